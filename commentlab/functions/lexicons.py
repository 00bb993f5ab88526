"""Word lists and patterns that define the results.

Operators take these as parameters, so another dictionary can be passed instead.
"""

# The classes, in the order of their ids.
LABELS = ("Negatif", "Netral", "Positif")

# Spellings an annotator may use for a label.
LABEL_ALIASES = {
    "positif": "Positif", "positive": "Positif", "pos": "Positif",
    "negatif": "Negatif", "negative": "Negatif", "neg": "Negatif",
    "netral": "Netral", "neutral": "Netral", "net": "Netral",
}

# Informal spelling -> standard spelling; an empty value deletes the word.
SLANG = {
    "gw": "saya", "gue": "saya", "gua": "saya", "lo": "kamu", "lu": "kamu", "elu": "kamu",
    "ga": "tidak", "gak": "tidak", "ngga": "tidak", "nggak": "tidak", "enggak": "tidak",
    "tdk": "tidak", "g": "tidak", "udah": "sudah", "dah": "sudah", "blm": "belum",
    "blom": "belum", "bgt": "sangat", "banget": "sangat", "bngt": "sangat", "bener": "benar",
    "lg": "lagi", "lgi": "lagi", "jg": "juga", "jga": "juga", "krn": "karena",
    "karna": "karena", "tp": "tapi", "tpi": "tapi", "yg": "yang", "yng": "yang",
    "dgn": "dengan", "dg": "dengan", "trs": "terus", "trus": "terus", "utk": "untuk",
    "buat": "untuk", "bwt": "untuk", "dri": "dari", "dr": "dari", "kl": "kalau",
    "klo": "kalau", "kalu": "kalau", "kalo": "kalau", "klu": "kalau", "sy": "saya",
    "q": "saya", "ntar": "nanti", "tar": "nanti", "aja": "saja", "gk": "tidak",
    "tak": "tidak", "gakk": "tidak", "sdh": "sudah", "org": "orang", "tau": "tahu",
    "cuma": "hanya", "kak": "", "bang": "", "kok": "", "kan": "", "jgn": "jangan",
    "jkw": "jokowi", "roi": "roy", "lah": "", "dong": "", "deh": "", "sih": "", "nih": "",
    "wkwk": "", "wkwkwk": "", "haha": "", "hehe": "", "hihi": "", "kwkw": "", "xD": "",
    "xd": "", "ok": "oke", "mantap": "mantap", "mantep": "mantap", "keren": "keren",
    "kerennn": "keren", "bagus": "bagus", "baguss": "bagus", "jelek": "jelek",
    "jelekk": "jelek", "gila": "gila", "gilaa": "gila", "bro": "", "gan": "", "min": "",
    "iya": "ya", "iyaa": "ya", "makasih": "terima kasih", "makasi": "terima kasih",
    "mksh": "terima kasih", "tks": "terima kasih", "smgt": "semangat",
    "subscribe": "berlangganan", "sub": "berlangganan", "like": "suka", "komen": "komentar",
    "share": "bagikan", "upload": "unggah", "konten": "konten", "channel": "saluran",
    "emang": "memang", "emg": "memang", "kayak": "seperti", "kyk": "seperti",
    "gitu": "begitu", "gtu": "begitu", "gini": "begini", "bgini": "begini",
    "gimana": "bagaimana", "gmn": "bagaimana", "knp": "kenapa", "krna": "karena",
    "bikin": "buat", "dpt": "dapat", "hrs": "harus", "blg": "bilang", "doang": "saja",
    "sgt": "sangat", "skrg": "sekarang", "skrng": "sekarang", "udh": "sudah",
    "kriminil": "kriminal", "jgan": "jangan", "sbnrnya": "sebenarnya", "jd": "jadi",
    "sm": "sama", "dn": "dan", "slalu": "selalu", "ijasah": "ijazah", "ijzah": "ijazah",
    "izajah": "ijazah", "ijazh": "ijazah",
}

# Words that carry no topic. Negators are left out on purpose.
STOPWORDS = (
    "yang", "dan", "di", "ke", "dari", "untuk", "dengan", "pada", "adalah", "ini", "itu",
    "atau", "juga", "sudah", "akan", "ada", "bisa", "lebih", "saat", "kami", "mereka",
    "kita", "anda", "ia", "dia", "kamu", "saya", "apa", "bagaimana", "mengapa", "ketika",
    "karena", "jika", "maka", "namun", "tetapi", "tapi", "saja", "lagi", "pun", "agar",
    "supaya", "ya", "telah", "sedang", "masih", "sangat", "sekali", "amat", "oleh",
    "dalam", "luar", "bawah", "atas", "antara", "setelah", "sebelum", "sejak", "selama",
    "sering", "kadang", "jarang", "selalu", "pernah", "satu", "dua", "tiga", "beberapa",
    "setiap", "semua", "lain", "sama", "baru", "lama", "besar", "kecil", "nya", "si",
)

# Stance words a stemmer must leave whole.
PROTECTED_ROOTS = (
    "setuju", "sependapat", "sepaham", "sepakat", "seting", "setting", "setel", "mentri",
)

# Words that negate the next one.
NEGATORS = (
    "tidak", "bukan", "jangan", "tdk", "gak", "ga", "nggak", "tak", "belum", "tanpa",
    "jgn", "ngga", "kaga", "kagak", "engga", "enggak", "ndak", "gk",
)

# Domain flags, each a pattern searched in the lower-case text.
DOMAIN_PATTERNS = {
    "accuser": r"\broy\b|suryo|\broi\b|panci|\brrt\b|rismon|\btifa\b|rizal|fadhilah|fadilah|penuduh|menuduh",
    "subject": r"jokowi|mulyono|pria solo|\bjkw\b|\bugm\b|rektor|dekan",
    "punish": r"penjara|adili|tangkap|\btahan\b|ditahan|\bbui\b|laporin|dipenjara|dihukum|\bhukum\b|tersangka|jeblos|borgol",
    "attack": r"stres|stress|gila|bodoh|goblok|tolol|dungu|odgj|sakit hati|dendam|najis|laknat|setan|bohong|pembohong|sinting|edan|sarap|bego|kurang ajar",
    "false_claim": r"palsu|bodong|edit|rekayasa|tipu|aspal|abal",
    "genuine": r"asli|terbukti|\bsah\b|valid",
    "slander": r"fitnah|hoax|hoaks|cari sensasi|cari panggung|pencemaran",
    "negator": r"\b(tidak|bukan|jangan|tdk|gak|nggak|tak|belum|tanpa|jgn|ngga)\b",
}

# Words too general for a list of domain terms.
GENERIC_TERMS = (
    "tidak", "orang", "kalau", "yang", "dan", "atau", "ini", "itu", "saya", "kamu", "dia",
    "mereka", "kita", "kami", "aja", "saja", "pak", "bu", "para", "dengan", "untuk",
    "dari", "ke", "di",
)

# Code points removed as emoji. The range from 24C2 to 1F251 is wide on
# purpose: it also takes kana, Han and Hangul with it.
EMOJI_RANGES = (
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F),
    (0x1F780, 0x1F7FF), (0x1F800, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F),
    (0x1FA70, 0x1FAFF), (0x2702, 0x27B0), (0x24C2, 0x1F251), (0x1F926, 0x1F937),
    (0x200D, 0x200D), (0x2640, 0x2642), (0x2600, 0x2B55), (0x23CF, 0x23CF),
    (0x23E9, 0x23E9), (0x231A, 0x231A), (0xFE0F, 0xFE0F), (0x3030, 0x3030),
)

# A narrower choice that leaves letters of all scripts alone.
EMOJI_RANGES_STRICT = (
    (0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F1E6, 0x1F1FF),
    (0x200D, 0x200D), (0xFE0F, 0xFE0F),
)

# Video link shapes, tried in this order.
VIDEO_URL_PATTERNS = (
    r"(?:youtube\.com/watch\?(?:[^&]*&)*v=)([a-zA-Z0-9_-]{11})",
    r"(?:youtu\.be/)([a-zA-Z0-9_-]{11})",
    r"(?:youtube\.com/embed/)([a-zA-Z0-9_-]{11})",
    r"(?:youtube\.com/shorts/)([a-zA-Z0-9_-]{11})",
    r"(?:youtube\.com/v/)([a-zA-Z0-9_-]{11})",
)
VIDEO_ID_PATTERN = r"^[a-zA-Z0-9_-]{11}$"

# Error reasons that mean the daily allowance is used up.
QUOTA_REASONS = ("quotaExceeded", "dailyLimitExceeded")

# Spellings of true and false.
TRUE_WORDS = ("true", "1", "yes", "y", "benar")
FALSE_WORDS = ("false", "0", "no", "n", "salah")
TRUE_WORDS_SHORT = ("true", "1", "yes", "benar")
FALSE_WORDS_SHORT = ("false", "0", "no", "salah")

# States of a job.
JOB_STATUSES = ("pending", "running", "completed", "failed")
