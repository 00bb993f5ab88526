"""Plain Python versions of the operators, from their contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = TEST_WORD.findall(lower(text))
        if not w:
            continue
        n = min(size, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item if item is None else str(item))
    widths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = TEST_WORD.findall(lower(text))
        hit, found = set(), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found - {None}))), bool(hit)))
    return out


ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def op4(text):
    text = text or ""
    a = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    b = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    c = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = [("assign", a), ("access", b), ("hex", c)]
    rows = sorted((s, k, e, n) for k, (n, x) in enumerate(kinds) for s, e in x)
    base = [f"{n}:{s}:{e}" for s, _, e, n in rows]
    return len(a), len(b), len(c), sha(",".join(base)), base


def op6(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    inside = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside), failed


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def op8(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [
        m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(p) <= 255 for p in m[0].split("."))
    ]
    card = [
        m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
        if 16 <= len(digits(m)) <= 19 and luhn(digits(m))
    ]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    kinds = [("email", email), ("ip", ip), ("card", card), ("phone", phone)]
    base = [f"{n}:{s}:{e}" for n, x in kinds for s, e in x]
    return len(email), len(ip), len(card), len(phone), sha(",".join(base)), base


def fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """Smallest id reachable, of (id, fingerprint) rows."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= radius:
                root[max(top(p), top(q))] = min(top(p), top(q))
    least = {}
    for d, p in prints:
        r = top(p)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return [least[top(p)] for _, p in prints]
