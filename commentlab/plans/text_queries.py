"""Text operators over the documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators.stemming import distinct_stems, stem_tokens
from ..session import materialize
from . import sqltext as st
from .registry import query
from .tables import (
    COMMENTS_SQL,
    LABELLED_SQL,
    NAME_SQL,
    PREDICTIONS_SQL,
    comments,
    labelled,
    predictions,
    table,
    text_table,
)

# Small dictionaries for the languages of the test tables.
DEMO_SLANG = {
    "th": "the", "ou": "you all", "ing": "", "er": "her", "nd": "and", "st": "saint",
    "re": "again", "n": "not", "tion": "", "eau": "water",
}
DEMO_STOPWORDS = (
    "the", "of", "de", "and", "to", "en", "in", "la", "der", "is", "que", "that", "le",
    "on", "it", "for", "as", "was", "be", "die",
)
DEMO_NEGATORS = ("not", "nicht", "pas")
DEMO_PATTERNS = {
    "accuser": r"\bthe\b|tion",
    "subject": r"und|eaux|\bque\b",
    "punish": r"worth|less",
    "attack": r"sh\b|hand",
    "false_claim": r"wh(er|on)",
    "genuine": r"ieux|ment\b",
    "slander": r"cht|\bdes\b",
    "negator": r"\b(not|nicht|pas|no)\b",
}

DOCS = "documents"


def docs(spark, sf, *cols):
    return text_table(spark, sf, DOCS).select(F.col("doc_id").alias("comment_id"), *cols)


@query("clean_aggressive", "T1 F1 F3",
       f"SELECT doc_id AS comment_id, {st.clean_aggressive('text')} AS clean FROM documents")
def clean_aggressive(spark, sf):
    return docs(spark, sf, tx.clean_aggressive("text").alias("clean"))


@query("clean_aggressive_pages", "T1",
       f"SELECT page_id, {st.clean_aggressive('html')} AS clean FROM pages")
def clean_aggressive_pages(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", tx.clean_aggressive("html").alias("clean"))


@query("clean_minimal", "T2 T8 F2",
       f"SELECT doc_id AS comment_id, {st.clean_minimal('text')} AS clean FROM documents")
def clean_minimal(spark, sf):
    return docs(spark, sf, tx.clean_minimal("text").alias("clean"))


@query("strip_emoji", "T3",
       f"SELECT doc_id AS comment_id, md5({st.no_emoji('text')}) AS text_md5 FROM documents")
def strip_emoji(spark, sf):
    return docs(spark, sf, F.md5(tx.strip_emoji("text")).alias("text_md5"))


@query("slang_replacement", "T4",
       "SELECT doc_id AS comment_id, "
       f"{st.join_words(st.replace_words(st.words(st.clean_aggressive('text')), DEMO_SLANG))} AS replaced "
       "FROM documents")
def slang_replacement(spark, sf):
    clean = tx.clean_aggressive("text")
    return docs(spark, sf, tx.normalize_slang(clean, DEMO_SLANG).alias("replaced"))


@query("tokenize", "T5 F3",
       f"SELECT doc_id AS comment_id, CAST(len({st.words('text')}) AS INTEGER) AS n_tokens, "
       f"md5({st.join_words(st.words('text'))}) AS tokens_md5 FROM documents")
def tokenize(spark, sf):
    t = tx.tokens("text")
    return docs(spark, sf, F.size(t).alias("n_tokens"),
                F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("stopword_removal", "T6",
       "SELECT doc_id AS comment_id, "
       f"{st.join_words(st.drop_stopwords(st.words(st.clean_aggressive('text')), DEMO_STOPWORDS))} AS kept "
       "FROM documents")
def stopword_removal(spark, sf):
    t = tx.drop_stopwords(tx.tokens(tx.clean_aggressive("text")), DEMO_STOPWORDS)
    return docs(spark, sf, F.array_join(t, " ").alias("kept"))


@query("feature_text", "T7 F1",
       "SELECT doc_id AS comment_id, "
       f"{st.join_words(st.feature_words('text', DEMO_SLANG, DEMO_STOPWORDS))} AS feature FROM documents")
def feature_text(spark, sf):
    return docs(spark, sf, tx.feature_text("text", DEMO_SLANG, DEMO_STOPWORDS).alias("feature"))


@query("feature_text_indonesian", "T7",
       "SELECT conv_id, turn, "
       f"{st.join_words(st.feature_words('text', lx.SLANG, lx.STOPWORDS))} AS feature FROM conversations")
def feature_text_indonesian(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.feature_text("text").alias("feature"))


# A stem table as data: every word of the corpus that ends in -s, and the word without it.
STEMS_SQL = f"""WITH words AS (
  SELECT doc_id, unnest({st.words(st.clean_aggressive('text'))}) AS token FROM documents)
SELECT DISTINCT token, substr(token, 1, length(token) - 1) AS stem
FROM words WHERE length(token) > 3 AND token LIKE '%s'"""


def demo_stems(spark, sf):
    words = docs(spark, sf, F.explode(tx.tokens(tx.clean_aggressive("text"))).alias("token"))
    plural = words.filter((F.length("token") > 3) & F.col("token").endswith("s"))
    return plural.select("token").distinct().withColumn(
        "stem", F.expr("substr(token, 1, length(token) - 1)"))


@query("stem_vocabulary", "T9 F5", f"""WITH words AS (
  SELECT DISTINCT unnest({st.words(st.clean_aggressive('text'))}) AS token FROM documents),
stems AS ({STEMS_SQL})
SELECT w.token, CASE WHEN w.token IN ('this', 'les', 'des') THEN w.token
                     ELSE coalesce(s.stem, w.token) END AS stem
FROM words w LEFT JOIN stems s ON w.token = s.token""")
def stem_vocabulary(spark, sf):
    words = docs(spark, sf, tx.tokens(tx.clean_aggressive("text")).alias("tokens"))
    return distinct_stems(words, "tokens", demo_stems(spark, sf), ("this", "les", "des"))


@query("stem_text", "T9 F1", f"""WITH words AS (
  SELECT doc_id, unnest({st.words(st.clean_aggressive('text'))}) AS token,
         generate_subscripts({st.words(st.clean_aggressive('text'))}, 1) AS pos FROM documents),
stems AS ({STEMS_SQL})
SELECT d.doc_id AS comment_id, coalesce(t.stemmed, '') AS stemmed FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN w.token IN ('this', 'les', 'des') THEN w.token
                            ELSE coalesce(s.stem, w.token) END, ' ' ORDER BY pos) AS stemmed
  FROM words w LEFT JOIN stems s ON w.token = s.token GROUP BY doc_id) t ON d.doc_id = t.doc_id""")
def stem_text(spark, sf):
    words = docs(spark, sf, tx.tokens(tx.clean_aggressive("text")).alias("tokens"))
    # The stem table is used more than once, so it is written, not recomputed.
    stems = materialize(demo_stems(spark, sf), "stems")
    stemmed = stem_tokens(words, "comment_id", "tokens", stems, ("this", "les", "des"))
    return stemmed.select("comment_id", F.array_join("tokens", " ").alias("stemmed"))


@query("readable_texts", "T10",
       f"""WITH t AS (SELECT doc_id, {st.squeeze('text')} AS sq,
  {st.gsub('text', rf'^[{st.SPACE}]+|[{st.SPACE}]+$', '')} AS tr FROM documents)
SELECT doc_id AS comment_id, length(tr) >= 3 AND regexp_matches(sq, '[A-Za-z]{{3,}}')
  AND length({st.gsub('sq', r'[^\pL]', '')})
      / greatest(length({st.gsub('sq', f'[{st.SPACE}]', '')}), 1) >= 0.5 AS readable
FROM t""")
def readable_texts(spark, sf):
    return docs(spark, sf, tx.is_readable("text").alias("readable"))


@query("dedup_keys", "T11",
       f"""WITH t AS (SELECT doc_id, lower({st.squeeze('text')}) AS norm FROM documents)
SELECT md5(norm) AS norm_md5, count(*) AS n, min(doc_id) AS first_id FROM t GROUP BY 1""")
def dedup_keys(spark, sf):
    return (
        docs(spark, sf, F.md5(tx.dedup_key("text")).alias("norm_md5"))
        .groupBy("norm_md5").agg(F.count("*").alias("n"), F.min("comment_id").alias("first_id"))
    )


LIGHT = st.gsub("coalesce(text, '')", rf"[{st.SPACE}\x{{200B}}]+")


@query("light_normalization", "T12",
       f"SELECT doc_id AS comment_id, trim({LIGHT}) AS clean FROM documents")
def light_normalization(spark, sf):
    return docs(spark, sf, tx.normalize_light("text").alias("clean"))


@query("first_nonempty_text", "T13 T30",
       """SELECT d.doc_id AS comment_id,
  md5(coalesce(nullif(CASE WHEN d.lang = 'en' THEN NULL WHEN d.lang = 'fr' THEN '' ELSE d.source END, ''),
               nullif(d.text, ''), '')) AS text_md5 FROM documents d""")
def first_nonempty_text(spark, sf):
    original = F.when(F.col("lang") == "fr", "").when(F.col("lang") != "en", F.col("source"))
    return docs(spark, sf, F.md5(tx.first_nonempty(original, F.col("text"))).alias("text_md5"))


@query("labelling_candidates", "T14",
       f"""WITH t AS (SELECT conv_id, turn, trim({LIGHT}) AS clean FROM conversations)
SELECT conv_id, turn, CAST(len(string_split(clean, ' ')) AS INTEGER) AS n_words FROM t
WHERE clean <> '' AND regexp_matches(clean, '[\\pL\\pN]') AND len(string_split(clean, ' ')) >= 3""")
def labelling_candidates(spark, sf):
    return (
        table(spark, sf, "conversations").filter(tx.is_candidate("text"))
        .select("conv_id", "turn", tx.word_count(tx.normalize_light("text")).alias("n_words"))
    )


@query("word_counts", "T15",
       f"""WITH t AS (SELECT doc_id, {st.squeeze('text')} AS sq, {st.clean_aggressive('text')} AS cl
FROM documents)
SELECT doc_id AS comment_id,
  CAST(CASE WHEN sq = '' THEN 0 ELSE len(string_split(sq, ' ')) END AS INTEGER) AS n_raw,
  CAST(CASE WHEN cl = '' THEN 0 ELSE len(string_split(cl, ' ')) END AS INTEGER) AS n_clean FROM t""")
def word_counts(spark, sf):
    return docs(spark, sf, tx.word_count("text").alias("n_raw"),
                tx.word_count(tx.clean_aggressive("text")).alias("n_clean"))


@query("word_ngrams", "T16",
       f"""WITH t AS (SELECT doc_id, unnest({st.words(st.clean_aggressive('text'))}) AS w,
  generate_subscripts({st.words(st.clean_aggressive('text'))}, 1) AS p FROM documents),
g AS (SELECT w AS gram, 1 AS n FROM t UNION ALL
      SELECT a.w || ' ' || b.w, 2 FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + 1)
SELECT gram, n, count(*) AS occurrences FROM g GROUP BY gram, n""")
def word_ngrams(spark, sf):
    words = docs(spark, sf, tx.tokens(tx.clean_aggressive("text")).alias("words"))
    return (
        words.select(F.explode(tx.word_ngrams(F.col("words"), 2)).alias("gram"))
        .groupBy("gram").agg(F.count("*").alias("occurrences"))
        .withColumn("n", F.size(F.split("gram", " ")))
    )


@query("char_ngrams", "T17",
       f"""WITH w AS (SELECT ' ' || unnest({st.words(st.clean_aggressive('text'))}) || ' ' AS w
  FROM documents),
v AS (SELECT w, count(*) AS c FROM w GROUP BY w),
g AS (SELECT substr(v.w, CAST(i AS INTEGER), n) AS gram, c FROM v, (VALUES (3), (4), (5)) s(n),
        unnest(generate_series(1, greatest(length(v.w) - n + 1, 1))) u(i)
      WHERE length(v.w) >= n)
SELECT gram, CAST(sum(c) AS BIGINT) AS occurrences FROM g GROUP BY gram""")
def char_ngrams(spark, sf):
    # Distinct words first: the letter runs of a word are made once, not once per use.
    words = docs(spark, sf, F.explode(tx.tokens(tx.clean_aggressive("text"))).alias("w"))
    return (
        words.groupBy("w").agg(F.count("*").alias("c"))
        .select(F.explode(tx.char_ngrams(F.array("w"))).alias("gram"), "c")
        .groupBy("gram").agg(F.sum("c").alias("occurrences"))
    )


NEG_WORDS = "|".join(DEMO_NEGATORS)


@query("negation_merge", "T18",
       "SELECT doc_id AS comment_id, md5(regexp_replace("
       f"{st.clean_aggressive('text')}, '(^| )({NEG_WORDS}) ([^ ]+)', '\\1\\2_\\3', 'g')) AS merged_md5, "
       f"len(regexp_extract_all({st.clean_aggressive('text')}, '(^| )({NEG_WORDS}) ([^ ]+)')) AS n_merged "
       "FROM documents")
def negation_merge(spark, sf):
    clean = docs(spark, sf, tx.clean_aggressive("text").alias("clean"))
    merged = tx.merge_negation("clean", DEMO_NEGATORS)
    return clean.select(
        "comment_id", F.md5(merged).alias("merged_md5"),
        (F.length("clean") - F.length(F.translate("clean", " ", ""))
         - F.length(merged) + F.length(F.translate(merged, " ", ""))).cast("bigint").alias("n_merged"))


FLAGS_SQL = ", ".join(
    f"CAST({st.has_match('lower(text)', p)} AS INTEGER) AS {n}"
    for n, p in DEMO_PATTERNS.items())


@query("domain_flags", "T19 T20", f"""WITH f AS (SELECT doc_id AS comment_id, {FLAGS_SQL} FROM documents)
SELECT *, accuser * greatest(punish, attack) AS accuser_hostile,
  subject * greatest(punish, attack) AS subject_hostile, accuser * slander AS accuser_slander,
  false_claim AS verdict_false, genuine AS verdict_genuine FROM f""")
def domain_flags(spark, sf):
    flags = docs(spark, sf, "text").select(
        "comment_id", *[c.alias(n) for n, c in tx.domain_flags("text", DEMO_PATTERNS).items()])
    return flags.select("*", *[c.alias(n) for n, c in tx.flag_interactions().items()])


REAL_TEXT = "concat(lang, ' gak ', text, ' tidak bisa yg korupsi ', lang)"


@query("full_word_lists", "T4 T6 T18 T19", f"""WITH c AS (SELECT doc_id AS comment_id, {REAL_TEXT} AS t FROM documents),
w AS (SELECT comment_id, lower(t) AS low, {st.join_words(st.feature_words('t', lx.SLANG, lx.STOPWORDS))} AS words FROM c)
SELECT comment_id, md5(words) AS words_md5,
  md5(regexp_replace(words, '(^| )({'|'.join(lx.NEGATORS)}) ([^ ]+)', '\\1\\2_\\3', 'g')) AS negated_md5,
  {', '.join(f"CAST({st.has_match('low', p)} AS INTEGER) AS {n}" for n, p in lx.DOMAIN_PATTERNS.items())} FROM w""")
def full_word_lists(spark, sf):
    """The whole lists of the operators' defaults, on texts that hold some of their words."""
    text = F.concat(F.col("lang"), F.lit(" gak "), F.col("text"), F.lit(" tidak bisa yg korupsi "), F.col("lang"))
    rows = text_table(spark, sf, DOCS).select(F.col("doc_id").alias("comment_id"), text.alias("t"))
    rows = rows.withColumn("words", tx.feature_text("t"))
    return rows.select(
        "comment_id", F.md5("words").alias("words_md5"), F.md5(tx.merge_negation("words")).alias("negated_md5"),
        *[c.alias(n) for n, c in tx.domain_flags("t").items()])


@query("text_preview", "T21",
       "SELECT doc_id AS comment_id, CASE WHEN length(text) > 170 THEN substr(text, 1, 170) || '...' "
       "ELSE text END AS preview FROM documents")
def text_preview(spark, sf):
    return docs(spark, sf, tx.preview("text").alias("preview"))


@query("keyword_search", "T22",
       "SELECT doc_id AS comment_id, regexp_matches(text, '(?i)th.t|worth') AS by_pattern, "
       "contains(lower(text), 'th.t') AS by_literal FROM documents "
       "WHERE regexp_matches(text, '(?i)th.t|worth') OR contains(lower(text), 'th.t')")
def keyword_search(spark, sf):
    by_pattern = tx.matches_keyword("text", "th.t|worth")
    by_literal = tx.matches_keyword("text", "th.t", literal=True)
    return docs(spark, sf, "text").filter(by_pattern | by_literal).select(
        "comment_id", by_pattern.alias("by_pattern"), by_literal.alias("by_literal"))


RAW_LABEL_SQL = """CASE WHEN lang = 'en' THEN upper({n}) || ' ' WHEN lang = 'fr' THEN lower(substr({n}, 1, 3))
  WHEN lang = 'de' THEN CASE label_id WHEN 0 THEN 'Negative' WHEN 1 THEN ' neutral' ELSE 'POSITIVE' END
  ELSE 'unsure' END""".format(n=NAME_SQL.format("label_id"))


def raw_label():
    name = lb.label_name("label_id")
    german = F.when(F.col("label_id") == 0, "Negative").when(F.col("label_id") == 1, " neutral").otherwise("POSITIVE")
    return (
        F.when(F.col("lang") == "en", F.concat(F.upper(name), F.lit(" ")))
        .when(F.col("lang") == "fr", F.lower(F.substring(name, 1, 3)))
        .when(F.col("lang") == "de", german)
        .otherwise("unsure")
    )


@query("canonical_labels", "T23 T24", f"""WITH {LABELLED_SQL},
r AS (SELECT comment_id, lower(trim({RAW_LABEL_SQL})) AS k FROM labelled),
c AS (SELECT comment_id, CASE WHEN k IN ('positif', 'positive', 'pos') THEN 'Positif'
  WHEN k IN ('negatif', 'negative', 'neg') THEN 'Negatif'
  WHEN k IN ('netral', 'neutral', 'net') THEN 'Netral' END AS label FROM r)
SELECT comment_id, label,
  CAST(CASE label WHEN 'Negatif' THEN 0 WHEN 'Netral' THEN 1 WHEN 'Positif' THEN 2 END AS INTEGER) AS label_id
FROM c""")
def canonical_labels(spark, sf):
    raw = labelled(spark, sf).select("comment_id", lb.canonical_label(raw_label()).alias("label"))
    return raw.withColumn("label_id", lb.label_id("label"))


@query("strict_labels", "T25", f"""WITH {LABELLED_SQL}
SELECT {NAME_SQL.format('label_id')} AS label, count(*) AS n FROM labelled GROUP BY 1""")
def strict_labels(spark, sf):
    shouted = F.concat(F.lit(" "), F.upper(lb.label_name("label_id")))
    return labelled(spark, sf).select(lb.strict_label(shouted).alias("label")).groupBy("label").agg(
        F.count("*").alias("n"))


@query("tolerant_booleans", "T26", """SELECT event_id,
  CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN TRUE
       WHEN event_type = 'error' THEN FALSE END AS flag,
  CASE WHEN event_type IN ('view', 'purchase') THEN TRUE END AS flag_short FROM events""")
def tolerant_booleans(spark, sf):
    kind = F.col("event_type")
    word = (
        F.when(kind == "view", " TRUE ").when(kind == "signup", "Y").when(kind == "purchase", "benar")
        .when(kind == "error", "N").otherwise("maybe"))
    return table(spark, sf, "events").select(
        "event_id", lb.tolerant_bool(word).alias("flag"),
        lb.tolerant_bool(word, lx.TRUE_WORDS_SHORT, lx.FALSE_WORDS_SHORT).alias("flag_short"))


@query("sortable_confidence", "T27 I2", """SELECT event_id,
  coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN NULL
                    ELSE CAST(value AS VARCHAR) END AS DOUBLE), -1.0) AS confidence,
  coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(user_id * 1000000 AS VARCHAR) || chr(10) END AS BIGINT), 0) AS safe
FROM events""")
def sortable_confidence(spark, sf):
    kind = F.col("event_type")
    raw = F.when(kind == "error", "n/a").when(kind != "view", F.col("value").cast("string"))
    count = F.when(kind == "error", "x").otherwise(F.concat((F.col("user_id") * 1_000_000).cast("string"), F.lit("\n")))
    return table(spark, sf, "events").select(
        "event_id", lb.sortable_confidence(raw).alias("confidence"), lb.safe_int(count).alias("safe"))


@query("error_pairs", "T28", f"""WITH {PREDICTIONS_SQL}
SELECT comment_id, {NAME_SQL.format('actual')} || ' → ' || {NAME_SQL.format('predicted')} AS error_pair,
  CASE WHEN actual = predicted THEN 'Benar' ELSE 'Salah' END AS error_status FROM predictions""")
def error_pairs(spark, sf):
    p = predictions(spark, sf)
    return p.select(
        "comment_id",
        lb.error_pair(lb.label_name("actual"), lb.label_name("predicted")).alias("error_pair"),
        lb.error_status(F.col("actual") == F.col("predicted")).alias("error_status"))


LOWER = "lower(text)"
TRACE_CLEAN = st.clean_aggressive("text")
TRACE_SLANG = st.join_words(st.replace_words(st.words(TRACE_CLEAN), DEMO_SLANG))


@query("stage_trace", "T29", f"""SELECT comment_id, {st.squeeze(LOWER)} AS stage_lower,
  {st.squeeze(st.no_url(LOWER))} AS stage_no_url,
  {st.squeeze(st.no_mention(st.no_url(LOWER)))} AS stage_no_mention,
  {st.squeeze(st.no_hashtag(st.no_mention(st.no_url(LOWER))))} AS stage_no_hashtag,
  {TRACE_CLEAN} AS stage_clean, {TRACE_SLANG} AS stage_slang,
  CAST(len({st.words(TRACE_SLANG)}) AS INTEGER) AS stage_n_tokens,
  {st.join_words(st.drop_stopwords(st.words(TRACE_SLANG), DEMO_STOPWORDS))} AS stage_feature
FROM (SELECT conv_id * 1000 + turn AS comment_id, text FROM conversations)""")
def stage_trace(spark, sf):
    turns = table(spark, sf, "conversations").withColumn(
        "comment_id", F.col("conv_id") * 1000 + F.col("turn"))
    stages = tx.stage_trace("text", DEMO_SLANG, DEMO_STOPWORDS)
    return turns.select("comment_id", *[c.alias(n) for n, c in stages.items()])


@query("unlabelled_text_default", "T30", f"""WITH {COMMENTS_SQL}
SELECT comment_id, coalesce(CASE WHEN label_id IS NULL THEN NULL ELSE lang END, '') AS value FROM comments""")
def unlabelled_text_default(spark, sf):
    value = F.when(F.col("label_id").isNotNull(), F.col("lang"))
    return comments(spark, sf).select("comment_id", F.coalesce(value, F.lit("")).alias("value"))
