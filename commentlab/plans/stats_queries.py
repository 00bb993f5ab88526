"""Counts, lengths, vocabulary, lift and other corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import ranking, sketches, stats
from ..operators.keyed import explode_rows, top_per_key, union_all
from ..session import materialize, new_path
from ..sources import writers
from . import sqltext as st
from .ranking_queries import SPLIT_SQL
from .registry import query
from .tables import (
    COMMENTS_SQL,
    LABEL_DIM_SQL,
    LABELLED_SQL,
    NAME_SQL,
    PREDICTIONS_SQL,
    comments,
    label_dim,
    labelled,
    predictions,
    table,
    text_table,
    texts,
)
from .text_queries import DEMO_SLANG, DEMO_STOPWORDS

FEATURE_SQL = st.feature_words("text", DEMO_SLANG, DEMO_STOPWORDS)
TOKENS_SQL = LABELLED_SQL + f""", docs AS (
  SELECT comment_id, label_id, {FEATURE_SQL} AS ws FROM labelled),
tokens AS (SELECT comment_id, label_id, unnest(ws) AS token FROM docs)"""


def feature_docs(spark, sf):
    return labelled(spark, sf).select(
        "comment_id", "label_id", tx.feature_tokens("text", DEMO_SLANG, DEMO_STOPWORDS).alias("words"))


def feature_tokens(spark, sf):
    return explode_rows(feature_docs(spark, sf), ["comment_id", "label_id"], "words", "token")


@query("class_terms_by_lift", "A11 J8 G14", f"""WITH {TOKENS_SQL},
ct AS (SELECT label_id, count(*) AS class_total FROM tokens GROUP BY 1),
al AS (SELECT token, count(*) AS n_all FROM tokens GROUP BY 1 HAVING count(*) >= 5),
pc AS (SELECT label_id, token, count(*) AS n_in FROM tokens GROUP BY 1, 2),
sc AS (SELECT pc.label_id, pc.token, n_in,
         round((n_in / class_total) / (n_all / (SELECT count(*) FROM tokens)), 6) AS lift
       FROM pc JOIN al ON pc.token = al.token JOIN ct ON pc.label_id = ct.label_id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY label_id ORDER BY lift DESC, token) AS INTEGER) AS rank FROM sc)
SELECT label_id, rank, token, lift, n_in FROM rk WHERE rank <= 12""")
def class_terms_by_lift(spark, sf):
    return stats.class_terms(feature_tokens(spark, sf), "token", "label_id")


@query("class_terms_by_document_lift", "A12", f"""WITH {TOKENS_SQL},
dt AS (SELECT DISTINCT comment_id, label_id, token FROM tokens),
ct AS (SELECT label_id, count(*) AS class_total FROM docs GROUP BY 1),
al AS (SELECT token, count(*) AS n_all FROM dt GROUP BY 1 HAVING count(*) >= 8),
pc AS (SELECT label_id, token, count(*) AS n_in FROM dt GROUP BY 1, 2),
sc AS (SELECT pc.label_id, pc.token, n_in,
         round((n_in / class_total) / (n_all / (SELECT count(*) FROM docs)), 6) AS lift
       FROM pc JOIN al ON pc.token = al.token JOIN ct ON pc.label_id = ct.label_id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY label_id ORDER BY lift DESC, token) AS INTEGER) AS rank FROM sc)
SELECT label_id, rank, token, lift, n_in FROM rk WHERE rank <= 12""")
def class_terms_by_document_lift(spark, sf):
    return stats.class_terms_by_document(feature_docs(spark, sf), "words", "label_id")


@query("class_distribution", "A1",
       f"WITH {LABELLED_SQL} SELECT label_id, count(*) AS n FROM labelled GROUP BY 1 ORDER BY 1")
def class_distribution(spark, sf):
    return stats.class_distribution(labelled(spark, sf), "label_id").orderBy("label_id")


@query("class_distribution_with_absent", "A2", f"""WITH {PREDICTIONS_SQL}, {LABEL_DIM_SQL}
SELECT d.label_id, d.label, count(p.comment_id) AS n
FROM label_dim d LEFT JOIN predictions p ON p.actual = d.label_id AND p.predicted = 1 GROUP BY 1, 2""")
def class_distribution_with_absent(spark, sf):
    found = predictions(spark, sf).filter(F.col("predicted") == 1)
    counts = stats.class_distribution(found.select(F.col("actual").alias("label_id")), "label_id")
    return stats.with_absent(counts, label_dim(spark), "label_id")


def three_texts(spark, sf, *keep):
    return texts(spark, sf).select(
        *keep, "text", tx.feature_text("text", DEMO_SLANG, DEMO_STOPWORDS).alias("feature"),
        tx.clean_minimal("text").alias("minimal"))


def wc_sql(expr: str) -> str:
    return f"(CASE WHEN {expr} = '' THEN 0 ELSE len(string_split({expr}, ' ')) END)"


THREE_SQL = f"""t AS (SELECT {st.squeeze('text')} AS a, {st.join_words(FEATURE_SQL)} AS b,
  {st.clean_minimal('text')} AS c FROM documents),
n AS (SELECT {wc_sql('a')} AS raw, {wc_sql('b')} AS feature, {wc_sql('c')} AS minimal FROM t)"""


@query("length_profile", "A3 A4", f"""WITH {THREE_SQL}
SELECT round(avg(raw), 6) AS avg_raw, round(avg(feature), 6) AS avg_feature,
  round(avg(minimal), 6) AS avg_minimal,
  CAST(floor(quantile_cont(raw, 0.5)) AS INTEGER) AS median_raw,
  CAST(floor(quantile_cont(feature, 0.5)) AS INTEGER) AS median_feature,
  CAST(floor(quantile_cont(minimal, 0.5)) AS INTEGER) AS median_minimal,
  CAST(max(raw) AS INTEGER) AS max_raw, CAST(max(feature) AS INTEGER) AS max_feature FROM n""")
def length_profile(spark, sf):
    texts = {"raw": "text", "feature": "feature", "minimal": "minimal"}
    return stats.length_profile(three_texts(spark, sf), texts, ["raw", "feature"], digits=6)


@query("approximate_median_lengths", "A4")
def approximate_median_lengths(spark, sf):
    return stats.approximate_medians(three_texts(spark, sf), {"raw": "text", "feature": "feature"})


@query("length_summary", "A5", f"""WITH {THREE_SQL}
SELECT round(avg(feature), 6) AS mean_words, quantile_cont(CAST(feature AS DOUBLE), 0.5) AS median_words,
  quantile_cont(CAST(feature AS DOUBLE), 0.95) AS p95_words, CAST(max(feature) AS INTEGER) AS max_words,
  count(*) FILTER (feature <= 1) AS n_short FROM n""")
def length_summary(spark, sf):
    return stats.length_summary(three_texts(spark, sf), "feature")


@query("vocabulary_size", "A6", f"WITH {TOKENS_SQL} SELECT count(DISTINCT token) AS vocab_size FROM tokens")
def vocabulary_size(spark, sf):
    return stats.vocabulary_size(feature_tokens(spark, sf), "token")


@query("vocabulary_size_approximate", "A6")
def vocabulary_size_approximate(spark, sf):
    return stats.vocabulary_size(feature_tokens(spark, sf), "token", approximate=True)


def sketched(spark, df, part, first, numbers=(), items=()):
    """The stored sketches of all parts. Those of ``first`` come before the rest, which reads only its own rows."""
    target = new_path(spark, "sketches")
    for rows in (df.filter(first), df.filter(~first)):
        made = sketches.part_sketches(rows, part, numbers, items)
        sketches.store_parts(made, part, target)
    return sketches.stored_parts(spark, target, part, made.schema)


QUANTILES = (0.25, 0.5, 0.75, 0.95)


@query("sketched_lengths", "A4", """SELECT t.name, q.q, (SELECT count(*) FROM documents) AS n, TRUE AS "close"
FROM (VALUES ('raw'), ('feature')) t(name), (VALUES (0.25::DOUBLE), (0.5), (0.75), (0.95)) q(q)""")
def sketched_lengths(spark, sf):
    """Quantiles of text lengths from sketches per language, held against the exact ranks of all rows:
    at most 1 % off."""
    lengths = materialize(three_texts(spark, sf, "lang").select(
        "lang", tx.word_count("text").alias("raw"), tx.word_count("feature").alias("feature")), "lengths")
    parts = sketched(spark, lengths, "lang", F.col("lang").eqNullSafe("en"), ["raw", "feature"])
    figures = [F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), sketches.quantile(name, q).alias("estimate"))
               for name in ("raw", "feature") for q in QUANTILES]
    found = materialize(sketches.merged(parts).select("n", F.inline(F.array(*figures))), "quantiles")
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("words")) for c in ("raw", "feature")))
    bounds = sketches.rank_bounds(lengths.select(F.inline(each)), "name", "words", found.drop("n"))
    close = (F.col("below") <= F.col("q") + 0.01) & (F.col("upto") >= F.col("q") - 0.01)
    return found.join(bounds, ["name", "q"]).select("name", "q", "n", close.alias("close"))


@query("sketched_vocabulary", "A6", f"""WITH {TOKENS_SQL}, t AS (SELECT lang, token FROM tokens JOIN labelled USING (comment_id))
SELECT coalesce(lang, 'all') AS part, count(*) AS n, count(DISTINCT token) AS vocab_size, TRUE AS "close"
FROM t GROUP BY GROUPING SETS ((lang), ())""")
def sketched_vocabulary(spark, sf):
    """Vocabulary per language and of all, from one sketch per language, held against exact counts: at
    most 5 % off."""
    docs = labelled(spark, sf).select("lang", tx.feature_tokens("text", DEMO_SLANG, DEMO_STOPWORDS).alias("words"))
    tokens = materialize(explode_rows(docs, ["lang"], "words", "token"), "tokens")
    parts = sketched(spark, tokens, "lang", F.col("lang").eqNullSafe("en"), items=["token"])
    both = union_all([
        sketches.merged(parts, ["lang"]).select(F.col("lang").alias("part"), "n", sketches.distinct("token").alias("estimate")),
        sketches.merged(parts).select(F.lit("all").alias("part"), "n", sketches.distinct("token").alias("estimate"))])
    used = tokens.select("lang", "token").distinct()
    exact = used.groupBy(F.col("lang").alias("part")).agg(F.count("*").alias("vocab_size"))
    every = used.select("token").distinct().agg(F.count("*").alias("vocab_size")).select(F.lit("all").alias("part"), "vocab_size")
    off = F.abs(F.col("estimate") - F.col("vocab_size"))
    return both.join(union_all([exact, every]), "part").select("part", "n", "vocab_size", (off <= 0.05 * F.col("vocab_size")).alias("close"))


@query("top_terms", "A7", f"""WITH {TOKENS_SQL}
SELECT token, count(*) AS n FROM tokens GROUP BY 1 ORDER BY n DESC, token LIMIT 12""")
def top_terms(spark, sf):
    return stats.top_terms(feature_tokens(spark, sf), "token")


@query("feature_quality", "A8", f"""WITH f AS (SELECT {st.join_words(FEATURE_SQL)} AS feature FROM documents),
c AS (SELECT count(*) AS n_total, count(*) FILTER (trim(feature) = '') AS n_empty,
      count(DISTINCT feature) FILTER (trim(feature) <> '') AS nd FROM f)
SELECT n_total, n_empty, round(100 * n_empty / n_total, 6) AS empty_pct,
  n_total - n_empty - nd AS n_duplicate, round(100 * (n_total - n_empty - nd) / n_total, 6) AS duplicate_pct FROM c""")
def feature_quality(spark, sf):
    return stats.quality(three_texts(spark, sf), "feature", digits=6)


LEAK_SQL = """per AS (SELECT feature, count(DISTINCT fold) AS nf, count(*) AS nr FROM f
  WHERE trim(feature) <> '' GROUP BY 1 HAVING count(DISTINCT fold) > 1)
SELECT count(*) AS shared_texts, CAST(coalesce(sum(nr), 0) AS BIGINT) AS rows_affected,
  (SELECT count(*) FROM (SELECT comment_id FROM f GROUP BY 1 HAVING count(DISTINCT fold) > 1)) AS id_overlap
FROM per"""


@query("split_leakage", "A9 A10", f"""WITH {COMMENTS_SQL},
f AS (SELECT comment_id, {st.join_words(FEATURE_SQL)} AS feature,
      CASE WHEN confidence < 0.1 THEN 'test' WHEN confidence < 0.3 THEN 'val' ELSE 'train' END AS fold
      FROM comments), {LEAK_SQL}""")
def split_leakage(spark, sf):
    fold = F.when(F.col("confidence") < 0.1, "test").when(F.col("confidence") < 0.3, "val").otherwise("train")
    df = texts(spark, sf).select(
        "comment_id", tx.feature_text("text", DEMO_SLANG, DEMO_STOPWORDS).alias("feature"), fold.alias("fold"))
    return stats.leakage(df, "comment_id", "feature", "fold")


@query("source_leakage_across_languages", "A9 A10", """WITH f AS (
  SELECT source AS comment_id, text AS feature, lang AS fold FROM documents), """ + LEAK_SQL)
def source_leakage_across_languages(spark, sf):
    df = table(spark, sf, "documents").select(
        F.col("source").alias("comment_id"), F.col("text").alias("feature"), F.col("lang").alias("fold"))
    return stats.leakage(df, "comment_id", "feature", "fold")


@query("confidence_profile", "A13", f"""WITH {LABELLED_SQL}
SELECT label_id, round(avg(confidence), 6) AS mean_confidence, min(confidence) AS min_confidence,
  max(confidence) AS max_confidence, round(quantile_cont(confidence, 0.5), 6) AS median_confidence
FROM labelled GROUP BY 1""")
def confidence_profile(spark, sf):
    df = labelled(spark, sf)
    basic = df.groupBy("label_id").agg(
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))
    median = ranking.exact_median(df, "label_id", "confidence", 0.0, 1.0, "median_confidence")
    return basic.join(median, "label_id").withColumn(
        "median_confidence", F.round("median_confidence", 6))


@query("label_transitions", "A14", f"""WITH {LABELLED_SQL}
SELECT label_id, human_id, count(*) AS n FROM labelled GROUP BY 1, 2""")
def label_transitions(spark, sf):
    return stats.transitions(labelled(spark, sf), "label_id", "human_id")


@query("value_counts_with_null", "A15 U1", f"""WITH {COMMENTS_SQL}
SELECT label_id, count(*) AS n FROM comments GROUP BY 1""")
def value_counts_with_null(spark, sf):
    return stats.class_distribution(comments(spark, sf), "label_id")


@query("subset_class_counts", "A16 J3", f"""WITH {LABELLED_SQL}
SELECT subset, label_id, count(*) AS n FROM (
  SELECT 'confident' AS subset, label_id FROM labelled WHERE confidence >= 0.5
  UNION ALL SELECT 'english', label_id FROM labelled WHERE lang = 'en'
  UNION ALL SELECT 'all', label_id FROM labelled) GROUP BY 1, 2""")
def subset_class_counts(spark, sf):
    # One scan: each row names the subsets it belongs to.
    names = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("confidence") >= 0.5, "confident"), F.when(F.col("lang") == "en", "english")))
    member = labelled(spark, sf).select("label_id", F.explode(names).alias("subset"))
    return member.groupBy("subset", "label_id").agg(F.count("*").alias("n"))


@query("group_by_remainder", "A17", """SELECT l_orderkey % 7 AS k, CAST(sum(l_linenumber) AS BIGINT) AS total,
  count(*) AS n FROM lineitem GROUP BY 1""")
def group_by_remainder(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 7).alias("k")).agg(
        F.sum("l_linenumber").alias("total"), F.count("*").alias("n"))


@query("correct_wrong_counts", "A18", f"""WITH {PREDICTIONS_SQL}
SELECT CASE WHEN actual = predicted THEN 'Benar' ELSE 'Salah' END AS status, count(*) AS n
FROM predictions GROUP BY 1""")
def correct_wrong_counts(spark, sf):
    status = lb.error_status(F.col("actual") == F.col("predicted"))
    return predictions(spark, sf).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


PAIR_SQL = f"{NAME_SQL.format('actual')} || ' → ' || {NAME_SQL.format('predicted')}"


def wrong_pairs(spark, sf):
    wrong = predictions(spark, sf).filter(F.col("actual") != F.col("predicted"))
    return wrong.select(lb.error_pair(lb.label_name("actual"), lb.label_name("predicted")).alias("error_pair"))


@query("top_error_pairs", "A19", f"""WITH {PREDICTIONS_SQL}
SELECT {PAIR_SQL} AS error_pair, count(*) AS n FROM predictions WHERE actual <> predicted
GROUP BY 1 ORDER BY n DESC, error_pair LIMIT 10""")
def top_error_pairs(spark, sf):
    return stats.top_pairs(wrong_pairs(spark, sf), "error_pair", 10)


@query("dominant_error_pair", "A20", f"""WITH {PREDICTIONS_SQL}
SELECT {PAIR_SQL} AS error_pair, count(*) AS n FROM predictions WHERE actual <> predicted
GROUP BY 1 ORDER BY n DESC, error_pair LIMIT 1""")
def dominant_error_pair(spark, sf):
    counts = wrong_pairs(spark, sf).groupBy("error_pair").agg(F.count("*").alias("n"))
    return stats.dominant(counts, "error_pair", "n")


@query("label_matrix", "A21", f"""WITH {PREDICTIONS_SQL}, {LABEL_DIM_SQL}
SELECT d.label AS actual_label,
  count(*) FILTER (predicted = 0) AS "Negatif", count(*) FILTER (predicted = 1) AS "Netral",
  count(*) FILTER (predicted = 2) AS "Positif"
FROM label_dim d LEFT JOIN predictions p ON p.actual = d.label_id GROUP BY 1""")
def label_matrix(spark, sf):
    counts = predictions(spark, sf).groupBy("actual", "predicted").agg(F.count("*").alias("n")).select(
        lb.label_name("actual").alias("actual_label"), lb.label_name("predicted").alias("predicted_label"), "n")
    return stats.label_matrix(counts, label_dim(spark), "actual_label", "predicted_label", "n")


@query("grid_score_pivot", "A22", """SELECT l_linenumber AS c,
  max(l_discount) FILTER (l_returnflag = 'A') AS "A", max(l_discount) FILTER (l_returnflag = 'N') AS "N",
  max(l_discount) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def grid_score_pivot(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("c")).pivot(
        "l_returnflag", ["A", "N", "R"]).agg(F.max("l_discount"))


@query("class_balance_status", "A23", f"""WITH {LABELLED_SQL},
c AS (SELECT {NAME_SQL.format('label_id')} AS label, count(*) AS n FROM labelled GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label DESC) AS k, min(n) OVER () AS lo, max(n) OVER () AS hi FROM c)
SELECT CASE WHEN max(lo) = max(hi) THEN 'balanced' ELSE 'dominant' END AS status,
  CASE WHEN max(lo) = max(hi) THEN NULL ELSE max(label) FILTER (k = 1) END AS label,
  CASE WHEN max(lo) = max(hi) THEN 0
       ELSE max(n) FILTER (k = 1) - coalesce(max(n) FILTER (k = 2), 0) END AS gap FROM r""")
def class_balance_status(spark, sf):
    counts = labelled(spark, sf).groupBy(lb.label_name("label_id").alias("label")).agg(F.count("*").alias("n"))
    return stats.balance_status(counts, "label", "n")


@query("totals_by_dataset", "A24", """SELECT lang AS dataset, CAST(sum(n_chars) AS BIGINT) AS total
FROM documents GROUP BY 1""")
def totals_by_dataset(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(
        F.sum("n_chars").alias("total"))


@query("confidence_histogram", "A25", f"""WITH {PREDICTIONS_SQL},
b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)),
p AS (SELECT CAST(least(greatest(floor(confidence * 20), 0), 19) AS INTEGER) AS bin, actual = predicted AS ok FROM predictions)
SELECT b.bin, count(*) FILTER (ok) AS n_correct, count(*) FILTER (NOT ok) AS n_wrong
FROM b LEFT JOIN p ON b.bin = p.bin GROUP BY 1""")
def confidence_histogram(spark, sf):
    dim = spark.range(20).select(F.col("id").cast("int").alias("bin"))
    p = predictions(spark, sf).withColumn("correct", F.col("actual") == F.col("predicted"))
    return stats.confidence_histogram(p, dim, "confidence", "correct")


@query("pipeline_parity", "A26", f"""WITH t AS (SELECT {st.clean_aggressive('text')} AS a,
  trim({st.gsub('lower(text)', '[^a-z]+')}) AS b, {st.clean_minimal('text')} AS c, {st.squeeze('lower(text)')} AS d
  FROM documents)
SELECT count(*) AS n, count(*) FILTER (a = b) AS aggressive_equal,
  round(count(*) FILTER (a = b) / count(*), 6) AS aggressive_share,
  count(*) FILTER (c = d) AS minimal_equal, round(count(*) FILTER (c = d) / count(*), 6) AS minimal_share FROM t""")
def pipeline_parity(spark, sf):
    df = text_table(spark, sf, "documents").select(
        tx.clean_aggressive("text").alias("a"),
        F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).alias("b"),
        tx.clean_minimal("text").alias("c"), tx.squeeze(F.lower("text")).alias("d"))
    return stats.parity(df, {"aggressive": ("a", "b"), "minimal": ("c", "d")})


@query("comments_per_video", "I13", "SELECT source AS video_id, count(*) AS n FROM documents GROUP BY 1")
def comments_per_video(spark, sf):
    return texts(spark, sf).groupBy("video_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "video_id")


@query("video_profile", "I14", f"""WITH t AS (SELECT source AS video_id, {st.clean_aggressive('text')} AS a,
  {st.clean_minimal('text')} AS b FROM documents)
SELECT video_id, count(*) AS n, round(avg(length(a)), 6) AS avg_aggressive, round(avg(length(b)), 6) AS avg_minimal
FROM t GROUP BY 1""")
def video_profile(spark, sf):
    return texts(spark, sf).groupBy("video_id").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.length(tx.clean_aggressive("text"))), 6).alias("avg_aggressive"),
        F.round(F.avg(F.length(tx.clean_minimal("text"))), 6).alias("avg_minimal"))


@query("corpus_profile", "I15", """SELECT count(*) AS n, count(DISTINCT source) AS n_videos,
  round(avg(length(text)), 6) AS avg_chars FROM documents""")
def corpus_profile(spark, sf):
    return texts(spark, sf).agg(
        F.count("*").alias("n"), F.count_distinct("video_id").alias("n_videos"),
        F.round(F.avg(F.length("text")), 6).alias("avg_chars"))


@query("domain_terms", "P9 J6", f"""WITH {TOKENS_SQL}
SELECT token, count(*) AS n FROM tokens
WHERE lower(trim(token)) NOT IN ('ci', 'with', 'des', 'und', 'this') GROUP BY 1 ORDER BY n DESC, token LIMIT 10""")
def domain_terms(spark, sf):
    generic = spark.createDataFrame([(w,) for w in ("ci", "with", "des", "und", "this")], "term string")
    words = feature_tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n"))
    key = F.lower(F.trim(words["token"]))
    kept = words.join(F.broadcast(generic), key == generic["term"], "left_anti")
    return kept.orderBy(F.desc("n"), "token").limit(10)


@query("word_count_band", "P11", f"""WITH t AS (SELECT conv_id, turn, {st.squeeze('text')} AS sq FROM conversations)
SELECT conv_id, turn FROM t WHERE {wc_sql('sq')} BETWEEN 6 AND 18""")
def word_count_band(spark, sf):
    return table(spark, sf, "conversations").filter(tx.word_count("text").between(6, 18)).select("conv_id", "turn")


def eda_report(spark, sf):
    """All corpus figures in one row, from a feature table that is written first."""
    df = materialize(labelled(spark, sf).select(
        "comment_id", "label_id", "text", tx.feature_text("text", DEMO_SLANG, DEMO_STOPWORDS).alias("feature"),
        tx.clean_minimal("text").alias("minimal")), "features")
    folded = ranking.stratified_split(df, "comment_id", "label_id")
    words = df.select("label_id", F.explode(tx.tokens("feature")).alias("token"))

    # Each part is a one-row aggregate, so it enters the report as a scalar subquery.
    def one(frame):
        return frame.select(F.to_json(F.struct(*frame.columns)).alias("v")).scalar()

    def table_json(frame, order, shown=None):
        """The rows in the order of the columns ``order``, of which those ``shown`` come out."""
        rows = F.sort_array(F.collect_list(F.struct(*order, *(c for c in shown or () if c not in order))))
        cut = F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in shown or order)))
        return frame.agg(F.to_json(cut).alias("v")).scalar()

    texts = {"raw": "text", "feature": "feature", "minimal": "minimal"}
    vocab = stats.vocabulary_size(words, "token")
    top = stats.top_terms(words, "token").select((-F.col("n")).alias("place"), "token", "n")
    lift = stats.class_terms(words, "token", "label_id")
    return df.agg(F.count("*").alias("n_total")).select(
        "n_total",
        table_json(stats.class_distribution(df, "label_id"), ["label_id", "n"]).alias("class_distribution"),
        one(stats.length_profile(df, texts, ["raw", "feature"])).alias("length"),
        one(vocab).alias("vocabulary"),
        table_json(top, ["place", "token"], ["token", "n"]).alias("top_terms"),
        one(stats.quality(df, "feature")).alias("quality"),
        one(stats.leakage(folded, "comment_id", "feature", "fold")).alias("leakage"),
        table_json(lift, ["label_id", "rank", "token", "lift", "n_in"]).alias("class_terms"),
    )


@query("eda_report", "D10 K4")
def eda_report_query(spark, sf):
    return eda_report(spark, sf)


REPORT = """n_total bigint, class_distribution string, length string, vocabulary string, top_terms string,
  quality string, leakage string, class_terms string"""
REPORT_SQL = f"""WITH {TOKENS_SQL}, {THREE_SQL.replace('FROM documents', 'FROM labelled')},
members AS (SELECT comment_id, label_id FROM labelled), {SPLIT_SQL},
f AS (SELECT d.comment_id, coalesce(array_to_string(ws, ' '), '') AS feature, fold FROM docs d JOIN folded USING (comment_id)),
per AS (SELECT feature, count(*) AS nr FROM f WHERE feature <> '' GROUP BY 1 HAVING count(DISTINCT fold) > 1),
filled AS (SELECT count(*) AS n_total, count(*) FILTER (feature = '') AS n_empty, count(DISTINCT feature) FILTER (feature <> '') AS nd FROM f),
q AS (SELECT *, n_total - n_empty - nd AS n_duplicate FROM filled),
top AS (SELECT token, count(*) AS n FROM tokens GROUP BY 1 ORDER BY n DESC, token LIMIT 12),
ct AS (SELECT label_id, count(*) AS class_total FROM tokens GROUP BY 1),
al AS (SELECT token, count(*) AS n_all FROM tokens GROUP BY 1 HAVING count(*) >= 5),
pc AS (SELECT label_id, token, count(*) AS n_in FROM tokens GROUP BY 1, 2),
sc AS (SELECT pc.label_id, pc.token, n_in, round((n_in / class_total) / (n_all / (SELECT count(*) FROM tokens)), 6) AS lift
       FROM pc JOIN al ON pc.token = al.token JOIN ct ON pc.label_id = ct.label_id),
lifted AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY lift DESC, token) AS rank FROM sc QUALIFY rank <= 12),
figures AS (
  SELECT 'n_total' AS section, 'n_total' AS item, count(*)::DOUBLE AS value FROM labelled
  UNION ALL SELECT 'class_distribution', label_id::VARCHAR, count(*) FROM labelled GROUP BY label_id
  UNION ALL SELECT 'length', u.item, u.value FROM (SELECT unnest([
      {{'item': 'avg_raw', 'value': round(avg(raw), 2)}}, {{'item': 'avg_feature', 'value': round(avg(feature), 2)}},
      {{'item': 'avg_minimal', 'value': round(avg(minimal), 2)}}, {{'item': 'median_raw', 'value': floor(quantile_cont(raw, 0.5))}},
      {{'item': 'median_feature', 'value': floor(quantile_cont(feature, 0.5))}},
      {{'item': 'median_minimal', 'value': floor(quantile_cont(minimal, 0.5))}},
      {{'item': 'max_raw', 'value': max(raw)}}, {{'item': 'max_feature', 'value': max(feature)}}]) AS u FROM n)
  UNION ALL SELECT 'vocabulary', 'vocab_size', count(DISTINCT token) FROM tokens
  UNION ALL SELECT 'top_terms', token, n FROM top
  UNION ALL SELECT 'quality', u.item, u.value FROM (SELECT unnest([
      {{'item': 'n_total', 'value': n_total::DOUBLE}}, {{'item': 'n_empty', 'value': n_empty}},
      {{'item': 'empty_pct', 'value': round(100 * n_empty / n_total, 2)}}, {{'item': 'n_duplicate', 'value': n_duplicate}},
      {{'item': 'duplicate_pct', 'value': round(100 * n_duplicate / n_total, 2)}}]) AS u FROM q)
  UNION ALL SELECT 'leakage', 'shared_texts', count(*) FROM per
  UNION ALL SELECT 'leakage', 'rows_affected', coalesce(sum(nr), 0) FROM per
  UNION ALL SELECT 'leakage', 'id_overlap', count(*) FROM (SELECT comment_id FROM f GROUP BY 1 HAVING count(DISTINCT fold) > 1)
  UNION ALL SELECT 'class_terms', label_id || ' ' || rank || ' ' || token, lift FROM lifted
  UNION ALL SELECT 'class_term_counts', label_id || ' ' || rank || ' ' || token, n_in FROM lifted)
SELECT section, item, value FROM figures"""


@query("eda_report_figures", "D10 K4", REPORT_SQL)
def eda_report_figures(spark, sf):
    """Every figure of the report, from the JSON document that was written."""
    path = new_path(spark, "report")
    writers.write_report(eda_report(spark, sf), path)
    doc = spark.read.text(path).select(F.from_json("value", REPORT).alias("r")).select("r.*")
    number = F.col("value").cast("double").alias("value")

    def fields(name):
        pairs = F.from_json(name, "map<string,string>")
        return doc.select(F.lit(name).alias("section"), F.explode(pairs).alias("item", "value")).select("section", "item", number)

    def listed(name, kind, item, value, section=None):
        rows = doc.select(F.inline(F.from_json(name, f"array<struct<{kind}>>")))
        return rows.select(F.lit(section or name).alias("section"), item.alias("item"), F.col(value).cast("double").alias("value"))

    term = F.concat_ws(" ", "label_id", "rank", "token")
    term_kind = "label_id:int,rank:int,token:string,lift:double,n_in:bigint"
    return union_all([
        doc.select(F.lit("n_total").alias("section"), F.lit("n_total").alias("item"), F.col("n_total").cast("double").alias("value")),
        listed("class_distribution", "label_id:int,n:bigint", F.col("label_id").cast("string"), "n"),
        fields("length"), fields("vocabulary"), listed("top_terms", "token:string,n:bigint", F.col("token"), "n"),
        fields("quality"), fields("leakage"), listed("class_terms", term_kind, term, "lift"),
        listed("class_terms", term_kind, term, "n_in", "class_term_counts"),
    ])


@query("top_parts_per_brand", "G14", """SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part)
WHERE rank <= 5""")
def top_parts_per_brand(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return top_per_key(part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 5, "rank")
