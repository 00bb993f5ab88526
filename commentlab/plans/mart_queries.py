"""Reporting tables, files in and out, and JSON trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import mart, metrics
from ..operators.curation import apply_updates
from ..operators.keyed import union_all
from ..session import new_path
from ..sources import readers, writers
from .metrics_queries import RUN, RUN_CELLS, RUN_SCORES, f1_sql, run_cells
from .registry import query
from .tables import LABELLED_SQL, NAME_SQL, PREDICTIONS_SQL, labelled, predictions, table, texts

LABEL_NAMES = ("Negatif", "Netral", "Positif")


def report_documents(spark, sf):
    """One JSON report per run. English ones put the metrics at the root and call F1 'f1-score'."""
    cells = run_cells(spark, sf)
    per = [metrics._class_columns(3)[i] for i in range(3)]
    scores = metrics.scores_from_cells(cells, [*RUN, *[c for c in cells.columns if c not in RUN]])

    def class_map(f1_name):
        entries = [x for i in range(3) for x in (
            F.lit(LABEL_NAMES[i]), F.struct(F.round(per[i]["f1"], 4).alias(f1_name), per[i]["support"].alias("support")))]
        return F.create_map(*entries)

    matrix = F.array(*[F.array(*[F.col(f"c{i}{j}") for j in range(3)]) for i in range(3)])
    shared = [F.col(c) for c in ("accuracy", "macro_f1", "weighted_f1", "n_test")] + [matrix.alias("confusion_matrix")]
    nested = F.to_json(F.struct(F.col("model"), F.struct(*shared, class_map("f1").alias("per_class")).alias("test")))
    root = F.to_json(F.struct(F.col("model"), *shared, class_map("f1-score").alias("per_class")))
    return scores.select(*RUN, F.when(F.col("dataset") == "en", root).otherwise(nested).alias("doc"))


@query("report_blocks", "S10", f"WITH {RUN_SCORES} SELECT dataset, model, accuracy, macro_f1, weighted_f1, n_test FROM runs")
def report_blocks(spark, sf):
    blocks = mart.report_blocks(report_documents(spark, sf), "doc", RUN)
    return blocks.select(*RUN, "block.accuracy", "block.macro_f1", "block.weighted_f1", "block.n_test")


@query("model_comparison", "D1 M27", f"""WITH {RUN_CELLS}, runs AS (SELECT dataset, model, c00, c01, c02, c10, c11, c12, c20, c21, c22,
  round((c00 + c11 + c22) / (c00 + c01 + c02 + c10 + c11 + c12 + c20 + c21 + c22), 6) AS acc,
  round(({f1_sql(0)} + {f1_sql(1)} + {f1_sql(2)}) / 3, 6) AS mf FROM cells)
SELECT dataset, model, round(acc, 4) AS accuracy, round(mf, 4) AS macro_f1, round({f1_sql(0)}, 4) AS f1_negatif,
  round({f1_sql(1)}, 4) AS f1_netral, round({f1_sql(2)}, 4) AS f1_positif FROM runs""")
def model_comparison(spark, sf):
    return mart.model_comparison(mart.report_blocks(report_documents(spark, sf), "doc", RUN), RUN)


def class_rows(i: int) -> str:
    return f"""SELECT c.dataset, c.model, '{LABEL_NAMES[i]}' AS label, round(c{i}{i} / nullif(c0{i} + c1{i} + c2{i}, 0), 4) AS precision,
  round(c{i}{i} / nullif(c{i}0 + c{i}1 + c{i}2, 0), 4) AS recall, round({f1_sql(i)}, 4) AS f1_score,
  c{i}0 + c{i}1 + c{i}2 AS support, accuracy, macro_f1, weighted_f1, CAST(NULL AS BIGINT) AS n_train, n_test
FROM cells c JOIN runs r ON c.dataset = r.dataset AND c.model = r.model"""


@query("per_class_metrics", "D2 M22", f"WITH {RUN_SCORES} " + " UNION ALL ".join(map(class_rows, range(3))))
def per_class_metrics(spark, sf):
    return mart.per_class_metrics(mart.report_blocks(report_documents(spark, sf), "doc", RUN), RUN)


@query("confusion_table", "D3", f"WITH {RUN_CELLS} " + " UNION ALL ".join(
    f"""SELECT dataset, model, '{LABEL_NAMES[i]}' AS actual_label, '{LABEL_NAMES[j]}' AS predicted_label, c{i}{j} AS "count",
  {str(i == j).upper()} AS is_diagonal FROM cells""" for i in range(3) for j in range(3)))
def confusion_table(spark, sf):
    return mart.confusion_table(mart.report_blocks(report_documents(spark, sf), "doc", RUN), RUN)


def raw_predictions(spark, sf):
    """Two files of predictions with different column names; the second lacks two columns."""
    p = predictions(spark, sf).withColumns({"a": lb.label_name("actual"), "b": lb.label_name("predicted")})
    i = F.col("comment_id").cast("string").alias("comment_id")
    word = F.when(F.col("a") == F.col("b"), "benar").otherwise("salah")
    first = p.filter("lang = 'en'").select(
        i, F.md5("text").alias("text"), F.col("a").alias("label_asli"), F.col("b").alias("prediksi"),
        word.alias("benar"), F.col("confidence").alias("keyakinan"))
    second = p.filter("lang <> 'en'").select(i, F.md5("text").alias("text"), F.col("a").alias("label"), F.col("b").alias("prediction"))
    return {"first": first, "second": second}


@query("standard_predictions", "D4 P10 T26 T28 U1", f"""WITH {PREDICTIONS_SQL},
p AS (SELECT *, {NAME_SQL.format('actual')} AS a, {NAME_SQL.format('predicted')} AS b FROM predictions)
SELECT 'pages' AS dataset, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS model, CAST(comment_id AS VARCHAR) AS comment_id, md5(text) AS text,
  a AS actual_label, b AS predicted_label, a = b AS is_correct, CASE WHEN a = b THEN 'Benar' ELSE 'Salah' END AS error_status,
  a || ' → ' || b AS error_pair, CASE WHEN lang = 'en' THEN confidence END AS confidence FROM p""")
def standard_predictions(spark, sf):
    return union_all([
        mart.standard_predictions(df, "pages", name) for name, df in raw_predictions(spark, sf).items()])


@query("standard_features", "D5 P10 G13", """SELECT 'parts' AS dataset, 'price' AS model, p_brand AS label, p_name AS feature, p_retailprice AS weight,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part""")
def standard_features(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_brand").alias("kelas"), F.col("p_name").alias("kata"), F.col("p_retailprice").alias("koef"), "p_partkey")
    return mart.standard_features(raw, "p_partkey", "parts", "price")


@query("typed_columns", "P12", """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS weight,
  coalesce(TRY_CAST(CASE WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS VARCHAR) END AS INTEGER), 0) AS "count" FROM events""")
def typed_columns(spark, sf):
    kind = F.col("event_type")
    raw = table(spark, sf, "events").select(
        "event_id", F.when(kind == "error", "n/a").otherwise(F.col("value").cast("string")).alias("weight"),
        F.when(kind == "view", "").otherwise(F.col("user_id").cast("string")).alias("count"))
    return mart.typed(raw, {"weight": "double", "count": "int"}, zero=["count"])


@query("merged_term_column", "P13", """SELECT 'vocab' AS source_path, CAST(l_linenumber AS INTEGER) AS rank, l_returnflag AS term,
  CAST(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_orderkey END AS INTEGER) AS "count" FROM lineitem""")
def merged_term_column(spark, sf):
    number = F.when(F.col("l_linestatus") == "F", "?").otherwise(F.col("l_orderkey").cast("string"))
    raw = table(spark, sf, "lineitem").select(
        F.lit("vocab").alias("source"), F.concat_ws(",", F.lit("terms"), "l_linenumber", "l_returnflag", number).alias("merged"))
    return mart.split_merged_terms(raw, "merged", "source")


def json_trees(spark, sf):
    """A nested report per document."""
    counts = F.struct(*[F.lit(i + 1).alias(n) for i, n in enumerate(LABEL_NAMES[:2])], F.col("n_chars").alias("Positif"))
    part = F.concat_ws(",", F.lit("terms"), F.lit("7"), "lang", "n_chars")
    body = F.concat(
        F.lit('{"n_total":'), F.col("n_chars"), F.lit(',"dist":'), F.to_json(counts),
        F.lit(',"partial":{"Negatif":1},"vocab":{"top_terms":[["'), F.col("source"), F.lit('",'), F.col("n_chars"),
        F.lit(']],"words":[{"word":"w","freq":3},"'), part, F.lit('"],"plain":["x"]},"avg":0.5,"ok":true,"none":null,"empty":{}}'))
    return table(spark, sf, "documents").select("doc_id", body.alias("tree"))


@query("flatten_json", "D6 D9", """WITH d AS (SELECT * FROM documents), leaf AS (
  SELECT doc_id, 'n_total' AS metric_path, CAST(n_chars AS VARCHAR) AS value, 'int' AS value_type FROM d
  UNION ALL SELECT doc_id, 'dist.Negatif', '1', 'int' FROM d UNION ALL SELECT doc_id, 'dist.Netral', '2', 'int' FROM d
  UNION ALL SELECT doc_id, 'dist.Positif', CAST(n_chars AS VARCHAR), 'int' FROM d
  UNION ALL SELECT doc_id, 'partial.Negatif', '1', 'int' FROM d
  UNION ALL SELECT doc_id, 'vocab.top_terms[0][0]', source, 'str' FROM d
  UNION ALL SELECT doc_id, 'vocab.top_terms[0][1]', CAST(n_chars AS VARCHAR), 'int' FROM d
  UNION ALL SELECT doc_id, 'vocab.words[0].word', 'w', 'str' FROM d UNION ALL SELECT doc_id, 'vocab.words[0].freq', '3', 'int' FROM d
  UNION ALL SELECT doc_id, 'vocab.words[1]', 'terms,7,' || lang || ',' || n_chars, 'str' FROM d
  UNION ALL SELECT doc_id, 'vocab.plain[0]', 'x', 'str' FROM d
  UNION ALL SELECT doc_id, 'avg', '0.5', 'float' FROM d UNION ALL SELECT doc_id, 'ok', 'true', 'bool' FROM d
  UNION ALL SELECT doc_id, 'none', NULL, 'NoneType' FROM d)
SELECT * FROM leaf""")
def flatten_json(spark, sf):
    return mart.flatten_scalars(json_trees(spark, sf), "tree", ["doc_id"])


@query("flatten_event_properties", "D6", "SELECT event_id, 'k' AS metric_path, props->>'k' AS value, 'int' AS value_type FROM events")
def flatten_event_properties(spark, sf):
    return mart.flatten_scalars(table(spark, sf, "events"), "props", ["event_id"])


@query("label_distributions", "D7 D9", """SELECT doc_id, 'dist' AS source_path, 'Negatif' AS label, CAST(1 AS BIGINT) AS "count" FROM documents
UNION ALL SELECT doc_id, 'dist', 'Netral', 2 FROM documents UNION ALL SELECT doc_id, 'dist', 'Positif', n_chars FROM documents""")
def label_distributions(spark, sf):
    leaves = mart.json_leaves(json_trees(spark, sf), "tree", ["doc_id"])
    return mart.label_distributions(leaves, ["doc_id"])


@query("term_lists", "D8 D9", """SELECT doc_id, 'vocab.top_terms' AS source, 'top_terms' AS path, CAST(1 AS INTEGER) AS rank, source AS term, n_chars AS "count" FROM documents
UNION ALL SELECT doc_id, 'vocab.words', 'words', 1, 'w', 3 FROM documents
UNION ALL SELECT doc_id, 'vocab.words', 'terms', 7, lang, n_chars FROM documents""")
def term_lists(spark, sf):
    leaves = mart.json_leaves(json_trees(spark, sf), "tree", ["doc_id"])
    return mart.term_lists(leaves, ["doc_id"])


@query("mart_manifest", "K14 K3", f"""WITH {RUN_CELLS}
SELECT 'confusion_matrix' AS file_name, 9 * count(*) AS rows, CAST(6 AS INTEGER) AS columns,
  'dataset, model, actual_label, predicted_label, count, is_diagonal' AS column_names FROM cells
UNION ALL SELECT 'model_comparison', count(*), 7, 'dataset, model, accuracy, macro_f1, f1_negatif, f1_netral, f1_positif' FROM cells""")
def mart_manifest(spark, sf):
    tables = {"confusion_matrix": confusion_table(spark, sf), "model_comparison": model_comparison(spark, sf)}
    return writers.write_mart(spark, tables, new_path(spark, "mart"))


# --- files -----------------------------------------------------------------------------

MASTER_SQL = f"""WITH {LABELLED_SQL}
SELECT CAST(comment_id AS VARCHAR) AS comment_id, {NAME_SQL.format('label_id')} AS label,
  CASE WHEN lang = 'en' THEN 'llm' END AS annotator, CASE WHEN lang = 'fr' THEN NULL ELSE confidence END AS confidence,
  CASE WHEN lang = 'de' THEN 'line one' || chr(10) || 'said "two"' END AS notes FROM labelled WHERE lang <> 'es'"""


@query("label_csv_round_trip", "S2 S3 K2", MASTER_SQL)
def label_csv_round_trip(spark, sf):
    """Written with bad values, then read with validation: Spanish rows have an unknown label."""
    lang = F.col("lang")
    master = labelled(spark, sf).select(
        F.col("comment_id").cast("string").alias("comment_id"),
        F.when(lang == "es", "Entah").otherwise(F.concat(F.lit("\t"), lb.label_name("label_id"), F.lit("\u00a0\n"))).alias("label"),
        F.when(lang == "en", "\tllm ").otherwise("  ").alias("annotator"),
        F.when(lang == "fr", "high").otherwise(F.col("confidence").cast("string")).alias("confidence"),
        F.when(lang == "de", 'line one\nsaid "two"').alias("notes"))
    path = new_path(spark, "labels-csv")
    writers.write_csv(master, path)
    return readers.read_label_csv(spark, path)


@query("parquet_round_trip", "K1 G6 S1", "SELECT doc_id AS comment_id, source AS video_id, lang FROM documents")
def parquet_round_trip(spark, sf):
    path = new_path(spark, "features")
    writers.write_parquet(texts(spark, sf).select("comment_id", "video_id", "text", "lang"), path, "lang")
    return readers.read_columns(spark, path, ["comment_id", "video_id", "lang"])


@query("required_fields", "S11", "SELECT doc_id, lang, source FROM documents")
def required_fields(spark, sf):
    wanted = ["doc_id", "lang", "source"]
    return readers.require_columns(table(spark, sf, "documents"), wanted).select(*wanted)


@query("relabel_batches", "S5 T25", """SELECT user_id AS idx, CASE arg_max(event_type, event_id) WHEN 'view' THEN 'Negatif' WHEN 'click' THEN 'Netral' ELSE 'Positif' END AS label,
  coalesce(arg_max(CASE WHEN event_type = 'click' THEN -1.0 ELSE value END, event_id), 0.9) AS confidence FROM events GROUP BY 1""")
def relabel_batches(spark, sf):
    """JSON lines in file order, where a later line for an index replaces an earlier one."""
    kind = F.col("event_type")
    word = F.when(kind == "view", "negatif").when(kind == "click", "\tNETRAL\u00a0").otherwise("positif")
    lines = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("idx"), word.alias("label"),
        F.when(kind == "click", F.lit(-1.0)).otherwise(F.col("value")).alias("confidence"))
    path = new_path(spark, "batches")
    lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id").write.json(path)
    return readers.read_batches(spark, f"{path}/*.json")


@query("published_table", "K5 K7", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def published_table(spark, sf):
    """A table rewritten from itself: the second version reads the first."""
    root = new_path(spark, "customer")
    writers.publish(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), root)
    zero = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    writers.publish(apply_updates(writers.read_current(spark, root), zero, "c_custkey", ["c_acctbal"]), root)
    return writers.read_current(spark, root)
