"""Reporting tables from metric documents, predictions, features and JSON trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.lexicons import LABELS
from ..session import materialize
from .keyed import explode_rows, union_all
from .ranking import exact_rank, with_quantile_bucket

_CLASS = "struct<precision:double, recall:double, f1:double, `f1-score`:double, f1_score:double, support:bigint>"
_BLOCK = {
    "accuracy": "double",
    "macro_f1": "double",
    "weighted_f1": "double",
    "n_train": "bigint",
    "n_test": "bigint",
    "labels": "array<string>",
    "per_class": f"map<string, {_CLASS}>",
    "confusion_matrix": "array<array<bigint>>",
}
_FIELDS = ", ".join(f"{n}:{t}" for n, t in _BLOCK.items())
REPORT = f"struct<test:struct<{_FIELDS}>, {_FIELDS}>"


def report_blocks(docs: DataFrame, doc: str, keep: Sequence[str]) -> DataFrame:
    """The metric block of each JSON report: its ``test`` part, or else the report itself."""
    parsed = docs.select(*keep, F.from_json(doc, REPORT).alias("_r"))
    root = F.struct(*[F.col(f"_r.{n}").alias(n) for n in _BLOCK])
    return parsed.select(*keep, F.coalesce("_r.test", root).alias("block"))


def _f1(cell: Column) -> Column:
    return F.coalesce(cell["f1"], cell["f1-score"], cell["f1_score"])


def model_comparison(blocks: DataFrame, keep: Sequence[str], digits: int = 4) -> DataFrame:
    per = F.col("block.per_class")
    return blocks.select(
        *keep,
        F.round("block.accuracy", digits).alias("accuracy"),
        F.round("block.macro_f1", digits).alias("macro_f1"),
        *[F.round(_f1(F.element_at(per, label)), digits).alias(f"f1_{label.lower()}") for label in LABELS],
    )


def _label_list(block: str = "block") -> Column:
    return F.coalesce(F.col(f"{block}.labels"), F.array(*map(F.lit, LABELS)))


def per_class_metrics(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per report and class; precision and recall from the matrix if not given."""
    rows = blocks.select(*keep, "block", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    cell = F.element_at(F.col("block.per_class"), F.col("label"))
    # The class's place among the names of the matrix; its row, column and diagonal from there.
    matrix = F.col("block.confusion_matrix")
    at = (F.array_position(_label_list(), F.col("label")) - 1).cast("int")
    row = F.get(matrix, F.when(at >= 0, at))
    right, zero = F.get(row, at), F.lit(0).cast("bigint")
    support = F.aggregate(row, zero, lambda a, x: a + x)
    guessed = F.aggregate(matrix, zero, lambda a, r: a + F.get(r, at))
    rows = rows.withColumn("_p", F.round(F.when(guessed != 0, right / guessed), 4)).withColumn(
        "_r", F.round(F.when(support != 0, right / support), 4)
    )
    return rows.select(
        *keep,
        "label",
        F.coalesce(cell["precision"], F.col("_p")).alias("precision"),
        F.coalesce(cell["recall"], F.col("_r")).alias("recall"),
        _f1(cell).alias("f1_score"),
        cell["support"].alias("support"),
        *[F.col(f"block.{c}").alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "n_train", "n_test")],
    )


def confusion_table(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The stored matrix in long form; a class without a name shows its number."""
    rows = explode_rows(
        blocks, [*keep, _label_list().alias("_l")], F.col("block.confusion_matrix"), "_row", "_a"
    )
    cells = explode_rows(rows, [*keep, "_l", "_a"], "_row", "count", "_p")

    def name(i: str) -> Column:
        return F.coalesce(F.get("_l", F.col(i)), F.col(i).cast("string"))

    return cells.select(
        *keep, name("_a").alias("actual_label"), name("_p").alias("predicted_label"), "count",
        (name("_a") == name("_p")).alias("is_diagonal"),
    )


# Spellings of the columns of prediction and feature files.
PREDICTION_ALIASES = {
    "label_asli": "actual_label", "label": "actual_label", "prediksi": "predicted_label",
    "prediction": "predicted_label", "benar": "is_correct", "correct": "is_correct",
    "keyakinan": "confidence",
}
FEATURE_ALIASES = {
    "class": "label", "kelas": "label", "label_name": "label", "term": "feature", "word": "feature",
    "token": "feature", "ngram": "feature", "kata": "feature", "fitur": "feature", "coef": "weight",
    "koef": "weight", "score": "weight", "importance": "weight", "weight_value": "weight",
}


def rename_known(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})


def with_missing(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """NULL columns for the names a frame lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def standard_predictions(df: DataFrame, dataset: str | None = None, model: str | None = None) -> DataFrame:
    """Predictions from any known spelling of the columns to one contract, with their origin."""
    out = rename_known(df, PREDICTION_ALIASES)
    texts = ("comment_id", "text", "actual_label", "predicted_label")
    out = with_missing(out, {**{c: "string" for c in texts}, "confidence": "double"})
    if "is_correct" in out.columns:
        correct = lb.tolerant_bool("is_correct")
    else:
        correct = F.coalesce(F.col("actual_label") == F.col("predicted_label"), F.lit(False))
    return out.withColumn("is_correct", correct).select(
        F.lit(dataset).cast("string").alias("dataset"),
        F.lit(model).cast("string").alias("model"),
        *texts,
        "is_correct",
        lb.error_status("is_correct").alias("error_status"),
        lb.error_pair("actual_label", "predicted_label").alias("error_pair"),
        "confidence",
    )


def standard_features(
    df: DataFrame, position: str | None = None, dataset: str | None = None, model: str | None = None
) -> DataFrame:
    """Top features to one contract, with their origin.

    Without a rank column the rank is the place within the label along the unique numeric
    column ``position``.
    """
    out = rename_known(df, FEATURE_ALIASES)
    out = with_missing(out, {"label": "string", "feature": "string", "weight": "double"})
    if "rank" not in out.columns:
        out = exact_rank(with_quantile_bucket(out, position), ["label"], F.col("_quantile"), [F.asc(position)])
    origin = [F.lit(dataset).cast("string").alias("dataset"), F.lit(model).cast("string").alias("model")]
    return out.select(*origin, "label", "feature", "weight", "rank")


def typed(df: DataFrame, types: Mapping[str, str], zero: Sequence[str] = ()) -> DataFrame:
    """Columns as numbers, bad values NULL, or 0 for the columns in ``zero``."""
    casts = {}
    for c, t in types.items():
        value = F.col(c).cast("string").try_cast(t)
        casts[c] = F.coalesce(value, F.lit(0).cast(t)) if c in zero else value
    return df.withColumns(casts)


def split_merged_terms(df: DataFrame, merged: str, source: str) -> DataFrame:
    """A text column 'path,rank,term,count' as four typed columns."""
    part = F.split(merged, ",")
    rows = df.select(
        F.col(source).alias("source_path"),
        F.get(part, 1).try_cast("int").alias("rank"),
        F.get(part, 2).alias("term"),
        F.coalesce(F.get(part, 3).try_cast("int"), F.lit(0)).alias("count"),
    )
    return rows.filter(F.col("term").isNotNull())


# --- JSON trees ------------------------------------------------------------------------

_TYPES = {"BIGINT": "int", "STRING": "str", "BOOLEAN": "bool", "VOID": "NoneType"}


def json_leaves(df: DataFrame, json: str, keep: Sequence[str]) -> DataFrame:
    """Every scalar of a JSON tree, however deep, with its steps from the root.

    Each round opens the objects and arrays found by the one before, until there are none; a
    round's values are written, so that no round repeats the work of another. Empty objects
    and arrays come out with type 'empty'.
    """
    tvf = df.sparkSession.tvf
    no_steps = F.expr("array()").cast("array<struct<key:string,pos:int>>")
    level = df.select(*keep, F.parse_json(json).alias("_v"), no_steps.alias("steps"))
    done = []
    while True:
        kind = F.schema_of_variant("_v")
        inside = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        empty = inside & F.to_json("_v").isin("{}", "[]")
        name = F.lit("float")
        for variant, python in _TYPES.items():
            name = F.when(kind == variant, python).otherwise(name)
        found = level.select(
            *keep, "steps", (inside & ~empty).alias("_open"), F.when(inside & ~empty, F.col("_v")).alias("_v"),
            F.when(~inside, F.col("_v").cast("string")).alias("value"), F.when(empty, "empty").otherwise(name).alias("value_type"),
        )
        found = materialize(found, "json-level")
        done.append(found.filter(~F.col("_open")).select(*keep, "steps", "value", "value_type"))
        deeper = found.filter("_open")
        if deeper.isEmpty():
            break
        inner = tvf.variant_explode(F.col("_v").outer()).toDF("_p", "_k", "_i")
        step = F.struct(F.col("_k").alias("key"), F.col("_p").alias("pos"))
        level = deeper.lateralJoin(inner).select(*keep, F.col("_i").alias("_v"), F.concat("steps", F.array(step)).alias("steps"))
    return union_all(done).select(*keep, "steps", _path("steps").alias("metric_path"), "value", "value_type")


def _path(steps: str | Column) -> Column:
    """Steps as 'a.b[0]'."""
    text = F.transform(
        steps, lambda s: F.when(s["key"].isNull(), F.concat(F.lit("["), s["pos"], F.lit("]")))
        .otherwise(F.concat(F.lit("."), s["key"]))
    )
    return F.regexp_replace(F.array_join(text, ""), r"^\.", "")


def flatten_scalars(df: DataFrame, json: str, keep: Sequence[str]) -> DataFrame:
    leaves = json_leaves(df, json, keep)
    return leaves.filter("value_type <> 'empty'").select(*keep, "metric_path", "value", "value_type")


def label_distributions(leaves: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Counts from every object that has all labels as keys."""
    labels = list(LABELS)
    at = F.transform("steps", lambda s, i: F.struct(s["key"].alias("label"), i.alias("at")))
    wanted = F.filter(at, lambda x: x["label"].isin(labels))
    hits = explode_rows(leaves, [*keep, "steps", "value", "value_type"], wanted, "_h").select(
        *keep,
        _path(F.slice("steps", F.lit(1), F.col("_h.at"))).alias("source_path"),
        F.col("_h.label").alias("label"),
        F.when(
            (F.col("_h.at") == F.size("steps") - 1) & F.col("value_type").isin("int", "float"),
            F.col("value").try_cast("double").cast("bigint"),
        ).alias("count"),
    )
    per = hits.groupBy(*keep, "source_path").agg(
        *[F.count_if(F.col("label") == x).alias(f"_n{i}") for i, x in enumerate(labels)],
        *[F.max(F.when(F.col("label") == x, F.col("count"))).alias(f"_c{i}") for i, x in enumerate(labels)],
    )
    for i in range(len(labels)):
        per = per.filter(F.col(f"_n{i}") > 0)
    rows = F.array(
        *[F.struct(F.lit(x).alias("label"), F.col(f"_c{i}").alias("count")) for i, x in enumerate(labels)]
    )
    return per.select(*keep, "source_path", F.inline(rows)).filter(F.col("count").isNotNull())


def term_lists(leaves: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Items of lists under a key that speaks of terms: objects, pairs or 'path,rank,term,count'."""
    n = F.size("steps")
    pairs = F.transform(
        "steps",
        lambda s, i: F.struct(
            i.alias("at"), s["key"].alias("key"), F.get("steps", i + 1).alias("next")
        ),
    )
    wanted = F.filter(
        pairs,
        lambda p: F.lower(p["key"]).rlike("term|word|token|vocab")
        & p["next"].isNotNull() & p["next"]["key"].isNull(),
    )
    hit = explode_rows(leaves.filter("value_type <> 'empty'"), [*keep, "steps", "value"], wanted, "_h")
    left = n - F.col("_h.at") - 2  # steps below the list item
    below = F.get("steps", F.col("_h.at") + 2)
    rows = hit.select(
        *keep,
        _path(F.slice("steps", F.lit(1), F.col("_h.at") + 1)).alias("source"),
        F.col("_h.key").alias("_key"),
        F.col("_h.next.pos").alias("_item"),
        F.when(left == 0, F.col("value")).alias("_text"),
        F.when((left == 1), below["key"]).alias("_field"),
        F.when((left == 1) & below["key"].isNull(), below["pos"]).alias("_place"),
        "value",
    )

    def field(*names: str) -> Column:
        found = [F.max(F.when(F.col("_field") == x, F.nullif("value", F.lit("")))) for x in names]
        return F.coalesce(*found)

    def place(i: int) -> Column:
        return F.max(F.when(F.col("_place") == i, F.col("value")))

    part = F.transform(F.split(F.max("_text"), ","), lambda p: F.trim(p))
    items = rows.groupBy(*keep, "source", "_key", "_item").agg(
        F.when(F.size(part) >= 4, part).alias("_part"),
        field("term", "word", "token").alias("_term"),
        field("count", "freq", "frequency").alias("_count"),
        field("path").alias("_path"),
        place(0).alias("_p0"),
        place(1).alias("_p1"),
    )
    pair = F.col("_p0").isNotNull() & F.col("_p1").isNotNull()
    return items.select(
        *keep,
        "source",
        F.coalesce(F.get("_part", 0), "_path", "_key").alias("path"),
        F.coalesce(F.get("_part", 1).try_cast("int"), F.col("_item") + 1).alias("rank"),
        F.coalesce(F.get("_part", 2), "_term", F.when(pair, F.col("_p0"))).alias("term"),
        F.coalesce(F.get("_part", 3), "_count", F.when(pair, F.col("_p1"))).try_cast("bigint").alias("count"),
    ).filter(F.col("term").isNotNull())
