"""Readers with fixed schemas and row validation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import labels as lb
from ..functions.lexicons import LABELS
from ..functions.text import is_blank, strip
from ..operators.curation import ANNOTATION_TASK
from ..operators.ingest import PAGE
from ..operators.keyed import first_per_key

BOM = "\ufeff"


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)


def read_csv(
    spark: SparkSession, path: str, types: Mapping[str, str], multi_line: bool = True
) -> DataFrame:
    """Named columns of a CSV with header, cast to the given types; bad values become NULL.

    Everything is read as text first, so ids keep leading zeros and no pass infers types. A
    byte order mark before the first name is dropped. ``multi_line`` allows line breaks
    inside quotes; turn it off for large files without them, so that they can be split.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', quote='"')
    raw = raw.toDF(*[c.lstrip(BOM).strip() for c in raw.columns])
    require_columns(raw, types)
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail before any job runs if a column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def valid_labels(df: DataFrame) -> DataFrame:
    """Rows with an id and a known label; blank notes and bad confidences become NULL."""
    def blank_to_null(c: str):
        return F.nullif(strip(c), F.lit("")).alias(c)

    return df.filter(~is_blank("comment_id") & strip("label").isin(list(LABELS))).select(
        strip("comment_id").alias("comment_id"),
        strip("label").alias("label"),
        blank_to_null("annotator"),
        F.col("confidence").cast("string").try_cast("double").alias("confidence"),
        blank_to_null("notes"),
    )


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    names = ("comment_id", "label", "annotator", "confidence", "notes")
    return valid_labels(read_csv(spark, path, {c: "string" for c in names}))


def read_annotation_export(spark: SparkSession, path: str) -> DataFrame:
    """Annotation tasks: JSON arrays, one or more files, with a fixed nested schema."""
    return spark.read.schema(ANNOTATION_TASK).json(path, multiLine=True)


def read_answer_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"video_id string, source_url string, source_title string, {PAGE}").json(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Re-label results from JSON lines; of a repeated ``idx`` the last one counts.

    Order is file name, then place in the file: the start of the split, then the row within
    it. Labels are put in canonical form. An unknown label, a broken line or one without ``idx``
    fails the job; blank lines are skipped.
    """
    texts = spark.read.text(path).filter(~is_blank("value"))
    lines = texts.select(
        "value",
        F.from_json("value", "idx bigint, label string, confidence double").alias("o"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    broken = F.raise_error(F.concat(F.lit("no idx in line: "), F.left("value", F.lit(200))))
    idx = F.when(F.col("o.idx").isNotNull(), F.col("o.idx")).otherwise(broken.cast("bigint"))
    rows = lines.select(idx.alias("idx"), "o.label", "o.confidence", "_file", "_block", "_line")
    last = first_per_key(rows, ["idx"], [F.desc("_file"), F.desc("_block"), F.desc("_line")])
    return last.select(
        "idx",
        lb.strict_label("label").alias("label"),
        F.coalesce("confidence", F.lit(0.9)).alias("confidence"),
    )


def from_records(
    spark: SparkSession, records: Sequence[Mapping], schema: StructType | str, columns: Sequence[str]
) -> DataFrame:
    """A small list of records as a DataFrame with those of ``columns`` that exist."""
    if not records:
        raise ValueError("no records")
    df = spark.createDataFrame(records, schema)
    return df.select(*[c for c in columns if c in df.columns])
