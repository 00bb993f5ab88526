"""Writers and versioned tables. Files are written in parallel unless one is asked for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, bom: bool = False) -> None:
    """CSV with header. ``single_file`` is for small results only: one task writes it all.

    ``bom`` puts a byte order mark before the first name of each file, for spreadsheets.
    """
    out = df.coalesce(1) if single_file else df
    if bom:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row result as a JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_mart(spark: SparkSession, tables: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Write each table as CSV and return the manifest; the rows are counted as they are written."""
    rows = []
    for name, df in tables.items():
        seen = Observation(name)
        write_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/{name}")
        rows.append((name, seen.get["rows"], len(df.columns), ", ".join(df.columns)))
    schema = "file_name string, rows bigint, columns int, column_names string"
    return spark.createDataFrame(rows, schema)


def _entries(spark: SparkSession, root: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _versions(spark: SparkSession, root: str) -> list[str]:
    """The complete versions of a table, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    return [v for v in _entries(spark, root) if fs.exists(path(v, "_SUCCESS"))]


def publish(df: DataFrame, root: str) -> str:
    """Write ``df`` as the next version of a table; readers see it once it is complete.

    So a table can be rewritten from itself, and a lost job leaves the old version in place. A
    claim file, made only if there is none, gives each version to one writer: a second writer of
    the same version fails.
    """
    spark = df.sparkSession
    known = [int(v.rsplit("=", 1)[1]) for v in (*_versions(spark, root), *_entries(spark, f"{root}/_claims"))]
    number = max(known, default=0) + 1
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_claims/version={number:08d}")
    claim.getFileSystem(spark._jsc.hadoopConfiguration()).create(claim, False).close()
    path = f"{root}/version={number:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    known = _versions(spark, root)
    if not known:
        raise ValueError(f"no complete version below {root}")
    return spark.read.parquet(known[-1])
