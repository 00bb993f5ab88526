"""Model metrics as SQL: rows are reduced to nine counts per run, the rest is arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import LABELS
from .keyed import explode_rows, first_per_key

K = len(LABELS)


def cell(i: int, j: int) -> str:
    return f"c{i}{j}"


def confusion_cells(
    df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = (), k: int = K
) -> DataFrame:
    """One row per run with the count of each (actual, predicted) pair, zeros included."""
    counts = [
        F.count_if((F.col(actual) == i) & (F.col(predicted) == j)).alias(cell(i, j))
        for i in range(k)
        for j in range(k)
    ]
    return df.groupBy(*groups).agg(*counts) if groups else df.agg(*counts)


def confusion_long(cells: DataFrame, groups: Sequence[str] = (), k: int = K) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.col(cell(i, j)).alias("n"))
            for i in range(k)
            for j in range(k)
        ]
    )
    return cells.select(*groups, F.inline(rows))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _class_columns(k: int) -> list[dict[str, Column]]:
    out = []
    for i in range(k):
        tp = F.col(cell(i, i))
        support = _sum([F.col(cell(i, j)) for j in range(k)])
        guessed = _sum([F.col(cell(j, i)) for j in range(k)])
        out.append(
            {
                "precision": _ratio(tp, guessed),
                "recall": _ratio(tp, support),
                "f1": _ratio(2 * tp, support + guessed),
                "support": support,
            }
        )
    return out


def scores_from_cells(
    cells: DataFrame, groups: Sequence[str] = (), k: int = K, digits: int = 6
) -> DataFrame:
    """Accuracy, macro-F1 and weighted-F1 per run."""
    per = _class_columns(k)
    n = _sum([p["support"] for p in per])
    right = _sum([F.col(cell(i, i)) for i in range(k)])
    return cells.select(
        *groups,
        F.round(_ratio(right, n), digits).alias("accuracy"),
        F.round(_sum([p["f1"] for p in per]) / k, digits).alias("macro_f1"),
        F.round(_ratio(_sum([p["f1"] * p["support"] for p in per]), n), digits).alias("weighted_f1"),
        n.alias("n_test"),
    )


def per_class_from_cells(
    cells: DataFrame, groups: Sequence[str] = (), k: int = K, digits: int = 6
) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("label_id"),
                *[F.round(p[m], digits).alias(m) for m in ("precision", "recall", "f1")],
                p["support"].alias("support"),
            )
            for i, p in enumerate(_class_columns(k))
        ]
    )
    return cells.select(*groups, F.inline(rows))


def evaluate(
    df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = (), digits: int = 6
) -> DataFrame:
    return scores_from_cells(confusion_cells(df, actual, predicted, groups), groups, digits=digits)


def evaluate_per_class(
    df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = (), digits: int = 6
) -> DataFrame:
    return per_class_from_cells(confusion_cells(df, actual, predicted, groups), groups, digits=digits)


def matrix_precision_recall(df: DataFrame, matrix: str, keep: Sequence[str], digits: int = 4) -> DataFrame:
    """Precision and recall per class of a stored square matrix; NULL where undefined."""
    rows = explode_rows(df, [*keep, matrix], matrix, "_row", "label_id")
    tp = F.get("_row", F.col("label_id"))
    support = F.aggregate("_row", F.lit(0).cast("bigint"), lambda a, x: a + x)
    guessed = F.aggregate(matrix, F.lit(0).cast("bigint"), lambda a, r: a + F.get(r, F.col("label_id")))
    return rows.select(
        *keep,
        "label_id",
        F.round(F.when(guessed != 0, tp / guessed), digits).alias("precision"),
        F.round(F.when(support != 0, tp / support), digits).alias("recall"),
    )


def row_shares(cells: DataFrame, groups: Sequence[str] = (), k: int = K, digits: int = 6) -> DataFrame:
    """The matrix with each row divided by its sum; rows without cases are NULL."""
    rows = []
    for i in range(k):
        total = _sum([F.col(cell(i, j)) for j in range(k)])
        for j in range(k):
            share = F.round(F.when(total != 0, F.col(cell(i, j)) / total), digits)
            rows.append(F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), share.alias("share")))
    return cells.select(*groups, F.inline(F.array(*rows)))


def hard_vote(votes: DataFrame, key: str, prediction: str, k: int = K) -> DataFrame:
    """The class most models chose; a tie goes to the smaller class id."""
    counts = F.array(*[F.count_if(F.col(prediction) == i) for i in range(k)])
    per = votes.groupBy(key).agg(counts.alias("_votes"))
    top = F.array_max("_votes")
    return per.select(
        key, (F.array_position("_votes", top) - 1).cast("int").alias("predicted"), top.alias("n_votes")
    )


def bias_grid(
    df: DataFrame, actual: str, s0: str, s1: str, s2: str, grid: Sequence[float]
) -> DataFrame:
    """Macro-F1 for every pair of biases on the outer classes.

    For a given second bias the rival of class 0 is fixed, and class 0 wins from some first
    bias on. So a row is reduced to that turning point and the rival, one entry per second
    bias, and the counts for each first bias are sums over turning points on a tiny table.
    """
    values = F.array(*map(F.lit, grid))
    first = F.col(s0)

    def entry(bp: Column) -> Column:
        third = F.col(s2) + bp
        rival = F.when(F.col(s1) >= third, F.lit(1)).otherwise(F.lit(2))
        best = F.greatest(F.col(s1), third)
        turn = F.size(F.filter(values, lambda bn: first + bn < best))
        return F.struct(bp.alias("bias_2"), turn.alias("turn"), rival.alias("rival"))

    small = (
        df.select(F.col(actual).alias("actual"), F.inline(F.transform(values, entry)))
        .groupBy("actual", "bias_2", "turn", "rival")
        .agg(F.count("*").alias("n"))
    )
    step = F.posexplode(values).alias("_i", "bias_0")
    won = F.when(F.col("turn") <= F.col("_i"), F.lit(0)).otherwise(F.col("rival"))
    spread = small.select("*", step).withColumn("predicted", won)
    cells = spread.groupBy("bias_0", "bias_2").agg(
        *[
            F.coalesce(
                F.sum(F.when((F.col("actual") == i) & (F.col("predicted") == j), F.col("n"))), F.lit(0)
            ).alias(cell(i, j))
            for i in range(K)
            for j in range(K)
        ]
    )
    return scores_from_cells(cells, ["bias_0", "bias_2"])


def best_bias(scores: DataFrame) -> DataFrame:
    """The best pair; among equals the first one tried."""
    return scores.orderBy(F.desc("macro_f1"), "bias_0", "bias_2").limit(1)


def mean_and_spread(scores: DataFrame, metric: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation over folds."""
    aggs = [
        F.round(F.avg(metric), 6).alias("mean_score"),
        F.round(F.stddev_pop(metric), 6).alias("std_score"),
    ]
    return scores.groupBy(*groups).agg(*aggs) if groups else scores.agg(*aggs)


def compare_engines(a: DataFrame, b: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """The metric of both engines side by side and the second minus the first."""
    left = a.select(*keys, F.col(metric).alias("first"))
    right = b.select(*keys, F.col(metric).alias("second"))
    return left.join(right, list(keys)).withColumn("difference", F.round(F.col("second") - F.col("first"), 4))


def winner(pairs: DataFrame, first: str, second: str, names: tuple[str, str]) -> Column:
    """The first model only if strictly better."""
    return F.when(F.col(first) > F.col(second), names[0]).otherwise(names[1])


def best_run(runs: DataFrame, groups: Sequence[str], metric: str, name: str) -> DataFrame:
    return first_per_key(runs, groups, [F.desc(metric), F.asc(name)])
