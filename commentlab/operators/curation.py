"""Label curation: annotation parsing, corrections, triage, agreement and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions.lexicons import LABELS
from .keyed import first_per_key, one_per_key, top_per_key

ANNOTATION_TASK = (
    "data struct<comment_id:string, video_id:string, text:string>, "
    "annotations array<struct<was_cancelled:boolean, result:array<struct<from_name:string, "
    "value:struct<choices:array<string>>>>>>"
)


def _choices(result: Column) -> Column:
    return result["value"]["choices"]


def _has_choice(result: Column) -> Column:
    return F.coalesce(F.size(_choices(result)) > 0, F.lit(False))


def first_valid_choice(annotations: str, control: str) -> Column:
    """Label of the first annotation, not cancelled, whose deciding choice is a known label.

    Inside one annotation the first result of the wanted control with any choice decides.
    """

    def decide(annotation: Column) -> Column:
        mine = F.filter(
            annotation["result"],
            lambda r: (F.coalesce(r["from_name"], F.lit("")).isin(control, "")) & _has_choice(r),
        )
        return lb.canonical_label(F.get(_choices(F.get(mine, 0)), 0))

    live = F.filter(annotations, lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    return F.get(F.filter(F.transform(live, decide), lambda c: c.isNotNull()), 0)


def last_choice(annotations: str) -> Column:
    """Raw choice of the last annotation: its last result that has one."""
    last = F.try_element_at(annotations, F.lit(-1))
    filled = F.filter(last["result"], _has_choice)
    return F.get(_choices(F.try_element_at(filled, F.lit(-1))), 0)


def parse_annotations(
    tasks: DataFrame, control: str, order: Sequence[Column], keep_unlabelled: bool = False
) -> DataFrame:
    """Annotated tasks as labelled rows: blank texts dropped, first task per id kept."""
    flat = tasks.select(
        "data.*", first_valid_choice("annotations", control).alias("label"), *order
    ).withColumn("label_id", lb.label_id("label"))
    if not keep_unlabelled:
        flat = flat.filter(F.col("label").isNotNull())
    flat = flat.filter(tx.squeeze("text") != "")
    kept = first_per_key(flat, ["comment_id"], order)
    return kept.select("comment_id", "video_id", "text", "label", "label_id")


def apply_updates(
    df: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], flag: str | None = None,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Rows whose key has an update take the given columns from it; ``flag`` marks them.

    Of several updates of one key the first in ``order`` counts; without an order a repeated
    key fails the job. A presence mark, not a NULL test, decides.
    """
    updates = one_per_key(updates, key, order)
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    out = df.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)))
    if flag:
        out = out.withColumn(flag, hit)
    return out.drop("_hit", *[f"_new_{c}" for c in columns])


def triage(df: DataFrame, verdicts: DataFrame, key: str, label: str, unreadable: str) -> DataFrame:
    """Verdict per row: exclude, confirm, correct or none (a word that is no label)."""
    choice = F.col("choice")
    verdict = (
        F.when(choice == unreadable, "exclude")
        .when(choice.isin(*LABELS) & (choice == F.col(label)), "confirm")
        .when(choice.isin(*LABELS), "correct")
        .otherwise("none")
    )
    return df.join(verdicts.select(key, "choice"), key, "left").withColumn("verdict", verdict)


def apply_triage(triaged: DataFrame, label: str) -> DataFrame:
    """Without the excluded rows, corrected labels in place, checked rows marked gold."""
    corrected = F.when(F.col("verdict") == "correct", F.col("choice")).otherwise(F.col(label))
    return (
        triaged.filter(F.col("verdict") != "exclude")
        .withColumn(label, corrected)
        .withColumn("is_gold", F.col("verdict").isin("confirm", "correct"))
        .drop("choice", "verdict")
    )


def dedup_by_text(df: DataFrame, text: str, key: str, best: Sequence[Column]) -> DataFrame:
    """One row per text, the best by the given order; texts compare without case or spacing."""
    keyed = df.withColumn("_norm", F.sha2(tx.dedup_key(text), 256))
    return first_per_key(keyed, ["_norm"], [*best, F.asc(key)]).drop("_norm")


def balanced_subset(
    df: DataFrame, label: str, key: str, confidence: str, per_class: int, first: str | None = None
) -> DataFrame:
    """The most confident rows of each class, rows with the ``first`` flag before others."""
    lead = [F.desc(first)] if first else []
    return top_per_key(df, [label], [*lead, F.desc(confidence), F.asc(key)], per_class)


def rebuild_balanced(
    df: DataFrame,
    corrections: DataFrame,
    key: str,
    label: str,
    confidence: str,
    text: str,
    per_class: int,
) -> DataFrame:
    """Readable rows, corrections applied, one row per text, best of each class."""
    pool = df.filter(tx.is_readable(text))
    fixed = apply_updates(pool, corrections, key, [label, confidence], "verified")
    best = [F.desc("verified"), F.desc(confidence)]
    single = dedup_by_text(fixed, text, key, best)
    return balanced_subset(single, label, key, confidence, per_class, "verified")


def mark_provenance(df: DataFrame, manual: DataFrame, key: str, label: str) -> DataFrame:
    """'llm' for labelled rows without a source; 'manual' plus the human label where known."""
    return apply_updates(
        df.withColumn("label_source", F.when(F.col(label).isNotNull(), F.coalesce("label_source", F.lit("llm")))
                      .otherwise(F.col("label_source")))
        .withColumn("manual_label", F.lit(None).cast("string")),
        manual.withColumn("label_source", F.lit("manual")),
        key,
        ["label_source", "manual_label"],
    )


def match_tasks(labels: DataFrame, tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """State of each label: to push, already done, or without a task."""
    # The done marks join the tasks, not the labels: labels without a task have no key to join by.
    finished = done.select("task_id", F.lit(True).alias("_done")).distinct()
    known = tasks.select(key, "task_id").join(finished, "task_id", "left")
    state = (
        F.when(F.col("task_id").isNull(), "missing").when(F.col("_done"), "skipped").otherwise("push")
    )
    return labels.join(known, key, "left").withColumn("state", state).drop("_done")


def agreement_counts(df: DataFrame, a: str, b: str, k: int = len(LABELS)) -> DataFrame:
    """One row with the count of every pair of classes."""
    return df.agg(
        *[
            F.count_if((F.col(a) == i) & (F.col(b) == j)).alias(f"c{i}{j}")
            for i in range(k)
            for j in range(k)
        ]
    )


def cohen_kappa(df: DataFrame, a: str, b: str, k: int = len(LABELS)) -> DataFrame:
    """Raw agreement, Cohen's kappa and its band; kappa is NULL when chance agrees fully."""
    cells = [[F.col(f"c{i}{j}") for j in range(k)] for i in range(k)]
    total = sum((c for row in cells for c in row), F.lit(0))
    n = F.nullif(total, F.lit(0).cast("bigint"))  # no rows: no agreement, rather than an error
    po = sum((cells[i][i] for i in range(k)), F.lit(0)) / n
    rows = [sum(cells[i], F.lit(0)) for i in range(k)]
    cols = [sum((cells[i][j] for i in range(k)), F.lit(0)) for j in range(k)]
    pe = sum((rows[i] / n * cols[i] / n for i in range(k)), F.lit(0.0))
    out = agreement_counts(df, a, b, k).select(total.alias("n"), po.alias("_po"), pe.alias("_pe"))
    kappa = F.when(F.col("_pe") < 1, (F.col("_po") - F.col("_pe")) / (1 - F.col("_pe")))
    return out.select(
        "n", F.round("_po", 6).alias("agreement"), F.round(kappa, 6).alias("kappa")
    ).withColumn("band", lb.agreement_band("kappa"))


def class_agreement(df: DataFrame, human: str, other: str, dim: DataFrame, target: int) -> DataFrame:
    """Per human class: rows, share agreed on (NULL if none), and share of the target done."""
    per = df.groupBy(F.col(human).alias("label_id")).agg(
        F.count("*").alias("n_human"), F.count_if(F.col(human) == F.col(other)).alias("_same")
    )
    n = F.coalesce("n_human", F.lit(0).cast("bigint"))
    return dim.join(per, "label_id", "left").select(
        "label_id",
        "label",
        n.alias("n_human"),
        F.round(100 * F.col("_same") / F.col("n_human"), 1).alias("agree_pct"),
        F.round(100 * n / target, 1).alias("progress_pct"),
    )


def review_task(columns: Sequence[str], guess: str, score: str, version: str) -> Column:
    """A review item: shown fields plus the model's guess, as JSON."""
    result = F.struct(
        F.lit("sentiment").alias("from_name"),
        F.struct(F.array(guess).alias("choices")).alias("value"),
    )
    prediction = F.struct(
        F.lit(version).alias("model_version"), F.round(score, 4).alias("score"), F.array(result).alias("result")
    )
    return F.to_json(F.struct(F.struct(*columns).alias("data"), F.array(prediction).alias("predictions")))


def consensus_wrong(votes: DataFrame, key: str, prediction: str, label: str) -> DataFrame:
    """Rows on which all models agree with each other and not with the label."""
    per = votes.groupBy(key, label).agg(
        F.min(prediction).alias("predicted"), F.max(prediction).alias("_hi"), F.count("*").alias("n_models")
    )
    agreed = (F.col("predicted") == F.col("_hi")) & (F.col("predicted") != F.col(label))
    return per.filter(agreed).drop("_hi")
