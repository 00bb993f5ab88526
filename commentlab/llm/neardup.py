"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Distinct fingerprints are grouped by the population counts of their four 16-bit parts. Two
fingerprints at most ``RADIUS`` bits apart have counts that differ by ``RADIUS`` at most in
sum, so only tiles of such groups meet; all others are skipped unseen. Tiles that meet are
compared in full with numpy's exclusive-or and bit counts. A pair of tiles reports not all its
links but a forest that connects the same fingerprints; connected components of those links are
found by rounds of minimum labels, each written to the shared folder.

Exact copies share one fingerprint and count once in all this, however many they are.

Defined cases: a null or empty text has no words, its fingerprint is zero and links like any
other; fewer than three words are one shingle; ids may be null or repeated: a component's id is
its smallest id that is not null, null if there is none; an empty table gives no rows; other
columns are carried along or ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlab.operators.keyed import first_per_key, salted_join
from commentlab.session import materialize

from .common import packed, same, text_key, unpacked

# Executors get the functions of this module with the task and need not have it installed.
register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
SEED = 42
RADIUS = 2
PARTS, PART_BITS = 4, 16
# Fingerprints in a tile, about; a comparison holds TILE * BLOCK numbers at a time.
TILE, BLOCK = 2048, 256
# Left tiles of a cell that meet its neighbours in one place, and places for the rows of a hot key.
TOGETHER, SALTS = 8, 8
# A part's count is kept in six bits with RADIUS added, so no sum of steps leaves its bits.
COUNT_BITS = 6


def fingerprint(text: str | None) -> int:
    """Bits set in more than half the hashes of the shingles, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, print`` of each row, written."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    made = rows.mapInArrow(fingerprint_batches, f"doc_id {kind}, text_key long, print long")
    return materialize(made, "fingerprints")


def forest(left: np.ndarray, right: np.ndarray, same_tile: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, thinned to a star per connected group of their fingerprints."""
    nodes = left if same_tile else np.concatenate([left, right])
    shift = 0 if same_tile else len(left)
    root = np.arange(len(nodes))
    for start in range(0, len(left), BLOCK):
        near = np.bitwise_count(left[start : start + BLOCK, None] ^ right[None, :]) <= RADIUS
        i, j = np.nonzero(near)
        # The stars of earlier blocks go along: a root that is lowered must take all its nodes with it.
        held = np.nonzero(root != np.arange(len(nodes)))[0]
        i, j = np.concatenate([i + start, held]), np.concatenate([j + shift, root[held]])
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            # Lower the roots too, so that whole groups move and not single fingerprints.
            for ends in (i, j, before[i], before[j]):
                np.minimum.at(root, ends, low)
            root = root[root]
            if (root == before).all():
                break
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def link_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for a, b, same_tile in zip(batch.column("a"), batch.column("b"), batch.column("same_tile").to_pylist()):
            left, right = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
            found.append(forest(left, right, same_tile))
        ends = [np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])


def steps() -> tuple[list[int], list[int]]:
    """Differences between the cells of fingerprints within the radius: each once, by sign."""
    some = [d for d in product(range(-RADIUS, RADIUS + 1), repeat=PARTS) if sum(map(abs, d)) <= RADIUS]
    packed_steps = [sum(x << (COUNT_BITS * k) for k, x in enumerate(d)) for d in some]
    return [s for s in packed_steps if s >= 0], packed_steps


def tiles(prints: DataFrame) -> DataFrame:
    """``cell, tile, prints``: distinct fingerprints by the counts of their parts, in arrays."""
    mask = (1 << PART_BITS) - 1
    cell = F.lit(0).cast("long")
    for k in range(PARTS):
        part = F.call_function("shiftrightunsigned", F.col("print"), F.lit(k * PART_BITS)).bitwiseAND(F.lit(mask))
        cell = cell + F.call_function("shiftleft", (F.bit_count(part) + RADIUS).cast("long"), F.lit(k * COUNT_BITS))
    rows = prints.select("print").distinct().withColumn("cell", cell)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("long").alias("n_tiles"))
    placed = rows.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("print"), "n_tiles"))
    return placed.groupBy("cell", "tile").agg(F.collect_list("print").alias("prints"))


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: fingerprints within the radius, enough links to connect all that are."""
    near = materialize(tiles(prints), "tiles")
    left = near.select(F.col("cell").alias("from_cell"), F.col("tile").alias("from_tile"), F.col("prints").alias("a"))
    left = left.withColumn("step", F.explode(F.lit(steps()[0]).cast("array<bigint>")))
    left = left.withColumns({"cell": F.col("from_cell") + F.col("step"), "run": F.expr(f"from_tile div {TOGETHER}")})
    # A cell of many tiles is met in several places, by runs of the left tiles.
    right = near.withColumnRenamed("prints", "b").join(left.select("cell", "run").distinct(), "cell")
    met = left.join(right, ["cell", "run"]).filter("step <> 0 OR from_tile <= tile")
    pairs = met.select("a", "b", ((F.col("step") == 0) & (F.col("from_tile") == F.col("tile"))).alias("same_tile"))
    return pairs.mapInArrow(link_batches, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``print, root`` of every linked fingerprint; the root is the least of its component.

    Each round takes the least root among the neighbours, hangs the old root below it too, and
    follows roots one step. It ends when a round changes nothing.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    roots = materialize(both.groupBy(F.col("a").alias("print")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        ends = salted_join(both, roots.withColumnsRenamed({"print": "b", "root": "near"}), "b", SALTS)
        ends = salted_join(ends, roots.withColumnsRenamed({"print": "a", "root": "own"}), "a", SALTS)
        offers = ends.select(F.explode(F.array("a", "own")).alias("print"), "near").groupBy("print").agg(F.min("near").alias("near"))
        lower = roots.join(offers, "print", "left").select("print", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        lower = materialize(lower, "roots")
        above = lower.select(F.col("print").alias("root"), F.col("root").alias("next"))
        moved = salted_join(lower, above, "root", SALTS).select("print", "old", F.col("next").alias("root"))
        moved = materialize(moved, "roots")
        roots = moved.select("print", "root")
        if moved.filter("root <> old").isEmpty():
            return roots


def rooted(prints: DataFrame) -> DataFrame:
    """``prints`` with the ``root`` of each fingerprint's component."""
    found = components(links(prints)).withColumnRenamed("root", "found")
    return salted_join(prints, found, "print", SALTS).withColumn("root", F.coalesce("found", "print")).drop("found")


def report(docs: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    rows = materialize(rooted(fingerprints(docs)), "rooted")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return salted_join(rows, least, "root", SALTS).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the ``rows`` with a ``root`` each, the document with the smallest id, with its own columns."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    chosen = rows.groupBy("root").agg(F.min(first).alias("first")).select("first.doc_id", "first.text_key").distinct()
    keyed = packed(docs).withColumns({"doc_id": F.col("row.doc_id"), "text_key": text_key("row.text")})
    kept = keyed.join(chosen, same(keyed, chosen, ["doc_id", "text_key"]), "left_semi")
    order = F.xxhash64(*(F.col(f"row.`{c}`").cast("string") for c in docs.columns if c not in ("text",)))
    return unpacked(first_per_key(kept, ["doc_id", "text_key"], [order]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id, with its own columns."""
    return keep_first(docs, rooted(fingerprints(docs)))
