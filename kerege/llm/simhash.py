"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit SimHash of its 4-word shingles. Fingerprints that differ in few bits are linked,
and the links' components are the groups of near copies. Every fingerprint has a row in a pivot table: its
Hamming distances to PIVOTS fixed reference fingerprints. By the triangle inequality two fingerprints whose
distances to any pivot differ by more than the radius can't be linked, so a pair is discarded by its largest
coordinate difference, and only survivors are compared bit by bit. Within a bucket the rows stand in order of
the first pivot distance, so that a row meets only those within the radius on it.

Which pairs meet at all: the 64 bits are cut into radius + k zones; a pair within the radius differs in at
most `radius` zones and so agrees on at least k whole ones. Each choice of k zones is one bucketing, so no link
is lost and no bucket grows with the square of the corpus: k rises with the number of fingerprints.
Buckets of over BUCKET rows (a huge cluster of near copies) are cut by the pivot distances themselves: a row goes to its cell of SPLIT pivots' distances,
each in ranges of twice the radius, and to the cells below whose ranges it is within the radius of, so that a pair within the radius meets in
the cell of the nearer ones. Cells that still have over BUCKET rows aren't compared pair by pair: two fingerprints within the radius share a
midpoint within half the radius (rounded down) of one and half the radius (rounded up) of the other, so every row sends itself to all midpoints of
its bucket's free bits and each midpoint links its rows to its smallest one that is within the lower half: linear in rows, split by key. Both ways have
the links of the comparison, for every radius; the tests hold them against all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.llm import near_copies
from kerege.llm._common import LOWER, keeps_names, written
from kerege.llm._graph import connected_components
from kerege.shipping import ship_package

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Reference fingerprints of the pivot table.
PIVOTS = 32
#: Rows of a bucket that are compared in one task; larger buckets go by midpoints.
BUCKET = 8192
#: Pivots by whose distances larger buckets are cut.
SPLIT = 3
#: Mean rows of a bucket at most, by which the number of agreeing zones is set.
FULL = 4
#: Rows a task takes at once when it compares buckets.
CHUNK = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text: bits set in over half of its shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each row of docs (doc_id, text, ...); other columns are ignored."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint (uint64) to the fixed reference fingerprints."""
    refs = np.array([_pivot(i) for i in range(pivots)], np.uint64)
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def linked(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within equal keys: arrays of fingerprints a, b. Keys come sorted."""
    table = pivot_table(fps)
    order = np.lexsort((table[:, 0], keys))
    keys, fps, table = keys[order], fps[order], table[order]
    n = len(keys)
    change = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) + 1
    stop = change[np.searchsorted(change, np.arange(n), side="right")] if n else change
    parent = np.arange(n)

    def find(at: np.ndarray) -> np.ndarray:
        root = parent[at]
        while not np.array_equal(up := parent[root], root):
            root = up
        parent[at] = root
        return root

    rows = np.arange(n)
    step = 1
    while True:
        rows = rows[rows + step < stop[rows]]
        if not len(rows):
            break
        rows = rows[table[rows + step, 0] - table[rows, 0] <= radius]  # in order of this pivot: later rows are further
        i, j = rows, rows + step
        apart = find(i) != find(j)
        i, j = i[apart], j[apart]
        for at in range(1, table.shape[1], 8):
            if len(i):
                near = np.abs(table[i, at : at + 8] - table[j, at : at + 8]).max(1) <= radius
                i, j = i[near], j[near]
        true = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        i, j = i[true], j[true]
        while len(i):
            a, b = find(i), find(j)
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        step += 1
    roots = find(np.arange(n))
    child = np.flatnonzero(roots != np.arange(n))
    return fps[child], fps[roots[child]]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = linked(keys, fps.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy()))
            if len(keys) >= CHUNK:
                whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                if whole:
                    yield made(keys[:whole], fps[:whole])
                    keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield made(keys, fps)

    return run


def zone_masks(fingerprint_count: int, radius: int = RADIUS, full: int = FULL) -> list[int]:
    """Masks of the bucketings: every choice of k of radius + k zones, for the least k that keeps buckets small."""
    k = 1
    while k < 4 and fingerprint_count > full << (64 * k // (radius + k)):
        k += 1
    edges = [64 * z // (radius + k) for z in range(radius + k + 1)]
    zones = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(zones, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivot(i: int) -> int:
    return xxhash.xxh64_intdigest(str(i), SEED)


def similar_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect every pair of distinct fingerprints (column fp) within the radius."""
    ship_package(distinct.sparkSession)
    masks = zone_masks(distinct.count(), radius)
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for t, m in enumerate(masks)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select(F.col("x.key").alias("key"), "fp", F.col("x.t").alias("t"))
    cold, hot = _parted(rows, bucket, "hot")
    links = _compared(cold, radius)
    if hot is None:
        return links
    few, many = _parted(_cells(hot, radius), bucket, "cells")
    links = links.unionByName(_compared(few, radius))
    return links if many is None else links.unionByName(_by_midpoints(many.select("t", "fp").distinct(), masks, radius))


def _parted(rows: DataFrame, bucket: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """rows (key, fp, t) of keys with at most `bucket` rows, and the others (None if there are none)."""
    large = written(rows.groupBy("key", "t").count().where(F.col("count") > bucket).select("key", "t"), name)
    if not large.take(1):
        return rows, None
    return rows.join(large.select("key"), "key", "left_anti"), rows.join(large, ["key", "t"])


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Edges within equal keys, by pivot tables."""
    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long")


def _cells(rows: DataFrame, radius: int) -> DataFrame:
    """rows with a key for each cell of pivot distances that they belong to."""
    width = max(1, 2 * radius)
    out, names = rows, []
    for p in range(SPLIT):
        away = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(_pivot(p)))))
        home, over = F.floor(away / width), (away % width < radius) & (away >= width)
        out = out.withColumn(f"c{p}", F.explode(F.when(over, F.array(home, home - 1)).otherwise(F.array(home))))
        names.append(f"c{p}")
    return out.select(F.xxhash64("key", *names).alias("key"), "fp", "t")


def _by_midpoints(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Edges for rows (t, fp) of large buckets: those that share a midpoint are linked to its smallest near fingerprint."""
    near, far = radius // 2, radius - radius // 2
    out = None
    for t, mask in enumerate(masks):
        free = [1 << b for b in range(64) if not mask >> b & 1]
        flips = [sum(c) for r in range(far + 1) for c in combinations(free, r)]
        points = rows.where(F.col("t") == t).select("fp", F.explode(F.array(*[F.lit(_signed(x)) for x in flips])).alias("flip"))
        points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), (F.bit_count("flip") <= near).alias("near"))
        out = points if out is None else out.unionByName(points)
    lowest = out.where("near").groupBy("mid").agg(F.min("fp").alias("low"))
    return out.join(lowest, "mid").where("low <> fp").select(F.greatest("fp", "low").alias("a"), F.least("fp", "low").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id of its group, itself included).

    A null text counts as empty; texts without words share fingerprint zero and so one group. Rows that repeat a
    doc_id stay, each with its own fingerprint. A null doc_id is never a component_id unless its whole
    group has none; then it is null. An empty table gives an empty one.
    """
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = connected_components(similar_links(distinct, radius, bucket))
    member = written(groups.join(distinct, groups.node == distinct.fp).select("fp", "root", "first_id"), "members")
    best = member.groupBy("root").agg(F.min("first_id").alias("group_id"))
    label = distinct.join(member.join(best, "root").select("fp", "group_id"), "fp", "left")
    label = label.select("fp", F.least("group_id", "first_id").alias("component_id"))
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


@keeps_names
def deduplicated(docs: DataFrame, shingle: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY, each_text: bool = False) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id; all columns stay.

    Near copies are texts with a Jaccard similarity of their shingles of at least `similarity`; op1's digest and radius, which reach
    about 0.95 alone, don't count here. Rows that repeat a kept doc_id count as copies and one of them stays, in a fixed order; with
    each_text only where their words are the same, so that other texts of the same doc_id stay if they stand for their own
    groups. Rows without doc_id can't be named and stay.
    """
    by = ("__doc_id", "__id") if each_text else ("__doc_id",)
    return near_copies.representatives(docs, shingle, similarity, by=by).unionByName(docs.where("doc_id is null"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
