"""Vector codes: each part of a vector becomes the number of its nearest entry in a codebook.

Nearest entries are found by a float32 matrix product: |entry|^2 - 2 part.entry orders the entries as the squared distances do. Every such score
has an interval that holds the exact value whatever the product's order of summation, from the standard bound on rounding errors of a dot product.
Entries whose interval starts above the best one's end can't be nearest; all others are evaluated again in 64-bit integers, and of the nearest the first one counts.
Codebooks (PARTS x ENTRIES entries) are broadcast; what a partition adds up for each entry is merged through groupBy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.llm._common import dropped, joined_by_group, written
from kerege.llm._vectors import finite, means, packed, unpacked

PARTS = 16
ENTRIES = 64
SCALE = 256
ROUNDS = 2
#: Unit roundoff of float32.
_UNIT = 2.0**-24


def screened(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries (columns) may be nearest to which points (rows), from float32 scores and their intervals.

    Both are integers below 2**27. Converting them and |entry|^2 to float32, `components` products and sums in any order, doubling
    (exact) and one subtraction are at most components + 4 roundings on the path of a term, so a score is off by
    at most g / (1 - g) * (|entry|^2 + 2 |point| |entry|), g = (components + 4) * 2**-24. The norms are taken in float64 and raised by 1e-12.
    """
    components = points.shape[1]
    squares = np.einsum("ij,ij->i", entries, entries)
    scores = squares.astype(np.float32) - np.float32(2) * (points.astype(np.float32) @ entries.astype(np.float32).T)
    norms = np.sqrt(squares.astype(np.float64)) * (1 + 1e-12)
    lengths = np.sqrt(np.einsum("ij,ij->i", points, points).astype(np.float64)) * (1 + 1e-12)
    g = (components + 4) * _UNIT
    off = g / (1 - g) * (norms * norms + 2 * lengths[:, None] * norms)
    scores = scores.astype(np.float64)
    return scores - off <= (scores + off).min(1)[:, None]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of its nearest entry (of equally near ones the first) and the exact squared distance."""
    rows, columns = np.nonzero(screened(points, entries))
    apart = points[rows] - entries[columns]
    exact = np.full((len(points), len(entries)), np.iinfo(np.int64).max)
    exact[rows, columns] = np.einsum("ij,ij->i", apart, apart)
    chosen = exact.argmin(1)
    return chosen, exact[np.arange(len(points)), chosen]


def _sums(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        parts, size, width = books.shape
        totals, n = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for frame in frames:
            points = unpacked(frame["packed"], parts * width).reshape(-1, parts, width)
            for p in range(parts):
                chosen, _ = nearest(points[:, p], books[p])
                n[p] += np.bincount(chosen, minlength=size)
                np.add.at(totals[p], chosen, points[:, p])
        part, entry = np.nonzero(n)
        if len(part):
            yield pd.DataFrame({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": n[part, entry], "totals": list(totals[part, entry])})

    return run


def _coded(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        parts, _, width = books.shape
        for frame in frames:
            points = unpacked(frame["packed"], parts * width).reshape(-1, parts, width)
            codes, error = np.empty((len(frame), parts), np.uint8), np.zeros(len(frame), np.int64)
            for p in range(parts):
                chosen, away = nearest(points[:, p], books[p])
                codes[:, p] = chosen
                error += away
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "code": [c.tobytes().hex() for c in codes], "error": error})

    return run


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits for each part), error long, label_error long, codebooks_sha256 for each vector (vec_id, embedding, label) that is kept.

    Vectors that are null or hold null, NaN or infinite components are dropped, and so are those that can't be cut like the others: all must have the number of components of the
    first kept vector, a multiple of `parts`. First is the smallest vec_id, of rows that repeat it the smallest components, rows without vec_id last. All rows stay, also those that repeat. Fewer
    vectors than `entries` (at most 256) make smaller codebooks; no vector, an empty result. Null labels count together; a label_error over long's range is null. Other columns are ignored, whatever
    their names; components whose distances don't fit a long raise ValueError.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    rows = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0) & finite(F.col("vector")))
    points = packed(rows, scale, "points")
    order = [F.col("vec_id").asc_nulls_last(), F.col("packed")]
    first = points.orderBy(*order).select("packed").limit(1).collect()
    components = len(first[0][0]) // 4 if first else parts
    alike = points.where(F.length("packed") == 4 * components)
    starts = [bytes(r[0]) for r in alike.orderBy(*order).select("packed").limit(entries).collect()]
    width = components // parts
    books = unpacked(pd.Series(starts, dtype=object), components).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if starts else 0):
        shared = spark.sparkContext.broadcast(books)
        books = books.copy()
        sums = alike.select("packed").mapInPandas(_sums(shared), "part int, entry int, n long, totals array<long>")
        for (part, entry), mean in means(sums, ["part", "entry"], width):
            books[part, entry] = mean
        shared.unpersist()
    shared = spark.sparkContext.broadcast(books)
    coded = written(alike.mapInPandas(_coded(shared), "vec_id long, label string, code string, error long"), "codes")
    shared.unpersist()
    dropped(points)
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    labels = written(total.select("label", F.expr("try_cast(total as bigint)").alias("label_error"), "n"), "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = joined_by_group(coded, labels, "label")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_screened_codes(spark, sf_dir: str) -> DataFrame:
    """The whole embeddings table."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assigned_sql(k: int) -> str:
    away = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    return f"a{k} as materialized (select vec_id, p, any_value(x) as x, min(o).e as e, min(o).d as d from (select v.vec_id, v.p, v.x, {{'d': cast({away} as bigint), 'e': c.e}} as o from v join c{k} c on v.p = c.p) group by vec_id, p)"


def _means_sql(k: int) -> str:
    mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
    return (
        f"m{k} as (select p, e, list({mean} order by i) as x from (select p, e, i, sum(x[i]) as s, count(*) as n from (select p, e, x, unnest(range(1, len(x) + 1)) as i from a{k - 1}) group by p, e, i) group by p, e), "
        f"c{k} as materialized (select c.p, c.e, coalesce(m.x, c.x) as x from c{k - 1} c left join m{k} m on c.p = m.p and c.e = m.e)"
    )


OP13_SQL = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as x, row_number() over (order by vec_id) - 1 as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select vec_id, e, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] as x from (select *, unnest(range(0, {PARTS})) as p from kept)),
c0 as materialized (select p, e, x from v where e < {ENTRIES}),
{_assigned_sql(0)},
{", ".join(f"{_means_sql(k)}, {_assigned_sql(k)}" for k in range(1, ROUNDS + 1))},
books as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as h from c{ROUNDS}),
coded as (select vec_id, string_agg(format('{{:02x}}', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by vec_id)
select c.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, b.h as codebooks_sha256
from coded c join kept k on c.vec_id = k.vec_id cross join books b
"""
