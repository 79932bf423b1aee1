"""Centroid clustering by plain Lloyd rounds in whole numbers.

Vectors become integers once. In every round the centroids are broadcast (CENTROIDS rows, whatever the corpus), each partition takes
the squared differences to one centroid after the other, and a vector goes to the nearest, of equally near ones the first. What a partition adds up for each
centroid, integers all, is merged through groupBy, so that neither a large cluster nor the order of partitions changes a figure. Rounds read one written table and
hold no lineage; a lost executor repeats its partitions alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.llm._common import dropped, written
from kerege.llm._vectors import finite, means, packed, unpacked

COMPONENTS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
#: Prefix of the text whose hash chooses the first centroids.
SALT = "3:"


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of points the number of the nearest centroid (the smallest of equally near ones) and its squared distance."""
    away = np.empty((len(centroids), len(points)), np.int64)
    for k, centroid in enumerate(centroids):
        apart = points - centroid
        away[k] = np.einsum("ij,ij->i", apart, apart)
    chosen = away.argmin(0)
    return chosen, away[chosen, np.arange(len(points))]


def _sums(shared, components: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shared.value
        totals, n = np.zeros((len(centroids), components), np.int64), np.zeros(len(centroids), np.int64)
        for frame in frames:
            points = unpacked(frame["packed"], components)
            chosen, _ = nearest(points, centroids)
            n += np.bincount(chosen, minlength=len(centroids))
            for k in np.unique(chosen):
                totals[k] += points[chosen == k].sum(0)
        used = np.flatnonzero(n)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": n[used], "totals": [totals[k] for k in used]})

    return run


def _assigned(shared, components: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chosen, away = nearest(unpacked(frame["packed"], components), shared.value)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": chosen.astype(np.int32), "distance": away})

    return run


def first_centroids(points: DataFrame, number: int, components: int) -> np.ndarray:
    """The vectors with the smallest hashes of their vec_id, in order; ties by components, rows without vec_id last."""
    order = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    rows = points.orderBy(order, "packed").limit(number).select("packed").collect()
    return unpacked(pd.Series([bytes(r[0]) for r in rows], dtype=object), components)


def clustered(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, number: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster int, distance long, cluster_inertia and inertia long, centroid_sha256 for each vector (vec_id, embedding) that is kept.

    Kept are vectors of exactly `components` components, none of them null, NaN or infinite. Rows that repeat a vec_id or a vector stay, each for
    itself; a null vec_id stays null and is never among the first centroids unless there are too few others. Fewer vectors than `number` make
    fewer centroids, none an empty result. Equal centroids: the first one gets the vectors, the other stays as it is. Sums over long's range are null. Other columns are
    ignored, whatever their names; components whose distances don't fit a long raise ValueError.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    points = packed(rows.where((F.size("vector") == components) & finite(F.col("vector"))), scale, "points")
    centroids = first_centroids(points, number, components)
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)
        sums = points.select("packed").mapInPandas(_sums(shared, components), "cluster int, n long, totals array<long>")
        centroids = centroids.copy()
        for (cluster,), mean in means(sums, ["cluster"], components):
            centroids[cluster] = mean
        shared.unpersist()
    shared = spark.sparkContext.broadcast(centroids)
    found = written(points.mapInPandas(_assigned(shared, components), "vec_id long, cluster int, distance long"), "clusters")
    shared.unpersist()
    dropped(points)
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(k, fits(s), fits(sum(inertia.values())), digest(centroids[k])) for k, s in inertia.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_lloyd(spark, sf_dir: str) -> DataFrame:
    """The whole embeddings table."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(k: int) -> str:
    """Assignment of all vectors to the centroids c<k>."""
    away = f"list_sum(list_transform(range(1, {COMPONENTS} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    return f"a{k} as materialized (select vec_id, any_value(x) as x, min(o).k as k, min(o).d as d from (select v.vec_id, v.x, {{'d': cast({away} as bigint), 'k': c.k}} as o from v cross join c{k} c) group by vec_id)"


def _means_sql(k: int) -> str:
    """Centroids c<k> as means of assignment a<k - 1>."""
    mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
    return (
        f"m{k} as (select k, list({mean} order by i) as x from (select k, i, sum(x[i]) as s, count(*) as n from a{k - 1}, (select unnest(range(1, {COMPONENTS} + 1)) as i) group by k, i) group by k), "
        f"c{k} as materialized (select c.k, coalesce(m.x, c.x) as x from c{k - 1} c left join m{k} m on c.k = m.k)"
    )


OP11_SQL = f"""
with kept as (select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as x from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select * from kept),
c0 as materialized (select row_number() over (order by sha256('{SALT}' || vec_id)) - 1 as k, x from v qualify row_number() over (order by sha256('{SALT}' || vec_id)) <= {CENTROIDS}),
{_round_sql(0)},
{", ".join(f"{_means_sql(k)}, {_round_sql(k)}" for k in range(1, ROUNDS + 1))}
select a.vec_id, cast(a.k as integer) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.k) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on a.k = c.k
"""
