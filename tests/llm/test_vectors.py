import hashlib
import math

import duckdb
import numpy as np
import pytest

from kerege.llm import clustering, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, `Cluster` string, packed int"
NAN, INF = float("nan"), float("inf")


def near(point, entries):
    """Number and squared distance of the nearest entry, in Python's whole numbers."""
    away = [sum((int(a) - int(b)) ** 2 for a, b in zip(point, e, strict=True)) for e in entries]
    return away.index(min(away)), min(away)


def whole(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def lloyd(rows, components, scale, number, rounds):
    kept = [(i, whole(v, scale)) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in order[:number]]
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v, centroids)[0], []).append(v)
        for k, members in groups.items():
            centroids[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *near(v, centroids)) for i, v in kept]
    sums = {k: sum(d for _, c, d in found if c == k) for k in range(number)}
    return sorted(((i, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in found), key=str)


def vectors(n, components, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.normal(0, spread, components)]) for k in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [None] + [0.0] * (components - 1)), (n + 3, [NAN] + [0.0] * (components - 1)), (n + 4, [-INF] + [0.0] * (components - 1)), (n + 5, [0.0] * (components - 1))]
    return rows + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None if k % 5 == 0 else k % 3, "x", None, 7) for k, (i, v) in enumerate(rows)], SCHEMA).repartition(5)


def test_lloyd_equals_brute_force(spark):
    rows = vectors(60, 6, 1)
    got = clustering.clustered(frame(spark, rows), components=6, number=4, rounds=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows, 6, 1024, 4, 5)


def test_lloyd_ties_and_small_tables(spark):
    same = [(k, [0.5, -0.25]) for k in range(9)]
    got = clustering.clustered(frame(spark, same), components=2, number=3, rounds=2).collect()
    assert {(r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got} == {(0, 0, 0, 0)} and len(got) == 9
    few = clustering.clustered(frame(spark, same[:2]), components=2, number=8, rounds=3).collect()
    assert len(few) == 2
    for none in ([], [(1, None)], [(1, [1.0])]):
        empty = clustering.clustered(frame(spark, none), components=2)
        assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="don't fit a long"):
        clustering.clustered(frame(spark, [(1, [1e9, 0.0])]), components=2).collect()


@pytest.mark.parametrize("high", [3, 300, 1 << 20, (1 << 27) - 1])
def test_screening_keeps_every_nearest_entry(high):
    rng = np.random.default_rng(high)
    points, entries = rng.integers(-high, high + 1, (3000, 4)), rng.integers(-high, high + 1, (64, 4))
    entries[40:] = points[:24] + rng.integers(-1, 2, (24, 4))  # nearly equal distances, also where numbers are large
    entries[50] = entries[45]
    apart = (points[:, None, :] - entries[None, :, :]) ** 2
    away = apart.sum(2)
    chosen, distance = vector_codes.nearest(points, entries)
    assert (chosen == away.argmin(1)).all() and (distance == away.min(1)).all()
    maybe = vector_codes.screened(points, entries)
    assert maybe[np.arange(3000), away.argmin(1)].all()
    assert maybe.sum() < 3000 * 64 / 2 or high <= 3  # it does discard


def codes(rows, parts, entries, scale, rounds):
    kept = [(i, whole(v, scale), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[0], []).append(cut(v, p))
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    found = []
    for i, v, label in kept:
        at = [near(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for e, _ in at), sum(d for _, d in at), label))
    total = {}
    for r in found:
        total[r[3]] = total.get(r[3], 0) + r[2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in found), key=str)


@pytest.mark.parametrize("entries", [5, 64])
def test_codes_equal_brute_force(spark, entries):
    rows = vectors(70, 8, 2)
    table = [(i, v, None if k % 5 == 0 else k % 3) for k, (i, v) in enumerate(rows)]
    got = vector_codes.compressed(frame(spark, rows), parts=4, entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes(table, 4, entries, 256, 2)


def test_codes_of_small_tables(spark):
    for none in ([], [(1, None)], [(1, [1.0])]):
        empty = vector_codes.compressed(frame(spark, none), parts=2)
        assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same = vector_codes.compressed(frame(spark, [(k, [0.5, -0.25]) for k in range(9)]), parts=2, entries=4).collect()
    assert {(r.code, r.error, r.label_error) for r in same} == {("0000", 0, 0)} and len(same) == 9


@pytest.mark.parametrize("query, sql", [(clustering.op11_lloyd, clustering.OP11_SQL), (vector_codes.op13_screened_codes, vector_codes.OP13_SQL)])
def test_queries_equal_their_sql(spark, sf, query, sql):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    found = query(spark, sf)
    expected = con.execute(sql).to_arrow_table()
    assert found.columns == expected.column_names
    assert sorted(tuple(r) for r in found.collect()) == sorted(zip(*(c.to_pylist() for c in expected.columns), strict=True))
