import re

import numpy as np
import pytest
import xxhash

from kerege.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string"


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", ["", None, "  \n", "One two", "a b c d", "A b c D e é É " * 20, "x y z\x0bw q\x85r"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_matches_spark_hash(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c d", 42)


@pytest.mark.parametrize(("bucket", "radius"), [(8192, 4), (3, 4), (8192, 5), (6, 3)])
def test_all_links(spark, bucket, radius):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**63, 100)]
    for base in fps[:8]:
        near = base
        for _ in range(12):  # chains: each link within the radius of the one before
            for b in rng.choice(63, rng.integers(1, radius + 2), replace=False):
                near ^= 1 << int(b)
            fps.append(near)
    fps = sorted(set(fps))
    links = simhash.similar_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius=radius, bucket=bucket)
    got = simhash.connected_components(links).collect()
    root = {r.node: r.root for r in got}
    want = slow_components([(f, f) for f in fps], radius)
    assert [root.get(f, f) for f in fps] == want


def test_odd_rows(spark):
    long = "w%d " * 3000 % tuple(range(3000))
    rows = [(7, "a b c d e", None, "s", 1, 5, "k"), (3, "A b C d e", "en", None, None, 6, None), (9, None, "en", "s", 1, 7, "k"), (4, "", None, None, 0, 8, "k")]
    rows += [(3, "A b C d e", "en", None, None, 6, None), (None, "a b c d e", None, None, None, None, None), (11, long, "en", "s", 1, 1, "x"), (12, long + "end", "en", "s", 1, 1, "x"), (3, "quite another text this is", "en", "s", 1, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    slow = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted((d if d is not None else -1, f, c) for (d, f), c in zip(slow, slow_components(slow), strict=True))
    assert got == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 3, 4, 11]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.deduplicated(docs).collect() == []


def test_query(spark, sf):
    got = {r.doc_id: r for r in simhash.op1_simhash(spark, sf).collect()}
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(rows)
    for (d, f), c in zip(rows, slow_components(rows), strict=True):
        assert (got[d].fingerprint, got[d].component_id) == (f"{f:016x}", c)
