import hashlib
import random
import re

import pytest

from kerege.llm import recompression as rc

SCHEMA = "doc_id long, text string, lang string, name long, starts string"


def slow(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                low[k] = min(d, low.get(k, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if d is not None and low[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", 1, "x") for d, t in rows], SCHEMA)
    kept = rc.without_repeats(docs)
    assert kept.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)


def check(spark, rows, tmp_path):
    spark.createDataFrame([(d, t, "en", 1, "x") for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in rc.op2_recompression(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, tmp_path, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range((3, 30, 400)[seed])]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            passage = rng.choice(base)
            cut = rng.randrange(len(passage))
            words += passage[cut:] if rng.random() < 0.5 else passage[: cut + 1]
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(4))]
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(words)))
    rng.shuffle(rows)
    check(spark, rows, tmp_path)


def test_odd_rows(spark, tmp_path):
    p = " ".join(f"p{i}" for i in range(20))
    run_ = "de " * 50
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(5, p), (3, p + " tail"), (3, p), (None, p), (8, None), (9, ""), (10, "a " + p), (11, run_), (12, "x " + run_ + "y"), (13, "de " * 13), (14, "de " * 12), (20, long), (21, "q " + long), (1, "é" + p)]
    check(spark, rows, tmp_path)
    kept = dict(run(spark, [r for r in rows if r[0] not in (3, None)]))
    assert kept[8] is None and kept[9] == "" and kept[14] == "de " * 12 and kept[21] == "q"


def test_empty(spark):
    assert run(spark, []) == []
