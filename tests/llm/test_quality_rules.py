import itertools
import random
import re

import numpy as np
import pytest

from kerege.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, __key string, x0 double, __kept long, __words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {p + j for places in windows.values() if len(places) > 1 for p in places for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


ODD = [None, "", " \n\t\n ", "a", "a b c a b c", "a a a a a", "x\ny\nx\n \nx \n y", "#*$%&|<> é 字 b", "word " * 30000, "a b c d " * 40 + "e", "\n".join(["one two three", "one  two three", "one two three"])]


def rows_of(texts, first=0):
    return [(first + k, t, "en" if k % 3 else None, f"s{k % 4}", "k", 1.0, 2, "w") for k, t in enumerate(texts)]


def test_counts_against_brute_force(spark, sf):
    given = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = [*ODD, *given]
    got = {r.doc_id: r for r in q.judged(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def covariance(x, share):
    return q.consistency(share) * np.cov(x.T, bias=True) + np.diag(np.square(q.FLOORS))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_least_determinant_against_all_subsets(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (11, 4)), rng.normal(8, 0.5, (4, 4))])
    least = min(np.linalg.det(covariance(x[list(c)], 0.6)) for c in itertools.combinations(range(15), 9))
    rows = spark.createDataFrame([("k", *map(float, r)) for r in x], "__key string, x0 double, x1 double, x2 double, x3 double")
    got = q.estimates(rows).first()
    assert least * 0.999 < got.det < 1.35 * least  # rows at the edge count in part; C-steps find a local least
    assert np.abs([got.m0, got.m1, got.m2, got.m3]).max() < 2


def test_salted_keys_give_the_same(spark):
    rng = np.random.default_rng(5)
    data = [(f"k{k % 3}", *map(float, rng.normal(k % 3, 1, 4))) for k in range(300)]
    rows = spark.createDataFrame(data, "__key string, x0 double, x1 double, x2 double, x3 double")
    one, two = ({r["__key"]: [r[c] for c in (*q._MEANS, *q._FACTORS, "det")] for r in q.estimates(rows, few=few).collect()} for few in (True, False))
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], rtol=1e-6, atol=1e-9) for k in one)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(n))


def test_outliers_go_and_prose_stays(spark):
    rng = random.Random(7)
    texts = [prose(rng, 80) for _ in range(150)]
    bad = [" ".join(w + "###" for w in prose(rng, 80).split()), " ".join("".join(rng.choices("ab", k=30)) for _ in range(80)), "\n".join([prose(rng, 60)] + [prose(rng, 12).replace(" ", "\n")] + ["a b\nc d"] * 12)]
    got = {r.doc_id: r.kept for r in q.judged(spark.createDataFrame(rows_of([*texts, *bad]), SCHEMA)).collect()}
    assert all(got[k] for k in range(150)) and not any(got[150 + k] for k in range(3))


def test_one_statistic_alone_rejects(spark):
    """In a group without spread each statistic passes the cutoff by itself."""
    none = [0.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([("k", *none)] * 60, "__key string, x0 double, x1 double, x2 double, x3 double")
    estimate = q.estimates(rows)
    ends = [np.log(2.1), np.log1p(7.5), np.log1p(7.5), np.log1p(47)]
    far = spark.createDataFrame([("k", *[float(ends[i]) if i == j else 0.0 for i in range(4)]) for j in range(4)], "__key string, x0 double, x1 double, x2 double, x3 double")
    assert all(r.d2 > q.CUTOFF for r in q._distance(far, estimate, True).collect())


def test_accepted_rows(spark):
    rng = random.Random(9)
    good = prose(rng, 60)
    rows = [(1, good, "en", "a", None, None, None, None), (1, "short", "en", "a", "k", 1.0, 3, "w"), (None, good, None, None, None, None, None, None), (2, None, "en", "a", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = q.accepted(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, good), (1, "short"), (0, good)])
    empty = spark.createDataFrame([], SCHEMA)
    assert q.judged(empty).collect() == [] and q.accepted(empty).collect() == []
