import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerege.llm import line_quality as lq
from kerege.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string, score double, id long"


def accuracy(got, labels, name):
    known = [(r, labels[r.doc_id][name]) for r in got if r.held_out and r.doc_id in labels]
    assert known
    return sum(r.predicted == y for r, y in known) / len(known)


# --- the field


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    energy, stay = rng.normal(size=8), 0.7
    good, total, same = lq.marginals(energy, sizes, stay)
    at, logz = 0, 0.0
    for n in sizes:
        weight, share, pair = 0.0, np.zeros(n), np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            w = math.exp(sum(energy[at + k] * y[k] for k in range(n)) + sum(stay for k in range(1, n) if y[k] == y[k - 1]))
            weight += w
            share += w * np.array(y)
            pair += w * np.array([k > 0 and y[k] == y[k - 1] for k in range(n)])
        assert np.allclose(good[at : at + n], share / weight) and np.allclose(same[at : at + n], pair / weight)
        logz += math.log(weight)
        at += n
    assert math.isclose(total, logz)


def test_field_learns_junk_lines():
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice(["the", "town", "of", "men", "house"]) for _ in range(rng.randrange(4, 12))) + "."
    junk = lambda: " ".join(w + "###" for w in clean().split())
    texts = ["\n".join((clean if k % 2 else junk)() for _ in range(rng.randrange(1, 8))) for k in range(400)]
    parts = [lq.line_features(t)[0] for t in texts]
    y = np.arange(400) % 2
    field = lq.fit(np.concatenate(parts), np.array([len(p) for p in parts]), y.astype(float))
    assert ((lq.scores(texts, field) >= 0.5) == y).mean() > 0.99
    assert lq.scores(["", None, " \n"], field).tolist() == [0.5] * 3


def test_quality_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 1.0, 1), (1, "a b\n\nc", None, None, None), (None, "x ###", "x", 1.0, 1), (3, "word " * 50000, "x", 1.0, 1), (4, "", "x", 1.0, 1)], DOCS)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality long")
    got = lq.quality(docs, labels, lambda d: F.crc32(d.cast("string")) % 3 != 1).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = spark.createDataFrame([], DOCS)
    assert lq.quality(empty, labels, lambda d: d > 0).collect() == []
    assert {r.score for r in lq.quality(docs, labels.where("false"), lambda d: d > 0).collect()} == {0.5}


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    got = lq.op7_line_field(spark, sf).collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert accuracy(got, labels, "quality") > 0.95


# --- the models


def slow_models(texts, every):
    """Evidence of word w after h by the definition, from (words, toxic): interpolated Kneser-Ney of both classes over one shared lower order; the pairs that count are those of over 3 toxic texts of `every`."""
    pairs = lambda t: list(zip(["^", *t], t, strict=False))
    second = Counter(w for t, _ in texts for w in set(t))
    n, v = second.total(), len(second)

    def probability(y, h, w):
        one, two = Counter(), Counter()
        for t, kind in texts:
            if kind == y:
                one.update(set(t))
                two.update(set(pairs(t)))
        base = (max(second[w] - 0.75, 0) + 0.75 * v / (v + 1)) / n
        of_words = max(one[w] - 3, 0) / one.total() + sum(min(3, x) for x in one.values()) / one.total() * base
        known = Counter(p for t, kind in every if kind == 1 for p in set(pairs(t)))
        after = {p: x for p, x in two.items() if p[0] == h}
        if not after:
            return of_words
        own = {p: max(x - 3, 0) for p, x in after.items() if known[p] > 3}
        return (own.get((h, w), 0) + (sum(after.values()) - sum(own.values())) * of_words) / sum(after.values())

    return lambda h, w: math.log(probability(1, h, w)) - math.log(probability(0, h, w))


@pytest.mark.parametrize("head", [10**6, 5])
def test_evidence_against_the_definition(spark, head):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices("a b b c cя 字" .split() if k % 2 else "a b d d я".split(), k=rng.randrange(1, 12))), k % 2) for k in range(60)]
    training = spark.createDataFrame([(k, t.upper() if k % 3 else t) for k, t, _ in rows] + [(99, rows[0][1])], "doc_id long, text string")
    known = spark.createDataFrame([(k, y) for k, _, y in rows] + [(99, rows[0][2])], "id long, toxic int")
    texts = tx.training_texts(training, known)
    kept = [(tx.words(r.text), r.toxic, r.fold) for r in texts.collect()]
    counts = tx.word_counts(texts)
    table, constant = tx.evidence(counts, tx.pair_counts(texts, counts, head))
    tests = ["a b", "b b b cя", "D я! quite new", "a b", "", " ".join(rng.choices("a b c d я 字 new".split(), k=50))]
    docs = spark.createDataFrame([(k, 0, f, t) for k, t in enumerate([*tests, None]) for f in (1, tx.FOLDS)], "id long, label int, fold int, text string")
    got = {(r.id, r.fold): r for r in tx.figures(docs, table, constant, [1, tx.FOLDS], head).collect()}
    for fold in (1, tx.FOLDS):  # a model that leaves out a fold, and the one that leaves out none
        slow = slow_models([(t, y) for t, y, f in kept if f != fold], [(t, y) for t, y, _ in kept])
        for k, text in enumerate(tests):
            found, r = tx.words(text), got[k, fold]
            assert r.n == len(found)
            want = [slow(h, w) for h, w in zip(["^", *found], found, strict=False)] or [0.0]
            assert abs(r["mean"] - sum(want) / len(want)) < 1e-9 and abs(r.top - sum(sorted(want)[-3:]) / len(want[:3])) < 1e-9
    assert got[6, 1].n == 0 and got[6, 1]["mean"] == 0


def test_both_ways_have_the_same_figures(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("toxic is not null").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    texts = tx.training_texts(docs, known)
    table, constant = tx.evidence(tx.word_counts(texts), tx.pair_counts(texts, tx.word_counts(texts)))
    rows = docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("int").alias("label"), F.lit(tx.FOLDS).alias("fold"), "text")
    one, two = ({r.id: (r.n, round(r["mean"], 9), round(r.top, 9)) for r in tx.figures(rows, table, constant, [tx.FOLDS], head).collect()} for head in (10**6, 50))
    assert one == two and len({x[2] for x in one.values()}) > 50


def test_long_texts_are_counted_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tx, "CHUNK", 7)
    text = " ".join(random.Random(3).choices(["a", "b", "c", "dd"], k=400))
    batch = pa.RecordBatch.from_pydict({"text": [text, None, "zz", text], "toxic": [0, 1, 1, 1], "fold": [0, 0, 1, 0]})
    got = Counter()
    for of_text in (tx._of_words, tx._of_pairs()):
        for out in tx._counted(of_text)(iter([batch])):
            for r in out.to_pylist():
                got[r["gram"], r["toxic"]] += r["n"]
    found = tx.words(text)
    pairs = set(zip(["^", *found], found, strict=False))
    grams = {**dict.fromkeys(found, 1), **{f"{h} {w}": 1 for h, w in pairs}, **Counter(f"{h} " for h, _ in pairs)}
    assert got == Counter({**{(g, y): n for g, n in grams.items() for y in (0, 1)}, ("zz", 1): 1, ("^ zz", 1): 1, ("^ ", 1): 2})


def test_toxicity_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 1.0, 1), (1, "a b", None, None, None), (None, "x ###", "x", 1.0, 1), (3, "word " * 50000, "x", 1.0, 1), (4, "", "x", 1.0, 1)], DOCS)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic long")
    got = tx.toxicity(docs, labels, lambda d: F.crc32(d.cast("string")) % 4 != 2).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert tx.toxicity(spark.createDataFrame([], DOCS), labels, lambda d: d > 0).collect() == []
    assert {r.score for r in tx.toxicity(docs, labels.where("false"), lambda d: d > 0).collect()} == {0.0}


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.1"
    got = tx.op10_kneser_ney(spark, sf).collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert accuracy(got, labels, "toxic") > 0.95
    known = [(r, labels[r.doc_id].toxic) for r in got if r.held_out and r.doc_id in labels]
    hit, found, true = (sum(x) for x in zip(*[(y * r.predicted, r.predicted, y) for r, y in known], strict=True))
    assert 2 * hit / (found + true) > 0.85, (hit, found, true)


@pytest.mark.parametrize("keys", [10**6, 0])
def test_pairs_of_ordinary_texts_are_known_too(spark, keys):
    """A pair of four ordinary texts and no toxic one has a share in the ordinary model, and counts are exact for both classes."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choices("a b c d e f".split(), k=rng.randrange(2, 9))), k % 2, k % tx.FOLDS) for k in range(40)] + [(f"only here n{k}", 0, k) for k in range(4)]
    texts = spark.createDataFrame(rows, "text string, toxic int, fold int")
    got = {r.gram: r for r in tx.all_pair_counts(texts, keys).collect()}
    wanted = {0: Counter(), 1: Counter()}
    for text, toxic, _ in rows:
        found = text.split()
        wanted[toxic].update({f"{h} {w}" for h, w in zip(["^", *found], found, strict=False)})
    often = {g for side in wanted.values() for g, n in side.items() if n > tx.DISCOUNT}
    assert set(got) == often and "only here" in often
    assert all((r[f"t{tx.FOLDS}"], r[f"o{tx.FOLDS}"]) == (wanted[1][g], wanted[0][g]) for g, r in got.items())
    counts = tx.word_counts(texts)
    table, constant = tx.evidence(counts, tx.all_pair_counts(texts, keys))
    assert table.where("key = 'only here'").count() == 1
    asked = spark.createDataFrame([(k, 0, tx.FOLDS, t) for k, (t, _, _) in enumerate(rows)], "id long, label int, fold int, text string")
    one, two = ({r.id: (r.n, round(r["mean"], 9), round(r.top, 9)) for r in tx.figures(asked, table, constant, [tx.FOLDS], head).collect()} for head in (10**6, 5))
    assert one == two


def test_texts_are_scored_by_the_block(monkeypatch):
    """Hashes of a batch of short texts are mixed and looked up a few times, not for each text; the figures are those of single words."""
    import pyarrow as pa
    import xxhash

    rng = random.Random(8)
    texts = [None, "", " \n", "^ ^", "STRASSE straße İx", "字 字я a_b", "x" * 3000] + [" ".join(rng.choices("a b c é Ö ² 字 new".split(), k=rng.randrange(9))) for _ in range(300)]
    digest = lambda w: np.array([xxhash.xxh64_intdigest(w.encode(), 1)], np.uint64)
    value = {}
    for k, (h, w) in enumerate(product(["^", "a", "é", "字"], ["", "a", "ö", "字"])):
        value[int(tx._mixed(digest(h), digest(w))[0])] = k / 7 - 1
    value |= {int(digest(w)[0]): k / 3 - 1 for k, w in enumerate(["a", "é", "ö", "x" * 3000])}
    keys = np.array(sorted(value), np.uint64)
    values = np.array([value[int(k)] for k in keys])
    models = {0: (values, 0.25), 1: (-values, -0.5)}

    def slow(text, values, constant):
        found, at, out = tx._WORD.findall((text or "").lower()), dict(zip(keys.tolist(), values.tolist(), strict=True)), []
        for h, w in zip(["^", *found], found, strict=False):
            own, led, whole = (at.get(int(x[0])) for x in (digest(w), tx._mixed(digest(h), digest("")), tx._mixed(digest(h), digest(w))))
            out.append(whole if None not in (own, led, whole) else (constant if own is None else own) + (led or 0.0))
        return len(out), sum(out) / max(1, len(out)), sum(sorted(out)[-tx.STRONGEST :]) / max(1, len(out[: tx.STRONGEST]))

    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array([k % 2 for k in range(n)], pa.int32()), pa.array(texts)], names=["id", "label", "fold", "text"])
    wanted = [slow(t, *models[k % 2]) for k, t in enumerate(texts)]
    calls, mixed = [], tx._mixed
    monkeypatch.setattr(tx, "_mixed", lambda h, w: calls.append(1) or mixed(h, w))
    for block in (10**6, 40):
        monkeypatch.setattr(tx, "BLOCK", block, raising=False)
        got = pa.Table.from_batches(tx._figures(type("Held", (), {"value": (keys, models)}))(iter([batch])))
        assert got.column("n").to_pylist() == [w[0] for w in wanted]
        assert np.allclose([got.column(c).to_pylist() for c in ("mean", "top")], [[w[1] for w in wanted], [w[2] for w in wanted]])
        assert block == 40 or len(calls) <= 4, len(calls)


def test_words_are_those_of_the_pattern():
    every = [chr(c) for c in range(0x110000)]
    assert tx.words(" ".join(every)) == tx._WORD.findall(" ".join(every).lower())
    assert all(tx.words(f"a{c}B") == tx._WORD.findall(f"a{c}B".lower()) for c in every[:0x3000])


def test_a_large_table_of_evidence_goes_in_parts(spark, monkeypatch):
    """Figures by parts of the pairs are those of the whole table; no words are shuffled, and all rows stay, those that repeat an id too."""
    rng = random.Random(11)
    of_class = ("abcdefgh", "efghijkl")
    rows = [(" ".join(rng.choices(of_class[k % 2], k=rng.randrange(12, 40))), k % 2, k % tx.FOLDS) for k in range(200)]
    texts = spark.createDataFrame(rows, "text string, toxic int, fold int")
    table, constant = tx.evidence(tx.word_counts(texts), tx.all_pair_counts(texts))
    single = table.where(~F.contains(F.rtrim("key"), F.lit(" "))).count()
    models = [1, tx.FOLDS]
    head = 3 * single // 2 + 3
    assert single <= 2 * head // 3 and 2 * (2 * head // 3) < table.count()
    more = [(7, rows[7][0]), (7, rows[8][0]), (900, None), (901, ""), (902, "new words alone"), (None, "a b")] * 2
    asked = spark.createDataFrame([(k, 0, f, t) for k, t in [*((k, t) for k, (t, _, _) in enumerate(rows)), *more] for f in models], "id long, label int, fold int, text string")

    def shuffled(*args):
        raise AssertionError("words are shuffled")

    monkeypatch.setattr(tx, "_by_shuffle", shuffled)
    one, two = (Counter((r.id, r.label, r.fold, r.n, round(r["mean"], 9), round(r.top, 9)) for r in tx.figures(asked, table, constant, models, h).collect()) for h in (10**6, head))
    assert one == two and sum(two.values()) == 2 * len(rows) + 4 * len(more) // 2 and max(two.values()) >= 2


def test_pairs_are_counted_in_passes_over_their_hashes(spark, monkeypatch):
    """With more hashes than can be broadcast at once no pass counts all pairs by themselves."""
    rng = random.Random(12)
    rows = [(" ".join(rng.choices("abcdef", k=9)), k % 2, k % tx.FOLDS) for k in range(60)]
    texts = spark.createDataFrame(rows, "text string, toxic int, fold int")
    passes, among = [], tx._of_pairs_among
    monkeypatch.setattr(tx, "_of_pairs_among", lambda keys: passes.append(keys and len(keys.value)) or among(keys))
    one, two = ({tuple(r) for r in tx.all_pair_counts(texts, keys).collect()} for keys in (10**6, 15))
    assert one == two and len(one) == passes[0]
    assert None not in passes and sum(passes[1:]) == passes[0] and 2 <= len(passes[1:]) <= 4


def test_scores_are_the_same_however_little_is_broadcast(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen, parts, sizes, figures = [], tx._by_parts, [], tx.figures
    monkeypatch.setattr(tx, "figures", lambda rows, table, *args: sizes.append((table.where(~F.contains(F.rtrim("key"), F.lit(" "))).count(), table.count())) or figures(rows, table, *args))
    monkeypatch.setattr(tx, "_by_parts", lambda *args: seen.append(args[4]) or parts(*args))
    one = tx.toxicity(docs, labels, lambda d: d > 0).collect()
    single, size = sizes[-1]
    assert single < size and not seen
    two = tx.toxicity(docs, labels, lambda d: d > 0, head=single).collect()
    assert seen and {(r.doc_id, round(r.score, 9)) for r in one} == {(r.doc_id, round(r.score, 9)) for r in two} and len(one) == len(two)
