import math
import random
import time
from itertools import combinations

from kerege.llm import decontamination as dc


def test_seeds_lie_clear_of_all_substitutions():
    for places in combinations(range(13), 3):
        assert any(all(at + k not in places for k in range(len(mask)) if mask[k] == "1") for mask in dc.SEEDS for at in range(14 - len(mask)))
    for n in range(1, 13):
        run = dc.run_length(n)
        for places in combinations(range(n), n - math.ceil(0.75 * n)):
            assert any(not set(places) & set(range(at, at + run)) for at in range(n - run + 1))


def slow_items(docs, items):
    """(doc_id, item_id, overlap) by all alignments, without seeds."""
    out = {}
    for d, text in docs:
        words = text.split()
        for k, item in items:
            want = item.split()
            for start in range(1 - len(want), len(words)):
                agree = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(want)]
                width = min(13, len(want))
                if any(sum(agree[x : x + width]) >= math.ceil(0.75 * width) for x in range(len(want) - width + 1)):
                    out[d, k] = max(out.get((d, k), 0), sum(agree))
    return sorted((d, k, n) for (d, k), n in out.items())


def test_against_all_alignments(spark):
    rng = random.Random(5)
    items, docs = [], []
    for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13, 15, 20]):
        item = [f"q{k}x{j}" for j in range(n)]
        items.append((k, " ".join(item)))
        allowed = min(n, 13) - math.ceil(0.75 * min(n, 13))
        placings = list(combinations(range(min(n, 13)), allowed))
        for places in rng.sample(placings, min(len(placings), 60)) + [tuple(range(allowed + 1))]:
            copy = [("sub" if j in places else w) for j, w in enumerate(item)]
            before = [f"f{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 5]))]
            docs.append((len(docs), " ".join(before + copy + [f"f{rng.randrange(50)}" for _ in range(rng.choice([0, 4]))])))
    wanted = slow_items(docs, items)
    for block in (1, 1024):  # blocks as short as the longest item, and longer than the texts
        got = dc.contaminated_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block)
        assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "overlap").collect()) == wanted


def test_items_that_repeat_cost_in_proportion(spark):
    """A text of 200,000 words, an item all over; its lies are as many as its repetitions, and no row holds more than a block."""
    item = " ".join(f"w{j}" for j in range(20))
    items = spark.createDataFrame([(1, item), (2, " ".join(f"w{j}" for j in range(5, 20)) + " tail " + item), (3, "one two three")], "item_id long, text string")
    seconds = {}
    for k in (1_000, 10_000):
        docs = spark.createDataFrame([(7, f"{item} " * k), (8, "other words")], "doc_id long, text string")
        began = time.perf_counter()
        got = sorted(tuple(r) for r in dc.contaminated_items(docs, items).select("doc_id", "item_id", "overlap").collect())
        seconds[k] = time.perf_counter() - began
        assert got == [(7, 1, 20), (7, 2, 20)]
    assert seconds[10_000] < 10 * seconds[1_000] + 5


SCHEMA = "doc_id long, text string, __gone string, item_id string, __words long, overlap string"


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, None, "g", "x", 1, "o"), (2, "", None, None, None, None), (3, f"before {item} after", "g", None, 1, None), (3, "quite other words", None, None, None, None), (None, item.upper(), None, None, None, None), (4, "word " * 100_000 + item, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(7, item, 1), (5, item, 1), (8, None, 1), (None, "nothing of it is there", 1), (9, "", 1)], "item_id long, text string, doc_id long")
    got = {r.doc_id: (r.contaminated, r.item_id, r.overlap, r.n_items) for r in dc.report(docs, items).collect()}
    hit, none = (True, 5, 14, 2), (False, None, None, 0)
    assert got == {1: none, 2: none, 3: hit, None: hit, 4: hit}
    kept = dc.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert dc.decontaminated(docs, items.where("false")).count() == 6 and dc.report(docs.where("false"), items).collect() == []
    assert not any(r.contaminated for r in dc.report(docs, items.where("text is null")).collect())


def test_a_large_benchmark_is_joined_by_shuffle(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one, two = (sorted(tuple(r) for r in dc.contaminated_items(docs, items, n).collect()) for n in (300_000, 10))
    assert one == two and one


def test_recall_of_substitutions(spark, sf):
    """Passages of 13 words with 1 to 3 substitutions, one in each of the items: all are found."""
    rng = random.Random(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = []
    for k, (_, text) in enumerate(items):
        words = [w for w in __import__("re").findall(r"[^\W_]+", text.lower())][:13]
        for place in rng.sample(range(13), 1 + k % 3):
            words[place] = f"sub{rng.randrange(99)}"
        docs.append((k, "some words in front " + " ".join(words) + " and behind"))
    got = {(r.doc_id, r.item_id) for r in dc.contaminated_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all((k, item) in got for k, (item, _) in enumerate(items))
