"""The pipeline, stage by stage, against brute force on a small table with null, repeated and clashing rows."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from kerege.llm import quality_rules
from test_decontamination import slow_items
from test_quality_rules import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, __starts string, c0 long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table():
    rng = random.Random(11)
    lexicon = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choices(lexicon, k=n))
    texts = {k: prose(90) for k in range(60)}
    passage, item = prose(30), prose(16)
    near = texts[3].split()
    near[40] = "changed"
    texts |= {60: texts[5], 61: " ".join(near), 62: prose(60) + " " + passage + " " + prose(60), 63: prose(50) + " " + passage, 64: prose(60) + " " + item + " " + prose(20), 65: "too short", 66: None, 67: "", 68: prose(80) + " " + prose(9000)}
    texts[69] = (prose(20) + "\n") * 9
    rows = [(k, t) for k, t in texts.items()] + [(7, prose(75)), (9, texts[9]), (None, prose(70)), (None, None)]
    return [(d, t, "en" if (d or 0) % 2 else None, f"s{(d or 0) % 3}", len(t or ""), "i", "s", 5) for d, t in rows], [(1, item), (2, "another item that stands in no document of this table at all my friend")]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, items = table()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage-{k}"
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return folder, [[tuple(r) for r in df.collect()] for df in out], [df.columns for df in out]


def pairs(rows):
    return sorted(((r[0], r[1]) for r in rows), key=lambda p: (p[0] is None, p[0] or 0, p[1] or ""))


def test_columns_stay(stages):
    assert all(c == stages[2][0] for c in stages[2][:-1])
    _, rows, _ = stages
    assert all(r[4:] == (len_, "i", "s", 5) for r, len_ in ((r, r[4]) for part in rows[:-1] for r in part))


def test_quality(spark, stages):
    _, rows, _ = stages
    kept = {(r.doc_id, r.n_words) for r in quality_rules.judged(spark.createDataFrame(rows[0], SCHEMA)).where("kept").collect()}
    stays = {d for d, _ in kept}
    assert pairs(rows[1]) == pairs(r for r in rows[0] if r[0] in stays)
    assert all(not brute(r[1])[5] for r in rows[1] if r[0] is not None) and {d for d, *_ in rows[1]} >= set(range(60)) - {d for d in range(60) if brute(dict(pairs(rows[0]))[d])[5]} - {d for d in range(60) if d not in stays}
    assert not {65, 66, 67, 69} & {d for d, *_ in rows[1]}


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(stages):
    _, rows, _ = stages
    named = [r for r in rows[1] if r[0] is not None]
    sets, root = [shingles(r[1]) for r in named], list(range(len(named)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(named)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda k: (named[k][0], k))
                root[b] = a
    want = [named[k] for k in range(len(named)) if find(k) == k] + [r for r in rows[1] if r[0] is None]
    assert pairs(rows[2]) == pairs(want)


def test_repeated_passages(stages):
    _, rows, _ = stages
    first = {}
    for d, t, *_ in rows[2]:
        words = WORD.findall(t or "")
        for k in range(len(words) - 12 if d is not None else 0):
            w = tuple(words[k : k + 13])
            first[w] = min(d, first.get(w, d))
    want = []
    for d, t, *_ in rows[2]:
        words = WORD.findall(t or "")
        gone = {k + j for k in range(len(words) - 12) if d is not None and first[tuple(words[k : k + 13])] < d for j in range(13)}
        want.append((d, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else t))
    assert pairs(rows[3]) == pairs(want) and pairs(rows[3]) != pairs(rows[2])


def test_benchmark_passages(stages):
    _, rows, _ = stages
    items = table()[1]
    # a document without an id is a document too
    bad = {d for d, _, _ in slow_items([(-1 if d is None else d, t or "") for d, t, *_ in rows[3]], items)}
    assert bad == {64} and pairs(rows[4]) == pairs(r for r in rows[3] if (-1 if r[0] is None else r[0]) not in bad)


def test_packing(stages):
    from tokenizers import Tokenizer

    _, rows, columns = stages
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = {c: k for k, c in enumerate(columns[5])}
    found, places = {}, {}
    for r in rows[5]:
        found.setdefault(r[at["doc_id"]], []).append((r[at["piece"]], r[at["start"]], r[at["length"]], r[at["ids_crc32"]]))
        places.setdefault(r[at["sequence_id"]], []).append((r[at["offset"]], r[at["length"]]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    docs = {}
    for d, t, *_ in rows[4]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        docs.setdefault(d, []).append(ids)
    assert found.keys() == docs.keys()
    for d, every in docs.items():
        if len(every) == 1:
            for _, start, length, crc in found[d]:
                assert zlib.crc32(every[0][start : start + length].tobytes()) == crc
        assert sum(p[2] for p in found[d]) == sum(map(len, every))


def test_run_gives_the_last_stage(spark, stages):
    folder, rows, columns = stages
    got = corpus_pipeline.run(spark, folder)
    at = [columns[5].index(c) for c in ("doc_id", "piece", "length", "ids_crc32")]
    assert sorted((tuple(r) for r in got.select("doc_id", "piece", "length", "ids_crc32").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted((tuple(r[k] for k in at) for r in rows[5]), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    empty = f"{folder}/empty"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
