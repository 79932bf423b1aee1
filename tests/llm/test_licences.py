import re

import pytest

from kerege.llm import licences

SCHEMA = "doc_id long, text string, n_words string, labels long"


@pytest.fixture(scope="module")
def finder():
    return licences.NoticeFinder(licences.PHRASES, licences.NOTICES)


def slow_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, found


TEXTS = ["", None, "MIT  license", "mit-license mit license.MIT License", "summit license", "Éa mit license é", "general public\nlicense apache license", "x " * 50000 + "MIT License", "mit license\x85 mit"]


@pytest.mark.parametrize("text", TEXTS)
def test_base(finder, text):
    words, found = slow_base(text)
    got = finder.scan(text)
    assert got["n_words"] == len(words) and got["n_base"] == len(found)
    assert got["first_word"] == min((w for w, _ in found), default=None)
    assert got["last_word"] == max((w for w, _ in found), default=None)
    assert got["base_labels"] == ",".join(sorted({x for _, x in found}))


def test_fuzzy(finder):
    got = finder.scan("some words. Licenced under teh Apache Licence, Version 2.0. and more")
    assert got["base_labels"] == "" and got["labels"] == "apache"
    assert 0.9 <= got["score"] < 1 and got["spans"][0]["first_word"] == 2
    assert finder.scan("Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc"
    assert finder.scan("the license of the public version is here")["labels"] == ""


def test_every_notice_within_its_edits_is_found(finder):
    import random

    rng = random.Random(2)
    for notice, label, edits, _ in finder.notices:
        for _ in range(20):
            x = list(notice)
            for _ in range(edits):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            assert label in {s[0] for s in finder.fuzzy("lorem ipsum " + "".join(x) + " dolor")}


def test_rows(spark):
    rows = [(1, None, "x", 1), (1, "MIT License", None, None), (None, "", "x", 1), (2, "MIT License", "x", 1), (2, "MIT License", "x", 1)]
    got = licences.scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.labels, r.score) for r in got) == [("1", "", 0.0), ("1", "mit", 1.0), ("2", "mit", 1.0), ("2", "mit", 1.0), ("None", "", 0.0)]
    assert licences.scan_licences(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = licences.op6_fuzzy_notices(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        words, found = slow_base(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(found), ",".join(sorted({x for _, x in found})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_a_megabyte_of_places_takes_time_in_proportion(finder):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        got = finder.scan("mit license " * n)
        took.append(time.process_time() - began)
        assert got["n_base"] == n and got["last_word"] == 2 * n - 2
    assert took[1] < 8 * took[0] + 1  # 16 times if it were quadratic
    got = finder.scan("lorem licensed under the apache license version 2 0 " * 20_000)
    assert len(got["spans"]) == 20_000 and got["spans"][-1]["first_word"] == 9 * 19_999 + 1


def test_notices_begin_and_end_with_words(finder):
    got = finder.scan("unreleased under the mit licenses")
    assert all(x["notice"].split()[0] in ("unreleased", "under") and not x["notice"].endswith("license") for x in got["spans"])
