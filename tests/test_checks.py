"""Catalogues by version, added rules, rule functions, XML, templates and keywords, on small rows."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from kerege import sinks
from kerege.operators import catalogue as C
from kerege.operators import keywords as K
from kerege.operators import rule_functions as P
from kerege.operators import templates as M
from kerege.operators import validation as V
from kerege.sources import xml_files as X

DOCS = "doc_id long, fields map<string,string>, raw_text string"
ONE = {"supplier_BIN": "123456789012", "recipient_BIN": "", "date_issue": "2024-01-01", "total_amount": "5.5"}


@pytest.fixture(scope="module")
def items(spark):
    return V.checked(spark.createDataFrame([(1, ONE, None), (2, {}, None)], DOCS), "2025-01-01")


def told(rows):
    return {(r.doc_id, r.version, r.code): (r.level, r.message) for r in rows.collect()}


def test_the_built_in_catalogue_says_what_rules_say(spark, items):
    own = {(r.doc_id, r.ord, r.code, r.level, r.message, r.value) for r in V.results(items).collect()}
    got = C.described(C.coded(items), C.versions(spark), ("v2.7",))
    assert {(r.doc_id, r.ord, r.code, r.level, r.message, r.value) for r in got.collect()} == own


def test_a_changed_catalogue_changes_results(spark, items, tmp_path):
    rules = C.catalogue(spark)
    now = sinks.rewrite_catalogue(rules, str(tmp_path), "x", "remove", ["BIN002"])
    now = C.with_rules(now, spark.createDataFrame([("BIN002", "warn", "Anders", "", "")], C.SCHEMA))
    both = C.described(C.coded(items), C.versions(spark).unionByName(C.as_version(now, "own")), ("own", "v2.7"))
    got = told(both)
    assert got[1, "own", "BIN002"] == ("WARN", "Anders [значение: ]") and got[1, "v2.7", "BIN002"][0] == "ERROR"
    assert got[1, "own", "D000"][0] == "OK" and got[1, "own", "BIN012"] == got[1, "v2.7", "BIN012"]
    alone = told(C.described(C.coded(items), C.as_version(now.where("code = 'BIN002'"), "own"), ("own",)))
    assert alone[1, "own", "TOT001"] == told(C.described(C.coded(items), C.versions(spark), ("v2.7",)))[1, "v2.7", "TOT001"]  # what it hasn't is the rule's own


def test_later_versions_inherit(spark):
    rows = [("a", "X", "ERROR", "one", "", "", None, None), ("c", "X", "WARN", "three", "", "", None, None), ("b", "Y", "INFO", "two", "", "", None, None), ("z", "Z", "INFO", "", "", "", None, None)]
    got = {(r.version, r.code): r.title for r in C.inherited(spark.createDataFrame(rows, C.VERSIONED), ("a", "b", "c")).collect()}
    assert got == {("a", "X"): "one", ("b", "X"): "one", ("c", "X"): "three", ("b", "Y"): "two", ("c", "Y"): "two"}


def test_catalogue_files_by_version(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": "v9", "rules": {"A": {"level": "WARN", "user": {"title": "t", "description": "d", "recommendation": "r", "ok": "fine"}}, "B": {"level": "ERROR", "user": {"title": "u"}, "ok_user": {"title": "good", "description": "yes"}}}}))
    (tmp_path / "b.json").write_text(json.dumps({"F001": {"level": "ERROR", "description": "x", "message": "m"}}))
    (tmp_path / "c.json").write_text("{")
    got = {(r.version, r.code): (r.level, r.title, r.ok, r.ok_description) for r in C.read_version(spark, str(tmp_path)).collect()}
    assert got == {("v9", "A"): ("WARN", "t", "fine", ""), ("v9", "B"): ("ERROR", "u", "good", "yes"), ("v1", "F001"): ("ERROR", "m", None, None)}


FAILING = {
    "cast": lambda day: F.when(F.col("supplier").cast("int") > 0, V._item("X", "OK", "t")),
    "index": lambda day: V._item("X", "OK", "t", value=F.array(F.lit("a"))[F.length("supplier")]),
    "division": lambda day: F.when((F.lit(1) / F.length("buyer")) > 5, V._item("X", "OK", "t")),
    "raised": lambda day: F.when(F.raise_error(F.lit("no")).isNull(), V._item("X", "OK", "t")),
    "date": lambda day: F.when(F.to_date("date", "dd.MM.yyyy") > day, V._item("X", "OK", "t")),
}


@pytest.mark.parametrize("name", sorted(FAILING))
def test_a_rule_that_fails_leaves_the_others(spark, name):
    docs = spark.createDataFrame([(1, ONE, None)], DOCS)
    before = [tuple(r) for r in V.results(V.checked(docs, "2025-01-01")).orderBy("ord").collect()]
    V.register_rule("BAD", FAILING[name])
    V.register_rule("TWICE", FAILING[name])  # shares its failing part with the other
    V.register_rule("FINE", lambda day: F.array(V._item("FINE", "INFO", "a"), F.lit(None), V._item("FINE", "INFO", "b", value=F.lit(""))), many=True)
    V.register_rule("NONE", lambda day: F.lit(None), many=True)
    try:
        rows = [tuple(r) for r in V.results(V.checked(docs, "2025-01-01")).orderBy("ord").collect()]
    finally:
        for rule in ("BAD", "TWICE", "FINE", "NONE"):
            V.unregister_rule(rule)
    added = [r for r in rows if r[2] in ("_rule_BAD", "_rule_TWICE", "FINE")]
    assert [(r[2], r[3], r[5]) for r in added] == [("FINE", "INFO", None), ("FINE", "INFO", ""), ("_rule_BAD", "ERROR", None), ("_rule_TWICE", "ERROR", None)]
    assert [r[2:] for r in rows if r not in added] == [r[2:] for r in before]
    assert [tuple(r) for r in V.results(V.checked(docs, "2025-01-01")).orderBy("ord").collect()] == before


def test_an_added_rule_in_place_of_a_built_in_one(spark):
    docs = spark.createDataFrame([(1, ONE, None)], DOCS)
    V.register_rule("BIN002", lambda day: F.lit(None))
    try:
        assert "BIN002" not in {r.code for r in V.results(V.checked(docs, "2025-01-01")).collect()}
    finally:
        V.unregister_rule("BIN002")
    assert "BIN002" in {r.code for r in V.results(V.checked(docs, "2025-01-01")).collect()}


def test_built_in_rules_need_no_python(spark):
    docs = spark.createDataFrame([(1, ONE, None)], DOCS)
    assert "Python" not in V.results(V.checked(docs))._jdf.queryExecution().executedPlan().toString()


def test_rule_functions(spark):
    def rule(fields):
        if fields.get("a") == "many":
            return [{"code": "M", "value": k} for k in range(3)]
        if fields.get("a") == "bad item":
            return [{"code": "M"}, 7]
        return {"code": "ONE", "level": "WARN", "title": "t", "value": None} if int(fields["a"]) else None

    P.register_rule_function(spark, "some_rule", rule)
    docs = spark.createDataFrame([(1, {"a": "many"}), (2, {"a": "1"}), (3, {"a": "0"}), (4, {"a": "x"}), (5, {}), (6, None), (7, {"a": "bad item"})], "doc_id long, fields map<string,string>")
    got = sorted((r.doc_id, r.code, r.level, r.value) for r in P.lateral_items(docs, ["some_rule"]).collect())
    broken = [(k, "_rule_some_rule", "ERROR", None) for k in (4, 5, 6, 7)]
    assert got == [(1, "M", "INFO", "0"), (1, "M", "INFO", "1"), (1, "M", "INFO", "2"), (2, "ONE", "WARN", None), *broken]
    docs.createOrReplaceTempView("some_docs")
    rows = spark.sql("select d.doc_id, r.description from some_docs d, lateral some_rule(d.fields) r where r.code like '_rule%' and d.doc_id = 4").collect()
    assert rows == [(4, "_rule_some_rule: invalid literal for int() with base 10: 'x'")]
    assert P.lateral_items(docs, []).collect() == []


def test_xml_forms(spark):
    texts = {
        1: '<?xml version="1.0"?>\n<!-- a --><x:doc xmlns:x="u" id="7"><x:a>007</x:a><b> q </b><b>last</b><c/><s><a>1</a><d>0.50</d></s><t><d>2</d><e>3</e></t></x:doc>',
        2: "<doc/>", 3: "<doc></doc>", 4: "<a>1</a><b>2</b>", 5: "<a><b></a></b>", 6: None, 7: "", 8: "text", 9: "<a>&no;</a>", 10: "<a><b>1</b>", 11: "<Док><БИН>1</БИН></Док>",
        12: "<d><lines><line><line_no>5</line_no><name>A &amp; B</name><qty>x</qty><amount>1.5</amount></line><line><name>c</name></line></lines></d>",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.fields for r in X.parsed(rows).collect()}
    assert got[1] == {"_id": "7", "_xmlns:x": "u", "a": "007", "b": "last", "c": "", "d": "0.50", "e": "3"}
    assert got[2] == got[3] == got[12] == {} and got[11] == {"БИН": "1"}
    good, bad = X.xml_documents(rows)
    assert {r.doc_id for r in bad.collect()} == {4, 5, 6, 7, 8, 9, 10} == {k for k, v in got.items() if v is None}
    assert [tuple(r) for r in X.lines(good).orderBy("line_no").collect()] == [(12, 2, "c", None, None, None, None, None, None), (12, 5, "A & B", None, None, None, 1.5, None, None)]
    assert {r.doc_id: r["items"][0].level for r in X.xml_items(rows).collect()} == {k: "OK" if k in (1, 2, 3, 11, 12) else "ERROR" for k in texts}


def test_xml_encodings(spark):
    text = '<?xml version="1.0" encoding="{}"?><a><б>жЁ№</б></a>'
    rows = [(1, text.format("UTF-8").encode()), (2, text.format("windows-1251").encode("cp1251")), (3, text.format("UTF-16").encode("utf-16")), (4, b"\xef\xbb\xbf" + text.format("utf-8").encode())]
    texts = spark.createDataFrame(rows, "doc_id long, content binary").select("doc_id", X.xml_text(F.col("content")).alias("text"))
    assert {r.doc_id: r.fields for r in X.parsed(texts).collect()} == {k: {"б": "жЁ№"} for k in (1, 2, 3, 4)}


def best_run(places):
    """The longest increasing subsequence by trying all, of equally long ones that of the smallest indexes."""
    there = [i for i, p in enumerate(places) if p]
    for n in range(len(there), 0, -1):
        fits = [c for c in itertools.combinations(there, n) if all(places[a] < places[b] for a, b in itertools.pairwise(c))]
        if fits:
            return list(min(fits))
    return []


def test_longest_runs(spark):
    rng = random.Random(3)
    rows = [[rng.choice([0, *range(1, 12)]) for _ in range(rng.randrange(9))] for _ in range(300)] + [[], [0], [1, 2, 3], [3, 2, 1], [5, 5, 5]]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, places array<int>")
    got = {r.k: r.run for r in frame.select("k", M.longest_run(F.col("places")).alias("run")).collect()}
    assert got == {k: best_run(r) for k, r in enumerate(rows)}


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"esf_template": {"metadata": {"document": "A"}, "required_sections": ["S", "S(1)"], "key_fields": {"n": {"pattern": "(?i)№\\s*\\d+"}}, "optional_fields": {"o": {"pattern": "zz", "required": False}}, "validation_rules": [{"name": "section_sequence_check", "enabled": True}, {"name": "signature_check", "enabled": False}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"metadata": {"document": "B"}, "key_fields": {}}))
    (tmp_path / "c.json").write_text("[")
    told = M.read_templates(spark, str(tmp_path))
    rows = {r.template: r for r in told.collect()}
    assert set(rows) == {"A", "B"} and rows["A"].fields == [("n", "(?i)№\\s*\\d+", True), ("o", "zz", False)] and rows["B"].fields == []
    docs = M.with_template(spark.createDataFrame([(1, "A", "S(1) then S and № 7, № 8"), (2, "A", None), (3, "B", "x"), (4, "none", "x")], "doc_id long, template string, text string"), told)
    assert {(r.doc_id, r.field): (r.value, r.n_found, r.level) for r in M.template_fields(docs).collect()} == {(1, "n"): ("№ 7", 2, "OK"), (1, "o"): (None, 0, "INFO"), (2, "n"): (None, 0, "ERROR"), (2, "o"): (None, 0, "INFO")}
    # "S" is first found inside of "S(1)", as words go, so both stand at the same place
    assert {r.doc_id: (r.missing, r.misplaced, r.in_order) for r in M.section_order(docs).collect()} == {1: ([], ["S(1)"], False), 2: (["S", "S(1)"], [], False), 3: ([], [], True)}
    assert {(r.doc_id, r.check): r.passed for r in M.template_checks(docs).collect()} == {(1, "section_sequence_check"): False, (2, "section_sequence_check"): False}


def test_keywords_of_several_words(spark):
    words = spark.createDataFrame([("x", "a", "One two"), ("x", "a", "one  two!"), ("x", "b", "two"), ("y", "b", "two one two"), ("y", "c", "..."), ("y", "c", "ÉTÉ")], "language string, role string, keyword string")
    docs = spark.createDataFrame([(1, "one two one TWO"), (2, None), (3, "two, one. two"), (4, "l'été one")], "doc_id long, text string")
    index = K.keyword_index(words)
    assert index.count() == 7
    places = sorted((r.doc_id, r.keyword, r.place) for r in K.keyword_places(docs, index).collect())
    assert places == [(1, "one two", 0), (1, "one two", 2), (1, "two", 1), (1, "two", 3), (1, "two one two", 1), (3, "one two", 1), (3, "two", 0), (3, "two", 2), (3, "two one two", 0), (4, "été", 1)]
    assert {(r.doc_id, r.language) for r in K.keyword_roles(docs, index).where("is_language").collect()} == {(1, "x"), (3, "x"), (4, "y")}
    told = {r.doc_id: (r.language, r.roles, r.is_invoice) for r in K.recognised(K.keyword_roles(docs, index), ("a", "b")).collect()}
    assert told == {1: ("x", ["a", "b"], True), 3: ("x", ["a", "b"], True), 4: ("y", ["c"], False)}


def test_keywords_in_a_row_as_by_groups(spark):
    """Votes that are counted inside of a document's row are those of grouped words, and their plan has no exchange or sort of rows."""
    words = spark.createDataFrame([("x", "a", "one two"), ("x", "a", "two"), ("x", "b", "two one two"), ("y", "a", "one"), ("y", "b", "one two"), ("z", "c", "three")], "language string, role string, keyword string")
    docs = spark.createDataFrame([(1, "one two one two"), (2, "two"), (3, None), (4, "three, ONE; two one"), (5, "two two one two two one two")], "doc_id long, text string")
    index = K.keyword_index(words)
    row = K.keyword_roles(docs, index)
    assert sorted(map(tuple, row.collect())) == sorted(map(tuple, K._by_groups(docs, index).collect()))
    plan = row._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "doc_id" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    assert K.keyword_roles(docs, index.where("false")).collect() == []


def test_places_of_sections_that_letters_touch(spark):
    """A name counts where it stands as words of its own, also behind places where it is a part of others."""
    rows = [("aB B aBc", ["B", "aB", "c", ""]), ("xB", ["B", "x"]), ("", ["B"]), ("B1 B-1 1B", ["B", "B1"]), ("A.B \\E A", ["A.B", "\\E A", "A"])]
    docs = spark.createDataFrame(rows, "text string, names array<string>")
    got = [r.p for r in docs.select(M.first_places(F.col("text"), F.col("names")).alias("p")).collect()]
    assert [p[:3] for p in got] == [[4, 1, 0], [0, 0], [0], [4, 1], [1, 5, 1]]


def test_xml_is_parsed_once(spark):
    from kerege.plans import checks

    plan = checks.xml_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count("from_xml(") <= 2, plan.count("xml")
