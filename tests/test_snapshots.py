"""Catalogues as snapshots: losses between the steps, two writers, older versions."""

from __future__ import annotations

import pytest

from kerege import snapshots as N
from kerege.operators import catalogue as C
from kerege.operators import validation as V


@pytest.fixture
def path(spark, tmp_path):
    where = f"file://{tmp_path}/catalogue"
    assert N.latest(spark, where) == 0 and N.history(spark, where).collect() == []
    assert N.commit(C.catalogue(spark), where, 0, "create", list(C.fixed.CATALOGUE)) == 1
    return where


def codes(df):
    return {r.code for r in df.collect()}


def new(spark, code="VAT001"):
    return spark.createDataFrame([(code, "WARN", "t", "", ""), ("BIN001", "WARN", "t", "", "")], C.SCHEMA)


def test_changes_and_older_versions(spark, path):
    assert N.change(spark, path, "add", lambda rows: C.with_rules(rows, new(spark))) == 2
    assert N.change(spark, path, "remove", lambda rows: C.without_rules(rows, ["D001", "NONE"])) == 3
    assert N.change(spark, path, "remove", lambda rows: C.without_rules(rows, ["NONE"])) == 4
    every = set(C.fixed.CATALOGUE)
    assert codes(N.read(spark, path)) == codes(N.read(spark, path, 3)) == (every | {"VAT001"}) - {"D001"}
    assert codes(N.read(spark, path, 2)) == every | {"VAT001"} and codes(N.read(spark, path, 1)) == every
    assert [tuple(r) for r in N.audit(spark, path).where("version > 1").collect()] == [(2, "ADD VAT001"), (3, "REMOVE D001")]
    with pytest.raises(ValueError, match="no version 9"):
        N.read(spark, path, 9)
    assert N.vacuum(spark, path, 2) == 2 and codes(N.read(spark, path, 3)) == codes(N.read(spark, path)) and N.latest(spark, path) == 4
    with pytest.raises(ValueError, match="no version 1"):
        N.read(spark, path, 1)


def test_a_loss_before_the_manifest_changes_nothing(spark, path, monkeypatch):
    before = codes(N.read(spark, path))
    with monkeypatch.context() as m:
        m.setattr(N, "_placed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            N.change(spark, path, "remove", lambda rows: C.without_rules(rows, ["D001"]))
    assert N.latest(spark, path) == 1 and codes(N.read(spark, path)) == before and N.audit(spark, path).where("version > 1").collect() == []
    assert N.change(spark, path, "remove", lambda rows: C.without_rules(rows, ["D001"])) == 2
    assert N.vacuum(spark, path, 2) == 1  # the snapshot that nothing refers to


def test_a_loss_within_the_rows_changes_nothing(spark, path):
    from pyspark.sql import functions as F

    broken = lambda rows: rows.withColumn("level", F.when(F.col("code") == "D001", F.raise_error(F.lit("torn"))).otherwise(F.col("level")))
    with pytest.raises(Exception, match="torn"):
        N.commit(broken(N.read(spark, path)), path, 1, "add", ["D001"])
    assert N.latest(spark, path) == 1 and codes(N.read(spark, path)) == set(C.fixed.CATALOGUE)


def test_of_two_writers_one_wins(spark, path):
    one, two = (C.with_rules(N.read(spark, path, 1), new(spark, c)) for c in ("ONE001", "TWO001"))
    assert N.commit(one, path, 1, "add", ["ONE001"]) == 2
    with pytest.raises(N.Conflict):
        N.commit(two, path, 1, "add", ["TWO001"])
    # a writer that was overtaken after it had looked: the rename finds the number taken
    with pytest.raises(N.Conflict, match="another writer"):
        N._placed(spark, path, 2, {"version": 2})
    assert "ONE001" in codes(N.read(spark, path)) and "TWO001" not in codes(N.read(spark, path)) and N.history(spark, path).count() == 2


def test_an_overtaken_change_is_made_again(spark, path):
    first = [True]

    def change(rows):
        if first.pop() if first else False:  # another writer comes in between
            N.change(spark, path, "add", lambda r: C.with_rules(r, new(spark, "ONE001")))
        return C.with_rules(rows, new(spark, "TWO001"))

    assert N.change(spark, path, "add", change) == 3
    assert {"ONE001", "TWO001"} <= codes(N.read(spark, path))


def test_results_as_of_a_version(spark, path):
    N.change(spark, path, "change", lambda rows: C.without_rules(rows, ["D000"]).unionByName(spark.createDataFrame([("D000", "INFO", "Kein Datum", "", "")], C.SCHEMA)))
    found = C.coded(V.checked(spark.createDataFrame([(1, {}, None)], "doc_id long, fields map<string,string>, raw_text string"), "2025-01-01"))
    both = C.as_version(N.read(spark, path, 1), "1").unionByName(C.as_version(N.read(spark, path), "2"))
    levels = {r.version: r.level for r in C.described(found, both, ("1", "2")).where("code = 'D000'").collect()}
    assert levels == {"1": "ERROR", "2": "INFO"}
