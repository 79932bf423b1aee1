"""Rules as compiled expressions: what stands in for slower functions gives the same, and no rule is evaluated below a lambda."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerege.functions import scalars as S
from kerege.operators import cells as X
from kerege.operators import validation as V


def test_trimmed_is_stripped(spark):
    texts = [None, "", " ", "a", " a", "a ", "я", "　я", "я ", "\x85x", "x\xa0", "a b", "№ 5", " x", "x\x7f", "€", "😀 ", "😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.trimmed(F.col("t")).alias("a"), S.stripped(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_date_text_is_date_found(spark):
    texts = [None, "", "2020-02-29", "2021-02-29", "2025-13-99", "0000-01-01", "1999-01-01\n", " 1999-01-01", "2020-1-2", "01.02.2003", "от 5 мая 2001 г.", "2020-02-30 или 01.02.2003"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_date_text(F.col("t")).cast("string").alias("a"), S.parse_date_found(F.col("t")).cast("string").alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_rules_are_not_below_a_lambda(spark):
    docs = spark.createDataFrame([(1, {"supplier_BIN": "123456789012", "total_amount": " 5,50 "})], "doc_id long, fields map<string,string>")
    plan = V.checked(docs, "1999-01-01")._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if " AS items#" in line]
    # a filter over the array of all items would have all rules interpreted
    assert made and not any("filter(" in line for line in made)


def test_later_keys_in_order(spark):
    fields = {"recipient_BIN": " ", "recipientBin": "", "Получатель": " 7 ", "buyer_bin": " ", "customerBin": "8", "Итог": "9", "total": " "}
    row = V.with_facts(V.with_texts(spark.createDataFrame([(1, fields), (2, None)], "doc_id long, fields map<string,string>"))).orderBy("doc_id").collect()
    assert (row[0].buyer, row[0].check_buyer, row[0].equal_buyer, row[0].total, row[0].supplier) == ("8", "8", "", "9", "")
    assert (row[1].buyer, row[1].total, row[1].date) == ("", "", "")


def test_keys_of_cells_are_made_once(spark):
    cells = spark.createDataFrame([(1, 1, 1, "БИН поставщика")], "doc_id long, r int, c int, v string")
    plan = X.labelled_bins(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)[^\\w\\s]+") == 1


def test_searches_are_made_once(spark):
    """Decoding and searching stand in the plan as often as they are needed: nullif and repeated columns had them evaluated again and again."""
    from pyspark.sql import functions as F

    from kerege.functions import scalars as S
    from kerege.operators import text_facts as T

    text = spark.createDataFrame([("Итого: 1 200,50 тг",), ("Ñ÷åò",), ("",), (None,)], "text string")
    plan = lambda c: text.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan(S.fix_mojibake(F.col("text"))).count("translate(") <= 4
    assert plan(T.text_bin(F.col("text"), ["БИН"])).count("regexp_extract(") == 1
    assert [r.x for r in text.select(S.fix_mojibake(F.col("text")).alias("x")).collect()] == ["Итого: 1 200,50 тг", "Счет", "", None]
    assert [r.x for r in text.select(T.preferred_total(F.col("text")).alias("x")).collect()] == [""] * 4


def test_cells_stay_where_their_documents_are(spark, sf):
    """Without broadcasts orders and lines are all that is shuffled: cells lie by document from then on."""
    import re

    from kerege.sources import invoices as I

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        plan = X.sheet_documents(I.cells(I.invoices(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    finally:
        for n in names:
            spark.conf.unset(n)
    moved = set(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan))
    assert moved and all(re.fullmatch(r"(o_orderkey|l_orderkey)#\d+L?, \d+", m) for m in moved), moved


def test_neighbours_against_all_pairs(spark):
    """Sheets with repeated, null and far cells: what meets is what a join on places has."""
    import random
    from collections import Counter

    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.randrange(-4, 9), rng.randrange(-4, 9), rng.choice(["a", "b", None]), rng.choice(["1", "2", "3", None])) for _ in range(150)]
    rows += [rows[0], (1, 10**6, 3, "a", "1"), (1, 10**6, 4, "b", None)]
    cells = spark.createDataFrame(rows, "doc_id long, r int, c int, x string, y string")
    offsets = [(0, 0), (0, 1), (-1, 0), (2, 1)]
    wanted, alone = Counter(), Counter()
    for d, r, c, x, _ in rows:
        for k, (dr, dc) in enumerate(offsets):
            found = [y for d2, r2, c2, _, y in rows if (d2, r2, c2) == (d, r + dr, c + dc) and y is not None] if x else []
            wanted.update((d, r, c, x, k, r + dr, c + dc, y) for y in found)
            alone.update([(d, r, c, x, k, r + dr, c + dc, None)] if x and not found else [])
    assert Counter(map(tuple, X.neighbours(cells, "x", "y", offsets).collect())) == wanted
    assert Counter(map(tuple, X.neighbours(cells, "x", "y", offsets, outer=True).collect())) == wanted + alone
    near = Counter()
    for d, r, c, x, _ in rows:
        near.update((d, r, c, x, r2, c2, y) for d2, r2, c2, _, y in rows if x and y and d2 == d and abs(r - r2) <= 3 and abs(c - c2) <= 3)
    got = X.around(cells, "x", "y", 3).select("doc_id", "r", "c", "x", F.explode("near").alias("n")).select("doc_id", "r", "c", "x", "n.*")
    assert Counter(map(tuple, got.collect())) == near
