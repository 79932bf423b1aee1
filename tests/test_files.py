"""Sources, settings, sinks and arrivals, on files that the tests make."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kerege import settings, sinks
from kerege.functions import scalars as S
from kerege.functions.text_layer import compatible
from kerege.operators import catalogue as C
from kerege.operators import reports as R
from kerege.operators import validation as V
from kerege.plans import queries as Q
from kerege.sources import files
from kerege.streaming import arrivals

GOOD = {"supplier_BIN": "123456789012", "recipient_BIN": "210987654321", "date_issue": "2024-05-01", "total_amount": 100.5, "lines": [{"n": 1}]}
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, cells):
    """A small spreadsheet whose second sheet is the active one; cells: {place: (kind, value, style)}."""
    rows = "".join(f'<c r="{at}" t="{kind}" s="{style}">' + (f"<is><t>{v}</t></is>" if kind == "inlineStr" else f"<v>{v}</v>") + "</c>" for at, (kind, v, style) in cells.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_NS}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {_NS}><sheetData><row><c r="A1"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {_NS}><sheetData><row>{rows}</row></sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}><si><t>БИН поставщика</t></si><si><r><t>Всего </t></r><r><t>с НДС</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {_NS}><numFmts><numFmt numFmtId="170" formatCode="dd\\.mm\\.yyyy"/><numFmt numFmtId="171" formatCode="0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in" / "deep"
    at.mkdir(parents=True)
    (at / "good.JSON").write_text(json.dumps(GOOD), encoding="utf-8")
    (at / "list.json").write_text("[1]", encoding="utf-8")
    (at / "broken.json").write_text("{", encoding="utf-8")
    (at / "error.json").write_text('{"error": "нет"}', encoding="utf-8")
    (at / "note.txt").write_text("x", encoding="utf-8")
    (at / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    (at / "bad.pdf").write_bytes(b"nothing")
    workbook(at / "sheet.xlsx", {"A5": ("inlineStr", "Дата выписки", 0), "B5": ("n", "45413", 2), "A10": ("s", "0", 0), "C10": ("str", "123456789012", 0), "A17": ("inlineStr", "БИН покупателя", 0), "B17": ("n", "210987654321", 0), "A41": ("s", "1", 0), "AB41": ("n", "7", 0), "B41": ("n", "1000.5", 3)})
    workbook(at / "empty.xlsx", {})
    return str(tmp_path / "in")


def test_all_kinds_of_files(spark, folder):
    good, bad = files.documents(files.listed(spark, folder))
    found = {r.doc_id.rsplit("/", 1)[1]: r for r in good.collect()}
    wrong = {r.doc_id.rsplit("/", 1)[1]: r.error for r in bad.collect()}
    assert set(found) == {"good.JSON", "list.json", "sheet.xlsx", "empty.xlsx"}
    assert set(wrong) == {"broken.json", "error.json", "note.txt", "old.xls", "bad.pdf"}
    assert wrong["note.txt"] == "Неподдерживаемый формат .txt" and wrong["error.json"] == "нет" and wrong["broken.json"] == "JSON"
    assert found["good.JSON"].fields["total_amount"] == "100.5" and found["good.JSON"].fields["lines"] == '[{"n":1}]' and found["list.json"].fields == {}
    assert found["sheet.xlsx"].fields == {"supplier_bin": "123456789012", "buyer_bin": "210987654321", "issue_date": "2024-05-01", "total_gross": "1000.5", "total_amount": "1000.5"}
    levels = {(r.doc_id.rsplit("/", 1)[1], r.code): r.level for r in V.results(V.checked(good, "2025-01-01")).where("code in ('BIN001', 'D000', 'TOT001')").collect()}
    assert {levels["sheet.xlsx", c] for c in ("BIN001", "D000", "TOT001")} == {"OK"} and levels["empty.xlsx", "BIN001"] == "ERROR"


def test_cells_of_the_active_sheet(tmp_path):
    workbook(tmp_path / "a.xlsx", {"A1": ("s", "1", 0), "B1": ("n", "60.25", 1), "AA2": ("b", "1", 0)})
    assert list(files.sheet_cells((tmp_path / "a.xlsx").read_bytes())) == [(1, 1, "Всего с НДС"), (1, 2, "1900-02-28"), (2, 27, "1")]


def test_pdf_text_to_documents(spark):
    text = "БИН поставщика: 123456789012\nБИН покупателя 210987654321\nДата выписки: 01 . 05 . 2024\n•Итого с НДС: 1 000,50 KZT"
    got = files.pdf_documents(spark.createDataFrame([("a", text), ("b", None)], "doc_id string, text string")).collect()
    assert got[0].fields == {"supplier_BIN": "123456789012", "recipient_BIN": "210987654321", "date_issue": "01.05.2024", "total_amount": "1000.50"}
    assert got[1].raw_text == "" and set(got[1].fields.values()) == {""}
    assert compatible("ﬁ①\xa0x") == "fi1 x"


def test_templates(spark):
    rows = spark.createDataFrame([('{"esf_template": {"a": 1}}',), ('{"a": "x"}',), ("no",)], "t string")
    assert [r[0] for r in rows.select(files.template(F.col("t"))).collect()] == [{"a": "1"}, {"a": "x"}, None]


def test_settings(tmp_path):
    (tmp_path / "list.json").write_text("[]")
    told = {"rule_priority": {"D000": 0}, "bin_rules": {"allow_equal_bins": True, "bin_checksum_enabled": False}, "totals": {"labels": ["Сумма"], "max_gap": 30, "prefer_total": "NET"}, "header_fuzzy_threshold": 0.9, "sections": {"prefer_esf_section": False}, "groups": {"X": {"title": "T", "order": 3, "prefixes": ["B"]}}, "group_priorities": {"X": ["BIN002"]}, "mode": "expert", "strict_bin": {"enabled": True}}
    (tmp_path / "told.json").write_text(json.dumps(told))
    got = settings.load(str(tmp_path / "none.json"), str(tmp_path / "list.json"), str(tmp_path / "told.json"))
    assert (got.priority, got.allow_equal_bins, got.checksum, got.max_gap, got.prefer_total, got.header_share, got.prefer_section, got.details) == ({"D000": 0}, True, False, 30, "net", 0.9, False, True)
    assert got.total_labels[0] == "Сумма" and got.group_prefixes == {"X": ["B"]} and got.group_best == {"X": ["BIN002"]} and got.group_titles == {"X": "T"}
    assert settings.load(str(tmp_path / "none.json")) == settings.Settings()


def test_settings_change_what_is_found(spark):
    text = "СЧЕТ-ФАКТУРА № 1\nСумма: 200 000,00\nАкт\nИтого: 50,00"
    docs = spark.createDataFrame([(1, {"supplier_BIN": "1", "recipient_BIN": "1"}, text)], "doc_id long, fields map<string,string>, raw_text string")
    total = lambda **a: {r.code: (r.level, r.value) for r in V.results(V.checked(docs, "2025-01-01", settings=settings.Settings(**a))).collect()}
    assert total()["TOT001"] == ("OK", "50,00") and total()["BIN007"][0] == "WARN"
    got = total(total_labels=("Сумма",), allow_equal_bins=True)
    assert got["TOT001"] == ("OK", "200 000,00") and got["BIN007"][0] == "OK"


def test_registered_rules_and_catalogue_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, {}, None)], "doc_id long, fields map<string,string>, raw_text string")
    V.register_rule("NEW001", lambda as_of: F.when(F.col("supplier") == "", V._item("NEW001", "INFO", "t")))
    try:
        assert "NEW001" in {r.code for r in V.results(V.checked(docs, "2025-01-01")).collect()}
    finally:
        del V.RULES["NEW001"]
    (tmp_path / "c.json").write_text(json.dumps({"rules": {"A001": {"level": "WARN", "user": {"title": "t", "description": "d", "recommendation": "r"}}}}))
    (tmp_path / "bad.json").write_text("{")
    assert C.read_catalogue(spark, str(tmp_path / "c.json")).collect() == [("A001", "WARN", "t", "d", "r")]
    assert C.read_catalogue(spark, str(tmp_path / "bad.json")).collect() == []


def test_human_sizes(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 5 << 20, 7 << 30, 3 << 40, 5 << 50)], "n long")
    assert [r[0] for r in rows.select(S.human_size(F.col("n"))).collect()] == ["0 Б", "1023 Б", "1 КБ", "5 МБ", "7 ГБ", "3 ТБ", "5120 ТБ"]


def test_sinks(spark, tmp_path, sf):
    results = spark.createDataFrame([(1, 0, "BIN001", "ERROR", "м"), (1, 1, "D000", "OK", "н"), (2, 0, "D000", "OK", "к")], "doc_id long, ord int, code string, level string, message string")
    for _ in range(2):
        sinks.append_log(results.where("doc_id = 1 and ord = 0"), str(tmp_path / "log"), "2025-01-01 00:00:00")
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["[2025-01-01 00:00:00] [ERROR] [BIN001] м"] * 2
    sinks.write_reports(R.report_text(R.report_lines(results)), str(tmp_path / "reports"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "reports")).collect()]
    long, short = "—" * 90, "—" * 60
    for part in (["❌ Нужны исправления: 1 категорий с ошибками (BIN)", long, "Идентификаторы контрагентов", "✖ Ошибка: м", short, "Даты документа", "☑ ОК: н", short, "✅ ОК: 1   ⚠ Предупреждения: 0   ❌ Ошибки: 1"], ["✅ Чики-пыки: критичных ошибок нет.", long, "Даты документа", "☑ ОК: к", short, "✅ ОК: 1   ⚠ Предупреждения: 0   ❌ Ошибки: 0"]):
        at = lines.index(part[0])
        assert lines[at : at + len(part)] == part
    truth = Q.mutation_truth(spark, sf)
    sinks.write_csv(truth, str(tmp_path / "truth"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "truth")).count() == truth.count()
    sinks.write_json(spark.createDataFrame([(1, None, "ж")], "a long, b string, c string"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"a":1,"b":null,"c":"ж"}'
    rules = C.catalogue(spark)
    new = spark.createDataFrame([("VAT001", "WARN", "t", "", ""), ("BIN001", "WARN", "t", "", "")], C.SCHEMA)
    now = sinks.rewrite_catalogue(rules, str(tmp_path / "cat"), "v1", "add", ["VAT001", "BIN001"], new)
    assert now.count() == rules.count() + 1
    then = sinks.rewrite_catalogue(now, str(tmp_path / "cat"), "v2", "remove", ["VAT001", "NONE"])
    assert then.count() == rules.count() and spark.read.parquet(str(tmp_path / "cat/backup-v2")).count() == now.count()
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "cat/audit")).collect()) == ["ADD VAT001", "REMOVE VAT001"]


def test_arrivals(spark, folder, tmp_path):
    stream = arrivals.arriving(spark, folder, per_batch=4)
    arrivals.check_arrivals(stream, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "check"), "2025-01-01").awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("doc_id").distinct().count() == 4 and spark.read.parquet(str(tmp_path / "bad")).count() == 5
    query = arrivals.checked_json(arrivals.arriving(spark, folder), "2025-01-01").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("arrived").select("doc_id").distinct().count() == 2


def test_prefix_groups_and_best_items(spark):
    results = spark.createDataFrame([(1, 0, "BIN001", "ERROR", "a"), (1, 1, "BIN012", "ERROR", "b"), (1, 2, "XYZ", "OK", "c"), (1, 3, "TOT001", "OK", "d")], "doc_id long, ord int, code string, level string, message string")
    got = {r.group_key: (r.code, r.place, r.n_items) for r in R.group_report(results, {"B": ["bin"], "T": ["T", "X"]}, {"B": 0}, {"B": ["BIN012"]}).collect()}
    assert got == {"B": ("BIN012", 0, 2), "T": ("XYZ", 9999, 2)}
