"""The data source for spreadsheets, in batches and as a stream."""

from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F
from test_files import _NS, workbook

from kerege.sources import files
from kerege.sources import workbooks as W


@pytest.fixture
def folder(spark, tmp_path):
    W.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k in range(5):
        workbook(tmp_path / "in" / ("deep" if k % 2 else "") / f"b{k}.xlsx", {"A1": ("inlineStr", "Дата", 0), "B1": ("n", "45413", 2), "C7": ("n", str(k), 0)})
    (tmp_path / "in" / "bad.XLSX").write_bytes(b"no archive, " * 9)
    (tmp_path / "in" / "other.txt").write_bytes(b"no")
    return tmp_path / "in"


def plain(df):
    return sorted(((r.path.rsplit("/", 1)[1], r.sheet, r.r, r.c, r.v) for r in df.where("error is null").collect()))


def test_cells_of_a_folder(spark, folder):
    cells = spark.read.format("xlsx_cells").load(str(folder))
    assert plain(cells) == sorted(x for k in range(5) for x in ((f"b{k}.xlsx", "b", 1, 1, "Дата"), (f"b{k}.xlsx", "b", 1, 2, "2024-05-01"), (f"b{k}.xlsx", "b", 7, 3, str(k))))
    bad = cells.where("error is not null").collect()
    assert len(bad) == 1 and bad[0].path.endswith("bad.XLSX") and "BadZipFile" in bad[0].error
    assert plain(spark.read.format("xlsx_cells").load(f"file://{folder}")) == plain(cells)
    assert plain(spark.read.format("xlsx_cells").option("sheet", "*").load(str(folder / "b0.xlsx")))[0] == ("b0.xlsx", "a", 1, 1, "1")
    assert spark.read.format("xlsx_cells").option("sheet", "none").load(str(folder / "b0.xlsx")).collect() == []
    by_content = files.xlsx_cells(files.listed(spark, str(folder)).where("kind = 'sheet'")).where("error is null")
    assert sorted((r.doc_id.rsplit("/", 1)[1], "b", r.r, r.c, r.v) for r in by_content.collect()) == plain(cells)


def test_filters_decide_what_is_opened(spark, folder):
    cells = spark.read.format("xlsx_cells").option("sheet", "*").load(str(folder))
    one = cells.where(F.col("path").endswith("b1.xlsx") & (F.col("sheet") == "b") & (F.col("r") > 1))
    assert plain(one) == [("b1.xlsx", "b", 7, 3, "1")]
    reader = W.CellReader({"path": str(folder), "sheet": "*"})
    kept = list(reader.pushFilters([W.D.StringEndsWith(("path",), "b1.xlsx"), W.D.EqualTo(("sheet",), "b"), W.D.In(("c",), (3,)), W.D.IsNotNull(("v",))]))
    assert [type(f).__name__ for f in kept] == ["EqualTo", "In", "IsNotNull"]  # what isn't whole files Spark holds again
    shares = reader.partitions()
    assert [len(s.paths) for s in shares] == [1]
    assert [r for b in reader.read(shares[0]) for r in b.select(["r", "c", "v"]).to_pylist()] == [{"r": 7, "c": 3, "v": "1"}]


def test_shares_and_batches(monkeypatch, folder):
    monkeypatch.setattr(W, "FILES", 2)
    monkeypatch.setattr(W, "CELLS", 2)
    reader = W.CellReader({"path": str(folder)})
    shares = reader.partitions()
    assert sorted(len(s.paths) for s in shares) == [2, 2, 2]
    assert [b.num_rows for b in reader.read(W.Share([p for p in shares[2].paths]))] == [2, 2, 2]


def test_cells_without_places(tmp_path):
    path = tmp_path / "x.xlsx"
    workbook(path, {})
    rows = '<row r="3"><c><v>1</v></c><c r="D3"><v>2</v></c><c><v>3</v></c><c/></row><row><c t="inlineStr"><is><t>x</t></is></c></row>'
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/s2.xml"] = f"<worksheet {_NS}><sheetData>{rows}</sheetData></worksheet>".encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    assert list(files.sheet_cells(path.read_bytes())) == [(3, 1, "1"), (3, 4, "2"), (3, 5, "3"), (4, 1, "x")]


def test_documents_of_sheets(spark, folder):
    workbook(folder / "inv.xlsx", {"A10": ("s", "0", 0), "C10": ("str", "123456789012", 0), "A41": ("s", "1", 0), "B41": ("n", "1000.5", 3)})
    good, bad = files.sheet_files(spark, str(folder))
    found = {r.doc_id.rsplit("/", 1)[1]: r.fields for r in good.collect()}
    assert found["inv.xlsx"]["supplier_bin"] == "123456789012" and found["inv.xlsx"]["total_amount"] == "1000.5" and len(found) == 6
    assert [r.doc_id.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.XLSX"]


def test_a_stream_reads_each_file_once(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("xlsx_cells").load(str(folder)).where("error is null")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    first = plain(run())
    assert len(first) == 15
    workbook(folder / "late.xlsx", {"A1": ("n", "9", 0)})
    same = max(os.stat(folder / f"b{k}.xlsx").st_mtime_ns for k in (0, 2, 4))
    assert os.stat(folder / "late.xlsx").st_mtime_ns >= same
    assert plain(run()) == sorted([*first, ("late.xlsx", "b", 1, 1, "9")])
    assert len(plain(run())) == 16


def test_offsets_tell_files_of_one_time_apart(folder):
    stream = W.CellStream({"path": str(folder)})
    for p, _, _ in W._listed({"path": str(folder)}):
        os.utime(p.removeprefix("file://"), ns=(10**18, 10**18))
    end = stream.latestOffset()
    assert end["at"] == 10**18 and len(end["names"]) == 6
    some = {"at": end["at"], "names": end["names"][:4]}
    paths = lambda a, b: sorted(p for s in stream.partitions(a, b) for p in s.paths)
    assert paths(stream.initialOffset(), some) == end["names"][:4] and paths(some, end) == end["names"][4:] and paths(end, end) == []
