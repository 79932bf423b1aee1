"""Invoice files: JSON, XML, spreadsheets and PDF, told apart by their suffix; what can't be read becomes a reject.

Files are listed and read by Spark's own readers, so any store that Spark reaches will do. Spreadsheets are zip archives of
XML and PDF a binary format: both are taken apart in Arrow batches, one file at a time.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerege.functions.text_layer import compatible
from kerege.operators.cells import sheet_documents
from kerege.operators.text_facts import pdf_bins, pdf_date, pdf_layer, pdf_total
from kerege.settings import Settings
from kerege.shipping import ship_package
from kerege.sources.pdf_layer import page_texts
from kerege.sources.workbooks import Workbook, register
from kerege.sources.xml_files import xml_documents, xml_text

#: Fixed value: what is said of other formats.
UNSUPPORTED = "Неподдерживаемый формат "
FIELDS = "map<string,string>"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix (lower case, with its point), kind (json, sheet, pdf, xml, null for others), content of all files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return kinds(files)


def kinds(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(suffix == ".json", "json").when(suffix.isin(".xlsx", ".xls"), "sheet").when(suffix == ".pdf", "pdf").when(suffix == ".xml", "xml")
    return files.select("path", suffix.alias("suffix"), kind.alias("kind"), "content")


def json_fields(text: Column) -> Column:
    """The object in a text as a map of texts (inner objects and lists as JSON); an empty map for other JSON values, null for what isn't JSON."""
    whole = F.trim(text)
    valid = F.call_function("try_parse_json", whole).isNotNull()
    return F.when(valid, F.when(whole.startswith("{"), F.from_json(whole, FIELDS)).otherwise(F.create_map().cast(FIELDS)))


def json_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, fields, raw_text) and rejects (doc_id, error) from (doc_id, text): objects with a key "error" are rejected by what it says."""
    rows = texts.select("doc_id", json_fields(F.col("text")).alias("fields"))
    error = F.when(F.col("fields").isNull(), "JSON").when(F.map_contains_key("fields", F.lit("error")), F.coalesce(F.try_element_at("fields", F.lit("error")), F.lit("")))
    told = rows.withColumn("error", error)
    good = told.where("error is null").select("doc_id", "fields", F.try_element_at("fields", F.lit("raw_text")).alias("raw_text"))
    return good, told.where("error is not null").select("doc_id", "error")


def sheet_cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the active sheet's filled cells."""
    yield from Workbook(io.BytesIO(content)).cells()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "r", "c", "v", "error"])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                cells = list(sheet_cells(content.as_py() or b""))  # whole, as a file with a fault has no cells
                rows = [(path, r, c, v, None) for r, c, v in cells] or [(path, None, None, None, "")]
            except Exception as told:  # whatever is wrong with one file is said of it, and the others go on
                rows = [(path, None, None, None, f"{type(told).__name__}: {told}")]
            for k in range(0, len(rows), 10_000):
                yield made(rows[k : k + 10_000])


def xlsx_cells(files: DataFrame) -> DataFrame:
    """doc_id, r, c, v, error from (path, content): a row for each filled cell; a file without any has one row with null places and what is wrong ("" if nothing)."""
    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(_cells, "doc_id string, r int, c int, v string, error string")


def sheet_files(spark: SparkSession, path: str, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, fields, raw_text) and rejects (doc_id, error) of the spreadsheets below path, which tasks open where they lie; doc_id is the path. Sheets without any cell have neither."""
    register(spark)
    cells = spark.read.format("xlsx_cells").load(path)
    # a file that broke off has cells before its fault, but is a reject
    bad = cells.where("error is not null").select(F.col("path").alias("doc_id"), "error")
    whole = cells.where("error is null").select(F.col("path").alias("doc_id"), "r", "c", "v").join(bad.select("doc_id"), "doc_id", "left_anti")
    return sheet_documents(whole, settings), bad


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                found = page_texts(content.as_py() or b"")
                rows = [(path, k + 1, None if t is None else compatible(t), "page" if t is None else None) for k, t in enumerate(found)] or [(path, None, None, None)]
            except Exception as told:  # whatever is wrong with one file is said of it, and the others go on
                rows = [(path, None, None, f"{type(told).__name__}: {told}")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "page", "text", "error"])


def pdf_pages(files: DataFrame) -> DataFrame:
    """doc_id, page, text, error from (path, content): a row for each page, its text in compatibility form (NFKC), white space as it was; error is "page" for one that can't be read.

    A file that can't be read has one row without page that says why, one without pages has a row without page and error.
    """
    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(_pages, "doc_id string, page int, text string, error string")


def pdf_texts(files: DataFrame) -> DataFrame:
    """doc_id, text, error from (path, content): all pages' text, one line end apart; pages that can't be read are left out."""
    rows = pdf_pages(files).groupBy("doc_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page", "text")))), lambda x: x["text"]), "\n")
    rows = rows.agg(text.alias("text"), F.max(F.when(F.col("page").isNull(), F.col("error"))).alias("error"))
    return rows.select("doc_id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def pdf_documents(texts: DataFrame) -> DataFrame:
    """Documents (doc_id, fields, raw_text) from PDF texts (doc_id, text)."""
    rows = texts.select("doc_id", pdf_layer(F.coalesce("text", F.lit(""))).alias("raw_text"))
    t = F.col("raw_text")
    supplier, buyer = pdf_bins(t)
    names = {"supplier_BIN": supplier, "recipient_BIN": buyer, "date_issue": pdf_date(t), "total_amount": pdf_total(t)}
    return rows.select("doc_id", F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)]).alias("fields"), "raw_text")


def documents(files: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, fields, raw_text) and rejects (doc_id, error) of files as kinds() gives them; doc_id is the path."""
    said = files.where("kind is null").select(F.col("path").alias("doc_id"), F.concat(F.lit(UNSUPPORTED), "suffix").alias("error"))
    told, bad = json_documents(files.where("kind = 'json'").select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text")))
    cells = xlsx_cells(files.where("kind = 'sheet'"))
    sheets = sheet_documents(cells.where("error is null").select("doc_id", "r", "c", "v"), settings)
    empty = cells.where("error = ''").select("doc_id", F.create_map().cast(FIELDS).alias("fields"), F.lit(None).cast("string").alias("raw_text"))
    texts = pdf_texts(files.where("kind = 'pdf'"))
    marked, broken = xml_documents(files.where("kind = 'xml'").select(F.col("path").alias("doc_id"), xml_text(F.col("content")).alias("text")))
    good = told.unionByName(sheets).unionByName(empty).unionByName(pdf_documents(texts.where("error is null"))).unionByName(marked.drop("lines"))
    wrong = said.unionByName(bad).unionByName(broken)
    for part in (cells, texts):
        wrong = wrong.unionByName(part.where("error <> ''").select("doc_id", "error"))
    return good, wrong


def template(text: Column) -> Column:
    """A template's fields: those under esf_template, else the object's own."""
    fields = json_fields(text)
    return F.coalesce(F.from_json(F.try_element_at(fields, F.lit("esf_template")), FIELDS), fields)
