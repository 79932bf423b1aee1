"""Invoices as XML: any root, canonical fields and lines by the names of their elements, what isn't well formed as rejects with XML001.

Spark's own XML parser does the work. A document's root may have any name, so it is put in an element of a known one; its children are then read as
a map of texts, in which numbers keep their zeros. Elements in sections count like those of the root, which come first; of equal names the first section's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions.scalars import from_1251
from kerege.operators.validation import _Value, _item

FIELDS = "map<string,string>"
#: Elements of a line, by their own names.
LINE = "line_no int, name string, uom string, qty double, price double, amount double, vat_rate double, vat_amount double"
_KINDS = [x.split() for x in LINE.split(", ")]
#: Lines are read as texts first: a number that can't be read would else cost all lines.
_AS_TEXT = ", ".join(f"{n} string" for n, _ in _KINDS)
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
#: Declaration and comments, then the root from its first tag to its last, which must have the same name.
_NAME = r"(?:[\p{L}_][\p{L}\p{N}_.-]*:)?[\p{L}_][\p{L}\p{N}_.-]*"
_ROOT = rf"(?s)^\x{{FEFF}}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<({_NAME})((?:\s[^<>]*)?)(?:/>|>(.*)</\1\s*>)\s*(?:<!--.*?-->\s*)*$"
#: Elements without children inside a section.
_LEAF = rf"(?s)<({_NAME})(?:\s[^<>]*)?>([^<>]*)</\1>"


def xml_text(content: Column) -> Column:
    """A file's text by the encoding that its declaration names: windows-1251 and UTF-16 (by its mark), else UTF-8."""
    head = F.lower(F.decode(F.substring(content, 1, 200), "ISO-8859-1"))
    wide = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    old = head.rlike("""encoding\\s*=\\s*["'](?:windows-|cp)1251["']""")
    return F.when(wide, F.decode(content, "UTF-16")).when(old, from_1251(F.decode(content, "ISO-8859-1"))).otherwise(content.cast("string"))


def parsed(texts: DataFrame) -> DataFrame:
    """doc_id, fields, lines from (doc_id, text); fields is null for what isn't well-formed XML, and lines is empty without a list of them.

    Attributes of the root count as fields under their name behind an underscore, texts beside its children under _VALUE. An empty element is an empty
    text, of a repeated child the last one counts; an element of a section whose text holds < or > is left out. Numbers of lines that can't be read are null. A null text isn't XML.
    """
    wrapped = F.when(F.col("text").rlike(_ROOT), F.regexp_replace("text", _ROOT, "<d><r$2>$3</r></d>"))
    rows = texts.select("doc_id", wrapped.alias("x"))
    rows = rows.select("doc_id", F.from_xml("x", f"r {FIELDS}, _bad string", _OPTIONS).alias("told"), F.from_xml("x", f"r struct<lines:struct<line:array<struct<{_AS_TEXT}>>>>", _OPTIONS).alias("more"))
    outer = F.coalesce(F.col("told.r"), F.create_map().cast(FIELDS))
    section = lambda k, v: F.coalesce(v.contains("</"), F.lit(False))
    inner = F.concat_ws("", F.map_values(F.map_filter(outer, lambda k, v: (k != "lines") & section(k, v))))
    rows = rows.select(
        "doc_id",
        (F.col("told").isNotNull() & F.col("told._bad").isNull()).alias("well"),
        F.map_filter(outer, lambda k, v: (k != "lines") & ~section(k, v)).alias("own"),
        F.regexp_replace(inner, "(</?)[^:<>\\s]+:", "$1").alias("inner"),
        F.transform(F.coalesce("more.r.lines.line", F.array()), lambda x: F.struct(*[F.trim(x[n]).try_cast(kind).alias(n) for n, kind in _KINDS])).alias("lines"),
    )
    names, values = (F.regexp_extract_all("inner", F.lit(_LEAF), F.lit(g)) for g in (1, 2))
    rows = rows.withColumns({"names": names, "pairs": F.arrays_zip(names.alias("k"), F.transform(values, lambda v: F.trim(v)).alias("v"))})
    first = F.filter("pairs", lambda x, i: (F.array_position("names", x["k"]) == i + 1) & ~F.map_contains_key("own", x["k"]))
    fields = F.map_concat("own", F.map_from_entries(first))
    return rows.select("doc_id", F.when(F.col("well"), fields).alias("fields"), F.when(F.col("well"), F.col("lines")).otherwise(F.array()).alias("lines"))


def xml_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, fields, raw_text, lines) and rejects (doc_id, error XML001) from (doc_id, text)."""
    rows = parsed(texts)
    good = rows.where("fields is not null").select("doc_id", "fields", F.lit(None).cast("string").alias("raw_text"), "lines")
    return good, rows.where("fields is null").select("doc_id", F.lit("XML001").alias("error"))


def xml_items(texts: DataFrame) -> DataFrame:
    """doc_id, items: XML001 for each text, in the form of the rules' items."""
    return items_of(parsed(texts))


def items_of(rows: DataFrame) -> DataFrame:
    """xml_items of rows of parsed() that are at hand; doc_id may be a struct that has more than the key."""
    level, title, description, recommendation, ok = fixed.CATALOGUE_25["XML001"]
    item = F.when(F.col("fields").isNull(), _item("XML001", level, title, description, recommendation)).otherwise(_item("XML001", "OK", ok))
    return rows.select("doc_id", F.array(item.cast(_Value)).alias("items"))


def lines(documents: DataFrame) -> DataFrame:
    """doc_id and the columns of LINE for each line of documents; lines without a number get their place, from 1."""
    rows = documents.select("doc_id", F.posexplode("lines").alias("at", "x"))
    return rows.select("doc_id", F.coalesce("x.line_no", F.col("at") + 1).alias("line_no"), *[f"x.{c.split()[0]}" for c in LINE.split(", ")[1:]])
