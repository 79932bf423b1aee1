"""Rules that the catalogues declare on documents with lines, keyed by the catalogue's version as one code means different things in them.

Lines are never gathered: what the rules ask of them is counted by document before rows move, and one row a document is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions.scalars import is_bin, parse_date_exact, parse_number, within_tolerance
from kerege.operators.lines import LIMIT, MOST_LINES

#: Document fields, all texts; lines are (doc_id, uom, qty, price, discount, vat_rate as text, cents, vat_cents).
FIELDS = ("format", "raw_text", "number", "seller_id", "buyer_id", "issue_date", "currency", "rate", "total", "reference", "signature", "signed_until", "signer", "director", "debug", "test")
MANDATORY = ("seller_id", "buyer_id", "number", "issue_date", "currency")


def line_counts(lines: DataFrame) -> DataFrame:
    """One row a document: n lines and how many of them each rule speaks of, and the sums of their cents."""
    rate = parse_number(F.col("vat_rate"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    of = {
        "no_rate": blank("vat_rate"),
        "zero_rate": rate == 0,
        "bad_rate": ~blank("vat_rate") & rate.isNull(),
        "wrong_vat": F.col("vat_cents") != F.round(F.col("cents") * rate / 100),
        "no_qty": F.col("qty").isNull() | (F.col("qty") == 0),
        "negative_qty": F.col("qty") < 0,
        "no_uom": blank("uom"),
        "bad_price": F.col("price").isNull() | (F.col("price") < 0),
        "long_price": F.abs(F.col("price") * 100 - F.round(F.col("price") * 100)) > 1e-6,
        "discounted": F.col("discount") > 0,
        "deep_discount": F.col("discount") > 0.5,
    }
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("cents").alias("lines_cents"), *[F.count_if(c).alias(k) for k, c in of.items()])


def _rules(as_of: Column, period: tuple[str, str]) -> dict[str, Column]:
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    there = lambda c: text(c) != ""
    some = lambda c: F.col(c) > 0
    missing = F.col("n_lines") == 0
    for c in MANDATORY:
        missing = missing | ~there(c)
    day, total = F.col("__day"), F.col("__total")
    gap = F.abs(F.col("lines_cents") - F.round(total * 100))
    whole = (total == F.floor(total)) & (F.col("lines_cents") % 100 != 0)  # the total has lost its cents
    close = within_tolerance(total, F.col("lines_cents") / 100)
    return {
        "F001": ~F.lower(text("format")).isin("pdf", "xls", "xlsx"),
        "F002": missing,
        "F003": (F.lower(text("format")) == "pdf") & ~there("raw_text"),
        "D000": day.isNull(),
        "D001": day > as_of,
        "D002": ~day.between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date")),
        "N001": ~text("number").rlike(r"^[A-Za-z0-9_-]{1,64}$"),
        "ID001": ~is_bin(text("seller_id")),
        "ID002": ~is_bin(text("buyer_id")),
        "ID003": there("seller_id") & (text("seller_id") == text("buyer_id")),
        "CUR001": ~F.upper(text("currency")).isin(fixed.CURRENCIES),
        "CUR002": there("currency") & (F.upper(text("currency")) != "KZT") & ~there("rate"),
        "AMT001": total.isNull() | (total == 0),
        "NEG001": total < 0,
        "TOT001": some("n_lines") & (gap > 0),
        "TOT002": some("n_lines") & (gap > LIMIT),
        "ROUND001": some("n_lines") & whole & close,
        "ROUND002": some("n_lines") & whole & ~close,
        "VAT001": some("n_lines") & (F.col("no_rate") == F.col("n_lines")),
        "VAT002": some("no_rate") & (F.col("no_rate") < F.col("n_lines")),
        "VAT003": some("n_lines") & (F.col("zero_rate") == F.col("n_lines")),
        "VAT004": some("bad_rate"),
        "QTY001": some("no_qty"),
        "QTY002": some("negative_qty"),
        "UOM001": some("no_uom"),
        "PRICE001": some("bad_price"),
        "PRICE002": some("long_price"),
        "DISC001": some("discounted"),
        "DISC002": some("deep_discount"),
        "LINE001": F.col("n_lines") == 0,
        "LINE002": F.col("n_lines") > MOST_LINES,
        "REF001": there("reference"),
        "REF002": there("reference") & F.col("__referred").isNull(),
        "SIG001": ~there("signature"),
        "SIG002": there("signature") & (parse_date_exact(text("signed_until")) < as_of),
        "META001": there("debug") | there("test"),
        "META002": F.lower(text("test")).isin("true", "1"),
        "AUTH001": ~there("signer"),
        "AUTH002": there("signer") & there("director") & (text("signer") != text("director")),
    }


def _later() -> dict[str, Column]:
    number, total = F.trim(F.coalesce(F.col("number"), F.lit(""))), F.col("__total")
    return {
        "TOT001": F.col("lines_cents") != F.round(total * 100),
        "VAT001": F.col("wrong_vat") > 0,
        "ID001": (number != "") & ~number.rlike(r"^[A-Z0-9_\-]+$"),
        "ID002": number == "",
        "AMT001": total.isNull() | (total <= 0),
        "NEG001": total < 0,
    }


#: Levels of each version's codes; a later version has those of the first besides its own.
VERSIONS = {"v1": {k: v[0] for k, v in fixed.FIRST_CATALOGUE.items()}, "v2.6": dict.fromkeys(("TOT001", "VAT001", "ID001", "ID002", "AMT001", "NEG001"), "ERROR")}


def findings(docs: DataFrame, lines: DataFrame, as_of: str, period: tuple[str, str], version: str = "v1") -> DataFrame:
    """doc_id, code, level, message of each rule that speaks of a document; SYS001 where no error or warning does.

    docs has doc_id and FIELDS; a reference is looked up among the documents' numbers. Documents without lines stay.
    """
    counted = line_counts(lines)
    rows = docs.join(counted, "doc_id", "left").fillna(0, [c for c in counted.columns if c != "doc_id"])
    numbers = docs.where("number is not null").select(F.col("number").alias("__referred")).distinct()
    # documents without a reference, most of them, get a key of their own each, which no number is: else all would meet at one
    rows = rows.withColumn("__sought", F.coalesce("reference", F.concat(F.lit("\u0000"), F.col("doc_id").cast("string"))))
    rows = rows.join(numbers, rows["__sought"] == numbers["__referred"], "left")
    rows = rows.withColumns({"__day": parse_date_exact(F.coalesce("issue_date", F.lit(""))), "__total": parse_number(F.coalesce("total", F.lit("")))})
    rules = _rules(F.lit(as_of).cast("date"), period)
    if version != "v1":
        rules |= _later()
    levels = VERSIONS["v1"] | VERSIONS[version]
    told = rows.select("doc_id", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("code"), F.lit(levels[k]).alias("level"))) for k, c in rules.items()]), lambda x: x.isNotNull()).alias("items"))
    clean = ~F.exists("items", lambda x: x["level"].isin("ERROR", "WARN"))
    success = F.array(F.struct(F.lit("SYS001").alias("code"), F.lit(levels["SYS001"]).alias("level")))
    flat = told.select("doc_id", F.explode_outer(F.when(clean, F.concat("items", success)).otherwise(F.col("items"))).alias("x")).where("x is not null")
    messages = F.create_map(*[F.lit(x) for k, v in fixed.FIRST_CATALOGUE.items() for x in (k, v[1])])
    return flat.select("doc_id", "x.code", "x.level", F.try_element_at(messages, F.col("x.code")).alias("message"))
