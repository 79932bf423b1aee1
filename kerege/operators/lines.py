"""Rules on invoice lines that the catalogue declares beyond the core rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minor units by which a total may differ from its lines (one whole unit).
LIMIT = 100
MOST_LINES = 1000


def line_findings(lines: DataFrame) -> DataFrame:
    """doc_id, code, n from lines (doc_id, qty, price, discount, vat_rate): how many lines each rule speaks of.

    One pass and one aggregation: each rule is a conditional count that is combined before rows move.
    """
    rules = {
        "QTY001": F.col("qty").isNull() | (F.col("qty") == 0),
        "QTY002": F.col("qty") < 0,
        "PRICE001": F.col("price").isNull() | (F.col("price") < 0),
        "DISC001": F.col("discount") > 0,
        "DISC002": F.col("discount") > 0.5,
        "VAT001": F.col("vat_rate").isNull(),
        "VAT003": F.col("vat_rate") == 0,
    }
    counted = lines.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("n")) for k in rules], F.struct(F.lit("LINE002").alias("code"), F.when(F.col("n") > MOST_LINES, F.col("n")).otherwise(0).alias("n")))
    return counted.select("doc_id", F.explode(F.filter(pairs, lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.code", "x.n")


def total_findings(totals: DataFrame) -> DataFrame:
    """doc_id, lines_cents, total_cents, code from (doc_id, lines_cents, total_cents): LINE001, TOT001 (differs), TOT002 (by over one unit) or OK."""
    gap = F.abs(F.col("lines_cents") - F.col("total_cents"))
    code = F.when(F.col("lines_cents").isNull(), "LINE001").when(gap > LIMIT, "TOT002").when(gap > 0, "TOT001").otherwise("OK")
    return totals.select("doc_id", "lines_cents", "total_cents", code.alias("code"))
