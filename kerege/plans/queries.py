"""Queries over the driver tables, each a plan of operators; their SQL is in kerege.plans.oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions import scalars as S
from kerege.operators import catalogue as C
from kerege.operators import cells as X
from kerege.operators import extended as E
from kerege.operators import lines as N
from kerege.operators import reports as R
from kerege.operators import text_facts as T
from kerege.operators import validation as V
from kerege.settings import Settings
from kerege.sources import files
from kerege.sources import invoices as I

AS_OF = I.AS_OF


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.mutated(I.invoices(spark, sf_dir), AS_OF)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.checked(I.documents(_mutated(spark, sf_dir)), AS_OF)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.results(_items(spark, sf_dir))


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rendered(I.invoices(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cells(I.invoices(spark, sf_dir))


def invoice_base(spark, sf_dir):
    return I.invoices(spark, sf_dir)


def bin_clean(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), "c_name")
    return rows.select("key", S.only_digits(F.col("c_name")).alias("digits"), S.is_bin(F.col("c_name")).alias("lenient"), S.is_strict_bin(F.col("c_name")).alias("strict"))


def bin_strict_vs_lenient(spark, sf_dir):
    key = F.col("s_suppkey").cast("bigint")
    number = F.when(key % 5 == 0, F.lit("111111111111")).when(key % 5 == 1, F.concat(F.lit("AB "), I.numbered(key, 7919000017, 104729))).when(key % 5 == 2, "12345").otherwise(I.numbered(key, 7919000017, 104729))
    return _read(spark, sf_dir, "supplier").select(key.alias("key"), number.alias("number")).select("key", "number", S.is_bin(F.col("number")).alias("lenient"), S.is_strict_bin(F.col("number")).alias("strict"))


def bin_checksum(spark, sf_dir):
    rows = I.invoices(spark, sf_dir)
    return rows.select("doc_id", S.checksum_holds(F.col("supplier_bin")).alias("supplier_holds"), S.checksum_holds(F.col("buyer_bin")).alias("buyer_holds"))


def parse_number_variants(spark, sf_dir):
    key, cents = F.col("o_orderkey").cast("bigint"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    text = (
        F.when(key % 6 == 0, F.concat(whole, F.lit(","), part))
        .when(key % 6 == 1, F.concat(F.lit(" 1 "), whole, F.lit("."), part))
        .when(key % 6 == 2, F.concat(F.lit("1'"), whole, F.lit(","), part, F.lit(" ")))
        .when(key % 6 == 3, F.concat(F.lit("1,"), whole, F.lit("."), part))
        .when(key % 6 == 4, F.concat(F.lit("-"), whole))
        .otherwise(F.concat(whole, F.lit("d")))
    )
    return _read(spark, sf_dir, "orders").select(key.alias("key"), text.alias("text")).select("key", "text", S.parse_number(F.col("text")).alias("number"))


def parse_date_variants(spark, sf_dir):
    key, day = F.col("o_orderkey").cast("bigint"), F.col("o_orderdate").cast("date")
    name = F.element_at(F.array(*map(F.lit, fixed.MONTHS)), F.month(day))
    text = (
        F.when(key % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 6 == 1, F.date_format(day, "d.M.yyyy"))
        .when(key % 6 == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 6 == 3, F.date_format(day, "yyyy.MM.dd"))
        .when(key % 6 == 4, F.concat(F.lit("от «"), F.date_format(day, "d"), F.lit("» "), name, F.lit(" "), F.date_format(day, "yyyy"), F.lit(" г.")))
        .otherwise(F.concat(F.lit("31.02."), F.date_format(day, "yyyy")))
    )
    rows = _read(spark, sf_dir, "orders").select(key.alias("key"), text.alias("text"))
    return rows.select("key", "text", S.parse_date_found(F.col("text")).alias("found"), S.parse_date_exact(F.col("text")).alias("exact"))


def excel_serial_dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date"))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), serial.cast("int").alias("serial"))
    return rows.select("key", "serial", S.to_iso(S.excel_date(F.col("serial"))).alias("day"))


def _rule(code: str):
    def run(spark, sf_dir):
        return V.rule_items(I.documents(_mutated(spark, sf_dir)), code, AS_OF)

    return run


def rule_results_long(spark, sf_dir):
    return _results(spark, sf_dir)


def rule_counts(spark, sf_dir):
    return R.rule_counts(_results(spark, sf_dir))


def group_report(spark, sf_dir):
    return R.group_report(_results(spark, sf_dir))


def doc_verdict(spark, sf_dir):
    return R.verdicts(_results(spark, sf_dir))


def doc_summary(spark, sf_dir):
    pairs = F.transform(F.array_sort(F.transform("items", lambda x, k: F.struct(V.priority(x["code"]).alias("p"), x["code"].alias("code"), k.alias("k"), x["level"].alias("level")))), lambda x: F.struct(x["code"].alias("code"), x["level"].alias("level")))
    return R.summaries(_items(spark, sf_dir).select("doc_id", pairs.alias("results")))


def text_bin_extract(spark, sf_dir):
    t = F.col("text")
    return _text(spark, sf_dir).select("doc_id", T.text_bin(t, fixed.SUPPLIER_LABELS).alias("supplier"), T.text_bin(t, fixed.BUYER_LABELS).alias("buyer"))


def text_date_extract(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", T.header_date(F.col("text")).alias("header_date"), T.body_date(F.col("text")).alias("body_date"))


def text_total_priority(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", T.preferred_total(F.col("text")).alias("total"))


def text_total_scored(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", T.scored_total(F.col("text")).alias("total"))


def pdf_facts(spark, sf_dir):
    t = F.col("text")
    supplier, buyer = T.pdf_bins(t)
    return _text(spark, sf_dir).select("doc_id", supplier.alias("supplier"), buyer.alias("buyer"), T.pdf_date(t).alias("day"), T.pdf_total(t).alias("total"))


def text_rule_counts(spark, sf_dir):
    """The rules on documents that are text alone."""
    docs = _text(spark, sf_dir).select("doc_id", F.create_map().cast("map<string,string>").alias("fields"), F.col("text").alias("raw_text"))
    return R.rule_counts(V.results(V.checked(docs, AS_OF)))


def esf_section(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", S.esf_section(F.col("text")).alias("section"))


def mojibake_fix(spark, sf_dir):
    rows = _text(spark, sf_dir).select("doc_id", F.translate("text", S._TO_1251, S._FROM_1251).alias("broken"))
    return rows.select("doc_id", "broken", S.fix_mojibake(F.col("broken")).alias("fixed"))


def clean_text_key(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.select("doc_id", F.md5(S.clean_text(F.col("text"))).alias("text_md5"), F.md5(S.clean_key(F.col("text"))).alias("key_md5"))


def header_similarity(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("key"), S.clean_key(F.col("p_name")).alias("name"))
    alike = lambda kind, least=0.0: F.round(S.header_similarity("name", fixed.HEADER_ALIASES[kind], least), 6)
    kinds = [k for k, aliases in fixed.HEADER_ALIASES.items() if aliases]
    return rows.select("key", *[alike(k).alias(k) for k in kinds], (alike("total_amount", 0.3) >= 0.3).alias("alike"))


def cell_neighbours(spark, sf_dir):
    rows = _cells(spark, sf_dir).select("doc_id", "r", "c", F.struct("v").alias("x"))
    return X.neighbours(rows, "x", "x", [(0, -1), (-1, 0)]).select("doc_id", "r", "c", "x.v", "k", "r2", "c2", F.col("v2.v").alias("v2"))


def cell_bin_label(spark, sf_dir):
    return X.labelled_bins(_cells(spark, sf_dir))


def cell_bin_context(spark, sf_dir):
    return X.context_bins(_cells(spark, sf_dir))


def cell_dates(spark, sf_dir):
    return X.cell_dates(_cells(spark, sf_dir))


def cell_totals(spark, sf_dir):
    return X.cell_totals(_cells(spark, sf_dir))


def doc_type_keywords(spark, sf_dir):
    found = [F.struct(sum(F.when(F.col("text").contains(w), 1).otherwise(0) for w in words).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(fixed.DOCUMENT_TYPES.items())]
    best = F.array_max(F.array(*found))
    return _text(spark, sf_dir).select("doc_id", F.when(best["n"] > 0, best["name"]).otherwise("").alias("doc_type"), best["n"].alias("n_found"))


def _totals(spark, sf_dir) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("lines_cents"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("doc_id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_cents"))
    return orders.join(lines, orders.doc_id == lines.l_orderkey, "left").select("doc_id", "lines_cents", "total_cents")


def line_total_check(spark, sf_dir):
    return N.total_findings(_totals(spark, sf_dir))


def line_qty_price_check(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("doc_id"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("vat_rate"))
    return N.line_findings(rows)


def line_vat_check(spark, sf_dir):
    """VAT in cents of each invoice, from lines' cents and whole percents."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.round(F.col("l_tax") * 100).cast("bigint").alias("rate"))
    return rows.groupBy(F.col("l_orderkey").cast("bigint").alias("doc_id")).agg(F.sum(F.expr("(cents * rate + 50) div 100")).alias("vat_cents"), F.count_if(F.col("rate") == 0).alias("n_exempt"))


def tolerance_check(spark, sf_dir):
    a, b = F.col("total_cents") / 100.0, F.col("lines_cents") / 100.0
    return _totals(spark, sf_dir).select("doc_id", S.within_tolerance(a, b).alias("within"), S.within_tolerance(a, b * 1.0001).alias("within_scaled"))


def mutation_truth(spark, sf_dir):
    k = {m[0]: m for m in fixed.MUTATIONS}
    value = lambda i: F.coalesce(*[F.when(F.col("mutation") == c, F.lit(m[i])) for c, m in k.items()], F.lit("OK" if i == 1 else ""))
    return _mutated(spark, sf_dir).select("doc_id", F.col("mutation").alias("check_code"), value(1).alias("expected_status"), value(2).alias("expected_message"))


def confusion_matrix(spark, sf_dir):
    return R.confusion(_results(spark, sf_dir), mutation_truth(spark, sf_dir).where("check_code <> 'BASE'"))


def catalog_add(spark, sf_dir):
    new = spark.createDataFrame([("VAT001", "WARN", "Нет ставки НДС", "", ""), ("BIN001", "WARN", "x", "", "")], C.SCHEMA)
    return C.with_rules(C.catalogue(spark), new)


def catalog_remove(spark, sf_dir):
    return C.without_rules(C.catalogue(spark), ["D001", "NEG001"])


def catalog_sync(spark, sf_dir):
    engine = _results(spark, sf_dir).select("code").unionByName(spark.createDataFrame([("VAT001",)], "code string"))
    return C.differences(engine, C.without_rules(C.catalogue(spark), ["D001"]))


def normalize_keys_map(spark, sf_dir):
    rows = V.normalized(I.documents(_mutated(spark, sf_dir)))
    return rows.select("doc_id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("supplier_bin", "buyer_bin", "issue_date", "total_amount", "total_net")])


def report_text(spark, sf_dir):
    return R.report_lines(_results(spark, sf_dir))


def report_details(spark, sf_dir):
    """The report with all items, its groups' prefixes, order and best items configured."""
    return R.report_lines(_results(spark, sf_dir), DETAILED)


DETAILED = Settings(details=True, group_prefixes={"BIN": ["BIN"], "DATE": ["D"], "SUM": ["TOT", "NEG"]}, group_order={"BIN": 0, "DATE": 1, "SUM": 2}, group_best={"BIN": ["BIN012", "BIN001"], "DATE": ["D000", "D001"], "SUM": ["NEG001"]})


def json_documents(spark, sf_dir):
    """Mutated invoices as JSON files would have them (every tenth isn't JSON, or not an object, or says an error), read back."""
    rows = I.documents(_mutated(spark, sf_dir))
    k = F.col("doc_id") % 40
    text = F.when(k == 0, "{broken").when(k == 10, "[1, 2]").when(k == 20, '{"error": "E"}').otherwise(F.to_json("fields"))
    good, bad = files.json_documents(rows.select("doc_id", text.alias("text")))
    names = ("supplier_BIN", "recipient_BIN", "date_issue", "total_amount")
    found = good.select("doc_id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names], F.lit(None).cast("string").alias("error"))
    return found.unionByName(bad.select("doc_id", *[F.lit(None).cast("string").alias(n) for n in names], "error"))


def sheet_rule_counts(spark, sf_dir):
    """The rules on documents that are sheets alone."""
    return R.rule_counts(V.results(V.checked(X.sheet_documents(_cells(spark, sf_dir)), AS_OF)))


def legacy_rule_counts(spark, sf_dir):
    """The rules of the older generation on mutated invoices."""
    return R.rule_counts(V.results(V.legacy_checked(I.documents(_mutated(spark, sf_dir)), AS_OF)))


def odd_totals(spark, sf_dir):
    """Totals that are no numbers, not finite, table indexes or missing; equal numbers are allowed and checksums off."""
    base = I.invoices(spark, sf_dir)
    total = F.element_at(F.array(*map(F.lit, ODD_TOTALS)), (F.col("doc_id") % len(ODD_TOTALS) + 1).cast("int"))
    fields = F.create_map(F.lit("supplier_BIN"), F.col("supplier_bin"), F.lit("recipient_BIN"), F.when(F.col("doc_id") % 2 == 0, F.col("supplier_bin")).otherwise(F.col("buyer_bin")), F.lit("total_amount"), total)
    docs = base.select("doc_id", fields.alias("fields"), F.lit(None).cast("string").alias("raw_text"))
    found = V.results(V.checked(docs, AS_OF, settings=Settings(checksum=False, allow_equal_bins=True)))
    return found.select("doc_id", "code", "level", "value")


ODD_TOTALS = ("nan", "inf", "-inf", "5", "12.0", "13", "1.5", "", "-3", "1 000,50")


def extended_rules(spark, sf_dir):
    """The declared rules of the first catalogue on invoices with lines."""
    docs, lines = I.extended(spark, sf_dir)
    return E.findings(docs, lines, AS_OF, ("1995-06-01", "2000-12-31")).select("doc_id", "code", "level")


def extended_rules_26(spark, sf_dir):
    """The rules that a later catalogue defines anew."""
    docs, lines = I.extended(spark, sf_dir)
    return E.findings(docs, lines, AS_OF, ("1995-06-01", "2000-12-31"), version="v2.6").where(F.col("code").isin(list(E.VERSIONS["v2.6"]))).select("doc_id", "code", "level")


def line_mutations(spark, sf_dir):
    """Totals after the mutations of lines, in cents, of each mutation that the seed chooses for a base document."""
    return I.line_mutations(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        invoice_base, bin_clean, bin_strict_vs_lenient, bin_checksum, parse_number_variants, parse_date_variants, excel_serial_dates, rule_results_long, rule_counts, group_report,
        doc_verdict, doc_summary, text_bin_extract, text_date_extract, text_total_priority, text_total_scored, pdf_facts, text_rule_counts, esf_section, mojibake_fix, clean_text_key,
        header_similarity, cell_neighbours, cell_bin_label, cell_bin_context, cell_dates, cell_totals, doc_type_keywords, line_total_check, line_qty_price_check, line_vat_check,
        tolerance_check, mutation_truth, confusion_matrix, catalog_add, catalog_remove, catalog_sync, normalize_keys_map, report_text, report_details, json_documents, sheet_rule_counts, legacy_rule_counts, odd_totals, extended_rules, extended_rules_26, line_mutations,
    )
}
QUERIES |= {f"rule_{code.lower()}": _rule(code) for code in fixed.CATALOGUE}
