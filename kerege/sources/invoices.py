"""Invoices rendered from the order tables, as fields, text and sheet cells; with the mutations of synthetic documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerege.functions import fixed

#: The day that "today" stands for in queries.
AS_OF = "1999-01-01"


def numbered(key: Column, factor: int, offset: int) -> Column:
    """A 12-digit business number for a key."""
    return F.lpad(((key * factor + offset) % 1_000_000_000_000).cast("string"), 12, "0")


def money_text(cents: Column) -> Column:
    sign = F.when(cents < 0, "-").otherwise("")
    whole = F.abs(cents)
    return F.concat(sign, F.floor(whole / 100).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, supplier_bin, buyer_bin, day, cents, n_lines: one row for each order with lines.

    The lines are added up before the join, so the join moves one row an order and what is summed is combined before it moves.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_extendedprice")
    totals = lines.groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"), F.min("l_suppkey").alias("supplier"), F.count("*").alias("n_lines"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = orders.join(totals, orders.o_orderkey == totals.l_orderkey)
    return joined.select(
        F.col("o_orderkey").cast("bigint").alias("doc_id"),
        numbered(F.col("supplier").cast("bigint"), 7919000017, 104729).alias("supplier_bin"),
        numbered(F.col("o_custkey").cast("bigint"), 6700417003, 15485863).alias("buyer_bin"),
        F.col("o_orderdate").cast("date").alias("day"),
        "cents",
        "n_lines",
    )


def mutated(base: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """doc_id, mutation, and the fields supplier_BIN, recipient_BIN, date_issue, total_amount as texts; mutation is doc_id mod 22, 0 for none."""
    k = (F.col("doc_id") % 22).cast("int")
    names = F.array(F.lit("BASE"), *[F.lit(m[0]) for m in fixed.MUTATIONS])
    name = F.element_at(names, k + 1)
    case = lambda column, **values: F.coalesce(*[F.when(name == code, F.lit(v) if isinstance(v, str) else v) for code, v in values.items()], column)
    day = F.lit(as_of).cast("date")
    return base.select(
        "doc_id",
        name.alias("mutation"),
        case(F.col("supplier_bin"), ID001="12345", BIN001="", BIN003="1234567", BIN006="AB1234567890").alias("supplier_BIN"),
        case(F.col("buyer_bin"), ID002="12345", BIN002="", BIN004="12AB56789012", BIN005="98765", BIN007=F.col("supplier_bin")).alias("recipient_BIN"),
        case(F.date_format("day", "yyyy-MM-dd"), D000="", D001=F.date_format(F.date_add(day, 5), "yyyy-MM-dd"), D002="2025/13/99", D003="1998-01-01", D004=F.date_format(day, "dd.MM.yyyy")).alias("date_issue"),
        case(money_text(F.col("cents")), TOT001=money_text(F.col("cents") + 1000), TOT003="0", TOT004=money_text(F.col("cents") + 1), NEG001=money_text(-F.col("cents")), AMT001="ABC").alias("total_amount"),
    )


def documents(rows: DataFrame) -> DataFrame:
    """doc_id, fields (a map) from rows of mutated(); there is no text."""
    names = ("supplier_BIN", "recipient_BIN", "date_issue", "total_amount")
    fields = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return rows.select("doc_id", fields.alias("fields"))


def rendered(base: DataFrame) -> DataFrame:
    """doc_id, text: the invoice as a page of text, in one of four layouts by doc_id mod 4."""
    day = F.date_format("day", "dd.MM.yyyy")
    total = money_text(F.col("cents"))
    number = F.col("doc_id").cast("string")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    layouts = [
        (line("СЧЕТ-ФАКТУРА № ", number, " от ", day), line("БИН поставщика: ", F.col("supplier_bin")), line("БИН покупателя: ", F.col("buyer_bin")), line("Итого с НДС: ", total, " KZT")),
        (line("Письмо"), line("ЭСФ"), line("Дата выписки: ", day), line("ИИН/БИН поставщика - ", F.col("supplier_bin")), line("БИН получателя ", F.col("buyer_bin")), line("Всего к оплате ", total), line("Приложение 1")),
        (line("Tax Invoice ", number), line("БИН поставщика:"), line("БИН покупателя: ", F.col("buyer_bin")), F.concat(F.date_format("day", "d"), F.lit(" "), F.element_at(F.array(*map(F.lit, fixed.MONTHS)), F.month("day")), F.lit(" "), F.date_format("day", "yyyy")), line("Итого: ", total, " тенге")),
        (line("Накладная ", day), line("BIN seller ", F.col("supplier_bin")), line("BIN buyer ", F.col("buyer_bin")), line("Количество 12"), line("Total ", total)),
    ]
    text = F.coalesce(*[F.when(F.col("doc_id") % 4 == k, F.concat_ws("\n", *lines)) for k, lines in enumerate(layouts)])
    return base.select("doc_id", text.alias("text"))


def cells(base: DataFrame) -> DataFrame:
    """doc_id, r, c, v: the invoice as cells of a sheet (texts), in one of three layouts by doc_id mod 3."""
    day, total = F.date_format("day", "dd.MM.yyyy"), money_text(F.col("cents"))
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    layouts = [
        [(5, 1, "Дата выписки"), (5, 2, day), (10, 1, "БИН поставщика"), (10, 3, F.col("supplier_bin")), (17, 1, "БИН покупателя"), (17, 2, F.col("buyer_bin")), (41, 1, "Всего с НДС"), (41, 2, total)],
        [(3, 2, "Поставщик"), (3, 4, "БИН"), (4, 3, F.col("supplier_bin")), (12, 2, "Покупатель"), (12, 4, "БИН"), (13, 3, F.col("buyer_bin")), (20, 2, "Итого к оплате"), (22, 2, total), (1, 1, F.concat(F.lit("Счет от "), day))],
        [(2, 1, "Поставщик БИН"), (4, 1, F.col("supplier_bin")), (8, 1, "Грузополучатель, БИН"), (8, 9, F.col("buyer_bin")), (9, 5, "Дата"), (10, 5, day), (15, 1, "Всего без НДС"), (15, 2, "н/д"), (15, 3, total), (30, 1, "Всего без НДС"), (30, 2, "7.5")],
    ]
    rows = [F.when(F.col("doc_id") % 3 == k, F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), text(v).alias("v")) for r, c, v in layout])) for k, layout in enumerate(layouts)]
    return base.select("doc_id", F.explode_outer(F.coalesce(*rows)).alias("x")).where("x is not null").select("doc_id", "x.r", "x.c", "x.v")


def extended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the fields of the extended rules, and their lines, with flaws by remainders of the key; orders without lines stay."""
    k = F.col("o_orderkey").cast("bigint")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").cast("bigint").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").cast("double").alias("qty"), F.col("l_discount").cast("double").alias("discount"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.round(F.col("l_tax") * 100).cast("bigint").alias("rate"),
    )
    at = lambda n: (F.col("doc_id") + F.col("line")) % n == 0
    lines = items.select(
        "doc_id",
        F.when(at(67), "").otherwise("усл").alias("uom"),
        F.when(at(71), 0.0).when(at(73), -1.0).otherwise(F.col("qty")).alias("qty"),
        F.when(at(79), F.col("cents") / 100 + 0.001).otherwise(F.col("cents") / 100).alias("price"),
        F.when(at(83), 0.6).otherwise(F.col("discount")).alias("discount"),
        F.when(F.col("doc_id") % 89 == 0, None).when(at(97), "x").otherwise(F.col("rate").cast("string")).alias("vat_rate"),
        "cents",
        (F.expr("(cents * rate + 50) div 100") + F.when(at(101), 1).otherwise(0)).alias("vat_cents"),
    )
    totals = items.groupBy("doc_id").agg(F.sum("cents").alias("cents"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("doc_id"), F.col("o_custkey").cast("bigint").alias("custkey"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("day"))
    rows = orders.join(totals, "doc_id", "left").withColumn("cents", F.coalesce("cents", F.lit(0)))
    n = lambda m, r=0: F.col("doc_id") % m == r
    cents, seller = F.col("cents"), numbered(F.col("doc_id"), 7919000017, 104729)
    docs = rows.select(
        "doc_id",
        F.when(n(43), "doc").when(n(3), "pdf").when(n(3, 1), "XLSX").otherwise("xls").alias("format"),
        F.when(n(6), None).otherwise("x").alias("raw_text"),
        F.when(n(17), "№ 5/7").when(n(17, 1), None).when(n(17, 2), F.concat(F.lit("inv-"), "doc_id")).otherwise(F.concat(F.lit("INV-"), "doc_id")).alias("number"),
        F.when(n(19), "12345").otherwise(seller).alias("seller_id"),
        F.when(n(23), seller).otherwise(numbered(F.col("custkey"), 6700417003, 15485863)).alias("buyer_id"),
        F.when(n(29), "31.13.2000").otherwise(F.col("day")).alias("issue_date"),
        F.when(n(31), "XXZ").when(n(5), "usd").otherwise("KZT").alias("currency"),
        F.when(n(10), "450.5").alias("rate"),
        F.when(n(37), "0").when(n(41), money_text(-cents)).when(n(7), money_text(cents + 50)).when(n(7, 1), money_text(cents + 500)).when(n(7, 2), F.floor(cents / 100).cast("string")).otherwise(money_text(cents)).alias("total"),
        F.when(n(11), F.concat(F.lit("INV-"), F.col("doc_id") + 1)).alias("reference"),
        F.when(n(13), None).otherwise("S").alias("signature"),
        F.when(n(13, 1), "1990-01-01").otherwise("2030-01-01").alias("signed_until"),
        F.when(n(47), " ").otherwise("A").alias("signer"),
        F.when(n(53), "B").otherwise("A").alias("director"),
        F.when(n(59), "1").alias("debug"),
        F.when(n(61), "true").alias("test"),
    )
    return docs, lines


#: Mutations that one base document gets.
PER_BASE = 8


def chosen_mutations(base: DataFrame, per_base: int = PER_BASE, seed: int = 42) -> DataFrame:
    """doc_id, mutation: for each base document so many different mutations, those with the least hashes of seed, document and code (then the code)."""
    scored = F.array(*[F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "doc_id", F.lit(m[0]))).alias("h"), F.lit(m[0]).alias("code")) for m in fixed.MUTATIONS])
    first = F.slice(F.array_sort(scored), 1, per_base)
    return base.select("doc_id", F.explode(first).alias("x")).select("doc_id", F.col("x.code").alias("mutation"))


def line_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, mutation, total_cents, vat_cents, with_vat_cents: totals as the chosen mutations leave them; those of lines and of totals change them.

    NEG001 and NEG002 turn the lines' amounts or VAT negative and add up anew, TOT002 takes five percent off the total with VAT.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("bigint").alias("doc_id"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.round(F.col("l_tax") * 100).cast("bigint").alias("rate"))
    vat = F.expr("(cents * rate + 50) div 100")
    sums = items.groupBy("doc_id").agg(F.sum("cents").alias("cents"), F.sum(vat).alias("vat"), F.sum(-F.abs("cents")).alias("minus_cents"), F.sum(-F.abs(vat)).alias("minus_vat"))
    rows = sums.join(chosen_mutations(sums), "doc_id")
    is_ = lambda *codes: F.col("mutation").isin(*codes)
    total = F.when(is_("NEG001"), F.col("minus_cents")).otherwise(F.col("cents"))
    tax = F.when(is_("NEG002"), F.col("minus_vat")).otherwise(F.col("vat"))
    whole = total + tax
    return rows.select(
        "doc_id",
        "mutation",
        F.when(is_("TOT003"), 0).when(is_("TOT001"), total + 1000).when(is_("TOT004"), total + 1).when(is_("AMT001"), None).otherwise(total).alias("total_cents"),
        F.when(is_("TOT003"), 0).otherwise(tax).alias("vat_cents"),
        F.when(is_("TOT003"), 0).when(is_("TOT002"), F.expr("(95 * (cents + vat) + 50) div 100")).otherwise(whole).alias("with_vat_cents"),
    )


def sectioned(base: DataFrame) -> DataFrame:
    """doc_id, text: an invoice by sections; two sections change places (doc_id mod 7 and the next digit to base 7), one may be left out and one may stand again at the end."""
    day, total = F.date_format("day", "dd.MM.yyyy"), money_text(F.col("cents"))
    seven = lambda power: F.expr(f"cast((doc_id div {power}) % 7 as int)")
    i, j, out, again = seven(1), seven(7), F.expr("cast((doc_id div 49) % 9 as int)"), F.expr("cast((doc_id div 5) % 11 as int)")
    names = F.array(*map(F.lit, fixed.TEMPLATE_SECTIONS))
    body = F.array(F.concat(F.lit("Дата выписки "), day), F.concat(F.lit("БИН "), "supplier_bin"), F.concat(F.lit("БИН "), "buyer_bin"), F.lit("Раздел АБ не раздел"), F.lit("виртуальный склад"), F.concat(F.lit("Всего "), total), F.when(F.col("doc_id") % 3 > 0, "ЭЦП поставщика").otherwise(""))
    place = lambda k: F.when(k == i, j).when(k == j, i).otherwise(k)
    # the sections' texts are made once, not at each place
    parts = lambda made: F.transform(F.array(*[F.struct(place(F.lit(k)).alias("p")) for k in range(7)]), lambda x: F.when(x["p"] != out, F.concat(F.get(names, x["p"]), F.lit(". Текст\n"), F.get(made, x["p"]))))
    kept = F.filter(F.get(F.transform(F.array(body), parts), 0), lambda x: x.isNotNull())
    last = F.when(again < 7, F.concat(F.get(names, again), F.lit(" (продолжение)"))).otherwise("")
    return base.select("doc_id", F.concat(F.lit("ЭСФ\n"), F.array_join(kept, "\n"), F.lit("\n"), last).alias("text"))


def bilingual(base: DataFrame) -> DataFrame:
    """doc_id, text: the invoice in Russian, in Kazakh or in both, by doc_id mod 3; every fifth has no date."""
    day, total = F.date_format("day", "dd.MM.yyyy"), money_text(F.col("cents"))
    dated = lambda name: F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit(name), day))
    ru = F.concat_ws("\n", F.concat(F.lit("Поставщик, БИН: "), "supplier_bin"), F.concat(F.lit("Покупатель: "), "buyer_bin"), dated("Дата выписки: "), F.concat(F.lit("ВСЕГО К ОПЛАТЕ "), total))
    kk = F.concat_ws("\n", F.concat(F.lit("Жеткізуші БСН: "), "supplier_bin"), F.concat(F.lit("Сатып алушы: "), "buyer_bin"), dated("Күні "), F.concat(F.lit("Төлеуге тиіс сома: "), total))
    text = F.when(F.col("doc_id") % 3 == 0, ru).when(F.col("doc_id") % 3 == 1, kk).otherwise(F.concat(kk, F.lit("\n"), ru))
    return base.select("doc_id", text.alias("text"))
