"""Queries on inputs that usual invoices don't have: broken texts of several kinds, sheets with several dates, preferred totals, rules that seldom fire, the older generation on texts; beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.functions import scalars as S
from kerege.operators import catalogue as C
from kerege.operators import cells as X
from kerege.operators import extended as E
from kerege.operators import reports as R
from kerege.operators import validation as V
from kerege.plans import oracle as O
from kerege.plans import queries as Q
from kerege.sources import invoices as I

AS_OF = I.AS_OF

_PLAIN = "Итого к оплате: "
_LATIN = "Résumé déjà vu, façade: "
#: What stands in front of a total, and what it is once repaired: bytes of 1251 read as Latin-1, UTF-8 read as 1252, the first and then the second, Latin words with accents, sound Cyrillic.
FORMS = [
    (_PLAIN.encode("cp1251").decode("latin-1"), _PLAIN),
    (_PLAIN.encode().decode("cp1252"), _PLAIN),
    (_PLAIN.encode("cp1251").decode("latin-1").encode().decode("cp1252"), _PLAIN),
    (_LATIN, None),  # taken for Cyrillic, as its accents are letters of 1251: what comes out is in the SQL
    (_PLAIN, _PLAIN),
    ("plain: ", "plain: "),
]


def mojibake_forms(spark, sf_dir: str) -> DataFrame:
    """Texts that are broken in several ways or not at all, and what repairing makes of them."""
    k = (F.col("doc_id") % len(FORMS)).cast("int")
    text = F.concat(F.get(F.array(*[F.lit(f[0]) for f in FORMS]), k), I.money_text(F.col("cents")))
    rows = I.invoices(spark, sf_dir).select("doc_id", text.alias("text"))
    return rows.select("doc_id", "text", S.fix_mojibake(F.col("text")).alias("fixed"))


_FIXED = [f[1] if f[1] is not None else f[0].encode("latin-1").decode("cp1251") for f in FORMS]
MOJIBAKE_SQL = f"""
with {O.INV}
select doc_id, [{", ".join(O._q(f[0]) for f in FORMS)}][doc_id % {len(FORMS)} + 1] || {O._money("cents")} as text, [{", ".join(map(O._q, _FIXED))}][doc_id % {len(FORMS)} + 1] || {O._money("cents")} as fixed from inv
"""

#: Headers of dates of two kinds.
ALIASES = {"issue_date": ["дата выписки"], "turnover_date": ["дата оборота"]}


def cell_dates_mixed(spark, sf_dir: str) -> DataFrame:
    """Issue and turnover dates of sheets that have both, stray dates and a second issue date, by doc_id mod 4: a label beside or above, an invoice's name, a turnover date alone."""
    day = lambda n: F.date_format(F.date_add("day", n), "dd.MM.yyyy")
    layouts = [
        [(1, 1, day(9)), (3, 1, F.lit("Дата оборота")), (3, 2, day(1)), (5, 1, F.lit("Дата выписки")), (5, 2, day(0)), (7, 1, F.lit("Дата выписки")), (8, 1, day(2)), (5, 3, day(8))],
        [(1, 1, day(9)), (4, 2, F.lit("Счет-фактура от ")), (4, 4, F.concat(F.lit("Счет от "), day(3))), (6, 1, F.lit("Дата оборота")), (7, 1, day(1))],
        [(1, 1, day(9)), (2, 1, F.lit("Дата оборота")), (2, 2, day(1)), (9, 9, F.lit("31.02.2000"))],
        [(2, 5, F.lit("Дата выписки")), (2, 6, F.lit("нет")), (3, 5, day(4)), (3, 4, F.lit("Дата выписки")), (1, 7, day(9))],
    ]
    rows = [F.when(F.col("doc_id") % 4 == k, F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), v.alias("v")) for r, c, v in layout])) for k, layout in enumerate(layouts)]
    base = I.invoices(spark, sf_dir)
    cells = base.select("doc_id", F.explode(F.coalesce(*rows)).alias("x")).select("doc_id", "x.r", "x.c", "x.v")
    issue, turnover = (X.cell_dates(cells, kind, ALIASES) for kind in ("issue_date", "turnover_date"))
    return base.select("doc_id").join(issue, "doc_id", "left").join(turnover, "doc_id", "left")


DATES_SQL = f"""
with {O.INV}
select doc_id, case doc_id % 4 when 0 then strftime(day, '%Y-%m-%d') when 1 then strftime(day + 3, '%Y-%m-%d') when 3 then strftime(day + 4, '%Y-%m-%d') end as issue_date,
  case when doc_id % 4 < 3 then strftime(day + 1, '%Y-%m-%d') end as turnover_date from inv
"""


def cell_totals_preferred(spark, sf_dir: str) -> DataFrame:
    """The total of a sheet where net or VAT is preferred: that kind's number if the sheet has it, else the usual one."""
    cells = I.cells(I.invoices(spark, sf_dir))
    rows = [X.cell_totals(cells, prefer).where("kind = 'total_amount'").select("doc_id", F.lit(prefer).alias("prefer"), "amount", "trace") for prefer in ("net", "vat")]
    return rows[0].unionByName(rows[1])


PREFERRED_SQL = f"""
with {O.TOTALS},
usual as (select doc_id, amount, trace from top where z = 1)
select doc_id, 'vat' as prefer, amount, trace from usual
union all select doc_id, 'net', amount, trace from found where kind = 'total_net'
union all select doc_id, 'net', amount, trace from usual where doc_id not in (select doc_id from found where kind = 'total_net')
"""

RARE = ("ID002", "LINE002", "PRICE001", "VAT001", "VAT002", "REF001", "REF002")


def extended_rules_rare(spark, sf_dir: str) -> DataFrame:
    """Declared rules that usual invoices never fire: wrong buyers, thousands of lines, missing and negative prices, lines without a rate."""
    docs, lines = I.extended(spark, sf_dir)
    n = lambda m, r=0: F.col("doc_id") % m == r
    docs = docs.withColumn("buyer_id", F.when(n(24), "12345").when(n(24, 1), None).otherwise(F.col("buyer_id")))
    price = F.when(n(31) & (F.col("cents") % 2 == 0), None).when(n(31, 1) & (F.col("cents") % 2 == 0), -1.0).otherwise(F.col("price"))
    lines = lines.withColumns({"price": price, "vat_rate": F.when(n(9) & (F.col("cents") % 2 == 0), " ").otherwise("7")})
    lines = lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(n(997), 300).otherwise(1)))).drop("copy")
    return E.findings(docs, lines, AS_OF, ("1995-06-01", "2000-12-31")).where(F.col("code").isin(*RARE)).select("doc_id", "code", "level")


RARE_SQL = f"""
with d as (select cast(o_orderkey as bigint) as doc_id, cast(o_custkey as bigint) as custkey from orders),
l as (select cast(l_orderkey as bigint) as doc_id, count(*) as n, count(*) filter (cast(round(l_extendedprice * 100) as bigint) % 2 = 0) as even from lineitem group by 1),
x as (select d.doc_id, coalesce(n, 0) as n, coalesce(even, 0) as even, case when d.doc_id % 17 > 1 then 'INV-' || d.doc_id when d.doc_id % 17 = 0 then '№ 5/7' end as number,
  case when d.doc_id % 11 = 0 then 'INV-' || (d.doc_id + 1) end as reference from d left join l on d.doc_id = l.doc_id),
nums as (select distinct case when doc_id % 17 = 2 then 'inv-' || doc_id else number end as number from x where number is not null)
select doc_id, 'ID002' as code, 'ERROR' as level from x where doc_id % 24 in (0, 1)
union all select doc_id, 'LINE002', 'WARN' from x where doc_id % 997 = 0 and n * 300 > 1000
union all select doc_id, 'PRICE001', 'ERROR' from x where doc_id % 31 in (0, 1) and even > 0
union all select doc_id, 'VAT001', 'ERROR' from x where doc_id % 9 = 0 and n > 0 and even = n
union all select doc_id, 'VAT002', 'WARN' from x where doc_id % 9 = 0 and even between 1 and n - 1
union all select doc_id, 'REF001', 'INFO' from x where reference is not null
union all select doc_id, 'REF002', 'WARN' from x where reference is not null and reference not in (select number from nums)
"""


def legacy_text_counts(spark, sf_dir: str) -> DataFrame:
    """The rules of the older generation on documents that are text alone: fewer labels, no section, no date from texts."""
    docs = I.rendered(I.invoices(spark, sf_dir)).select("doc_id", F.create_map().cast("map<string,string>").alias("fields"), F.col("text").alias("raw_text"))
    return R.rule_counts(V.results(V.legacy_checked(docs, AS_OF)))


_OLD = O.fixed
LEGACY_TEXT_SQL = f"""
with {O.TXT},
f as (select doc_id, {O._labelled(_OLD.LEGACY_SUPPLIER_LABELS)} as supplier, {O._labelled(_OLD.LEGACY_BUYER_LABELS)} as buyer from txt),
r as (select 'BIN001' as code, length({O._digits("supplier")}) = 12 as ok from f union all select 'BIN002', length({O._digits("buyer")}) = 12 from f union all select 'D000', false from f
  union all select 'BIN012', {O._holds("supplier")} from f where length({O._digits("supplier")}) = 12 union all select 'BIN012', {O._holds("buyer")} from f where length({O._digits("buyer")}) = 12)
select code, case when ok then 'OK' else 'ERROR' end as level, count(*) as n from r group by all
"""

def catalog_labels(spark, sf_dir: str) -> DataFrame:
    """The catalogue with a rule for each label that the documents have and it hasn't, and without those that found nothing in any document."""
    truth = Q.mutation_truth(spark, sf_dir).where("check_code <> 'BASE'")
    new = truth.groupBy(F.col("check_code").alias("code")).agg(F.max(F.when(F.col("expected_status") == "ERROR", "ERROR").otherwise("WARN")).alias("level"), F.max("expected_message").alias("title"))
    new = new.select("code", "level", "title", F.lit("").alias("description"), F.lit("").alias("recommendation"))
    found = Q.rule_results_long(spark, sf_dir).where("level <> 'OK'").select("code").distinct()
    rules = C.catalogue(spark)
    return C.with_rules(rules.join(found, "code", "left_semi"), new)


LABELS_SQL = f"""
with {O.RES},
cat0 as {O._values([(c, *v) for c, v in O.fixed.CATALOGUE.items()], "code, level, title, description, recommendation")},
kept as (select * from cat0 where code in (select code from res where level <> 'OK')),
told as (select distinct check_code as code, case expected_status when 'ERROR' then 'ERROR' else 'WARN' end as level, expected_message as title from mut join {O._TRUTH} v on mut.m = v.m)
select code, level, title, description, recommendation from kept union all select code, level, title, '', '' from told where code not in (select code from kept)
"""

QUERIES = {f.__name__: f for f in (mojibake_forms, cell_dates_mixed, cell_totals_preferred, extended_rules_rare, legacy_text_counts, catalog_labels)}
ORACLE_SQL = {"mojibake_forms": MOJIBAKE_SQL, "cell_dates_mixed": DATES_SQL, "cell_totals_preferred": PREFERRED_SQL, "extended_rules_rare": RARE_SQL, "legacy_text_counts": LEGACY_TEXT_SQL, "catalog_labels": LABELS_SQL}
