"""Queries for catalogues by version, rules that are added at run time, XML files, templates, sections and keywords, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.operators import catalogue as C
from kerege.operators import keywords as K
from kerege.operators import rule_functions as P
from kerege.operators import templates as M
from kerege.operators import validation as V
from kerege.plans import oracle as O
from kerege.sources import invoices as I
from kerege.sources import xml_files as X

AS_OF = I.AS_OF


def _documents(spark, sf_dir: str) -> DataFrame:
    return I.documents(I.mutated(I.invoices(spark, sf_dir), AS_OF))


#: Versions that one run of catalogue_results puts beside each other.
SHOWN = ("v2.5", "v2.7")


def catalogue_results(spark, sf_dir: str) -> DataFrame:
    """What the rules find in each invoice, once, as two catalogues put it; what a catalogue hasn't comes from the ones before it."""
    return C.described(C.coded(V.checked(_documents(spark, sf_dir), AS_OF)), C.inherited(C.versions(spark)), SHOWN)


_VERSIONS = (
    [("v1", 1, c, level, text, "", "", None, None) for c, (level, text) in fixed.FIRST_CATALOGUE.items()]
    + [(v, k, c, *texts, "") for v, k, table in (("v2.5", 2, fixed.CATALOGUE_25), ("v2.6", 3, fixed.CATALOGUE_26)) for c, texts in table.items()]
    + [("v2.7", 4, c, *texts, None, None) for c, texts in fixed.CATALOGUE.items()]
)
_TEXTS = ("level", "title", "description", "recommendation", "ok", "ok_description")
_RAW = f"{O.RES.split('cat as (')[0]}"

CATALOGUE_SQL = f"""
with {_RAW}
okt as {O._values(O._OK, "code, role, title, description, recommendation")},
told as {O._values(_VERSIONS, "version, n, code, level, title, description, recommendation, ok, ok_description")},
own as {O._values([(c, *v) for c, v in fixed.CATALOGUE.items()], "code, level, title, description, recommendation")},
shown as (select unnest([2, 4]) as n, unnest(['v2.5', 'v2.7']) as version),
cat as (select s.version, t.code, t.level, t.title, t.description, t.recommendation, t.ok, t.ok_description from shown s join told t on t.n <= s.n qualify row_number() over (partition by s.version, t.code order by t.n desc) = 1),
x as (select r.doc_id, r.n, r.code, r.ok, r.role, r.value, s.version, row_number() over (partition by r.doc_id, s.version order by case when r.code like 'BIN%' then 0 when r.code like 'D%' then 1 else 2 end, r.code, r.n) - 1 as ord from raw r, shown s),
y as (select x.*, case when x.ok then 'OK' else coalesce(cat.level, own.level) end as level,
  case when x.ok then coalesce(cat.ok, okt.title) else coalesce(cat.title, own.title) || coalesce(' (' || x.role || ')', '') end as title,
  case when x.ok then coalesce(cat.ok_description, okt.description) else coalesce(cat.description, own.description) end as description,
  case when x.ok then okt.recommendation else coalesce(cat.recommendation, own.recommendation) end as recommendation
  from x left join cat on x.code = cat.code and x.version = cat.version left join own on x.code = own.code left join okt on x.code = okt.code and x.role is not distinct from okt.role)
select doc_id, version, cast(ord as integer) as ord, code, level, concat_ws(' — ', nullif(title, ''), nullif(description, ''), nullif(recommendation, '')) || coalesce(' [значение: ' || value || ']', '') as message, value from y
"""


def _share(as_of) -> F.Column:
    """An item where the document's share is large; the division fails on every seventh."""
    share = F.lit(100) / (F.col("doc_id") % 7)
    return F.when(share >= 50, V._item("SHARE", "WARN", "share", value=F.col("supplier")))


def _digits(as_of) -> F.Column:
    """Two items where the first digits of a number are large; the cast fails for numbers with letters."""
    first = F.when(F.col("supplier") != "", F.substring("supplier", 1, 3).cast("int"))
    return F.when(first >= 500, F.array(V._item("HIGH", "INFO", "high"), V._item("HIGH", "WARN", "higher", value=first.cast("string"))))


def isolated_rules(spark, sf_dir: str) -> DataFrame:
    """All rules with two added ones, of which each fails for some documents: an ERROR under the rule's name there, all else as without it."""
    V.register_rule("SHARE", _share)
    V.register_rule("HIGH", _digits, many=True)
    try:
        return V.results(V.checked(_documents(spark, sf_dir), AS_OF)).select("doc_id", "ord", "code", "level", "value")
    finally:
        V.unregister_rule("SHARE")
        V.unregister_rule("HIGH")


_PLACE = "row_number() over (partition by doc_id order by case when code like 'BIN%' then 0 when code like 'D%' then 1 else 2 end, code, n) - 1"
_ITEMS = f"""{O.RES.split("res as (")[0]}
a as (select doc_id, n, code, level, value from items"""

ISOLATED_SQL = f"""
with {_ITEMS}
  union all select doc_id, 9, case when doc_id % 7 = 0 then '_rule_SHARE' else 'SHARE' end, case when doc_id % 7 = 0 then 'ERROR' else 'WARN' end, case when doc_id % 7 <> 0 then supplier end from mut where doc_id % 7 in (0, 1, 2)
  union all select doc_id, 10, '_rule_HIGH', 'ERROR', null from mut where supplier <> '' and try_cast(substr(supplier, 1, 3) as integer) is null
  union all select doc_id, 11 + k, 'HIGH', case k when 0 then 'INFO' else 'WARN' end, case k when 1 then cast(cast(substr(supplier, 1, 3) as integer) as varchar) end from mut, (select unnest([0, 1]) as k) where try_cast(substr(supplier, 1, 3) as integer) >= 500)
select doc_id, cast({_PLACE} as integer) as ord, code, level, value from a
"""


def blank_fields(fields: dict[str, str]) -> list[dict]:
    """An item for each of the usual fields that is blank."""
    return [{"code": "BLANK", "level": "WARN", "value": k} for k in ("supplier_BIN", "recipient_BIN", "date_issue", "total_amount") if not fields.get(k, "").strip()]


def large_total(fields: dict[str, str]) -> dict | None:
    """One item or none; totals that aren't numbers make it fail."""
    return {"code": "LARGE", "value": fields["total_amount"]} if float(fields["total_amount"]) >= 100_000 else None


def lateral_rules(spark, sf_dir: str) -> DataFrame:
    """Native rules' results, and those of two Python rules called from SQL as table functions."""
    P.register_rule_function(spark, "blank_fields", blank_fields)
    P.register_rule_function(spark, "large_total", large_total)
    docs = _documents(spark, sf_dir)
    native = V.results(V.checked(docs, AS_OF)).select("doc_id", F.lit("native").alias("rule"), "code", "level", "value", F.lit("").alias("description"))
    called = P.lateral_items(docs, ["blank_fields", "large_total"])
    return native.unionByName(called.select("doc_id", "rule", "code", "level", "value", "description"))


LATERAL_SQL = f"""
with {O.RES},
given as (select doc_id, unnest(['supplier_BIN', 'recipient_BIN', 'date_issue', 'total_amount']) as k, unnest([supplier, buyer, written, total]) as v from mut)
select doc_id, 'native' as rule, code, level, value, '' as description from res
union all select doc_id, 'blank_fields', 'BLANK', 'WARN', k, '' from given where trim(v) = ''
union all select doc_id, 'large_total', 'LARGE', 'INFO', total, '' from mut where try_cast(total as double) >= 100000
union all select doc_id, 'large_total', '_rule_large_total', 'ERROR', null, '_rule_large_total: could not convert string to float: ''' || total || '''' from mut where try_cast(total as double) is null
"""

def _xml(spark, sf_dir: str) -> DataFrame:
    """doc_id, text: mutated invoices with their lines as XML in three layouts by doc_id mod 3, every tenth one broken in one of five ways."""
    item = F.struct(F.col("l_linenumber").cast("int").alias("n"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_quantity").cast("int").alias("qty"))
    made = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").cast("bigint").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    line = lambda x: F.concat(F.lit("<line>"), tag("name", F.concat(F.lit("A &amp; B "), x["n"].cast("string"))), tag("qty", x["qty"].cast("string")), tag("amount", I.money_text(x["cents"])), F.lit("</line>"))
    lines = F.concat(F.lit("<lines>"), F.concat_ws("", F.transform("items", line)), F.lit("</lines>"))
    seller, buyer, day, total = (tag(n, F.col(n)) for n in ("supplier_BIN", "recipient_BIN", "date_issue", "total_amount"))
    layouts = [
        F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<invoice>'), seller, buyer, day, total, lines, F.lit("</invoice>")),
        F.concat(F.lit('<!-- x --><e:esf xmlns:e="urn:e"><e:seller>'), seller, F.lit("</e:seller><e:buyer><e:name>x</e:name>"), buyer, F.lit("</e:buyer>"), day, total, lines, F.lit("</e:esf>\n")),
        F.concat(F.lit("<Документ>\n  <Стороны>"), seller, F.lit("\n"), buyer, F.lit("<supplier_BIN>999</supplier_BIN></Стороны>\n"), total, day, lines, F.lit("</Документ>")),
    ]
    text = F.coalesce(*[F.when(F.col("doc_id") % 3 == k, x) for k, x in enumerate(layouts)])
    k = F.col("doc_id") % 50
    broken = F.when(k == 0, F.substring(text, 1, 100)).when(k == 10, F.replace(text, F.lit("</lines>"), F.lit(""))).when(k == 20, F.replace(text, F.lit("&amp;"), F.lit("&"))).when(k == 30, "").when(k == 40, F.concat(text, text))
    docs = I.mutated(I.invoices(spark, sf_dir), AS_OF).join(made, "doc_id")
    return docs.select("doc_id", F.coalesce(broken, text).alias("text"))


def xml_documents(spark, sf_dir: str) -> DataFrame:
    """Fields and lines of invoices read from XML, and what XML001 says of each in the catalogue that has it."""
    rows = X.parsed(_xml(spark, sf_dir))
    names = ("supplier_BIN", "recipient_BIN", "date_issue", "total_amount")
    sums = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + F.round(x["amount"] * 100).cast("bigint"))
    good = lambda x: F.when(F.col("fields").isNotNull(), x)
    # what is read goes along with the key, so that each text is parsed once and none is joined to itself
    found = F.struct("doc_id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names], good(F.size("lines")).alias("n_lines"), good(sums).alias("lines_cents"), good(F.get("lines", 0)["name"]).alias("first_name"))
    told = C.described(C.coded(X.items_of(rows.select(found.alias("doc_id"), "fields"))), C.versions(spark), ("v2.5",))
    return told.select(F.col("doc_id.doc_id").alias("doc_id"), "code", "level", "message", *[f"doc_id.{c}" for c in (*names, "n_lines", "lines_cents", "first_name")])


XML_SQL = f"""
with {O.MUT},
ln as (select cast(l_orderkey as bigint) as doc_id, count(*) as n_lines, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as lines_cents, min(l_linenumber) as first from lineitem group by 1)
select doc_id, 'XML001' as code, case when doc_id % 10 = 0 then 'ERROR' else 'OK' end as level,
  case when doc_id % 10 = 0 then {O._q(" — ".join(fixed.CATALOGUE_25["XML001"][1:4]))} else {O._q(fixed.CATALOGUE_25["XML001"][4])} end as message,
  case when doc_id % 10 <> 0 then supplier end as supplier_BIN, case when doc_id % 10 <> 0 then buyer end as recipient_BIN, case when doc_id % 10 <> 0 then written end as date_issue, case when doc_id % 10 <> 0 then total end as total_amount,
  case when doc_id % 10 <> 0 then cast(n_lines as integer) end as n_lines, case when doc_id % 10 <> 0 then lines_cents end as lines_cents, case when doc_id % 10 <> 0 then 'A & B ' || first end as first_name
from mut join ln using (doc_id)
"""

#: A second template beside the built-in one.
SMALL = ("Накладная", ["Раздел B", "Раздел А"], [("number", r"БИН \d+", True), ("gtin", r"\b\d{14}\b", True), ("store", "(?i)СКЛАД", False)], [("section_sequence_check", True), ("signature_check", False), ("format_detection", True), ("other", True)])


def _sectioned(spark, sf_dir: str) -> DataFrame:
    docs = I.sectioned(I.invoices(spark, sf_dir)).withColumn("template", F.when(F.col("doc_id") % 2 == 0, fixed.TEMPLATE_NAME).otherwise(SMALL[0]))
    return M.with_template(docs, M.templates(spark).unionByName(spark.createDataFrame([SMALL], M.TEMPLATE)))


def section_order(spark, sf_dir: str) -> DataFrame:
    """Which sections of its template a text misses, has out of order and has twice."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return M.section_order(_sectioned(spark, sf_dir)).select("doc_id", "template", joined("missing"), joined("misplaced"), joined("repeated"), "in_order")


def template_fields(spark, sf_dir: str) -> DataFrame:
    """Fields of two templates in one plan."""
    return M.template_fields(_sectioned(spark, sf_dir))


def template_checks(spark, sf_dir: str) -> DataFrame:
    """The named checks that the templates ask for."""
    return M.template_checks(_sectioned(spark, sf_dir))


_NAMES = "[" + ", ".join(map(O._q, fixed.TEMPLATE_SECTIONS)) + "]"
_FIELDS = [(fixed.TEMPLATE_NAME, f, p, int(r)) for f, (p, r) in fixed.TEMPLATE_FIELDS.items()] + [(SMALL[0], f, p, int(r)) for f, p, r in SMALL[2]]
SECTIONED = f"""{O.INV},
dig as (select *, cast(doc_id % 7 as int) as i, cast((doc_id // 7) % 7 as int) as j, cast((doc_id // 49) % 9 as int) as o, cast((doc_id // 5) % 11 as int) as g,
  ['Дата выписки ' || strftime(day, '%d.%m.%Y'), 'БИН ' || supplier_bin, 'БИН ' || buyer_bin, 'Раздел АБ не раздел', 'виртуальный склад', 'Всего ' || {O._money("cents")}, case when doc_id % 3 > 0 then 'ЭЦП поставщика' else '' end] as body from inv),
txt as (select doc_id, case when doc_id % 2 = 0 then '{fixed.TEMPLATE_NAME}' else '{SMALL[0]}' end as template,
  'ЭСФ' || chr(10) || array_to_string(list_transform(list_filter(list_transform(range(0, 7), lambda k: case k when i then j when j then i else k end), lambda k: k <> o), lambda k: {_NAMES}[k + 1] || '. Текст' || chr(10) || body[k + 1]), chr(10)) || chr(10)
  || case when g < 7 then {_NAMES}[g + 1] || ' (продолжение)' else '' end as text from dig),
sec as (select doc_id, template, text, case when template = '{fixed.TEMPLATE_NAME}' then {_NAMES} else ['Раздел B', 'Раздел А'] end as names from txt),
pl as (select *, list_transform(names, lambda n: greatest(length(regexp_extract(text, '(?s)^(.*?)' || n || '([^\\p{{L}}\\p{{N}}]|$)', 1)) + case when regexp_matches(text, n || '([^\\p{{L}}\\p{{N}}]|$)') then 1 else 0 end, 0)) as p,
  list_transform(names, lambda n: len(regexp_extract_all(text, n || '([^\\p{{L}}\\p{{N}}]|$)')) > 1) as twice from sec)"""

SECTIONS_SQL = f"""
with {SECTIONED},
sub as (select doc_id, p, list_filter(range(1, len(names) + 1), lambda k: (m >> (k - 1)) & 1 = 1) as s from pl, (select unnest(range(0, 128)) as m) where m < (1 << len(names))),
ok as (select doc_id, s from sub where len(list_filter(s, lambda k: p[k] = 0)) = 0 and len(list_filter(range(2, len(s) + 1), lambda x: p[s[x]] <= p[s[x - 1]])) = 0),
best as (select doc_id, s from ok qualify row_number() over (partition by doc_id order by len(s) desc, s) = 1),
r as (select doc_id, template, array_to_string(list_transform(list_filter(range(1, len(names) + 1), lambda k: p[k] = 0), lambda k: names[k]), ',') as missing,
  array_to_string(list_transform(list_filter(range(1, len(names) + 1), lambda k: p[k] > 0 and not list_contains(s, k)), lambda k: names[k]), ',') as misplaced,
  array_to_string(list_transform(list_filter(range(1, len(names) + 1), lambda k: twice[k]), lambda k: names[k]), ',') as repeated from pl join best using (doc_id))
select *, missing = '' and misplaced = '' as in_order from r
"""

_SENSE = "replace(replace(replace(pattern, '(?i)эцп', '[эЭ][цЦ][пП]'), '(?i)виртуальный склад', '(?i)виртуальный склад'), '(?i)СКЛАД', '[сС][кК][лЛ][аА][дД]')"
FIELDS_SQL = f"""
with {SECTIONED},
f as {O._values(_FIELDS, "template, field, pattern, required")},
x as (select doc_id, f.template, field, required = 1 as required, regexp_extract_all(text, {_SENSE}) as every from txt join f on txt.template = f.template)
select doc_id, template, field, required, every[1] as value, cast(len(every) as integer) as n_found, case when len(every) > 0 then 'OK' when required then 'ERROR' else 'INFO' end as level from x
"""

CHECKS_SQL = f"""
with {SECTIONS_SQL.strip().removeprefix("with").replace("select *, missing = '' and misplaced = '' as in_order from r", "")},
f as {O._values(_FIELDS, "template, field, pattern, required")},
mt as (select doc_id, count(*) as n, count(*) filter (regexp_matches(text, {_SENSE})) as k from txt join f on txt.template = f.template where required = 1 group by doc_id),
a as (select doc_id, template, text, missing = '' and misplaced = '' as in_order, case when missing = '' then 0 else len(string_split(missing, ',')) end as gone, case template when '{SMALL[0]}' then 2 else 7 end as ns, n, k
  from r join txt using (doc_id, template) join mt using (doc_id))
select doc_id, template, 'section_sequence_check' as "check", in_order as passed from a
union all select doc_id, template, 'binary_fields_presence', len(list_distinct(regexp_extract_all(text, '\\b\\d{{12}}\\b'))) >= 2 from a where template = '{fixed.TEMPLATE_NAME}'
union all select doc_id, template, 'signature_check', contains(text, 'ЭЦП') from a where template = '{fixed.TEMPLATE_NAME}'
union all select doc_id, template, 'format_detection', 2 * (k + ns - gone) > n + ns from a
union all select doc_id, template, 'other', null from a where template = '{SMALL[0]}'
"""


def keyword_roles(spark, sf_dir: str) -> DataFrame:
    """Votes of keywords in two languages, over invoices in one of them or both."""
    return K.keyword_roles(I.bilingual(I.invoices(spark, sf_dir)), K.keyword_index(K.built_in(spark)))


def keyword_formats(spark, sf_dir: str) -> DataFrame:
    """A document's language, the roles that have keywords of it, and whether these make an invoice."""
    return K.recognised(keyword_roles(spark, sf_dir)).select("doc_id", "language", F.array_join("roles", ",").alias("roles"), "is_invoice")


_RU = f"concat_ws(chr(10), 'Поставщик, БИН: ' || supplier_bin, 'Покупатель: ' || buyer_bin, case when doc_id % 5 = 0 then '' else 'Дата выписки: ' || strftime(day, '%d.%m.%Y') end, 'ВСЕГО К ОПЛАТЕ ' || {O._money('cents')})"
_KK = f"concat_ws(chr(10), 'Жеткізуші БСН: ' || supplier_bin, 'Сатып алушы: ' || buyer_bin, case when doc_id % 5 = 0 then '' else 'Күні ' || strftime(day, '%d.%m.%Y') end, 'Төлеуге тиіс сома: ' || {O._money('cents')})"
_WORDS = [(a, r, w) for a, roles in fixed.KEYWORDS.items() for r, words in roles.items() for w in words]
KEYWORDS_SQL = f"""
with {O.INV},
txt as (select doc_id, case doc_id % 3 when 0 then {_RU} when 1 then {_KK} else {_KK} || chr(10) || {_RU} end as text from inv),
w as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), '  ') || ' ' as line from txt),
k as {O._values(_WORDS, "language, role, keyword")},
n as (select doc_id, language, role, keyword, (length(line) - length(replace(line, ' ' || replace(keyword, ' ', '  ') || ' ', ''))) // (length(replace(keyword, ' ', '  ')) + 2) as n from w, k),
v as (select doc_id, language, role, cast(sum(n) as bigint) as n_places, count(*) filter (n > 0) as n_keywords from n group by all having sum(n) > 0),
b as (select doc_id, language, row_number() over (partition by doc_id order by sum(n_places) desc, count(*) desc, language) as p from v group by doc_id, language)
select v.doc_id, v.language, role, n_places, n_keywords, b.p = 1 as is_language from v join b on v.doc_id = b.doc_id and v.language = b.language
"""
FORMATS_SQL = f"""
with v as ({KEYWORDS_SQL}),
r as (select doc_id, language, string_agg(role, ',' order by role) as roles, count(*) as n from v where is_language group by all)
select doc_id, language, roles, n = 4 as is_invoice from r
"""

QUERIES = {f.__name__: f for f in (catalogue_results, isolated_rules, lateral_rules, xml_documents, section_order, template_fields, template_checks, keyword_roles, keyword_formats)}
ORACLE_SQL = {
    "catalogue_results": CATALOGUE_SQL, "isolated_rules": ISOLATED_SQL, "lateral_rules": LATERAL_SQL, "xml_documents": XML_SQL, "section_order": SECTIONS_SQL,
    "template_fields": FIELDS_SQL, "template_checks": CHECKS_SQL, "keyword_roles": KEYWORDS_SQL, "keyword_formats": FORMATS_SQL,
}
