"""The registered queries in DuckDB's SQL, written against the tables alone."""

from __future__ import annotations

from kerege.functions import fixed
from kerege.functions.scalars import plain_key
from kerege.sources.invoices import AS_OF


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(select * from (values " + ", ".join("(" + ", ".join("null" if x is None else str(x) if isinstance(x, int) else _q(x) for x in r) + ")" for r in rows) + f") as _v({names}))"


def _money(c: str) -> str:
    return f"(case when {c} < 0 then '-' else '' end || cast(abs({c}) // 100 as varchar) || '.' || lpad(cast(abs({c}) % 100 as varchar), 2, '0'))"


def _number(key: str, factor: int, offset: int) -> str:
    return f"lpad(cast((cast({key} as bigint) * {factor} + {offset}) % 1000000000000 as varchar), 12, '0')"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _holds(x: str) -> str:
    at = lambda i: f"cast(substr({_digits(x)}, {i}, 1) as integer)"
    total = lambda first: "((" + " + ".join(f"{at(i)} * {i + first - 1}" for i in range(1, 12)) + ") % 11)"
    return f"(case when length({_digits(x)}) <> 12 then false when {total(1)} <> 10 then {total(1)} = {at(12)} else {total(3)} = {at(12)} end)"


INV = f"""
t as (select l_orderkey as k, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents, min(l_suppkey) as sk, count(*) as n_lines from lineitem group by l_orderkey),
inv as (select cast(o_orderkey as bigint) as doc_id, {_number("sk", 7919000017, 104729)} as supplier_bin, {_number("o_custkey", 6700417003, 15485863)} as buyer_bin, cast(o_orderdate as date) as day, cents, n_lines
  from orders join t on o_orderkey = k)"""

_CODES = [m[0] for m in fixed.MUTATIONS]


def _case(column: str, **values: str) -> str:
    return "case doc_id % 22 " + " ".join(f"when {_CODES.index(c) + 1} then {v}" for c, v in values.items()) + f" else {column} end"


MUT = f"""{INV},
mut as (select doc_id, cast(doc_id % 22 as integer) as m,
  {_case("supplier_bin", ID001="'12345'", BIN001="''", BIN003="'1234567'", BIN006="'AB1234567890'")} as supplier,
  {_case("buyer_bin", ID002="'12345'", BIN002="''", BIN004="'12AB56789012'", BIN005="'98765'", BIN007="supplier_bin")} as buyer,
  {_case("strftime(day, '%Y-%m-%d')", D000="''", D001=f"strftime(date '{AS_OF}' + 5, '%Y-%m-%d')", D002="'2025/13/99'", D003="'1998-01-01'", D004=f"strftime(date '{AS_OF}', '%d.%m.%Y')")} as written,
  {_case(_money("cents"), TOT001=_money("(cents + 1000)"), TOT003="'0'", TOT004=_money("(cents + 1)"), NEG001=_money("(-cents)"), AMT001="'ABC'")} as total from inv)"""

_OK = [(c, None, t, "", "") for c, t in fixed.OK_TITLES.items()] + [("BIN007", None, *fixed.BIN007_OK)] + [("BIN012", r, fixed.CHECKSUM_OK.format(role=r), "", "") for r in fixed.ROLES]

def _results(mut: str) -> str:
    """Rule results of a table mut (doc_id, supplier, buyer, written, total)."""
    return f"""{mut},
f as (select *, coalesce(try_cast(try_strptime(written, '%Y-%m-%d') as date), try_cast(try_strptime(written, '%d.%m.%Y') as date)) as d, try_cast(total as double) as num from mut),
g as (select *, coalesce(strftime(d, '%Y-%m-%d'), written) as shown, (num is not null and abs(num - round(num)) < 1e-9 and round(num) between 1 and 12) as idx from f),
raw as (
  select doc_id, 0 as n, 'BIN001' as code, null as role, length({_digits("supplier")}) = 12 as ok, supplier as value from g
  union all select doc_id, 1, 'BIN002', null, length({_digits("buyer")}) = 12, buyer from g
  union all select doc_id, 2, 'BIN007', null, supplier <> buyer, supplier || '/' || buyer from g where supplier <> '' and buyer <> ''
  union all select doc_id, 3, 'D000', null, d is not null, shown from g
  union all select doc_id, 4, 'D001', null, not coalesce(d > date '{AS_OF}', false), shown from g
  union all select doc_id, 5, 'TOT001', null, not idx and coalesce(num > 0, false), case when idx then null else nullif(total, '') end from g
  union all select doc_id, 6, 'NEG001', null, false, total from g where num < 0
  union all select doc_id, 7, 'BIN012', '{fixed.ROLES[0]}', {_holds("supplier")}, supplier from g where length({_digits("supplier")}) = 12
  union all select doc_id, 8, 'BIN012', '{fixed.ROLES[1]}', {_holds("buyer")}, buyer from g where length({_digits("buyer")}) = 12),
cat as {_values([(c, *v) for c, v in fixed.CATALOGUE.items()], "code, level, title, description, recommendation")},
okt as {_values(_OK, "code, role, title, description, recommendation")},
items as (select doc_id, n, raw.code, case when ok then 'OK' else cat.level end as level,
  case when ok then okt.title else cat.title || coalesce(' (' || raw.role || ')', '') end as title,
  case when ok then okt.description else cat.description end as description, case when ok then okt.recommendation else cat.recommendation end as recommendation, value
  from raw join cat on raw.code = cat.code left join okt on raw.code = okt.code and raw.role is not distinct from okt.role),
res as (select doc_id, cast(row_number() over (partition by doc_id order by case when code like 'BIN%' then 0 when code like 'D%' then 1 else 2 end, code, n) - 1 as integer) as ord, code, level,
  concat_ws(' — ', nullif(title, ''), nullif(description, ''), nullif(recommendation, '')) || coalesce(' [значение: ' || value || ']', '') as message, value from items)"""


RES = _results(MUT)

_GROUP = "case when code like 'BIN%' then 'BIN' when code like 'D0%' then 'DATE' when code like 'TOT%' or code like 'NEG%' then 'SUM' else regexp_extract(code, '^[A-Za-z]+') end"
_TITLE = "case group_key " + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.GROUP_TITLES.items()) + " end"
REP = f"""{RES},
keyed as (select *, {_GROUP} as group_key, case level when 'ERROR' then 3 when 'WARN' then 2 else 1 end as sev from res),
best as (select *, row_number() over (partition by doc_id, group_key order by sev desc, ord) as k, count(*) over (partition by doc_id, group_key) as n_items from keyed),
rep as (select doc_id, group_key, 9999 as place, {_TITLE} as title, n_items, code, level,
  case level when 'ERROR' then 'Ошибка' when 'WARN' then 'Предупреждение' else 'ОК' end as label, case level when 'ERROR' then '✖' when 'WARN' then '⚠' else '☑' end as icon, message from best where k = 1)"""
VER = f"""{REP},
vg as (select doc_id, group_key, min(ord) as first, count(*) filter (level = 'ERROR') as e, count(*) filter (level = 'WARN') as w, count(*) as n from keyed group by all),
ver as (select doc_id, case when sum(e) > 0 then 'ERROR' when sum(w) > 0 then 'WARN' else 'OK' end as verdict, coalesce(string_agg(group_key, ', ' order by first) filter (e > 0), '') as bad_groups,
  cast(sum(n) - sum(e) - sum(w) as bigint) as n_ok, cast(sum(w) as bigint) as n_warn, cast(sum(e) as bigint) as n_error from vg group by doc_id)"""

_T = fixed.SUMMARY_TEXTS
SUM = f"""{RES},
names as {_values(list(fixed.SUMMARY_LABELS.items()), "code, name")},
marks as (select doc_id, code, level, min(case level when 'ERROR' then ord else ord + 1000 end) as pos from res where level <> 'OK' group by all),
named as (select doc_id, name, min(pos) as pos from marks join names using (code) group by all),
parts as (select doc_id, list(name order by pos) as p from named group by doc_id),
sets as (select doc_id, list(code) filter (level = 'ERROR') as e, list(code) filter (level = 'WARN') as w, string_agg(distinct code, ',' order by code) as affected from marks group by doc_id),
docs as (select distinct doc_id from res),
summary as (select docs.doc_id, case when e is not null then 'error' when w is not null then 'warn' else 'ok' end as status, coalesce(e, []) as e, coalesce(w, []) as w, coalesce(p, []) as p, coalesce(affected, '') as affected
  from docs left join sets using (doc_id) left join parts using (doc_id))
select doc_id, status, case status when 'error' then 'Есть ошибки' when 'warn' then 'Есть предупреждения' else 'Документ корректен' end as title,
  case when status = 'ok' then {_q(_T["clean"])} when list_contains(e, 'BIN001') and list_contains(e, 'BIN002') then {_q(_T["both"])}
  when list_contains(w, 'BIN007') and len(e) = 0 then {_q(_T["equal"])} when list_contains(e, 'D001') then {_q(_T["future"])}
  when list_contains(w, 'BIN012') and len(e) = 0 then {_q(_T["checksum"])} when len(p) = 1 then 'Обнаружено: ' || p[1] || '.' when len(p) = 2 then 'Обнаружено: ' || p[1] || ' и ' || p[2] || '.'
  when len(p) <= 4 then 'Обнаружены: ' || array_to_string(p[1:len(p) - 1], ', ') || ' и ' || p[len(p)] || '.' else {_q(_T["many"])} end as message, affected from summary"""

_MONTH = "[" + ", ".join(map(_q, fixed.MONTHS)) + "]"
TXT = f"""{INV},
txt as (select doc_id, day, case doc_id % 4
  when 0 then concat_ws(chr(10), 'СЧЕТ-ФАКТУРА № ' || doc_id || ' от ' || strftime(day, '%d.%m.%Y'), 'БИН поставщика: ' || supplier_bin, 'БИН покупателя: ' || buyer_bin, 'Итого с НДС: ' || {_money("cents")} || ' KZT')
  when 1 then concat_ws(chr(10), 'Письмо', 'ЭСФ', 'Дата выписки: ' || strftime(day, '%d.%m.%Y'), 'ИИН/БИН поставщика - ' || supplier_bin, 'БИН получателя ' || buyer_bin, 'Всего к оплате ' || {_money("cents")}, 'Приложение 1')
  when 2 then concat_ws(chr(10), 'Tax Invoice ' || doc_id, 'БИН поставщика:', 'БИН покупателя: ' || buyer_bin, day(day) || ' ' || {_MONTH}[month(day)] || ' ' || year(day), 'Итого: ' || {_money("cents")} || ' тенге')
  else concat_ws(chr(10), 'Накладная ' || strftime(day, '%d.%m.%Y'), 'BIN seller ' || supplier_bin, 'BIN buyer ' || buyer_bin, 'Количество 12', 'Total ' || {_money("cents")}) end as text from inv)"""

_WS = "' ' || chr(10) || chr(160)"


def _extract(text: str, pattern: str, group: int, flags: str = "(?i)") -> str:
    return f"regexp_extract({text}, {_q(flags + pattern)}, {group})"


def _first(parts: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ", '')"


def _labelled(labels: list[str]) -> str:
    import re

    return _first([f"trim({_extract('text', rf'(?:{x})[^\d]{{0,80}}(\d[\d \-' + chr(39) + r'.]{3,})', re.compile(x).groups + 1)}, {_WS})" for x in labels])


def _clean_number(x: str) -> str:
    return f"try_cast(replace(translate({x}, '   ''’‘', ''), ',', '.') as double)"


def _moneylike(x: str) -> str:
    return f"({x} <> '' and (regexp_matches({x}, '[,.’'']') or length({_digits(x)}) between 3 and 8))"


def _clear(start: str, length: str) -> str:
    low = f"greatest({start} - 40, 1)"
    return f"not regexp_matches(lower(substr(text, {low}, {start} + {length} + 40 - {low})), 'бин|ийн|iin|bin')"


def _preferred() -> str:
    parts = []
    for label in fixed.PREFERRED_TOTALS:
        whole, raw = (_extract("text", rf"{label}[^\d]{{0,220}}{fixed.MONEY}", g, "(?is)") for g in (0, 1))
        value = f"trim({raw}, {_WS})"
        start = f"(strpos(text, {whole}) + length({whole}) - length({raw}))"
        parts.append(f"case when {whole} <> '' and {_moneylike(value)} and {_clean_number(value)} is not null and {_clear(start, f'length({raw})')} then {value} end")
    return "coalesce(" + ", ".join(parts) + ", '')"


_LABELS = "(?:" + "|".join(fixed.TOTAL_LABELS) + ")"
_SHAPES = (rf"{_LABELS}\s*[:\-]?\s*[^\d\n\r]{{0,140}}{fixed.MONEY}", rf"{fixed.MONEY}[^\d\n\r]{{0,140}}{_LABELS}")


def _matches(k: int) -> str:
    all_ = lambda g: f"regexp_extract_all(text, {_q('(?i)' + _SHAPES[k])}, {g})"
    return f"select doc_id, text, {k} as shape, unnest({all_(0)}) as whole, unnest({all_(1)}) as raw, unnest(range(1, len({all_(0)}) + 1)) as i from txt"


SCORED = f"""{TXT},
m as ({_matches(0)} union all {_matches(1)}),
p as (select *, strpos(text, whole) + case shape when 0 then length(whole) - length(raw) else 0 end as start, trim(raw, {_WS}) as value from m),
c as (select doc_id, value, {_clean_number("value")} as number, case when regexp_matches(value, '[,.’'']') then 2 else 0 end + case when length({_digits("value")}) >= 4 then 1 else 0 end as score, shape * 1000000 + i as place
  from p where {_moneylike("value")} and {_clear("start", "length(raw)")}),
w as (select doc_id, value, row_number() over (partition by doc_id order by score desc, number desc, place desc) as k from c where number is not null)"""


def _any(patterns: list[str]) -> str:
    return _first([_extract("text", p, 1) for p in patterns])


_EVERY = f"regexp_extract_all(text, {_q('(?i)' + fixed.PDF_ANY)}, 1)"
_SUMS = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, {_q('(?i)' + p)}, 1)" for p in fixed.PDF_TOTALS[:2]) + "), list_concat(" + ", ".join(f"regexp_extract_all(text, {_q('(?i)' + p)}, 1)" for p in fixed.PDF_TOTALS[2:]) + "))"

CELLS = f"""{INV},
cl as (
  select doc_id, unnest([5, 5, 10, 10, 17, 17, 41, 41]) as r, unnest([1, 2, 1, 3, 1, 2, 1, 2]) as c, unnest(['Дата выписки', strftime(day, '%d.%m.%Y'), 'БИН поставщика', supplier_bin, 'БИН покупателя', buyer_bin, 'Всего с НДС', {_money("cents")}]) as v from inv where doc_id % 3 = 0
  union all select doc_id, unnest([3, 3, 4, 12, 12, 13, 20, 22, 1]), unnest([2, 4, 3, 2, 4, 3, 2, 2, 1]), unnest(['Поставщик', 'БИН', supplier_bin, 'Покупатель', 'БИН', buyer_bin, 'Итого к оплате', {_money("cents")}, 'Счет от ' || strftime(day, '%d.%m.%Y')]) from inv where doc_id % 3 = 1
  union all select doc_id, unnest([2, 4, 8, 8, 9, 10, 15, 15, 15, 30, 30]), unnest([1, 1, 1, 9, 5, 5, 1, 2, 3, 1, 2]), unnest(['Поставщик БИН', supplier_bin, 'Грузополучатель, БИН', buyer_bin, 'Дата', strftime(day, '%d.%m.%Y'), 'Всего без НДС', 'н/д', {_money("cents")}, 'Всего без НДС', '7.5']) from inv where doc_id % 3 = 2)"""


def _moves(offsets: list[tuple[int, int]]) -> str:
    return _values([(k, a, b) for k, (a, b) in enumerate(offsets)], "k, dr, dc")


_ID, _SUP, _BUY = "regexp_matches(lower({}), 'бин|иин|iin|bin')", "regexp_matches(lower({}), 'поставщик|продавец|продавц[ау]|продавцом|supplier|seller')", "regexp_matches(lower({}), 'покупател[ьяю]|покупателем|получател[ья]|получателю|получателем|заказчик|buyer|customer|recipient')"
_STRICT = f"(length({_digits('{0}')}) = 12 and {_digits('{0}')} <> repeat(left({_digits('{0}')}, 1), 12))"
_JOINED = "select a.*, k, a.r + dr as r2, a.c + dc as c2, b.v as v2 from {0} a, {1} o, cl b where b.doc_id = a.doc_id and b.r = a.r + dr and b.c = a.c + dc"
LABELLED = f"""{CELLS},
lab as (select *, 'supplier_bin' as role from cl where {_ID.format("v")} and {_SUP.format("v")} union all select *, 'buyer_bin' from cl where {_ID.format("v")} and {_BUY.format("v")}),
near as ({_JOINED.format("lab", _moves([(0, 0), *[(0, k) for k in range(1, 9)], *[(k, 0) for k in range(1, 5)]]))}),
pick as (select *, row_number() over (partition by doc_id, role order by r, c, k) as p from near where {_STRICT.format("v2")})"""
CONTEXT = f"""{CELLS},
num as (select * from cl where {_STRICT.format("v")}),
near as ({_JOINED.format("num", _moves([(a, b) for a in range(-3, 4) for b in range(-3, 4)]))}),
ctx as (select doc_id, r, c, v, string_agg(lower(v2), ' ' order by r2, c2) as x from near group by all),
tag as (select doc_id, r, c, v, {_SUP.format("x")} as s, {_BUY.format("x")} as b from ctx where {_ID.format("x")}),
sup as (select doc_id, r, c, v, row_number() over (partition by doc_id order by r, c) as p from tag where s),
buy as (select tag.doc_id, tag.r, tag.c, tag.v, row_number() over (partition by tag.doc_id order by tag.r, tag.c) as p from tag left join sup on sup.doc_id = tag.doc_id and sup.p = 1 where b and not coalesce(sup.r = tag.r and sup.c = tag.c, false))"""
_KIND = "case lower(v) when 'всего с ндс' then 'total_gross' when 'итого к оплате' then 'total_amount' when 'всего без ндс' then 'total_net' end"
TOTALS = f"""{CELLS},
lab as (select *, {_KIND} as kind from cl where {_KIND} is not null),
near as ({_JOINED.format("lab", _moves([(0, 0), *[(0, k) for k in range(1, 6)], *[(k, 0) for k in range(1, 4)]]))}),
num as (select *, try_cast(replace(replace(regexp_extract(lower(v2), '(-?\\d[\\d\\s,.]*)', 1), ' ', ''), ',', '.') as double) as amount from near),
one as (select *, row_number() over (partition by doc_id, kind, r, c order by k) as p from num where amount is not null),
two as (select doc_id, kind, amount, case kind when 'total_amount' then 'TOTAL' else upper(kind) end || '@R' || r2 || 'C' || c2 as trace, row_number() over (partition by doc_id, kind order by r desc, c desc) as q from one where p = 1),
found as (select doc_id, kind, amount, trace from two where q = 1),
top as (select *, row_number() over (partition by doc_id order by kind desc) as z from found where kind in ('total_gross', 'total_amount'))"""


def _alike(key: str, alias: str) -> str:
    n = len(alias)
    same = "(" + " + ".join(f"case when substr({key}, {i + 1}, 1) = {_q(ch)} then 1 else 0 end" for i, ch in enumerate(alias)) + ")"
    return f"(case when {key} = {_q(alias)} then 1.0 else cast({same} as double) / greatest(length({key}), {n}) end)"


_CLEAN = "trim(regexp_replace(text, '[\\s\\x{00A0}\\x{200B}\\x{200E}\\x{202F}\\x{2000}-\\x{200A}\\x{3000}\\x{0085}]+', ' ', 'g'))"
_KEY = f"replace(replace(lower({_CLEAN}), '№', 'номер'), 'счёт', 'счет')"
_TYPES = "[" + ", ".join("(" + " + ".join(f"case when contains(text, {_q(w)}) then 1 else 0 end" for w in words) + ")" for words in fixed.DOCUMENT_TYPES.values()) + "]"
_LINES = f"""
lines as (select l_orderkey, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as lines_cents from lineitem group by 1),
tot as (select cast(o_orderkey as bigint) as doc_id, lines_cents, cast(round(o_totalprice * 100) as bigint) as total_cents from orders left join lines on o_orderkey = l_orderkey)"""


def _within(a: str, b: str) -> str:
    return f"coalesce({a} = {b} or abs({a} - {b}) <= 0.5 or ({b} <> 0 and abs({a} - {b}) / abs({b}) <= 0.0005), false)"


_TRUTH = _values([(k + 1, *m) for k, m in enumerate(fixed.MUTATIONS)], "m, check_code, expected_status, expected_message")
_CATALOGUE = _values([(c, *v) for c, v in fixed.CATALOGUE.items()], "code, level, title, description, recommendation")
_FINDINGS = {
    "QTY001": "l_quantity is null or l_quantity = 0",
    "QTY002": "l_quantity < 0",
    "PRICE001": "l_extendedprice is null or l_extendedprice < 0",
    "DISC001": "l_discount > 0",
    "DISC002": "l_discount > 0.5",
    "VAT001": "l_tax is null",
    "VAT003": "l_tax = 0",
}
_WHOLE = "cast(o_totalprice_c // 100 as varchar)"

ORACLE_SQL = {
    "invoice_base": f"with {INV} select * from inv",
    "bin_clean": f"select cast(c_custkey as bigint) as key, {_digits('c_name')} as digits, length({_digits('c_name')}) = 12 as lenient, {_STRICT.format('c_name')} as strict from customer",
    "bin_strict_vs_lenient": f"""with n as (select cast(s_suppkey as bigint) as key, case s_suppkey % 5 when 0 then '111111111111' when 1 then 'AB ' || {_number("s_suppkey", 7919000017, 104729)} when 2 then '12345' else {_number("s_suppkey", 7919000017, 104729)} end as number from supplier)
select key, number, length({_digits("number")}) = 12 as lenient, {_STRICT.format("number")} as strict from n""",
    "bin_checksum": f"with {INV} select doc_id, {_holds('supplier_bin')} as supplier_holds, {_holds('buyer_bin')} as buyer_holds from inv",
    "parse_number_variants": f"""with o as (select cast(o_orderkey as bigint) as key, cast(round(o_totalprice * 100) as bigint) as o_totalprice_c from orders),
n as (select key, {_WHOLE} as w, lpad(cast(o_totalprice_c % 100 as varchar), 2, '0') as p from o),
x as (select key, case key % 6 when 0 then w || ',' || p when 1 then ' 1 ' || w || '.' || p when 2 then '1''' || w || ',' || p || ' ' when 3 then '1,' || w || '.' || p when 4 then '-' || w else w || 'd' end as text from n)
select key, text, {_clean_number("text")} as number from x""",
    "parse_date_variants": f"""with n as (select cast(o_orderkey as bigint) as key, cast(o_orderdate as date) as d from orders),
x as (select key, d, case key % 6 when 0 then strftime(d, '%Y-%m-%d') when 1 then day(d) || '.' || month(d) || '.' || year(d) when 2 then strftime(d, '%d/%m/%Y') when 3 then strftime(d, '%Y.%m.%d')
  when 4 then 'от «' || day(d) || '» ' || {_MONTH}[month(d)] || ' ' || year(d) || ' г.' else '31.02.' || year(d) end as text from n)
select key, text, case when key % 6 in (0, 1, 2, 4) then d end as found, case when key % 6 in (0, 1, 2, 3) then d end as exact from x""",
    "excel_serial_dates": "select cast(o_orderkey as bigint) as key, cast(datediff('day', date '1899-12-30', cast(o_orderdate as date)) as integer) as serial, strftime(cast(o_orderdate as date), '%Y-%m-%d') as day from orders",
    "rule_results_long": f"with {RES} select doc_id, ord, code, level, message, value from res",
    "rule_counts": f"with {RES} select code, level, count(*) as n from res group by all",
    "group_report": f"with {REP} select * from rep",
    "doc_verdict": f"with {VER} select * from ver",
    "doc_summary": f"with {SUM}",
    "text_bin_extract": f"with {TXT} select doc_id, {_labelled(fixed.SUPPLIER_LABELS)} as supplier, {_labelled(fixed.BUYER_LABELS)} as buyer from txt",
    "text_date_extract": f"""with {TXT} select doc_id, {_first([_extract("text", h + fixed.ANY_DATE, 1) for h in fixed.HEADER_DATES])} as header_date,
  coalesce({", ".join(f"nullif({_extract('text', x + chr(92) + 's*' + fixed.ANY_DATE, 1)}, '')" for x in fixed.DATE_LABELS)}, case when doc_id % 4 = 2 then strftime(day, '%d.%m.%Y') end, regexp_extract(text, '\\b\\d{{2}}[./-]\\d{{2}}[./-]\\d{{4}}\\b')) as body_date from txt""",
    "text_total_priority": f"with {TXT} select doc_id, {_preferred()} as total from txt",
    "text_total_scored": f"with {SCORED} select txt.doc_id, coalesce(value, '') as total from txt left join w on txt.doc_id = w.doc_id and w.k = 1",
    "pdf_facts": f"""with {TXT} select doc_id, coalesce(nullif({_any(fixed.PDF_SUPPLIER)}, ''), {_EVERY}[1], '') as supplier, coalesce(nullif({_any(fixed.PDF_BUYER)}, ''), {_EVERY}[2], '') as buyer,
  regexp_replace({_any(fixed.PDF_DATES)}, '\\s*[./-]\\s*', '.', 'g') as day, trim(replace(translate(coalesce({_SUMS}[-1], ''), '  ', ''), ',', '.'), {_WS}) as total from txt""",
    "esf_section": f"""with {TXT} select doc_id, case doc_id % 4 when 0 then '' when 1 then trim(substr(text, strpos(text, 'ЭСФ'), strpos(text, 'Приложение') - strpos(text, 'ЭСФ')), {_WS}) when 2 then substr(text, strpos(text, 'Tax Invoice')) else text end as section from txt""",
    "clean_text_key": f"select doc_id, md5({_CLEAN}) as text_md5, md5(trim(regexp_replace(regexp_replace({_KEY}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))) as key_md5 from documents",
    "header_similarity": "with k as (select cast(p_partkey as bigint) as key, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')) as h from part), x as (select key, "
    + ", ".join(f"round(greatest(0.0, {', '.join(_alike('h', plain_key(a)) for a in aliases)}), 6) as {kind}" for kind, aliases in fixed.HEADER_ALIASES.items() if aliases)
    + " from k) select *, total_amount >= 0.3 as alike from x",
    # the moved places are made first, so that the join is on plain columns
    "cell_neighbours": f"""with {CELLS.replace("cl as (", "cl as materialized (")}
select a.doc_id, a.r, a.c, a.v, 0 as k, a.r as r2, a.c - 1 as c2, b.v as v2 from cl a join cl b on b.doc_id = a.doc_id and b.r = a.r and b.c = a.c - 1
union all select a.doc_id, a.r, a.c, a.v, 1, a.r - 1, a.c, b.v from cl a join cl b on b.doc_id = a.doc_id and b.r = a.r - 1 and b.c = a.c""",
    "cell_bin_label": f"with {LABELLED} select doc_id, role, {_digits('v2')} as bin, 'LABEL@R' || r || 'C' || c || '->R' || r2 || 'C' || c2 as trace from pick where p = 1",
    "cell_bin_context": f"with {CONTEXT} select doc_id, 'supplier_bin' as role, {_digits('v')} as bin, 'CTX@R' || r || 'C' || c as trace from sup where p = 1 union all select doc_id, 'buyer_bin', {_digits('v')}, 'CTX@R' || r || 'C' || c from buy where p = 1",
    "cell_dates": f"with {CELLS} select doc_id, strftime(day, '%Y-%m-%d') as issue_date from inv",
    "cell_totals": f"with {TOTALS} select * from found where kind <> 'total_amount' union all select doc_id, 'total_amount', amount, trace from top where z = 1",
    "doc_type_keywords": f"""with {TXT}, n as (select doc_id, {_TYPES} as n from txt)
select doc_id, case when list_max(n) > 0 then [{", ".join(map(_q, fixed.DOCUMENT_TYPES))}][list_position(n, list_max(n))] else '' end as doc_type, cast(list_max(n) as integer) as n_found from n""",
    "line_total_check": f"with {_LINES} select *, case when lines_cents is null then 'LINE001' when abs(lines_cents - total_cents) > 100 then 'TOT002' when lines_cents <> total_cents then 'TOT001' else 'OK' end as code from tot",
    "line_qty_price_check": " union all ".join(f"select cast(l_orderkey as bigint) as doc_id, '{c}' as code, count(*) as n from lineitem where {x} group by l_orderkey" for c, x in _FINDINGS.items())
    + " union all select cast(l_orderkey as bigint), 'LINE002', count(*) from lineitem group by l_orderkey having count(*) > 1000",
    "line_vat_check": "select cast(l_orderkey as bigint) as doc_id, cast(sum((cast(round(l_extendedprice * 100) as bigint) * cast(round(l_tax * 100) as bigint) + 50) // 100) as bigint) as vat_cents, count(*) filter (cast(round(l_tax * 100) as bigint) = 0) as n_exempt from lineitem group by l_orderkey",
    "tolerance_check": f"with {_LINES}, x as (select doc_id, cast(total_cents as double) / 100.0::double as a, cast(lines_cents as double) / 100.0::double as b from tot) select doc_id, {_within('a', 'b')} as within, {_within('a', '(b * 1.0001::double)')} as within_scaled from x",
    "mutation_truth": f"with {MUT} select doc_id, coalesce(check_code, 'BASE') as check_code, coalesce(expected_status, 'OK') as expected_status, coalesce(expected_message, '') as expected_message from mut left join {_TRUTH} v on mut.m = v.m",
    "confusion_matrix": f"""with {RES}, truth as (select doc_id, check_code, expected_status from mut join {_TRUTH} v on mut.m = v.m),
lv as (select doc_id, code, max(case level when 'ERROR' then 3 when 'WARN' then 2 else 1 end) as s from res group by all)
select check_code, expected_status, case s when 3 then 'ERROR' when 2 then 'WARNING' when 1 then 'OK' else 'NONE' end as actual, count(*) as n from truth left join lv on truth.doc_id = lv.doc_id and check_code = code group by all""",
    "catalog_add": f"select * from {_CATALOGUE} union all select 'VAT001', 'WARN', 'Нет ставки НДС', '', ''",
    "catalog_remove": f"select * from {_CATALOGUE} where code not in ('D001', 'NEG001')",
    "catalog_sync": f"with {RES}, e as (select code from res union select 'VAT001'), c as (select code from {_CATALOGUE} where code <> 'D001') select code, 'missing' as status from e where code not in (select code from c) union all select code, 'unused' from c where code not in (select code from e)",
    "normalize_keys_map": f"with {RES} select doc_id, supplier as supplier_bin, buyer as buyer_bin, case when written <> '' then shown end as issue_date, total as total_amount, '' as total_net from g",
    "report_text": f"""with {VER}, u as (select doc_id, 0 as place, '' as gk, case verdict when 'ERROR' then '❌ Нужны исправления: ' || len(string_split(bad_groups, ', ')) || ' категорий с ошибками (' || bad_groups || ')' when 'WARN' then '⚠ Есть предупреждения (не блокирует отправку).' else '✅ Чики-пыки: критичных ошибок нет.' end as line from ver
  union all select doc_id, 1, group_key || '1', title from rep union all select doc_id, 1, group_key || '2', icon || ' ' || label || ': ' || message from rep
  union all select doc_id, 2, '', '✅ ОК: ' || n_ok || '   ⚠ Предупреждения: ' || n_warn || '   ❌ Ошибки: ' || n_error from ver)
select doc_id, cast(row_number() over (partition by doc_id order by place, gk) - 1 as integer) as line_no, line from u""",
}
_PAIRS = "".join(chr(b) for b in range(0x80, 0x100) if b != 0x98)
ORACLE_SQL["mojibake_fix"] = f"with {TXT} select doc_id, translate(text, {_q(bytes(b for b in range(0x80, 0x100) if b != 0x98).decode('cp1251'))}, {_q(_PAIRS)}) as broken, text as fixed from txt"
ORACLE_SQL |= {f"rule_{code.lower()}": f"with {RES} select doc_id, level, value from items where code = '{code}'" for code in fixed.CATALOGUE}

# documents that are sheets or texts alone: what is found in them, checked as fields are
_SHEETS = f"""{INV},
mut as (select doc_id, supplier_bin as supplier, buyer_bin as buyer, strftime(day, '%Y-%m-%d') as written, case when doc_id % 3 = 2 then '' else {_money("cents")} end as total from inv)"""
_TEXTS = f"""{SCORED},
mut as (select txt.doc_id, {_labelled(fixed.SUPPLIER_LABELS)} as supplier, {_labelled(fixed.BUYER_LABELS)} as buyer,
  coalesce(nullif({_first([_extract("text", h + fixed.ANY_DATE, 1) for h in fixed.HEADER_DATES])}, ''), {", ".join(f"nullif({_extract('text', x + chr(92) + 's*' + fixed.ANY_DATE, 1)}, '')" for x in fixed.DATE_LABELS)}, case when txt.doc_id % 4 = 2 then strftime(day, '%d.%m.%Y') end, regexp_extract(text, '\\b\\d{{2}}[./-]\\d{{2}}[./-]\\d{{4}}\\b')) as written,
  coalesce(nullif({_preferred()}, ''), value, '') as total from txt left join w on txt.doc_id = w.doc_id and w.k = 1)"""
ORACLE_SQL["sheet_rule_counts"] = f"with {_results(_SHEETS)} select code, level, count(*) as n from res group by all"
ORACLE_SQL["text_rule_counts"] = f"with {_results(_TEXTS)} select code, level, count(*) as n from res group by all"
ORACLE_SQL["legacy_rule_counts"] = f"""with {RES}, old as (select * from res where code not in ('BIN007', 'TOT001', 'NEG001') and not (code = 'D001' and doc_id in (select doc_id from g where d is null)))
select code, level, count(*) as n from old group by all"""
ORACLE_SQL["json_documents"] = f"""with {MUT} select doc_id, case when doc_id % 40 not in (0, 10, 20) then supplier end as "supplier_BIN", case when doc_id % 40 not in (0, 10, 20) then buyer end as "recipient_BIN",
case when doc_id % 40 not in (0, 10, 20) then written end as date_issue, case when doc_id % 40 not in (0, 10, 20) then total end as total_amount, case doc_id % 40 when 0 then 'JSON' when 20 then 'E' end as error from mut"""

_ODD = ("nan", "inf", "-inf", "5", "12.0", "13", "1.5", "", "-3", "1 000,50")
ORACLE_SQL["odd_totals"] = f"""with {INV}, tt as (select *, [{", ".join(map(_q, _ODD))}][doc_id % {len(_ODD)} + 1] as total, case when doc_id % 2 = 0 then supplier_bin else buyer_bin end as other from inv)
select doc_id, 'BIN001' as code, 'OK' as level, supplier_bin as value from tt union all select doc_id, 'BIN002', 'OK', other from tt union all select doc_id, 'BIN007', 'OK', supplier_bin || '/' || other from tt
union all select doc_id, 'D000', 'ERROR', '' from tt union all select doc_id, 'D001', 'OK', '' from tt
union all select doc_id, case when total in ('nan', 'inf', '-inf') then '_rule_TOT001' else 'TOT001' end, case when total in ('13', '1.5', '1 000,50') then 'OK' else 'ERROR' end, case when total in ('nan', 'inf', '-inf', '5', '12.0', '') then null else total end from tt
union all select doc_id, 'NEG001', 'WARN', total from tt where total in ('-inf', '-3')"""

_PLACED = """keyed as (select *, case when code like 'BIN%' then 'BIN' when code like 'D%' then 'DATE' else 'SUM' end as group_key, case level when 'ERROR' then 3 when 'WARN' then 2 else 1 end as sev from res),
ranked as (select *, case group_key when 'BIN' then 0 when 'DATE' then 1 else 2 end as place, row_number() over (partition by doc_id, group_key order by sev desc, case code when 'BIN012' then 0 when 'BIN001' then 1 when 'D000' then 0 when 'D001' then 1 when 'NEG001' then 0 else 999 end, ord) as k from keyed),
vg as (select doc_id, group_key, min(ord) as first, count(*) filter (level = 'ERROR') as e, count(*) filter (level = 'WARN') as w, count(*) as n from keyed group by all),
ver as (select doc_id, sum(e) as e, sum(w) as w, sum(n) as n, count(*) filter (e > 0) as bad, string_agg(group_key, ', ' order by first) filter (e > 0) as names from vg group by doc_id)"""
ORACLE_SQL["report_details"] = f"""with {RES}, {_PLACED},
u as (select doc_id, -1 as place, 0 as part, 0 as ord, case when e > 0 then '❌ Нужны исправления: ' || bad || ' категорий с ошибками (' || names || ')' when w > 0 then '⚠ Есть предупреждения (не блокирует отправку).' else '✅ Чики-пыки: критичных ошибок нет.' end as line from ver
  union all select distinct doc_id, place, 1, 0, {_TITLE} from ranked
  union all select doc_id, place, 2, 0, case level when 'ERROR' then '✖ Ошибка: ' when 'WARN' then '⚠ Предупреждение: ' else '☑ ОК: ' end || message from ranked where k = 1
  union all select doc_id, place, 3, ord, '   • ' || message from ranked where k > 1
  union all select doc_id, 9, 0, 0, '✅ ОК: ' || cast(n - e - w as bigint) || '   ⚠ Предупреждения: ' || cast(w as bigint) || '   ❌ Ошибки: ' || cast(e as bigint) from ver)
select doc_id, cast(row_number() over (partition by doc_id order by place, part, ord) - 1 as integer) as line_no, line from u"""

_EXTENDED = f"""
it as (select cast(l_orderkey as bigint) as doc_id, cast(l_linenumber as bigint) as ln, cast(l_quantity as double) as q, cast(l_discount as double) as disc, cast(round(l_extendedprice * 100) as bigint) as cents, cast(round(l_tax * 100) as bigint) as rate from lineitem),
li as (select doc_id, cents, rate, (doc_id + ln) % 67 = 0 as no_uom, (doc_id + ln) % 71 = 0 as no_qty_made, (doc_id + ln) % 73 = 0 as minus, (doc_id + ln) % 79 = 0 as long_price, (doc_id + ln) % 83 = 0 as deep, disc, q, (doc_id + ln) % 97 = 0 and doc_id % 89 <> 0 as bad_rate, doc_id % 89 = 0 as no_rate, (doc_id + ln) % 101 = 0 as plus from it),
lc as (select doc_id, count(*) as n, sum(cents) as lines_cents, count(*) filter (no_rate) as no_rate, count(*) filter (rate = 0 and not no_rate and not bad_rate) as zero_rate, count(*) filter (bad_rate) as bad_rate, count(*) filter (plus and not no_rate and not bad_rate) as wrong_vat,
  count(*) filter (no_qty_made or (not minus and q = 0)) as no_qty, count(*) filter (minus and not no_qty_made) as negative_qty, count(*) filter (no_uom) as no_uom, count(*) filter (long_price) as long_price, count(*) filter (deep or disc > 0) as discounted, count(*) filter (deep or disc > 0.5) as deep from li group by doc_id),
o as (select cast(o_orderkey as bigint) as doc_id, cast(o_orderdate as date) as day, {_number("o_orderkey", 7919000017, 104729)} as own, {_number("o_custkey", 6700417003, 15485863)} as cust from orders),
d as (select o.*, coalesce(n, 0) as n, coalesce(lines_cents, 0) as lc, coalesce(no_rate, 0) as no_rate, coalesce(zero_rate, 0) as zero_rate, coalesce(bad_rate, 0) as bad_rate, coalesce(wrong_vat, 0) as wrong_vat, coalesce(no_qty, 0) as no_qty, coalesce(negative_qty, 0) as negative_qty, coalesce(no_uom, 0) as no_uom,
  coalesce(long_price, 0) as long_price, coalesce(discounted, 0) as discounted, coalesce(deep, 0) as deep,
  case when o.doc_id % 37 = 0 then 0 when o.doc_id % 41 = 0 then -coalesce(lines_cents, 0) when o.doc_id % 7 = 0 then coalesce(lines_cents, 0) + 50 when o.doc_id % 7 = 1 then coalesce(lines_cents, 0) + 500 when o.doc_id % 7 = 2 then coalesce(lines_cents, 0) // 100 * 100 else coalesce(lines_cents, 0) end as tc,
  case when o.doc_id % 17 = 0 then '№ 5/7' when o.doc_id % 17 = 1 then null when o.doc_id % 17 = 2 then 'inv-' || o.doc_id else 'INV-' || o.doc_id end as number,
  case when o.doc_id % 19 = 0 then '12345' else own end as seller, case when o.doc_id % 23 = 0 then own else cust end as buyer, case when o.doc_id % 29 <> 0 then day end as dd,
  case when o.doc_id % 43 = 0 then 'doc' when o.doc_id % 3 = 0 then 'pdf' else 'xls' end as fmt, o.doc_id % 31 = 0 as xxz, o.doc_id % 5 = 0 and o.doc_id % 31 <> 0 as usd from o left join lc on o.doc_id = lc.doc_id),
dn as (select distinct number from d where number is not null)"""
_CLOSE = _within("cast(tc as double) / 100.0::double", "cast(lc as double) / 100.0::double")
_CUT = "tc % 100 = 0 and lc % 100 <> 0 and n > 0"
_SAID = {
    "F001": "fmt = 'doc'", "F002": "n = 0 or number is null", "F003": "fmt = 'pdf' and doc_id % 6 = 0", "D000": "dd is null", "D001": f"dd > date '{AS_OF}'", "D002": "dd not between date '1995-06-01' and date '2000-12-31'",
    "N001": "number is null or number = '№ 5/7'", "ID001": "doc_id % 19 = 0", "ID002": "false", "ID003": "seller = buyer", "CUR001": "xxz", "CUR002": "(xxz or usd) and doc_id % 10 <> 0", "AMT001": "tc = 0", "NEG001": "tc < 0",
    "TOT001": "n > 0 and lc <> tc", "TOT002": "n > 0 and abs(lc - tc) > 100", "ROUND001": f"{_CUT} and {_CLOSE}", "ROUND002": f"{_CUT} and not {_CLOSE}", "VAT001": "n > 0 and no_rate = n", "VAT002": "no_rate > 0 and no_rate < n",
    "VAT003": "n > 0 and zero_rate = n", "VAT004": "bad_rate > 0", "QTY001": "no_qty > 0", "QTY002": "negative_qty > 0", "UOM001": "no_uom > 0", "PRICE002": "long_price > 0", "DISC001": "discounted > 0", "DISC002": "deep > 0",
    "LINE001": "n = 0", "LINE002": "n > 1000", "REF001": "doc_id % 11 = 0", "REF002": "doc_id % 11 = 0 and 'INV-' || (doc_id + 1) not in (select number from dn)", "SIG001": "doc_id % 13 = 0", "SIG002": "doc_id % 13 = 1",
    "META001": "doc_id % 59 = 0 or doc_id % 61 = 0", "META002": "doc_id % 61 = 0", "AUTH001": "doc_id % 47 = 0", "AUTH002": "doc_id % 53 = 0 and doc_id % 47 <> 0",
}
_LATER = {"TOT001": "lc <> tc", "VAT001": "wrong_vat > 0", "ID001": "number = '№ 5/7' or number like 'inv-%'", "ID002": "number is null", "AMT001": "tc <= 0", "NEG001": "tc < 0"}
_FIRST_LEVELS = _values([(k, v[0]) for k, v in fixed.FIRST_CATALOGUE.items()], "code, level")


def _declared(said: dict[str, str]) -> str:
    return " union all ".join(f"select doc_id, '{code}' as code from d where {condition}" for code, condition in said.items())


ORACLE_SQL["extended_rules"] = f"""with {_EXTENDED}, f as (select f.doc_id, f.code, l.level from ({_declared(_SAID)}) f join {_FIRST_LEVELS} l on f.code = l.code)
select * from f union all select doc_id, 'SYS001', 'INFO' from d where doc_id not in (select doc_id from f where level in ('ERROR', 'WARN'))"""
ORACLE_SQL["extended_rules_26"] = f"with {_EXTENDED} select doc_id, code, 'ERROR' as level from ({_declared(_LATER)})"
_HASHES = ", ".join(f"{{'h': md5('42|' || doc_id || '|{c}'), 'code': '{c}'}}" for c in _CODES)
ORACLE_SQL["line_mutations"] = f"""with l as (select cast(l_orderkey as bigint) as doc_id, cast(round(l_extendedprice * 100) as bigint) as cents, cast(round(l_tax * 100) as bigint) as rate from lineitem),
s as (select doc_id, cast(sum(cents) as bigint) as cents, cast(sum((cents * rate + 50) // 100) as bigint) as vat from l group by doc_id),
m as (select *, unnest(list_sort([{_HASHES}])[1:8]).code as mutation from s)
select doc_id, mutation, case mutation when 'TOT003' then 0 when 'TOT001' then cents + 1000 when 'TOT004' then cents + 1 when 'AMT001' then null when 'NEG001' then -cents else cents end as total_cents,
case mutation when 'TOT003' then 0 when 'NEG002' then -vat else vat end as vat_cents,
case mutation when 'TOT003' then 0 when 'TOT002' then (95 * (cents + vat) + 50) // 100 when 'NEG001' then -cents + vat when 'NEG002' then cents - vat else cents + vat end as with_vat_cents from m"""
