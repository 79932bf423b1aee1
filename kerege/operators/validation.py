"""Documents to rule results: normalised fields, facts from fields or text, rules, messages, order.

Input everywhere: documents (doc_id, fields map<string,string>, raw_text); without the column raw_text no plan for texts is made. Each document is one row from start to results, so nothing moves
between tasks until results are grouped.

Items are taken apart by outer explodes and then filtered: for a plain explode the optimizer infers a filter on the array's size and
pushes it below every projection, where each step's expressions are written out again inside the next one's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions.scalars import bound, esf_section, filled as unless_empty, first_of, fix_mojibake, holds_sql, identifier_number, is_bin, parse_date_exact, parse_date_text, parse_number, stripped, to_iso, trimmed
from kerege.operators.text_facts import text_bin, text_date, text_total
from kerege.settings import Settings

_Value = "struct<code:string,level:string,title:string,description:string,recommendation:string,value:string>"


def _sourced(docs: DataFrame) -> DataFrame:
    """docs with __supplier, __buyer, __issue, __iso: what normalisation finds for the canonical fields."""
    given = docs.withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    there = lambda k: F.when(F.map_contains_key("fields", F.lit(k)), _given(k))
    given = given.withColumns(
        {
            "__supplier": F.coalesce(there("supplier_bin"), there("supplier_BIN")),
            "__buyer": F.coalesce(there("buyer_bin"), *[there(k) for k in fixed.BUYER_SOURCES]),
            "__issue": F.coalesce(there("issue_date"), *[F.nullif(_given(k), F.lit("")) for k in fixed.DATE_SOURCES]),
        }
    )
    return given.withColumn("__iso", F.nullif(to_iso(parse_date_text(F.col("__issue"))), F.lit("")))


def _given(key: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit(""))


def _canonical() -> dict[str, Column]:
    """Fields that normalisation sets, over rows of _sourced; null for none."""
    there = lambda k: F.when(F.map_contains_key("fields", F.lit(k)), _given(k))
    return {
        "supplier_bin": F.col("__supplier"),
        "buyer_bin": F.col("__buyer"),
        "issue_date": F.coalesce("__iso", "__issue"),
        "supplier_BIN": F.coalesce(there("supplier_BIN"), F.nullif("__supplier", F.lit(""))),
        "recipient_BIN": F.coalesce(there("recipient_BIN"), F.nullif("__buyer", F.lit(""))),
        "date_issue": F.coalesce(there("date_issue"), F.nullif("__issue", F.lit(""))),
    } | {k: _given(k) for k in fixed.TOTAL_FIELDS}


_SOURCED = ("__supplier", "__buyer", "__issue", "__iso")


def normalized(docs: DataFrame) -> DataFrame:
    """docs with the canonical fields, added where they are missing; the old names too; issue_date in ISO form if it can be read.

    A field that is there but empty counts as there, except that dates are taken from the first filled source. All added
    values come from the given map alone, so the map is rebuilt once and not step by step.
    """
    values = _canonical()
    added = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()]), lambda x: x["v"].isNotNull())
    rest = F.map_filter("fields", lambda k, v: ~k.isin(list(values)))
    return _sourced(docs).withColumn("fields", F.map_concat(rest, F.map_from_entries(added))).drop(*_SOURCED)


def with_texts(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs with full_text (repaired) and section_text; each is made once for each document."""
    if "raw_text" not in docs.columns:
        return docs.withColumns({"full_text": F.lit(""), "section_text": F.lit("")})
    repaired = docs.withColumn("full_text", F.when(F.coalesce("raw_text", F.lit("")) == "", F.lit("")).otherwise(fix_mojibake(F.col("raw_text"))))
    told = settings or Settings()
    section = esf_section(F.col("full_text"), told.section_headers) if told.prefer_section else F.col("full_text")
    return repaired.withColumn("section_text", F.when(F.col("full_text") == "", F.lit("")).otherwise(section))


#: Canonical fields that facts are looked up in first.
_KNOWN = ("supplier_BIN", "supplier_bin", "recipient_BIN", "buyer_bin", "issue_date", "date_issue", "total_amount")


def _first(keys: list[str]) -> Column:
    """The first filled value under these keys, stripped; empty without one. Over the columns __at_<n> of canonical fields and, for documents where the first keys are blank, the map of all others."""
    n = next((k for k, key in enumerate(keys) if key not in _KNOWN), len(keys))
    at = lambda k: F.col(f"__at_{_KNOWN.index(k)}")
    rest = F.array(*[at(k) if k in _KNOWN else _given(k) for k in keys[n:]])
    return F.coalesce(*[F.nullif(at(k), F.lit("")) for k in keys[:n]], *([F.get(F.filter(F.transform(rest, stripped), lambda x: x != ""), 0)] if n < len(keys) else []), F.lit(""))


def with_facts(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs (not yet normalised) with the texts that the rules look at, and their numbers and dates; text is searched only where no field is filled, first the section and then all of it.

    What rules share is a column of its own: expressions that stand in lambdas or under arrays that lambdas go through are interpreted, all others are compiled.
    """
    both = lambda find: F.when(F.col("full_text") == "", F.lit("")).otherwise(F.coalesce(unless_empty(find(F.col("section_text"))), F.when(F.col("section_text") != F.col("full_text"), find(F.col("full_text"))), F.lit("")))
    told = settings or Settings()
    values = _canonical()
    known = _sourced(docs).withColumns({f"__value_{n}": F.coalesce(values[k], F.lit("")) for n, k in enumerate(_KNOWN)})
    known = known.withColumns({f"__at_{n}": trimmed(F.col(f"__value_{n}")) for n in range(len(_KNOWN))})
    facts = known.withColumns(
        {
            "supplier": _first(fixed.SUPPLIER_KEYS),
            "buyer": _first(fixed.BUYER_KEYS),
            "equal_supplier": _first(fixed.EQUAL_SUPPLIER_KEYS),
            "equal_buyer": _first(fixed.EQUAL_BUYER_KEYS),
            "check_supplier": _first(fixed.CHECK_SUPPLIER_KEYS),
            "check_buyer": _first(fixed.CHECK_BUYER_KEYS),
            "date": _first(fixed.DATE_KEYS),
            "future": _first(fixed.FUTURE_KEYS),
            "total": _first(fixed.TOTAL_KEYS),
        }
    ).drop("fields", *_SOURCED, *[f"__{at}_{n}" for at in ("value", "at") for n in range(len(_KNOWN))])
    facts = facts.withColumn("total_number", parse_number(F.col("total")))
    facts = facts.withColumn("indexed", is_table_index(F.col("total_number")))
    texts = ("text_supplier", "text_buyer", "text_date", "text_total")
    facts = facts.withColumns(dict.fromkeys(texts, F.lit(""))) if "raw_text" not in docs.columns else facts.withColumns(
        {
            "text_supplier": F.when((F.col("supplier") == "") | (F.col("equal_supplier") == "") | (F.col("check_supplier") == ""), both(lambda t: text_bin(t, fixed.SUPPLIER_LABELS))).otherwise(F.lit("")),
            "text_buyer": F.when((F.col("buyer") == "") | (F.col("equal_buyer") == "") | (F.col("check_buyer") == ""), both(lambda t: text_bin(t, fixed.BUYER_LABELS))).otherwise(F.lit("")),
            "text_date": F.when((F.col("date") == "") | (F.col("future") == ""), both(text_date)).otherwise(F.lit("")),
            "text_total": F.when((F.col("total") == "") | F.col("indexed"), both(lambda t: text_total(t, told.max_gap, told.total_labels))).otherwise(F.lit("")),
        }
    )
    filled = lambda name, text: F.when(F.col(name) == "", F.col(text)).otherwise(F.col(name)).alias(name)
    of = {n: filled(n, f"text_{n.split('_')[-1]}") for n in ("supplier", "buyer", "equal_supplier", "equal_buyer", "check_supplier", "check_buyer", "date")}
    of["future"] = filled("future", "text_date")
    of["positive_total"] = F.when((F.col("total") == "") | F.col("indexed"), F.col("text_total")).otherwise(F.col("total"))
    of["signed_total"] = F.when(F.col("total") == "", F.col("text_total")).otherwise(F.col("total"))
    facts = facts.withColumns(of)
    number = lambda name: F.when(F.col(name) == F.col("total"), F.col("total_number")).otherwise(parse_number(F.col(name)))
    facts = facts.withColumns(
        {f"{c}_number": identifier_number(F.col(c)) for c in ("check_supplier", "check_buyer")}
        | {f"{c}_is_bin": is_bin(F.col(c)) for c in ("supplier", "buyer")}
        | {f"{c}_number": number(c) for c in ("positive_total", "signed_total")}
        | {"day": parse_date_exact(F.col("date"))}
    )
    same = F.when(F.col("future") == F.col("date"), F.col("day")).otherwise(parse_date_exact(F.col("future")))
    return facts.withColumns({f"{c}_holds": F.expr(holds_sql(f"{c}_number")) for c in ("check_supplier", "check_buyer")} | {"future_day": same, "positive_indexed": is_table_index(F.col("positive_total_number"))})


def is_table_index(number: Column) -> Column:
    """Within 1e-9 of a whole number from 1 to 12, as columns of a table are numbered; false for null."""
    usual = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e9)
    return bound(number, lambda x: F.when(usual(x), (F.abs(x - F.round(x)) < 1e-9) & F.round(x).between(1, 12)).otherwise(False))


def _item(code: str, level: str, title: Column | str, description: str = "", recommendation: str = "", value: Column | None = None) -> Column:
    text = F.lit(title) if isinstance(title, str) else title
    value = F.lit(None).cast("string") if value is None else value
    return F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), text.alias("title"), F.lit(description).alias("description"), F.lit(recommendation).alias("recommendation"), value.alias("value"))


def _failed(code: str, value: Column | None = None) -> Column:
    return _item(code, *fixed.CATALOGUE[code], value=value)


def _right(code: str, value: Column) -> Column:
    return _item(code, "OK", fixed.OK_TITLES[code], value=value)


def _present(code: str, fact: str) -> Column:
    return F.when(F.col(f"{fact}_is_bin"), _right(code, F.col(fact))).otherwise(_failed(code, F.col(fact)))


def _equal(as_of: Column) -> Column:
    supplier, buyer = F.col("equal_supplier"), F.col("equal_buyer")
    value = F.concat(supplier, F.lit("/"), buyer)
    return F.when((supplier == "") | (buyer == ""), None).when(supplier == buyer, _failed("BIN007", value)).otherwise(_item("BIN007", "OK", *fixed.BIN007_OK, value=value))


def _equal_allowed(as_of: Column) -> Column:
    supplier, buyer = F.col("equal_supplier"), F.col("equal_buyer")
    return F.when((supplier != "") & (buyer != ""), _item("BIN007", "OK", *fixed.BIN007_OK, value=F.concat(supplier, F.lit("/"), buyer)))


def _dated(as_of: Column) -> Column:
    return F.when(F.col("day").isNull(), _failed("D000", F.col("date"))).otherwise(_right("D000", F.col("date")))


def _not_future(as_of: Column) -> Column:
    late = F.coalesce(F.col("future_day") > as_of, F.lit(False))
    return F.when(late, _failed("D001", F.col("future"))).otherwise(_right("D001", F.col("future")))


def _total(as_of: Column) -> Column:
    value = F.col("positive_total")
    number, first = F.col("positive_total_number"), F.col("total_number")
    unusual = lambda x: x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf")))
    # such totals can't be rounded, which ends the rule: its name stands for the code; a negative one fails before that
    broken = F.coalesce(unusual(first), F.lit(False)) | F.coalesce(unusual(number) & ~(number == float("-inf")), F.lit(False))
    broken_item = _item("_rule_TOT001", "ERROR", fixed.RULE_FAILED[0], "_rule_TOT001", fixed.RULE_FAILED[1])
    bad = number.isNull() | (number <= 0) | F.col("positive_indexed")
    return F.when(broken, broken_item).when(value == "", _failed("TOT001")).when(bad, _failed("TOT001", value)).otherwise(_right("TOT001", value))


def _negative(as_of: Column) -> Column:
    return F.when(F.coalesce(F.col("signed_total_number") < 0, F.lit(False)), _failed("NEG001", F.col("signed_total")))


def _checksum(fact: str, role: str) -> Callable[[Column], Column]:
    def rule(as_of: Column) -> Column:
        level, title, *rest = fixed.CATALOGUE["BIN012"]
        bad = _item("BIN012", level, f"{title} ({role})", *rest, value=F.col(fact))
        return F.when(F.col(f"{fact}_number").isNull(), None).when(F.col(f"{fact}_holds"), _item("BIN012", "OK", fixed.CHECKSUM_OK.format(role=role), value=F.col(fact))).otherwise(bad)

    return rule


#: Rules in order. Each makes a column from the day that counts as today: an item, or null for nothing to say.
RULES: dict[str, Callable[[Column], Column]] = {
    "BIN001": lambda as_of: _present("BIN001", "supplier"),
    "BIN002": lambda as_of: _present("BIN002", "buyer"),
    "BIN007": _equal,
    "D000": _dated,
    "D001": _not_future,
    "TOT001": _total,
    "NEG001": _negative,
    "BIN012a": _checksum("check_supplier", fixed.ROLES[0]),
    "BIN012b": _checksum("check_buyer", fixed.ROLES[1]),
}


_BUILT_IN = dict(RULES)
#: Names of rules that were added, and whether they give arrays of items.
_ADDED: dict[str, bool] = {}


def register_rule(name: str, rule: Callable[[Column], Column], many: bool = False) -> None:
    """Add a rule, or put it in place of one: a function of the day that counts as today, giving an item struct or null; with many, an array of items or null.

    Such a rule is evaluated under a guard (`guarded`), as built-in ones need none: these have only forms that don't throw.
    """
    RULES[name] = rule
    _ADDED[name] = many


def unregister_rule(name: str) -> None:
    """Take an added rule away; a built-in one of that name counts again."""
    if _ADDED.pop(name, None) is not None:
        RULES.pop(name, None)
        if name in _BUILT_IN:
            RULES[name] = _BUILT_IN[name]


def guarded(rule: Column, name: str, many: bool = False) -> Column:
    """What an expression of any kind finds, as an array of items; if evaluating it fails (casts, indexes, divisions, raised errors), an ERROR item under the rule's name.

    try_to_binary gives null for whatever fails below it. The rule stands in a lambda, for else parts that rules share would be
    evaluated once ahead of them all, outside of the guard. An outcome passes as JSON, so that nothing found differs from nothing known.
    """
    kind = f"array<{_Value}>" if many else _Value
    found = F.transform(F.array(F.lit(0)), lambda _: rule.cast(kind))[0]
    said = F.call_function("try_to_binary", F.to_json(F.struct(found.alias("x"))), F.lit("utf-8"))
    told = F.from_json(said.cast("string"), f"struct<x:{kind}>")["x"]
    failed = F.array(_item(f"_rule_{name}", "ERROR", fixed.RULE_FAILED[0], f"_rule_{name}", fixed.RULE_FAILED[1]).cast(_Value))
    items = F.filter(told, lambda x: x.isNotNull()) if many else F.array(told)
    return F.when(said.isNull(), failed).when(told.isNull(), F.array().cast(f"array<{_Value}>")).otherwise(items)


def checked(docs: DataFrame, as_of: str | None = None, rules: list[str] | tuple[str, ...] | None = None, settings: Settings | None = None) -> DataFrame:
    """doc_id, items: what the rules say of each document, in order; added rules come last. as_of defaults to the current day."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    told = settings or Settings()
    made = RULES | ({"BIN007": _equal_allowed} if told.allow_equal_bins else {})
    names = [r for r in rules or made if told.checksum or not r.startswith("BIN012")]
    facts = with_facts(with_texts(docs, told), told)
    own = {f"__item_{k}": made[r](day).cast(_Value) for k, r in enumerate(r for r in names if r not in _ADDED)}
    facts = facts.withColumns(own)
    none = F.array().cast(f"array<{_Value}>")
    items = F.concat(none, *[F.when(F.col(x).isNull(), none).otherwise(F.array(F.col(x))) for x in own])
    added = [guarded(made[r](day), r, _ADDED[r]) for r in names if r in _ADDED]
    return facts.select("doc_id", (F.concat(items, *added) if added else items).alias("items"))


def legacy_checked(docs: DataFrame, as_of: str | None = None, settings: Settings | None = None) -> DataFrame:
    """doc_id, items by the rules of the older generation: fields as they are given, identifiers behind fewer labels in the raw text, four date forms; D001 says nothing of dates that can't be read."""
    told = settings or Settings()
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    given = docs.withColumns({"fields": F.coalesce("fields", F.create_map().cast("map<string,string>")), "raw_text": F.coalesce("raw_text", F.lit("")) if "raw_text" in docs.columns else F.lit("")})
    pairs = (("supplier", fixed.CHECK_SUPPLIER_KEYS, fixed.LEGACY_SUPPLIER_LABELS), ("buyer", fixed.CHECK_BUYER_KEYS, fixed.LEGACY_BUYER_LABELS))
    facts = {name: F.coalesce(F.nullif(first_of(F.col("fields"), keys), F.lit("")), text_bin(F.col("raw_text"), labels)) for name, keys, labels in pairs}
    facts["date"] = first_of(F.col("fields"), fixed.LEGACY_DATE_KEYS)
    rows = given.select("doc_id", *[v.alias(k) for k, v in facts.items()])
    rows = rows.withColumns({f"{c}_number": identifier_number(F.col(c)) for c in ("supplier", "buyer")} | {f"{c}_is_bin": is_bin(F.col(c)) for c in ("supplier", "buyer")})
    rows = rows.withColumns({f"{c}_holds": F.expr(holds_sql(f"{c}_number")) for c in ("supplier", "buyer")})
    date = F.when(~F.col("date").rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), parse_date_exact(F.col("date")))
    late = F.when(date > day, _failed("D001", F.col("date"))).when(date.isNotNull(), _right("D001", F.col("date")))
    made = [_present("BIN001", "supplier"), _present("BIN002", "buyer"), F.when(date.isNull(), _failed("D000", F.col("date"))).otherwise(_right("D000", F.col("date"))), late]
    if told.checksum:
        made += [_checksum("supplier", fixed.ROLES[0])(day), _checksum("buyer", fixed.ROLES[1])(day)]
    return rows.select("doc_id", F.filter(F.array(*[x.cast(_Value) for x in made]), lambda x: x.isNotNull()).alias("items"))


def message(item: Column, show_values: bool = True) -> Column:
    """Title, description and recommendation, those that aren't blank; and the value, if there is one."""
    parts = F.concat_ws(" — ", *[F.nullif(trimmed(item[c]), F.lit("")) for c in ("title", "description", "recommendation")])
    return F.concat(parts, F.when(item["value"].isNotNull(), F.concat(F.lit(" [значение: "), item["value"], F.lit("]"))).otherwise(F.lit(""))) if show_values else parts


def priority(code: Column, told: dict[str, int] = fixed.PRIORITY) -> Column:
    known = F.create_map(*[F.lit(x) for p in told.items() for x in p]).cast("map<string,int>")
    return F.coalesce(F.try_element_at(known, code), F.when(code.startswith("BIN"), 0).when(code.startswith("D"), 1).otherwise(2))


def results(items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, ord, code, level, message, value: items sorted by priority, code and the rules' order; ord counts from 0."""
    told = settings or Settings()
    scored = F.transform("items", lambda x, k: F.struct(priority(x["code"], told.priority).alias("priority"), x["code"].alias("code"), k.alias("k"), x.alias("item")))
    rows = items.select("doc_id", F.posexplode_outer(F.sort_array(scored)).alias("ord", "x")).where("x is not null").select("doc_id", "ord", F.col("x.item").alias("item"))
    return rows.select("doc_id", "ord", "item.code", F.upper("item.level").alias("level"), message(F.col("item"), told.show_values).alias("message"), "item.value")


def rule_items(docs: DataFrame, code: str, as_of: str | None = None) -> DataFrame:
    """doc_id, level, value of one rule's items."""
    names = [r for r in RULES if r.startswith(code)]
    return checked(docs, as_of, names).select("doc_id", F.explode_outer("items").alias("x")).where("x is not null").select("doc_id", "x.level", "x.value")
