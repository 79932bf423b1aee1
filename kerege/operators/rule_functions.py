"""Rules as table functions: Python rules that SQL can call beside the native ones.

A rule takes a document's facts (a dict of texts) and returns None, one item or a list of items, an item being a dict with code and any of level, title,
description, recommendation and value. Registered under a name it is a table function: `select d.doc_id, r.* from docs d, lateral name(d.fields) r`. Rows go to
Python in Arrow batches, and only for rules of this kind; a rule that raises gives an ERROR item that says so, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.shipping import ship_package

ITEM = "code string, level string, title string, description string, recommendation string, value string"
_NAMES = tuple(x.split()[0] for x in ITEM.split(", "))

Rule = Callable[[dict[str, str]], dict | list[dict] | None]


def found_by(rule: Rule, name: str, fields: dict[str, str] | None) -> Iterator[tuple]:
    """Rows of ITEM: what the rule returns, or that it failed. An item without level is an INFO; values that aren't texts become such."""
    try:
        told = rule(dict(fields or {}))
        items = [] if told is None else [told] if isinstance(told, dict) else list(told)
        rows = [tuple(None if (x := {"level": "INFO", "title": "", "description": "", "recommendation": ""} | item).get(n) is None else str(x[n]) for n in _NAMES) for item in items]
    except Exception as e:  # whatever a rule raises is its own result
        rows = [(f"_rule_{name}", "ERROR", fixed.RULE_FAILED[0], f"_rule_{name}: {e}", fixed.RULE_FAILED[1], None)]
    yield from rows


def register_rule_function(spark: SparkSession, name: str, rule: Rule) -> None:
    """Register a rule as a table function of this name for SQL."""
    ship_package(spark)

    class Items:
        def eval(self, fields: dict) -> Iterator[tuple]:
            yield from found_by(rule, name, fields)

    spark.udtf.register(name, F.udtf(Items, returnType=ITEM, useArrow=True))


def lateral_items(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, rule and an item's columns for each item that the registered functions find in docs (doc_id, fields)."""
    out = None
    for name in names:
        rows = docs.sparkSession.sql(f"select d.doc_id, '{name}' as rule, r.* from {{docs}} d, lateral `{name}`(d.fields) r", docs=docs.select("doc_id", "fields"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rule string, {ITEM}")
    return out
