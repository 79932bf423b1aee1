"""Results to reports: groups, verdicts, summaries, counts, comparison with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions.scalars import level_name
from kerege.settings import Settings


def is_error(level: Column) -> Column:
    return F.upper(level).isin("ERR", "ERROR")


def is_warning(level: Column) -> Column:
    return F.upper(level).isin("WARN", "WARNING")


def group_key(code: Column, prefixes: dict[str, list[str]] | None = None) -> Column:
    """A configured group whose prefix the code has (in their order), else one by the code's letters."""
    letters = F.upper(F.regexp_extract(code, "^([A-Za-z]+)", 1))
    own = F.when(letters.isin("TOT", "NEG"), "SUM").when(letters == "D", "DATE").when(letters == "", "OTHER").otherwise(letters)
    for group, starts in reversed(list((prefixes or {}).items())):
        for start in reversed(starts):
            own = F.when(F.upper(code).startswith(start.upper()), group).otherwise(own)
    return own


def severity(level: Column) -> Column:
    return F.when(F.upper(level) == "ERROR", 3).when(is_warning(level) & (F.upper(level) != "ERR"), 2).when(F.upper(level).isin("INFO", "OK"), 1).otherwise(0)


def group_report(results: DataFrame, prefixes: dict[str, list[str]] | None = None, order: dict[str, int] | None = None, best: dict[str, list[str]] | None = None, titles: dict[str, str] | None = None) -> DataFrame:
    """doc_id, group_key, title, n_items, code, level, label, icon, message: each group's gravest item, the first of equals.

    order and best are the groups' configured places and the codes that come first among equals of a group.
    """
    rows = results.withColumn("group_key", group_key(F.col("code"), prefixes))
    place = F.lit(999)
    for group, codes in (best or {}).items():
        for k, code in enumerate(codes):
            place = F.when((F.col("group_key") == group) & (F.col("code") == code), k).otherwise(place)
    first = F.min_by(F.struct("code", "level", "message"), F.struct(-severity(F.col("level")), place, "ord")).alias("x")
    grouped = rows.groupBy("doc_id", "group_key").agg(first, F.count("*").alias("n_items"))
    title = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in (fixed.GROUP_TITLES | (titles or {})).items() for x in p]), F.col("group_key")), F.col("group_key"))
    place = F.coalesce(*[F.when(F.col("group_key") == g, n) for g, n in (order or {}).items()], F.lit(9999))
    shown = F.when(is_error(F.col("x.level")), "ERROR").when(is_warning(F.col("x.level")), "WARN").otherwise("OK")
    icon = F.create_map(*[F.lit(x) for p in fixed.LEVEL_ICONS.items() for x in p])[shown]
    return grouped.select("doc_id", "group_key", place.alias("place"), title.alias("title"), "n_items", "x.code", "x.level", level_name(shown).alias("label"), icon.alias("icon"), "x.message")


def verdicts(results: DataFrame, prefixes: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, verdict (ERROR, WARN, OK), bad_groups (groups with errors, in order of appearance), n_ok, n_warn, n_error."""
    rows = results.withColumn("group_key", group_key(F.col("code"), prefixes))
    grouped = rows.groupBy("doc_id", "group_key").agg(
        F.min("ord").alias("first"),
        F.count_if(is_error(F.col("level"))).alias("e"),
        F.count_if(is_warning(F.col("level"))).alias("w"),
        F.count("*").alias("n"),
    )
    bad = F.array_sort(F.collect_list(F.when(F.col("e") > 0, F.struct("first", "group_key"))))  # a document has a few groups
    whole = grouped.groupBy("doc_id").agg(F.array_join(F.transform(bad, lambda x: x["group_key"]), ", ").alias("bad_groups"), F.sum("e").alias("n_error"), F.sum("w").alias("n_warn"), F.sum("n").alias("n"))
    verdict = F.when(F.col("n_error") > 0, "ERROR").when(F.col("n_warn") > 0, "WARN").otherwise("OK")
    return whole.select("doc_id", verdict.alias("verdict"), "bad_groups", (F.col("n") - F.col("n_error") - F.col("n_warn")).alias("n_ok"), "n_warn", "n_error")


def rule_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("code", "level").agg(F.count("*").alias("n"))


def summaries(items: DataFrame) -> DataFrame:
    """doc_id, status, title, message, affected for documents (doc_id, results array<struct<code,level>> in order), without a shuffle."""
    codes = lambda keep: F.transform(F.filter("results", lambda x: keep(x["level"])), lambda x: x["code"])
    rows = items.select("doc_id", "results", codes(is_error).alias("e"), codes(is_warning).alias("w"))
    names = F.create_map(*[F.lit(x) for p in fixed.SUMMARY_LABELS.items() for x in p])
    rows = rows.withColumn("parts", F.array_distinct(F.filter(F.transform(F.concat("e", "w"), lambda c: F.try_element_at(names, c)), lambda x: x.isNotNull())))
    status = F.when(F.size("results") == 0, "none").when(F.size("e") > 0, "error").when(F.size("w") > 0, "warn").otherwise("ok")
    has = F.array_contains
    text, parts, n = fixed.SUMMARY_TEXTS, F.col("parts"), F.size("parts")
    phrase = (
        F.when(n == 0, text["unnamed"])
        .when(n == 1, F.concat(F.lit("Обнаружено: "), F.get(parts, 0), F.lit(".")))
        .when(n == 2, F.concat(F.lit("Обнаружено: "), F.get(parts, 0), F.lit(" и "), F.get(parts, 1), F.lit(".")))
        .when(n <= 4, F.concat(F.lit("Обнаружены: "), F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" и "), F.get(parts, n - 1), F.lit(".")))
        .otherwise(text["many"])
    )
    none = F.size("e") == 0
    spoken = (
        F.when(F.col("status") == "none", text["none"])
        .when(F.col("status") == "ok", text["clean"])
        .when(has("e", "BIN001") & has("e", "BIN002"), text["both"])
        .when(has("w", "BIN007") & none, text["equal"])
        .when(has("e", "D001"), text["future"])
        .when(has("w", "BIN012") & none, text["checksum"])
        .otherwise(phrase)
    )
    titles = F.create_map(*[F.lit(x) for p in fixed.SUMMARY_TITLES.items() for x in p])
    rows = rows.withColumn("status", status)
    affected = F.array_join(F.array_sort(F.array_distinct(F.concat("e", "w"))), ",")
    return rows.select("doc_id", F.when(F.col("status") == "none", "ok").otherwise(F.col("status")).alias("status"), titles[F.col("status")].alias("title"), spoken.alias("message"), affected.alias("affected"))


def confusion(results: DataFrame, truth: DataFrame) -> DataFrame:
    """check_code, expected_status, actual, n: labels (doc_id, check_code, expected_status) against the level of the result of that code (NONE without)."""
    level = F.max_by("level", severity(F.col("level")))
    found = results.groupBy("doc_id", "code").agg(level.alias("level"))
    joined = truth.join(found, (truth.doc_id == found.doc_id) & (truth.check_code == found.code), "left")
    actual = F.when(is_warning(F.col("level")), "WARNING").otherwise(F.coalesce("level", F.lit("NONE")))
    return joined.groupBy("check_code", "expected_status", actual.alias("actual")).agg(F.count("*").alias("n"))


def report_lines(results: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, line_no, line: the report of each document as text lines; with settings.details each group's other items follow its main one."""
    told = settings or Settings()
    groups = group_report(results, told.group_prefixes, told.group_order, told.group_best, told.group_titles)
    item = F.struct("place", "group_key", "title", "icon", "label", "message", F.array().cast("array<string>").alias("others"))
    if told.details:
        rows = results.withColumn("group_key", group_key(F.col("code"), told.group_prefixes))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: x["message"])  # a document has a few results
        others = rows.groupBy("doc_id", "group_key").agg(listed.alias("every"))
        groups = groups.join(others, ["doc_id", "group_key"])
        main = F.array_position("every", F.col("message")).cast("int")
        rest = F.filter("every", lambda x, k: k + 1 != main)
        item = F.struct("place", "group_key", "title", "icon", "label", "message", F.transform(rest, lambda x: F.concat(F.lit("   • "), x)).alias("others"))
    best = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("g"))
    seen = verdicts(results, told.group_prefixes)
    n_bad = F.size(F.split("bad_groups", ", "))
    head = (
        F.when(F.col("verdict") == "ERROR", F.concat(F.lit("❌ Нужны исправления: "), n_bad.cast("string"), F.lit(" категорий с ошибками ("), F.col("bad_groups"), F.lit(")")))
        .when(F.col("verdict") == "WARN", "⚠ Есть предупреждения (не блокирует отправку).")
        .otherwise("✅ Чики-пыки: критичных ошибок нет.")
    )
    foot = F.concat(F.lit("✅ ОК: "), F.col("n_ok").cast("string"), F.lit("   ⚠ Предупреждения: "), F.col("n_warn").cast("string"), F.lit("   ❌ Ошибки: "), F.col("n_error").cast("string"))
    body = F.flatten(F.transform("g", lambda x: F.concat(F.array(x["title"], F.concat(x["icon"], F.lit(" "), x["label"], F.lit(": "), x["message"])), x["others"])))
    lines = best.join(seen, "doc_id").select("doc_id", F.concat(F.array(head), body, F.array(foot)).alias("lines"))
    out = lines.select("doc_id", F.posexplode("lines").alias("line_no", "line"))
    return out.withColumn("line", F.coalesce("line", F.lit("")))


def report_text(lines: DataFrame) -> DataFrame:
    """lines of report_lines with the rules between its parts: a long one under the head, a short one under each group; line_no counts anew."""
    last = Window.partitionBy("doc_id")
    rows = lines.withColumn("__n", F.max("line_no").over(last))
    title = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    starts = [f"{i} " for i in fixed.LEVEL_ICONS.values()]
    opens = F.lit(False)
    for icon in starts:
        opens = opens | F.coalesce(title.startswith(icon), F.lit(False))
    rows = rows.withColumn("__opens", opens & (F.col("line_no") > 0))
    long, short = F.lit("—" * 90), F.lit("—" * 60)
    parts = F.when(F.col("line_no") == 0, F.array(F.col("line"), long)).when(F.col("__opens") & (F.col("line_no") > 1), F.array(short, F.col("line"))).when(F.col("line_no") == F.col("__n"), F.array(short, F.col("line"))).otherwise(F.array("line"))
    flat = rows.select("doc_id", "line_no", F.posexplode(parts).alias("__k", "line"))
    return flat.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "__k")) - 1).alias("line_no"), "line")
