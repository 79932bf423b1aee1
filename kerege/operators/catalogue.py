"""The rule catalogue as a small table: rows (code, level, title, description, recommendation), and its versions.

Results that have codes alone (`coded`) get their levels and texts from a table of catalogues keyed by (version, code) in a join, so that
a changed or a second catalogue changes them without any rule being evaluated again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.operators.validation import message, priority
from kerege.settings import Settings

SCHEMA = "code string, level string, title string, description string, recommendation string"
#: ok and ok_description are said where nothing is wrong.
VERSIONED = f"version string, {SCHEMA}, ok string, ok_description string"
#: Catalogues that are built in, each one following the one before.
ORDER = ("v1", "v2.5", "v2.6", "v2.7")
#: Rows of a catalogue that are broadcast at most; larger ones are joined as the planner sees fit.
BROADCAST_ROWS = 100_000


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *v) for c, v in fixed.CATALOGUE.items()], SCHEMA)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue from a JSON file of code -> {level, user{title, description, recommendation}} under "rules"; malformed files give no rows."""
    text = spark.read.text(path, wholetext=True)
    kind = "struct<rules:map<string,struct<level:string,user:struct<title:string,description:string,recommendation:string>>>>"
    rows = text.select(F.explode(F.from_json("value", kind)["rules"]).alias("code", "x"))
    return rows.select("code", "x.level", "x.user.title", "x.user.description", "x.user.recommendation")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file as rows of VERSIONED, its version by the file's own word; also the first form, code -> {level, message}, as v1. Malformed files give no rows."""
    said = "struct<title:string,description:string,recommendation:string,ok:string>"
    kind = f"struct<version:string,rules:map<string,struct<level:string,user:{said},ok_user:{said}>>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", kind).alias("f")).select("f.version", F.explode("f.rules").alias("code", "x"))
    later = rows.select("version", "code", "x.level", "x.user.title", "x.user.description", "x.user.recommendation", F.coalesce("x.ok_user.title", "x.user.ok").alias("ok"), F.when(F.coalesce("x.ok_user.title", "x.user.ok").isNotNull(), F.coalesce("x.ok_user.description", F.lit(""))).alias("ok_description"))
    first = text.select(F.explode(F.from_json("value", "map<string,struct<level:string,message:string>>")).alias("code", "x")).where("x.message is not null")
    return later.unionByName(first.select(F.lit("v1").alias("version"), "code", "x.level", F.col("x.message").alias("title"), F.lit("").alias("description"), F.lit("").alias("recommendation"), F.lit(None).cast("string").alias("ok"), F.lit(None).cast("string").alias("ok_description")))


def with_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules and the new ones whose code isn't there yet."""
    return rules.unionByName(new.join(rules.select("code"), "code", "left_anti").select(*rules.columns))


def without_rules(rules: DataFrame, codes: list[str]) -> DataFrame:
    return rules.where(~F.col("code").isin(codes))


def differences(engine: DataFrame, rules: DataFrame) -> DataFrame:
    """code, status: codes that only the engine has (missing), and that only the catalogue has (unused)."""
    missing = engine.select("code").distinct().join(rules.select("code"), "code", "left_anti").select("code", F.lit("missing").alias("status"))
    unused = rules.select("code").distinct().join(engine.select("code"), "code", "left_anti").select("code", F.lit("unused").alias("status"))
    return missing.unionByName(unused)


def versions(spark: SparkSession) -> DataFrame:
    """The built-in catalogues as rows of VERSIONED; what a catalogue doesn't say is null."""
    rows = [("v1", c, level, text, "", "", None, None) for c, (level, text) in fixed.FIRST_CATALOGUE.items()]
    rows += [(v, c, *texts, "") for v, table in (("v2.5", fixed.CATALOGUE_25), ("v2.6", fixed.CATALOGUE_26)) for c, texts in table.items()]
    ok = {c: (t, "") for c, t in fixed.OK_TITLES.items()} | {"BIN007": fixed.BIN007_OK[:2], "BIN012": (fixed.CHECKSUM_OK, "")}
    rows += [("v2.7", c, *texts, *ok.get(c, (None, None))) for c, texts in fixed.CATALOGUE.items()]
    return spark.createDataFrame(rows, VERSIONED)


def as_version(rules: DataFrame, version: str) -> DataFrame:
    """A plain catalogue (SCHEMA) as one version of VERSIONED."""
    return rules.select(F.lit(version).alias("version"), "code", "level", "title", "description", "recommendation", F.lit(None).cast("string").alias("ok"), F.lit(None).cast("string").alias("ok_description"))


def inherited(catalogues: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """VERSIONED rows for each version of `order` and each code that it or one before it has: a later version says what the last one that has the code says.

    Versions outside `order` are left out; a code that a version repeats has its last row by level and texts.
    """
    said = ("level", "title", "description", "recommendation", "ok", "ok_description")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("version"))
    own = catalogues.where(place > 0).groupBy("version", "code").agg(F.max(F.struct(*said)).alias("said"))
    every = own.select("code").distinct().withColumn("version", F.explode(F.array(*map(F.lit, order))))
    before = Window.partitionBy("code").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    last = every.join(own, ["version", "code"], "left").withColumn("said", F.last("said", ignorenulls=True).over(before))
    return last.where("said is not null").select("version", "code", *[F.col(f"said.{c}").alias(c) for c in said])


def coded(items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, ord, code, outcome (ok, failed, broken), role, value and own: what rules found (doc_id, items) in order of priority, code and rule.

    own has the level and texts that a rule brings itself; they count for codes that a catalogue doesn't have.
    """
    told = settings or Settings()
    outcome = lambda x: F.when(x["level"] == "OK", "ok").when(x["code"].startswith("_rule_"), "broken").otherwise("failed")
    role = lambda x: F.when(x["code"] == "BIN012", F.nullif(F.regexp_extract(x["title"], "|".join(fixed.ROLES), 0), F.lit("")))
    texts = lambda x: F.struct(*[x[c].alias(c) for c in ("level", "title", "description", "recommendation")])
    scored = F.transform("items", lambda x, k: F.struct(priority(x["code"], told.priority).alias("priority"), x["code"].alias("code"), k.alias("k"), outcome(x).alias("outcome"), role(x).alias("role"), x["value"].alias("value"), texts(x).alias("own")))
    return items.select("doc_id", F.posexplode_outer(F.array_sort(scored)).alias("ord", "x")).where("x is not null").select("doc_id", "ord", *[f"x.{c}" for c in ("code", "outcome", "role", "value", "own")])


def described(found: DataFrame, catalogues: DataFrame, versions: tuple[str, ...], settings: Settings | None = None) -> DataFrame:
    """doc_id, version, ord, code, level, message, value: rows of `coded` as each of the versions puts them.

    What is in order has level OK and the version's ok text (the rule's own where it has none); a rule that broke, and a code that the version hasn't, keep what the rule brought.
    """
    told = settings or Settings()
    some = catalogues.where(F.col("version").isin(*versions))
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    rows = found.withColumn("version", F.explode(F.array(*map(F.lit, versions)))).join(some, ["version", "code"], "left")
    own = lambda c: F.col(f"own.{c}")
    ok, known = F.col("outcome") == "ok", F.col("level").isNotNull() & (F.col("outcome") != "broken")
    role = F.coalesce("role", F.lit(""))
    title = F.when(ok, F.coalesce(F.replace("ok", F.lit("{role}"), role), own("title"))).when(known, F.concat("title", F.when(role != "", F.concat(F.lit(" ("), role, F.lit(")"))).otherwise(""))).otherwise(own("title"))
    description = F.when(ok, F.coalesce("ok_description", own("description"))).when(known, F.col("description")).otherwise(own("description"))
    recommendation = F.when(ok | ~known, own("recommendation")).otherwise(F.col("recommendation"))
    item = F.struct(title.alias("title"), description.alias("description"), recommendation.alias("recommendation"), "value")
    level = F.when(ok, "OK").when(known, F.upper("level")).otherwise(F.upper(own("level")))
    return rows.select("doc_id", "version", "ord", "code", level.alias("level"), message(item, told.show_values).alias("message"), "value")


