"""Documents held against templates: order of sections, fields by patterns, the template's named checks.

A template is a row of a table: name, sections (in order), fields (name, pattern, required) and checks (name, enabled). Documents name their template; it is joined to
them, one row each, so that any number of templates makes one plan and no text is copied for a pattern. All work is done in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions.scalars import bound

TEMPLATE = "template string, sections array<string>, fields array<struct<field:string,pattern:string,required:boolean>>, checks array<struct<name:string,enabled:boolean>>"
#: Templates that are broadcast at most; more of them meet their documents by shuffle.
BROADCAST_ROWS = 10_000


def templates(spark: SparkSession) -> DataFrame:
    """The template that is built in."""
    fields = [(name, pattern, required) for name, (pattern, required) in fixed.TEMPLATE_FIELDS.items()]
    return spark.createDataFrame([(fixed.TEMPLATE_NAME, fixed.TEMPLATE_SECTIONS, fields, [(c, True) for c in fixed.TEMPLATE_CHECKS])], TEMPLATE)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates from JSON files, under esf_template or at the top; a file that is malformed, or names no document, is left out. A field's own word on being required counts, else the list it stands in."""
    field = "map<string,struct<pattern:string,required:boolean>>"
    kind = f"struct<metadata:struct<document:string>,required_sections:array<string>,key_fields:{field},optional_fields:{field},validation_rules:array<struct<name:string,enabled:boolean>>>"
    text = spark.read.text(path, wholetext=True)
    told = text.select(F.from_json("value", f"struct<esf_template:{kind}>")["esf_template"].alias("a"), F.from_json("value", kind).alias("b")).select(F.coalesce("a", "b").alias("t"))
    listed = lambda c, required: F.transform(F.map_entries(F.coalesce(f"t.{c}", F.create_map().cast(field))), lambda x: F.struct(x["key"].alias("field"), x["value"]["pattern"].alias("pattern"), F.coalesce(x["value"]["required"], F.lit(required)).alias("required")))
    fields = F.filter(F.concat(listed("key_fields", True), listed("optional_fields", False)), lambda x: x["pattern"].isNotNull())
    checks = F.transform(F.coalesce("t.validation_rules", F.array()), lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["enabled"], F.lit(True)).alias("enabled")))
    rows = told.select(F.col("t.metadata.document").alias("template"), F.coalesce("t.required_sections", F.array().cast("array<string>")).alias("sections"), fields.alias("fields"), checks.alias("checks"))
    return rows.where("template is not null")


def with_template(docs: DataFrame, told: DataFrame) -> DataFrame:
    """docs (doc_id, template, text, ...) with their template's columns; documents whose template isn't there are left out."""
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
    return docs.join(told, "template")


def first_places(text: Column, names: Column) -> Column:
    """Where each of the names first stands in the text as words of its own, from 1; 0 if nowhere."""
    return F.transform(names, lambda n: _first_place(text, n))


def _first_place(text: Column, name: Column) -> Column:
    """A pattern that differs from name to name is compiled anew each time, so the name's first place is looked up; only where letters or digits touch it there a pattern looks for the next ones."""

    def told(at: Column) -> Column:
        before = F.when(at > 1, F.substr(text, at - 1, F.lit(1))).otherwise("")
        touched = F.concat(before, F.substr(text, at + F.length(name), F.lit(1))).rlike(r"[\p{L}\p{N}]")
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}])"))
        later = bound(F.split(text, pattern, F.lit(2)), lambda s: F.when(F.size(s) > 1, F.length(F.get(s, 0)) + 1).otherwise(0))
        return F.when(name == "", F.regexp_instr(text, pattern)).when(at == 0, 0).when(touched, later).otherwise(at)

    return bound(F.call_function("locate", name, text), told)


def longest_run(places: Column) -> Column:
    """Indexes (from 0) of the longest strictly increasing subsequence of places, those that are 0 left out; of equally long ones that with the smallest indexes from the left.

    The state has the best subsequence that ends at each place so far; indexes stand negative in it, so that the greatest array is the wanted one.
    """
    kind = "array<struct<n:int,path:array<int>,place:int>>"

    def step(state: Column, x: Column) -> Column:
        before = F.transform(F.filter(state, lambda s: s["place"] < x["place"]), lambda s: F.struct(s["n"].alias("n"), s["path"].alias("path")))
        best = F.array_max(before)
        own = F.array((-x["i"]).cast("int"))
        added = F.struct(F.coalesce(best["n"] + 1, F.lit(1)).cast("int").alias("n"), F.coalesce(F.concat(best["path"], own), own).alias("path"), x["place"].cast("int").alias("place"))
        return F.concat(state, F.array(added))

    found = F.filter(F.transform(places, lambda p, i: F.struct(p.alias("place"), i.alias("i"))), lambda x: x["place"] > 0)
    done = F.aggregate(found, F.array().cast(kind), step)
    return F.transform(F.coalesce(F.array_max(F.transform(done, lambda s: F.struct(s["n"].alias("n"), s["path"].alias("path"))))["path"], F.array().cast("array<int>")), lambda i: -i)


def section_order(docs: DataFrame) -> DataFrame:
    """doc_id, template, missing, misplaced and repeated (arrays of sections, in the template's order), in_order from rows of with_template.

    Of a section's places the first counts. Misplaced are those outside of the longest run of sections in order: the fewest that would have to be moved. A text without any
    section misses them all; in_order says that none is missing or misplaced.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "template", "sections", text.alias("text"), first_places(text, F.col("sections")).alias("places"))
    rows = rows.withColumns({"run": longest_run(F.col("places")), "rest": F.transform("sections", lambda s, i: F.substr("text", F.get("places", i) + F.length(s)))})
    again = F.transform(F.arrays_zip("sections", "rest"), lambda x: (F.get(first_places(x["rest"], F.array(x["sections"])), 0) > 0))
    rows = rows.withColumn("again", again)
    which = lambda test: F.filter("sections", lambda s, i: test(i))
    rows = rows.select(
        "doc_id",
        "template",
        which(lambda i: F.get("places", i) == 0).alias("missing"),
        which(lambda i: (F.get("places", i) > 0) & ~F.array_contains("run", i)).alias("misplaced"),
        which(lambda i: (F.get("places", i) > 0) & F.get("again", i)).alias("repeated"),
    )
    return rows.withColumn("in_order", (F.size("missing") == 0) & (F.size("misplaced") == 0))


def template_fields(docs: DataFrame) -> DataFrame:
    """doc_id, template, field, required, value (the first match, null without one), n_found, level for each field of a document's template.

    A required field that isn't found is an ERROR, an optional one an INFO, all others are OK. Patterns are columns, and mean what they mean for texts of all scripts; a null text matches nothing.
    """
    text = F.coalesce("text", F.lit(""))

    def found(f: Column) -> Column:
        every = F.regexp_extract_all(text, F.concat(F.lit("(?U)"), f["pattern"]), F.lit(0))
        return F.struct(f["field"].alias("field"), f["required"].alias("required"), F.get(every, 0).alias("value"), F.size(every).alias("n_found"))

    rows = docs.select("doc_id", "template", F.explode_outer(F.transform("fields", found)).alias("x")).where("x is not null").select("doc_id", "template", "x.*")
    return rows.withColumn("level", F.when(F.col("n_found") > 0, "OK").when(F.col("required"), "ERROR").otherwise("INFO"))


def template_checks(docs: DataFrame) -> DataFrame:
    """doc_id, template, check, passed for each enabled check of a document's template, by name; names that aren't known have null.

    The sections' order, two different numbers of 12 digits (a supplier's and a recipient's), a signature, and whether the document can be told to be of its kind: most of its required fields and sections are there.
    """
    text = F.coalesce("text", F.lit(""))
    sections = section_order(docs).select("doc_id", "template", "in_order", F.size("missing").alias("n_missing"))
    matched = lambda f: F.size(F.regexp_extract_all(text, F.concat(F.lit("(?U)"), f["pattern"]), F.lit(0))) > 0
    required = F.filter("fields", lambda f: f["required"])
    numbers = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\d{12}\b"), F.lit(0)))) >= 2
    signed = F.exists(F.filter("fields", lambda f: f["field"] == "signature_ECP"), matched)
    rows = docs.select("doc_id", "template", "checks", F.size("sections").alias("n_sections"), F.size(required).alias("n_fields"), F.size(F.filter(required, matched)).alias("n_matched"), numbers.alias("numbers"), signed.alias("signed"))
    rows = rows.join(sections, ["doc_id", "template"])
    alike = (2 * (F.col("n_matched") + F.col("n_sections") - F.col("n_missing"))) > (F.col("n_fields") + F.col("n_sections"))
    known = {"section_sequence_check": F.col("in_order"), "binary_fields_presence": F.col("numbers"), "signature_check": F.col("signed"), "format_detection": alike}
    one = F.explode(F.filter("checks", lambda c: c["enabled"])).alias("c")
    rows = rows.select("doc_id", "template", *[v.alias(f"__{k}") for k, v in known.items()], one)
    passed = F.coalesce(*[F.when(F.col("c.name") == k, F.col(f"__{k}")) for k in known])
    return rows.select("doc_id", "template", F.col("c.name").alias("check"), passed.alias("passed"))
