"""Language and roles of a document's parts by keywords of several languages.

Keywords are an inverted index: a row for each of their words, with the place it has in the keyword. Words of documents meet it in one join by word (the index is
small and broadcast up to a bound), and only words that are part of some keyword are ever shuffled. A keyword of several words stands where all of them do, in
order: its hits share the place where it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions.scalars import bound

INDEX = "word string, at int, n int, language string, role string, keyword string"
#: Rows of an index that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Rows of an index that are looked up as a map at most.
ROW_INDEX = 5_000
_HITS = "array<struct<at:int,n:int,language:string,role:string,keyword:string>>"


def keyword_index(keywords: DataFrame) -> DataFrame:
    """INDEX rows of (language, role, keyword): the keywords' words in lower case. Keywords without a letter or digit are left out, repeated ones count once."""
    told = keywords.select("language", "role", F.regexp_extract_all(F.lower("keyword"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    told = told.where("size(words) > 0").select("language", "role", "words", F.array_join("words", " ").alias("keyword")).distinct()
    return told.select("language", "role", "keyword", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).select("word", "at", "n", "language", "role", "keyword")


def built_in(spark: SparkSession) -> DataFrame:
    rows = [(language, role, word) for language, roles in fixed.KEYWORDS.items() for role, words in roles.items() for word in words]
    return spark.createDataFrame(rows, "language string, role string, keyword string")


def keyword_places(docs: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, language, role, keyword, place: where keywords stand in texts (doc_id, text), in words from 0. A null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    hits = docs.select("doc_id", F.posexplode(words).alias("i", "word")).join(index, "word")
    whole = hits.where("n = 1").select("doc_id", "language", "role", "keyword", F.col("i").alias("place"))
    parts = hits.where("n > 1").groupBy("doc_id", "language", "role", "keyword", "n", (F.col("i") - F.col("at")).alias("place")).agg(F.count_distinct("at").alias("k"))
    return whole.unionByName(parts.where("k = n").select("doc_id", "language", "role", "keyword", "place"))


def keyword_roles(docs: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, language, role, n_places, n_keywords, is_language: votes of each language and role with a keyword in the document.

    Documents are a row each, and with an index of up to ROW_INDEX rows, which is a map beside them, a document's votes are counted inside its row: nothing is grouped or sorted, so that a task's memory doesn't grow with its rows.
    A keyword inside a longer one of the same language and role counts too. is_language marks the language with most votes, ties: with most roles, then the first by name.
    """
    if index.count() > ROW_INDEX:
        return _by_groups(docs, index)
    entries = F.broadcast(index.groupBy("word").agg(F.collect_list(F.struct("at", "n", "language", "role", "keyword")).alias("hits")).agg(F.map_from_entries(F.collect_list(F.struct("word", "hits"))).alias("__index")))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = docs.select("doc_id", words.alias("__words")).join(entries)

    def hit(w: Column, i: Column) -> Column:
        return F.transform(F.coalesce(F.try_element_at("__index", w), F.array().cast(_HITS)), lambda x: F.struct(x["language"].alias("language"), x["role"].alias("role"), x["keyword"].alias("keyword"), x["n"].alias("n"), (i - x["at"]).alias("place"), x["at"].alias("at")))

    start = lambda x: F.struct(*[x[c].alias(c) for c in ("language", "role", "keyword", "n", "place")])

    def whole(hits: Column) -> Column:
        """Places of keywords: a keyword of several words has a hit of each of its words."""
        many = F.transform(F.array_distinct(F.transform(F.filter(hits, lambda x: x["n"] > 1), start)), lambda s: F.struct(s.alias("s"), F.size(F.filter(hits, lambda x: start(x) == s)).alias("k")))
        return F.concat(F.transform(F.filter(hits, lambda x: x["n"] == 1), start), F.transform(F.filter(many, lambda m: m["k"] == m["s"]["n"]), lambda m: m["s"]))

    def votes(places: Column) -> Column:
        pair = lambda x: F.struct(x["language"].alias("language"), x["role"].alias("role"))

        def of(p: Column) -> Column:
            own = F.filter(places, lambda x: pair(x) == p)
            return F.struct(p["language"].alias("language"), p["role"].alias("role"), F.size(own).cast("long").alias("n_places"), F.size(F.array_distinct(F.transform(own, lambda x: x["keyword"]))).cast("long").alias("n_keywords"))

        return F.transform(F.array_distinct(F.transform(places, pair)), of)

    def best(found: Column) -> Column:
        def of(name: Column) -> Column:
            own = F.filter(found, lambda v: v["language"] == name)
            return F.struct((-F.aggregate(own, F.lit(0).cast("long"), lambda a, v: a + v["n_places"])).alias("a"), (-F.size(own)).alias("b"), name.alias("language"))

        first = F.array_min(F.transform(F.array_distinct(F.transform(found, lambda v: v["language"])), of))
        return bound(first, lambda f: F.transform(found, lambda v: F.struct(v["language"].alias("language"), v["role"].alias("role"), v["n_places"].alias("n_places"), v["n_keywords"].alias("n_keywords"), (v["language"] == f["language"]).alias("is_language"))))

    told = bound(bound(bound(F.flatten(F.transform("__words", hit)), whole), votes), best)
    return rows.select("doc_id", F.explode(told).alias("x")).select("doc_id", "x.*")


def _by_groups(docs: DataFrame, index: DataFrame) -> DataFrame:
    """keyword_roles with an index that is too large to lie in a row: words meet it by join."""
    found = keyword_places(docs, index).groupBy("doc_id", "language", "role").agg(F.count("*").alias("n_places"), F.count_distinct("keyword").alias("n_keywords"))
    own, every = Window.partitionBy("doc_id", "language"), Window.partitionBy("doc_id")
    votes = found.withColumns({"__votes": F.sum("n_places").over(own), "__roles": F.count("*").over(own)})
    best = F.min(F.struct((-F.col("__votes")).alias("a"), (-F.col("__roles")).alias("b"), "language")).over(every)
    return votes.withColumn("is_language", best["language"] == F.col("language")).drop("__votes", "__roles")


def recognised(roles: DataFrame, needed: tuple[str, ...] = ("supplier", "buyer", "date", "total")) -> DataFrame:
    """doc_id, language, roles, is_invoice from rows of keyword_roles: the document's language, its roles in it (sorted), and whether all needed ones are there."""
    told = roles.where("is_language").groupBy("doc_id", "language").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return told.withColumn("is_invoice", F.size(F.array_intersect("roles", F.array(*map(F.lit, needed)))) == len(needed))
