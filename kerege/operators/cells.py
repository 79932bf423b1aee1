"""Facts from sheet cells (doc_id, r, c, v as text): neighbours meet on exploded offsets in windows, never by ranges; cells that lie by document stay where they are throughout.

What is filtered by a costly expression is made by an outer explode first, as filters on plain columns are pushed below and write the expression out again for each place where it stands.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions.scalars import clean_key, clean_text, header_similarity, is_strict_bin, only_digits, parse_date_found
from kerege.settings import Settings

HEADER_SHARE = 0.82
DATE_SHARE = 0.75


def has_token(key: Column, tokens: list[str]) -> Column:
    """Does a key (made by clean_key, as a column of its own) hold one of the words?"""
    return key.rlike("|".join(map(re.escape, tokens)))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once, whatever is filtered by it later."""
    return rows.withColumn(name, F.explode_outer(F.array(value)))


def _moves(*moves: tuple[Column | int, ...]) -> Column:
    """Places a cell goes to: a number, and where (each two values)."""
    return F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(x) if isinstance(x, int) else x).alias("x"), (F.lit(y) if isinstance(y, int) else y).alias("y")) for k, x, y in moves])


def _meeting(rows: DataFrame, own: Column, others: Column, anchor: str, value: Column) -> DataFrame:
    """rows of `anchor` (not null) at each of the places `others` (k, x, y), with __seen, the values (not null) of all rows that are at that place of their document by `own`.

    Rows meet in a window on their document and place: where cells lie by document nothing moves between tasks, which a join on all three would do on both sides.
    """
    none = F.array().cast("array<struct<k:int,x:int,y:int>>")
    places = F.concat(F.when(value.isNotNull(), own).otherwise(none), F.when(F.col(anchor).isNotNull(), others).otherwise(none))
    moved = rows.withColumn("__m", F.explode(places))
    moved = moved.withColumns({"k": F.col("__m.k"), "__x": F.col("__m.x"), "__y": F.col("__m.y"), anchor: F.when(F.col("__m.k") >= 0, F.col(anchor)), "__v": F.when(F.col("__m.k") < 0, value)})
    moved = moved.select("doc_id", "r", "c", anchor, "k", "__x", "__y", "__v")
    return moved.withColumn("__seen", F.collect_list("__v").over(Window.partitionBy("doc_id", "__x", "__y"))).where("k >= 0").drop("__v")


def neighbours(rows: DataFrame, anchor: str, value: str, offsets: list[tuple[int, int]], outer: bool = False) -> DataFrame:
    """doc_id, r, c, anchor, k, r2, c2, v2 for rows (doc_id, r, c, anchor, value): values (not null) of cells at the offsets (rows, columns) of each anchor (not null), k being the offset's place in the list; with outer a null where there is none."""
    others = _moves(*[(k, F.col("r") + dr, F.col("c") + dc) for k, (dr, dc) in enumerate(offsets)])
    met = _meeting(rows, _moves((-1, F.col("r"), F.col("c"))), others, anchor, F.col(value))
    each = F.explode_outer("__seen") if outer else F.explode("__seen")
    return met.select("doc_id", "r", "c", anchor, "k", F.col("__x").alias("r2"), F.col("__y").alias("c2"), each.alias("v2"))


def around(rows: DataFrame, anchor: str, value: str, reach: int) -> DataFrame:
    """doc_id, r, c, anchor, near for rows (doc_id, r, c, anchor, value): values (not null), with r2 and c2, of cells at most `reach` rows and columns away from an anchor (not null), itself included; a part of them a row.

    The sheet is cut into blocks as wide as the window; a window lies on four of them at most, so an anchor is copied
    four times and not once for each place of its window, and cells meet by block.
    """
    side = 2 * reach + 1
    block = lambda x: F.floor(x / side).cast("int")
    r, c = F.col("r"), F.col("c")
    corners = [(block(r + dr), block(c + dc)) for dr in (-reach, reach) for dc in (-reach, reach)]
    others = F.array_distinct(_moves(*[(0, x, y) for x, y in corners]))
    item = F.when(F.col(value).isNotNull(), F.struct(r.alias("r2"), c.alias("c2"), F.col(value).alias("t")))
    met = _meeting(rows, _moves((-1, block(r), block(c))), others, anchor, item)
    within = lambda x: (F.abs(x["r2"] - F.col("r")) <= reach) & (F.abs(x["c2"] - F.col("c")) <= reach)
    return met.select("doc_id", "r", "c", anchor, F.filter("__seen", within).alias("near"))


_LABEL_OFFSETS = [(0, 0), *[(0, k) for k in range(1, 9)], *[(k, 0) for k in range(1, 5)]]
#: Rows and columns around a number that say whose it is.
REACH = 3
_NUMBER_OFFSETS = [(0, 0), *[(0, k) for k in range(1, 6)], *[(k, 0) for k in range(1, 4)]]


def labelled_bins(cells: DataFrame) -> DataFrame:
    """doc_id, role, bin, trace: by the first label in reading order whose own, right (8) or lower (4) cell holds a valid number."""
    keyed = _once(cells.select("doc_id", "r", "c", "v"), "key", clean_key(F.col("v")))
    roles = F.array_compact(F.array(F.when(has_token(F.col("key"), fixed.SUPPLIER_TOKENS), "supplier_bin"), F.when(has_token(F.col("key"), fixed.BUYER_TOKENS), "buyer_bin")))
    found = F.struct(F.when(has_token(F.col("key"), fixed.ID_TOKENS), roles).alias("roles"), F.when(is_strict_bin(F.col("v")), F.col("v")).alias("number"))
    rows = _once(keyed, "x", found).select("doc_id", "r", "c", F.when(F.size("x.roles") > 0, F.col("x.roles")).alias("roles"), "x.number")
    found = neighbours(rows, "roles", "number", _LABEL_OFFSETS).withColumn("role", F.explode("roles"))
    best = F.min_by(F.struct(only_digits(F.col("v2")).alias("bin"), "r", "c", "r2", "c2"), F.struct("r", "c", "k")).alias("x")
    at = lambda r, c: [F.lit("R"), F.col(r).cast("string"), F.lit("C"), F.col(c).cast("string")]
    return found.groupBy("doc_id", "role").agg(best).select("doc_id", "role", "x.bin", F.concat(F.lit("LABEL@"), *at("x.r", "x.c"), F.lit("->"), *at("x.r2", "x.c2")).alias("trace"))


def bins_in_context(cells: DataFrame) -> DataFrame:
    """doc_id, r, c, bin, key: each valid number with the key of the cells within three rows and columns, in reading order."""
    text = F.lower(clean_text(F.col("v")))
    rows = _once(cells.select("doc_id", "r", "c", "v"), "x", F.struct(F.when(is_strict_bin(F.col("v")), F.col("v")).alias("number"), F.nullif(text, F.lit("")).alias("t")))
    near = around(rows.select("doc_id", "r", "c", "x.number", "x.t"), "number", "t", REACH)
    # at most 49 cells a number
    words = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("near"))), lambda x: x["t"]), " ")
    every = near.groupBy("doc_id", "r", "c", "number").agg(words.alias("context"))
    return every.select("doc_id", "r", "c", only_digits(F.col("number")).alias("bin"), clean_key(F.col("context")).alias("key"))


def _by_context(near: DataFrame, supplier: Column, buyer: Column) -> DataFrame:
    """doc_id, role, bin, trace from numbers in context; the two columns say for which roles a number is asked."""
    item = F.struct("r", "c", "bin", supplier.alias("s"), buyer.alias("b"))
    rows = near.where(has_token(F.col("key"), fixed.ID_TOKENS)).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    rows = rows.withColumn("supplier", F.get(F.filter("all", lambda x: x["s"]), 0))
    taken = lambda x: F.coalesce((x["r"] == F.col("supplier.r")) & (x["c"] == F.col("supplier.c")), F.lit(False))
    rows = rows.withColumn("buyer", F.get(F.filter("all", lambda x: x["b"] & ~taken(x)), 0))
    found = F.array(*[F.struct(F.lit(f"{role}_bin").alias("role"), F.col(role).alias("x")) for role in ("supplier", "buyer")])
    out = rows.select("doc_id", F.explode(found).alias("y")).where("y.x is not null")
    return out.select("doc_id", "y.role", "y.x.bin", F.concat(F.lit("CTX@R"), F.col("y.x.r").cast("string"), F.lit("C"), F.col("y.x.c").cast("string")).alias("trace"))


def context_bins(cells: DataFrame) -> DataFrame:
    """doc_id, role, bin, trace by context alone: a number that serves as the supplier's isn't the buyer's too."""
    return _by_context(bins_in_context(cells), has_token(F.col("key"), fixed.SUPPLIER_TOKENS), has_token(F.col("key"), fixed.BUYER_TOKENS))


def cell_bins(cells: DataFrame) -> DataFrame:
    """doc_id, role, bin, trace: by label; what is missing in a document by context, where only missing roles take numbers."""
    labelled = labelled_bins(cells)
    have = labelled.groupBy("doc_id").agg(F.collect_set("role").alias("have"))
    missing = lambda role: ~F.coalesce(F.array_contains("have", role), F.lit(False))
    near = bins_in_context(cells).join(have, "doc_id", "left")
    return labelled.unionByName(_by_context(near, missing("supplier_bin") & has_token(F.col("key"), fixed.SUPPLIER_TOKENS), missing("buyer_bin") & has_token(F.col("key"), fixed.BUYER_TOKENS)))


def cell_dates(cells: DataFrame, kind: str = "issue_date", aliases: dict[str, list[str]] = fixed.HEADER_ALIASES) -> DataFrame:
    """doc_id, issue_date (ISO): the first date in reading order beside or under a like header, or in a cell that names an invoice."""
    # a date has four digits in a row
    dated = _once(cells.select("doc_id", "r", "c", "v"), "day", F.when(F.col("v").rlike(r"\d{4}"), parse_date_found(F.col("v"))))
    anchors = dated.select("doc_id", "r", "c", "v", F.when(F.col("day").isNotNull(), F.struct("day", "v")).alias("x"))
    beside = _once(neighbours(anchors, "x", "v", [(0, -1), (-1, 0)], outer=True), "key", clean_key(F.col("v2")))
    alike = lambda name: F.max(header_similarity("key", aliases[name], DATE_SHARE))
    scores = beside.groupBy("doc_id", "r", "c", "x").agg(alike("issue_date").alias("issue"), alike("turnover_date").alias("turnover"))
    scores = scores.select("doc_id", "r", "c", "x.day", "x.v", "issue", "turnover")
    rows = _once(scores.fillna(0.0, ["issue", "turnover"]), "key", clean_key(F.col("v")))
    own = (header_similarity("key", aliases["issue_date"], DATE_SHARE) >= DATE_SHARE) | has_token(F.col("key"), fixed.INVOICE_WORDS)
    hit = (F.col("issue") >= DATE_SHARE) | ((F.col("turnover") < DATE_SHARE) & own) if kind == "issue_date" else F.col("turnover") >= DATE_SHARE
    return rows.where(hit).groupBy("doc_id").agg(F.date_format(F.min_by("day", F.struct("r", "c")), "yyyy-MM-dd").alias(kind))


def cell_totals(cells: DataFrame, prefer: str = "gross", aliases: dict[str, list[str]] = fixed.HEADER_ALIASES, share: float = HEADER_SHARE) -> DataFrame:
    """doc_id, kind, amount, trace: for each kind of total the number in, right of (5) or under (3) its last label in reading order that has one.

    A kind total_amount comes last: the preferred kind's number, else the gross one, else that of its own label.
    """
    kinds = [k for k in aliases if k.startswith("total")]
    # aliases hold letters in all but a few places, so cells without a letter are no labels
    keyed = _once(cells.select("doc_id", "r", "c", "v"), "key", F.when(F.col("v").rlike(r"\p{L}"), clean_key(F.col("v"))))
    labels = F.array_compact(F.array(*[F.when(header_similarity("key", aliases[k], share) >= share, k) for k in kinds]))
    raw = F.replace(F.replace(F.regexp_extract(F.lower(clean_text(F.col("v"))), r"(-?\d[\d\s,.]*)", 1), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    rows = _once(keyed, "x", F.struct(F.when(F.col("key").isNotNull(), labels).alias("kinds"), raw.try_cast("double").alias("amount")))
    rows = rows.select("doc_id", "r", "c", F.when(F.size("x.kinds") > 0, F.col("x.kinds")).alias("kinds"), "x.amount")
    near = neighbours(rows, "kinds", "amount", _NUMBER_OFFSETS).select("*", F.explode("kinds").alias("kind")).withColumnRenamed("v2", "amount")
    first = near.groupBy("doc_id", "kind", "r", "c").agg(F.min_by(F.struct("amount", "r2", "c2"), "k").alias("x"))
    last = first.groupBy("doc_id", "kind").agg(F.max_by("x", F.struct("r", "c")).alias("x"))
    name = F.when(F.col("kind") == "total_amount", "TOTAL").otherwise(F.upper("kind"))
    found = last.select("doc_id", "kind", F.struct("x.amount", F.concat(name, F.lit("@R"), F.col("x.r2").cast("string"), F.lit("C"), F.col("x.c2").cast("string")).alias("trace")).alias("x"))
    chosen = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "x"))).alias("m"))  # as many as kinds at most
    order = [f"total_{prefer}"] if prefer in ("net", "vat") else []
    pick = F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in [*order, "total_gross", "total_amount"]])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), (pick if k == "total_amount" else F.try_element_at("m", F.lit(k))).alias("x")) for k in kinds])
    out = chosen.select("doc_id", F.explode_outer(rows).alias("y")).where("y.x is not null")
    return out.select("doc_id", "y.kind", "y.x.amount", "y.x.trace")


def sheet_documents(cells: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, fields, raw_text (null) of sheets, ready to be checked."""
    told = settings or Settings()
    pairs = cell_bins(cells).select("doc_id", F.col("role").alias("k"), F.col("bin").alias("v"))
    pairs = pairs.unionByName(cell_dates(cells, aliases=told.header_aliases).select("doc_id", F.lit("issue_date").alias("k"), F.col("issue_date").alias("v")))
    pairs = pairs.unionByName(cell_totals(cells, told.prefer_total, told.header_aliases, told.header_share).select("doc_id", F.col("kind").alias("k"), F.col("amount").cast("string").alias("v")))
    every = cells.select("doc_id").distinct().join(pairs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields")), "doc_id", "left")
    return every.select("doc_id", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), F.lit(None).cast("string").alias("raw_text"))
