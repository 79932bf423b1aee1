"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Texts become lower-case words of letters and digits. A fixed mask over consecutive words keeps some places and ignores the
others, so a masked hash survives substitutions at ignored places; several masks ignore different ones.
Hashes of the training windows meet those of the benchmark in an equi-join. A hit fixes how the item lies on the document; there all the
item's words are compared with the document's. A document is contaminated if some WINDOW aligned words of an item (all of
them, if it has fewer) agree in a SHARE of the places.

No such document is missed: wherever the allowed substitutions stand in WINDOW words, one of SEEDS lies clear of them at some place
(the tests try all 286 placings). An item of n < WINDOW words with s allowed substitutions has n // (s + 1) words in a row without
one, and its seeds are all its runs of that length; the documents' runs are hashed only for lengths that the benchmark has.
OP4_SQL has the same seeds.

The benchmark's seeds are broadcast if it has at most BROADCAST_WORDS words (about 50 bytes a seed); a larger one is
joined by shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerege.llm._common import keeps_names, written

#: Fixed masks; 1 marks a place that counts.
SEEDS = ("111011", "1100001011", "110111")
WINDOW = 13
SHARE = 0.75
BROADCAST_WORDS = 300_000
#: Words of a text that are looked at together, at least as many as the longest item has.
BLOCK = 1024


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(0))


def run_length(n_words: int) -> int:
    """Words in a row that agree in any item of so few words (under WINDOW) with the allowed substitutions."""
    return n_words // (n_words - math.ceil(SHARE * n_words) + 1)


def seeds(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """rows with an array __words become, for each place and mask, a row of the other columns with __at and __key; the words aren't carried along."""
    for m, mask in enumerate(masks):
        kept = ", ".join(f"__words[i + {k}]" for k in range(len(mask)) if mask[k] == "1")
        rows = rows.withColumn(f"__k{m}", F.expr(f"case when size(__words) < {len(mask)} then cast(array() as array<bigint>) else transform(sequence(0, size(__words) - {len(mask)}), i -> xxhash64('{mask}', {kept})) end"))
    others = [c for c in rows.columns if c != "__words" and not c.startswith("__k")]
    placed = rows.select(*others, F.posexplode(F.arrays_zip(*[f"__k{m}" for m in range(len(masks))])).alias("__at", "__k"))
    return placed.select(*others, "__at", F.explode(F.array(*[F.col(f"__k.__k{m}") for m in range(len(masks))])).alias("__key")).where("__key is not null")


def item_seeds(items: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """Seeds of items (item_id, __words), and the masks that the documents need to meet them."""
    out, masks = seeds(items.where(F.size("__words") >= WINDOW), SEEDS), SEEDS
    sizes = [r[0] for r in items.select(F.size("__words")).where(F.size("__words").between(1, WINDOW - 1)).distinct().collect()]
    for run in sorted({run_length(n) for n in sizes}):
        same = [n for n in sizes if run_length(n) == run]
        out = out.unionByName(seeds(items.where(F.size("__words").isin(same)), ("1" * run,)))
        masks += ("1" * run,)
    return out, masks


#: Which places of the item agree with words of the text; __from is where the item starts among these.
_AGREE = "transform(__item, (w, j) -> if(coalesce(get(__words, __from + j) = w, false), 1, 0))"
_COUNT = "aggregate(__agree, 0, (a, x) -> a + x)"


def _enough() -> Column:
    """Does some window of __agree suffice? The places are counted first, as most hits by chance fall short in all."""
    need = math.ceil(SHARE * WINDOW)
    short = f"size(__agree) < {WINDOW} and {_COUNT} >= ceil({SHARE} * size(__agree))"
    windows = f"exists(sequence(0, size(__agree) - {WINDOW}), s -> aggregate(slice(__agree, s + 1, {WINDOW}), 0, (a, x) -> a + x) >= {need})"
    return F.expr(f"({short}) or (size(__agree) >= {WINDOW} and {_COUNT} >= {need} and {windows})")


def blocks(texts: DataFrame, size: int, more: int) -> DataFrame:
    """texts with __words cut into rows of the other columns, __block and __words: `size` words each, and the `more` words that follow."""
    others = [c for c in texts.columns if c != "__words"]
    cut = f"transform(sequence(0, greatest(size(__words) - 1, 0) div {size}), b -> struct(b as __block, slice(__words, b * {size} + 1, {size + more}) as __words))"
    return texts.select(*others, F.explode(F.expr(cut)).alias("__b")).select(*others, F.col("__b.__block").alias("__block"), F.col("__b.__words").alias("__words"))


def contaminated_items(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, overlap long): documents that hold an item of benchmark (item_id, text), with most agreeing places.

    A hit is a lie of an item on a document: its start. Lies meet the block of words in which they start, not the document, so
    that a text in which an item repeats costs in proportion to its length, and one text's lies are dealt over many tasks.
    """
    items = written(benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), normal_words(F.col("text")).alias("__words")).distinct(), "items")
    found, masks = item_seeds(items.withColumn("__n", F.size("__words")))
    seeded = found.select("__key", F.col("__at").alias("__item_at"), "item_id", "__n")
    n_words, longest = (x or 0 for x in items.agg(F.sum(F.size("__words")), F.max(F.size("__words"))).first())
    size = max(block, longest)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__hash"), "text")
    placed = seeds(texts.select("doc_id", "__hash", normal_words(F.col("text")).alias("__words")), masks)
    hits = placed.join(F.broadcast(seeded) if n_words <= broadcast_words else seeded, "__key")
    # one row for each lie of an item on a document, however many seeds agree
    start = F.col("__at") - F.col("__item_at")
    lies = hits.select("doc_id", "__hash", "item_id", "__n", start.alias("__start"), F.expr(f"greatest(__at - __item_at, 0) div {size}").cast("int").alias("__block")).distinct()
    lies = written(lies, "lies")
    hit = lies.select("doc_id", "__hash").distinct()
    same = texts.doc_id.eqNullSafe(hit.doc_id) & (texts["__hash"] == hit["__hash"])
    held = blocks(texts.join(hit, same, "left_semi").select("doc_id", "__hash", normal_words(F.col("text")).alias("__words")), size, longest)
    at = lies.doc_id.eqNullSafe(held.doc_id) & (lies["__hash"] == held["__hash"]) & (lies["__block"] == held["__block"])
    # the words from the lie's start on are cut out within the join, so that no lie carries its block further
    begin = lies["__start"] - lies["__block"] * size
    words = F.slice(held["__words"], F.greatest(begin, F.lit(0)) + 1, lies["__n"])
    laid = lies.join(held, at).select(lies.doc_id.alias("doc_id"), "item_id", F.least(begin, F.lit(0)).alias("__from"), words.alias("__words"))
    whole = items.select("item_id", F.col("__words").alias("__item"))
    laid = laid.join(F.broadcast(whole) if n_words <= broadcast_words else whole, "item_id")
    agreed = laid.select("doc_id", "item_id", F.expr(_AGREE).alias("__agree")).where(_enough())
    return agreed.groupBy("doc_id", "item_id").agg(F.max(F.expr(f"cast({_COUNT} as bigint)")).alias("overlap"))


@keeps_names
def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without those that hold benchmark passages, with all their columns; rows that repeat a doc_id go together."""
    gone = contaminated_items(docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs.doc_id.cast("long").eqNullSafe(gone["__gone"]), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per doc_id of docs: contaminated, item_id and overlap of the item with most agreeing places (ties: the least id), n_items.

    Null and short texts hold nothing; rows that repeat a doc_id (null too) are one document that holds what any of them holds. Items
    without text are ignored, equal items are separate ones. An empty benchmark finds nothing. Other columns are ignored.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("overlap"))
    rows = every.unionByName(contaminated_items(docs, benchmark))
    best = F.max(F.when(F.col("overlap").isNotNull(), F.struct("overlap", (-F.col("item_id")).alias("minus"))))
    out = rows.groupBy("doc_id").agg(best.alias("best"), F.count("overlap").alias("n_items"))
    return out.select("doc_id", F.col("best").isNotNull().alias("contaminated"), (-F.col("best.minus")).alias("item_id"), F.col("best.overlap").alias("overlap"), "n_items")


def op4_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    """The whole documents table against the whole benchmark table."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_key(mask: str) -> str:
    kept = ", ".join(f"ws[i + {k + 1}]" for k in range(len(mask)) if mask[k] == "1")
    return f"case when i + {len(mask)} <= len(ws) then concat_ws(' ', '{mask}', {kept}) end"


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_KEYS = "[" + ", ".join(map(_sql_key, SEEDS)) + "]"
_RUN = f"(len(ws) // (len(ws) - cast(ceil({SHARE} * len(ws)) as bigint) + 1))"
_RUN_KEY = "'run ' || array_to_string(ws[i + 1:i + run], ' ')"
OP4_SQL = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark where text is not null),
short as (select item_id, ws, {_RUN} as run from b where len(ws) between 1 and {WINDOW - 1}),
dp as (select doc_id, ws, unnest(range(0, len(ws))) as i from d),
bp as (select item_id, ws, unnest(range(0, len(ws))) as i from b where len(ws) >= {WINDOW}),
dk as (select doc_id, i, unnest({_KEYS}) as k from dp union all select doc_id, i, {_RUN_KEY} from dp, (select distinct run from short) where i + run <= len(ws)),
bk as (select item_id, i, unnest({_KEYS}) as k from bp union all select item_id, i, {_RUN_KEY} from (select *, unnest(range(0, len(ws) - run + 1)) as i from short)),
h as (select distinct doc_id, item_id, dk.i - bk.i as s from dk join bk on dk.k = bk.k),
a as (select h.doc_id, h.item_id, list_transform(range(1, len(b.ws) + 1), lambda j: case when s + j >= 1 and s + j <= len(d.ws) and d.ws[s + j] = b.ws[j] then 1 else 0 end) as agree
  from h join d on h.doc_id = d.doc_id join b on h.item_id = b.item_id),
w as (select doc_id, item_id, list_sum(agree) as n, list_max(list_transform(range(0, greatest(0, len(agree) - {WINDOW}) + 1), lambda x: list_sum(agree[x + 1:x + {WINDOW}]))) as top,
  ceil({SHARE} * least({WINDOW}, len(agree))) as need from a),
m as (select doc_id, item_id, max(n) as n from w where top >= need group by all),
r as (select doc_id, row_number() over (partition by doc_id order by n desc, item_id) as k, item_id, n, count(*) over (partition by doc_id) as c from m)
select d.doc_id, r.doc_id is not null as contaminated, r.item_id, cast(r.n as bigint) as overlap, coalesce(c, 0) as n_items
from d left join r on d.doc_id = r.doc_id and r.k = 1
"""
