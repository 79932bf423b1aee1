"""Substring dedup by recompression.

The rounds need no table of names: a name is a hash of what it stands for, so all partitions name alike, and what would be a Spark round of
naming is a pass over an array. Runs are renamed in the first round alone (later rounds only pair), as a run's context reaches over its neighbours and soon
over more than WINDOW words.

Words get names (64-bit hashes); rounds then rename maximal runs of one name, and pairs of a name of the left half of the
alphabet followed by one of the right half, halves being drawn anew by a hash in every round. A name
is a hash of the names it stands for, so it is the same in all partitions without a table of names, and equal
substrings get equal interior names; two substrings that share a name by accident only cost a comparison.

Each symbol knows the words it covers and the words that its parse depends on (its context). A window of
WINDOW words that holds a symbol's whole context holds that symbol wherever the window stands. Each window is
filed under the longest such symbol (ties: the largest name), so equal windows are filed under equal
names. Only names that stand in two documents can belong to a repeat: they reveal the candidates, whose
windows are then compared by 128-bit hashes of their words. Of exact copies only the first is compared. Windows without a contained symbol
of two words or more are filed under their words' names, so none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerege.llm._common import dropped, keeps_names, written
from kerege.shipping import ship_package

WINDOW = 13
ROUNDS = 3
#: Words named at once.
CHUNK = 200_000
#: Names, and then windows, are compared in so many slices of their hashes, each of which frees its shuffle files before the next.
SLICES = 4

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def window_names(names: np.ndarray, parts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The name under which each window of a sequence of word names is filed; the value at i is that of the window at i.

    parts has the document of each word, ascending; windows that reach over a document's end are meaningless.
    """
    n = len(names)
    best = np.zeros((window + 1) * (n + 1), np.uint64)  # at c * (n + 1) + w: largest score of a symbol whose context is the words w .. w + c
    # runs of one word: that they end depends on the words beside them, and beyond a document's end on words unknown
    same = (names[1:] == names[:-1]) & (parts[1:] == parts[:-1])
    s = np.flatnonzero(np.concatenate(([True], ~same))) if n else np.empty(0, np.int64)
    e = np.concatenate((s[1:], [n]))[: len(s)]
    doc = parts[s]
    sym = _mixed(_mixed(names[s] + _U(1)) + (e - s).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    inner = doc[1:] == doc[:-1]
    far = 4 * window + n
    cs = np.where(np.concatenate(([False], inner))[: len(s)], s - 1, -far)
    ce = np.where(np.concatenate((inner, [False]))[: len(s)], e + 1, far)
    for r in range(rounds):
        if len(sym) < 2:
            break
        # pairs: a pair depends on its two symbols alone, a symbol that stays single also on the one that it could have joined
        right = (_mixed(sym + _U((r + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) & _U(1)).astype(bool)
        joins = np.concatenate((~right[:-1] & right[1:] & (doc[1:] == doc[:-1]), [False]))
        at = np.flatnonzero(~np.concatenate(([False], joins[:-1])))
        pair = joins[at]
        other = np.where(right[at] & ~pair, at - 1, at + 1)
        there = (other >= 0) & (other < len(sym))
        other = np.where(there, other, at)
        there &= doc[other] == doc[at]
        cs, ce = np.where(there, np.minimum(cs[at], cs[other]), -far), np.where(there, np.maximum(ce[at], ce[other]), far)
        sym = np.where(pair, _mixed(sym[at] * _U(5) + _mixed(sym[other] + _U(7))), sym[at])
        s, e, doc = s[at], np.where(pair, e[other], e[at]), doc[at]
        fits = (ce - cs <= window) & (e - s > 1)
        score = (np.minimum((e - s)[fits], 15).astype(np.uint64) << _U(60)) | (sym[fits] >> _U(4))
        np.maximum.at(best, (ce - cs)[fits] * (n + 1) + cs[fits], score)
    best = best.reshape(window + 1, n + 1)
    within = best[1][:n].copy()
    for c in range(2, window + 1):
        wider = np.maximum(within, np.concatenate((within[1:], [_U(0)])))
        within = np.maximum(wider, best[c][:n])
    bare = np.flatnonzero(within[: max(0, n - window + 1)] == 0)
    if len(bare):
        name = np.zeros(len(bare), np.uint64)
        for k in range(window):
            name = _mixed(name * _U(31) + names[bare + k])
        within[bare] = name | _U(1)
    return within


def _named(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(d) for d in docs]
    digest = xxhash.xxh64_intdigest
    names = np.fromiter((digest(w) for d in docs for w in d), np.uint64, sum(sizes))
    return names, np.repeat(np.arange(len(docs)), sizes)


def _runs(window: int, rounds: int):
    """Rows (doc_id, text_hash, name, first, last) of runs of windows filed under one name, from (doc_id, text_hash, text)."""

    def made(ids: list, hashes: list, docs: list[list[bytes]]) -> pa.RecordBatch:
        names, part = _named(docs)
        filed = window_names(names, part, window, rounds)
        whole = np.flatnonzero(part[: len(part) - window + 1] == part[window - 1 :]) if len(part) >= window else np.empty(0, np.int64)
        filed = filed[whole].view(np.int64)
        start = np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1])).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (filed[1:] != filed[:-1]) | (whole[1:] != whole[:-1] + 1)))) if len(whole) else np.empty(0, np.int64)
        stop = np.concatenate((new[1:], [len(whole)]))[: len(new)] - 1
        owner = part[whole[new]] if len(new) else np.empty(0, np.int64)
        cut = [pa.array([ids[k] for k in owner.tolist()], pa.int64()), pa.array([hashes[k] for k in owner.tolist()], pa.int64()), pa.array(filed[new])]
        cut += [pa.array((whole[x] - start[owner]).astype(np.int32)) for x in (new, stop)]
        return pa.RecordBatch.from_arrays(cut, names=["doc_id", "text_hash", "name", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, docs, size = [], [], [], 0
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) >= window:
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    docs.append(words)
                    size += len(words)
                if size >= CHUNK:
                    yield made(ids, hashes, docs)
                    ids, hashes, docs, size = [], [], [], 0
        if docs:
            yield made(ids, hashes, docs)

    return run


def _hashes(window: int):
    """Rows (doc_id, place, h1, h2) of the candidate windows, from (doc_id, number, text, spans); place is number and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, places, digests = [], [], []
            for doc_id, number, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                first, last = spans.values.to_numpy() >> 32, spans.values.to_numpy() & 0xFFFFFFFF
                length = last - first + 1
                at = np.repeat(first - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
                begin = np.where(at > 0, ends[at - 1] + 1, 0)
                digests += [digest(joined[b:e]) for b, e in zip(begin.tolist(), ends[at + window - 1].tolist(), strict=True)]
                ids.append(np.full(len(at), doc_id))
                places.append(at | number << 32)
            both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            cut = [np.concatenate(ids) if ids else np.empty(0, np.int64), np.concatenate(places) if ids else np.empty(0, np.int64), both[:, 0].copy(), both[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cut], names=["doc_id", "place", "h1", "h2"])

    return run


def _in_slices(make, name: str) -> list[DataFrame]:
    """The tables of make(0) .. make(SLICES - 1), written one after the other, so that their shuffles don't stand on disk together."""
    return [written(make(k), name) for k in range(SLICES)]


def repeated_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, starts, whole): for each distinct row of docs with repeats, the starts of windows whose words also start in a
    document of smaller doc_id. A text that such a document has as a whole gets whole = true and no starts.
    """
    ship_package(docs.sparkSession)
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # exact copies: only the first one's windows are compared
    rows = written(keyed.select("doc_id", "text_hash", F.md5("text").alias("digest")).distinct(), "texts")
    owner = rows.groupBy("digest").agg(F.min("doc_id").alias("low"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")).cast("long").alias("number")  # of the texts of one doc_id
    rows = written(rows.join(owner, "digest").select("doc_id", "text_hash", number, (F.col("doc_id") > F.col("low")).alias("copy")), "texts")
    firsts, copies = rows.where("not copy").drop("copy"), rows.where("copy")

    runs = written(keyed.mapInArrow(_runs(window, rounds), "doc_id long, text_hash long, name long, first int, last int"), "runs")

    def revealed(k: int) -> DataFrame:
        part = runs.where(F.pmod("name", F.lit(SLICES)) == k)
        shared = part.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name")
        return part.join(shared, "name").select("doc_id", "text_hash", F.expr("shiftleft(cast(first as bigint), 32) | last").alias("span"))

    parts = _in_slices(revealed, "spans")
    dropped(runs)
    spans = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))
    grouped = written(spans.join(firsts, ["doc_id", "text_hash"]), "spans")
    for part in parts:
        dropped(part)
    found = keyed.join(grouped, ["doc_id", "text_hash"]).select("doc_id", "number", "text", "spans")
    hashed = written(found.mapInArrow(_hashes(window), "doc_id long, place long, h1 long, h2 long"), "windows")

    def verified(k: int) -> DataFrame:
        part = hashed.where(F.pmod("h1", F.lit(SLICES)) == k)
        lowest = part.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h1", "h2", "low")
        return part.join(lowest, ["h1", "h2"]).where("doc_id > low").select("doc_id", "place")

    late = reduce(DataFrame.unionByName, _in_slices(verified, "late"))
    dropped(hashed)
    dropped(grouped)
    late = late.groupBy("doc_id", F.expr("shiftright(place, 32)").alias("number")).agg(F.collect_set(F.expr("cast(place & 4294967295L as int)")).alias("starts"))
    starts = late.join(firsts, ["doc_id", "number"]).select("doc_id", "text_hash", "starts", F.lit(False).alias("whole"))
    return starts.unionByName(copies.select("doc_id", "text_hash", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole")))


def _kept_words(text: str | None, starts: list[int] | None, whole: bool | None, window: int) -> tuple[list[bytes], int, int]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if whole and len(words) >= window:
        return [], len(words), len(words)
    if not starts:
        return words, len(words), 0
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.asarray(starts), 1)
    np.add.at(covered, np.asarray(starts) + window, -1)
    keep = np.flatnonzero(np.cumsum(covered)[:-1] == 0).tolist()
    return [words[k] for k in keep], len(words), len(words) - len(keep)


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept_words(t.as_py(), s.as_py(), w, window) for t, s, w in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True)]
            cut = [
                batch.column(0),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(r[0])).hexdigest() for r in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cut, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _texts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            starts, whole, kept = cols.pop("__starts"), cols.pop("__whole").to_pylist(), []
            for text, s, w in zip(cols["text"], starts, whole, strict=True):
                words, _, removed = _kept_words(text.as_py(), s.as_py(), w, window) if w or s.is_valid else ([], 0, 0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass") if removed else text.as_py())
            cols["text"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _with_starts(docs: DataFrame, window: int) -> DataFrame:
    starts = repeated_windows(docs, window).select(*[F.col(a).alias(b) for a, b in (("doc_id", "__doc"), ("text_hash", "__hash"), ("starts", "__starts"), ("whole", "__whole"))])
    return docs.join(starts, (docs.doc_id == starts["__doc"]) & (F.xxhash64(docs.text) == starts["__hash"]), "left").drop(starts["__doc"], starts["__hash"])


@keeps_names
def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every word cut that stands in a window of `window` words which also starts in a document of smaller doc_id.

    All columns stay; texts that lose words have the others joined by one space, other texts stay as they are (null
    too). Windows are judged on the input. Rows that repeat a doc_id aren't each other's
    source, as none has the smaller one; rows without doc_id neither lose words nor are a source. An empty table gives an empty one.
    """
    joined = _with_starts(docs, window)
    return joined.mapInArrow(_texts(window), docs.schema)


def op2_recompression(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined = _with_starts(docs, WINDOW).select("doc_id", "text", "__starts", "__whole")
    return joined.mapInArrow(_digests(WINDOW), "doc_id long, n_words long, n_removed long, kept_sha256 string")


_OP2_WORDS = "case when text is null then [] else regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') end"
OP2_SQL = f"""
with w as (select doc_id, {_OP2_WORDS} as ws from documents),
x as (select doc_id, unnest(range(1, len(ws) - 11)) as i, ws from w where len(ws) >= 13),
g as (select doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') as s from x),
m as (select s, min(doc_id) as low from g group by s),
late as (select g.doc_id, list(g.i) as starts from g join m on g.s = m.s and m.low < g.doc_id group by g.doc_id),
hit as (select doc_id, list_distinct(flatten(list_transform(starts, lambda a: range(a, a + 13)))) as gone from late),
j as (select w.doc_id, ws, coalesce(gone, []) as gone from w left join hit on w.doc_id = hit.doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(gone) as bigint) as n_removed,
  sha256(coalesce(list_aggregate([ws[k] for k in range(1, len(ws) + 1) if not list_contains(gone, k)], 'string_agg', ' '), '')) as kept_sha256
from j
"""
