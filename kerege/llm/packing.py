"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most `capacity` tokens. Pieces are dealt by hash into blocks of about BLOCK pieces, so
a block is a fair sample of the lengths whatever repeats. Each block is evolved on ISLANDS islands, one Spark
group each: a solution is a list of bins; crossover injects whole well-filled bins of one parent into the other, drops the
bins that hold the same pieces, swaps displaced pieces for smaller ones where that fills a bin better, and best-fits the
displaced ones; mutation empties the least filled bins and a few others. After each
epoch every island sends its elite to the next one in the ring. The fewest bins of a block win. The least filled bins of
all blocks are opened again and packed once more across blocks, so what is lost at the blocks' edges is small.
An island stops once it has as few bins as the total length allows.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.llm._common import written
from kerege.shipping import ship_package

CAPACITY = 2048
END = 0
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
STEPS = 24
POPULATION = 5
#: Bins, and displaced pieces, that one crossover or mutation looks at for swaps.
SWAPS = 200
#: Share of a block's bins, the least filled ones, that is packed again across blocks.
OPEN = 0.05
#: Chunks whose ids a worker keeps; when they are more, it starts anew (speed alone depends on it).
KEPT = 500_000

_ODD = re.compile(r"\s | \s|^ | \Z")


class ChunkEncoder:
    """Ids of a byte-level BPE, as little-endian unsigned 32-bit bytes, by way of the chunks between spaces.

    A space between two other characters that aren't white space always begins a pre-token, so texts are cut there and
    the chunks' ids are kept and reused; a text with other spaces or a special token's string is encoded whole.
    Where the file's merges stand in the order of their ids, tiktoken encodes the chunks by the same vocabulary, as it is several times faster.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.kept, self.inner, self.lead = kept, {}, {}
        self.ranked = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary for tiktoken, or None if ids aren't ranks."""
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary, merges, before = told["model"]["vocab"], told["model"]["merges"], told["pre_tokenizer"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if told["normalizer"] or before != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True}:
            return None
        if any(vocabulary[a + b] != 256 + k for k, (a, b) in enumerate(pairs)) or len(vocabulary) != 256 + len(pairs):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items()}
        return tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self._whole(chunks)
        encode = self.ranked.encode_ordinary
        return [array("I", encode(c)).tobytes() for c in chunks]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text) or (self.special and self.special.search(text)):
            return self._whole([text])[0]
        first, *rest = text.split(" ")
        inner = self.inner
        parts = list(map(inner.get, rest))
        if None in parts:
            if len(inner) > self.kept:
                inner.clear()
            missing = list({c for c, p in zip(rest, parts, strict=True) if p is None})
            found = dict(zip(missing, self._chunks([" " + c for c in missing]), strict=True))
            parts = [found[c] if p is None else p for c, p in zip(rest, parts, strict=True)]
            inner.update(found)
        if (head := self.lead.get(first)) is None:
            if len(self.lead) > self.kept // 4:
                self.lead.clear()
            head = self.lead[first] = self._chunks([first])[0]
        return head + b"".join(parts)


_encoders: dict[str, ChunkEncoder] = {}
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document's ids; only the first may be shorter than the capacity."""
    n = len(ids) // 4
    at = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(at, at[1:], strict=False)]


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kerege.llm import packing

        encoder = packing._encoders.get(path) or packing._encoders.setdefault(path, packing.ChunkEncoder(path))
        end, salt = END.to_bytes(4, "little"), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                salt += 1
                rows += [(doc_id, k, a, n, crc, salt) for k, (a, n, crc) in enumerate(packing.cut(encoder.encode(text.as_py() or "") + end, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


class Bins:
    """Bins under best fit: find the fullest bin with room for a length."""

    def __init__(self, capacity: int, bins: list[list[int]], lengths: list[int]):
        self.capacity, self.lengths, self.bins = capacity, lengths, bins
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for b, items in enumerate(bins):
            self._put(b, capacity - sum([lengths[i] for i in items]))

    def _put(self, b: int, room: int) -> None:
        self.by_room[room].append(b)
        self.mask |= 1 << room

    def fit(self, items: list[int]) -> None:
        """Best-fit the items, longest first."""
        for i in sorted(items, key=self.lengths.__getitem__, reverse=True):
            n = self.lengths[i]
            free = self.mask >> n
            if free:
                room = n + (free & -free).bit_length() - 1
                b = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.mask &= ~(1 << room)
                self.bins[b].append(i)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([i])
            self._put(b, room - n)


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more unevenly filled: (-bins, mean square of fill)."""
    return -len(bins), sum((sum([lengths[i] for i in b]) / capacity) ** 2 for b in bins) / max(1, len(bins))


def replaced(bins: list[list[int]], loose: list[int], lengths: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Swap displaced items for one or two smaller ones of a bin that they fill better; changes the bins, returns what is displaced then.

    Small items are easier to place afterwards, so each swap leaves best fit an easier rest. SWAPS bins and items are looked at.
    """
    loose = sorted(loose, key=lengths.__getitem__, reverse=True)
    for b in rng.sample(range(len(bins)), min(len(bins), SWAPS)):
        items = bins[b]
        room = capacity - sum([lengths[i] for i in items])
        if not room or not loose:
            continue
        sets = [(lengths[i], (i,)) for i in items] + [(lengths[i] + lengths[j], (i, j)) for k, i in enumerate(items[:12]) for j in items[:k]]
        best = None
        for at in range(min(len(loose), SWAPS)):
            n = lengths[loose[at]]
            for size, out in sets:
                if 0 < n - size <= room and (best is None or n - size > best[0]):
                    best = (n - size, at, out)
            if best and best[0] == room:
                break
        if best:
            bins[b] = [i for i in items if i not in best[2]] + [loose.pop(best[1])]
            loose = sorted([*loose, *best[2]], key=lengths.__getitem__, reverse=True)
    return loose


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject a run of b's well-filled bins into a, drop a's bins that hold any of their items, best-fit what these held besides."""
    full = sorted(b, key=lambda x: -sum([lengths[i] for i in x]))[: max(1, len(b) // 2)]
    size = max(1, min(len(full), rng.randrange(1, len(full) // 4 + 2)))
    at = rng.randrange(len(full) - size + 1)
    injected = [list(x) for x in full[at : at + size]]
    gone = {i for x in injected for i in x}
    kept, loose = injected, []
    for x in a:
        if gone.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in gone]
    loose = replaced(kept, loose, lengths, capacity, rng)
    bins = Bins(capacity, kept, lengths)
    bins.fit(loose)
    return bins.bins


def mutated(bins: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empty the least filled bin and a few others, and best-fit their items in a shuffled order of bins."""
    order = sorted(range(len(bins)), key=lambda k: sum([lengths[i] for i in bins[k]]))
    out = set(order[: 1 + len(bins) // 50]) | {rng.randrange(len(bins)) for _ in range(2 + len(bins) // 50)}
    kept = [list(x) for k, x in enumerate(bins) if k not in out]
    rng.shuffle(kept)
    loose = replaced(kept, [i for k in out for i in bins[k]], lengths, capacity, rng)
    found = Bins(capacity, kept, lengths)
    found.fit(loose)
    return found.bins


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, seed: int, steps: int = STEPS) -> list[list[list[int]]]:
    """Some generations of one island; the best solution comes first. Stops at the least number of bins that can be."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    population = list(population)
    if not population:
        first = Bins(capacity, [], lengths)
        first.fit(list(range(len(lengths))))
        population = [first.bins]
    score = lambda x: fitness(x, lengths, capacity)
    while len(population) < POPULATION and len(population[0]) > least:
        population.append(mutated(population[0], lengths, capacity, rng))
    ranked = sorted(((score(x), x) for x in population), key=lambda p: p[0], reverse=True)
    for _ in range(steps):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = rng.sample(ranked, 2)
        child = crossover(a[1], b[1], lengths, capacity, rng)
        if rng.random() < 0.5:
            child = mutated(child, lengths, capacity, rng)
        ranked = sorted([*ranked, (score(child), child)], key=lambda p: p[0], reverse=True)[:POPULATION]
    return [x for _, x in ranked]


_STATE = "block long, island int, lengths array<int>, solution array<int>, rank int, bins int, room double"


def _flat(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            out[i] = b
    return out


def _bins(flat: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, b in enumerate(flat):
        out[b].append(i)
    return out


def _epoch(capacity: int, islands: int, epoch: int, steps: int):
    """A group's rows are one island's solutions, its own and those that have come to it; the same again for the next epoch."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, island = (k.as_py() for k in key)
        lengths = table.column("lengths")[0].as_py()
        come = [_bins(s) for s in table.column("solution").to_pylist() if s]
        found = evolve(lengths, come, capacity, seed=(block * 31 + island) * 31 + epoch, steps=steps)[:POPULATION]
        rows = [(island, x, k) for k, x in enumerate(found)]
        if islands > 1:  # the elite also goes to the next island
            rows.append(((island + 1) % islands, found[0], POPULATION))
        scores = [fitness(x, lengths, capacity) for _, x, _ in rows]
        columns = [[block] * len(rows), [r[0] for r in rows], [lengths] * len(rows), [_flat(r[1], len(lengths)) for r in rows], [r[2] for r in rows], [-s[0] for s in scores], [s[1] for s in scores]]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "island", "lengths", "solution", "rank", "bins", "room"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, steps: int = STEPS, level: int = 0) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, salt) with block, bin, fill, offset: one bin number for each bin within its block."""
    ship_package(pieces.sparkSession)
    total = pieces.count()
    blocks = max(1, -(-total // block))
    item = F.struct((-F.col("length")).alias("minus"), "doc_id", "piece", "salt", "start", "length", "ids_crc32")
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(level)), F.lit(blocks)))
    dealt = written(dealt.groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items")), "blocks")
    state = dealt.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.transform("items", lambda x: x.length.cast("int")).alias("lengths"), F.array().cast("array<int>").alias("solution"))
    for epoch in range(epochs):
        state = written(state.groupBy("block", "island").applyInArrow(_epoch(capacity, islands, epoch, steps), _STATE), "islands")
        state, best = state.select("block", "island", "lengths", "solution"), state
    top = best.groupBy("block").agg(F.max_by("solution", F.struct(-F.col("bins"), "room", -F.col("island"), -F.col("rank"))).alias("solution"))
    both = dealt.join(top, "block").select("block", F.explode(F.arrays_zip("items", "solution")).alias("x"))
    placed = both.select("block", F.col("x.solution").alias("bin"), *[F.col(f"x.items.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "salt")])
    from pyspark.sql import Window

    inside = Window.partitionBy("block", "bin")  # a bin has at most `capacity` pieces, as none is empty
    before = inside.orderBy(F.desc("length"), "doc_id", "piece", "salt").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumns({"fill": F.sum("length").over(inside), "offset": F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))})


def packed(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each document's pieces and their places.

    Null texts count as empty and still take one token, the end. Rows that repeat a doc_id are packed as documents of
    their own, a null doc_id stays null. Texts are packed whole whatever their length. An empty table gives no sequence. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer_file, capacity), _PIECE), "pieces")
    first = written(pack(pieces, capacity), "packed")
    # the least filled bins of each block are packed again together with those of other blocks
    ranked = first.where("offset = 0").select("block", "bin", "fill")
    cutoff = ranked.groupBy("block").agg(F.percentile_approx("fill", F.lit(OPEN), F.lit(1000)).alias("low"))
    marked = first.join(cutoff, "block")
    opened = (F.col("fill") <= F.col("low")) & (F.col("fill") < capacity)
    again = pack(marked.where(opened).select("doc_id", "piece", "start", "length", "ids_crc32", "salt"), capacity, level=1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    number = lambda top: (F.lit(top) + F.col("block") * F.lit(1 << 24) + F.col("bin")).cast("long").alias("sequence_id")
    return marked.where(~opened).select(*columns, number(0), "offset").unionByName(again.select(*columns, number(1 << 62), "offset"))


def op5_grouping_genetic(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, packed into sequences of 2048 tokens of byte_bpe_50k.json."""
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
