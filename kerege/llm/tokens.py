"""Token counts by rank-synchronous array merging.

A text is cut where no piece can reach across: in front of each space mark that follows another character, and at lines' ends. The
distinct pre-tokens of a batch are laid out as one ragged array of symbols (one for each character at first). Every
step finds each sequence's lowest-rank pair and merges it in all sequences at once; a sequence without a
pair that makes a piece leaves the array. What survives is counted: a symbol that is a piece is one token,
any other character as many as it has UTF-8 bytes (byte fallback). Counts of pre-tokens are kept and reused, so a
text's count is a sum of look-ups.

Within one sequence all places of the lowest rank merge at once where that gives what merging from the left, one
at a time, gives: the places don't overlap and no new pair ranks as low. Else the leftmost merges alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.shipping import ship_package

LIMIT = 4096
#: Pre-tokens whose counts a worker keeps; when they are more, it starts anew (speed alone depends on it).
KEPT = 500_000
#: Characters that are merged in one array, unless one pre-token has more.
SYMBOLS = 400_000

MARK = "▁"
#: Characters, spaces and line ends that other normalisations than the identity would change.
_PROBE = " ﬁＡ①  x\té\n e\u0301 "
_SLOTS = 20
_NONE = np.iinfo(np.int64).max


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with identity normalisation, dummy prefix and byte fallback; others raise ValueError."""

    def __init__(self, model_file: str, kept: int = KEPT):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if model.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK) or not any(model.is_byte(i) for i in range(model.vocab_size())):
            raise ValueError(f"{model_file} changes texts before it cuts them, or has no byte pieces; its tokens can't be counted here")
        special = {i for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        score = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if i not in special}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbols = {p: i for i, p in enumerate([*score, *sorted({c for p in score for c in p} - score.keys())])}
        self.pieces = len(score)
        self.symbol = {c: i for c, i in symbols.items() if len(c) == 1}
        self.other = len(symbols)
        pairs = sorted((symbols[p[:k]] << 32 | symbols[p[k:]], symbols[p], ranks[s]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pair, self.made, self.rank = np.ascontiguousarray(np.array([*pairs, (_NONE, 0, _NONE)], np.int64).T)
        # a pair's row in these arrays by its hash; pairs that another has kept from their slot are searched
        self.slot = np.full(1 << _SLOTS, len(self.pair) - 1, np.int32)
        at, first = np.unique(self._hashed(self.pair), return_index=True)
        self.slot[at] = first
        # no piece holds a line's end in most models; then texts are cut there too
        line = "" if any("\n" in p for p in score) else r"\n"
        self.unit = re.compile(rf"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}+" if line else ""))
        self.kept, self.counts = kept, {}

    @staticmethod
    def _hashed(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = self.slot[self._hashed(key)]
        found = self.pair[at] == key
        unsure = np.flatnonzero(~found & (at != len(self.pair) - 1))
        at[unsure] = np.searchsorted(self.pair, key[unsure])
        found[unsure] = self.pair[at[unsure]] == key[unsure]
        return np.where(found, self.rank[at], _NONE), self.made[at]

    def merged(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit (not empty, as normalised)."""
        text = "".join(units)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        values, where = np.unique(chars, return_inverse=True)
        ids = np.array([self.symbol.get(chr(v), self.other) for v in values], np.int64)[where]
        size = np.array([len(chr(v).encode("utf-8", "surrogatepass")) for v in values], np.int64)[where]
        weight = np.where(ids < self.pieces, 1, size)
        seq = np.repeat(np.arange(len(units)), [len(u) for u in units])
        out = np.zeros(len(units), np.int64)
        rank, made = self._all(ids, seq)
        while len(seq):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(rank, first)
            run = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(seq)]))))
            going = least[run] < _NONE
            if not going.all():
                done = ~going
                out += np.bincount(seq[done], weight[done], len(units)).astype(np.int64)
                ids, seq, weight, rank, made = (x[going] for x in (ids, seq, weight, rank, made))
                continue
            chosen = np.flatnonzero(rank == least[run])
            new = np.concatenate(([True], (chosen[1:] != chosen[:-1] + 1) | (seq[chosen[1:]] != seq[chosen[:-1]])))
            place = np.arange(len(chosen))
            chosen = chosen[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            leftmost = np.concatenate(([True], seq[chosen[1:]] != seq[chosen[:-1]]))
            if not leftmost.all():
                # would several merges of one sequence make a pair that comes before the rest of them?
                after_ids, _, _, after_seq, fresh = self._merge(ids, weight, made, seq, chosen)
                after_rank = self._all(after_ids, after_seq)[0]
                near = fresh | np.concatenate((fresh[1:], [False]))
                early = near & (after_rank <= least[np.searchsorted(seq[first], after_seq)])
                risky = np.unique(after_seq[early])
                chosen = chosen[leftmost | ~np.isin(seq[chosen], risky)]
            ids, weight, keep, seq, fresh = self._merge(ids, weight, made, seq, chosen)
            rank, made = rank[keep], made[keep]
            stale = np.flatnonzero(fresh | np.concatenate((fresh[1:], [False])))
            beside = np.minimum(stale + 1, len(seq) - 1)
            same = (seq[beside] == seq[stale]) & (beside != stale)
            r, m = self._ranked(ids[stale], ids[beside])
            rank[stale], made[stale] = np.where(same, r, _NONE), m
        return out

    def _all(self, ids: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = self._ranked(ids, np.concatenate((ids[1:], [self.other])))
        rank[np.concatenate((seq[1:] != seq[:-1], [True]))] = _NONE
        return rank, made

    @staticmethod
    def _merge(ids, weight, made, seq, chosen):
        ids, weight, keep, fresh = ids.copy(), weight.copy(), np.ones(len(ids), bool), np.zeros(len(ids), bool)
        ids[chosen] = made[chosen]
        weight[chosen] = 1
        keep[chosen + 1] = False
        fresh[chosen] = True
        return ids[keep], weight[keep], keep, seq[keep], fresh[keep]

    def units(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.counts) > self.kept:
            self.counts.clear()
        counts, cut, missing = self.counts, [self.units(t) for t in texts], set()
        for units in cut:
            missing.update(set(units).difference(counts))
        todo, size = [], 0
        for unit in sorted(missing):
            todo.append(unit)
            size += len(unit)
            if size >= SYMBOLS:
                counts.update(zip(todo, self.merged(todo).tolist(), strict=True))
                todo, size = [], 0
        if todo:
            counts.update(zip(todo, self.merged(todo).tolist(), strict=True))
        return [sum(map(counts.__getitem__, units)) for units in cut]


_counters: dict[str, PieceCounter] = {}


def _counted(model_file: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kerege.llm import tokens

        counter = tokens._counters.setdefault(model_file, None) or tokens.PieceCounter(model_file)
        tokens._counters[model_file] = counter
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = np.array(counter.count(texts), np.int64)
                size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    Null texts count as empty, which have no tokens. Texts are counted whole whatever their length. Rows that repeat are counted each for
    itself, a null doc_id stays null. An empty table gives an empty one; other columns are ignored. A model that normalises texts raises ValueError.
    """
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(model_file, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_rank_synchronous(spark, sf_dir: str) -> DataFrame:
    """Token counts of the whole documents table under piece_bpe_32k.model."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
