"""Document quality from a linear-chain conditional random field over lines.

Every line with a word has features of its own and those of the lines before and after it (counts per word or per letter; no labels,
languages, sources or ids). The field labels each line good or bad. Training labels are those of documents: each line of a training document
takes its document's. The likelihood of the lines' labels is climbed by Adam steps on a bounded sample of labelled rows.
A document's score is the mean of its lines' forward-backward marginals of good, weighted by their lengths in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.shipping import ship_package

#: The sample that the field is fitted on: at most so many training rows, those with the smallest hashes of doc_id,
#: of at most so many bytes each.
TRAIN_ROWS = 3000
TRAIN_BYTES = 20_000
STEPS = 120
RATE = 0.15
RIDGE = 1e-3
THRESHOLD = 0.5

_OTHER, _LOWER, _UPPER, _DIGIT, _MARK, _SHOUT, _BAR, _PUNCT = range(8)
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _LOWER
for _chars, _k in (("#*$%&<>@^~=_+\\/{}[]", _MARK), ("!?", _SHOUT), ("|", _BAR), (".,;:'\"()-", _PUNCT)):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
OWN = 9


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the text's lines that have a word: n x OWN and n."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = [x for x in data.split(b"\n") if x.split()]
    if not lines:
        return np.zeros((0, OWN)), np.zeros(0)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.repeat(np.arange(len(lines)), size)
    kind = np.bincount(at * 8 + _CLASS[np.frombuffer(b"".join(lines), np.uint8)], minlength=8 * len(lines)).reshape(-1, 8)
    words = [x.split() for x in lines]
    n = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    letters = kind[:, _LOWER] + kind[:, _UPPER]
    own = [
        np.log1p(n),
        1 - distinct / n,
        np.minimum(kind[:, _MARK] / n, 3),
        np.minimum(kind[:, _SHOUT] / n, 3),
        np.minimum(kind[:, _BAR] / n, 3),
        kind[:, _UPPER] / np.maximum(letters, 1),
        np.minimum(kind[:, _DIGIT] / n, 3),
        np.minimum(kind[:, _PUNCT] / n, 3),
        np.log1p(letters / n),
    ]
    return np.stack(own, 1), size.astype(np.float64)


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A constant, a line's features, and those of the lines before and after (zeros at a text's ends); first marks texts' first lines."""
    zero = np.zeros((1, own.shape[1]))
    before = np.concatenate((zero, own[:-1]))[: len(own)] * ~first[:, None]
    after = np.concatenate((own[1:], zero))[: len(own)] * ~np.concatenate((first[1:], [True]))[: len(own), None]
    return np.concatenate((np.ones((len(own), 1)), own, before, after), 1)


class Field:
    """Two labels; a line's energy for good is x . w, and a pair of like labels in a row gains `stay`."""

    def __init__(self, weights: np.ndarray, stay: float, mean: np.ndarray, scale: np.ndarray, empty: float):
        self.weights, self.stay, self.mean, self.scale, self.empty = weights, stay, mean, scale, empty

    def inputs(self, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((own - self.mean) / self.scale, first)


def marginals(energy: np.ndarray, sizes: np.ndarray, stay: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Forward-backward over many chains laid end to end, all chains' k-th lines at once.

    Returns each line's marginal of good, the sum of the chains' log partition functions, and for each line the chance that it is
    labelled as the line before it (0 for first ones).
    """
    start = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # chains longer than k
    n = len(energy)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack((np.zeros(n), energy), 1)
    step = np.array([[stay, 0.0], [0.0, stay]])
    for k, m in enumerate(live.tolist()):
        here = start[order[:m]] + k
        forward[here] = score[here] if k == 0 else score[here] + np.logaddexp.reduce(forward[here - 1][:, :, None] + step, axis=1)
    for k in range(len(live) - 2, -1, -1):
        here = start[order[: live[k + 1]]] + k
        backward[here] = np.logaddexp.reduce((backward[here + 1] + score[here + 1])[:, None, :] + step, axis=2)
    both = forward + backward
    total = np.logaddexp.reduce(both, axis=1)
    good = np.exp(both[:, 1] - total)
    same = np.zeros(n)
    inner = np.ones(n, bool)
    inner[start[sizes > 0]] = False
    i = np.flatnonzero(inner)
    pair = forward[i - 1] + score[i] + backward[i] + stay - total[i, None]
    same[i] = np.exp(pair).sum(1)
    return good, float(total[start[sizes > 0]].sum()), same


def fit(own: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """The field for texts' lines laid end to end; labels are the texts', 0 or 1. Chains count alike whatever their length."""
    rate = float(labels.mean()) if len(labels) else 0.5
    if not len(own):
        return Field(np.zeros(1 + 3 * OWN), 0.0, np.zeros(OWN), np.ones(OWN), rate)
    mean, scale = own.mean(0), np.maximum(own.std(0), 1e-3)
    first = np.zeros(len(own), bool)
    first[np.cumsum(sizes)[:-1]] = True
    first[0] = True
    field = Field(np.zeros(1 + 3 * OWN), 0.0, mean, scale, rate)
    x = field.inputs(own, first)
    y, weight = np.repeat(labels, sizes), np.repeat(1 / sizes, sizes) / len(sizes)
    value, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        good, _, same = marginals(x @ value[:-1], sizes, value[-1])
        slope = np.concatenate((x.T @ ((y - good) * weight), [((~first - same) * weight).sum()])) - RIDGE * value
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        value = value + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    field.weights, field.stay = value[:-1], float(value[-1])
    return field


def scores(texts: list[str | None], field: Field) -> np.ndarray:
    """Length-weighted mean marginals of good; texts without a word get the training rows' share of good ones."""
    parts = [line_features(t) for t in texts]
    sizes = np.array([len(p[1]) for p in parts], np.int64)
    out = np.full(len(texts), field.empty)
    if sizes.sum():
        own, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first = np.zeros(len(own), bool)
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))[sizes > 0]
        first[start] = True
        good, _, _ = marginals(field.inputs(own, first) @ field.weights, sizes[sizes > 0], field.stay)
        out[sizes > 0] = np.add.reduceat(good * length, start) / np.add.reduceat(length, start)
    return np.clip(out, 0, 1)


def _scored(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).to_pylist(), field))], names=["doc_id", "score"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [line_features(t.as_py())[0].ravel() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.float64())), batch.column(1)], names=["own", "quality"])


def train(docs: DataFrame, labels: DataFrame, trained, rows: int = TRAIN_ROWS) -> Field:
    """Fit on at most `rows` labelled rows of docs for which `trained(doc_id)` holds; their line features come to the driver."""
    ship_package(docs.sparkSession)
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("quality") > 0, 1).otherwise(0).alias("quality")).distinct()
    known = known.where(trained(F.col("id"))).withColumn("place", F.xxhash64("id"))
    # twice as many ids as rows, as a few are of long texts
    chosen = known.orderBy("place", "id", "quality").limit(2 * rows)
    text = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.octet_length("text") <= TRAIN_BYTES)
    sample = text.join(chosen, "id").orderBy("place", "id", "quality", F.xxhash64("text")).limit(rows)
    found = sample.select("text", "quality").mapInArrow(_features, "own array<double>, quality int").toArrow()
    own = [np.asarray(x, np.float64).reshape(-1, OWN) for x in found.column("own").to_pylist()]
    full = [k for k, x in enumerate(own) if len(x)]
    quality = found.column("quality").to_numpy()[full] if full else np.zeros(0)
    return fit(np.concatenate([own[k] for k in full]) if full else np.zeros((0, OWN)), np.array([len(own[k]) for k in full], np.int64), quality.astype(np.float64))


def quality(docs: DataFrame, labels: DataFrame, trained, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels (doc_id, quality) are read where `trained(doc_id)` holds.

    Null texts count as empty and get the training rows' share of good ones (one half without training rows). Rows that repeat a doc_id
    are scored each for itself; labelled rows without doc_id aren't trained on. Texts are scored whole whatever their length (those of over TRAIN_BYTES aren't trained
    on). An empty table gives an empty one; other columns are ignored.
    """
    field = train(docs, labels, trained)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(field), "doc_id long, score double")
    return found.select("doc_id", (~trained(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op7_line_field(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole documents table; labels are read from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda doc_id: F.crc32(doc_id.cast("string")) % 3 != 1)
