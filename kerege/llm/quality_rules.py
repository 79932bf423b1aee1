"""Quality rules: base counts and robust multivariate outliers, in DataFrame functions alone.

Every text gets counts of words, symbols, repeated lines and repeated words. Documents that the base rules fail are rejected. The others
become vectors of four transformed statistics (log of word length, log of symbols, of repeated lines and of
repeated words per hundred words). For each language and source the mean and covariance of the SHARE of rows with the least determinant of their
covariance are sought: from three starts (medians with the spread of quartiles; medians with the covariance of squashed rows; mean and covariance of
all rows) C-steps take the SHARE of rows with the smallest Mahalanobis distances for the next estimate, until no determinant falls by over a
thousandth any more (STEPS at most); the start with the least determinant wins. FLOORS are added to the variances, as most of these counts are zero in
most documents. A document is rejected if its squared distance is over CUTOFF, the chi-square quantile with 4 degrees of freedom at 1 - 1e-9.

Where a group's estimate has no spread beyond the floors and zero counts, one statistic alone rejects from: words twice as long (or half as long) as
its group's, 7 symbols per hundred words, 7 repeated lines per hundred words, 46 repeated words per hundred. Groups with spread of their own reject later.

A group of under LEAST documents is too small for an estimate of its own and takes that of its language, else that of all documents.
Distances are ranked by bins of a fixed grid, counted for each group, so no group is gathered or sorted and the result
doesn't depend on the partitions; rows of the bin at the edge count in part, so that the SHARE is met exactly. Estimates, a few numbers a group, are
broadcast if there are at most BROADCAST_KEYS groups; else they are joined with rows that are salted, so that no group's rows meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerege.llm._common import SPACES, dropped, keeps_names, word_list, written

MIN_WORDS = 50
MAX_REPEAT = 50
SHARE = 0.6
STEPS = 12
CUTOFF = 48.6
LEAST = 40
#: Standard deviations added to those estimated, for the four statistics in order.
FLOORS = (0.1, 0.3, 0.3, 0.55)
#: Bins of ln(squared distance) a unit.
GRID = 32
#: Groups whose estimates are broadcast at most, and parts that a group's rows are dealt to where there are more.
BROADCAST_KEYS = 50_000
SALTS = 32

_D = 4
_X = [f"x{i}" for i in range(_D)]


def consistency(share: float) -> float:
    """Factor by which the covariance of the closest share of a 4-dimensional normal sample falls short."""
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < share else (low, mid)
    return share / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), named __ in front; a null text has none of each."""
    text = F.coalesce(docs.text, F.lit(""))
    rows = docs.withColumns({"__words": word_list(text), "__text": text})
    rows = rows.withColumns({"__n": F.size("__words"), "__bits": F.length(F.bin(F.size("__words").cast("long")))})
    # a window is its hash, over the bits of its place: sorted, equal windows stand side by side
    packed = "case when __n < 3 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, __n - 3), i -> shiftleft(xxhash64(__words[i], __words[i + 1], __words[i + 2]), __bits) | cast(i as bigint))) end"
    rows = rows.withColumn("__sorted", F.expr(packed))
    place = lambda x: f"cast({x} & (shiftleft(1L, __bits) - 1L) as int)"
    words = lambda y: " and ".join(f"__words[{place('x')} + {j}] = __words[{place(y)} + {j}]" for j in range(3))
    same = lambda y: f"(shiftright(x, __bits) = shiftright({y}, __bits) and {words(y)})"
    twin = f"(k > 0 and {same('__sorted[k - 1]')}) or (k + 1 < size(__sorted) and {same('__sorted[k + 1]')})"
    rows = rows.withColumn("__places", F.expr(f"sort_array(transform(filter(__sorted, (x, k) -> {twin}), x -> x & (shiftleft(1L, __bits) - 1L)))"))
    covered = "aggregate(transform(__places, (p, k) -> if(k + 1 < size(__places), least(3L, __places[k + 1] - p), 3L)), 0L, (a, x) -> a + x)"
    lines = F.expr(rf"filter(split(__text, '\n'), l -> l rlike '[^{SPACES}]')".replace("\\", "\\\\"))
    rows = rows.withColumn("__lines", lines)
    return rows.withColumns(
        {
            "__n_words": F.col("__n").cast("long"),
            "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "__n_symbols": (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_repeat_words": F.expr(covered),
        }
    ).drop("__words", "__text", "__n", "__bits", "__sorted", "__places", "__lines")


def _vector() -> list[Column]:
    n = F.col("__n_words").cast("double")
    share = lambda c: F.log1p(100.0 * F.col(c) / n)
    return [F.log(F.col("__word_chars") / n), share("__n_symbols"), share("__n_dup_lines"), share("__n_repeat_words")]


def _with(rows: DataFrame, table: DataFrame, on: list[str], few: bool) -> DataFrame:
    """rows joined with a table of one row (or a few) for each value of `on`: broadcast, or by salted keys if there are many."""
    if few:
        return rows.join(F.broadcast(table), on)
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("__salt")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*_X), F.lit(SALTS)).cast("int"))
    return salted.join(table.select("*", salts), [*on, "__salt"]).drop("__salt")


_MEANS = [f"m{i}" for i in range(_D)]
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]
_FACTORS = [f"l{i}{j}" for i, j in _PAIRS]


def _distance(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to each estimate of their key; the estimates' columns stay."""
    joined = _with(rows, estimate, ["__key"], few)
    y: list[Column] = []
    for i in range(_D):
        rest = F.col(_X[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
        y.append(F.col(f"y{i}"))
    return joined.withColumn("d2", sum((v * v for v in y[1:]), y[0] * y[0])).drop(*[f"y{i}" for i in range(_D)])


def _triangle(moments: DataFrame) -> DataFrame:
    """(__key, start, m0.., l00.., det): means, the Cholesky factor of the covariances c00, c10, ... plus the floors, and its determinant."""
    out = moments
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # rounding may leave a little less than the floor; it never goes below a hundredth of it
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 100))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(_D):
        det = det * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
    return out.select("__key", "start", *_MEANS, *_FACTORS, det.alias("det"))


def _started(rows: DataFrame, few: bool) -> DataFrame:
    """The three starting estimates of each key, as _triangle gives them."""
    quartiles = rows.groupBy("__key").agg(*[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q{i}") for i, x in enumerate(_X)])
    spread = lambda i: F.sqrt(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + FLOORS[i] ** 2)
    middle = written(quartiles.select("__key", *[F.col(f"q{i}")[1].alias(f"q{i}") for i in range(_D)], *[spread(i).alias(f"s{i}") for i in range(_D)]), "quartiles")
    squashed = [F.tanh((F.col(_X[i]) - F.col(f"q{i}")) / F.col(f"s{i}")) for i in range(_D)]
    whole = _with(rows, middle, ["__key"], few).withColumns({f"z{i}": z for i, z in enumerate(squashed)}).groupBy("__key")
    firsts = [F.first(c).alias(c) for i in range(_D) for c in (f"q{i}", f"s{i}")]
    moments = whole.agg(*firsts, *[F.avg(x).alias(f"a{i}") for i, x in enumerate(_X)], *[F.covar_pop(_X[i], _X[j]).alias(f"v{i}{j}") for i, j in _PAIRS], *[F.covar_pop(f"z{i}", f"z{j}").alias(f"t{i}{j}") for i, j in _PAIRS])
    moments = written(moments, "starts")
    means = {0: "q", 1: "q", 2: "a"}
    covariance = {
        0: lambda i, j: F.col(f"s{i}") ** 2 - FLOORS[i] ** 2 if i == j else F.lit(0.0),
        1: lambda i, j: F.col(f"s{i}") * F.col(f"s{j}") * F.col(f"t{i}{j}"),
        2: lambda i, j: F.col(f"v{i}{j}"),
    }
    out = None
    for start, c in covariance.items():
        part = moments.select("__key", F.lit(start).alias("start"), *[F.col(f"{means[start]}{i}").cast("double").alias(f"m{i}") for i in range(_D)], *[c(i, j).cast("double").alias(f"c{i}{j}") for i, j in _PAIRS])
        out = part if out is None else out.unionByName(part)
    found = written(_triangle(out), "estimate")
    dropped(middle)
    dropped(moments)
    return found


def _stepped(rows: DataFrame, found: DataFrame, share: float, few: bool) -> DataFrame:
    """One C-step of every estimate."""
    near = _distance(rows, found, few).withColumn("__bin", F.floor(F.log(F.col("d2") + 1e-9) * GRID).cast("int"))
    counts = near.groupBy("__key", "start", "__bin").count()
    group = Window.partitionBy("__key", "start")  # as many rows as bins
    edge = counts.withColumns({"__upto": F.sum("count").over(group.orderBy("__bin")), "__want": share * F.sum("count").over(group)})
    edge = edge.where(F.col("__upto") >= F.col("__want")).groupBy("__key", "start").agg(F.min(F.struct("__bin", "__upto", "count", "__want")).alias("e"))
    edge = edge.select("__key", "start", F.col("e.__bin").alias("__edge"), ((F.col("e.__want") - F.col("e.__upto") + F.col("e.count")) / F.col("e.count")).alias("__part"))
    edge = written(edge, "edges")
    inner = _with(near, edge, ["__key", "start"], few).where("__bin <= __edge").withColumn("w", F.when(F.col("__bin") < F.col("__edge"), 1.0).otherwise(F.col("__part")))
    inner = inner.withColumns({f"d{i}": F.col(x) - F.col(f"m{i}") for i, x in enumerate(_X)})
    sums = inner.groupBy("__key", "start").agg(
        F.sum("w").alias("w"),
        *[F.first(m).alias(m) for m in _MEANS],
        *[F.sum(F.col("w") * F.col(f"d{i}")).alias(f"s{i}") for i in range(_D)],
        *[F.sum(F.col("w") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"p{i}{j}") for i, j in _PAIRS],
    )
    mean = lambda i: F.col(f"s{i}") / F.col("w")
    moments = sums.select("__key", "start", *[(F.col(f"m{i}") + mean(i)).alias(f"m{i}") for i in range(_D)], *[(consistency(share) * (F.col(f"p{i}{j}") / F.col("w") - mean(i) * mean(j))).alias(f"c{i}{j}") for i, j in _PAIRS])
    after = written(_triangle(moments), "estimate")
    dropped(edge)
    return after


def estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS, few: bool = True) -> DataFrame:
    """(__key, m0.., l00.., det): the minimum-covariance-determinant estimate of each key, from rows (__key, x0, x1, x2, x3)."""
    now = _stepped(rows, _started(rows, few), share, few)
    for _ in range(steps - 1):
        after = _stepped(rows, now, share, few)
        old = now.select("__key", "start", F.col("det").alias("before"))
        falling = after.join(old, ["__key", "start"]).where("det < 0.999 * before").limit(1).count()
        dropped(now)
        now = after
        if not falling:
            break
    best = now.groupBy("__key").agg(F.min(F.struct("det", "start", *_MEANS, *_FACTORS)).alias("e"))
    return written(best.select("__key", *[f"e.{c}" for c in (*_MEANS, *_FACTORS, "det")]), "best")


def _key(*names: str) -> Column:
    return F.to_json(F.struct(F.lit(len(names)).alias("level"), *[F.coalesce(F.col(n).cast("string"), F.lit("\x00")).alias(n) for n in names]))


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Null texts have no words and fail the base rules, as empty ones do. A null language or source is a value of its own.
    Rows that repeat a doc_id are judged each for itself. distance is null where the base rules failed.
    An empty table gives an empty one. Other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("__lang"), F.col("source").alias("__source"))
    rows = statistics(narrow).drop("text").withColumnsRenamed({"__lang": "lang", "__source": "source"})
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT * F.col("__n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = written(rows.select("*", *[F.when(~F.col("base_failed"), v).alias(x) for x, v in zip(_X, _vector(), strict=True)]), "statistics")
    good = rows.where("not base_failed")
    levels = good.select(F.explode(F.array(_key("lang", "source"), _key("lang"), _key())).alias("__key"), *_X)
    sizes = written(levels.groupBy("__key").count(), "sizes")
    few = sizes.count() <= BROADCAST_KEYS
    found = estimates(levels, few=few)
    sized = sizes.where(F.col("count") >= LEAST).select("__key")
    # each row takes the narrowest of its three keys that is large enough; the widest one always serves
    keyed = good
    for k, key in enumerate((_key("lang", "source"), _key("lang"))):
        held = sized.select(F.col("__key").alias(f"__g{k}"))
        keyed = keyed.withColumn(f"__k{k}", key).join(F.broadcast(held) if few else held, F.col(f"__k{k}") == F.col(f"__g{k}"), "left")
    keyed = keyed.withColumn("__key", F.coalesce("__g0", "__g1", _key())).drop("__k0", "__k1", "__g0", "__g1")
    near = _distance(keyed, found, few).withColumn("distance", F.col("d2"))
    names = ["doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed"]
    bad = rows.where("base_failed").select(*names, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return near.select(*names, "distance", (F.col("distance") <= CUTOFF).alias("kept")).unionByName(bad)


@keeps_names
def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Rows that repeat a doc_id stay if one of them is kept."""
    kept = judged(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs.doc_id.cast("long").eqNullSafe(kept["__kept"]), "left_semi")


def op3_outliers(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict for the whole documents table."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("distance").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
