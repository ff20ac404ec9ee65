"""Mixing sources to target weights, by cube-method balanced sampling.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at ``MOST`` times its
source's size and the excess goes to the others by weight. With r the target over the source's size, a document counts floor(r)
times, and once more if it is sampled: the samples of a source shall make up the rest of its target. A document longer than that rest would
overshoot it alone, so it is sampled only where the others can't fill the rest; all others have the same inclusion probability.

The sample is balanced on words and documents of each source: while more than ``OPEN`` documents of a group have undecided
probabilities, these move along the null space of (words, documents) until one becomes 0 or 1 (the flight), the longest first. Groups are
chunks of a source by the hash of the document, of about ``CHUNK`` documents, so a hot source is many groups; rows that repeat
are spread over chunks by a row number. The undecided rest of the chunks goes through further flights until one chunk is left for each source, and
then lands: of the subsets of the last ``OPEN`` documents that which comes nearest to the words still open is taken, and of those as
near, nearest to the documents open. Ties and moves are decided by hashes of the document, so reruns agree.

Defined results: a null or blank text has size 0 and takes 0; repeated rows are documents of their own, and of rows alike in doc_id, text
and source any takes what one of them is due; null is a source like others; an empty table gives an empty result. ``mixed`` keeps all columns
of its input, whatever their names; the query reads doc_id, text and source only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import importable, steady, stored, tidied

MOST = 3
CHUNK = 4_000
POOL = 24  # documents that move at a time
OPEN = 14  # documents that are left to landing; it tries all their subsets
WORD = r"[^\x20\x09-\x0D]+"


def drawn():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(7))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a draw by the document's content."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        drawn().alias("draw"),
    )


def targets(rows: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target. Windows run over one row for each source, never over documents."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most)
    # those of the least cap for their weight fill up first; before each, the level that the rest could share
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = weighed.withColumn("total", F.sum("source_size").over(rest)).withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(rest) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    full = F.col("cap") <= F.col("level") * F.col("weight")
    # a full source stays full: the level only rises; the first that isn't has the highest level of the rest, and all of them share it
    share = level.withColumn("own", F.when(~full, F.col("level"))).withColumn("common", F.max("own").over(rest))
    return share.select("source", "source_size", F.when(full | F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight"))).cast("double").alias("target"))


def uniform(draw: int, step: int) -> float:
    x = (draw & 0xFFFFFFFFFFFFFFFF) ^ (step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) / 2.0**64


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray, pool: int = POOL, least: int = OPEN) -> np.ndarray:
    """Moves p (in place) until at most ``least`` are strictly between 0 and 1; expectations and both totals are kept.

    A pool of undecided documents moves at a time, along the projection of its largest one's axis on the null space of
    (1, ..., 1) and the sizes: the others make up for the largest, which is decided while there are enough of them.
    """
    live: list[int] = []
    waiting = iter(np.flatnonzero((p > 0) & (p < 1)).tolist())
    step, more = 0, True
    while True:
        while more and len(live) < pool:
            at = next(waiting, None)
            more = at is not None
            if more:
                live.append(at)
        if len(live) <= max(2, least):
            return p
        at = np.array(live)
        s, q = size[at].astype(float), p[at]
        n, mean = len(at), s.mean()
        off, lead = s - mean, int(s.argmax())
        spread = float(off @ off)
        way = -1.0 / n - (off * (off[lead] / spread) if spread > 1e-9 else 0.0)
        way = np.broadcast_to(way, n).copy()
        way[lead] += 1
        way[np.abs(way) < 1e-12] = 0.0
        if not way.any():  # the largest alone can't move: any three others can
            lead = (lead + 1) % n
            a, b, c = s[[lead, (lead + 1) % n, (lead + 2) % n]]
            way[[lead, (lead + 1) % n, (lead + 2) % n]] = (b - c, c - a, a - b) if len({a, b, c}) > 1 else (1.0, -1.0, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(way > 0, (1 - q) / way, np.where(way < 0, q / -way, np.inf)).min()
            down = np.where(way > 0, q / way, np.where(way < 0, (1 - q) / -way, np.inf)).min()
        move = up if uniform(int(draw[at[lead]]), step) * (up + down) < down else -down
        q = q + move * way
        q[q < 1e-9], q[q > 1 - 1e-9] = 0.0, 1.0
        p[at] = q
        live = at[(q > 0) & (q < 1)].tolist()
        step += 1


def land(p: np.ndarray, size: np.ndarray, draw: np.ndarray, rest: float) -> np.ndarray:
    """Decides the last ones (in place): the subset whose words come nearest to ``rest``, then whose number comes nearest to the sum of
    their probabilities, then that of the least mixed draw."""
    live = np.flatnonzero((p > 0) & (p < 1))
    if len(live):
        subset = np.arange(1 << len(live))
        words, count = np.zeros(len(subset), np.int64), np.zeros(len(subset), np.int64)
        tie = np.zeros(len(subset), np.uint64)
        for at, n in enumerate(live.tolist()):
            taken = subset >> at & 1
            words += taken * int(size[n])
            count += taken
            tie ^= np.where(taken, np.uint64(int(uniform(int(draw[n]), 1) * 2.0**63)), np.uint64(0))
        best = np.lexsort((tie, np.abs(count - p[live].sum()), np.abs(words - rest)))[0]
        p[live] = best >> np.arange(len(live)) & 1
    return p


def _flown(last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("draw", "ascending")])
        p, size, draw = rows["p"].to_numpy().copy(), rows["size"].to_numpy(), rows["draw"].to_numpy()
        rest = float(p @ size)
        p = flight(p, size, draw)
        if last:
            sure = p >= 1
            p = land(p, size, draw, rest - float(size[sure].sum()))
        return rows.set_column(rows.column_names.index("p"), "p", pa.array(p))

    return run


def chances(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with source_size, target, times (the whole part of r) and p, the probability to be taken once more."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-9)
    due = found.select(F.col("source").alias("s"), "source_size", "target", whole.alias("times"), F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("rest"))
    joined = rows.join(due, rows["source"].eqNullSafe(due["s"])).drop("s")
    fits = F.col("size") <= F.col("rest")
    sums = joined.groupBy("source").agg(F.sum(F.when(fits, F.col("size"))).alias("fitting")).select(F.col("source").alias("s"), F.coalesce("fitting", F.lit(0)).alias("fitting"))
    both = joined.join(sums, joined["source"].eqNullSafe(sums["s"])).drop("s")
    share = F.least(F.lit(1.0), F.col("rest") / F.greatest(F.col("fitting"), F.lit(1)))
    others = F.greatest(F.lit(0.0), F.col("rest") - F.col("fitting")) / F.greatest(F.col("source_size") - F.col("fitting"), F.lit(1))
    p = F.when((F.col("size") == 0) | (F.col("rest") < 0.5), F.lit(0.0)).when(fits, share).otherwise(F.least(F.lit(1.0), others))
    return both.withColumn("p", F.when(p < 1e-9, F.lit(0.0)).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)).drop("rest", "fitting")


def mix(docs: DataFrame, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    importable(docs.sparkSession)
    rows = stored(sized(docs))
    state = chances(rows, stored(targets(rows, most)))
    groups = max(1, math.ceil(rows.count() / chunk))
    often = rows.groupBy("source", "draw").count().where(F.col("count") > max(1, chunk // 8)).select(F.col("source").alias("s"), F.col("draw").alias("d"), F.lit(True).alias("often"))
    salted = state.join(often, state["source"].eqNullSafe(often["s"]) & (state["draw"] == often["d"]), "left").drop("s", "d")
    salt = F.when(F.col("often"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    schema = "doc_id long, source string, size long, draw long, source_size long, target double, times long, p double, chunk long"
    open_rows = salted.withColumn("chunk", F.pmod(F.xxhash64("draw", salt), F.lit(groups))).drop("often")
    done = None
    while True:
        moved = open_rows.groupBy("source", "chunk").applyInArrow(tidied(_flown(groups == 1)), schema)
        if groups == 1:
            out = moved if done is None else done.unionByName(moved)
            break
        moved = stored(moved)
        decided = (F.col("p") <= 0) | (F.col("p") >= 1)
        done = moved.where(decided) if done is None else done.unionByName(moved.where(decided))
        # OPEN of each chunk at most are open, so each round leaves a small share of the chunks
        groups = math.ceil(groups / max(2, chunk // (2 * OPEN)))
        open_rows = moved.where(~decided).withColumn("chunk", F.pmod(F.col("chunk"), F.lit(groups)))
    times = F.col("times") + F.col("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), "draw")


def mixed(docs: DataFrame, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Of rows alike in doc_id, text and source, which the mix doesn't
    tell apart, each gets its share of what they take together."""
    docs = steady(docs)
    key = (drawn(), F.col("source").cast("string"))
    marks = stored(mix(docs, most, chunk).groupBy("draw", "source").agg(F.count("*").alias("rows"), F.sum("times").alias("times")))
    marks = marks.where("times > 0").select(F.col("draw").alias("d"), F.col("source").alias("s"), "rows", F.col("times").alias("t"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key[0].alias("draw"), key[1].alias("source"))
    met = whole.join(marks, (F.col("draw") == F.col("d")) & F.col("source").eqNullSafe(F.col("s")))
    each = met.where("rows = 1").select("row", "t")
    if not marks.where("rows > 1").isEmpty():
        # a place for each row of a key: its place among those written with it, after those written before
        again = stored(met.where("rows > 1").withColumn("number", F.monotonically_increasing_id())).withColumn("file", F.shiftright("number", 33))
        sizes = again.groupBy("d", "s", "file").agg(F.count("*").alias("here"))
        before = F.coalesce(F.sum("here").over(W.partitionBy("d", "s").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select(F.col("d").alias("d2"), F.col("s").alias("s2"), F.col("file").alias("file2"), before.alias("start"))
        placed = again.withColumn("inner", F.row_number().over(W.partitionBy("d", "s", "file").orderBy("number")) - 1)
        placed = placed.join(starts, (F.col("d") == F.col("d2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("file") == F.col("file2")))
        one_more = (F.col("start") + F.col("inner") < F.col("t") % F.col("rows")).cast("long")
        each = each.unionByName(placed.select("row", (F.floor(F.col("t") / F.col("rows")) + one_more).alias("t")).where("t > 0"))
    copies = each.select("row", F.explode(F.sequence(F.lit(1), F.col("t"))).alias("copy"))
    return copies.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op2_mix_sources(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
