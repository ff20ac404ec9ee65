"""The prefix trie of conversations by partition refinement.

All conversations start in one class; turns split the classes, and a class is named by what its members have said so far: the exclusive or
of 128-bit digests of (place, role, text). A round splits the active classes by a block of turns, one, two, four and so on, as one aggregation
that combines before its shuffle. Conversations whose class has only themselves left retire: their further turns are a unary chain and
leave the rounds as they are. Folding back doubles its reach with each round, so both ways take about log(turns) rounds however long
a shared beginning is.

``numbered`` counts and combines along a key in order without holding the key together: rows are dealt by ranges of key and order,
each task streams its own, and what a task passes to the next is one small row for each partition.

Digests are the first 128 bits of SHA-256, so two different beginnings share a name with a chance of 2**-128.

Defined results: turns of a conversation are ordered by turn (null first), turns that tie by the digest of role and text; repeated rows are turns of their own; null role
or text is empty; rows without conv_id belong to no conversation and are left out; a table without conversations gives an empty result.
Only conv_id, turn, role and text are read, so other columns may have any name. The list of a node's ended conversations is hashed in
order by one task, which streams it from runs of ``RUN`` ids.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .session import importable, partitions, stored, tidied

FAMILY, HEADS = 20, 4
RUN = 4096
NAME, ABOVE = ["x1", "x2"], ["p1", "p2"]
WORD = r"[^\x20\x09-\x0D]+"


def digest(text: Column) -> list[Column]:
    """Two longs of SHA-256."""
    at = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(at, first, 16), 16, -10).cast("long") for first in (1, 17)]


def numbered(rows: DataFrame, key: str, order: list[str], combined: tuple[str, ...] = ()) -> DataFrame:
    """rows with ``at``, the number of rows of the same key (a long, not null) before this one in order, and the longs of ``combined`` replaced by
    their exclusive or over this row and those before it. Written once."""
    spark = rows.sparkSession
    importable(spark)
    schema = StructType([*rows.schema.fields, StructField("at", LongType()), StructField("part", IntegerType())])
    names = rows.columns

    def run(batches):
        part, held, count, before = TaskContext.get().partitionId(), None, 0, [np.int64(0)] * len(combined)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(key)).to_numpy(zero_copy_only=False)
            begins = np.append(held is None or keys[0] != held, keys[1:] != keys[:-1])
            if begins[0]:
                count, before = 0, [np.int64(0)] * len(combined)
            start = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
            at = np.arange(len(keys)) - start + np.where(start, 0, count)
            columns = list(batch.columns)
            for k, c in enumerate(combined):
                run = np.bitwise_xor.accumulate(columns[names.index(c)].to_numpy(zero_copy_only=False))
                value = run ^ np.append(np.int64(0), run)[start] ^ np.where(start, np.int64(0), before[k])
                columns[names.index(c)] = pa.array(value)
                before[k] = value[-1]
            held, count = keys[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(np.full(len(keys), part, np.int32))], names=[*names, "at", "part"])

    found = stored(rows.repartitionByRange(partitions(spark), key, *order).sortWithinPartitions(key, *order).mapInArrow(tidied(run), schema))
    # keys that two or more partitions share: at most one for each partition
    reach = sorted(found.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())
    shared = sorted({a.high for a, b in zip(reach, reach[1:], strict=False) if a.high == b.low})
    if not shared:
        return found.drop("part")
    some = found.join(F.broadcast(spark.createDataFrame([(k,) for k in shared], f"{key} long")), key)
    ends = some.groupBy(key, "part").agg(F.max("at").alias("at"), *(F.max_by(c, "at").alias(c) for c in combined)).collect()
    carried, last = [], {}
    for row in sorted(ends, key=lambda r: (r[key], r.part)):
        count, *values = last.get(row[key], (0, *[0] * len(combined)))
        carried.append((row[key], row.part, count, *values))
        last[row[key]] = (count + row["at"] + 1, *(v ^ row[c] for v, c in zip(values, combined, strict=True)))
    passed = spark.createDataFrame(carried, f"{key} long, part int, _at long" + "".join(f", _{c} long" for c in combined))
    both = found.join(F.broadcast(passed), [key, "part"], "left")
    new = {"at": F.col("at") + F.coalesce("_at", F.lit(0))} | {c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in combined}
    return both.withColumns(new).select(*names, "at")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, at, d1, d2 (of role and text), n_words: turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    d1, d2 = digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), d1.alias("d1"), d2.alias("d2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    return numbered(rows, "conv_id", ["turn", "d1", "d2"]).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with the first h of the family's first conversation in front (h from the conversation's own id) in place of a conversation's own
    first h; and conv_id, length of all conversations, turnless ones too. turns: as of turns_of."""
    counts = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    own = counts.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    base = counts.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    sized = own.join(base, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    sized = stored(sized.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "k", "length"))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    columns = ["conv_id", "length", "depth", "d1", "d2", "n_words"]
    taken = heads.join(sized, "base").where("at < k").withColumn("depth", F.col("at") + 1).select(*columns)
    kept = turns.join(sized, "conv_id").where("at >= h").withColumn("depth", F.col("at") - F.col("h") + F.col("k") + 1).select(*columns)
    return taken.unionByName(kept), sized.select("conv_id", "length")


def named(turns: DataFrame) -> DataFrame:
    """turns (conv_id, length, depth from 1 to length, d1, d2, n_words) -> conv_id, depth, class name, the name above it, n_words, last."""
    e1, e2 = digest(F.concat_ws(",", *(F.col(c).cast("string") for c in ("depth", "d1", "d2"))))
    rows = turns.select("conv_id", "depth", "n_words", (F.col("depth") == F.col("length")).alias("last"), e1.alias("x1"), e2.alias("x2"))
    rows = rows.withColumns({"e1": F.col("x1"), "e2": F.col("x2")})
    found = numbered(rows, "conv_id", ["depth"], ("x1", "x2"))
    return stored(found.select("conv_id", "depth", *NAME, F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"), "n_words", "last"))


def refined(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes that a round has split off (depth, name, name above, conv_id, n_convs, n_words, n_ends), and the turns of
    retired conversations, each a class of one member below another such one of the same conversation. turns: as of named."""
    classes, tails, active, low = [], [], None, 1
    while True:
        high = 2 * low - 1
        inside = lambda rows, of: rows if of is None else rows.join(of, "conv_id", "left_semi")
        block = inside(turns.where(F.col("depth").between(low, high)), active)
        counted = stored(block.groupBy("depth", *NAME, *ABOVE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"), F.count_if("last").alias("n_ends")))
        classes.append(counted)
        shared = counted.where((F.col("depth") == high) & (F.col("n_convs") > 1)).select(*NAME)
        rest = inside(turns.where(F.col("depth") > high), active)
        if shared.isEmpty():
            tails.append(rest)
            break
        end = block.where(F.col("depth") == high)
        alone = stored(end.join(shared, NAME, "left_anti").select("conv_id"))
        tails.append(rest.join(alone, "conv_id", "left_semi"))
        active, low = stored(end.join(shared, NAME, "left_semi").select("conv_id")), 2 * low
    return reduce(DataFrame.unionByName, classes), reduce(DataFrame.unionByName, tails)


def folded(shared: DataFrame) -> DataFrame:
    """shared (name, name above it or null, leaves, saved) -> name, leaves and saved summed over each one's subtree within shared.
    Round k adds what lies from 2**k up to 2**(k+1) - 1 below."""
    state = stored(shared.select(*NAME, *ABOVE, "leaves", "saved"))
    while not (low := state.where("p1 is not null")).isEmpty():
        more = low.groupBy(*ABOVE).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")).withColumnsRenamed(dict(zip(ABOVE, NAME, strict=True)))
        above = state.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        new = state.join(more, NAME, "left").join(above, ABOVE, "left")
        state = stored(new.select(*NAME, F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved")))
    return state.select(*NAME, "leaves", "saved")


def hashed_lists(ends: DataFrame) -> DataFrame:
    """ends (name, conv_id) -> name, SHA-256 of its conv_ids in order, joined by commas."""
    spark = ends.sparkSession
    importable(spark)

    def runs(batches):
        for batch in batches:
            a, b, ids = (batch.column(c).to_pylist() for c in (*NAME, "conv_id"))
            out: list[tuple] = []
            for key in zip(a, b, ids, strict=True):
                if out and out[-1][:2] == key[:2] and len(out[-1][3]) < RUN:
                    out[-1][3].append(str(key[2]))
                else:
                    out.append((*key, [str(key[2])]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:3]] + [pa.array([",".join(x[3]) for x in out])], names=[*NAME, "first", "ids"])

    def digests(batches):
        held, state = None, None
        done: list[tuple] = []
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in NAME)
            for at, key in enumerate(zip(a, b, strict=True)):
                ids = batch.column("ids")[at].as_py().encode()
                if key == held:
                    state.update(b"," + ids)
                    continue
                if state:
                    done.append((*held, state.hexdigest()))
                held, state = key, hashlib.sha256(ids)
            if done:
                yield of(done)
                done = []
        if state:
            yield of([(*held, state.hexdigest())])

    def of(done):
        a, b, text = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text)], names=[*NAME, "ends_sha256"])

    n = partitions(spark)
    few = ends.select(*NAME, "conv_id").repartitionByRange(n, *NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id").mapInArrow(tidied(runs), "x1 long, x2 long, first long, ids string")
    return few.repartition(n, *NAME).sortWithinPartitions(*NAME, "first").mapInArrow(tidied(digests), "x1 long, x2 long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node, the root too. turns (conv_id, length, depth, d1, d2, n_words), lengths (conv_id, length) of all conversations."""
    spark = turns.sparkSession
    all_of = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).head()
    long = lambda v: F.lit(v).cast("long")
    empty = F.sha2(F.lit(b""), 256)
    if not all_of.n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rows = named(turns)
    classes, tails = refined(rows)
    shared, single = classes.where("n_convs > 1"), classes.where("n_convs = 1")
    below = classes.groupBy(*ABOVE).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone")).withColumnsRenamed(dict(zip(ABOVE, NAME, strict=True)))
    counted = stored(shared.join(below, NAME, "left").select(*shared.columns, F.coalesce("n_children", long(0)).alias("n_children"), F.coalesce("alone", long(0)).alias("alone")))
    top = F.col("depth") == 1  # its parent is the root, which stays out of the joins
    own = counted.select(*NAME, *(F.when(~top, F.col(c)).alias(c) for c in ABOVE), (F.col("alone") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    own = stored(own)
    sums = stored(folded(own))
    whole = own.agg(F.coalesce(F.sum("leaves"), long(0)).alias("leaves"), F.coalesce(F.sum("saved"), long(0)).alias("saved")).head()
    first = classes.where(top).agg(F.count("*").alias("n"), F.count_if(F.col("n_convs") == 1).alias("alone")).head()
    parents = counted.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"))

    # of ends that several conversations share, turnless ones at the root
    several = counted.where("n_ends > 1").select(*NAME)
    ends = rows.where("last").select(*NAME, "conv_id").join(several, NAME, "left_semi").unionByName(lengths.where("length = 0").select(long(0).alias("x1"), long(0).alias("x2"), "conv_id"))
    lists = stored(hashed_lists(ends))
    one = rows.where("last").join(counted.where("n_ends = 1").select(*NAME), NAME).select(*NAME, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    ended = lists.where("x1 <> 0 or x2 <> 0").unionByName(one)

    parent = lambda: F.when(top, long(all_of.least)).otherwise(F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    end = lambda last: F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256")
    joint = counted.join(sums, NAME).join(parents, ABOVE, "left").join(ended, NAME, "left")
    joint = joint.select("conv_id", "depth", parent(), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    last = F.col("n_ends") > 0
    lone = single.join(parents, ABOVE, "left").select("conv_id", "depth", parent(), "n_convs", F.when(last, 0).otherwise(1).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), end(last))
    chain = tails.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), long(1).alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), end(F.col("last")))
    at_root = lists.where("x1 = 0 and x2 = 0").agg(F.first("ends_sha256").alias("found"))
    leaves = whole.leaves + first.alone + (0 if first.n else 1)
    root = at_root.select(long(all_of.least).alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"), long(all_of.n).alias("n_convs"), long(first.n).alias("n_children"), long(leaves).alias("n_leaves"), long(whole.saved).alias("saved_tokens"), F.coalesce("found", empty).alias("ends_sha256"))
    return root.unionByName(joint).unionByName(lone).unionByName(chain)


def op12_prefix_trie(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(turns_of(conversations)))
