"""N-gram Jaccard join by size-aware heavy and light sides.

A document is its set of distinct word shingles (hashes). Sets that are equal form a class at once; classes are joined.

Order: shingles that one document only has come first, those that many have last, then by hash. Two sets of the wanted similarity share
at least two shingles of their prefixes in this order (of n - ceil(0.75 n) + 2), and one of the prefixes shorter by one. Which
shingles are alone or common is told by filters of fixed size over the counts of all shingles (see ``filters``), one rule for all sets.

- small sets (light): all subsets of two shingles of the longer prefix are enumerated, and equal subsets meet;
- large sets (heavy): the inverted lists of the shorter prefix's shingles are scanned; small sets that are near the boundary in size
  stand in these lists too;
- the boundary is the size up to which enumeration costs less in all, from counts over the whole corpus.

Shingles that are alone can't be shared, so prefixes go on without them, and sets whose prefixes are empty then have no links. Of the
others the shared shingles are written once, with the size of the whole set.

Meetings are verified exactly on these, those that parities, a bit or two for each shingle, don't rule out. A list of n sets isn't n * n / 2 pairs: first each set meets the first and
a drawn one of each of its lists, and what these links connect needs no further proof; only sets of a list that are still in different
components are then compared with each other, in lists of more than ``LONG_LIST`` by their differences from a pivot (by_difference).

Defined results: a null or wordless text has no shingles and its own doc_id; fewer words than a shingle make one; a null doc_id is larger
than all others, and the component of none but such is null; repeated rows are of one class; an empty table gives an empty result.
An input that isn't the same at each reading is stored first. Other columns than doc_id and text are not read; ``one_of_each`` keeps all
columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .filters import Filter, built, counted
from .repeats import LAST
from .session import importable, steady, stored, tidied

SHINGLE = 5
PERCENT = 75
HOT = 200
SCAN = 4  # rows that a scanned posting costs: itself, two meetings, and a share in what is left to compare; an enumerated subset costs one
LONG_LIST = 64  # sets; longer lists are compared by differences from a pivot
DRAWN = 64  # members of a family that make its pivot, about
PARITY_BITS = 1024
BROADCAST_ROWS = 100_000  # of 24 bytes
STATE = "doc_key long, tie long, n long, class binary, tokens array<long>, singles int, parity binary, shingles binary"


class Sets:
    """The distinct shingles of a chunk's documents in order of their hashes, and each document's first (one more entry)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE):
        buf = A.LOWER[buf]
        s, e, first = A.words(buf, off)
        hashes = A.word_hashes(buf, s, e)
        length = np.diff(first)
        gram = A.chained(hashes, shingle)
        valid = np.ones(len(gram), bool)
        for end in first[1:-1]:
            valid[max(0, end - shingle + 1) : end] = False
        at = np.flatnonzero(valid)
        doc = np.searchsorted(first, at, "right") - 1
        keys = gram[at]
        for few in range(1, shingle):  # whole sequences of documents below a shingle
            short = np.flatnonzero(length == few)
            if len(short):
                keys = np.concatenate([keys, A.chained(hashes, few)[first[short]]])
                doc = np.concatenate([doc, short])
        order = A.distinct_rows(keys, doc)
        keys, doc = keys[order], doc[order]
        if len(keys):
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
            keys, doc = keys[new], doc[new]
        self.keys, self.doc, self.first = keys, doc, np.searchsorted(doc, np.arange(len(off)))

    def prefixes(self, shared: Filter, hot: Filter | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(in_both, prefix, of, single): which shingles others may have; those of the longer prefixes among them, in order; of which
        document each is; and whether it is in the shorter prefix."""
        n = np.diff(self.first)
        reach = np.minimum(n, n - -(-PERCENT * n // 100) + 2)
        in_both = shared.test(self.keys)
        alone = n - A.per_row(in_both.astype(np.int64), self.first)
        # the shared ones of documents whose prefix holds more than what is alone
        at = np.flatnonzero(in_both & (alone < reach)[self.doc])
        keys, doc = self.keys[at], self.doc[at]
        if hot is not None and len(keys):
            late = hot.test(keys)
            order = np.argsort(doc * 2 + late, kind="stable")
            keys, doc = keys[order], doc[order]
        place = alone[doc] + np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(n)))[doc]
        ahead = place < reach[doc]
        return in_both, keys[ahead], doc[ahead], (place < reach[doc] - 1)[ahead]


def shingle_filters(texts: DataFrame, hot: int = HOT) -> tuple[Filter, Filter | None]:
    """Of the shingles that two documents have or more, and of those that ``hot`` have."""

    def keys(batch):
        for _, _, buf, off in A.chunks(batch.column("text")):
            yield Sets(buf, off).keys

    return built(counted(texts, keys), hot)


def parity(keys: np.ndarray) -> bytes:
    """Of each of some classes of shingles whether their number is odd: a power of two of classes, twice the set's size or more."""
    bits = max(PARITY_BITS, 1 << int(2 * len(keys) - 1).bit_length())
    return np.packbits((np.bincount((keys & A.U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many classes two parities differ; the longer one is folded to the other's classes."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def states(docs: DataFrame, shared: Filter, hot: Filter | None) -> DataFrame:
    """A row for each document: n, and for those that may link: its class, and once in a batch for each class the prefix
    shingles and all shingles that others may have too, and its parity."""

    def run(batches):
        for batch in batches:
            ids, ties, seen = batch.column("doc_key").to_numpy(), batch.column("tie").to_numpy(), set()
            for i, j, buf, off in A.chunks(batch.column("text")):
                sets = Sets(buf, off)
                in_both, prefix, of, single = sets.prefixes(shared, hot)
                cut = np.searchsorted(of, np.arange(j - i + 1))
                columns = names, tokens, singles, parities, shingles = [None] * (j - i), [None] * (j - i), [None] * (j - i), [None] * (j - i), [None] * (j - i)
                for d in np.unique(of).tolist():
                    own = sets.keys[sets.first[d] : sets.first[d + 1]]
                    names[d] = name = xxhash.xxh3_128_digest(own)
                    if name not in seen:
                        seen.add(name)
                        tokens[d] = prefix[cut[d] : cut[d + 1]].view(np.int64)
                        singles[d] = int(single[cut[d] : cut[d + 1]].sum())
                        parities[d] = parity(own)
                        shingles[d] = own[in_both[sets.first[d] : sets.first[d + 1]]].tobytes()
                kinds = (pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), pa.array(ties[i:j]), pa.array(np.diff(sets.first)), *map(pa.array, columns, kinds)], [x.split()[0] for x in STATE.split(", ")])

    return docs.select("doc_key", "tie", "text").mapInArrow(tidied(run), STATE)


def boundary(sets: DataFrame) -> int:
    """The size up to which enumerating subsets costs fewer rows than scanning lists. Sizes are summed up in steps of a tenth."""
    k = F.size("tokens").cast("double")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1)))
    by_size = sets.groupBy(step.alias("step")).agg(F.max("n").alias("n"), F.sum(k * (k - 1) / 2).alias("subsets"), F.sum("singles").alias("lists")).orderBy("n").collect()
    best, gain, total = 1, 0.0, 0.0
    for r in by_size:  # some hundred rows, whatever the sizes
        total += SCAN * r.lists - r.subsets
        if total > gain:
            best, gain = r.n, total
    return best


def postings(sets: DataFrame, small: int) -> DataFrame:
    """k1, k2, rid, n: what each set stands under."""
    pairs = F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda y: F.struct(F.least(x, y).alias("k1"), F.greatest(x, y).alias("k2")))))
    light = sets.where(F.col("n") <= small).select("rid", "n", F.explode(pairs).alias("k")).select(F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"), "rid", "n")
    listed = sets.where((F.col("n") > small) | (100 * F.col("n") >= PERCENT * (small + 1))).where("singles > 0")
    heavy = listed.select(F.explode(F.slice("tokens", 1, F.col("singles"))).alias("k1"), F.lit(None).cast("long").alias("k2"), "rid", "n")
    return heavy.unionByName(light)


def met(posts: DataFrame) -> DataFrame:
    """Postings of lists with two sets or more, each with the list's first set and a drawn one, which lists of the same sets have in common."""
    lists = posts.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min(F.struct("rid", "n")).alias("one"), F.min(F.struct(F.xxhash64("rid").alias("draw"), "rid", "n")).alias("two")).where("c > 1")
    near = lists.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), "c", F.col("one.rid").alias("p1"), F.col("one.n").alias("n1"), F.col("two.rid").alias("p2"), F.col("two.n").alias("n2"))
    return posts.join(near, (F.col("k1") == F.col("l1")) & F.col("k2").eqNullSafe(F.col("l2"))).drop("l1", "l2")


def alike(n1, n2):
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)) if not isinstance(n1, str) else alike(F.col(n1), F.col(n2))


def close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs without those whose parities differ in more classes than similar sets differ in shingles: each shingle of one
    set only changes one class. No similar pair is lost."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                differ = np.array([apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)])
                total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
                keep = (100 + PERCENT) * differ <= (100 - PERCENT) * total
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    left, right = sets.select(F.col("rid").alias("a"), "n", F.col("parity").alias("x")), sets.select(F.col("rid").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(tidied(run), "a long, b long")


def wholes(ids: DataFrame, sets: DataFrame, state: DataFrame) -> DataFrame:
    """rid, n, shingles (the shared ones, sorted) for the rids of ids."""
    needed = stored(sets.select("rid", "n", "class").join(ids, "rid", "left_semi"))
    named = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    return state.where("shingles is not null").select("class", "shingles").join(named, "class").groupBy("rid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, state: DataFrame) -> DataFrame:
    """Of stored pairs (a, b) those whose whole sets are similar. Only sets that stand in a pair after close() are moved."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist(), strict=True):
                both = np.intersect1d(np.frombuffer(x.as_buffer(), A.U), np.frombuffer(y.as_buffer(), A.U), assume_unique=True).size
                keep.append(100 * both >= PERCENT * (n - both))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    pairs = stored(close(pairs, sets))
    if pairs.isEmpty():
        return pairs
    whole = wholes(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), sets, state)
    left, right = whole.select(F.col("rid").alias("a"), F.col("n").alias("m"), F.col("shingles").alias("x")), whole.select(F.col("rid").alias("b"), "n", F.col("shingles").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("n") + F.col("m")).alias("n"), "x", "y").mapInArrow(tidied(run), "a long, b long"))


def paired(rows: DataFrame, key: list[str], other: DataFrame | None = None) -> DataFrame:
    """a, b, root_a, root_b: pairs of rows (or of a row and one of other) with equal keys, of like sizes, in different components."""
    x, y = (d.select(*key, F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("root").alias(f"root_{c}")) for d, c in ((rows, "a"), (rows if other is None else other, "b")))
    both = x.join(y, key).where((F.col("root_a") != F.col("root_b")) & alike("n_a", "n_b"))
    if other is None:
        return both.where("a < b").select("a", "b", "root_a", "root_b")
    swap = F.col("a") > F.col("b")
    turn = lambda u, v: F.when(swap, F.col(v)).otherwise(F.col(u))
    return both.select(turn("a", "b").alias("a"), turn("b", "a").alias("b"), turn("root_a", "root_b").alias("root_a"), turn("root_b", "root_a").alias("root_b"))


def differences(own: DataFrame, hot: Filter | None) -> DataFrame:
    """Of rows (f, rid, n, root, shingles, pivot): the shingles that only one of set and pivot has, those of the pivot and hot ones
    last, without those that are alone, which would be the first; the number of all of them, and score: two sets are similar where the
    scores and 2 * (100 + PERCENT) for each difference they share add up to 0 or more."""

    def run(batches):
        for batch in batches:
            rows = []
            for x, p, n in zip(batch.column("shingles"), batch.column("pivot"), batch.column("n").to_pylist(), strict=True):
                x, p = np.frombuffer(x.as_buffer(), A.U), np.frombuffer(p.as_buffer(), A.U) if p.is_valid else np.zeros(0, A.U)
                extra, lacking = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                late = hot.test(extra) if hot is not None and len(extra) else np.zeros(len(extra), bool)
                keys = np.concatenate([extra, lacking])
                late = np.concatenate([late, np.ones(len(lacking), bool)])
                size = n - len(x) + len(keys)
                rows.append((size, (100 - PERCENT) * n - (100 + PERCENT) * size, keys[np.lexsort((keys, late))].tobytes()))
            if rows:
                size, score, delta = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("f", "rid", "n", "root")), pa.array(size, pa.int64()), pa.array(score, pa.int64()), pa.array(delta, pa.binary())], ["f", "rid", "n", "root", "size", "score", "delta"])

    return own.select("f", "rid", "n", "root", "shingles", "pivot").mapInArrow(tidied(run), "f long, rid long, n long, root long, size long, score long, delta binary")


SHORT_OUT, SHORT_IN, LONG_OUT = 0, 1, 2


def difference_posts(ranked: DataFrame) -> DataFrame:
    """kind, f, e, rid, n, root: the differences that a set stands under. See by_difference()."""
    unit = 2 * (100 + PERCENT)

    def run(batches):
        for batch in batches:
            size, score, top, widest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "score", "top", "widest"))
            inside = score + top >= 0
            short = size - np.maximum(1, -((score - top - 1) // unit)) + 1
            share = np.maximum(1, -((score + top) // unit))
            long = np.where(~inside & (share <= widest), size - share + 1, 0)
            delta = batch.column("delta")
            kept = np.array([len(d.as_buffer()) // 8 for d in delta], np.int64)
            for kinds, cut in ((np.where(inside, SHORT_IN, SHORT_OUT), short), (np.full(len(size), LONG_OUT), long)):
                cut = np.clip(cut - (size - kept), 0, kept)  # the first of all are alone
                at = np.repeat(np.arange(len(cut)), cut)
                if len(at):
                    e = np.concatenate([np.frombuffer(delta[d].as_buffer(), np.int64)[: cut[d]] for d in np.flatnonzero(cut).tolist()])
                    columns = [batch.column(c).take(pa.array(at)) for c in ("f", "rid", "n", "root")]
                    yield pa.RecordBatch.from_arrays([pa.array(kinds[at], pa.int32()), pa.array(e), *columns], ["kind", "e", "f", "rid", "n", "root"])

    return ranked.select("f", "rid", "n", "root", "size", "score", "delta", "top", "widest").mapInArrow(tidied(run), "kind int, e long, f long, rid long, n long, root long")


def by_difference(long: DataFrame, key: list[str], sets: DataFrame, state: DataFrame, hot: Filter | None) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify (a, b, root_a, root_b) and certain links (a, b) between roots, for lists too long for their pairs.

    Lists with the same main component make a family f. Its pivot is any set of shingles, here those of most of some drawn members; the
    choice costs time only. X' is what differs between X and the pivot, so that X and Y differ in |X'| + |Y'| - 2 |X' & Y'| shingles. The
    member whose score is best is linked for certain with each X whose score and its own add up to 0 or more ("in"). Two sets
    that are both in need no more. Any other similar pair shares differences, by the scores more than a known number, so equal ones
    stand among the first of both: among the few first of a set that is in (or of both that are out), more of its partner's."""
    owner = long.groupBy(*key, "root").agg(F.count("*").alias("m")).groupBy(*key).agg(F.max(F.struct("m", "root")).alias("main")).select(*key, F.col("main.root").alias("f"))
    members = stored(long.join(owner, key).select("f", "rid", "n", "root").distinct())
    own = stored(members.join(wholes(members.select("rid").distinct(), sets, state).drop("n"), "rid"))
    drawn = own.join(members.groupBy("f").agg(F.count("*").alias("m")), "f").where(F.pmod(F.xxhash64("rid"), "m") < DRAWN)

    def most(rows: pa.Table) -> pa.Table:
        keys, count = np.unique(np.frombuffer(b"".join(rows["shingles"].to_pylist()), A.U), return_counts=True)
        return pa.table({"f": pa.array([rows["f"][0].as_py()], pa.int64()), "pivot": pa.array([keys[2 * count > len(rows)].tobytes()], pa.binary())})

    pivots = drawn.select("f", "shingles").groupBy("f").applyInArrow(tidied(most), "f long, pivot binary")
    deltas = stored(differences(own.join(pivots, "f", "left"), hot))
    best = deltas.groupBy("f").agg(F.max(F.struct("score", "rid", "root")).alias("best")).select("f", F.col("best.score").alias("top"), F.col("best.root").alias("home"))
    ranked = deltas.join(best, "f")
    inside = F.col("score") + F.col("top") >= 0
    sure = ranked.where(inside & (F.col("root") != F.col("home"))).select(F.col("root").alias("a"), F.col("home").alias("b")).distinct()
    widest = ranked.groupBy("f").agg(F.coalesce(F.max(F.when(inside, F.col("size"))), F.lit(0)).alias("widest"))
    posts = stored(difference_posts(ranked.join(widest, "f")))
    of = lambda kind: posts.where(F.col("kind") == kind)
    pairs = paired(of(SHORT_OUT), ["f", "e"]).unionByName(paired(of(SHORT_IN), ["f", "e"], of(LONG_OUT)))
    return pairs, sure


def linked(sets: DataFrame, posts: DataFrame, state: DataFrame, hot: Filter | None) -> DataFrame:
    """node, root over the rids of sets that have a link."""
    spark = sets.sparkSession
    posts = stored(met(posts))
    first = stored(posts.where((F.col("p1") != F.col("rid")) & alike("n", "n1")).groupBy("rid").agg(F.min("p1").alias("a")).select("a", F.col("rid").alias("b")))
    roots = components(verified(first, sets, state))

    def joined(pairs: DataFrame) -> DataFrame:
        """Pairs, of a stored table, that roots doesn't connect yet."""
        of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")})
        return both.where("root_a <> root_b")

    def merged(edges: DataFrame) -> DataFrame:
        """roots after links between (root_a, root_b)."""
        tops = components(edges)
        here = roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        top = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
        return stored(here.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))

    def proven(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b, root_a, root_b), between roots."""
        pairs = stored(pairs)
        if pairs.isEmpty():
            return spark.createDataFrame([], "a long, b long")
        ok = verified(pairs, sets, state)
        return stored(ok.join(pairs, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())

    drawn = [posts.where((F.col(p) != F.col("rid")) & alike("n", n)).select(F.least("rid", p).alias("a"), F.greatest("rid", p).alias("b")) for p, n in (("p1", "n1"), ("p2", "n2"))]
    edges = proven(joined(drawn[0].unionByName(drawn[1]).distinct()))
    if not edges.isEmpty():
        roots = merged(edges)
    rooted = posts.select("k1", F.coalesce("k2", F.lit(0)).alias("k2"), F.col("k2").isNull().alias("heavy"), "c", "rid", "n").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    key = ["k1", "k2", "heavy"]
    mixed = rooted.groupBy(*key).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select(*key)
    rest = stored(rooted.join(mixed, key))
    pairs = paired(rest.where(F.col("c") <= LONG_LIST), key)
    sure = None
    long = rest.where(F.col("c") > LONG_LIST)
    if not long.isEmpty():
        more, sure = by_difference(long, key, sets, state, hot)
        pairs = pairs.unionByName(more)
    edges = proven(pairs.distinct())
    if sure is not None:
        edges = stored(edges.unionByName(sure).distinct())
    return roots if edges.isEmpty() else merged(edges)


def classes(docs: DataFrame) -> DataFrame:
    """doc_key, tie, n, head of each row of docs (doc_key, tie, text): head is the least (doc_key, tie) of its component."""
    importable(docs.sparkSession)
    own = F.struct("doc_key", "tie")
    shared, hot = shingle_filters(docs.select("text"))
    state = stored(states(docs, shared, hot))
    some = state.where("class is not null").groupBy("class").agg(F.min(own).alias("low"), F.max("n").alias("n"), F.first("tokens", True).alias("tokens"), F.first("singles", True).alias("singles"), F.first("parity", True).alias("parity"))
    sets = stored(some.withColumn("rid", F.monotonically_increasing_id()))
    roots = linked(sets, postings(sets, boundary(sets)), state, hot)
    rooted = sets.select("class", "low", "rid").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = rooted.groupBy("root").agg(F.min("low").alias("head"))
    named = rooted.join(least, "root").select("class", "head")
    alone = state.where("class is null").select("doc_key", "tie", "n", own.alias("head"))
    return state.where("class is not null").select("doc_key", "tie", "n", "class").join(named, "class").select("doc_key", "tie", "n", "head").unionByName(alone)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_key (null last), tie (of the text, to tell rows of one doc_id apart), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return steady(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), F.xxhash64(text).alias("tie"), text.alias("text")))


def op10_ngram_jaccard(docs: DataFrame) -> DataFrame:
    back = lambda c: F.when(c != LAST, c)
    return classes(keyed(docs)).select(back(F.col("doc_key")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.col("head.doc_key")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, for each component: that of the smallest doc_id (null last), then of the least hash of the text. Rows of one doc_id with
    different texts are documents of their own. Of rows that repeat doc_id and text one stays, the first by its columns as JSON; rows
    without doc_id and without words all stay."""
    docs = steady(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), F.xxhash64(text).alias("tie"), (F.col("doc_id").isNotNull() | text.rlike(r"[^\x20\x09-\x0D]")).alias("known"), F.struct("*").alias("row"))
    key = ["doc_key", "tie"]
    gone = classes(keyed(docs)).where("head.doc_key <> doc_key or head.tie <> tie").select(*key).distinct()
    kept = named.join(gone, key, "left_anti")
    twice = stored(named.where("known").groupBy(*key).count().where("count > 1").select(*key))
    if twice.isEmpty():
        return kept.select("row.*")
    firsts = kept.where("known").join(twice, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    once = kept.where("known").join(twice, key, "left_anti").unionByName(kept.where("not known"))
    return once.select("row.*").unionByName(firsts.select("row.*"))
