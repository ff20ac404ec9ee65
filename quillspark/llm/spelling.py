"""Grouping of spelling variants by an even-partition pigeonhole join.

Words that differ by one inserted, deleted or replaced code point agree in at least one half: a word of l code points is indexed under
its first l // 2 and under the rest. A word of equal length probes both at their own places, a word of l + 1 the first half at its own
place and the second one place later. Where many words have one half, their other halves are within one edit themselves, so the
same split is made of these, and so on: keys grow until few words share one, or all but one code point is in the key, when no more words
can share it than there are letters. So no frequent beginning or ending makes many pairs. Candidates that several keys bring are one; each is
verified.

Words are counted chunk by chunk on the byte arrays of the texts, so what is shuffled is a row for each distinct word of a chunk.

Defined results: a null or empty text has no runs; a null doc_id counts as the empty string in the crc32; repeated rows count again; an empty
table, or one without a frequent word, gives an empty result. Only doc_id and text are read, so other columns may have any name. A run of any
length is one word.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .session import importable, stored, tidied

LEAST_LENGTH, LEAST_COUNT, TIMES, ONE_IN = 5, 3, 2, 97
CROWD = 16  # words that share a key are compared as they are up to here
HELD_WORDS = 100_000  # that a task counts before it passes them on
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # U+00C0 to U+00FF are the byte C3 and one more
CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the register's step, without its start and end


def runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal letter runs of a chunk of texts."""
    letter = LETTER[buf]
    letter[1:] |= buf[:-1] == 0xC3
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    inner = off[(off > 0) & (off < len(buf))]
    start[inner] = letter[inner]
    end[inner - 1] = letter[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def checksums(buf: np.ndarray, s: np.ndarray, e: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, continued from before, byte by byte for all spans at once; long ones by zlib."""
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = e - s
    long = np.flatnonzero(size > 64)
    live, at = np.flatnonzero(size <= 64), 0
    while len(live):
        live = live[size[live] > at]
        now = out[live]
        out[live] = CRC[(now ^ buf[s[live] + at]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        at += 1
    out ^= np.uint32(0xFFFFFFFF)
    for x in long.tolist():
        out[x] = zlib.crc32(buf[s[x] : e[x]].tobytes(), int(before[x]))
    return out


def counted(ids: list, buf: np.ndarray, off: np.ndarray, one_in: int = ONE_IN, least: int = LEAST_LENGTH) -> dict[bytes, int]:
    """How often each word of at least ``least`` code points is in a chunk of texts."""
    buf = A.LOWER[buf]
    s, e = runs(buf, off)
    if not len(s):
        return {}
    doc = np.searchsorted(off, s, "right") - 1
    head = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids], np.uint32)
    check = checksums(buf, s, e, head[doc])
    pairs = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf == 0xC3, out=pairs[1:])
    points = (e - s) - (pairs[e] - pairs[s])
    touched = check % np.uint32(one_in) == 0
    whole = np.flatnonzero(~touched & (points >= least))
    key, at, count = np.unique(A.hashes(buf, s[whole], e[whole]), return_index=True, return_counts=True)
    raw = buf.tobytes()
    out: dict[bytes, int] = {}
    for x, n in zip(whole[at].tolist(), count.tolist(), strict=True):
        out[raw[s[x] : e[x]]] = n
    for x in np.flatnonzero(touched & (points > least)).tolist():
        word = raw[s[x] : e[x]].decode()
        gone = int(check[x]) % len(word)
        word = (word[:gone] + word[gone + 1 :]).encode()
        out[word] = out.get(word, 0) + 1
    return out


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of docs (doc_id, text): words of ``LEAST_LENGTH`` code points and ``least_count`` occurrences at least."""
    importable(docs.sparkSession)

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, buf, off in A.chunks(batch.column("text")):
                for word, n in counted(ids[i:j], buf, off).items():
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield of(held)
                    held = {}
        if held:
            yield of(held)

    def of(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def part(text: Column, first: Column, length: Column) -> Column:
    """length code points of text from place first (0, 1, ...)."""
    return F.substring(text, first + 1, length)


def halves(rows: DataFrame) -> DataFrame:
    """The next keys of rows (word, n, key, low, high, over): of a word's part from low to high that is not in its key, with over = 1
    if the part is to be one longer than the indexed word's. Each key holds what it was made of, so it names its places too."""
    size = F.col("high") - F.col("low") - F.col("over")  # of the indexed word's part
    half = F.floor(size / 2).cast("int")
    key = lambda side, text: F.concat_ws(" ", "key", F.lit(side), size.cast("string"), text)
    first = F.struct(key("<", part(F.col("word"), F.col("low"), half)).alias("key"), (F.col("low") + half).alias("low"), F.col("high").alias("high"))
    rest = F.col("low") + half + F.col("over")
    second = F.struct(key(">", part(F.col("word"), rest, size - half)).alias("key"), F.col("low").alias("low"), rest.alias("high"))
    both = rows.withColumn("new", F.explode(F.array(first, second)))
    return both.select("word", "n", "over", "new.*")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, a_n, b, b_n: each two words of words (word, n) that differ by exactly one code point, once.

    Keys of more than ``crowd`` words are split on, each round by a count that combines before its shuffle, as long as a part of two or
    more code points is left. A candidate is verified where its key brings it up, so only pairs that are near are moved to become one."""
    start = words.select("word", "n", F.lit("").alias("key"), F.lit(0).alias("low"), F.length("word").cast("int").alias("high"))
    index, probes, found = halves(start.withColumn("over", F.lit(0))), halves(start.withColumn("over", F.lit(1))), []
    while True:
        index, probes = stored(index), stored(probes)
        sides = index.withColumn("indexed", F.lit(True)).unionByName(probes.withColumn("indexed", F.lit(False)))
        sizes = sides.groupBy("key").agg(F.count("*").alias("c"), F.max("indexed").alias("indexed"), F.first(F.col("high") - F.col("low") - F.col("over")).alias("size"))
        crowded = stored(sizes.where((F.col("c") > crowd) & F.col("indexed") & (F.col("size") > 1)).select("key"))
        last = crowded.isEmpty()
        here = lambda rows, kind: rows if last else rows.join(crowded, "key", kind)
        few, more = (here(rows, "left_anti").select("key", "word", "n") for rows in (index, probes))
        one = few.toDF("key", "a", "a_n")
        for other, apart in ((few, F.col("a") < F.col("b")), (more, F.lit(True))):  # equal lengths are probed by the index itself
            found.append(stored(one.join(other.toDF("key", "b", "b_n"), "key").where(apart & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")))
        if last:
            return reduce(DataFrame.unionByName, found).distinct()
        index, probes = (halves(here(rows, "left_semi")) for rows in (index, probes))


def near(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n, other, other_n for each two words of words (word, n) that differ by exactly one code point, in both directions."""
    pairs, names = stored(near_pairs(words, crowd)), ["word", "n", "other", "other_n"]
    return pairs.toDF(*names).unionByName(pairs.select("b", "b_n", "a", "a_n").toDF(*names))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form); a form counts at least twice its word, so chains end. Reach doubles with each round."""
    state = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        state = new.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """word, n, n_near, form, form_n, root of words (word, n)."""
    words = stored(words)
    best = near(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("other"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("taken", F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False)))
    out = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("taken"), F.col("best.other")).alias("form"), F.when(F.col("taken"), -F.col("best.m")).alias("form_n")))
    return out.join(roots(out.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")
