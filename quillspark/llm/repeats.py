"""Repeated windows of a fixed length over a whole corpus: the parts that the two substring operators share.

Every window of k symbols (words or bytes) has an anchor, the gram of m symbols in it with the smallest hash, so equal windows
have equal anchors at equal places. Consecutive windows of one anchor form a segment; each window is in one segment.

1. ``filters``: anchors of all texts are counted in packed form; only segments whose anchor occurs twice go on. Under a hot
   anchor (``HOT`` occurrences) windows are counted one by one, and only the runs of windows that occur twice go on.
2. ``indexed``: each task sends its distinct segments to the bucket of their anchor; there are as many buckets as the counted
   anchors fill with ``BUCKET_BYTES`` each. A distinct segment that is the only one of its anchor has no other equals than
   itself, so its occurrences say all. Among the others an index (the operator's own) tells for each window what is known of its equals.
3. ``marked``: all occurrences of segments meet these findings in a join, which Spark can split where a segment is hot, and
   give the spans of each document.

Segments are known by 64 bits of their anchor and 64 bits of xxh3 of their bytes; a bucket compares the bytes of those it merges and
stops the job if two differ. Rows are known by doc_id and the hash of their text: rows that repeat both have the same result. A null
doc_id is last. Other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .filters import Filter, built, counted
from .session import importable, partitions, steady, tidied

HOT = 2000
BUCKET_BYTES = 16 << 20
LAST = (1 << 63) - 1
LOW32, HIGH32 = A.U(0xFFFFFFFF), A.U(0xFFFFFFFF00000000)
SEGMENT = "bucket int, packed binary"
FOUND = "anchor long, segment long, a int, b int, low long"


@dataclass(frozen=True)
class Windows:
    unit: str  # "word" or "byte"
    k: int
    m: int
    chunk: int


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return steady(docs.select(doc_id.alias("doc_id"), text.alias("text"))).withColumns({"doc_key": F.coalesce("doc_id", F.lit(LAST)), "text_key": F.xxhash64("text")})


class Cut:
    """The segments of a chunk: doc, place (symbol in the chunk), windows, anchor, segment (hash)."""

    def __init__(self, spec: Windows, buf: np.ndarray, off: np.ndarray):
        self.spec, self.buf = spec, buf
        if spec.unit == "word":
            self.s, self.e, self.first = A.words(buf, off)
            symbols = A.word_hashes(buf, self.s, self.e)
        else:
            self.first, symbols = off, A.VALUE[buf]
        n = len(symbols) - spec.k + 1
        self.place = np.zeros(0, np.int64)
        if n <= 0:
            self.doc = self.windows = self.place
            self.anchor = np.zeros(0, A.U)
            return
        gram = A.grams(symbols, spec.m)
        at = (A.sliding_min((gram & HIGH32) | np.arange(len(gram), dtype=A.U), spec.k - spec.m + 1) & LOW32).astype(np.int64)
        valid = np.ones(n, bool)
        for end in self.first[1:-1]:
            valid[max(0, end - spec.k + 1) : end] = False
        start = valid.copy()
        start[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        self.place = np.flatnonzero(start)
        # a run of windows ends before the next run or the next invalid one
        stop = np.flatnonzero(valid & np.append(start[1:] | ~valid[1:], True)) + 1
        self.windows = stop - self.place
        self.doc = np.searchsorted(self.first, self.place, "right") - 1
        self.anchor = gram[at[self.place]]
        self.symbols = symbols

    def take(self, keep: np.ndarray) -> None:
        self.place, self.windows, self.doc, self.anchor = (x[keep] for x in (self.place, self.windows, self.doc, self.anchor))

    def each(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments ``keep``: their windows' places, which segment each is of, and the windows' hashes."""
        of, count = np.flatnonzero(keep), self.windows[keep]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(self.place[keep], count) + inner
        return place, np.repeat(of, count), A.spans(A.prefix(self.symbols), place, place + self.spec.k) if len(place) else np.zeros(0, A.U)

    def parts(self, keep: np.ndarray, windows: "Filter") -> "Cut":
        """The runs of windows that pass the filter in the segments ``keep``, as segments of the same anchors."""
        place, of, key = self.each(keep)
        good = windows.test(key)
        place, of = place[good], of[good]
        start = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (of[1:] != of[:-1])])) if len(place) else np.zeros(0, np.int64)
        out = object.__new__(Cut)
        out.__dict__.update(self.__dict__)
        out.place, of = place[start], of[start]
        out.windows = np.diff(np.append(start, len(place)))
        out.doc, out.anchor = self.doc[of], self.anchor[of]
        return out

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end bytes of the segments."""
        first, end = self.place, self.place + self.windows + self.spec.k - 1
        return (self.s[first], self.e[end - 1]) if self.spec.unit == "word" else (first, end)

    def segments(self) -> np.ndarray:
        """Hashes of the segments' bytes."""
        view = memoryview(self.buf)
        return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(*(x.tolist() for x in self.bounds()), strict=True)), A.U, len(self.place))


@dataclass
class Passed:
    """Which segments go on: anchors that occur twice, and under hot anchors windows that do."""

    shared: Filter
    hot: Filter | None = None
    windows: Filter | None = None

    def cuts(self, cut: Cut):
        keep = self.shared.test(cut.anchor)
        cut.take(keep)
        if self.hot is not None:
            very = self.hot.test(cut.anchor)
            if very.any():
                yield cut.parts(very, self.windows)
                cut.take(~very)
        yield cut


def filters(docs: DataFrame, spec: Windows, hot: int = HOT) -> Passed:
    importable(docs.sparkSession)
    texts = docs.select("text")

    def anchors(batch):
        for _, _, buf, off in A.chunks(batch.column("text"), spec.chunk):
            yield Cut(spec, buf, off).anchor

    shared, very = built(counted(texts, anchors), hot)
    if very is None:
        return Passed(shared)

    def windows(batch):
        for _, _, buf, off in A.chunks(batch.column("text"), spec.chunk):
            cut = Cut(spec, buf, off)
            keep = very.test(cut.anchor)
            if keep.any():
                yield cut.each(keep)[2]

    return Passed(shared, very, built(counted(texts, windows), 1 << 62)[0])


def distinct(anchor: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): rows in order of their key, and where each distinct key begins in it."""
    order = np.lexsort((segment, anchor))
    anchor, segment = anchor[order], segment[order]
    return order, np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])])) if len(order) else order


def merged(rows: pa.Table) -> pa.Table:
    """Rows of one segment as one, in order of anchor and segment: the smallest low, all times, the body that all have."""
    anchor, segment, low, times, windows = (rows[c].to_numpy() for c in ("anchor", "segment", "low", "times", "windows"))
    order, first = distinct(anchor, segment)
    if not len(first):
        return rows
    which = order[first]
    body = rows["body"].combine_chunks()
    body = pa.concat_arrays(body.chunks) if isinstance(body, pa.ChunkedArray) else body
    again = np.setdiff1d(np.arange(len(order)), first, assume_unique=True)
    if len(again):
        of = np.searchsorted(first, again, "right") - 1
        if not pc.all(pc.equal(body.take(pa.array(order[again])), body.take(pa.array(which[of])))).as_py():
            raise ValueError("two segments of one hash")
    return pa.table({"anchor": anchor[which], "segment": segment[which], "low": np.minimum.reduceat(low[order], first), "times": np.add.reduceat(times[order], first), "windows": windows[which], "body": body.take(pa.array(which))})


def segments(docs: DataFrame, spec: Windows, passed: Passed, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Distinct segments of each Arrow batch: their smallest doc_key, how often they occur, and their text; packed by bucket."""
    unit = 8 if spec.unit == "word" else 1
    buckets = max(partitions(docs.sparkSession), -(-passed.shared.held * 3 * spec.k * unit // (2 * bucket_bytes)))

    def packed(rows: pa.Table) -> pa.RecordBatch:
        bucket = (rows["anchor"].to_numpy() % A.U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows.take(pa.array(order)), bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rows.slice(a, b - a))
            out.append((int(bucket[a]), sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["bucket", "packed"])

    def run(batches):
        for batch in batches:
            key, found = batch.column("doc_key").to_numpy(), []
            for i, j, buf, off in A.chunks(batch.column("text"), spec.chunk):
                for cut in passed.cuts(Cut(spec, buf, off)):
                    segment = cut.segments()
                    order, first = distinct(cut.anchor, segment)
                    if len(first):
                        which = order[first]
                        low, times = np.minimum.reduceat(key[i:j][cut.doc[order]], first), np.diff(np.append(first, len(order)))
                        a, b = (x[which] for x in cut.bounds())
                        body = pa.array([buf[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.large_binary())
                        found.append(pa.table({"anchor": cut.anchor[which], "segment": segment[which], "low": low, "times": times, "windows": cut.windows[which], "body": body}))
            if found:
                yield packed(merged(pa.concat_tables(found).combine_chunks()))

    return docs.select("doc_key", "text").mapInArrow(tidied(run), SEGMENT)


def indexed(found: DataFrame, index, alone) -> DataFrame:
    """What is known of the windows of each distinct segment, LAST where there is nothing to say.

    index(bodies, anchor, low, times): pairs of segments (a slice) and the values of all their windows, for segments in order of anchor;
    alone(low, times): the one value of all windows of segments that are the only ones of their anchors."""

    def runs(anchor, segment, count, values):
        which = np.repeat(np.arange(len(anchor)), count)
        start = np.cumsum(count) - count
        new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (which[1:] != which[:-1])])) if len(values) else np.zeros(0, np.int64)
        end = np.append(new[1:], len(values))
        keep = values[new] != LAST
        new, end = new[keep], end[keep]
        of = which[new]
        return {"anchor": anchor[of].view(np.int64), "segment": segment[of].view(np.int64), "a": (new - start[of]).astype(np.int32), "b": (end - start[of]).astype(np.int32), "low": values[new]}

    def run(rows: pa.Table) -> pa.Table:
        rows = merged(pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for c in rows["packed"].chunks for x in c).combine_chunks())
        anchor, segment, low, times, windows = (rows[c].to_numpy() for c in ("anchor", "segment", "low", "times", "windows"))
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        several = np.repeat(np.diff(np.append(first, len(anchor))) > 1, np.diff(np.append(first, len(anchor))))
        value = alone(low, times)
        sure = np.flatnonzero(~several & (value != LAST))
        out = [{"anchor": anchor[sure].view(np.int64), "segment": segment[sure].view(np.int64), "a": np.zeros(len(sure), np.int32), "b": windows[sure].astype(np.int32), "low": value[sure]}]
        at = np.flatnonzero(several)
        if len(at):
            bodies = rows["body"].take(pa.array(at)).to_pylist()
            del rows
            for part, values in index(bodies, anchor[at], low[at], times[at]):
                own = at[part]
                out.append(runs(anchor[own], segment[own], windows[own], values))
        return pa.table({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    return found.groupBy("bucket").applyInArrow(tidied(run), FOUND)


def marked(docs: DataFrame, spec: Windows, passed: Passed, found: DataFrame, later: bool = True) -> DataFrame:
    """doc_key, text_key, spans (array of start and end symbols, not in order): what to remove from each document.

    later: only where the finding's low is a smaller doc_key; else wherever there is a finding."""

    def run(batches):
        for batch in batches:
            key, text = batch.column("doc_key").to_numpy(), batch.column("text_key").to_numpy()
            for i, j, buf, off in A.chunks(batch.column("text"), spec.chunk):
                for cut in passed.cuts(Cut(spec, buf, off)):
                    if len(cut.place):
                        yield pa.RecordBatch.from_arrays([pa.array(cut.anchor.view(np.int64)), pa.array(cut.segments().view(np.int64)), pa.array(key[i:j][cut.doc]), pa.array(text[i:j][cut.doc]), pa.array((cut.place - cut.first[cut.doc]).astype(np.int32))], ["anchor", "segment", "doc_key", "text_key", "place"])

    there = docs.select("doc_key", "text_key", "text").mapInArrow(tidied(run), "anchor long, segment long, doc_key long, text_key long, place int")
    met = there.join(found, ["anchor", "segment"])
    met = met.where(F.col("low") < F.col("doc_key")) if later else met
    span = F.struct((F.col("place") + F.col("a")).alias("start"), (F.col("place") + F.col("b") + F.lit(spec.k - 1)).alias("end"))
    return met.groupBy("doc_key", "text_key").agg(F.collect_set(span).alias("spans"))


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n symbols lie in a span."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        change[s["start"]] += 1
        change[s["end"]] -= 1
    return np.cumsum(change[:-1]) > 0


def removed(docs: DataFrame, spans: DataFrame, run, schema: str) -> DataFrame:
    """run(batches with doc_id, text and spans) over all rows of keyed() docs."""
    joined = docs.join(spans, ["doc_key", "text_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(tidied(run), schema)
