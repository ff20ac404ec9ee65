"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes cuts a text where it meets a mask, a harder one before the aimed length and an easier one
after it (normalised chunking), so edits move boundaries only nearby. The fingerprint is the sorted set of chunk digests,
each with its length; likeness is containment: the length of the chunks that the other has too, over the own length.

``neighbours`` pairs each document with the next in order of doc_id without a window over all rows: rows go to parts of
that order, each part is sorted and streamed, and the first row of a part also goes to the part before it.

Defined results: a null text is empty; an empty text has the empty fingerprint, like 1.0 to another empty one and 0.0 to
others; null doc_ids come last; rows of one doc_id are in order of their text's hash; a lone row is its own next; an
empty table gives an empty result. An input that isn't the same at each reading (limit, sample) is stored first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .session import importable, partitions, slots, steady, tidied

LEAST, AIM, MOST = 32, 96, 255
HARD, EASY = A.U(0xFE000000), A.U(0xF8000000)  # 7 and 5 bits
GEAR = (A.VALUE >> A.U(32)).astype(np.uint32)
ROWS = 64  # of which Python holds the texts at a time, besides those of a flush
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gear(buf: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there, by doubling the reach five times."""
    h = GEAR[buf]
    for reach in (1, 2, 4, 8, 16):
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
    return h


def ends(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of a run of texts, and each text's first chunk (one more entry)."""
    easy = np.flatnonzero((h & np.uint32(EASY)) == 0)
    hard = (h[easy] & np.uint32(HARD)) == 0
    hard_at, easy_at = easy[hard].tolist(), easy.tolist()
    out, first, i, j, ni, nj = [], [0], 0, 0, len(hard_at), len(easy_at)
    for start, end in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        while start < end:
            low, aim, cut = start + LEAST - 1, start + AIM - 1, start + MOST
            while i < ni and hard_at[i] < low:
                i += 1
            if i < ni and hard_at[i] < aim:
                cut = hard_at[i] + 1
            else:
                while j < nj and easy_at[j] < aim:
                    j += 1
                if j < nj and easy_at[j] < cut:
                    cut = easy_at[j] + 1
            start = min(cut, end)
            out.append(start)
        first.append(len(out))
    return np.array(out, np.int64), np.array(first)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted distinct chunk digests: 56 bits of hash, then 8 bits of length."""
    out: list[np.ndarray] = []
    for _, _, buf, off in A.chunks(pa.array(texts, pa.large_binary()).cast(pa.large_string()), 1 << 19):
        if not len(buf):
            out += [np.zeros(0, A.U)] * (len(off) - 1)
            continue
        # a cut is at least LEAST bytes from the start of its text, so no hash reaches back into another
        end, first = ends(gear(buf), off)
        start = np.concatenate([[0], end[:-1]])
        digest = (A.hashes(buf, start, end) << A.U(8)) | (end - start).astype(A.U)
        out += [np.unique(digest[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment: which share of a's length is in chunks that b has too."""
    total = int((a & A.U(255)).sum())
    if not total:
        return float(not len(b))
    return float((np.intersect1d(a, b, assume_unique=True) & A.U(255)).sum()) / total


def text_of(digests: np.ndarray) -> str:
    return digests.astype(">u8").tobytes().hex()


KEY = ("absent", "doc_id", "tie")
PER_PART = 40  # rows drawn for each part, to cut the order evenly


ALONE, OWN, FOLLOWING = range(3)


def dealt(docs: DataFrame, parts: int) -> tuple[DataFrame, int] | None:
    """part, slot, kind, KEY, text, and the number of parts: all rows in parts of the order of KEY; what a part begins with also goes, as
    FOLLOWING, to the part before.

    A part begins with the key of a row that was drawn, so which rows are first is known without asking, and no two parts begin
    with the same key. Rows of one doc_id and text are alike: of those that were drawn more than once each task lets one take its place in
    the order; a further one is followed by one like it whatever the order is, so it goes ALONE to the parts in turn.
    None if there are no rows."""
    spark = docs.sparkSession
    rows = steady(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = rows.select(F.col("doc_id").isNull().cast("int").alias("absent"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    all_of = rows.agg(F.min(F.struct(*KEY)).alias("least"), F.count("*").alias("count")).head()
    if not all_of["count"]:
        return None
    least, share = tuple(all_of.least), PER_PART * parts / all_of["count"]
    drawn = sorted(tuple(r) for r in rows.select(*KEY).where(F.rand(7) < share).collect()) or [least]  # some for each partition
    cuts = sorted({least, *(drawn[len(drawn) * p // parts] for p in range(1, parts))})
    often = {a for a, b in zip(drawn, drawn[1:], strict=False) if a == b}
    parts = len(cuts)
    slot = slots(spark, parts)

    def run(batches):
        turn, sent, met = 0, set(), {}
        for batch in batches:
            to, kind, again, before = [], [], [], []
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)):
                if key in often:
                    text = batch.column("text")[at].as_py()
                    if met.setdefault(key, text) == text and key in sent:
                        to.append(turn % parts)
                        kind.append(ALONE)
                        turn += 1
                        continue
                    sent.add(key)
                low, high = bisect_left(cuts, key), bisect_right(cuts, key)
                to.append(high - 1)
                kind.append(OWN)
                if low < high:
                    again.append(at)
                    before.append((low - 1) % parts)
            out = batch.take(pa.array([*range(len(to)), *again], pa.int32()))
            to += before
            kind += [FOLLOWING] * len(again)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([slot[p] for p in to], pa.int32()), pa.array(kind, pa.int32()), *out.columns], ["part", "slot", "kind", *out.schema.names])

    return rows.mapInArrow(tidied(run), "part int, slot int, kind int, absent int, doc_id long, tie long, text string"), parts


def neighbours(docs: DataFrame, run, schema: str) -> DataFrame:
    """run((doc_id, text) rows in order, each with the next one's text) over parts of the order of doc_id."""
    spark = docs.sparkSession
    importable(spark)
    found = dealt(docs, max(2, partitions(spark)))
    if found is None:
        return spark.createDataFrame([], schema)
    rows, parts = found

    def streamed(batches):
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    few = batch.slice(at, ROWS)
                    yield from zip(*(few.column(c).to_pylist() for c in ("part", "kind", "absent", "doc_id", "text")), strict=True)

        def paired():
            held = None
            for part, kind, absent, doc_id, text in rows():
                if held:
                    if held[0] != part:
                        raise RuntimeError("the input has changed since its order was cut")
                    yield held[1], held[2], text
                name = None if absent else doc_id
                held = (part, name, text) if kind == OWN else None
                if kind == ALONE:
                    yield name, text, text
            if held:
                raise RuntimeError("the input has changed since its order was cut")

        yield from run(paired())

    ordered = rows.repartition(parts, "slot").sortWithinPartitions("part", "kind", *KEY)
    return ordered.select("part", "kind", "absent", "doc_id", "text").mapInArrow(tidied(streamed), schema)


def fingerprinted(pairs, limit: int = 1 << 19):
    def flush(rows):
        edited = []
        for _, text, after in rows:
            k = len(text) // 4
            edited.append((text[: len(text) - k] + after[:k]).encode())
        own, other, following = (fingerprints(x) for x in ([r[1].encode() for r in rows], edited, [rows[-1][2].encode()]))
        columns = [
            (doc_id, len(text), hashlib.sha256(edited[at]).hexdigest(), text_of(own[at]), text_of(other[at]), likeness(own[at], other[at]), likeness(own[at], own[at + 1] if at + 1 < len(rows) and rows[at + 1][1] == after else fingerprints([after.encode()])[0] if at + 1 < len(rows) else following[0]))
            for at, (doc_id, text, after) in enumerate(rows)
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    held, size = [], 0
    for row in pairs:
        held.append(row)
        size += len(row[1])
        if size > limit:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def op8_document_fingerprints(docs: DataFrame) -> DataFrame:
    return neighbours(docs, fingerprinted, SCHEMA)
