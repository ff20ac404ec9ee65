"""Bloom filters over keys that occur often enough, built from all rows.

A range of keys belongs to each bucket, and with it a slice of the filter. Every task sorts its distinct keys with their counts and sends
them, as differences of their upper ``KEY_BITS``, to their buckets; a bucket sums them and sets the bits of its slice. A slice has its share
of ``BITS``, and ``KEY_SPACE`` bits for each of its keys where that is more: a full filter lets all keys through, and what follows then carries the
whole corpus. The driver sees the slices only, up to ``MOST_BITS`` in all. Keys that agree in the upper bits, or a fuller filter, pass more
keys and cost time; none is ever lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .session import importable, partitions, tidied

BITS, HOT_BITS, MOST_BITS = 1 << 27, 1 << 21, 1 << 30
KEY_SPACE = 6  # bits; with four probes 6 % of other keys pass
HELD_KEYS = 1 << 21
KEY_BITS = 36
COUNT_BITS = 64 - KEY_BITS
PROBES = tuple(A.mix(np.arange(11, 15, dtype=A.U) * A.STEP) | A.U(1))
PACKED = "bucket int, start long, size int, steps binary, many binary, counts binary"
CODEC = pa.Codec("zstd", 1)


class Filter:
    """slices: the bytes of each bucket's slice. held: how many occurrences its keys have in all."""

    def __init__(self, slices: list[bytes], held: int = 0):
        self.buckets, self.bits, self.held = len(slices), np.frombuffer(b"".join(slices), np.uint8), held
        self.sizes = np.array([8 * len(x) for x in slices], A.U)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def test(self, keys: np.ndarray) -> np.ndarray:
        short = keys >> A.U(COUNT_BITS)
        bucket = bucket_of(short, self.buckets).astype(np.int64)
        base, size = self.starts[bucket], self.sizes[bucket]
        mixed = A.mix(short)
        out = np.ones(len(keys), bool)
        for probe in PROBES:
            at = base + ((mixed * probe) >> A.U(32)) % size
            out &= (self.bits[(at >> A.U(3)).astype(np.int64)] >> (at & A.U(7)).astype(np.uint8)) & 1 > 0
        return out


def bucket_of(short: np.ndarray, buckets: int) -> np.ndarray:
    return (short * A.U(buckets)) >> A.U(KEY_BITS)


def filled(short: np.ndarray, size: int) -> bytes:
    bits, mixed = np.zeros(size, bool), A.mix(short)
    for probe in PROBES:
        bits[(((mixed * probe) >> A.U(32)) % A.U(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _packed(short: np.ndarray, buckets: int) -> pa.RecordBatch:
    """short: sorted upper bits, with repeats. A row for each bucket: the distinct ones' differences, byte by byte, and counts above 1."""
    first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    counts = np.diff(np.append(first, len(short)))
    keys = short[first]
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        k, c = keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]
        steps = np.diff(k).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (KEY_BITS + 7) // 8]
        many = np.flatnonzero(c > 1)
        rows.append((b, int(k[0]), len(k), CODEC.compress(steps.T.tobytes(), asbytes=True), many.astype(np.uint32).tobytes(), c[many].astype(np.uint32).tobytes()))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], [x.split()[0] for x in PACKED.split(", ")])


def _unpacked(start: int, size: int, steps: bytes, many: bytes, counts: bytes) -> np.ndarray:
    """Upper bits and count of each key, in one number."""
    wide = (KEY_BITS + 7) // 8
    out = np.empty(size, A.U)
    if size > 1:
        raw = np.frombuffer(CODEC.decompress(steps, wide * (size - 1), asbytes=True), np.uint8).reshape(wide, -1)
        step = np.zeros((size - 1, 8), np.uint8)
        step[:, :wide] = raw.T
        np.cumsum(step.view("<u8").ravel(), out=out[1:])
        out[1:] += A.U(start)
    out[0] = start
    out <<= A.U(COUNT_BITS)
    count = np.ones(size, A.U)
    count[np.frombuffer(many, np.uint32)] = np.frombuffer(counts, np.uint32)
    return out | count


def counted(docs: DataFrame, keys_of) -> DataFrame:
    """Packed distinct keys with counts of each task's rows. keys_of(batch): arrays of keys."""
    buckets = partitions(docs.sparkSession)

    def run(batches):
        held, size = np.empty(HELD_KEYS, A.U), 0
        for batch in batches:
            for keys in keys_of(batch):
                at = 0
                while at < len(keys):
                    some = keys[at : at + HELD_KEYS - size]
                    np.right_shift(some, A.U(COUNT_BITS), out=held[size : size + len(some)])
                    size, at = size + len(some), at + len(some)
                    if size == HELD_KEYS:
                        held.sort()
                        yield _packed(held, buckets)
                        size = 0
        if size:
            yield _packed(np.sort(held[:size]), buckets)

    return docs.mapInArrow(tidied(run), PACKED)


def built(packed: DataFrame, hot: int, common: int = 2, bits: int = BITS) -> tuple[Filter, Filter | None]:
    """A filter of the keys with ``common`` occurrences, and one of those with ``hot`` (None if there are none)."""
    spark = packed.sparkSession
    importable(spark)
    buckets = partitions(spark)
    share = lambda total: max(64, total // buckets // 64 * 64)
    least, hot_size, largest = share(bits), share(HOT_BITS), share(max(bits, MOST_BITS))
    most = A.U((1 << COUNT_BITS) - 1)

    def run(rows: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in PACKED.split(", ")][1:]
        parts = [_unpacked(*(x.as_py() for x in row)) for row in zip(*(rows[n] for n in names), strict=True)]
        both = np.concatenate(parts)
        del parts
        both.sort()
        short = both >> A.U(COUNT_BITS)
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        short = short[first]
        both &= most
        total = np.add.reduceat(both, first)
        often, very = short[total >= common], short[total >= hot]
        size = min(max(least, -(-KEY_SPACE * len(often) // 64) * 64), largest)
        columns = {
            "bucket": pa.array([rows["bucket"][0].as_py()], pa.int32()), "held": pa.array([int(total[total >= common].sum())], pa.int64()),
            "shared": pa.array([filled(often, size)], pa.binary()), "hot": pa.array([filled(very, hot_size) if len(very) else None], pa.binary()),
        }
        return pa.table(columns)

    rows = packed.groupBy("bucket").applyInArrow(tidied(run), "bucket int, held long, shared binary, hot binary").collect()
    found = {r.bucket: r for r in rows}
    shared = [found[b].shared if b in found else bytes(least // 8) for b in range(buckets)]
    very = [found[b].hot or bytes(hot_size // 8) if b in found else bytes(hot_size // 8) for b in range(buckets)]
    return Filter(shared, sum(r.held for r in rows)), Filter(very) if any(r.hot for r in rows) else None
