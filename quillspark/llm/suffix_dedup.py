"""Suffix-array dedup: bytes covered by a string of 400 bytes that starts more than once in the corpus go.

Shards hold the distinct segments of their anchors (see ``repeats``), with how often each occurs. A shard's suffixes are sorted by
Larsson-Sadakane refinement, their common prefixes come from Kasai's rule, and windows next to each other with a common prefix of
a whole window are equal. A bucket's segments are dealt to shards of about ``SHARD_BYTES`` in order of their anchors; equal windows have equal
anchors, so only shards that share an anchor are merged, by binary search of each one's windows in the other.

Defined results: a null or empty text has no bytes; shorter texts than a window lose nothing; repeated rows are occurrences of
their own and have equal results; an empty table gives an empty result. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import eights
from .repeats import LAST, Windows, covered, filters, indexed, keyed, marked, removed, segments
from .suffixes import kasai, suffix_array

WINDOWS = Windows("byte", 400, 100, 1 << 18)
SHARD_BYTES = 1 << 20
REPEATED = -(1 << 63)
SEPARATOR = b"\xff"  # stands in no UTF-8 text
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Shard:
    """Sorted windows of some segments: groups of equal ones, with how often they occur."""

    def __init__(self, bodies: list[bytes], times: np.ndarray, k: int):
        length = np.array([len(b) for b in bodies])
        self.text = np.frombuffer(SEPARATOR.join(bodies), np.uint8)
        start = np.cumsum(length + 1) - length - 1
        count = length - k + 1
        self.at = (np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        seen = np.zeros(256, bool)
        seen[self.text] = True
        dense = (np.cumsum(seen) - 1).astype(np.uint8)
        order = suffix_array(dense[self.text])[0]  # in full: Kasai needs the true order, also among equal windows
        lcp = kasai(self.text, order, start, count, k)
        weight = np.zeros(len(self.text), np.int64)
        weight[self.at] = np.repeat(times, count)
        windows = order[weight[order] > 0]
        # equal windows are neighbours in order, with no other suffix between them
        new = lcp[windows] < k
        group = np.cumsum(new) - 1
        self.first, self.total = windows[new].astype(np.int64), np.bincount(group, weight[windows]).astype(np.int64)
        self.group = np.zeros(len(self.text), np.int32)
        self.group[windows] = group
        self.segment = np.searchsorted(start, self.first, "right") - 1  # of each group's first window


def merge(a: Shard, b: Shard, mine: np.ndarray, theirs: np.ndarray, k: int) -> None:
    """Adds to the groups ``mine`` of a, and ``theirs`` of b, what the equal groups of the other had alone."""
    x, y = eights(a.text).byteswap(), eights(b.text).byteswap()
    mine_at, theirs_at = a.first[mine], b.first[theirs]
    low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs))
    equal = np.full(len(mine), -1)
    live = np.arange(len(mine))
    while len(live):
        middle = (low[live] + high[live]) // 2
        sign, left = np.zeros(len(live), np.int64), np.arange(len(live))
        for step in range(0, k, 8):
            place = min(step, k - 8)
            p, q = x[mine_at[live[left]] + place], y[theirs_at[middle[left]] + place]
            sign[left[p < q]], sign[left[p > q]] = -1, 1
            left = left[p == q]
            if not len(left):
                break
        equal[live[left]] = middle[left]
        low[live[sign > 0]] = middle[sign > 0] + 1
        high[live[sign < 0]] = middle[sign < 0]
        live = live[(sign != 0) & (low[live] < high[live])]
    hit = np.flatnonzero(equal >= 0)
    i, j = mine[hit], theirs[equal[hit]]
    a.more[i] += b.total[j]
    b.more[j] += a.total[i]


def index_bytes(k: int, shard_bytes: int = SHARD_BYTES):
    def index(bodies: list[bytes], anchor: np.ndarray, low: np.ndarray, times: np.ndarray):
        number = np.cumsum([len(b) for b in bodies]) // shard_bytes
        cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])).tolist()
        held: list[tuple[slice, Shard]] = []  # those that share their last anchor with what comes

        def known(part: slice, shard: Shard):
            return part, np.where((shard.total + shard.more)[shard.group[shard.at]] > 1, REPEATED, LAST)

        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and anchor[begin] != anchor[begin - 1]:
                yield from (known(*x) for x in held)
                held = []
            shard = Shard(bodies[begin:end], times[begin:end], k)
            shard.more = np.zeros_like(shard.total)
            theirs = np.flatnonzero(anchor[begin:end][shard.segment] == anchor[begin])
            for part, before in held:
                mine = np.flatnonzero(anchor[part][before.segment] == anchor[begin])
                if len(mine):
                    merge(before, shard, mine, theirs, k)
            held.append((slice(begin, end), shard))
        yield from (known(*x) for x in held)

    return index


def alone(low: np.ndarray, times: np.ndarray) -> np.ndarray:
    return np.where(times > 1, REPEATED, LAST)


def _kept(batches):
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = text.as_py().encode()
            if spans.is_valid:
                gone = covered(len(data), spans.as_py())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            else:
                kept, runs = data, 0
            rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def op7_suffix_array_dedup(docs: DataFrame, spec: Windows = WINDOWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    docs = keyed(docs)
    passed = filters(docs, spec)
    found = indexed(segments(docs, spec, passed), index_bytes(spec.k, shard_bytes), alone)
    return removed(docs, marked(docs, spec, passed, found, later=False), _kept, SCHEMA)
