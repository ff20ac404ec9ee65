"""Substring dedup: word windows that start in an earlier document go, found by FM-indexes.

Shards hold the distinct segments of their anchors (see ``repeats``). Each shard's words become numbers and a compressed
FM-index; all windows of the shard are streamed through backward search over its wavelet matrix, whose matching statistics end at
the threshold of ``WINDOWS.k`` words. The interval of a window gives the smallest doc_id that has it. A bucket with more
words than ``SHARD_WORDS`` has several indexes, and the windows whose anchors an index has are streamed through it.

Defined results: a null or empty text has no words; texts below the window lose nothing; of rows with one doc_id none is the
smaller; a null doc_id is larger than all others; repeated rows have equal results; an empty table gives an empty result. Other columns
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import LAST, Windows, covered, filters, indexed, keyed, marked, removed, segments
from .suffixes import FMIndex

WINDOWS = Windows("word", 13, 6, 1 << 20)
SHARD_WORDS = 1 << 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def index_words(k: int, shard_words: int = SHARD_WORDS):
    def index(bodies: list[bytes], anchor: np.ndarray, low: np.ndarray, times: np.ndarray):
        words = [b.split() for b in bodies]
        length = np.array([len(w) for w in words])
        count = length - k + 1
        numbers: dict[bytes, int] = {}
        text = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, length.sum())
        start = np.cumsum(length) - length
        shard = np.cumsum(length) // shard_words
        for number in np.unique(shard):
            own = np.flatnonzero(shard == number)
            # equal windows have equal anchors, which stand together: others with one of these are next to them
            near = np.flatnonzero((anchor == anchor[own[0]]) | (anchor == anchor[own[-1]]))
            near = np.union1d(own, near)
            here = text[start[own[0]] : start[own[-1]] + length[own[-1]]]
            # symbols of this index: 0 its end, 1 between segments, then its words
            seen, code = np.unique(here, return_inverse=True)
            to = np.full(len(numbers), -1, np.int64)
            to[seen] = np.arange(len(seen)) + 2
            t = np.ones(len(here) + len(own) + 1, np.int64)
            label = np.full(len(t), LAST)
            put = np.arange(len(here)) + np.repeat(np.arange(len(own)), length[own])
            t[put], label[put], t[-1] = code + 2, np.repeat(low[own], length[own]), 0
            fm = FMIndex(t, label)
            at = np.repeat(start[near], count[near]) + np.arange(count[near].sum()) - np.repeat(np.cumsum(count[near]) - count[near], count[near])
            of = np.repeat(near, count[near])
            a, b = fm.search(to[text], at, k, (of >= own[0]) & (of <= own[-1]))
            hit = np.flatnonzero(b > a)
            yield of, at - start[of], hit, fm.least(a[hit], b[hit])

    def best(bodies: list[bytes], anchor: np.ndarray, low: np.ndarray, times: np.ndarray):
        windows = np.array([len(b.split()) for b in bodies]) - k + 1
        out, start = np.repeat(low, windows), np.cumsum(windows) - windows
        for of, place, hit, least in index(bodies, anchor, low, times):
            at = start[of[hit]] + place[hit]
            out[at] = np.minimum(out[at], least)
        yield slice(0, len(bodies)), out

    return best


def alone(low: np.ndarray, times: np.ndarray) -> np.ndarray:
    return low


def _kept(batches):
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = text.as_py().encode().split()
            gone = covered(len(words), spans.as_py())
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def spans_to_remove(docs: DataFrame, spec: Windows = WINDOWS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs: rows of keyed()."""
    passed = filters(docs, spec)
    found = indexed(segments(docs, spec, passed), index_words(spec.k, shard_words), alone)
    return marked(docs, spec, passed, found)


def op6_substring_dedup(docs: DataFrame, spec: Windows = WINDOWS, shard_words: int = SHARD_WORDS) -> DataFrame:
    docs = keyed(docs)
    return removed(docs, spans_to_remove(docs, spec, shard_words), _kept, SCHEMA)
