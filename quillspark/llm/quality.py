"""Quality rules: a base of counted rules, and hashed n-gram logistic regression with calibrated probabilities.

The model has three hashed families (words, word pairs, byte trigrams), each as shares of a text. It is fitted on the
driver on at most ``sample`` labelled documents, those with the smallest hash of doc_id; a fifth of them calibrates the
probability. Everything else runs in Arrow batches over whole texts.

Defined results: a null or empty text has no words and fails the base; null doc_ids stay as they are; repeated rows each
get the same result; without labels of both classes every text that passes the base is kept; an empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .linear import fit_logistic, fit_platt, sigmoid
from .session import importable, tidied

BUCKETS = 1 << 12
FAMILIES = 3
SAMPLE = 2000
THRESHOLD = 0.25  # on the probability of quality: clean texts stay in doubt
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def features(buf: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, off: np.ndarray, hashes: np.ndarray):
    """For each family: the bucket of each of its grams, and each document's first gram (one more entry)."""
    n = len(buf)
    last = np.zeros(len(s), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    pair = A.mix(hashes[:-1] + A.mix(hashes[1:] ^ A.STEP)) if len(s) > 1 else np.zeros(0, A.U)
    pair_ok = ~last[:-1]
    code = A.LOWER[np.where(A.SPACE[buf], 32, buf)].astype(np.uint32)
    three = (code[:-2] << 16 | code[1:-1] << 8 | code[2:]) * np.uint32(2654435761) if n > 2 else np.zeros(0, np.uint32)
    keep = np.ones(len(three), bool)
    for end in off[1:-1]:
        keep[max(0, end - 2) : end] = False
    pair_at, three_at = np.concatenate([[0], np.cumsum(pair_ok)]), np.concatenate([[0], np.cumsum(keep)])
    shift = 64 - 12
    return (
        ((hashes >> A.U(shift)).astype(np.int32), first),
        ((pair[pair_ok] >> A.U(shift)).astype(np.int32), pair_at[np.minimum(first, len(pair_ok))]),
        ((three[keep] >> np.uint32(32 - 12)).astype(np.int32), three_at[np.minimum(off, len(keep))]),
    )


def repeated_words(text: bytes, window: int = REPEAT_WINDOW) -> int:
    """Words in windows found twice or more in the text; exact."""
    w = text.split()
    seen = Counter(zip(*(w[i:] for i in range(window))))
    reach = count = 0
    for i in range(len(w) - window + 1):
        if seen[tuple(w[i : i + window])] > 1:
            count += i + window - max(i, reach)
            reach = i + window
    return count


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def base_columns(buf: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    lead = np.concatenate([[0], np.cumsum(~(A.CONTINUATION[buf] | A.SPACE[buf]))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[buf])])
    out = {"n_words": np.diff(first), "word_chars": lead[off[1:]] - lead[off[:-1]], "n_symbols": symbols[off[1:]] - symbols[off[:-1]]}
    lines, repeats = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    windows = A.grams(hashes, REPEAT_WINDOW)
    if len(windows):
        own = doc[: len(windows)]
        inside = own == doc[REPEAT_WINDOW - 1 :]
        keyed = A.mix(windows[inside] ^ A.mix(own[inside].astype(A.U) * A.STEP))
        order = np.argsort(keyed)
        same = np.flatnonzero(keyed[order][1:] == keyed[order][:-1])
        for d in np.unique(own[inside][order[same]]):  # equal windows have equal hashes; each find is counted on the words
            repeats[d] = repeated_words(buf[off[d] : off[d + 1]].tobytes())
    for d in np.unique(np.searchsorted(off, np.flatnonzero(buf == 10), "right") - 1):
        lines[d] = repeated_lines(buf[off[d] : off[d + 1]].tobytes())
    return out | {"n_dup_lines": lines, "n_repeat_words": repeats}


def analysed(column):
    for i, j, buf, off in A.chunks(column):
        s, e, first = A.words(buf, off)
        yield i, j, buf, off, s, e, first, A.word_hashes(buf, s, e)


def _sampled(batches):
    """Each labelled document as its label, and the shares of its buckets that occur."""
    for batch in batches:
        quality = batch.column("quality").to_numpy(zero_copy_only=False)
        for i, j, buf, off, s, e, first, hashes in analysed(batch.column("text")):
            rows = []
            families = features(buf, s, e, first, off, hashes)
            for d in range(j - i):
                dense = np.zeros(FAMILIES * BUCKETS, np.float32)
                for f, (ids, at) in enumerate(families):
                    if at[d + 1] > at[d]:
                        dense[f * BUCKETS : (f + 1) * BUCKETS] = np.bincount(ids[at[d] : at[d + 1]], minlength=BUCKETS) / (at[d + 1] - at[d])
                found = np.flatnonzero(dense)
                rows.append((int(quality[i + d]), found.astype(np.uint16).tobytes(), dense[found].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["quality", "ids", "shares"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model, or None where the labels have one class at most."""
    importable(docs.sparkSession)
    chosen = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    known = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(chosen), "doc_id")  # sample rows at most
    rows = known.select("quality", "text").mapInArrow(tidied(_sampled), "quality int, ids binary, shares binary").orderBy(F.xxhash64("ids"), "quality").limit(2 * sample).collect()
    y = np.array([r.quality for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    x = np.zeros((len(rows), FAMILIES * BUCKETS), np.float32)
    for at, r in enumerate(rows):
        x[at, np.frombuffer(r.ids, np.uint16)] = np.frombuffer(r.shares, np.float32)
    scale = 1 / np.sqrt((x * x).mean(0) + 1e-7)
    x *= scale / np.sqrt(x.shape[1])
    held = np.arange(len(y)) % 5 == 0
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held = np.zeros(len(y), bool)
    w, b = fit_logistic(x[~held], y[~held], ridge=1e-4)
    test = held if held.any() else ~held
    slope, shift = fit_platt((x[test] @ w + b)[:, 0], y[test])
    weights = (w[:, 0] * scale / np.sqrt(x.shape[1]) * slope).astype(np.float32)
    return {"weights": weights.reshape(FAMILIES, BUCKETS), "bias": float(b[0] * slope + shift)}


def verdicts(column, model: dict | None, threshold: float) -> list[np.ndarray]:
    """The columns of SCHEMA after doc_id, for one Arrow column of texts."""
    found = []
    for i, j, buf, off, s, e, first, hashes in analysed(column):
        out = base_columns(buf, off, s, e, first, hashes)
        p = np.ones(j - i)
        if model:
            total = np.full(j - i, model["bias"])
            for weights, (gram, at) in zip(model["weights"], features(buf, s, e, first, off, hashes), strict=True):
                total += A.per_row(weights[gram], at) / np.maximum(np.diff(at), 1)
            p = sigmoid(total)
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
        found.append((*out.values(), failed, p, ~failed & (p >= threshold)))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def judge(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: the base columns, the calibrated probability of quality, and the verdict."""
    importable(docs.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = verdicts(batch.column("text"), model, threshold)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), SCHEMA)


def filtered(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text is kept."""
    importable(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdicts(batch.column(at), model, threshold)[-1]))

    return docs.mapInArrow(tidied(run), docs.schema)


def op1_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
