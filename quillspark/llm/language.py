"""Language identification by error-correcting output codes.

Every language gets a binary codeword; one logistic classifier of hashed byte trigrams predicts each bit. A text's
margins are decoded to the codeword of the least weighted logistic loss; a bit weighs more the better it did on
calibration rows. A small gap between the best two codewords flags the text as ambiguous.

Learned from text and lang of a bounded sample (``per_language`` rows of each language are aimed at, by the hash of
doc_id) of the rows that the caller passes; lang, source and doc_id are never inputs of a prediction.

Defined results: null, empty or letterless texts are ``und`` with score 0; so are all where no language was learned; with one
language, it is always given. Repeated rows get equal results, null doc_ids stay null and are never learned from; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .linear import fit_logistic, sigmoid
from .session import importable, tidied

BITS = 13  # of a trigram's bucket
PER_LANGUAGE, MAX_ROWS = 500, 8000
AMBIGUOUS = 0.8
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"

#: Bytes as letters for n-grams: ASCII letters in lower case and all bytes of other code points; the rest is a space.
LETTER = np.full(256, 32, np.uint32)
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1: the exhaustive code for up to 7 classes, else the rows of a splitmix rule, 12 log2 k long."""
    if k < 2:
        return np.ones((k, 0), np.float32)
    if k <= 7:
        columns = [[1, *(1 if c >> i & 1 else -1 for i in range(k - 1))] for c in range(2 ** (k - 1) - 1)]
        return np.array(columns, np.float32).T
    n = int(np.ceil(12 * np.log2(k)))
    code = np.where(A.mix(np.arange(1, k * n + 1, dtype=A.U) * A.STEP) >> A.U(63), 1, -1).reshape(k, n).astype(np.float32)
    return code[:, np.abs(code.sum(0)) < k]


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the three bytes from each place, and which lie in one document."""
    code = LETTER[buf]
    if len(code) < 3:
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    ids = ((code[:-2] << 16 | code[1:-1] << 8 | code[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32)
    keep = np.ones(len(ids), bool)
    for end in off[1:-1]:
        keep[max(0, end - 2) : end] = False
    at = np.concatenate([[0], np.cumsum(keep)])
    return ids[keep], at[np.minimum(off, len(ids))]


def _sampled(batches):
    for batch in batches:
        for i, j, buf, off in A.chunks(batch.column("text")):
            ids, at = trigrams(buf, off)
            rows = []
            for d in range(j - i):
                counts = np.bincount(ids[at[d] : at[d + 1]], minlength=1 << BITS)
                found = np.flatnonzero(counts)
                rows.append((found.astype(np.uint16).tobytes(), (counts[found] / max(1, at[d + 1] - at[d])).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "ids", "shares"])


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> dict | None:
    """rows: doc_id, text, lang to learn from."""
    importable(rows.sparkSession)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id is not null and lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    got = chosen.mapInArrow(tidied(_sampled), "lang string, ids binary, shares binary").orderBy(F.xxhash64("ids"), "lang").limit(max_rows).collect()
    langs = sorted({r.lang for r in got})
    code = codewords(len(langs))
    if len(langs) < 2:
        return {"langs": langs, "code": code, "weights": np.zeros((1 << BITS, 0), np.float32), "bias": np.zeros(0), "trust": np.zeros(0)}
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for at, r in enumerate(got):
        x[at, np.frombuffer(r.ids, np.uint16)] = np.frombuffer(r.shares, np.float32)
    label = np.array([langs.index(r.lang) for r in got])
    scale = 1 / np.sqrt((x * x).mean(0) + 1e-7) / np.sqrt(x.shape[1])
    x *= scale
    y = (code[label] > 0).astype(np.float32)
    held = np.arange(len(got)) % 5 == 0
    w, b = fit_logistic(x[~held], y[~held], ridge=1e-4)
    right = ((x[held] @ w + b > 0) == (y[held] > 0)).mean(0) if held.any() else np.ones(code.shape[1])
    trust = np.maximum(np.log((right + 0.01) / (1.01 - right)), 0.05)
    return {"langs": langs, "code": code, "weights": (w * scale[:, None]).astype(np.float32), "bias": b, "trust": trust / trust.sum()}


def decode(margin: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language's number, its share of exp(-loss), and whether the runner-up comes close."""
    loss = np.stack([(np.logaddexp(0, -margin * word) * model["trust"]).sum(1) for word in model["code"]], 1)
    p = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    score = p[np.arange(len(best)), best]
    return best, score, score < AMBIGUOUS


def predict(docs: DataFrame, model: dict | None, ambiguous: float = AMBIGUOUS) -> DataFrame:
    importable(docs.sparkSession)

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            langs, scores, flags = [], [], []
            for i, j, buf, off in A.chunks(batch.column("text"), 1 << 19):
                has = A.per_row((LETTER[buf] != 32).astype(np.int64), off) > 0
                ascii_only = A.per_row((buf > 127).astype(np.int64), off) == 0
                for d in np.flatnonzero(has & ~ascii_only):
                    part = buf[off[d] : off[d + 1]]
                    has[d] = bool(((part | 32) - np.uint8(97) < 26).any()) or bool(letter.search(part.tobytes().decode()))
                if not model:
                    best, score, close = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i, bool)
                    has[:] = False
                elif len(model["langs"]) == 1:
                    best, score, close = np.zeros(j - i, int), np.ones(j - i), np.zeros(j - i, bool)
                else:
                    ids, at = trigrams(buf, off)
                    margin = A.per_row(model["weights"][ids], at) / np.maximum(np.diff(at), 1)[:, None] + model["bias"]
                    best, score, close = decode(margin, model)
                langs += [model["langs"][k] if ok else "und" for k, ok in zip(best, has, strict=True)]
                scores.append(np.where(has, score, 0.0))
                flags.append(np.where(has, score < ambiguous, True))
            if langs:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(flags))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.mapInArrow(tidied(run), SCHEMA)


def op4_language_id(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = fit(docs.where(remainder != 1))
    return predict(docs.select("doc_id", "text", F.coalesce(remainder == 1, F.lit(False)).alias("held_out")), model)
