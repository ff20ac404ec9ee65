"""Sum-of-squares packing of token sequences.

A document's ids are cut only where it is longer than a sequence: its first piece takes the remainder, the others fill a
sequence each. First pieces are packed online: N(g) open sequences have g free places; a piece goes where the sum of the squared
N(g) becomes smallest, that is to the open gap (or a new sequence) that minimises N(gap - length) - N(gap). Longer pieces come first. Pieces
that fill a sequence are one; the others, at most one of each document, are packed in chunks of about ``CHUNK``, so nothing grows with
the corpus but the number of chunks. Ids are made once and their digests and lengths written.

Tokenising caches the ids of space-separated words: where a single space stands between two other characters that are
no white space, the pre-tokeniser of the vocabulary always begins a word with that space. Of a word that isn't cached, what its
line ends and closing marks set apart is made by itself, because the pre-tokeniser parts it there too; Latin letters are merged by
``merging``, all else goes through the tokenizer.

Defined results: a null or empty text is one piece with the closing id 0 alone; repeated rows are documents of their own; null
doc_ids stay; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import importable, stored, tidied

SEQUENCE = 2048
CHUNK = 50_000
CACHED_WORDS, CACHED_LENGTH = 250_000, 64  # of each of two generations, some 40 MB for each
SAFE = re.compile(r"(?<=\S) (?=\S)")
UNSAFE = re.compile(r"[^\S ](?:(?<= .)| )", re.DOTALL)  # another white space beside a space; two spaces are looked for before it
SINGLE = re.compile(r"\S+(?:\n\S+)+")
MARKS, LATIN = ".,;:!?", "\u024f"
CLOSING = b"\0\0\0\0"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words(dict):
    """The ids of words after a space, made when first asked for; the last two generations are kept. Single line ends between
    characters that are no white space, and marks that close a word, are made by themselves."""

    def __init__(self, encode, letters):
        self.encode, self.letters, self.old, self.bare, self.newline = encode, letters, {}, {}, encode("\n")

    def __missing__(self, w: str) -> bytes:
        got = self.old.get(w)
        if got is None:
            if "\n" in w and SINGLE.fullmatch(w):
                first, *rest = w.split("\n")
                return self[first] + b"".join([self.newline + self.part("", x) for x in rest])
            got = self.part(" ", w)
        if len(w) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[w] = got
        return got

    def part(self, before: str, w: str) -> bytes:
        """Letters are one word of the pre-tokeniser, and so are the marks after them; all else is left to it."""
        head = w.rstrip(MARKS)
        if head.isalpha() and max(head) <= LATIN:
            got = self.letters(before + head)
            return got if len(head) == len(w) else got + self.closing(w[len(head) :])
        return self.encode(before + w)

    def closing(self, marks: str) -> bytes:
        got = self.bare.get(marks)
        if got is None:
            got = self.encode(marks)
            if len(marks) <= 4:
                self.bare[marks] = got
        return got


def merging(tokenizer):
    """The ids of one pre-tokenised word's bytes, by a leaner merge loop than the tokenizer's own, or None where the two could differ.

    That loop merges the pair whose joint token has the lowest id. It equals the vocabulary's merges if ids rise with the order of the
    merges and each token's own bytes merge to it: a token has then just one pair of parts that merging can reach."""
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    ids = model["vocab"]
    order = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    ranks = {}
    for token, number in ids.items():
        if token in added:
            continue
        own = tokenizer.model.tokenize(token)
        if len(own) != 1 or own[0].id != number or any(c not in byte for c in token):
            return None
        ranks[bytes(byte[c] for c in token)] = number
    lowest = [ids[c] for c in byte if c in ids]
    if any(a >= b for a, b in zip(order, order[1:], strict=False)) or len(lowest) < 256 or (order and max(lowest) >= order[0]) or len(ranks) != 256 + len(order):
        return None
    return tiktoken.Encoding("merging", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """ids of a text as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()

        def raw(text: str) -> bytes:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            return pack_ids[len(ids)](*ids) if len(ids) < len(pack_ids) else np.array(ids, "<u4").tobytes()

        pack_ids = [struct.Struct(f"<{n}I").pack for n in range(64)]
        merge = merging(tokenizer)

        def letters(word: str) -> bytes:
            ids = merge(word.encode())
            return pack_ids[len(ids)](*ids) if len(ids) < len(pack_ids) else np.array(ids, "<u4").tobytes()

        self.raw, self.words = raw, Words(raw, letters if merge else raw)

    def __call__(self, text: str) -> bytes:
        # almost all texts have safe spaces only, which a plain split finds
        plain = not text.startswith(" ") and not text.endswith(" ") and "  " not in text and UNSAFE.search(text) is None
        first, *rest = text.split(" ") if plain else SAFE.split(text)
        return self.raw(first) + b"".join(map(self.words.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    importable(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = (encode(t) if (t := text.as_py()) else b"") + CLOSING
                n, start = len(ids) // 4, 0
                length = n % sequence or sequence
                doc, number = doc_id.as_py(), 0
                while start < n:
                    out.append((doc, number, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length, number = start + length, sequence, number + 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), schema)


def place(lengths: list[int], sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, by sum of squares; a full length has a sequence of its own."""
    count = np.zeros(sequence + 1, np.int64)  # of open sequences by gap; a new one has the gap ``sequence``, and 0 is closed
    open_by_gap: list[list[int]] = [[] for _ in range(sequence + 1)]
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for at, size in enumerate(lengths):
        if size < sequence:
            after = count[: sequence - size + 1]
            # the change of the sum of squares, halved: N(gap - size) - N(gap) + 1; closing a sequence has no new gap
            change = after - count[size:] + 1
            change[0] = -count[size]
            usable = count[size:] > 0
            usable[-1] = True
            change[-1] = after[-1] + (0 if size else 1)
            best = int(np.where(usable, change, 1 << 40).argmin()) + size
        else:
            best = sequence
        if best < sequence:
            number[at] = open_by_gap[best].pop()
            count[best] -= 1
        else:
            number[at], made = made, made + 1
        offset[at] = sequence - best
        gap = best - size
        if gap:
            count[gap] += 1
            open_by_gap[gap].append(int(number[at]))
    return number, offset


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, chunk: int = CHUNK) -> DataFrame:
    cut = stored(pieces(docs, vocabulary or default_vocabulary(), sequence))  # some 50 bytes for each piece
    full = F.col("length") == sequence
    groups = max(1, -(-cut.where(~full).count() // chunk))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # by number, so that rows that repeat are not one chunk
    dealt = cut.withColumn("number", F.monotonically_increasing_id())
    rest = dealt.where(~full).withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        base = rows["chunk"][0].as_py() << 32
        rows = rows.sort_by([("length", "descending"), ("number", "ascending")])
        number, offset = place(rows["length"].to_pylist(), sequence)
        return rows.drop_columns(["number", "chunk"]).append_column("sequence_id", pa.array(number + base)).append_column("offset", pa.array(offset))

    alone = dealt.where(full).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.groupBy("chunk").applyInArrow(tidied(run), schema).unionByName(alone)


def op9_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
