"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of numpy arrays.

A chunk of texts is cut into pre-tokens by the classes of its code points, all at once. Each distinct pre-token that the worker has not
met before is a row of a ragged array of symbols; a round finds each row's pair of lowest rank and applies all its places at once,
and what symbols survive are counted. As a merge's parts are always made by earlier merges (checked when the vocabulary is read), a
round's new pairs rank above it, so this equals merging one pair at a time. Rows of more than ``LONG`` bytes keep their places by rank
instead of looking at each symbol in each round, so that one endless word costs about n log n.

The class of a code point (letter, number, white space, other) is asked of the vocabulary's own pre-tokeniser when it is first met.
A pre-token's 64-bit hash stands for it within one worker (of a kept set of at most ``KNOWN``).

Texts of more than ``A.CHUNK_BYTES`` are cut at single spaces between printable ASCII characters, where a pre-token always begins, so memory
doesn't grow with the text; only a text without such a place is one piece.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows, and rows without doc_id, stay; an empty table gives an
empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .session import importable, tidied

TOKEN_LIMIT = 1024
LONG = 256
KNOWN = 1 << 20
LETTER, NUMBER, SPACE, OTHER, UNMET = range(5)
NEVER = np.int32(1 << 30)
SAFE_CUT = re.compile(rb"[!-~] (?=[!-~])")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """The merges of a tokenizers file as arrays. A file of another kind than plain byte-level BPE is an error."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        whole = json.loads(self.tokenizer.to_str())
        model, before = whole["model"], whole["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or whole["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        added = whole["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take the space beside them")
        self.added = [t["content"].encode() for t in added]
        #: The longest of the strings that begin at a place wins, as in the library.
        self.apart = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        ids = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.byte = np.array([ids[sign[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in part], np.int64) for part in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        born = np.full(max(ids.values()) + 1, NEVER, np.int64)
        born[self.byte] = -1
        born[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path} has merges of parts that are made later")
        key = left << 32 | right
        self.rank = np.argsort(key).astype(np.int32)
        self.key, self.made = key[self.rank], made
        self.kind = np.full(0x110000, UNMET, np.uint8)
        self.kind[0x20] = SPACE
        self.forget()

    def forget(self) -> None:
        """An added token, set apart before the others are looked for, counts as one."""
        raw = np.frombuffer(b"".join(self.added), np.uint8)
        ends = np.cumsum([len(t) for t in self.added], dtype=np.int64)
        keys = A.hashes(raw, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if self.added else np.zeros(0, A.U)
        self.known = np.sort(keys)
        self.counted = np.ones(len(keys), np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NEVER)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """A letter joins a letter before it, a number a number, and of the rest what is no white space joins a mark after it."""
        found = self.kind[points]
        if (found == UNMET).any():
            new = np.unique(points[found == UNMET])
            starts = np.zeros(6 * len(new) + 1, bool)
            for _, (at, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}!1{chr(c)}\n" for c in new.tolist())):
                starts[at] = True
            cell = starts[:-1].reshape(-1, 6)
            self.kind[new] = np.select([~cell[:, 1], ~cell[:, 4], ~cell[:, 2]], [LETTER, NUMBER, OTHER], SPACE)
            found = self.kind[points]
        return found

    def pre_tokens(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The byte at which each pre-token of a chunk of texts begins; together they cover it."""
        begins = np.flatnonzero(~A.CONTINUATION[buf])
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
        n = len(points)
        if not n:
            return begins
        new = np.zeros(n + 3, bool)  # the last three stand for what isn't there
        new[np.searchsorted(begins, off[:-1])] = True
        new[n:] = True
        special = []
        if self.apart is not None:
            raw = buf.tobytes()
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) if self.apart.search(raw) else ():
                special += [np.searchsorted(begins, m.span()) for m in self.apart.finditer(raw, i, j)]
            for low, high in special:
                new[[low, high]] = True
        kind = self.kinds(points)
        start = new.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        space = np.append(kind == SPACE, [False] * 3)
        points = np.append(points, np.zeros(3, np.uint32))
        # of several white spaces before something else the last one is set apart, and a plain space goes with what follows
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~new[1:])
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        mark = np.flatnonzero((points == 0x27) & start)
        mark = mark[~new[mark + 1]]
        one, two = points[mark + 1], np.where(new[mark + 2], 0, points[mark + 2])
        short = mark[np.isin(one, [ord(c) for c in "stmd"])]
        longer = mark[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
        start[short + 1] = False
        start[short + 2] = True
        start[longer + 1] = start[longer + 2] = False
        start[longer + 3] = True
        for low, high in special:
            start[low + 1 : high] = False
            start[[low, high]] = True
        return begins[start[:n]]

    def counts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text of a chunk."""
        first = self.pre_tokens(buf, off)
        end = np.append(first[1:], len(buf))
        key, at, back = np.unique(A.hashes(buf, first, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, key)
        met = self.known[np.minimum(place, len(self.known) - 1)] == key if len(self.known) else np.zeros(len(key), bool)
        count = np.zeros(len(key), np.int64)
        count[met] = self.counted[place[met]]
        new = np.flatnonzero(~met)
        if len(new):
            count[new] = self.survivors(buf, first[at[new]], end[at[new]])
            if len(self.known) + len(new) > KNOWN:
                self.forget()
                place = np.searchsorted(self.known, key)
            self.known, self.counted = np.insert(self.known, place[new], key[new]), np.insert(self.counted, place[new], count[new])
        return A.per_row(count[back], np.searchsorted(first, off))

    def survivors(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """For each span of bytes how many symbols are left when no pair can be merged."""
        size = e - s
        out = size.copy()
        for x in np.flatnonzero(size > LONG).tolist():
            out[x] = self.survivors_of_long(self.byte[buf[s[x] : e[x]]])
        row = np.flatnonzero((size > 1) & (size <= LONG))
        owner = np.repeat(row, size[row])
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(size[row]) - size[row], size[row])
        symbol = self.byte[buf[s[owner] + inner]]
        while len(symbol):
            rank = np.full(len(symbol), NEVER, np.int32)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.ranks(symbol[:-1], symbol[1:]), NEVER)
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            long = np.diff(np.append(begin, len(owner)))
            least = np.repeat(np.minimum.reduceat(rank, begin), long)
            live = least < NEVER
            out[owner[begin]] = long
            at = np.flatnonzero((rank == least) & live)
            at = alternate(at, at[1:] == at[:-1] + 1)
            symbol[at] = self.made[rank[at]]
            live[at + 1] = False
            symbol, owner = symbol[live], owner[live]
        return out

    def survivors_of_long(self, symbol: np.ndarray) -> int:
        """The same for one long row: places wait in a list of their pair's rank, and a round takes the lowest rank's."""
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def wait(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank < NEVER], rank[rank < NEVER]
            sort = np.argsort(rank, kind="stable")
            at, rank = at[sort], rank[sort]
            cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
            for r, part in zip(rank[cut].tolist(), np.split(at, cut[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        wait(np.arange(n - 1))
        while order:
            lowest = heapq.heappop(order)
            at = np.unique(np.concatenate(waiting.pop(lowest)))
            at = at[alive[at] & (after[at] < n)]
            at = at[self.ranks(symbol[at], symbol[after[at]]) == lowest]
            at = alternate(at, after[at[:-1]] == at[1:])
            gone = after[at]
            symbol[at] = self.made[lowest]
            alive[gone] = False
            after[at] = after[gone]
            inside = at[after[at] < n]
            before[after[inside]] = inside
            near = np.concatenate([before[at][before[at] >= 0], inside])
            wait(np.unique(near))
        return int(alive[:n].sum())


def alternate(at: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Of places in order, where joined says that the next one overlaps a place, every other one of each run, the first included."""
    number = np.arange(len(at))
    begins = np.append(True, ~joined)[: len(at)]
    return at[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0]


def cut(text: bytes, limit: int) -> list[bytes]:
    """A long text in parts that hold the same pre-tokens."""
    out, at = [], 0
    while len(text) - at > limit:
        found = SAFE_CUT.search(text, at + limit)
        if not found:
            break
        out.append(text[at : found.start() + 1])
        at = found.start() + 1
    return [*out, text[at:]] if at else [text]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def token_numbers(column: pa.Array, vocabulary: Vocabulary, limit: int = A.CHUNK_BYTES) -> np.ndarray:
    """Tokens of each text of a column."""
    out = np.zeros(len(column), np.int64)
    for i, j, buf, off in A.chunks(column, limit):
        if j == i + 1 and len(buf) > limit:
            for part in cut(buf.tobytes(), limit):
                out[i] += vocabulary.counts(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0]
        elif len(buf):
            out[i:j] = vocabulary.counts(buf, off)
    return out


def token_counts(docs: DataFrame, vocabulary: str | None = None, token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than token_limit tokens) of each row of docs (doc_id, text)."""
    importable(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        words = vocabulary_of(path)
        for batch in batches:
            text = batch.column("text")
            _, off = A.buffer(text)
            tokens = token_numbers(text, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > token_limit)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)


def op13_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
