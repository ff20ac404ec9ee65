"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits, plus signs before digits, and identifier cues.
Each anchor is expanded to both sides by a deterministic local parser that validates what it reads: email addresses, IP
addresses, card numbers (Luhn), telephone numbers, IBANs (mod 97), account numbers after a cue, and user names and passwords
in addresses of a scheme. Spans of a kind never overlap. Digits that run on beyond what a card or a telephone number can be are no base
span; in them the parser looks for the boundaries of whole groups that make a card number, which is an account then, and for a
telephone number that ends before it (dial).

Defined results: a null or empty text has no spans; null doc_ids stay; repeated rows get equal results; an empty table gives
an empty result; offsets are code points. Other columns are not read by the query and pass through ``masked`` unchanged.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import importable, tidied

KINDS = ("email", "ip", "card", "phone", "iban", "account", "login", "dial")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://")
CUES = ("iban", "IBAN", "account", "Account", "ACCOUNT", "konto", "Konto", "compte", "Compte", "cuenta", "Cuenta")
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
LABEL = frozenset(LETTERS + DIGITS + "-")
DIGIT = frozenset(DIGITS)
DIAL = frozenset(" ().-" + DIGITS)
PLAIN = str.maketrans("", "", " -")

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        x = int(d) << (at & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    end, n, labels = at + 1, len(t), 0
    while end < n and t[end] in LABEL:
        end += 1
    if start == at or end == at + 1:
        return None
    while end + 1 < n and t[end] == "." and t[end + 1] in LABEL:
        labels, end = labels + 1, end + 2
        while end < n and t[end] in LABEL:
            end += 1
    return (start, end) if labels else None


def address_at(t: str, start: int) -> tuple[int, bool]:
    """From the first digit of a number: the end of up to four dotted numbers, and whether they are an address."""
    end, n, parts = start, len(t), []
    while True:
        first = end
        while end < n and t[end] in DIGIT:
            end += 1
        parts.append(t[first:end])
        if len(parts) == 4 or end + 1 >= n or t[end] != "." or t[end + 1] not in DIGIT:
            break
        end += 1
    return end, len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def account_end(t: str, start: int) -> int:
    """End of the digits from start that stand together or one space or hyphen apart."""
    end, n = start + 1, len(t)
    while end < n:
        if t[end] in DIGIT:
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in DIGIT:
            end += 2
        else:
            break
    return end


def phone_at(t: str, at: int) -> tuple[int, int] | None:
    """From a plus sign before a digit; the bounds of what the shape takes, or None where it takes nothing."""
    end, n = at + 2, len(t)
    while end < n and t[end] in DIAL:
        end += 1
    while end > at + 3 and t[end - 1] not in DIGIT:
        end -= 1
    return (at, end) if end > at + 3 else None


CARD = re.compile(r"(?:3[47]|4|5[1-5]|2[2-7]|6)[0-9]+")
LAYOUTS = ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3))


def accounts_inside(t: str, start: int, end: int) -> list[tuple[int, int]]:
    """Card numbers of whole groups in the digits [start, end), which are no card number as a whole; leftmost, not overlapping."""
    groups = [m.span() for m in re.compile("[0-9]+").finditer(t, start, end)]
    out, at = [], 0
    while at < len(groups):
        step = 1
        for n in (1, 3, 4, 5):
            some = groups[at : at + n]
            if len(some) == n < len(groups) and (n == 1 or tuple(b - a for a, b in some) in LAYOUTS):
                code = t[some[0][0] : some[-1][1]].translate(PLAIN)
                if 13 <= len(code) <= 19 and CARD.fullmatch(code) and luhn(code):
                    out.append((some[0][0], some[-1][1]))
                    step = n
                    break
        at += step
    return out


def dial_before(t: str, at: int, end: int) -> tuple[int, int] | None:
    """The telephone number from the plus sign at ``at`` up to the first account in what its shape takes."""
    inside = accounts_inside(t, at + 1, account_end(t, at + 1))
    if not inside or inside[0][0] > end:
        return None
    stop = at + len(t[at : inside[0][0]].rstrip(" ().-"))
    return (at, stop) if 9 <= sum(c in DIGIT for c in t[at:stop]) <= 15 else None


def iban_at(t: str, at: int) -> tuple[int, int] | None:
    got = re.compile(r"[\s:#.]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})").match(t, at)
    if not got:
        return None
    for end in range(got.end(1), got.start(1) + 14, -1):
        code = t[got.start(1) : end].replace(" ", "")
        if t[end - 1] != " " and 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return got.start(1), end
    return None


def account_after(t: str, at: int) -> tuple[int, int] | None:
    got = re.compile(r"(?:[ ]?(?:no|nr|number|num)\b)?[ .:#=]{1,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])").match(t, at)
    return (got.start(1), got.end(1)) if got else None


def login_after(t: str, at: int) -> tuple[int, int] | None:
    got = re.compile(r"[^\s/:@]+:[^\s/@]+(?=@)").match(t, at)
    return (got.start(), got.end()) if got else None


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("plus", 2))
    found.add_word("@", ("at", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def scan(t: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not t:
        return out
    mail = number = chain = dial = 0  # where the next match of a kind can begin
    for end, (kind, length) in anchors.iter(t):
        if kind == "digit":
            if end >= number:
                number, ok = address_at(t, end)
                if ok:
                    out["ip"].append((end, number))
            if end >= chain:
                chain = account_end(t, end)
                if chain - end >= 13 and 13 <= len(code := t[end:chain].translate(PLAIN)):
                    if len(code) <= 19 and luhn(code):
                        out["card"].append((end, chain))
                    else:
                        out["account"] += accounts_inside(t, end, chain)
        elif kind == "at":
            if end >= mail and (got := email_at(t, end, mail)):
                out["email"].append(got)
                mail = got[1]
        elif kind == "plus":
            if end - 1 >= dial and (got := phone_at(t, end - 1)):
                dial = got[1]
                if 9 <= sum(c in DIGIT for c in t[got[0] : dial]) <= 15:
                    out["phone"].append(got)
                elif number_of := dial_before(t, *got):
                    out["dial"].append(number_of)
        elif kind == "scheme":
            if got := login_after(t, end + 1):
                out["login"].append(got)
        else:
            word = t[end + 1 - length : end + 1].lower()
            got = iban_at(t, end + 1) if word == "iban" else account_after(t, end + 1)
            if got and (word == "iban" or not any(a < got[1] and got[0] < b for a, b in out["account"])):
                out["iban" if word == "iban" else "account"].append(got)
    if len(out["account"]) > 1:
        out["account"] = apart(out["account"])
    return out


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order, without those that overlap one before."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def joined(spans: dict, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def found(docs: DataFrame) -> DataFrame:
    importable(docs.sparkSession)

    def run(batches):
        anchors = automaton()
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                spans = scan(t.as_py() or "", anchors)
                rows.append((*(len(spans[k]) for k in BASE), hashlib.sha256(joined(spans, BASE).encode()).hexdigest(), joined(spans, KINDS), sum(map(len, spans.values()))))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), SCHEMA)


def mask(t: str, spans: dict) -> str:
    """t with every span, or union of spans that overlap, replaced by the kind of its first."""
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= done:
            out += [t[done:a], f"<{k}>"]
        done = max(done, b)
    return "".join([*out, t[done:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with masked texts, and n_chars to match where there is such a column."""
    importable(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def run(batches):
        anchors = automaton()
        for batch in batches:
            texts = [t if not t else mask(t, scan(t, anchors)) for t in batch.column(names.index("text")).to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, batch.schema.field(names.index("text")).type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([old if t is None else len(t) for t, old in zip(texts, columns[at].to_pylist(), strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidied(run), schema)


def op3_personal_data(docs: DataFrame) -> DataFrame:
    return found(docs)
