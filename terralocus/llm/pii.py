"""Personal data in texts, plain and disguised, with spans of the source text.

Plain finds (email, ip, card, phone) are made on the text as it stands. Then
transducers rewrite the text and keep, for every piece they write, which source
characters it stands for: look-alikes become ASCII (one character for one),
invisible characters go, spelled digits become digits, `plus` before digits
becomes `+`, bracketed or spelled `at` and `dot` become `@` and `.`. The same
finders run on the rewritten text; a find that holds anything rewritten and
does not lie inside a plain find of its kind is mapped back to source characters
and added. Plain finds are never changed.

A spelled `at` without brackets counts only where a name with a spelled `dot`
follows, so prose ("at once", "at example.com") stays as it is. All finders take
time in proportion to the text, also for runs of digits or of address characters.

Defined results: a null text is the empty text and has no spans; finds that
fail their test (parts of an ip, digits of a card or phone) are dropped and their
characters not tried again; spans count code points, the end is exclusive;
repeated rows are judged each. Texts are judged whole, however long; other
columns of any name stay inside `row`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import whole_text

# The kinds in their order among spans of one start.
KINDS = ("email", "ip", "card", "phone")
PART_MOST = 255
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

# What an address has behind the name; the name is what stands before it.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like these.
LOOK_ALIKES = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
    " ": " ", " ": " ", " ": " ",
})
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_AT, _DOT = "(?:at|arroba|arobase)", "(?:dot|punto|punkt|point)"
_OPEN, _SHUT, _GAP = r"[\[({<]", r"[\])}>]", "[ \t]{1,3}"
_LABEL = "[a-z0-9-]{1,63}"
_ENDED = "(?![a-z0-9_])"
_BRACKETED_DOT = rf"{_OPEN}[ \t]{{0,3}}(?:{_DOT}|\.)[ \t]{{0,3}}{_SHUT}[ \t]{{0,3}}"
# On lower-case text: where a disguise may begin (words with the character before them), and what it is then.
_TRIGGER = re.compile(rf"[{INVISIBLE}]|{_OPEN}(?=[ \t]{{0,3}}(?:{_AT}|{_DOT}|@|\.))|[^a-z0-9_](?:{_WORD}|plus|{_AT}|{_DOT}){_ENDED}")
_REWRITE = re.compile(
    rf"(?P<hidden>[{INVISIBLE}]+)"
    rf"|(?P<at>{_OPEN}[ \t]{{0,3}}(?:{_AT}|@)[ \t]{{0,3}}{_SHUT}[ \t]{{0,3}}"
    rf"|{_AT}{_GAP}(?={_LABEL}(?:\.{_LABEL}){{0,8}}(?:{_GAP}{_DOT}{_GAP}|[ \t]{{0,3}}{_BRACKETED_DOT})[a-z0-9]))"
    rf"|(?P<dot>{_BRACKETED_DOT}|{_DOT}{_GAP}(?=[a-z0-9]))"
    rf"|(?P<digits>{_WORD}(?:[ -]{_WORD}){{0,63}}{_ENDED})"
    rf"|(?P<plus>plus ?(?=[0-9]|{_WORD}{_ENDED}))")
_ONE_WORD = re.compile(_WORD)
# Beyond these characters a text may have look-alikes.
_ODD = re.compile("[^\x00-\x7f\xc0-\xff\xa1\xab\xbb\xbf]")


class _Alike(dict):
    """Any code point to its lower-case ASCII look-alike, learned as met: the table, digits of all scripts, compatibility forms."""

    def __missing__(self, point: int) -> int:
        char = chr(point)
        number = unicodedata.decimal(char, None)
        plain = LOOK_ALIKES.get(point) or (str(number) if number is not None else unicodedata.normalize("NFKC", char))
        plain = plain if len(plain) == 1 and plain.isascii() else char
        self[point] = out = ord(plain.lower()) if len(plain.lower()) == 1 else point
        return out


_ALIKE = _Alike()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str):
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _NAME_CHARS:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= PART_MOST for p in m.group().split(".")):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() < CARD_DIGITS[0]:
            continue
        digits = _NOT_DIGIT.sub("", m.group())
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(_NOT_DIGIT.sub("", m.group())) <= PHONE_DIGITS[1]:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def finds(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text as it stands, by start, then kind."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    for kind in KINDS[1:]:
        out += [(kind, *s) for s in FINDERS[kind](text)]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Rewritten:
    """A text without disguises, and the way back to the source."""

    def __init__(self, text: str):
        self.source = text
        # one character for one, lower-case
        self.alike = text.translate(_ALIKE) if _ODD.search(text) else text.lower()
        pieces, self.starts, self.sources, self.changed = [], [], [], []
        self.length = 0

        def put(piece: str, start: int, end: int, changed: bool) -> None:
            if piece:
                self.starts.append(self.length)
                self.sources.append((start, end))
                self.changed.append(changed)
                pieces.append(piece)
                self.length += len(piece)

        at = 0
        for start, end, kind in self._disguises():
            put(self.alike[at:start], at, start, False)
            at = end
            if kind == "digits":
                for word in _ONE_WORD.finditer(self.alike, start, end):
                    put(DIGIT_WORDS[word.group()], *word.span(), True)
            elif kind != "hidden":
                put({"at": "@", "dot": ".", "plus": "+"}[kind], start, end, True)
        self.same = at == 0 and self.alike == text.lower()
        put(self.alike[at:], at, len(text), False)
        self.text = "".join(pieces)

    def _disguises(self):
        """(start, end, kind) of what is to be rewritten, from left to right."""
        text, done = self.alike, 0
        for t in chain((None,), _TRIGGER.finditer(text)):
            at = 0 if t is None else t.start() + (t.end() - t.start() > 1)
            m = _REWRITE.match(text, at) if at >= done else None
            if m is None:
                continue
            start = at
            if m.lastgroup in ("at", "dot"):
                while start > max(done, at - 3) and text[start - 1] in " \t":
                    start -= 1
                # without brackets it stands between words
                if text[at].isalpha() and not (0 < start < at and text[start - 1] in _NAME_CHARS):
                    continue
            done = m.end()
            yield start, done, m.lastgroup

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source characters of a span, and whether anything in it was rewritten."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, b = self.sources[first][0], self.sources[last][1]
        if not self.changed[first]:
            a += start - self.starts[first]
        if not self.changed[last]:
            b = self.sources[last][0] + end - self.starts[last]
        return a, b, first != last or self.changed[first] or not self.source[a:b].isascii()


def disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further (kind, start, end) that only the rewritten text shows."""
    new = Rewritten(text)
    if new.same:
        return []
    held = {k: [(s, e) for kind, s, e in plain if kind == k] for k in KINDS}
    starts = {k: [s for s, _ in held[k]] for k in KINDS}
    out = []
    for kind, start, end in finds(new.text):
        a, b, changed = new.back(start, end)
        near = bisect_right(starts[kind], a) - 1  # plain finds of a kind do not overlap
        if changed and not (near >= 0 and held[kind][near][1] >= b):
            out.append((kind, a, b))
    return out


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` (all columns as a struct) and `spans`: array of (kind, start, end, added), by start, then kind."""
    packed = docs.select(F.struct("*").alias("row"), whole_text(text).alias("work"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))
    spans = F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("added")))

    def run(batches):
        for batch in batches:
            lists = []
            for t in batch.column(1):
                t = t.as_py()
                plain = finds(t)
                more = set(disguised(t, plain))
                lists.append([{"kind": k, "start": s, "end": e, "added": (k, s, e) in more} for k, s, e in in_order([*plain, *more])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], ["row", "spans"])

    return packed.mapInArrow(run, packed.select("row", spans.alias("spans")).schema)


def redacted(docs: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with each span of `text` replaced by its kind; overlapping spans by that of the first. Nulls stay."""
    rows = found(docs, text)

    def step(state, span):
        own = F.struct(F.concat(state["out"], F.substring(F.col("_text"), state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0))),
                                F.when(span["start"] >= state["at"], F.replace(F.lit(mark), F.lit("{}"), span["kind"])).otherwise(F.lit(""))).alias("out"),
                       F.greatest(state["at"], span["end"]).alias("at"))
        return own

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("spans", first, step)
    new = F.concat(done["out"], F.substring(F.col("_text"), done["at"] + 1, F.length("_text")))
    return rows.withColumn("_text", F.col("row")[text]).withColumn("_new", new).select(F.col("row").withField(text, F.col("_new")).alias("row")).select("row.*")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of plain finds of each kind, their digest, all spans, and how many were added."""
    rows = found(docs.select(doc_id, text), text)
    plain = F.filter("spans", lambda s: ~s["added"])
    told = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: ~s["added"] & (s["kind"] == k))).cast("bigint")
    return rows.select(F.col("row")[doc_id].alias(doc_id), *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(told(plain).cast("binary"), 256).alias("base_sha256"),
                       told(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("bigint").alias("n_added"))
