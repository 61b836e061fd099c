"""Personal data: plain finds against the plain patterns, disguises, spans, long texts."""

import hashlib
import random
import re
import time

import pytest

from terralocus.llm import pii as P
from terralocus.llm.tables import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(t):
    return re.sub("[^0-9]", "", t)


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and P.luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_plain_finds_of_random_texts():
    rng = random.Random(1)
    for n in range(3000):
        text = "".join(rng.choice(["1", "25", "4", ".", "@", "a", "-", " ", "+", "(", "é", "256", "0", "%"]) for _ in range(rng.randrange(60)))
        assert P.finds(text) == plain(text), text


def test_plain_finds_of_the_given_table(spark):
    rows = [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    assert sum(len(P.finds(t)) for t in rows) > 20
    for t in rows:
        assert P.finds(t) == plain(t)
        assert P.disguised(t, P.finds(t)) == []  # clean prose stays as it is


@pytest.mark.parametrize("before,kind,secret", [
    ("write to ", "email", "john (dot) doe [at] example (dot) com"),
    ("écrire à ", "email", "jane at mail4 dot example dot com"),
    ("or ", "email", "JANE { AT } example <DOT> com"),
    ("escriba a ", "email", "juan arroba correo punto es"),
    ("see ", "email", "ｊoe＠ｅxample．com"),
    ("see ", "email", "jоe@exаmple.com"),  # Cyrillic o and a
    ("see ", "email", "j​oe@exa­mple.com"),
    ("call ", "phone", "plus one seven four three five five five three eight two four"),
    ("call ", "phone", "+1 (743) five five five-3824"),
    ("card ", "card", "four three eight one 8935 5774 1609"),
    ("card ", "card", "４381893557741609"),
    ("card ", "card", "4381–8935–5774–1609"),
    ("host ", "ip", "192 dot 168 dot 1 dot 10"),
    ("host ", "ip", "192[.]168(dot)1[.]10"),
    ("host ", "ip", "one nine two dot one six eight dot one dot one"),
])
def test_disguises_map_back_to_the_source(before, kind, secret):
    for text in (before + secret, before + secret + ", thanks", "ab​c " + before + secret + " ünd"):
        spans = P.disguised(text, P.finds(text))
        start = text.index(secret)
        assert (kind, start, start + len(secret)) in spans


@pytest.mark.parametrize("text", ["we met at ten, look at example.com", "at dot", "one two three", "plus one", "a dot on the map", "(at) the (dot)", "", "[at]", "eight", "at"])
def test_prose_stays(text):
    assert P.disguised(text, P.finds(text)) == []


def test_plain_ones_stay_beside_added_ones():
    text = "a@b.com, c [at] d.com, 4381893557741609 and joe [at] a@b.com"
    base = P.finds(text)
    more = P.disguised(text, base)
    assert [text[s:e] for _, s, e in base] == ["a@b.com", "4381893557741609", "a@b.com"]
    assert "c [at] d.com" in [text[s:e] for _, s, e in more]


@pytest.mark.parametrize("unit", ["1", "a", "1 ", "one ", "(", " ", "a@", "1.", "+1", "at dot ", "a at b dot ", "x@y.", "[at]", "​", "one-"])
def test_time_grows_with_length_only(unit):
    text = unit * (400_000 // len(unit))
    start = time.time()
    P.disguised(text, P.finds(text))
    assert time.time() - start < 8


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a@b.com ünd c [at] d.org"), (1, "a@b.com ünd c [at] d.org"), (2, None), (3, ""), (None, "+1 (743) 555-3824"), (4, "x" * 300_000 + " 10.0.0.1")]
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id bigint, text string, work int, kind string, spans int")
    got = P.judged(frame).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[1].spans == "email:0:7,email:12:24" and by[1].base_sha256 == sha("email:0:7") and (by[1].n_email, by[1].n_added) == (1, 1)
    assert by[2].spans == by[3].spans == "" and by[2].base_sha256 == sha("") and by[2].n_card == 0
    assert by[None].n_phone == 1 and by[4].spans == "ip:300001:300009"
    told = {(r.doc_id, r.text) for r in P.redacted(frame).collect()}
    assert {(1, "[email] ünd [email]"), (2, None), (3, ""), (None, "[phone]")} <= told
    assert P.redacted(frame).columns == frame.columns
    assert P.judged(frame.limit(0)).count() == 0 and P.redacted(frame.limit(0)).count() == 0
