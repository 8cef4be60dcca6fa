from __future__ import annotations

import random
import time

import pytest

from siftwell.llm import pii

from .conftest import ODD

AUTO = pii.anchors()


def found(text):
    return [(text[a:b], k) for a, b, k in pii.findings(AUTO, text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to jo.e+x@mail7.example.com.", [("jo.e+x@mail7.example.com", "EMAIL")]), ("ends und.34@mail7.example.com### next", [("und.34@mail7.example.com", "EMAIL")]), ("élan.5@b-c.example.org, ok", [("élan.5@b-c.example.org", "EMAIL")]),
        ("no @ here, a@b, @x.com, a@.com, a.@b.com, a@b.c1", []), ("call +1 (017) 555-7713 now", [("+1 (017) 555-7713", "PHONE")]), ("tel (020) 555-1234.", [("(020) 555-1234", "PHONE")]), ("212-555-1234", [("212-555-1234", "PHONE")]),
        ("ip 97.51.17.173 and 256.1.1.1 and 1.2.3.4.5", [("97.51.17.173", "IP")]), ("card 9807915762804490 end", [("9807915762804490", "ACCOUNT")]), ("4111 1111 1111 1111", [("4111 1111 1111 1111", "ACCOUNT")]), ("4111-1111-1111-1111", [("4111-1111-1111-1111", "ACCOUNT")]),
        ("7536784127813050 4845168114407329", [("7536784127813050", "ACCOUNT"), ("4845168114407329", "ACCOUNT")]), ("12345678901 short, 12345678901234567890 long, x1234567890123", []), ("IBAN DE89 3704 0044 0532 0130 00", [("DE89 3704 0044 0532 0130 00", "IBAN")]), ("GB82WEST12345698765432", [("GB82WEST12345698765432", "IBAN")]),
        ('token = "681c09b8e90e7e8c9575180f595f646cf2969054" the', [("681c09b8e90e7e8c9575180f595f646cf2969054", "SECRET")]), ("password=f8cb0ab732d29a210e and", [("f8cb0ab732d29a210e", "SECRET")]), ("token: short", []), ("https://u:p@host/x y", [("https://u:p@host/x", "URL")]), ("see https://example.com/a?b=1.", []), ("http://10.0.0.1/x", [("http://10.0.0.1/x", "URL")]),
        ("year 2024, 3.14, page 1234-1240", []),
    ],
)
def test_boundaries(text, want):
    assert found(text) == want


@pytest.mark.parametrize("n", [16, 512, 513, 5000])
def test_secrets_of_any_length(n):
    value = ("aB3_" * n)[:n]
    for cue in ("token", "password"):
        for q in ('"', "'", ""):
            assert found(f"x {cue} = {q}{value}{q} y") == [(value, "SECRET")]


def test_short_passwords():
    assert found("password=hunter2 and Passwd: 'tr0ub4' x") == [("hunter2", "SECRET"), ("tr0ub4", "SECRET")]
    assert found("password: P@ss-w0rd! then") == [("P@ss-w0rd!", "SECRET")] and found('password = "a b" token=hunter2 password=<SECRET>') == []
    assert found('password = "<SECRET>"') == [] and found("password=") == [] and found("password = ") == []


@pytest.mark.parametrize("part", ["token", "token=", "password=", "token='", "tokentoken=\"", "token-password:", "password=x "])
def test_many_cues_stay_linear(part):
    began = time.process_time()
    pii.findings(AUTO, part * 60_000 + "a" * 300_000)
    assert time.process_time() - began < 5


def with_check_digit(digits: str) -> str:
    return next(v for d in "0123456789" if pii.checked(v := digits + d))


def everywhere(text):
    """The findings without anchors: every parser at every place, then the same rule for overlaps."""
    found, secrets = [], pii.Secrets(text)
    for i, c in enumerate(text):
        found += [pii.email(text, i)] if c == "@" else []
        found += [pii.url(text, i, i + len(s)) for s in pii.SCHEMES if text[i : i + len(s)].lower() == s]
        found += [secrets.after(w, i + len(w)) for w in pii.CUES if text[i : i + len(w)].lower() == w]
        found += [pii.ipv6(text, i)] if c == ":" else []
        if c in pii.DIGITS:
            found += [*pii.number(text, i), pii.iban(text, i)]
    out, end = [], 0
    for a, b, k in sorted({x for x in found if x}, key=lambda x: (x[0], -x[1], x[2])):
        if a >= end:
            out.append((a, b, k))
            end = b
    return out


def test_anchors_miss_nothing():
    """Against every parser at every place, on random texts of pieces that matter to them."""
    r = random.Random(4)
    pieces = ["4111 1111 1111 1111", "411111111111", "+1 ", "(020) ", "555", "-1234", "10.", "1.2.3.4", "2001:db8:", ":", "::1", "ab", "@", ".", "x.co", "DE89 3704 0044 0532 0130 00", "http://", "u:p@", "Token", "=", '"', "a" * 16, " ", "-", "é", "7", "card "]
    kinds = set()
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 12)))
        assert pii.findings(AUTO, text) == everywhere(text), text
        kinds |= {k for *_, k in everywhere(text)}
    assert kinds == {"EMAIL", "URL", "IP", "IBAN", "ACCOUNT", "PHONE", "SECRET"}


@pytest.mark.parametrize("n", [63, 64, 65, 80, 5000])
def test_local_parts_of_any_length(n):
    assert found(f"to {'x' * n}@mail.example.com.") == [(f"{'x' * n}@mail.example.com", "EMAIL")]


def test_cues_and_schemes_in_any_case():
    for cue in ("apiKey", "Api_Key", "API-KEY", "accessKey", "ToKeN"):
        assert found(f"{cue}: abcdefghij0123456789 x") == [("abcdefghij0123456789", "SECRET")]
    assert found("see Http://u:p@host/x y") == [("Http://u:p@host/x", "URL")]


def test_check_digits():
    assert found("at 1700000000000 ms, 4111111111111112, 4111-1111-1111-1112") == []
    assert found("account no. 4111111111111112, Card: 1700000000000") == [("4111111111111112", "ACCOUNT"), ("1700000000000", "ACCOUNT")]


def test_ipv6():
    assert found("from 2001:db8::8a2e:370:7334. and [::ffff:1.2.3.4]") == [("2001:db8::8a2e:370:7334", "IP"), ("::ffff:1.2.3.4", "IP")]
    assert found("at 12:30:45, std::vector, bad::add, 00:1a:2b:3c:4d:5e, 1:2:3:4:5:6:7:8:9, x2001:db8::1:1") == []


def test_columns_that_clash(spark):
    d = spark.createDataFrame([(1, "a@b.co", 5, "x", "y")], "doc_id bigint, text string, n_findings int, findings string, kind string")
    assert pii.find(d).first().n_findings == 1 and pii.clean(d).first() == (1, "<EMAIL>", 5, "x", "y")


def test_planted_values_in_prose():
    r = random.Random(1)
    for _ in range(300):
        kind, value = r.choice([("EMAIL", f"ab{r.randrange(99)}.c@mail{r.randrange(9)}.example.com"), ("PHONE", f"+1 ({r.randrange(1000):03d}) 555-{r.randrange(10_000):04d}"), ("IP", ".".join(str(r.randrange(1, 256)) for _ in range(4))), ("ACCOUNT", with_check_digit(str(r.randrange(10**14, 10**15))))])
        pad = lambda: " ".join("".join(r.choice("abcdeé") for _ in range(4)) for _ in range(r.randrange(3)))
        text = f"{pad()} {value}{r.choice([' ', '. ', ', ', '### ', chr(10)])}{pad()}"
        assert found(text) == [(value, kind)]


def test_masking_is_final(tables, docs):
    cleaned = pii.clean(tables("documents"))
    assert cleaned.count() == tables("documents").count() and pii.find(cleaned).count() == 0
    row = pii.clean(docs([(1, "to a.b@c.de and +1 (017) 555-7713")])).first()
    assert (row.text, row.n_chars) == ("to <EMAIL> and <PHONE>", 22)


def test_only_findings_change(tables):
    before = {r.doc_id: r.text for r in tables("documents").collect()}
    spans = {r.doc_id: r.findings for r in pii.find(tables("documents")).collect()}
    for r in pii.clean(tables("documents")).collect():
        if r.doc_id not in spans:
            assert r.text == before[r.doc_id]
        for f in spans.get(r.doc_id, []):
            assert before[r.doc_id][f.start : f.end] == f.value


def test_odd_rows(docs):
    rows = [*enumerate(ODD), (3, "x"), (None, "a@b.co"), (60, "1" * 200_000), (61, "@" * 50_000), (65, "a:" * 50_000), (62, "1-" * 50_000), (63, "1." * 50_000), (64, "+1(" * 50_000)]
    d = docs(rows)
    got = pii.find(d).collect()
    assert {r.doc_id for r in got} <= {None, 62, 63, 64} and None in {r.doc_id for r in got}
    assert pii.clean(d).count() == len(rows) and pii.clean(d).columns == d.columns
    assert pii.find(d.where("false")).count() == 0 and pii.clean(d.where("false")).count() == 0
