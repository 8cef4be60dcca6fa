"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, URL schemes, words that announce a secret (both in any case),
and short patterns that every telephone, account or network number must contain (four digits in a row; a digit
after a dot, a plus sign or an opening bracket; a digit on both sides of a hyphen; two colons, or a colon between
hexadecimal digits). From each anchor a deterministic parser expands to both sides and validates the boundaries:

- email: a local part of any length and a dotted domain with a top level of two letters or more
- url: scheme, host and the rest up to white space, without closing punctuation; only with user data (user@host)
  or a numeric host it is personal, other links stay
- ip: four numbers up to 255, not part of a longer dotted number; or an IPv6 address with at least three groups
- iban: country code, check digits and body whose remainder modulo 97 is 1
- account: 12 to 19 digits, in one run or in groups of at least three joined by single spaces or hyphens, with a
  right check digit (Luhn), or after a word for account or card whatever the check digit
- phone: 8 to 15 digits with a country code or an area code in brackets, or in three groups joined by hyphens
- secret: a value after "token", "secret", "password", "api_key" and such, and = or :, of any length from 16
  characters on, after "password" and "passwd" from 6; quoted, without white space, or of the characters of keys, after
  a password word of all that don't separate or bracket. What is masked already is no secret.

Defined results: a null, empty or anchorless text has no finding; find gives no row for it and clean keeps it as it
is. Texts of any length are searched whole, in linear time. Where findings overlap the one that begins first, then
the longest, stays; of equal ones the kind first in the alphabet. Repeated rows, and rows with a null doc_id, are
treated alike. A finding is replaced by its kind in brackets. An empty table gives an empty result. Other columns
stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from ipaddress import IPv6Address
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .decontaminate import with_texts

CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
DIGITS = "0123456789"
HEXADECIMAL = DIGITS + "abcdefABCDEF"

#: The longest number, IBAN or network address has fewer characters.
REACH = 64

EDGE = ".!#$%&'*+/=?^`{|}~-"
DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![^\W_])")
URL = re.compile(r"[^\s<>\"'`|*#$%&]+")
OWNER = re.compile(r"[^/\s@]+@[^/\s]+|\d{1,3}(?:\.\d{1,3}){3}(?![\w.])")
IP = re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)", re.A)
ACCOUNT = re.compile(r"\d{12,19}(?![\w])|\d{3,6}(?:([ -])\d{3,6})(?:\1\d{3,6}){1,4}(?![\w])", re.A)
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,5}){1,4}(?!\d)|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}(?!\d)|\d{3}-\d{2,4}-\d{4}(?![\d-])", re.A)
IPV6 = re.compile(r"[0-9A-Fa-f:.]{2,64}")
OWNED = re.compile(r"(?:account|acct|a/c|card|konto|karte|compte|carte|cuenta|tarjeta)(?:\s{1,2}(?:number|no|nr|num)\b)?[\s.:#=-]{1,4}\Z", re.I)
RUN = re.compile(r"\d*", re.A)
NAME = re.compile(r"[\w-]*+")
ASSIGN = re.compile(r"\s{0,3}[\"']?\s{0,3}[=:]\s{0,3}")
QUOTED = {'"': re.compile(r"[^\"\s]*+"), "'": re.compile(r"[^'\s]*+")}
PLAIN = re.compile(r"[A-Za-z0-9_+/.=-]*+")
PASSWORD = re.compile(r"[^\s\"'`,;<>|&()\[\]{}]*+")
MASK = re.compile(r"<(?:EMAIL|URL|IP|IBAN|ACCOUNT|PHONE|SECRET)>")
#: Characters a secret has at least, after a password word and after any other.
SHORT, LONG = 6, 16


def spellings(word: str) -> set[str]:
    """The word in all mixtures of small and capital letters."""
    return {"".join(x) for x in product(*({c, c.upper()} for c in word))}


def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    for words, kind in ((SCHEMES, "://"), (CUES, "=")):
        for w in words:
            for x in spellings(w):
                a.add_word(x, (kind, len(x)))
    a.add_word("::", (":", 2))
    for x, y in product(HEXADECIMAL, repeat=2):
        a.add_word(f"{x}:{y}", (":", 3))
    for d in DIGITS:
        for x in ".+(":
            a.add_word(x + d, (x, 2))
        for e in DIGITS:
            a.add_word(f"{d}-{e}", ("-", 3))
    for n in range(10_000):
        a.add_word(f"{n:04d}", ("9", 4))
    a.make_automaton()
    return a


def email(text: str, at: int) -> tuple[int, int, str] | None:
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] in "_" + EDGE):
        start -= 1
    while start < at and text[start] in EDGE:
        start += 1
    local = text[start:at]
    d = DOMAIN.match(text, at + 1)
    if not local or local[-1] == "." or not d:
        return None
    return start, d.end(), "EMAIL"


def url(text: str, begin: int, after: int) -> tuple[int, int, str] | None:
    if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
        return None
    m = URL.match(text, after)
    if not m:
        return None
    end = m.end()
    while end > after and text[end - 1] in ".,;:!?)]}":
        end -= 1
    return (begin, end, "URL") if OWNER.match(text[after:end]) else None


def left(text: str, at: int, allowed: str) -> int:
    """Where the allowed characters before at begin; no identifier begins further away than REACH."""
    end = max(0, at - REACH)
    while at > end and text[at - 1] in allowed:
        at -= 1
    return at


def boundary(text: str, start: int, more: str = "") -> bool:
    """No word, and none of more, runs on into start."""
    return not start or not (text[start - 1].isalnum() or text[start - 1] in "_" + more)


def checked(digits: str) -> bool:
    """Whether the last digit is the check digit (Luhn) of the others."""
    return not sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def account(text: str, start: int, found: str) -> bool:
    digits = "".join(c for c in found if c in DIGITS)
    return 12 <= len(digits) <= 19 and (checked(digits) or OWNED.search(text, max(0, start - 32), start) is not None)


def ipv6(text: str, begin: int) -> tuple[int, int, str] | None:
    start = left(text, begin, HEXADECIMAL + ":.")
    m = IPV6.match(text, start)
    if not m or not boundary(text, start):
        return None
    end = m.end()
    if text[end : end + 1].isalnum() or text[end : end + 1] == "_":
        return None
    value = m.group().rstrip(".")
    if value.endswith(":") and not value.endswith("::"):
        value = value[:-1]
    try:
        IPv6Address(value)
    except ValueError:
        return None
    return (start, start + len(value), "IP") if "." in value or sum(map(bool, value.split(":"))) > 2 else None


def number(text: str, begin: int) -> list[tuple[int, int, str]]:
    """What a digit of a number may belong to."""
    found = []
    for kind, pattern, allowed, edge in (("IP", IP, DIGITS + ".", "."), ("ACCOUNT", ACCOUNT, DIGITS + " -", "-+"), ("PHONE", PHONE, DIGITS + " .-()+", "")):
        low = left(text, begin, allowed)
        for start in range(low, begin + 1):
            if text[start] in "+(" + DIGITS and boundary(text, start, edge) and (m := pattern.match(text, start)) and m.end() > begin:
                n = sum(c.isdigit() for c in m.group())
                if kind == "IP" or kind == "ACCOUNT" and account(text, start, m.group()) or kind == "PHONE" and 8 <= n <= 15:
                    found.append((start, m.end(), kind))
                    break
    return found


def iban(text: str, begin: int) -> tuple[int, int, str] | None:
    low = left(text, begin, "ABCDEFGHIJKLMNOPQRSTUVWXYZ " + DIGITS)
    for start in range(low, begin):
        if text[start].isalpha() and boundary(text, start) and (m := IBAN.match(text, start)) and m.end() > begin:
            s = m.group().replace(" ", "")
            if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                return start, m.end(), "IBAN"
    return None


class Secrets:
    """The secrets of a text, asked for by its cues in order. No run is scanned again for each cue in it, so time is linear."""

    def __init__(self, text: str):
        self.text = text
        self.named = 0  # end of the run of name characters that was looked at last
        self.values: dict[re.Pattern, tuple[int, int]] = {p: (-1, -1) for p in (*QUOTED.values(), PLAIN, PASSWORD)}

    def end(self, pattern: re.Pattern, at: int, whole: bool) -> int:
        """Where the run at a place ends; that of a place inside the last run, or if whole of the same place, is known."""
        begin, end = self.values[pattern]
        if at != begin and (whole or at >= end):
            self.values[pattern] = at, (end := pattern.match(self.text, at).end())
        return end

    def after(self, cue: str, at: int) -> tuple[int, int, str] | None:
        text = self.text
        if at >= self.named:
            self.named = NAME.match(text, at).end()
        m = ASSIGN.match(text, self.named)
        if not m or m.end() == len(text):
            return None
        password = cue.lower().startswith("passw")
        start, least = m.end(), SHORT if password else LONG
        if (quote := text[start]) in QUOTED:
            start += 1
            end = self.end(QUOTED[quote], start, True)
            if text[end : end + 1] != quote:
                return None
        else:
            end = self.end(PASSWORD if password else PLAIN, start, False)
        return (start, end, "SECRET") if end - start >= least and not MASK.fullmatch(text, start, end) else None


def findings(auto: ahocorasick.Automaton, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, in order, without overlap."""
    if not text:
        return []
    found, seen, secrets = [], -1, Secrets(text)  # seen: end of the digits that were already looked at
    for last, (kind, size) in auto.iter(text):
        begin = last - size + 1
        if kind == "@":
            hit = email(text, last)
            found += [hit] if hit else []
        elif kind == "://":
            hit = url(text, begin, last + 1)
            found += [hit] if hit else []
        elif kind == ":":
            hit = ipv6(text, begin)
            found += [hit] if hit else []
        elif kind == "=":
            hit = secrets.after(text[begin : last + 1], last + 1)
            found += [hit] if hit else []
        elif last > seen:
            hits = number(text, last)
            if kind == "9" and (hit := iban(text, last)):
                hits.append(hit)
            found += hits
            # Nothing begins inside a run of digits, so the rest of the run has no other result.
            run = RUN.match(text, last).end()
            seen = max((e - 1 for _, e, _ in hits), default=run - 1)
    out, end = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in found:
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


def find(docs: DataFrame) -> DataFrame:
    """A row for each document with personal data: every finding, with characters from start to end."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_findings", pa.int32()), ("findings", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = anchors()
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py()
                if found := findings(auto, text):
                    rows.append({"doc_id": doc_id, "n_findings": len(found), "findings": [{"start": a, "end": b, "kind": k, "value": text[a:b]} for a, b, k in found]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, n_findings int, findings array<struct<start:int,end:int,kind:string,value:string>>")


def clean(docs: DataFrame) -> DataFrame:
    """The documents with all columns, personal data replaced by its kind; n_chars, where there is one, follows."""
    at, count = docs.columns.index("text"), "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = anchors()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [findings(auto, t) for t in texts]
            if any(found):
                batch = with_texts(batch, [masked(t, f) if f else t for t, f in zip(texts, found)], [bool(f) for f in found], at, count)
            yield batch

    return docs.mapInArrow(run, docs.schema)
