"""Column functions over text. Built-in expressions where Spark has them; Arrow UDFs for Unicode and open JSON."""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that a trim takes off, beside what Java's \\s has.
BLANKS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
BLANK = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@F.pandas_udf(T.StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    """NFKC, trimmed, lower case: the form in which titles are compared."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip(BLANK).lower())


@F.pandas_udf(T.StringType())
def nfkc_block(s: pd.Series) -> pd.Series:
    """NFKC, lower case, white space collapsed: the form in which blocks are compared."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).lower().split()))


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with keys in UTF-16 order and without white space; null where it can't be parsed."""

    def order(v):
        if isinstance(v, dict):
            return {k: order(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
        return [order(x) for x in v] if isinstance(v, list) else v

    def one(x):
        try:
            return None if x is None else json.dumps(order(json.loads(x)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def decode_quoted_path(s: pd.Series) -> pd.Series:
    """A path as it is without the quotes and backslash escapes of a patch header; null where they are wrong."""
    simple = {ord(k): v for k, v in zip('abfnrtv\\"', b'\x07\x08\x0c\x0a\x0d\x09\x0b\\"')}

    def one(x):
        if x is None or len(x) < 2 or x[0] != '"' or x[-1] != '"':
            return x if x is None or not x.startswith('"') else None
        raw, out, i = x[1:-1].encode(), bytearray(), 0
        while i < len(raw):
            if raw[i] != 92:
                out.append(raw[i])
                i += 1
            elif i + 1 < len(raw) and raw[i + 1] in simple:
                out.append(simple[raw[i + 1]])
                i += 2
            elif raw[i + 1 : i + 4].isdigit() and len(raw) >= i + 4 and max(raw[i + 1 : i + 4]) < 56 and int(raw[i + 1 : i + 4], 8) < 256:
                out.append(int(raw[i + 1 : i + 4], 8))
                i += 4
            else:
                return None
        try:
            return out.decode()
        except UnicodeDecodeError:
            return None

    return s.map(one)


def truncate_utf8(limit: int):
    """A UDF that cuts text to at most ``limit`` bytes of UTF-8 at a character border; a cut text ends with three dots."""

    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(raw := x.encode()) <= limit:
                return x
            return raw[: max(0, limit - 3)].decode("utf-8", "ignore") + "..."

        return s.map(one)

    return cut


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def normal_lines(c: Column) -> Column:
    """Lines trimmed, line ends unified, the whole trimmed."""
    lines = F.transform(F.split(F.regexp_replace(c, "\r\n", "\n"), "\n", -1), trimmed)
    return trimmed(F.array_join(lines, "\n"))


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1) of a text, or null where it hasn't got them."""
    lines = F.split(content, "\r?\n", -1)
    return F.when((start >= 1) & (start <= end) & (end <= F.size(lines)), F.array_join(F.slice(lines, start, end - start + 1), "\n"))


def repository_path(c: Column) -> Column:
    """A path inside the repository with forward slashes, null for one that leads out."""
    p = F.regexp_replace(F.translate(c, "\\", "/"), r"^\./", "")
    return F.when(~(p.startswith("/") | (p == "..") | p.startswith("../") | p.contains("/../")), p)


def redact(c: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Each given secret of 8 UTF-16 units or more, and what stands after "Bearer", is replaced."""
    for secret in secrets:
        if len(secret.encode("utf-16-le", "surrogatepass")) >= 16:
            c = F.replace(c, F.lit(secret), F.lit("[REDACTED]"))
    return F.regexp_replace(c, rf"(?i)(Bearer{BLANKS}+)[a-z0-9._-]+", "$1[REDACTED]")


#: Control and format characters, line and paragraph separators.
UNSEEN = re.compile("[" + "".join(re.escape(chr(i)) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Cc", "Cf", "Zl", "Zp")) + "]")


def terminal_safe(limit: int = 2048):
    """A UDF that writes a text as a JSON string does, without the quotes, and with escapes for what can't be seen.

    A result of more than ``limit`` bytes of UTF-8 is cut at a character border and ends with three dots.
    """

    @F.pandas_udf(T.StringType())
    def safe(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            text = UNSEEN.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(x, ensure_ascii=False)[1:-1])
            raw = text.encode()
            return text if len(raw) <= limit else raw[: max(0, limit - 3)].decode("utf-8", "ignore") + "..."

        return s.map(one)

    return safe


def utf16(c: Column) -> Column:
    """A text's UTF-16 units as bytes; their order is that of the units."""
    return F.encode(c, "UTF-16BE")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(utf16(c)) / 2).cast("int")


def half_up_tenths(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator in tenths, halves upwards, as an integer; null for a denominator of 0 or less."""
    return F.when(denominator > 0, F.floor(numerator * 10 / denominator + F.lit(0.5)).cast("bigint"))


def tenths_text(tenths: Column) -> Column:
    """25 -> 2.5; N/A for null."""
    return F.when(tenths.isNull(), "N/A").otherwise(F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string")))


def signed_tenths_text(numerator: Column, denominator: Column) -> Column:
    t = half_up_tenths(F.abs(numerator), denominator)
    return F.when(t.isNull(), "N/A").when(t == 0, "0.0").otherwise(F.concat(F.when(numerator > 0, "+").otherwise("-"), tenths_text(t)))


def strict_utc(c: Column) -> Column:
    """The instant of an ISO timestamp in UTC that exists in the calendar; null for any other text."""
    parsed = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"\.\d{1,9}Z$", "Z"), "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss "))
    exact = F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss") == F.substring(c, 1, 19)
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z\z") & exact, parsed)


def json_pointer(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def framed_hash(*parts: Column) -> Column:
    """SHA-256 of parts with their lengths before them, so that no two lists of parts share an image."""
    framed = [F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.sha2(F.concat(*framed).cast("binary"), 256)
