"""Scalar functions that the operators' rules use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_share(n: Column, of: Column) -> Column:
    """n / of, and 0 where of is 0."""
    return F.when(of == 0, 0.0).otherwise(n / of)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970, to the nearest one; half a millisecond counts away from 1970."""
    us = F.unix_micros(ts.cast("timestamp"))
    near = F.floor((F.abs(us) + 500) / 1000)
    return F.when(us < 0, -near).otherwise(near)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def redacted(text: Column, secret: str) -> Column:
    """text without a secret's occurrences; an empty secret hides nothing."""
    return F.replace(text, F.lit(secret), F.lit("[redacted]")) if secret else text


def in_language_order(text: Column) -> Column:
    """text to sort by as people do, not by code units."""
    return F.collate(text, "UNICODE")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def capped_list(values: Column, most: int = 20) -> Column:
    """The first values, and how many more there are."""
    more = F.size(values) - most
    return F.when(more > 0, F.array_append(F.slice(values, 1, most), F.concat(more.cast("string"), F.lit(" more")))).otherwise(values)


def without_json_comments(text: Column) -> Column:
    """JSON of a configuration that allows comments and commas before a closing bracket; strings stay as they are."""
    string = r'"(?:[^"\\]|\\.)*"'
    bare = F.regexp_replace(text, rf"({string})|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(bare, rf"({string})|,(?=\s*[\]}}])", "$1")


def utf16_length(text: Column) -> Column:
    """Code units of text; a character beyond the basic plane has two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def script_number(x: Column) -> Column:
    """A finite double as scripts print it: digits up to 21 places, an exponent beyond them and below a millionth."""
    text = F.abs(x).cast("string")
    read = lambda t: F.struct(F.regexp_extract(t, r"^(\d+)", 1).alias("whole"), F.regexp_extract(t, r"^\d+\.(\d+)", 1).alias("part"), F.coalesce(F.regexp_extract(t, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0)).alias("power"))
    led = lambda r: F.regexp_replace(F.concat(r["whole"], r["part"]), "^0+", "")
    # point: its place, counted from the first digit that isn't 0
    placed = lambda r: F.struct(F.regexp_replace(led(r), "0+$", "").alias("digits"), (r["power"] - F.length(r["part"]) + F.length(led(r))).alias("point"))

    def shown(d: Column) -> Column:
        digits, point = d["digits"], d["point"]
        n, e = F.length(digits), point - 1
        plain = F.when(point >= n, F.rpad(digits, point, F.lit("0"))).when(point > 0, F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        scientific = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))
        return F.when(n == 0, "0").when((point > -6) & (point <= 21), plain).otherwise(scientific)

    return F.concat(F.when(x < 0, "-").otherwise(""), let(let(let(text, read), placed), shown))
