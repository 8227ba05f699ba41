"""Keys, n-grams and scalar measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes of a string that order it.
KEY_BYTES = 8


def folded(text: Column, suffix: bool = False) -> Column:
    """Lower case, null as empty; from its last character backwards for suffixes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.reverse(low) if suffix else low


def key(text: Column, suffix: bool = False) -> Column:
    """The first 8 UTF-8 bytes in hexadecimal, filled with zeros: sorts like an unsigned 64-bit number."""
    return F.rpad(F.hex(F.substring(F.encode(folded(text, suffix), "UTF-8"), 1, KEY_BYTES)), 2 * KEY_BYTES, "0")


def key_text(pattern: str, suffix: bool = False, fill: str = "0") -> str:
    """The key of a pattern; fill "F" gives the greatest key that a string beginning with it can have."""
    text = pattern.lower()
    text = text[::-1] if suffix else text
    return text.encode()[:KEY_BYTES].hex().upper().ljust(2 * KEY_BYTES, fill)


def unsigned(key_hex: Column) -> Column:
    """A key as decimal text of its unsigned value."""
    return F.conv(key_hex, 16, 10)


def readable(key_hex: Column, suffix: bool = False) -> Column:
    """The characters of a key, without its filling; a character that the key cuts becomes U+FFFD."""
    text = F.make_valid_utf8(F.unhex(F.regexp_replace(key_hex, "(00)+$", "")).cast("string"))
    return F.reverse(text) if suffix else text


def radix_code(key_hex: Column, bits: int) -> Column:
    """The key's leading bits, up to 32: codes without boundaries."""
    return F.shiftright(F.conv(F.substring(key_hex, 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")


def ngrams(text: Column, n: int) -> Column:
    """All runs of n characters in order; none if the string is shorter. The string is cut into characters once, so the work grows with its length."""

    def runs(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    return F.when(F.length(text) >= n, F.flatten(F.transform(F.array(F.split(text, "")), runs))).otherwise(F.array().cast("array<string>"))


def entropy(p: Column) -> Column:
    """Binary entropy in bits; 0 at 0 and 1."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def geometric_mean(x: Column) -> Column:
    """Of positive values; others don't count."""
    return F.exp(F.avg(F.when(x > 0, F.log(x))))


def printable(text: Column) -> Column:
    return text.rlike(r"\A[\x20-\x7E]+\z")
