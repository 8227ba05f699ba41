"""String predicates, and their rewriting: a cheap integer condition first, then the exact one.

Patterns are literal. The integer condition never loses a row, so results equal a plain scan's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.operators.bitmask import Features
from codesieve.operators.quantile import Codes


@dataclass(frozen=True)
class Match:
    """Strings that begin with `prefix`, end with `suffix` and contain `inside`, each if given; case-insensitive unless exact_case.

    Prefix and suffix may overlap.
    """

    column: str
    prefix: str = ""
    suffix: str = ""
    inside: str = ""
    exact_case: bool = False

    def exact(self) -> Column:
        text = F.col(self.column) if self.exact_case else F.lower(self.column)
        fold = (lambda s: s) if self.exact_case else str.lower
        out = F.col(self.column).isNotNull()
        for pattern, test in ((self.prefix, text.startswith), (self.suffix, text.endswith), (self.inside, text.contains)):
            out = out & test(fold(pattern)) if pattern else out
        return out


def like(column: str, pattern: str) -> Match | None:
    """A LIKE pattern as a Match, if its wildcards are only % at either end; None otherwise, and the plain ILIKE serves."""
    body = pattern.strip("%")
    if "_" in body or "%" in body or "\\" in body:
        return None
    ahead, behind = pattern.startswith("%"), pattern.endswith("%")
    if ahead and behind:
        return Match(column, inside=body)
    return Match(column, suffix=body) if ahead else Match(column, prefix=body) if behind else None


@dataclass(frozen=True)
class Index:
    """The code columns that a table has: separate ones, a packed one, a presence bitmask."""

    prefix: Codes | None = None
    suffix: Codes | None = None
    packed: str | None = None
    features: Features | None = None
    names: dict = field(default_factory=dict)

    def conditions(self, match: Match, way: str = "range") -> list[Column]:
        """Integer conditions that every match meets. way: range, shift or in, for a packed column."""
        out = []
        if self.packed and self.prefix and self.suffix:
            out += packed_conditions(self.packed, self.prefix, self.suffix, match, way)
        else:
            out += [F.col(self.names.get(c.name, c.name)).between(*c.range(p)) for c, p in ((self.prefix, match.prefix), (self.suffix, match.suffix)) if c and p]
        if self.features and (mask := self.features.mask(match.inside)):
            out.append(F.col(self.features.name).bitwiseAND(F.lit(mask)) == mask)
        return out


def packed_conditions(name: str, prefix: Codes, suffix: Codes, match: Match, way: str) -> list[Column]:
    """On (prefix code << bits) | suffix code. A range over the prefix and a list of values reach the Parquet scan, shifts and masks don't."""
    bits, low_mask, col = suffix.bits, (1 << suffix.bits) - 1, F.col(name)
    lo, hi = prefix.range(match.prefix)
    s_lo, s_hi = suffix.range(match.suffix)
    if way == "in" and (hi - lo + 1) * (s_hi - s_lo + 1) <= 256:
        return [col.isin([p << bits | s for p in range(lo, hi + 1) for s in range(s_lo, s_hi + 1)])]
    out = []
    if match.prefix:
        out.append(F.shiftright(col, bits).between(lo, hi) if way == "shift" else col.between(lo << bits, hi << bits | low_mask))
    if match.suffix:
        out.append(col.bitwiseAND(F.lit(low_mask)).between(s_lo, s_hi))
    return out


def accelerate(df: DataFrame, match: Match, index: Index, way: str = "range") -> DataFrame:
    """The matching rows: integer conditions first, the exact one behind them."""
    condition = None
    for c in [*index.conditions(match, way), match.exact()]:
        condition = c if condition is None else condition & c
    return df.where(condition)
