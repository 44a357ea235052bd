"""Column functions: compatibility, scenario labels, two-bit sequences, text wrapping."""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
WORD = 32
_ODD_BITS = 0x5555555555555555


def known(x: Column) -> Column:
    """x as double, null as NaN."""
    return F.coalesce(x.cast("double"), F.lit(float("nan")))


def compatibility(percentile: Column) -> Column:
    return 1 - 2 * F.abs(percentile - 0.5)


def scenario_label(raw: Column) -> Column:
    """The canonical label of a raw one, without blanks around it and zeros before its numbers; null if it is none."""
    clean = F.lower(F.regexp_replace(raw, r"(?U)\A\s+|\s+\z", ""))
    short = F.regexp_replace(clean, r"([(,])0+(?=[0-9])", "$1")
    return F.when(clean.rlike(r"\A(ad\([0-9]+\)|ca\([0-9]+,[0-9]+\))\z"), short)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("double")


def pack(codes: Column) -> Column:
    """Array of 64-bit words of an array of codes 0..3: 32 bases a word, the first in its top bits, zeros at the end."""
    # as a lambda's variable the codes are computed once, not again for each base
    return F.get(F.transform(F.array(codes), _words), F.lit(0))


def _words(codes: Column) -> Column:
    n = F.ceil(F.size(codes) / WORD).cast("int")
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("long"),
        lambda acc, p: F.shiftleft(acc, 2).bitwiseOR(F.coalesce(F.get(codes, w * WORD + p), F.lit(0)).cast("long")),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))


def unpack(words: Column, length: Column | int) -> Column:
    """The codes again."""
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda p: F.call_function("shiftrightunsigned", w, F.lit(62) - 2 * p).bitwiseAND(F.lit(3)).cast("tinyint")))
    return F.slice(F.flatten(each), F.lit(1), F.lit(length) if isinstance(length, int) else length)


def hamming(a: Column, b: Column) -> Column:
    """Bases in which two arrays of words differ."""
    x = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    return F.aggregate(x, F.lit(0), lambda acc, w: acc + F.bit_count(w.bitwiseOR(F.shiftrightunsigned(w, 1)).bitwiseAND(F.lit(_ODD_BITS))))


def planes(words: Column, n: int) -> list[Column]:
    """The n words of an array, none null, as columns: of each two words the upper bits of their bases, then the lower ones."""
    at = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(0)) if i < n else F.lit(0).cast("long")
    odd = lambda w: w.bitwiseAND(F.lit(_ODD_BITS))
    upper = lambda w: odd(F.shiftrightunsigned(w, 1))
    return [F.shiftleft(bits(at(i)), 1).bitwiseOR(bits(at(i + 1))) for i in range(0, n, 2) for bits in (upper, odd)]


def hamming_of(a: list[Column], b: list[Column]) -> Column:
    """hamming() of planes(): compiled with the rest of the plan, where functions of arrays are interpreted."""
    x = [p.bitwiseXOR(q) for p, q in zip(a, b)]
    return reduce(operator.add, (F.bit_count(upper.bitwiseOR(lower)) for upper, lower in zip(x[::2], x[1::2])), F.lit(0))


def bases(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.element_at(F.array(*map(F.lit, BASES)), c.cast("int") + 1)), "")


def wrapped(text: Column, width: int = 100) -> Column:
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def _constant_sql(values: np.ndarray, kind: str) -> str:
    """An array of numbers as SQL that folds into a constant; repr() of a double reads back as the same one."""
    return f"cast(split('{','.join(map(repr, values.tolist()))}', ',') as array<{kind}>)"


def _halvings(n: int) -> list[int]:
    return [1 << i for i in reversed(range(n.bit_length()))]


class Steps:
    """A distribution function: sorted distinct values, and how many draws are no larger than each.

    A column bisects the values in log2 of their number of steps, inside the engine.
    """

    def __init__(self, values: np.ndarray, cums: np.ndarray) -> None:
        self.values, self.cums = np.asarray(values, float), np.asarray(cums, np.int64)
        self.n = int(self.cums[-1])
        self.single = self.n == len(self.values)  # no value twice: the counts are the places

    def of(self, x: float) -> float:
        """The share of draws no larger than x; 0 for NaN."""
        at = 0 if np.isnan(x) else int(np.searchsorted(self.values, x, side="right"))
        return float(self.cums[at - 1] / self.n) if at else 0.0

    def share(self, x: Column) -> Column:
        """The share of draws no larger than x; 1 for NaN."""
        at = bisected(F.expr(_constant_sql(self.values, "double")), len(self.values), x)
        count = at if self.single else F.coalesce(F.get(F.expr(_constant_sql(self.cums, "bigint")), at - 1), F.lit(0))
        return count / F.lit(float(self.n))

    def share_sql(self, x: str) -> str:
        """The same as SQL, of an SQL expression."""
        at = f"aggregate(array({', '.join(map(str, _halvings(len(self.values))))}), 0, (p, h) -> if(get({_constant_sql(self.values, 'double')}, p + h - 1) <= {x}, p + h, p))"
        count = at if self.single else f"coalesce(get({_constant_sql(self.cums, 'bigint')}, {at} - 1), 0)"
        return f"{count} / {float(self.n)!r}D"


def bisected(values: Column, n: int, x: Column) -> Column:
    """How many of n sorted values, an array, are no larger than x (all for NaN), by halving."""
    return F.aggregate(F.array(*map(F.lit, _halvings(n))), F.lit(0), lambda p, h: F.when(F.get(values, p + h - 1) <= x, p + h).otherwise(p))


def interpolated(x: Column, at: np.ndarray, values: np.ndarray) -> Column:
    """The straight line between points (at, ascending; values) at x, the first or last value beyond them; null for NaN and null."""
    xs, ys = F.expr(_constant_sql(np.asarray(at, float), "double")), F.expr(_constant_sql(np.asarray(values, float), "double"))
    n, x = len(at), F.nullif(x.cast("double"), F.lit(float("nan")))

    def line(p: Column) -> Column:
        x0, y0 = F.get(xs, p - 1), F.get(ys, p - 1)
        return F.when(p == 0, F.lit(float(values[0]))).when(p == n, F.lit(float(values[-1]))).otherwise((F.get(ys, p) - y0) / (F.get(xs, p) - x0) * (x - x0) + y0)

    # as a lambda's variable the place is found once
    return F.when(x.isNotNull(), F.get(F.transform(F.array(bisected(xs, n, x)), line), F.lit(0)))
