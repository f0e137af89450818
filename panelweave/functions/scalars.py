"""Column expressions. Everything here stays in the JVM."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKS_PER_MONTH = 4.3


def text_key(*parts: str | Column, sep: str = "") -> Column:
    """Join key parts as text; a missing part becomes the text NA, so the key is never NULL."""
    return F.concat_ws(sep, *[F.coalesce(_column(p).cast("string"), F.lit("NA")) for p in parts])


def recode(value: str | Column, mapping: Mapping) -> Column:
    """Map values one to one; a value outside the mapping becomes NULL."""
    value = _column(value)
    out = None
    for old, new in mapping.items():
        out = F.when(value == F.lit(old), F.lit(new)) if out is None else out.when(value == F.lit(old), F.lit(new))
    return out


def number_of(value: str | Column, numbers: Mapping[str, float]) -> Column:
    """The number that belongs to a text, NULL for any other; other types are compared as text.

    The texts are dealt to buckets of about four by their CRC, so thousands of them are found as fast as a few.
    """
    text = _column(value).cast("string")
    buckets: list[dict[str, float]] = [{} for _ in range(len(numbers) // 4 + 1)]
    for key, number in numbers.items():
        buckets[zlib.crc32(str(key).encode()) % len(buckets)][str(key)] = float(number)
    # One constant, folded before the query runs.
    table = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,double>>")
    bucket = F.get(table, (F.crc32(text.cast("binary")) % len(buckets)).cast("int"))
    return F.try_element_at(bucket, text)


def region_from_key(key: str | Column, names: Mapping[str, str]) -> Column:
    """Region name from the first character of a cluster key."""
    return recode(F.substring(_column(key).cast("string"), 1, 1), names)


def member_flag(relation: str | Column, excluded: Iterable[str]) -> Column:
    """1 for people whose income counts; NULL for excluded relations and for an unknown relation."""
    return F.when(_is_member(relation, excluded), F.lit(1.0))


def members_only(value: str | Column, relation: str | Column, excluded: Iterable[str]) -> Column:
    """Hide a household value on the rows of people who do not belong to the family."""
    return F.when(_is_member(relation, excluded), _column(value))


def real_income(amount: str | Column, member: Column, deflator: str | Column) -> Column:
    return F.when(member.isNotNull(), _column(amount) * _column(deflator))


def hourly_wage(wage: str | Column, weekly_hours: str | Column, weeks: float = WEEKS_PER_MONTH) -> Column:
    """Monthly wage per hour; a zero rate falls back to the wage, zero hours give NULL."""
    rate = F.try_divide(_column(wage).cast("double"), _column(weekly_hours) * F.lit(weeks))
    return F.when(rate == 0, _column(wage)).otherwise(rate)


def log_or_zero(value: str | Column) -> Column:
    """Natural logarithm with log(0) taken as 0."""
    value = _column(value)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.ln(value))


def is_employed(wage: str | Column) -> Column:
    return F.when(_column(wage) > 0, 1).otherwise(0)


def missing_as_zero(value: str | Column) -> Column:
    return F.coalesce(_column(value), F.lit(0.0))


def row_max(*values: str | Column) -> Column:
    """Largest of several columns, ignoring NULLs."""
    return F.greatest(*[_column(v) for v in values])


def percent_text(share: str | Column, digits: int = 2) -> Column:
    """A share as percent text without trailing zeros: 0.125 -> 12.5%, 0.12 -> 12%."""
    return F.concat(decimal_text(F.bround(_column(share) * 100, digits), "0." + "#" * digits), F.lit("%"))


def decimal_text(value: str | Column, pattern: str) -> Column:
    """A number written by a decimal pattern, where # is an optional digit."""
    return F.call_function("format_number", _column(value), F.lit(pattern.rstrip(".")))


def number_text(value: str | Column, digits: int = 10) -> Column:
    """A number as text the way a report prints it: no exponent, whole numbers without a decimal point."""
    return decimal_text(value, "0." + "#" * digits)


def without_prefix(value: str | Column, length: int) -> Column:
    """Text after a variable-name prefix of `length` characters."""
    return F.substr(_column(value), F.lit(length + 1))


def all_as_text(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(c).cast("string").alias(c) for c in frame.columns])


# --- normal distribution -------------------------------------------------------------------------
# Rational approximations of the normal integral (W. J. Cody, 1969).
# Centre, |z| <= 0.67448975, in z^2, highest power first.
CENTRE_TOP = (0.065682337918207449113, 2.2352520354606839287, 161.02823106855587881, 1067.6894854603709582,
              18154.981253343561249)
CENTRE_BOTTOM = (1.0, 47.20258190468824187, 976.09855173777669322, 10260.932208618978205, 45507.789335026729956)
# Middle, up to sqrt(32), in |z|, highest power first.
MIDDLE_TOP = (1.0765576773720192317e-8, 0.39894151208813466764, 8.8831497943883759412, 93.506656132177855979,
              597.27027639480026226, 2494.5375852903726711, 6848.1904505362823326, 11602.651437647350124,
              9842.7148383839780218)
MIDDLE_BOTTOM = (1.0, 22.266688044328115691, 235.38790178262499861, 1519.377599407554805, 6485.558298266760755,
                 18615.571640885098091, 34900.952721145977266, 38912.003286093271411, 19685.429676859990727)
# Tail, beyond sqrt(32), in 1/z^2, highest power first.
TAIL_TOP = (0.02307344176494017303, 0.21589853405795699, 0.1274011611602473639, 0.022235277870649807,
            0.001421619193227893466, 2.9112874951168792e-5)
TAIL_BOTTOM = (1.0, 1.28426009614491121, 0.468238212480865118, 0.0659881378689285515, 0.00378239633202758244,
               7.29751555083966205e-5)
CENTRE_EDGE = 0.67448975
MIDDLE_EDGE = math.sqrt(32.0)
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def normal_pdf(z: str | Column) -> Column:
    z = _column(z)
    return F.exp(z * z * F.lit(-0.5)) * F.lit(INV_SQRT_2PI)


def normal_cdf(z: str | Column) -> Column:
    z = _column(z)
    # One copy of the tail keeps the generated method small enough to be compiled.
    tail = F.exp(z * z * F.lit(-0.5)) * _scaled_tail(z)
    return F.when(F.abs(z) <= CENTRE_EDGE, F.lit(0.5) + _centre(z)).otherwise(
        F.when(z > 0, 1.0).otherwise(0.0) + F.when(z > 0, -1.0).otherwise(1.0) * tail
    )


def inverse_mills(z: str | Column) -> Column:
    """pdf(z) / cdf(z). Below the centre the exponentials cancel, so the far tail keeps full precision.

    Give it a plain column: the expression mentions z many times.
    """
    z = _column(z)
    density = F.exp(z * z * F.lit(-0.5))
    top = F.when(z < 0, 1.0).otherwise(density)
    bottom = F.when(z < 0, 0.0).otherwise(1.0) + F.when(z < 0, 1.0).otherwise(-density) * _scaled_tail(z)
    return F.lit(INV_SQRT_2PI) * F.when(F.abs(z) <= CENTRE_EDGE, density / (F.lit(0.5) + _centre(z))).otherwise(
        top / F.when(z.isNotNull(), bottom)
    )


def _centre(z: Column) -> Column:
    square = z * z
    return z * _polynomial(CENTRE_TOP, square) / _polynomial(CENTRE_BOTTOM, square)


def _scaled_tail(z: Column) -> Column:
    """Tail probability beyond |z| times exp(z^2 / 2), for |z| > 0.67448975."""
    y = F.abs(z)
    square = z * z
    # The far approximation is a ratio in 1 / z^2; both sides times z^10 make it a ratio in z^2.
    far = _polynomial(TAIL_TOP[::-1], square) / _polynomial(TAIL_BOTTOM[::-1], square) / square
    return F.when(y <= MIDDLE_EDGE, _polynomial(MIDDLE_TOP, y) / _polynomial(MIDDLE_BOTTOM, y)).otherwise(
        (F.lit(INV_SQRT_2PI) - far) / y
    )


def _polynomial(coefficients: Iterable[float], x: Column) -> Column:
    first, *rest = coefficients
    out = F.lit(first)
    for c in rest:
        out = out * x + F.lit(c)
    return out


def _is_member(relation: str | Column, excluded: Iterable[str]) -> Column:
    relation = _column(relation)
    return relation.isNotNull() & ~relation.isin(*excluded)


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
