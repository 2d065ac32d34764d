"""Exact money as column expressions.

Amounts are integer paise (BIGINT) at rest and inside the engine, DECIMAL at the edges.
Nothing here goes through binary floating point.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def quantize(x: Column) -> Column:
    """Half-up to the paisa. Spark's decimal round() is HALF_UP."""
    return F.round(x, 2)


def as_decimal(x: Column, scale: int = 6) -> Column:
    """Coerce through text, so a DOUBLE never contributes its binary tail."""
    return x.cast("string").cast(f"decimal(38,{scale})")


def to_paise(x: Column) -> Column:
    return F.coalesce(F.round(x * F.lit(100), 0).cast("bigint"), F.lit(0).cast("bigint"))


def from_paise(p: Column) -> Column:
    cents = F.coalesce(p, F.lit(0)).cast("decimal(20,0)") * F.lit(Decimal("0.01"))
    return cents.cast("decimal(20,2)")


def div_half_up(num: Column, den: Column) -> Column:
    """num / den rounded half-up to an integer; num >= 0, den > 0, no intermediate rounding."""
    n, d = num.cast(_WIDE), den.cast(_WIDE)
    twice = (n * F.lit(2) + d).cast(_WIDE)
    return _floor_div(twice, (d * F.lit(2)).cast(_WIDE))


def product_div_half_up(a: Column, b: Column, den: Column, limit_a: int, limit_b: int) -> Column:
    """a * b / den rounded half-up; a, b, den >= 0 whole numbers.

    Within the limits (a <= limit_a, b and den <= limit_b, 2 * limit_a * limit_b + limit_b < 2^63) in BIGINT, beyond them in
    wide decimals. Both are exact; the first is much the cheaper one and nearly every claim takes it.
    """
    assert 2 * limit_a * limit_b + limit_b < 2**63
    small = (a <= limit_a) & (b <= limit_b) & (den <= limit_b)
    la, lb, ld = (c.cast("bigint") for c in (a, b, den))
    fast = F.call_function("div", la * lb * 2 + ld, ld * 2)
    wide = div_half_up((a.cast("decimal(20,0)") * b.cast("decimal(18,0)")).cast(_WIDE), den)
    return F.when(small, fast).otherwise(wide)


def div_half_even(num: Column, den: Column) -> Column:
    """num / den rounded half-even to an integer, any sign of num, den > 0."""
    n, d = num.cast(_WIDE), den.cast(_WIDE)
    rest = F.pmod(n, d)
    floor = _floor_div(n, d)
    twice = (rest * F.lit(2)).cast(_WIDE)
    up = (twice > d) | ((twice == d) & (F.pmod(floor, F.lit(2)) == 1))
    return floor + F.when(up, 1).otherwise(0).cast("bigint")


def _floor_div(n: Column, d: Column) -> Column:
    """Floor of n / d. The remainder goes first, so the division is exact."""
    return F.call_function("div", (n - F.pmod(n, d)).cast(_WIDE), d).cast("bigint")


def ratio(num: Column, den: Column, scale: int) -> Column:
    """num / den as DECIMAL with `scale` digits, half-even, rounded once. NULL when den is 0."""
    shift = F.lit(Decimal(10) ** scale)
    safe = F.when(den.cast(_WIDE) > 0, den)
    units = div_half_even((num.cast(_WIDE) * shift).cast(_WIDE), safe)
    if scale == 0:
        return units.cast("decimal(20,0)")
    return (units.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(22,{scale})")


def group_digits(digits: Column) -> Column:
    """Lakh/crore grouping of a digit string: last three, then pairs."""
    size = F.length(digits)
    head = F.substring(digits, F.lit(1), size - 3)
    grouped = F.concat(
        F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","), F.right(digits, F.lit(3))
    )
    return F.when(size > 3, grouped).otherwise(digits)


def rupees(x: Column, paise: bool = False) -> Column:
    """Display text, sign before the symbol, NULL as a dash."""
    value = F.round(x, 2 if paise else 0)
    size = F.abs(value)
    whole = F.floor(size).cast("decimal(30,0)")
    text = group_digits(whole.cast("string"))
    if paise:
        text = F.concat(text, F.lit("."), F.right(size.cast("decimal(38,2)").cast("string"), F.lit(2)))
    signed = F.concat(F.when(value < 0, "-").otherwise(""), F.lit("₹"), text)
    return F.coalesce(signed, F.lit("—"))


def rs(p: Column) -> Column:
    """'Rs 1,234.50' for message texts, from paise."""
    return F.concat(F.lit("Rs "), F.format_number(from_paise(p), 2))


def parse_amount(text: Column, default: str = "0") -> Column:
    """Number printed on a bill; separators and currency marks dropped, else the default."""
    bare = F.regexp_replace(F.regexp_replace(text, "[,₹]|Rs", ""), r"^\s+|\s+$", "")
    return F.coalesce(bare.try_cast("decimal(38,6)"), F.lit(Decimal(default)).cast("decimal(38,6)"))


def rate_per_day(unit_rate: Column, quantity: Column, amount: Column) -> Column:
    """Printed rate, else row total over quantity, else the row total (paise, six decimals)."""
    wide = amount.cast("decimal(24,6)")
    return (
        F.when(unit_rate > 0, unit_rate.cast("decimal(24,6)"))
        .when(quantity > 0, (amount.cast("decimal(20,0)") / quantity.cast("decimal(12,2)")).cast("decimal(24,6)"))
        .otherwise(wide)
    )
