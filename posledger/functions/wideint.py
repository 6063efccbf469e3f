"""Exact integer arithmetic on on-chain quantities.

Narrow path: DECIMAL(38,0) expressions, for columns declared to have at most 38 digits. ANSI mode makes
an overflow an error. Wide path: sums run on signed limbs of 26 digits, so an additive fold of the declared
width (78 digits for an event's amount, 156 for a value; more is an error) is an ordinary partial aggregation; products and quotients of wide values are Python integers in
Arrow functions over digit strings (``integers``), since Spark has no exact type beyond 38 digits.
Callers choose by declared width, never by looking at values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The protocol's scales and bounds.
RAY = 10**27
BPS = 10_000
YEAR_SECONDS = 31_536_000
VIRTUAL = 10**6
RAY_DIGITS, ORACLE_DIGITS, VALUE_DIGITS = 27, 8, 26

DEC = "decimal(38,0)"
#: Digits of a limb, and limbs of an event's amount: 78 digits hold 256 bits. Values in dollars are products of three and have more.
LIMB, LIMBS, VALUE_LIMBS = 26, 3, 6


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda variable is, where a repeated expression would be repeated."""
    return F.element_at(F.transform(F.array(value), use), 1)


def num(value) -> Column:
    """A column, or an integer literal of up to 38 digits, as DECIMAL(38,0)."""
    return value.cast(DEC) if isinstance(value, Column) else F.lit(str(value)).cast(DEC)


def fail(message: str, kind: str = DEC) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def div_down(p: Column, d: Column) -> Column:
    """floor(p / d) for p >= 0 and d > 0; the division is made exact first, since decimal division rounds.

    A quotient has 32 digits before the point at most, so small divisors take the upper and the lower 19 digits in turn.
    """
    half, p, d = num(10**19), num(p), num(d)

    def exact(x, y):
        return ((x - x % y) / y).cast(DEC)

    def by_halves(x):
        low = (x % half).cast(DEC)
        high = exact(x, half)
        return (exact(high, d) * half + exact(((high % d) * half + low).cast(DEC), d)).cast(DEC)

    return F.when(d >= 10**6, exact(p, d)).otherwise(by_halves(p))


def div_up(p: Column, d: Column) -> Column:
    return (div_down(p, d) + F.when(p % d > 0, 1).otherwise(0)).cast(DEC)


def mul(a: Column, b: Column) -> Column:
    return (num(a) * num(b)).cast(DEC)


def product(a: Column, b: Column) -> Column:
    """The digits of a * b for two values of 0 to 38 digits, by limbs of 13 digits: no partial sum leaves 38 digits."""
    unit, size = num(10**13), 13

    def split(x, name):
        low = (x % unit).cast(DEC)
        rest = ((x - low) / unit).cast(DEC)
        middle = (rest % unit).cast(DEC)
        return low.alias(f"{name}0"), middle.alias(f"{name}1"), ((rest - middle) / unit).cast(DEC).alias(f"{name}2")

    def convolve(t):
        pairs = [[(i, k - i) for i in range(3) if 0 <= k - i < 3] for k in range(5)]
        sums = [sum(((t[f"a{i}"] * t[f"b{j}"]).cast(DEC) for i, j in p[1:]), (t[f"a{p[0][0]}"] * t[f"b{p[0][1]}"]).cast(DEC)).cast(DEC) for p in pairs]

        def step(acc, c):
            total = (acc["carry"] + c).cast(DEC)
            digit = (total % unit).cast(DEC)
            return F.struct(((total - digit) / unit).cast(DEC).alias("carry"), F.concat(F.lpad(digit.cast("string"), size, "0"), acc["text"]).alias("text"))

        start = F.struct(num(0).alias("carry"), F.lit("").alias("text"))
        return F.aggregate(F.array(*sums), start, step, lambda r: F.concat(F.lpad(r["carry"].cast("string"), size, "0"), r["text"]))

    return bound(F.struct(num(a).alias("a"), num(b).alias("b")), lambda t: bound(F.struct(*split(t["a"], "a"), *split(t["b"], "b")), convolve))


def ray_mul_up(a: Column, b: Column) -> Column:
    """ceil(a * b / RAY): RAY is a power of ten, so the quotient is the product's digits but the last 27."""
    keep = 6 * 13 - RAY_DIGITS

    def rounded(digits):
        whole = F.regexp_replace(F.substring(digits, 1, keep), "^0+(?=[0-9])", "").cast(DEC)
        return (whole + F.when(F.substring(digits, keep + 1, RAY_DIGITS) != "0" * RAY_DIGITS, 1).otherwise(0)).cast(DEC)

    return bound(product(a, b), rounded)


def from_ray_up(a: Column) -> Column:
    return div_up(num(a), num(RAY))


def percent_mul_down(value: Column, bps: Column) -> Column:
    return div_down(mul(value, bps), num(BPS))


def mul_div_down(a: Column, b: Column, d: Column) -> Column:
    return div_down(mul(a, b), num(d))


def linear_interest(rate: Column, seconds: Column) -> Column:
    """RAY + floor(rate * seconds / year); a negative time is an error."""
    growth = div_down(mul(rate, seconds), num(YEAR_SECONDS))
    return F.when(seconds < 0, fail("valuation instant before the checkpoint")).otherwise((num(RAY) + growth).cast(DEC))


def premium_ray(shares: Column, offset: Column, index: Column) -> Column:
    owed = (mul(shares, index) - num(offset)).cast(DEC)
    return F.when(owed < 0, fail("negative premium")).otherwise(owed)


def limbs(text: Column, count: int = LIMBS) -> list[Column]:
    """Signed limbs of a decimal string, lowest first; more digits than ``count`` limbs hold are an error.

    What fits the lowest limb is only cast, and the others are null: a sum passes over them.
    """
    size = F.length(text)
    minus = F.startswith(text, F.lit("-"))
    digits = F.lpad(F.regexp_replace(text, "^-?0*", ""), count * LIMB, "0")
    most = F.when(F.length(F.regexp_replace(text, "^-?0*", "")) > count * LIMB, fail(f"more than {count * LIMB} digits"))
    sign = F.when(minus, -1).otherwise(1)
    long = [(F.substring(digits, 1 + LIMB * k, LIMB).cast(DEC) * sign).cast(DEC) for k in range(count - 1, -1, -1)]
    long[0] = F.coalesce(most, long[0])
    return [F.when(size <= LIMB, text.cast(DEC) if k == 0 else F.lit(None).cast(DEC)).otherwise(x) for k, x in enumerate(long)]


def limb(text: str, scale: str = "scale", negative: str = "false", count: int = LIMBS) -> str:
    """SQL of one signed limb of a column of digit strings, at most ``count`` limbs long: the one that column ``scale`` numbers from the lowest.

    Null where the string ends below it; where ``negative`` holds the other sign.
    """
    minus = f"startswith({text}, '-')"
    part = f"CAST(substr(lpad(substr({text}, if({minus}, 2, 1)), {count * LIMB}, '0'), {1 + (count - 1) * LIMB} - {scale} * {LIMB}, {LIMB}) AS {DEC})"
    value = f"CASE WHEN length({text}) <= {LIMB} THEN if({scale} = 0, CAST({text} AS {DEC}), NULL) WHEN {minus} THEN -{part} ELSE {part} END"
    return f"CAST(if({negative}, -1, 1) * ({value}) AS {DEC})"


def joined_columns(*names: str) -> Column:
    """As ``joined``, of named columns and as one expression."""
    unit, zero = f"CAST('1{'0' * LIMB}' AS {DEC})", f"CAST(0 AS {DEC})"
    x = f"CAST(acc.carry + coalesce(p, {zero}) AS {DEC})"
    low = f"CAST(pmod({x}, {unit}) AS {DEC})"
    other = f"CASE WHEN acc.seen THEN {unit} - 1 - {low} WHEN {low} = 0 THEN {zero} ELSE {unit} - {low} END"
    pad = lambda v: f"lpad(CAST(CAST({v} AS {DEC}) AS string), {LIMB}, '0')"
    step = f"named_struct('carry', CAST(({x} - {low}) / {unit} AS {DEC}), 'text', concat({pad(low)}, acc.text), 'other', concat({pad(other)}, acc.other), 'seen', acc.seen OR {low} > 0)"
    plain = lambda t: f"regexp_replace({t}, '^0+(?=[0-9])', '')"
    below = f"concat('-', {plain(f'concat(CAST(CAST(if(acc.seen, -acc.carry - 1, -acc.carry) AS {DEC}) AS string), acc.other)')})"
    digits = f"if(acc.carry < 0, {below}, {plain('concat(CAST(acc.carry AS string), acc.text)')})"
    start = f"named_struct('carry', {zero}, 'text', '', 'other', '', 'seen', false)"
    narrow = " AND ".join(f"coalesce({n}, {zero}) = 0" for n in names[1:])
    return F.expr(f"CASE WHEN {narrow} THEN CAST(coalesce({names[0]}, {zero}) AS string) ELSE aggregate(array({', '.join(names)}), {start}, (acc, p) -> {step}, acc -> {digits}) END")


def joined(*parts: Column) -> Column:
    """The decimal string of sums of limbs, lowest first, which may have any sign and more than 26 digits each; null is 0."""
    unit, zero = num(10**LIMB), num(0)

    def step(acc, part):
        """Carry on, keeping the digits so far and those of the negative, whose limbs are complements above the first that isn't 0."""
        x = (acc["carry"] + F.coalesce(part, zero)).cast(DEC)
        low = F.pmod(x, unit).cast(DEC)
        other = F.when(acc["seen"], unit - 1 - low).when(low == 0, zero).otherwise(unit - low).cast(DEC)
        pad = lambda v: F.lpad(v.cast("string"), LIMB, "0")
        return F.struct(
            ((x - low) / unit).cast(DEC).alias("carry"), F.concat(pad(low), acc["text"]).alias("text"), F.concat(pad(other), acc["other"]).alias("other"), (acc["seen"] | (low > 0)).alias("seen"),
        )

    def digits(acc):
        top = F.when(acc["seen"], -acc["carry"] - 1).otherwise(-acc["carry"])
        plain = lambda text: F.regexp_replace(text, "^0+(?=[0-9])", "")
        below = F.concat(F.lit("-"), plain(F.concat(top.cast(DEC).cast("string"), acc["other"])))
        return F.when(acc["carry"] < 0, below).otherwise(plain(F.concat(acc["carry"].cast("string"), acc["text"])))

    start = F.struct(zero.alias("carry"), F.lit("").alias("text"), F.lit("").alias("other"), F.lit(False).alias("seen"))
    narrow = F.lit(True)
    for p in parts[1:]:
        narrow = narrow & (F.coalesce(p, zero) == 0)
    return F.when(narrow, F.coalesce(parts[0], zero).cast("string")).otherwise(F.aggregate(F.array(*parts), start, step, digits))


class Unvalued(ValueError):
    """Why a row has no value; it is told in the row and stops no other."""


def integers(function, fields: tuple):
    """An Arrow function over digit strings.

    ``function`` gets the Python integers of a row (None for null) and returns one for each of ``fields``, or raises
    ``Unvalued``. The result is a struct of strings: the fields, null where there is no value, and ``reason``, null where there is.
    """

    @F.pandas_udf(", ".join(f"{x} string" for x in (*fields, "reason")))
    def over_rows(*columns: pd.Series) -> pd.DataFrame:
        rows = []
        for row in zip(*[[x if x is None else int(x) for x in c] for c in columns]):
            try:
                rows.append((*[None if x is None else str(x) for x in function(*row)], None))
            except Unvalued as why:
                rows.append((*[None] * len(fields), str(why)))
        return pd.DataFrame(rows, columns=[*fields, "reason"], dtype=object)

    return lambda *columns: over_rows(*[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in columns])


def _quotient(a, b, d):
    return (None if a is None or b is None or d is None else a * b // d,)


def _value(amount, decimals, price):
    if amount is None or decimals is None or price is None:
        return (None,)
    return (amount * price * 10 ** (18 - decimals) if decimals <= 18 else amount * price // 10 ** (decimals - 18),)


def mul_div_wide(a, b, d) -> Column:
    """floor(a * b / d) of digit strings of any width; null where any is null."""
    return integers(_quotient, ("x",))(a, b, d)["x"]


def value_wide(amount, decimals, price) -> Column:
    """As ``to_value``, of any width and as digits; null where any is null."""
    return integers(_value, ("x",))(amount, decimals, price)["x"]


def sums_wide(values: dict) -> list[Column]:
    """Aggregates of named lists of limbs; ``joined_sums`` makes digits of them."""
    return [F.sum(v).cast(DEC).alias(f"_{n}_{k}") for n, column in values.items() for k, v in enumerate(column)]


def joined_sums(name: str, count: int = LIMBS) -> Column:
    return joined(*[F.col(f"_{name}_{k}") for k in range(count)])


def to_value(amount: Column, decimals: Column, price: Column) -> Column:
    """amount * price * 10**(18 - decimals), floored; 10**26 is one dollar."""
    up = F.rpad(F.lit("1"), (F.lit(19) - F.least(decimals, F.lit(18))).cast("int"), F.lit("0")).cast(DEC)
    down = F.rpad(F.lit("1"), (F.greatest(decimals, F.lit(18)) - 17).cast("int"), F.lit("0")).cast(DEC)
    return div_down(mul(mul(amount, price), up), down)


def to_decimal(value: Column, decimals: Column) -> Column:
    """Base units as an exact decimal string: no trailing zeros, sign in front; no decimals pass the value through."""
    text = value.cast("string")
    plain = F.regexp_replace(text, "^-", "")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    n = decimals.cast("int")
    padded = F.lpad(plain, F.greatest(F.length(plain), n + 1), F.lit("0"))
    whole = F.substr(padded, F.lit(1), F.length(padded) - n)
    part = F.rtrim(F.substr(padded, F.length(padded) - n + 1), F.lit("0"))
    scaled = F.concat(sign, whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(n <= 0, text).otherwise(scaled)
