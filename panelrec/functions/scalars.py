"""Scalar expressions: cleaning rules, calendar, money, gates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelrec.config import NULL_TOKENS, SEASONS


def blank_to_null(text: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trim and turn the null tokens into null."""
    return F.when(~F.trim(text).isin(*tokens), F.trim(text))


def safe_int(text: Column) -> Column:
    return text.try_cast("int")


def safe_double(text: Column) -> Column:
    return text.try_cast("double")


def safe_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(text, pattern)


def recoded(value: Column, codes: dict[str, str], default: str) -> Column:
    out = None
    for source, target in codes.items():
        out = F.when(value == source, target) if out is None else out.when(value == source, target)
    return out.otherwise(default)


def floor_zero(text: Column) -> Column:
    """Negative, null and unreadable counts become 0."""
    return F.greatest(F.coalesce(safe_int(text), F.lit(0)), F.lit(0))


def code_text(text: Column, default: str) -> Column:
    """Drop a trailing ``.0`` and fill nulls."""
    return F.coalesce(F.regexp_replace(text, r"\.0$", ""), F.lit(default))


def yes_flag(text: Column, yes: str = "S") -> Column:
    return F.when(F.upper(text) == yes, 1).otherwise(0).cast("tinyint")


def flag_or_zero(text: Column, kind: str = "int") -> Column:
    return F.coalesce(safe_int(text), F.lit(0)).cast(kind)


def months_since(later: Column, earlier: Column) -> Column:
    """Whole months by calendar plus day difference over 31, to one decimal."""
    return F.round(
        (F.year(later) - F.year(earlier)) * 12.0
        + (F.month(later) - F.month(earlier))
        + (F.dayofmonth(later) - F.dayofmonth(earlier)) / F.lit(31.0),
        1,
    )


def age_at_join(age: Column, tenure_months: Column) -> Column:
    return F.round(age.cast("double") - tenure_months.cast("double") / 12.0, 1)


def ratio_or_one(value: Column, reference: Column) -> Column:
    return F.when(reference > 0, value / reference).otherwise(1.0)


def calendar(day: Column) -> dict[str, Column]:
    """Month number, its yearly cycle and the season flags."""
    month = F.month(day)
    angle = F.lit(2 * math.pi) * month / 12.0
    out = {
        "snap_month": month,
        "sin_month": F.round(F.sin(angle), 4),
        "cos_month": F.round(F.cos(angle), 4),
    }
    for name, months in SEASONS.items():
        out[name] = F.when(month.isin(*months), 1).otherwise(0).cast("tinyint")
    return out


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def odds(top: Column, hold: Column, eps_mode: str = "floor") -> Column:
    """Top item probability over the hold probability.

    ``floor`` bounds the divisor below by 1e-8, ``add`` adds 1e-9 to it.
    """
    if eps_mode == "floor":
        return top / F.greatest(hold, F.lit(1e-8))
    if eps_mode == "add":
        return top / (hold + 1e-9)
    raise ValueError(f"unknown eps_mode {eps_mode}")


def fires(value: Column, threshold: Column, strict: bool = True) -> Column:
    return value > threshold if strict else value >= threshold


def draw_key(seed: int, *keys: Column) -> Column:
    """Uniform, reproducible ordering key of a row: md5 of seed and row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw_unit(seed: int, *keys: Column) -> Column:
    """Reproducible uniform number in [0, 1) from the first 13 hex digits."""
    head = F.conv(F.substring(draw_key(seed, *keys), 1, 13), 16, 10).cast("double")
    return head / F.lit(float(16 ** 13))


def inverse_normal(p: Column) -> Column:
    """Normal quantile by the published rational approximation (error below 1.2e-9)."""
    # Fixed coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00, 1.0)

    def horner(coefs: Sequence[float], x: Column) -> Column:
        acc: Column = F.lit(coefs[0])
        for coef in coefs[1:]:
            acc = acc * x + F.lit(coef)
        return acc

    centre = p - 0.5
    square = centre * centre
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    return (
        F.when(p < 0.02425, horner(c, low) / horner(d, low))
        .when(p > 1 - 0.02425, -horner(c, high) / horner(d, high))
        .otherwise(horner(a, square) * centre / horner(b, square))
    )
