"""Portable uniform numbers and orders: the same on any engine, partitioning and run."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 of the keys joined by '|'. Strings that aren't columns: pass F.lit."""
    return F.conv(_digits(keys), 16, 10).cast("long") / F.lit(float(1 << 52))


def _digits(keys) -> Column:
    cols = [F.lit(str(k)) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k) for k in keys]
    return F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 13)


def below(share: float, *keys: Column | str | int) -> Column:
    """uniform(*keys) < share, by the digits of the hash alone: no number is made of them."""
    least = math.ceil(share * (1 << 52))
    return F.lit(least > 0) if not 0 < least < 1 << 52 else _digits(keys) < F.lit(f"{least:013x}")


def pick(u: Column, values: list[str]) -> Column:
    """One of the values, each with the same chance."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def box_muller(u1: Column, u2: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-300)))) * F.cos(2 * F.pi() * u2)
