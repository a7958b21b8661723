"""Noise from a hash of the coordinates, so it does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import COLORS, clamp8, idiv, require
from .tone import apply_in_region

# A Mersenne prime modulus and one odd multiplier per coordinate.
MODULUS = 2147483647
MULTIPLIERS = {"image_id": 7919, "y": 104729, "x": 1299709}
CHANNEL_STEP = 15485863
SEED_STEP = 32452843


def coordinate_hash(channel: int, seed: int) -> Column:
    """Quadratic mix modulo a prime; every product stays below 2^62."""
    mixed = F.lit(channel * CHANNEL_STEP + seed * SEED_STEP).cast("bigint")
    for name, k in MULTIPLIERS.items():
        mixed = mixed + (F.col(name).cast("bigint") % MODULUS) * k
    first = F.pmod(mixed, F.lit(MODULUS))
    inner = (first * 48271 + 11) % MODULUS
    return (first * inner + inner) % MODULUS


def _noise(df: DataFrame, frequency: int, changed, seed: int, region) -> DataFrame:
    require(0 <= frequency <= 100, "frequency is a percentage")
    changes = {}
    for i, c in enumerate(COLORS):
        h = coordinate_hash(i, seed)
        strike = h % 100 < frequency
        rest = idiv(h, 100)
        sign = F.when(rest % 2 == 1, 1).otherwise(-1)
        unit = idiv(rest, 2) % 1000  # thousandths, in [0, 1)
        changes[c] = F.when(strike, changed(F.col(c), sign, unit)).otherwise(F.col(c))
    return apply_in_region(df, changes, region)


def noise_additive(
    df: DataFrame, frequency: int, amount: int, seed: int = 1, region: Column | None = None
) -> DataFrame:
    """c +/- 255 * amount% * U."""
    change = lambda c, s, u: clamp8(c + s * idiv(u * (255 * amount), 100_000))
    return _noise(df, frequency, change, seed, region)


def noise_multiplicative(
    df: DataFrame, frequency: int, amount: int, seed: int = 1, region: Column | None = None
) -> DataFrame:
    """c +/- c * amount% * U."""
    change = lambda c, s, u: clamp8(c + s * idiv(c * u * amount, 100_000))
    return _noise(df, frequency, change, seed, region)


def noise_salt_pepper(
    df: DataFrame, frequency: int, seed: int = 1, region: Column | None = None
) -> DataFrame:
    change = lambda c, s, u: F.when(s > 0, 255).otherwise(0)
    return _noise(df, frequency, change, seed, region)
