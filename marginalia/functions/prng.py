"""Counter-based random numbers as Column expressions (32-bit arithmetic in BIGINT)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Fixed value: increment of the mulberry32 generator.
STEP = 0x6D2B79F5


def mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product; one factor is split so that ANSI mode never overflows."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    return (low * b + (high * b).bitwiseAND(F.lit(0xFFFF)) * 65536).bitwiseAND(F.lit(MASK))


def mulberry32(seed: Column, draw: Column) -> Column:
    """Draw number ``draw`` (from 1) of the generator, as an unsigned 32-bit BIGINT."""
    a = (seed + mul32(draw.cast("long").bitwiseAND(F.lit(MASK)), F.lit(STEP))).bitwiseAND(F.lit(MASK))
    t = mul32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + mul32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14))


def mulberry32_block(seed: int, count: int) -> np.ndarray:
    """Draws 1 to ``count`` of the generator."""
    mask, u = np.uint64(MASK), np.uint64
    a = (u(seed & MASK) + np.arange(1, count + 1, dtype=np.uint64) * u(STEP)) & mask
    t = (a ^ (a >> u(15))) * (a | u(1)) & mask
    t ^= (t + ((t ^ (t >> u(7))) * (t | u(61)) & mask)) & mask
    return t ^ (t >> u(14))
