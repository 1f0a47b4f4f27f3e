"""Repeatable pseudo-random order that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import dtype_of, is_integral, ref

# Both multipliers are odd, so every step is one-to-one below 2**31, and no
# product leaves 64 bits.
MULTIPLIER = 2654435761
SECOND_MULTIPLIER = 1540483477
MODULUS = 4294967296
KEY_RANGE = 2147483648


def spread(key: Column, seed: int = 0) -> Column:
    """Hash of an integer key into [0, 2**32): multiply, fold the high bits in, multiply.

    The middle step matters: without it another seed would only rotate the order, and
    folds would line up with the split. Bits from the 32nd on are multiplied and folded into
    the lower 31 first, so keys that differ only there are spread as well.
    """
    low = F.lit(KEY_RANGE - 1)
    key = key.cast("bigint")
    upper = F.shiftrightunsigned(key, 31)
    upper = upper.bitwiseAND(low).bitwiseXOR(F.shiftright(upper, 31)) * F.lit(SECOND_MULTIPLIER)
    k = key.bitwiseAND(low).bitwiseXOR(upper.bitwiseAND(low)) + F.lit(seed)
    h = F.pmod(k * F.lit(MULTIPLIER), F.lit(MODULUS))
    return F.pmod(h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(SECOND_MULTIPLIER), F.lit(MODULUS))


def row_order(df: DataFrame, key: str, seed: int = 0) -> Column:
    """Hash of the row key: arithmetic for integers, xxhash64 otherwise. Rows without a key come last."""
    if is_integral(dtype_of(df, key)):
        return F.coalesce(spread(ref(key), seed), F.lit(MODULUS - 1))
    return F.when(ref(key).isNull(), F.lit((1 << 63) - 1)).otherwise(F.xxhash64(ref(key), F.lit(seed)))


def slot(df: DataFrame, key: str, n: int, seed: int = 0) -> Column:
    """One of n slots from the leading bits of the row hash; all rows without a key share the last slot."""
    unit = F.pmod(row_order(df, key, seed), F.lit(MODULUS)).cast("double") / F.lit(float(MODULUS))
    return F.floor(unit * n).cast("int")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the leading 32 bits of an md5 over the parts."""
    digest = F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(MODULUS))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The n rows first in hash order: the same rows on any partitioning."""
    return df.orderBy(row_order(df, key, seed), ref(key)).limit(n)
