"""Scalar functions of radix partitioning and hashing as Spark columns, exact under ANSI arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiply-shift factors for keys of 32 and 64 bits.
FACTOR_32 = 2654435769
FACTOR_64 = 11400714819323198485
#: In-band marker of a missing key in files.
NULL_KEY = -1
_LOW = 0xFFFFFFFF


@dataclass(frozen=True)
class RadixBits:
    """Bits of up to three partitioning passes; pass 1 takes the lowest bits of the key."""

    passes: tuple[int, ...]

    def __post_init__(self):
        if not 1 <= len(self.passes) <= 3 or any(b < 0 for b in self.passes) or sum(self.passes) > 62:
            raise ValueError(f"one to three passes of non-negative bits, 62 together at most: {self.passes}")

    @classmethod
    def parse(cls, text: str) -> RadixBits:
        """From text such as "8,8"."""
        try:
            return cls(tuple(int(x) for x in text.split(",")))
        except ValueError as e:
            raise ValueError(f"radix bits must be one to three integers parted by commas: {text!r}") from e

    def ignored(self, number: int) -> int:
        """Bits that earlier passes have used up; passes count from 1."""
        return sum(self.passes[: number - 1])

    def fanout(self, number: int | None = None) -> int:
        return 1 << (sum(self.passes) if number is None else self.passes[number - 1])

    def partition_id(self, key: Column, number: int) -> Column:
        return partition_id(key, self.passes[number - 1], self.ignored(number))

    def combined_id(self, key: Column) -> Column:
        """One number for all passes; the first pass is its most significant part."""
        out = F.lit(0).cast("long")
        for k, bits in enumerate(self.passes, 1):
            out = F.shiftleft(out, bits) + self.partition_id(key, k)
        return out


def fanout(bits: int | Column) -> Column:
    return F.shiftleft(F.lit(1).cast("long"), bits) if isinstance(bits, int) else F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def partition_id(key: Column, bits: int, ignore: int = 0) -> Column:
    """Bits ignore .. ignore+bits-1 of the key's two's complement; null for a null key."""
    return F.shiftright(key.cast("long").bitwiseAND(F.lit(((1 << bits) - 1) << ignore)), ignore)


def multiply_shift_32(key: Column, bits: int) -> Column:
    """Upper `bits` of key * FACTOR_32 modulo 2**32, for 0 <= key < 2**31."""
    return F.shiftright((key.cast("long") * F.lit(FACTOR_32)).bitwiseAND(F.lit(_LOW)), 32 - bits)


def multiply_shift_64(key: Column, bits: int) -> Column:
    """Upper `bits` (1 to 32) of key * FACTOR_64 modulo 2**64, for 0 <= key < 2**31, by halves of the factor."""
    high, low = FACTOR_64 >> 32, FACTOR_64 & _LOW
    key = key.cast("long")
    upper = (F.shiftright(key * F.lit(low), 32) + key * F.lit(high)).bitwiseAND(F.lit(_LOW))
    return F.shiftright(upper, 32 - bits)


def _low_product(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 for 0 <= x < 2**32, by halves of 16 bits: no product exceeds 2**48."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    upper = F.shiftleft((high * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low * F.lit(factor) + upper).bitwiseAND(F.lit(_LOW))


def wrapped_product(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64 as a signed integer, for every 64-bit x; nothing overflows on the way."""
    high, low = factor >> 32, factor & _LOW
    xl, xh = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
    first, second = xl.bitwiseAND(F.lit(0xFFFF)) * F.lit(low), F.shiftright(xl, 16) * F.lit(low)
    lower = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    upper = F.shiftright(lower, 32) + F.shiftright(second, 16) + _low_product(xl, high) + _low_product(xh, low)
    return F.shiftleft(upper.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(lower.bitwiseAND(F.lit(_LOW)))


def multiply_shift_64_full(key: Column, bits: int) -> Column:
    """Upper `bits` of key * FACTOR_64 modulo 2**64 for every 64-bit key; null for null."""
    return F.shiftrightunsigned(wrapped_product(key.cast("long"), FACTOR_64), 64 - bits)


# Shifts and factors of Murmur3's avalanche steps.
MURMUR_32 = (16, 0x85EBCA6B, 13, 0xC2B2AE35, 16)
MURMUR_64 = (33, 0xFF51AFD7ED558CCD, 33, 0xC4CEB9FE1A85EC53, 33)


def murmur3_finalizer_32(key: Column) -> Column:
    """Murmur3's 32-bit avalanche step of each key's low 32 bits, as a signed integer; null for null."""
    a, f, b, g, c = MURMUR_32
    x = key.cast("long").bitwiseAND(F.lit(_LOW))
    x = _low_product(x.bitwiseXOR(F.shiftright(x, a)), f)
    x = _low_product(x.bitwiseXOR(F.shiftright(x, b)), g)
    x = x.bitwiseXOR(F.shiftright(x, c))
    return F.when(x >= 2**31, x - 2**32).otherwise(x).cast("int")


def murmur3_finalizer_64(key: Column) -> Column:
    """Murmur3's 64-bit avalanche step of each key; null for null."""
    a, f, b, g, c = MURMUR_64
    x = key.cast("long")
    x = wrapped_product(x.bitwiseXOR(F.shiftrightunsigned(x, a)), f)
    x = wrapped_product(x.bitwiseXOR(F.shiftrightunsigned(x, b)), g)
    return x.bitwiseXOR(F.shiftrightunsigned(x, c))


def log2_floor(x: Column) -> Column:
    """Floor of the binary logarithm of a positive integer."""
    return F.length(F.bin(x)) - 1


def log2_ceil(x: Column) -> Column:
    """Ceiling of the binary logarithm of a positive integer."""
    return F.when(x > 1, F.length(F.bin(x - 1))).otherwise(0)


def from_sentinel(key: Column) -> Column:
    """Null instead of the in-band marker."""
    return F.nullif(key, F.lit(NULL_KEY))


def to_sentinel(key: Column) -> Column:
    return F.coalesce(key, F.lit(NULL_KEY))


def narrow_key(key: Column, kind: str = "int", strict: bool = True) -> Column:
    """The key as a narrower integer; out of range raises, or is null when not strict."""
    return key.cast(kind) if strict else key.try_cast(kind)


def day_number(day: Column) -> Column:
    """Days since 1992-01-01."""
    return F.datediff(day, F.to_date(F.lit("1992-01-01")))
