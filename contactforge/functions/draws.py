"""Random draws as pure functions of (seed, name of the decision, keys).

Nothing depends on partitioning or on the order of rows: any row can be computed again alone, on any executor, and in
another SQL engine. A draw is the first 32 bits of an MD5 digest, divided by 2**32, so it lies in [0, 1).
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def digest(seed: int, name: str, *keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{name}"), *(_column(k).cast("string") for k in keys)))


def part(hexed: Column, n: int) -> Column:
    """The n-th of a digest's four 32-bit parts as a number in [0, 1)."""
    return F.conv(F.substring(hexed, 8 * n + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def unit(seed: int, name: str, *keys) -> Column:
    """Uniform in [0, 1)."""
    return part(digest(seed, name, *keys), 0)


def below(u: Column, high) -> Column:
    """Uniform integer in [0, high) from a unit draw."""
    return F.floor(u * (high if isinstance(high, Column) else F.lit(high))).cast("long")


def normal(seed: int, name: str, *keys) -> Column:
    """Standard normal (Box and Muller). |z| < 6.67, as u is at least 2**-32 away from 1."""
    hexed = digest(seed, name, *keys)
    return F.sqrt(-2.0 * F.log(1.0 - part(hexed, 0))) * F.cos(2.0 * F.pi() * part(hexed, 1))


#: Bound of ``normal``.
NORMAL_BOUND = 6.67


def nucleotide(u: Column) -> Column:
    return F.substring(F.lit("ACGT"), below(u, 4).cast("int") + 1, F.lit(1))


def other_nucleotide(u: Column, base: Column) -> Column:
    """One of the three other bases; ``base`` must be one of ACGT."""
    rest = F.replace(F.lit("ACGT"), base, F.lit(""))
    return F.substring(rest, below(u, 3).cast("int") + 1, F.lit(1))


def symbols(u: Column, alphabet: str) -> Column:
    """One symbol of an alphabet."""
    return F.substring(F.lit(alphabet), below(u, len(alphabet)).cast("int") + 1, F.lit(1))


#: Multipliers of a public 32-bit integer mix; both are below 2**31, so that products fit into 63 bits everywhere.
MIX = (0x21F0AAAD, 0x735A2D97)


def mixed(x):
    """The mix of a number from 0 to 2**32 - 1, as a column."""
    low = F.lit(0xFFFFFFFF).cast("long")
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    x = (x * MIX[0]).bitwiseAND(low)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 15))
    x = (x * MIX[1]).bitwiseAND(low)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 15))


def counted(keys: Column, k: Column) -> Column:
    """Draw number ``k`` in [0, 1) of a stream whose two 32-bit keys are in a digest: many draws from one digest."""
    key = lambda n: F.conv(F.substring(keys, 8 * n + 1, 8), 16, 10).cast("long")
    x = mixed(key(0).bitwiseXOR(k.cast("long"))) + key(1)
    return mixed(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) / 4294967296.0


def counted_array(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    """``counted`` for arrays: keys of shape (n, 2)."""
    def mix(x):
        x = x ^ (x >> np.uint32(16))
        x = x * np.uint32(MIX[0])
        x = x ^ (x >> np.uint32(15))
        x = x * np.uint32(MIX[1])
        return x ^ (x >> np.uint32(15))

    return mix(mix(keys[:, 0] ^ k.astype(np.uint32)) + keys[:, 1]) / 4294967296.0
