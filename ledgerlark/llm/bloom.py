"""Bloom filters built and asked by DataFrame expressions: plain bitmaps as binary literals."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a chunk; a chunk is one aggregate row.
_CHUNK_BITS = 32768
#: A filter goes into the expression, so its size is bounded.
MAX_FILTER_BYTES = 64 << 20


def _positions(key: Column, salt: int, bits: int, hashes: int) -> list[Column]:
    """Bit positions of a key by double hashing (31-bit halves, so nothing overflows)."""
    half = F.lit(1 << 31).cast("long")
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * salt + i)), half) for i in (0, 1))
    return [F.pmod(a + b * F.lit(i).cast("long"), F.lit(bits).cast("long")) for i in range(hashes)]


@dataclass(frozen=True)
class Filter:
    """Bit i is bit i % 8 of byte i // 8 of data."""

    salt: int
    bits: int
    hashes: int
    data: bytes

    def passes(self, key: Column) -> Column:
        passed = F.lit(True)
        for at in _positions(key, self.salt, self.bits, self.hashes):
            byte = F.conv(F.hex(F.substring(F.lit(self.data), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
            passed &= F.getbit(byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1
        return passed


def filter_bytes(n: int, rate: float) -> int:
    return math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 8)


def build_filter(keys: DataFrame, rate: float, salt: int = 0, n: int | None = None) -> Filter:
    """Filter over the column `key`; positions are combined on the map side."""
    n = keys.count() if n is None else n
    if filter_bytes(n, rate) > MAX_FILTER_BYTES:
        raise ValueError(f"a filter over {n} keys is over the limit; split them and filter each part")
    bits = max(64, 8 * filter_bytes(n, rate))
    hashes = min(16, max(1, round(bits / max(n, 1) * math.log(2))))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), salt, bits, hashes))).alias("at"))
    chunks = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("map"))
    data = bytearray(-(-bits // _CHUNK_BITS) * _CHUNK_BITS // 8)
    for row in chunks.collect():  # MAX_FILTER_BYTES at most
        start = (row["chunk"] - 1) * _CHUNK_BITS // 8
        data[start : start + len(row["map"])] = row["map"]
    return Filter(salt, bits, hashes, bytes(data[: -(-bits // 8)]))
