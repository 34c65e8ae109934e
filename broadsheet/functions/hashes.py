"""Identifier hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def fnv1a_base36(c) -> Column:
    """FNV-1a over UTF-16 units, 32 bits, base 36 in lower case."""
    raw = F.encode(col(c), "UTF-16BE")
    positions = F.sequence(F.lit(1), F.octet_length(raw), F.lit(2))
    units = F.transform(positions, lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(2))), 16, 10).cast("long"))
    state = F.aggregate(
        F.when(F.octet_length(raw) > 0, units).otherwise(F.array().cast("array<bigint>")),
        F.lit(2166136261).cast("long"),
        lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(16777619), F.lit(1 << 32)))
    return F.lower(F.conv(state.cast("string"), 10, 36))


def client_hash(c) -> Column:
    """First 12 bytes of the SHA-256 digest in hex."""
    return F.substring(F.sha2(col(c), 256), 1, 24)
