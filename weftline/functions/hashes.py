"""Hashes and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.urls import canonical_url

#: Offset bases and primes of the published FNV-1a algorithm.
FNV64_HIGH, FNV64_LOW = 0xCBF29CE4, 0x84222325
FNV64_PRIME_LOW = 0x1B3  # the prime is 2^40 + 0x1B3
FNV32, FNV32_PRIME = 0x811C9DC5, 0x01000193
MASK = 0xFFFFFFFF


def _bytes(text: Column) -> Column:
    """The bytes of a string as an array of ints."""
    raw = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.greatest(F.length(raw) - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(raw, i, F.lit(2)), 16, 10).cast("long"))


def fnv64(text: Column) -> Column:
    """FNV-1a as struct(high, low) of its 32-bit halves: no unsigned type is needed."""
    start = F.struct(F.lit(FNV64_HIGH).cast("long").alias("high"), F.lit(FNV64_LOW).cast("long").alias("low"))

    def step(h: Column, byte: Column) -> Column:
        low = h["low"].bitwiseXOR(byte)
        carry = F.shiftright(low * FNV64_PRIME_LOW, 32)
        shifted = F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)  # the prime's 2^40 moves the low half up by 8 bits
        high = (h["high"] * FNV64_PRIME_LOW + carry + shifted).bitwiseAND(F.lit(MASK))
        return F.struct(high.alias("high"), (low * FNV64_PRIME_LOW).bitwiseAND(F.lit(MASK)).alias("low"))

    return F.aggregate(_bytes(text), start, step)


def fnv64_hex(text: Column) -> Column:
    """16 lower-case digits."""
    h = fnv64(text)
    return F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")))


def fnv64_signed(text: Column) -> Column:
    """The bit pattern as a long."""
    h = fnv64(text)
    return F.shiftleft(h["high"], 32).bitwiseOR(h["low"])


def fnv32(text: Column) -> Column:
    """FNV-1a of 32 bits, unsigned in a long."""
    return F.aggregate(_bytes(text), F.lit(FNV32).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(F.lit(MASK)))


def sample_fraction(text: Column) -> Column:
    """A stable number in [0, 1) for a path."""
    return fnv32(text) / F.lit(float(1 << 32))


def shard(text: Column, shards: int) -> Column:
    """FNV-1a modulo the number of shards, unsigned."""
    h = fnv64(text)
    return (((h["high"] % shards) * ((1 << 32) % shards) + h["low"] % shards) % shards).cast("int")


def document_id(url: Column) -> Column:
    """FNV-1a of the canonical URL, 16 digits."""
    return fnv64_hex(canonical_url(url))


def markdown_doc_id(url: Column) -> Column:
    """The first 16 bytes of the URL's SHA-256, in hexadecimal."""
    return F.substring(F.sha2(url, 256), 1, 32)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sha1_base32(data: Column) -> Column:
    """`sha1:` and the 32 base32 digits of the SHA-1 of a text or binary, as archives name contents."""
    digest, digits = F.sha1(data), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = [F.conv(F.substring(digest, at, 5), 16, 10).cast("int") for at in range(1, 41, 5)]  # 20 bits each
    return F.concat(F.lit("sha1:"), *[F.substr(digits, F.shiftright(part, bits).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for part in parts for bits in (15, 10, 5, 0)])
