"""SimHash fingerprints and pigeonhole blocks as Spark expressions; no Python runs on the executors.

A fingerprint has 63 bits.  Bits of word hashes are added up three at a time in
lanes of 21 bits, so 21 sums give all 63 counts, and all three are compared with
half the number of words at once.  A set may have up to 262,143 words (with more,
lanes run over: equal sets still have equal fingerprints).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS, LANES = 63, 21
_MASK = 1 | 1 << LANES | 1 << 2 * LANES


def lane(hashed: Column, i: int) -> Column:
    """The bits i, i + 21 and i + 42 of a hash, each in its own lane."""
    return F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(_MASK))


def from_sums(sums: list[Column], n: Column) -> Column:
    """The fingerprint of n word hashes, given the sums of their lanes: a bit is set where more than half have it.

    2**20 + 2 * count - (n + 1) has bit 20 set just where 2 * count > n, in every lane by itself.
    """
    most = F.lit(_MASK << (LANES - 1)) - (n.cast("long") + 1) * F.lit(_MASK)
    out = F.lit(0).cast("long")
    for i, s in enumerate(sums):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(most + s * 2, LANES - 1).bitwiseAND(F.lit(_MASK)), i))
    return out


def of_words(words: Column) -> Column:
    """The fingerprint of an array of words, each as often as it is there (for few rows: each sum is a loop over the array)."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def total(i: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + lane(h, i))

    return from_sums([total(i) for i in range(LANES)], F.size(words))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def spans(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of that many blocks of a fingerprint."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def block_keys(fingerprint: Column, blocks: int, agree: int) -> Column:
    """An array of keys, one for each choice of `agree` blocks: fingerprints that differ in at most
    blocks - agree bits have a key in common."""
    keys = []
    for number, chosen in enumerate(combinations(spans(blocks), agree)):
        key = F.lit(number).cast("long")
        for first, bits in chosen:
            key = key * (1 << bits) + F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        keys.append(key)
    return F.array(*keys)
