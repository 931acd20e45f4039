"""Vectors as columns: feature-hashed text, norms, cosine, sign signatures over fixed hyperplanes, probe masks."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Embedding width, number of hyperplanes, seed of the hyperplanes.
DIM = 128
PLANES = 12
SEED = 42


_WORD = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))


def _powers() -> np.ndarray:
    """31**i modulo 256 repeats with period 8; entry i also inverts entry -i."""
    return np.array([pow(31, i, 256) for i in range(8)], dtype=np.uint8)


def _slot_weights(texts: list[str], dim: int) -> np.ndarray:
    """Token counts of lowercased texts hashed into ``dim`` slots: 4 at the token's slot, 1 at its second slot.

    All tokens of a batch are hashed at once. The string hash sum(c * 31**(n-1-i)) modulo a power of two only needs
    running sums of c * 31**-i, so a token's hash is the difference of two of them. Bytes hold it, as ``dim`` divides 256."""
    if 256 % dim:
        raise ValueError("the number of slots must divide 256")
    encoded = [t.encode() for t in texts]
    raw = np.frombuffer(b" " + b" ".join(encoded) + b" ", dtype=np.uint8)
    word = _WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    power = _powers()
    inverse = np.resize(power[-np.arange(8) % 8], len(raw))
    sums = np.zeros(len(raw) + 1, np.uint8)
    np.cumsum(raw * inverse, dtype=np.uint8, out=sums[1:])
    h = (sums[end] - sums[begin]) * power[(end - 1) % 8]
    starts = np.cumsum([1, *(len(e) + 1 for e in encoded[:-1])])
    row = np.repeat(np.arange(len(texts)) * dim, np.diff([*np.searchsorted(begin, starts), len(begin)]))
    slot = np.uint8(dim - 1)
    first = row + (h & slot)
    second = row + ((h * np.uint8(31) + (end - begin).astype(np.uint8)) & slot)
    size = len(texts) * dim
    weights = 4 * np.bincount(first, minlength=size) + np.bincount(second, minlength=size)
    return weights.reshape(len(texts), dim).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _hash_slots(lowered: pd.Series) -> pd.Series:
    texts, out, a = lowered.fillna("").tolist(), [], 0
    while a < len(texts):
        # slices of about 1 MB of text keep the working arrays small next to very long texts
        b, size = a, 0
        while b < len(texts) and (b == a or size < 1 << 20):
            size += len(texts[b])
            b += 1
        out.extend(_slot_weights(texts[a:b], DIM))
        a = b
    return pd.Series(out)


def embed(text: Column) -> Column:
    """Feature-hashed text, unnormalised and times four, so that weights (1 and 0.25) are exact whole numbers."""
    return _hash_slots(F.lower(text))


def word_lengths(text: Column, dim: int = 16) -> Column:
    """Another embedder, of built-in expressions: how many words of each length, the last slot for all longer ones."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    sizes = F.transform(words, lambda w: F.least(F.length(w), F.lit(dim)))
    # bound once per row by an outer one-element transform
    return F.transform(F.array(sizes), lambda all_: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.size(
        F.filter(all_, lambda n: n == k)).cast("float")))[0]


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def l2_normalize(vec: Column) -> Column:
    """Divided by its length; a zero vector stays as it is.

    The length is bound once per row by an outer one-element transform; written inside the inner function it would be
    worked out again for every element."""
    return F.transform(F.array(norm(vec)), lambda size: F.when(size == 0, as_double(vec)).otherwise(
        F.transform(as_double(vec), lambda x: x / size)))[0]


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from precomputed norms; 0 when either vector is zero."""
    return F.when((norm_a == 0) | (norm_b == 0), 0.0).otherwise(dot(a, b) / (norm_a * norm_b))


def hyperplanes(dim: int, planes: int = PLANES, seed: int = SEED) -> list[list[float]]:
    """Seeded Gaussian normals, to nine decimals so that the same numbers can be written into SQL."""
    draw = random.Random(seed)
    return [[round(draw.gauss(0.0, 1.0), 9) for _ in range(dim)] for _ in range(planes)]


def lsh_signature(vec: Column, dim: int, planes: int = PLANES, seed: int = SEED) -> Column:
    """Bit i is set when the vector lies on the positive side of plane i (boundary included)."""
    normals = np.array(hyperplanes(dim, planes, seed)).T
    bits = (1 << np.arange(planes)).astype(np.int64)

    @F.pandas_udf(T.IntegerType())
    def signature(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        sides = np.stack(vectors.to_numpy()).astype(np.float64) @ normals >= 0
        return pd.Series((sides * bits).sum(axis=1).astype(np.int32))

    return signature(vec)


def probe_signatures(signature: Column, planes: int = PLANES) -> Column:
    """The signature and its one-bit neighbours."""
    flips = [signature.bitwiseXOR(F.lit(1 << i)) for i in range(planes)]
    return F.array(signature, *flips)


def lsh_buckets(vec: Column, dim: int, planes: int = PLANES, tables: int = 1, probes: int = 0, seed: int = SEED) -> Column:
    """Buckets of a vector as array<bigint>: table * 2**planes + signature, the tables in order.

    Table t has planes of its own, drawn with seed + t, so table 0 gives ``lsh_signature``. With ``probes`` each table also
    names the buckets across that many planes, those the vector lies nearest to first; ``planes`` of them are all one-bit
    neighbours."""
    if not 1 <= planes <= 30:
        raise ValueError("a table has 1 to 30 planes")
    normals = np.concatenate([np.array(hyperplanes(dim, planes, seed + t)) for t in range(tables)])
    length = np.sqrt((normals ** 2).sum(axis=1)).reshape(tables, planes)
    bits = (1 << np.arange(planes)).astype(np.int64)
    base = (np.arange(tables, dtype=np.int64) << planes)[:, None]
    probes = min(probes, planes)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def buckets(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="object")
        side = (np.stack(vectors.to_numpy()).astype(np.float64) @ normals.T).reshape(-1, tables, planes)
        own = ((side >= 0) * bits).sum(axis=2)[:, :, None]
        near = np.argsort(np.abs(side) / length, axis=2, kind="stable")[:, :, :probes]
        every = np.concatenate([own, own ^ bits[near]], axis=2) + base
        return pd.Series(list(every.reshape(len(every), -1)))

    return buckets(vec)


def export_vector(vec: Column) -> Column:
    """Comma-separated text of a vector."""
    return F.array_join(F.transform(as_double(vec), lambda x: x.cast("string")), ",")


def import_vector(text: Column) -> Column:
    """Comma-separated text to array<double>; an unreadable number becomes null."""
    return F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
