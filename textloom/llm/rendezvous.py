"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import fresh, q

PRIME = (1 << 31) - 1


def _seeds(shard: int) -> tuple[int, int, int]:
    d = hashlib.md5(f"shard:{shard}".encode()).digest()
    return tuple(1 + int.from_bytes(d[4 * i : 4 * i + 4], "big") % (PRIME - 1) for i in range(3))


def shard_rows(weights: dict[int, float]) -> list[tuple[int, float, int, int, int]]:
    """(shard, weight, a, b, c) of each shard, in order; weights must be positive."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("every shard needs a positive weight")
    return [(s, float(w), *_seeds(s)) for s, w in sorted(weights.items())]


def winner(key: Column, weights: dict[int, float]) -> Column:
    """The shard with the highest score -weight / ln(u), u in (0, 1) hashed from key and shard; the lower
    shard at a tie. A key's score on a shard depends on nothing else, so adding a shard moves only the
    keys which that shard wins, and removing one only the keys it held. A null key has no shard."""
    digest = F.md5(key.cast("string").cast("binary"))
    x1 = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")
    x2 = F.conv(F.substring(digest, 8, 7), 16, 10).cast("long")
    p = F.lit(PRIME).cast("long")
    shards = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(w).alias("w"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c")) for s, w, a, b, c in shard_rows(weights)))

    def scored(s: Column, k: Column) -> Column:
        y = (s.a * k.x1 + s.b) % p
        z = (y * s.c + k.x2 * s.a) % p
        u = ((z * z + y) % p + 1) / F.lit(float(PRIME + 1))
        return F.struct((-s.w / F.log(u)).alias("score"), (-s.shard).alias("s"))

    # transform over a one-element array binds the two key hashes once per row
    best = F.transform(F.array(F.struct(x1.alias("x1"), x2.alias("x2"))), lambda k: F.array_max(F.transform(shards, lambda s: scored(s, k))))
    return F.when(key.isNotNull(), -best.getItem(0).s)


def assign(df: DataFrame, key: str, weights: dict[int, float], out: str = "shard") -> DataFrame:
    """Adds the shard of each row by its ``key`` (any type, hashed as string) without a shuffle. Equal keys,
    repeated rows included, share a shard; a null key gets null; an existing column ``out`` is not
    overwritten: the new one then takes leading underscores."""
    return df.withColumn(fresh(df, out), winner(q(key), weights))
