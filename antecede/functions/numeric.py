"""Column expressions over numbers and vectors, and seeded choices."""

from functools import reduce

from pyspark.sql import Column, functions as F

# Bucket edges of the distance and position features.
EDGES13 = [-8, -4, -2, -1, 1, 2, 3, 4, 5, 8, 16, 32, 64]
EDGES9 = [1, 2, 3, 4, 5, 8, 16, 32, 64]
POSITION_EDGES = [0, 1, 2, 3, 4, 5, 8, 16, 32]


def distance_bin(distance: Column, edges: list[int] = EDGES13) -> Column:
    """Number of edges below a distance."""
    return reduce(
        lambda total, edge: total + F.when(distance > edge, 1).otherwise(0),
        edges,
        F.lit(0),
    )


def distance_bin9(distance: Column) -> Column:
    return distance_bin(distance, EDGES9)


def bucket_onehot(distance: Column, edges: list[int] = EDGES9) -> Column:
    """One-hot of the bin, with everything past the last edge in the last bucket."""
    hot = F.least(distance_bin(distance, edges), F.lit(len(edges) - 1))
    return F.array(*[F.when(hot == i, 1).otherwise(0) for i in range(len(edges))])


def hash_key(seed, *parts: Column) -> Column:
    """md5 over a seed and key columns; the source of every seeded choice and order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(seed, *parts: Column) -> Column:
    """The first 32 bits of ``hash_key`` as a long."""
    return F.conv(F.substr(hash_key(seed, *parts), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def coin(p: float, seed, *parts: Column) -> Column:
    """True for a share ``p`` of keys, the same on every run."""
    return hash_int(seed, *parts) < F.lit(int(p * 2**32))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(
        F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )


def times(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def softmax_clamp(logits: Column, lo: float = 1e-4, hi: float = 1 - 1e-4) -> Column:
    """Softmax, then a clamp that is not renormalised."""
    shifted = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(shifted, lambda v: F.greatest(F.least(v / total, F.lit(hi)), F.lit(lo)))
