"""Signal augmentation of training windows, as expressions over one-row-per-window arrays.

Every copy is decided by md5 of the seed and of what it is, so runs and engines agree on it.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the augmentations.
JITTER_FRACTION = 0.02
KNOTS = 4
KNOT_STD = 0.1


def normal(*parts: Column) -> Column:
    """A standard normal number for a text: two uniform numbers of its md5, as radius and angle."""
    text = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    uniform = lambda at: (F.conv(F.substring(text, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * pi * uniform(9))


def _curve(knots: Sequence[Column]) -> Column:
    """Divided differences of the cubic through equally spaced knots on [0, 1]."""
    level, terms = list(knots), []
    for k in range(len(knots)):
        terms.append(level[0])
        level = [(b - a) / float(k + 1) for a, b in zip(level, level[1:])]
    return F.array(*terms)


def _value(curve: str, i: Column, n: Column) -> Column:
    """The curve at sample i of n, by nested products."""
    u = F.when(n > 1, i.cast("double") / (n - 1)).otherwise(0.0) * (KNOTS - 1)
    out = F.col(curve)[KNOTS - 1]
    for k in reversed(range(KNOTS - 1)):
        out = F.col(curve)[k] + (u - k) * out
    return out


def magnitude_curve(*seed: Column) -> Column:
    return _curve([F.lit(1.0) + F.lit(KNOT_STD) * normal(*seed, F.lit(f"knot{k}")) for k in range(KNOTS)])


def time_path(*seed: Column) -> Column:
    """A path from 0 to 1 through the sums of steps around one."""
    steps = [F.lit(1.0) + F.lit(KNOT_STD) * normal(*seed, F.lit(f"knot{k}")) for k in range(KNOTS)]
    sums = [reduce(lambda a, b: a + b, steps[:k + 1]) for k in range(KNOTS)]
    low, high = F.least(*sums), F.greatest(*sums)
    return _curve([(p - low) / (high - low) for p in sums])


def noise_level(c: str) -> Column:
    """A fiftieth of a channel's deviation; a flat channel counts as deviation one."""
    sums = F.aggregate(c, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + x * x).alias("b")))
    spread = lambda s: F.sqrt(F.greatest(s["b"] / F.size(c) - (s["a"] / F.size(c)) * (s["a"] / F.size(c)), F.lit(0.0)))
    level = F.aggregate(F.array(sums), F.lit(0.0), lambda _, s: spread(s))
    return F.lit(JITTER_FRACTION) * F.when(level > 0, level).otherwise(1.0)


def jitter(c: str, *seed: Column) -> Column:
    return F.transform(c, lambda x, i: x + F.col(f"__level_{c}") * normal(*seed, F.lit(c), i))


def magnitude_warp(c: str, *seed: Column) -> Column:
    """All channels times one smooth curve through knots around one."""
    return F.transform(c, lambda x, i: x * _value("__curve", i, F.size(c)))


def time_warp(c: str, *seed: Column) -> Column:
    """All channels read along one smooth, rising path from the first to the last sample; short windows stay as they are.

    The path's places are looked up between neighbouring samples, so a window costs its length.
    """
    last = F.size(c) - 1
    places = F.array_sort(F.transform(c, lambda x, i: F.least(F.greatest(_value("__path", i, F.size(c)), F.lit(0.0)), F.lit(1.0)) * last))

    def read(p: Column) -> Column:
        left = F.least(F.floor(p), last - 1).cast("int")
        return F.element_at(c, left + 1) * (1.0 - (p - left)) + F.element_at(c, left + 2) * (p - left)

    return F.when(F.size(c) > KNOTS, F.transform(places, read)).otherwise(F.col(c))


AUGMENTATIONS = {"jitter": jitter, "magnitude_warp": magnitude_warp, "time_warp": time_warp}


def augment(arrays: DataFrame, channels: Sequence[str], names: Sequence[str], copies: int = 1, seed: int = 42) -> DataFrame:
    """Each window plus `copies` altered copies per augmentation; `augmentation` is 'none' for the original."""
    channels = list(channels)
    unknown = set(names) - set(AUGMENTATIONS)
    if unknown:
        raise ValueError(f"unknown augmentations: {sorted(unknown)}")
    kinds = F.array(F.struct(F.lit("none").alias("augmentation"), F.lit(0).alias("copy")), *[
        F.struct(F.lit(n).alias("augmentation"), F.lit(k).alias("copy")) for n in names for k in range(copies)
    ])
    plain = arrays.withColumns({c: F.col(c).cast("array<double>") for c in channels})
    spread = plain.select("*", F.explode(kinds).alias("__k")).select(*arrays.columns, "__k.augmentation", "__k.copy")
    key = [F.lit(seed), F.col("window_id"), F.col("augmentation"), F.col("copy")]
    # what holds for a whole window is found once, before its samples are gone through
    spread = spread.withColumns({"__curve": magnitude_curve(*key), "__path": time_path(*key), **{f"__level_{c}": noise_level(c) for c in channels}})
    altered = {n: {c: AUGMENTATIONS[n](c, *key) for c in channels} for n in names}

    def one(c: str) -> Column:
        choice = F.when(F.col("augmentation") == "none", F.col(c))
        for n in names:
            choice = choice.when(F.col("augmentation") == n, altered[n][c])
        return choice

    return spread.withColumns({c: one(c) for c in channels}).select(*arrays.columns, "augmentation", "copy")
