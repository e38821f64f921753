"""Recursive filters along whole series, exact and block by block.

A filter's memory is a short state vector, and the state after a block is a linear map of the state before it plus what the
block alone adds. So blocks are filtered from an empty state side by side, one small row per block goes into a chain along
each series that gives the true states, and the blocks are filtered again from those. No response is cut off, whatever the
order and the cut-off, and a series may be any number of blocks long.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetide.operators.ordered import row_numbers, time_bucket
from kinetide.session import cut_lineage

STEP = 64  # samples that one matrix product advances


Section = tuple[tuple[float, ...], tuple[float, ...]]


def butterworth_low(order: int, cutoff_hz: float, sample_hz: float) -> tuple[Section, ...]:
    """Sections (b, a) of degree 2, and of 1 if the order is odd, of a digital low-pass: analog poles on a circle, mapped by the
    bilinear transform with a prewarped cut-off."""
    if not 0 < cutoff_hz < sample_hz / 2 or order < 1:
        raise ValueError("the cut-off must lie between 0 and half the sampling rate, the order be 1 or more")
    radius, out = math.tan(math.pi * cutoff_hz / sample_hz), []
    for k in range((order + 1) // 2):
        angle = math.pi * (2 * k + order + 1) / (2 * order)
        pole = radius * complex(math.cos(angle), math.sin(angle))
        real = 2 * k + 1 == order
        z = (1 + pole) / (1 - pole)
        a = (1.0, -z.real) if real else (1.0, -2 * z.real, abs(z) ** 2)
        out.append((tuple(sum(a) / 2 * v for v in (1, 1)) if real else tuple(sum(a) / 4 * v for v in (1, 2, 1)), a))
    return tuple(out)


@dataclass(frozen=True)
class Filter:
    """y = C s + D x, s' = A s + B x of sections in a row, each in the transposed direct form, with the matrices of STEP samples.

    The sections keep powers of A well conditioned where one recursion of high degree would cancel most digits.
    """

    sections: tuple[Section, ...]

    def __post_init__(self) -> None:
        step, into, out, gain = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b, a in self.sections:
            n = max(len(a), len(b)) - 1
            a, b = (np.r_[x, np.zeros(n + 1 - len(x))] / a[0] for x in (a, b))
            own = np.zeros((n, n))
            own[:, 0] = -a[1:]
            own[:-1, 1:] = np.eye(n - 1)
            fed = b[1:] - a[1:] * b[0]
            first = np.r_[1.0, np.zeros(n - 1)]
            step = np.block([[step, np.zeros((len(step), n))], [np.outer(fed, out), own]])
            into, out, gain = np.r_[into, fed * gain], np.r_[b[0] * out, first], b[0] * gain
        n = len(step)
        seen = np.zeros((STEP, n))  # what each of STEP outputs sees of the state
        power = np.eye(n)
        for i in range(STEP):
            seen[i] = out @ power
            power = power @ step
        response = np.r_[gain, seen[:-1] @ into]
        held = np.zeros((n, STEP))  # what each input leaves in the state
        one = into.copy()
        for i in reversed(range(STEP)):
            held[:, i] = one
            one = step @ one
        across = np.array([[response[i - j] if i >= j else 0.0 for j in range(STEP)] for i in range(STEP)])
        for name, value in dict(size=n, step=step, into=into, out=out, gain=gain, seen=seen, held=held, across=across, power=power,
                                rest=np.linalg.solve(np.eye(n) - step, into)).items():
            object.__setattr__(self, name, value)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and the state after them."""
        whole = len(x) // STEP * STEP
        parts = x[:whole].reshape(-1, STEP)
        added, states = parts @ self.held.T, np.empty((len(parts) + 1, self.size))
        states[0] = state
        for i, add in enumerate(added):
            states[i + 1] = self.power @ states[i] + add
        y, state = (parts @ self.across.T + states[:-1] @ self.seen.T).ravel(), states[-1]
        tail = np.empty(len(x) - whole)
        for i, v in enumerate(x[whole:]):
            tail[i] = self.out @ state + self.gain * v
            state = self.step @ state + self.into * v
        return np.r_[y, tail], state

    def after(self, n: int, state: np.ndarray) -> np.ndarray:
        """The state after n samples of nothing."""
        return np.linalg.matrix_power(self.step, n) @ state


def _chain(blocks: DataFrame, f: Filter, reverse: bool) -> DataFrame:
    """Filters (session_id, block, x) from one end of each series to the other, starting at rest on the first value."""
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.asarray(v.values) for v in b.column("x")]
            values = [v[::-1] for v in values] if reverse else values
            ends = [f.run(v, np.zeros(f.size))[1].tolist() for v in values]
            yield pa.RecordBatch.from_arrays(
                [b.column("session_id"), b.column("block"), pa.array([len(v) for v in values], pa.int64()), pa.array([float(v[0]) for v in values]), pa.array(ends, pa.list_(pa.float64()))],
                ["session_id", "block", "n", "first", "added"])

    def states(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ascending=not reverse)
        state, out = f.rest * group["first"].iloc[0], []
        for n, added in zip(group["n"], group["added"]):
            out.append(state.tolist())
            state = f.after(int(n), state) + np.array(added)
        return group.assign(state=out)[["session_id", "block", "state"]]

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, state in zip(b.column("x"), b.column("state")):
                x = np.asarray(x.values)
                y = f.run(x[::-1] if reverse else x, np.array(state.as_py()))[0]
                out.append(y[::-1] if reverse else y)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate([np.zeros(0), *out])))
            yield pa.RecordBatch.from_arrays([b.column("session_id"), b.column("block"), lists], ["session_id", "block", "x"])

    kind = blocks.schema["session_id"].dataType.simpleString()
    ends = blocks.mapInArrow(alone, f"session_id {kind}, block long, n long, first double, added array<double>")
    started = ends.groupBy("session_id").applyInPandas(states, f"session_id {kind}, block long, state array<double>")
    return cut_lineage(blocks.join(started, ["session_id", "block"]).mapInArrow(filtered, f"session_id {kind}, block long, x array<double>"))


def zero_phase(samples: DataFrame, value: str, f: Filter, width: int, order: Sequence[str] = ("t",), block: int = 100_000, name: str = "filtered") -> DataFrame:
    """samples with the column `name`: value filtered forward, then backward, over each whole series.

    Both ends are extended oddly by 3 (n + 1) samples, n the filter's order; shorter series yield no rows. A block is one row
    of at most 2 x `block` values; blocks of a series are filtered in parallel. A null session or value counts as no sample.
    """
    edge, least = 3 * (f.size + 1), max(block, 3 * (f.size + 1) + 1)
    rows = samples.where(F.col("session_id").isNotNull() & F.col(value).isNotNull())
    numbered = cut_lineage(row_numbers(rows.withColumn("__bucket", time_bucket("t", width)), ["session_id"], "__bucket", order, "__row").drop("__bucket"))
    sizes = numbered.groupBy("session_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > edge)
    last = F.greatest(F.floor(F.col("__n") / least) - 1, F.lit(0))  # the rest of a series belongs to its last block
    placed = numbered.join(sizes, "session_id").withColumn("__block", F.least(F.floor((F.col("__row") - 1) / least), last))
    packed = placed.groupBy("session_id", F.col("__block").alias("block"), (F.col("__block") == last).alias("is_last")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("__row").alias("r"), F.col(value).cast("double").alias("v")))).alias("p"))  # one block
    x = F.transform("p", lambda s: s["v"])
    before = F.transform(F.sequence(F.lit(edge), F.lit(1), F.lit(-1)), lambda i: 2 * F.element_at("x", 1) - F.element_at("x", i + 1))
    after = F.transform(F.sequence(F.lit(1), F.lit(edge)), lambda i: 2 * F.element_at("x", -1) - F.element_at("x", -i - 1))
    none = F.array().cast("array<double>")
    ext = F.concat(F.when(F.col("block") == 0, before).otherwise(none), F.col("x"), F.when(F.col("is_last"), after).otherwise(none))
    blocks = cut_lineage(packed.select("session_id", "block", "is_last", x.alias("x")).select("session_id", "block", ext.alias("x")))
    smooth = _chain(_chain(blocks, f, False), f, True)
    at = smooth.select("session_id", "block", F.posexplode("x").alias("i", name))
    row = F.col("block") * least + F.col("i") + 1 - F.when(F.col("block") == 0, F.lit(edge)).otherwise(F.lit(0))
    return numbered.join(at.select("session_id", row.alias("__row"), name), ["session_id", "__row"]).select(*samples.columns, name)
