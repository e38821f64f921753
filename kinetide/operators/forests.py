"""Forests and boosted trees for many folds or resamples at once, grown level by level from integer histograms.

Features are binned once. A pass over the rows adds up three integers per (open node, feature, bin) of all trees of all models
in a block; they are summed node by node, running sums over the bins give every split, and one row per open node comes back: its totals
and its best split. So rows never leave the executors, a level of a thousand trees is one aggregate, and since only integers
are summed the trees do not depend on how rows are partitioned. What the driver and each task hold are the trees of a block.

Class weights, gradients and leaf values are fixed-point numbers. The bag of a tree takes a row as often as a Poisson(1) draw
from a hash of the row and the tree; the features of a node are drawn by a hash too. A group's multiplicity counts its rows.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinetide.operators import models
from kinetide.operators.cleaning import melt
from kinetide.operators.ordered import exact_percentiles
from kinetide.session import cut_lineage

BINS = 32
PRIME = (1 << 31) - 1
CLASS_UNIT, GRADIENT_UNIT, VALUE_UNIT = 1 << 20, 1 << 24, 1 << 30
CELLS = 1 << 22  # histogram cells that a task holds; with more, it passes on what each batch has
NODES = 1 << 20  # nodes of a block of models, about
ROWS_OF_TASK, MOST_OF_TASK = 1 << 11, 1 << 20  # binned rows that are worth a task of their own, and that a task has at most
ROUNDS_KEPT = 20  # boosting rounds whose trees a pass looks through before margins are written
AT_ONCE = 1 << 20  # (row, tree) pairs that are looked at together
POISSON = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


@dataclass(frozen=True)
class Ensemble:
    """What to grow: `boosting` fits trees one after the other to gradients of the log loss, else they are a forest."""

    trees: int
    depth: int
    leaf: int  # rows of a leaf at least
    boosting: bool = False
    rate: float = 0.1
    seed: int = 42


def _draw(seed: int, tree: int) -> tuple[int, int]:
    h = hashlib.md5(f"{seed}:{tree}".encode()).hexdigest()
    return int(h[:8], 16) % (PRIME - 1) + 1, int(h[8:16], 16) % PRIME


def row_key(column: Column) -> Column:
    """32 bits of the md5 of a row's name."""
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


@dataclass
class Trees:
    """Nodes of all trees of a block; left is 0 for a leaf, the right child follows the left one, a value is a multiple of 1 / VALUE_UNIT."""

    model: list[int] = field(default_factory=list)
    tree: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)  # 1 for the root, 2 i and 2 i + 1 below i
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)

    def add(self, model: int, tree: int, path: int, value: int) -> int:
        for name, x in (("model", model), ("tree", tree), ("path", path), ("feature", 0), ("cut", 0), ("left", 0), ("value", value)):
            getattr(self, name).append(x)
        return len(self.model) - 1


@dataclass
class Grown:
    """Fitted ensembles: one tree table for all models of a design."""

    names: list[str]
    cuts: dict[str, list[float]]
    design: models.Design
    kind: Ensemble
    start: list[int]  # margin before the first tree, in VALUE_UNIT
    trees: Trees

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """model_id, tree, node, feature, threshold, left_child, value: rows go left while feature <= threshold; node -1 holds the start."""
        first: dict[tuple[int, int], int] = {}
        t = self.trees
        for i, at in enumerate(zip(t.model, t.tree)):
            first.setdefault(at, i)
        order = sorted(range(len(t.model)), key=lambda i: (t.model[i], t.tree[i], i))
        number: dict[int, int] = {}
        seen: dict[tuple[int, int], int] = {}
        for i in order:
            at = t.model[i], t.tree[i]
            number[i] = seen[at] = seen.get(at, -1) + 1
        rows = [(self.design.ids[m], -1, -1, None, None, None, s / VALUE_UNIT) for m, s in enumerate(self.start)]
        for i in order:
            inner = t.left[i] > 0
            name = self.names[t.feature[i]] if inner else None
            rows.append((self.design.ids[t.model[i]], t.tree[i], number[i], name, self.cuts[name][t.cut[i]] if inner else None, number[t.left[i]] if inner else None, t.value[i] / VALUE_UNIT))
        return spark.createDataFrame(rows, "model_id string, tree int, node int, feature string, threshold double, left_child int, value double")


def cut_points(rows: DataFrame, names: Sequence[str]) -> dict[str, list[float]]:
    """Up to BINS - 1 distinct quantiles of each feature."""
    probs = {f"q{k:02d}": k / BINS for k in range(1, BINS)}
    found = exact_percentiles(melt(rows, [], names), ["feature"], "value", probs).collect()  # one row per feature
    return {r.feature: sorted({r[q] for q in probs}) for r in found}


def _binned(rows: DataFrame, names: Sequence[str], cuts: dict[str, list[float]], group: str, groups: Sequence[str], key: Column | None) -> DataFrame:
    """(g, y, h, bins): group number, label, row key and a byte per feature: how many cuts lie below the value."""
    at = {g: i for i, g in enumerate(groups)}
    by_values = key is None
    named = F.lit(None).cast("long") if by_values else row_key(key)
    plain = rows.select(F.col(group).cast("string").alias("g"), F.col("label").cast("int").alias("y"), named.alias("h"), *[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))])
            bins = np.column_stack([np.searchsorted(cuts.get(n, []), x[:, i]) for i, n in enumerate(names)]).astype(np.uint8)
            g, h = [at.get(v, -1) for v in b.column("g").to_pylist()], b.column("h")
            if by_values:  # a row is named by its values
                h = pa.array([int(hashlib.md5(v.tobytes() + bytes([y % 256])).hexdigest()[:8], 16) for v, y in zip(x, b.column("y").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), b.column("y"), h, pa.array([v.tobytes() for v in bins], pa.binary())], ["g", "y", "h", "bins"])

    return plain.mapInArrow(run, "g int, y int, h long, bins binary")


@dataclass
class _Pass:
    """What a task needs to add up a level, or to score."""

    d: int
    kind: Ensemble
    weights: np.ndarray  # models x groups, multiplicities
    classes: np.ndarray  # models x 2, class weights in CLASS_UNIT
    start: np.ndarray
    roots: np.ndarray  # nodes where rows enter, in trees that are being grown
    past: np.ndarray  # models x rounds: roots of the boosting trees since margins were written
    model: np.ndarray
    tree: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    open_at: np.ndarray  # node -> place among the open nodes, or -1
    chosen: np.ndarray  # open nodes x features that may split them

    def walk(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Where rows of a (rows x trees) table of nodes end."""
        row = np.arange(len(bins))[:, None]
        while True:
            left = self.left[node]
            if not left.any():
                return node
            right = bins[row, self.feature[node]] > self.cut[node]
            node = np.where(left > 0, left + right, node)

    def margins(self, b: pa.RecordBatch, bins: np.ndarray) -> np.ndarray:
        base = np.tile(self.start, (len(bins), 1))
        if "margin" in b.schema.names:
            base = b.column("margin").flatten().to_numpy().reshape(len(bins), -1).copy()
        for k in range(self.past.shape[1]):
            base += self.value[self.walk(bins, np.tile(self.past[:, k], (len(bins), 1)))]
        return base


def _spread(data: DataFrame, rows: int) -> DataFrame:
    """Binned rows are few bytes of a file that may be one split; passes need them on all cores."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data.repartition(max(min(cores, -(-rows // ROWS_OF_TASK)), -(-rows // MOST_OF_TASK)))


def _columns(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, ...]:
    packed = b.column("bins").cast(pa.binary())
    first = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
    bins = np.frombuffer(packed.buffers()[2], np.uint8, b.num_rows * d, first).reshape(b.num_rows, d)
    return (*(b.column(c).to_numpy() for c in ("g", "y", "h")), bins)


def _histogram(p: _Pass):
    k = p.chosen.shape[1]
    cells = len(p.chosen) * k * BINS

    def entries(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(open node, row's bins, n, a, b) of all rows in open nodes."""
        g, y, h, bins = _columns(b, p.d)
        margin = p.margins(b, bins) if p.kind.boosting else None
        step = max(1, AT_ONCE // max(1, len(bins)))
        for at in range(0, len(p.roots), step):
            roots = p.roots[at:at + step]
            m = p.model[roots]
            w = p.weights[m][:, g].T
            if not p.kind.boosting:
                draw = np.array([_draw(p.kind.seed, t) for t in p.tree[roots].tolist()], np.int64)
                w = w * np.searchsorted(POISSON, (h[:, None] * draw[:, 0] + draw[:, 1]) % PRIME, side="right")
            node = p.open_at[p.walk(bins, np.tile(roots, (len(bins), 1)))]
            row, col = np.nonzero((node >= 0) & (w > 0))
            w, of = w[row, col], m[col]
            if p.kind.boosting:
                q = 1.0 / (1.0 + np.exp(-margin[row, of] / VALUE_UNIT))
                a, c = (w * np.rint(x * GRADIENT_UNIT).astype(np.int64) for x in (y[row] - q, q * (1 - q)))
                yield node[row, col], bins[row], w, a, c
            else:
                c = w * p.classes[of, y[row]]
                yield node[row, col], bins[row], np.ones(len(w), np.int64), np.where(y[row] == 0, c, 0), np.where(y[row] == 1, c, 0)

    def add(out: np.ndarray, node: np.ndarray, bins: np.ndarray, *values: np.ndarray) -> None:
        row, size = np.arange(len(node)), len(p.chosen) * BINS
        if size > 4 * len(node):
            for j in range(k):
                cell = (node * k + j) * BINS + bins[row, p.chosen[node, j]]
                for x, v in zip(out, values):
                    np.add.at(x, cell, v)
            return
        # few nodes: whole sums of one feature, exact in doubles as they are integers below 2^53
        table, weights = out.reshape(3, len(p.chosen), k, BINS), [v.astype(float) for v in values]
        columns, base = np.ascontiguousarray(bins.T), node * BINS
        for j in range(k):
            cell = base + (columns[j] if p.kind.boosting else columns[p.chosen[node, j], row])
            for x, v in zip(table, weights):
                x[:, j] += np.bincount(cell, v, size).astype(np.int64).reshape(-1, BINS)

    def sparse(node: np.ndarray, bins: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        row = np.repeat(np.arange(len(node)), k)
        cell = ((node[:, None] * k + np.arange(k)) * BINS + bins[np.arange(len(node))[:, None], p.chosen[node]]).ravel()
        return _summed(cell, *(v[row] for v in values))

    def packed(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 1 << 16):
            part = [c[i:i + (1 << 16)] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part[0] // (k * BINS), *part)], ["node", "cell", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, cells), np.int64) if cells <= CELLS else None
        step = max(1024, min(AT_ONCE // 64 // max(1, len(p.roots)), 1 << 14))
        for b in batches:
            for i in range(0, b.num_rows, step):
                for part in entries(b.slice(i, step)):
                    if held is not None:
                        add(held, *part)
                    elif len(part[0]):
                        yield from packed(*sparse(*part))
        if held is not None:
            full = np.flatnonzero(held[0])
            yield from packed(full, *held[:, full])

    return run


def _splits(k: int, kind: Ensemble):
    """Totals and the best split of each node, from rows of whole nodes."""
    def side(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(n, 1.0) if kind.boosting else (a * a + b * b) / np.maximum(a + b, 1.0)

    def best(cell: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, at = np.unique(cell // (k * BINS), return_inverse=True)
        step = max(1, AT_ONCE // (k * BINS))
        for lo in range(0, len(node), step):
            here = (at >= lo) & (at < lo + step)
            count = min(step, len(node) - lo)
            h = np.zeros((3, count * k * BINS), np.int64)
            h[:, (at[here] - lo) * k * BINS + cell[here] % (k * BINS)] = [v[here] for v in values]
            left = np.cumsum(h.reshape(3, count, k, BINS), axis=3)
            total = left[..., -1:]
            fair = (left[0] >= kind.leaf) & (total[0] - left[0] >= kind.leaf)
            l, r = left.astype(float), (total - left).astype(float)
            if kind.boosting:
                apart = side(*l) - side(*r)
                gain = l[0] * r[0] / np.maximum(l[0] + r[0], 1.0) * apart * apart
            else:
                gain, fair = side(*l) + side(*r), fair & (total[1] > 0) & (total[2] > 0)
            gain = np.where(fair, gain, 0.0).reshape(count, -1)
            first = gain.argmax(axis=1)  # of equal gains the first feature, then the lowest cut
            none = gain[np.arange(count), first] <= 0
            lefts = left.reshape(3, count, -1)[:, np.arange(count), first]
            columns = [node[lo:lo + count], *total[:, :, 0, 0], first // BINS, first % BINS, *lefts]
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=none if i > 3 else None) for i, c in enumerate(columns)], SPLIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("cell", "n", "a", "b")])
            n += b.num_rows
            if n > AT_ONCE:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                n = max(0, len(held[0][0]) - AT_ONCE)
        if held:
            yield from best(*_summed(*map(np.concatenate, zip(*held))))

    return run


SPLIT = ["node", "n", "a", "b", "j", "bin", "left_n", "left_a", "left_b"]


def _summed(cell: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values of each cell, cells in order."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
    return cell[starts], *(np.add.reduceat(v[order], starts) if len(cell) else v for v in values)


def _best_splits(data: DataFrame, p: _Pass) -> dict[int, tuple]:
    """(n, a, b, place of the feature, bin, left n, a, b) of each open node that has rows; without a split the place is None.

    A task sends one row per cell; the rows of a node meet in one task and are summed as they come.
    """
    k = p.chosen.shape[1]
    cells = data.mapInArrow(_histogram(p), "node long, cell long, n long, a long, b long").repartition("node")
    found = cells.mapInArrow(_splits(k, p.kind), ", ".join(f"{c} long" for c in SPLIT)).collect()  # one row per open node
    return {r.node: tuple(r)[1:] for r in found}


def _value(kind: Ensemble, a: int, b: int) -> int:
    if kind.boosting:
        return round(kind.rate * (a / b) * VALUE_UNIT) if b else 0
    return round(b / (a + b) * VALUE_UNIT) if a + b else 0


def _chosen(kind: Ensemble, tree: int, path: int, d: int) -> list[int]:
    """Features that may split a node: all in boosting, the sqrt(d) with the lowest hashes in a forest."""
    if kind.boosting:
        return list(range(d))
    a, b = _draw(kind.seed, tree)
    mixed = [(((path * 7919 + f + 1) * a + b) % PRIME) ** 2 % PRIME for f in range(d)]
    return sorted(sorted(range(d), key=lambda f: (mixed[f], f))[:max(1, math.isqrt(d))])


def _grow(data: DataFrame, kind: Ensemble, d: int, weights: np.ndarray, classes: np.ndarray, start: list[int]) -> Trees:
    """All trees of one block of models."""
    trees, m = Trees(), len(weights)
    past: list[list[int]] = []

    def state(roots: list[int], opened: list[int]) -> _Pass:
        at = np.full(len(trees.model), -1)
        at[opened] = np.arange(len(opened))
        arrays = {n: np.array(getattr(trees, n), np.int64) for n in ("model", "tree", "feature", "cut", "left", "value")}
        chosen = np.array([_chosen(kind, trees.tree[i], trees.path[i], d) for i in opened], np.int64).reshape(len(opened), len(_chosen(kind, 0, 1, d)))
        return _Pass(d, kind, weights, classes, np.array(start, np.int64), np.array(roots, np.int64), np.array(past, np.int64).reshape(-1, m).T, **arrays, open_at=at, chosen=chosen)

    def levels(roots: list[int]) -> None:
        opened = roots
        for _ in range(kind.depth):
            found, below = _best_splits(data, state(roots, opened)), []
            for at, (n, a, b, j, bin_, ln, la, lb) in found.items():
                i = opened[at]
                if trees.path[i] == 1:
                    trees.value[i] = _value(kind, a, b)
                if j is None:
                    continue
                trees.feature[i], trees.cut[i] = _chosen(kind, trees.tree[i], trees.path[i], d)[j], bin_
                sides = ((ln, la, lb), (n - ln, a - la, b - lb))
                children = [trees.add(trees.model[i], trees.tree[i], 2 * trees.path[i] + s, _value(kind, *x[1:])) for s, x in enumerate(sides)]
                trees.left[i] = children[0]
                below += [c for c, x in zip(children, sides) if x[0] >= 2 * kind.leaf and (kind.boosting or x[1] and x[2])]
            opened = below
            if not opened:
                break

    if not kind.boosting:
        levels([trees.add(i, t, 1, 0) for i in range(m) for t in range(kind.trees)])
        return trees
    for t in range(kind.trees):
        roots = [trees.add(i, t, 1, 0) for i in range(m)]
        levels(roots)
        past.append(roots)
        if len(past) == ROUNDS_KEPT and t + 1 < kind.trees:
            p = state(roots, [])
            columns = ["g", "y", "h", "bins"]

            def with_margins(batches: Iterator[pa.RecordBatch], p: _Pass = p) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    margin = p.margins(b, _columns(b, d)[3])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, margin.size + 1, m), pa.int32()), pa.array(margin.ravel()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), lists], [*columns, "margin"])

            data, past = cut_lineage(data.mapInArrow(with_margins, "g int, y int, h long, bins binary, margin array<long>")), []
    return trees


def fit(rows: DataFrame, names: Sequence[str], design: models.Design, moments: models.Moments, kind: Ensemble, balanced: bool,
        group: str = "day_str", key: Column | None = None, data: DataFrame | None = None, cuts: dict[str, list[float]] | None = None) -> Grown:
    """Ensembles of all models of a design; a missing value counts as the largest. key: what names a row in the bags."""
    names, m, d = list(names), len(design.ids), len(names)
    cuts = cut_points(rows, names) if cuts is None else cuts
    data = cut_lineage(_spread(_binned(rows, names, cuts, group, design.groups, key), int(moments.n.sum()))) if data is None else data
    counts = moments.class_counts(design.weights)
    weights = np.rint(design.weights).astype(np.int64)
    total = counts.sum(1, keepdims=True)
    classes = np.rint(total / (2 * counts) * CLASS_UNIT).astype(np.int64) if balanced else np.full((m, 2), CLASS_UNIT, np.int64)
    start = [round(math.log(c[1] / c[0]) * VALUE_UNIT) if kind.boosting else 0 for c in counts.tolist()]
    at_once = 1 if kind.boosting else kind.trees
    wide = min(1 << kind.depth, 4096)
    block = max(1, min(NODES // (kind.trees * wide), CELLS // (at_once * wide * BINS * (d if kind.boosting else max(1, math.isqrt(d))) // 2)))
    out = Trees()
    for lo in range(0, m, block):
        s = slice(lo, lo + block)
        grown, first = _grow(data, kind, d, weights[s], classes[s], start[s]), len(out.model)
        for name in ("tree", "path", "feature", "cut", "value"):
            getattr(out, name).extend(getattr(grown, name))
        out.model += [i + lo for i in grown.model]
        out.left += [i + first if i else 0 for i in grown.left]
    return Grown(names, cuts, design, kind, start, out)


def score(data: DataFrame, grown: Grown) -> DataFrame:
    """model_id, label, score, predicted of each row with the models that are tested on its group, written before it is returned."""
    d, kind, t = len(grown.names), grown.kind, grown.trees
    roots: dict[int, list[int]] = {}
    for i, (m, path) in enumerate(zip(t.model, t.path)):
        if path == 1:
            roots.setdefault(m, []).append(i)
    at = {g: i for i, g in enumerate(grown.design.groups)}
    tested: dict[int, list[int]] = {}
    for m, g in enumerate(grown.design.test_group):
        tested.setdefault(at.get(g, -2), []).append(m)
    arrays = {n: np.array(getattr(t, n), np.int64) for n in ("model", "tree", "feature", "cut", "left", "value")}
    none = np.zeros(0, np.int64)
    p = _Pass(d, kind, none, none, none, none, none, **arrays, open_at=none, chosen=none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                g, y, _, bins = _columns(whole.slice(i, 1024), d)
                for group in np.unique(g).tolist():
                    rows = g == group
                    for m in tested.get(group, []):
                        total = np.full(int(rows.sum()), grown.start[m], np.int64)
                        step = max(1, AT_ONCE // max(1, len(total)))
                        for k in range(0, len(roots[m]), step):
                            some = np.array(roots[m][k:k + step])
                            total += p.value[p.walk(bins[rows], np.tile(some, (len(total), 1)))].sum(axis=1)
                        s = 1.0 / (1.0 + np.exp(-total / VALUE_UNIT)) if kind.boosting else total / (kind.trees * VALUE_UNIT)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), m, np.int32)), pa.array(y[rows]), pa.array(s)], ["m", "label", "score"])

    scored = cut_lineage(data.mapInArrow(run, "m int, label int, score double"))
    ids = data.sparkSession.createDataFrame(list(enumerate(grown.design.ids)), "m int, model_id string")
    return scored.join(ids, "m").select("model_id", "label", "score", (F.col("score") > 0.5).cast("int").alias("predicted"))


def fit_and_score(rows: DataFrame, names: Sequence[str], design: models.Design, moments: models.Moments, kind: Ensemble, balanced: bool,
                  group: str = "day_str", key: Column | None = None) -> tuple[DataFrame, Grown]:
    names = list(names)
    cuts = cut_points(rows, names)
    data = cut_lineage(_spread(_binned(rows, names, cuts, group, design.groups, key), int(moments.n.sum())))
    grown = fit(rows, names, design, moments, kind, balanced, group, key, data, cuts)
    return score(data, grown), grown


def score_stored(rows: DataFrame, table: DataFrame, keep: Sequence[str] = (), boosting: bool = False) -> DataFrame:
    """keep columns, model_id and score of every row under each model of a stored tree table (see Grown.to_frame)."""
    nodes = [tuple(r) for r in table.orderBy("model_id", "tree", "node").collect()]  # a model, as large as its trees
    names = sorted({r[3] for r in nodes if r[3] is not None})
    kept = rows.select(*keep, *[F.col(n).cast("double").alias(f"__x{i}") for i, n in enumerate(names)])
    models_: dict[str, tuple[float, dict[int, list[tuple]]]] = {}
    for model, tree, node, feature, threshold, left, value in nodes:
        start, trees = models_.setdefault(model, [0.0, {}])
        if tree < 0:
            models_[model][0] = value
        else:
            trees.setdefault(tree, []).append((names.index(feature) if left else 0, threshold or 0.0, left or 0, value))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "model_id string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f"__x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))]) if names else np.zeros((b.num_rows, 1))
            row = np.arange(b.num_rows)
            for model, (start, trees) in models_.items():
                total = np.full(b.num_rows, start)
                for tree in trees.values():
                    feature, threshold, left, value = (np.array(c) for c in zip(*tree))
                    node = np.zeros(b.num_rows, int)
                    while left[node].any():
                        node = np.where(left[node] > 0, left[node] + ~(x[row, feature[node]] <= threshold[node]), node)
                    total += value[node]
                s = 1 / (1 + np.exp(-total)) if boosting else total / len(trees)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([model] * b.num_rows), pa.array(s)], [*keep, "model_id", "score"])

    return kept.mapInArrow(run, schema)
