"""Runs of repeated words inside a text, by uniting suffix classes in order of decreasing common prefix.

Suffixes are sorted by doubling; neighbours in that order are edges weighted by the length of their common prefix (LCP).
Taking edges from the longest down unites classes of positions whose suffixes agree that far, each kept as an ordered set. A
run of period q and length m starts at s with an LCP of m - q between s and s + q; a position of their class in between would
give the run a smaller period, so when the two first stand in one class they stand next to each other. Newly adjacent positions
at a distance of at most half the LCP (runs of three periods at least) seed the runs, and each run is found once, at its start.
"""
from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetide.llm.common import mix, small_batches

LEAST = 24  # words of a run at least
TIMES = 3  # periods of a run at least
SHORTEST = 16  # words that start and start + period agree on at least: 24 less a third
U = np.uint64


def _may_repeat(words: np.ndarray) -> bool:
    """Whether any SHORTEST words in a row occur twice; without that there is no run."""
    grams, width = words.view(U), 1
    while width < SHORTEST:
        grams = mix(grams[:-width] * U(3) + grams[width:])
        width *= 2
    grams = np.sort(grams)
    return bool((grams[1:] == grams[:-1]).any())


def suffix_edges(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, position, LCP) of neighbours in suffix order with an LCP of SHORTEST or more, longest first."""
    n = len(words)
    ranks, width = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1], 1
    while True:
        rank = ranks[-1]
        key = rank * (n + 2)
        key[:n - width] += rank[width:]
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.r_[1, key[order][1:] != key[order][:-1]])
        if new[order[-1]] == n:
            break
        ranks.append(new)
        width *= 2
    i, j = order[:-1].copy(), order[1:].copy()
    left, right, lcp = i.copy(), j.copy(), np.zeros(n - 1, np.int64)
    for rank, width in zip(reversed(ranks), (1 << k for k in reversed(range(len(ranks))))):
        inside = (i < n) & (j < n)
        same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        step = same * width
        lcp, i, j = lcp + step, i + step, j + step
    keep = np.flatnonzero(lcp >= SHORTEST)
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    return left[keep], right[keep], lcp[keep]


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period; words: one 64-bit number for each word."""
    n = len(words)
    if n < LEAST or not _may_repeat(words):
        return []
    same, found = words.tolist(), []
    class_of: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for x, y, lcp in zip(*(e.tolist() for e in suffix_edges(words))):
        for p in (x, y):
            if p not in class_of:
                class_of[p], members[p] = p, [p]
        a, b = class_of[x], class_of[y]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        into, moved = members[a], members.pop(b)
        if len(moved) > 8 and len(moved) * 32 > len(into):
            into = members[a] = sorted(into + moved)
        else:
            for p in moved:
                if into[-1] < p:
                    into.append(p)
                else:
                    insort(into, p)
        for p in moved:
            k = len(into) - 1 if into[-1] == p else bisect_left(into, p)
            for s, t in ((into[k - 1], p) if k else (p, p), (p, into[k + 1]) if k + 1 < len(into) else (p, p)):
                d = t - s
                if 0 < 2 * d <= lcp and d + lcp >= LEAST and class_of[s if t == p else t] == a and (s == 0 or same[s - 1] != same[t - 1]):
                    found.append((s, d + lcp, d))
        for p in moved:
            class_of[p] = a
    return sorted(found, key=lambda r: (r[0], r[2]))


def shifted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, the numbers of the words that stand at each place: from a given word on a passage repeats."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _digests(repeat_some: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                words = (text.as_py() or b"").split()
                at = shifted(doc, len(words)) if repeat_some else None
                if at is not None:
                    words = [words[i] for i in at.tolist()]
                runs = find_runs(np.fromiter(map(hash, words), np.int64, len(words)))
                best = (None,) * 4
                if runs:
                    top = runs[0]
                    for r in runs[1:]:
                        if r[1] * top[2] > top[1] * r[2]:
                            top = r
                    best = (*top, 1000 * top[1] // top[2])
                listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
                text_left = b" ".join(collapsed(words, runs))
                rows.append((doc, len(runs), *best, listed, hashlib.sha256(text_left).hexdigest(), runs, text_left.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(KINDS), KINDS)], NAMES)
    return run


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
KINDS = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(RUN), pa.large_string()]
NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, repeat_some: bool = False) -> DataFrame:
    """Runs of each row of docs (doc_id, text): n_runs, the run with the greatest length / period, digests, runs and the text without repeats.

    Words are runs of other than ASCII white space, compared byte by byte. A run has the smallest period q, max(24, 3 q) words at
    least, and cannot be extended. Of equal quotients the smallest start, then period, comes first. collapsed is the text's words
    joined by one space without those that some run holds after its first q words. repeat_some writes a repeating passage into
    one text in ten first (see shifted). A null, empty or short text has no run and four nulls; a null id counts as an empty text
    in repeat_some. Repeated rows stay; very long texts need about 8 numbers a word and doubling; other columns are not read; an
    empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(repeat_some), SCHEMA)
