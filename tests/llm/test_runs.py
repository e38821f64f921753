import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest import rows
from kinetide.llm import runs
from kinetide.llm.common import WORD


def all_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i:j + q]
            if len(s) >= max(24, 3 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall(WORD, text or "")
    h, n = zlib.crc32((b"" if doc_id is None else str(doc_id).encode())), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_all_periods(seed):
    rng, seen = random.Random(seed), 0
    for _ in range(300):
        w = []
        while len(w) < rng.randint(0, 160):
            unit = [rng.randint(0, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 12))]
            w += unit * rng.choice([1, 1, 3, 9]) + unit[:rng.randint(0, len(unit))]
        want = all_runs(w)
        seen += len(want)
        assert runs.find_runs(np.array([hash(str(x)) for x in w], np.int64)) == want
    assert seen > 100


def test_nested_and_long_runs():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert runs.find_runs(np.array(b, np.int64)) == all_runs(b)
    assert runs.find_runs(np.full(50_000, 7, np.int64)) == [(0, 50_000, 1)]
    assert runs.find_runs(np.arange(50_000) % 16_000) == [(0, 50_000, 16_000)]
    assert runs.find_runs(np.zeros(23, np.int64)) == [] and runs.find_runs(np.zeros(24, np.int64)) == [(0, 24, 1)]


def test_query_against_definition(spark, small, odd, none):
    assert runs.periodic_runs(none).count() == 0
    made = [(i, " ".join(f"w{x}" for x in [*range(30), *([i % 7, 1, 2] * (i % 40)), *range(20)])) for i in range(1000, 1300)]
    ties = [(2000, " ".join(["a"] * 24 + ["b"] * 24 + ["a", "b"] * 30))]
    made = spark.createDataFrame(made + ties, "doc_id long, text string").repartition(3)
    for docs in (small, made):
        got = rows(runs.periodic_runs(docs, repeat_some=True).drop("runs", "collapsed"))
        for d in docs.where("length(text) < 9000").collect():  # trying all periods takes the square of the length
            assert tuple(got[d.doc_id]) == expected(d.doc_id, d.text)
    every = runs.periodic_runs(odd, repeat_some=True).drop("runs", "collapsed").collect()
    short = [r for r in odd.collect() if r.doc_id != 9]
    assert sorted((tuple(r) for r in every if r.doc_id != 9), key=str) == sorted((expected(r.doc_id, r.text) for r in short), key=str)
    assert [r.n_runs for r in every if r.doc_id == 9] == [0]


def test_operator_returns_runs_and_text(spark):
    text = "start " + "x y " * 20 + "end"
    r = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(1, 40, 2)] and r.collapsed == "start x y end"
