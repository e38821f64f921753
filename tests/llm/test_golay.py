import random
import re

import numpy as np
import pytest
import xxhash

from kinetide.llm import golay
from kinetide.llm.common import WORD


def fingerprint(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    """Components of (doc_id, fingerprint) by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return sorted(((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(rows)), key=str)


def flip(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def test_code():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 2000)
    at, _ = golay.fuzzy_keys(words)
    assert set(np.bincount(at).tolist()) == {1, 6}
    index = golay.codeword_index(np.arange(1 << 23))
    assert (np.bincount(index, minlength=4096) == 2048).all()  # spheres of 1 + 23 + 253 + 1771 words fill the space


@pytest.mark.parametrize("errors", range(4))
def test_keys_meet(errors):
    rng = random.Random(errors)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = np.array([flip(int(x), rng.sample(range(64), errors)) for x in a], np.uint64)
    met = set.intersection(*(set(zip(*(v.tolist() for v in golay.keys(x.view(np.int64))))) for x in (a, b)))
    assert {i for i, _ in met} == set(range(3000))
    assert np.bincount(golay.keys(a.view(np.int64))[0]).max() <= 86


def test_fingerprints_and_classes(spark, small, odd, none):
    assert golay.simhash_classes(none).count() == 0
    for docs in (odd, small):
        rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, golay.simhash_classes(docs).collect()), key=str) == classes(rows)


@pytest.mark.parametrize("parts, limit", [(1, 1024), (5, 1024), (3, 12), (1, 3)])
def test_links_against_all_pairs(spark, monkeypatch, parts, limit):
    """Random fingerprints, chains, and a dense ball; small limits deal keys by further bits and by blocks."""
    monkeypatch.setattr(golay, "LIMIT", limit)
    rng = random.Random(parts)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for x in list(prints)[:40]:
        for _ in range(4):
            x = flip(x, rng.sample(range(64), rng.randint(1, 5)))
            prints.add(x)
    centre = rng.getrandbits(64)
    prints |= {flip(centre, rng.sample(range(64), rng.randint(0, 2))) for _ in range(120)}
    rows = sorted(prints)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in rows]
    from kinetide.llm.components import connected_components

    met = connected_components(golay.fingerprint_links(spark.createDataFrame(signed, "print long").repartition(parts))).collect()
    found = {}
    for r in met:
        found.setdefault(r.component, set()).add(r.node % (1 << 64))
    want = {}
    for d, f, c in classes([(x, x) for x in rows]):
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
