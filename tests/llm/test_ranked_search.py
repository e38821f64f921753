import math
import random
import re
from collections import Counter

import pytest

from kinetide.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top=50):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in docs if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in queries.items():
        scores = []
        for d, c in held:
            m = 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def test_terms():
    text = "Ab-c9_é X \x7f\x00ÀZ ~İ"
    assert [t.decode() for t in rs.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("seed", range(5))
def test_sums_cover_each_item(seed):
    rng = random.Random(seed)
    common = [rng.sample(range(60), 12) for _ in range(4)]
    items = {i: sorted({*rng.choice(common), *rng.choice(common), *rng.sample(range(400), 5)}) for i in range(80)} | {99: []}
    leaves, sums, nodes = rs.shared_sets(items)
    held = [set(x) for x in leaves]
    for a, b in sums:
        assert not held[a] & held[b]  # no term is counted twice
        held.append(held[a] | held[b])
    assert {i: held[nodes[i]] if i in nodes else set() for i in items} == {i: set(t) for i, t in items.items()}
    assert len(sums) < sum(max(0, len(t) - 1) for t in items.values()) / 3  # shared sums are made once


@pytest.mark.parametrize("items, docs_at_once, parts", [(512, 512, 1), (5, 7, 4)])
def test_search_against_all_documents(spark, monkeypatch, items, docs_at_once, parts):
    monkeypatch.setattr(rs, "ITEMS", items)
    monkeypatch.setattr(rs, "DOCS", docs_at_once)
    rng = random.Random(items)
    words = [f"t{i}" for i in range(60)] + ["É", "Ünï", "A1"]
    docs = [(i, rng.choice([" ", "-", ". "]).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    docs += [(7, docs[7][1]), (None, "t1 t2"), (None, None), (400, None), (401, ""), (402, "t3 " * 5000)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(20)] + [(3, "t5"), (None, "t6"), (50, None), (51, "nowhere")]
    found = rs.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(asked, "item_id long, text string"), 10)
    assert sorted(map(tuple, found.collect()), key=str) == ranked(docs, asked, 10)


def test_odd_tables(spark, odd, none):
    items = odd.selectExpr("doc_id as item_id", "text", "lang as doc_id", "n_words as score")
    assert rs.search(none, items).count() == 0 and rs.search(odd, items.where("false")).count() == 0
    found = sorted(map(tuple, rs.search(odd, items).collect()), key=str)
    assert found == ranked([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
