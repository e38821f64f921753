"""Ranked lexical search of many items at once: term sets that items share are evaluated once.

Items are dealt to blocks of bounded size. In a block, terms that stand in the same items form one set; then the two sets that
most items have in common become a new set, again and again, while two items or more share it. That gives a DAG whose leaves are
term sets and whose inner nodes, items among them, are sums of two nodes. Documents are read once for the postings of the
block's terms; a task then fills one accumulator for each leaf and document of a batch, adds along the DAG, and keeps each
item's best documents.
"""
from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinetide.llm.common import small_batches, staged

TOP = 50
ITEMS = 512  # items of a block, about
MINED = 64  # sets of an item that pairs are mined from at once; longer items are mined by such pieces
DOCS = 512  # documents whose accumulators are filled at once

_TERMS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Letters A-Z and digits in a row, and all that is not ASCII, A-Z in lower case."""
    return (text or b"").translate(_TERMS).split()


def shared_sets(items: dict[int, list[int]]) -> tuple[list[list[int]], list[tuple[int, int]], dict[int, int]]:
    """(leaves, sums, node of each item): leaves are lists of terms, node len(leaves) + k is the sum of the two nodes sums[k]."""
    holders = defaultdict(list)
    for item, terms in items.items():
        for t in terms:
            holders[t].append(item)
    by_items = defaultdict(list)
    for t, held in holders.items():
        by_items[tuple(held)].append(t)
    leaves, sums = [sorted(t) for t in by_items.values()], []
    sets: dict[int, set[int]] = {item: set() for item in items}
    for leaf, held in enumerate(by_items):
        for item in held:
            sets[item].add(leaf)
    holders = {leaf: set(held) for leaf, held in enumerate(by_items) if len(held) > 1}
    pairs: Counter[tuple[int, int]] = Counter()
    for own in sets.values():
        shared = sorted(s for s in own if s in holders)
        for i in range(0, len(shared), MINED):
            pairs.update(combinations(shared[i:i + MINED], 2))
    by_count = defaultdict(set)
    for pair, n in pairs.items():
        by_count[n].add(pair)
    most = max(by_count, default=0)
    while most > 1:
        if not by_count[most]:
            most -= 1
            continue
        a, b = pair = min(by_count[most])
        by_count[most].discard(pair)
        both = {i for i in holders[a] & holders[b] if a in sets[i] and b in sets[i]}
        if len(both) < most:  # some of its items have been given larger sets meanwhile
            by_count[len(both)].add(pair)
            continue
        new = len(leaves) + len(sums)
        sums.append(pair)
        holders[new] = both
        near: Counter[int] = Counter()
        for i in both:
            sets[i] -= {a, b}
            near.update(s for s in sets[i] if s in holders)
            sets[i].add(new)
        for s in (a, b):
            holders[s] -= both
        for s, n in near.items():
            if n > 1:
                by_count[n].add((s, new))
    nodes = {}
    made: dict[tuple[int, int], int] = {}
    for item, own in sets.items():
        rest = sorted(own)
        while len(rest) > 1:
            pair = rest[0], rest[1]
            if pair not in made:
                made[pair] = len(leaves) + len(sums)
                sums.append(pair)
            rest = [made[pair], *rest[2:]]
        if rest:
            nodes[item] = rest[0]
    return leaves, sums, nodes


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """The plan of one block, pickled: item ids, terms, leaf of each term, sums, node of each item."""
    terms: dict[bytes, int] = {}
    items = {}
    for item, texts in group.groupby("item_id")["text"]:
        own = dict.fromkeys(t for text in texts if text is not None for t in terms_of(text.encode()))
        items[int(item)] = [terms.setdefault(t, len(terms)) for t in own]
    leaves, sums, nodes = shared_sets(items)
    leaf = np.zeros(len(terms), np.int32)
    for k, own in enumerate(leaves):
        leaf[own] = k
    plan = list(nodes), list(terms), leaf, len(leaves), np.array(sums, np.int32).reshape(-1, 2), list(nodes.values())
    return pd.DataFrame({"plan": [pickle.dumps(plan)]})


def _postings(terms: list[bytes]):
    """(doc_id, n, term, tf): a document's number of terms, and those of the block that it holds with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(terms)}
        for batch in batches:
            sizes, found, counts, ends = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [0]
            for text in batch.column("text").cast(pa.large_binary()):
                words = terms_of(text.as_py())
                ids = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                own, tf = np.unique(ids[ids >= 0], return_counts=True)
                sizes.append(len(words))
                found.append(own)
                counts.append(tf)
                ends.append(ends[-1] + len(own))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), k)) for x, k in ((found, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])
    return run


def _scored(plan: tuple, weight: np.ndarray, n_docs: int, n_terms: int, top: int):
    items, _, leaf, n_leaves, sums, nodes = plan
    nodes = np.array(nodes, np.int64)

    def accumulate(batch: pa.RecordBatch) -> np.ndarray:
        """Scores of the batch's documents, a row for each item."""
        n, lists = batch.column("n").to_numpy(), batch.column("term")
        doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
        m = 50 + 50 * n * n_docs // n_terms
        sums_at = np.zeros((n_leaves + len(sums), len(n)), np.int64)
        np.add.at(sums_at, (leaf[term], doc), weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])))
        for k, (a, b) in enumerate(sums.tolist(), n_leaves):
            np.add(sums_at[a], sums_at[b], out=sums_at[k])
        return sums_at[nodes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.ones(len(items), np.int64)  # scores below cannot be among the best of this task
        kept, held = [], 0

        def best() -> tuple[np.ndarray, ...]:
            item, doc, known, score = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((doc, ~known, -score, item))
            item = item[order]
            starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, int)
            place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
            full = order[place == top - 1]
            floor[item[place == top - 1]] = score[full]
            order, item = order[place < top], item[place < top]
            return item, doc[order], known[order], score[order]

        for whole in batches:
            for i in range(0, whole.num_rows, DOCS):
                batch = whole.slice(i, DOCS)
                score = accumulate(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], batch.schema.names))
                item, at = np.nonzero(score >= floor[:, None])
                ids = batch.column("doc_id")
                kept.append((item, np.asarray(ids.fill_null(0))[at], ids.is_valid().to_numpy(zero_copy_only=False)[at], score[item, at]))
                held += len(item)
                if held > 4 * top * len(items):
                    kept = [best()]
                    held = len(kept[0][0])
        if kept:
            item, doc, known, score = best()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(items, np.int64)[item]), pa.array(doc, mask=~known), pa.array(score)], ["item_id", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) its `top` documents (doc_id, text) with the highest scores above 0.

    A term is a maximal run of ASCII letters, digits and characters beyond ASCII, only A-Z in lower case. Scores are integers: the
    sum over the item's distinct terms of w * (10^9 tf div (1000 tf + 20 m)), w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 +
    (50 n N) div L, with N documents that have a term, L terms in all, n terms in the document. Equal scores are ranked by doc_id,
    null ids last. A null or empty text has no term: such an item finds nothing, such a document is not counted. Rows of one
    item_id are one item with the terms of all; rows with a null item_id are left out. Repeated documents are ranked each; a very
    long text is one row of its terms' counts. Other columns are not read; no documents or items give an empty table.

    A block's plan, with the terms of about ITEMS items, is all that is sent to the tasks; blocks follow each other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    blocks = max(1, -(-items.select("item_id").distinct().count() // ITEMS))
    plans = staged(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).groupBy("block").applyInPandas(lambda key, g: _plan(g).assign(block=key[0]), "plan binary, block long"), "plans")
    found = [_block(docs, pickle.loads(row.plan), top) for b in range(blocks) for row in plans.where(F.col("block") == b).collect()]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, plan: tuple, top: int) -> DataFrame:
    terms = plan[1]
    postings = staged(docs.mapInArrow(_postings(terms), "doc_id long, n long, term array<int>, tf array<long>"), "postings")
    counts = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = counts.docs, counts.terms or 1
    df = np.zeros(len(terms), np.int64)
    for row in postings.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
        df[row[0]] = row[1]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return postings.where(F.size("term") > 0).mapInArrow(_scored(plan, weight, n_docs, n_terms, top), "item_id long, doc_id long, score long")
