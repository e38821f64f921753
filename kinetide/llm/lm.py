"""Scoring texts with a log-bilinear model trained by noise-contrastive estimation, next to smoothed unigrams.

The model predicts a word's class from the classes of the words before it; the most frequent words are classes of their
own, all others share classes by hash, inside which a word has its smoothed share. So probabilities are normalised over
the whole vocabulary and one class for unknown words in each shared class.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetide.llm.common import ROWS_PER_BATCH, Words, small_batches, staged, training_share

OWN, SHARED = 191, 64  # classes of single words, and shared ones
CLASSES = OWN + 1 + SHARED  # the end of a text is one more
END = OWN
CONTEXT = 2  # words that the model sees
SIZE = 16  # numbers in a class's vector
FREQUENT = 1 << 18  # most words whose counts every task holds (4 MB); the counts of all others are joined
ROUNDS = 2  # parts of the training texts, each learned from by all tasks before their parameters are averaged
SHARD = 6_000  # training texts of a shard, about; its rounds share them
LEAST_SHARDS = 8
NOISE = 32  # noise samples of a minibatch
BATCH = 8192
SMOOTH = 0.1
MERGE = 1 << 22  # words that a task counts before it passes on what it has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c): counts of word hashes, added up over many texts before they are passed on."""
    held, n = [], 0

    def merged() -> pa.RecordBatch:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        keys, at = np.unique(keys, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, counts).astype(np.int64))], ["h", "c"])

    for batch in batches:
        keys, counts = np.unique(Words(batch.column("text"), lower=True).hashes, return_counts=True)
        held.append((keys, counts))
        n += len(keys)
        if n >= MERGE:
            yield merged()
            held, n = [], 0
    if held:
        yield merged()


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of frequent words, ascending
    counts: np.ndarray
    classes: np.ndarray
    texts: int  # training texts, which is how often the end was seen
    shared_size: np.ndarray  # words in each shared class, smoothed

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its count where it is frequent, else -1."""
        classes = (OWN + 1 + (h % np.uint64(SHARED)).astype(np.int64))
        if not len(self.hashes):
            return classes, np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, self.classes[at], classes), np.where(known, self.counts[at], -1)


def contexts(classes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, an end after each, and the classes before each token, ends before a text; borders: of the words."""
    texts = len(borders) - 1
    tokens = np.insert(classes, borders[1:], END)
    starts = borders[:-1] + np.arange(texts)
    before = np.full((CONTEXT, len(tokens)), END, np.int64)
    for k in range(CONTEXT):
        before[k, k + 1:] = tokens[:len(tokens) - k - 1]
        for j in range(k + 1):  # the first k + 1 tokens have nothing of their own text there
            before[k, np.minimum(starts + j, len(tokens) - 1)[starts + j < np.r_[starts[1:], len(tokens)]]] = END
    return tokens, before


class LogBilinear:
    """score(w | context) = (sum of the context classes' vectors, one table a position) . target vector + bias."""

    def __init__(self, flat: np.ndarray | None = None):
        shapes = [(CONTEXT, CLASSES, SIZE), (CLASSES, SIZE), (CLASSES,)]
        if flat is None:
            rng = np.random.default_rng(0)
            flat = np.concatenate([rng.normal(0, 0.1, np.prod(s)) if len(s) > 1 else np.zeros(s) for s in shapes])
        ends = np.cumsum([np.prod(s) for s in shapes])
        self.flat = np.array(flat, np.float64)
        self.context, self.target, self.bias = (self.flat[e - np.prod(s):e].reshape(s) for s, e in zip(shapes, ends))
        self.normaliser = np.full(CLASSES ** CONTEXT, np.nan)

    def train(self, tokens: np.ndarray, before: np.ndarray, noise: np.ndarray, sums: np.ndarray, rng: np.random.Generator, rate: float = 0.1) -> None:
        """One pass of minibatches: each token against the minibatch's noise samples, steps by AdaGrad (sums: squares so far)."""
        log_noise = np.log(NOISE * noise)
        order, columns = rng.permutation(len(tokens)), np.arange(SIZE)
        for at in range(0, len(tokens), BATCH):
            rows = order[at:at + BATCH]
            w, c = tokens[rows], before[:, rows]
            false = rng.choice(CLASSES, NOISE, p=noise)
            hidden = self.context[np.arange(CONTEXT)[:, None], c].sum(axis=0)
            right = (hidden * self.target[w]).sum(axis=1) + self.bias[w] - log_noise[w]
            wrong = hidden @ self.target[false].T + self.bias[false] - log_noise[false]
            up, down = 1 / (1 + np.exp(np.clip(right, -30, 30))), -1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
            back = up[:, None] * self.target[w] + down @ self.target[false]
            scatter = lambda idx, g: np.bincount((idx[:, None] * SIZE + columns).ravel(), g.ravel(), CLASSES * SIZE)
            target, bias = scatter(w, up[:, None] * hidden) + scatter(false, down.T @ hidden), np.bincount(w, up, CLASSES) + np.bincount(false, down.sum(axis=0), CLASSES)
            slope = np.concatenate([*(scatter(c[k], back) for k in range(CONTEXT)), target, bias]) / len(rows)
            sums += slope * slope
            self.flat += rate * slope / (np.sqrt(sums) + 1e-8)

    def log10(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities; the normaliser of each context is found once, by products of context and target vectors."""
        key = before[0].copy()
        for k in range(1, CONTEXT):
            key = key * CLASSES + before[k]
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        hidden = self.context[np.arange(CONTEXT)[:, None], before[:, first]].sum(axis=0)
        new = np.flatnonzero(np.isnan(self.normaliser[keys]))
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            z = hidden[part] @ self.target.T + self.bias
            top = z.max(axis=1)
            self.normaliser[keys[part]] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        out = np.empty(len(tokens))
        for i in range(0, len(tokens), 1 << 16):
            s = slice(i, i + (1 << 16))
            out[s] = (hidden[at[s]] * self.target[tokens[s]]).sum(axis=1) + self.bias[tokens[s]] - self.normaliser[key[s]]
        return out / np.log(10)


def _learn(shared, start: np.ndarray, noise: np.ndarray):
    """(i, value, weight): the parameters after the texts of each shard, weighted by its tokens.

    Rows come sorted by shard. A shard is learned in groups of ROWS_PER_BATCH texts from its first one on, with random numbers of
    its own, so nothing depends on which shards a task holds or how rows reach it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        shard, held, model, sums, rng, seen = None, [], None, None, None, 0

        def learn(texts: pa.Array) -> int:
            found = Words(texts, lower=True)
            tokens, before = contexts(words.look_up(found.hashes)[0], found.borders)
            model.train(tokens, before, noise, sums, rng)
            return len(tokens)

        def finish() -> Iterator[pa.RecordBatch]:
            n = seen + (learn(pa.concat_arrays(held)) if held else 0)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start))), pa.array(model.flat * n), pa.array(np.full(len(start), float(n)))], ["i", "value", "weight"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shards, texts = batch.column("shard").to_numpy(), batch.column("text").cast(pa.large_string())
            for lo, hi in zip(borders := np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]), [*borders[1:], len(shards)]):
                if shard != shards[lo]:
                    if shard is not None:
                        yield from finish()
                    shard, held, model, sums, rng, seen = int(shards[lo]), [], LogBilinear(start), np.full(len(start), 1e-4), np.random.default_rng(int(shards[lo])), 0
                while lo < hi:
                    take = min(hi - lo, ROWS_PER_BATCH - sum(map(len, held)))
                    held.append(texts[lo:lo + take])
                    lo += take
                    if sum(map(len, held)) == ROWS_PER_BATCH:
                        seen += learn(pa.concat_arrays(held))
                        held = []
        if shard is not None:
            yield from finish()
    return run


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>, times array<long>"


def _score(shared, flat: np.ndarray):
    """What a task knows of each text, and its words whose counts it does not hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value, LogBilinear(flat)
        end = np.log10(words.texts + SMOOTH)
        share = np.log10(words.shared_size)
        for batch in batches:
            found = Words(batch.column("text"), lower=True)
            classes, counts = words.look_up(found.hashes)
            tokens, before = contexts(classes, found.borders)
            logs = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + SMOOTH), 0.0)
            inside = np.where(classes > END, logs - share[np.maximum(classes - END - 1, 0)], 0.0)
            texts = len(found.borders) - 1
            sums = lambda x, borders: np.diff(np.r_[0.0, np.cumsum(x)][borders])
            lbl = sums(model.log10(tokens, before), found.borders + np.arange(texts + 1))
            rare = [np.unique(found.hashes[a:b][counts[a:b] < 0], return_counts=True) for a, b in zip(found.borders[:-1], found.borders[1:])]
            ends = np.cumsum([0, *(len(r) for r, _ in rare)])
            flat_of = lambda k, kind: np.concatenate([np.zeros(0, kind), *(r[k].astype(kind, copy=False) for r in rare)]).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat_of(*x))) for x in ((0, np.uint64), (1, np.int64))]
            numbers = [pa.array(np.diff(found.borders) + 1), pa.array(sums(counts >= 0, found.borders).astype(np.int64) + (words.texts > 0)), pa.array(sums(logs, found.borders) + end), pa.array(lbl + sums(inside, found.borders))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out")), *numbers, *lists], [f.split()[0] for f in SCORED.split(", ")])
    return run


def _most_frequent(counts: DataFrame) -> pd.DataFrame:
    """Words whose counts lie in the highest bins that together hold FREQUENT words at most, most frequent first.

    A histogram of the counts' logarithms (some hundred bins) tells which; so no task sends more than what is kept.
    """
    level = F.floor(F.log2("c") * 8)
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(level.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, lowest = 0, None
    for b, n in bins:
        held += n
        if held > FREQUENT:
            break
        lowest = b
    found = counts.where(level >= lowest).toPandas() if lowest is not None else pd.DataFrame({"h": [], "c": []}, dtype="int64")
    return found.sort_values(["c", "h"], ascending=[False, True], ignore_index=True)


def score_texts(docs: DataFrame, held_out: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text).

    Texts whose crc32(doc_id) mod held_out is not 0 are learned from, all are scored; null texts are empty, a null doc_id
    counts as an empty text in the hash and stays null. Words are compared by 64-bit hashes. base_score and score are
    log10. Counts are over all training texts; those of the FREQUENT most frequent words go to every task, all others are
    joined by word. Without training texts all words are unknown and the model keeps its first parameters. Repeated rows
    are learned from and scored each; other columns are not read; an empty table gives an empty one. Training texts are dealt to
    shards by a hash of their id, so scores do not depend on how the table is partitioned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (training_share(F.col("doc_id"), held_out) == 0).alias("held_out"))
    taught = docs.where("not held_out")
    counts = staged(taught.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    texts = taught.count()
    seen, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = _most_frequent(counts)
    own = frequent["h"].to_numpy()[:OWN]
    hashes = frequent["h"].to_numpy().view(np.uint64)
    classes = np.where(np.arange(len(hashes)) < OWN, np.arange(len(hashes)), OWN + 1 + (hashes % np.uint64(SHARED)).astype(np.int64))
    order = np.argsort(hashes)
    place = F.pmod(F.col("h"), F.lit(SHARED)).alias("k")  # 2^64 is a multiple of SHARED, so signs do not matter
    shared = np.zeros((2, SHARED))
    for row in counts.where(~F.col("h").isin([int(h) for h in own])).groupBy(place).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        shared[:, row["k"]] = row["c"], row["n"]
    words = Vocabulary(hashes[order], frequent["c"].to_numpy()[order], classes[order], texts, shared[0] + SMOOTH * (shared[1] + 1))
    noise = np.zeros(CLASSES)
    noise[:len(own)], noise[END], noise[END + 1:] = frequent["c"].to_numpy()[:OWN], texts, shared[0]
    noise = (noise + 1) / (noise + 1).sum()
    everywhere, flat = spark.sparkContext.broadcast(words), LogBilinear().flat
    flat[-CLASSES:] = np.log(noise)
    shards = max(LEAST_SHARDS, texts // SHARD)  # learned side by side, as many whatever the partitions
    for part in range(ROUNDS):
        some = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == part)
        named = some.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard"), "doc_id", F.xxhash64("text").alias("t"), "text")
        some = named.repartition("shard").sortWithinPartitions("shard", "doc_id", "t").select("shard", "text")
        means = some.mapInArrow(_learn(everywhere, flat, noise), "i long, value double, weight double").groupBy("i").agg((F.sum("value") / F.sum("weight")).alias("v")).toPandas()
        if len(means):
            flat = means.sort_values("i")["v"].to_numpy()
    scored = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(everywhere, flat), SCORED)
    scored = staged(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    rare = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("found"))
    # shares inside a class were taken off already, for frequent and rare words
    total = float(np.log10(seen + texts + SMOOTH * (distinct + (texts > 0) + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(seen + texts).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("model") + logs).alias("score"))
