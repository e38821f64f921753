"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL-proximal."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinetide.llm.common import mix, small_batches, training_share

BUCKETS = 1 << 16  # hashed n-grams
ORDERS = (1, 2, 3)  # characters of an n-gram
SAMPLE = 2000  # labelled documents that the model is fitted on, the lowest by hash of each language in turn
PARTS = 256  # of a language, ranked side by side before its lowest hashes are
CALIBRATION = 5  # every fifth of them is kept for the temperature
SLICE = 1 << 18  # characters whose n-grams are looked up at once
UNKNOWN = "und"


def code_points(text: str) -> np.ndarray:
    """The lower-case text, a space at either end."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, by the slice of SLICE characters that their last one lies in: each n-gram once."""
    for begin in range(0, len(codes), SLICE):
        end, out = min(begin + SLICE, len(codes)), []
        for n in ORDERS:
            part = codes[max(0, begin - n + 1):end].astype(np.uint64)
            key = np.full(max(0, len(part) - n + 1), n, np.uint64)
            for i in range(n):
                key = key * np.uint64(0x110000) + part[i:len(part) - n + 1 + i]
            out.append(mix(key) % np.uint64(BUCKETS))
        yield np.concatenate(out).astype(np.int64)


def ngrams(text: str) -> np.ndarray:
    """Buckets of all n-grams of the text."""
    return np.concatenate(list(slices(code_points(text))))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their share of the text's n-grams."""
    found, counts = np.unique(ngrams(text), return_counts=True)
    return found, counts / counts.sum()


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets by languages, inverse document frequency included
    bias: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        """Linear scores: weights averaged over the n-grams of the whole text."""
        total, n = np.zeros(len(self.languages)), 0
        for part in slices(code_points(text)):
            total += self.weights[part].sum(axis=0)
            n += len(part)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        share = softmax(self.scores(text) / self.temperature)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) if any(map(str.isalpha, t)) else (np.zeros(0, np.int64), np.zeros(0)) for t in batch.column("text").to_pylist()]
        columns = [pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([b.astype(np.float32) for _, b in found], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *columns], ["doc_id", "lang", "f", "v"])


def _documents_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of this task that hold an n-gram of each bucket; bucket -1: texts with a letter."""
    seen, here, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if any(map(str.isalpha, text)):
                here[:] = False
                for part in slices(code_points(text)):
                    here[part] = True
                seen += here
                n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], n))], ["bucket", "n"])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of texts (text) that hold an n-gram of each bucket, and their number; at most BUCKETS rows leave a task."""
    found = texts.select("text").mapInArrow(_documents_by_bucket, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(BUCKETS + 1, np.int64)  # the last one is bucket -1
    for r in found:
        seen[r["bucket"]] = r["n"]
    return seen[:BUCKETS], int(seen[BUCKETS])


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seen: np.ndarray, documents: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> Model:
    """FTRL-proximal with L1 and L2 over TF-IDF vectors, then a temperature on documents kept aside. texts: their features;
    seen, documents: the corpus's document frequencies.

    Texts without features teach nothing. Labels in code point order; none gives a model that answers und.
    """
    rows = [(x, y) for x, y in zip(texts, labels) if len(x[0])]
    languages = sorted({y for _, y in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + documents) / (1 + seen)) + 1
    scale = float(np.mean([1 / np.linalg.norm(v * idf[f]) for (f, v), _ in rows]))  # one factor for all: scores stay linear in the text
    k = len(languages)
    z, n, bias = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k)), BUCKETS
    data = [(np.append(f, bias), np.append(v * idf[f] * scale, 1.0), languages.index(y)) for (f, v), y in rows]
    kept = [r for i, r in enumerate(data) if i % CALIBRATION == 0 and len(data) >= 50]
    taught = [r for i, r in enumerate(data) if i % CALIBRATION or len(data) < 50]

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(taught)):
            at, x, y = taught[i]
            w = weights(at)
            slope = softmax(x @ w)
            slope[y] -= 1
            g = x[:, None] * slope
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[at] = old + g * g
    w = weights(np.arange(BUCKETS + 1))
    logits, truth = [x @ w[at] for at, x, _ in kept or taught], [y for _, _, y in kept or taught]
    loss = lambda t: -sum(np.log(softmax(s / t)[y] + 1e-12) for s, y in zip(logits, truth))
    temperature = min(np.exp(np.linspace(-4, 2, 61)), key=loss)
    return Model(languages, w[:BUCKETS] * idf[:, None] * scale, w[bias], float(temperature))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs (doc_id, text, lang).

    The model learns from at most `sample` documents (a bound on what the driver holds) with a text and a language whose
    crc32(doc_id) mod 4 is not 2: the lowest md5 of the id of each language, languages taking turns, so that a rare one is
    learned beside a hot one. Document frequencies are those of all such documents. It sees texts only. Null texts and texts
    without a letter are und with score 0, as is everything if nothing can be learned. Very long texts are read by slices,
    which give each n-gram once. Repeated rows are judged alike; a null doc_id counts as an empty text in the hash and stays
    null; other columns are not read; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (training_share(F.col("doc_id"), 4) == 2).alias("held_out"))
    labelled = docs.where("not held_out and text is not null and lang is not null")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    ids = labelled.select("doc_id", "lang", order.alias("o")).distinct()
    ranked = Window.partitionBy("lang", F.conv(F.substring("o", 1, 4), 16, 10).cast("int") % PARTS).orderBy("o", "doc_id")
    ids = ids.withColumn("turn", F.row_number().over(ranked)).where(F.col("turn") <= sample)
    ids = ids.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id")))
    ids = ids.orderBy("turn", "o", "doc_id", "lang").limit(sample).select(F.col("doc_id").alias("id"), F.col("lang").alias("l"))
    taught = labelled.join(F.broadcast(ids), F.expr("doc_id <=> id and lang = l"), "left_semi")
    taught = taught.select("doc_id", "lang", "text").mapInArrow(_featurise, "doc_id long, lang string, f array<int>, v array<float>")
    taught = taught.groupBy("doc_id", "lang").agg(F.min(F.struct("f", "v")).alias("x")).orderBy("doc_id", "lang").select("lang", "x.*").collect()
    model = fit([(np.array(r["f"], np.int64), np.array(r["v"])) for r in taught], [r["lang"] for r in taught], *document_frequencies(labelled))
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
