"""Shared helpers of the corpus operators: words as hashes, staged tables, public vocabularies."""
from __future__ import annotations

import base64
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinetide.session import ensure_checkpoint_dir

WORD = "[^\\x20\\x09-\\x0D]+"  # fixed value: what the corpus operators call a word
SPACES = " \t\n\v\f\r"
ROWS_PER_BATCH = 512  # rows that a Python worker holds at once
SLICE = 1 << 20  # bytes whose words are found at once
BITS = 1 << 24  # of a filter that is sent to all tasks

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df as a written table in the shared folder: later passes read columns instead of computing them again."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.parquet(path)
    out.staged_at = path
    return out


def collect_garbage(spark: SparkSession) -> None:
    """The shuffle files of steps that are over go with the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing later reads, and shuffle files of steps that are over."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    collect_garbage(df.sparkSession)


def among(df: DataFrame, column: str, wanted: DataFrame, others: bool = False) -> DataFrame:
    """Rows of df whose number in `column` stands in the first column of `wanted`, and some others: for a join that follows, so that it shuffles less.

    All tasks get a table of hashed bits, BITS at most, however many numbers are wanted. others: the rows that are left out otherwise, none of them wanted.
    """
    bits = wanted.select(F.pmod(F.xxhash64(F.col(wanted.columns[0]).cast("long")), F.lit(BITS)).alias("_place"))
    bits = bits.groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_place % 64 as int)))").alias("_bits"))
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))
    bit = F.coalesce(F.getbit("_bits", (place % 64).cast("int")), F.lit(0))
    return df.join(F.broadcast(bits), F.shiftright(place, 6) == F.col("_word"), "left" if others else "inner").where(bit == (0 if others else 1)).select(df.columns)


def unused(name: str, df: DataFrame) -> str:
    """A column name that df lacks, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts in a small executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def training_share(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE[_WS] = 0
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SLICE bytes that end where a text ends or at white space."""
    begin, end = int(offsets[0]), int(offsets[-1])
    while begin < end:
        stop = begin + SLICE
        if stop >= end:
            stop = end
        else:
            stop = int(offsets[np.searchsorted(offsets, stop)])
            if stop > begin + 2 * SLICE:  # a long text: cut at the next white space
                near = begin + SLICE
                space = np.flatnonzero(_WS[data[near:stop]])[:1]
                stop = near + int(space[0]) if len(space) else stop
        yield begin, stop
        begin = stop


class Words:
    """Words of a batch of texts: hash of each, text borders in words, and sums over the bytes of each text."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts) + 1, np.int64)
        for begin, stop in _slices(self.data, self.offsets):
            part = self.data[begin:stop]
            inside = ~_WS[part]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = self.offsets[(self.offsets > begin) & (self.offsets < stop)] - begin
            first[edges] = inside[edges]
            last[edges - 1] = inside[edges - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            if not len(starts):
                continue
            up, down = _power(len(part))
            values = _BYTE[_LOWER[part] if lower else part] * up[:len(part)]
            found = np.add.reduceat(values, starts) * down[starts]
            hashes.append(mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            counts += np.bincount(np.searchsorted(self.offsets, starts + begin, side="right"), minlength=len(counts))[:len(counts)]
        self.hashes = np.concatenate(hashes)
        self.borders = np.cumsum(counts)

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.borders[:-1], self.borders[1:]):
            yield self.hashes[a:b]

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Sum over each text's bytes of a table of 256 weights."""
        out = np.zeros(len(self.offsets) - 1, np.int64)
        for i, (a, b) in enumerate(zip(self.offsets[:-1], self.offsets[1:])):
            out[i] = int(weight[self.data[a:b]].sum())
        return out


def word_hash(word: str) -> int:
    """The hash that Words gives to one word."""
    return int(Words(pa.array([word]), lower=False).hashes[0])


class TokenPool:
    """Token ids of short strings; ids already found are kept for up to `most` strings. Results never depend on what is kept.

    encode_all: ids of many strings in order and the number of each, where that is faster than one call a string.
    """

    def __init__(self, encode: Callable[[str], list[int]], most: int = 300_000, encode_all: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.encode, self.most, self.encode_all = encode, most, encode_all or self._one_by_one
        self.clear()

    def _one_by_one(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode(p) for p in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.used = 0

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[:len(old)] = old
            setattr(self, name, new)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and the number of ids of each piece."""
        if len(self.slots) > self.most:
            self.clear()
        slots = np.fromiter(map(self.slots.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(slots < 0).tolist()
        new = list(dict.fromkeys(pieces[i] for i in unknown))
        if new:
            at = len(self.slots)
            flat, sizes = self.encode_all(new)
            for name, need in (("starts", at + len(new)), ("sizes", at + len(new)), ("ids", self.used + len(flat))):
                self._room(name, need)
            self.starts[at:at + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[at:at + len(new)] = sizes
            self.ids[self.used:self.used + len(flat)] = flat
            self.used += len(flat)
            self.slots.update(zip(new, range(at, at + len(new))))
            slots[unknown] = [self.slots[pieces[i]] for i in unknown]
        sizes = self.sizes[slots]
        places = np.repeat(self.starts[slots] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[places + np.arange(len(places))], sizes


@lru_cache(4)
def _byte_level(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    spaced = np.zeros(max(ranks.values()) + 1, bool)
    spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), spaced


def byte_level_encoder(path: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level rank file."""
    return _byte_level(path)[0].encode_ordinary


def byte_level_words(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encoder of many words at once, each after one space: ids of all in order, and the number of ids of each word.

    Words hold no white space, so a token that begins with a space begins a word and no token crosses a border.
    """
    encoding, spaced = _byte_level(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids = encoding.encode_to_numpy(" " + " ".join(words), disallowed_special=()).astype(np.int32)
        return ids, np.diff(np.append(np.flatnonzero(spaced[ids]), len(ids)))
    return encode
