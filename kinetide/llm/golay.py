"""SimHash near-duplicates found by fuzzy hashing with the binary Golay code.

The (23, 12) Golay code is perfect: each 23-bit word is at most 3 bits from exactly one codeword. The keys of a word are the
indices of the codewords that it, or it with one bit flipped, decodes to: one key if the codeword is at most 2 bits away, else
six. Two words that differ in at most 2 bits have a word between them at most 1 bit from both, so they share a key.

A fingerprint is cut into segments A and B of 23 bits and a rest of two halves. Of 3 errors (a, b in the segments, r in the rest):
a = 0 leaves at most 2 for B if r > 0 or b < 3, so A itself with a key of B meets; b = 0 likewise; a = 3 or b = 3 leaves all else
equal; otherwise both segments have 1 or 2 errors and the rest at most 1, so keys of A and B with an equal half meet. A
fingerprint has at most 86 keys, most of 33 bits; what meets is verified on all 64 bits.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetide.llm.common import discard, mix, small_batches, staged
from kinetide.llm.components import connected_components

ERRORS = 3  # fingerprints link at so many differing bits or fewer
SEED = 42
POLYNOMIAL = 0b101011100011  # fixed value: a generator of the (23, 12) code
LIMIT = 1024  # fingerprints of one key that are compared at once; more are dealt by further bits
ROUNDS = 3  # such levels; what is still large after them is compared by pairs of blocks
HELD = 1 << 15  # shingles whose bits are counted at once
U = np.uint64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _remainder(words: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (POLYNOMIAL << (bit - 11)), words)
    return words


def _leaders() -> np.ndarray:
    """The error of at most 3 bits for each remainder."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one)[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | one).ravel())
    errors = np.concatenate([[0], one, two, three[np.bitwise_count(three) == 3]])
    out = np.zeros(1 << 11, np.int64)
    out[_remainder(errors)] = errors
    return out


_LEADERS, _HIGH, _LOW = _leaders(), _remainder(np.arange(1 << 12) << 11), _remainder(np.arange(1 << 11))
_FLIPS = np.concatenate([[0], 1 << np.arange(23)])


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the nearest codeword of each 23-bit word."""
    return (words ^ _LEADERS[_HIGH[words >> 11] ^ _LOW[words & 0x7FF]]) >> 11


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, key) of each distinct key of each word."""
    found = np.sort(codeword_index(words[:, None] ^ _FLIPS), axis=1)
    new = np.c_[np.ones(len(words), bool), found[:, 1:] != found[:, :-1]]
    return np.nonzero(new)[0], found[new]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, key of 64 bits) such that fingerprints at ERRORS bits or fewer share a key."""
    bits = prints.astype(U)
    a, b, rest = ((bits >> U(s) & U((1 << w) - 1)).astype(np.int64) for s, w in ((0, 23), (23, 23), (46, 18)))
    (at_a, ka), (at_b, kb) = fuzzy_keys(a), fuzzy_keys(b)
    n = np.arange(len(bits))
    found = [(n, 1 << 60 | b << 18 | rest), (n, 2 << 60 | a << 18 | rest), (at_b, 3 << 60 | a[at_b] << 12 | kb), (at_a, 4 << 60 | b[at_a] << 12 | ka)]
    each, first = np.bincount(at_b, minlength=len(bits)), np.searchsorted(at_b, n)
    times = each[at_a]  # keys of B for each key of A
    at, left = np.repeat(at_a, times), np.repeat(ka, times)
    right = kb[np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[at_a], times)]
    both = (left << 12 | right) << 9
    found += [(at, 5 << 60 | both | rest[at] & 511), (at, 6 << 60 | both | rest[at] >> 9)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _fingerprint(text: bytes) -> int:
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(3, len(words))
    starts, ends = np.r_[0, ends[:-1] + 1][:len(words) - width + 1], ends[width - 1:]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), HELD):
        s = slice(i, i + HELD)
        pieces = map(joined.__getitem__, map(slice, starts[s].tolist(), ends[s].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), "<u8", len(starts[s]))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = [_fingerprint(t.as_py() or b"") for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "print"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy()
        at, found = keys(prints)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(found[i:i + (1 << 16)]), pa.array(prints[at[i:i + (1 << 16)]])], ["key", "print"])


def _dealt(level: int):
    """Keys of the next level: of four groups of 16 bits one at least is equal in fingerprints that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, prints = (batch.column(c).to_numpy() for c in ("key", "print"))
            bit = np.arange(64, dtype=U)
            for group in range(4):
                chosen = bit[(bit // U(16), bit % U(4), bit // U(4) % U(4))[level] == U(group)]
                mask = reduce(lambda x, y: x | U(1) << y, chosen, U(0))
                new = mix(mix(key.astype(U) + U(4 * level + group)) ^ (prints.astype(U) & mask))
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(prints)], ["key", "print"])
    return run


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(U)) <= ERRORS  # of signed numbers it counts the bits of the absolute value


def _forest(prints: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint and the least that links lead to, inside prints, or between prints and other."""
    rows = prints if other is None else np.concatenate([prints, other])
    linked = near(rows[:, None], rows)
    if other is not None:
        linked[:len(prints), :len(prints)] = linked[len(prints):, len(prints):] = False
        np.fill_diagonal(linked, True)
    label = np.arange(len(rows))
    while True:
        new = np.where(linked, label, len(rows)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = label != np.arange(len(rows))
    return rows[on], rows[label[on]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b) from rows sorted by key: links a, b without a key, and rows (key, a) of keys with more than LIMIT fingerprints."""
    def passed(links: list[tuple[np.ndarray, np.ndarray]], large: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*links) if links else ([], [])))
        none, n = np.zeros(len(large[0]), np.int64), len(a)
        key, is_link = np.concatenate([np.zeros(n, np.int64), large[0]]), np.r_[np.ones(n, bool), np.zeros(len(none), bool)]
        return pa.RecordBatch.from_arrays([pa.array(key, mask=is_link), pa.array(np.concatenate([a, large[1]])), pa.array(np.concatenate([b, none]), mask=~is_link)], ["key", "a", "b"])

    def compared(key: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole keys, sorted."""
        if not len(key):
            return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        links, size_of, large = [], np.repeat(sizes, sizes), np.repeat(sizes > LIMIT, sizes)
        few = np.flatnonzero((size_of > 1) & (size_of <= 8))
        for lag in range(1, 8):
            at = few[few + lag < len(key)]
            at = at[(key[at] == key[at + lag]) & near(prints[at], prints[at + lag])]
            links.append((prints[at], prints[at + lag]))
        for k in np.flatnonzero((sizes > 8) & (sizes <= LIMIT)):
            links.append(_forest(prints[starts[k]:starts[k] + sizes[k]]))
        yield passed(links, (key[large], prints[large]))

    held_key, held, streaming = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        key, prints = (batch.column(c).to_numpy() for c in ("key", "print"))
        if streaming is not None:  # the last key is known to be large: its rows go on as they come
            same = key == streaming
            if same.any():
                yield passed([], (key[same], prints[same]))
                key, prints = key[~same], prints[~same]
        if not len(key):
            continue
        key, prints = np.concatenate([held_key, key]), np.concatenate([held, prints])
        last = int(np.searchsorted(key, key[-1]))
        streaming = None
        if len(key) - last > LIMIT:
            streaming, last = int(key[-1]), len(key)
        yield from compared(key[:last], prints[:last])
        held_key, held = key[last:], prints[last:]
    yield from compared(held_key, held)


def _blocks(keyed: DataFrame) -> DataFrame:
    """Links of keys that stay large, by pairs of blocks of about LIMIT / 2 fingerprints."""
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(LIMIT // 2)).cast("int").alias("blocks"))
    rows = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "block").alias("i"), F.greatest(i, "block").alias("j"))))

    def links(group):
        import pandas as pd

        here = group["block"] == group["block"].iloc[0]
        a, b = _forest(group["a"][here].to_numpy(), None if here.all() else group["a"][~here].to_numpy())
        return pd.DataFrame({"a": a, "b": b})

    return rows.select("key", "a", "block", pairs.alias("pair")).groupBy("key", "pair").applyInPandas(links, "a long, b long")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column print) that give the same components as all links."""
    keyed, links, old = prints.mapInArrow(_keyed, "key long, print long"), [], []
    for level in range(ROUNDS + 1):
        met = staged(keyed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_met, "key long, a long, b long"), "met")
        old.append(met)
        links.append(met.where("key is null").select("a", "b"))
        large = met.where("key is not null").select("key", "a")
        if large.isEmpty():
            break
        if level == ROUNDS:
            links.append(_blocks(large))
            break
        keyed = large.withColumnRenamed("a", "print").mapInArrow(_dealt(level), "key long, print long").distinct()
    found = staged(reduce(DataFrame.unionByName, links).distinct(), "links")
    discard(*old)
    return found


def simhash_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs (doc_id, text): components of fingerprints at ERRORS bits or fewer.

    Words are runs of other than ASCII white space, A-Z in lower case; a bit of the fingerprint is set if more than half of the
    3-word shingles, repeats included, have it in their XXH64. A text of fewer words is one shingle. A null text, or one without
    words, has fingerprint 0 and links like any other. component_id is the smallest doc_id that links lead to; rows with a null
    id get their component's, null if all its ids are null. Equal fingerprints, so exact copies too, are compared once; a very
    long text is hashed piece by piece. Repeated rows stay, other columns are not read, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = staged(docs.mapInArrow(_prints, "doc_id long, print long"), "prints")
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(distinct.select("print"))
    classes = staged(distinct.join(connected_components(links).withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("component", "print").alias("component")), "classes")
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "component").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
