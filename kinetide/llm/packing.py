"""Packing tokenised documents into sequences: best fit first, then a local search that empties bins."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetide.llm.common import TokenPool, byte_level_encoder, byte_level_words, small_batches, staged

LENGTH = 2048  # tokens of a sequence
END = 0  # id after each document
GROUP = 20_000  # pieces that one task packs together
SPECIAL = "<|endoftext|>"  # fixed value: the vocabulary's special token

_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACES = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21))]
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
FIRST = "\ud800"  # marks a text's first fragment, which has no space before it; no text holds this code point


def fragments(text: str) -> list[str]:
    """Cut text at single spaces between other characters. No token crosses such a place, as the vocabulary's pattern begins
    anew at the space; the space is left out of the fragments."""
    loose = text[0] in _SPACES or text[-1] in _SPACES or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in _SPACES[:-1])
    loose = loose or not text.isascii() and _WIDE_SPACE.search(text)
    parts = _CUT.split(text) if loose else text.split(" ")
    parts[0] = FIRST + parts[0]
    return parts


class DocumentTokens:
    """Ids of whole texts as the tokeniser file gives them. Fragments go through the rank file of the same vocabulary, which is
    several times faster; one with the special token's text goes through the tokeniser itself."""

    def __init__(self, tokenizer: str, ranks: str):
        from tokenizers import Tokenizer

        whole, fast = Tokenizer.from_file(tokenizer), byte_level_encoder(ranks)

        def encode(part: str) -> list[int]:
            part = part[1:] if part[0] == FIRST else f" {part}"
            return whole.encode(part, add_special_tokens=False).ids if SPECIAL in part else fast(part)

        words = byte_level_words(ranks)

        def encode_all(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Fragments without white space go through one call; first, special and other ones through a call each."""
            alone = np.fromiter((part[0] == FIRST or SPECIAL in part or part.split() != [part] for part in parts), bool, len(parts))
            ids, found = words([part for part, odd in zip(parts, alone) if not odd]), [encode(part) for part, odd in zip(parts, alone) if odd]
            sizes = np.zeros(len(parts), np.int64)
            sizes[~alone], sizes[alone] = ids[1], list(map(len, found))
            odd, flat = np.repeat(alone, sizes), np.zeros(int(sizes.sum()), np.int32)
            flat[~odd], flat[odd] = ids[0], list(chain.from_iterable(found))
            return flat, sizes

        self.pool = TokenPool(encode, most=600_000, encode_all=encode_all)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts = [fragments(t) if t else [] for t in texts]
        ids, sizes = self.pool([p for ps in parts for p in ps])
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, parts)])]
        for a, b in zip(ends[:-1], ends[1:]):
            yield ids[a:b]


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenise(tokenizer: str, ranks: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = DocumentTokens(tokenizer, ranks)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens(batch.column("text").to_pylist())):
                ids = np.append(ids, END).astype("<u4")
                first = len(ids) % most or most
                borders = [0, *range(first, len(ids) + 1, most)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(borders[:-1], borders[1:]))]
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])
    return run


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that still takes it."""
    bins, by_free, mask = [], [[] for _ in range(most + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = most, len(bins)
            bins.append([])
        bins[b].append(i)
        by_free[free - size].append(b)
        mask |= 1 << (free - size)
    return bins


def _singles(members: list[int], lengths: np.ndarray) -> dict[int, tuple[int, ...]]:
    """One document of each size in a bin; at most 63 sizes of a bin of 2048 tokens differ."""
    return {int(lengths[i]): (i,) for i in reversed(members)}


def _pairs(members: list[int], lengths: np.ndarray) -> dict[int, tuple[int, ...]]:
    """Two documents of each size that two of a bin have together."""
    by_size: dict[int, list[int]] = {}
    for i in members:
        by_size.setdefault(int(lengths[i]), []).append(i)
    two = {2 * s: (at[0], at[1]) for s, at in by_size.items() if len(at) > 1}
    return {s + t: (x[0], y[0]) for (s, x), (t, y) in combinations(by_size.items(), 2)} | two


class _Bins:
    """Bins, and what the underfull ones could give back: for each size the rooms of the bins that hold it, as bits, kept up to date."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, most: int):
        self.lengths, self.most = lengths, most
        self.members: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}
        self.parts: dict[int, tuple[dict, dict, dict]] = {}  # of underfull bins: nothing, one document, two documents by size
        self.rooms: tuple[dict[int, int], ...] = {}, {}, {}
        self.holders: tuple[dict[tuple[int, int], set[int]], ...] = {}, {}, {}
        for b, members in enumerate(bins):
            self.put(b, members)

    def put(self, b: int, members: list[int]) -> None:
        self.take_out(b)
        self.members[b], self.fill[b] = members, int(self.lengths[members].sum())
        if not members or self.fill[b] >= self.most:
            return
        self.parts[b] = {0: ()}, _singles(members, self.lengths), _pairs(members, self.lengths)
        room = self.most - self.fill[b]
        for found, rooms, holders in zip(self.parts[b], self.rooms, self.holders):
            for size in found:
                rooms[size] = rooms.get(size, 0) | 1 << room
                holders.setdefault((size, room), set()).add(b)

    def take_out(self, b: int) -> None:
        for found, rooms, holders in zip(self.parts.pop(b, ()), self.rooms, self.holders):
            room = self.most - self.fill[b]
            for size in found:
                at = holders[size, room]
                at.discard(b)
                if not at:
                    del holders[size, room]
                    rooms[size] &= ~(1 << room)
                    if not rooms[size]:
                        del rooms[size]

    def partner(self, give: dict[int, tuple[int, ...]], taken: int, fill: int) -> tuple[tuple[int, ...], tuple[int, ...], int] | None:
        """What to give, what to take back (`taken` documents) and from which bin, for the largest gain of a bin as full as fill or fuller."""
        rooms, allowed = self.rooms[taken], (1 << (self.most - fill + 1)) - 1
        back = np.fromiter(rooms, np.int64, len(rooms))
        widest = np.fromiter(((bits & allowed).bit_length() - 1 for bits in rooms.values()), np.int64, len(rooms))
        gain = np.fromiter(give, np.int64, len(give))[:, None] - back
        gain[(gain > widest) | (gain <= 0)] = 0
        if not gain.size or not gain.max():
            return None
        x, y = np.unravel_index(gain.argmax(), gain.shape)
        size, best = int(back[y]), int(gain[x, y])
        fitting = (rooms[size] & allowed) >> best
        least = best + (fitting & -fitting).bit_length() - 1  # the least room that takes the gain
        o = min(self.holders[taken][size, least])
        return list(give.values())[x], self.parts[o][taken][size], o

    def exchange(self, d: int) -> bool:
        """One move, else exchange one for one, two for one or one for two, from d to a bin as full or fuller."""
        members, fill, (_, one, two) = self.members[d], self.fill[d], self.parts[d]
        self.take_out(d)
        for give, taken in ((one, 0), (one, 1), (two, 1), (one, 2)):
            if best := self.partner(give, taken, fill):
                give, take, o = best
                self.put(o, [i for i in self.members[o] if i not in take] + list(give))
                self.put(d, [i for i in members if i not in give] + list(take))
                return True
        self.put(d, members)
        return False


def local_search(bins: list[list[int]], lengths: np.ndarray, most: int) -> list[list[int]]:
    """Move documents from the emptiest bins into fuller ones, raising the sum of squared fills, until bins are empty.

    Every exchange is looked for over all underfull bins and moves words from a bin to one that is as full or fuller, so the
    sum of squares rises each time and the search ends: at the least possible number of bins, or where no exchange is left.
    """
    least, live = -(-int(lengths.sum()) // most), sum(map(bool, bins))
    if live <= least:
        return [b for b in bins if b]
    state = _Bins(bins, lengths, most)
    moved = True
    while moved and live > least:
        moved = False
        for d in sorted(state.parts, key=lambda b: (state.fill[b], b)):
            while live > least and d in state.parts and state.exchange(d):
                moved = True
                live -= not state.members[d]
    return [b for b in state.members.values() if b]


def pack(lengths: np.ndarray, most: int = LENGTH) -> list[list[int]]:
    return local_search(best_fit(lengths, most), lengths, most)


def _pack_group(most: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for number, members in enumerate(pack(lengths, most)):
            sequence[members] = (int(group["bundle"].iloc[0]) << 32) + number
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return group.assign(sequence_id=sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]
    return run


def pack_documents(docs: DataFrame, most: int = LENGTH, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): its place in the document and in its sequence.

    A null or empty text is its end token alone. Texts of more than `most` tokens are cut into full pieces, the first one
    shorter; full pieces are sequences of their own. Other pieces are dealt by row to bundles of about GROUP, each packed by
    one task; a bundle wastes less than one bin more than its own optimum. Repeated rows are packed each, a null doc_id
    stays null, other columns are not read, an empty table gives an empty one.
    """
    import public_tokenizers

    small_batches(docs.sparkSession)
    paths = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(*paths, most), SCHEMA)
    pieces = staged(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    bundles = max(1, -(-pieces.where(F.col("length") < most).count() // GROUP))
    full = pieces.where(F.col("length") >= most).drop("row").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    open_ = pieces.where(F.col("length") < most).withColumn("bundle", F.pmod(F.xxhash64("row"), F.lit(bundles)))
    return open_.groupBy("bundle").applyInPandas(_pack_group(most), f"{SCHEMA}, sequence_id long, offset long").unionByName(full)
