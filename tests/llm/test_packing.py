import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinetide.llm import packing as p

TEXTS = ["", " ", "a  b", " a", "a ", "a \n b", "x <|endoftext|> y", "  q", "it's  \t\n  ok\n\n", "a  b", "\x1c a \x1d b", "é́ 日本 語 🎉 x", "a\xa0 b  c", "don't  we'll 12 3.4"]


def test_ids_are_the_tokenisers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, mine = Tokenizer.from_file(path), p.DocumentTokens(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text, ids in zip(TEXTS, mine(TEXTS)):
        assert whole.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


@pytest.mark.parametrize(("low", "high", "n"), [(1, 2047, 400), (600, 1000, 300), (1, 50, 900), (1500, 2047, 50), (5, 6, 1)])
def test_bins_hold_everything_once(low, high, n):
    lengths = np.random.default_rng(n).integers(low, high, n)
    first = p.best_fit(lengths, 2048)
    fill = lambda bins: sum(int(lengths[b].sum()) ** 2 for b in bins)
    squares, bins = fill(first), p.local_search([list(b) for b in first], lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(n)) and all(lengths[b].sum() <= 2048 for b in bins)
    assert len(bins) <= len(first) and fill(bins) >= squares


def test_search_empties_a_bin():
    lengths = np.array([6, 5, 5, 4])  # two bins of ten are enough
    assert len(p.local_search([[0], [1, 3], [2]], lengths, 10)) == 2
    assert len(p.local_search([[0], [1], [2], [3]], lengths, 10)) == 2


def test_two_for_one():
    bins = p._Bins([[0, 1], [2, 3]], np.array([3, 3, 5, 4]), 10)
    assert bins.exchange(0) and bins.fill == {0: 5, 1: 10} and sorted(bins.members[1]) == [0, 1, 3]


def test_one_for_two():
    bins = p._Bins([[0], [1, 2, 3]], np.array([5, 2, 2, 5]), 10)
    assert bins.exchange(0) and bins.fill == {0: 4, 1: 10} and sorted(bins.members[0]) == [1, 2]


def test_the_search_saves_bins_over_best_fit():
    lengths = np.random.default_rng(1).integers(600, 1000, 300)
    assert len(p.pack(lengths)) < len(p.best_fit(lengths, 2048))


def test_nothing_to_exchange_is_left():
    lengths = np.random.default_rng(1).integers(600, 1000, 120)
    bins = p.pack(lengths)
    fill = [int(lengths[b].sum()) for b in bins]
    for d, o in ((d, o) for d in range(len(bins)) for o in range(len(bins)) if d != o and fill[d] <= fill[o] < 2048):
        ones = lengths[bins[d]]
        twos = [ones[i] + ones[j] for i in range(len(ones)) for j in range(i)]
        back = lengths[bins[o]]
        two_back = [back[i] + back[j] for i in range(len(back)) for j in range(i)]
        gains = [s - t for s in ones for t in [0, *back, *two_back]] + [s - t for s in twos for t in back]
        assert not any(0 < g <= 2048 - fill[o] for g in gains)


def test_pieces_and_places(odd, none, small):
    assert p.pack_documents(none).count() == 0
    for docs in (odd, small):
        whole, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [(r.doc_id, r.text) for r in docs.collect()]
        want, total = [], 0
        for doc, text in texts:
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            total += len(ids)
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            want += [(doc or -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        got = p.pack_documents(docs).collect()
        assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for members in places.values():
            ends = 0
            for offset, length in sorted(members):
                assert offset == ends
                ends += length
            assert ends <= 2048
        assert len(places) <= -(-total // 2048) + 2
