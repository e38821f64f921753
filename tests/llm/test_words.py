import random
import re

import numpy as np
import pyarrow as pa

from kinetide.llm import common
from kinetide.llm.common import WORD, TokenPool, Words


def texts():
    rng = random.Random(1)
    return ["", None, "a b  c\n", "  ", "é\x0bx y z", "\x1c q\x85w", *("".join(rng.choices("aB \n\tcé日", k=rng.randint(0, 400))) for _ in range(80))]


def small_letters(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_words_against_regex(monkeypatch):
    for size in (7, 50, 1 << 20):
        monkeypatch.setattr(common, "SLICE", size)
        found, seen = Words(pa.array(texts()), lower=True), {}
        for text, hashes in zip(texts(), found):
            words = re.findall(WORD, small_letters(text or ""))
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_pool_does_not_depend_on_what_it_keeps():
    calls = []
    pool = TokenPool(lambda s: calls.append(s) or list(s.encode()), most=3)
    for part in (["ab", "c", "ab"], ["d", "e", "f", "g"], ["ab", ""], []):
        ids, sizes = pool(part)
        assert ids.tolist() == [b for p in part for b in p.encode()] and sizes.tolist() == [len(p.encode()) for p in part]
    assert calls.count("ab") == 2
    assert np.array_equal(pool(["c"])[0], [99])
