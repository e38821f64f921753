"""Quality rules: plain counts of each text, and how well public vocabularies fit it."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kinetide.llm.common import SPACES, TokenPool, Words, byte_level_encoder, mix, small_batches, staged, unused

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
LETTER_START = np.ones(256, np.int64)  # bytes that begin a code point, white space aside
LETTER_START[0x80:0xC0] = 0
LETTER_START[[ord(c) for c in SPACES]] = 0

# First code point of each script's range, up to the next one.
SCRIPT_FROM = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00C0, "latin"), (0x0250, "other"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
# Bands of scripts: least and most characters a token, most share of characters that fall back to bytes, least token entropy as a share of what
# the text's number of tokens allows. Prose lies well inside: 1.4 to 5 characters a token, no bytes, 0.6 and more of the entropy. A text is judged by the script of most of its letters.
BANDS = {
    "latin": (1.2, 12.0, 0.15, 0.30), "greek": (0.4, 8.0, 0.60, 0.25), "cyrillic": (0.4, 8.0, 0.60, 0.25), "hebrew": (0.3, 8.0, 0.80, 0.25),
    "arabic": (0.3, 8.0, 0.80, 0.25), "indic": (0.2, 8.0, 0.95, 0.20), "thai": (0.2, 8.0, 0.95, 0.20), "kana": (0.3, 4.0, 0.80, 0.20),
    "han": (0.25, 4.0, 0.90, 0.20), "hangul": (0.25, 4.0, 0.90, 0.20), "other": (0.2, 12.0, 0.95, 0.20),
}
LEAST_TOKENS = 50  # shorter texts say too little about fertility
# The bands above hold for any text. Inside them, each group of one script and one label of language has its own, from the median and the median
# deviation of all its documents: characters a token on both sides, tokens a word above.
LEAST_DOCUMENTS = 100  # groups of fewer documents have no bands of their own
DEVIATIONS = 5.0  # that a long text may be from the median; shorter ones more, by SHORT
SHORT = 400.0

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    "chars_per_token double, byte_share double, entropy double, entropy_share double, base_failed boolean, kept boolean"
)


@lru_cache(1)
def _scripts() -> tuple[np.ndarray, np.ndarray, list[str]]:
    names = list(dict.fromkeys(s for _, s in SCRIPT_FROM))
    return np.array([a for a, _ in SCRIPT_FROM]), np.array([names.index(s) for _, s in SCRIPT_FROM]), names


def script_of(text: str) -> str:
    """Script of most letters, the earlier in the table at a tie; `other` without letters."""
    begin, kind, names = _scripts()
    ascii_letters = len(text) - len(text.translate(_NO_LATIN)) if text.isascii() else -1
    if ascii_letters >= 0:
        return "latin" if ascii_letters else "other"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(kind[np.searchsorted(begin, codes, side="right") - 1], minlength=len(names))
    counts[names.index("other")] = 0
    return names[int(counts.argmax())] if counts.any() else "other"


_NO_LATIN = {c: None for c in [*range(65, 91), *range(97, 123)]}


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, n: int = 5) -> int:
    """Words inside n-word windows that are found twice or more."""
    if len(words) <= n:
        return 0
    windows = words[:len(words) - n + 1]
    for i in range(1, n):
        windows = mix(windows * np.uint64(3) + words[i:len(words) - n + 1 + i])
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(windows) + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:len(windows)] += again[:-1]
    steps[n:] -= again[:-1]
    return int((np.cumsum(steps[:-1]) > 0).sum())


class Fertility:
    """How public vocabularies fit texts: a byte-level one gives length and entropy, the characters of a byte-fallback one the share of bytes."""

    def __init__(self, byte_level: str, fallback: str):
        import sentencepiece

        self.pool, self.fallback = TokenPool(byte_level_encoder(byte_level)), sentencepiece.SentencePieceProcessor(model_file=fallback)
        self.bytes_of: dict[str, int] = {}

    def fallen(self, text: str) -> int:
        """Characters that the fallback vocabulary can only write as bytes."""
        if text.isascii():
            return 0
        known = self.bytes_of
        here = set(text)
        for c in here - known.keys():
            known[c] = int(not c.isspace() and self.fallback.piece_to_id(c) == self.fallback.unk_id())
        odd = [c for c in here if known[c]]
        return sum(map(text.count, odd))

    def __call__(self, texts: list[str]) -> Iterator[tuple[float | None, float | None, int, int]]:
        """Entropy of the tokens in bits, as a share of the most that their number allows, tokens and fallen characters of each text."""
        words = [(t.translate(_TO_SPACE) if _ODD_SPACE.search(t) else t).split() for t in texts]
        ids, sizes = self.pool([f" {w}" for ws in words for w in ws])
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, words)])]
        for text, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
            n = b - a
            share = np.unique(ids[a:b], return_counts=True)[1] / max(1, n)
            entropy = float(-(share * np.log2(share)).sum()) if n else None
            yield entropy, (entropy / float(np.log2(n)) if n > 1 else 1.0) if n else None, n, self.fallen(text)


# split() knows more spaces than the words here do; those stay inside words
_TO_SPACE = {c: "_" for c in [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]}
_ODD_SPACE = re.compile("[" + "".join(map(chr, _TO_SPACE)) + "]")


def in_band(script: str, chars_per_token: float, byte_share: float, entropy_share: float, tokens: int) -> bool:
    if tokens < LEAST_TOKENS:
        return True
    least, most, bytes_most, entropy_least = BANDS[script]
    return least <= chars_per_token <= most and byte_share <= bytes_most and entropy_share >= entropy_least


def _judged(batch: pa.RecordBatch, fertility: Fertility) -> list[tuple]:
    """A row of SCHEMA, without the id, for each text of a batch."""
    texts, words = [t or "" for t in batch.column("text").to_pylist()], Words(batch.column("text"), lower=False)
    chars, symbols = words.sums(LETTER_START), words.sums(SYMBOLS)
    rows = []
    for text, w, c, s, (entropy, share, tokens, fallen) in zip(texts, words, chars.tolist(), symbols.tolist(), fertility(texts)):
        repeated, script = repeated_words(w), script_of(text)
        failed = len(w) < 10 or 100 * repeated > 20 * len(w)
        per_token, fallen = (c / tokens, fallen / c) if tokens and c else (None, None)
        bare = script == "other" and text.isascii() and tokens >= LEAST_TOKENS  # many tokens and no letter of any script
        kept = not failed and not bare and in_band(script, per_token, fallen, share, tokens)
        rows.append((len(w), c, s, duplicate_lines(text), repeated, script, per_token, fallen, entropy, share, failed, kept))
    return rows


def _measure(byte_level: str, fallback: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(byte_level, fallback)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.float64()] * 4 + [pa.bool_()] * 2
        for batch in batches:
            columns = list(zip(*_judged(batch, fertility))) or [[]] * 12
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column("lang")], [*names, "lang"])
    return run


def _measured_rows(byte_level: str, fallback: str, added: list[str]):
    """Whole rows with the script, characters a token, letters and words of the text, and the verdict by the fixed bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(byte_level, fallback)
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            rows = [(r[5], r[6], r[1], r[0], r[-1]) for r in _judged(batch, fertility)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*batch.schema.names, *added])
    return run


def _far(x: Column, name: str, tokens: Column) -> Column:
    """Deviations from the group's median."""
    return (x - F.col(f"b.mid_{name}")) / (F.col(f"b.dev_{name}") * F.sqrt(1 + F.lit(SHORT) / tokens))


def _in_own_band(rows: DataFrame, script: str, per_token: str, chars: str, words: str, kept: str, lang: str) -> DataFrame:
    """rows (a written table) with the column kept set to false where a text leaves the bands of its script and language.

    Medians are aggregated by Spark over all documents that the fixed rules keep and that have LEAST_TOKENS tokens; a group
    is taken to be prose for the most part. Its documents are few numbers, merged in each task, and the bands are one row a group.
    """
    tokens = F.col(chars) / F.col(per_token)
    seen = rows.where(F.col(kept) & (tokens >= LEAST_TOKENS)).select(F.col(script).alias("s"), F.col(lang).alias("l"), F.col(per_token).alias("cpt"), (tokens / F.col(words)).alias("tpw"))
    group = F.coalesce(F.col("l"), F.lit("")), F.col("l").isNull()
    seen = seen.select("s", group[0].alias("l"), group[1].alias("none"), "cpt", "tpw")
    keys = ["s", "l", "none"]
    mids = staged(seen.groupBy(*keys).agg(F.percentile_approx("cpt", 0.5).alias("mid_cpt"), F.percentile_approx("tpw", 0.5).alias("mid_tpw"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS), "medians")
    bands = seen.join(mids, keys).groupBy(*keys, "mid_cpt", "mid_tpw").agg(
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"mid_{x}")), 0.5).alias(f"mad_{x}") for x in ("cpt", "tpw")))
    bands = staged(bands.select(*keys, "mid_cpt", "mid_tpw", *(F.greatest(1.4826 * F.col(f"mad_{x}"), 0.01 * F.col(f"mid_{x}")).alias(f"dev_{x}") for x in ("cpt", "tpw"))), "bands")
    bands = bands.select(*(F.col(k).alias(f"__{k}") for k in keys), "mid_cpt", "mid_tpw", "dev_cpt", "dev_tpw").alias("b")
    d = rows.alias("d")
    joined = d.join(bands, (F.col(f"d.{script}") == F.col("b.__s")) & (F.coalesce(F.col(f"d.{lang}"), F.lit("")) == F.col("b.__l")) & (F.col(f"d.{lang}").isNull() == F.col("b.__none")), "left")
    tokens = F.col(f"d.{chars}") / F.col(f"d.{per_token}")
    out = (F.abs(_far(F.col(f"d.{per_token}"), "cpt", tokens)) > DEVIATIONS) | (_far(tokens / F.col(f"d.{words}"), "tpw", tokens) > DEVIATIONS)
    verdict = F.col(f"d.{kept}") & ~F.coalesce((tokens >= LEAST_TOKENS) & out, F.lit(False))
    return joined.select(*(verdict.alias(c) if c == kept else F.col(f"d.`{c}`") for c in rows.columns))


def _language(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string")


def quality(docs: DataFrame, byte_level: str | None = None, fallback: str | None = None) -> DataFrame:
    """Counts, fertility and verdict of each row of docs (doc_id, text, and lang if there is one).

    Null and empty texts have no words: base_failed, all counts 0, fertility null. Repeated rows of one lang are judged alike,
    a null doc_id stays null, other columns are not read, an empty table gives an empty one. One pass over the texts, whose
    figures are written; bands come from these. Long texts are read in slices. byte_level and fallback: paths of the
    vocabularies on the executors.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _language(docs).alias("lang"))
    rows = staged(rows.mapInArrow(_measure(*_paths(byte_level, fallback)), f"{SCHEMA}, lang string"), "fertility")
    return _in_own_band(rows, "script", "chars_per_token", "word_chars", "n_words", "kept", "lang").drop("lang")


def good_documents(docs: DataFrame, byte_level: str | None = None, fallback: str | None = None) -> DataFrame:
    """The rows of docs (text and any other columns) whose text quality() keeps; rows are written once with their figures."""
    small_batches(docs.sparkSession)
    added, lang = [unused(n, docs) for n in ("script", "per_token", "chars", "words", "kept")], unused("language", docs)
    rows = docs.withColumn(lang, _language(docs))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k()) for n, k in zip(added, (T.StringType, T.DoubleType, T.LongType, T.LongType, T.BooleanType)))])
    rows = staged(rows.mapInArrow(_measured_rows(*_paths(byte_level, fallback), added), schema).where(F.col(added[-1])), "fertility", "zstd")  # whole texts, on disk as long as the result is read
    return _in_own_band(rows, *added, lang).where(F.col(added[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def _paths(byte_level: str | None, fallback: str | None) -> tuple[str, str]:
    import public_tokenizers

    return byte_level or public_tokenizers.path("byte_bpe_50k.tiktoken"), fallback or public_tokenizers.path("piece_bpe_32k.model")
