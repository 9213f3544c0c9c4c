"""Quality rules: plain text rules first, then tokeniser fertility under a public vocabulary.

Fertility is measured word by word with a byte-fallback vocabulary: code points per token,
the share of byte-fallback tokens, and the entropy of the document's token distribution
relative to the most its token count allows. A document is rejected where a figure lies
outside its bands:

* The band of its dominant script bounds what text of the script can show at all under a 32k
  vocabulary. These are fixed parameters: encoded blobs and stuck loops fall outside.
* The band of its language (of its script, where no language is given) is fitted to the corpus:
  the quartiles of code points per token over all documents of the language that pass the base
  rules. Text that the vocabulary splits far more finely than its language does is rejected:
  symbols strewn over words, tables of fragments, shouting. A language of fewer than
  LEAST_GROUP such documents has no fitted band.

The quartiles come from counts by language and hundredths, pre-aggregated before the shuffle,
so a language of a third of all rows is a few hundred rows a task. Texts are never shuffled: the
fitted bounds, a row a language, go to the documents by broadcast, as long as they are no more
than MOST_BANDS.

Defined results: a null or empty text has no words, fails the base rule and is not kept;
repeated rows are judged alike; every rule reads the whole text; an empty table gives an empty
one; a null language, or a table without that column, is grouped by script; figures on the edge
of a band are inside. Columns of documents are carried as one struct, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import textcodec as tc
from limnos.session import store

#: Characters that count as symbols, a fixed value.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Words whose tokens are kept per worker; beyond it the table starts anew.
KEPT = 200_000
#: Fitted bands: least documents of a language, and how many robust standard deviations below the median is too fine.
LEAST_GROUP = 100
DEVIATIONS = 3.0
#: Languages whose bounds are broadcast; more of them are joined by shuffle.
MOST_BANDS = 10_000
#: Least standard deviation, as a share of the median, so that a language of copies has a band too.
LEAST_SPREAD = 0.005
SCRIPTS = ("other", "latin", "cyrillic", "greek", "arabic", "indic", "kana", "han", "hangul")


@dataclass(frozen=True)
class Band:
    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float


#: By script: code points per token (least, most), most byte-fallback share, least relative entropy.
BANDS = {
    "latin": Band((1.42, 9.0), 0.20, 0.45),
    "cyrillic": Band((0.9, 8.0), 0.30, 0.45),
    "greek": Band((0.5, 6.0), 0.60, 0.40),
    "arabic": Band((0.5, 6.0), 0.70, 0.40),
    "indic": Band((0.3, 6.0), 0.90, 0.35),
    "kana": Band((0.3, 4.0), 0.90, 0.35),
    "han": Band((0.2, 4.0), 0.95, 0.35),
    "hangul": Band((0.2, 4.0), 0.95, 0.35),
    "other": Band((0.2, 9.0), 0.95, 0.35),
}


def _script_table() -> np.ndarray:
    """Script of a letter by its first UTF-8 byte; 255 where the byte tells nothing."""
    t = np.full(256, 255, np.uint8)
    for lo, hi, k in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xC9, 1), (0xCD, 0xCF, 3), (0xD0, 0xD3, 2), (0xD8, 0xDB, 4), (0xE0, 0xE0, 5), (0xE3, 0xE3, 6), (0xE4, 0xE9, 7), (0xEA, 0xED, 8), (0xD4, 0xD7, 0), (0xDC, 0xDF, 0), (0xE1, 0xE2, 0)):
        t[lo : hi + 1] = k
    return t


_SCRIPT = _script_table()
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class WordTokens:
    """Token ids of words, kept per worker in flat arrays."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pointer = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, after learning the new ones."""
        new = set(words)
        if len(self.index) + len(new) > KEPT:
            self.clear()
        new.difference_update(self.index)
        if new:
            ordered = list(new)
            found = self.model.encode([w.decode("utf-8", "replace") for w in ordered], num_threads=1)
            self.index.update(zip(ordered, range(len(self.index), len(self.index) + len(ordered))))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.pointer = np.concatenate([self.pointer, self.pointer[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum()))])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def flatten(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of the words one after the other, tokens of each word)."""
        start, size = self.pointer[at], self.pointer[at + 1] - self.pointer[at]
        first = np.cumsum(size) - size
        return self.ids[np.arange(int(size.sum())) + np.repeat(start - first, size)], size


def word_tokens(path: str) -> WordTokens:
    return tc.held(f"quality {path}", lambda: WordTokens(path))


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The plain counts of each document of a chunk."""
    n = len(at) - 1
    in_word = tc.SPACE_WORD[data]
    start, end, pointer = tc.words(data, at, tc.SPACE_WORD)
    rolling = tc.RollingHash(data)
    # lines: they begin at documents and after line feeds
    begins = np.unique(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1]))
    begins = begins[begins < len(data)]
    ends = np.minimum(np.append(begins[1:], len(data)), at[np.searchsorted(at, begins, "right")]) if len(begins) else begins
    ends = ends - ((ends > begins) & (data[np.maximum(ends - 1, 0)] == 10)) if len(begins) else ends
    seen = np.concatenate([[0], np.cumsum(in_word)])
    full = seen[ends] > seen[begins] if len(begins) else np.zeros(0, bool)
    line_doc = np.searchsorted(at, begins, "right") - 1
    doc, line = line_doc[full], rolling.of(begins[full], ends[full])
    order = np.lexsort((line, doc))
    again = np.zeros(len(order), bool)
    again[1:] = (doc[order][1:] == doc[order][:-1]) & (line[order][1:] == line[order][:-1])
    # three-word windows within a document
    word_doc = tc.doc_of(pointer)
    windows = tc.grams(rolling.of(start, end), 3)
    own = np.flatnonzero(word_doc[: len(windows)] == word_doc[2:]) if len(windows) else np.zeros(0, np.int64)
    key, wd = windows[own], word_doc[own]
    by = np.lexsort((key, wd))
    same = np.zeros(len(by) + 1, bool)
    same[1:-1] = (wd[by][1:] == wd[by][:-1]) & (key[by][1:] == key[by][:-1])
    twice = own[by[same[1:] | same[:-1]]]
    covered = np.zeros(len(start), bool)
    for k in range(3):
        covered[twice + k] = True
    return {
        "n_words": np.diff(pointer),
        "word_chars": _sums(in_word & ((data & 0xC0) != 0x80), at),
        "n_symbols": _sums(_SYMBOL[data], at),
        "n_dup_lines": np.bincount(doc[order][again], minlength=n),
        "n_repeat_words": _sums(covered, pointer),
    }


def fertility(data: np.ndarray, at: np.ndarray, tokens: WordTokens) -> dict[str, np.ndarray]:
    """chars_per_token, byte_share, entropy (relative) and script (index) of each document of a chunk."""
    n, raw = len(at) - 1, data.tobytes()
    words: list[bytes] = []
    sizes = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = raw[a:b].split()
        sizes.append(len(own))
        words += own
    ids, per_word = tokens.flatten(tokens.look_up(words)) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    word_at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    token_at = np.concatenate([[0], np.cumsum(per_word)])[word_at]
    count = np.diff(token_at)
    key = np.sort((np.repeat(np.arange(n, dtype=np.int64), count) << 20) | ids)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    c = np.diff(np.append(first, len(key))).astype(float)
    inner = np.bincount(key[first] >> 20, c * np.log2(c), minlength=n) if len(key) else np.zeros(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(count)
        entropy = np.where(count > 1, (bits - inner / count) / bits, 1.0)
        chars = _sums(tc.SPACE_WORD[data] & ((data & 0xC0) != 0x80), at)
        script_of = _SCRIPT[data]
        shares = np.stack([_sums(script_of == k, at) for k in range(len(SCRIPTS))])
        return {
            "chars_per_token": np.where(count > 0, chars / count, 0.0),
            "byte_share": np.where(count > 0, _sums(tokens.is_byte[ids], token_at) / count, 0.0),
            "entropy": entropy,
            "script": np.where(shares.sum(0) > 0, shares.argmax(0), 0),
        }


def within_bands(figures: dict[str, np.ndarray], bands: dict[str, Band]) -> np.ndarray:
    rows = [bands[s] for s in SCRIPTS]
    script = figures["script"]
    least, most = (np.array([b.chars_per_token[i] for b in rows])[script] for i in (0, 1))
    ratio = figures["chars_per_token"]
    return (ratio >= least) & (ratio <= most) & (figures["byte_share"] <= np.array([b.byte_share for b in rows])[script]) & (figures["entropy"] >= np.array([b.entropy for b in rows])[script])


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text_col: str = "text", path: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """Columns: row (all of the document's columns), the base counts, the fertility figures, base_failed, in_script_band. One narrow pass."""
    path, bands = path or default_vocabulary(), bands or BANDS
    rows = docs.select(tc.row_of(docs), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        pa.default_memory_pool().release_unused()
        for batch in batches:
            for part, column in tc.chunks(batch, "text"):
                data, at = tc.buffer_of(column)
                base, figures = base_counts(data, at), fertility(data, at, tokens)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                columns = [part.column(0), *(pa.array(base[k].astype(np.int64)) for k in LONGS)]
                columns += [pa.array(figures[k].astype(float)) for k in ("chars_per_token", "byte_share", "entropy")]
                columns += [pa.array([SCRIPTS[k] for k in figures["script"]], pa.string()), pa.array(failed), pa.array(within_bands(figures, bands))]
                yield pa.RecordBatch.from_arrays(columns, ["row", *LONGS, "chars_per_token", "byte_share", "entropy", "script", "base_failed", "in_script_band"])

    shape = tc.shape_with_row(rows, ", ".join(f"{k} bigint" for k in LONGS) + ", chars_per_token double, byte_share double, entropy double, script string, base_failed boolean, in_script_band boolean")
    return rows.mapInArrow(run, shape)


def fitted_bands(measured: DataFrame, least_group: int = LEAST_GROUP, deviations: float = DEVIATIONS) -> DataFrame:
    """(band, least): the least code points per token of each language, from ``measured(band, chars_per_token, base_failed)``."""
    counts = measured.where("not base_failed").groupBy("band", F.round("chars_per_token", 2).alias("v")).agg(F.count("*").alias("n"))
    quartiles = counts.groupBy("band").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"), F.sum("n").alias("n")).where(F.col("n") >= least_group)
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, LEAST_SPREAD * F.col("q")[1])
    return quartiles.select("band", (F.col("q")[1] - deviations * spread).alias("least"))


def _banded(measured: DataFrame, docs: DataFrame, lang_col: str) -> DataFrame:
    """With the column band: the language of the document, or else its script."""
    language = F.col(f"row.`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None)
    return measured.withColumn("band", F.coalesce(F.concat(F.lit("lang "), language), F.concat(F.lit("script "), "script")))


def _verdict(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """With the columns least (of the fitted band, or null) and kept."""
    bands = store(bands)
    judged = measured.join(F.broadcast(bands) if bands.count() <= MOST_BANDS else bands, "band", "left")
    fine = F.col("least").isNull() | (F.col("chars_per_token") >= F.col("least"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("in_script_band") & fine)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str | None = None, bands: dict[str, Band] | None = None, least_group: int = LEAST_GROUP) -> DataFrame:
    """The figures of ``measure``, and least and kept; the struct row holds all columns but the text. The texts are read once: the figures are stored, then judged."""
    measured = _banded(measure(docs, text_col, path, bands), docs, lang_col).withColumn("row", F.col("row").dropFields(f"`{text_col}`"))
    measured = store(measured)
    return _verdict(measured, fitted_bands(measured, least_group))


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, the base counts, base_failed, kept, the fertility figures and the fitted bound."""
    judged = judge(docs.select("doc_id", "text", *(c for c in docs.columns if c == "lang")))
    figures = (F.round(c, 6).alias(c) for c in ("chars_per_token", "byte_share", "entropy", "least"))
    return judged.select(F.col("row.doc_id").cast("long").alias("doc_id"), *LONGS, "base_failed", "kept", "script", *figures)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Two narrow passes over the texts, one for the fitted bounds and one that judges, so that no text is written or shuffled in between.
    """
    figures = _banded(measure(docs), docs, "lang").select("band", "chars_per_token", "base_failed")
    return _verdict(_banded(measure(docs), docs, "lang"), fitted_bands(figures)).where("kept").select("row.*")
