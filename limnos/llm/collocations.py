"""Phrase collocations, exact, from suffix arrays over word ids.

1. Each task cuts the texts of its rows, language by language, into shards of about SHARD_BYTES.
   A shard's words get ids from a dictionary; ids of all pieces, a zero after each, are sorted by
   suffix with prefix doubling, to the depth of the longest phrase. Neighbours' common prefixes
   give the intervals: one per n-gram of the shard, with its count.
2. Counts are merged by language and phrase, pre-aggregated before the shuffle: a phrase in
   every document is one row a task.
3. Two passes. The first counts all words and phrases of up to ``most - 1`` words. A phrase of
   ``most`` words can be frequent only if both phrases it starts and ends with are, so the second
   pass leaves out those that a bit table of the frequent ones excludes; the table has a fixed
   size, errs on one side only and changes no count.
4. Scores are exact: products are decimals of 38 digits, and whole quotients are taken. The parts
   of a phrase are looked up by joins that broadcast keys with a large share of all rows.
5. The first rows of a language are taken among the first rows of SLICES slices.

Defined results: null texts are empty, a null language is ``und``; languages without candidates
give no row, and an empty table none; repeated rows count each time; texts of any length are
cut at ends of pieces only; other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm import textcodec as tc
from limnos.llm.lookup import look_up
from limnos.session import store

SHARD_BYTES = 4 << 20
#: Bytes of texts that a task holds for shards that are not full.
HELD_BYTES = 8 << 20
#: Bytes of texts that a task is handed at a time; a longer text comes alone.
BATCH_BYTES = 4 << 20
#: Bits of the table of frequent phrases, as a power of two: 8 MB, at any size of the input.
FILTER_BITS = 26
SLICES = 64
#: Words that are made strings at a time.
_WORDS = 1 << 16
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_IS_SEPARATOR = np.isin(np.arange(256), np.frombuffer(_SEPARATORS, np.uint8))
_IS_WORD = ~(_IS_SEPARATOR | np.isin(np.arange(256), np.frombuffer(b"\x20\x09", np.uint8)))
#: A-Z to a-z, separators of pieces to line feeds.
_FOLD = bytes(10 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def word_ids(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """(the words by id, ids of all words in order with a zero after each piece; ids begin with 1)."""
    folded = data.translate(_FOLD)
    raw = np.frombuffer(folded, np.uint8)
    start, end, _ = tc.words(raw, np.array([0, len(raw)]), _IS_WORD)
    index: dict[bytes, int] = defaultdict(lambda: len(index) + 1)
    piece = np.cumsum(raw == 10, dtype=np.int32)[start] if len(start) else start
    breaks = np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)
    out = np.zeros(len(start) + (int(breaks[-1]) if len(breaks) else 0) + 1, np.int32)
    for lo in range(0, len(start), _WORDS):
        hi = min(lo + _WORDS, len(start))
        out[np.arange(lo, hi) + breaks[lo:hi]] = np.fromiter(map(index.__getitem__, folded[start[lo] : end[hi - 1]].split()), np.int32, hi - lo)
    return list(index), out


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` ids from there on at least, by prefix doubling."""
    rank, k, order = ids, 1, None
    while order is None or k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        key = rank.astype(np.int64) * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        k *= 2
    return order


def intervals(ids: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a position of each n-gram, its count) for n up to ``most``: the intervals of a common prefix of n or more."""
    order = suffix_order(ids, most)
    padded = np.concatenate([ids, np.zeros(most, ids.dtype)])
    whole = np.ones(len(order), bool)
    new = np.zeros(len(order), bool)  # the common prefix with the neighbour before is shorter than n
    new[0] = True
    for n in range(1, most + 1):
        word = padded[order + n - 1]
        whole &= word > 0
        new[1:] |= word[1:] != word[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(order)))
        kept = whole[first]
        yield n, order[first[kept]], counts[kept]


def _phrases(words: pa.Array, ids: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(ids[at + k] - 1)) for k in range(n)), " ") if n > 1 else words.take(pa.array(ids[at] - 1))


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    """A hash of each word, by its bytes and the language."""
    data = np.frombuffer(b"".join(words), np.uint8)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    own = np.frombuffer(lang.encode(), np.uint8)
    with np.errstate(over="ignore"):
        return tc.mix(tc.RollingHash(data).of(at[:-1], at[1:]) + tc.RollingHash(own).of(np.array([0]), np.array([len(own)])))


def _bits(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The bit of the n words from each position."""
    out = np.zeros(len(at), _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _U(0xC2B2AE3D27D4EB4F) + hashes[ids[at + k] - 1]
    return (tc.mix(out) >> _U(64 - FILTER_BITS)).astype(np.int64)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, text of about SHARD_BYTES) from rows (lang, text); texts end with a separator."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def out(lang: str) -> tuple[str, bytes]:
        del sizes[lang]
        return lang, b"".join(held.pop(lang))

    for batch in batches:
        for lang, text in zip(batch.column(0), tc.text_array(batch.column(1))):
            lang, data = lang.as_py(), text.as_buffer()
            lo, raw = 0, np.frombuffer(data, np.uint8)
            while lo < len(raw):  # a long text goes in stretches that end with pieces
                hi = min(lo + SHARD_BYTES, len(raw))
                while hi < len(raw) and not _IS_SEPARATOR[raw[hi - 1]]:
                    more = np.flatnonzero(_IS_SEPARATOR[raw[hi : hi + SHARD_BYTES]])
                    hi = hi + int(more[0]) + 1 if len(more) else min(hi + SHARD_BYTES, len(raw))
                held[lang].append(raw[lo:hi].tobytes())
                sizes[lang] += hi - lo
                lo = hi
                if sizes[lang] >= SHARD_BYTES:
                    yield out(lang)
        while sum(sizes.values()) > HELD_BYTES:
            yield out(max(sizes, key=sizes.get))
    for lang in list(sizes):
        yield out(lang)


COUNTS = "lang string, n_words int, phrase string, c long"


def _counted(lang: str, n: int, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(counts), 100_000):
        part = phrases[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), n, np.int32)), part, pa.array(counts[lo : lo + 100_000])], ["lang", "n_words", "phrase", "c"])


def shard_counts(rows: DataFrame, lengths: range, table: bytes | None = None) -> DataFrame:
    """COUNTS of the n-grams of ``rows(lang, text)``, by shard, for each n of ``lengths``; n_words 0 counts all words.

    With ``table``, the longest n-grams are left out unless the (n-1)-grams they start and end with are in it.
    """
    most = max(lengths)
    spread = rows.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(spread.value, np.uint8) if spread else None
        for lang, data in shards(batches):
            tc.release()
            words, ids = word_ids(data)
            if not words:
                continue
            texts = pa.array(words, pa.binary()).cast(pa.string())
            hashes = _word_hashes(words, lang) if spread else None
            if 1 in lengths:
                yield from _counted(lang, 0, pa.array([""]), np.array([np.count_nonzero(ids)]))
            for n, at, counts in intervals(ids, most):
                if n not in lengths:
                    continue
                if spread and n == most:
                    for k in (0, 1):
                        bit = _bits(hashes, ids, at + k, n - 1)
                        held = (frequent[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        at, counts = at[held], counts[held]
                yield from _counted(lang, n, _phrases(texts, ids, at, n), counts)

    return rows.mapInArrow(run, COUNTS)


def bit_table(phrases: DataFrame) -> bytes:
    """The bits of ``phrases(lang, phrase)``, at most 2 ** FILTER_BITS, gathered by words of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[lang].append(phrase.encode())
            for lang, found in by_lang.items():
                words, ids = word_ids(b"\n".join(found) + b"\n")
                first = np.flatnonzero(np.concatenate([[True], ids[:-1] == 0]) & (ids > 0))
                size = np.diff(np.append(first, len(ids))) - 1
                hashes = _word_hashes(words, lang)
                for n in np.unique(size):
                    bit = _bits(hashes, ids, first[size == n], int(n))
                    np.bitwise_or.at(own, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        cells = own.view(np.int64)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], ["cell", "bits"])

    cells = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = phrases.select("lang", "phrase").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return cells.tobytes()


def frequencies(docs: DataFrame, most: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """COUNTS over all rows, of phrases of up to ``most`` words with ``least`` occurrences or more; n_words 0 counts a language's words."""
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.concat(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit("\n")).alias("text"))
    merged = lambda counts: counts.groupBy("lang", "n_words", "phrase").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | (F.col("n_words") == 0))
    setting, conf = "spark.sql.execution.arrow.maxBytesPerBatch", docs.sparkSession.conf
    before = conf.get(setting, None)
    conf.set(setting, str(BATCH_BYTES))
    try:
        short = store(merged(shard_counts(rows, range(1, most))))
        long = store(merged(shard_counts(rows, range(most, most + 1), bit_table(short.where(F.col("n_words") == most - 1)))))
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)
    return short.unionByName(long)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, first: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of 2 to ``most`` words.

    A phrase within a longer candidate that has ``share`` percent of its occurrences or more is left out.
    """
    counts = frequencies(docs, most, least, text_col, lang_col)
    words = F.split("phrase", " ")
    part = lambda lo, size: F.concat_ws(" ", F.slice(words, lo, size))
    phrases = counts.where("n_words >= 2")
    inner = phrases.where("n_words > 2").withColumn("inner", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: F.concat_ws(" ", F.slice(words, i, m)))))))
    longer = inner.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("c").alias("longest"))
    left = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("c")))
    cuts = left.select("lang", "phrase", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"), "n_words")
    cuts = store(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("tail")))
    parts = counts.where("n_words between 1 and %d" % (most - 1))
    with_head = store(look_up(cuts, parts.select("lang", F.col("phrase").alias("head"), F.col("c").alias("l")), "lang", "head"))
    both = look_up(with_head, parts.select("lang", F.col("phrase").alias("tail"), F.col("c").alias("r")), "lang", "tail")
    scored = both.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("best")).select("lang", "phrase", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ahead = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    sliced = ahead(best.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))), "lang", "slice").drop("rank", "slice")
    totals = counts.where("n_words = 0").select("lang", F.col("c").alias("n"))
    return ahead(sliced, "lang").join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
