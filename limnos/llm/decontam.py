"""Benchmark decontamination with suffix arrays over shards of the training text.

The benchmark is the stated query set. It is read in blocks of bounded size; for each block
every shard of documents (about a megabyte of text, inside the task that reads it) is
indexed by a suffix array over words, and every test suffix is looked up in it by binary
search, word by word, which narrows an interval of the array to all locations of the match.
Only suffixes that begin with a word gram of the block enter the array: a match of at
least that many words cannot begin anywhere else. From the interval of its window a test suffix
is followed on, word by word, over the locations that still agree, which gives its longest
verbatim match in the shard and a place of it.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after folding A-Z, compared by
64-bit hashes. A window is 10 consecutive words of an item, or the whole of a shorter item.

Defined results: null and empty texts have no words; documents without words are never
contaminated; benchmark rows without an id or without words are ignored; repeated document
rows are judged alike; repeated item ids count once. Shards never mix documents: a match
ends with its document. An empty table of documents gives an empty one, an empty benchmark hits
nothing; the columns of documents are carried as one struct, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import textcodec as tc

WINDOW = 10
GRAM = 3
#: A block of the benchmark holds this many bytes of text at most, or one longer item.
BLOCK_BYTES = 2 << 20


class TestSuffixes:
    """The distinct windows of one block of items, as rows of word hashes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        data, at = tc.buffer_of(pa.array([t for _, t in items], pa.large_string()))
        hashes, pointer = tc.folded_words(data, at)
        rows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (lo, hi) in enumerate(zip(pointer[:-1].tolist(), pointer[1:].tolist())):
            words = hashes[lo:hi].tolist()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                rows.setdefault(tuple(words[i : i + window]), []).append((k, lo + i))
        ordered = sorted(rows)
        self.names = [name for name, _ in items]
        self.items = [sorted({self.names[k] for k, _ in rows[r]}) for r in ordered]
        # the test suffixes: window, item, and the words from start to end
        self.hashes = hashes
        self.suffix_window = np.repeat(np.arange(len(ordered)), [len(rows[r]) for r in ordered])
        self.suffix_item, self.start = np.array([x for r in ordered for x in rows[r]], np.int64).reshape(-1, 2).T
        self.end = pointer[self.suffix_item + 1]
        self.length = np.array([len(r) for r in ordered], np.int64)
        self.words = np.zeros((len(ordered), window), np.uint64)
        for k, r in enumerate(ordered):
            self.words[k, : len(r)] = r
        self.gram = int(min(GRAM, self.length.min())) if ordered else GRAM
        heads = [tc.grams(self.words[k, : self.gram], self.gram) for k in range(len(ordered))]
        self.heads = np.unique(np.concatenate(heads)) if heads else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.heads & np.uint64(0xFFFFF)).astype(np.int64)] = True


class ShardIndex:
    """Suffix array over the words of one shard, of the suffixes that some test suffix may match."""

    def __init__(self, hashes: np.ndarray, pointer: np.ndarray, tests: TestSuffixes) -> None:
        self.hashes = hashes
        heads = tc.grams(hashes, tests.gram)
        at = np.flatnonzero(tests.sieve[(heads & np.uint64(0xFFFFF)).astype(np.int64)])
        at = at[np.isin(heads[at], tests.heads)] if len(at) else at
        self.doc = np.searchsorted(pointer, at, "right") - 1
        end = pointer[self.doc + 1]
        at_depth = [np.where(at + d < end, hashes[np.minimum(at + d, len(hashes) - 1)], np.uint64(0)) for d in range(tests.words.shape[1])] if len(at) else []
        order = np.lexsort(at_depth[::-1]) if len(at) else np.zeros(0, np.int64)
        self.left = (end - at)[order]
        self.at, self.doc = at[order], self.doc[order]
        self.columns = [c[order] for c in at_depth]

    def _bound(self, column: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            seen = column[np.minimum(mid, len(column) - 1)]
            go = open_ & ((seen <= value) if right else (seen < value))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    def search(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, matched): for each test suffix the array interval of its window, and its longest match in words, window at most."""
        lo, hi = np.zeros(len(tests.length), np.int64), np.full(len(tests.length), len(self.at), np.int64)
        matched = np.zeros(len(tests.length), np.int64)
        for d, column in enumerate(self.columns):
            k = np.flatnonzero((lo < hi) & (tests.length > d))
            if not len(k):
                break
            value = tests.words[k, d]
            lo[k], hi[k] = self._bound(column, lo[k], hi[k], value, False), self._bound(column, lo[k], hi[k], value, True)
            matched[k[lo[k] < hi[k]]] = d + 1
        return np.where(matched == tests.length, lo, 0), np.where(matched == tests.length, hi, 0), matched


    def longest(self, tests: TestSuffixes, lo: np.ndarray, hi: np.ndarray, pointer: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, document, first word, words) of the longest match of each item that has a window in the shard, at one of its places.

        ``lo`` and ``hi`` are the intervals of the windows. Suffixes and locations carry a key of the words read so far;
        at each further word those go on whose key the other side has.
        """
        suffix = np.flatnonzero((lo < hi)[tests.suffix_window])
        if not len(suffix):
            return []
        window = tests.suffix_window[suffix]
        words, place = tests.length[window].copy(), self.at[lo[window]]
        found = np.flatnonzero(lo < hi)
        size = (hi - lo)[found]
        at = self.at[np.arange(int(size.sum())) + np.repeat(lo[found] - (np.cumsum(size) - size), size)]
        end = pointer[np.searchsorted(pointer, at, "right")]
        at_key, depth = tc.mix(np.repeat(found, size).astype(np.uint64)), tests.words.shape[1]
        going = np.flatnonzero(words == depth)
        key = tc.mix(window[going].astype(np.uint64))
        while True:
            more, left = tests.start[suffix[going]] + depth < tests.end[suffix[going]], at + depth < end
            going, key, at, end, at_key = going[more], key[more], at[left], end[left], at_key[left]
            if not len(going) or not len(at):
                break
            with np.errstate(over="ignore"):
                key = tc.mix(key * np.uint64(3) + tests.hashes[tests.start[suffix[going]] + depth])
                at_key = tc.mix(at_key * np.uint64(3) + self.hashes[at + depth])
            known, first = np.unique(at_key, return_index=True)
            slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
            met = known[slot] == key
            going, key = going[met], key[met]
            depth += 1
            words[going], place[going] = depth, at[first[slot[met]]]
            both = np.isin(at_key, key)
            at, end, at_key = at[both], end[both], at_key[both]
        item = tests.suffix_item[suffix]
        order = np.lexsort((-words, item))
        best = order[np.concatenate([[True], item[order][1:] != item[order][:-1]])]
        doc = np.searchsorted(pointer, place[best], "right") - 1
        return list(zip(item[best].tolist(), doc.tolist(), (place[best] - pointer[doc]).tolist(), words[best].tolist()))


LONGEST = "array<struct<item:string,words:bigint,start:bigint>>"
_LONGEST = pa.list_(pa.struct([("item", pa.string()), ("words", pa.int64()), ("start", pa.int64())]))


def _merge(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans, sorted, from any spans."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]], 1)


def _pass_over(tests: TestSuffixes):
    """A map over batches (row, text, hits, items, longest) that adds what one block of items hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in tc.chunks(batch, "text", 2 << 20):
                hashes, pointer = tc.folded_words(*tc.buffer_of(column))
                n = part.num_rows
                spans: list[list[np.ndarray]] = [[] for _ in range(n)]
                names: list[set[str]] = [set() for _ in range(n)]
                longest = part.column(4).to_pylist()
                if len(tests.length) and len(hashes):
                    shard = ShardIndex(hashes, pointer, tests)
                    lo, hi, _ = shard.search(tests)
                    for q in np.flatnonzero(lo < hi):
                        found = slice(lo[q], hi[q])
                        doc, at = shard.doc[found], shard.at[found] - pointer[shard.doc[found]]
                        for d in np.unique(doc):
                            names[d].update(tests.items[q])
                            starts = at[doc == d]
                            spans[d].append(np.stack([starts, starts + tests.length[q]], 1))
                    for item, d, start, words in shard.longest(tests, lo, hi, pointer):
                        longest[d].append({"item": tests.names[item], "words": words, "start": start})
                old_hits, old_items = part.column(2).to_pylist(), part.column(3).to_pylist()
                hits, items = [], []
                for d in range(n):
                    if spans[d]:
                        had = np.array(old_hits[d], np.int64).reshape(-1, 2)
                        hits.append(_merge(np.concatenate([had, *spans[d]])).ravel().tolist())
                        items.append(sorted(names[d].union(old_items[d])))
                    else:
                        hits.append(old_hits[d])
                        items.append(old_items[d])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(longest, _LONGEST), pa.array(np.diff(pointer), pa.int64())],
                    ["row", "text", "hits", "items", "longest", "n_words"],
                )

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """Blocks of (id, text) of bounded size, streamed to the driver one partition at a time; at least one block."""
    block: list[tuple[str, str]] = []
    size = given = 0
    rows = benchmark.select(benchmark[id_col].cast("string").alias("i"), benchmark[text_col].cast("string").alias("t")).where("i is not null and t is not null")
    for row in rows.toLocalIterator():
        if block and size + len(row.t) > BLOCK_BYTES:
            given += 1
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t.encode())
    if block or not given:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns: row (all of the document's columns), n_words, hits (disjoint spans of hit words, flattened), items (sorted ids),
    longest (item, words, start: an item's longest match in the shard stands at one document of it).

    One narrow pass per block of the benchmark; documents are never shuffled.
    """
    state = docs.select(tc.row_of(docs), docs[text_col].cast("string").alias("text"))
    state = state.select("row", "text", F.expr("cast(array() as array<bigint>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), F.expr(f"cast(array() as {LONGEST})").alias("longest"))
    for block in item_blocks(benchmark, item_id, item_text):
        shape = tc.shape_with_row(state, f"text string, hits array<bigint>, items array<string>, longest {LONGEST}, n_words bigint")
        state = state.select("row", "text", "hits", "items", "longest").mapInArrow(_pass_over(TestSuffixes(block)), shape)
    return state.drop("text")


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per item with a window in any document: item_id, words of its longest verbatim match over all shards, and where it stands: doc_id, start.

    Of matches equally long in a shard one is reported; over the shards the least doc_id, nulls first, then the least start.
    """
    found = find_contamination(docs, benchmark).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.explode("longest").alias("m"))
    best = found.groupBy("m.item").agg(F.min(F.struct((-F.col("m.words")).alias("less"), "doc_id", "m.start")).alias("b"))
    return best.select(F.col("item").alias("item_id"), (-F.col("b.less")).alias("words"), "b.doc_id", "b.start")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.expr("aggregate(hits, 0L, (a, x) -> x - a)")  # ends less starts: the signs alternate from the end
    found = find_contamination(docs, benchmark).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    return find_contamination(docs, benchmark).where(F.size("hits") == 0).select("row.*")
