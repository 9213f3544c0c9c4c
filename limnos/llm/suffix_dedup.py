"""Removal of long verbatim repeats: every byte under a 400-byte string that also starts elsewhere.

A 400-byte window of a document always contains the same *anchor*: the 128-byte gram with the
least hash, a function of the window's content alone. So equal windows share their anchor, and
the text is cut into *spans*: the runs of windows with one anchor, about one per 140 bytes.

1. One pass emits each span's place, the anchor's hash and the hash of the span's bytes.
2. Counting by (anchor, span) settles most windows: a span that occurs twice is a repeat
   from end to end; an anchor with a single span that occurs once repeats nowhere. Counts are
   pre-aggregated before the shuffle, so a passage in a third of all documents is one row a task.
3. What is left is the rim of the repeats: single spans whose anchor has other spans. One
   copy of each distinct span of such anchors is sorted by suffix in shards of bounded size,
   all spans of an anchor together. On the shard's Burrows-Wheeler transform, intervals are
   extended backward, breadth first, which derives common prefixes by increasing value; it
   stops at 400, and what has no value by then is a repeat. Anchors with very many distinct
   spans (a passage quoted in ever new surroundings) are settled window by window instead, by
   counting window hashes with pre-aggregation, so no group is ever gathered in one task.
4. Removed ranges go back to their documents by key; a map cuts them out.

Defined results: null and empty texts have 0 bytes; repeated rows repeat each other; texts
under 400 bytes lose nothing; windows never cross documents; very long texts are handled in
overlapping segments; an empty table gives an empty one; the columns of documents are carried as one
struct, so no name clashes. Equality of spans rests on 64-bit hashes of their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import textcodec as tc
from limnos.llm.ngram_join import with_row_key
from limnos.session import store

WINDOW = 400
GRAM = 128
#: Spans in a shard of step 3, on average; anchors with more distinct spans than that are settled by windows.
SHARD_SPANS = 1500
#: Bytes of spans that are sorted at once in a task, beyond those of one anchor.
SORTED_BYTES = 1 << 18
_U = np.uint64


def spans_of(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The spans of a chunk: doc, start and end of the bytes under its windows, anchor hash, span hash."""
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "start", "end", "anchor", "span")}
    if len(data) < window:
        return empty
    rolling = tc.RollingHash(data)
    places = np.arange(len(data) - gram + 1)
    hashes = rolling.of(places, places + gram)
    least, reach, wide = (hashes & ~_U(0xFFFFFF)) | (places.astype(_U) & _U(0xFFFFFF)), 1, window - gram + 1
    while reach * 2 <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    doc = np.searchsorted(at, np.arange(len(least)), "right") - 1
    whole = np.flatnonzero(np.arange(len(least)) + window <= at[doc + 1])
    if not len(whole):
        return empty
    low = least[whole] & _U(0xFFFFFF)
    anchor = (whole & ~0xFFFFFF) | low.astype(np.int64)
    anchor += (anchor < whole) * (1 << 24)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[whole][1:] != doc[whole][:-1])])
    first = whole[new]
    last = whole[np.append(np.flatnonzero(new)[1:] - 1, len(whole) - 1)]
    anchor = anchor[new]
    with np.errstate(over="ignore"):
        span = tc.mix(rolling.of(first, last + window) + (anchor - first).astype(_U))
    return {"doc": doc[first], "start": first, "end": last + window, "anchor": hashes[anchor].view(np.int64), "span": span.view(np.int64)}


def _segments(batch: pa.RecordBatch, limit: int, window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, bytes before them): chunks; a document longer than a chunk comes in overlapping segments."""
    for part, column in tc.chunks(batch, "text", limit):
        data, at = tc.buffer_of(column)
        if len(data) <= 4 * limit or part.num_rows > 1:
            yield part, data, at, 0
        else:
            for lo in range(0, len(data) - window + 1, limit):
                piece = data[lo : lo + limit + window - 1]
                yield part, piece, np.array([0, len(piece)]), lo


def _emit_spans(window: int, gram: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tc.release()
        for batch in batches:
            for part, data, at, lead in _segments(batch, limit, window):
                s = spans_of(data, at, window, gram)
                rows, offset = pa.array(s["doc"]), lead - at[s["doc"]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(s["start"] + offset), pa.array(s["end"] + offset), pa.array(s["anchor"]), pa.array(s["span"])],
                    ["dk", "rk", "start", "end", "anchor", "span"],
                )

    return run


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling of the suffixes that still tie; the symbols must make all suffixes distinct."""
    n, bits = len(symbols), max(1, int(symbols.max()).bit_length())
    step = max(1, 62 // bits)
    padded = np.concatenate([symbols, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << bits) | padded[k : k + n]
    order, rank, slots = np.argsort(key), np.zeros(n, np.int64), np.arange(n)
    items, key = order, key[order]
    while True:
        # rank: the first slot of the suffixes that tie
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[items] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        slots = slots[~new | np.append(~new[1:], False)]
        if not len(slots):
            return order
        items = order[slots]
        key = rank[items] * n + rank[items + step]  # a tie holds no separator yet, so it goes on
        by = np.argsort(key)
        order[slots] = items = items[by]
        key = key[by]
        step *= 2


def repeated_starts(texts: list[bytes], least: int) -> np.ndarray:
    """For the concatenated texts, whether a string of ``least`` bytes starting there, inside its text, also starts elsewhere.

    Separators are distinct symbols in text order, so no match crosses a text. Intervals of
    the Burrows-Wheeler transform are extended to the left, level by level: an interval of
    the suffixes that begin with a string w gives, for each symbol c in it, the interval of cw. The
    first interval to end at a boundary of the array fixes the common prefix there: its
    string, less the new symbol. Boundaries without a value after ``least`` levels have more.
    """
    joined = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), k) for k, t in enumerate(texts)])
    n = len(joined)
    order = suffix_array(joined)
    before = joined[order - 1]  # the transform
    by_symbol = np.argsort(before.astype(np.uint16) if len(texts) < 65_000 else before, kind="stable")
    step_left = np.empty(n, np.int64)
    step_left[by_symbol] = np.arange(n)  # place of the suffix one symbol longer
    first = joined[order]
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(least):
        size = hi - lo
        alone = size == 1
        single = step_left[lo[alone]]
        lo, size = lo[~alone], size[~alone]
        # suffixes one longer, by interval and place: those of one symbol are neighbours
        key = np.sort(np.repeat(np.arange(len(lo)) * n, size) + step_left[np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)])
        which, target = np.divmod(key, n)
        symbol = first[target]
        new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])])) if len(key) else key
        lo = np.concatenate([target[new], single])
        hi = np.concatenate([target[new] + np.diff(np.append(new, len(target))), single + 1])
        fresh = unset[hi]
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        # of intervals with one end any will do: their strings are equally long
        hi, one = np.unique(hi, return_index=True)
        lo = lo[one]
        unset[hi] = False
    long = np.zeros(n, bool)
    long[order[:-1]] |= unset[1:n]
    long[order[1:]] |= unset[1:n]
    return long


def _settle(window: int):
    """Rows (shard, dk, rk, start, bytes, single) of a shard to the repeated ranges of its single spans."""

    def run(table: pa.Table) -> pa.Table:
        tc.release()
        texts = table.column("bytes").to_pylist()
        single = table.column("single").to_numpy()
        # a task sorts its spans a part at a time: spans of an anchor stay together
        anchors = table.column("anchor").to_numpy()
        order = np.argsort(anchors, kind="stable")
        sizes = np.cumsum([len(texts[k]) for k in order])
        row, start, end = [], [], []
        lo = 0
        while lo < len(order):
            hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SORTED_BYTES, "right"))
            hi = max(hi, lo + 1)
            while hi < len(order) and anchors[order[hi]] == anchors[order[hi - 1]]:
                hi += 1
            group = order[lo:hi]
            long = repeated_starts([texts[k] for k in group], window)
            at = 0
            for k in group:
                n = len(texts[k])
                if single[k]:
                    found = np.flatnonzero(np.diff(np.concatenate([[False], long[at : at + n], [False]]).astype(np.int8)))
                    for a, b in zip(found[::2].tolist(), found[1::2].tolist()):
                        row.append(k)
                        start.append(a)
                        end.append(b - 1 + window)
                at += n + 1
            lo = hi
        own = table.take(pa.array(row, pa.int64()))
        base = own.column("start").to_numpy() if row else np.zeros(0, np.int64)
        return pa.table({"dk": own.column("dk"), "rk": own.column("rk"), "start": pa.array(base + np.array(start, np.int64)), "end": pa.array(base + np.array(end, np.int64))})

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dk, rk, text, spans) to the bytes of each span."""
    names = ["dk", "rk", "start", "anchor", "single", "hot", "bytes"]
    for batch in batches:
        texts = batch.column(2)
        for k in range(batch.num_rows):
            raw = texts[k].as_buffer().to_pybytes()
            spans = batch.column(3)[k].as_py()
            for lo in range(0, len(spans), 2000):
                part = spans[lo : lo + 2000]
                columns = [pa.array([s[c] for s in part]) for c in ("start", "anchor", "single", "hot")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k] * len(part))), batch.column(1).take(pa.array([k] * len(part))), *columns, pa.array([raw[s["start"] : s["end"]] for s in part], pa.binary())], names
                )


def _window_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column(6)[k].as_buffer(), np.uint8)
                places = np.arange(len(data) - window + 1)
                values = tc.RollingHash(data).of(places, places + window).view(np.int64)
                own = pa.array(np.full(len(places), k))
                start = batch.column(2)[k].as_py()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in (0, 1, 4)), pa.array(places + start), pa.array(values)], ["dk", "rk", "single", "start", "value"])

    return run


def repeats(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, segment: int = tc.CHUNK_BYTES) -> DataFrame:
    """(dk, rk, start, end): ranges of bytes to remove, overlapping or not, for rows (dk, rk, text)."""
    spans = store(keyed.select("dk", "rk", "text").mapInArrow(_emit_spans(window, gram, segment), "dk long, rk long, start long, end long, anchor long, span long"))
    counts = spans.groupBy("anchor", "span").agg(F.count("*").alias("n"))
    per_anchor = counts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 or least > 1")
    known = store(counts.join(per_anchor, "anchor"))
    placed = store(spans.join(known, ["anchor", "span"]).select("dk", "rk", "start", "end", "anchor", "span", "n", (F.expr("kinds > 1 and least = 1")).alias("rim"), (F.col("kinds") > SHARD_SPANS).alias("hot")))
    plain = placed.where("n > 1").select("dk", "rk", "start", "end")

    # one copy of each distinct span at the rim
    place = F.struct("dk", "rk", "start", "end", "hot")
    rim = placed.where("rim").groupBy("anchor", "span").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    wanted = rim.select("at.*", "anchor", (F.col("n") == 1).alias("single"))
    wanted = wanted.groupBy("dk", "rk").agg(F.collect_list(F.struct("start", "end", "anchor", "single", "hot")).alias("spans"))
    # repeated rows carry the same text: any one of them will do, and a second one changes nothing but work
    texts = keyed.select("dk", "rk", "text").join(wanted, ["dk", "rk"]).select("dk", "rk", "text", "spans")
    pieces = store(texts.mapInArrow(_slices, "dk long, rk long, start long, anchor long, single boolean, hot boolean, bytes binary"))
    shards = max(1, pieces.count() // SHARD_SPANS)
    cold = pieces.where("not hot").withColumn("shard", F.expr(f"pmod(xxhash64(anchor), {shards}L)"))
    sorted_ = cold.groupBy("shard").applyInArrow(_settle(window), "dk long, rk long, start long, end long")
    values = pieces.where("hot").mapInArrow(_window_hashes(window), "dk long, rk long, single boolean, start long, value long")
    twice = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    counted = values.where("single").join(twice, "value").select("dk", "rk", "start", (F.col("start") + window).alias("end"))
    return plain.union(sorted_).union(counted)


def whole_characters(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges, widened to whole UTF-8 characters, sorted and disjoint."""
    inner = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        while lo > 0 and inner(lo):
            lo -= 1
        while inner(hi):
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(whole: bool):
    """(row, text, ranges) to (row, text, n_bytes, n_removed, n_spans, kept); ``whole`` removes characters entirely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tc.release()
        for batch in batches:
            texts, ranges = tc.text_array(batch.column(1)), batch.column(2)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k in range(batch.num_rows):
                raw = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
                own = sorted((r["start"], r["end"]) for r in ranges[k].as_py()) if ranges[k].is_valid else []
                if whole and own:
                    own = whole_characters(raw, own)
                keep, removed, at, merged, edge = [], 0, 0, 0, -1
                for lo, hi in own:
                    merged += lo > edge
                    if hi > at:
                        keep.append(raw[at:lo] if lo > at else b"")
                        removed += hi - max(at, lo)
                        at = hi
                    edge = max(edge, hi)
                keep.append(raw[at:])
                out[0].append(len(raw))
                out[1].append(removed)
                out[2].append(merged)
                out[3].append(b"".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["row", "text", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, segment: int = tc.CHUNK_BYTES, whole: bool = False) -> DataFrame:
    """Columns: row (the document's columns but its text), text, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    With ``whole`` the ranges are widened to whole characters, so that what stays is valid text.
    """
    ranges = repeats(with_row_key(docs, id_col, text_col), window, gram, segment)
    ranges = store(ranges.groupBy("dk", "rk").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges")))
    doc_id, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    keyed = docs.select(tc.row_of(docs, text_col), text.alias("text"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("dk"), F.xxhash64(text).alias("rk"))
    joined = keyed.join(ranges, ["dk", "rk"], "left").select("row", "text", "ranges")
    return joined.mapInArrow(_cut(whole), tc.shape_with_row(joined, "text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))


def repeat_report(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut = without_repeats(docs.select("doc_id", "text"))
    return cut.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their repeats of ``window`` bytes or more cut out of text; n_chars, where present, follows.

    Characters of which bytes were removed go with them; all others stay, U+FFFD included. All
    documents stay, even if nothing is left of one. Columns keep their names, whatever they are.
    """
    cut = without_repeats(docs, window=window, gram=min(GRAM, window // 3), whole=True)
    whole, text = F.col("n_removed") == 0, F.col("text")
    text = F.when(whole, text).otherwise(F.col("kept").cast("string"))
    changed = {"text": text, "n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    fields = [(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return cut.select(*fields)


def brute_force(texts: list[bytes], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by definition, for small inputs."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out
