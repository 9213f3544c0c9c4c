"""Exact token counts by prefix dynamic programming over a byte-level BPE vocabulary.

Two levels of the same recurrence give the exact count of every prefix of a text:

* Between chunks. Where a pre-token ends with a visible character, a prefix is encoded as the
  text is, so ``count(prefix) = count(prefix up to the boundary) + count(rest)``. The running
  sum over chunks is the table. ``prefix_tables`` gives it for every text: ends of chunks in
  code points and token counts up to there. A chunk's own total comes from the tokenizer
  library and is kept per worker, because words repeat; texts with runs of white space or
  special strings get theirs from the library's own token offsets.
* Within a chunk. ``last[i]`` is the last token of the encoding of the first i bytes of a
  pre-token; it is the one vocabulary entry t that may follow ``last[i - |t|]``, and
  ``count[i] = count[i - |t|] + 1``.

Totals, truncation and budget questions are look-ups in the table (``token_counts``,
``truncated``): the total is its last entry, a budget is found by search, and the recurrence
settles the one chunk it falls into. No prefix is encoded again.

Defined results: null texts count as empty: 0 bytes, 0 tokens, an empty table. Repeated rows
give repeated rows; an empty table of documents gives an empty one; only the id and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import textcodec as tc

#: The pre-token pattern of the vocabulary files, a fixed value.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_BLANKS = regex.compile(r"\p{White_Space}+")
#: Texts with other white space, runs of it, or possibly special strings get their boundaries from the library's offsets.
_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]|<\|")
#: Chunk totals kept per worker; beyond it the table starts anew, so memory stays bounded.
KEPT = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceTable:
    """The recurrence within one pre-token."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        unletter = lambda s: bytes(back[c] for c in s)
        self.ids = {unletter(t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        self.longest = max(map(len, self.ids))
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(unletter(a), unletter(b)): r for r, (a, b) in enumerate(pairs)}
        self.may_follow = lru_cache(1 << 16)(self._may_follow)

    def merge(self, piece: bytes) -> list[bytes]:
        """The plain merge procedure, for short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: bytes, b: bytes) -> bool:
        return self.merge(a + b) == [a, b]

    def counts(self, piece: bytes) -> list[int]:
        """Token count of each prefix of the piece, by bytes, the empty one first."""
        last: list[bytes] = [b""]
        count = [0]
        for i in range(1, len(piece) + 1):
            for n in range(min(i, self.longest), 0, -1):
                t = piece[i - n : i]
                if t in self.ids and (n == i or self.may_follow(last[i - n], t)):
                    if n == i and self.merge(t) != [t]:
                        continue
                    last.append(t)
                    count.append(count[i - n] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count


class PrefixCounter:
    """Exact counts for every prefix of a text under one tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.first: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self._pieces: PieceTable | None = None

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, table: dict[str, int], missing: set[str], lead: str) -> None:
        if len(table) + len(missing) > KEPT:
            table.clear()
        ordered = list(missing)
        table.update((w, ((len(lead) + len(w)) << 32) + n) for w, n in zip(ordered, self._encode([lead + w for w in ordered])))

    def deltas(self, texts: list[str]) -> list[list[int]]:
        """Per text, for each chunk its code points (times 2**32) and tokens, in one number."""
        uneven = [i for i, t in enumerate(texts) if _UNEVEN.search(t)]
        parted = {i: [line.split(" ") for line in t.split("\n")] if t else [] for i, t in enumerate(texts)}
        for i in uneven:
            del parted[i]
        first, spaced = {line[0] for p in parted.values() for line in p}, set()
        for p in parted.values():
            for line in p:
                spaced.update(line[1:])
        for table, found, lead in ((self.first, first, ""), (self.spaced, spaced, " ")):
            if len(table) + len(found) > KEPT:
                table.clear()
            self._learn(table, found.difference(table), lead)
        one, more, feed = self.first.__getitem__, self.spaced.__getitem__, (1 << 32) + 1
        out: list[list[int]] = [[] for _ in texts]
        for i, p in parted.items():
            own = out[i]
            for k, line in enumerate(p):
                if k:
                    own.append(feed)
                own.append(one(line[0]))
                own.extend(map(more, line[1:]))
        for i in uneven:
            out[i] = self._by_offsets(texts[i])
        return out

    def _by_offsets(self, text: str) -> list[int]:
        """Chunks of any text: they end with pre-tokens whose last character is visible."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        offsets, words = found.offsets, found.word_ids
        out, at, before = [], 0, 0
        for k, (_, end) in enumerate(offsets):
            last = k + 1 == len(offsets)
            if last or (words[k] != words[k + 1] or words[k] is None) and end > at and not _BLANKS.match(text[end - 1]) and offsets[k + 1][0] >= end:
                end = len(text) if last else end
                out.append(((end - at) << 32) + k + 1 - before)
                at, before = end, k + 1
        return out

    def table(self, text: str) -> tuple[list[int], list[int], list[str]]:
        """(code points before each chunk, tokens before each chunk, chunks), with the totals last."""
        sums = np.cumsum([0, *self.deltas([text])[0]])
        at, tokens = (sums >> 32).tolist(), (sums & 0xFFFFFFFF).tolist()
        return at, tokens, [text[lo:hi] for lo, hi in zip(at, at[1:])]

    def chunk_counts(self, chunk: str) -> list[int]:
        """Exact counts of the prefixes of one chunk, by code points, the empty one first.

        A prefix that ends inside a pre-token adds that pre-token's own prefix count, by the
        recurrence. Two kinds of pre-token depend on what follows: a run of white space, which
        is one while it ends the prefix, and a contraction, which has three characters at most.
        """
        if self._pieces is None:
            self._pieces = PieceTable(self.path)
        special = chunk in self.special
        lead = _BLANKS.match(chunk)
        run = lead.group() if lead else ""
        out, before = [0], 0
        for piece in PRE_TOKEN.findall(chunk):
            if piece in _CONTRACTIONS:
                shorter = [sum(self._pieces.counts(q.encode())[-1] for q in PRE_TOKEN.findall(piece[:i])) for i in range(1, len(piece))]
                out += [before + n for n in (*shorter, self._pieces.counts(piece.encode())[-1])]
            else:
                counts, at = self._pieces.counts(piece.encode()), 0
                for c in piece:
                    at += len(c.encode())
                    out.append(before + counts[at])
            before = out[-1]
        if len(run) > 1 or run == chunk:
            counts, at = self._pieces.counts(run.encode()), 0
            for i, c in enumerate(run, 1):
                at += len(c.encode())
                out[i] = counts[at]
        if special:
            out[-1] = 1
        return out

    def count(self, text: str, prefix: int) -> int:
        """Tokens of the first ``prefix`` code points."""
        at, tokens, parts = self.table(text)
        k = int(np.searchsorted(at, prefix, "right")) - 1
        return tokens[k] if k == len(parts) or at[k] == prefix else tokens[k] + self.chunk_counts(parts[k])[prefix - at[k]]

    def longest_within(self, text: str, limit: int) -> int:
        """Code points of the longest prefix with at most ``limit`` tokens."""
        at, tokens, parts = self.table(text)
        k = int(np.searchsorted(tokens, limit, "right")) - 1
        if k >= len(parts):
            return at[-1]
        inner = self.chunk_counts(parts[k])
        return at[k] + max(i for i, n in enumerate(inner) if tokens[k] + n <= limit)


def counter(path: str) -> PrefixCounter:
    """One counter per worker process."""
    return tc.held(f"tokens {path}", lambda: PrefixCounter(path))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, ends (code points up to the end of each chunk), tokens (exact token count up to there).

    One narrow pass, no shuffle. Any prefix that ends at one of ``ends`` has the count beside it.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for part, column in tc.chunks(batch, "text"):
                _, at = tc.buffer_of(column)
                rows = counts.deltas([t or "" for t in column.to_pylist()])
                pointer = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=pointer[1:])
                sums = np.concatenate([[0], np.cumsum(np.fromiter((x for r in rows for x in r), np.int64, int(pointer[-1])))])
                sums = sums[1:] - np.repeat(sums[pointer[:-1]], np.diff(pointer))
                lists = [pa.ListArray.from_arrays(pa.array(pointer), pa.array(x.astype(np.int32))) for x in (sums >> 32, sums & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), *lists], ["doc_id", "n_bytes", "ends", "tokens"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, ends array<int>, tokens array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), all from the prefix table."""
    n_tokens = F.coalesce(F.try_element_at("tokens", F.lit(-1)), F.lit(0)).cast("long")
    return prefix_tables(docs, id_col, text_col, path).select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def tokens_up_to(tables: DataFrame, position: int) -> DataFrame:
    """(doc_id, tokens, exact_at) from stored tables: the count of the longest tabulated prefix of at most ``position`` code points."""
    inside = F.size(F.filter("ends", lambda e: e <= position))
    at = lambda c: F.when(inside > 0, F.get(F.col(c), inside - 1)).otherwise(0)
    return tables.select("doc_id", at("tokens").alias("tokens"), at("ends").alias("exact_at"))


def truncated(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, text): the longest prefix of each text with at most ``limit`` tokens."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for part, column in tc.chunks(batch, "text"):
                texts = [None if t is None else t[: counts.longest_within(t, limit)] for t in column.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")
