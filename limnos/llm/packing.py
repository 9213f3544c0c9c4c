"""Packing of token sequences into windows by best-fit decreasing.

Overlong documents are first cut into full windows. What remains of each document, shorter
than a window, goes by decreasing length into the open window with the least room that
still holds it; a segment tree over remaining capacities finds that window in log(window)
steps. Every partition packs its own documents; the remainders of a fixed share of documents,
chosen by a hash of id and text and carried with their ids, are cut at will to fill the gaps
that best fit leaves, and what is over at the end fills windows whose lengths are
powers of two, which need no padding. So padding stays near zero, and
only metadata (lengths, checksums, ids of that share) is shuffled, never texts.

Tokens are counted with the tokenizer library, word by word: the normaliser and the
pre-tokenizer never look across a space or a line feed, so the ids of a text are those of its
blank-separated stretches in order. Every document ends with ``end_id``.

Defined results: null and empty texts are the end id alone; a document of nothing else still
gets its piece; repeated rows are packed as often as they occur; an empty table packs to
nothing. The order of pieces depends on the partitioning, the multiset of ids never.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from limnos.llm import textcodec as tc
from limnos.llm.tokens import byte_letters
from limnos.session import cut_lineage

WINDOW = 4096
END_ID = 2
#: One document in so many carries the ids of its remainder, to be cut into gaps.
FILLER_SHARE = 24
#: Documents that one partition packs.
SHARD_ROWS = 30_000
#: Stretches whose ids are kept per worker; beyond it the table starts anew.
KEPT = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Stretches whose pieces follow from the pre-token pattern alone: printable ASCII but the apostrophe (it may begin
#: a contraction), and the letters of Latin-1, all of them stable under the vocabulary's normaliser.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordIds:
    """Little-endian 32-bit ids of blank-separated stretches, kept per worker.

    Plain stretches are cut into pre-tokens here and only those, which repeat more than
    stretches do, go through the vocabulary's merges; all other stretches go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = [t.id for t in self.model.tokenize(spelled)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        self.pieces[piece] = found
        return found

    def _learn(self, words: list[str]) -> None:
        if len(self.pieces) > KEPT:
            self.older, self.pieces = self.pieces, {}
        pieces, other = self.pieces, []  # what was in use lately survives as the older half
        for w in words:
            if _PLAIN.fullmatch(w) and "<|" not in w:
                self.known[w] = b"".join([pieces.get(p) or self._piece(p) for p in _PIECES.findall(w.lower())])
            else:
                other.append(w)
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        parted = [_folded(t).replace("\n", " ").split(" ") for t in texts]
        new = {w for p in parted for w in p}
        if len(self.known) + len(new) > KEPT:
            self.known = {"": b""}
        self._learn(list(new.difference(self.known)))
        return [b"".join(map(self.known.__getitem__, p)) for p in parted]


def _folded(text: str) -> str:
    """The text in lower case, as the normaliser would have it, where case mapping is one letter to one."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def word_ids(path: str) -> WordIds:
    return tc.held(f"packing {path}", lambda: WordIds(path))


class OpenWindows:
    """Open windows by remaining capacity: a segment tree holds, for each range of capacities, how many are open."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def _change(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def add(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room that is at least ``need``: (window, room)."""
        k = need + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        self._change(room, -1)
        return self.windows[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window of each item, room left in each window) for items of 1 to ``window`` tokens."""
    open_, room = OpenWindows(window), []
    placed = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[k]
        found = open_.tightest(n)
        if found is None:
            found = (len(room), window)
            room.append(window)
        placed[k] = found[0]
        room[found[0]] = left = found[1] - n
        if left:
            open_.add(found[0], left)
    return placed, room


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TOKENS = "doc_id long, doc_tokens long, window_crcs array<long>, rest_crc long, rest_ids binary"


def _measure(path: str, window: int, end_id: int):
    """Rows (doc_id, text) to TOKENS: checksums of the full windows and of the remainder; ids of filler remainders."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            for part, column in tc.chunks(batch, "text"):
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of.encode([t or "" for t in column.to_pylist()])):
                    ids += end
                    cut = len(ids) // (4 * window) * 4 * window
                    crc = zlib.crc32(rest := ids[cut:])
                    rows[0].append(len(ids) // 4)
                    rows[1].append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, cut, 4 * window)])
                    rows[2].append(crc)
                    rows[3].append(rest if (crc ^ (doc_id or 0) * 0x9E3779B1) % FILLER_SHARE == 0 and rest else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())],
                    ["doc_id", "doc_tokens", "window_crcs", "rest_crc", "rest_ids"],
                )

    return run


class Packer:
    """Packs the documents of one partition."""

    def __init__(self, first: int, window: int) -> None:
        self.next, self.window = first, window
        self.out: list[tuple] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def pack(self, rows: list[tuple]) -> None:
        """rows: as TOKENS."""
        w = self.window
        whole, fillers = [], []
        for doc_id, n, crcs, crc, ids in rows:
            for k, c in enumerate(crcs):
                self.out.append((doc_id, k * w, w, c, n, self.new(), 0))
            if left := n - len(crcs) * w:
                (fillers if ids else whole).append((doc_id, n - left, left, crc, n, ids))
        placed, room = best_fit_decreasing([x[2] for x in whole], w)
        base = self.next
        self.next += len(room)
        used = [0] * len(room)
        for (doc_id, start, left, crc, n, _), at in zip(whole, placed):
            self.out.append((doc_id, start, left, crc, n, base + at, used[at]))
            used[at] += left
        gaps = [(base + k, w - r, r) for k, r in sorted(enumerate(room), key=lambda x: (x[1], x[0])) if r and (w - r) & (w - r - 1)]
        self._fill(fillers, gaps)

    def _fill(self, fillers: list[tuple], gaps: list[tuple[int, int, int]]) -> None:
        """Cuts the fillers, as one stream, into the gaps (sequence, offset, room), then into windows of their own."""
        left = sum(x[2] for x in fillers)
        gaps = gaps[::-1]
        target = (0, 0, 0)
        for doc_id, start, length, _, n, ids in fillers:
            done = 0
            while done < length:
                if not target[2]:
                    if gaps:
                        target = gaps.pop()
                    else:
                        target = (self.new(), 0, self.window if left >= self.window else 1 << (left.bit_length() - 1))
                sequence, at, room = target
                take = min(room, length - done)
                self.out.append((doc_id, start + done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), n, sequence, at))
                target = (sequence, at + take, room - take)
                done += take
                left -= take


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece, see PIECES. Texts are read once; their measures are written, counted and dealt evenly."""
    path = path or default_vocabulary()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    measured = cut_lineage(rows.mapInArrow(_measure(path, window, end_id), TOKENS))
    shards = max(1, -(-measured.count() // SHARD_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, window)
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        packer.pack(rows)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for k in range(0, len(packer.out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.out[k : k + 10_000])], names)

    return measured.repartition(shards).mapInArrow(run, PIECES)
