import random
import zlib
from collections import defaultdict

import numpy as np
from docs import frame, odd_documents
from tokenizers import Tokenizer

from limnos.llm import packing


def check(pieces, rows, window):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(texts)
    for doc_id, ids in texts.items():
        want = defaultdict(int)
        assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, ids))
        for p in by_doc[doc_id]:
            fits = [x for x in ids if len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
            assert fits and p.length > 0
            want[tuple(fits[0]), p.start] += p.length
        if len(ids) == 1:  # each id lies in exactly one piece
            at = 0
            for p in sorted(by_doc[doc_id], key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(ids[0])
    padding = total = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, total


def test_pieces_are_exact_and_padding_is_small(spark):
    rows = odd_documents(n=60)
    padding, total = check(packing.pack(frame(spark, rows)).collect(), rows, 4096)
    assert padding <= 0.05 * total + 4096


def test_small_windows(spark):
    rows = odd_documents(n=60)
    padding, total = check(packing.pack(frame(spark, rows), window=64).collect(), rows, 64)
    assert padding < 0.02 * total


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_tree_finds_the_tightest_window():
    rng = random.Random(5)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    placed, room = packing.best_fit_decreasing(lengths, 100)
    naive: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(naive) if r >= n]
        if fits:
            naive[min(fits)[1]] -= n
        else:
            naive.append(100 - n)
    assert sorted(naive) == sorted(room)
    load = defaultdict(int)
    for n, k in zip(lengths, placed):
        load[k] += n
    assert all(100 - load[k] == r for k, r in enumerate(room))
