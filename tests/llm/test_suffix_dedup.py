import random

import numpy as np
from docs import frame, odd_documents

from limnos.llm import suffix_dedup
from limnos.llm.suffix_dedup import brute_force, repeated_starts


def test_backward_extension_matches_brute_force():
    rng = random.Random(6)
    for alphabet, least in (("ab", 3), ("abc", 5), ("a", 4), ("abcdefgh", 2), ("ab", 12)):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))).encode() for _ in range(12)]
        texts += [texts[0], texts[1] + texts[2]]
        got = repeated_starts(texts, least)
        starts: dict[bytes, int] = {}
        for t in texts:
            for i in range(len(t) - least + 1):
                starts[t[i : i + least]] = starts.get(t[i : i + least], 0) + 1
        want = []
        for t in texts:
            want += [i + least <= len(t) and starts[t[i : i + least]] > 1 for i in range(len(t))] + [False]
        assert got.tolist() == want


def corpus(seed):
    rng = random.Random(seed)
    rows = odd_documents(seed, n=40)
    prose = lambda n: "".join(rng.choice("abcdefgh éü\n") for _ in range(n))
    passages = [prose(rng.choice([399, 400, 401, 450, 900, 2000])) for _ in range(8)]
    for k in range(60):
        text = prose(rng.choice([0, 5, 300])) + rng.choice(passages)[rng.choice([0, 0, 1, 30]) :] + prose(rng.choice([0, 7, 500]))
        rows.append((2000 + k, text + (rng.choice(passages) if k % 3 else ""), None, None, None, None, None))
    rows.append((3000, "é" * 900 + prose(10), None, None, None, None, None))
    return rows


def report(spark, rows, **options):
    from pyspark.sql import functions as F

    cut = suffix_dedup.without_repeats(frame(spark, rows), **options)
    return sorted(map(tuple, cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


def expected(rows, window=400):
    return sorted(((r[0], *b) for r, b in zip(rows, brute_force([(r[1] or "").encode() for r in rows], window))), key=repr)


def test_matches_brute_force(spark):
    rows = corpus(1)
    got = report(spark, rows)
    assert got == expected(rows)
    assert sum(r[2] > 0 for r in got) > 40
    assert sorted(map(tuple, suffix_dedup.repeat_report(frame(spark, rows)).collect()), key=repr) == got


def test_short_windows_hot_anchors_and_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_SPANS", 3)
    rows = corpus(2)
    assert report(spark, rows, window=60, gram=12, segment=700) == expected(rows, 60)


def test_cut_documents_keep_their_columns(spark):
    rows = corpus(3)
    cut = suffix_dedup.cut_repeats(frame(spark, rows))
    assert cut.columns == frame(spark, rows).columns
    got = {(r.doc_id, r.n_chars, r.text) for r in cut.collect()}
    for r, (n, removed, *_) in zip(rows, brute_force([(r[1] or "").encode() for r in rows])):
        if not removed:
            assert (r[0], r[4], r[1]) in got
    assert cut.count() == len(rows)


def test_cut_text_is_whole_characters_and_keeps_what_the_input_holds(spark):
    assert suffix_dedup.whole_characters("aéb€c".encode(), [(2, 3), (5, 6)]) == [(1, 3), (4, 7)]
    rng = random.Random(4)
    passage = "é" + "".join(rng.choice("abcdefgh éü") for _ in range(300)) + "ü"
    texts = ["x\ufffdy è" + passage + "ñ end", "other é" + passage + "ö tail", "no repeat \ufffd here"]
    rows = [(k, t, "en", "s", len(t), None, None) for k, t in enumerate(texts)]
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.cut_repeats(frame(spark, rows), 220).collect()}
    # ñ and ö share their first byte, so it repeats and both go
    assert got == {0: ("x\ufffdy è end", 9), 1: ("other é tail", 12), 2: (texts[2], len(texts[2]))}


def test_empty_table(spark):
    assert suffix_dedup.repeat_report(frame(spark, [])).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    s = np.append(rng.integers(1, 3, 300), 0)
    assert suffix_dedup.suffix_array(s).tolist() == sorted(range(301), key=lambda i: s[i:].tolist())
