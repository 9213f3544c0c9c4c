import random
import re
from collections import Counter

import numpy as np
import pytest
from docs import frame, odd_documents

from limnos.llm import collocations as co


def brute(rows, most=3, least=10, share=50, first=2000):
    """Counters of tuples of words."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, total = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\n-\r]", (r[1] or "").translate(fold)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                counts.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    candidates = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    inside = Counter()
    for (lang, p), c in candidates.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                inside[lang, p[i : i + n]] = max(inside[lang, p[i : i + n]], c)
    out = []
    for (lang, p), a in candidates.items():
        if inside[lang, p] == 0 or 100 * inside[lang, p] < share * a:
            score, k = min((1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    ranked, rank = [], Counter()
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= first:
            ranked.append((lang, rank[lang], p.decode(), -a, left, right, total[lang], -s))
    return ranked


def prose(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["New", "York", "é", "東京", "don't", "a\x1cb", "x y"]
    sep = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!?", " :"]
    text = lambda k: "".join(rng.choice(words) + rng.choice(sep) for _ in range(k))
    return [(i, text(rng.choice([0, 1, 2, 60, 400])) + rng.choice(["", "new york city", " the new york city hall"]), rng.choice([None, "en", "en", "de", "und"])) for i in range(n)]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_rows_match_brute_force(spark, most):
    rows = prose(most) + odd_documents()
    got = co.collocations(frame(spark, rows).repartition(5), most=most).collect()
    want = brute(rows, most)
    assert len(want) > 300
    assert sorted(map(tuple, got)) == sorted(want)


def test_first_rows_ties_and_empty_tables(spark):
    rows = prose(9)
    got = co.collocations(frame(spark, rows), first=7).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, first=7))
    assert co.collocations(frame(spark, [])).count() == 0
    assert co.collocations(frame(spark, [(1, None, None), (2, " .", "en")])).count() == 0


def test_exact_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3_000_000_007, 9_000_000_011, 3_000_000_019
    assert spark.range(1).select(co._score(F.lit(a), F.lit(left), F.lit(right))).first()[0] == 1_000_000 * a * a // (left * right)


def test_shards_cut_long_texts_at_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(co, "SHARD_BYTES", 64)
    monkeypatch.setattr(co, "HELD_BYTES", 96)
    text = "".join(f"word{k} and more{'.' if k % 9 == 0 else ' '}" for k in range(200)) + "\n"
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en", "fr"], "text": [text, "short\n", "\n", "nothing to cut here " * 20 + "\n"]})
    got = list(co.shards(iter([batch])))
    assert b"".join(d for lang, d in got if lang == "en").decode() == text + "\n"
    assert all(d.endswith((b".", b"\n")) for _, d in got) and len(got) > 20


def test_intervals_are_the_counts_of_windows():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 4, 500)
    ids[-1] = 0
    for n, at, counts in co.intervals(ids, 5):
        want = Counter(tuple(ids[i : i + n]) for i in range(len(ids) - n + 1) if (ids[i : i + n] > 0).all())
        assert {tuple(ids[i : i + n]): c for i, c in zip(at, counts)} == want
