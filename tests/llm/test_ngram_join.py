import random
import re

import numpy as np
from docs import frame, odd_documents

from limnos.llm import ngram_join
from limnos.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8, roots=False):
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in linked[i]:
                root[i] = root[j] = min(root[i], root[j])
    if roots:
        return root
    out = []
    for i in range(n):
        ids = [rows[k][0] for k in range(n) if root[k] == root[i] and rows[k][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(linked[i])))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    rows = odd_documents(n=30)
    next_id = 1000
    for group in range(12):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.choice([12, 60, 200]))]
        for copy in range(rng.choice([2, 3, 9])):
            w = list(words)
            for _ in range(rng.choice([0, 1, 1, 3])):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((next_id, " ".join(w), None, None, None, None, None))
            next_id += 1
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    assert sorted(map(tuple, ngram_join.near_duplicates(frame(spark, rows)).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_split_components_count_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "TOGETHER", 2)
    rows = corpus(2)
    assert sorted(map(tuple, ngram_join.near_duplicates(frame(spark, rows)).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    kept = ngram_join.keep_one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = kept.collect()
    by_row = {(r[0], r[1]): root for r, root in zip(rows, brute(rows, roots=True))}
    worded = [r for r in got if shingles(r.text)]
    classes = [by_row[r.doc_id, r.text] for r in worded]
    assert len(classes) == len(set(classes))
    assert set(classes) == {by_row[r[0], r[1]] for r in rows if shingles(r[1])}
    assert {(r.doc_id, r.text) for r in got if not shingles(r.text)} == {(r[0], r[1]) for r in rows if not shingles(r[1])}


def test_empty_table(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    assert ngram_join.keep_one_of_each(frame(spark, [])).count() == 0


def test_labels_meet_as_often_as_estimated():
    rng = np.random.default_rng(1)
    met = np.zeros(7)
    for _ in range(400):
        common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)])) * np.uint64(2) for _ in range(2))
        x, y = ngram_join.trie_labels(np.stack([ngram_join.signature(a), ngram_join.signature(b)]))
        for depth in range(1, 7):
            met[depth] += (x[:, : 2 * depth] == y[:, : 2 * depth]).all(1).any()
    for depth in range(1, 7):
        assert abs(met[depth] / 400 - ngram_join.meeting(0.8, depth)) < 0.02


def test_prefixes_are_shortened_until_the_recall_is_met(spark):
    rng = random.Random(7)
    rows = []
    for group in range(60):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
        other = list(words)
        for at in (20, 70):
            other[at] = f"e{rng.random()}"
        rows += [(2 * group, " ".join(words), None, None, None, None, None), (2 * group + 1, " ".join(other), None, None, None, None, None)]
    join = ngram_join.NearDuplicates(frame(spark, rows))
    depths = list(join.recalls)
    assert depths[0] == ngram_join.DEPTH and len(depths) > 1 and join.recalls[depths[-1]] >= ngram_join.RECALL > join.recalls[depths[0]]
    assert sorted(map(tuple, join.by_document().collect())) == sorted(brute(rows))


def test_components(spark):
    edges = [(1, 2), (2, 1), (3, 2), (9, 8), (7, 9), (5, 5), (20, 21), (21, 22), (22, 23), (23, 24), (30, 24)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{k: 20 for k in (20, 21, 22, 23, 24, 30)}}
