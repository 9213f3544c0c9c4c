import random
import zlib

import numpy as np
import pyarrow as pa
from docs import frame

from limnos.llm import textcodec as tc
from limnos.llm import toxicity as tox


def corpus(n=1200, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([10, 60, 200]))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["zugrok", "zugrak", "vexlim", "idiot", "moron"]) + rng.choice(["", "a", "en", "s"]))
        rows.append((i, " ".join(words), "en", None, None, None, None))
        labels.append((i, 1, int(bad)))
    rows += [(n, None, *[None] * 5), (n + 1, "", *[None] * 5), (None, "no id", *[None] * 5), rows[0], (n + 2, "word " * 20_000 + "zugroken zugrak vexlims", *[None] * 5)]
    labels += [(None, 1, 1), (5, None, None), (n, 0, None)]
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    truth = {i: y for i, _, y in labels[: len(rows) - 5]}
    got = tox.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.97
    scores = {r.doc_id: r.score for r in got}
    assert scores[1200] == scores[1201] < 0.5 < scores[1202]


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = corpus(400)
    flipped = [(i, q, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    a, b = (sorted(map(tuple, tox.toxicity(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()), key=repr) for x in (labels, flipped))
    assert a == b


def test_without_labels_fixed_words_score(spark):
    rows = [(1, "you idiot", *[None] * 5), (2, "you there", *[None] * 5)]
    got = {r.doc_id: r.predicted for r in tox.toxicity(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: 1, 2: 0}
    assert tox.toxicity(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    strong = [np.where(y, rng.random(6000) < 0.9, rng.random(6000) < 0.03) for _ in range(3)]
    weak = np.where(y, rng.random(6000) < 0.5, rng.random(6000) < 0.3)
    votes = np.stack([*strong, *[weak] * 6], 1)
    q = tox.fit_label_model(votes, 0.2)
    assert ((q > 0.5) == y).mean() > 0.95 > ((votes.mean(1) > 0.5) == y).mean()


def test_hits_by_hand():
    lexicon = tox.Lexicon(np.sort(tox.insult_hashes()), np.zeros(len(tox.INSULTS), int), np.ones(len(tox.INSULTS), bool))
    doc, _, times = lexicon.hits(*tc.buffer_of(pa.array(["An IDIOT, idiot", None, "moron", "idiots"], pa.large_string())))
    assert doc.tolist() == [0, 2, 3] and times.tolist() == [2, 1, 1]
