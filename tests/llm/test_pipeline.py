import random
import re

import test_decontam
import test_ngram_join
import test_packing
import test_quality
from docs import frame, odd_documents, padded

import corpus_pipeline
from limnos.llm.suffix_dedup import brute_force


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeinorstlhd") for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = odd_documents(n=20)
    passage, leaked = prose(120), prose(30)
    for k in range(60):
        text = prose(rng.choice([30, 70, 150, 400]))
        if k % 6 == 0:
            text += ".\n" + passage + ".\n" + prose(60)
        if k % 10 == 3:
            text += " " + leaked
        rows.append((500 + k, text, "en", "s", len(text), None, None))
        if k % 5 == 0:
            rows.append((700 + k, text + " tail", "en", "s", 1, None, None))
            rows.append((600 + k, text, None, None, None, None, None))
    return padded(rows), [(1, leaked), (2, "absent " * 20)]


def test_every_stage_matches_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == frame(spark, []).columns

    bag = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    good = kept["quality_rules"]
    passing = [r for r in rows if not test_quality.brute(r[1])[-1]]
    assert set(map(tuple, good)) <= set(passing) and len(good) >= 0.8 * len(passing)
    ones = kept["ngram_jaccard_join"]
    roots = test_ngram_join.brute([tuple(r) for r in good], roots=True)
    assert len(ones) == len(set(roots)) and set(ones) <= set(good)
    cut = kept["suffix_array_dedup"]
    want = brute_force([r.text.encode() for r in ones], corpus_pipeline.PASSAGE_BYTES)
    assert sorted((r.doc_id, len(r.text.encode())) for r in cut if r.doc_id and r.doc_id >= 500) == sorted((r.doc_id, b[0] - b[1]) for r, b in zip(ones, want) if r.doc_id and r.doc_id >= 500)
    assert any(b[1] for b in want)
    clean = kept["benchmark_decontamination"]
    assert bag(clean) == bag(r for r, b in zip(cut, test_decontam.brute([tuple(r) for r in cut], items)) if not b[-1])
    assert 0 < len(clean) < len(cut)
    padding, total = test_packing.check(kept["packing"], [tuple(r) for r in clean], 4096)
    assert padding < 0.05 * total + 4096


def test_run_applies_all_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])
