import hashlib
import re
from collections import defaultdict

from docs import frame, odd_documents, shaped
from pyspark.sql import functions as F

from limnos.llm import exact_dedup as ed


def brute(rows):
    """By row: the texts themselves as keys."""
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for normal, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        ahead = (best[0], len(best[1] or ""))
        kept = 0
        for r in members:
            first = (r[0], len(r[1] or "")) == ahead and not kept
            kept += first
            out.append((r[0], best[0], len(members), first, hashlib.sha256(normal.encode()).hexdigest()))
    return out


def spaced(rows):
    """More copies that differ in white space only, in a group of a third of all rows."""
    base = next(r for r in rows if r[1] and len(r[1].split()) > 50)
    return rows + [(1000 + k, base[1].replace(" ", " " * (1 + k % 3)) + "\t" * (k % 2), "en") for k in range(len(rows) // 2)]


def test_verdicts_match_brute_force(spark, tmp_path):
    rows = spaced(odd_documents())
    frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "docs"))
    assert shaped(ed.exact_dedup(spark, str(tmp_path / "docs")).collect()) == shaped(brute(rows))


def test_digests_that_clash_are_told_apart_by_bytes(spark, tmp_path):
    rows = spaced(odd_documents())
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    weak = ed.DedupState(spark, str(tmp_path / "state"), lambda normal: F.unhex(F.substring(F.sha2(normal, 256), 1, 2)))
    weak.absorb(str(tmp_path / "docs"))
    assert weak.entries().where("n > 1").count() > 5
    assert shaped(ed.verdicts(weak, spark.read.parquet(str(tmp_path / "docs"))).collect()) == shaped(brute(rows))


def test_state_outlives_runs_and_batches(spark, tmp_path):
    rows = odd_documents()
    for k in range(4):
        frame(spark, rows[k::4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        state = ed.DedupState(spark, str(tmp_path / "state"))
        state.absorb(str(tmp_path / "docs"), files_per_batch=1)
        state.absorb(str(tmp_path / "docs"))  # nothing new
    assert state.entries().agg(F.sum("n")).first()[0] == len(rows)
    assert shaped(ed.verdicts(state, spark.read.parquet(str(tmp_path / "docs"))).collect()) == shaped(brute(rows))


def test_empty_table_and_no_python_worker(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "none"))
    assert ed.exact_dedup(spark, str(tmp_path / "none")).count() == 0
    frame(spark).write.parquet(str(tmp_path / "docs"))
    plan = ed.exact_dedup(spark, str(tmp_path / "docs"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
