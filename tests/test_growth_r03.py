"""Steps whose cost grew faster than their input: same results as before, in bounded parts."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from limnos.operators import matching as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else math.nan


@pytest.mark.parametrize("sizes", [(8192, 16384, (512, 4096)), (3, 40, (2, 7))])
def test_most_similar_equals_all_pairs(spark, monkeypatch, sizes):
    """Copies, null, ragged and zero vectors; blocks of any size."""
    for name, value in zip(("QUERIES", "VECTORS", "TILE"), sizes):
        monkeypatch.setattr(M, name, value)
    rng = random.Random(3)
    some = [[rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)] for _ in range(150)] + [[1.0, 1.0, 1.0, 1.0]] * 60 + [None, [0.0] * 4, [1.0, None, 0.0, 2.0], [1.0, 2.0], []]
    rng.shuffle(some)
    vectors = list(enumerate(some))
    df = spark.createDataFrame(vectors, "id long, v array<float>").repartition(3)
    got = {(r.q, r["rank"]): (r.id, r.c) for r in M.most_similar(df.where("id % 10 = 0"), df, 5).collect()}
    want = {}
    for q, a in vectors[::10]:
        scored = [(math.inf if c is not None and math.isnan(c) else -math.inf if c is None else round(c, 9), i, c) for i, b in vectors if i != q for c in [cosine(a, b)]]
        for rank, (_, i, c) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:5], 1):
            want[q, rank] = (i, c)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all((got[k][1] is None) == (c is None) and (c is None or math.isnan(c) == math.isnan(got[k][1])) and (c is None or math.isnan(c) or abs(c - got[k][1]) < 1e-12) for k, (_, c) in want.items())


def test_vector_topk_multiplies_blocks(spark):
    assert "NestedLoop" not in plan(entry.queries()["vector_topk"](spark, "/root/testdata/sf0.001"))


def test_closure_stores_no_pair_twice(spark, monkeypatch):
    """A random graph with cycles and several parents against breadth-first search."""
    from limnos.operators import graph as G

    rng = random.Random(5)
    parents = {k: {rng.randrange(60) for _ in range(rng.choice([0, 1, 1, 2]))} for k in range(60)} | {k: {k + 1} for k in range(100, 140)}
    stored, store = [], G.store
    monkeypatch.setattr(G, "store", lambda df: stored.append(store(df)) or stored[-1])
    df = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in [*ps, None]], "class long, parent long")
    want, steps = {}, 0
    for c in parents:
        level, depth = parents[c], 1
        while level:
            want |= {(c, a): depth for a in level}
            level, depth = {p for a in level for p in parents.get(a, ())} - {a for x, a in want if x == c}, depth + 1
    assert {(r["class"], r.ancestor): r.depth for r in G.ancestors(df).collect()} == want
    assert sum(s.count() for s in stored) == len(want)


def test_triples_are_dealt_by_subject_before_they_are_made(spark, monkeypatch):
    from limnos.operators import graph as G

    monkeypatch.setattr(G, "RECORDS", 10)
    events = spark.range(100).selectExpr("cast(id % 40 as string) as event_id", "'w' as eu_cd_lw", "'Messung' as record_type", "concat('s', id % 80) as statement", "cast(null as string) as time_original", "'' as quote", "'d' as source_document")
    links = spark.range(0).selectExpr("'' as relationship_id", "'' as source_event_id", "'' as target_event_id", "'' as relationship_type", "'' as mechanism", "'' as source_document")
    out = G.triples(events, links)
    assert out.count() == out.distinct().count() == 40 * 5 + 80 * 2
    own = plan(out).split("Union")[1].split("causal-link")[0]
    assert own.index("Generate") < own.index("Exchange hashpartitioning")  # in the printed tree what comes first stands below


def test_references_are_dealt_by_number_of_ids(spark, monkeypatch):
    from limnos.operators import facts as D

    monkeypatch.setattr(D, "IDS", 100)
    out = plan(entry.queries()["reference_resolution"](spark, "/root/testdata/sf0.001"))
    assert out.count("REPARTITION_BY_NUM") >= 6


def test_nearest_in_crowds_equals_all_pairs(spark, monkeypatch):
    """Crowds of several widths, equal places, lone points at the edge; the search begins with small cells."""
    stored, store = [], M.store
    monkeypatch.setattr(M, "store", lambda df: stored.append(store(df)) or stored[-1])
    rng = random.Random(8)
    at = lambda s: (rng.gauss(0.3, s), rng.gauss(-0.2, s))
    points, targets = ([at(rng.choice([1e-5, 1e-3, 0.05, 0.5])) for _ in range(400)] for _ in range(2))
    points += points[:30] + targets[:30] + [(None, 0.0)]
    targets += targets[:30] + [(0.3, None)]
    p, t = (spark.createDataFrame([(k, *xy) for k, xy in enumerate(side)], f"{name} long, x double, y double") for side, name in ((points, "id"), (targets, "target")))
    got = {r.id: (r.target, r.status) for r in M.nearest(p, t, 0.05).collect()}
    for k, (x, y) in enumerate(points):
        best = min(((math.hypot(x - a, y - b), j) for j, (a, b) in enumerate(targets) if b is not None), default=None) if x is not None else None
        far = best is None or best[0] > 0.1
        assert got[k] == ((None, "none") if far else (best[1], "auto" if best[0] <= 0.05 else "review"))
    assert len(got) == len(points) and len(stored) > 8


def test_ranges_and_pages_share_tasks_where_there_are_many(monkeypatch, tmp_path):
    from limnos.sources import datasources as ds
    from test_datasources import dbf, pages

    monkeypatch.setattr(ds, "TASKS", 4)
    for k in range(9):
        (tmp_path / f"{k}.dbf").write_bytes(dbf(k))
    pages(tmp_path, [3] * 10)
    for reader, n in ((ds.DbfReader(str(tmp_path), 2, ".dbf"), sum(range(9))), (ds.PagesReader(str(tmp_path), "wb"), 30)):
        tasks = reader.partitions()
        assert 1 < len(tasks) <= 4
        rows = [r for task in tasks for r in reader.read(task)]
        assert len(rows) == n and len(set(map(repr, rows))) == n


def test_whole_files_holds_each_row_as_a_file(spark, tmp_path):
    from limnos.sources import datasources as ds

    ds.register(spark)
    df = spark.range(20).selectExpr("concat('a', id % 3, '/', id, '.bin') as name", "cast(concat('\\0', repeat('x', cast(id as int))) as binary) as body")
    for _ in range(2):  # a second run replaces the files
        df.write.format("whole_files").mode("append").save(str(tmp_path))
    assert {str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.rglob("*") if f.is_file()} == {f"a{k % 3}/{k}.bin": b"\0" + b"x" * k for k in range(20)}


def test_few_texts_at_a_time_are_python_objects(spark):
    import pyarrow as pa

    from limnos.functions import text as T

    texts = ["a b " * 50_000, None, "", "x" * 1_001] * 50
    got = T.split_near.func(pa.array(texts), pa.array([500] * len(texts)))
    assert isinstance(got, pa.Array) and len(got) == 200
    assert [len(p) for p in got[:4].to_pylist()] == [400, 0, 0, 3] and got.slice(4).equals(got.slice(0, 196))


def test_union_takes_a_bounded_number_of_ranges(spark, monkeypatch):
    from limnos.operators import spatial as S

    monkeypatch.setattr(S, "RANGES", 2)
    parts, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: parts.append(df.rdd.getNumPartitions()) or cut(df))
    corner = lambda dx, dy: f"named_struct('x', x + {dx}, 'y', double({dy}))"
    boxes = spark.range(1000).selectExpr("id % 3 as code", "double(id div 3 % 50) as x").selectExpr("code", f"array(array(array({', '.join(corner(a, b) for a, b in ((0, 0), (2, 0), (2, 1), (0, 1), (0, 0)))}))) as geometry")
    assert {r.code: r.a for r in S.union_per_code(boxes, "code").select("code", S.area(F.col("geometry")).alias("a")).collect()} == dict.fromkeys(range(3), 51.0)
    assert max(parts) == 2
