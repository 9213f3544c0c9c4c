import math

import pytest
from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.operators import aggregates as A
from limnos.operators import crawl as C
from limnos.operators import facts as D
from limnos.operators import matching as M
from limnos.operators import relational as R
from limnos.operators import sequences as Q
from limnos.operators import spatial as S


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_insert_new_keeps_null_keys_apart(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, c string, v string")
    new = spark.createDataFrame([(1, None, "z", 1), (1, "y", "n", 2), (1, "y", "n", 2)], "k int, c string, v string, extra int")
    out = R.insert_new(old, new, ["k", "c"])
    assert rows(out, "k", "c", "v", "extra") == [(1, "y", "n", 2), (1, None, "a", None), (2, "x", "b", None)]
    assert R.insert_new(out, new, ["k", "c"]).count() == out.count()


def test_either_key_and_sets(spark):
    ids = spark.createDataFrame([("L1", "S1"), ("L2", None)], "lw string, ls string")
    found, lost = R.either_key(spark.createDataFrame([("S1",), ("L2",), ("?",)], "code string"), "code", ids, ["lw", "ls"], "lw", "lake")
    assert rows(found, "code", "lake") == [("?", None), ("L2", "L2"), ("S1", "L1")] and rows(lost, "code") == [("?",)]
    parts = spark.createDataFrame([(1,), (1,), (9,)], "k int")
    assert rows(R.set_cover(parts, spark.createDataFrame([(1,), (2,)], "k int"), ["k"]), "k", "problem") == [(1, "repeated"), (2, "missing"), (9, "foreign")]
    state = R.reset_state(spark.createDataFrame([("retry", 3), ("ok", 1)], "status string, n int"), F.col("status") == "retry", {"status": F.lit("pending"), "n": F.lit(0)})
    assert rows(state, "status", "n") == [("ok", 1), ("pending", 0)]


def test_blocks_and_chunks(spark):
    cases = {"1 Einleitung ........ 4\n2 Ziel ....... 9": "toc", "Abb. 3 Lage des Sees": "caption", "Meier (1998) a\nSchmidt (2001) b\nHuber (2003a) c": "bibliography", "kurz": "noise", None: "noise", "Der See wird seit Jahren untersucht.": "content"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", D.block_class(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == cases
    blocks = spark.createDataFrame([("d", i, f"b{i}", 1 + i // 2, "x" * n) for i, n in enumerate((40, 50, 30, 200, 5))], "doc string, pos int, block_id string, page int, text string")
    got = [([b.block_id for b in r.blocks], [b.block_id for b in r.context_blocks]) for r in D.chunks(blocks, 100, 60).orderBy("chunk").collect()]
    assert got == [(["b0", "b1"], ["b2"]), (["b2"], ["b1"]), (["b3"], ["b2", "b4"]), (["b4"], [])]


def test_evidence_merging_and_references(spark):
    blocks = spark.createDataFrame([("b1", "Der Wasser-\nstand sank  stark."), ("b2", "x")], "block_id string, text string")
    facts = spark.createDataFrame([("e1", [("b1", "Wasserstand sank stark")]), ("e2", [("b2", "y"), ("b9", "z")]), ("e3", [])], "id string, evidence array<struct<block_id:string,quote:string>>")
    assert rows(D.evidence_problems(facts, blocks), "id", "problem") == [("e2", "quote not in block"), ("e2", "unknown block"), ("e3", "no evidence")]
    events = spark.createDataFrame([("a", "s", ["q1"], 1), ("b", "s", ["q2", "q1"], 2), ("c", None, ["q3"], 3)], "event_id string, statement string, evidence array<string>, pos int")
    merged, ids = D.merge_facts(events, "event_id", "pos")
    assert rows(merged, "event_id", "evidence", "merged") == [("a", ["q1", "q2"], 2), ("c", ["q3"], 1)] and rows(ids, "event_id", "canonical_id") == [("a", "a"), ("b", "a"), ("c", "c")]
    refs = spark.createDataFrame([("k1", "e1", "G1"), ("k2", "e1", "G2")], "chunk_id string, local_id string, global_id string")
    good, bad = D.resolve_references(spark.createDataFrame([("k1", "e1", "G2"), ("k2", "e1", "e7")], "chunk_id string, source string, target string"), refs, ["source", "target"])
    assert rows(good, "source", "target") == [("G1", "G2")] and rows(bad, "source", "target") == [("e1", "e7")]
    events = spark.createDataFrame([("e", None), ("f", [("A", "x"), ("B", "y")])], "event_id string, waterbody_references array<struct<name:string,role:string>>")
    assert rows(D.mentions(events), "event_id", "position", "name") == [("e", None, None), ("f", 0, "A"), ("f", 1, "B")]
    out, wrong = D.verified_batch(spark.createDataFrame([("a", "x"), ("b", "y")], "document string, content string"), spark.createDataFrame([("a", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("b", "0"), ("c", "1")], "document string, sha256 string"))
    assert rows(out, "document") == [("a",)] and rows(wrong, "document", "problem") == [("b", "changed"), ("c", "missing")]
    jobs = spark.createDataFrame([("j", ["Phosphor", "See"])], "job string, terms array<string>")
    hits = D.context_blocks(jobs, spark.createDataFrame([("b1", "Phosphor im See"), ("b2", "See"), ("b3", "nichts")], "block_id string, text string"), spark.createDataFrame([("j", "b2")], "job string, block_id string"))
    assert rows(hits, "block_id", "hits") == [("b1", 2)]


def test_similar_names_equal_all_pairs(spark):
    import difflib
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdest ") for _ in range(rng.randint(5, 24))) for _ in range(60)]
    names = base + [n[:k] + rng.choice("xyz") + n[k + rng.randint(0, 1) :] for n in base for k in (rng.randrange(len(n)), rng.randrange(len(n)))]
    names = sorted({n for n in names if len(n) >= 5})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(a, b) for a in names for b in names if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert {(r.name, r.other) for r in M.similar_names(df, df).collect()} == want and want


def test_station_links(spark):
    stations = spark.createDataFrame([("k1", "Pegel Humboldtbrücke", "Havel", "Tiefer See", 100.0, 100.0), ("k2", "Unbekannt", "Spree", "Nirgends", None, None)], "key string, name string, waterway string, water_body string, x double, y double")
    sources = spark.createDataFrame([("S1", "Humboldtbruecke", "B1", 110.0, 100.0), ("S2", "Nordufer", "B1", 900.0, 900.0), ("S3", "Westufer", "B2", 0.0, 0.0)], "station_id string, name string, water_body_id string, x double, y double")
    bodies = spark.createDataFrame([("B1", "Tiefer See"), ("B2", "Flacher Teich")], "water_body_id string, name string")
    mappings, candidates = M.link_stations(stations, sources, bodies, 2)
    got = {r.key: r for r in mappings.collect()}
    assert got["k1"].station_id == "S1" and got["k1"].status == "auto_match" and math.isclose(got["k1"].score, 65 + 0.35 * (100 - 10 / 15))
    assert got["k2"].status == "unmatched" and candidates.count() == 4
    s = spark.createDataFrame([(92.0, 5.0, None), (85.0, 10.0, None), (85.0, 5.0, None), (64.0, 50.0, None), (99.0, 50.0, 200.0)], "s double, m double, d double")
    assert [r.c for r in s.select(M.classify_score(F.col("s"), F.col("m"), F.col("d")).alias("c")).collect()] == ["auto_match", "auto_match", "review", "unmatched", "review"]


def test_evidence_fusion(spark):
    e = [("one", "c", "code", "A"), ("one", "n", "name", "A"), ("one", "n", "name", "B"), ("two", "c", "code", "A"), ("two", "n", "name", "B"), ("three", "n", "name", "A"), ("three", "n", "name", "B"), ("three", "g", "river", "B"), ("four", "c", "code", "A"), ("four", "g", "area", "Z"), ("five", "c", "code", "A"), ("six", "g", "area", "Q")]
    out = M.fuse_evidence(spark.createDataFrame(e, "item string, set_id string, kind string, target string"), spark.createDataFrame([("five", True)], "item string, blocked boolean"))
    assert {r.item: (r.status, r.targets, r.conflict) for r in out.collect()} == {"one": ("rule_assigned", ["A"], False), "two": ("needs_review", ["A", "B"], True), "three": ("rule_assigned", ["B"], False), "four": ("needs_review", ["A", "Z"], True), "five": ("needs_review", ["A"], False), "six": ("needs_review", ["Q"], False)}


def test_aliases(spark):
    aliases = spark.createDataFrame([("maximale Tiefe", "property", "WaterBody", "max_depth_m", 1.0), ("Name", "property", "WaterBody", "name", 1.0), ("Name", "property", "Station", "name", 1.0)], "alias string, kind string, label string, property string, weight double")
    q = spark.createDataFrame([("Maximale  Tiefe",), ("name",)], "query string")
    assert rows(M.alias_lookup(aliases, q), "query", "label", "property") == [("Maximale  Tiefe", "WaterBody", "max_depth_m"), ("name", "Station", "name"), ("name", "WaterBody", "name")]
    found = M.phrase_matches(spark.createDataFrame([("Wie gross ist die maximale Tiefe?",)], "question string"), aliases)
    assert rows(found, "alias", "words") == [("maximale Tiefe", 2)]


def square(x, y, w, h=None):
    h = h or w
    return [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]


def test_general_polygons(spark):
    frame = square(0, 0, 10)[0]
    holed = [[frame, [{"x": float(a), "y": float(b)} for a, b in ((3, 3), (7, 3), (7, 7), (3, 7))]]]
    ell = [[[{"x": float(a), "y": float(b)} for a, b in ((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))]]]
    shared = lambda a, b: S.shared_area(*(S.convex_parts([S._rings(p) for p in g]) for g in (a, b)))
    assert math.isclose(shared(holed, [square(0, 0, 10)]), 84.0) and math.isclose(shared(ell, [square(2, 2, 6)]), 6 * 2 + 2 * 4)
    df = spark.createDataFrame([("h", holed), ("l", ell)], "id string, geometry array<array<array<struct<x:double,y:double>>>>")
    assert rows(df, "id", S.area(F.col("geometry"))) == [("h", 84.0), ("l", 64.0)]
    points = spark.createDataFrame([("p", 5.0, 5.0), ("q", 1.0, 9.0), ("r", 9.0, 9.0)], "id string, x double, y double")
    assert rows(S.points_in_polygons(points, df), "point_id", "polygon_id") == [("q", "h"), ("q", "l"), ("r", "h")]
    assert rows(S.within_distance(points, df, 1.5), "point_id", "polygon_id", F.round("distance", 3)) == [("p", "l", 1.0), ("q", "h", 0.0), ("q", "l", 0.0), ("r", "h", 0.0)]
    lakes = df.withColumn("name", F.upper("id"))
    sites = points.withColumn("text", F.concat(F.lit("am "), F.lit("L")))
    assert ("p", "l", "named_near") in rows(S.associations(sites, lakes, 1.5), "site", "lake", "status")
    assert rows(S.union_per_code(df.withColumn("c", F.lit(1)), "c"), F.round(S.area(F.col("geometry")), 3)) == [(91.0,)]


def test_urls_and_priorities(spark):
    urls = {"HTTP://WWW.Example.de:80/a b?utm_source=x&q=1#f": "http://www.example.de/a%20b?q=1", "https://x.de:8443": "https://x.de:8443/", "ftp://x.de/": None, "http://u:p@x.de/": None, "x": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", C.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == urls
    hits = spark.createDataFrame([("http://a.de/suche?q=see", "", 0), ("http://a.de/x.pdf", "Bericht Salzsee", 2), ("http://b.lfu.de/", "nichts", 20)], "u string, t string, r int")
    assert [r.p for r in hits.select(C.hit_priority(F.col("u"), F.col("t"), F.col("r"), ["Salzsee"], ["lfu.de"]).alias("p")).collect()] == [5, 78, 48]
    links = spark.createDataFrame([("http://a/1", "Salzsee Gutachten", "Phosphor", False, True), ("http://a/2", "Impressum", "", False, False), ("http://a/3", "Arendsee", "", False, False), ("http://a/4", "weiter", "", True, False)], "u string, l string, c string, n boolean, p boolean")
    assert [r.w for r in links.select(C.link_priority(F.col("u"), F.col("l"), F.col("c"), F.col("n"), F.col("p"), ["Salzsee"], ["Phosphor"]).alias("w")).collect()] == [95, 0, 12, 0]
    text = spark.createDataFrame([("Der Salzsee hat Phosphor. https://a.de/x, doi 10.1234/ab.c",)], "t string")
    r = text.select(C.local_topics(F.col("t"), ["Salzsee"], ["Phosphor", "Blei"]).alias("a"), C.links_of_text(F.col("t")).alias("b"), C.assess(F.col("t"), ["Salzsee"], ["Phosphor"], [], F.lit(50), F.lit(False), F.lit("ok")).alias("c"), C.assess(F.col("t"), ["Salzsee"], ["Phosphor"], [], F.lit(50), F.lit(False), F.lit("ok"), geography=["Sachsen"]).alias("d"), C.assess(F.col("t"), ["Salzsee"], ["Phosphor"], [], F.lit(50), F.lit(False), F.lit("ok"), geography=["doi"]).alias("e")).first()
    assert r.a == ["Phosphor"] and r.b == ["https://a.de/x", "https://doi.org/10.1234/ab.c"] and (r.c, r.d, r.e) == ("relevant", "uncertain", "relevant")
    assert rows(spark.createDataFrame([("Müller, A. (1999) See.\nText (2001)",)], "t string").select(F.size(C.bibliographic_lines(F.col("t"))).alias("n")), "n") == [(1,)]


def test_choices(spark):
    hist = spark.createDataFrame([("p", "a", 5), ("p", "a", 3), ("p", "b", 0)], "profile string, family string, gain int")
    fam = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "profile string, family string")
    assert rows(C.family_choice(hist, fam, epsilon=0.0), "family") == [("a",)]
    assert rows(C.plausible_batches(spark.createDataFrame([(1, False, None), (1, True, False), (2, False, False)], "batch int, name_hit boolean, topic_hit boolean")), "batch", "plausible") == [(1, True), (2, False)]
    assert rows(C.shared_cache(spark.createDataFrame([("h", 1), ("h", 5)], "host string, next_allowed int")), "next_allowed") == [(5,)]
    assert rows(C.replay(spark.createDataFrame([("o", "r")], "profile string, response string"), spark.createDataFrame([("o", "n")], "old_profile string, new_profile string")), "profile", "response") == [("n", "r")]
    reg = spark.createDataFrame([("1/a", "Salzsee (Nord)", "x"), ("2", "Salzsee", "y"), ("3", "Moor", "y")], "code string, name string, region string")
    got = C.profiles(reg, spark.createDataFrame([("3", "O3")], "code string, other_code string"))
    assert rows(got, "id", "name", "identity_requires_confirmation") == [("1_a", "Salzsee", True), ("2", "Salzsee", True), ("3", "Moor", False)]
    urls = spark.createDataFrame([("p", "u1"), ("p", "u2")], "profile string, url string")
    assert rows(C.research_export(urls, spark.createDataFrame([("p", "u1", "relevant")], "profile string, url string, decision string")), "url", "bucket") == [("u1", "accepted"), ("u2", "unread")]
    assert rows(C.allowed_tasks(spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, profile string"), spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([("p",)], "profile string")), "id") == [(2,)]
    assert C.next_best(spark.createDataFrame([("a", 1), ("b", 3)], "u string, score int"), ["u"]).first().u == "b"


def test_reports(spark):
    t = spark.sql("select timestamp'2020-01-01 00:00:00' as a, timestamp'2020-01-01 00:00:10' as b union all select timestamp'2020-01-01 00:00:05', timestamp'2020-01-01 00:00:15'")
    r = A.throughput(t, "a", "b").first()
    assert (r.requests, r.busy_s, r.wall_s, round(r.concurrency, 3)) == (2, 20.0, 15.0, 1.333)
    assert rows(A.expected_counts({"x": t}, {"x": 3}), "table", "expected", "found") == [("x", 3, 2)]
    lines = spark.createDataFrame([("d", 1, "Kopf"), ("d", 2, "Kopf"), ("d", 3, "Kopf"), ("d", 1, "Text")], "doc string, page int, t string")
    assert rows(Q.repeated_lines(lines, ["doc"], "page", "t"), "t", "margin") == [("Kopf", True)] * 3 + [("Text", False)]
    assert rows(A.provenance(spark.createDataFrame([("k", 2), ("k", 1), ("k", 2)], "k string, r int"), ["k"], "r"), "rows") == [([1, 2],)]
    assert rows(spark.createDataFrame([("Alt-Ruppin", 3), ("12", 4)], "l string, i int").select(T.label_tag(F.col("l"), F.col("i")).alias("t")), "t") == [("ALT",), ("S4",)]


def test_graph_is_promoted_once(spark, tmp_path):
    from limnos.operators import graph as G

    nodes = spark.createDataFrame([("A", "1", {}), ("B", "2", {})], "label string, key string, properties map<string,string>")
    edges = spark.createDataFrame([("e", "T", "A", "1", "B", "2", {})], "name string, type string, start_label string, start_key string, end_label string, end_key string, properties map<string,string>")
    path = str(tmp_path / "graph")
    G.promote(spark, nodes, edges, path)
    with pytest.raises(ValueError, match="rebuild"):
        G.promote(spark, nodes, edges, path)
    for bad in ((nodes.union(nodes), edges), (nodes.where("label = 'A'"), edges)):
        with pytest.raises(ValueError, match="nothing was published"):
            G.promote(spark, *bad, path, rebuild=True)
    kept = G.drop_labels(nodes, edges, ["B"])
    G.promote(spark, *kept, path, rebuild=True)
    assert spark.read.parquet(path + "/nodes").count() == 1 and spark.read.parquet(path + "/edges").count() == 0
