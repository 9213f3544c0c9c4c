from pyspark.sql import functions as F

from limnos.operators import reviews as V


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_recorded_judgements(spark):
    df = spark.createDataFrame([(1, "download", "match", "science", 50.0, 0.5, "gut"), (2, "keep", "match", None, 101.0, 2.0, " ")], "id int, action string, identity string, category string, importance double, confidence double, reason string")
    got = {r.id: r.problems for r in V.judgement_problems(df, V.PREFLIGHT).collect()}
    assert got[1] == [] and sorted(got[2]) == ["invalid_action", "invalid_category", "invalid_confidence", "invalid_importance", "invalid_reason"]
    answers = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    assert rows(V.batch_problems(answers, spark.createDataFrame([(1,), (2,)], "id int")), "id", "problem") == [(1, "repeated"), (2, "unanswered"), (9, "not asked")]
    reviews = spark.createDataFrame([(1, "relevant", ["Der Salzsee ist trüb"], ["P"], ["P"], [1], [1, 2]), (2, "relevant", [], ["X"], ["P"], [3], [1]), (3, "maybe", ["steht nirgendwo geschrieben"], [], [], [], [])], "id int, decision string, evidence_quotes array<string>, topic_hits array<string>, topics array<string>, follow_link_ids array<int>, link_ids array<int>")
    fragments = spark.createDataFrame([(1, "Heute: der  SALZSEE ist trüb."), (3, "etwas anderes")], "id int, text string")
    assert {r.id: r.problems for r in V.review_problems(reviews, fragments).collect()} == {1: [], 2: ["positive_without_quote", "unknown_topic", "unknown_link"], 3: ["invalid_decision", "quote_not_in_source"]}


def test_ontology_and_fields(spark):
    classes = spark.createDataFrame([("core:Event", None), ("Flut", "core:Event"), ("a", "b"), ("b", "a")], "class string, parent string")
    events = spark.createDataFrame([("1", "Ereignis", "Flut"), ("2", "Zustand", "Flut"), ("3", "Ereignis", "?"), ("4", "Ereignis", None), ("5", "Ereignis", "a")], "event_id string, record_type string, ontology_concept string")
    got = {r.event_id: (r.fatal, r.warnings) for r in V.ontology_problems(events, classes).collect()}
    assert got == {"1": ([], []), "2": ([], ["record_type_ontology_mismatch"]), "3": (["unknown_ontology_class"], []), "4": ([], ["needs_ontology_extension"]), "5": ([], ["record_type_ontology_mismatch"])}
    facts = spark.createDataFrame([("1", "x", "unknown", [(["a"],)]), ("2", "x", "y", [(["a"],)])], "event_id string, a string, b string, evidence array<struct<field_names:array<string>>>")
    assert rows(V.field_evidence_gaps(facts, ["a", "b"]), "event_id", "missing") == [("2", ["b"])]
    t = spark.createDataFrame([("2020", "2019"), ("2020-13", None), ("2020", "2021-01")], "a string, b string").select(V.time_problems(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in t.collect()] == [["reversed"], ["invalid_start"], []]


def test_profiles_and_exports(spark):
    codes = spark.createDataFrame([("X_SAL17OW01-00",)], "code string")
    state = spark.createDataFrame([("DE_SAL17OW01-00", 2015, 1, "", "3", "2"), ("DE_ZZZ17OW01-00", 2015, 2, "1", "", "2")], "code string, cycle int, pos int, eco_stat string, eco_pot string, chem_stat string")
    part = lambda member, *v: spark.createDataFrame([("SAL17OW01-00", 2015, x) for x in v], f"code string, cycle int, {member} string")
    got = V.status_profiles(codes, state, part("qe_cd", "a", "a", ""), part("substance", "s"), part("name_stn", "n", "m"))
    assert rows(got, "short", "cycle", "eco", "chem", "n_quality", "n_substances", "n_stations") == [("SAL17OW01-00", 2015, "3", "2", 2, 1, 2)]
    assert rows(spark.createDataFrame([("2",), ("x",)], "n string").select(V.ecology_text(F.col("n")).alias("t")), "t") == [("",), ("gut",)]
    events = spark.createDataFrame([("a:1", "Bode", "Zustand", "gut\nso", "c", None, "A", [None, "q"]), ("b:1", "bode.", "Messung", "x", "c", "2020", "B", []), ("b:2", "Selke", "Messung", "y", "c", None, "B", None)], "event_id string, name string, record_type string, statement string, ontology_concept string, time_original string, source string, quotes array<string>")
    drain = spark.createDataFrame([(1, "Bode", "SAL17"), (2, "Bode", "WES")], "pos int, name string, code string")
    labels, marks = spark.createDataFrame([("Selke", 0.5, 0.5)], "target string, x double, y double"), spark.createDataFrame([("SEL1", 0.51, 0.5)], "id string, x double, y double")
    out = V.waterbody_export(events, drain, labels, marks, "SAL")
    assert [(r.wb_name, r.eu_cd_lw, r.code_source, r.n_events) for r in out["wb_name_to_code"].collect()] == [("Bode", "SAL17", "drainbasin", 2), ("Selke", "SEL1", "karte", 1)]
    assert rows(out["pdf_event"], "event_id", "statement", "quote") == [("a:1", "gut so", "q"), ("b:1", "x", ""), ("b:2", "y", "")]
    assert rows(out["pdf_waterbody"], "wb_name", "sources", "map_x") == [("Bode", "A|B", None), ("Selke", "B", 0.5)]
    rel = spark.createDataFrame([(0, "Alpha", "1", "2", "t", "s\nt", None)], "pos int, source string, source_event_id string, target_event_id string, relationship_type string, statement string, mechanism string")
    assert rows(V.relationship_export(rel), "relationship_id", "statement", "mechanism") == [("AL-rel-0", "s t", "")]


def test_overviews(spark):
    u = lambda *v: spark.createDataFrame(list(v), "site string, url string")
    docs = spark.createDataFrame([("s", "h1", "relevant"), ("s", "h1", "uncertain"), ("s", "h2", "irrelevant")], "site string, sha256 string, decision string")
    assert rows(V.site_overview(u(("s", "a"), ("s", "b")), u(("s", "b"), ("s", "c")), docs), "first", "second", "added", "together", "archived", "useful", "uncertain", "rejected") == [(2, 2, 1, 3, 2, 1, 1, 1)]
    assert rows(V.lake_summary(spark.createDataFrame([("l",), ("m",)], "lake string"), spark.createDataFrame([("l", "d", "matched"), ("l", "d", "matched"), ("l", "e", "review")], "lake string, document string, status string")), "lake", "matched", "review", "excluded") == [("l", 1, 1, 0), ("m", 0, 0, 0)]
    assert rows(V.coverage(spark.createDataFrame([("a", "x"), ("a", "x")], "id string, layer string"), spark.createDataFrame([("a",), ("b",)], "id string"), ["x", "y"]), "id", "x", "y") == [("a", 2, 0), ("b", 0, 0)]
    f = spark.createDataFrame([("d", i, ("Salzsee " if i == 2 else "") + "wort " * 200) for i in range(6)], "doc string, pos int, text string")
    got = V.excerpts(f, ["Salzsee"], 1200, best=1).collect()
    assert sorted(r.pos for r in got) == [0, 2, 5] and all(len(r.text) <= 400 for r in got)
