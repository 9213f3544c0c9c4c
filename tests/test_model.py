import glob

import pytest
from pyspark.sql import functions as F

from limnos.operators import graph as G
from limnos.plans import model, questions
from limnos.sources.sinks import publish


def strings(spark, columns, rows):
    names = columns.split()
    return spark.createDataFrame([(*map(lambda v: v if v is None else str(v), r), str(i)) for i, r in enumerate(rows, 1)], ", ".join(f"{c} string" for c in [*names, "source_row_number"]))


def boxes(df, spec):
    shape = spark_box(spec)
    return df.withColumn("geometry", shape)


def spark_box(columns):
    x, y, w, h = (F.col(c).cast("double") for c in columns.split())
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(F.array(F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    raw = {
        "planunits": boxes(strings(spark, "planu_cd planu_name parti wa_cd rbd_cd land_cd delivery metadata url wbusername x y w h", [("P1", "Plan", None, None, "5000", "BB", "2021-01-02", None, None, None, 0, 0, 9, 9)]), "x y w h"),
        "lakewaterbody": boxes(strings(spark, "eu_cd_lw eu_cd_ls s_name rbd_cd planu_cd eco_stat chem_stat x y w h", [("L1", "S1", "Salzsee", "5000", "P1", "2", "3", 0, 0, 1000, 1000), ("L2", "L2", "Tiefsee", "5000", "P9", "2", "3", 5000, 0, 1000, 500)]), "x y w h"),
        "stammdaten": strings(spark, "eu_cd_lw lawa_id flaeche_atkis volumen z_max artificial_2021", [("L1", "800.0", "100", "5", "8.96", "N"), ("L2", "801", "50", "x", "20", "Y")]),
        "groundwaterbody": boxes(strings(spark, "eu_cd_gb nametext horizon planu_cd x y w h", [("G1", "Grund", "1", "P9", 500, 0, 1000, 2000)]), "x y w h"),
        "catchments": boxes(strings(spark, "drain_c drain_n area_ca planu_c x y w h", [("C1", "Gebiet", "1.5", "P1", 0, 0, 2000, 2000)]), "x y w h"),
        "messstellen": strings(spark, "eu_cd_wb eu_cd_sm name_stn x y", [("L1", "EU1", "A", 600, 10), ("L1", "EU2", "A", 10, 10)]),
        "einzeldaten": strings(spark, "eu_cd_lw messstelle id_abschnitt datum parameter qk einheit wert", [("L1", "A", "7", "2020-05-01", "Phosphor", "Q", "mg/l", "1.5"), ("L1", "B", "7", "2020-05-02", "Phosphor", "Q", "mg/l", "2.5"), ("L1", "B", None, None, None, "Q", "mg/l", "3")]),
        "einzeldaten_chemie": strings(spark, "eu_cd_lw messstelle id_abschnitt datum parameterbezeichnung qk einheit wert", [("L2", "Z", None, "03.06.2021", "blei", None, "µg/l", "4")]),
        "einzeldaten_abschnitte": strings(spark, "eu_cd_lw messstelle abschnitt jahr laenge_von", [("L1", "A", "7", "2020", "0"), ("L1", "A", "7", "2020", "1")]),
        "wasserkoerper_bewertung": strings(spark, "eu_cd_lw parameter qk jahr wert methode", [("L1", "Klasse", "D", "2015", "2", "m"), ("L1", "Klasse", "D", "2016", "999", "m"), ("L2", "Klasse", "D", "2016", "4", "m")]),
        "messstellen_bewertung": strings(spark, "eu_cd_lw messstelle parameter komponente einheit jahr wert x_wert y_wert", [("L2", "Y", "Klasse", "D", None, "2016", "7", "5100", "20"), ("LX", "Q", "Klasse", "D", None, "2016", "1", None, None)]),
        "gw_measures": strings(spark, "eu_cd_gb pollcode pollother poll_fail levelvalue", [("G1", "1245", "-9999", "Y", "NA")]),
        "ow_measures": strings(spark, "eu_cd_ls pscode ps_fail", [("S1", "1166", "N"), ("unknown", "1166", "Y"), ("L2", "1166", "Y")]),
        "ffh": boxes(strings(spark, "eu_cd_ph name prot_type leg_cd ms_cd_ph x y w h", [("F1", "Moor", "H", "H", "m", 900, 900, 500, 500)]), "x y w h"),
        "protection_area_bewertung": strings(spark, "eu_cd_p eu_cd_wb nametext", [("F1", "S1", "a"), ("F1", "G1", "b"), ("F0", "L2", "c")]),
        "core_locations": strings(spark, "core_code eu_cd_lw x_coord y_coord", [("K1", "L1", "15", "52")]),
        "paleo_elements": strings(spark, "code name ages value", [("K1", "Pb", "100", "0.5")]),
    }
    at = str(tmp_path_factory.mktemp("silver") / "model")
    publish(spark, model.build(raw), at, [])
    return {p.rstrip("/").rsplit("/", 1)[-1]: spark.read.parquet(p) for p in glob.glob(f"{at}/*/")}


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_bodies_and_identifiers(tables):
    assert rows(tables["water_body"], "water_body_id", "area_km2", "planning_unit_code", "lawa_id", "artificial") == [("L1", 1.0, "P1", 800, False), ("L2", 0.5, None, 801, True)]
    assert rows(tables["water_body_identifier"], "identifier", "water_body_id") == [("L1", "L1"), ("L2", "L2"), ("S1", "L1")]
    assert ("groundwater_body", "unresolved_planning_unit") in rows(tables["import_issue"], "target_table", "issue_type")


def test_stations_and_aliases(tables):
    assert [(r.station_id, r.name, r.station_origin) for r in tables["monitoring_station"].orderBy("station_id").collect()] == [(1, "A", "shapefile"), (2, "A", "shapefile"), (3, "B", "observed_only"), (4, "Z", "observed_only"), (5, "Y", "observed_only")]
    got = [(r.alias_id, r.alias_code, r.station_id) for r in tables["station_alias"].orderBy("alias_id").collect()]
    assert got == [(1, "EU1", 1), (2, "A", 2), (3, "EU2", 2), (4, "B", 3), (5, "Z", 4), (6, "Y", 5)]
    assert rows(tables["monitoring_station"].where("station_id = 5"), "x", "y") == [(5100.0, 20.0)]


def test_facts(tables):
    assert rows(tables["parameter"], "parameter_id", "name") == [(1, "blei"), (2, "Klasse"), (3, "Phosphor")]
    m = rows(tables["measurement"], "measurement_id", "station_id", "sampling_section_id", "value")
    assert m == [(1, 2, 1, 1.5), (2, 3, 1, 2.5), (4, 4, None, 4.0)]
    assert ("measurement", "unresolved_parameter") in rows(tables["import_issue"], "target_table", "issue_type")
    assert rows(tables["water_body_assessment"], "value_raw", "value_normalized", "is_valid") == [(2.0, 2.0, True), (4.0, 4.0, True), (999.0, None, False)]
    assert rows(tables["chemical_status"], "chemical_status_id", "groundwater_body_id", "surface_water_body_id", "failed_standard") == [(1, "G1", None, True), (2, None, "L1", False), (4, None, "L2", True)]
    assert rows(tables["protected_area_assessment"], "protected_area_id", "surface_water_body_id", "groundwater_body_id") == [("F1", "L1", None), ("F1", None, "G1"), (None, "L2", None)]
    assert model.violations(tables).count() == 0


def test_spatial_relations(tables):
    assert rows(tables["water_body_groundwater_body"], "water_body_id", F.round("overlap_area_km2", 6), F.round("water_body_overlap_ratio", 6)) == [("L1", 0.5, 0.5)]
    assert rows(tables["station_groundwater_body"], "station_id") == [(1,)]
    assert rows(tables["water_body_protected_area"], "relation_method", F.round("overlap_area_km2", 6)) == [("source_reference", None), ("spatial_intersection", 0.01)]
    x, y = tables["core_location"].select("location.x", "location.y").first()
    assert abs(x - 500000) < 0.01 and abs(y - 5761038.2) < 1


def test_graph(tables):
    own = {k: v for k, v in tables.items() if k in {s.table for s in G.NODES} | {s.table for s in G.EDGES} and k != "import_issue"}
    nodes, edges = G.nodes(own, tuple(s for s in G.NODES if s.table in own)), G.edges(own)
    assert {r.label: r["count"] for r in nodes.groupBy("label").count().collect()}["WaterBody"] == 2
    assert len(G.NODES) == 21 and len(G.EDGES) == 34
    lost = G.dangling(edges, nodes)
    assert rows(lost, "name", "missing") == [("station_assessment_water", "end")]  # the source names a lake that does not exist
    assert rows(edges.where("name = 'water_protected'"), F.col("properties")["relation_method"]) == [("source_reference",), ("spatial_intersection",)]
    assert "edges/water_protected" in {r.part for r in G.viewer_json(nodes, edges).collect()}


def test_questions(spark, tables):
    ask = {"Welcher ist der größte See?": "largest_lake", "Wie tief ist der tiefste See?": "deepest_lake", "Zusammenhang von Chemie und Bewertung?": "chemical_assessment_relation", "Welche Schadstoffe gibt es?": "chemical_status", "Bewertungen zeigen": "assessments", "Messdaten je Parameter": "measurement_summary", "FFH-Gebiete": "protected_areas", "Hallo": "graph_overview"}
    assert {q: questions.route(q) for q in ask} == ask
    got = spark.createDataFrame([(q,) for q in ask], "q string").select("q", questions.route_column(F.col("q")).alias("k")).collect()
    assert {r.q: r.k for r in got} == ask
    service = questions.QuestionService(spark, {k: v for k, v in tables.items() if k != "import_issue"})
    said = {key: service.answer(q) for q, key in ask.items()}
    assert said["largest_lake"]["interpretation"] == "Der größte See ist Salzsee mit 1,00 km²."
    assert said["deepest_lake"]["rows"].first().lake == "Tiefsee"
    relation = {r.lake_id: r for r in said["chemical_assessment_relation"]["rows"].where("assessment_value <= 5").collect()}
    assert (relation["L1"].direct_chemical_status_count, relation["L1"].derived_chemical_status_count, relation["L1"].failed_standard_count, relation["L1"].overlapping_groundwater_bodies) == (1, 1, 1, ["Grund"])
    assert rows(said["chemical_status"]["rows"], "lake_id", "derivation") == [("L1", "direkt"), ("L1", "über Grundwasser-Überlappung"), ("L2", "direkt")]
    assert said["measurement_summary"]["rows"].first().measurement_count == 2
    assert "kein Kausalnachweis" in said["chemical_assessment_relation"]["interpretation"] or "fehlen" in said["chemical_assessment_relation"]["interpretation"]
    assert service.read_only("select count(*) as n from water_body").first().n == 2
    for bad in ("DELETE FROM water_body", "select 1; drop table x", "with a as (select 1) insert into b select * from a"):
        with pytest.raises(ValueError):
            service.read_only(bad)


def test_publish_swaps_only_valid_builds(spark, tables, tmp_path):
    at = f"{tmp_path}/gold"
    publish(spark, {"water_body": tables["water_body"].drop("geometry")}, at, [lambda t: t["water_body"].where("water_body_id is null")])
    with pytest.raises(ValueError):
        publish(spark, {"water_body": tables["water_body"].drop("geometry").limit(1)}, at, [lambda t: t["water_body"]])
    assert spark.read.parquet(f"{at}/water_body").count() == 2
