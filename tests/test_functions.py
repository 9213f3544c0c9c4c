import datetime as dt

from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.functions import values as V


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


def test_keys_and_names(spark):
    assert one(spark, "2792.0", T.key_text) == "2792" and one(spark, " ", T.key_text) is None
    assert one(spark, "Humboldtbrücke", T.ascii_tokens) == one(spark, "Humboldtbrücke", T.ascii_tokens_full) == "humboldtbruecke"
    assert one(spark, " Potsdam, Havel ", T.ascii_tokens) == "potsdam havel"
    assert one(spark, " Große   STRASSE. ", T.collapse_norm) == "grosse strasse"
    assert one(spark, "DERW_DEST_SAL17OW01-00", T.waterbody_core) == "SAL17OW01-00"
    assert one(spark, "x_SAL17OW01-00_y", T.short_code) == "SAL17OW01-00" and one(spark, "none", T.short_code) is None
    assert one(spark, "5681.3", T.digits) == "56813"
    assert sorted(one(spark, "Alt (Neu) See", T.name_variants)) == ["Alt   See", "Alt (Neu) See", "Neu"]
    assert one(spark, "Ufer-\nbereich der\n Elbe", T.quote_norm) == "Uferbereich der Elbe"
    assert one(spark, "Größter", T.accent_fold) == "großter".replace("ß", "ss")
    row = spark.createDataFrame([("DE_LW_1", "2792")], "a string, b string").select(T.composite_key(F.col("a"), F.col("b")).alias("k"), T.stable_id(F.col("a"), F.lit(None)).alias("s")).first()
    assert row.k == "7:DE_LW_1|4:2792" and len(row.s) == 64
    assert one(spark, 12345.678, lambda c: T.german_number(c), "double") == "12.345,68"
    assert one(spark, "Elbe --- (1.234 Werte)", T.option_count) == 1234
    assert one(spark, "http://u@WWW.x.de:80/a", T.host) == "www.x.de"


def test_scores(spark):
    df = spark.createDataFrame([("Pegel Alte Brücke", "Alte Bruecke Nord")], "a string, b string")
    r = df.select(T.token_set_score(F.col("a"), F.col("b")).alias("t"), T.ratcliff_ratio("a", "b").alias("q")).first()
    assert abs(r.t - 200 / 3) < 1e-9 and 0 < r.q < 1
    pieces = spark.createDataFrame([("eins zwei\ndrei vier fünf", 10)], "t string, n int").select(T.split_near("t", "n").alias("p")).first().p
    assert all(len(p) <= 10 for p in pieces) and " ".join(pieces).split() == "eins zwei drei vier fünf".split()


def test_terms_and_identity(spark):
    df = spark.createDataFrame([("Der Salzsee I ist flach. Salzsee II nicht; Salzseeufer",)], "t string")
    r = df.select(T.matched_terms(F.col("t"), ["Salzsee", "Ufer"]).alias("m"), T.identity_spans(F.col("t"), ["Salzsee I"], ["Salzsee II"], 10).alias("s")).first()
    assert r.m == ["Salzsee"] and [s.name for s in r.s] == ["Salzsee I"]


def test_numbers(spark):
    assert one(spark, "1.5", V.integer) == 1 and one(spark, "nan", V.number) is None and one(spark, "x", V.number) is None
    assert [one(spark, v, V.tri_state) for v in ("Y", "N", "ja", "0", None, "?")] == [True, False, True, False, None, None]
    assert tuple(one(spark, "< 0,05", V.qualified)) == ("<", 0.05) and tuple(one(spark, "7", V.qualified)) == (None, 7.0)
    assert one(spark, "1.234,5", V.grouped_number) == 1234.5 and one(spark, "1.23,5", V.grouped_number) is None
    assert tuple(one(spark, "<= 1.234,5 mg/l", V.quantity)) == ("<=", 1234.5, "mg/l")
    assert tuple(one(spark, " ***", V.dbf_number)) == (None, "***", "overflow")
    assert [tuple(one(spark, v, V.validity, "double"))[1:] for v in (None, 999.0, 3.0, 7.0)] == [(False, "missing"), (False, "sentinel"), (True, None), (False, "out of scale")]
    assert one(spark, "äb", V.token_estimate) == 1
    assert tuple(one(spark, "Höchstkonzentration mg/l pro Tag", V.limit_row)) == ("maximum", "day", "concentration")


def test_dates(spark):
    assert one(spark, "05.03.2020 10:30", V.timestamp_of) == dt.datetime(2020, 3, 5, 10, 30)
    assert one(spark, "2020-02-30", V.date_of) is None and one(spark, "29.02.2020", V.german_date) == "2020-02-29"
    assert [one(spark, v, V.partial_date_valid) for v in ("2020", "2020-13", "2020-02-29", "2021-02-29", None)] == [True, False, True, False, False]
    assert one(spark, "a/2019/b.csv", V.historical_path) and not one(spark, "a/b2019/c", V.historical_path)
    assert one(spark, "Daten, Stand: 01.02.2023", V.reference_date) == dt.date(2023, 2, 1)
    r = spark.createDataFrame([("2020-05", "2020"), ("2021", "2020-12-31")], "a string, b string").select(V.interval_reversed(F.col("a"), F.col("b")).alias("r")).collect()
    assert [x.r for x in r] == [False, True]


def test_collections(spark):
    assert one(spark, "b|a||b", V.split_set) == ["a", "b"]
    assert one(spark, [None, "x"], V.first_present, "array<string>") == "x"
    assert one(spark, {"a": "1", "b": None}, V.clean_properties, "map<string,string>") == {"a": "1"}
    assert one(spark, " =cmd", V.csv_guard) == "' =cmd" and one(spark, "a=1", V.csv_guard) == "a=1"
    r = spark.sql("select map('a',1,'b',2) d, map('b',3) o, array(struct('x' as key, 1 as value), struct('x' as key, 2 as value)) e").select(V.merged_config(F.col("d"), F.col("o")).alias("m"), V.last_by_key(F.col("e")).alias("l")).first()
    assert r.m == {"a": 1, "b": 3} and r.l == {"x": 2}
