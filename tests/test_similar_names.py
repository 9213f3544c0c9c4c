"""The segment join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from limnos.operators import matching as M

SF = "/root/testdata/sf0.01"


def all_pairs(left, right, threshold):
    out = {}
    for a in left:
        matcher = SequenceMatcher(None, "", a, autojunk=False)
        for b in right:
            if a != b and min(len(a), len(b)) >= 5:
                matcher = SequenceMatcher(None, a, b, autojunk=False)
                if matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold:
                    out[a, b] = matcher.ratio()
    return out


def edited(rng, name):
    s = list(name)
    for _ in range(rng.choice([1, 1, 2, 3])):
        at = rng.randrange(len(s))
        s[at : at + 1] = rng.choice([[], [s[at], rng.choice("abxyz")], [rng.choice("abxyz")], s[at : at + 1] * 2])
    return "".join(s)


@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_pairs_equal_all_pairs(spark, threshold):
    rng = random.Random(6)
    base = ["Großer Stechlinsee", "Kleiner Plöner See", "Arendsee", "Müggelsee Ost", "Schweriner Innensee", "abababababab", "See am Wald bei Berlin", "aaaaaa", "short", "four"]
    left = sorted({edited(rng, rng.choice(base)) for _ in range(110)} | set(base))
    right = sorted({edited(rng, rng.choice(base)) for _ in range(110)} | set(base))
    frame = lambda names: spark.createDataFrame([(n,) for n in names] + [(names[0],), (None,), ("",)], "name string")
    got = {(r.name, r.other): r.similarity for r in M.similar_names(frame(left), frame(right), threshold).collect()}
    want = all_pairs(left, right, threshold)
    assert got.keys() == want.keys() and len(want) > 200
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_parts_equal_all_pairs_with_few_candidates(spark):
    """All part names of sf0.01, with edited ones among them."""
    rng = random.Random(1)
    names = sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()})
    near = sorted(set(names[::4]) | {edited(rng, n) for n in names[::8]})
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {(r.name, r.other) for r in M.similar_names(frame(near), frame(near)).select("name", "other").collect()}
    assert got == set(all_pairs(near, near, 0.9)) and got
    candidates = M.name_candidates(frame(near), frame(near)).where(F.col("short") != F.col("long")).count()
    assert candidates < 25 * len(got), (candidates, len(got), len(near) ** 2)


def test_links_by_body_equal_links_over_all_pairs(spark):
    """With two ranks wanted, certain bodies are joined by id; with many, every source is compared. The first two ranks are the same."""
    rng = random.Random(3)
    bodies = [(f"B{k}", n) for k, n in enumerate(["Tiefer See", "Großer Müggelsee", "Flacher Teich", "Havel", "Schlachtensee"])]
    sources = [(f"S{k:02}", rng.choice(["Nordufer", "Pegel Brücke", "Mitte", "Westufer"]) + f" {k % 7}", rng.choice(bodies[:4])[0], rng.choice([None, 100.0 * k]), 50.0) for k in range(24)]
    stations = [(f"k{k:02}", rng.choice(["Pegel Brücke", "Mitte", "Nordufer West"]), "Spree", rng.choice(["Tiefer See", "Tiefersee", "Grosser Müggelsee", "Havl", "Nirgends", "Schlachtensee", None]), rng.choice([None, 70.0 * k]), 40.0) for k in range(16)]
    frames = [
        spark.createDataFrame(stations, "key string, name string, waterway string, water_body string, x double, y double"),
        spark.createDataFrame(sources, "station_id string, name string, water_body_id string, x double, y double"),
        spark.createDataFrame(bodies, "water_body_id string, name string"),
    ]
    some, every = M.link_stations(*frames, top_n=2), M.link_stations(*frames, top_n=100)
    ranked = lambda df: sorted((r.key, r.rank, r.station_id, round(r.score, 9)) for r in df.where("rank <= 2").collect())
    assert ranked(some[1]) == ranked(every[1]) and len(ranked(every[1])) == 32
    chosen = lambda df: sorted((r.key, r.station_id, r.status, round(r.margin, 9), round(r.body_score or 0, 9)) for r in df.collect())
    assert chosen(some[0]) == chosen(every[0])
