"""The guard on parsed plans, and passages against the plain rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.operators import crawl as C
from limnos.plans.questions import QuestionService, only_reads

READS = [
    "select 1",
    "select `set`, use, `insert` from (select 1 as `set`, 2 as use, 3 as `insert`)",  # columns that are named like commands
    "with a as (select 1 x), b as (select * from a) select * from b union all select 2",
    "/* drop table t */ select 'delete from t; drop' as s -- insert into t",
    "values (1, 'create'), (2, 'use')",
    "from range(3) select id where id in (select max(id) from range(2))",
    "table numbers",
    "select 1;",
    "SELECT transform(array(1), x -> x + 1)",
]
REFUSED = [
    "drop table t",
    "insert into t select 1",
    "with a as (select 1 x) insert into t select * from a",
    "from numbers insert into t select n insert into u select n",
    "create table t as select 1",
    "set spark.sql.shuffle.partitions = 1",
    "use default",
    "cache table numbers",
    "explain select 1",
    "merge into t using u on t.a = u.a when matched then delete",
    "select reflect('java.lang.System', 'getProperty', 'user.home')",
    "select * from numbers where n = (select java_method('java.lang.System', 'nanoTime'))",
    "select transform(n) using 'cat' as (m string) from numbers",
    "with a as (select transform(n) using 'cat' as (m string) from numbers) select * from a",
    "begin select 1; end",
]


@pytest.mark.parametrize("statement", READS + REFUSED)
def test_only_reading_plans_pass(spark, statement):
    spark.range(5).toDF("n").createOrReplaceTempView("numbers")
    assert only_reads(spark, statement) == (statement in READS)
    if statement in READS:
        assert QuestionService(spark, {}).read_only(statement).count() > 0
    else:
        with pytest.raises(ValueError, match="only one reading"):
            QuestionService(spark, {}).read_only(statement)


@pytest.mark.parametrize("statement", ["select 1; drop table t", "", "selec 1", "select 'open"])
def test_what_is_no_statement_is_an_error(spark, statement):
    with pytest.raises(ValueError, match="not a statement"):
        only_reads(spark, statement)


def brute_passages(fragments, names, topics, cap, norm, has):
    """By the rule: windows around names in order, best scores first, spaced."""
    found, seen = [], set()
    for number, (locator, text) in enumerate(fragments):
        spots = sorted(m.span() for n in names for m in re.finditer(r"(?<!\w)" + r"\s+".join(map(re.escape, n.split())) + r"(?!\w)", text, re.I))
        for a, b in spots:
            lo, hi = max(0, a - 240), min(len(text), b + 540)
            lo = text.rfind(" ", 0, lo) + 1 if lo else 0
            hi = (text.find(" ", hi) if text.find(" ", hi) >= 0 else len(text)) if hi < len(text) else hi
            quote = text[lo:hi]
            if has(quote, names) and (locator, norm(quote)) not in seen:
                seen.add((locator, norm(quote)))
                found.append((-3 - len(has(quote, topics)), number, lo, a, locator, quote))
        if number in (0, len(fragments) - 1) and text.strip():
            found.append((0, number, 0, 0, locator, text[:1000]))
    out, used = [], 0
    for _, _, lo, _, locator, quote in sorted(found):
        if used + len(quote) <= cap and len(out) < 30 and not any(o[0] == locator and abs(o[1] - lo) < 300 for o in out):
            out.append((locator, lo, quote))
            used += len(quote)
    return out


def test_passages_follow_the_rule(spark):
    rng = random.Random(8)
    words = ["Salzsee", "salzsee", "Großer  See", "Großer See", "C++", "Phosphor", "Blei", "Wasser", "überSalzsee", "und", "der", "\n", "a.b"]
    docs = {d: [(rng.choice(["p1", "p2"]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 80, 900])))) for _ in range(rng.choice([1, 2, 4]))] for d in range(12)}
    docs[99] = [("p", "ohne Namen"), ("p", " "), ("q", "")]
    names, topics = ["Salzsee", "Großer See", "C++"], ["Phosphor", "Blei"]

    def norm(s):
        return re.sub(r"\s+", " ", s.strip().lower().replace("ß", "ss")).strip(" .,;:")

    def has(s, terms):
        return [t for t in terms if re.search(r"(?<!\w)" + re.escape(norm(t)) + r"(?!\w)", norm(s))]

    rows = [(d, k, locator, text) for d, fs in docs.items() for k, (locator, text) in enumerate(fs)]
    df = spark.createDataFrame(rows + [(100, 0, "p", None)], "doc int, number int, locator string, text string")
    sample = {r.text: (r.a, r.b) for r in df.where("text is not null").select("text", T.matched_terms(F.col("text"), names).alias("a"), T.matched_terms(F.col("text"), topics).alias("b")).collect()}
    assert all(bool(has(t, topics)) == bool(b) for t, (_, b) in sample.items())
    for cap in (2500, 12_000):
        got = {}
        for r in C.passages(df, names, topics, cap).collect():
            got.setdefault(r.doc, []).append((int(r.evidence_id[1:]), r.locator, r.offset, r.text))
        library = lambda s, terms: sample[s][0] if s in sample and terms is names else has(s, terms)
        want = {d: brute_passages(fs, names, topics, cap, norm, library) for d, fs in docs.items()}
        assert {d: [x[1:] for x in sorted(v)] for d, v in got.items()} == {d: v for d, v in want.items() if v}
