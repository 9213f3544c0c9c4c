"""Checks around recorded judgements and extracted facts, status profiles, and the exports built from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.functions import text as T
from limnos.functions import values as V
from limnos.operators.graph import ancestors
from limnos.operators.matching import name_to_code, nearest

#: Ontology roots that a record type may stand under, fixed values.
ROOTS = {
    "Ereignis": ("core:Event",),
    "Maßnahme": ("core:Intervention",),
    "Zustand": ("core:State", "core:Assessment"),
    "Messung": ("core:Observation",),
    "Prozess": ("core:Process",),
    "Eigenschaft": ("core:Entity", "core:State"),
}
#: Ecological classes in words, fixed values.
ECOLOGY = {1: "sehr gut", 2: "gut", 3: "mäßig", 4: "unbefriedigend", 5: "schlecht"}
#: Permitted values of recorded judgements, fixed values.
DECISIONS = ("relevant", "supporting", "uncertain", "irrelevant")
PREFLIGHT = {"action": ("download", "defer"), "identity": ("match", "uncertain", "mismatch"), "category": ("science", "authority", "data", "background", "navigation", "unrelated", "unknown")}
START_LINKS = {"action": ("accept", "reject", "uncertain"), "identity": ("match", "uncertain", "mismatch"), "category": ("science", "authority", "data", "background", "tourism", "navigation", "unrelated", "unknown")}


def _reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))


def judgement_problems(df: DataFrame, choices: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of recorded judgements with ``problems``: values outside the choices, scores out of range, no reason."""
    rules = {f"invalid_{c}": ~F.coalesce(F.col(c).isin(*allowed), F.lit(False)) for c, allowed in choices.items()}
    rules |= {f"invalid_{c}": ~F.coalesce(F.col(c).between(0, most), F.lit(False)) for c, most in (("importance", 100), ("confidence", 1))}
    rules["invalid_reason"] = F.coalesce(F.trim("reason"), F.lit("")) == ""
    return df.withColumn("problems", _reasons(rules))


def batch_problems(answers: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, problem) where a batch's answers are not exactly its tasks, once each."""
    n = answers.groupBy("id").agg(F.count("*").alias("n"))
    j = tasks.select("id", F.lit(True).alias("asked")).join(n, "id", "full_outer")
    problem = F.when(F.col("asked").isNull(), "not asked").when(F.col("n").isNull(), "unanswered").when(F.col("n") > 1, "repeated")
    return j.select("id", problem.alias("problem")).where("problem is not null")


def review_problems(reviews: DataFrame, fragments: DataFrame) -> DataFrame:
    """Problems of recorded reviews against the fragments they were given.

    ``reviews(id, decision, evidence_quotes, topic_hits, topics, follow_link_ids, link_ids)``, ``fragments(id, text)``. A quote
    of at least 12 characters must stand in a fragment; positive decisions need one; topics and links must be among those given.
    """
    quotes = reviews.select("id", F.explode("evidence_quotes").alias("quote"))
    good = quotes.join(fragments, "id").where((F.length(T.collapse_norm(F.col("quote"))) >= 12) & F.contains(T.collapse_norm(F.col("text")), T.collapse_norm(F.col("quote")))).select("id", "quote").distinct()
    lost = quotes.join(good, ["id", "quote"], "left_anti").select("id").distinct().withColumn("lost", F.lit(True))
    rules = {
        "invalid_decision": ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)),
        "quote_not_in_source": F.col("lost"),
        "positive_without_quote": F.col("decision").isin("relevant", "supporting") & (F.size("evidence_quotes") == 0),
        "unknown_topic": F.size(F.array_except("topic_hits", "topics")) > 0,
        "unknown_link": F.size(F.array_except("follow_link_ids", "link_ids")) > 0,
    }
    return reviews.join(lost, "id", "left").select("id", _reasons(rules).alias("problems"))


def ontology_problems(events: DataFrame, classes: DataFrame) -> DataFrame:
    """(event_id, fatal, warnings) of ``events(event_id, record_type, ontology_concept)`` against ``classes(class, parent)``."""
    up = ancestors(classes).select("class", F.col("ancestor").alias("a")).union(classes.select("class", F.col("class").alias("a")))
    lines = up.groupBy("class").agg(F.collect_set("a").alias("line"))
    roots = F.create_map(*(x for k, v in ROOTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    j = events.join(lines, events.ontology_concept == lines["class"], "left")
    none = F.coalesce(F.trim("ontology_concept"), F.lit("")) == ""
    fatal = _reasons({"unknown_ontology_class": ~none & F.col("line").isNull()})
    warn = _reasons({"needs_ontology_extension": none, "record_type_ontology_mismatch": F.col("line").isNotNull() & ~F.arrays_overlap("line", F.coalesce(roots[F.col("record_type")], F.expr("cast(array() as array<string>)")))})
    return j.select("event_id", fatal.alias("fatal"), warn.alias("warnings"))


def field_evidence_gaps(facts: DataFrame, fields: list[str]) -> DataFrame:
    """(event_id, missing): filled fields that no piece of ``evidence array<struct<field_names array>>`` vouches for."""
    named = F.flatten(F.transform("evidence", lambda e: e["field_names"]))
    filled = F.array_compact(F.array(*(F.when(V.present(F.col(f)) & ~F.col(f).cast("string").isin("not_stated", "not_applicable", "unresolved", "unknown"), F.lit(f)) for f in fields)))
    return facts.select("event_id", F.array_except(filled, F.coalesce(named, F.expr("cast(array() as array<string>)"))).alias("missing")).where("size(missing) > 0")


def time_problems(start: Column, end: Column) -> Column:
    """Names of what is wrong with a normalised time."""
    bad = lambda c: c.isNotNull() & (c != "") & ~V.partial_date_valid(c)
    return _reasons({"invalid_start": bad(start), "invalid_end": bad(end), "reversed": (F.length(start) == F.length(end)) & V.interval_reversed(start, end)})


def status_profiles(codes: DataFrame, state: DataFrame, quality: DataFrame, chemistry: DataFrame, stations: DataFrame) -> DataFrame:
    """Per short code and cycle: ecological and chemical state and counts of quality elements, substances and stations.

    Inputs carry ``code`` and ``cycle``; an empty member counts as one. Only codes of the register are kept.
    """
    known = codes.select(T.short_code(F.col("code")).alias("short")).where("short is not null").distinct()
    own = lambda df: df.withColumn("short", T.short_code(F.col("code"))).join(known, "short", "left_semi")
    s = own(state).groupBy("short", "cycle").agg(F.max_by(F.coalesce(F.nullif("eco_stat", F.lit("")), "eco_pot"), "pos").alias("eco"), F.max_by("chem_stat", "pos").alias("chem"))
    out = s
    for df, member, name in ((quality, "qe_cd", "n_quality"), (chemistry, "substance", "n_substances"), (stations, "name_stn", "n_stations")):
        out = out.join(own(df).groupBy("short", "cycle").agg(F.countDistinct(F.coalesce(member, F.lit(""))).alias(name)), ["short", "cycle"], "full_outer")
    return out


def ecology_text(number: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ECOLOGY.items() for x in kv))[V.integer(number).cast("int")], F.lit(""))


def waterbody_export(events: DataFrame, drain: DataFrame, labels: DataFrame, codes: DataFrame, prefer: str = "", max_distance: float = 0.05) -> dict[str, DataFrame]:
    """Tables of documented findings for a virtual graph.

    ``events(event_id, name, record_type, statement, ontology_concept, time_original, source, quotes)``; a name's code comes
    from the register ``drain(pos, name, code)``, else from the nearest map label: ``codes(id, x, y)``, ``labels(target, x, y)``.
    """
    official = name_to_code(drain, prefer).select("key", "code", F.lit("drainbasin").alias("code_source"))
    mapped = nearest(codes, labels, max_distance).where("status = 'auto'").groupBy(T.collapse_norm(F.col("target")).alias("key")).agg(F.min("id").alias("code")).withColumn("code_source", F.lit("karte"))
    resolved = official.unionByName(mapped.join(official, "key", "left_anti"))
    keyed = events.withColumn("key", T.collapse_norm(F.col("name")))
    coded = keyed.join(resolved, "key", "left").withColumn("eu_cd_lw", F.coalesce("code", F.lit("")))
    bodies = coded.where("key <> ''").groupBy("key", "eu_cd_lw", F.coalesce("code_source", F.lit("")).alias("code_source")).agg(F.min_by("name", "event_id").alias("wb_name"), F.count("*").alias("n_events"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    line = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    return {
        "wb_name_to_code": bodies.select("wb_name", "eu_cd_lw", "code_source", "n_events").orderBy(F.col("eu_cd_lw") == "", F.desc("n_events"), "wb_name"),
        "pdf_waterbody": bodies.join(labels.select(T.collapse_norm(F.col("target")).alias("key"), "x", "y").dropDuplicates(["key"]), "key", "left").select("wb_name", "eu_cd_lw", "code_source", "n_events", "sources", F.col("x").alias("map_x"), F.col("y").alias("map_y")),
        "pdf_event": coded.select("event_id", "eu_cd_lw", "record_type", line(F.col("statement")).alias("statement"), "ontology_concept", "time_original", F.col("source").alias("source_document"), line(V.first_present(F.col("quotes"))).alias("quote")),
    }


def relationship_export(relationships: DataFrame) -> DataFrame:
    """``relationships(pos, source, source_event_id, target_event_id, relationship_type, statement, mechanism)`` with ids by source and position."""
    line = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(" ")).alias(c)
    return relationships.select(F.concat(F.upper(F.left("source", F.lit(2))), F.lit("-rel-"), F.col("pos").cast("string")).alias("relationship_id"), "source_event_id", "target_event_id", "relationship_type", line("statement"), line("mechanism"), F.col("source").alias("source_document"))


def site_overview(first: DataFrame, second: DataFrame, documents: DataFrame) -> DataFrame:
    """Per site: candidates of two search passes and what the second adds, and archived originals by decision, each content once."""
    sets = first.groupBy("site").agg(F.collect_set("url").alias("a")).join(second.groupBy("site").agg(F.collect_set("url").alias("b")), "site", "full_outer")
    none = F.expr("cast(array() as array<string>)")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    found = sets.select("site", F.size(a).alias("first"), F.size(b).alias("second"), F.size(F.array_except(b, a)).alias("added"), F.size(F.array_union(a, b)).alias("together"))
    hashes = lambda *kinds: F.countDistinct(F.when(F.col("decision").isin(*kinds), F.col("sha256")))
    kept = documents.groupBy("site").agg(F.countDistinct("sha256").alias("archived"), hashes("relevant", "supporting").alias("useful"), hashes("uncertain").alias("uncertain"), hashes("irrelevant").alias("rejected"))
    return found.join(kept, "site", "full_outer").na.fill(0)


def lake_summary(lakes: DataFrame, associations: DataFrame) -> DataFrame:
    """Distinct documents per lake and status, lakes without any included."""
    docs = lambda s: F.countDistinct(F.when(F.col("status") == s, F.col("document")))
    counted = associations.groupBy("lake").agg(docs("matched").alias("matched"), docs("review").alias("review"), docs("excluded").alias("excluded"))
    return lakes.select("lake").join(counted, "lake", "left").na.fill(0)


def coverage(features: DataFrame, ids: DataFrame, layers: list[str]) -> DataFrame:
    """Features per id and layer, zeros included; layers are given."""
    counted = features.groupBy("id").agg(*(F.count_if(F.col("layer") == x).alias(x) for x in layers))
    return ids.select("id").distinct().join(counted, "id", "left").na.fill(0)


def excerpts(fragments: DataFrame, terms: list[str], budget: int, best: int = 8) -> DataFrame:
    """Fragments worth reading per document: the first, the last and those with most terms, each cut to its share of the budget.

    A long fragment keeps its beginning, its end and the surroundings of its first hits. ``fragments(doc, pos, text)``.
    """
    hits = F.size(T.matched_terms(F.col("text"), terms))
    w = Window.partitionBy("doc")
    ranked = fragments.withColumn("_h", hits).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_h"), "pos"))).withColumn("_last", F.max("pos").over(w)).withColumn("_first", F.min("pos").over(w))
    chosen = ranked.where((F.col("_r") <= best) | (F.col("pos") == F.col("_first")) | (F.col("pos") == F.col("_last"))).withColumn("_n", F.greatest(F.lit(300), F.floor(F.lit(budget) / F.count("*").over(w))).cast("int"))
    n, text = F.col("_n"), F.col("text")
    spot = F.regexp_extract(text, "(?is)(.{0,80}(?:" + "|".join(map(re.escape, terms)) + ").{0,160})", 1)
    cut = F.concat_ws("\n[…]\n", F.left(text, (n / 3).cast("int")), F.nullif(spot, F.lit("")), F.right(text, (n / 6).cast("int")))
    return chosen.select("doc", "pos", F.when(F.length(text) <= n, text).otherwise(F.left(cut, n)).alias("text"))
