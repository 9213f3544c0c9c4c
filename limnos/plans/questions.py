"""German questions to curated queries over the model's tables, with tables and sentences as answers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions.values import csv_guard
from limnos.operators.aggregates import label_counts

Tables = dict[str, DataFrame]


def _ranked(column: str, other: str) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        return t["water_body"].where(F.col(column).isNotNull()).select(F.col("water_body_id").alias("lake_id"), F.col("name").alias("lake"), column, other, "volume_m3").orderBy(F.desc(column), "lake_id")

    return run


def _statuses(t: Tables) -> DataFrame:
    """Direct statuses of lakes and those derived over overlapping groundwater bodies."""
    chem = t["chemical_status"].join(t["pollutant"].select("pollutant_id", "pollutant_code", F.col("name").alias("pollutant_name")), "pollutant_id", "left")
    direct = chem.where("surface_water_body_id is not null").select(F.col("surface_water_body_id").alias("lake_id"), F.lit("direkt").alias("derivation"), F.lit(None).cast("string").alias("groundwater_body"), "chemical_status_id", "failed_standard", "pollutant_code", "pollutant_name", "fail_reason_code", "exemption_type", "inserted_at")
    over = t["water_body_groundwater_body"].join(t["groundwater_body"].select("groundwater_body_id", F.col("name").alias("groundwater_body")), "groundwater_body_id")
    derived = chem.join(over, "groundwater_body_id").select(F.col("water_body_id").alias("lake_id"), F.lit("über Grundwasser-Überlappung").alias("derivation"), "groundwater_body", "chemical_status_id", "failed_standard", "pollutant_code", "pollutant_name", "fail_reason_code", "exemption_type", "inserted_at")
    return direct.unionByName(derived)


def _lakes(t: Tables) -> DataFrame:
    return t["water_body"].select(F.col("water_body_id").alias("lake_id"), F.col("name").alias("lake"), "area_km2")


def chemical_status(t: Tables) -> DataFrame:
    return _statuses(t).drop("chemical_status_id").join(_lakes(t).drop("area_km2"), "lake_id").orderBy(F.desc_nulls_first("failed_standard"), F.asc_nulls_last("lake"), F.asc_nulls_last("pollutant_code"))


def assessments(t: Tables) -> DataFrame:
    a = t["water_body_assessment"].join(t["parameter"].select("parameter_id", F.col("name").alias("assessment_parameter"), "quality_component"), "parameter_id", "left")
    rows = a.select(F.col("water_body_id").alias("lake_id"), "assessment_year", F.coalesce("value_normalized", "value_raw").alias("assessment_value"), "assessment_parameter", "quality_component", F.col("method").alias("assessment_method"))
    return rows.join(_lakes(t).drop("area_km2"), "lake_id").orderBy(F.asc_nulls_last("lake"), F.asc_nulls_last("assessment_year"), F.asc_nulls_last("assessment_parameter"))


def chemical_assessment_relation(t: Tables) -> DataFrame:
    """Grain: lake and assessment. Statuses are gathered per lake before assessments join, so neither multiplies the other."""
    status = F.struct("chemical_status_id", "failed_standard", "pollutant_code")
    by_lake = _statuses(t).groupBy("lake_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("derivation") == "direkt", status))).alias("direct"),
        F.array_sort(F.collect_set(F.when(F.col("derivation") != "direkt", status))).alias("derived"),
    )
    bodies = t["water_body_groundwater_body"].join(t["groundwater_body"], "groundwater_body_id").groupBy(F.col("water_body_id").alias("lake_id")).agg(F.array_sort(F.collect_set("name")).alias("overlapping_groundwater_bodies"))
    none = F.expr("cast(array() as array<struct<chemical_status_id:bigint,failed_standard:boolean,pollutant_code:string>>)")
    direct, derived = F.coalesce("direct", none), F.coalesce("derived", none)
    every = F.concat(direct, derived)
    failed = F.filter(every, lambda s: s["failed_standard"])
    codes = lambda a: F.filter(F.transform(a, lambda s: s["pollutant_code"]), lambda c: c.isNotNull())
    lakes = _lakes(t).join(by_lake, "lake_id", "left").join(bodies, "lake_id", "left").select(
        "lake_id", "lake", "area_km2", F.size(every).alias("chemical_status_count"), F.size(direct).alias("direct_chemical_status_count"), F.size(derived).alias("derived_chemical_status_count"),
        F.coalesce("overlapping_groundwater_bodies", F.expr("cast(array() as array<string>)")).alias("overlapping_groundwater_bodies"), codes(every).alias("pollutant_codes"), F.size(failed).alias("failed_standard_count"), codes(failed).alias("failed_pollutants"),
    )
    return lakes.join(assessments(t).drop("lake"), "lake_id", "left").orderBy(F.asc_nulls_last("lake"), F.asc_nulls_last("assessment_year"), F.asc_nulls_last("assessment_parameter"))


def measurement_summary(t: Tables) -> DataFrame:
    m = t["measurement"].join(t["unit"].select("unit_id", F.col("symbol").alias("unit")), "unit_id", "left").join(t["parameter"].select("parameter_id", F.col("name").alias("parameter"), "quality_component"), "parameter_id")
    grouped = m.groupBy(F.col("water_body_id").alias("lake_id"), "parameter_id", "parameter", "quality_component", "unit").agg(F.count("*").alias("measurement_count"), F.min("value").alias("minimum"), F.avg("value").alias("average"), F.max("value").alias("maximum"), F.min("measured_at").alias("first_measurement"), F.max("measured_at").alias("last_measurement"))
    return grouped.join(_lakes(t).drop("area_km2"), "lake_id").orderBy(F.desc("measurement_count"), F.asc_nulls_last("lake"), F.asc_nulls_last("parameter"), "lake_id", "parameter_id", "unit").limit(1000)


def protected_areas(t: Tables) -> DataFrame:
    rows = t["water_body_protected_area"].join(t["protected_area"].select("protected_area_id", F.col("name").alias("protected_area"), "area_type"), "protected_area_id")
    return rows.select(F.col("water_body_id").alias("lake_id"), "protected_area_id", "protected_area", "area_type", "relation_method", "overlap_area_km2", F.col("water_body_overlap_ratio").alias("overlap_ratio")).join(_lakes(t).drop("area_km2"), "lake_id").orderBy(F.asc_nulls_last("lake"), F.asc_nulls_last("protected_area"))


def graph_overview(t: Tables) -> DataFrame:
    return label_counts(t).orderBy(F.desc("entity_count"), "entity_type")


@dataclass(frozen=True)
class Curated:
    key: str
    title: str
    plan: Callable[[Tables], DataFrame]


CATALOGUE = {
    q.key: q
    for q in (
        Curated("largest_lake", "Größter See", _ranked("area_km2", "max_depth_m")),
        Curated("deepest_lake", "Tiefster See", _ranked("max_depth_m", "area_km2")),
        Curated("chemical_assessment_relation", "Chemischer Zustand und Bewertung", chemical_assessment_relation),
        Curated("chemical_status", "Chemische Überschreitungen", chemical_status),
        Curated("assessments", "Bewertungen der Seen", assessments),
        Curated("measurement_summary", "Messdatenübersicht", measurement_summary),
        Curated("protected_areas", "Seen und Schutzgebiete", protected_areas),
        Curated("graph_overview", "Inhalt des Knowledge Graphen", graph_overview),
    )
}
#: Which words of a folded question ask for which query; the first line with all of its patterns counts. Fixed values.
ROUTES = (
    ("largest_lake", (r"\b(grosst|groesst|groest|flachengrosst)", r"\bsee")),
    ("deepest_lake", (r"\b(tiefst|maximale tiefe)",)),
    ("chemical_assessment_relation", (r"chem", r"bewert|zusammenhang|beziehung|korrelation")),
    ("chemical_status", (r"chem|schadstoff|uberschreit|pollut",)),
    ("assessments", (r"bewert|zustandsklasse|potentialklasse",)),
    ("measurement_summary", (r"mess|parameter|datamart|analyse",)),
    ("protected_areas", (r"schutzgebiet|ffh|protected",)),
)


def fold(question: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", question.casefold()) if not unicodedata.combining(c))


def route(question: str) -> str:
    q = fold(question)
    return next((key for key, patterns in ROUTES if all(re.search(p, q) for p in patterns)), "graph_overview")


def route_column(question):
    """The same over a column, for many questions at once."""
    from limnos.functions.text import accent_fold

    q = accent_fold(question)
    out = F.lit("graph_overview")
    for key, patterns in reversed(ROUTES):
        hit = q.rlike(patterns[0])
        for p in patterns[1:]:
            hit = hit & q.rlike(p)
        out = F.when(hit, key).otherwise(out)
    return out


def _comma(x: float) -> str:
    return f"{x:.2f}".replace(".", ",")


def group_means(relation: DataFrame) -> DataFrame:
    """Mean of per-lake mean classes for lakes with and without a failed standard; classes 1 to 5 of lakes with a status count."""
    valid = relation.where("chemical_status_count > 0 and assessment_value between 1 and 5")
    per_lake = valid.groupBy("lake_id").agg(F.avg("assessment_value").alias("m"), F.max(F.col("failed_standard_count") > 0).alias("failed"))
    return per_lake.groupBy("failed").agg(F.count("*").alias("lakes"), F.avg("m").alias("mean"))


def interpret(key: str, rows: DataFrame) -> str:
    """One German sentence on a result; each is one small aggregation."""
    if key == "chemical_assessment_relation":
        by = {r.failed: r for r in group_means(rows).collect()}
        if True in by and False in by:
            a, b = by[True], by[False]
            way = "schlechter" if a["mean"] > b["mean"] else "besser"
            return f"Seen mit chemischer Überschreitung haben im Mittel die Bewertung {_comma(a['mean'])}, Seen ohne erfasste Überschreitung {_comma(b['mean'])} (1 = gut, 5 = schlecht), also {way}; beschreibend über {a.lakes + b.lakes} Seen, kein Kausalnachweis."
        n = rows.agg(F.countDistinct(F.when(F.col("assessment_value").between(1, 5), F.col("lake_id"))).alias("a"), F.countDistinct(F.when(F.col("chemical_status_count") > 0, F.col("lake_id"))).alias("c"), F.countDistinct(F.when(F.col("failed_standard_count") > 0, F.col("lake_id"))).alias("f")).first()
        return f"Für {n.a} Seen sind gültige Bewertungswerte vorhanden; {n.c} sind mit chemischen Statusdaten verknüpft, bei {n.f} ist eine Überschreitung hinterlegt. Für einen Gruppenvergleich fehlen Daten in einer der Gruppen."
    if key in ("largest_lake", "deepest_lake"):
        top = rows.first()
        if top is None:
            return "Für diese Frage wurden keine Daten gefunden."
        return f"Der größte See ist {top.lake} mit {_comma(top.area_km2)} km²." if key == "largest_lake" else f"Der tiefste See ist {top.lake} mit maximal {_comma(top.max_depth_m)} m."
    if key == "graph_overview":
        return "Der Knowledge Graph enthält die unten aufgeführten Entitätstypen."
    aggs = [F.count("*").alias("n"), F.countDistinct("lake_id").alias("lakes")]
    aggs += [F.count_if("failed_standard").alias("failed")] if key == "chemical_status" else [F.sum("measurement_count").alias("m")] if key == "measurement_summary" else []
    r = rows.agg(*aggs).first()
    if not r.n:
        return "Für diese Frage wurden keine Daten gefunden."
    return {
        "chemical_status": lambda: f"Es liegen {r.n} chemische Statusangaben für {r.lakes} Seen vor; {r.failed} davon markieren eine Überschreitung.",
        "assessments": lambda: f"Der Graph enthält {r.n} Wasserkörperbewertungen für {r.lakes} Seen.",
        "measurement_summary": lambda: f"Der Datamart fasst {r.m:,} Messwerte in {r.n} See-Parameter-Kombinationen zusammen.".replace(",", "."),
        "protected_areas": lambda: f"Es wurden {r.n} Beziehungen zwischen {r.lakes} Seen und Schutzgebieten gefunden.",
    }[key]()


#: Functions that run code of the machine, and plan nodes that do.
_RUNS_CODE = {"reflect", "java_method", "try_reflect"}
_RUNS_SCRIPTS = "ScriptTransformation"


def _each(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def only_reads(spark: SparkSession, statement: str) -> bool:
    """Whether Spark's parser takes the text for one statement that only reads: no command, insert or script anywhere in its plan.

    What stands in quotes, comments or names is no matter, since the plan is judged and not the text. Raises ValueError if it cannot be parsed.
    """
    jvm = spark.sparkContext._jvm
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise ValueError(f"not a statement: {str(e)[:200]}") from e
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    kind = lambda name: jvm.java.lang.Class.forName(name)
    writes = [kind(logical + n) for n in ("Command", "ParsedStatement", "CompoundPlanStatement")]
    a_plan, a_function = kind(logical + "LogicalPlan"), kind("org.apache.spark.sql.catalyst.analysis.UnresolvedFunction")
    subquery = kind("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    stack = [plan]
    while stack:
        node = stack.pop()
        if any(w.isInstance(node) for w in writes) or _RUNS_SCRIPTS in node.getClass().getSimpleName():
            return False
        if a_function.isInstance(node) and _each(node.nameParts())[-1].lower() in _RUNS_CODE:
            return False
        if subquery.isInstance(node):
            stack.append(node.plan())
        stack += _each(node.children())
        if a_plan.isInstance(node):
            stack += _each(node.expressions()) + [x for x in _each(node.innerChildren()) if a_plan.isInstance(x)]
    return True


class QuestionService:
    """Answers questions and read-only SQL over registered tables."""

    def __init__(self, spark: SparkSession, tables: Tables) -> None:
        self.spark, self.tables = spark, tables
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def ask(self, question: str) -> tuple[str, DataFrame]:
        if not question.strip() or len(question) > 2000:
            raise ValueError("a question of 1 to 2000 characters is needed")
        key = route(question)
        return key, CATALOGUE[key].plan(self.tables)

    def answer(self, question: str) -> dict:
        key, rows = self.ask(question)
        return {"intent": key, "title": CATALOGUE[key].title, "columns": rows.columns, "interpretation": interpret(key, rows), "rows": rows}

    def read_only(self, statement: str) -> DataFrame:
        if not only_reads(self.spark, statement):
            raise ValueError("only one reading statement is allowed")
        return self.spark.sql(statement.strip().rstrip(";"))

    @staticmethod
    def as_csv(rows: DataFrame, path: str) -> None:
        """A CSV data mart: `;` between cells, nested values as JSON, formulas guarded."""
        from limnos.sources.sinks import write_datamart

        write_datamart(rows, path)


__all__ = ["CATALOGUE", "QuestionService", "csv_guard", "group_means", "interpret", "route", "route_column"]
