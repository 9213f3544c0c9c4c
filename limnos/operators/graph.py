"""Property graph and triples as plain tables: declarative node and edge specs compiled to projections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.session import store
from limnos.sources.sinks import publish


@dataclass(frozen=True)
class Node:
    """Nodes of a label: a table, the key columns, and whether the key is their length-prefixed composition."""

    table: str
    label: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class Edge:
    """Edges of a type: a table, the two key columns (labels), and property columns."""

    name: str
    type: str
    start: tuple[str, str]
    end: tuple[str, str]
    table: str
    properties: tuple[str, ...] = ()
    unique_by: tuple[str, ...] = ()


#: Tables, labels and keys of the graph, fixed values.
NODES = (
    Node("planning_unit", "PlanningUnit", ("planning_unit_code",)),
    Node("water_body", "WaterBody", ("water_body_id",)),
    Node("water_body_identifier", "WaterBodyIdentifier", ("identifier_type", "identifier")),
    Node("groundwater_body", "GroundwaterBody", ("groundwater_body_id",)),
    Node("catchment", "Catchment", ("catchment_id",)),
    Node("monitoring_station", "MonitoringStation", ("station_id",)),
    Node("station_alias", "StationAlias", ("alias_id",)),
    Node("core_location", "CoreLocation", ("core_code",)),
    Node("parameter", "Parameter", ("parameter_id",)),
    Node("unit", "Unit", ("unit_id",)),
    Node("pollutant", "Pollutant", ("pollutant_id",)),
    Node("paleo_element", "PaleoElement", ("element_id",)),
    Node("protected_area", "ProtectedArea", ("protected_area_id",)),
    Node("sampling_section", "SamplingSection", ("sampling_section_id",)),
    Node("measurement", "Measurement", ("measurement_id",)),
    Node("water_body_assessment", "WaterBodyAssessment", ("assessment_id",)),
    Node("station_assessment", "StationAssessment", ("assessment_id",)),
    Node("chemical_status", "ChemicalStatus", ("chemical_status_id",)),
    Node("paleo_measurement", "PaleoMeasurement", ("paleo_measurement_id",)),
    Node("protected_area_assessment", "ProtectedAreaAssessment", ("assessment_id",)),
    Node("import_issue", "ImportIssue", ("issue_id",)),
)
_W, _G, _S, _C = ("WaterBody", "water_body_id"), ("GroundwaterBody", "groundwater_body_id"), ("MonitoringStation", "station_id"), ("Catchment", "catchment_id")
_M, _P, _U, _Y = ("Measurement", "measurement_id"), ("Parameter", "parameter_id"), ("Unit", "unit_id"), ("SamplingSection", "sampling_section_id")
_PLAN, _CHEM, _CORE = ("PlanningUnit", "planning_unit_code"), ("ChemicalStatus", "chemical_status_id"), ("CoreLocation", "core_code")
_WA, _SA, _PA = ("WaterBodyAssessment", "assessment_id"), ("StationAssessment", "assessment_id"), ("ProtectedAreaAssessment", "assessment_id")
_AREA, _PM = ("ProtectedArea", "protected_area_id"), ("PaleoMeasurement", "paleo_measurement_id")
#: Edge mappings, fixed values. An edge exists where both keys are known.
EDGES = (
    Edge("water_planning", "IN_PLANNING_UNIT", _W, _PLAN, "water_body"),
    Edge("groundwater_planning", "IN_PLANNING_UNIT", _G, _PLAN, "groundwater_body"),
    Edge("catchment_planning", "IN_PLANNING_UNIT", _C, _PLAN, "catchment"),
    Edge("water_identifier", "HAS_IDENTIFIER", _W, ("WaterBodyIdentifier", "identifier_type,identifier"), "water_body_identifier", ("identifier_type", "identifier")),
    Edge("station_water", "MONITORS", _S, _W, "monitoring_station"),
    Edge("station_alias", "HAS_ALIAS", _S, ("StationAlias", "alias_id"), "station_alias"),
    Edge("core_water", "IN_WATERBODY", _CORE, _W, "core_location"),
    Edge("water_section", "HAS_SAMPLING_SECTION", _W, _Y, "sampling_section"),
    Edge("station_section", "HAS_SAMPLING_SECTION", _S, _Y, "sampling_section"),
    Edge("station_measurement", "RECORDED", _S, _M, "measurement"),
    Edge("measurement_water", "FOR_WATERBODY", _M, _W, "measurement"),
    Edge("measurement_section", "SAMPLED_IN", _M, _Y, "measurement"),
    Edge("measurement_parameter", "MEASURES_PARAMETER", _M, _P, "measurement"),
    Edge("measurement_unit", "HAS_UNIT", _M, _U, "measurement"),
    Edge("water_assessment", "HAS_ASSESSMENT", _W, _WA, "water_body_assessment"),
    Edge("water_assessment_parameter", "FOR_PARAMETER", _WA, _P, "water_body_assessment"),
    Edge("station_assessment", "HAS_ASSESSMENT", _S, _SA, "station_assessment"),
    Edge("station_assessment_water", "FOR_WATERBODY", _SA, _W, "station_assessment"),
    Edge("station_assessment_parameter", "FOR_PARAMETER", _SA, _P, "station_assessment"),
    Edge("station_assessment_unit", "HAS_UNIT", _SA, _U, "station_assessment"),
    Edge("surface_chemical", "HAS_CHEMICAL_STATUS", ("WaterBody", "surface_water_body_id"), _CHEM, "chemical_status"),
    Edge("ground_chemical", "HAS_CHEMICAL_STATUS", _G, _CHEM, "chemical_status"),
    Edge("chemical_pollutant", "FOR_POLLUTANT", _CHEM, ("Pollutant", "pollutant_id"), "chemical_status"),
    Edge("core_paleo", "HAS_PALEO_MEASUREMENT", _CORE, _PM, "paleo_measurement"),
    Edge("paleo_element", "OF_ELEMENT", _PM, ("PaleoElement", "element_id"), "paleo_measurement"),
    Edge("protected_assessment", "HAS_ASSESSMENT", _AREA, _PA, "protected_area_assessment"),
    Edge("protected_assessment_surface", "FOR_WATERBODY", _PA, ("WaterBody", "surface_water_body_id"), "protected_area_assessment"),
    Edge("protected_assessment_ground", "FOR_GROUNDWATER_BODY", _PA, _G, "protected_area_assessment"),
    Edge("water_ground_overlap", "OVERLAPS", _W, _G, "water_body_groundwater_body", ("overlap_area_km2", "water_body_overlap_ratio", "determination_method")),
    Edge("catchment_ground_overlap", "OVERLAPS", _C, _G, "catchment_groundwater_body", ("overlap_area_km2", "catchment_overlap_ratio", "determination_method")),
    Edge("catchment_water_overlap", "OVERLAPS", _C, _W, "catchment_water_body", ("overlap_area_km2", "catchment_overlap_ratio", "water_body_overlap_ratio", "determination_method")),
    Edge("station_ground", "LOCATED_IN", _S, _G, "station_groundwater_body", ("determination_method",)),
    Edge("station_catchment", "LOCATED_IN", _S, _C, "station_catchment", ("determination_method",)),
    Edge("water_protected", "OVERLAPS_PROTECTED_AREA", _W, _AREA, "water_body_protected_area", ("relation_method", "overlap_area_km2", "water_body_overlap_ratio"), ("relation_method",)),
)


def key_of(columns: tuple[str, ...]) -> Column:
    cols = [F.col(c).cast("string") for c in columns]
    return cols[0] if len(cols) == 1 else T.composite_key(*cols)


def _map(columns: list[str]) -> Column:
    if not columns:
        return F.expr("cast(map() as map<string,string>)")
    full = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))
    return F.map_filter(full, lambda _, v: v.isNotNull())


def nodes(tables: dict[str, DataFrame], specs: tuple[Node, ...] = NODES) -> DataFrame:
    """(label, key, properties) of all specs whose table is given; null properties are left out."""
    frames = [tables[s.table].select(F.lit(s.label).alias("label"), key_of(s.key).alias("key"), _map([c for c, kind in tables[s.table].dtypes if c not in s.key and not kind.startswith(("binary", "array", "struct", "map"))]).alias("properties")).where("key is not null") for s in specs if s.table in tables]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def edges(tables: dict[str, DataFrame], specs: tuple[Edge, ...] = EDGES) -> DataFrame:
    """(name, type, start_label, start_key, end_label, end_key, properties), unique by ends and the spec's own key."""
    frames = []
    for s in specs:
        if s.table not in tables:
            continue
        start, end = key_of(tuple(s.start[1].split(","))), key_of(tuple(s.end[1].split(",")))
        rows = tables[s.table].select(F.lit(s.name).alias("name"), F.lit(s.type).alias("type"), F.lit(s.start[0]).alias("start_label"), start.alias("start_key"), F.lit(s.end[0]).alias("end_label"), end.alias("end_key"), *[F.col(c).alias(f"_{c}") for c in s.unique_by], _map(list(s.properties)).alias("properties"))
        rows = rows.where("start_key is not null and end_key is not null").dropDuplicates(["start_key", "end_key", *(f"_{c}" for c in s.unique_by)])
        frames.append(rows.drop(*(f"_{c}" for c in s.unique_by)))
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def dangling(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges of which an end is missing; must be empty before a graph is published."""
    known = node_table.select("label", "key")
    start = edge_table.join(known, (edge_table.start_label == known.label) & (edge_table.start_key == known.key), "left_anti").withColumn("missing", F.lit("start"))
    end = edge_table.join(known, (edge_table.end_label == known.label) & (edge_table.end_key == known.key), "left_anti").withColumn("missing", F.lit("end"))
    return start.union(end)


def repeated_keys(node_table: DataFrame) -> DataFrame:
    """(label, key, n) of keys that are not unique within their label; must be empty before a graph is published."""
    return node_table.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def drop_labels(node_table: DataFrame, edge_table: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of some labels and every edge at them."""
    return node_table.where(~F.col("label").isin(labels)), edge_table.where(~F.col("start_label").isin(labels) & ~F.col("end_label").isin(labels))


def promote(spark: SparkSession, node_table: DataFrame, edge_table: DataFrame, path: str, rebuild: bool = False) -> None:
    """Publish the graph under ``path``: keys must be unique and edges whole; a graph that is there is replaced only on ``rebuild``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not rebuild and folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        raise ValueError(f"{path} holds a graph already; ask for a rebuild to replace it")
    publish(spark, {"nodes": node_table, "edges": edge_table}, path, [lambda t: repeated_keys(t["nodes"]), lambda t: dangling(t["edges"], t["nodes"])])


def hop(rows: DataFrame, edge_table: DataFrame, edge_type: str, source: str, target: str, outer: bool = False, backward: bool = False) -> DataFrame:
    """One step of a path: from the column ``source`` along a type to the new column ``target``."""
    a, b = ("end_key", "start_key") if backward else ("start_key", "end_key")
    step = edge_table.where(F.col("type") == edge_type).select(F.col(a).alias("_from"), F.col(b).alias(target))
    return rows.join(step, rows[source] == step["_from"], "left" if outer else "inner").drop("_from")


#: Records whose triples are made in one task.
RECORDS = 50_000


def triples(events: DataFrame, relationships: DataFrame) -> DataFrame:
    """(s, p, o) of documented findings and causal links; statements without a value are absent.

    Records are dealt by subject, RECORDS a task, before they become triples: equal triples have one subject, so each
    task finds its own, and no task holds the triples of a whole file.

    ``events(event_id, eu_cd_lw, record_type, statement, time_original, quote, source_document)``,
    ``relationships(relationship_id, source_event_id, target_event_id, relationship_type, mechanism, source_document)``.
    """
    finding, link = F.concat(F.lit("finding/"), "event_id"), F.concat(F.lit("causal-link/"), "relationship_id")
    resource = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c))

    def rows(df: DataFrame, subject: Column, parts: list[tuple[str, Column]]) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")) for p, o in parts))
        dealt = df.withColumn("s", subject).repartition(max(1, -(-df.count() // RECORDS)), "s")
        return dealt.select("s", F.explode(pairs).alias("x")).select("s", "x.p", "x.o").where("s is not null and coalesce(o, '') <> ''").distinct()

    own = rows(events, finding, [
        ("a", F.lit("DocumentedFinding")), ("label", F.col("statement")), ("statementText", F.col("statement")), ("recordType", F.col("record_type")), ("wasDerivedFrom", resource("document", "source_document")),
        ("concernsWaterBody", F.when(F.col("eu_cd_lw") != "", resource("water-body", "eu_cd_lw"))), ("timeOriginal", F.col("time_original")), ("evidenceQuote", F.col("quote")), ("a", F.when(F.col("record_type") == "Messung", "MeasurementFinding")),
    ])
    causal = rows(relationships, link, [
        ("a", F.lit("CausalLink")), ("cause", resource("finding", "source_event_id")), ("effect", resource("finding", "target_event_id")), ("relationshipType", F.col("relationship_type")), ("mechanism", F.col("mechanism")), ("wasDerivedFrom", resource("document", "source_document")),
    ])
    return own.union(causal)


def ancestors(classes: DataFrame) -> DataFrame:
    """(class, ancestor, depth) closure of ``classes(class, parent)``, however deep; the least depth of each pair.

    Pairs of distance exactly 2^k are joined with those of up to 2^k, so a chain of n classes takes log2(n) rounds and no
    distance beyond 2^k is met by more than one of its splits. A class on a cycle is an ancestor of itself; rounds end
    where no pair is as far apart as the round reaches.
    """
    known = store(classes.where("parent is not null and class is not null").select("class", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    reach = 1
    while not (far := known.where(F.col("depth") == reach)).isEmpty():
        upper = known.select(F.col("class").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        further = far.join(upper, "ancestor").groupBy("class", F.col("_a").alias("ancestor")).agg((F.min("_d") + reach).alias("depth"))
        known = known.union(store(further.join(known.select("class", "ancestor"), ["class", "ancestor"], "left_anti")))
        reach *= 2
    return known


def viewer_json(node_table: DataFrame, edge_table: DataFrame, size: int = 100_000) -> DataFrame:
    """(part, json): nodes and edges for the viewer as JSON arrays, a part per label, numbered parts of about ``size`` entries where a label has more."""

    def parts(df: DataFrame, kind: str, label: str, entry: list[str]) -> DataFrame:
        pieces = df.groupBy(label).agg(F.ceil(F.count("*") / size).alias("_n"))
        keyed = df.join(F.broadcast(pieces), label).withColumn("_k", F.pmod(F.xxhash64(*entry), F.col("_n")))
        part = F.concat(F.lit(f"{kind}/"), label, F.when(F.col("_n") > 1, F.concat(F.lit("/"), F.col("_k").cast("string"))).otherwise(""))
        return keyed.groupBy(part.alias("part")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*entry)))).alias("json"))

    return parts(node_table, "nodes", "label", ["key", "label"]).union(parts(edge_table, "edges", "name", ["start_key", "end_key", "type"]))


#: Bytes of entries that travel in one row.
PIECE = 16_384


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, part, number, piece) of entries sorted by part: consecutive ones joined by commas, about PIECE bytes each."""
    last, held, size, number = None, [], 0, 0

    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(("task", "part", "number", "piece"), map(list, zip(*done)))), pa.schema([("task", pa.int32()), ("part", pa.string()), ("number", pa.int64()), ("piece", pa.string())]))

    for batch in batches:
        done = []
        for task, part, entry in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (part != last[1] or size > PIECE):
                done.append((*last, number, ",".join(held)))
                held, size, number = [], 0, number + 1
            last = (task, part)
            held.append(entry)
            size += len(entry)
        if done:
            yield rows(done)
    if held:
        yield rows([(*last, number, ",".join(held))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, sha) of pieces sorted by part and place."""
    last, running, done = None, None, []
    for batch in batches:
        for part, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if running is not None and part == last:
                running.update(b"," + piece.encode())
                continue
            if running is not None:
                done.append((last, running))
            last, running = part, hashlib.sha256(b"[" + piece.encode())
    if running is not None:
        done.append((last, running))
    for _, running in done:
        running.update(b"]")
    yield pa.RecordBatch.from_pydict({"part": [p for p, _ in done], "sha": [r.hexdigest() for _, r in done]}, pa.schema([("part", pa.string()), ("sha", pa.string())]))


def viewer_digests(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(part, sha): the SHA-256 of each label's whole JSON array for the viewer, entries in order.

    Entries are sorted by ranges over all tasks and joined to small pieces there; a part's digest reads its pieces
    in order as a stream in one task, since it can be computed in no other way, and holds none of them.
    """

    def entries(df: DataFrame, kind: str, label: str, entry: list[str]) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}/"), label).alias("part"), F.array(*entry).alias("at"), F.to_json(F.struct(*entry)).alias("entry"))

    rows = entries(node_table, "nodes", "label", ["key", "label"]).union(entries(edge_table, "edges", "name", ["start_key", "end_key", "type"]))
    dealt = rows.repartitionByRange("part", "at").sortWithinPartitions("part", "at")
    pieces = dealt.select(F.spark_partition_id().alias("task"), "part", "entry").mapInArrow(_pieces, "task int, part string, number long, piece string")
    return pieces.repartition("part").sortWithinPartitions("part", "task", "number").select("part", "piece").mapInArrow(_digests, "part string, sha string")
