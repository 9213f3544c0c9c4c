"""From landed string tables to the typed model: dimensions, stations and aliases, facts, spatial relations, issues.

Every input is a frame of strings with ``source_row_number``; geometries, where a table has them, are in
the column ``geometry`` (multipolygon of points in metres) or ``x``/``y``. Lookups are null-safe joins, dense
ids are numbered without a global sort in one task, and what cannot be resolved is null plus an issue row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.functions import values as V
from limnos.operators import relational as R
from limnos.operators import spatial as S

Frames = dict[str, DataFrame]
_KINDS = {"key": T.key_text, "text": T.clean_text, "num": V.number, "int": V.integer, "bool": V.tri_state, "date": V.date_of, "as_is": lambda c: c}

#: Source columns of the plainly mapped tables, fixed values: target=source:kind.
PLAIN = {
    "planning_unit": ("planunits", "planning_unit_code=planu_cd:key name=planu_name:text participants=parti:text work_area_code=wa_cd:key river_basin_code=rbd_cd:key country_state_code=land_cd:key delivery_date=delivery:date metadata_reference=metadata:text url=url:text wb_username=wbusername:text geometry=geometry:as_is"),
    "groundwater_body": ("groundwaterbody", "groundwater_body_id=eu_cd_gb:key name=nametext:text horizon=horizon:int aquifer_type=aqui_type:text geological_formation=geol_form:text layered=layered:text river_basin_code=rbd_cd:key source_planning_unit_code=planu_cd:key quantitative_status=quant_stat:text chemical_status=chem_stat:text metadata_reference=metadata:text geometry=geometry:as_is source_row_number=source_row_number:int"),
    "catchment": ("catchments", "catchment_id=drain_c:key name=drain_n:text area_km2=area_ca:num area_number=area_no:key source_water_body_code=eu_cd_w:key source_planning_unit_code=planu_c:key river_basin_code=rbd_cd:key water_authority=wa_cd:key description_from=descr_f:text description_to=descr_t:text comment=comment:text metadata_reference=metadata:text geometry=geometry:as_is source_row_number=source_row_number:int"),
    "core_location": ("core_locations", "core_code=core_code:key water_body_id=eu_cd_lw:key longitude=x_coord:num latitude=y_coord:num"),
    "_lake": ("lakewaterbody", "water_body_id=eu_cd_lw:key segment_code=eu_cd_ls:key name=s_name:text river_basin_code=rbd_cd:key source_planning_unit_code=planu_cd:key ecological_status=eco_stat:text chemical_status=chem_stat:text geometry=geometry:as_is source_row_number=source_row_number:int"),
    "_base": ("stammdaten", "water_body_id=eu_cd_lw:key lawa_id=lawa_id:int hectares=flaeche_atkis:num volume_m3=volumen:num volume_source=volumen_quelle:text max_depth_m=z_max:num stratification=schichtung:text residence_time=verweilzeit:text lawa_type=lawa_ti_typ:text water_type=typ_2021:key artificial=artificial_2021:bool modified=modified_2021:bool"),
    "_section": ("einzeldaten_abschnitte", "sampling_section_id=source_row_number:int source_row_number=source_row_number:int water_body_id=eu_cd_lw:key source_station_code=messstelle:key section_code=abschnitt:key sampling_year=jahr:int length_from=laenge_von:num length_to=laenge_bis:num depth_from=tiefe_von:num depth_to=tiefe_bis:num"),
    "_body_assessment": ("wasserkoerper_bewertung", "assessment_id=source_row_number:int source_row_number=source_row_number:int water_body_id=eu_cd_lw:key parameter=parameter:text component=qk:text assessment_year=jahr:int value=wert:text method=methode:text"),
    "_station_assessment": ("messstellen_bewertung", "assessment_id=source_row_number:int source_row_number=source_row_number:int water_body_id=eu_cd_lw:key source_station_code=messstelle:key parameter=parameter:text component=komponente:text unit=einheit:text assessment_year=jahr:int value=wert:text description=beschreibung:text method=methode:text expert_judgement=expertenurteil:text comment=kommentar:text reported_x=x_wert:num reported_y=y_wert:num"),
    "_biology": ("einzeldaten", "source_row_number=source_row_number:int source_index=source_index:int water_body_id=eu_cd_lw:key source_station_code=messstelle:key source_section_code=id_abschnitt:key measured_at=datum:date parameter=parameter:text component=qk:text unit=einheit:text value=wert:num comment=kommentar:text method=methode:text monitoring_program=messprogramm:text abundance_type=abundanzart:text"),
    "_chemistry": ("einzeldaten_chemie", "source_row_number=source_row_number:int source_index=source_index:int water_body_id=eu_cd_lw:key source_station_code=messstelle:key source_section_code=id_abschnitt:key measured_at=datum:date parameter=parameterbezeichnung:text component=qk:text unit=einheit:text value=wert:num comment=kommentar:text method=methode:text monitoring_program=messprogramm:text"),
    "_ground_status": ("gw_measures", "source_row_number=source_row_number:int groundwater_body_id=eu_cd_gb:key pollutant_code=pollcode:key failed_standard=poll_fail:bool risk_code=poll_risk:key upward_trend_code=pollupward:key trend_code=polltrendr:key trend_reversal_code=polltrer_p:key exemption_type=ex_che_typ:key exemption_reason=ex_che_pr:key exception_code=pollexntc:key level_set=levelset:text level_value=levelvalue:num level_unit=levelunit:text inserted_at=ins_when:date inserted_by=ins_by:text river_basin_code=rbd_cd:key metadata_reference=metadata:text pollutant_other=pollother:text"),
    "_surface_status": ("ow_measures", "source_row_number=source_row_number:int source_code=eu_cd_ls:key pollutant_code=pscode:key failed_standard=ps_fail:bool exemption_type=chemextype:key exemption_reason=chemexpre:key exception_code=ps_exctype:key fail_reason_code=failrbsp:key fail_reason_other=failrbs_ot:text inserted_at=ins_when:date inserted_by=ins_by:text river_basin_code=rbd_cd:key metadata_reference=metadata:text"),
    "_paleo": ("paleo_elements", "paleo_measurement_id=source_row_number:int source_row_number=source_row_number:int core_code=code:key element=name:text age_years_bp=ages:int value_dimensionless=value:num"),
    "_area_assessment": ("protection_area_bewertung", "assessment_id=source_row_number:int source_row_number=source_row_number:int source_protected_area_code=eu_cd_p:key source_water_body_code=eu_cd_wb:key template=template:text name=nametext:text legislation_code=leg_cd:key legislation_link=legislink:text area_type=parea_t:key designation_begin=desigbegin:date evolution_type=evolutiont:text comment=pa_comment:text exemption_code=parea_ex:key habitat_status=parea_hb_o:key metadata_reference=metadata:text"),
}
#: Protected-area sources: table, id column, member-state column; optional columns follow.
AREAS = (("ffh", "eu_cd_ph", "ms_cd_ph"), ("waterprotection", "eu_cd_pd", "ms_cd_pd"), ("recreation_areas", "eu_cd_pr", "ms_cd_pr"))


def plain(raw: Frames, name: str) -> DataFrame:
    """A plainly mapped table; source columns that are absent become null."""
    source, mapping = PLAIN[name]
    df = raw[source]
    columns = []
    for entry in mapping.split():
        target, rest = entry.split("=")
        column, kind = rest.split(":")
        columns.append((_KINDS[kind](F.col(f"`{column}`")) if column in df.columns else F.lit(None).cast("string")).alias(target))
    return df.select(*columns)


def issue(df: DataFrame, table: str, source: str, field: str, value: Column, kind: str) -> DataFrame:
    return df.select(F.lit(table).alias("target_table"), F.lit(source).alias("source_file"), F.col("source_row_number").cast("long").alias("source_row_number"), F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(kind).alias("issue_type"))


def stations_and_aliases(raw: Frames, water: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, aliases).

    Registered stations come first, in source order, each with its official code and its name as aliases; of equal
    aliases the later station holds the alias, at the place of the first. Codes that only observations know become
    stations of their own where the water body is known, in the order biology, chemistry, sections, assessments.
    """
    known = raw["messstellen"]
    registered = known.select(V.integer(F.col("source_row_number")).alias("row"), T.key_text(F.col("eu_cd_wb")).alias("water_body_id"), T.key_text(F.col("eu_cd_sm")).alias("eu_station_code"), T.clean_text(F.col("name_stn")).alias("name"), *(V.number(F.col(c)).alias(c) for c in "xy"))
    slots = F.array(F.struct(F.lit(1).alias("slot"), F.col("eu_station_code").alias("alias_code"), F.lit("eu_code").alias("alias_type")), F.struct(F.lit(2).alias("slot"), T.key_text(F.col("name")).alias("alias_code"), F.lit("local_code").alias("alias_type")))
    claims = registered.select("row", "water_body_id", F.explode(slots).alias("s")).select(F.struct(F.lit(0).alias("rank"), "row", F.col("s.slot").alias("slot")).alias("at"), "water_body_id", "s.alias_code", "s.alias_type", F.lit("messstellen.shp").alias("source_file")).where("alias_code is not null")
    claimed = claims.groupBy("water_body_id", "alias_code").agg(F.min("at").alias("first"), F.max("at").alias("owner"), F.max_by("alias_type", "at").alias("alias_type"), F.first("source_file").alias("source_file"))

    seen = None
    for rank, (table, file) in enumerate((("einzeldaten", "einzeldaten.csv"), ("einzeldaten_chemie", "einzeldaten_chemie.csv"), ("einzeldaten_abschnitte", "einzeldaten_abschnitte.csv"), ("messstellen_bewertung", "messstellen_bewertung.csv")), 1):
        if table in raw:
            part = raw[table].select(T.key_text(F.col("eu_cd_lw")).alias("water_body_id"), T.key_text(F.col("messstelle")).alias("alias_code"), F.struct(F.lit(rank).alias("rank"), V.integer(F.col("source_row_number")).alias("row"), F.lit(0).alias("slot")).alias("at"), F.lit(file).alias("source_file"))
            seen = part if seen is None else seen.union(part)
    observed = seen.where("water_body_id is not null and alias_code is not null").groupBy("water_body_id", "alias_code").agg(F.min("at").alias("first"), F.min_by("source_file", "at").alias("source_file"))
    observed = observed.join(water.select("water_body_id"), "water_body_id", "left_semi").join(claimed, ["water_body_id", "alias_code"], "left_anti").withColumn("owner", F.col("first")).withColumn("alias_type", F.lit("observed_code"))
    every = claimed.unionByName(observed.select(claimed.columns))

    places = raw["messstellen_bewertung"].select(T.key_text(F.col("eu_cd_lw")).alias("water_body_id"), T.key_text(F.col("messstelle")).alias("alias_code"), V.integer(F.col("source_row_number")).alias("r"), V.number(F.col("x_wert")).alias("x"), V.number(F.col("y_wert")).alias("y")).where("x is not null and y is not null") if "messstellen_bewertung" in raw else None
    rows = registered.select(F.struct(F.lit(0).alias("rank"), "row", F.lit(0).alias("slot")).alias("at"), "water_body_id", "eu_station_code", "name", F.lit("shapefile").alias("station_origin"), "x", "y")
    only = observed.select(F.col("first").alias("at"), "water_body_id", F.lit(None).cast("string").alias("eu_station_code"), F.col("alias_code").alias("name"), F.lit("observed_only").alias("station_origin"))
    if places is not None:
        at = places.groupBy("water_body_id", F.col("alias_code").alias("name")).agg(F.min_by(F.struct("x", "y"), "r").alias("p"))
        only = only.join(at, ["water_body_id", "name"], "left").select("at", "water_body_id", "eu_station_code", "name", "station_origin", "p.x", "p.y")
    else:
        only = only.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    stations = _numbered(rows.unionByName(only), "at", "station_id")
    owners = every.withColumn("at", F.struct(F.col("owner.rank").alias("rank"), F.col("owner.row").alias("row"), F.lit(0).alias("slot"))).join(stations.select("at", "station_id"), "at")
    aliases = _numbered(owners.select("first", "station_id", "water_body_id", "alias_code", "alias_type", "source_file"), "first", "alias_id").drop("first")
    return stations.drop("at"), aliases


def _numbered(df: DataFrame, order: str, id_column: str) -> DataFrame:
    """Rows numbered from 1 by a unique order, without a sort in one task."""
    keyed = df.withColumn("_k", F.format_string("%012d|%018d|%04d", *(F.col(f"{order}.{c}").cast("long") for c in ("rank", "row", "slot"))))
    return R.dense_ids(keyed, ["_k"], id_column).join(keyed, "_k").drop("_k")


def build(raw: Frames, cell_m: float = 5000.0) -> Frames:
    """All tables of the model whose sources are given, and ``import_issue``."""
    t: Frames = {}
    issues: list[DataFrame] = []
    t["planning_unit"] = plain(raw, "planning_unit")
    plans = t["planning_unit"].select("planning_unit_code").distinct()
    with_plan = lambda df: R.resolve(df, plans, {"source_planning_unit_code": "planning_unit_code"}, "planning_unit_code", "planning_unit_code")

    lakes = with_plan(plain(raw, "_lake")).join(plain(raw, "_base"), "water_body_id", "left")
    t["water_body"] = lakes.withColumn("area_km2", V.hectares_to_km2(F.col("hectares"))).drop("hectares", "source_row_number")
    both = F.array(F.struct(F.lit("EU_CD_LW").alias("identifier_type"), F.col("water_body_id").alias("identifier")), F.when(F.col("segment_code") != F.col("water_body_id"), F.struct(F.lit("EU_CD_LS").alias("identifier_type"), F.col("segment_code").alias("identifier"))))
    t["water_body_identifier"] = t["water_body"].select("water_body_id", F.explode(F.array_compact(both)).alias("i")).select("i.identifier", "i.identifier_type", "water_body_id")
    ids = t["water_body_identifier"]
    for name, file in (("groundwater_body", "groundwaterbody.shp"), ("catchment", "catchments.shp")):
        if PLAIN[name][0] in raw:
            rows = with_plan(plain(raw, name))
            if name == "groundwater_body":
                lost = rows.where("planning_unit_code is null and source_planning_unit_code is not null")
                issues.append(issue(lost, name, file, "PLANU_CD", F.col("source_planning_unit_code"), "unresolved_planning_unit"))
            t[name] = rows.drop("source_row_number")

    if "messstellen" in raw:
        t["monitoring_station"], t["station_alias"] = stations_and_aliases(raw, t["water_body"])
    if "core_locations" in raw:
        cores = plain(raw, "core_location")
        t["core_location"] = cores.withColumn("location", S.to_utm33(F.col("longitude"), F.col("latitude")))

    observed = [plain(raw, n) for n in ("_biology", "_chemistry", "_body_assessment", "_station_assessment") if PLAIN[n][0] in raw]
    t["parameter"] = R.dense_ids(reduce(DataFrame.union, (o.select(F.col("parameter").alias("name"), F.col("component").alias("quality_component")) for o in observed)).where("name is not null"), ["name", "quality_component"], "parameter_id")
    measured = [o for o in observed if "unit" in o.columns]
    if measured:
        t["unit"] = R.dense_ids(reduce(DataFrame.union, (o.select(F.col("unit").alias("symbol")) for o in measured)).where("symbol is not null"), ["symbol"], "unit_id")

    with_parameter = lambda df: R.resolve(df, t["parameter"], {"parameter": "name", "component": "quality_component"}, "parameter_id", "parameter_id")
    with_unit = lambda df: R.resolve(df, t["unit"], {"unit": "symbol"}, "unit_id", "unit_id")
    with_station = lambda df: R.resolve(df, t["station_alias"], {"water_body_id": "water_body_id", "source_station_code": "alias_code"}, "station_id", "station_id")
    judged = lambda df: df.withColumn("v", V.validity(F.col("value"))).withColumns({"value_raw": V.number(F.col("value")), "value_normalized": F.col("v.value"), "is_valid": F.col("v.valid"), "validation_reason": F.col("v.reason")}).drop("v", "value", "parameter", "component")

    if "einzeldaten_abschnitte" in raw:
        t["sampling_section"] = with_station(plain(raw, "_section"))
    facts = []
    for name, file in (("_biology", "einzeldaten.csv"), ("_chemistry", "einzeldaten_chemie.csv")):
        if PLAIN[name][0] in raw:
            facts.append(plain(raw, name).withColumn("source_file", F.lit(file)).withColumn("_rank", F.lit(len(facts))))
    if facts:
        m = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
        order = m.select(F.struct(F.col("_rank").alias("rank"), F.col("source_row_number").alias("row"), F.lit(0).alias("slot")).alias("at"), "*")
        m = with_station(with_unit(with_parameter(_numbered(order, "at", "measurement_id").drop("at"))))
        if "sampling_section" in t:
            m = R.resolve(m.withColumn("_year", F.year("measured_at").cast("long")), t["sampling_section"], {"water_body_id": "water_body_id", "source_section_code": "section_code", "_year": "sampling_year"}, "sampling_section_id", "sampling_section_id", "source_row_number").drop("_year")
        issues.append(issue(m.where("parameter_id is null"), "measurement", "einzeldaten", "PARAMETER", F.col("parameter"), "unresolved_parameter"))
        t["measurement"] = m.where("parameter_id is not null").drop("_rank", "parameter", "component", "unit")
    if "wasserkoerper_bewertung" in raw:
        t["water_body_assessment"] = judged(with_parameter(plain(raw, "_body_assessment"))).withColumn("source_file", F.lit("wasserkoerper_bewertung.csv"))
    if "messstellen_bewertung" in raw:
        t["station_assessment"] = judged(with_station(with_unit(with_parameter(plain(raw, "_station_assessment"))))).drop("unit").withColumn("source_file", F.lit("messstellen_bewertung.csv"))

    if "gw_measures" in raw or "ow_measures" in raw:
        _chemical(raw, t, ids, issues)
    if "paleo_elements" in raw:
        paleo = plain(raw, "_paleo")
        t["paleo_element"] = R.dense_ids(paleo.select(F.col("element").alias("symbol")).where("symbol is not null"), ["symbol"], "element_id")
        t["paleo_measurement"] = R.resolve(paleo, t["paleo_element"], {"element": "symbol"}, "element_id", "element_id").drop("element")
    _areas(raw, t, ids)
    _overlaps(t, cell_m)
    t["import_issue"] = reduce(DataFrame.union, issues) if issues else None
    return {k: v for k, v in t.items() if v is not None}


def _chemical(raw: Frames, t: Frames, ids: DataFrame, issues: list[DataFrame]) -> None:
    sources = []
    if "gw_measures" in raw:
        sources.append(plain(raw, "_ground_status").withColumns({"source_file": F.lit("GW_measures.csv"), "_rank": F.lit(0)}))
    if "ow_measures" in raw:
        surface = R.resolve(plain(raw, "_surface_status"), ids, {"source_code": "identifier"}, "water_body_id", "surface_water_body_id")
        sources.append(surface.withColumns({"source_file": F.lit("OW_measures.csv"), "_rank": F.lit(1)}))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    for c in ("groundwater_body_id", "surface_water_body_id", "source_code", "pollutant_other"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    other = rows.where("pollutant_code is not null").groupBy("pollutant_code").agg(F.min_by("pollutant_other", F.struct("_rank", "source_row_number")).alias("pollutant_other"))
    t["pollutant"] = R.dense_ids(other.select("pollutant_code"), ["pollutant_code"], "pollutant_id").join(other, "pollutant_code").withColumn("name", F.lit(None).cast("string"))
    # ids are given before unresolved rows are dropped, so they keep their gaps
    numbered = _numbered(rows.withColumn("at", F.struct(F.col("_rank").alias("rank"), F.col("source_row_number").alias("row"), F.lit(0).alias("slot"))), "at", "chemical_status_id").drop("at")
    owned = F.col("groundwater_body_id").isNotNull() | F.col("surface_water_body_id").isNotNull()
    issues.append(issue(numbered.where(~owned), "chemical_status", "OW_measures.csv", "EU_CD_LS", F.col("source_code"), "unresolved_water_body"))
    t["chemical_status"] = R.resolve(numbered.where(owned), t["pollutant"], {"pollutant_code": "pollutant_code"}, "pollutant_id", "pollutant_id").drop("_rank", "pollutant_code", "pollutant_other", "source_code")


def _areas(raw: Frames, t: Frames, ids: DataFrame) -> None:
    frames = []
    for table, id_col, state in AREAS:
        if table in raw:
            df = raw[table]
            pick = lambda c, kind, df=df: (_KINDS[kind](F.col(c)) if c in df.columns else F.lit(None).cast("string"))
            frames.append(df.select(pick(id_col, "key").alias("protected_area_id"), pick("name", "text").alias("name"), pick("prot_type", "text").alias("area_type"), pick("leg_cd", "key").alias("legislation_code"), pick(state, "key").alias("member_state_code"), pick("status", "text").alias("status"), pick("wsg_zone", "text").alias("water_protection_zone"), pick("areastatus", "text").alias("area_status"), pick("rbd_cd", "key").alias("river_basin_code"), pick("metadata", "text").alias("metadata_reference"), pick("url", "text").alias("url"), F.lit(table + ".shp").alias("source_file"), "geometry"))
    if frames:
        t["protected_area"] = reduce(DataFrame.unionByName, frames)
    if "protection_area_bewertung" in raw:
        a = R.resolve(plain(raw, "_area_assessment"), ids, {"source_water_body_code": "identifier"}, "water_body_id", "surface_water_body_id")
        for key, column, target in (("groundwater_body", "groundwater_body_id", "source_water_body_code"), ("protected_area", "protected_area_id", "source_protected_area_code")):
            known = t[key].select(column).distinct() if key in t else None
            a = R.resolve(a, known, {target: column}, column, column) if known is not None else a.withColumn(column, F.lit(None).cast("string"))
        t["protected_area_assessment"] = a


def _overlaps(t: Frames, cell_m: float) -> None:
    shape = lambda name, key: t[name].select(F.col(key).alias("id"), "geometry").where("geometry is not null")
    has = lambda name: name in t and "array" in dict(t[name].dtypes).get("geometry", "")
    for target, (a, ka, ra), (b, kb, rb) in (
        ("water_body_groundwater_body", ("water_body", "water_body_id", "water_body_overlap_ratio"), ("groundwater_body", "groundwater_body_id", None)),
        ("catchment_groundwater_body", ("catchment", "catchment_id", "catchment_overlap_ratio"), ("groundwater_body", "groundwater_body_id", None)),
        ("catchment_water_body", ("catchment", "catchment_id", "catchment_overlap_ratio"), ("water_body", "water_body_id", "water_body_overlap_ratio")),
        ("water_body_protected_area", ("water_body", "water_body_id", "water_body_overlap_ratio"), ("protected_area", "protected_area_id", None)),
    ):
        if has(a) and has(b):
            o = S.overlaps(shape(a, ka), shape(b, kb))
            t[target] = o.select(F.col("left_id").alias(ka), F.col("right_id").alias(kb), "overlap_area_km2", F.col("left_ratio").alias(ra), *([F.col("right_ratio").alias(rb)] if rb else []), F.col("determination_method").alias("relation_method" if target == "water_body_protected_area" else "determination_method"))
    if "protected_area_assessment" in t:
        stated = t["protected_area_assessment"].where("surface_water_body_id is not null and protected_area_id is not null").select(F.col("surface_water_body_id").alias("water_body_id"), "protected_area_id", F.lit("source_reference").alias("relation_method")).distinct()
        spatial = t.get("water_body_protected_area")
        t["water_body_protected_area"] = spatial.unionByName(stated, allowMissingColumns=True) if spatial is not None else stated.withColumns({"overlap_area_km2": F.lit(None).cast("double"), "water_body_overlap_ratio": F.lit(None).cast("double")})
    if "monitoring_station" in t:
        points = t["monitoring_station"].where("x is not null and y is not null").select(F.col("station_id").alias("id"), "x", "y")
        for target, name, key in (("station_groundwater_body", "groundwater_body", "groundwater_body_id"), ("station_catchment", "catchment", "catchment_id")):
            if has(name):
                t[target] = S.points_in_polygons(points, shape(name, key)).select(F.col("point_id").alias("station_id"), F.col("polygon_id").alias(key), F.lit("spatial_intersection").alias("determination_method"))


def violations(t: Frames) -> DataFrame:
    """(rule, n) of broken invariants: owners of statuses, origins, one fact per source row, unique ids."""
    checks = []
    count = lambda rule, df: checks.append(df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    if "chemical_status" in t:
        count("one owner per chemical status", t["chemical_status"].where("(groundwater_body_id is null) = (surface_water_body_id is null)"))
    if "monitoring_station" in t:
        count("station origin", t["monitoring_station"].where("station_origin not in ('shapefile', 'observed_only')"))
    for name in ("measurement", "water_body_assessment", "station_assessment", "chemical_status"):
        if name in t:
            count(f"one {name} per source row", t[name].groupBy("source_file", "source_row_number").count().where("count > 1"))
    count("parameters are unique", t["parameter"].groupBy("name", "quality_component").count().where("count > 1"))
    return reduce(DataFrame.union, checks).where("n > 0")
