"""Topology, matching, graph and geometry over keys and points derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.operators import graph as G
from limnos.operators import matching as M
from limnos.operators import spatial as S
from limnos.operators import topology as P
from limnos.session import read_table as t

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_BODIES = "(select s_suppkey as pos, 'X_' || s_suppkey as code, s_name as name, case when s_suppkey % 2 = 0 then 'a' else 'b' end as src, '5' || s_nationkey || (s_suppkey % 23) as gkz from supplier)"
_REL = "case when a.gkz = b.gkz then 'same_system' when starts_with(b.gkz, a.gkz) then 'receives' when starts_with(a.gkz, b.gkz) then 'drains_into' else 'shares_catchment' end"


def _bodies(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("X_"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("name"), F.array(F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b")).alias("sources"), F.concat(F.lit("5"), F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 23).cast("string")).alias("gkz"))


@query(f"""
select a.pos as pos_a, b.pos as pos_b, {_REL} as relation, case when a.src <> b.src then 'ja' else 'nein' end as cross_document
from {_BODIES} a join {_BODIES} b on a.pos < b.pos and left(a.gkz, 2) = left(b.gkz, 2)""")
def prefix_relations(spark, d):
    return P.spatial_edges(_bodies(spark, d)).select("pos_a", "pos_b", "relation", "cross_document")


@query(f"""
select relation, count(*) as edges, count(*) filter (where sa <> sb) as cross_document_edges from (select {_REL} as relation, a.src as sa, b.src as sb
from {_BODIES} a join {_BODIES} b on a.pos < b.pos and left(a.gkz, 2) = left(b.gkz, 2)) group by 1""")
def relation_summary(spark, d):
    return P.relation_counts(_bodies(spark, d))


@query(f"""
with e as (select p_partkey as pos, cast(p_partkey as varchar) as event_id, cast(p_partkey % 100 + 1 as varchar) as core, case p_size % 3 when 0 then 'Maßnahme' when 1 then 'Zustand' else 'Sonstiges' end as kind from part),
r as (select *, row_number() over (partition by core, kind order by pos) as n from e),
f as (select case when length(a.gkz) >= length(b.gkz) then a.pos else b.pos end as up, case when length(a.gkz) >= length(b.gkz) then b.pos else a.pos end as down, abs(length(a.gkz) - length(b.gkz)) as dist
      from {_BODIES} a join {_BODIES} b on a.pos < b.pos and a.src <> b.src and a.gkz <> b.gkz and (starts_with(a.gkz, b.gkz) or starts_with(b.gkz, a.gkz)))
select c.event_id as cause_event_id, x.event_id as effect_event_id, cast(f.dist as bigint) as hydro_distance from f join r c on c.core = cast(f.up as varchar) and c.kind = 'Maßnahme' and c.n <= 3 join r x on x.core = cast(f.down as varchar) and x.kind = 'Zustand' and x.n <= 3 where f.dist <= 4""")
def prefix_causal_candidates(spark, d):
    p = t(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "Maßnahme").when(F.col("p_size") % 3 == 1, "Zustand").otherwise("Sonstiges")
    events = p.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("event_id"), F.concat(F.lit("X_"), (F.col("p_partkey") % 100 + 1).cast("string")).alias("code"), kind.alias("record_type"), F.col("p_name").alias("statement"), F.lit("s").alias("source"))
    return P.causal_candidates(events, P.flow_edges(_bodies(spark, d), events)).select("cause_event_id", "effect_event_id", F.col("hydro_distance").cast("long").alias("hydro_distance"))


@query("select p_brand as key, arg_min(p_name, row(length(p_name), p_partkey)) as name, min(p_partkey) as pos from part group by 1")
def min_by_length(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    return P.shortest_first(p, "key", "name", "pos")


@query("""
with c as (select lower(p_name) as key, p_brand as code, count(*) as n, min(p_partkey) as pos from part group by 1, 2)
select key, code from (select *, row_number() over (partition by key order by case when contains(code, '1') then 1 else 0 end desc, n desc, pos) as r from c) where r = 1""")
def name_to_code(spark, d):
    return M.name_to_code(t(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_brand").alias("code")), "1")


_POINTS = "select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings"


@query(f"""
with p as ({_POINTS}), j as (select a.vec_id as id, b.vec_id as target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from p a join p b on a.vec_id % 2 = 1 and b.vec_id % 2 = 0 and abs(a.x - b.x) <= 0.1 and abs(a.y - b.y) <= 0.1),
b as (select id, arg_min(target, row(d, target)) as target, min(d) as d from j where d <= 0.1 group by id)
select p.vec_id as id, target, round(d, 6) as distance, case when d <= 0.05 then 'auto' when d is not null then 'review' else 'none' end as status from p left join b on id = vec_id where vec_id % 2 = 1""")
def nearest_neighbour(spark, d):
    p = t(spark, d, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    out = M.nearest(p.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "id"), p.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "target"), 0.05)
    return out.withColumn("distance", F.round("distance", 6))


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), q as (select * from v where vec_id % 100 = 0),
s as (select q.vec_id as q, v.vec_id as id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) as c from q, v where q.vec_id <> v.vec_id)
select q, id, round(c, 4) as cosine, rank from (select *, row_number() over (partition by q order by round(c, 9) desc, id) as rank from s) where rank <= 5""")
def vector_topk(spark, d):
    """Every vector whose id is divisible by 100 against all."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return M.most_similar(v.where("id % 100 = 0"), v, 5).select("q", "id", F.round("c", 4).alias("cosine"), "rank")


@query("""
with w as (select p_name, count(*) as n, list_distinct(string_split(lower(p_name), ' ')) as t from part group by 1),
s as (select a.p_name as a, b.p_name as b, a.n as n, b.n as m, 200.0 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)) as s from w a join w b on a.p_name <= b.p_name)
select a, b, round(s, 4) as score, cast(case when a = b then n * (n - 1) // 2 else n * m end as bigint) as parts from s where s >= 50""")
def token_set_match(spark, d):
    """Every part: pairs of names, found by prefixes of their rarest tokens, with the number of pairs of parts."""
    names = t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    words = names.select("name", "n", F.explode(T.informative_tokens(F.col("name"))).alias("token"))
    rare = words.join(words.groupBy("token").agg(F.count("*").alias("often")), "token")
    # a score of 50 needs a third of either side's tokens shared
    tokens = F.array_sort(F.collect_list(F.struct("often", "token")))
    heads = rare.groupBy("name", "n").agg(tokens.alias("i")).select("name", "n", F.explode(F.slice(F.transform("i", lambda x: x["token"]), F.lit(1), (F.size("i") - F.ceil(F.size("i") / 3) + 1).cast("int"))).alias("token"))
    a, b = (heads.select(F.col("name").alias(s), F.col("n").alias(f"n_{s}"), "token") for s in "ab")
    pairs = a.join(b, "token").where("a <= b").drop("token").distinct().withColumn("s", T.token_set_score(F.col("a"), F.col("b"))).where("s >= 50")
    return pairs.select("a", "b", F.round("s", 4).alias("score"), F.expr("case when a = b then n_a * (n_a - 1) div 2 else n_a * n_b end").alias("parts"))


@query()
def fuzzy_ratio_match(spark, d):
    """Ratcliff-Obershelp similarity at least 0.9; SQL has no such ratio, tests compare with all pairs."""
    names = t(spark, d, "part").select(F.col("p_name").alias("name"))
    return M.similar_names(names, names)


@query("""
with s as (select l_partkey, l_suppkey, sum(l_quantity) as q from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_partkey order by q desc, l_suppkey) as rank, lead(q) over (partition by l_partkey order by q desc, l_suppkey) as second from s)
select l_partkey, l_suppkey, q as score, rank, case when rank = 1 then q - coalesce(second, 0) end as margin from r where rank <= 3""")
def ranked_candidates(spark, d):
    from limnos.operators.relational import ranked

    s = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("score"))
    return ranked(s, ["l_partkey"], "score", [F.col("l_suppkey")], 3).withColumn("rank", F.col("rank").cast("long"))


@query("""
with e as (select o_orderkey as item, 'c' as set_id, 'code' as kind, cast(o_custkey % 7 as varchar) as target from orders union all select o_orderkey, 'c', 'code', cast(o_custkey % 5 as varchar) from orders
 union all select o_orderkey, 'n', 'name', cast(o_orderkey % 7 as varchar) from orders union all select o_orderkey, 'n', 'name', cast(o_orderkey % 3 as varchar) from orders),
h as (select item, target, count(distinct set_id) as k from e group by 1, 2), a as (select item, list_sort(list(target) filter (where k = 2)) as allowed, list_sort(list(target)) as every from h group by 1)
select item, len(coalesce(allowed, [])) = 0 as conflict, case when len(allowed) = 1 then 'rule_assigned' else 'needs_review' end as status, array_to_string(case when len(coalesce(allowed, [])) = 0 then every else allowed end, ',') as targets from a""")
def evidence_intersection(spark, d):
    o = t(spark, d, "orders")
    part = lambda s, k, a, b: o.select(F.col("o_orderkey").alias("item"), F.lit(s).alias("set_id"), F.lit(k).alias("kind"), F.explode(F.array(*(x.cast("string") for x in (a, b)))).alias("target"))
    e = part("c", "code", F.col("o_custkey") % 7, F.col("o_custkey") % 5).union(part("n", "name", F.col("o_orderkey") % 7, F.col("o_orderkey") % 3))
    flags = o.select(F.col("o_orderkey").alias("item"), F.lit(False).alias("blocked"))
    return M.fuse_evidence(e, flags).withColumn("targets", F.array_join("targets", ","))


def _graph(spark, d):
    nodes = {n: t(spark, d, n) for n in ("nation", "customer", "orders")}
    specs = (G.Node("nation", "Nation", ("n_nationkey",)), G.Node("customer", "Customer", ("c_custkey",)), G.Node("orders", "Order", ("o_orderkey",)))
    edges = (G.Edge("in_nation", "IN_NATION", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "customer"), G.Edge("placed", "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"), "orders", ("o_orderpriority",)))
    return G.nodes(nodes, specs), G.edges(nodes, edges)


@query("""
select 'in_nation' as name, 'IN_NATION' as type, cast(c_custkey as varchar) as start_key, cast(c_nationkey as varchar) as end_key, cast(null as varchar) as priority from customer union all
select 'placed', 'PLACED', cast(o_custkey as varchar), cast(o_orderkey as varchar), o_orderpriority from orders""")
def graph_edges(spark, d):
    return _graph(spark, d)[1].select("name", "type", "start_key", "end_key", F.try_element_at("properties", F.lit("o_orderpriority")).alias("priority"))


@query("""
select 'start' as missing, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0) union all
select 'end', count(*) from customer where c_nationkey not in (select n_nationkey from nation where n_nationkey < 20) union all
select 'customer start', count(*) from customer where c_custkey % 2 = 1""")
def graph_completeness(spark, d):
    nodes, edges = _graph(spark, d)
    kept = nodes.where("not (label = 'Customer' and cast(key as bigint) % 2 = 1) and not (label = 'Nation' and cast(key as int) >= 20)")
    kind = F.when((F.col("missing") == "start") & (F.col("name") == "in_nation"), "customer start").otherwise(F.col("missing"))
    return G.dangling(edges, kept).groupBy(kind.alias("missing")).agg(F.count("*").alias("n"))


@query("select n_name, o_orderpriority as priority, count(*) as paths from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2")
def graph_paths(spark, d):
    _, edges = _graph(spark, d)
    starts = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("o"), "o_orderpriority")
    path = G.hop(G.hop(starts, edges, "PLACED", "o", "c", backward=True), edges, "IN_NATION", "c", "n")
    return path.join(t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n"), "n_name"), "n").groupBy("n_name", F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("paths"))


@query("""
with e as (select cast(p_partkey as varchar) as id, p_brand as code, case when p_size > 25 then 'Messung' else 'Zustand' end as kind, p_name as st from part)
select 'finding/' || id as s, p, o from e, lateral (values ('a', 'DocumentedFinding'), ('label', st), ('statementText', st), ('recordType', kind), ('wasDerivedFrom', 'document/d'), ('concernsWaterBody', 'water-body/' || code), ('a', case when kind = 'Messung' then 'MeasurementFinding' end)) v(p, o) where o is not null
union all select 'causal-link/' || s_suppkey, p, o from supplier, lateral (values ('a', 'CausalLink'), ('cause', 'finding/' || s_suppkey), ('effect', 'finding/' || (s_suppkey + 1)), ('relationshipType', 'x'), ('wasDerivedFrom', 'document/d')) v(p, o)""")
def triples(spark, d):
    p = t(spark, d, "part")
    events = p.select(F.col("p_partkey").cast("string").alias("event_id"), F.col("p_brand").alias("eu_cd_lw"), F.when(F.col("p_size") > 25, "Messung").otherwise("Zustand").alias("record_type"), F.col("p_name").alias("statement"), F.lit(None).cast("string").alias("time_original"), F.lit("").alias("quote"), F.lit("d").alias("source_document"))
    k = F.col("s_suppkey")
    rel = t(spark, d, "supplier").select(k.cast("string").alias("relationship_id"), k.cast("string").alias("source_event_id"), (k + 1).cast("string").alias("target_event_id"), F.lit("x").alias("relationship_type"), F.lit(None).cast("string").alias("mechanism"), F.lit("d").alias("source_document"))
    return G.triples(events, rel)


@query("""
with recursive c as (select 'r' || r_regionkey as class, 'root' as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
w(class, ancestor, depth) as (select class, parent, 1 from c union all select w.class, c.parent, w.depth + 1 from w join c on c.class = w.ancestor)
select class, ancestor, cast(min(depth) as bigint) as depth from w group by 1, 2""")
def closure_ancestors(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    classes = t(spark, d, "region").select(key("r", "r_regionkey").alias("class"), F.lit("root").alias("parent")).union(t(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))).union(t(spark, d, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey")))
    return G.ancestors(classes).withColumn("depth", F.col("depth").cast("long"))


def _box(id_, x, y, w, h):
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.col(id_).alias("id"), F.array(F.array(F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y)))).alias("geometry")


_A = "(select c_custkey as id, (c_custkey * 37) % 5000 + 0.5 as x, (c_custkey * 91) % 5000 + 0.25 as y, 60 as w, 40 as h from customer)"
_B = "(select s_suppkey as id, (s_suppkey * 53) % 5000 as x, (s_suppkey * 71) % 5000 as y, 150 as w, 100 as h from supplier)"


def _boxes(spark, d):
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    left = c.select(*_box("c_custkey", (F.col("c_custkey") * 37) % 5000 + 0.5, (F.col("c_custkey") * 91) % 5000 + 0.25, F.lit(60), F.lit(40)))
    right = s.select(*_box("s_suppkey", (F.col("s_suppkey") * 53) % 5000, (F.col("s_suppkey") * 71) % 5000, F.lit(150), F.lit(100)))
    return left, right


@query(f"""
with j as (select a.id as left_id, b.id as right_id, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as ar
from {_A} a join {_B} b on a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)
select left_id, right_id, cast(round(ar, 4) as double) as area, round(ar / 2400.0, 6) as left_ratio, round(ar / 15000.0, 6) as right_ratio from j""")
def geo_overlaps(spark, d):
    o = S.overlaps(*_boxes(spark, d))
    return o.select("left_id", "right_id", F.round(F.col("overlap_area_km2") * 1e6, 4).alias("area"), F.round("left_ratio", 6).alias("left_ratio"), F.round("right_ratio", 6).alias("right_ratio"))


@query(f"select p.id as point_id, b.id as polygon_id from {_A} p join {_B} b on p.x >= b.x and p.x < b.x + b.w and p.y >= b.y and p.y < b.y + b.h")
def geo_points_in_polygons(spark, d):
    left, right = _boxes(spark, d)
    corner = F.get(F.get(F.get("geometry", 0), 0), 0)
    return S.points_in_polygons(left.select("id", corner["x"].alias("x"), corner["y"].alias("y")), right)


@query(f"""
with j as (select p.id as point_id, b.id as polygon_id, greatest(b.x - p.x, 0, p.x - b.x - b.w) as dx, greatest(b.y - p.y, 0, p.y - b.y - b.h) as dy from {_A} p, {_B} b)
select point_id, polygon_id, round(sqrt(dx * dx + dy * dy), 6) as distance from j where dx * dx + dy * dy <= 2500""")
def geo_within_distance(spark, d):
    left, right = _boxes(spark, d)
    corner = F.get(F.get(F.get("geometry", 0), 0), 0)
    return S.within_distance(left.select("id", corner["x"].alias("x"), corner["y"].alias("y")), right, 50.0, digits=6)


_SLABS = """
with b as (select c_nationkey as code, (c_custkey * 37) % 5000 + 0.5 as x, (c_custkey * 91) % 5000 + 0.25 as y, c_custkey % 7 * 30 + 60 as w, c_custkey % 5 * 40 + 40 as h from customer),
e as (select code, x as v from b union select code, x + w from b), slab as (select code, v as x0, lead(v) over (partition by code order by v) as x1 from e),
r as (select s.code, x0, x1, y as y0, y + h as y1 from slab s join b on b.code = s.code and b.x <= x0 and b.x + b.w >= x1 where x1 is not null),
m as (select *, coalesce(max(y1) over (partition by code, x0 order by y0, y1 rows between unbounded preceding and 1 preceding), y0) as seen from r)
select code, cast(round(sum((x1 - x0) * greatest(0, y1 - greatest(y0, seen))), 2) as double) as area from m group by code"""


@query(_SLABS)
def geo_union_area(spark, d):
    """Area of each nation's union of overlapping boxes; the SQL adds up what is covered in slabs between edges."""
    k = F.col("c_custkey")
    boxes = t(spark, d, "customer").select("c_nationkey", *_box("c_custkey", (k * 37) % 5000 + 0.5, (k * 91) % 5000 + 0.25, k % 7 * 30 + 60, k % 5 * 40 + 40))
    return S.union_per_code(boxes.withColumnRenamed("c_nationkey", "code"), "code").select("code", F.round(S.area(F.col("geometry")), 2).alias("area"))


#: Lines with one corner, as two boxes without width or height.
_BENT = "(select c_custkey as id, v.x, v.y, v.w, v.h from (select c_custkey, (c_custkey * 37) % 5000 + 0.5 as x, (c_custkey * 91) % 5000 + 0.25 as y from customer) c, lateral (values (x, y, 60, 0), (x + 60, y, 0, 400)) v(x, y, w, h))"
_BARS = "(select s_suppkey as id, (s_suppkey * 53) % 5000 as x, (s_suppkey * 71) % 5000 as y, 900 as w, 0 as h from supplier)"


def _gaps(right: str) -> str:
    return f"""
with j as (select a.id as left_id, b.id as right_id, greatest(b.x - a.x - a.w, a.x - b.x - b.w, 0) as dx, greatest(b.y - a.y - a.h, a.y - b.y - b.h, 0) as dy from {_BENT} a, {right} b)
select left_id, right_id, round(min(sqrt(dx * dx + dy * dy)), 6) as distance from j where dx * dx + dy * dy <= 2500 group by 1, 2"""


def _bent(spark, d):
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    x, y = (F.col("c_custkey") * 37) % 5000 + 0.5, (F.col("c_custkey") * 91) % 5000 + 0.25
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.array(point(x, y), point(x + 60, y), point(x + 60, y + 400))).alias("geometry"))


@query(_gaps(_B))
def geo_lines_near_polygons(spark, d):
    """Bent lines and boxes no more than 50 apart, 0 where a line enters a box or lies in it."""
    return S.geometries_within(_bent(spark, d), _boxes(spark, d)[1], 50.0, digits=6)


@query(_gaps(_BARS))
def geo_line_pairs(spark, d):
    """Bent lines and long bars no more than 50 apart."""
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    x, y = (F.col("s_suppkey") * 53) % 5000, (F.col("s_suppkey") * 71) % 5000
    bars = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.array(point(x, y), point(x + 900, y))).alias("geometry"))
    return S.geometries_within(_bent(spark, d), bars, 50.0, digits=6)
