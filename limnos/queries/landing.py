"""Sources and sinks over whole tables, written to the shared scratch folder and read back, and the reports on what was landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.functions import values as V
from limnos.operators import aggregates as A
from limnos.operators import facts as D
from limnos.operators import graph as G
from limnos.operators import relational as R
from limnos.operators import reviews as W
from limnos.operators import spatial as S
from limnos.operators import topology as H
from limnos.session import read_table as t
from limnos.session import scratch
from limnos.sources import readers as I
from limnos.sources import sinks as O

QUERIES: dict = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("select c_custkey, '''=' || c_custkey as formula, c_acctbal, null::varchar as empty, c_mktsegment from customer")
def datamart_round_trip(spark, d):
    """A data mart written and landed again: all columns text, cells that look like formulas guarded."""
    path = scratch(spark)
    O.write_datamart(t(spark, d, "customer").select("c_custkey", _text("=", F.col("c_custkey")).alias("formula"), "c_acctbal", F.lit(None).cast("string").alias("empty"), "c_mktsegment"), path)
    rows, _ = I.read_csv(spark, path)
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "formula", F.col("c_acctbal").cast("double").alias("c_acctbal"), "empty", "c_mktsegment")


@query("select case when s_suppkey % 3 = 0 then s_suppkey || ';x;y;z' end as line, 'width' as issue, count(*) as n from supplier where s_suppkey % 3 = 0 group by 1")
def csv_width_issues(spark, d):
    """Lines of another width than the header's are issues, with the line as it stands."""
    path = scratch(spark)
    key = F.col("s_suppkey")
    line = F.when(key % 3 == 0, _text(key, ";x;y;z")).otherwise(_text(key, ";x;y"))
    # one column named like the header line, so that every file begins with it and no file waits for another
    t(spark, d, "supplier").select(line.alias("A;B;C")).write.csv(path, header=True, sep="\x01", quote="", escape="")
    _, issues = I.read_csv(spark, path)
    return issues.groupBy("line", "issue").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_totalprice, o_orderstatus, null::varchar as empty from orders")
def jsonl_round_trip(spark, d):
    path = scratch(spark)
    O.write_jsonl(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(None).cast("string").alias("empty")), path)
    return I.read_jsonl(spark, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string, empty string")[0]


@query("select p_partkey, unnest(['Code', 'L''x' || p_partkey, 'odd']) as first, unnest(['Wert', p_size || ';' || p_size, null]) as second, unnest([null, null, 'width']) as issue from part")
def portal_dialect(spark, d):
    """The portal's quoting: apostrophes inside cells are literal, delimiters inside quotes too."""
    text = _text("'Code';'Wert'\r\n'L'x", F.col("p_partkey"), "';'", F.col("p_size"), ";", F.col("p_size"), "'\n'odd'\n")
    rows = t(spark, d, "part").select("p_partkey", F.explode(I.parse_portal(text)).alias("r"))
    return rows.select("p_partkey", F.get("r.row", F.lit(0)).alias("first"), F.get("r.row", F.lit(1)).alias("second"), "r.issue")


@query(r"""
select doc_id || '.csv' as path, regexp_matches(lower(left(ltrim(text), 200)), '<(!doctype|html)') as html, cast(len(l) - 1 as bigint) as rows, cast(len(list_filter(l, lambda x: contains(x, ';'))) as bigint) as odd_widths, cast(strlen(text) as bigint) as bytes, sha256(text) as sha256
from (select *, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: x <> '') as l from documents where text is not null)""")
def file_inspection(spark, d):
    """Whole texts looked at as files of one column."""
    files = t(spark, d, "documents").where("text is not null").select(_text(F.col("doc_id"), ".csv").alias("path"), F.col("text").cast("binary").alias("content"))
    return I.inspect_csv(files, [1]).select("path", "html", F.col("rows").cast("long").alias("rows"), F.col("odd_widths").cast("long").alias("odd_widths"), F.col("bytes").cast("long").alias("bytes"), "sha256")


@query("""
with f as (select 'd/' || doc_id || case when doc_id % 2 = 0 then '.CSV' else '.html' end as path, case when doc_id % 2 = 0 then 'csv' else 'html' end as adapter, text from documents where text is not null)
select path, adapter, cast(strlen(text) as bigint) as bytes, sha256(text) as sha256, min(path) over (partition by text) as canonical_path from f""")
def file_inventory(spark, d):
    """Every text as a file: its adapter, and of equal contents the least path."""
    docs, i = t(spark, d, "documents").where("text is not null"), F.col("doc_id")
    files = docs.select(F.concat(F.lit("d/"), i.cast("string"), F.when(i % 2 == 0, ".CSV").otherwise(".html")).alias("path"), F.col("text").cast("binary").alias("content"))
    return I.inventory(files).withColumn("bytes", F.col("bytes").cast("long"))


@query("select s_suppkey, 'Größe ' || s_name as text, ['a' || s_suppkey, 'b\"c', ''] as cells from supplier")
def decoded_bytes(spark, d):
    """UTF-8 with a mark, or latin-1 bytes, to text; and lines that were quoted as a whole to cells."""
    text = _text("Größe ", F.col("s_name"))
    content = F.when(F.col("s_suppkey") % 2 == 0, F.encode(F.concat(F.lit("﻿"), text), "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return t(spark, d, "supplier").select("s_suppkey", I.decoded(content).alias("text"), I.unquote_line(_text('"a', F.col("s_suppkey"), ',b""c,"'), ",").alias("cells"))


@query("select table_name, ordinal_position as position, column_name as source_name, lower(column_name) as name, column_name as long_name from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')")
def column_registry(spark, d):
    tables = {name: t(spark, d, name) for name in TABLES}
    found = [row for name, df in tables.items() for row in I.column_registry({name: df}, df.columns)]
    return spark.createDataFrame(found, "table_name string, position int, source_name string, name string, long_name string")


@query("select 's' || s_suppkey as id, cast(s_nationkey as varchar) as nation from supplier where s_nationkey <> 3")
def wfs_paging(spark, d):
    """Pages that overlap by one feature: each feature once, and only those that the filter names."""
    key = F.col("s_suppkey")
    feature = lambda k, kind: F.concat(F.lit('{"id":"s'), k.cast("string"), F.lit('","properties":{"ok":"'), kind.cast("string"), F.lit('","nation":"'), F.col("s_nationkey").cast("string"), F.lit('"},"geometry":null}'))
    own = feature(key, F.col("s_nationkey") != 3)
    pages = t(spark, d, "supplier").select(key.alias("offset"), F.concat(F.lit('{"features":['), own, F.lit(","), own, F.lit("]}")).alias("body"))
    features, _ = I.wfs_pages(pages.union(pages), 1, {"ok": "true"})
    return features.select("id", F.element_at("properties", F.lit("nation")).alias("nation"))


@query("select 'https://a.org/' || c_nationkey as url, min_by(c_name, c_custkey) as title, '10.1234/x' || max(c_nationkey) as doi, min(c_custkey) as rank from customer group by c_nationkey")
def search_hits(spark, d):
    """Hits of several services: every URL once, whatever tracking it carries, with the best hit's title."""
    c, n = t(spark, d, "customer"), F.col("c_nationkey")
    return I.search_results(c.select(_text("HTTPS://A.org/", n, "?utm_source=", F.col("c_custkey")).alias("url"), F.col("c_name").alias("title"), _text("doi:10.1234/x", n).alias("doi"), F.col("c_custkey").alias("rank")))


@query("""
select 'S' || s_nationkey as id, 'repeated id' as problem from supplier group by s_nationkey having count(*) > 1 union all select 'S' || s_nationkey, 'outside the envelope' from supplier where s_suppkey % 7 = 0
union all select 'S' || s_nationkey, 'kind' from supplier where s_suppkey % 7 = 1""")
def geojson_problems(spark, d):
    """Collections of at most a hundred features each: repeated ids, unknown kinds, and points outside the envelope."""
    key = F.col("s_suppkey")
    feature = F.concat(F.lit('{"properties":{"owk":"S'), F.col("s_nationkey").cast("string"), F.lit('"},"geometry":{"type":"'), F.when(key % 7 == 1, "Curve").otherwise("Point"), F.lit('","coordinates":['), F.when(key % 7 == 0, "99").otherwise("9"), F.lit(",1.5e0]}}"))
    groups = t(spark, d, "supplier").select(F.floor(key / 100).alias("g"), feature.alias("f")).groupBy("g").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    path = scratch(spark)
    groups.repartition("g").write.partitionBy("g").text(path)
    return I.read_geojson(spark, path, "owk", (0, 0, 10, 10))[1]


@query("""
with p as (select c_custkey, radians(47 + c_custkey % 800 / 100.0) as phi, radians(9 + c_custkey % 1100 / 100.0 - 15) as lam, 6378137.0 as a, 1 / 298.257222101 as f from customer),
q as (select *, f / (2 - f) as n, 2 * sqrt(f / (2 - f)) / (1 + f / (2 - f)) as e from p),
r as (select *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) as s from q),
u as (select *, atan2(s, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + s * s)) as eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 as a1, 13 * n * n / 48 - 3 * n * n * n / 5 as a2, 61 * n * n * n / 240 as a3, a / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) as radius from r)
select c_custkey, round(500000 + 0.9996 * radius * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 1) as x,
  round(0.9996 * radius * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 1) as y from u""")
def utm_projection(spark, d):
    k = F.col("c_custkey")
    at = S.to_utm33(9 + k % 1100 / 100.0, 47 + k % 800 / 100.0)
    return t(spark, d, "customer").select("c_custkey", F.round(at["x"], 1).alias("x"), F.round(at["y"], 1).alias("y"))


@query("select s_suppkey, s_name, case when s_suppkey % 2 = 1 then s_acctbal end as s_acctbal from supplier")
def insert_new_evolving(spark, d):
    """Only suppliers not there yet are inserted; a column that the table lacks is added, null in the old rows."""
    s = t(spark, d, "supplier")
    return R.insert_new(s.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name"), s.union(s).select("s_suppkey", "s_name", "s_acctbal"), ["s_suppkey"])


@query("select o_orderkey, case when o_orderstatus = 'P' then 'O' else o_orderstatus end as o_orderstatus, case when o_orderstatus = 'P' then null else o_totalprice end as o_totalprice from orders")
def state_reset(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.reset_state(orders, F.col("o_orderstatus") == "P", {"o_totalprice": F.lit(None).cast("double"), "o_orderstatus": F.lit("O")})


@query("select doc_id || '' as document, case when doc_id % 5 = 0 then 'missing' when doc_id % 7 = 0 then 'changed' end as problem from documents where text is not null and (doc_id % 5 = 0 or doc_id % 7 = 0)")
def verified_batch(spark, d):
    """Outputs against the manifest of their digests."""
    docs, i = t(spark, d, "documents").where("text is not null").withColumn("document", F.col("doc_id").cast("string")), F.col("doc_id")
    outputs = docs.where(i % 5 != 0).select("document", F.when(i % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return D.verified_batch(outputs, docs.select("document", F.sha2("text", 256).alias("sha256")))[1]


@query("""
select o_orderkey, 'C' || o_custkey as code, case when o_custkey % 2 = 0 then o_custkey end as body from orders where o_custkey % 3 > 0 union all select o_orderkey, 'N' || o_custkey, o_custkey from orders where o_custkey % 3 = 0""")
def either_key_lookup(spark, d):
    """A code that may stand in either of two id columns of a register; even customers have both, odd ones the second only."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    ids = c.select(k.alias("id"), F.when(k % 2 == 0, _text("C", k)).alias("first"), _text("N", k).alias("second"))
    orders = t(spark, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_custkey") % 3 == 0, "N").otherwise("C"), F.col("o_custkey").cast("string")).alias("code"))
    return R.either_key(orders, "code", ids, ["first", "second"], "id", "body")[0]


@query("select l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), '|') as lines from lineitem group by 1")
def provenance_rows(spark, d):
    return A.provenance(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", F.array_join("rows", "|").alias("lines"))


@query("""
with s as (select epoch_us(ts) as a, epoch_us(ts) + 1000000 * (1 + event_id % 7) as z from events)
select count(*) as requests, sum(z - a) / 1e6 as busy_s, (max(z) - min(a)) / 1e6 as wall_s, round(avg(z - a) / 1e6, 6) as mean_s, median(z - a) / 1e6 as median_s, round(sum(z - a) / (max(z) - min(a)), 9) as concurrency from s""")
def throughput_report(spark, d):
    """Requests that start at an event and last one to seven seconds."""
    e = t(spark, d, "events").select(F.col("ts").alias("a"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + 1_000_000 * (1 + F.col("event_id") % 7)).alias("z")).withColumn("a", F.col("a").cast("timestamp"))
    return A.throughput(e, "a", "z").withColumns({"busy_s": F.round("busy_s", 6), "mean_s": F.round("mean_s", 6), "concurrency": F.round("concurrency", 9)})


@query("""
select * from (select 'orders' as "table", (select count(distinct l_orderkey) from lineitem) as expected, (select count(*) from orders) as found union all select 'part', (select count(distinct l_partkey) from lineitem), (select count(*) from part)
union all select 'customer', (select count(distinct o_custkey) from orders), (select count(*) from customer) union all select 'nation', (select count(distinct c_nationkey) from customer), (select count(*) from nation)) where expected <> found""")
def expected_sizes(spark, d):
    """Tables whose size is not the number of their keys that another table names."""
    named = {"orders": ("lineitem", "l_orderkey"), "part": ("lineitem", "l_partkey"), "customer": ("orders", "o_custkey"), "nation": ("customer", "c_nationkey")}
    expected = {name: t(spark, d, table).agg(F.countDistinct(key)).first()[0] for name, (table, key) in named.items()}
    return A.expected_counts({name: t(spark, d, name) for name in named}, expected)


@query("""
with a as (select distinct l_suppkey as site, l_partkey as url from lineitem where l_linenumber <= 2), b as (select distinct l_suppkey as site, l_partkey as url from lineitem where l_linenumber >= 2),
f as (select coalesce(a.site, b.site) as site, count(a.url) as first, count(b.url) as second, count(b.url) - count(case when a.url = b.url then 1 end) as added, count(*) as together from a full join b on a.site = b.site and a.url = b.url group by 1),
k as (select l_suppkey as site, count(distinct l_orderkey) as archived, count(distinct case when l_returnflag = 'A' then l_orderkey end) as useful, count(distinct case when l_returnflag = 'N' then l_orderkey end) as uncertain, count(distinct case when l_returnflag = 'R' then l_orderkey end) as rejected from lineitem group by 1)
select site, first, second, added, together, archived, useful, uncertain, rejected from f join k using (site)""")
def site_overview(spark, d):
    """Suppliers as sites, parts as candidates of two passes, orders as archived originals by decision."""
    li = t(spark, d, "lineitem").withColumn("site", F.col("l_suppkey"))
    decision = F.when(F.col("l_returnflag") == "A", "relevant").when(F.col("l_returnflag") == "N", "uncertain").otherwise("irrelevant")
    passes = [li.where(c).select("site", F.col("l_partkey").alias("url")) for c in ("l_linenumber <= 2", "l_linenumber >= 2")]
    out = W.site_overview(*passes, li.select("site", F.col("l_orderkey").alias("sha256"), decision.alias("decision")))
    return out.select("site", *(F.col(c).cast("long").alias(c) for c in out.columns if c != "site"))


@query("""
select c_custkey as lake, count(distinct case when o_orderstatus = 'F' then o_orderdate end) as matched, count(distinct case when o_orderstatus = 'P' then o_orderdate end) as review, count(distinct case when o_orderstatus = 'O' then o_orderdate end) as excluded
from customer left join orders on c_custkey = o_custkey group by 1""")
def lake_documents(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "P", "review").otherwise("excluded")
    found = t(spark, d, "orders").select(F.col("o_custkey").alias("lake"), F.col("o_orderdate").alias("document"), status.alias("status"))
    return W.lake_summary(t(spark, d, "customer").select(F.col("c_custkey").alias("lake")), found)


@query("select o_orderkey as id, count(case when l_returnflag = 'A' then 1 end) as \"A\", count(case when l_returnflag = 'N' then 1 end) as \"N\", 0::bigint as \"none\" from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def layer_coverage(spark, d):
    features = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("layer"))
    return W.coverage(features, t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), ["A", "N", "none"])


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'invalid_start' when s_suppkey % 3 = 1 then 'reversed' else '' end as problems from supplier")
def time_problems(spark, d):
    k = F.col("s_suppkey")
    start = F.when(k % 3 == 0, "2001-13").when(k % 3 == 1, "2003").otherwise("2001-02")
    return t(spark, d, "supplier").select("s_suppkey", F.array_join(W.time_problems(start, F.when(k % 3 == 1, "2002").otherwise("2001-03")), "|").alias("problems"))


@query("select s_suppkey as id, 'M' || printf('%.1f', x) || ' ' || printf('%.1f', y) || ' L' || printf('%.1f', x) || ' ' || printf('%.1f', y + 50) as d from (select s_suppkey, 50.0 * (s_suppkey % 2) as x, 0.0 as y from supplier) where (select count(distinct s_suppkey % 2) from supplier) = 2")
def map_paths(spark, d):
    """One line a supplier, left or right, over the whole height of a map of 50 by 50."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit(8.0).alias("y")), F.struct(F.lit(1).alias("pos"), F.lit(0.0).alias("y")))).alias("e")
    points = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0).alias("part"), (8.0 * (F.col("s_suppkey") % 2)).alias("x"), ends)
    return O.map_paths(points.select("id", "part", "e.pos", "x", "e.y"), 50.0, 50.0)


@query("select p_partkey, 'Elbe ' || p_size as label, 'v' || p_partkey as value, 1000 + p_size as count, true as selected, 'a=x' || p_size || '|s=v' || p_partkey || '|t=two words' as fields from part")
def portal_forms(spark, d):
    """Options of a portal's select with their counts, and what the form would submit."""
    k, n = F.col("p_partkey"), F.col("p_size")
    html = _text("<form><input name=a value='x", n, "'><input type=checkbox name=b value=1><input type=submit name=c><select name=s><option value=q disabled>q<option selected value=v", k, ">Elbe ", n, " --- (1.", F.lpad(n.cast("string"), 3, "0"), " values)</select><textarea name=t>two\n words</textarea><select name=z disabled><option>no</select></form>")
    form = t(spark, d, "part").select("p_partkey", I.parse_form(html).alias("f"))
    pairs = F.array_join(F.transform("f.fields", lambda x: F.concat(x["field"], F.lit("="), x["value"])), "|")
    return form.select("p_partkey", F.explode("f.options").alias("o"), pairs.alias("fields")).select("p_partkey", "o.label", "o.value", "o.count", "o.selected", "fields")


@query("select n_name as name, round(n_nationkey / 7.0, 4) as x, case when n_nationkey % 2 = 0 then 0.25 else 0.75 end as y from nation where n_nationkey % 2 = 0 or length(n_name) >= 5")
def map_labels(spark, d):
    """Names of even nations stand alone on the map, those of odd ones inside a longer line."""
    n, k = t(spark, d, "nation"), F.col("n_nationkey")
    line = F.when(k % 2 == 0, F.concat(F.lower("n_name"), F.lit(" :"))).otherwise(F.concat(F.lit("xx "), F.col("n_name"), F.lit(" yy")))
    return I.label_positions(n.select(k.alias("pos"), line.alias("text"), (k / 7.0).alias("x"), F.when(k % 2 == 0, 0.25).otherwise(0.75).alias("y")), n.select(F.col("n_name").alias("name")))


_NODES = (G.Node("customer", "Customer", ("c_custkey",)), G.Node("nation", "Nation", ("n_nationkey",)), G.Node("region", "Region", ("n_regionkey",)))
_EDGES = (G.Edge("customer_nation", "IN", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "customer"), G.Edge("nation_region", "IN", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "nation"))


@query("""
select 'node' as part, 'Customer' as label, c_custkey || '' as key from customer union all select 'node', 'Nation', n_nationkey || '' from nation
union all select 'edge', 'IN', c_custkey || '>' || c_nationkey from customer""")
def promoted_graph(spark, d):
    """A graph checked for unique keys and whole edges, published without one label and its edges, and read back."""
    tables = {"customer": t(spark, d, "customer").select("c_custkey", "c_nationkey"), "nation": t(spark, d, "nation").select("n_nationkey", "n_regionkey")}
    tables["region"] = tables["nation"].select("n_regionkey").distinct()
    nodes, edges = G.drop_labels(G.nodes(tables, _NODES), G.edges(tables, _EDGES), ["Region"])
    path = scratch(spark)
    G.promote(spark, nodes, edges, path)
    nodes, edges = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges"))
    return nodes.select(F.lit("node").alias("part"), "label", "key").union(edges.select(F.lit("edge"), "type", F.concat("start_key", F.lit(">"), "end_key")))


@query("select label || '' as label, key || '' as key, n from (select 'Nation' as label, n_regionkey as key, count(*) as n from nation group by 2) where n > 1")
def repeated_node_keys(spark, d):
    return G.repeated_keys(t(spark, d, "nation").select(F.lit("Nation").alias("label"), F.col("n_regionkey").cast("string").alias("key")))


@query("""
select event_type as name, case when event_type = 'click' then '' else event_type end as code, count(*) as n, row_number() over (order by event_type = 'click', count(*) desc, event_type) as place from events group by 1""")
def event_frequency(spark, d):
    """Names by frequency, those without a code last."""
    names = t(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return A.frequency_table(names.withColumn("code", F.when(F.col("name") == "click", "").otherwise(F.col("name"))), "name", "code", "n", "place")


@query("select o_orderpriority as class, count(*) as n, count(case when o_orderstatus = 'P' then 1 end) as for_review from orders group by 1")
def manifest_counters(spark, d):
    """Rows and rows for review by class, as a run's manifest states them."""
    return A.manifest_counters(t(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "P").withColumnRenamed("o_orderpriority", "class")


@query("select s_suppkey, 'N ' || s_name as name, s_nationkey || ' km' as area from supplier")
def infobox_cells(spark, d):
    html = _text("<table><tr><th>Name</th><td>N <b>", F.col("s_name"), "</b></td></tr>\n<tr class=x><th> <i>Fläche</i></th><td>", F.col("s_nationkey"), "\n km</td></tr></table>")
    box = I.infobox(html)
    return t(spark, d, "supplier").select("s_suppkey", box["Name"].alias("name"), box["Fläche"].alias("area"))


@query("""
with r as (select n_nationkey as pos, lower(n_name) as key, 'g' || n_nationkey as gkz from nation), q as (select c_custkey, 'River ' || n_name as name, lower('River ' || n_name) as key from customer join nation on c_nationkey = n_nationkey)
select distinct q.name, (select min_by(r.gkz, r.pos) from r where contains(q.key, r.key)) as gkz from q""")
def river_codes(spark, d):
    """Codes of names that hold a name of the register."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("key"), _text("g", F.col("n_nationkey")).alias("gkz"), "n_name", "n_nationkey")
    names = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("River "), "n_name").alias("name"))
    return H.code_of_name(names, n.select("pos", "key", "gkz"))


@query("""
with b as (select doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w from documents where text is not null),
h as (select word as job, doc_id as block_id, 1 as hits from b, (values ('the'), ('of'), ('and')) v(word) where list_contains(w, word) and doc_id % 2 = 1)
select job, block_id, cast(hits as bigint) as hits, cast(row_number() over (partition by job order by block_id) as int) as rank from h qualify rank <= 4""")
def context_blocks(spark, d):
    """For each of three words the first four documents that hold it, those already supplied left out."""
    docs = t(spark, d, "documents").where("text is not null")
    jobs = spark.createDataFrame([(w, [w.upper()]) for w in ("the", "of", "and")], "job string, terms array<string>")
    supplied = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("block_id")).join(F.broadcast(jobs.select("job")))
    return D.context_blocks(jobs, docs.select(F.col("doc_id").alias("block_id"), "text"), supplied)


@query("select c_custkey, lower(c_name) as folded, upper(c_mktsegment) || '|' || c_custkey as name, '' as none, 4.0::double as wait from customer")
def folded_names(spark, d):
    """Compatibility and accent folding, and settings of a run in which the last value of a key counts."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    entries = F.array(*(F.struct(F.lit(a).alias("key"), b.alias("value")) for a, b in (("n", F.lit("x")), ("n", F.concat(F.upper("c_mktsegment"), F.lit("|"), k.cast("string"))))))
    return c.select("c_custkey", T.accent_fold(T.compatibility_fold("c_name")).alias("folded"), V.last_by_key(entries)["n"].alias("name"), T.clip(F.lit(None).cast("string"), 3).alias("none"), V.backoff_seconds(F.lit(2)).alias("wait"))
