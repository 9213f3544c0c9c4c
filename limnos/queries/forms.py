"""Number, text, date and collection forms, references, links and research bookkeeping over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.functions import values as V
from limnos.operators import crawl as C
from limnos.operators import facts as D
from limnos.operators import graph as G
from limnos.session import read_table as t

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("""
select c_custkey, c_custkey + 0.5::double as grouped, null::double as not_grouped, '>=' as operator, c_custkey + 0.25::double as value, 'mg/l' as unit,
  case when c_custkey % 3 = 1 then 12.5::double end as dbf, case when c_custkey % 3 = 0 then 'overflow' when c_custkey % 3 = 2 then 'malformed' end as issue,
  case when c_nationkey <> 0 then c_acctbal / c_nationkey end as ratio, c_acctbal / 100.0 as km2, c_acctbal / 1000000.0 as from_m2, greatest(0.0, least(100.0, c_acctbal)) as clamped,
  least(60.0, pow(2.0, c_nationkey)) as wait, cast(trunc(c_acctbal) as bigint) as whole from customer""")
def number_forms(spark, d):
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    field = F.when(k % 3 == 0, "****").when(k % 3 == 1, " 12.5 ").otherwise("1a2")
    quantity, dbf = V.quantity(_text(" >= ", k, ",25  mg/l ")), V.dbf_number(field)
    return c.select(
        k, V.grouped_number(_text(k, ",5")).alias("grouped"), V.grouped_number(_text("1.2.", k, "x")).alias("not_grouped"), quantity["operator"].alias("operator"), quantity["value"].alias("value"), quantity["unit"].alias("unit"),
        dbf["value"].alias("dbf"), dbf["issue"].alias("issue"), V.safe_ratio(F.col("c_acctbal"), F.col("c_nationkey")).alias("ratio"), V.hectares_to_km2(F.col("c_acctbal")).alias("km2"), V.m2_to_km2(F.col("c_acctbal")).alias("from_m2"),
        V.clamp(F.col("c_acctbal"), 0.0, 100.0).alias("clamped"), V.backoff_seconds(F.col("c_nationkey")).alias("wait"), V.integer(F.col("c_acctbal").cast("string")).alias("whole"),
    )


@query(r"""
select p_partkey, trim('strasse ae ' || regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as ascii, p_brand as core, 'XDE' || p_partkey || 'OW' || p_size || '-7' as short, '568' || p_partkey as gkz,
  trim(regexp_replace('Gewässer ' || p_name, '\s+', ' ', 'g')) as quoted, p_name || ' (b' || p_size || ')|' || p_name || '  |b' || p_size as variants, left(upper(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')), 3) as tag, 'S' || p_size as numbered,
  replace(replace(replace(format('{:,.2f}', p_retailprice), ',', '#'), '.', ','), '#', '.') as german, 1000 + p_partkey % 1000 as options, sha256('{"c0":"' || p_brand || '","c1":' || p_size || '}') as id, left(p_name, 5) as clipped from part""")
def text_forms(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    name, size = F.col("p_name"), F.col("p_size")
    return p.select(
        k, T.ascii_tokens(_text("'Straße Ä ", name, "'")).alias("ascii"), T.waterbody_core(_text("DE_LW_", F.col("p_brand"))).alias("core"), T.short_code(_text("xde", k, "ow", size, "-7z")).alias("short"), T.code_norm(_text(" 56.8 ", k), "gkz").alias("gkz"),
        T.quote_norm(_text("Gewäs-\nser ", name)).alias("quoted"), F.array_join(T.name_variants(_text(name, " (b", size, ")")), "|").alias("variants"), T.label_tag(F.col("p_brand"), size).alias("tag"), T.label_tag(size.cast("string"), size).alias("numbered"),
        T.german_number(F.col("p_retailprice")).alias("german"), T.option_count(_text("Elbe --- (1.", F.lpad((k % 1000).cast("string"), 3, "0"), " values)")).alias("options"), T.stable_id(F.col("p_brand"), size).alias("id"), T.clip(name, 5).alias("clipped"),
    )


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, cast(o_orderdate as date) as stated, year(o_orderdate) >= 2000 as historical, false as month_13, true as month_ok from orders""")
def date_forms(spark, d):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    year = F.date_format("o_orderdate", "yyyy")
    return t(spark, d, "orders").select(
        "o_orderkey", V.german_date(day).alias("iso"), V.reference_date(_text("x, Stand: ", day, " y")).alias("stated"), V.historical_path(_text("a/", year, "/b")).alias("historical"), V.partial_date_valid(_text(year, "-13")).alias("month_13"), V.partial_date_valid(F.date_format("o_orderdate", "yyyy-MM")).alias("month_ok")
    )


@query("""
select event_id, case when user_id = event_id % 5 then user_id || '' else array_to_string(list_sort([user_id || '', (event_id % 5) || '']), '|') end as members, coalesce(case when event_id % 2 = 0 then 'a' end, case when event_id % 3 = 0 then 'b' end) as first,
  case when event_id % 2 = 0 then 'own' else 'default' end as merged, 'late' as last, event_id % 2 = 0 as has_own, case when event_id % 3 = 0 then '''=x' else 'x' end as cell from events""")
def collection_forms(spark, d):
    e, i, u = t(spark, d, "events"), F.col("event_id"), F.col("user_id")
    own = F.map_from_arrays(F.array(F.lit("k"), F.lit("z")), F.array(F.when(i % 2 == 0, F.lit("own")), F.lit("1")))
    own = V.clean_properties(own)
    merged = V.merged_config(F.create_map(F.lit("k"), F.lit("default")), own)
    entries = F.array(*(F.struct(F.lit("k").alias("key"), F.lit(v).alias("value")) for v in ("early", "late")))
    return e.select(
        "event_id", V.join_set(V.split_set(_text(u, "||", i % 5, "|", u))).alias("members"), V.first_present(F.array(F.when(i % 2 == 0, "a"), F.when(i % 3 == 0, "b"))).alias("first"), merged["k"].alias("merged"), V.last_by_key(entries)["k"].alias("last"),
        F.map_contains_key(own, F.lit("k")).alias("has_own"), V.csv_guard(F.when(i % 3 == 0, "=x").otherwise("x")).alias("cell"),
    )


@query("""
select o_orderkey as chunk_id, o_orderkey || ':1' as a, o_orderkey || ':2' as b, true as resolved from orders where o_orderkey in (select l_orderkey from lineitem where l_linenumber = 1) and o_orderkey in (select l_orderkey from lineitem where l_linenumber = 2)
union all select o_orderkey, '1', o_orderkey || ':2', false from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 1) or o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 2)""")
def reference_resolution(spark, d):
    """Local numbers of lines, and lines named outright, to global ids; orders that lack one are unresolved."""
    items = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    size = items.count()
    keys = items.repartition(max(1, -(-size // D.IDS)), "l_orderkey", "l_linenumber").distinct()
    ids = keys.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").cast("string").alias("local_id"), _text(F.col("l_orderkey"), ":", F.col("l_linenumber")).alias("global_id"))
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.lit("1").alias("a"), _text(F.col("o_orderkey"), ":2").alias("b"))
    good, bad = D.resolve_references(rows, ids, ["a", "b"], size)
    return good.withColumn("resolved", F.lit(True)).unionByName(bad.withColumn("resolved", F.lit(False)))


_HIT = "45 + 20 * (page_id % 2 = 0)::int + 15 * (page_id % 3 = 0)::int + 10 * (page_id % 5 = 0)::int - least(page_id % 11, 7)"


@query(f"""
select page_id, cast(case when page_id % 7 = 0 then 5 else greatest(30, least(95, {_HIT})) end as bigint) as hit,
  cast(case when page_id % 13 = 0 and page_id % 2 = 1 then 0 when page_id % 17 = 0 then 5 when page_id % 19 = 0 then 0 when page_id % 2 = 1 and page_id % 23 = 0 and page_id % 3 > 0 then 12
    else least(95, 8 + 42 * (page_id % 2 = 0)::int + 20 * (page_id % 4 = 0)::int + 22 * (page_id % 3 = 0)::int + 10 * (page_id % 5 = 0)::int + 18 * (page_id % 3 = 0 and page_id % 5 = 0)::int) end as bigint) as link from pages""")
def link_scores(spark, d):
    """Scores of hits and links whose parts follow from the page's id: name, document word, host, rank, search form, navigation, other lake."""
    i = F.col("page_id")
    some = lambda n, word: F.when(i % n == 0, word).otherwise("")
    title = _text("x ", some(2, "Salzsee"), " ", some(3, "Änhang B"), " y")
    url = F.concat(F.lit("https://"), F.when(i % 5 == 0, "www.lfu.de").otherwise("a.org"), F.when(i % 7 == 0, "/search?q=1").otherwise("/p"))
    label = _text(title, " ", some(17, "Ostsee"), " ", some(19, "Impressum"), " ", some(23, "Westsee"))
    hit = C.hit_priority(url, title, i % 11, ["Salzsee"], ["lfu.de"])
    link = C.link_priority(F.lit("https://a.org/p"), label, some(4, "Phosphor"), i % 13 == 0, i % 5 == 0, ["Salzsee"], ["Phosphor"], ["Ostsee"])
    return t(spark, d, "pages").select("page_id", hit.cast("long").alias("hit"), link.cast("long").alias("link"))


@query("select user_id as batch, bool_or(event_type = 'click' or value > 90) as plausible from events group by 1")
def plausible_batches(spark, d):
    e = t(spark, d, "events")
    return C.plausible_batches(e.select(F.col("user_id").alias("batch"), (F.col("event_type") == "click").alias("name_hit"), F.when(F.col("value") > 90, True).alias("topic_hit")))


@query("select event_type as host, max(user_id) as next_allowed from events group by 1")
def shared_cache(spark, d):
    return C.shared_cache(t(spark, d, "events").select(F.col("event_type").alias("host"), F.col("user_id").alias("next_allowed")))


@query("select o_orderkey as id, o_custkey as profile from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') and o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def allowed_tasks(spark, d):
    blocked = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    permitted = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("profile"))
    return C.allowed_tasks(t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("profile")), blocked, permitted)


@query("select c_name as profile, o_orderkey, o_totalprice from orders join customer on c_custkey = o_custkey")
def replayed_responses(spark, d):
    ids = t(spark, d, "customer").select(F.col("c_custkey").alias("old_profile"), F.col("c_name").alias("new_profile"))
    return C.replay(t(spark, d, "orders").select(F.col("o_custkey").alias("profile"), "o_orderkey", "o_totalprice"), ids)


@query("""
select o_custkey as profile, o_orderkey as url, case when o_orderstatus = 'O' then 'unread' when o_orderpriority = '1-URGENT' then 'accepted' when o_orderpriority = '2-HIGH' then 'to_check' else 'rejected' end as bucket from orders""")
def research_buckets(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("profile"), F.col("o_orderkey").alias("url"), "o_orderstatus", "o_orderpriority")
    decision = F.when(F.col("o_orderpriority") == "1-URGENT", "relevant").when(F.col("o_orderpriority") == "2-HIGH", "uncertain").otherwise("irrelevant")
    return C.research_export(orders.select("profile", "url"), orders.where("o_orderstatus <> 'O'").select("profile", "url", decision.alias("decision"))).select("profile", "url", "bucket")


@query("""
with n as (select s_name as name, s_suppkey as code, s_nationkey as region, 'B' || s_suppkey || ' (alias ' || s_nationkey || ')' as whole from supplier)
select 'S_' || code as id, 'B' || code as name, whole || '|B' || code || '  |alias ' || region as aliases, case when code % 2 = 0 then 'S ' || code || '|X' || code else 'S ' || code end as identifiers, region, false as identity_requires_confirmation from n""")
def research_profiles(spark, d):
    s, k = t(spark, d, "supplier"), F.col("s_suppkey")
    register = s.select(_text("S ", k).alias("code"), _text("B", k, " (alias ", F.col("s_nationkey"), ")").alias("name"), F.col("s_nationkey").alias("region"))
    codes = s.where(k % 2 == 0).select(_text("S ", k).alias("code"), _text("X", k).alias("other_code"))
    return C.profiles(register, codes).select("id", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join("identifiers", "|").alias("identifiers"), "region", "identity_requires_confirmation")


@query("""
select event_id, list_aggregate(list_distinct([user_id % 3, event_id % 2]), 'count') as n, 'https://a.org/' || event_id || '|https://doi.org/10.1234/x' || user_id as links from events""")
def links_in_text(spark, d):
    text = _text("see https://a.org/", F.col("event_id"), ", doi 10.1234/x", F.col("user_id"), ". and https://a.org/", F.col("event_id"), ".")
    return t(spark, d, "events").select("event_id", F.size(F.array_distinct(F.array(F.col("user_id") % 3, F.col("event_id") % 2))).cast("long").alias("n"), F.array_join(C.links_of_text(text), "|").alias("links"))


@query("""
with recursive w(class, ancestor, depth) as (select p_partkey, p_partkey // 2, 1 from part where p_partkey // 2 > 0 union all select class, ancestor // 2, depth + 1 from w where ancestor // 2 > 0)
select class, ancestor, depth from w""")
def closure_of_parts(spark, d):
    """All ancestors of every part, a part's parent being the one of half its key."""
    half = F.floor(F.col("p_partkey") / 2)
    return G.ancestors(t(spark, d, "part").select(F.col("p_partkey").alias("class"), F.when(half > 0, half).alias("parent")))
