"""Texts, blocks, facts, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import text as T
from limnos.functions import values as V
from limnos.operators import aggregates as A
from limnos.operators import crawl as C
from limnos.operators import facts as D
from limnos.operators import sequences as Q
from limnos.session import read_table as t

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(r"select doc_id, length(text) as chars, cast(ceil(octet_length(encode(text)) / 3.0) as bigint) as estimate, sha256(text) as sha, left(text, 160) as clipped, len(string_split(text, chr(10))) as lines from documents")
def text_profile(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", F.length(c).cast("long").alias("chars"), V.token_estimate(c).alias("estimate"), F.sha2(c, 256).alias("sha"), T.clip(c, 160).alias("clipped"), F.size(F.split(c, "\n")).cast("long").alias("lines"))


@query(r"""
select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) as host,
  regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1)
  || case when array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_')), '&') = '' then '' else '?' || array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_')), '&') end as canonical from pages""")
def url_canonical(spark, d):
    return t(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"), C.canonical_url(F.col("url")).alias("canonical"))


@query(r"""
select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as links, array_to_string(list_slice(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1, 3), ' ') as first_links from pages""")
def html_title_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"), F.array_join(F.slice(links, 1, 3), " ").alias("first_links"))


@query("select token, count(*) as n, min(doc_id) as first from (select doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) as token from documents) group by 1 having count(*) >= 20")
def explode_mentions(spark, d):
    tokens = t(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n >= 20")


@query("select doc_id, first_value(doc_id) over (partition by source, text order by doc_id) as canonical_id from documents")
def statement_dedup(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "text").withColumn("o", F.col("doc_id"))
    return Q.first_of_equal(docs, ["source"], "text", "o", "doc_id").select("doc_id", "canonical_id")


@query("select min(doc_id) as doc_id, count(*) as merged, string_agg(cast(doc_id as varchar), ',' order by doc_id) as evidence from documents group by text, lang")
def semantic_dedup(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "text", "lang", F.array(F.col("doc_id")).alias("evidence"), F.col("doc_id").alias("o"))
    merged, _ = D.merge_facts(docs, "event_id", "o")
    return merged.select(F.col("event_id").alias("doc_id"), "merged", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


@query("select string_agg(cast(doc_id as varchar), ',' order by doc_id) as ids from documents group by lang, source, length(text) // 50 having count(*) > 1")
def possible_duplicates(spark, d):
    docs = t(spark, d, "documents").withColumn("bucket", F.floor(F.length("text") / 50))
    return A.possible_duplicates(docs, ["lang", "source", "bucket"], "doc_id").select(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("select * from (select doc_id, lang, source, length(text) // 50 as bucket, count(*) over (partition by lang, source, length(text) // 50) as n from documents) where n > 1")
def possible_duplicate_rows(spark, d):
    """As possible_duplicates, whose SQL asks for a list a group, with a row for each document."""
    docs = t(spark, d, "documents").withColumn("bucket", F.floor(F.length("text") / 50))
    return A.duplicate_rows(docs, ["lang", "source", "bucket"], "doc_id")


@query("""
with q as (select doc_id as id, doc_id as block, text as quote from documents union all select doc_id, doc_id + 1, text from documents),
n as (select q.id, trim(regexp_replace(q.quote, '\\s+', ' ', 'g')) as quote, d.doc_id as known, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) as text from q left join documents d on d.doc_id = q.block)
select distinct id, case when known is null then 'unknown block' else 'quote not in block' end as problem from n where known is null or not contains(text, quote)""")
def quote_containment(spark, d):
    """Whole texts as quotes, of their own block and of the next."""
    docs, quote = t(spark, d, "documents"), F.col("text")
    facts = docs.select(F.col("doc_id").alias("id"), F.array(F.struct(F.col("doc_id").alias("block_id"), quote.alias("quote")), F.struct((F.col("doc_id") + 1).alias("block_id"), quote.alias("quote"))).alias("evidence"))
    return D.evidence_problems(facts, docs.select(F.col("doc_id").alias("block_id"), "text"))


@query(r"""
with l as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as lines from documents),
n as (select *, len(list_filter(lines, lambda x: regexp_matches(x, '\(\s*\d{4}[a-z]?\s*\)'))) as years, len(list_filter(lines, lambda x: regexp_matches(x, '\.{4,}\s*\d{1,4}\s*$'))) as leaders from l)
select doc_id, case when len(lines) = 0 then 'noise' when leaders >= 2 or (leaders > 0 and leaders / len(lines) >= 0.4) then 'toc'
  when regexp_matches(trim(lines[1]), '(?i)^(Abb\.?|Abbildung|Tab\.?|Tabelle|Foto|Karte|Fig\.?)\s*\d') and length(text) < 300 then 'caption'
  when (years >= 3 and years / len(lines) >= 0.3) or (years >= 2 and regexp_matches(text, '\b(Hrsg|Verlag|In:|S\.\s*\d+\s*[–-]\s*\d+|ISBN)\b')) then 'bibliography' when length(trim(text)) < 15 then 'noise' else 'content' end as class from n""")
def block_classify(spark, d):
    return t(spark, d, "documents").select("doc_id", D.block_class(F.col("text")).alias("class"))


@query("""
with recursive b as (select source as doc, doc_id as pos, length(text) as n, row_number() over (partition by source order by doc_id) as r from documents),
g(doc, pos, r, total, chunk) as (select doc, pos, r, n, 0 from b where r = 1
  union all select b.doc, b.pos, b.r, case when g.total + b.n <= 10000 then g.total + b.n else b.n end, case when g.total + b.n <= 10000 then g.chunk else g.chunk + 1 end from g join b on b.doc = g.doc and b.r = g.r + 1)
select doc, cast(chunk as bigint) as chunk, count(*) as blocks, min(pos) as first, max(pos) as last from g group by 1, 2""")
def chunk_greedy(spark, d):
    blocks = t(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("block_id"), F.lit(1).alias("page"), "text")
    return D.chunks(blocks).select("doc", "chunk", F.size("blocks").cast("long").alias("blocks"), F.array_min(F.transform("blocks", lambda b: b["pos"])).alias("first"), F.array_max(F.transform("blocks", lambda b: b["pos"])).alias("last"))


@query("""
select conv_id, turn, case when length(lag(text) over w) <= 100 then lag(text) over w end as previous, case when length(lead(text) over w) <= 100 then lead(text) over w end as next from conversations window w as (partition by conv_id order by turn)""")
def neighbour_context(spark, d):
    return Q.neighbours(t(spark, d, "conversations").dropDuplicates(["conv_id", "turn"]), ["conv_id"], "turn", "text", 100).select("conv_id", "turn", "previous", "next")


@query("""
select conv_id, turn, last_value(case when role = 'user' then left(text, 20) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as section from conversations""")
def running_heading(spark, d):
    c = t(spark, d, "conversations").withColumn("h", F.when(F.col("role") == "user", F.left("text", F.lit(20))))
    return Q.running_heading(c, ["conv_id"], "turn", "h").select("conv_id", "turn", "section")


@query("""
with e as (select distinct user_id, cast(date_diff('hour', timestamp '2000-01-01', date_trunc('hour', ts)) as bigint) as h from events), r as (select *, h - row_number() over (partition by user_id order by h) as k from e)
select user_id, min(h) as first, max(h) as last, count(*) as n from r group by user_id, k""")
def gaps_islands(spark, d):
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 946684800) / 3600).alias("h")
    return Q.islands(t(spark, d, "events").select("user_id", hour), ["user_id"], "h")


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as recent from events")
def sliding_rate(spark, d):
    return Q.sliding_count(t(spark, d, "events"), ["user_id"], "ts", 3600).select("event_id", "recent")


@query("""
with g as (select user_id, event_id, case when value > 40 then 1 else 0 end as gain from events)
select event_id, count(*) over w = 3 and max(abs(gain)) over w = 0 as plateau from g window w as (partition by user_id order by event_id rows between 2 preceding and current row)""")
def plateau(spark, d):
    e = t(spark, d, "events").withColumn("gain", F.when(F.col("value") > 40, 1).otherwise(0))
    return Q.plateaus(e, ["user_id"], "event_id", "gain", 3).select("event_id", "plateau")


@query("""
with h as (select date_trunc('hour', ts) as slot, count(*) as n, count(*) filter (where event_type = 'error') as failed from events group by 1), s as (select unnest(generate_series((select min(slot) from h), (select max(slot) from h), interval 1 hour)) as slot)
select cast(s.slot as timestamp) as slot, coalesce(n, 0) as n, coalesce(failed, 0) as failed from s left join h using (slot)""")
def minute_spine(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return A.minute_report(e, "ts", {"failed": F.count_if(F.col("event_type") == "error")}, "hour").withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query("""
with f as (select user_id, event_id, case when value < 30 then 1 else 0 end as bad from events), s as (select *, sum(1 - bad) over (partition by user_id order by event_id) as k from f)
select event_id, cast(sum(bad) over (partition by user_id, k order by event_id) as bigint) as streak from s""")
def failure_streaks(spark, d):
    return Q.failure_streaks(t(spark, d, "events"), ["user_id"], "event_id", F.col("value") < 30).select("event_id", "streak")


@query(r"""
with l as (select source, doc_id, unnest(list_distinct(string_split(text, chr(10)))) as line from documents), o as (select source, line from l group by 1, 2 having count(distinct doc_id) >= 3)
select doc_id, count(*) as lines, count(o.line) as margins from l left join o on o.source = l.source and o.line = l.line group by 1""")
def margin_lines(spark, d):
    lines = t(spark, d, "documents").select("source", "doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    return Q.repeated_lines(lines, ["source"], "doc_id", "line").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("margin").alias("margins"))


@query("""
select conv_id, turn, cast(sum(case when role = p then 0 else 1 end) over (partition by conv_id order by turn) as bigint) as table_group from (select *, coalesce(lag(role) over (partition by conv_id order by turn), '') as p from conversations)""")
def table_continuation(spark, d):
    return Q.continued_groups(t(spark, d, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "table_group")


@query("""
with a as (select lang || '/' || (doc_id % 50) as k, count(*) as n from documents where doc_id % 2 = 0 group by 1), b as (select lang || '/' || (doc_id % 40) as k, count(*) as n from documents where doc_id % 2 = 1 group by 1)
select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as n_fine, coalesce(b.n, 0) as n_coarse, case when b.n is null then 'only_fine' when a.n is null then 'only_coarse' when a.n = 1 and b.n = 1 then 'matched' else 'ambiguous' end as status from a full join b on a.k = b.k""")
def compare_variants(spark, d):
    """Every document is on one side."""
    docs, coarse = t(spark, d, "documents"), "doc_id % 2 = 1"
    key = lambda n: F.concat("lang", F.lit("/"), (F.col("doc_id") % n).cast("string")).alias("k")
    return D.compare_variants(docs.where("doc_id % 2 = 0").select(key(50)), docs.where(coarse).select(key(40)), "k")


@query("""
with w as (select doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 as a, (length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7 as b, (length(lower(text)) - length(replace(lower(text), 'and', ''))) // 3 as c from documents)
select doc_id as id, (a > 0)::int + (b > 0)::int + (c > 0)::int as distinct_terms, cast(a + b + c as bigint) as hits, case when (a > 0)::int + (b > 0)::int + (c > 0)::int = 0 then 'none' when (a > 0)::int + (b > 0)::int + (c > 0)::int <= 2 then 'few' else 'many' end as bucket from w""")
def term_statistics(spark, d):
    return A.term_statistics(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["the", "license", "and"])


@query("select field, count(*) filter (where ok) as filled, count(*) as rows from (select 'toxic' as field, toxic = 1 as ok from labels union all select 'quality', quality = 1 from labels) group by 1")
def fill_rates(spark, d):
    return A.fill_rates(t(spark, d, "labels"), {"toxic": F.col("toxic") == 1, "quality": F.col("quality") == 1})


@query()
def page_parse(spark, d):
    """Title, links and visible text with a tolerant HTML parser; tests compare on small pages."""
    from limnos.sources.readers import parse_page

    return t(spark, d, "pages").select("page_id", parse_page("html").alias("p")).select("page_id", "p.title", F.size("p.links").alias("links"), F.length("p.text").alias("text_chars"))


@query(r"""
with recursive d as (select doc_id as doc, coalesce(text, '') as t from documents), p as (select doc, t, regexp_split_to_array(t, '(?i)\bwith\b') as parts from d),
m as (select doc, t, cast(list_sum(list_transform(parts[1 : i], lambda x: length(x))) as bigint) + 4 * (i - 1) as s from (select *, unnest(range(1, len(parts))) as i from p)),
b as (select *, greatest(0, s - 240) as low, least(length(t), s + 544) as high from m),
w as (select doc, s, t, case when low = 0 or strpos(reverse(left(t, low)), ' ') = 0 then 0 else low - strpos(reverse(left(t, low)), ' ') + 1 end as a, case when high = length(t) or strpos(substr(t, high + 1), ' ') = 0 then length(t) else high + strpos(substr(t, high + 1), ' ') - 1 end as z from b),
q as (select doc, s, a, substr(t, a + 1, z - a) as text, trim(regexp_replace(replace(lower(trim(substr(t, a + 1, z - a))), 'ß', 'ss'), '\s+', ' ', 'g'), ' .,;:') as norm from w),
c as (select doc, s, a, text, 3 + cast(regexp_matches(norm, '(^|[^\p{L}\p{N}_])and($|[^\p{L}\p{N}_])') as int) + cast(regexp_matches(norm, '(^|[^\p{L}\p{N}_])mit($|[^\p{L}\p{N}_])') as int) as score from q qualify row_number() over (partition by doc, norm order by s) = 1
  union all select doc, 0, 0, left(t, 1000), 0 from d where trim(t) <> ''),
o as (select *, row_number() over (partition by doc order by score desc, a, s) as k from c),
f(doc, k, used, places, taken, a, text) as (select doc, 0, 0, cast([] as bigint[]), false, cast(0 as bigint), '' from d
  union all select o.doc, o.k, case when ok then used + length(o.text) else used end, case when ok then list_append(places, o.a) else places end, ok, o.a, o.text
  from (select f.doc, f.k, f.used, f.places, f.used + length(o.text) <= 12000 and len(f.places) < 30 and len(list_filter(f.places, lambda x: abs(x - o.a) < 300)) = 0 as ok from f join o on o.doc = f.doc and o.k = f.k + 1) g join o on o.doc = g.doc and o.k = g.k + 1)
select doc, 'e' || len(places) as evidence_id, cast(a as int) as "offset", text from f where taken""")
def evidence_passages(spark, d):
    """Passages around a name in every document, the best first, spaced and up to a size."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("number"), F.lit("text").alias("locator"), "text")
    return C.passages(docs, ["with"], ["and", "mit"]).select("doc", "evidence_id", "offset", "text")
