"""Driver queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from limnos.session import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.tokens import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.decontam import contamination_report

    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.html_extract import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.ngram_join import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.url_filter import judge

    return judge(read_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.suffix_dedup import repeat_report

    return repeat_report(read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.license_scan import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.quality import quality_report

    return quality_report(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.exact_dedup import exact_dedup

    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.collocations import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from limnos.llm.conversation_trie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_html_extraction, op4_toxicity, op5_ngram_jaccard_join, op6_url_filter, op7_suffix_dedup, op8_license_scan, op9_quality_rules, op10_packing, op11_exact_dedup, op12_collocations, op13_conversation_trie, pipeline)}


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Words compared as strings, windows as joined strings.
_OP2 = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS.format(text="coalesce(text, '')")} as w from benchmark where item_id is not null),
bw as (select distinct item, least(10, len(w)) as m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win from (select item, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from b where len(w) > 0)),
sizes as (select distinct m from bw),
dw as (select r, m, i, array_to_string(w[i : i + m - 1], ' ') as win from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)),
hit as (select distinct dw.r, dw.m, dw.i, bw.item from dw join bw on bw.m = dw.m and bw.win = dw.win),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + m)) as p from (select distinct r, m, i from hit)) group by r),
named as (select r, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select d.doc_id, len(d.w) as n_words, coalesce(c.n, 0) as n_hit, coalesce(n.n, 0) as n_items, sha256(coalesce(n.items, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from d left join covered c using (r) left join named n using (r)"""

#: Exact Jaccard over all pairs that share a shingle, then components by least label.
_OP5 = f"""
with recursive d as (select row_number() over () as r, doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
s as (select distinct r, array_to_string(w[i : i + 4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5) union all select r, array_to_string(w, ' ') || '|' from d where len(w) between 1 and 4),
k as (select r, count(*) as n, string_agg(g, chr(10) order by g) as whole from s group by r),
c as (select min(r) as c, count(*) as copies, min(n) as n, whole from k group by whole), m as (select k.r, c.c, c.copies, c.n from k join c using (whole)),
cs as (select s.r as c, s.g from s join (select c from c) x on x.c = s.r), j as (select a.c as a, b.c as b, count(*) as shared from cs a join cs b on a.g = b.g and a.c <> b.c group by 1, 2),
l as (select a, b from j join c x on x.c = j.a join c y on y.c = j.b where shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
walk(c, root) as (select c, c from c union select l.b, walk.root from walk join l on l.a = walk.c), roots as (select c, min(root) as root from walk group by c),
near as (select l.a as c, sum(copies) as links from l join c on c.c = l.b group by 1),
ids as (select root, min(doc_id) as class_id from m join roots using (c) join d using (r) group by root)
select d.doc_id, case when m.r is null then d.doc_id else ids.class_id end as class_id, cast(coalesce(m.copies - 1, 0) + coalesce(near.links, 0) as bigint) as n_links
from d left join m using (r) left join near on near.c = m.c left join roots on roots.c = m.c left join ids on ids.root = roots.root"""


#: Grouped by the normalised texts themselves.
_OP11 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as normal from documents),
k as (select *, count(*) over (partition by normal) as n, row_number() over w as place, first_value(doc_id) over w as keep_id from d window w as (partition by normal order by length(text) desc, doc_id nulls last, r desc))
select doc_id, keep_id, n as group_size, place = 1 as kept, sha256(normal) as text_sha256 from k"""


#: Words with the two after them, products in 128 bits.
_OP12 = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, row_number() over () as r, regexp_extract_all(p, '[^\x20\x09]+') as w from p), u as (select lang, r, unnest(w) as a, generate_subscripts(w, 1) as i from w),
t as (select lang, a, lead(a, 1) over o as b, lead(a, 2) over o as c from u window o as (partition by r order by i)),
g as (select lang, 1 as m, a as phrase, count(*) as c from t group by all union all select lang, 2, a || ' ' || b, count(*) from t where b is not null group by all union all select lang, 3, a || ' ' || b || ' ' || c, count(*) from t where c is not null group by all),
n as (select lang, cast(sum(c) as bigint) as n from g where m = 1 group by lang), cand as (select *, string_split(phrase, ' ') as ws from g where m >= 2 and c >= 10),
inside as (select lang, array_to_string(ws[i : i + 1], ' ') as phrase, max(c) as longest from cand, (values (1), (2)) v(i) where m = 3 group by all),
cuts as (select cand.lang, cand.phrase, c as a, k, array_to_string(ws[1 : k], ' ') as head, array_to_string(ws[k + 1 : m], ' ') as tail from cand left join inside using (lang, phrase), (values (1), (2)) v(k) where k < m and coalesce(100 * longest < 50 * c, true)),
scored as (select cuts.*, x.c as l, y.c as r, cast((cast(1000000 as hugeint) * a * a) // (cast(x.c as hugeint) * y.c) as bigint) as score from cuts join g x on x.lang = cuts.lang and x.phrase = head join g y on y.lang = cuts.lang and y.phrase = tail),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best join n using (lang) qualify rank <= 2000"""

#: Nodes are the lists of their turns; CRC-32 by its table, made from the polynomial.
_OP13 = """
with recursive bits(n, v, k) as (select range, range, 0 from range(256) union all select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8),
crc as (select list(v order by n) as l from bits where k = 8), ids as (select distinct conv_id as c from conversations where conv_id is not null),
h as (select c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: xor(l[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 as h from ids, crc),
s as (select conv_id as c, turn, coalesce(role, '') as role, strlen(coalesce(text, '')) as b, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as g from conversations),
t as (select c, g, b, row_number() over (partition by c order by turn nulls first, role, g) as p from s),
built as (select h.c, 0 as own, p, g, b from h join t on t.c = h.c - h.c % 5 and p <= h union all select h.c, 1, p, g, b from h join t on t.c = h.c and p > h),
path as (select c, b, row_number() over w as d, list(g) over w as path from built window w as (partition by c order by own, p) union all select c, 0, 0, cast([] as varchar[]) from ids),
n as (select path, d, min(c) as c, count(*) as n, max(b) as b from path group by path, d), ends as (select path, string_agg(cast(c as varchar), ',' order by c) as ids from (select c, path from path qualify row_number() over (partition by c order by d desc) = 1) group by path),
kids as (select path[1 : d - 1] as path, count(*) as k from n where d > 0 group by 1), m as (select n.*, coalesce(k, 0) as k from n left join kids using (path)),
sums as (select a.path, count(*) filter (x.k = 0) as leaves, sum((x.n - 1) * x.b) as saved from m a join m x on x.path[1 : a.d] = a.path group by a.path)
select m.c as conv_id, m.d as depth, up.c as parent_conv_id, m.n as n_convs, m.k as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from m join sums using (path) left join ends using (path) left join n up on m.d > 0 and up.path = m.path[1 : m.d - 1]"""


def _op8() -> str:
    from limnos.llm import license_scan as ls

    listed = lambda words: f"[{', '.join(repr(w) for w in words)}]::varchar[]"
    templates = ", ".join(f"('{name}', {listed(words)}, {ls.block_words(ls.TEMPLATES[name])}, {', '.join(map(listed, ls.MARKS.get(name, ([], []))))})" for name, words in ls._template_words(ls.TEMPLATES).items())
    phrases = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in ls.PHRASES.items())
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
p(label, phrase, m) as (values {phrases}), t(label, words, width, must, never) as (values {templates}),
hit as (select r, label, i - 1 as pos from (select r, w, label, phrase, m, unnest(range(1, len(w) - m + 2)) as i from d, p where len(w) >= m) where array_to_string(w[i : i + m - 1], ' ') = phrase),
base as (select r, count(*) as n, min(pos) as a, max(pos) as z, string_agg(distinct label, ',' order by label) as labels from hit group by r),
win as (select r, label, words, must, never, w[i : i + width - 1] as held, w[greatest(1, i - {ls.REACH}) : i + width - 1 + {ls.REACH}] as around from (select r, w, t.*, unnest(range(1, len(w) + 1)) as i from d, t where len(list_intersect(t.words, d.w)) >= {ls.THRESHOLD} * len(t.words) - 1e-9)),
tm as (select r, label, len(list_intersect(words, held)) / len(words) as share from win where len(list_intersect(words, held)) >= {ls.THRESHOLD} * len(words) - 1e-9 and list_has_all(held, must) and not list_has_any(around, never)),
more as (select r, max(share) as share from tm group by r), every as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from hit union all select r, label from tm) group by r)
select d.doc_id, len(d.w) as n_words, coalesce(base.n, 0) as n_base, base.a as first_word, base.z as last_word, coalesce(base.labels, '') as base_labels, coalesce(every.labels, '') as labels,
  case when base.n > 0 then 1.0::double else coalesce(more.share, 0.0::double) end as score from d left join base using (r) left join more using (r) left join every using (r)"""


def oracle_sql() -> dict[str, str]:
    """Operators that SQL can express over whole tables; the others are tested against brute force."""
    return {"op2_decontamination": _OP2, "op5_ngram_jaccard_join": _OP5, "op8_license_scan": _op8(), "op11_exact_dedup": _OP11, "op12_collocations": _OP12, "op13_conversation_trie": _OP13}
