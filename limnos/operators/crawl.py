"""Research planning: URL forms, scoring of hits, links and tasks, frontier choice, portal partitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.functions import text as T

#: Query parameters that only track, fixed values.
TRACKING = ("fbclid", "gclid", "msclkid", "mc_cid", "mc_eid")
#: Words of documents worth reading and of pages never worth it, fixed values.
DOCUMENT_WORDS = ("pdf", "bericht", "report", "gutachten", "anlage", "anhang", "appendix", "method", "download", "dokument", "literatur", "archiv", "begleit", "langfassung", "kurzfassung", "steckbrief")
SUPPORT_WORDS = ("method", "anhang", "anlage", "begleit", "langfassung", "kurzfassung")
USELESS_WORDS = ("datenschutz", "impressum", "privacy", "login", "anmelden")


def canonical_url(c: Column) -> Column:
    """http(s) URL in one form: scheme and host in lower case, no default port, tracking or fragment; null if it is none."""
    u = F.trim(c)
    part = lambda p, g=1: F.regexp_extract(u, p, g)
    scheme = F.lower(part(r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"))
    authority = part(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")
    name = F.rtrim(F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1)), F.lit("."))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(u, r"^[^?#]*?://[^/?#]*(/[^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), _keeps), "&")
    url = F.concat(scheme, F.lit("://"), name, port, F.when(path == "", "/").otherwise(F.replace(path, F.lit(" "), F.lit("%20"))), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    good = scheme.isin("http", "https") & (name != "") & ~F.contains(authority, F.lit("@")) & (F.length(u) <= 4096) & ~u.rlike(r"[\x00-\x1F]")
    return F.when(good, url)


def _keeps(part: Column) -> Column:
    key = F.lower(_unquoted(F.regexp_extract(part, "^([^=]*)", 1)))
    return (part != "") & ~F.startswith(key, F.lit("utm_")) & ~key.isin(*TRACKING)


def suspicious_search(url: Column, names: list[str]) -> Column:
    """A search form's result page that does not name the body."""
    return url.rlike(r"(?i)^[^?#]*/(search|suche)/?(\?|$)") & url.rlike(r"(?i)[?&](q|query|search)=") & (F.size(T.matched_terms(_unquoted(url), names)) == 0)


def _unquoted(url: Column) -> Column:
    return F.coalesce(F.try_url_decode(url), url)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def hit_priority(url: Column, title: Column, rank: Column, names: list[str], preferred: list[str] = ()) -> Column:
    """45, and 20 for the name, 15 for a document, 10 for a preferred host, less the rank up to 7; kept in 30 to 95; 5 for search forms."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), _unquoted(url))
    direct = F.size(T.matched_terms(text, names)) > 0
    host = T.host(url)
    liked = F.lit(False)
    for h in preferred:
        liked = liked | (host == h) | F.endswith(host, F.lit("." + h))
    score = 45 + 20 * direct.cast("int") + 15 * _any_word(T.plain_norm(text), DOCUMENT_WORDS).cast("int") + 10 * liked.cast("int") - F.least(rank, F.lit(7))
    return F.when(suspicious_search(url, names), 5).otherwise(F.greatest(F.lit(30), F.least(F.lit(95), score)))


def link_priority(url: Column, label: Column, context: Column, navigation: Column, parent_useful: Column, names: list[str], topics: list[str], excluded: list[str] = ()) -> Column:
    """Weight of a link: the body's name counts most, then documents, topics, useful parents and method annexes."""
    whole = F.concat_ws(" ", label, context, _unquoted(url))
    near = F.concat_ws(" ", label, _unquoted(url))
    direct, identity, topic = (F.size(T.matched_terms(t, list(n))) > 0 for t, n in ((near, names), (whole, names), (whole, topics)))
    document = _any_word(T.plain_norm(F.concat_ws(" ", label, url)), DOCUMENT_WORDS)
    support = _any_word(T.plain_norm(F.concat_ws(" ", label, context)), SUPPORT_WORDS)
    norm_label = T.plain_norm(label)
    other_lake = ~direct & (F.length(norm_label) < 80) & norm_label.rlike(r"\b\w*see\b") & ~_any_word(norm_label, DOCUMENT_WORDS)
    score = 8 + 42 * direct.cast("int") + 10 * (identity & ~direct).cast("int") + 20 * topic.cast("int") + 22 * document.cast("int") + 10 * parent_useful.cast("int") + 18 * (support & parent_useful).cast("int")
    out = F.when(navigation & ~direct, 0)
    if excluded:
        out = out.when(F.size(T.matched_terms(whole, list(excluded))) > 0, 5)
    return out.when(_any_word(norm_label, USELESS_WORDS), 0).when(other_lake, 12).otherwise(F.least(F.lit(95), score))


def local_topics(text: Column, names: list[str], topics: list[str], reach: int = 250) -> Column:
    """Topics within so many characters of a name, in one paragraph."""
    return window_topics(local_windows(text, names, reach), topics)


def local_windows(text: Column, names: list[str], reach: int = 250) -> Column:
    """Surroundings of names, each within its paragraph."""
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda p: F.transform(T.identity_spans(p, names, (), reach), lambda s: s["window"])))


def window_topics(windows: Column, topics: list[str]) -> Column:
    """Topics in any of the windows."""
    return F.array_distinct(F.flatten(F.transform(windows, lambda w: T.matched_terms(w, topics))))


def assess(text: Column, names: list[str], topics: list[str], excluded: list[str], priority: Column, supporting: Column, status: Column, needs_confirmation: bool = False, geography: list[str] | None = None) -> Column:
    """relevant, supporting, uncertain or irrelevant; with ``geography``, a text that names none of its terms is no more than uncertain."""
    identity, hits = F.size(T.matched_terms(text, names)) > 0, F.size(local_topics(text, names, topics)) > 0
    against = F.size(T.matched_terms(text, excluded)) > 0 if excluded else F.lit(False)
    out = F.when(against, "uncertain").when(identity & hits, "relevant").when(supporting, "supporting").when(identity | (F.trim(text) == "") | (~hits & (priority >= 60)), "uncertain").otherwise("irrelevant")
    out = F.when((out == "irrelevant") & (status != "ok"), "uncertain").otherwise(out)
    gate = F.lit(needs_confirmation)
    if geography is not None:
        gate = gate | (F.size(T.matched_terms(text, geography)) == 0)
    return F.when(out.isin("relevant", "supporting") & gate, "uncertain").otherwise(out)


def links_of_text(text: Column) -> Column:
    """URLs and DOIs of a text, each once, in order; DOIs as resolver URLs."""
    urls = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"')\]]+[^\s<>\"')\].,;:])"), F.lit(1))
    dois = F.transform(F.regexp_extract_all(text, F.lit(r"\b(10\.\d{4,9}/[^\s<>\"')\]]+[^\s<>\"')\].,;:])"), F.lit(1)), lambda d: F.concat(F.lit("https://doi.org/"), d))
    return F.array_distinct(F.concat(urls, dois))


def bibliographic_lines(text: Column) -> Column:
    """Lines that look like references: a year in parentheses, and authors or a publisher."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\((?:19|20)\d{2}[a-z]?\)") & x.rlike(r"[\p{Lu}][\p{L}-]+,\s*\p{Lu}\.|Hrsg|Verlag|ISBN|DOI"))


def term_positions(text: Column, term: str) -> Column:
    """Array of (start, end), from 0, where the term stands between other characters than letters and digits; its blanks match any white space."""
    pattern = r"(?iU)(?<!\w)" + r"\s+".join(map(re.escape, term.split())) + r"(?!\w)"
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    sizes = F.zip_with(F.transform(F.slice(parts, 1, F.size(hits)), F.length), F.transform(hits, F.length), lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    spans = "array<struct<start:int,end:int>>"
    step = lambda acc, x: F.struct((acc["at"] + x["p"] + x["h"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["p"]).alias("start"), (acc["at"] + x["p"] + x["h"]).alias("end"))).cast(spans).alias("out"))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")), step, lambda acc: acc["out"])


def passages(fragments: DataFrame, names: list[str], topics: list[str], cap: int = 12_000, most: int = 30, before: int = 240, after: int = 540, spacing: int = 300) -> DataFrame:
    """(doc, evidence_id, locator, offset, text): original passages around the names in ``fragments(doc, number, locator, text)``.

    A window of ``before`` and ``after`` characters around each name is widened to whole words. Equal passages of a
    locator count once. Passages go by their score, 3 and 1 a topic, then by place; the beginnings of the first and last
    fragment come last. One is taken unless it would pass ``cap`` characters in all, or begins less than ``spacing``
    from one of its locator that was taken; ``most`` at most. Null texts are empty.
    """
    f = fragments.select("doc", "number", "locator", F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    found = f.withColumn("m", F.explode(F.concat(*(term_positions(t, n) for n in names))))
    low, high = F.greatest(F.col("m.start") - before, F.lit(0)), F.least(F.length(t), F.col("m.end") + after)
    space_before = F.instr(F.reverse(F.substr(t, F.lit(1), low)), " ")
    start = F.when((low == 0) | (space_before == 0), 0).otherwise(low - space_before + 1)
    space_after = F.call_function("locate", F.lit(" "), t, high + 1)
    end = F.when((high == F.length(t)) | (space_after == 0), F.length(t)).otherwise(space_after - 1)
    quoted = found.withColumns({"start": start, "end": end}).withColumn("quote", F.substr(t, F.col("start") + 1, F.col("end") - F.col("start")))
    quoted = quoted.where(F.size(T.matched_terms(F.col("quote"), names)) > 0).withColumn("norm", T.collapse_norm(F.col("quote")))
    once = quoted.groupBy("doc", "locator", "norm").agg(F.min(F.struct("number", "m.start", F.col("start").alias("offset"), F.col("quote").alias("text"))).alias("c"))
    score = 3 + F.size(T.matched_terms(F.col("c.text"), topics))
    candidate = lambda s, number, at, m, text: F.struct((-s).cast("int").alias("score"), number.cast("long").alias("number"), at.cast("int").alias("offset"), m.cast("int").alias("m"), F.col("locator"), text.alias("text"))
    windows = once.select("doc", candidate(score, F.col("c.number"), F.col("c.offset"), F.col("c.start"), F.col("c.text")).alias("c"))
    ends = f.groupBy("doc").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    edges = f.join(ends, "doc").where(F.col("number").isin(F.col("first"), F.col("last")) & (F.trim(t) != "")).select("doc", candidate(F.lit(0), F.col("number"), F.lit(0), F.lit(0), F.substr(t, F.lit(1), F.lit(1000))).alias("c"))
    shape = "array<struct<locator:string,offset:int,text:string>>"
    fits = lambda acc, c: (acc["used"] + F.length(c["text"]) <= cap) & (F.size(acc["out"]) < most) & ~F.exists(acc["out"], lambda x: (x["locator"] == c["locator"]) & (F.abs(x["offset"] - c["offset"]) < spacing))
    taken = lambda acc, c: F.struct((acc["used"] + F.length(c["text"])).alias("used"), F.array_append(acc["out"], F.struct(c["locator"].alias("locator"), c["offset"].alias("offset"), c["text"].alias("text"))).cast(shape).alias("out"))
    ordered = windows.union(edges).groupBy("doc").agg(F.array_sort(F.collect_list("c")).alias("c"))
    chosen = F.aggregate("c", F.struct(F.lit(0).alias("used"), F.array().cast(shape).alias("out")), lambda acc, c: F.when(fits(acc, c), taken(acc, c)).otherwise(acc), lambda acc: acc["out"])
    return ordered.select("doc", F.posexplode(chosen).alias("k", "p")).select("doc", F.concat(F.lit("e"), (F.col("k") + 1).cast("string")).alias("evidence_id"), "p.locator", "p.offset", "p.text")


def enqueue(old: DataFrame, new: DataFrame) -> DataFrame:
    """Frontier after discoveries, one row per profile and URL: greatest priority, least depth, usefulness sticks."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.groupBy("profile", "url").agg(F.max("priority").alias("priority"), F.min("depth").alias("depth"), F.max(F.coalesce("parent_useful", F.lit(False))).alias("parent_useful"))


def search_scores(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Score: priority - 15 per search of the profile - 12 per empty and 5 per search of its family.

    ``history(profile, family, new_count)`` of finished searches.
    """
    by_family = history.groupBy("profile", "family").agg(F.count("*").alias("n"), F.count_if(F.coalesce("new_count", F.lit(0)) == 0).alias("empty"))
    by_profile = by_family.groupBy("profile").agg(F.sum("n").alias("body"))
    j = candidates.join(by_profile, "profile", "left").join(by_family, ["profile", "family"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.withColumn("score", F.col("priority") - 15 * zero("body") - 12 * zero("empty") - 5 * zero("n")).drop("body", "n", "empty")


def task_scores(candidates: DataFrame, done: DataFrame, explore: bool = False) -> DataFrame:
    """Score of tasks (profile, host, branch, priority) against those done; exploring favours hosts not seen much."""
    out = candidates
    for c, n in (("host", "_h"), ("profile", "_p"), ("branch", "_b")):
        out = out.join(done.groupBy(c).agg(F.count("*").alias(n)), c, "left")
    h, p, b = (F.coalesce(c, F.lit(0)) for c in ("_h", "_p", "_b"))
    score = 100 / (1 + h) + F.col("priority") / 4 - 8 * p - b if explore else F.col("priority") - 5 * h - 8 * p - 2 * b
    return out.withColumn("score", score).drop("_h", "_p", "_b")


def next_best(scored: DataFrame, tie: list[str]) -> DataFrame:
    return scored.orderBy(F.desc("score"), *tie).limit(1)


def family_choice(history: DataFrame, families: DataFrame, prior_mean: float = 1.0, prior_weight: float = 2.0, epsilon: float = 0.1, round_: int = 0) -> DataFrame:
    """Per profile the search family with the best smoothed mean gain; a hash-seeded share explores instead."""
    gains = history.groupBy("profile", "family").agg(F.sum("gain").alias("g"), F.count("*").alias("n"))
    j = families.join(gains, ["profile", "family"], "left").withColumn("value", (F.coalesce("g", F.lit(0)) + prior_mean * prior_weight) / (F.coalesce("n", F.lit(0)) + prior_weight))
    draw = F.pmod(F.xxhash64("profile", F.lit(round_)), F.lit(1000)) / 1000
    order = F.when(draw < epsilon, F.pmod(F.xxhash64("profile", "family", F.lit(round_)), F.lit(1 << 30)).cast("double")).otherwise(-F.col("value"))
    w = Window.partitionBy("profile").orderBy("o", "family")
    return j.withColumn("o", order).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("profile", "family", "value")


def plausible_batches(hits: DataFrame) -> DataFrame:
    """Batches of hits of which at least one names the body or a topic: (batch, plausible)."""
    return hits.groupBy("batch").agg(F.bool_or(F.coalesce("name_hit", F.lit(False)) | F.coalesce("topic_hit", F.lit(False))).alias("plausible"))


def accept_up_to(candidates: DataFrame, target: int) -> DataFrame:
    """The most important accepted candidates per profile, up to the target less what is there already (``have``)."""
    w = Window.partitionBy("profile").orderBy(F.desc("importance"), "url")
    return candidates.where("accepted").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.greatest(F.lit(0), F.lit(target) - F.coalesce("have", F.lit(0)))).drop("_r")


def budget_shares(total: int, groups: DataFrame) -> DataFrame:
    """(group, share): the total split evenly over ``groups(group, index)``, the rest to the first ones."""
    n = groups.agg(F.count("*").alias("_n"))
    return groups.join(F.broadcast(n)).select("group", (F.floor(F.lit(total) / F.col("_n")) + (F.col("index") < F.lit(total) % F.col("_n")).cast("int")).cast("long").alias("share"))


def split_choice(options: DataFrame, target: int) -> DataFrame:
    """Per job the dimension that splits it into fewest exports of at most the target: cost sum of ceil(n / target), at least 1 each, and 0.05 per option.

    ``options(job, dimension, label, n, expected)``; dimensions whose counts do not add up to the job's are no candidates.
    """
    costs = options.groupBy("job", "dimension").agg(F.sum("n").alias("sum"), F.max("expected").alias("expected"), F.count("*").alias("k"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / target))).alias("files"))
    fit = costs.where("sum = expected and k >= 2").withColumn("cost", F.round(F.col("files") + 0.05 * F.col("k"), 6))
    return fit.groupBy("job").agg(F.min(F.struct("cost", "k", "dimension")).alias("b")).select("job", "b.dimension", "b.cost", F.col("b.k").alias("children"))


def review_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with at least one reason for a human look, and the reasons in order."""
    return df.withColumn("reasons", F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))).where(F.size("reasons") > 0)


def allowed_tasks(tasks: DataFrame, blocked: DataFrame, permitted: DataFrame) -> DataFrame:
    """Tasks not blocked, of permitted profiles."""
    return tasks.join(blocked.select("id"), "id", "left_anti").join(permitted.select("profile"), "profile", "left_semi")


def shared_cache(rows: DataFrame) -> DataFrame:
    """Latest allowed time per host over all workers."""
    return rows.groupBy("host").agg(F.max("next_allowed").alias("next_allowed"))


def replay(responses: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored responses under new profile ids of ``ids(old_profile, new_profile)``."""
    return responses.join(ids, responses.profile == ids.old_profile).select(F.col("new_profile").alias("profile"), *[c for c in responses.columns if c != "profile"])


def profiles(register: DataFrame, codes: DataFrame) -> DataFrame:
    """Research profiles of ``register(code, name, region)``: names without bracketed parts, aliases, ids, and a caveat for names that repeat."""
    plain = F.trim(F.regexp_replace("name", r"\s*\([^)]*\)", ""))
    rows = register.join(codes, "code", "left").withColumn("plain", plain)
    often = rows.groupBy("plain").agg((F.count("*") > 1).alias("identity_requires_confirmation"))
    return rows.join(often, "plain").select(F.regexp_replace("code", "[^A-Za-z0-9_.-]", "_").alias("id"), F.col("plain").alias("name"), T.name_variants(F.col("name")).alias("aliases"), F.array_compact(F.array("code", "other_code")).alias("identifiers"), "region", "identity_requires_confirmation")


def research_export(urls: DataFrame, reviews: DataFrame) -> DataFrame:
    """Bucket of every URL of a profile: accepted, to check, rejected, unread."""
    j = urls.join(reviews, ["profile", "url"], "left")
    return j.withColumn("bucket", F.when(F.col("decision").isin("relevant", "supporting"), "accepted").when(F.col("decision") == "uncertain", "to_check").when(F.col("decision") == "irrelevant", "rejected").otherwise("unread"))


def source_inventory(stages: dict[str, DataFrame]) -> DataFrame:
    """(url, stages): in which stages each URL occurs."""
    frames = [df.select("url", F.lit(name).alias("stage")) for name, df in stages.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return stages_of(out)


def stages_of(rows: DataFrame) -> DataFrame:
    """(url, stages) of ``rows(url, stage)``, however many stages there are."""
    return rows.groupBy("url").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


def config_identity(*columns: Column) -> Column:
    return T.stable_id(*columns)
