"""Entity matching: ranked candidates, fuzzy names, evidence fusion, nearest neighbours, names to codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.functions import text as T
from limnos.session import store


def name_to_code(rows: DataFrame, prefer: str = "") -> DataFrame:
    """(key, code) for ``rows(pos, name, code)``: codes that contain ``prefer`` first, then the most frequent, then the earliest."""
    counted = rows.where("coalesce(name, '') <> '' and coalesce(code, '') <> ''").withColumn("key", T.collapse_norm(F.col("name"))).groupBy("key", "code").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    liked = F.contains("code", F.lit(prefer)) if prefer else F.lit(True)
    w = Window.partitionBy("key").orderBy(liked.cast("int").desc(), F.desc("n"), "pos")
    return counted.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("key", "code")


#: Targets in the cell of a target, on average, with which the search for neighbours begins, and how often cells can be halved for it.
CROWD, HALVINGS = 8, 24


def nearest(points: DataFrame, targets: DataFrame, max_distance: float) -> DataFrame:
    """Nearest target of each point within 2 * max_distance, with status auto, review or none.

    A grid finds it: a target no farther than a cell is wide lies in one of the nine cells around the point. The search
    begins with cells so small that they hold few targets; points without a target that near go on to cells twice as
    wide, up to 2 * max_distance, so that no point is compared with all of a crowd. Equal places are compared once.
    ``points(id, x, y)``, ``targets(target, x, y)``; ties go to the least target.
    """
    width = 2 * max_distance
    held = store(targets.where("x is not null and y is not null").groupBy(F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.min("target").alias("target")))
    rest = store(points.where("x is not null and y is not null").select("x", "y").distinct())
    cell = lambda c, w: F.floor(F.col(c) / w)
    crowd = lambda w: held.groupBy(cell("tx", w), cell("ty", w)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.lit(0.0))).first()[0]
    halvings = 0
    while halvings < HALVINGS and crowd(width / 2**halvings) > CROWD:
        halvings += 1
    found = None
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    for k in range(halvings, -1, -1):
        w = width / 2**k
        around = F.array(*(F.struct((cell("x", w) + dx).alias("cx"), (cell("y", w) + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
        near = rest.select("x", "y", F.explode(around).alias("c")).select("x", "y", "c.cx", "c.cy")
        met = near.join(held.withColumn("cx", cell("tx", w)).withColumn("cy", cell("ty", w)), ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= w)
        settled = store(met.groupBy("x", "y").agg(F.min(F.struct("distance", "target")).alias("b")))
        found = settled if found is None else found.unionByName(settled)
        if k:
            rest = store(rest.join(settled, ["x", "y"], "left_anti"))
    best = points.select("id", "x", "y").join(found, ["x", "y"]).groupBy("id").agg(F.min("b").alias("b"))
    status = F.when(F.col("b.distance") <= max_distance, "auto").when(F.col("b.distance").isNotNull(), "review").otherwise("none")
    return points.select("id").join(best, "id", "left").select("id", F.col("b.target").alias("target"), F.col("b.distance").alias("distance"), status.alias("status"))


#: Queries and vectors of one block of products, and those of one matrix within it.
QUERIES, VECTORS = 8_192, 16_384
TILE = (512, 4_096)


def _matrix(lists: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors filled up with zeros, their lengths): -1 for one that is null or holds a null."""
    lists = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    broken = lists.is_null().to_numpy(zero_copy_only=False)
    broken[pc.list_parent_indices(lists).to_numpy()[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    out[broken] = 0.0
    return out, np.where(broken, -1, size)


def _best_of_block(k: int):
    """The k best vectors of a block for each of its queries: matrix products, of which only what may still be among the best is kept."""
    names, kinds = ("q", "id", "c"), (pa.int64(), pa.int64(), pa.float64())

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.sort_by("id")
            width = max(pc.max(pc.list_value_length(x["v"])).as_py() or 0 for x in (queries, vectors))
            (a, a_size), (b, b_size) = _matrix(queries["v"], width), _matrix(vectors["v"], width)
            a_norm, b_norm = (np.sqrt((m * m).sum(1)) for m in (a, b))
            a_id, b_id = queries["id"].to_numpy(), vectors["id"].to_numpy()
            for lo in range(0, len(a), TILE[0]):
                mine = slice(lo, lo + TILE[0])
                best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
                least = np.full(len(a_id[mine]), -np.inf)  # what the k-th best so far has; of equals the one that came first stays
                for at in range(0, len(b), TILE[1]):
                    theirs = slice(at, at + TILE[1])
                    with np.errstate(invalid="ignore", divide="ignore"):
                        c = (a[mine] @ b[theirs].T) / (a_norm[mine, None] * b_norm[None, theirs])
                    score = np.floor(c * 1e9 + 0.5)
                    score[np.isnan(c)] = np.inf
                    score[(a_size[mine, None] != b_size[None, theirs]) | (a_size[mine, None] < 0)] = -1e300
                    score[a_id[mine, None] == b_id[None, theirs]] = -np.inf
                    if at == 0 and score.shape[1] > k:
                        floor = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
                        keep = (score >= floor[:, None]) & (score > -np.inf)
                    else:
                        keep = score > least[:, None]
                    i, j = np.nonzero(keep)
                    if not len(i):
                        continue
                    i, j, s, c = (np.concatenate(x) for x in zip(best, (i, at + j, score[i, j], c[i, j])))
                    order = np.lexsort((j, -s, i))
                    i, j, s, c = i[order], j[order], s[order], c[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    least[i[rank == k - 1]] = s[rank == k - 1]
                    best = tuple(x[rank < k] for x in (i, j, s, c))
                i, j, s, c = best
                for column, x in zip(out, (a_id[mine][i], b_id[j], pa.array(c, mask=s == -1e300))):
                    column.append(pa.array(x))
        return pa.table([pa.chunked_array(x, kind) for x, kind in zip(out, kinds)], names=names)

    return run


def most_similar(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q, id, c, rank): for each of ``queries(id, v)`` the k of ``vectors(id, v)`` with other ids and the greatest cosine, exact to 9 digits; of equals the least ids.

    A vector without length has no direction (NaN, first); one that is null, holds a null or has another length has no cosine (last).
    Queries are dealt to blocks of about QUERIES, vectors to blocks of about VECTORS; each pair of blocks is one
    group, of which k rows a query are left, so memory is bounded and the products are spread over all tasks.
    """
    queries, vectors = (df.select(F.col("id").cast("long").alias("id"), F.col("v").alias("v")).where("id is not null") for df in (queries, vectors))
    blocks, shards = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERIES), (vectors, VECTORS)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "v", dealt(blocks).alias("block")).withColumn("shard", every(shards))
    right = vectors.select("id", "v", dealt(shards).alias("shard")).withColumn("block", every(blocks))
    found = left.repartition(blocks * shards, "block", "shard").groupBy("block", "shard").cogroup(right.repartition(blocks * shards, "block", "shard").groupBy("block", "shard")).applyInArrow(_best_of_block(k), "q long, id long, c double")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("c", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


#: Segments beyond those that unmatched characters can spoil: so many of the most common ones need no look-up.
SPARE_SEGMENTS = 4


def _segment_counts(a: Column, threshold: float) -> tuple[Column, Column]:
    """(segments of a name of length a, how many of them are looked up)."""
    longest = F.floor(a * (2 - threshold) / threshold + 1e-9)
    spoilt = F.floor((1 - threshold) * (a + longest) + 1e-9)
    segments = F.least(a, spoilt + 1 + SPARE_SEGMENTS)
    return segments.cast("int"), F.least(spoilt + 1, segments).cast("int")


def _segment(name: Column, a: Column, n: Column, i: Column, shift: Column | None = None) -> Column:
    """The i-th of n segments of a name of length a; with a shift, what stands as much later in another name."""
    start = F.floor(i * a / n)
    size = F.floor((i + 1) * a / n) - start
    return F.substr(name, (start + 1 + (shift if shift is not None else 0)).cast("int"), size.cast("int"))


def name_candidates(shorter: DataFrame, longer: DataFrame, threshold: float = 0.9, least: int = 5) -> DataFrame:
    """(short, long): pairs of ``name`` of the two tables, the first no longer, that can have a ratio of ``threshold``.

    A ratio r of names of lengths a <= b leaves at most (1 - r) * (a + b) characters unmatched in both, and each spoils one
    of the shorter name's segments at most. With SPARE_SEGMENTS more segments than can be spoilt, that many more stay
    whole, so it does to look up the rarest ones and leave out the most common: each is looked for in the
    longer name at its place, shifted by no more than the unmatched characters allow.
    """
    names = lambda df: df.select("name").where(F.length("name") >= least).distinct()
    a, n, keep = F.col("a"), F.col("n"), F.col("keep")
    segments, looked_up = _segment_counts(F.length("name"), threshold)
    short = names(shorter).select(F.col("name").alias("short"), F.length("name").alias("a"), segments.alias("n"), looked_up.alias("keep"))
    cut = short.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("segment", _segment(F.col("short"), a, n, F.col("i")))
    often = cut.groupBy("a", "i", "segment").agg(F.count("*").alias("often"))
    rare = cut.join(often, ["a", "i", "segment"]).withColumn("r", F.row_number().over(Window.partitionBy("short").orderBy("often", "i"))).where(F.col("r") <= keep).select("short", "a", "i", "segment")
    b = F.length("name")
    low = F.greatest(F.lit(1), F.ceil(b * threshold / (2 - threshold) - 1e-9)).cast("int")
    lengths = names(longer).withColumn("a", F.explode(F.sequence(low, b))).withColumn("n", _segment_counts(a, threshold)[0]).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    matched = threshold * (a + b) / 2 - 1e-9
    start, end = F.floor(F.col("i") * a / n), F.floor((F.col("i") + 1) * a / n)
    back, ahead = F.least(start, F.floor(a - matched)), F.least(b - end, F.floor(b - matched))
    shifts = F.sequence((-back).cast("int"), F.greatest(ahead, -back).cast("int"))
    probes = lengths.withColumn("segment", F.explode(F.array_distinct(F.transform(shifts, lambda s: _segment(F.col("name"), a, n, F.col("i"), s)))))
    return probes.select(F.col("name").alias("long"), "a", "i", "segment").join(rare, ["a", "i", "segment"]).select("short", "long").distinct()


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.9, least: int = 5) -> DataFrame:
    """Pairs (name, other, similarity) of different names with a Ratcliff-Obershelp ratio of at least the threshold.

    Candidates come from ``name_candidates``, the shorter name on either side; then the character multisets are
    compared, then the ratio itself.
    """
    one = name_candidates(left, right, threshold, least).toDF("name", "other")
    two = name_candidates(right, left, threshold, least).toDF("other", "name").where(F.length("other") < F.length("name"))
    pairs = one.unionByName(two).where(F.col("name") != F.col("other"))
    counts = lambda c: F.split(F.col(c), "")
    shared = F.aggregate(F.array_distinct(F.filter(counts("name"), lambda x: x != "")), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter(counts("name"), lambda y: y == x)), F.size(F.filter(counts("other"), lambda y: y == x))))
    likely = pairs.where(2 * shared / (F.length("name") + F.length("other")) >= threshold - 1e-9)
    return likely.withColumn("similarity", T.ratcliff_ratio("name", "other")).where(F.col("similarity") >= threshold)


def classify_score(score: Column, margin: Column, distance: Column | None = None) -> Column:
    """auto_match, review or unmatched; a best candidate over 100 m away always needs review."""
    out = F.when(((score >= 92) & (margin >= 5)) | ((score >= 82) & (margin >= 10)), "auto_match").when(score >= 65, "review").otherwise("unmatched")
    return out if distance is None else F.when(distance > 100, "review").otherwise(out)


def name_similarity(pairs: DataFrame, left: str, right: str, contexts: list[str]) -> DataFrame:
    """Adds name_score, 0 to 100: over all variants of both names the best of sequence, token and containment scores, and a bonus of context."""
    keyed = pairs.withColumn("_row", F.struct(*pairs.columns))
    variants = keyed.withColumn("_l", F.explode(T.name_variants(F.col(left)))).withColumn("_r", F.explode(T.name_variants(F.col(right))))
    a, b = T.ascii_tokens(F.col("_l")), T.ascii_tokens(F.col("_r"))
    scored = variants.withColumn("_seq", 100 * T.ratcliff_ratio(a, b)).withColumn("_tok", T.token_set_score(F.col("_l"), F.col("_r")))
    inside = F.when(F.contains(a, b) | F.contains(b, a), 100.0).otherwise(0.0)
    best = scored.groupBy("_row").agg(F.max(F.greatest("_seq", 0.55 * F.col("_tok") + 0.45 * F.col("_seq"), inside)).alias("_best"))
    context = F.greatest(F.lit(0.0), *(T.token_set_score(F.col(f"_row.{c}"), F.col(f"_row.{right}")) for c in contexts))
    bonus = F.when(F.col("_best") >= 45, F.least(F.lit(6.0), context * 0.06)).otherwise(0.0)
    return best.select("_row.*", F.least(F.lit(100.0), F.col("_best") + bonus).alias("name_score"))


#: Score from which a water body counts as the station's own, a fixed value.
CERTAIN_BODY = 85


def best_bodies(names: DataFrame, bodies: DataFrame) -> DataFrame:
    """(wb, b(water_body_id, body_name, body_score)): the body whose name resembles ``wb`` most, the largest id of equals.

    Names that resemble a body at CERTAIN_BODY or more find theirs by segments; only the others are compared with every body.
    """
    left = names.withColumn("name", T.ascii_tokens(F.col("wb")))
    right = bodies.select("water_body_id", F.col("name").alias("body_name")).withColumn("other", T.ascii_tokens(F.col("body_name")))
    own, theirs = left.select("name").distinct(), right.select(F.col("other").alias("name")).distinct()
    near = similar_names(own, theirs, CERTAIN_BODY / 100, least=1).select("name", "other").unionByName(own.join(theirs, "name").select("name", F.col("name").alias("other")))
    found = left.join(near, "name").join(right, "other")
    rest = left.join(near.select("name").distinct(), "name", "left_anti").join(right)
    pairs = found.select("wb", "name", "other", "water_body_id", "body_name").unionByName(rest.select("wb", "name", "other", "water_body_id", "body_name"))
    scored = pairs.withColumn("body_score", 100 * T.ratcliff_ratio("name", "other"))
    return scored.groupBy("wb").agg(F.max_by(F.struct("water_body_id", "body_name", "body_score"), F.struct("body_score", "water_body_id")).alias("b"))


def link_stations(stations: DataFrame, sources: DataFrame, bodies: DataFrame, top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(mappings, candidates): the best source per station of ``stations(key, name, waterway, water_body, x, y)``.

    ``sources(station_id, name, water_body_id, x, y)`` is a station register and ``bodies(water_body_id, name)`` its
    water bodies; candidates are scored per pair of distinct names, and a station is compared with the register it is stated against.
    """
    names = stations.select(F.col("water_body").alias("wb")).distinct()
    body = best_bodies(names, bodies)
    registered = sources.select("station_id", F.col("name").alias("source_name"), F.col("water_body_id").alias("source_body"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    known = stations.join(body, stations.water_body == body.wb, "left")
    # a source in the station's body scores 65 or more, any other 60 at most: with enough of the former the latter cannot rank
    enough = sources.groupBy(F.col("water_body_id").alias("_body")).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(top_n, 2))
    certain = (F.col("b.body_score") >= CERTAIN_BODY) & (F.col("b.water_body_id") == F.col("_body"))
    settled = known.join(enough, certain, "left_semi").join(registered, F.col("b.water_body_id") == F.col("source_body"))
    candidates = settled.unionByName(known.join(enough, certain, "left_anti").join(registered))
    scored = name_similarity(candidates.select("key", "name", "waterway", "water_body", "x", "y", "station_id", "source_name", "source_body", "sx", "sy", "b"), "name", "source_name", ["waterway", "water_body"])
    same = (F.col("b.body_score") >= CERTAIN_BODY) & (F.col("source_body") == F.col("b.water_body_id"))
    distance = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    score = F.when(same & distance.isNotNull(), 65 + 0.35 * F.greatest(F.lit(0.0), 100 - distance / 15)).when(same, F.greatest(F.lit(70.0), 0.3 * F.col("name_score") + 70)).otherwise(0.35 * F.col("name_score") + 0.25 * F.coalesce("b.body_score", F.lit(0.0)))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "station_id")
    ranked = scored.withColumn("distance_m", distance).withColumn("score", score).withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    ranked = ranked.where(F.col("rank") <= top_n)
    margin = F.col("score") - F.col("second")
    mappings = ranked.where("rank = 1").select("key", "station_id", "source_name", F.col("b.body_name").alias("matched_body"), F.col("b.body_score").alias("body_score"), "distance_m", "score", margin.alias("margin"), classify_score(F.col("score"), margin, F.col("distance_m")).alias("status"))
    return mappings, ranked.select("key", "rank", "station_id", "source_name", "distance_m", "score")


def fuse_evidence(evidence: DataFrame, flags: DataFrame) -> DataFrame:
    """Assignment per item from ``evidence(item, set_id, kind, target)`` and ``flags(item, blocked)``.

    Strong sets (codes, names) are intersected: a target is allowed if every strong set of the item has it. Spatial
    targets then narrow the allowed ones, or contradict them. One allowed target without contradiction or block is
    assigned; otherwise all targets with evidence are candidates.
    """
    strong = evidence.where(F.col("kind").isin("code", "name"))
    n_sets = strong.groupBy("item").agg(F.countDistinct("set_id").alias("sets"))
    hits = strong.groupBy("item", "target").agg(F.countDistinct("set_id").alias("hits"))
    allowed = hits.join(n_sets, "item").where("hits = sets").groupBy("item").agg(F.array_sort(F.collect_set("target")).alias("strong"))
    spatial = evidence.where(F.col("kind").isin("area", "river")).groupBy("item").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "river", F.col("target")))).alias("river"), F.array_sort(F.collect_set(F.when(F.col("kind") == "area", F.col("target")))).alias("area"))
    every = evidence.groupBy("item").agg(F.array_sort(F.collect_set("target")).alias("every"))
    none = F.expr("cast(array() as array<string>)")
    j = every.join(n_sets, "item", "left").join(allowed, "item", "left").join(spatial, "item", "left").join(flags, "item", "left")
    j = j.select("item", "every", F.col("sets").isNotNull().alias("has_strong"), F.coalesce("strong", none).alias("strong"), F.col("river").isNotNull().alias("located"), F.when(F.size(F.coalesce("river", none)) > 0, F.col("river")).otherwise(F.coalesce("area", none)).alias("near"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    narrowed = F.array_intersect("strong", "near")
    contradicted = F.col("located") & (F.size("strong") > 0) & (F.size(narrowed) == 0)
    conflict = (F.col("has_strong") & (F.size("strong") == 0)) | contradicted
    final = F.when(F.col("located") & (F.size(narrowed) > 0), narrowed).otherwise(F.col("strong"))
    j = j.withColumn("conflict", conflict).withColumn("allowed", final)
    auto = (F.size("allowed") == 1) & ~F.col("conflict") & ~F.col("blocked")
    chosen = F.when(F.col("conflict") | (F.size("allowed") == 0), F.col("every")).otherwise(F.col("allowed"))
    return j.select("item", "conflict", F.when(auto, "rule_assigned").otherwise("needs_review").alias("status"), chosen.alias("targets"))


def alias_lookup(aliases: DataFrame, queries: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Candidates (query, label, property, kind, weight) of ``aliases(alias, kind, label, property, weight)`` for normalised ``queries(query)``."""
    index = aliases.withColumn("key", T.collapse_norm(F.col("alias")))
    index = index.where(F.col("label").isin(labels)) if labels else index
    return queries.withColumn("key", T.collapse_norm(F.col("query"))).join(index, "key").select("query", "label", "property", "kind", "weight", "alias")


def phrase_matches(questions: DataFrame, aliases: DataFrame, longest: int = 4) -> DataFrame:
    """Aliases that stand in a question as runs of whole words, longer ones first: (question, alias, words)."""
    words = F.split(T.ascii_tokens(F.col("question")), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    found = questions.withColumn("w", words).select("question", F.explode(F.array_distinct(spans)).alias("key"))
    index = aliases.select("alias", T.ascii_tokens(F.col("alias")).alias("key")).distinct()
    return found.join(index, "key").select("question", "alias", F.size(F.split("key", " ")).alias("words"))
