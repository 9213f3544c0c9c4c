"""Facts taken from documents: block classes, chunks, evidence checks, semantic deduplication, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.functions import text as T
from limnos.operators.sequences import greedy_groups

#: Patterns of tables of contents, captions, bibliographies, fixed values.
LEADER = r"\.{4,}\s*\d{1,4}\s*$"
CAPTION = r"(?i)^(Abb\.?|Abbildung|Tab\.?|Tabelle|Foto|Karte|Fig\.?)\s*\d"
YEAR = r"\(\s*\d{4}[a-z]?\s*\)"
BIBLIOGRAPHY = r"\b(Hrsg|Verlag|In:|S\.\s*\d+\s*[–-]\s*\d+|ISBN)\b"
#: Fields that do not make a fact another one.
NOT_SEMANTIC = ("event_id", "relationship_id", "evidence", "extraction_metadata", "quality_assessment", "source_document", "publication_date", "retrieved_at", "category_assessment")


def block_class(text: Column, kind: Column | None = None) -> Column:
    """content, toc, caption, bibliography or noise."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    leaders, years = _matching(lines, LEADER), _matching(lines, YEAR)
    out = (
        F.when(n == 0, "noise")
        .when((leaders >= 2) | ((leaders > 0) & (leaders / n >= 0.4)), "toc")
        .when(F.trim(F.get(lines, 0)).rlike(CAPTION) & (F.length(text) < 300), "caption")
        .when(((years >= 3) & (years / n >= 0.3)) | ((years >= 2) & text.rlike(BIBLIOGRAPHY)), "bibliography")
        .when(F.length(F.trim(text)) < 15, "noise")
        .otherwise("content")
    )
    return out if kind is None else F.when(kind == "table_row", "content").otherwise(out)


def _matching(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def chunks(blocks: DataFrame, max_chars: int = 10_000, context_chars: int = 2500) -> DataFrame:
    """Chunks of ``blocks(doc, pos, block_id, page, text)`` in order, at most max_chars each, with short neighbour blocks as context."""
    sized = greedy_groups(blocks.withColumn("_n", F.length("text")), ["doc"], "pos", "_n", max_chars, "chunk")
    block = F.struct("pos", "block_id", "page", "text")
    short = lambda b: F.when(F.length(b["text"]) <= context_chars, b)
    grouped = sized.groupBy("doc", "chunk").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.array_sort(F.collect_set("page")).alias("pages"))
    # the neighbours are the edges of the chunks before and after
    edge = sized.groupBy("doc", "chunk").agg(F.min_by(short(block), "pos").alias("first"), F.max_by(short(block), "pos").alias("last"))
    before, after = edge.select("doc", (F.col("chunk") + 1).alias("chunk"), F.col("last").alias("before")), edge.select("doc", (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("after"))
    grouped = grouped.join(before, ["doc", "chunk"], "left").join(after, ["doc", "chunk"], "left")
    identity = F.sha2(F.array_join(F.transform("blocks", lambda b: b["block_id"]), "|"), 256)
    return grouped.select("doc", "chunk", F.concat(F.format_string("chunk_%04d_", F.col("chunk") + 1), F.substr(identity, F.lit(1), F.lit(8))).alias("chunk_id"), "blocks", F.array_compact(F.array("before", "after")).alias("context_blocks"), "pages")


def evidence_problems(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, problem) for evidence of ``facts(id, evidence array<struct<block_id, quote>>)`` whose block is unknown or lacks the quote."""
    quoted = facts.select("id", F.explode_outer("evidence").alias("e")).select("id", F.col("e.block_id").alias("block_id"), F.col("e.quote").alias("quote"))
    joined = quoted.join(blocks.select("block_id", F.col("text").alias("_text"), F.lit(True).alias("_known")), "block_id", "left")
    ok = F.contains(T.quote_norm(F.col("_text")), T.quote_norm(F.col("quote")))
    problem = F.when(F.col("block_id").isNull(), "no evidence").when(F.col("_known").isNull(), "unknown block").when(F.coalesce(F.trim("quote"), F.lit("")) == "", "empty quote").when(~ok, "quote not in block")
    return joined.select("id", problem.alias("problem")).where("problem is not null").distinct()


def semantic_key(df: DataFrame, excluded: tuple[str, ...] = NOT_SEMANTIC) -> Column:
    """Digest of all columns but ids, evidence and metadata; columns in name order, nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in excluded)), {"ignoreNullFields": "false"}), 256)


def merge_facts(df: DataFrame, id_column: str, order: str, evidence: str = "evidence") -> tuple[DataFrame, DataFrame]:
    """(merged facts, id map): facts with one semantic key become the first of them, with the evidence of all, each once, in order."""
    keyed = df.withColumn("_key", semantic_key(df.drop(order)))
    firsts = keyed.groupBy("_key").agg(F.min_by(F.struct(*df.columns), order).alias("_row"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(evidence).alias("e")))), lambda x: x["e"]))).alias("_all"), F.count("*").alias("merged"))
    out = firsts.select(*[(F.col("_all") if c == evidence else F.col(f"_row.{c}")).alias(c) for c in df.columns], "merged")
    ids = keyed.select(id_column, "_key").join(firsts.select("_key", F.col(f"_row.{id_column}").alias("canonical_id")), "_key").select(id_column, "canonical_id")
    return out, ids


#: Ids that one task sorts or holds.
IDS = 500_000


def resolve_references(rows: DataFrame, ids: DataFrame, columns: list[str], size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Local references to global ids: ``ids(chunk_id, local_id, global_id)``, the own chunk first, then a global id given outright.

    (resolved rows, rows with an unresolved reference). Both sides are dealt to tasks of about IDS ids; ``size`` is how
    many there are at most, if that is known, and saves counting them.
    """
    out = rows
    parts = max(1, -(-(ids.count() if size is None else size) // IDS))
    known = ids.select("global_id").repartition(parts, "global_id").distinct()
    for c in columns:
        local = ids.select("chunk_id", F.col("local_id").alias(c), F.col("global_id").alias(f"_{c}")).repartition(parts, "chunk_id", c)
        outright = known.select(F.col("global_id").alias(c), F.col("global_id").alias(f"_g{c}"))
        out = out.repartition(parts, "chunk_id", c).join(local, ["chunk_id", c], "left").repartition(parts, c).join(outright, c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", f"_g{c}")).drop(f"_g{c}")
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.col(f"_{c}").isNotNull()
    good = out.where(fine).select(*[(F.col(f"_{c}") if c in columns else F.col(c)).alias(c) for c in rows.columns])
    return good, out.where(~fine).select(*rows.columns)


def compare_variants(fine: DataFrame, coarse: DataFrame, key: str) -> DataFrame:
    """Per key: rows on either side and matched, ambiguous, only_fine or only_coarse."""
    a, b = fine.groupBy(key).agg(F.count("*").alias("n_fine")), coarse.groupBy(key).agg(F.count("*").alias("n_coarse"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("n_fine", F.lit(0)).alias("n_fine"), F.coalesce("n_coarse", F.lit(0)).alias("n_coarse"))
    status = F.when(F.expr("n_coarse = 0"), "only_fine").when(F.expr("n_fine = 0"), "only_coarse").when(F.expr("n_fine = 1 and n_coarse = 1"), "matched").otherwise("ambiguous")
    return both.withColumn("status", status)


def context_blocks(jobs: DataFrame, blocks: DataFrame, supplied: DataFrame, n: int = 4) -> DataFrame:
    """For ``jobs(job, terms)`` the n blocks with most term hits that were not supplied yet; terms are few, so blocks are joined by term word."""
    words = jobs.select("job", F.explode("terms").alias("term"))
    tokens = blocks.select("block_id", F.explode(F.array_distinct(F.split(T.collapse_norm(F.col("text")), r"[^\p{L}\p{N}]+"))).alias("term"))
    hits = words.withColumn("term", F.lower("term")).join(tokens, "term").join(supplied, ["job", "block_id"], "left_anti").groupBy("job", "block_id").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("job").orderBy(F.desc("hits"), "block_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mentions(events: DataFrame) -> DataFrame:
    """One row per water-body reference, in order; events without one keep a row."""
    return events.select("event_id", F.posexplode_outer("waterbody_references").alias("position", "r")).select("event_id", "position", "r.*")


def ontology_tables(events: DataFrame, classes: DataFrame) -> dict[str, DataFrame]:
    """Normalised tables of events: concepts (with whether the class is known), evidence, quantities, categories."""
    known = classes.select(F.col("class").alias("ontology_concept"), F.lit(True).alias("known"))
    return {
        "event_concept": events.select("event_id", "ontology_concept").join(known, "ontology_concept", "left").select("event_id", "ontology_concept", F.coalesce("known", F.lit(False)).alias("known")),
        "event_evidence": events.select("event_id", F.posexplode("evidence").alias("position", "e")).select("event_id", "position", "e.*"),
        "event_value": events.select("event_id", F.posexplode("values").alias("position", "v")).select("event_id", "position", "v.*"),
        "event_category": events.select("event_id", F.explode("categories").alias("category")),
    }


def verified_batch(outputs: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outputs of ``outputs(document, content)`` whose SHA-256 is the manifest's, and (document, problem) for the rest."""
    joined = manifest.join(outputs.withColumn("_sha", F.sha2("content", 256)), "document", "left")
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "changed")
    marked = joined.withColumn("problem", problem)
    return marked.where("problem is null").select("document", "content"), marked.where("problem is not null").select("document", "problem")
