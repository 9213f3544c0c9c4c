"""Jaccard self-join of documents on five-word shingles, by a MinHash LSH forest and exact verification.

1. One pass makes the signature of each document: one-permutation MinHash over 128 bins with
   optimal densification. A tree of the forest is a run of six bins; the document's label in
   it is that run, as sorted bytes, so a prefix of the label is a node of the tree's trie.
2. Documents with the same shingle set are one class; only classes go on.
3. The forest is descended from its leaves. At a depth, every node links its classes to its
   least one, as a star, never as all pairs; the components of these links hold all candidate
   pairs, which step 4 verifies. Each verified pair has a known similarity s, and pairs of that
   similarity meet at depth k in some of the L trees with probability p = 1 - (1 - s^k)^L. So
   pairs found / sum of 1/p estimates the share of pairs found so far. While that is under the
   target recall, the matched prefixes are shortened by one bin and the forest is read again:
   the prefix length follows the data. Tries are nested, so a shorter prefix only joins
   components of the longer one: just the links between them are followed, and just the
   components that grew are verified again.
4. Components are verified exactly: small ones together, up to a few hundred classes a
   task; a larger one is split into blocks, and each pair of blocks is one task, so no task
   ever holds more than two blocks. A task counts links with products of the 0/1 membership
   matrices of shingles, emits one row per class (its links, and the least class it is linked
   with), and no pairs.
5. Components of the verified links are the near-duplicate groups.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after folding A-Z. Defined results: a
document of 1 to 4 words has one shingle, all of its words; one without words (null, empty,
blank) is in no group but its own and has no links. Rows with equal texts, repeated rows
included, are copies: linked, and counted once each. Class ids are the least doc_id of a
group (null only if all of its ids are null), so groups whose least rows share an id share the
class id. An empty table gives an empty one; other columns may have any name. Set identity
rests on 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import textcodec as tc
from limnos.llm.components import components
from limnos.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
TREES, DEPTH = 21, 6
BINS = 128
#: Classes in a block of a large component, and, on average, in a task of small ones.
BLOCK, TOGETHER = 256, 96
#: Up to so many classes (under 20 MB of keys) are sent to the texts; the texts of more are shuffled to them.
SENT = 200_000
_U = np.uint64


def meeting(similarity, depth: int, trees: int = TREES):
    """Probability that two documents of that similarity share a prefix of ``depth`` bins in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _probes() -> np.ndarray:
    at = np.arange(64 * BINS, dtype=np.uint64).reshape(64, BINS)
    return (tc.mix(at + _U(0x51ED270B)) % _U(BINS)).astype(np.int64)


_PROBES = _probes()


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    hashes, pointer = tc.folded_words(data, at)
    all_ = tc.grams(hashes, size)
    out = []
    for lo, hi in zip(pointer[:-1].tolist(), pointer[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(all_[lo : hi - size + 1]))
        else:
            out.append(tc.grams(hashes[lo:hi], hi - lo, salt=hi - lo) if hi > lo else np.zeros(0, _U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted, non-empty set; empty bins borrow by a fixed probe sequence."""
    bins = (shingles >> _U(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, full = np.zeros(BINS, _U), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = shingles[first], True
    empty = np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(empty):
            return out
        take = probe[empty]
        out[empty[full[take]]] = out[take[full[take]]]
        empty = empty[~full[take]]
    out[empty] = shingles[0]
    return out


def trie_labels(signatures: np.ndarray) -> np.ndarray:
    """(documents, trees, 2 * DEPTH) bytes: the label of a document in each tree, two bytes a bin."""
    bins = tc.mix(signatures[:, : TREES * DEPTH]) >> _U(48)
    return bins.astype(">u2").view(np.uint8).reshape(-1, TREES, 2 * DEPTH)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tc.release()
    for batch in batches:
        for part, column in tc.chunks(batch, "text"):
            sets = shingle_sets(*tc.buffer_of(column))
            full = [k for k, s in enumerate(sets) if len(s)]
            fid, blank = np.zeros(len(sets), np.int64), np.ones(len(sets), bool)
            labels = np.zeros((0, TREES, 2 * DEPTH), np.uint8)
            if full:
                with np.errstate(over="ignore"):
                    digest = np.array([np.add.reduce(tc.mix(sets[k] ^ _U(0xA5A5A5A5A5A5A5A5))) + _U(len(sets[k])) for k in full], _U)
                fid[full] = tc.mix(digest).view(np.int64)
                labels = trie_labels(np.stack([signature(sets[k]) for k in full]))
            blank[full] = False
            n = len(full) * TREES
            flat = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 2 * DEPTH).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(labels))])
            pointer = np.concatenate([[0], np.cumsum(np.where(blank, 0, TREES))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(fid, mask=blank), pa.ListArray.from_arrays(pa.array(pointer), flat)],
                ["doc_id", "dk", "rk", "fid", "labels"],
            )


def _resolve_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tc.release()
    for batch in batches:
        for part, column in tc.chunks(batch, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(*tc.buffer_of(column))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], [*part.schema.names[:-1], "shingles"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by slices of the membership matrix."""
    n = len(sets)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, member = flat[order], member[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, member = column[often], member[often]
    shared = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1, 4096))
        for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(column)])):
            x = np.zeros((n, 4096), np.float32)
            x[member[lo:hi], column[lo:hi] - 4096 * k] = 1
            shared += x @ x.T
    return np.rint(shared).astype(np.int64)


def _verify(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tc.release()
        i, j = key[1].as_py(), key[2].as_py()
        fid = table.column("fid").to_numpy()
        _, one = np.unique(fid, return_index=True)
        table = table.take(pa.array(one))
        fid, copies, block = (table.column(c).to_numpy() for c in ("fid", "copies", "block"))
        comp = table.column("comp").to_numpy()
        arrays = table.column("shingles").combine_chunks()
        at, values = arrays.offsets.to_numpy(), arrays.values.to_numpy()
        sets = [values[a:b] for a, b in zip(at[:-1], at[1:])]
        shared = shared_counts(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        linked = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
        linked &= comp[:, None] == comp[None, :]
        if i != j:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        links, pairs = linked @ copies, linked.sum(1)
        # by depth: every pair stands for itself and for those of its similarity that the depth misses
        alike = np.where(linked, shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1), 1.0)
        weights = np.stack([np.where(linked, 1 / meeting(alike, depth), 0).sum(1) for depth in range(1, DEPTH + 1)], 1)
        label, near = np.arange(len(fid)), linked | np.eye(len(fid), dtype=bool)
        while True:
            lower = np.where(near, label[None, :], len(fid)).min(1)
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        return pa.table({"fid": fid, "links": links.astype(np.int64), "root": fid[label], "pairs": pairs.astype(np.int64), "weights": list(weights)})

    return run


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, dk, rk, text): a null-free key (dk, rk) of each row's id and text."""
    doc_id, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("dk"), F.xxhash64(text).alias("rk"), text.alias("text"))


class NearDuplicates:
    """The join's results: ``rows`` (doc_id, dk, rk, fid), ``classes`` (fid, copies, first, links, root)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> None:
        keyed = with_row_key(docs, id_col, text_col)
        signed = cut_lineage(keyed.mapInArrow(_sign, "doc_id long, dk long, rk long, fid long, labels array<binary>"))
        self.rows = signed.drop("labels")
        first = F.min(F.struct("doc_id", "dk", "rk")).alias("first")
        labelled = cut_lineage(signed.where("fid is not null").groupBy("fid").agg(F.count("*").alias("copies"), first, F.min("doc_id").alias("least_id"), F.any_value("labels").alias("labels")))
        classes = labelled.drop("labels")

        #: By depth, the estimated share of pairs found.
        self.recalls: dict[int, float] = {}
        candidates = cut_lineage(components(self._stars(labelled, DEPTH)))
        found = self._verified(candidates, classes, keyed, threshold)
        for depth in range(DEPTH, 0, -1):
            if depth < DEPTH:
                grown = self._grown(candidates, self._stars(labelled, depth))
                if not grown.isEmpty():
                    candidates = cut_lineage(candidates.join(grown, "node", "left_anti").union(grown))
                    again = self._verified(grown, classes, keyed, threshold)
                    found = cut_lineage(found.join(grown.select(F.col("node").alias("fid")), "fid", "left_anti").union(again))
            weight = F.element_at("weights", depth)
            pairs, total = found.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0.0))).first()
            self.recalls[depth] = pairs / total if pairs else 1.0
            if self.recalls[depth] >= recall:
                break
        self.links, verified = found.groupBy("fid").agg(F.sum("links").alias("links")), found.select(F.col("fid").alias("a"), F.col("root").alias("b"))
        groups = components(verified).select(F.col("node").alias("fid"), "root")
        self.classes = (
            classes.join(self.links, "fid", "left")
            .join(groups, "fid", "left")
            .select("fid", "copies", "first", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "fid").alias("root"))
        )

    @staticmethod
    def _stars(labelled: DataFrame, depth: int) -> DataFrame:
        """Links (a, b) of every class to the least one of each of its nodes at that depth."""
        leaves = labelled.select("fid", F.posexplode("labels").alias("tree", "label"))
        leaves = leaves.select("fid", F.xxhash64("tree", F.substring("label", 1, 2 * depth)).alias("key"))
        nodes = leaves.groupBy("key").agg(F.min("fid").alias("a"), F.max("fid").alias("z")).where("a <> z").select("key", "a")
        return leaves.join(nodes, "key").select("a", F.col("fid").alias("b"))

    @staticmethod
    def _grown(candidates: DataFrame, stars: DataFrame) -> DataFrame:
        """(node, root) of the components that further links join from those of ``candidates``, single classes included."""
        for end in ("a", "b"):
            known = candidates.select(F.col("node").alias(end), "root")
            stars = stars.join(known, end, "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
        joined = components(stars).select(F.col("node").alias("old"), F.col("root").alias("new"))
        members = candidates.join(joined, candidates["root"] == joined["old"]).select("node", F.col("new").alias("root"))
        single = joined.join(candidates, candidates["node"] == joined["old"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
        return cut_lineage(members.union(single))

    def _verified(self, candidates: DataFrame, classes: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
        """(fid, links, root, pairs, weights), perhaps several rows a class: documents of other classes it is linked to, and the figures of the estimate."""
        nodes = candidates.select(F.col("node").alias("fid"), F.col("root").alias("comp"))
        n = nodes.count()
        tasks = max(1, n // TOGETHER)
        # components of more than one block: at most one for BLOCK classes
        large = nodes.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
        large = F.broadcast(large) if n // BLOCK <= SENT else large
        nodes = nodes.join(large, "comp", "left").fillna(1, ["blocks"])
        placed = nodes.join(classes.select("fid", "copies", F.col("first.dk").alias("dk"), F.col("first.rk").alias("rk")), "fid")
        placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(fid), blocks) as int)"))
        placed = F.broadcast(placed) if n <= SENT else placed
        texts = placed.join(keyed.select("dk", "rk", "text"), ["dk", "rk"]).select("fid", "comp", "copies", "blocks", "block", "text")
        sets = texts.mapInArrow(_resolve_sets, "fid long, comp long, copies long, blocks int, block int, shingles array<long>")
        spread = sets.withColumn(
            "task",
            F.explode(
                F.expr(
                    f"if(blocks = 1, array(struct(pmod(xxhash64(comp), {tasks}L) as t, -1 as i, -1 as j)),"
                    " transform(sequence(0, blocks - 1), x -> struct(comp as t, least(x, block) as i, greatest(x, block) as j)))"
                )
            ),
        ).select("fid", "comp", "copies", "block", "shingles", "task.t", "task.i", "task.j")
        return cut_lineage(spread.groupBy("t", "i", "j").applyInArrow(_verify(threshold), "fid long, links long, root long, pairs long, weights array<double>"))

    def by_document(self) -> DataFrame:
        """One row per input row: doc_id, class_id (least doc_id of its group), n_links (documents of similarity at or over the threshold)."""
        named = self.classes.groupBy("root").agg(F.min("least_id").alias("class_id"))
        classes = self.classes.select("fid", "links", "root").join(named, "root").select("fid", "links", "class_id")
        joined = self.rows.select("doc_id", "fid").join(classes, "fid", "left")
        return joined.select("doc_id", F.when(F.col("fid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))

    def kept(self) -> DataFrame:
        """Keys (dk, rk) of the rows that stay: of each group the row least by (doc_id, text hash), and rows without words."""
        firsts = self.classes.groupBy("root").agg(F.min("first").alias("first")).select("first.dk", "first.rk")
        return firsts.union(self.rows.where("fid is null").select("dk", "rk").distinct())


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(docs, **options).by_document()


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns. Repeats of a row (same id and text) become one row, with or without words."""
    kept = NearDuplicates(docs).kept()
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    keyed = docs.select(tc.row_of(docs), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("dk"), F.xxhash64(text).alias("rk"))
    return keyed.join(kept, ["dk", "rk"], "left_semi").dropDuplicates(["dk", "rk"]).select("row.*")
