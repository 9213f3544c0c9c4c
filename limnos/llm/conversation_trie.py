"""The prefix trie of rebuilt conversations, families first.

A conversation c belongs to the family of c - c % FAMILY; it is rebuilt from the first h turns
of that base conversation and its own turns after the first h, with h = crc32(decimal c) % MODULUS.

1. Turns are dealt by ranges of the base id and sorted within them, base conversation first:
   the family's conversations come together, as in a cogroup, but as a stream, so that a
   conversation of any number of turns passes in bounded memory. Of a turn, only the SHA-256 of
   role and text and the number of bytes travel.
2. Each family's small trie is built in passing; only its combined nodes go on. A node is known
   by the chained digest of its turns. The ids of the conversations that end at a node are
   joined in ascending pieces over all families of a range, so a node at which a third of all
   conversations end is a few pieces a task.
3. Family nodes are merged by digest, pre-aggregated before the shuffle.
4. Subtree sums: a node with one member is a chain, whose sums are known. Among shared nodes,
   sums over descendants nearer than 2^k and pointers to the 2^k-th ancestor are doubled until
   the trie's depth is passed, a join and a grouping a round; ancestors with a large share of
   all nodes are looked up by broadcast.
5. The SHA-256 over a node's ids reads its pieces in order, as a stream.

Defined results: turns of a conversation are ordered by turn (null first), then role, then the
digest of role and text; null roles and texts are empty; a repeated row is a turn of its own;
rows without conv_id belong to no conversation; c % 5 has the sign of c; an empty table gives
no node, any other a root; other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.lookup import look_up
from limnos.session import store

FAMILY, MODULUS = 5, 9
#: Bytes of a piece of ids, and nodes of a family held before they are sent on.
PIECE, HELD = 1 << 15, 100_000
#: Ids held for pieces that are not full, per task.
OPEN_IDS = 200_000
ROOT = hashlib.sha256(b"").digest()[:16]
NODES = "node binary, parent binary, depth long, n_convs long, conv_id long, bytes long, ids string"


def taken(conv_id: int) -> int:
    """How many of its base's turns a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % MODULUS


class FamilyTrie:
    """The nodes of one family; sent on and begun anew beyond HELD, since all that is kept can be merged."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}

    def visit(self, node: bytes, parent: bytes | None, depth: int, size: int, conv: int) -> None:
        held = self.nodes.get(node)
        if held is None:
            self.nodes[node] = [parent, depth, 1, conv, size]
        else:
            held[2] += 1
            held[3] = min(held[3], conv)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, int, bool]]:
    """(base, conv, turn digest, bytes, whether the conversation goes on from the row before) of sorted rows."""
    last = None
    for batch in batches:
        for base, conv, digest, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
            yield base, conv, digest, size, conv == last
            last = conv


def family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of NODES: combined nodes family by family, and pieces of ids (with ``ids``, whose conv_id is the first)."""
    out: list[tuple] = []
    trie, lead, pieces, open_ids = FamilyTrie(), [], {}, 0  # lead: (node, bytes) of the base's first turns
    base = conv = None
    node, depth, at, h = ROOT, 0, 0, 0
    ended: list[tuple[int, bytes]] = []

    def descend(digest: bytes, size: int) -> None:
        nonlocal node, depth
        parent, node, depth = node, hashlib.sha256(node + digest).digest()[:16], depth + 1
        trie.visit(node, parent, depth, size, conv)

    def close() -> None:
        """The family's nodes and ends."""
        nonlocal open_ids, trie
        out.extend((k, *v, None) for k, v in trie.nodes.items())
        trie = FamilyTrie()
        for c, k in sorted(ended):
            pieces.setdefault(k, []).append(c)
        open_ids += len(ended)
        for k in {k for _, k in ended}:
            if len(pieces[k]) * 8 > PIECE:
                open_ids -= len(pieces[k])
                piece_out(k)
        ended.clear()
        if open_ids > OPEN_IDS:
            for k in list(pieces):
                piece_out(k)
            open_ids = 0

    def piece_out(k: bytes) -> None:
        ids = pieces.pop(k)
        out.append((k, None, None, None, ids[0], None, ",".join(map(str, ids))))

    for own_base, own, digest, size, on in conversations_of(batches):
        if not on:
            if conv is not None:
                ended.append((conv, node))
            if own_base != base:
                close()
                base, lead = own_base, []
            conv, node, depth, at, h = own, ROOT, 0, 0, taken(own)
            trie.visit(ROOT, None, 0, 0, conv)
            for d, s in [] if own == base else lead[:h]:
                descend(d, s)
        if own == base:
            if len(lead) < MODULUS - 1:
                lead.append((digest, size))
            descend(digest, size)
        elif at >= h:
            descend(digest, size)
        at += 1
        if len(trie.nodes) > HELD:
            out.extend((k, *v, None) for k, v in trie.nodes.items())
            trie = FamilyTrie()
        if len(out) >= 10_000:
            yield _batch(out)
            out.clear()
    if conv is not None:
        ended.append((conv, node))
    close()
    for k in list(pieces):
        piece_out(k)
    if out:
        yield _batch(out)


def ends_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of pieces sorted by node and first id."""
    last, running = None, hashlib.sha256()
    for batch in batches:
        done = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != last:
                if last is not None:
                    done.append((last, running.hexdigest()))
                last, running = node, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.binary(), pa.string()))], ["node", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["node", "ends_sha256"])


def subtree_sums(shared: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) from ``shared(node, parent, depth, n_leaves, saved_tokens)``, where the last two are each node's own."""
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    sums = store(shared.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"))
    for k in range(int(deepest).bit_length()):
        below = sums.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        further = look_up(sums, sums.select(F.col("node").alias("up"), F.col("up").alias("next")), "up")
        sums = store(further.join(below, "node", "left").select("node", F.col("next").alias("up"), *((F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved")))))
    return sums.drop("up")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = conversations[conv_col].cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where(conv.isNotNull()).select((conv - conv % FAMILY).alias("base"), conv.alias("conv"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), conversations[turn_col].alias("turn"), role.alias("role"))
    dealt = turns.repartitionByRange("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "role", "digest")
    found = store(dealt.select("base", "conv", "digest", "bytes").mapInArrow(family_nodes, NODES))
    merged = found.where("ids is null").groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"))
    merged = store(merged)
    single = F.col("n_convs") == 1
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(single).alias("single"))
    nodes = merged.join(children, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "single": F.coalesce("single", F.lit(0))})
    own_leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("single")).cast("long")
    sums = subtree_sums(nodes.where(~single).select("node", "parent", "depth", own_leaves.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")))
    pieces = found.where("ids is not null").select("node", "conv_id", "ids").repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ids")
    nodes = store(nodes.join(sums, "node", "left").join(pieces.mapInArrow(ends_hashes, "node binary, ends_sha256 string"), "node", "left"))
    parents = merged.where(~single).select(F.col("node").alias("parent"), F.col("conv_id").alias("shared_parent"))
    named = look_up(nodes, parents, "parent")
    return named.select(
        "conv_id",
        "depth",
        F.when(F.col("parent").isNotNull(), F.coalesce("shared_parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
