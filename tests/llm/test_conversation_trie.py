import hashlib
import random
import zlib
from collections import defaultdict

from docs import shaped

from limnos.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, node string, `a.b c` string"


def brute(rows):
    """Nodes as tuples of turns."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = (abs(c) // 5 * 5) * (1 if c >= 0 else -1)
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    joined = lambda p: ",".join(map(str, sorted(ends[p])))
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(joined(p).encode()).hexdigest()) for p, m in members.items()]


def conversations(seed=1, n=120):
    """Few distinct turns, so that tries branch; nulls, ties, repeats, gaps, absent bases, long and identical conversations."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(500, 700, 3), -1, -5, -7, 2**40]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 12])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "bé", None, "", "東京 " * 9]), "x", None))
    rows += [(c, t, "user", "same", None, None) for c in range(1000, 1060) for t in range(4)]
    rows += [(2000, t, "user", f"turn {t % 7}", None, None) for t in range(90)] + [(2010, t, "user", f"turn {t % 7}", None, None) for t in range(80)]
    rows += [rows[5], rows[5], (None, 1, "user", "no conversation", None, None), (3, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def test_nodes_match_brute_force(spark):
    rows = conversations()
    got = ct.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert shaped(got) == shaped(brute(rows))


def test_small_bounds_change_nothing(spark, monkeypatch):
    """Pieces, open ids and families that are sent on early merge to the same nodes."""
    rows = conversations(2, 60)
    for name, v in (("PIECE", 16), ("OPEN_IDS", 3), ("HELD", 2)):
        monkeypatch.setattr(ct, name, v)
    import pyarrow as pa

    def run(rows):
        frame = spark.createDataFrame(rows, SCHEMA)
        return ct.prefix_trie(frame).collect()

    assert shaped(run(rows)) == shaped(brute(rows))
    # the driver's own copy of the function sees the small bounds
    batch = pa.RecordBatch.from_pylist([{"base": 0, "conv": c, "digest": bytes([t]), "bytes": 1} for c in (0, 1, 2, 3, 4) for t in range(9)])
    out = [r for b in ct.family_nodes(iter([batch])) for r in b.to_pylist()]
    assert [r["ids"] for r in out if r["ids"]] and sum(r["n_convs"] or 0 for r in out if r["node"] == ct.ROOT and not r["ids"]) == 5


def test_few_conversations(spark):
    one = [(7, 0, "user", "hello", None, None), (7, 1, None, "there", None, None)]
    empty_base = [(9, 0, "u", "t", None, None)]
    for rows in ([], one, empty_base, one + empty_base, [(None, 0, "a", "b", None, None)]):
        assert shaped(ct.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()) == shaped(brute(rows))
