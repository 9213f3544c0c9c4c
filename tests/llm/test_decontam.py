import hashlib
import re

from docs import frame, odd_documents, padded, shaped

from limnos.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        hit, names = set(), set()
        for name, t in items:
            v = words(t)
            m = min(10, len(v))
            for i in range(len(v) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[i : i + m]:
                        hit.update(range(p, p + m))
                        names.add(str(name))
        listed = ",".join(sorted(names))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def items_of(rows):
    t = [r[1] for r in rows if r[1] and len(words(r[1])) > 60]
    cut = lambda x, a, b: " ".join(words(x)[a:b]).upper()
    return [(1, cut(t[0], 5, 40)), (2, cut(t[1], 0, 10)), (10, "never seen " * 9), (9, cut(t[2], 7, 12)), (3, ""), (4, None), (1, cut(t[3], 2, 30)), (7, "another text")]


def test_report_matches_brute_force(spark):
    rows = [r for r in odd_documents(n=25) if len(r[1] or "") < 20_000]
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination_report(frame(spark, rows), bench).collect()
    assert shaped(got) == shaped(brute(rows, items))
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


def test_many_blocks_give_the_same(spark, monkeypatch):
    rows = [r for r in odd_documents(n=15) if len(r[1] or "") < 20_000]
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 50)
    assert shaped(decontam.contamination_report(frame(spark, rows), bench).collect()) == shaped(brute(rows, items))


def test_clean_documents_keep_their_columns(spark):
    rows = [r for r in odd_documents(n=15) if len(r[1] or "") < 20_000]
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.decontaminate(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert shaped(kept.collect()) == shaped(r for r, b in zip(padded(rows), brute(rows, items)) if not b[-1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination_report(frame(spark, []), none).count() == 0
    assert not any(r.contaminated for r in decontam.contamination_report(frame(spark), none).collect())


def test_longest_matches(spark, monkeypatch):
    rows = [r for r in odd_documents(n=25) if len(r[1] or "") < 20_000]
    items = [(str(i), t) for i, t in items_of(rows) + [(20, "same line again " * 40), (21, " ".join(words(rows[20][1])[:30]) + " and then " + " ".join(words(rows[21][1])[3:40]))]]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [(r[0], words(r[1])) for r in rows]

    def longest(v):
        """Length of the longest common run with any document, of 10 words or all."""
        best = 0
        for _, w in texts:
            last = [0] * (len(v) + 1)
            for x in w:
                last = [0] + [last[k] + 1 if x == y else 0 for k, y in enumerate(v)]
                best = max(best, *last)
        return best if best >= min(10, len(v)) and best else 0

    want = {}
    for i, t in items:
        n = longest(words(t)) if t else 0
        if n:
            want[i] = max(n, want.get(i, 0))
    for block in (1 << 21, 50):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        got = decontam.longest_matches(frame(spark, rows), bench).collect()
        assert {r.item_id: r.words for r in got} == want
        for r in got:
            own = [" ".join(w[r.start : r.start + r.words]) for i, w in texts if i == r.doc_id]
            assert any(s and s in " ".join(words(t)) for s in own for i, t in items if i == r.item_id)
    assert max(want.values()) > 30
