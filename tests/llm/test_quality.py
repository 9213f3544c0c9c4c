import re
from collections import Counter

from docs import frame, odd_documents, shaped

from limnos.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed)


def test_base_columns_match_brute_force(spark):
    rows = odd_documents()
    got = quality.quality_report(frame(spark, rows)).collect()
    assert shaped(tuple(r)[:7] for r in got) == shaped((r[0], *brute(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_fertility_separates_prose_from_noise(spark):
    prose = "The river gauge near the old mill was read every morning, and its keeper wrote the level of the water into a long ledger. " * 1
    prose += "When spring floods came the notes grew longer; they told of bridges under water, lost boats, and a pump which failed twice during one night while several neighbours carried sand to the dam by hand."
    noise = " ".join(f"{i * 7919 % 65521:x}Q%Z{i * 104729 % 9973:X}~^" for i in range(80))
    unknown = " ".join(chr(0x1F300 + i) + chr(0x13000 + i) for i in range(80))
    rows = [(1, prose, *[None] * 5), (2, noise, *[None] * 5), (3, "a " + unknown, *[None] * 5)]
    got = {r.doc_id: r.kept for r in quality.quality_report(frame(spark, rows)).collect()}
    assert got[1] and not got[2]


def test_figures_of_one_document():
    import numpy as np
    import pyarrow as pa

    from limnos.llm import textcodec as tc

    tokens = quality.WordTokens(quality.default_vocabulary())
    text = "water level water gauge \U00013000"
    f = quality.fertility(*tc.buffer_of(pa.array([text, None], pa.large_string())), tokens)
    ids = [i for w in text.split() for i in tokens.model.encode(w)]
    p = np.array(list(Counter(ids).values())) / len(ids)
    assert np.isclose(f["chars_per_token"][0], len(text.replace(" ", "")) / len(ids))
    assert np.isclose(f["byte_share"][0], sum(tokens.model.is_byte(i) for i in ids) / len(ids))
    assert np.isclose(f["entropy"][0], -(p * np.log2(p)).sum() / np.log2(len(ids)))
    assert f["chars_per_token"][1] == 0


def test_keep_good_keeps_columns(spark):
    assert quality.keep_good(frame(spark)).columns == frame(spark).columns
    assert quality.keep_good(frame(spark, [])).count() == 0


def test_bands_fitted_to_each_language(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    common = "the water level was read each morning and written down with care before people went home over old bridges near this river".split()
    prose = lambda: " ".join(rng.choice(common) for _ in range(90))
    strewn = lambda: " ".join(rng.choice(common) + rng.choice(["***", "$$$", "&&&", ""]) for _ in range(90))
    rows = [(k, prose(), "xx", *[None] * 4) for k in range(140)] + [(k, strewn(), "xx", *[None] * 4) for k in range(140, 150)]
    rows += [(k, strewn(), "yy", *[None] * 4) for k in range(150, 160)] + [(k, prose(), None, *[None] * 4) for k in range(160, 290)]
    got = {r.doc_id: r for r in quality.quality_report(frame(spark, rows)).collect()}
    for group, members in (("xx", range(150)), (None, range(160, 290))):
        passing = [got[k] for k in members if not got[k].base_failed]
        low, mid, high = np.percentile(np.round([r.chars_per_token for r in passing], 2), [25, 50, 75])
        least = mid - quality.DEVIATIONS * max((high - low) / 1.349, quality.LEAST_SPREAD * mid)
        assert all(abs(got[k].least - least) < 1e-5 for k in members), group
        assert all(r.kept == (r.chars_per_token >= least) for r in passing)
    assert not any(got[k].kept for k in range(140, 150)) and sum(got[k].kept for k in range(140)) > 130
    assert all(got[k].least is None and got[k].kept for k in range(150, 160))  # too few for a band of their own
    assert quality.quality_report(frame(spark, [])).count() == 0
    assert quality.quality_report(frame(spark, rows).drop("lang")).count() == len(rows)
