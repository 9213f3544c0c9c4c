"""URL filter: rules by host and path first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models over the characters of host and path are counted
from the URLs that a rule accepts and from those that a rule rejects, orders 0 to ORDER. The
probability of a character under a context of k characters leans on that under k - 1:
``p_k = (n(context, c) + a * p_{k-1}) / (n(context) + a)``; a context never seen leaves the
shorter one's value. A URL's figure is the difference of its log likelihoods per character,
and the threshold is where a logistic fit of the label to it, both sides weighted alike, gives
one half, on about a fifth of the labelled URLs that the counts leave out (by a hash of host and path).

A character with its context of ORDER is six bytes, so one integer names it exactly and nothing is
hashed. Counts are rows of a table that grows with the labelled URLs and stays distributed: those
of lower orders are sums over it, and a key meets at most 256 rows in any window; a common gram has
a row in each block that it goes back to. URLs are
scored in blocks of about BLOCK_CHARS characters, each with the figures of its own grams only.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and
is judged by the models as an empty string; repeated rows are judged alike; if rules label
nothing on one side, the models know nothing and allow. An empty table gives an empty one; only the
id and the url are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm import textcodec as tc
from limnos.session import store

ORDER = 5
WEIGHT = 2.0
BLOCK_CHARS = 1 << 18
#: One labelled URL in this many sets the threshold and is left out of the counts.
HELD_OUT = 5
#: (verdict, host, path), fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_START, _END = 2, 3


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.regexp_extract(F.substr(url, F.locate("://", url) + 3), "^[^/?#]*(/[^?#]*)?", 1)).otherwise("")


def by_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [((host == r[1]) | F.endswith(host, F.lit("." + r[1]))) & F.startswith(path, F.lit(r[2])) for r in ordered]
    pick = lambda values: reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(list(zip(fits, values))), F.lit(None).cast("string"))
    return pick([r[1] + r[2] for r in ordered]), pick([r[0] for r in ordered])


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, URL) of every character; the end counts as one. A gram holds the ORDER bytes before and the character's own, last."""
    lead = bytes([_START] * ORDER)
    raw = [lead + u.encode() + bytes([_END]) for u in urls]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    url = np.repeat(np.arange(len(raw)), sizes)
    first = np.cumsum(sizes) - sizes
    at = np.flatnonzero(np.arange(len(data)) - first[url] >= ORDER)
    gram = data[at - ORDER]
    for k in range(ORDER - 1, -1, -1):
        gram = gram << 8 | data[at - k]
    return gram, url[at]


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows over which all columns stay the same."""
    n = len(columns[0])
    turns = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
    return zip([0, *turns.tolist()] if n else [], [*turns.tolist(), n])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, block, allow) to (block, gram, allow, reject): every gram of the block, also of rows without a rule."""
    for batch in batches:
        for part, column in tc.chunks(batch, "text"):
            blocks = part.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in _runs(blocks):
                gram, url = _grams(column.slice(lo, hi - lo).to_pylist())
                side = part.column(2).slice(lo, hi - lo).fill_null(-1).to_numpy(zero_copy_only=False)[url]
                found, place = np.unique(gram, return_inverse=True)
                counts = [np.bincount(place[side == k], minlength=len(found)) for k in (1, 0)]
                for at in range(0, len(found), 50_000):
                    own = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[own]), blocks[lo])), pa.array(found[own]), *(pa.array(c[own].astype(np.int64)) for c in counts)], ["block", "gram", "allow", "reject"])


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, difference) for each row of ``counts(gram, allow, reject)``, from the models of all orders over it."""
    sides = ("allow", "reject")
    levels = [counts]
    for k in range(ORDER, 0, -1):
        levels.append(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(*(F.sum(s).alias(s) for s in sides)))
    below = None
    for k, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.shiftright("gram", 8))
        level = level.select("gram", *sides, *(F.sum(s).over(context).alias(f"{s}_context") for s in sides))
        if below is None:
            level = level.select("*", *(F.lit(1 / 256).alias(f"{s}_below") for s in sides))
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
            level = level.withColumn("shorter", shorter).join(below.select(F.col("gram").alias("shorter"), *(F.col(s).alias(f"{s}_below") for s in sides)), "shorter")
        below = level.select("gram", *(((F.col(s) + WEIGHT * F.col(f"{s}_below")) / (F.col(f"{s}_context") + WEIGHT)).alias(s) for s in sides))
    return below.select("gram", (F.log("allow") - F.log("reject")).alias("difference"))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, in each the grams in order and then the URLs, to the URLs with their ratio."""
    block, grams, differences, known = None, [], [], None
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        is_url = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        for lo, hi in _runs(blocks, is_url):
            if blocks[lo] != block:
                block, grams, differences, known = blocks[lo], [], [], None
            rows = batch.slice(lo, hi - lo)
            if not is_url[lo]:
                grams.append(rows.column(1).to_numpy(zero_copy_only=False))
                differences.append(rows.column(2).to_numpy(zero_copy_only=False))
                continue
            if known is None:
                known, grams, differences = (np.concatenate(grams), np.concatenate(differences)), [], []
            for part, column in tc.chunks(rows, "text"):
                gram, url = _grams(column.to_pylist())
                ratio = np.bincount(url, known[1][np.searchsorted(known[0], gram)], len(column)) / np.bincount(url, minlength=len(column))
                yield pa.RecordBatch.from_arrays([*part.columns[4:], pa.array(ratio)], [*part.schema.names[4:], "ratio"])


def held_out(text: Column) -> Column:
    """Whether a labelled URL, given as host and path, serves the threshold and not the counts: about one in HELD_OUT, repeats together."""
    return F.pmod(F.xxhash64(text), F.lit(HELD_OUT)) == 0


def threshold_of(scored: DataFrame) -> float:
    """The ratio at which a held-out row of ``scored(host, path, ruled, ratio)`` is as likely accepted as rejected.

    Where one side has no held-out rows, all labelled rows are taken; without labelled rows on one
    side, the threshold is below everything.
    """
    held = _threshold(scored.where(held_out(F.concat("host", "path"))))
    return _threshold(scored) if held == -np.inf else held


def _threshold(scored: DataFrame) -> float:
    """Logistic calibration of the ratio over cells of 1/200, both sides weighted alike; 0, where the models are equally likely, if it does not rise.

    Targets are those of one more row of the other side each, so that sides told apart entirely leave it finite.
    """
    allow = F.col("ruled") == "allow"
    cells = scored.where("ruled is not null").groupBy(F.floor(F.col("ratio") * 200).alias("cell")).agg(F.count_if(allow).alias("allow"), F.count_if(~allow).alias("block")).collect()
    n = np.array([(r.allow, r.block) for r in sorted(cells, key=lambda r: r.cell)], float).reshape(-1, 2)
    total = n.sum(0)
    if not total.all():
        return -np.inf
    at = (np.array(sorted(r.cell for r in cells)) + 0.5) / 200
    weight = n / total
    wanted = weight @ [(total[0] + 1) / (total[0] + 2), 1 / (total[1] + 2)]
    weight, x, fit = weight.sum(1), np.stack([at, np.ones(len(at))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        curve, slope = weight * p * (1 - p), x.T @ (wanted - weight * p) - 1e-6 * fit
        a, b, d = curve @ at**2 + 1e-6, curve @ at, curve.sum() + 1e-6
        step = np.array([d * slope[0] - b * slope[1], a * slope[1] - b * slope[0]]) / (a * d - b * b)
        fit = fit + step * min(1.0, 2 / np.abs(step).max()) if np.abs(step).max() > 0 else fit
    return float(-fit[1] / fit[0]) if fit[0] > 1e-9 else 0.0


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, ratio (log likelihood difference per character)."""
    url = pages[url_col].cast("string")
    parsed = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select(F.concat("host", "path").alias("text"), "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    chars = ruled.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).first().n or 0
    block = F.pmod(F.xxhash64("page_id", "text"), F.lit(1 + chars // BLOCK_CHARS)).alias("block")
    rows = store(ruled.select(block, "*").repartition("block").sortWithinPartitions("block"))
    allow = F.when(F.col("ruled").isNotNull() & ~held_out(F.col("text")), (F.col("ruled") == "allow").cast("int")).alias("allow")
    grams = store(rows.select("text", "block", allow).mapInArrow(_count, "block long, gram long, allow long, reject long"))
    values = log_ratios(store(grams.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("reject").alias("reject"))))
    needed = grams.select("block", "gram").join(values, "gram").select("block", "gram", "difference")
    both = needed.unionByName(rows, allowMissingColumns=True).select("block", "gram", "difference", "text", "page_id", "host", "path", "rule", "ruled")
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("gram").asc_nulls_last())
    scored = store(dealt.mapInArrow(_score, "page_id long, host string, path string, rule string, ruled string, ratio double"))
    other = F.when(F.col("ratio") >= float(threshold_of(scored)), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), "ratio")
