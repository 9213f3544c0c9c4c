"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicons. Words and word beginnings (3 to 6 bytes) are counted over a bounded sample of
   labelled rows, ``SAMPLE_ROWS``, the least by a hash of the id; those that toxic rows hold
   far more often than others enter the lexicons, at most ``LEXICON`` of them. Beginnings
   catch inflected forms that no word list has.
2. Voters. Each lexicon kind is split into several voters by hash; fixed insult words, several
   distinct hits, and dense hits are voters of their own. They vote on every sampled row.
3. Label model. A two-class latent model of the votes, fitted by EM, with each voter's
   accuracies and the correlations that remain once the class is known, by which voters
   that repeat each other are discounted. It gives each sampled row a posterior; of the
   labels only their overall share is used here.
4. A logistic classifier over lexicon hits is trained on the posteriors and scores all rows,
   whole texts, in one narrow pass.

Labels of rows with crc32(id as text) mod 5 = 0 are never used; a null id counts as the
empty text there. Defined results: null and empty texts have no hits and get the score of a
hitless text; repeated rows score alike; without any usable label only the fixed words score; an
empty table of documents gives no rows. Columns of any other name are not read. Lexicon entries
of equal z are taken in the order of kind and hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm import textcodec as tc
from limnos.session import store

SAMPLE_ROWS = 8000
LEXICON = 2048
#: Word beginnings, in bytes; 0 is the whole word.
KINDS = (0, 3, 4, 5, 6)
VOTERS_PER_KIND = 4
#: Least sampled rows with a lexicon entry, least z of its log odds.
LEAST_ROWS, LEAST_Z = 5, 4.0
#: Least share of toxic rows among the sampled rows with an entry, smoothed.
LEAST_SHARE = 0.7
#: Common English insults, a fixed public word list.
INSULTS = "idiot idiots idiotic moron moronic stupid dumb dumbass loser losers pathetic worthless trash garbage scum scumbag clown disgusting imbecile jerk bastard bitch asshole shit fuck fucking crap freak vermin filth retard retarded ugly".split()
_U = np.uint64


def _entries(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, document of each word, entry hash) for each kind, over the words long enough."""
    data = tc.FOLD[data]
    start, end, pointer = tc.words(data, at, tc.FOLDED_WORD)
    rolling, doc = tc.RollingHash(data), tc.doc_of(pointer)
    for kind in KINDS:
        long = np.flatnonzero(end - start > kind) if kind else np.arange(len(start))
        stop = start[long] + kind if kind else end
        with np.errstate(over="ignore"):
            yield kind, doc[long], tc.mix(rolling.of(start[long], stop) + _U(kind * 0x9E3779B9 + 1))


def insult_hashes() -> np.ndarray:
    data, at = tc.buffer_of(pa.array([" ".join(INSULTS)], pa.large_string()))
    return next(_entries(data, at))[2]


@dataclass
class Lexicon:
    """Entries of all kinds, sorted by hash."""

    hashes: np.ndarray
    kinds: np.ndarray
    insult: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes & _U(0xFFFFF)).astype(np.int64)] = True

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, entry, times), each pair once."""
        pairs = []
        for _, doc, hashes in _entries(data, at):
            k = np.flatnonzero(self.sieve[(hashes & _U(0xFFFFF)).astype(np.int64)]) if len(self.hashes) else np.zeros(0, np.int64)
            if len(k):
                place = np.minimum(np.searchsorted(self.hashes, hashes[k]), len(self.hashes) - 1)
                real = self.hashes[place] == hashes[k]
                pairs.append(doc[k[real]] * len(self.hashes) + place[real])
        if not pairs:
            return (np.zeros(0, np.int64),) * 3
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        return pair // len(self.hashes), pair % len(self.hashes), times


def _emit_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (kind, entry, toxic), each entry once a row."""
    for batch in batches:
        for part, column in tc.chunks(batch, "text"):
            toxic = part.column(0).to_numpy(zero_copy_only=False)
            for kind, doc, hashes in _entries(*tc.buffer_of(column)):
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                one = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])) if len(doc) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), kind), pa.int32()), pa.array(hashes[one].view(np.int64)), pa.array(toxic[doc[one]], pa.int32())], ["kind", "entry", "toxic"])


def _emit_hits(lexicon: Lexicon):
    """(toxic, text) to (n_words, entries, times) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in tc.chunks(batch, "text"):
                data, at = tc.buffer_of(column)
                doc, entry, times = lexicon.hits(data, at)
                pointer = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                n = np.diff(tc.words(tc.FOLD[data], at, tc.FOLDED_WORD)[2])
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.ListArray.from_arrays(pa.array(pointer), pa.array(entry)), pa.ListArray.from_arrays(pa.array(pointer), pa.array(times))], ["n_words", "entries", "times"])

    return run


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> np.ndarray:
    """Posterior of the toxic class for each row of 0/1 votes: a two-class latent model, by EM.

    Each voter has a rate of votes in either class (its accuracies). What votes still share once
    the class is known is their correlation; a voter counts as one over the sum of its squared
    correlations with all voters, itself included, so voters that repeat each other count as one.
    ``prior``, the share of toxic rows, stays fixed, so the classes cannot drift to another
    split of the votes, and no voter may vote more often in the clean class.
    """
    x = votes.astype(float)
    n, k = x.shape
    q = np.where(x.any(1), 0.3 + 0.7 * x.mean(1), 0.02)
    for _ in range(rounds):
        mass = q.sum(), n - q.sum()
        rate1 = (q @ x + 0.5) / (mass[0] + 1)
        rate0 = np.minimum(((1 - q) @ x + 0.5) / (mass[1] + 1), rate1)
        rest = x - q[:, None] * rate1 - (1 - q)[:, None] * rate0
        covariance = rest.T @ rest / n
        scale = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        weight = 1 / np.maximum(((covariance / scale[:, None] / scale[None, :]) ** 2).sum(1), 1.0)
        odds = np.log(prior / (1 - prior)) + x @ (weight * np.log(rate1 / rate0)) + (1 - x) @ (weight * np.log((1 - rate1) / (1 - rate0)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q


def fit_classifier(row: np.ndarray, entry: np.ndarray, n: int, size: int, target: np.ndarray, rounds: int = 600, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier over 0/1 hits, for soft targets, by Nesterov steps."""
    w, bias = np.zeros(size), -1.0
    vw, vb = w.copy(), bias
    width = max(1.0, np.bincount(row, minlength=n).max(initial=0))
    step = 4.0 / (width * max(1.0, np.bincount(entry, minlength=size).max(initial=0)) + ridge)
    step_b = 4.0 / max(n * 2, 1)
    step, previous = max(step, 1e-3), (w, bias)
    for t in range(rounds):
        odds = np.bincount(row, vw[entry], n) + vb
        gap = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target
        w, bias = vw - step * (np.bincount(entry, gap[row], size) + ridge * vw), vb - step_b * gap.sum()
        m = t / (t + 3)
        vw, vb = w + m * (w - previous[0]), bias + m * (bias - previous[1])
        previous = (w, bias)
    return w, float(bias)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _votes(lexicon: Lexicon, sample: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, row, entry) of the sampled rows."""
    row = np.repeat(np.arange(len(sample)), [len(s["entries"]) for s in sample])
    entry = np.array([e for s in sample for e in s["entries"]], np.int64)
    times = np.array([t for s in sample for t in s["times"]], float)
    words = np.array([s["n_words"] for s in sample], float)
    n = len(sample)
    group = np.searchsorted(KINDS, lexicon.kinds) * VOTERS_PER_KIND + (lexicon.hashes >> _U(60)).astype(np.int64) % VOTERS_PER_KIND
    votes = np.zeros((n, len(KINDS) * VOTERS_PER_KIND + 4), bool)
    votes[row, group[entry]] = True
    votes[row[lexicon.insult[entry]], -4] = True
    distinct = np.bincount(row, minlength=n)
    votes[:, -3] = distinct >= 2
    votes[:, -2] = distinct >= 5
    votes[:, -1] = np.bincount(row, times, n) > 0.01 * np.maximum(words, 1)
    used = votes.mean(0) > 0
    return votes[:, used], row, entry


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        doc, entry, _ = self.lexicon.hits(data, at)
        odds = np.bincount(doc, self.weights[entry], len(at) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` labelled rows; what comes to the driver is bounded by ``rows`` and LEXICON."""
    usable = labels.select(labels["doc_id"].cast("long").alias("i"), labels["toxic"].cast("int").alias("toxic")).where("i is not null and toxic in (0, 1)").where(~held_out(F.col("i")))
    chosen = usable.groupBy("i").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("i"), "i").limit(rows)
    texts = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "i")
    # copies count once; read three times below, so the at most ``rows`` texts are written down
    texts = store(texts.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"))
    counted = texts.mapInArrow(_emit_entries, "kind int, entry long, toxic int").groupBy("kind", "entry").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    total = texts.agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    bad, good = total.a or 0, (total.n or 0) - (total.a or 0)
    insults = insult_hashes()
    found: list = []
    if bad and good:
        a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
        odds = F.log(a / (bad + 1.0 - a)) - F.log(b / (good + 1.0 - b))
        z = odds / F.sqrt(1 / a + 1 / b)
        found = counted.where(f"n >= {LEAST_ROWS} and (a + 0.5) / (n + 1) >= {LEAST_SHARE}").select("kind", "entry", z.alias("z")).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "kind", "entry").limit(LEXICON).collect()
    entries = {np.uint64(r.entry & (1 << 64) - 1): r.kind for r in found} | {h: 0 for h in insults}
    hashes = np.array(sorted(entries), _U)
    lexicon = Lexicon(hashes, np.array([entries[h] for h in hashes]), np.isin(hashes, insults))
    if not (bad and good):
        return Model(lexicon, np.where(lexicon.insult, 3.0, 0.0), -2.0)
    sample = texts.mapInArrow(_emit_hits(lexicon), "n_words long, entries array<long>, times array<long>").toArrow().to_pylist()
    votes, row, entry = _votes(lexicon, sample)
    posterior = fit_label_model(votes, min(max(bad / (bad + good), 0.01), 0.99))
    weights, bias = fit_classifier(row, entry, len(sample), len(hashes), posterior)
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in tc.chunks(batch, "text"):
                s = model.scores(*tc.buffer_of(column))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = docs[id_col].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
