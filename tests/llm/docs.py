"""Small documents with the odd cases every operator must define."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, row int, `a.b c-d` string, kept string"
WORDS = "the onre thing of Ant ertion was häuser niño и не 東京 don't x1 42 éa under mit license cc by nc".split()


def odd_documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, near copies, clashing column names."""
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ". ", "\n", "  ", ", "]) for _ in range(k))
    texts = [None, "", " ", "\n\n", "one", "A b c d", "a\x1cb\tc\x0bd   e f", "<|endoftext|> x <|startoftext|>y"]
    texts += [prose(rng.choice([3, 20, 80, 300])) for _ in range(n)]
    texts += [prose(20_000), "same line again\n" * 500, "ab" * 6000, "z" * 3000]
    base = prose(400)
    texts += [base, base, base.replace("thing", "thong", 1), base + " tail", "lead " + base, prose(50) + base[:900] + prose(50)]
    rows = [(i, t, rng.choice([None, "en", "de"]), rng.choice([None, "s0"]), None if t is None else len(t), "h", 1, "o", None) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "a null id with some words", *[None] * 7), (None, base, *[None] * 7), (20, "another text under the same id", "en", "s1", 1, "x", 2, "p", "q")]
    return rows


def padded(rows):
    """Rows of all columns; shorter ones end in nulls."""
    return [(*r, *[None] * (9 - len(r))) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(padded(odd_documents() if rows is None else rows), SCHEMA)


def shaped(rows):
    """Rows as sorted tuples, for comparing bags."""
    return sorted((tuple(r) for r in rows), key=repr)
