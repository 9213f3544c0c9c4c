import random

import pytest
from docs import frame, odd_documents, shaped
from tokenizers import Tokenizer

from limnos.llm import tokens


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter(tokens.default_vocabulary())


def test_counts_match_the_library(spark, counter):
    rows = odd_documents()
    library = Tokenizer.from_file(tokens.default_vocabulary())
    want = []
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    assert shaped(tokens.token_counts(frame(spark, rows)).collect()) == shaped(want)
    assert tokens.token_counts(frame(spark, [])).count() == 0


def test_every_prefix_is_exact(counter):
    rng = random.Random(2)
    texts = ["", " ", "a  b", "x\n\ny", "don't 'll <|endoftext|> z", "naïve çüé 東京 ９９", "a\nb c\n", "a\x1cb c", "12 345,67 !!! ??", "  \n\t x", "\u3000\u3000y \u2028", "a \n b\r\n c", "it's 'they'rest\"'s ''ve", "<|endoftext|><|startoftext|> <|endo", "q<|endoftext|>'s"]
    texts += ["".join(rng.choice("ab \n\t\r'\u3000é<|s.") for _ in range(40)) for _ in range(40)]
    texts += ["".join(rng.choice("abtheing AE'\n 1é.") for _ in range(60)) for _ in range(25)]
    for text in texts:
        exact = [len(counter.tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [counter.count(text, i) for i in range(len(text) + 1)] == exact, text
        for limit in (0, 1, 4, 15):
            assert counter.longest_within(text, limit) == max(i for i, n in enumerate(exact) if n <= limit)


def test_recurrence_within_a_piece(counter):
    table = tokens.PieceTable(tokens.default_vocabulary())
    rng = random.Random(4)
    for _ in range(60):
        piece = "".join(rng.choice("theinragos") for _ in range(rng.randint(1, 18)))
        exact = [len(counter.tokenizer.encode(piece[:i], add_special_tokens=False).ids) for i in range(len(piece) + 1)]
        assert table.counts(piece.encode()) == exact


def test_tables_hold_the_counts_of_prefixes(spark, counter):
    rows = odd_documents(n=12)
    tables = tokens.prefix_tables(frame(spark, rows))
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    for r in tables.collect():
        own = {t or "" for t in texts[r.doc_id]}
        assert not r.ends and own & {""} or any(r.ends and r.ends[-1] == len(t) for t in own)
        if len(own) == 1 and len(t := next(iter(own))) < 3000:
            assert r.tokens == [len(counter.tokenizer.encode(t[:e], add_special_tokens=False).ids) for e in r.ends]
            assert r.ends == sorted(set(r.ends))
    for r in tokens.tokens_up_to(tables, 40).collect():
        if len(texts[r.doc_id]) == 1 and (t := next(iter(texts[r.doc_id]))):
            assert r.exact_at <= 40 and r.tokens == len(counter.tokenizer.encode(t[: r.exact_at], add_special_tokens=False).ids)
    for r in tokens.truncated(frame(spark, rows), 7).collect():
        if len(texts[r.doc_id]) == 1 and (t := next(iter(texts[r.doc_id]))):
            assert t.startswith(r.text) and len(counter.tokenizer.encode(r.text, add_special_tokens=False).ids) <= 7
            if len(t) > len(r.text):
                assert len(counter.tokenizer.encode(t[: len(r.text) + 1], add_special_tokens=False).ids) > 7
    assert tokens.prefix_tables(frame(spark, [])).count() == tokens.truncated(frame(spark, [])).count() == 0
