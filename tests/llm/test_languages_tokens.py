"""References of many languages, and token ids by stretches of text."""

import random

import public_tokenizers
import pytest

from folioscope.llm import divergence
from folioscope.llm.tokens import WordBpe


def test_more_languages_than_the_plan_holds(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{r.randrange(i % 6 * 20, i % 6 * 20 + 60)}" if r.random() < 0.9 else "#1!" for _ in range(r.choice([3, 60, 120]))]
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words), None if i % 6 == 5 else f"l{i % 6}"))
    rows += [(100, None, "l1"), (101, "", "empty"), (102, "alone " * 80, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {x["doc_id"]: x for x in divergence.quality(docs).collect()}
    monkeypatch.setattr(divergence, "LANGUAGES", 2)
    got = {x["doc_id"]: x for x in divergence.quality(docs).collect()}
    assert got.keys() == want.keys() and sum(x["js_words"] is not None for x in got.values()) > 30
    for i, x in want.items():
        for c in x.asDict():
            assert got[i][c] == (pytest.approx(x[c], abs=1e-7) if isinstance(x[c], float) else x[c]), (i, c)


def test_ids_are_looked_up_by_stretches():
    bpe = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " \t\n", "It's Foo,bar! it's\nfoo,bar!", "x_1 ½² ÀÉ don't... 'll", "a b   odd\u0000", "<|endoftext|> é"]
    for _ in range(2):
        assert [x.tolist() for x in bpe.encode(texts)] == [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert "foo,bar!" in bpe.ids
