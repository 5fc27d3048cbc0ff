import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from folioscope.functions import text as T


def spec(text):
    """The tokenizer in plain Python."""
    out = []
    for w in regex.findall(r"[\p{L}\p{N}_]+", unicodedata.normalize("NFC", text or "")):
        parts = [p for p in regex.split(T.PARTS, w) if p]
        out += [x.casefold().replace("̇", "") for x in ([w, *parts] if len(parts) > 1 else [w])]
    return out


CASES = {
    "openTabGroup": ["opentabgroup", "open", "tab", "group"],
    "max_retry_count": ["max_retry_count", "max", "retry", "count"],
    "HTTP": ["http"],
    "Größe STRAẞE": ["grösse", "strasse"],
    "Й": ["й"],
    "İzmir": ["izmir"],
    "a_": ["a_"],
    "": [],
    "... --": [],
}


def test_tokens(spark):
    rows = [(k,) for k in CASES]
    got = {r["text"]: r["tokens"] for r in T.with_tokens(spark.createDataFrame(rows, "text string"), "text").collect()}
    assert got == CASES


def test_tokens_equal_the_specification_on_random_text(spark):
    r = random.Random(3)
    letters = "abzABZ019_ -.ßäÖéЙйŁłǅİσΣς́̈ﬁ中ｱ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(400)]
    got = T.with_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text").collect()
    assert all(row["tokens"] == spec(row["text"]) for row in got)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "want"), [("a/b/c.py", ["a", "a/b", "a/b/c.py"]), ("a/", ["a"]), ("a", ["a"])])
def test_path_prefixes(spark, path, want):
    assert one(spark, T.path_prefixes(F.col("p")), p=path) == want


def test_small_functions(spark):
    assert one(spark, T.collapse(F.col("t")), t=" a \t\n b ") == "a b"
    assert one(spark, T.strip(F.col("t")), t="\t x y \n") == "x y"
    assert one(spark, T.unquoted(F.col("t")), t="'it''") == "it'"
    assert one(spark, T.unquoted(F.col("t")), t="'it\"") == "'it\""
    assert one(spark, T.effective_date(F.col("u"), F.col("c")), u="", c="2024-01-02") == "2024-01-02"
    assert one(spark, T.entropy(F.col("t")), t="aabb") == pytest.approx(1.0)
    assert one(spark, T.entropy(F.col("t")), t="") == 0
    assert one(spark, T.answer_form(F.col("t")), t="Takes  10ms → “done”") == 'takes 10 ms -> "done"'
    assert one(spark, T.has_phrase(F.col("t"), ["tab group", "re:x+y"]), t="open the tab group now") is True
    assert one(spark, T.has_phrase(F.col("t"), ["tab gro"]), t="open the tab group now") is False
    assert one(spark, T.has_phrase(F.col("t"), []), t="a") is None
    assert one(spark, T.path_key(F.col("p")), p="./a//b/../c") == "a/c"
    assert one(spark, T.is_slug(F.col("p")), p="a-b2") is True
    assert one(spark, T.is_slug(F.col("p")), p="a--b") is False


def test_snippet(spark):
    text = "x " * 100 + "alpha and beta together" + " y" * 100
    got = one(spark, T.snippet(F.col("t"), F.array(F.lit("alpha"), F.lit("beta"))), t=text)
    assert "alpha and beta" in got and got.startswith("…") and got.endswith("…")
    assert one(spark, T.snippet(F.col("t"), F.array(F.lit("zz"))), t="short") == "short"
