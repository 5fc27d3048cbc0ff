"""Token counts, decontamination, near duplicates, packing, toxicity and the pipeline against plain versions."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, jaccard_join, packing, token_counts, toxicity
from folioscope.llm.common import plain_words, shingle_set, window_hashes
from folioscope.llm.tokens import ByteBpe, WordBpe

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ODD = ["", "a", "it's we'll x'sy 'tis", "tab\t\n\n  two  \n", "naïve ﬁne ΣΑΣ İi ½ ²x", "日本語 text и ещё", "a b\u0085c\x1fd", "<|endoftext|> y", "é" * 70, "can't\r\n  stop!!! #*$%& 1234567 a1b2", "\x0b\x0c x"]


def docs(spark, texts, ids=None):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string, node string, n int")


# --- tokens ----------------------------------------------------------------------------------


def test_tokens_equal_the_libraries():
    word, byte = WordBpe(WORD), ByteBpe(BYTE)
    r = random.Random(4)
    texts = ODD + ["".join(r.choice("aZé'sßll .,!\n\t12½́Σ中²") for _ in range(40)) for _ in range(300)]
    for t, ids in zip(texts, word.encode(texts), strict=True):
        assert ids.tolist() == word.library.encode(t, add_special_tokens=False).ids
        assert "".join(byte.pieces(t)) == t and sum(byte.count(byte.pieces(t))) == len(byte.library.encode_ordinary(t))


def test_edits_equal_counting_anew():
    byte, r = ByteBpe(BYTE), random.Random(6)
    for _ in range(150):
        text = "".join(r.choice(["word ", "don't ", "  ", "\n", "12", "é", "!?", "x" * 30, " the"]) for _ in range(r.randint(0, 400)))
        tree = token_counts.build(text, byte)
        for _ in range(4):
            a = r.randint(0, len(text) + 3)
            text2 = text[: min(a, len(text))]
            b, new = a + r.choice([0, 1, 5, 60]), r.choice(["", " ", "'s", "new words here ", "\n\n", "z" * 90])
            want = text2 + new + text[max(min(a, len(text)), min(b, len(text))) :]
            text, again = token_counts.edit(text, tree, a, b, new, byte)
            assert text == want and tree.total == len(byte.library.encode_ordinary(text)) and sum(tree.chars) == len(text)
            assert [tree.prefix(k) for k in range(len(tree.tokens) + 1)] == [sum(tree.tokens[:k]) for k in range(len(tree.tokens) + 1)]


def test_an_edit_leaves_most_of_a_long_text():
    byte = ByteBpe(BYTE)
    text = "some words in a row, " * 20_000
    tree = token_counts.build(text, byte)
    _, again = token_counts.edit(text, tree, 200_000, 200_005, "other", byte)
    assert again < 2_000


def test_counts_query(spark):
    texts = [*ODD, None]
    got = token_counts.revised_counts(docs(spark, texts), tokenizer=BYTE, edits=[("n div 2", "n div 2 + 1", "new ")]).orderBy("doc_id").collect()
    lib = ByteBpe(BYTE).library
    for t, g in zip(texts, got, strict=True):
        t = t or ""
        new = t[: len(t) // 2] + "new " + t[len(t) // 2 + 1 :]
        assert (g["n_chars"], g["n_tokens"], g["n_tokens_edited"]) == (len(t), len(lib.encode_ordinary(t)), len(lib.encode_ordinary(new)))
    assert token_counts.revised_counts(docs(spark, []), tokenizer=BYTE, edits=[("0", "0", "x")]).count() == 0
    trees = token_counts.token_trees(docs(spark, ["a b c", "same"]), tokenizer=BYTE)
    edits = spark.createDataFrame([(0, 1, 0, None, None), (9, 1, 0, 0, "x")], "doc_id long, seq int, start long, end long, replacement string")
    out = token_counts.edited_trees(trees, edits, tokenizer=BYTE).orderBy("doc_id").collect()
    assert [(r["text"], r["sums"][1]) for r in out] == [("", 0), ("same", 1)]


# --- decontamination -------------------------------------------------------------------------


def greedy(a, b, least):
    """Greedy string tiling by trying all starts."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        ma[i : i + n] = [True] * n
        mb[j : j + n] = [True] * n
        total += n


def test_tiling_equals_greedy():
    r = random.Random(8)
    for _ in range(60):
        item = [r.choice("abcdef").encode() for _ in range(r.randint(5, 24))]
        doc = [r.choice("abcdef").encode() for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(item) - 1)
            doc += item[i : i + r.randint(3, 12)]
        seeds = decontaminate.Seeds([(1, item)], 3)
        got = seeds.coverage(doc, 0.0001)
        want = greedy(doc, item, 3) / len(item)
        assert (got[0][1] if got else 0.0) == pytest.approx(want)


def test_contamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    half = item.split()
    texts = ["x y " + item + " z", " ".join(half[6:] + ["and"] + half[:6]), "One, two THREE four five. six (seven) eight nine ten eleven twelve!", " ".join(half[:5]), None, "", " ".join(half[:5]) + " y", item, item]
    got = decontaminate.contamination(docs(spark, texts), spark.createDataFrame([(7, item), (3, item), (1, "too short"), (2, None)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [g["contaminated"] for g in got] == [True, True, True, False, False, False, False, True, True]
    assert got[0]["item_id"] == 3 and got[0]["n_items"] == 2 and got[0]["coverage"] == 1.0 and got[3]["item_id"] is None and got[3]["coverage"] == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(g["contaminated"] for g in decontaminate.contamination(docs(spark, texts), none).collect())
    assert decontaminate.without_contaminated(docs(spark, texts), spark.createDataFrame([(7, item)], "item_id long, text string")).count() == 4


# --- near duplicates -------------------------------------------------------------------------


def brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in (plain_words(t) for t in texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def corpus(seed, groups, size):
    """Groups of copies with words exchanged here and there, a passage that many share, and loners."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage, out = [word() for _ in range(40)], []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(30, 150))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [" ".join([word() for _ in range(r.randint(5, 60))] + passage) for _ in range(70)]
    out += [None, "", " \n", "a", "A", "a b", "one two three four", "One Two\tThree four", "é É", "x " * 3000]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "groups", "size"), [(1, 12, 6), (2, 1, 130)])
def test_components_equal_brute_force(spark, seed, groups, size):
    texts = corpus(seed, groups, size)
    sizes, roots = brute(texts)
    got = jaccard_join.jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [g["n_shingles"] for g in got] == sizes
    assert [g["component_id"] for g in got] == roots
    assert sum(g["representative"] for g in got) == len(set(roots))


def test_components_of_nothing(spark):
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0
    got = jaccard_join.jaccard_components(docs(spark, ["a b c d e f", "a b c d e f"], ids=[4, 4])).collect()
    assert [(g["doc_id"], g["component_id"]) for g in got] == [(4, 4), (4, 4)]


def test_regions_equal_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(40):
        base = r.integers(0, 60, size=25)
        sets = [np.unique(np.where(r.random(25) < 0.1, r.integers(0, 400, size=25), base)).astype(np.uint64) for _ in range(r.integers(2, 20))]
        classes = list(range(len(sets)))
        links = jaccard_join.region_links(sets, classes, 0, 75)
        def parts(pairs):
            p = list(range(len(sets)))
            def root(x):
                while p[x] != x:
                    x = p[x]
                return x
            for a, b in pairs:
                x, y = sorted((root(a), root(b)))
                p[y] = x
            return [root(i) for i in classes]
        every = [(i, j) for i in classes for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - k)]
        assert parts(links) == parts(every)
        for i, j in every:  # bounds never hide a link
            assert jaccard_join.may_link(jaccard_join.sketch(sets[i]), len(sets[i]), jaccard_join.sketch(sets[j]), len(sets[j]), 75)
            assert abs(jaccard_join.size_code(len(sets[i])) - jaccard_join.size_code(len(sets[j]))) <= jaccard_join.code_reach(75)


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["class"] for r in jaccard_join.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_long_texts_are_hashed_in_pieces():
    words = [f"w{i % 977}x{i % 13}".encode() for i in range(900_000)]
    whole = window_hashes(words, 5)
    assert len(whole) == len(words) - 4
    for at in (0, 449_998, 450_001, 899_995):
        assert whole[at] == window_hashes(words[at : at + 5], 5)[0]
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0


# --- packing ---------------------------------------------------------------------------------


def check_packing(rows, texts, room=4096):
    word = WordBpe(WORD)
    want = {i: [*word.library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    seen, filled = {}, {}
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen.keys() == want.keys()
    for i, parts in seen.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == len(want[i])
    padding = total = 0
    for parts in filled.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= room
        total += at
        padding += 0 if at & (at - 1) == 0 else room - at
    return padding / total


def test_packing(spark):
    r = random.Random(9)
    texts = [*ODD, None, *(" ".join(r.choice(["word", "another.", "end!", "it's", "Größe"]) for _ in range(r.randint(0, 700))) for _ in range(150)), "long sentence " * 9000]
    rows = packing.pack(docs(spark, texts).coalesce(1), tokenizer=WORD).collect()
    assert check_packing(rows, texts) < 0.02
    assert packing.pack(docs(spark, []), tokenizer=WORD).count() == 0
    assert packing.pack(docs(spark, ["a", "a"], ids=[3, 3]).coalesce(1), tokenizer=WORD).count() == 2


def test_cuts_have_least_cost():
    r = random.Random(11)
    for _ in range(200):
        ends = np.cumsum([r.randint(1, 6) for _ in range(r.randint(1, 12))])
        penalty = np.array([r.choice([0, 2, 5]) for _ in ends])
        got = packing.cuts(ends, penalty, 8)
        cost = dict(zip(ends.tolist(), penalty.tolist()))
        assert all(b - a <= 8 for a, b in zip([0, *got], got)) and ends[-1] - (got[-1] if got else 0) <= 8
        best = {0: 0}
        for j in ends.tolist():
            best[j] = cost[j] + 8 + min(c for i, c in best.items() if i >= j - 8)
        if got:
            assert sum(cost[j] + 8 for j in got) == best[got[-1]]


# --- toxicity --------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(12)
    bad = ["grumbo", "grumbix", "snarfle", "blortly"]
    word = lambda: "".join(r.choice(["ta", "ri", "mo", "len", "sel", "du"]) for _ in range(r.randint(1, 4)))
    texts, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(10, 80))]
        y = int(i % 5 == 0)
        for _ in range(3 * y):
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "s", "ta"])
        texts.append(" ".join(w))
        labels.append((i, y))
    texts += [None, "", "word " * 50_000]
    lab = spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")
    got = {g["doc_id"]: g for g in toxicity.toxicity(docs(spark, texts), lab).collect()}
    assert len(got) == 903 and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) and g["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, g in got.items())
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0
    kept = toxicity.without_toxic(docs(spark, texts), lab)
    assert kept.columns == ["doc_id", "text", "node", "n"] and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, g in got.items() if not g["predicted"])


def plain_ratio(word, texts, labels):
    """The word's log ratio from counts of all contexts that toxic documents have twice or more, by plain tables."""
    k, d, counts, lower, totals = toxicity.ORDER, toxicity.DISCOUNT, {}, {}, {}
    grams = lambda w, n: {s[i - n + 1 : i + 1] for s in [toxicity.spelled(w)] for i in range(k - 1, len(s))}
    for t, y in zip(texts, labels, strict=True):
        for g in (g for w in set(t.split()) for g in grams(w, k)):
            counts.setdefault(g[:-1], {}).setdefault(g, [0, 0])[1 - y] += 1
    for g in (g for w in {w for t in texts for w in t.split()} for n in range(1, k) for g in grams(w, n)):
        lower[g] = lower.get(g, 0) + 1
    for g, n in lower.items():
        x = totals.setdefault(g[:-1], [0, 0])
        x[0], x[1] = x[0] + n, x[1] + 1

    def share(g):
        rest = share(g[1:]) if g else 1 / 5000
        n, kinds = totals.get(g[:-1], (0, 0)) if g else (0, 0)
        return max(lower.get(g, 0) - d, 0) / n + d * kinds / n * rest if n else rest

    out = 0.0
    for i in range(k - 1, len(s := toxicity.spelled(word))):
        g = s[i - k + 1 : i + 1]
        known = counts.get(g[:-1], {})
        if sum(n[0] for n in known.values()) >= toxicity.SEEN:
            p = []
            for c in (0, 1):
                n, kinds = sum(x[c] for x in known.values()), sum(x[c] > 0 for x in known.values())
                p.append((max(known.get(g, (0, 0))[c] - d, 0) / n if n else 0) + (d * kinds / n if n else 1) * share(g[1:]))
            out += np.log(p[0] / p[1])
    return out


def test_toxicity_counts_all_contexts(spark):
    """More than 30,000 contexts, none of them left out."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(10))
    ids = [i for i in range(40) if toxicity.fold_of(i) != 2][:8]
    many, few = [word() for _ in range(5000)], [word() for _ in range(300)]
    texts = [" ".join(many), " ".join([*many, *few, "aaaaaaaaaaaa"]), *(" ".join([*few, *r.sample(many, 50)]) for _ in ids[2:])]
    labels = [int(i < 2) for i in range(len(ids))]
    model, _ = toxicity._fit(docs(spark, texts, ids), spark.createDataFrame(list(zip(ids, labels, strict=True)), "doc_id long, toxic int"))
    tried = [*r.sample(many, 20), *r.sample(few, 5), "aaaaaaaaaaaa", "unseen", many[0][:8] + "x", ""]
    assert len(model.unseen) > 30_000
    assert np.allclose(model.ratios(tried), [plain_ratio(w, texts, labels) for w in tried], rtol=1e-9, atol=1e-9)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {g["score"] < 1e-9 for g in toxicity.toxicity(docs(spark, ["a", None]), none).collect()} == {True}
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


# --- pipeline --------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("keyed", [False, True])
def test_a_thousand_repeats_of_linked_rows(spark, keyed):
    words = [f"w{i}" for i in range(300)]
    near, other = " ".join(words), " ".join([*words[:-3], "x", "y", "z"])
    rows = [(7, near)] * 1_000 + [(3, other)] * 1_000 + [(9, "something else"), (9, near)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.monotonically_increasing_id())
    found = jaccard_join.jaccard_components(table, row="_row" if keyed else None).collect()
    assert len(found) == len(rows) and sorted({(r.doc_id, r.component_id) for r in found}) == [(3, 3), (7, 3), (9, 3), (9, 9)]
    kept = [r for r in found if r.representative]
    assert len(kept) == (2 if keyed else 1_001) and {r.doc_id for r in kept} == {3, 9}


def test_pipeline(spark):
    import corpus_pipeline

    now = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = now.columns, now
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, DATA).cache()
        assert after.columns == columns, name
        if name == "near_duplicates":
            rows = now.orderBy("doc_id").collect()
            _, roots = brute([r["text"] for r in rows])
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(rows[i]["doc_id"] for i in set(roots))
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert not any(i in r["text"] for r in after.collect() for i in items)
        now = after
    assert now.count() < before.count()
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
    assert {r["doc_id"] for r in packed} == texts.keys()
    assert now.where(F.col("n_chars") != F.length("text")).count() == 0
