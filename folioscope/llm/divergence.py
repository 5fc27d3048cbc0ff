"""Quality by distribution divergence, in Spark's own functions only.

A document's histograms of character classes and of its language's common words are compared to references that are
counted over the whole corpus, by Jensen-Shannon distance (base 2, so from 0 to 1).  Short documents have wide
histograms by chance, so each comparison has a least length below which it isn't made.  The reference is the nearest
one of all languages: documents of mixed or wrongly named languages aren't punished for their label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.storage import checked_broadcast, materialised

SYMBOLS = "#*$%&|<>"
#: Character classes other than letters and, as ``other``, the rest; white space is in none.
CLASSES = {"symbol": SYMBOLS, "digit": "0123456789", "mark": ".,;:!?'\"()-"}
#: Common words of a language that make its histogram; languages up to which the references stand in the plan itself. Those of more are tables.
WORDS, LANGUAGES = 40, 64
#: Distances from which a document is rejected, and the least characters and words for a comparison.
FAR_CLASSES, FAR_WORDS, LEAST_CHARS, LEAST_WORDS = 0.3, 0.97, 200, 50
#: Distances (of classes, of words) that reject a document together.
BOTH = 0.11, 0.78

_WORD = "[^\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _of_class(rest: Column, letters: str) -> Column:
    """How many of the characters of a text stand in a class."""
    return F.length(F.regexp_replace(rest, "[^" + "".join(f"\\x{ord(c):02x}" for c in letters) + "]+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once: within a function of array elements it would be once for each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more in the text."""
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(ranked: Column) -> Column:
        """Of the windows (hash, place) in order of their hashes: each place that equals a neighbour covers three words."""
        same = F.filter(F.transform(ranked, lambda x, k: F.when((x["h"] == F.get(ranked, k - 1)["h"]) | (x["h"] == F.get(ranked, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(same), start, step, lambda a: a["n"])

    ranked = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked(h), covered))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), some)))


def _entropy_term(p: Column, q: Column) -> Column:
    """A summand of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


NAMES = ["letter", *CLASSES, "other"]


def _lowered() -> Column:
    """The words of a row's text in lower case; case doesn't change where words end."""
    return words_of(F.lower("text"))


def _top_words(rows: DataFrame) -> DataFrame:
    """(lang, word, count): the WORDS commonest words of each language."""
    words = rows.select("lang", F.explode(_lowered()).alias("word")).groupBy("lang", "word").count()
    first = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    return words.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= WORDS).drop("_r")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang").agg(*(F.sum(c).alias(c) for c in NAMES))


def references(rows: DataFrame) -> tuple[list[dict[str, float]], list[str], list[dict[str, float]]] | None:
    """Per language the shares of character classes; the common words of all; their shares among the common words of the language.

    Counted over all rows.  What comes to the driver is one row for each language and WORDS words; None for more than LANGUAGES.
    """
    sums = _sums(rows).limit(LANGUAGES + 1).collect()
    if len(sums) > LANGUAGES:
        return None
    classes = [{c: r[c] / total for c in NAMES} for r in sums if (total := sum(r[c] for c in NAMES))]
    by: dict = {}
    for r in _top_words(rows).collect():
        by.setdefault(r["lang"], {})[r["word"]] = r["count"]
    shares = [{w: n / sum(x.values()) for w, n in x.items()} for x in by.values()]
    return classes, sorted({w for x in shares for w in x}), shares


def _by_tables(rows: DataFrame) -> DataFrame:
    """(_row, far_classes, far_words) of rows that are written: the least distances to the references of all languages, which are tables.

    A language has few classes, so all of them go along as one row. Words meet the languages that have them among their common ones:
    with p a word's share in the document, the divergence is 1 less what the words in common take from it.
    """
    total = sum(F.col(c) for c in NAMES)
    refs = _sums(rows).where(total > 0).select(F.struct(*((F.col(c) / total).alias(c) for c in NAMES)).alias("q")).agg(F.collect_list("q").alias("_refs"))
    own = {c: F.try_divide(F.col(c), F.col("word_chars")) for c in NAMES}
    nearest = F.array_min(F.transform("_refs", lambda q: _distance([(own[c], q[c]) for c in NAMES])))
    classes = rows.join(F.broadcast(refs)).select("_row", F.when(F.size("_refs") == 0, 0.0).otherwise(F.least(nearest, F.lit(1.0))).alias("far_classes"))
    top = _top_words(rows)
    shares = materialised(top.select("lang", "word", (F.col("count") / F.sum("count").over(Window.partitionBy("lang"))).alias("share")), "shares")
    met = rows.select("_row", F.explode(_lowered()).alias("word")).join(checked_broadcast(shares.select("word").distinct()), "word").groupBy("_row", "word").count()
    met = met.select("_row", "word", (F.col("count") / F.sum("count").over(Window.partitionBy("_row"))).alias("p")).join(checked_broadcast(shares), "word")
    part = _entropy_term(F.col("p"), F.col("share")) - (F.col("p") + F.col("share")) / 2
    each = met.groupBy("_row", "lang").agg((1 + F.sum(part)).alias("d")).groupBy("_row").agg(F.min("d").alias("d"))
    words = each.select("_row", F.least(F.sqrt(F.greatest(F.lit(0.0), F.col("d"))), F.lit(1.0)).alias("far_words"))
    return classes.join(words, "_row", "left").select("_row", "far_classes", F.coalesce("far_words", F.lit(1.0)).alias("far_words"))


def _distance(pairs: list[tuple[Column, Column]]) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), sum((_entropy_term(p, q) for p, q in pairs), F.lit(0.0))))


def quality(docs: DataFrame) -> DataFrame:
    """Base measures, distances and verdict of every document.

    docs: doc_id, text, lang; other columns are ignored.  Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept (boolean), js_classes, js_words (double, null where the document is too
    short to compare).  A null or empty text has no words and fails the base rule.  A null lang counts as a language of
    its own.  All languages have references.  Rows are judged one by one; repeated ids are kept as rows; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    # one pass over the text leaves what is neither letter nor white space; classes are counted in that
    rows = rows.withColumns({"_rest": F.regexp_replace("text", "[\\p{L}\\x20\\x09-\\x0D]+", ""), "n_words": F.size("words"), "word_chars": F.length(F.array_join("words", ""))})
    rows = rows.withColumns({c: _of_class(F.col("_rest"), letters) for c, letters in CLASSES.items()} | {"letter": F.col("word_chars") - F.length("_rest")})
    rows = rows.withColumn("other", F.length("_rest") - sum(F.col(c) for c in CLASSES)).drop("_rest")
    found = references(rows)
    rows = rows if found else materialised(rows.drop("words"), "rows").withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chars, comparable = F.col("word_chars"), F.col("n_words") >= LEAST_WORDS
    long = (chars > 0) & (F.length("text") >= LEAST_CHARS)
    columns = [
        "_row", "doc_id", "lang", F.col("n_words").cast("long"), F.col("word_chars").cast("long"), F.col("symbol").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
    ]
    if found:
        classes, common, shares = found
        own = {c: F.col(c) / chars for c in NAMES}
        far = F.least(*(_distance([(own[c], F.lit(float(q.get(c, 0.0)))) for c in own]) for q in classes), F.lit(1.0), F.lit(1.0)) if classes else F.lit(0.0)
        measured = rows.select(*columns, F.when(long, far).alias("js_classes"), F.filter(_lowered(), lambda w: w.isin(common) if common else F.lit(False)).alias("_common"))
        measured = measured.withColumn("js_words", F.when(comparable, _word_distance(F.col("_common"), shares)))
    else:
        measured = rows.select(*columns, long.alias("_long")).join(_by_tables(rows), "_row").withColumns({"js_classes": F.when(F.col("_long"), F.col("far_classes")), "js_words": F.when(comparable, F.col("far_words"))})
    return measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("js_classes") < FAR_CLASSES, F.lit(True)) & F.coalesce(F.col("js_words") < FAR_WORDS, F.lit(True)) & ~F.coalesce((F.col("js_classes") >= BOTH[0]) & (F.col("js_words") >= BOTH[1]), F.lit(False))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_classes", "js_words"
    )


def _run_term(of: Column):
    def step(total: Column, run: Column) -> Column:
        share = F.coalesce(F.try_element_at(of, run["w"]), F.lit(0.0))
        return total + _entropy_term(run["p"], share) - share / 2

    return step


def _word_distance(common: Column, shares: list[dict[str, float]]) -> Column:
    """The least Jensen-Shannon distance of the document's common words to the references; 1 if it has none.

    Runs of equal words in the sorted array give the histogram; words that a document lacks add half their share.
    """
    n = F.size(common)

    def least(runs: Column) -> Column:
        out = []
        for q in shares:
            of = F.create_map(*(F.lit(x) for pair in q.items() for x in pair))
            out.append(F.sqrt(F.greatest(F.lit(0.0), F.aggregate(runs, F.lit(0.5), _run_term(of)))))
        return F.least(*out, F.lit(1.0), F.lit(1.0))

    def runs(ranked: Column, starts: Column) -> Column:
        return F.transform(starts, lambda i, k: F.struct(F.get(ranked, i).alias("w"), ((F.coalesce(F.get(starts, k + 1), F.size(ranked)) - i) / F.size(ranked)).alias("p")))

    first = lambda r: F.filter(F.transform(r, lambda w, i: F.when(i == 0, i).when(w != F.get(r, i - 1), i)), lambda i: i.isNotNull())
    whole = let(F.sort_array(common), lambda r: let(first(r), lambda s: let(runs(r, s), least)))
    return F.when(n == 0, F.lit(1.0)).otherwise(whole) if shares else F.lit(0.0)
