"""Text expressions: the tokenizer, white space, paths, snippets and small normalisers, as Spark columns."""

from __future__ import annotations

import posixpath
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of letters, numbers and underscores; the classes are those of Unicode.
WORD = r"[\p{L}\p{N}_]+"
BETWEEN = r"[^\p{L}\p{N}_]+"
#: Where an identifier falls into parts: underscores, and from small letter or digit to capital (Latin and Cyrillic).
PARTS = "_|(?<=[a-zа-яё0-9])(?=[A-ZА-ЯЁ])"
#: What a text has that holds such an identifier.
COMPOUND = "_|[a-zа-яё0-9][A-ZА-ЯЁ]"
#: Texts with marks to compose, or letters whose folding isn't that of lower() and ß, take the slow way.
SPECIAL = "[̀-ͯᄀ-ᇿİŉſǰͅͰ-Ͽևༀ-࿿Ꭰ-᏿ᲀ-᲏ẖ-ỿἀ-῿Ω-ÅꙀ-ꟿꬰ-ꮿ豈-ﭏ]"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column) -> Column:
    """Case folded: lower case, sharp s spelled out, the dot above of a lowered dotted I dropped."""
    return F.replace(F.replace(F.lower(word), F.lit("ß"), F.lit("ss")), F.lit("̇"), F.lit(""))


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _slow_tokens(texts: pd.Series, cut: bool) -> pd.Series:
    import regex

    words, parts = regex.compile(WORD), regex.compile(PARTS)

    def one(t):
        if t is None:
            return None
        out = []
        for w in words.findall(unicodedata.normalize("NFC", t)):
            own = [p for p in parts.split(w) if p] if cut else []
            out += [x.casefold().replace("̇", "") for x in ([w, *own] if len(own) > 1 else [w])]
        return out

    return texts.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded_slowly(texts: pd.Series) -> pd.Series:
    return _slow_tokens(texts, True)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _whole_slowly(texts: pd.Series) -> pd.Series:
    return _slow_tokens(texts, False)


def plain_tokens(text: Column, *, parts: bool = True) -> Column:
    """Tokens of composed text whose folding is plain: each word folded, and with ``parts``, if it has several, each of them too.

    A text without identifiers of several parts is folded and cut as a whole.
    """

    def of(w: Column) -> Column:
        own = F.filter(F.split(w, PARTS), lambda p: p != "")
        return let(own, lambda p: F.when(F.size(p) > 1, F.concat(F.array(fold(w)), F.transform(p, fold))).otherwise(F.array(fold(w))))

    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(fold(whole), BETWEEN), "")
    if not parts:
        return words
    each = F.flatten(F.transform(F.array_remove(F.split(whole, BETWEEN), ""), of))
    return F.when(whole.rlike(COMPOUND), each).otherwise(words)


def with_tokens(df: DataFrame, column: str, name: str = "tokens", *, exact: bool = True, parts: bool = True, **more: str) -> DataFrame:
    """The frame with the tokens of a text column, duplicates kept, in order; ``more`` names other tokens and their columns.

    With ``parts`` an identifier of several parts (under_score, camelCase, K9J) brings each of them beside itself.

    With ``exact`` the rows with SPECIAL letters, hardly any, go to Python in Arrow batches; all others stay in the JVM. Texts with
    as many bytes as letters have none and aren't searched for them.
    """
    wanted = {name: column} | more
    plain = {k: plain_tokens(F.col(c), parts=parts) for k, c in wanted.items()}
    if not exact:
        return df.withColumns(plain)
    odd = reduce(or_, (F.coalesce((F.octet_length(c) != F.length(c)) & F.col(c).rlike(SPECIAL), F.lit(False)) for c in wanted.values()))
    slowly = _folded_slowly if parts else _whole_slowly
    slow = {k: F.coalesce(slowly(F.col(c)), F.array().cast("array<string>")) for k, c in wanted.items()}
    return df.where(~odd).withColumns(plain).union(df.where(odd).withColumns(slow))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def unquoted(text: Column) -> Column:
    """Without a matched pair of quotes around it."""
    return F.regexp_replace(F.trim(text), "(?s)^([\"'])(.*)\\1$", "$2")


def title_of_slug(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit(" "))


def effective_date(updated: Column, created: Column) -> Column:
    return F.coalesce(F.nullif(updated, F.lit("")), F.nullif(created, F.lit("")), F.lit(""))


def entropy(run: Column) -> Column:
    """Shannon entropy of a string in bits per character; 0 for an empty one."""
    n = F.length(run)
    letters = F.array_distinct(F.split(run, ""))
    share = lambda c: (n - F.length(F.replace(run, c, F.lit("")))) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def is_slug(text: Column) -> Column:
    return F.coalesce(text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


@F.pandas_udf(T.StringType())
def path_key(paths: pd.Series) -> pd.Series:
    """A path's spelling for comparison: composed, without . and .. and doubled slashes."""
    return paths.map(lambda p: None if p is None else posixpath.normpath(unicodedata.normalize("NFC", p.replace("\\", "/"))))


def inside(path: Column) -> Column:
    """Whether a normal path stays below its root."""
    return ~path.startswith("/") & (path != "..") & ~path.startswith("../")


def path_prefixes(path: Column) -> Column:
    """The path and all directories above it, cut at whole components."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


# fixed values: units that stand one space behind their number
UNITS = "ms|s|secs?|seconds?|mins?|minutes?|kb|mb|gb"


def answer_form(text: Column) -> Column:
    """An answer for comparison: lower case, straight quotes, -> for arrows, one space, one between number and unit."""
    plain = F.translate(F.lower(text), "‘’“”", "''\"\"")
    plain = F.regexp_replace(plain, "[→⟶⇒]|=>", "->")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), rf"(\d)[\s-]*({UNITS})(?![\p{{L}}\p{{N}}_])", "$1 $2")


def has_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands in the answer form of a text on word borders (re: begins a pattern); null without phrases."""
    if not phrases:
        return F.lit(None).cast("boolean")
    form, before, behind = answer_form(F.coalesce(text, F.lit(""))), "(?U)(?<!\\w)", "(?!\\w)"
    patterns = [F.lit(f"{before}(?:{p[3:]}){behind}") if p.startswith("re:") else F.concat(F.lit(before + "\\Q"), answer_form(F.lit(p)), F.lit("\\E" + behind)) for p in phrases]
    found = [F.rlike(form, pattern) for pattern in patterns]
    return reduce(or_, found)


def source_key(source: Column) -> Column:
    """A cited path as code files are named: slashes, and no dots and slashes before it."""
    return F.regexp_replace(F.replace(F.trim(source), F.lit("\\"), F.lit("/")), "^[./]+", "")


def snippet(text: Column, terms: Column, width: int = 140, lead: int = 30) -> Column:
    """The window of a text that holds most different terms, from ``lead`` characters before the first of them."""
    whole = collapse(text)

    def cut(t: Column) -> Column:
        low = F.lower(t)
        found = F.filter(F.transform(F.array_distinct(terms), lambda q: F.position(q, low) - 1), lambda p: p >= 0)

        def best(places: Column) -> Column:
            counted = F.transform(places, lambda p: F.struct(F.size(F.filter(places, lambda o: (o >= p - lead) & (o < p - lead + width))).alias("n"), (-p).alias("p")))
            start = F.greatest(F.lit(0), F.coalesce(-F.array_max(counted)["p"], F.lit(0)) - lead)
            return F.concat(F.when(start > 0, "…").otherwise(""), F.substr(t, start + 1, F.lit(width)), F.when(start + width < F.length(t), "…").otherwise(""))

        return let(found, best)

    return let(F.coalesce(whole, F.lit("")), cut)
