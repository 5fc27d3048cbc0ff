"""Shell lines, globs and paths in columns: regular expressions cut, array functions join; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All repetitions are possessive: no text makes the matcher step back, or nest calls.
_SINGLE, _DOUBLE, _ESCAPED = r"'[^']*+'", r'"(?:[^"\\]++|\\.)*+"', r"\\."
_QUOTED = f"{_SINGLE}|{_DOUBLE}|{_ESCAPED}"
#: Comments, redirections, separators, words: what a line is made of, from left to right.
_PIECE = rf"(?s)#[^\n]*+|[<>]++&?+|[;&|()\n]++|(?:[^\s;&|()<>'\"\\]++|{_QUOTED})++"
#: A line whose quotes all end.
_WHOLE = rf"(?s)\A(?:(?<![^\s;&|()<>])#[^\n]*+|[^'\"\\#]++|#|{_QUOTED})*+\\?\z"
_PART = rf"(?s){_QUOTED}|[^'\"\\]++"
#: Stand before a word and between commands while a line is put together again.
_WORD, _NEXT = "\x01", "\x02"
_ASSIGNED = r"^[A-Za-z_][A-Za-z0-9_]*="


def no_words() -> Column:
    return F.array().cast("array<string>")


def unquoted(word: Column) -> Column:
    """A word without its quotes and the signs that escape."""
    inner = lambda p: F.substr(p, F.lit(2), F.length(p) - 2)
    plain = lambda p: F.when(p.startswith("'"), inner(p)).when(p.startswith('"'), F.regexp_replace(inner(p), r'(?s)\\(["\\$`])', "$1")).when(p.startswith("\\"), F.substr(p, F.lit(2))).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit(_PART), F.lit(0)), plain), "")


def commands(line: Column) -> Column:
    """The words of each simple command of a line: array<array<string>>.

    Commands end at ``; & && | ||``, brackets and new lines outside of quotes. What follows a here-document's mark is text; so
    is what follows a # that begins a word, up to the line's end. Settings (``A=1``) before a command fall away, and commands of
    nothing else. A line with a quote that doesn't end is cut at white space alone. Null: none.
    """
    text = F.translate(F.regexp_replace(F.coalesce(line, F.lit("")), "(?s)<<.*", ""), _WORD + _NEXT, "  ")
    pieces = F.filter(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda p: ~p.startswith("#"))
    cut = F.transform(pieces, lambda p: F.when(p.rlike(r"\A[;&|()\n]"), _NEXT).otherwise(F.concat(F.lit(_WORD), unquoted(p))))
    blank = F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ; ")), r"\s+"), lambda w: w != "")
    cut_at_blanks = F.transform(blank, lambda w: F.when(w.isin(";", "&&", "||", "|", "&"), _NEXT).otherwise(F.concat(F.lit(_WORD), w)))
    again = F.array_join(F.when(text.rlike(_WHOLE), cut).otherwise(cut_at_blanks), "")
    words = F.transform(F.split(again, _NEXT, -1), lambda c: F.slice(F.split(c, _WORD, -1), F.lit(2), F.length(c) + 1))

    def without_settings(command: Column) -> Column:
        first = F.array_position(F.transform(command, lambda w: ~w.rlike(_ASSIGNED)), True).cast("int")
        return F.when(first > 0, F.slice(command, first, F.size(command))).otherwise(no_words())

    return F.filter(F.transform(words, without_settings), lambda c: F.size(c) > 0)


def _literal(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def matches_glob(path: Column, glob: Column) -> Column:
    """Whether a whole path fits a glob: ``*`` and ``?`` stay within a name, ``**`` goes across folders, ``{a,b}`` takes either."""
    either = lambda g: F.concat(F.lit("(?:"), F.array_join(F.transform(F.split(F.substr(g, F.lit(2), F.length(g) - 2), ",", -1), _literal), "|"), F.lit(")"))
    sign = lambda g: F.when(g == "**/", "(?:.*/)?").when(g == "**", ".*").when(g == "*", "[^/]*").when(g == "?", "[^/]").when(F.length(g) > 1, either(g)).otherwise(_literal(g))
    parts = F.transform(F.regexp_extract_all(glob, F.lit(r"(?s)\*\*/|\*\*|\{[^}]*+\}|."), F.lit(0)), sign)
    return F.rlike(path, F.concat(F.lit(r"(?s)\A"), F.array_join(parts, ""), F.lit(r"\z")))


def _components(path: Column) -> Column:
    """The names of an absolute path, . and .. being followed."""
    step = lambda way, name: F.when(name == "..", F.slice(way, F.lit(1), F.greatest(F.size(way) - 1, F.lit(0)))).otherwise(F.concat(way, F.array(name)))
    return F.aggregate(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), no_words(), step)


def holds_root(path: Column, root: Column) -> Column:
    """Whether a search from a path sees all of a project: no path, the working folder, the project's root or a folder above it."""
    own, way = _components(root), _components(F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", root, path)))
    above = (F.coalesce(root, F.lit("")) != "") & (F.size(way) <= F.size(own)) & (F.slice(own, F.lit(1), F.size(way)) == way)
    return path.isNull() | path.isin("", ".", "./") | F.coalesce(above, F.lit(False))
