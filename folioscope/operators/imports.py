"""Imports between the files of a repository, for Python, TypeScript and JavaScript, and Rust.

Every file has keys by which it can be asked for, every statement asks for keys in an order of preference, and what means what is
one join of the two. Statements of scripts and Rust are found by patterns in columns; Python files are parsed, in Arrow batches,
for the bare facts of their import statements. Comments count as any text in scripts and Rust.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.storage import small_batches

# fixed values: endings of script files, in the order in which they are tried
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
LANGUAGES = {"python": (".py",), "ts/js": SCRIPTS, "rust": (".rs",)}
#: Files that stand for the folder they are in.
RUST_ROOTS = ("mod", "lib", "main")

ASKED = ("path", "language", "statement", "wish", "fallback", "preference", "key", "rooted")


def _language(path: Column) -> Column:
    return F.coalesce(*(F.when(reduce(Column.__or__, (path.endswith(e) for e in ends)), F.lit(name)) for name, ends in LANGUAGES.items()))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _join(*parts: Column) -> Column:
    """Parts of a path, empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def _normal(path: Column) -> Column:
    """A relative path without ``.`` and with its ``..`` followed; those that lead out of the root stay."""
    up = lambda way: (F.size(way) > 0) & (F.coalesce(F.try_element_at(way, F.lit(-1)), F.lit("..")) != "..")
    step = lambda way, name: F.when((name == "..") & up(way), F.slice(way, F.lit(1), F.size(way) - 1)).otherwise(F.concat(way, F.array(name)))
    return F.array_join(F.aggregate(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), F.array().cast("array<string>"), step), "/")


# --- what files are called -------------------------------------------------------------------


def keys(files: DataFrame) -> DataFrame:
    """(language, key, place, rooted, target) of files (path): the names a file can be asked for by, best first by ``place``.

    A name is ``rooted`` if the folder src was left out before it, as absolute imports may do.
    """
    path = F.col("path")
    no = F.lit(False)

    def called(key: Column, place: int | Column, rooted: Column = no, when: Column | None = None) -> Column:
        entry = F.struct(key.alias("key"), (F.lit(place) if isinstance(place, int) else place).cast("int").alias("place"), rooted.alias("rooted"))
        return entry if when is None else F.when(when, entry)

    package, module = path.rlike("(^|/)__init__[.]py$"), F.regexp_replace(path, "(/__init__)?[.]py$", "")
    python = [called(module, package.cast("int")), called(F.substr(module, F.lit(5)), 2 + package.cast("int"), F.lit(True), module.startswith("src/"))]
    ending = F.regexp_extract(path, "([.][a-z]+)$", 1)
    tried = F.array_position(F.array(*map(F.lit, SCRIPTS)), ending)
    bare = F.substr(path, F.lit(1), F.length(path) - F.length(ending))
    index = bare.endswith("/index")
    script = [called(path, 0), called(bare, tried), called(F.substr(bare, F.lit(1), F.length(bare) - 6), len(SCRIPTS) + tried, when=index)]
    folded = path.endswith("/mod.rs")
    rust = [called(F.regexp_replace(path, "(/mod)?[.]rs$", ""), folded.cast("int")), called(F.regexp_replace(path, "[.]rs$", ""), 0, when=folded)]
    own = F.when(F.col("language") == "python", F.array(*python)).when(F.col("language") == "ts/js", F.array(*script)).otherwise(F.array(*rust))
    each = files.select("path").distinct().withColumn("language", _language(path)).where("language is not null").select("path", "language", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("k"))
    return each.select("language", "k.key", "k.place", "k.rooted", F.col("path").alias("target"))


# --- what statements ask for -----------------------------------------------------------------


_FACTS = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("module", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_FACTS)
def _python_imports(texts: pd.Series) -> pd.Series:
    """The import statements of Python files: level (null: a plain import, of ``names``), module, names."""

    def facts(text: str) -> Iterator[dict]:
        try:
            nodes = ast.walk(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError, MemoryError):  # no Python
            return
        for node in nodes:
            names = [a.name for a in getattr(node, "names", ()) if isinstance(a, ast.alias)]
            if isinstance(node, ast.Import):
                yield {"level": None, "module": "", "names": names}
            elif isinstance(node, ast.ImportFrom):
                yield {"level": node.level, "module": node.module or "", "names": names}

    return texts.map(lambda t: list(facts(t or "")))


def _asked(rows: DataFrame, *, fallback: Column, preference: Column, key: Column, rooted: Column) -> DataFrame:
    values = {"fallback": fallback, "preference": preference.cast("int"), "key": F.nullif(key, F.lit("")), "rooted": rooted}
    return rows.withColumns(values).select(*ASKED)


def _python(files: DataFrame) -> DataFrame:
    """A name is the module below the statement's base; the base itself stands for names that are none."""
    rows = files.select("path", "language", F.posexplode(_python_imports(F.col("text"))).alias("statement", "s")).select("path", "language", "statement", "s.*")
    folders = F.split(_folder(F.col("path")), "/")
    above = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - F.col("level") + 1, F.lit(0))), "/")
    base = _join(F.when(F.col("level") > 0, above).otherwise(F.lit("")), F.replace(F.col("module"), F.lit("."), F.lit("/")))
    rooted, first = F.coalesce(F.col("level"), F.lit(0)) == 0, F.lit(0)
    names = rows.select("*", base.alias("base"), F.posexplode("names").alias("wish", "name"))
    names = _asked(names, fallback=F.lit(False), preference=first, key=_join(F.col("base"), F.when(F.col("level").isNull(), F.replace(F.col("name"), F.lit("."), F.lit("/"))).otherwise(F.col("name"))), rooted=rooted)
    whole = rows.where("level is not null").withColumns({"base": base, "wish": F.size("names")})
    return names.unionByName(_asked(whole, fallback=F.lit(True), preference=first, key=F.col("base"), rooted=rooted))


#: In all statements of scripts the name of what is asked for comes right after one of three words.
_NAMED = r"""(?<![\w$.])(?:from\s*|import\s*\(?\s*|require\s*\(\s*)(?:"([^"'\n]+)"|'([^"'\n]+)')"""


def _scripts(files: DataFrame) -> DataFrame:
    found = lambda group: F.regexp_extract_all("text", F.lit(_NAMED), F.lit(group))
    names = F.zip_with(found(1), found(2), lambda a, b: F.concat(a, b))
    rows = files.select("path", "language", F.posexplode(names).alias("statement", "name")).withColumn("wish", F.lit(0))
    near = F.col("name").rlike(r"^\.\.?/")
    return _asked(rows, fallback=F.lit(False), preference=F.lit(0), key=F.when(near, _normal(F.concat_ws("/", _folder(F.col("path")), F.col("name")))), rooted=F.lit(False))


#: A declaration up to its semicolon: the keyword, the path, the names in brackets behind it.
_DECLARED = r"(?m)^[^\S\n]*(?:pub(?:\([^)]*\))?\s+)?(mod|use)\s+([\w:]+)(\{[^}]*\})?\s*;"


def _rust(files: DataFrame) -> DataFrame:
    """Of a path the longest part that is a file is meant."""
    found = [F.regexp_extract_all("text", F.lit(_DECLARED), F.lit(g)) for g in (1, 2, 3)]
    rows = files.select("path", "language", F.posexplode(F.arrays_zip(*(f.alias(n) for f, n in zip(found, ("word", "head", "group"), strict=True)))).alias("statement", "d")).select("path", "language", "statement", "d.*")
    module, used = (F.col("word") == "mod") & F.col("head").rlike(r"^\w+$"), (F.col("word") == "use") & F.col("head").rlike(r"^(crate|super|self)(::\w+)*(::)?$") & ((F.col("group") != "") == F.col("head").endswith("::"))
    rows = rows.where(module | used)
    folder, stem = _folder(F.col("path")), F.regexp_extract("path", r"([^/]*)[.]rs$", 1)
    stands = stem.isin(*RUST_ROOTS)
    own, above = F.when(stands, folder).otherwise(_join(folder, stem)), F.when(stands, _folder(folder)).otherwise(folder)
    first = F.substring_index("head", "::", 1)
    bases = F.when(module, F.array(own)).when(first == "crate", F.array(F.lit("src"), F.lit(""))).when(first == "self", F.array(own)).otherwise(F.array(above))
    head = F.filter(F.split(F.when(module, F.concat(F.lit("self::"), "head")).otherwise(F.col("head")), "::"), lambda p: p != "")
    leaves = F.when(F.col("group") != "", F.transform(F.split(F.regexp_replace("group", r"[{}]", ""), ","), lambda n: F.substring_index(F.trim(n), "::", -1))).otherwise(F.array(F.lit("")))
    rows = rows.withColumns({"bases": bases, "parts": F.slice(head, F.lit(2), F.size(head))}).select("*", F.posexplode(leaves).alias("wish", "leaf"))
    rows = rows.withColumn("parts", F.filter(F.concat("parts", F.array("leaf")), lambda p: p != "")).select("*", F.posexplode("bases").alias("b", "base"))
    taken = F.posexplode_outer(F.reverse(F.when(F.size("parts") > 0, F.sequence(F.lit(1), F.size("parts"))))).alias("p", "n")
    rows = rows.select("*", taken)
    key = F.when(F.col("n") > 0, _join(F.col("base"), F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/")))
    return _asked(rows, fallback=F.lit(False), preference=F.col("b") * 1_000_000 + F.coalesce("p", F.lit(0)), key=key, rooted=F.lit(False))


def statements(files: DataFrame) -> DataFrame:
    """(path, language, statement, wish, fallback, preference, key, rooted): what the statements of files (path, text) ask for, name by name.

    Names that no repository holds have a null key; a name may have several keys, that of the least preference first. Texts that
    are null or can't be parsed have no statements.
    """
    small_batches(files.sparkSession)
    known = files.withColumn("language", _language(F.col("path")))
    of = lambda name, read: read(known.where(F.col("language") == name))
    return of("python", _python).unionByName(of("ts/js", _scripts)).unionByName(of("rust", _rust))


def resolved(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(path, language, statement, target): what each name of ``statements`` means among the files (path); no row for those that mean none."""
    key = ["path", "language", "statement", "wish", "fallback"]
    there = keys(files).withColumnRenamed("rooted", "_left_out")
    met = asked.where("key is not null").join(there, ["language", "key"]).where("rooted or not _left_out")
    best = met.groupBy(*key).agg(F.min_by("target", F.struct("preference", "place", "target")).alias("target"))
    names = asked.where("not fallback").select(key).distinct().join(best.select(*key, F.lit(True).alias("_found")), key, "left")
    symbols = names.groupBy("path", "statement").agg(F.max(F.col("_found").isNull()).alias("_symbol")).where("_symbol").drop("_symbol")
    return best.where("not fallback").unionByName(best.where("fallback").join(symbols, ["path", "statement"], "left_semi")).select("path", "language", "statement", "target")


def edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, dst) of the files (path, text), each once and none to itself; (language, seen, resolved) of their statements)."""
    asked = statements(files)
    found = resolved(asked, files)
    seen = asked.select("path", "language", "statement").distinct().groupBy("language").agg(F.count("*").alias("seen"))
    hit = found.select("path", "language", "statement").distinct().groupBy("language").agg(F.count("*").alias("resolved"))
    out = found.select(F.col("path").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()
    return out, seen.join(hit, "language", "left").select("language", "seen", F.coalesce("resolved", F.lit(0)).alias("resolved"))
