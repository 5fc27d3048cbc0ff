"""Markdown pages as rows: finding a store, listing, tolerant reading, front matter; rendering and writing them."""

from __future__ import annotations

import os
import re
import stat
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.sources import sink

FOLDER, ENVIRONMENT = ".memory", "FOLIOSCOPE_DIR"
MANAGED = ("slug", "title", "kind", "created", "updated", "status", "superseded_by")
LISTS = ("sources", "supersedes")
SCHEMA = "slug string, title string, body string, path string, kind string, created string, updated string, status string, superseded_by string, sources array<string>, supersedes array<string>, extra map<string,array<string>>, extra_lists array<string>"


def find_store(start: str = ".") -> Path:
    """The environment's folder, else the nearest one upward, else the one that would be made here."""
    if found := os.environ.get(ENVIRONMENT):
        return Path(found)
    here = Path(start).resolve()
    return next((p / FOLDER for p in (here, *here.parents) if (p / FOLDER).is_dir()), here / FOLDER)


def store_problem(store: str | Path) -> str | None:
    store = Path(store)
    if store.is_symlink() and not store.exists():
        return "the store is a link to nothing"
    if store.exists() and not store.is_dir():
        return "the store is not a folder"
    return None


def page_paths(store: str | Path) -> list[str]:
    """Regular *.md files at the top of the store, sorted; links only if they end inside it."""
    root = Path(store)
    out = []
    if not root.is_dir():
        return out
    inner = root.resolve()
    for p in sorted(root.glob("*.md")):
        try:
            if stat.S_ISREG(p.stat().st_mode) and (not p.is_symlink() or p.resolve().is_relative_to(inner)):
                out.append(str(p))
        except OSError:
            continue
    return out


def unquote(value: str) -> str:
    """Without white space and one pair of equal quotes around it."""
    value = value.strip()
    return m[2] if (m := re.fullmatch(r"(['\"])(.*)\1", value, re.S)) else value


#: A front matter line: an entry of a list, or a key and what follows it.  Others (comments too) are passed over.
_ENTRY = re.compile(r"\s*-\s+(?P<item>.*)|(?!\s*#)(?P<key>[^:]*):(?P<value>.*)")


def front_matter(lines: list[str]) -> dict[str, str | list[str]]:
    """Scalars and lists by key; a key without a value begins a list."""
    meta: dict[str, str | list[str]] = {}
    last: list[str] | None = None
    for m in filter(None, map(_ENTRY.match, lines)):
        if m["item"] is not None:
            if last is not None:
                last.append(unquote(m["item"]))
            continue
        value = m["value"].strip()
        inline = re.fullmatch(r"\[(.*)\]", value, re.S)
        found = [u for x in inline[1].split(",") if (u := unquote(x))] if inline else unquote(value) if value else []
        meta[m["key"].strip()] = found
        last = found if isinstance(found, list) else None
    return meta


def parse(text: str, path: str) -> dict:
    """One page: front matter between --- lines at the very start, then the body."""
    head = re.match(r"---[^\S\n]*\n(?:(.*?)\n)??---[^\S\n]*(?:\n|\Z)", text, re.S)
    meta, body = (front_matter((head[1] or "").split("\n")), text[head.end() :].lstrip("\n")) if head else ({}, text)
    scalar = lambda k: v if isinstance(v := meta.get(k), str) and v else None
    entries = lambda v: v if isinstance(v, list) else [v] if v else []
    slug = scalar("slug") or Path(path).stem
    extra = {k: v for k, v in meta.items() if k not in MANAGED and k not in LISTS}
    row = {k: scalar(k) for k in MANAGED} | {k: entries(meta.get(k)) for k in LISTS}
    return row | {"slug": slug, "title": scalar("title") or slug.replace("-", " "), "body": body, "path": path, "extra": {k: entries(v) for k, v in extra.items()}, "extra_lists": [k for k, v in extra.items() if isinstance(v, list)]}


def _fields() -> T.StructType:
    """SCHEMA as a type, which needs no session."""
    of = {"string": T.StringType(), "array<string>": T.ArrayType(T.StringType()), "map<string,array<string>>": T.MapType(T.StringType(), T.ArrayType(T.StringType()))}
    return T.StructType([T.StructField(n, of[t]) for n, t in (x.strip().split(" ") for x in SCHEMA.split(", "))])


@F.pandas_udf(_fields())
def _parsed(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t, p) for t, p in zip(texts, paths, strict=True)], columns=_fields().names)


def read_pages(spark: SparkSession, store: str) -> DataFrame:
    """Rows of SCHEMA.  A local store is listed first, so that links out of it and pipes are passed by; another is globbed.

    Bytes that aren't UTF-8 become U+FFFD; an unreadable or missing store has no rows.
    """
    local = "://" not in store or store.startswith("file:")
    paths = page_paths(store.removeprefix("file://")) if local else [store]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load([f"file://{os.path.abspath(p)}" for p in paths] if local else paths)
    text = F.expr("make_valid_utf8(cast(content AS STRING))")
    return files.select(_parsed(text, F.regexp_replace("path", "^file:/*", "/")).alias("p")).select("p.*")


def find_page(pages: DataFrame, slug: str) -> DataFrame:
    """The first page in order of path whose own slug it is: one row or none."""
    return pages.where(F.col("slug") == slug).orderBy("path").limit(1)


def rendered(pages: DataFrame) -> Column:
    """The file of a page: managed fields in order, lists as blocks, other fields sorted, empty ones left out, then the body.

    Other fields that extra_lists names are lists, however many entries they have.
    """
    line = lambda k: F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f"{k}: "), F.concat(F.lit('"'), F.col(k), F.lit('"')) if k == "title" else F.col(k)))
    entries = lambda head, values: F.concat_ws("\n", head, F.transform(values, lambda x: F.concat(F.lit("  - "), x)))
    block = lambda k: F.when(F.size(F.coalesce(F.col(k), F.array().cast("array<string>"))) > 0, entries(F.lit(f"{k}:"), F.col(k)))
    parts = [*(line(k) for k in MANAGED if k in pages.columns), *(block(k) for k in reversed(LISTS) if k in pages.columns)]
    if "extra" in pages.columns:
        fields = F.array_sort(F.map_entries(F.coalesce("extra", F.expr("cast(map() as map<string,array<string>>)"))))
        is_list = lambda e: (F.array_contains(F.coalesce("extra_lists", F.array().cast("array<string>")), e["key"]) if "extra_lists" in pages.columns else F.lit(False)) | (F.size(e["value"]) > 1)
        one = lambda e: F.when(is_list(e), entries(F.concat(e["key"], F.lit(":")), e["value"])).when(F.coalesce(F.get(e["value"], F.lit(0)), F.lit("")) != "", F.concat(e["key"], F.lit(": "), e["value"][0]))
        parts.append(F.nullif(F.array_join(F.array_compact(F.transform(fields, one)), "\n"), F.lit("")))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *parts), F.lit("\n---\n\n"), F.coalesce("body", F.lit("")))


def exported(pages: DataFrame) -> Column:
    """The file of a page as another notes program takes it: title, type and body."""
    return F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\ntype: note\n---\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))


def write_pages(pages: DataFrame, store: str, text: Column | None = None) -> None:
    """One file per page, each put in place whole once all are written; see ``sink``.  The folder must be one that executors share.

    text: what is written of a page, by default ``rendered``.  Slugs must differ; of equal ones any stays.
    """
    sink.use(pages.sparkSession)
    pages.select("slug", (rendered(pages) if text is None else text).alias("text")).write.format("page_files").mode("append").save(store)


def current(pages: DataFrame) -> DataFrame:
    """Pages that no other supersedes."""
    return pages.where("superseded_by is null or superseded_by = ''")


def retargeted(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """sources renamed by (old, new), first places kept, doubles dropped; superseded pages stay as they are."""
    each = current(pages).select("slug", F.posexplode("sources").alias("pos", "old"))
    new = each.join(moves.groupBy("old").agg(F.min("new").alias("new")), "old", "left").select("slug", "pos", F.coalesce("new", "old").alias("source"))
    lists = new.groupBy("slug").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"])).alias("_sources"))
    return pages.join(lists, "slug", "left").withColumn("sources", F.coalesce("_sources", "sources")).drop("_sources")


def listed(pages: DataFrame) -> DataFrame:
    """Newest first, then by slug backwards."""
    from folioscope.functions.text import effective_date

    return pages.withColumn("updated", effective_date(F.col("updated"), F.col("created"))).orderBy(F.desc("updated"), F.desc("slug"))
