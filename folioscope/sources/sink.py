"""A sink of page files that appear together: tasks write aside, the driver's commit puts in place, a failed job leaves nothing.

Each attempt of a task has a folder of its own below a hidden one of the job; the driver hears of that folder's name and how many
files it holds. Commit moves the files of the attempts that counted, each whole, over those that were there, and removes the
job's folder with whatever failed or doubled attempts left in it; abort only removes. A commit that is cut off has put some pages
in place, each whole; writing again puts all there. Page stores only ever read ``*.md`` at their top, so nothing aside is seen.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ASIDE = ".writing-"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    n: int


class _PageWriter(DataSourceWriter):
    def __init__(self, store: str):
        self.store, self.aside = store, os.path.join(store, ASIDE + uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> _Written:
        folder, n = os.path.join(self.aside, uuid.uuid4().hex), 0
        os.makedirs(folder)
        for slug, text in iterator:
            if not slug or "/" in slug or slug.startswith("."):
                raise ValueError(f"not a slug: {slug}")
            with open(os.path.join(folder, f"{slug}.md"), "w", encoding="utf-8") as f:
                f.write(text or "")
            n += 1
        return _Written(folder, n)

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for entry in os.scandir(m.folder) if m else ():
                os.replace(entry.path, os.path.join(self.store, entry.name))
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class PageFiles(DataSource):
    """Rows (slug, text) as files <slug>.md in the folder ``path``, which driver and executors share; mode append."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> _PageWriter:
        if overwrite:
            raise ValueError("pages are added or replaced one by one; other pages stay")
        return _PageWriter(self.options["path"])


def use(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)
