"""Lines of Markdown: fences, sections, wiki links."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: A fence: three or more of one mark, at any indent.
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_SPAN = re.compile(r"(`+).*?(?<!`)\1(?!`)")
_LINK = re.compile(r"\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]")


def fenced(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Each line and whether it is a fence or stands behind an open one, which as many of its own marks close."""
    opener = ""
    for line in lines:
        mark = m[1] if (m := _FENCE.match(line)) else ""
        yield line, bool(mark or opener)
        if mark and not opener:
            opener = mark
        elif mark.startswith(opener) and opener:
            opener = ""


def sections(body: str) -> list[tuple[str | None, str]]:
    """(header, chunk): cut at second-level headings outside of fences; what precedes them, if anything, has no header."""
    heads: list[str | None] = [None]
    chunks: list[list[str]] = [[]]
    for line, code in fenced(body.splitlines(keepends=True)):
        if not code and line.startswith("## "):
            heads.append(line.strip())
            chunks.append([])
        chunks[-1].append(line)
    out = [(h, "".join(c)) for h, c in zip(heads, chunks, strict=True)]
    return out if out[0][1].strip() else out[1:]


def links(body: str) -> list[str]:
    """Targets of wiki links in order, duplicates kept; none from fences and code spans."""
    return [t.strip() for line, code in fenced(body.splitlines()) if not code for t in _LINK.findall(_SPAN.sub("", line))]
