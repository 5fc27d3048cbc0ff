"""Search output, tool calls, imports, duplicates, corpora, sources that git and logs are."""

import json
import os
import subprocess

import numpy as np
from pyspark.sql import functions as F

from folioscope.functions.shell import commands, matches_glob
from folioscope.functions.text import path_key
from folioscope.operators import corpora, duplicates, freshness, imports, index, logstats, rank, search, similar, toolcalls
from folioscope.sources import git, logs, pages


def one(spark, make, *values):
    """What a column of literals is for each value or tuple of values."""
    return [spark.range(1).select(make(*(F.lit(x).cast("string") for x in (v if isinstance(v, tuple) else (v,)))).alias("x")).first()["x"] for v in values]


def test_shell_lines(spark):
    lines = {
        "A=1 B=2 grep -E 'a|b' x && cd y\nls | wc; echo \"a;b\"": [["grep", "-E", "a|b", "x"], ["cd", "y"], ["ls"], ["wc"], ["echo", "a;b"]],
        "cat <<E\nrm x": [["cat"]],
        "it's a": [["it's", "a"]],
        "A=1": [],
        "": [],
        "  ;; \n": [],
        "ls # it's a note; rm x\ncat a#b": [["ls"], ["cat", "a#b"]],
        "echo 'it'\"'\"'s' \"a \\\"b\\\" c\" d\\ e": [["echo", "it's", 'a "b" c', "d e"]],
        "grep '' . 2>/dev/null || true": [["grep", "", ".", "2", ">", "/dev/null"], ["true"]],
        "(cd x && ls) & find . \\( -name 'a b' \\)": [["cd", "x"], ["ls"], ["find", ".", "(", "-name", "a b", ")"]],
        "say \"it's; fine | here": [["say", '"it\'s;', "fine"], ["here"]],
        "x='a;b' y": [["y"]],
    }
    assert one(spark, commands, *lines) == list(lines.values())
    assert one(spark, commands, None) == [[]]
    long = "echo " + "'quoted' word\\ more; " * 50_000
    assert one(spark, lambda c: F.size(commands(c)), long) == [50_000]


def test_globs(spark):
    yes = [("*.md", "a.md"), ("**/*.md", "a.md"), ("**/*.md", "x/y/a.md"), ("a?.{md,txt}", "ab.txt"), ("**", "x/y"), ("{a", "{a"), ("a.b", "a.b"), ("{x\\E,y}", "x\\E"), ("(a)+", "(a)+")]
    no = [("*.md", "x/a.md"), ("a?", "a/"), ("*.md", "a.mdx"), ("a.b", "axb"), ("", "a")]
    assert all(one(spark, lambda g, p: matches_glob(p, g), *yes)) and not any(one(spark, lambda g, p: matches_glob(p, g), *no))


def judged(spark, cases):
    """(is_search, is_edit, scans, reads) of calls (name, input, root or error)."""
    rows = [(i, name, given, *(rest if rest else (None,))) for i, (name, given, *rest) in enumerate(cases)]
    found = toolcalls.classified(spark.createDataFrame([(*r, None) for r in rows], "i int, name string, input map<string,string>, root string, error boolean"), search_tool="search").orderBy("i").collect()
    return ["".join(x for x, f in zip("sewr", (r.is_search, r.is_edit, r.scans, r.reads)) if f) for r in found]


def test_scans_from_the_root_and_above(spark):
    sh = lambda line: ("Bash", {"command": line})
    cases = [
        (("Grep", {"path": "/p"}, "/p/q"), "w"), (("Grep", {"path": "/p/q/src"}, "/p/q"), ""), (("Grep", {"path": ".."}, "/p/q"), "w"), (("Grep", {"path": "../q/./x/.."}, "/p/q"), "w"), (("Grep", {"path": ".."}), ""),
        (sh("cd .memory && grep -n x a.md"), "w"), (sh("grep x .memory_"[:8]), ""), (sh("find / -path '*/.memory/*'"), "w"), ((*sh("find src -name '*.md'"), "/p"), ""), ((*sh("find /p -name '*.md' -print"), "/p"), "w"),
        (sh("cd .memory; cd ..; cat a"), ""), (sh("cd .memory; cat a; find . -name '*.py'"), "r"), (sh("grep -rl x"), "w"), (sh("grep -l x"), ""), (sh("grep -e r -e .memory src"), ""), (sh("grep --regexp=x .memory"), "w"),
        (sh("rg x"), ""), (sh("rg -uu x"), "w"), (sh("git grep x -- .memory"), "w"), (sh("git grep x .memory"), "w"), (sh("git grep .memory"), ""), (sh("echo 'grep -r x .'"), ""), (sh("X=1 folioscope search y | sed -n 1p .memory/a.md"), "sr"),
        (("search", {}), "s"), ((None, None), ""), (("Edit", {"file_path": "a/.memory/x"}), ""), (("Edit", {"notebook_path": "n"}), "e"), (("Read", {"file_path": ".memory/a"}), "r"), (("LS", {"path": "."}), ""), (("LS", {"path": ".memory"}), "w"),
        (("Glob", {"pattern": "**/*.md"}), "w"), (("Glob", {"pattern": "*.md"}), ""), (("Glob", {}), "w"), (("Grep", {"glob": "*.md"}), "w"), (("Grep", {"glob": "src/*.md"}), ""), (("Grep", {"type": "py"}), ""), (("Grep", {"pattern": ".memory", "path": "src"}), ""),
    ]
    assert judged(spark, [c for c, _ in cases]) == [want for _, want in cases]
    plan = toolcalls.classified(spark.createDataFrame([], "name string, input map<string,string>, error boolean"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_imports(spark):
    rows = {
        "src/app/__init__.py": "from .core import run\n", "src/app/core.py": "import app.util\nfrom . import util, missing\nfrom ..lib import x\n", "src/app/util.py": "def broken(:\n", "lib.py": "", "src/lib.py": "import os\nimport app\n",
        "web/a.ts": "import x from './b'\nexport {y} from './c/'\nconst z = require('./d.js'); import('react')", "web/b.tsx": "", "web/c/index.js": "", "web/d.js": "import './a'",
        "src/lib.rs": "mod net;\npub(crate) use crate::net::tcp::{Socket, Addr};\nuse self::nothing;", "src/net/mod.rs": "mod tcp;", "src/net/tcp.rs": "use super::Thing;\nuse super::udp;", "src/net/udp.rs": "", "README.md": "import x",
    }
    found, seen = imports.edges(spark.createDataFrame(list(rows.items()), "path string, text string"))
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == sorted([
        ("src/app/__init__.py", "src/app/core.py"), ("src/app/core.py", "src/app/util.py"), ("src/app/core.py", "src/app/__init__.py"), ("src/app/core.py", "src/lib.py"), ("src/lib.py", "src/app/__init__.py"),
        ("web/a.ts", "web/b.tsx"), ("web/a.ts", "web/c/index.js"), ("web/a.ts", "web/d.js"), ("web/d.js", "web/a.ts"),
        ("src/lib.rs", "src/net/mod.rs"), ("src/lib.rs", "src/net/tcp.rs"), ("src/net/mod.rs", "src/net/tcp.rs"), ("src/net/tcp.rs", "src/net/udp.rs"),
    ])
    assert {r["language"]: (r["seen"], r["resolved"]) for r in seen.collect()} == {"python": (6, 5), "ts/js": (5, 4), "rust": (6, 4)}


def test_imports_in_odd_places(spark):
    rows = {
        "a.py": "from b.c import *\nif x:\n    import b.c as q, nowhere\ntext = 'import d'\n", "b/__init__.py": "from ...up import y\nfrom . import c\n", "b/c.py": None, "d.py": "", "src/d.py": "", "up.py": "", "e.py": "import d",
        "w/x.mjs": "import{a}from'./y';export{b}from \"../w/z.jsx\";import type {T} from './t';a.require('./no');const q=await import( './y' );import '../../out'", "w/y.js": "", "w/y.ts": "", "w/z.jsx": "", "w/t/index.tsx": "", "out.js": "",
        "src/main.rs": "pub mod a;\n    use crate::a::b::Thing;\nuse crate::{a, c};\nuse std::fmt;\nuse crate::a::*;\nmod inline { }\n", "src/a.rs": "use self::b::X;\nuse super::c::{self, d::E};", "src/a/b.rs": "", "src/c/mod.rs": "", "none.txt": "import a",
    }
    found, seen = imports.edges(spark.createDataFrame(list(rows.items()), "path string, text string"))
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == sorted([
        ("a.py", "b/c.py"), ("b/__init__.py", "b/c.py"), ("b/__init__.py", "up.py"), ("e.py", "d.py"),
        ("w/x.mjs", "w/y.ts"), ("w/x.mjs", "w/z.jsx"), ("w/x.mjs", "w/t/index.tsx"),
        ("src/main.rs", "src/a.rs"), ("src/main.rs", "src/a/b.rs"), ("src/main.rs", "src/c/mod.rs"), ("src/a.rs", "src/a/b.rs"), ("src/a.rs", "src/c/mod.rs"),
    ])
    assert {r["language"]: (r["seen"], r["resolved"]) for r in seen.collect()} == {"python": (5, 5), "ts/js": (5, 4), "rust": (5, 5)}


def test_search_surface(spark):
    long = "words and words " * 20
    own = spark.createDataFrame([("a", "Tab", "tab " + long, "2024", "", None, ["src/x.py"]), ("b", "Other", "tab tab", "2025", "", None, []), ("c", "Third", long, "", "2023", "a", ["src/ui/y.py"])], "slug string, title string, body string, updated string, created string, superseded_by string, sources array<string>")
    asked = spark.createDataFrame([(1, "tab"), (2, "")], "qid int, q string")
    ix = index.build(own)
    found = search.matches(ix, own, asked, spark.createDataFrame([(1, "src/ui"), (2, "src")], "qid int, path string"))
    best = search.hits(found)
    assert [(r["qid"], r["slug"], r["score"] > 0) for r in best.orderBy("qid", "rank").collect()] == [(1, "a", True), (1, "c", False), (2, "a", False), (2, "c", False)]
    assert [(r["qid"], r["slugs"]) for r in search.skipped(found).collect()] == [(1, ["b"])]
    drift = spark.createDataFrame([("c", ["src/ui/y.py"], ["gone"])], "slug string, changed array<string>, gone array<string>")
    cards = search.described(best, own, rank.query_terms(asked), drift)
    rows = {(r["qid"], r["slug"]): r for r in cards.select("*", search.line().alias("line"), search.as_json().alias("json")).collect()}
    assert rows[1, "c"]["line"].endswith("2023  ▸ touches src/ui  ⚠ superseded by a  ⚠ source changed: src/ui/y.py  ⚠ source gone: gone")
    told = json.loads(rows[1, "a"]["json"])
    assert told["slug"] == "a" and told["superseded_by"] is None and told["touching"] == [] and told["score"] == round(told["score"], 3)
    assert search.hits(search.matches(ix, own, asked.limit(0))).count() == 0
    assert [r["slug"] for r in search.starting(own, "b").collect()] == ["b"]


def test_rendering_keeps_lists(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "p.md").write_text("---\nslug: p\ntitle: 'P'\ntags: [one]\nnone: []\nowner: me\n---\n\ntext\n")
    own = pages.read_pages(spark, str(tmp_path / "s"))
    assert own.select(pages.rendered(own).alias("t")).first()["t"] == '---\nslug: p\ntitle: "P"\nnone:\nowner: me\ntags:\n  - one\n---\n\ntext\n'
    pages.write_pages(own, str(tmp_path / "notes"), pages.exported(own))
    assert (tmp_path / "notes" / "p.md").read_text() == "---\ntitle: P\ntype: note\n---\n\ntext\n\n"


def test_log_of_several_appends(spark, tmp_path):
    import time

    for i in range(3):
        logs.append_log(spark.createDataFrame([(f"2024-01-0{i + 1}", "search", 10 * i + k) for k in range(4)], "ts string, event string, hits int").coalesce(1), str(tmp_path / "log"))
        time.sleep(1.1)
    rows = logs.read_log(spark, str(tmp_path / "log")).orderBy("line_no").collect()
    assert [r["hits"] for r in rows] == [10 * i + k for i in range(3) for k in range(4)]
    (tmp_path / "one.jsonl").write_text('{"event": "x"}\n[1]\n{"ts": "2024", "event": "y"}\n{torn')
    assert [r["event"] for r in logs.read_log(spark, str(tmp_path / "one.jsonl"), timed=False).orderBy("line_no").collect()] == ["x", "y"]


def test_stream_summary(spark):
    lines = [{"type": "system", "subtype": "init", "model": "m", "skills": ["a", "b"]}, {"type": "system", "subtype": "init", "model": "late"}, {"type": "result", "result": "no"}, {"type": "result", "result": "yes", "num_turns": 4, "is_error": False}]
    df = spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(lines)] + [("t", 0, "torn")], "session string, line_no int, value string")
    got = {r["session"]: r for r in logs.stream_summary(df).collect()}
    assert (got["s"]["model"], got["s"]["n_skills"], got["s"]["answer"], got["s"]["num_turns"]) == ("m", 2, "yes", 4)
    assert (got["t"]["model"], got["t"]["n_skills"], got["t"]["answer"], got["t"]["num_turns"]) == (None, 0, "", None)


def test_git(spark, tmp_path):
    run = lambda *w: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *w], check=True, capture_output=True)
    assert git.commits(spark, str(tmp_path / "none")) is None and git.tracked_files(spark, str(tmp_path / "none")).count() == 0
    run("init")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "é.py").write_text("1")
    (tmp_path / "b.py").write_text("1")
    run("add", ".")
    run("commit", "-m", "one", "--date", "2020-01-01T00:00:00")
    (tmp_path / "b.py").write_text("2")
    run("commit", "-am", "two")
    assert sorted(r["path"] for r in git.tracked_files(spark, str(tmp_path)).collect()) == ["b.py", "src/é.py"]
    got = git.commits(spark, str(tmp_path))
    assert got.groupBy("path").count().orderBy("path").collect() == [("b.py", 2), ("src/é.py", 1)]
    assert [r["path"] for r in git.commits(spark, str(tmp_path / "src")).collect()] == ["é.py"]


def test_git_history_in_ranges(spark, tmp_path):
    run = lambda *w, at=1_600_000_000: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *w], check=True, capture_output=True, env=os.environ | {"GIT_COMMITTER_DATE": f"{at} +0000"})
    run("init", "-b", "main")
    (tmp_path / "pages").mkdir()
    names = ["pages/a.md", "b c.py", "e\u0301.py", "d\"q.py"]
    for i in range(40):
        name = names[i % 4] if i < 30 else "busy.py"
        (tmp_path / name).write_text(str(i))
        run("add", ".")
        run("commit", "-m", str(i), at=1_600_000_000 + i)
    run("checkout", "-b", "side", "HEAD~5")
    (tmp_path / "side.py").write_text("s")
    run("add", ".")
    run("commit", "-m", "side", at=1_600_000_050)
    run("checkout", "main")
    run("merge", "--no-ff", "side", "-m", "merge", at=1_600_000_060)
    whole = git.commits(spark, str(tmp_path), step=7)
    assert whole.rdd.getNumPartitions() == 6
    want = {"pages/a.md": 28, "b c.py": 29, "\u00e9.py": 26, "d\"q.py": 27, "busy.py": 39, "side.py": 50}
    assert {r.path: r.ct - 1_600_000_000 for r in freshness.last_commits(whole).collect()} == want
    assert whole.where("path = 'busy.py'").count() == 10 and whole.where(F.col("path").isin("\u00e9.py", "none")).count() == 7
    assert [r.path for r in git.commits(spark, str(tmp_path / "pages")).distinct().select("path").distinct().collect()] == ["a.md"]
    wanted = spark.createDataFrame([(p,) for p in ["busy.py", "b c.py", "never.py", None]], "path string")
    assert {r.path: r.ct - 1_600_000_000 for r in git.newest(spark, str(tmp_path), wanted, first=4).collect()} == {"busy.py": 39, "b c.py": 29}
    assert git.newest(spark, str(tmp_path / "none"), wanted) is None
    pages = spark.createDataFrame([("a", "pages/a.md", 0.0)], "slug string, path string, mtime double")
    cited = spark.createDataFrame([("a", p) for p in ["busy.py", "\u00e9.py", "b c.py", "gone.py"]], "slug string, source string")
    files = git.tracked_files(spark, str(tmp_path)).select(path_key("path").alias("path"))
    assert [tuple(r) for r in freshness.drift(pages, cited, whole, files).collect()] == [("a", ["b c.py", "busy.py"], ["gone.py"])]


def test_corpora(spark):
    own = spark.createDataFrame([(i, f"p{i}", f"Title {i}", "body") for i in range(10)], "place long, slug string, title string, body string")
    made = corpora.stubs(own)
    assert [r["slug"] for r in made.orderBy("place").collect()] == ["p0-summary", "p1-summary"] and "title 0" in made.first()["body"]
    assert sorted(r["slug"] for r in corpora.stubs_for_share(made, 10, 0.35).collect()) == ["p0-summary", "p0-summary-1-0", "p0-summary-2-0", "p1-summary", "p1-summary-1-1"]
    assert corpora.grown(own, 25).count() == 25 and corpora.grown(own, 25).where("slug = 'p4-2'").count() == 1 and corpora.grown(own, 4).count() == 4
    entries = spark.createDataFrame([("n", "N", "bug", "x", ["b", "a", "b"], ["o"]), ("o", "O", "bug", "y", ["a"], [])], "slug string, title string, kind string, body string, sources array<string>, supersedes array<string>")
    got = {r["slug"]: r for r in corpora.corpus_pages(entries, "2024-01-01").collect()}
    assert got["o"]["superseded_by"] == "n" and got["o"]["status"] == "superseded" and got["n"]["sources"] == ["a", "b"] and got["n"]["status"] is None


def test_duplicates(spark):
    own = spark.createDataFrame([("a", ["b", "nobody"]), ("b", []), ("c", [])], "slug string, supersedes array<string>")
    assert sorted((r["slug"], r["partner"]) for r in duplicates.partners(own).collect()) == [("a", "b"), ("b", "a")]
    scores = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (2, 3, 0.4)], "i int, j int, score double")
    row = duplicates.per_pair(scores, spark.createDataFrame([(1, 2)], "i int, j int"), 0.5).first()
    assert (row["threshold"], row["recall"], row["fpr"]) == (0.5, 1.0, 0.5)
    best = duplicates.verdict(spark.createDataFrame([("x", 0.4), ("y", 0.6)], "name string, recall double")).first()
    assert best["name"] == "y" and best["build"]


def test_vectors_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[7].tolist())], "id long, v array<double>")
    asked = rows.where("id % 5 = 0").select(F.col("id").alias("qid"), "v")
    one, many = (sorted(map(tuple, similar.cosine_topk(asked, rows, 3, block=b).collect())) for b in (512, 4))
    assert one == many and len(one) == 39
    assert similar.cosine_topk(asked.limit(0), rows, 3).count() == 0


def test_repeats_across_stretches(spark):
    rows = [(i, float(t), "s", "x") for i, t in enumerate([1800, 1915, 1921, 2042, 3839, 3841])]
    got = logstats.repeats(spark.createDataFrame(rows, "line_no long, ts double, session string, top string")).orderBy("line_no").collect()
    assert [r["repeat"] for r in got] == [False, True, True, False, False, True]
