"""URL filter by a path-template tree per host, in Spark's own functions only.

The paths of a host form a tree.  Level by level, a segment that varies becomes a wildcard: numbers, hexadecimal names
and dates by their form, others where a branch has many different segments for its URLs.  Of the branches that remain,
siblings whose labelled shares don't differ significantly are merged, neighbours in order of their share.  A template
is rejected if the smoothed share of blocked URLs among its labelled ones is large enough; what a host lacks in labels
comes from the same template on its domain, and then on all hosts.

Labels come from rules (host suffix and path prefix) and are counted per distinct host and path before any shuffle of
branches, so a host with a third of all pages is a matter of its distinct paths only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialised

#: Segments of a path that make levels of the tree; what lies deeper belongs to the last level's template.
DEPTH = 6
#: A branch varies if it has more different segments than this, or more than MANY and over SHARE of its distinct paths.
FANOUT, MANY, SHARE = 64, 8, 0.5
#: Labelled URLs that both siblings need before they may be merged, and the z value below which they are alike.
ENOUGH, ALIKE = 5, 1.96
#: Weight, in URLs, of what a share is drawn towards in the smoothed purity, and the purity from which a template is rejected.
PRIOR, REJECT = 4.0, 0.8
#: Rows up to which a side is broadcast; beyond, in how many parts a key is dealt.
MAX_SENT, SALT = 200_000, 16

Rules = list[tuple[str, str]]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule (host suffix followed by the beginning of a path) that fits, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        out = out.when(fits, F.lit(rule))
    return out


def _form(segment: Column) -> Column:
    """Wildcards for segments that vary by their form, an ending such as .html kept."""
    stem, ending = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "{hex}")
        .when(stem.rlike(r"[0-9]{3}"), "{id}")
    )
    return F.when(kind.isNull(), segment).otherwise(F.concat(kind, ending))


def templates(paths: DataFrame) -> DataFrame:
    """Of each distinct host, path (with n, labelled, blocked) its template and the template's smoothed purity."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    now = paths.withColumn("_parts", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.concat(F.slice(parts, 1, DEPTH - 1), F.when(F.size(parts) >= DEPTH, F.array(F.array_join(F.slice(parts, DEPTH, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>")))))
    now = now.withColumn("template", F.lit(""))
    depth = now.agg(F.max(F.size("_parts"))).first()[0] or 0
    for level in range(depth):
        now = materialised(now.withColumn("_own", _form(F.get("_parts", F.lit(level)))), "level")  # each level reads the one before once
        branch = now.where("_own is not null").groupBy("host", "template", "_own").agg(F.count("*").alias("_n"), F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"))
        wide = branch.groupBy("host", "template").agg(F.count("*").alias("_kinds"), F.sum("_n").alias("_all"))
        varies = (F.col("_kinds") > FANOUT) | ((F.col("_kinds") > MANY) & (F.col("_kinds") > SHARE * F.col("_all")))
        branch = materialised(branch.join(wide, ["host", "template"]).where(~varies), "branches")
        # siblings in order of their labelled share; a significant step begins a new group
        rate = F.try_divide("_b", "_l")
        judged = branch.where(F.col("_l") >= ENOUGH)
        by = Window.partitionBy("host", "template").orderBy(rate, "_own")
        pooled = (F.col("_b") + F.lag("_b").over(by)) / (F.col("_l") + F.lag("_l").over(by))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("_l") + 1 / F.lag("_l").over(by)))
        step = rate - F.lag(rate).over(by)
        new = F.coalesce((step > 0) & (step >= ALIKE * error), F.lit(True))
        groups = judged.withColumn("_new", new.cast("int")).withColumn("_group", F.sum("_new").over(by))
        whole = Window.partitionBy("host", "template", "_group")
        groups = groups.withColumn("_name", F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list("_own").over(whole)), "|"), F.lit(")")))
        named = branch.join(groups.select("host", "template", "_own", "_name"), ["host", "template", "_own"], "left").select("host", "template", "_own", F.when(F.col("_name").contains("|"), F.col("_name")).otherwise(F.col("_own")).alias("_name"))
        now = with_small(now, named, ["host", "template", "_own"])
        own = F.when(F.col("_own").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("_name", F.when(F.col("_own").startswith("{"), F.col("_own")).otherwise(F.lit("*")))))
        now = now.withColumn("template", F.concat("template", own)).drop("_own", "_name")
    now = materialised(now, "templates")
    return with_small(now.select("host", "path", "template"), purities(now), ["host", "template"])


def domain_of(host: Column) -> Column:
    """The last two names of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def purities(rows: DataFrame) -> DataFrame:
    """Of each host and template (rows also have labelled, blocked) n_labelled, n_blocked, n_pooled and the smoothed purity.

    A template's share on a host is drawn towards its share on the host's domain, that towards its share on all hosts, and
    that towards the share of blocked URLs among all labelled ones, with a weight of PRIOR URLs each.  n_pooled is how many
    labelled URLs there are on any host.
    """
    sums = [F.sum(c).alias(c) for c in ("_l", "_b")]
    host = rows.groupBy("host", "template").agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b")).withColumn("domain", domain_of(F.col("host")))
    host = materialised(host, "hosts")
    domain = host.groupBy("domain", "template").agg(*sums)
    every = domain.groupBy("template").agg(*sums)
    base = every.agg(F.coalesce(F.try_divide(F.sum("_b"), F.sum("_l")), F.lit(0.0)).alias("_base"))  # one row
    drawn = lambda prior: (F.col("_b") + PRIOR * F.col(prior)) / (F.col("_l") + PRIOR)
    every = every.join(F.broadcast(base)).select("template", F.col("_l").alias("n_pooled"), drawn("_base").alias("_every"))
    domain = with_small(domain, every, ["template"]).select("domain", "template", "n_pooled", drawn("_every").alias("_domain"))
    return with_small(host, domain, ["domain", "template"]).select("host", "template", F.col("_l").alias("n_labelled"), F.col("_b").alias("n_blocked"), "n_pooled", drawn("_domain").alias("purity"))


def with_small(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """A left join with a frame that has a row for each key: broadcast if it is small, else with hot keys dealt out by salt."""
    small = materialised(small, "small")
    if small.limit(MAX_SENT + 1).count() <= MAX_SENT:
        return rows.join(F.broadcast(small), keys, "left")
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int")
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", salt).join(each, [*keys, "_salt"], "left").drop("_salt")


def judge_urls(pages: DataFrame, *, block: list[str], allow: list[str]) -> DataFrame:
    """A verdict for the url of every page: its longest rule's, else that of its template.

    pages: page_id, url; other columns are ignored.  Returns page_id, host, path, rule, verdict, template, purity, one
    row per row of pages.  A url that is null or has no :// has an empty host and path and is allowed.  A url without a path
    (http://a.net) is met by no rule, since each rule has a slash.  Repeated rows give repeated rows, an empty table an
    empty result.
    """
    rules = [(r, "block") for r in block] + [(r, "allow") for r in allow]
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r for r in block])
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("rule").alias("labelled"), F.count(F.when(blocked, 1)).alias("blocked"))
    found = templates(paths)
    told = (F.col("host") != "") & (F.col("purity") >= REJECT) & (F.col("n_pooled") >= ENOUGH)
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).when(told, "block").otherwise("allow")
    return with_small(rows, found, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
