"""Pieces of DuckDB SQL that several statements share."""

from __future__ import annotations

TOKENS = r"""
list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), lambda w: replace(lower(w), 'ß', 'ss'))"""


def tokens(text: str) -> str:
    """Tokens of a text without identifiers of several parts."""
    return TOKENS.format(text=text)


DOCUMENTS = "SELECT doc_id, 'doc-' || doc_id AS slug, split_part(text, chr(10), 1) AS title, text AS body FROM documents"
ITEMS = "SELECT item_id AS qid, text AS q FROM benchmark"


def corpus(pages: str = DOCUMENTS, queries: str = ITEMS) -> str:
    """The index of pages (doc_id, slug, title, body), the terms of queries (qid, q), what they meet."""
    return f"""
pages_ AS ({pages}), queries_ AS ({queries}),
each_ AS (SELECT slug, unnest({tokens("title || ' ' || slug")}) AS term, 1 AS t FROM pages_ UNION ALL SELECT slug, unnest({tokens("body")}) AS term, 0 AS t FROM pages_),
postings_ AS (SELECT term, slug, sum(t)::BIGINT AS title_tf, sum(1 - t)::BIGINT AS body_tf FROM each_ GROUP BY term, slug),
lengths_ AS (SELECT slug, len({tokens("title || ' ' || slug")})::BIGINT AS title_len, len({tokens("body")})::BIGINT AS body_len FROM pages_),
df_ AS (SELECT term, count(*) AS df FROM postings_ GROUP BY term),
stats_ AS (SELECT count(*) AS n, coalesce(avg(title_len), 1.0) AS avg_title, coalesce(avg(body_len), 1.0) AS avg_body FROM lengths_),
terms_ AS (SELECT DISTINCT qid, unnest({tokens("q")}) AS term FROM queries_),
hits_ AS (SELECT * FROM terms_ JOIN postings_ USING (term) JOIN df_ USING (term) JOIN lengths_ USING (slug) CROSS JOIN stats_),
qrels_ AS (SELECT item_id AS qid, 'doc-' || doc_id AS slug FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


PAGES = corpus()
STRIPPED = r"regexp_replace(regexp_replace({text}, '^[\s\x1c-\x1f]+', ''), '[\s\x1c-\x1f]+$', '')"


def snippets(rows: str) -> str:
    """rows: columns of its own, t (text without repeated white space) and terms (list); gives them with snippet."""
    return f"""SELECT * EXCLUDE (t, terms, f_, s_), (CASE WHEN s_ > 0 THEN '…' ELSE '' END) || substr(t, s_ + 1, 140) || (CASE WHEN s_ + 140 < length(t) THEN '…' ELSE '' END) AS snippet FROM (
  SELECT *, greatest(0, coalesce(-list_max(list_transform(f_, lambda p: struct_pack(n := len(list_filter(f_, lambda o: o >= p - 30 AND o < p + 110)), p := -p))).p, 0) - 30) AS s_ FROM (
    SELECT *, list_filter(list_transform(terms, lambda q: strpos(lower(t), q) - 1), lambda p: p >= 0) AS f_ FROM ({rows})))"""


COLLAPSED = r"trim(regexp_replace({text}, '[\s\x1c-\x1f]+', ' ', 'g'))"


def erfc(x: str) -> str:
    """The complementary error function of 0 to 4 by its power series; 0 beyond, as six decimals have it."""
    return f"(CASE WHEN {x} > 4 THEN 0.0 ELSE 1 - 1.1283791670955126 * list_sum(list_transform(range(0, 130), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(greatest({x}, 1e-300)) - lgamma(n + 1.0)) / (2 * n + 1))) END)"


def fisher(a: str, b: str, c: str, d: str) -> str:
    """Fisher's two-sided p of a table, null with an empty side."""
    ways = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
    p = lambda x: f"({ways(f'({a} + {b})', x)} + {ways(f'({c} + {d})', f'({a} + {c} - {x})')} - {ways(f'({a} + {b} + {c} + {d})', f'({a} + {c})')})"
    return f"(CASE WHEN {a} + {b} > 0 AND {c} + {d} > 0 THEN least(1.0, list_sum(list_transform(range(greatest(0, {a} - {d}), least({a} + {b}, {a} + {c}) + 1), lambda x: CASE WHEN {p('x')} <= {p(a)} + 1e-7 THEN exp({p('x')}) ELSE 0.0 END))) END)"


def rank_test(rows: str, by: str = "") -> str:
    """The rank test of rows (by, v, a): a tells the first sample."""
    own, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    over = f"PARTITION BY {by} ORDER BY v" if by else "ORDER BY v"
    return f"""SELECT {own}n1, n2, u, variance, CASE WHEN n1 = 0 OR n2 = 0 THEN NULL WHEN variance <= 0 THEN 1.0 ELSE {erfc('(greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(greatest(variance, 1e-9)) / sqrt(2))')} END AS p FROM (
  SELECT {own}n1, n2, s - n1 * (n1 + 1) / 2 AS u, CASE WHEN n1 + n2 > 1 THEN n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0))) ELSE 0.0 END AS variance FROM (
    SELECT {own}sum(c1)::BIGINT AS n1, sum(c - c1)::BIGINT AS n2, sum(c1 * r) AS s, sum(c * c * c - c)::DOUBLE AS ties FROM (
      SELECT *, sum(c) OVER ({over}) - (c - 1) / 2 AS r FROM (SELECT {own}v, count(*) AS c, count(*) FILTER (a) AS c1 FROM ({rows}) WHERE v IS NOT NULL GROUP BY ALL)) {group}))"""


def bm25f(weight: float = 5.0) -> str:
    return f"""SELECT qid, slug, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.2 + tf)) AS score FROM (
  SELECT *, {weight} * title_tf / (0.25 + 0.75 * title_len / avg_title) + body_tf / (0.25 + 0.75 * body_len / avg_body) AS tf FROM hits_) GROUP BY qid, slug"""


FTS = """SELECT qid, slug, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (title_len + body_len) / (avg_title + avg_body)))) AS score FROM (
  SELECT *, 5.0 * title_tf + body_tf AS tf FROM hits_) GROUP BY qid, slug"""
COUNT = "SELECT qid, slug, sum(title_tf + body_tf)::DOUBLE AS score FROM hits_ GROUP BY qid, slug"


def top(scored: str, k: int = 10) -> str:
    return f"SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, slug) AS rank, slug, round(score, 6) AS score FROM ({scored})) WHERE rank <= {k}"


def ranked(scored: str, k: int = 10) -> str:
    return f"WITH {PAGES} {top(scored, k)}"
