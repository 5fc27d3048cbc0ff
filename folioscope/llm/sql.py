"""DuckDB SQL of the queries' results, where SQL can state them over whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE w_ AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s_ AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w_),
e_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s_),
l_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e_ a JOIN e_ b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r_ AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r_.a, x.b FROM r_ JOIN (SELECT a, b FROM l_ UNION ALL SELECT b, a FROM l_) x ON x.a = r_.b)
SELECT s_.doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM s_ JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r_ GROUP BY a) c USING (doc_id)"""

#: CRC-32 of doc_id in decimal: each character, then eight steps of one bit.
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),"
    " lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END))"
)
_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"
#: Levels of a tree from the rows of ``{base}(g, i, n, h)``: 16 neighbours become their parent while a group has more than one node.
_TREE = """(SELECT g, i, n, h, 0 AS l FROM {base}
  UNION ALL SELECT g, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)), l + 1 FROM {name} WHERE n > 1 GROUP BY g, i // 16, l)"""
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaf_ AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce('=' || source, '') AS g, {_LEAF.format(text="text")} AS h,
    {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered FROM documents),
base_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, row) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf_),
tree_ AS {_TREE.format(base="base_", name="tree_")},
top_ AS MATERIALIZED (SELECT g AS of, 'all' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, h FROM tree_ WHERE n = 1),
upper_ AS {_TREE.format(base="top_", name="upper_")},
nodes_ AS MATERIALIZED (SELECT g, i, n, h, l FROM tree_ UNION ALL SELECT g, i, n, h, l + 100 FROM upper_),
on_way_ AS MATERIALIZED (
  SELECT b.row, t.l, t.g, t.i FROM base_ b JOIN tree_ t ON t.g = b.g AND t.i = b.i // (16 ** t.l)::BIGINT WHERE t.n > 1
  UNION ALL SELECT b.row, u.l + 100, u.g, u.i FROM base_ b JOIN top_ t ON t.of = b.g JOIN upper_ u ON u.i = t.i // (16 ** u.l)::BIGINT WHERE u.n > 1),
runs_ AS MATERIALIZED (
  SELECT w.row, w.l, row_number() OVER (PARTITION BY w.row ORDER BY w.l) AS step, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < w.i), '') AS before, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > w.i), '') AS after
  FROM on_way_ w JOIN nodes_ x ON x.l = w.l AND x.g = w.g AND x.i // 16 = w.i // 16 GROUP BY w.row, w.l, w.i),
way_ AS MATERIALIZED (SELECT row, string_agg(before || after, '' ORDER BY step) AS proof, list(before ORDER BY step) AS befores, list(after ORDER BY step) AS afters FROM runs_ GROUP BY row),
fold_ AS (
  SELECT row, CASE WHEN {_CRC} % 5 = 0 THEN lowered ELSE h END AS h, 0 AS step FROM base_
  UNION ALL SELECT row, sha256(befores[step + 1] || h || afters[step + 1]), step + 1 FROM fold_ JOIN way_ USING (row) WHERE step < len(befores)),
folded_ AS (SELECT row, arg_max(h, step) AS folded_root FROM fold_ GROUP BY row)
SELECT b.doc_id, b.h AS leaf, t.h AS subroot, r.h AS root, sha256(coalesce(w.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM base_ b JOIN folded_ f USING (row) LEFT JOIN way_ w USING (row) JOIN top_ t ON t.of = b.g CROSS JOIN (SELECT h FROM upper_ WHERE n = 1) r"""

ORACLES["op12_exact_dedup"] = r"""
WITH t_ AS (SELECT doc_id, row_number() OVER () AS row, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM t_ WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, row)"""


def _clusters(rounds: int) -> str:
    """Exact integers throughout: each round is a table of assignments and one of centroids."""
    nearest = "SELECT v.row, arg_min(c.k, (list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))) * 1000 + c.k)) AS k FROM v_ v CROSS JOIN c{r}_ c GROUP BY v.row"
    steps = [
        "v_ AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x FROM v_ QUALIFY k < 8)",
    ]
    for r in range(rounds):
        steps.append(f"a{r}_ AS MATERIALIZED ({nearest.format(r=r)})")
        steps.append(
            f"s{r}_ AS MATERIALIZED (SELECT k, j, sum(v.x[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}_ JOIN v_ v USING (row) CROSS JOIN range(1, 65) i(j) GROUP BY k, j)"
        )
        steps.append(f"m{r}_ AS MATERIALIZED (SELECT k, list(((s - (((s % n) + n) % n)) // n)::HUGEINT ORDER BY j) AS x FROM s{r}_ GROUP BY k)")
        steps.append(f"c{r + 1}_ AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r}_ c LEFT JOIN m{r}_ m USING (k))")
    steps.append(f"a_ AS MATERIALIZED ({nearest.format(r=rounds)})")
    steps.append(f"d_ AS MATERIALIZED (SELECT v.vec_id, k, list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))::BIGINT AS d, c.x AS x FROM a_ JOIN v_ v USING (row) JOIN c{rounds}_ c USING (k))")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        " sha256(array_to_string(list_transform(x, lambda y: y::VARCHAR), ',')) AS centroid_sha256 FROM d_"
    )


ORACLES["op13_centroids"] = _clusters(10)
