"""SQL that states the vectorizers by another way, for comparison: every edge becomes a vertex, hops are doubled."""

from __future__ import annotations

from vicinage.operators.options import GraphOptions, SequenceOptions


def H(*parts: str) -> str:  # noqa: N802
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substring(md5({text}), 1, 8)) AS BIGINT)"


def _norms(keys: str, options: GraphOptions, scaled: bool) -> str:
    """CTEs from rows(keys, r, d, feature, value) to the final select."""
    inner = f"CASE WHEN n > 0 THEN value / n ELSE 0 END" if options.inner_normalization else "value"
    buckets = options.bucket_weights
    if options.inner_normalization and scaled and buckets:
        inner = f"({inner}) * CASE " + " ".join(f"WHEN r = {r} AND d = {d} THEN sqrt({float(w)})" for (r, d), w in buckets.items()) + " ELSE 1 END"
    outer = f"CASE WHEN n > 0 THEN value / n ELSE 0 END" if options.normalization else "value"
    return f"""
summed AS (SELECT {keys}, r, d, feature, sum(value) AS value FROM rows_ GROUP BY {keys}, r, d, feature),
bucket AS (SELECT {keys}, feature, {inner} AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY {keys}, r, d)) AS n FROM summed)),
flat AS (SELECT {keys}, feature, sum(value) AS value FROM bucket GROUP BY {keys}, feature),
result AS (SELECT {keys}, feature, {outer} AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY {keys})) AS n FROM flat))"""


def graph_ctes(corpus: tuple[str, str], options: GraphOptions, by_vertex: bool = False) -> str:
    """CTEs that end in ``result`` (graph_id [, vid], feature, value)."""
    r, d, mask = options.radius, options.distance, (1 << options.nbits) - 1
    depth = max(r, d)
    mark = "b.root - y.number" if options.positional else "g.degree"
    buckets = options.bucket_weights
    allowed = "true" if buckets is None else "(" + " OR ".join([f"(r = {i} AND d = {j})" for (i, j), w in buckets.items() if w] or ["false"]) + ")"
    kinds = "" if options.use_only_context else f"SELECT graph_id, vid, r, d, ({H('least(a, b)', 'greatest(a, b)', '2 * r', '2 * d')} & {mask}) + 1 AS feature, value FROM valued WHERE value <> 0 UNION ALL "
    rows = f"{kinds}SELECT graph_id, vid, r, d, ({H('b', '2 * r', '2 * d')} & {mask}) + 1 AS feature, half AS value FROM valued WHERE value <> 0"
    if not options.discrete:
        rows = f"SELECT graph_id, vid, r, d, feature, value FROM ({rows})"
    keys = "graph_id, vid" if by_vertex else "graph_id"
    return f"""
WITH RECURSIVE v AS ({corpus[0]}), e0 AS ({corpus[1]}),
e AS (SELECT graph_id, u, w, min(struct_pack(nesting := nesting, label := label, weight := weight)) AS s FROM (
  SELECT graph_id, least(src, dst) AS u, greatest(src, dst) AS w, nesting, label, weight FROM e0 WHERE src <> dst) GROUP BY graph_id, u, w),
heavy AS (SELECT graph_id FROM v WHERE coalesce(weight, 0) <> 0 UNION SELECT graph_id FROM e WHERE coalesce(s.weight, 0) <> 0),
x AS (
  SELECT graph_id, 'n' || vid AS x, vid, true AS node, vid AS number, ({H('label')} & {mask}) + 1 AS hl, coalesce(weight, 1) AS weight, false AS nesting FROM v UNION ALL
  SELECT e.graph_id, 'e' || u || '_' || w, NULL, false, m.last + row_number() OVER (PARTITION BY e.graph_id ORDER BY u, w), ({H('s.label')} & {mask}) + 1, coalesce(s.weight, 1), s.nesting
  FROM e JOIN (SELECT graph_id, max(vid) AS last FROM v GROUP BY graph_id) m USING (graph_id)),
links AS (
  SELECT graph_id, 'n' || u AS a, 'e' || u || '_' || w AS b FROM e UNION ALL SELECT graph_id, 'n' || w, 'e' || u || '_' || w FROM e),
adjacent AS (SELECT graph_id, a, b FROM links UNION ALL SELECT graph_id, b, a FROM links),
degrees AS (SELECT graph_id, a AS x, count(*) AS degree FROM adjacent GROUP BY graph_id, a),
open_ AS (SELECT a.graph_id, a.a, a.b FROM adjacent a JOIN x ON x.graph_id = a.graph_id AND x.x = a.b AND NOT x.nesting),
visit(graph_id, root, x, k) AS (
  SELECT graph_id, number, x, 0 FROM x WHERE node UNION
  SELECT t.graph_id, t.root, o.b, t.k + 1 FROM visit t JOIN open_ o ON o.graph_id = t.graph_id AND o.a = t.x WHERE t.k < {2 * depth}),
bfs AS (SELECT graph_id, root, x, min(k) AS k FROM visit GROUP BY graph_id, root, x),
items AS (
  SELECT b.graph_id, b.root, b.k, {H('y.hl', mark if options.positional else 'coalesce(g.degree, 0)')} AS h, y.weight FROM bfs b
  JOIN x y ON y.graph_id = b.graph_id AND y.x = b.x LEFT JOIN degrees g ON g.graph_id = b.graph_id AND g.x = b.x),
shells AS (SELECT graph_id, root, k, CAST(('0x' || substring(md5(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h)), 1, 8)) AS BIGINT) AS s,
  sum(weight) AS total, count(*) AS n, sum(CASE WHEN weight > 0 THEN ln(weight) ELSE 0 END) AS logs, min(weight) AS low FROM items GROUP BY graph_id, root, k),
radii AS (SELECT unnest(range({options.min_r}, {r + 1})) AS r),
hood AS (
  SELECT t.graph_id, t.root, q.r, CAST(('0x' || substring(md5(string_agg(CAST(s AS VARCHAR), ',' ORDER BY k)), 1, 8)) AS BIGINT) AS p,
    (sum(CASE WHEN k = 0 THEN total ELSE 0 END) + sum(CASE WHEN k % 2 = 0 THEN total ELSE 0 END)) / (1 + sum(CASE WHEN k % 2 = 0 THEN n ELSE 0 END))
    * CASE WHEN min(CASE WHEN k % 2 = 1 THEN low END) = 0 THEN 0 ELSE exp(sum(CASE WHEN k % 2 = 1 THEN logs ELSE 0 END) / (1 + sum(CASE WHEN k % 2 = 1 THEN n ELSE 0 END))) END AS size
  FROM shells t JOIN radii q ON t.k <= 2 * q.r GROUP BY t.graph_id, t.root, q.r HAVING max(k) = 2 * q.r),
near AS (SELECT b.graph_id, b.root AS a, x.vid AS b, b.k // 2 AS d FROM bfs b JOIN x ON x.graph_id = b.graph_id AND x.x = b.x AND x.node WHERE b.k // 2 BETWEEN {options.min_d} AND {d}),
nests AS (SELECT graph_id, u AS a, w AS b, coalesce(s.weight, 1) AS cw FROM e WHERE s.nesting UNION ALL SELECT graph_id, w, u, coalesce(s.weight, 1) FROM e WHERE s.nesting),
pairs AS (SELECT graph_id, a, b, d, 1.0::DOUBLE AS cw FROM near UNION ALL SELECT t.graph_id, t.a, n.b, n.d, t.cw FROM nests t JOIN near n ON n.graph_id = t.graph_id AND n.a = t.b),
valued AS (
  SELECT p.graph_id, p.a AS vid, f.r, p.d, f.p AS a, g.p AS b, p.cw * CASE WHEN w.graph_id IS NULL THEN 1 ELSE f.size + g.size END AS value, p.cw * CASE WHEN w.graph_id IS NULL THEN 1 ELSE g.size END AS half
  FROM pairs p JOIN hood f ON f.graph_id = p.graph_id AND f.root = p.a JOIN hood g ON g.graph_id = p.graph_id AND g.root = p.b AND g.r = f.r
  LEFT JOIN heavy w ON w.graph_id = p.graph_id),
plain AS (SELECT graph_id, vid, r, d, feature, sum(value) AS value FROM ({rows}) WHERE {allowed} GROUP BY graph_id, vid, r, d, feature),
rows_ AS ({_lift(mask) if not options.discrete else 'SELECT * FROM plain'}),
{_norms(keys, options, True)}"""


def _lift(mask: int) -> str:
    dense = f"SELECT p.graph_id, p.vid, r, d, (feature + i) % {mask} AS feature, value * CAST(v.embedding[i + 1] AS DOUBLE) AS value FROM plain p JOIN v ON v.graph_id = p.graph_id AND v.vid = p.vid, range(0, 64) t(i)"
    sparse = f"SELECT p.graph_id, p.vid, r, d, ({H('feature', 'i')} & {mask}) + 1 AS feature, value * CAST(v.embedding[i + 1] AS DOUBLE) AS value FROM (SELECT graph_id, vid, r, d, feature, sum(value) AS value FROM ({dense}) GROUP BY ALL) p JOIN v ON v.graph_id = p.graph_id AND v.vid = p.vid, range(0, 64) t(i) WHERE abs(CAST(v.embedding[i + 1] AS DOUBLE)) > 0.2"
    return f"{dense} UNION ALL {sparse}"


def sequence_ctes(corpus: str, options: SequenceOptions, weighted: bool = False, by_position: bool = False) -> str:
    """CTEs that end in ``result`` (id [, pos], feature, value)."""
    mask = (1 << options.nbits) - 1
    run = lambda at: H(f"list_aggregate(list_transform(tokens[{at} + 1 : {at} + r + 1], lambda t: regexp_replace(t, '([\\\\,])', '\\\\\\1', 'g')), 'string_agg', ',')")
    first = "42" if options.use_only_context else run("pos")
    value = "list_sum(weights[pos + 1 : pos + r + 1]) + list_sum(weights[pos + o + 1 : pos + o + r + 1])" if weighted else "1.0::DOUBLE"
    offsets = ", ".join(f"({o})" for o in [*range(options.min_d, options.distance + 1), *range(-options.distance, -options.min_d)])
    buckets = options.bucket_weights
    allowed = "true" if buckets is None else "(" + " OR ".join([f"(r = {i} AND abs(o) = {j})" for (i, j), w in buckets.items() if w] or ["false"]) + ")"
    ends = "SELECT id, pos, r, d, feature, value FROM pairs UNION ALL SELECT id, pos + r, r, d, feature, value FROM pairs WHERE pos + 2 * r < n" if by_position else "SELECT * FROM pairs"
    keys = "id, pos" if by_position else "id"
    return f"""
WITH s AS ({corpus}),
placed AS (SELECT *, len(tokens) AS n, unnest(range(0, len(tokens))) AS pos FROM s),
runs AS (SELECT * FROM placed, (SELECT unnest(range({options.min_r}, {options.radius + 1})) AS r), (VALUES {offsets}) q(o) WHERE pos + r < n AND pos + o >= 0 AND pos + o + r < n AND {allowed}),
pairs AS (SELECT id, pos, n, r, abs(o) AS d, ({H('f', 'g', 'r', 'abs(o)')} & {mask}) + 1 AS feature, value FROM (
  SELECT *, {first} AS f, {run('pos + o')} AS g, {value} AS value FROM runs)),
rows_ AS ({ends}),
{_norms(keys, options.set_params(inner_normalization=False) if by_position else options, False)}"""
