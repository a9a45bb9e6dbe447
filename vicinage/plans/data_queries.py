"""Queries of loaders, statistics, samples, metrics, links, motifs and alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions.lineage import many, shared_folder
from vicinage.operators import align, annotate, gaps, graph_vectorizer, links, metrics, motifs, sampling, statistics
from vicinage.operators.options import GraphOptions, SequenceOptions
from vicinage.plans.reference_sql import H, graph_ctes, sequence_ctes
from vicinage.plans.registry import query, rounded
from vicinage.sources import corpora as C
from vicinage.sources import formats

BASE = GraphOptions(r=1, d=1, nbits=20)


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select("doc_id", "n_chars")
    score = ((F.col("n_chars") * 31 + F.col("doc_id") * 17) % 1000) / 1000
    return C.table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


LABELS = "l AS (SELECT doc_id, quality AS y, ((n_chars * 31 + doc_id * 17) % 1000) / 1000.0::DOUBLE AS score, CAST(((n_chars * 31 + doc_id * 17) % 1000) / 1000.0::DOUBLE >= 0.5 AS INTEGER) AS predicted FROM labels JOIN documents USING (doc_id))"


def social(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One graph of regions, nations and suppliers: ids are moved apart by a million each."""
    region, nation, supplier = (C.table(spark, sf, t) for t in ("region", "nation", "supplier"))
    vertex = lambda df, key, shift, label: df.select(F.lit(0).cast("long").alias("graph_id"), (F.col(key).cast("long") + shift).alias("vid"), F.lit(label).alias("label"))
    edge = lambda df, a, x, b, y, label: df.select(F.lit(0).cast("long").alias("graph_id"), (F.col(a).cast("long") + x).alias("src"), (F.col(b).cast("long") + y).alias("dst"), F.lit(label).alias("label"))
    vertices = vertex(region, "r_regionkey", 0, "region").unionByName(vertex(nation, "n_nationkey", 1_000_000, "nation")).unionByName(vertex(supplier, "s_suppkey", 2_000_000, "supplier"))
    edges = edge(nation, "n_nationkey", 1_000_000, "n_regionkey", 0, "in").unionByName(edge(supplier, "s_suppkey", 2_000_000, "s_nationkey", 1_000_000, "in"))
    return vertices, edges


SOCIAL = (
    "sv AS (SELECT 0::BIGINT AS graph_id, r_regionkey::BIGINT AS vid, 'region' AS label FROM region UNION ALL SELECT 0, n_nationkey + 1000000, 'nation' FROM nation UNION ALL SELECT 0, s_suppkey + 2000000, 'supplier' FROM supplier), "
    "se AS (SELECT DISTINCT 0::BIGINT AS graph_id, least(a, b) AS u, greatest(a, b) AS w FROM (SELECT n_nationkey + 1000000 AS a, n_regionkey::BIGINT AS b FROM nation UNION ALL SELECT s_suppkey + 2000000, s_nationkey + 1000000 FROM supplier)), "
    "sd AS (SELECT sv.graph_id, vid, count(x) AS degree FROM sv LEFT JOIN (SELECT u AS x FROM se UNION ALL SELECT w FROM se) ON x = vid GROUP BY ALL)"
)

# Statistics.
query("class_stats", lambda s, sf: statistics.class_stats(scored_labels(s, sf), "y"), f"WITH {LABELS} SELECT y AS class, count(*) AS n, count(*) / sum(count(*)) OVER () AS fraction FROM l GROUP BY y")
query("feature_describe", lambda s, sf: statistics.describe_features(graph_vectorizer.vectorize(*C.name_graphs(s, sf), BASE)), graph_ctes(C.NAMES_SQL, BASE) + " SELECT count(DISTINCT graph_id) AS instances, count(DISTINCT feature) AS width, count(*) / count(DISTINCT graph_id) AS mean_features FROM result")
_EVENTS = "SELECT user_id, {} FROM events GROUP BY user_id"
query("score_percentiles", lambda s, sf: rounded(statistics.score_percentiles(C.table(s, sf, "events"), "user_id", "value"), "p50", "p25", "p75", "p10", "p90"), _EVENTS.format(", ".join(f"round(quantile_cont(value, {q / 100}), 6) + 0.0 AS p{q}" for q in (50, 25, 75, 10, 90))))
query("avg_std", lambda s, sf: rounded(statistics.average_and_deviation(C.table(s, sf, "events"), "user_id", "value"), "average", "deviation", places=4), _EVENTS.format("round(avg(value), 4) + 0.0 AS average, round(stddev_pop(value), 4) + 0.0 AS deviation"))
query("label_color_rank", lambda s, sf: rounded(statistics.label_ranks(C.name_graphs(s, sf)[0]), "rank"), f"WITH v AS ({C.NAMES_SQL[0]}) SELECT label, round((row_number() OVER (ORDER BY label) - 1) / count(*) OVER (), 6) + 0.0 AS rank FROM (SELECT DISTINCT label FROM v)")
query("degree_stats", lambda s, sf: statistics.degree_stats(*social(s, sf)), f"WITH {SOCIAL} SELECT graph_id, count(*) AS n_vertices, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, CAST(count(*) * (count(*) - 1) / 2 - sum(degree) / 2 AS BIGINT) AS n_non_edges, max(degree) AS max_degree, quantile_cont(degree, 0.5) AS median_degree FROM sd GROUP BY graph_id")
query("degree_histogram", lambda s, sf: statistics.degree_histogram(*social(s, sf)), f"WITH {SOCIAL} SELECT graph_id, degree, count(*) AS n FROM sd GROUP BY ALL")
_INDUCED = "SELECT vid FROM sd WHERE degree {} 3"
for _name, _op, _at_least in (("degree_filter_ge", ">=", True), ("degree_filter_lt", "<", False)):
    query(
        _name, lambda s, sf, at_least=_at_least: (lambda g: g[0].select("graph_id", F.col("vid").alias("a"), F.lit(-1).cast("long").alias("b")).unionByName(g[1].select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))))(links.degree_filter(*social(s, sf), 3, at_least)),
        f"WITH {SOCIAL}, k AS ({_INDUCED.format(_op)}) SELECT 0::BIGINT AS graph_id, vid AS a, -1::BIGINT AS b FROM k UNION ALL SELECT 0, u, w FROM se WHERE u IN (FROM k) AND w IN (FROM k)",
    )


def _intervals(s: SparkSession, sf: str) -> DataFrame:
    """Blocks of three of the part table's rows."""
    n = C.table(s, sf, "part").count()
    return s.createDataFrame([(n, b, e) for b, e in sampling.intervals(n, block_size=3)], "size long, begin long, end long")


# Samples.
query("balance_topk", lambda s, sf: sampling.balance(scored_labels(s, sf).withColumn("m", F.col("score") - 0.5), "doc_id", "y", "m").select("doc_id", "y"), f"WITH {LABELS}, c AS (SELECT y, count(*) AS n FROM l GROUP BY y), m AS (SELECT y, n FROM c ORDER BY n, y LIMIT 1) SELECT doc_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY abs(score - 0.5), doc_id) AS k FROM l) WHERE y = (SELECT y FROM m) OR k <= 2 * (SELECT n FROM m)")
query("subsample_per_class", lambda s, sf: sampling.subsample(scored_labels(s, sf), "doc_id", "y", 60).select("doc_id", "y"), f"WITH {LABELS} SELECT doc_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY doc_id) AS k FROM l) WHERE k <= 60 // (SELECT count(DISTINCT y) FROM l)")
query("train_test_split", lambda s, sf: sampling.train_test_split(scored_labels(s, sf), "doc_id", "y").select("doc_id", "y", "is_test"), f"WITH {LABELS} SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY {H(chr(39) + '2' + chr(39), 'doc_id')}, doc_id) <= floor(count(*) OVER (PARTITION BY y) * 0.3::DOUBLE) AS is_test FROM l")
query("bipartition", lambda s, sf: sampling.bipartition(scored_labels(s, sf), "doc_id").select("doc_id", "part"), f"WITH {LABELS} SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {H(chr(39) + '0' + chr(39), 'doc_id')}, doc_id) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 0 ELSE 1 END AS part FROM l")
query("make_data_matrix", lambda s, sf: rounded(sampling.data_matrix(graph_vectorizer.vectorize(*C.name_graphs(s, sf), BASE)), "value"), graph_ctes(C.NAMES_SQL, BASE) + " SELECT graph_id, 1 AS y, feature, round(value, 6) + 0.0 AS value FROM result UNION ALL SELECT graph_id, -1, feature, round(-value, 6) + 0.0 FROM result")
query("compute_intervals", lambda s, sf: _intervals(s, sf), "WITH s(size) AS (SELECT count(*) FROM part), b AS (SELECT size, unnest(range(0, size - 2, 3)) AS begin FROM s), r AS (SELECT size, begin, begin + 3 AS end_ FROM b UNION ALL SELECT size, size - size % 3, size FROM s WHERE size % 3 = 2) SELECT size::BIGINT AS size, begin, CASE WHEN size - end_ = 1 THEN size ELSE end_ END AS \"end\" FROM r")

# Metrics.
query("confusion_matrix", lambda s, sf: metrics.confusion_matrix(scored_labels(s, sf), "y", "predicted"), f"WITH {LABELS} SELECT y AS truth, predicted, count(*) AS n FROM l GROUP BY ALL")
query("confusion_matrix_norm", lambda s, sf: metrics.confusion_matrix(scored_labels(s, sf), "y", "predicted", True), f"WITH {LABELS}, c AS (SELECT y AS truth, predicted, count(*) AS n FROM l GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY truth) AS fraction FROM c")
_CURVE = f"WITH {LABELS}, e AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY score), c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM e WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
query("roc_curve", lambda s, sf: metrics.roc_curve(scored_labels(s, sf), "y", "score"), _CURVE + " SELECT score, fp / n AS fpr, tp / p AS tpr FROM c")
query("pr_curve", lambda s, sf: metrics.pr_curve(scored_labels(s, sf), "y", "score"), _CURVE + " SELECT score, tp / (tp + fp) AS precision, tp / p AS recall FROM c")
query("ranking_summary", lambda s, sf: rounded(metrics.ranking_summary(scored_labels(s, sf), "y", "score"), "auc", "average_precision"), f"WITH {LABELS} SELECT round((SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM l a, l b WHERE a.y = 1 AND b.y = 0), 6) + 0.0 AS auc, (SELECT round(avg(tp / n), 6) + 0.0 FROM (SELECT (SELECT count(*) FROM l b WHERE b.y = 1 AND b.score >= a.score)::DOUBLE AS tp, (SELECT count(*) FROM l b WHERE b.score >= a.score) AS n FROM l a WHERE a.y = 1)) AS average_precision")
query("class_report", lambda s, sf: rounded(metrics.class_report(scored_labels(s, sf), "y", "predicted"), "precision", "recall", "f1"), f"WITH {LABELS}, c AS (SELECT c AS class, count(*) FILTER (y = c) AS support, count(*) FILTER (predicted = c) AS said, count(*) FILTER (y = c AND predicted = c) AS hit FROM l, (VALUES (0), (1)) t(c) GROUP BY c) SELECT class, support, round(hit / said, 6) + 0.0 AS precision, round(hit / support, 6) + 0.0 AS recall, round(2 * hit / (said + support), 6) + 0.0 AS f1 FROM c")

# Links.
query("non_edges", lambda s, sf: links.non_edges(*social(s, sf)), f"WITH {SOCIAL} SELECT a.graph_id, a.vid AS u, b.vid AS v FROM sv a JOIN sv b ON a.vid < b.vid WHERE NOT EXISTS (FROM se WHERE u = a.vid AND w = b.vid)")
_RANKS = f"r AS (SELECT vid, row_number() OVER (ORDER BY {H(chr(39) + '1v' + chr(39), 'graph_id', 'vid')}, vid) - 1 AS rank FROM sv), c AS (SELECT count(*) AS n, count(*) * (count(*) - 1) // 2 AS n_pairs, (SELECT count(*) FROM se) AS m FROM sv), g AS (SELECT *, least(10 * m, n_pairs - m) AS wanted, [p for p in {list(links.STEPS)} if n_pairs % p <> 0][1] AS step, {H(chr(39) + '1p' + chr(39), '0')} % n_pairs AS shift FROM c)"
_DRAWS = "k AS (SELECT k, n, wanted, CAST((CAST(step AS HUGEINT) * k + shift) % n_pairs AS BIGINT) AS number FROM g, range((SELECT least(wanted + m, n_pairs) FROM g)) t(k)), d AS (SELECT k, wanted, least(a.vid, b.vid) AS u, greatest(a.vid, b.vid) AS v FROM k JOIN r a ON a.rank = number % n JOIN r b ON b.rank = (number % n + number // n + 1) % n)"
_SPLIT = f"WITH {SOCIAL}, {_RANKS}, {_DRAWS}, p AS (SELECT graph_id, u, w AS v, 1 AS y FROM se), q AS (SELECT 0::BIGINT AS graph_id, u, v, 0 AS y FROM (SELECT *, row_number() OVER (ORDER BY k) AS place FROM d WHERE NOT EXISTS (FROM se WHERE se.u = d.u AND se.w = d.v)) WHERE place <= wanted), a AS (SELECT * FROM p UNION ALL SELECT * FROM q)"
query("link_pred_split", lambda s, sf: links.link_split(*social(s, sf)), _SPLIT + f" SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H(chr(39) + '1s' + chr(39), 'graph_id', 'u', 'v')}, u, v) <= floor(count(*) OVER (PARTITION BY y) * 0.3::DOUBLE) AS is_test FROM a")
query(
    "all_pairs_path", lambda s, sf: links.path_lengths(*social(s, sf), 3),
    f"WITH RECURSIVE {SOCIAL}, n AS (SELECT u AS a, w AS b FROM se UNION ALL SELECT w, u FROM se), t(root, vid, hops) AS (SELECT vid, vid, 0 FROM sv UNION SELECT root, b, hops + 1 FROM t JOIN n ON a = vid WHERE hops < 3) SELECT 0::BIGINT AS graph_id, root, vid, min(hops) AS hops FROM t GROUP BY root, vid",
)


def _pairs_of_roles(s: SparkSession, sf: str):
    vertices, edges = C.role_graphs(s, sf)
    steps = edges.filter("not nesting").drop("nesting", "weight")
    pairs = steps.select((F.col("graph_id") * (1 << 24) + F.col("src")).alias("pair_id"), "graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    return links.neighborhood_pairs(vertices, steps, pairs, 2)


query(
    "neighborhood_pairs", lambda s, sf: (lambda g: g[0].select("graph_id", F.col("vid").alias("a"), F.lit(-1).cast("long").alias("b"), "label").unionByName(g[1].select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "label")))(_pairs_of_roles(s, sf)),
    "WITH c AS (SELECT conv_id AS g, turn AS v, role FROM conversations), m AS (SELECT g, max(v) AS last FROM c GROUP BY g), p AS (SELECT a.g * 16777216 + a.v AS id, a.g, a.v AS x, b.v AS y FROM c a JOIN c b ON a.g = b.g AND b.v = a.v + 1), "
    "i AS (SELECT id, c.v, role FROM p JOIN c ON c.g = p.g AND c.v BETWEEN x - 2 AND y + 2) "
    "SELECT id AS graph_id, v AS a, -1::BIGINT AS b, role AS label FROM i UNION ALL SELECT id, last + 1, -1, '#' FROM p JOIN m USING (g) UNION ALL SELECT id, x, last + 1, '#' FROM p JOIN m USING (g) UNION ALL SELECT id, y, last + 1, '#' FROM p JOIN m USING (g) "
    "UNION ALL SELECT a.id, a.v, b.v, '-' FROM i a JOIN i b ON a.id = b.id AND b.v = a.v + 1 JOIN p ON p.id = a.id WHERE a.v <> p.x",
)
query(
    "edge_prediction_overlay", lambda s, sf: (lambda e: links.prediction_overlay(e.filter("(u + v) % 3 <> 0"), e.filter("(u + v) % 4 <> 0")))(social(s, sf)[1].select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))),
    f"WITH {SOCIAL} SELECT u, w AS v, CASE WHEN (u + w) % 3 <> 0 AND (u + w) % 4 <> 0 THEN 'limegreen' WHEN (u + w) % 3 <> 0 THEN 'crimson' ELSE 'gray' END AS color FROM se WHERE (u + w) % 3 <> 0 OR (u + w) % 4 <> 0",
)


# Motifs.
def _event_scores(s: SparkSession, sf: str) -> DataFrame:
    mean = C.table(s, sf, "events").agg(F.avg("value").alias("mean"))
    rows = C.event_sequences(s, sf).crossJoin(F.broadcast(mean))  # one row
    return rows.select("id", "tokens", F.transform("weights", lambda w: F.round(w * 100 - F.col("mean"), 3)).alias("score"))


def _event_rows(s: SparkSession, sf: str) -> DataFrame:
    """id, day, ts, event_id, score: a row an event."""
    events = C.table(s, sf, "events")
    mean = events.agg(F.avg("value").alias("mean"))
    rows = events.crossJoin(F.broadcast(mean))  # one row
    return rows.select(F.col("user_id").alias("id"), F.to_date("ts").alias("day"), "ts", "event_id", F.round(F.col("value") - F.col("mean"), 3).alias("score"))


_SCORES = "z AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, round(value - (SELECT avg(value) FROM events), 3) AS x, substring(event_type, 1, 1) AS token FROM events)"
query("max_subarray", lambda s, sf: rounded(motifs.max_stretches(_event_rows(s, sf), "id", "day", ["ts", "event_id"], "score"), "score", places=3), f"WITH {_SCORES}, t AS (SELECT id, k, sum(x) OVER (PARTITION BY id ORDER BY k) AS c FROM z), a AS (SELECT * FROM t UNION ALL SELECT DISTINCT id, -1, 0 FROM t) SELECT e.id, round(max(e.c - b.c), 3) + 0.0 AS score FROM t e JOIN a b ON b.id = e.id AND b.k < e.k GROUP BY e.id")
query("iterated_max_subarray", lambda s, sf: rounded(motifs.iterated_max_subarrays(_event_scores(s, sf), 2, 10), "score", places=3))
query("smallest_positive", lambda s, sf: rounded(motifs.smallest_positives(_event_rows(s, sf), "id", "score"), "base", places=3), f"WITH {_SCORES} SELECT id, coalesce(round(min(x) FILTER (x > 0), 3), -1.0) AS base FROM z GROUP BY id")


def _extracted(s: SparkSession, sf: str) -> DataFrame:
    marked = annotate.annotate(*C.name_graphs(s, sf), BASE)
    found = motifs.sequence_and_score(marked.withColumn("position", F.col("vid").cast("int")))
    return found.select("graph_id", F.array_join("tokens", "").alias("tokens"), F.round(F.aggregate("score", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


query("extract_sequence_score", _extracted, "SELECT p_partkey AS graph_id, p_name AS tokens, round(length(p_name)::DOUBLE / (2 * length(p_name) - 1), 6) AS total FROM part")


# Files.
def _gspan_text(s: SparkSession, sf: str) -> DataFrame:
    """The name graphs as lines: every fifth vertex V, every seventh with a JSON attribute."""
    vertices, edges = C.name_graphs(s, sf)
    code = F.when(F.col("vid") % 5 == 4, "V").otherwise("v")
    tail = F.when(F.col("vid") % 7 == 6, F.lit(' {"weight": 0.5, "note": "x"}')).otherwise("")
    head = vertices.select("graph_id").distinct().select("graph_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("t # "), F.col("graph_id").cast("string")).alias("value"))
    own = vertices.select("graph_id", F.lit(1).alias("kind"), F.col("vid").alias("at"), F.concat(F.concat_ws(" ", code, F.col("vid").cast("string"), F.when(F.col("label") == " ", "_").otherwise(F.col("label"))), tail).alias("value"))
    lines = edges.select("graph_id", F.lit(2).alias("kind"), F.col("src").alias("at"), F.concat_ws(" ", F.lit("e"), F.col("src").cast("string"), F.col("dst").cast("string"), "label").alias("value"))
    rows = head.unionByName(own).unionByName(lines)
    return rows.select(F.col("graph_id").alias("file"), (F.col("kind") * 1000 + F.col("at")).alias("line_no"), "value")


def _read_gspan(s: SparkSession, sf: str) -> DataFrame:
    graphs, vertices, edges = formats.read_gspan(_gspan_text(s, sf), "file")
    named = many(graphs).select("file", "graph_id", F.regexp_extract("header", r"(\d+)", 1).cast("long").alias("number"))
    own = vertices.select("file", "graph_id", F.col("vid").alias("a"), F.lit(-1).cast("long").alias("b"), "label", "weight")
    lines = edges.select("file", "graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "label", F.col("len").alias("weight"))
    return own.unionByName(lines).join(named, ["file", "graph_id"]).select("number", "a", "b", "label", "weight")


_GSPAN_ROWS = f"WITH v AS ({C.NAMES_SQL[0]}), e AS ({C.NAMES_SQL[1]}) SELECT graph_id AS number, vid AS a, -1::BIGINT AS b, CASE WHEN label = ' ' THEN '_' ELSE label END AS label, CASE WHEN vid % 7 = 6 THEN 0.5::DOUBLE WHEN vid % 5 = 4 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM v UNION ALL SELECT graph_id, src, dst, '-', 1.0 FROM e"
query("read_gspan", _read_gspan, _GSPAN_ROWS)


def _read_gspan_files(s: SparkSession, sf: str) -> DataFrame:
    """The same after the lines were written to several files and read from their splits."""
    path = f"{shared_folder(s)}/gspan-{uuid.uuid4().hex}"
    _gspan_text(s, sf).repartition(max(7, int(s.conf.get("spark.sql.shuffle.partitions"))), "file").sortWithinPartitions("file", "line_no").select("value").write.text(path)
    graphs, vertices, edges = formats.read_gspan(formats.read_file_lines(s, path), "file", "block")
    named = many(graphs).select("file", "graph_id", F.regexp_extract("header", r"(\d+)", 1).cast("long").alias("number"))
    own = vertices.select("file", "graph_id", F.col("vid").alias("a"), F.lit(-1).cast("long").alias("b"), "label", "weight")
    lines = edges.select("file", "graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "label", F.col("len").alias("weight"))
    return own.unionByName(lines).join(named, ["file", "graph_id"]).select("number", "a", "b", "label", "weight")


query("read_gspan_files", _read_gspan_files, _GSPAN_ROWS)
query("write_gspan", lambda s, sf: formats.gspan_lines(*C.name_graphs(s, sf)).select("graph_id", "kind", "a", "b", "value"), f"WITH v AS ({C.NAMES_SQL[0]}), e AS ({C.NAMES_SQL[1]}) SELECT DISTINCT graph_id, 0 AS kind, -1::BIGINT AS a, -1::BIGINT AS b, 't # ' || graph_id AS value FROM v UNION ALL SELECT graph_id, 1, vid, -1, 'v ' || vid || ' ' || label FROM v UNION ALL SELECT graph_id, 2, src, dst, 'e ' || src || ' ' || dst || ' ' || label FROM e")


def _read_node_link(s: SparkSession, sf: str) -> DataFrame:
    vertices, edges = formats.read_node_link(formats.node_link_lines(*C.name_graphs(s, sf)), "graph_id")
    return vertices.select("graph_id", F.col("vid").alias("a"), F.lit(-1).cast("long").alias("b"), "label").unionByName(edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "label"))


query("read_node_link", _read_node_link, f"WITH v AS ({C.NAMES_SQL[0]}), e AS ({C.NAMES_SQL[1]}) SELECT graph_id, vid AS a, -1::BIGINT AS b, label FROM v UNION ALL SELECT graph_id, src, dst, label FROM e")
query("write_node_link", lambda s, sf: formats.node_link_lines(*C.name_graphs(s, sf)), f"WITH v AS ({C.NAMES_SQL[0]}), e AS ({C.NAMES_SQL[1]}), n AS (SELECT graph_id, string_agg('{{\"id\":' || vid || ',\"label\":\"' || label || '\"}}', ',' ORDER BY vid) AS n FROM v GROUP BY graph_id), k AS (SELECT graph_id, string_agg('{{\"source\":' || src || ',\"target\":' || dst || ',\"label\":\"' || label || '\"}}', ',' ORDER BY src) AS k FROM e GROUP BY graph_id) SELECT graph_id, '{{\"directed\":false,\"multigraph\":false,\"nodes\":[' || n || '],\"links\":[' || coalesce(k, '') || ']}}' AS value FROM n LEFT JOIN k USING (graph_id)")
query("line_serialize_graph", lambda s, sf: formats.adjacency_lines(*C.name_graphs(s, sf)), f"WITH v AS ({C.NAMES_SQL[0]}) SELECT graph_id, string_agg(vid || ':' || label || ' [' || concat_ws(' ', CASE WHEN vid > 0 THEN vid - 1 END, CASE WHEN vid < last THEN vid + 1 END) || ']', '--' ORDER BY vid) AS value FROM (SELECT *, max(vid) OVER (PARTITION BY graph_id) AS last FROM v) GROUP BY graph_id")
query("word_sequence_roundtrip", lambda s, sf: formats.word_sequence_lines(C.word_graphs(s, sf)[0]), f"WITH v AS ({C.WORDS_SQL[0]}) SELECT graph_id, string_agg(label, ' ' ORDER BY vid) || ' ' AS value FROM v GROUP BY graph_id")


# Alignment: names by twos, each even one with the one before.
def _name_pairs(s: SparkSession, sf: str) -> DataFrame:
    ids = C.table(s, sf, "part").filter((F.col("p_partkey") % 2 == 0) & (F.col("p_partkey") > 0))
    return many(ids).select(F.col("p_partkey").alias("pair_id"), F.col("p_partkey").alias("a_id"), (F.col("p_partkey") - 1).alias("b_id"))


def _same_place(s: SparkSession, sf: str) -> DataFrame:
    """The matching that joins vertices of one id."""
    vertices = C.name_graphs(s, sf)[0]
    side = lambda x: _name_pairs(s, sf).join(vertices.select(F.col("graph_id").alias(f"{x}_id"), F.col("vid").alias(f"{x}_vid")), f"{x}_id")
    return side("a").join(side("b").select("pair_id", F.col("b_vid").alias("a_vid")), ["pair_id", "a_vid"]).select("pair_id", "a_vid", F.col("a_vid").alias("b_vid"))


_PLACES = f"v AS ({C.NAMES_SQL[0]}), p AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 0), m AS (SELECT id, a.vid, a.label AS x, b.label AS y FROM p JOIN v a ON a.graph_id = id JOIN v b ON b.graph_id = id - 1 AND b.vid = a.vid), n AS (SELECT id, count(*) AS na, (SELECT count(*) FROM v b WHERE b.graph_id = id - 1) AS nb FROM p JOIN v ON graph_id = id GROUP BY id)"
query("matching_edges_fraction", lambda s, sf: rounded(align.matching_edges_fraction(C.name_graphs(s, sf)[1], _name_pairs(s, sf), _same_place(s, sf)), "fraction"), f"WITH {_PLACES} SELECT id AS pair_id, round((least(na, nb) - 1)::DOUBLE / (na - 1), 6) + 0.0 AS fraction FROM n")
query("matching_neighborhoods_fraction", lambda s, sf: rounded(align.matching_neighborhoods_fraction(*C.name_graphs(s, sf), _name_pairs(s, sf), _same_place(s, sf)), "fraction"), f"WITH {_PLACES} SELECT id AS pair_id, round(CASE WHEN least(na, nb) < 2 THEN 0 WHEN na <= nb THEN 1 ELSE (nb - 1) / na END, 6) + 0.0 AS fraction FROM n")
#: Runs of places at kept edges with equal labels; b's own edges join runs that touch.
_COMMON = f"{_PLACES}, k AS (SELECT id, vid FROM m WHERE x = y), e AS (SELECT a.id, a.vid FROM k a JOIN k b ON a.id = b.id AND b.vid = a.vid + 1), w AS (SELECT id, vid FROM e UNION SELECT id, vid + 1 FROM e), i AS (SELECT id, vid - row_number() OVER (PARTITION BY id ORDER BY vid) AS island FROM w), c AS (SELECT id, island, count(*) AS n FROM i GROUP BY ALL)"
query("max_common_subgraph", lambda s, sf: align.common_subgraphs(*C.name_graphs(s, sf), _name_pairs(s, sf), _same_place(s, sf)).groupBy("pair_id").agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("parts")), f"WITH {_COMMON} SELECT id AS pair_id, max(n) AS largest, count(*) AS parts FROM c GROUP BY id")
query("largest_common_fraction", lambda s, sf: rounded(align.largest_common_fraction(*C.name_graphs(s, sf), _name_pairs(s, sf), _same_place(s, sf)), "fraction"), f"WITH {_COMMON} SELECT id AS pair_id, round(coalesce((SELECT max(c.n) FROM c WHERE c.id = n.id) / nb, 0), 6) + 0.0 AS fraction FROM n")
query("matching_quality", lambda s, sf: rounded(align.matching_quality(*C.name_graphs(s, sf), _name_pairs(s, sf), _same_place(s, sf)), "quality"), f"WITH {_COMMON} SELECT id AS pair_id, round(coalesce((SELECT sum(c.n) FROM c WHERE c.id = n.id) / nb, 0), 6) + 0.0 AS quality FROM n")


def _vectors(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The query set and all rows."""
    rows = C.table(s, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows.filter("id % 50 = 0"), rows


_GAPS = "g AS (SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2))), 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"
query("vec_pairwise_distance", lambda s, sf: gaps.gaps(*_vectors(s, sf)), f"WITH {_GAPS} FROM g")


query("vec_knn", lambda s, sf: gaps.nearest(*_vectors(s, sf), 5), f"WITH {_GAPS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM g) WHERE rank <= 5")


def _names_by_twos(s: SparkSession, sf: str):
    return *C.name_graphs(s, sf), _name_pairs(s, sf)


query("graph_align", lambda s, sf: align.match(*_names_by_twos(s, sf)))
query("stable_match", lambda s, sf: (lambda g: align.stable_match(align.vertex_distances(graph_vectorizer.vertex_vectorize(g[0], g[1], BASE), g[2])))(_names_by_twos(s, sf)))
query(
    "annotate_sequences_linear",
    lambda s, sf: rounded(annotate.annotate_sequences(C.names(s, sf), SequenceOptions(r=1, d=1, nbits=20), annotate.Linear(((F.col("feature") % 7) - 3) / F.lit(10.0))), "importance"),
    sequence_ctes(C.PART_SQL, SequenceOptions(r=1, d=1, nbits=20), by_position=True) + " SELECT s.id, s.pos, token, round(coalesce(m, 0), 6) + 0.0 AS importance FROM (SELECT id, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS token FROM s) s LEFT JOIN (SELECT id, pos, sum(value * (feature % 7 - 3) / 10.0::DOUBLE) AS m FROM result GROUP BY ALL) USING (id, pos)",
)
query(
    "annotate_sequences_probability",
    lambda s, sf: rounded(annotate.annotate_sequences(C.names(s, sf), SequenceOptions(r=1, d=1, nbits=20), annotate.Linear(((F.col("feature") % 7) - 3) / F.lit(10.0), 0.1), probability=True), "importance"),
    sequence_ctes(C.PART_SQL, SequenceOptions(r=1, d=1, nbits=20), by_position=True) + " SELECT s.id, s.pos, token, round(1 / (1 + exp(-coalesce(m, 0.1::DOUBLE))), 6) + 0.0 AS importance FROM (SELECT id, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS token FROM s) s LEFT JOIN (SELECT id, pos, sum(value * (feature % 7 - 3) / 10.0::DOUBLE) + 0.1::DOUBLE AS m FROM result GROUP BY ALL) USING (id, pos)",
)


def _written(s: SparkSession, values: DataFrame) -> DataFrame:
    """Lines that were written to files of the shared folder and read again."""
    path = f"{shared_folder(s)}/lines-{uuid.uuid4().hex}"
    values.write.text(path)
    return formats.read_lines(s, path)


def _read_characters(s: SparkSession, sf: str) -> DataFrame:
    vertices, _ = formats.read_sequences(_written(s, C.table(s, sf, "part").select("p_name")))
    return vertices.groupBy("vid", "label").agg(F.count(F.lit(1)).alias("n"))


def _read_words(s: SparkSession, sf: str) -> DataFrame:
    lines = C.table(s, sf, "documents").filter("text is not null").select(F.regexp_replace("text", r"[\x09-\x0D]", " "))
    vertices, edges = formats.read_word_sequences(_written(s, lines))
    return vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def _read_targets(s: SparkSession, sf: str) -> DataFrame:
    lines = C.table(s, sf, "part").select(F.explode(F.array(F.col("p_size").cast("string"), F.lit(" "))))
    return formats.read_targets(_written(s, lines)).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def _node_link_files(s: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(s)}/graphs-{uuid.uuid4().hex}"
    formats.write_node_link(*C.role_graphs(s, sf), path)
    _, edges = formats.read_node_link(formats.read_lines(s, path))
    return edges.groupBy("src", "dst", "label", "weight", "nesting").agg(F.count(F.lit(1)).alias("n"))


query("read_characters", _read_characters, f"SELECT vid, label, count(*) AS n FROM (SELECT unnest(range(0, len(tokens))) AS vid, unnest(tokens) AS label FROM ({C.PART_SQL})) GROUP BY ALL")
query("read_words", _read_words, f"WITH v AS ({C.WORDS_SQL[0]}) SELECT label, count(*) AS n FROM v GROUP BY label UNION ALL SELECT '-', count(*) FROM v WHERE vid > 0 HAVING count(*) > 0")
query("read_targets", _read_targets, "SELECT CAST(p_size AS INTEGER) AS target, count(*) AS n FROM part GROUP BY ALL")
query("node_link_files", _node_link_files, f"WITH v AS ({C.ROLES_SQL[0]}), e AS ({C.ROLES_SQL[1]}) SELECT src, dst, label, weight, nesting, count(*) AS n FROM e GROUP BY ALL")
query(
    "join_pre_processes",
    lambda s, sf: sampling.pre_processed(C.names(s, sf), [lambda d: d.select("id", F.array_join("tokens", "").alias("text")), lambda d: d.select("id", F.array_join(F.reverse("tokens"), "").alias("text"))], [1.0, 0.5]),
    "SELECT p_partkey AS id, p_name AS text, 0 AS process, 1.0::DOUBLE AS process_weight FROM part UNION ALL SELECT p_partkey, reverse(p_name), 1, 0.5 FROM part",
)
