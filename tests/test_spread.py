"""Steps whose rows grow are dealt to many tasks, however small the table or how large the hub they come from."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from vicinage.operators import graph_vectorizer as G
from vicinage.operators import neighborhoods as N
from vicinage.operators import sequence_vectorizer as S
from vicinage.operators.options import GraphOptions, SequenceOptions
from vicinage.sources import corpora


def test_sequences_of_one_part_are_unfolded_in_many(spark, monkeypatch):
    sequences = spark.createDataFrame([(k, [c for c in f"{k:03d}"]) for k in range(60)], "id long, tokens array<string>").coalesce(1)
    parts, pairs = [], S._pairs

    def watched(s, options):
        parts.append(s.rdd.getNumPartitions())
        return pairs(s, options)

    monkeypatch.setattr(S, "_pairs", watched)
    S.vectorize(sequences, SequenceOptions(nbits=20))
    S.position_vectorize(sequences, SequenceOptions(nbits=20))
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2


def test_windows_of_long_sequences(spark):
    """Rows that carry the tokens in reach alone have the pairs of plain loops."""
    pick, rows = random.Random(3), []
    for k in range(4):
        tokens = [pick.choice("ab,") for _ in range(pick.choice([1, 3, 30]))]
        rows.append((k, tokens, [float(pick.randint(1, 9)) for _ in tokens]))
    for options in (SequenceOptions(r=2, d=3, nbits=20), SequenceOptions(r=1, d=0, nbits=20), SequenceOptions(r=0, d=2, min_d=1, nbits=20)):
        want = {}
        for k, tokens, weights in rows:
            for pos in range(len(tokens)):
                for r in range(options.min_r, options.radius + 1):
                    for offset in (*range(options.min_d, options.distance + 1), *range(-options.distance, -options.min_d)):
                        end = pos + offset
                        if end >= 0 and max(pos, end) + r < len(tokens):
                            key = (k, pos, end, r)
                            want[key] = want.get(key, 0.0) + sum(weights[pos : pos + r + 1]) + sum(weights[end : end + r + 1])
        found = S._pairs(spark.createDataFrame(rows, "id long, tokens array<string>, weights array<double>"), options).collect()
        assert len(found) == len(want) and {(x["id"], x["pos"], x["end"], x["r"]): x["value"] for x in found} == want


def test_steps_from_a_hub_are_dealt(spark, monkeypatch):
    """Stars whose middles are hubs, with a path behind: hops as in plain search, and no task that has a hub's steps whole."""
    monkeypatch.setattr(N, "STEPS", 4)
    edges = [(g, 0, k) for g in (1, 2) for k in range(1, 30)] + [(1, 1, 30), (1, 30, 31), (2, 2, 3)]
    near, vertices = {}, sorted({(g, v) for g, a, b in edges for v in (a, b)})
    for g, a, b in edges:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)
    want = set()
    for g, root in vertices:
        hops, level = {root: 0}, {root}
        for hop in (1, 2, 3):
            level = {y for x in level for y in near[g, x]} - set(hops)
            hops |= dict.fromkeys(level, hop)
        want |= {(g, root, v, h) for v, h in hops.items()}
    lines = spark.createDataFrame([(*e, False) for e in edges], "graph_id long, u long, v long, nesting boolean")
    found = N.distances(spark.createDataFrame(vertices, "graph_id long, vid long"), lines, 3)
    rows = [(r["graph_id"], r["root"], r["vid"], r["hops"]) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_shuffled_before_their_words(spark, small):
    """Words stay where their text was dealt to, so texts are shuffled and rows of words are not."""
    plan = entry_module.queries()["word_sequence_roundtrip"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("Generate")


def test_lifted_features_are_made_in_many_tasks(spark):
    """The few features of 60 graphs fit one task; what their vectors lift them to is dealt. Vectors and keys may be missing."""
    rows = [(g, v, "ab"[v % 2], None if g == 3 else [] if g == 4 else [float(g + v + k) for k in range(5)], None if g == 5 else {} if g == 6 else {"x": 2.0, "y": float(v)}) for g in range(60) for v in range(3)]
    vertices = spark.createDataFrame(rows, "graph_id long, vid long, label string, vec array<double>, svec map<string,double>")
    edges = spark.createDataFrame([(g, v, v + 1, "-") for g in range(60) for v in range(2)], "graph_id long, src long, dst long, label string")
    options = GraphOptions(r=1, d=1, nbits=20)
    plain = G.rooted_features(vertices.drop("vec", "svec"), edges, options).groupBy("graph_id", "vid", "r", "d", "feature").agg(F.sum("value").alias("value")).collect()
    lifted = G.rooted_features(vertices, edges, options.set_params(discrete=False))
    assert lifted.select(F.spark_partition_id()).distinct().count() > 4
    own, mask, want = {(g, v): (vec, svec) for g, v, _, vec, svec in rows}, (1 << 20) - 1, {}
    hashed = {(f, k): h for f, k, h in spark.createDataFrame([(f, k) for x in plain for k in "xy" for f in ((x["feature"] + i) % mask for i in range(5))] + [(x["feature"], k) for x in plain for k in "xy"], "f long, k string").distinct().select("f", "k", (G.text_hash(F.col("f"), F.col("k")).bitwiseAND(mask) + 1).alias("h")).collect()}
    for x in plain:
        vec, svec = own[x["graph_id"], x["vid"]]
        for f, value in [((x["feature"] + i) % mask, x["value"] * y) for i, y in enumerate(vec)] if vec else [(x["feature"], x["value"])]:
            for at, y in [(f, value), *([(hashed[f, k], value * y) for k, y in svec.items()] if svec else [(f, value)])]:
                key = (x["graph_id"], x["vid"], x["r"], x["d"], at)
                want[key] = want.get(key, 0.0) + y
    found = lifted.groupBy("graph_id", "vid", "r", "d", "feature").agg(F.sum("value").alias("value")).collect()
    assert {tuple(x)[:5]: round(x["value"], 6) for x in found} == {k: round(y, 6) for k, y in want.items()}


def test_lines_of_orders_are_numbered_once(spark, small):
    """Each use of an order's vertices or edges sorted and shuffled whole line items anew."""
    vertices, edges = corpora.order_graphs(spark, small)
    for table in (vertices, edges):
        assert "Window" not in table._jdf.queryExecution().executedPlan().toString()
    lengths = corpora.order_graphs(spark, small, lengths=True)[1]
    weights = {(r["graph_id"], r["vid"]): r["weight"] for r in vertices.collect()}
    assert edges.count() == lengths.count() and all(r["length"] == weights[r["graph_id"], r["dst"]] for r in lengths.collect())
