"""gSpan files whose records cross the splits, and pairs without edges beside plain sets."""

import random

from vicinage.operators import links
from vicinage.sources import formats


def test_gspan_records_across_splits(spark, tmp_path):
    """Ten files of unequal size, read in splits of about a kilobyte: graphs go on over splits, and files begin anew."""
    pick, expected = random.Random(1), {}
    for f in range(10):
        lines = []
        for g in range(pick.randrange(1, 30)):
            n = pick.choice([1, 2, 5, 60])
            expected[f, g + 1] = (f"t # {f}-{g}", n, max(0, n - 1))
            lines += [f"t # {f}-{g}", *[f"v {k} a{k}" for k in range(n)], *[f"e {k} {k + 1} -" for k in range(n - 1)]]
        (tmp_path / f"{f}.gspan").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = formats.read_file_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 20
        graphs, vertices, edges = formats.read_gspan(lines, "file", "block")
        count = lambda df: {(r["file"], r["graph_id"]): r["count"] for r in df.groupBy("file", "graph_id").count().collect()}
        n, m = count(vertices), count(edges)
        got = {(int(r["file"].rsplit("/", 1)[1].split(".")[0]), r["graph_id"]): (r["header"], n.get((r["file"], r["graph_id"]), 0), m.get((r["file"], r["graph_id"]), 0)) for r in graphs.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected


def test_drawn_pairs_are_no_edges_and_differ(spark):
    """Graphs of all small sizes: as many pairs as are wanted, all of them where there are too few."""
    pick, vertices, edges = random.Random(2), [], []
    for g in range(2, 14):
        vertices += [(g, 10 * v, "a") for v in range(g)]
        edges += [(g, 10 * u, 10 * v, "-") for u in range(g) for v in range(u + 1, g) if pick.random() < 0.15]
    v, e = spark.createDataFrame(vertices, "graph_id long, vid long, label string"), spark.createDataFrame(edges, "graph_id long, src long, dst long, label string")
    for ratio in (1, 10):
        found = [tuple(r) for r in links.sampled_non_edges(v, e, ratio).collect()]
        assert len(found) == len(set(found)) and all(u < w for _, u, w in found)
        assert not set(found) & {x[:3] for x in edges}
        for g in range(2, 14):
            m = sum(x[0] == g for x in edges)
            assert sum(x[0] == g for x in found) == min(ratio * m, g * (g - 1) // 2 - m)


def test_no_plan_makes_all_pairs(spark):
    v, e = spark.createDataFrame([(1, k, "a") for k in range(9)], "graph_id long, vid long, label string"), spark.createDataFrame([(1, 0, 1, "-")], "graph_id long, src long, dst long, label string")
    plan = links.sampled_non_edges(v, e)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and all("=" in line for line in joins), joins
    assert links.link_split(v, e).count() == 11


def test_written_files_grow_in_number(spark, small, monkeypatch):
    """gSpan lines are written to as many files as a shuffle has parts, so that no part grows with the table."""
    from vicinage.plans import data_queries

    paths, read = [], data_queries.formats.read_file_lines
    monkeypatch.setattr(data_queries.formats, "read_file_lines", lambda s, path: paths.append(path) or read(s, path))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        data_queries._read_gspan_files(spark, small)
        assert len(spark.read.text(paths[0]).inputFiles()) > 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
