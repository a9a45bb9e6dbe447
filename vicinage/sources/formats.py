"""Readers and writers of graph and sequence files: gSpan text, node-link JSON lines, sequences, targets, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.sources.corpora import paths

ATTRIBUTES = "map<string,string>"


def read_lines(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """line_no, value. A list of lines is taken as it is. Numbers of files are unique and rise within a file;
    which file comes first is Spark's choice."""
    if isinstance(source, list):
        return spark.createDataFrame(list(enumerate(source)), "line_no long, value string")
    return spark.read.text(source).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where a split of the file begins), line_no (rising within a block), value."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("line_no"), "value")


def _begun(rows: DataFrame, document: str | None, block: str | None) -> DataFrame:
    """``rows`` with graph_id: how many of the document's heads are not behind the row.

    With blocks, heads are counted within each one and carried on over the counts of the document's blocks before it.
    """
    own = [c for c in (document, block) if c]
    within = Window.partitionBy(*(own or [F.lit(0)])).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("graph_id", F.sum("head").over(within).cast("long"))
    if not block:
        return rows
    before = Window.partitionBy(document).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*own).agg(F.sum("head").alias("_heads")).select(*own, F.coalesce(F.sum("_heads").over(before), F.lit(0)).alias("_before"))
    return rows.join(heads, own).withColumn("graph_id", F.col("graph_id") + F.col("_before")).drop("_before")


def read_gspan(lines: DataFrame, document: str | None = None, block: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs (graph_id, header), vertices (graph_id, vid, label, weight, attrs), edges (graph_id, src, dst, label, len, attrs).

    A line that begins with g or t begins a graph; lines before the first one are graph 0 with an empty header. Blank
    lines and unknown codes are skipped. V is a vertex of weight 0.1, v one of weight 1; JSON behind the label gives
    attributes, of which ``label`` and ``weight`` override. A graph without vertices has a row in graphs alone.
    ``document`` names a column that keeps the lines of different files apart, ``block`` one that cuts each file into
    parts in order, so that no task holds a file; read_file_lines() has both.
    """
    code = F.substring(F.trim("value"), 1, 1)
    rows = lines.filter(F.trim("value") != "").withColumn("code", code).withColumn("head", F.col("code").isin("g", "t").cast("int"))
    rows = _begun(rows, document, block)
    keys = [document, "graph_id"] if document else ["graph_id"]
    graphs = rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("head") == 1, F.trim("value"))), F.lit("")).alias("header"))
    words = F.split(F.trim("value"), r"\s+")
    attrs = lambda k: F.from_json(F.regexp_extract(F.trim("value"), r"^(?:\S+\s+){%d}(\{.*\})$" % k, 1), ATTRIBUTES)
    own = rows.filter(F.lower("code") == "v").select(*keys, words[1].cast("long").alias("vid"), words[2].alias("label"), F.when(F.col("code") == "V", 0.1).otherwise(1.0).alias("weight"), attrs(3).alias("attrs"))
    vertices = own.withColumns({"label": F.coalesce(F.col("attrs")["label"], "label"), "weight": F.coalesce(F.col("attrs")["weight"].cast("double"), "weight")})
    lines_ = rows.filter(F.col("code") == "e").select(*keys, words[1].cast("long").alias("src"), words[2].cast("long").alias("dst"), words[3].alias("label"), F.lit(1.0).alias("len"), attrs(4).alias("attrs"))
    edges = lines_.withColumns({"label": F.coalesce(F.col("attrs")["label"], "label"), "weight": F.col("attrs")["weight"].cast("double"), "nesting": F.lower(F.col("attrs")["nesting"]).isin("true", "1")})
    return graphs, vertices, edges


def gspan_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, kind, a, b, value: the lines of a gSpan file in the order of the first four columns; attributes are left out."""
    none = F.lit(-1).cast("long")
    heads = vertices.select("graph_id").distinct().select("graph_id", F.lit(0).alias("kind"), none.alias("a"), none.alias("b"), F.concat(F.lit("t # "), F.col("graph_id").cast("string")).alias("value"))
    own = vertices.select("graph_id", F.lit(1).alias("kind"), F.col("vid").alias("a"), none.alias("b"), F.concat_ws(" ", F.lit("v"), F.col("vid").cast("string"), "label").alias("value"))
    lines = edges.select("graph_id", F.lit(2).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.lit("e"), F.col("src").cast("string"), F.col("dst").cast("string"), "label").alias("value"))
    return heads.unionByName(own).unionByName(lines)


def write_gspan(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    gspan_lines(vertices, edges).orderBy("graph_id", "kind", "a", "b").select("value").write.text(path)


NODE_LINK = "struct<nodes:array<struct<id:bigint,label:string,weight:double>>,links:array<struct<source:bigint,target:bigint,label:string,weight:double,nesting:boolean>>>"


def read_node_link(lines: DataFrame, key: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of one JSON graph a line; graph_id is the line's key."""
    rows = lines.filter(F.trim("value") != "").select(F.col(key).alias("graph_id"), F.from_json("value", NODE_LINK).alias("g"))
    vertices = rows.select("graph_id", F.explode("g.nodes").alias("n")).select("graph_id", F.col("n.id").alias("vid"), "n.label", "n.weight")
    edges = rows.select("graph_id", F.explode("g.links").alias("e")).select("graph_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.label", "e.weight", F.coalesce("e.nesting", F.lit(False)).alias("nesting"))
    return vertices, edges


def node_link_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, value: a JSON graph a row, nodes and links in order of their ids.

    Weights of vertices and edges and the nesting of edges are written where there are such columns; nulls are left out.
    """
    own = [F.col("vid").alias("id"), "label", *[c for c in ("weight",) if c in vertices.columns]]
    ends = [F.col("src").alias("source"), F.col("dst").alias("target"), "label", *[c for c in ("weight", "nesting") if c in edges.columns]]
    nodes = vertices.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("nodes"))
    links = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(*ends))).alias("links"))
    whole = F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), "nodes", F.coalesce("links", F.array().cast(links.schema["links"].dataType)).alias("links"))
    return nodes.join(links, "graph_id", "left").select("graph_id", F.to_json(whole).alias("value"))


def write_node_link(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A JSON graph a line, in order of graph_id."""
    node_link_lines(vertices, edges).orderBy("graph_id").select("value").write.text(path)


def adjacency_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, value: ``id:label [neighbours]`` of each vertex, joined by ``--``."""
    from vicinage.operators.neighborhoods import both_ways, simple_edges

    near = both_ways(simple_edges(edges)).groupBy("graph_id", F.col("a").alias("vid")).agg(F.sort_array(F.collect_list("b")).alias("near"))
    each = vertices.join(near, ["graph_id", "vid"], "left").select("graph_id", "vid", F.concat(F.col("vid").cast("string"), F.lit(":"), "label", F.lit(" ["), F.coalesce(F.array_join(F.transform("near", lambda v: v.cast("string")), " "), F.lit("")), F.lit("]")).alias("text"))
    return each.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("vid", "text"))).alias("t")).select("graph_id", F.array_join(F.transform("t", lambda t: t["text"]), "--").alias("value"))


def read_sequences(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Path graphs of the characters of each line that isn't empty."""
    from vicinage.operators.sequence_vectorizer import tokens_of

    return paths(lines.filter("value <> ''").select(F.col("line_no").alias("id"), tokens_of(F.col("value")).alias("tokens")))


def read_word_sequences(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Path graphs of the words of each line that has one."""
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    return paths(lines.select(F.col("line_no").alias("id"), words.alias("tokens")).filter(F.size("tokens") > 0))


def word_sequence_lines(vertices: DataFrame) -> DataFrame:
    """graph_id, value: labels in order of vertex id, each with a space behind it."""
    rows = vertices.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("vid", "label"))).alias("t"))
    return rows.select("graph_id", F.concat(F.array_join(F.transform("t", lambda t: t["label"]), " "), F.lit(" ")).alias("value"))


def read_targets(lines: DataFrame) -> DataFrame:
    """line_no, target: one integer a line that isn't blank."""
    return lines.filter(F.trim("value") != "").select("line_no", F.trim("value").cast("int").alias("target"))


def matrix_market_lines(features: DataFrame, key: str, nbits: int) -> DataFrame:
    """row, value: the lines of a MatrixMarket file behind its header, rows and columns from 1."""
    return features.select(F.col(key).alias("row"), F.concat_ws(" ", (F.col(key) + 1).cast("string"), (F.col("feature") + 1).cast("string"), F.col("value").cast("string")).alias("value"))


def serialized(values: Column, separator: str = "_") -> Column:
    """A list as text."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)
