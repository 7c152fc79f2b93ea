"""Reading and writing the file formats of the pipeline."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemaruang.functions import text as T


def read_csv(spark: SparkSession, path: str, na_tokens: bool = False, order: str | None = "ord") -> DataFrame:
    """All columns as strings, records over several lines allowed; ``order`` adds the position of each row.

    ``na_tokens`` makes the usual words for missing values null; otherwise blanks are ``''``. The order is that of files and of rows within
    them, as monotonic ids; for one file it is the line order.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, nullValue="\x00", emptyValue="")
    names = df.columns
    out = df.select(*[(T.null_tokens(f"`{c}`") if na_tokens else T.blank_if_null(f"`{c}`")).alias(c) for c in names])
    return out.withColumn(order, F.monotonically_increasing_id()) if order else out


def read_validated(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Only the required columns, stripped; rows of blanks are left out, missing columns are an error."""
    df = read_csv(spark, path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = df.select(*[T.strip(c).alias(c) for c in required], "ord")
    return out.filter(F.greatest(*[F.length(c) for c in required]) > 0 if len(required) > 1 else F.length(required[0]) > 0)


def read_lines(spark: SparkSession, path: str, column: str = "word") -> DataFrame:
    """Stripped lines that are not blank, with their order."""
    lines = spark.read.text(path).select(T.strip("value").alias(column), F.monotonically_increasing_id().alias("ord"))
    return lines.filter(F.col(column) != "")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select("word").distinct()


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Only lines of several words."""
    return read_lines(spark, path, "phrase").filter(F.col("phrase").contains(" ")).select("phrase").distinct()


def read_slang_lines(spark: SparkSession, path: str) -> DataFrame:
    """(slang, formal, ord) of ``slang:formal`` lines, split at the first colon; lines without one are left out."""
    lines = read_lines(spark, path, "value").filter(F.col("value").contains(":"))
    parts = F.split("value", ":", 2)
    return lines.select(T.strip(parts[0]).alias("slang"), T.strip(parts[1]).alias("formal"), "ord")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of an edge list with commas or blanks; short lines are left out, edges are undirected and simple."""
    parts = F.filter(F.split(F.trim(F.regexp_replace("value", r"[,\s]+", " ")), " "), lambda t: t != "")
    ends = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 2).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    return ends.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a GML file as this package and common tools write it; the label is the id.

    The whole text is split into node and edge blocks by expressions, so a file is one row but its blocks are spread.
    """
    body = spark.read.text(path, wholetext=True)
    block = lambda kind: F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\n\s*\]"), F.lit(1))).alias("b")
    nodes = body.select(block("node")).select(F.regexp_extract("b", r"(?m)^\s*id\s+(\S+)", 1).alias("n"), F.regexp_extract("b", r'(?m)^\s*label\s+"?(.*?)"?\s*$', 1).alias("label"))
    nodes = nodes.select("n", F.when(F.col("label") != "", F.col("label")).otherwise(F.col("n")).alias("id"))
    ends = body.select(block("edge")).select(F.regexp_extract("b", r"source\s+(\S+)", 1).alias("s"), F.regexp_extract("b", r"target\s+(\S+)", 1).alias("t"))
    a, b = nodes.select(F.col("n").alias("s"), F.col("id").alias("x")), nodes.select(F.col("n").alias("t"), F.col("id").alias("y"))
    edges = ends.join(a, "s").join(b, "t").filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    return nodes.select("id"), edges


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a word2vec text file, compressed or not, its header line left out. A gzip file cannot be split: convert it once."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") > 2)
    return rows.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.try_cast("double")).alias("vec"))


def read_aspect_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(users, vectors) of a wide matrix: users (id, community) and long vectors, the last row of an id counting."""
    from gemaruang.functions.vectors import parse_vector

    wide = read_csv(spark, path)
    aspects = [c for c in wide.columns if c not in ("id", "community", "ord")]
    users = wide.groupBy("id").agg(F.max_by("community", "ord").alias("community"))
    last = wide.groupBy("id").agg(F.max_by(F.struct("community", *[f"`{a}`" for a in aspects]), "ord").alias("r"))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), F.col("r")[a].alias("cell")) for a in aspects]))
    long = last.select("id", F.col("r.community").alias("community"), cells.alias("c")).select("id", "community", F.col("c.aspect").alias("aspect"), parse_vector("c.cell").alias("vec"))
    return users, long


def output_path(source: str, out: str, stamp: bool = False) -> str:
    """Where to write: a folder takes the source's name (with the time where asked); the source itself is refused."""
    if os.path.isdir(out) or out.endswith("/"):
        stem, ext = os.path.splitext(os.path.basename(source.rstrip("/")))
        out = os.path.join(out, f"{stem}_{int(time.time())}{ext}" if stamp else stem + ext)
    if os.path.abspath(out) == os.path.abspath(source):
        raise ValueError("the output must not overwrite the input")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are written as bracketed lists."""
    cells = [F.when(F.col(f"`{n}`").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(F.col(f"`{n}`"), lambda x: x.cast("string")), ", "), F.lit("]"))).alias(n) if t.startswith("array") else F.col(f"`{n}`") for n, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").csv(path, header=True, escape='"')


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def _quoted(c: str):
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), '"', "&quot;"), F.lit('"'))


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, a, b, value): the lines of a GML file, to be ordered by the first three columns; nodes are (id, attributes...)."""
    extra = [c for c in nodes.columns if c != "id"]
    block = F.concat(F.lit("  node [\n    id "), F.conv(F.hex(F.xxhash64("id")), 16, 10), F.lit("\n    label "), _quoted("id"), *[x for c in extra for x in (F.lit(f"\n    {c.replace('_', '')} "), _quoted(c))], F.lit("\n  ]"))
    num = lambda c: F.conv(F.hex(F.xxhash64(c)), 16, 10)
    n = nodes.select(F.lit(1).alias("section"), F.col("id").alias("a"), F.lit("").alias("b"), block.alias("value"))
    e = edges.select(F.lit(2).alias("section"), F.col("u").alias("a"), F.col("v").alias("b"), F.concat(F.lit("  edge [\n    source "), num("u"), F.lit("\n    target "), num("v"), F.lit("\n  ]")).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, "", "", "graph ["), (3, "", "", "]")], "section int, a string, b string, value string")
    return ends.unionByName(n).unionByName(e)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, a, b, value): the lines of a GraphML file."""
    extra = [c for c in nodes.columns if c != "id"]

    def xml(c: str):
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")

    node = F.concat(F.lit('<node id="'), xml("id"), F.lit('">'), *[x for c in extra for x in (F.lit(f'<data key="{c}">'), xml(c), F.lit("</data>"))], F.lit("</node>"))
    n = nodes.select(F.lit(1).alias("section"), F.col("id").alias("a"), F.lit("").alias("b"), node.alias("value"))
    e = edges.select(F.lit(2).alias("section"), F.col("u").alias("a"), F.col("v").alias("b"), F.concat(F.lit('<edge source="'), xml("u"), F.lit('" target="'), xml("v"), F.lit('"/>')).alias("value"))
    keys = "".join(f'<key id="{c}" for="node" attr.name="{c}" attr.type="string"/>' for c in extra)
    head = f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'
    ends = nodes.sparkSession.createDataFrame([(0, "", "", head), (3, "", "", "</graph></graphml>")], "section int, a string, b string, value string")
    return ends.unionByName(n).unionByName(e)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "gml") -> None:
    """One text file in order; a graph file is a format of one file, so its lines pass through one writing task."""
    lines = {"gml": gml_lines, "graphml": graphml_lines}[form](nodes, edges)
    lines.orderBy("section", "a", "b").select("value").coalesce(1).write.mode("overwrite").text(path)
