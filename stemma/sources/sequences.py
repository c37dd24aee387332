"""Readers and writers of sequence files: FASTA, Stockholm, Newick, pair records and split files.

Paths go to Spark's readers, so any store and compression that Spark opens will do.  A Stockholm or
Newick file holds one family or tree and is read whole, one file to a row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_SCHEMA = "x string, a string, y string, t double, fam string, id string, gamma array<int>, gamma_lp array<array<float>>"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of every record; the name is the header's first word, the sequence loses white space."""
    # a record ends where the next line begins with the mark; the mark may also stand within a header
    text = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))
    records = text.where(F.length(F.trim("value")) > 0)
    head = F.split("value", "\n", 2)
    return records.select(F.regexp_extract(head[0], r"^\s*(\S*)", 1).alias("name"), F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def write_fasta(records: DataFrame, path: str, *, wrap: int = 60) -> None:
    """Writes name and seq with lines of ``wrap`` letters."""
    lines = F.regexp_replace("seq", f"(.{{{wrap}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines)).write.text(path)


def _stockholm_lines(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^/]*)?$", 1).alias("fam"), "value")
    return files.select("fam", F.posexplode(F.split("value", r"\r?\n"))).withColumnRenamed("col", "line")


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """fam, row_idx, name, aln: wrapped blocks of one name are joined in the order of the file."""
    lines = _stockholm_lines(spark, path).where(~F.col("line").startswith("#") & ~F.col("line").startswith("//") & (F.trim("line") != ""))
    parts = lines.select("fam", "pos", F.split(F.trim("line"), r"\s+", 2).alias("p")).where(F.size("p") == 2)
    rows = parts.groupBy("fam", F.col("p")[0].alias("name")).agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", F.col("p")[1].alias("part")))).alias("parts"))
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("fam").orderBy("first")) - 1
    return rows.select("fam", index.alias("row_idx"), "name", F.array_join(F.col("parts.part"), "").alias("aln"))


def read_stockholm_annotations(spark: SparkSession, path: str) -> DataFrame:
    """fam, kind (GC, GS or GR), name (null for GC), tag, value."""
    lines = _stockholm_lines(spark, path).where(F.col("line").rlike("^#=G[CSR] "))
    kind = F.substring("line", 3, 2)
    rest = F.split(F.trim(F.substring("line", 6, 1 << 30)), r"\s+")
    text = lambda n: F.array_join(F.slice(rest, n, F.size(rest)), " ")
    made = lines.select("fam", "pos", kind.alias("kind"), F.when(kind != "GC", rest[0]).alias("name"), F.when(kind == "GC", rest[0]).otherwise(rest[1]).alias("tag"), F.when(kind == "GC", text(2)).otherwise(text(3)).alias("value"))
    sep = F.when(F.col("kind") == "GS", " ").otherwise("")
    return made.groupBy("fam", "kind", "name", "tag").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v")).select("fam", "kind", "name", "tag", F.when(F.col("kind") == "GS", F.array_join("v.value", " ")).otherwise(F.array_join("v.value", "")).alias("value"))


EDGE = T.ArrayType(T.StructType([T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("branch_length", T.DoubleType()), T.StructField("is_leaf", T.BooleanType()), T.StructField("depth", T.IntegerType())]))


def newick_edges(text: str | None) -> list[tuple]:
    """(node, parent, name, branch length, is leaf, depth) of each node of a Newick tree, in preorder."""
    import re

    rows: list[list] = []
    stack: list[int] = []
    open_node, expect_name = None, True
    for token in re.findall(r"'(?:[^']|'')*'|[(),:;]|[^(),:;\s]+", text or ""):
        if token in "(,":
            if token == "(":
                node = len(rows) if open_node is None else open_node
                if open_node is None:
                    rows.append([node, stack[-1] if stack else None, "", 0.0, True, len(stack)])
                rows[node][4] = False
                stack.append(node)
            open_node, expect_name = None, True
        elif token == ")":
            open_node, expect_name = stack.pop(), True
        elif token == ":":
            expect_name = False
        elif token == ";":
            break
        else:
            if open_node is None:
                open_node = len(rows)
                rows.append([open_node, stack[-1] if stack else None, "", 0.0, True, len(stack)])
            if expect_name:
                rows[open_node][2] = token.strip("'").replace("''", "'")
            else:
                rows[open_node][3], expect_name = float(token), True
    return [tuple(r) for r in rows]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """tree_id, node_id, parent_id, name, branch_length, is_leaf, depth; one tree to a file, files parsed by Arrow batches."""
    kind = T.StructType([T.StructField("tree_id", T.StringType()), *EDGE.elementType.fields])

    def run(batches):
        for b in batches:
            rows = [(tree, *node) for tree, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for node in newick_edges(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.int32()), strict=True)], kind.fieldNames())

    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^/]*)?$", 1).alias("tree_id"), "value")
    return files.mapInArrow(run, kind)


def newick(nodes: list[tuple[int, int | None, str, float]]) -> str:
    """The Newick text of one tree's nodes (node, parent, name, branch length), however deep; a node's children in order of their numbers."""
    children: dict = {}
    for node in sorted(nodes, key=lambda n: n[0]):
        children.setdefault(node[1], []).append(node)
    out, stack = [], [(n, True, 0) for n in reversed(children.get(None, []))]
    while stack:
        (number, parent, name, length), opening, place = stack.pop()
        below = children.get(number, [])
        if opening:
            if place:
                out.append(",")
            if below:
                out.append("(")
                stack.append(((number, parent, name, length), False, place))
                stack += [(n, True, k) for k, n in reversed(list(enumerate(below)))]
                continue
        elif below:
            out.append(")")
        out.append(f"{name};" if parent is None else f"{name}:{length:g}")
    return "".join(out)


def write_newick(edges: DataFrame) -> DataFrame:
    """tree_id, newick of trees given as edges; each tree's edges fit one group."""

    def run(key, table):
        parents = [None if p is None else int(p) for p in table["parent_id"].to_pylist()]
        nodes = list(zip(table["node_id"].to_pylist(), parents, table["name"].to_pylist(), table["branch_length"].to_pylist(), strict=True))
        return pa.table({"tree_id": [key[0].as_py()], "newick": [newick(nodes)]})

    return edges.select("tree_id", "node_id", "parent_id", "name", "branch_length").groupBy("tree_id").applyInArrow(run, "tree_id string, newick string")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair records from JSON lines, compressed or not."""
    return spark.read.schema(PAIR_SCHEMA).json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """split, fam from a JSON file of lists named train, val and test."""
    raw = spark.read.schema("train array<string>, val array<string>, test array<string>").option("multiLine", True).json(path)
    return raw.select(F.explode(F.create_map(*[x for k in ("train", "val", "test") for x in (F.lit(k), F.coalesce(k, F.array().cast("array<string>")))])).alias("split", "fams")).select("split", F.explode("fams").alias("fam"))


def read_clans(spark: SparkSession, path: str) -> DataFrame:
    """fam, clan from tab-separated lines; a family without a clan is its own."""
    raw = spark.read.option("sep", "\t").schema("fam string, clan string").csv(path)
    return raw.select("fam", F.coalesce(F.when(F.trim("clan") != "", F.col("clan")), "fam").alias("clan"))


def read_assays(spark: SparkSession, path: str) -> DataFrame:
    """mutated_sequence, DMS_score from a CSV file with a header."""
    return spark.read.option("header", True).csv(path).select("mutated_sequence", F.col("DMS_score").cast("double").alias("DMS_score"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Writes pair records as compressed JSON lines under ``path``/records, and ``path``/manifest with their numbers of pairs and families."""
    pairs.write.option("compression", "gzip").json(f"{path}/records")
    written = read_pairs(pairs.sparkSession, f"{path}/records")
    files = F.sort_array(F.collect_set("_file"))
    written.withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)).agg(F.count("*").alias("n_pairs"), F.count_distinct("fam").alias("n_families"), files.alias("shard_files")).coalesce(1).write.json(f"{path}/manifest")


def read_pair_shards(spark: SparkSession, path: str) -> DataFrame:
    """The records that ``write_pairs`` wrote; it is an error if they aren't as many as the manifest says."""
    said = spark.read.schema("n_pairs long, n_families long, shard_files array<string>").json(f"{path}/manifest").first()
    records = read_pairs(spark, f"{path}/records")
    if records.count() != said.n_pairs:
        raise ValueError(f"{path} doesn't hold the {said.n_pairs} pairs of its manifest")
    return records
