"""Writers and the relations they write."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import PREFIXES


def _term(value: Column, kind: Column, type_: Column) -> Column:
    escaped = value
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(safe))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    typed = F.concat(quoted, F.lit("^^<http://www.w3.org/2001/XMLSchema#"), type_, F.lit(">"))
    literal = F.when(type_.isNull() | (type_ == "string"), quoted).otherwise(typed)
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:b"), F.regexp_replace(value, "[^A-Za-z0-9]", ""))).otherwise(literal)


def n_triples(triples: DataFrame) -> DataFrame:
    """(value): one statement a line; N-Triples is a subset of Turtle."""
    none = F.lit(None).cast("string")
    return triples.select(F.concat_ws(" ", _term(F.col("s"), F.col("s_kind"), none), _term(F.col("p"), F.lit("iri"), none), _term(F.col("o"), F.col("o_kind"), F.col("o_type")), F.lit(".")).alias("value"))


def write_turtle(triples: DataFrame, path: str) -> None:
    """Prefixes beside the statements, so that a reader may use them; the statements need none."""
    spark = triples.sparkSession
    head = spark.createDataFrame([(f"@prefix {p}: <{iri}> .",) for p, iri in sorted(PREFIXES.items())], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/prefixes")
    n_triples(triples).write.mode("overwrite").text(f"{path}/statements")


def fasta_records(sequences: DataFrame) -> DataFrame:
    """(value): a header, which gets ``>`` if it has none, and its sequence."""
    head = F.when(F.startswith("header", F.lit(">")), F.col("header")).otherwise(F.concat(F.lit(">"), "header"))
    return sequences.select(F.concat(head, F.lit("\n"), "sequence").alias("value"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    fasta_records(sequences).write.mode("overwrite").text(path)


def matrix_rows(kernel: DataFrame, size: int) -> DataFrame:
    """(i, value): rows of a kernel as text, ``%.4f`` by spaces; a missing cell is 0. A row is dense, the table is not collected."""
    spark = kernel.sparkSession
    cells = kernel.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("cells"))
    rows = spark.range(size).withColumnRenamed("id", "i").join(cells, "i", "left")
    columns = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    value = F.array_join(F.transform(columns, lambda j: F.format_string("%.4f", F.coalesce(F.try_element_at("cells", j), F.lit(0.0)))), " ")
    return rows.select("i", value.alias("value"))


def write_matrix_text(kernel: DataFrame, size: int, path: str) -> None:
    """A head line ``n n`` and the rows, in order."""
    head = kernel.sparkSession.createDataFrame([(-1, f"{size} {size}")], "i long, value string")
    head.unionByName(matrix_rows(kernel, size)).repartitionByRange("i").sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def matrix_blocks(kernel: DataFrame, size: int) -> DataFrame:
    """(i, block): the upper triangle row by row as little-endian float32."""
    cells = kernel.where("i <= j").groupBy("i").agg(F.collect_list(F.struct("j", "k")).alias("cells"))
    rows = kernel.sparkSession.range(size).withColumnRenamed("id", "i").join(cells, "i", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for i, found in zip(batch.column("i").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                row = np.zeros(size - i, "<f4")
                for cell in found or ():
                    row[cell["j"] - i] = cell["k"]
                blocks.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(blocks, pa.binary())], names=["i", "block"])

    return rows.mapInArrow(pack, "i long, block binary")


def write_matrix_binary(kernel: DataFrame, size: int, path: str) -> None:
    """One file: int32 size, then the upper triangle as float32.

    ``path`` is one, or a URI, that executors and pyarrow's file systems know. A file has one writer: one task streams the
    rows, which others have made and sorted, under a name of its own and renames the file when it is whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = pyarrow.fs.FileSystem.from_uri(path)
        own = f"{place}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(own, compression=None) as out:
            out.write(struct.pack("<i", size))
            for batch in batches:
                for block in batch.column("block"):
                    out.write(block.as_buffer())
        store.move(own, place)
        yield pa.RecordBatch.from_pydict({"rows": [size]})

    matrix_blocks(kernel, size).repartition(1).sortWithinPartitions("i").select("block").mapInArrow(write, "rows long").collect()


def write_named(rows: DataFrame, folder: str) -> None:
    """Text files of given names out of (name, at, value): a file holds the lines of its name in the order of ``at``.

    Each is written by one task. Spark's writer commits them; the driver then renames what was written, a file at a time.
    """
    spark = rows.sparkSession
    made = f"{folder}/.parts-{uuid.uuid4().hex}"
    rows.select("name", "at", "value").repartition("name").sortWithinPartitions("name", "at").select("value", "name").write.partitionBy("name").text(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.globStatus(path(f"{made}/name=*/part-*")):
        target = path(f"{folder}/{unquote(status.getPath().getParent().getName().removeprefix('name='))}")
        store.mkdirs(target.getParent())
        store.rename(status.getPath(), target)
    store.delete(path(made), True)


def _xml(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def graphml(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(part, value): the lines of a GraphML file; all columns of ``nodes`` but ``id`` are attributes. ``edges`` is (source, target)."""
    spark = nodes.sparkSession
    columns = [c for c in nodes.columns if c != "id"]
    keys = "".join(f'<key id="{c}" for="node" attr.name="{c}" attr.type="string"/>' for c in columns)
    kind = "directed" if directed else "undirected"
    frame = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="{kind}">'), (4, "</graph></graphml>")], "part int, value string")
    data = [F.concat(F.lit(f'<data key="{c}">'), _xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>")) for c in columns]
    node = nodes.select(F.lit(2).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id").cast("string")), F.lit('">'), *data, F.lit("</node>")).alias("value"))
    edge = edges.select(F.lit(3).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("source").cast("string")), F.lit('" target="'), _xml(F.col("target").cast("string")), F.lit('"/>')).alias("value"))
    return frame.unionByName(node).unionByName(edge)


def ontology_graph(terms: DataFrame, edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """GraphML of the annotated terms with aspect, level, number of proteins and whether they are bins."""
    counts = annotations.groupBy("id").agg(F.countDistinct("p").alias("num_proteins"))
    nodes = terms.join(counts, "id").select("id", F.col("namespace").alias("aspect"), "level", "num_proteins", "is_bin")
    shown = edges.where(F.col("relation").isin("is_a", "bin_for")).join(nodes.select(F.col("id").alias("child")), "child", "left_semi").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
    return graphml(nodes, shown.select(F.col("parent").alias("source"), F.col("child").alias("target")))


def network_graph(pairs: DataFrame) -> DataFrame:
    """GraphML of an undirected network (p, q, fold): each pair once; an entity has its largest fold."""
    rows = pairs.select(F.least("p", "q").alias("source"), F.greatest("p", "q").alias("target"), "fold").distinct()
    ends = rows.select(F.explode(F.array("source", "target")).alias("id"), "fold").groupBy("id").agg(F.max("fold").alias("fold"))
    return graphml(ends, rows.select("source", "target").distinct(), directed=False)


def write_graphml(lines: DataFrame, path: str) -> None:
    lines.repartitionByRange("part").sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def datapoints(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, value): ``p;PROTEIN`` and ``p-q;PPAIR``, by (kind, value)."""
    one = entities.select(F.lit(0).alias("kind"), F.concat("p", F.lit(";PROTEIN")).alias("value"))
    two = pairs.select(F.lit(1).alias("kind"), F.concat("p", F.lit("-"), "q", F.lit(";PPAIR")).alias("value"))
    return one.unionByName(two.distinct())


def predicates(terms: DataFrame) -> DataFrame:
    """(value): two fixed declarations, and one for each term's ``predicate``."""
    fixed = terms.sparkSession.createDataFrame([("DEF BOUND(PPAIR)",), ("DEF IN(PROTEIN,PROTEIN,PPAIR)",)], "value string")
    return fixed.unionByName(terms.select(F.concat(F.lit("DEF "), "predicate", F.lit("(PROTEIN)")).alias("value")))


def rules(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value): for each term (id, namespace, level, predicate): it implies one of its children, and all its parents;
    and bound proteins share a function on each level of each namespace. Only is_a counts."""
    is_a = edges.where(F.col("relation") == "is_a")
    name = terms.select("id", "predicate")

    def joined(one: str, other: str, word: str) -> DataFrame:
        rows = is_a.join(name.toDF(one, "own"), one).join(name.toDF(other, "others"), other)
        grouped = rows.groupBy("own").agg(F.array_join(F.sort_array(F.collect_set(F.concat("others", F.lit("(p)")))), f" {word} ").alias("others"))
        return grouped.select(F.lit(f"{other} {word}").alias("kind"), F.concat("own", F.lit("(p) => ("), "others", F.lit(")")).alias("value"))

    level = terms.groupBy("namespace", "level").agg(F.sort_array(F.collect_set("predicate")).alias("all"))
    same = F.array_join(F.transform("all", lambda x: F.concat(F.lit("("), x, F.lit("(p) AND "), x, F.lit("(q))"))), " OR ")
    bound = level.select(F.lit("bound").alias("kind"), F.concat(F.lit("IN(p,q,pq) AND BOUND(pq) => ("), same, F.lit(")")).alias("value"))
    return joined("parent", "child", "OR").unionByName(joined("child", "parent", "AND")).unionByName(bound)


def closed_world(terms: DataFrame, annotations: DataFrame) -> DataFrame:
    """(p, id, label): an entity with a term of a namespace has 0 for all others of it, and nothing in other namespaces."""
    rows = annotations.select("id", "p").distinct().join(terms.select("id", "namespace"), "id")
    grid = rows.select("p", "namespace").distinct().join(terms.select("id", "namespace"), "namespace")
    return grid.join(rows.select("id", "p", F.lit(1).alias("hit")), ["id", "p"], "left").select("p", "id", F.coalesce("hit", F.lit(0)).alias("label"))


def function_labels(terms: DataFrame, annotations: DataFrame) -> DataFrame:
    """(value): ``predicate(p)=label``."""
    rows = closed_world(terms, annotations).join(terms.select("id", "predicate"), "id")
    return rows.select(F.concat("predicate", F.lit("("), "p", F.lit(")="), F.col("label").cast("string")).alias("value"))


def interaction_labels(pairs: DataFrame) -> DataFrame:
    """(value): ``BOUND(p-q)=0`` or 1 and ``IN(p,q,p-q)=1`` of (p, q, state)."""
    bound = F.concat(F.lit("BOUND("), "p", F.lit("-"), "q", F.lit(")="), F.col("state").cast("int").cast("string"))
    inside = F.concat(F.lit("IN("), "p", F.lit(","), "q", F.lit(","), "p", F.lit("-"), "q", F.lit(")=1"))
    return pairs.select(F.explode(F.array(bound, inside)).alias("value"))


def fold_lines(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(test_fold, part, file, value) of rotated pairs (p, q, state) and, if given, rotated labels (p, predicate, label)."""
    end = F.concat("p", F.lit("-"), "q")
    bound = F.concat(F.lit("BOUND("), end, F.lit(")="), F.col("state").cast("int").cast("string"))
    inside = F.concat(F.lit("IN("), "p", F.lit(","), "q", F.lit(","), end, F.lit(")=1"))
    lines = pairs.select("test_fold", "part", F.lit("interactions").alias("file"), F.explode(F.array(bound, inside)).alias("value"))
    if labels is None:
        return lines
    value = F.concat("predicate", F.lit("("), "p", F.lit(")="), F.col("label").cast("string"))
    return lines.unionByName(labels.select("test_fold", "part", F.lit("functions").alias("file"), value.alias("value")))


#: Files of folds that a task writes at a time; a writer takes some hundred KB.
OPEN_FILES = 200


def write_folds(pairs: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """The lines of each test fold, part and file, in folders.

    Rotation writes each pair once a test fold, so files are compressed (gzip; of such lines level 4 makes fewer bytes than 6, and
    at about twice the speed). A task keeps one open for each folder that it
    comes to, up to ``OPEN_FILES``; without that its lines would be sorted by folders and spilled on the way.
    """
    conf, name = pairs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, OPEN_FILES)
    try:
        fold_lines(pairs, labels).write.mode("overwrite").partitionBy("test_fold", "part", "file").option("compression", "gzip").option("zlib.compress.level", "FOUR").text(path)
    finally:
        conf.set(name, before)


def write_data_set(path: str, datapoints: DataFrame, predicates: DataFrame, rules: DataFrame, pairs: DataFrame, labels: DataFrame) -> None:
    """All files of a learner: what holds for all folds, and the folds."""
    datapoints.repartitionByRange("kind", "value").sortWithinPartitions("kind", "value").select("value").write.mode("overwrite").text(f"{path}/datapoints")
    predicates.write.mode("overwrite").text(f"{path}/predicates")
    rules.select("value").write.mode("overwrite").text(f"{path}/rules")
    write_folds(pairs, f"{path}/folds", labels)


def write_vector(rows: DataFrame, path: str) -> None:
    """Values (i, y) as text, one a line, by their index."""
    rows.repartitionByRange("i").sortWithinPartitions("i").select(F.col("y").cast("string").alias("value")).write.mode("overwrite").text(path)
