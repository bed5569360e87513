"""A triple store of Parquet files, partitioned by graph and predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import fingerprint
from .statistics import Graph, Statistics, statistics_of

DEFAULT_GRAPH = "urn:braidwork:default"


class TripleStore:
    """Graphs under one folder. A constant predicate of a query prunes all other folders."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, graph: str) -> str:
        return f"{self.path}/g={self.spark.range(1).select(F.url_encode(F.lit(graph))).first()[0]}"

    def load(self, triples: DataFrame, graph: str = DEFAULT_GRAPH, analyze: bool = True, once: bool = False) -> None:
        """Add triples to a graph, and keep its statistics if ``analyze``. Triples that lie there already are not added again.

        ``once`` tells of ``triples`` that each is there once: they are not shuffled for that."""
        fresh = triples if once else triples.dropDuplicates()
        if (old := self._read(graph)) is not None:
            fresh = fresh.join(old, [c for c in fresh.columns if c != "o_type"], "left_anti")
        # One sorted file set a predicate, and no hot predicate in a single task.
        fresh.hint("rebalance", "p").write.mode("append").partitionBy("p").parquet(self._folder(graph))
        if analyze:
            self.statistics(graph)

    def version(self, graph: str = DEFAULT_GRAPH) -> str:
        """Another one after each change of the graph's files."""
        return fingerprint(self.spark, self._folder(graph))

    def statistics(self, graph: str = DEFAULT_GRAPH, version: str | None = None) -> Statistics | None:
        """Those of the graph as it is, which are made if they are missing; none for an unknown graph."""
        if (triples := self._read(graph)) is None:
            return None
        folder = f"{self._folder(graph)}/_statistics/{version or self.version(graph)}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/sets/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            found = statistics_of(triples)
            found.predicates.write.mode("overwrite").parquet(f"{folder}/predicates")
            found.sets.write.mode("overwrite").parquet(f"{folder}/sets")
        return Statistics(self.spark.read.parquet(f"{folder}/predicates"), self.spark.read.parquet(f"{folder}/sets"))

    def view(self, graph: str = DEFAULT_GRAPH) -> Graph:
        """The triples of a graph with its statistics and version, for queries and pipelines."""
        version = self.version(graph)
        return Graph(self.graph(graph), self.statistics(graph, version), version=f"{graph}@{version}")

    def _read(self, graph: str) -> DataFrame | None:
        folder = self._folder(graph)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("s string, s_kind string, o string, o_kind string, o_type string, p string").parquet(folder)

    def graph(self, graph: str = DEFAULT_GRAPH) -> DataFrame:
        """The triples of a graph; an unknown graph is empty."""
        found = self._read(graph)
        return found if found is not None else self.spark.createDataFrame([], "s string, s_kind string, o string, o_kind string, o_type string, p string")

    def is_empty(self, graph: str = DEFAULT_GRAPH) -> bool:
        return self.graph(graph).isEmpty()

    def clear(self, graph: str = DEFAULT_GRAPH) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(graph))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
