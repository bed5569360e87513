"""Triple mappings over streams: they are stateless, so they run on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.mapping import Rule, to_triples
from ..sources.files import string_schema


def read_delimited(spark: SparkSession, folder: str, columns: list[str], sep: str = "\t") -> DataFrame:
    return spark.readStream.schema(string_schema(columns)).option("sep", sep).csv(folder)


def stream_triples(stream: DataFrame, rules: list[Rule], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream's triples to Parquet by predicate. Duplicates within a batch go; a graph drops the rest when read."""

    def write(batch: DataFrame, _: int) -> None:
        batch.dropDuplicates().write.mode("append").partitionBy("p").parquet(path)

    writer = to_triples(stream, rules, distinct=False).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
