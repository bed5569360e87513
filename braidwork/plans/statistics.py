"""What is in a graph, as tables that Spark makes and queries are ordered by.

``predicates``: triples, subjects, objects (approximately) and the most objects of a subject, by predicate. ``sets``: the
characteristic sets, that is which predicates and classes occur together on a subject, with the number of such subjects.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize
from ..terms import TYPE
from .mapping import Rule

#: A class is a member of a characteristic set under this name.
_CLASS = TYPE + " "


@dataclass(frozen=True)
class Statistics:
    predicates: DataFrame
    sets: DataFrame

    def of(self, names: Iterable[str]) -> dict[str, dict[str, int]]:
        """The rows of some predicates, by predicate."""
        rows = self.predicates.where(F.col("p").isin(*names)).collect() if (names := sorted(set(names))) else []
        return {r["p"]: r.asDict() for r in rows}

    def subjects(self, stars: list[list[str]]) -> list[int]:
        """For each list of members how many subjects have all of them; one pass over the sets."""
        if not stars:
            return []
        counts = [F.coalesce(F.sum(F.when(reduce(Column.__and__, [F.array_contains("members", m) for m in star], F.lit(True)), F.col("subjects"))), F.lit(0)) for star in stars]
        return list(self.sets.agg(*[c.alias(f"n{k}") for k, c in enumerate(counts)]).first())


@dataclass(frozen=True)
class Graph:
    """Triples with what is known of them.

    A subject has at most one object of each of the ``functional`` predicates; queries check that. ``version`` names
    the content: it is another one whenever the triples are others. Of triples that are not ``sized``, as those of a checkpoint,
    Spark's estimate is that of the files that they were made of, which are many times smaller: none is broadcast to be joined.

    ``subjects`` are relations with rules of one subject, a constant predicate each, by which every row makes a subject of its own.
    Nothing else in the graph makes triples of these subjects, or of these predicates but types: a star of them is read off the rows.
    """

    triples: DataFrame
    statistics: Statistics | None = None
    functional: frozenset[str] = field(default_factory=frozenset)
    version: str | None = None
    sized: bool = True
    subjects: tuple[tuple[DataFrame, tuple[Rule, ...]], ...] = ()


def member(predicate: str, constant: str | None = None) -> str:
    """The name of a predicate in a characteristic set, or of the class that it gives."""
    return _CLASS + constant if predicate == TYPE and constant is not None else predicate


def statistics_of(triples: DataFrame) -> Statistics:
    """Tables of a graph, which is a set of triples. What a subject has is one value, so its predicates and classes have to fit in memory, its triples have not.

    Triples are shuffled once, without their objects but for classes; all counts come from how many subjects have what, how often.
    """
    rows = triples.select("s", "p", F.when(F.col("p") == TYPE, F.col("o")).alias("class")).repartition("s")
    had = rows.groupBy("s", "p", "class").agg(F.count("*").alias("n")).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "class", "n"))).alias("has"))
    had = materialize(had.groupBy("has").agg(F.count("*").alias("subjects")))
    pairs = had.select("has", "subjects", F.explode("has").alias("x")).groupBy("has", "x.p").agg(F.sum("x.n").alias("n"), F.max("subjects").alias("subjects"))
    by_predicate = pairs.groupBy("p").agg(F.sum(F.col("n") * F.col("subjects")).alias("triples"), F.sum("subjects").alias("subjects"), F.max("n").alias("most"))
    objects = triples.groupBy("p").agg(F.approx_count_distinct("o").alias("objects"))
    named = F.flatten(F.transform("has", lambda x: F.array(x["p"], F.when(x["class"].isNotNull(), F.concat(F.lit(_CLASS), x["class"])).otherwise(x["p"]))))
    sets = had.groupBy(F.array_sort(F.array_distinct(named)).alias("members")).agg(F.sum("subjects").alias("subjects"))
    return Statistics(by_predicate.join(objects, "p").select("p", "triples", "subjects", "objects", "most"), sets)
