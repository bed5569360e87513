"""Operators on an ontology: terms (id, name, namespace, ...), edges (child, parent, relation), annotations (id, p)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize

IS_A = "is_a"


def related(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """The edges of some relations; none means all."""
    return edges if relations is None else edges.where(F.col("relation").isin(*relations))


def parents(edges: DataFrame, relations: list[str] | None = (IS_A,)) -> DataFrame:
    return related(edges, relations).select(F.col("child").alias("id"), "parent")


def children(edges: DataFrame, relations: list[str] | None = (IS_A,)) -> DataFrame:
    return related(edges, relations).select(F.col("parent").alias("id"), "child")


def without_obsolete(terms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = terms.where(~F.col("is_obsolete"))
    return kept, edges.join(kept.select(F.col("id").alias("child")), "child", "left_semi")


def alternatives(terms: DataFrame) -> DataFrame:
    """(alt_id, id)."""
    return terms.select(F.explode("alt_ids").alias("alt_id"), "id")


def distances(edges: DataFrame, relations: list[str] | None = (IS_A,)) -> DataFrame:
    """(id, ancestor, d): each ancestor with the number of steps of the shortest path to it.

    By doubling: a round joins the pairs that the last one found to all that are known, which finds those up to twice as far
    away. For of a shortest path of more than 2**r steps and at most 2**(r + 1), the first 2**r are one of the last round's,
    and the rest is known; the smallest of such sums is the distance. What a round finds is kept as a table of
    its own, so nothing is written twice.
    """
    step = related(edges, relations).select(F.col("child").alias("id"), F.col("parent").alias("ancestor")).distinct()
    found = [materialize(step.withColumn("d", F.lit(1)))]
    while True:
        known = reduce(DataFrame.unionByName, found)
        above = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("d").alias("more"))
        further = found[-1].join(above, "ancestor").groupBy("id", F.col("top").alias("ancestor")).agg(F.min(F.col("d") + F.col("more")).alias("d"))
        new = materialize(further.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        found.append(new)


def closure(edges: DataFrame, relations: list[str] | None = (IS_A,)) -> DataFrame:
    """(id, ancestor): the transitive closure; a term is its own ancestor only in a circle. See ``distances``."""
    return distances(edges, relations).select("id", "ancestor")


def levels(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): 0 without an is_a parent, else one more than the smallest level of a parent: the distance to the nearest term without one."""
    up = related(edges, [IS_A]).select(F.col("child").alias("id"))
    roots = materialize(terms.select("id").join(up, "id", "left_anti"))
    below = distances(edges).join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").groupBy("id").agg(F.min("d").alias("level"))
    return roots.withColumn("level", F.lit(0)).unionByName(below)


def annotate(terms: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations (id, p) of known terms; and those of unknown ones, to be warned of."""
    rows = annotations.select("id", "p").distinct()
    return rows.join(terms.select("id"), "id", "left_semi"), rows.join(terms.select("id"), "id", "left_anti")


def inverted(annotations: DataFrame) -> DataFrame:
    """(p, ids): the sorted terms of each protein."""
    return annotations.groupBy("p").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def by_level(levels: DataFrame) -> DataFrame:
    """(level, ids): the sorted terms of each level, the levels in order."""
    return levels.groupBy("level").agg(F.sort_array(F.collect_set("id")).alias("ids")).orderBy("level")


def propagate(annotations: DataFrame, edges: DataFrame) -> DataFrame:
    """Every ancestor over is_a gets a term's proteins."""
    up = closure(edges)
    return annotations.select("id", "p").unionByName(annotations.join(up, "id").select(F.col("ancestor").alias("id"), "p")).distinct()


def prune(terms: DataFrame, edges: DataFrame, annotations: DataFrame, aspects: list[str] | None = None, max_depth: int | None = None, min_annot: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms (with their level and is_bin), edges and annotations after pruning, bins included.

    Kept are terms of the aspects, down to ``max_depth``, with at least ``min_annot`` proteins. The proteins of
    a kept term's removed is_a children make a bin term below it if they are at least ``min_annot`` (or 1) and
    the term is not at ``max_depth``. The bin ``BN:x`` of the term ``y:x`` has the same namespace.
    """
    annotations = materialize(annotations.select("id", "p").distinct())  # used in several places below
    counts = annotations.groupBy("id").agg(F.count("*").alias("n"))
    level = levels(terms, edges) if "level" not in terms.columns else None
    rows = terms if level is None else terms.join(level, "id")
    rows = rows.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keep = F.col("level") >= 0
    if aspects is not None:
        keep = keep & F.col("namespace").isin(*aspects)
    if max_depth is not None:
        keep = keep & (F.col("level") <= max_depth)
    if min_annot is not None:
        keep = keep & (F.col("n") >= min_annot)
    kept = materialize(rows.where(keep).select("id", "name", "namespace", "level"))
    kept_ids = kept.select("id")
    edges_kept = edges.join(kept_ids.withColumnRenamed("id", "child"), "child", "left_semi").join(kept_ids.withColumnRenamed("id", "parent"), "parent", "left_semi")
    lost = edges.where(F.col("relation") == IS_A).join(kept_ids.withColumnRenamed("id", "child"), "child", "left_anti").select("parent", F.col("child").alias("id")).distinct()
    gathered = lost.join(annotations, "id").join(kept.select(F.col("id").alias("parent"), "namespace", "level"), "parent").select("parent", "namespace", "level", "p").distinct()
    gathered = materialize(gathered)
    if max_depth is not None:
        gathered = gathered.where(F.col("level") != max_depth)
    large = gathered.groupBy("parent", "namespace", "level").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, min_annot or 1))
    name = F.concat(F.lit("BN:"), F.substring_index("parent", ":", -1))
    bins = materialize(large.select(name.alias("id"), F.concat(F.lit("bin of "), "parent").alias("name"), "namespace", (F.col("level") + 1).alias("level"), "parent"))
    all_terms = kept.withColumn("is_bin", F.lit(False)).unionByName(bins.drop("parent").withColumn("is_bin", F.lit(True)))
    all_edges = edges_kept.select("child", "parent", "relation").unionByName(bins.select(F.col("id").alias("child"), "parent", F.lit("bin_for").alias("relation")))
    bin_annotations = gathered.join(bins.select("parent", "id"), "parent").select("id", "p")
    return all_terms, all_edges, annotations.select("id", "p").join(kept_ids, "id", "left_semi").unionByName(bin_annotations)


def level_statistics(terms: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per level: terms, bins, annotations (a protein counts for each term), different proteins."""
    # Terms are few and annotations many: only these are joined, and proteins are counted once a level and not once for each count.
    of_terms = terms.groupBy("level").agg(F.countDistinct("id").alias("n_terms"), F.countDistinct(F.when(F.col("is_bin"), F.col("id"))).alias("n_bins"))
    held = annotations.where("p IS NOT NULL").join(terms.select("id", "level"), "id").groupBy("level", "p").agg(F.count("*").alias("n"))
    of_proteins = held.groupBy("level").agg(F.sum("n").alias("n_annotations"), F.count("*").alias("n_proteins"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_annotations", "n_proteins")]
    return of_terms.join(of_proteins, of_terms["level"].eqNullSafe(of_proteins["level"]), "left").select(of_terms["level"], "n_terms", "n_bins", *counts)


def violations(terms: DataFrame, edges: DataFrame, annotations: DataFrame, min_annot: int = 0) -> DataFrame:
    """Rows (check, id) that should not be: a table to be empty.

    A protein of a child that an is_a parent lacks; an edge between namespaces; a term with too few
    proteins; an aspect without exactly one root; an annotation of an unknown term.
    """
    is_a = edges.where(F.col("relation") == IS_A).select("child", "parent")
    missing = is_a.join(annotations.withColumnRenamed("id", "child"), "child").join(annotations.withColumnRenamed("id", "parent"), ["parent", "p"], "left_anti")
    spaces = terms.select("id", "namespace")
    across = is_a.join(spaces.toDF("child", "n1"), "child").join(spaces.toDF("parent", "n2"), "parent").where("n1 <> n2")
    counts = terms.join(annotations, "id", "left").groupBy("id").agg(F.countDistinct("p").alias("n"))
    roots = terms.join(is_a.select(F.col("child").alias("id")), "id", "left_anti").where(~F.coalesce(F.col("is_bin"), F.lit(False)) if "is_bin" in terms.columns else F.lit(True))
    n_roots = roots.groupBy("namespace").agg(F.count("*").alias("n")).where("n <> 1")
    unknown = annotations.join(terms, "id", "left_anti")

    def named(df: DataFrame, check: str, column: str) -> DataFrame:
        return df.select(F.lit(check).alias("check"), F.col(column).cast("string").alias("id"))

    parts = [named(missing, "parent lacks protein", "child"), named(across, "edge between namespaces", "child"), named(counts.where(F.col("n") < min_annot), "too few proteins", "id"), named(n_roots, "roots", "namespace"), named(unknown, "unknown term", "id")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
