"""Networks of pairs (p, q)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import materialize


#: Entities up to which a table of them is broadcast to all tasks (16 MB of numbers), so that the pairs stay where they are.
BROADCAST_ENTITIES = 500_000


def broadcast_few(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows``, to be broadcast if there are at most ``most`` of them, as is counted."""
    most = BROADCAST_ENTITIES if most is None else most
    return F.broadcast(rows) if rows.select(F.lit(1)).limit(most + 1).count() <= most else rows


def symmetrize(pairs: DataFrame, once: bool = False) -> DataFrame:
    """Both orientations, once each. ``once`` tells of ``pairs`` that each has p <> q and is there in one orientation, once: nothing is shuffled then."""
    both = F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q"))))
    rows = pairs.select(both.alias("x")).select("x.*")
    return rows if once else rows.distinct()


def canonical(pairs: DataFrame, symmetric: bool = False) -> DataFrame:
    """One orientation of each pair: the smaller name first. ``symmetric`` tells of ``pairs`` that each is there in both orientations, once: nothing is shuffled then."""
    if symmetric:
        return pairs.where("p <= q").select("p", "q")
    return pairs.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()


def restrict(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs both ends of which are among ``entities`` (p)."""
    few = broadcast_few(entities.select("p"))
    return pairs.join(few, "p", "left_semi").join(few.select(F.col("p").alias("q")), "q", "left_semi").select("p", "q")


def density(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: pairs, entities, pairs / (n (n - 1))."""
    n = entities.select("p").distinct().agg(F.count("*").alias("n_entities"))
    rows = pairs.agg(F.count("*").alias("n_pairs")).crossJoin(n)
    return rows.withColumn("density", F.try_divide(F.col("n_pairs").cast("double"), (F.col("n_entities") * (F.col("n_entities") - 1)).cast("double")))


def asymmetric(pairs: DataFrame) -> DataFrame:
    """Pairs without their mirror: a table to be empty for an undirected network. Each pair and its mirror are counted in one shuffle."""
    known = pairs.where("p IS NOT NULL AND q IS NOT NULL")
    ends = known.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.count_if(F.col("p") <= F.col("q")).alias("__up"), F.count_if(F.col("p") >= F.col("q")).alias("__down"))
    one = ends.where("__up = 0 OR __down = 0")
    turned = F.when(F.col("__up") > 0, F.struct("p", "q")).otherwise(F.struct(F.col("q").alias("p"), F.col("p").alias("q")))
    one = one.select(F.explode(F.array_repeat(turned, (F.col("__up") + F.col("__down")).cast("int"))).alias("x")).select("x.p", "x.q")
    return one.unionByName(pairs.where("p IS NULL OR q IS NULL").select("p", "q"))


#: Members of a group that are paired as one; a larger group is dealt into blocks of about as many.
GROUP = 2048
#: Pairs of a task, about: two cells of blocks of that size, or many of small groups.
TASK_PAIRS = 1 << 22


def pairs_within(rows: DataFrame, key: str, entity: str, most: int = GROUP, summary: dict[str, Column] | None = None) -> DataFrame:
    """(key, a, b, ...): the rows a and b, as structs, of each group whose entities are a >= b, with a ``summary`` of the group.

    The rows of a large group are dealt into blocks by entity, and each row meets each block once: pairs of blocks form a
    triangular grid, whose cells are joined by themselves. So a key that all rows have makes many tasks of bounded
    size, and a small group is one cell. The rows are few bytes against their pairs, so the number of tasks comes from the
    pairs, which are counted first, and adaptive execution isn't to put the tasks together.
    """
    names = list(summary or {})
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("__blocks"), F.count("*").alias("__members"), *[c.alias(n) for n, c in (summary or {}).items()])
    sizes = materialize(sizes)
    met = F.col("__members").cast("double")
    total, cells = sizes.agg(F.sum(met * (met + 1) / 2), F.sum(F.col("__blocks").cast("double") * (F.col("__blocks") + 1) / 2)).first()
    shuffled_into = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(int(cells or 0), shuffled_into), -(-int(total or 0) // TASK_PAIRS))
    own = F.pmod(F.xxhash64(entity), F.col("__blocks")).cast("int")
    dealt = rows.select(key, F.struct(*rows.columns).alias("__row"), F.col(entity)).join(sizes.drop("__members"), key).select(key, "__row", *names, own.alias("__own"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__met"))
    cell = [key, "__low", "__high"]
    dealt = dealt.select(key, F.least("__own", "__met").alias("__low"), F.greatest("__own", "__met").alias("__high"), "__own", "__row", *names)
    a = dealt.select(*cell, F.col("__own").alias("__x"), F.col("__row").alias("a"), *names).repartition(tasks, *cell)
    b = dealt.select(*cell, F.col("__own").alias("__y"), F.col("__row").alias("b")).repartition(tasks, *cell)
    met = a.join(b.hint("merge"), cell).where((F.col("a")[entity] >= F.col("b")[entity]) & ((F.col("__low") == F.col("__high")) | (F.col("__x") != F.col("__y"))))
    return met.select(key, "a", "b", *names)


def co_members(groups: DataFrame) -> DataFrame:
    """Pairs p < q that share a group (p, g), once each. Where no entity is in two groups, no pair comes up twice, and nothing is shuffled for that."""
    groups = materialize(groups.select("g", "p").distinct())
    pairs = pairs_within(groups, "g", "p").where("a.p > b.p").select(F.col("b.p").alias("p"), F.col("a.p").alias("q"))
    return pairs if groups.groupBy("p").count().where("count > 1").isEmpty() else pairs.distinct()


def shuffled(seed: int, *columns: str):
    """A portable random order: a digest of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def permute(rows: DataFrame, seed: int, *columns: str) -> DataFrame:
    return rows.orderBy(shuffled(seed, *columns), *columns)


def drawn(n_entities: int, draws: int, seed: int, spark: SparkSession) -> DataFrame:
    """(draw, a, b): the first of an endless row of pairs of places below ``n_entities``, which digests of the draw's number give."""
    def place(end: str) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(end), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(n_entities))

    return spark.range(draws).toDF("draw").select("draw", place("a").alias("a"), place("b").alias("b"))


def sample_negatives(entities: DataFrame, known: DataFrame, n_pairs: int, seed: int = 0, oversample: float = 4.0) -> DataFrame:
    """``n_pairs`` // 2 pairs p < q that are not ``known`` in either orientation, and their mirrors.

    One rule for all sizes: entities are numbered by name, draws give pairs of numbers, and the first different pairs
    that are neither known nor an entity with itself are chosen. So neither the full product is made, nor does the
    number of draws that are looked at matter; it doubles until there are enough pairs. If fewer are left than
    wanted, all of these are the result.
    """
    spark = entities.sparkSession
    names = materialize(entities.select("p").distinct())
    n = names.count()
    wanted, possible = n_pairs // 2, n * (n - 1) // 2
    ends = names.select(F.col("p").alias("q"))
    few, few_ends = broadcast_few(names), broadcast_few(ends)
    held = known.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).where("p < q").join(few, "p", "left_semi").join(few_ends, "q", "left_semi")
    # Rows that repeat a pair only count where there may not be enough pairs left.
    if possible - held.count() < wanted:
        wanted = min(wanted, possible - held.distinct().count())
    if wanted <= 0:
        return symmetrize(held.limit(0))
    indexed = materialize(number(names, "p"))
    x, y = indexed.toDF("x", "a"), indexed.toDF("y", "b")
    draws = int(oversample * wanted) + 100
    while True:
        pairs = drawn(n, draws, seed, spark).where("a <> b").join(x, "a").join(y, "b")
        pairs = pairs.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(F.min("draw").alias("draw"))
        pairs = materialize(pairs)
        # The drawn pairs go to the known ones, which are many more.
        taken = held.join(broadcast_few(pairs.select("p", "q")), ["p", "q"], "left_semi").distinct()
        pairs = materialize(pairs.join(taken, ["p", "q"], "left_anti"))
        if pairs.count() >= wanted:
            break
        draws *= 2
    # The last draw that is needed, by halving: each step counts, and no task gets all pairs.
    low, high = 0, draws - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if pairs.where(F.col("draw") <= middle).count() >= wanted else (middle + 1, high)
    return symmetrize(pairs.where(F.col("draw") <= low).select("p", "q"))


def number(rows: DataFrame, column: str) -> DataFrame:
    """(column, index): places in ascending order from 0.

    A range partitioning sorts; tasks number their own rows, and offsets come from the tasks' counts.
    """
    # The id's upper bits are the task's number, its lower 33 count the task's rows.
    at = F.monotonically_increasing_id()
    part = materialize(rows.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("at", at))
    part = part.select(column, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("local"))
    counts = part.groupBy("part").count()
    # One row a task, so the window over all of them is small.
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return part.join(F.broadcast(before), "part").select(column, (F.col("base") + F.col("local")).cast("long").alias("index"))
