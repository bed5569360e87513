"""Declarative mapping of relations to triples.

A mapping is a list of rules. To write a graph, all rules of a table are evaluated in one scan: each row makes an array
of structs, the array is exploded, and duplicates go, as a graph is a set. To query a relation as a graph, each
rule is a projection of its own, so that a pattern's predicate decides while planning which of them are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_type string"
_STRUCT = "struct<s:string,s_kind:string,p:string,o:string,o_kind:string,o_type:string>"

# XML Schema names of Spark's types.
XSD = {T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "boolean", T.StringType: "string"}


@dataclass(frozen=True)
class Rule:
    """s p o. A null object, and a row for which ``when`` doesn't hold, make no triple.

    ``kind`` is iri, bnode or literal; a literal's type is ``type``. With ``each`` the object is an array
    of strings, or of (value, is_iri) structs if ``kind`` is mixed.
    """

    s: Column
    p: Column | str
    o: Column | str
    kind: str = "iri"
    type: str | None = None
    when: Column | None = None
    each: bool = False
    s_kind: str = "iri"


def iri(s: Column, p: Column | str, o: Column | str, **more) -> Rule:
    return Rule(s, p, o, **more)


def literal(s: Column, p: Column | str, o: Column, type: str = "string", **more) -> Rule:
    return Rule(s, p, o, "literal", type, **more)


def blank(*columns: str, salt: str = "") -> Column:
    """A blank node named by the content of its row, so that running a task again names it alike."""
    return F.concat(F.lit("_:"), F.sha2(F.concat_ws("\x1f", F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns]), 256))


def _made(rule: Rule) -> Column:
    p = F.lit(rule.p) if isinstance(rule.p, str) else rule.p
    o = F.lit(rule.o) if isinstance(rule.o, str) else rule.o

    def one(x: Column) -> Column:
        if rule.kind == "mixed":
            value, kind, type_ = x["value"], F.when(x["is_iri"], "iri").otherwise("literal"), F.when(~x["is_iri"], "string")
        else:
            value, kind, type_ = x, F.lit(rule.kind), F.lit(rule.type).cast("string")
        ok = value.isNotNull() & rule.s.isNotNull()
        if rule.when is not None:
            ok = ok & F.coalesce(rule.when, F.lit(False))
        made = F.struct(rule.s.alias("s"), F.lit(rule.s_kind).alias("s_kind"), p.alias("p"), value.cast("string").alias("o"), kind.alias("o_kind"), type_.alias("o_type"))
        return F.when(ok, made.cast(_STRUCT))

    return F.transform(o, one) if rule.each else F.array(one(o))


def object_of(rule: Rule) -> Column:
    return (F.lit(rule.o) if isinstance(rule.o, str) else rule.o).cast("string")


def holds(rule: Rule) -> Column:
    """Whether a row makes the triple of a rule of one object."""
    when = F.lit(True) if rule.when is None else F.coalesce(rule.when, F.lit(False))
    return object_of(rule).isNotNull() & rule.s.isNotNull() & when


def to_triples(df: DataFrame, rules: list[Rule], distinct: bool = True, by_rule: bool = False) -> DataFrame:
    """The triples that ``rules`` make of ``df``; a stream cannot have ``distinct``.

    ``by_rule`` reads ``df`` once a rule instead of once: for queries, whose constant predicates leave few of them.

    To be made distinct, triples of a task are held in its memory, and are many times the bytes of the file that they come from:
    the rows are spread over tasks before.
    """
    df = df.hint("rebalance") if distinct else df
    if by_rule:
        return reduce(DataFrame.unionByName, [_projected(df, r, distinct) for r in rules])
    made = F.flatten(F.filter(F.array(*[_made(r) for r in rules]), lambda x: x.isNotNull()))
    triples = df.select(F.explode(made).alias("t")).where("t IS NOT NULL").select("t.*")
    return triples.dropDuplicates() if distinct else triples


def _projected(df: DataFrame, rule: Rule, distinct: bool) -> DataFrame:
    """The triples of one rule, its predicate outside of what is exploded or made distinct. A rule of one object is plain columns, so that filters reach its rows."""
    if rule.each or rule.kind == "mixed":
        made = _made(rule)
        t = df.select(F.explode(made).alias("t")) if rule.each else df.select(made[0].alias("t"))
        t = t.where("t IS NOT NULL").select(*[F.col(f"t.{c}").alias(c) for c in ("s", "s_kind", "p", "o", "o_kind", "o_type")])
    else:
        p = F.lit(rule.p) if isinstance(rule.p, str) else rule.p
        t = df.where(holds(rule)).select(rule.s.cast("string").alias("s"), F.lit(rule.s_kind).alias("s_kind"), p.cast("string").alias("p"), object_of(rule).alias("o"), F.lit(rule.kind).alias("o_kind"), F.lit(rule.type).cast("string").alias("o_type"))
    t = t.dropDuplicates() if distinct else t
    return t.withColumn("p", F.lit(rule.p)) if isinstance(rule.p, str) else t
