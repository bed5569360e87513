"""A SPARQL subset compiled to DataFrame joins.

ASK, SELECT [DISTINCT], FROM, GRAPH, basic graph patterns with ``a``, ``;``, ``,`` and variable predicates,
and FILTER with comparisons, && and ||. Patterns of one subject are read by one grouping of its rows where what a
subject has is known to be bounded; statistics of the graph, if there are any, order the joins. Catalyst plans them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import PREFIXES, TYPE
from .mapping import Rule, holds, object_of
from .statistics import Graph, Statistics, member

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>\s]*>)
    |(?P<var>[?$]\w+)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<pname>[A-Za-z][\w-]*:(?:[\w-]|\.(?=[\w-]))*)
    |(?P<word>[A-Za-z]+)
    |(?P<op>&&|\|\||<=|>=|!=|[=<>!{}().;,*])""",
    re.VERBOSE,
)


class SparqlError(ValueError):
    """The text is not in the subset."""


@dataclass(frozen=True)
class Term:
    """A variable, or a constant with its kind (iri, literal) and a literal's type."""

    value: str
    kind: str
    type: str | None = None

    @property
    def free(self) -> bool:
        return self.kind == "var"


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term
    o: Term

    def variables(self) -> set[str]:
        return {t.value for t in (self.s, self.p, self.o) if t.free}


@dataclass
class Query:
    ask: bool = False
    distinct: bool = False
    variables: list[str] = field(default_factory=list)
    graphs: list[str] = field(default_factory=list)
    patterns: list[Pattern] = field(default_factory=list)
    filters: list = field(default_factory=list)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"cannot read {text[at:at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.rest = tokens(text)[::-1]
        self.prefixes = dict(PREFIXES)

    def peek(self) -> tuple[str, str]:
        return self.rest[-1] if self.rest else ("end", "")

    def next(self) -> tuple[str, str]:
        if not self.rest:
            raise SparqlError("the query ends too early")
        return self.rest.pop()

    def word(self, *words: str) -> bool:
        kind, value = self.peek()
        if kind == "word" and value.upper() in words:
            self.rest.pop()
            return True
        return False

    def op(self, value: str) -> bool:
        if self.peek() == ("op", value):
            self.rest.pop()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.op(value):
            raise SparqlError(f"{value!r} expected, not {self.peek()[1]!r}")

    def resolve(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in self.prefixes:
            raise SparqlError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + local

    def iri(self) -> str:
        kind, value = self.next()
        if kind == "iri":
            return value[1:-1]
        if kind == "pname":
            return self.resolve(value)
        raise SparqlError(f"an IRI expected, not {value!r}")

    def term(self, verb: bool = False) -> Term:
        kind, value = self.next()
        if kind == "var":
            return Term(value[1:], "var")
        if kind in ("iri", "pname"):
            self.rest.append((kind, value))
            return Term(self.iri(), "iri")
        if verb and (kind, value) == ("word", "a"):
            return Term(TYPE, "iri")
        if not verb:
            if kind == "string":
                return Term(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]), "literal", "string")
            if kind == "number":
                return Term(value, "literal", "integer" if re.fullmatch(r"[+-]?\d+", value) else "double")
            if kind == "word" and value in ("true", "false"):
                return Term(value, "literal", "boolean")
        raise SparqlError(f"a term expected, not {value!r}")

    def query(self) -> Query:
        q = Query()
        while self.word("PREFIX"):
            kind, name = self.next()
            if kind != "pname" or not name.endswith(":"):
                raise SparqlError("a prefix expected")
            self.prefixes[name[:-1]] = self.iri()
        if self.word("ASK"):
            q.ask = True
        elif self.word("SELECT"):
            q.distinct = self.word("DISTINCT")
            while self.peek()[0] == "var":
                q.variables.append(self.next()[1][1:])
            if not q.variables and self.op("*"):
                q.variables = ["*"]
            if not q.variables:
                raise SparqlError("SELECT needs variables")
        else:
            raise SparqlError("only ASK and SELECT are known")
        while self.word("FROM"):
            q.graphs.append(self.iri())
        self.word("WHERE")
        self.need("{")
        self.group(q)
        if self.rest:
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        if q.variables == ["*"]:
            q.variables = sorted(set().union(*[p.variables() for p in q.patterns]))
        return q

    def group(self, q: Query) -> None:
        while not self.op("}"):
            if self.word("GRAPH"):
                q.graphs.append(self.iri())
                self.need("{")
                self.group(q)
            elif self.word("FILTER"):
                self.need("(")
                q.filters.append(self.either())
                self.need(")")
            else:
                self.triples(q)
            self.op(".")

    def triples(self, q: Query) -> None:
        s = self.term()
        while True:
            p = self.term(verb=True)
            while True:
                q.patterns.append(Pattern(s, p, self.term()))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.peek() in (("op", "."), ("op", "}")):
                return

    def either(self):
        parts = [self.both()]
        while self.op("||"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both(self):
        parts = [self.comparison()]
        while self.op("&&"):
            parts.append(self.comparison())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def comparison(self):
        if self.op("("):
            inner = self.either()
            self.need(")")
            return inner
        left = self.term()
        kind, value = self.next()
        if kind != "op" or value not in ("<", "<=", ">", ">=", "=", "!="):
            raise SparqlError(f"a comparison expected, not {value!r}")
        return (value, left, self.term())

    # a "(" before a term is a group; terms need none


def parse(text: str) -> Query:
    return _Parser(text).query()


#: Rows that one side of a product of unconnected patterns may have.
PRODUCT_ROWS = 10_000
_NUMERIC = ("integer", "double", "float", "decimal", "long", "int")


def _object_is(term: Term, *at: Column) -> Column:
    """Whether an object, of the columns ``at`` or those of a triple, is a constant."""
    o, o_kind, o_type = at or (F.col("o"), F.col("o_kind"), F.col("o_type"))
    same = (o == term.value) & (o_kind == term.kind)
    if term.kind == "literal" and term.type != "string":
        same &= F.coalesce(o_type.isin(*_NUMERIC) if term.type in _NUMERIC else o_type == term.type, F.lit(False))
    return same


def _bind(triples: DataFrame, pattern: Pattern, is_set: bool = True) -> DataFrame:
    """One scan: constants become filters that prune and push down, variables become columns.

    If the table may repeat triples, what one variable is bound to is made distinct, which partial aggregation makes
    cheap; repeats of more variables are left to the query's DISTINCT.
    """
    df, out, seen = triples, [], {}
    for place, term in (("p", pattern.p), ("s", pattern.s), ("o", pattern.o)):
        if not term.free:
            df = df.where(_object_is(term) if place == "o" else F.col(place) == term.value)
        elif term.value in seen:
            df = df.where(F.col(place) == F.col(seen[term.value]))
        else:
            seen[term.value] = place
            kind = {"p": F.lit("iri"), "s": F.col("s_kind"), "o": F.col("o_kind")}[place]
            out += _variable(term.value, F.col(place), kind, F.col("o_type") if place == "o" else F.lit(None).cast("string"))
    if not out:
        return df.select(F.lit(1).alias("|exists")).limit(1)
    bound = df.select(*out)
    return bound if is_set or len(seen) > 1 else bound.distinct()


@dataclass(frozen=True)
class Star:
    """Patterns of one free subject and constant predicates, read out of one grouping of the subjects' rows."""

    subject: str
    patterns: tuple[Pattern, ...]

    def variables(self) -> set[str]:
        return set().union(*[p.variables() for p in self.patterns])


#: Objects of one subject and predicate up to which a star gathers them; predicates with more are joined, row by row.
GATHERED = 1000


def _stars(patterns: list[Pattern], most: Mapping[str, int]) -> list[Star | Pattern]:
    """Patterns put together by subject: those with constant objects, and with free ones if ``most`` bounds what a subject has."""
    own: dict[str, list[Pattern]] = {}
    patterns = list(dict.fromkeys(patterns))
    for p in patterns:
        if p.s.free and not p.p.free and (not p.o.free or most.get(p.p.value, GATHERED + 1) <= GATHERED):
            own.setdefault(p.s.value, []).append(p)
    stars = [Star(name, tuple(found)) for name, found in own.items() if len(found) > 1]
    used = {p for star in stars for p in star.patterns}
    return [*stars, *[p for p in patterns if p not in used]]


def _variable(name: str, value: Column, kind: Column, type_: Column) -> list[Column]:
    return [value.alias(name), F.when(kind == "literal", "literal").otherwise("node").alias(f"{name}|kind"), type_.alias(f"{name}|type")]


def _read_star(triples: DataFrame, star: Star, most: Mapping[str, int]) -> DataFrame:
    """One scan and one shuffle, whatever the number of patterns.

    A constant object leaves a flag, a predicate that has one object a subject leaves that, another leaves the
    set of its objects, which is exploded. If a subject has a second object of a predicate that should have one, that is an error.
    """
    free = [p for p in star.patterns if p.o.free]
    fixed = [p for p in star.patterns if not p.o.free]
    rows = triples.where(F.col("p").isin(*sorted({p.p.value for p in star.patterns})))
    hits = [(F.col("p") == p.p.value) & _object_is(p.o) for p in fixed]
    wanted = F.col("p").isin(*sorted({p.p.value for p in free})) if free else F.lit(False)
    rows = rows.where(reduce(Column.__or__, hits, wanted))
    flags = [F.max(h).alias(f"h{k}") for k, h in enumerate(hits)]
    if not free:  # flags alone are combined before the shuffle
        found = rows.groupBy("s").agg(*flags)
    else:
        value = F.when(wanted, F.struct("o", "o_kind", "o_type"))
        rows = rows.select("s", "p", *[h.alias(f"h{k}") for k, h in enumerate(hits)], value.alias("v"))
        flags = [F.max(f"h{k}").alias(f"h{k}") for k in range(len(hits))]
        names = sorted({p.p.value for p in free})
        for k, name in enumerate(names):
            v = F.when(F.col("p") == name, F.col("v"))
            flags += [F.min(v).alias(f"a{k}"), F.max(v).alias(f"z{k}")] if most[name] == 1 else [F.collect_set(v).alias(f"c{k}")]
        found = rows.repartition("s").groupBy("s").agg(*flags)
    found = found.where(reduce(Column.__and__, [F.col(f"h{k}") for k in range(len(fixed))], F.lit(True)))
    known = {star.subject: (F.col("s"), F.lit("node"))}
    out = _variable(star.subject, F.col("s"), F.lit("node"), F.lit(None).cast("string"))
    for k, p in enumerate(free):
        at, v = names.index(p.p.value), F.col(f"v{k}")
        if most[p.p.value] == 1:
            several = F.raise_error(F.concat(F.lit(f"several objects of {p.p.value} at "), F.col("s"))).cast("struct<o:string,o_kind:string,o_type:string>")
            found = found.where(F.col(f"a{at}").isNotNull()).withColumn(f"v{k}", F.when(F.col(f"a{at}").eqNullSafe(F.col(f"z{at}")), F.col(f"a{at}")).otherwise(several))
        else:
            found = found.withColumn(f"v{k}", F.explode(f"c{at}"))
        kind = F.when(v["o_kind"] == "literal", "literal").otherwise("node")
        if p.o.value in known:  # bound before: the same value and kind
            found = found.where((v["o"] == known[p.o.value][0]) & (kind == known[p.o.value][1]))
        else:
            known[p.o.value] = (v["o"], kind)
            out += _variable(p.o.value, v["o"], v["o_kind"], v["o_type"])
    return found.select(*out)


def _rows_of(graph: Graph, star: Star) -> tuple[DataFrame, dict[str, Rule]] | None:
    """The relation whose rows make the star's subjects, with its rules by predicate, if the graph tells of one."""
    names = {p.p.value for p in star.patterns}
    for rows, rules in graph.subjects:
        by_predicate = {r.p: r for r in rules}
        if names <= by_predicate.keys() and names != {TYPE} and len(by_predicate) == len(rules):
            return rows, by_predicate
    return None


def _read_rows(rows: DataFrame, rules: Mapping[str, Rule], star: Star) -> DataFrame:
    """A star whose subjects are made by a row each: nothing is grouped, and so nothing is shuffled."""
    names = sorted({p.p.value for p in star.patterns})
    subject = rules[names[0]].s.cast("string").alias("s")
    found = rows.where(reduce(Column.__and__, [holds(rules[n]) for n in names])).select(subject, *[object_of(rules[n]).alias(f"o{k}") for k, n in enumerate(names)])
    known = {star.subject: (F.col("s"), "node")}
    out = _variable(star.subject, F.col("s"), F.lit("node"), F.lit(None).cast("string"))
    for p in star.patterns:
        rule, o = rules[p.p.value], F.col(f"o{names.index(p.p.value)}")
        kind = "literal" if rule.kind == "literal" else "node"
        if not p.o.free:
            found = found.where(_object_is(p.o, o, F.lit(rule.kind), F.lit(rule.type).cast("string")))
        elif p.o.value in known:  # bound before: the same value and kind
            found = found.where((o == known[p.o.value][0]) & F.lit(kind == known[p.o.value][1]))
        else:
            known[p.o.value] = (o, kind)
            out += _variable(p.o.value, o, F.lit(rule.kind), F.lit(rule.type).cast("string"))
    return found.select(*out)


def _join(left: DataFrame, right: DataFrame, sized: bool = True) -> DataFrame:
    """Equi-join on all shared variables: value and kind; by sorting if sizes are unknown."""
    shared = [c for c in right.columns if c in left.columns and not c.endswith("|type")]
    right = right.drop(*[c for c in right.columns if c in left.columns and c.endswith("|type")])
    if shared:
        return left.join(right if sized else right.hint("merge"), shared)
    # Nothing in common: a product, which is made only with a side that is small, as counting to a limit tells.
    for one, other in ((right, left), (left, right)):
        if one.limit(PRODUCT_ROWS + 1).count() <= PRODUCT_ROWS:
            return other.crossJoin(F.broadcast(one))
    raise SparqlError(f"patterns without a common variable, of more than {PRODUCT_ROWS} rows each")


def _compared(node, columns: list[str]) -> Column:
    if node[0] in ("and", "or"):
        return reduce(Column.__and__ if node[0] == "and" else Column.__or__, [_compared(n, columns) for n in node[1]])
    op, a, b = node

    def text(t: Term) -> Column:
        if t.free and t.value not in columns:
            raise SparqlError(f"?{t.value} is not bound")
        return F.col(f"`{t.value}`") if t.free else F.lit(t.value)

    def numeric(t: Term) -> Column:
        known = F.coalesce(F.col(f"`{t.value}|type`").isin(*_NUMERIC), F.lit(False)) if t.free else F.lit(t.type in _NUMERIC)
        return F.when(known, text(t).try_cast("double"))

    do: Callable[[Column, Column], Column] = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "=": Column.__eq__, "!=": Column.__ne__}[op]
    x, y = numeric(a), numeric(b)
    return F.when(x.isNotNull() & y.isNotNull(), do(x, y)).when(x.isNull() & y.isNull(), do(text(a), text(b))).otherwise(F.lit(op == "!="))


def _estimates(statistics: Statistics, units: list[Star | Pattern]) -> list[tuple[float, dict[str, float]]]:
    """Rows of each unit and different values of its variables, from a graph's statistics."""
    parts = [u.patterns if isinstance(u, Star) else (u,) for u in units]
    info = statistics.of({p.p.value for own in parts for p in own if not p.p.free})
    subjects = statistics.subjects([[member(p.p.value, None if p.o.free else p.o.value) for p in own if not p.p.free] for own in parts])
    none = {"triples": 0, "subjects": 1, "objects": 1}
    out = []
    for own, n in zip(parts, subjects, strict=True):
        rows, values = float(n), {}
        for p in own:
            at = info.get(p.p.value, none)
            each = at["triples"] / max(1, at["subjects"])
            if p.p.free:
                rows *= 4  # unknown: a subject has a few
                values |= {p.p.value: 8.0, **({p.o.value: rows} if p.o.free else {})}
            elif p.o.free:
                rows *= each
                values[p.o.value] = float(at["objects"])
            elif p.p.value != TYPE:  # a class is a member of the sets itself
                rows *= each / max(1, at["objects"])
            if p.s.free:
                values[p.s.value] = float(n)
            else:
                rows /= max(1, n)
        out.append((rows, {v: max(1.0, min(x, rows)) for v, x in values.items()}))
    return out


#: Orders that are followed at once; with up to eight units these are all that matter.
_ORDERS = 256


def join_order(estimates: list[tuple[float, dict[str, float]]]) -> list[int]:
    """The order of joins with the fewest rows in between: dynamic programming over sets of units, each joined to a connected one."""
    best = {frozenset([k]): (rows, rows, values, [k]) for k, (rows, values) in enumerate(estimates)}
    for _ in estimates[1:]:
        longer: dict[frozenset, tuple] = {}
        for done, (cost, rows, values, order) in best.items():
            rest = [k for k in range(len(estimates)) if k not in done]
            for k in [k for k in rest if values.keys() & estimates[k][1].keys()] or rest:
                n, own = estimates[k]
                joined = rows * n
                for v in values.keys() & own.keys():
                    joined /= max(values[v], own[v])
                both = {v: max(1.0, min(values.get(v, joined), own.get(v, joined), joined)) for v in values.keys() | own.keys()}
                key = done | {k}
                if key not in longer or cost + joined < longer[key][0]:
                    longer[key] = (cost + joined, joined, both, [*order, k])
        best = dict(sorted(longer.items(), key=lambda x: x[1][0])[:_ORDERS])
    return next(iter(best.values()))[3]


def plan(graph: Graph, patterns: list[Pattern]) -> tuple[list[Star | Pattern], dict[str, int]]:
    """Stars and single patterns in the order in which they are joined, and how many objects a subject has of a predicate at most.

    With statistics the cheapest order is taken; without, units with most constants come first, then those connected to them.
    """
    most = dict.fromkeys(graph.functional, 1)
    if graph.statistics is not None:
        most = {name: int(at["most"]) for name, at in graph.statistics.of({p.p.value for p in patterns if not p.p.free}).items()} | most
    units = _stars(patterns, most)
    if graph.statistics is not None and len(units) > 1:
        return [units[k] for k in join_order(_estimates(graph.statistics, units))], most
    todo = sorted(units, key=lambda u: 0 if isinstance(u, Star) else len(u.variables()) + u.p.free)
    order, names = todo[:1], todo[0].variables() if todo else set()
    del todo[:1]
    while todo:
        at = next((k for k, u in enumerate(todo) if names & u.variables()), 0)
        names |= todo[at].variables()
        order.append(todo.pop(at))
    return order, most


def compile_patterns(graph: Graph, patterns: list[Pattern], is_set: bool = True) -> DataFrame:
    """All patterns joined, star by star."""
    order, most = plan(graph, patterns)

    def read(u: Star | Pattern) -> DataFrame:
        if not isinstance(u, Star):
            return _bind(graph.triples, u, is_set)
        made = _rows_of(graph, u)
        return _read_star(graph.triples, u, most) if made is None else _read_rows(*made, u)

    return reduce(lambda left, right: _join(left, right, graph.sized), [read(u) for u in order])


_CLEAR = re.compile(r"\s*CLEAR\s+(?:SILENT\s+)?(?:GRAPH\s+<(?P<graph>[^<>\s]*)>|(?P<default>DEFAULT))\s*;?\s*", re.IGNORECASE)


def update(store, text: str) -> None:
    """``CLEAR GRAPH <iri>`` and ``CLEAR DEFAULT`` on a ``TripleStore``; an unknown graph is as good as cleared."""
    m = _CLEAR.fullmatch(text)
    if m is None:
        raise SparqlError(f"no update that is known: {text.strip()}")
    store.clear(*[m["graph"]] if m["graph"] is not None else [])


def run(triples: DataFrame | Graph | Callable[[str | None], DataFrame | Graph], text: str, types: Mapping[str, str] | None = None, arity: int | None = None, is_set: bool = True) -> DataFrame:
    """The bindings of a query over a triple table, or over what a function gives for a graph's name.

    Values are strings; ``types`` names Spark types for some variables, and what doesn't parse is null.
    A projected variable that no pattern binds is null; ``arity`` asserts how many are bound. SELECT without
    DISTINCT keeps duplicates; the table is a set, or is made one if ``is_set`` is false and the query needs that.
    ASK gives one row with one boolean, ``ask``. A ``Graph`` brings statistics, which order the joins and allow more
    patterns to be read at once; they change no row.
    """
    q = parse(text)
    graph = triples
    if not isinstance(triples, (DataFrame, Graph)):
        named = [triples(g) for g in list(dict.fromkeys(q.graphs)) or [None]]
        graph = named[0] if len(named) == 1 else reduce(DataFrame.unionByName, [g.triples if isinstance(g, Graph) else g for g in named]).dropDuplicates()
    if isinstance(graph, DataFrame):
        graph = Graph(graph)
    if not is_set and not (q.distinct or q.ask):
        graph, is_set = replace(graph, triples=graph.triples.dropDuplicates()), True
    bound = compile_patterns(graph, q.patterns, is_set)
    for f in q.filters:
        bound = bound.where(_compared(f, bound.columns))
    if q.ask:
        return bound.limit(1).agg((F.count("*") > 0).alias("ask"))
    if arity is not None and arity != (n := sum(v in bound.columns for v in q.variables)):
        raise SparqlError(f"{n} variables are bound, not {arity}")
    out = [F.col(f"`{v}`") if v in bound.columns else F.lit(None).cast("string").alias(v) for v in q.variables]
    result = bound.select(*out)
    result = result.distinct() if q.distinct else result
    return result.withColumns({v: F.col(f"`{v}`").try_cast(t) for v, t in (types or {}).items()})
