import itertools
import random

import pytest
from pyspark.sql import functions as F

from braidwork.plans import experiment, sparql, stages, statistics
from braidwork.plans.mapping import iri, literal, to_triples
from braidwork.plans.statistics import Graph, statistics_of
from braidwork.plans.store import TripleStore
from braidwork.sources import files
from braidwork.terms import BASE as B
from braidwork.terms import PREFIXES, TYPE

SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_type string"
SAME = PREFIXES["owl"] + "sameAs"


def frame(spark, triples):
    rows = [(s, "iri", p, str(o), "literal" if isinstance(o, int) else "iri", "integer" if isinstance(o, int) else None) for s, p, o in triples]
    return spark.createDataFrame(rows, SCHEMA)


def brute(triples, patterns, variables):
    """All bindings, by trying all triples for each pattern in turn."""
    found = [{}]
    for pattern in patterns:
        grown = []
        for bound in found:
            for triple in triples:
                b = dict(bound)
                if all(b.setdefault(t, x) == x if isinstance(t, str) and t.startswith("?") else t == x for t, x in zip(pattern, triple, strict=True)):
                    grown.append(b)
        found = grown
    return sorted({tuple(str(b[v]) for v in variables) for b in found})


def text(patterns, variables):
    def term(t):
        return t if isinstance(t, str) and t.startswith("?") else str(t) if isinstance(t, int) else f"<{t}>"

    return f"SELECT DISTINCT {' '.join(variables)} WHERE {{ {' . '.join(' '.join(map(term, p)) for p in patterns)} }}"


def made_graph(r):
    nodes = [f"n{k}" for k in range(14)]
    triples = {(n, TYPE, r.choice(["A", "B"])) for n in nodes}
    triples |= {(n, "one", r.choice(nodes)) for n in nodes[:10]} | {(n, "size", r.randint(0, 3)) for n in nodes}
    triples |= {(r.choice(nodes), p, r.choice(nodes)) for p in ("many", "few") for _ in range(25 if p == "many" else 6)}
    return sorted(triples, key=str)


def test_random_patterns_with_and_without_statistics(spark):
    r = random.Random(5)
    triples = made_graph(r)
    table = frame(spark, triples).cache()
    known = statistics_of(table)
    known = statistics.Statistics(known.predicates.cache(), known.sets.cache())
    graphs = [Graph(table), Graph(table, known), Graph(table, functional=frozenset(["one", "size", TYPE]))]
    shapes = [
        [("?x", TYPE, "A"), ("?x", "one", "?y"), ("?x", "many", "?z"), ("?x", "size", "?n")],
        [("?x", "many", "?y"), ("?x", "many", "?z"), ("?y", "one", "?z")],
        [("?x", "one", "?y"), ("?x", "many", "?y")],
        [("?x", "many", "?x"), ("?x", "size", "?n")],
        [("?x", "one", "?y"), ("?y", "one", "?z"), ("?z", TYPE, "B"), ("?y", "size", 2), ("?x", "size", "?n")],
        [("?x", "?p", "?y"), ("?x", TYPE, "B"), ("?y", TYPE, "A"), ("?y", "size", "?n")],
        [("?x", "few", "?y"), ("?y", "few", "?z"), ("?z", "few", "?x")],
        [("?x", "none", "?y"), ("?x", TYPE, "?t")],
        [("n1", "many", "?y"), ("?y", "one", "?z"), ("?y", TYPE, "?t")],
    ]
    for patterns in shapes:
        variables = sorted({t for p in patterns for t in p if isinstance(t, str) and t.startswith("?")})
        wanted = brute(triples, patterns, variables)
        for graph in graphs:
            got = sparql.run(graph, text(patterns, variables)).collect()
            assert sorted(map(tuple, got)) == wanted, patterns


def test_a_second_object_of_a_functional_predicate_is_an_error(spark):
    table = frame(spark, [("a", "one", "b"), ("a", "one", "c"), ("a", TYPE, "A")])
    with pytest.raises(Exception, match="several objects of one at a"):
        sparql.run(Graph(table, functional=frozenset(["one"])), text([("?x", "one", "?y"), ("?x", TYPE, "A")], ["?x", "?y"])).collect()
    repeated = frame(spark, [("a", "one", "b"), ("a", "one", "b"), ("a", TYPE, "A")])  # a bag: the same object again
    got = sparql.run(Graph(repeated, functional=frozenset(["one"])), text([("?x", "one", "?y"), ("?x", TYPE, "A")], ["?x", "?y"]), is_set=False).collect()
    assert [tuple(r) for r in got] == [("a", "b")]


def test_statistics(spark):
    table = frame(spark, [("a", TYPE, "A"), ("a", "p", "x"), ("a", "p", "y"), ("b", TYPE, "A"), ("b", "p", "x"), ("c", "q", 3)])
    found = statistics_of(table)
    assert sorted(tuple(r) for r in found.predicates.collect()) == sorted([(TYPE, 2, 2, 1, 1), ("p", 3, 2, 2, 2), ("q", 1, 1, 1, 1)])
    assert {(tuple(r["members"]), r["subjects"]) for r in found.sets.collect()} == {(tuple(sorted([TYPE, TYPE + " A", "p"])), 2), (("q",), 1)}
    assert found.subjects([["p"], [statistics.member(TYPE, "A"), "p"], ["p", "q"], []]) == [2, 2, 0, 3]
    assert found.of(["p", "nowhere"]).keys() == {"p"} and found.of([]) == {}
    empty = statistics_of(frame(spark, []))
    assert empty.subjects([["p"]]) == [0] and empty.of(["p"]) == {}


def test_order_is_the_cheapest(spark):
    estimates = [(1e6, {"x": 1e6, "y": 1e3}), (10.0, {"y": 10.0}), (1e4, {"x": 1e4, "z": 1e4}), (5.0, {"z": 5.0})]

    def cost(order):
        rows, values, total = estimates[order[0]][0], dict(estimates[order[0]][1]), 0.0
        for k in order[1:]:
            n, own = estimates[k]
            joined = rows * n
            for v in values.keys() & own.keys():
                joined /= max(values[v], own[v])
            values = {v: max(1.0, min(values.get(v, joined), own.get(v, joined), joined)) for v in values.keys() | own.keys()}
            rows, total = joined, total + joined
        return total + estimates[order[0]][0]

    connected = [o for o in itertools.permutations(range(4)) if all(any(estimates[k][1].keys() & estimates[j][1].keys() for j in o[:i]) for i, k in enumerate(o) if i)]
    assert cost(sparql.join_order(estimates)) == min(map(cost, connected))
    many = [(float(10 + k), {f"v{k}": 10.0, f"v{k + 1}": 10.0}) for k in range(14)]  # a long chain
    assert sorted(sparql.join_order(many)) == list(range(14))


def genes(n):
    out = []
    for k in range(n):
        orf, feat = f"{B}sgd_id.S{k}", f"{B}sgd_feature.Y{k}"
        out += [(orf, TYPE, f"{B}sgd_id"), (orf, f"{B}sgd_id_has_type", f"{B}sgd_feature_type.ORF"), (orf, f"{B}sgd_id_has_qualifier", f"{B}sgd_id_qualifier.Verified"), (orf, SAME, feat), (feat, TYPE, f"{B}sgd_feature")]
        i = f"{B}sgd_int.{k}"
        out += [(i, TYPE, f"{B}sgd_int"), (i, f"{B}sgd_int_has_bait", feat), (i, f"{B}sgd_int_has_hit", f"{B}sgd_feature.Y{(k + 1) % n}"), (i, f"{B}sgd_int_has_type", f"{B}sgd_int_type.physical_interactions")]
    return out


def scans(df):
    return str(df._jdf.queryExecution().optimizedPlan()).count("Relation [")


def test_one_scan_a_star(spark, tmp_path):
    store = TripleStore(spark, str(tmp_path / "store"))
    store.load(frame(spark, genes(12)))
    query = f"""SELECT DISTINCT ?a ?b WHERE {{ ?a a bw:sgd_id ; bw:sgd_id_has_type bw:sgd_feature_type.ORF ; bw:sgd_id_has_qualifier bw:sgd_id_qualifier.Verified ; owl:sameAs ?f .
        ?b a bw:sgd_id ; bw:sgd_id_has_type bw:sgd_feature_type.ORF ; bw:sgd_id_has_qualifier bw:sgd_id_qualifier.Verified ; owl:sameAs ?g . ?f a bw:sgd_feature . ?g a bw:sgd_feature .
        ?i a bw:sgd_int ; bw:sgd_int_has_bait ?f ; bw:sgd_int_has_hit ?g ; bw:sgd_int_has_type bw:sgd_int_type.physical_interactions . }}"""
    df = sparql.run(store.view(), query)
    assert scans(df) == 5  # fourteen patterns
    assert {(r["a"], r["b"]) for r in df.collect()} == {(f"{B}sgd_id.S{k}", f"{B}sgd_id.S{(k + 1) % 12}") for k in range(12)}
    assert experiment.physical_interactions(store.view()).count() == 24


def test_cyclic_pattern_starts_from_the_rarest_predicate(spark, tmp_path):
    """Few hits, many residues: the hits' star comes first, and the residues' last."""
    out = []
    for k in range(20):
        p, d, f, i = f"{B}gold_protein.P{k}", f"{B}gold_domain.D{k}", f"{B}sgd_feature.Y{k}", f"{B}sgd_id.S{k}"
        fam = f"{B}family.F{k % 3}"
        out += [(p, TYPE, f"{B}gold_protein"), (p, f"{B}gold_parent_of", d), (p, SAME, f), (d, TYPE, f"{B}gold_domain"), (d, f"{B}gold_instance_of", fam), (f, TYPE, f"{B}sgd_feature"), (i, TYPE, f"{B}sgd_id"), (i, SAME, f), (i, f"{B}sgd_id_has_type", f"{B}sgd_feature_type.ORF")]
        for n in range(30):
            r = f"{B}gold_residue.R{k}_{n}"
            out += [(d, f"{B}gold_parent_of", r), (r, TYPE, f"{B}gold_residue"), (r, f"{B}gold_residue_has_position", n)]
        if k in (4, 7):
            h = f"{B}sgd_ipr_hit.H{k}"
            out += [(f, f"{B}sgd_feature_has_ipr_hit", h), (h, TYPE, f"{B}sgd_ipr_hit"), (h, f"{B}sgd_ipr_hit_has_db_id", fam), (h, f"{B}sgd_ipr_hit_starts_at", 3), (h, f"{B}sgd_ipr_hit_stops_at", 5)]
    rows = frame(spark, out).unionByName(spark.createDataFrame([(f"{B}sgd_ipr_hit.H{k}", "iri", f"{B}sgd_ipr_hit_{p}", o, "literal", t) for k in (4, 7) for p, o, t in (("is_true", "true", "boolean"), ("has_method", "Pfam", "string"))], SCHEMA))
    store = TripleStore(spark, str(tmp_path / "store"))
    store.load(rows)
    view = store.view()
    patterns = sparql.parse(f"SELECT * WHERE {{ {POSITIONS} }}").patterns
    assert len(patterns) == 19
    order, _ = sparql.plan(view, patterns)
    subjects = [u.subject if isinstance(u, sparql.Star) else u.s.value for u in order]
    assert subjects[0] in ("hit", "feat") and subjects[-1] == "r" and len(order) == 6
    got = experiment.gold_positions(view).collect()
    assert {(r["domain"], r["position"], r["family"]) for r in got} == {(f"D{k}", n, f"F{k % 3}") for k in (4, 7) for n in (3, 4, 5)}


POSITIONS = """?p a bw:gold_protein ; bw:gold_parent_of ?d ; owl:sameAs ?feat . ?d a bw:gold_domain ; bw:gold_parent_of ?r ; bw:gold_instance_of ?pfam .
    ?r a bw:gold_residue ; bw:gold_residue_has_position ?pos . ?feat a bw:sgd_feature ; bw:sgd_feature_has_ipr_hit ?hit .
    ?id a bw:sgd_id ; owl:sameAs ?feat ; bw:sgd_id_has_type bw:sgd_feature_type.ORF .
    ?hit a bw:sgd_ipr_hit ; bw:sgd_ipr_hit_is_true true ; bw:sgd_ipr_hit_has_method "Pfam" ; bw:sgd_ipr_hit_has_db_id ?pfam ; bw:sgd_ipr_hit_starts_at ?start ; bw:sgd_ipr_hit_stops_at ?stop ."""


def test_store_keeps_statistics_of_what_it_holds(spark, tmp_path):
    store = TripleStore(spark, str(tmp_path / "store"))
    assert store.statistics() is None and store.view().triples.count() == 0
    store.load(frame(spark, genes(3)))
    first = store.view()
    assert first.statistics.of([SAME])[SAME]["triples"] == 3 and store.view().version == first.version
    store.load(frame(spark, genes(5)))
    later = store.view()
    assert later.version != first.version and later.statistics.of([SAME])[SAME]["triples"] == 5
    store.load(frame(spark, genes(6)), analyze=False)
    assert store.view().statistics.of([SAME])[SAME]["triples"] == 6


# Cache keys of sources.


def test_fingerprints(spark, tmp_path):
    assert files.fingerprint(spark, str(tmp_path / "missing")) == "none"
    one = tmp_path / "a.txt"
    one.write_text("x")
    before = files.fingerprint(spark, str(tmp_path))
    assert before == files.fingerprint(spark, str(tmp_path))
    one.write_text("xy")
    assert files.fingerprint(spark, str(tmp_path)) != before
    rows = frame(spark, genes(4))
    assert files.content_fingerprint(rows) == files.content_fingerprint(rows.repartition(3)) != files.content_fingerprint(rows.limit(7))
    assert files.content_fingerprint(rows) != files.content_fingerprint(rows.unionByName(rows)) and files.content_fingerprint(rows.limit(0))


def test_stages_are_made_again_when_their_source_changed(spark, tmp_path):
    store = TripleStore(spark, str(tmp_path / "store"))

    def run(sources):
        todo = [stages.Stage(lambda c: store.graph().groupBy("p").agg(F.count("*").alias("n")), (), ("counts",), sources=("graph",)), stages.Stage(lambda c, counts: counts.agg(F.sum("n").alias("n")), ("counts",), ("total",)), stages.Stage(lambda c: spark.range(2), (), ("fixed",))]
        scheduler = stages.Scheduler(spark, todo, str(tmp_path / "cache"), {}, sources)
        out = scheduler.run(["total", "fixed"])
        return out["total"].first()["n"], scheduler.ran

    store.load(frame(spark, genes(2)))
    assert run({"graph": store.version()}) == (18, [("counts",), ("total",), ("fixed",)])
    assert run({"graph": store.version()}) == (18, [])
    store.load(frame(spark, genes(3)))
    assert run({"graph": store.version()}) == (28, [("counts",), ("total",)])
    assert run({}) == (28, [("counts",), ("total",)]) == run({})  # no version, nothing kept


OBO = "[Term]\nid: T:1\nname: root\nnamespace: n\n\n[Term]\nid: T:2\nname: {}\nnamespace: n\nis_a: T:1\n"


def test_experiment_follows_its_sources(spark, tmp_path):
    """Other triples, another ontology: other results, without being told to."""
    store = TripleStore(spark, str(tmp_path / "store"))
    store.load(genome(spark, 6))
    (tmp_path / "terms.obo").write_text(OBO.format("leaf"))
    run = lambda: experiment.run(spark, store.view, str(tmp_path / "terms.obo"), str(tmp_path / "out"), targets=["entities", "terms"], num_folds=2, min_sequence_len=1, redundancy=1.0)
    made = run()
    assert made["entities"].count() == 6 and {r["name"] for r in made["terms"].collect()} == {"root", "leaf"}
    store.load(genome(spark, 8))
    (tmp_path / "terms.obo").write_text(OBO.format("other"))
    made = run()
    assert made["entities"].count() == 8 and {r["name"] for r in made["terms"].collect()} == {"root", "other"}


def genome(spark, n):
    r = random.Random(2)
    out = genes(n)
    notes = []
    for k in range(n):
        orf, note = f"{B}sgd_id.S{k}", f"{B}sgd_go_annotation.{k}"
        out += [(note, TYPE, f"{B}sgd_go_annotation"), (note, f"{B}sgd_go_annotation_has_sgd_id", orf), (note, f"{B}sgd_go_annotation_has_term", "http://x/#T:2")]
        notes += [(note, "iri", f"{B}sgd_go_annotation_has_ecode", "IDA", "literal", "string"), (orf, "iri", f"{B}sgd_id_has_sequence", "".join(random.Random(k).choices("ACDEFGHIKLMNPQRSTVWY", k=60)), "literal", "string")]
        notes += [(orf, "iri", f"{B}sgd_id_in_chromosome", f"{B}chromosome.1", "iri", None), (orf, "iri", f"{B}sgd_id_in_strand", "W", "literal", "string"), (orf, "iri", f"{B}sgd_id_starts_at", str(r.randint(0, 99)), "literal", "integer"), (orf, "iri", f"{B}sgd_id_stops_at", "200", "literal", "integer")]
    return frame(spark, out).unionByName(spark.createDataFrame(notes, SCHEMA))


def test_stars_of_rows_are_not_grouped(spark):
    rows = spark.createDataFrame([("a", "x", 1, "a"), ("b", "y", 2, "x"), ("c", None, 2, "c"), (None, "z", 2, "a")], "k string, x string, n int, same string")
    s = F.col("k")
    rules = (iri(s, TYPE, "C"), iri(s, "to", F.col("x")), literal(s, "n", F.col("n"), "integer"), iri(s, "same", F.col("same"), when=F.col("n") < 3))
    triples = to_triples(rows, list(rules), distinct=False, by_rule=True)
    functional = frozenset({"to", "n", "same"})
    plain, known = Graph(triples, functional=functional), Graph(triples, functional=functional, subjects=((rows, rules),))
    for text, n in (
        ("SELECT ?s ?x ?n WHERE { ?s a <C> ; <to> ?x ; <n> ?n . }", 2),
        ("SELECT ?s ?x WHERE { ?s <to> ?x ; <n> 2 . }", 1),
        ('SELECT ?s ?x WHERE { ?s <to> ?x ; <n> "2" . }', 1),
        ("SELECT ?s ?n WHERE { ?s <same> ?s ; <n> ?n . }", 2),
        ("SELECT ?s ?n WHERE { ?s <same> <a> ; <n> ?n ; <to> <x> . }", 1),
        ("SELECT ?s ?x WHERE { ?s <to> ?x ; <n> ?x . }", 0),
    ):
        got, wanted = sparql.run(known, text), sparql.run(plain, text)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() == n
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in wanted._jdf.queryExecution().executedPlan().toString()
