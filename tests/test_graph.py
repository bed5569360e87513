import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork import settings
from braidwork import terms as V
from braidwork.__main__ import main
from braidwork.functions import numeric, text
from braidwork.operators import features, folds, network, ontology, strings
from braidwork.plans import experiment, mapping, mappings, sparql
from braidwork.plans.stages import Scheduler, Stage, StageError
from braidwork.plans.store import TripleStore
from braidwork.sources import files, sinks
from braidwork.streaming import triples as streams

B = V.BASE


def table(spark, columns, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (len(columns) - len(r)) for r in rows], files.string_schema(columns))


def statements(df):
    return {(r["s"].replace(B, ""), r["p"].replace(B, ""), r["o"].replace(B, "")) for r in df.collect()}


@pytest.fixture(scope="module")
def gene_triples(spark):
    features_ = table(
        spark,
        mappings.FEATURES,
        ("S1", "ORF", "Verified|Verified", "YA", "", "", "chromosome 1", "L1|L2", "1", "10", "20", "W"),
        ("S2", "ORF", "Verified", "YB", None, None, None, None, "1", "40", "30", "C"),
        ("S3", "ORF", "Dubious", "YC", None, None, None, None, "2", "1", "2", "W"),
    )
    interactions = table(
        spark,
        mappings.INTERACTIONS,
        ("YA", "", "YB", "", "Two-hybrid", "physical interactions", "BioGRID", "manually curated"),
        ("YB", "", "YA", "", "Two-hybrid", "physical interactions", "BioGRID", "high-throughput"),
        ("YA", "", "YC", "", "x", "physical interactions", "BioGRID", "manually curated"),
        ("YA", "", "YA", "", "x", "genetic interactions", "BioGRID", "manually curated"),
    )
    gos = table(spark, mappings.ASSOCIATIONS, ("SGD", "S1", "", "", "GO:1", "", "IDA"), ("SGD", "S1", "", "NOT", "GO:2", "", "IEA"), ("SGD", "S2", "", "NOT", "GO:2", "", "ND"))
    domains = table(spark, mappings.DOMAINS, ("YA", "", "", "Pfam", "PF1", "", "5", "9", "1e-4", "T", "", "IPR1"), ("YA", "", "", "Pfam", "PF2", "", "1", "2", "oops", "?", "", ""), ("YB", "", "", "SMART", "SM1", "", "1", "2", "", "T"))
    aliases = table(spark, mappings.ALIASES, ("4932", "YA.1", "S1", "BLAST SGD"), ("4932", "YB", "S2", "SGD"), ("4932", "YB", "X2", "SGD"))
    aliases = aliases.withColumn("ALIAS_ID", F.when(F.col("ALIAS_ID").startswith("S"), F.concat(F.lit("S0"), F.substring("ALIAS_ID", 2, 9))).otherwise(F.col("ALIAS_ID")))
    actions = table(spark, mappings.ACTIONS, ("4932.YA.1", "4932.YB", "binding"), ("4932.YA.1", "9606.YB", "binding"))
    sequences = spark.createDataFrame([("x SGDID:S1, more", "MKA")], "header string, sequence string")
    parts = [mappings.sgd_features(features_), mappings.sgd_interactions(interactions), mappings.sgd_associations(gos), mappings.sgd_domains(domains), mappings.string_aliases(aliases), mappings.string_actions(actions), mappings.sgd_sequences(sequences)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.cache()


def test_feature_mapping(gene_triples):
    got = statements(gene_triples)
    assert {o for s, p, o in got if (s, p) == ("sgd_id.S1", "sgd_id_has_qualifier")} == {"sgd_id_qualifier.Verified"}
    assert ("sgd_id_qualifier.Verified", V.TYPE, "sgd_id_qualifier") in got
    assert {o for s, p, o in got if (s, p) == ("sgd_id.S1", V.SAME_AS)} == {"sgd_feature.YA", "sgd_id.L1", "sgd_id.L2"}
    assert ("sgd_id.S1", V.PART_OF, "sgd_feature.chromosome_1") in got and ("sgd_id.S2", "sgd_id_starts_at", "40") in got
    assert not [x for x in got if x[0] == "sgd_id.S2" and x[1] == V.PART_OF]
    assert ("sgd_int_source.BioGRID", V.TYPE, "sgd_int_source") in got
    assert {o for _, p, o in got if p == "sgd_ipr_hit_has_evalue"} == {"1.0E-4", "-1.0"}
    assert {o for _, p, o in got if p == "sgd_ipr_hit_has_db_id"} == {"pfam_id.PF1"}


def test_gene_queries(gene_triples):
    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(experiment.gene_ids(gene_triples)) == [("S1",), ("S2",)]
    assert rows(experiment.gene_sequences(gene_triples)) == [("S1", "MKA")]
    assert rows(experiment.gene_terms(gene_triples)) == [("S1", "GO:1"), ("S2", "GO:2")]
    assert rows(experiment.gene_contexts(gene_triples)) == [("S1", "chromosome_1", "W", 10, 20), ("S2", "chromosome_1", "C", 40, 30)]
    assert rows(experiment.gene_features(gene_triples)) == [("S1", "YA"), ("S2", "YB")]
    both = [("S1", "S2"), ("S2", "S1")]
    assert rows(experiment.physical_interactions(gene_triples)) == both
    assert rows(experiment.physical_interactions(gene_triples, True)) == both
    edited = gene_triples.withColumn("s", F.regexp_replace("s", r"sgd_id\.S(\d)$", "sgd_id.S0$1")).withColumn("o", F.regexp_replace("o", r"sgd_id\.S(\d)$", "sgd_id.S0$1"))
    assert rows(experiment.action_interactions(edited)) == [("S01", "S02"), ("S02", "S01")]


def test_gold_queries(spark, gene_triples, tmp_path):
    lines = {"ppi/ready/proteins.txt": "YA\nYB\n", "ppi/ready/goldPosProteinPairs.txt": "YA YB 1\n", "ppi/ready/goldNegProteinPairs.txt": "YB YB\n", "ddi/ready/domains.txt": "YA PF1\n", "rri/ready/residues.txt": "YA PF1 5\nYA PF1 9\nYA PF1 10\n"}
    for kind, folder in (("Domain", "ddi"), ("Residue", "rri")):
        lines |= {f"{folder}/ready/gold{sign}{kind}Pairs.txt": "YA PF1 5 YA PF1 9 x\n" if kind == "Residue" else "YA PF1 YB PF2 x\n" for sign in ("Pos", "Neg")}
    for name, content in lines.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    tables = files.gold(spark, str(tmp_path))
    all_triples = gene_triples.unionByName(mappings.gold_standard(tables, expected_pairs=1))
    assert [tuple(r) for r in experiment.gold_pairs(all_triples, "protein", True).collect()] == [("YA", "YB")]
    assert [tuple(r) for r in experiment.gold_pairs(all_triples, "residue", False).collect()] == [("YA_PF1_5", "YA_PF1_9")]
    assert [tuple(r) for r in experiment.gold_sequences(all_triples).collect()] == [("YA", "MKA")]
    assert sorted(r["pos"] for r in experiment.gold_contexts(all_triples).collect()) == [15.0, 35.0]
    got = sorted(r["position"] for r in experiment.gold_positions(all_triples).collect())
    assert got == [5, 9]  # the borders count
    with pytest.raises(ValueError):
        mappings.gold_standard(tables, expected_pairs=3201)


def test_sparql_subset(spark):
    t = spark.createDataFrame([(B + "a", "iri", B + "p", "1", "literal", "integer"), (B + "a", "iri", B + "p", "10", "literal", "integer"), (B + "b", "iri", B + "p", "x", "literal", "string"), (B + "a", "iri", B + "q", B + "b", "iri", None), (B + "a", "iri", V.TYPE, B + "k.x", "iri", None)], mapping.SCHEMA)

    def run(q, **o):
        return sorted(tuple(x.replace(B, "") if isinstance(x, str) else x for x in r) for r in sparql.run(t, q, **o).collect())

    assert run("SELECT ?s ?v WHERE { ?s bw:p ?v . FILTER(?v >= 9 && ?v <= 10) }") == [("a", "10")]
    assert run("PREFIX e: <urn:e#> SELECT DISTINCT ?s WHERE { ?s bw:p ?v ; a bw:k.x. } ") == [("a",)]
    assert run("SELECT ?s WHERE { ?s bw:p ?v ; a bw:k.x }") == [("a",), ("a",)]
    assert run('SELECT ?s WHERE { ?s bw:p "x" }') == [("b",)]
    assert run("SELECT ?x ?y WHERE { ?x ?r ?y . ?y bw:p ?z }") == [("a", "b")]
    assert run("SELECT ?s ?v WHERE { ?s bw:p ?v FILTER(?v = 'x') }") == [("b", "x")]
    assert run("SELECT ?s ?n WHERE { ?s bw:q ?o }", arity=1) == [("a", None)]
    assert run("SELECT ?v WHERE { bw:a bw:p ?v } # note", types={"v": "long"}) == [(1,), (10,)]
    assert run("ASK { GRAPH <urn:g> { ?s a bw:none } }") == [(False,)]
    assert run("SELECT * WHERE { <urn:braidwork:term#a> bw:q ?o }") == [("b",)]
    for bad in ("SELECT WHERE { ?s ?p ?o }", "SELECT ?s WHERE { ?s zz:p ?o }", "DESCRIBE ?s", "SELECT ?s WHERE { ?s ?p }", "ASK { ?s a ?o } x", "SELECT ?s WHERE { ?s bw:p ?o FILTER(?q > 1) }", "SELECT ?s WHERE { ?s % ?o }"):
        with pytest.raises(sparql.SparqlError):
            sparql.run(t, bad)
    with pytest.raises(sparql.SparqlError):
        sparql.run(t, "SELECT ?s WHERE { ?s a ?k }", arity=2)


def test_other_mappings(spark):
    entries = table(spark, mappings.PDB_ENTRIES, ("1ABC", "", "", "", "2.5", "X-RAY (a)"))
    assert ("http://rdf.wwpdb.org/pdb/1abc", "pdb_has_exp_method", "X-RAY__a_") in statements(mappings.ipfam_entries(entries))
    families = table(spark, mappings.FAMILIES, ("1", "PF1", "", "", "", "domain", "pfama"), ("2", "PF2", "", "", "", None, "pfama"), ("3", "PF3", "", "", "", "x", "other"))
    assert len(statements(mappings.ipfam_families(families))) == 4
    homo, hetero = table(spark, ["FAM", "ID", "INT_TYPE"], ("A", "", "t")), table(spark, ["FAM1", "ID1", "FAM2", "ID2", "INT_TYPE"], ("A", "", "B", "", "t"))
    got = mappings.ipfam_interactions(homo, hetero)
    assert got.where(F.col("p") == V.own("ipfam_int_has_pfam")).count() == 3
    assert len(statements(mappings.ipfam_regions(table(spark, mappings.REGIONS, ("7", "", "PF1", "1ABC", "A", "3", "", "9"))))) == 5
    assert len(statements(mappings.ipfam_region_interactions(table(spark, mappings.REGION_INTERACTIONS, ("1", "1ABC", "7", "8"))))) == 4
    homologs = table(spark, mappings.HOMOLOGS, ("YA", "", "", "", "", "50", "", "1ABC_B"), ("YA", "", "", "", "", "25", "", "2XYZ"))
    assert {o for _, p, o in statements(mappings.sgd_homologs(homologs)) if p == "sgd_pdb_has_target"} == {"http://rdf.wwpdb.org/pdb/1abc_B", "http://rdf.wwpdb.org/pdb/2xyz"}
    with pytest.raises(Exception, match="no PDB id"):
        mappings.sgd_homologs(table(spark, mappings.HOMOLOGS, ("YA", "", "", "", "", "1", "", "12345"))).collect()
    xrefs = table(spark, mappings.XREFS, ("P1", "EBI", "UniProt/Swiss-Prot ID", "", "S1"), ("P2", "EBI", "other", "", "S1"))
    assert [x[2] for x in statements(mappings.sgd_xrefs(xrefs))] == ["http://purl.uniprot.org/uniprot/P1"]
    slim = table(spark, mappings.SLIM, ("", "", "S1", "", "other", "GO:9"), ("", "", "S1", "", "x", "GO:1"))
    assert len(statements(mappings.sgd_slim(slim))) == 1
    groups = table(spark, mappings.GROUPS, ("4932.a.b", "", "", "COG1"), ("4932.a", "", "", "NOG2"), ("9606.a", "", "", "COG1"))
    assert ("string_id.a.b", "string_id_in_cog", "cog_cluster_id.COG1") in statements(mappings.string_groups(groups))
    assert len(statements(mappings.string_groups(groups))) == 4
    fasta = spark.createDataFrame([("1abc:A:sequence", "MK"), ("1abc:A:secstr", "HH")], "header string, sequence string")
    assert len(statements(mappings.pdb_structures(fasta))) == 2
    with pytest.raises(Exception, match="twice"):
        mappings.pdb_structures(fasta.unionByName(fasta)).collect()
    assert len(statements(mappings.sifts_chains(table(spark, mappings.CHAINS, ("1ABC", "A", "P1"))))) == 1
    assert len(statements(mappings.pdb_ids(spark.createDataFrame([("1abc.cif.gz",)], "name string")))) == 1
    cafa = table(spark, ["ID", "SEQUENCE", "GO", "TAXID", "EVIDENCE"], ("T1", "MK", "GO:1;GO:2;GO:1", "9606", None))
    assert len(statements(mappings.function_annotations(cafa))) == 5


def test_psimi(spark):
    row = {"ID_INTERACTOR_A": "uniprotkb:P1", "ID_INTERACTOR_B": "-", "TAXID_INTERACTOR_A": "taxid:-2|taxid:9606(human)", "INTERACTION_TYPES": 'psi-mi:"MI:0915"(physical)', "CONFIDENCE_VALUES": "author:x|intact-miscore:0.5", "IS_NEGATIVE": "false", "SOURCE_DATABASE": "unknown:x|mint:7", "INTERACTION_IDENTIFIERS": None}
    df = table(spark, files.PSIMI, [row.get(c) for c in files.PSIMI])
    got = {(p.rpartition("/")[2], o) for _, p, o in statements(mappings.psimi(df))}
    obo = V.PREFIXES["obo"]
    assert {("MI_has_interactor_a", V.PREFIXES["uniprot"] + "P1"), ("has_taxid_interactor_a", "-2"), ("has_taxid_interactor_a", V.PREFIXES["taxon"] + "9606"), ("MI_has_type", obo + "MI_0915"), ("MI_has_confidence", "0.5"), ("is_negative", "false"), ("MI_has_source_db", obo + "MINT_7")} <= got
    assert len(got) == 8
    for column, value in (("ID_INTERACTOR_A", "uniprotkb:1|uniprotkb:2"), ("SOURCE_DATABASE", "zzz:1"), ("IS_NEGATIVE", "maybe")):
        with pytest.raises(Exception, match="several ids|unknown PSI-MI|no boolean"):
            mappings.psimi(df.withColumn(column, F.lit(value))).collect()


def test_store(spark, tmp_path):
    store = TripleStore(spark, str(tmp_path / "store"))
    t = mapping.to_triples(spark.range(5), [mapping.iri(V.mint("x", F.col("id").cast("string")), V.TYPE, V.own("x")), mapping.literal(V.mint("x", F.col("id").cast("string")), V.own("n"), F.col("id"), "integer")])
    assert store.is_empty()
    store.load(t)
    store.load(t)
    assert store.graph().count() == 10 and not store.is_empty()
    df = sparql.run(lambda g: store.graph(), "SELECT ?x WHERE { ?x bw:n 3 }")
    assert df.count() == 1 and "PartitionFilters: [isnotnull(p" in df._jdf.queryExecution().toString()
    store.load(t, "urn:other")
    store.clear()
    assert store.is_empty() and not store.is_empty("urn:other")


def toy_ontology(spark):
    terms = spark.createDataFrame([(x, x, "n") for x in "ABCDE"], "id string, name string, namespace string")
    edges = spark.createDataFrame([("B", "A", "is_a"), ("C", "A", "is_a"), ("D", "B", "is_a"), ("D", "C", "is_a"), ("E", "D", "is_a")], "child string, parent string, relation string")
    return terms, edges, spark.createDataFrame([("D", "p1"), ("E", "p2"), ("C", "p3")], "id string, p string")


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], set()).add(r["p"])
    return out


def test_ontology(spark):
    terms, edges, annotations = toy_ontology(spark)
    assert {r["id"]: r["level"] for r in ontology.levels(terms, edges).collect()} == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 3}
    spread = ontology.propagate(annotations, edges).cache()
    assert sets(spread) == {"A": {"p1", "p2", "p3"}, "B": {"p1", "p2"}, "C": {"p1", "p2", "p3"}, "D": {"p1", "p2"}, "E": {"p2"}}
    assert sets(ontology.propagate(spread, edges)) == sets(spread)
    for options, kept in (({"max_depth": 1}, "ABC"), ({"min_annot": 2}, "ABCD"), ({"max_depth": 2}, "ABCD")):
        got = ontology.prune(terms, edges, spread, **options)[0]
        assert sorted(r["id"] for r in got.collect()) == list(kept)
    flat = spark.createDataFrame([("X", "R", "is_a"), ("Y", "R", "is_a")], "child string, parent string, relation string")
    terms = spark.createDataFrame([(x, x, "n") for x in "RXY"], "id string, name string, namespace string")
    spread = ontology.propagate(spark.createDataFrame([("X", "p1"), ("Y", "p2")], "id string, p string"), flat)
    kept, kept_edges, kept_annotations = ontology.prune(terms, flat, spread, min_annot=2)
    assert {(r["id"], r["level"], r["is_bin"]) for r in kept.collect()} == {("R", 0, False), ("BN:R", 1, True)}
    assert sets(kept_annotations)["BN:R"] == {"p1", "p2"}
    assert ontology.violations(kept, kept_edges, kept_annotations, 2).count() == 0
    assert ontology.violations(kept, kept_edges, kept_annotations, 3).count() == 2
    stats = {r["level"]: tuple(r)[1:] for r in ontology.level_statistics(kept, kept_annotations).collect()}
    assert stats == {0: (1, 0, 2, 2), 1: (1, 1, 2, 2)}
    assert "<edge source" in " ".join(r["value"] for r in sinks.ontology_graph(kept, kept_edges, kept_annotations).collect())
    known, unknown = ontology.annotate(terms, spark.createDataFrame([("R", "p"), ("Q", "p")], "id string, p string"))
    assert (known.count(), unknown.count()) == (1, 1)


OBO = """format-version: 1.2
remark: not a term

[Term]
id: T:0
name: root
namespace: n
alt_id: T:90
alt_id: T:91

[Term]
id: T:1
name: one
namespace: n
is_a: T:0 ! root
relationship: part_of T:0 ! root

[Term]
id: T:2
name: two: a
namespace: n
is_a: T:0 ! root
is_a: T:1 ! one

[Term]
id: T:3
name: old
namespace: n
is_obsolete: true

[Typedef]
id: part_of
name: part of
"""


def test_ontology_file(spark, tmp_path):
    path = tmp_path / "x.obo"
    path.write_text(OBO)
    terms, edges = files.obo(spark, str(path))
    assert sorted((r["id"], r["name"]) for r in terms.collect()) == [("T:0", "root"), ("T:1", "one"), ("T:2", "two: a")]
    assert files.obo(spark, str(path), True)[0].count() == 4
    assert sorted(tuple(r) for r in edges.collect()) == [("T:1", "T:0", "is_a"), ("T:1", "T:0", "part_of"), ("T:2", "T:0", "is_a"), ("T:2", "T:1", "is_a")]
    assert sorted(r["alt_id"] for r in ontology.alternatives(terms).collect()) == ["T:90", "T:91"]
    assert {r["id"]: r["level"] for r in ontology.levels(terms, edges).collect()} == {"T:0": 0, "T:1": 1, "T:2": 1}
    assert ontology.closure(edges).count() == 3
    roots = spark.createDataFrame([("T:2", "a")], "id string, p string")
    assert ontology.propagate(roots, edges).count() == 3
    path.write_text(OBO + "\n[Term]\nid: T:1\nname: again\n")
    with pytest.raises(Exception, match="two terms"):
        files.obo(spark, str(path))[0].collect()


def test_networks(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "p string, q string")
    assert network.symmetrize(pairs).count() == 4 and network.canonical(pairs).count() == 2
    assert network.asymmetric(network.symmetrize(pairs)).count() == 0 and network.asymmetric(pairs).count() == 1
    names = spark.createDataFrame([(c,) for c in "abcd"], "p string")
    row = network.density(network.symmetrize(pairs), names).first()
    assert row["density"] == pytest.approx(4 / 12)
    many = spark.range(400).select(F.format_string("e%03d", "id").alias("p"))
    known = network.symmetrize(spark.range(399).select(F.format_string("e%03d", "id").alias("p"), F.format_string("e%03d", F.col("id") + 1).alias("q")))
    got = network.sample_negatives(many, known, 600, seed=1).cache()
    assert got.count() == 600 and got.join(known, ["p", "q"]).count() == 0 and got.where("p = q").count() == 0 and network.asymmetric(got).count() == 0
    assert network.sample_negatives(names, network.symmetrize(pairs), 100).count() == 8
    assert [r["index"] for r in network.number(names, "p").orderBy("p").collect()] == [0, 1, 2, 3]


def test_folds(spark):
    names = spark.range(50).select(F.format_string("e%02d", "id").alias("p"))
    feats = names.select("p", F.concat(F.lit("f"), F.substring("p", 3, 1)).alias("feature")).where("p < 'e40'").unionByName(names.where("p < 'e10'").withColumn("feature", F.lit("g")))
    dealt = folds.balanced_folds(names, feats, 5, seed=2).cache()
    assert dealt.count() == 50 and dealt.select("p").distinct().count() == 50
    sizes = [r["count"] for r in dealt.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 10
    most = dealt.join(feats.where("feature <> 'g'"), "p").groupBy("fold", "feature").count().agg(F.max("count")).first()[0]
    assert most <= 2  # four entities over five folds, in two rounds at most
    assert folds.feature_order({("a",): 5, ("a", "b"): 1, ("c",): 1}) == ["b", "c", "a"]
    r = random.Random(3)
    members = spark.createDataFrame([(f"e{k}", f) for k in range(60) for f in r.sample("abcdefg", k=r.randint(0, 3))], "p string, feature string")
    every = spark.createDataFrame([(f"e{k}",) for k in range(70)], "p string")
    one, other = (sorted(tuple(x) for x in folds.balanced_folds(every, members, 4, 2, most).collect()) for most in (1000, 1))
    assert one == other and len(one) == 70
    pairs = network.symmetrize(spark.range(23).select(F.format_string("e%02d", "id").alias("p"), F.format_string("e%02d", F.col("id") + 20).alias("q")))
    both = folds.pair_folds(pairs, pairs.limit(0), 5, seed=1).cache()
    assert sorted(r["count"] for r in both.groupBy("fold").count().collect()) == [8, 8, 8, 8, 14]
    assert both.join(both.select(F.col("q").alias("p"), F.col("p").alias("q"), "fold"), ["p", "q", "fold"]).count() == 46
    few = folds.chunk(pairs.where("p in ('e00', 'e20')"), 5)
    assert {r["fold"] for r in few.collect()} == {4}
    turned = folds.rotate(both, 5)
    assert turned.where("part = 'test' AND fold <> test_fold").count() == 0 and turned.count() == 5 * 46
    assert folds.pairs_per_entity(dealt, both).count() == 5
    y = folds.labelled(pairs, pairs, pairs.limit(0))
    assert {r["y"] for r in y.collect()} == {1}
    with pytest.raises(Exception, match="without one label"):
        folds.labelled(pairs, pairs, pairs).collect()


def test_features(spark):
    df = spark.createDataFrame([(0, "AAAA"), (1, "ACDE"), (2, "")], "i long, s string")
    phi = {(r["i"], r["pos"]): r["entropy_8"] for r in features.low_complexity(df, (8,)).collect()}
    assert phi[0, 0] == pytest.approx(0, abs=1e-7) and phi[1, 2] == pytest.approx(1.3862943, abs=1e-6)
    aa = spark.createDataFrame([("A", 1.0), ("C", 3.0)], "aa string, v double")
    got = {r["i"]: r["v"] for r in features.per_sequence(features.composition(df, aa, ["v"])).collect()}
    assert got == {0: 1.0, 1: 2.0}


def test_sources(spark, tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(content)
        return str(path)

    p = write("a.tsv", 'h1\th2\n\nhead\tx\nr1\t"a ""q"" b"\tsurplus\tmore\nr2\nr3\t\n')
    rows = [tuple(r) for r in files.delimited(spark, p, ["a", "b"], skip=2).collect()]
    assert rows == [("r1", 'a "q" b'), ("r2", None), ("r3", None)]
    assert files.delimited(spark, write("c.tsv", "!x\n!y\na\tb\n"), ["a", "b"], comment="!").count() == 1
    p = write("s.fa", ">one x\nMK\nA*\n\n>two\r\nCC\r\n>three\n")
    assert [tuple(r) for r in files.fasta(spark, p).collect()] == [("one x", "MKA"), ("two", "CC"), ("three", "")]
    p = write("x.clstr", ">Cluster 0\n0\t10aa, >a... *\n1\t9aa, >b... at 95.50%\n>Cluster 1\n0\t3aa, >c... *\n")
    assert [tuple(r) for r in files.clusters(spark, p).collect()] == [(0, "a", 1.0), (0, "b", 0.955), (1, "c", 1.0)]
    p = write("g.pcl", "id\tNAME\tGWEIGHT\tc1\tc2\nEWEIGHT\t\t\t1\t1\n1\tg\t1\t0.5\t2\n")
    assert [(r["gene"], r["x"]) for r in files.expression(spark, p).collect()] == [("g", [0.5, 2.0])]
    with pytest.raises(Exception, match="missing"):
        files.expression(spark, write("h.pcl", "id\tNAME\tG\tc1\nE\t\t\t1\n1\tg\t1\t\n")).collect()
    p = write("m.txt", "2 2\n1.0000 0.5000\n0.5000 1.0000\n")
    assert sorted((r["i"], r["row"]) for r in files.matrix(spark, p).collect())[0][1] in ([1.0, 0.5], [2.0, 2.0])
    for n, version in files.PSIMI_VERSIONS.items():
        df, found = files.psimi(spark, write(f"p{n}.txt", "\t".join("x" * n) + "\n" + "\t".join(["-"] * n) + "\n"))
        assert found == version and df.count() == 1 and len(df.columns) == n
    with pytest.raises(ValueError):
        files.psimi(spark, write("p3.txt", "a\tb\tc\n"))
    letters = "ARNDCQEGHILKMFPSTWYV"
    line = lambda n, r: f"{n:5d} {r}  " + "".join(f"{k:3d}" for k in range(20)) + " " + "".join(f"{100 if c == r else 0:4d}" for c in letters)
    p = write("x.pssm", "\n\n\n" + line(1, "A") + "\n" + line(2, "R") + "\n" + "\n" * 6)
    got = files.pssm(spark, p).collect()
    assert [(r["pos"], r["residue"]) for r in got] == [(1, "A"), (2, "R")] and got[0]["costs"][0] == pytest.approx(-np.log(0.8 + 0.2 * strings.BACKGROUND["A"]))
    p = write("aa.tsv", "aa\tx\nA\t1\nC\t3\n")
    assert {r["aa"]: r["x"] for r in files.amino_acids(spark, p).collect()} == {"A": 1, "C": 3, "?": 2}
    p = write("cyc.tsv", "ORF\tName\tComplex\nYA\tx\tc1\nYA\tx\tc1\n")
    assert [tuple(r) for r in files.complexes(spark, p).collect()] == [("c1", "YA")]
    p = write("ruled.txt", "____\n----\n____\n----\n____\n" + " " * 75 + f"{'YA; YB':20}{'P1':11}\n----\nx\n")
    assert [tuple(r) for r in files.ruled_table(spark, p, {"a": (75, 95), "b": (95, 106)}).collect()] == [("YA", "P1")]
    write("folds/f3.txt", "skip\na b\n")
    assert [tuple(r) for r in files.test_folds(spark, str(tmp_path / "folds/*")).collect()] == [(3, "a", "b")]
    write("ipr/p.tsv.txt", "\t".join(["q", "", "", "Pfam", "F1"] + [""] * 10) + "\n")
    hits, missing = files.per_entity(spark, spark.createDataFrame([("p",), ("z",)], "p string"), str(tmp_path / "ipr"))
    assert hits.count() == 1 and [r["p"] for r in missing.collect()] == ["z"]
    assert files.interpro(spark, str(tmp_path / "ipr/*"), sources=["SMART"]).count() == 0


def test_sinks(spark, tmp_path):
    k = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 2.0)], "i long, j long, k double")
    sinks.write_matrix_text(k, 2, str(tmp_path / "m"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()) == ["0.5000 2.0000", "1.0000 0.5000", "2 2"]
    sinks.write_matrix_binary(k, 2, str(tmp_path / "b.bin"))
    import struct

    assert (tmp_path / "b.bin").read_bytes() == struct.pack("<i3f", 2, 1.0, 0.5, 2.0)
    assert [r["value"] for r in sinks.fasta_records(spark.createDataFrame([("a", "MK"), (">b", "C")], "header string, sequence string")).collect()] == [">a\nMK", ">b\nC"]
    t = spark.createDataFrame([("urn:s", "iri", "urn:p", 'a"b\n', "literal", "string"), ("_:x1", "bnode", "urn:p", "5", "literal", "integer")], mapping.SCHEMA)
    assert {r["value"] for r in sinks.n_triples(t).collect()} == {'<urn:s> <urn:p> "a\\"b\\n" .', '_:bx1 <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .'}
    pairs = spark.createDataFrame([("a", "b", True, 0), ("b", "a", True, 1)], "p string, q string, state boolean, fold int")
    assert {r["value"] for r in sinks.interaction_labels(pairs).collect()} == {"BOUND(a-b)=1", "IN(a,b,a-b)=1", "BOUND(b-a)=1", "IN(b,a,b-a)=1"}
    graph = [r["value"] for r in sinks.network_graph(pairs).collect()]
    assert sum("<edge" in v for v in graph) == 1 and sum('<data key="fold">1' in v for v in graph) == 2
    terms = spark.createDataFrame([("A", "n", 0, "P0"), ("B", "n", 1, "P1"), ("C", "n", 1, "P2")], "id string, namespace string, level int, predicate string")
    edges = spark.createDataFrame([("B", "A", "is_a"), ("C", "A", "is_a"), ("C", "B", "part_of")], "child string, parent string, relation string")
    got = {r["value"] for r in sinks.rules(terms, edges).collect()}
    assert "P0(p) => (P1(p) OR P2(p))" in got and "P2(p) => (P0(p))" in got and len(got) == 5
    assert sinks.predicates(terms).count() == 5
    labels = {r["value"] for r in sinks.function_labels(terms, spark.createDataFrame([("B", "x")], "id string, p string")).collect()}
    assert labels == {"P0(x)=0", "P1(x)=1", "P2(x)=0"}
    assert sinks.datapoints(spark.createDataFrame([("a",)], "p string"), pairs).count() == 3


def test_functions(spark):
    row = spark.range(1).select(
        text.sanitize(F.lit("a b'(c)\"")).alias("a"), text.sanitize_all(F.lit("x|x||y z")).alias("b"), V.dssp_class(F.lit(" ")).alias("c"), text.strip_taxon(F.lit("1.a.b")).alias("d"), numeric.parsed_evalue(F.lit("n/a")).alias("e"),
        numeric.evalue_score(F.lit(0.0)).alias("f"), numeric.smoothed_cost(F.lit(0.0), F.lit(0.0)).alias("g"), text.cache_key(F.lit("a"), F.lit(1)).alias("h"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"], row["g"]) == ("a_b_SQUOTE__c__DQUOTE_", ["x", "y_z"], B + "dssp_coil", "a.b", -1.0, 1.0, 1e13)


def test_stages(spark, tmp_path):
    calls = []

    def base(c):
        calls.append("base")
        return spark.range(c["n"]), spark.range(1)

    stages = [Stage(base, (), ("a", "b")), Stage(lambda c, a: a.select((F.col("id") * 2).alias("id")), ("a",), ("double",)), Stage(lambda c: spark.range(1), (), ("x", "y"))]
    make = lambda n: Scheduler(spark, stages, str(tmp_path / "cache"), {"n": n})
    assert make(3).get("double").count() == 3 and make(3).run(["double", "b"])["b"].count() == 1 and calls == ["base"]
    assert make(4).get("double").count() == 4 and calls == ["base", "base"]
    assert make(4).get("a", force=True).count() == 4 and len(calls) == 3
    with pytest.raises(StageError):
        make(1).get("none")
    with pytest.raises(StageError):
        make(1).get("x")
    with pytest.raises(StageError):
        Scheduler(spark, [*stages, stages[0]], "")
    with pytest.raises(StageError):
        Scheduler(spark, [Stage(None, ("q",), ("p",)), Stage(None, ("p",), ("q",))], "").get("p")


def made_genes(spark):
    more = spark.range(40).withColumn("k", F.format_string("S%02d", F.col("id") + 10))
    sgd, feature = V.mint("sgd_id", F.col("k")), V.mint("sgd_feature", F.col("k"))
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: F.substr(F.lit("ACDEFGHIKLMNPQRSTVWY"), F.pmod(F.xxhash64("id", x), F.lit(20)).cast("int") + 1, F.lit(1))), "")
    e = V.mint("edge", F.col("k"))
    other = V.mint("sgd_feature", F.format_string("S%02d", F.pmod(F.col("id") + 1, F.lit(40)) + 10))
    note = V.mint("note", F.col("k"))
    rules = [
        mapping.iri(sgd, V.TYPE, V.own("sgd_id")), mapping.iri(sgd, V.own("sgd_id_has_type"), V.own("sgd_feature_type.ORF")), mapping.iri(sgd, V.own("sgd_id_has_qualifier"), V.own("sgd_id_qualifier.Verified")),
        mapping.iri(sgd, V.SAME_AS, feature), mapping.iri(feature, V.TYPE, V.own("sgd_feature")), mapping.literal(sgd, V.own("sgd_id_has_sequence"), letters),
        mapping.iri(sgd, V.own("sgd_id_in_chromosome"), V.mint("chromosome", (F.col("id") % 3).cast("string"))), mapping.literal(sgd, V.own("sgd_id_in_strand"), F.lit("W")), mapping.literal(sgd, V.own("sgd_id_starts_at"), F.col("id") * 100, "integer"), mapping.literal(sgd, V.own("sgd_id_stops_at"), F.col("id") * 100 + 50, "integer"),
        mapping.iri(e, V.TYPE, V.own("sgd_int")), mapping.iri(e, V.own("sgd_int_has_bait"), feature), mapping.iri(e, V.own("sgd_int_has_hit"), other), mapping.iri(e, V.own("sgd_int_has_type"), V.own("sgd_int_type.physical_interactions")), mapping.iri(e, V.own("sgd_int_has_cur_type"), V.own("sgd_int_cur_type.manually_curated")),
        mapping.iri(note, V.TYPE, V.own("sgd_go_annotation")), mapping.iri(note, V.own("sgd_go_annotation_has_sgd_id"), sgd), mapping.iri(note, V.own("sgd_go_annotation_has_term"), V.go_term(F.when(F.col("id") % 2 == 0, "E").otherwise("C"))), mapping.literal(note, V.own("sgd_go_annotation_has_ecode"), F.lit("IDA")),
    ]
    return mapping.to_triples(more, rules).cache()


def test_experiment(spark, tmp_path):
    t = made_genes(spark)
    terms, edges, _ = toy_ontology(spark)
    run = Scheduler(spark, experiment.stages(lambda: t, lambda: (terms, edges)), str(tmp_path / "cache"), {"num_folds": 4, "aspects": ["n"]})
    out = run.run(["entities", "high", "negative", "pair_folds", "entity_folds", "rules", "function_labels", "rotated", "datapoints"])
    assert out["entities"].count() == 40 and out["high"].count() == 80 and out["negative"].count() == 80
    assert out["negative"].join(out["high"], ["p", "q"]).count() == 0
    assert out["entity_folds"].count() == 40 and out["pair_folds"].count() == 160 and out["rotated"].count() == 640
    assert out["function_labels"].count() == 200 and out["rules"].count() > 5 and out["datapoints"].count() == 200
    found = {(r["what"], r["of"]): r["value"] for r in run.get("statistics").collect()}
    assert found["entities", ""] == 40 and found["pairs", "high"] == 80 and found["density", "high"] == pytest.approx(80 / (40 * 39))
    assert sum(v for (what, _), v in found.items() if what == "pairs by fold") == 160
    assert run.get("missing").count() == 0
    bare = t.where(F.col("p") != V.own("sgd_id_has_sequence"))
    with pytest.raises(StageError, match="no sequence"):
        Scheduler(spark, experiment.stages(lambda: bare, lambda: (terms, edges)), str(tmp_path / "other"), {}).get("ids")


def test_experiment_from_files(spark, tmp_path):
    """The command: data set, statistics, and the kernels out of a folder of tables."""
    t = made_genes(spark)
    TripleStore(spark, str(tmp_path / "store")).load(t)
    names = sorted(r["p"] for r in experiment.gene_ids(t).collect())
    tables = tmp_path / "tables"
    for folder in ("expression/one", "expression/two", "interpro", "pssm"):
        (tables / folder).mkdir(parents=True)
    r = np.random.default_rng(3)
    x = r.normal(size=(2, 40, 4))
    for k, name in enumerate(("one", "two")):
        (tables / f"expression/{name}/a.pcl").write_text("\n".join(["NAME\td\tGWEIGHT\ta\tb\tc\te", "EWEIGHT\t\t\t1\t1\t1\t1", *[f"{n}\tx\t1\t" + "\t".join(map(str, row)) for n, row in zip(names, x[k], strict=True)]]))
    (tables / "complexes.tab").write_text("ORF\tName\tComplex\n" + "".join(f"{n}\tx\tc{k % 5}\n" for k, n in enumerate(names)))
    for k, n in enumerate(names):
        (tables / f"interpro/{n}.tsv.txt").write_text("\t".join({3: "Pfam", 4: f"F{k % 4}", 8: "0.01"}.get(c, "x") for c in range(15)) + "\n")
        lines = [f"{at + 1:5d} A  " + "  0" * 20 + " " + "".join(f"{100 if c == (k + at) % 20 else 0:4d}" for c in range(20)) + "  0.50 0.10" for at in range(3)]
        (tables / f"pssm/{n}.pssm").write_text("\n".join(["", "title", "letters", *lines, *["tail"] * 6]) + "\n")
    (tmp_path / "terms.obo").write_text("format-version: 1.2\n\n[Term]\nid: R\nname: root\nnamespace: n\n\n[Term]\nid: E\nname: e\nnamespace: n\nis_a: R ! root\n\n[Term]\nid: C\nname: c\nnamespace: n\nis_a: R ! root\n")
    common = ["run-experiment", str(tmp_path / "store"), str(tmp_path / "terms.obo"), str(tmp_path / "out"), "--num-folds", "4"]
    assert main(common) == 0
    data = tmp_path / "out/data"
    lines = spark.read.text(str(data / "folds")).groupBy("test_fold", "part", "file").count().collect()
    assert {(r["test_fold"], r["part"], r["file"]) for r in lines} == {(k, p, f) for k in range(4) for p in ("test", "valid", "train") for f in ("interactions", "functions")}
    assert sum(r["count"] for r in lines if r["file"] == "interactions") == 4 * 2 * 160 and sum(r["count"] for r in lines if r["file"] == "functions") == 4 * 40 * 3
    assert spark.read.text(str(data / "predicates")).count() == 5 and spark.read.text(str(data / "datapoints")).count() == 200
    kinds = [*experiment.AVERAGED, "interpro_count_kernel", "average_kernel", "pair_kernel"]
    made = experiment.run(spark, lambda: t, str(tmp_path / "terms.obo"), str(tmp_path / "out"), str(tables), kinds, num_folds=4)
    matrices = {}
    for name in kinds[:-1]:
        m = np.zeros((40, 40))
        for c in made[name].collect():
            m[c["i"], c["j"]] = c["k"]
        matrices[name] = m
        assert np.allclose(m, m.T) and np.allclose(np.diag(m), 1)
    wanted = sum(np.corrcoef(x[k]) for k in range(2)) / 2
    assert np.allclose(matrices["expression_kernel"], wanted)
    assert np.allclose(matrices["interpro_kernel"], [[float(a % 4 == b % 4) for b in range(40)] for a in range(40)])
    assert np.allclose(matrices["average_kernel"], sum(matrices[n] for n in experiment.AVERAGED) / 5)
    assert made["pair_kernel"].where("i = j").count() == 80
    assert main([*common, "--tables", str(tables), "--targets", "order"]) == 0
    assert main(["clear", str(tmp_path / "store")]) == 0


def test_redundancy(spark):
    long = "ACDEFGHIKLMNPQRSTVWY" * 3
    df = spark.createDataFrame([("a", long + "AA"), ("b", long), ("c", "".join(reversed(long)) + "CC"), ("d", "AC")], "p string, seq string")
    assert sorted(r["p"] for r in experiment.redundancy_filter(df, 0.9).collect()) == ["a", "c", "d"]


def test_conversion_and_streams(spark, tmp_path):
    (tmp_path / "in" / "SIFTS").mkdir(parents=True)
    (tmp_path / "in" / "SIFTS" / "pdb_chain_uniprot.csv").write_text("1abc\tA\tP1\n")
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert mappings.convert(spark, root, "sifts", ["pdb-uniprot", "unknown"], out) == ["pdb-uniprot"]
    mappings.convert(spark, root, "sifts", None, out)
    assert spark.read.parquet(f"{out}/sifts-pdb-uniprot").count() == 1
    with pytest.raises(ValueError):
        mappings.convert(spark, root, "nothing", None, out)
    stream = streams.read_delimited(spark, f"{root}/SIFTS", mappings.CHAINS)
    rule = mapping.iri(V.pdb(F.col("PDB_ID"), F.col("PDB_CHAIN")), V.own("sifts_same_as"), V.uniprot(F.col("SP_ID")))
    streams.stream_triples(stream, [rule], f"{out}/stream", f"{out}/state").awaitTermination(60)
    assert spark.read.parquet(f"{out}/stream").count() == 1


def test_redundancy_equals_plain_version(spark):
    """Sequences that all share a part, some of them similar."""
    r = random.Random(4)
    common = "".join(r.choices("ACDEFGHIKL", k=30))
    rows = {}
    for k in range(25):
        own = "".join(r.choices("MNPQRSTVWY", k=r.randint(5, 80)))
        rows[f"p{k}"] = common + own
        if k % 3 == 0:
            rows[f"q{k}"] = common + own[: r.randint(1, len(own))] + "".join(r.choices("MNP", k=r.randint(0, 20)))
    for threshold in (0.5, 0.8):
        grams = {p: {s[i : i + 5] for i in range(len(s) - 4)} for p, s in rows.items()}
        kept = []
        for p in sorted(rows, key=lambda p: (-len(rows[p]), p)):
            if all(len(grams[p] & grams[q]) < threshold * min(len(grams[p]), len(grams[q])) for q in kept):
                kept.append(p)
        got = experiment.redundancy_filter(spark.createDataFrame([*rows.items()], "p string, seq string"), threshold)
        assert sorted(x["p"] for x in got.collect()) == sorted(kept) and 1 < len(kept) < len(rows)


def test_gold_pipeline(spark, tmp_path):
    """Kernels of a gold standard's proteins in the order of its files."""
    names = [f"Y{k}" for k in (3, 0, 2, 1, 4)]
    ready = tmp_path / "gold/ppi/ready"
    ready.mkdir(parents=True)
    (ready / "proteins.txt").write_text("".join(f"{n}\n" for n in names))
    positive, negative = [("Y0", "Y3"), ("Y2", "Y1")], [("Y4", "Y0"), ("Y1", "Y3")]
    (ready / "goldPosProteinPairs.txt").write_text("".join(f"{p} {q}\n" for p, q in positive))
    (ready / "goldNegProteinPairs.txt").write_text("".join(f"{p} {q}\n" for p, q in negative))
    (ready / "test0.txt").write_text("head\nY2 Y1\nY4 Y0\n")
    t = mapping.to_triples(spark.createDataFrame([(n,) for n in names], "n string"), [mapping.iri(V.mint("gold_protein", F.col("n")), V.TYPE, V.own("gold_protein"))])
    for pairs, verb in ((positive, "gold_interacts_with"), (negative, "gold_not_interacts_with")):
        t = t.unionByName(mapping.to_triples(spark.createDataFrame(pairs, "p string, q string"), [mapping.iri(V.mint("gold_protein", F.col("p")), V.own(verb), V.mint("gold_protein", F.col("q")))]))
    hits = spark.createDataFrame([(n, "Pfam", f"F{k % 2}", "0.1") for k, n in enumerate(names)], "p string, DB string, FAMILY string, EVALUE string")
    todo = experiment.gold_stages(spark, lambda: t, lambda name: hits, str(tmp_path / "gold"), ("interpro", "random"))
    out = Scheduler(spark, todo, str(tmp_path / "cache"), {}).run(["gold_y", "gold_interpro_kernel", "gold_average_pair_kernel", "gold_random_pair_kernel", "gold_test_indices"])
    assert {(r["i"], r["y"]) for r in out["gold_y"].collect()} == {(0, 1.0), (1, 1.0), (2, -1.0), (3, -1.0)}
    m = np.array([[float(a % 2 == b % 2) for b in range(5)] for a in range(5)])
    assert {(r["i"], r["j"]) for r in out["gold_interpro_kernel"].collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(m), strict=True)}
    at = [(names.index(p), names.index(q)) for p, q in positive + negative]
    wanted = np.array([[m[i, a] * m[j, b] + m[i, b] * m[j, a] for a, b in at] for i, j in at])
    got = np.zeros((4, 4))
    for r in out["gold_average_pair_kernel"].collect():
        got[r["i"], r["j"]] = r["k"]
    assert np.allclose(got, wanted)
    assert out["gold_random_pair_kernel"].where("i = j").count() == 4
    assert {(r["fold"], r["s"]) for r in out["gold_test_indices"].collect()} == {(0, 1), (0, 2)}


def test_settings(tmp_path):
    assert settings.settings([tmp_path / "none.ini"]) == settings.DEFAULTS
    (tmp_path / "a.ini").write_text("[store]\npath = /data/store\n[other]\nx = %y\n")
    found = settings.settings([tmp_path / "none.ini", tmp_path / "a.ini"])
    assert found["store"] == {"path": "/data/store", "default_graph": settings.DEFAULTS["store"]["default_graph"]} and found["other"] == {"x": "%y"}
    assert [p.name for p in settings.places({"HOME": str(tmp_path)})] == ["braidwork.ini"] * 2
