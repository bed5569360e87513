"""The data set pipeline: from triples of genes and interactions to networks, folds, rules and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import predicate_name
from ..lineage import materialize
from ..operators import folds, kernels, network, ontology, twins
from ..sources import files, sinks
from ..terms import local_name
from . import sparql
from .stages import Scheduler, Stage, StageError
from .statistics import Graph

Triples = DataFrame | Graph

# Evidence codes that are trusted; those assigned automatically are not among them.
EVIDENCE = ["EXP", "IDA", "IPI", "IMP", "IGI", "IEP", "ISS", "ISO", "ISA", "ISM", "IGC", "IBA", "IBD", "IKR", "IRD", "RCA", "TAS", "NAS", "IC", "ND"]

_ORF = "?{0} a bw:sgd_id ; bw:sgd_id_has_type bw:sgd_feature_type.ORF ; bw:sgd_id_has_qualifier bw:sgd_id_qualifier.Verified"


def _verified(name: str = "orf") -> str:
    return _ORF.format(name)


def gene_ids(triples: Triples) -> DataFrame:
    """(p): verified genes."""
    rows = sparql.run(triples, f"SELECT ?orf WHERE {{ {_verified()} . }}")
    return rows.select(local_name(F.col("orf")).alias("p")).distinct()


def gene_sequences(triples: Triples) -> DataFrame:
    rows = sparql.run(triples, f"SELECT ?orf ?seq WHERE {{ {_verified()} ; bw:sgd_id_has_sequence ?seq . }}", arity=2)
    return rows.select(local_name(F.col("orf")).alias("p"), "seq")


def gene_terms(triples: Triples) -> DataFrame:
    """(p, id) by trusted evidence."""
    text = f"""SELECT ?orf ?fun ?ecode WHERE {{ {_verified()} .
        ?note a bw:sgd_go_annotation ; bw:sgd_go_annotation_has_ecode ?ecode ; bw:sgd_go_annotation_has_sgd_id ?orf ; bw:sgd_go_annotation_has_term ?fun . }}"""
    rows = sparql.run(triples, text, arity=3).where(F.col("ecode").isin(*EVIDENCE))
    return rows.select(local_name(F.col("orf")).alias("p"), local_name(F.col("fun"), "#").alias("id")).distinct()


def gene_features(triples: Triples) -> DataFrame:
    """(p, feature): one a gene; more are an error."""
    rows = sparql.run(triples, f"SELECT ?orf ?feat WHERE {{ {_verified()} ; owl:sameAs ?feat . ?feat a bw:sgd_feature . }}", arity=2)
    one = F.when(F.count_distinct("feat") == 1, F.min("feat")).otherwise(F.raise_error(F.lit("a gene with several features")).cast("string"))
    grouped = rows.groupBy("orf").agg(one.alias("feat"))
    return grouped.select(local_name(F.col("orf")).alias("p"), local_name(F.col("feat")).alias("feature"))


def gene_contexts(triples: Triples) -> DataFrame:
    """(p, chrom, strand, start, stop)."""
    text = f"SELECT ?orf ?chrom ?strand ?start ?stop WHERE {{ {_verified()} . ?orf bw:sgd_id_in_chromosome ?chrom . ?orf bw:sgd_id_in_strand ?strand . ?orf bw:sgd_id_starts_at ?start . ?orf bw:sgd_id_stops_at ?stop . }}"
    rows = sparql.run(triples, text, types={"start": "long", "stop": "long"}, arity=5)
    return rows.select(local_name(F.col("orf")).alias("p"), local_name(F.col("chrom")).alias("chrom"), "strand", "start", "stop")


def physical_interactions(triples: Triples, manual_only: bool = False) -> DataFrame:
    """(p, q), symmetric."""
    manual = "; bw:sgd_int_has_cur_type bw:sgd_int_cur_type.manually_curated" if manual_only else ""
    text = f"""SELECT DISTINCT ?orf1 ?orf2 WHERE {{ {_verified("orf1")} ; owl:sameAs ?feat1 . {_verified("orf2")} ; owl:sameAs ?feat2 .
        ?feat1 a bw:sgd_feature . ?feat2 a bw:sgd_feature .
        ?int a bw:sgd_int ; bw:sgd_int_has_bait ?feat1 ; bw:sgd_int_has_hit ?feat2 {manual} ; bw:sgd_int_has_type bw:sgd_int_type.physical_interactions . }}"""
    rows = sparql.run(triples, text, arity=2)
    return network.symmetrize(rows.select(local_name(F.col("orf1")).alias("p"), local_name(F.col("orf2")).alias("q")))


def action_interactions(triples: Triples) -> DataFrame:
    """(p, q), symmetric: genes linked by any predicate between their entries."""
    text = f"""SELECT DISTINCT ?orf1 ?orf2 WHERE {{ {_verified("orf1")} . {_verified("orf2")} .
        ?id1 a bw:string_id ; owl:sameAs ?orf1 . ?id2 a bw:string_id ; owl:sameAs ?orf2 . ?id1 ?mode ?id2 . }}"""
    rows = sparql.run(triples, text, arity=2)
    return network.symmetrize(rows.select(local_name(F.col("orf1")).alias("p"), local_name(F.col("orf2")).alias("q")))


def gold_pairs(triples: Triples, kind: str, positive: bool) -> DataFrame:
    verb = "gold_interacts_with" if positive else "gold_not_interacts_with"
    rows = sparql.run(triples, f"SELECT ?x ?y WHERE {{ ?x a bw:gold_{kind} . ?y a bw:gold_{kind} . ?x bw:{verb} ?y . }}", arity=2)
    return rows.select(local_name(F.col("x")).alias("p"), local_name(F.col("y")).alias("q")).distinct()


def gold_sequences(triples: Triples) -> DataFrame:
    text = """SELECT ?p ?seq WHERE { ?p a bw:gold_protein ; owl:sameAs ?feat . ?feat a bw:sgd_feature .
        ?id a bw:sgd_id ; owl:sameAs ?feat ; bw:sgd_id_has_type bw:sgd_feature_type.ORF ; bw:sgd_id_has_sequence ?seq . }"""
    return sparql.run(triples, text, arity=2).select(local_name(F.col("p")).alias("p"), "seq")


def gold_contexts(triples: Triples) -> DataFrame:
    """(p, chrom, pos): the midpoint of the gene."""
    text = """SELECT ?p ?chrom ?strand ?start ?stop WHERE { ?p a bw:gold_protein ; owl:sameAs ?feat . ?feat a bw:sgd_feature . ?id a bw:sgd_id ; owl:sameAs ?feat .
        ?id bw:sgd_id_in_chromosome ?chrom . ?id bw:sgd_id_in_strand ?strand . ?id bw:sgd_id_starts_at ?start . ?id bw:sgd_id_stops_at ?stop . }"""
    from ..functions.numeric import midpoint

    rows = sparql.run(triples, text, types={"start": "long", "stop": "long"}, arity=5)
    return rows.select(local_name(F.col("p")).alias("p"), local_name(F.col("chrom")).alias("chrom"), midpoint(F.col("start"), F.col("stop")).alias("pos"))


def gold_positions(triples: Triples) -> DataFrame:
    """(domain, residue, start, stop, position, family): residues that lie inside a hit of their domain's family."""
    text = """SELECT ?d ?r ?start ?stop ?pos ?pfam WHERE {
        ?p a bw:gold_protein ; bw:gold_parent_of ?d ; owl:sameAs ?feat .
        ?d a bw:gold_domain ; bw:gold_parent_of ?r ; bw:gold_instance_of ?pfam .
        ?r a bw:gold_residue ; bw:gold_residue_has_position ?pos .
        ?feat a bw:sgd_feature ; bw:sgd_feature_has_ipr_hit ?hit .
        ?id a bw:sgd_id ; owl:sameAs ?feat ; bw:sgd_id_has_type bw:sgd_feature_type.ORF .
        ?hit a bw:sgd_ipr_hit ; bw:sgd_ipr_hit_is_true true ; bw:sgd_ipr_hit_has_method "Pfam" ; bw:sgd_ipr_hit_has_db_id ?pfam ;
            bw:sgd_ipr_hit_starts_at ?start ; bw:sgd_ipr_hit_stops_at ?stop .
        FILTER((?pos >= ?start) && (?pos <= ?stop)) }"""
    rows = sparql.run(triples, text, types={"start": "long", "stop": "long", "pos": "long"})
    return rows.select(local_name(F.col("d")).alias("domain"), local_name(F.col("r")).alias("residue"), "start", "stop", F.col("pos").alias("position"), local_name(F.col("pfam")).alias("family"))


def gold_labels(pairs: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(i, y) of ordered pairs (p, q, index): 1 or -1 as the graph has it; a pair with neither or both is an error."""
    rows = folds.labelled(pairs.select("p", "q"), positive, negative)
    return pairs.join(rows, ["p", "q"]).select(F.col("index").alias("i"), F.col("y").cast("double").alias("y"))


def gold_stages(spark: SparkSession, load_triples: Callable[[], Triples], load: Callable[[str], object], root: str, kinds: tuple[str, ...] = ("colocalization", "expression", "complex", "interpro", "interpro_score", "profile", "random")) -> list[Stage]:
    """Stages of a gold standard's proteins: orders, labels, a kernel and its pairwise kernel of each kind, their average
    (without the random one), and the indices of the test folds.

    ``root`` holds the gold standard's files, ``load`` is that of ``kernel_stages``. Kernels are of entities and pairs in
    the order of the files. Parameters: gamma (1), pssm_k (4), pssm_threshold (6), seed (0).
    """

    def orders(c):
        entities, pairs = files.gold_order(spark, root, "protein")
        at = entities.withColumnRenamed("id", "e")
        indexed = pairs.withColumnRenamed("index", "s").join(at.toDF("p", "i"), "p").join(at.toDF("q", "j"), "q")
        return entities.select(F.col("id").alias("p"), F.col("index").alias("i")), indexed.select("p", "q", "s", "i", "j", "positive")

    def labels(c, gold_pair_order):
        t = load_triples()
        return gold_labels(gold_pair_order.withColumnRenamed("s", "index"), gold_pairs(t, "protein", True), gold_pairs(t, "protein", False))

    def kernel(kind: str):
        def run(c, gold_order):
            n = gold_order.count()
            if kind == "colocalization":
                made = kernels.colocalization(gold_contexts(load_triples()).join(gold_order, "p").select("i", "chrom", "pos"), c.get("gamma", 1.0))
            elif kind == "expression":
                made = kernels.expression(gold_order.select("i", F.col("p").alias("gene")), load("expression"))
            elif kind == "complex":
                made = twins.diffusion(twins.cliques(load("complexes").join(gold_order, "p").select("i", "complex"), gold_order.select("i"))).cells()
            elif kind in ("interpro", "interpro_score"):
                made = kernels.interpro(gold_order.select("i", "p"), load("interpro"), "match" if kind == "interpro" else "evalue")
            elif kind == "profile":
                made = kernels.pssm(gold_order, load("pssm"), c.get("pssm_k", 4), c.get("pssm_threshold", 6.0))
            else:
                made = kernels.random_linear(gold_order.select("i"), seed=c.get("seed", 0))
            return kernels.prepared(made, n, normalized=True)

        return run

    def pairwise(kind: str):
        return lambda c, gold_pair_order, **one: kernels.pairwise(gold_pair_order.select("s", "i", "j"), one[f"gold_{kind}_kernel"])

    def average(c, **pair_kernels):
        return kernels.average(*pair_kernels.values())

    def test_indices(c, gold_pair_order):
        rows = files.test_folds(spark, f"{root}/ppi/ready/test*.txt")
        return rows.join(gold_pair_order, ["p", "q"]).select("fold", "s")

    averaged = tuple(f"gold_{k}_pair_kernel" for k in kinds if k != "random")
    return [
        Stage(orders, (), ("gold_order", "gold_pair_order"), sources=("gold",)),
        Stage(labels, ("gold_pair_order",), ("gold_y",), sources=("graph",)),
        *[Stage(kernel(k), ("gold_order",), (f"gold_{k}_kernel",), sources=() if k == "random" else ("graph",) if k == "colocalization" else ("tables",)) for k in kinds],
        *[Stage(pairwise(k), ("gold_pair_order", f"gold_{k}_kernel"), (f"gold_{k}_pair_kernel",)) for k in kinds],
        Stage(average, averaged, ("gold_average_pair_kernel",)),
        Stage(test_indices, ("gold_pair_order",), ("gold_test_indices",), sources=("gold",)),
    ]


def redundancy_filter(sequences: DataFrame, threshold: float = 0.6, k: int = 5) -> DataFrame:
    """(p): one member of each cluster of similar sequences, the longest (ties: the smallest name).

    Stands in for an external clustering tool, whose output ``sources.files.clusters`` reads as well. Similar are
    sequences that share at least ``threshold`` of the shorter one's different k-mers. Clusters are greedy by
    length: a sequence goes if a kept longer one is similar, which is settled in rounds.

    Of two similar sequences, the one with fewer k-mers shares one of its rarest with the other: as many as it may lack
    and one more. Only these are joined, so that a k-mer which all sequences have makes no pairs, and then counted in full.
    """
    grams = sequences.where(F.length("seq") >= k).select("p", F.length("seq").alias("n"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substr("seq", i, F.lit(k))))).alias("g"))
    sets = grams.groupBy("p").agg(F.collect_list("g").alias("set"), F.max("n").alias("n"))  # of one sequence each
    sets = materialize(sets.withColumn("size", F.size("set")))
    grams = sets.select("p", "size", F.explode("set").alias("g"))
    rarity = grams.groupBy("g").agg(F.count("*").alias("holders"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("holders", "g"))
    rare = grams.join(rarity, "g").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(threshold * F.col("size")) + 1)
    holder = grams.select(F.col("p").alias("q"), F.col("size").alias("size2"), "g")
    pairs = rare.select("p", "size", "g").join(holder, "g").where("p <> q AND size <= size2").select("p", "q").distinct()
    pairs = pairs.join(sets, "p").join(sets.toDF("q", "set2", "n2", "size2"), "q")
    pairs = pairs.where(F.size(F.array_intersect("set", "set2")) >= threshold * F.col("size"))
    # The longer one stands before the other; of equal ones, the one with the smaller name.
    first = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("q") < F.col("p")))
    edges = pairs.select(F.when(first, F.col("p")).otherwise(F.col("q")).alias("p"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("q"))
    edges = materialize(edges.distinct())
    left = materialize(sequences.select("p").distinct())
    kept = None
    while not left.isEmpty():
        ahead = edges.join(left.select(F.col("p").alias("q")), "q", "left_semi").join(left, "p", "left_semi")
        first = materialize(left.join(ahead, "p", "left_anti"))
        gone = edges.join(first.select(F.col("p").alias("q")), "q", "left_semi").select("p")
        kept = first if kept is None else materialize(kept.unionByName(first))
        left = materialize(left.join(first, "p", "left_anti").join(gone, "p", "left_anti"))
    return left if kept is None else kept


def incomplete(ids: DataFrame, sequences: DataFrame, features: DataFrame, annotations: DataFrame) -> DataFrame:
    """(check, p, fatal): genes without a sequence or a feature, which is fatal, and those without a term, which isn't."""
    out = None
    for check, table, fatal in (("no sequence", sequences, True), ("no feature", features, True), ("no term", annotations, False)):
        rows = ids.join(table.select("p"), "p", "left_anti").select(F.lit(check).alias("check"), "p", F.lit(fatal).alias("fatal"))
        out = rows if out is None else out.unionByName(rows)
    return out


def statistics(entities: DataFrame, terms: DataFrame, annotations: DataFrame, high: DataFrame, low: DataFrame, negative: DataFrame, entity_folds: DataFrame, pair_folds: DataFrame, k: int) -> DataFrame:
    """(what, of, value): numbers and densities of networks, terms by level, and how even the folds are."""
    out = entities.agg(F.count("*").cast("double").alias("value")).select(F.lit("entities").alias("what"), F.lit("").alias("of"), "value")

    def add(rows: DataFrame, what: str, of: str, column: str) -> None:
        nonlocal out
        out = out.unionByName(rows.select(F.lit(what).alias("what"), F.col(of).cast("string").alias("of"), F.col(column).cast("double").alias("value")))

    for name, pairs in (("high", high), ("low", low), ("negative", negative)):
        rows = network.density(pairs, entities).withColumn("name", F.lit(name))
        add(rows, "pairs", "name", "n_pairs")
        add(rows, "density", "name", "density")
    levels = ontology.level_statistics(terms, annotations)
    for column in ("n_terms", "n_bins", "n_annotations", "n_proteins"):
        add(levels, f"{column} by level", "level", column)
    add(entity_folds.groupBy("fold").agg(F.count("*").alias("n")), "entities by fold", "fold", "n")
    add(folds.imbalance(entity_folds, annotations.select("p", F.col("id").alias("feature")), k), "imbalance by fold", "fold", "unbalance")
    add(pair_folds.groupBy("fold").agg(F.count("*").alias("n")), "pairs by fold", "fold", "n")
    add(network.asymmetric(pair_folds).agg(F.count("*").alias("n")).withColumn("of", F.lit("")), "pairs without their mirror", "of", "n")
    add(folds.pairs_per_entity(entity_folds, pair_folds), "pairs an entity by fold", "fold", "pairs_per_entity")
    return out


#: The kernels of entities that the average is made of.
AVERAGED = ("colocalization_kernel", "expression_kernel", "complex_kernel", "interpro_kernel", "pssm_kernel")


def kernel_stages(load: Callable[[str], object]) -> list[Stage]:
    """Stages of kernels, for the entities by their ``index``; none of them is needed for the fold files.

    ``load`` gives the tables that triples don't hold: ``expression``, a list of (gene, x); ``complexes`` (complex, p);
    ``interpro`` (p, DB, FAMILY, EVALUE); ``pssm``, as ``sources.files.pssm`` reads it.
    Parameters besides: gamma (1), pssm_k (2), pssm_threshold (6).
    """

    def order(c, entities):
        return network.number(entities, "p").select("p", F.col("index").alias("i"))

    def pair_order(c, order, high, negative):
        pairs = network.canonical(high.unionByName(negative))
        named = pairs.withColumn("name", F.concat_ws("-", "p", "q"))
        numbered = named.join(network.number(named, "name"), "name").select(F.col("index").alias("s"), "p", "q")
        return numbered.join(order.toDF("p", "i"), "p").join(order.toDF("q", "j"), "q").select("s", "i", "j")

    def made(make: Callable[..., DataFrame], fixed: bool = False) -> Callable[..., DataFrame]:
        def run(c, order, **tables):
            n = order.count()
            return kernels.prepared(make(c, order, n, **tables), n, normalized=True, fixed=fixed)

        return run

    def colocalization(c, order, n, contexts):
        rows = contexts.join(order, "p").select("i", "chrom", ((F.col("start") + F.col("stop")) / 2).alias("pos"))
        return kernels.colocalization(rows, c.get("gamma", 1.0))

    def expression(c, order, n, features):
        genes = order.join(features, "p").select("i", F.col("feature").alias("gene"))
        return kernels.expression(genes, load("expression"))

    def complexes(c, order, n, features):
        members = load("complexes").join(features.select("p", "feature").withColumnsRenamed({"p": "q", "feature": "p"}), "p").select("complex", F.col("q").alias("p")).join(order, "p")
        return twins.diffusion(twins.cliques(members.select("i", "complex"), order.select("i"))).cells()

    def domains(mode):
        return lambda c, order, n: kernels.interpro(order.select("i", "p"), load("interpro"), mode)

    def scoring(c, order, n):
        return kernels.pssm(order, load("pssm"), c.get("pssm_k", 2), c.get("pssm_threshold", 6.0))

    def average(c, **all_kernels):
        return kernels.average(*all_kernels.values())

    def pair_kernel(c, pair_order, average_kernel):
        return kernels.pairwise(pair_order, average_kernel)

    return [
        Stage(order, ("entities",), ("order",)),
        Stage(pair_order, ("order", "high", "negative"), ("pair_order",)),
        Stage(made(colocalization), ("order", "contexts"), ("colocalization_kernel",)),
        Stage(made(expression), ("order", "features"), ("expression_kernel",), sources=("tables",)),
        Stage(made(complexes, fixed=True), ("order", "features"), ("complex_kernel",), sources=("tables",)),
        Stage(made(domains("match")), ("order",), ("interpro_kernel",), sources=("tables",)),
        Stage(made(domains("count")), ("order",), ("interpro_count_kernel",), sources=("tables",)),
        Stage(made(scoring), ("order",), ("pssm_kernel",), sources=("tables",)),
        Stage(average, AVERAGED, ("average_kernel",)),
        Stage(pair_kernel, ("pair_order", "average_kernel"), ("pair_kernel",)),
    ]


def stages(load_triples: Callable[[], Triples], load_ontology: Callable[[], tuple[DataFrame, DataFrame]]) -> list[Stage]:
    """Stages from a triple table and an ontology to fold files' rows and statistics; see ``kernel_stages`` for more.

    Parameters of the context: min_sequence_len (50), redundancy (0.6), aspects, max_depth, min_annot, num_folds (10), seed (0).
    """

    def resources(c):
        t = load_triples()
        ids, sequences, terms, features = gene_ids(t), gene_sequences(t), gene_terms(t), gene_features(t)
        missing = incomplete(ids, sequences, features, terms)
        if fatal := missing.where("fatal").limit(5).collect():
            raise StageError("genes lack what all need: " + ", ".join(f"{r['p']} ({r['check']})" for r in fatal))
        return ids, sequences, terms, features, gene_contexts(t), physical_interactions(t, True), physical_interactions(t), action_interactions(t), missing

    def entities(c, ids, sequences):
        kept = sequences.join(ids, "p", "left_semi").where(F.length("seq") >= c.get("min_sequence_len", 50))
        return redundancy_filter(kept, c.get("redundancy", 0.6))

    def annotated(c, entities, annotations):
        terms, edges = load_ontology()
        known, _ = ontology.annotate(terms, annotations.join(entities, "p", "left_semi"))
        return ontology.prune(terms, edges, ontology.propagate(known, edges), c.get("aspects"), c.get("max_depth"), c.get("min_annot"))

    def networks(c, entities, manual, physical, actions):
        high, low = network.restrict(manual, entities), network.restrict(physical.unionByName(actions).distinct(), entities)
        negative = network.sample_negatives(entities, low.unionByName(high), high.count(), c.get("seed", 0))
        return high, low, negative

    def deal(c, entities, term_annotations, high, negative):
        k, seed = c.get("num_folds", 10), c.get("seed", 0)
        dealt = folds.balanced_folds(entities, term_annotations.select("p", F.col("id").alias("feature")), k, seed)
        return dealt, folds.pair_folds(high, negative, k, seed)

    def numbers(c, entities, terms, term_annotations, high, low, negative, entity_folds, pair_folds):
        return statistics(entities, terms, term_annotations, high, low, negative, entity_folds, pair_folds, c.get("num_folds", 10))

    def output(c, entities, terms, term_edges, term_annotations, entity_folds, pair_folds):
        named = terms.withColumn("predicate", predicate_name(F.col("namespace"), F.col("level"), F.col("id"), F.col("name")))
        k = c.get("num_folds", 10)
        labels = sinks.closed_world(terms, term_annotations).join(named.select("id", "predicate"), "id").join(entity_folds, "p")
        return (
            sinks.datapoints(entities, pair_folds.select("p", "q")),
            sinks.predicates(named),
            sinks.rules(named, term_edges),
            sinks.function_labels(named, term_annotations),
            folds.rotate(pair_folds, k),
            folds.rotate(labels.select("p", "predicate", "label", "fold"), k),
        )

    return [
        Stage(resources, (), ("ids", "sequences", "annotations", "features", "contexts", "manual", "physical", "actions", "missing"), sources=("graph",)),
        Stage(entities, ("ids", "sequences"), ("entities",)),
        Stage(annotated, ("entities", "annotations"), ("terms", "term_edges", "term_annotations"), sources=("ontology",)),
        Stage(networks, ("entities", "manual", "physical", "actions"), ("high", "low", "negative")),
        Stage(deal, ("entities", "term_annotations", "high", "negative"), ("entity_folds", "pair_folds")),
        Stage(numbers, ("entities", "terms", "term_annotations", "high", "low", "negative", "entity_folds", "pair_folds"), ("statistics",)),
        Stage(output, ("entities", "terms", "term_edges", "term_annotations", "entity_folds", "pair_folds"), ("datapoints", "predicates", "rules", "function_labels", "rotated", "rotated_labels")),
    ]


def loader(spark: SparkSession, root: str, entities: DataFrame | None = None) -> Callable[[str], object]:
    """The tables of ``kernel_stages`` from a folder: ``expression/EXPERIMENT/*.pcl``, ``complexes.tab``, ``interpro/P.tsv.txt`` and ``pssm/P.pssm``."""

    def load(name: str):
        if name == "expression":
            return [*files.expression_folder(spark, f"{root}/expression").values()]
        if name == "complexes":
            return files.complexes(spark, f"{root}/complexes.tab")
        if name == "interpro":
            found = files.listing(spark, f"{root}/interpro/*.tsv.txt").select(F.regexp_replace("name", r"\.tsv\.txt$", "").alias("p"))
            return files.per_entity(spark, found if entities is None else entities, f"{root}/interpro")[0]
        return files.pssm(spark, f"{root}/pssm/*.pssm")

    return load


def run(spark: SparkSession, load_triples: Callable[[], Triples], ontology_path: str, destination: str, root: str | None = None, targets: list[str] | None = None, force: bool = False, **context) -> dict[str, DataFrame]:
    """Runs the data-set pipeline, writes the learner's files, and gives the targets asked for (the statistics by default).

    What was made before is read again if the triples, the ontology and the tables are still the same: a ``Graph`` says so by
    its version, a plain table by its rows, files by names, sizes and times.
    """
    triples = load_triples()
    sources = {"graph": triples.version if isinstance(triples, Graph) and triples.version else files.content_fingerprint(triples.triples if isinstance(triples, Graph) else triples), "ontology": files.fingerprint(spark, ontology_path)}
    todo = stages(lambda: triples, lambda: files.obo(spark, ontology_path))
    if root is not None:
        sources["tables"] = files.fingerprint(spark, root)
        todo += kernel_stages(loader(spark, root))
    scheduler = Scheduler(spark, todo, f"{destination}/cache", context, sources)
    made = scheduler.run([*(targets or ["statistics"])], force)
    if targets is None:
        out = scheduler.run(["datapoints", "predicates", "rules", "rotated", "rotated_labels"])
        sinks.write_data_set(f"{destination}/data", out["datapoints"], out["predicates"], out["rules"], out["rotated"], out["rotated_labels"])
    return made
