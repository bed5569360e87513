"""Mappings of the source tables to triples: one function a table, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as V
from ..functions import text as X
from ..functions.numeric import parsed_evalue
from ..sources import files
from .mapping import Rule, blank, iri, literal, to_triples

# The columns of the source tables, in their order. The names of classes and properties below
# (``sgd_...``, ``ipfam_...``, ``string_...``, ``gold_...``, ``pdb_...``) are vocabulary, fixed as well.
FEATURES = ["SGD_ID", "FEAT_TYPE", "FEAT_QUALIFIER", "FEAT_NAME", "STD_GENE_NAME", "ALIASES", "PARENT_FEAT_NAME", "OTHER_SGD_IDS", "CHROMOSOME", "START_COORD", "STOP_COORD", "STRAND", "GENETIC_POS", "COORD_VERSION", "SEQ_VERSION", "DESCRIPTION"]
XREFS = ["XREF_ID", "XREF_ID_SOURCE", "XREF_ID_TYPE", "FEAT_NAME", "SGD_ID", "UNDOCUMENTED"]
DOMAINS = ["FEAT_NAME", "CRC64", "LENGTH", "METHOD", "DB_MEMBERS", "DB_DESCRIPTION", "START", "STOP", "EVALUE", "STATUS", "DATE", "IPR_ID", "IPR_DESCRIPTION", "IPR_GO"]
SLIM = ["GENE_ORF", "GENE_STD", "SGD_ID", "GO_ASPECT", "GO_TERM", "GO_ID", "FEATURE_TYPE"]
ASSOCIATIONS = ["DB", "SGD_ID", "DONTCARE_ID", "QUALIFIERS", "GO_ID", "DB_REFS", "ECODE", "WITH_FROM", "GO_ASPECT", "DB_NAMES", "DB_SYNONYMS", "DB_TYPES", "TAXIDS", "DATE", "ASSIGNED_BY", "EXTENSION", "VARIANTS"]
HOMOLOGS = ["FEAT_NAME", "START_COORD_QUERY", "STOP_COORD_QUERY", "START_COORD_TARGET", "STOP_COORD_TARGET", "PERCENT_ALIGNED", "SCORE", "TARGET_PDB_ID", "TARGET_TAXON_ID", "TARGET_TAXON_NAME"]
INTERACTIONS = ["BAIT_FEAT_NAME", "BAIT_STD_NAME", "HIT_FEAT_NAME", "HIT_STD_NAME", "EXPERIMENT_TYPE", "INTERACTION_TYPE", "SOURCE_DATABASE", "CURATION_TYPE", "NOTES", "PHENOTYPE", "REFERENCE", "CITATION"]
PDB_ENTRIES = ["PDB_ID", "HEADER", "TITLE", "DATE", "RESOLUTION", "EXP_METHOD", "AUTHOR", "PDB_FILE", "SIFTS_FILE"]
FAMILIES = ["FAMILY_INT", "FAMILY_ACC", "FAMILY_ID", "DESCRIPTION", "COMMENT", "FAMILY_TYPE", "SOURCE_DB", "COLOUR", "NUMBER_FAM_INT", "NUMBER_LIG_INT", "NUMBER_PDBS"]
REGIONS = ["REGION", "PROT_FAM", "PROT_FAM_ACC", "PDB_ID", "CHAIN", "START", "START_ICODE", "END", "END_ICODE", "REGION_SOURCE_DB"]
REGION_INTERACTIONS = ["REGION_INT", "PDB_ID", "REGION_A", "REGION_B", "IS_INTRACHAIN", "QUALITY_CONTROL"]
ALIASES = ["TAXON", "STRING_ID", "ALIAS_ID", "ALIAS_TYPE"]
ACTIONS = ["ITEM_ID_A", "ITEM_ID_B", "MODE", "ACTION", "A_IS_ACTING", "SCORE", "SOURCES", "TRANSFERRED_SOURCES"]
GROUPS = ["TAXON.STRING_ID", "START", "STOP", "CLUSTER_ID", "ANNOTATION"]
ANNOTATIONS = ["ID", "SEQUENCE", "GO", "TAXID", "EVIDENCE"]
CHAINS = ["PDB_ID", "PDB_CHAIN", "SP_ID", "RES_BEGIN", "RES_END", "PDB_BEGIN", "PDB_END", "SP_BEGIN", "SP_END"]


def is_a(s: Column, kind: str, **more) -> Rule:
    return iri(s, V.TYPE, V.own(kind), **more)


def _sgd(column: str = "SGD_ID") -> Column:
    return V.mint("sgd_id", X.sanitize(F.col(column)))


def _feature(column: str) -> Column:
    return V.mint("sgd_feature", X.sanitize(F.col(column)))


def _typed(kind: str, value: Column, when: Column | None = None) -> Rule:
    return is_a(value, kind, when=when)


def sgd_features(df: DataFrame) -> DataFrame:
    sgd, feature, kind = _sgd(), _feature("FEAT_NAME"), V.mint("sgd_feature_type", X.sanitize(F.col("FEAT_TYPE")))
    parent, chromosome = _feature("PARENT_FEAT_NAME"), V.mint("sgd_feature", F.concat(F.lit("chromosome_"), "CHROMOSOME"))
    qualifiers = F.transform(X.sanitize_all(F.col("FEAT_QUALIFIER")), lambda q: V.mint("sgd_id_qualifier", q))
    others = F.transform(X.sanitize_all(F.col("OTHER_SGD_IDS")), lambda a: V.mint("sgd_id", a))
    rules = [
        is_a(sgd, "sgd_id"),
        is_a(feature, "sgd_feature"),
        iri(sgd, V.SAME_AS, feature),
        iri(sgd, V.own("sgd_id_has_type"), kind),
        _typed("sgd_feature_type", kind),
        iri(sgd, V.own("sgd_id_has_qualifier"), qualifiers, each=True),
        iri(sgd, V.SAME_AS, others, each=True),
        is_a(parent, "sgd_feature"),
        iri(sgd, V.PART_OF, parent),
        _typed("sgd_chromosome", chromosome),
        iri(sgd, V.own("sgd_id_in_chromosome"), chromosome),
        literal(sgd, V.own("sgd_id_in_strand"), F.col("STRAND")),
        literal(sgd, V.own("sgd_id_starts_at"), F.col("START_COORD").cast("long"), "integer"),
        literal(sgd, V.own("sgd_id_stops_at"), F.col("STOP_COORD").cast("long"), "integer"),
    ]
    # Qualifiers are individuals too: their type triples come from a second, tiny relation of the same scan.
    types = df.select(F.explode(qualifiers).alias("q")).distinct()
    return to_triples(df, rules).unionByName(to_triples(types, [is_a(F.col("q"), "sgd_id_qualifier")]))


def sgd_xrefs(df: DataFrame) -> DataFrame:
    wanted = (F.col("XREF_ID_SOURCE") == "EBI") & F.col("XREF_ID_TYPE").isin("UniProt/TrEMBL ID", "UniProt/Swiss-Prot ID")
    return to_triples(df.where(wanted), [iri(_sgd(), V.own("sgd_id_has_xref"), V.uniprot(F.col("XREF_ID")))])


def sgd_sequences(df: DataFrame) -> DataFrame:
    """(header, sequence); a header without exactly one ``SGDID:`` word is an error."""
    ids = F.filter(F.split("header", r"\s+"), lambda w: F.startswith(w, F.lit("SGDID:")))
    one = F.when(F.size(ids) == 1, F.regexp_replace(F.get(F.split(F.get(ids, F.lit(0)), ":"), F.lit(1)), r"^,+|,+$", "")).otherwise(F.raise_error(F.concat(F.lit("no single SGDID: "), "header")).cast("string"))
    rows = df.select(V.mint("sgd_id", X.sanitize(one)).alias("id"), "sequence")
    return to_triples(rows, [literal(F.col("id"), V.own("sgd_id_has_sequence"), F.col("sequence"))])


def sgd_domains(df: DataFrame) -> DataFrame:
    """Hits without a Pfam family have no database id."""
    hit = blank(*DOMAINS, salt="domain")
    known = F.when(F.col("STATUS") == "T", "true").when(F.col("STATUS") == "?", "false").otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("STATUS", F.lit("null")))).cast("string"))
    rows = df.withColumn("hit", hit)
    h = F.col("hit")
    rules = [
        is_a(h, "sgd_ipr_hit", s_kind="bnode"),
        literal(h, V.own("sgd_ipr_hit_has_id"), F.coalesce("IPR_ID", F.lit("")), s_kind="bnode"),
        literal(h, V.own("sgd_ipr_hit_has_method"), F.col("METHOD"), s_kind="bnode"),
        iri(h, V.own("sgd_ipr_hit_has_db_id"), V.mint("pfam_id", F.col("DB_MEMBERS")), when=(F.col("METHOD") == "Pfam") & (F.col("STATUS") == "T"), s_kind="bnode"),
        literal(h, V.own("sgd_ipr_hit_starts_at"), F.col("START").cast("long"), "integer", s_kind="bnode"),
        literal(h, V.own("sgd_ipr_hit_stops_at"), F.col("STOP").cast("long"), "integer", s_kind="bnode"),
        literal(h, V.own("sgd_ipr_hit_has_evalue"), parsed_evalue(F.col("EVALUE")), "double", s_kind="bnode"),
        literal(h, V.own("sgd_ipr_hit_is_true"), known, "boolean", s_kind="bnode"),
        iri(_feature("FEAT_NAME"), V.own("sgd_feature_has_ipr_hit"), h, kind="bnode"),
    ]
    return to_triples(rows, rules)


def sgd_slim(df: DataFrame) -> DataFrame:
    rows = df.where(~F.col("GO_TERM").isin("other", "not_yet_annotated"))
    return to_triples(rows, [iri(_sgd(), V.own("sgd_id_has_goslim"), V.go_term(X.sanitize(F.col("GO_ID"))))])


def sgd_associations(df: DataFrame, drop_negated: bool = False) -> DataFrame:
    """Qualifiers, NOT among them, are ignored unless ``drop_negated``."""
    rows = df.where(~F.contains(F.coalesce("QUALIFIERS", F.lit("")), F.lit("NOT"))) if drop_negated else df
    rows = rows.withColumn("note", blank(*ASSOCIATIONS, salt="association"))
    a = F.col("note")
    rules = [
        is_a(a, "sgd_go_annotation", s_kind="bnode"),
        iri(a, V.own("sgd_go_annotation_has_sgd_id"), _sgd(), s_kind="bnode"),
        iri(a, V.own("sgd_go_annotation_has_term"), V.go_term(X.sanitize(F.col("GO_ID"))), s_kind="bnode"),
        literal(a, V.own("sgd_go_annotation_has_ecode"), F.col("ECODE"), s_kind="bnode"),
    ]
    return to_triples(rows, rules)


def sgd_homologs(df: DataFrame) -> DataFrame:
    rows = df.withColumn("match", blank(*HOMOLOGS, salt="homolog")).withColumn("target", X.pdb_chain(F.col("TARGET_PDB_ID")))
    m = F.col("match")
    target = F.when(F.col("target.chain").isNull(), V.pdb(F.col("target.id"))).otherwise(V.pdb(F.col("target.id"), F.col("target.chain")))
    rules = [
        is_a(m, "sgd_pdb_homology", s_kind="bnode"),
        iri(m, V.own("sgd_pdb_has_query"), V.mint("sgd_feature", F.col("FEAT_NAME")), s_kind="bnode"),
        literal(m, V.own("sgd_pdb_alignment"), F.col("PERCENT_ALIGNED").cast("double") / 100, "double", s_kind="bnode"),
        iri(m, V.own("sgd_pdb_has_target"), target, s_kind="bnode"),
    ]
    return to_triples(rows, rules)


def sgd_interactions(df: DataFrame) -> DataFrame:
    rows = df.withColumn("int", blank(*INTERACTIONS, salt="interaction"))
    rules = [is_a(F.col("int"), "sgd_int", s_kind="bnode")]
    rules += [iri(F.col("int"), V.own(f"sgd_int_has_{end}"), _feature(f"{end.upper()}_FEAT_NAME"), s_kind="bnode") for end in ("bait", "hit")]
    for predicate, kind, column in (("type", "sgd_int_type", "INTERACTION_TYPE"), ("exp_type", "sgd_int_exp_type", "EXPERIMENT_TYPE"), ("cur_type", "sgd_int_cur_type", "CURATION_TYPE"), ("source", "sgd_int_source", "SOURCE_DATABASE")):
        value = V.mint(kind, X.sanitize(F.col(column)))
        rules += [iri(F.col("int"), V.own(f"sgd_int_has_{predicate}"), value, s_kind="bnode"), _typed(kind, value)]
    return to_triples(rows, rules)


def ipfam_entries(df: DataFrame) -> DataFrame:
    entry = V.pdb(F.col("PDB_ID"))
    rules = [
        iri(entry, V.TYPE, V.expand("pdbo:PDBID")),
        literal(entry, V.own("pdb_has_resolution"), F.col("RESOLUTION").cast("double"), "double"),
        literal(entry, V.own("pdb_has_exp_method"), X.sanitize(F.col("EXP_METHOD"))),
    ]
    return to_triples(df, rules)


def ipfam_families(df: DataFrame) -> DataFrame:
    family, kind = V.mint("pfam_id", F.col("FAMILY_ACC")), V.mint("pfam_type", F.col("FAMILY_TYPE"))
    typed = ~X.absent(F.col("FAMILY_TYPE"))
    rules = [is_a(family, "pfam_id"), iri(family, V.own("pfam_id_has_type"), kind, when=typed), _typed("pfam_type", kind, typed)]
    return to_triples(df.where(F.col("SOURCE_DB") == "pfama"), rules)


def ipfam_interactions(homo: DataFrame, hetero: DataFrame) -> DataFrame:
    """(FAM, ID, INT_TYPE) and (FAM1, ID1, FAM2, ID2, INT_TYPE): a homo row is a family with itself."""
    rows = homo.select(F.col("FAM").alias("a"), F.col("FAM").alias("b"), "INT_TYPE").unionByName(hetero.select(F.col("FAM1").alias("a"), F.col("FAM2").alias("b"), "INT_TYPE"))
    rows = rows.withColumn("int", blank("a", "b", "INT_TYPE", salt="family"))
    kind = V.mint("ipfam_int_type", F.col("INT_TYPE"))
    rules = [is_a(F.col("int"), "ipfam_int", s_kind="bnode"), iri(F.col("int"), V.own("ipfam_int_has_int_type"), kind, s_kind="bnode"), _typed("ipfam_int_type", kind)]
    rules += [iri(F.col("int"), V.own("ipfam_int_has_pfam"), V.mint("pfam_id", F.col(c)), s_kind="bnode") for c in ("a", "b")]
    return to_triples(rows, rules)


def ipfam_regions(df: DataFrame) -> DataFrame:
    region = V.mint("ipfam_region", F.col("REGION"))
    rules = [
        is_a(region, "ipfam_region"),
        iri(region, V.own("ipfam_region_instance_of"), V.mint("pfam_id", F.col("PROT_FAM_ACC"))),
        iri(region, V.own("ipfam_region_occurs_in"), V.pdb(F.col("PDB_ID"), F.col("CHAIN"))),
        literal(region, V.own("ipfam_region_starts_at"), F.col("START").cast("long"), "integer"),
        literal(region, V.own("ipfam_region_stops_at"), F.col("END").cast("long"), "integer"),
    ]
    return to_triples(df, rules)


def ipfam_region_interactions(df: DataFrame) -> DataFrame:
    s = V.mint("ipfam_region_int", F.col("REGION_INT"))
    rules = [is_a(s, "ipfam_region_int"), iri(s, V.own("ipfam_region_int_occurs_in"), V.pdb(F.col("PDB_ID")))]
    return to_triples(df, rules + [iri(s, V.own("ipfam_region_int_has_region"), V.mint("ipfam_region", F.col(c))) for c in ("REGION_A", "REGION_B")])


# The mapped fields of PSI-MI TAB and the properties they become.
PSIMI_LISTS = {
    "ID_INTERACTOR_A": "MI_has_interactor_a", "ID_INTERACTOR_B": "MI_has_interactor_b", "INTERACTION_DETECTION_METHOD": "MI_has_detection_method",
    "TAXID_INTERACTOR_A": "has_taxid_interactor_a", "TAXID_INTERACTOR_B": "has_taxid_interactor_b", "INTERACTION_TYPES": "MI_has_type",
    "SOURCE_DATABASE": "MI_has_source_db", "INTERACTION_IDENTIFIERS": "MI_has_identifier", "TAXID_HOST": "has_taxid_host",
}
PSIMI_UNIQUE = ("ID_INTERACTOR_A", "ID_INTERACTOR_B")


def psimi(df: DataFrame) -> DataFrame:
    """Any version of PSI-MI TAB: fields that the table lacks are skipped. Two ids for one interactor are an error."""
    obo = V.PREFIXES["obo"]
    rows = df.withColumn("int", blank(*df.columns, salt="psimi"))
    rules = [iri(F.col("int"), V.TYPE, obo + "MI_0000", s_kind="bnode")]
    for column, name in PSIMI_LISTS.items():
        if column not in df.columns:
            continue
        parts = X.psimi_parts(F.col(column))
        if column in PSIMI_UNIQUE:
            parts = F.when(F.size(parts) <= 1, parts).otherwise(F.raise_error(F.concat(F.lit("several ids: "), F.col(column))).cast("array<string>"))
        rules.append(Rule(F.col("int"), obo + name, F.transform(parts, X.psimi_term), kind="mixed", each=True, s_kind="bnode"))
    if "CONFIDENCE_VALUES" in df.columns:
        rules.append(literal(F.col("int"), obo + "MI_has_confidence", X.psimi_confidence(F.col("CONFIDENCE_VALUES")), each=True, s_kind="bnode"))
    if "IS_NEGATIVE" in df.columns:
        rules.append(literal(F.col("int"), obo + "is_negative", X.psimi_bool(F.col("IS_NEGATIVE")), "boolean", s_kind="bnode"))
    return to_triples(rows, rules)


def string_aliases(df: DataFrame) -> DataFrame:
    s = V.mint("string_id", F.col("STRING_ID"))
    same = F.array_contains(F.split("ALIAS_TYPE", r"\s+"), "SGD") & F.regexp_like("ALIAS_ID", F.lit("^[SL]0"))
    return to_triples(df, [is_a(s, "string_id"), iri(s, V.SAME_AS, V.mint("sgd_id", F.col("ALIAS_ID")), when=same)])


def string_actions(df: DataFrame, taxon: str = "4932") -> DataFrame:
    """The predicate is the row's mode. Ids are told to be of the taxon by how they start."""
    own = F.startswith("ITEM_ID_A", F.lit(taxon)) & F.startswith("ITEM_ID_B", F.lit(taxon))
    a, b = (V.mint("string_id", X.strip_taxon(F.col(c))) for c in ("ITEM_ID_A", "ITEM_ID_B"))
    return to_triples(df.where(own), [iri(a, V.mint("string_action_mode", F.col("MODE")), b)])


def string_groups(df: DataFrame, taxon: str = "4932") -> DataFrame:
    rows = df.withColumn("id", F.col("`TAXON.STRING_ID`")).where(F.substring_index("id", ".", 1) == taxon)
    s, cluster = V.mint("string_id", X.strip_taxon(F.col("id"))), V.mint("cog_cluster_id", F.col("CLUSTER_ID"))
    rules: list[Rule] = []
    for kind in ("COG", "KOG", "NOG"):
        own = F.startswith("CLUSTER_ID", F.lit(kind))
        rules += [iri(s, V.own(f"string_id_in_{kind.lower()}"), cluster, when=own), is_a(cluster, "cog_cluster_id", when=own)]
    return to_triples(rows, rules)


def gold_standard(tables: dict[str, DataFrame], expected_pairs: int | None = None) -> DataFrame:
    """Triples of the tables that ``sources.files.gold`` reads: entities, parents and both kinds of pairs."""
    if expected_pairs is not None and (n := tables["protein_positive"].count()) != expected_pairs:
        raise ValueError(f"{n} positive protein pairs, not {expected_pairs}")
    out = to_triples(tables["proteins"], [is_a(V.mint("gold_protein", F.col("id")), "gold_protein"), iri(V.mint("gold_protein", F.col("id")), V.SAME_AS, V.mint("sgd_feature", F.col("id")))])
    d, r = F.col("id"), F.col("id")
    above = F.regexp_replace("id", "_[^_]*$", "")
    domain, residue = V.mint("gold_domain", d), V.mint("gold_residue", r)
    out = out.unionByName(to_triples(tables["domains"], [is_a(domain, "gold_domain"), iri(domain, V.own("gold_instance_of"), V.mint("pfam_id", F.substring_index("id", "_", -1))), iri(V.mint("gold_protein", above), V.own("gold_parent_of"), domain)]))
    out = out.unionByName(to_triples(tables["residues"], [is_a(residue, "gold_residue"), literal(residue, V.own("gold_residue_has_position"), F.substring_index("id", "_", -1).cast("long"), "integer"), iri(V.mint("gold_domain", above), V.own("gold_parent_of"), residue)]))
    for kind in ("protein", "domain", "residue"):
        for state, predicate in (("positive", "gold_interacts_with"), ("negative", "gold_not_interacts_with")):
            pairs = tables[f"{kind}_{state}"]
            out = out.unionByName(to_triples(pairs, [iri(V.mint(f"gold_{kind}", F.col("p")), V.own(predicate), V.mint(f"gold_{kind}", F.col("q")))]))
    return out


def gold_aliases(df: DataFrame) -> DataFrame:
    """(OLN, SP_ACC): protein names and accessions."""
    return to_triples(df, [iri(V.mint("gold_protein", F.col("OLN")), V.SAME_AS, V.uniprot(F.col("SP_ACC")))])


def pdb_ids(names: DataFrame) -> DataFrame:
    """(name): structure files named by their id."""
    return to_triples(names, [iri(V.pdb(F.substring_index("name", ".", 1)), V.TYPE, V.expand("pdbo:PDBID"))])


def pdb_structures(df: DataFrame) -> DataFrame:
    """FASTA with headers ``id:chain:sequence`` and ``id:chain:secstr``; a kind that comes twice for a chain is an error."""
    parts = F.split("header", ":")
    rows = df.select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("chain"), F.get(parts, F.lit(2)).alias("kind"), "sequence")
    known = F.when(F.col("kind").isin("sequence", "secstr"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))).cast("string"))
    one = F.when(F.count("*") == 1, F.max("sequence")).otherwise(F.raise_error(F.lit("a chain comes twice")).cast("string"))
    rows = rows.withColumn("kind", known).groupBy("id", "chain", "kind").agg(one.alias("sequence"))
    s = V.pdb(F.col("id"), F.col("chain"))
    return to_triples(rows, [literal(s, V.own(f"pdb_id_has_{name}"), F.col("sequence"), when=F.col("kind") == kind) for kind, name in (("sequence", "ps"), ("secstr", "ss"))])


def sifts_chains(df: DataFrame) -> DataFrame:
    return to_triples(df, [iri(V.pdb(F.col("PDB_ID"), F.col("PDB_CHAIN")), V.own("sifts_same_as"), V.uniprot(F.col("SP_ID")))])


def function_annotations(df: DataFrame) -> DataFrame:
    """(ID, SEQUENCE, GO list, TAXID, EVIDENCE): entities of a function prediction set, terms parted by ``;``."""
    s = V.mint("target_id", F.col("ID"))
    terms = F.transform(X.sanitize_all(F.col("GO"), ";"), V.go_term)
    rules = [is_a(s, "target_id"), literal(s, V.own("target_id_has_seq"), F.col("SEQUENCE")), iri(s, V.own("target_id_has_go"), terms, each=True), literal(s, V.own("target_id_has_taxid"), F.col("TAXID")), literal(s, V.own("target_id_has_evidence"), F.col("EVIDENCE"))]
    return to_triples(df, rules)


Loader = Callable[[SparkSession, str], DataFrame]


def _table(path: str, columns: list[str], mapping: Callable[[DataFrame], DataFrame], **options) -> Loader:
    return lambda spark, root: mapping(files.delimited(spark, f"{root}/{path}", columns, **options))


def _gold(spark: SparkSession, root: str) -> DataFrame:
    return gold_standard(files.gold(spark, f"{root}/gold"))


def _ipfam_pairs(spark: SparkSession, root: str) -> DataFrame:
    homo = files.delimited(spark, f"{root}/ipfam/homodomain_interaction.csv", ["FAM", "ID", "INT_TYPE"], skip=1)
    return ipfam_interactions(homo, files.delimited(spark, f"{root}/ipfam/heterodomain_interaction.csv", ["FAM1", "ID1", "FAM2", "ID2", "INT_TYPE"], skip=1))


#: Target -> part -> loader of its triples from a root folder.
REGISTRY: dict[str, dict[str, Loader]] = {
    "sgd": {
        "features": _table("SGD/SGD_features.tab", FEATURES, sgd_features),
        "xrefs": _table("SGD/dbxref.tab", XREFS, sgd_xrefs),
        "sequences": lambda spark, root: sgd_sequences(files.fasta(spark, f"{root}/SGD/orf_trans_all.fasta")),
        "domains": _table("SGD/domains.tab", DOMAINS, sgd_domains),
        "goslims": _table("SGD/go_slim_mapping.tab", SLIM, sgd_slim),
        "gos": _table("SGD/gene_association.sgd", ASSOCIATIONS, sgd_associations, comment="!"),
        "pdb-homologues": _table("SGD/pdb_homologs.tab", HOMOLOGS, sgd_homologs),
        "interactions": _table("SGD/interaction_data.tab", INTERACTIONS, sgd_interactions),
    },
    "ipfam": {
        "pdb-entries": _table("ipfam/pdb_entry.txt", PDB_ENTRIES, ipfam_entries),
        "families": _table("ipfam/protein_family.txt", FAMILIES, ipfam_families, skip=1),
        "family-interactions": _ipfam_pairs,
        "regions": _table("ipfam/pdb_protein_region.txt", REGIONS, ipfam_regions),
        "region-interactions": _table("ipfam/pdb_protein_region_int.txt", REGION_INTERACTIONS, ipfam_region_interactions),
    },
    "intact": {"rows": lambda spark, root: psimi(files.delimited(spark, f"{root}/intact.txt", files.PSIMI, quote=""))},
    "mint": {"rows": lambda spark, root: psimi(files.delimited(spark, f"{root}/mint.txt", files.PSIMI, quote=""))},
    "biogrid": {"rows": lambda spark, root: psimi(files.delimited(spark, f"{root}/biogrid.txt", files.PSIMI, skip=1, quote=""))},
    "string": {
        "aliases": _table("STRING/aliases.txt", ALIASES, string_aliases, skip=1),
        "interactions": _table("STRING/actions.txt", ACTIONS, string_actions, skip=1),
        "cog": _table("STRING/groups.txt", GROUPS, string_groups, skip=1),
    },
    "gold": {"all": _gold, "aliases": lambda spark, root: gold_aliases(files.ruled_table(spark, f"{root}/gold/yeast.txt", {"OLN": (75, 95), "SP_ACC": (95, 106)}))},
    "pdb": {
        "ids": lambda spark, root: pdb_ids(files.listing(spark, f"{root}/PDB/divided/mmCIF/*")),
        "ps-ss": lambda spark, root: pdb_structures(files.fasta(spark, f"{root}/PDB/ss.txt")),
    },
    "cafa13": {"annotations": _table("cafa/targets.tab", ANNOTATIONS, function_annotations)},
    "sifts": {"pdb-uniprot": _table("SIFTS/pdb_chain_uniprot.csv", CHAINS, sifts_chains)},
}


def convert(spark: SparkSession, root: str, target: str, parts: list[str] | None, destination: str, force: bool = False) -> list[str]:
    """Write each part's triples to its own folder unless it is there; unknown parts are left out. The parts written."""
    if target not in REGISTRY:
        raise ValueError(f"unknown target {target!r}: there are {', '.join(sorted(REGISTRY))}")
    done = []
    for part, load in REGISTRY[target].items():
        if parts is None or part in parts:
            load(spark, root).write.mode("overwrite" if force else "ignore").partitionBy("p").parquet(f"{destination}/{target}-{part}")
            done.append(part)
    return done
