"""Vocabulary: namespaces, prefixes and minting of terms.

Terms of this engine's own vocabulary are ``<base><name>``; individuals of a class are ``<class>.<id>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "urn:braidwork:term#"
UNKNOWN = "urn:braidwork:unknown-term#"

# Public namespaces and their usual prefixes.
PREFIXES = {
    "bw": BASE,
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "go": "http://www.geneontology.org/go#",
    "obo": "http://purl.obolibrary.org/obo/",
    "mi": "http://purl.obolibrary.org/obo/mi#",
    "unicore": "http://purl.uniprot.org/core/",
    "uniprot": "http://purl.uniprot.org/uniprot/",
    "taxon": "http://purl.uniprot.org/taxonomy/",
    "pdbo": "http://rdf.wwpdb.org/schema/pdbx-v40.owl#",
    "pdbr": "http://rdf.wwpdb.org/pdb/",
}
REFSEQ = "http://purl.obolibrary.org/obo/refseq#"
TYPE = PREFIXES["rdf"] + "type"
SAME_AS = PREFIXES["owl"] + "sameAs"
PART_OF = PREFIXES["dcterms"] + "isPartOf"

# The secondary structure codes of DSSP and their classes; a blank is a coil.
DSSP = {"H": "alpha_helix", "B": "beta_bridge", "E": "beta_ladder", "G": "3_helix", "I": "5_helix", "T": "turn", "S": "bend", "C": "coil", " ": "coil"}


def own(name: str) -> str:
    return BASE + name


def expand(name: str) -> str:
    """``prefix:local`` in full."""
    prefix, _, local = name.partition(":")
    return PREFIXES[prefix] + local


def mint(kind: str, identifier: Column) -> Column:
    """An individual of one of this vocabulary's classes."""
    return F.concat(F.lit(own(kind) + "."), identifier)


def go_term(identifier: Column) -> Column:
    return F.concat(F.lit(PREFIXES["go"]), identifier)


def uniprot(identifier: Column) -> Column:
    return F.concat(F.lit(PREFIXES["uniprot"]), identifier)


def pdb(identifier: Column, chain: Column | None = None) -> Column:
    name = F.lower(identifier) if chain is None else F.concat(F.lower(identifier), F.lit("_"), chain)
    return F.concat(F.lit(PREFIXES["pdbr"]), name)


def dssp_class(code: Column) -> Column:
    """The class of a DSSP code; others are an error."""
    table = F.create_map(*[F.lit(x) for k, v in DSSP.items() for x in (k, own("dssp_" + v))])
    return F.coalesce(F.try_element_at(table, code), F.raise_error(F.concat(F.lit("unknown DSSP code "), code)))


def local_name(iri: Column, mark: str = ".") -> Column:
    """What stands behind the last ``mark``: ids may hold none."""
    return F.substring_index(iri, mark, -1)


def prefix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PREFIXES.items()), "prefix string, iri string")
