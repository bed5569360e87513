"""Scalar functions on identifiers and fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import PREFIXES, REFSEQ, UNKNOWN

# How characters that an IRI cannot hold are written.
SANITIZE = ((" ", "_"), ("'", "_SQUOTE_"), ('"', "_DQUOTE_"), ("(", "_"), (")", "_"))

# Prefixes of identifiers in PSI-MI TAB and the IRIs they stand for, tried in this order.
PSIMI = {
    "psi-mi": PREFIXES["obo"],
    "imex": PREFIXES["obo"] + "IMEX",
    "intact": PREFIXES["obo"] + "INTACT",
    "mint": PREFIXES["obo"] + "MINT",
    "uniprotkb": PREFIXES["uniprot"],
    "refseq": REFSEQ,
    "rcsb pdb": PREFIXES["pdbr"],
    "wwpdb": PREFIXES["pdbr"],
    "taxid": PREFIXES["taxon"],
    "chebi": UNKNOWN,
    "ddbj/embl/genbank": UNKNOWN,
    "emdb": UNKNOWN,
    "ensembl": UNKNOWN,
    "ensemblgenomes": UNKNOWN,
}


def sanitize(text: Column) -> Column:
    for plain, safe in SANITIZE:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def sanitize_all(text: Column, mark: str = r"\|") -> Column:
    """The different non-empty parts of a list field, sanitised."""
    return F.filter(F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), mark), sanitize)), lambda x: x != "")


def absent(text: Column) -> Column:
    """Whether a delimited field has no value: the reader makes empty cells null."""
    return F.coalesce(text, F.lit("")) == ""


def psimi_parts(text: Column) -> Column:
    """Parts of a PSI-MI list without those that say "unknown"; ``-`` and nothing are no parts."""
    parts = F.filter(F.split(text, r"\|"), lambda x: ~F.contains(x, F.lit("unknown")))
    return F.when(absent(text) | (text == "-"), F.array().cast("array<string>")).otherwise(parts)


def psimi_term(part: Column) -> Column:
    """(value, is_iri) of a prefixed identifier. A negative taxid is a literal; unknown prefixes are an error."""
    body = F.substring_index(part, "(", 1)
    found = F.when(part.isNull(), F.lit(None).cast("struct<value:string,is_iri:boolean>"))
    for prefix, iri in PSIMI.items():
        rest = F.substr(body, F.lit(len(prefix) + 2))
        if prefix == "psi-mi":
            value, is_iri = F.concat(F.lit(iri), F.replace(F.replace(rest, F.lit('"'), F.lit("")), F.lit(":"), F.lit("_"))), F.lit(True)
        elif prefix == "taxid":
            value, is_iri = F.when(F.contains(rest, F.lit("-")), rest).otherwise(F.concat(F.lit(iri), rest)), ~F.contains(rest, F.lit("-"))
        else:
            value, is_iri = F.concat(F.lit(iri if prefix == "uniprotkb" else iri + "_"), rest), F.lit(True)
        found = found.when(F.startswith(part, F.lit(prefix + ":")), F.struct(value.alias("value"), is_iri.alias("is_iri")))
    return found.otherwise(F.raise_error(F.concat(F.lit("unknown PSI-MI prefix: "), part)).cast("struct<value:string,is_iri:boolean>"))


def psimi_confidence(text: Column) -> Column:
    """Scores behind ``intact-miscore:``."""
    mark = "intact-miscore:"
    return F.transform(F.filter(psimi_parts(text), lambda x: F.startswith(x, F.lit(mark))), lambda x: F.substr(x, F.lit(len(mark) + 1)))


def psimi_bool(text: Column, skip: tuple[str, ...] = ()) -> Column:
    """true or false; what is missing or in ``skip`` is null and anything else an error."""
    return F.when(text.isNull() | text.isin(*skip), F.lit(None).cast("boolean")).when(text == "true", True).when(text == "false", False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), text)).cast("boolean"))


def pdb_chain(text: Column) -> Column:
    """``1abc`` or ``1abc_C`` as (id, chain), the id lowered; other forms are an error."""
    kind = "struct<id:string,chain:string>"
    whole = F.struct(F.lower(text).alias("id"), F.lit(None).cast("string").alias("chain"))
    parts = F.struct(F.lower(F.substr(text, F.lit(1), F.lit(4))).alias("id"), F.substr(text, F.lit(6), F.lit(1)).alias("chain"))
    bad = F.raise_error(F.concat(F.lit("no PDB id: "), F.coalesce(text, F.lit("null")))).cast(kind)
    return F.when(F.length(text) == 4, whole.cast(kind)).when((F.length(text) == 6) & (F.substr(text, F.lit(5), F.lit(1)) == "_"), parts.cast(kind)).otherwise(bad)


def strip_taxon(text: Column) -> Column:
    """What stands behind the first dot."""
    return F.regexp_replace(text, r"^[^.]*\.", "")


def predicate_name(namespace: Column, level: Column, identifier: Column, name: Column) -> Column:
    """``namespace-lvlN-id-name`` with colons of the id as dashes and only letters and digits of the name."""
    return F.concat_ws("-", namespace, F.concat(F.lit("lvl"), level.cast("string")), F.replace(identifier, F.lit(":"), F.lit("-")), F.regexp_replace(name, r"[^\p{Alnum}]", ""))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]))
