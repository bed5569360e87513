"""Readers of delimited and line-structured files. All give strings unless said otherwise; paths may be globs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.network import number


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _digest(rows: DataFrame) -> str:
    """A digest of rows as a bag, in whatever order they come; sums of two hashes, which partial aggregation makes."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    hashes = [F.xxhash64(F.lit(salt), *columns) for salt in (1, 2)]
    summed = rows.agg(F.count("*"), *[F.sum(h.cast("decimal(38,0)")) for h in hashes]).first()
    return hashlib.sha256(repr([None if x is None else int(x) for x in summed]).encode()).hexdigest()[:32]


def fingerprint(spark: SparkSession, path: str) -> str:
    """What tells a file, or the files under a folder, from a later state: names, sizes and times. Spark lists them and reads none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return "none"
    return _digest(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime"))


def content_fingerprint(rows: DataFrame) -> str:
    """The same for a table that is no file: of all its rows, which are read for it."""
    return _digest(rows)


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", skip: int = 0, quote: str = '"', comment: str | None = None) -> DataFrame:
    """Records by position. Short rows end in nulls, surplus cells go, empty cells are null, blank lines don't count.

    ``skip`` drops that many records at the head of each file, as long as these lie in its first split. A record is a line.
    """
    reader = spark.read.schema(string_schema(columns)).option("sep", sep).option("quote", quote).option("escape", quote).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    if not skip:
        return reader.csv(path)
    # A file may be split over tasks; the records to be skipped are the first of the split that begins with the file.
    place, at = F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at")
    rows = reader.csv(path).select("*", place, (F.col("_metadata.file_block_start") == 0).alias("__head"), at)
    first = rows.where("__head").groupBy("__file").agg(F.min("__at").alias("__first"))
    return rows.join(F.broadcast(first), "__file", "left").where(~F.col("__head") | (F.col("__at") - F.col("__first") >= skip)).select(*[F.col(f"`{c}`") for c in columns])


def with_header(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.option("sep", sep).option("header", True).csv(path)


def tokens(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(file, line, words): the words of each line, numbered from 0 in its file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "value"))
    rows = rows.where((F.trim("value") != "") & (F.col("line") >= skip))
    return rows.select("file", "line", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("words"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence): lines are joined, a trailing ``*`` goes. A record is one row from the start, however its lines wrap."""
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^\s*>", "")
    rows = records.select(text.alias("t")).where(F.trim("t") != "")
    body = F.regexp_replace(F.when(F.instr("t", "\n") > 0, F.substr("t", F.instr("t", "\n") + 1)).otherwise(""), r"\s", "")
    return rows.select(F.trim(F.substring_index("t", "\n", 1)).alias("header"), F.regexp_replace(body, r"\*+$", "").alias("sequence"))


def obo(spark: SparkSession, path: str, keep_obsolete: bool = False) -> tuple[DataFrame, DataFrame]:
    """Terms (id, name, namespace, is_obsolete, alt_ids) and edges (child, parent, relation) of an ontology file.

    Only ``[Term]`` stanzas count, and edges of dropped terms go with them. Two terms with one id are an error.
    """
    stanzas = spark.read.option("lineSep", "\n[").text(path).where(F.regexp_like("value", F.lit(r"^\[?Term\]")))  # a file may begin with a stanza
    rows = stanzas.select(F.sha2("value", 256).alias("stanza"), F.explode(F.split("value", r"\r?\n")).alias("line"))
    rows = rows.select("stanza", F.regexp_extract("line", r"^([^ ]+): (.+)$", 1).alias("key"), F.regexp_extract("line", r"^([^ ]+): (.+)$", 2).alias("value")).where("key <> ''")

    def one(key: str):
        return F.max(F.when(F.col("key") == key, F.col("value")))

    first_word = F.substring_index("value", " ", 1)
    terms = rows.groupBy("stanza").agg(
        one("id").alias("id"),
        one("name").alias("name"),
        one("namespace").alias("namespace"),
        F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"),
        F.sort_array(F.collect_set(F.when(F.col("key") == "alt_id", F.col("value")))).alias("alt_ids"),
        F.collect_set(F.when(F.col("key") == "is_a", F.struct(F.lit("is_a").alias("relation"), first_word.alias("parent")))).alias("up"),
        F.collect_set(F.when(F.col("key") == "relationship", F.struct(first_word.alias("relation"), F.get(F.split("value", " "), F.lit(1)).alias("parent")))).alias("other"),
    )
    terms = terms.where(F.col("id").isNotNull())
    if not keep_obsolete:
        terms = terms.where(~F.col("is_obsolete"))
    twice = F.count("*").over(Window.partitionBy("id"))
    terms = terms.withColumn("id", F.when(twice == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("two terms "), "id")).cast("string")))
    edges = terms.select(F.col("id").alias("child"), F.explode(F.concat("up", "other")).alias("e")).select("child", "e.parent", "e.relation")
    return terms.select("id", "name", "namespace", "is_obsolete", "alt_ids"), edges


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, header, identity) of a cluster file: a representative has ``*`` and identity 1."""
    blocks = spark.read.option("lineSep", "\n>").text(path).where(F.regexp_like("value", F.lit(r"^>?Cluster \d+")))
    rows = blocks.select(F.regexp_extract("value", r"Cluster (\d+)", 1).cast("long").alias("cluster"), F.explode(F.split("value", r"\r?\n")).alias("line"))
    rows = rows.where(F.regexp_like("line", F.lit(r"^\d+\s")))
    header = F.regexp_extract("line", r">(.*?)\.\.\.", 1)
    percent = F.regexp_extract("line", r"at .*?([\d.]+)%", 1).try_cast("double") / 100
    return rows.select("cluster", header.alias("header"), F.when(F.endswith(F.trim("line"), F.lit("*")), F.lit(1.0)).otherwise(percent).alias("identity"))


# The columns of InterPro tables, and those that are read by default.
INTERPRO = ["QUERY_ID", "?2", "?3", "DB", "FAMILY", "DESCRIPTION", "START", "STOP", "EVALUE", "?10", "DATE", "IPR_FAMILY", "SHORT_DESCRIPTION", "GO_TERMS", "PATHWAYS"]
INTERPRO_DEFAULT = ["QUERY_ID", "DB", "FAMILY", "START", "STOP", "EVALUE", "DATE", "IPR_FAMILY", "GO_TERMS"]


def interpro(spark: SparkSession, path: str, columns: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    rows = delimited(spark, path, INTERPRO)
    if sources is not None:
        rows = rows.where(F.col("DB").isin(*sources))
    return rows.select(*[F.col(f"`{c}`") for c in columns or INTERPRO_DEFAULT])


def per_entity(spark: SparkSession, entities: DataFrame, folder: str, extension: str = "tsv.txt", columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Domain hits of one file per entity (p), read as one scan; and the entities without a file."""
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), rf"\.{extension}$".replace(".txt", r"\.txt"), "")
    rows = spark.read.schema(string_schema(INTERPRO)).option("sep", "\t").csv(f"{folder}/*.{extension}").withColumn("p", name)
    wanted = columns or INTERPRO_DEFAULT
    hits = rows.join(entities.select("p"), "p", "left_semi").select("p", *[F.col(f"`{c}`") for c in wanted])
    files = spark.read.format("binaryFile").load(f"{folder}/*.{extension}").select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), rf"\.{extension}$", "").alias("p"))
    return hits, entities.select("p").join(files, "p", "left_anti")


def expression(spark: SparkSession, path: str, id_column: str = "NAME") -> DataFrame:
    """(gene, x array<double>, file) of microarray tables: the first data row and two columns are no conditions; a null is an error."""
    rows = with_header(spark, path)
    conditions = [c for c in rows.columns if c != id_column][2:]
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    first = rows.groupBy("__file").agg(F.min("__at").alias("__first"))
    rows = rows.join(F.broadcast(first), "__file").where("__at <> __first")
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.raise_error(F.lit("a measurement is missing")).cast("double")) for c in conditions]
    return rows.select(F.col(id_column).alias("gene"), F.array(*values).alias("x"), F.col("__file").alias("file"))


def expression_folder(spark: SparkSession, root: str, experiments: list[str] | None = None) -> dict[str, DataFrame]:
    """Experiment -> (gene, x) of the tables ``root/EXPERIMENT/*.pcl``; only those that are listed, if any are."""
    found = listing(spark, f"{root}/*/*.pcl").select(F.element_at(F.split("path", "/"), -2).alias("experiment")).distinct()
    if experiments is not None:
        found = found.where(F.col("experiment").isin(*experiments))
    # One row an experiment.
    return {r["experiment"]: expression(spark, f"{root}/{r['experiment']}/*.pcl").select("gene", "x") for r in found.orderBy("experiment").collect()}


def in_order(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (gene, ...) with their ``index``: genes of ``targets`` (gene, index) have theirs, the others follow by name."""
    own = rows.join(targets, "gene")
    rest = rows.join(targets, "gene", "left_anti")
    n = targets.agg(F.coalesce(F.max("index") + 1, F.lit(0)).cast("long").alias("n"))  # one row
    numbered = number(rest, "gene").crossJoin(F.broadcast(n)).select("gene", (F.col("index") + F.col("n")).alias("index"))
    return own.unionByName(rest.join(numbered, "gene"))


def table_or_none(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame | None:
    """A Parquet table with some columns cast, or nothing if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.parquet(path)
    return rows.withColumns({c: F.col(c).cast(t) for c, t in types.items()}) if types else rows


# The columns of PSI-MI TAB; versions 2.5, 2.6 and 2.7 have the first 15, 36 and 42.
PSIMI = [
    "ID_INTERACTOR_A", "ID_INTERACTOR_B", "ALT_IDS_INTERACTOR_A", "ALT_IDS_INTERACTOR_B", "ALIASES_INTERACTOR_A", "ALIASES_INTERACTOR_B",
    "INTERACTION_DETECTION_METHOD", "PUBLICATION_1ST_AUTHOR", "PUBLICATION_IDENTIFIERS", "TAXID_INTERACTOR_A", "TAXID_INTERACTOR_B",
    "INTERACTION_TYPES", "SOURCE_DATABASE", "INTERACTION_IDENTIFIERS", "CONFIDENCE_VALUES", "EXPANSION_METHODS", "BIOLOGICAL_ROLE_A",
    "BIOLOGICAL_ROLE_B", "EXPERIMENTAL_ROLE_A", "EXPERIMENTAL_ROLE_B", "TYPE_INTERACTOR_A", "TYPE_INTERACTOR_B", "XREFS_A", "XREFS_B",
    "XREFS_INTERACTION", "ANNOTATIONS_A", "ANNOTATIONS_B", "ANNOTATIONS_INTERACTION", "TAXID_HOST", "PARAMETERS_INTERACTION", "CREATION_DATE",
    "UPDATE_DATE", "CHECKSUM_A", "CHECKSUM_B", "CHECKSUM_INTERACTION", "IS_NEGATIVE", "FEATURES_A", "FEATURES_B", "STOICHIOMETRY_A",
    "STOICHIOMETRY_B", "IDENTIFICATION_METHOD_A", "IDENTIFICATION_METHOD_B",
]
PSIMI_VERSIONS = {15: "2.5", 36: "2.6", 42: "2.7"}


def psimi(spark: SparkSession, path: str, version: str | None = None, header: bool = True) -> tuple[DataFrame, str]:
    """An interaction table and its version, told by the number of columns; other numbers are an error."""
    if version is None:
        n = len((spark.read.text(path).first() or [""])[0].split("\t"))
        if n not in PSIMI_VERSIONS:
            raise ValueError(f"{n} columns are no known version")
        version = PSIMI_VERSIONS[n]
    size = next((k for k, v in PSIMI_VERSIONS.items() if v == version), None)
    if size is None:
        raise ValueError(f"unknown version {version}")
    return spark.read.schema(string_schema(PSIMI[:size])).option("sep", "\t").option("header", header).option("enforceSchema", True).option("quote", "").csv(path), version


def pssm(spark: SparkSession, path: str, priors: list[float] | None = None, gamma: float = 0.8) -> DataFrame:
    """(file, pos, residue, scores, costs) of fixed-width position-specific scoring matrices.

    Three leading and six trailing lines don't count. ``costs`` are -ln of the smoothed probabilities, 1e13 for
    zero; ``priors`` are by letter and those of all proteins by default. Both arrays are in the order of the letters. Positions that don't follow each other are an error.
    """
    from ..functions.numeric import smoothed_cost
    from ..operators.strings import AMINO_ACIDS, BACKGROUND, PSSM_ORDER

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n").alias("lines"))
    rows = text.select("file", F.posexplode(F.slice("lines", F.lit(4), F.greatest(F.size("lines") - 9, F.lit(0)))).alias("at", "line"))
    prior = priors or [*BACKGROUND.values()]
    order = [PSSM_ORDER.index(a) for a in AMINO_ACIDS]
    scores = F.array(*[F.trim(F.substring("line", 10 + 3 * k, 3)).cast("int") for k in order])
    costs = F.array(*[smoothed_cost(F.trim(F.substring("line", 71 + 4 * k, 4)).cast("double") / 100, F.lit(float(prior[AMINO_ACIDS.index(PSSM_ORDER[k])])), gamma) for k in order])
    rows = rows.select("file", "at", F.trim(F.substring("line", 1, 5)).cast("int").alias("pos"), F.trim(F.substring("line", 6, 2)).alias("residue"), scores.alias("scores"), costs.alias("costs"))
    before = F.lag("pos").over(Window.partitionBy("file").orderBy("at"))
    ok = F.when(before.isNull() | (F.col("pos") == before + 1), F.col("pos")).otherwise(F.raise_error(F.lit("positions don't follow each other")).cast("int"))
    return rows.withColumn("pos", ok).drop("at")


def amino_acids(spark: SparkSession, path: str) -> DataFrame:
    """A property table (aa, numbers) with the means as the unknown residue ``?``."""
    rows = with_header(spark, path)
    numbers = [c for c in rows.columns if c != "aa"]
    rows = rows.select("aa", *[F.col(c).cast("double").alias(c) for c in numbers])
    return rows.unionByName(rows.agg(*[F.avg(c).alias(c) for c in numbers]).select(F.lit("?").alias("aa"), *numbers))


def complexes(spark: SparkSession, path: str) -> DataFrame:
    """(complex, p)."""
    return with_header(spark, path).select(F.col("Complex").alias("complex"), F.col("ORF").alias("p")).distinct()


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, row array<double>) of a text matrix; a head line of two numbers, as our writer makes, is skipped."""
    rows = tokens(spark, path).select("line", F.transform("words", lambda w: w.cast("double")).alias("row"))
    shape = rows.agg(F.max(F.size("row")).alias("width"), F.min("line").alias("low"), F.min_by(F.size("row"), "line").alias("first"))
    rows = rows.crossJoin(F.broadcast(shape))  # one row
    head = (F.col("first") == 2) & (F.col("width") != 2)
    return rows.where(~head | (F.col("line") > F.col("low"))).select((F.col("line") - F.col("low") - head.cast("int")).cast("long").alias("i"), "row")


def ruled_table(spark: SparkSession, path: str, boxes: dict[str, tuple[int, int]], section: int = 5) -> DataFrame:
    """Fixed-width columns of the part behind the given number of ruler lines; the first of ``;``-parted values."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"), F.col("_metadata.file_path").alias("file"))
    ruler = F.contains("line", F.lit("____")) | F.contains("line", F.lit("----"))
    rows = rows.withColumn("ruler", ruler).withColumn("part", F.sum(F.col("ruler").cast("int")).over(Window.partitionBy("file").orderBy("at")))
    cut = {n: F.trim(F.get(F.split(F.trim(F.substring("line", a + 1, b - a)), ";"), F.lit(0))) for n, (a, b) in boxes.items()}
    return rows.where((F.col("part") == section) & ~F.col("ruler") & (F.trim("line") != "")).select(*[c.alias(n) for n, c in cut.items()])


def gold(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Entities, labelled pairs and test folds of a gold standard of proteins, domains and residues."""
    out: dict[str, DataFrame] = {}
    for kind, folder, size, name in (("protein", "ppi", 1, "Protein"), ("domain", "ddi", 2, "Domain"), ("residue", "rri", 3, "Residue")):
        base = f"{root}/{folder}/ready"
        out[f"{kind}s"] = tokens(spark, f"{base}/{kind}s.txt").select(F.array_join(F.slice("words", 1, size), "_").alias("id"))
        for state, sign in ((True, "Pos"), (False, "Neg")):
            rows = tokens(spark, f"{base}/gold{sign}{name}Pairs.txt")
            out[f"{kind}_{'positive' if state else 'negative'}"] = rows.select(F.array_join(F.slice("words", 1, size), "_").alias("p"), F.array_join(F.slice("words", 1 + size, size), "_").alias("q"))
    return out


def gold_order(spark: SparkSession, root: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(id, index) and (p, q, index, positive) of a kind of the gold standard in the order of its files, positive pairs first."""
    folder, size, name = {"protein": ("ppi", 1, "Protein"), "domain": ("ddi", 2, "Domain"), "residue": ("rri", 3, "Residue")}[kind]
    base = f"{root}/{folder}/ready"

    def named(first: int):
        return F.array_join(F.slice("words", first, size), "_")

    entities = tokens(spark, f"{base}/{kind}s.txt").select(named(1).alias("id"), "line")
    entities = entities.join(number(entities, "line"), "line").select("id", "index")
    pairs = None
    for state, sign in ((True, "Pos"), (False, "Neg")):
        rows = tokens(spark, f"{base}/gold{sign}{name}Pairs.txt").select(F.struct(F.lit(not state).alias("after"), "line").alias("place"), named(1).alias("p"), named(1 + size).alias("q"), F.lit(state).alias("positive"))
        pairs = rows if pairs is None else pairs.unionByName(rows)
    return entities, pairs.join(number(pairs, "place"), "place").select("p", "q", "index", "positive")


def gold_kernels(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The matrices that come with the gold standard, (i, row) of each kind."""
    return {kind: matrix(spark, f"{root}/{folder}/ready/{kind}Kernel.txt") for kind, folder in (("protein", "ppi"), ("domain", "ddi"), ("residue", "rri"))}


def test_folds(spark: SparkSession, pattern: str, size: int = 1) -> DataFrame:
    """(fold, p, q): the pairs of fold files, whose first line doesn't count; the fold is the number in the name."""
    rows = tokens(spark, pattern, skip=1)
    fold = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d+)", 1).cast("int")
    return rows.select(fold.alias("fold"), F.array_join(F.slice("words", 1, size), "_").alias("p"), F.array_join(F.slice("words", 1 + size, size), "_").alias("q"))


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name): the files of a glob; no content is read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
