"""Readers for the reference's input formats: split CSVs, JSON id
dictionaries, line lists, whitespace affinity matrices and nested JSON
records (protein, compound, activity payloads)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindscape.operators.ranking import partition_rank
from bindscape.session import cut_lineage

INTERACTION_CSV_SCHEMA = T.StructType([
    T.StructField("compound", T.StringType()),
    T.StructField("protein", T.StringType()),
    T.StructField("affinity", T.DoubleType()),
])

# Alternate column names of the training CSV, renamed on read.
ALTERNATE_NAMES = {"compound_iso_smiles": "compound", "target_sequence": "protein"}


def _strip(c: Column) -> Column:
    """Python ``str.strip``: all leading and trailing whitespace, newlines included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def file_stem(path) -> Column:
    """Stem of the dataset file a row came from. Spark writes a dataset as a
    directory of part files, so for ``.../name.csv/part-....csv`` the stem is
    ``name``; for a plain file it is the file name without extension."""
    p = F.col(path) if isinstance(path, str) else path
    parent = F.regexp_extract(p, r"([^/]+)/part-[^/]*$", 1)
    leaf = F.regexp_extract(p, r"([^/]+)$", 1)
    name = F.when(parent != "", parent).otherwise(leaf)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def split_name(path) -> Column:
    """A2: split name from the file stem, first match wins."""
    s = file_stem(path)
    return (F.when(s.contains("train"), "train").when(s.contains("test"), "test")
             .when(s.contains("valid"), "valid").when(s.contains("ligands"), "ligands")
             .when(s.contains("proteins"), "proteins").when(s.isin("Y", "affinity"), "affinity")
             .otherwise(s))


def read_split_csv(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """A1: read header CSVs matching ``pattern`` with an explicit schema (no
    inference pass); adds ``source_file`` and the A2 ``source_split``."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", False)
    df = r.csv(pattern)
    for old, new in ALTERNATE_NAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return (df.withColumn("source_file", F.col("_metadata.file_path"))
              .withColumn("source_split", split_name(F.col("_metadata.file_path"))))


def read_id_dict(spark: SparkSession, pattern: str) -> DataFrame:
    """A3: each file is one JSON object ``{id: value}``; one row per entry.
    Columns ``compound_id/compound`` for ligand or compound files,
    ``protein_id/protein`` for protein files, else ``id/data``. A file that is
    not one valid JSON object is read as text: one row per line of the stripped
    content in ``data``, the other columns null. Each file is one record (the
    format); a large dictionary is sharded over many files."""
    raw = spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_path").alias("_path"), _strip(F.col("value")).alias("_text"))
    m = F.from_json("_text", T.MapType(T.StringType(), T.StringType()))
    raw = raw.withColumn("_map", F.when(F.col("_text").startswith("{") & F.col("_text").endswith("}"), m))
    entries = F.transform(F.map_entries("_map"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    lines = F.transform(F.split("_text", "\n"), lambda x: F.struct(F.lit(None).cast("string").alias("k"), x.alias("v")))
    is_json = F.col("_map").isNotNull()
    ex = raw.select("_path", is_json.alias("_json"), F.explode(F.when(is_json, entries).otherwise(lines)).alias("e"))
    path = F.col("_path")
    is_comp = F.col("_json") & (path.contains("ligands") | path.contains("compounds"))
    is_prot = F.col("_json") & ~is_comp & path.contains("proteins")
    other = ~is_comp & ~is_prot
    return ex.select(
        F.when(is_comp, F.col("e.k")).alias("compound_id"), F.when(is_comp, F.col("e.v")).alias("compound"),
        F.when(is_prot, F.col("e.k")).alias("protein_id"), F.when(is_prot, F.col("e.v")).alias("protein"),
        F.when(other, F.col("e.k")).alias("id"), F.when(other, F.col("e.v")).alias("data"), "_path")


def read_lines_indexed(spark: SparkSession, pattern: str) -> DataFrame:
    """``(source_file, idx, data)``: the lines of the stripped content of each file with their
    number in it from 0 (leading and trailing blank lines are no part of it). Files are
    split over tasks; the number comes from a rank by block and position."""
    raw = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.regexp_replace("value", "\r$", "").alias("data"))
    rows = cut_lineage(raw.withColumn("_row", F.monotonically_increasing_id()))
    ranked = partition_rank(rows, ["source_file"], "_block", ["_row"], "_n")
    full = F.when(_strip(F.col("data")) != "", F.col("_n"))
    ends = ranked.groupBy(F.col("source_file").alias("_f")).agg(F.min(full).alias("_first"), F.max(full).alias("_last"))
    kept = ranked.join(ends, F.col("source_file") == F.col("_f")).where(F.col("_n").between(F.col("_first"), F.col("_last")))
    text = F.col("data")
    text = F.when(F.col("_n") == F.col("_first"), F.regexp_replace(text, r"^\s+", "")).otherwise(text)
    text = F.when(F.col("_n") == F.col("_last"), F.regexp_replace(text, r"\s+$", "")).otherwise(text)
    return kept.select("source_file", (F.col("_n") - F.col("_first")).cast("long").alias("idx"), text.alias("data"))


def read_list_txt(spark: SparkSession, pattern: str) -> DataFrame:
    """A4: each file stripped and cut into lines; ``(source_file, idx, data)``."""
    return read_lines_indexed(spark, pattern)


def read_matrix_txt(spark: SparkSession, pattern: str) -> DataFrame:
    """A5: whitespace matrix; a line with any unparsable token is dropped
    whole and later rows shift up. Long form ``(source_file, i, j, affinity)``.
    A file whose first line has a single token is not a matrix (no rows)."""
    lines = read_lines_indexed(spark, pattern).select(
        "source_file", "idx", F.split(_strip(F.col("data")), r"\s+").alias("tokens"))
    matrix = lines.where((F.col("idx") == 0) & (F.size("tokens") > 1)).select(F.col("source_file").alias("_f"))
    row = F.transform("tokens", lambda t: t.try_cast("double"))
    bad = F.exists(F.zip_with(row, "tokens", lambda v, t: v.isNull() & (t != "")), lambda b: b)
    kept = lines.join(matrix, F.col("source_file") == F.col("_f"), "left_semi").where(~bad).select(
        "source_file", "idx", row.alias("row"))
    numbered = partition_rank(kept, ["source_file"], "idx", rank_col="_n")
    return numbered.select("source_file", (F.col("_n") - 1).cast("int").alias("i"), F.posexplode("row").alias("j", "affinity"))


PROTEIN_JSON_SCHEMA = T.StructType([
    T.StructField("primaryAccession", T.StringType()),
    T.StructField("proteinDescription", T.StructType([
        T.StructField("recommendedName", T.StructType([
            T.StructField("fullName", T.StructType([T.StructField("value", T.StringType())]))]))])),
    T.StructField("genes", T.ArrayType(T.StructType([
        T.StructField("geneName", T.StructType([T.StructField("value", T.StringType())]))]))),
    T.StructField("organism", T.StructType([T.StructField("scientificName", T.StringType())])),
    T.StructField("sequence", T.StructType([T.StructField("value", T.StringType()),
                                            T.StructField("length", T.LongType())])),
    T.StructField("comments", T.ArrayType(T.StructType([
        T.StructField("commentType", T.StringType()),
        T.StructField("texts", T.ArrayType(T.StructType([T.StructField("value", T.StringType())])))]))),
    T.StructField("keywords", T.ArrayType(T.StructType([T.StructField("value", T.StringType())]))),
])


def flatten_protein(rec) -> Column:
    """Flat protein record with reference defaults ("" / 0 / [])."""
    r = F.col(rec) if isinstance(rec, str) else rec
    fn = F.try_element_at(F.filter(r["comments"], lambda c: c["commentType"] == "FUNCTION"), F.lit(1))
    return F.struct(
        F.coalesce(r["primaryAccession"], F.lit("")).alias("uniprot_id"),
        F.coalesce(r["proteinDescription"]["recommendedName"]["fullName"]["value"], F.lit("")).alias("protein_name"),
        F.coalesce(F.try_element_at(r["genes"], F.lit(1))["geneName"]["value"], F.lit("")).alias("gene_name"),
        F.coalesce(r["organism"]["scientificName"], F.lit("")).alias("organism"),
        F.coalesce(r["sequence"]["value"], F.lit("")).alias("sequence"),
        F.coalesce(r["sequence"]["length"], F.lit(0).cast("long")).alias("length"),
        F.coalesce(F.try_element_at(fn["texts"], F.lit(1))["value"], F.lit("")).alias("function"),
        F.coalesce(F.transform(r["keywords"], lambda k: F.coalesce(k["value"], F.lit(""))),
                   F.array().cast("array<string>")).alias("keywords"),
    )


COMPOUND_JSON_SCHEMA = T.StructType([
    T.StructField("molecule_chembl_id", T.StringType()),
    T.StructField("pref_name", T.StringType()),
    T.StructField("molecule_structures", T.StructType([
        T.StructField("canonical_smiles", T.StringType()), T.StructField("standard_inchi", T.StringType())])),
    T.StructField("molecule_properties", T.StructType([
        T.StructField(n, T.StringType()) for n in ("full_mwt", "alogp", "hbd", "hba", "rtb", "psa")])),
    T.StructField("max_phase", T.StringType()),
    T.StructField("therapeutic_flag", T.BooleanType()),
])


def flatten_compound(rec) -> Column:
    """Flat compound record; numeric strings cast to double, missing -> 0/""/false."""
    r = F.col(rec) if isinstance(rec, str) else rec
    props = r["molecule_properties"]

    def num(c):
        return F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.struct(
        F.coalesce(r["molecule_chembl_id"], F.lit("")).alias("chembl_id"),
        F.coalesce(r["pref_name"], F.lit("")).alias("pref_name"),
        F.coalesce(r["molecule_structures"]["canonical_smiles"], F.lit("")).alias("smiles"),
        F.coalesce(r["molecule_structures"]["standard_inchi"], F.lit("")).alias("inchi"),
        num(props["full_mwt"]).alias("molecular_weight"), num(props["alogp"]).alias("alogp"),
        num(props["hbd"]).alias("hbd"), num(props["hba"]).alias("hba"),
        num(props["rtb"]).alias("rtb"), num(props["psa"]).alias("psa"),
        F.coalesce(r["max_phase"].try_cast("double"), F.lit(0.0)).cast("int").alias("max_phase"),
        F.coalesce(r["therapeutic_flag"], F.lit(False)).alias("therapeutic_flag"),
    )


ACTIVITY_JSON_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("activities", T.ArrayType(T.StructType([
        T.StructField("activity_id", T.LongType()), T.StructField("standard_type", T.StringType()),
        T.StructField("standard_value", T.StringType()), T.StructField("standard_units", T.StringType()),
        T.StructField("pchembl_value", T.StringType()), T.StructField("activity_comment", T.StringType())]))),
])


def flatten_activities(df: DataFrame, rec: str = "rec") -> DataFrame:
    """One row per ``activities[*]`` element with the six fields
    (comment defaults to "")."""
    ex = df.select("*", F.explode_outer(F.col(f"{rec}.activities")).alias("_a"))
    return ex.select(
        *[c for c in df.columns if c != rec], F.col(f"{rec}.target").alias("target"),
        F.col("_a.activity_id").alias("activity_id"), F.col("_a.standard_type").alias("standard_type"),
        F.col("_a.standard_value").alias("standard_value"), F.col("_a.standard_units").alias("standard_units"),
        F.col("_a.pchembl_value").alias("pchembl_value"),
        F.coalesce(F.col("_a.activity_comment"), F.lit("")).alias("activity_comment"),
    ).filter(F.col("activity_id").isNotNull() | F.col("standard_type").isNotNull())


def _depth(text: Column) -> Column:
    """Opening less closing braces and brackets outside strings, of a piece without escapes that starts outside a string."""
    bare = F.regexp_replace(text, r'"[^"]*(?:"|$)', "")
    return F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))


def read_large_id_dict(spark: SparkSession, path: str) -> DataFrame:
    """A3 for one large file: ``(id, data)``, the entries of one JSON object, read by as many tasks as the
    file has splits; the rows that ``from_json`` to a map of strings gives.

    The text source cuts the file at commas, wherever its splits lie. A comma ends an entry if it stands outside
    strings and at depth one: running counts of the quotes and of the braces before each piece, in the order of the file, tell
    (range partitions with offsets, on narrow rows). Pieces of an entry are then put together and parsed by themselves, so a task holds
    entries, not the file. An entry that is no valid JSON raises. A missing or empty object gives no rows."""
    from bindscape.operators.ranking import prefix_sums
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("o"), "value")
    pieces = cut_lineage(raw)
    # no piece ends within an escape, as no comma is escaped
    value = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(F.regexp_replace(value, '[^"]', ""))
    # the two ways in which a piece can start: outside a string, or inside one up to its first quote
    inside = F.regexp_replace(value, r'^[^"]*(?:"|$)', "")
    narrow = pieces.select("o", quotes.alias("q"), _depth(value).alias("out"), _depth(inside).alias("in"))
    quoted = prefix_sums(narrow, "o", ["q"])
    starts_in = (F.col("cum_q") - F.col("q")) % 2 == 1
    deep = prefix_sums(quoted.select("o", "cum_q", F.when(starts_in, F.col("in")).otherwise(F.col("out")).alias("d")), "o", ["d"])
    border = ((F.col("cum_q") % 2 == 0) & (F.col("cum_d") == 1)).cast("int")
    ends = prefix_sums(deep.select("o", border.alias("e")), "o", ["e"])
    numbered = pieces.join(ends.select("o", (F.col("cum_e") - F.col("e")).alias("entry")), "o")
    texts = numbered.groupBy("entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "value"))), lambda x: x["value"]), ",").alias("t"))
    last = texts.agg(F.max("entry")).first()[0]
    t = F.col("t")
    t = F.when(F.col("entry") == 0, F.regexp_replace(t, r"^\s*\{", "")).otherwise(t)
    t = F.when(F.col("entry") == F.lit(last), F.regexp_replace(t, r"\}\s*$", "")).otherwise(t)
    parsed = F.from_json(F.concat(F.lit("{"), t, F.lit("}")), T.MapType(T.StringType(), T.StringType()))
    parsed = F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("not an entry of a JSON object: "), F.substring(t, 1, 80))))
    return texts.select(F.explode(parsed).alias("id", "data"))
