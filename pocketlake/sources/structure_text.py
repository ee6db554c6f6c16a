"""Scans of structure and pocket text files into rows.

A file is one input row, so a task holds whole files and line order survives; everything after the line
split is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.features import mean_plddt


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def split_lines(files: DataFrame, text: str = "value") -> DataFrame:
    """One row per line with its position; the other columns are repeated."""
    kept = [c for c in files.columns if c != text]
    # A line feed at the end of the text ends the last line and does not open another one.
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n$", "")
    return files.select(*kept, F.posexplode(F.split(body, "\n")).alias("pos", "line"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*.pdb") -> DataFrame:
    """Lines of all files below ``path`` whose name matches, keyed by file stem."""
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        .select(
            F.col("_metadata.file_path").alias("path"),
            file_stem(F.col("_metadata.file_path")).alias("structure_id"),
            F.col("_metadata.file_size").alias("file_size"),
            "value",
        )
    )
    return split_lines(files)


def _field(start: int, length: int) -> Column:
    return F.trim(F.substring("line", start, length))


#: Start and length behind the last standard column for numbers that no field can hold, by the start of their field.
_WIDE = {7: (81, 20), 23: (101, 12)}


def _hybrid_bounds(width: int) -> tuple[int, int, int]:
    """First number in upper-case letters, numbers per case, and the base-36 value of the first code with a leading letter."""
    return 10**width, 26 * 36 ** (width - 1), 10 * 36 ** (width - 1)


def number_text(number: Column, width: int) -> Column:
    """A whole number right-aligned in ``width`` columns: decimal while it fits, then hybrid-36, then a field of ``*``.

    Hybrid-36 is the usual extension of atom and residue numbers: codes with a leading upper-case letter, then with a lower-case one.
    """
    first, span, letter = _hybrid_bounds(width)
    number = number.cast("long")

    def code(skipped: int) -> Column:
        return F.conv((number - skipped + letter).cast("string"), 10, 36)

    fits = number.between(1 - 10 ** (width - 1), first - 1)
    text = (
        F.when(fits, number.cast("string"))
        .when(number.between(first, first + span - 1), code(first))
        .when(number.between(first + span, first + 2 * span - 1), F.lower(code(first + span)))
    )
    return F.lpad(F.when(number.isNull(), "").otherwise(F.coalesce(text, F.lit("*" * width))), width, " ")


def _number(start: int, width: int) -> Column:
    """The number that ``number_text`` wrote at ``start``, NULL if there is none."""
    first, span, letter = _hybrid_bounds(width)
    text = _field(start, width)
    value = F.conv(text, 36, 10).cast("long") - letter + first
    tail = f"[0-9A-Z]{{{width - 1}}}$"
    return (
        F.when(text.rlike(f"^[A-Z]{tail}"), value)
        .when(text.rlike(f"^[a-z]{tail.lower()}"), value + span)
        .when(text == "*" * width, _field(*_WIDE[start]).try_cast("long"))
        .otherwise(text.try_cast("long"))
    )


def parse_atoms(lines: DataFrame, key: Sequence[str] = ("structure_id",)) -> DataFrame:
    """Fixed-width ATOM/HETATM lines as atom rows (columns of the PDB format).

    The model number is the count of MODEL lines before an atom. That running count stays within one file,
    as the file was read by one task anyway.
    """
    models = lines.where(F.col("line").startswith("MODEL")).select(
        *key, F.col("pos").alias("_start"), _field(11, 4).try_cast("int").alias("_model")
    )
    records = lines.where(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    atoms = records.select(
        *key,
        "pos",
        F.trim(F.substring("line", 1, 6)).alias("record"),
        _number(7, 5).alias("atom_id"),
        _field(13, 4).alias("atom_name"),
        _field(18, 3).alias("resname"),
        _field(22, 1).alias("chain"),
        _number(23, 4).try_cast("int").alias("resseq"),
        _field(31, 8).try_cast("double").alias("x"),
        _field(39, 8).try_cast("double").alias("y"),
        _field(47, 8).try_cast("double").alias("z"),
        _field(61, 6).try_cast("double").alias("bfactor"),
        F.col("line").startswith("HETATM").alias("is_het"),
    )
    starts = models.groupBy(*key).agg(F.array_sort(F.collect_list("_start")).alias("_starts"))
    numbered = atoms.join(starts, list(key), "left")
    count = F.size(F.filter(F.coalesce("_starts", F.array().cast("array<int>")), lambda s: s < F.col("pos")))
    return numbered.withColumn("model", count).drop("_starts")


def _strip(text: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` would leave tabs."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def parse_info(lines: DataFrame, key: Sequence[str] = ("structure_id",)) -> DataFrame:
    """``Pocket N :`` blocks with their ``key : value`` lines as (pocket_id, name, text, number) rows.

    Lines before the first block are ignored. The block of a line is found by a window within its file.
    """
    line = _strip(F.col("line"))
    header = F.regexp_extract("line", r"^Pocket\s+(\d+)", 1)
    block = F.when(F.col("line").startswith("Pocket"), F.nullif(header, F.lit("")).try_cast("int"))
    marked = lines.select(*key, "pos", line.alias("line")).withColumn("_block", block)
    upto = Window.partitionBy(*key).orderBy("pos")
    filled = marked.withColumn("pocket_id", F.last("_block", ignorenulls=True).over(upto))
    pair = F.split("line", ":", 2)
    name = F.translate(F.lower(_strip(F.get(pair, F.lit(0)))), " -", "__")
    text = _strip(F.get(pair, F.lit(1)))
    return filled.where(
        F.col("pocket_id").isNotNull() & F.col("_block").isNull() & F.col("line").contains(":")
    ).select(*key, "pocket_id", "pos", name.alias("name"), text.alias("text"), text.try_cast("double").alias("number"))


def pocket_table(
    info: DataFrame, columns: Sequence[str] = ("volume", "score"), key: Sequence[str] = ("structure_id",)
) -> DataFrame:
    """One row per pocket: the named properties as numbers, all others in a map. Repeated keys: last wins."""
    named = [F.max_by("number", F.when(F.col("name") == c, F.col("pos"))).alias(c) for c in columns]
    rest = F.collect_list(F.when(~F.col("name").isin(*columns), F.struct("name", "pos", "text"))).alias("_rest")
    table = info.groupBy(*key, "pocket_id").agg(*named, rest).withColumn("_rest", F.array_sort("_rest"))
    # In the order of name and position the last of a name stands before another name or at the end.
    last = F.filter("_rest", lambda e, i: F.coalesce(F.get("_rest", i + 1)["name"] != e["name"], F.lit(True)))
    extra = F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"], e["text"])))
    return table.select(*key, "pocket_id", *columns, extra.alias("extra"))


def pocket_residue_ids(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct (key, resseq) of a pocket's atom records; unreadable numbers are skipped."""
    records = lines.where(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    return (
        records.select(*key, _number(23, 4).try_cast("int").alias("resseq")).where("resseq IS NOT NULL").distinct()
    )


def pocket_residue_lists(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    return pocket_residue_ids(lines, key).groupBy(*key).agg(F.array_sort(F.collect_set("resseq")).alias("residue_ids"))


def pocket_centroids(pockets: DataFrame, lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean coordinates of each pocket's atoms; a pocket without a file or atoms sits at (0, 0, 0)."""
    records = lines.where(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    means = records.groupBy(*key).agg(
        *[F.avg(_field(s, 8).try_cast("double")).alias(f"center_{a}") for a, s in (("x", 31), ("y", 39), ("z", 47))]
    )
    return pockets.join(means, list(key), "left").na.fill(0.0, ["center_x", "center_y", "center_z"])


def format_pdb_line(atoms: DataFrame) -> Column:
    """A fixed-width atom record from an atom row; coordinates must already be rounded to 3 decimals.

    Numbers too large for their field are written as ``number_text`` says; those beyond hybrid-36 stand behind column 80 as well.
    """
    record = F.when(F.col("is_het"), "HETATM").otherwise("ATOM  ")
    serial, residue = number_text(F.col("atom_id"), 5), number_text(F.col("resseq"), 4)
    line = F.format_string(
        "%s%s  %-3s %3s %s%s    %8.3f%8.3f%8.3f%6.2f%6.2f",
        record, serial, "atom_name", "resname", "chain", residue, "x", "y", "z",
        F.lit(1.0), "bfactor",
    )
    wide = F.concat(F.rpad(line, 80, " "), F.lpad(F.col("atom_id").cast("string"), 20, " "), F.lpad(F.col("resseq").cast("string"), 12, " "))
    return F.when((serial == "*" * 5) | (residue == "*" * 4), wide).otherwise(line)


def accession(stem: Column) -> Column:
    """Second ``-`` token of a model file's stem, or the stem itself."""
    parts = F.split(stem, "-")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(stem)


def catalog_columns(paths: DataFrame, path: str = "path") -> DataFrame:
    """Catalog fields that follow from a path."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return paths.withColumn("filename", name).withColumn("uniprot_id", accession(file_stem(F.col(path))))


def build_catalog(spark: SparkSession, folder: str, catalog_path: str, force: bool = False) -> DataFrame:
    """Catalog of all structure files: accession, path, size and mean pLDDT (NULL when unreadable).

    Kept as Parquet; an existing one is reused unless ``force``.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{catalog_path}/_SUCCESS")
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if force or not exists:
        lines = read_lines(spark, folder, "*.pdb")
        files = lines.groupBy("path", "structure_id", "file_size").agg(F.count("*").alias("n_lines"))
        confidence = mean_plddt(
            parse_atoms(lines.select(F.col("path").alias("structure_id"), "pos", "line"))
        ).withColumnRenamed("structure_id", "path")
        catalog_columns(files).join(confidence, "path", "left").select(
            "uniprot_id", "filename", F.col("path").alias("filepath"), "file_size", "mean_plddt"
        ).write.mode("overwrite").parquet(catalog_path)
    return spark.read.parquet(catalog_path)
