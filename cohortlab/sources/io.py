"""Readers and writers.

All readers return lazy DataFrames with explicit column handling; the only
actions are one-line header reads of text files.  The text formats are parsed from a
table of lines (``parse_*``), wherever it comes from; broken lines are kept apart, not
dropped unseen.  Writers never collect.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (pruning and pushdown by Catalyst)."""
    return spark.read.parquet(path)


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", schema: StructType | str | None = None,
                   header: bool = True) -> DataFrame:
    """Delimited text with a header row (tab by default).

    With a schema the file is not sampled for inference; a UTF-8 BOM before
    the header is stripped by the CSV reader.
    """
    r = spark.read.option("header", header).option("sep", sep).option("encoding", "UTF-8")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


# -- text lines to rows ----------------------------------------------------------------------

BROKEN = "_broken_line"       # the text of a line that does not parse, else null


def data_lines(lines: DataFrame, header: str | None = None) -> DataFrame:
    """The lines (value) without byte-order marks, blank lines and copies of the header."""
    clean = lines.select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.trim("value") != "")
    return clean if header is None else clean.where(F.col("value") != F.lit(header.lstrip("\ufeff")))


def parse_delimited(lines: DataFrame, schema: StructType | str, sep: str = "\t", header: str | None = None,
                    date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Lines of delimited text to the columns of ``schema`` and ``BROKEN``.

    Nothing is dropped and nothing fails: a line with too few or too many cells, or with a
    cell that is not of its type, keeps what parses and is named in ``BROKEN``;
    :func:`accepted` and :func:`quarantined` part the rows.  A quoted cell may hold the
    separator, but no line break.
    """
    typed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType([*typed.fields, StructField(BROKEN, StringType())])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "dateFormat": date_format}
    row = F.from_csv("value", full.toDDL(), options)
    # read as a whole: the parser must see all cells to tell a broken line
    rows = data_lines(lines, header).select(row.alias("row"))
    return rows.select(*[F.col(f"row.`{f.name}`") for f in full.fields])


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(BROKEN).isNull()).drop(BROKEN)


def quarantined(parsed: DataFrame) -> DataFrame:
    """The broken lines as they stood."""
    return parsed.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"))


def _text_columns(header: str, sep: str) -> StructType:
    names = [n.strip().strip('"') for n in header.lstrip("\ufeff").split(sep)]
    return StructType([StructField(n, StringType()) for n in names])


def parse_code_list(lines: DataFrame, header: str, column: str, sep: str = ",") -> DataFrame:
    """S3: one column of CSV lines as a code list (code string), trimmed and de-duplicated;
    broken lines take no part."""
    rows = accepted(parse_delimited(lines, _text_columns(header, sep), sep, header))
    return rows.select(F.trim(F.col(f"`{column}`")).alias("code")).where("code <> ''").distinct()


def read_code_list(spark: SparkSession, path: str, column: str, sep: str = ",") -> DataFrame:
    """S3: one column of a CSV as a code list DataFrame (code string), de-duplicated."""
    lines = spark.read.text(path)
    return parse_code_list(lines, lines.first()["value"], column, sep)


def read_dosage(spark: SparkSession, path: str, id_col: str = "FID", snps: list[str] | None = None) -> DataFrame:
    """Whitespace-delimited genotype dosages -> long (patid, snp, dosage).

    The header line names the columns; ``FID`` becomes ``patid`` (string).
    Non-numeric dosage cells (e.g. ``NA``) become null.
    """
    lines = spark.read.text(path)
    header = lines.first()["value"]
    return parse_dosage(lines, header, id_col, snps)


def parse_dosage(lines: DataFrame, header: str, id_col: str = "FID", snps: list[str] | None = None) -> DataFrame:
    """Lines (value) of a dosage file to (patid, snp, dosage); lines equal to the header
    and blank ones are left out.  Cells are taken by position, so the plan does not
    grow with the number of SNPs."""
    names = header.split()
    snps = snps or [n for n in names if n not in (id_col, "IID", "PAT", "MAT", "SEX", "PHENOTYPE")]
    wanted = F.split(F.lit(" ".join(n if n in set(snps) else "" for n in names)), " ")
    cells = (lines.where((F.col("value") != F.lit(header)) & (F.trim("value") != ""))
             .select(F.split(F.trim("value"), r"\s+").alias("_c")))
    return (cells.select(F.get("_c", F.lit(names.index(id_col))).alias("patid"), F.posexplode("_c").alias("_at", "_v"))
            .select("patid", F.get(wanted, F.col("_at")).alias("snp"), F.col("_v").try_cast("double").alias("dosage"))
            .where("snp <> ''"))


def parse_scores(lines: DataFrame, header: str, traits: list[str], id_col: str = "patid", sep: str = ",") -> DataFrame:
    """Lines of a score table to long (patid, trait, score).

    A trait is kept only if every cell of it that is not empty is a number; a trait with
    another cell goes as a whole.  The bad traits (at most one row each) meet the cells in
    an anti join, so nothing runs while the plan is built.  Broken lines take no part.
    """
    rows = accepted(parse_delimited(lines, _text_columns(header, sep), sep, header))
    cells = F.array(*[F.struct(F.lit(t).alias("trait"), F.col(f"`{t}`").alias("text")) for t in traits])
    long = rows.select(F.col(f"`{id_col}`").alias("patid"), F.inline(cells))
    long = long.withColumn("score", F.col("text").try_cast("double"))
    bad = long.where("text IS NOT NULL AND score IS NULL").select("trait").distinct()
    return long.join(bad, "trait", "left_anti").select("patid", "trait", "score")


def read_scores(spark: SparkSession, path: str, traits: list[str], id_col: str = "patid") -> DataFrame:
    """Score CSV -> long (patid, trait, score); see :func:`parse_scores`."""
    lines = spark.read.text(path)
    return parse_scores(lines, lines.first()["value"], traits, id_col)


def parse_sequences(lines: DataFrame, header: str) -> DataFrame:
    """CSV lines whose cells hold stringified Python lists -> array columns ``code``,
    ``year``, ``age`` and ``BROKEN``: lines that are no CSV row, a cell that is no list, or lists
    of different lengths."""
    rows = parse_delimited(lines, _text_columns(header, ","), ",", header)
    lists = {"code": "array<string>", "year": "array<int>", "age": "array<int>"}
    cells = {c: F.from_json(F.regexp_replace(c, "'", '"'), kind) for c, kind in lists.items()}
    size = [F.coalesce(F.size(c), F.lit(-1)) for c in cells.values()]
    fits = (size[0] >= 0) & (size[0] == size[1]) & (size[0] == size[2])
    names = [c for c in rows.columns if c not in lists and c != BROKEN]
    text = F.concat_ws(",", *names, *lists)
    return rows.select(*names, *[v.alias(c) for c, v in cells.items()],
                       F.coalesce(BROKEN, F.when(~fits, text)).alias(BROKEN))


def read_sequences_csv(spark: SparkSession, path: str) -> DataFrame:
    """The sequences of a CSV file; broken lines are left out (see :func:`parse_sequences`)."""
    lines = spark.read.text(path)
    return accepted(parse_sequences(lines, lines.first()["value"]))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors keyed by id as Parquet (id, features array<double>); missing -> error."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no embeddings at {path}") from e
    return df.select("id", F.col("features").cast("array<double>").alias("features"))


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("id", F.col("features").cast("array<double>")).write.mode(mode).parquet(path)


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None,
               sort_by: list[str] | None = None) -> None:
    """Write Parquet (snappy) only if the path does not exist yet.

    With ``sort_by`` rows are range-partitioned and sorted within partitions
    (O1) instead of a global single-output sort.
    """
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    w = df.write.mode("ignore").option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with header; ``single_file`` only for small report tables."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_labels(labels: DataFrame, path: str, k: int, id_col: str = "id", mode: str = "overwrite") -> None:
    """Final clustering (id, k, label) as Parquet partitioned by k; join back by id."""
    (labels.select(F.col(id_col).alias("id"), F.lit(int(k)).alias("k"), F.col("label").cast("int"))
           .write.mode(mode).partitionBy("k").parquet(path))


def read_patients(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Patient table (patid, pracid)."""
    df = spark.read.parquet(path) if fmt == "parquet" else read_delimited(spark, path)
    return df.select(F.col("patid").cast("string"), F.col("pracid").cast("string"))


def read_deprivation(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Deprivation quintile per patient (patid, imd2015_5)."""
    df = spark.read.parquet(path) if fmt == "parquet" else read_delimited(spark, path)
    return df.select(F.col("patid").cast("string"), F.col("imd2015_5").try_cast("int").alias("imd2015_5"))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write stands at ``path`` (Spark's ``_SUCCESS`` marker)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def reuse_or_build(spark: SparkSession, path: str, build, partition_by: list[str] | None = None) -> DataFrame:
    """Read an intermediate table that was written to its end before, otherwise
    build it, write it over whatever an unfinished write left, and read it back - the
    next job starts from the files, not from the upstream plan."""
    if not is_complete(spark, path):
        w = build().write.mode("overwrite").option("compression", "snappy")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)
