"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.sources.synthetic import bands

_NUMBER_PREFIX = r"^[ \t\n\x0b\f\r]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_NAMED_PREFIX = r"(?i)^[ \t\n\x0b\f\r]*([+-]?)(inf|nan)"
_HEX_PREFIX = r"(?i)^[ \t\n\x0b\f\r]*([+-]?)0x([0-9a-f]{1,15})"


def numbered(rows: DataFrame, name: str, file: Column | None = None) -> DataFrame:
    """The rows with contiguous numbers from 0 in their order, partition after partition. All of it stays in the JVM.

    A row's number is its place in its partition plus the rows of earlier ones: a number per partition, which the driver adds up.
    file: the names of the files that the rows come from, where each file is read as a whole. Then files go by name, as Spark spreads them by size.
    """
    at = rows.withColumn(name, F.monotonically_increasing_id())
    if file is not None:
        at = at.withColumn("cumulo_file", file)
    part = F.shiftright(F.col(name), 33) if file is None else F.col("cumulo_file")
    found = at.groupBy(part.alias("k")).agg(F.count("*").alias("n"), F.min(name).alias("first")).collect()
    before, starts = 0, []
    for r in sorted(found, key=lambda r: r["k"]):
        starts.append((r["k"], before - r["first"]))
        before += r["n"]
    table = rows.sparkSession.createDataFrame(starts, f"cumulo_part {'bigint' if file is None else 'string'}, cumulo_start bigint")
    joined = at.join(F.broadcast(table), part == F.col("cumulo_part"))
    return joined.withColumn(name, F.col(name) + F.col("cumulo_start")).select(name, *[c for c in rows.columns])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): the lines of text files with contiguous numbers from 0."""
    return numbered(spark.read.text(path), "row_id")


def _leading_number(c: Column) -> Column:
    """A number at the start of the text, else 0: decimal, hexadecimal without a fraction, inf or nan in any case."""
    found, named, hexed = F.regexp_extract(c, _NUMBER_PREFIX, 1), F.lower(F.regexp_extract(c, _NAMED_PREFIX, 2)), F.regexp_extract(c, _HEX_PREFIX, 2)
    minus = lambda p: F.when(F.regexp_extract(c, p, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
    decimal = F.when(found == "", F.lit(0.0)).otherwise(F.when(found != "", found).cast("double"))
    whole = F.when(hexed != "", F.conv(F.when(hexed != "", hexed), 16, 10).cast("double") * minus(_HEX_PREFIX))
    return F.when(named == "inf", minus(_NAMED_PREFIX) * F.lit(float("inf"))).when(named == "nan", F.lit(float("nan"))).otherwise(F.coalesce(whole, decimal))


def read_matrix(spark: SparkSession, path: str, n: int, features: int, mode: str = "strict") -> DataFrame:
    """points(row_id, x) from a CSV without header: the first n rows and features columns.

    strict: every field must be a number, and a row must have the columns. compat: empty fields vanish and later ones
    move left, text counts as 0 and a number's prefix as that number. Both fail if rows or columns are missing.
    """
    if n <= 0 or features <= 0:
        raise ValueError("n and features must be positive")
    if mode not in ("strict", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    fields = F.split(F.regexp_replace("value", r"\r$", ""), ",", -1)
    rows = numbered_lines(spark, path).where(F.col("row_id") < n)
    if mode == "compat":
        parsed = rows.select("row_id", F.slice(F.filter(fields, lambda v: v != ""), 1, features).alias("fields"))
        x = F.transform("fields", _leading_number)
    else:
        parsed = rows.select("row_id", F.slice(fields, 1, features).alias("fields"))
        x = F.transform("fields", lambda v: v.cast("double"))
    found = parsed.agg(F.count("*").alias("n"), F.min(F.size("fields")).alias("least")).first()
    if found["n"] < n:
        raise ValueError(f"{path} has {found['n']} rows, {n} are needed")
    if found["least"] < features:
        raise ValueError(f"a row of {path} has {found['least']} columns, {features} are needed")
    return parsed.select("row_id", x.alias("x"))


def read_corpus(spark: SparkSession, path: str, text: str = "transcription", category: str = "medical_specialty") -> DataFrame:
    """docs(doc_id, text, category) from a CSV with header, or a folder of them in the order of their names; quoted fields can hold line breaks.

    Because of those a file is read by one task, so a large corpus should come in several.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = df.select(F.col(text).alias("text"), F.col(category).alias("category"), F.col("_metadata.file_path").alias("cumulo_file"))
    return numbered(rows, "doc_id", F.col("cumulo_file")).drop("cumulo_file")


def load_points(spark: SparkSession, source: str = "synthetic", path: str | None = None, n: int = 400, features: int = 50, clusters: int = 4, seed: int = 42, mode: str = "strict") -> DataFrame:
    """points(row_id, x) from the generator or a CSV; what can't be loaded is an error in either case."""
    if source == "synthetic":
        return bands(spark, n, features, clusters, seed).select("row_id", "x")
    if source == "csv":
        if not path:
            raise ValueError("a CSV source needs a path")
        return read_matrix(spark, path, n, features, mode)
    raise ValueError(f"unknown source {source!r}")


def fixed(c: Column, digits: int = 6) -> Column:
    """Text with so many decimals, without a negative zero. A tie in the shortest decimal form is rounded half up."""
    return F.format_string(f"%.{digits}f", F.when(F.round(c, digits) == 0, F.lit(0.0)).otherwise(c))


def write_rows(df: DataFrame, column: str, path: str, order: str = "row_id", digits: int | None = 6) -> None:
    """One headerless CSV line per row from an array of doubles, in row order across the files (part numbers ascend).

    digits: decimals; None writes each number in the shortest form that reads back as the same number.
    """
    line = F.array_join(F.transform(column, lambda v: v.cast("string") if digits is None else fixed(v, digits)), ",")
    df.orderBy(order).select(line.alias("value")).write.mode("overwrite").text(path)


def write_membership(memberships: DataFrame, path: str, as_text: bool = True) -> None:
    """Memberships (row_id, u): a CSV line of C numbers per point, or Parquet."""
    if as_text:
        write_rows(memberships, "u", path)
    else:
        memberships.select("row_id", "u").write.mode("overwrite").parquet(path)


def write_centroids(spark: SparkSession, centroids: list[list[float]], path: str) -> None:
    """Centroids, a CSV line of F numbers each; there are few of them, so one file."""
    rows = spark.createDataFrame([(j, [float(v) for v in c]) for j, c in enumerate(centroids)], "row_id bigint, x array<double>")
    write_rows(rows.coalesce(1), "x", path)


def write_features(points: DataFrame, path: str, digits: int | None = 6) -> None:
    write_rows(points, "x", path, digits=digits)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """(feature_index, feature_name) with a header, by index."""
    vocabulary.select("feature_index", "feature_name").orderBy("feature_index").write.mode("overwrite").csv(path, header=True)


def write_categories(docs: DataFrame, path: str) -> None:
    docs.orderBy("doc_id").select("category").write.mode("overwrite").csv(path, header=True)
