"""Delimited files: legacy encodings, byte order marks, untidy headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch.session import stage

BOM = "\ufeff"

# Names Spark's CSV source understands. The two code pages need spark.sql.legacy.javaCharsets.
CHARSET = {"cp949": "x-windows-949", "cp1252": "windows-1252", "utf-8": "UTF-8", "utf-8-sig": "UTF-8"}


def _charset(spark: SparkSession, encoding: str) -> str:
    """The charset's name. A code page needs a session setting that stays on, because Spark asks for it when the plan runs."""
    charset = CHARSET[encoding.lower()]
    if charset != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return charset


def file_encodings(spark: SparkSession, path: str, legacy: str = "cp949") -> DataFrame:
    """(file, encoding): ``utf-8`` for a file of which every line is valid UTF-8, else the legacy code page."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    return lines.groupBy("file").agg(F.when(F.bool_and("valid"), "utf-8").otherwise(legacy).alias("encoding"))


def find_encoding(spark: SparkSession, path: str, legacy: str = "cp949") -> str:
    """``utf-8`` when every line of the files is valid UTF-8, else the legacy code page.

    The lines are checked where they are read; one boolean comes back.
    """
    lines = spark.read.text(path)
    valid = lines.agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    return "utf-8" if valid or valid is None else legacy


def read_delimited(
    spark: SparkSession, path: str, encoding: str | None = "utf-8", sep: str = ",", schema: str | None = None,
    multiline: bool = False, legacy: str = "cp949",
) -> DataFrame:
    """Read files with a header. All columns are strings without a schema.

    ``encoding=None`` decides per file: the folder is read once in each encoding and every file is kept from the reading
    that is right for it, so a folder may hold both kinds. The headers must then agree once they are decoded.
    """
    if encoding is None:
        found = stage(file_encodings(spark, path, legacy), "encodings")
        kinds = [r[0] for r in found.select("encoding").distinct().orderBy(F.col("encoding") != "utf-8").collect()] or ["utf-8"]
        parts = [(kind, _read(spark, path, kind, sep, schema, multiline)) for kind in kinds]
        if len(parts) == 1:
            return parts[0][1]
        out = None
        for kind, rows in parts:
            right = found.filter(F.col("encoding") == kind).select(F.col("file").alias("_file"))
            own = rows.withColumn("_file", F.col("_metadata.file_path")).join(right, "_file", "left_semi").drop("_file")
            out = own if out is None else out.unionByName(own.toDF(*out.columns))
        return out
    return _read(spark, path, encoding, sep, schema, multiline)


def _read(spark: SparkSession, path: str, encoding: str, sep: str, schema: str | None, multiline: bool) -> DataFrame:
    reader = (
        spark.read.option("header", True).option("sep", sep).option("escape", '"')
        .option("encoding", _charset(spark, encoding)).option("multiLine", multiline)
    )
    if schema:
        reader = reader.schema(schema).option("enforceSchema", True)
    return tidy_header(reader.csv(path))


def tidy_header(df: DataFrame, lower: bool = False) -> DataFrame:
    """Header names without byte order mark and outer blanks, lowercased on request."""
    names = [c.removeprefix(BOM).strip() for c in df.columns]
    return df.toDF(*[n.lower() if lower else n for n in names])


def column_named(df: DataFrame, *names: str) -> str | None:
    """Real name of the first column that matches one of the names in any case."""
    found = {c.strip().lower(): c for c in df.columns}
    for name in names:
        if name.strip().lower() in found:
            return found[name.strip().lower()]
    return None


def write_delimited(
    df: DataFrame, path: str, encoding: str = "utf-8", sep: str = ",", mode: str = "error"
) -> None:
    """Write files with a header; ``utf-8-sig`` starts each file with a byte order mark."""
    if encoding == "utf-8-sig":
        first = df.columns[0]
        df = df.withColumnRenamed(first, BOM + first)
    (
        df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
        .option("emptyValue", "").option("encoding", _charset(df.sparkSession, encoding)).csv(path)
    )
