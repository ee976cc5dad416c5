"""Sources: JSON lines, delimited catalogues, text lists, configurations; sinks with exclusive creation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velaspan.functions import text as T


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Records of JSON-lines files or folders; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, content) of lines that are no JSON, blank ones apart; numbered within each file.

    Files are split as for any other read. What comes before a block of a file
    is the sum of its earlier blocks' line counts, one row a block.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("content"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("lines", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bad = rows.where(F.trim("content") != "").where(F.try_parse_json("content").isNull())
    return bad.join(blocks, ["file", "block"]).select("file", (F.col("lines") + F.col("at") - F.col("first") + 1).cast("int").alias("line"), "content")


def with_origin(df: DataFrame) -> DataFrame:
    """Rows with the path of their file."""
    return df.select("*", F.col("_metadata.file_path").alias("source_path"))


def delimited(spark: SparkSession, path: str, required: Sequence[str], sep: str = ";") -> DataFrame:
    """A delimited file with a header (a byte-order mark is dropped): all columns as cleaned text; columns must be there."""
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    if missing := set(required) - set(df.columns):
        raise ValueError(f"columns missing in {path}: {sorted(missing)}")
    return df.select(*[T.clean(F.col(f"`{c}`")).alias(c) for c in df.columns])


def text_list(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """Distinct cleaned lines, without empty ones, in order."""
    lines = spark.read.text(path).select(T.clean(F.regexp_replace("value", "﻿", "")).alias(column))
    return lines.where(F.col(column) != "").distinct().orderBy(column)


def json_document(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """A JSON file that is one document, or one array of records."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def reviews(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(sha256, id, note) of review files, each a JSON document about one source; two about the same source are an error."""
    rows = json_document(spark, path, "sha256 string, segnalazioni array<struct<id:string,osservazione:string>>")
    if not rows.where("sha256 is null").isEmpty() or not rows.groupBy("sha256").count().where("count > 1").isEmpty():
        raise ValueError("reviews without a source, or several of one")
    return rows.select("sha256", F.inline("segnalazioni")).withColumnRenamed("osservazione", "note")


def config(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def file_hashes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, sha256, length) of files, by their bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    """Distinct municipality names of a catalogue."""
    out = delimited(spark, path, ["Comune"]).select(F.col("Comune").alias("name")).where("name <> ''").distinct()
    if out.isEmpty():
        raise ValueError("the catalogue of municipalities is empty")
    return out


def surveys(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, respondent, ...) of a survey catalogue; missing values and unknown respondents fail."""
    df = delimited(spark, path, ["codice_psn", "nome_indagine", "tipo_rispondente"]).distinct()
    bad = df.where("codice_psn = '' or nome_indagine = '' or tipo_rispondente not in ('imprese', 'famiglie_individui', 'altro', 'da_verificare')")
    if not bad.isEmpty():
        raise ValueError("surveys with missing values or an unknown respondent type")
    if not dependency_conflicts(df, ["codice_psn"], [c for c in df.columns if c != "codice_psn"]).isEmpty():
        raise ValueError("surveys whose code stands for different rows")
    return df.withColumnsRenamed({"codice_psn": "code", "nome_indagine": "name", "tipo_rispondente": "respondent"}).orderBy("code")


def dependency_conflicts(df: DataFrame, key: Sequence[str], dependents: Sequence[str]) -> DataFrame:
    """Keys with more than one value of their dependents, and how many."""
    return df.groupBy(*key).agg(F.count_distinct(F.struct(*dependents)).alias("variants")).where("variants > 1")


def catalogue(spark: SparkSession, names: str, surnames: str, towns: str, streets: str, survey_path: str) -> dict[str, DataFrame]:
    """The five catalogues, checked against each other: names, surnames, towns, streets, surveys; and ``stats``."""
    town_rows = delimited(spark, towns, ["Codice Comune (alfanumerico)", "Comune", "Codice catasto"])
    town = town_rows.select(F.col("Codice Comune (alfanumerico)").alias("code"), F.col("Comune").alias("town"), F.col("Codice catasto").alias("cadastre"))
    if not town.where("code = '' or town = '' or not (cadastre rlike '^[A-Z][0-9]{3}$')").isEmpty():
        raise ValueError("towns with an empty code or name, or a bad cadastral code")
    if not dependency_conflicts(town, ["code"], ["town", "cadastre"]).isEmpty():
        raise ValueError("towns whose code has several names or cadastral codes")
    town = town.distinct()
    rows = delimited(spark, streets, ["CODICE_ISTAT", "COMUNE", "ODONIMO"]).select(F.col("CODICE_ISTAT").alias("code"), F.col("COMUNE").alias("named"), F.col("ODONIMO").alias("street"))
    if not rows.where("code = '' or named = '' or street = ''").isEmpty():
        raise ValueError("streets with missing values")
    if not rows.join(town, "code", "left_anti").isEmpty():
        raise ValueError("streets of unknown towns")
    if not rows.join(town, "code").where("named <> town").isEmpty():
        raise ValueError("streets whose town has another name")
    street = rows.select("code", "street").distinct().join(town.select("code", "town"), "code")
    out = {"names": text_list(spark, names), "surnames": text_list(spark, surnames), "towns": town, "streets": street, "surveys": surveys(spark, survey_path)}
    counts = {k: v.agg(F.count("*").alias(k)) for k, v in out.items()}
    stats = rows.agg(F.count("*").alias("street_rows"))
    for c in counts.values():
        stats = stats.join(c)  # one row each
    out["stats"] = stats.withColumn("duplicates_removed", F.col("street_rows") - F.col("streets"))
    return out


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines in a new folder; an existing one is an error. Nulls are left out."""
    df.write.mode("errorifexists").json(path)


def replace_json_lines(df: DataFrame, path: str) -> None:
    """Write beside ``path``, move the old folder aside, the new one in, then delete the old one.

    A reader finds the old folder or the new one, but for the moment between
    two renames; after a failure one of them is there, under its own name or
    with ``.old`` behind it.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    staged, aside = f"{path}.staged", f"{path}.old"
    df.write.mode("overwrite").json(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(aside), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(aside)):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(at(staged), at(path)):
        fs.rename(at(aside), at(path))
        raise OSError(f"{staged} could not be renamed")
    fs.delete(at(aside), True)


def append_segment(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next numbered segment of a folder, and return its number."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    number = 1 + max([int(n.removeprefix("segment=")) for n in names if n.startswith("segment=")], default=0)
    df.write.mode("errorifexists").json(f"{path.rstrip('/')}/segment={number:03d}")
    return number


def write_report(report: dict, path: str | Path) -> None:
    """A report as indented JSON in a new file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)
        f.write("\n")


def json_array(df: DataFrame) -> DataFrame:
    """All rows as one JSON array, for small tables that must be one document."""
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
