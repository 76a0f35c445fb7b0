"""Corpus scans: Markdown, e-mail text and mixed foreign corpora from directories, with front matter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from scriptorium.functions import cleaning
from scriptorium.functions import text as T

def _mapping(text: str | None, strict: bool) -> dict[str, str] | None:
    import yaml

    block = None if text is None else cleaning.front_matter(text)[0]
    if block is None:
        return None if text is None else {}
    try:
        found = yaml.safe_load(block)
        if found is not None and not isinstance(found, dict):
            raise ValueError("front matter must be a mapping")
    except (yaml.YAMLError, ValueError):
        if strict:
            raise
        lines = (x.partition(":") for x in block.splitlines() if x[:1].strip() and ":" in x)
        found = {k.strip(): v.strip() for k, _, v in lines}
    return {str(k): str(v) for k, v in (found or {}).items()}


@F.pandas_udf(MapType(StringType(), StringType()))
def _strict(raw: pd.Series) -> pd.Series:
    return pd.Series([_mapping(t, True) for t in raw], dtype=object)


@F.pandas_udf(MapType(StringType(), StringType()))
def _lenient(raw: pd.Series) -> pd.Series:
    return pd.Series([_mapping(t, False) for t in raw], dtype=object)


def front_matter(raw: Column, strict: bool = True) -> Column:
    """map<string,string> of the YAML mapping at the very start; empty where there is none, null for null. Anything but a mapping, and bad YAML, stops the query, or if not `strict` is read as plain `key: value` lines."""
    return _strict(raw) if strict else _lenient(raw)


@F.pandas_udf(StringType())
def _body(raw: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cleaning.front_matter(t)[1] for t in raw], dtype=object)


def body(raw: Column) -> Column:
    """The text after the front matter."""
    return _body(raw)


def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(document_id, source_file, raw, file_hash): files below `path` by suffix, whatever its case; the id is the path below it. No such file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    if files.select("path").limit(1).count() == 0:
        raise ValueError(f"no {' '.join(suffixes)} file below {path}")
    root = path.rstrip("/").removeprefix("file:").lstrip("/")
    return files.select(F.regexp_replace("path", rf"^[a-z0-9]+:/+\Q{root}\E/", "").alias("document_id"), F.col("path").alias("source_file"), F.decode("content", "UTF-8").alias("raw"), F.sha2("content", 256).alias("file_hash"))


def _checked(docs: DataFrame, least: int) -> DataFrame:
    """Documents; one with too few words stops the query when it is read."""
    few = T.word_count(F.col("clean_text")) < least
    return docs.withColumn("clean_text", F.when(few, F.raise_error(F.concat(F.lit("no usable prose in "), F.col("document_id")))).otherwise(F.col("clean_text")))


def _columns(docs: DataFrame, genre: Column, prefix: str = "") -> DataFrame:
    meta = F.col("metadata")
    author = F.coalesce(meta["author"], F.lit(None))
    return docs.select(
        F.concat(F.lit(prefix), F.col("document_id")).alias("document_id"), "source_file", F.col("raw").alias("raw_markdown"), "clean_text", "file_hash", author.alias("author"), "metadata",
        F.coalesce(meta["root_document_id"], F.concat(F.lit(prefix), F.col("document_id"))).alias("root_document_id"), F.coalesce(meta["author_id"], author).alias("author_id"), meta["source_type"].alias("source_type"), genre.alias("genre"),
    )


def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown corpus: one row per .md, .markdown or .mdown file, cleaned; files without a word are an error."""
    docs = scan(spark, path, (".md", ".markdown", ".mdown")).withColumn("metadata", front_matter(F.col("raw"))).withColumn("clean_text", T.clean_markdown(F.col("raw")))
    return _columns(_checked(docs, 1), F.coalesce(F.col("metadata")["genre"], F.lit("blog")))


def load_email(spark: SparkSession, path: str, source: str = "work", author: str | None = None) -> DataFrame:
    """E-mail corpus: .txt files, ids below `source/`, genre `{source}_email`; fewer than three words are an error."""
    docs = scan(spark, path, (".txt",)).withColumn("metadata", F.create_map().cast("map<string,string>")).withColumn("clean_text", T.clean_email(F.col("raw"), F.lit(author) if author else None))
    return _columns(_checked(docs, 3), F.lit(f"{source}_email"), f"{source}/")


def load_foreign(spark: SparkSession, path: str) -> DataFrame:
    """Corpus of other authors: Markdown, and .txt as e-mail; without an author_id the parent folder stands for the author."""
    docs = scan(spark, path, (".md", ".markdown", ".mdown", ".txt")).withColumn("metadata", front_matter(F.col("raw")))
    mail = F.lower("document_id").endswith(".txt") | (F.lower(F.coalesce(F.col("metadata")["source_type"], F.lit(""))) == "email")
    docs = docs.withColumn("clean_text", F.when(mail, T.clean_foreign_email(body(F.col("raw")), F.col("metadata")["author"])).otherwise(T.clean_markdown(F.col("raw"))))
    out = _columns(_checked(docs, 1), F.lit("negative"), "negative/")
    folder = F.nullif(F.regexp_extract("document_id", r"([^/]+)/[^/]+$", 1), F.lit("negative"))
    return out.withColumn("author_id", F.coalesce("author_id", folder)).withColumn("source_type", F.when(mail_of(out), "email").otherwise(F.col("source_type")))


def mail_of(docs: DataFrame) -> Column:
    return F.lower(docs["document_id"]).endswith(".txt") | (F.lower(F.coalesce(docs["source_type"], F.lit(""))) == "email")
