"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import chunks, components, mail, mixing, overlap, packing, pieces, sentences, subjects, tokens, vectors
from scriptorium.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Prose of train and of another split that is the same or almost the same."""
    return overlap.document_pairs(*overlap.overlaps(overlap.split_sides(table(spark, d, "corpus_docs")), 0.6)).select("doc_a", "doc_b")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """How much evaluation prose occurs in train, per split and source type, with spans and counts."""
    docs = table(spark, d, "corpus_docs")
    return overlap.overlap_report(docs, *overlap.overlaps(overlap.split_sides(docs), 0.6))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every prose document with its class of equal texts and how many documents of the other side overlap it."""
    return overlap.document_links(*overlap.overlaps(overlap.split_sides(table(spark, d, "corpus_docs")), 0.6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of usable vectors of which one is among the 5 most similar of the other."""
    return vectors.neighbour_pairs(vectors.nearest_vectors(table(spark, d, "passage_vectors")))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    prose = overlap.prose(table(spark, d, "corpus_docs")).select(F.col("document_id").alias("record"), F.col("clean_text").alias("text"))
    return prose.union(table(spark, d, "manifest_rows").select("sample_id", "excerpt"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that share at least 200 consecutive code points."""
    return chunks.record_pairs(*chunks.shared_spans(_texts(spark, d)))


def p3_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The stretches that records share, between one record of each text."""
    return chunks.stretches(*chunks.shared_spans(_texts(spark, d)))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the class of its text and the number of texts linked to it."""
    return chunks.classes(*chunks.shared_spans(_texts(spark, d)))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many code points of each record occur elsewhere."""
    texts = _texts(spark, d)
    return chunks.coverage(*chunks.shared_spans(texts), texts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of author keys that must share a split."""
    return components.authors_that_share(components.tied_groups(table(spark, d, "corpus_docs"), table(spark, d, "passages"))[1])


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every author key with the component it is in and the number of other keys there."""
    return components.component_classes(components.tied_groups(table(spark, d, "corpus_docs"), table(spark, d, "passages"))[1]).select("author_key", "others")


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its split."""
    by_doc, _ = components.tied_groups(table(spark, d, "corpus_docs"), table(spark, d, "passages"))
    return components.assign_splits(by_doc, table(spark, d, "split_targets")).select("document_id", "split")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages of more than 700 words or 5,000 code points: those that the cutter cuts."""
    return pieces.oversized_passages(table(spark, d, "passages"), table(spark, d, "corpus_docs"))


def p5_file_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All prose as a few giant files in the shared folder, cut by byte ranges; one row per piece."""
    return pieces.split_files(spark, pieces.text_files(overlap.prose(table(spark, d, "corpus_docs")).select(F.col("clean_text").alias("text")))).drop("path")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of these passages."""
    return pieces.passage_pieces(table(spark, d, "passages"), table(spark, d, "corpus_docs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of prose."""
    docs = overlap.prose(table(spark, d, "corpus_docs")).select("document_id", F.col("clean_text").alias("text"))
    return sentences.sentences(docs).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of e-mails that the sender newly wrote."""
    return mail.new_lines(table(spark, d, "corpus_docs")).select("document_id", "line_no").distinct()


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    """Every e-mail as its clean_text should be; mails without a new line have none."""
    return mail.new_text(mail.new_lines(table(spark, d, "corpus_docs")))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """All texts in containers of each capacity."""
    return packing.pack_texts(materialize(tokens.sized(table(spark, d, "documents")).select("doc_id", "tokens")), table(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(materialize(p8_pack(spark, d)), table(spark, d, "pack_sizes"))


def _mixes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialize(mixing.one_per_text(tokens.sized(table(spark, d, "documents"))))
    return mixing.mix_sources(sizes, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts of every mix and how often each is used."""
    return _mixes(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return _mixes(spark, d)[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of every document."""
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject."""
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_report, p1_links, p2_found, p3_found, p3_stretches, p3_classes, p3_coverage, p4_found, p4_groups, p4_split, p5_found, p5_pieces, p5_file_pieces, p6_found, p7_found, p7_text, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_composition)}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p5_found": P5_FOUND}


_REACH = """
WITH RECURSIVE d AS (
  SELECT DISTINCT document_id, CASE WHEN lower(trim(author_id)) NOT IN ('', 'unknown', 'n/a', '-') THEN lower(trim(author_id)) END AS a,
         coalesce(root_document_id, document_id) AS r FROM corpus_docs),
ties AS (
  SELECT document_id, 'a' || a AS k FROM d WHERE a IS NOT NULL
  UNION SELECT document_id, 'r' || r FROM d
  UNION SELECT p.document_id, 'r' || p.root_document_id FROM passages p WHERE p.root_document_id IS NOT NULL AND p.document_id IN (SELECT document_id FROM d)),
e AS (SELECT DISTINCT x.k AS u, y.k AS v FROM ties x JOIN ties y USING (document_id) WHERE x.k <> y.k),
reach(src, k) AS (SELECT DISTINCT k, k FROM ties WHERE k LIKE 'a%' UNION SELECT reach.src, e.v FROM reach JOIN e ON reach.k = e.u)
"""
P4_FOUND = f"{_REACH} SELECT substr(src, 2) AS author_a, substr(k, 2) AS author_b FROM reach WHERE k LIKE 'a%' AND src < k"
P4_GROUPS = f"{_REACH} SELECT substr(src, 2) AS author_key, count(*) - 1 AS others FROM reach WHERE k LIKE 'a%' GROUP BY src"

P5_FOUND = r"""
WITH t AS (
  SELECT document_id, passage_id, text FROM passages WHERE text IS NOT NULL
  UNION SELECT p.document_id, p.passage_id, substring(d.clean_text, p.start_char + 1, p.end_char - p.start_char)
  FROM passages p JOIN (SELECT document_id, max_by(clean_text, loaded_at) AS clean_text FROM corpus_docs WHERE clean_text IS NOT NULL GROUP BY 1) d USING (document_id) WHERE p.text IS NULL)
SELECT DISTINCT document_id, passage_id FROM t WHERE length(text) > 5000 OR len(regexp_extract_all(text, '[\pL\pN_]+(?:[''’][\pL\pN_]+)*')) > 700
"""
