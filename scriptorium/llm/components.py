"""Groups of records that must stay together, and splits that never cut one (problem 4).

Components come from frontier breadth-first search with many seeds at once over hash-partitioned adjacency rows, with colliding seeds merged in smaller graphs (`operators.graph`). Nodes are keys, not
documents; whole components fill the splits in hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators import graph
from scriptorium.session import materialize, skew_join

PLACEHOLDERS = ("", "unknown", "n/a", "-")


def author_key(c: Column) -> Column:
    """author_id trimmed and lower-cased; null, blank and placeholders give null."""
    key = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(~key.isin(*PLACEHOLDERS), key)


def tie_keys(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(document_id, kind, key): the keys that tie a document to others: `a` its author key, `r` its root and the roots of its passages.

    Repeated rows count once; rows without document_id are left out; passages of documents that are not there tie nothing.
    """
    d = docs.where("document_id is not null").select("document_id", author_key(F.col("author_id")).alias("a"), F.coalesce("root_document_id", "document_id").alias("r"))
    own = d.select("document_id", F.explode(F.array(F.struct(F.lit("a").alias("kind"), F.col("a").alias("key")), F.struct(F.lit("r").alias("kind"), F.col("r").alias("key")))).alias("t")).select("document_id", "t.kind", "t.key").where("key is not null")
    roots = passages.where("root_document_id is not null").select("document_id", F.lit("r").alias("kind"), F.col("root_document_id").alias("key")).distinct()
    known = d.select("document_id").distinct()
    return own.union(roots.join(known, "document_id", "left_semi")).distinct()


def tied_groups(docs: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents tied by author, root or the roots of their passages.

    Returns (document_id, component) and (author_key, component).
    """
    ties = graph.named_nodes(tie_keys(docs, passages), "kind", "key")
    by_doc, comp = graph.tied(ties.select("document_id", "node"), "document_id")
    authors = ties.where("kind = 'a'").select("key", "node").distinct()
    by_author = authors.join(comp.withColumnRenamed("id", "node"), "node").select(F.col("key").alias("author_key"), "component")
    return by_doc, by_author


def component_classes(by_author: DataFrame) -> DataFrame:
    """(author_key, component, others): every author key with its component and how many others are in it; nothing is paired."""
    size = by_author.groupBy("component").agg((F.count(F.lit(1)) - 1).alias("others"))
    return skew_join(by_author, size, "component").select("author_key", "component", "others")


def authors_that_share(by_author: DataFrame) -> DataFrame:
    """(author_a, author_b), author_a < author_b: pairs of author keys in one component."""
    a = by_author.select("component", F.col("author_key").alias("author_a"))
    b = by_author.select("component", F.col("author_key").alias("author_b"))
    return a.join(b, "component").where("author_a < author_b").select("author_a", "author_b")


def assign_splits(by_doc: DataFrame, targets: DataFrame, buckets: int = 1024) -> DataFrame:
    """(document_id, component, split) with whole components in hash order filling the target shares.

    `targets(split, target_share)` is a handful of rows; shares are normalised to sum to 1. The running size is a two-level prefix
    sum (buckets of the hash, then within a bucket), so no window holds all rows. A component goes to the split in which its middle falls; this
    keeps a component that is larger than a share from shifting all later ones. Components of one document dominate the remainder and level the shares.
    """
    size = by_doc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.xxhash64("component")).withColumn("bucket", F.pmod(F.shiftrightunsigned("x", 40), F.lit(buckets)))
    size = materialize(size)
    per = size.groupBy("bucket").agg(F.sum("n").alias("bn"))
    before = per.select("bucket", (F.sum("bn").over(W.orderBy("bucket")) - F.col("bn")).alias("before"), F.sum("bn").over(W.partitionBy()).alias("total"))  # at most `buckets` rows
    within = W.partitionBy("bucket").orderBy("x", "component")
    placed = size.join(F.broadcast(before), "bucket").select("component", ((F.col("before") + F.sum("n").over(within) - F.col("n") / 2) / F.col("total")).alias("at"))
    t = targets.where("split is not null and target_share > 0").groupBy("split").agg(F.max("target_share").alias("w"))
    bounds = t.select("split", (F.sum("w").over(W.orderBy(F.desc("w"), "split")) / F.sum("w").over(W.partitionBy())).alias("hi"), F.col("w"), F.sum("w").over(W.partitionBy()).alias("all"))
    bounds = bounds.select(F.struct("hi", "split").alias("b")).agg(F.array_sort(F.collect_list("b")).alias("bounds"))  # a row of a few splits
    pick = F.get(F.filter("bounds", lambda b: b["hi"] > F.col("at")), F.lit(0))["split"]
    last = F.element_at("bounds", -1)["split"]
    chosen = placed.crossJoin(F.broadcast(bounds)).select("component", F.coalesce(pick, last).alias("split"))
    return skew_join(by_doc, chosen, "component").select("document_id", "component", "split")
