"""Groups of documents that share prose, roots or authors, and partitions that keep groups whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import graph
from scriptorium.session import materialize, skew_join


STRATA = ("blog", "work", "gmail", "negative")


def smallest_connected(keys: DataFrame, node: str = "document_id", key: str = "key") -> DataFrame:
    """(node, group_id): the smallest node of all that are connected by shared keys. Null nodes are left out, null keys tie nothing; a node without key is its own group."""
    rows = keys.where(F.col(node).isNotNull()).select(node, key).distinct()
    by_node, _ = graph.tied(graph.named_nodes(rows.where(F.col(key).isNotNull()), key).select(node, "node"), node)
    by_node = materialize(by_node)
    smallest = by_node.groupBy("component").agg(F.min(node).alias("group_id"))
    found = skew_join(by_node, smallest, "component").select(node, "group_id")
    alone = rows.select(node).distinct().join(found, node, "left_anti")
    return found.union(alone.select(node, F.col(node).alias("group_id")))


def tie_keys(docs: DataFrame, least_words: int = 20) -> DataFrame:
    """(document_id, key) of `docs(document_id, root, author, label, text)`: root, squeezed body, each squeezed paragraph of `least_words` words or more, and for negatives (label 0) the author. Case counts."""
    body = T.squeeze(F.col("text"))
    long = F.filter(T.paragraphs(F.col("text")), lambda p: T.word_count(p) >= least_words)
    keys = F.array_union(
        F.array(F.concat(F.lit("r:"), F.col("root")), F.when(F.length(body) > 0, F.concat(F.lit("b:"), F.md5(body))), F.when((F.col("label") == 0) & (F.col("author") != ""), F.concat(F.lit("a:"), F.col("author")))),
        F.coalesce(F.transform(long, lambda p: F.concat(F.lit("p:"), F.md5(T.squeeze(p)))), F.array().cast("array<string>")),
    )
    return docs.select("document_id", F.explode(keys).alias("key")).where("key is not null")


def label_conflicts(groups: DataFrame) -> DataFrame:
    """(group_id, positives, negatives) of the groups of `groups(document_id, group_id, label)` that hold both labels."""
    n = groups.groupBy("group_id").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    return n.where("positives > 0 and negatives > 0")


def require_one_label(groups: DataFrame) -> DataFrame:
    """`groups`, unless a group holds both labels, which is an error: such prose has to be looked at before anything is fitted on it."""
    bad = label_conflicts(groups).select("group_id").limit(1).collect()
    if bad:
        raise ValueError(f"duplicate prose crosses labels, for example in group {bad[0].group_id}")
    return groups


def stratum(genre: Column) -> Column:
    """blog (also for a missing genre), work, gmail or negative."""
    g = F.coalesce(F.lower(F.trim(genre)), F.lit("blog"))
    return F.when(g == "work_email", "work").when(g == "gmail_email", "gmail").when(g == "blog", "blog").otherwise("negative")


def running_size(rows: DataFrame, by: list[str], order: str, size: str) -> DataFrame:
    """`rows` with `ahead`, the sum of `size` over the rows of the same `by` that come earlier by the hexadecimal digest `order`: 256 ranges of the digest first, then within a range."""
    g = rows.withColumn("_b", F.substring(order, 1, 2))
    per = g.groupBy(*by, "_b").agg(F.sum(size).alias("_n"))
    over = W.partitionBy(*by).orderBy("_b") if by else W.orderBy("_b")  # 256 rows for each of `by`
    per = per.select(*by, "_b", (F.sum("_n").over(over) - F.col("_n")).alias("_before"))
    within = W.partitionBy(*by, "_b").orderBy(order)
    return g.join(per, [*by, "_b"]).withColumn("ahead", F.col("_before") + F.sum(size).over(within) - F.col(size)).drop("_b", "_before")


def holdout(groups: DataFrame, seed: str = "42", share: float = 0.2, blog_share: float = 0.5, least_blogs: int = 3) -> DataFrame:
    """`groups(document_id, group_id, stratum)` with `held`: whole groups in hash order until a stratum's target is reached.

    The target is a share of the stratum's documents, rounded up, for `blog` its own share and at least `least_blogs` (all if there are fewer). Strata take turns, and a group that an earlier one
    has taken counts for the later ones in which it has documents.
    """
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    counts = materialize(groups.groupBy("group_id", "stratum").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r.stratum: r.n for r in counts.groupBy("stratum").agg(F.sum("n").alias("n")).collect()}  # four strata
    taken = None
    for name in STRATA:
        if not sizes.get(name):
            continue
        target = min(sizes[name], max(least_blogs, math.ceil(sizes[name] * blog_share))) if name == "blog" else math.ceil(sizes[name] * share)
        own, done = counts.where(F.col("stratum") == name), 0
        if taken is not None:
            done = own.join(taken, "group_id", "left_semi").agg(F.sum("n")).first()[0] or 0
            own = own.join(taken, "group_id", "left_anti")
        own = running_size(own.withColumn("x", F.md5(F.concat_ws("|", F.lit(seed), "stratum", "group_id"))), [], "x", "n")
        new = own.where(F.col("ahead") + done < target).select("group_id")
        taken = materialize(new if taken is None else taken.union(new))
    if taken is None:
        return groups.withColumn("held", F.lit(False))
    return skew_join(groups, taken.withColumn("held", F.lit(True)), "group_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def require_both_labels(split: DataFrame) -> DataFrame:
    """`split(…, held, label)`, unless a side lacks a label, which is an error."""
    sides = split.groupBy("held").agg(F.count_distinct("label").alias("n")).collect()
    if len(sides) < 2 or any(r.n < 2 for r in sides):
        raise ValueError("development and hold-out need both labels")
    return split


def fingerprint(docs: DataFrame, *cols: str) -> DataFrame:
    """(rows, digest): a digest of a table's distinct rows that doesn't depend on their order."""
    h = docs.select(*cols).distinct().select(F.xxhash64(*cols).alias("a"), F.xxhash64(*cols, F.lit(1)).alias("b"))
    return h.agg(F.count(F.lit(1)).alias("rows"), F.concat(F.lpad(F.hex(F.coalesce(F.bit_xor("a"), F.lit(0))), 16, "0"), F.lpad(F.hex(F.coalesce(F.bit_xor("b"), F.lit(0))), 16, "0")).alias("digest"))


def folds(groups: DataFrame, n: int = 3, seed: str = "42") -> DataFrame:
    """`groups(document_id, group_id, label)` with `fold`: stratified, whole groups.

    Groups of equal numbers of positives and negatives are dealt out in turn, in hash order, so every fold gets its share of each kind. There are at most as many folds as groups of the rarer label; fewer than
    two are an error. Where some fold would leave the others fewer than two positive groups or a single label, groups go alternately, in order, to two folds.
    """
    size = groups.groupBy("group_id").agg(F.count_if(F.col("label") == 1).cast("int").alias("p"), F.count_if(F.col("label") == 0).cast("int").alias("q"))
    size = materialize(size.withColumns({"x": F.md5(F.concat_ws("|", F.lit(seed), "group_id")), "one": F.lit(1)}))
    total = size.agg(F.count_if(F.col("p") > 0).alias("pos"), F.count_if(F.col("q") > 0).alias("neg")).first()
    n = min(n, total.pos, total.neg)
    if n < 2:
        raise ValueError("too few independent groups of a label")
    dealt = materialize(running_size(size, ["p", "q"], "x", "one").select("group_id", "p", "q", "x", "one", F.pmod("ahead", F.lit(n)).cast("int").alias("fold")))
    per = dealt.groupBy("fold").agg(F.count_if(F.col("p") > 0).alias("pos"), F.count_if(F.col("q") > 0).alias("neg")).collect()
    if any(total.pos - r.pos < 2 or total.neg - r.neg < 1 for r in per):
        label = (F.col("p") > 0).cast("int")
        ordered = size.withColumn("label", label).withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("group_id")))  # only where groups are so few that dealing fails
        dealt = ordered.select("group_id", F.pmod(F.col("k") - 1, F.lit(2)).cast("int").alias("fold"))
    return skew_join(groups, dealt.select("group_id", "fold"), "group_id")


def genre_label(genre: Column) -> Column:
    """1 for blog, work and personal mail (and for a missing genre), else 0."""
    return F.coalesce(F.lower(F.trim(genre)), F.lit("blog")).isin("blog", "work_email", "gmail_email").cast("int")


def last_of_each(df: DataFrame, by: str, order: str, tie: str) -> DataFrame:
    """The last row of every value of `by` by `order`, then `tie`; a hot value is reduced before it is shuffled."""
    w = W.partitionBy(by).orderBy(F.desc_nulls_last(order), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
