"""Chains of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize, skew_join


def origins(rows: DataFrame, rounds: int = 64) -> DataFrame:
    """(document_id, origin, steps, visible) of `rows(document_id, parent, visible)`, one row per document: the end of its chain of parents, that is a document that is its own parent.

    Steps count the parents on the way; visible holds if all documents on the way, both ends included, are. Chains that leave the table or run in a circle have null in all three. Every round looks twice as
    far as the one before, so a chain of n parents takes about log2(n) rounds; a parent of a third of all rows is salted.
    """
    top = F.col("parent") == F.col("document_id")
    state = materialize(rows.select("document_id", F.col("parent").alias("at"), (~top).cast("int").alias("steps"), "visible", top.alias("done")))
    for _ in range(rounds):
        ahead = state.select(F.col("document_id").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"), F.col("visible").alias("seen"), F.col("done").alias("there"))
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        # a parent that is its own parent ends the chain; any other passes on where it has got to itself
        moved = skew_join(open_, ahead, "at").where("further <> document_id")
        moved = moved.select("document_id", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("visible") & F.col("seen")).alias("visible"), F.col("there").alias("done"))
        state = materialize(state.where("done").unionByName(moved))
    found = state.where("done").select("document_id", F.col("at").alias("origin"), "steps", "visible")
    return rows.select("document_id").join(found, "document_id", "left")
