"""Mixing sources to target shares (problem 9), by pivotal dependent rounding.

A source's texts are all wanted equally often: target tokens by tokens there are, at most max_repeats times. The whole part is taken; the fractional parts are rounded in
pairs: two texts exchange chance, weighed by their sizes and in a random direction, until one of them is certain. So the expected copies of every text and the tokens
of the source are kept. Pairs are settled within buckets of a bounded size; the one text per bucket that stays uncertain goes up a
reduction tree, until one is left per source, which is drawn.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize

BUCKET, FAN = 10_000, 1_000
SETTLED = "mix string, source string, doc_id bigint, tokens bigint, bucket bigint, chance double"


def settle(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Rounded chances: all 0 or 1 but for one at most; the sum of size times chance stays as it is, up to rounding errors."""
    out = list(chances)
    live = -1
    for i, p in enumerate(out):
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[i] = float(p > 0.5)
            continue
        if live < 0:
            live = i
            continue
        a, b, u, v = out[live], p, sizes[live], sizes[i]
        # mass (in tokens) that can go either way
        up, down = min((1 - a) * u, b * v), min(a * u, (1 - b) * v)
        if rng.random() * (up + down) < down:
            a, b = a + up / u, b - up / v
        else:
            a, b = a - down / u, b + down / v
        done_a = a <= 1e-12 or a >= 1 - 1e-12
        out[live], out[i] = (float(a > 0.5) if done_a else a), b
        if b <= 1e-12 or b >= 1 - 1e-12:
            out[i] = float(b > 0.5)
            live = -1 if done_a else live
        elif done_a:
            live = i
    return out


def _bucket(t: pa.Table, seed: int, last: bool) -> pa.Table:
    order = np.lexsort((t.column("doc_id").to_numpy(),))
    t = t.take(pa.array(order))
    rng = random.Random(f"{seed}/{t.column('mix')[0]}/{t.column('source')[0]}/{t.column('bucket')[0]}")
    order = list(range(t.num_rows))
    rng.shuffle(order)
    # from large to small: texts of like size settle each other, and what stays uncertain is small
    sizes = t.column("tokens").to_pylist()
    t = t.take(pa.array(sorted(order, key=lambda i: -sizes[i])))
    chances = settle(t.column("tokens").to_pylist(), t.column("chance").to_pylist(), rng)
    if last:
        chances = [c if c in (0.0, 1.0) else float(rng.random() < c) for c in chances]
    return t.set_column(t.schema.get_field_index("chance"), "chance", pa.array(chances, pa.float64()))


def wanted(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix, source, share, max_repeats, have, times): how often each text of a source is wanted.

    Without `total_tokens` a mix is as large as its scarcest source allows; with it, sources that run out give all they may and the mix is smaller.
    Shares are normalised within the mix over the targets given; a source without texts gives none.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have"))
    t = targets.where("mix is not null and source is not null and target_share > 0").groupBy("mix", F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    whole = t.groupBy("mix").agg(F.sum("share").alias("whole"))
    t = t.join(whole, "mix").select("mix", "source", (F.col("share") / F.col("whole")).alias("share"), "max_repeats").join(have, "source", "left")
    limit = t.where("have > 0 and max_repeats > 0").groupBy("mix").agg(F.min(F.col("have") * F.col("max_repeats") / F.col("share")).alias("total"))
    total = F.lit(float(total_tokens)) if total_tokens else F.col("total")
    times = F.least(F.col("max_repeats").cast("double"), F.col("share") * total / F.col("have"))
    return t.join(limit, "mix", "left").select("mix", "source", "share", "max_repeats", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce(times, F.lit(0.0)).alias("times"))


def one_per_text(sizes: DataFrame) -> DataFrame:
    """Texts under several doc_ids count as one: the smallest doc_id stands for them, with its source."""
    return sizes.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x")).select("x.*")


def mix_sources(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mixes and their report.

    `sizes(doc_id, source, tokens)` holds one row per text; `targets(mix, source, target_share, max_repeats)` is small. Returns (mix, source, doc_id, tokens, copies)
    of the texts used, no more than max_repeats times each, and (mix, source, target_share, reached_share, texts, tokens, most_copies) for every target.
    """
    sizes = sizes.where("doc_id is not null and source is not null and tokens > 0")
    plan = materialize(wanted(sizes, targets, total_tokens))
    rows = sizes.join(F.broadcast(plan), "source").where("times > 0")  # targets: a few rows per mix
    whole = F.floor(F.col("times") + 1e-9)
    rows = rows.select("mix", "source", "doc_id", "tokens", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("times") - whole).alias("chance"))
    count = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-count // BUCKET))
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets))))
    open_ = rows.where("chance > 0").select("mix", "source", "doc_id", "tokens", "bucket", "chance")
    settled = []
    step = lambda last: lambda t: _bucket(t, seed, last)
    while True:
        last = buckets == 1
        done = materialize(open_.groupBy("mix", "source", "bucket").applyInArrow(step(last), SETTLED))
        settled.append(done.where("chance = 1").select("mix", "doc_id"))
        if last:
            break
        buckets = -(-buckets // FAN)
        open_ = done.where("chance > 0 and chance < 1").withColumn("bucket", F.col("bucket") % buckets)
    drawn = settled[0]
    for s in settled[1:]:
        drawn = drawn.union(s)
    copies = rows.join(drawn.withColumn("more", F.lit(1)), ["mix", "doc_id"], "left").select("mix", "source", "doc_id", "tokens", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("copies")).where("copies > 0")
    copies = materialize(copies)
    used = copies.groupBy("mix", "source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    all_ = used.groupBy("mix").agg(F.sum("tokens").alias("all"))
    report = plan.join(used, ["mix", "source"], "left").join(all_, "mix", "left").select(
        "mix", "source", F.round("share", 6).alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("reached_share"),
        F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return copies, report
