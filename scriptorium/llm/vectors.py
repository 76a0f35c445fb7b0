"""The k most similar vectors of every vector (problem 2).

Vectors are scaled to length 1; identical ones become one class, so a third of all rows being one vector is one search. Class
representatives get additive-quantisation codes and a list of close coarse cells. A representative asks in its closest cell only, and is a member of the few closest ones;
within a cell, codes are scored by table look-up, and the best are compared exactly. Neighbouring cells form districts: a vector travels once to each district that
holds one of its cells, not once to each cell, and all answers to a query come from one district.

Districts larger than a block are cut into blocks of members and of queries by hash, each pair of blocks a task of bounded size, so no member is left out and no group
is unbounded. Where cells hold fewer than k members, the query asks again with more cells a vector, in the end all.

The quantiser is fitted on at most `SAMPLE` hashed rows; every usable row is indexed. The cell count follows the rows up to `MAX_CELLS`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.quantizer import Quantizer, kmeans, nearest, unit
from scriptorium.session import materialize, skew_join

SAMPLE = 32_768
PER_CELL = 256
MAX_CELLS = 8_192
BLOCK, DISTRICT = 16_384, 16
BOOKS, WORDS, BEAM = 4, 256, 4


def _rows(col: pa.ChunkedArray | pa.Array, width: int, dtype: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)


def usable_vectors(df: DataFrame, dim: int = 64) -> DataFrame:
    """(vec_id, x): one row per vec_id, x the unit vector as float32 bytes.

    Null, short, long, all-zero and non-finite vectors and rows without vec_id are left out. Of several usable rows of one vec_id the largest counts.
    """
    v = F.col("embedding")
    fine = (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    one = df.where(F.col("vec_id").isNotNull() & fine).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) if b.num_rows else np.zeros((0, dim), np.float32)
            raw = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)], pa.binary())], names=["vec_id", "x"])

    return one.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>")).mapInArrow(pack, "vec_id bigint, x binary")


class Model:
    """The quantiser, and the district of every cell."""

    def __init__(self, q: Quantizer):
        self.q = q
        centres = kmeans(q.cells, max(1, len(q.cells) // DISTRICT), 10, np.random.default_rng(3))
        self.district = nearest(q.cells, centres)[:, 0]


def _fit(reps: DataFrame, n: int, dim: int) -> Model:
    """Fitted on the SAMPLE rows of the smallest hashes."""
    near = reps.select(F.xxhash64("vec_id").alias("h"), "vec_id", "x").orderBy("h", "vec_id").limit(SAMPLE)
    x = np.frombuffer(b"".join(r.x for r in near.collect()), np.float32).reshape(-1, dim)
    return Model(Quantizer.fit(x, int(min(MAX_CELLS, max(1, n // PER_CELL), len(x))), BOOKS, WORDS, BEAM))


def _search(table: pa.Table, q: Quantizer, dim: int, k: int, rerank: int) -> pa.Table:
    """Exact top k among the `rerank` members that score best by code, for every row that asks in one of the cells of a block. `home` is the cell in which a row asks, -1 for none."""
    ids, x, home = table.column("vec_id").to_numpy(), _rows(table.column("x"), dim), table.column("home").to_numpy()
    lists = table.column("cells").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    owner, cell = np.repeat(np.arange(len(ids)), sizes), lists.flatten().to_numpy()
    order = np.lexsort((ids[owner], cell))
    owner, cell = owner[order], cell[order]
    codes = _rows(table.column("codes"), q.books, np.uint8)
    norms = table.column("norm").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    asking = np.flatnonzero(home >= 0)
    asking = asking[np.argsort(home[asking], kind="stable")]
    for c in np.unique(home[asking]):
        own = asking[np.searchsorted(home[asking], c) : np.searchsorted(home[asking], c, side="right")]
        members = owner[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
        if not len(members):
            continue
        mids, mx, mc, mn = ids[members], x[members], codes[members], norms[members]
        step = max(1, (1 << 22) // len(members))
        for i in range(0, len(own), step):
            rows = own[i : i + step]
            scores = q.scores(x[rows], mc, mn)
            scores[ids[rows][:, None] == mids[None, :]] = -9
            top = np.argpartition(-scores, rerank - 1, axis=1)[:, :rerank] if rerank < len(members) else np.tile(np.arange(len(members)), (len(rows), 1))
            exact = np.einsum("qd,qrd->qr", x[rows], mx[top], optimize=True)
            exact[ids[rows][:, None] == mids[top]] = -9
            best = np.lexsort((mids[top], -exact), axis=1)[:, :k]
            found, sims = np.take_along_axis(mids[top], best, 1), np.take_along_axis(exact, best, 1)
            keep = sims > -2
            out.append((np.repeat(ids[rows], keep.sum(1)), found[keep], sims[keep]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.float32)]
    return pa.table({"vec_id": cols[0], "near": cols[1], "similarity": cols[2].astype(np.float32)})


def _ask(coded: DataFrame, model, pending: DataFrame | None, probes: int, dim: int, k: int, rerank: int) -> DataFrame:  # noqa: ANN001
    """(vec_id, list): the best of every asking vector, as structs of negative similarity and id; vectors are members of their `probes` closest cells. `pending(vec_id)` restricts who asks."""
    wanted = None
    if pending is not None:
        coded = coded.join(pending.withColumn("asks", F.lit(True)), "vec_id", "left")
        wanted = sorted(r.home for r in coded.where("asks").select("home").distinct().collect())  # at most MAX_CELLS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        use = np.ones(len(m.district), bool)
        if wanted is not None:
            use[:] = False
            use[wanted] = True
        for b in batches:
            x, home = _rows(b.column("x"), dim), b.column("home").to_numpy()
            asks = np.ones(len(home), bool) if wanted is None else b.column("asks").fill_null(False).to_numpy(zero_copy_only=False)
            cells = nearest(x, m.q.cells, probes)
            row, cell = np.repeat(np.arange(len(x)), probes), cells.ravel()
            row, cell = row[use[cell]], cell[use[cell]]
            where = m.district[cell]
            order = np.lexsort((where, row))
            row, cell, where = row[order], cell[order], where[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (where[1:] != where[:-1])])) if len(row) else np.zeros(0, np.int64)
            at = row[first]
            offsets = np.append(first, len(row)).astype(np.int32)
            here = asks[at] & (m.district[home[at]] == where[first])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[first].astype(np.int32)), b.column("vec_id").take(take), b.column("x").take(take), b.column("codes").take(take), b.column("norm").take(take), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32))), pa.array(np.where(here, home[at], -1).astype(np.int32))],
                names=["district", "vec_id", "x", "codes", "norm", "cells", "home"],
            )

    rows = coded.mapInArrow(place, "district int, vec_id bigint, x binary, codes binary, norm float, cells array<int>, home int")
    sizes = rows.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("home") >= 0).alias("q"))
    sizes = sizes.select("district", F.ceil(F.col("n") / BLOCK).cast("int").alias("mb"), F.greatest(F.lit(1), F.ceil(F.col("q") / BLOCK)).cast("int").alias("qb")).where("mb > 1 or qb > 1")
    rows = rows.join(F.broadcast(sizes), "district", "left").withColumns({"mb": F.coalesce("mb", F.lit(1)), "qb": F.coalesce("qb", F.lit(1))})  # at most MAX_CELLS rows
    own_m, own_q = F.pmod(F.xxhash64("vec_id"), F.col("mb")).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("qb")).cast("int")
    everything = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda m, q, member, asks: F.struct(m.cast("int").alias("m"), q.cast("int").alias("q"), F.lit(member).alias("member"), F.lit(asks).alias("asks"))
    both = F.concat(F.transform(everything(F.col("qb")), lambda j: block(own_m, j, True, False)), F.when(F.col("home") >= 0, F.transform(everything(F.col("mb")), lambda j: block(j, own_q, False, True))).otherwise(F.array().cast("array<struct<m:int,q:int,member:boolean,asks:boolean>>")))
    single = F.array(block(F.lit(0), F.lit(0), True, True))
    tasks = rows.withColumn("p", F.explode(F.when((F.col("mb") == 1) & (F.col("qb") == 1), single).otherwise(both)))
    tasks = tasks.select("district", F.col("p.m").alias("m"), F.col("p.q").alias("q"), "vec_id", "x", "codes", "norm", F.when(F.col("p.member"), F.col("cells")).otherwise(F.array().cast("array<int>")).alias("cells"), F.when(F.col("p.asks"), F.col("home")).otherwise(-1).alias("home"))
    found = tasks.groupBy("district", "m", "q").applyInArrow(lambda t: _search(t, model.value.q, dim, k, rerank), "vec_id bigint, near bigint, similarity float")
    pairs = F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("near").alias("id")))
    return found.groupBy("vec_id").agg(F.slice(F.array_sort(pairs), 1, k).alias("list"))  # k a block of members


def nearest_vectors(df: DataFrame, k: int = 5, probes: int = 8, rerank: int = 48, dim: int = 64) -> DataFrame:
    """(vec_id, near, similarity): for every usable vector its k most similar others by cosine.

    Equal similarities rank by id. Identical vectors are each other's nearest. An empty table gives an empty table; with fewer than k others
    all are listed. Vectors are members of their `probes` closest cells, and `rerank` members of the asked one are compared exactly.
    """
    spark = df.sparkSession
    vectors = materialize(usable_vectors(df, dim).withColumn("class", F.unhex(F.md5("x"))))
    ranked = vectors.select("class", "vec_id").withColumn("rn", F.row_number().over(W.partitionBy("class").orderBy("vec_id"))).where(f"rn <= {k + 1}")
    first = materialize(ranked.groupBy("class").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vec_id", F.col("ids")[0]))
    reps = vectors.join(first.select("vec_id"), "vec_id", "left_semi")
    n = first.count()
    if n == 0:
        return spark.createDataFrame([], "vec_id bigint, near bigint, similarity float")
    model = spark.sparkContext.broadcast(_fit(reps, n, dim))  # bounded by MAX_CELLS and the codebooks
    cells = len(model.value.q.cells)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value.q
        for b in batches:
            x = _rows(b.column("x"), dim)
            codes, norms = q.encode(x, BEAM)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array(nearest(x, q.cells)[:, 0])], names=["vec_id", "x", "codes", "norm", "home"])

    coded = materialize(reps.select("vec_id", "x").mapInArrow(code, "vec_id bigint, x binary, codes binary, norm float, home int"))
    probes = min(probes, cells)
    best = materialize(_ask(coded, model, None, probes, dim, k, rerank))
    enough = min(k, n - 1)
    while probes < cells:
        short = coded.select("vec_id").join(best.where(F.size("list") >= enough).select("vec_id"), "vec_id", "left_anti")
        if short.isEmpty():
            break
        probes = min(cells, 8 * probes)
        again = _ask(coded, model, materialize(short), probes, dim, k, rerank)
        best = materialize(best.join(again.select("vec_id"), "vec_id", "left_anti").union(again))
    # representatives stand for their classes: each listed one brings the first ids of its class, and the own class comes first
    heads = first.where(F.size("ids") > 1).select(F.col("vec_id").alias("near"), "ids")
    others = best.select("vec_id", F.explode("list").alias("l")).select("vec_id", F.col("l.id").alias("near"), F.col("l.s").alias("s")).join(heads, "near", "left")
    others = others.select("vec_id", "s", F.explode(F.coalesce("ids", F.array("near"))).alias("id")).groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "id"))), 1, k).alias("others"))
    lists = first.join(others, "vec_id", "left").select("class", F.concat(F.transform("ids", lambda i: F.struct(F.lit(-2.0).cast("float").alias("s"), i.alias("id"))), F.coalesce("others", F.array().cast("array<struct<s:float,id:bigint>>"))).alias("ranked"))
    out = skew_join(vectors.select("vec_id", "class"), lists, "class").select("vec_id", F.slice(F.filter("ranked", lambda r: r["id"] != F.col("vec_id")), 1, k).alias("near"))
    return out.select("vec_id", F.explode("near").alias("n")).select("vec_id", F.col("n.id").alias("near"), F.when(F.col("n.s") < -1.5, F.lit(1.0)).otherwise(-F.col("n.s")).cast("float").alias("similarity"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, of which at least one lists the other."""
    return near.select(F.least("vec_id", "near").alias("vec_a"), F.greatest("vec_id", "near").alias("vec_b")).distinct()
