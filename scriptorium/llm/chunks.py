"""Long exact spans shared between records (problem 3), by content-defined chunks.

A gear hash rolls over the code points. Anchors are the places that hold the smallest hash of some window (so no two are further apart than a window),
and depend on nearby content only: an insertion moves them along and changes none further off. From every anchor a chunk runs to the first anchor at least `reach`
further on. The numbers are such that any stretch of `span` code points that two records share holds a whole chunk cut alike in both; chunks are then looked up by digest.

Records that share a digest are candidates. A digest in more than HOT records is not paired but replaced by the digests of all stretches of
`span` code points around it, so that boilerplate that is shorter than `span` yields no pair. All candidates are checked on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.session import materialize, skew_join

GEAR, WINDOW = 16, 32
BLOCK = 1 << 19
HOT = 64
SHARD_CHARS = 4_000_000
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def reach(span: int) -> int:
    """Least distance from a chunk's first to its last anchor."""
    return span - GEAR - 3 * (WINDOW - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, BLOCK), base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


class Digests:
    """Digests of any stretch of a block, from running sums."""

    def __init__(self, points: np.ndarray):
        self.symbols = _mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        n = len(points)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.symbols * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + width] for every i; width is a power of two."""
    step = 1
    while step < width:
        x = f(x[:-step], x[step:])
        step *= 2
    return x


def anchors(symbols: np.ndarray) -> np.ndarray:
    """Places (of a gear window's last code point) that hold the least hash of some window."""
    if len(symbols) < GEAR + WINDOW:
        return np.zeros(0, np.int64)
    h, step = symbols, 1
    while step < GEAR:
        h = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    h = h * np.uint64(0x9E3779B97F4A7C15)
    low = _slide(h, WINDOW, np.minimum)
    full = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)])
    return np.flatnonzero(_slide(full, WINDOW, np.maximum) == h) + GEAR - 1


def chunks(digests: Digests, span: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and digest of the chunks of a block of records; `ends` are the records' ends. No chunk crosses one."""
    a = anchors(digests.symbols)
    if not len(a):
        return a, a, a.astype(np.uint64)
    to = np.searchsorted(a, a + reach(span))
    some = to < len(a)
    start, end = a[some] - GEAR + 1, a[np.minimum(to, len(a) - 1)][some] + 1
    inside = np.searchsorted(ends, start, side="right") == np.searchsorted(ends, end - 1, side="right")
    start, end = start[inside], end[inside]
    return start, end, digests.of(start, end)


def _blocks(ids: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    own, parts, size = [], [], 0
    for i, t in zip(ids, texts):
        own.append(i)
        parts.append(code_points(t))
        size += len(parts[-1])
        if size > BLOCK:
            yield own, parts
            own, parts, size = [], [], 0
    if own:
        yield own, parts


def chunk_table(records: DataFrame, span: int) -> DataFrame:
    """(digest, id): the distinct chunks of every record of `records(id, text)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, parts in _blocks(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ends = np.cumsum([len(p) for p in parts])
                start, _, digest = chunks(Digests(np.concatenate(parts)), span, ends)
                owner = np.searchsorted(ends, start, side="right")
                order = np.lexsort((digest, owner))
                owner, digest = owner[order], digest[order]
                fresh = np.ones(len(owner), bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(digest[fresh].view(np.int64)), pa.array(np.array(ids, np.int64)[owner[fresh]])], names=["digest", "id"])

    return records.select("id", "text").mapInArrow(run, "digest bigint, id bigint")


def _around(records: DataFrame, span: int) -> DataFrame:
    """(digest, id): digests of all stretches of `span` around the hot chunks of `records(id, text, hot array<bigint>)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, hot in zip(*(b.column(c).to_pylist() for c in ("id", "text", "hot"))):
                points = code_points(t)
                d = Digests(points)
                start, end, digest = chunks(d, span, np.array([len(points)]))
                some = np.isin(digest.view(np.int64), np.array(hot, np.int64))
                lo, hi = np.maximum(0, end[some] - span), np.minimum(start[some], len(points) - span)
                if len(lo) and len(points) >= span:
                    at = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi)]))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(d.of(at, at + span)).view(np.int64)), pa.array(np.full(len(np.unique(d.of(at, at + span))), i, np.int64))], names=["digest", "id"])

    return records.select("id", "text", "hot").mapInArrow(run, "digest bigint, id bigint")


class _Stretches:
    """A text's code points and the digests of all its stretches of `span`."""

    def __init__(self, text: str, span: int):
        self.points = code_points(text)
        at = np.arange(max(0, len(self.points) - span + 1))
        self.digests = Digests(self.points).of(at, at + span)
        self.order = np.argsort(self.digests, kind="stable")
        self.sorted = self.digests[self.order]


def _hits(own: _Stretches, other: _Stretches, span: int) -> np.ndarray:
    """Places of the stretches of `own` that `other` holds. Digests only propose; every stretch is compared code point by code point, neighbours at once."""
    if not len(own.digests) or not len(other.digests):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(other.sorted, own.digests), len(other.sorted) - 1)
    hit = np.flatnonzero(other.sorted[at] == own.digests)
    twin = other.order[at[hit]]
    if not len(hit):
        return hit
    breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(twin) != 1)) + 1
    keep = np.ones(len(hit), bool)
    for a, b in zip([0, *breaks], [*breaks, len(hit)]):
        h, t, n = int(hit[a]), int(twin[a]), int(b - a) + span - 1
        same = own.points[h : h + n] == other.points[t : t + n]
        if not same.all():  # a collision of digests: the stretches around the difference go, unless another place of that digest holds them
            for k in range(a, b):
                if not same[k - a : k - a + span].all():
                    places = other.order[np.searchsorted(other.sorted, own.digests[hit[k]]) : np.searchsorted(other.sorted, own.digests[hit[k]], side="right")]
                    keep[k] = any(np.array_equal(own.points[hit[k] : hit[k] + span], other.points[p : p + span]) for p in places)
    return hit[keep]


def _verify(t: pa.Table, span: int) -> pa.Table:
    """Pairs of one shard and block that share `span` code points, and where. Rows: texts (partners null) and texts with their partners' ids."""
    ids, texts, partners = (t.column(c).to_pylist() for c in ("id", "text", "partners"))
    held = {i: _Stretches(text, span) for i, text, p in zip(ids, texts, partners) if p is None}
    rows = []
    for i, text, p in zip(ids, texts, partners):
        if p is None:
            continue
        own = _Stretches(text, span)
        for e in p:
            if e in held and len(here := _hits(own, held[e], span)):
                rows.append((i, e, _merge(here, span), _merge(_hits(held[e], own, span), span)))
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, ty) for c, ty in zip(cols, SHARED.types)], schema=SHARED)


def _merge(at: np.ndarray, span: int) -> list[int]:
    """Starts and ends, in turn, of the union of the stretches at sorted places."""
    cut = np.flatnonzero(np.diff(at) > span)
    starts, ends = np.concatenate([at[:1], at[cut + 1]]), np.concatenate([at[cut], at[-1:]]) + span
    return np.stack([starts, ends], 1).ravel().tolist()


SHARED = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("here", pa.list_(pa.int64())), ("there", pa.list_(pa.int64()))])


def text_classes(records: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, record) members of classes of equal text, and (id, text) of the classes, for `records(record, text)` with texts of `least` code points or more."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("record"), pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary()), b.column("text")], names=["row", "record", "digest", "text"])

    rows = records.where(F.col("record").isNotNull() & (F.length("text") >= least)).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.select("row", "record", "text").mapInArrow(digest, "row bigint, record string, digest binary, text string"))
    reps = rows.groupBy("digest").agg(F.min("row").alias("id"))
    members = materialize(rows.select("record", "digest").join(reps, "digest").select("id", "record").distinct())
    texts = rows.join(members.select(F.col("id").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("id"), "text")
    return members, texts


def shared_spans(records: DataFrame, span: int = 200) -> tuple[DataFrame, DataFrame]:
    """Classes of records that share at least `span` consecutive code points.

    `records(record, text)`: null ids and texts are left out, and texts shorter than `span` share nothing. Returns (id, other, here, there), each pair of
    different texts once, with starts and ends, in turn, of what each has of the other (ends exclusive); and the members (id, record) of the classes.
    Records of equal text are members of one class.
    """
    members, texts = text_classes(records, span)
    texts = materialize(texts)
    keys = materialize(chunk_table(texts, span))
    seen = materialize(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1"))
    two = seen.where("n = 2").select("a", "b")
    few = keys.join(seen.where(f"n > 2 and n <= {HOT}").select("digest"), "digest")
    several = few.join(few.select("digest", F.col("id").alias("b")), "digest").where("id < b").select(F.col("id").alias("a"), "b")
    pairs = two.union(several)
    if not seen.where(f"n > {HOT}").isEmpty():
        marked = keys.join(seen.where(f"n > {HOT}").select("digest"), "digest").groupBy("id").agg(F.collect_list("digest").alias("hot"))
        near = materialize(_around(texts.join(marked, "id"), span))
        near = near.join(near.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "digest", "left_semi")
        pairs = pairs.union(near.join(near.select("digest", F.col("id").alias("b")), "digest").where("id < b").select(F.col("id").alias("a"), "b"))
    pairs = materialize(pairs.distinct())
    held = pairs.select(F.col("b").alias("id")).distinct()
    total = held.count()
    sizes = texts.select("id", F.length("text").alias("n"))
    shards = max(1, int((pairs.join(sizes, pairs.b == sizes.id).groupBy("b").agg(F.first("n").alias("n")).agg(F.sum("n")).first()[0] or 0) // SHARD_CHARS) + 1) if total else 1
    placed = pairs.withColumn("shard", F.pmod(F.xxhash64("b"), F.lit(shards)).cast("int"))
    load = placed.groupBy("shard").agg((F.floor(F.count(F.lit(1)) / 2000) + 1).cast("int").alias("blocks"))
    placed = materialize(placed.join(load, "shard").withColumn("block", F.pmod(F.xxhash64("a", F.lit(1)), F.col("blocks")).cast("int")))
    ask = placed.groupBy("shard", "block", F.col("a").alias("id")).agg(F.collect_list("b").alias("partners"))
    kept = placed.select("shard", "block", F.col("b").alias("id")).distinct().withColumn("partners", F.lit(None).cast("array<bigint>"))
    tasks = ask.unionByName(kept).join(texts, "id")
    found = tasks.groupBy("shard", "block").applyInArrow(lambda t: _verify(t, span), "id bigint, other bigint, here array<bigint>, there array<bigint>")
    return materialize(found), members


def record_pairs(found: DataFrame, members: DataFrame) -> DataFrame:
    """(record_a, record_b), record_a < record_b, of all members of classes that share a stretch, and of one class."""
    a, b = members.select("id", F.col("record").alias("x")), members.select(F.col("id").alias("other"), F.col("record").alias("y"))
    across = found.select("id", "other").join(a, "id").join(b, "other").where("x <> y").select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))
    within = a.join(b.withColumnRenamed("other", "id"), "id").where("x < y").select(F.col("x").alias("record_a"), F.col("y").alias("record_b"))
    return across.union(within).distinct()


def _spans(found: DataFrame) -> DataFrame:
    """(id, other, s, e): every shared stretch of every class, once for each class it is shared with."""
    ends = lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / 2 - 1).cast("int")), lambda i: F.struct(F.get(c, 2 * i).alias("s"), F.get(c, 2 * i + 1).alias("e")))
    way = lambda own, other, c: found.select(F.col(own).alias("id"), F.col(other).alias("other"), F.explode(ends(F.col(c))).alias("p"))
    return way("id", "other", "here").union(way("other", "id", "there")).select("id", "other", "p.s", "p.e")


def stretches(found: DataFrame, members: DataFrame) -> DataFrame:
    """(record, other, start_char, end_char): the stretches that a record shares with another, between the smallest records of classes of equal text; ends exclusive. Copies are listed by `classes`."""
    name = members.groupBy("id").agg(F.min("record").alias("record"))
    out = _spans(found).join(name, "id").join(name.select(F.col("id").alias("other"), F.col("record").alias("other_record")), "other")
    return out.select("record", F.col("other_record").alias("other"), F.col("s").alias("start_char"), F.col("e").alias("end_char"))


def classes(found: DataFrame, members: DataFrame) -> DataFrame:
    """(record, class_record, copies, links): every record of enough code points with the smallest record of its text, the number of records of that text, and the number of other texts that share a stretch."""
    size = members.groupBy("id").agg(F.min("record").alias("class_record"), F.count(F.lit(1)).alias("copies"))
    links = found.select("id").union(found.select("other")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    return skew_join(members, size.join(links, "id", "left"), "id").select("record", "class_record", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def coverage(found: DataFrame, members: DataFrame, records: DataFrame, span: int = 200) -> DataFrame:
    """(record, chars, shared_chars): for each record of at least `span` code points how many of them lie in stretches that another record has too."""
    spans = _spans(found).select("id", "s", "e").distinct()
    order = W.partitionBy("id").orderBy("s", "e")
    reached = F.coalesce(F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = spans.select("id", (F.col("e") - F.greatest("s", reached)).alias("new")).groupBy("id").agg(F.sum(F.greatest(F.lit(0), F.col("new"))).alias("shared"))
    copies = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    length = records.where(F.length("text") >= span).groupBy("record").agg(F.max(F.length("text")).alias("chars"))
    out = members.join(copies, "id").join(own, "id", "left").join(length, "record")
    shared = F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return out.groupBy("record").agg(F.max("chars").cast("bigint").alias("chars"), F.max(shared).cast("bigint").alias("shared_chars"))
