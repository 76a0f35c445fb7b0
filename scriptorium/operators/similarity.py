"""Similarity of passages, documents and texts: cosine and multi-vector maxima in Arrow blocks, character tf-idf in SQL and in blocks."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.session import materialize

BLOCK = 512
_WORD = re.compile(r"\w+(?:['’]\w+)*")
_SPACES = re.compile(r"\s\s+")


def _blocks(vectors: DataFrame, cols: list[str], prefix: str, by: list[str] | None = None) -> DataFrame:
    """Rows of up to about BLOCK vectors as arrays, spread by the hash of the columns `by` (all, if not given)."""
    n = vectors.count()
    b = F.pmod(F.xxhash64(*(by or cols)), F.lit(max(1, n // BLOCK)))
    return vectors.groupBy(b.alias("_b")).agg(F.collect_list(F.struct(*cols, "v")).alias(prefix)).drop("_b")


def vectors_of(df: DataFrame, cols: list[str], vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector (no null or non-finite value, not all zero), as `v`."""
    v = F.col(vector)
    fine = (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    return df.where(v.isNotNull()).where(fine).select(*cols, v.cast("array<double>").alias("v"))


def cosines(queries: DataFrame, bank: DataFrame, top: int | None = None) -> DataFrame:
    """(q, r, cosine) of `queries(q, v)` against `bank(r, v)`: a query set against all rows, block by block, each pair of blocks one matrix product.

    With `top`, each pair of blocks passes on only the best of every query, and the best overall are kept (ties by r). A query never meets the row of its own id.
    """
    pairs = _blocks(queries, ["q"], "qs").crossJoin(_blocks(bank, ["r"], "rs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qs, rs in zip(b.column("qs").to_pylist(), b.column("rs").to_pylist()):
                q, r = np.array([x["q"] for x in qs]), np.array([x["r"] for x in rs])
                a, c = np.array([x["v"] for x in qs]), np.array([x["v"] for x in rs])
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
                s = np.clip(a @ c.T, -1, 1)
                keep = q[:, None] != r[None, :]
                if top and len(r) > top:
                    order = np.lexsort((np.broadcast_to(r, s.shape), -np.where(keep, np.round(s, 9), -2)), axis=1)
                    mask = np.zeros_like(keep)
                    np.put_along_axis(mask, order[:, :top], True, axis=1)
                    keep &= mask
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(r[j]), pa.array(s[i, j])], names=["q", "r", "cosine"])

    found = pairs.mapInArrow(run, "q bigint, r bigint, cosine double")
    if not top:
        return found
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round("cosine", 9)), "r"))).where(f"rank <= {top}")


def maxsim(candidates: DataFrame, bank: DataFrame) -> DataFrame:
    """(c, r, maxsim) of `candidates(c, i, v)` and `bank(r, j, v)`: mean over a document's passages of their best cosine to the other document's, averaged both ways.

    A passage is never compared with itself (equal document and number). If both have `keys` (arrays), a passage of the bank is left out for the candidates that have one of its keys. Blocks pass
    on the maxima of rows and columns only, which the aggregations combine.
    """
    keyed = ["keys"] if "keys" in candidates.columns and "keys" in bank.columns else []
    left, right = _blocks(candidates, ["c", "i", *keyed], "qs", ["c", "i"]), _blocks(bank, ["r", "j", *keyed], "rs", ["r", "j"])
    pairs = left.crossJoin(right)
    schema = pa.schema([("c", pa.int64()), ("r", pa.int64()), ("side", pa.int8()), ("k", pa.int64()), ("best", pa.float64())])

    def unit(rows: list, doc: str, number: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.array([r["v"] for r in rows])
        return np.array([r[doc] for r in rows]), np.array([r[number] for r in rows]), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qs, rs in zip(b.column("qs").to_pylist(), b.column("rs").to_pylist()):
                (c, i, x), (r, j, y) = unit(qs, "c", "i"), unit(rs, "r", "j")
                s = np.clip(x @ y.T, -1, 1)
                s[(c[:, None] == r[None, :]) & (i[:, None] == j[None, :])] = -np.inf
                if keyed:
                    own: dict[int, list[int]] = {}
                    for row, q in enumerate(qs):
                        for k in q["keys"]:
                            own.setdefault(k, []).append(row)
                    for col, x in enumerate(rs):
                        for k in x["keys"]:
                            s[own.get(k, []), col] = -np.inf
                for side, mine_, number, other, m in ((0, c, i, r, s), (1, r, j, c, s.T)):
                    order = np.argsort(other, kind="stable")
                    names, starts = np.unique(other[order], return_index=True)
                    best = np.maximum.reduceat(m[:, order], starts, axis=1).ravel()
                    mine, far, k = np.repeat(mine_, len(names)), np.tile(names, len(mine_)), np.repeat(number, len(names))
                    some = best > -np.inf
                    ends = (mine[some], far[some]) if side == 0 else (far[some], mine[some])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.array(np.full(some.sum(), side, np.int8)), pa.array(k[some]), pa.array(best[some])], schema=schema)

    best = pairs.mapInArrow(run, "c bigint, r bigint, side tinyint, k bigint, best double").groupBy("c", "r", "side", "k").agg(F.max("best").alias("best"))
    return best.groupBy("c", "r", "side").agg(F.avg("best").alias("m")).groupBy("c", "r").agg(F.avg("m").alias("maxsim"))


def gram_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, gram, tf) of character 3- to 5-grams of the lower-cased text, runs of white space being one space. Null texts have none.

    Grams are counted where the text is read, so only counts are shuffled. (As column expressions, one array of all grams per text, it took tens of times as long.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist()):
                counts = _grams(t)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(counts), b.column(key).type), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[key, "gram", "tf"])

    rows = docs.where(F.col(text).isNotNull()).select(key, text)
    return rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, gram string, tf bigint").groupBy(key, "gram").agg(F.sum("tf").alias("tf"))


def run_digests(docs: DataFrame, key: str, text: str = "text", size: int = 12) -> DataFrame:
    """(key, digest): md5 of the distinct runs of `size` consecutive lower-cased words of each text, joined by spaces. Null and shorter texts have none. (As column expressions the words were found anew for every run.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist()):
                w = _WORD.findall(t.lower())
                found = list({hashlib.md5(" ".join(w[i : i + size]).encode("utf-8", "surrogatepass")).hexdigest() for i in range(len(w) - size + 1)})  # noqa: S324
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), b.column(key).type), pa.array(found, pa.string())], names=[key, "digest"])

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, digest string")


def vocabulary(counts: DataFrame, key: str, size: int = 50_000) -> DataFrame:
    """(gram, df, total, idf): the `size` grams of the largest total count, ties in order of the gram; idf = ln((1 + N) / (1 + df)) + 1."""
    n = counts.agg(F.countDistinct(key).alias("n"))
    v = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "gram").limit(size)
    return v.crossJoin(F.broadcast(n)).select("gram", "df", "total", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, gram, weight): (1 + ln tf) idf, scaled to length 1 per key."""
    w = counts.join(F.broadcast(vocab.select("gram", "idf")), "gram").select(key, "gram", ((1 + F.log("tf")) * F.col("idf")).alias("w"))  # vocabulary: at most its size
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_cosines(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(q, r, cosine) of a query set `a(key, gram, weight)` against `b`, by the grams they share; pairs that share none have none."""
    q = a.select(F.col(key).alias("q"), "gram", F.col("weight").alias("x"))
    r = b.select(F.col(key).alias("r"), "gram", F.col("weight").alias("y"))
    return q.join(r, "gram").where("q <> r").groupBy("q", "r").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def gram_vocabulary(passages: DataFrame, text: str = "text", size: int = 50_000) -> DataFrame:
    """(gram, df, total, idf): as `vocabulary` of `gram_counts`, for passages of one row each. Tasks add up what their passages hold, so no counts of single passages are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        total: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([df[g] for g in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "df", "total"])

        for b in batches:
            for t in b.column(0).to_pylist():
                counts = _grams(t)
                df.update(counts.keys())
                for g, n in counts.items():
                    total[g] += n
                df[""] += bool(counts)  # passages with any gram
                if len(total) > 1 << 19:
                    total[""] = 0
                    yield told()
                    df, total = Counter(), Counter()
        total[""] = 0
        yield told()

    sums = passages.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "gram string, df bigint, total bigint").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    sums = materialize(sums)
    n = sums.where("gram = ''").select(F.col("df").alias("n"))
    v = sums.where("gram <> ''").orderBy(F.desc("total"), "gram").limit(size)
    return v.crossJoin(F.broadcast(n)).select("gram", "df", "total", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _grams(text: str) -> Counter:
    """Character 3- to 5-grams of a text, as in `gram_counts`."""
    t = _SPACES.sub(" ", text.lower())
    counts: Counter = Counter()
    for n in (3, 4, 5):
        counts.update(t[i : i + n] for i in range(len(t) - n + 1))
    return counts


def numbered_grams(vocab: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of a vocabulary's grams, the most frequent first, and their idf: as many as the vocabulary's size."""
    rows = sorted(vocab.select("gram", "total", "idf").collect(), key=lambda r: (-r.total, r.gram))
    return {r.gram: i for i, r in enumerate(rows)}, np.array([r.idf for r in rows])


def gram_vectors(passages: DataFrame, numbers: dict[str, int], text: str = "text") -> DataFrame:
    """`passages` with `grams` and `times` instead of the text: numbers (two bytes) and counts (four bytes) of its grams of the vocabulary. Passages without one stay, empty."""
    kept = [c for c in passages.columns if c != text]
    known = passages.sparkSession.sparkContext.broadcast(numbers)  # a vocabulary of at most 50,000 grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, times = [], []
            for t in b.column(text).to_pylist():
                found = [(known.value[g], n) for g, n in _grams(t or "").items() if g in known.value]
                grams.append(np.array([g for g, _ in found], np.uint16).tobytes())
                times.append(np.array([n for _, n in found], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(grams, pa.binary()), pa.array(times, pa.binary())], names=[*kept, "grams", "times"])

    types = dict(passages.dtypes)
    return passages.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", grams binary, times binary")


#: Passages of a block of the bank and of a block of candidates, as vectors and as grams; pairs of documents whose values a task holds at a time; frequent grams that are multiplied as a matrix.
DENSE, SPARSE, PAIRS, FREQUENT = (256, 1024), (16, 256), 1 << 22, 4_096


def _packed(rows: DataFrame, side: str, vector: tuple[str, ...], blocks: int, most: int | None) -> DataFrame:
    """Blocks of passages, the documents of one block together; of a document of more than `most` passages every part is a block of its own (`cut`)."""
    block = F.concat(F.lit("b"), F.pmod(F.xxhash64(side), F.lit(blocks)).cast("string"))
    if most:
        big = materialize(rows.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))  # at most one of `most` rows
        part = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_n") / most)).cast("string")
        rows = rows.join(F.broadcast(big), side, "left")
        block = F.when(F.col("_n").isNull(), block).otherwise(F.concat_ws(" ", side, part))
    extra = [c for c in ("keys", "name") if c in rows.columns]
    rows = rows.select(block.alias("_b"), F.col(side).alias("doc"), "own", (F.col("_n").isNotNull() if most else F.lit(False)).alias("cut"), *vector, *extra)
    types = dict(rows.dtypes)
    listed = [(c, types[c]) for c in extra]

    def pack(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("doc").to_numpy(), kind="stable")))
        own = t.column("own").combine_chunks()
        cols = {"doc": [t.column("doc").to_numpy().tobytes()], "own": [own.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], "known": [own.is_valid().to_numpy(zero_copy_only=False).tobytes()], "cut": [t.column("cut")[0].as_py()]}
        if len(vector) == 1:
            x = np.array(t.column("v").to_pylist(), np.float64)
            single = x.astype(np.float32)
            cols["x"] = [(single if (single == x).all() else x).tobytes()]
            cols["size"] = [np.int64([x.shape[1]]).tobytes()]
        else:
            grams = t.column("grams").to_pylist()
            cols["x"] = [b"".join(grams) + b"".join(t.column("times").to_pylist())]
            cols["size"] = [np.array([len(g) // 2 for g in grams], np.int64).tobytes()]
        cols |= {c: [t.column(c).to_pylist()] for c, _ in listed}
        return pa.table([pa.array(v, f.type) for v, f in zip(cols.values(), schema)], schema=schema)

    arrow = {"array<bigint>": pa.list_(pa.int64()), "string": pa.string()}
    schema = pa.schema([*((c, pa.binary()) for c in ("doc", "own", "known")), ("cut", pa.bool_()), ("x", pa.binary()), ("size", pa.binary()), *((c, pa.list_(arrow[k])) for c, k in listed)])
    return rows.groupBy("_b").applyInArrow(pack, "doc binary, own binary, known binary, cut boolean, x binary, size binary" + "".join(f", {c} array<{k}>" for c, k in listed))


class _Block:
    """Passages sorted by document: where each document's begin, what it must not meet, and the vectors."""

    def __init__(self, row: dict, idf: np.ndarray | None):
        doc = np.frombuffer(row["doc"], np.int64)
        self.n, self.cut, self.idf = len(doc), row["cut"], idf
        self.doc, self.at = np.unique(doc, return_index=True)
        self.many = np.diff(np.append(self.at, len(doc)))
        self.own, self.known = np.frombuffer(row["own"], np.int64)[self.at], np.frombuffer(row["known"], bool)[self.at]
        self.keys, self.names = row.get("keys"), row.get("name")
        size = np.frombuffer(row["size"], np.int64)
        if idf is None:
            raw = row["x"]
            x = np.frombuffer(raw, np.float32 if len(raw) == 4 * self.n * size[0] else np.float64).reshape(self.n, -1).astype(np.float64)
            self.x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        else:
            total = int(size.sum())
            self.gram = np.frombuffer(row["x"], np.uint16, total).astype(np.int64)
            self.of = np.repeat(np.arange(self.n), size)
            w = (1 + np.log(np.frombuffer(row["x"][2 * total :], np.uint32))) * idf[self.gram]
            self.w = w / np.maximum(np.sqrt(np.bincount(self.of, w * w, self.n)), 1e-300)[self.of]
            self.ends = np.concatenate([[0], np.cumsum(size)])

    def opened(self) -> None:
        """Makes a block of candidates ready for products."""
        if self.idf is not None:
            rare = np.unique(self.gram[self.gram >= FREQUENT])
            self.place = np.full(max(len(self.idf), FREQUENT), -1)
            self.place[:FREQUENT] = np.arange(FREQUENT)
            self.place[rare] = FREQUENT + np.arange(len(rare))
            self.x = np.zeros((FREQUENT + len(rare), self.n))
            self.x[self.place[self.gram], self.of] = self.w
        self.rows: dict[int, list[int]] = {}
        for i, own in enumerate(self.keys or ()):
            for k in own or ():
                self.rows.setdefault(k, []).append(i)

    def products(self, bank: _Block) -> np.ndarray:
        """Cosines of a bank's passages (rows) with those of this block (columns)."""
        if self.idf is None:
            s = np.clip(bank.x @ self.x.T, -1, 1)
        else:
            often = bank.gram < FREQUENT
            top = np.zeros((bank.n, FREQUENT))
            top[bank.of[often], bank.gram[often]] = bank.w[often]
            s = top @ self.x[:FREQUENT]
            place = self.place[bank.gram]
            rest = ~often & (place >= 0)
            for j in range(bank.n):
                a, e = bank.ends[j], bank.ends[j + 1]
                some = rest[a:e]
                if some.any():
                    s[j] += bank.w[a:e][some] @ self.x[place[a:e][some]]
        for j, own in enumerate((bank.keys or ()) if self.rows else ()):
            for k in own or ():
                s[j, self.rows.get(k, [])] = -np.inf
        return s


class _Rest:
    """What a block of candidates scores against a bank that passes by block by block."""

    def __init__(self, left: _Block, top: int | None):
        self.left, self.top = left, top
        left.opened()
        self.values: list[np.ndarray] = []
        self.parts: dict[int, list] = {}  # documents that come in several blocks: best of every passage so far, sums and counts of their passages' best, what they must not meet
        self.best: list[list] = [[] for _ in left.doc]
        self.least = np.full(len(left.doc), -np.inf)

    def add(self, bank: _Block) -> None:
        s = self.left.products(bank)
        of_left = np.maximum.reduceat(s, bank.at, axis=0)  # best of every candidate passage in every document of the bank
        of_bank = np.ascontiguousarray(s.T) if (self.left.many == 1).all() else np.maximum.reduceat(np.ascontiguousarray(s.T), self.left.at, axis=0)  # and the other way round
        some = of_bank > -np.inf
        sums, counts = np.add.reduceat(np.where(some, of_bank, 0), bank.at, axis=1), np.add.reduceat(some.astype(np.float64), bank.at, axis=1)
        names = [bank.names[i] for i in bank.at] if bank.names else [None] * len(bank.doc)
        if not bank.cut:
            self.pairs(of_left, sums, counts, bank.own, bank.known, names)
        elif (d := int(bank.doc[0])) in self.parts:
            held = self.parts[d]
            held[0], held[1], held[2] = np.maximum(held[0], of_left), held[1] + sums, held[2] + counts
        else:
            self.parts[d] = [of_left, sums, counts, bank.own, bank.known, names]

    def pairs(self, of_left: np.ndarray, sums: np.ndarray, counts: np.ndarray, own: np.ndarray, known: np.ndarray, names: list) -> None:
        """Takes up documents of the bank that are complete."""
        left = self.left
        some = of_left > -np.inf
        mine, n = np.add.reduceat(np.where(some, of_left, 0), left.at, axis=1).T, np.add.reduceat(some.astype(np.float64), left.at, axis=1).T
        with np.errstate(invalid="ignore", divide="ignore"):
            m = (mine / n + sums / counts) / 2
        m[(left.own[:, None] == own) & left.known[:, None] & known] = np.nan
        if not self.top:
            self.values.append(m)
            return
        v = np.where(np.isnan(m), -np.inf, np.round(m, 9))
        v[np.isneginf(v)] = -np.inf
        for c in np.flatnonzero((v.max(1) >= self.least) & (v.max(1) > -np.inf)):
            new = np.flatnonzero((v[c] >= self.least[c]) & (v[c] > -np.inf))
            self.best[c] = sorted(self.best[c] + [(-v[c, r], names[r], m[c, r]) for r in new], key=lambda x: x[:2])[: self.top]
            if len(self.best[c]) == self.top:
                self.least[c] = -self.best[c][-1][0]

    def done(self) -> pa.RecordBatch:
        for held in self.parts.values():
            self.pairs(*held)
        docs = self.left.doc
        if self.top:
            at = np.repeat(np.arange(len(docs)), [len(x) for x in self.best])
            return pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array([x[1] for own in self.best for x in own], pa.string()), pa.array([x[2] for own in self.best for x in own], pa.float64())], names=["c", "name", "maxsim"])
        mid, best, n = [], [], []
        for c in range(len(docs)):
            v = np.concatenate([x[c] for x in self.values])
            v = v[~np.isnan(v)]
            n.append(len(v))
            mid.append(float(np.median(v)) if len(v) else None)
            best.append(float(v.max()) if len(v) else None)
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(mid, pa.float64()), pa.array(best, pa.float64()), pa.array(n, pa.int64())], names=["c", "mid", "best", "n"])


def against_rest(asked: DataFrame, bank: DataFrame, idf: np.ndarray | None = None, top: int | None = None) -> DataFrame:
    """(c, mid, best, n): median and maximum, over the documents of `bank(r, own, v)`, of the mean best cosine of passages, both ways, to each document of `asked(c, own, v)`, and the number of these documents; or, with `top`,
    (c, name, maxsim) of the `top` greatest, ties by the bank's `name`.

    Documents of equal `own` (where not null) never meet. If both have `keys` (arrays), a passage of the bank is left out for the candidates that have one of its keys. With `idf`, passages hold `grams` and `times` of
    `gram_vectors` in place of `v`; those without one have cosine 0 to all. Every block of candidates sees the whole bank in one task, so no values of pairs are shuffled or stored; candidates without any document to meet have n = 0, and
    an empty bank gives no rows.
    """
    rows, width = DENSE if idf is None else SPARSE
    vector = ("v",) if idf is None else ("grams", "times")
    size = lambda df, side: df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(side).alias("docs")).first()
    a, b = size(asked, "c"), size(bank, "r")
    left_blocks = max(1, a.n // width, 0 if top else a.docs * b.docs // PAIRS)
    left = materialize(_packed(asked, "c", vector, left_blocks, None))
    right = materialize(_packed(bank, "r", vector, max(1, b.n // rows), rows))
    lists = {c: F.lit(None) for c in ("keys",) if c not in left.columns or c not in right.columns}
    left, right = left.drop(*lists), right.drop(*lists)
    tasks = min(left_blocks, 4 * asked.sparkSession.sparkContext.defaultParallelism)
    own = F.struct(*left.columns)
    bank_rows = right.coalesce(1).select(F.struct(*right.columns).alias("bank"), (F.monotonically_increasing_id() == 0).alias("first"))
    # every task reads the whole bank; a block of candidates goes to Python with the bank's first row only
    pairs = left.select(own.alias("left")).repartition(tasks).crossJoin(bank_rows.hint("shuffle_replicate_nl")).select(F.when(F.col("first"), F.col("left")).alias("left"), "bank")
    shared = asked.sparkSession.sparkContext.broadcast(idf)  # as many numbers as the vocabulary has grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            for row in b.to_pylist():
                if row["left"] is not None:
                    if rest:
                        yield rest.done()
                    rest = _Rest(_Block(row["left"], shared.value), top)
                rest.add(_Block(row["bank"], shared.value))
        if rest:
            yield rest.done()

    return pairs.mapInArrow(run, "c bigint, name string, maxsim double" if top else "c bigint, mid double, best double, n bigint")


def symmetric_sparse(asked: DataFrame, bank: DataFrame, idf: np.ndarray) -> DataFrame:
    """(document_id, similarity) of `asked(document_id, grams, times)` against `bank(document_id, grams, times)`, rows of `gram_vectors`: the median over all other documents of the bank of the mean best cosine of passages,
    both ways. Passages that share no gram have cosine 0, and so have documents without one."""
    named = lambda df, side: df.select(F.xxhash64("document_id").alias(side), F.xxhash64("document_id").alias("own"), "grams", "times")
    found = against_rest(named(asked, "c"), named(bank, "r"), idf)
    ids = asked.select("document_id", F.xxhash64("document_id").alias("c")).distinct()
    return ids.join(found, "c", "left").select("document_id", F.coalesce("mid", F.lit(0.0)).alias("similarity"))
