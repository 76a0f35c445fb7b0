"""Cutting oversized items at natural boundaries (problem 5).

An item is worked on in ranges, never as a whole: a row's text is cut into ranges as it streams by, a giant file is read range by range by whoever gets them.

1. Every range measures itself: its words, code points and load. The load of a word with what follows up to the next word is the larger of its shares
   of the two limits; a range starts a new one, so measuring needs no neighbour but a short halo to know whether a word runs in from the left.
2. The measures of an item's ranges are stitched by prefix sums. Only items over a limit go on.
3. Cut lines stand at fixed multiples of the load. The range in which a line falls looks back over a slack (a halo of the range before, if need be) and
   takes the strongest boundary there: paragraph, line, sentence, clause, white space, or nothing natural at all. Lines don't depend on one another.
4. Consecutive cuts make the pieces; each piece starts a given number of words before the cut ahead of it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.session import materialize, release, shared_dir

WORD = re.compile(r"\w+(?:['’]\w+)*")
#: Boundaries from strong to weak; a match's end is a place to cut.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"(?:[.!?…؟।]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*\s*)"),
    re.compile(r"(?:[,;:،؛–—]+\s+|[、，；：]\s*)"),
    re.compile(r"\s+"),
)


@dataclass(frozen=True)
class Limits:
    """A piece has at most `words` words and `chars` code points. Consecutive pieces overlap by `overlap` words (fewer where the words are long), and a cut may lie `slack` of a piece ahead of its line."""

    words: int = 700
    chars: int = 5000
    overlap: int = 40
    slack: float = 0.25

    @property
    def step(self) -> float:
        """Load from one cut line to the next: with slack and overlap it makes a full piece."""
        return 1.0 - self.slack - self.overlap / self.words - 1e-6

    @property
    def halo(self) -> int:
        """Code points that slack and overlap can reach back."""
        return int((self.slack + self.overlap / self.words) * self.chars) + 300


def _word_starts(text: str, at: int) -> list[int]:
    """Starts of the words of text[at:]; what lies before `at` is the halo."""
    return [s for m in WORD.finditer(text) if (s := m.start()) >= at]


def _loads(starts: list[int], begin: int, end: int, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the load units in [begin, end) and the load up to each, 0 at begin."""
    edges = np.array([begin, *starts, end], np.int64)
    least = np.full(len(edges) - 1, 1.0 / lim.words)
    least[0] = 0.0  # what runs in from the left holds no word start
    return edges, np.concatenate([[0.0], np.cumsum(np.maximum(np.diff(edges) / lim.chars, least))])


def measure(text: str, at: int, lim: Limits) -> tuple[int, int, float]:
    """Words that start in text[at:], its code points and its load."""
    starts = _word_starts(text, at)
    return len(starts), len(text) - at, float(_loads(starts, at, len(text), lim)[1][-1])


def cuts(text: str, at: int, load: float, words: int, total: float, lim: Limits) -> list[tuple[int, int, int, int, int]]:
    """The cuts of the lines in the range text[at:], whose halo is text[:at]; `load` and `words` are those ahead of the range, `total` the item's load.

    Each is (line, cut, words before it, start of the next piece, words before that), places counted from the range's start.
    """
    every = [m.start() for m in WORD.finditer(text)]
    ahead = [s for s in every if s < at]
    begin = ahead[0] if ahead else at
    back_edges, back = _loads([s for s in ahead if s > begin], begin, at, lim)
    if ahead:  # the first unit of the halo starts at a word
        back = back + np.concatenate([[0.0], np.full(len(back) - 1, max(0.0, 1.0 / lim.words - (back_edges[1] - back_edges[0]) / lim.chars))])
    own_edges, own = _loads([s for s in every if s >= at], at, len(text), lim)
    edges = np.concatenate([back_edges[:-1], own_edges])
    loads = np.concatenate([back[:-1] - back[-1], own]) + load
    starts = np.array(every, np.int64)
    out = []
    line = int(np.floor(load / lim.step)) + 1
    while line * lim.step <= loads[-1] + 1e-12 and line * lim.step < total - 1e-9:
        goal, least = line * lim.step, line * lim.step - lim.slack
        if goal <= load + 1e-12 and line > 1 and load > 0:
            line += 1
            continue
        hi = int(np.interp(goal, loads, edges))
        lo = int(np.ceil(np.interp(least, loads, edges))) if least > loads[0] else int(edges[0])
        cut = hi
        for kind in BOUNDARIES:
            best = -1
            for m in kind.finditer(text, max(0, lo - 3), min(len(text), hi + 3)):
                if lo < m.end() <= hi:
                    best = m.end()
            if best > 0:
                cut = best
                break
        k = int(np.searchsorted(starts, cut))  # words that start ahead of the cut
        first = max(0, k - lim.overlap)
        floor = np.interp(cut, edges, loads) - lim.overlap / lim.words
        while first < k and np.interp(starts[first], edges, loads) < floor:
            first += 1
        nxt = int(starts[first]) if first < k else cut
        before = words + k - len(ahead)
        out.append((line, cut - at, before, nxt - at, before - (k - first)))
        line += 1
    return out


def _ranges(text: str, size: int, halo: int) -> Iterator[tuple[int, str, int]]:
    """(number, halo and range, place of the range in it)."""
    for n, i in enumerate(range(0, max(1, len(text)), size)):
        lo = max(0, i - halo)
        yield n, text[lo : i + size], i - lo


def measured_ranges(items: DataFrame, lim: Limits, size: int) -> DataFrame:
    """(item, range, words, chars, load) for `items(item, text)`; null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *measure(part, at, lim)) for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist()) for n, part, at in _ranges(t, size, 300)]
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "range", "words", "chars", "load"), r)) for r in rows], schema=MEASURED)

    return items.where("text is not null").select("item", "text").mapInArrow(run, "item bigint, range int, words bigint, chars bigint, load double")


MEASURED = pa.schema([("item", pa.int64()), ("range", pa.int32()), ("words", pa.int64()), ("chars", pa.int64()), ("load", pa.float64())])
CUTS = pa.schema([("item", pa.int64()), ("line", pa.int64()), ("cut", pa.int64()), ("words", pa.int64()), ("next", pa.int64()), ("next_words", pa.int64())])


def oversized(ranges: DataFrame, lim: Limits) -> DataFrame:
    """(item, words, chars, load) of the items over a limit, from their ranges' measures."""
    return ranges.groupBy("item").agg(F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.sum("load").alias("load")).where((F.col("words") > lim.words) | (F.col("chars") > lim.chars))


def split_items(items: DataFrame, lim: Limits = Limits(), size: int = 1 << 16) -> DataFrame:
    """(item, piece, start_char, end_char, word_count) of every item of `items(item bigint, text)` over a limit.

    `item` is unique. Places count code points of the item's text, ends exclusive. Items within the limits, null and empty texts give no row. A run
    without any boundary is cut at its line. Pieces cover the text; each is within both limits.
    """
    ranges = materialize(measured_ranges(items, lim, size))
    big = oversized(ranges, lim)
    order = W.partitionBy("item").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    stitched = ranges.join(big.select("item", F.col("load").alias("total")), "item").select("item", "range", F.coalesce(F.sum("load").over(order), F.lit(0.0)).alias("before"), F.coalesce(F.sum("words").over(order), F.lit(0)).alias("words_before"), "total")
    plan = stitched.groupBy("item").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("range", "before", "words_before"))).alias("plan"))  # one small row per range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text, total, table in zip(*(b.column(c).to_pylist() for c in ("item", "text", "total", "plan"))):
                for (n, part, at), r in zip(_ranges(text, size, lim.halo), table):
                    rows += [(item, line, cut + n * size, w, nxt + n * size, nw) for line, cut, w, nxt, nw in cuts(part, at, r["before"], r["words_before"], total, lim)]
            yield pa.RecordBatch.from_pylist([dict(zip(CUTS.names, r)) for r in rows], schema=CUTS)

    found = items.join(plan, "item").select("item", "text", "total", "plan").mapInArrow(run, "item bigint, line bigint, cut bigint, words bigint, next bigint, next_words bigint")
    return pieces_of(found, big)


def pieces_of(found: DataFrame, big: DataFrame) -> DataFrame:
    """Pieces between consecutive cuts."""
    last = big.select("item", F.lit(1 << 62).alias("line"), F.col("chars").alias("cut"), "words", F.lit(None).cast("bigint").alias("next"), F.lit(None).cast("bigint").alias("next_words"))
    order = W.partitionBy("item").orderBy("line")
    return found.unionByName(last).select("item", (F.row_number().over(order) - 1).cast("bigint").alias("piece"), F.coalesce(F.lag("next").over(order), F.lit(0)).alias("start_char"), F.col("cut").alias("end_char"), (F.col("words") - F.coalesce(F.lag("next_words").over(order), F.lit(0))).alias("word_count"))


def passage_items(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(item, document_id, passage_id, start_char, text): distinct passages with their texts; a null text is taken from clean_text by its offsets.

    Null stays null where the document is gone, has no clean_text, or an offset is null.
    """
    p = passages.where("document_id is not null and passage_id is not null").select("document_id", "passage_id", "text", "start_char", "end_char")
    here = p.where("text is not null").select("document_id", "passage_id", "start_char", "text")
    gaps = p.where("text is null and end_char > start_char").drop("text").distinct()
    texts = docs.where("clean_text is not null").select("document_id", "clean_text", "loaded_at")
    found = gaps.join(texts, "document_id").groupBy("document_id", "passage_id", "start_char", "end_char").agg(F.max_by(F.expr("substring(clean_text, int(start_char) + 1, int(end_char - start_char))"), "loaded_at").alias("text"))
    return here.unionByName(found.select("document_id", "passage_id", "start_char", "text")).withColumn("item", F.monotonically_increasing_id())


def _candidates(passages: DataFrame, docs: DataFrame, lim: Limits) -> DataFrame:
    """(item, document_id, passage_id, at, text): distinct passages that may be over a limit. A word and what parts it from the next take two code points at least, so shorter texts are within both limits."""
    items = passage_items(passages, docs).where(F.length("text") > F.lit(min(2 * lim.words, lim.chars)))
    items = items.groupBy("document_id", "passage_id", "text").agg(F.min("start_char").alias("at"))
    return materialize(items.withColumn("item", F.monotonically_increasing_id()))


def oversized_passages(passages: DataFrame, docs: DataFrame, lim: Limits = Limits(), size: int = 1 << 12) -> DataFrame:
    """(document_id, passage_id) of the passages that are cut, that is those over a limit: every piece's owner. Repeated rows count once."""
    return passage_pieces(passages, docs, lim, size).select("document_id", "passage_id").distinct()


def passage_pieces(passages: DataFrame, docs: DataFrame, lim: Limits = Limits(), size: int = 1 << 12) -> DataFrame:
    """(document_id, passage_id, piece, start_char, end_char, word_count) of passages over a limit; places count in the document where the passage has a start, else in the passage."""
    items = _candidates(passages, docs, lim)
    done = split_items(items.select("item", "text"), lim, size)
    at = F.coalesce("at", F.lit(0))
    return items.select("item", "document_id", "passage_id", "at").join(done, "item").select("document_id", "passage_id", "piece", (at + F.col("start_char")).alias("start_char"), (at + F.col("end_char")).alias("end_char"), "word_count")


def text_files(texts: DataFrame) -> list[str]:
    """Writes `texts(text)`, parted by blank lines, as text files into the shared folder and gives their URIs, one per task. Null texts are left out."""
    spark = texts.sparkSession
    path = f"{shared_dir(spark)}/scriptorium-{uuid.uuid4().hex}"
    texts.where("text is not null").select("text").write.option("lineSep", "\n\n").text(path)
    release(spark, path)
    return [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # as many as tasks


def split_files(spark: SparkSession, paths: list[str], lim: Limits = Limits(), size: int = 1 << 22) -> DataFrame:
    """(path, piece, start_char, end_char, word_count) of UTF-8 files over a limit, which no worker ever reads as a whole.

    `paths` are URIs that pyarrow opens on every executor. A range is `size` bytes; a code point belongs to the range of its first byte.
    """
    from pyarrow import fs

    def opened(path: str) -> pa.NativeFile:
        if "://" not in path and not path.startswith("file:"):
            return fs.LocalFileSystem().open_input_file(path)
        where, inner = fs.FileSystem.from_uri(path)
        return where.open_input_file(inner)

    def part(path: str, n: int, halo: int) -> tuple[str, int]:
        with opened(path) as f:
            end = f.size()
            lo, hi = max(0, n * size - 4 * halo), min(end, (n + 1) * size + 3)
            raw = f.read_at(hi - lo, lo)
        cont = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
        a, b, c = 0, n * size - lo, min((n + 1) * size, end) - lo
        while cont(a):
            a += 1
        while cont(b):
            b += 1
        while cont(c):
            c += 1
        left = raw[a:b].decode("utf-8", "replace")[-halo:] if halo else ""
        return left + raw[b:c].decode("utf-8", "replace"), len(left)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = []
            for p in b.column("path").to_pylist():
                with opened(p) as f:
                    lengths.append(f.size())
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("path"), pa.array(lengths, pa.int64())], names=["item", "path", "bytes"])

    named = spark.createDataFrame(list(enumerate(paths)), "item bigint, path string")
    files = materialize(named.repartition(max(1, min(len(paths), 64))).mapInArrow(sized, "item bigint, path string, bytes bigint"))
    tasks = files.select("item", "path", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / size)).cast("int"))).alias("range")).repartition("item", "range")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, r, *measure(*part(p, r, 300), lim)) for i, p, r in zip(*(b.column(c).to_pylist() for c in ("item", "path", "range")))]
            yield pa.RecordBatch.from_pylist([dict(zip(MEASURED.names, r)) for r in rows], schema=MEASURED)

    ranges = materialize(tasks.mapInArrow(measured, "item bigint, range int, words bigint, chars bigint, load double"))
    big = oversized(ranges, lim)
    order = W.partitionBy("item").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in ("load", "words", "chars")]
    plan = tasks.join(ranges.select("item", "range", *before), ["item", "range"]).join(big.select("item", F.col("load").alias("total")), "item")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, p, n, load, words, chars, total in zip(*(b.column(c).to_pylist() for c in ("item", "path", "range", "load_before", "words_before", "chars_before", "total"))):
                text, at = part(p, n, lim.halo)
                rows += [(i, line, c + chars, w, nxt + chars, nw) for line, c, w, nxt, nw in cuts(text, at, load, words, total, lim)]
            yield pa.RecordBatch.from_pylist([dict(zip(CUTS.names, r)) for r in rows], schema=CUTS)

    found = plan.select("item", "path", "range", "load_before", "words_before", "chars_before", "total").mapInArrow(cut, "item bigint, line bigint, cut bigint, words bigint, next bigint, next_words bigint")
    return files.select("item", "path").join(pieces_of(found, big), "item").drop("item")
