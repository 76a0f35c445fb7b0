"""Same or almost the same records across splits (problem 1).

Every text becomes a sequence of word hashes. Records of equal sequence are one class from then on.

* Shards: evaluation records of the same least hash of five-word runs, near copies as a rule, are one bucket, and buckets are put into shards. Each
  shard is one word sequence, kept as a run-length compressed Burrows-Wheeler transform: repeated stretches of near copies cost next to nothing.
* Routing: a pair whose sets of runs reach the similarity shares some of the first runs of each in any fixed order of runs (prefix filtering). So a
  training record only visits the shards of buckets with which it shares those and which hold records about its size; how many are first depends on the sizes of both. The order puts runs that are
  frequent in the corpus last, by a table of counts of hashed runs that covers all of them, and frequent ones are salted. Routing decides what is cheap, never what is found: it names no partner.
* Search: training records stream through the shard by backward search, all places at once. The interval of a run lists the records that hold it; records that hold one of the
  rarest runs found become candidates, and shared runs and their union are counted exactly.
* Spans: for every pair found, backward search of variable length gives the maximal matches of the two records; these are merged into spans and counted.

A shard that outgrows its size is cut into parts, and its training records into blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize, sift

WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
RUN = 5
#: The table of counts has SLOTS_BITS bits of a run's hash at most, in chunks of CHUNK_BITS; a count is kept as its logarithm, STEPS to a doubling. Runs per counting block.
SLOTS_BITS, CHUNK_BITS, STEPS, COUNT_BLOCK = 26, 16, 8, 1 << 22
#: Runs that a pair must share among the first ones of each; the first ones are as many more.
AGREE = 16
#: Words in an index; rows of one run in one salt.
SHARD_WORDS, SALT_ROWS = 400_000, 20_000
#: Words that stream through an index at once, and pairs looked up at once.
STREAM, LOOKUPS = 200_000, 2_000_000


def is_email(source_type: Column, genre: Column) -> Column:
    return F.coalesce(F.lower(F.trim(source_type)) == "email", F.lit(False)) | F.coalesce(F.endswith(genre, F.lit("_email")), F.lit(False))


def prose(docs: DataFrame) -> DataFrame:
    """Rows of corpus_docs that aren't e-mails and have an id and a clean_text."""
    return docs.where(F.col("document_id").isNotNull() & F.col("clean_text").isNotNull() & ~is_email(F.col("source_type"), F.col("genre")))


def words_of(text: str) -> list[str]:
    """Runs of letters or digits of the lower-cased NFKC form; each kana or Han character is a word."""
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def word_hashes(text: str, known: dict[str, int]) -> np.ndarray:
    words = words_of(text)
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)


def runs(words: np.ndarray, n: int = RUN) -> np.ndarray:
    """Hashes of all runs of n consecutive words, in order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ words[i : len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def tokenised(docs: DataFrame) -> DataFrame:
    """(id, document_id, side, n, least, digest, words) for `docs(document_id, side, text)`: n distinct runs, the least of their hashes, the sequence and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            if len(known) > 1_000_000:
                known = {}
            ns, leasts, digests, seqs = [], [], [], []
            for t in b.column("text").to_pylist():
                w = word_hashes(t, known)
                raw = w.tobytes()
                own = np.unique(runs(w))
                ns.append(len(own))
                leasts.append(int(own[0].view(np.int64)) if len(own) else 0)
                seqs.append(raw)
                digests.append(xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("document_id"), b.column("side"), pa.array(ns, pa.int32()), pa.array(leasts, pa.int64()), pa.array(digests, pa.binary()), pa.array(seqs, pa.binary())], names=["id", "document_id", "side", "n", "least", "digest", "words"])

    return docs.withColumn("id", F.monotonically_increasing_id()).select("id", "document_id", "side", "text").mapInArrow(run, "id bigint, document_id string, side int, n int, least bigint, digest binary, words binary")


def slots_of(own: np.ndarray, bits: int) -> np.ndarray:
    """Places of runs in a table of counts."""
    return (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def run_counts(tokens: DataFrame, total: int) -> np.ndarray:
    """How often runs occur in all records, by slot of their hash: STEPS times the binary logarithm, rounded; 0 where only one side has any. Runs of one slot are counted together.

    There are about as many slots as half of the `total` runs, at most 1 << SLOTS_BITS (a byte each): more than fixed numbers of frequent runs, the table tells rare runs from less rare ones on large inputs too.
    """
    bits = max(CHUNK_BITS, min(SLOTS_BITS, int(total).bit_length() - 1))
    low = (1 << CHUNK_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = [0, 0]

        def counted(side: int) -> pa.RecordBatch:
            every, n = np.unique(np.concatenate(held[side]), return_counts=True)
            held[side].clear()
            size[side] = 0
            chunk, start = np.unique(every >> np.uint32(CHUNK_BITS), return_index=True)
            at, n = np.split((every & np.uint32(low)).astype(np.uint16), start[1:]), np.split(n.astype(np.uint32), start[1:])
            once = [x == 1 for x in n]  # most are: these need no number
            cols = [[x[o].tobytes() for x, o in zip(at, once)], [x[~o].tobytes() for x, o in zip(at, once)], [x[~o].tobytes() for x, o in zip(n, once)]]
            return pa.RecordBatch.from_arrays([pa.array(chunk.astype(np.int32)), pa.array(np.full(len(chunk), side, np.int32)), *(pa.array(c, pa.binary()) for c in cols)], names=["chunk", "side", "once", "slots", "n"])

        for b in batches:
            for side, raw in zip(b.column("side").to_pylist(), b.column("words").to_pylist()):
                own = slots_of(np.unique(runs(np.frombuffer(raw, np.uint64))), bits).astype(np.uint32)
                held[side].append(own)
                size[side] += len(own)
                if size[side] > COUNT_BLOCK:
                    yield counted(side)
        yield from (counted(side) for side in (0, 1) if size[side])

    def add(t: pa.Table) -> pa.Table:
        n = np.zeros((2, low + 1), np.int64)
        for side, once, slots, many in zip(*(t.column(c).to_pylist() for c in ("side", "once", "slots", "n"))):
            n[side, np.frombuffer(once, np.uint16)] += 1
            n[side, np.frombuffer(slots, np.uint16)] += np.frombuffer(many, np.uint32)
        level = np.where(n.all(0), np.rint(STEPS * np.log2(np.maximum(n.sum(0), 1))).clip(0, 255), 0)
        return pa.table({"chunk": t.column("chunk")[:1], "level": pa.array([level.astype(np.uint8).tobytes()], pa.binary())})

    found = tokens.select("side", "words").mapInArrow(run, "chunk int, side int, once binary, slots binary, n binary").groupBy("chunk").applyInArrow(add, "chunk int, level binary").toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    for chunk, level in zip(found.column("chunk").to_pylist(), found.column("level").to_pylist()):
        levels[chunk << CHUNK_BITS : (chunk + 1) << CHUNK_BITS] = np.frombuffer(level, np.uint8)
    return levels


def needed(n: int, similarity: float) -> int:
    """How many first runs a record of n runs shares with any partner: AGREE, or fewer if it is so short that they may not share as many."""
    return min(AGREE, max(1, int(np.ceil(similarity * n - 1e-9))))


def size_class(n: int | np.ndarray) -> np.ndarray:
    """Sizes by tenths; partners of a similarity are few classes apart."""
    return np.minimum(255, np.log(n) / np.log(1.1)).astype(np.int64)


def classes_apart(similarity: float) -> int:
    return int(np.ceil(np.log(1 / similarity) / np.log(1.1) + 1e-9))


def first_runs(own: np.ndarray, levels: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a record's distinct runs those that a partner may have to share, in the common order (count, then hash); how often each occurs, about; and the largest size class of partners for which it is among the first.

    With m and n runs, two records of the similarity s share at least a = ceil(s * max(m, n)) runs, and a >= t * (m + n) for t = s / (1 + s). So they share at least min(AGREE, a) among the first
    n - a + min(AGREE, a) of the one and as many in the other. Run r (from 0) of n is among these only if t * m < AGREE - r + (1 - t) * n. Runs of level 0, which no partner holds, come first and are not returned.
    """
    n, least, t = len(own), int(np.ceil(similarity * len(own) - 1e-9)), similarity / (1 + similarity)
    often = levels[slots_of(own, len(levels).bit_length() - 1)]
    first = np.argsort(often, kind="stable")[: n - least + min(AGREE, least)]
    most = (AGREE - np.arange(len(first)) + (1 - t) * n) / t
    first, most = first[often[first] > 0], most[often[first] > 0]
    return own[first], np.exp2(often[first] / STEPS).astype(np.int64), size_class(np.maximum(most, 1) * (1 + 1e-9))


def prefixes(tokens: DataFrame, levels: Broadcast, similarity: float, side: int) -> DataFrame:
    """(run, who, size, top) of the records of one side, by the first runs of each. `size` is the size class and `top` the largest one of partners; `who` is the bucket, for training records (side 0) id and `needed`.

    A run is named by 32 bits: two of one name can only add a visit. A frequent run has several names: a training record takes one of them, a bucket all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for b in batches:
            names, owners, sizes, tops = [], [], [], []
            for i, who, raw in zip(b.column("id").to_pylist(), b.column("who").to_pylist(), b.column("words").to_pylist()):
                own = np.unique(runs(np.frombuffer(raw, np.uint64)))
                n = len(own)
                if not n:
                    continue
                own, often, top = first_runs(own, table, similarity)
                salts = often // SALT_ROWS + 1
                if side:
                    turn = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                    own, top = np.repeat(own, salts), np.repeat(top, salts)
                else:
                    turn, who = np.uint64(i * 0x9E3779B1 % (1 << 31)) % salts.astype(np.uint64), (i << 5) | needed(n, similarity)
                own = (own + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
                names.append((own >> np.uint64(32)).astype(np.uint32).view(np.int32))
                owners.append(np.full(len(own), who, np.int64))
                sizes.append(np.full(len(own), size_class(n), np.int16))
                tops.append(top.astype(np.int16))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (names, owners, sizes, tops)], names=["run", "who", "size", "top"])

    return tokens.select("id", "who", "words").mapInArrow(run, "run int, who bigint, size smallint, top smallint")


class RunIndex:
    """Full-text index of several word sequences.

    The Burrows-Wheeler transform is kept as its runs of equal symbols, sorted by symbol and row: one number for where a run starts and one for how many rows precede it.
    A step of backward search is one binary search among the runs. Every five-word interval also lists the sequences that hold it.
    """

    def __init__(self, sequences: list[np.ndarray]):
        every = np.concatenate([np.concatenate([s, np.zeros(1, np.uint64)]) for s in sequences])
        ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
        own = np.ones(len(every), bool)
        own[ends] = False
        self.alphabet = np.unique(every[own])
        text = np.zeros(len(every), np.int64)  # 0 separates
        text[own] = np.searchsorted(self.alphabet, every[own]) + 1
        n = self.size = len(text)
        rank, width = text.copy(), 1
        while True:
            ahead = np.full(n, -1, np.int64)
            ahead[: n - width] = rank[width:] if width < n else 0
            key = rank * (n + 2) + ahead + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            sorted_key = key[order]
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            done = new[order[-1]] == n - 1
            rank, width = new, width * 2
            if done or width >= n:
                break
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        bwt = text[self.suffixes - 1]
        heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        lengths = np.diff(np.append(heads, n))
        keys = bwt[heads] * n + heads
        order = np.argsort(keys)
        self.keys = keys[order]
        self.before = np.concatenate([[0], np.cumsum(lengths[order])])
        # rows whose suffixes start with the same five words are one group; a group lists its sequences
        padded = np.concatenate([text, np.zeros(RUN, np.int64)])
        fresh, inside = np.zeros(n, bool), np.ones(n, bool)
        fresh[0] = True
        for k in range(RUN):
            word = padded[self.suffixes.astype(np.int64) + k]
            fresh[1:] |= word[1:] != word[:-1]
            inside &= word > 0
        self.group = (np.cumsum(fresh) - 1).astype(np.int32)
        owner = np.searchsorted(ends, self.suffixes)
        count = len(sequences)
        held = np.unique(self.group[inside].astype(np.int64) * count + owner[inside])
        self.listed = (held % count).astype(np.int32)
        self.lists = np.searchsorted(held // count, np.arange(int(self.group[-1]) + 2))
        self.pairs = np.sort((held % count) * (int(self.group[-1]) + 1) + held // count)
        self.groups = int(self.group[-1]) + 1
        self.distinct = np.bincount(self.listed, minlength=count)
        self.ends = ends
        self.owned: np.ndarray | None = None  # rows by sequence, made where maximal matches are asked for

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for those that no sequence holds."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows of smaller symbols plus how often the symbol stands ahead of the row: one end of the interval after a step."""
        ask = symbol * self.size + row
        j = np.searchsorted(self.keys, ask) - 1
        at = np.maximum(j, 0)
        return np.where(j >= 0, self.before[at] + np.minimum(ask - self.keys[at], self.before[at + 1] - self.before[at]), 0)

    def intervals(self, symbol: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the n words that end at each place of `last`; empty where they don't occur."""
        lo, hi = np.zeros(len(last), np.int64), np.full(len(last), self.size, np.int64)
        live = np.flatnonzero(last >= n - 1)
        hi[last < n - 1] = 0
        for k in range(n):
            s = symbol[last[live] - k]
            ok = s > 0
            hi[live[~ok]] = lo[live[~ok]] = 0
            live, s = live[ok], s[ok]
            lo[live], hi[live] = self.back(s, lo[live]), self.back(s, hi[live])
            live = live[lo[live] < hi[live]]
        empty = lo >= hi
        lo[empty] = hi[empty] = 0
        return lo, hi

    def matches(self, words: np.ndarray, n: int = RUN) -> np.ndarray:
        """For every run of five words its group in the index, or -1: backward search from all ends at once."""
        if len(words) < n:
            return np.zeros(0, np.int64)
        lo, hi = self.intervals(self.symbols(words), np.arange(n - 1, len(words)), n)
        return np.where(lo < hi, self.group[lo], -1).astype(np.int64)

    def maximal(self, asked: list[tuple[np.ndarray, int]], n: int = RUN) -> list[np.ndarray]:
        """For every (words, sequence) the (start, end) of their maximal matches of n words or more: no word can be added at either side of any of them.

        A match may end only where some occurrence of the last n words in the sequence is not followed by the next word; from these ends backward search runs as far as it gets, for all pairs at once.
        """
        if not asked:
            return []
        if self.owned is None:
            self.owned = np.sort(np.searchsorted(self.ends, self.suffixes).astype(np.int64) * (self.size + 1) + np.arange(self.size))
        length = np.array([len(w) for w, _ in asked])
        first = np.cumsum(length + 1) - length - 1
        symbol = np.full(int(length.sum()) + len(asked), -1)  # -1 parts the texts
        for (w, _), at in zip(asked, first):
            symbol[at : at + len(w)] = self.symbols(w)
        pair = np.repeat(np.arange(len(asked)), length + 1)
        sequence = np.array([e for _, e in asked], np.int64)[pair] * (self.size + 1)
        inside = lambda at, lo, hi: np.searchsorted(self.owned, sequence[at] + hi) - np.searchsorted(self.owned, sequence[at] + lo)
        last = np.arange(n - 1, len(symbol) - 1)
        lo, hi = self.intervals(symbol, last, n)
        here, further = inside(last, lo, hi), inside(last, *self.intervals(symbol, last + 1, n + 1))
        stop = (here > 0) & (further < here)
        end, lo, hi = last[stop], lo[stop], hi[stop]
        start = end - n + 1
        live = np.flatnonzero(start > 0)
        while len(live):
            s = symbol[start[live] - 1]
            live, s = live[s > 0], s[s > 0]
            a, b = self.back(s, lo[live]), self.back(s, hi[live])
            ok = inside(end[live], a, b) > 0
            live = live[ok]
            lo[live], hi[live] = a[ok], b[ok]
            start[live] -= 1
            live = live[start[live] > 0]
        whole = start < np.append(np.minimum.accumulate(start[::-1])[::-1][1:], len(symbol))  # else a match that ends later holds it
        found = np.stack([start[whole], end[whole] + 1], 1)
        cut = np.searchsorted(pair[end[whole]], np.arange(len(asked) + 1))
        return [found[a:b] - at for a, b, at in zip(cut, cut[1:], first)]


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end), sorted by end, as disjoint spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def _expand(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of given starts and sizes the number of the range of every element, and the elements."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _partners(index: RunIndex, asked: list[np.ndarray], sizes: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int]]:
    """(asked, sequence, shared runs) of all pairs of the similarity. `sizes` are the asked ones' numbers of distinct runs."""
    length = np.array([len(w) for w in asked])
    owner = np.repeat(np.arange(len(asked)), length)
    found = index.matches(np.concatenate(asked))
    place = np.arange(len(found))
    held = (found >= 0) & (owner[place] == owner[place + RUN - 1])
    own = np.unique(owner[place[held]] * index.groups + found[held])
    doc, group = own // index.groups, own % index.groups
    hits = np.bincount(doc, minlength=len(asked))
    least = np.ceil(similarity * sizes - 1e-9).astype(np.int64)
    # a partner holds one of the rarest runs, those that no sequence holds being the rarest of all
    often = index.lists[group + 1] - index.lists[group]
    order = np.lexsort((often, doc))
    first = np.concatenate([[0], np.cumsum(hits)[:-1]])
    rarest = order[np.arange(len(order)) - first[doc[order]] < (hits - least + 1)[doc[order]]]
    which, at = _expand(index.lists[group[rarest]], often[rarest])
    count = len(index.ends)
    pairs = np.unique(doc[rarest[which]] * count + index.listed[at])
    a, e = pairs // count, pairs % count
    near = np.minimum(sizes[a], index.distinct[e]) >= similarity * np.maximum(sizes[a], index.distinct[e]) - 1e-9
    a, e = a[near], e[near]
    step = max(1, LOOKUPS // max(1, int(hits.max(initial=1))))
    for i in range(0, len(a), step):
        which, at = _expand(first[a[i : i + step]], hits[a[i : i + step]])
        key = e[i : i + step][which] * index.groups + group[at]
        there = np.minimum(np.searchsorted(index.pairs, key), len(index.pairs) - 1)
        shared = np.bincount(which[index.pairs[there] == key], minlength=len(a[i : i + step]))
        for x, y, n in zip(a[i : i + step].tolist(), e[i : i + step].tolist(), shared.tolist()):
            if n and n >= similarity * (sizes[x] + index.distinct[y] - n) - 1e-9:
                yield x, y, n


def _search(t: pa.Table, similarity: float) -> pa.Table:
    """Pairs of one part of a shard and one block of training records."""
    ids, sides, words = t.column("id").to_pylist(), t.column("side").to_pylist(), t.column("words").to_pylist()
    held, asked = ([(i, np.frombuffer(w, np.uint64)) for i, s, w in sorted(zip(ids, sides, words)) if s == side] for side in (1, 0))
    rows = []
    if held and asked:
        index = RunIndex([w for _, w in held])
        at = 0
        while at < len(asked):
            to, size = at, 0
            while to < len(asked) and (to == at or size + len(asked[to][1]) <= STREAM):
                size += len(asked[to][1])
                to += 1
            some = asked[at:to]
            sizes = np.array([len(np.unique(runs(w))) for _, w in some])
            pairs = list(_partners(index, [w for _, w in some], sizes, similarity))
            for (a, e, shared), found in zip(pairs, index.maximal([(some[a][1], e) for a, e, _ in pairs])):
                spans = merged(found)
                lengths = spans[:, 1] - spans[:, 0]
                rows.append((some[a][0], held[e][0], shared, int(sizes[a] + index.distinct[e] - shared), len(spans), int(lengths.sum()), int(lengths.max())))
            at = to
    cols = list(zip(*rows)) if rows else [[]] * 7
    return pa.table([pa.array(c, ty) for c, ty in zip(cols, FOUND.types)], schema=FOUND)


FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("shared", pa.int64()), ("either", pa.int64()), ("spans", pa.int32()), ("matched", pa.int64()), ("longest", pa.int32())])


def overlaps(docs: DataFrame, similarity: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Classes of side 0 (training) and side 1 (evaluation) that are the same or almost the same.

    `docs(document_id, side, text)`; texts are not null. Returns (id, other, shared, either, spans, matched, longest) between the representatives of training and
    evaluation classes: shared runs, runs of either, merged maximal matches, their words in the training text, and the longest; and the members (id, document_id, side) of
    all classes. Texts of fewer than five words have no run and no partner. Repeated rows count once.
    """
    tokens = materialize(tokenised(docs))
    narrow = tokens.select("id", "document_id", "side", "digest", "n").where("n > 0")
    reps = narrow.groupBy("digest", "side").agg(F.min("id").alias("rep"))
    members = materialize(narrow.join(reps, ["digest", "side"]).select(F.col("rep").alias("id"), "document_id", "side").distinct())
    # copies that don't stand for their class leave; all but them and a few others pass without a shuffle
    copies = narrow.join(reps, ["digest", "side"]).where("id <> rep").select("id")
    size = tokens.where("n > 0").agg(F.sum(F.when(F.col("side") == 1, F.octet_length("words"))).alias("bytes"), F.sum("n").alias("runs")).first()
    shards = max(1, (size.bytes or 0) // 8 // SHARD_WORDS + 1)
    doubtful, sure = sift(tokens.where("n > 0").select("id", "side", "n", F.col("least").alias("who"), "words"), copies)
    own = sure.union(doubtful.join(copies, "id", "left_anti"))
    levels = tokens.sparkSession.sparkContext.broadcast(run_counts(tokens, size.runs or 0))  # 64 MB at most
    there = prefixes(own.where("side = 1"), levels, similarity, 1).groupBy("run", F.col("who").alias("bucket"), F.col("size").alias("other")).agg(F.max("top").alias("reach"))
    asking = prefixes(own.where("side = 0"), levels, similarity, 0)
    alike = (F.abs(F.col("size") - F.col("other")) <= classes_apart(similarity)) & (F.col("size") <= F.col("reach")) & (F.col("other") <= F.col("top"))
    visits = asking.join(there, "run").where(alike).groupBy("who", "bucket", "other").agg(F.count(F.lit(1)).alias("agree")).where("agree >= who & 31")
    visits = materialize(visits.select(F.shiftright("who", 5).alias("id"), "bucket").distinct())
    shard = F.pmod(F.xxhash64("bucket"), F.lit(shards)).cast("int").alias("shard")
    asked = own.where("side = 0").select("id", F.octet_length("words").alias("bytes")).join(visits.select("id", shard).distinct(), "id")
    held = own.where("side = 1").select("id", F.octet_length("words").alias("bytes"), F.col("who").alias("bucket")).join(visits.select("bucket").distinct(), "bucket", "left_semi").select("id", shard, "bytes")
    load = lambda df, name, words: df.groupBy("shard").agg(F.ceil(F.sum("bytes") / 8 / words).cast("int").alias(name))
    loads = load(held, "parts", SHARD_WORDS).join(load(asked, "blocks", 4 * SHARD_WORDS), "shard")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    tasks = held.join(loads, "shard").select("id", F.lit(1).alias("side"), "shard", one("parts").alias("part"), every("blocks").alias("block"))
    tasks = tasks.union(asked.join(loads, "shard").select("id", F.lit(0), "shard", every("parts").alias("part"), one("blocks").alias("block")))
    tasks = materialize(tasks)
    needed_ = sift(tokens.select("id", "words"), tasks.select("id"))[0]
    found = tasks.join(needed_, "id").groupBy("shard", "part", "block").applyInArrow(lambda t: _search(t, similarity), "id bigint, other bigint, shared bigint, either bigint, spans int, matched bigint, longest int")
    return materialize(found), members


def split_sides(docs: DataFrame) -> DataFrame:
    """(document_id, side, text) of prose: side 0 for train, 1 for any other split; rows without a split are left out."""
    return prose(docs).where("split is not null").select("document_id", F.when(F.col("split") == "train", 0).otherwise(1).alias("side"), F.col("clean_text").alias("text"))


def document_pairs(found: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_a, doc_b, shared, either, spans, matched, longest) with doc_a < doc_b, every member of the one class with every member of the other."""
    a = members.where("side = 0").select("id", F.col("document_id").alias("x"))
    b = members.where("side = 1").select(F.col("id").alias("other"), F.col("document_id").alias("y"))
    both = found.join(a, "id").join(b, "other").where("x <> y")
    return both.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(*(F.max(c).alias(c) for c in ("shared", "either", "spans", "matched", "longest")))


def document_links(found: DataFrame, members: DataFrame) -> DataFrame:
    """(document_id, side, class_id, links): every document of a side with its class and the number of documents of the other side that overlap it; copies are not paired with each other.

    A document delivered with different texts has a row for each; the own document is counted too where it stands on both sides.
    """
    copies = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    way = lambda own, other: found.select(F.col(own).alias("own"), F.col(other).alias("id")).join(copies, "id").groupBy("own").agg(F.sum("copies").alias("links"))
    links = way("id", "other").union(way("other", "id")).withColumnRenamed("own", "id")
    return members.join(links, "id", "left").select("document_id", "side", F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def overlap_report(docs: DataFrame, found: DataFrame, members: DataFrame) -> DataFrame:
    """(split, source_type, documents, overlapping, largest_share, spans, matched_words, longest_span): evaluation prose per split and source type, how much of it occurs in
    train, and of each document's closest partner the merged spans, their words and the longest."""
    best = F.max(F.struct((F.col("shared") / F.col("either")).alias("share"), "matched", "spans", "longest"))
    hit = found.groupBy(F.col("other").alias("id")).agg(best.alias("x"))
    by_doc = members.where("side = 1").join(hit, "id").groupBy("document_id").agg(F.max("x").alias("x"))
    kind = F.coalesce(F.lower(F.trim("source_type")), F.lit("none")).alias("source_type")
    own = prose(docs).where("split <> 'train'").select("document_id", "split", kind).distinct()
    return own.join(by_doc, "document_id", "left").groupBy("split", "source_type").agg(
        F.countDistinct("document_id").alias("documents"), F.count("x").alias("overlapping"), F.round(F.max("x.share"), 6).alias("largest_share"),
        F.coalesce(F.sum("x.spans"), F.lit(0)).alias("spans"), F.coalesce(F.sum("x.matched"), F.lit(0)).alias("matched_words"), F.max("x.longest").alias("longest_span"),
    )
