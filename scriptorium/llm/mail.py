"""Reducing every e-mail to what its sender newly wrote (problem 7).

Three sources of evidence meet in one pass over the lines:

* what earlier messages of the thread hold already, found by a generalised suffix automaton over them, whatever the wrapping and prefixes of the lines;
* what ends messages: paragraphs that end several messages of one sender, and lines and paragraphs that stand near the end of messages of several senders and hardly anywhere else, learned over all messages;
* the layout rules of `mailtext`, with its word lists as a fallback.

Within a thread only messages that share a chunk digest are compared, each with the earliest message that holds the digest, so a thread of a third of all rows
costs one link per message and digest. Automata are built over a bounded number of characters: longer texts go in pieces that overlap by what a match has at least.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import mailtext
from scriptorium.llm.chunks import Digests, chunks, code_points
from scriptorium.llm.components import author_key
from scriptorium.llm.overlap import is_email
from scriptorium.session import materialize, skew_join

#: Inherited text has this many characters at least, white space and prefixes aside; a sender's ending recurs in so many messages.
LONG, RECURS = 120, 3
#: Senders whose messages a line or paragraph must end to count as an ending of all, and the share of its places that lie near an end.
SENDERS, AT_ENDS = 5, 0.9
#: Characters of earlier messages in one automaton and of one piece of a message, and messages that stream through it in one task.
SOURCE_CHARS, PIECE, READERS = 200_000, 50_000, 256


class Automaton:
    """Suffix automaton of several texts, added in order of time; a state knows the first text that holds its strings."""

    def __init__(self) -> None:
        self.to: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, first: int, to: dict[str, int], link: int) -> int:
        self.to.append(to)
        self.length.append(length)
        self.first.append(first)
        self.link.append(link)
        return len(self.to) - 1

    def add(self, text: str, order: int) -> None:
        last = 0
        for ch in text:
            if ch in self.to[last]:
                q = self.to[last][ch]
                if self.length[q] == self.length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, ch, q)
                continue
            cur = self._state(self.length[last] + 1, order, {}, 0)
            p = last
            while p != -1 and ch not in self.to[p]:
                self.to[p][ch] = cur
                p = self.link[p]
            if p != -1:
                q = self.to[p][ch]
                self.link[cur] = q if self.length[p] + 1 == self.length[q] else self._clone(p, ch, q)
            last = cur

    def _clone(self, p: int, ch: str, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.to[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.to[p].get(ch) == q:
            self.to[p][ch] = clone
            p = self.link[p]
        return clone

    def inherited(self, text: str, before: int, least: int) -> list[tuple[int, int]]:
        """Stretches of at least `least` characters of `text` that a text added under a smaller order holds.

        Where the longest match is of a later text only, shorter ones that end at the same place are tried: the states that the suffix links lead to.
        """
        out: list[tuple[int, int]] = []
        state = run = 0
        for i, ch in enumerate(text):
            while state and ch not in self.to[state]:
                state = self.link[state]
                run = self.length[state]
            if ch not in self.to[state]:
                continue
            state, run = self.to[state][ch], run + 1
            held, n = state, run
            while n >= least and self.first[held] >= before:
                held = self.link[held]
                n = self.length[held] if held > 0 else 0
            if n >= least:
                if out and out[-1][1] >= i + 1 - n:
                    out[-1] = (min(out[-1][0], i + 1 - n), i + 1)
                else:
                    out.append((i + 1 - n, i + 1))
        return out


def flat(raw: str) -> tuple[str, list[tuple[int, int]]]:
    """The message without prefixes and white space, and where each line lies in it."""
    parts, places, at = [], [], 0
    for line in raw.split("\n"):
        t = re.sub(r"\s+", "", mailtext.unquoted(line))
        parts.append(t)
        places.append((at, at + len(t)))
        at += len(t)
    return "".join(parts), places


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split())) - (1 << 63)


def _own_body(own: list[str]) -> int:
    """Digest of a message's own lines without white space and without a greeting, that is a first line that ends in a comma."""
    own = ["".join(x.split()) for x in own]
    return _digest("".join(own[1:] if len(own) > 1 and own[0][-1] in ",，،" and len(own[0]) <= 60 else own))


def mails(docs: DataFrame) -> DataFrame:
    """(id, document_id, sender, thread, at, author, author_id, raw): distinct e-mails; rows without id or raw_markdown are left out."""
    own = docs.where(is_email(F.col("source_type"), F.col("genre")) & F.col("document_id").isNotNull() & F.col("raw_markdown").isNotNull())
    latest = own.groupBy("document_id", F.col("raw_markdown").alias("raw")).agg(F.max(F.struct("loaded_at", "author", "author_id", F.coalesce("root_document_id", "document_id").alias("thread"), "written_at")).alias("x"))
    sender = F.coalesce(author_key(F.col("x.author_id")), F.lower("x.author"))
    return latest.select("document_id", sender.alias("sender"), F.col("x.thread").alias("thread"), F.col("x.written_at").alias("at"), F.col("x.author").alias("author"), F.col("x.author_id").alias("author_id"), "raw").withColumn("id", F.monotonically_increasing_id())


def inherited_lines(mail: DataFrame) -> DataFrame:
    """(id, lines): the lines of each message that an earlier one of its thread holds, as parts of long matches."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests = [], []
            for i, raw in zip(b.column("id").to_pylist(), b.column("raw").to_pylist()):
                p = code_points(flat(raw)[0])
                found = np.unique(chunks(Digests(p), LONG, np.array([len(p)]))[2].view(np.int64)) if len(p) >= LONG else []
                digests.extend(found)
                ids += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64())], names=["id", "digest"])

    # threads of one message, the most by far, leave first; a hot thread's rows only combine here
    busy = mail.groupBy("thread").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("thread")
    threaded = materialize(mail.select("id", "thread", "at", "raw").join(busy, "thread"))
    cut = threaded.select("id", "raw").mapInArrow(keys, "id bigint, digest bigint").join(threaded.select("id", "thread", "at"), "id")
    cut = materialize(cut)
    # the digest stands for thread and digest, so that a thread of a third of all rows is spread over its digests
    cut = cut.withColumn("key", F.xxhash64("thread", "digest"))
    first = cut.groupBy("key").agg(F.min(F.struct("at", "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("first.id").alias("source"))
    pairs = materialize(skew_join(cut, first, "key").where("id <> source").select("thread", "source", "id").distinct())
    sources = pairs.select("thread", "source").distinct().join(threaded.select(F.col("id").alias("source"), F.length("raw").alias("chars")), "source")
    size = sources.groupBy("thread").agg((F.floor(F.sum("chars") / SOURCE_CHARS) + 1).cast("int").alias("s")).join(pairs.groupBy("thread").agg((F.floor(F.approx_count_distinct("id") / READERS) + 1).cast("int").alias("r")), "thread")
    pieces = sources.select("thread", "source", F.explode(F.sequence(F.lit(0), F.floor(F.col("chars") / PIECE).cast("int"))).alias("piece"))
    pieces = skew_join(pieces, size, "thread").withColumn("shard", F.pmod(F.xxhash64("source", "piece"), F.col("s")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("r") - 1))
    held = pieces.select("thread", "shard", every.alias("block"), F.col("source").alias("id"), "piece")
    readers = skew_join(pairs, size, "thread").select("thread", "source", "id", F.pmod(F.xxhash64("id", F.lit(1)), F.col("r")).cast("int").alias("block"))
    asks = readers.join(pieces.select("source", "shard").distinct(), "source").select("thread", "shard", "block", "id", F.lit(None).cast("int").alias("piece"))
    rows = held.union(asks).distinct().join(threaded.select("id", "at", "raw"), "id")

    def match(t: pa.Table) -> pa.Table:
        found = sorted(zip(*(t.column(c).to_pylist() for c in ("at", "id", "piece", "raw"))), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2] if r[2] is not None else -1))
        order = {i: n for n, i in enumerate(dict.fromkeys(x[1] for x in found))}
        machine = Automaton()
        for _, i, piece, raw in found:
            if piece is not None:
                machine.add(flat(raw)[0][piece * PIECE : (piece + 1) * PIECE + LONG - 1], order[i])
        ids, lines = [], []
        for _, i, piece, raw in found:
            if piece is not None:
                continue
            text, places = flat(raw)
            spans = machine.inherited(text, order[i], LONG)
            own = [n for n, (a, b) in enumerate(places) if b > a and any(s <= a and b <= e for s, e in spans)]
            if own:
                ids.append(i)
                lines.append(own)
        return pa.table({"id": pa.array(ids, pa.int64()), "lines": pa.array(lines, pa.list_(pa.int32()))})

    found = rows.groupBy("thread", "shard", "block").applyInArrow(match, "id bigint, lines array<int>")
    return found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def recurring_endings(mail: DataFrame) -> DataFrame:
    """(id, endings): digests of the templates of lines and paragraphs near a message's end that are known to end messages.

    A paragraph that ends RECURS or more messages of one sender that say different things; a line or paragraph near the end of messages of SENDERS or more senders, if so are AT_ENDS of its places. Messages of equal
    own text count once for their sender, whatever they quote and whom they greet in a first line: copies of one message show nothing about its ending.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, s, raw, author, aid in zip(*(b.column(c).to_pylist() for c in ("id", "sender", "raw", "author", "author_id"))):
                own, seen = mailtext.observed(raw, author, aid)
                body = _own_body(own)
                rows += [(i, s, _digest(t), body, w) for w, t in dict.fromkeys(seen)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int8()))], names=["id", "sender", "digest", "body", "place"])

    seen = materialize(mail.select("id", "sender", "raw", "author", "author_id").mapInArrow(ends, "id bigint, sender string, digest bigint, body bigint, place tinyint"))
    near = seen.where("place > 0")
    own = near.where("place = 2 and sender is not null").groupBy("sender", "digest").agg(F.countDistinct("body").alias("n")).where(f"n >= {RECURS}").select("sender", "digest")
    # one row per template and sender first, so that a closing of a third of all messages is few rows
    per = seen.groupBy("digest", "sender").agg(F.count_if(F.col("place") > 0).alias("near"), F.count_if(F.col("place") == 0).alias("far"))
    common = per.groupBy("digest").agg(F.count_if((F.col("near") > 0) & F.col("sender").isNotNull()).alias("senders"), F.sum("near").alias("near"), F.sum("far").alias("far"))
    common = common.where((F.col("senders") >= SENDERS) & (F.col("near") >= AT_ENDS * (F.col("near") + F.col("far")))).select("digest", F.lit(True).alias("known"))
    found = near.where("sender is not null").join(own, ["sender", "digest"], "left_semi").select("id", "digest").union(skew_join(near.select("id", "digest"), common, "digest").select("id", "digest"))
    return found.groupBy("id").agg(F.collect_set("digest").alias("endings"))


def new_lines(docs: DataFrame, lists: bool = True) -> DataFrame:
    """(document_id, line_no, line): the lines of every e-mail that its sender newly wrote, counted from 0; blank lines are left out.

    Empty and null texts give no row. Of a document delivered twice with different texts, lines of either come out. `lists=False` leaves the word lists of `mailtext` out.
    """
    mail = materialize(mails(docs))
    known = mail.join(inherited_lines(mail), "id", "left").join(recurring_endings(mail), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, numbers, lines = [], [], []
            for d, raw, author, aid, inherited, endings in zip(*(b.column(c).to_pylist() for c in ("document_id", "raw", "author", "author_id", "lines", "endings"))):
                known_ends = set(endings or ())
                text, kinds = mailtext.mark(raw, author, aid, lambda p, k=known_ends: _digest(p) in k, inherited, lists)
                for n, (line, kind) in enumerate(zip(text, kinds)):
                    if kind == mailtext.NEW:
                        docs_.append(d)
                        numbers.append(n)
                        lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names=["document_id", "line_no", "line"])

    return known.select("document_id", "raw", "author", "author_id", "lines", "endings").mapInArrow(run, "document_id string, line_no bigint, line string")


def new_text(lines: DataFrame) -> DataFrame:
    """(document_id, clean_text): the new lines of each e-mail, joined; blank lines between them are not kept."""
    return lines.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("clean_text"))
