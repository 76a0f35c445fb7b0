"""Build a reference bank from an author's prose, store it, and score new prose against it in batches.

A score says how compatible the style of a text is with the bank. It is no probability of authorship and no detector of machines.
"""

from __future__ import annotations

import html
import json
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium import __version__
from scriptorium.functions import measures as M
from scriptorium.functions import text as T
from scriptorium.operators import distributions as D
from scriptorium.operators import segments
from scriptorium.operators import similarity as S
from scriptorium.operators.groups import fingerprint
from scriptorium.operators.metrics import decision
from scriptorium.session import materialize

Encoder = Callable[[list[str]], np.ndarray]


def projection_encoder(texts: list[str], width: int = 64) -> np.ndarray:
    """A stand-in for a neural encoder: signed random projection of word counts. Every word has a fixed direction, the signs of the bits of its hash. Give your own function, or vectors, for real use."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts):
        row[0] = 1e-3  # texts without words
        for word, n in Counter(segments.WORD.findall(text.lower())).items():
            bits = np.frombuffer(hashlib.blake2b(word.encode(), digest_size=width // 8).digest(), np.uint8)
            row += np.float32(n**0.5) * (2.0 * np.unpackbits(bits) - 1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


@dataclass(frozen=True)
class Settings:
    model_id: str = "projection"
    revision: str = "1"
    weights: tuple[float, float, float] = (0.60, 0.25, 0.15)
    match: float = 70.0
    mismatch: float | None = 40.0
    schema_version: int = 1


def embedding_key(text, settings: Settings):  # noqa: ANN001, ANN201
    """Digest of a passage's text and of what made its vector."""
    return F.sha2(F.to_json(F.array(text, F.lit(settings.model_id), F.lit(settings.revision), F.lit(str(settings.schema_version)))), 256)


def _encoded(encoder: Encoder, texts: list[str], batch: int) -> np.ndarray:
    """Vectors of texts, `batch` at a time; a batch that runs out of memory is halved, a single text that does is an error."""
    try:
        return np.concatenate([np.asarray(encoder(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)])
    except MemoryError:
        if batch == 1:
            raise
        return _encoded(encoder, texts, batch // 2)


def embed(passages: DataFrame, encoder: Encoder, settings: Settings, cache: DataFrame | None = None, batch: int = 64, most: int = 4_096) -> DataFrame:
    """`passages` with `embedding_key` and `embedding`: only distinct texts that the cache lacks are encoded, long ones together.

    A passage of more than `most` tokens is an error, never cut; tokens are counted by the encoder's `count_tokens`, or as words if it has none.
    """
    count = getattr(encoder, "count_tokens", None) or (lambda t: len(segments.WORD.findall(t)))
    keyed = passages.withColumn("embedding_key", embedding_key(F.col("text"), settings))
    new = keyed.select("embedding_key", "text").dropDuplicates(["embedding_key"])
    if cache is not None:
        new = new.join(cache.select("embedding_key"), "embedding_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("embedding_key"), b.column("text").to_pylist()
            if any(len(t) > most and count(t) > most for t in texts):
                raise ValueError(f"a passage has more than {most} tokens")
            vectors = _encoded(encoder, texts, batch) if texts else np.zeros((0, 1), np.float32)
            if not np.isfinite(vectors).all() or (len(vectors) and not np.abs(vectors).sum(1).all()):
                raise ValueError("the encoder gave a vector that is not finite or all zero")
            yield pa.RecordBatch.from_arrays([keys, pa.array(list(vectors), pa.list_(pa.float32()))], names=["embedding_key", "embedding"])

    found = new.sortWithinPartitions(F.length("text")).mapInArrow(run, "embedding_key string, embedding array<float>")
    if cache is not None:
        found = found.unionByName(cache.select("embedding_key", "embedding"))
    return keyed.join(found, "embedding_key")


SIGNALS = ("authorship", "stylometry", "character")


class Engine:
    """A bank: passages with vectors and measures of its documents, and their history: what each of its documents scores against all others, by which the signals of candidates are normalised."""

    def __init__(self, spark: SparkSession, settings: Settings, encoder: Encoder, passages: DataFrame, measures: DataFrame, history: DataFrame | None = None):
        self.spark, self.settings, self.encoder, self.passages, self.measures, self._history = spark, settings, encoder, passages, measures, history
        self._fitted: dict[str, DataFrame] = {}

    @classmethod
    def build(cls, docs: DataFrame, encoder: Encoder = projection_encoder, settings: Settings = Settings(), cache: DataFrame | None = None) -> Engine:
        """From `docs(document_id, text)`; documents of equal prose count once. An empty bank is an error when it is used."""
        own = docs.where("text is not null").withColumn("_digest", F.sha2("text", 256)).groupBy("_digest").agg(F.min_by(F.struct("document_id", "text"), "document_id").alias("d")).select("d.*")
        passages = materialize(embed(segments.passages(own), encoder, settings, cache))
        return cls(docs.sparkSession, settings, encoder, passages, materialize(M.measured(own, keep=("document_id",))))

    def once(self, name: str, work: Callable[[], DataFrame]) -> DataFrame:
        """A table that depends on the bank alone, worked out at its first use."""
        if name not in self._fitted:
            self._fitted[name] = materialize(work())
        return self._fitted[name]

    @property
    def distribution(self) -> DataFrame:
        return self.once("distribution", lambda: D.distribution(M.long_form(self.measures, ())))

    @property
    def history(self) -> DataFrame:
        """(document_id, authorship, stylometry, character) of every document of the bank against the others. Passages that a document shares with others, as a whole or by a paragraph of twenty words, are left out for it."""
        if self._history is None:
            self._history = materialize(self._leave_one_out())
        return self._history

    def _keyed(self) -> DataFrame:
        """Passages with digests of their text and of their long paragraphs."""
        long = F.filter(T.paragraphs(F.col("text")), lambda p: T.word_count(p) >= 20)
        return self.passages.withColumn("keys", F.array_distinct(F.concat(F.array(F.xxhash64("text")), F.transform(long, lambda p: F.xxhash64(F.trim(p))))))

    def _leave_one_out(self) -> DataFrame:
        keyed = materialize(self._keyed())
        all_keys = keyed.groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("all_keys"))
        numbered = keyed.join(all_keys, "document_id").select(F.xxhash64("document_id").alias("c"), F.col("embedding").cast("array<double>").alias("v"), "keys", "all_keys")
        asked = numbered.select("c", F.col("c").alias("own"), "v", F.col("all_keys").alias("keys"))
        bank = numbered.select(F.col("c").alias("r"), F.col("c").alias("own"), "v", "keys")
        authorship = S.against_rest(asked, bank).where("n > 0").select("c", F.col("mid").alias("authorship"))
        style = D.similarity_to_rest(self.measures, ("document_id",)).withColumnRenamed("similarity", "stylometry")
        chars = S.symmetric_sparse(self._weights(), self._weights(), self._vocabulary()[1]).withColumnRenamed("similarity", "character")
        docs = self.measures.select("document_id", F.xxhash64("document_id").alias("c"))
        return docs.join(authorship, "c").join(style, "document_id").join(chars, "document_id").select("document_id", *SIGNALS)

    def spread(self) -> dict[str, tuple[float, float, float, int]]:
        """Median, median absolute deviation, population deviation and number of each signal in the history."""
        if not hasattr(self, "_spread"):
            long = materialize(self.history.select(F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in SIGNALS))).alias("x")).select("x.*"))
            centre = D.exact_medians(long, "signal")
            std = long.groupBy("signal").agg(F.stddev_pop("value").alias("std"))
            off = long.join(F.broadcast(centre.select("signal", "median")), "signal").select("signal", F.abs(F.col("value") - F.col("median")).alias("value"))
            mad = D.exact_medians(off, "signal").select("signal", F.col("median").alias("mad"))
            self._spread = {r.signal: (r.median, r.mad, r.std, r.n) for r in centre.join(mad, "signal").join(std, "signal").collect()}
        return self._spread

    def save(self, path: str) -> None:
        """Tables first, the manifest with their digests last: a folder without manifest is no bank."""
        tables = {"passages": self.passages, "measures": self.measures, "history": self.history}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        digests = {name: _digest(self.spark.read.parquet(f"{path}/{name}")) for name in tables}
        manifest = {"version": __version__, "settings": asdict(self.settings), "features": M.NAMES, "digests": digests, "spread": self.spread()}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: Encoder = projection_encoder) -> Engine:
        """A saved bank. Another schema, other features, changed tables, unusable vectors and keys that don't fit the texts are errors."""
        m = json.loads(spark.read.text(f"{path}/manifest").first().value)
        settings = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in m["settings"].items()})
        if settings.schema_version != Settings().schema_version or m["features"] != M.NAMES:
            raise ValueError("the bank was made by an incompatible version")
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in m["digests"]}
        for name, df in tables.items():
            if _digest(df) != m["digests"][name]:
                raise ValueError(f"the bank's {name} have changed since it was saved")
        passages = tables["passages"]
        if passages.count() != S.vectors_of(passages, ["embedding_key"]).count():
            raise ValueError("the bank holds unusable vectors")
        if not passages.where(F.col("embedding_key") != embedding_key(F.col("text"), settings)).isEmpty():
            raise ValueError("the bank's vectors belong to other texts")
        return cls(spark, settings, encoder, passages, tables["measures"], tables["history"])

    def _numbered(self, passages: DataFrame, doc: str, number: str) -> DataFrame:
        return passages.select(F.xxhash64("document_id").alias(doc), F.xxhash64("document_id", "passage_id").alias(number), F.col("embedding").cast("array<double>").alias("v"))

    def _vocabulary(self) -> tuple[dict[str, int], np.ndarray]:
        """Numbers and idf of the bank's grams, at most 50,000."""
        if not hasattr(self, "_grams"):
            self._grams = S.numbered_grams(S.gram_vocabulary(self.passages))
        return self._grams

    def _weights(self) -> DataFrame:
        """Grams of the bank's passages; vocabulary and document counts are those of the whole bank."""
        return self.once("weights", lambda: S.gram_vectors(self.passages.select("document_id", "text"), self._vocabulary()[0]))

    def _character(self, asked: DataFrame) -> DataFrame:
        """(document_id, character): the median over all bank documents of the mean best cosine of passages, both ways; passages that share no gram have 0."""
        numbers, idf = self._vocabulary()
        own = materialize(S.gram_vectors(asked.select(F.concat(F.lit("\x1f"), "document_id").alias("document_id"), "text"), numbers))  # candidates bear a mark
        found = S.symmetric_sparse(own, self._weights(), idf)
        return found.select(F.substring("document_id", 2, 1 << 30).alias("document_id"), F.col("similarity").alias("character"))

    def signals(self, candidates: DataFrame) -> DataFrame:
        """(candidate_id, words, authorship, stylometry, character) of `candidates(candidate_id, text)`, the raw signals. Texts of fewer than three words are left out."""
        own = candidates.where(T.word_count(F.col("text")) >= 3).select(F.col("candidate_id").cast("string").alias("document_id"), "text")
        cp = materialize(embed(segments.passages(own), self.encoder, self.settings))
        vectors = lambda p, side: p.select(F.xxhash64("document_id").alias(side), F.lit(None).cast("bigint").alias("own"), F.col("embedding").cast("array<double>").alias("v"))
        sim = S.against_rest(vectors(cp.withColumn("document_id", F.concat(F.lit("\x1f"), "document_id")), "c"), vectors(self.passages, "r"))
        authorship = sim.where("n > 0").select("c", F.col("mid").alias("authorship"))
        wide = M.measured(own, keep=("document_id",))
        style = D.stylometry_similarity(wide, self.distribution, ("document_id",)).withColumnRenamed("similarity", "stylometry")
        chars = self._character(cp)
        out = own.select("document_id", F.xxhash64(F.concat(F.lit("\x1f"), "document_id")).alias("c"), T.word_count(F.col("text")).alias("words")).join(authorship, "c", "left").join(style, "document_id").join(chars, "document_id", "left")
        return out.select(F.col("document_id").alias("candidate_id"), "words", "authorship", "stylometry", F.coalesce("character", F.lit(0.0)).alias("character"))

    def normalised(self, signal: str) -> Column:
        """A signal against the history; without history the signal itself, cut to 0..1."""
        median, mad, std, n = self.spread().get(signal, (None, None, None, 0))
        value = F.coalesce(F.col(signal), F.lit(0.0))
        lit = lambda x: F.lit(x).cast("double")
        return D.normalise(value, lit(median), lit(mad), lit(std), F.lit(n))

    def score(self, candidates: DataFrame) -> DataFrame:
        """Raw signals, their components (normalised by the bank's history), `score` (0 to 100), `decision` and `evidence_strength` of every candidate, in one plan."""
        w = self.settings.weights
        out = self.signals(candidates).withColumns({f"{s}_component": self.normalised(s) for s in SIGNALS})
        parts = [F.col(f"{s}_component") for s in SIGNALS]
        out = out.withColumn("score", 100 * sum((x * p for x, p in zip(w, parts)), F.lit(0.0)) / sum(w))
        mismatch = F.lit(self.settings.mismatch).cast("double")
        return out.withColumn("decision", decision(F.col("score"), F.lit(self.settings.match), mismatch)).withColumn("evidence_strength", D.evidence_strength(F.col("words"), *parts))

    def evaluation(self) -> DataFrame:
        """(document_id, SIGNALS components, score, without_characters, spread) of the bank's own documents: each by its signals against the others, normalised by the others' signals, itself left out."""
        others = materialize(self.history.select("document_id", F.explode(F.array(*(F.struct(F.lit(s).alias("feature"), F.col(s).alias("value")) for s in SIGNALS))).alias("x")).select("document_id", "x.*"))
        rest = F.broadcast(D.leave_one_out(others.select("feature", "value")))  # three rows
        out = D.against_rest(others.join(rest, "feature")).groupBy("document_id").pivot("feature", list(SIGNALS)).agg(F.first("component"))
        w, parts = self.settings.weights, [F.col(s) for s in SIGNALS]
        score = 100 * sum((x * p for x, p in zip(w, parts)), F.lit(0.0)) / sum(w)
        return out.withColumns({"score": score, "without_characters": 100 * (w[0] * parts[0] + w[1] * parts[1]) / (w[0] + w[1]), "spread": F.greatest(*parts) - F.least(*parts)})

    def best_documents(self, candidates: DataFrame) -> DataFrame:
        """(candidate_id, document_id, similarity): every document of the bank by its passages' similarity to each candidate's."""
        own = candidates.select(F.col("candidate_id").cast("string").alias("document_id"), "text")
        cp = materialize(embed(segments.passages(own), self.encoder, self.settings))
        marked = cp.withColumn("document_id", F.concat(F.lit("\x1f"), "document_id"))
        sim = S.maxsim(self._numbered(marked, "c", "i"), self._numbered(self.passages, "r", "j"))
        names = marked.select(F.substring("document_id", 2, 1 << 30).alias("candidate_id"), F.xxhash64("document_id").alias("c")).distinct()
        docs = self.passages.select("document_id", F.xxhash64("document_id").alias("r")).distinct()
        return sim.join(names, "c").join(docs, "r").select("candidate_id", "document_id", F.col("maxsim").alias("similarity"))

    def deviations(self, candidates: DataFrame, top: int = 5) -> DataFrame:
        """(candidate_id, feature, robust_z, position, rank): the measures in which each candidate is furthest from the bank."""
        own = candidates.select(F.col("candidate_id").cast("string").alias("document_id"), "text")
        dev = D.deviations(M.long_form(M.measured(own, keep=("document_id",)), ("document_id",)), self.distribution)
        ranked = dev.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy(F.desc(F.abs("robust_z")), "feature"))).where(F.col("rank") <= top)
        return ranked.select(F.col("document_id").alias("candidate_id"), "feature", F.col("value"), "robust_z", "position", "rank")

    def features(self, candidates: DataFrame, top: int = 5) -> DataFrame:
        """(candidate_id, side, rank, feature, label, value, median, robust_z, percentile, text): the measures in which each candidate is closest to the bank and furthest from it. Measures that are 0 in the candidate and always 0
        in the bank are left out if ten others remain."""
        own = candidates.select(F.col("candidate_id").cast("string").alias("document_id"), "text")
        long = materialize(M.long_form(M.measured(own, keep=("document_id",)), ("document_id",)))
        history = M.long_form(self.measures, ())
        dev = D.described(long, history, self.distribution).withColumn("told", F.col("varies") | (F.col("value") != 0) | (F.col("median") != 0))
        dev = dev.withColumn("n", F.count_if("told").over(W.partitionBy("document_id"))).where((F.col("n") < 10) | F.col("told"))
        size = F.abs("robust_z")
        near = dev.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy(size, "feature"))).withColumn("side", F.lit("match"))
        far = dev.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy(F.desc(size), "feature"))).withColumn("side", F.lit("mismatch"))
        out = near.unionByName(far).where(F.col("rank") <= top).withColumn("text", D.sentence_of(F.col("label"), F.col("value"), F.col("median"), F.col("position")))
        return out.select(F.col("document_id").alias("candidate_id"), "side", "rank", "feature", "label", "value", "median", "robust_z", "percentile", "text")

    def analogues(self, candidates: DataFrame, top: int = 3) -> DataFrame:
        """(candidate_id, document_id, passage_id, similarity, excerpt, rank): the bank's passages closest to any passage of each candidate."""
        own = candidates.select(F.col("candidate_id").cast("string").alias("document_id"), "text")
        cp = embed(segments.passages(own), self.encoder, self.settings)
        q = cp.select(F.xxhash64("document_id", "passage_id", F.lit("c")).alias("q"), F.col("document_id").alias("candidate_id"), F.col("embedding").cast("array<double>").alias("v"))
        r = self.passages.select(F.xxhash64("document_id", "passage_id").alias("r"), "document_id", "passage_id", "text", F.col("embedding").cast("array<double>").alias("v"))
        near = S.cosines(q.select("q", "v"), r.select("r", "v"), top).join(q.select("q", "candidate_id"), "q").groupBy("candidate_id", "r").agg(F.max("cosine").alias("similarity"))
        ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc(F.round("similarity", 9)), "r"))).where(F.col("rank") <= top)
        return ranked.join(r.select("r", "document_id", "passage_id", F.substring("text", 1, 500).alias("excerpt")), "r").select("candidate_id", "document_id", "passage_id", "similarity", "excerpt", "rank")

    def weakest_passages(self, candidates: DataFrame, top: int = 3) -> DataFrame:
        """The passages of each candidate that score lowest, as candidates of their own."""
        own = candidates.select(F.col("candidate_id").cast("string").alias("document_id"), "text")
        ps = segments.passages(own).select("document_id", F.concat_ws("#", "document_id", "passage_id").alias("candidate_id"), "passage_id", "start_char", "end_char", "text")
        s = self.score(ps.select("candidate_id", "text")).select("candidate_id", "score")
        ranked = ps.join(s, "candidate_id", "left").withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy(F.coalesce("score", F.lit(-1.0)), "passage_id"))).where(F.col("rank") <= top)
        return ranked.select(F.col("document_id").alias("candidate_id"), "passage_id", "start_char", "end_char", "score", "rank")

    def sentence_deletions(self, candidates: DataFrame, most: int = 20) -> DataFrame:
        """(candidate_id, index, delta): how much the score rises without a sentence, for up to `most` sentences of the weakest passages of texts of at least 150 words; gains only."""
        long = candidates.where(T.word_count(F.col("text")) >= 150).select(F.col("candidate_id").cast("string").alias("candidate_id"), "text")
        weak = self.weakest_passages(long).select("candidate_id", F.col("start_char").alias("lo"), F.col("end_char").alias("hi"), "rank")
        s = long.select("candidate_id", "text", F.explode(T.sentence_spans(F.col("text"))).alias("s")).join(weak, "candidate_id").where("s.start_char >= lo and s.start_char < hi")
        s = s.withColumn("k", F.row_number().over(W.partitionBy("candidate_id").orderBy("rank", "s.index"))).where(F.col("k") <= most)
        cut = F.expr("concat(substring(text, 1, s.start_char), substring(text, s.end_char + 1))")
        variants = s.select(F.concat_ws("#", "candidate_id", F.col("s.index").cast("string")).alias("id"), "candidate_id", F.col("s.index").alias("index"), cut.alias("text"))
        after = self.score(variants.select(F.col("id").alias("candidate_id"), "text")).select(F.col("candidate_id").alias("id"), F.col("score").alias("after"))
        before = self.score(long).select("candidate_id", "score")
        return variants.join(after, "id").join(before, "candidate_id").select("candidate_id", "index", (F.col("after") - F.col("score")).alias("delta")).where("delta > 0")


    def highlights(self, candidates: DataFrame, mode: str = "deep") -> DataFrame:
        """(candidate_id, start_char, end_char, effect, severity): sentences that speak against the bank. In `deep` mode by how much the score rises without them, else, and where that wasn't tried, by how far their passage is
        below the text."""
        if mode not in ("fast", "deep"):
            raise ValueError("mode must be fast or deep")
        own = candidates.select(F.col("candidate_id").cast("string").alias("candidate_id"), "text")
        weak = materialize(self.weakest_passages(own)).select("candidate_id", F.col("start_char").alias("lo"), F.col("end_char").alias("hi"), F.col("score").alias("of_passage"), "rank")
        whole = self.score(own).select("candidate_id", "score")
        s = own.select("candidate_id", F.explode(T.sentence_spans(F.col("text"))).alias("s")).select("candidate_id", "s.start_char", "s.end_char", F.col("s.index").alias("index"))
        first = s.join(weak, "candidate_id").where("start_char >= lo and start_char < hi").groupBy("candidate_id", "index").agg(F.min_by("of_passage", "rank").alias("of_passage"))
        s = s.join(first, ["candidate_id", "index"], "left").join(whole, "candidate_id")
        gap = F.when(F.col("of_passage") < F.col("score"), F.col("score") - F.col("of_passage"))
        if mode == "deep":
            s = s.join(self.sentence_deletions(own), ["candidate_id", "index"], "left")
            gap = F.coalesce("delta", gap)
        return highlight_ranges(s.withColumn("effect", gap).where("effect is not null").select("candidate_id", "start_char", "end_char", "effect"))

    def warnings(self, candidates: DataFrame) -> DataFrame:
        """(candidate_id, warning): what limits the evidence of a candidate."""
        s = self.score(candidates)
        parts = [F.col(f"{x}_component") for x in SIGNALS]
        short = F.when(F.col("words") < 150, F.lit("fewer than 150 words give little evidence"))
        apart = F.when(F.greatest(*parts) - F.least(*parts) >= 0.65, F.lit("the components disagree strongly; subject or genre may be the reason"))
        small = F.lit("the bank has fewer than ten documents") if self.measures.count() < 10 else F.lit(None).cast("string")
        return s.select("candidate_id", F.explode(F.array_compact(F.array(short, apart, small))).alias("warning"))


def _digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order; vectors and numbers count by their text."""
    text = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    return fingerprint(text, "h").first().digest


def highlight_ranges(sentences: DataFrame, most: int = 10) -> DataFrame:
    """`sentences(candidate_id, start_char, end_char, effect)`: the strongest effects that don't overlap one already taken, at most `most`, with their severity. Ties go by place. Each candidate's rows go to one task: they are
    the sentences of one text."""
    schema = pa.schema([("candidate_id", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("effect", pa.float64())])

    def pick(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["effect"], r["start_char"]))
        taken: list[dict] = []
        for r in rows:
            if len(taken) == most:
                break
            if r["end_char"] > r["start_char"] and not any(r["start_char"] < x["end_char"] and x["start_char"] < r["end_char"] for x in taken):
                taken.append(r)
        return pa.Table.from_pylist(taken, schema)

    own = sentences.where("start_char is not null and end_char is not null and effect is not null").select(F.col("candidate_id").cast("string").alias("candidate_id"), F.col("start_char").cast("bigint").alias("start_char"), F.col("end_char").cast("bigint").alias("end_char"), F.col("effect").cast("double").alias("effect"))
    best = own.groupBy("candidate_id").applyInArrow(pick, "candidate_id string, start_char bigint, end_char bigint, effect double")
    return best.withColumn("severity", F.when(F.col("effect") >= 5, "high").when(F.col("effect") >= 2, "medium").otherwise("low"))


def write_report(metrics: DataFrame, path: str, title: str = "Style compatibility", most: int = 10_000) -> None:
    """A small HTML page of an already aggregated table; values are escaped. A table of more than `most` rows is an error: nothing is cut off."""
    rows = metrics.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most; aggregate first")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in metrics.columns)
    lines = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    Path(path).write_text(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>A measure of style, not proof of authorship.</p><table><tr>{head}</tr>{lines}</table>", encoding="utf-8")
