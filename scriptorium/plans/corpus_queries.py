"""Queries on the corpus, its passages, vectors and samples, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import groups as G
from scriptorium.operators import segments
from scriptorium.operators import similarity as S
from scriptorium.plans.measure_queries import _MARK, W, _sents
from scriptorium.session import materialize, spread, table


def _is_mail() -> Column:
    return F.coalesce(F.lower(F.trim("source_type")) == "email", F.lit(False)) | F.coalesce(F.endswith("genre", F.lit("_email")), F.lit(False))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: the one loaded last."""
    return G.last_of_each(table(spark, d, "corpus_docs").where("document_id is not null"), "document_id", "loaded_at", "file_hash")


def _prose(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).where(~_is_mail() & F.col("clean_text").isNotNull())


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "manifest_rows").where("sample_id is not null and excerpt is not null").select("sample_id", F.col("excerpt").alias("text")).distinct())


def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Prose cleaned anew from its Markdown."""
    return _latest(spark, d).where(~_is_mail()).select("document_id", T.clean_markdown(F.col("raw_markdown")).alias("text"))


def clean_email(spark: SparkSession, d: str) -> DataFrame:
    """E-mails by the plain cleaner."""
    return _latest(spark, d).where(_is_mail()).select("document_id", T.clean_email(F.col("raw_markdown"), F.col("author")).alias("text"), T.clean_foreign_email(F.col("raw_markdown"), F.col("author")).alias("foreign_text"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the front matter of every document that has one; what is no YAML is read line by line."""
    from scriptorium.sources.markdown import front_matter as parse

    return _latest(spark, d).select("document_id", F.explode(parse(F.col("raw_markdown"), strict=False)).alias("field", "value"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    """Prose cut into passages of about 300 words."""
    return segments.passages(_prose(spark, d).select("document_id", F.col("clean_text").alias("text"))).select("document_id", "passage_id", "start_char", "end_char", "word_count")


def training_views(spark: SparkSession, d: str) -> DataFrame:
    """Views of every prose document."""
    return segments.views(_prose(spark, d).select("document_id", F.col("clean_text").alias("text"))).select("document_id", "view_index", "start_char", "end_char", "word_count")


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The first run of sentences of 150 to 190 words of every prose document that has one."""
    return segments.excerpts(_prose(spark, d).select("document_id", F.col("clean_text").alias("text")))


def generation_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The excerpt of 450 to 600 words that stands for each prose document when new texts are written after it."""
    return segments.generation_excerpts(_prose(spark, d).select("document_id", F.col("clean_text").alias("text")))


def documents_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Documents, e-mails and characters per split and label."""
    r = _latest(spark, d)
    return r.groupBy("split", G.genre_label(F.col("genre")).alias("derived_label")).agg(F.count(F.lit(1)).alias("documents"), F.sum(_is_mail().cast("bigint")).alias("mails"), F.sum(F.length("clean_text")).alias("chars"))


def distinct_last_prose(spark: SparkSession, d: str) -> DataFrame:
    """Of documents of equal prose the one loaded last."""
    p = _prose(spark, d).withColumn("digest", F.md5("clean_text"))
    return G.last_of_each(p, "digest", "loaded_at", "document_id").select("digest", "document_id")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """All documents, e-mails too, with root, author, label, stratum and the text that tells copies apart: clean_text, or of a mail without it the message."""
    r = _latest(spark, d)
    author = F.lower(F.trim("author_id"))
    return r.select(
        "document_id", F.coalesce("root_document_id", "document_id").alias("root"), F.when(~author.isin("", "unknown", "n/a", "-"), author).alias("author"), G.genre_label(F.col("genre")).alias("label"),
        G.stratum(F.col("genre")).alias("stratum"), F.coalesce("clean_text", F.when(_is_mail(), F.col("raw_markdown"))).alias("text"),
    )


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, group_id, label, stratum) of every document."""
    docs = materialize(_labelled(spark, d))
    return G.smallest_connected(G.tie_keys(docs)).join(docs.select("document_id", "label", "stratum"), "document_id")


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a root, a body, a long paragraph or a negative author."""
    return _groups(spark, d).select("document_id", "group_id")


def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Groups that hold documents of both labels: what `require_one_label` raises for."""
    return G.label_conflicts(_groups(spark, d))


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups held out of each stratum."""
    return G.holdout(_groups(spark, d)).select("document_id", "group_id", "stratum", "held")


def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Stratified folds that no group straddles."""
    return G.folds(materialize(_groups(spark, d))).select("document_id", "group_id", "fold")


def passage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose text isn't what their offsets hold, or whose word count is wrong."""
    p = table(spark, d, "passages").where("text is not null").select("document_id", "passage_id", "text", "start_char", "end_char", "word_count").distinct()
    t = _latest(spark, d).where("clean_text is not null").select("document_id", "clean_text")
    there = F.expr("substring(clean_text, int(start_char) + 1, int(end_char - start_char))")
    out = p.join(t, "document_id").select("document_id", "passage_id", (there == F.col("text")).alias("in_place"), (F.coalesce(F.col("word_count"), F.lit(-1)) == T.word_count(F.col("text"))).alias("counted"))
    return out.where("not in_place or not counted").distinct()


def sentence_in_passage(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of prose per passage that their starts lie in: a range join within the document."""
    s = _prose(spark, d).select("document_id", F.explode(T.sentence_spans(F.col("clean_text"))).alias("s")).select("document_id", F.col("s.start_char").alias("at"))
    p = table(spark, d, "passages").where("start_char is not null and end_char is not null").select("document_id", "passage_id", "start_char", "end_char").distinct()
    return p.join(s, "document_id").where("at >= start_char and at < end_char").groupBy("document_id", "passage_id", "start_char").agg(F.count(F.lit(1)).alias("sentences"))


def unseen_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embedding keys of passages that no usable vector has."""
    have = S.vectors_of(table(spark, d, "passage_vectors"), ["embedding_key"]).select("embedding_key")
    return table(spark, d, "passages").where("embedding_key is not null").select("embedding_key").distinct().join(have, "embedding_key", "left_anti")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.vectors_of(table(spark, d, "embeddings").select("vec_id", "label", "embedding").distinct(), ["vec_id", "label"])


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of every fiftieth vector with all others."""
    v = _vectors(spark, d)
    out = S.cosines(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "v"), v.select(F.col("vec_id").alias("r"), "v"))
    return out.select("q", "r", F.round("cosine", 5).alias("cosine"))


def nearest_analogues(spark: SparkSession, d: str) -> DataFrame:
    """The three closest vectors of every fiftieth."""
    v = _vectors(spark, d)
    out = S.cosines(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "v"), v.select(F.col("vec_id").alias("r"), "v"), 3)
    return out.select("q", "r", "rank", F.round("cosine", 5).alias("cosine"))


def _maxsim(spark: SparkSession, d: str) -> DataFrame:
    """Documents (labels) of every fiftieth vector, with all their vectors, against all documents with all of theirs; a vector is not compared with itself."""
    v = materialize(_vectors(spark, d).select(F.col("label").cast("bigint").alias("label"), "vec_id", "v"))
    asked = v.where("vec_id % 50 = 0").select("label").distinct()
    return S.maxsim(v.join(asked, "label", "left_semi").select(F.col("label").alias("c"), F.col("vec_id").alias("i"), "v"), v.select(F.col("label").alias("r"), F.col("vec_id").alias("j"), "v"))


def symmetric_maxsim(spark: SparkSession, d: str) -> DataFrame:
    """Multi-vector similarity of the documents of every fiftieth vector with all documents."""
    return _maxsim(spark, d).select("c", "r", F.round("maxsim", 6).alias("maxsim"))


def maxsim_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments and percentiles of each candidate's similarities, and its own document against the best and the median other."""
    m = _maxsim(spark, d)
    other = F.when(F.col("c") != F.col("r"), F.col("maxsim"))
    q = F.percentile("maxsim", F.array(*(F.lit(x) for x in (0.1, 0.25, 0.75, 0.9))))
    out = m.groupBy("c").agg(F.avg("maxsim").alias("mean"), F.stddev_pop("maxsim").alias("std"), F.min("maxsim").alias("least"), F.max("maxsim").alias("most"), q.alias("q"), F.max(F.when(F.col("c") == F.col("r"), F.col("maxsim"))).alias("own"), F.max(other).alias("best"), F.median(other).alias("mid"))
    cols = {"mean": F.col("mean"), "std": F.col("std"), "least": F.col("least"), "most": F.col("most"), "p10": F.col("q")[0], "p25": F.col("q")[1], "p75": F.col("q")[2], "p90": F.col("q")[3], "own_minus_best": F.col("own") - F.col("best"), "own_minus_median": F.col("own") - F.col("mid")}
    return out.select("c", *(F.round(v, 6).alias(k) for k, v in cols.items()))


def char_ngram_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The 50,000 most frequent character 3- to 5-grams of the samples with their weights."""
    v = S.vocabulary(S.gram_counts(_samples(spark, d), "sample_id"), "sample_id")
    return v.select("gram", "df", "total", F.round("idf", 8).alias("idf"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(S.gram_counts(_samples(spark, d), "sample_id"))
    return S.tfidf(counts, materialize(S.vocabulary(counts, "sample_id")), "sample_id")


def char_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Character tf-idf cosines of every fiftieth sample with all others."""
    w = materialize(_weights(spark, d))
    asked = w.where(F.regexp_extract("sample_id", r"(\d+)$", 1).cast("bigint") % 50 == 0)
    return S.sparse_cosines(asked, w, "sample_id").select("q", "r", F.round("cosine", 6).alias("cosine"))


def ngram12_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Runs of twelve words that more than one sample has, and in how many."""
    s = S.run_digests(_samples(spark, d), "sample_id")
    return s.groupBy("digest").agg(F.countDistinct("sample_id").alias("samples")).where("samples > 1")


def copied_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of at least eight words that more than one sample has."""
    s = _samples(spark, d).select("sample_id", F.explode(T.sentences(F.col("text"))).alias("s")).where(T.word_count(F.col("s")) >= 8)
    return s.groupBy(F.md5("s").alias("digest")).agg(F.countDistinct("sample_id").alias("samples")).where("samples > 1")


def sample_audit(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose recorded word count or digest isn't the excerpt's."""
    r = table(spark, d, "manifest_rows").where("excerpt is not null").select("sample_id", "excerpt", "excerpt_words", "sample_sha256").distinct()
    return r.select("sample_id", (F.coalesce("excerpt_words", F.lit(-1)) == T.word_count(F.col("excerpt"))).alias("counted"), (F.sha2("excerpt", 256) == F.col("sample_sha256")).alias("hashed")).where("not counted or not hashed").distinct()


def stale_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Recorded nearest passages whose similarity isn't the vectors' cosine any more."""
    v = S.vectors_of(table(spark, d, "passage_vectors").select("vec_id", "embedding").distinct(), ["vec_id"])
    v = v.where(F.size("v") == 64)
    s = table(spark, d, "style_scores").where("vec_id is not null").select("candidate_id", "vec_id", F.explode("nearest_reference_passages").alias("n")).select("candidate_id", "vec_id", F.col("n.vec_id").alias("near"), F.col("n.similarity").alias("was")).distinct()
    both = s.join(v, "vec_id").join(v.select(F.col("vec_id").alias("near"), F.col("v").alias("u")), "near")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    cos = dot("v", "u") / F.sqrt(dot("v", "v") * dot("u", "u"))
    return both.select("candidate_id", "near", F.round("was", 4).alias("was"), F.round(cos, 4).alias("now")).where("abs(was - now) > 0.005")


_MAIL = "(coalesce(lower(trim(source_type)) = 'email', false) OR coalesce(ends_with(genre, '_email'), false))"
_LATEST = "latest AS (SELECT * FROM corpus_docs WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC NULLS LAST, file_hash DESC) = 1)"
_PROSE = f"{_LATEST}, prose AS (SELECT * FROM latest WHERE NOT {_MAIL} AND clean_text IS NOT NULL)"
_LABEL = "(coalesce(lower(trim(genre)), 'blog') IN ('blog', 'work_email', 'gmail_email'))::INT"
_SQUEEZE = r"trim(regexp_replace({t}, '[\pZ\s]+', ' ', 'g'))".replace("\\p", "\\p")
_TEXT = f"coalesce(clean_text, CASE WHEN {_MAIL} THEN raw_markdown END)"
_STRATUM = "CASE coalesce(lower(trim(genre)), 'blog') WHEN 'work_email' THEN 'work' WHEN 'gmail_email' THEN 'gmail' WHEN 'blog' THEN 'blog' ELSE 'negative' END"
_GROUPS = rf"""WITH RECURSIVE {_LATEST},
base AS MATERIALIZED (SELECT document_id, coalesce(root_document_id, document_id) AS root, lower(trim(author_id)) AS author, {_LABEL} AS label, {_STRATUM} AS stratum, {_TEXT} AS t FROM latest),
keys AS MATERIALIZED (SELECT document_id, 'r:' || root AS k FROM base UNION SELECT document_id, 'b:' || md5({_SQUEEZE.format(t="t")}) FROM base WHERE length({_SQUEEZE.format(t="t")}) > 0
UNION SELECT document_id, 'a:' || author FROM base WHERE label = 0 AND author NOT IN ('', 'unknown', 'n/a', '-')
UNION SELECT document_id, 'p:' || md5({_SQUEEZE.format(t="p")}) FROM (SELECT document_id, unnest(string_split_regex(t, '\n\s*\n')) AS p FROM base) WHERE len(regexp_extract_all(p, '{W}')) >= 20),
hub AS (SELECT k, min(document_id) AS h FROM keys GROUP BY 1), ties AS MATERIALIZED (SELECT DISTINCT document_id AS u, h AS v FROM keys JOIN hub USING (k) UNION SELECT DISTINCT h, document_id FROM keys JOIN hub USING (k)),
reach(u, v) AS (SELECT u, v FROM ties UNION SELECT reach.u, ties.v FROM reach JOIN ties ON reach.v = ties.u),
grp AS MATERIALIZED (SELECT document_id, coalesce(group_id, document_id) AS group_id, label, stratum FROM base LEFT JOIN (SELECT u AS document_id, min(v) AS group_id FROM reach GROUP BY 1) USING (document_id))"""


def _held_sql() -> str:
    """The strata in turn, each with what the ones ahead have taken."""
    parts, taken = [], "SELECT NULL AS group_id WHERE false"
    for name in G.STRATA:
        want = "least(count(*), greatest(3, ceil(count(*)*0.5)))" if name == "blog" else "ceil(count(*)*0.2)"
        parts.append(
            f"w_{name} AS (SELECT {want} AS target, count(*) FILTER (WHERE group_id IN (SELECT group_id FROM ({taken}))) AS done FROM grp WHERE stratum = '{name}'), "
            f"g_{name} AS (SELECT group_id, count(*) AS n FROM grp WHERE stratum = '{name}' AND group_id NOT IN (SELECT group_id FROM ({taken}) WHERE group_id IS NOT NULL) GROUP BY 1), "
            f"t_{name} AS (SELECT group_id FROM (SELECT group_id, sum(n) OVER (ORDER BY md5(concat_ws('|', '42', '{name}', group_id))) - n AS ahead FROM g_{name}), w_{name} WHERE ahead + done < target)"
        )
        taken += f" UNION ALL SELECT group_id FROM t_{name}"
    return f"{_GROUPS}, {', '.join(parts)} SELECT document_id, group_id, stratum, group_id IN (SELECT group_id FROM ({taken}) WHERE group_id IS NOT NULL) AS held FROM grp"


_EMB = "e AS (SELECT DISTINCT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)"
_MAX = f"""WITH {_EMB}, s AS (SELECT a.label AS c, b.label AS r, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id AND a.label IN (SELECT label FROM e WHERE vec_id % 50 = 0)),
m AS (SELECT c, r, (x + y)/2 AS maxsim FROM (SELECT c, r, avg(m) AS x FROM (SELECT c, r, i, max(s) AS m FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT c, r, avg(m) AS y FROM (SELECT c, r, j, max(s) AS m FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (c, r))"""
_SAMP = "samp AS (SELECT DISTINCT sample_id, excerpt AS text FROM manifest_rows WHERE sample_id IS NOT NULL AND excerpt IS NOT NULL)"
_GRAMS = rf"""{_SAMP}, ch AS (SELECT sample_id, regexp_replace(lower(text), '[\pZ\s][\pZ\s]+', ' ', 'g') AS t FROM samp),
g AS (SELECT sample_id, substring(t, i::BIGINT, n::BIGINT) AS gram FROM ch, (VALUES (3), (4), (5)) l(n), unnest(range(1, length(t) - n + 2)) u(i)),
tf AS (SELECT sample_id, gram, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT gram, count(*) AS df, sum(tf) AS total, ln((1 + (SELECT count(DISTINCT sample_id) FROM tf))/(1 + count(*))) + 1 AS idf FROM tf GROUP BY 1 ORDER BY total DESC, gram LIMIT 50000)"""
_WIDE_MARK = _MARK.replace(r"(\s|\z)", r"([\pZ\s]|\z)")  # white space as Python sees it
SQL = {
    "documents_by_kind": f"WITH {_LATEST} SELECT split, {_LABEL} AS derived_label, count(*) AS documents, sum({_MAIL}::INT) AS mails, sum(length(clean_text)) AS chars FROM latest GROUP BY 1, 2",
    "distinct_last_prose": f"WITH {_PROSE} SELECT md5(clean_text) AS digest, document_id FROM prose QUALIFY row_number() OVER (PARTITION BY md5(clean_text) ORDER BY loaded_at DESC NULLS LAST, document_id DESC) = 1",
    "duplicate_groups": f"{_GROUPS} SELECT document_id, group_id FROM grp",
    "label_conflicts": f"{_GROUPS} SELECT group_id, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives FROM grp GROUP BY 1 HAVING positives > 0 AND negatives > 0",
    "holdout_split": _held_sql(),
    "group_folds": f"""{_GROUPS}, z AS (SELECT group_id, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM grp GROUP BY 1),
o AS (SELECT group_id, ((row_number() OVER (PARTITION BY p, q ORDER BY md5(concat_ws('|', '42', group_id))) - 1) % 3)::INT AS fold FROM z) SELECT document_id, group_id, fold FROM grp JOIN o USING (group_id)""",
    "passage_audit": f"""WITH {_LATEST}, p AS (SELECT DISTINCT document_id, passage_id, text, start_char, end_char, word_count FROM passages WHERE text IS NOT NULL)
SELECT DISTINCT * FROM (SELECT document_id, passage_id, substring(clean_text, start_char + 1, end_char - start_char) = text AS in_place, coalesce(word_count, -1) = len(regexp_extract_all(text, '{W}')) AS counted FROM p JOIN latest USING (document_id) WHERE clean_text IS NOT NULL) WHERE NOT in_place OR NOT counted""",
    "sentence_in_passage": rf"""WITH {_PROSE}, q0 AS (SELECT document_id, string_split(replace({_MARK.replace("{t}", "clean_text")}, chr(2), '.'), chr(1)) AS parts FROM prose), q1 AS (SELECT document_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM q0),
o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM q1), st AS (SELECT document_id, off + length(part) - length(regexp_replace(part, '^\s+', '')) AS pos FROM o WHERE regexp_matches(part, '[\p{{L}}\p{{N}}_]')),
ps AS (SELECT DISTINCT document_id, passage_id, start_char, end_char FROM passages WHERE start_char IS NOT NULL AND end_char IS NOT NULL) SELECT document_id, passage_id, start_char, count(*) AS sentences FROM ps JOIN st USING (document_id) WHERE pos >= start_char AND pos < end_char GROUP BY document_id, passage_id, start_char, end_char""",
    "excerpts": rf"""WITH {_PROSE}, q0 AS (SELECT document_id, string_split(replace({_WIDE_MARK.replace("{t}", "clean_text")}, chr(2), '.'), chr(1)) AS parts FROM prose), q1 AS (SELECT document_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM q0),
o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, regexp_replace(part, '^[\pZ\s]+|[\pZ\s]+\z', '', 'g') AS body FROM q1),
st AS (SELECT document_id, i, off + length(part) - length(regexp_replace(part, '^[\pZ\s]+', '')) AS pos, body, len(regexp_extract_all(body, '[^\pZ\s]+')) AS n FROM o WHERE regexp_matches(part, '[\p{{L}}\p{{N}}_]')),
k AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS c FROM st WINDOW w AS (PARTITION BY document_id ORDER BY i))
SELECT a.document_id, a.pos::INT AS start_char, (b.pos + length(b.body))::INT AS end_char, (b.c - a.c + a.n)::INT AS word_count FROM k a JOIN k b ON a.document_id = b.document_id AND b.k >= a.k AND b.c - a.c + a.n BETWEEN 150 AND 190 QUALIFY row_number() OVER (PARTITION BY a.document_id ORDER BY a.k, b.k) = 1""",
    "stale_neighbours": """WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM passage_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT DISTINCT candidate_id, vec_id, n.vec_id AS near, n.similarity AS was FROM (SELECT candidate_id, vec_id, unnest(nearest_reference_passages) AS n FROM style_scores WHERE vec_id IS NOT NULL)),
c AS (SELECT candidate_id, near, round(was, 4) AS was, round(list_cosine_similarity(a.e, b.e), 4) AS now FROM s JOIN v a ON a.vec_id = s.vec_id JOIN v b ON b.vec_id = s.near) SELECT * FROM c WHERE abs(was - now) > 0.005""",
    "unseen_embeddings": "SELECT DISTINCT embedding_key FROM passages WHERE embedding_key IS NOT NULL AND embedding_key NOT IN (SELECT embedding_key FROM passage_vectors WHERE embedding_key IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)",
    "cosine_pairs": f"WITH {_EMB} SELECT a.vec_id AS q, b.vec_id AS r, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id",
    "nearest_analogues": f"WITH {_EMB}, s AS (SELECT a.vec_id AS q, b.vec_id AS r, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), t AS (SELECT q, r, c, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, r) AS rank FROM s) SELECT q, r, rank, round(c, 5) AS cosine FROM t WHERE rank <= 3",
    "symmetric_maxsim": f"{_MAX} SELECT c, r, round(maxsim, 6) AS maxsim FROM m",
    "maxsim_moments": f"{_MAX} SELECT c, round(avg(maxsim), 6) AS mean, round(stddev_pop(maxsim), 6) AS std, round(min(maxsim), 6) AS least, round(max(maxsim), 6) AS most, " + ", ".join(f"round(quantile_cont(maxsim, 0.{p}), 6) AS p{p}" for p in (10, 25, 75, 90)) + ", round(max(maxsim) FILTER (WHERE c = r) - max(maxsim) FILTER (WHERE c <> r), 6) AS own_minus_best, round(max(maxsim) FILTER (WHERE c = r) - median(maxsim) FILTER (WHERE c <> r), 6) AS own_minus_median FROM m GROUP BY 1",
    "char_ngram_vocabulary": f"WITH {_GRAMS} SELECT gram, df, total, round(idf, 8) AS idf FROM v",
    "char_similarity": rf"""WITH {_GRAMS}, w AS (SELECT sample_id, gram, (1 + ln(tf))*idf AS w FROM tf JOIN v USING (gram)), n AS (SELECT sample_id, sqrt(sum(w*w)) AS norm FROM w GROUP BY 1), x AS (SELECT sample_id, gram, w/norm AS w FROM w JOIN n USING (sample_id))
SELECT a.sample_id AS q, b.sample_id AS r, round(sum(a.w*b.w), 6) AS cosine FROM x a JOIN x b USING (gram) WHERE regexp_extract(a.sample_id, '(\d+)$', 1)::BIGINT % 50 = 0 AND a.sample_id <> b.sample_id GROUP BY 1, 2""",
    "ngram12_overlap": f"WITH {_SAMP}, w AS (SELECT sample_id, regexp_extract_all(lower(text), '{W}') AS w FROM samp), s AS (SELECT sample_id, array_to_string(w[i:i + 11], ' ') AS run FROM w, unnest(range(1, len(w) - 10)) u(i)) SELECT md5(run) AS digest, count(DISTINCT sample_id) AS samples FROM s GROUP BY run HAVING samples > 1",
    "copied_sentences": f"WITH {_SAMP}, s AS (SELECT sample_id, unnest({_sents('text')}) AS s FROM samp) SELECT md5(s) AS digest, count(DISTINCT sample_id) AS samples FROM s WHERE len(regexp_extract_all(s, '{W}')) >= 8 GROUP BY s HAVING samples > 1",
    "sample_audit": f"SELECT DISTINCT * FROM (SELECT sample_id, coalesce(excerpt_words, -1) = len(regexp_extract_all(excerpt, '{W}')) AS counted, sha256(excerpt) = sample_sha256 AS hashed FROM manifest_rows WHERE excerpt IS NOT NULL) WHERE NOT counted OR NOT hashed",
}
QUERIES = {f.__name__: f for f in (clean_markdown, clean_email, front_matter, passages, training_views, excerpts, generation_excerpts, documents_by_kind, distinct_last_prose, duplicate_groups, label_conflicts, holdout_split, group_folds, passage_audit, sentence_in_passage, unseen_embeddings, cosine_pairs, nearest_analogues, symmetric_maxsim, maxsim_moments, char_ngram_vocabulary, char_similarity, ngram12_overlap, copied_sentences, sample_audit, stale_neighbours)}
