"""Queries on copies, lineage, contrast and supply, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import measures as M
from scriptorium.functions import text as T
from scriptorium.operators import distributions as D
from scriptorium.operators import groups as G
from scriptorium.operators import lineage, segments
from scriptorium.operators import metrics as X
from scriptorium.operators import similarity as S
from scriptorium.plans import corpus_queries as C
from scriptorium.plans import measure_queries as Q
from scriptorium.plans.score_queries import SQL as SCORE_SQL
from scriptorium.plans.score_queries import _rounded, _rows
from scriptorium.session import materialize, skew_join, table

MATCH, MISMATCH = 70.0, 40.0


def deviation_details(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of every fiftieth document against the reference source: label, centre, spread, percentile, and whether the measure varies there at all."""
    wide = Q._wide(spark, d)
    history = M.long_form(wide.where(F.col("source") == Q.REFERENCE), ())
    own = M.long_form(wide.where("doc_id % 50 = 0"), ("doc_id",))
    out = D.described(own, history, D.distribution(history))
    return out.select("doc_id", "feature", "label", *(F.round(c, 5).alias(c) for c in ("value", "median", "mean", "std", "percentile")), "varies")


def structure_measures(spark: SparkSession, d: str) -> DataFrame:
    """Headings, lists and quotes of prose, counted in its marked-up source against the words of its clean text."""
    p = C._prose(spark, d).select("document_id", "clean_text", T.structure(F.col("raw_markdown"), F.col("clean_text"), F.lit(False)).alias("source"))
    m = M.measured(p.where("source is not null"), "clean_text", "source", keep=("document_id",))
    return m.select("document_id", *(F.round(c, 5).alias(c) for c in M.FAMILIES["markup"]))


def _passage_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, vec_id, v) of usable vectors, one row per vec_id."""
    v = S.vectors_of(table(spark, d, "passage_vectors").where("vec_id is not null and document_id is not null"), ["document_id", "vec_id"]).where(F.size("v") == 64)
    return v.groupBy("vec_id").agg(F.max(F.struct("document_id", "v")).alias("x")).select("vec_id", "x.document_id", "x.v")


def _contrast(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (every fiftieth vector's documents), all vectors, and the documents with root, author and label; numbered by hash."""
    docs = C._labelled(spark, d).select("document_id", "root", "author", "label")
    v = materialize(_passage_vectors(spark, d).join(docs, "document_id"))
    asked = v.where("vec_id % 50 = 0").select("document_id").distinct()
    return v.join(asked, "document_id", "left_semi"), v, docs


def negative_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate document against the passages of every negative author but its own: the best and the median similarity, and the gaps to its similarity to the positive documents."""
    asked, every, docs = _contrast(spark, d)
    asked = materialize(asked)
    number = lambda c: F.xxhash64(c)
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    authors = every.where("label = 0 and author is not null").select(number("author").alias("r"), number("author").alias("own"), "v")
    sims = S.against_rest(asked.select(number("document_id").alias("c"), hashed("author").alias("own"), "v"), authors).select("c", "best", "mid")
    bank = every.where("label = 1").select(number("document_id").alias("r"), hashed("root").alias("own"), "v")
    user = S.against_rest(asked.select(number("document_id").alias("c"), hashed("root").alias("own"), "v"), bank).where("n > 0").select("c", F.col("mid").alias("user"))
    who = asked.select("document_id").distinct().withColumn("c", number("document_id"))
    out = who.select("document_id", "c").join(user, "c").join(sims, "c", "left")
    best, mid = F.coalesce("best", F.lit(0.0)), F.coalesce("mid", F.lit(0.0))
    cols = {"user_similarity": F.col("user"), "best_negative": best, "median_negative": mid, "user_minus_best": F.col("user") - best, "user_minus_median": F.col("user") - mid}
    return out.select("document_id", *(F.round(v, 5).alias(k) for k, v in cols.items()))


def best_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of each candidate document the ten positive documents of other roots that are most like it."""
    asked, every, _ = _contrast(spark, d)
    number = lambda c: F.xxhash64(c)
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    bank = every.where("label = 1").select(number("document_id").alias("r"), hashed("root").alias("own"), F.col("document_id").alias("name"), "v")
    sims = S.against_rest(asked.select(number("document_id").alias("c"), hashed("root").alias("own"), "v"), bank, top=10).withColumnRenamed("name", "like")
    ranked = sims.join(asked.select("document_id", number("document_id").alias("c")).distinct(), "c").withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy(F.desc(F.round("maxsim", 9)), "like")))
    return ranked.where("rank <= 10").select("document_id", "like", "rank", F.round("maxsim", 5).alias("maxsim"))


def char_symmetric_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth sample against all others by characters: of their paragraphs the mean best cosine both ways, and the median over all other samples; pairs that share nothing count 0."""
    s = C._samples(spark, d).select("sample_id", F.explode(T.paragraphs(F.col("text"))).alias("text"))
    p = materialize(s.select(F.col("sample_id").alias("document_id"), "text"))
    numbers, idf = S.numbered_grams(S.gram_vocabulary(p))
    w = materialize(S.gram_vectors(p, numbers))
    found = S.symmetric_sparse(w.where(F.regexp_extract("document_id", r"(\d+)$", 1).cast("bigint") % 50 == 0), w, idf)
    return found.select(F.col("document_id").alias("sample_id"), F.round("similarity", 6).alias("similarity"))


def reserved_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of primary test prose and train prose that are equal or where a paragraph of twenty words or more of one stands in the other."""
    p = C._prose(spark, d).select("document_id", "split", F.col("clean_text").alias("text"))
    return segments.overlapping(p.where("split = 'primary_test'").drop("split"), p.where("split = 'train'").drop("split")).distinct()


def sample_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's checks together: 150 to 700 words, no run of twelve words and no sentence of eight words or more from the corpus."""
    s = C._samples(spark, d)
    p = C._prose(spark, d).select("document_id", F.col("clean_text").alias("text"))
    sents = lambda df, *c: df.select(*c, F.explode(T.sentences(F.col("text"))).alias("x")).where(T.word_count(F.col("x")) >= 8).select(*c, F.md5("x").alias("x"))
    shared = S.run_digests(s, "sample_id").join(S.run_digests(p, "document_id").select("digest").distinct(), "digest", "left_semi").select("sample_id").distinct().withColumn("shares_run", F.lit(True))
    copied = sents(s, "sample_id").join(sents(p).distinct(), "x", "left_semi").select("sample_id").distinct().withColumn("copies_sentence", F.lit(True))
    out = s.select("sample_id", T.word_count(F.col("text")).alias("words")).join(shared, "sample_id", "left").join(copied, "sample_id", "left")
    out = out.withColumns({"fits": F.col("words").between(150, 700), "shares_run": F.coalesce("shares_run", F.lit(False)), "copies_sentence": F.coalesce("copies_sentence", F.lit(False))})
    return out.withColumn("passes", F.col("fits") & ~F.col("shares_run") & ~F.col("copies_sentence"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Every document's origin by its chain of roots, how far off it is, and whether all documents on the way have a source type; chains that end nowhere or run in a circle have no origin."""
    r = C._latest(spark, d).select("document_id", F.coalesce("root_document_id", "document_id").alias("parent"), F.col("source_type").isNotNull().alias("visible"))
    return lineage.origins(r)


def lineage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Roots with fewer than twenty documents, their numbers, and the order in which they would be drawn: least used first, then by hash."""
    r = C._latest(spark, d).groupBy(F.coalesce("root_document_id", "document_id").alias("root")).agg(F.count(F.lit(1)).alias("documents")).where("documents < 20")
    return r.select("root", "documents", F.md5(F.concat(F.lit("42|"), "root")).alias("draw"))


def curation_status(spark: SparkSession, d: str) -> DataFrame:
    """Samples by kind of source: samples, authors with twenty or more, the largest author's share, and the gates on these."""
    r = table(spark, d, "manifest_rows").where("sample_id is not null").select("sample_id", F.coalesce(F.lower(F.trim("source_type")), F.lit("none")).alias("kind"), F.lower(F.trim("author_id")).alias("author")).distinct()
    per = r.groupBy("kind", "author").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("kind").agg(F.sum("n").alias("samples"), F.count_if((F.col("n") >= 20) & F.col("author").isNotNull()).alias("big_authors"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))
    return out.withColumns({"enough": F.col("samples") >= 100, "varied": (F.col("big_authors") >= 3) & (F.col("largest_share") <= 0.5)})


def supervision_gate(spark: SparkSession, d: str) -> DataFrame:
    """Per population whether it can carry a verifier: ten negative roots, three known negative authors if any is known, six positive roots; and whether one author dominates."""
    from scriptorium.plans.score_queries import negative_supply

    s = negative_supply(spark, d)
    eligible = (F.col("negative_roots") >= 10) & ((F.col("negative_authors") == 0) | (F.col("negative_authors") >= 3))
    return s.select("split", eligible.alias("eligible"), (eligible & (F.col("positive_roots") >= 6)).alias("supervised"), F.coalesce(F.col("largest_share") > 0.5, F.lit(False)).alias("dominated"))


def root_margin_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row with the median margin of its root; rows of roots without a finite margin have none."""
    rows = _rows(spark, d).select("root_document_id", "split", "label")
    m = X.margins(_rows(spark, d), "root_document_id", "raw_margin").select("root_document_id", F.round("median", 9).alias("margin"))
    return skew_join(rows.distinct(), m, "root_document_id", "left")


def authors_on_both_sides(spark: SparkSession, d: str) -> DataFrame:
    """Author keys of positive and of negative documents alike."""
    r = C._labelled(spark, d).where("author is not null")
    return r.where("label = 1").select("author").intersect(r.where("label = 0").select("author"))


def authors_without_train(spark: SparkSession, d: str) -> DataFrame:
    """Author keys that have documents, but none in train."""
    r = C._latest(spark, d).select(F.lower(F.trim("author_id")).alias("author"), "split").where("author is not null and author not in ('', 'unknown', 'n/a', '-')")
    return r.select("author").distinct().exceptAll(r.where("split = 'train'").select("author").distinct())


def recorded_passages_per_kind(spark: SparkSession, d: str) -> DataFrame:
    """Passages and vectors in one list of counts per document kind."""
    kinds = C._latest(spark, d).select("document_id", G.stratum(F.col("genre")).alias("kind"))
    p = table(spark, d, "passages").select("document_id", "passage_id").distinct().withColumn("what", F.lit("passage"))
    v = table(spark, d, "passage_vectors").select("document_id", "passage_id").distinct().withColumn("what", F.lit("vector"))
    return p.unionByName(v).join(kinds, "document_id").groupBy("kind", "what").agg(F.count(F.lit(1)).alias("rows"))


def outer_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Pooled outer folds: rates of the frozen decisions beside ranking figures of the pooled scores."""
    rows = _rows(spark, d).where(F.col("outer_fold").isNotNull() & X.finite("fold_match_threshold") & X.finite("score") & F.col("label").isNotNull()).withColumn("g", F.lit("outer"))
    rows = materialize(rows.withColumn("decision", X.decision(F.col("score"), F.col("fold_match_threshold"), F.col("fold_mismatch_threshold"))))
    return _rounded(X.full_report(rows, "g"), "tpr", "fpr", "accuracy", "open_rate", "auroc", "average_precision", "eer", "brier", "ece", "tpr_at_1", "tpr_at_5", "tpr_at_10").drop("g")


def holdout_report(spark: SparkSession, d: str) -> DataFrame:
    """The hold-out population under fixed thresholds, over all sources and by source: documents, rates and mean score."""
    rows = _rows(spark, d).where("split = 'historical_holdout'").where(X.finite("score") & F.col("label").isNotNull())
    hit = (F.col("score") >= MATCH).cast("double")
    out = rows.withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("none"))).rollup("source").agg(
        F.count(F.lit(1)).alias("documents"), F.avg(F.when(F.col("label") == 1, hit)).alias("tpr"), F.avg(F.when(F.col("label") == 0, hit)).alias("fpr"), F.avg("score").alias("mean_score"), F.avg((F.col("score") < MISMATCH).cast("double")).alias("mismatch_rate"),
    )
    return _rounded(out, "tpr", "fpr", "mean_score", "mismatch_rate")


def positive_report(spark: SparkSession, d: str) -> DataFrame:
    """Positives alone, by population: how many are accepted, and their mean, least and greatest score."""
    rows = _rows(spark, d).where((F.col("label") == 1) & X.finite("score"))
    out = rows.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.avg((F.col("score") >= MATCH).cast("double")).alias("accepted"), F.avg("score").alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("most"))
    return _rounded(out, "accepted", "mean_score")


def fixed_source_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Development negatives by the three kinds of source, also those without any document."""
    kinds = spark.createDataFrame([("email",), ("technical_blog",), ("ai_synthetic",)], "kind string")
    rows = _rows(spark, d).where((F.col("label") == 0) & X.finite("score") & (F.col("split") == "development_oof"))
    own = rows.groupBy(F.lower(F.trim("source_type")).alias("kind")).agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(F.lower(F.trim("author_id"))).alias("authors"), F.median("score").alias("median_score"), F.avg((F.col("decision") == "MATCH").cast("double")).alias("false_acceptance"))
    out = own.join(kinds, "kind", "right").select("kind", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("authors", F.lit(0)).alias("authors"), "median_score", "false_acceptance")
    return _rounded(out, "median_score", "false_acceptance")


NEGATIVE_SUPPLY = SCORE_SQL["negative_supply"]
_V = f"""WITH {C._LATEST}, dl AS (SELECT document_id, coalesce(root_document_id, document_id) AS root, CASE WHEN lower(trim(author_id)) NOT IN ('', 'unknown', 'n/a', '-') THEN lower(trim(author_id)) END AS author, {C._LABEL} AS label FROM latest),
ok AS (SELECT vec_id, document_id, embedding::DOUBLE[] AS e FROM passage_vectors WHERE vec_id IS NOT NULL AND document_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS MATERIALIZED (SELECT o.vec_id, o.m.d AS document_id, o.m.e AS e, dl.root, dl.author, dl.label FROM (SELECT vec_id, max({{'d': document_id, 'e': e}}) AS m FROM ok GROUP BY 1) o JOIN dl ON dl.document_id = o.m.d),
a AS MATERIALIZED (SELECT * FROM v WHERE document_id IN (SELECT document_id FROM v WHERE vec_id % 50 = 0))"""
_TWO_WAYS = "SELECT c, r, (x + y)/2 AS s FROM (SELECT c, r, avg(m) AS x FROM (SELECT c, r, i, max(s) AS m FROM {s} GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT c, r, avg(m) AS y FROM (SELECT c, r, j, max(s) AS m FROM {s} GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (c, r)"
_USER = f"""pu AS MATERIALIZED (SELECT a.document_id AS c, b.document_id AS r, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS s FROM a, v b WHERE b.label = 1 AND a.root <> b.root),
su AS ({_TWO_WAYS.format(s="pu")})"""
_PAR = rf"list_filter(string_split_regex(clean_text, '\n\s*\n'), lambda p: len(regexp_extract_all(p, '{Q.W}')) >= 20)"
_SQ = lambda t: rf"trim(regexp_replace({t}, '[\pZ\s]+', ' ', 'g'))"
SQL = {
    "deviation_details": Q.measures_sql() + Q._UNPIVOT + f""", r AS (SELECT feature, value FROM l WHERE source = '{Q.REFERENCE}'), md AS (SELECT feature, median(value) AS median, avg(value) AS mean, stddev_pop(value) AS std, count(DISTINCT value) > 1 AS varies FROM r GROUP BY 1),
cd AS (SELECT doc_id, feature, value FROM l WHERE doc_id % 50 = 0), pc AS (SELECT doc_id, cd.feature, cd.value, 100.0*(sum((round(r.value, 9) < round(cd.value, 9))::INT) + 0.5*sum((round(r.value, 9) = round(cd.value, 9))::INT))/count(*) AS percentile FROM cd JOIN r ON r.feature = cd.feature GROUP BY 1, 2, 3)
SELECT doc_id, feature, upper(x[1]) || x[2:] AS label, round(value, 5) AS value, round(median, 5) AS median, round(mean, 5) AS mean, round(std, 5) AS std, round(percentile, 5) AS percentile, varies FROM (SELECT *, replace(replace(feature, 'function_', 'Function word: '), '_', ' ') AS x FROM pc JOIN md USING (feature))""",
    "structure_measures": rf"""WITH {C._PROSE}, n AS (SELECT document_id, raw_markdown AS s, greatest(len(regexp_extract_all(lower(clean_text), '{Q.W}')), 1)::DOUBLE AS n FROM prose WHERE raw_markdown IS NOT NULL)
SELECT document_id, round(1000.0*len(regexp_extract_all(s, '(?m)^\s{{0,3}}#{{1,6}}\s+'))/n, 5) AS heading_rate, round(1000.0*len(regexp_extract_all(s, '(?m)^\s*(?:[-*+]|\d+[.)])\s+'))/n, 5) AS list_rate, round(1000.0*len(regexp_extract_all(s, '(?m)^\s*>'))/n, 5) AS quote_paragraph_rate FROM n""".replace("\\\\", "\\"),
    "negative_contrast": f"""{_V}, {_USER}, pn AS MATERIALIZED (SELECT a.document_id AS c, b.author AS r, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS s FROM a, v b WHERE b.label = 0 AND b.author IS NOT NULL AND (a.author IS NULL OR a.author <> b.author)),
sn AS (SELECT c, max(s) AS best, median(s) AS mid FROM ({_TWO_WAYS.format(s="pn")}) GROUP BY 1), u AS (SELECT c, median(s) AS u FROM su GROUP BY 1)
SELECT c AS document_id, round(u, 5) AS user_similarity, round(coalesce(best, 0), 5) AS best_negative, round(coalesce(mid, 0), 5) AS median_negative, round(u - coalesce(best, 0), 5) AS user_minus_best, round(u - coalesce(mid, 0), 5) AS user_minus_median FROM u LEFT JOIN sn USING (c)""",
    "best_documents": f"{_V}, {_USER} SELECT c AS document_id, r AS \"like\", rank, round(s, 5) AS maxsim FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(s, 9) DESC, r) AS rank FROM su) WHERE rank <= 10",
    "char_symmetric_similarity": rf"""WITH {C._SAMP}, pp AS (SELECT sample_id, unnest(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S'))) AS text FROM samp), pas AS (SELECT sample_id, row_number() OVER () AS k, regexp_replace(lower(text), '[\pZ\s][\pZ\s]+', ' ', 'g') AS t FROM pp),
g AS (SELECT k, substring(t, i::BIGINT, n::BIGINT) AS gram FROM pas, (VALUES (3), (4), (5)) l(n), unnest(range(1, length(t) - n + 2)) u(i)), tf AS MATERIALIZED (SELECT k, gram, count(*) AS tf FROM g GROUP BY 1, 2),
vc AS (SELECT gram, count(*) AS df, sum(tf) AS total, ln((1 + (SELECT count(DISTINCT k) FROM tf))/(1 + count(*))) + 1 AS idf FROM tf GROUP BY 1 ORDER BY total DESC, gram LIMIT 50000), w AS (SELECT k, gram, (1 + ln(tf))*idf AS w FROM tf JOIN vc USING (gram)),
n AS (SELECT k, sqrt(sum(w*w)) AS norm FROM w GROUP BY 1), x AS MATERIALIZED (SELECT k, gram, w/norm AS w FROM w JOIN n USING (k)), cs AS (SELECT a.k AS i, b.k AS j, sum(a.w*b.w) AS s FROM x a JOIN x b USING (gram) WHERE a.k IN (SELECT k FROM pas WHERE regexp_extract(sample_id, '(\d+)$', 1)::BIGINT % 50 = 0) GROUP BY 1, 2),
al AS MATERIALIZED (SELECT p.sample_id AS c, q.sample_id AS r, p.k AS i, q.k AS j, coalesce(s, 0) AS s FROM pas p JOIN pas q ON p.sample_id <> q.sample_id LEFT JOIN cs ON cs.i = p.k AND cs.j = q.k WHERE regexp_extract(p.sample_id, '(\d+)$', 1)::BIGINT % 50 = 0)
SELECT c AS sample_id, round(median(s), 6) AS similarity FROM ({_TWO_WAYS.format(s="al")}) GROUP BY 1""",
    "reserved_overlap": f"""WITH {C._PROSE}, z AS (SELECT document_id, split, {_SQ('clean_text')} AS whole, list_transform({_PAR}, lambda p: {_SQ('p')}) AS ps FROM prose WHERE split IN ('primary_test', 'train'))
SELECT t.document_id, r.document_id AS training_id FROM z t JOIN z r ON t.split = 'primary_test' AND r.split = 'train' WHERE t.whole = r.whole OR len(list_filter(t.ps, lambda p: contains(r.whole, p))) > 0 OR len(list_filter(r.ps, lambda p: contains(t.whole, p))) > 0""",
    "sample_checks": f"""WITH {C._PROSE}, {C._SAMP}, runs AS (SELECT DISTINCT array_to_string(w[i:i + 11], ' ') AS x FROM (SELECT regexp_extract_all(lower(clean_text), '{Q.W}') AS w FROM prose), unnest(range(1, len(w) - 10)) u(i)),
sents AS (SELECT DISTINCT s FROM (SELECT unnest({Q._sents('clean_text')}) AS s FROM prose) WHERE len(regexp_extract_all(s, '{Q.W}')) >= 8), sw AS (SELECT sample_id, regexp_extract_all(lower(text), '{Q.W}') AS w FROM samp),
sr AS (SELECT DISTINCT sample_id FROM sw, unnest(range(1, len(w) - 10)) u(i) WHERE array_to_string(w[i:i + 11], ' ') IN (SELECT x FROM runs)), ss AS (SELECT DISTINCT sample_id FROM (SELECT sample_id, unnest({Q._sents('text')}) AS s FROM samp) WHERE len(regexp_extract_all(s, '{Q.W}')) >= 8 AND s IN (SELECT s FROM sents)),
o AS (SELECT sample_id, len(w)::INT AS words, len(w) BETWEEN 150 AND 700 AS fits, sample_id IN (SELECT * FROM sr) AS shares_run, sample_id IN (SELECT * FROM ss) AS copies_sentence FROM sw) SELECT *, fits AND NOT shares_run AND NOT copies_sentence AS passes FROM o""",
    "provenance": f"""WITH RECURSIVE {C._LATEST}, p AS (SELECT document_id, coalesce(root_document_id, document_id) AS parent, source_type IS NOT NULL AS visible FROM latest),
w(document_id, pos, steps, visible) AS (SELECT document_id, parent, 0, visible FROM p UNION ALL SELECT w.document_id, p.parent, w.steps + 1, w.visible AND p.visible FROM w JOIN p ON p.document_id = w.pos WHERE w.pos <> p.parent AND w.steps < 1000),
e AS (SELECT w.document_id, w.pos AS origin, w.steps + (w.document_id <> w.pos)::INT AS steps, w.visible AND p.visible AS visible FROM w JOIN p ON p.document_id = w.pos WHERE p.parent = p.document_id)
SELECT p.document_id, e.origin, e.steps, e.visible FROM p LEFT JOIN e USING (document_id)""",
    "lineage_counts": f"WITH {C._LATEST} SELECT coalesce(root_document_id, document_id) AS root, count(*) AS documents, md5('42|' || coalesce(root_document_id, document_id)) AS draw FROM latest GROUP BY 1 HAVING documents < 20",
    "curation_status": """WITH r AS (SELECT DISTINCT sample_id, coalesce(lower(trim(source_type)), 'none') AS kind, lower(trim(author_id)) AS author FROM manifest_rows WHERE sample_id IS NOT NULL), p AS (SELECT kind, author, count(*) AS n FROM r GROUP BY 1, 2),
o AS (SELECT kind, sum(n) AS samples, count(*) FILTER (WHERE n >= 20 AND author IS NOT NULL) AS big_authors, round(max(n)/sum(n), 6) AS largest_share FROM p GROUP BY 1) SELECT *, samples >= 100 AS enough, big_authors >= 3 AND largest_share <= 0.5 AS varied FROM o""",
    "supervision_gate": f"WITH s AS ({NEGATIVE_SUPPLY}), e AS (SELECT *, negative_roots >= 10 AND (negative_authors = 0 OR negative_authors >= 3) AS eligible FROM s) SELECT split, eligible, eligible AND positive_roots >= 6 AS supervised, coalesce(largest_share > 0.5, false) AS dominated FROM e",
    "root_margin_rows": "WITH p AS (SELECT DISTINCT * FROM predictions), m AS (SELECT root_document_id, round(median(raw_margin), 9) AS margin FROM p WHERE isfinite(raw_margin) GROUP BY 1) SELECT DISTINCT root_document_id, split, label, margin FROM p LEFT JOIN m USING (root_document_id)",
    "authors_on_both_sides": f"WITH {C._LATEST}, b AS (SELECT lower(trim(author_id)) AS author, {C._LABEL} AS label FROM latest) SELECT author FROM b WHERE label = 1 AND author NOT IN ('', 'unknown', 'n/a', '-') INTERSECT SELECT author FROM b WHERE label = 0",
    "authors_without_train": f"WITH {C._LATEST}, b AS (SELECT lower(trim(author_id)) AS author, split FROM latest) SELECT DISTINCT author FROM b WHERE author NOT IN ('', 'unknown', 'n/a', '-') EXCEPT SELECT author FROM b WHERE split = 'train'",
    "recorded_passages_per_kind": f"WITH {C._LATEST}, k AS (SELECT document_id, {C._STRATUM} AS kind FROM latest), r AS (SELECT DISTINCT document_id, passage_id, 'passage' AS what FROM passages UNION ALL SELECT DISTINCT document_id, passage_id, 'vector' FROM passage_vectors) SELECT kind, what, count(*) AS rows FROM r JOIN k USING (document_id) GROUP BY 1, 2",
    "holdout_report": f"""WITH p AS (SELECT DISTINCT * FROM predictions), h AS (SELECT coalesce(lower(trim(source)), 'none') AS source, label, score FROM p WHERE split = 'historical_holdout' AND isfinite(score) AND label IS NOT NULL)
SELECT source, count(*) AS documents, round(avg((score >= {MATCH})::INT) FILTER (WHERE label = 1), 6) AS tpr, round(avg((score >= {MATCH})::INT) FILTER (WHERE label = 0), 6) AS fpr, round(avg(score), 6) AS mean_score, round(avg((score < {MISMATCH})::INT), 6) AS mismatch_rate FROM h GROUP BY ROLLUP (source)""",
    "positive_report": f"WITH p AS (SELECT DISTINCT * FROM predictions) SELECT split, count(*) AS documents, round(avg((score >= {MATCH})::INT), 6) AS accepted, round(avg(score), 6) AS mean_score, min(score) AS least, max(score) AS most FROM p WHERE label = 1 AND isfinite(score) GROUP BY 1",
    "fixed_source_diagnostics": """WITH p AS (SELECT DISTINCT * FROM predictions), q AS (SELECT lower(trim(source_type)) AS kind, lower(trim(author_id)) AS author, score, decision FROM p WHERE label = 0 AND isfinite(score) AND split = 'development_oof')
SELECT k.kind, count(score) AS documents, count(DISTINCT author) AS authors, round(median(score), 6) AS median_score, round(avg((decision = 'MATCH')::INT), 6) AS false_acceptance FROM (VALUES ('email'), ('technical_blog'), ('ai_synthetic')) k(kind) LEFT JOIN q USING (kind) GROUP BY 1""",
}
QUERIES = {
    f.__name__: f
    for f in (deviation_details, structure_measures, negative_contrast, best_documents, char_symmetric_similarity, reserved_overlap, sample_checks, provenance, lineage_counts, curation_status, supervision_gate, root_margin_rows, authors_on_both_sides,
              authors_without_train, recorded_passages_per_kind, outer_decisions, holdout_report, positive_report, fixed_source_diagnostics)
}
