"""Queries on stylometric measures, and the SQL that checks them. One document of `documents` is one root; its source stands for its author."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import measures as M
from scriptorium.functions import text as T
from scriptorium.operators import distributions as D
from scriptorium.session import materialize, spread, table

REFERENCE = "weblog_north"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", F.lower(F.trim("source")).alias("source")))


def _family(name: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = M.measured(_docs(spark, d), keep=("doc_id",))
        return f.select("doc_id", *(F.round(c, 6).alias(c) for c in M.FAMILIES[name]))

    run.__doc__ = f"The {name.replace('_', ' ')} measures of every document."
    return run


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words of every text."""
    return _docs(spark, d).where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every text."""
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


def sentence_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its place."""
    s = _docs(spark, d).where("text is not null").select("doc_id", F.explode(T.sentence_spans(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.index").alias("index"), F.col("s.start_char").alias("start_char"), F.col("s.end_char").alias("end_char"), F.md5(F.col("s.text")).alias("digest"))


def paragraph_counts(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank paragraphs of every text."""
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("paragraphs"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return M.long_form(_wide(spark, d), ("doc_id", "source"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """The measures of every document, worked out once."""
    return materialize(M.measured(_docs(spark, d), keep=("doc_id", "source")))


def feature_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Median, deviation and robust scale of each measure over the reference source."""
    out = D.distribution(_long(spark, d).where(F.col("source") == REFERENCE))
    return out.select("feature", *(F.round(c, 6).alias(c) for c in ("median", "std", "mad", "scale")))


def robust_deviations(spark: SparkSession, d: str) -> DataFrame:
    """How far each measure of each document is from the reference source."""
    every = _long(spark, d)
    out = D.deviations(every, D.distribution(every.where(F.col("source") == REFERENCE)))
    return out.select("doc_id", "feature", F.round("robust_z", 4).alias("robust_z"), "position")


def stylometry_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike each document is to the reference source by its measures."""
    wide = _wide(spark, d)
    dist = D.distribution(M.long_form(wide.where(F.col("source") == REFERENCE), ("doc_id",)))
    return D.stylometry_similarity(wide, dist, ("doc_id", "source")).select("doc_id", "source", F.round("similarity", 6).alias("similarity"))


def stylometry_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """The reference source's own documents against each other: mean and spread of their similarity to the rest, by length class."""
    own = _docs(spark, d).where(F.col("source") == REFERENCE).withColumn("words", F.coalesce(T.word_count(F.col("text")), F.lit(0)))
    return D.spread_of_history(materialize(M.measured(own, keep=("doc_id", "words"))))


def historical_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's mean sentence length falls among the reference source's, in percent, ties counted half."""
    wide = M.measured(_docs(spark, d), keep=("doc_id", "source"))
    hist = wide.where(F.col("source") == REFERENCE)
    return D.percentiles(wide.select("doc_id", F.round("sentence_length_mean", 6).alias("v")), hist.select(F.round("sentence_length_mean", 6).alias("v"))).select("doc_id", F.round("percentile", 6).alias("percentile"))


W = r"[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*"
_NOT = r"[^\p{L}\p{N}_]"
_MARK = (
    r"regexp_replace(regexp_replace(regexp_replace({t}, '(^|[^\p{L}\p{N}_])(Dr|Mr|Mrs|Ms|Prof|St|vs|etc|e\.g|i\.e)\.', '\1\2' || chr(2), 'g'), "
    r"'([.!?]+[\"''’”)]*)(\s|\z)', '\1' || chr(1) || '\2', 'g'), '(\n\s*\n)', chr(1) || '\1', 'g')"
).replace('\\"', '"')


def _sents(t: str) -> str:
    return r"list_filter(list_transform(string_split(" + _MARK.replace("{t}", t) + r", chr(1)), lambda x: regexp_replace(replace(x, chr(2), '.'), '^\s+|\s+\z', '', 'g')), lambda x: regexp_matches(x, '[\p{L}\p{N}_]'))"


def _count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def measures_sql(where: str = "") -> str:
    """CTEs that end in `m`: doc_id, source and the 95 measures."""
    ws = lambda names: "(" + "+".join(f"(length(j)-length(replace(j, ' {w} ', '')))/{len(w) + 2}.0" for w in names) + ")"
    avg, med = lambda a: f"list_avg({a})", lambda a: f"list_median({a})"
    mom = lambda a, k, s="1.0": f"list_avg(list_transform({a}, lambda x: pow((x - list_avg({a}))/{s}, {k})))"
    share = lambda p: f"len(list_filter(wl, lambda x: {p}))/len(wl)"
    std = lambda a: f"sqrt({mom(a, 2)})"
    e = {
        "sentence_length_mean": avg("sl"), "sentence_length_median": med("sl"), "sentence_length_std": std("sl"), "sentence_length_skew": mom("sl", 3, f"greatest({std('sl')}, 1.0)"),
        "paragraph_length_mean": avg("pl"), "paragraph_length_median": med("pl"), "paragraph_length_std": std("pl"), "sentences_per_paragraph": "len(s)/greatest(len(p),1)",
        "word_length_mean": avg("wl"), "word_length_std": std("wl"), "type_token_ratio": "len(list_distinct(w))/n", "root_type_token_ratio": "len(list_distinct(w))/sqrt(n)",
        "hapax_rate": "coalesce(len(list_filter(map_values(list_histogram(w)), lambda x: x = 1)), 0)/n", "short_word_rate": share("x <= 3"), "long_word_rate": share("x >= 8"),
        "lexical_density_proxy": f"1.0 - {ws(M.FUNCTION_WORDS)}/n", "contraction_rate": "1000.0*len(list_filter(w, lambda x: contains(x, '''') OR contains(x, '’')))/n",
        "parenthetical_rate": f"1000.0*{_count('t', r'\([^)]*\)')}/n", "question_sentence_rate": r"""len(list_filter(s, lambda x: regexp_matches(x, '\?["'')”’]*\z')))/greatest(len(s),1)""",
        "sentence_initial_conjunction_rate": rf"len(list_filter(s, lambda x: regexp_matches(x, '(?i)^(?:and|but|so|or)({_NOT}|\z)')))/greatest(len(s),1)",
        "one_sentence_paragraph_rate": f"len(list_filter(p, lambda x: len({_sents('x')}) = 1))/greatest(len(p),1)",
        "passive_voice_proxy": "1000.0*" + _count(rf"regexp_replace(lower(t), '({_NOT})', '\1\1', 'g')", rf"(?:^|{_NOT})(?:is|are|was|were|been|be)\s+[\p{{L}}\p{{N}}_]+ed(?:{_NOT}|\z)") + "/n",
        "capitalized_word_rate": r"1000.0*len(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z][a-z]+$')))/n",
        "uppercase_word_rate": r"1000.0*len(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z][A-Z]+$')))/n",
        "heading_rate": "1000.0*" + _count("t", r"(?m)^\s{0,3}#{1,6}\s+") + "/n", "list_rate": "1000.0*" + _count("t", r"(?m)^\s*(?:[-*+]|\d+[.)])\s+") + "/n", "quote_paragraph_rate": "1000.0*" + _count("t", r"(?m)^\s*>") + "/n",
    }
    e |= {name: f"1000.0*{ws(words)}/n" for name, words in (M.PRONOUNS | M.DISCOURSE).items()}
    e |= {f"function_{w}_rate": f"1000.0*{ws([w])}/n" for w in M.FUNCTION_WORDS}
    e |= {f"{p}_rate": f"1000.0*(length(t)-length(replace(t, '{ch}', '')))/n" for p, ch in M.PUNCTUATION.items()}
    e |= {f"word_length_{a}_{b}_fraction": share(f"x >= {a} AND x <= {b}") for a, b in M.LENGTH_BINS}
    zero = lambda a: f"CASE WHEN len({a}) > 0 THEN {a} ELSE [0.0] END"
    return (
        f"WITH d AS (SELECT doc_id, lower(trim(source)) AS source, coalesce(text, '') AS t FROM documents {where}), "
        f"b AS (SELECT doc_id, source, t, regexp_extract_all(lower(t), '{W}') AS w, {_sents('t')} AS s, list_filter(string_split_regex(t, '\\n\\s*\\n'), lambda x: regexp_matches(x, '\\S')) AS p FROM d), "
        f"c AS (SELECT *, greatest(len(w), 1)::DOUBLE AS n, ' ' || array_to_string(w, '  ') || ' ' AS j, {zero(f"list_transform(s, lambda x: {_count('x', W)}::DOUBLE)")} AS sl, "
        f"{zero(f"list_transform(p, lambda x: {_count('x', W)}::DOUBLE)")} AS pl, {zero('list_transform(w, lambda x: length(x)::DOUBLE)')} AS wl FROM b), "
        "m AS (SELECT doc_id, source, " + ", ".join(f"({e[name]})::DOUBLE AS {name}" for name in M.NAMES) + " FROM c)"
    )


_UNPIVOT = ", l AS (SELECT doc_id, source, feature, value FROM (UNPIVOT m ON " + ", ".join(M.NAMES) + " INTO NAME feature VALUE value))"
_DIST = f"""{_UNPIVOT}, r AS (SELECT * FROM l WHERE source = '{REFERENCE}'),
md AS (SELECT feature, median(value) AS med, stddev_pop(value) AS sd FROM r GROUP BY 1),
dist AS (SELECT feature, med, sd, 1.4826*median(abs(value - med)) AS mad, greatest(1.4826*median(abs(value - med)), 0.25*sd, greatest(0.1*abs(med), 0.01)) AS scale FROM r JOIN md USING (feature) GROUP BY 1, 2, 3)"""
_TEXTS = "FROM documents WHERE text IS NOT NULL"
SQL = {f"{f}_measures": measures_sql() + " SELECT doc_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in names) + " FROM m" for f, names in M.FAMILIES.items()} | {
    "word_counts": f"SELECT doc_id, {_count('text', W)} AS words {_TEXTS}",
    "sentence_counts": f"SELECT doc_id, len({_sents('text')}) AS sentences {_TEXTS}",
    "paragraph_counts": f"SELECT doc_id, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: regexp_matches(x, '\\S'))) AS paragraphs {_TEXTS}",
    "sentence_offsets": rf"""WITH p AS (SELECT doc_id, string_split(replace({_MARK.replace("{t}", "text")}, chr(2), '.'), chr(1)) AS parts {_TEXTS}),
q AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM p),
o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)  , 0) AS off, regexp_replace(part, '^\s+|\s+\z', '', 'g') AS body FROM q)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS index, (off + length(part) - length(regexp_replace(part, '^\s+', '')))::INT AS start_char,
(off + length(part) - length(regexp_replace(part, '^\s+', '')) + length(body))::INT AS end_char, md5(body) AS digest FROM o WHERE regexp_matches(body, '[\p{{L}}\p{{N}}_]')""",
    "feature_distribution": measures_sql() + _DIST + " SELECT feature, round(med, 6) AS median, round(sd, 6) AS std, round(mad, 6) AS mad, round(scale, 6) AS scale FROM dist",
    "robust_deviations": measures_sql() + _DIST + " SELECT doc_id, feature, round((value - med)/scale, 4) AS robust_z, CASE WHEN abs((value - med)/scale) < 1 THEN 'within' WHEN value > med THEN 'higher' ELSE 'lower' END AS position FROM l JOIN dist USING (feature)",
    "stylometry_similarity": measures_sql() + _DIST + " SELECT doc_id, source, round(exp(-avg(least(abs((value - med)/scale), 8))/2), 6) AS similarity FROM l JOIN dist USING (feature) GROUP BY 1, 2",
    "stylometry_leave_one_out": measures_sql() + _UNPIVOT + f""", r AS MATERIALIZED (SELECT doc_id, feature, value FROM l WHERE source = '{REFERENCE}'), n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS words FROM documents WHERE lower(trim(source)) = '{REFERENCE}'),
lo AS (SELECT a.doc_id, a.feature, a.value AS v, median(b.value) AS med, stddev_pop(b.value) AS sd FROM r a JOIN r b ON a.feature = b.feature AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3),
la AS (SELECT lo.doc_id, lo.feature, v, med, sd, 1.4826*median(abs(b.value - med)) AS mad FROM lo JOIN r b ON b.feature = lo.feature AND b.doc_id <> lo.doc_id GROUP BY 1, 2, 3, 4, 5),
sim AS (SELECT doc_id, exp(-avg(least(abs(v - med)/greatest(mad, 0.25*sd, 0.1*abs(med), 0.01), 8))/2) AS s FROM la GROUP BY 1)
SELECT (CASE WHEN words < 150 THEN 0 WHEN words < 500 THEN 1 ELSE 2 END)::INT AS length_class, count(*) AS documents, round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS spread FROM sim JOIN n USING (doc_id) GROUP BY 1""",
    "historical_percentile": measures_sql() + f""", v AS (SELECT doc_id, source, round(sentence_length_mean, 6) AS v FROM m), h AS (SELECT v FROM v WHERE source = '{REFERENCE}')
SELECT x.doc_id, round(100.0*(sum((h.v < x.v)::INT) + 0.5*sum((h.v = x.v)::INT))/count(*), 6) AS percentile FROM v x, h GROUP BY 1""",
}
QUERIES = {f"{f}_measures": _family(f) for f in M.FAMILIES} | {f.__name__: f for f in (word_counts, sentence_counts, sentence_offsets, paragraph_counts, feature_distribution, robust_deviations, stylometry_similarity, stylometry_leave_one_out, historical_percentile)}
