"""The 95 stylometric measures, in one pass over the rows and without a shuffle.

`measured` counts in Arrow batches: one tokenisation feeds all measures, where column expressions scan a text once for every list and mark. (Over 10,000 documents: 13 s of
eight cores with expressions.) `measured_columns` is the same as column expressions, for plans in which no Python may run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T

# ---- fixed values: word lists and marks that name the measures ----
FUNCTION_WORDS = (
    "a an the and but or so if because while although of in on at by for from to with without about as is are was were be been have has had do does did can could would should will may might it this that these those"
).split()
PRONOUNS = {
    "first_person_singular_rate": "i me my mine myself".split(),
    "first_person_plural_rate": "we us our ours ourselves".split(),
    "second_person_rate": "you your yours yourself".split(),
    "third_person_rate": "he she they him her them their".split(),
}
DISCOURSE = {
    "transition_rate": "however therefore anyway instead meanwhile finally furthermore nonetheless".split(),
    "hedge_rate": "perhaps maybe probably seems possibly apparently".split(),
    "intensifier_rate": "very really extremely quite absolutely".split(),
    "subordinate_marker_rate": "because although while unless since whereas".split(),
}
PUNCTUATION = {"comma": ",", "period": ".", "semicolon": ";", "colon": ":", "em_dash": "—", "hyphen": "-", "question": "?", "exclamation": "!", "double_quote": '"'}
LENGTH_BINS = ((1, 3), (4, 6), (7, 9), (10, 1000))
# ---- end of fixed values ----
FAMILIES = {
    "sentence_length": ["sentence_length_mean", "sentence_length_median", "sentence_length_std", "sentence_length_skew", "sentences_per_paragraph"],
    "paragraph": ["paragraph_length_mean", "paragraph_length_median", "paragraph_length_std", "one_sentence_paragraph_rate"],
    "lexical": ["word_length_mean", "word_length_std", "type_token_ratio", "root_type_token_ratio", "hapax_rate", "short_word_rate", "long_word_rate", "lexical_density_proxy", "contraction_rate"],
    "pronoun": list(PRONOUNS),
    "discourse": [*DISCOURSE, "parenthetical_rate", "question_sentence_rate", "sentence_initial_conjunction_rate", "passive_voice_proxy", "capitalized_word_rate", "uppercase_word_rate"],
    "markup": ["heading_rate", "list_rate", "quote_paragraph_rate"],
    "function_word": [f"function_{w}_rate" for w in FUNCTION_WORDS],
    "punctuation": [f"{p}_rate" for p in PUNCTUATION],
    "word_length_bin": [f"word_length_{a}_{b}_fraction" for a, b in LENGTH_BINS],
}
NAMES = [n for names in FAMILIES.values() for n in names]


def _sums(a: Column) -> Column:
    """Sums of the first three powers of an array, in one pass. (A mean inside a lambda would be worked out anew for every element.)"""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    return F.aggregate(a, zero, lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + x * x).alias("b"), (s["c"] + x * x * x).alias("c")))


def _median(a: Column) -> Column:
    """Median of a sorted array."""
    return (F.get(a, ((F.size(a) - 1) / 2).cast("int")) + F.get(a, (F.size(a) / 2).cast("int"))) / 2.0


def measured_columns(df: DataFrame, text: str = "text", structure: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns and the 95 measures of `text`; `structure` holds the marked-up source where headings, lists and quotes are counted.

    Null texts count as empty. Empty arrays count as a single 0, so every measure is defined for every row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    src = F.coalesce(F.col(structure), t) if structure else t
    base = df.select(*keep, t.alias("_t"), src.alias("_src"), T.words(F.lower(t)).alias("_w"), T.sentences(t).alias("_s"), T.paragraphs(t).alias("_p"))
    base = base.select("*", F.transform("_s", lambda s: T.word_count(s).cast("double")).alias("_sl0"), F.transform("_p", lambda p: T.word_count(p).cast("double")).alias("_pl0"), F.transform("_w", lambda w: F.length(w).cast("double")).alias("_wl0"), F.array_sort("_w").alias("_sorted"), F.size("_w").alias("_k"))
    or_zero = lambda a: F.when(F.size(a) > 0, F.col(a)).otherwise(F.array(F.lit(0.0)))
    base = base.select("*", F.array_sort(or_zero("_sl0")).alias("_sl"), F.array_sort(or_zero("_pl0")).alias("_pl"), or_zero("_wl0").alias("_wl"))
    k = F.col("_k")
    n = F.greatest(k, F.lit(1)).cast("double")
    single = F.size(F.filter(F.transform("_sorted", lambda w, i: ((i == 0) | (F.get("_sorted", i - 1) != w)) & ((i == k - 1) | (F.get("_sorted", i + 1) != w))), lambda x: x))
    step = base.select(
        *keep, "_t", n.alias("_n"), F.size("_s").alias("_sn"), F.size("_p").alias("_pn"), "_wl",
        F.size(F.array_distinct("_w")).alias("_types"), single.alias("_single"), F.size(F.filter("_w", lambda w: w.contains("'") | w.contains("’"))).alias("_short"),
        _sums(F.col("_sl")).alias("_ss"), _sums(F.col("_pl")).alias("_ps"), _sums(F.col("_wl")).alias("_ws"), _median(F.col("_sl")).alias("_sm"), _median(F.col("_pl")).alias("_pm"), F.size("_sl").alias("_sk"), F.size("_pl").alias("_pk"), F.size("_wl").alias("_wk"),
        F.size(F.filter("_p", lambda p: F.size(T.sentences(p)) == 1)).alias("_p1"),
        F.size(F.filter("_s", lambda s: s.rlike(r"\?[\"')”’]*\z"))).alias("_sq"),
        F.size(F.filter("_s", lambda s: s.rlike(r"(?i)^(?:and|but|so|or)([^\p{L}\p{N}_]|\z)"))).alias("_sc"),
        F.regexp_extract_all("_t", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("_runs"), F.regexp_replace(F.lower("_t"), r"([^\p{L}\p{N}_])", "$1$1").alias("_wide"),
        F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" ")).alias("_j"),
        F.regexp_count("_src", F.lit(r"(?m)^\s{0,3}#{1,6}\s+")).alias("_heads"), F.regexp_count("_src", F.lit(r"(?m)^\s*(?:[-*+]|\d+[.)])\s+")).alias("_lists"), F.regexp_count("_src", F.lit(r"(?m)^\s*>")).alias("_quotes"),
    )
    N = F.col("_n")  # noqa: N806
    count = lambda ws: sum((F.length("_j") - F.length(F.replace(F.col("_j"), F.lit(f" {w} "), F.lit("")))) / F.lit(float(len(w) + 2)) for w in ws)
    rate = lambda c: 1000.0 * c / N
    literal = lambda ch: F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(ch), F.lit("")))
    share = lambda p: F.size(F.filter("_wl", p)) / F.size("_wl").cast("double")
    within = lambda a, b: share(lambda x: (x >= a) & (x <= b))
    mean = lambda c, k: F.col(c)["a"] / F.col(k)
    var = lambda c, k: F.greatest(F.lit(0.0), F.col(c)["b"] / F.col(k) - mean(c, k) * mean(c, k))
    third = F.col("_ss")["c"] / F.col("_sk") - 3 * mean("_ss", "_sk") * F.col("_ss")["b"] / F.col("_sk") + 2 * mean("_ss", "_sk") * mean("_ss", "_sk") * mean("_ss", "_sk")
    s_std = F.greatest(F.sqrt(var("_ss", "_sk")), F.lit(1.0))
    m: dict[str, Column] = {
        "sentence_length_mean": mean("_ss", "_sk"), "sentence_length_median": F.col("_sm"), "sentence_length_std": F.sqrt(var("_ss", "_sk")), "sentence_length_skew": third / (s_std * s_std * s_std),
        "paragraph_length_mean": mean("_ps", "_pk"), "paragraph_length_median": F.col("_pm"), "paragraph_length_std": F.sqrt(var("_ps", "_pk")),
        "sentences_per_paragraph": F.col("_sn") / F.greatest(F.col("_pn"), F.lit(1)),
        "word_length_mean": mean("_ws", "_wk"), "word_length_std": F.sqrt(var("_ws", "_wk")),
        "type_token_ratio": F.col("_types") / N, "root_type_token_ratio": F.col("_types") / F.sqrt(N), "hapax_rate": F.col("_single") / N,
        "short_word_rate": share(lambda x: x <= 3), "long_word_rate": share(lambda x: x >= 8),
        "lexical_density_proxy": 1.0 - count(FUNCTION_WORDS) / N, "contraction_rate": rate(F.col("_short")),
        "parenthetical_rate": rate(F.regexp_count("_t", F.lit(r"\([^)]*\)"))), "question_sentence_rate": F.col("_sq") / F.greatest(F.col("_sn"), F.lit(1)),
        "sentence_initial_conjunction_rate": F.col("_sc") / F.greatest(F.col("_sn"), F.lit(1)), "one_sentence_paragraph_rate": F.col("_p1") / F.greatest(F.col("_pn"), F.lit(1)),
        # delimiters are doubled, so that one match never takes the next one's
        "passive_voice_proxy": rate(F.regexp_count("_wide", F.lit(r"(?:^|[^\p{L}\p{N}_])(?:is|are|was|were|been|be)\s+[\p{L}\p{N}_]+ed(?:[^\p{L}\p{N}_]|\z)"))),
        "capitalized_word_rate": rate(F.size(F.filter("_runs", lambda w: w.rlike("^[A-Z][a-z]+$")))), "uppercase_word_rate": rate(F.size(F.filter("_runs", lambda w: w.rlike("^[A-Z][A-Z]+$")))),
        "heading_rate": rate(F.col("_heads")), "list_rate": rate(F.col("_lists")), "quote_paragraph_rate": rate(F.col("_quotes")),
    }
    m |= {name: rate(count(ws)) for name, ws in (PRONOUNS | DISCOURSE).items()}
    m |= {f"function_{w}_rate": rate(count([w])) for w in FUNCTION_WORDS}
    m |= {f"{p}_rate": rate(literal(ch)) for p, ch in PUNCTUATION.items()}
    m |= {f"word_length_{a}_{b}_fraction": within(a, b) for a, b in LENGTH_BINS}
    return step.select(*keep, *(m[name].cast("double").alias(name) for name in NAMES))


_S = r"[\t\n\f\r ]"  # white space as both SQL engines see it
_WORD, _RUN, _HAS = re.compile(r"\w+(?:['’]\w+)*"), re.compile(r"\w+"), re.compile(r"\w")
_PROTECT = re.compile(r"(^|\W)(" + "|".join(T.ABBREVIATIONS) + r")\.")
_END = re.compile(rf"""([.!?]+["'’”)]*)({_S}|\Z)""")
_BLANK, _NONBLANK = re.compile(rf"\n{_S}*\n"), re.compile(r"[^\t\n\f\r ]")
_QUESTION, _CONJUNCTION, _PAREN = re.compile(r"\?[\"')”’]*\Z"), re.compile(r"(?:and|but|so|or)(?:\W|\Z)", re.I), re.compile(r"\([^)]*\)")
_PASSIVE = re.compile(rf"(?<!\w)(?:is|are|was|were|been|be){_S}+\w+ed(?!\w)")
_CAPITAL, _UPPER = re.compile(r"[A-Z][a-z]+"), re.compile(r"[A-Z][A-Z]+")
_HEADING, _LIST, _QUOTE = re.compile(rf"(?m)^{_S}{{0,3}}#{{1,6}}{_S}+"), re.compile(rf"(?m)^{_S}*(?:[-*+]|[0-9]+[.)]){_S}+"), re.compile(rf"(?m)^{_S}*>")
_GROUPS = [(name, frozenset(ws)) for name, ws in (PRONOUNS | DISCOURSE).items()]
_TRIM = "\t\n\f\r \x0b"


def _sentences(text: str) -> list[str]:
    t = _BLANK.sub("\x01", _END.sub("\\1\x01\\2", _PROTECT.sub("\\1\\2\x02", text)))
    return [s.replace("\x02", ".").strip(_TRIM) for s in t.split("\x01") if _HAS.search(s)]


def _spread(a: list[float]) -> tuple[float, float, float, float]:
    """Mean, median, population deviation and skew (with a divisor of one deviation, at least 1); an empty list counts as a single 0."""
    a = sorted(a) or [0.0]
    n = len(a)
    mean = sum(a) / n
    std = sqrt(sum((x - mean) ** 2 for x in a) / n)
    return mean, (a[(n - 1) // 2] + a[n // 2]) / 2, std, sum((x - mean) ** 3 for x in a) / n / max(std, 1.0) ** 3


def measures_of(text: str | None, structure: str | None = None) -> list[float]:
    """The measures of one text, in the order of NAMES."""
    t = text or ""
    src = t if structure is None else structure
    words = _WORD.findall(t.lower())
    counts = Counter(words)
    k = len(words)
    n = float(max(k, 1))
    sentences = _sentences(t)
    paragraphs = [p for p in _BLANK.split(t) if _NONBLANK.search(p)]
    lengths = Counter(map(len, words)) or Counter({0: 1})
    total = sum(lengths.values())
    mean_length = sum(a * c for a, c in lengths.items()) / total
    runs = _RUN.findall(t)
    s, p = _spread([float(len(_WORD.findall(x))) for x in sentences]), _spread([float(len(_WORD.findall(x))) for x in paragraphs])
    share = lambda lo, hi: sum(c for a, c in lengths.items() if lo <= a <= hi) / total
    rate = lambda x: 1000.0 * x / n
    out = {
        "sentence_length_mean": s[0], "sentence_length_median": s[1], "sentence_length_std": s[2], "sentence_length_skew": s[3], "sentences_per_paragraph": len(sentences) / max(len(paragraphs), 1),
        "paragraph_length_mean": p[0], "paragraph_length_median": p[1], "paragraph_length_std": p[2],
        "one_sentence_paragraph_rate": (1 if len(sentences) == 1 else 0) if len(paragraphs) == 1 else sum(len(_sentences(x)) == 1 for x in paragraphs) / max(len(paragraphs), 1),
        "word_length_mean": mean_length, "word_length_std": sqrt(sum(c * (a - mean_length) ** 2 for a, c in lengths.items()) / total), "type_token_ratio": len(counts) / n, "root_type_token_ratio": len(counts) / sqrt(n),
        "hapax_rate": sum(c == 1 for c in counts.values()) / n, "short_word_rate": share(0, 3), "long_word_rate": share(8, 1 << 40), "lexical_density_proxy": 1.0 - sum(counts[w] for w in FUNCTION_WORDS) / n,
        "contraction_rate": rate(sum(c for w, c in counts.items() if "'" in w or "’" in w)), "parenthetical_rate": rate(len(_PAREN.findall(t))),
        "question_sentence_rate": sum(_QUESTION.search(x) is not None for x in sentences) / max(len(sentences), 1), "sentence_initial_conjunction_rate": sum(_CONJUNCTION.match(x) is not None for x in sentences) / max(len(sentences), 1),
        "passive_voice_proxy": rate(len(_PASSIVE.findall(t.lower()))), "capitalized_word_rate": rate(sum(_CAPITAL.fullmatch(x) is not None for x in runs)), "uppercase_word_rate": rate(sum(_UPPER.fullmatch(x) is not None for x in runs)),
        "heading_rate": rate(len(_HEADING.findall(src))), "list_rate": rate(len(_LIST.findall(src))), "quote_paragraph_rate": rate(len(_QUOTE.findall(src))),
    }
    out |= {name: rate(sum(counts[w] for w in ws)) for name, ws in _GROUPS}
    out |= {f"function_{w}_rate": rate(counts[w]) for w in FUNCTION_WORDS}
    out |= {f"{name}_rate": rate(t.count(ch)) for name, ch in PUNCTUATION.items()}
    out |= {f"word_length_{a}_{b}_fraction": share(a, b) for a, b in LENGTH_BINS}
    return [float(out[name]) for name in NAMES]


def measured(df: DataFrame, text: str = "text", structure: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns and the 95 measures of `text`; `structure` holds the marked-up source where headings, lists and quotes are counted. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_t").to_pylist()
            sources = b.column("_src").to_pylist() if structure else [None] * len(texts)
            rows = [measures_of(t, s) for t, s in zip(texts, sources)]
            cols = list(zip(*rows)) if rows else [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.float64()) for c in cols)], names=[*keep, *NAMES])

    kinds = dict(df.dtypes)
    own = df.select(*keep, F.col(text).alias("_t"), *([F.coalesce(F.col(structure), F.col(text), F.lit("")).alias("_src")] if structure else []))
    return own.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{n} double" for n in NAMES)]))


def long_form(df: DataFrame, keep: tuple[str, ...], names: list[str] | None = None) -> DataFrame:
    """(keep, feature, value): one row per measure."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names or NAMES))
    return df.select(*keep, F.explode(pairs).alias("m")).select(*keep, "m.feature", "m.value")
