"""Words, sentences and paragraphs as column expressions, in which no Python runs; cleaning in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import cleaning

#: A word is a run of letters, digits and underscores with inner apostrophes. Spelled out, as \w differs between engines.
WORD = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"
# ---- fixed values: abbreviations whose full stop ends no sentence ----
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "St", "vs", "etc", r"e\.g", r"i\.e")
# ---- end of fixed values ----
PROTECT = r"(^|[^\p{L}\p{N}_])(" + "|".join(ABBREVIATIONS) + r")\."
SENTENCE_END = r"""([.!?]+["'’”)]*)(\s|\z)"""
BLANK_LINE = r"\n\s*\n"


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null stays null."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def marked(text: Column) -> Column:
    """The text with the full stops of abbreviations masked (U+0002) and sentence ends marked (U+0001), length-preserving but for the marks."""
    t = F.regexp_replace(text, PROTECT, "$1$2\u0002")
    t = F.regexp_replace(t, SENTENCE_END, "$1\u0001$2")
    return F.regexp_replace(t, r"(\n\s*\n)", "\u0001$1")


def sentences(text: Column) -> Column:
    """Array of sentences that hold a word, trimmed, abbreviations restored."""
    parts = F.transform(F.split(marked(text), "\u0001"), lambda p: F.regexp_replace(F.regexp_replace(p, "\u0002", "."), r"^\s+|\s+\z", ""))
    return F.filter(parts, lambda p: p.rlike(r"[\p{L}\p{N}_]"))


def sentence_spans(text: Column) -> Column:
    """Array of (text, start_char, end_char, index): sentences with exact places in code points from 0, ends exclusive."""
    raw = F.split(F.regexp_replace(marked(text), "\u0002", "."), "\u0001")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start_char:int,end_char:int>>").alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        lead = F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
        body = F.regexp_replace(piece, r"^\s+|\s+\z", "")
        start = acc["at"] + lead
        one = F.array(F.struct(body.alias("text"), start.alias("start_char"), (start + F.length(body)).alias("end_char")))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.when(body.rlike(r"[\p{L}\p{N}_]"), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(raw, zero, add)["out"]
    return F.transform(spans, lambda s, i: F.struct(s["text"].alias("text"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), i.alias("index")))


def paragraphs(text: Column) -> Column:
    """Array of non-blank paragraphs."""
    return F.filter(F.split(text, BLANK_LINE), lambda p: p.rlike(r"\S"))


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def shingles(text: Column, size: int = 12) -> Column:
    """Array of the distinct runs of `size` consecutive lower-cased words, joined by spaces."""
    w = words(F.lower(text))
    n = F.size(w)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " ")))).otherwise(F.array().cast("array<string>"))


def prose_markup(raw: Column) -> Column:
    """Markdown without what isn't prose: front matter, code, liquid and HTML tags, navigation, images, links' targets; entities are resolved. Null stays null."""
    return cleaning.markup_column(raw)


def clean_markdown(raw: Column) -> Column:
    """Plain prose of Markdown: `prose_markup` without heading, quote, list and emphasis marks and surplus white space."""
    return cleaning.markdown_column(raw)


def clean_email(raw: Column, author: Column | None = None) -> Column:
    """A message's own lines."""
    return cleaning.email_column(raw, author)


def clean_foreign_email(raw: Column, author: Column | None = None) -> Column:
    """`clean_email` for mail of mixed origin."""
    return cleaning.foreign_email_column(raw, author)


def source_text(path: Column, raw: Column) -> Column:
    """The prose of a file by its suffix: `.txt` is mail, all else Markdown."""
    return F.when(F.lower(path).endswith(".txt"), clean_email(raw)).otherwise(clean_markdown(raw))


def structure(raw: Column, clean: Column, is_mail: Column) -> Column:
    """Where headings, lists and quotes are counted: the clean text of a mail, else the marked-up source."""
    return F.when(is_mail, clean).otherwise(raw)


def remove_math(text: Column) -> Column:
    """Without $$…$$, \\[…\\], \\(…\\) and $…$."""
    return F.regexp_replace(text, r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+\$", "")
