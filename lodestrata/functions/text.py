"""Scalar text functions as columns: normalisation, tokens, answers, labels, provenance headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of answer normalisation.
ARTICLES = ("a", "an", "the")
#: Words that overlap measures leave out, unless a caller gives others; the articles, prepositions and auxiliaries of Spark's English list.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay, so that results don't depend on the engine's case tables."""
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(beyond) == beyond, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def tokens(text: Column) -> Column:
    """Lower-case words between ASCII white space; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+", -1), ""), F.array().cast("array<string>"))


def word_tokens(text: Column, least: int = 1) -> Column:
    """Runs of at least `least` ASCII letters, digits and underscores, in lower case."""
    parts = F.split(ascii_lower(text), r"[^a-z0-9_]+", -1)
    return F.coalesce(F.filter(parts, lambda w: F.length(w) >= least), F.array().cast("array<string>"))


def answer_tokens(text: Column) -> Column:
    """Tokens of a normalised answer: lower case, no ASCII punctuation, no articles."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+", -1), lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def substring_match(prediction: Column, gold: Column) -> Column:
    return F.contains(normalize_answer(prediction), normalize_answer(gold)).cast("double")


#: Answers that match nothing but themselves.
SPECIAL_ANSWERS = ("yes", "no", "noanswer")


def special_mismatch(prediction: Column, gold: Column) -> Column:
    """Whether either normalised answer is a special one and the other is not the same."""
    return (prediction.isin(*SPECIAL_ANSWERS) | gold.isin(*SPECIAL_ANSWERS)) & (prediction != gold)


def token_f1(common: Column, n_prediction: Column, n_gold: Column) -> Column:
    """F1 of multiset overlap; 0 where nothing is common."""
    precision, recall = common / n_prediction, common / n_gold
    return F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, both / union).otherwise(0.0)


def keyword_overlap(a: Column, b: Column) -> Column:
    """Common distinct keywords over the larger set."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? and white space, trimmed and not empty."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[\x20\x09-\x0D]+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda s: s != "")


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def provenance_header(*parts: Column) -> Column:
    """`[source_id: a:b]` in front of a stored text."""
    return F.concat(F.lit("[source_id: "), F.concat_ws(":", *(p.cast("string") for p in parts)), F.lit("]"))


def header_id(stored: Column) -> Column:
    """The id of a text's provenance header; null without one."""
    found = F.regexp_extract(stored, r"^\[source_id: ([^\]]*)\]", 1)
    return F.when(found != "", found)


def without_header(stored: Column) -> Column:
    return F.regexp_replace(stored, r"^\[source_id: [^\]]*\]\n?", "")


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles or tags; five named entities; white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return F.regexp_replace(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), r"^ | $", "")


def stored_id(prefix: str, text: Column) -> Column:
    """Content hash id of a text within a namespace."""
    return F.concat(F.lit(f"{prefix}-"), F.md5(F.coalesce(text, F.lit(""))))
