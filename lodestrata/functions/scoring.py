"""Scoring of model outputs as columns: extraction of answers, options and labels, and metrics against gold answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import text as T

#: The labels that a judge gives, in the order in which they are looked for, and which of them mean yes.
JUDGE_LABELS = ("CORRECT", "WRONG", "YES", "NO")
JUDGE_TRUE = ("CORRECT", "YES")
#: Fixed patterns of answers to multiple-choice questions: the option alone, after a cue, or in front.
OPTION_PATTERNS = (r"^[\x20\x09-\x0D]*\(?([A-D])\)?[.]?[\x20\x09-\x0D]*$", r"(?i:answer)[\x20]*(?:is|:)[\x20]*\(?([A-D])(?:[^A-Za-z0-9_]|$)", r"^[\x20\x09-\x0D]*\(?([A-D])[).:]")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match; null where it doesn't match or the group is empty."""
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def first_line(text: Column) -> Column:
    return trimmed(F.substring_index(text, "\n", 1))


def parsed_output(text: Column, prefix: str = "answer:") -> Column:
    """What follows the prefix (in any case) up to the end of its line, without repeats of it; else the first line."""
    after = F.regexp_extract(text, rf"(?i){prefix}([^\n]*)", 1)
    again = trimmed(F.regexp_replace(after, rf"(?i){prefix}", ""))
    return F.when(text.rlike(rf"(?i){prefix}"), again).otherwise(first_line(text))


def answer_span(text: Column) -> Column:
    """What follows `(the) (final) answer is` at the start of a one-line text; null elsewhere."""
    return found(text, r"^(?i:(?:the )?(?:final )?answer is):?[\x20]*([^\n]*)$")


def label_prediction(text: Column) -> Column:
    """The number of the first `label: n`, else the number that is the whole text; null without either."""
    return F.coalesce(found(text, r"(?i:label):[\x20]*([0-9]+)"), found(text, r"^[\x20\x09-\x0D]*([0-9]+)[\x20\x09-\x0D]*$")).try_cast("long")


def first_sentence(text: Column) -> Column:
    """The text up to a new line, or up to an end of a sentence that white space follows."""
    marked = F.regexp_replace(text, "([.!?。！？])[\\x20\\x09-\\x0D]+|\n+", "$1\u0001")
    return trimmed(F.substring_index(marked, "\u0001", 1))


def option_prediction(text: Column) -> Column:
    """A to D by the first pattern that matches; null without any."""
    return F.coalesce(*(found(text, p) for p in OPTION_PATTERNS))


def choice_text(text: Column) -> Column:
    """Lower case, white space collapsed, punctuation at the edges gone."""
    return F.regexp_replace(collapsed(T.ascii_lower(text)), r"^[!-/:-@\[-`{-~\x20]+|[!-/:-@\[-`{-~\x20]+$", "")


def choice_tokens(text: Column) -> Column:
    return F.array_remove(F.split(T.ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def multiset_common(a: Column, b: Column) -> Column:
    """How many elements two arrays share, repeats counted as often as both have them."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def f1_of_tokens(a: Column, b: Column) -> Column:
    common = multiset_common(a, b)
    return F.when(common > 0, 2 * common / (F.size(a) + F.size(b))).otherwise(0.0)


def answer_f1(prediction: Column, gold: Column) -> Column:
    """Token F1 of normalised answers; special answers match nothing but themselves."""
    p, g = T.answer_tokens(prediction), T.answer_tokens(gold)
    return F.when(T.special_mismatch(F.array_join(p, " "), F.array_join(g, " ")), 0.0).otherwise(f1_of_tokens(p, g))


def _lcs(a, b) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one integer."""
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    row, all_bits = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & all_bits
    return len(b) - row.bit_count()


def _lcs_of_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else _lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of words; 0 for null."""
    return F.pandas_udf(_lcs_of_batch, "long")(a, b)


def rouge_l(common: Column, n_prediction: Column, n_gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F of a common subsequence; 0 where nothing is common."""
    p, r = (F.when(common > 0, common / n).otherwise(0.0) for n in (n_prediction, n_gold))
    return p, r, F.when(common > 0, 2 * p * r / (p + r)).otherwise(0.0)


def judge_label(response: Column) -> Column:
    """The label field of a JSON object in the response, else the first of CORRECT, WRONG, YES, NO that its upper case holds, in that order.

    INCORRECT so reads as CORRECT, as the contract of the labels has it.
    """
    told = F.upper(F.get_json_object(json_object(response), "$.label"))
    upper = F.upper(response)
    seen = F.coalesce(*(F.when(F.contains(upper, F.lit(x)), x) for x in JUDGE_LABELS))
    return F.when(told.isin(*JUDGE_LABELS), told).otherwise(seen)


def judge_bool(label: Column) -> Column:
    return F.when(label.isin(*JUDGE_TRUE), True).when(label.isin(*JUDGE_LABELS), False)


def json_object(text: Column) -> Column:
    """From the first { to the last } of a text, fences and all else around it gone; null without both."""
    return found(text, r"(?s)(\{.*\})")


def contained_share(prediction: Column, golds: Column) -> Column:
    """The share of the gold elements that the prediction holds, in any case."""
    low = T.ascii_lower(prediction)
    return F.when(F.size(golds) > 0, F.size(F.filter(golds, lambda g: F.contains(low, T.ascii_lower(g)))) / F.size(golds)).otherwise(0.0)


def choice_of_text(prediction: Column, choices: Column) -> Column:
    """Which of an array of choices (from 0) a text names; null where none is sure, and for null and blank texts.

    It is the choice of the same text, else the only one that begins with the text or that the text begins with, else the one with the best F1 of distinct words (0.15 more where one
    holds the other), if that is 0.55 at least and 0.08 ahead of the next. Texts of under 24 characters and three words must be the same. Null and blank choices are left out.
    """
    listed = F.filter(F.transform(choices, lambda c, i: F.struct(i.alias("i"), choice_text(c).alias("c"))), lambda e: e["c"] != "")
    each = F.transform(listed, lambda e: F.struct(e["i"].alias("i"), e["c"].alias("c"), F.array_distinct(choice_tokens(e["c"])).alias("w")))
    p = choice_text(prediction)
    whole = F.struct(p.alias("p"), choice_tokens(p).alias("t"), each.alias("each"))

    def chosen(x: Column) -> Column:
        p, w, each = x["p"], F.array_distinct(x["t"]), x["each"]
        same = F.filter(each, lambda e: e["c"] == p)
        begun = F.filter(each, lambda e: F.startswith(e["c"], p) | F.startswith(p, e["c"]))
        common = lambda e: F.size(F.array_intersect(e["w"], w))
        f1 = lambda e: 2 * common(e) / (F.size(e["w"]) + F.size(w)) + F.when(F.contains(e["c"], p) | F.contains(p, e["c"]), 0.15).otherwise(0.0)
        scores = F.transform(each, lambda e: F.struct(F.when(common(e) > 0, F.round(f1(e), 9)).otherwise(0.0).alias("score"), (-e["i"]).alias("i")))
        best = F.get(F.sort_array(scores, False), F.lit(0))
        second = F.coalesce(F.get(F.sort_array(scores, False), F.lit(1))["score"], F.lit(0.0))
        long = (F.length(p) >= 24) | (F.size(x["t"]) >= 3)
        return (
            F.when(p == "", None).when(F.size(same) > 0, F.get(same, F.lit(0))["i"]).when(long & (F.size(begun) == 1), F.get(begun, F.lit(0))["i"])
            .when(long & (best["score"] >= 0.55) & (F.round(best["score"] - second, 9) >= 0.08), -best["i"])
        )

    # an array of one: what the choice reads is then computed once
    return F.get(F.transform(F.array(whole), chosen), F.lit(0)).cast("long")


def option_chain(output: Column, choices: Column) -> Column:
    """A to D: the option that the output names, or what is parsed from it, or its first or its last line, else the choice whose text the output or its parsed form gives; null without any."""
    parsed, lines = parsed_output(output), T.lines(output)
    letter = lambda n: F.when(n.isNotNull(), F.substring(F.lit("ABCD"), (n + 1).cast("int"), F.lit(1)))
    named = [option_prediction(x) for x in (output, parsed, F.get(lines, F.lit(0)), F.try_element_at(lines, F.lit(-1)))]
    return F.coalesce(*named, letter(choice_of_text(output, choices)), letter(choice_of_text(parsed, choices)))
