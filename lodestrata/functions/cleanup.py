"""Text cleaning as columns: normal forms for matching, anchors, cuts, summaries, keys and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.scoring import collapsed

#: Marks that stand for others when texts are matched, character by character.
FANCY, PLAIN = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "
#: Names of question categories by number.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}


def matching_form(text: Column) -> Column:
    """Plain quotes and dashes, lower case, white space collapsed, none in front of punctuation."""
    return F.regexp_replace(collapsed(T.ascii_lower(F.translate(text, FANCY, PLAIN))), r"[\x20]+([,.;:!?])", "$1")


def anchors(words: Column, size: int, least: int = 24) -> Column:
    """Up to five runs of `size` words, at the start, each quarter and the end, at least `least` characters long; a shorter text is its own anchor."""
    last = F.size(words) - size
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda q: F.floor(last * q / 4).cast("int")))
    runs = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))
    whole = F.array(F.array_join(words, " "))
    return F.array_distinct(F.filter(F.when(last > 0, runs).otherwise(whole), lambda a: F.length(a) >= least))


def cut(words: Column, most: int, strategy: str = "head") -> Column:
    """At most `most` tokens of an array: its head, its tail, or half of each."""
    n, half = F.size(words), most // 2
    tail = F.slice(words, F.greatest(n - most + 1, F.lit(1)), most)
    if strategy == "head":
        return F.slice(words, 1, most)
    if strategy == "tail":
        return tail
    if strategy == "head_tail":
        return F.when(n <= most, words).otherwise(F.concat(F.slice(words, 1, half), F.slice(words, n - (most - half) + 1, most - half)))
    raise ValueError(f"unknown strategy {strategy!r}")


def summary(text: Column, most: int) -> Column:
    """A text that fits, else its start up to the last end of a sentence in the second half of what fits, else cut with dots."""
    plain = collapsed(text)
    head = F.substring(plain, 1, most)
    stop = F.length(head) - F.instr(F.reverse(head), " .")  # the place of the last full stop that a space follows
    has = (F.instr(head, ". ") > 0) & (stop >= most // 2)
    return F.when(F.length(plain) <= most, plain).when(has, F.substring(head, F.lit(1), stop)).otherwise(F.concat(F.regexp_replace(head, r"[\x20]+$", ""), F.lit("...")))


def stored_form(text: Column) -> Column:
    """Without a provenance header, new lines of one kind and at most two in a row, no white space at the edges."""
    lines = F.regexp_replace(T.without_header(text), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def triple_form(text: Column) -> Column:
    """Lower case, everything but letters, digits and spaces as a space, trimmed."""
    return F.trim(F.regexp_replace(T.ascii_lower(text), "[^a-z0-9 ]", " "))


def key_form(name: Column) -> Column:
    """A name as a key: no characters but word characters and white space, which becomes an underscore."""
    return T.ascii_lower(F.regexp_replace(F.trim(F.regexp_replace(name, r"[^A-Za-z0-9_\x20\x09-\x0D]", "")), r"[\x20\x09-\x0D]+", "_"))


def slug(name: Column) -> Column:
    """Safe in a file name: runs of other characters than letters, digits, dots, dashes and underscores become a dash."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def category_name(number: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.concat(F.lit("category-"), number.cast("string")))


def ngrams(text: Column, n: int = 2) -> Column:
    """Distinct runs of n characters; none of a shorter text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def dice(a: Column, b: Column) -> Column:
    """Twice the common elements over both sets' sizes; 0 where both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def char_tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' character counts, where characters that only one of them has weigh 1.5; 0 for an empty text."""
    x, y = F.array_remove(F.split(a, ""), ""), F.array_remove(F.split(b, ""), "")
    n = lambda xs, c: F.size(F.filter(xs, lambda z: z == c)).cast("double")
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, c: acc + f(c))
    shared = F.array_intersect(x, y)
    square = lambda own, other: total(shared, lambda c: n(own, c) * n(own, c)) + total(F.array_except(own, other), lambda c: n(own, c) * n(own, c) * 2.25)
    length = F.sqrt(square(x, y) * square(y, x))
    return F.when(length > 0, total(shared, lambda c: n(x, c) * n(y, c)) / length).otherwise(0.0)


def change_ratio(old: Column, new: Column) -> Column:
    """1 - Jaccard of the sets of characters."""
    return 1 - T.set_jaccard(F.array_distinct(F.split(old, "")), F.array_distinct(F.split(new, "")))


#: Fixed values of the update rule: the range of Han characters, weights of a Han character, of a word and of any other character.
HAN, TOKENS_A_HAN, TOKENS_A_WORD, TOKENS_A_CHARACTER = r"[\x{4E00}-\x{9FFF}]", 1.5, 1.33, 0.5


def estimated_tokens(text: Column) -> Column:
    """A text's tokens by its Han characters, its words without any that have a letter, and its other characters; 0 for an empty text, else 1 at least."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}") & ~w.rlike(HAN))
    rest = F.length(F.regexp_replace(text, HAN, ""))
    n = (F.length(text) - rest) * TOKENS_A_HAN + F.size(words) * TOKENS_A_WORD + rest * TOKENS_A_CHARACTER
    return F.when(F.length(text) > 0, F.greatest(F.floor(n), F.lit(1))).otherwise(0).cast("long")


def long_enough(text: Column, least: int = 20) -> Column:
    """Whether a text has at least so many characters; null has none."""
    return F.coalesce(F.length(text) >= least, F.lit(False))


def keep_update(new: Column, old: Column, short: int = 200, small_text: float = 0.7, large_text: float = 0.2) -> Column:
    """Whether a new text replaces an old one: its set of characters differs, and by less than small_text, or large_text where the old one has `short` tokens or more.

    Null counts as an empty text; two empty texts do not differ.
    """
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    ratio = F.when((old == "") & (new == ""), 0.0).otherwise(change_ratio(old, new))
    return (ratio > 0) & (ratio < F.when(estimated_tokens(old) < short, small_text).otherwise(large_text))
