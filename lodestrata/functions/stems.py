"""English word stems by Porter's rules of 1980, as an Arrow function over arrays of words."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published endings of steps 2 to 4 with what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def _form(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _form(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str], least: int) -> str:
    """The longest of the endings that the word has is replaced, if what stands before it measures `least`."""
    for size in range(min(7, len(word) - 1), 1, -1):
        end = word[-size:]
        if end in endings:
            rest = word[:-size]
            if end == "ion" and rest[-1:] not in ("s", "t"):
                return word
            return rest + endings[end] if _measure(rest) >= least else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            rest = word[: -len(end)]
            if word.endswith(end):
                if "v" in _form(rest):
                    if rest.endswith(("at", "bl", "iz")) or (_measure(rest) == 1 and _short_end(rest) and not _doubled(rest)):
                        word = rest + "e"
                    else:
                        word = rest[:-1] if _doubled(rest) and rest[-1] not in "lsz" else rest
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(_replaced(word, STEP_2, 1), STEP_3, 1), STEP_4, 2)
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or (m == 1 and not _short_end(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stems(words: Column) -> Column:
    """The stems of an array of words, in its order; null for null."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        names = pa.array([w if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
        lengths = lists.value_lengths().to_pylist()
        offsets, at = [], 0
        for n in lengths:
            offsets.append(None if n is None else at)
            at += n or 0
        return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), names.take(flat.indices))

    return run(words)


def keywords(text: Column, stop: tuple[str, ...]) -> Column:
    """The words that a stemmed search takes: runs of two or more letters in lower case that aren't stop words, as stems; of a text with Han characters, all pairs of neighbours in runs of them, unstemmed, and its other words."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}&&[^\p{IsHan}]]{2,}"), F.lit(0))
    kept = F.filter(plain, lambda w: ~w.isin(*stop)) if stop else plain
    runs = F.regexp_extract_all(text, F.lit(r"\p{IsHan}+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substr(r, k, F.lit(2))))))
    return F.coalesce(F.concat(stems(kept), pairs), F.array().cast("array<string>"))
