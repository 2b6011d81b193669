"""Tokenizing and stemming, as Spark columns for data and in Python for query strings.

A text is lower-cased, split at everything that is neither a letter nor a number, and cleared of
one-byte pieces and stop words; what is left is stemmed. The stemmer is a sequence of suffix
rules in which the first rule whose suffix matches ends its step, applied or not; stems are not
stable under a second stemming, and nothing relies on that.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "it", "as", "was", "are", "were",
    "been", "be", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "we", "they",
    "me", "him", "her", "us", "them", "my", "your", "his", "its", "our",
    "their", "what", "which", "who", "whom", "not", "no", "nor", "if",
    "then", "than", "so", "just", "about", "into", "through", "during",
    "before", "after", "above", "below", "between", "same", "such",
)

# The suffix rules of steps 2 and 3, and the suffixes that step 4 removes, in order.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"
_SPLIT = regex.compile(r"[^\p{Alphabetic}\p{N}]+")
_STOP = frozenset(STOP_WORDS)
_CVC = regex.compile(r"[^aeiou][aeiou][^aeiouwxy]$")
_DOUBLE = regex.compile(r"([^aeiou])\1$")
_VOWEL = regex.compile(r"[aeiou]")
_MEASURE = regex.compile(r"[aeiou][^aeiou]")


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(_MEASURE.findall(word))


def _mend(word: str) -> str:
    """After -ed or -ing is gone."""
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _DOUBLE.search(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if measure(word) == 1 and _CVC.search(word) else word


def _suffix(word: str, suffixes) -> str | None:
    return next((s for s in suffixes if word.endswith(s)), None)


def stem_word(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word.encode()) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and _VOWEL.search(word[:-2]):
        word = _mend(word[:-2])
    elif word.endswith("ing") and _VOWEL.search(word[:-3]):
        word = _mend(word[:-3])
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = _suffix(word, rules)
        if s and measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + rules[s]
    s = _suffix(word, STEP4)
    if s and measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _CVC.search(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def raw_words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text.lower()) if len(w.encode()) > 1]


def tokenize_text(text: str) -> list[str]:
    """Terms of one string, for queries."""
    return [stem_word(w) for w in raw_words(text) if w not in _STOP]


def words_column(text: Column) -> Column:
    """Lower-case pieces of more than one byte, stop words included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: F.octet_length(w) > 1)


def kept_words_column(text: Column) -> Column:
    """The words that are indexed, before stemming; a word's place here is its position."""
    return F.filter(words_column(text), lambda w: ~w.isin(*STOP_WORDS))


def _less(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _m(word: Column) -> Column:
    return F.regexp_count(word, F.lit("[aeiou][^aeiou]"))


def _has_vowel(word: Column) -> Column:
    return word.rlike("[aeiou]")


def _cvc(word: Column) -> Column:
    return word.rlike("[^aeiou][aeiou][^aeiouwxy]$")


def with_stem(frame: DataFrame, word: str = "word", out: str = "term") -> DataFrame:
    """Add the stem of a column of lower-case words.

    Each step is a projection of its own, so that a step's result is computed once; a regular
    expression takes the place of trying suffixes one by one, as its lazy prefix finds the longest
    suffix, which is the first of the ordered rules.
    """
    w = F.col("_w")
    frame = frame.withColumn(
        "_w",
        F.when(F.octet_length(word) <= 2, F.col(word)).when(F.col(word).endswith("sses") | F.col(word).endswith("ies"), _less(F.col(word), 2))
        .when(F.col(word).endswith("s") & ~F.col(word).endswith("ss"), _less(F.col(word), 1)).otherwise(F.col(word)),
    )
    cut = (
        F.when(w.endswith("eed"), F.lit(None).cast("string"))
        .when(w.endswith("ed") & _has_vowel(_less(w, 2)), _less(w, 2))
        .when(w.endswith("ing") & _has_vowel(_less(w, 3)), _less(w, 3))
    )
    frame = frame.withColumn("_cut", cut)
    c = F.col("_cut")
    mended = (
        F.when(c.rlike("(at|bl|iz)$"), F.concat(c, F.lit("e")))
        .when(c.rlike(r"([^aeiou])\1$") & ~c.rlike("[lsz]$"), _less(c, 1))
        .when((_m(c) == 1) & _cvc(c), F.concat(c, F.lit("e")))
        .otherwise(c)
    )
    eed = F.when(w.endswith("eed") & (_m(_less(w, 3)) > 0), _less(w, 1))
    frame = frame.withColumn("_w", F.coalesce(F.when(c.isNotNull(), mended), eed, w))
    frame = frame.withColumn("_w", F.when(w.endswith("y") & _has_vowel(_less(w, 1)), F.concat(_less(w, 1), F.lit("i"))).otherwise(w))
    s = F.col("_s")
    head = F.substring(w, F.lit(1), F.length(w) - F.length(s))
    for rules in (STEP2, STEP3):
        frame = frame.withColumn("_s", F.regexp_extract(w, f"({'|'.join(rules)})$", 1))
        swap = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
        frame = frame.withColumn("_w", F.when((s != "") & (_m(head) > 0), F.concat(head, F.element_at(swap, s))).otherwise(w))
    frame = frame.withColumn("_s", F.regexp_extract(w, f"({'|'.join(STEP4)})$", 1))
    frame = frame.withColumn("_w", F.when((s != "") & (_m(head) > 1) & ((s != "ion") | head.rlike("[st]$")), head).otherwise(w))
    last = _less(w, 1)
    frame = frame.withColumn("_w", F.when(w.endswith("e") & ((_m(last) > 1) | ((_m(last) == 1) & ~_cvc(last))), last).otherwise(w))
    frame = frame.withColumn("_w", F.when(w.endswith("ll") & (_m(last) > 1), last).otherwise(w))
    stem = F.when(F.octet_length(word) <= 2, F.col(word)).otherwise(w)
    # Exploding a single value ends the optimizer's view of a stem's origin. It would else copy filters
    # and join keys on stems down through the steps, each of which has the one before in many places.
    return frame.withColumn(out, F.explode(F.array(stem))).drop("_w", "_cut", "_s")


DELETIONS = "variant bigint, term string"
MOST_DELETED = 2


def deletions(rows: DataFrame, column: str) -> DataFrame:
    """rows once for each hash ("variant") of what is left of a word when up to MOST_DELETED characters are deleted.

    Words within that many edits, swaps of neighbours among them, have a variant in common.
    """
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    some = lambda w: F.when(F.length(w) > 0, less(w)).otherwise(F.array().cast("array<string>"))
    held = rows.withColumn("_0", F.array(F.col(column)))
    for n in range(MOST_DELETED):
        held = held.withColumn(f"_{n + 1}", F.array_distinct(F.flatten(F.transform(f"_{n}", some))))
    known = F.concat(*[f"_{n}" for n in range(MOST_DELETED + 1)])
    return held.select(F.explode(F.array_distinct(F.transform(known, lambda w: F.xxhash64(w)))).alias("variant"), *rows.columns)
