"""English stemming (the public Porter2 algorithm), applied to distinct words only.

Spark has no stemmer. A vocabulary is small next to its corpus, so distinct words are
stemmed once in Arrow batches and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm.
VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = frozenset("cdeghkmnrt")
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), after(0))
    return r1, after(r1)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS and word[-1] not in "wxY"


def _vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    word = word.removeprefix("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word.startswith("y"):
        word = "Y" + word[1:]
    word = "".join("Y" if c == "y" and i and word[i - 1] in VOWELS else c for i, c in enumerate(word))
    r1, r2 = _regions(word)

    for end in ("'s'", "'s", "'"):  # step 0
        if word.endswith(end):
            word = word[: -len(end)]
            break

    if word.endswith("sses"):  # step 1a
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _vowel(word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word

    if word.endswith(("eedly", "eed")):  # step 1b
        end = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), "")
        if end and _vowel(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif len(word) <= r1 and _short_end(word):
                word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:  # step 1c
        word = word[:-1] + "i"

    for end, new in STEP_2:
        if word.endswith(end):
            stay = word[: -len(end)]
            if len(stay) >= r1 and not (end == "ogi" and not stay.endswith("l")) and not (end == "li" and stay[-1:] not in LI):
                word = stay + new
            break
    for end, new in STEP_3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + new
            break
    for end in STEP_4:
        if word.endswith(end):
            stay = word[: -len(end)]
            if len(stay) >= r2 and (end != "ion" or stay.endswith(("s", "t"))):
                word = stay
            break

    if word.endswith("e"):  # step 5
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def _stem(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0)
        yield pa.RecordBatch.from_arrays([words, pa.array([stem(w) for w in words.to_pylist()], pa.string())], names=["term", "stem"])


def vocabulary_stems(words: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct words."""
    return words.select(F.col(column).alias("term")).where(F.col("term").isNotNull()).distinct().mapInArrow(_stem, "term string, stem string")


def stemmed_texts(texts: DataFrame, tokens, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, text) with every token replaced by its stem, for search over stems. Counts
    per text and token cross the network, not occurrences."""
    counted = texts.select(F.col(id_), F.explode(tokens(F.col(text))).alias("term")).groupBy(id_, "term").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(vocabulary_stems(counted), "term")
    merged = joined.groupBy(id_, "stem").agg(F.sum("n").alias("n"))
    words: Column = F.flatten(F.collect_list(F.array_repeat("stem", F.col("n").cast("int"))))
    out = merged.groupBy(id_).agg(F.array_join(words, " ").alias(text))
    return texts.select(id_).join(out, id_, "left").select(id_, F.coalesce(text, F.lit("")).alias(text))
