"""English stems (Porter2) and stopwords, a word at a time and for columns of words."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopwords of English text search, and the words, endings and letters that the published Porter2 rules name.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
UNCHANGED_AFTER_S = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LATE_REGION = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_AFTER = "cdeghkmnrt"
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("ization", "ize"), ("izer", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"),
    ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", ""),
)
THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_VOWEL = "[aeiouy]"
_REGION = re.compile(rf"{_VOWEL}[^aeiouy]")
_SHORT_END = re.compile(rf"(?:^|.*[^aeiouy]){_VOWEL}[^aeiouywxY]$|^{_VOWEL}[^aeiouy]$")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    met = _REGION.search(word, start)
    return met.end() if met else len(word)


def _longest(word: str, endings: tuple) -> str | tuple | None:
    """The longest of the endings (or of pairs that begin with one) that the word has."""
    met = [e for e in endings if word.endswith(e if isinstance(e, str) else e[0])]
    return max(met, key=lambda e: len(e if isinstance(e, str) else e[0]), default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"{_VOWEL}.", word[:-1]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    base = word[: -len(ending)]
    if ending.startswith("eed"):
        return base + "ee" if len(base) >= r1 else word
    if not re.search(_VOWEL, base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT_END.match(base) else base


@lru_cache(100_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word; words with other letters than a to z and the apostrophe stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in UNCHANGED:
        return word
    word = re.sub(rf"({_VOWEL})y", r"\1Y", re.sub("^y", "Y", word.removeprefix("'")))
    late = next((p for p in LATE_REGION if word.startswith(p)), None)
    r1 = len(late) if late else _region(word, 0)
    r2 = _region(word, r1)
    word = re.sub("'s'$|'s$|'$", "", word)
    word = _plural(word)
    if word in UNCHANGED_AFTER_S:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    second = _longest(word, SECOND)
    if second is not None:
        base = word[: -len(second[0])]
        rest_ok = base.endswith("l") if second[0] == "ogi" else base[-1:] in tuple(LI_AFTER) if second[0] == "li" else True
        if len(base) >= r1 and rest_ok:
            word = base + second[1]
    third = _longest(word, THIRD)
    if third is not None:
        base = word[: -len(third[0])]
        if len(base) >= (r2 if third[0] == "ative" else r1):
            word = base + third[1]
    fourth = _longest(word, FOURTH)
    if fourth is not None:
        base = word[: -len(fourth)]
        if len(base) >= r2 and (fourth != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or len(base) >= r1 and not _SHORT_END.match(base):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stem_term(word: str) -> str:
    """The stem of a search term; empty for a stopword."""
    return "" if word in _STOPS else stem(word)


_STOPS = frozenset(STOPWORDS)


def stemmed(tokens: Column) -> Column:
    """Stems of arrays of lower-case words, place by place; stopwords become empty and keep their place.

    Each distinct word of a batch is stemmed once; null arrays stay null.
    """

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        words = column.flatten().dictionary_encode()
        stems = pa.array([stem_term(w) if w is not None else None for w in words.dictionary.to_pylist()], pa.string())
        lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_pylist()
        ends = [0]
        for n in lengths:
            ends.append(ends[-1] + n)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems.take(words.indices), mask=column.is_null())

    return run(tokens)
