"""Snowball stemmers for English (Porter2) and Russian, from their published rules.

Spark has no stemmer, so ``stemmed`` runs an Arrow-batched function, and only
over the distinct words of a column: each word is stemmed once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgram.functions import stopwords

_VOWEL = "aeiouy"
# fixed values: words that the English rules treat on their own
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_R1_PREFIXES = ("gener", "commun", "arsen")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# suffix -> replacement, longest first; those of step 2 with a condition are handled there
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWEL and word[i - 1] in _VOWEL:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    n = len(word)
    if n == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    return n > 2 and word[-1] not in _VOWEL + "wxY" and word[-2] in _VOWEL and word[-3] not in _VOWEL


@lru_cache(200_000)
def english_stem(word: str) -> str:
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) < 3:
        return word
    word = word.removeprefix("'")
    if word[:1] == "y":
        word = "Y" + word[1:]
    word = re.sub(r"([aeiouy])y", r"\1Y", word)
    head = next((p for p in _R1_PREFIXES if word.startswith(p)), None)
    r1 = len(head) if head else _region(word, 0)
    r2 = _region(word, r1)
    for end in ("'s'", "'s", "'"):  # step 0
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):  # step 1a
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWEL for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):  # step 1b
        if word.endswith(end):
            stem = word[: -len(end)]
            if end.startswith("eed"):
                if len(stem) >= r1:
                    word = stem + "ee"
            elif any(c in _VOWEL for c in stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(_DOUBLES):
                    word = word[:-1]
                elif _short_end(word) and len(word) <= r1:
                    word += "e"
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:  # step 1c
        word = word[:-1] + "i"
    for end, new in _STEP2.items():
        if word.endswith(end):
            stem = word[: -len(end)]
            if len(stem) >= r1 and not (end == "ogi" and not stem.endswith("l")) and not (end == "li" and stem[-1:] not in tuple("cdeghkmnrt")):
                word = stem + new
            break
    for end, new in _STEP3.items():
        if word.endswith(end):
            stem = word[: -len(end)]
            if len(stem) >= (r2 if end == "ative" else r1):
                word = stem + new
            break
    for end in _STEP4:
        if word.endswith(end):
            stem = word[: -len(end)]
            if len(stem) >= r2 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    stem = word[:-1]  # step 5
    if word.endswith("e"):
        if len(stem) >= r2 or (len(stem) >= r1 and not _short_end(stem)):
            word = stem
    elif word.endswith("l") and len(stem) >= r2 and stem.endswith("l"):
        word = stem
    return word.replace("Y", "y")


# fixed values: Russian endings by group; those of a first group follow а or я
_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_REFLEXIVE = ("ся", "сь")
_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
_SUPERLATIVE = ("ейш", "ейше")
_DERIVATIONAL = ("ост", "ость")
_RU_VOWEL = "аеиоуыэюя"


def _longest(word: str, start: int, groups) -> int:
    """Where the longest ending begins, not before ``start``; -1 if there is none.

    ``groups`` is (endings that need а or я before them, other endings).  The
    longest ending that matches decides, whether its condition holds or not.
    """
    best, needs = "", False
    for conditional, endings in ((True, groups[0]), (False, groups[1])):
        for e in endings:
            if len(e) > len(best) and word.endswith(e) and len(word) - len(e) >= start:
                best, needs = e, conditional
    at = len(word) - len(best)
    if not best or (needs and (at - 1 < start or word[at - 1] not in "ая")):
        return -1
    return at


def _cut(word: str, start: int, groups) -> tuple[str, bool]:
    at = _longest(word, start, groups)
    return (word[:at], True) if at >= 0 else (word, False)


@lru_cache(200_000)
def russian_stem(word: str) -> str:
    word = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in _RU_VOWEL), len(word))

    def region(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in _RU_VOWEL and word[i - 1] in _RU_VOWEL:
                return i + 1
        return len(word)

    r2 = region(region(0))
    word, done = _cut(word, rv, _GERUND)
    if not done:
        word, _ = _cut(word, rv, ((), _REFLEXIVE))
        word, done = _cut(word, rv, ((), _ADJECTIVE))
        if done:
            word, _ = _cut(word, rv, _PARTICIPLE)
        else:
            word, done = _cut(word, rv, _VERB)
            if not done:
                word, _ = _cut(word, rv, ((), _NOUN))
    if word.endswith("и") and len(word) > rv:
        word = word[:-1]
    at = _longest(word, rv, ((), _DERIVATIONAL))
    if at >= r2:
        word = word[:at]
    word, done = _cut(word, rv, ((), _SUPERLATIVE))
    if word.endswith("нн") and len(word) - 2 >= rv:
        word = word[:-1]
    elif not done and word.endswith("ь") and len(word) > rv:
        word = word[:-1]
    return word


_STEMMERS = {"english": (english_stem, stopwords.ENGLISH), "russian": (russian_stem, stopwords.RUSSIAN)}


def stem_column(word: Column, language: str) -> Column:
    """The stem of a word column."""
    if language not in _STEMMERS:
        raise ValueError(f"no stemmer for {language!r}")

    @F.pandas_udf("string")
    def of(words: pd.Series) -> pd.Series:
        stem = _STEMMERS[language][0]
        return words.map(lambda w: None if w is None else stem(w))

    return of(word)


def stem_filter(tokens: list[str], language: str) -> list[str]:
    """Drops stop words, then stems: for a token list on the driver."""
    stem, stop_words = _STEMMERS[language]
    stop = frozenset(stop_words)
    return [stem(t) for t in tokens if t not in stop]


def stem_tokens(rows: DataFrame, id_col: str, tokens_col: str, language: str) -> DataFrame:
    """``(id, pos, token, stem)`` of the tokens that are no stop words.

    Every distinct token is stemmed once and joined back.
    """
    from sparkgram.functions.analysis import without_stop_words

    stop = _STEMMERS[language][1]
    tokens = rows.select(id_col, F.posexplode(without_stop_words(F.col(tokens_col), stop)).alias("pos", "token"))
    stems = tokens.select("token").distinct().withColumn("stem", stem_column(F.col("token"), language))
    return tokens.join(stems, "token").select(id_col, "pos", "token", "stem")
