"""Tokens: for similarity (Latin stems and CJK pairs) and for search (Porter stems)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks of CJK characters.
CJK = "一-鿿㐀-䶿぀-ゟ゠-ヿ가-힯豈-﫿"
#: Suffix, length in bytes that the word must exceed, bytes cut; the first that fits is cut.
SUFFIXES = (("ting", 5, 3), ("ing", 4, 3), ("ed", 3, 2), ("es", 3, 2), ("s", 3, 1), ("ly", 4, 2))

_RUNS = re.compile(rf"([{CJK}]+)|((?:(?![{CJK}])[^\W_])+)")


_CJK = re.compile(f"[{CJK}]")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def short_stem(word: str) -> str:
    size = len(word.encode())
    for suffix, least, cut in SUFFIXES:
        if size > least and word.endswith(suffix):
            return word[:-cut]
    return word


def _latin(words: Iterable[str]) -> Iterator[str]:
    return (short_stem(w) for w in words if len(w) > 1 or not w.isascii())


def hybrid_tokens(text: str) -> list[str]:
    """Stemmed Latin runs of two bytes or more; CJK runs as overlapping pairs, a single one as itself."""
    text = text.lower()
    if text.isascii() or not _CJK.search(text):
        return list(_latin(_WORD.findall(text)))
    out: list[str] = []
    for cjk, word in _RUNS.findall(text):
        if word:
            out += _latin([word])
        else:
            out += [cjk] if len(cjk) == 1 else [cjk[i : i + 2] for i in range(len(cjk) - 1)]
    return out


def distinct_tokens(text: str) -> list[str]:
    """The same in order of code points, each once: a word that occurs again is not stemmed again."""
    plain = text.lower()
    if plain.isascii() or not _CJK.search(plain):
        return sorted(set(_latin(set(_WORD.findall(plain)))))
    return sorted(set(hybrid_tokens(text)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(text: pd.Series) -> pd.Series:
    """Similarity tokens in order; null text has none."""
    return text.map(lambda t: hybrid_tokens(t) if t is not None else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def token_set(text: pd.Series) -> pd.Series:
    """The set of similarity tokens, in Spark's order of strings; null text has none."""
    return text.map(lambda t: distinct_tokens(t) if t is not None else [])


class Porter:
    """The suffix stripper of M. F. Porter (1980)."""

    #: The paper's rules by step; (condition on the measure, suffix, replacement).
    STEP2 = (
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
        ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    )
    STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def shape(word: str) -> str:
        """c and v by letter; y after a consonant is a vowel."""
        out = ""
        for i, x in enumerate(word):
            out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
        return out

    @classmethod
    def measure(cls, stem: str) -> int:
        return len(re.findall("v+c", cls.shape(stem)))

    @classmethod
    def vowel(cls, stem: str) -> bool:
        return "v" in cls.shape(stem)

    @classmethod
    def double(cls, word: str) -> bool:
        return len(word) > 1 and word[-1] == word[-2] and cls.shape(word)[-1] == "c"

    @classmethod
    def short(cls, word: str) -> bool:
        return cls.shape(word)[-3:] == "cvc" and word[-1] not in "wxy"

    @classmethod
    def _longest(cls, word: str, rules, least: int) -> str:
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(suffix):
                stem = word[: len(word) - len(suffix)]
                return stem + new if cls.measure(stem) > least else word
        return word

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if cls.measure(w[:-3]) > 0 else w
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and cls.vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif cls.double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif cls.measure(w) == 1 and cls.short(w):
                        w += "e"
                    break
        if w.endswith("y") and cls.vowel(w[:-1]):
            w = w[:-1] + "i"
        w = cls._longest(w, cls.STEP2, 0)
        w = cls._longest(w, cls.STEP3, 0)
        for suffix in sorted(cls.STEP4, key=len, reverse=True):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if cls.measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                    w = stem
                break
        if w.endswith("e"):
            m = cls.measure(w[:-1])
            if m > 1 or (m == 1 and not cls.short(w[:-1])):
                w = w[:-1]
        if cls.measure(w) > 1 and cls.double(w) and w.endswith("l"):
            w = w[:-1]
        return w


_TERM = re.compile(r"[^\W_]+")


#: Where characters begin that may combine with the one before.
_MARKS = re.compile("[\u0300-\U0010ffff]+")


def _unmarked(found: re.Match[str]) -> str:
    return "".join(c for c in found[0] if not unicodedata.combining(c))


@lru_cache(1 << 17)
def known_stem(word: str) -> str:
    """As `Porter.stem`; a worker remembers this many."""
    return Porter.stem(word)


def search_terms(text: str, stemmed: bool = True) -> list[str]:
    """Lower-cased alphanumeric runs, diacritics off, stemmed."""
    plain = text.lower()
    if not plain.isascii():
        plain = _MARKS.sub(_unmarked, unicodedata.normalize("NFKD", plain))
    words = _TERM.findall(plain)
    return [known_stem(w) for w in words] if stemmed else words


@F.pandas_udf(T.ArrayType(T.StringType()))
def terms(text: pd.Series) -> pd.Series:
    """Search terms in order, stemmed; null text has none."""
    return text.map(lambda t: search_terms(t) if t is not None else [])


def leaf_counts(leaves: list[tuple[list[str], bool]], stemmed: bool = True) -> Callable[[Column], Column]:
    """Of a text the number of its terms, and how often each leaf (stems in a row, whether the last is a prefix) occurs.

    What a rule puts in place of a suffix differs from it in its last two characters at most, so a word and its stem begin
    alike: only words that begin like a stem in question, its last three characters aside, are stemmed.
    """
    heads = tuple({w[: max(1, len(w) - 3)] for words, _ in leaves for w in words})

    def fits(x: str, leaf: tuple[list[str], bool], k: int) -> bool:
        words, prefix = leaf
        return x.startswith(words[k]) if prefix and k == len(words) - 1 else x == words[k]

    def counts(text: str | None) -> list[int]:
        found = search_terms(text, stemmed=False) if text is not None else []
        here = {i: known_stem(w) if stemmed else w for i, w in enumerate(found) if w.startswith(heads)}
        out = [len(found)]
        for leaf in leaves:
            out.append(sum(all(i + k in here and fits(here[i + k], leaf, k) for k in range(len(leaf[0]))) for i in here))
        return out

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(counts)

    return run


def plain_terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits: the unstemmed terms, in expressions only."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
