"""Words as a search index keeps them: folded, split, and stemmed by Porter's rules (Porter 1980, "An algorithm for suffix stripping")."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")

#: fixed values: suffixes and what takes their place; a rule fits where the rest before it has the measure of its step
_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split(), "") | {"sion": "s", "tion": "t"}


def _letters(word: str) -> str:
    """The word as c for consonants and v for vowels; y is a vowel behind a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _letters(stem)))


def _short_end(stem: str) -> bool:
    """consonant, vowel, consonant other than w, x and y."""
    return _letters(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The word after the rule of its longest suffix, if the stem before it has a measure of at least ``least``."""
    suffix = next((word[-n:] for n in range(min(7, len(word)), 1, -1) if word[-n:] in rules), "")
    stem = word.removesuffix(suffix)
    # of -sion and -tion the letter that stays is part of the stem
    kept = rules[suffix] if suffix in ("sion", "tion") else ""
    return stem + rules[suffix] if suffix and _measure(stem + kept) >= least else word


def _plural_and_past(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    for suffix in ("ed", "ing"):
        stem = word.removesuffix(suffix)
        if stem != word and "v" in _letters(stem):
            if stem.endswith(("at", "bl", "iz")) or _measure(stem) == 1 and _short_end(stem):
                return stem + "e"
            return stem[:-1] if len(stem) > 1 and stem[-1] == stem[-2] and _letters(stem)[-1] == "c" and stem[-1] not in "lsz" else stem
        if stem != word:
            break
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters, and others than plain Latin letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _plural_and_past(word)
    if word.endswith("y") and "v" in _letters(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(_replaced(word, _SECOND, 1), _THIRD, 1), _FOURTH, 2)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stems(text: str | None) -> list[str]:
    """Stems of the runs of letters and digits of a text, in order, in lower case and without diacritics."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return [stem(w) for w in _WORD.findall(text.lower())]
