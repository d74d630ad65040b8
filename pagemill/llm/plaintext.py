"""Words as they were meant: text without the tricks that hide them from a filter."""

from __future__ import annotations

import re
import unicodedata

#: fixed values: letters of other scripts that look like Latin ones
_LOOKALIKE = str.maketrans(
    "аеорсухіјѕԁһӏвнкмтгпьиАВЕКМНОРСТУХІЈЅαβεικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢƒ",
    "aeopcyxijsdhlbhkmtrnbuABEKMHOPCTYXIJSabeikvoptuxwABEZHIKMNOPTYXiagabcdeghijklmnoprtuvwyzf",
)
#: fixed values: digits and signs that stand for letters
_LEET = str.maketrans("0134578@$!|+€", "oieastbasiite")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_CODE = re.compile(r"`[^`\n]*`|\b[\w.-]+\.\w+/\S+|\bhttps?://\S+|\b[0-9a-f]{12,64}\b|\b\w+_\w[\w]*\b(?:\([^)\n]*\))?")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-*_]){2,}[^\W_](?![^\W_])")
_WORD = re.compile(r"[^\W_](?:[\w'’*@$!|+€#]*[^\W_]|[*#]+(?![\w]))?", re.U)
# what a text has at least if one of the costlier patterns fits
_MAY_BE_CODE = re.compile(r"[`/_]|[0-9a-f]{12}")
_MAY_BE_SPACED = re.compile(r"(?<![^\W_])[^\W_][ .\-*_][^\W_][ .\-*_]")
_LONG_RUN = re.compile(r"([^\W\d])\1\1")
_END = re.compile(r"(?<=[.!?…])\s+|\n+|(?<=[;:])\s+(?=[A-ZÀ-Þ])")


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _END.split(text)) if s]


def _join_spaced(m: re.Match) -> str:
    return re.sub(r"[ .\-*_]", "", m[0])


def _letters(word: str) -> str:
    """One word without look-alikes: digits among letters become letters, runs of a letter one or two."""
    if any(c.isdigit() or c in "@$!|+€" for c in word):
        body = word.rstrip("!|+")
        if any(c.isalpha() for c in body) and not re.fullmatch(r"\d+[a-z]{1,3}|v?\d[\d.]*[a-z]?|[a-z]{1,2}\d+|[0-9a-f]{5,}|\d+x\d+|0x[0-9a-f]+", body):
            word = body.translate(_LEET)
    return re.sub(r"([^\W\d])\1{2,}", r"\1", word)


def plain_words(sentence: str) -> list[str]:
    """Words of a sentence in lower case, undisguised and without accents. Code, links and numbers are left out.

    A word with letters starred out keeps the stars (``f*ck``), for a vocabulary to fill in.
    """
    if not sentence.isascii():
        sentence = _INVISIBLE.sub("", unicodedata.normalize("NFKC", sentence))
        # a word that mixes scripts is a disguise; one in a single other script is that script's
        sentence = re.sub(r"\w+", lambda m: m[0].translate(_LOOKALIKE) if not m[0].isascii() and re.search(r"[A-Za-z]", strip_accents(m[0])) else m[0], sentence)
        sentence = strip_accents(sentence)
    if _MAY_BE_CODE.search(sentence):
        sentence = _CODE.sub(" ", sentence)
    text = sentence.lower()
    if _MAY_BE_SPACED.search(text):
        text = _SPACED.sub(_join_spaced, text)
    long_runs = _LONG_RUN.search(text) is not None
    out = []
    for w in _WORD.findall(text):
        if not long_runs and w.isalpha():
            out.append(w)
            continue
        w = _letters(w)
        if w.isdigit() or not any(c.isalpha() for c in w):
            continue
        out.append(w.replace("’", "'").replace("#", "*"))
    return out
