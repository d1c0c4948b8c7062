"""The Porter2 stemmer for English, written from its published description."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Fixed values of the algorithm: exceptional words, suffixes and what they become.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = {"al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"}


AFTER_VOWEL = re.compile("[aeiouy][^aeiouy]")
SHORT_END = re.compile(r"(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)")
CONSONANT_Y = re.compile(r"(^|[aeiouy])y")
IDENTIFIER = re.compile(r"[0-9.+#\-]")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same within R1."""

    def after(start: int) -> int:
        m = AFTER_VOWEL.search(word, start)
        return m.end() if m else len(word)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _ends_short(word: str) -> bool:
    return SHORT_END.search(word) is not None


def _longest(word: str, suffixes) -> str | None:
    """The longest of ``suffixes``, which have up to seven letters, that the word ends with."""
    for n in range(min(7, len(word)), 0, -1):
        if word[-n:] in suffixes:
            return word[-n:]
    return None


def _step_1(word: str, r1: int) -> str:
    s = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        word = word[:-2]
    elif s in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif s == "s" and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    s = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(word) - len(s) >= r1:
            word = word[: -len(s)] + "ee"
    elif s and any(c in VOWELS for c in word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    return word


def _step_2(word: str, r1: int) -> str:
    s = _longest(word, STEP_2)
    if s and len(word) - len(s) >= r1:
        before = word[: -len(s)]
        if (s == "ogi" and not before.endswith("l")) or (s == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            return word
        return before + STEP_2[s]
    return word


def _step_3(word: str, r1: int, r2: int) -> str:
    s = _longest(word, STEP_3)
    if s and len(word) - len(s) >= (r2 if s == "ative" else r1):
        return word[: -len(s)] + STEP_3[s]
    return word


def _step_4(word: str, r2: int) -> str:
    s = _longest(word, STEP_4)
    if s and len(word) - len(s) >= r2 and (s != "ion" or word[-4:-3] in ("s", "t")):
        return word[: -len(s)]
    return word


def _step_5(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or (at >= r1 and not _ends_short(word[:-1]))):
        return word[:-1]
    if word.endswith("ll") and at >= r2:
        return word[:-1]
    return word


def porter2(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in SPECIAL:
        return SPECIAL[word]
    word = CONSONANT_Y.sub(r"\1Y", word) if "y" in word else word
    r1, r2 = _regions(word)
    word = _step_1(word, r1)
    if word not in AFTER_1A:
        word = _step_5(_step_4(_step_3(_step_2(word, r1), r1, r2), r2), r1, r2)
    return word.lower()


def stem(word: str) -> str:
    """The index term of a word: what comes before an apostrophe, stemmed unless it looks like an identifier."""
    head = word.replace("’", "'").split("'")[0] or word
    return head if IDENTIFIER.search(head) else porter2(head)
