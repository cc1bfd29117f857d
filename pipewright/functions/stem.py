"""The published English stemmer of the Snowball family (Porter 2), for search terms and texts alike."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"),
    ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_SHORT = re.compile(f"(?:{_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$")
_DOUBLED = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first non-vowel after a vowel."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes):
    return next((s for s in suffixes if word.endswith(s if isinstance(s, str) else s[0])), None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.lstrip("'")
    if len(word) <= 2 or not word.isascii():
        return word
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", word)
    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = head if head is not None else _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # past and progressive forms
    ending = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if ending in ("eed", "eedly"):
        w = w[: -len(ending)] + "ee" if len(w) - len(ending) >= r1 else w
    elif ending and re.search(_VOWEL, w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLED.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derivations, each within its region
    pair = _longest(w, _STEP2)
    if pair and len(w) - len(pair[0]) >= r1:
        before = w[: -len(pair[0])]
        if (pair[0] != "ogi" or before.endswith("l")) and (pair[0] != "li" or before[-1:] in tuple("cdeghkmnrt")):
            w = before + pair[1]
    pair = _longest(w, _STEP3)
    if pair and len(w) - len(pair[0]) >= (r2 if pair[0] == "ative" else r1):
        w = w[: -len(pair[0])] + pair[1]
    ending = _longest(w, _STEP4)
    if ending and len(w) - len(ending) >= r2 and (ending != "ion" or w[: -len(ending)].endswith(("s", "t"))):
        w = w[: -len(ending)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
