"""Porter's stemmer with the usual extensions of natural-language toolkits, for scores that compare stems."""

from __future__ import annotations

from functools import lru_cache

# Irregular forms, and suffixes with what replaces them, in the order in which they are tried.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
SECOND = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous "
    "aliti:al iviti:ive biliti:ble fulli:ful"
)
THIRD = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_SECOND, _THIRD = (tuple(tuple(x.split(":")) for x in rules.split()) for rules in (SECOND, THIRD))
_FOURTH = tuple(FOURTH.split())


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    shape = _shape(word)
    return shape[-3:] == "cvc" and word[-1] not in "wxy" or shape == "vc"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
    if cut is None:
        return word
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if cut[-1:] == cut[-2:-1] and _shape(cut)[-1:] == "c":
        return cut if cut[-1] in "lsz" else cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _short(cut) else cut


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    for suffix, new in _SECOND:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + new if _measure(rest) > 0 else word
    return word[:-1] if word.endswith("logi") and _measure(word[:-3]) > 0 else word


def _third(word: str) -> str:
    for suffix, new in _THIRD:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + new if _measure(rest) > 0 else word
    return word


def _fourth(word: str) -> str:
    for suffix in _FOURTH:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")) else word
    return word


def _last(word: str) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short(rest):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    return _last(_fourth(_third(_derived(word))))
