"""English stems by the Porter2 rules, for vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The published rules.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
BEGINNINGS = ("gener", "commun", "arsen")

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_V}{_C}")
_SHORT_END = re.compile(f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$")
_longest = lambda endings: re.compile("(?:" + "|".join(sorted(endings, key=len, reverse=True)) + ")$")
_ENDS_2, _ENDS_3, _ENDS_4, _ENDS_1B = map(_longest, (STEP_2, STEP_3, STEP_4, ("eed", "eedly", "ed", "edly", "ing", "ingly")))


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    ends = [len(b) for b in BEGINNINGS if word.startswith(b)]
    found = _REGION.search(word)
    first = ends[0] if ends else found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _plural(word: str) -> str:
    """Step 1a."""
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    """Step 1b."""
    found = _ENDS_1B.search(word)
    if not found:
        return word
    if found[0].startswith("eed"):
        return word[: found.start()] + "ee" if found.start() >= first else word
    stem = word[: found.start()]
    if not re.search(_V, stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", stem):
        return stem[:-1]
    return stem + "e" if first >= len(stem) and _SHORT_END.search(stem) else stem


def porter2(word: str) -> str:
    """The stem of a lower-case word; words of other letters lose what looks like an English ending."""
    word = word.replace("’", "'").removeprefix("'")
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub(f"(^|{_V})y", r"\1Y", word)
    first, second = _regions(word)
    word = _plural(re.sub("(?:'s'|'s|')$", "", word))
    if word in STAY:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    found = _ENDS_2.search(word)
    if found and found.start() >= first:
        before = word[: found.start()]
        if not (found[0] == "ogi" and not before.endswith("l")) and not (found[0] == "li" and not re.search("[cdeghkmnrt]$", before)):
            word = before + STEP_2[found[0]]
    found = _ENDS_3.search(word)
    if found and found.start() >= (second if found[0] == "ative" else first):
        word = word[: found.start()] + STEP_3[found[0]]
    found = _ENDS_4.search(word)
    if found and found.start() >= second and not (found[0] == "ion" and word[found.start() - 1] not in "st"):
        word = word[: found.start()]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or (at >= first and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


def with_stems(vocabulary: DataFrame, term: str = "term", stem: str = "stem") -> DataFrame:
    """(term, stem) of a table of different lower-case words; null terms go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([porter2(w) for w in words.to_pylist()], pa.string())], names=[term, stem])

    return vocabulary.filter(f"`{term}` is not null").select(term).mapInArrow(run, f"`{term}` string, `{stem}` string")
