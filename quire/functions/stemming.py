"""Porter's stemmer (1980) over arrays of terms, in Arrow batches: each distinct term of a batch is stemmed once."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.sources.shipping import ship_package

# The suffixes of the published steps 2, 3 and 4.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble logi:log alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
#: Longer and shorter terms are kept as they are.
LEAST, MOST = 3, 64


def _table(pairs: str) -> list[tuple[str, str]]:
    """(suffix, what it becomes), longest suffixes first."""
    return sorted((tuple(p.split(":")) for p in pairs.split()), key=lambda p: -len(p[0]))


_SECOND, _THIRD = _table(STEP_2), _table(STEP_3)
_FOURTH = sorted([*STEP_4.split(), "ion"], key=len, reverse=True)


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Whether a stem ends in consonant, vowel, consonant, the last none of w, x and y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swapped(word: str, table: list[tuple[str, str]]) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case term."""
    if not LEAST <= len(word) <= MOST:
        return word
    if word.endswith(("sses", "ies")) and len(word) > 3:
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        stem = next((word[: -len(s)] for s in ("ing", "ed") if word.endswith(s)), None)
        if stem is not None and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                word = stem + "e"
            elif stem[-2:-1] == stem[-1:] and _shape(stem).endswith("cc") and stem[-1] not in "lsz":
                word = stem[:-1]
            elif _measure(stem) == 1 and _short(stem):
                word = stem + "e"
            else:
                word = stem
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swapped(_swapped(word, _SECOND), _THIRD)
    suffix = next((s for s in _FOURTH if word.endswith(s)), None)
    if suffix:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_lists(terms: pa.Array) -> pa.Array:
    """Lists of terms as lists of stems."""
    sizes = pc.fill_null(pc.list_value_length(terms), 0)
    ends = pc.cumulative_sum(sizes)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    coded = terms.flatten().dictionary_encode()
    stems = pa.array([None if w is None else porter(w) for w in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices))


def porter_stems(terms: Column) -> Column:
    """The stems of an array of lower-case terms, in order; a null array is empty."""
    ship_package(SparkSession.active())

    @F.arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        return stem_lists(lists)

    return stems(F.coalesce(terms, F.array().cast("array<string>")))
