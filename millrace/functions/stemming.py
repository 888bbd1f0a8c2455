"""Stems of Spanish words by region-based suffix stripping.

The rules are those of the public algorithm for Spanish of the Snowball family: three
regions of the word (RV, R1, R2), an attached pronoun (step 0), a standard suffix (step 1),
else a verb's ending (steps 2a and 2b), a last vowel (step 3), and acute accents. Words are
expected in lower case; a word without any such ending is its own stem.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vowels and endings of the algorithm.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
GERUNDS_WITH_ACCENT = "iéndo ándo ár ér ír".split()
GERUNDS = "ando iendo ar er ir".split()
NOUNS = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AGENTS = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
QUALITIES = "idad idades".split()
ADJECTIVES = "iva ivo ivas ivos".split()
Y_ENDINGS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
E_ENDINGS = "en es éis emos".split()
VERB_ENDINGS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
    "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
LAST_VOWELS = "os a o á í ó".split()
WITHOUT_ACCENT = str.maketrans("áéíóú", "aeiou")


def _after(word: str, start: int, vowel: bool) -> int:
    """The place after the first vowel (or other letter) from ``start`` on; the word's end if there is none."""
    for i in range(start, len(word)):
        if (word[i] in VOWELS) == vowel:
            return i + 1
    return len(word)


def regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    r1 = _after(word, _after(word, 0, True), False)
    r2 = _after(word, _after(word, r1, True), False)
    if len(word) < 3:
        return len(word), r1, r2
    if word[1] not in VOWELS:
        return _after(word, 2, True), r1, r2
    return (_after(word, 2, False) if word[0] in VOWELS else 3), r1, r2


_SUFFIXES = frozenset([*NOUNS, *AGENTS, *REPLACED, "amente", "mente", *QUALITIES, *ADJECTIVES])
_BEFORE_PRONOUN = frozenset([*GERUNDS_WITH_ACCENT, *GERUNDS, "yendo"])
_VERBS, _Y, _PRONOUNS, _LAST = frozenset([*E_ENDINGS, *VERB_ENDINGS]), frozenset(Y_ENDINGS), frozenset(PRONOUNS), frozenset([*LAST_VOWELS, "e", "é"])
_LONGEST = max(map(len, _SUFFIXES | _VERBS))


def _ending(word: str, endings: frozenset[str], start: int = 0) -> str:
    """The longest of ``endings`` that the word has from ``start`` on, or nothing."""
    return next((word[-n:] for n in range(min(_LONGEST, len(word) - start), 0, -1) if word[-n:] in endings), "")


def _cut(word: str, start: int, *endings: str) -> str:
    """Without the longest of ``endings``, if it lies in the region from ``start`` on."""
    e = _ending(word, frozenset(endings))
    return word[: len(word) - len(e)] if e and len(word) - len(e) >= start else word


def _without_pronoun(word: str, rv: int) -> str:
    pronoun = _ending(word, _PRONOUNS)
    if not pronoun:
        return word
    rest = word[: -len(pronoun)]
    before = _ending(rest, _BEFORE_PRONOUN, rv)
    if before in GERUNDS_WITH_ACCENT:
        return rest[: -len(before)] + before.translate(WITHOUT_ACCENT)
    if before in GERUNDS or (before == "yendo" and rest[:-5].endswith("u")):
        return rest
    return word


def _without_suffix(word: str, r1: int, r2: int) -> str:
    suffix = _ending(word, _SUFFIXES)
    rest = word[: len(word) - len(suffix)]
    if not suffix or len(rest) < (r1 if suffix == "amente" else r2):
        return word
    if suffix in REPLACED:
        return rest + REPLACED[suffix]
    if suffix in AGENTS:
        return _cut(rest, r2, "ic")
    if suffix == "amente":
        shorter = _cut(rest, r2, "iv")
        return _cut(shorter, r2, "at") if shorter != rest else _cut(rest, r2, "os", "ic", "ad")
    if suffix == "mente":
        return _cut(rest, r2, "ante", "able", "ible")
    if suffix in QUALITIES:
        return _cut(rest, r2, "abil", "ic", "iv")
    return _cut(rest, r2, "at") if suffix in ADJECTIVES else rest


def _without_verb_ending(word: str, rv: int) -> str:
    y = _ending(word, _Y, rv)
    if y and word[: -len(y)].endswith("u"):
        return word[: -len(y)]
    ending = _ending(word, _VERBS, rv)
    rest = word[: len(word) - len(ending)]
    return rest[:-1] if ending in E_ENDINGS and rest.endswith("gu") else rest


def _without_last_vowel(word: str, rv: int) -> str:
    vowel = _ending(word, _LAST, rv)
    rest = word[: len(word) - len(vowel)]
    return rest[:-1] if vowel in ("e", "é") and rest.endswith("gu") and len(rest) - 1 >= rv else rest


def spanish_stem(word: str) -> str:
    """The stem of a lower-case word."""
    rv, r1, r2 = regions(word)
    word = _without_pronoun(word, rv)
    shorter = _without_suffix(word, r1, r2)
    word = shorter if shorter != word else _without_verb_ending(word, rv)
    return _without_last_vowel(word, rv).translate(WITHOUT_ACCENT)


def stem_table(words: DataFrame, term: str = "term") -> DataFrame:
    """term and stem of every different word: each word is stemmed once, however often it occurs."""

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=batch["term"].map(spanish_stem))

    distinct = words.select(F.col(term).alias("term")).filter(F.col(term).isNotNull()).distinct()
    return distinct.mapInPandas(stems, "term string, stem string")


def stem_prefix(column: Column, stem: str) -> Column:
    """``column`` starts with ``stem``, as a range that storage can prune by."""
    return (column >= stem) & (column < stem + "\U0010ffff")
