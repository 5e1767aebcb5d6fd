"""Which words of a list a text contains: one scan by an Aho-Corasick automaton, whatever the length of the list.

The automaton is built once in every Python worker from the list that travels with the
query (Spark broadcasts it when it is large). Short lists stay built-in expressions.

Cases: a null text contains nothing, an empty text only the empty word. Words that repeat in the list count
once, at their first place. The answer follows the order of the list, not that of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lists from this length on are matched by the automaton.
AUTOMATON_FROM = 20
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


class WordList:
    """Words in an order of preference; bounded ones count only between characters that are no letters a-z."""

    def __init__(self, words: tuple[str, ...], bounded: bool = False) -> None:
        self.words, self.bounded = words, bounded
        self.always = [k for k, w in enumerate(words) if w == ""]
        self.machine = ahocorasick.Automaton()
        for k, word in enumerate(words):
            if word and word not in self.machine:
                self.machine.add_word(word, (k, len(word)))
        self.machine.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(place in the list, start, end) of every occurrence of a word."""
        if len(self.machine) == 0:
            return
        for last, (k, size) in self.machine.iter(text):
            at, to = last + 1 - size, last + 1
            if self.bounded and (text[at - 1 : at] in LETTERS or text[to : to + 1] in LETTERS):
                continue
            yield k, at, to

    def found(self, text: str | None) -> list[str]:
        """The words that text contains, in list order."""
        if text is None:
            return []
        return [self.words[k] for k in sorted({*self.always[:1], *(k for k, _, _ in self.places(text))})]

    def first(self, text: str | None) -> str | None:
        if text is None:
            return None
        least = min((k for k, _, _ in self.places(text)), default=None)
        if self.always and (least is None or self.always[0] < least):
            return ""
        return None if least is None else self.words[least]

    def any(self, text: str | None) -> bool | None:
        if text is None:
            return None
        return bool(self.always) or next(self.places(text), None) is not None


@lru_cache(64)
def word_list(words: tuple[str, ...], bounded: bool = False) -> WordList:
    return WordList(words, bounded)


def _column(words: list[str], bounded: bool, kind: T.DataType, ask: Callable[[WordList, str | None], object]):  # noqa: ANN202
    listed = tuple(words)

    @F.pandas_udf(kind)
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = word_list(listed, bounded)
        for batch in batches:
            yield pd.Series([ask(known, text) for text in batch], dtype=object)

    return answers


def contained(haystack: Column, words: list[str], bounded: bool = False) -> Column:
    """The words that a text contains, in list order."""
    return F.coalesce(_column(words, bounded, T.ArrayType(T.StringType()), WordList.found)(haystack), F.array().cast("array<string>"))


def first_of(haystack: Column, words: list[str], bounded: bool = False) -> Column:
    """The first word of the list that a text contains; null if none."""
    return _column(words, bounded, T.StringType(), WordList.first)(haystack)


def any_of(haystack: Column, words: list[str], bounded: bool = False) -> Column:
    return _column(words, bounded, T.BooleanType(), WordList.any)(haystack)
