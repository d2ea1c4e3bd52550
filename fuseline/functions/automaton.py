"""Many words looked for in one pass over a text.

One automaton holds all words; it goes to the workers with the function, once, and the time for a text grows with the
text and its hits, not with the number of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Automaton:
    """hits(text) gives (start, end, index of the word) of every place of every word, in the order of their ends."""

    def __init__(self, words: Iterable[str]):
        self.words = [w for w in words if w]
        self._built = None

    def __reduce__(self):
        return Automaton, (self.words,)

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        if not self.words:
            return
        if self._built is None:
            import ahocorasick

            self._built = ahocorasick.Automaton()
            for i, w in enumerate(self.words):
                self._built.add_word(w, i)
            self._built.make_automaton()
        for last, i in self._built.iter(text):
            yield last + 1 - len(self.words[i]), last + 1, i

    def longest(self, text: str) -> list[tuple[int, int, int]]:
        """hits() of which none lies within another: at each place the longest word."""
        out: list[tuple[int, int, int]] = []
        for start, end, i in self.hits(text):
            while out and out[-1][0] >= start:
                out.pop()
            if not out or out[-1][1] < end:
                out.append((start, end, i))
        return out


def words_in(c: Column, words: Iterable[str]) -> Column:
    """The different ones of words that a text contains, in their given order."""
    machine = Automaton(dict.fromkeys(words))

    @F.arrow_udf("array<string>")
    def found(text: pa.Array) -> pa.Array:
        rows = [sorted({i for *_, i in machine.hits(x or "")}) for x in text.to_pylist()]
        return pa.array([[machine.words[i] for i in r] for r in rows], pa.list_(pa.string()))

    return found(c)
