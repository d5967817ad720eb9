"""A bounded memory of what was computed for a word, kept in each Python worker."""

from __future__ import annotations

from collections.abc import Callable


class WordCache(dict):
    """Looks a word up, or computes and keeps it; words met lately outlive the others.

    At `size` words the memory becomes the older generation and a new one is begun, so at most
    twice `size` words are held. A dict with __missing__ serves `map(cache.__getitem__, words)`
    at the speed of a plain dict.
    """

    def __init__(self, compute: Callable[[str], object], size: int = 300_000, longest: int = 256):
        super().__init__()
        self.compute, self.size, self.longest, self.older = compute, size, longest, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value
