"""Splitting whole texts into pre-tokens, with what a worker remembers of the distinct ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

SUBBATCH = 1 << 20  # characters split at a time
REMEMBERED, LONG = 250_000, 64  # distinct pre-tokens that a worker keeps within a task, and the characters of the longest of these: about 60 MB
# The characters up to U+00FF of the classes L, N and White_Space.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = r"\t-\r \x85\xa0"


@lru_cache(4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text. White space is Unicode's, as in the libraries' regular expressions; texts up to U+00FF take a faster equal pattern."""
    import regex

    wide = regex.compile(pattern.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
    narrow = re.compile(pattern.replace(r"(?!\S)", f"(?![^{SPACES}])").replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]").replace(r"\s", f"[{SPACES}]"))

    def split(text: str) -> list[str]:
        if text.isascii():
            return narrow.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide.findall(text)
        return narrow.findall(text)

    return split


def in_parts(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in lists of about SUBBATCH characters (one text at least)."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(text or "")
        if size >= SUBBATCH:
            yield part
            part, size = [], 0
    if part:
        yield part


def looked_up(texts: Iterable[str | None], split: Callable[[str], list[str]], known: dict[str, object], learn: Callable[[list[str]], Iterable[object]]) -> Iterator[list[object]]:
    """For each text what `known` has for its pre-tokens, in order; `learn` gives it for those that are new."""
    for part in in_parts(texts):
        rows = [split(t) for t in part]
        new = sorted(set().union(*rows).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = sorted(set().union(*rows))
        known.update(zip(new, learn(new)))
        for row in rows:
            yield list(map(known.__getitem__, row))
        for word in new:
            if len(word) > LONG:
                del known[word]
