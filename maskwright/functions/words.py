"""Which capitalised words of a form line can belong to a name."""

from __future__ import annotations

import functools
import re

from .patterns import AUDIT_STOPWORDS

STOPWORDS = frozenset(AUDIT_STOPWORDS)
SEGMENTS = STOPWORDS | {f"{w}S" for w in STOPWORDS}
SHORTEST, LONG, WHOLE = 2, 4, 6
#: A word, and the possessive and punctuation that don't belong to it.
WORD = re.compile(r"(?P<core>.*?)(?:'S)?[.,:'\-]*", re.DOTALL)


@functools.lru_cache(maxsize=100_000)
def made_of_stopwords(word: str) -> bool:
    """A run of form words without spaces, as OCR gives: at least six letters, one of the words of four or more."""
    if len(word) < WHOLE:
        return False
    reach = {0: False}  # ends that can be reached -> with a long word
    for end in range(SHORTEST, len(word) + 1):
        starts = [s for s in reach if end - s >= SHORTEST and word[s:end] in SEGMENTS]
        if starts:
            reach[end] = any(reach[s] or end - s >= LONG for s in starts)
    return reach.get(len(word), False)


@functools.lru_cache(maxsize=100_000)
def form_word(word: str) -> bool:
    """Whether a word in capitals is form vocabulary, or only a letter."""
    core = WORD.fullmatch(word)["core"]
    return len(core) < 2 or core in STOPWORDS or made_of_stopwords(core.replace("'", ""))


def telling(words: list[str]) -> list[int]:
    """Places of the words that say more than form vocabulary does."""
    return [i for i, w in enumerate(words) if not form_word(w)]
