"""Small string helpers of the spelling operators; plain Python, used inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata


def fold(text: str) -> str:
    """Lower case without accents and ligatures."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in plain if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("œ", "oe")


def within_one(a: str, b: str) -> bool:
    """True if one insertion, deletion, substitution or swap of neighbours (or nothing) separates the words."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def distance(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
    return row[-1]


def is_subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def deletions(word: str) -> list[str]:
    """The word and every word that lacks one of its letters: words within one edit share such a form."""
    return sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})


WORD = re.compile(r"[^\W_]+")
