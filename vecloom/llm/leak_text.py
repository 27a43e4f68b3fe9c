"""Reading scanned pages and passages as folded words, and the run of a passage in a page.

A page is a list of segments: its lines, cut again where columns stand side by
side. Words are folded so that letters a recogniser confuses become equal. A run
of passage words may leave a segment only at its end and go on at the start of a
later one, which is how other columns, adverts and sheet numbers come between;
inside a segment every word has to follow.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

#: Letters that recognisers take for one another share a class.
CLASSES = ("nur", "oeca0", "tfs85ſ", "hb", "il1j|")
#: Letters read as two, or two as one, are written in classes.
PARTS = {"m": "nn", "d": "oi", "ß": "ss"}
_FOLD = {ord(c): group[0] for group in CLASSES for c in group}
_FOLD |= {ord(c): "".join(_FOLD.get(ord(x), x) for x in PARTS[c]) for c in PARTS}
_SHARP = re.compile(r"(?<=[a-zäöü])B")
for _a, _b in (("г", "т"), ("ё", "е"), ("й", "и")):
    _FOLD[ord(_a)] = _b
_LINE_ENDS = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_GAP = re.compile(r"[  ]{2,}|\t+")


class _Keep(dict):
    """Translation of one character: folded if it is a letter or digit, else dropped."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        folded = _FOLD.get(code, c) if c.isalnum() or c == "|" else ""
        self[code] = folded
        return folded


_KEEP = _Keep()


def clean(text: str) -> str:
    """Compatibility forms, marks and case removed; folding comes later, by word."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ſ", "s"))
    return _SHARP.sub("ß", text).lower()


def fold(word: str) -> str:
    return word.translate(_KEEP)


class Page:
    """Folded words of a text, the segment of each, and where a run may go from it."""

    __slots__ = ("words", "ends", "starts")

    def __init__(self, text: str):
        self.words: list[str] = []
        self.starts: list[int] = []  # index of the first word of each segment
        for line in _LINE_ENDS.split(clean(text)):
            for segment in _GAP.split(line):
                words = [w for w in map(fold, segment.split()) if w]
                if words:
                    self.starts.append(len(self.words))
                    self.words += words
        self.ends = [s - 1 for s in self.starts[1:]] + [len(self.words) - 1] if self.starts else []

    def onward(self, i: int, way: int) -> list[int]:
        """Where the word after ``i`` (before, if ``way`` is -1) can stand: nearest segment first."""
        k = bisect_right(self.starts, i) - 1
        if way > 0:
            return [i + 1] if i < self.ends[k] else self.starts[k + 1 :]
        return [i - 1] if i > self.starts[k] else self.ends[:k][::-1]

    def behind(self, i: int, way: int) -> list[int]:
        """Ends of segments on the other side, where a run that left its segment may go on: the next column."""
        k = bisect_right(self.starts, i) - 1
        if i != (self.ends[k] if way > 0 else self.starts[k]):
            return []
        return self.starts[:k] if way > 0 else self.ends[k + 1 :]

    def strings(self) -> Iterator[tuple[str, int, int]]:
        """``(letters, first, last)`` of every one to four neighbouring words of a segment."""
        words = self.words
        for start, end in zip(self.starts, self.ends):
            for i in range(start, end + 1):
                letters = ""
                for j in range(i, min(i + 4, end + 1)):
                    letters += words[j]
                    yield letters, i, j


_near: dict[tuple[str, str], bool] = {}


def near(a: str, b: str) -> bool:
    """Whether two folded words are one word misread: an edit for four letters, two for nine."""
    if a == b:
        return True
    most = 2 if len(a) >= 9 else 1 if len(a) >= 4 else 0
    if not most or abs(len(a) - len(b)) > most:
        return False
    known = _near.get((a, b))
    if known is None:
        if len(_near) > 200_000:
            _near.clear()
        known = _near[a, b] = _edits(a, b, most)
    return known


def _edits(a: str, b: str, most: int) -> bool:
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if not most:
        return False
    return _edits(a[1:], b, most - 1) or _edits(a, b[1:], most - 1) or _edits(a[1:], b[1:], most - 1)


#: Segments passed over within which one or two words more are believed; farther away three have to follow.
CLOSE = 8


def _extend(page: Page, passage: list[str], i: int, j: int, way: int, most: int) -> int:
    """Passage words, ``most`` at most, that follow word ``j`` (at ``i``) in direction ``way``."""
    words = page.words
    first, last = max(0, j - most), min(len(passage) - 1, j + most)
    memo: dict[tuple[int, int], int] = {}

    def at_word(at: int, j: int, want: str, two: str | None) -> int:
        """Words gained if the next passage word, read in one of the ways of a recogniser, stands at ``at``."""
        got, here = words[at], 0
        if near(want, got):
            here = 1 + go(at, j + way)
        if two and len(got) > len(want) and near(two, got):
            here = max(here, 2 + go(at, j + 2 * way))
        if len(got) < len(want) + 2:
            for then in page.onward(at, way):
                size = len(got) + len(words[then])
                if abs(size - len(want)) > 2 and (not two or abs(size - len(two)) > 2):
                    continue
                both = got + words[then] if way > 0 else words[then] + got
                if near(want, both):
                    here = max(here, 1 + go(then, j + way))
                elif two and near(two, both) and not near(want, got):
                    here = max(here, 2 + go(then, j + 2 * way))
        if not here and len(want) >= 4 and len(got) > len(want) and (got.startswith(want) if way > 0 else got.endswith(want)):
            here = 1
        return here

    def go(i: int, j: int) -> int:
        if not first <= j + way <= last:
            return 0
        known = memo.get((i, j))
        if known is not None:
            return known
        memo[i, j] = 0
        best, want = 0, passage[j + way]
        two = None if not first <= j + 2 * way <= last else (want + passage[j + 2 * way] if way > 0 else passage[j + 2 * way] + want)
        for far, at in enumerate(page.onward(i, way)):
            here = at_word(at, j, want, two)
            # a lone short word beyond other segments is chance, not the passage
            if (here == 1 and far > 1 and len(want) < 6) or (far > CLOSE and here < 3):
                here = 0
            best = max(best, here)
        if not best:
            # the foot of a column, read on at the head of another: more must follow to count
            for at in page.behind(i, way):
                here = at_word(at, j, want, two)
                best = max(best, here if here >= 3 else 0)
        memo[i, j] = best
        return best

    return go(i, j)


#: Letters below which a shingle takes a third word.
SHORT = 9


def shingles(words: list[str]) -> list[tuple[int, int, str]]:
    """``(first word, words, letters)`` of each shingle of a passage."""
    out = []
    for j in range(len(words) - 1):
        size = 2 if len(words[j]) + len(words[j + 1]) >= SHORT or j + 3 > len(words) else 3
        out.append((j, size, "".join(words[j : j + size])))
    return out


def places(page: Page, wanted: set[str]) -> dict[str, list[tuple[int, int]]]:
    """Where the wanted strings stand in a page: first and last word of each."""
    out: dict[str, list[tuple[int, int]]] = {}
    for letters, i, j in page.strings():
        if letters in wanted:
            out.setdefault(letters, []).append((i, j))
    return out


def longest_run(page: Page, passage: list[str], enough: int | None = None, where: dict[str, list[tuple[int, int]]] | None = None) -> int:
    """Most consecutive words of ``passage`` that stand in ``page``; ``enough`` ends the search.

    A run is grown from every shingle of the passage that stands in the page.
    """
    own = shingles(passage)
    where = places(page, {letters for _, _, letters in own}) if where is None else where
    best, most = 0, enough or len(passage)
    for at, size, letters in own:
        for i, j in where.get(letters, ()):
            best = max(best, size + _extend(page, passage, j, at + size - 1, 1, most) + _extend(page, passage, i, at, -1, most))
            if enough and best >= enough:
                return best
    return best


def passage_words(text: str) -> list[str]:
    return [w for w in map(fold, clean(text).split()) if w]
