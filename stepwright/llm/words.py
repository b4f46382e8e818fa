"""Words of a text, apart from case, markup, punctuation and line breaks."""

from __future__ import annotations

import re
import unicodedata

# a tag may go over lines but not over a blank one; a tag or comment ends where the next one begins, so that none is read twice
_TAGS = re.compile(r"</?[a-zA-Z][^<>\n]*+(?:\n(?!\s*\n)[^<>\n]*+)*+>|<!--(?:(?!<!--).)*?-->|&(?:[a-zA-Z]{2,8}|#\d{1,6});", re.S)
_LINKS = re.compile(r"\]\(")
_SPACE = re.compile(r"\s+")
_OTHER = re.compile(r"[\W_]+")


def words(text: str | None) -> list[str]:
    """What stands between white space, in lower case and compatible form, letters and digits only.

    An identifier or path is one word.  Tags, entities and comments separate words; what holds no letter
    or digit is no word.
    """
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAGS.sub(" ", text)
    if "](" in text:
        text = _LINKS.sub("] (", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    found = (_OTHER.sub("", w) for w in _SPACE.split(text.lower()))
    return [w for w in found if w]


def word_places(text: str | None) -> list[tuple[str, int, int]]:
    """The words of a text with where they begin and end in it; words of one stretch without white space share its place."""
    if not text:
        return []
    blank = _TAGS.sub(lambda m: " " * len(m[0]), text).replace("](", "] ")
    found = []
    for m in re.finditer(r"\S+", blank):
        part = unicodedata.normalize("NFKC", m[0]).lower()
        found += [(w, m.start(), m.end()) for w in (_OTHER.sub("", p) for p in _SPACE.split(part)) if w]
    return found


def common_in_order(a: list, b: list, least: int) -> bool:
    """Whether the longest common subsequence has ``least`` words, by bit-parallel rows; ends as soon as it can't."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row, spare = full, len(a) + len(b) - least  # of the words of a found so far and the words of b left
    for j, y in enumerate(b):
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
        if j % 8 == 7 and row.bit_count() + j + 1 > spare:
            return False
    return len(a) - row.bit_count() >= least
