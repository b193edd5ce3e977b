"""Words of a text whatever its case, accents, punctuation, markup and spacing."""

from __future__ import annotations

import html
import re
import unicodedata

# Characters that can't be seen, as code points.
INVISIBLE = "".join(
    map(
        chr,
        (
            0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E,
            *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070),
            *range(0xFE00, 0xFE10), 0xFEFF,
        ),
    )
)
_INVISIBLE = re.compile(f"[{re.escape(INVISIBLE)}]+")

#: A tag of any length, or an entity.
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>|&(?:[A-Za-z]{2,8}|#\d{2,6}|#x[0-9A-Fa-f]{2,5});")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]+")
_WORD = re.compile(r"[^\W_]+")


def _unescape(match: re.Match) -> str:
    found = match.group()
    return " " if found[0] == "<" else html.unescape(found)


def strip_marks(text: str) -> str:
    """Without accents; compatibility forms in their ordinary form."""
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


def fold(text: str) -> str:
    """Case-folded text without accents, invisible characters and markup."""
    if "<" in text or "&" in text:
        text = _TAG.sub(_unescape, text)
    if not text.isascii():
        text = strip_marks(_INVISIBLE.sub("", text))
    return text.casefold()


def words(text: str | None) -> list[str]:
    """The folded words in order; none for null."""
    return _WORD.findall(fold(text)) if text else []
