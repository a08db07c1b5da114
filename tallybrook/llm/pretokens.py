"""Splitting of texts before byte-level BPE, and which texts each engine splits alike."""

from __future__ import annotations

import re

import regex

#: The public splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _BLANK = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: The same pattern over the code points below 256, where the standard engine is faster.
_LATIN = re.compile(
    rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_ANY = regex.compile(PATTERN)


#: A space between two characters that are no white space in any engine's tables (fixed values: those of Unicode, and the characters
#: that some versions of it class so). Every match of PATTERN that reaches it begins there, whatever classes the others have.
_BORDER = regex.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0\u180e\u200b-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff])(?= [^\s\x1c-\x1f\x85\xa0\u180e\u200b-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff])")


def chunks(text: str) -> list[str]:
    """Parts of any text that are encoded apart in every engine: words with the space before them, and what surrounds other white space."""
    return _BORDER.split(text)


def is_latin(text: str) -> bool:
    """Whether every character is below U+0100, where all engines' Unicode tables agree."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def split(text: str) -> list[str]:
    """The matches of PATTERN, in order."""
    return _LATIN.findall(text) if is_latin(text) else _ANY.findall(text)


latin_split = _LATIN.findall


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others by the next free letters from U+0100 on."""
    letters = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    free = 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return letters


_LETTERS = _byte_letters()


def as_letters(piece: str) -> str:
    """A pre-token as byte-level models spell it."""
    return piece.encode().decode("latin-1").translate(_LETTERS)
