"""The words of a text: markup taken off, references decoded, compatibility forms folded, lower case."""

from __future__ import annotations

import re
import unicodedata

_TAG = re.compile(r"<[^<>]*>")
_LINK = re.compile(r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]")
# Leading zeros don't count; more digits than here are no character, whatever they are. The x may be of either case.
_REFERENCE = re.compile(r"&(?:(nbsp|amp|quot|lt|gt|ndash|mdash|shy)|#0*([0-9]{1,7})|#[xX]0*([0-9A-Fa-f]{1,6}));")
_DROPPED = re.compile("[­​-‍⁠﻿]+")
# The named references and what they stand for.
_NAMED = {"nbsp": " ", "amp": "&", "quot": '"', "lt": "<", "gt": ">", "ndash": "–", "mdash": "—", "shy": "­"}
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


class _Places(dict):
    """What each character becomes before words are split at blanks: kana and Han stand alone, letters, marks and digits stay,
    others become blanks. Filled as characters are met, from the tables of the interpreter that NFKC and lower case use too."""

    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        if 0x3040 <= code <= 0x30FF or 0x3400 <= code <= 0x9FFF:
            made = f" {c} "
        else:
            made = code if unicodedata.category(c)[0] in "LMN" else " "
        self[code] = made
        return made


_PLACES = _Places()


def _decoded(m: re.Match) -> str:
    """What one reference stands for; itself, if its number is no character."""
    if m[1]:
        return _NAMED[m[1]]
    code = int(m[2]) if m[2] else int(m[3], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; none for a null, empty or blank text.

    In this order: tags become blanks, piped links their label, references are decoded once, NFKC, invisible characters
    are dropped, lower case; then maximal runs of letters, marks and digits, with every kana and Han character a word of its
    own. Text in ASCII alone takes a shorter way to the same words.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[[" in text:
        text = _LINK.sub(r"\1", text)
    if "&" in text:
        text = _REFERENCE.sub(_decoded, text)
    if not text.isascii():
        text = _DROPPED.sub("", unicodedata.normalize("NFKC", text)).lower()
        if not text.isascii():
            return text.translate(_PLACES).split()
    return text.encode().translate(_ASCII).decode().split()
