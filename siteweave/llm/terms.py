"""Terms of whole texts by one pass of ``bytes.translate``: letters lowered, separators blanked."""

from __future__ import annotations

import string

#: ASCII bytes other than letters (and digits, where they count) are separators; bytes from 0x80 on belong to terms.
_ASCII_LETTERS = string.ascii_letters.encode()


def translate_table(kept: bytes = b"") -> bytes:
    """The 256 bytes that lower A-Z, keep letters, ``kept`` and all beyond ASCII, and blank the rest."""
    inside = {*_ASCII_LETTERS, *kept}
    return bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or b in inside else 0x20 for b in range(256))


LETTERS = translate_table()
LETTERS_AND_DIGITS = translate_table(string.digits.encode())


def terms_of(text: bytes | None, by: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none for null."""
    return text.translate(by).split() if text else []
