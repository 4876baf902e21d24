"""Plain words of a text: runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII."""

from __future__ import annotations

#: Bytes as words keep them; every other ASCII byte becomes a space.
_KEPT = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, in order; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()
