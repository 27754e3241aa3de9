"""Plain words of UTF-8 texts: runs of letters a to z, digits and all characters from U+0080 on; only A to Z lower-cased."""

from __future__ import annotations

from ledgerloom.llm.common import ship

ship(__name__)

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
TABLE = bytes(c if c >= 0x80 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain_words(raw: bytes | None) -> list[bytes]:
    """The words in order; every other byte parts them."""
    return raw.translate(TABLE).split() if raw else []
