"""What the JVM has no function for: compatibility forms of characters."""

from __future__ import annotations

import unicodedata


def compatible(text: str) -> str:
    """A text in NFKC: ligatures, circled digits and wide letters as plain characters."""
    return unicodedata.normalize("NFKC", text)
