"""Tokens and words of a text, for Arrow functions."""

from __future__ import annotations

import re

#: A token: a longest run of word characters, or of characters that are neither word characters nor white space.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: A word: a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def count_tokens(text: str) -> int:
    """Number of tokens."""
    return len(TOKEN.findall(text))
