"""Texts of too many tokens as consecutive pieces of balanced size, each repeating the end of the one before.

The fewest pieces that hold the text give equally long targets. Each target is snapped to the strongest boundary near it,
of equals to the nearest one; from strongest to weakest: before a file's diff or a hunk, after an empty line, after a line,
after a sentence. When a piece then exceeds the limit, one more piece is planned and all is placed anew. Only where no
boundary is near is the cut between two tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarloom.llm.tokens import TOKEN

HUNK = re.compile(r"(?:diff --git |@@ -)")
SENTENCE_END = re.compile(r"[.!?…。]['\")\]»”’]*$")


def boundaries(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    """For each token, how well the text may be cut before it: 4 hunk, 3 paragraph, 2 line, 1 sentence, 0 not."""
    rank = np.zeros(len(tokens) + 1, np.int8)
    for i in range(1, len(tokens)):
        end, start = tokens[i - 1][1], tokens[i][0]
        if end == start:
            continue
        gap = text[end:start]
        if "\n" in gap:
            # A line may begin with white space, a hunk's header does not.
            rank[i] = 4 if gap[-1] == "\n" and HUNK.match(text, start) else 3 if re.search(r"\n[ \t\r]*\n", gap) else 2
        elif SENTENCE_END.search(text, tokens[i - 1][0], end):
            rank[i] = 1
    return rank


def place(rank: np.ndarray, n: int, m: int, size: int, overlap: int) -> list[int] | None:
    """The cuts of ``n`` tokens into ``m`` pieces, each target snapped to a boundary; None if a piece exceeds ``size``."""
    each = (n + overlap * (m - 1)) / m
    near = int((each - overlap) / 3)
    cuts = [0]
    for i in range(1, m):
        aim = round(each + (i - 1) * (each - overlap))
        most = cuts[-1] + size - (overlap if i > 1 else 0)
        low, high = max(aim - near, cuts[-1] + 1, overlap), min(aim + near, most, n - 1)
        if high < low:
            return None
        at = min(aim, high)
        found = rank[low : high + 1]
        if found.max() > 0:
            best = low + np.flatnonzero(found == found.max())
            at = int(best[np.abs(best - aim).argmin()])
        cuts.append(max(at, low))
    cuts.append(n)
    return cuts if n - cuts[-2] + (overlap if m > 1 else 0) <= size else None


def split_tokens(text: str, tokens: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    n = len(tokens)
    rank = boundaries(text, tokens)
    m = 1 + ceil((n - size) / (size - overlap))
    while (cuts := place(rank, n, m, size, overlap)) is None:
        m += 1
    at = lambda i: 0 if i == 0 else len(text) if i == n else tokens[i][0]
    pieces = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        s = max(0, a - overlap)
        pieces.append((at(a), at(s), at(b), b - s))
    return pieces


def token_spans(text: str, size: int) -> list[tuple[int, int]]:
    """Tokens of a text of more than ``size`` of them, else nothing."""
    if len(text) <= size:  # a token has at least one character
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    return tokens if len(tokens) > size else []


def split_text(text: str, size: int = 1024, overlap: int = 64) -> list[tuple[int, int, int, int]]:
    """``first``, ``start``, ``end``, ``n_tokens`` of each piece of a text of more than ``size`` tokens, else nothing.

    ``text[start:end]`` is the piece, ``text[first:end]`` its part that repeats nothing; these parts one after the other
    are the text. Every piece but the first begins with the last ``overlap`` tokens of the one before.
    """
    if not 0 <= 2 * overlap < size:
        raise ValueError("a piece must be more than twice as long as the overlap")
    tokens = token_spans(text, size)
    return split_tokens(text, tokens, size, overlap) if tokens else []


def long_lines(text: str, tokens: list[tuple[int, int]], size: int) -> list[int]:
    """Numbers, from 1, of the lines (they end at a line feed) with more than ``size`` of the tokens. No piece can hold
    such a line, so it is cut inside."""
    breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    line = np.searchsorted(breaks, np.array([t[0] for t in tokens], np.int64))
    return (np.flatnonzero(np.bincount(line) > size) + 1).tolist()


PIECE = "doc_id bigint, piece int, first int, start int, end int, n_tokens int, text string, long_lines array<int>"


def pieces(documents: DataFrame, size: int = 1024, overlap: int = 64, with_text: bool = True) -> DataFrame:
    """``PIECE`` of every text of more than ``size`` tokens, numbered from 1; offsets count code points. ``long_lines``, in
    the first piece's row only, are the lines of the text that have more than ``size`` tokens by themselves. ``with_text``
    false leaves ``text`` null. Rows without ``doc_id`` or text are left out; repeated rows are cut each by itself."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                tokens = token_spans(t, size)
                if tokens:
                    lines = long_lines(t, tokens, size)
                    rows += [(d, i, f, s, e, n, t[s:e] if with_text else None, lines if i == 1 else None) for i, (f, s, e, n) in enumerate(split_tokens(t, tokens, size, overlap), 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])

    if not 0 <= 2 * overlap < size:
        raise ValueError("a piece must be more than twice as long as the overlap")
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(cut, PIECE)


def long_texts(documents: DataFrame, size: int = 1024, overlap: int = 64) -> DataFrame:
    """``doc_id``, ``line_no``: of each text that ``pieces`` cuts, 0 and each of its lines that has to be cut inside."""
    first = pieces(documents, size, overlap, with_text=False).where("piece = 1")
    return first.select("doc_id", F.explode(F.concat(F.array(F.lit(0)), "long_lines")).alias("line_no"))
