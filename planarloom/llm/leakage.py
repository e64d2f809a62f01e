"""Documents that repeat a passage of a held-out item, by winnowing.

Of every run of ``WINDOW`` consecutive hashes of ``GRAM`` words the smallest is a fingerprint, for items and documents
alike, so two texts that share GRAM + WINDOW - 1 = 7 words in a row share a fingerprint. A passage of 30 words with 3
edits has 7 such words: 27 kept words lie in 4 runs. Longer passages that qualify hold a qualifying one of under 60 words,
which has such a run too. From each shared fingerprint the match is extended both ways as far as 0 to 5 edits reach, so
what is reported is decided by the words and not by hashes. The items are the query set: blocks of them of bounded size,
one after the other, are joined by fingerprint to all documents in a lookup that every task holds, so documents are not
shuffled and no fingerprint, however frequent, is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from planarloom.llm.tokens import WORD

GRAM, WINDOW = 5, 3
LEAST, PER_EDIT, MOST_EDITS = 30, 10, 5
#: Words of the items whose fingerprints one pass over the documents holds: at most some 100 MB in a task.
BLOCK_WORDS = 1_000_000


def words(text: str) -> list[str]:
    """Runs of letters and digits without letter case."""
    return WORD.findall(text.casefold())


def fingerprints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of word numbers ``ids``; words without number (0) are in none."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h ^ ids[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    known = np.lib.stride_tricks.sliding_window_view(ids > 0, GRAM).all(1)
    h[~known] = np.uint64(2**64 - 1)
    if n <= WINDOW:
        at = np.arange(n)
    else:
        rows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.unique(np.arange(len(rows)) + rows.argmin(1))
    at = at[known[at]]
    return at, h[at]


def reach(a: np.ndarray, b: np.ndarray) -> list[int]:
    """For 0 to ``MOST_EDITS`` edits, how many words of ``a`` from its start match words from the start of ``b``."""
    n, m = len(a), len(b)
    out: list[int] = []
    front: dict[int, int] = {}
    for e in range(MOST_EDITS + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):  # b's position less a's
            if e == 0:
                i = 0
            else:
                steps = []
                if d in front:  # replaced
                    steps.append(front[d] + 1)
                if d + 1 in front:  # dropped
                    steps.append(front[d + 1] + 1)
                if d - 1 in front:  # added
                    steps.append(front[d - 1])
                if not steps:
                    continue
                i = min(max(steps), n, m - d)
                if i < 0 or i + d < 0:
                    continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            new[d] = i
        front = new
        out.append(max([*front.values(), out[-1] if out else 0]))
    return out


def leaks(item: np.ndarray, doc: np.ndarray, p: int, q: int) -> bool:
    """Whether a passage around the ``GRAM`` words at ``p`` of the item and ``q`` of the document is repeated."""
    if not np.array_equal(item[p : p + GRAM], doc[q : q + GRAM]):
        return False
    span = LEAST + PER_EDIT * MOST_EDITS
    right = reach(item[p : p + span], doc[q : q + span + MOST_EDITS])
    left = reach(item[max(0, p - span) : p][::-1], doc[max(0, q - span - MOST_EDITS) : q][::-1])
    return any(x + y >= max(LEAST, PER_EDIT * (i + j)) for i, x in enumerate(left) for j, y in enumerate(right) if i + j <= MOST_EDITS)


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_words`` words, or of one item; they arrive one at a time."""
    block, n = [], 0
    for ident, text in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        own = len(words(text))
        if block and n + own > block_words:
            yield block
            block, n = [], 0
        block.append((ident, text))
        n += own
    if block:
        yield block


def leaked(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``item_id`` of every document that repeats at least ``LEAST`` consecutive words of the item, of which up
    to one in ``PER_EDIT`` is replaced, dropped or added. Each pair once. Null ids and texts are left out; items of fewer
    words and empty texts give no rows; copies of a document count by themselves."""
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = [texts.mapInPandas(_finder(block), "doc_id bigint, item_id bigint") for block in item_blocks(items, block_words)]
    if not found:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return reduce(DataFrame.unionByName, found).distinct()


def _finder(block: list[tuple[int, str]]):
    """The function that finds the items of ``block`` in batches of documents."""
    vocab: dict[str, int] = {}
    known = [(ident, np.array([vocab.setdefault(w, len(vocab) + 1) for w in words(text)], np.int64)) for ident, text in block]
    places: dict[int, list[tuple[int, int]]] = {}
    for k, (_, ids) in enumerate(known):
        for at, h in zip(*fingerprints(ids), strict=True):
            places.setdefault(int(h), []).append((k, int(at)))
    hashes = np.array(sorted(places), np.uint64)

    def of_text(text: str) -> set[int]:
        ids = np.array([vocab.get(w, 0) for w in words(text)], np.int64)
        at, h = fingerprints(ids)
        if not len(at) or not len(hashes):
            return set()
        slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        found: set[int] = set()
        for q, x in zip(at[hashes[slot] == h], h[hashes[slot] == h], strict=True):
            for k, p in places[int(x)]:
                if k not in found and leaks(known[k][1], ids, p, int(q)):
                    found.add(k)
        return {known[k][0] for k in found}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i in sorted(of_text(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

    return find
