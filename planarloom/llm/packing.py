"""Texts put together into containers of a fixed number of tokens, by hierarchical residual packing.

Each partition packs its texts by best fit, block by block, and emits the bins that are nearly full; a bin that is not
goes on as one item of the next block. What is left of the partitions, a few bins each, is merged as a tree: in each round
the underfull bins meet in groups of bounded size and are packed as items, those still underfull are taken apart and
packed anew, and nearly full ones are emitted. The last round, of one group or of several when bins no longer fit
together, emits all. Full bins never move; only what is underfull is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarloom.llm.tokens import TOKEN
from planarloom.runtime import Workspace, broadcast_if_small

#: A bin is nearly full with this share of its tokens.
NEARLY_FULL = 0.995
#: Tokens and bytes of text a group of a merge round takes together.
GROUP_TOKENS, GROUP_BYTES = 4_000_000, 64 << 20
MAX_ROUNDS = 20

PLACED = "full boolean, grp bigint, seq bigint, doc_id bigint, piece int, n_tokens int, text string"


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Runs ``n_tokens``, ``rank``, ``count``, ``container``: ``count`` items of a size from ``rank`` on go one each into
    the containers from ``container`` on. Larger items first, each where it leaves the least space. Items of one size are
    alike, so whole runs of them are placed at once."""
    runs: list[tuple[int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    opened = 0

    def put(space: int, start: int, count: int) -> None:
        if space and count:
            if space not in free:
                insort(spaces, space)
            free.setdefault(space, []).append((start, count))

    for s in sorted(counts, reverse=True):
        if not 0 < s <= size:
            raise ValueError(f"a text of {s} tokens does not fit a container of {size}")
        rank, left = 0, counts[s]
        while left and (at := bisect_left(spaces, s)) < len(spaces):
            space = spaces[at]
            start, count = free[space].pop()
            if not free[space]:
                del free[space]
                spaces.pop(at)
            m = min(left, count)
            runs.append((s, rank, m, start))
            put(space - s, start, m)
            put(space, start + m, count - m)
            rank, left = rank + m, left - m
        per = size // s
        full, rest = divmod(left, per)
        for _ in range(per if full else 0):
            runs.append((s, rank, full, opened))
            rank += full
        put(size - per * s, opened, full)
        opened += full
        if rest:
            for _ in range(rest):
                runs.append((s, rank, 1, opened))
                rank += 1
            put(size - rest * s, opened, 1)
            opened += 1
    return runs


#: A text in a bin: doc_id, piece, n_tokens, text. It takes the room of one token at least.
Item = tuple[int, int, int, str]


def room(items: list[Item]) -> int:
    return sum(max(1, x[2]) for x in items)


def merge(bins: list[list[Item]], size: int) -> list[list[Item]]:
    """The bins, each as one item, packed together by best fit; an item's place depends on its size and order only."""
    by_size: dict[int, list[list[Item]]] = {}
    for b in bins:
        by_size.setdefault(room(b), []).append(b)
    out: dict[int, list[Item]] = {}
    for s, rank, n, start in best_fit(Counter({s: len(b) for s, b in by_size.items()}), size):
        for i in range(n):
            out.setdefault(start + i, []).extend(by_size[s][rank + i])
    return list(out.values())


def cut_long(doc_id: int, text: str, size: int) -> list[Item]:
    """The text whole if it has at most ``size`` tokens, else cut after each ``size`` tokens."""
    n = len(TOKEN.findall(text))
    if n <= size:
        return [(doc_id, 1, n, text)]
    starts = [m.start() for i, m in enumerate(TOKEN.finditer(text)) if i % size == 0]
    ends = [*starts[1:], len(text)]
    starts[0] = 0
    return [(doc_id, i + 1, min(size, n - i * size), text[s:e]) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


class Out:
    """Rows of bins, full ones numbered from 1 and underfull ones from -1 downwards in their group."""

    def __init__(self, grp: int):
        self.grp, self.full, self.under = grp, 0, 0

    def frame(self, full: list[list[Item]], under: list[list[Item]]) -> pd.DataFrame:
        rows = []
        for b in full:
            self.full += 1
            rows += [(True, self.grp, self.full, *x) for x in b]
        for b in under:
            self.under -= 1
            rows += [(False, self.grp, self.under, *x) for x in b]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")])


def pack(documents: DataFrame, work: Workspace, size: int = 2048, bucket: int = 20_000) -> DataFrame:
    """``container``, ``doc_id``, ``piece``, ``n_tokens``, ``text``: every text once, whole if it has at most ``size`` tokens,
    else cut after each ``size`` tokens; the pieces of a container have at most ``size`` tokens together. Containers are
    numbered from 1.

    ``doc_id`` is unique; rows without it or without a text are left out. A text without tokens takes the room of one.
    ``bucket`` bounds how many items a task packs at once, and how many underfull bins it holds.
    """
    least = size * NEARLY_FULL

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, open_bins = Out(TaskContext.get().partitionId()), []
        for pdf in batches:
            items = [[x] for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for x in cut_long(d, t, size)]
            for i in range(0, len(items), bucket):
                bins = merge(open_bins + items[i : i + bucket], size)
                open_bins = [b for b in bins if room(b) < least]
                yield out.frame([b for b in bins if room(b) >= least], [])
                if len(open_bins) > bucket:
                    yield out.frame([], open_bins)
                    open_bins = []
        yield out.frame([], open_bins)

    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    rounds = [work.cut(texts.mapInPandas(fill, PLACED), "round0")]
    before = None
    while True:
        left = rounds[-1].where("not full")
        n_bins, tokens, size_b = left.agg(F.count_distinct("grp", "seq"), F.sum(F.greatest("n_tokens", F.lit(1))), F.sum(F.octet_length("text"))).first()
        if not n_bins:
            break
        n = len(rounds)
        groups = max(1, -(-tokens // GROUP_TOKENS), -(-size_b // GROUP_BYTES))
        # The bins have stopped fitting together when a round has left nine in ten of them.
        last = groups == 1 or n >= MAX_ROUNDS or (before is not None and n_bins > 0.9 * before)
        before = n_bins

        together = left.withColumn("g", F.pmod(F.xxhash64("grp", "seq", F.lit(n)), F.lit(groups)))
        rounds.append(work.cut(together.groupBy("g").applyInPandas(_merge_round(size, least, last), PLACED), f"round{n}"))

    # A row per task and round, so that containers are numbered without a gap.
    numbers, done = [], 0
    for n, table in enumerate(rounds):
        for grp, most in sorted(tuple(r) for r in table.where("full").groupBy("grp").agg(F.max("seq")).collect()):
            numbers.append((n, grp, done))
            done += most
    offsets = broadcast_if_small(work.spark.createDataFrame(numbers, "round int, grp bigint, before bigint"), 1_000_000)
    whole = None
    for n, table in enumerate(rounds):
        rows = table.where("full").withColumn("round", F.lit(n))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.join(offsets, ["round", "grp"]).select((F.col("before") + F.col("seq")).alias("container"), "doc_id", "piece", "n_tokens", "text")


def _merge_round(size: int, least: float, last: bool):
    """The function that packs a group's underfull bins: as items first, then those still underfull text by text."""

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bins: dict[tuple, list[Item]] = {}
        pdf = pdf.sort_values(["grp", "seq", "doc_id", "piece"])
        for g, s, *item in zip(*(pdf[c].tolist() for c in ("grp", "seq", "doc_id", "piece", "n_tokens", "text")), strict=True):
            bins.setdefault((g, s), []).append(tuple(item))
        merged = merge(list(bins.values()), size)
        full, under = [b for b in merged if room(b) >= least], [b for b in merged if room(b) < least]
        anew = merge([[x] for b in under for x in b], size)
        if len(anew) <= len(under):
            full, under = full + [b for b in anew if room(b) >= least], [b for b in anew if room(b) < least]
        return Out(int(key[0])).frame(full + under if last else full, [] if last else under)

    return again
