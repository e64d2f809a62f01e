"""Freely typed values mapped to the entry of a reference list they mean.

The distinct values are folded (lower case, without accents, look-alike Cyrillic and Greek letters, quotes, punctuation and
bracketed remarks). An inverted index from character n-grams to the entries' names (value and aliases), weighted by how rare
each n-gram is among them, gives the candidates; they are scored by the weighted cosine of their n-grams. A candidate whose
edit distance is small for its length, or which begins with what a full stop cuts off, is confirmed by this exact check and
gains on the others. The best entry is accepted above a threshold, lower for a confirmed one, and if it leads the next
entry by a margin. The answers are then joined back to the rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarloom.runtime import Workspace, broadcast_if_small, skew_join

#: Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans("авеёкмнорстухіјѕԁһгαεικνορτυχ", "abeekmhopctyxijsdhraeiknoptux")

#: Cosine a candidate needs to be looked at; to be accepted when nothing confirms it; and its lead over the next entry.
CANDIDATE, ACCEPT, MARGIN = 0.12, 0.47, 0.1
#: What a confirmation adds to the cosine at least, what it adds by its nearness, the lead a confirmed entry needs.
CONFIRMED, NEARNESS, CONFIRMED_MARGIN = 0.2, 0.3, 0.005
#: What a word left out costs, in cosine, and what it and a plural s cost in typing errors.
SHORTENED, WORD_OUT, PLURAL = 0.1, 1.0, 0.5
#: Names of the reference list that every task may hold.
MAX_NAMES = 200_000
#: Values a task decides, as long as there are not too many tasks.
VALUES_PER_TASK, MAX_TASKS = 5_000, 20_000


def fold(text: str) -> str:
    """Lower case, Latin letters without accents, words parted by one space; bracketed remarks are dropped."""
    text = re.sub(r"\([^)]*\)", " ", text.lower().translate(LOOKALIKE))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", text))


def ngrams(flat: str) -> Counter:
    """Letters, pairs, threes and pairs around one letter, with marks at both ends."""
    s = f"^{flat}$"
    out = Counter(flat)
    for n in (2, 3):
        out.update(s[i : i + n] for i in range(len(s) - n + 1))
    out.update(f"{s[i]}.{s[i + 2]}" for i in range(len(s) - 2))
    return out


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent letters swapped: 1); anything above ``most`` is ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(n: int) -> int:
    """Typing errors that a name of ``n`` letters may have."""
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3


class Matcher:
    """Finds the entry a value means among ``rows`` of (canon_id, k, value, aliases)."""

    def __init__(self, rows: list[tuple]):
        #: Per key the folded names: flat form, words, entry.
        self.names: dict[str, list[tuple[str, list[str], int]]] = {}
        for ident, k, value, aliases in sorted(rows, key=lambda r: (r[0], r[1])):
            for name in [value, *(aliases or [])]:
                words = fold(name or "").split()
                if words:
                    self.names.setdefault(k, []).append(("".join(words), words, ident))
        n = sum(map(len, self.names.values()))
        if n > MAX_NAMES:
            raise ValueError(f"the reference list has {n} names, tasks hold at most {MAX_NAMES}")
        found = Counter(g for names in self.names.values() for flat, _, _ in names for g in ngrams(flat))
        self.weight = {g: log(1 + n / (1 + m)) for g, m in found.items()}
        self.unseen = log(1 + n)
        #: Per key the inverted index: n-gram to (position of the name, its part of the cosine).
        self.index: dict[str, dict[str, list[tuple[int, float]]]] = {}
        for k, names in self.names.items():
            own = self.index.setdefault(k, {})
            for at, (flat, _, _) in enumerate(names):
                for g, x in self._vector(flat).items():
                    own.setdefault(g, []).append((at, x))

    def _vector(self, flat: str) -> dict[str, float]:
        v = {g: (1 + log(c)) * self.weight.get(g, self.unseen) for g, c in ngrams(flat).items()}
        length = sqrt(sum(x * x for x in v.values()))
        return {g: x / length for g, x in v.items()}

    def _cosines(self, k: str, flat: str) -> dict[int, float]:
        """Cosine of every name that shares an n-gram."""
        own, out = self.index.get(k, {}), {}
        for g, x in self._vector(flat).items():
            for at, y in own.get(g, ()):
                out[at] = out.get(at, 0.0) + x * y
        return out

    def _check(self, forms: list[tuple[str, float]], cut_off: bool, flat: str, words: list[str], typed: list[str]) -> float | None:
        """How near the value is to a name, from 1 (the same) towards 0; None if too far."""
        most = allowed(len(flat))
        best = min((d + extra for form, extra in forms if (d := distance(form, flat, most)) <= most), default=None)
        if best is None and cut_off:
            # The last word, or all of the value as one, is the beginning of the name's.
            for form, start in ((forms[0][0], flat), ("".join(typed), "".join([*words[:-1], words[-1][: len(typed[-1])]]) if len(words) == len(typed) > 1 else "")):
                if start and len(form) > 1:
                    least = allowed(len(form)) if len(form) > 3 else 0
                    d = min(distance(form, start[: len(form) + i], least) for i in (-1, 0, 1))
                    if d <= least:
                        return max(0.3, 1 - (d + 0.5) / (least + 1.5))
        return None if best is None else max(0.0, 1 - best / (most + 1))

    def _find(self, k: str, value: str) -> int:
        """``canon_id`` of the entry of ``k`` that ``value`` means, 0 if none."""
        typed = fold(value).split()
        if not typed:
            return 0
        forms = [("".join(typed), 0.0)]
        if forms[0][0].endswith("s"):
            forms.append((forms[0][0][:-1], PLURAL))
        if len(typed) > 1:
            forms.append(("".join(typed[:-1]), WORD_OUT))
        cosines = self._cosines(k, forms[0][0])
        if len(typed) > 1:  # a word too many at the end: 'area', 'old'
            for at, x in self._cosines(k, forms[-1][0]).items():
                cosines[at] = max(cosines.get(at, 0.0), x - SHORTENED)
        cut_off = re.search(r"\w\s*\.\W*$", value) is not None
        scores: dict[int, tuple[float, bool]] = {}
        for at, cosine in cosines.items():
            if cosine < CANDIDATE:
                continue
            flat, words, ident = self.names[k][at]
            near = self._check(forms, cut_off, flat, words, typed)
            score = (cosine + (CONFIRMED + NEARNESS * near if near is not None else 0.0), near is not None)
            scores[ident] = max(scores.get(ident, (0.0, False)), score)
        ranked = sorted(((*s, -i) for i, s in scores.items()), reverse=True)
        if not ranked:
            return 0
        score, confirmed, ident = ranked[0]
        lead = score - (ranked[1][0] if len(ranked) > 1 else 0.0)
        return -ident if (lead >= CONFIRMED_MARGIN if confirmed else score >= ACCEPT and lead >= MARGIN) else 0


def map_values(values: DataFrame, canon: DataFrame, work: Workspace) -> DataFrame:
    """Rows of ``values`` (origin, way_id, k, v) that are a case, as ``origin``, ``way_id``, ``k``, ``v``, ``canon_id``.

    A case is a non-blank value of a listed key that is not a ``value`` of that key to the letter; ``canon_id`` is 0 where
    it resembles none. Each distinct value is decided once, however many rows have it, and joined back without sending a
    frequent value's rows to one task. Repeated rows count once. ``canon`` goes to the driver and to every task; more than
    ``MAX_NAMES`` names are refused.
    """
    rows = [tuple(r) for r in canon.where("canon_id is not null and k is not null").select("canon_id", "k", "value", "aliases").limit(MAX_NAMES + 1).collect()]
    matcher = Matcher(rows)
    exact = broadcast_if_small(canon.where("k is not null and value is not null").select("k", F.col("value").alias("v")).distinct(), MAX_NAMES)
    keys = sorted({r[1] for r in rows})
    cases = values.where(F.col("k").isin(keys) & F.col("v").rlike(r"\S")).join(exact, ["k", "v"], "left_anti").select("origin", "way_id", "k", "v").distinct()
    cases, seen = work.cut_counting(cases.withColumn("kv", F.concat("k", F.lit("\0"), "v")), "cases", n=F.lit(True))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"kv": pdf["kv"], "canon_id": [matcher._find(k, v) for k, v in zip(pdf["k"], pdf["v"], strict=True)]})

    # The work is in the values' number, not their bytes, so the number of tasks follows it.
    tasks = min(MAX_TASKS, 1 + seen["n"] // VALUES_PER_TASK)
    meant = work.cut(cases.select("kv", "k", "v").distinct().repartition(tasks).mapInPandas(find, "kv string, canon_id bigint"), "meant")
    return skew_join(cases, meant, "kv").select("origin", "way_id", "k", "v", "canon_id")


def typed_values(way: DataFrame, landuse: DataFrame) -> DataFrame:
    """All tags of ``way`` and the ``landuse_type`` of ``landuse`` as origin, way_id, k, v."""
    tags = way.select(F.lit("way").alias("origin"), "way_id", F.explode("tags").alias("t")).select("origin", "way_id", "t.k", "t.v")
    return tags.unionByName(landuse.select(F.lit("landuse").alias("origin"), "way_id", F.lit("landuse").alias("k"), F.col("landuse_type").alias("v")))
