"""Test items inside training texts: a BM25 index of the items, searched with block-max WAND.

Items are indexed by runs of three words. Every passage of every text, windows
that overlap by half and are at least twice as long as the longest item, is a
query. A score is a share: what an item's own text would score is one. Block
maxima and the upper bounds of the lists let the search skip items that can't
reach the threshold, and return all others. Then runs of five words of the
item's question and of its answer, its last sentence, are looked up in the
whole text. An item is in a text if 0.8 of all of its runs are.

Words are runs of letters and digits, and signs beyond ASCII, in lower case, so
spacing, case and punctuation don't matter. Items of fewer words are indexed and
looked up by runs of as many. NULL or empty texts and items match nothing.
Repeated items and texts match each. Indexes are built for a bounded number of
items at a time; a longer list of items takes several passes.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, fresh, map_slices
from .shingles import windows, word_hashes

K1, B = 1.2, 0.75
TERM_WORDS, RUN_WORDS = 3, 5
BLOCK = 64
#: Most items in an index, which is sent to every executor.
INDEX_ITEMS = 20_000
LEAST_WINDOW = 128
# ASCII letters in lower case, digits, and everything beyond ASCII; the rest parts words.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")
PAIRS = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, overlap double"


def plain_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words without case and signs."""
    return word_hashes(text.translate(PLAIN).split()) if text else np.zeros(0, np.uint64)


class ItemIndex:
    """Lists of items by run of words, with impacts as shares of an item's own score."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.names, self.runs, terms = [], [], []
        for name, text in items:
            whole = plain_hashes((text or "").encode())
            if not len(whole):
                continue
            answer = plain_hashes(_answer(text).encode())
            question = whole[: len(whole) - len(answer)] if len(answer) < len(whole) else whole
            width = min(RUN_WORDS, len(whole))
            self.names.append(name)
            self.runs.append((width, np.unique(windows(whole, width)), _part(question, width), _part(answer, width)))
            short = min(TERM_WORDS, len(whole))
            terms.append(Counter((short, t) for t in windows(whole, short).tolist()))
        sizes = [sum(t.values()) for t in terms]
        mean = sum(sizes) / max(1, len(sizes))
        holders = Counter(k for t in terms for k in t)
        lists: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for item, (own, size) in enumerate(zip(terms, sizes)):
            impacts = {}
            for k, n in own.items():
                rarity = math.log(1 + (len(terms) - holders[k] + 0.5) / (holders[k] + 0.5))
                impacts[k] = rarity * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean))
            whole = sum(impacts.values())
            for k, x in impacts.items():
                lists[k].append((item, x / whole))
        self.window = max(LEAST_WINDOW, 2 * max(sizes, default=0) + 2 * TERM_WORDS)
        self.widths = sorted({w for w, _ in lists})
        self.keys, self.lists = {}, {}
        for w in self.widths:
            mine = sorted(k for k in lists if k[0] == w)
            self.keys[w] = np.array([t for _, t in mine], np.uint64)
            self.lists[w] = [self._blocks(lists[k]) for k in mine]

    @staticmethod
    def _blocks(postings: list[tuple[int, float]]) -> tuple:
        """Items, impacts, last item and greatest impact of each block, and greatest impact of all."""
        items, impacts = [p[0] for p in postings], [p[1] for p in postings]
        blocks = range(0, len(items), BLOCK)
        return (items, impacts, [items[min(b + BLOCK, len(items)) - 1] for b in blocks],
                [max(impacts[b : b + BLOCK]) for b in blocks], max(impacts))

    def above(self, terms: list[tuple], threshold: float) -> dict[int, float]:
        """All items with at least the threshold for a query of lists, by block-max WAND."""
        cursors = [[lst[0][0], 0, lst] for lst in terms]  # current item, place, list
        found: dict[int, float] = {}
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2][4]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block_bound, next_item = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in cursors[: pivot + 1]:
                # The block that would hold the item, from the cursor's own on.
                b = c[1] // BLOCK
                while b < len(c[2][2]) and c[2][2][b] < item:
                    b += 1
                if b < len(c[2][2]):
                    block_bound += c[2][3][b]
                    next_item = min(next_item, c[2][2][b] + 1)
            if block_bound < threshold:
                target = max(next_item, item + 1)
            elif cursors[0][0] == item:
                score = sum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found[item] = score
                target = item + 1
            else:
                target = item
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    items, place = c[2][0], c[1]
                    while place < len(items) and items[place] < target:
                        # Whole blocks that end before the target are skipped.
                        b = place // BLOCK
                        place = (b + 1) * BLOCK if c[2][2][b] < target else place + 1
                    c[1] = place
                    c[0] = items[place] if place < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def search(self, hashes: np.ndarray, threshold: float) -> dict[int, float]:
        """Best score of each item that a passage of a text retrieves."""
        best: dict[int, float] = {}
        hits: list[tuple[np.ndarray, int, np.ndarray]] = []
        for w in self.widths:
            runs = windows(hashes, w) if len(hashes) >= w else hashes[:0]
            keys = self.keys[w]
            at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            where = np.flatnonzero(keys[at] == runs)
            if len(where):
                hits.append((where, w, at[where]))
        if not hits:
            return best
        step = self.window // 2
        passages: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for where, w, at in hits:
            for place, k in zip((where // step).tolist(), at.tolist()):
                passages[place].add((w, k))
                if place:
                    passages[place - 1].add((w, k))
        for terms in passages.values():
            for item, score in self.above([self.lists[w][k] for w, k in terms], threshold).items():
                best[item] = max(score, best.get(item, 0.0))
        return best

    def matches(self, text: bytes | None, threshold: float, share: float) -> list[tuple]:
        """Items in a text: id, score, overlap of question, of answer and of both."""
        hashes = plain_hashes(text)
        found, runs = [], {}
        for item, score in sorted(self.search(hashes, threshold).items()):
            width, *parts = self.runs[item]
            if width not in runs:
                runs[width] = np.unique(windows(hashes, width)) if len(hashes) >= width else hashes[:0]
            whole, question, answer = (_inside(p, runs[width]) for p in parts)
            if whole >= share:
                found.append((self.names[item], score, question, answer, whole))
        return found


def _answer(text: str) -> str:
    """The last sentence, if there are several."""
    parts = [p for p in SENTENCE.split(text.strip()) if p]
    return parts[-1] if len(parts) > 1 else ""


def _part(hashes: np.ndarray, width: int) -> np.ndarray:
    return np.unique(windows(hashes, width)) if len(hashes) >= width else hashes[:0]


def _inside(part: np.ndarray, runs: np.ndarray) -> float:
    """Share of runs that a text has; a part too short for a run is no obstacle."""
    return float(np.isin(part, runs, assume_unique=True).mean()) if len(part) else 1.0


def _indexes(items: DataFrame):
    """Broadcast indexes of bounded size that together hold every item."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    shards = -(-rows.count() // INDEX_ITEMS)
    for shard in range(shards):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard) if shards > 1 else rows
        made = ItemIndex([tuple(r) for r in mine.collect()])
        yield items.sparkSession.sparkContext.broadcast(made.__dict__)


def _index(shared) -> ItemIndex:
    made = ItemIndex.__new__(ItemIndex)
    made.__dict__.update(shared.value)
    return made


def leaks(documents: DataFrame, items: DataFrame, threshold: float = 0.5, share: float = 0.8) -> DataFrame:
    """One row for each document and test item in it."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    found = documents.sparkSession.createDataFrame([], PAIRS)
    for shared in _indexes(items):

        def work(columns: list[list], shared=shared) -> list[list]:
            index = _index(shared)
            made = [(d, *m) for d, t in zip(*columns) for m in index.matches(t, threshold, share)]
            return [list(c) for c in zip(*made)] if made else [[] for _ in range(6)]

        found = found.union(map_slices(rows, work, PAIRS))
    return found


def without_leaks(documents: DataFrame, items: DataFrame, threshold: float = 0.5, share: float = 0.8) -> DataFrame:
    """The documents that hold no test item; nothing is shuffled."""
    kept, names = documents, documents.columns
    searched, clean = fresh(documents, "_searched"), fresh(documents, "_clean")
    for shared in _indexes(items):

        def work(columns: list[list], shared=shared) -> list[list]:
            index = _index(shared)
            return [[not index.matches(t, threshold, share) for t in columns[0]]]

        raw = kept.withColumn(searched, F.col("text").cast("string").cast("binary"))
        kept = append_columns(raw, [searched], work, f"`{clean}` boolean").filter(F.col(clean)).select(*names)
    return kept
