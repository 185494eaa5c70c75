"""Few full sequences from many documents: a configuration linear program over the length histogram.

Each document becomes its token ids and an end id. Only what is longer than a
sequence is cut. The histogram of piece lengths, at most one row per length, is
all that the driver sees. There the linear program over configurations (which
lengths share a sequence) is solved by multiplicative weights: prices per
length, a knapsack table that finds for every length the dearest configuration
with it, and a rise of the prices of lengths that are covered too little. Whole
parts of the solution are kept; what is left is packed best fit by counts.
Pieces then take their places by their rank among the pieces of their length.

A NULL or empty text is the end id alone. Repeated rows are documents of their
own. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, map_slices, text_of, worker_cache, written

ROUNDS, RATE = 40, 0.3
#: Bytes of ids of words that a worker keeps.
BYTES_KEPT = 160_000_000
# A sign that follows a letter or digit and stands before white space or the end.
SIGN_AT_END = re.compile(r"([.,;:|])(?<=[^\W_].)(?=\s|\Z)")
BUCKET_ROWS = 20_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Token ids of whole texts, put together from those of the parts between blanks."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in whole["added_tokens"]]
        steps = whole["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in steps if p["type"] == "Split"))
        self.plain = re.compile("[\x00-\x1b\x20-\x7f\xa1-\xac\xae-\xff–—‘’“”…€]*")
        vocabulary = whole["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.known = Recent(BYTES_KEPT)

    def parts(self, text: str) -> list[str]:
        """Parts whose ids in a row are those of the text: white space separates pre-tokens.

        A sign behind a letter or digit and before white space is a pre-token of its own, so a
        blank may stand before it. Case goes here where lower case keeps the characters' number.
        """
        if self.plain.fullmatch(text):
            lower = text.lower()
            if not any(s in lower for s in self.special):
                return SIGN_AT_END.sub(r" \1", lower).replace("\n", " ").split(" ")
        return text.split(" ")

    def learn(self, fresh: set[str]) -> None:
        """Ids of parts not met before; those in letters by one call of the library."""
        simple, other, cut = [], [], []
        for p in fresh:
            if not self.plain.fullmatch(p) or any(s in p for s in self.special):
                other.append(p)
            elif p.isalpha() and p.islower():
                simple.append(p)
            else:
                cut.append((p, self.split.findall(p.lower())))
        words = self._words({w for _, found in cut for w in found}.union(simple))
        for p in simple:
            self.known.add(p, words[p])
        for p, found in cut:
            self.known.add(p, b"".join([words[w] for w in found]))
        for p, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False)):
            self.known.add(p, np.array(e.ids, "<u4").tobytes())

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens in lower case."""
        fresh = list(words)
        # A pre-token ends with the only token of it that carries an end mark.
        ids = np.array(self.library.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
        raw, borders = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        return {word: raw[a:b] for word, a, b in zip(fresh, borders, borders[1:])}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as unsigned little-endian 32-bit numbers."""
        parts = [self.parts(t) for t in texts]
        self.learn(self.known.missing(set().union(*parts)))
        known = self.known.young
        return [b"".join(map(known.__getitem__, p)) for p in parts]


def encoder(path: str) -> Encoder:
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def pieces(documents: DataFrame, path: str, capacity: int) -> DataFrame:
    """Every document's ids with an end id, cut where they exceed a sequence."""

    def work(columns: list[list]) -> list[list]:
        rows = []
        for doc, ids in zip(columns[0], encoder(path).ids([t or "" for t in columns[1]])):
            ids += b"\0\0\0\0"
            for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)]

    return map_slices(documents.select(F.col("doc_id").cast("long"), text_of("text")), work, PIECES)


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The length to take next for each capacity, so that what is taken is dearest; 0 where none fits."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        if n:
            worth = best[room - lengths[:n]] + prices[:n]
            at = int(worth.argmax())
            best[room], take[room] = worth[at], lengths[at]
    return take


def configurations(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], float]:
    """How often to use each configuration, as a nearly best solution of the linear program."""
    lengths = np.array(sorted(counts))
    demand = np.array([counts[n] for n in lengths.tolist()], float)
    at = {n: i for i, n in enumerate(lengths.tolist())}
    weights, covered = np.ones(len(lengths)), np.zeros(len(lengths))
    used: dict[tuple[int, ...], float] = defaultdict(float)
    for turn in range(1, ROUNDS + 1):
        take = _knapsack(weights * lengths / capacity, lengths, capacity).tolist()
        need = turn / ROUNDS * demand - covered
        for n in reversed(lengths.tolist()):
            if need[at[n]] <= 0:
                continue
            chosen, room = [n], capacity - n
            while take[room]:
                chosen.append(take[room])
                room -= take[room]
            amount = need[at[n]] / chosen.count(n)
            used[tuple(sorted(chosen, reverse=True))] += amount
            for x in chosen:
                need[at[x]] -= amount
                covered[at[x]] += amount
        weights *= np.exp(-RATE * np.clip(covered * ROUNDS / (turn * demand) - 1, -1, 1))
        weights /= weights.max()
        weights = np.maximum(weights, 1e-6)
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of sequences for each configuration; they hold every piece exactly once."""
    left = {n: c for n, c in counts.items() if n < capacity}
    chosen = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    if not left:
        return chosen
    solved = configurations(left, capacity)
    # The fullest first: what the rest covers twice is trimmed.
    for items, amount in sorted(solved.items(), key=lambda x: (-sum(x[0]), x[0])):
        whole = min([int(amount), *(left[n] // items.count(n) for n in set(items))])
        if whole:
            chosen.append((items, whole))
            for n in items:
                left[n] -= whole
    return chosen + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit from the longest down, over counts of equal pieces and of equally filled sequences."""
    filled: dict[int, list[list]] = defaultdict(list)  # by room: configurations and how many there are
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], many: int) -> None:
        if not filled[room]:
            insort(rooms, room)
        filled[room].append([items, many])

    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = min(capacity // n, todo)
                many = todo // each
                put(capacity - each * n, (n,) * each, many)
                todo -= each * many
                continue
            room = rooms[at]
            items, many = filled[room].pop()
            if not filled[room]:
                rooms.pop(at)
            each = min(room // n, todo)
            moved = min(many, todo // each)
            if moved < many:
                put(room, items, many - moved)
            put(room - each * n, items + (n,) * each, moved)
            todo -= each * moved
    return [(items, many) for group in filled.values() for items, many in group]


def _places(chosen: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks of runs of places, and each run's sequence, places a sequence and offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for items, many in chosen:
        offset = 0
        for n in sorted(set(items), reverse=True):
            each = items.count(n)
            runs[n].append((taken[n], sequence, each, offset))
            taken[n] += each * many
            offset += each * n
        sequence += many
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack(documents: DataFrame, path: str, capacity: int) -> DataFrame:
    """One row for each piece, with its sequence and place."""
    spark = documents.sparkSession
    cut = written(pieces(documents, path, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    buckets = max(16, sum(histogram.values()) // BUCKET_ROWS)
    # Ranks among equal lengths: buckets are ranked apart, and the sizes of those before are added.
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    starts = sizes.select(
        "length", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank")
    )

    def work(columns: list[list]) -> list[list]:
        *kept, ranks = columns
        sequences, offsets = [], []
        for n, rank in zip(kept[3], ranks):
            first, sequence, each, offset = places.value[n]
            run = int(np.searchsorted(first, rank, "right")) - 1
            copy, place = divmod(rank - int(first[run]), int(each[run]))
            sequences.append(int(sequence[run]) + copy)
            offsets.append(int(offset[run]) + place * n)
        return [*kept, sequences, offsets]

    return map_slices(ranked, work, f"{PIECES}, sequence_id bigint, offset bigint")
