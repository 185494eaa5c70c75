"""Secrets in texts, among them those that only their neighbours give away.

A credential has parts: an access identifier, a secret, an endpoint. Some parts show
what they are (a key assignment, a cloud access key, a long hexadecimal string) and are
always reported. Weak candidates are not: a user name, a short password, a random-looking
string, an address of a server. They are reported when complementary parts co-occur.

1. Parts are found in the whole text, each kind from left to right without overlaps.
2. A text's scopes are its blocks between blank lines. Parts and scopes are intervals of
   code points; a part belongs to the scope in which it begins.
3. An interval join links a weak part with a complementary part of its scope that begins or
   ends within ``REACH`` code points: identifiers with secrets, secrets with identifiers and
   endpoints, endpoints with secrets. Parts are sorted by where they begin, with running
   maxima of where they end, so each search is a bisection and no pairs are listed.
4. Rounds: first weak parts beside strong ones are accepted. Then a weak secret without any
   strong neighbour needs an identifier and an endpoint both; those two are accepted with it.

A weak secret inside a strong part is not reported apart. A document is one row and its parts
never leave the row, so nothing is shuffled. A NULL or empty text has no parts; repeated rows
are judged each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, fresh

#: Most code points between two parts of one credential.
REACH = 300
LEAST_BITS = 3.6

# Kinds in the order in which equal starts are listed: what they are part of, and whether they are reported anyway.
KINDS = {
    "assign": ("secret", True), "access": ("identifier", True), "hex": ("secret", True),
    "user": ("identifier", False), "pass": ("secret", False), "random": ("secret", False), "endpoint": ("endpoint", False),
}
PLACE = {kind: i for i, kind in enumerate(KINDS)}
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
USER = re.compile(
    r"""(?<![A-Za-z0-9])(?ai:user(?:_?(?:name|id))?|uid|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{2,64})(?![A-Za-z0-9])"""
)
PASS = re.compile(r"""(?<![A-Za-z0-9])(?ai:pass(?:word|wd|phrase)?|pwd|pin)["']?\x20*[:=]\x20*["']?([^\s"']{4,64})""")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(
    r"""(?<![A-Za-z0-9])(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{3,}"""
    r"""|(?ai:host(?:name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:_-]{3,}"""
    r"""|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}:\d{1,5}(?!\d))"""
)
BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


@dataclass
class Part:
    kind: str
    start: int
    end: int
    partner: Part | None = None

    @property
    def role(self) -> str:
        return KINDS[self.kind][0]

    @property
    def strong(self) -> bool:
        return KINDS[self.kind][1]


def looks_random(value: str) -> bool:
    """Letters of both cases and digits, spread over many characters."""
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_BITS


def base_parts(text: str) -> list[Part]:
    """Parts that are reported in any case, by kind."""
    # A run that is too short is passed over whole, as what follows it may depend on where it ends.
    parts = [Part("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        parts += [Part("access", *m.span()) for m in ACCESS.finditer(text)]
    return parts + [Part("hex", *m.span()) for m in HEX.finditer(text)]


class Intervals:
    """Parts in the order of their starts, for searches by distance."""

    def __init__(self, parts: list[Part]):
        self.parts = sorted(parts, key=lambda p: (p.start, p.end))
        self.starts = [p.start for p in self.parts]
        # The part with the furthest end so far.
        self.furthest: list[Part] = []
        for p in self.parts:
            self.furthest.append(p if not self.furthest or p.end > self.furthest[-1].end else self.furthest[-1])

    def near(self, part: Part, low: int, high: int) -> Part | None:
        """A part that begins in [low, high) and lies within reach, the one before it if there is one."""
        first = bisect_left(self.starts, low)
        behind = bisect_right(self.starts, part.start) - 1
        # Scopes don't share parts, so what ends furthest among those before began in this scope if it is near enough.
        if behind >= first and (before := self.furthest[behind]).start >= low and before.end >= part.start - REACH:
            return before
        after = behind + 1
        if after < len(self.starts) and self.starts[after] < high and self.starts[after] <= part.end + REACH:
            return self.parts[after]
        return None


def weak_parts(text: str, base: list[Part]) -> list[Part]:
    """Candidates that need a complement; none lies inside a strong part."""
    found = [Part("user", *m.span()) for m in USER.finditer(text)]
    found += [Part("pass", *m.span()) for m in PASS.finditer(text)]
    found += [Part("random", *m.span()) for m in RANDOM.finditer(text) if looks_random(m[0])]
    found += [Part("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    strong = Intervals(base)
    free = []
    for p in found:
        at = bisect_left(strong.starts, p.end) - 1
        if at < 0 or strong.furthest[at].end <= p.start:
            free.append(p)
    return free


def scopes(text: str) -> list[int]:
    """Where the blocks between blank lines begin."""
    return [0, *(m.end() for m in BLANK_LINES.finditer(text))]


def linked(parts: list[Part], borders: list[int], size: int) -> list[Part]:
    """The strong parts, and the weak ones that have complements within their scope and reach."""
    strong = [p for p in parts if p.strong]
    weak = [p for p in parts if not p.strong]
    if not weak:
        return strong
    sure = {role: Intervals([p for p in strong if p.role == role]) for role in COMPLEMENTS}
    maybe = {role: Intervals([p for p in weak if p.role == role]) for role in COMPLEMENTS}

    def nearest(table: dict[str, Intervals], part: Part, role: str) -> Part | None:
        at = bisect_right(borders, part.start) - 1
        return table[role].near(part, borders[at], borders[at + 1] if at + 1 < len(borders) else size + 1)

    for p in weak:
        p.partner = next((x for r in COMPLEMENTS[p.role] if (x := nearest(sure, p, r))), None)
    for p in maybe["secret"].parts:
        if p.partner is None:
            both = [nearest(maybe, p, role) for role in COMPLEMENTS["secret"]]
            if all(both):
                p.partner = both[0]
                for other in both:
                    other.partner = other.partner or p
    return strong + [p for p in weak if p.partner]


def credentials(text: str | None) -> list[Part]:
    """The parts of a text that are reported, by start and kind."""
    if not text:
        return []
    base = base_parts(text)
    found = linked(base + weak_parts(text, base), scopes(text), len(text))
    return sorted(found, key=lambda p: (p.start, PLACE[p.kind], p.end))


PARTS = "array<struct<kind string, start bigint, `end` bigint, partner_kind string, partner_start bigint>>"


def with_credentials(documents: DataFrame, text: str = "text", out: str = "credentials") -> DataFrame:
    """Every row with its reported parts and, for weak ones, the part that gives them away."""

    def work(columns: list[list]) -> list[list]:
        return [[[
            {"kind": p.kind, "start": p.start, "end": p.end, "partner_kind": p.partner and p.partner.kind,
             "partner_start": p.partner and p.partner.start}
            for p in credentials(t)
        ] for t in columns[0]]]

    scanned = fresh(documents, "_scanned")
    plain = documents.withColumn(scanned, F.col(text).cast("string"))
    return append_columns(plain, [scanned], work, f"`{out}` {PARTS}").drop(scanned)


def digest(documents: DataFrame) -> DataFrame:
    """Counts of the strong kinds, a hash of their spans and all reported spans of every document."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_credentials(narrow).drop("text")
    strong = [k for k, (_, sure) in KINDS.items() if sure]
    span = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of_kinds = lambda kinds: F.filter("credentials", lambda x: x["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *(F.size(of_kinds([k])).cast("long").alias(f"n_{k}") for k in strong),
        F.sha2(F.array_join(F.transform(of_kinds(strong), span), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("credentials", span), ",").alias("spans"),
        F.size(of_kinds([k for k in KINDS if k not in strong])).cast("long").alias("n_linked"),
    )
