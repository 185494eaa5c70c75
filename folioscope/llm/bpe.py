"""Token counts of every prefix of a word by dynamic programming over a byte-pair vocabulary.

A sequence of tokens is what byte-pair merging gives exactly if each two
neighbours are what it gives for their joint text. So the encoding of a prefix
is the encoding of a shorter prefix and one more token, and exactly one last
token fits. ``open_last`` holds that token for prefixes inside a word; the last
token of a finished prefix carries the vocabulary's word-end mark.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import Counter
from itertools import accumulate
from operator import sub

import regex

from .common import bounded, worker_cache

END = "</w>"
# Texts of these characters are in composed form and keep their length in lower case.
PLAIN = re.compile("[\x00-\x7f\xa1-\xac\xae-\xff–—‘’“”…€]*")
CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
SPACE = regex.compile(r"\s")
CHUNKS = regex.compile(r"[^\s]+|\s+")
PAIRS_KEPT, WORDS_KEPT, CHUNKS_KEPT = 400_000, 1_200_000, 1_000_000
NEVER = 1 << 30


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class PrefixCounter:
    """Counts for prefixes of texts, with what was learned about words kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in whole["added_tokens"]]
        self.split = regex.compile(next(
            p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        ))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.letters = byte_letters()
        # Only tokens that merging can reach count as candidates.
        self.inner, self.final = {}, {}
        for token, number in model["vocab"].items():
            if token in self.special:
                continue
            closed = token.endswith(END) and token != END
            text = token[: -len(END)] if closed else token
            (self.final if closed else self.inner)[text] = number
        # Common lengths first: exactly one candidate fits, so the order is free.
        often = Counter(map(len, [*self.inner, *self.final]))
        self.lengths = sorted(often, key=lambda n: (abs(n - 2.6), n))
        self.open_pairs: dict = {}
        self.final_pairs: dict = {}
        self.made: dict = {}
        self.words: dict = {}
        self.chunks: dict = {}

    def merged(self, parts: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging of a short text, and the last pair that was merged."""
        last = None
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, NEVER))
            if best not in self.rank:
                break
            joined, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [*best]:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts, last = joined, best
        return parts, last

    def origin(self, token: str) -> tuple[int, str, str] | None:
        """Rank and parts of the merge that makes a token; None if its text never becomes it."""
        found = self.made.get(token, 0)
        if found == 0:
            closed = token.endswith(END) and token != END
            parts = list(token[: -len(END)] if closed else token)
            if closed:
                parts[-1] += END
            whole, last = self.merged(parts)
            found = None
            if whole == [token]:
                found = (self.rank[last], *last) if last else (-1, "", "")
            self.made[token] = found
        return found

    def fits(self, before: str, token: str) -> bool:
        """Whether merging leaves ``token`` after ``before``; nothing is before a word's first token.

        Merges are undone from the last back: the two parts at the border must
        never have been joined before one of them became part of its token.
        """
        if self.origin(token) is None:
            return False
        if not before:
            return True
        rank, left, right, until = self.rank, before, token, NEVER
        while rank.get((left, right), NEVER) >= until:
            a, b = self.origin(left), self.origin(right)
            if a[0] > b[0]:
                until, left = a[0], a[2]
            elif b[0] >= 0:
                until, right = b[0] + 1, b[1]
            else:
                return True
        return False

    def words_counts(self, words: list[str]):
        """Token counts of each prefix of each word, taken as a finished word.

        Words are letters for bytes, best in sorted order: what a word shares
        with the start of the one before is not worked out again.
        """
        inner, final, lengths = self.inner, self.final, self.lengths
        open_known, final_known = bounded(self.open_pairs, PAIRS_KEPT), bounded(self.final_pairs, PAIRS_KEPT)
        previous, open_last, open_count, counts = "", [""], [0], [0]
        for word in words:
            size, same = len(word), 0
            for x, y in zip(word, previous):
                if x != y:
                    break
                same += 1
            del open_last[same + 1 :], open_count[same + 1 :], counts[same + 1 :]
            for end in range(same + 1, size + 1):
                in_count = out_count = 0
                last = ""
                for length in lengths:
                    start = end - length
                    if start < 0:
                        continue
                    piece = word[start:end]
                    if not out_count and piece in final:
                        key = (open_last[start], piece)
                        fit = final_known.get(key)
                        if fit is None:
                            fit = final_known[key] = self.fits(key[0], piece + END)
                        if fit:
                            out_count = open_count[start] + 1
                            if in_count:
                                break
                    if not in_count and piece in inner:
                        key = (open_last[start], piece)
                        fit = open_known.get(key)
                        if fit is None:
                            fit = open_known[key] = self.fits(*key)
                        if fit:
                            in_count, last = open_count[start] + 1, piece
                            if out_count:
                                break
                open_last.append(last)
                open_count.append(in_count)
                counts.append(out_count)
            previous = word
            yield counts

    def learn_words(self, pretokens: set[str]) -> None:
        """Work out the changes of the count at each character of pre-tokens not met before."""
        known = bounded(self.words, WORDS_KEPT)
        fresh = {p: p.encode() for p in pretokens.difference(known)}
        letters = sorted(("".join([self.letters[b] for b in raw]), p) for p, raw in fresh.items())
        for (_, text), counts in zip(letters, self.words_counts([x for x, _ in letters])):
            if len(fresh[text]) != len(text):
                ends = [0]
                for c in text:
                    ends.append(ends[-1] + len(c.encode()))
                counts = [counts[end] for end in ends]
            known[text] = _changes(counts)

    def _by_library(self, chunk: str) -> list[int]:
        out = []
        for start in range(0, len(chunk), 512):
            prefixes = [chunk[: i + 1] for i in range(start, min(start + 512, len(chunk)))]
            out += [len(e.ids) for e in self.library.encode_batch(prefixes, add_special_tokens=False)]
        return out

    def _pretokens(self, chunk: str) -> list[str] | None:
        """Pre-tokens of a text without white space; None where prefixes change what is before them."""
        if PLAIN.fullmatch(chunk):
            return self.split.findall(chunk.lower())
        composed = [unicodedata.normalize("NFC", c) for c in chunk]
        if any(len(c) != 1 for c in composed) or not unicodedata.is_normalized("NFC", "".join(composed)):
            return None
        return self.split.findall("".join([c.lower() for c in composed]))

    def _segments(self, chunk: str) -> list[tuple[str, int | None]]:
        """Parts without special strings; one that runs up to such a string has it but for its last character.

        The number says where the string begins. Until it is whole it is ordinary text.
        """
        found, rest = [], chunk
        while rest:
            hits = [(rest.find(s), -len(s), s) for s in self.special if s in rest]
            if not hits:
                found.append((rest, None))
                break
            start, _, string = min(hits)
            found.append((rest[:start] + string[:-1], start))
            rest = rest[start + len(string) :]
        return found

    def _steps(self, text: str, tokens: list[str] | None) -> array:
        """Changes of the count at each character of a text without special strings or white space."""
        if tokens is None:
            return array("h", _changes([0, *self._by_library(text)]))
        steps = array("h")
        for token in tokens:
            own = self.words[token]
            if len(token) > 2 and CONTRACTION.fullmatch(token):
                steps.extend((1, 1, sum(array("h", own)) - 2))
            else:
                steps.frombytes(own)
        if len(steps) != len(text):
            # A character may be several in lower case.
            ends = list(accumulate(len(unicodedata.normalize("NFC", c).lower()) for c in text))
            steps = array("h", [sum(steps[a:b]) for a, b in zip([0, *ends], ends)])
        return steps

    def learn(self, pieces: set[str]) -> None:
        """Work out the changes of the count at each character of texts between blanks."""
        known, simple, other = self.chunks, [], []
        for p in pieces:
            # Most are letters, with a sign behind them or none.
            if p.isalpha() and PLAIN.fullmatch(p):
                simple.append((p, p.lower(), ""))
            elif p[:-1].isalpha() and p[-1] in ".,|;:" and PLAIN.fullmatch(p):
                simple.append((p, p[:-1].lower(), p[-1]))
            else:
                other.append((p, CHUNKS.findall(p)))
        parts = {w: self._segments(w) for _, cut in other for w in cut if not SPACE.match(w)}
        texts = {t: self._pretokens(t) for found in parts.values() for t, _ in found}
        wanted = {t for tokens in texts.values() for t in tokens or ()}
        # A contraction that is cut short is a sign and a letter of its own.
        wanted |= {t[1] for t in wanted if CONTRACTION.fullmatch(t)} | {"'", *".,|;:"}
        wanted.update([w for _, w, _ in simple])
        self.learn_words(wanted)
        found = self.words
        for p, word, sign in simple:
            known[p] = found[word] + found[sign] if sign else found[word]
        for p, cut in other:
            steps = array("h")
            for word in cut:
                if word not in parts:
                    steps.frombytes(bytes(2 * len(word)))
                for text, special in parts.get(word, ()):
                    own = self._steps(text, texts[text])
                    steps.extend(own)
                    if special is not None:
                        # The string is one token now, and what was made of its beginning is gone.
                        steps.append(sum(own[:special]) + 1 - sum(own))
            known[p] = steps.tobytes()

    def steps(self, texts: list[str]) -> list[bytes]:
        """Change of the token count at each character of each text, as 16-bit numbers.

        Running sums are the counts of the prefixes. No token crosses a blank.
        """
        pieces = [t.split(" ") for t in texts]
        known = bounded(self.chunks, CHUNKS_KEPT)
        self.learn(set().union(*pieces).difference(known))
        return [b"\0\0".join(map(known.__getitem__, p)) for p in pieces]


def _changes(counts: list[int]) -> bytes:
    return array("h", map(sub, counts[1:], counts)).tobytes()


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a vocabulary file."""
    cache = worker_cache("prefix_counters")
    if path not in cache:
        cache[path] = PrefixCounter(path)
    return cache[path]
