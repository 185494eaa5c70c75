"""Brute-force versions and a table with every awkward row."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=True):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(sets, percent):
    """Smallest id of everything reachable, by comparing all pairs."""
    names = sorted(sets)
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in names}


def invented(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abdeginorst", k=rng.randint(2, 8))) for _ in range(n))


def edited(text, seed, edits):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = invented(rng.random(), 1)
    return " ".join(w)


def awkward_rows():
    """Nulls, empty and very long texts, equal rows, near copies, odd characters."""
    base, line = invented(1, 120), invented(2, 60)
    texts = [
        None, "", "   \n\t ", "a", "two words", base, base, base.upper(), *(edited(base, s, s % 4) for s in range(9)),
        f"{invented(3, 30)}\n{line}\n{invented(4, 20)}", f"{line}\n{invented(5, 40)}", edited(line, 6, 1),
        "x" * 20_000, invented(7, 12_000), "é ñ ß 日本語 😀 \x00 \x1c   <|endoftext|> don't 'S", "ab " * 500,
    ]
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 2 else f"s{i % 2}", None) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], rows[-1], (None, base, "en", "s0", 1), (None, None, None, None, None)]
