"""Counts and ids against the vocabulary's own library."""

import time
import zlib

import numpy as np
import pytest
from helpers import awkward_rows, edited, invented
from tokenizers import Tokenizer

from folioscope.llm import packing, tokens
from folioscope.llm.bpe import counter

PATH = tokens.vocabulary_path()
ODD = [
    "It's d'r 'rest x  ý İ ΑΣ ß", "a<|endoftext|>b", "étude  café́ \x1c x\x1dy\x1e\x1f", "日本語テキスト 한국어 ไทย",
    "''s 'S 'll'd 'LL!!!'s..'ve've", "a b c ١٢٣ ²½ ªº", "", " \n ", "x" * 900, "ﬁ Ⅷ ǅ ẞ 'ſ", "é" * 50,
    "<|startoftext|><|endoftext|> <|endoftext", "!!<|endoftext|>x's<|startoftext|>'s<|endof<|endoftext|>1", "日本語" * 15 + "\uf900語",
    "İstanbul\u212bİİ''s" + "日" * 9, "<|ENDOFTEXT|>é<|endoftext|>e\u0301<|endoftext|>", "ΑΣİΣ<|startoftext|>ß\u1e9e",
    "\U0001F600\U0001F469‍\U0001F469 x", "Don'T stop—ever…",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", [*ODD, invented(1, 80), edited(invented(2, 60), 3, 9).upper()])
def test_every_prefix(library, text):
    steps = counter(PATH).steps([text])[0]
    expected = [len(e.ids) for e in library.encode_batch([text[: i + 1] for i in range(len(text))], add_special_tokens=False)]
    assert tokens.prefix_counts(steps).tolist() == expected


@pytest.mark.parametrize("odd", ["\uf900", "<|endoftext|>", "İ"])
def test_long_chunks_take_time_in_proportion(library, odd):
    text = "日本語" * 5_000 + odd + "語" * 100
    started = time.process_time()
    steps = counter(PATH).steps([text])[0]
    assert time.process_time() - started < 20
    counts = tokens.prefix_counts(steps)
    for n in (7, 15_000, 15_001, 15_005, len(text)):
        assert counts[n - 1] == len(library.encode(text[:n], add_special_tokens=False).ids)


def test_digest(spark, awkward, nothing, library):
    limit = 100
    rows = tokens.token_digest(awkward, PATH, limit).collect()
    assert len(rows) == awkward.count() and not tokens.token_digest(nothing, PATH, limit).collect()
    texts = {}
    for r in awkward_rows():
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in rows:
        assert any(
            r.n_bytes == len(t.encode()) and r.n_tokens == len(library.encode(t, add_special_tokens=False).ids)
            and r.over_limit == (r.n_tokens > limit) for t in texts[r.doc_id]
        )
        text = texts[r.doc_id][0]
        if len(texts[r.doc_id]) == 1 and r.over_limit and len(text) < 5_000:
            counts = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
            assert r.fitting_chars == max(n for n, c in enumerate(counts) if c <= limit)


def test_stored_counts_answer(spark, library):
    text = invented(5, 40)
    df = spark.createDataFrame([(1, text, 33), (2, None, 4), (3, "ab", 99)], "id int, text string, chars int")
    stored = tokens.with_prefix_counts(df, "text", PATH)
    at = {r.id: r.tokens_at for r in tokens.count_at(stored, "chars").collect()}
    assert at == {1: len(library.encode(text[:33], add_special_tokens=False).ids), 2: 0, 3: 1}
    cut = tokens.answers(stored, 20).withColumn("cut", tokens.cut_to_budget("text", tokens.F.col("fitting_chars")))
    kept = {r.id: r.cut for r in cut.collect()}
    assert len(library.encode(kept[1], add_special_tokens=False).ids) <= 20 and text.startswith(kept[1])
    assert kept[3] == "ab"


def check_packing(rows, texts, library, capacity):
    """Every id is in one place, and the sequences are gapless."""
    used, sequences = {}, {}
    for r in rows:
        used.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    whole = 0
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        whole += len(ids)
        starts = range(0, len(ids), capacity)
        want = sorted((k, s, zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(starts))
        have = sorted((r.piece, r.start, r.ids_crc32) for r in used[doc])
        assert all(have.count(w) >= 1 for w in want)
    assert sum(r.length for r in rows) == whole
    return len(sequences), -(-whole // capacity)


def test_packing(documents, awkward, nothing, library):
    for table in (documents, awkward):
        texts = [(r.doc_id, r.text) for r in table.collect()]
        made, least = check_packing(packing.pack(table, PATH, 2048).collect(), texts, library, 2048)
        assert made <= least + 2
    assert not packing.pack(nothing, PATH, 2048).collect()


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 257, 60), rng.integers(1, 4_000, 60))}
    chosen = packing.plan(counts, 256)
    held = {}
    for items, many in chosen:
        assert sum(items) <= 256 and many > 0
        for n in items:
            held[n] = held.get(n, 0) + many
    assert held == counts
    bins, filled = sum(m for _, m in chosen), sum(n * c for n, c in counts.items())
    assert bins <= max(1.05 * filled / 256 + 3, sum(c for n, c in counts.items() if n > 128) * 1.02 + filled / 256 * 0.2)
