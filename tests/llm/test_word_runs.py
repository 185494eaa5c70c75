"""Shared runs of words against every window of 50 words."""

import numpy as np
from helpers import SCHEMA, invented, words

from folioscope.llm import queries, word_runs

LEAST = word_runs.LEAST


def covered(rows):
    """Places of words inside windows that another text has too, by document."""
    texts = {doc: (text, words(text)) for doc, text, *_ in rows}
    holders = {}
    for text, w in texts.values():
        for i in range(len(w) - LEAST + 1):
            holders.setdefault(tuple(w[i : i + LEAST]), set()).add(text)
    several = {t for t, _ in texts.values() if sum(t == x for x, _ in texts.values()) > 1}
    out = set()
    for doc, (text, w) in texts.items():
        for i in range(len(w) - LEAST + 1):
            if text in several or len(holders[tuple(w[i : i + LEAST])]) > 1:
                out |= {(doc, j) for j in range(i, i + LEAST)}
    return out


def found(df):
    return {(r.doc_id, j) for r in word_runs.repeated_runs(df).collect() for j in range(r.word, r.word + r.n_words)}


def broken(text, n):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def planted_rows():
    a, b = invented(1, 56), invented(2, 51)
    texts = [
        f"{invented(10, 30)}\n{broken(a, 6)}\n{invented(11, 20)}", f"{broken(a, 5)}", f"{invented(12, 21)} {a} {invented(13, 5)}",
        f"{invented(14, 44)} {b} {invented(15, 3)} {b}", f"{broken(b.upper(), 1)}\n{invented(16, 7)}", broken(invented(3, 60), 4),
        broken(invented(3, 60), 4), f"{invented(4, 49)} x", f"{invented(4, 49)} y", "z " * 80, "z " * 70, None, "",
    ]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_runs_across_lines_and_inside_sentences(spark):
    rows = planted_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == covered(rows)
    removed = {(r.doc_id, r.word, r.line, r.n_words, r.first_doc_id) for r in word_runs.repeated_runs(df).collect() if r.removed and r.doc_id < 9}
    assert removed == {(1, 0, 0, 56, 0), (2, 21, 0, 56, 0), (3, 98, 0, 51, 3), (4, 0, 0, 51, 3), (6, 0, 0, 60, 5)}


def test_query_reports_them(spark, tmp_path):
    spark.createDataFrame(planted_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in queries.op2(spark, str(tmp_path)).collect()}
    assert got >= {0, 1, 2, 3, 4, 5, 6}


def test_tables(documents, awkward, nothing):
    assert found(documents) == covered([tuple(r) for r in documents.collect()])
    ids = awkward.filter("doc_id is not null")
    assert found(ids) == covered([tuple(r) for r in ids.collect()])
    assert word_runs.repeated_runs(awkward).filter("doc_id is null").count() == 1
    assert found(nothing) == set()


def test_scripts_without_blanks(spark):
    passage = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    rows = [(i, f"{a}{passage}\n{b}", "ja", "s", 0) for i, (a, b) in enumerate([("日本", "語"), ("かな ", "x"), ("", "y z")])]
    got = word_runs.repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.word, r.n_words, r.removed) for r in got} == {(0, 2, 60, False), (1, 2, 60, True), (2, 0, 60, True)}


def rows_of(df):
    return sorted(map(tuple, word_runs.repeated_runs(df).collect()), key=str)


def test_a_row_holds_many_stretches_of_near_copies(spark, monkeypatch):
    base = broken(invented(7, 400), 9)
    texts = [base, *(f"{base[: 300 + 40 * i]} changed{i} {base[300 + 40 * i :]}\n{broken(invented(50 + i, 30), 7)}" for i in range(6)), "z " * 300, "z " * 200]
    df = spark.createDataFrame([(i if i != 3 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", 0)], SCHEMA)
    seen = []
    written = word_runs.written
    monkeypatch.setattr(word_runs, "written", lambda d, purpose: (seen.append((purpose, written(d, purpose))), seen[-1][1])[1])
    whole = rows_of(df)
    stored = {purpose: made.count() for purpose, made in seen}
    assert "stretches" not in stored and stored["segments"] < 250 * len(texts) / 4
    # The exact way for anchors of very many texts finds the same, also one anchor by one.
    monkeypatch.setattr(word_runs, "MOST_PLACES", 0)
    assert rows_of(df) == whole
    monkeypatch.setattr(word_runs, "MOST_PLACES", 6)
    monkeypatch.setattr(word_runs, "WORDS_AT_ONCE", 1)
    assert rows_of(df) == whole


def test_lowest():
    values = np.random.default_rng(4).integers(0, 5, 300).astype(np.uint64)
    for width in (1, 2, 8, 38, 39, 300):
        assert word_runs.lowest(values, width).tolist() == [i + min(range(width), key=lambda j: (values[i + j], j)) for i in range(301 - width)]  # noqa: B023
