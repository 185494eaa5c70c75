"""Decontamination, fixity and the pipeline."""

import random
import re

import pytest
from helpers import SCHEMA, edited, invented
from test_near_dedup import expected as groups
from test_tokens_packing import PATH, Tokenizer, check_packing

import corpus_pipeline
from folioscope.llm import decontaminate, fixity, pseudonyms, toxicity

SF = "/root/testdata/sf0.001"


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text).split()


def runs(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def contained(docs, items):
    out = set()
    for doc, text in docs:
        w = plain(text)
        for item, q in items:
            own = runs(plain(q), min(5, len(plain(q)))) if plain(q) else set()
            if own and len(own & runs(w, min(5, len(plain(q))))) >= 0.8 * len(own):
                out.add((doc, item))
    return out


def found(docs, items):
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}


def test_leaks(spark, monkeypatch, documents, items, awkward, nothing):
    pairs = [(r.item_id, r.text) for r in items.collect()]
    want = contained([(r.doc_id, r.text) for r in documents.collect()], pairs)
    assert found(documents, items) == want and want
    q = invented(1, 30) + ". " + invented(2, 6) + "."
    own = spark.createDataFrame([(1, q), (2, "two words"), (3, None), (4, ""), (1, q), (5, invented(7, 300))], "item_id long, text string")
    rows = [(1, f"{invented(3, 400)} {q.upper()} {invented(4, 90)}", "", "", 0), (2, edited(q, 5, 1), "", "", 0),
            (3, " ".join(q.split()[:20]), "", "", 0), (4, "these two, words", "", "", 0), (5, None, "", "", 0),
            (6, f"{invented(8, 64)} {invented(7, 300)}", "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = contained([(r[0], r[1]) for r in rows], [(r.item_id, r.text) for r in own.collect()])
    assert found(docs, own) == want == {(1, 1), (2, 1), (4, 2), (6, 5)}
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 2)
    assert found(docs, own) == want
    kept = decontaminate.without_leaks(docs.withColumn("_clean", docs.doc_id), own)
    assert {r.doc_id for r in kept.collect()} == {3, 5} and kept.columns[-1] == "_clean"
    assert found(nothing, own) == set() and found(awkward, own.limit(0)) == set()
    assert decontaminate.without_leaks(awkward, items).count() <= awkward.count()


@pytest.mark.parametrize("seed", range(5))
def test_block_max_search_is_exact(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(decontaminate, "BLOCK", rng.choice([1, 2, 5]))
    vocabulary = [invented(i, 1) + str(i) for i in range(25)]
    index = decontaminate.ItemIndex([(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 2)))) for i in range(60)])
    for _ in range(40):
        terms = [(w, k) for w in index.widths for k in range(len(index.keys[w])) if rng.random() < 0.4]
        lists, threshold, scores = [index.lists[w][k] for w, k in terms], rng.uniform(0.1, 1), {}
        for items, impacts, *_ in lists:
            for item, x in zip(items, impacts):
                scores[item] = scores.get(item, 0.0) + x
        got = index.above(lists, threshold)
        assert got == pytest.approx({i: s for i, s in scores.items() if s >= threshold})


def test_fixity(spark):
    rows = [(i, f"a{i % 3}", i // 3, bytes([i % 251]) * (50 + i % 700)) for i in range(3_000)]
    schema = "page_id long, archive string, position long, record binary"
    bad = {5: b"\xff" * 55, 2_999: b"\x00" * (50 + 2_999 % 700), 1_500: b"\x01" * (50 + 1_500 % 700)}
    ours = fixity.leaves(spark.createDataFrame(rows, schema), ["page_id"])
    theirs = fixity.leaves(spark.createDataFrame([(i, a, p, bad.get(i, r)) for i, a, p, r in rows], schema), ["page_id"])
    got = {(r.page_id, r.status) for r in fixity.audit(ours.filter("page_id <> 9"), theirs.filter("page_id <> 77"), ["page_id"]).collect()}
    assert got == {(5, "differs"), (2_999, "differs"), (1_500, "differs"), (77, "missing"), (9, "extra")}
    assert fixity.audit(ours, ours, ["page_id"]).count() == 0
    assert fixity.audit(ours.limit(0), ours.limit(0), ["page_id"]).count() == 0


def test_fixity_after_lost_and_added_records(spark):
    schema = "page_id long, archive string, position long, record binary"
    record = lambda i: bytes([i % 251]) * (40 + i * 37 % 900) + str(i // 2 if i % 50 == 0 else i).encode()
    rows = [(i, f"a{i % 2}", i, record(i)) for i in range(1_200)]
    whole = fixity.leaves(spark.createDataFrame(rows, schema), ["page_id"])

    def findings(changed):
        return sorted((r.page_id, r.status) for r in fixity.audit(whole, fixity.leaves(spark.createDataFrame(changed, schema), ["page_id"]), ["page_id"]).collect())

    assert findings([r for r in rows if r[0] != 120]) == [(120, "missing")]
    odd = [r for r in rows if r[0] not in (0, 77, 78, 1_199)]
    odd = [(*r[:3], b"\xff" + r[3][1:]) if r[0] in (79, 500, 1_197) else r for r in odd]
    odd += [(9_000, "a0", 301, b"added"), (9_001, "a1", 600, b"between")]
    assert findings(odd) == [(0, "missing"), (77, "missing"), (78, "missing"), (79, "differs"), (500, "differs"), (1_197, "differs"),
                             (1_199, "missing"), (9_000, "extra"), (9_001, "extra")]


def test_records(spark):
    pages = spark.createDataFrame([(1, "u", "é"), (2, None, None)], "page_id long, url string, html string")
    got = [bytes(r.x) for r in pages.select(fixity.response_record(pages.url, pages.html).alias("x")).collect()]
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    assert got == [head.format("u", 2, "é").encode(), head.format("", 0, "").encode()]


def test_pipeline(spark, items, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        rows = [tuple(r) for r in out.collect()]
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, labels).filter("is_toxic").collect()}
            assert sorted(rows) == sorted(r for r in before if r[0] not in bad) and bad
        if name == "near_dedup":
            keep = {d for d, _, _, k in groups(before, 80) if k}
            assert sorted(rows) == sorted(r for r in before if r[0] in keep) and len(rows) < len(before)
        if name == "decontamination":
            leaks = contained([r[:2] for r in before], [(r.item_id, r.text) for r in items.collect()])
            assert sorted(rows) == sorted(r for r in before if r[0] not in {d for d, _ in leaks})
        if name == "pii":
            hidden = {r.doc_id: r.text for r in pseudonyms.pseudonymised(docs).collect()}
            assert {r[0]: r[1] for r in rows} == hidden and any(hidden[r[0]] != r[1] for r in before)
        if name == "packing":
            check_packing(out.collect(), [r[:2] for r in before], Tokenizer.from_file(PATH), corpus_pipeline.SEQUENCE_TOKENS)
        else:
            assert out.columns == names
            docs = out
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_awkward_and_empty_tables(spark, awkward, nothing):
    for table in (awkward.withColumn("sketch", awkward.doc_id).withColumn("label", awkward.text), nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
