"""Repeated passages against a comparison of all lines."""

from helpers import SCHEMA, components, edited, invented, shingles, words

from folioscope.llm import paragraphs


def expected(rows):
    lines, place = {}, {}
    for doc, text, *_ in rows:
        n = 0
        for number, line in enumerate((text or "").split("\n")):
            if len(words(line)) >= paragraphs.LEAST_LINE:
                lines[doc, number], place[doc, number] = line, n
                n += 1
    names = sorted(lines)
    roots = components({i: shingles(lines[k]) for i, k in enumerate(names)}, paragraphs.PERCENT)
    docs = {}
    for i, k in enumerate(names):
        docs.setdefault(roots[i], set()).add(k[0])
    repeated = {k: names[roots[i]] for i, k in enumerate(names) if len(docs[roots[i]]) > 1}
    out = set()
    for k in repeated:
        run = [k]
        for step in (-1, 1):
            at = place[k]
            while True:
                at += step
                next_ = next((x for x in repeated if x[0] == k[0] and place[x] == at), None)
                if next_ is None:
                    break
                run.append(next_)
        if sum(len(words(lines[x])) for x in run) >= paragraphs.LEAST_PASSAGE:
            out.add((*k, repeated[k] != k))
    return out


def found(df):
    return {(r.doc_id, r.line, r.removed) for r in paragraphs.repeated_lines(df).collect()}


def test_bands_find_pairs_at_the_threshold():
    assert 1 - (1 - 0.8**paragraphs.ROWS) ** paragraphs.BANDS >= paragraphs.RECALL


def test_planted(spark):
    long, a, b = invented(1, 70), invented(2, 25), invented(3, 24)
    rows = [
        (1, f"{invented(4, 30)}\n{long}\n{invented(5, 9)}", "en", "s", 0),
        (2, f"{edited(long, 6, 1)}\nshort line\n{invented(7, 20)}", "en", "s", 0),
        (3, f"{a}\nshort\n{b}", "en", "s", 0), (4, f"{invented(8, 12)}\n{a}\n{b}", "en", "s", 0),
        (5, f"{a}\n{invented(9, 30)}", "en", "s", 0), (6, f"{invented(10, 50)}\n{invented(10, 50)}", "en", "s", 0),
    ]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == expected(rows) == {(1, 1, False), (2, 0, True), (3, 0, False), (3, 2, False), (4, 1, True), (4, 2, True)}


def test_tables(documents, awkward, nothing):
    assert found(documents) == expected([tuple(r) for r in documents.collect()])
    ids = awkward.filter("doc_id is not null")
    assert found(ids) == expected(list(dict.fromkeys(tuple(r) for r in ids.collect())))
    assert paragraphs.repeated_lines(awkward).count() >= 0
    assert found(nothing) == set()


def sentences(text):
    out = []
    for number, line in enumerate((text or "").split("\n")):
        w = words(line)
        if len(w) >= paragraphs.LEAST_LINE:
            own, index = [], 0
            for i, x in enumerate(w, 1):
                own.append(x)
                if x[-1] in ".!?" or i == len(w):
                    if len(own) >= paragraphs.LEAST_SENTENCE:
                        out.append((number, index, tuple(own)))
                    own, index = [], index + 1
    return out


def expected_sentences(rows):
    found = {doc: sentences(text) for doc, text, *_ in rows}
    docs = {}
    for doc, own in found.items():
        for _, _, s in own:
            docs.setdefault(s, set()).add(doc)
    out = set()
    for doc, own in found.items():
        run = []
        for x in [*own, None]:
            if x is not None and len(docs[x[2]]) > 1:
                run.append(x)
                continue
            if sum(len(s) for _, _, s in run) >= paragraphs.LEAST_RUN:
                out |= {(doc, line, index) for line, index, _ in run}
            run = []
    return out


def prose(seed, n):
    return " ".join(invented(f"{seed} {i}", 9).capitalize() + "." for i in range(n))


def test_passages_inside_lines(spark):
    passage = prose(1, 7)
    rows = [(i, f"{invented(10 + i, 31)} {passage} {invented(20 + i, 33)}\n{prose(40 + i, 3)}", "en", "s", 0) for i in range(3)]
    rows += [(9, f"{prose(50, 4)} {prose(1, 1)} {prose(51, 4)}", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.line, r.sentence) for r in paragraphs.repeated_passages(df).collect()}
    assert got == expected_sentences(rows) and {d for d, *_ in got} == {0, 1, 2} and len(got) == 18


def test_lines_and_sentences_together(documents, nothing):
    rows = [tuple(r) for r in documents.collect()]
    got = paragraphs.repeated_passages(documents).collect()
    lines = {(d, n) for d, n, _ in expected(rows)}
    want = {(d, n, None) for d, n in lines} | {x for x in expected_sentences(rows) if x[:2] not in lines}
    assert {(r.doc_id, r.line, r.sentence) for r in got} == want
    assert paragraphs.repeated_passages(nothing).count() == 0
