"""Valid numbers next to other digits or capitals."""

import re

from folioscope.llm import pseudonyms

CARD, IBAN = "4111 1111 1111 1111", "DE89370400440532013000"
TEXTS = {
    f"{CARD} 123 end": [CARD], "n 4111111111111111 12/27": ["4111111111111111"], f"{IBAN} BIC COBADEFF": [IBAN],
    "GB29NWBK60161331926819 2024-01-05": ["GB29NWBK60161331926819", "2024-01-05"], f"123 {CARD}": [CARD],
    f"12345678 {CARD}.": [CARD], f"{CARD} 123 and 4337-1665-9846-4399 321": [CARD, "4337-1665-9846-4399"],
    "DE89 3704 0044 0532 0130 00 EUR 17": ["DE89 3704 0044 0532 0130 00"],
}
CLEAN = ["4111 1111 1111 1112 124", "DE88370400440532013000 BIC COBADEFF", "1234 5678"]


def test_neighbours(spark):
    texts = [*TEXTS, *CLEAN]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    hidden = pseudonyms.pseudonymised(table, count="n")
    got = {r.doc_id: r for r in hidden.collect()}
    for i, (text, values) in enumerate(TEXTS.items()):
        rest = text
        for v in values:
            assert v not in got[i].text, (text, got[i].text)
            rest = rest.replace(v, re.sub("[0-9]", "#", v))
        assert got[i].n == len(values), (text, got[i].text)
        assert "".join(a if b != "#" else "#" for a, b in zip(got[i].text, rest)) == rest
    assert [got[len(TEXTS) + i].text for i in range(len(CLEAN))] == CLEAN
    assert {r.doc_id: r.text for r in pseudonyms.restored(hidden).collect()} == dict(enumerate(texts))
