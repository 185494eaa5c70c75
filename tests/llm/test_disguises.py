"""Disguises with signs at any place, of any length."""

import pytest
from helpers import invented

from folioscope.llm import toxicity

WORDS = ["idiot", "shit", "hate", "loser", "ass", "stupid", "moron", "worthless"]


@pytest.fixture(scope="module")
def model(spark):
    texts = [(" ".join([*WORDS, invented(i, 4)]),) for i in range(200)]
    return toxicity.log_model(toxicity.character_counts(spark.createDataFrame(texts, "text string")))


@pytest.mark.parametrize("hidden, word", [
    ("1d107", "idiot"), ("5h17", "shit"), ("h473", "hate"), ("idio7", "idiot"), ("!diot", "idiot"), ("|oser", "loser"),
    ("(!diot)", "idiot"), ("7h1$h1t", "shit"), ("s+upid", "stupid"), ("$tup1d,", "stupid"), ("m0r0n!!!", "moron"),
])
def test_signs_anywhere(model, hidden, word):
    got = toxicity.restored_words(hidden, model)
    assert got == [word] or word in "".join(got)


def test_ordinary_words_stay(model):
    assert [toxicity.restored_words(w, model) for w in ("Idiot", "(moron)", '"hate".', "...", "1234", "___")] == [
        ["idiot"], ["moron"], ["hate"], [], ["1234"], []
    ]


@pytest.mark.parametrize("sign", [".", "_"])
def test_long_texts_joined_by_signs(model, sign):
    got = toxicity.restored_words(sign.join(WORDS * 40), model)
    assert {w for w in WORDS if w not in got and w not in " ".join(got)} == set()


def test_runs_of_letters(model):
    features = toxicity.Features(model, None)
    assert "=ass" in features.of_text("x1 a s s y2")
    # The borders of windows lie inside words here; each word is whole in another window.
    spaced = " ".join(" ".join(w) for w in WORDS * 30)
    assert len(spaced) > 2 * toxicity.DECODED_AT_ONCE
    assert "worthless" in " ".join(toxicity.decoded(spaced, model))
