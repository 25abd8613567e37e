"""Disguised spelling of whole phrases: letters apart, joined words, runs of signs."""

from __future__ import annotations

import pytest

from annospark.llm import toxicity as tox

PLAIN = ["you are such a stupid idiot and nobody likes you", "what a loser he is", "the people of the world have a day for all",
         "truck luck duck stuck fuck", "bad idea and a good day"] * 20


@pytest.fixture(scope="module")
def features():
    return tox.Features(tox.character_model(tox._trigrams(PLAIN)))


@pytest.mark.parametrize("text, word", [
    ("such a l o s e r", "loser"), ("y o u s t u p i d i d i o t", "stupid"), ("y o u s t u p i d i d i o t", "idiot"),
    ("y o u  s t u p i d  i d i o t", "idiot"), ("b a d", "bad"),
    (" ".join("thepeopleoftheworldhaveadayforallandyouaresuchastupididiot"), "idiot"),
    ("you-are-such-a-st*pid-1diot-and-nobody-likes-you", "stupid"), ("you-are-such-a-st*pid-1diot-and-nobody-likes-you", "idiot"),
    ("d.u.m.b.s.t.u.u.u.p.i.d", "stupid"), ("f**k", "fuck")])
def test_words_of_phrases_are_features(features, text, word):
    least = {tox.zlib.crc32(x.encode()) % tox.BUCKETS for x in ((word,) if len(word) < 5 else (word[:4] + "-",))}
    assert least <= set(features(text).tolist())


def test_restoring_takes_time_by_length(features):
    word = "st0pp" * 4000
    assert len(tox.restore(word, features.model)) >= 4 * 4000
