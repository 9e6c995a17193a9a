"""Plain texts go through the vocabulary's model alone, with the library's own ids."""

from __future__ import annotations

import random

from caravel.llm.queries import vocabulary
from caravel.llm.tokens import Encoder


def test_plain_texts_need_no_whole_library():
    class Alone(Encoder):
        by_library = None

    rng, own, library = random.Random(1), Alone(vocabulary()), Encoder(vocabulary())
    texts = ["".join(rng.choice("ab'sSt 9²½ \t\n\v\f\r.,-éÉßĀ'll'D") for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "x" * 500 + ", " + "y" * 11, "It's we'll 'TIS don't.", "a1b22 ½cup"]
    assert [own.ids(t) for t in texts] == [library.by_library(t) for t in texts]
