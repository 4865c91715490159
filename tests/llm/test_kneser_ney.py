"""Character models against interpolated Kneser-Ney written out with dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from bazaarlens.llm import langid


def grams_of(texts, order):
    out = Counter()
    for t in texts:
        s = langid.symbols([t], order).codes.tolist()
        out.update("".join(map(chr, s[k - order + 1: k + 1])) for k in range(order - 1, len(s)))
    return out


class Plain:
    """P_k(c | h) = max(n(hc) - D, 0) / n(h) + D * types(h) / n(h) * P_(k-1)(c | shorter h)."""

    def __init__(self, texts, order, vocabulary):
        self.order, self.vocabulary = order, vocabulary
        self.n = {order: grams_of(texts, order)}
        for k in range(order - 1, 0, -1):  # how many symbols stand before a shorter gram
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.total, self.types, self.discount = {}, {}, {}
        for k, counts in self.n.items():
            self.total[k], self.types[k] = defaultdict(int), defaultdict(int)
            for g, n in counts.items():
                self.total[k][g[:-1]] += n
                self.types[k][g[:-1]] += 1
            once, twice = (sum(n == x for n in counts.values()) for x in (1, 2))
            self.discount[k] = once / (once + 2 * twice) if once else 0.5

    def weight(self, k, h):
        return self.discount[k] * self.types[k][h] / self.total[k][h] if self.total[k].get(h) else 1.0

    def p(self, g):
        k = len(g)
        below = self.p(g[1:]) if k > 1 else 1 / self.vocabulary
        total = self.total[k].get(g[:-1], 0)
        return (max(self.n[k].get(g, 0) - self.discount[k], 0) / total if total else 0) + self.weight(k, g[:-1]) * below


@pytest.mark.parametrize("order, seed", [(2, 1), (3, 2), (5, 3)])
def test_likelihoods(order, seed):
    rng = random.Random(seed)
    words = {"aa": ["the", "cat", "sat", "mat", "on"], "bb": ["der", "Hund", "saß", "über", "the"]}
    corpus = {x: [" ".join(rng.choices(w, k=rng.randrange(1, 9))) + rng.choice(["", ".", " 12"]) for _ in range(25)]
              for x, w in words.items()}
    counts = {x: grams_of(t, order) for x, t in corpus.items()}
    model = langid.train_model([(x, g, n) for x, c in counts.items() for g, n in c.items()], order)
    vocabulary = len({s for c in counts.values() for g in c for s in g}) + 1
    plain = [Plain(corpus[x], order, vocabulary) for x in model.languages]
    texts = ["the cat", "der Hund", "über the mat", "", "tac eht", "satdersatder!"]  # of known symbols
    got = model.log_likelihoods(langid.symbols(texts, order))
    for i, t in enumerate(texts):
        s = "".join(map(chr, langid.symbols([t], order).codes.tolist()))
        for j, m in enumerate(plain):
            want = sum(math.log(m.p(s[k - order + 1: k + 1])) for k in range(order - 1, len(s)))
            assert math.isclose(got[i, j], want, rel_tol=1e-4, abs_tol=1e-3)


def test_unknown_symbols_cost_the_same_in_every_language():
    counts = [("aa", "ab", 3), ("aa", "ba", 2), ("bb", "bb", 4)]
    model = langid.train_model(counts, 2)
    logs = model.log_likelihoods(langid.symbols(["ж"], 2))
    assert np.isfinite(logs).all() and logs.shape == (1, 2)
