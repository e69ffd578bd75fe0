"""Weighted automata and detectors against plain enumeration and hand-made inputs."""

import random
from itertools import product

import pytest

from weftline.operators import algebra, automata

WORDS = "xay xay xay xb xb ay ay b".split()


def weight(a, word):
    """The sum over all paths that spell the word."""
    at = dict(a.starts)
    for s in word:
        nxt = {}
        for p, x, q, w in a.edges:
            if x == s and p in at:
                nxt[q] = nxt.get(q, 0) + at[p] * w
        at = nxt
    return sum(w * a.ends.get(q, 0) for q, w in at.items())


def every(alphabet, n):
    return ["".join(w) for k in range(n + 1) for w in product(alphabet, repeat=k)]


def test_algebra():
    tree, _ = automata.Automaton.tree(WORDS)
    a = algebra.Weighted.of(tree)
    assert {w: round(weight(a, w), 9) for w in every("abxy", 3) if weight(a, w)} == {"xay": 0.375, "xb": 0.25, "ay": 0.25, "b": 0.125}
    assert algebra.Weighted.of(tree, counts=True).groups()[0, 1] == (1, 5.0)
    assert a.is_deterministic() and a.alphabet() == set("xaby") and not a.inverse().is_deterministic()
    assert all(abs(weight(a, w) - weight(a.inverse(), w[::-1])) < 1e-12 and abs(weight(a, w) - weight(a.suffix_minimised(), w)) < 1e-12 for w in every("abxy", 3))
    assert len(a.suffix_minimised().states()) < len(a.states())
    assert all(a.predecessors(q) == {e[0] for e in a.incoming().get(q, [])} and a.successors(q) == {e[2] for e in a.outgoing().get(q, [])} for q in a.states())
    assert a.lengths()[0] == 0 and max(a.lengths().values()) == 3 and sorted(a.numbered().values()) == list(range(len(a.states())))
    assert weight(a.map_symbols({"y": "b"}), "xab") == pytest.approx(0.375) and weight(a.ones().all_final(), "xa") == 1
    c = a.complete("abxyz")
    assert len(c.edges) == 5 * len(c.states()) and weight(c, "xay") == pytest.approx(0.375) and weight(c, "zz") == 0
    dead = algebra.Weighted([*a.edges, (0, "q", 99, 0.5), (98, "q", 0, 0.5)], a.starts, a.ends)
    assert dead.trim().states() == a.states()
    both = algebra.Weighted([(0, "a", 1, 0.25), (0, "a", 1, 0.5)], {0: 1.0}, {1: 1.0})
    assert both.aggregated().edges == [(0, "a", 1, 0.75)] and both.aggregated(max).edges == [(0, "a", 1, 0.5)]
    assert a.merged(0, [1]).states() == a.states() - {1} and algebra.alphabets([a, both]) == (set("xaby"), {"a"})


def test_products_and_differences_over_all_words():
    rng = random.Random(3)
    for _ in range(30):
        x, y = ([[rng.choice("abc") for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(3, 30))] for _ in range(2))
        a, b = (algebra.Weighted.of(automata.alergia(t, 0.5)) for t in (x, y))
        p, d = a.product(b), a.difference(b)
        for w in every("abc", 4):
            assert weight(p, w) == pytest.approx(weight(a, w) * weight(b, w))
            assert weight(d, w) == pytest.approx(0 if weight(b, w) else weight(a, w))
        word, best = d.most_probable()
        assert best == pytest.approx(max([weight(d, w) for w in every("abc", 5)])) and (not best or weight(d, word) == pytest.approx(best))


def test_silent_windows(spark):
    rows = [("p", 0, 1, ["a", "b"]), ("p", 2, 2, ["a", "b"]), ("q", 1, 3, ["a"]), ("e", 1, 4, ["a"])]
    test = spark.createDataFrame(rows, "model string, win long, ord long, word array<string>")
    trained = spark.createDataFrame([("p", 1, ["a", "b"]), ("e", 2, [])], "model string, ord long, word array<string>")
    want = {("p", 0): 0.0, ("p", 1): 1.0, ("p", 2): 0.0, ("q", 0): 0.0, ("q", 1): 1.0, ("e", 0): 0.0, ("e", 1): 1.0}
    assert {(r[0], r[1]): round(r[2], 9) for r in automata.distances(test, trained).collect()} == want
    assert {(r[0], r[1]): round(r[2], 9) for r in automata.learned_distances(test, trained).collect()} == want
    found = {(r["model"], r["win"]): (r["word"], r["p"]) for r in automata.explained(test, trained, 0.5).collect()}
    whole = algebra.Weighted.of(automata.alergia([["a", "b"]])).most_probable()
    assert set(found) == {("p", 1), ("q", 1), ("e", 1)} and found["q", 1] == (None, None)
    assert found["p", 1][0] == whole[0] and found["p", 1][1] == pytest.approx(whole[1])
