"""Every registered traffic query against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle

import __spark_entry__
from weftline.operators import automata
from weftline.sources import adapters
from weftline.plans.oracle import ORACLES
from weftline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert not oracle.differ(*oracle.compare(spark, QUERIES[name], ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def nearest(i, kept, d):
    return min(d[min(i, k), max(i, k)] for k in kept)


def test_reduction_by_hand():
    """Pairs by distance: 0-1 0.1, 1-2 0.12, 0-2 0.2, 2-3 0.3, 1-3 0.4, 0-3 0.45."""
    d = {(0, 1): 0.1, (1, 2): 0.12, (0, 2): 0.2, (2, 3): 0.3, (1, 3): 0.4, (0, 3): 0.45}
    assert automata.reduced([0, 1, 2, 3], d, 0.05) == [0, 1, 2, 3]
    assert automata.reduced([0, 1, 2, 3], d, 0.1) == [1, 2, 3]  # 0 goes, 0.1 from 1
    assert automata.reduced([0, 1, 2, 3], d, 0.15) == [1, 2, 3]  # without 1, 0 would be 0.2 from 2
    assert automata.reduced([0, 1, 2, 3], d, 0.2) == [2, 3]
    assert automata.reduced([0, 1, 2, 3], d, 0.44) == [2, 3]  # without 2, 0 would be 0.45 from 3
    assert automata.reduced([0, 1, 2, 3], d, 0.45) == [3]


def test_reduces_the_models_of_all_training_windows(spark):
    """No dropped model is further than the bound from a kept one, and no model more could go in the order of pairs."""
    words = {}
    for r in sorted(adapters.words(spark, SF).where("train").collect(), key=lambda r: r["ord"]):
        words.setdefault(r["model"], {}).setdefault(r["win"], []).append(list(r["word"]))
    got = {}
    for r in QUERIES["at_reduce_models"](spark, SF).collect():
        got.setdefault(r["model"], set()).add(r["win"])
    assert max(w for x in words.values() for w in x) > 8 and set(got) == set(words)
    for model, windows in words.items():
        learned = {w: automata.alergia(x) for w, x in windows.items()}
        kinds = [w for w in sorted(windows) if all(repr(learned[w].table()) != repr(learned[v].table()) for v in windows if v < w)]
        d = {(v, w): automata.automaton_distance(learned[v], learned[w]) for v in kinds for w in kinds if v < w}
        gone, kept = set(kinds) - got[model], got[model]
        assert kept <= set(kinds) and all(nearest(i, kept, d) <= 0.5 for i in gone)
        for i, j in sorted(d, key=lambda p: (d[p], p)):
            if i in gone and j in gone:
                continue
            drop = j if i in gone else i
            rest = kept - {drop}
            assert not rest or max(nearest(x, rest, d) for x in gone | {drop}) > 0.5
            break
