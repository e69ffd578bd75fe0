"""Conversations as words: prefix trees, membership, distances, and merged probabilistic automata.

In an unmerged prefix tree the weights along a word multiply out to its relative frequency, so trees are tables of
counts, a distance is a full outer join and membership an anti join. Merging (Alergia) and the linear algebra of merged
automata work on one model's few states at a time, in grouped functions.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Sequence
from math import log, log2, log10, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import functions as X

# --- Conversations -----------------------------------------------------------------------------------------------


KINDS = ("FILETRANSFER", "GENERAL", "GENERAL_ACT", "UNKNOWN")
#: States between two messages: 0 if no conversation is open, else 1 + 2 * kind + whether a middle message has passed.
STATES = 1 + 2 * len(KINDS)
#: Numbers of messages that one task takes at a time.
SLICE = 1_000_000


def advance(state: int, asdu: int, cot: int) -> tuple[int, int, bool]:
    """(state after a message that isn't spontaneous, number of its conversation's kind, whether it begins one)."""
    if state:
        k, passed = divmod(state - 1, 2)
        kind = KINDS[k]
        middle = (kind == "FILETRANSFER" and 123 <= asdu <= 127) or (kind == "GENERAL" and cot not in (6, 7)) or (kind == "GENERAL_ACT" and cot != 6)
        begins = not middle and bool(passed)
        passed = passed or middle
    if not state or begins:
        k, passed, begins = KINDS.index("FILETRANSFER" if asdu == 122 else {6: "GENERAL_ACT", 7: "GENERAL"}.get(cot, "UNKNOWN")), False, True
    closes = KINDS[k] != "FILETRANSFER" and cot in (10, 44, 45, 46, 47)
    return 0 if closes else 1 + 2 * k + int(passed), k, begins


def split_conversations(rows: Iterable[tuple[int, int]], state: int = 0) -> list[tuple[int, str]]:
    """Conversation number and kind of each (asdu, cot) of a pair's messages, none of them spontaneous, in order; one that is open at the start is number 0."""
    out, number = [], 0 if state else -1
    for asdu, cot in rows:
        state, k, begins = advance(state, asdu, cot)
        number += begins
        out.append((number, KINDS[k]))
    return out


def ends_of_slice(rows: Iterable[tuple[int, int, int]]) -> tuple[list[int], list[int | None]]:
    """For each state at the start of the messages (seq, asdu, cot): the state at their end, and the seq at which the last conversation begins, if one does."""
    at, last = list(range(STATES)), [None] * STATES
    for seq, asdu, cot in rows:
        after = {x: advance(x, asdu, cot) for x in set(at)}
        last = [seq if after[x][2] else y for x, y in zip(at, last, strict=True)]
        at = [after[x][0] for x in at]
    return at, last


def conversations(messages: DataFrame, by: Sequence[str] = ("pair",), symbol: str = "symbol", slice_rows: int = SLICE) -> DataFrame:
    """(by..., conv, first_seq, kind, word): I-frames of a pair (and window) as conversations.

    A spontaneous message is a conversation of its own; the others go through a state machine whose state depends on all
    messages before. It has few states, so a slice of a group's messages is first reduced to what it does to each of them;
    these rows, one a slice, are followed in order, and then each slice is cut from the state in which it begins. No task
    takes all messages of a busy group."""
    by = list(by)
    own = messages.where(X.is_spontaneous("cot")).select(*by, F.concat(F.lit("s"), F.col("seq").cast("string")).alias("conv"), F.col("seq").alias("first_seq"), F.lit("SPONTANEOUS").alias("kind"), F.array(F.col(symbol)).alias("word"))
    types = {f.name: f.dataType.simpleString() for f in messages.schema}
    group, names = [*by, "_slice"], "".join(f"{c} {types[c]}, " for c in by) + "_slice long"
    place = F.floor(F.col("seq") / F.lit(slice_rows)).cast("long").alias("_slice")
    rest = messages.where(~X.is_spontaneous("cot")).select(*by, place, "seq", F.col("asdu").cast("int").alias("asdu"), F.col("cot").cast("int").alias("cot"), F.col(symbol).alias("_symbol"))

    def reduced(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("seq")
        ends, begins = ends_of_slice(zip(table["seq"], table["asdu"], table["cot"], strict=True))
        return table[group].head(1).assign(ends=[ends], begins=[begins])

    def followed(table: pd.DataFrame) -> pd.DataFrame:
        table, state, first, states, firsts = table.sort_values("_slice"), 0, None, [], []
        for ends, begins in zip(table["ends"], table["begins"], strict=True):
            states.append(state)
            firsts.append(first)
            state, first = int(ends[state]), first if pd.isna(begins[state]) else int(begins[state])
        return table[group].assign(state=states, first=pd.array(firsts, dtype="Int64"))

    def cut(table: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        table, state = table.sort_values("seq"), int(start["state"].iloc[0])
        table["c"], table["kind"] = zip(*split_conversations(zip(table["asdu"], table["cot"], strict=True), state), strict=True)
        g = table.groupby("c", sort=True)
        done = g[group].first()
        done["first_seq"], done["kind"], done["word"] = g["seq"].first(), g["kind"].first(), g["_symbol"].agg(list)
        if state and 0 in done.index:
            done.loc[0, "first_seq"] = int(start["first"].iloc[0])
        return done[[*group, "first_seq", "kind", "word"]]

    slices = rest.select(*by, "_slice", "seq", "asdu", "cot").groupBy(*group).applyInPandas(reduced, f"{names}, ends array<int>, begins array<long>")
    starts = slices.groupBy(*by).applyInPandas(followed, f"{names}, state int, first long")
    parts = rest.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(cut, f"{names}, first_seq long, kind string, word array<string>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_slice", "word"))), lambda x: x["word"]))
    found = parts.groupBy(*by, "first_seq", "kind").agg(joined.alias("word"))
    return own.unionByName(found.select(*by, F.concat(F.lit("c"), F.col("first_seq").cast("string")).alias("conv"), "first_seq", "kind", "word"))


def dense_windows(rel: Column, width: float) -> Column:
    return F.floor(rel / F.lit(width)).cast("long")


def window_spine(placed: DataFrame, by: Sequence[str] = ("pair",)) -> DataFrame:
    """Every window 0 .. last of each pair, also the empty ones."""
    return placed.groupBy(*by).agg(F.max("win").alias("top")).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("win"))


def smoothing_windows(messages: DataFrame, rel: Column, widths: Sequence[float] = (300.0, 600.0)) -> DataFrame:
    """Each message once for each width: a model is learned from each window of each."""
    each = F.explode(F.array(*(F.struct(F.lit(float(w)).alias("width"), dense_windows(rel, w).alias("win")) for w in widths)))
    return messages.withColumn("_w", each).withColumns({"width": F.col("_w.width"), "win": F.col("_w.win")}).drop("_w")


def drop_last(df: DataFrame) -> DataFrame:
    """All but the last window that any pair has."""
    last = df.agg(F.max("win").alias("_last"))
    return df.join(F.broadcast(last), F.col("win") < F.col("_last"), "left_semi")


# --- Prefix trees ------------------------------------------------------------------------------------------------


def prefixes(words: DataFrame, model: str = "model") -> DataFrame:
    """(model, prefix, n): how many words pass each prefix; the empty one counts all words."""
    counted = words.groupBy(model, "word").agg(F.count("*").alias("n"))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.size("word")), lambda i: F.slice("word", 1, i)))
    return counted.select(model, cut.alias("prefix"), "n").groupBy(model, "prefix").agg(F.sum("n").alias("n"))


def transitions(words: DataFrame, model: str = "model") -> DataFrame:
    """(model, src, symbol, dst, n, p): edges of the tree and their probabilities."""
    tree = prefixes(words, model)
    parent = tree.select(model, F.col("prefix").alias("src"), F.col("n").alias("total"))
    child = tree.where(F.size("prefix") > 0).select(model, F.slice("prefix", F.lit(1), F.size("prefix") - 1).alias("src"), F.element_at("prefix", -1).alias("symbol"), F.col("prefix").alias("dst"), "n")
    return child.join(parent, [model, "src"]).select(model, "src", "symbol", "dst", "n", (F.col("n") / F.col("total")).alias("p"))


def finals(words: DataFrame, model: str = "model") -> DataFrame:
    """(model, state, n, p): words that end in a state, over those that pass it."""
    ends = words.groupBy(model, F.col("word").alias("prefix")).agg(F.count("*").alias("ends"))
    return ends.join(prefixes(words, model), [model, "prefix"]).select(model, F.col("prefix").alias("state"), F.col("ends").alias("n"), (F.col("ends") / F.col("n")).alias("p"))


def distribution(words: DataFrame, model: str = "model") -> DataFrame:
    """(model, word, p): relative frequencies, which is what the tree assigns."""
    n = words.groupBy(model).agg(F.count("*").alias("total"))
    return words.groupBy(model, "word").agg(F.count("*").alias("n")).join(n, model).select(model, "word", (F.col("n") / F.col("total")).alias("p"))


def log_probabilities(test: DataFrame, trained: DataFrame, model: str = "model") -> DataFrame:
    """log p of each distinct test word; null where the model lacks it."""
    return test.select(model, "word").distinct().join(distribution(trained, model), [model, "word"], "left").withColumn("log_p", F.log("p")).drop("p")


def anomalies(test: DataFrame, trained: DataFrame, model: str = "model") -> DataFrame:
    """The test words that the model of their pair doesn't know, all of them where there is no model."""
    return test.join(trained.select(model, "word").distinct(), [model, "word"], "left_anti")


def judged_windows(test: DataFrame, model: str = "model", win: str = "win") -> DataFrame:
    """(model, win): every window from the first of the test to the last that the pair has, also those in which it is silent."""
    first = test.agg(F.min(win).alias("_first"))
    each = F.explode(F.sequence(F.col("_first"), F.col("_last"))).alias(win)
    return test.groupBy(model).agg(F.max(win).alias("_last")).join(F.broadcast(first)).select(model, each)


def distances(test: DataFrame, trained: DataFrame, model: str = "model", win: str = "win") -> DataFrame:
    """(model, win, distance): min(1, L2 distance) of the distributions of each window and its pair's model.

    Without a model it is 1, or 0 in a window without words; a silent window is as far as can be from a model that has edges."""
    window = test.withColumn("_m", F.struct(model, win))
    p = distribution(window, "_m").select(F.col("_m.*"), "word", F.col("p").alias("p1"))
    golden = distribution(trained, model).withColumnRenamed("p", "p2")
    # sum (p1 - p2)^2 over both = sum over the window's words of (p1 - p2)^2 - p2^2, + sum p2^2 of the model
    weight = golden.groupBy(model).agg(F.sum(F.col("p2") * F.col("p2")).alias("norm"), F.max(F.size("word")).alias("deep"))
    near = p.join(golden, [model, "word"], "left").withColumn("p2", F.coalesce("p2", F.lit(0.0)))
    part = near.groupBy(model, win).agg(F.sum(F.col("p1") * F.col("p1") - 2 * F.col("p1") * F.col("p2")).alias("s"))
    d = F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.col("s") + F.col("norm"))))
    silent = F.when(F.coalesce("deep", F.lit(0)) > 0, 1.0).otherwise(0.0)
    every = judged_windows(test, model, win).join(part, [model, win], "left").join(weight, model, "left")
    return every.select(model, win, F.when(F.col("s").isNull(), silent).when(F.col("norm").isNull(), 1.0).otherwise(d).alias("distance"))


def until_near(scored: DataFrame, by: Sequence[str], model: str = "model", near: float = 0.0) -> DataFrame:
    """Of each window's models, in order, those up to the first whose distance is `near` or less: the others needn't be looked at."""
    before = Window.partitionBy(*by).orderBy(model).rowsBetween(Window.unboundedPreceding, -1)
    return scored.withColumn("_least", F.min("distance").over(before)).where(F.col("_least").isNull() | (F.col("_least") > near)).drop("_least")


def best_model(scored: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    """The least distance over models and the first model that has it."""
    return scored.groupBy(*by).agg(F.min("distance").alias("distance"), F.min_by(model, F.struct("distance", model)).alias(model))


def missing_words(test: DataFrame, trained: DataFrame, model: str = "model", by: Sequence[str] = ("win",)) -> DataFrame:
    """The most probable word of the model that the window lacks (of equals the first in order)."""
    by = list(by)
    asked = test.select(model, *by).distinct()
    lacks = asked.join(distribution(trained, model), model).join(test.select(model, *by, "word").distinct(), [model, *by, "word"], "left_anti")
    return lacks.groupBy(model, *by).agg(F.min_by(F.struct("word", "p"), F.struct(-F.col("p"), "word")).alias("x")).select(model, *by, "x.word", "x.p")


def accuracy(words: DataFrame, share: float = 0.33, order: str = "ord", model: str = "model") -> DataFrame:
    """Trains on the first share of each model's words and counts the others that it doesn't know."""
    placed = words.withColumns({"_rn": F.row_number().over(Window.partitionBy(model).orderBy(order)), "_n": F.count("*").over(Window.partitionBy(model))})
    train = F.col("_rn") <= F.floor(F.col("_n") * F.lit(share))
    known = placed.where(train).select(model, "word").distinct().withColumn("_k", F.lit(1))
    j = placed.where(~train).join(known, [model, "word"], "left")
    return j.groupBy(model).agg(F.count("*").alias("n_test"), F.count_if(F.col("_k").isNull()).alias("n_miss"), F.avg(F.col("_k").isNotNull().cast("double")).alias("accuracy"))


# --- Merged automata ---------------------------------------------------------------------------------------------


class Automaton:
    """A deterministic automaton with counts: edges[state][symbol] = [next, n], ends[state] = n. State 0 is the start."""

    def __init__(self) -> None:
        self.edges: dict[int, dict[str, list]] = defaultdict(dict)
        self.ends: dict[int, int] = defaultdict(int)

    @classmethod
    def tree(cls, words: Iterable[Sequence[str]]) -> tuple[Automaton, int]:
        a, names, n = cls(), {(): 0}, 0
        a.ends[0] += 0
        for w in words:
            n, at = n + 1, 0
            for i, s in enumerate(w):
                to = names.setdefault(tuple(w[: i + 1]), len(names))
                a.edges[at].setdefault(s, [to, 0])[1] += 1
                at = to
            a.ends[at] += 1
        return a, n

    def passes(self, q: int) -> int:
        return self.ends[q] + sum(n for _, n in self.edges[q].values())

    def states(self) -> list[int]:
        """Reachable states, breadth first, symbols in order: a numbering that depends on nothing else."""
        seen, queue = [0], deque([0])
        while queue:
            for s in sorted(self.edges[q := queue.popleft()]):
                if (to := self.edges[q][s][0]) not in seen:
                    seen.append(to)
                    queue.append(to)
        return seen

    def table(self) -> tuple[list[tuple[int, str, int, float]], list[float]]:
        """(src, symbol, dst, probability) and the states' final probabilities, states renumbered."""
        order = self.states()
        name = {q: i for i, q in enumerate(order)}
        rows = [(name[q], s, name[to], n / self.passes(q)) for q in order if self.passes(q) for s, (to, n) in sorted(self.edges[q].items())]
        return rows, [self.ends[q] / self.passes(q) if self.passes(q) else 0.0 for q in order]


def compatible(a: Automaton, p: int, q: int, alpha: float) -> bool:
    """Hoeffding's bound, with a decimal logarithm, on the end and every symbol of both states."""
    n, m = a.passes(p), a.passes(q)
    if not n or not m:
        return True
    bound = (1 / sqrt(n) + 1 / sqrt(m)) * sqrt(0.5 * log10(2 / alpha))
    count = lambda x, s: a.edges[x][s][1] if s in a.edges[x] else 0
    return abs(a.ends[p] / n - a.ends[q] / m) < bound and all(abs(count(p, s) / n - count(q, s) / m) < bound for s in {*a.edges[p], *a.edges[q]})


def alergia(words: Iterable[Sequence[str]], alpha: float = 0.05, least: int | None = None) -> Automaton:
    """Merges compatible states of the words' tree; a state that fewer than `least` (log2 of the words) pass is left as it is."""
    words = list(words)
    a, n = Automaton.tree(words)
    least = least if least is not None else int(log2(n)) if n else 1
    name = {0: ()}
    for q in a.states():
        for s, (to, _) in a.edges[q].items():
            name[to] = (*name[q], s)
    red = [0]
    while True:
        blue = sorted({to for q in red for to, _ in a.edges[q].values()} - set(red), key=name.__getitem__)
        blue = [q for q in blue if a.passes(q) >= least]
        if not blue:
            return a
        q = blue[0]
        for r in sorted(red, key=name.__getitem__):
            if compatible(a, r, q, alpha):
                _merge(a, r, q)
                break
        else:
            red.append(q)


def _merge(a: Automaton, r: int, q: int) -> None:
    for edges in a.edges.values():
        for e in edges.values():
            if e[0] == q:
                e[0] = r
    fold = [(r, q)]
    while fold:
        into, gone = fold.pop()
        a.ends[into] += a.ends[gone]
        for s, (to, n) in list(a.edges[gone].items()):
            if s in a.edges[into]:
                a.edges[into][s][1] += n
                fold.append((a.edges[into][s][0], to))
            else:
                a.edges[into][s] = [to, n]


def inner_product(a: Automaton, b: Automaton) -> float:
    """Sum over all words of P_a * P_b: the product automaton's total weight, by a linear solve."""
    (ea, fa), (eb, fb) = a.table(), b.table()
    by_a, by_b = defaultdict(list), defaultdict(dict)
    for q, s, to, p in ea:
        by_a[q].append((s, to, p))
    for q, s, to, p in eb:
        by_b[q][s] = (to, p)
    index, queue, cells = {(0, 0): 0}, deque([(0, 0)]), []
    while queue:
        q, r = pair = queue.popleft()
        for s, to, p in by_a[q]:
            if s in by_b[r]:
                nxt, p2 = (to, by_b[r][s][0]), by_b[r][s][1]
                if nxt not in index:
                    index[nxt] = len(index)
                    queue.append(nxt)
                cells.append((index[pair], index[nxt], p * p2))
    m = np.eye(len(index))
    for i, j, p in cells:
        m[i, j] -= p
    end = np.array([fa[q] * fb[r] for q, r in index])
    try:
        return float(np.linalg.solve(m, end)[0])
    except np.linalg.LinAlgError:
        return float(np.linalg.lstsq(m, end, rcond=None)[0][0])


def automaton_distance(a: Automaton, b: Automaton) -> float:
    empty = [not any(x.edges.values()) for x in (a, b)]
    if any(empty):
        return 0.0 if all(empty) else 1.0
    return min(1.0, sqrt(max(0.0, inner_product(a, a) - 2 * inner_product(a, b) + inner_product(b, b))))


def word_log_probability(a: Automaton, word: Sequence[str]) -> float | None:
    q, total = 0, 0.0
    for s in word:
        if s not in a.edges[q]:
            return None
        to, n = a.edges[q][s]
        total += log(n / a.passes(q))
        q = to
    return total + log(a.ends[q] / a.passes(q)) if a.ends[q] else None


def reduced(names: Sequence[int], distance: dict[tuple[int, int], float], most: float) -> list[int]:
    """The names that stay when each dropped one must have a kept one within `most`.

    Pairs are taken nearest first; of each pair the first goes, or the second where the first has gone already. It ends
    at the first pair whose loss would put some dropped one further than `most` from its nearest kept one."""
    gone: set[int] = set()

    def loss(out: set[int]) -> float:
        kept = [k for k in names if k not in out]
        return max(min(distance[min(i, k), max(i, k)] for k in kept) for i in out) if kept else 1.0

    for (i, j), _ in sorted(distance.items(), key=lambda x: (x[1], x[0])):
        if i in gone and j in gone:
            continue
        after = gone | {j if i in gone else i}
        if loss(after) > most:
            break
        gone = after
    return [i for i in names if i not in gone]


def reduce_models(models: Sequence[Automaton], most: float = 0.1) -> list[int]:
    """Indices of the models that stay: equal ones once, then as in `reduced` by the models' distances."""
    kinds: dict[str, int] = {}
    for i, m in enumerate(models):
        kinds.setdefault(repr(m.table()), i)
    left = sorted(kinds.values())
    return reduced(left, {(i, j): automaton_distance(models[i], models[j]) for k, i in enumerate(left) for j in left[k + 1 :]}, most)


def reduce_windows(words: DataFrame, most: float, model: str = "model", win: str = "win", alpha: float = 0.05) -> DataFrame:
    """(model, win): the windows whose merged automata stay in each model's ensemble."""

    def keep(table: pd.DataFrame) -> pd.DataFrame:
        parts = sorted((w, g.sort_values("ord")["word"].map(list).tolist()) for w, g in table.groupby(win))
        left = reduce_models([alergia(x, alpha) for _, x in parts], most)
        return pd.DataFrame({model: table[model].iloc[0], win: [parts[i][0] for i in left]})

    kind = words.schema[model].dataType.simpleString()
    return words.select(model, win, "ord", "word").groupBy(model).applyInPandas(keep, f"{model} {kind}, {win} long")


def learn(words: DataFrame, model: str = "model", alpha: float = 0.05) -> DataFrame:
    """(model, src, symbol, dst, p): the merged automaton of each model; a null symbol carries a state's final probability."""

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        edges, ends = alergia(table.sort_values("ord")["word"].map(list), alpha).table()
        rows = [(q, s, to, p) for q, s, to, p in edges] + [(q, None, None, p) for q, p in enumerate(ends)]
        out = pd.DataFrame(rows, columns=["src", "symbol", "dst", "p"]).astype({"dst": "Int64"})
        out.insert(0, model, table[model].iloc[0])
        return out

    kind = words.schema[model].dataType.simpleString()
    return words.select(model, "word", "ord").groupBy(model).applyInPandas(fit, f"{model} {kind}, src int, symbol string, dst int, p double")


def _judge(test: DataFrame, trained: DataFrame, model: str, win: str, judge, shape: str) -> DataFrame:
    """judge(model's words or None, window number, words of the window) -> values, for each window of each pair."""
    first = test.agg(F.min(win).alias("_first"))
    cols = [model, "word", "ord"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        golden = right.sort_values("ord")["word"].map(list).tolist() if len(right) else None
        rows = []
        if len(left):
            parts = {w: part["word"].map(list).tolist() for w, part in left.sort_values("ord").groupby(win)}
            for w in range(int(left["_first"].iloc[0]), max(parts) + 1):
                rows += [(left[model].iloc[0], w, *x) for x in judge(golden, parts.get(w, []))]
        return pd.DataFrame(rows, columns=[model, win, *(x.split()[0] for x in shape.split(", "))])

    kind = test.schema[model].dataType.simpleString()
    asked = test.select(*cols, win).join(F.broadcast(first))
    return asked.groupBy(model).cogroup(trained.select(*cols).groupBy(model)).applyInPandas(compare, f"{model} {kind}, {win} long, {shape}")


def _window_distance(golden: Automaton | None, words: list, mine: Automaton) -> float:
    if golden is None:
        return 1.0 if words else 0.0
    return automaton_distance(golden, mine)


def learned_distances(test: DataFrame, trained: DataFrame, model: str = "model", win: str = "win", alpha: float = 0.05) -> DataFrame:
    """(model, win, distance) of merged automata: each window's own, also of silent ones, against its pair's."""

    def judge(golden: list | None, words: list) -> list[tuple]:
        return [(_window_distance(None if golden is None else alergia(golden, alpha), words, alergia(words, alpha)),)]

    return _judge(test, trained, model, win, judge, "distance double")


def explained(test: DataFrame, trained: DataFrame, threshold: float, model: str = "model", win: str = "win", alpha: float = 0.05) -> DataFrame:
    """(model, win, distance, word, p) of windows further than `threshold` from their model: the model's most probable word that the window's own merged automaton lacks."""
    from weftline.operators.algebra import Weighted

    def judge(golden: list | None, words: list) -> list[tuple]:
        a, b = None if golden is None else alergia(golden, alpha), alergia(words, alpha)
        d = _window_distance(a, words, b)
        if d <= threshold:
            return []
        return [(d, *(Weighted.of(a).difference(Weighted.of(b)).most_probable() if a else (None, None)))]

    return _judge(test, trained, model, win, judge, "distance double, word array<string>, p double")
