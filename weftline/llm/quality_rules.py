"""Quality rules (operator 9, native): rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Only DataFrame functions touch rows. The votes of m rules make at most 3**m patterns, so the pattern counts that the
driver fits on are bounded by the rules, not by the data.

Defined results: a null, empty or blank text has no words; it fails the base rules and is not kept. Repeated rows each
get a result. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stage

#: Bytes that part words, as a character class.
SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 5


def counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and some plain shape measures."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    base = base.select("doc_id", "t", F.filter(F.split("t", f"{SPACE}+"), lambda w: w != "").alias("w"))
    n = F.size("w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, WINDOW))))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    shaped = base.select("t", "doc_id", n.alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), F.size(F.array_distinct("w")).alias("n_distinct"), windows.alias("s"), F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("n_unique_lines"))
    # Only a text with equal windows has them sorted, each with its place, so that equal ones stand side by side.
    none = F.array().cast("array<struct<s: string, i: int>>")
    ordered = F.when(F.size(F.array_distinct("s")) < F.size("s"), F.array_sort(F.transform("s", lambda x, i: F.struct(x.alias("s"), (i + 1).alias("i"))))).otherwise(none)
    shaped = shaped.withColumn("g", ordered).drop("s")
    m = F.size("g")
    same = lambda i, j: F.when((j >= 1) & (j <= m), F.get("g", i - 1)["s"] == F.get("g", j - 1)["s"]).otherwise(False)
    twice = F.filter(F.sequence(F.lit(1), m), lambda i: same(i, i - 1) | same(i, i + 1))
    places = F.when(m >= 2, F.array_sort(F.transform(twice, lambda i: F.get("g", i - 1)["i"]))).otherwise(F.array().cast("array<int>"))
    found = shaped.select(
        "doc_id", "n_words", "n_distinct", "n_lines",
        "word_chars",
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).alias("n_symbols"),
        (F.col("n_lines") - F.col("n_unique_lines")).alias("n_dup_lines"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("t", "[^0-9]+", "")).alias("n_digits"),
        places.alias("p"),
    )
    # A window at p covers p .. p + 4; of each only the part that the next one doesn't cover counts.
    gain = F.zip_with(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("p") > 0, F.lit(WINDOW) + F.aggregate(gain, F.lit(0), lambda a, x: a + x)).otherwise(0)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits")
    return found.withColumn("n_repeat_words", covered).select("doc_id", *(F.col(c).cast("long").alias(c) for c in names))


def votes() -> dict[str, Column]:
    """Each rule's vote on the counts: 1 good, 0 bad, -1 abstains. A rule that looks for one kind of junk never votes good."""
    c = F.col

    def rule(bad: Column, sees: Column, good: Column | None = None) -> Column:
        vote = F.when(~sees, -1).when(bad, 0)
        return (vote if good is None else vote.when(good, 1)).otherwise(-1)

    words = c("n_words") > 0
    return {
        "length": rule(c("n_words") < 10, F.lit(True), c("n_words") >= 40),
        "word_length": rule((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 12 * c("n_words")), words, c("word_chars").between(3 * c("n_words"), 10 * c("n_words"))),
        "symbols": rule(8 * c("n_symbols") > c("n_words"), words),
        "lines": rule(2 * c("n_dup_lines") > c("n_lines"), c("n_lines") >= 3),
        "repeats": rule(100 * c("n_repeat_words") > 18 * c("n_words"), c("n_words") >= 20),
        "variety": rule(100 * c("n_distinct") < 15 * c("n_words"), c("n_words").between(20, 2000)),
        "capitals": rule(2 * c("n_upper") > c("word_chars"), c("word_chars") >= 50),
        "digits": rule(4 * c("n_digits") > c("word_chars"), c("word_chars") >= 50),
    }


#: Where the rates of votes (good, bad, abstaining) begin, for good documents and for bad ones; they also smooth the counts, as one document.
START = ({1: 0.6, 0: 0.01, -1: 0.39}, {1: 0.3, 0: 0.3, -1: 0.4})
#: Each rule is built to blame one good document in a hundred at most and to catch a twentieth of the bad ones at least.
#: Without these bounds the fit may take any two rules that agree for the two classes.
MOST_BLAMED, LEAST_CAUGHT = 0.01, 0.05
Rates = tuple[dict[int, float], dict[int, float]]


def fit(patterns: list[tuple[tuple[int, ...], int]], m: int, rounds: int = 50, prior: float = 0.9) -> tuple[float, list[Rates]]:
    """(share of good documents, for each of m rules the rates of its votes in good and in bad ones), by expectation-maximisation.

    The bounds on blame keep each rule's sense."""
    rates: list[Rates] = [START] * m
    for _ in range(rounds):
        good = total = 0.0
        seen = [(dict(START[0]), dict(START[1])) for _ in range(m)]
        for vote, n in patterns:
            p = posterior(vote, prior, rates)
            good, total = good + n * p, total + n
            for (g, b), v in zip(seen, vote, strict=True):
                g[v] += n * p
                b[v] += n * (1 - p)
        prior = min(0.99, max(0.7, good / total)) if total else prior
        rates = []
        for g, b in seen:
            g, b = ({v: x / sum(r.values()) for v, x in r.items()} for r in (g, b))
            g[0], b[0] = min(g[0], MOST_BLAMED), max(b[0], LEAST_CAUGHT)
            rates.append((g, b))
    return prior, rates


def weight(rates: Rates, vote: int) -> float:
    """What a vote, or abstaining, adds to the log-odds."""
    return max(-12.0, min(12.0, log(rates[0][vote] / rates[1][vote])))


def posterior(vote: tuple[int, ...], prior: float, rates: list[Rates]) -> float:
    return 1 / (1 + exp(-log(prior / (1 - prior)) - sum(weight(r, v) for r, v in zip(rates, vote, strict=True))))


def quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The counts, base_failed, kept and p_good, the posterior, of each document."""
    voted = stage(counts(docs, text, doc_id).select("*", *(v.alias(f"vote_{k}") for k, v in votes().items())), "votes")
    columns = [f"vote_{k}" for k in votes()]
    patterns = [(tuple(r[c] for c in columns), r["n"]) for r in voted.groupBy(*columns).agg(F.count("*").alias("n")).collect()]
    prior, rates = fit(sorted(patterns), len(columns))
    odds = F.lit(log(prior / (1 - prior)))
    for c, r in zip(columns, rates, strict=True):
        odds = odds + F.when(F.col(c) == 1, weight(r, 1)).when(F.col(c) == 0, weight(r, 0)).otherwise(weight(r, -1))
    p = 1 / (1 + F.exp(-odds))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (p >= least)).alias("kept"), F.round(p, 6).alias("p_good")
    )
