"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Facts are measured by array expressions inside the row. Each rule maps facts to a vote: 1 (good), -1 (bad) or
0 (abstains). Votes are counted by pattern over the whole corpus (at most 3^rules rows), expectation-maximisation of a
two-class model with vote chances for each rule and class runs on that table, and the posterior of each row is a sum of log odds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrec.llm.common import SPACE, staged

WINDOW = 8

#: (rule, votes bad where, votes good where); it abstains elsewhere. A rule needs words to say anything.
RULES = (
    ("length", "n_words < 20", "n_words >= 50"),
    ("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    ("word_size", "word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("symbol_share", "50 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("variety", "n_words >= 20 and 5 * n_distinct < n_words", "n_words >= 20 and 4 * n_distinct >= n_words"),
)


def facts(docs: DataFrame) -> DataFrame:
    """Add the measured facts of every whole text; a null or empty text has none of anything.

    ``n_repeat_words`` counts words inside 8-word windows that occur twice or more in the text. Windows are compared by
    64-bit hashes within one text; most texts end at the first test, that all windows differ.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select("*", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
                        F.array_remove(F.split(text, SPACE, -1), "").alias("__w"), text.alias("__t"))
    n = F.size("__w")
    hashes = F.transform("__w", lambda x: F.xxhash64(x))
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("__h", i, WINDOW))))
    step = lines.select("*", hashes.alias("__h")).select("*", windows.alias("__g"))
    distinct = step.withColumn("__all", F.size(F.array_distinct("__g")) == F.size("__g"))
    pairs = F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = distinct.withColumn("__s", F.when(~F.col("__all"), pairs))
    before = lambda i: (i > 0) & (F.get("__s", i - 1)["h"] == F.get("__s", i)["h"])
    after = lambda i: F.coalesce(F.get("__s", i + 1)["h"] == F.get("__s", i)["h"], F.lit(False))
    again = F.array_sort(F.transform(
        F.filter(F.transform("__s", lambda x, i: F.when(before(i) | after(i), x["i"])), lambda x: x.isNotNull()), lambda x: x))
    found = sorted_.withColumn("__r", again)
    covered = F.aggregate(F.transform("__r", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__r", i + 1) - p, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        *docs.columns, n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size(F.array_distinct("__h")).cast("long").alias("n_distinct"))


def votes(measured: DataFrame, rules=RULES) -> DataFrame:
    """Add ``votes``, the array of the rules' votes."""
    vote = [F.when((F.col("n_words") > 0) & F.expr(good), 1).when(F.expr(bad), -1).otherwise(0).cast("int") for _, bad, good in rules]
    return measured.withColumn("votes", F.array(*vote))


#: Starting chances of the votes (bad, abstain, good) in good and in bad rows.
START_GOOD, START_BAD = (0.02, 0.28, 0.70), (0.40, 0.30, 0.30)


@dataclass(frozen=True)
class VoteModel:
    """Share of good rows and, for each rule, the chances of its votes (-1, 0, 1) in good and in bad rows."""

    prior: float
    good: tuple[tuple[float, ...], ...]
    bad: tuple[tuple[float, ...], ...]

    def log_odds(self, at: Column) -> Column:
        """Log odds of good: prior plus each vote's log-likelihood ratio."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, (g, b) in enumerate(zip(self.good, self.bad)):
            vote = F.get(at, F.lit(j))
            weight = [math.log(x / y) for x, y in zip(g, b)]
            total = total + F.when(vote == -1, weight[0]).when(vote == 0, weight[1]).otherwise(weight[2])
        return total

    def accuracy(self) -> list[float]:
        """Chance that each rule is right when it votes."""
        out = []
        for g, b in zip(self.good, self.bad):
            right = self.prior * g[2] + (1 - self.prior) * b[0]
            out.append(right / (right + self.prior * g[0] + (1 - self.prior) * b[2]))
        return out


def _oriented(good: list[float], bad: list[float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """A rule stays on its side: its bad vote is at least twice as likely in bad rows, its good vote no likelier there."""
    gm, gp = min(good[0], 0.1), good[2]
    bm, bp = min(0.9, max(bad[0], 2 * gm)), min(bad[2], gp)
    bp = min(bp, 0.98 - bm)
    return (gm, max(1e-6, 1 - gm - gp), gp), (bm, max(1e-6, 1 - bm - bp), bp)


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, weight: float = 10.0) -> VoteModel:
    """Expectation-maximisation over counted vote patterns, a two-class model with rules independent given the class.

    Chances start at ``START_GOOD`` and ``START_BAD`` and keep them as a Dirichlet prior of ``weight`` votes; rules keep
    their orientation and the share of good rows stays in [0.5, 0.98]. An empty corpus gives the starting model.
    """
    m = len(patterns[0][0]) if patterns else len(RULES)
    prior, good, bad = 0.8, [START_GOOD] * m, [START_BAD] * m
    patterns = sorted(patterns)
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        mass = 0.0
        seen_g = [[weight * x for x in START_GOOD] for _ in range(m)]
        seen_b = [[weight * x for x in START_BAD] for _ in range(m)]
        for vote, count in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[j][v + 1] / bad[j][v + 1]) for j, v in enumerate(vote))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            mass += p * count
            for j, v in enumerate(vote):
                seen_g[j][v + 1] += p * count
                seen_b[j][v + 1] += (1 - p) * count
        prior = min(0.98, max(0.5, mass / total))
        pairs = [_oriented([x / sum(g) for x in g], [x / sum(b) for x in b]) for g, b in zip(seen_g, seen_b)]
        good, bad = [g for g, _ in pairs], [b for _, b in pairs]
    return VoteModel(prior, tuple(good), tuple(bad))


def judged(docs: DataFrame, rules=RULES, least: float = 0.5) -> DataFrame:
    """Add facts, ``votes``, ``base_failed``, ``p_good`` (posterior) and ``kept``.

    ``kept`` is false where the base rules fail, else p_good >= ``least``. Null and empty texts have no words, so they
    fail the base rules. Facts and votes are staged once; the pattern table has at most 3^rules rows.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    if {"n_words", "votes", "n_lines"} & set(extra):
        raise ValueError("columns n_words, n_lines and votes are made here; rename them first")
    seen = staged(votes(facts(docs), rules).drop("text"))
    patterns = [(tuple(r["votes"]), r["n"]) for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    model = fit_votes(patterns)
    odds = model.log_odds(F.col("votes"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return seen.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= least))
