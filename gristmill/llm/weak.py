"""Weak supervision: the accuracies of heuristic voters without gold labels.

The voters' patterns are counted over all documents by Spark; at most
3 ** voters patterns exist, so the table that the driver sees does not grow
with the corpus. Expectation-maximisation then runs on those counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prior votes that count like observed ones: (bad votes, good votes) of good
#: and of bad documents, and (good, bad) documents. They settle empty tables.
PRIOR_GOOD = (0.2, 19.8)
PRIOR_BAD = (6.0, 14.0)
PRIOR_CLASS = (9.0, 1.0)
#: A voter calls at most this share of good documents bad; voters are written so.
MOST_FALSE = 0.02


@dataclass(frozen=True)
class Accuracies:
    """P(good), and each voter's probability of voting bad, by class."""

    good: float
    bad_if_good: tuple[float, ...]
    bad_if_bad: tuple[float, ...]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        total = math.log(self.good / (1 - self.good))
        for vote, g, b in zip(votes, self.bad_if_good, self.bad_if_bad):
            if vote < 0:
                total += math.log(g / b)
            elif vote > 0:
                total += math.log((1 - g) / (1 - b))
        return total

    def posterior(self, votes: dict[str, Column]) -> Column:
        """The probability that a document is good, from its vote columns."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for column, g, b in zip(votes.values(), self.bad_if_good, self.bad_if_bad):
            odds = odds + F.when(column < 0, math.log(g / b)).when(column > 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def vote_patterns(voted: DataFrame, names: list[str]) -> list[tuple[tuple[int, ...], int]]:
    """Every vote pattern that occurs and its number of documents."""
    if len(names) > 9:
        raise ValueError("at most 9 voters: their patterns are counted on the driver")
    rows = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((tuple(int(r[name]) for name in names), r["n"]) for r in rows)


def estimate(patterns: list[tuple[tuple[int, ...], int]], voters: int, rounds: int = 40) -> Accuracies:
    """Expectation-maximisation for independent voters that may abstain.

    Starts from "any bad vote makes a document suspect" and alternates the
    posterior of each pattern with the maximum a posteriori accuracies.
    """
    belief = {votes: 0.25 if min(votes, default=1) < 0 else 0.98 for votes, _ in patterns}
    model = Accuracies(0.9, (0.01,) * voters, (0.3,) * voters)
    for _ in range(rounds):
        docs = list(PRIOR_CLASS)
        tally = [[list(PRIOR_GOOD), list(PRIOR_BAD)] for _ in range(voters)]
        for votes, n in patterns:
            share = (n * belief[votes], n * (1 - belief[votes]))
            docs[0] += share[0]
            docs[1] += share[1]
            for i, vote in enumerate(votes):
                if vote:
                    for side in (0, 1):
                        tally[i][side][0 if vote < 0 else 1] += share[side]
        rate = [[side[0] / (side[0] + side[1]) for side in pair] for pair in tally]
        # a voter speaks against what it calls bad, never for it
        model = Accuracies(docs[0] / sum(docs), tuple(min(r[0], r[1], MOST_FALSE) for r in rate), tuple(max(r[0], r[1]) for r in rate))
        belief = {votes: 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(votes))))) for votes, _ in patterns}
    return model
