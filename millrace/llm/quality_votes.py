"""Quality rules by weak supervision. DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document or abstains (0). How far each rule can be trusted is not given: the
rules' accuracies, as the chances of each vote on good and on bad documents, and the share of good documents are estimated
by expectation-maximisation from how the votes fall together. The estimation needs only the number of documents per pattern of votes, at most 3 ** rules rows, counted
with map-side combining over all documents. A document's posterior probability of being good then decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.shared import let, stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MAX_RULES = 10     # 3 ** 10 = 59 049 patterns of votes at most reach the driver


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that are found twice or more, the first one included.

    Windows are compared by a 64-bit hash of their words' hashes: two different windows of one text are taken for
    equal with a chance of about (words ** 2) / 2 ** 65.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window),
                                                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(F.transform(s, lambda x, j: F.when(
            F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)) | ((j > 0) & F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))), x["i"])),
            lambda i: i.isNotNull()))
        return let(F.sort_array(twice), lambda d: F.aggregate(
            F.transform(d, lambda i, j: F.least(F.lit(window), F.coalesce(F.get(d, j + 1) - i, F.lit(window)))), F.lit(0), lambda a, n: a + n))

    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(F.size(words) >= window, some).otherwise(0).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules look at; a null text has none of anything."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({"_words": words_of(whole), "_lines": F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")})
    minus = lambda drop: F.length(whole) - F.length(F.translate(whole, drop, ""))
    return (found.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.translate(whole, SPACE, "")).cast("long"), "n_symbols": minus(SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_lines": F.size("_lines").cast("long"),
        "n_ends": minus(".!?").cast("long"), "n_digits": minus("0123456789").cast("long"), "n_capitals": minus("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "n_repeat_words": repeated_words(F.col("_words"))}).drop("_words", "_lines"))


@dataclass(frozen=True)
class VotingRule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains; so it does on null."""
    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        yes, no = (F.coalesce(F.expr(x), F.lit(False)) for x in (self.good, self.bad))
        return F.when(yes, 1).when(no, -1).otherwise(0)


RULES = (
    VotingRule("length", "n_words >= 50", "n_words < 5"),
    VotingRule("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    VotingRule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    VotingRule("symbol_characters", "500 * n_symbols <= word_chars", "50 * n_symbols > word_chars"),
    VotingRule("repeated_lines", "n_dup_lines = 0 AND n_lines >= 3", "5 * n_dup_lines > 2 * n_lines"),
    VotingRule("repeated_windows", "100 * n_repeat_words <= n_words AND n_words >= 10", "100 * n_repeat_words > 20 * n_words"),
    VotingRule("sentences", "n_ends * 40 >= n_words AND n_ends * 2 <= n_words", "n_ends * 200 < n_words OR n_ends > n_words"),
    VotingRule("digits", "100 * n_digits <= word_chars", "3 * n_digits > word_chars"),
    VotingRule("capitals", "n_capitals * 4 <= n_words + 4", "n_capitals * 3 > word_chars"),
)
#: Where the estimation begins, and what it is drawn to: the chances of a bad vote, an abstention and a good vote. Good documents rarely get a
#: bad vote; bad ones are bad in one way or two and pass the other rules.
GOOD_VOTES, BAD_VOTES = (0.01, 0.19, 0.8), (0.25, 0.05, 0.7)


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and per rule the chances of the votes -1, 0 and 1 on a good and on a bad document."""
    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def weights(self, rule: int) -> list[float]:
        """What each vote of the rule adds to the log odds of being good."""
        return [math.log(g / b) for g, b in zip(self.good[rule], self.bad[rule])]

    def accuracy(self, rule: int) -> float:
        """The chance that a vote of the rule is right."""
        g, b = self.good[rule], self.bad[rule]
        right = self.prior * g[2] + (1 - self.prior) * b[0]
        return right / (right + self.prior * g[0] + (1 - self.prior) * b[2])

    def logit(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(self.weights(j)[v + 1] for j, v in enumerate(votes))

    def posterior(self, votes: list[Column]) -> Column:
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, v in enumerate(votes):
            logit = logit + F.get(F.array(*[F.lit(w) for w in self.weights(j)]), v + 1)
        return 1 / (1 + F.exp(-logit))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200, tolerance: float = 1e-9, weight: float = 0.05) -> VoteModel:
    """Expectation-maximisation over (votes, number of documents) pairs.

    Votes are taken as independent given the class. The starting chances also stand for ``weight`` times the corpus as if they had
    been seen, so that the classes keep their meaning and a rule that no other agrees with keeps its word, at every size alike.
    """
    total = sum(n for _, n in patterns) or 1
    model = VoteModel(0.85, (GOOD_VOTES,) * rules, (BAD_VOTES,) * rules)
    for _ in range(rounds):
        share = [weight * total * 0.85, weight * total * 0.15]
        seen = [[[share[0] * c for c in GOOD_VOTES] for _ in range(rules)], [[share[1] * c for c in BAD_VOTES] for _ in range(rules)]]
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.logit(votes)))))
            for k, mass in enumerate((n * p, n * (1 - p))):
                share[k] += mass
                for j, v in enumerate(votes):
                    seen[k][j][v + 1] += mass
        new = VoteModel(min(0.999, max(0.001, share[0] / sum(share))), *(tuple(tuple(x / sum(row) for x in row) for row in part) for part in seen))
        moved = abs(new.prior - model.prior) + sum(abs(x - y) for a, b in ((new.good, model.good), (new.bad, model.bad)) for r, q in zip(a, b) for x, y in zip(r, q))
        model = new
        if moved < tolerance * rules:
            break
    return model


def judge_quality(docs: DataFrame, rules: tuple[VotingRule, ...] = RULES, threshold: float = 0.5, text: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with the counts, base_failed, one vote per rule, posterior and kept.

    base_failed: fewer than ten words, or over a fifth of them in repeated windows. kept: the posterior is at
    least ``threshold`` and the base has not failed. Null and empty texts fail the base. Equal rows get equal
    results; an empty table gives an empty result. Input columns named like an added one are replaced.
    """
    if not 0 < len(rules) <= MAX_RULES:
        raise ValueError(f"between 1 and {MAX_RULES} rules, not {len(rules)}")
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_ends", "n_digits", "n_capitals", "n_repeat_words",
             "base_failed", "votes", "posterior", "kept"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    counted = with_counts(docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)], F.col(text).alias("_text")), "_text")
    voted = counted.drop("_text").withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), "votes": F.array(*[r.vote() for r in rules])})
    voted = stored(voted, "quality-votes")   # the texts are read and counted once
    seen = [(tuple(r.votes), r.n) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()]
    model = fit_votes(seen, len(rules))
    posterior = model.posterior([F.get(F.col("votes"), F.lit(i)) for i in range(len(rules))])
    out = voted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], *[c for c in out.columns if not c.startswith("in_")])
