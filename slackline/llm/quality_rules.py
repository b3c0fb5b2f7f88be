"""Quality rules as weak supervision (operator 8).

Twelve rules each vote good (+1), bad (-1) or abstain (0) on a document. No rule
decides alone: expectation-maximisation over the counts of all vote patterns in
the corpus estimates each rule's accuracies and the share of good documents, and a
document stays when its posterior probability of being good is at least 0.5. Rules
overlap, so that what is wrong with a document is seen by two of them or more; one that often
misfires on documents that all others call good is found out and weighs little. A
base rule on length and repetition rejects by itself, as its contract asks.

Cost: one pass over the texts, whose counts are kept in the shared folder beside the
carried columns, then one aggregation to at most 3**12 pattern rows, whatever the
corpus' size (a few dozen in practice), on which the model is fitted.

Defined results: null, empty and blank texts have all counts 0 and fail the base
rule; null ids stay null; repeated rows give a row each; an empty table gives an
empty result; columns other than the named ones aren't read, and keep_good() returns them as
they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slackline.llm import storage, textstats
from slackline.llm.frames import internal, long_fields, map_texts

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: What is believed of every rule before any document, and of how many documents that belief has the weight:
#: how often it votes good when it speaks on a good document, and bad on a bad one (it knows one kind of fault).
BELIEF_GOOD, BELIEF_BAD, BELIEF_WEIGHT = 0.99, 0.35, 20.0
_PREFIX = "_q_"


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def _share(part: str, whole: str) -> Column:
    return F.col(_PREFIX + part) / F.greatest(F.col(_PREFIX + whole), F.lit(1))


def rules() -> dict[str, Column]:
    """Each rule's vote, an expression over the counts."""
    n = F.col(_PREFIX + "n_words")
    symbols, shouting = _share("n_symbols", "n_words"), _share("n_upper", "n_letters")
    repeats, copies = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    exclaims, pipes = _share("n_exclaim", "n_words"), _share("n_pipes", "n_words")
    stops = (F.col(_PREFIX + "n_stops") + F.col(_PREFIX + "n_commas")) / F.greatest(n, F.lit(1))
    length, top, long = _share("word_chars", "n_words"), _share("n_top_word", "n_words"), _share("n_long_words", "n_words")
    letters, small = _share("n_letters", "word_chars"), _share("n_short_words", "n_words")
    return {
        "length": _vote(n >= 30, n < MIN_WORDS),
        "symbols": _vote(symbols < 0.1, symbols > 0.3),
        "repeats": _vote(repeats < 0.05, repeats > 0.2),
        "copied_lines": _vote((copies == 0) & (F.col(_PREFIX + "n_lines") > 2), copies > 0.3),
        "shouting": _vote(shouting < 0.2, shouting > 0.5),
        "exclaims": _vote(exclaims < 0.05, exclaims > 0.3),
        "tables": _vote(pipes == 0, pipes > 0.2),
        "sentences": _vote((stops >= 0.02) & (stops < 0.5), (n >= 30) & (stops < 0.005)),
        "top_word": _vote((n >= 30) & (top < 0.2), (n >= 30) & (top > 0.4)),
        "letters": _vote(letters >= 0.8, (n > 0) & (letters < 0.7)),
        "small_words": _vote(small >= 0.12, (n >= 30) & (small < 0.05)),
        "word_length": _vote((length >= 2.5) & (length < 9) & (long < 0.2), (n > 0) & ((length < 2) | (length > 14))),
    }


@dataclass(frozen=True)
class VoteModel:
    """bias: log odds of good before any vote. for_good, for_bad: what a rule's vote adds to them."""

    bias: float
    for_good: tuple[float, ...]
    for_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(self.bias)
        for plus, minus, vote in zip(self.for_good, self.for_bad, votes, strict=True):
            odds = odds + F.when(vote > 0, F.lit(plus)).when(vote < 0, F.lit(minus)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_votes(patterns: np.ndarray, count: np.ndarray, rounds: int = 1000) -> VoteModel:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and their counts.

    A rule has two accuracies: how often it votes good when it speaks on a good document, and
    how often bad when it speaks on a bad one. Nothing bounds them: BELIEF_WEIGHT documents' worth
    of belief is added to what the corpus says, which also tells which of the two classes
    is called good. Without any document the belief stays.
    """
    width = patterns.shape[1] if patterns.ndim == 2 else 0
    up, down = (patterns > 0).reshape(-1, width).astype(float), (patterns < 0).reshape(-1, width).astype(float)
    shares = lambda w, belief: ((w @ up + BELIEF_WEIGHT * belief) / (w @ (up + down) + BELIEF_WEIGHT), (w @ down + BELIEF_WEIGHT * (1 - belief)) / (w @ (up + down) + BELIEF_WEIGHT))
    none = np.zeros(len(up))
    good, bad, odds = shares(none, BELIEF_GOOD), shares(none, 1 - BELIEF_BAD), float(np.log(9.0))  # of votes: good, bad
    for _ in range(rounds if count.sum() else 0):
        plus, minus = np.log(good[0]) - np.log(bad[0]), np.log(good[1]) - np.log(bad[1])
        sure = 1 / (1 + np.exp(-np.clip(odds + up @ plus + down @ minus, -700, 700)))
        g, b, last = count * sure, count * (1 - sure), good[0]
        good, bad = shares(g, BELIEF_GOOD), shares(b, 1 - BELIEF_BAD)
        odds = float(np.log(g.sum() + 1) - np.log(b.sum() + 1))
        if np.abs(good[0] - last).max(initial=0) < 1e-10:
            break
    plus, minus = np.log(good[0]) - np.log(bad[0]), np.log(good[1]) - np.log(bad[1])
    return VoteModel(odds, tuple(map(float, plus)), tuple(map(float, minus)))


def quality_verdicts(df: DataFrame, text: str = "text", carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, quality (the posterior) and kept. Fits on all rows of ``df``."""
    carry = list(carry)
    named, own, of = internal(df, text, carry)
    fields = [T.StructField(_PREFIX + f.name, f.dataType) for f in long_fields(*textstats.FIELDS)]
    counted = storage.written(map_texts(named, of, fields, lambda: textstats.counts, own), "quality-counts")
    votes = rules()
    names = list(votes)
    voted = counted.select(*[v.alias(k) for k, v in votes.items()])
    found = voted.groupBy(*names).agg(F.count("*").alias("_n")).collect()  # at most 3**12 rows
    model = fit_votes(np.array([[r[k] for k in names] for r in found], float).reshape(len(found), len(names)), np.array([r["_n"] for r in found], float))
    n, repeats = F.col(_PREFIX + "n_words"), F.col(_PREFIX + "n_repeat_words")
    base_failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    return counted.select(
        *[F.col(o).alias(c) for c, o in zip(carry, own, strict=True)],
        *[F.col(_PREFIX + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"),
        model.posterior(list(votes.values())).alias("quality"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose verdict is kept, with the columns they came with."""
    columns = docs.columns
    unique = [f"_d{i}" for i in range(len(columns))]
    place = columns.index(text)
    verdicts = quality_verdicts(docs.toDF(*unique), unique[place], unique)
    return verdicts.filter("kept").select(*unique).toDF(*columns)
