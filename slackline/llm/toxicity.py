"""Toxicity by a weighted finite-state pattern grammar (operator 6).

A text is read clause by clause. The lexical transducer, an automaton over letters, writes
for each word its class (insult, threat, target, negation, report, quotation mark, intent or other) and, for
insults and threats, a weight. Word-level transducers then read classes and write them with
marks: an insult or threat after a negation is marked negated, after a target targeted, in a report
or quotation reported; a threat after a word of intent is marked meant, a target soon after an insult
aimed. Each is a table of states and arcs, made by window() or report(); compose() makes one machine of them. Its last
arcs carry weights by the marked class, so what is scored is a clause's matches in their context, not lone words.
A logistic curve over the clauses' scores makes the document's score.

Weights of words are learnt from labels: stems of words that toxic documents have and others
don't, beside a fixed seed list. Weights of arcs are learnt by logistic loss, drawn towards
PRIOR, which alone decides where a class isn't met. Both come from a bounded sample (6,000
labelled rows of each class at most, first by hash). Labels, language, source and id are never inputs.

Cost: the sample's words are counted once; every document is scored in one pass in time
linear in its length, without a shuffle. Clauses are whole, however long. The lexicon has as many entries as the
sample supports: each holds a share of toxic rows or adds LEAST_NEW of them at least.

Defined results: null and empty texts match nothing and get the score of a text without
matches; without both classes among the labels the seed list and PRIOR alone decide; null ids give
held_out null; repeated rows give a row each; other columns, whatever their names, aren't read; an
empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slackline.llm.frames import map_texts
from slackline.llm.labelled import clean_labels, fold, training_sample

FOLDS, HELD_OUT = 5, 0
#: A learnt stem that isn't common has at least this share of the toxic rows that no other stem has.
LEAST_NEW = 0.001
STEM_LETTERS = range(3, 9)
#: Of documents that have a learnt stem, at least so many are toxic in a sample that has as many of either class.
PRECISION = 0.99

INSULT_SEEDS = "idiot idiots moron morons imbecile loser losers scum trash worthless pathetic disgusting stupid clown vermin bastard coward pig filth".split()
THREAT_SEEDS = "kill hurt destroy murder strangle stab shoot beat".split()
TARGETS = frozenset("you your yours yourself u he she they him her them his their these those people du sie ihr tu vous il elle ils usted ellos ella".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca".split())
REPORTS = frozenset("said says called calls wrote writes claimed claims quoted reported heard sagte dit dijo".split())
INTENTS = frozenset("will gonna going i'll should must want".split())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
_ENDS = re.compile("[.!?;:\n]")
#: Words for which a negation, target, intent or insult reaches on.
NEAR = 4
_KINDS = {w: "intent" for w in INTENTS} | {w: "report" for w in REPORTS} | {w: "negation" for w in NEGATIONS} | {w: "target" for w in TARGETS} | dict.fromkeys("\"“”«»", "quote")
CLASSES = ("insult", "threat", "target", "negation", "report", "quote", "intent", "other")
_PAYING = frozenset(["insult", "threat"])
#: What a mark multiplies an arc's weight by before anything is learnt; "idle" is a threat that isn't meant.
PRIOR = {"negated": 0.4, "targeted": 1.5, "reported": 0.5, "idle": 0.3, "aimed": 0.5}


@dataclass(frozen=True)
class Transducer:
    """Deterministic, state 0 first. arcs: from a state and a symbol to the symbol written and the next state.
    A symbol is a class and its marks, joined by "|"."""

    states: int
    arcs: dict[tuple[int, str], tuple[str, int]]

    def alphabet(self) -> frozenset[str]:
        """What it writes."""
        return frozenset(out for out, _ in self.arcs.values())

    def write(self, symbols: Iterable[str]) -> list[str]:
        state, found = 0, []
        for symbol in symbols:
            out, state = self.arcs[state, symbol]
            found.append(out)
        return found


def _class(symbol: str) -> str:
    return symbol.partition("|")[0]


def window(alphabet: Iterable[str], openers: frozenset[str], marked: frozenset[str], mark: str, once: bool = False, near: int = NEAR) -> Transducer:
    """Marks symbols of the classes ``marked`` that come at most ``near`` symbols after one of the classes ``openers``,
    or only the first of them. The state is how far the last opener still reaches."""
    arcs = {}
    for state in range(near + 1):
        for symbol in alphabet:
            hit = state > 0 and _class(symbol) in marked
            left = near if _class(symbol) in openers else 0 if hit and once else max(0, state - 1)
            arcs[state, symbol] = f"{symbol}|{mark}" if hit else symbol, left
    return Transducer(near + 1, arcs)


def report(alphabet: Iterable[str]) -> Transducer:
    """Marks insults and threats after a word of report, or between quotation marks."""
    arcs = {}
    for state in (0, 1):
        for symbol in alphabet:
            kind = _class(symbol)
            after = 1 if kind == "report" else 1 - state if kind == "quote" else state
            arcs[state, symbol] = f"{symbol}|reported" if state and kind in _PAYING else symbol, after
    return Transducer(2, arcs)


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str] = CLASSES) -> Transducer:
    """The transducer that writes what ``second`` writes on what ``first`` writes: pairs of states that can be reached."""
    number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        pair = todo.pop()
        for symbol in alphabet:
            between, one = first.arcs[pair[0], symbol]
            out, two = second.arcs[pair[1], between]
            if (one, two) not in number:
                number[one, two] = len(number)
                todo.append((one, two))
            arcs[number[pair], symbol] = out, number[one, two]
    return Transducer(len(number), arcs)


@lru_cache(maxsize=1)
def machine() -> Transducer:
    """Negation, target, report, intent and aim in one."""
    found = window(CLASSES, frozenset(["negation"]), _PAYING, "negated")
    for build in (
        lambda a: window(a, frozenset(["target"]), _PAYING, "targeted"), report,
        lambda a: window(a, frozenset(["intent"]), frozenset(["threat"]), "meant"), lambda a: window(a, _PAYING, frozenset(["target"]), "aimed", once=True),
    ):
        found = compose(found, build(found.alphabet()))
    return found


@lru_cache(maxsize=1)
def paying() -> tuple[str, ...]:
    """The symbols whose arcs have a weight."""
    return tuple(sorted(s for s in machine().alphabet() if _class(s) in _PAYING or s.endswith("|aimed")))


def prior_weight(symbol: str) -> float:
    kind, *marks = symbol.split("|")
    marks += ["idle"] * (kind == "threat" and "meant" not in marks)
    return float(np.prod([PRIOR.get(m, 1.0) for m in marks]))


@dataclass
class Entry:
    kind: str
    weight: float
    whole: bool


@dataclass
class Grammar:
    """entries: letters of a stem or word to what the lexical automaton pays for it. arcs: the weight of each of
    paying(). curve: see calibrate()."""

    entries: dict[str, Entry]
    arcs: np.ndarray = field(default_factory=lambda: np.array([prior_weight(s) for s in paying()]))
    curve: np.ndarray = field(default_factory=lambda: np.array([-2.0, 1.0, 0.5, 0.5]))

    def compiled(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for letters, entry in self.entries.items():
            automaton.add_word(letters, (len(letters), entry))
        if self.entries:
            automaton.make_automaton()
        return automaton


def matches(automaton, low: str) -> list[tuple[int, int, Entry]]:
    """Start and end of the words that an entry accepts from their first letter on; the weightiest entry of a word counts."""
    found: dict[int, tuple[int, int, Entry]] = {}
    if not len(automaton):
        return []
    size = len(low)
    for last, (length, entry) in automaton.iter(low):
        start, end = last - length + 1, last + 1
        if start and low[start - 1].isalpha():
            continue
        if entry.whole and end < size and low[end].isalpha():
            continue
        if start not in found or entry.weight > found[start][2].weight:
            found[start] = (start, end, entry)
    return [found[k] for k in sorted(found)]


def classes(low: str, begin: int, end: int, lexical: dict[int, Entry]) -> list[tuple[str, float]]:
    """The class and weight of each word of a clause. lexical: entries by the place where they begin."""
    words, left = [], dict(lexical)
    for m in _WORD.finditer(low, begin, end):
        inside = low.find("'", m.start(), m.end()) + 1
        entry = left.pop(m.start(), None) or (left.pop(inside, None) if inside else None)
        words.append((entry.kind, entry.weight) if entry else (_KINDS.get(m[0], "other"), 0.0))
    return words + [(e.kind, e.weight) for e in left.values()]  # entries that begin inside what _WORD takes as one word


def clause_profile(words: list[tuple[str, float]]) -> dict[str, float]:
    """What the machine writes on a clause: the weights of each paying symbol, summed; an aimed target counts one."""
    found: dict[str, float] = {}
    for out, (_, weight) in zip(machine().write(kind for kind, _ in words), words, strict=True):
        if weight or out.endswith("|aimed"):
            found[out] = found.get(out, 0.0) + (weight or 1.0)
    return found


def profiles(automaton, text: str | None) -> tuple[list[dict[str, float]], int]:
    """The profile of each clause of a whole text in which something was matched, and the number of different entries."""
    low = (text or "").lower()
    hits = matches(automaton, low)
    if not hits:
        return [], 0
    stops = [m.start() for m in _ENDS.finditer(low)]
    found, k = [], 0
    while k < len(hits):
        place = bisect_left(stops, hits[k][0])
        begin, end = stops[place - 1] + 1 if place else 0, stops[place] if place < len(stops) else len(low)
        lexical = {}
        while k < len(hits) and hits[k][0] < end:
            lexical[hits[k][0]] = hits[k][2]
            k += 1
        found.append(clause_profile(classes(low, begin, end, lexical)))
    return found, len({id(e) for _, _, e in hits})


def document_outputs(automaton, text: str | None, arcs: np.ndarray) -> tuple[float, float, float]:
    """Of the matched clauses of a whole text: the highest score, the sum, and the number of different entries."""
    weight = dict(zip(paying(), arcs.tolist(), strict=True))
    clauses, entries = profiles(automaton, text)
    scores = [sum(weight[s] * x for s, x in c.items()) for c in clauses]
    return max(scores, default=0.0), sum(scores), float(entries)


def symbol_sums(automaton, text: str | None) -> list[float]:
    """log(1 + sum over clauses) of each paying symbol."""
    sums: Counter = Counter()
    for c in profiles(automaton, text)[0]:
        sums.update(c)
    return [float(np.log1p(sums[s])) for s in paying()]


def curve_inputs(best: float, total: float, entries: float) -> np.ndarray:
    return np.array([1.0, min(best, 8.0), np.log1p(total), np.log1p(entries)])


def scorer(grammar: Grammar):
    automaton = grammar.compiled()

    def score(text: str | None) -> tuple[float]:
        odds = float(curve_inputs(*document_outputs(automaton, text, grammar.arcs)) @ grammar.curve)
        return (float(1 / (1 + np.exp(-np.clip(odds, -30, 30)))),)

    return score


def stems(text: str | None) -> set[str]:
    """Whole words (with a closing $) and beginnings of the words of a text."""
    found = set()
    for w in {m.lower() for m in re.findall(r"[^\W\d_]+", text or "")}:
        found.add(w + "$")
        found.update(w[:n] for n in STEM_LETTERS if n < len(w))
    return found


def stem_counts(sample: DataFrame) -> DataFrame:
    """stem, toxic and clean: documents of the sample that have it. Summed within a task before the shuffle."""
    schema = T.StructType([T.StructField("stem", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])

    def run(batches):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label].update(stems(text))
        names = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"stem": part, "toxic": [counts[1][n] for n in part], "clean": [counts[0][n] for n in part]})

    return sample.select("label", "text").mapInArrow(run, schema).groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def longest_forms(found: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Beginnings that nearly always go on in one way give way to that longer form."""
    longer: dict[str, str] = {}
    for s in found:
        for parent in (s[:-1], s[:-2]) if s[-1] == "$" else (s[:-1],):
            if parent in found and found[s][0] >= 0.9 * found[parent][0] and found[s][0] > found.get(longer.get(parent, ""), (0, 0))[0]:
                longer[parent] = s
    return {s: n for s, n in found.items() if s not in longer}


def choose(found: dict[str, tuple[int, int]], holders: dict[str, set[int]], toxic: int, clean: int) -> dict[str, Entry]:
    """Stems that many toxic rows have; then, most first, those that cover rows without any such stem."""
    weigh = lambda s: float(np.clip(np.log((found[s][0] + 0.5) / (toxic + 1)) - np.log((found[s][1] + 0.5) / (clean + 1)), 0.5, 6) / 2)
    chosen = [s for s in found if found[s][0] >= max(8, 0.02 * toxic)]
    covered: set[int] = set().union(*(holders[s] for s in chosen))
    least = max(4, LEAST_NEW * toxic)
    heap = [(-len(holders[s] - covered), len(s), s) for s in found.keys() - set(chosen)]
    heapq.heapify(heap)
    while heap and -heap[0][0] >= least:
        gain, size, s = heapq.heappop(heap)
        now = len(holders[s] - covered)
        if now == -gain:
            covered |= holders[s]
            chosen.append(s)
        else:  # others have covered some of its rows; gains only fall
            heapq.heappush(heap, (-now, size, s))
    kept: dict[str, Entry] = {}
    for s in sorted(chosen, key=lambda s: (len(s), s)):
        bare = s.rstrip("$")
        if not any(bare[:n] in kept and not kept[bare[:n]].whole for n in range(1, len(bare) + 1)):
            kept[bare] = Entry("insult", weigh(s), s.endswith("$"))
    return kept


def learn_entries(sample: DataFrame, toxic: int, clean: int) -> dict[str, Entry]:
    """Entries from the sample, which has so many rows of either class."""
    if not toxic or not clean:
        return {}
    share = F.col("toxic") / toxic
    precise = stem_counts(sample).filter((F.col("toxic") >= max(4, LEAST_NEW * toxic)) & (share >= PRECISION * (share + F.col("clean") / clean)))
    found = longest_forms({r["stem"]: (r["toxic"], r["clean"]) for r in precise.collect()})  # of the sample's words
    names = {s: k for k, s in enumerate(sorted(found))}
    field_ = T.StructField("has", T.ArrayType(T.IntegerType()))
    held = map_texts(sample.filter("label = 1"), "text", [field_], lambda: lambda t: (sorted(names[s] for s in stems(t) if s in names),), [])  # a row each of the sample
    own = held.toArrow().column("has").combine_chunks()
    row, name = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy())), own.flatten().to_numpy()
    order = np.argsort(name, kind="stable")
    ends = np.searchsorted(name[order], np.arange(len(names) + 1))
    return choose(found, {s: set(row[order[ends[k] : ends[k + 1]]].tolist()) for s, k in names.items()}, toxic, clean)


def calibrate(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, towards: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic curve over the columns of x by Newton steps, drawn ``towards`` a point (0 if there is none)."""
    middle = np.zeros(x.shape[1]) if towards is None else towards
    w = middle.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - label)) / weight.sum() + ridge * (w - middle)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / weight.sum() + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _rows(sample: DataFrame, width: int, function) -> tuple[np.ndarray, np.ndarray]:
    """What a function of the grammar's automaton makes of each text of the sample, and the labels, in order of id."""
    rows = map_texts(sample, "text", [T.StructField("x", T.ArrayType(T.DoubleType()))], function, ["doc_id", "label"]).orderBy("doc_id").collect()  # 2 * SAMPLE_PER_CLASS at most
    return np.array([r["x"] for r in rows], float).reshape(len(rows), width), np.array([r["label"] for r in rows], float)


def learn_arcs(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights of the arcs of paying() from symbol_sums(): none is below 0."""
    towards = np.array([0.0, *(prior_weight(s) for s in paying())])
    towards[0] = -1.0
    return np.maximum(calibrate(np.column_stack([np.ones(len(x)), x]), label, weight, ridge, towards)[1:], 0.0)


def train(documents: DataFrame, labels: DataFrame, allowed: Column) -> Grammar:
    sample = training_sample(documents, labels, "toxic", allowed).cache()
    seen = Counter({r["label"]: r["count"] for r in sample.groupBy("label").count().collect()})
    entries = {w: Entry("insult", 1.5, True) for w in INSULT_SEEDS} | {w: Entry("threat", 1.5, True) for w in THREAT_SEEDS}
    grammar = Grammar(entries | learn_entries(sample, seen[1], seen[0]))
    if seen[0] and seen[1]:
        there = Counter({r["label"]: r["count"] for r in clean_labels(labels, "toxic").filter(allowed).groupBy("label").count().collect()})

        def sums():
            automaton = grammar.compiled()
            return lambda t: (symbol_sums(automaton, t),)

        def inputs():
            automaton = grammar.compiled()
            return lambda t: (curve_inputs(*document_outputs(automaton, t, grammar.arcs)).tolist(),)

        x, label = _rows(sample, len(paying()), sums)
        weight = np.where(label > 0, there[1] / seen[1], there[0] / seen[0])
        grammar.arcs = learn_arcs(x, label, weight)
        grammar.curve = calibrate(_rows(sample, 4, inputs)[0], label, weight)
    sample.unpersist()
    return grammar


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    grammar = train(documents, labels, ~held_out)
    scored = map_texts(documents, "text", [T.StructField("score", T.DoubleType())], lambda: scorer(grammar), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
