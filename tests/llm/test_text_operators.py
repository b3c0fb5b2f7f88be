"""Counts, classifiers, personal data and tokens against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.llm import personal_data, quality_ranker, quality_rules, textstats, token_counts, toxicity
from slackline.llm.queries import QUERIES, vocabulary
from slackline.llm.wordbpe import PrefixCounter

MID = "/root/testdata/sf0.01"
LETTERS = "abcdefghijklmnopqrstuvwxyzéüßñ'’ÀΣİ0123½²!?.-<|> ́\x1c\x85\t\n  日本語ﬁ☃\U0001f600"


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_counts(text):
    words, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, texts):
    rows = QUERIES["op8_quality_rules"](spark, MID).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("seed", range(30))
def test_repeated_words_small(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert textstats.counts(text)[4] == plain_counts(text)[4]


def test_repeated_words_many_distinct():
    words = [f"w{i}" for i in range(9000)] * 2
    assert textstats.counts(" ".join(words))[4] == 18_000
    assert textstats.counts(" ".join(words[:9100]))[4] == 200


def test_quality_verdicts_follow_labels(spark):
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    rows = QUERIES["op8_quality_rules"](spark, MID).drop("quality").join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


@pytest.mark.parametrize(("share", "right_on_good", "right_on_bad", "rules"), [(0.8, 0.9, 0.6, 6), (0.6, 0.8, 0.7, 8), (0.8, 0.999, 0.55, 6), (0.9, 0.95, 0.5, 10)])
def test_vote_model_recovers_accuracies(share, right_on_good, right_on_bad, rules):
    """Rules that misfire on up to a third of the good documents, and abstain on a fifth of all."""
    rng, size = np.random.default_rng(0), 20_000
    good = rng.random(size) < share
    on_good, on_bad = right_on_good - np.linspace(0, 0.15, rules), right_on_bad + np.linspace(0, 0.2, rules)
    votes = np.where(good[:, None], rng.random((size, rules)) < on_good, rng.random((size, rules)) >= on_bad) * 2 - 1
    votes *= rng.random(votes.shape) < 0.8
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit_votes(patterns.astype(float), count.astype(float))
    assert abs(1 / (1 + np.exp(-model.bias)) - share) < 0.05
    assert np.allclose(model.for_good, np.log(on_good / (1 - on_bad)), atol=0.25) and np.allclose(model.for_bad, np.log((1 - on_good) / on_bad), atol=0.35 if right_on_good < 0.99 else 2)
    start = quality_rules.fit_votes(np.zeros((0, 6)), np.zeros(0))
    assert len(start.for_good) == 6


def plain_votes(text):
    """The rules by hand."""
    words, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
    n, data = len(words), (text or "").encode()
    of, share = max(n, 1), lambda good, bad: -1 if bad else 1 if good else 0
    chars = sum(map(len, words))
    upper, letters = sum(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in data), sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 192 for c in data)
    _, _, symbols, copies, repeats = plain_counts(text)
    top = max(Counter(words).values(), default=0) / of
    stops, small, long = sum(c in b".," for c in data) / of, sum(len(w.encode()) <= 3 for w in words) / of, sum(len(w.encode()) >= 16 for w in words) / of
    exclaims, pipes, length = data.count(b"!") / of, data.count(b"|") / of, chars / of
    shouting, symbols, repeats, copied, alpha = upper / max(letters, 1), symbols / of, repeats / of, copies / max(len(lines), 1), letters / max(chars, 1)
    return (
        share(n >= 30, n < 10), share(symbols < 0.1, symbols > 0.3), share(repeats < 0.05, repeats > 0.2), share(copied == 0 and len(lines) > 2, copied > 0.3), share(shouting < 0.2, shouting > 0.5),
        share(exclaims < 0.05, exclaims > 0.3), share(pipes == 0, pipes > 0.2), share(0.02 <= stops < 0.5, n >= 30 and stops < 0.005), share(n >= 30 and top < 0.2, n >= 30 and top > 0.4),
        share(alpha >= 0.8, n > 0 and alpha < 0.7), share(small >= 0.12, n >= 30 and small < 0.05), share(2.5 <= length < 9 and long < 0.2, n > 0 and (length < 2 or length > 14)),
    )


def plain_posteriors(votes, rounds=3000):
    """Expectation-maximisation by loops over documents."""
    from math import exp, log

    width = len(votes[0])
    good, bad, prior = [0.99] * width, [0.35] * width, 0.9
    for _ in range(rounds):
        odds = [log(prior / (1 - prior)) + sum(log(good[k] / (1 - bad[k])) if v > 0 else log((1 - good[k]) / bad[k]) for k, v in enumerate(d) if v) for d in votes]
        sure = [1 / (1 + exp(-o)) for o in odds]
        spoken = lambda k, want, w: sum(x for x, d in zip(w, votes, strict=True) if d[k] in want)
        other = [1 - x for x in sure]
        was = good
        good = [(spoken(k, (1,), sure) + 20 * 0.99) / (spoken(k, (1, -1), sure) + 20) for k in range(width)]
        bad = [(spoken(k, (-1,), other) + 20 * 0.35) / (spoken(k, (1, -1), other) + 20) for k in range(width)]
        prior = (sum(sure) + 1) / (len(votes) + 2)
        if max(abs(a - b) for a, b in zip(was, good, strict=True)) < 1e-12:
            break
    odds = [log(prior / (1 - prior)) + sum(log(good[k] / (1 - bad[k])) if v > 0 else log((1 - good[k]) / bad[k]) for k, v in enumerate(d) if v) for d in votes]
    return [1 / (1 + exp(-o)) for o in odds]


def test_quality_verdicts_by_hand(spark, small):
    rows = QUERIES["op8_quality_rules"](spark, small).collect()
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    want = plain_posteriors([plain_votes(texts[r["doc_id"]]) for r in rows])
    assert max(abs(r["quality"] - w) for r, w in zip(rows, want, strict=True)) < 1e-4
    assert all(r["kept"] == (not r["base_failed"] and w >= 0.5) for r, w in zip(rows, want, strict=True) if abs(w - 0.5) > 1e-3)


def test_one_misfiring_rule_does_not_reject(spark):
    """A line that a quarter of the good documents repeat: the only fault that one rule sees in them."""
    base = "The river runs past the old mill, and the boats come home at dusk. "
    rows = [(i, f"{base}Number {i} of them has a tale to tell, {'so' * (i % 5)} they say. " * 1 + "\n".join(["", f"line {i} here.", f"line {i} here.", f"line {i} here."] if i % 4 == 0 else ["", "one more.", f"and {i}, two."])) for i in range(400)]
    rows += [(1000 + i, "#$% @@ || && ** " * 12 + str(i)) for i in range(40)]
    out = {r["doc_id"]: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["kept"] for i in range(400) if not out[i]["base_failed"]) and not any(out[1000 + i]["kept"] for i in range(40))


def accuracy(rows, label):
    held = [r for r in rows if r["held_out"]]
    assert held
    return np.mean([r["predicted"] == r[label] for r in held])


def test_quality_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = QUERIES["op1_quality_ranker"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    assert accuracy(rows, "quality") > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = QUERIES["op6_toxicity_grammar"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    assert accuracy(rows, "toxic") > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pairwise_ranking_orders_by_the_right_feature():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    label = (x[:, 1] > 0).astype(int)
    model = quality_ranker.fit_ranker(x, label)
    assert abs(model.weights[1]) > 3 * max(abs(model.weights[0]), abs(model.weights[2]))
    assert np.mean((model.worth(x) >= model.threshold) == label) > 0.98


def test_folds_follow_crc32(spark):
    import zlib

    rows = QUERIES["op1_quality_ranker"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    rows = QUERIES["op6_toxicity_grammar"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def outputs(text):
    entries = {"idiot": toxicity.Entry("insult", 2.0, True), "kill": toxicity.Entry("threat", 2.0, True), "lowei": toxicity.Entry("insult", 2.0, False)}
    grammar = toxicity.Grammar(entries)
    return toxicity.document_outputs(grammar.compiled(), text, grammar.arcs)


def plain_marks(words):
    """What each word is marked as, read off the words before it."""
    found, open_ = [], False
    for i, w in enumerate(words):
        before, marks = words[max(0, i - 4) : i], []
        if w in ("insult", "threat"):
            marks += ["negated"] * ("negation" in before) + ["targeted"] * ("target" in before) + ["reported"] * open_ + ["meant"] * (w == "threat" and "intent" in before)
        if w == "target":
            last = max((k for k, v in enumerate(before) if v in ("insult", "threat")), default=None)
            marks += ["aimed"] * (last is not None and "target" not in before[last:])
        open_ = True if w == "report" else not open_ if w == "quote" else open_
        found.append("|".join([w, *marks]))
    return found


@pytest.mark.parametrize("seed", range(20))
def test_machine_against_plain_marks(seed):
    rng = random.Random(seed)
    for _ in range(300):
        words = [rng.choice(toxicity.CLASSES) for _ in range(rng.randint(0, 25))]
        assert toxicity.machine().write(words) == plain_marks(words)


def test_composition_is_one_after_the_other():
    first = toxicity.window(toxicity.CLASSES, frozenset(["negation"]), frozenset(["insult", "threat"]), "negated")
    second = toxicity.report(first.alphabet())
    both, rng = toxicity.compose(first, second), random.Random(1)
    for _ in range(300):
        words = [rng.choice(toxicity.CLASSES) for _ in range(rng.randint(0, 25))]
        assert both.write(words) == second.write(first.write(words))


@pytest.mark.parametrize("seed", range(5))
def test_documents_against_plain_clauses(seed):
    """Clauses, words and scores of random texts by splitting them, with clauses beyond any limit."""
    rng, grammar = random.Random(seed), toxicity.Grammar({"idiot": toxicity.Entry("insult", 2.0, True), "kill": toxicity.Entry("threat", 1.0, True)})
    vocabulary_ = ["idiot", "kill", "you", "not", "said", '"', "will", "tree", "tree", "idiotic"]
    for _ in range(60):
        text = "".join(rng.choice(vocabulary_) + rng.choice([" "] * 9 + [". ", "\n"]) for _ in range(rng.choice([5, 40, 3000])))
        scores, entries = [], set()
        for clause in re.split("[.!?;:\n]", text):
            words = re.findall(r'[a-z]+|"', clause)
            kinds = [{"idiot": "insult", "kill": "threat"}.get(w) or toxicity._KINDS.get(w, "other") for w in words]
            if not {"insult", "threat"} & set(kinds):
                continue
            entries |= {w for w in words if w in ("idiot", "kill")}
            pay = {"insult": 2.0, "threat": 1.0, "target": 1.0}
            scores.append(sum(pay[k] * toxicity.prior_weight(m) for k, m in zip(kinds, plain_marks(kinds), strict=True) if k in ("insult", "threat") or m.endswith("aimed")))
        best, total, number = toxicity.document_outputs(grammar.compiled(), text, grammar.arcs)
        assert abs(best - max(scores, default=0)) < 1e-9 and abs(total - sum(scores)) < 1e-6 and number == len(entries)


def test_arcs_are_learnt_from_labels():
    """Negated insults in clean rows, plain ones in toxic rows."""
    rng = np.random.default_rng(0)
    plain, negated = toxicity.paying().index("insult"), toxicity.paying().index("insult|negated")
    x, label = np.zeros((2000, len(toxicity.paying()))), rng.integers(0, 2, 2000).astype(float)
    x[label > 0, plain], x[label == 0, negated] = np.log1p(2), np.log1p(2)
    arcs = toxicity.learn_arcs(x, label, np.ones(2000))
    assert arcs[plain] > 1.5 and arcs[negated] < 0.1 < toxicity.prior_weight("insult|negated")
    unmet = toxicity.paying().index("threat|meant")
    assert abs(arcs[unmet] - toxicity.prior_weight("threat|meant")) < 1e-6


def test_grammar_weighs_clauses():
    plain, aimed, negated = (outputs(t)[0] for t in ("an idiot there", "you idiot", "not an idiot"))
    assert aimed > plain > negated > 0
    assert outputs("she said idiot")[0] < plain
    assert outputs("I will kill you")[0] > outputs("they kill time")[0]
    assert outputs("idiotic idea")[0] == 0 and outputs("loweichen")[0] > 0 and outputs("xlowei")[0] == 0
    assert outputs("not here. an idiot")[0] == plain  # a negation in another clause doesn't count
    assert outputs(None) == outputs("") == (0.0, 0.0, 0.0)


PLAIN = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    found = []
    for kind, expression in PLAIN.items():
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 13 <= len(digits) <= 19 and personal_data.luhn(digits) or kind == 3 and 9 <= len(digits) <= 15
            if ok:
                found.append((kind, *m.span()))
    return found


@pytest.mark.parametrize("seed", range(20))
def test_base_spans_small(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        text = "".join(rng.choice("ab@@..+-% ()0123456789é") for _ in range(rng.randint(0, 40)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_base_spans_stay_linear():
    assert personal_data.base_spans("a" * 500_000) == [] and personal_data.base_spans("a@" * 200_000) == []
    assert personal_data.base_spans("1" * 500_000) == [] and personal_data.base_spans("1." * 300_000) != [None]


def test_personal_data_query(spark, texts):
    rows = QUERIES["op5_personal_data"](spark, MID).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_bootstrapping_finds_unseen_numbers(spark):
    from slackline.llm.personal_data import personal_spans

    seen = [f"please phone +1 (555) 010-{1000 + i} now" for i in range(12)]
    rows = [(i, t) for i, t in enumerate([*seen, "please phone 555 010 77777 now", "version 555 010 88888 there"])]
    out = {r["doc_id"]: r for r in personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[12]["added"]] == [(3, 13, 26)]
    assert out[13]["added"] == [] and all(len(out[i]["base"]) == 1 for i in range(12))


def test_mentions_stay_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        (found,) = personal_data.mentions("call 555 010 7777 or 10.2.3.4, " * n)
        took.append(time.perf_counter() - began)
        assert len(found) == 2 * n
    assert took[1] < 10 * took[0]


def test_long_numbers_and_far_words():
    spaced = "1" + " " * 60 + "23456789"
    assert personal_data.candidates(f"no {spaced} x", []) == [(3, 3 + len(spaced), [3])]
    text = "phone" + " " * 500 + "555 010 77777" + "." * 200 + "now"
    assert personal_data.Context(text).patterns(505, 518) == ["L1 phone", "R1 now"]
    assert personal_data.candidates("id5550107777 +1x 5550107777x (5550107777)", [])[0][:2] == (29, 40)


@pytest.mark.parametrize("seed", range(10))
def test_masking_by_letter(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice("abc😀é ") for _ in range(rng.randint(0, 30)))
        spans = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randint(0, len(text))
            spans.append((s, min(len(text), s + rng.randint(1, 6)), rng.randrange(4)))
        spans = [x for x in spans if x[0] < x[1]]
        covered = personal_data.merged((s, e) for s, e, _ in spans)
        want, at = "", 0
        for s, e in covered:
            kind = min(x for x in spans if x[0] == s)[2]
            want, at = want + text[at:s] + f"<{personal_data.KINDS[kind].upper()}>", e
        assert personal_data.masked(text, spans) == want + text[at:]


def plain_discovery(rows, rounds=50):
    """The scores by dictionaries: a pattern's sureness, then each open value's, until nothing changes."""
    links, opened = {(p, v) for v, _, _, ps in rows for p in ps}, {(p, v, k) for v, kind, may, ps in rows if kind is None for p in ps for k in may}
    known = {(v, kind) for v, kind, _, _ in rows if kind is not None}
    known_values = {v for v, _ in known}
    size, score = Counter(p for p, _ in links), {x: 1.0 for x in known}
    for _ in range(rounds):
        sums = Counter()
        for p, v in links:
            for (value, kind), x in score.items():
                if value == v:
                    sums[p, kind] += x
        doubt = {}
        for p, v, k in opened:
            if v not in known_values and sums[p, k] >= personal_data.LEAST_SUPPORT and sums[p, k] / size[p] >= personal_data.PATTERN_SURE:
                doubt[v, k] = doubt.get((v, k), 1.0) * max(1 - sums[p, k] / size[p] * sums[p, k] / (sums[p, k] + 1), 1e-12)
        score = {x: 1.0 for x in known} | {x: 1 - d for x, d in doubt.items()}
    best = {}
    for (v, k), x in score.items():
        if v not in known_values and x >= personal_data.INSTANCE_SURE:
            best[v] = max(best.get(v, (0, -9)), (x, -k))
    return {(v, -k) for v, (_, k) in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_discovery_against_dictionaries(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        kind = rng.choice([0, 3, 3, None])
        may = [kind] if kind is not None else rng.choice([[3], [2, 3], [0]])
        word = rng.randrange(3) if kind is None or rng.random() < 0.9 else 9
        rows.append((f"v{i if kind is None else rng.randrange(60)}-{kind}", kind, may, [f"L1 {word}{may[-1]}", f"L2 {word}{may[-1]}{rng.randrange(2)}", f"R1 {rng.randrange(2)}"]))
    found = spark.createDataFrame(rows, "value string, kind long, may array<long>, patterns array<string>")
    want = plain_discovery(rows)
    assert {(r["value"], r["found"]) for r in personal_data.discover(found).collect()} == want and want


def test_redaction(spark):
    rows = [(1, "mail a.b@c.org or 10.1.2.3!", 5), (2, None, 0), (3, "nothing", 7)]
    out = {r["doc_id"]: r for r in personal_data.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out[1]["text"] == "mail <EMAIL> or <IP>!" and out[1]["n_chars"] == 21
    assert out[2]["text"] is None and out[3]["text"] == "nothing"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_token_counts_query(spark, texts, library):
    for r in QUERIES["op9_prefix_token_counts"](spark, MID).collect():
        text = texts[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_token_counts_of_odd_texts(library):
    counter, rng = PrefixCounter(vocabulary()), random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) + rng.choice(["", "", "<|endoftext|>", "<|endoftext|>x"])
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_prefix(library):
    counter, rng = PrefixCounter(vocabulary()), random.Random(4)
    words = ["hello", "internationalization", "aaaaaaaaaaaa", "can't", "we'll", "'re", "naïveté", "x" * 120, "", "12", "<|endoftext|>", "a<|endoftext|>b", "日本語テキスト", "e\u0301a\u0323\u0301", "\u1112\u1161\u11ab\u1100\u116e\u11a8", "क्षि", "ไม่มี", "👨‍👩‍👧", "ΑΣ", "İx", "'d\u0323b", "''m\u0323'", "'re\u0301"]
    for _ in range(150):
        text = " ".join(rng.choice(words) + rng.choice(["", "", *words]) for _ in range(4)) + "".join(rng.choice(LETTERS) for _ in range(6))
        totals = counter.every_prefix(text)
        assert totals == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], repr(text)


@pytest.mark.parametrize("alphabet", ["日本語文字列漢検索", "가나다라마바", "абвгде", "กขคงจ่้ิ", "abcdé", "\u1112\u1161\u11ab", "e\u0301", "1١१", "।॥क्ष"])
def test_every_prefix_of_long_runs(library, alphabet):
    """In any script, in about linear time."""
    import time

    counter, rng = PrefixCounter(vocabulary()), random.Random(5)
    text = "".join(rng.choice(alphabet) for _ in range(3000))
    began = time.perf_counter()
    totals = counter.every_prefix(text)
    assert time.perf_counter() - began < 3
    for i in [0, 1, 2, 3, 50, 777, 1500, 2999, 3000, *rng.sample(range(3000), 30)]:
        assert totals[i] == len(library.encode(text[:i], add_special_tokens=False).ids)


def test_prefixes_of_chunks(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(6)
    for r in token_counts.prefix_table(docs, vocabulary()).collect():
        ends, tokens = np.cumsum(r["end_steps"]), np.cumsum(r["token_steps"])
        assert len(ends) == len(tokens)
        for k in rng.sample(range(len(ends)), min(4, len(ends))):
            own = spark_text(docs, r["doc_id"])[: ends[k]]
            assert tokens[k] == len(library.encode(own, add_special_tokens=False).ids)


_TEXTS = {}


def spark_text(docs, doc_id):
    if not _TEXTS:
        _TEXTS.update(docs.select("doc_id", "text").collect())
    return _TEXTS[doc_id]


def test_budget_from_the_table(spark, library):
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "  two  spaces ")], "doc_id long, text string")
    rows = token_counts.prefix_table(docs, vocabulary()).withColumn("cut", token_counts.longest_within(4)).collect()
    assert {r["doc_id"]: r["cut"] for r in rows} == {1: 19, 2: 0, 3: 13}
    dense = token_counts.every_prefix(docs.filter("doc_id = 1"), vocabulary()).first()["prefix_tokens"]
    assert dense == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_scores_ignore_metadata(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    for scores in (quality_ranker.quality_scores, toxicity.toxicity_scores):
        assert sorted(scores(docs, labels).collect()) == sorted(scores(other, labels).collect())
