"""Personal data by bootstrapped contextual extraction (operator 5).

Base expressions find e-mail addresses, IP addresses, card and telephone numbers; these
are the seeds. Words around the seeds are lexical patterns. Spark scores the graph of
patterns and instances (values found in the corpus) in rounds until the scores settle: a pattern is as sure as the
share of its instances that are known, an instance as sure as its patterns together make it.
Values that only look like an identifier (numbers that fail a check, spelled-out
addresses) are added where patterns of high confidence surround them.

Cost: one pass over the texts, which leaves a row a document with its few mentions; the
graph has a row for each different pattern and value and is aggregated with partial sums,
so a value or word that a third of all documents have is one row a task. Nothing is
collected and nothing but what Spark's own size check admits is broadcast. Only texts with spans
go to Python a second time, to be masked. Every step is linear in a text's length but for sorting its spans.

Defined results: null and empty texts have no spans; null ids stay null; rows that repeat
are a row each; added spans never overlap base spans; columns other than the named ones aren't read,
and redact() returns them as they were, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slackline.llm import storage
from slackline.llm.frames import internal, map_texts, parts, release

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring after which it is an error that scores still change.
MOST_ROUNDS = 100
#: A pattern counts from so many different known values on, and at this share of its values.
LEAST_SUPPORT, PATTERN_SURE = 3, 0.7
#: An unseen value is added at this confidence.
INSTANCE_SURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9][0-9(). -]*")
_SEPARATORS = "(). -"
_SPELLED = re.compile(r"( at |\(at\)|\[at\]| \(at\) | \[at\] )[A-Za-z0-9-]+(?:(?:\.| dot |\(dot\)|\[dot\])[A-Za-z0-9-]+)+")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What the address expression matches, found from each at sign outwards so that no run is read twice."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        # nothing before this sign can be part of a later match: the local part has no at sign
        done = domain.end() if domain else at + 1
        if domain:
            found.append((start, done))
        at = text.find("@", done)
    return found


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    spans: list[tuple[int, int, int]] = []
    if not text:
        return spans
    if "@" in text:
        spans += [(0, s, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m[0].split("."))):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits and their usual separators, with a bracket before them, that no letter or mark of an address touches."""
    for m in _RUN.finditer(text):
        run, start = m[0], m.start()
        if m.end() < len(text) and (text[m.end()] == "@" or "A" <= text[m.end()] <= "Z" or "a" <= text[m.end()] <= "z"):
            run = run.rstrip("0123456789")  # the last number belongs to a word
        run = run.rstrip(_SEPARATORS)
        end = start + len(run)
        before = text[start - 1 : start]
        if before == "(" and not _touches(text[start - 2 : start - 1]):
            start -= 1
        elif _touches(before):
            continue
        if run:
            yield start, end


def _touches(c: str) -> bool:
    return bool(c) and (c in ".@+" or "A" <= c <= "Z" or "a" <= c <= "z")


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kinds it may be) of what looks like an identifier outside the spans taken."""
    found = []
    for start, end in numbers(text):
        run = text[start:end]
        digits = len(_DIGIT.findall(run))
        may = [k for k, fits in ((1, run.count(".") == 3 and " " not in run), (2, 13 <= digits <= 19), (3, 7 <= digits <= 15)) if fits]
        if may and end - start > 6:
            found.append((start, end, may))
    for m in _SPELLED.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end(), [0]))
    blocked, k, free, end = merged((s, e) for _, s, e in taken), 0, [], 0
    for s, e, may in sorted(found, key=lambda x: x[:2]):
        while k < len(blocked) and blocked[k][1] <= s:
            k += 1
        if s >= end and (k == len(blocked) or blocked[k][0] >= e):
            free.append((s, e, may))
            end = e
    return free


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones joined."""
    found: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if found and s < found[-1][1]:
            found[-1] = found[-1][0], max(e, found[-1][1])
        else:
            found.append((s, e))
    return found


class Context:
    """The words of a text, for the lexical patterns of places in it."""

    def __init__(self, text: str):
        self.text, spans = text, [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def patterns(self, start: int, end: int) -> list[str]:
        """One and two words to the left, one to the right, in lower case."""
        k, r = bisect_left(self.starts, start), bisect_right(self.ends, end)
        left = [self.text[self.starts[i] : min(self.ends[i], start)].lower() for i in range(max(0, k - 2), k)]
        found = ["L1 " + left[-1]] if left else []
        found += ["L2 " + " ".join(left)] if len(left) == 2 else []
        return found + (["R1 " + self.text[max(self.starts[r], end) : self.ends[r]].lower()] if r < len(self.ends) else [])


_MENTION = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.LongType()),
    T.StructField("may", T.ArrayType(T.LongType())), T.StructField("value", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType())),
])


def mentions(text: str | None) -> tuple[list[dict]]:
    """Base spans (with their kind) and candidates (with what they may be) of a whole text."""
    if not text:
        return ([],)
    taken = base_spans(text)
    rows = [(s, e, k, [k]) for k, s, e in taken] + [(s, e, None, may) for s, e, may in candidates(text, taken)]
    if not rows:
        return ([],)
    context = Context(text)
    return ([{"start": s, "end": e, "kind": k, "may": may, "value": "".join(text[s:e].lower().split()), "patterns": context.patterns(s, e)} for s, e, k, may in rows],)


def discover(found: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """value and kind of unseen identifiers. found: (value, kind or null, may, patterns), a row for each mention.

    Scores only grow from round to round; the rounds end when none does by a millionth."""
    edges = storage.written(found.select("value", "kind", F.explode("may").alias("may"), F.explode_outer("patterns").alias("pattern")).distinct(), "pii-edges")
    known = edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    size = edges.filter("pattern is not null").groupBy("pattern").agg(F.count_distinct("value").alias("size"))
    links = edges.filter("pattern is not null").select("pattern", "value").distinct()
    open_ = edges.filter("kind is null and pattern is not null").select("pattern", "value", F.col("may").alias("kind")).distinct()
    open_ = open_.join(known.select("value").distinct(), "value", "left_anti")
    scores, state = known, None
    for k in range(most_rounds):
        sums = links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        sure = sums.join(size, "pattern").withColumn("sure", F.col("sum") / F.col("size")).filter((F.col("sum") >= LEAST_SUPPORT) & (F.col("sure") >= PATTERN_SURE))
        doubt = F.sum(F.log(F.greatest(F.lit(1.0) - F.col("sure") * F.col("sum") / (F.col("sum") + 1), F.lit(1e-12))))
        new = open_.join(sure.select("pattern", "kind", "sure", "sum"), ["pattern", "kind"]).groupBy("value", "kind").agg((F.lit(1.0) - F.exp(doubt)).alias("score"))
        scores = storage.written(known.unionByName(new), f"pii-round{k}")
        before, state = state, tuple(scores.agg(F.count("*"), F.sum(F.round("score", 6).cast("decimal(38,6)"))).first())
        if state == before:
            break
    else:
        raise RuntimeError(f"scores didn't settle in {most_rounds} rounds")
    best = scores.join(known.select("value").distinct(), "value", "left_anti").filter(F.col("score") >= INSTANCE_SURE)
    return best.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("found"))


def personal_spans(df: DataFrame, text: str = "text", carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with base and added, two arrays of (kind, start, end) by kind and start."""
    place = storage.mark()
    carry = list(carry)
    named, own, of = internal(df, text, carry)
    fields = [T.StructField("_mentions", T.ArrayType(_MENTION))]
    rows = storage.written(map_texts(named, of, fields, lambda: mentions, own).withColumn("_row", F.monotonically_increasing_id()), "pii-mentions")
    each = rows.filter(F.size("_mentions") > 0).select("_row", F.inline("_mentions"))
    found = storage.written(discover(each.select("value", "kind", "may", "patterns")), "pii-found")
    added = each.filter("kind is null").join(found, "value").filter(F.array_contains("may", F.col("found")))
    added = added.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(F.col("found").alias("kind"), "start", "end"))).alias("_added"))
    added = storage.written(added, "pii-added").withColumnRenamed("_row", "_of")
    base = F.transform(F.filter("_mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    joined = rows.join(added, F.col("_row") == F.col("_of"), "left")
    none = F.array().cast("array<struct<kind:bigint,start:bigint,end:bigint>>")
    spans = joined.select(*[F.col(o).alias(c) for c, o in zip(carry, own, strict=True)], F.sort_array(base).alias("base"), F.coalesce("_added", none).alias("added"))
    return storage.tidy(spans, place)


def _joined(spans) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, (s["kind"] + 1).cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_digests(df: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans."""
    spans = personal_spans(df)
    number = [_count(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.sort_array(F.concat("base", "added"))
    return spans.select("doc_id", *number, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (start, end, kind) replaced; overlapping spans become one, named by the first."""
    found, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            found += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*found, text[at:]])


def _mask(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in columns:
        made, at = [pa.array([], pa.string())], 0
        for part in parts(texts):
            rows = zip(part.to_pylist(), spans.slice(at, len(part)).to_pylist(), strict=True)
            made.append(pa.array([None if t is None else masked(t, [(s["start"], s["end"], s["kind"]) for s in own]) for t, own in rows], pa.string()))
            at += len(part)
        yield pa.concat_arrays(made)
    release()


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first.
    A column n_chars becomes the new text's length."""
    columns = docs.columns
    unique = [f"_d{i}" for i in range(len(columns))]
    place = unique[columns.index(text)]
    spans = personal_spans(docs.toDF(*unique), place, unique).withColumn("_spans", F.concat("base", "added"))
    touched = F.size("_spans") > 0
    spans = spans.withColumn("_masked", F.arrow_udf(_mask, T.StringType())(F.when(touched, F.col(place)), F.when(touched, F.col("_spans"))))
    clean = F.coalesce("_masked", place)
    out = {c: (clean if c == text else F.col(u)).alias(c) for c, u in zip(columns, unique, strict=True)}
    if "n_chars" in out and text in out:
        out["n_chars"] = F.length(clean).cast("long").alias("n_chars")
    return spans.select(*[out[c] for c in columns])
