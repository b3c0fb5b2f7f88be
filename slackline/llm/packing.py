"""Packing by minimum bin slack (operator 10).

Documents are cut at the window's size; full windows are sequences of their own. The
rest is a histogram of piece lengths, no longer than the window, whatever the corpus'
size. For one window after another a bitset subset-sum program finds the multiset of
lengths, with the longest one left in it, whose sum comes closest to the capacity, and
traces back how many of each length it took. The same multiset fills as many windows
as the histogram allows, so the plan has few entries for any number of documents.

Lengths in windows that this leaves far from full (a length that very many documents share,
or the rest of any table) are cut at powers of two and planned once more. Texts aren't
tokenised again for that: a piece carries a checksum of each BLOCK of its ids, and checksums
of neighbouring blocks combine to that of a part.

Cost: texts are tokenised once; narrow rows of pieces are stored and shuffled (with the ids,
if they are asked for, in two bytes each where the vocabulary fits). Pieces of one length are numbered in as many chunks as a chunk has rows, so a
length that a third of all documents have is spread like any other, and no task sees more than
the root of its rows. The driver holds the histogram (at most ``window`` rows) and the plan, both
bounded by the window alone.

Defined results: null and empty texts are the end token alone; null ids stay null; rows
that repeat an id are packed a row each; other columns, whatever their names, aren't read; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slackline.llm import storage
from slackline.llm.frames import release, slices
from slackline.llm.wordbpe import END, LONGEST_KEY, chunks

WINDOW = 4096
END_ID = 2
#: Ids of a block, which has a checksum of its own; the shortest part that is cut off.
BLOCK = 64
#: A window that is short of its size by more than this share is far from full.
SLACK = 1 / 64
#: Chunks of text in a generation of those whose ids a worker remembers, each about 200 bytes: 160 MB in two generations.
MEMORY = 400_000
#: Characters of texts whose unknown words are asked of the library at once.
TOGETHER = 200_000
#: Punctuation that ends words.
MARKS = ".,;:!?%$&#*|()-\""


class Encoder:
    """Token ids of whole texts by the tokenizers library, which is asked for each word once as long as it is remembered.

    Two generations of chunks are remembered: what was met since the last turn, and what was met before.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        vocabulary = self._library.get_vocab(with_added_tokens=False)
        self.largest = max(self._library.get_vocab().values())
        self._closes = np.zeros(self.largest + 1, bool)  # tokens that end a word
        self._closes[[i for token, i in vocabulary.items() if token.endswith(END)]] = True
        self._young: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters only, many in one call: each one's ids end with the first token that ends a word."""
        found = {}
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self._library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), (4 * (np.flatnonzero(self._closes[ids]) + 1)).tolist()
            if len(ends) != len(some):
                return self._each(words)
            found.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        return found

    def _each(self, texts: list[str]) -> dict[str, bytes]:
        encoded = self._library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return {c: pack(f"<{len(e.ids)}I", *e.ids) for c, e in zip(texts, encoded, strict=True)}

    def _asked(self, unknown: list[str]) -> dict[str, bytes]:
        """The ids of each, remembered or by the library."""
        found, words, rest = {}, [], []
        for c in unknown:
            ids = self._young.get(c) or self._old.get(c)
            if ids is not None:
                found[c] = ids
            else:
                (words if c.isalpha() and max(c) <= "ÿ" else rest).append(c)
        return found | self._words(words) | self._each(rest)

    def _learn(self, unknown: list[str]) -> dict[str, bytes]:
        whole, ends = [], {}
        for c in unknown:
            word = c.rstrip(MARKS)
            if word and word != c and word.isalpha() and max(word) <= "ÿ":  # letters and the marks after them are never one token
                ends[c] = word, c[len(word) :]
            else:
                whole.append(c)
        found = self._asked(list(dict.fromkeys([*whole, *(part for pair in ends.values() for part in pair)])))
        found.update({c: found[word] + found[marks] for c, (word, marks) in ends.items()})
        if len(self._young) > MEMORY:
            self._young, self._old = {"": b""}, self._young
        self._young.update({c: ids for c, ids in found.items() if len(c) <= LONGEST_KEY})
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, four bytes each, lowest first."""
        split = [chunks(_plain(t)) for t in texts]
        got = [list(map(self._young.get, parts)) for parts in split]
        gaps = [(parts, known, k) for parts, known in zip(split, got, strict=True) for k in _gaps(known)]
        if gaps:
            found = self._learn(list({parts[k]: None for parts, _, k in gaps}))
            for parts, known, k in gaps:
                known[k] = found[parts[k]]
        return [b"".join(known) for known in got]


def _gaps(known: list) -> Iterator[int]:
    """Places of None."""
    k = -1
    with suppress(ValueError):
        while True:
            yield (k := known.index(None, k + 1))


def _plain(text: str | None) -> str:
    """The text in lower case where that is letter by letter and nothing combines: in Latin-1 without special tokens."""
    if not text or "<|" in text:
        return text or ""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Neighbouring texts that are encoded together: TOGETHER characters, one text at least."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text or "") > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def binary_parts(length: int) -> list[int]:
    """Powers of two from the largest in the length down to BLOCK, and what is left."""
    parts = []
    while length >= BLOCK:
        parts.append(1 << length.bit_length() - 1)
        length -= parts[-1]
    return parts + [length] * (length > 0)


def block_sums(data: bytes) -> list[int]:
    """The checksum of each BLOCK ids of four bytes, the last ones perhaps fewer."""
    return [zlib.crc32(data[i : i + 4 * BLOCK]) for i in range(0, len(data), 4 * BLOCK)]


def combined(sums: list[int], ids: int) -> int:
    """The checksum of so many ids, given those of their blocks."""
    total = 0
    for k, s in enumerate(sums):
        zeros = bytes(4 * min(BLOCK, ids - k * BLOCK))
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ s  # the sum so far, moved past the block, and the block's own
    return total


def cut_pieces(df: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and blocks (see block_sums) of every piece, and if asked for its ids, lowest byte first:
    two bytes each if all ids of the vocabulary have room in them, else four."""
    fields = [T.StructField("doc_id", df.schema["doc_id"].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")] + [T.StructField("blocks", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer).encode
        narrow = max(encoder(tokenizer).largest, end_id) < 1 << 16
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, held = [], []
                ids = (data for group in _groups(batch.column(1).to_pylist()) for data in encode(group))
                for doc_id, data in zip(batch.column(0).to_pylist(), ids, strict=True):
                    data += end
                    for at in range(0, len(data), 4 * window):
                        piece = data[at : at + 4 * window]
                        rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4, block_sums(piece) if len(piece) < 4 * window else []))
                        if with_ids:
                            held.append(np.frombuffer(piece, "<u4").astype("<u2").tobytes() if narrow else piece)
                columns = [pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(6)]
                if with_ids:
                    columns.append(pa.array(held, arrow.field(6).type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        release()

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def closest_fill(left: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is closest to ``room`` from below.

    left: (length, number there is), longest first. Bit s of a bitset says that sum s can be
    made; numbers are taken in powers of two, and the stages are traced back from the best sum.
    """
    mask, reach, stages = (1 << room + 1) - 1, 1, []
    for length, number in left:
        if length > room:
            continue
        rest, step = min(number, room // length), 1
        while rest and not reach >> room & 1:
            take = min(step, rest)
            stages.append((length, take, reach))
            reach |= reach << length * take & mask
            rest, step = rest - take, step * 2
        if reach >> room & 1:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + take
            best -= length * take
    return taken


@dataclass(frozen=True)
class Plan:
    """Rows of the plan, in order of length and first rank: pieces of ``length`` whose rank is from
    ``rank`` on go to sequences from ``sequence`` on, ``each`` a sequence, from ``offset`` on. slack: lengths in windows
    that stay far from full."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    padding: int
    slack: frozenset[int]
    histogram: dict[int, int]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given their length and their rank among pieces of that length."""
        wide = int(max(self.rank.max(initial=0), rank.max(initial=0))) + 1
        row = np.searchsorted(self.length * wide + self.rank, length * wide + rank, side="right") - 1
        further = rank - self.rank[row]
        return self.sequence[row] + further // self.each[row], self.offset[row] + further % self.each[row] * length


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """The plan for so many pieces of each length, none longer than the window."""
    left = {length: n for length, n in sorted(histogram.items(), reverse=True) if n}
    used, rows, sequence, padding, slack = dict.fromkeys(left, 0), [], 0, 0, set()
    while left:
        first = next(iter(left))
        rest = [(k, n - (k == first)) for k, n in left.items() if n > (k == first)]
        taken = closest_fill(rest, window - first)
        taken[first] = taken.get(first, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            rows.append((length, used[length], sequence, taken[length], offset))
            offset += length * taken[length]
            used[length] += taken[length] * times
            left[length] -= taken[length] * times
            if not left[length]:
                del left[length]
        sequence += times
        if offset & (offset - 1):  # a power of two needs no padding
            padding += (window - offset) * times
            slack.update(taken if window - offset > SLACK * window else ())
    rows.sort()
    return Plan(*(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5)), padding, frozenset(slack), used)


def cut_histogram(histogram: dict[int, int], cut: frozenset[int]) -> dict[int, int]:
    """The lengths there are when those in ``cut`` are cut into binary_parts()."""
    found: dict[int, int] = {}
    for length, n in histogram.items():
        for part in binary_parts(length) if length in cut else [length]:
            found[part] = found.get(part, 0) + n
    return found


def best_plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[Plan, frozenset[int]]:
    """The plan, and the lengths that are cut for it: of full windows none."""
    cut = plan_windows(histogram, window).slack - {window}
    return plan_windows(cut_histogram(histogram, cut), window), cut


def _parts(row: dict) -> list[dict]:
    """A piece, cut into binary_parts()."""
    found, at = [], 0
    width = len(row.get("ids", b"")) // row["length"]
    for length in binary_parts(row["length"]):
        own = row["blocks"][at // BLOCK : -(-(at + length) // BLOCK)]
        part = row | {"start": row["start"] + at, "length": length, "ids_crc32": combined(own, length)}
        found.append(part | {"ids": row["ids"][width * at : width * (at + length)]} if "ids" in row else part)
        at += length
    return found


def dealt(pieces: DataFrame, cut: frozenset[int], chunks: dict[int, int]) -> DataFrame:
    """Stored pieces (with their number _piece), those of lengths in ``cut`` in parts, and the chunk of its length that each is in."""
    schema = T.StructType([f for f in pieces.schema if f.name != "blocks"] + [T.StructField("_chunk", T.LongType())])
    arrow = to_arrow_schema(schema)
    number = np.zeros(max(chunks, default=0) + 1, np.uint64)
    number[list(chunks)] = list(chunks.values())

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            whole = ~np.isin(length, list(cut))
            tables = [batch.filter(pa.array(whole)).select(schema.names[:-1])]
            if not whole.all():
                parts = [x for row in batch.filter(pa.array(~whole)).to_pylist() for x in _parts(row)]
                tables.append(pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in parts], f.type) for f in list(arrow)[:-1]], schema=pa.schema(list(arrow)[:-1])))
            for table in tables:
                piece, start, length = (table.column(table.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.uint64) for c in ("_piece", "start", "length"))
                mixed = (piece * np.uint64(0x9E3779B97F4A7C15) ^ start) * np.uint64(0xBF58476D1CE4E5B9)
                chunk = (mixed >> np.uint64(33)) % number[length] if len(length) else length
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(table.columns, arrow, strict=False)), pa.array(chunk.astype(np.int64))], schema=arrow)

    return pieces.mapInArrow(run, schema)


def ranked(pieces: DataFrame) -> DataFrame:
    """The rows of dealt() with rank, from 0, among those of the same length."""
    counted = pieces.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "_chunk", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("_piece", "start"))
    return pieces.withColumn("_row", within).join(before, ["length", "_chunk"]).withColumn("rank", F.col("_before") + F.col("_row") - 1).drop("_chunk", "_row", "_before", "_piece")


def pack_documents(df: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset, and their ids if asked for. tokenizer: path of the vocabulary file."""
    place = storage.mark()
    pieces = storage.written(cut_pieces(df, tokenizer, window, end_id, with_ids).withColumn("_piece", F.monotonically_increasing_id()), "pack-pieces")
    plan, cut = best_plan({r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}, window)  # at most ``window`` rows
    chunks = {length: -int(-(n**0.5) // 1) for length, n in plan.histogram.items()}
    names = [c for c in pieces.columns if c not in ("blocks", "_piece")]
    kept = [T.StructField(c, T.ArrayType(T.IntegerType())) if c == "ids" else pieces.schema[c] for c in names]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return storage.tidy(ranked(dealt(pieces, cut, chunks)).select(*names, "rank").mapInArrow(_placer(plan, schema), schema), place)


def _unpacked(ids: pa.Array, length: np.ndarray) -> pa.Array:
    """Lists of ids, from those of each piece as bytes and their number."""
    data = b"".join(ids.to_pylist())
    ends = np.cumsum([0, *length], dtype=np.int32)
    values = np.frombuffer(data, "<u2" if len(data) == 2 * ends[-1] else "<u4").astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _placer(plan: Plan, schema: T.StructType) -> Callable:
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            value = lambda c: batch.column(names.index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            sequence, offset = plan.place(value("length"), value("rank"))
            kept = [(_unpacked(batch.column(i), value("length")) if names[i] == "ids" else batch.column(i)).cast(arrow.field(i).type) for i in range(len(arrow) - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=arrow)

    return run


def padding_share(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Sequences, ids and padding, where a sequence whose length is a power of two needs none."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("ids"))
    power = F.bit_count("ids") == 1
    return filled.agg(F.count("*").alias("sequences"), F.sum("ids").alias("ids"), F.sum(F.when(power, 0).otherwise(window - F.col("ids"))).alias("padding"))
