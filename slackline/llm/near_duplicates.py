"""Near duplicates by MinHash (operator 7).

Every document's set of word shingles is hashed by many universal functions, whose minima
are cut into bands. Documents with the same set are one node from the start. Documents that
share a band's bucket are candidates; a candidate pair is checked on a short signature
first, which only discards pairs that are far below the threshold, and then on the full
sets. Verified links become connected components by large-star and small-star.

A bucket's pairs aren't all compared. First each member is compared with the bucket's hub,
the member with most company over all its buckets. A group of copies becomes one component
that way. Then all pairs of a bucket that are still in different components follow, block
against block inside tasks that return links only, so no link between candidates is lost.
Members in a bucket's largest component meet only the blocks of those outside it, and large
buckets with one such component, which mostly hold the same members, are compared as one.

With 32 bands of 5 minima a pair at similarity 0.85 is missed as a candidate with a chance of
7e-9, one at 0.80 with 3e-6; 64-bit hashes stand for shingles.

Cost: texts are read twice, the second time only those of candidates; a row a document and
a row a document and band are shuffled. Buckets are counted by partial sums. What a hot key
(a text, bucket, hub or component that very many rows share) is joined to is a written table, and
nothing above the join needs its rows together, so Spark splits the key over many tasks. A
pair of blocks holds 2 * BLOCK members and 2 * BLOCK_SHINGLES shingles on average, or one long text.

Defined results: null, empty and blank texts have no shingles and are linked with nothing;
in near_duplicates() rows that share an id are one document, whose links are pooled, and a
row with a null id takes no part (component_id null, kept); in deduplicate() each row is
a document of its own, whatever its id; other columns, whatever their names, aren't read, and
deduplicate() returns them as they were; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slackline.llm import membership, storage
from slackline.llm.components import stars
from slackline.llm.frames import map_texts
from slackline.llm.textstats import utf8

#: Members of a block, and shingles of all of them, when what is left of a bucket is compared.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19


@dataclass(frozen=True)
class NearParameters:
    """words in a shingle; percent: least similarity; bands of rows minima; margin: how far below the
    threshold the short signature may estimate a pair that is still checked (six standard deviations)."""

    words: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 5
    margin: float = 0.17
    seed: int = 5

    @property
    def functions(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the argument reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, A-Z in lower case."""
    from xxhash import xxh3_64_intdigest

    found = utf8(text).lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, n)
    width = min(n, words)
    factors = _odd(words * 1000 + width, width)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += each[k : n - width + 1 + k] * factors[k]
    return np.unique(_mix(total))


def sketcher(p: NearParameters) -> Callable[[str | None], tuple]:
    """The function that makes of a text: the size of its set, the set's digest, its band keys and its short signature."""
    from xxhash import xxh3_128_digest

    a, b = _odd(p.seed, p.functions), _odd(p.seed + 1, p.functions)
    join, salt = _odd(p.seed + 2, p.rows), _odd(p.seed + 3, p.bands)

    def sketch(text: str | None) -> tuple:
        found = shingles(text, p.words)
        if not len(found):
            return 0, None, None, None
        least = np.full(p.functions, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(found), 128):
            np.minimum(least, (found[i : i + 128, None] * a + b).min(0), out=least)
        least >>= np.uint64(32)
        keys = _mix((least.reshape(p.bands, p.rows) * join).sum(1, dtype=np.uint64) + salt)
        return len(found), xxh3_128_digest(found.tobytes()), keys.view(np.int64).tolist(), (least & np.uint64(0xFFFF)).astype("<u2").tobytes()

    return sketch


_SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())]


def _agreeing(pairs: DataFrame, signatures: DataFrame, p: NearParameters) -> DataFrame:
    """Of different pairs (a, b) those whose signatures don't rule them out."""
    least = int(p.functions * (p.percent / 100 - p.margin))
    sides = [signatures.select(F.col("node").alias(c), F.col("signature").alias(f"_{c}"), F.col("n_shingles").alias(f"n{c}")) for c in ("a", "b")]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").filter((100 * F.col("na") >= p.percent * F.col("nb")) & (100 * F.col("nb") >= p.percent * F.col("na")))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    width = p.functions

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.names.index(c))  # noqa: B023, E731
            x, y = (np.frombuffer(b"".join(column(c).to_pylist()), "<u2").reshape(-1, width) for c in ("_a", "_b"))
            keep = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([column("a").filter(keep), column("b").filter(keep)], schema=to_arrow_schema(schema))

    return joined.select("a", "b", "_a", "_b").mapInArrow(run, schema)


def _sets(nodes: DataFrame, texts: DataFrame, p: NearParameters) -> DataFrame:
    """(node, set) of nodes (node, place, digest). texts: (place, text) of all rows, which aren't shuffled."""
    nodes = storage.written(nodes, "near-wanted")
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("set", T.ArrayType(T.LongType()))]

    def start():
        from xxhash import xxh3_128_digest

        def made(text):
            found = shingles(text, p.words)
            return xxh3_128_digest(found.tobytes()), np.sort(found.view(np.int64)).tolist()

        return made

    made = map_texts(membership.likely(texts, "place", membership.bitmap(nodes, "place")), "text", fields, start, [])
    single = made.groupBy("digest").agg(F.first("set").alias("set"))  # rows may repeat
    return storage.written(single.join(nodes.select("digest", "node"), "digest").select("node", "set"), "near-sets")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, p: NearParameters) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets."""
    pairs = storage.written(pairs, "near-agreeing")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(nodes.select("node", "place", "digest").join(wanted, "node", "left_semi"), texts, p)
    sides = [sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}")) for c in ("a", "b")]
    both = F.size(F.array_intersect("sa", "sb"))
    close = 100 * both >= p.percent * (F.size("sa") + F.size("sb") - both)
    return storage.written(pairs.join(sides[0], "a").join(sides[1], "b").filter(close).select("a", "b"), "near-links")


def _blocks(mine: Column) -> Column:
    """Into how many blocks those rows of a group are cut."""
    return F.greatest(F.ceil(F.count_if(mine) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(mine, F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Of groups with members outside their home: blocks of all (_k), of members outside (_out) and at home (_in), and rows once dealt."""
    out, every = F.col("c") != F.col("home"), F.lit(True)
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(out).alias("_far"), _blocks(every).alias("_k"), _blocks(out).alias("_out"), _blocks(~out).alias("_in"))
    across = F.col("_far") * (F.col("_out") + F.col("_in")) + (F.col("n") - F.col("_far")) * F.col("_out")
    return found.filter("_far > 0 and n > 2").select(*by, "_k", "_out", "_in", F.when(F.col("_k") > 1, across).otherwise(F.col("n")).alias("_rows"))


def _cells(members: DataFrame, placed: DataFrame) -> DataFrame:
    """(united, key, i, j, node, c, own): members of buckets that are still in several components, dealt to pairs of blocks.
    placed: the component of every node that isn't its component's smallest.

    A bucket's home is the component that most of its members are in. Members at home have no one to be compared with there, so they go
    only to the blocks of those outside. Buckets of more than one block with one home are mostly the same members over again: they are
    united, each member dealt once, where that makes fewer rows."""
    now = members.join(placed, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("c"))
    now = storage.written(now, "near-now")
    most = now.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("home"), F.count("*").alias("_parts"))
    homes = storage.written(most.filter("_parts > 1").drop("_parts"), "near-homes")
    now = storage.written(now.join(homes, "key"), "near-apart")
    open_ = storage.written(_dealt(now, "key", "home"), "near-open")
    wide = open_.filter("_k > 1")
    family = storage.written(now.join(wide.select("key"), "key", "left_semi").select("home", "node", "n_shingles", "c").distinct(), "near-family")
    apart = wide.groupBy("home").agg(F.sum("_rows").alias("_apart"), F.count("*").alias("_buckets"))
    united = storage.written(_dealt(family, "home").join(apart, "home").filter("_buckets > 1 and _rows < _apart").drop("_rows", "_apart", "_buckets"), "near-united")
    alone = storage.written(open_.join(united.select("home", F.lit(True).alias("_united")), "home", "left").filter("_k = 1 or _united is null").select("key", "_k", "_out", "_in"), "near-alone")

    columns = ["united", "key", "node", "c", "home", "_k", "_out", "_in"]
    rows = now.join(alone, "key").withColumn("united", F.lit(False)).select(*columns)
    rows = rows.unionByName(family.join(united, "home").withColumn("united", F.lit(True)).withColumn("key", F.col("home")).select(*columns))
    out, one, spread = F.col("c") != F.col("home"), F.col("_k") == 1, F.xxhash64("node")
    own = F.when(one, 0).when(out, F.pmod(spread, F.col("_out"))).otherwise(F.col("_out") + F.pmod(spread, F.col("_in")))
    others = F.when(one, 1).when(out, F.col("_out") + F.col("_in")).otherwise(F.col("_out"))
    rows = rows.withColumn("_i", own.cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), others - 1)))
    return rows.select("united", "key", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "node", "c", F.col("_i").alias("own"))


def _cell_pairs(table: pa.Table, p: NearParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one pair of blocks, and the places of the pairs in it that aren't ruled out: those in different
    components, of similar size and signature, whose first common bucket this is, or that have one where buckets are united."""
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    flat = lambda c: np.asarray(column[c].to_numpy(zero_copy_only=False))
    node, c, own, size = (flat(x) for x in ("node", "c", "own", "n_shingles"))
    keys = np.array(column["keys"].to_pylist(), np.int64)
    signature = np.frombuffer(b"".join(column["signature"].to_pylist()), "<u2").reshape(len(node), -1)
    key, i, j = (int(flat(x)[0]) for x in ("key", "i", "j"))
    united, least = flat("united")[0], int(p.functions * (p.percent / 100 - p.margin))
    band = None if united else int((keys == key).all(0).argmax())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for x in range(len(node)):
        y = np.flatnonzero((c != c[x]) & (node > node[x]) if i == j else (c != c[x]) & (own == j)) if own[x] == i else np.empty(0, int)
        y = y[(100 * size[y] >= p.percent * size[x]) & (100 * size[x] >= p.percent * size[y])]
        common = keys[y] == keys[x]
        y = y[common.any(1) if united else common.argmax(1) == band]
        y = y[(signature[y] == signature[x]).sum(1) >= least]
        found.append((np.full(len(y), x), y))
    return node, *(np.concatenate(z) for z in zip(*found, strict=True))


def _left_over(members: DataFrame, placed: DataFrame, nodes: DataFrame, texts: DataFrame, p: NearParameters) -> DataFrame:
    """Links (a, b) between components among all pairs of a bucket, block against block; only links leave a task.

    The signatures come first, and only nodes of pairs they don't rule out come with their sets."""
    cell = ["united", "key", "i", "j"]
    cells = _cells(members, placed).join(nodes.select("node", "n_shingles", "keys", "signature"), "node")

    def candidates(table: pa.Table) -> pa.Table:
        _, x, y = _cell_pairs(table, p)
        places = np.unique(np.concatenate([x, y]))
        return table.select([*cell, "node", "c", "own"]).take(pa.array(places))

    schema = T.StructType([cells.schema[c] for c in (*cell, "node", "c", "own")])
    chosen = storage.written(cells.groupBy(*cell).applyInArrow(candidates, schema), "near-cells")
    sets = _sets(nodes.select("node", "place", "digest").join(chosen.select("node").distinct(), "node", "left_semi"), texts, p)

    def compare(table: pa.Table) -> pa.Table:
        node, x, y = _cell_pairs(table, p)
        lists = table.column("set").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        of = lambda k: values[ends[k] - ends[0] : ends[k + 1] - ends[0]]
        group = table.column("c").to_numpy().copy()
        a, b = [], []
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            if group[u] == group[v]:
                continue
            s, t = of(u), of(v)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= p.percent * (len(s) + len(t) - both):
                a.append(node[u])
                b.append(node[v])
                group[group == group[u]] = group[v]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = chosen.join(nodes.select("node", "n_shingles", "keys", "signature"), "node").join(sets, "node")
    return storage.written(full.groupBy(*cell).applyInArrow(compare, "a long, b long"), "near-more")


def _linked(rows: DataFrame, texts: DataFrame, p: NearParameters, pool: bool) -> DataFrame:
    """_row, doc_id, n_shingles and component of each row of sketches with a set; a component is its least _row.
    texts: (place, text) of all rows; rows have their place. pool: rows with the same doc_id are linked."""
    sound = rows.filter("digest is not null")
    same = storage.written(sound.groupBy("digest").agg(F.min("_row").alias("node")), "near-same")
    known = storage.written(sound.select("_row", "doc_id", "n_shingles", "digest").join(same, "digest").drop("digest"), "near-known")
    nodes = sound.select(F.col("_row").alias("node"), "place", "digest", "n_shingles", "keys", "signature").join(same.select("node"), "node")
    nodes = storage.written(nodes.withColumn("keys", F.array_distinct("keys")), "near-nodes")  # as many as bands but for one chance in 2**50

    buckets = nodes.select(F.explode("keys").alias("key"), "node", "n_shingles")
    shared = storage.written(buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-shared")
    members = storage.written(membership.likely(buckets, "key", membership.bitmap(shared, "key")).join(shared, "key"), "near-members")
    nodes = storage.written(membership.likely(nodes, "node", membership.bitmap(members, "node")), "near-candidates")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("hub"))
    hubs = storage.written(hubs, "near-hubs")
    spokes = members.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = _verified(_agreeing(storage.written(spokes, "near-spokes"), nodes, p), nodes, texts, p)
    if pool:
        held = storage.written(known.select("doc_id", "node").distinct(), "near-held")
        several = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
        links = links.unionByName(held.join(storage.written(several, "near-several"), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"))
    first = stars(links)
    more = _left_over(members.select("key", "node", "n_shingles"), first, nodes, texts, p)
    final = stars(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return storage.written(known.join(final, "node", "left").select("_row", "doc_id", "n_shingles", F.coalesce("component", "node").alias("component")), "near-linked")


def _sketched(df: DataFrame, text: str, p: NearParameters, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each row with its sketch."""
    return storage.written(map_texts(df, text, _SKETCH, lambda: sketcher(p), keep), "near-sketches")


def near_duplicates(df: DataFrame, parameters: NearParameters = NearParameters(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    place = storage.mark()
    named = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = _sketched(named.withColumn("_row", F.monotonically_increasing_id()), "_text", parameters, ["doc_id", "_row"])
    texts = named.select(F.col("doc_id").alias("place"), F.col("_text").alias("text"))
    linked = _linked(rows.filter("doc_id is not null").withColumn("place", F.col("doc_id")), texts, parameters, pool=True)
    least = storage.written(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-least")
    alone = rows.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = linked.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return storage.tidy(found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), place)


def deduplicate(docs: DataFrame, parameters: NearParameters, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, null after all others, and of rows that
    repeat that id the first. Links are between rows, so different texts under one id are told apart."""
    place = storage.mark()
    columns = docs.columns
    own = [f"_d{i}" for i in range(len(columns))]
    of = own[columns.index(text)]
    named = docs.toDF(*own).withColumn(of, F.col(of).cast("string")).withColumn("doc_id", F.col(own[columns.index("doc_id")]).cast("long"))
    rows = storage.written(named.withColumn("_row", F.monotonically_increasing_id()), "near-rows")  # a number that stays
    rows = rows.withColumn("place", F.col("_row"))
    linked = _linked(_sketched(rows, of, parameters, ["doc_id", "_row", "place"]), rows.select("place", F.col(of).alias("text")), parameters, pool=False)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    several = linked.groupBy("component").agg(F.count("*").alias("_n"), least.alias("_least")).filter("_n > 1")
    first = storage.written(several.select("component", F.col("_least._row").alias("_first")), "near-first")
    gone = linked.join(first, "component").filter("_row <> _first").select("_row")
    gone = storage.written(gone, "near-gone")  # its size is known when the join is planned
    return storage.tidy(rows.join(gone, "_row", "left_anti").select(*own).toDF(*columns), place)
