"""Mixing, archives, search, near duplicates, packing and the pipeline against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slackline.llm import additive_search, components, membership, mixing, near_duplicates, packing, warc
from slackline.llm.queries import ORACLES, QUERIES, vocabulary
from tests.llm.nasty import prose

MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{MID}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).fetchdf(), QUERIES[name](spark, MID).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda df: sorted(tuple(None if v != v else str(v).removesuffix(".0") for v in r) for r in df[columns].itertuples(index=False))
    assert plain(got.astype(object).where(got.notna(), float("nan"))) == plain(want.astype(object).where(want.notna(), float("nan")))


def test_mixture_meets_its_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"), F.lit("t").alias("text"))
    mixed = mixing.mix_sources(docs, {"big": 1.0, "small": 3.0})
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.02 and abs(sum(n.values()) - 20_000) < 600
    copies = Counter(r["copies"] for r in mixed.filter("source = 'small'").dropDuplicates(["doc_id"]).collect())
    assert copies[4] > copies[1] and max(copies) > 8
    keys = [r["shuffle_key"] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert mixing.mix_sources(docs, {"small": 1.0}).filter("source = 'big'").isEmpty()


def test_poisson_levels_at_high_rates(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 40.0), ("c", 500.0)], "source string, rate double")
    for r in mixing.poisson_levels(rates).collect():
        rate = {"a": 0.3, "b": 40.0, "c": 500.0}[r["source"]]
        u = np.random.default_rng(0).random(4000)
        draws = np.searchsorted(np.array(r["levels"]), u, side="right")
        assert abs(draws.mean() - rate) < 0.1 * rate and abs(draws.var() - rate) < 0.2 * rate


def test_archives_parse_by_hand(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "é\r\n\r\n")]
    warc.write_archives(warc.resolve_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), f"file://{tmp_path}/w")
    records = [r for p in sorted(tmp_path.glob("w/part-*")) for r in warc.parse_archive(p.read_bytes())]
    kinds = Counter(h["warc-type"] for h, _ in records)
    assert kinds == {"response": 2, "revisit": 1}
    revisit = next(h for h, _ in records if h["warc-type"] == "revisit")
    original = next(h for h, b in records if h["warc-type"] == "response" and b.endswith(b"same"))
    assert revisit["warc-refers-to"] == original["warc-record-id"] and revisit["warc-refers-to-target-uri"] == "http://b"
    assert revisit["warc-payload-digest"] == original["warc-payload-digest"]
    small = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), min_bytes=5).collect()
    assert all(r["record_type"] == "response" for r in small)


def test_search_recall(spark):
    rows = QUERIES["op4_additive_search"](spark, "/root/testdata/sf0.1").collect()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack([np.asarray(v, float) for v in table.embedding]), table.vec_id.to_numpy()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(ids[ids % 20 == 0].tolist())
    hits = total = 0
    for q, got in found.items():
        scores = (x * x[ids == q][0]).sum(1)
        other = ids != q
        best = ids[other][np.lexsort((ids[other], -scores[other]))[:20]]
        hits, total = hits + len(set(best) & {v for v, _ in got}), total + 20
        assert all(abs(scores[ids == v][0] - s) < 1e-9 for v, s in got) and len(got) == 20
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    assert hits / total >= 0.95


def test_search_with_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(1, 400)] + [(400 + i, [2.0 + i / 100, 1.0]) for i in range(100)]
    out = additive_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=500, k=20).collect()
    assert out == []
    out = additive_search.nearest(spark.createDataFrame([(0, [0.0, 1.0]), *rows], "vec_id long, embedding array<double>"), every=1000, k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == list(range(1, 21))


def test_beam_beats_greedy():
    x = np.random.default_rng(2).normal(size=(600, 16))
    books = additive_search.fit_index(x, books=4, words=16).books
    unit = x / np.sqrt((x * x).sum(1))[:, None]

    def error(beam):
        codes, norms = additive_search.AdditiveIndex(books, beam).encode(x)
        assert np.allclose(norms, np.sqrt((x * x).sum(1)))
        return ((unit - sum(b[c] for b, c in zip(books, codes.T, strict=True))) ** 2).sum()

    assert error(8) < error(1)


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def plain_components(texts, width, percent):
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    where, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        common = Counter(j for g in s for j in where[g] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_query(spark):
    texts = dict(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect())
    want = plain_components(texts, 3, 85)
    rows = QUERIES["op7_minhash_components"](spark, MID).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def variants(number, size, changes, seed):
    """Copies of one text with so many words changed: near each other or not, as chance has it."""
    rng, base = random.Random(seed), [f"w{k}" for k in range(size)]
    for _ in range(number):
        words = base[:]
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield " ".join(words)


def test_near_duplicates_lose_no_link_in_large_groups(spark):
    """Groups around the threshold, larger than a block, where most links don't go through any hub."""
    texts = dict(enumerate([*variants(700, 120, 14, 1), *variants(300, 40, 6, 2), *(prose(50, s) for s in range(40)), *["same words here now"] * 50]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    rows = near_duplicates.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain_components(texts, 3, 85)


def test_left_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    texts = dict(enumerate(variants(150, 60, 9, 5)))
    rows = near_duplicates.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain_components(texts, 3, 85)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (70, 71), (71, 70)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(300)) and got[71] == got[70] == 70
    assert len(rows) == len(got) == 61 + 300 + 2


def test_membership_keeps_all_members(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    kept = membership.likely(rows, "k", membership.bitmap(rows.filter("k % 7 = 0"), "k")).collect()
    assert {r["k"] for r in kept} >= set(range(0, 5000, 7)) and len(kept) < 800
    assert membership.likely(rows, "k", membership.bitmap(rows.limit(0), "k")).isEmpty()


def test_packing_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    texts = dict(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op10_bin_slack_packing"](spark, MID).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    filled = packing.padding_share(spark.createDataFrame(rows)).first()
    assert filled["padding"] < 0.01 * filled["ids"]


@pytest.mark.parametrize("seed", range(20))
def test_closest_fill(seed):
    rng = random.Random(seed)
    for _ in range(30):
        room = rng.randint(0, 60)
        left = sorted({rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}.items(), reverse=True)
        sums = {0}
        for length, n in left:
            sums = {s + k * length for s in sums for k in range(n + 1)}
        taken = packing.closest_fill(left, room)
        assert sum(a * b for a, b in taken.items()) == max(s for s in sums if s <= room)
        assert all(n <= dict(left)[k] for k, n in taken.items())


def test_plan_places_every_piece_once():
    rng = random.Random(9)
    histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(30)}
    plan = packing.plan_windows(histogram, 64)
    taken = defaultdict(list)
    for length, n in histogram.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            taken[s].append((o, length))
    for pieces in taken.values():
        at = 0
        for o, length in sorted(pieces):
            assert o == at
            at += length
        assert at <= 64
    rooms = []  # first fit, longest first
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        k = next((i for i, room in enumerate(rooms) if room >= length), None)
        if k is None:
            rooms.append(64)
            k = len(rooms) - 1
        rooms[k] -= length
    assert len(taken) <= len(rooms) and sorted(taken) == list(range(len(taken)))
    assert plan.padding == sum(64 - n for n in (sum(k for _, k in p) for p in taken.values()) if n & (n - 1))


def test_hot_length_leaves_little_padding(spark):
    """Two thirds of all documents have one length that fills a window badly."""
    rows = [(i, "word " * (2400 if i % 3 else 30 + i % 9)) for i in range(90)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary())
    share = packing.padding_share(packed).first()
    assert share["padding"] <= 0.02 * share["ids"] and share["ids"] == sum(len(t.split()) + 1 for _, t in rows)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).filter("n <> t").isEmpty()


def test_hot_length_is_numbered_in_chunks(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"), F.col("id").alias("ids_crc32"), F.lit(9).cast("long").alias("doc_tokens"), F.array(F.col("id")).alias("blocks"), F.col("id").alias("_piece"))
    chunks = {k: 50 for k in range(1, 51)}
    dealt = packing.dealt(pieces, frozenset(), chunks)
    hot = [r["count"] for r in dealt.filter("length = 7").groupBy("_chunk").count().collect()]
    assert len(hot) == 50 and max(hot) < 80
    by = defaultdict(list)
    for r in packing.ranked(dealt).collect():
        by[r["length"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 5000


@pytest.mark.parametrize("width", ["<u2", "<u4"])
@pytest.mark.parametrize("size", [1, 63, 64, 65, 127, 128, 2400, 4095])
def test_parts_have_the_checksums_of_their_ids(size, width):
    ids = np.random.default_rng(size).integers(0, 49_000, size).astype("<u4")
    row = {"start": 4096, "length": size, "ids_crc32": zlib.crc32(ids.tobytes()), "blocks": packing.block_sums(ids.tobytes()), "ids": ids.astype(width).tobytes()}
    assert packing.combined(row["blocks"], size) == row["ids_crc32"]
    parts = packing._parts(row)
    assert b"".join(p["ids"] for p in parts) == row["ids"] and [p["length"] for p in parts] == packing.binary_parts(size)
    for p in parts:
        own = np.frombuffer(p["ids"], width)
        assert p["ids_crc32"] == zlib.crc32(own.astype("<u4").tobytes()) and own.tolist() == ids.tolist()[p["start"] - 4096 :][: p["length"]]
    listed = packing._unpacked(pa.array([p["ids"] for p in parts]), np.array([p["length"] for p in parts]))
    assert sum(listed.to_pylist(), []) == ids.tolist() and [len(x) for x in listed.to_pylist()] == packing.binary_parts(size)


def test_packed_ids_are_the_documents(spark):
    rows = [(i, "word " * (2400 if i % 3 else 30 + i % 9)) for i in range(40)] + [(99, None), (None, "x")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), with_ids=True).collect()
    for doc_id, text in rows:
        own = sorted((r for r in out if r["doc_id"] == doc_id), key=lambda r: r["start"])
        ids = [i for r in own for i in r["ids"]]
        assert ids[-1] == 2 and len(ids) == own[0]["doc_tokens"] == len((text or "").split()) + 1
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] for r in own)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = docs.columns
    (_, good), (_, one), (_, mask), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = good(spark, docs, MID)
    verdicts = {r["doc_id"]: r["kept"] for r in QUERIES["op8_quality_rules"](spark, MID).collect()}
    rows = kept.collect()
    assert kept.columns == columns and {r["doc_id"] for r in rows} == {i for i, k in verdicts.items() if k}
    kept = spark.createDataFrame(rows, docs.schema)
    single = one(spark, kept, MID).collect()
    want = plain_components({r["doc_id"]: r["text"] for r in rows}, 5, 80)
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, (_, c) in want.items() if i == c)
    clean = mask(spark, spark.createDataFrame(single, docs.schema), MID).collect()
    assert len(clean) == len(single) and not any("@mail" in r["text"] for r in clean) and all(r["n_chars"] == len(r["text"]) for r in clean if "<EMAIL>" in r["text"])
    mixed = mix(spark, spark.createDataFrame(clean, docs.schema), MID)
    assert mixed.columns == columns and 0.8 * len(clean) < mixed.count() < 1.2 * len(clean)
    packed = pack(spark, mixed, MID)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


def test_pipeline_runs_whole(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and "sequence_id" in out.columns
