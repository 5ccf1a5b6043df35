"""Sharding, whitening and the prefix trie against plain versions, with awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import queries
from quillgraph.llm.prefix_trie import Sweep, prefix_trie, turn_arrays
from quillgraph.llm.sharding import _share_out, communication_matrix, hypergeometric, shuffle_into_shards, write_shards
from quillgraph.llm.shared import Workspace
from quillgraph.llm.whitening import _deviations, whiten

# sharding


def chances(pool, good, draws):
    return [math.comb(good, k) * math.comb(pool - good, draws - k) / math.comb(pool, draws) for k in range(draws + 1)]


@pytest.mark.parametrize("pool, good, draws", [(10, 3, 4), (50, 20, 30), (7, 7, 3), (9, 0, 5), (5, 2, 5), (0, 0, 0), (400, 390, 60)])
def test_hypergeometric_follows_its_law(spark, pool, good, draws):
    """The inverse distribution at evenly spaced points has each value as often as its chance says."""
    n = 20_000
    args = [F.lit(x).cast("long") for x in (pool, good, draws)]
    got = dict(spark.range(n).select(hypergeometric((F.col("id") + 0.5) / n, *args).alias("k")).groupBy("k").count().collect())
    for k, p in enumerate(chances(pool, good, draws)):
        assert abs(got.get(k, 0) / n - p) <= 3 / n, (k, p)
    assert sum(got.values()) == n


def test_hypergeometric_of_many_rows(spark):
    pool, good, draws, n = 10**11, 3 * 10**10, 10**9, 200
    args = [F.lit(x).cast("long") for x in (pool, good, draws)]
    k = np.array([r[0] for r in spark.range(n).select(hypergeometric((F.col("id") + 0.5) / n, *args)).collect()], float)
    sd = math.sqrt(draws * 0.3 * 0.7 * (1 - draws / pool))
    assert abs(k.mean() - 0.3 * draws) < 0.1 * sd and abs(k.std() / sd - 1) < 0.03


def test_communication_matrix_has_both_sums(spark):
    r = random.Random(4)
    n = {p: r.choice([1, 2, 7, 300, 4000]) for p in range(0, 90, 1) if p % 7}
    counts = spark.createDataFrame(list(n.items()), "part long, n long")
    got = {x.part: x.counts for x in communication_matrix(counts, 5, Workspace(spark, "t")).collect()}
    assert {p: sum(c) for p, c in got.items()} == n
    total = sum(n.values())
    assert [sum(c[s] for c in got.values()) for s in range(5)] == [total // 5 + (s < total % 5) for s in range(5)]


def test_small_matrix_follows_the_law(spark):
    """Partitions of 2 and 4 rows, two shards: what the first sends to shard 0 over 4,000 seeds."""
    children = F.array(*[F.struct(F.lit(p).cast("long").alias("node"), F.lit(n).cast("long").alias("n")) for p, n in ((0, 2), (1, 4))])
    places = F.array(F.lit(3).cast("long"), F.lit(3).cast("long"))
    drawn = spark.range(4000).select(_share_out(places, children, 2, F.lit(11), F.col("id")).alias("c")).collect()
    assert all([a + b for a, b in zip(r.c[0].counts, r.c[1].counts, strict=True)] == [3, 3] and sum(r.c[0].counts) == 2 for r in drawn)
    got = Counter(r.c[0].counts[0] for r in drawn)
    assert sum((got[k] - 4000 * p) ** 2 / (4000 * p) for k, p in enumerate(chances(6, 3, 2))) < 13.8  # 1 in 1,000


SHARD_SCHEMA = "doc_id long, text string, shard int, slot string, row int, part long, `a.b` int"


def test_shards_are_exact_and_whole(spark, tmp_path):
    rows = [(None if i % 5 == 0 else i % 40, None if i % 11 == 0 else "same" if i % 3 == 0 else f"t{i}" * (i % 7), 1, "x", None, 3, i % 2) for i in range(1003)] + [(7, "long " * 100_000, 1, "x", 1, 2, 3)] * 2
    docs = spark.createDataFrame(rows, SHARD_SCHEMA).repartition(9)
    out = shuffle_into_shards(spark, docs, shards=8, seed=3).cache()
    found = out.collect()
    assert Counter(tuple(r.row) for r in found) == Counter(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert [len(slots[s]) for s in range(8)] == [126] * 5 + [125] * 3
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    write_shards(out, str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.shard, r.slot) for r in again.select("shard", "slot").collect()} == {(r.shard, r.slot) for r in found}
    other = {(r.shard, r.slot): r.row for r in shuffle_into_shards(spark, docs, shards=8, seed=4).collect()}
    assert sum(other[r.shard, r.slot] == r.row for r in found) < 500


def test_shuffle_is_uniform_over_shards_and_slots(spark):
    """A run of neighbours spreads over shards and places as chance has it."""
    docs = spark.range(40_000).repartition(7)
    found = shuffle_into_shards(spark, docs.select(F.col("id").alias("doc_id")), shards=4, seed=9).select("row.doc_id", "shard", "slot").toPandas()
    assert sorted(found["shard"].value_counts()) == [10_000] * 4
    cells = np.zeros((10, 40))
    np.add.at(cells, (found["doc_id"] // 4000, found["shard"] * 10 + found["slot"] // 1000), 1)
    chi = ((cells - 100) ** 2 / 100).sum()
    assert abs(chi - 9 * 39) < 4 * math.sqrt(2 * 9 * 39)
    beside = found.sort_values(["shard", "slot"])["doc_id"].to_numpy()
    assert abs(np.corrcoef(beside[:-1], beside[1:])[0, 1]) < 0.02


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in shuffle_into_shards(spark, docs, 8).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert shuffle_into_shards(spark, docs.where("false"), 8).collect() == []
    assert {r.shard for r in shuffle_into_shards(spark, docs, 1).collect()} == {0}
    with pytest.raises(ValueError):
        shuffle_into_shards(spark, docs, 0)


def test_op11_query(spark, sf):
    got = queries.QUERIES["op11_sharding"](spark, sf).collect()
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(text)
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)


# whitening


def plain_whitening(vectors, k=16):
    grid = [None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted({tuple(x) for x in grid if x is not None}), float)
    centred = fit - fit.mean(axis=0)
    values, turn = np.linalg.eigh(centred.T @ centred / len(fit))
    order = np.argsort(-values)[:k]
    return grid, len(fit), fit, values[order], turn[:, order], values.sum()


def check_whitening(rows, got, k):
    grid, n, fit, values, turn, trace = plain_whitening([v for _, v in rows], k)
    mean = fit.mean(axis=0)
    sums = [int(s) for s in fit.sum(axis=0)]
    want = Counter(i for (i, _), x in zip(rows, grid, strict=True) if x is not None)
    by = defaultdict(dict)
    for r in got:
        by[r.component][r.vec_id, r.deviation] = r
        assert r.n == n and abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9
    assert Counter(r.vec_id for r in got if r.component == 1) == want
    for j in range(len(values)):
        sign = 0
        for (i, _), x in zip(rows, grid, strict=True):
            if x is None:
                continue
            r = by[j + 1][i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))]
            y = (np.array(x) - mean) @ turn[:, j] / math.sqrt(values[j])
            sign = sign or (1 if y * r.whitened >= 0 or abs(y) < 1e-6 else -1)
            assert abs(r.whitened - sign * y) < 1e-6


def test_whitening_equals_the_eigenvectors(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 24)) * np.linspace(2, 0.1, 24) @ np.linalg.qr(r.standard_normal((24, 24)))[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(900, None), (901, [math.nan] + [0.0] * 23), (902, [math.inf] + [0.0] * 23), (903, [None] + [0.0] * 23), (None, rows[3][1]), (5, rows[5][1]), (5, rows[7][1])] + [(1000 + i, rows[0][1]) for i in range(200)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, component int").repartition(5)
    check_whitening(rows, whiten(spark, frame, k=16).collect(), 16)
    # a block that takes many passes
    check_whitening(rows, whiten(spark, frame, k=3, block=5).collect(), 3)
    check_whitening(rows, whiten(spark, frame.withColumn("embedding", F.col("embedding").cast("array<double>")), k=40).collect(), 24)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark, spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark, spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], schema)).collect() == []
    # rank one of two dimensions; the shorter vector and the empty ones stay out
    got = whiten(spark, spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [5.0]), (4, []), (5, [])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9)) for r in got) == [(1, 1, 128**2, 1.0), (2, 1, 128**2, 1.0)]


def test_deviations_beyond_a_long():
    x = np.array([[2_000_000, 5], [0, 5]])
    assert _deviations(x, 2, x.sum(axis=0)) == [4 * 10**12, 4 * 10**12]
    assert _deviations(x * 10**6, 2, x.sum(axis=0) * 10**6) == [None, None]


def test_op12_query(spark, sf):
    table = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(table, queries.QUERIES["op12_embedding_whitening"](spark, sf).collect(), 16)


# prefix trie


def plain_trie(convs):
    """convs: id -> list of (key, bytes)."""
    if not convs:
        return {}
    members, ends, last = defaultdict(set), defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            key = tuple(t[0] for t in turns[:d])
            members[key].add(c)
            last[key] = turns[d - 1][1] if d else 0
        ends[tuple(t[0] for t in turns)].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[c] for c in children[key]) or 1
        saved[key] = (len(members[key]) - 1) * last[key] + sum(saved[c] for c in children[key])
    return {
        (min(members[k]), len(k)): (min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k in members
    }


def collected(df):
    got = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def random_convs(seed, n):
    r = random.Random(seed)
    convs = {}
    for c in r.sample(range(-50, 5 * n), n):
        if convs and r.random() < 0.3:
            turns = list(r.choice(list(convs.values())))[: r.randint(0, 6)]
        elif r.random() < 0.3:
            turns = [("user", "hot"), ("assistant", "answer")]
        else:
            turns = []
        convs[c] = turns + [(r.choice(["user", "assistant"]), r.choice("abcd") * r.randint(0, 3)) for _ in range(r.choice([0, 0, 1, 2, 5]))]
    return convs


@pytest.mark.parametrize("units", [2, 3, 4096])
def test_trie_equals_plain(spark, units):
    """Two spines a partition, stitched at one level and at several."""
    convs = random_convs(units, 240)
    convs[10**6] = [("user", f"turn {k}") for k in range(700)]
    convs[10**6 + 1] = convs[10**6][:600] + [("user", "other")]
    rows = [(c, list(t)) for c, t in convs.items()]
    hashed = spark.createDataFrame([(c, [(hashlib.sha256(repr(x).encode()).hexdigest()[:32], len(x[1])) for x in t]) for c, t in rows], "conv_id long, turns array<struct<digest:string,n_bytes:bigint>>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert collected(prefix_trie(spark, hashed, units)) == plain_trie({c: [(x, len(x[1])) for x in t] for c, t in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sweep_cut_anywhere():
    """Any cut of the sorted rows into units gives the nodes of one sweep."""
    convs = random_convs(8, 120)
    order = sorted((tuple(hashlib.sha256(repr(x).encode()).digest()[:16] for x in t), c, [0, *(len(x[1]) for x in t)]) for c, t in convs.items())

    def swept(cuts):
        top, names, nodes = Sweep(0, True), {}, []
        for unit, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(order)], strict=True)):
            sweep = Sweep(unit)
            for key, c, sizes in order[a:b]:
                sweep.row(c, [b"", *key], sizes)
            if a < b:
                sweep.end()
                spine = sorted((x for x in sweep.out if x["kind"] == 1), key=lambda x: (x["side"], x["depth"]))
                top.spines([x for x in spine if not x["side"]], [x for x in spine if x["side"]])
                nodes += [x for x in sweep.out if x["kind"] == 0]
        top.end()
        names = {(x["unit"], x["side"], x["depth"]): x["conv_id"] for x in top.out if x["kind"] == 3}
        for x in nodes + [x for x in top.out if x["kind"] == 0]:
            parent = x.get("parent_conv_id")
            if parent is None and "unit" in x:
                parent = names[x["unit"], x["side"], x["depth"] - 1]
            yield x["conv_id"], x["depth"], parent, x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"]

    want = {(c, d, *v[:-1]) for (c, d), v in plain_trie({c: [(x, len(x[1])) for x in t] for c, t in convs.items()}).items()}
    r = random.Random(2)
    for _ in range(60):
        assert set(swept(sorted(r.sample(range(len(order) + 1), r.randint(0, 12))))) == want


def test_hot_copies_span_partitions(spark):
    """Pieces of one node's ids come from many partitions and keep their order."""
    turns = [("ab" * 16, 3), ("cd" * 16, 5)]
    arrays = spark.range(20_000).select("id", F.lit(0).alias("k")).withColumn("turns", F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(n).cast("long").alias("n_bytes")) for d, n in turns])).withColumnRenamed("id", "conv_id")
    got = collected(prefix_trie(spark, arrays))
    assert got == plain_trie({c: turns for c in range(20_000)})


def test_turns_in_order(spark):
    rows = [(1, 2, "user", "c"), (1, None, None, "a"), (1, 1, "user", None), (1, 1, "user", None), (2, None, None, "a"), (2, 1, "user", ""), (None, 1, "user", "x"), (3, 0, "user", "é" * 100_000), (3, 0, "user", "f"), (4, 0, "user", "f"), (4, 0, "user", "é" * 100_000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, digest int").repartition(3)
    arrays = {r.conv_id: [(t.digest, t.n_bytes) for t in r.turns] for r in turn_arrays(frame).collect()}
    key = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
    assert arrays[1] == [(key("", "a"), 1), (key("user", ""), 0), (key("user", ""), 0), (key("user", "c"), 1)]
    assert arrays[2] == arrays[1][:2] and arrays[3] == arrays[4] and sorted(x[1] for x in arrays[3]) == [1, 200_000]
    got = collected(prefix_trie(spark, turn_arrays(frame)))
    assert got == plain_trie(arrays)
    assert collected(prefix_trie(spark, turn_arrays(frame.where("false")))) == {}


def test_op13_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op13_conversation_prefix_trie"]).df()
    got = queries.QUERIES["op13_conversation_prefix_trie"](spark, sf).toPandas()
    order = ["conv_id", "depth"]
    want, got = (x.sort_values(order).reset_index(drop=True)[sorted(x.columns)] for x in (want, got))
    assert len(got) > 50 and (got.fillna(-1).astype(str).replace(r"\.0$", "", regex=True) == want.fillna(-1).astype(str).replace(r"\.0$", "", regex=True)).all().all()
