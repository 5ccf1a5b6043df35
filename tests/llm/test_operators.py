"""Each operator against a brute-force version, with awkward rows: nulls, empty
and long texts, ties, repeated rows, clashing columns, and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate as dec
from quillgraph.llm import kneser_ney, mixing, pii
from quillgraph.llm.exact_dedup import PerfectHash, exact_dedup
from quillgraph.llm.jaccard_join import jaccard_components
from quillgraph.llm.quality import quality
from quillgraph.llm.substring_dedup import substring_dedup
from quillgraph.llm.suffix_dedup import suffix_dedup
from quillgraph.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label long, pid int, blob binary, kind string, cls long"


def make_texts(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "Ünder", "x"]
    out = [None, "", " \n\t", "one", "One two", "a b c d e", "A  b\tc d\ne", "ab" * 400, "x " * 300, "same same " * 40]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 120))) for _ in range(12)]
    out += base + base[:4]
    passage = " ".join(r.choice(words) for _ in range(40))
    for b in base[:6]:
        w = b.split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(b + "\n" + passage + " " + " ".join(r.choice(words) for _ in range(10)))
    out.append(" ".join(r.choice(words) for _ in range(20000)))
    out.append(out[-1][5000:15000])
    return out


@pytest.fixture(scope="module")
def rows():
    t = make_texts()
    random.Random(1).shuffle(t)
    return list(enumerate(t, start=7))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, 0.5, 3, 4, b"z", "k", 9) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    found = df.collect()
    out = {r.doc_id: r for r in found}
    assert len(out) == len(found)
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    table = PerfectHash.build(a, b)
    assert sorted(table.find(a, b)) == list(range(5000))
    again, _ = PerfectHash.load(memoryview(table.dump()))
    assert (again.find(a, b) == table.find(a, b)).all()
    assert len(PerfectHash.build(a[:0], b[:0]).find(a[:5], b[:5])) == 5


@pytest.mark.parametrize("history", [None, True, False])
def test_exact_dedup(spark, docs, rows, empty, history):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = by_id(exact_dedup(spark, docs, is_history=None if history is None else F.lit(history)))
    for i, t in rows:
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(g), len(g), i == max(g), sha((t or "").encode()))
    assert exact_dedup(spark, empty).count() == 0


def test_exact_dedup_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "alone"), (None, "two"), (4, "two"), (5, "same"), (5, "same"), (None, None), (None, "")], "doc_id long, text string")
    got = sorted((r.text_sha256, r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark, df).collect())
    want = [("alone", None, None, 1, True), ("two", None, 4, 2, False), ("two", 4, 4, 2, True), ("same", 5, 5, 2, True), ("same", 5, 5, 2, True), ("", None, None, 2, True), ("", None, None, 2, True)]
    assert got == sorted((sha(t.encode()), i is None, i, k, n, kept) for t, i, k, n, kept in want)


def brute_windows(items, length):
    """Covered flags of each document's units where a window also starts earlier."""
    seen, out = set(), {}
    for i, u in sorted(items):
        cut = [False] * len(u)
        for p in range(len(u) - length + 1):
            key = bytes(u[p : p + length]) if isinstance(u, bytes) else tuple(u[p : p + length])
            if key in seen:
                cut[p : p + length] = [True] * length
            seen.add(key)
        out[i] = cut
    return out


def test_substring_dedup(spark, docs, rows, empty):
    items = [(i, (t or "").encode().split()) for i, t in rows]
    want = brute_windows(items, 20)
    got = by_id(substring_dedup(spark, docs))
    for i, w in items:
        kept = b" ".join(x for x, c in zip(w, want[i]) if not c)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(want[i]), sha(kept))
        assert got[i].kept_text.encode() == kept
        for s, e in zip(got[i].spans[::2], got[i].spans[1::2]):
            assert e - s >= 20
    assert substring_dedup(spark, empty).count() == 0


def test_suffix_dedup(spark, docs, rows, empty):
    items = [(i, (t or "").encode()) for i, t in rows]
    want = brute_windows(items, 100)
    got = by_id(suffix_dedup(spark, docs, keep_bytes=True))
    for i, w in items:
        kept = bytes(x for x, c in zip(w, want[i]) if not c)
        runs = sum(1 for k, c in enumerate(want[i]) if c and not (k and want[i][k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(w), sum(want[i]), runs, sha(kept))
        assert bytes(got[i].kept) == kept
    assert suffix_dedup(spark, empty).count() == 0


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_hot_anchor_and_slices(spark, operator, monkeypatch):
    """A line in all documents, with hot dealing and sliced anchor files forced: same result."""
    from quillgraph.llm import repeats

    r = random.Random(5)
    line = " ".join(f"common{k}" for k in range(14))
    data = [(k, " ".join([*(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(12)), line, *(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(12))])) for k in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    before = sorted(map(tuple, operator(spark, df).collect()))
    monkeypatch.setattr(repeats, "HOT", 5)
    monkeypatch.setattr(repeats, "HOT_PER_CHUNK", 1)
    assert sorted(map(tuple, operator(spark, df).collect())) == before
    monkeypatch.setattr(repeats, "slices", lambda folder, count, parts, limit=0: [(k, k + 1) for k in range(parts)])
    monkeypatch.setattr(f"{operator.__module__}.slices", repeats.slices)
    assert sorted(map(tuple, operator(spark, df).collect())) == before


def test_repeated_ids_do_not_mark_each_other(spark):
    t = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(5, t), (5, t)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup(spark, df).collect()] == [0, 0]
    assert [r.n_removed for r in suffix_dedup(spark, df).collect()] == [0, 0]


def test_null_ids(spark):
    t = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, t), (5, t)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(spark, df).collect()} == {None: 0, 5: 60}
    assert {r.doc_id: r.component_id for r in jaccard_components(spark, df).collect()} == {None: None, 5: None}
    assert {r.doc_id for r in pii.find_pii(spark, df).collect()} == {None, 5}


def brute_components(rows, k=5, num=75, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sets, {i: root(i) for i in sets}


def test_jaccard(spark, docs, rows, empty):
    sets, component = brute_components(rows)
    got = by_id(jaccard_components(spark, docs))
    for i, _ in rows:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), component[i])
    assert jaccard_components(spark, empty).count() == 0


@pytest.mark.parametrize("often", [1, 2, 8])
def test_jaccard_at_the_threshold(spark, monkeypatch, often):
    """Chains of edits around 0.75, so that links fall on both sides and components need several of them."""
    from quillgraph.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    if often == 2:  # lists in many blocks and rows
        monkeypatch.setattr(jaccard_join, "BLOCK", 6)
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 400)
    r = random.Random(11)
    data = []
    for _ in range(6):
        w = [f"t{r.randrange(50)}" for _ in range(r.randint(8, 60))]
        for _ in range(25):
            w = list(w)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"t{r.randrange(50)}"
            if r.random() < 0.3:
                w.append(f"t{r.randrange(50)}")
            data.append(" ".join(w))
    data += ["boiler plate line that all of these share " + " ".join(f"u{k}{j}" for j in range(r.randint(1, 4))) for k in range(40)]
    rows = list(enumerate(data))
    _, component = brute_components(rows)
    got = by_id(jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {i: got[i].component_id for i, _ in rows} == component


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, docs, rows, empty, order):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    small = [(i, t) for i, t in rows if len(t or "") < 2000]
    got = by_id(kneser_ney.score_documents(spark, docs.where(F.length(F.coalesce("text", F.lit(""))) < 2000), training, order))
    words = lambda t: (t or "").encode().lower().split() + [0]
    train = [words(t) for i, t in small if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = Counter(w for t in train for w in t)
    n, v = sum(seen.values()), len(seen)
    counts = {order: Counter()}
    for t in train:
        s = ["S"] * (order - 1) + t
        counts[order].update(tuple(s[k - order + 1 : k + 1]) for k in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: kneser_ney.discounts([sum(x == c for x in counts[k].values()) for c in (1, 2, 3, 4)]) for k in counts}
    total = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            total[k][g[:-1]][0] += c
            total[k][g[:-1]][min(c, 3)] += 1

    def probability(context, w):
        p = 1 / (v + 1)
        for k in range(1, order + 1):
            c = tuple(context[len(context) - k + 1 :])
            if c in total[k]:
                z, x = total[k][c], counts[k].get((*c, w), 0)
                p = (x - d[k][min(x, 3)]) / z[0] + (d[k][1] * z[1] + d[k][2] * z[2] + d[k][3] * z[3]) / z[0] * p
        return p

    for i, t in small:
        context, score, base = ["S"] * (order - 1), 0.0, 0.0
        for w in words(t):
            score += math.log10(probability(context, w))
            base += math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1)))
            context = [*context, w][1:]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words(t)), sum(w in seen for w in words(t)), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    everything = sum(probability(["S"] * (order - 2) + [b"same"], w) for w in [*seen, "never"])
    assert everything == pytest.approx(1)
    assert kneser_ney.score_documents(spark, empty, training, order).count() == 0


def test_registered_model_has_order_3(spark, sf):
    from quillgraph.llm.queries import QUERIES

    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = by_id(QUERIES["op1_kneser_ney"](spark, sf))
    want = by_id(kneser_ney.score_documents(spark, spark.read.parquet(f"{sf}/documents.parquet"), training, 3))
    assert got.keys() == want.keys() and all(got[i].score == pytest.approx(want[i].score) for i in want)


def test_words_of_any_rank_are_counted_once(spark, monkeypatch):
    """More passes than one, all words hot or none: the same scores."""
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(300))) for i in range(20)], "doc_id long, text string")
    found = []
    for rounds, hot in ((1, 4), (3, 4), (2, 1000), (2, 0)):
        monkeypatch.setattr(kneser_ney, "ROUNDS", rounds)
        monkeypatch.setattr(kneser_ney, "HOT_WORDS", hot)
        found.append(by_id(kneser_ney.score_documents(spark, rows, F.col("doc_id") % 4 > 0, 4)))
    for other in found[1:]:
        assert all(other[i].score == pytest.approx(found[0][i].score) for i in range(20))


def test_decontaminate(spark, empty):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(40)) for k in range(8)] + [(8, None), (9, ""), (10, "tiny"), (11, text(6))]
    items.append((12, items[0][1]))
    clean = [text(200) for _ in range(20)]
    docs, want = [(k, t) for k, t in enumerate(clean)], {k: set() for k in range(20)}
    for k, (item, t) in enumerate(items[:8]):
        same = {0, 12} if item == 0 else {item}
        planted = [t, t.upper().replace(" ", ",  "), t[:150], t.replace("a", "z", 3)]
        for j, p in enumerate(planted):
            docs.append((100 + 10 * k + j, f"{clean[k]}\n{p} {clean[k + 1]}"))
            want[100 + 10 * k + j] = same
        docs.append((1000 + k, clean[k] + t[:60]))  # too short a part
        want[1000 + k] = set()
    docs += [(2000, None), (2001, ""), (2002, items[11][1] + " and more"), (2003, text(30000) + items[3][1])]
    want |= {2000: set(), 2001: set(), 2002: {11}, 2003: {3}}
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    got = by_id(dec.decontaminate(spark, df, bench))
    assert {k: set(x.items) for k, x in got.items()} == want
    assert all(x.contaminated == bool(want[k]) and x.n_items == len(want[k]) for k, x in got.items())
    assert dec.decontaminate(spark, empty, bench).count() == 0
    assert dec.decontaminate(spark, df, bench.limit(0)).where("contaminated").count() == 0


def test_passage_that_aligns_at_one_start_only(spark):
    rng = np.random.default_rng(5)
    item = "".join(rng.choice(list("abcdefghijklmnopqrstuvw"), 200))
    for start in (49, 50, 51):
        passage = list(item[start : start + 100])
        for k in (1, 15, 30, 45, 60, 75):
            passage[k] = "z"
        text = "1 2 3 4 5 6 7 8 " * 20
        docs = spark.createDataFrame([(1, text + "".join(passage) + text), (2, text + "".join(passage[:40]) + "z" + "".join(passage[41:]) + text)], "doc_id long, text string")
        found = by_id(dec.decontaminate(spark, docs, spark.createDataFrame([(7, item)], "item_id long, text string")))
        assert (found[1].items, found[2].items) == ([7], [])


def test_decontaminate_in_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(6)]
    df = spark.createDataFrame([(k, f"before {t} after") for k, t in items] + [(99, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dec, "INDEX_BYTES", 300)
    got = by_id(dec.decontaminate(spark, df, bench))
    assert {k: list(x.items) for k, x in got.items()} == {**{k: [k] for k, _ in items}, 99: []}


def normal(text):
    import re

    return re.sub(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", b" ", (text or "").encode().lower()).lstrip(b" ")


def sellers(p, t):
    """Least edits between p and a stretch of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def holds(item, text, length, rate, near=None):
    """Whether a stretch of the item aligns within the budget, by full alignment of every start."""
    item, text = normal(item).rstrip(b" ") if near is None else normal(item), normal(text)
    w = min(len(item), length)
    e = int(w * rate + 1e-9)
    return w >= dec.Q and any(sellers(item[s : s + w], text) <= e for s in (range(len(item) - w + 1) if near is None else near))


@pytest.mark.parametrize("length", [40, 100])
def test_decontaminate_finds_all_at_the_budget(spark, length):
    """Random edits around the budget, at the ends too; brute force tries every start of every item."""
    r = random.Random(length)
    letters = "abcdefghijklmnopqrst"
    rate = 0.06
    items = ["".join(r.choice(letters) for _ in range(3 * length)) for _ in range(5)]
    docs, want = [], []
    for k in range(120):
        t = r.randrange(5)
        start = r.randrange(2 * length)
        p = list(items[t][start : start + length])
        budget = int(length * rate)
        for q in range(budget + r.choice([-1, 0, 0, 2, 3, 4])):
            at = r.choice([r.randrange(len(p)), r.randrange(4), len(p) - 1 - r.randrange(4)])
            edit = r.randrange(3)
            p[at : at + (edit != 1)] = [] if edit == 2 else [r.choice("uvwxyz")]
        docs.append("0123456789" * r.randint(0, 3) + "".join(p) + "9876543210" * r.randint(0, 2))
        near = range(max(0, start - 8), min(2 * length, start + 8) + 1)
        want.append(holds(items[t], docs[-1], length, rate, near))
    assert 30 < sum(want) < 110
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = by_id(dec.decontaminate(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench, length, rate))
    assert [got[k].contaminated for k in range(len(docs))] == want


def test_short_items_have_their_whole_budget(spark):
    """Every length from 12 to 120, edits spread evenly, exactly at the budget and one beyond it."""
    r = random.Random(9)
    items, docs, want = [], [], []
    for n in range(12, 121):
        item = "".join(r.choice("abcdefghijklmnopqrst") for _ in range(n))
        items.append((n, item))
        w = min(n, 100)
        for more in (0, 1):
            p, e = list(item[:w]), int(w * 0.06 + 1e-9) + more
            for k in range(e):
                p[(k + 1) * w // (e + 1) - (more == 0 and k % 2)] = "z"
            docs.append(f"0 1 2 3 4 5 6 {'9' * 40}{''.join(p)}{'8' * 40} 7 6 5 4")
            want.append(holds(item, docs[-1], 100, 0.06))
    assert all(want[::2]) and not any(want[1::2])
    got = by_id(dec.decontaminate(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert [got[k].contaminated for k in range(len(docs))] == want


def test_random_short_items(spark):
    """Items of few letters share many grams; brute force over all pairs."""
    r = random.Random(10)
    items = [(k, "".join(r.choice("ab c") for _ in range(r.randint(8, 70)))) for k in range(40)]
    docs = [(k, "".join(r.choice("abc ") for _ in range(r.randint(0, 150)))) for k in range(60)]
    for k, (_, t) in enumerate(items):
        p = list(t)
        for _ in range(r.randint(0, 4)):
            p[r.randrange(len(p))] = r.choice(["", "a", "x", "bb"])
        docs.append((100 + k, docs[k][1] + "".join(p) + "cab" * r.randint(0, 5)))
    got = by_id(dec.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 40, 0.08))
    kept = [(k, normal(t)) for k, t in items]
    want = {d: [k for k, t in kept if holds_normal(t, normal(x), 40, 0.08)] for d, x in docs}
    assert {d: list(got[d].items) for d in want} == want and sum(map(len, want.values())) > 15


def holds_normal(item, text, length, rate):
    w = min(len(item), length)
    return w >= dec.Q and any(sellers(item[s : s + w], text) <= int(w * rate + 1e-9) for s in range(len(item) - w + 1))


def test_repetitive_texts(spark, monkeypatch):
    """One letter over and over: bounded runs, equal stretches tried once."""
    items = [(1, "a" * 300), (2, "ab" * 4000), (3, "a" * 50 + "".join(chr(98 + k % 20) for k in range(60))), (4, "a" * 20_000 + "b" * 100)]
    docs = [(1, "a" * 200_000), (2, "ab" * 20_000), (3, "b" * 500 + "a" * 93), (4, "b" * 500 + "a" * 94), (5, "xy" * 200_000), (6, "a" * 150 + "b" * 94 + "a" * 10)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {k: list(x.items) for k, x in by_id(dec.decontaminate(spark, frame, bench)).items()}
    assert got == {1: [1, 4], 2: [2], 3: [4], 4: [1, 4], 5: [], 6: [1, 4]}
    monkeypatch.setattr(dec, "HITS", 50)
    some = frame.where("doc_id in (3, 4, 6)")
    assert {k: list(x.items) for k, x in by_id(dec.decontaminate(spark, some, bench)).items()} == {k: got[k] for k in (3, 4, 6)}


def test_decontaminate_rows_of_one_id(spark, monkeypatch):
    """Each row has its own result, in one block and in several; null ids too."""
    items = [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(4)]
    rows = [(5, "clean"), (5, f"{items[1][1]} {items[2][1]}"), (None, "clean"), (None, items[0][1]), (7, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [("5", 0), ("5", 2), ("7", 0), ("None", 0), ("None", 1)]
    assert sorted((str(r.doc_id), r.n_items) for r in dec.decontaminate(spark, df, bench).collect()) == want
    monkeypatch.setattr(dec, "INDEX_BYTES", 300)
    assert sorted((str(r.doc_id), r.n_items) for r in dec.decontaminate(spark, df, bench).collect()) == want


def plain_spans(text):
    """The base spans as the contract states them, in the plainest way."""
    import re

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t, d: all(int(p) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t, d: 14 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t, d: 10 <= len(d) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m[0], re.sub("[^0-9]", "", m[0]))]
    return [(name, s, e) for s, _, e, name in sorted(found)]


def test_pii_base_matches_the_patterns():
    r = random.Random(8)
    fixed = ["4111 1111 1111 1111", "10.20.30.40.50.60.70.80", "0001.2.3.255 256.1.1.1", "a@b.c@d.e.f", "+1 (269) 555-3271 +49", "a%b+c@x-y.z..w", "1.2.3.4@5.6"]
    for k in range(4000):
        t = fixed[k] if k < len(fixed) else "".join(r.choice("ab.@-%+ 0123456789()é\n") for _ in range(r.randint(0, 60)))
        if k % 3 == 0:
            t += " " + "".join(r.choice("01259 -") for _ in range(r.randint(10, 30)))
        assert pii.detect(t) == plain_spans(t)


@pytest.mark.parametrize(
    "text",
    ["1" * 200_000, "é" + " " * 200_000, "é" + "a" * 200_000, "é" + "a dot " * 33_000, "é x at " + "dot " * 50_000, "é x at " + "a dot " * 33_000 + "z", "é" + "[ " * 100_000, "é" + "1 " * 100_000, "é+1" + "(" * 200_000, "é" + "1." * 100_000]
    + ["é" + "a@" * 100_000, "é" + "joe at example dot com " * 9_000, "plus one " * 22_000, "é" + "x at " * 40_000, "é" + "a" + " " * 100_000 + "at" + " " * 100_000],
)
def test_pii_takes_linear_time(text):
    import time

    began = time.process_time()
    base = pii.detect(text)
    pii.added(text, base)
    assert time.process_time() - began < 6


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("é john dot smith at mail dot example dot com.", "email", "john dot smith at mail dot example dot com"),
        ("ｊｏｈｎ@ехample.com", "email", "ｊｏｈｎ@ехample.com"),
        ("call plus four one five five five five two six seven one ok", "phone", "plus four one five five five five two six seven one"),
        ("net 45 dot 196 dot 222 dot 2 up", "ip", "45 dot 196 dot 222 dot 2"),
        ("4111​1111 1111 1111", "card", "4111​1111 1111 1111"),
        ("look at the dot there", None, None),
        ("one two three go at it", None, None),
    ],
)
def test_pii_disguises_map_back(text, kind, found):
    new = pii.added(text, pii.detect(text))
    assert [(k, text[s:e]) for k, s, e in new] == ([(kind, found)] if kind else [])


@pytest.mark.parametrize(
    "text",
    ["joe [ at ] example.com", "joe [ @ ] example.com", "joe@example [ . ] com", "joe (\tAT\n) example.com", "joe@ex[ dot ]ample.com", "joe@exſample.com", "joe@exıample.com", "joe@exĳample.com", "10.1.2[ . ]3", "plus ZÉRO UN DEUX TROIS quatre cinq sept huit neuf un", "joe\x1cat\x1cexample\x1cdot\x1ccom"],
)
def test_pii_gate_lets_all_disguises_pass(spark, text):
    new = pii.added(text, pii.detect(text))
    assert new
    r = pii.find_pii(spark, spark.createDataFrame([(1, "nothing here"), (2, text)], "doc_id long, text string")).where("doc_id = 2").first()
    assert r.n_added == len(new)


def test_pii_rows(spark, docs, rows, empty):
    extra = spark.createDataFrame([(900, "a@b.co 1.2.3.4 999.1.1.1 +1 (269) 555-3271; 4111 1111 1111 1111", "x", "y", 1, 0.0, 1, 1, b"", "", 1)], SCHEMA)
    got = by_id(pii.find_pii(spark, docs.unionByName(extra)))
    assert set(got) == {i for i, _ in rows} | {900}
    r = got[900]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (1, 1, 1, 1, 0)
    assert r.base_sha256 == sha(r.spans.encode()) and r.spans.startswith("email:0:6,ip:7:14")
    assert all(got[i].spans == "" and got[i].base_sha256 == sha(b"") for i, t in rows if not t)
    assert pii.find_pii(spark, empty).count() == 0


def labelled(spark, mark, n=400):
    r = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    data, labels = [], []
    for i in range(n):
        bad = i % 7 == 0
        t = " ".join(r.choice(words) for _ in range(r.randint(5, 60)))
        data.append((i, f"{t} {mark if bad else ''} {t[:20]}"))
        if i % 2 == 0 or bad:
            labels.append((i, int(not bad), int(bad)))
    data += [(n, None), (n + 1, ""), (n + 2, mark), (n + 3, "w1 " * 30000)]
    return spark.createDataFrame(data, "doc_id long, text string").withColumn("label", F.lit("clash")), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "bad"), [(toxicity, 1), (quality, 0)])
def test_classifiers(spark, operator, bad, empty):
    mark = "vile awful rotten"
    docs, labels = labelled(spark, mark)
    got = by_id(operator(spark, docs, labels))
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    wrong = [i for i in range(400) if got[i].held_out and got[i].predicted != (bad if i % 7 == 0 else 1 - bad)]
    assert len(wrong) <= 2 and got[402].predicted == bad and got[400].score == got[401].score
    assert operator(spark, empty, labels).count() == 0
    assert operator(spark, docs, labels.limit(0)).count() == 404


def test_mixing(spark, docs, rows, empty):
    r = random.Random(9)
    data = [(i, "w " * r.randint(1, 9) + "| " * (9 if i % 5 == 0 else 0), ["en", "fr", None][i % 3], f"s{min(i % 11, 3)}", 5) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("weight", F.lit("clash"))
    target = {"lang": spark.createDataFrame([("en", 2.0), ("fr", 1.0), ("(none)", 1.0), ("xx", 9.0)], "lang string, target double")}
    got = mixing.mix(spark, df, target).collect()
    assert len(got) == 600
    tokens = sum(x.n_tokens for x in got)
    assert all(x.n_tokens == len(d[1].split()) for x, d in zip(sorted(got), data))
    share = defaultdict(float)
    for x in got:
        share[x.lang] += x.n_tokens * x.weight / tokens
        assert 0 <= x.probability <= 1
    assert share["en"] == pytest.approx(0.5, abs=1e-4) and share["(none)"] == pytest.approx(0.25, abs=1e-4)
    seen = sum(x.sampled for x in got) / sum(x.probability for x in got)
    assert 0.8 < seen < 1.2
    assert mixing.mix(spark, empty).count() == 0
    assert mixing.mix(spark, docs).count() == len(rows)


def test_mixing_leaves_out_what_has_no_target(spark):
    rows = [(1, "a b", "en", "s1"), (2, "", "en", "s2"), (3, "", "en", "s1"), (4, "c d", "en", "s2"), (5, None, None, None), (5, "a b", "en", "s1"), (None, "x y", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(spark, df, {"source": spark.createDataFrame([("s1", 1.0), ("s3", 0.0)], "source string, target double")}).collect()
    assert sorted((str(r.doc_id), r.source, r.probability, r.sampled) for r in got) == [
        ("1", "s1", 1.0, True), ("2", "s2", 0.0, False), ("3", "s1", 1.0, True), ("4", "s2", 0.0, False), ("5", "(none)", 0.0, False), ("5", "s1", 1.0, True), ("None", "s1", 1.0, True)
    ]
    assert {r.topic for r in mixing.mix(spark, df).collect()} == {"prose", "empty"}


def test_mixing_draws_by_row(spark):
    """Rows without an id, rows that repeat one and equal rows are drawn each by itself, as often as expected."""
    rows = [(None, f"w{k} x", "fr" if k % 5 == 0 else "en") for k in range(1500)] + [(7, "same text", "en")] * 500 + [(8, f"t {k}", "fr") for k in range(100)]
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, source string").repartition(3)
    share = spark.createDataFrame([("en", 1.0), ("fr", 1.0)], "lang string, target double")
    got = mixing.mix(spark, df, {"lang": share}).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.doc_id, r.lang].append((r.probability, r.sampled))
    assert {k: len(v) for k, v in groups.items()} == {(None, "en"): 1200, (None, "fr"): 300, (7, "en"): 500, (8, "fr"): 100}
    for (p, _), *_ in groups.values():
        assert 0 < p <= 1
    for (_, lang), v in groups.items():
        p = v[0][0]
        kept = sum(x for _, x in v)
        assert (kept == len(v)) if lang == "fr" else 0 < p < 0.5 and abs(kept - p * len(v)) < 4 * math.sqrt(len(v) * p * (1 - p)), (lang, kept, p)
    again = mixing.mix(spark, df, {"lang": share}, carry=True)
    assert sum(r.sampled for r in again.collect()) == sum(r.sampled for r in got)
    assert again.select("row.*").columns == df.columns


def test_last_stage_keeps_all_columns(spark, sf):
    """Any columns pass through, those with the operator's names as they are, and none is needed but id, text, lang and source."""
    import corpus_pipeline

    rows = [(k, f"text {k} of it", "en", "s", f"u{k}", 10 + k, "Kept", -1.5) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, topic int, Weight string, probability double")
    out = corpus_pipeline.mix_sources(spark, df, sf)
    assert out.columns == [*df.columns, "mixing_topic", "n_tokens", "mixing_weight", "mixing_probability"]
    assert [tuple(r)[:8] for r in out.orderBy("doc_id").collect()] == rows


def test_raking_matches_brute_force(spark):
    r = random.Random(10)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): r.randint(1, 500) for a in range(4) for b in range(3) for c in range(2) if r.random() < 0.9}
    df = spark.createDataFrame([(i, "w " * n, l, s, t) for i, ((s, l, t), n) in enumerate(cells.items())], "doc_id long, text string, lang string, source string, topic string")
    table = df.select("source", "lang", "topic", mixing.n_tokens(F.col("text")).alias("tokens"))
    from quillgraph.llm.shared import Workspace

    targets = {m: mixing.tempered(table, m, 0.5) for m in mixing.MARGINS}
    got = {(x.source, x.lang, x.topic): x.share for x in mixing.rake(table, targets, Workspace(spark, "t")).collect()}
    now = {k: float(v) for k, v in cells.items()}
    goal = []
    for m in range(3):
        t = defaultdict(float)
        for k, v in cells.items():
            t[k[m]] += v
        z = sum(x**0.5 for x in t.values())
        goal.append({k: x**0.5 / z for k, x in t.items()})
    for _ in range(200):
        for m in range(3):
            t = defaultdict(float)
            for k, v in now.items():
                t[k[m]] += v
            now = {k: v * goal[m][k[m]] / t[k[m]] for k, v in now.items()}
    assert got == pytest.approx(now, abs=1e-5)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf)
        assert docs.columns == names, name
        assert 0 < docs.count() <= before
        before = docs.count()
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)


def test_words_without_a_common_letter_order_differ(spark):
    """Words that a polynomial hash modulo a power of two takes for equal, whatever its base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, " ".join([word] * 20)), (4, " ".join([other] * 20))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(spark, df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert all(r.n_removed == 0 for r in substring_dedup(spark, df).collect())
    got = by_id(kneser_ney.score_documents(spark, df, F.col("doc_id") == 1, 2))
    assert (got[2].n_known, got[2].train_tokens) == (1, 2)


class HeldSets:
    def __init__(self, sets):
        self.sets = {c: np.sort(np.array(sorted(s), np.uint64)) for c, s in sets.items()}

    def load(self, classes):
        found = [self.sets[int(c)] for c in classes]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


@pytest.mark.parametrize("small", [0, 1000])
def test_lists_are_settled_in_place(monkeypatch, small):
    """Members of one list: the components of the links that brute force finds, in one block and in two."""
    from quillgraph.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "SMALL", small)
    r = random.Random(small)
    base = list(range(100, 180))
    sets = {}
    for c in range(1, 151):
        mine = set(r.sample(base, r.randint(60, 80))) | {r.randrange(1000, 1040) for _ in range(r.randint(0, 9))} | {1}
        sets[c] = mine
    classes = np.array(sorted(sets), np.uint64)
    n = np.array([len(sets[int(c)]) for c in classes], np.uint32)

    def components_of(sides):
        parent = {c: c for c in sets}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sides[a - 1] in (0, 3 - sides[b - 1]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
        return {c: root(c) for c in sets}

    for side in (np.zeros(150, np.uint8), np.repeat(np.array([1, 2], np.uint8), [60, 90])):
        a, b = jj.unit_links([np.full(150, 7, np.uint64), classes, n, n, classes, side], HeldSets(sets), 75, 100)
        got = {c: c for c in sets}
        for x, y in zip(a.tolist(), b.tolist()):
            got[x] = y
        assert got == components_of(side)
        assert 2 < len(set(got.values())) < 140 and len(a) < 150


def test_jaccard_of_many_near_copies(spark):
    """A large group whose members link to few others: neither lost nor joined."""
    r = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for p in r.sample(range(120), r.randint(1, 4)):
            w[p] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    _, component = brute_components(rows)
    got = by_id(jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {i: got[i].component_id for i, _ in rows} == component
    assert 20 < len(set(component.values())) < 680


def random_samples(seed, n=60, dims=12):
    from quillgraph.llm.features import Samples

    r = np.random.default_rng(seed)
    rows = [np.flatnonzero(r.random(dims) < 0.3) for _ in range(n)]
    label = (r.random(n) < 0.4).astype(np.int64)
    names = np.arange(100, 100 + dims, dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    return Samples(label, first, names[np.concatenate(rows)]), rows, label


def test_prior_speaks_of_the_rows_that_are_left():
    """Half of the positives and a fifth of the unlabelled text are copies: the share among the others."""
    from quillgraph.llm.toxicity import prior_of_kept

    before, after = np.array([1] * 100 + [0] * 1000), np.array([1] * 50 + [0] * 800)
    assert prior_of_kept(0.1, before, after) == pytest.approx(50 / 800)
    assert prior_of_kept(0.1, before, before) == pytest.approx(0.1)
    assert prior_of_kept(0.1, before[:0], before[:0]) == 0.1


@pytest.mark.parametrize("prior", [0.05, 0.9])
def test_nnpu_slope_is_the_risks(prior):
    """The slope against differences of the risk as it is written, on both sides of the correction."""
    from quillgraph.llm.toxicity import Risk

    samples, rows, label = random_samples(1)
    r = np.random.default_rng(2)
    value = r.random(12) + 0.5
    risk = Risk(samples.first, (samples.feature - 100).astype(np.int64), value, label == 1, prior, 0.01)
    sides = set()
    for _ in range(20):
        w = r.normal(0, 2, 13)

        def parts(w):
            g = [sum(w[j] * value[j] for j in x) + w[-1] for x in rows]
            s = [1 / (1 + math.exp(-x)) for x in g]
            pos, unl = [x for x, y in zip(s, label) if y], [x for x, y in zip(s, label) if not y]
            return prior * np.mean([1 - x for x in pos]), np.mean(unl) - prior * np.mean(pos)

        def objective(w, negative):
            a, b = parts(w)
            return (-b if negative else a + b) + 0.005 * (w[:-1] ** 2).sum()

        a, b = parts(w)
        assert risk.terms(w) == pytest.approx((a, b))
        sides.add(b < 0)
        want = [(objective(w + 1e-5 * e, b < 0) - objective(w - 1e-5 * e, b < 0)) / 2e-5 for e in np.eye(13)]
        assert risk.slope(w) == pytest.approx(want, abs=1e-6)
    assert (True in sides) if prior == 0.9 else (False in sides)


def test_log_count_ratios_and_dual_descent_match_plain_versions():
    from quillgraph.llm import quality as q

    samples, rows, label = random_samples(5)
    hashes, ratio = q.log_count_ratios(samples, label == 1, 100, 1.0, 3)
    p, n = label.sum(), (1 - label).sum()
    want = {}
    for j in range(12):
        a = sum(1 for x, y in zip(rows, label) if y and j in x)
        b = sum(1 for x, y in zip(rows, label) if not y and j in x)
        if a + b >= 3:
            want[100 + j] = math.log((a + 1) / (p + 2)) - math.log((b + 1) / (n + 2))
    assert dict(zip(hashes.tolist(), ratio)) == pytest.approx(want)
    assert set(q.log_count_ratios(samples, label == 1, 4, 1.0, 3)[0].tolist()) <= set(want)

    # the dual's optimum by long projected gradient descent on its box
    x = np.zeros((60, 13))
    for i, f in enumerate(rows):
        x[i, f] = [want.get(100 + j, 0.0) for j in f]
    x[:, -1] = 1
    y = np.where(label == 1, 1.0, -1.0)
    kernel = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(kernel).max()
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (kernel @ alpha - 1), 0, 0.1)
    value = np.array([want.get(100 + j, 0.0) for j in range(12)])
    w = q.dual_descent(samples.first, (samples.feature - 100).astype(np.int64), value[(samples.feature - 100).astype(np.int64)], y, 12, 0.1, 2000)
    primal = lambda w: 0.5 * w @ w + 0.1 * np.maximum(0, 1 - y * (x @ w)).sum()
    assert primal(w) == pytest.approx(primal((alpha * y) @ x), rel=1e-3)


@pytest.mark.parametrize(("operator", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_with_repeated_and_null_ids(spark, operator, column):
    docs, labels = labelled(spark, "vile awful rotten")
    more = spark.createDataFrame([(None, "vile awful rotten", "clash"), (None, None, "x"), (7, "another text", "y"), (7, "another text", "y")], "doc_id long, text string, label string")
    got = operator(spark, docs.unionByName(more), labels.unionByName(labels)).collect()
    assert len(got) == 408 and sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 7 for r in got) == 3
    assert all(r.predicted == int(r.score >= (0.5 if operator is toxicity else 0.3)) for r in got)


def test_words_with_one_hash_stay_apart():
    from quillgraph.llm import substring_dedup as sd
    from quillgraph.llm.repeats import same_slices, settled

    text = b"ab cd ab cd ef "
    data = np.frombuffer(text, np.uint8)

    class T(list):
        start, end = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
        hash = np.array([1, 1, 1, 1, 2], np.uint64)

    name = sd.word_names(T([0] * 5), data)
    assert name[0] == name[2] and name[1] == name[3] and len(set(name.tolist())) == 3
    assert same_slices(data, np.array([0, 0, 3]), np.array([6, 3, 9]), np.array([5, 2, 2]), step=3).tolist() == [True, False, True]
    one = np.zeros(5, np.int64)
    head, later = settled(data, T.start, np.full(5, 2), one, np.arange(5), one)
    assert sorted(head.tolist()) == [0, 1, 4] and sorted(later.tolist()) == [2, 3]


def table_dir(spark, folder, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Every stage against a plain version: nulls, repeated ids and rows, empty and long texts, clashing columns."""
    import corpus_pipeline as cp

    docs, labels = labelled(spark, "vile awful rotten")
    items = [(k, " ".join(f"item{k}word{j}" for j in range(9))) for k in range(3)]
    r = random.Random(21)
    base = [" ".join(f"v{r.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    near = [b.rsplit(" ", 2)[0] + " other end" for b in base]
    long = " ".join(f"long{j}" for j in range(40000))
    more = [(1000 + k, t) for k, t in enumerate(base)] + [(900 + k, t) for k, t in enumerate(near)] + [(None, base[0]), (None, "vile awful rotten"), (None, None), (2000, "same"), (2000, "same"), (2000, "other same id"), (2001, ""), (2002, long), (1500, long + " end"), (2003, f"x {items[1][1]} y"), (None, items[2][1]), (2004, items[0][1][:30])]
    names = ["doc_id", "text", "lang", "source", "n_chars", "row", "id", "digest", "one", "component", "items"]
    given = spark.createDataFrame([(r.doc_id, r.text) for r in docs.collect()] + more, "doc_id long, text string")
    given = given.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit("r").alias("row"), F.lit(7).cast("long").alias("id"), F.lit("d").alias("digest"), F.lit(1).alias("one"), F.lit(2).cast("long").alias("component"), F.lit("i").alias("items"))
    assert given.columns == names
    sf_dir = table_dir(spark, tmp_path, given, labels, spark.createDataFrame(items, "item_id long, text string"))
    rows = lambda df: Counter((x.doc_id, x.text) for x in df.collect())

    now, docs = rows(given), given
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        before, docs = now, spark.createDataFrame(out.collect(), out.schema)
        now = rows(docs)
        assert not now - before
        if k < 4:
            assert docs.columns == names
        if k == 0:
            gone = before - now
            assert all("vile awful rotten" in (t or "") for _, t in gone) and sum(gone.values()) > 50
            assert not any("vile awful rotten" in (t or "") for _, t in now)
        elif k == 1:
            best = {}
            for i, t in before:
                key = t or ""
                best[key] = max(best.get(key, -1), -1 if i is None else i)
            assert Counter({((None if i == -1 else i), key): 1 for key, i in best.items()}) == Counter({(i, t or ""): n for (i, t), n in now.items()})
        elif k == 2:
            listed = sorted(before.elements(), key=lambda x: (-1 if x[0] is None else x[0], sha((x[1] or "").encode())))
            sets, component = brute_components([(n, t) for n, (_, t) in enumerate(listed)])
            want = [listed[n] for n in range(len(listed)) if component[n] == n]
            assert Counter(want) == now and len(want) < len(listed)
        elif k == 3:
            want = {x for x in before if "item" not in (x[1] or "") or not any(holds(t, x[1], 100, 0.06) for _, t in items)}
            assert set(now) == want and len(want) == len(before) - 2  # what shares no q-gram holds nothing
        else:
            assert 0 < len(now) <= len(before) and {"weight", "probability", "topic", "n_tokens"} <= set(docs.columns)
    empty = given.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0


@pytest.mark.parametrize(
    "operator",
    [substring_dedup, suffix_dedup, jaccard_components, pii.find_pii, exact_dedup, lambda s, d: kneser_ney.score_documents(s, d, F.col("doc_id") != 9, 3), lambda s, d: dec.decontaminate(s, d, d.limit(0).withColumnRenamed("doc_id", "item_id"))],
    ids=["op7", "op5", "op6", "op10", "op4", "op1", "op2"],
)
def test_one_row_for_each_row(spark, operator):
    """Null ids, repeated ids and repeated rows: as many rows out as in, equal ones alike."""
    rows = [(None, "a b"), (None, "a b"), (None, None), (5, "x y z"), (5, "x y z"), (5, "other"), (9, ""), (9, "")]
    got = operator(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
