"""Near duplicates, embeddings, decontamination and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import helpers
from verdex.llm import components, decontam, embeddedup, minhash, queries


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def some_docs(seed=2):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 160))] for _ in range(25)]
    shared = " ".join(f"s{i}" for i in range(40))
    docs = []
    for words in base:
        for _ in range(rng.randint(1, 6)):
            docs.append(edited(words, rng.choice([0, 0, 1, 2, 3, 6]), rng) + (" " + shared if rng.random() < 0.3 else ""))
    docs += ["a b c", "A  b\nc", "a b c d", "", None, " \t ", "x", "x"]
    # A chain whose ends are not similar themselves.
    words = [f"c{i}" for i in range(100)]
    for _ in range(8):
        docs.append(" ".join(words))
        words = words[4:] + [f"d{rng.randrange(10**6)}" for _ in range(4)]
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


@pytest.mark.parametrize("pair_members, block", [(32, 512), (0, 5)])
def test_minhash_equals_all_pairs(spark, monkeypatch, pair_members, block):
    monkeypatch.setattr(minhash, "PAIR_MEMBERS", pair_members)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", block)
    docs = some_docs()
    frame = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, kept string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame, shingle=4).collect()}
    assert got == helpers.near_duplicates(docs)


def test_minhash_large_near_group(spark, monkeypatch):
    """A hub that some members do not reach on their own: links between members count."""
    monkeypatch.setattr(minhash, "PAIR_MEMBERS", 4)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, edited(base, rng.randint(0, 9), rng)) for i in range(90)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == helpers.near_duplicates(docs)


def test_minhash_edges(spark):
    rows = [(1, "p q r s t u"), (1, "other words stand here now"), (2, "p q r s t u"), (3, "other words stand here now"), (None, "p q r s t u"), (None, None), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame).collect()), key=repr)
    # The two texts of document 1 tie 2 and 3 together.
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, None, None), (None, 0, None, None), (4, 0, 4, True)], key=repr)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_signature_agreement_is_the_similarity():
    signer, rng = minhash.Signer(4, 200, 6), np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        agree = (signer.values(a) == signer.values(b)).mean()
    assert agree == pytest.approx(800 / 1200, abs=0.05)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    groups = helpers.Union()
    for a, b in links:
        if a is not None and a != b:
            groups.join(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: groups.find(x) for x in groups.parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for size, noise in [(30, 0.02), (12, 0.035), (5, 0.04), (1, 0), (1, 0)] * 2:
        centre = rng.normal(size=24)
        rows += [(centre + noise * np.linalg.norm(centre) * rng.normal(size=24) / 2).tolist() for _ in range(size)]
    rows += [rng.normal(size=24).tolist() for _ in range(150)]
    rows += [rows[0], [2 * x for x in rows[0]], [-x for x in rows[0]], None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [1.0, 2.0], [1e300] * 24, [1e-300] * 24]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [512, 7])
def test_embeddings_equal_all_cosines(spark, monkeypatch, block):
    monkeypatch.setattr(embeddedup, "BLOCK_ROWS", block)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddedup.near_duplicates(frame).collect()}
    scaled = [(i, [x / 1e300 for x in v] if v and v[0] == 1e300 else [x * 1e300 for x in v] if v and v[0] == 1e-300 else v) for i, v in rows]
    assert got == helpers.near_vectors(scaled)


def test_many_cells_miss_nearly_nothing(spark, monkeypatch):
    """Several projections a cell, and pairs that lie just above the threshold."""
    monkeypatch.setattr(embeddedup, "CELL_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(1500, 32))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    side = rng.normal(size=rows.shape)
    side -= (side * rows).sum(axis=1, keepdims=True) * rows
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9502, 0.96, size=(1500, 1))
    rows = np.concatenate([rows, cosine * rows + np.sqrt(1 - cosine**2) * side])
    assert embeddedup.plan(3000, 0.95).per_table > 3
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddedup.near_duplicates(frame).collect()}
    near = rows @ rows.T >= 0.95
    truth = near.sum(axis=1) - 1
    assert sum(got.values()) >= 0.999 * truth.sum() and all(got[i] <= n for i, n in enumerate(truth)) and truth.sum() >= 3000


def test_forest_and_first_met():
    rng = np.random.default_rng(4)
    for _ in range(30):
        near = rng.random((20, 20)) < 0.06
        near = near | near.T
        np.fill_diagonal(near, False)
        every, label, groups = np.arange(20), np.arange(20), helpers.Union()
        embeddedup.forest(near, every, every, label)
        for a, b in zip(*np.nonzero(near)):
            groups.join(int(a), int(b))
        assert label.tolist() == [groups.find(i) for i in range(20)]
        keys = rng.integers(0, 6, (20, 5))
        for some in (near, rng.random((20, 20)) < 0.7):
            met = embeddedup.first_met(keys, every, every, some, 3)
            assert (met == (some & ~(keys[:, None, :3] == keys[None, :, :3]).any(axis=2))).all()


def test_embedding_edges(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.01]), (2, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddedup.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, None), (2, 0, 2, True)], key=repr)
    assert embeddedup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n, m", [(30, 40), (1, 1), (600, 500), (0, 3), (3, 0)])
def test_collisions_are_window_members(n, m):
    rng = np.random.default_rng(0)
    left, right = rng.integers(-300, 300, (n, 9)), rng.integers(-300, 300, (m, 9))
    right[: m // 2] = left[: m // 2][: len(right[: m // 2])] if n >= m // 2 else right[: m // 2]
    expected = (np.abs(left[:, None, :] - right[None, :, :]) <= 40).sum(axis=2)
    assert (embeddedup.collisions(left, right, 40) == expected).all()


def test_plan_reaches_its_recall():
    for n in (100, 10_000, 10**9):
        how = embeddedup.plan(n, 0.95)
        near = embeddedup.same_cell(how.distance, embeddedup.CELL_WIDTH * how.distance)
        assert 1 - (1 - near**how.per_table) ** how.tables >= embeddedup.RECALL and how.count > 8


WORDS = re.compile(r"\w+")


def brute_matches(docs, items, k=5):
    out = {}
    for d, text in docs:
        words = WORDS.findall((text or "").lower())
        for i, item in items:
            want = WORDS.findall((item or "").lower())
            if not want:
                continue
            kk, best = min(k, len(want)), 0.0
            bag = Counter(tuple(want[j : j + kk]) for j in range(len(want) - kk + 1))
            width = min(len(want), len(words))
            for a in range(len(words) - width + 1 if words else 0):
                got = Counter(tuple(words[a + j : a + j + kk]) for j in range(width - kk + 1))
                both = (bag & got).total()
                best = max(best, both / (bag.total() + got.total() - both) if both else 0)
            if best >= 0.8:
                out[(d, i)] = round(best, 9)
    return out


def planted(seed=6):
    rng = random.Random(seed)
    filler = lambda n: " ".join(f"f{rng.randrange(400)}" for _ in range(n))
    items = [(i, " ".join(f"b{rng.randrange(300)}" for _ in range(rng.choice([2, 4, 5, 30, 60, 61, 90])))) for i in range(30)] + [(40, "x y " * 20), (41, None), (42, "!!")]
    docs = []
    for n in range(60):
        item = rng.choice(items[:31])[1].split()
        if n % 3 == 0:
            item = edited(item, 1, rng).split() if len(item) > 40 else item
        passage = " ".join(item).upper() if n % 4 == 0 else ", ".join(item)
        docs.append((n, f"{filler(rng.randint(0, 80))}\n{passage} {filler(rng.randint(0, 80))}" if n % 5 else filler(120)))
    return docs + [(90, None), (91, ""), (92, items[5][1]), (92, items[5][1]), (93, " ".join(items[6][1].split()[:-3]))], items


@pytest.mark.parametrize("sent_words", [1_000_000, 60])
def test_decontamination_equals_brute_force(spark, sent_words):
    """By either way: the benchmark goes to the workers, or is joined as a table."""
    docs, items = planted()
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, matches int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.matches(frame, bench, sent_words=sent_words).collect()
    assert len(rows) == len(docs)
    got = {(r["doc_id"], m["item_id"]): round(m["similarity"], 9) for r in rows for m in r["matches"]}
    assert got == brute_matches(docs, items)
    assert [r["matches"] for r in decontam.matches(frame, bench.limit(0)).collect()] == [[]] * len(docs)
    assert decontam.matches(frame.limit(0), bench).count() == 0


def test_passages_before_a_repeated_word_are_found():
    rng = random.Random(8)
    items = [(i, " ".join(f"b{i}x{rng.randrange(9000)}" for _ in range(504))) for i in range(20)]
    docs = [(i, " ".join(text.split()[:449] + ["again"] * 70)) for i, text in items]
    items.append((60, "x y " * 20))
    docs += [(60, "x y " * 100), (61, "x y " * 9 + "z " * 9 + "x y " * 18)]
    got = decontam.Matcher(items, 5, 80)([t for _, t in docs])
    expected = brute_matches(docs, items)
    assert len(expected) >= 20
    assert {(d, m["item_id"]): round(m["similarity"], 9) for (d, _), found in zip(docs, got) for m in found} == expected


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 256, (40, 8)).astype(np.uint8)
    windows = np.concatenate([prints ^ np.packbits(rng.random((40, 64)) < share, axis=1) for share in (0.0, 0.1, 0.2, 0.25, 0.3, 0.5)])
    far = np.array([[int(decontam.COUNT[w ^ p].sum()) for p in prints] for w in windows])
    got = set(zip(*(x.tolist() for x in decontam.near(windows, decontam.block_tables(prints), prints))))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS)))) and len(got) > 100


def test_the_index_decides_what_is_within_the_radius(monkeypatch):
    """Without its tables nearly all matches are lost; without the supplement few are."""
    docs, items = planted()
    texts, held = [t for _, t in docs], [i for i in items if i[1]]
    whole = decontam.Matcher(held, 5, 80)(texts)
    alone = decontam.Matcher(held, 5, 80, supplement=False)(texts)
    monkeypatch.setattr(decontam, "near", lambda *_: (np.zeros(0, int), np.zeros(0, int)))
    without = decontam.Matcher(held, 5, 80)(texts)
    count = lambda found: sum(map(len, found))
    assert count(whole) > 30 and count(without) < 0.2 * count(whole) and count(alone) >= 0.9 * count(whole)


def test_recall_of_the_index_at_the_threshold():
    """Windows cut to a similarity of 0.80 to 0.83: at least nine in ten are found by the tables alone."""
    rng = random.Random(9)
    found = total = 0
    for n in range(300):
        item = [f"b{rng.randrange(5000)}" for _ in range(60)]
        cut = rng.choice([6, 5])  # words replaced at one end
        text = " ".join([f"x{rng.randrange(5000)}" for _ in range(cut)] + item[cut:])
        exact = brute_matches([(0, text)], [(n, " ".join(item))])
        if exact and 0.8 <= exact[0, n] <= 0.83:
            total += 1
            found += bool(decontam.Matcher([(n, " ".join(item))], 5, 80, supplement=False)([text])[0])
    assert total >= 100 and found >= 0.9 * total


def test_many_items_of_one_size():
    """Memory follows the shingles that documents share with items, not windows times items."""
    items = [(i, f"w{i}") for i in range(50_000)]
    got = decontam.Matcher(items, 5, 80)([" ".join(f"w{i} filler" for i in range(0, 50_000, 500)), None, "nothing here"])
    assert [m["item_id"] for m in got[0]] == list(range(0, 50_000, 500)) and got[1:] == [[], []]


def test_queries_on_small_data(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in queries.op7_decontaminate(spark, small).collect()}
    assert got == brute_matches(docs, items) and got
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op6_minhash(spark, small).collect()}
    assert got == helpers.near_duplicates(docs)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op2_embedding_dedup(spark, small).collect()}
    assert got == helpers.near_vectors(rows)
