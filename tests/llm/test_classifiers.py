"""Language, quality and toxicity: held-out accuracy and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from verdex.llm import langid, quality, queries, toxicity
from verdex.llm.common import fold

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(small):
    return DATA


def accuracy(pairs):
    pairs = list(pairs)
    return sum(a == b for a, b in pairs) / len(pairs)


def test_language_query(spark, data):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op1_langid(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    held = [r for r in rows if r["held_out"]]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert accuracy((r["lang_pred"], truth[r["doc_id"]]) for r in held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    model = langid.fit(["the and of the and that " * 20, "der die und das nicht " * 20] * 10, ["en", "de"] * 10)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "123 !?", 0), (4, "und das ist nicht die " * 20_000, 0), (5, "the", 0), (5, "the", 0)], "doc_id long, text string, Score int")
    rows = langid.predict(docs, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "und", "de", "en", "en"] and rows[0]["score"] == 0
    assert langid.predict(docs.limit(0), model).count() == 0
    empty = langid.train(docs.withColumnRenamed("Score", "lang").limit(0), "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


def test_language_windows_are_all_read():
    model = langid.fit(["the and of the and that " * 20, "der die und das nicht " * 20] * 10, ["en", "de"] * 10)
    score = model.scorer()
    mixed = "the and that of the " * 30 + "der die und das nicht " * 300
    (names, _), (alone, p) = score(["x", mixed, "the and"]), score([mixed])
    assert names[1] == alone[0] == "de" and p[0] < 1.0


def brute_language(model, text):
    """Probabilities of a text by sliding every filter over every zero-filled window."""
    data = text.encode()
    total = np.zeros(len(model.languages))
    for at in range(0, len(data), langid.WINDOW):
        window = data[at : at + langid.WINDOW + langid.PAD - 1]
        e = model.embedding[np.frombuffer(window + bytes(langid.WINDOW + langid.PAD - 1 - len(window)), np.uint8)]
        pooled = [np.max([sum(e[i + k] @ w[k] for k in range(len(w))) for i in range(langid.WINDOW)], axis=0) for w in model.filters]
        z = np.maximum(np.concatenate(pooled) + model.offsets, 0) @ model.dense + model.bias
        q = np.exp(z - z.max())
        total += q / q.sum() * min(langid.WINDOW, len(data) - at)
    return total / total.sum()


def test_language_query_equals_brute_force(spark, small):
    """The query on a small table against the network applied by definition, whatever the partitions."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs.where(fold("doc_id", 5) != 0), "text", "lang", "doc_id")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in queries.op1_langid(spark, small).collect()}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (fold("doc_id", 5) == 0).alias("h")).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(texts)
    for i, t in list(sorted(texts.items()))[:25] + [max(texts.items(), key=lambda x: len(x[1] or "") if len(x[1] or "") < 9000 else 0)]:
        if t and langid.LETTER.search(t):
            p = brute_language(model, t)
            assert got[i][0] == model.languages[int(p.argmax())] and got[i][1] == pytest.approx(p.max(), abs=1e-4)
    assert {i: g[2] for i, g in got.items()} == held
    for n in (1, 7):
        again = langid.predict(docs.select("doc_id", "text").repartition(n), model).collect()
        assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in again} == {i: g[:2] for i, g in got.items()}


def test_language_does_not_depend_on_the_batch():
    model = langid.fit(["the and of the and that " * 20, "der die und das nicht " * 20] * 10, ["en", "de"] * 10)
    score = model.scorer()
    texts = ["the", "x" * 255, "y" * 256, "z" * 257, None, "der die das " * 300, "", "and", "é" * 200, "der und"]
    names, p = score(texts)
    alone = [score([t]) for t in texts]
    assert names == [a[0][0] for a in alone] and p == [a[1][0] for a in alone]
    assert score(texts[::-1]) == (names[::-1], p[::-1])


def test_a_very_long_text_is_scored_in_slabs(monkeypatch):
    """The same bits whatever the slab, and little more memory than the text takes."""
    import tracemalloc

    model = langid.fit(["the and of the and that " * 20, "der die und das nicht " * 20] * 10, ["en", "de"] * 10)
    texts = ["the and of " * 9000, "x", "der das " * 400, "é" * 300]
    whole = model.scorer()(texts)
    for slab in (1, 3, 50):
        monkeypatch.setattr(langid, "SLAB", slab)
        assert model.scorer()(texts) == whole
    monkeypatch.setattr(langid, "SLAB", 64)
    score, text = model.scorer(), "der die und das nicht " * 400_000  # 8.8 MB
    tracemalloc.start()
    names, _ = score([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == ["de"] and peak < 6 * len(text)  # 16 float32 a byte and width before


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    model = langid.fit(["ab cd ef " * 9, "xy zw uv " * 9] * 4, ["a", "b"] * 4)
    text = bytes(rng.integers(97, 123, 100).astype(np.uint8))
    names, p = model.scorer()([text.decode()])
    padded = np.frombuffer(text + bytes(langid.WINDOW + langid.PAD - len(text)), np.uint8)
    e = model.embedding[padded]
    pooled = [np.max([sum(e[i + k] @ w[k] for k in range(len(w))) for i in range(langid.WINDOW)], axis=0) for w in model.filters]
    z = np.maximum(np.concatenate(pooled) + model.offsets, 0) @ model.dense + model.bias
    q = np.exp(z - z.max())
    assert p[0] == pytest.approx(float(q.max() / q.sum()), abs=1e-5) and names[0] == model.languages[int(q.argmax())]


@pytest.mark.parametrize("query, label, least", [("op4_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_label_queries(spark, data, query, label, least):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries.QUERIES[query](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert accuracy((r["predicted"], truth[r["doc_id"]]) for r in held) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_edges(spark):
    model = quality.fit(["plain words are here and there"] * 20 + ["junk$$$ more### %%% junk&&&"] * 20, [1] * 20 + [0] * 20)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "$$$ ### %%% " * 50_000, 0), (4, "words are here", 0)], "doc_id long, text string, Predicted int")
    rows = quality.score(docs, model).orderBy("doc_id").collect()
    assert rows[0]["score"] == rows[1]["score"] and rows[2]["predicted"] == 0 and rows[3]["predicted"] == 1
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.fit(["a"], [1])
    assert one.scorer()(["anything"])[0] > 0.7
    assert quality.fit([], []).scorer()([None])[0] == pytest.approx(0.5)


def brute_quality(text, model):
    """The mean weight of a text's hashed uni- and bigrams, counted one by one."""
    words = quality.TOKENS.findall(text or "")
    mask, total = (1 << 64) - 1, 0.0
    hashes = [quality.REPEATED if i and words[i].lower() == words[i - 1].lower() else quality.xxhash.xxh64_intdigest(w) for i, w in enumerate(words)]
    for i, h in enumerate(hashes):
        total += float(model.weights[(h * int(quality.MIX) & mask) >> (64 - model.bits)])
        if i + 1 < len(hashes):
            pair = (h * 0xC2B2AE3D27D4EB4F + hashes[i + 1]) & mask
            total += float(model.weights[(pair * int(quality.MIX) & mask) >> (64 - model.bits)])
    z = model.bias + quality.SCALE * (total / (2 * len(words) - 1) if words else 0.0)
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def test_quality_query_equals_single_products(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.train(queries.labelled(spark, docs, small, "quality", 4, 2), "text", "label", "doc_id")
    got = {r["doc_id"]: r["score"] for r in queries.op4_quality(spark, small).collect()}
    for r in docs.collect():
        if len(r["text"] or "") < 20_000:
            assert got[r["doc_id"]] == pytest.approx(brute_quality(r["text"], model), abs=1e-6)


def test_quality_scores_do_not_depend_on_the_batch():
    model = quality.fit(["good words here"] * 5 + ["bad ### $$$"] * 5, [1] * 5 + [0] * 5)
    texts = ["good good words", None, "### bad", "", "x " * 100]
    assert np.allclose(model.scorer()(texts), [model.scorer()([t])[0] for t in texts])


def brute_segments(scores):
    """Maximal segments by definition: the best one, then those of both sides."""
    n, best = len(scores), (0.0, 0, 0)
    for i in range(n):
        total = 0.0
        for j in range(i, n):
            total += scores[j]
            if total > best[0] + 1e-9:
                best = (total, i, j + 1)
    if best[0] <= 0:
        return []
    s, a, b = best
    return brute_segments(scores[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(5)
    for _ in range(400):
        scores = np.array([rng.choice([-0.7, -0.7, -0.31, 0.53, 2.09, 3.17]) for _ in range(rng.randint(0, 22))])
        got, expected = toxicity.maximal_segments(scores), brute_segments(scores)
        assert [round(s[2], 6) for s in got] == pytest.approx([round(s[2], 6) for s in expected])
        assert [s[:2] for s in got] == [s[:2] for s in expected]


def brute_toxicity(texts, labelled, model):
    """{id: (score, passages)}, from plain counts of all tokens."""
    places, counts = [0, 0], [Counter(), Counter()]

    def tokens(word):
        return [*(word[:k] + "*" for k in toxicity.PREFIXES if len(word) > k), word]

    for text, label in labelled:
        words = set(re.findall(r"\w+", (text or "").lower()))
        places[1 - label] += len(words)
        counts[1 - label].update(t for w in words for t in tokens(w))
    base = places[0] / sum(places)

    def score(word):
        rate, chain = base, [(counts[0][t], counts[1][t]) for t in tokens(word)]
        for (a, b), (c, d) in zip(chain, [*chain[1:], (0, 0)]):
            rate = (a - c + toxicity.PRIOR * rate) / (a - c + b - d + toxicity.PRIOR)
        return math.log(rate / (1 - rate)) - math.log(base / (1 - base)) - toxicity.DRIFT

    out = {}
    for i, text in texts:
        words, last, scores = re.findall(r"\w+", text or ""), {}, []
        for at, word in enumerate(words):
            s = score(word.lower())
            if s > -toxicity.DRIFT:
                s, last[word] = s if at - last.get(word, -toxicity.APART) >= toxicity.APART else -toxicity.DRIFT, at
            scores.append(s)
        found = toxicity.maximal_segments(np.array(scores))
        chance = model.scale * max(len(words), 1)
        gains = [model.decay * s - math.log(chance + 1e-9) for *_, s in found]
        evidence = (sum(g for g in gains if g > 0) or max(gains)) if gains else -math.log(chance + 1.0)
        z = max(-35.0, min(35.0, evidence - model.threshold + math.log(7 / 3)))
        out[i] = 1 / (1 + math.exp(-z)), sorted((a, b - a) for (a, b, _), g in zip(found, gains) if g > 0)
    return out


def test_toxicity_query_equals_plain_counts(spark, small):
    """Scores and passages of a whole small table."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.labelled(spark, docs, small, "toxic", 3, 1)
    model = toxicity.train(rows, "text", "label", "doc_id")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 20_000]
    expected = brute_toxicity(texts, [(r["text"], r["label"]) for r in rows.collect()], model)
    got = {r["doc_id"]: r["score"] for r in queries.op10_toxicity(spark, small).collect()}
    spans = {r["doc_id"]: sorted((p["first_word"], p["n_words"]) for p in r["passages"]) for r in toxicity.score(docs, model).collect()}
    off = [i for i, (s, p) in expected.items() if abs(s - got[i]) > 1e-6 or p != spans[i]]
    assert not off


def table_of(scores):
    """Scores of tokens as workers have them."""
    hashes = np.array([toxicity.xxhash.xxh64_intdigest(t, seed=42) for t in scores], np.uint64)
    return toxicity.Scores(np.sort(hashes), np.array(list(scores.values()))[np.argsort(hashes)])


def test_a_repeated_word_is_no_passage():
    scanner = toxicity.Scanner(table_of({"odd": 2.0, "begin*": -0.5, "beginn*": 0.5}))
    alone, again = scanner.scan("odd")[1], scanner.scan("odd " * 60)[1]
    assert alone == [(0, 1, pytest.approx(alone[0][2]))] and again == alone and alone[0][2] > 0
    assert len(scanner.scan("odd " + "x " * 80 + "odd")[1]) == 2
    assert scanner.scores("x").tolist() == [-toxicity.DRIFT]
    assert scanner.scores("Begin beginning begine begin").tolist() == [-toxicity.DRIFT, 0.5, -0.5, -toxicity.DRIFT]


def test_counts_are_exact_for_any_number_of_words(spark):
    """Each of 600,000 words (the table of old had 262,144 places) has the score of its own counts, by either way."""
    rng = random.Random(2)
    texts = [(i, " ".join(f"w{rng.randrange(600_000):06x}{'abcdef'[i % 6]}" for _ in range(1500)), int(i % 5 == 0)) for i in range(600)]
    labelled = spark.createDataFrame(texts, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.train(labelled, "text", "toxic", "doc_id")
    assert len(model.table.hashes) > 500_000
    probe = texts[:40] + [(1000, "w00000 w0000 unseen w", 0)]
    expected = brute_toxicity([(i, t) for i, t, _ in probe], [(t, y) for _, t, y in texts], model)
    frame = spark.createDataFrame([(i, t) for i, t, _ in probe], "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], sorted((p["first_word"], p["n_words"]) for p in r["passages"])) for r in toxicity.score(frame, model).collect()}
    assert all(got[i][0] == pytest.approx(expected[i][0], abs=1e-6) and got[i][1] == expected[i][1] for i in expected)


def test_scores_are_the_same_when_tokens_are_joined(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.labelled(spark, docs, small, "toxic", 3, 1)
    sent, joined = toxicity.train(rows, "text", "label", "doc_id"), toxicity.train(rows, "text", "label", "doc_id", sent=0)
    assert joined.table is None and (joined.decay, joined.scale, joined.threshold) == pytest.approx((sent.decay, sent.scale, sent.threshold))
    probe = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Unseen words")], "doc_id long, text string")).withColumnRenamed("doc_id", "Score")
    assert toxicity.score(probe, joined).columns == toxicity.score(probe, sent).columns
    one, two = (sorted((r["text"] or "", r["predicted"], round(r["score"], 9), str(r["passages"])[:2000]) for r in toxicity.score(probe, m).collect()) for m in (sent, joined))
    assert [x[:3] for x in one] == [x[:3] for x in two]
    kept = toxicity.score(docs, joined, keep=["doc_id"])
    assert kept.columns == ["doc_id", "score", "predicted", "passages"] and kept.count() == docs.count()


def test_toxicity_finds_short_passages_in_long_texts(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeiou") + rng.choice("bdfgl") for _ in range(3)) for _ in range(800)]
    bad = ["vermin", "imbecile", "wretch"]

    def text(toxic):
        out = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        if toxic:
            for _ in range(2):
                out[rng.randrange(len(out))] = rng.choice(bad)
        return " ".join(out)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(labelled, "text", "toxic", "doc_id")
    long_clean = " ".join(rng.choice(words) for _ in range(20_000))
    probe = [(1, None), (2, ""), (3, long_clean), (4, long_clean + " vermin wretch imbecile " + long_clean), (5, "you wretch vermin")]
    got = toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [0, 0, 0, 1, 1]
    assert got[3]["passages"] and got[3]["passages"][0]["first_word"] == 20_000
    nothing = toxicity.train(labelled.limit(0), "text", "toxic", "doc_id")
    assert toxicity.score(labelled, nothing).where("predicted = 1").count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("id", "'w' as text", "cast(id % 2 as int) as label")
    from pyspark.sql import functions as F

    assert 800 < quality.hash_sample(rows, "id", [(F.lit(1), 1000)]).count() < 1200
    assert quality.hash_sample(rows.limit(50), "id", [(F.lit(1), 1000), (F.length("text"), 60)]).count() == 50


def test_toxicity_hashes_what_decides_a_word_and_keeps_newer_words(monkeypatch):
    """One hash for a known word, beginnings only for others; a full cache keeps its newer half."""
    digest, asked = toxicity.xxhash.xxh64_intdigest, []
    monkeypatch.setattr(toxicity.xxhash, "xxh64_intdigest", lambda t, seed: asked.append(t) or digest(t, seed=seed))
    known = {"hatred": 2.0, "hatr*": 1.5, "hatre*": 1.25, "kindly*": -3.0, "kind*": -2.0}
    pairs = sorted((digest(t, seed=42), v) for t, v in known.items())
    table = toxicity.Scores(np.array([h for h, _ in pairs], np.uint64), np.array([v for _, v in pairs]))
    words = ["hatred", "hatreds", "kindly", "kindlyness", "hatr", "other", "a"]
    assert table.scores(words).tolist() == [2.0, 1.25, -2.0, -3.0, -toxicity.DRIFT, -toxicity.DRIFT, -toxicity.DRIFT]
    assert asked.count("hatred") == 1 and asked.count("hatr*") == 0 and asked.count("kind*") == 1 and asked.count("othe*") == 1
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 4)
    held = toxicity.WordScores(table)
    for text in (["a", "b", "c", "Hatred"], ["d", "e"]):
        held.of(text)
    asked.clear()
    assert held.of(["Hatred", "c", "e", "f"]).tolist() == [2.0, -1.0, -1.0, -1.0]
    assert asked == ["f"] and len(held) <= 6
