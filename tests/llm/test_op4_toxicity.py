import math
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm import op4_toxicity as op


def brute(scores):
    """Maximal scoring subsequences by their definition: best first, then left and right of it."""
    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (found is None or total > found[2] + 1e-9 or abs(total - found[2]) < 1e-9 and (j + 1 - i) < found[1] - found[0]):
                    found = (i, j + 1, total)
        return [*best(lo, found[0]), found, *best(found[1], hi)] if found else []

    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-0.5, -0.5, -0.5, 1.13, 0.41, 3.07]) for _ in range(rng.randrange(30))]
    got = op.segments(np.array(scores))
    want = brute(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want, strict=True))


def small_corpus():
    rng, rows = random.Random(4), []
    for i in range(120):
        words = [rng.choice(["of", "the", "and", "so", "it", "we"]) + rng.choice("abcde") for _ in range(rng.randrange(8, 30))]
        toxic = int(i % 3 == 0)
        if toxic:
            words[3:3] = rng.sample(["scum", "idiot", "moron", "trash"], 3)
        elif i % 10 == 1:
            words.append("moron")
        rows.append((i, " ".join(words), toxic))
    return [*rows, (500, rows[0][1], 1), (501, None, 0), (502, "", 0)]


def test_weights_lambda_and_k_equal_brute_force(spark):
    rows = small_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = op.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), held_out=op.F.col("doc_id") < 0)
    known = [(t, y) for _, t, y in rows if t is not None]
    same = Counter(known)  # here only equal texts share a key
    n1, n0 = (sum(1 / same[k] for k in known if k[1] == y) for y in (1, 0))
    assert (model.n1, model.n0) == pytest.approx((n1, n0))

    def weight(y1, y0):
        prior = (y1 + y0) / (n1 + n0) * op.PRIOR + 0.01
        odds = math.log((y1 + prior) / (n1 + op.PRIOR - y1 - prior)) - math.log((y0 + prior) / (n0 + op.PRIOR - y0 - prior))
        error = op.SIGNIFICANT * math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        return math.copysign(max(0.0, abs(odds) - error), odds)

    counts = {w: [sum(1 / same[k] for k in known if k[1] == y and w in k[0].split()) for y in (1, 0)] for w in {w for t, _ in known for w in t.split()}}
    want = {w.encode(): weight(*c) for w, c in counts.items()}
    assert any(x < 0 for x in want.values()) and set(model.weights) == {w for w, x in want.items() if x}
    assert all(model.weights[w] == pytest.approx(want[w]) for w in model.weights)

    walk, best, tokens = [], [], 0
    for t, y in known:
        if y:
            continue
        scores, last = [], {}
        for i, w in enumerate(t.split()):
            x = weight(counts[w][0], max(0.0, counts[w][1] - 1)) if w.encode() in model.counts else 0.0
            if x > 0:
                echo = i - last.get(w, -op.ECHO) < op.ECHO
                last[w] = i
                x = 0.0 if echo else x
            scores.append(x - op.DRIFT)
        walk += [round(x / op.STEP) * op.STEP for x in scores]
        best += [x for _, _, x in brute(scores)]
        tokens += len(scores)
    largest = max(model.weights.values()) - op.DRIFT
    mean = lambda rate: sum(math.exp(rate * x) for x in [*walk, largest]) / (len(walk) + 1)
    assert mean(model.rate) == pytest.approx(1, abs=1e-6) and mean(model.rate / 2) < 1
    best = sorted([*best, largest], reverse=True)
    at = [i / (tokens * math.exp(-model.rate * x)) for i, x in enumerate(best, 1)]
    assert model.k == pytest.approx(max(at), rel=1e-6)


def test_passages_are_the_significant_segments(spark):
    rows = small_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = op.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), held_out=op.F.col("doc_id") < 0)
    text = b"ofa theb " * 40 + b"scum idiot trash " + b"ofa theb " * 40 + b"moron " + b"ofa theb " * 40
    words = op.tokens_of(text)
    every = op.segments(model.scores(words, model.weights))
    found = model.judge(text)[1]
    assert [(a, b) for a, b, _ in found] == [(80, 83)] and len(every) >= 1
    assert all((model.k * len(words) * math.exp(-model.rate * s) <= op.MOST_EXPECTED) == ((a, b, s) in found) for a, b, s in every)
    assert op.Model.scores([b"x", b"x", *[b"y"] * op.ECHO, b"x"], {b"x": 2.0}).tolist()[:2] == [1.5, -0.5] and op.Model.scores([b"x", *[b"y"] * op.ECHO, b"x"], {b"x": 2.0})[-1] == 1.5


def test_repeated_ids_keep_the_bound(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i} of the row") for i in range(500)], "doc_id long, text string")
    model = op.train(docs, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int"), held_out=op.F.col("doc_id") < 0)
    assert (model.n1, model.n0) == (2, 3)


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.1"
    return op.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(op.fold("doc_id", 5) == 0)
    seen = op.score(spark.read.parquet(f"{sf}/documents.parquet"), model).join(labels, "doc_id").select("toxic", "score").collect()
    wrong = sum((r.score >= 0.5) != bool(r.toxic) for r in seen)
    assert len(seen) > 500 and wrong <= 0.03 * len(seen)
    assert sum(r.score >= 0.5 for r in seen if not r.toxic) <= 0.005 * len(seen)


def test_null_empty_long_and_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "the idiot loser scum moron", 7), (3, "of the and " * 200000, 7), (3, "x", 7)], "doc_id long, text string, score int")
    got = op.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score >= 0.5 for r in got} == {1: False, 2: False, None: True, 3: False}
    kept = op.reject(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 3]


def test_chance_hits_of_long_clean_texts_do_not_add_up(spark, model):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where((op.fold("doc_id", 5) == 0) & (op.F.col("toxic") == 0)).dropDuplicates(["doc_id"])
    clean = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id").orderBy("doc_id").collect() if r.text]
    joined = "\n".join(clean).encode()
    chance = min((w for w in model.weights if model.weights[w] > 2), key=model.weights.get)
    sparse = b"of the and so " * 1250 + chance + b" "  # one chance hit in 5,000 words, as in clean documents
    count = lambda text: len(op.segments(model.scores(op.tokens_of(text), model.weights)))
    assert count(joined) > 3 and count(sparse * 200) >= 200
    assert model.judge(joined)[0] < 0.5
    assert [model.judge(sparse * k)[0] < 0.5 for k in (1, 4, 40, 200)] == [True] * 4
    abuse = b"the idiot loser scum moron " * 2
    assert model.judge(sparse * 200 + abuse)[0] >= 0.5 and model.judge((b"of the and so " * 500 + abuse) * 3)[0] >= 0.5


def test_evidence_is_the_best_sum_statistic():
    m = op.Model(rate=1.5, k=0.1)
    scores, n = [3.0, 9.0, 8.0, 3.0], 1000
    want = max(1.5 * sum(sorted(scores)[-r:]) - r * op.math.log(0.1 * n) + op.math.log(op.math.factorial(r)) for r in range(1, 5))
    assert abs(m.evidence(scores, n) - want) < 1e-9
    assert m.evidence([], n) == m.evidence([], 0) == 0 and m.evidence([3.0] * 50, 10**6) == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for rows in ([], [(1, None)], [(2, 1)], [(1, 1)]):
        m = op.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score < 0.5 for r in op.score(docs, m).collect()] == [True]
    assert op.score(docs.limit(0), m).count() == 0


def test_held_out_labels_train_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", op.F.when(op.fold("doc_id", 5) == 0, 1 - op.F.col("toxic")).otherwise(op.F.col("toxic")))
    a, b = op.train(docs, labels), op.train(docs, flipped)
    assert a.counts == b.counts and (a.rate, a.k, a.intercept, a.slope) == (b.rate, b.k, b.intercept, b.slope)
