import numpy as np
import pytest

from textloom.llm import op1_language as op


def gram_set(text, letters):
    t = ["" if c not in letters else c for c in text.lower()]
    return {tuple(t[i : i + k]) for k in range(1, op.LONGEST + 1) for i in range(len(t) - k + 1)}


TEXTS = ["Abc ab! cab", "ß ñandú ab", "zzz", "aaa bbb" * 30, "a", "漢字 ab 𝔘x"]


@pytest.mark.parametrize("table", [0, 1 << 22])
@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_codes_are_the_distinct_grams(monkeypatch, chunk, table):
    monkeypatch.setattr(op, "CHUNK", chunk)
    monkeypatch.setattr(op, "TABLE", table)
    grams = op.Grams("abcñ")
    for x in TEXTS:
        a, sx = grams.codes(x), gram_set(x, "abcñ")
        assert len(a) == len(set(a.tolist())) == len(sx)
        for y in TEXTS:
            assert len(np.intersect1d(a, grams.codes(y))) == len(sx & gram_set(y, "abcñ"))


def test_one_product_equals_kernel_regression():
    texts = ["the and of to", "der die und das", "le la et les", "and the of it", "und der ist", "et la des"] * 3
    names = ["en", "de", "fr"] * 6
    model = op.fit(texts, names)
    letters = set(model.letters)
    marks = [gram_set(t, letters) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    f = k @ root
    y = np.where(np.array(names)[:, None] == np.array(["de", "en", "fr"])[None], 1.0, -1.0)
    w = np.linalg.solve(f.T @ f + op.RIDGE * len(texts) * np.eye(len(texts)), f.T @ y)
    source = op.Grams(model.letters)
    for t in ("the of der", "la les and xyz"):
        direct = np.array([kernel(gram_set(t, letters), m) for m in marks]) @ root @ w
        codes = source.codes(t)
        got = sum(model.weights[np.flatnonzero(model.grams == c)[0]] for c in codes if c in model.grams) / len(codes) ** 0.5
        assert np.allclose(direct, got, atol=1e-3)


@pytest.mark.parametrize("table", [0, 1 << 22])
def test_prediction_equals_brute_force_with_fewer_landmarks_than_texts(monkeypatch, table):
    monkeypatch.setattr(op, "LANDMARKS", 2)
    monkeypatch.setattr(op, "TABLE", table)
    texts = ["the and of to", "der die und das", "le la et les", "and the of it", "und der ist", "et la des", "of a the", "das ist die", "les et des"]
    names = ["en", "de", "fr"] * 3
    model = op.fit(texts, names)
    marks = [gram_set(t, set(model.letters)) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    chosen = range(6)
    values, vectors = np.linalg.eigh(np.array([[kernel(marks[a], marks[b]) for b in chosen] for a in chosen]))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    f = np.array([[kernel(m, marks[b]) for b in chosen] for m in marks]) @ root
    y = np.where(np.array(names)[:, None] == np.array(["de", "en", "fr"])[None], 1.0, -1.0)
    w = np.linalg.solve(f.T @ f + op.RIDGE * len(texts) * np.eye(6), f.T @ y)
    tests = ["the of der", "la les and xyz", None, "12", "das und", "et"]
    for t, (name, score) in zip(tests, model.predictor()(tests), strict=True):
        if t in (None, "12"):
            assert (name, score) == ("und", 0.0)
            continue
        v = np.array([kernel(gram_set(t, set(model.letters)), marks[b]) for b in chosen]) @ root @ w
        assert name == ["de", "en", "fr"][int(v.argmax())]
        assert abs(score - 1 / np.exp(op.SHARPNESS * (v - v.max())).sum()) < 1e-3


@pytest.mark.parametrize("text", ["½ ²", "①", "Ⅷ", "12 !?", "_", "٣"])
def test_numbers_are_no_letters(text):
    model = op.fit(["the and of to", "der die und das"], ["en", "de"])
    assert model.predictor()([text, text + " the"]) [0] == ("und", 0.0) and not op.has_letter(text) and op.has_letter(text + "a")


def test_all_letters_are_told_apart():
    many = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 400))
    model = op.fit([many[:200], many[200:]], ["a", "b"])
    assert len(model.letters) == 400 and [x for x, _ in model.predictor()([many[150:190], many[210:260]])] == ["a", "b"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    seen = op.op1_language(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert len(seen) > 2000 and sum(r.lang == r.lang_pred for r in seen) >= 0.99 * len(seen)
    assert all(0 <= r.score <= 1 for r in seen)


def test_odd_rows(spark, sf_dir):
    model = op.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "12 !?", 3), (None, "the and of the", 3), (5, "the and of " * 200000, 3), (5, "漢字", 3)], "doc_id long, text string, score int")
    got = op.predict(df, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got if r.lang_pred == "und"] == [(1, "und"), (2, "und"), (3, "und")]
    assert len(got) == 6 and [r.lang_pred for r in got][3:5] == ["en", "en"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in op.predict(df, op.train(df)).collect()} == {"und"}
    assert op.predict(df.limit(0), op.train(df.limit(0))).count() == 0


def test_held_out_rows_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.withColumn("lang", op.F.when(op.fold("doc_id", 4) == 2, op.F.lit("xx")).otherwise(op.F.col("lang")))
    a, b = op.train(docs), op.train(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)
