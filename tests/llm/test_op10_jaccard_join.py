import random
import re

import pytest

from textloom.llm import op10_jaccard_join as op
from textloom.llm import shingles


def brute(texts):
    def shingle_set(t):
        w = [x for x in re.split("[\x20\t-\r]+", "".join(c.lower() if c < "\x7f" else c for c in t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [(k, shingle_set(t)) for k, t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k, len(s), low[find(i)]) for i, (k, s) in enumerate(sets))


def run(spark, texts):
    df = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, n long").repartition(3)
    return sorted(tuple(r) for r in op.classes(df).collect())


def variants(rng, n, size, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(300)}"
        yield " ".join(w)


@pytest.mark.parametrize("hot, least", [(2, 0), (2, 5000), (500, 100000)])
def test_classes_equal_brute_force(spark, monkeypatch, hot, least):
    if hot == 2:  # every step is taken, and all that is left meets at once or in rounds
        monkeypatch.setattr(op, "HOT", 2)
        monkeypatch.setattr(op, "NEAR", 3)
        monkeypatch.setattr(op, "ROUNDS", 1)
        monkeypatch.setattr(op, "MEETINGS", 0)
        monkeypatch.setattr(op, "LEAST_MEETINGS", least)
    monkeypatch.setattr(op, "LEAST_FREQUENT", 50)
    monkeypatch.setattr(op, "MOST_FREQUENT", 50)
    rng, texts = random.Random(5), [None, "", " \t", "Á b", "á b", "A b", "a  B"]
    for size, n in ((4, 5), (6, 8), (9, 12), (12, 14), (16, 14), (40, 30), (120, 30)):
        texts += variants(rng, n, size, max(1, size // 20))
        texts += variants(rng, n, size, max(2, size // 8))
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(rng.choice([5, 9, 12, 16, 20, 60]))) for _ in range(60)]
    texts = list(enumerate(texts + texts[20:40], 3))
    rng.shuffle(texts)
    assert run(spark, texts) == brute(texts)


def test_subsets_find_every_small_link(spark, monkeypatch):
    monkeypatch.setattr(op, "boundary", lambda histogram: 10)
    rng = random.Random(7)
    texts = list(enumerate([t for size in range(1, 18) for t in variants(rng, 7, size, 1)] + [" ".join(f"q{i}" for i in range(k)) for k in range(1, 20)]))
    assert run(spark, texts) == brute(texts)


def test_ties_and_repeated_rows_and_null_ids(spark):
    got = run(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (3, None)])
    assert got == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (3, 0, 3)]
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in op.classes(df).collect()} == {4}


def test_empty_table(spark):
    assert run(spark, []) == []


def mixed(rng, n):
    """Texts of 10 out of 60 passages that all share."""
    passages = [" ".join(f"p{i}x{j}" for j in range(25)) for i in range(60)]
    return [" ".join(rng.sample(passages, 10)) for _ in range(n)]


def test_mixed_passages_equal_brute_force_and_grow_in_proportion(spark, monkeypatch):
    seen = {}
    possible = op._Join._possible

    def count_pairs(self, pairs):
        out = possible(self, pairs)
        seen["pairs"] += pairs.count()
        seen["possible"] += out.count()
        return out

    monkeypatch.setattr(op._Join, "_possible", count_pairs)
    found = []
    for n in (300, 600):
        seen |= {"pairs": 0, "possible": 0}
        texts = mixed(random.Random(n), n)
        words = [t.split() for t in texts]
        texts += [" ".join(["edited", *w[1:]]) for w in words[: n // 10]]
        got = run(spark, list(enumerate(texts)))
        assert got == brute(list(enumerate(texts)))
        found.append(dict(seen))
    postings = 60 * 330  # of the smaller run, at most
    assert found[0]["pairs"] <= 2 * postings and found[1]["pairs"] <= 4 * postings
    assert found[1]["possible"] <= 2.5 * found[0]["possible"] + 10


def test_lists_of_many_classes_equal_brute_force(spark):
    """Sets that agree on most shingles of a common part without being linked, so that all steps are taken."""
    rng, texts = random.Random(3), []
    common = " ".join(f"c{i}" for i in range(40))
    for g in range(30):
        own = " ".join(f"g{g}w{i}" for i in range(rng.choice([8, 10, 12, 14])))
        texts += [common + " " + own, own + " " + common, common + " " + own + " z"]
    texts = list(enumerate(texts))
    assert run(spark, texts) == brute(texts)


@pytest.mark.parametrize("n", [1, 3, 7, 12, 40, 200, 900])
def test_linked_sets_share_a_part(n):
    import numpy as np

    rng = np.random.default_rng(n)
    for _ in range(60):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        differ = rng.integers(0, n // 9 + 1)
        t = np.unique(np.concatenate((s[rng.permutation(n)[: n - differ]], rng.integers(0, 1 << 63, rng.integers(0, differ + 1), dtype=np.uint64))))
        if 5 * len(np.intersect1d(s, t)) >= 4 * len(np.union1d(s, t)) and len(t):
            assert set(op._part_keys(s).tolist()) & set(op._part_keys(t).tolist())


def test_deduplicate_keeps_one_row_of_each_class(spark):
    df = spark.createDataFrame([(5, "a b c", "x", {"k": 1}), (2, "a b c", "y", {"k": 1}), (9, None, "z", None)], "doc_id long, text string, component_id string, row map<string,int>")
    out = op.deduplicate(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 9]


@pytest.mark.parametrize("hot", [3, 64])
def test_pairs_get_the_values_of_a_node_once(spark, monkeypatch, hot):
    """Copies of a node's values, as different tasks make them, are one when they meet the pairs."""
    monkeypatch.setattr(op, "HOT", hot)
    pairs = [(a, b) for a in range(6) for b in (10, 11 + a)]
    values = spark.createDataFrame([(b, [b]) for b in range(100) for _ in range(3)], "b long, y array<long>").repartition(4)
    out = op._with_nodes(spark.createDataFrame(pairs, "a long, b long"), "b", values)
    assert out.columns.count("y") == 1 and "salt" not in out.columns and "hot" not in out.columns
    assert sorted((r.a, r.b, tuple(r.y)) for r in out.collect()) == sorted((a, b, (b,)) for a, b in pairs)


@pytest.mark.parametrize("names", ["_gone string", "row string", "other string", "node string", "key string"])
def test_deduplicate_by_row(spark, names):
    x, y, z = "one text of this and that", "something else in quite other words", "a third text that nobody has seen"
    rows = [(2, x, "p"), (5, x, "p"), (5, y, "p"), (7, z, "p"), (7, z, "p"), (None, z, "p"), (None, "q r s", "p"), (None, "q r s", "q"), (8, "", "p"), (8, "", "p"), (2, x, "q")]
    out = op.deduplicate(spark.createDataFrame(rows, f"doc_id long, text string, {names}")).collect()
    got = sorted(((r.doc_id, r.text) for r in out), key=repr)
    assert got == sorted([(2, x), (5, y), (7, z), (None, "q r s"), (8, ""), (8, "")], key=repr)


@pytest.mark.parametrize("n", range(1, 60))
def test_required_overlap_and_prefix(n):
    for m in range(1, 60):
        best = min(n, m)
        linked = [i for i in range(best + 1) if 100 * i >= 80 * (n + m - i)]
        assert op.compatible(n, m) == bool(linked)
        if linked:
            assert linked[0] == op.required(n, m) and op.prefix_length(n) >= n - linked[0] + 1


def test_long_texts_are_cut_at_words(monkeypatch):
    text = ("ab cd\nef gh ij " * 50).encode()
    want = shingles.sets([text])[0].tolist()
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert shingles.sets([text])[0].tolist() == want
