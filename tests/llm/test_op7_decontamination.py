import random

import pytest

from textloom.llm import op7_decontamination as op


def rows(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in op.overlap_columns(op.find_overlaps(d, b, **kw)).collect()], d, b


@pytest.mark.parametrize("max_bytes", [1 << 20, 64])
def test_brute_force(spark, max_bytes):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "B", "cc", "Ñu", "d9"])
    text = lambda n: rng.choice([" ", ", ", "-"]).join(word() for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 13, 16]) if i else 20)) for i in range(2, 9)] + [(20, None), (21, "..."), (3, "zz yy")]
    docs = [(k, text(rng.randrange(60))) for k in range(40)] + [(90, None), (91, ""), (92, "?!"), (93, items[0][1] * 3)]
    got, _, _ = rows(spark, docs, items, window=4, max_pattern_bytes=max_bytes)
    want = op.brute_force(dict(docs), items, 4)
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(docs)


def test_decontaminate_keeps_columns_and_rows(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = [(1, passage), (2, "clean"), (2, "clean"), (3, None), (4, passage + " x" * 300)]
    for most in (1 << 20, 8):
        _, d, b = rows(spark, docs, [(1, passage), (2, "other words here")])
        out = op.decontaminate(d, b, max_pattern_bytes=most)
        assert out.columns == d.columns
        assert sorted(r.doc_id for r in out.collect()) == [2, 2, 3, 4]


def test_empty_tables(spark):
    got, d, _ = rows(spark, [(1, "a b")], [])
    assert got[0][1:4] == (2, 0, 0) and not got[0][5]
    assert rows(spark, [], [(1, "a")])[0] == []


def test_shared_prefixes_shift_safely():
    words = [b"x", b"a", b"a", b"a", b"b", b"a", b"a", b"b"]
    spans, found = op.WuManber([("i", b"a a b"), ("j", b"b")], 3).find(words)
    assert spans == [(2, 5), (5, 8)] or spans == [(2, 8)]
    assert found == {"i", "j"}


def test_tables_are_small_and_time_does_not_depend_on_buckets():
    import time
    import tracemalloc

    rng = random.Random(5)
    words = [b"w%d" % i for i in range(30)]  # few words: buckets of thousands of patterns
    items = [(str(i), b" ".join(rng.choices(words, k=200))) for i in range(1500)]
    tracemalloc.start()
    matcher = op.WuManber(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(len(t) for _, t in items)
    assert peak < 60 * size + (40 << 20)
    doc = rng.choices(words, k=20_000)
    start = time.process_time()
    spans, found = matcher.find(doc + items[7][1].split())
    assert time.process_time() - start < 3 and "7" in found and (20_000, 20_200) in [(max(a, 20_000), b) for a, b in spans]


def test_long_texts_are_cut_at_words(monkeypatch):
    text = b"ab cd  ef gh ij " * 50
    want = op._words(text)
    monkeypatch.setattr(op.shingles, "CHUNK", 64)
    got = next(iter(op._hashed([text])))
    assert all((x == y).all() for x, y in zip(want, got, strict=True))
    assert [len(h) for _, _, h in op._hashed([b"", b"a", b"  ", text, b"b c"])] == [0, 1, 0, 250, 2]


def test_windows_of_many_texts_move_as_one_alone_would(monkeypatch):
    import numpy as np

    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices("abcde", k=n)).encode()
    items, texts = [(str(i), text(rng.choice([1, 2, 3, 7]))) for i in range(6)], [text(rng.randrange(40)) for _ in range(30)] + [b"", text(700)]
    matcher = op.WuManber(items, 4)
    want = [matcher.find(t.split()) for t in texts]
    for span in (1, 5, 256):  # how many words a window moves in changes no result
        monkeypatch.setattr(op, "SPAN", span)
        assert [r[1:] for r in op._searched(matcher, texts)] == want
    for g in matcher.groups:
        words = next(op._groups([text(300)]))
        hashes, at, out = words[3], g.m - 1, []
        while at < 300:  # a window alone
            step = int(g.shift[g._addresses(hashes, np.array([at]))][0])
            out += [] if step else [at]
            at += max(1, step)
        assert set(g.candidates(hashes, g.ends(hashes, words[4]))[0]) == set(g.candidates(hashes, np.array(out, np.int64))[0])


def test_a_bucket_is_selected_by_the_suffix_and_narrowed_by_what_comes_before_it():
    middle = [b"m%d" % i for i in range(500)]
    matcher = op.WuManber([(str(i), b"first " + w + b" the same end") for i, w in enumerate(middle)], 5)
    (g,) = matcher.groups
    ends = g._addresses(matcher.hashes, g.at + 4)
    assert len(set(ends.tolist())) == 1 and int(g.first[ends[0] + 1] - g.first[ends[0]]) == 500  # one bucket
    for i in (0, 250, 499):
        assert matcher.find(b"x first".split() + [middle[i]] + b"the same end y".split()) == ([(1, 6)], {str(i)})
    assert matcher.find(b"first other the same end".split()) == ([], set())
    assert matcher.find([]) == ([], set()) and list(op._searched(matcher, [None, b"", b"?"])) == [(0, [], set())] * 3
