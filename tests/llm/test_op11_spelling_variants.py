import random
import re
import zlib
from collections import Counter, defaultdict

from textloom.llm import op11_spelling_variants as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n):
    """Near words meet in a word without one of its letters, or are such a word."""
    at = defaultdict(set)
    for w in n:
        at[w].add(w)
        for i in range(len(w)):
            at[w[:i] + w[i + 1 :]].add(w)
            at[w[:i] + "?" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for gap, some in at.items():
        whole = {gap} & some
        for x in some if whole or "?" in gap else ():
            # a shorter word is near those that it is a gap of; equal lengths meet with the place marked
            near[x] |= (some - {x}) if "?" in gap else (whole if x not in whole else some - whole)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in n}


def rows_of(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_equals_brute_force(spark, sf_dir):
    n = words_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = rows_of(op.op11_spelling_variants(spark, sf_dir))
    assert got == brute(n) and len(got) > 500 and any(r[1] for r in got)


def test_dense_words_and_split_keys(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(900)}
    words |= {"commonbeginning" + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(700)}
    words |= {"".join(rng.choice("xy") for _ in range(rng.randrange(1, 7))) + "commonending" for _ in range(100)}
    n = {w: rng.choice([1, 5, 25, 25, 126, 700, 4000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute(n)
    for most in (1, 64, 1 << 14, 1 << 40):
        assert rows_of(op.variants(df, most_meetings=most)) == want


def test_meetings_under_a_key_are_bounded(spark):
    """One beginning with very many endings: no key keeps more meetings than the bound, and few words meet."""
    words = [("beginning" + "".join(chr(97 + (i // 26**k) % 26) for k in range(3)) * 2, 5) for i in range(4000)]
    df = spark.createDataFrame(words, "word string, n long")
    pairs, tables = op.near_pairs(df, 1000)
    assert pairs.count() == len(brute_pairs([w for w, _ in words]))
    last = tables[-2].groupBy("key").pivot("shift").count()
    assert last.count() < sum(t.count() for t in tables)
    assert len(tables) > 2 and tables[-1].count() == 0


def brute_pairs(words):
    near = {(r[0], r[4]) for r in brute({w: 5 for w in words})}
    return range(sum(k for _, k in near) // 2)


def test_edges(spark):
    docs = [(1, None, 0), (2, "", 0), (None, "Würden wurden", 0), (3, "ÉCOLES ÉCOLES éCOLES x×÷y " * 3, 0), (3, "ÉCOLES ÉCOLES éCOLES x×÷y " * 3, 0)]
    docs += [(i, "Zusammen zusamen zusammen! Zusammen_ZUSAMMEN zusammen", 0) for i in range(10, 16)]
    docs.append((4, "letters " * 30_000 + "q" * 200_000, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, word int").repartition(3)
    n = words_of((r.doc_id, r.text) for r in df.collect())
    assert {"zusammen", "zusamen", "letters"} <= set(n)
    assert {(r.word, r.n) for r in op.counted(op.with_losses(op.runs(df))).collect()} == set(n.items())
    assert rows_of(op.variants(op.counted(op.with_losses(op.runs(df))))) == brute(n)
    assert op.variants(op.counted(op.with_losses(op.runs(df.limit(0))))).collect() == []


def test_chains_of_forms(spark):
    n = {"aaaaaab"[i:] if i else "aaaaaab": 5**i for i in range(7)}
    chain = {"m" * (6 + i): 5 ** (i + 1) for i in range(9)}
    df = spark.createDataFrame(list((n | chain).items()), "word string, n long")
    got = rows_of(op.variants(df))
    assert got == brute(n | chain)
    assert {r[2] for r in got if r[0] in chain} == {"m" * 14}


def test_no_python(spark, sf_dir):
    plan = op.counted(op.with_losses(op.runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
