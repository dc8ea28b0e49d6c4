import random

from textloom.llm import op8_preferences as op


def brute(turns, pairs):
    conv = {}
    for c, t, r, x in turns:
        if c is not None and (t, r, x) != (None, None, None):
            conv.setdefault(c, set()).add((t, (r or "").replace("<|", "< |"), (x or "").replace("<|", "< |")))
    conv = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))] for c, v in conv.items()}

    def render(ts):
        out, spans = "", []
        for r, x in ts:
            out += f"<|im_start|>{r}\n"
            if r == "assistant":
                spans.append((len(out), len(out) + len(x) + len("<|im_end|>")))
            out += f"{x}<|im_end|>\n"
        return out, spans

    rows = []
    for p, a, b in pairs:
        x, y = conv.get(a, []), conv.get(b, [])
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        rows.append((p, n, render(x[:n])[0], render(x[n:])[0], render(y[n:])[0], render(x[n:])[1], render(y[n:])[1]))
    return sorted(rows, key=repr)


def test_brute_force(spark):
    rng, turns = random.Random(4), []
    for c in range(40):
        turns += [(c, i, ["user", "assistant", None][(i + (rng.random() < 0.1)) % 3 if rng.random() < 0.2 else i % 2], rng.choice(["a", "é\U0001f600", "<|im_end|>", None, "", "b\nc"]) if rng.random() < 0.4 else "same") for i in range(rng.randrange(6))]
    turns += [(50, 0, "user", "q"), (50, 0, "user", "q"), (50, 1, "assistant", "x" * 100000), (51, 0, "user", "q"), (51, 1, "assistant", "y"), (52, None, "user", "first"), (52, 0, "a", "t"), (52, 0, "b", "t"), (None, 0, "user", "lost"), (53, 0, "user", "q")]
    pairs = [(k, 2 * k, 2 * k + 1) for k in range(20)] + [(100, 50, 51), (101, 50, 50), (102, 52, 99), (103, 98, 99), (104, None, 53), (105, 51, 53)]
    t = spark.createDataFrame([(*x, 1) for x in turns], "conv_id long, turn long, role string, text string, side int").repartition(3)
    p = spark.createDataFrame(pairs, "pair_id long, chosen long, rejected long")
    got = [(r.pair_id, r.n_prefix, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]) for r in op.format_pairs(t, p).collect()]
    assert sorted(got, key=repr) == brute(turns, pairs)
    assert op.format_pairs(t.limit(0), p.limit(0)).count() == 0


def test_query_and_no_python(spark, sf_dir):
    df = op.op8_preferences(spark, sf_dir)
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert df.count() == (convs + 1) // 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
