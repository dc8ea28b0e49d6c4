"""Spelling variants: words that differ by one code point, and the form that each rarer word stands for.

Even-partition pigeonhole join. A word is cut in two halves, whose lengths depend on its length alone. One edit spares one
of them, so a word of length l is indexed under each half, together with l and the half's number. A word of length l or l + 1
probes with its own substrings at the places where a half of an l-letter word would lie: the first half where it is, the second
shifted by the difference of lengths. Two words that meet under a key share all but a *hole*, the half left out.

Halves alone do not stay selective: with many words one beginning of three letters has thousands of endings. Where a key would
make more than ``MOST_MEETINGS`` meetings, its hole is cut in two evenly again, and the words meet under what each half of the hole
leaves, by the same argument; so on, until no key is that large or its hole is one letter wide, where the alphabet bounds it. No pair is
lost: an edit inside a hole is inside one of its halves. A pair that could meet under several keys is a candidate only under the
key whose hole has the first differing letter, so candidates are not repeated, and one edit is verified within the join.

Occurrences are counted by one shuffle, aggregated before it. Forms lead to a word of ``ratio`` times the count, so chains are short
(a logarithm of the largest count) and free of cycles; roots come by pointer jumping. Only DataFrame functions are used.

Defined cases: a null text has no words; a null id counts as the empty text in the deletion rule; repeated rows are counted each; of
near words of equal count the smallest in code-point order is the form; extra columns are ignored; an empty table gives no words. A
text is cut into pieces of some 65,536 code points, never within a run of letters, so that a long text is not one array of words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table

#: Letters of a word, and those of them that ASCII lower-casing leaves as they are.
LETTERS, OTHER_CAPITALS = "A-Za-zÀ-ÿ", "À-Þ"
PIECE = 65_536
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Occurrences whose crc32 this divides lose a letter.
LOSS = 199
#: Pairs that may meet under one key before its hole is cut again.
MOST_MEETINGS = 1 << 14


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and run: each maximal run of letters, with A to Z in lower case."""
    piece = F.when(F.char_length("text") <= PIECE, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}[{LETTERS}]*+"), F.lit(0)))
    found = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(piece).alias("piece")).select("doc_id", F.explode(F.regexp_extract_all("piece", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    return found.select("doc_id", F.when(F.col("run").rlike(f"[{OTHER_CAPITALS}]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower("run")).alias("run"))


def with_losses(found: DataFrame, loss: int = LOSS) -> DataFrame:
    """``runs`` with a word each: the run, or without one letter where ``loss`` divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.withColumn("h", h).select("doc_id", F.when(F.col("h") % loss == 0, short).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, for words of at least so many letters that occur at least so often."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key(p: Column, q: Column, shift: int) -> Column:
    """What a hole [p, q) of an indexed word leaves of a word ``shift`` letters longer, with the hole and the indexed length."""
    rest = F.substring("word", q + shift + 1, F.col("size"))
    return F.xxhash64(F.col("size") - shift, p, q, F.substring("word", F.lit(1), p), rest)


def _keyed(words: DataFrame, holes: Column) -> DataFrame:
    """Rows of the index (shift null) and of probes (shift 0 or 1) for each hole of an array of (p, q)."""
    each = words.select("word", "n", "size", "shift", F.explode(holes).alias("hole")).select("word", "n", "size", "shift", "hole.p", "hole.q")
    shift = F.coalesce(F.col("shift"), F.lit(0))
    key = F.when(shift == 1, _key(F.col("p"), F.col("q"), 1)).otherwise(_key(F.col("p"), F.col("q"), 0))
    return each.withColumn("key", key)


def _halves(p: Column, q: Column) -> Column:
    """A hole cut evenly: the edit is in its second half, or in its first."""
    mid = p + F.floor((q - p) / 2).cast("int")
    return F.array(F.struct(mid.alias("p"), q.alias("q")), F.struct(p.alias("p"), mid.alias("q")))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of words with one edit between them that meet under a key; a is the shorter or the smaller word."""
    index = rows.where("shift is null").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"), "q")
    probes = rows.where("shift is not null").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"))
    end = lambda c: F.substring(c, F.lit(1), F.col("q"))
    first_difference_in_hole = (F.col("q") == F.col("size_a")) | (end("a") != end("b"))
    once = (F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    both = index.withColumnRenamed("key", "k").join(probes, (F.col("k") == F.col("key")) & once & first_difference_in_hole & one_edit)
    return both.select("a", "n_a", "b", "n_b")


def near_pairs(words: DataFrame, most_meetings: int = MOST_MEETINGS) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs of distinct words (columns word, n; a word once) that one inserted, deleted or replaced code point apart, and the stored
    tables that they read."""
    sized = words.select("word", "n", F.char_length("word").cast("int").alias("size")).where("size > 0")
    roles = sized.select("*", F.explode(F.array(F.lit(None).cast("int"), F.lit(0), F.lit(1))).alias("shift"))
    # the hole of a word is in an indexed word's places: one letter less where the probe is the longer word
    indexed = F.col("size") - F.coalesce(F.col("shift"), F.lit(0))
    rows, pairs, tables = _keyed(roles.where(indexed > 0), _halves(F.lit(0), indexed)), [], []
    while True:
        rows = stored(rows, "keys")
        many = rows.groupBy("key").agg(F.count(F.when(F.col("shift").isNull(), 1)).alias("x"), F.count("shift").alias("y"), F.max(F.col("q") - F.col("p")).alias("wide"))
        many = stored(many.where((F.col("x") * F.col("y") > most_meetings) & (F.col("wide") > 1)).select("key"), "many")
        tables += [rows, many]
        if many.isEmpty():
            pairs.append(_met(rows))
            return reduce(DataFrame.unionByName, pairs), tables
        pairs.append(_met(rows.join(many, "key", "left_anti")))
        rows = _keyed(rows.join(many, "key", "left_semi"), _halves(F.col("p"), F.col("q")))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root for rows of word and form, by pointer jumping: each round doubles the distance."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        last, now = now, stored(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(last)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, most_meetings: int = MOST_MEETINGS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n)."""
    words = stored(words.select("word", "n"), "words")
    pairs, tables = near_pairs(words, most_meetings)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.lit(None).cast("long").alias("n"), F.col(y).alias("near"), (-F.col(f"n_{y}")).alias("less"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*")
    all_rows = both.unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("less")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct("less", "near"))).alias("best")
    near = all_rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    held = -F.col("best.less") >= F.col("n") * ratio
    out = stored(near.select("word", "n", "n_near", F.when(held, F.col("best.near")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n")), "forms")
    dropped(words, *tables)
    return out.join(_roots(out.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(with_losses(runs(table(spark, sf_dir, "documents")))))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
#: crc32 is not a function of the SQL at hand; tests hold the query against all pairs.
ORACLES: dict[str, str] = {}
