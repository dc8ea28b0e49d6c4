"""Size-aware heavy-light Jaccard self-join over word shingles, for classes of near duplicates.

Sets are the distinct five-word shingles of a text; two texts link when 100 * intersection >= 80 * union.

* Equal sets are one node. Small nodes enumerate fixed-size subsets: sets of sizes n <= m link exactly when they
  share c(n, m) = ceil(4 (n + m) / 9) shingles, so both emit a key for each of their subsets of that size, and
  equal keys are links without any further check.
* Larger nodes post themselves in the inverted lists of a prefix of their shingles, rare ones first, one list at
  least being shared by any two that link. A scan of the lists aggregates each to its length and a pivot, the
  member that has the fewest rarer shingles, as originals of many copies do. In lists of at most ``NEAR`` members all meet;
  in longer ones all meet the pivot, then in ``ROUNDS`` rounds 1, 4, 16 pivots from other classes than the list's largest: a
  bounded number of meetings a posting, however long a list is. What is left is done in one round once it needs
  no more than ``MEETINGS`` meetings a posting. What a pair has before a shared shingle must leave room for a
  link, so of most meetings no pair comes, and lists none of whose members may be the smaller of a pair are left out.
* Members of longer lists in which members are then left that have not met all others post themselves once more, in lists that only like sets share:
  the shingles are dealt to more parts than linked sets can differ in, so linked sets agree on a whole part. These
  lists are scanned in the same way, with more and more pivots, until each member has met all the others that are not known to be of its class.
* The boundary between small and large is the size at which enumeration and scanning together cost least, by the
  histogram of small sizes.

Pairs pass a test of sizes and of bitmaps that can only show that two sets do not link, and then the exact test on
whole sets. Links within a class may stay untested; a link between different classes cannot, so components are exact.
Lists are only aggregated, before any shuffle, and hot nodes of pairs are salted, so no task holds a list.

Which shingles count as frequent only orders prefixes. It decides cost, never the result.

Defined cases: null, empty and blank texts have no shingles and link with nothing; texts of one to four words are one
shingle; equal texts link; rows that share a doc_id are each a row of the result; a null doc_id is kept and never
names a class that has another id; extra columns are ignored by ``classes`` and kept by ``deduplicate``, whatever
their names. ``deduplicate`` keeps one row of each class, that of the smallest doc_id (null last, then by a hash of the whole row),
one of rows that are equal, and all rows without shingles. Sets and rows are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil, comb, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import bytes_of, dropped, fresh, frugal, stored, table, with_settings
from .components import components, merged

#: Frequent shingles that order prefixes: one for so many shingles of the corpus, within these bounds.
FREQUENT_SHARE, LEAST_FREQUENT, MOST_FREQUENT = 500, 100_000, 2_000_000
#: Largest size for which subsets may be enumerated, and the cost of a posting against that of a subset.
MOST_SMALL, SCAN_COST = 12, 8
#: Rows up to which one side of a join may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows of a batch that goes to Python.
BATCH_ROWS = 1000
#: Pairs of a node that make it hot, and the parts that these are dealt to.
HOT, SALTS = 64, 16
#: Members of a list that all meet.
NEAR = 8
#: Meetings a posting, and in all, up to which all that is left is done in one round.
MEETINGS, LEAST_MEETINGS = 32, 100_000
#: Rounds of pivots in the lists of prefixes, and the growth of the pivots of a list from round to round.
ROUNDS, MORE = 3, 4
#: Shingles among which a task looks for frequent ones at a time, and the count that makes one a candidate.
SPAN, OFTEN = 500_000, 3


def required(n: int, m: int) -> int:
    """Least intersection of linked sets of sizes n and m."""
    return -(-4 * (n + m) // 9)


def compatible(n: int, m: int) -> bool:
    return 5 * min(n, m) >= 4 * max(n, m)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def subset_keys(n: int, most: int) -> int:
    return sum(comb(n, required(n, m)) for m in range(1, most + 1) if compatible(n, m))


def boundary(histogram: dict[int, int], most: int = MOST_SMALL, scan_cost: int = SCAN_COST) -> int:
    """The largest size whose sets enumerate subsets, by total cost; 0: none does."""

    def cost(x: int) -> int:
        return sum(k * (subset_keys(n, x) if n <= x else scan_cost * prefix_length(n)) for n, k in histogram.items() if n <= most)

    return min(range(most + 1), key=lambda x: (cost(x), x))


def _sets_of(batch: pa.RecordBatch, column: int):
    return shingles.sets(bytes_of(batch.column(column)))


def _describe(batches):
    """doc_id, row, size and node of each row; shingles that are frequent here come with some of the rows."""
    held: list[np.ndarray] = []
    kind = pa.list_(pa.struct([("s", pa.int64()), ("c", pa.int64())]))

    def frequent():
        if not held:
            return []
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        often = counts >= OFTEN
        return [{"s": s, "c": c} for s, c in zip(values[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]

    def out(b, found, extra):
        n, node, often = [len(s) for s in found], [shingles.set_id(s) for s in found], [[] for _ in found]
        if extra:
            often[-1] = extra
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(often, kind)], names=["doc_id", "row", "n", "node", "often"])

    last = None
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            some = b.slice(at, 1000)
            found = _sets_of(some, 2)
            if last is not None:
                yield out(*last, frequent() if sum(map(len, held)) > SPAN else [])
            last = some, found
            held += found
    if last is not None:
        yield out(*last, frequent())


def _posting(frequent: np.ndarray, rank: np.ndarray, small: int):
    """Rows of a node with the keys of its subsets and of its prefix, once in a task."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                nodes, sizes, rare, subsets, prefixes, sketches = [], [], [], [], [], []
                for s in _sets_of(b.slice(at, 1000), 0):
                    n, node = len(s), shingles.set_id(s)
                    if not n or node in seen:
                        continue
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(n)
                    rare.append(n)
                    sketches.append(_sketch(s))
                    subsets.append(_subsets(s, small) if n <= small else [])
                    if n <= small and 5 * n < 4 * (small + 1):
                        prefixes.append([])
                        continue
                    p = prefix_length(n)
                    if len(frequent):
                        at_ = np.searchsorted(frequent, s)
                        at_[at_ == len(frequent)] = 0
                        common = frequent[at_] == s
                        rare[-1] -= int(common.sum())
                        if common.any():
                            those = s[common]
                            s = np.concatenate((s[~common], those[np.lexsort((those, rank[at_[common]]))]))
                    prefixes.append(s[:p].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), pa.array(subsets, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["node", "n", "rare", "subsets", "prefix", "sketch"])

    return run


def _subsets(s: np.ndarray, small: int) -> list[int]:
    """Keys (sizes n <= m, subset) of a set; the lowest bit tells whether the set has the smaller size."""
    n, out = len(s), []
    values = shingles.mix(s)
    for m in range(1, small + 1):
        if compatible(n, m):
            tag = (min(n, m) << 8 | max(n, m)) * 0x9E3779B97F4A7C15
            for part in combinations(values.tolist(), required(n, m)):
                x = shingles.mix(np.array([(sum(part) + tag) & 0xFFFFFFFFFFFFFFFF], np.uint64))
                out.append(int(x.view(np.int64)[0]) & ~1 | (n <= m))
    return out


def _sketch(s: np.ndarray) -> np.ndarray:
    """A bitmap of a set, of two to four bits for each member, in words of 64 bits."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s >> np.uint64(17)) & np.uint64(bits - 1)] = 1
    return np.packbits(out).view(np.int64)


#: Members of a list by what comes before their key, then by their node.
_ORDER = "shiftleft(cast(least(before, 1000000) as bigint), 40) | (node & 1099511627775)"
#: n and m are compatible, and what is left after the shared positions can reach the required intersection.
_FILTER = "5 * least(n, m) >= 4 * greatest(n, m) and 9 * (1 + least(n - 1 - pos, m - 1 - mpos)) >= 4 * (n + m)"
#: A member may be the smaller of two that link: what is left after its position can hold eight ninths of it.
_SMALLER = "9 * (n - pos) >= 8 * n"
#: Where all that have not met do so: of two that are pivots one goes to the other, and two that share the key before this one have met, or
#: meet, in that key's list. Positions there are lower, so it leaves no less room for a link.
_ONCE = "(root = main or node < mnode) and coalesce(prev != mprev, true)"
#: Members of x that y cannot have: bits that only x has, the longer bitmap being folded to the other's length.
_ONLY = "aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p & ~q)), 0, (t, c) -> t + c)"
_FOLDED = "if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p | q), {x})"


def band(n: int) -> int:
    """Sizes that are compatible are in the same band or in adjacent ones."""
    return floor(log(n) / log(1.25))


@cache
def parts_of(b: int) -> tuple[int, int]:
    """Parts of the sets whose larger partner is in a band, and how many more they are than needed for one to agree.

    Linked sets of sizes up to u differ in no more than 2 u / 9 shingles.
    """
    differ = 2 * ceil(1.25 ** (b + 1)) // 9
    spare = (differ + 1) // 8 + 1
    return differ + 1 + spare, spare


def _part_keys(s: np.ndarray) -> np.ndarray:
    """Keys of the parts of a set, as the larger or equal one of a pair and as the smaller one.

    Linked sets agree on more parts than are spare, so a set with no more empty parts than that leaves those out.
    """
    out = []
    for b in (band(len(s)), band(len(s)) + 1):
        parts, spare = parts_of(b)
        x = shingles.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5 + b))
        at = (x % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, shingles.mix(x))
        keys = shingles.mix(sums + shingles.mix(np.arange(parts, dtype=np.uint64) + np.uint64(b << 32 | 1)))
        full = np.bincount(at, minlength=parts) > 0
        out.append(keys[full] if parts - int(full.sum()) <= spare else keys)
    return np.concatenate(out)


def _emit(value, name: str):
    """Rows of a node and an array made of its set, once in a task."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                nodes, values = [], []
                for s in _sets_of(b.slice(at, 1000), 0):
                    node = shingles.set_id(s)
                    if len(s) and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        values.append(value(s).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["node", name])

    return run


def _keys(rows: DataFrame, keys: str, *columns: str) -> DataFrame:
    """A row for each key: its position and the key before it, null for the first."""
    each = F.transform(keys, lambda key, i: F.struct(i.alias("pos"), key.alias("key"), F.get(keys, i - 1).alias("prev")))
    return rows.select(*columns, F.inline(each))


def _some_or_all(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def _with_nodes(pairs: DataFrame, by: str, values: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``pairs`` with the values of the node in column ``by``; pairs of hot nodes are dealt to parts.

    Only values of nodes that the column has are sent, and copies of a node's row become one where they meet the pairs.
    ``ids`` are the same pairs without what else they carry.
    """
    ends = stored((pairs if ids is None else ids).groupBy(by).agg((F.count("*") > HOT).alias("hot")), "ends")
    n, k = ends.agg(F.count("*"), F.count_if("hot")).first()
    sent, at = values.join(_some_or_all(ends, n), by), [by]
    if k:
        hot = _some_or_all(ends.where("hot"), k)
        pairs = pairs.join(hot, by, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
        sent, at = sent.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))), [by, "salt"]
    sent = sent.groupBy(*at).agg(*[F.first(c).alias(c) for c in values.columns if c != by])
    return pairs.join(sent, at).drop("salt")


class _Join:
    """The steps of one join; each holds what later ones need in shared storage."""

    def __init__(self, docs: DataFrame, row: Column | None = None):
        texts = docs.select("doc_id", (F.lit(0).cast("bigint") if row is None else row).alias("row"), "text")
        self.texts = with_settings(texts, **{"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS})
        self.info = stored(self.texts.mapInArrow(frugal(_describe), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row bigint, n bigint, node bigint, often array<struct<s:bigint,c:bigint>>"), "sets")
        total = self.info.agg(F.sum("n")).first()[0] or 0
        most = min(MOST_FREQUENT, max(LEAST_FREQUENT, total // FREQUENT_SHARE))
        top = self.info.select(F.explode("often").alias("x")).groupBy("x.s").agg(F.sum("x.c").alias("c")).orderBy(F.desc("c"), "s").limit(most).toPandas()
        values, counts = top["s"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
        order = np.argsort(values)
        self.frequent, self.rank = values[order], counts[order]
        histogram = {r.n: r.k for r in self.info.where(F.col("n").between(1, MOST_SMALL)).groupBy("n").agg(F.count("*").alias("k")).collect()}
        self.small = boundary(histogram)
        self.checked: DataFrame | None = None
        self.held: list[DataFrame] = []

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        """A table that is only needed until the roots are known."""
        self.held.append(stored(df, name))
        return self.held[-1]

    def roots(self) -> DataFrame:
        """node and root, for the nodes that link with another."""
        post = self._stored(self.texts.select("text").mapInArrow(frugal(_posting(self.frequent, self.rank, self.small)), "node bigint, n int, rare int, subsets array<bigint>, prefix array<bigint>, sketch array<bigint>"), "postings")
        self.postings = post.agg(F.sum(F.size("prefix"))).first()[0] or 0
        self.sketches = post.select("node", "n", "sketch")
        pairs, members = self._scanned(_keys(post, "prefix", "node", "n").withColumn("before", F.col("pos")))
        roots = stored(components(self._subset_links(post).unionByName(self._tested(pairs))), "roots")
        roots, unmet = self._rounds(members, roots, ROUNDS)
        several = None if unmet is None else self._stored(members.join(unmet.select("key").distinct(), "key", "left_semi").select("node").distinct(), "nodes")
        if several is not None:
            some = _some_or_all(several, several.count())
            rows = self._texts_of(several).mapInArrow(frugal(_emit(_part_keys, "keys")), "node bigint, keys array<bigint>").join(some, "node", "left_semi")
            rare = post.join(some, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.min("rare").alias("before"))
            rows = self._stored(rows.join(rare, "node"), "parts")
            pairs, members = self._scanned(_keys(rows, "keys", "node", "n", "before").withColumn("pos", F.lit(0)))
            roots, _ = self._rounds(members, self._merged(roots, self._tested(pairs)))
        dropped(*self.held)
        return roots

    @staticmethod
    def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        return roots if links.isEmpty() else merged(roots, links)

    @staticmethod
    def _subset_links(post: DataFrame) -> DataFrame:
        rows = post.select("node", F.explode("subsets").alias("x")).select("node", F.shiftright("x", 1).alias("key"), (F.col("x").bitwiseAND(F.lit(1)) == 1).alias("low"))
        pivots = rows.where("low").groupBy("key").agg(F.min("node").alias("a"))
        return rows.join(pivots, "key").where("a != node").select("a", F.col("node").alias("b"))

    def _scanned(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of the members of each list (node, key, before, prev), all of short ones and those with the pivot of longer ones, and
        the members of the longer ones. The pivot has the least of ``before``."""
        lists = rows.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("a"), F.max("node").alias("b"), F.max(F.expr(_SMALLER)).alias("any"))
        lists = self._stored(lists.where("a < b and any").select("key", "k", "a", "b"), "lists")
        more = lists.where("k > 2").select("key", "k")
        packed = rows.select("key", "node", "prev", F.expr("shiftleft(cast(n as bigint), 32) | pos").alias("place"), F.expr(_ORDER).alias("order"))
        members = self._stored(packed.join(_some_or_all(more, more.count()), "key").select("key", "k", "node", "prev", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), "order"), "members")
        members = members.withColumn("smaller", F.expr(_SMALLER))
        short = members.where(F.col("k") <= NEAR).groupBy("key").agg(F.collect_set(F.struct("node", "n", "pos")).alias("x"))
        short = short.select(F.explode("x").alias("p"), "x").select("p.*", F.explode("x").alias("q")).select("node", "n", "pos", F.col("q.node").alias("mnode"), F.col("q.n").alias("m"), F.col("q.pos").alias("mpos"))
        long = members.where(F.col("k") > NEAR)
        pivots = long.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("mnode"), F.col("n").alias("m"), F.col("pos").alias("mpos")), "order").alias("p")).select("key", "p.*")
        star = long.drop("k", "prev").join(_some_or_all(pivots, pivots.count()), "key")
        return lists.where("k = 2").select("a", "b").unionByName(self._pairs(short.where("node < mnode"))).unionByName(self._pairs(star)).distinct(), self._stored(long.drop("k").distinct(), "long")

    @staticmethod
    def _pairs(met: DataFrame) -> DataFrame:
        return met.where("node != mnode").where(_FILTER).select(F.least("node", "mnode").alias("a"), F.greatest("node", "mnode").alias("b"))

    def _several(self, rooted: DataFrame) -> DataFrame:
        """Lists that hold several classes, with their largest class."""
        rows = rooted.groupBy("key", "root").agg(F.count("*").alias("k"), F.max("smaller").alias("any"))
        rows = rows.groupBy("key").agg(F.max_by("root", "k").alias("main"), F.count("*").alias("classes"), F.max("any").alias("any"), F.sum("k").alias("size"))
        return self._stored(rows.where("classes > 1 and any").select("key", "main", "size"), "several")

    @staticmethod
    def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
        return members.join(_some_or_all(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def _texts_of(self, nodes: DataFrame) -> DataFrame:
        """Texts whose sets are these nodes, one for each; others may come with them."""
        ids = self._stored(self.info.where("n > 0").join(_some_or_all(nodes, nodes.count()), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "wanted")
        some = ids.select("doc_id").distinct()
        return self.texts.join(_some_or_all(some, ids.count()), "doc_id", "left_semi").select("text").unionByName(self.texts.where("doc_id is null").select("text"))

    def _tested(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes a, b that link, by their whole sets; pairs tested before are left out."""
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = self._stored(pairs, "pairs")
        self.checked = pairs if self.checked is None else self.checked.unionByName(pairs)
        possible = pairs if pairs.isEmpty() else self._stored(self._possible(pairs), "possible")
        if possible.isEmpty():
            return possible
        nodes = self._nodes(possible)
        members = self._texts_of(nodes).mapInArrow(frugal(_emit(lambda s: s, "members")), "node bigint, members array<bigint>")
        members = self._stored(members.join(_some_or_all(nodes, nodes.count()), "node", "left_semi"), "members")
        second = _with_nodes(possible, "b", members.select(F.col("node").alias("b"), F.col("members").alias("y")))
        both = _with_nodes(second, "a", members.select(F.col("node").alias("a"), F.col("members").alias("x")), possible)
        shared = F.size(F.array_intersect("x", "y"))
        return self._stored(both.where(100 * shared >= 80 * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links")

    def _nodes(self, pairs: DataFrame) -> DataFrame:
        """The nodes of some pairs."""
        return self._stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose bitmaps leave room for a link: members that show in one bitmap only are in one set only."""
        maps = self.sketches
        both = _with_nodes(_with_nodes(pairs, "b", maps.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y0"))), "a", maps.select(F.col("node").alias("a"), "n", F.col("sketch").alias("x0")), pairs)
        both = both.where("5 * least(n, m) >= 4 * greatest(n, m)").withColumn("x", F.expr(_FOLDED.format(x="x0", y="y0"))).withColumn("y", F.expr(_FOLDED.format(x="y0", y="x0")))
        most = f"least(n - {_ONLY.format(x='x', y='y')}, m - {_ONLY.format(x='y', y='x')})"
        return both.where(f"9 * {most} >= 4 * (n + m)").select("a", "b")

    def _rounds(self, members: DataFrame, roots: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Roots after rounds in which pivots of each list, from other classes than its largest, meet its members, and the
        members (key, node) of other classes that have not been pivots then: None if there are none."""
        met, pivots, rounds = None, 1, 0
        while True:
            rooted = self._rooted(members, roots)
            lists = self._several(rooted)
            open_ = self._stored(rooted.join(_some_or_all(lists, lists.count()), "key"), "open")
            left = open_.where("root != main")
            if met is not None:
                left = left.join(met, ["key", "node"], "left_anti")
            if rounds == most:
                left = self._stored(left.select("key", "node"), "unmet")
                return roots, None if left.isEmpty() else left
            meetings = left.groupBy("key").agg(F.count("*").alias("k"), F.first("size").alias("size")).agg(F.sum(F.col("k") * F.col("size"))).first()[0]
            if not meetings:
                return roots, None
            last = meetings <= max(LEAST_MEETINGS, MEETINGS * self.postings)
            dealt = F.col("node") if last else F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots))
            here = left.groupBy("key", dealt.alias("r")).agg(F.min_by(F.struct(F.col("node").alias("mnode"), F.col("n").alias("m"), F.col("pos").alias("mpos"), F.col("root").alias("mroot"), F.col("prev").alias("mprev")), "order").alias("p"))
            here = self._stored(here.select("key", "p.*"), "pivots")
            meeting = open_.join(_some_or_all(here, here.count()), "key").where("root != mroot")
            if last:
                meeting = meeting.where(_ONCE)
            pairs = self._pairs(meeting).distinct()
            roots = self._merged(roots, self._tested(pairs))
            if last:
                return roots, None
            now = here.select("key", F.col("mnode").alias("node"))
            met, pivots, rounds = now if met is None else met.unionByName(now), pivots * MORE, rounds + 1


def _nodes_with_class(join: _Join, first: Column) -> DataFrame:
    """node and the first row of its class, for each set that is not empty."""
    roots = join.roots()
    firsts = join.info.where("n > 0").groupBy("node").agg(F.min(first).alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = firsts.groupBy("root").agg(F.min("first").alias("best"))
    return firsts.join(lowest, "root").select("node", "best")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``."""
    join = _Join(docs)
    named = _nodes_with_class(join, F.col("doc_id")).withColumnRenamed("best", "component_id")
    return join.info.select("doc_id", "n", "node").join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _row_hash(docs: DataFrame) -> Column:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return F.xxhash64(*[docs[c].cast("string") if "map<" in kinds[c] or "variant" in kinds[c] else docs[c] for c in docs.columns])


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, with all its columns; see the module for which."""
    join = _Join(docs, _row_hash(docs))
    named = _nodes_with_class(join, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    rows = join.info.where("n > 0").select("doc_id", "row", "node").join(named, "node")
    best = F.col("row") == F.col("best.row")
    row, other = fresh(docs, "row", "other")
    counts = rows.groupBy(F.col("row").alias(other), best.alias("best")).agg(F.count("*").alias("k")).where("not best or k > 1")
    counts = stored(counts.select(other, "best"), "gone")
    gone, again = counts.where("not best").select(other), counts.where("best").select(other)
    dropped(*join.held)
    kept = docs.withColumn(row, _row_hash(docs))
    kept = kept.join(_some_or_all(gone, gone.count()), F.col(row) == F.col(other), "left_anti")
    if n := again.count():
        again = _some_or_all(again, n)
        repeated = kept.join(again, F.col(row) == F.col(other), "left_semi").dropDuplicates([row])
        kept = kept.join(again, F.col(row) == F.col(other), "left_anti").unionByName(repeated)
    return kept.drop(row)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""
}
