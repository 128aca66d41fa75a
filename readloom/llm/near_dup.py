"""Operator 2: near duplicates from bottom-k sketches of one hash function.

1. Each text gives its set of shingles, a fingerprint of the set (128 bits) and
   the k least hash values (the sketch). Equal sets form a class with one
   representative; only representatives go on.
2. Inverted lists of the retained values give pairs that overlap. A list of at
   most ``LIST`` classes gives all its pairs, from each class's rarest lists
   (as many as hold what a linked pair has in common, see ``prefix``). Longer
   lists (a passage that many documents share, a large group of near copies)
   give no pairs among their members: each class that lies in them for the
   most part is held against one pivot of each list and band of sizes, the
   member with the fewest other values.
3. The sketch of a pair's union estimates its similarity. Pairs far below the
   threshold go (``MARGIN`` standard deviations, at least).
4. The rest is decided on full sets, in whole numbers.
5. Where a pivot's group still falls into several components, the links that
   it may hide are found exactly, from what each member's full set differs from
   the pivot's. A pair of members is linked if and only if their differences
   have enough in common, and for a member that isn't linked to the pivot that
   is one value at least. So differences are joined on their rarest values
   only, few of them (a prefix filter), and only members that can have enough
   in common with some other component take part (see ``_Apart``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import mix, row_groups, shingles, text_buffer, words
from .components import connected_components
from .narrow import marked
from .scratch import Scratch

K = 64
LIST = 32  # classes in a list that gives all its pairs
OVERLAPS = 2  # values in short lists that a pair must have in common; linked classes that differ have at least four in common
MARGIN = 5.3
BITMAP = 8  # 64-bit words
NO_ID = 2**63 - 1


def shingle_sets(rows: pa.RecordBatch, text: str, width: int) -> Iterator[np.ndarray]:
    """Each row's shingle hashes, sorted and distinct (63 bits)."""
    hashes, _, _, first = words(*text_buffer(rows.column(text)))
    whole = (shingles(hashes, width) >> np.uint64(1)).astype(np.int64) if len(hashes) >= width else np.zeros(0, np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            values = np.sort(whole[a : b - width + 1])
            yield values[np.concatenate([[True], values[1:] != values[:-1]])]
        else:
            yield (shingles(hashes[a:b], width) >> np.uint64(1)).astype(np.int64)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    x = values.astype(np.uint64)
    return int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)), int(mix(x + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64))


SKETCHES = "row long, doc_id long, h long, n long, f1 long, f2 long, sketch array<long>"


def _sketch(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_groups(batch, "text"):
                n, f1, f2, parts = [], [], [], []
                for values in shingle_sets(rows, "text", width):
                    one, two = fingerprint(values)
                    n.append(len(values))
                    f1.append(one)
                    f2.append(two)
                    parts.append(values[:k])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                columns = [rows.column("row"), rows.column("doc_id"), rows.column("h"), *(pa.array(x, pa.int64()) for x in (n, f1, f2)), sketch]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "h", "n", "f1", "f2", "sketch"])

    return run


def _sets(width: int):
    """(node, f1, f2, text) -> (node, set), only for texts that have the node's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_groups(batch, "text"):
                nodes, sets = [], []
                for node, f1, f2, values in zip(rows.column("node").to_pylist(), rows.column("f1").to_pylist(), rows.column("f2").to_pylist(), shingle_sets(rows, "text", width)):
                    if (f1, f2) == fingerprint(values):
                        nodes.append(node)
                        sets.append(values)
                if nodes:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "set"])

    return run


def estimate(one: np.ndarray, two: np.ndarray, k: int) -> float:
    """Similarity of two sets from their sketches: both are complete up to the lesser of the greatest values kept (all of a set of under ``k`` values), and so is their union."""
    upto = min(x[-1] if len(x) >= k else np.iinfo(np.int64).max for x in (one, two))
    both = np.sort(np.concatenate([one, two]))
    both = both[: np.searchsorted(both, upto, "right")]
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _near(k: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (s, at), (t, bt) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column("s"), batch.column("t")))
            for i in range(batch.num_rows):
                keep[i] = estimate(s[at[i] : at[i + 1]], t[bt[i] : bt[i + 1]], k) >= share
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def most_unshared(percent: int, n: float) -> float:
    """Of ``n`` values of a linked pair's union, those that only one side has, at most (``MARGIN`` standard deviations)."""
    t = percent / 100
    return (1 - t) * n + MARGIN * math.sqrt(n * t * (1 - t))


def prefix(percent: int, k: int) -> int:
    """Of a class's lists in any fixed order, how many hold ``OVERLAPS`` of those that it has in common with a linked class, if there are so many."""
    return math.floor(most_unshared(percent, k)) + OVERLAPS


def floor_of_estimate(percent: int, k: int) -> float:
    t = percent / 100
    return t - MARGIN * math.sqrt(t * (1 - t) / k)


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """Per row of ``documents``: row, doc_id, h (hash of the text), n_shingles, component_id, first.

    Documents are linked where 100 * common shingles >= percent * shingles of
    both, on sets of ``width``-word shingles (words: runs of characters other
    than ASCII white space, A-Z lower-cased; a text of fewer words is one
    shingle). ``component_id`` is the least doc_id reachable, ``first`` marks
    one row of each component (the least doc_id's first). Null, empty and
    blank texts have no shingles, no links and stay. Rows with equal doc_id are
    documents of their own that share an id; null ids count as greatest. Other
    columns are ignored. Runs jobs at once and returns a table's reader.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "neardup")
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = scratch.table(plain.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("text")}).mapInArrow(_sketch(width, k), SKETCHES), "sketches")
    order = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("row"), F.col("h"), F.col("n"))
    classes = sketches.where("n > 0").groupBy("f1", "f2").agg(F.min(order).alias("least"))
    classes = scratch.table(classes.select("f1", "f2", F.col("least.row").alias("node"), F.col("least.d").alias("doc_id"), "least.h", "least.n"), "classes")
    nodes = scratch.table(sketches.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "sketch"), "nodes")

    lists = nodes.select("node", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = lists.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    shared = scratch.table(shared, "shared")  # a table: Spark splits hot keys of joins between plain shuffles only
    lists = scratch.table(lists.join(shared, "value"), "lists")
    rarest = Window.partitionBy("node").orderBy("members", "value")
    ranked = lambda rows: rows.withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= prefix(percent, k))
    short = ranked(lists.where(F.col("members") <= LIST)).select("value", "node")
    pairs = short.alias("x").join(short.alias("y"), "value").where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = pairs.groupBy("a", "b").count().where(F.col("count") >= OVERLAPS).select("a", "b")

    hot = lists.where(F.col("members") > LIST)
    long_ = ranked(hot.join(_mostly_shared(hot, percent, k), "node")).select("value", "node", "n", "other")
    step = math.log(100 / percent) * (1 + 1e-6)  # sizes of linked classes differ by one step at most, and a band has three
    bands = F.array_distinct(F.array(*[F.floor((F.log("n") + F.lit(more)) / F.lit(3 * step)) for more in (0.0, step)]))
    long_ = scratch.table(long_.withColumn("band", F.explode(bands)).drop("n"), "long")
    pivot = scratch.table(long_.groupBy("value", "band").agg(F.min(F.struct("other", "node")).alias("p")).select("value", "band", F.col("p.node").alias("pivot")), "pivot")
    groups = scratch.table(long_.join(pivot, ["value", "band"]).select("node", "pivot").distinct(), "groups")
    stars = groups.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    check = _Check(plain, classes, nodes, scratch, width, percent, k)
    links = check.linked(check.near(pairs.unionByName(stars).distinct()))
    labels = connected_components(links, scratch, "components")

    named = groups.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    center = named.where("node = pivot").select("pivot", F.col("component").alias("center"))
    named = scratch.table(named.join(center, "pivot").withColumn("apart", F.col("component") != F.col("center")).drop("center"), "named")
    split = scratch.table(named.where("apart").select("pivot").distinct(), "split")
    if not split.isEmpty():
        members = scratch.table(named.join(split, "pivot", "left_semi"), "members")
        links = links.unionByName(_Apart(check, members, scratch, percent).links())
        labels = connected_components(links, scratch, "all-components")

    of_doc = classes.select("node", "doc_id")
    labelled = of_doc.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    head = F.min(F.struct("doc_id", "node")).alias("head")
    heads = labelled.groupBy("component").agg(head).select("component", F.col("head.doc_id").alias("component_id"), F.col("head.node").alias("first_row"))
    of_class = labelled.join(heads, "component").select("node", "component_id", "first_row")
    of_class = classes.select("f1", "f2", "node").join(of_class, "node").select("f1", "f2", "component_id", "first_row")
    rows = sketches.select("row", "doc_id", "h", "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2")
    out = rows.join(of_class, ["f1", "f2"], "left").select(
        "row", "doc_id", "h", F.col("n").alias("n_shingles"),
        F.when(F.col("first_row").isNull(), F.col("doc_id")).otherwise(F.nullif("component_id", F.lit(NO_ID))).alias("component_id"),
        (F.col("first_row").isNull() | (F.col("first_row") == F.col("row"))).alias("first"),
    )
    return scratch.last(out, "out")


def _mostly_shared(hot: DataFrame, percent: int, k: int) -> DataFrame:
    """node, other: classes with so few values outside long lists that they may share none, or one, of those with a linked class.

    A whole set (fewer than ``k`` values) may differ from a linked one in a
    share of its own size, and a sketch cut at ``k`` may lack some of its values.
    """
    t = percent / 100
    cut = F.when(F.col("kept") > t * k, 0.65).otherwise((1 - t) / t + 1e-9) * F.col("kept")
    few = F.when(F.col("kept") < k, F.floor(cut)).otherwise(math.floor(most_unshared(percent, k))) + OVERLAPS - 1
    return hot.groupBy("node").agg((F.first("kept") - F.count("*")).alias("other"), F.first("kept").alias("kept")).where(F.col("other") <= few).select("node", "other")


def without_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each component, the first; texts without shingles all stay. Rows equal in id and text count as one."""
    found = near_duplicates(documents, width, percent).where("n_shingles > 0")
    keyed = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "h", "first")
    state = keyed.groupBy("doc", "h").agg(F.max("first").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    tagged = documents.select(F.struct("*").alias("given"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("h"))
    tagged = marked(tagged, F.xxhash64("doc", "h"), state, F.xxhash64("doc", "h"), "hit")
    met = tagged.where("hit").join(state, ["doc", "h"], "left")
    once = met.where("stays").dropDuplicates(["doc", "h"]).select("given.*")
    return tagged.where("not hit").select("given.*").unionByName(met.where("stays is null").select("given.*")).unionByName(once)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


class _Check:
    """Estimates and then decides pairs of classes."""

    def __init__(self, plain: DataFrame, classes: DataFrame, nodes: DataFrame, scratch: Scratch, width: int, percent: int, k: int):
        self.plain, self.classes, self.nodes, self.scratch = plain, classes, nodes, scratch
        self.width, self.percent, self.k = width, percent, k

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches may belong to linked classes."""
        pairs = self.scratch.table(pairs, "pairs")
        held = self.nodes.join(_ends(pairs), "node", "left_semi")
        near = pairs.join(held.select(F.col("node").alias("a"), F.col("sketch").alias("s")), "a").join(held.select(F.col("node").alias("b"), F.col("sketch").alias("t")), "b")
        near = near.select("a", "b", "s", "t").mapInArrow(_near(self.k, floor_of_estimate(self.percent, self.k)), "a long, b long")
        return self.scratch.table(near, "estimated")

    def linked(self, near: DataFrame) -> DataFrame:
        """Pairs that are linked, by their full sets."""
        sets = self.sets(_ends(near), "ends")
        both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
        common, sizes = F.size(F.array_intersect("s", "t")), F.size("s") + F.size("t")
        return self.scratch.table(both.where(100 * common >= self.percent * (sizes - common)).select("a", "b"), "links")

    def sets(self, wanted: DataFrame, tag: str) -> DataFrame:
        """node, set of the wanted classes, each from one row that has its representative's id and text."""
        wanted = self.scratch.table(self.classes.join(wanted, "node", "left_semi"), f"wanted-{tag}")
        key = F.xxhash64("doc_id", "h")
        texts = self.plain.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        texts = marked(texts, key, wanted, key, "hit").where("hit").drop("hit").dropDuplicates(["doc_id", "h"])
        texts = texts.join(wanted, ["doc_id", "h"]).select("node", "f1", "f2", "text")
        return self.scratch.table(texts.mapInArrow(_sets(self.width), "node long, set array<long>"), f"sets-{tag}")


class _Apart:
    """Links between different components of a pivot's group, from differences of full sets.

    Let d(x) be what a member's set x and the pivot's p don't have in common. As
    x and y differ by |d(x)| + |d(y)| - 2 |d(x) & d(y)| shingles, they are linked
    if and only if 2q |d(x) & d(y)| >= w(x) + w(y), where q = 100 + percent and
    w(x) = q |d(x)| - (100 - percent) |x|. A member apart from the pivot's
    component has w(x) > -w(p), and w(p) is the least of all, so the right side
    is above 0: such a pair shares values of its differences. Values that one
    member alone has drop out; a member that has u left can share u at most, so
    z(x) = 2q u(x) - w(x) must reach w(y), and the other way round. Of the u
    values, in any fixed order, all but the last (least number to share) - 1 are
    a prefix in which some shared value must lie; the rarest come first. Pairs
    that meet there are held against each other's bitmaps of all u values before
    they leave the join: what is shared has a bit in both, or is one of the
    values that fell on a bit with another, of either side.
    """

    def __init__(self, check: _Check, members: DataFrame, scratch: Scratch, percent: int):
        self.check, self.members, self.scratch = check, members, scratch
        self.q, self.r = 100 + percent, 100 - percent

    @staticmethod
    def _bits(values: Column, word: int) -> Column:
        """Word of a bitmap with a bit for each of some hashed values."""
        bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        mine = F.filter(values, lambda v: F.pmod(F.shiftright(v, 6), F.lit(BITMAP)) == word)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda all_, v: all_.bitwiseOR(bit(v)))

    def links(self) -> DataFrame:
        table = self.scratch.table
        sets = self.check.sets(self.members.select("node").distinct(), "members")
        diffs = self.members.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("set").alias("p")), "pivot")
        differ = F.concat(F.array_except("set", "p"), F.array_except("p", "set"))
        diffs = diffs.select("pivot", "node", "component", "apart", F.size("set").alias("n"), differ.alias("d"))
        diffs = table(diffs.withColumn("w", F.lit(self.q).cast("long") * F.size("d") - F.lit(self.r).cast("long") * F.col("n")), "diffs")
        each = diffs.select("pivot", "node", F.explode("d").alias("value"))
        holders = table(each.groupBy("pivot", "value").agg(F.count("*").alias("holders")).where("holders > 1"), "holders")
        each = each.join(holders, ["pivot", "value"]).groupBy("pivot", "node").agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("rarest"))
        state = diffs.drop("d", "n").join(each.withColumn("u", F.size("rarest")), ["pivot", "node"])
        state = table(state.withColumn("z", 2 * self.q * F.col("u") - F.col("w")), "state")

        def least_most(rows: DataFrame, tag: str) -> DataFrame:
            return rows.groupBy("pivot").agg(F.min("w").alias(f"w_{tag}"), F.max("z").alias(f"z_{tag}"))

        bounds = table(least_most(state.where("apart"), "apart").join(least_most(state, "any"), "pivot"), "bounds")
        low, high = (F.when(F.col("apart"), F.col(f"{c}_any")).otherwise(F.col(f"{c}_apart")) for c in "wz")
        able = state.join(bounds, "pivot").withColumns({"low": low, "high": high}).where("z >= low and high >= w")
        length = F.greatest(F.lit(0), F.col("u") - F.ceil((F.col("w") + F.col("low")) / (2 * self.q)) + 1).cast("int")
        bits = [self._bits(F.col("rarest")["value"], k).alias(f"b{k}") for k in range(BITMAP)]
        able = able.select("pivot", "node", "component", "apart", "w", "z", "u", F.slice("rarest", F.lit(1), length)["value"].alias("prefix"), *bits).where(F.size("prefix") > 0)
        lost = F.col("u") - sum(F.bit_count(f"b{k}") for k in range(BITMAP))
        able = able.withColumns({"lost": lost, "value": F.explode("prefix")}).drop("prefix", "u")
        ranked = table(able, "prefixes")
        x, y = ranked.where("apart").alias("x"), ranked.alias("y")
        both = sum(F.bit_count(F.col(f"x.b{k}").bitwiseAND(F.col(f"y.b{k}"))) for k in range(BITMAP)) + F.least("x.lost", "y.lost")
        may = (2 * self.q * both >= F.col("x.w") + F.col("y.w")) & F.expr("x.component <> y.component and x.z >= y.w and y.z >= x.w and (not y.apart or x.node < y.node)")
        met = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.value") == F.col("y.value")) & may)
        met = table(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), "x.pivot").groupBy("a", "b").agg(F.min("pivot").alias("pivot")), "met")
        ends = met.select("pivot", F.col("a").alias("node")).union(met.select("pivot", F.col("b").alias("node"))).distinct()
        held = table(diffs.select("pivot", "node", "w", "d").join(ends, ["pivot", "node"], "left_semi"), "held")
        side = lambda c: held.select("pivot", F.col("node").alias(c), F.col("w").alias(f"w_{c}"), F.col("d").alias(f"d_{c}"))
        both = met.join(side("a"), ["pivot", "a"]).join(side("b"), ["pivot", "b"])
        both = both.where(2 * self.q * F.size(F.array_intersect("d_a", "d_b")) >= F.col("w_a") + F.col("w_b"))
        return table(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links-apart")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, min(r.root) = r.node AS kept
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""
