"""Near duplicates by MinHash with tensored banding.

Two small collections of partial keys, each made of a few minhashes, are combined pairwise into table keys: ``m`` partial
keys of either collection give ``m * m`` tables for ``2 * m * rows`` minhashes, where separate tables would need
``m * m * 2 * rows``. Documents with the same set of shingles are one node. Nodes that share a table key are candidates,
and every link is confirmed on the full sets.

Groups are settled without all their pairs. Each bucket is first compared with its smallest member, then members that
are still in different components with a few members drawn for each bucket; what is linked becomes one component.
At last all pairs of a bucket across components whose parity bits agree enough are compared, so no link is lost: a pair left
out is one whose ends are already connected.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procatlas.llm.store import stored

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct word shingles.

    Words are runs of characters that are not ASCII white space, with A-Z lowered. A text with fewer words than
    ``width`` is one shingle, a text without words none.
    """

    def __init__(self, width: int, memo: int = 300_000):
        import xxhash

        self.width, self.limit, self.hash, self.words = width, memo, xxhash.xxh3_64_intdigest, OrderedDict()

    def word_hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        known = self.words
        if len(known) > self.limit:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = self.hash(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        words = self.word_hashes(text)
        width = min(self.width, len(words))
        if not width:
            return words
        count = len(words) - width + 1
        out = np.full(count, width, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                out = _mixed(out * _STEP + words[k : k + count])
        return np.unique(out)


class Signer:
    """Minhashes of shingle sets, and the partial keys made of them."""

    def __init__(self, keys: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.keys, self.rows = keys, rows
        self.masks = rng.integers(0, 2**63, size=2 * keys * rows, dtype=np.uint64)

    def minhashes(self, shingles: np.ndarray, block: int = 4096) -> np.ndarray:
        lowest = np.full(len(self.masks), np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(shingles), block):
                mixed = (shingles[None, i : i + block] ^ self.masks[:, None]) * _MIX
                mixed ^= mixed >> np.uint64(31)
                mixed *= _STEP
                lowest = np.minimum(lowest, mixed.min(axis=1))
        return lowest

    def partial(self, minhashes: np.ndarray) -> np.ndarray:
        """The ``2 * keys`` partial keys: the first half is one collection, the second the other."""
        rows = minhashes.reshape(2 * self.keys, self.rows)
        out = np.zeros(2 * self.keys, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.rows):
                out = _mixed(out * _STEP + rows[:, k])
        return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int64()))])
_SIGNED_DDL = "doc_id long, n_shingles long, set_hash binary, first array<long>, second array<long>"


def _signed(docs: DataFrame, width: int, keys: int, rows: int) -> DataFrame:
    def sign(batches):
        import xxhash

        shingler, signer = Shingler(width), Signer(keys, rows)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = shingler.shingles(text.as_py())
                partial = signer.partial(signer.minhashes(shingles)).view(np.int64)
                row = (doc_id, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), partial[:keys], partial[keys:])
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _SIGNED)], schema=_SIGNED)

    return docs.mapInArrow(sign, _SIGNED_DDL)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """4096 bits: whether an odd number of shingles falls on each.

    Two sets differ in at least as many shingles as their bits differ, since what they share cancels out.
    """
    odd = np.bincount((shingles >> np.uint64(52)).astype(np.int64), minlength=4096) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", longs), ("bits", longs)])

    def shingle(batches):
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler.shingles(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([x.view(np.int64) for x in sets], type=longs), pa.array([parity_bits(x) for x in sets], type=longs)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(shingle, "doc_id long, shingles array<long>, bits array<long>")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of undirected ``a, b`` links of longs: the smallest node reachable. Nodes without links have no row.

    Each round joins every node to the smallest neighbour of its neighbours (large star, then small star), which
    roughly squares what is reached; every round is written, so a lost executor repeats no earlier round.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "star-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = stored(small, "star-links")
        now = edges.selectExpr("count(*)", "sum(hash(a, b) * 1L)", "sum(b % 1000003)").first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, keys: int = 10, rows: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Linked are documents with ``100 * intersection >= percent * union`` of their shingle sets. ``component_id`` is the
    smallest id reachable over links, the row's own included, and ``kept`` whether it is the row's own. Null and empty texts
    and texts without words have no shingles and no links. Rows that share an id count as one document with
    several texts, each row with its own ``n_shingles``; rows without an id are never linked, have a null component and are
    kept. Other columns are ignored, and an empty table gives an empty result.

    With similarity s, two documents become candidates with probability ``(1 - (1 - s ** rows) ** keys) ** 2``: 0.9985 at
    0.8 by default. Candidates whose sets must differ in too much, as their parity bits show, are not compared in full,
    which loses none.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = stored(_signed(slim, width, keys, rows), "near-signed")
    linked = base.filter("doc_id is not null and n_shingles > 0")
    nodes = linked.groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    placed = stored(linked.select("doc_id", "n_shingles", "set_hash").join(nodes, "set_hash").select("doc_id", "n_shingles", "node"), "near-rows")
    repeated = placed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last")
    ties = placed.join(repeated, "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b")
    found = placed.join(_components(slim, base, ties, width, percent), "node", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    rest = base.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rest.unionByName(found).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, base: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, component`` of all nodes that have a link; ``links`` are some that hold already."""
    linked = base.filter("doc_id is not null and n_shingles > 0")
    nodes = linked.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"))
    signed = stored(linked.join(nodes, ["set_hash", "doc_id"], "left_semi").dropDuplicates(["set_hash", "doc_id"]), "near-nodes")

    halves = signed.select("doc_id", "n_shingles", F.posexplode("first").alias("i", "x"), "second").select("doc_id", "n_shingles", "i", "x", F.posexplode("second").alias("j", "y"))
    keyed = halves.select("doc_id", F.col("n_shingles").alias("n"), F.xxhash64("i", "x", "j", "y").alias("key"))
    order = Window.partitionBy("key").orderBy("doc_id")
    members = keyed.select("key", "doc_id", "n", F.min("doc_id").over(order).alias("leader"), F.lead("doc_id").over(order).alias("next"))
    members = stored(members.filter("leader <> doc_id or next is not null").drop("next"), "near-members")

    wanted = members.select("doc_id").distinct()
    sets = stored(_sets(docs.filter("doc_id is not null").join(wanted, "doc_id", "left_semi").select("doc_id", "text"), width).dropDuplicates(["doc_id", "shingles"]), "near-sets")
    sketches = sets.select("doc_id", F.size("shingles").alias("n_shingles"), "bits")

    def alike(n_one: str, n_other: str, one: str, other: str) -> Column:
        """Whether so few bits differ that the sets may be linked."""
        differ = F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        return differ * (100 + percent) <= (F.col(n_one) + F.col(n_other)) * (100 - percent)

    def like_sized(one: Column | str, other: Column | str) -> Column:
        return F.least(one, other) * 100 >= F.greatest(one, other) * percent

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs ``a, b``."""
        left, right = (sketches.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"m_{x}")) for x in "ab")
        near = pairs.join(left, "a").join(right, "b").filter(like_sized("n_a", "n_b") & alike("n_a", "n_b", "m_a", "m_b")).select("a", "b").distinct()
        full = near.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s_a")), "a")
        shared = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - shared
        return stored(full.filter(shared * 100 >= union * percent).select("a", "b").distinct(), "near-links")

    def in_groups(groups: DataFrame) -> DataFrame:
        """The members with the component ``c`` they are in."""
        return members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")

    def led(groups: DataFrame, draws: range) -> DataFrame:
        """One pair of a node with each other component among the drawn members of its buckets that are like it in size.

        Only buckets of several components are asked. A bucket's draws differ from those of other buckets, so a node that is like part of a crowd meets many of it.
        """
        now = in_groups(groups)
        drawn = [F.min_by(F.struct(F.col("doc_id"), F.col("c"), F.col("n")), F.xxhash64("key", "doc_id", F.lit(k))).alias(f"d{k}") for k in draws]
        several = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), *drawn).filter("low < high")
        several = several.select(F.col("key").alias("bucket"), F.array_distinct(F.array(*[f"d{k}" for k in draws])).alias("drawn"))
        other = F.filter("drawn", lambda d: (d["c"] != F.col("c")) & like_sized(F.col("n"), d["n"]))
        met = now.join(several, (F.col("key") == F.col("bucket")) & (F.size(other) > 0)).select("doc_id", "n", F.explode(other).alias("d"))
        # Of another component's members that a node meets, in whatever buckets, the one nearest in size stands for all.
        once = met.groupBy("doc_id", F.col("d.c").alias("c")).agg(F.min(F.struct(F.abs(F.col("n") - F.col("d.n")).alias("gap"), F.col("d.doc_id").alias("doc_id"))).alias("near"))
        return once.select(F.least("doc_id", "near.doc_id").alias("a"), F.greatest("doc_id", "near.doc_id").alias("b")).distinct()

    def across(groups: DataFrame) -> DataFrame:
        """In each bucket, all pairs across components that may be links; one end is not with the bucket's smallest member."""
        now = in_groups(groups).join(groups.select(F.col("node").alias("leader"), F.col("component").alias("c_leader")), "leader", "left")
        now = now.withColumn("stray", F.col("c") != F.coalesce("c_leader", "leader"))
        mixed = now.filter("stray").select("key").distinct()
        now = now.join(mixed, "key", "left_semi").select("key", "doc_id", "n", "c", "stray")
        now = now.join(sketches.select("doc_id", F.col("bits").alias("m")), "doc_id")
        side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("c", "n", "m")]
        strays = now.filter("stray").select("key", F.col("doc_id").alias("a"), *side("a"))
        others = now.select(F.col("key").alias("bucket"), F.col("doc_id").alias("b"), "stray", *side("b"))
        once = ~F.col("stray") | (F.col("a") < F.col("b"))
        found = strays.join(others, (F.col("key") == F.col("bucket")) & (F.col("c_a") != F.col("c_b")) & once & like_sized("n_a", "n_b") & alike("n_a", "n_b", "m_a", "m_b"))
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # First each node with the smallest member of its buckets, then across components with drawn members, twice, then all that is left.
    pairs = members.filter("leader <> doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("leader").alias("a")).select("a", "b")
    links = links.unionByName(confirmed(pairs))
    groups = components(links)
    for find in (lambda g: led(g, range(3)), lambda g: led(g, range(3, 6)), across):
        pairs = stored(find(groups), "near-pairs")
        new = pairs if pairs.isEmpty() else confirmed(pairs)
        if not new.isEmpty():
            links = links.unionByName(new)
            groups = components(links)
    return groups


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns: one document of each group, all rows without links."""
    found = near_groups(docs, width, percent, text=text, doc_id=doc_id)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, docs[doc_id] == F.col("__dropped"), "left_anti")
