"""N-gram Jaccard join (7): components of documents whose shingle sets overlap enough.

1. A document becomes the sorted array of its distinct shingles (64-bit names). Documents with
   equal sets are one node.
2. Prefix filter: under any common order of shingles two linked sets share k of their first
   n - ceil(t * n) + k shingles (shares() says which k). The order is by name, but shingles that fill large tiles come
   last; that list is bounded (HEAVY) and changes which candidates arise, never the result.
3. Nodes that share a prefix shingle form a tile. Tiles of at most TILE nodes give the pairs of
   fitting sizes; a pair that occurs in k tiles is a candidate if hashed bitmap signatures, which
   bound the overlap from above (every bit that differs is an element that only one set has), let
   it pass. Larger tiles are banded by size and make no pairs: their nodes of neighbouring bands
   join one group of candidates, by one edge a node.
4. Groups are verified with exact intersections of sorted arrays, in blocks of at most BLOCK
   nodes, every block with the first one. A pair that is already connected through verified links
   needs no check, so a group of copies costs in proportion to its size, while no link between
   different texts is lost. Most groups of several blocks are one component then.
5. Of a group that is not, the nodes apart from its largest component are tried with all its nodes. Its
   shingles are counted: a pair has at most as many common ones (of more than TILE nodes) as the node
   that has fewer of them, and whatever a link needs beyond these are rare ones. So a pair shares enough
   rare shingles, which are small tiles like those of step 3; or both have so many common ones that these
   could do. Nodes of the latter kind are sorted by size into blocks, and blocks meet if their sizes and
   numbers of common shingles allow any link.
6. The candidate pairs that are not connected by then are verified one by one.

What is left of the square of a group's size: nodes that consist of shingles that over TILE nodes of the
group have, nine of ten of them at a similarity of 0.9, and yet do not link.

Names of sets have 128 bits (a node's name is 64 of them, remade for sets that share these alone);
shingles are compared by 64-bit names.

Defined results: null or blank text has no shingles and is linked with nothing; repeated rows
are linked (equal sets) unless empty; rows without an id get the component's id; of a component the row
of least id stays, a null id being the least; very long texts count whole; an empty table gives no rows;
other columns are ignored, or kept as they are by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_written, keyed, materialize, rejoin, small_batches
from graphloom.llm.suffix_dedup import _BYTE, mix
from graphloom.operators.connected import connected_components
from graphloom.storage import materialize_counted

TILE = 128
BLOCK = 512
#: At most so many shingles are put last, those of the largest tiles of LARGE nodes or more.
HEAVY, LARGE = 200_000, 16
#: So many names that different sets share are dealt with.
SHARED = 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str | None], size: int, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """The sorted distinct shingle names of each text, as int64."""
    group, held = [], 0
    for k, text in enumerate(texts):
        group.append((text or "").encode().translate(_LOWER))
        held += len(group[-1])
        if held >= chunk or k + 1 == len(texts):
            yield from _sets(group, size)
            group, held = [], 0


def _sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    buf = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = ~_SPACE[buf]
    begin = np.flatnonzero(word & np.r_[True, ~word[:-1]]) if len(buf) else np.empty(0, dtype=np.int64)
    at = np.arange(len(buf)) - np.maximum.accumulate(np.where(word & np.r_[True, ~word[:-1]], np.arange(len(buf)), 0))
    letters = np.where(word, mix(_BYTE[buf], at), np.uint64(0))
    names = mix(np.add.reduceat(letters, begin), 1) if len(begin) else np.empty(0, dtype=np.uint64)
    first = np.searchsorted(begin, np.r_[0, ends])
    rows = names[: max(len(names) - size + 1, 0)].copy()
    for i in range(1, size):
        rows = mix(rows, names[i : i + len(rows)])
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(rows[a : b - size + 1].view(np.int64))
        elif b > a:
            one = mix(names[a : a + 1], int(b - a))
            for x in names[a + 1 : b]:
                one = mix(one, x)
            yield one.view(np.int64)
        else:
            yield np.empty(0, dtype=np.int64)


def set_names(s: np.ndarray, again: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Two 64-bit names of a set: equal sets have equal names. again: first names that different sets
    have; there the second name is mixed in."""
    names = [mix(np.atleast_1d(mix(s.view(np.uint64), seed).sum(dtype=np.uint64)), len(s)) for seed in (7, 8)]
    u, u2 = (int(x.view(np.int64)[0]) for x in names)
    return (int(mix(*names).view(np.int64)[0]) if u in again else u), u2


def shares(n):
    """So many prefix shingles have to be shared: a longer prefix that shares more rules out texts that have only a passage in common."""
    return 1 + n // 32


def prefix_length(n: int, num: int, den: int) -> int:
    """Two linked sets share shares(n), n of the smaller one, of so many first elements. A set so
    small that one more element breaks a link has links with equal sets only, and needs none."""
    if den * n < num * (n + 1):
        return 0
    return min(n, n - -(-n * num // den) + shares(n))


def bitmap(s: np.ndarray) -> bytes:
    """Hashed signature; the number of bits follows the size, from 512 to 4096."""
    bits = 1 << min(12, max(9, int(len(s)).bit_length()))
    on = np.zeros(bits, dtype=np.uint8)
    on[(mix(s.view(np.uint64), 11) >> np.uint64(40)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(on).tobytes()


def needed(a, b, num: int, den: int):
    """Least overlap of linked sets of a and b elements: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


class Forest:
    """Union-find over node names."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _folded(map_: bytes, width: int) -> np.ndarray:
    """A signature at a smaller width: its parts laid over each other."""
    words = np.frombuffer(map_, dtype=np.uint64)
    return np.bitwise_or.reduce(words.reshape(-1, width // 8), axis=0)


def _tile_pairs(token: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of fitting sizes within runs of one token. Rows are sorted by token."""
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[starts, len(token)])
    rank = np.arange(len(token)) - np.repeat(starts, size)
    after = np.repeat(size, size) - rank - 1
    left = np.repeat(np.arange(len(token)), after)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
    ok = np.minimum(n[left], n[right]) * den >= np.maximum(n[left], n[right]) * num
    return left[ok], right[ok]


def _candidates(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of small tiles that share enough tokens. tiles: token, u, n, and for step 5 h (common
    shingles) and apart: pairs of an apart node that the common shingles alone do not link."""
    rest = "h" in tiles.columns
    dealt = tiles.repartition("token").sortWithinPartitions("token")

    def pairs(b: pd.DataFrame) -> pd.DataFrame:
        u, n = b["u"].to_numpy(), b["n"].to_numpy()
        left, right = _tile_pairs(b["token"].to_numpy(), n, num, den)
        if rest:
            h, apart = b["h"].to_numpy(), b["apart"].to_numpy()
            some = apart[left] | apart[right]
            left, right = left[some], right[some]
            need = np.maximum(needed(n[left], n[right], num, den) - np.minimum(h[left], h[right]), 1)
        else:
            need = shares(np.minimum(n[left], n[right]))
        found, c = np.unique(np.c_[np.minimum(u[left], u[right]), np.maximum(u[left], u[right]), need], axis=0, return_counts=True)
        return pd.DataFrame({"v": found[:, 0], "w": found[:, 1], "need": found[:, 2], "c": c})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = pd.concat([held, b]) if held is not None else b
            token = b["token"].to_numpy()
            whole = token != token[-1]
            held = b[~whole]
            if whole.any():
                yield pairs(b[whole])
        if held is not None and len(held):
            yield pairs(held)

    found = dealt.mapInPandas(run, "v long, w long, need long, c long").groupBy("v", "w", "need").agg(F.sum("c").alias("c"))
    return found.filter("c >= need").select("v", "w")


def _bounded(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose signatures leave room for enough overlap."""
    side = lambda k: maps.select(F.col("u").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"bitmap_{k}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            differ = []
            for x, y in zip(b["bitmap_v"], b["bitmap_w"]):
                width = min(len(x), len(y))
                differ.append(int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(dtype=np.int64)))
            total = b["n_v"] + b["n_w"]
            yield b[["v", "w"]][(total - np.array(differ, dtype=np.int64)) // 2 >= needed(b["n_v"], b["n_w"], num, den)]

    return pairs.join(side("v"), "v").join(side("w"), "w").mapInPandas(run, "v long, w long")


def verify_block(u: list, sets: list[np.ndarray], label: list, first: list, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the nodes of one group. label: nodes of one label are already connected;
    first: only pairs of a first node with another node (any pair, if both are first) are looked at."""
    forest = Forest()
    known: dict = {}
    for x, l in zip(u, label):
        forest.join(x, known.setdefault(l, x))
    n = np.array([len(s) for s in sets])
    bits = 1 << min(12, max(9, int(n.max()).bit_length()))
    maps = np.zeros((len(u), bits), dtype=np.uint8)
    for i, s in enumerate(sets):
        maps[i, (mix(s.view(np.uint64), 13) >> np.uint64(40)).astype(np.int64) & (bits - 1)] = 1
    maps = np.packbits(maps, axis=1).view(np.uint64)
    order = np.argsort(n, kind="stable")
    links = []
    for i in np.flatnonzero(first):
        differ = np.bitwise_count(maps ^ maps[i]).sum(axis=1, dtype=np.int64)
        bound = (n + n[i] - differ) // 2 - needed(n, n[i], num, den)
        bound[i] = -1
        bound[np.minimum(n, n[i]) * den < np.maximum(n, n[i]) * num] = -1
        other = order[bound[order] >= 0]
        for j in other[np.argsort(-bound[other], kind="stable")]:
            if forest.find(u[i]) == forest.find(u[j]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (n[i] + n[j] - both):
                forest.join(u[i], u[j])
                links.append((u[i], u[j]))
    return links


def _verify(groups: DataFrame, keys: list[str], n_groups: int, size: int, num: int, den: int) -> DataFrame:
    """groups: keys, u, label, first, text. Groups are small but cost CPU, so they are dealt out explicitly:
    by their bytes alone Spark would put them into one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "u"], ascending=False, kind="stable").drop_duplicates("u")
        links = verify_block(pdf["u"].tolist(), list(shingle_sets(pdf["text"].tolist(), size)), pdf["label"].tolist(), pdf["first"].tolist(), num, den)
        return pd.DataFrame(links, columns=["v", "w"], dtype="int64")

    spark = groups.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    parts = max(1, min(n_groups, max(least, n_groups // 16)))
    return groups.repartition(parts, *keys).groupBy(*keys).applyInPandas(run, "v long, w long")


def _shingles(nodes: DataFrame, size: int) -> DataFrame:
    """component, u, apart, n, token: all shingles of all nodes. nodes: component, u, apart, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"].tolist(), size))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            columns = {c: np.repeat(b[c].to_numpy(), n) for c in ("component", "u", "apart")}
            yield pd.DataFrame(columns | {"n": np.repeat(n, n), "token": np.concatenate(sets)})

    return nodes.select("component", "u", "apart", "text").mapInPandas(run, "component long, u long, apart boolean, n long, token long")


def _rest(nodes: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs and verified links of step 5. nodes: component, u, label, apart, text."""
    tokens = materialize(_shingles(nodes, size))
    # Written, so that both sides of the joins are plain shuffles, which Spark can split at a common shingle.
    counts = materialize(tokens.groupBy("component", "token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    common = tokens.join(counts.filter(F.col("c") > TILE).select("component", "token"), ["component", "token"], "left_semi").groupBy("u").agg(F.count(F.lit(1)).alias("h"))
    sized = tokens.groupBy("component", "u", "apart").agg(F.max("n").alias("n")).join(common, "u", "left").select("component", "u", "apart", "n", F.coalesce("h", F.lit(0)).alias("h"))
    sized = materialize(sized)
    rare = tokens.join(counts.filter(F.col("c") <= TILE).select("component", "token"), ["component", "token"], "left_semi").join(sized.select("u", "h"), "u")
    pairs = materialize(_candidates(rare.select(F.xxhash64("component", "token").alias("token"), "u", "n", "h", "apart"), num, den))

    need = lambda a, b: F.ceil(num * (F.col(a) + F.col(b)) / (num + den))
    able = sized.withColumn("m", F.ceil(F.col("n") * num / den)).filter(F.col("h") >= need("n", "m"))
    order = ["component", "n", "h", "u"]
    ranged = materialize(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    block = F.shiftleft(F.shiftright("at", 33), 24) + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / BLOCK)
    blocks = ranged.withColumn("block", block)
    stats = blocks.groupBy("component", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("h").alias("h"), F.max("apart").alias("apart"))
    side = lambda k: stats.select("component", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "lo", "hi", "h", "apart")))
    fits = (F.col("hi_a") * den >= F.col("lo_b") * num) & (F.col("hi_b") * den >= F.col("lo_a") * num) & (F.least("h_a", "h_b") >= need("lo_a", "lo_b"))
    meet = materialize(side("a").filter("apart_a").join(side("b"), "component").filter(fits).select("component", "block_a", "block_b"))
    rows = blocks.select("component", "block", "u").join(nodes.select("u", "label", "apart", "text"), "u")
    one = lambda k, first: rows.withColumnRenamed("block", f"block_{k}").join(meet, ["component", f"block_{k}"]).select("component", "block_a", "block_b", "u", "label", "text", first.alias("first"))
    groups = one("a", F.col("apart")).unionByName(one("b", F.lit(False)))
    links = materialize(_verify(groups, ["component", "block_a", "block_b"], meet.count(), size, num, den))
    drop_written(tokens, counts, sized, ranged, meet)
    return pairs, links


def _scan(docs: DataFrame, size: int, num: int, den: int, again: frozenset[int]) -> DataFrame:
    """Each row's set: n, its names u and u2, and its prefix in the order of names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"].tolist(), size))
            names = np.array([set_names(s, again) for s in sets], dtype="int64").reshape(-1, 2)
            out = {"doc_id": b["doc_id"].astype("Int64"), "id": b["id"], "h": b["h"], "n": np.array([len(s) for s in sets], dtype="int64"), "u": names[:, 0], "u2": names[:, 1]}
            yield pd.DataFrame(out | {"prefix": [s[: prefix_length(len(s), num, den)] for s in sets]})

    return docs.mapInPandas(run, "doc_id long, id long, h long, n long, u long, u2 long, prefix array<long>")


def _prefixes(docs: DataFrame, size: int, num: int, den: int, last: np.ndarray, again: frozenset[int]) -> DataFrame:
    """token, u: prefixes in the order that puts the shingles of `last` at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens, us, ns, seen = [], [], [], set()
            for s in shingle_sets(b["text"].tolist(), size):
                k = prefix_length(len(s), num, den)
                if not k or (u := set_names(s, again)[0]) in seen:
                    continue
                seen.add(u)
                if len(last):
                    heavy = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    s = np.r_[s[~heavy], s[heavy]]
                tokens.append(s[:k])
                us.append(u)
                ns.append(k)
            token = np.concatenate(tokens) if tokens else np.empty(0, dtype=np.int64)
            yield pd.DataFrame({"token": token, "u": np.repeat(np.array(us, dtype=np.int64), ns)})

    return docs.mapInPandas(run, "token long, u long")


def _verify_pairs(pairs: DataFrame, nodes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs that link."""
    texts = lambda k: nodes.select(F.col("u").alias(k), F.col("text").alias(f"text_{k}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            links = []
            for x, y in zip(*(shingle_sets(b[f"text_{k}"].tolist(), size) for k in "vw")):
                same = len(np.intersect1d(x, y, assume_unique=True))
                links.append(den * same >= num * (len(x) + len(y) - same))
            yield b[["v", "w"]][np.array(links, dtype=bool)]

    return pairs.join(texts("v"), "v").join(texts("w"), "w").mapInPandas(run, "v long, w long")


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and id, h (the row's identity), label (of the
    component, null without shingles). Sets link when den * overlap >= num * union."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = keyed(docs).drop("row")
    again: frozenset[int] = frozenset()
    while True:
        scanned = materialize(_scan(texts, size, num, den, again))
        rows = scanned.drop("prefix", "u2")
        sets = scanned.filter("n > 0").groupBy("u").agg(F.min("n").alias("n"), F.min(F.struct("n", "u2")).alias("lo"), F.max(F.struct("n", "u2")).alias("hi"), F.min("doc_id").alias("least"), F.min(F.struct("id", "h")).alias("row"))
        sets = materialize(sets.select("u", "n", (F.col("lo") != F.col("hi")).alias("shared"), "least", "row.*"), release=True)
        # Different sets share 64 bits once in 2^64 pairs: of a trillion documents some ten thousand.
        more = frozenset(r["u"] for r in sets.filter("shared").select("u").limit(SHARED + 1).collect())
        if not more:
            break
        if len(more) > SHARED or again:
            raise RuntimeError("too many different sets share a name")
        again = more
        drop_written(scanned, sets)

    counts = scanned.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LARGE)
    last = np.sort(np.array([r[0] for r in counts.orderBy(F.desc("c"), "token").limit(HEAVY).select("token").collect()], dtype=np.int64))
    entries = materialize(_prefixes(texts, size, num, den, last, again))
    # Written, so that both sides of the join come from a plain shuffle, which Spark can split at a hot shingle.
    shared = materialize(entries.groupBy("token").agg(F.min("u").alias("a"), F.max("u").alias("b")).filter("a < b").select("token"))
    entries2 = materialize(entries.join(shared, "token", "left_semi").distinct().join(sets.select("u", "n"), "u"), release=True)
    drop_written(entries, shared)

    # Written for the same reason, like the other sides of joins with hot tokens and components below.
    tile_size = materialize(entries2.groupBy("token").agg(F.count(F.lit(1)).alias("m")))
    small = entries2.join(tile_size.filter(F.col("m") <= TILE).select("token"), "token", "left_semi")
    band = F.floor(F.log("n") / float(-np.log(num / den))).alias("band")
    large = materialize(entries2.join(tile_size.filter(F.col("m") > TILE).select("token"), "token", "left_semi").select("token", "u", band), release=True)
    leaders = materialize(large.groupBy("token", "band").agg(F.min("u").alias("w")))
    near = leaders.unionByName(leaders.withColumn("band", F.col("band") - 1))
    star = large.join(near, ["token", "band"]).select(F.col("u").alias("v"), "w").filter("v <> w")
    pairs = materialize(_candidates(small, num, den), release=True)
    coarse = materialize(connected_components(star.distinct()).withColumnRenamed("node", "u"))
    drop_written(entries2, tile_size, large, leaders)

    # The texts and signatures of nodes that have any candidate.
    used = pairs.select(F.col("v").alias("u")).unionByName(pairs.select(F.col("w").alias("u"))).unionByName(coarse.select("u")).distinct().join(sets.select("u", "id", "h"), "u")
    nodes = materialize(texts.select("id", "h", "text").join(used, ["id", "h"]).dropDuplicates(["u"]).select("u", "text"), release=True)

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(shingle_sets(b["text"].tolist(), size))
            yield pd.DataFrame({"u": b["u"], "n": np.array([len(x) for x in found], dtype="int64"), "bitmap": list(map(bitmap, found))})

    maps = materialize(nodes.mapInPandas(signatures, "u long, n long, bitmap binary"))
    pairs = materialize(_bounded(pairs, maps, num, den), release=True)

    # Blocks of a component: each with the first one.
    count = materialize(coarse.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    placed = materialize(coarse.join(count, "component").withColumn("block", F.pmod(F.xxhash64("u"), "blocks")).join(nodes, "u"))
    pivot = placed.filter("block = 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = placed.filter("block > 0").select("component", "block", "u", "text", F.lit(False).alias("first")).unionByName(pivot.select("component", "block", "u", "text", F.lit(True).alias("first")))
    # Nodes of block k > 0 are first too: pairs inside the block count as well.
    groups = groups.select("component", "block", "u", "text", F.lit(True).alias("first"), F.col("u").alias("label"))
    n_groups = count.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    links = materialize(_verify(groups, ["component", "block"], n_groups, size, num, den), release=True)
    found = materialize(connected_components(links).withColumnRenamed("node", "u").withColumnRenamed("component", "label"))

    # What is still apart in a component of several blocks.
    split = placed.filter("blocks > 1").join(found, "u", "left").withColumn("label", F.coalesce("label", "u")).select("component", "u", "label", "text")
    sizes = split.groupBy("component", "label").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("component").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("component", F.col("top.label").alias("main"))
    rest, n_rest = materialize_counted(split.join(materialize(main), "component").withColumn("apart", F.col("label") != F.col("main")).drop("main"))
    if n_rest:
        rare, more = _rest(rest, size, num, den)
        pairs = pairs.unionByName(_bounded(rare, maps, num, den)).distinct()
        links = links.unionByName(more)
        found = materialize(connected_components(links).withColumnRenamed("node", "u").withColumnRenamed("component", "label"))
    # Pairs of small tiles that are not connected yet: their links join labels, far fewer than nodes.
    label = lambda k: found.select(F.col("u").alias(k), F.col("label").alias(f"label_{k}"))
    pairs = pairs.join(label("v"), "v", "left").join(label("w"), "w", "left").filter(F.coalesce("label_v", "v") != F.coalesce("label_w", "w"))
    pairs = materialize(pairs.select("v", "w", F.coalesce("label_v", "v").alias("label_v"), F.coalesce("label_w", "w").alias("label_w")))
    more = materialize(_verify_pairs(pairs, nodes, size, num, den).join(pairs, ["v", "w"]).select("label_v", "label_w").distinct())
    joined = materialize(connected_components(more).select(F.col("node").alias("label"), "component"))
    # A node without links before is its own label.
    found = found.unionByName(joined.select(F.col("label").alias("u"), "label").join(found.select("u"), "u", "left_anti"))
    found = materialize(found.join(joined, "label", "left").select("u", F.coalesce("component", "label").alias("label")))

    named = sets.select("u", "least").join(found, "u", "left").withColumn("label", F.coalesce("label", "u"))
    least = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")))
    component = named.join(least, "label").select("u", "component_id", "label")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "id", "h", "label"]
    linked = rows.filter("n > 0").join(component, "u").select(*columns)
    out = linked.unionByName(rows.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "label": F.lit(None).cast("long")}).select(*columns))
    drop_written(nodes, maps, placed)
    return out


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near copies: of each component the row of least id stays, and all rows without shingles."""
    names = docs.columns
    found = jaccard_components(docs, size, num, den)
    first = found.filter("label is not null").groupBy("label").agg(F.min(F.struct("id", "h")).alias("row")).select("row.*")
    single = materialize(first.unionByName(found.filter("label is null").select("id", "h").distinct()))
    return rejoin(keyed(docs).join(single, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]), names)
