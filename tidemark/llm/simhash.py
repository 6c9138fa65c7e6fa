"""Operator 2, SimHash near-dedup: vantage-point trees over fingerprints, and the Hamming metric.

``near_duplicates`` links 64-bit fingerprints that differ in at most ``threshold`` bits, exactly. Over all 64 bits the
distances of unrelated texts crowd around 32, where a radius of 4 prunes little, so the bits are split into ``BANDS``
bands and a forest holds one tree a band: if two fingerprints differ in 4 bits, they differ in at most 1 within some band
of three (in general ``threshold // BANDS``), and that smaller radius prunes well.

* Each level of a tree has a vantage point and measures Hamming distance on some bits of the band that no other level
  has. Distances on disjoint bits add up, so the triangle bounds of all levels do too: a query visits the far side only
  as long as the sum of what each boundary on the way costs is within the radius. With a radius of 1 it thus reaches at
  most one shard more for each level, and not a multiple.
* Vantage points, bits and boundaries are chosen on the driver from a bounded sample of distinct fingerprints
  (``SAMPLE``). It only decides how evenly they are dealt out, not what is found.
* Every distinct fingerprint is a member of the one shard it falls into, and a query at each shard that its radius
  reaches. Shards that hold many more rows than planned are cut into blocks of members and of queries.
* Within a shard a tree goes on, splitting members and queries together, down to small blocks that are compared
  exactly at 64 bits. A shard returns a spanning forest of its links, never all pairs.
* Connected components of the links, over smallest document ids, give each document its class.

``keep_one`` thins a corpus by similarity: distinct shingles of five words, and an estimated Jaccard similarity of 0.8 or
more. Such texts differ in about 15 % of their fingerprint's bits, a radius that no metric tree can search exactly without
reaching nearly all shards. So fingerprints are longer (``WIDE`` words of 64 bits, which estimate 0.8 within 0.026), and a
forest of as many trees as give a pair at 0.8 a chance of ``CHANCE`` to share a shard searches without a margin; each of
their levels is one bit. Where the sample shows groups of near copies of 1 % of all fingerprints or more, every text near
the middle of such a group is linked to it directly, and then only meets texts that are in no such group.

Copies have one fingerprint and meet only in a ``min`` that combines before the shuffle. Null and empty texts have
fingerprint zero, which links like any other. Classes are named by ids: if one id is the smallest of several
fingerprints, these are one class; a fingerprint that only rows with a null id have links nothing and its class is null.
An empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .arrow import fresh, hashed_sample, prepare, table
from .graph import connected_components
from .scratch import Scratch
from .words import spans

SEED, SHINGLE, THRESHOLD = 42, 4, 4
BANDS = 3
#: The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Distinct fingerprints that trees are planned from at most; members a shard is planned for; of a block.
SAMPLE, SHARD, LEAF = 8192, 16_384, 64
FULL = np.uint64(2**64 - 1)
#: Of ``keep_one``: words of a shingle, similarity, words of a fingerprint, members of a shard, chance to share a shard.
SIMILAR_SHINGLE, SIMILARITY, WIDE, WIDE_SHARD, CHANCE = 5, 0.8, 16, 1024, 0.98
#: Of the sample, the share and number of fingerprints near one that make it the middle of a large group.
CROWD, CROWD_LEAST = 0.01, 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text; zero if it has no word."""
    joined, starts, ends = spans(text or "", lower=True)
    if not len(starts):
        return 0
    width = min(width, len(starts))
    ones, total = np.zeros(64, np.int64), len(starts) - width + 1
    digest, a, b = xxhash.xxh64_intdigest, starts.tolist(), ends[width - 1 :].tolist()
    for at in range(0, total, 1 << 16):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a[at : at + (1 << 16)], b[at : at + (1 << 16)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def wide_fingerprint(text: str | None, width: int = SIMILAR_SHINGLE, words: int = WIDE) -> np.ndarray:
    """A fingerprint of ``words`` times 64 bits of a text's distinct shingles; zero if it has no word."""
    joined, starts, ends = spans(text or "", lower=True)
    if not len(starts):
        return np.zeros(words, "<u8")
    width, digest = min(width, len(starts)), xxhash.xxh64_intdigest
    h = np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[width - 1 :].tolist())], "<u8"))
    ones, step = np.zeros(64 * words, np.int64), np.arange(1, words + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):  # as many as a byte counts, so bits are added up as bytes
        z = h[at : at + 255, None] + step  # each shingle's own stream of bits
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def differing_share(similarity: float) -> float:
    """The share of bits in which fingerprints of sets with this Jaccard similarity differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_threshold(similarity: float = SIMILARITY, words: int = WIDE) -> int:
    """Bits that may differ: those expected at this similarity, and half a standard error more."""
    p, n = differing_share(similarity), 64 * words
    return int(p * n + 0.5 * math.sqrt(p * (1 - p) * n))


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _wide_fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([wide_fingerprint(t).view(np.int64) for t in texts], dtype=object)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def band_masks(bands: int = BANDS) -> list[np.uint64]:
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]


def choose_split(fps: np.ndarray, metrics: list[tuple[np.uint64, int]], seed: int) -> tuple[np.uint64, np.uint64, int, int] | None:
    """``(vantage point, mask, radius, mu)``: left is distance <= mu. The first metric that splits fairly is taken.

    Of a few vantage points, the one is taken whose halves, boundary counted twice, are smallest.
    """
    rng = np.random.default_rng(seed)
    for mask, radius in metrics:
        best = None
        for vp in fps[rng.integers(0, len(fps), 4)]:
            seen = np.bincount(np.bitwise_count((fps ^ vp) & mask), minlength=65).cumsum()
            for mu in {int(np.searchsorted(seen, len(fps) / 2)), int(np.searchsorted(seen, len(fps) / 2)) - 1}:
                if 0 <= mu < 64 and 0 < seen[mu] < len(fps):
                    left = seen[min(mu + radius, 64)]
                    right = len(fps) - (seen[mu - radius] if mu >= radius else 0)
                    cost = max(int(left), int(right))
                    if best is None or cost < best[0]:
                        best = (cost, vp, mask, radius, mu)
        if best and best[0] < 0.95 * len(fps):
            return best[1:]
    return None


class Tree:
    """The top of one tree: levels of a vantage point, a mask of bits and a boundary, whose sides number the shards."""

    def __init__(self, sample: np.ndarray, bits: np.ndarray, radius: int, depth: int, first_shard: int, seed: int):
        """``sample``: rows of words; ``bits``: the places of those that distances are measured on."""
        rng = np.random.default_rng(seed)
        depth = min(depth, len(bits))
        many = len(bits) // depth if depth and radius else 1
        many -= 1 - many % 2  # an odd number of bits has two sides of one size
        self.radius, self.first, self.shards, self.words = radius, first_shard, 1 << depth, sample.shape[1]
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        cell, left = np.zeros(len(sample), np.int64), rng.permutation(bits)
        for _ in range(depth):
            best = None
            for k in range(min(8, len(left) // many)):
                places = left[k * many : (k + 1) * many]
                mask = np.zeros(self.words, np.uint64)
                np.bitwise_or.at(mask, places // 64, np.uint64(1) << (places % 64).astype(np.uint64))
                point = (sample[rng.integers(0, len(sample))] if len(sample) else np.zeros(self.words, np.uint64)) & mask
                d = np.bitwise_count((sample ^ point) & mask).sum(1, dtype=np.int64)
                for mu in range(many):
                    size = np.bincount(2 * np.unique(cell, return_inverse=True)[1] + (d > mu)) if len(sample) else np.zeros(1)
                    cost = (int((size.astype(np.int64) ** 2).sum()), abs(2 * mu + 1 - many))
                    if best is None or cost < best[0]:
                        best = (cost, (mask, point, mu), k, d > mu)
            self.levels.append(best[1])
            cell = 2 * cell + best[3]
            left = np.concatenate([left[: best[2] * many], left[(best[2] + 1) * many :]])

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, shard, member)`` of every shard that a fingerprint's radius reaches; it is a member of one."""
        home, costs = np.zeros(len(fps), np.int64), np.zeros((len(fps), len(self.levels)), np.int64)
        for k, (mask, point, mu) in enumerate(self.levels):
            d = np.bitwise_count((fps ^ point) & mask).sum(1, dtype=np.int64)
            home |= (d > mu).astype(np.int64) << k
            costs[:, k] = np.where(d > mu, d - mu, mu + 1 - d)
        every = np.arange(len(fps))
        rows, shards, member = [every], [home], [np.ones(len(fps), bool)]
        reached = [(every, home, np.zeros(len(fps), np.int64))]  # by which levels have been crossed so far
        for k in range(len(self.levels) if self.radius else 0):
            for row, shard, spent in list(reached):
                go = spent + costs[row, k] <= self.radius
                if go.any():
                    reached.append((row[go], shard[go] ^ (1 << k), spent[go] + costs[row[go], k]))
                    rows.append(row[go])
                    shards.append(shard[go] ^ (1 << k))
                    member.append(np.zeros(int(go.sum()), bool))
        return np.concatenate(rows), np.concatenate(shards) + self.first, np.concatenate(member)


class Forest:
    """A union-find over row numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent[x]]
            if (up == self.parent[x]).all():
                return up
            self.parent[x] = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the pairs; those already joined cost nothing, so a dense group stays cheap."""
        while True:
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def link_shard(fps: np.ndarray, member: np.ndarray, mask: np.uint64, radius: int, threshold: int) -> np.ndarray:
    """The root of every row after linking members to rows within ``threshold`` bits, by one tree over both."""
    forest, metrics = Forest(len(fps)), [(mask, radius), (FULL, threshold)]
    todo = [(np.flatnonzero(member), np.arange(len(fps)), 0)]
    while todo:
        ms, qs, depth = todo.pop()
        split = choose_split(fps[ms], metrics, depth) if len(ms) > LEAF else None
        if split is None:
            for m in range(0, len(ms), LEAF):
                block = ms[m : m + LEAF]
                for q in range(0, len(qs), 1 << 14):
                    near = np.bitwise_count(fps[block][:, None] ^ fps[qs[q : q + (1 << 14)]][None]) <= threshold
                    i, j = np.nonzero(near)
                    forest.link(block[i], qs[q + j])
            continue
        vp, by, r, mu = split
        dm = np.bitwise_count((fps[ms] ^ vp) & by) <= mu
        dq = np.bitwise_count((fps[qs] ^ vp) & by).astype(np.int16)
        todo += [(ms[dm], qs[dq - r <= mu], depth + 1), (ms[~dm], qs[dq + r > mu], depth + 1)]
    return forest.find(np.arange(len(fps)))


def link_wide(fps: np.ndarray, member: np.ndarray, threshold: int) -> np.ndarray:
    """The root of every row after linking members to rows within ``threshold`` bits of a long fingerprint.

    Rows are linked to pivots first, each the first that is near none before it; what is in one component by then is not
    compared again, so a dense group costs little more than its size.
    """
    n, words = fps.shape
    few = min(4, words)  # unrelated rows are told by the first words: 4 standard errors beyond what these share of it
    share = threshold / (64 * words)
    early = threshold if few == words else min(threshold, int(64 * few * share + 4 * math.sqrt(64 * few * share * (1 - share))))
    forest = Forest(n)

    def link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Links all near pairs of two lists of rows; which of the second are near one of the first."""
        near = np.zeros(len(b), bool)
        for x in range(0, len(a), LEAF):
            for y in range(0, len(b), 1 << 14):
                p, q = a[x : x + LEAF], b[y : y + (1 << 14)]
                d = np.zeros((len(p), len(q)), np.uint16)
                for w in range(few):
                    d += np.bitwise_count(fps[p, w][:, None] ^ fps[q, w][None])
                i, j = np.nonzero(d <= early)
                ok = np.bitwise_count(fps[p[i]] ^ fps[q[j]]).sum(1, dtype=np.int64) <= threshold
                i, j = i[ok], j[ok]
                forest.link(p[i], q[j])
                near[y + j] = True
        return near

    members, rows = np.flatnonzero(member), np.arange(n)
    todo, others = members, []
    while len(todo):
        pivots, rest = todo[:LEAF], todo[LEAF:]
        link(pivots, rows)
        near = link(pivots, rest)
        others.append(rest[near])
        todo = rest[~near]
    others = np.concatenate(others) if others else members[:0]  # members that are no pivots
    root = forest.find(rows)
    pivot = np.ones(n, bool)
    pivot[others] = False
    most = np.bincount(root[others], minlength=1).argmax() if len(others) else -1
    small, large = others[root[others] != most], others[root[others] == most]
    rest = np.flatnonzero(~(pivot & member))  # pivots have met every row
    link(small, rest)
    if len(large):
        link(large, rest[root[rest] != most])
    return forest.find(rows)


def _crowded(sample: np.ndarray, threshold: int) -> np.ndarray:
    """Middles of large groups: those of the sample with the most others near, each apart from the ones before."""
    found, left = [], sample
    while len(left) and len(found) < 2 / CROWD:
        near = np.array([(np.bitwise_count(x ^ left).sum(1, dtype=np.int64) <= threshold).sum() for x in left[:512]])
        if near.max() < max(CROWD_LEAST, CROWD * len(sample)):
            if len(left) <= 512:
                break
            left = left[512:]  # none of these is in a large group's middle
            continue
        middle = left[near.argmax()]
        found.append(middle)
        left = left[np.bitwise_count(middle ^ left).sum(1, dtype=np.int64) > threshold]
    return np.array(found, np.uint64).reshape(-1, sample.shape[1])


def _matrix(pdf: pd.DataFrame, words: int) -> np.ndarray:
    return np.stack([pdf[f"f{k}"].to_numpy() for k in range(words)], 1).view(np.uint64) if len(pdf) else np.zeros((0, words), np.uint64)


def _links(reps: DataFrame, words: int, sample: np.ndarray, trees: list[Tree], link, shard_rows: int, middles: np.ndarray, threshold: int) -> DataFrame:
    """Links ``(a, b)`` that ``link`` finds in each shard of ``trees``.

    ``reps``: a fingerprint's words ``f0``, ``f1`` and so on, and ``rep``, its node. Rows near one of ``middles`` are no members.
    """
    most, spark = 4 * shard_rows, reps.sparkSession
    names = [f"f{k}" for k in range(words)]

    def reach(pdf: pd.DataFrame):
        fps = _matrix(pdf, words)
        outside = np.ones(len(fps), bool)
        for middle in middles:
            outside &= np.bitwise_count(fps ^ middle).sum(1, dtype=np.int64) > threshold
        for tree in trees:
            row, shard, member = tree.route(fps)
            yield row, shard, member & outside[row]

    def count(batches):
        for pdf in batches:
            for _, shard, member in reach(pdf):
                at, inverse = np.unique(shard, return_inverse=True)
                yield pd.DataFrame({"shard": at, "members": np.bincount(inverse, member, len(at)).astype(np.int64), "rows": np.bincount(inverse, minlength=len(at))})

    counted = reps.mapInPandas(count, "shard long, members long, rows long").groupBy("shard").agg(F.sum("members").alias("members"), F.sum("rows").alias("rows"))
    large = counted.where(F.greatest("members", "rows") > most).toLocalIterator()  # a row for each shard far above its size
    blocks = spark.sparkContext.broadcast({r.shard: (-(-r.members // most) or 1, -(-r["rows"] // most)) for r in large})

    def route(batches):
        for pdf in batches:
            spread = (pdf["rep"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)

            def rows(row, shard, part, member):
                return pd.DataFrame({"shard": shard, "part": part, "rep": pdf["rep"].to_numpy()[row], "member": member} | {c: pdf[c].to_numpy()[row] for c in names})

            for row, shard, member in reach(pdf):
                cut = np.isin(shard, np.fromiter(blocks.value, np.int64, len(blocks.value)))
                yield rows(row[~cut], shard[~cut], 0, member[~cut])
                for s in np.unique(shard[cut]).tolist():
                    at, (m, q) = shard == s, blocks.value[s]
                    own, mine = row[at], row[at & member]
                    for k in range(m):  # as queries, to all blocks of members
                        yield rows(own, s, k * q + spread[own] % q, False)
                    for k in range(q):  # as members, to all blocks of queries
                        yield rows(mine, s, spread[mine] // q % m * q + k, True)

    def linked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        roots, reps = link(key[0], _matrix(pdf, words), pdf["member"].to_numpy(bool)), pdf["rep"].to_numpy()
        apart = reps != reps[roots]
        return pd.DataFrame({"a": reps[apart], "b": reps[roots[apart]]})

    schema = "shard long, part long, rep long, member boolean, " + ", ".join(f"{c} long" for c in names)
    return reps.mapInPandas(route, schema).groupBy("shard", "part").applyInPandas(linked, "a long, b long")


def fingerprint_links(reps: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """Links ``(a, b)`` that join the same representatives as all pairs within ``threshold`` bits do.

    ``reps``: ``fp`` (long, distinct) and ``rep`` (long, the fingerprint's node).
    """
    n, radius, masks = reps.count(), threshold // bands, band_masks(bands)
    sample = np.array([r.fp for r in hashed_sample(reps.select("fp"), "fp", SAMPLE, n).collect()], np.int64).view(np.uint64).reshape(-1, 1)
    depth = math.ceil(math.log2(max(n / SHARD, 1)))
    trees, first = [], 0
    for k, mask in enumerate(masks):
        trees.append(Tree(sample, np.flatnonzero(np.unpackbits(np.array([mask]).view(np.uint8), bitorder="little")), radius, depth, first, k))
        first += trees[-1].shards
    last = np.cumsum([t.shards for t in trees])

    def link(shard: int, fps: np.ndarray, member: np.ndarray) -> np.ndarray:
        return link_shard(fps[:, 0], member, masks[int(np.searchsorted(last, shard, side="right"))], radius, threshold)

    return _links(reps.select(F.col("fp").alias("f0"), "rep"), 1, sample, trees, link, SHARD, np.zeros((0, 1), np.uint64), threshold)


def similar_links(reps: DataFrame, similarity: float = SIMILARITY, words: int = WIDE, chance: float = CHANCE) -> DataFrame:
    """Links ``(a, b)`` between representatives whose fingerprints estimate ``similarity`` or more.

    ``reps``: ``f0``, ``f1`` and so on (longs, distinct together) and ``rep`` (long, the fingerprint's node).
    """
    n, threshold = reps.count(), wide_threshold(similarity, words)
    names = [f"f{k}" for k in range(words)]
    sample = hashed_sample(reps.select(*names, F.xxhash64(*names).alias("_h")), "_h", SAMPLE, n).drop("_h").toPandas()
    sample = _matrix(sample, words)
    depth = math.ceil(math.log2(max(n / WIDE_SHARD, 1)))
    many = math.ceil(math.log(1 - chance) / math.log(1 - (1 - differing_share(similarity)) ** depth)) if depth else 1
    bits, size = np.random.default_rng(0).permutation(64 * words), max(depth, 64 * words // many)
    trees = [Tree(sample, np.take(bits, np.arange(k * size, (k + 1) * size), mode="wrap"), 0, depth, k << depth, k) for k in range(many)]
    middles = _crowded(sample, threshold)
    links = _links(reps, words, sample, trees, lambda shard, fps, member: link_wide(fps, member, threshold), WIDE_SHARD, middles, threshold)
    if not len(middles):
        return links

    def to_middle(batches):
        for pdf in batches:
            fps = _matrix(pdf, words)
            for k, middle in enumerate(middles):
                near = np.bitwise_count(fps ^ middle).sum(1, dtype=np.int64) <= threshold
                yield pd.DataFrame({"k": k, "a": pdf["rep"].to_numpy()[near], "own": (fps == middle).all(1)[near]})

    found = reps.mapInPandas(to_middle, "k int, a long, own boolean")
    heads = F.broadcast(found.where("own").select("k", F.col("a").alias("b")))  # a row a middle: 2 / CROWD at most
    return links.unionByName(found.where("NOT own").join(heads, "k").select("a", "b"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(id_col, fp, component)`` for every row; ``component`` is the smallest id that links reach. Ids are integers."""
    prepare(docs.sparkSession)
    prints = scratch.cut(docs.select(F.col(id_col), _fingerprint(F.col(text_col)).alias("fp")))
    reps = scratch.cut(prints.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("rep")))
    links = fingerprint_links(reps.where("rep IS NOT NULL"), threshold)
    component = connected_components(links, "a", "b", scratch)
    classes = reps.join(component, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(classes, "fp").select(id_col, "fp", "component")


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id, then of the smallest text hash.

    Groups are components of texts whose estimated similarity is ``similarity`` or more, whatever ids their rows have:
    rows of one id whose texts are in different groups are judged each in its own. A null id comes after all others.
    """
    prepare(docs.sparkSession)
    key, i = fresh(docs, "_text_hash"), F.col(id_col)
    keyed = docs.withColumn(key, F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")))
    prints = keyed.select(F.struct(i.isNull().alias("none"), i.alias("id"), F.col(key).alias("hash")).alias("row"), _wide_fingerprint(F.col(text_col)).alias("fp"))
    heads = prints.groupBy("fp").agg(F.min("row").alias("first"))
    names = [F.get("fp", F.lit(k)).alias(f"f{k}") for k in range(WIDE)]
    heads = scratch.cut(heads.select(*names, "first", F.monotonically_increasing_id().alias("rep")))
    links = similar_links(heads.drop("first"), similarity)
    component = connected_components(links, "a", "b", scratch)
    classes = heads.select("rep", "first").join(component, F.col("rep") == F.col("node"), "left")
    first = classes.groupBy(F.coalesce("component", "rep").alias("component")).agg(F.min("first").alias("first")).select("first.id", "first.hash")
    once = keyed.dropDuplicates([id_col, key])
    return once.join(first, once[id_col].eqNullSafe(first["id"]) & (once[key] == first["hash"]), "left_semi").select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    return classes.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def _oracle() -> str:
    """XXH64 by its definition: a table of shingles in which every step reads some more bytes of each."""
    p1, p2, p3, p4, p5 = PRIMES
    wide = lambda x: f"({x})::UHUGEINT"
    mul = lambda a, b: f"({wide(a)} * {wide(b)} % {2**64})"
    add = lambda *a: f"(({' + '.join(map(wide, a))}) % {2**64})"
    rotl = lambda x, r: f"({wide(x)} * {2**r} % {2**64} + {wide(x)} // {2 ** (64 - r)})"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)"
    little = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(n))) + ")::UBIGINT"
    stripe = lambda k: f"CASE WHEN state = 0 AND n - p >= 32 THEN {mul(rotl(add(f'v{k}', mul(f'l{k}', p2)), 31), p1)} ELSE v{k} END::UBIGINT"
    merged = add(*[rotl(f"v{k + 1}", r) for k, r in enumerate((1, 7, 12, 18))])
    for k in range(1, 5):
        merged = add(mul(xor(merged, mul(rotl(mul(f"v{k}", p2), 31), p1)), p1), p4)
    eight = add(mul(rotl(xor("h", mul(rotl(mul("l1", p2), 31), p1)), 27), p1), p4)
    four = add(mul(rotl(xor("h", mul("l5", p1)), 23), p2), p3)
    one = mul(rotl(xor("h", mul("l6", p5)), 11), p1)
    bits = ", ".join(f"sum(h // {2**b} % 2) AS b{b}" for b in range(64))
    back = " + ".join(f"CASE WHEN 2 * b{b} > total THEN {2**b}::UHUGEINT ELSE 0 END" for b in range(64))
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT k, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
r(s, x, n, p, state, v1, v2, v3, v4, h) AS (
  SELECT s, hex(encode(s)), strlen(s), 0::BIGINT, 0, {(SEED + p1 + p2) % 2**64}::UBIGINT, {(SEED + p2) % 2**64}::UBIGINT, {SEED}::UBIGINT, {(SEED - p1) % 2**64}::UBIGINT, 0::UBIGINT FROM (SELECT DISTINCT s FROM s)
  UNION ALL
  SELECT s, x, n, p + CASE WHEN state = 0 THEN CASE WHEN n - p >= 32 THEN 32 ELSE 0 END WHEN n - p >= 8 THEN 8 WHEN n - p >= 4 THEN 4 WHEN n > p THEN 1 ELSE 0 END,
    CASE WHEN state = 0 AND n - p >= 32 THEN 0 WHEN state = 0 OR n > p THEN 1 ELSE 2 END, {stripe(1)}, {stripe(2)}, {stripe(3)}, {stripe(4)},
    CASE WHEN state = 0 AND n - p >= 32 THEN h WHEN state = 0 AND n >= 32 THEN {add(merged, 'n')} WHEN state = 0 THEN {add(SEED + p5, 'n')}
      WHEN n - p >= 8 THEN {eight} WHEN n - p >= 4 THEN {four} WHEN n > p THEN {one} ELSE h END::UBIGINT
  FROM (SELECT *, CASE WHEN n - p >= 8 THEN {little('p', 8)} END AS l1, {', '.join(f"CASE WHEN n - p >= 32 THEN {little(f'p + {8 * k}', 8)} END AS l{k + 1}" for k in (1, 2, 3))},
          CASE WHEN n - p >= 4 THEN {little('p', 4)} END AS l5, CASE WHEN n > p THEN {little('p', 1)} END AS l6 FROM r WHERE state < 2)),
a1 AS (SELECT s, {xor('h', f'h // {2**33}')} AS h FROM r WHERE state = 2),
a2 AS (SELECT s, {mul('h', p2)}::UBIGINT AS h FROM a1),
a3 AS (SELECT s, {mul(xor('h', f'h // {2**29}'), p3)}::UBIGINT AS h FROM a2),
hashed AS MATERIALIZED (SELECT s, {xor('h', f'h // {2**32}')} AS h FROM a3),
counted AS (SELECT k, count(*) AS total, {bits} FROM s JOIN hashed USING (s) GROUP BY k),
prints AS MATERIALIZED (SELECT d.k, doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN (SELECT k, ({back})::UBIGINT AS fp FROM counted) USING (k)),
reps AS MATERIALIZED (SELECT fp, min(doc_id) AS rep FROM prints GROUP BY fp),
links AS MATERIALIZED (SELECT DISTINCT a.rep AS a, b.rep AS b FROM reps a JOIN reps b ON bit_count(xor(a.fp, b.fp)) <= {THRESHOLD} WHERE a.rep IS NOT NULL AND b.rep IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component AS component_id FROM prints JOIN reps USING (fp) LEFT JOIN classes USING (rep)
"""


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLE = {"op2_simhash_near_dedup": _oracle()}
