"""Operator 4, approximate nearest neighbours: learned partitions.

On a bounded sample of vectors (``SAMPLE``) the driver builds the graph of nearest neighbours, cuts it into balanced
parts (projections halved at the median, then refined by moving vectors to the parts of most of their neighbours as long
as parts stay balanced), and trains a small network to predict the parts of a vector's neighbours. The network assigns
every vector of the table to its likeliest part, and routes a query to its several likeliest ones, where all candidates
are reranked by exact distance in double precision. How many parts a query probes is measured, not guessed: the fewest
that reach ``RECALL`` on sample vectors that the network was not trained on.

Parts grow in number with the table: beyond ``MAX_PARTS`` of them, each of these is cut again in the same way, by a task
of its own from a sample of its own, so that a part stays near ``PART_ROWS`` up to ``MAX_PARTS`` squared of them.

Of vectors that are equal, those beyond the ``k + 1`` smallest ids cannot be among any query's ``k`` nearest, and are
left out before anything is dealt out; equal queries are searched once. Parts are dealt to tasks in blocks of candidates
and of queries, by the counts of both, so no task holds a whole part, however large or popular; where no more than
``QUERY_BLOCK`` queries probe a part, its candidates are sent once.

Vectors that are null, zero, hold null or non-finite components, or have another length than most, take no part, nor do
rows with a null id. An id counts once, as candidate and as query: repeated rows change nothing, and of different vectors
of one id the smallest one counts. Ties go to the smaller id. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .arrow import hashed_sample, prepare, table
from .scratch import Scratch

K = 10
#: Vectors that one network is learned from at most; rows that one part is planned for; parts of one network at most.
SAMPLE, PART_ROWS, MAX_PARTS = 8192, 2048, 256
#: Recall that probes are set for; candidates and queries of one block.
RECALL, BLOCK, QUERY_BLOCK = 0.95, 16_384, 16_384


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row, by blocks."""
    k, out, sq = min(k, len(x) - 1), [], (x * x).sum(1)
    for a in range(0, len(x), 1024):
        d = sq[None] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, 1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, passes: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part of every row: parts differ little in size and few neighbours are apart."""
    part, first, rng = np.zeros(len(x), np.int64), 0, np.random.default_rng(0)
    todo = [(np.arange(len(x)), parts)]
    while todo:
        rows, p = todo.pop()
        if p == 1:
            part[rows] = first
            first += 1
            continue
        v = x[rows] - x[rows].mean(0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):  # power iteration: the direction in which these rows vary most
            axis = v.T @ (v @ axis)
            axis /= np.linalg.norm(axis) or 1
        order, left = np.argsort(v @ axis, kind="stable"), p // 2
        cut = round(len(rows) * left / p)
        todo += [(rows[order[:cut]], left), (rows[order[cut:]], p - left)]
    most, least = math.ceil(len(x) / parts * slack), math.floor(len(x) / parts / slack)
    for _ in range(passes):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[best[i]] < most and size[part[i]] > least:
                size[best[i]] += 1
                size[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer from vectors to log odds of parts."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @property
    def parts(self) -> int:
        return len(self.b2)


def train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, batch: int = 256, rate: float = 2e-3) -> Router:
    """Fits ``target`` (a distribution over parts per row) by cross-entropy with Adam."""
    rng = np.random.default_rng(0)
    mean = x.mean(0)
    scale = float((x - mean).std()) or 1.0
    z = (x - mean) / scale
    p = [rng.normal(size=(x.shape[1], hidden)) * math.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.normal(size=(hidden, target.shape[1])) * math.sqrt(1 / hidden), np.zeros(target.shape[1])]
    p = [a.astype(np.float32) for a in p]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(z), batch):
            rows = order[a : a + batch]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            e = np.exp(o - o.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                g = g + 1e-4 * p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *p)


def learn(x: np.ndarray, parts: int, k: int = K, recall: float = RECALL) -> Router:
    """A router into ``parts`` parts; its probes are measured on a quarter of the rows, held out."""
    dim, x = x.shape[1] if x.ndim == 2 else 0, x.astype(np.float32)
    if parts < 2 or len(x) < 8 * parts:
        return Router(np.zeros(dim), 1.0, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held = np.arange(len(x)) % 4 == 0
    fit, test = x[~held], x[held]
    near = neighbours(fit, k)
    part = balanced_parts(fit, near, parts)
    target = np.zeros((len(fit), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(fit)), near.shape[1] + 1), part[np.hstack([near, np.arange(len(fit))[:, None]])].ravel()), 1 / (near.shape[1] + 1))
    router = train(fit, target)
    odds, true = router.odds(test), neighbours(test, k)
    place = (-odds).argsort(1).argsort(1)  # rank of every part for every row
    rank = np.take_along_axis(place, odds.argmax(1)[true], 1)
    router.probes = next(m for m in range(1, parts + 1) if (rank < m).mean() >= recall or m == parts)
    return router


@dataclass
class Partition:
    """A router into parts and, where there are many, one for each part into parts of its own."""

    coarse: Router
    fine: list[Router] | None = None

    @property
    def parts(self) -> int:
        return self.coarse.parts * (max(r.parts for r in self.fine) if self.fine else 1)

    def _probe(self, x: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
        def top(router: Router, rows: np.ndarray) -> np.ndarray:
            odds = router.odds(rows)
            return odds.argmax(1)[:, None] if best else (-odds).argsort(1, kind="stable")[:, : router.probes]

        first = top(self.coarse, x)
        row, part = np.repeat(np.arange(len(x)), first.shape[1]), first.ravel()
        if self.fine:
            step, rows, parts = self.parts // self.coarse.parts, [], []
            for p in np.unique(part).tolist():
                at = row[part == p]
                second = top(self.fine[p], x[at])
                rows.append(np.repeat(at, second.shape[1]))
                parts.append(p * step + second.ravel())
            row, part = np.concatenate(rows), np.concatenate(parts)
        return row, part.astype(np.int32)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The part of each row."""
        row, part = self._probe(x, True)
        return part[np.argsort(row, kind="stable")]

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, part)`` of every part that a query probes."""
        return self._probe(x, False)


def _stacked(vectors) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def learn_partition(rows: DataFrame, n: int, scratch: Scratch, k: int = K) -> Partition:
    """The partition of ``n`` rows ``(vec_id, vec)``. What reaches the driver is ``SAMPLE`` vectors, and one network a part."""
    sample = hashed_sample(rows, "vec_id", SAMPLE, n).select("vec").toPandas()["vec"]
    x = _stacked(sample) if len(sample) else np.zeros((0, 0))
    wanted = n // PART_ROWS
    if wanted <= MAX_PARTS:
        return Partition(learn(x, wanted, k))
    coarse = learn(x, MAX_PARTS, k, math.sqrt(RECALL))
    dim, space, each = x.shape[1], 1 << 40, math.ceil(wanted / MAX_PARTS)
    share = min(space, int(SAMPLE * MAX_PARTS / n * space))  # of each part, a sample of about its share of SAMPLE a part

    def place(batches):
        for pdf in batches:
            yield pdf.assign(part=coarse.odds(_stacked(pdf["vec"])).argmax(1).astype(np.int32))

    def train_part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _stacked(pdf.sort_values("vec_id")["vec"])[: 4 * SAMPLE]
        return pd.DataFrame({"part": [key[0]], "model": [pickle.dumps(learn(own, min(each, MAX_PARTS), k, math.sqrt(RECALL)))]})

    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(space)) < share)
    placed = some.mapInPandas(place, f"vec_id long, vec {rows.schema['vec'].dataType.simpleString()}, part int")
    models = {r.part: pickle.loads(r.model) for r in placed.groupBy("part").applyInPandas(train_part, "part int, model binary").toLocalIterator()}
    return Partition(coarse, [models.get(p) or learn(np.zeros((0, dim)), 1) for p in range(coarse.parts)])


def _nearest(k: int):
    """Per query of a block, the ``k`` nearest candidates by exact distance; ties to the smaller id."""

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "vec_id": [], "score": []})
        q, x = (_stacked(side["vec"]).astype(np.float64) for side in (left, right))
        ids, reps, out = right["vec_id"].to_numpy(), left["rep"].to_numpy(), []
        sq = (x * x).sum(1)
        for a in range(0, len(q), 256):
            d = sq[None] + (q[a : a + 256] ** 2).sum(1)[:, None] - 2 * q[a : a + 256] @ x.T
            last = np.partition(d, min(k, d.shape[1]) - 1, 1)[:, min(k, d.shape[1]) - 1]
            # rounding of the fast form is far below this margin
            row, col = np.nonzero(d <= (last + 1e-9 * (1 + np.abs(last) + sq.max()))[:, None])
            exact = np.sqrt(((q[a + row] - x[col]) ** 2).sum(1))
            order = np.lexsort((ids[col], exact, row))
            row, col, exact = row[order], col[order], exact[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            out.append(pd.DataFrame({"rep": reps[a + row], "vec_id": ids[col], "score": exact})[nth < k])
        return pd.concat(out)

    return search


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, vec)`` of the vectors that take part, as floats if they are and doubles otherwise, without negative zeros."""
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(vec_col, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(finite & F.exists("vec", lambda x: x != 0))


def common_length(rows: DataFrame) -> int:
    """The length that most vectors have; of equally many, the smaller."""
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return most.n if most else 0


def _block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which of as many blocks an id is dealt to."""
    spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (spread % blocks.astype(np.uint64)).astype(np.int32)


def search(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of ``vectors`` for each of ``queries``, but their own id.

    ``queries`` are rows of ``vectors``.
    """
    spark = vectors.sparkSession
    prepare(spark)
    good = usable(vectors, id_col, vec_col)
    fits = F.size("vec") == common_length(good)
    once = good.where(fits).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    rows = scratch.cut(once.withColumn("_n", nth).where(F.col("_n") <= k + 1).drop("_n"))
    asked = scratch.cut(usable(queries, id_col, vec_col).where(fits).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    reps = scratch.cut(asked.groupBy("vec").agg(F.min("vec_id").alias("rep")))
    kind = rows.schema["vec"].dataType.simpleString()
    partition = spark.sparkContext.broadcast(learn_partition(rows, rows.count(), scratch, k))  # MAX_PARTS + 1 networks at most
    parts = partition.value.parts

    def assign(batches):
        for pdf in batches:
            yield pdf.assign(part=partition.value.assign(_stacked(pdf["vec"])))

    def routes(batches):
        for pdf in batches:
            row, part = partition.value.route(_stacked(pdf["vec"]))
            yield pdf.iloc[row].assign(part=part)

    def counted(placed: DataFrame, size: int) -> np.ndarray:
        """Of every part, the blocks that its rows fill; a number a part reaches the driver."""
        blocks = np.zeros(parts, np.int64)
        for r in placed.groupBy("part").count().toLocalIterator():
            blocks[r.part] = -(-r["count"] // size)
        return blocks

    placed = scratch.cut(rows.mapInPandas(assign, f"vec_id long, vec {kind}, part int"))
    routed = reps.mapInPandas(routes, f"vec {kind}, rep long, part int")
    blocks = spark.sparkContext.broadcast((counted(placed, BLOCK), counted(routed.select("part"), QUERY_BLOCK)))

    def deal(own: int, id_name: str):
        """Rows with their own block, once for every block of the other side; none where the other side has no rows."""
        names = ["block", "q_block"] if own == 0 else ["q_block", "block"]

        def dealt(batches):
            for pdf in batches:
                part = pdf["part"].to_numpy()
                others = blocks.value[1 - own][part]
                row = np.repeat(np.arange(len(pdf)), others)
                other = np.arange(len(row)) - np.repeat(others.cumsum() - others, others)
                mine = _block_of(pdf[id_name].to_numpy(), np.maximum(blocks.value[own][part], 1))
                yield pdf.iloc[row].assign(**{names[0]: mine[row], names[1]: other.astype(np.int32)})

        return dealt

    keys = ["part", "block", "q_block"]
    right = placed.mapInPandas(deal(0, "vec_id"), f"vec_id long, vec {kind}, part int, block int, q_block int")
    left = routed.mapInPandas(deal(1, "rep"), f"vec {kind}, rep long, part int, block int, q_block int")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest(k + 1), "rep long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))
    few = found.withColumn("_n", best).where(F.col("_n") <= k + 1).drop("_n")
    named = asked.join(reps, "vec").select(F.col("vec_id").alias("query_id"), "rep")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = named.join(few, "rep").where("query_id != vec_id").select("query_id", rank.alias("rank"), "vec_id", "score")
    return out.where(F.col("rank") <= k)


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"), Scratch(spark))


QUERIES = {"op4_learned_partitions": op4_learned_partitions}
ORACLE: dict[str, str] = {}
