"""Embedding near-dedup by product quantisation.

Unit vectors are dealt to coarse inverted lists by their nearest centroid. What is left after the centroid is cut into
subspaces, each coded by its nearest codeword. A query visits the lists of its nearest centroids; there its squared distance to
every coded vector is a sum of table look-ups. As the length of each vector's coding error is kept with its code, the triangle
inequality tells which vectors may lie within the wanted distance, and only these are compared exactly, in double precision.

Coarse centroids and codewords are fitted on at most ``sample`` vectors (a documented bound); every vector is indexed. Exact
copies are one node with a count, so they are compared once. Spark deals (list, chunk of the list, chunk of its queries) to
groups; a group returns a count of links for each query and as many links as connect its members, never all pairs. Where a
vector that is found does not visit the query's own list, the pair is counted for it there too, so both ends count it once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm.shared import components, written

SEED = 11


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    #: Bound on the rows that the index is fitted on.
    sample: int = 32_768
    #: Vectors a list should hold, and the bound on the number of lists.
    per_list: int = 48
    lists: int = 1024
    probes: int = 16
    subspaces: int = 16
    codewords: int = 64
    #: Vectors, and queries, that a group holds at most on average.
    chunk: int = 2048
    queries: int = 8192


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c).astype(x.dtype)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + 2048] @ c.T - half).argmax(1) for i in range(0, len(x), 2048))])


class Index:
    def __init__(self, x: np.ndarray, n: int, s: Settings):
        self.settings, d = s, x.shape[1]
        self.coarse = k_means(x, int(np.clip(n // s.per_list, 1, min(s.lists, len(x)))))
        rest = x - self.coarse[nearest(x, self.coarse)]
        cut = np.linspace(0, d, min(s.subspaces, d) + 1).astype(int)
        self.cut = list(zip(cut[:-1], cut[1:]))
        self.words = [k_means(np.ascontiguousarray(rest[:, a:b]), min(s.codewords, len(x)), 5) for a, b in self.cut]

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Lists in order of distance, the first being the vector's own."""
        half = (self.coarse * self.coarse).sum(1) / 2
        k, out = min(self.settings.probes, len(self.coarse)), []
        for i in range(0, len(x), 2048):
            near = x[i : i + 2048] @ self.coarse.T - half
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out)

    def encode(self, x: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors of one list, and the lengths of their coding errors."""
        rest = x - self.coarse[which]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(self.cut, self.words)], axis=1)
        back = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def candidates(self, q: np.ndarray, which: int, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) numbers whose distance may be within the radius, by asymmetric table look-ups."""
        rest = q - self.coarse[which]
        far = np.zeros((len(q), len(codes)), np.float32)
        for k, ((a, b), w) in enumerate(zip(self.cut, self.words)):
            r = rest[:, a:b]
            table = (r * r).sum(1)[:, None] - 2 * r @ w.T + (w * w).sum(1)
            far += table[:, codes[:, k]]
        radius = np.sqrt(2 - 2 * self.settings.cosine)
        return np.nonzero(far <= (radius + error + 1e-3) ** 2)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small for a double
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number that links reach, for each of ``n`` numbers."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            break
    return low


def search_group(table: pa.Table, index: Index) -> pa.Table:
    s = index.settings
    which = table.column("list")[0].as_py()
    vec = table.column("embedding").combine_chunks()
    x = vec.values.to_numpy(zero_copy_only=False).reshape(len(vec), -1).astype(float)
    node, copies, asks = (table.column(c).to_numpy() for c in ("node", "copies", "asks"))
    exact, unit = units(x), units(x).astype(np.float32)
    q, db = np.flatnonzero(asks), np.flatnonzero(~asks)
    lists = table.column("lists").combine_chunks()
    start, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    out: list[tuple] = []
    if len(q) and len(db):
        codes, error = index.encode(unit[db], which)
        count, back, left, right = np.zeros(len(q), np.int64), np.zeros(len(db), np.int64), [], []
        home, visits = flat[start[q]], flat[start[db][:, None] + np.arange(start[db[0] + 1] - start[db[0]])]
        for lo in range(0, len(q), 512):
            a, b = index.candidates(unit[q[lo : lo + 512]], which, codes, error)
            good = []
            for k in range(0, len(a), 1 << 16):
                p, r = q[lo + a[k : k + (1 << 16)]], db[b[k : k + (1 << 16)]]
                good.append((np.einsum("ij,ij->i", exact[p], exact[r]) >= s.cosine) & (node[p] != node[r]))
            if good:
                good = np.concatenate(good)
                a, b = a[good] + lo, b[good]
                np.add.at(count, a, copies[db[b]])
                one_way = ~(visits[b] == home[a][:, None]).any(1)
                np.add.at(back, b[one_way], copies[q[a[one_way]]])
                left.append(a)
                right.append(b)
        a, b = (np.concatenate(z) if left else np.zeros(0, np.int64) for z in (left, right))
        low = linked_groups(len(q) + len(db), a, b + len(q))
        own = np.concatenate([node[q], node[db]])
        out += [(int(node[q[h]]), int(count[h]), None) for h in np.flatnonzero(count)]
        out += [(int(node[db[h]]), int(back[h]), None) for h in np.flatnonzero(back)]
        out += [(int(x), 0, int(y)) for x, y in zip(own, own[low]) if x != y]
    got = list(zip(*out)) if out else [[], [], []]
    return pa.table({"a": pa.array(got[0], pa.int64()), "n": pa.array(got[1], pa.int64()), "b": pa.array(got[2], pa.int64())})


def embedding_classes(table: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row (vec_id, n_links, component_id, kept) for each row of ``table`` (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do rows with a null vec_id,
    which are not kept. Vectors of each length have an index of their own. Rows that repeat a vector count each as another vector.
    Extra columns are not read. An empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    usable = F.coalesce(F.expr(f"vec_id IS NOT NULL AND {finite} AND exists(embedding, x -> x <> 0)"), F.lit(False))
    rows = rows.withColumn("usable", usable)
    size = F.size("embedding")
    lengths = sorted(r[0] for r in rows.filter("usable").select(size.alias("d")).distinct().collect())
    if len(lengths) > 1:
        each = [embedding_classes(table.filter(F.size("embedding") == d), s) for d in lengths]
        rest = rows.filter(F.coalesce(~size.isin(lengths), F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(False).alias("kept"))
        rest = rest.withColumn("kept", F.col("vec_id").isNotNull())
        return reduce(DataFrame.unionByName, each, rest)
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    good = rows.filter("usable")
    nodes = written(good.groupBy("h", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vectors")
    n = nodes.count()
    if n:
        fit = nodes.orderBy(F.xxhash64("node")).limit(s.sample).select("embedding").toArrow().column(0).combine_chunks()
        index = Index(units(fit.values.to_numpy().reshape(len(fit), -1)).astype(np.float32), n, s)

        def place(batches):
            for batch in batches:
                vec = batch.column("embedding")
                if not len(vec):
                    continue
                lists = index.probes(units(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)).astype(np.float32))
                yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "copies": batch.column("copies"), "embedding": vec, "lists": pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))})

        placed = nodes.select("node", "copies", "embedding").mapInArrow(place, "node long, copies long, embedding array<double>, lists array<int>")
        placed = written(placed, "placed")
        size = placed.groupBy(F.col("lists")[0].alias("list")).agg(F.ceil(F.count("*") / s.chunk).alias("parts"))
        asked = placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / s.queries).alias("turns"))
        size = F.broadcast(size.join(asked, "list"))  # at most one row a list
        salt = lambda k, of: F.pmod(F.xxhash64(F.col("node"), F.lit(k)), F.col(of))
        every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
        db = placed.withColumn("list", F.col("lists")[0]).join(size, "list").withColumn("part", salt(1, "parts")).withColumn("turn", every("turns"))
        ask = placed.withColumn("list", F.explode("lists")).join(size, "list").withColumn("turn", salt(2, "turns")).withColumn("part", every("parts"))
        cols = ["list", "part", "turn", "node", "copies", "embedding"]
        # a vector brings the lists it visits, a query only its own
        both = db.select(*cols, "lists", F.lit(False).alias("asks")).unionByName(ask.select(*cols, F.slice("lists", 1, 1).alias("lists"), F.lit(True).alias("asks")))
        found = both.groupBy("list", "part", "turn").applyInArrow(lambda t: search_group(t, index), "a long, n long, b long")
        found = written(found, "found")
    else:
        found = spark.createDataFrame([], "a long, n long, b long")
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("near"))
    parts = components(found.filter("b IS NOT NULL").select("a", "b"), "vectors")
    of_node = nodes.join(counts, nodes.node == counts.a, "left").join(parts.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    of_node = of_node.select(F.col("h").alias("nh"), F.col("embedding").alias("ne"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part"))
    linked = good.join(of_node, (F.col("h") == F.col("nh")) & (F.col("embedding") == F.col("ne"))).select("vec_id", "n_links", F.col("part").alias("component_id"))
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
