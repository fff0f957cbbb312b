"""Most similar vectors for every vector.

Method: a forest of random-projection trees. Each tree halves a bounded sample
of the vectors again and again by a hyperplane between two centroids that start
from two random vectors; all vectors are then routed through the trees. The
search of a vector pops the leaves of *all* trees from one shared queue in the
order of their accumulated distance to the splitting planes, and the popped
leaves' vectors are ranked by their exact cosine.

A leaf is one block of work: its members and the vectors that search it meet in
one matrix product, which serves both directions (member to searcher and back).

Scale: the trees are fitted on eight sampled vectors a leaf, at least ``sample_rows``
and at most ``MOST_SAMPLED`` a field; every vector is indexed. A tree has at least 16
leaves from 512 vectors on (fewer are one block), so that a small field goes through the forest too, and about ``leaf_rows``
vectors a leaf up to 134 million vectors a field, beyond that larger leaves, which are
cut into blocks of ``block_rows``. Vectors without structure must visit ever more leaves
for the same recall (``probes_for``), and each visit ships the vector: 5 copies up to
92 681 vectors, then a number that grows with the power 0.75. Equal vectors are
searched once, so that a field with many copies has no hot leaf.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIM, MIN_DEPTH, MOST_SAMPLED = 64, 4, 1 << 18


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scale to unit length; null, zero and non-finite vectors fall away."""
    for batch in batches:
        column = batch.column("v")
        if not len(column):
            continue
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        size = len(flat) // len(column)
        m = flat.reshape(len(column), size)
        norm = np.linalg.norm(m.astype(np.float64), axis=1)
        good = np.isfinite(norm) & (norm > 0)
        m = (m[good] / norm[good, None]).astype(np.float32)
        mask = pa.array(good)
        yield pa.RecordBatch.from_arrays(
            [batch.column("field").filter(mask), batch.column("key").filter(mask), pa.array([r.tobytes() for r in m], pa.binary())],
            names=["field", "key", "vec"],
        )


def unit_vectors(df: DataFrame, dim: int = DIM) -> DataFrame:
    """(field, key, vec): one unit vector per field and key, as float32 bytes.

    ``df`` has (field, key, v). Null keys, null vectors, vectors with null
    elements or of another length and all-zero vectors are left out. Of several
    vectors under one key the smallest in array order counts.
    """
    kept = df.filter(F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    unit = kept.select("field", "key", F.col("v").cast("array<float>").alias("v")).mapInArrow(_unit, "field string, key string, vec binary")
    return unit.groupBy("field", "key").agg(F.min("vec").alias("vec"))


def _fit_tree(sample: np.ndarray, depth: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the hyperplanes (nodes x dim) and their offsets, breadth first; every split halves its sample."""
    rng = np.random.default_rng(seed)
    groups, levels = [np.arange(len(sample))], []
    for _ in range(depth):
        planes, offsets, below = [], [], []
        for g in groups:
            x = sample[g]
            if len(g) < 2:
                w, m = np.zeros(sample.shape[1], np.float32), 0.0
                side = np.zeros(len(g), bool)
            else:
                a, b = x[rng.choice(len(g), 2, replace=False)]
                for _ in range(4):
                    s = x @ (a - b)
                    side = s > np.median(s)
                    if side.all() or not side.any():
                        break
                    a, b = x[side].mean(0), x[~side].mean(0)
                    a, b = a / (np.linalg.norm(a) + 1e-12), b / (np.linalg.norm(b) + 1e-12)
                w = (a - b) / (np.linalg.norm(a - b) + 1e-12)
                s = x @ w
                m = float(np.median(s))
                side = s > m
            planes.append(w)
            offsets.append(m)
            below += [g[~side], g[side]]
        levels.append((np.array(planes, np.float32), np.array(offsets, np.float32)))
        groups = below
    return levels


def _leaf_costs(levels: list, x: np.ndarray) -> np.ndarray:
    """Rows x leaves: the squared distances to the planes that a path to the leaf crosses, added up."""
    cost = np.zeros((len(x), 1), np.float32)
    for planes, offsets in levels:
        s = x @ planes.T - offsets
        cost = np.stack([cost + np.maximum(s, 0) ** 2, cost + np.maximum(-s, 0) ** 2], axis=2).reshape(len(x), -1)
    return cost


def probes_for(leaves: int, trees: int, at_16: int = 5) -> int:
    """Leaves to pop for a vector: ``at_16`` for 16 leaves, growing with the measured power 0.75 of their number."""
    return min(trees * leaves, max(trees, math.ceil(at_16 * (leaves / 16) ** 0.75)))


def _route(forest: dict, block_rows: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = np.array(batch.column("field").to_pylist())
            ids = batch.column("id").to_numpy()
            raw = batch.column("vec")
            for field in np.unique(fields):
                trees, probes, blocks = forest[field]
                rows = np.flatnonzero(fields == field)
                part = raw.take(pa.array(rows))
                x = np.frombuffer(b"".join(part.to_pylist()), np.float32).reshape(len(rows), -1)
                costs = [_leaf_costs(t, x) for t in trees]
                leaves = costs[0].shape[1]
                own = np.stack([c.argmin(1) + i * leaves for i, c in enumerate(costs)], axis=1)
                every = np.concatenate(costs, axis=1)
                popped = np.argpartition(every, probes - 1, axis=1)[:, :probes] if probes < every.shape[1] else np.tile(np.arange(every.shape[1]), (len(rows), 1))
                search = ~(popped[:, :, None] == own[:, None, :]).any(2)
                r = np.concatenate([np.repeat(np.arange(len(rows)), own.shape[1]), np.nonzero(search)[0]])
                leaf = np.concatenate([own.ravel(), popped[search]])
                member = np.arange(len(r)) < own.size
                # a leaf of several blocks: a member lies in one, a search and the other blocks' members visit each
                n = blocks[leaf]
                home = np.where(member, ids[rows][r] % n, -1)
                at = np.repeat(np.arange(len(r)), n)
                block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([field] * len(at)), pa.array(leaf[at].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array((home[at] == block)), pa.array(ids[rows][r[at]]), part.take(pa.array(r[at]))],
                    names=["field", "leaf", "block", "member", "id", "vec"],
                )

    return route


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if sims.shape[1] > k else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


def _rank(k: int):
    def rank(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(len(ids), -1)
        mi, mx = ids[member], x[member]
        order = np.concatenate([np.flatnonzero(member), np.flatnonzero(~member)])
        out_id, out_nb, out_sim = [], [], []

        def keep(i: np.ndarray, nb: np.ndarray, sim: np.ndarray) -> None:
            good = sim > -2
            out_id.append(np.broadcast_to(i[:, None], nb.shape)[good])
            out_nb.append(nb[good])
            out_sim.append(sim[good])

        if len(mi):
            # running best of each member over the searches that visit its block
            best_nb, best_sim = np.full((len(mi), k), -1, np.int64), np.full((len(mi), k), -9, np.float32)
            for s in range(0, len(order), 1024):
                rows = order[s : s + 1024]
                qi = ids[rows]
                sims = x[rows] @ mx.T
                sims[qi[:, None] == mi[None, :]] = -9
                t = _top(sims, k)
                keep(qi, mi[t], np.take_along_axis(sims, t, 1))
                visiting = ~member[rows]
                if visiting.any():
                    cols, vi = sims[visiting].T, qi[visiting]
                    t = _top(cols, k)
                    nb, sim = np.concatenate([best_nb, vi[t]], axis=1), np.concatenate([best_sim, np.take_along_axis(cols, t, 1)], axis=1)
                    t = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    best_nb, best_sim = np.take_along_axis(nb, t, 1), np.take_along_axis(sim, t, 1)
            keep(mi, best_nb, best_sim)
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"id": cat(out_id, np.int64), "nb": cat(out_nb, np.int64), "sim": cat(out_sim, np.float32)})

    return rank


def _sample(vecs: DataFrame, counts: dict[str, int], rows: int) -> dict[str, np.ndarray]:
    """At most ``rows`` vectors of each field, chosen by a hash of the vector: the same at every run."""
    share = F.create_map(*[F.lit(x) for f, n in counts.items() for x in (f, min(1.0, 1.1 * rows / n))])
    chosen = vecs.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < share[F.col("field")] * (1 << 20)).select("field", "vec")
    out: dict[str, list] = {f: [] for f in counts}
    for r in chosen.limit(2 * rows * len(counts)).collect():
        out[r.field].append(bytes(r.vec))
    return {f: np.frombuffer(b"".join(sorted(v)[:: max(1, len(v) // rows)][:rows]), np.float32).reshape(-1, DIM if not v else len(v[0]) // 4) for f, v in out.items()}


def nearest(vecs: DataFrame, k: int = 5, trees: int = 3, leaf_rows: int = 4096, block_rows: int = 8192, sample_rows: int = 16384, probes_at_16: int = 5) -> DataFrame:
    """(field, id, nb, sim): for each row of ``vecs`` (field, id, vec) the ``k`` best candidates of the forest.

    ``vec`` holds unit vectors as float32 bytes, ``id`` is unique. A field of one
    vector has no neighbours; of equal cosines the smaller id comes first.
    """
    counts = {r.field: r.n for r in vecs.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = vecs.sparkSession
    if not counts:
        return spark.createDataFrame([], "field string, id bigint, nb bigint, sim float")
    largest = max(counts.values())
    samples, forest = _sample(vecs, counts, min(MOST_SAMPLED, max(sample_rows, 8 * largest // leaf_rows))), {}
    for field, n in counts.items():
        depth = 0 if n < 32 << MIN_DEPTH else min(max(MIN_DEPTH, round(math.log2(max(1, n / leaf_rows)))), int(math.log2(max(1, len(samples[field]) / 8))))
        fitted = [_fit_tree(samples[field], depth, 7 * i + 1) for i in range(trees if depth else 1)]
        # blocks of a leaf: from its share of the sample, so that no block exceeds block_rows by much
        blocks = np.concatenate([np.bincount(_leaf_costs(t, samples[field]).argmin(1), minlength=1 << depth) for t in fitted])
        blocks = np.maximum(1, np.ceil(blocks / max(1, len(samples[field])) * n / block_rows)).astype(np.int64)
        forest[field] = (fitted, probes_for(1 << depth, len(fitted), probes_at_16), blocks)
    # the planes: MOST_SAMPLED / 8 nodes a tree at most, 25 MB a field
    shared = spark.sparkContext.broadcast(pickle.dumps(forest))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _route(pickle.loads(shared.value), block_rows)(batches)

    routed = vecs.mapInArrow(route, "field string, leaf int, block int, member boolean, id bigint, vec binary")
    found = routed.groupBy("field", "leaf", "block").applyInArrow(_rank(k), "id bigint, nb bigint, sim float")
    best = found.groupBy("id", "nb").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "nb")
    return best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def similar_pairs(df: DataFrame, k: int = 5, dim: int = DIM, **how) -> DataFrame:
    """(field_name, key_a, key_b), key_a < key_b: pairs of which one is among the ``k`` most similar of the other.

    ``df`` has (field, key, v). Equal vectors are one class: the search runs over
    classes, its result is given back to the keys. A key with ``k`` or more
    copies pairs with the first of them in key order (ties at cosine 1); a class
    of fewer members fills the rest from the nearest classes, key by key.
    """
    vecs = unit_vectors(df, dim)
    classes = materialize(vecs.groupBy("field", "vec").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    near = nearest(classes.select("field", "id", "vec"), k, **how)
    names = classes.select("id", "field", F.col("rep").alias("key"), "n")
    a, b = names.select(*[F.col(c).alias(f"{c}_a") for c in names.columns]), names.select(*[F.col(c).alias(f"{c}_b") for c in names.columns])
    edges = near.join(a, near.id == F.col("id_a")).join(b, near.nb == F.col("id_b"))
    single = edges.filter((F.col("n_a") == 1) & (F.col("n_b") == 1)).select("field_a", "key_a", "key_b", "sim", "id_a")
    copies = classes.filter("n > 1").select("field", "vec", "id", "n")
    if not copies.limit(1).count():
        pairs = single.select(F.col("field_a").alias("field"), F.col("key_a").alias("x"), F.col("key_b").alias("y"))
    else:
        keyed = vecs.join(copies, ["field", "vec"]).select("id", "field", "key", "n")
        # the filter on row_number is applied before the shuffle too, so a class of any size sends k + 1 keys a task
        first = keyed.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("key"))).filter(F.col("r") <= k + 1)
        within = keyed.join(first.select("id", F.col("key").alias("y")), "id").filter(F.col("key") != F.col("y"))
        within = within.withColumn("r", F.row_number().over(Window.partitionBy("field", "key").orderBy("y"))).filter(F.col("r") <= k).select("field", F.col("key").alias("x"), "y")
        members = first.filter(F.col("r") <= k).select("id", "key").unionByName(classes.filter("n = 1").select("id", F.col("rep").alias("key")))
        outward = edges.filter(F.col("n_a") <= k).join(members.select(F.col("id").alias("nb"), F.col("key").alias("y")), "nb")
        outward = outward.withColumn("r", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("sim"), "key_b", "y"))).filter(F.col("r") <= F.lit(k + 1) - F.col("n_a"))
        across = outward.join(members.select(F.col("id").alias("id_a"), F.col("key").alias("x")), "id_a").select(F.col("field_a").alias("field"), "x", "y")
        pairs = within.unionByName(across)
    return pairs.select(F.col("field").alias("field_name"), F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def catalogue_vectors(spark, sf_dir: str) -> DataFrame:
    """(field, key, v) of the three vector columns."""
    chunks = spark.read.parquet(f"{sf_dir}/chunk_index.parquet")
    docs = spark.read.parquet(f"{sf_dir}/doc_index.parquet")
    pick = lambda d, name, key, col: d.select(F.lit(name).alias("field"), F.col(key).alias("key"), F.col(col).alias("v"))
    return (
        pick(chunks, "proposition_embedding", "chunk_id", "proposition_embedding")
        .unionByName(pick(chunks, "section_summary_embedding", "parent_section_id", "section_summary_embedding"))
        .unionByName(pick(docs, "summary_embedding", "document_id", "summary_embedding"))
    )


def p4_found(spark, sf_dir: str) -> DataFrame:
    return similar_pairs(catalogue_vectors(spark, sf_dir))
