"""Filling fixed-capacity containers with texts.

Method: lexical retrieval packing. The texts are dealt to shards of lexically
close texts; each shard has a BM25 index over the tokens of its whole texts, with
the document frequencies and the mean length of all texts. The longest unused
text is the seed of a container, all unused texts of the shard that share a token
with it follow in the order of their score as long as they fit, and the last part
of the room takes the largest of them that fit. A text longer than the capacity is
cut into full containers and a rest that is packed like a text of its own.

Shards: BM25 weights, randomly projected to ``DIMS`` numbers, go down a tree of
two-means splits fitted on at most ``SAMPLE`` texts; where its sample is used up,
the tree goes on with random directions. A leaf far beyond ``shard_texts`` is
split by the hash of the id.

Scale: every text is tokenised once, all else reads its tokens. A shard holds about ``shard_texts`` texts whatever the size of the
collection, so the work is in proportion and no task sees more. Document
frequencies are one row a token of the tokenizer's vocabulary. Each shard leaves
at most one container far from full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread
from .tokens import TOKENIZER, encoding, opened, shipped

SHARD_TEXTS, MAX_PLANS, LAST = 1024, 1000, 0.1
DIMS, SAMPLE = 128, 16384
K1, B = 1.2, 0.75
_turns: dict[int, np.ndarray] = {}


def _reader(ranks, code: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = opened(ranks)
        for batch in batches:
            tokens = [np.array(t, code).tobytes() for t in enc.encode_ordinary_batch(batch.column("text").to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.binary())], names=["doc_id", "tokens"])

    return read


def tokenised(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, width) of the texts with a token, of 2 or 4 bytes each; every text meets the tokenizer once."""
    width = 2 if encoding(path).max_token_value < 1 << 16 else 4
    return materialize(rows.select("doc_id", "text").mapInArrow(_reader(shipped(rows.sparkSession, path), f"<u{width}"), "doc_id bigint, tokens binary").filter(F.length("tokens") > 0).withColumn("width", F.lit(width)))


def _read(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    width = batch.column("width")[0].as_py() if len(batch) else 4
    return [np.frombuffer(x, f"<u{width}").astype(np.int64) for x in batch.column("tokens").to_pylist()]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and count of each different token of a row, and the rows' sizes."""
    tokens = _read(batch)
    sizes = np.array([len(x) for x in tokens], np.int64)
    cell, tf = np.unique(np.repeat(np.arange(len(tokens)), sizes) << 32 | np.concatenate([*tokens, np.zeros(0, np.int64)]), return_counts=True)
    return cell >> 32, cell & 0xFFFFFFFF, tf, sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n, total = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        _, token, _, sizes = _flat(batch)
        more = np.bincount(token, minlength=len(df))
        more[: len(df)] += df
        df, n, total = more, n + len(sizes), total + int(sizes.sum())
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[df[at], n, total])], names=["token", "n"])


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency by token, number of texts, and their mean length; one collected row a token of the tokenizer's vocabulary."""
    got = tokens.select("tokens", "width").mapInArrow(_count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(got.token.tolist(), got.n.tolist()))
    n, total = by.pop(-1, 0), by.pop(-2, 0)
    df = np.zeros(max(by, default=0) + 1, np.int64)
    df[list(by)] = list(by.values())
    return df, n, total / max(1, n)


def _vectors(batch: pa.RecordBatch, stats: tuple[np.ndarray, int, float]) -> np.ndarray:
    """Projected BM25 weights of unit length."""
    df, n, mean = stats
    if len(df) not in _turns:
        _turns[len(df)] = np.random.default_rng(7).standard_normal((len(df), DIMS), np.float32)
    turn, (row, token, tf, sizes) = _turns[len(df)], _flat(batch)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = (idf[token] * tf / (tf + K1 * (1 - B + B * sizes[row] / max(1.0, mean)))).astype(np.float32)
    ends, out = np.searchsorted(row, np.arange(len(sizes) + 1)), np.zeros((len(sizes), DIMS), np.float32)
    for i, (s, e) in enumerate(zip(ends, ends[1:])):
        out[i] = weight[s:e] @ turn[token[s:e]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_tree(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, cuts and children of a tree; a child below zero is the leaf -1 - child. Leaves get equal parts of the sample."""
    rng = np.random.default_rng(8)
    axes, cuts, kids, todo, last = [], [], [], [(np.arange(len(sample)), leaves, -1, 0)], 0
    while todo:
        at, k, parent, side = todo.pop()
        if k == 1:
            me, last = -1 - last, last + 1
        else:
            me, x = len(axes), sample[at]
            axis, cut = rng.standard_normal(DIMS).astype(np.float32), 0.0
            if len(at) >= 16:
                two = x[rng.choice(len(x), 2, replace=False)]
                for _ in range(8):
                    near = (x @ (two[1] - two[0])) > (two[1] - two[0]) @ (two[0] + two[1]) / 2
                    if near.all() or not near.any():
                        break
                    two = np.stack([x[~near].mean(0), x[near].mean(0)])
                axis = two[1] - two[0] if np.abs(two[1] - two[0]).max() > 1e-6 else axis
                cut = float(np.quantile(x @ axis, (k // 2) / k))
            right = x @ axis > cut
            axes.append(axis), cuts.append(cut), kids.append([0, 0])
            todo += [(at[right], k - k // 2, me, 1), (at[~right], k // 2, me, 0)]
        if parent >= 0:
            kids[parent][side] = me
    return np.array(axes, np.float32).reshape(-1, DIMS), np.array(cuts, np.float32), np.array(kids, np.int64).reshape(-1, 2)


def leaf_of(vectors: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    axes, cuts, kids = tree
    node = np.full(len(vectors), 0 if len(axes) else -1, np.int64)
    while (going := np.flatnonzero(node >= 0)).size:
        at = node[going]
        node[going] = kids[at, ((vectors[going] * axes[at]).sum(1) > cuts[at]).astype(np.int64)]
    return -1 - node


def dealt(tokens: DataFrame, stats: tuple[np.ndarray, int, float], shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """``tokens`` (doc_id, tokens) with the shard of lexically close texts that each belongs to."""
    context = tokens.sparkSession.sparkContext
    leaves = max(1, -(-stats[1] // shard_texts))
    shared = context.broadcast(stats)
    tree = (np.zeros((0, DIMS), np.float32), np.zeros(0, np.float32), np.zeros((0, 2), np.int64))
    if leaves > 1:

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _vectors(batch, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in v], pa.binary())], names=["doc_id", "vec"])

        some = tokens.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < min(1 << 30, int(SAMPLE / stats[1] * (1 << 30))))
        got = sorted((r.doc_id, bytes(r.vec)) for r in some.mapInArrow(project, "doc_id bigint, vec binary").limit(2 * SAMPLE).collect())
        tree = fit_tree(np.frombuffer(b"".join(v for _, v in got), np.float32).reshape(-1, DIMS), leaves)
    sent = context.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(_vectors(batch, shared.value), sent.value) if len(sent.value[0]) else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "tokens", "width")], pa.array(leaf)], names=["doc_id", "tokens", "width", "leaf"])

    placed = materialize(tokens.mapInArrow(deal, "doc_id bigint, tokens binary, width int, leaf bigint"))
    # leaves that hold too many texts are few; written first, so that the tokens are shuffled once
    parts = materialize(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (1.5 * shard_texts)).alias("parts")).filter("parts > 1"))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))
    return placed.join(parts, "leaf", "left").select("doc_id", "tokens", "width", (F.col("leaf") * F.lit(1 << 31) + piece).alias("shard"))


def bm25_scores(texts: list[np.ndarray], dense_from: int = 32, stats: tuple[np.ndarray, int, float] | None = None) -> np.ndarray:
    """Score of every text (column) for every text as a query (row); the query counts each of its terms once.

    ``stats`` are those of the whole collection; without them the texts are the collection.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(texts) if n else np.zeros(0, np.int64)
    cell, tf = np.unique(doc.astype(np.int64) << 32 | flat, return_counts=True)
    doc, term = cell >> 32, cell & 0xFFFFFFFF
    terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
    all_df, all_n, mean = (stats[0][terms], stats[1], stats[2]) if stats else (df, n, sizes.mean() if n else 1.0)
    idf = np.log(1 + (all_n - all_df + 0.5) / (all_df + 0.5))
    length = K1 * (1 - B + B * sizes / max(1.0, mean))
    weight = (idf[at] * tf * (K1 + 1) / (tf + length[doc])).astype(np.float32)
    scores = np.zeros((n, n), np.float32)
    often = df >= dense_from
    pick = often[at]
    if pick.any():
        column = np.cumsum(often) - 1
        w = np.zeros((n, int(often.sum())), np.float32)
        w[doc[pick], column[at[pick]]] = weight[pick]
        scores += (w > 0).astype(np.float32) @ w.T
    order = np.flatnonzero(~pick & (df[at] > 1))
    order = order[np.argsort(at[order], kind="stable")]
    # postings of rarer terms, by their length, as small outer products
    counts = df[at[order]]
    for k in np.unique(counts):
        rows = order[counts == k].reshape(-1, k)
        q = np.repeat(doc[rows], k, axis=1).ravel()
        d = np.tile(doc[rows], (1, k)).ravel()
        np.add.at(scores.reshape(-1), q * n + d, np.tile(weight[rows], (1, k)).ravel())
    np.fill_diagonal(scores, -1)
    return scores


def fill(sizes: np.ndarray, scores: np.ndarray, capacity: int) -> list[list[tuple[int, bool]]]:
    """Containers as lists of (item, was it retrieved), the seed first.

    A seed asks for its unused neighbours, nearest first, and takes those that
    fit; once room for ``LAST`` of the capacity is left, the largest of its
    unused neighbours that fits. What shares no token with the seed comes only
    when no neighbour fits any more.
    """
    order, out = np.lexsort((np.arange(len(sizes)), -sizes)), []
    free = np.ones(len(sizes), bool)
    for seed in order:
        if not free[seed]:
            continue
        free[seed] = False
        box, room = [(int(seed), False)], capacity - int(sizes[seed])
        fits = np.flatnonzero(free & (sizes <= room))
        near = fits[scores[seed, fits] > 0]
        near = near[np.argsort(-scores[seed, near], kind="stable")]
        far = fits[scores[seed, fits] <= 0]
        while len(near) and room > LAST * capacity:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[near]), room - LAST * capacity, "right")))
            box += [(int(i), True) for i in near[:n]]
            free[near[:n]] = False
            room -= int(sizes[near[:n]].sum())
            near = near[n:][sizes[near[n:]] <= room]
        for nearest in (True, False):
            found = near if nearest else far[sizes[far] <= room]
            while len(found):
                i = int(found[np.argmax(sizes[found])])
                box.append((i, nearest))
                free[i] = False
                room -= int(sizes[i])
                found = found[(found != i) & (sizes[found] <= room)]
        out.append(box)
    return out


def _pack(plans: list[tuple[str, int]], shared):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, shard = table.column("doc_id").to_numpy(), table.column("shard")[0].as_py() if len(table) else 0
        tokens = _read(table)
        scores, lengths = bm25_scores(tokens, stats=shared.value), np.array([len(t) for t in tokens], np.int64)
        rows = []
        for name, capacity in plans:
            # full containers of the texts beyond the capacity, and what is left of each
            whole = (lengths - 1) // capacity
            rest = lengths - whole * capacity
            box = 0
            for i in np.flatnonzero(whole):
                for p in range(int(whole[i])):
                    rows.append((name, capacity, f"{name}-{shard}-{box}", int(ids[i]), p, p * capacity, capacity, 0, "seed", None))
                    box += 1
            for items in fill(rest, scores, capacity):
                seed = items[0][0]
                for position, (j, near) in enumerate(items):
                    part = int(whole[j])
                    rows.append((name, capacity, f"{name}-{shard}-{box}", int(ids[j]), part, part * capacity, int(rest[j]), position, "seed" if not position else "neighbour" if near else "size", float(scores[seed, j]) if position else None))
                box += 1
        cols = list(zip(*rows)) if rows else [[] for _ in range(10)]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["plan_name", "capacity_tokens", "container_id", "doc_id", "part_no", "start_token", "n_tokens", "position", "placed_as", "score"])

    return pack


def containers(texts: DataFrame, plans: DataFrame, path: str = TOKENIZER, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(plan_name, capacity_tokens, container_id, doc_id, part_no, start_token, n_tokens, position, placed_as, score)

    ``texts`` has (doc_id, text), ``plans`` a few rows (plan_name, capacity_tokens).
    One row per plan and text, more for texts longer than the capacity: parts in
    the order of their first token. ``placed_as`` is ``seed``, ``neighbour`` (retrieved,
    with its score for the seed) or ``size`` (shares no token with the seed). Texts
    without a token, null texts and null ids need no container; plans without a
    positive capacity are left out; more than ``MAX_PLANS`` plans are an error.
    """
    few = plans.filter("plan_name is not null and capacity_tokens > 0").distinct().orderBy("plan_name", "capacity_tokens").limit(MAX_PLANS + 1).collect()
    if len(few) > MAX_PLANS:
        raise ValueError(f"more than {MAX_PLANS} plans")
    tokens = tokenised(spread(texts.select("doc_id", "text").filter("doc_id is not null and text <> ''"), "doc_id"), path)
    stats = statistics(tokens)
    shared = tokens.sparkSession.sparkContext.broadcast(stats)
    shards = dealt(tokens, stats, shard_texts).groupBy("shard")
    columns = "plan_name string, capacity_tokens int, container_id string, doc_id bigint, part_no int, start_token bigint, n_tokens int, position int, placed_as string, score double"
    return shards.applyInArrow(_pack([(r.plan_name, r.capacity_tokens) for r in few], shared), columns)


def p6_containers(spark, sf_dir: str) -> DataFrame:
    return containers(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/container_sizes.parquet"))


def p6_fill(spark, sf_dir: str) -> DataFrame:
    """Per plan: containers, pieces, tokens, the share of the capacity in use, and the share of the placed pieces that were retrieved, with their mean score."""
    packed = p6_containers(spark, sf_dir)
    near, other = F.count_if(F.col("placed_as") == "neighbour"), F.count_if(F.col("placed_as") == "size")
    each = packed.groupBy("plan_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"), near.alias("near"), other.alias("other"), F.sum("score").alias("score"))
    each = each.groupBy("plan_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), *[F.sum(c).alias(c) for c in ("pieces", "used", "near", "other", "score")])
    placed = F.col("near") + F.col("other")
    return each.select(
        "plan_name", "capacity_tokens", "containers", "pieces", F.col("used").alias("tokens"), F.round(F.col("used") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("filled"),
        F.round(F.try_divide("near", placed), 4).alias("retrieved"), F.round(F.try_divide("score", placed), 4).alias("mean_score"),
    )
