"""Vector search, BM25, rank fusion and the expansion of hits.

One question: its vector and terms are literals of the plan, the index is scanned
without a shuffle of vectors or texts, and only the best rows leave the tasks.
Many questions: they are rows; vectors meet the index in blocks of matrix
products, terms meet the rows' words inside the tasks. Rows may repeat; each counts once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.functions.text import analyze
from docloom.functions.vector import dot

K1, B, RRF_K = 1.2, 0.75, 60


def usable(vector: Column) -> Column:
    """Neither null nor all zero."""
    return vector.isNotNull() & F.exists(vector, lambda v: v != 0)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine with one query vector, which is a literal of the plan."""
    q = [float(v) for v in query]
    norm = sum(v * v for v in q) ** 0.5
    return F.round(dot(vector, F.array(*[F.lit(v) for v in q])) / (F.sqrt(dot(vector, vector)) * norm), 6)


def ranked(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The ``k`` best rows of distinct rows with their rank from 1; only they reach the single ranking task."""
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("bigint"))


def best_distinct(df: DataFrame, k: int) -> DataFrame:
    """``ranked`` of rows that may repeat: the best ``4 k`` rows usually hold ``k`` different ones; where they don't, repeats are removed by a shuffle."""
    rows = df.orderBy(F.desc("score"), "id").limit(4 * k).collect()
    few = list(dict.fromkeys(rows))
    if len(few) < k and len(rows) == 4 * k:
        return ranked(df.distinct(), k)
    schema = StructType([*df.schema.fields, StructField("rank", LongType())])
    return df.sparkSession.createDataFrame([(*r, i + 1) for i, r in enumerate(few[:k])], schema)


def knn(nodes: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """Exact search by ``v``: the filter holds before the ranking, so up to ``k`` rows match it.

    Gives the columns of ``nodes`` but for the vector, ``score`` and ``rank``. Repeated
    rows count once, without a shuffle of the index.
    """
    kept = nodes.filter(usable(F.col("v")))
    kept = kept if where is None else kept.filter(where)
    return best_distinct(kept.withColumn("score", cosine_to(F.col("v"), query)).drop("v"), k)


def knn_then_filter(nodes: DataFrame, query: list[float], k: int, where: Column) -> DataFrame:
    """Exact search, then the filter: may give fewer than ``k`` rows."""
    return knn(nodes, query, k).filter(where)


def part_of(tf: Column, dl: Column, df: Column, total: Column, mean: Column) -> Column:
    """What one term adds to a row's BM25 score."""
    idf = F.log(1 + (total - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def bm25(nodes: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """(id, score) of rows with a query term. Statistics are those of all rows; filters come after.

    Texts are tokenised once, in the scan; a shuffle of (id, length, the terms found)
    removes repeated rows and serves both the statistics and the scores.
    """
    wanted = F.array(*[F.lit(x) for x in terms]) if terms else F.array().cast("array<string>")
    words = nodes.filter(F.col(text).isNotNull()).select("id", analyze(F.col(text)).alias("t"))
    docs = words.select("id", F.size("t").alias("dl"), F.filter("t", lambda w: F.array_contains(wanted, w)).alias("found")).distinct()
    stats = docs.agg(F.count(F.lit(1)).alias("total"), F.avg("dl").alias("mean"))
    tf = docs.select("id", "dl", F.explode("found").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row a query term, and one row of statistics
    hit = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    return hit.groupBy("id").agg(F.round(F.sum(part_of(F.col("tf"), F.col("dl"), F.col("df"), F.col("total"), F.col("mean"))), 6).alias("score"))


def postings(nodes: DataFrame, text: str = "text") -> DataFrame:
    """(term, id, dl, tf) of every distinct row: the index that many questions read; write it partitioned or bucketed by term."""
    docs = nodes.filter(F.col(text).isNotNull()).select("id", analyze(F.col(text)).alias("t"))
    lists = docs.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    per = lists.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("n"))
    # a repeated row repeats all its terms
    again = docs.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return per.join(again, "id").select("term", "id", "dl", F.ceil(F.col("n") / F.col("copies")).cast("int").alias("tf"))


def bm25_batch(index: DataFrame, sizes: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the ``k`` best rows of each question.

    ``index`` is that of ``postings``, ``sizes`` one row (total, mean), ``questions`` has
    (qid, term), each term once. The postings of the questions' terms are gathered by id.
    """
    wanted = index.join(questions.select("term").distinct(), "term", "left_semi")
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("dl", "term", "tf")).alias("p")).select("id", "p.dl", "p.term", "p.tf")
    return best_by_terms(lists, wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), sizes, questions, k)


def bm25_batch_texts(nodes: DataFrame, questions: DataFrame, k: int, text: str = "text") -> DataFrame:
    """``bm25_batch`` straight from the rows: the different texts of an id, each of which counts, are shuffled once, and no posting is."""
    texts = nodes.filter(F.col(text).isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.collect_set(text).alias("texts"))
    docs = texts.select("id", F.transform("texts", analyze).alias("docs"))
    sizes = docs.agg(F.sum(F.size("docs").cast("bigint")).alias("total"), F.sum(F.size(F.flatten("docs")).cast("bigint")).alias("words"))
    sizes = sizes.select("total", (F.col("words") / F.col("total")).alias("mean"))
    lists = docs.select("id", F.flatten(F.transform("docs", lambda d: F.array_repeat(F.size(d), F.size(d)))).alias("dl"), F.flatten("docs").alias("term"))
    # an id's words of texts of one length count together
    seen = lists.select("id", F.explode(F.arrays_zip("dl", "term")).alias("p")).select("id", "p.dl", "p.term").distinct()
    df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return best_by_terms(lists.withColumn("tf", F.transform("term", lambda _: F.lit(1))), df, sizes, questions, k)


def best_by_terms(lists: DataFrame, df: DataFrame, sizes: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) from one row an id with its postings as arrays (dl, term, tf), and (term, df).

    Questions go out in blocks of at most ``QUESTIONS``. A task sums the parts of a
    question's terms over ``ROWS`` ids at a time and sends its ``k`` best ids a question, from
    at most two tasks a core, so pairs of question and id are never shuffled.
    """
    spark = lists.sparkSession
    size = sizes.first()  # one row
    asked = questions.select("qid", "term").distinct().join(df, "term").groupBy("qid").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    kind, qkind = dict(lists.dtypes)["id"], dict(asked.dtypes)["qid"]
    lists = lists.select("id", "dl", "term", "tf").coalesce(2 * spark.sparkContext.defaultParallelism)

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, index, idf, terms, mean = pickle.loads(shared.value)
            best: list[list] = [[] for _ in qids]
            for part in in_chunks(batches, ROWS):
                found = part.column("term").combine_chunks().flatten().dictionary_encode()
                term = np.array([index.get(t, -1) for t in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]
                of = np.repeat(np.arange(part.num_rows), part.column("term").combine_chunks().value_lengths().to_numpy())
                dl, tf = (part.column(c).combine_chunks().flatten().to_numpy()[term >= 0].astype(np.int64) for c in ("dl", "tf"))
                of, term = of[term >= 0], term[term >= 0]
                if not len(term):
                    continue
                # texts of an id that differ in length are apart; then the postings in the order of their terms
                span = dl.max() + 1
                entry, at = np.unique(of * span + dl, return_inverse=True)
                key, at = np.unique(term * len(entry) + at, return_inverse=True)
                term, of, dl, tf = key // len(entry), entry[key % len(entry)] // span, entry[key % len(entry)] % span, np.bincount(at, tf)
                score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
                first = np.searchsorted(term, np.arange(len(idf) + 1))
                ids = part.column("id").to_pylist()
                for j, mine in enumerate(terms):
                    spans = [(a, b) for a, b in zip(first[mine].tolist(), first[mine + 1].tolist()) if a < b]
                    if not spans:
                        continue
                    sums = np.bincount(np.concatenate([of[a:b] for a, b in spans]), np.concatenate([score[a:b] for a, b in spans]), len(ids))
                    have = best[j]
                    rows = np.flatnonzero(sums > (max(0.0, -have[-1][0] - 1e-6) if len(have) == k else 0.0))
                    got = np.round(sums[rows], 6)
                    if len(rows) > k:  # ties of the last place stay
                        good = got >= np.partition(got, len(got) - k)[len(got) - k]
                        rows, got = rows[good], got[good]
                    if len(rows):
                        best[j] = sorted([*have, *((-s, ids[i]) for i, s in zip(rows.tolist(), got.tolist()))])[:k]
            out = [(qid, i, -s) for qid, have in zip(qids, best) for s, i in have]
            yield hits_of(out, qkind, kind)

        return run

    def ask(rows: list) -> DataFrame:
        index: dict[str, int] = {}
        terms = [np.array([index.setdefault(t.term, len(index)) for t in r.terms], np.int64) for r in rows]
        n = np.zeros(len(index))
        for r, mine in zip(rows, terms):
            n[mine] = [t.df for t in r.terms]
        idf = np.log(1 + (size.total - n + 0.5) / (n + 0.5))
        shared = spark.sparkContext.broadcast(pickle.dumps(([r.qid for r in rows], index, idf, terms, size.mean)))
        return lists.mapInArrow(search(shared), f"qid {qkind}, id {kind}, score double")

    return top_of_each(in_blocks(asked, ask, f"qid {qkind}, id {kind}, score double").repartition("qid"), k)


def in_chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they hold ``rows`` rows or 32 MB."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= 1 << 25:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def hits_of(rows: list, qkind: str, kind: str) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(cols[0]), ARROW[qkind]), pa.array(list(cols[1]), ARROW[kind]), pa.array(list(cols[2]), pa.float64())], names=["qid", "id", "score"])


def in_blocks(asked: DataFrame, ask, schema: str) -> DataFrame:
    """The answers of ``ask`` to blocks of at most ``QUESTIONS`` questions; one block at a time is on the driver."""
    found, block = [], []
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == QUESTIONS:
            found.append(ask(block))
            block = []
    if block:
        found.append(ask(block))
    return reduce(lambda a, b: a.unionByName(b), found) if found else asked.sparkSession.createDataFrame([], schema)


def top_of_each(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


QUESTIONS, ROWS = 4096, 16384  # of a block, and of a chunk of the index
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def knn_batch(nodes: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the ``k`` most similar rows of each question, exactly.

    ``nodes`` has (id, v), ``questions`` (qid, v), one row each. Questions go out in
    blocks of at most ``QUESTIONS``; each task multiplies its part of the index with
    the block and sends ``k`` rows a question. Null, all-zero and vectors of another length
    than the questions' are left out.
    """
    spark = nodes.sparkSession
    asked = questions.filter(usable(F.col("v"))).select("qid", F.col("v").cast("array<double>").alias("v"))
    # from at most two tasks a core, as each sends k rows a question
    kept = nodes.filter(usable(F.col("v"))).select("id", F.col("v").cast("array<double>").alias("v")).coalesce(2 * spark.sparkContext.defaultParallelism)
    kind = dict(kept.dtypes)["id"]
    qkind = dict(asked.dtypes)["qid"]

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = pickle.loads(shared.value)
            best: list[dict] = [{} for _ in qids]
            least = np.full(len(qids), -2.0)
            for batch in batches:
                sizes = np.array(batch.column("v").value_lengths())
                rows = np.flatnonzero(sizes == q.shape[1])
                if not len(rows):
                    continue
                part = batch.take(pa.array(rows))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                ids = part.column("id").to_pylist()
                once = list({(i, v.tobytes()): n for n, (i, v) in enumerate(zip(ids, x))}.values())
                x, ids = x[once] / np.linalg.norm(x[once], axis=1, keepdims=True), [ids[n] for n in once]
                # so many of the best rows hold the k best ids, also where ids have several vectors
                most = k + len(ids) - len(set(ids))
                for start in range(0, len(qids), 512):
                    sims = q[start : start + 512] @ x.T
                    for j, row in enumerate(sims, start):
                        have = best[j]
                        near = np.flatnonzero(row >= least[j] - 1e-6)
                        got = np.round(row[near], 6)
                        if len(near) > most:  # ties of the last place stay
                            good = got >= np.partition(got, len(got) - most)[len(got) - most]
                            near, got = near[good], got[good]
                        if not len(near):
                            continue
                        for i, s in zip(near.tolist(), got.tolist()):
                            have[ids[i]] = max(s, have.get(ids[i], -2.0))
                        best[j] = have = dict(sorted(have.items(), key=lambda e: (-e[1], e[0]))[:k])
                        if len(have) == k:
                            least[j] = min(have.values())
            out = [(qid, i, s) for qid, have in zip(qids, best) for i, s in sorted(have.items(), key=lambda e: (-e[1], e[0]))[:k]]
            yield hits_of(out, qkind, kind)

        return run

    def ask(rows: list) -> DataFrame:
        q = np.array([r.v for r in rows], np.float64)
        shared = spark.sparkContext.broadcast(pickle.dumps(([r.qid for r in rows], q / np.linalg.norm(q, axis=1, keepdims=True))))
        return kept.mapInArrow(search(shared), f"qid {qkind}, id {kind}, score double")

    found = in_blocks(asked, ask, f"qid {qkind}, id {kind}, score double")
    return top_of_each(found.repartition("qid").groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def rrf_batch(*lists: DataFrame, k: int, c: int = RRF_K) -> DataFrame:
    """(qid, id, score, rank): ranked lists of many questions fused; ties keep the first list's order."""
    both = reduce(lambda a, b: a.unionByName(b), [x.select("qid", "id", "rank", F.lit(i).alias("arm")) for i, x in enumerate(lists)])
    g = both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"), F.min(F.struct("arm", "rank")).alias("f"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "f", "id")
    return g.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).drop("f")


def bm25_best_field(nodes: DataFrame, terms: list[str], boosts: dict[str, float]) -> DataFrame:
    """The largest boosted score of several fields."""
    parts = [bm25(nodes, terms, f).select("id", (F.col("score") * b).alias("score")) for f, b in boosts.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


def rrf(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score, arm, best): ranks of several lists summed as 1 / (k + rank); ties keep the first list's order."""
    both = reduce(lambda a, b: a.unionByName(b), [x.select("id", "rank", F.lit(i).alias("arm")) for i, x in enumerate(lists)])
    first = F.min(F.struct("arm", "rank"))
    g = both.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), first.alias("f"))
    return g.select("id", "score", F.col("f.arm").alias("arm"), F.col("f.rank").alias("best"))


def fused(k: int, *lists: DataFrame) -> DataFrame:
    top = rrf(*lists).orderBy(F.desc("score"), "arm", "best", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "arm", "best", "id")).cast("bigint")).select("id", "score", "rank")


def hybrid(nodes: DataFrame, query: list[float], terms: list[str], k: int, depth: int | None = None, where: Column | None = None) -> DataFrame:
    """Vector and text search to ``depth`` (2k), fused, cut to ``k``. A filter holds after the text statistics."""
    depth = depth or 2 * k
    text = bm25(nodes, terms)
    if where is not None:
        text = text.join(nodes.filter(where).select("id").distinct(), "id", "left_semi")
    return fused(k, knn(nodes, query, depth, where), ranked(text, depth))


def small_to_big(hits: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections of the hits in the order of their first, with the best score and the full text; a section without text gives its hit's.

    ``hits`` has (section_id, score, rank, text), a few rows.
    """
    h = hits.filter("section_id is not null")
    best = h.groupBy("section_id").agg(F.max("score").alias("score"), F.min("rank").alias("position"), F.max_by("text", F.struct("score", -F.col("rank"))).alias("text"))
    # the hits' few sections select the texts, so that no other text is shuffled
    mine = F.broadcast(best.select("section_id"))
    t, pages = texts.withColumnRenamed("text", "full").join(mine, "section_id", "left_semi"), pages.join(mine, "section_id", "left_semi")
    return best.join(t, "section_id", "left").join(pages, "section_id", "left").select("section_id", "score", "position", "first_page", "last_page", F.coalesce("full", "text").alias("content"))


def auto_merge(hits: DataFrame, nodes: DataFrame, most: int = 50) -> DataFrame:
    """(id, section_id, position, merged): parents hit twice or more give all their children at their first hit's place."""
    parents = hits.filter("section_id is not null").groupBy("section_id").agg(F.min("rank").alias("position"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    children = nodes.select("id", "section_id").join(F.broadcast(parents), "section_id").distinct()  # fewer parents than hits
    children = children.withColumn("_n", F.row_number().over(Window.partitionBy("section_id").orderBy("id"))).filter(F.col("_n") <= most).drop("_n")
    single = hits.join(parents, "section_id", "left_anti").select("id", "section_id", F.col("rank").alias("position"))
    return children.select("id", "section_id", "position", F.lit(True).alias("merged")).unionByName(single.withColumn("merged", F.lit(False)))


def widened(search, k: int, valid) -> DataFrame:
    """``search(k)``, and once more for twice as many where the result is not valid and not already that large."""
    hits = search(k)
    return hits if valid(hits) or hits.count() >= 2 * k else search(2 * k)


def with_fallback(search, nodes: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """``search()``; where it fails, the first ``k`` rows that match the filter, without a score."""
    try:
        return search()
    except Exception:
        kept = nodes if where is None else nodes.filter(where)
        few = kept.drop("v").dropDuplicates(["id"]).orderBy("id").limit(k)
        return few.withColumn("score", F.lit(None).cast("double")).withColumn("rank", F.row_number().over(Window.orderBy("id")).cast("bigint"))


def first_images(hits: DataFrame, images: DataFrame, most: int = 5) -> DataFrame:
    """(id, section_id, position): the first images of the hits' sections, in the order of the hits, then of the images.

    ``hits`` has (section_id, rank), a few rows; ``images`` (id, section_id, seq).
    """
    best = hits.filter("section_id is not null").groupBy("section_id").agg(F.min("rank").alias("rank"))
    mine = images.join(F.broadcast(best), "section_id").distinct().orderBy("rank", "seq", "id").limit(most)
    return mine.select("id", "section_id", F.row_number().over(Window.orderBy("rank", "seq", "id")).cast("bigint").alias("position"))
