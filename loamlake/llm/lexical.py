"""Ranked lexical search: the best documents of every query, by range-maximum tables over posting lists.

One pass over the texts counts the terms that queries ask for; what it leaves
per document is thin. From that come the corpus counts and, a chunk of documents at a time, posting
lists with the impact of every term in every document. Over each list stands a sparse
table that names the greatest impact of any range in two looks.

A query begins with one interval, all documents of the chunk. The sum over its
lists of the greatest impact in an interval bounds every score there. The interval with the
greatest bound is taken next and split at the document that holds the greatest of those impacts, which is
scored; an interval of few postings is scored whole. The search ends when no bound can reach the
``k`` best found, in this chunk or in earlier ones of the task, so results are exact.

Queries go in passes of bounded vocabulary: what is broadcast and what a task
holds never exceed ``terms_per_pass`` terms and one query more, however many queries there are. A term's
weight comes from counts over all documents.

Cases: a null text has no terms and is no document of the counts; a query without terms or without a
match has no row; queries with equal key and terms are one; documents with equal keys are ranked each by itself and a null key comes
last among equal scores; a text of any length is counted whole; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlake.llm.blocks import ramp, send
from loamlake.operators.running import running_sum
from loamlake.runtime import cut_lineage

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The same on UTF-8 bytes: what is no part of a term becomes a blank.
TO_TERMS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))
NO_KEY = 1 << 63  # after every key
WHOLE = 2048


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Chunk:
    """Posting lists of some documents with a sparse table over each."""

    def __init__(self, keys: list[int], sizes: list[int], counts: list[int], terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, length: int):
        """``counts`` postings of each document, one after another in ``terms`` and ``tf``; ``sizes`` are terms with repeats."""
        by_key = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys = [keys[i] for i in by_key]
        place = np.empty(len(keys), np.int64)
        place[by_key] = np.arange(len(keys))
        doc = np.repeat(place, counts)
        norm = np.repeat(np.array([8 * (10 + 90 * n * documents // length) for n in sizes], np.int64), counts)
        tf = tf.astype(np.int64)
        impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + norm))
        self.width = len(keys) + 1
        code = terms.astype(np.int64) * self.width + doc
        order = np.argsort(code, kind="stable")
        self.code, self.doc, self.impact = code[order], doc[order], impact[order]
        edges = np.searchsorted(self.code, np.arange(len(weights) + 1) * self.width)
        self.first, self.last = edges[:-1], edges[1:]
        self.log = np.frexp(np.arange(int((self.last - self.first).max(initial=0)) + 1))[1] - 1
        # best[j, p]: where the greatest impact of the 2**j postings from p on stands.
        self.best = np.empty((int(self.log[-1]) + 1, len(code)), np.int32)
        self.best[0] = np.arange(len(code))
        for j in range(1, len(self.best)):
            half, below = 1 << (j - 1), self.best[j - 1]
            here, there = below[:-half], below[half:]
            self.best[j] = below
            self.best[j, : len(code) - half] = np.where(self.impact[there] > self.impact[here], there, here)

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the greatest impact of each range; none is empty."""
        j = self.log[b - a]
        here, there = self.best[j, a], self.best[j, b - (1 << j)]
        return np.where(self.impact[there] > self.impact[here], there, here)

    def search(self, terms: np.ndarray, top: list[tuple[int, int]], k: int) -> None:
        """Put what belongs there into ``top``, a heap of (score, -key) with ``k`` entries at most."""
        waiting, number = [], count()

        def offer(score: int, doc: int) -> None:
            entry = (int(score), -self.keys[doc])
            if len(top) < k:
                heapq.heappush(top, entry)
            elif entry > top[0]:
                heapq.heapreplace(top, entry)

        def wait(base: np.ndarray, a: np.ndarray, b: np.ndarray, low: int) -> None:
            live = b > a
            if not live.any():
                return
            base, a, b = base[live], a[live], b[live]
            best = self.greatest(a, b)
            bound = int(self.impact[best].sum())
            if bound > 0 and (len(top) < k or (bound, -self.keys[low]) > top[0]):
                heapq.heappush(waiting, (-bound, low, next(number), base, a, b, best))

        terms = terms[self.last[terms] > self.first[terms]]
        if len(terms):
            wait(terms * self.width, self.first[terms], self.last[terms], 0)
        while waiting:
            bound, low, _, base, a, b, best = heapq.heappop(waiting)
            if len(top) == k and (-bound, -self.keys[low]) <= top[0]:
                if -bound < top[0][0]:
                    return
                continue
            if int((b - a).sum()) <= WHOLE:
                at = np.repeat(a, b - a) + ramp(b - a)
                docs, of = np.unique(self.doc[at], return_inverse=True)
                scores = np.zeros(len(docs), np.int64)
                np.add.at(scores, of, self.impact[at])
                enough = scores >= (top[0][0] if len(top) == k else 1)
                for score, doc in zip(scores[enough].tolist(), docs[enough].tolist()):
                    offer(score, doc)
                continue
            doc = int(self.doc[best[np.argmax(self.impact[best])]])
            middle = np.searchsorted(self.code, base + doc)
            held = (middle < b) & (self.doc[np.minimum(middle, len(self.doc) - 1)] == doc)
            score = int(self.impact[middle[held]].sum())
            if score > 0:
                offer(score, doc)
            wait(base, a, middle, low)
            wait(base, middle + held, b, min(doc + 1, len(self.keys) - 1))


def queries(items: DataFrame, item: str, terms_per_pass: int) -> DataFrame:
    """item, text_hash, terms, pass of every different row of ``items`` that has a term."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    rows = items.select(F.col(f"`{item}`").alias("item"), terms.alias("terms")).filter("size(terms) > 0")
    rows = cut_lineage(rows.withColumn("text_hash", F.sha2(F.array_join(F.array_sort("terms"), " "), 256)).dropDuplicates(["item", "text_hash"]), "queries")
    sums = running_sum(rows.withColumn("_n", F.size("terms")), F.col("_n"), ["item", "text_hash"])
    passes = sums.select(F.col("item").alias("_item"), F.col("text_hash").alias("_hash"), F.floor(F.col("before") / terms_per_pass).alias("pass"))
    joined = rows.join(passes, F.col("item").eqNullSafe(F.col("_item")) & (F.col("text_hash") == F.col("_hash")))
    return cut_lineage(joined.select("item", "text_hash", "terms", "pass"), "queries")


def rank(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item: str = "item_id", k: int = 10, terms_per_pass: int = 50_000, postings: int = 1 << 19) -> DataFrame:
    """item, rank (from 1), key, score of the ``k`` best rows of ``docs`` for each row of ``items``, both with a ``text``.

    A chunk has ``postings`` postings and those of one document more.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col("text").cast("string").alias("text"))
    asked, out = queries(items, item, terms_per_pass), None
    passes = asked.agg(F.max("pass")).first()[0]
    for at in range(0 if passes is None else passes + 1):
        # Of bounded size: at most ``terms_per_pass`` terms and those of one query.
        own = asked.filter(F.col("pass") == at).select("item", "text_hash", "terms").orderBy("item", "text_hash").collect()
        number = {t: i for i, t in enumerate(sorted({t for q in own for t in q["terms"]}))}
        found = _search(spark, texts, [np.array([number[t] for t in q["terms"]], np.int64) for q in own], number, k, postings)
        named = spark.createDataFrame([(i, q["item"]) for i, q in enumerate(own)], f"query int, item {asked.schema['item'].dataType.simpleString()}")
        found = found.join(F.broadcast(named), "query").select("item", "rank", "key", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = asked.select("item", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _search(spark, texts: DataFrame, wanted: list[np.ndarray], number: dict[str, int], k: int, postings: int) -> DataFrame:
    """query, rank, key, score: one pass over the texts, one over what it leaves."""
    sent = send(spark, {t.encode("utf-8"): i for t, i in number.items()})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        for batch in batches:
            sizes, terms, tf = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(TO_TERMS).split()
                held = [(known[w], c) for w, c in Counter(words).items() if w in known]
                sizes.append(len(words))
                terms.append([t for t, _ in held])
                tf.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["key", "size", "terms", "tf"])

    thin = cut_lineage(texts.mapInArrow(counted, "key bigint, size bigint, terms array<int>, tf array<int>"), "postings")
    documents, length = thin.agg(F.count_if(F.col("size") > 0), F.sum("size")).first()
    holding = np.zeros(len(number), np.int64)
    for term, n in thin.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one number a term
        holding[term] = n
    weights = np.array([weight(documents, n) for n in holding.tolist()], np.int64)
    job = send(spark, (wanted, weights, documents, length or 1))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, documents, length = job()
        tops: list[list[tuple[int, int]]] = [[] for _ in wanted]
        keys, sizes, counts, terms, tf, have = [], [], [], [], [], 0

        def work() -> None:
            chunk = Chunk(keys, sizes, counts, np.concatenate(terms), np.concatenate(tf), weights, documents, length)
            for query, top in zip(wanted, tops):
                chunk.search(query, top, k)
            for held in (keys, sizes, counts, terms, tf):
                held.clear()

        for batch in batches:
            for one, size, of, often in zip(*(batch.column(i) for i in range(4))):
                if not len(of):
                    continue
                keys.append(NO_KEY if one.as_py() is None else one.as_py())
                sizes.append(size.as_py())
                counts.append(len(of))
                terms.append(of.values.to_numpy())
                tf.append(often.values.to_numpy())
                have += len(of)
                if have >= postings:
                    work()
                    have = 0
        if have:
            work()
        rows = [(i, score, None if key == -NO_KEY else -key) for i, top in enumerate(tops) for score, key in top]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()))], ["query", "score", "key"])

    best = thin.mapInArrow(searched, "query int, score bigint, key bigint").withColumn("part", F.spark_partition_id() % 256)
    best_first = [F.desc("score"), F.asc_nulls_last("key")]
    for by in (["query", "part"], ["query"]):  # in two steps, so that no task meets what all tasks found
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))).filter(F.col("rank") <= k)
    return best.select("query", "rank", "key", "score")
