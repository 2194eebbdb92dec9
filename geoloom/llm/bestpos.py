"""Ranked lexical search: impact lists read by the Best Position Algorithm, slice by slice of the documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoloom.llm.store import batches_of, ship_by_value, staged

ship_by_value(__name__)

#: ASCII letters and digits and all bytes of longer characters make terms; A-Z are lower-cased.
FOLD = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def bagger(vocabulary: dict[bytes, int]):
    """A task that counts all terms of whole texts, and each one of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, terms, counts = [], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                bag = Counter(map(vocabulary.get, words))
                del bag[None]
                sizes.append(len(words))
                terms.append(list(bag))
                counts.append(list(bag.values()))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip((sizes, terms, counts), kinds, strict=True))], names=["doc_id", "n", "terms", "counts"])

    return run


class Lists:
    """Impact lists of a slice of documents.

    Entries stand by term and falling impact in ``doc`` and ``impact``, list ``t`` from
    ``start[t]`` on. ``entry[first[d]:first[d + 1]]`` are the places of document ``d`` in all
    lists: a direct access.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.term, self.impact = doc[order], term[order], impact[order]
        self.start = np.searchsorted(self.term, np.arange(n_terms + 1))
        self.entry = np.argsort(self.doc, kind="stable")
        self.first = np.searchsorted(self.doc[self.entry], np.arange(docs + 1))

    def best(self, wanted: np.ndarray, k: int, floor: int, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Documents and whole scores that can be among the ``k`` best for the terms ``wanted``, given that ``floor`` is reached elsewhere.

        Every round reads each list from its best position on, the last one before which all
        places are seen. A document met there is looked up in all lists, which marks its places
        as seen and moves best positions further than the lists were read. No unseen document
        scores more than the impacts at the best positions add up to (nothing for a list seen to its
        end); reading stops when that is strictly below the k-th score, so ties are complete.
        """
        begin, end = self.start[wanted], self.start[wanted + 1]
        at = begin.copy()
        mine = np.zeros(len(self.start) - 1, bool)
        mine[wanted] = True
        seen = np.zeros(len(self.doc), bool)
        known = np.zeros(len(self.first) - 1, bool)
        docs, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        kth = floor
        while (at < end).any():
            parts = [self.doc[a : min(a + block, e)] for a, e in zip(at, end, strict=True) if a < e]
            met = np.unique(np.concatenate(parts))
            met = met[~known[met]]
            known[met] = True
            if len(met):
                counts = self.first[met + 1] - self.first[met]
                bounds = np.cumsum(counts) - counts
                entries = self.entry[np.repeat(self.first[met] - bounds, counts) + np.arange(counts.sum())]
                inside = mine[self.term[entries]]
                seen[entries[inside]] = True
                docs.append(met)
                scores.append(np.add.reduceat(np.where(inside, self.impact[entries], 0), bounds))
                whole = np.concatenate(scores)
                if len(whole) >= k:
                    kth = max(floor, int(np.partition(whole, len(whole) - k)[len(whole) - k]))
            most = 0
            for i, (a, e) in enumerate(zip(at, end, strict=True)):
                while a < e and seen[a]:
                    piece = seen[a : a + 4 * block]
                    step = int(piece.argmin()) if not piece.all() else len(piece)
                    a = min(a + step, e)
                at[i] = a
                if a < e:
                    most += int(self.impact[a - 1]) if a > begin[i] else int(self.impact[a])
            if most < kth:
                break
            block *= 2
        return np.concatenate(docs), np.concatenate(scores)


def ranker(items: list[tuple[int, int | None, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int, slice_entries: int):
    """A task that gives its ``k`` best documents of each item. Slices have a bounded number of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by item: scores and ids so far, best first
        top: dict[int, list[tuple[int, bool, int]]] = {}
        held: list[tuple] = []

        def settle() -> None:
            ids = [i for part in held for i in part[0]]
            counts = np.concatenate([part[1] for part in held])
            term = np.concatenate([part[2] for part in held])
            tf = np.concatenate([part[3] for part in held])
            size = np.concatenate([part[4] for part in held])
            held.clear()
            doc = np.repeat(np.arange(len(ids)), counts)
            m = 100 - 90 + (90 * size * n_docs) // n_terms
            lists = Lists(doc, term, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])), len(ids), len(weight))
            for number, _, wanted in items:
                best = top.setdefault(number, [])
                met, scores = lists.best(wanted, k, -best[k - 1][0] if len(best) >= k else 0)
                if len(met) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    met, scores = met[scores >= least], scores[scores >= least]
                fresh = [(-int(s), ids[d] is None, ids[d] or 0) for d, s in zip(met.tolist(), scores.tolist(), strict=True) if s > 0]
                top[number] = sorted(best + fresh)[:k]

        total = 0
        for b in batches:
            for row in range(0, b.num_rows, 1024):
                part = b.slice(row, 1024)
                terms = part.column(2)
                counts = np.diff(np.asarray(terms.offsets)) if part.num_rows else np.empty(0, int)
                got = (part.column(0).to_pylist(), counts, terms.flatten().to_numpy(zero_copy_only=False), part.column(3).flatten().to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False))
                held.append(got)
                total += len(got[2])
                if total >= slice_entries:
                    settle()
                    total = 0
        if total:
            settle()
        name = {number: item for number, item, _ in items}
        rows = [(number, name[number], None if void else i, -s) for number, best in top.items() for s, void, i in best]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "doc_id", "score"])

    return run


def blocks_of(queries: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, int | None, list[bytes]]]]:
    """``(number, id, distinct terms)`` of the items, in blocks of bounded size."""
    block, size = [], 0
    for number, row in enumerate(queries.toLocalIterator()):
        terms = sorted(set(terms_of(bytes(row[1]) if row[1] is not None else None)))
        block.append((number, row[0], terms))
        size += 64 + sum(map(len, terms))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 1 << 22, slice_entries: int = 1 << 19) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item, best first.

    One pass counts the terms of whole texts; document counts and lengths are added up by
    Spark. Documents are dealt over the tasks, each builds impact lists of a bounded slice
    after the other and reads them by best positions (:meth:`Lists.best`), with the k-th
    score of its earlier slices as a floor. The best of all tasks are ranked at the end. Items come in blocks
    of at most ``block_bytes`` (or one item), each with a pass of its own, so
    neither the driver nor a task holds more.

    Null texts have no terms. Items without terms, or whose terms stand nowhere, have no rows. Equal scores
    go by id, null ids last. Rows that repeat an id, on either side, are documents and items of their
    own. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    asked = queries.select(F.col(item_col).cast("long"), F.col(item_text).cast("string").cast("binary"))
    found = []
    for block in blocks_of(asked, block_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted({t for *_, terms in block for t in terms}))}
        with batches_of(spark, 256):
            bags = staged(own.mapInArrow(bagger(vocabulary), "doc_id long, n long, terms array<int>, counts array<long>"), "bags")
        n_docs, n_terms = bags.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        frequency = dict(bags.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        items = [(number, name, np.array([vocabulary[t] for t in terms], np.int64)) for number, name, terms in block]
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = bags.where(F.size("terms") > 0).repartition(tasks)
        found.append(staged(dealt.mapInArrow(ranker(items, weight, n_docs, n_terms, k, slice_entries), "item long, item_id long, doc_id long, score long"), "best"))
    schema = "item_id long, rank int, doc_id long, score long"
    if not found:
        return spark.createDataFrame([], schema)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
