"""Ranked lexical search of many items at once, with shared parts of the items worked out once.

1. Items are dealt to blocks by hash. In a task per block, term sets that several items share are
   mined: the pair of columns that occurs together in most items becomes a column of its own,
   and so on with the new columns, until no pair is shared. The result is a graph in which each
   shared set is the sum of two earlier ones, and every item a short list of sets and terms.
2. One pass over the documents counts the terms that any item of the turn has, and stores the counts.
   Document frequencies and the average length come from the stored rows.
3. A second pass holds, for some documents at a time, one accumulator per term and shared set: a
   set's accumulator is filled once and read by all sets and items above it. A task keeps the best
   documents of each item seen so far; the tasks' lists are merged in two steps.

Scores are whole numbers, so the order of the sums does not matter. A turn takes ``TURN`` blocks;
more items make more turns over the documents, not larger tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, store, texts

BLOCK_TERMS = 16_384          # distinct terms of items, added up over a block, on average
TURN = 8                      # blocks that one pass over the documents answers
MINED = 1024                  # columns and shared sets of a block that mining looks at; more only share less
CELLS = 4_000_000             # accumulators at once
SALTS = 32                    # first merge of the tasks' lists

#: ASCII letters in lower case, digits and everything beyond ASCII; the rest separates.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, terms``: each item's distinct terms, sorted. Equal items are one."""
    given = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sorted(t.decode() for t in set(terms(x))) for x in texts(b, "text")],
                                       pa.list_(pa.string()))], names=["item_id", "terms"])

    return map_arrow(given, run, "item_id long, terms array<string>").distinct()


def mine(has: np.ndarray, most: int = MINED) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Shared pairs of the Boolean columns ``has`` (item by column): the columns with those of the
    pairs added and their parts taken out, and the two columns of each pair."""
    n = has.shape[1]
    cols = np.zeros((len(has), n + most), np.float32)
    cols[:, :n] = has
    both = np.zeros((n + most, n + most), np.float32)
    both[:n, :n] = cols[:, :n].T @ cols[:, :n]
    np.fill_diagonal(both, 0)
    pairs = []
    while len(pairs) < most:
        k = n + len(pairs)
        a, b = divmod(int(both[:k, :k].argmax()), k) if k else (0, 0)
        if not k or both[a, b] < 2:
            break
        new = cols[:, a] * cols[:, b]
        cols[:, k] = new
        cols[:, a] -= new
        cols[:, b] -= new
        pairs.append((a, b))
        for c in (a, b, k):
            both[c, :k + 1] = both[:k + 1, c] = cols[:, c] @ cols[:, :k + 1]
            both[c, c] = 0
    return cols[:, :n + len(pairs)] > 0, pairs


def graph(sets: list[list[str]]) -> dict:
    """The block's terms, the two nodes of each shared set, and per item its nodes. Nodes
    0 to n-1 are the terms, the following ones the shared sets in order."""
    times = Counter(t for s in sets for t in s)
    vocabulary = sorted(times, key=lambda t: (-times[t], t))
    place = {t: k for k, t in enumerate(vocabulary)}
    shared = min(MINED, sum(1 for t in vocabulary if times[t] > 1))     # the first columns
    has = np.zeros((len(sets), shared), bool)
    for row, s in enumerate(sets):
        at = [place[t] for t in s]
        has[row, [k for k in at if k < shared]] = True
    cols, pairs = mine(has)
    node = lambda k: k if k < shared else len(vocabulary) + k - shared
    own = [[node(int(k)) for k in np.flatnonzero(cols[row])] + sorted(place[t] for t in s if place[t] >= shared)
           for row, s in enumerate(sets)]
    return {"terms": vocabulary, "left": [node(a) for a, _ in pairs], "right": [node(b) for _, b in pairs], "nodes": own}


def graphs(items: DataFrame, blocks: int) -> DataFrame:
    """One row per block: its graph and the ids of its items."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["item_id"].to_pylist(), table["terms"].to_pylist()), key=lambda r: (r[0] is not None, r))
        g = graph([r[1] for r in rows])
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()),
                         "items": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                         "terms": pa.array([g["terms"]], pa.list_(pa.string())),
                         "left": pa.array([g["left"]], pa.list_(pa.int32())),
                         "right": pa.array([g["right"]], pa.list_(pa.int32())),
                         "nodes": pa.array([g["nodes"]], pa.list_(pa.list_(pa.int32())))})

    return dealt.groupBy("block").applyInArrow(
        run, "block int, items array<long>, terms array<string>, left array<int>, right array<int>, nodes array<array<int>>")


def count_terms(docs: DataFrame, vocabulary: list[str], text: str, doc_id: str) -> DataFrame:
    """``doc_id, n, ids, times``: all terms of a document counted, those of the vocabulary one by one."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    place = {t.encode(): k for k, t in enumerate(vocabulary)}

    def run(batches):
        for b in batches:
            n, ids, times = [], [], []
            for t in texts(b, "text"):
                words = terms(t)
                found = Counter(filter(place.__contains__, words))
                n.append(len(words))
                ids.append([place[w] for w in found])
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "n", "ids", "times"])

    return map_arrow(given, run, "doc_id long, n long, ids array<int>, times array<int>")


class Best:
    """The ``k`` best documents of each item: higher score first, then smaller id, unknown ids first."""

    def __init__(self, items: int, k: int):
        self.k, self.kept, self.rows, self.floor = k, [], 0, np.ones(items, np.int64)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floor[first:first + len(scores), None])
        self.kept.append((item + first, scores[item, doc], docs[doc]))
        self.rows += len(item)
        if self.rows > 4 * self.k * len(self.floor):
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, doc = (np.concatenate(c) for c in zip(*self.kept)) if self.kept else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        last = item[nth == self.k - 1]
        self.floor[last] = score[nth == self.k - 1]
        stay = nth < self.k
        self.kept = [(item[stay], score[stay], doc[stay])]
        self.rows = int(stay.sum())
        return self.kept[0]


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 of
    each item, equal scores by ascending id (rows without id first).

    Null and empty texts have no terms: as a document they are not counted, as an item they find
    nothing. Equal items count once; different texts of one item id are items of their own, and
    each has its ranks. Each row of ``docs`` is a document, also with a repeated id. Columns other
    than those named are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = store(item_terms(items, item_id, item_text).filter(F.size("terms") > 0), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    planned = store(graphs(asked, blocks), "graphs")
    schema = "item_id long, nth int, rank int, doc_id long, score long"
    turns = [_turn(docs, planned.filter(F.col("block").between(at, at + TURN - 1)).orderBy("block").collect(), k, text, doc_id)
             for at in range(0, blocks, TURN)]                   # a turn has at most TURN blocks
    turns = [t for t in turns if t is not None]
    found = reduce(DataFrame.unionByName, turns) if turns else spark.createDataFrame([], schema)
    return found.select("item_id", "rank", "doc_id", "score")


def _turn(docs: DataFrame, rows: list, k: int, text: str, doc_id: str) -> DataFrame | None:
    if not rows:
        return None
    vocabulary = sorted({t for r in rows for t in r.terms})
    place = {t: n for n, t in enumerate(vocabulary)}
    plans = [(np.array([place[t] for t in r.terms]), r.left, r.right, r.nodes) for r in rows]
    names = [i for r in rows for i in r["items"]]
    counted = store(count_terms(docs, vocabulary, text, doc_id), "counts")
    many = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    # As many numbers as the turn's vocabulary has terms, which TURN and BLOCK_TERMS bound.
    held = dict(counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect())
    n_docs, n_terms = many.N, many.L
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    leaves = max(len(p[0]) + len(p[1]) for p in plans)

    def run(batches):
        best = Best(len(names), k)
        for b in batches:
            for at in range(0, b.num_rows, max(1, CELLS // leaves)):
                _score(b.slice(at, max(1, CELLS // leaves)), best)
        item, score, doc = best.trim()
        task = TaskContext.get().partitionId() % SALTS
        for at in range(0, len(item), 10_000):
            s = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in item[s].tolist()], pa.int64()), pa.array(item[s], pa.int32()),
                 pa.array(np.full(len(item[s]), task), pa.int32()),
                 pa.array(doc[s], pa.int64(), mask=doc[s] == _NO_ID), pa.array(score[s], pa.int64())],
                names=["item_id", "nth", "salt", "doc_id", "score"])

    def _score(b: pa.RecordBatch, best: Best) -> None:
        n = b.column(1).to_numpy()
        docs_at = b.column(0).fill_null(_NO_ID).to_numpy()
        lists = b.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        at, ids = np.repeat(np.arange(len(n)), sizes), lists.flatten().to_numpy()
        times = b.column(3).flatten().to_numpy().astype(np.int64)
        norm = 50 + (50 * n * n_docs) // max(n_terms, 1)
        part = weight[ids] * ((1_000_000_000 * times) // (1000 * times + 20 * norm[at]))
        first = 0
        for leaf, left, right, nodes in plans:
            where = np.full(len(weight), -1)
            where[leaf] = np.arange(len(leaf))
            mine = where[ids]
            sums = np.zeros((len(leaf) + len(left), len(n)), np.int64)
            sums[mine[mine >= 0], at[mine >= 0]] = part[mine >= 0]
            for node, (x, y) in enumerate(zip(left, right), len(leaf)):
                np.add(sums[x], sums[y], out=sums[node])
            for start in range(0, len(nodes), 64):
                scores = np.stack([sums[own].sum(axis=0) for own in nodes[start:start + 64]])
                best.add(first + start, scores, docs_at)
            first += len(nodes)

    near = map_arrow(counted.filter("n > 0"), run, "item_id long, nth int, salt int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    some = Window.partitionBy("item_id", "nth", "salt").orderBy(*order)
    every = Window.partitionBy("item_id", "nth").orderBy(*order)
    return (near.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k)
            .select("item_id", "nth", "rank", "doc_id", "score"))


_NO_ID = -(1 << 63)
