"""Approximate nearest neighbours over randomly rotated one-bit codes.

1. A bounded sample of the rows (``SAMPLE`` rows, fewer when vectors are long) gives the centres of
   lists. Every row goes to the list of its nearest centre.
2. A row's difference to its centre is scaled to length one, rotated by one random rotation, and
   kept as one sign bit per dimension. Beside the bits it keeps two scalars: the length of the
   difference, and the inner product of the rotated unit vector with its own sign vector.
3. A query gets the distance of its k-th nearest sample row, which no true neighbour exceeds. It goes
   to each list whose ball, the farthest row from the centre, reaches within that distance, so
   choosing lists loses nothing.
4. In a part of a list the query's rotated difference is rounded to four bits per dimension; the inner product with every code
   comes from bit counts of four bit planes. Divided by the row's own scalar it estimates the true
   inner product; the estimate's error bound gives a smallest distance, and rows that could be
   among the k nearest by it are measured exactly on the original vectors.

A list is split into parts of bounded size by a running number, so a list with most of the rows, or
many copies of one vector, makes many tasks. Only step 4 is approximate: a bound of ``ERROR``
deviations fails with a chance below one in a hundred for a single row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import arrow_type, map_arrow, store

#: Rows that the centres are fitted on, and the bytes that these may have at most.
SAMPLE, SAMPLE_BYTES = 16_384, 32_000_000
LISTS = 512                   # at most so many; a quarter of the root of the rows below that
PART_BYTES = 32_000_000       # original vectors that one task holds
STEPS = 10                    # turns of the fit
ERROR = 2.6                   # deviations of the estimate that the bound covers
PLANES = 4                    # bits of a query's dimension
CELLS = 1_000_000             # (query, row) estimates at once


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, vec`` of the rows whose vectors are present, not zero and finite throughout."""
    kind = df.schema[embedding].dataType.elementType
    vec = F.col(embedding) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(embedding).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.coalesce(fine, F.lit(False)))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation of ``dim`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` groups of near sample rows, starting from spread rows of the sample."""
    lists = max(1, min(lists, len(sample)))
    found = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(STEPS if lists > 1 else 1):
        near = nearest(sample, found)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        times = np.bincount(near, minlength=lists)
        found[times > 0] = sums[times > 0] / times[times > 0, None]
    return found


def nearest(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.argmin((found ** 2).sum(axis=1) - 2 * rows @ found.T, axis=1)


def encode(rows: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words), lengths of the differences, and the inner products
    of unit vectors with their sign vectors. A row on its centre has length 0 and product 1."""
    apart = rows - centre
    length = np.sqrt((apart ** 2).sum(axis=1))
    turned = (apart / np.where(length > 0, length, 1)[:, None]) @ turn
    own = np.where(length > 0, np.abs(turned).sum(axis=1) / np.sqrt(rows.shape[1]), 1.0)
    return pack(turned > 0), length, own


def pack(bits: np.ndarray) -> np.ndarray:
    """Boolean columns as 64-bit words, padded by zeros."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, :bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def estimate(codes: np.ndarray, own: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated inner products of unit vectors: queries (rows, rotated, unit) by codes."""
    dim = turned.shape[1]
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2 ** PLANES - 1), 1e-12)
    level = np.rint((turned - low) / step).astype(np.int64)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    total = np.zeros((len(turned), len(codes)), np.int64)
    for k in range(PLANES):
        plane = pack((level >> k & 1).astype(bool))
        for word in range(codes.shape[1]):
            total += np.bitwise_count(plane[:, word, None] & codes[None, :, word]).astype(np.int64) << k
    # sum over set bits of the query's rounded values, minus that over the bits not set
    signed = 2 * (step * total + low * ones[None, :]) - (step * level.sum(axis=1, keepdims=True) + low * dim)
    return signed / np.sqrt(dim) / own[None, :]


def error_bound(own: np.ndarray, dim: int) -> np.ndarray:
    """How far an estimate may be off, as a multiple of the deviation of a random rotation."""
    return ERROR * np.sqrt(np.maximum(1 - own ** 2, 0)) / own / np.sqrt(max(dim - 1, 1))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scan(held: dict, asked: list[tuple], k: int, centre: np.ndarray, turn: np.ndarray) -> list[tuple]:
    """(query, key, vec_id, distance) of the rows of one part that may be among the k nearest of a
    query; at most the k nearest of the part for each."""
    ids, vecs, codes, length, own, void = (held[c] for c in ("id", "vec", "code", "length", "own", "void"))
    off = error_bound(own, vecs.shape[1])
    out = []
    many = max(1, CELLS // len(ids))
    for at in range(0, len(asked), many):
        some = asked[at:at + many]
        q = np.array([x[3] for x in some], np.float64)
        apart = q - centre
        far = np.sqrt((apart ** 2).sum(axis=1))
        turned = (apart / np.where(far > 0, far, 1)[:, None]) @ turn
        base = (far ** 2)[:, None] + (length ** 2)[None, :]
        scale = 2 * far[:, None] * length[None, :]
        guess = base - scale * np.clip(estimate(codes, own, turned), -1, 1)
        least = guess - scale * off[None, :]
        for row, (query, key, most, _) in enumerate(some):
            other = void | (ids != query)
            first = np.flatnonzero(other)
            if not len(first):
                continue
            if len(first) > k:
                first = first[np.argpartition(guess[row, first], k - 1)[:k]]
                limit = min(most, np.sort(np.sqrt(((vecs[first] - q[row]) ** 2).sum(axis=1)))[k - 1])
                first = np.flatnonzero(other & (least[row] <= limit * limit * (1 + 1e-9)))
            exact = np.sqrt(((vecs[first].astype(np.float64) - q[row]) ** 2).sum(axis=1))
            order = np.lexsort((ids[first], ~void[first], exact))[:k]
            out += [(query, key, None if void[first[x]] else int(ids[first[x]]), float(exact[x]))
                    for x in order.tolist() if exact[x] <= most]
    return out


class Index:
    """Codes of all rows, stored, with what a search needs to read them."""

    def __init__(self, df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding"):
        spark = df.sparkSession
        rows = usable(df, vec_id, embedding)
        sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        self.dim, n = (sizes["dim"], sizes["count"]) if sizes else (1, 0)
        rows = rows.filter(F.size("vec") == self.dim)
        take = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * self.dim)))
        picked = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(take).collect()
        self.sample = np.array([r.vec for r in picked], np.float64).reshape(-1, self.dim)
        self.sample_ids = [r.vec_id for r in picked]
        spread = self.sample if len(picked) else np.zeros((1, self.dim))
        self.centres = centres(spread, min(LISTS, max(1, round(n ** 0.5 / 4))))
        self.turn = rotation(self.dim)
        self.rows = store(self._coded(rows), "codes")
        lists = self.rows.groupBy("list").agg(F.count("*").alias("n"), F.max("length").alias("radius"))
        per = max(1, PART_BYTES // (8 * self.dim))
        self.lists = spark.createDataFrame(                 # at most LISTS rows
            [(r["list"], r.radius, -(-r.n // per)) for r in lists.collect()], "list int, radius double, parts long")

    def _coded(self, rows: DataFrame) -> DataFrame:
        found, turn, dim, kind = self.centres, self.turn, self.dim, arrow_type(rows.schema["vec"].dataType)
        schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(
            "list int, slot long, code binary, length double, own double").fields])

        def run(batches):
            slot = 0
            for b in batches:
                vecs = _matrix(b.column(1), dim).astype(np.float64)
                near = nearest(vecs, found)
                code, length, own = encode(vecs, found[near], turn)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1).cast(kind), pa.array(near, pa.int32()),
                     pa.array(np.arange(slot, slot + len(vecs)), pa.int64()),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(own)],
                    names=[f.name for f in schema])
                slot += len(vecs)

        return map_arrow(rows, run, schema)

    def search(self, asked, k: int = 10) -> DataFrame:
        """``query_id, rank, vec_id, score`` of the rows for which the condition ``asked`` on ``vec_id``
        holds: their ``k`` nearest rows with other ids by Euclidean distance, nearest first, ties to the smaller id.

        A row takes part if its vector is present, finite and not zero and has the commonest length
        (the larger one at a tie). Rows of one id are never each other's neighbours; equal rows are
        one query, different vectors of one id are separate queries. A row without an id is found, as
        null, but is no query. Fewer other rows than ``k`` give all of them. Other columns are not
        read; an empty table gives an empty result.
        """
        found, turn, dim = self.centres, self.turn, self.dim
        sample, names, radius = self.sample, self.sample_ids, np.full(len(self.centres), -1.0)
        for r in self.lists.collect():
            radius[r["list"]] = r.radius
        mine = {}
        for place, name in enumerate(names):
            mine.setdefault(name, []).append(place)
        queries = (self.rows.filter(asked).filter("vec_id IS NOT NULL").select("vec_id", "vec")
                   .withColumn("key", F.xxhash64("vec")).dropDuplicates(["vec_id", "key"]))
        vec = arrow_type(queries.schema["vec"].dataType)

        def send(batches):
            for b in batches:
                ids, vecs = b.column(0).to_pylist(), _matrix(b.column(1), dim).astype(np.float64)
                near = np.sqrt(np.maximum((vecs ** 2).sum(axis=1)[:, None] + (sample ** 2).sum(axis=1) - 2 * vecs @ sample.T, 0))
                for row, name in enumerate(ids):
                    near[row, mine.get(name, [])] = np.inf
                most = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(ids), np.inf)
                most = most * (1 + 1e-6) + 1e-6
                far = np.sqrt(((vecs[:, None, :] - found[None, :, :]) ** 2).sum(axis=2))
                row, to = np.nonzero((radius >= 0) & (far - radius <= most[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), b.column(0).take(row), b.column(1).cast(vec).take(row),
                     b.column(2).take(row), pa.array(most[row])], names=["list", "vec_id", "vec", "key", "most"])

        sent = map_arrow(queries, send, T.StructType([
            T.StructField("list", T.IntegerType()), *queries.schema.fields, T.StructField("most", T.DoubleType())]))
        parts = F.broadcast(self.lists.select("list", "parts"))
        none = {"code": F.lit(None).cast("binary"), "length": F.lit(None).cast("double"), "own": F.lit(None).cast("double")}
        order = ["list", "part", "role", "vec_id", "vec", "key", "most", "code", "length", "own"]
        left = (self.rows.join(parts, "list").withColumns({
            "part": F.pmod(F.col("slot"), "parts"), "role": F.lit(0), "key": F.lit(0).cast("long"),
            "most": F.lit(None).cast("double")}).select(order))
        right = (sent.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                 .withColumns({"role": F.lit(1), **none}).select(order))
        met = left.unionByName(right).repartition("list", "part").sortWithinPartitions("list", "part", "role")

        def scan(batches):
            at, held, rows, waiting = None, None, [], []

            def close():
                nonlocal held, rows
                if held is None and rows:
                    held = {name: np.concatenate([r[name] for r in rows]) for name in rows[0]}
                    rows = []
                done = _scan(held, waiting, k, found[at[0]], turn) if held and waiting else []
                waiting.clear()
                return _found(done)

            for b in batches:
                where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
                start = 0
                while start < len(where):
                    group = where[start]
                    stop = start
                    while stop < len(where) and where[stop] == group:
                        stop += 1
                    piece = b.slice(start, stop - start)
                    if group[:2] != at:
                        if at is not None:
                            yield close()
                        at, held, rows = group[:2], None, []
                    vecs = _matrix(piece.column(4), dim)
                    if group[2] == 0:
                        ids = piece.column(3)
                        rows.append({"id": ids.fill_null(0).to_numpy(), "void": ids.is_null().to_numpy(zero_copy_only=False), "vec": vecs,
                                     "code": np.frombuffer(b"".join(piece.column(7).to_pylist()), np.uint64).reshape(len(vecs), -1),
                                     "length": piece.column(8).to_numpy(), "own": piece.column(9).to_numpy()})
                    else:
                        waiting += zip(piece.column(3).to_pylist(), piece.column(5).to_pylist(), piece.column(6).to_pylist(), vecs)
                        if len(waiting) >= 512:
                            yield close()
                    start = stop
            if at is not None:
                yield close()

        near = map_arrow(met, scan, "query_id long, key long, vec_id long, score double")
        best = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
        return (near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([], [], [], [])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "key", "vec_id", "score"])
