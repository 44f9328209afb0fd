"""I-Match fingerprints over randomised lexicon subsets.

The lexicon has the terms whose inverse document frequency lies in a band; document frequencies
are counted over all documents. A text's distinct lexicon terms are sorted, and the sorted list is
hashed under each of several randomised lexicons:

* ``WIDE`` lexicons each lack a random eighth of the terms. Texts with an equal hash under one of
  them differ in the lacking terms only.
* families of narrow lexicons each keep a random share of the terms only. A family deals every term
  to one of ``1 / share`` lexicons and uses the first ``SLOTS`` of them. The share of them that agrees
  tells how far texts are alike that differ in many terms.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WordHashes, append_columns, map_arrow, mix, store, texts

#: The band: a term is in at least one of RARE documents and at most one of COMMON.
RARE, COMMON = 2000, 4
#: A lexicon of up to so many terms (8 bytes each) is sent to the tasks; a larger one is joined.
SENT_TERMS = 2_000_000
WIDE, LACKING = 8, 8                         # wide lexicons; each lacks one term in LACKING
SLOTS, SHARES = 32, (32, 128, 512, 2048)
ENOUGH = 8                                   # filled lexicons that make a family's figure count
ALIKE = 1 - 1 / LACKING                      # least likeness of texts that agree in a wide lexicon
NONE = -1                                    # in a sketch: a lexicon without terms of the text
WIDE_DIGITS, DIGITS = 12, 4


def term_hashes(text: str, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's terms, A-Z lower-cased."""
    return np.unique(words.of(text.encode().lower().split()))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term`` (hash) and ``df``. A task adds up what it has met and passes it on when that has
    grown to a few million terms, so its memory is bounded."""
    def run(batches):
        words, held, size = WordHashes(), [], 0
        for b in batches:
            for t in texts(b, text):
                held.append(term_hashes(t, words))
                size += len(held[-1])
            if size > 3_000_000:
                yield _counted(held)
                held, size = [], 0
        yield _counted(held)

    return (map_arrow(docs.select(text), run, "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    terms, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))],
                                      names=["term", "df"])


@dataclass(frozen=True)
class Lexicon:
    """The terms of the band: sorted hashes to be sent, or a stored table ``term``."""

    sent: np.ndarray | None
    table: DataFrame | None = None


def lexicon(docs: DataFrame, text: str = "text", rare: int = RARE, common: int = COMMON,
            sent_terms: int = SENT_TERMS) -> Lexicon:
    """All terms in the band; a term of one document only is never in it."""
    total = docs.count()
    low, high = max(2, math.ceil(total / rare)), max(2, total // common)
    band = store(document_frequencies(docs, text).filter(F.col("df").between(low, high)).select("term"), "lexicon")
    if band.count() > sent_terms:
        return Lexicon(None, band)
    return Lexicon(np.sort(band.toArrow().column("term").to_numpy().view(np.uint64)))


def _seeds(first: int, n: int) -> np.ndarray:
    return np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)


_WIDE_SEEDS, _NARROW_SEEDS = _seeds(0, WIDE), _seeds(100, len(SHARES))
_SHARES = np.array(SHARES, np.uint64)


def sketch(terms: np.ndarray) -> np.ndarray:
    """Hashes of the sorted distinct ``terms`` (unsigned) under each lexicon, wide ones first."""
    out = np.full(WIDE + len(SHARES) * SLOTS, NONE, np.int64)
    if not len(terms):
        return out
    kept = mix(terms + _WIDE_SEEDS[:, None]) % np.uint64(LACKING) != 0
    for k in range(WIDE):
        own = terms[kept[k]]
        if len(own):
            out[k] = xxhash.xxh3_64_intdigest(own.tobytes()) >> (64 - 4 * WIDE_DIGITS)
    slot = mix(terms + _NARROW_SEEDS[:, None]) % _SHARES[:, None]
    family, at = np.nonzero(slot < SLOTS)
    place = family * SLOTS + slot[family, at].astype(np.int64)
    order = np.argsort(place, kind="stable")                   # terms stay sorted in a lexicon
    place = place[order]
    if len(place):
        data = terms[at[order]].tobytes()
        starts = np.flatnonzero(np.diff(place, prepend=NONE))
        ends = [*(8 * starts[1:]).tolist(), len(data)]
        out[WIDE + place[starts]] = [xxhash.xxh3_64_intdigest(data[a:b]) >> (64 - 4 * DIGITS)
                                     for a, b in zip((8 * starts).tolist(), ends)]
    return out


def written(values: np.ndarray) -> str:
    """A sketch as hexadecimal digits, dashes for a lexicon without terms."""
    wide = "".join([f"{x:012x}" if x >= 0 else "-" * WIDE_DIGITS for x in values[:WIDE].tolist()])
    narrow = np.frombuffer(values[WIDE:].astype(">u2").tobytes().hex().encode(), f"S{DIGITS}").copy()
    narrow[values[WIDE:] == NONE] = b"-" * DIGITS
    return wide + narrow.tobytes().decode()


def sketch_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing lexicons among those that either text fills, in the sparsest narrow family
    with ``ENOUGH`` of them, or over all families; at least ``ALIKE`` where a wide lexicon agrees
    and a family counts; 1 for equal sketches."""
    if np.array_equal(a, b):
        return 1.0
    filled = ((a != NONE) | (b != NONE))[WIDE:].reshape(-1, SLOTS).sum(1).tolist()
    same = ((a == b) & (a != NONE))
    agree = same[WIDE:].reshape(-1, SLOTS).sum(1).tolist()
    for f, s in zip(reversed(filled), reversed(agree)):
        if f >= ENOUGH:
            return max(s / f, ALIKE if same[:WIDE].any() else 0.0)
    return sum(agree) / max(1, sum(filled))


def likeness(a: str, b: str) -> float:
    """``sketch_likeness`` of two written fingerprints."""
    def read(t: str) -> np.ndarray:
        at = WIDE * WIDE_DIGITS
        parts = ([t[k:k + WIDE_DIGITS] for k in range(0, at, WIDE_DIGITS)]
                 + [t[k:k + DIGITS] for k in range(at, len(t), DIGITS)])
        return np.array([NONE if x[0] == "-" else int(x, 16) for x in parts], np.int64)

    return sketch_likeness(read(a), read(b))


class Sketcher:
    def __init__(self, terms: np.ndarray):
        self.lexicon, self.words = terms, WordHashes()

    def of(self, text: str) -> np.ndarray:
        """A text none of whose terms is in the lexicon is described by all of them."""
        t = term_hashes(text, self.words)
        if len(t) and len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, t), len(self.lexicon) - 1)
            known = t[self.lexicon[at] == t]
            t = known if len(known) else t
        return sketch(t)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined_sketches(terms: DataFrame, lexicon_table: DataFrame) -> DataFrame:
    """``key`` and ``sketch`` of each distinct key of ``terms(key, terms)``, by joining single
    terms with the lexicon: a group is one text's terms, and no table is sent whole."""
    one = terms.dropDuplicates(["key"])
    known = (one.select("key", F.explode("terms").alias("term")).join(lexicon_table, "term")
             .groupBy("key").agg(F.collect_list("term").alias("known")))

    def run(batch: pa.RecordBatch) -> list:
        return [pa.array([sketch(np.sort(np.array(t, np.int64).view(np.uint64))) for t in
                          batch.column(batch.schema.get_field_index("use")).to_pylist()], pa.list_(pa.int64()))]

    both = one.join(known, "key", "left").select("key", F.coalesce("known", "terms").alias("use"))
    return append_columns(both, run, [T.StructField("sketch", T.ArrayType(T.LongType()))]).drop("use")


def fingerprint(df: DataFrame, terms: Lexicon, text: str = "text") -> DataFrame:
    """``df`` with ``fingerprint``, a string of lexicon hashes. Null counts as empty; equal
    texts have equal fingerprints; texts are read whole. A column of that name is replaced."""
    field = [T.StructField("fingerprint", T.StringType())]
    if terms.table is None:
        shared = df.sparkSession.sparkContext.broadcast(terms.sent)
        held: dict[str, Sketcher] = {}

        def run(batch: pa.RecordBatch) -> list:
            f = held.setdefault("f", Sketcher(shared.value))
            return [pa.array([written(f.of(t)) for t in texts(batch, text)], pa.string())]

        return append_columns(df, run, field)

    key = "__imatch_key"
    words = WordHashes()
    keyed = df.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))

    def split(batch: pa.RecordBatch) -> list:
        return [pa.array([term_hashes(t, words).view(np.int64) for t in texts(batch, text)], pa.list_(pa.int64()))]

    each = append_columns(keyed.select(F.col(key).alias("key"), F.col(text)), split,
                          [T.StructField("terms", T.ArrayType(T.LongType()))]).select("key", "terms")
    known = joined_sketches(each, terms.table).select(F.col("key").alias(key), F.col("sketch").alias("__sketch"))

    def write(batch: pa.RecordBatch) -> list:
        return [pa.array([written(np.array(v)) for v in
                          batch.column(batch.schema.get_field_index("__sketch")).to_pylist()], pa.string())]

    return append_columns(keyed.join(known, key), write, field).drop(key, "__sketch")


#: Rows of one stretch of ids, and the most stretches that the ids are cut into.
STRETCH, MAX_STRETCHES = 2000, 10_000


def with_next(docs: DataFrame, each: Callable[[], Callable[[object, str, str], tuple]],
              schema: T.StructType, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``each()(id, text, next text)`` for every document, the next one being that with the next
    smaller id and the first following the last.

    Ids are cut into stretches at quantiles. A stretch is one sorted stream; the first
    document of the one after it is sent along. Only cuts and first ids, at most
    ``MAX_STRETCHES``, are known to the driver. Documents of one id go by the hash of their
    text; those without an id come last. Texts travel compressed.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.withColumn("h", F.xxhash64("text"))
    total = given.count()
    if total == 0:
        return docs.sparkSession.createDataFrame([], schema)
    n = min(MAX_STRETCHES, -(-total // STRETCH))
    cuts = given.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def stretch(ids) -> np.ndarray:
        """Numbers of the ids' stretches, from the largest ids on; rows without an id are in the last."""
        known = np.array([i is not None for i in ids], bool)
        value = np.array([0 if i is None else i for i in ids], np.int64)
        return np.where(known, len(cuts) - np.searchsorted(cuts, value), n)

    def number(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(stretch(b.column(0).to_pylist()), pa.int32()), b.column(0), b.column(1)],
                names=["at", "id", "h"])

    numbered = map_arrow(given.select("id", "h"), number, "at int, id long, h long")
    first = numbered.groupBy("at").agg(F.max(F.struct("id", "h")).alias("x")).collect()
    order = sorted(first, key=lambda r: r["at"])
    heads = {r["at"]: (r.x["id"], r.x["h"]) for r in order}
    before = {r["at"]: order[k - 1]["at"] for k, r in enumerate(order)}     # of the first: the last

    def deal(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            rows = []
            ids, *rest = (c.to_pylist() for c in b.columns)
            for i, t, h, at in zip(ids, *rest, stretch(ids).tolist()):
                data = pack(t.encode())
                rows.append((at, 0, i, h, data))
                if heads[at] == (i, h):
                    rows.append((before[at], 1, i, h, data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (
                    pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["at", "extra", "id", "h", "data"])

    dealt = (map_arrow(given.select("id", "text", "h"), deal, "at int, extra int, id long, h long, data binary")
             .repartition("at").sortWithinPartitions("at", "extra", F.desc_nulls_last("id"), F.desc("h")))

    def run(batches):
        import zstandard

        unpack, fn = zstandard.ZstdDecompressor().decompress, each()
        waiting = None                                    # (stretch, id, text) without its next
        out: list[tuple] = []
        for b in batches:
            for at, extra, i, _, data in zip(*(c.to_pylist() for c in b.columns)):
                if extra and (waiting is None or waiting[0] != at):
                    continue                              # a copy of a first document
                t = unpack(data).decode()
                if waiting is not None:
                    out.append(fn(waiting[1], waiting[2], t))
                waiting = None if extra else (at, i, t)
            yield _rows(out, schema)
            out = []

    return map_arrow(dealt, run, schema)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    s = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(s), s)], schema=s)


def edit(text: str, other: str) -> str:
    """The last third of ``text`` replaced by the beginning of ``other``."""
    k = len(text) // 3
    return text[:len(text) - k] + other[:k]


EDITED = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()),
    ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()),
    ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])


def edited_fingerprints(docs: DataFrame, terms: Lexicon, text: str = "text", doc_id: str = "doc_id"
                        ) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the
    next document's text. Null counts as empty; repeated rows follow one another; an empty table
    gives no rows; other columns are left out."""
    if terms.table is not None:
        return _edited_by_join(docs, terms.table, text, doc_id)
    shared = docs.sparkSession.sparkContext.broadcast(terms.sent)

    def each():
        f, last = Sketcher(shared.value), [None, None]

        def one(i, t: str, other: str) -> tuple:
            own = last[1] if last[0] is t else f.of(t)
            after = f.of(other)
            last[:] = other, after
            new = edit(t, other)
            changed = f.of(new)
            return (i, len(t), _digest(new), written(own), written(changed),
                    sketch_likeness(own, changed), sketch_likeness(own, after))
        return one

    return with_next(docs, each, EDITED, text, doc_id)


_TERMS = T.ArrayType(T.LongType())
SPLIT = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("n_chars", T.LongType()), ("own", T.StringType()), ("own_terms", _TERMS),
    ("edited_sha256", T.StringType()), ("edited_terms", _TERMS), ("next", T.StringType()))])


def _edited_by_join(docs: DataFrame, lexicon_table: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``edited_fingerprints`` for a lexicon of any size. Texts go by their digest, so each
    distinct one is sketched once; the next document's text is some row's own."""
    def each():
        words = WordHashes()

        def one(i, t: str, other: str) -> tuple:
            new = edit(t, other)
            return (i, len(t), _digest(t), term_hashes(t, words).view(np.int64),
                    _digest(new), term_hashes(new, words).view(np.int64), _digest(other))
        return one

    rows = store(with_next(docs, each, SPLIT, text, doc_id), "imatch_terms")
    terms = (rows.select(F.col("own").alias("key"), F.col("own_terms").alias("terms"))
             .unionByName(rows.select(F.col("edited_sha256").alias("key"), F.col("edited_terms").alias("terms"))))
    known = store(joined_sketches(terms, lexicon_table), "imatch_sketches")
    out = rows.select("doc_id", "n_chars", "own", "edited_sha256", "next")
    for column, name in (("own", "a"), ("edited_sha256", "b"), ("next", "c")):
        out = out.join(known.select(F.col("key").alias(column), F.col("sketch").alias(name)), column)

    def compare(batch: pa.RecordBatch) -> list:
        a, b, c = ([np.array(v) for v in batch.column(batch.schema.get_field_index(k)).to_pylist()] for k in "abc")
        return [list(map(written, a)), list(map(written, b)), list(map(sketch_likeness, a, b)),
                list(map(sketch_likeness, a, c))]

    return append_columns(out, compare, EDITED.fields[3:]).select(*EDITED.names)
