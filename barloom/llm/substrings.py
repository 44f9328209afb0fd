"""Substring dedup with compressed FM-indexes.

Whether a window of words occurs again is asked of FM-indexes, one per shard: backward search
over a wavelet tree of the Burrows-Wheeler transform gives the longest match that ends at a
word, and stretches of at least a window are reported.

What keeps this linear is which text a shard gets. A window's anchor is the least hash of its
``GRAM``-word runs, so equal windows have equal anchors. Windows in a row with the same anchor
are a segment. Anchors met once cannot repeat and fall away after a count; the distinct
segments of the others go to the shard of their anchor, where they are indexed and searched.
Copies of one segment are counted before that, and an anchor with more segments than a shard
holds is split into blocks that are searched against each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, append_columns, map_arrow, mix, release, shingle_hashes, store, texts, unstore

WINDOW, GRAM = 35, 8
SHARD = 10_000                                # segments in one index, some half a million words


class WaveletTree:
    """Ranks of symbols in a sequence. One bit per symbol and level, the highest bit first;
    each level's symbols are stably sorted by the bit above. Bits are packed in words, with
    a running count per word."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        s = sequence
        for level in range(self.depth - 1, -1, -1):
            bit = (s >> level & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence leads for ``symbol``; the walk of 0 taken off
        is the number of that symbol before ``at``."""
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at


class FmIndex:
    """Backward search in ``text`` (symbols from 0) for patterns of up to 64 symbols."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = _suffix_order(text, symbols)
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        every = np.arange(symbols)
        self.base = self.first[:-1] - self.tree.walk(every, np.zeros(symbols, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with ``symbol`` and go on like those in [low, high)."""
        base = self.base[symbol]
        return base + self.tree.walk(symbol, low), base + self.tree.walk(symbol, high)


def _suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes by their first 64 symbols, ranks doubling; the text is taken as a circle."""
    rank, kinds, size = text.astype(np.int64), symbols, 1
    while size < 64:
        pair = rank * kinds + np.roll(rank, -size)
        distinct, rank = np.unique(pair, return_inverse=True)
        kinds, size = len(distinct), size * 2
        if kinds == len(text):
            break
    return np.argsort(rank, kind="stable")


def repeated_windows(segments: list[list[bytes]], indexed: np.ndarray, asked: np.ndarray, window: int
                     ) -> np.ndarray:
    """For each asked segment a mask of its windows that occur in an indexed segment other than
    itself (bit k: the window that begins at word k).

    All asked segments advance together, each with one test at a time: extend to the left from
    some end while enough occurrences are left. The first test takes the whole segment. Later
    ones begin at the end of the first open window: where such a test stops at a word, every
    window from there to the window's start is closed, as it would contain the failed match.
    """
    numbers: dict[bytes, int] = {}
    rows = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in s), np.int64, len(s))
            for s in segments]
    symbols = len(numbers) + 1
    gap = np.zeros(1, np.int64)
    index = FmIndex(np.concatenate([x for r, i in zip(rows, indexed) if i for x in (r, gap)] or [gap]), symbols)
    length = np.array([len(r) for r in rows])
    text = np.concatenate(rows)
    base = np.cumsum(length) - length
    need = np.where(indexed, 2, 1)

    one = np.int64(1)
    hit = np.zeros(len(rows), np.int64)
    open_ = np.where(asked, (one << np.maximum(length - window + 1, 0)) - 1, 0)
    seg = np.flatnonzero(open_)
    start, end = np.zeros(len(seg), np.int64), length[seg]
    whole = np.ones(len(seg), bool)
    low, high, at = np.zeros(len(seg), np.int64), np.zeros(len(seg), np.int64), end.copy()
    while len(seg):
        at = at - 1
        symbol = text[base[seg] + at]
        fresh = at == end - 1
        lo, hi = index.extend(symbol, low, high)
        low = np.where(fresh, index.first[symbol], lo)
        high = np.where(fresh, index.first[symbol + 1], hi)
        failed = high - low < need[seg]
        over = failed | (at == start)
        if not over.any():
            continue
        s, f = seg[over], np.where(failed, at, at - 1)[over]          # [f + 1, end) occurs again
        a, e, w = start[over], end[over], whole[over]
        found = np.maximum(e - window - f, 0)                           # windows in it
        hit[s] |= ((one << found) - 1) << (f + 1)
        # A whole test closes what it found and the last window; one from a window's end also
        # all windows up to where it stopped.
        closed = hit[s] | np.where(w, one << (e - window), ((one << np.maximum(f - a + 1, 0)) - 1) << a)
        open_[s] &= ~closed
        left = open_[s]
        again = left > 0
        lowest = np.zeros(len(s), np.int64)
        lowest[again] = np.bitwise_count((left[again] & -left[again]) - 1).astype(np.int64)
        keep = np.ones(len(seg), bool)
        places = np.flatnonzero(over)
        keep[places[~again]] = False
        start[places], end[places] = lowest, lowest + window
        at[places], whole[places] = end[places], False
        low[places] = high[places] = 0
        seg, start, end, whole = seg[keep], start[keep], end[keep], whole[keep]
        low, high, at = low[keep], high[keep], at[keep]
    return hit[asked]


def segments_of(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first word, number of words) of a text's segments."""
    if len(words) < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = shingle_hashes(words, gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    least = np.concatenate([views[k:k + 4096].argmin(axis=1) for k in range(0, len(views), 4096)])
    place = least + np.arange(len(views))
    begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    size = np.diff(np.concatenate([begins, [len(views)]])) + window - 1
    return grams[place[begins]], _contents(words, begins, size), begins, size


#: An odd base and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _contents(words: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order-sensitive hashes of runs of words: polynomials in ``BASE``, taken as differences of
    running sums, which the inverse's powers move to the run's beginning."""
    m = len(words)
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate([one, np.full(m, BASE, np.uint64)]))
    back = np.cumprod(np.concatenate([one, np.full(m, _INVERSE, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * power[:m])])
    return mix(mix((total[begins + size] - total[begins]) * back[begins]) + size.astype(np.uint64))


def text_segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The segments of ``docs(doc_id, row, text)``; ``row`` is a hash of id and text."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "row", "anchor", "seg", "start", "size")])

    def run(batches):
        words = WordHashes()
        for b in batches:
            ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            held, owner = [], []
            for k, t in enumerate(texts(b, "text")):
                held.append(segments_of(words.of(t.encode().split()), window, gram))
                owner.append(np.full(len(held[-1][0]), k))
            owner = pa.array(np.concatenate(owner or [np.zeros(0, int)]))
            cols = [np.concatenate([h[c] for h in held] or [np.zeros(0, np.int64)]).view(np.int64) for c in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(owner), pa.array(rows, pa.int64()).take(owner),
                 *map(pa.array, cols)], schema=schema)

    return map_arrow(docs, run, "doc_id long, row long, anchor long, seg long, start long, size long")


def segment_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(row, start, size, ...)`` with the segment's ``words``, joined by one space."""
    fields = [c for c in wanted.columns if c != "row"]
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    found = docs.select("row", "text").dropDuplicates(["row"]).join(lists, "row")

    def run(batch: pa.RecordBatch) -> list:
        out = []
        for t, parts in zip(texts(batch, "text"), batch.column(batch.schema.get_field_index("parts")).to_pylist()):
            ws = t.encode().split()
            out.append([b" ".join(ws[p["start"]:p["start"] + p["size"]]).decode() for p in parts])
        return [pa.array(out, pa.list_(pa.string()))]

    from pyspark.sql.types import ArrayType, StringType, StructField
    return (append_columns(found, run, [StructField("words", ArrayType(StringType()))])
            .select(F.explode(F.arrays_zip("parts", "words")).alias("x")).select("x.parts.*", "x.words"))


def search_shards(segments: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``anchor, seg, mask`` for ``segments(anchor, seg, copies, kinds, words)``; ``kinds`` is
    how many segments the anchor has."""
    total = segments.count()
    shards = max(1, -(-total // shard))
    blocks = F.ceil(F.col("kinds") / shard).cast("int")
    own = F.pmod(F.xxhash64("seg"), F.col("blocks")).cast("int")
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    places = F.when(F.col("blocks") == 1, F.array(pair(F.lit(0), F.lit(0)))).otherwise(F.array_distinct(F.flatten(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                    lambda k: F.array(pair(F.col("block"), k), pair(k, F.col("block")))))))
    dealt = (segments.withColumn("blocks", blocks).withColumn("block", own)
             .withColumn("at", F.explode(places))
             .withColumn("shard", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("string"))
                         .otherwise(F.concat_ws("/", F.col("anchor").cast("string"), "at.i", "at.j")))
             .select("shard", "anchor", "seg", "words",
                     (F.col("at.i") == F.col("block")).alias("indexed"),
                     ((F.col("at.j") == F.col("block")) & (F.col("copies") == 1)).alias("asked")))

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy()
        rows = [w.encode().split() for w in table.column("words").to_pylist()]
        masks = repeated_windows(rows, table.column("indexed").to_numpy(), asked, window)
        keep = pa.array(asked)
        return pa.table({"anchor": table.column("anchor").filter(keep), "seg": table.column("seg").filter(keep),
                         "mask": pa.array(masks, pa.int64())})

    return (dealt.groupBy("shard").applyInArrow(run, "anchor long, seg long, mask long")
            .filter("mask <> 0").groupBy("anchor", "seg").agg(F.bit_or("mask").alias("mask")))


def removed_words(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of ``n`` words a repeated window covers; a span has ``start`` and ``mask``."""
    begins = np.zeros(n + 1, bool)
    for s in spans:
        mask, k = s["mask"], s["start"]
        while mask:
            begins[k] = begins[k] or mask & 1
            mask, k = mask >> 1, k + 1
    edge = np.zeros(n + window + 1, np.int64)
    at = np.flatnonzero(begins)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, text: str = "text",
          doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of windows of
    ``window`` words that also begin anywhere else, the same text included.

    ``kept`` has the other words, joined by one space. A null text has no words, one shorter than
    a window keeps all. Windows are judged on the input. Null and repeated ids are
    harmless: rows are told apart by id and text, and a repeated row repeats all its windows.
    Only the two columns named are read; an empty table gives an empty result.
    """
    if window - gram + 1 > 60:
        raise ValueError("a segment has more windows than a mask has bits")
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.withColumn("row", F.xxhash64("doc_id", "text")).select("doc_id", "row", "text")
    every = store(text_segments(given, window, gram), "segments")
    often = every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    met = store(every.join(often, "anchor", "left_semi"), "repeated")
    unstore(every)
    release(spark)
    kinds = store(met.groupBy("anchor", "seg").agg(
        F.count("*").alias("copies"), F.min(F.struct("row", "start", "size")).alias("at"))
        .select("anchor", "seg", "copies", "at.*"), "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    words = store(segment_words(given, kinds.join(several, "anchor")), "words")
    release(spark)
    whole = kinds.filter("copies > 1").select(
        "anchor", "seg", F.expr(f"shiftleft(1L, CAST(size - {window} + 1 AS INT)) - 1").alias("mask"))
    found = store(whole.unionByName(search_shards(words, window, shard)), "windows")
    spans = (met.join(found, ["anchor", "seg"]).groupBy("doc_id", "row")
             .agg(F.collect_set(F.struct("start", "mask")).alias("spans")))
    spans = store(spans.withColumnRenamed("doc_id", "id"), "spans")
    unstore(words, kinds, met, found)
    release(spark)
    rows = (given.join(spans, given.doc_id.eqNullSafe(spans.id) & (given.row == spans.row), "left")
            .select(given.doc_id, "text", "spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(batches):
        for b in batches:
            out = []
            for i, t, s in zip(b.column(0).to_pylist(), texts(b, "text"), b.column(2).to_pylist()):
                ws = t.encode().split()
                gone = removed_words(len(ws), s or [], window)
                out.append((i, len(ws), int(gone.sum()),
                            b" ".join([w for w, g in zip(ws, gone.tolist()) if not g]).decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

    return map_arrow(rows, cut, "doc_id long, n_words long, n_removed long, kept string")
