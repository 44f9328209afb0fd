"""N-gram Jaccard join: documents whose shingle sets reach a similarity, and their components.

1. Equal sets become one class. Everything below works on classes.
2. Tiles. Classes meet by size band and segment: a band of sizes has ``n`` segments, more than
   two linked sets of that band can differ in, a hash deals shingles to segments, so two linked
   sets agree in at least one whole segment. A tile is a (band, segment, content) that two
   or more classes share; tiles with the same members count once.
3. Links. Members meet a pivot of their tile. Hashed bitmaps bound the overlap from above by bit
   counts, and the pairs left are intersected exactly as sorted arrays. A few rounds with other
   pivots join most members of a tile; then every pair of a tile still in different components is
   compared inside tasks: by bitmap, which names the members that may have a link, and these exactly, which
   gives a spanning forest. So no link between components is missed and no pair is written out.
4. Numbers of links, where asked for. Two linked classes are in one component, so a component's
   classes are dealt to blocks by hash, two blocks meet in a task, and all their pairs are
   intersected exactly. A task returns a number for each class, never the pairs.

Shingles are 64-bit hashes; within one set or pair a clash has a chance below 1e-12.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import WordHashes, map_arrow, mix, release, shingle_hashes, store, texts, unstore

SHINGLE, PERCENT = 4, 85
FAMILIES = 4                # hash families a set may fall back to when segments are empty
PIVOT_ROUNDS = 2
PIVOT_SHARE = 2000          # members that one task compares with one pivot
FEW_PAIRS = 400_000         # pairs (of 24 bytes) that may be broadcast
BLOCK = 512                 # members of a tile's block
LINK_BLOCK, SET_COST = 1_000_000, 2_000   # shingles of a component's block, where a set costs some more
COLUMNS = 4096              # shingles whose owners are multiplied at once


class JoinWords(WordHashes):
    """A smaller cache: in a pipeline the workers also hold what earlier stages left."""

    LIMIT = 100_000


def shingle_set(text: str, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of the text with A-Z lower-cased."""
    return np.unique(shingle_hashes(words.of(text.encode().lower().split()), n))


def most_apart(a: int, b: int, percent: int) -> int:
    """Linked sets with ``a`` and ``b`` elements differ in at most so many: an intersection of
    i links if 100 i >= percent (a + b - i), and a + b - 2 i elements are in one set only."""
    return (100 - percent) * (a + b) // (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(segments, most differing ones) of each band in which a set of ``size`` can meet a
    partner. A pair meets in the band of its larger set."""
    out: dict[int, int] = {}
    top = 100 * size // percent

    def segments(b: int) -> int:
        k = most_apart(b, b, percent)
        return 1 << (k + k // 64).bit_length()

    b = size
    while True:
        n = segments(b)
        low, high = b, top                    # the largest partner in this band, by bisection
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if segments(mid) <= n else (low, mid - 1)
        out[n] = most_apart(size, low, percent)
        if low >= top:
            return list(out.items())
        b = low + 1


def segment_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the set's segments in all its bands. Agreeing in empty segments only is no
    evidence: a set with so many of them that a partner could agree in those alone adds the
    keys of the next hash family, and after the last one those of its empty segments."""
    keys = []
    for n, apart in bands(len(shingles), percent):
        if n == 1:
            continue                          # links equal sets only, which are one class
        for family in range(FAMILIES):
            h = mix(shingles + np.uint64(0x9E3779B97F4A7C15 * (family + 1) & 0xFFFFFFFFFFFFFFFF))
            seg = (h >> np.uint64(40)).astype(np.int64) & (n - 1)
            total = np.zeros(n, np.uint64)
            np.add.at(total, seg, mix(h))
            held = np.bincount(seg, minlength=n) > 0
            needed = (n - int(held.sum())) >= n - apart
            at = np.arange(n) if needed and family == FAMILIES - 1 else np.flatnonzero(held)
            keys.append(mix(mix(total[at]) + (at + n * (family + 1)).astype(np.uint64)))
            if not needed:
                break
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle in a map of four to eight times as many bits, in 64-bit words."""
    width = max(64, 1 << (4 * len(shingles) - 1).bit_length())
    at = shingles & np.uint64(width - 1)
    out = np.zeros(width // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64),
                     np.uint64(1) << (at & np.uint64(63)))
    return out


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def overlap_bound(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """No more than this many shared elements: each bit that only one map has stands for an
    element which the other set lacks."""
    words = min(len(a), len(b))
    a, b = _fold(a, words), _fold(b, words)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def linked(shared: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * shared >= percent * (n_a + n_b - shared)


def document_sets(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text: str = "text",
                  doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, two hashes of the set (``cls`` names the class) and
    the keys of its segments."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()),
                        ("check", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        words = JoinWords()
        for b in batches:
            sets = [shingle_set(t, n, words) for t in texts(b, "text")]
            ids = b.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_signed(mix(s).sum()) for s in sets], pa.int64()),
                pa.array([_signed(mix(~s).sum()) for s in sets], pa.int64()),
                pa.array([segment_keys(s, percent).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], schema=schema)

    return map_arrow(given, run, "doc_id long, n_shingles long, cls long, check long, keys array<long>")


def _signed(x: np.uint64) -> int:
    x = int(x)
    return x - (1 << 64) if x >> 63 else x


def tiles(classes: DataFrame) -> DataFrame:
    """(``tile``, ``cls``) of the tiles with two or more classes. Tiles with the same members
    are one, named by a hash of the members."""
    per_key = Window.partitionBy("key")
    rows = (classes.select("cls", F.explode("keys").alias("key"))
            .withColumns({"low": F.min("cls").over(per_key), "high": F.max("cls").over(per_key),
                          "tile": F.bit_xor(F.xxhash64("cls")).over(per_key)}))
    return rows.filter("low < high").select("tile", "cls").distinct()


def class_sets(docs: DataFrame, wanted: DataFrame, n: int, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """``cls, size, bits, shingles`` of the wanted classes, from one text of each.
    ``wanted`` has ``cls`` and the ``rep`` id; rows of that id with another text are left out."""
    no_id = F.lit(-(1 << 63))
    given = docs.select(F.coalesce(F.col(doc_id), no_id).alias("id"), F.col(text).alias("text"))
    found = (given.join(wanted.select("cls", F.coalesce("rep", no_id).alias("id")), "id")
             .withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "cls", "h"]).select("cls", "text"))
    schema = pa.schema([("cls", pa.int64()), ("size", pa.int64()), ("bits", pa.binary()),
                        ("shingles", pa.binary())])

    def run(batches):
        words = JoinWords()
        for b in batches:
            rows = []
            for cls, t in zip(b.column(0).to_pylist(), texts(b, "text")):
                s = shingle_set(t, n, words)
                if _signed(mix(s).sum()) == cls:
                    rows.append((cls, len(s), bitmap(s).tobytes(), s.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    return map_arrow(found, run, "cls long, size long, bits binary, shingles binary")


def _meet(pairs: DataFrame, sets: DataFrame, column: str, agree) -> DataFrame:
    """The ``pairs(pivot, cls)`` whose sizes and ``column`` agree. A pivot and up to about
    ``PIVOT_SHARE`` members stream through a task, the pivot first; a pivot with more members is
    sent to several tasks."""
    sets = sets.select("cls", "size", F.col(column).alias("data"))
    # The sets are wide and most are in no pair. Pairs that are few by count go to them, which
    # spares a shuffle of all sets; more of them meet the sets by shuffle.
    near = F.broadcast if pairs.count() <= FEW_PAIRS else lambda df: df
    count = Window.partitionBy("pivot")
    dealt = (pairs.withColumn("parts", F.ceil(F.count("*").over(count) / PIVOT_SHARE))
             .withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts"))).drop("parts"))
    members = sets.join(near(dealt), "cls").select("pivot", "part", F.lit(1).alias("role"), "cls", "size", "data")
    pivots = (sets.withColumnRenamed("cls", "pivot").join(near(dealt.select("pivot", "part").distinct()), "pivot")
              .select("pivot", "part", F.lit(0).alias("role"), F.col("pivot").alias("cls"), "size", "data"))
    rows = (members.unionByName(pivots).repartition("pivot", "part")
            .sortWithinPartitions("pivot", "part", "role"))

    def run(batches):
        at = n = held = None
        for b in batches:
            out = []
            for pivot, _, role, cls, size, raw in zip(*(c.to_pylist() for c in b.columns)):
                mine = np.frombuffer(raw, np.uint64)
                if role == 0:
                    at, n, held = pivot, size, mine
                elif at == pivot and agree(held, n, mine, size):
                    out.append((pivot, cls))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], names=["pivot", "cls"])

    return map_arrow(rows, run, "pivot long, cls long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs(pivot, cls)`` as ``a, b``: bitmaps first, which
    are small and rule most pairs out, then the sorted arrays of the pairs left."""
    def may(a, n_a, b, n_b):
        return 100 * min(n_a, n_b) >= percent * max(n_a, n_b) and linked(
            overlap_bound(a, n_a, b, n_b), n_a, n_b, percent)

    def do(a, n_a, b, n_b):
        return linked(overlap(a, b), n_a, n_b, percent)

    left = store(_meet(pairs, sets, "bits", may), "bounded")
    return _meet(left, sets, "shingles", do).select(F.col("pivot").alias("a"), F.col("cls").alias("b"))


def candidates(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``group, cls``: the classes that have a partner of another label in some tile which the bitmaps do not rule out,
    in groups that hold both sides of every such pair.

    A tile's members are ordered by size and cut into blocks; two blocks meet in a task, which
    compares their maps word by word.
    """
    order = Window.partitionBy("tile").orderBy("size", "cls")
    # Places are worked out on narrow rows; the maps join last and are shuffled once.
    places = (members.select("tile", "cls", "label").join(sets.select("cls", "size"), "cls")
              .withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
              .withColumn("blocks", F.max("block").over(Window.partitionBy("tile")))
              .withColumn("other", F.explode(F.sequence(F.lit(0), "blocks")))
              .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
              .select("tile", "i", "j", "block", "cls", "label", "size"))
    rows = (places.join(sets.select("cls", "bits"), "cls")
            .select("tile", "i", "j", "block", "cls", "label", "size", "bits")
            .repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "block", "size", "cls"))

    def run(batches):
        at, held = None, []
        for b in batches:
            out = []
            for tile, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (tile, i, j) != at:
                    if held:
                        out += _compare(at, held, percent)
                    at, held = (tile, i, j), []
                held.append(row)
            yield _columns(out, "a", "b")
        yield _columns(_compare(at, held, percent) if held else [], "a", "b")

    # An edge that many tiles share is one, and a class is in one group.
    edges = store(map_arrow(rows, run, "a long, b long").distinct(), "near")
    groups = connect(edges).select(F.col("label").alias("group"), F.col("node").alias("cls"))
    unstore(edges)
    return groups


def _columns(out: list[tuple[int, int]], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], names=names)


def _stars(parts: dict[int, set[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Edges that join the names of each part, given as (block, name): all names of a block go to the least of them, and
    the least of one block to that of the other. Other tasks that meet one of the blocks make the same edges for
    it, and overlapping tiles many of them, so few are left of all once equal ones count once."""
    out = set()
    for part in parts.values():
        least: dict[int, int] = {}
        for block, name in part:
            least[block] = min(name, least.get(block, name))
        out |= {(least[block], name) for block, name in part} | {(min(least.values()), max(least.values()))}
    return sorted((a, b) for a, b in out if a != b)


def _compare(at: tuple, rows: list[list], percent: int) -> list[tuple[int, int]]:
    """Edges that join all classes which are joined by pairs that may link and have different labels, in a
    block or in blocks i and j. Rows are (block, cls, label, size, bits) by block and size."""
    _, i, j = at
    block, cls, label, size, bits = zip(*rows)
    maps = [np.frombuffer(b, np.uint64) for b in bits]
    words = min(map(len, maps))
    maps = np.stack([_fold(m, words) for m in maps])
    size, names = np.array(size), np.array(label)
    second = 0 if i == j else block.index(j) if j in block else len(rows)
    root = np.arange(len(rows))
    for a in range(len(rows) if i == j else second):
        first = a + 1 if i == j else second
        stop = first + int(np.searchsorted(size[first:], 100 * size[a] // percent, side="right"))
        near = np.arange(first, stop)
        near = near[(names[near] != names[a]) & (100 * np.minimum(size[near], size[a]) >= percent * np.maximum(size[near], size[a]))]
        if not len(near):
            continue
        other = maps[near]
        most = np.minimum(size[a] - np.bitwise_count(maps[a] & ~other).sum(axis=1, dtype=np.int64),
                          size[near] - np.bitwise_count(other & ~maps[a]).sum(axis=1, dtype=np.int64))
        partners = near[100 * most >= percent * (size[a] + size[near] - most)]
        for r in np.unique(root[partners]):
            root[root == r] = root[a]
    parts: dict[int, set[tuple[int, int]]] = {}
    for r, *name in zip(root.tolist(), block, cls):
        parts.setdefault(r, set()).add(tuple(name))
    return _stars(parts)


def forests(found: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of labels that join all labels which any links between ``found(group, cls)`` of one group join; a class
    without label is its own. Two blocks of a group are intersected exactly in a task, and fewer pairs come back
    than the task has members."""
    known = (found.join(labels, "cls", "left")
             .select("group", "cls", F.coalesce("label", "cls").alias("mine")))

    def unite(at, rows):
        first, second, _, linked_at = _linked_blocks(at, rows, percent)
        if first is None:
            return []
        parent: dict[int, int] = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(*(k.tolist() for k in np.nonzero(linked_at))):
            p, q = top(first[x][2]), top(second[y][2])
            if p != q:
                parent[max(p, q)] = min(p, q)
        parts: dict[int, set[tuple[int, int]]] = {}
        for block, _, label, _ in first + second:
            if label in parent:
                parts.setdefault(top(label), set()).add((block, label))
        return _stars(parts)

    return _in_blocks(known, sets, unite, "a", "b").distinct()


def connect(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes of ``edges(a, b)``; the label is the least node of the component. In each turn every node
    moves to that one of itself and its neighbours which comes first by hash, and the edges move with their
    ends. Loops and double edges go, so that the next turn has a share of the nodes and edges only, and all
    turns together read the edges a few times. ``edges`` should be stored."""
    def drawn(c):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))

    left, turns = edges.select("a", "b"), []
    while True:
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = store(both.groupBy("a").agg(F.min(drawn("b")).alias("near"))
                      .select(F.col("a").alias("node"), F.least("near", drawn("a"))["to"].alias("label")), "turn")
        turns.append(moved)
        rest = store(left.join(moved.toDF("a", "la"), "a").join(moved.toDF("b", "lb"), "b").filter("la <> lb")
                     .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "rest")
        if len(turns) > 1:
            unstore(left)
        left = rest
        if left.isEmpty():
            break
    unstore(left)
    # The last turns are the smallest; a node that has no edge left has come to its end.
    ends = turns[-1]
    for moved in turns[-2::-1]:
        ends = (moved.withColumnRenamed("label", "via").join(ends.withColumnRenamed("node", "via"), "via", "left")
                .select("node", F.coalesce("label", "via").alias("label")))
    least = ends.groupBy("label").agg(F.min("node").alias("least"))
    labels = store(ends.join(least, "label").select("node", F.col("least").alias("label")), "labels")
    unstore(*turns)
    return labels


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``cls, label`` after ``links(a, b)`` between classes have joined their labels."""
    if labels is None:
        return connect(links).select(F.col("node").alias("cls"), "label")
    one = labels.select(F.col("cls").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("cls").alias("b"), F.col("label").alias("lb"))
    edges = store(links.join(one, "a", "left").join(two, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct(), "edges")
    joined = connect(edges)
    old = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
    fresh = joined.join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_anti")
    return (old.select("cls", F.coalesce("new", "label").alias("label"))
            .unionByName(fresh.select(F.col("node").alias("cls"), "label")))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``, or of ``left``
    with each other: products of owner matrices over the shingles that several sets have."""
    both = left + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    kept = times[column] > 1
    owner, column = owner[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right if right is not None else left)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        owned = np.zeros((len(both), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        owned[owner[at], column[at] - low] = 1
        one, two = (owned, owned) if right is None else (owned[:len(left)], owned[len(left):])
        out += (one @ two.T).astype(np.int64)
    return out


def _linked_blocks(at: tuple, rows: list[list], percent: int):
    """Classes of block i, of block j, their intersections, and which of them link (only once, and no
    class with itself, where i is j); rows are (block, cls, value, shingles)."""
    _, i, j = at
    held = list({r[1]: r for r in rows}.values())          # a class may have come with two texts
    first, second = [r for r in held if r[0] == i], [r for r in held if r[0] == j]
    if not first or not second:
        return None, None, None, None
    sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in (first, second)]
    sizes = [np.array([len(s) for s in side]) for side in sets]
    shared = shared_counts(sets[0], None if i == j else sets[1])
    found = 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)
    if i == j:
        np.fill_diagonal(found, False)
    return first, second, shared, found


def _count_links(at: tuple, rows: list[list], percent: int) -> list[tuple[int, int]]:
    """``cls`` and the rows of the classes it links with, over the pairs of a block with itself
    or of block i with block j; a row's value is its number of rows."""
    first, second, _, found = _linked_blocks(at, rows, percent)
    if first is None:
        return []
    times = [np.array([r[2] for r in side], np.int64) for side in (first, second)]
    out = list(zip([r[1] for r in first], (found @ times[1]).tolist()))
    if at[1] != at[2]:
        out += zip([r[1] for r in second], (times[0] @ found).tolist())
    return [x for x in out if x[1]]


def _in_blocks(known: DataFrame, sets: DataFrame, work, *names: str) -> DataFrame:
    """What ``work(at, rows)`` returns for each pair of blocks of each group, two numbers a row. ``known`` has a
    group, ``cls`` and one value; a group of more than ``LINK_BLOCK`` shingles is dealt to blocks by hash."""
    group, _, value = known.columns
    sized = store(known.join(sets.select("cls", "size").distinct(), "cls"), "known")
    # A group of more than one block holds a million shingles, so these are few.
    large = (sized.groupBy(group).agg(F.sum(F.col("size") + SET_COST).alias("cost"))
             .filter(F.col("cost") > LINK_BLOCK)
             .select(group, F.ceil(F.col("cost") / LINK_BLOCK).cast("int").alias("blocks")))
    dealt = (sized.drop("size").join(F.broadcast(large), group, "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))
    near = F.broadcast if sized.count() <= FEW_PAIRS else lambda df: df
    rows = (sets.select("cls", "shingles").join(near(dealt), "cls")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    "block", "cls", value, "shingles")
            .repartition(group, "i", "j").sortWithinPartitions(group, "i", "j"))

    def run(batches):
        at, held = None, []
        for b in batches:
            out = []
            for name, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (name, i, j) != at:
                    if held:
                        out += work(at, held)
                    at, held = (name, i, j), []
                held.append(row)
            yield _columns(out, *names)
        yield _columns(work(at, held) if held else [], *names)

    made = store(map_arrow(rows, run, f"{names[0]} long, {names[1]} long"), "made")
    unstore(sized)
    return made


def link_counts(labels: DataFrame, sets: DataFrame, times: DataFrame, percent: int) -> DataFrame:
    """``cls, n``: rows of the other classes that a class links with. ``labels(cls, label)``
    names the components, ``times(cls, times)`` the rows of each class."""
    known = labels.join(times, "cls").select("label", "cls", "times")
    made = _in_blocks(known, sets, lambda at, rows: _count_links(at, rows, percent), "cls", "n")
    found = store(made.groupBy("cls").agg(F.sum("n").alias("n")), "links")
    unstore(made)
    return found


def _pivots(members: DataFrame, turn: int, done: list[DataFrame]) -> DataFrame:
    """``cls, pivot``: each class with the pivot of other label that it meets in most of its tiles. A tile's pivot
    is drawn by hash in each turn; pairs of earlier turns are left out."""
    heads = members.groupBy("tile").agg(
        F.min_by(F.struct(F.col("cls").alias("pivot"), F.col("label").alias("to")),
                 F.xxhash64(F.lit(turn), "cls")).alias("p")).select("tile", "p.*")
    pairs = (members.join(heads, "tile").filter("label <> to")
             .groupBy("cls", "pivot").agg(F.count("*").alias("times")))
    for tried in done:
        pairs = pairs.join(tried, ["cls", "pivot"], "left_anti")
        pairs = pairs.join(tried.select(F.col("pivot").alias("cls"), F.col("cls").alias("pivot")), ["cls", "pivot"], "left_anti")
    return pairs.groupBy("cls").agg(F.max_by("pivot", F.struct("times", "pivot")).alias("pivot")).select("cls", "pivot")


def jaccard_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text: str = "text",
                       doc_id: str = "doc_id", links: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, cls, component_id``, with ``links`` also
    ``n_links``, the number of other rows that the row links with.

    Two rows link when the Jaccard similarity of their shingle sets is at least ``percent``
    hundredths; ``component_id`` is the smallest id that links reach. A text with fewer than
    ``n`` words is one shingle. A null or wordless text has no shingles, links with nothing and
    is its own component. Null ids never name a component that has another id. Repeated rows,
    also of one id with different texts, each count. Columns other than the two named are not
    read, so their names cannot clash; an empty table gives an empty result.
    """
    sets = store(document_sets(docs, n, percent, text, doc_id), "sets")
    classes = (sets.filter("n_shingles > 0").groupBy("cls", "check", "n_shingles")
               .agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys")))
    met = store(tiles(classes.filter(F.size("keys") > 0)), "tiles")
    with_keys, sets = sets, store(sets.drop("keys"), "members")
    unstore(with_keys)
    release(docs.sparkSession)
    reps = sets.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    vectors = store(class_sets(docs, reps.join(met.select("cls").distinct(), "cls", "left_semi"), n,
                               text, doc_id), "vectors")
    release(docs.sparkSession)
    labels, done = None, []
    for turn in range(PIVOT_ROUNDS + 1):
        members = met
        if labels is not None:
            now = labels.select("cls", "label")
            members = (met.join(now, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
            tile = Window.partitionBy("tile")
            members = (members.withColumns({"low": F.min("label").over(tile), "high": F.max("label").over(tile)})
                       .filter("low < high").drop("low", "high"))
        else:
            members = members.withColumn("label", F.col("cls"))
        members = store(members, "members")
        if members.isEmpty():
            unstore(members)
            break
        if turn < PIVOT_ROUNDS:
            pairs = store(_pivots(members, turn, done), "pairs")
            links = store(verify(pairs, vectors, percent), "links")
            done.append(pairs)
        else:
            found = store(candidates(members, vectors, percent), "candidates")
            known = labels.select("cls", "label") if labels is not None else members.select("cls", "label").limit(0)
            links = store(forests(found, known, vectors, percent), "links")
            unstore(found)
        labels_new = store(_relabel(labels, links), "components")
        if labels is not None:
            unstore(labels)
        labels = labels_new
        unstore(members, links)
        release(docs.sparkSession)
    every = sets.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    if labels is None:
        named = every.select("cls", F.col("rep").alias("component"))
    else:
        labelled = every.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        least = labelled.groupBy("label").agg(F.min("rep").alias("component"))
        named = labelled.join(least, "label").select("cls", "component")
    unstore(met, *done)
    out = ["doc_id", "n_shingles", "cls",
           F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")]
    if links:
        release(docs.sparkSession)
        times = sets.filter("n_shingles > 0").groupBy("cls").agg(F.count("*").alias("times"))
        equal = times.withColumnRenamed("times", "n")
        if labels is not None:
            more = link_counts(labels.select("cls", "label"), vectors, times, percent)
            equal = equal.join(more.withColumnRenamed("n", "more"), "cls", "left").select(
                "cls", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        named = named.join(equal.withColumn("n_links", F.col("n") - 1).drop("n"), "cls", "left")
        out.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    unstore(vectors)
    return sets.select("doc_id", "n_shingles", "cls").join(named, "cls").select(*out)


def representatives(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id. Rows with that
    same id and the same text count as one; wordless rows all stay; a row with a null id stays
    if no id is known in its component."""
    found = jaccard_components(docs, n, percent)
    stay = found.filter(F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = stay.select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    again = Window.partitionBy("doc_id", "__text").orderBy("__text")
    return (kept.withColumn("__text", F.xxhash64("text"))
            .withColumn("__nth", F.row_number().over(again)).filter("__nth = 1")
            .drop("__text", "__nth"))
