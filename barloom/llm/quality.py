"""Quality rules: a linear-chain conditional random field labels each line of a text as
content or boilerplate, and the share of words in content lines decides whether it is kept.

The field has two states, binary line features and transition weights. It is fitted by
gradient ascent on the exact log-likelihood over a bounded sample of labelled documents.
Lines have no labels of their own, so these are found in turns: at first each line takes its
document's label; then a model of single lines gives each line the label that its own features
speak for, wherever they contradict the document's label clearly; the field is fitted on those
sequences, in which labels change from line to line. Viterbi decoding labels the lines of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
MIN_CONTENT_SHARE = 0.5
#: The fit uses at most so many labelled documents, half of each label, and lines of each.
FIT_DOCS, FIT_LINES = 1600, 40
#: A line takes the other label where its own features are so many nats for it, after each round.
CONTRADICTS, ROUNDS = 1.0, 3

_SYMBOL_BYTES, _UPPER, _DIGITS = SYMBOLS.encode(), bytes(range(65, 91)), b"0123456789"
_PUNCT = b"!?.,;:"
#: Upper bounds of the buckets of each line measure; a value above all is in the last one.
BUCKETS = {
    "words": (1, 2, 4, 8, 16, 32, 64, 128),
    "bytes_per_word": (2, 4, 6, 8, 12, 20),
    "symbol_share": (0, 0.01, 0.03, 0.08, 0.2),
    "upper_share": (0.005, 0.05, 0.15, 0.4, 0.7),
    "digit_share": (0, 0.02, 0.1, 0.3),
    "punct_share": (0, 0.01, 0.03, 0.06, 0.12),
    "distinct_share": (0.3, 0.5, 0.7, 0.9, 0.999),
    "lone_symbols": (0, 0.1, 0.3),
}
_FLAGS = ("ends_sentence", "seen_before", "doubled_mark")
N_FEATURES = sum(len(b) + 1 for b in BUCKETS.values()) + 2 * len(_FLAGS)
PER_LINE = len(BUCKETS) + len(_FLAGS)


@dataclass(frozen=True)
class Field:
    """Weights of a fitted field; state 1 is content."""

    emit: np.ndarray        # (N_FEATURES, 2)
    move: np.ndarray        # (2, 2) from, to
    start: np.ndarray       # (2,)

    @classmethod
    def all_content(cls) -> "Field":
        emit = np.zeros((N_FEATURES, 2))
        emit[:, 1] = 1.0
        return cls(emit, np.zeros((2, 2)), np.zeros(2))

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most probable state of each line; content wins a tie."""
        score = self.emit[features].sum(axis=1)
        (a, b), (c, d) = self.move.tolist()
        s0, s1 = (self.start + score[0]).tolist()
        back: list[tuple[int, int]] = []
        for e0, e1 in score[1:].tolist():
            back.append((int(s1 + c >= s0 + a), int(s1 + d >= s0 + b)))
            s0, s1 = max(s0 + a, s1 + c) + e0, max(s0 + b, s1 + d) + e1
        path = [int(s1 >= s0)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return np.array(path[::-1], np.int8)


def line_features(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    """Feature numbers of each line, one per measure and flag."""
    seen: set[bytes] = set()
    raw, flags = [], []
    for line, ws in zip(lines, words):
        size, n = len(line), len(ws)
        marks = size - len(line.translate(None, _SYMBOL_BYTES))
        raw.append((n, sum(map(len, ws)) / n, marks / size,
                    (size - len(line.translate(None, _UPPER))) / size,
                    (size - len(line.translate(None, _DIGITS))) / size,
                    (size - len(line.translate(None, _PUNCT))) / size,
                    len(set(ws)) / n,
                    sum(len(w) == 1 and w in _SYMBOL_BYTES for w in ws) / n if marks else 0))
        flags.append((ws[-1][-1] in b".!?", line in seen,
                      b"!!" in line or b"**" in line or b"##" in line))
        seen.add(line)
    values, out, base = np.array(raw, float).reshape(-1, len(BUCKETS)), [], 0
    for k, bounds in enumerate(BUCKETS.values()):
        out.append(base + np.searchsorted(bounds, values[:, k]))
        base += len(bounds) + 1
    on = np.array(flags, int).reshape(-1, len(_FLAGS))
    for k in range(len(_FLAGS)):
        out.append(base + on[:, k])
        base += 2
    return np.stack(out, axis=1)


def repeat_words(words: list[bytes], n: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``n`` words that occur twice or more. Exact: windows are
    ranked by doubling (``n`` is a power of two), not hashed."""
    m = len(words)
    if m <= n:
        return 0
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, m)
    if len(numbers) > m - n:                  # too few repeated words for a repeated window
        return 0
    size, kinds = 1, len(numbers)
    while size < n:
        pair = rank[:-size] * kinds + rank[size:]
        distinct, rank = np.unique(pair, return_inverse=True)
        kinds, size = len(distinct), size * 2
        if kinds == len(rank):
            return 0
    repeated = np.bincount(rank, minlength=kinds)[rank] > 1
    edge = np.zeros(m + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:m] > 0).sum())


def _worded(text: str) -> tuple[list[bytes], list[list[bytes]]]:
    lines, words = [], []
    for line in text.encode().split(b"\n"):
        ws = line.split()
        if ws:
            lines.append(line)
            words.append(ws)
    return lines, words


def judge(text: str, field: Field) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share, kept) of one text."""
    lines, by_line = _worded(text)
    words = [w for ws in by_line for w in ws]
    n, repeats = len(words), repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    share = 0.0
    if n:
        content = field.viterbi(line_features(lines, by_line))
        share = float(np.dot(content, [len(ws) for ws in by_line])) / n
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeats, failed, share,
            not failed and share >= MIN_CONTENT_SHARE)


FIELDS = [T.StructField(c, T.LongType()) for c in
          ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()),
    T.StructField("kept", T.BooleanType())]


def apply_rules(df: DataFrame, field: Field, col: str = "text") -> DataFrame:
    """``df`` with the base measures, ``content_share`` and ``kept``.

    A null or empty text has no words and fails. Texts are read whole. Rows are
    independent: repeated rows get equal results, an empty table an empty result. Columns of
    ``df`` under a new column's name are replaced, others pass through.
    """
    def run(batch: pa.RecordBatch) -> list:
        rows = [judge(t, field) for t in texts(batch, col)]
        return list(zip(*rows)) if rows else [[]] * len(FIELDS)

    return append_columns(df, run, FIELDS)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = FIT_DOCS, max_lines: int = FIT_LINES
        ) -> Field:
    """Fit on at most ``max_docs`` labelled documents, half of each label, taken by the hash
    of their id, and the first ``max_lines`` lines of each. Null labels are left out; a
    document labelled twice counts as its lower label. Without both labels every line is content.
    """
    clean = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    order = F.xxhash64(F.lit("fit"), "doc_id")
    picked = None
    for label in (0, 1):
        part = clean.filter(F.col("quality") == label).orderBy(order, "doc_id").limit(max_docs // 2)
        picked = part if picked is None else picked.unionByName(part)
    ids = {r.doc_id: r.quality for r in picked.collect()}        # at most max_docs rows
    if len(set(ids.values())) < 2:
        return Field.all_content()
    sample = docs.filter(F.col("doc_id").isin(list(ids))).select("doc_id", "text")

    def lines(batch: pa.RecordBatch) -> list:
        out = []
        for t in texts(batch, "text"):
            ls, ws = _worded(t)
            out.append(line_features(ls[:max_lines], ws[:max_lines]).ravel().astype(np.int32))
        return [pa.array(out, pa.list_(pa.int32()))]

    rows = (append_columns(sample, lines, [T.StructField("f", T.ArrayType(T.IntegerType()))])
            .filter(F.size("f") > 0)
            .groupBy("doc_id").agg(F.min("f").alias("f")).collect())     # one row per id
    rows.sort(key=lambda r: r.doc_id)
    x = [np.array(r.f).reshape(-1, PER_LINE) for r in rows]
    labels = np.array([ids[r.doc_id] for r in rows])
    if len(set(labels.tolist())) < 2:
        return Field.all_content()
    return _train(x, line_labels(x, labels), labels)


def line_odds(x: list[np.ndarray], gold: list[np.ndarray], smooth: float = 1.0) -> list[np.ndarray]:
    """How many nats a line's features speak for content: the mean over its features, times the square
    root of their number since they depend on each other, of the log ratio of smoothed shares."""
    flat, state = np.concatenate(x), np.concatenate(gold)
    n = [np.bincount(flat[state == s].ravel(), minlength=N_FEATURES) + smooth for s in (0, 1)]
    ratio = np.log(n[1] / ((state == 1).sum() + 2 * smooth)) - np.log(n[0] / ((state == 0).sum() + 2 * smooth))
    return [ratio[f].sum(axis=1) / np.sqrt(PER_LINE) for f in x]


def line_labels(x: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A label for each line, from those of the documents: ``rounds`` times, single lines are
    counted under the present labels, and a line that clearly contradicts its document's gets the other one."""
    gold = [np.full(len(f), q) for f, q in zip(x, labels)]
    for _ in range(rounds):
        new = [np.where(odds > CONTRADICTS, 1, np.where(odds < -CONTRADICTS, 0, q))
               for odds, q in zip(line_odds(x, gold), labels)]
        if len({int(v) for g in new for v in g}) < 2 or all(map(np.array_equal, new, gold)):
            break
        gold = new
    return gold


def _train(x: list[np.ndarray], gold_lines: list[np.ndarray], labels: np.ndarray, steps: int = 120,
           rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Gradient ascent with adaptive steps on the penalized log-likelihood of the line labels.
    Sequences are padded to one length and run through forward and backward passes together; the
    documents of either label weigh alike."""
    n = len(x)
    length = np.array([len(f) for f in x])
    t_max = int(length.max())
    feats = np.full((n, t_max, PER_LINE), N_FEATURES)                   # the last row is padding
    gold = np.zeros((n, t_max), int)
    for k, f in enumerate(x):
        feats[k, :len(f)] = f
        gold[k, :len(f)] = gold_lines[k]
    real = np.arange(t_max)[None, :] < length[:, None]
    each = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    weight = np.where(real, (each / length)[:, None], 0.0)              # a document weighs alike
    w = np.zeros((N_FEATURES + 1) * 2 + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)

    for step in range(1, steps + 1):
        emit = w[:-6].reshape(-1, 2)
        move, start = w[-6:-2].reshape(2, 2), w[-2:]
        score = emit[feats].sum(axis=2)
        fwd, bwd = np.zeros((n, t_max, 2)), np.zeros((n, t_max, 2))
        fwd[:, 0] = start + score[:, 0]
        for t in range(1, t_max):
            fwd[:, t] = np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]) + score[:, t]
        for t in range(t_max - 2, -1, -1):
            ahead = score[:, t + 1] + bwd[:, t + 1]
            back = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            bwd[:, t] = np.where(real[:, t + 1, None], back, 0.0)
        last = fwd[np.arange(n), length - 1]
        log_z = np.logaddexp(last[:, 0], last[:, 1])
        p = np.exp(fwd + bwd - log_z[:, None, None])
        miss = (np.stack([gold == 0, gold == 1], 2) - p) * weight[:, :, None]
        g = np.zeros_like(w)
        for s in (0, 1):
            g[:-6].reshape(-1, 2)[:, s] = np.bincount(
                feats.ravel(), np.repeat(miss[:, :, s].ravel(), PER_LINE), N_FEATURES + 1)
        if t_max > 1:
            pair = (fwd[:, :-1, :, None] + move + (score + bwd)[:, 1:, None, :]
                    - log_z[:, None, None, None])
            both = real[:, 1:, None, None] * weight[:, 1:, None, None]
            want = np.eye(4)[2 * gold[:, :-1] + gold[:, 1:]].reshape(n, t_max - 1, 2, 2)
            g[-6:-2] = ((want - np.exp(np.minimum(pair, 0))) * both).sum((0, 1)).ravel()
        g[-2:] = miss[:, 0].sum(0)
        g -= decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    emit = w[:-6].reshape(-1, 2)[:-1].copy()
    return Field(emit, w[-6:-2].reshape(2, 2).copy(), w[-2:].copy())
