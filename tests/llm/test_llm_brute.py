"""Corpus queries without a SQL twin against plain Python on whole small tables."""

import base64
import collections
import hashlib
import re
from html import unescape

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from barloom.llm import imatch, ngram_join, quality, substrings
from barloom.llm.common import WordHashes
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def components(docs, n, percent):
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op1(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_jaccard_join"](spark, SF).collect()}
    assert got == components(docs, 4, 85)


def test_op1_near_the_threshold(spark):
    """Groups of texts that differ by more and more words, so that pairs lie on both sides."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(25):
        base = [f"w{g}_{k}" for k in range(int(rng.integers(4, 160)))]
        for v in range(14):
            t = list(base)
            for k in rng.integers(0, len(t), size=int(rng.integers(0, 1 + len(t) // 12))):
                t[k] = f"x{rng.integers(50)}"
            rows.append((len(rows), " ".join(t)))
    pdf = pd.DataFrame(rows, columns=["doc_id", "text"])
    df = spark.createDataFrame(pdf)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == components(pdf, 4, 85)


def test_op1_links(spark, monkeypatch):
    """Numbers of links of rows, also between different texts of one component, of equal texts,
    of a repeated id, and of a component that is cut into blocks."""
    rng = np.random.default_rng(6)
    texts = [None, " ", "one two", "one two", "One TWO"]
    for g in range(6):
        base = [f"w{g}_{k}" for k in range(int(rng.integers(40, 90)))]
        for v in range(25):
            t = list(base)
            for k in rng.integers(0, len(t), size=v % 4):
                t[k] = f"x{rng.integers(50)}"
            texts.append(" ".join(t))
    rows = [(k, t) for k, t in enumerate(texts)] + [(2, "ONE two"), (7, texts[40].upper()), (None, texts[9])]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    want = [(i, len(a), sum(x != y and bool(a) and 100 * len(a & b) >= 85 * len(a | b) for y, b in enumerate(sets)))
            for x, ((i, _), a) in enumerate(zip(rows, sets))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1_000_000, 15_000):
        monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
        got = ngram_join.jaccard_components(df, links=True).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == collections.Counter(want)
    assert max(w[2] for w in want) > 5


def least_of_component(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(parent)}


def test_op1_connect_reads_edges_a_few_times(spark, monkeypatch):
    """Paths, a star, random edges, loops and double edges: the least node of each component, while all turns
    together write fewer rows than a few times the nodes and edges."""
    rng = np.random.default_rng(8)
    edges = [(k, k + 1) for k in range(1000, 1600)] + [(5000, int(k)) for k in rng.permutation(1000) + 4900 if k != 5000]
    edges += [(int(a), int(b)) for a, b in rng.integers(10_000, 11_000, (500, 2))] + [(7, 7), (9, 8), (8, 9), (9, 8), (-3, -9)]
    written, store = [], ngram_join.store

    def counted(df, name):
        written.append((out := store(df, name)).count())
        return out

    monkeypatch.setattr(ngram_join, "store", counted)
    got = {r.node: r.label for r in ngram_join.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == (want := least_of_component(edges))
    assert sum(written) < 3 * (len(want) + len(edges)), written
    written.clear()
    assert ngram_join.connect(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op1_edges_of_a_large_group_follow_its_members():
    """The blocks of one group of near copies, each met with each other: few edges more than members."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    blocks = []
    for k in range(10):
        sets = [np.unique(np.concatenate([base[4:], rng.integers(0, 1 << 62, 4).astype(np.uint64)])) for _ in range(30)]
        blocks.append([[k, c, c, len(s), ngram_join.bitmap(s).tobytes()]
                       for c, s in zip(rng.integers(0, 1 << 60, 30).tolist(), sets)])
    edges = set()
    for i, one in enumerate(blocks):
        edges.update(ngram_join._compare((0, i, i), one, 85))
        for j in range(i):
            edges.update(ngram_join._compare((0, j, i), blocks[j] + one, 85))
    assert set(least_of_component(edges).values()) == {min(r[1] for b in blocks for r in b)}
    assert len(edges) < 300 + 10 * 10, len(edges)


def test_op1_groups_in_many_blocks(spark, monkeypatch):
    """Components that only the last pass finds, over several blocks of a tile and of a group."""
    rng = np.random.default_rng(10)
    rows = []
    for g in range(4):
        base = [f"w{g}_{k}" for k in range(70)]
        for v in range(40):
            t = list(base)
            for k in rng.integers(0, 70, size=v % 4):
                t[k] = f"x{rng.integers(50)}"
            rows.append((len(rows), " ".join(t)))
    pdf = pd.DataFrame(rows, columns=["doc_id", "text"])
    for name, value in (("PIVOT_ROUNDS", 0), ("BLOCK", 7), ("LINK_BLOCK", 15_000)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(pdf)).collect()}
    assert got == components(pdf, 4, 85)


def test_bands_meet_and_bounds_hold():
    rng = np.random.default_rng(1)
    for a in [*range(1, 60), 200, 999, 5000]:
        for b in range(a, 100 * a // 85 + 1, max(1, a // 40)):
            mine, theirs = dict(ngram_join.bands(a, 85)), dict(ngram_join.bands(b, 85))
            shared = [n for n in mine if n in theirs and n > ngram_join.most_apart(a, b, 85)]
            assert shared, (a, b)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 62, 120).astype(np.uint64))
        y = np.unique(np.concatenate([x[20:], rng.integers(0, 1 << 62, 30).astype(np.uint64)]))
        bound = ngram_join.overlap_bound(ngram_join.bitmap(x), len(x), ngram_join.bitmap(y), len(y))
        assert bound >= ngram_join.overlap(x, y) == len(np.intersect1d(x, y))


def test_op2(spark, docs):
    data = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_op3(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op3_html_wrapper"](spark, SF).collect()}
    for i, h in zip(pages.page_id, pages.html):
        a = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        a = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>", " ", a))
        text = " ".join(unescape(a).split())
        assert got[i].text == text and got[i].n_chars == len(text)


def test_op4(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op4_quality_crf"](spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        t, r = t or "", got[i]
        w = WORD.findall(t)
        n = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        in_repeat = {j for k in range(len(w) - 7) if n[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(in_repeat) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(in_repeat), failed)
        assert not (r.kept and failed)


def test_op4_held_out_accuracy(spark):
    """Fitted on half of the labelled documents, judged on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.fit(docs, labels.filter("pmod(xxhash64(doc_id), 2) = 0"))
    out = quality.apply_rules(docs, field).join(labels.filter("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").toPandas()
    judged = out[~out.base_failed]
    assert len(judged) > 100 and (judged.kept == (judged.quality == 1)).mean() > 0.97


def plain_lines(text):
    """Feature numbers of each line with a word, measured one by one."""
    seen, out = set(), []
    spaces = b" \t\n\r\x0b\x0c"
    for line in text.encode().split(b"\n"):
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", line) if x]
        if not w:
            continue
        share = [sum(c in s for c in line) / len(line) for s in (
            b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:")]
        values = [len(w), sum(c not in spaces for c in line) / len(w), *share, len(set(w)) / len(w),
                  sum(x in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">") for x in w) / len(w)]
        numbers, base = [], 0
        for v, bounds in zip(values, quality.BUCKETS.values()):
            numbers.append(base + sum(b < v for b in bounds))
            base += len(bounds) + 1
        for flag in (w[-1][-1:] in (b".", b"!", b"?"), line in seen, any(m in line for m in (b"!!", b"**", b"##"))):
            numbers.append(base + flag)
            base += 2
        seen.add(line)
        out.append((numbers, len(w)))
    return out


def plain_share(text, field):
    """Share of words in content lines on the best path, each state with its score and its labels."""
    lines = plain_lines(text)
    if not lines:
        return 0.0
    best = {}
    for k, (numbers, _) in enumerate(lines):
        emit = [sum(field.emit[n][s] for n in numbers) for s in (0, 1)]
        if k == 0:
            best = {s: (field.start[s] + emit[s], (s,)) for s in (0, 1)}
        else:
            best = {s: max(((best[r][0] + field.move[r][s] + emit[s], best[r][1] + (s,)) for r in (0, 1)),
                           key=lambda x: (x[0], x[1][-2])) for s in (0, 1)}
    path = max(best.values(), key=lambda x: (x[0], x[1][-1]))[1]
    return sum(n for (_, n), s in zip(lines, path) if s) / sum(n for _, n in lines)


def test_op4_kept(spark, docs):
    """Verdicts and content shares of every document, with features and paths in plain Python."""
    field = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op4_quality_crf"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        share = plain_share(t or "", field)
        assert got[i].content_share == pytest.approx(share, abs=1e-12)
        assert got[i].kept == (not got[i].base_failed and share >= 0.5)


def test_op4_labels_change_inside_a_text(spark):
    """Lines of a good document after lines of a bad one: the path turns from boilerplate to content."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.fit(docs, labels)
    joined = docs.join(labels, "doc_id").filter("text IS NOT NULL").select("text", "quality").toPandas()
    lines = {q: [[x for x in t.split("\n") if WORD.search(x)] for t in joined.text[joined.quality == q]] for q in (0, 1)}
    lines = {q: [x for x in v if len(x) >= 3][:40] for q, v in lines.items()}
    turned = []
    for bad, good in zip(lines[0], lines[1]):
        path = field.viterbi(quality.line_features(*quality._worded("\n".join(bad[-3:] + good[:6]))))
        turned.append(path[:3].mean() < 0.5 < path[3:].mean())
    assert len(turned) >= 20 and np.mean(turned) > 0.8
    shares = quality.apply_rules(docs, field).filter("n_words > 0").toPandas().content_share
    assert ((shares > 0) & (shares < 1)).mean() > 0.05


def test_line_labels_leave_the_documents_label():
    rng = np.random.default_rng(5)
    kinds = [np.arange(quality.PER_LINE), np.arange(quality.PER_LINE) + quality.PER_LINE]
    x, q = [], []
    for k in range(60):
        q.append(k % 2)
        x.append(np.array([kinds[q[-1] if rng.random() < 0.8 else 1 - q[-1]] for _ in range(20)]))
    gold = quality.line_labels(x, np.array(q))
    assert all((g == (f[:, 0] > 0)).all() for f, g in zip(x, gold))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(30):
        field = quality.Field(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.integers(0, quality.N_FEATURES, size=(6, quality.PER_LINE))
        score = field.emit[x].sum(1)

        def total(path):
            return (field.start[path[0]] + sum(score[k, s] for k, s in enumerate(path))
                    + sum(field.move[a, b] for a, b in zip(path, path[1:])))
        best = max((tuple(p >> k & 1 for k in range(6)) for p in range(64)), key=total)
        assert tuple(field.viterbi(x)) == best


def test_op5_blocks_of_a_hot_anchor(spark):
    """Small shards, so that anchors are split into blocks searched against each other."""
    rng = np.random.default_rng(4)
    words = [f"v{k}" for k in range(400)]
    passage = list(rng.choice(words, 60))
    rows = []
    for i in range(80):
        t = [*rng.choice(words, 25), *passage[:rng.integers(36, 61)], *rng.choice(words, 25)]
        rows.append((i, " ".join(t)))
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    seen = collections.Counter(tuple(w[k:k + 35]) for _, t in rows for w in [t.split()] for k in range(len(w) - 34))
    want = {}
    for i, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(k, k + 35)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substrings.dedup(df, shard=7).collect()} == want


def test_backward_search_counts():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 9, 3000)
    index = substrings.FmIndex(text, 9)
    circle = np.concatenate([text, text[:64]])
    for size in (1, 2, 3, 4):
        for _ in range(20):
            p = rng.integers(0, 9, size)
            low, high = np.array([index.first[p[-1]]]), np.array([index.first[p[-1] + 1]])
            for s in p[-2::-1]:
                low, high = index.extend(np.array([s]), low, high)
            assert high[0] - low[0] == sum((circle[k:k + size] == p).all() for k in range(len(text)))


def test_op9(spark, docs):
    got = QUERIES["op9_imatch_fingerprints"](spark, SF).toPandas().set_index("doc_id")
    d = docs.sort_values("doc_id", ascending=False)
    t = [x or "" for x in d.text]
    for k, i in enumerate(d.doc_id):
        cut = len(t[k]) // 3
        new = t[k][:len(t[k]) - cut] + t[(k + 1) % len(t)][:cut]
        assert got.n_chars[i] == len(t[k]) and got.edited_sha256[i] == hashlib.sha256(new.encode()).hexdigest()
    assert got.near_edited.mean() > 0.3 and got.near_next.mean() < 0.1
    assert (got.near_edited > got.near_next).mean() > 0.9


def scrambled(x):
    """The 64-bit scrambling in plain integers."""
    x &= 2 ** 64 - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2 ** 64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2 ** 64
    return x ^ (x >> 31)


def plain_fingerprint(text, lexicon):
    """Each lexicon's sorted terms one after another, as lists of integers."""
    t = {xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()}
    t = sorted(t & lexicon or t)

    def hashed(own, digits):
        if not own:
            return "-" * digits
        return f"{xxhash.xxh3_64_intdigest(b''.join(x.to_bytes(8, 'little') for x in own)) >> (64 - 4 * digits):0{digits}x}"

    out = [hashed([x for x in t if scrambled(x + (k + 1) * 0xA0761D6478BD642F) % 8], 12) for k in range(8)]
    for family, share in enumerate((32, 128, 512, 2048)):
        slot = [scrambled(x + (family + 101) * 0xA0761D6478BD642F) % share for x in t]
        out += [hashed([x for x, at in zip(t, slot) if at == k], 4) for k in range(32)]
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    for family in (3, 2, 1, 0):
        pairs = [(x, y) for x, y in zip(a, b) if len(x) == 4][32 * family:32 * family + 32]
        filled = [(x, y) for x, y in pairs if (x, y) != ("----", "----")]
        if len(filled) >= 8:
            wide = any(x == y and x[0] != "-" for x, y in zip(a[:8], b[:8]))
            return max(sum(x == y for x, y in filled) / len(filled), 7 / 8 if wide else 0)
    filled = [(x, y) for x, y in zip(a[8:], b[8:]) if (x, y) != ("----", "----")]
    return sum(x == y for x, y in filled) / max(1, len(filled))


def test_op9_fingerprints(spark, docs):
    """Lexicon, fingerprints and likeness against plain integers, and by the join that a large lexicon takes."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = docs.sort_values("doc_id", ascending=False)
    texts = [x or "" for x in d.text]
    df = collections.Counter(w for t in texts for w in {xxhash.xxh3_64_intdigest(w) for w in t.encode().lower().split()})
    lexicon = {w for w, n in df.items() if 2 <= n <= len(texts) // 4}
    sent, joined = imatch.lexicon(table), imatch.lexicon(table, sent_terms=10)
    assert set(sent.sent.tolist()) == lexicon
    assert joined.sent is None and {r.term % 2 ** 64 for r in joined.table.collect()} == lexicon
    own = [plain_fingerprint(t, lexicon) for t in texts]
    for terms in (sent, joined):
        got = imatch.edited_fingerprints(table, terms).toPandas().set_index("doc_id")
        assert len(got) == len(texts)
        for k, i in enumerate(d.doc_id):
            after = (k + 1) % len(texts)
            changed = plain_fingerprint(imatch.edit(texts[k], texts[after]), lexicon)
            assert got.fingerprint[i] == "".join(own[k]) and got.edited_fingerprint[i] == "".join(changed)
            assert got.near_edited[i] == plain_likeness(own[k], changed)
            assert got.near_next[i] == plain_likeness(own[k], own[after])
            assert imatch.likeness(got.fingerprint[i], got.edited_fingerprint[i]) == got.near_edited[i]
        alone = imatch.fingerprint(table, terms).toPandas().set_index("doc_id").fingerprint
        assert (alone == got.fingerprint[alone.index]).all()


def test_op9_wide_lexicons():
    """One term of 200 changed: some wide lexicon lacks both forms, or the narrow ones mostly agree."""
    rng = np.random.default_rng(4)
    hits = []
    for _ in range(40):
        t = np.unique(rng.integers(0, 2 ** 63, 200).astype(np.uint64))
        a, b = imatch.sketch(t), imatch.sketch(np.sort(np.append(t[1:], np.uint64(rng.integers(0, 2 ** 63)))))
        hits.append(((a == b)[:8]).any())
        assert imatch.sketch_likeness(a, b) > 0.7
    assert 0 < sum(hits) < 40


def test_pipeline(spark, docs):
    """Every stage on its input: junk goes, near copies are one, secrets are out, ids give texts."""
    kept, parts = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        parts[name] = kept.toPandas()
        if name != "byte-level bpe":
            assert list(kept.columns) == list(docs.columns)
            kept = spark.createDataFrame(parts[name], kept.schema)
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    ids = set(parts["quality rules"].doc_id)
    assert all(i in ids for i in labels.index[labels.quality == 1] if len(WORD.findall(docs.set_index("doc_id").text[i])) > 100)
    one = parts["quality rules"]
    want = {c for _, c in components(one, 5, 80).values()}
    assert set(parts["n-gram jaccard join"].doc_id) == want
    assert not parts["secret scan"].text.str.contains("[0-9a-f]{32,}", regex=True).any()
    assert len(parts["byte-level bpe"]) == len(parts["mixing"])
    assert (parts["byte-level bpe"].n_tokens == parts["byte-level bpe"].ids.map(len)).all()


def test_word_hashes_start_anew(monkeypatch):
    monkeypatch.setattr(WordHashes, "LIMIT", 3)
    h = WordHashes()
    first = h.of([b"a", b"b", b"c", b"d"])
    assert (h.of([b"a", b"d"]) == first[[0, 3]]).all()
