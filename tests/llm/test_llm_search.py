"""Operators 11 to 13 against plain Python, and on odd rows."""

import heapq
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import lexical, repair, vectors
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
VECS = "vec_id long, embedding array<float>"


# 11

def nearest_rows(rows, k, asked):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = pd.Series([len(v) for _, v in good]).value_counts()
    dim = max(d for d in dims.index if dims[d] == dims.max()) if len(dims) else 0
    good = [g for g in good if len(g[1]) == dim]
    out = {}
    for i, q in good:
        if i is not None and asked(i):
            near = sorted((math.sqrt(((q - v) ** 2).sum()), j is not None, j) for j, v in good if j != i)[:k]
            out[i] = [(r + 1, j, s) for r, (s, _, j) in enumerate(near)]
    return out


def found_rows(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({x[1] for x in got.get(q, [])} & {x[1] for x in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def test_op11_recall_and_scores(spark):
    rows = [tuple(r) for r in pd.read_parquet(f"{SF}/embeddings.parquet")[["vec_id", "embedding"]].itertuples(index=False)]
    rows = [(int(i), [float(x) for x in v]) for i, v in rows]
    want, got = nearest_rows(rows, 10, lambda i: i % 100 == 0), found_rows(QUERIES["op11_rotated_codes"](spark, SF))
    assert set(got) == set(want) and recall(got, want) >= 0.99
    by_id = dict(rows)
    for q, found in got.items():
        assert [x[0] for x in found] == list(range(1, 11))
        for _, i, s in found:
            assert s == pytest.approx(np.linalg.norm(np.array(by_id[q], float) - np.array(by_id[i], float)), rel=1e-12)


def test_op11_groups_parts_and_copies(spark, monkeypatch):
    """Tight groups, so lists are left out by their bounds; a third of the rows are one vector; small parts."""
    monkeypatch.setattr(vectors, "PART_BYTES", 40 * 8 * 24)
    monkeypatch.setattr(vectors, "SAMPLE", 200)
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 24)) * 6
    data = np.concatenate([np.repeat(middle[:1], 400, axis=0), middle[rng.integers(12, size=800)] + rng.normal(size=(800, 24))])
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    rng.shuffle(rows)
    index = vectors.Index(spark.createDataFrame([(int(i), v) for i, v in rows], VECS))
    assert index.lists.agg(F.max("parts")).first()[0] > 5
    want, got = nearest_rows(rows, 10, lambda i: i % 100 == 0), found_rows(index.search(F.col("vec_id") % 100 == 0))
    assert recall(got, want) >= 0.98
    assert [x[1] for x in got[0]] == [x[1] for x in want[0]] == list(range(1, 11))       # ties to smaller ids


def test_op11_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]),
            (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.1]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (100, [3.0, 4.0])]
    df = spark.createDataFrame(rows, VECS).withColumn("list", F.lit("x")).withColumn("VEC", F.lit(1)).withColumn("score", F.lit(0))
    got = found_rows(vectors.Index(df).search(F.col("vec_id") % 100 == 0))
    assert got == nearest_rows(rows, 10, lambda i: i % 100 == 0)
    assert found_rows(vectors.Index(df.filter("vec_id = 0")).search(F.lit(True))) == {}
    empty = vectors.Index(df.limit(0)).search(F.lit(True))
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_op11_estimates_keep_their_bound():
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(500, 40))
    turn, centre = vectors.rotation(40), rng.normal(size=40) * 0.1
    codes, length, own = vectors.encode(rows, centre, turn)
    unit = (rows - centre) / length[:, None]
    q = rng.normal(size=(30, 40))
    q /= np.linalg.norm(q, axis=1)[:, None]
    off = np.abs(vectors.estimate(codes, own, q @ turn) - q @ unit.T)
    assert (off <= vectors.error_bound(own, 40)[None, :]).mean() > 0.99


# 12

def ranked(docs, items, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    bags = [(d, word.findall((t or "").translate(lower))) for d, t in docs]
    bags = [(d, w) for d, w in bags if w]
    N, L = len(bags), sum(len(w) for _, w in bags)
    out = set()
    for item, text in items:
        terms = set(word.findall((text or "").translate(lower)))
        scores = []
        df = {t: sum(t in w for _, w in bags) for t in terms}
        for d, w in bags:
            m = 50 + (50 * len(w) * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10 ** 9 * w.count(t)) // (1000 * w.count(t) + 20 * m))
                    for t in terms)
            if s > 0:
                scores.append((-s, d is not None, d))
        out |= {(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])}
    return out


def test_op12_many_turns_and_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    monkeypatch.setattr(lexical, "TURN", 2)
    monkeypatch.setattr(lexical, "CELLS", 600)
    rnd = random.Random(5)
    words = [f"W{k}é" for k in range(30)] + ["the", "THE", "a1"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(k, text(rnd.randint(1, 30))) for k in range(150)] + [(900 + k, "the the, W1é") for k in range(20)]
    docs += [(None, "the a1"), (None, "the a1"), (500, None), (501, " .,"), (3, "the a1"), (502, "W2é " * 5000)]
    items = [(k, text(rnd.randint(1, 12))) for k in range(25)] + [(77, None), (78, ""), (79, "nowhere"), (5, "W2é w3É"), (None, "a1"), (80, "W1é"), (80, "W1é")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("n", F.lit(0))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(0)).withColumn("block", F.lit(0))
    got = [tuple(r) for r in lexical.search(d, i, k=7).collect()]
    want = ranked(docs, sorted(set(items), key=str), 7)
    assert set(got) == want
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0


def test_op12_shared_sets_are_used_once():
    sets = [["a", "b", "c", "x"], ["a", "b", "c", "y"], ["a", "b", "z"], ["q"]]
    g = lexical.graph(sets)
    names = list(g["terms"])
    content = [{t} for t in names]
    for x, y in zip(g["left"], g["right"]):
        assert not content[x] & content[y]
        content.append(content[x] | content[y])
    assert content[len(names):] == [{"a", "b"}, {"a", "b", "c"}]
    for s, nodes in zip(sets, g["nodes"]):
        assert sorted(t for n in nodes for t in content[n]) == sorted(s)
    assert sum(map(len, g["nodes"])) == 7


def test_op12_mining_keeps_every_term():
    rng = np.random.default_rng(2)
    sets = [[f"t{k}" for k in np.flatnonzero(rng.random(60) < 0.3)] for _ in range(40)]
    g = lexical.graph(sets)
    content = [[t] for t in g["terms"]]
    for x, y in zip(g["left"], g["right"]):
        content.append(content[x] + content[y])
    assert [sorted(t for n in nodes for t in content[n]) for nodes in g["nodes"]] == [sorted(s) for s in sets]
    assert len(g["left"]) + sum(map(len, g["nodes"])) < 0.8 * sum(map(len, sets))


# 13

def cheapest(rows):
    """Counts and the least (cost, audit) by a search over (row, state) in order of cost."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], __import__("hashlib").md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, said = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            break
        if (k, state) in done:
            continue
        done.add((k, state))
        for initial, to in follow[state].items():
            if initial in names:
                heapq.heappush(heap, (cost + 5, audit + "I", k, to, said + (names[initial] + ":",)))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, said))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 * (faults[k] == "truncated")
                if role[:1] in follow[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, follow[state][role[:1]], said + (f"{role}:{text}",)))
                for initial, to in follow[state].items():
                    if initial in names:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, to, said + (f"{names[initial]}:{text}",)))
    known = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "blank": faults.count("blank"),
            "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit}, list(said)


def random_turns(rnd, n):
    roles, said = ["system", "user", "user", "assistant", "assistant", "tool", "User", ""], ["a.", "b!", "c", "", " \t", "d? ", "e . x", "long. " * 50]
    return [(rnd.choice([None, k, k, k, k + 1]), rnd.choice(roles), rnd.choice(said) if rnd.random() < 0.4 else f"{k} words" + rnd.choice(["", "."]))
            for k in range(n)]


def check_repair(spark, convs, extra=lambda df: df):
    rows = [(c, *r) for c, turns in convs.items() for r in turns]
    repairs, edits = repair.repair(extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r.asDict() for r in repairs.drop("segments").collect()}
    said = {}
    for r in edits.filter("edit <> 'D'").orderBy("conv_id", "part", "nth").collect():
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert edits.count() == sum(len(r["audit"]) for r in got.values())
    assert set(got) == set(convs)
    for c, turns in convs.items():
        want, lines = cheapest([(t, r or "", x or "") for t, r, x in turns])
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == want, (c, turns)
        assert said.get(c, []) == lines, (c, turns)


def test_op13_random_conversations(spark):
    rnd = random.Random(8)
    convs = {c: random_turns(rnd, rnd.choice([1, 2, 3, 5, 8, 30])) for c in range(150)}
    convs[None] = [(0, "user", "x."), (1, "assistant", None), (2, None, "y."), (2, None, "y.")]
    check_repair(spark, convs, lambda df: df.withColumn("mark", F.lit("z")).withColumn("late", F.lit(7)).withColumn("AT", F.lit(1)))


def test_op13_one_conversation_over_many_partitions(spark):
    rnd = random.Random(3)
    convs = {1: random_turns(rnd, 700), 2: random_turns(rnd, 3), 0: random_turns(rnd, 40)}
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_repair(spark, convs)
        rows = spark.createDataFrame([(1, *r) for r in convs[1]], "conv_id long, turn long, role string, text string")
        assert repair.parsed(rows).filter("cell IS NOT NULL").count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_op13_empty(spark):
    repairs, edits = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repairs.count() == 0 and edits.count() == 0
