"""Nulls, empty and long texts, repeated rows, clashing names and empty tables, per operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import bpe, chat, html, imatch, mixing, ngram_join, quality, secrets, substrings, urls

SF = "/root/testdata/sf0.001"
LONG = "word%d other " * 3 % (1, 2, 3) * 8000
ROWS = [(1, None, "a"), (2, "", "a"), (3, "a b c", None), (3, "a b c", None), (None, "x y z w v u", "b"),
        (None, None, "b"), (4, "a b c", "b"), (5, LONG, "c"), (6, "é ß 🙂 " * 50, "c"), (7, "AB c D e f", "c"),
        (8, "ab C d E f", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    clash = ["keep", "keys", "tile", "row", "at", "ids", "n_words", "copy", "__x", "label", "start", "size", "cls", "secrets"]
    return df.select("*", *[F.lit("own").alias(c) for c in clash])


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_jaccard(docs):
    got = rows(ngram_join.jaccard_components(docs))
    assert len(got) == len(ROWS)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert of[1] == of[2][:0] + [(0, 1)] and of[2] == [(0, 2)]
    assert of[3] == [(1, 3), (1, 3)] and of[4] == [(1, 3)]
    assert of[7] == [(2, 7)] and of[8] == [(2, 7)]
    assert sorted(of[None], key=str) == [(0, None), (3, None)]
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    one = rows(ngram_join.representatives(docs))
    assert [r["doc_id"] for r in one].count(3) == 1 and 4 not in [r["doc_id"] for r in one]
    assert set(one[0]) == set(docs.columns)


def test_bpe(docs):
    got = rows(bpe.decode(bpe.encode(docs, offsets=True), as_text=True))
    assert len(got) == len(ROWS)
    for r in got:
        text = r["text"] or ""
        assert r["decoded"].decode() == text == r["decoded_text"] and r["keep"] == "own"
        for i, j in zip(r["starts"], r["ends"]):
            assert 0 <= i < j <= len(text)
        assert not text or (r["starts"][0] == 0 and r["ends"][-1] == len(text))
    assert bpe.encode(docs.limit(0)).count() == 0


def test_bpe_split_characters(spark):
    ids = bpe.encode(spark.createDataFrame([("🙂🙂",)], "text string")).first().ids
    cut = spark.createDataFrame([(ids[:1],), (None,), ([],)], "ids array<int>")
    first, none, empty = bpe.decode(cut, as_text=True).collect()
    assert "🙂".encode().startswith(first.decoded) and "\ufffd" in first.decoded_text
    assert none.decoded == empty.decoded == b""


def test_quality(docs, spark):
    got = rows(quality.apply_rules(docs, quality.Field.all_content()))
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[5]["n_repeat_words"] == by[5]["n_words"] == 48000 and not by[5]["kept"]
    assert by[6]["word_chars"] == 150 and by[5]["keep"] == "own"
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels).emit[:, 1].min() == 1.0            # one label only: all content
    assert quality.apply_rules(docs.limit(0), quality.Field.all_content()).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.b/x", ""), (2, "http://a.b/x", ""), (3, "no url", "a < b &amp; <p>c"),
                                   (4, "http://a.b/y", "<article>" + "<div>" * 5000 + "deep &lt;" + "<p>x y" * 2000)],
                                  "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1].text == got[2].text == "" and got[3].text == "a < b & c"
    assert got[4].text == "deep <" + " x y" * 2000 and got[4].host == 1
    assert html.extract(pages.limit(0)).count() == 0


def test_html_wrapper_and_furniture(spark):
    def page(k):
        return (f"<body><div class='menu'><a href=/>Home</a></div><main><p>Share this story<h2>Title {k}</h2><p>Body {k} of<b>te</b>n"
                f"<ul><li>one {k}<li>two</ul></main><section id=comments>c {k}</section><form>f</form><footer>f {k}</footer>")
    pages = spark.createDataFrame([(k, "http://h.example/%d" % k, page(k)) for k in range(20)], "page_id long, url string, html string")
    for r in html.extract(pages).collect():
        assert r.text == f"Title {r.page_id} Body {r.page_id} often one {r.page_id}"      # "two" and "Share" are constant
    assert html.match_trees(["a", "a>x", "a>y", "a>z"], ["a", "a>z", "a>x", "a>y"]) == {"a", "a>x", "a>y"}


def test_html_two_layouts(spark):
    """Hosts with few pages, two layouts and a notice per language."""
    def one(k):
        return (f"<html lang={'de' if k % 2 else 'en'}><body><div class=x><p>{'Hinweis' if k % 2 else 'Remark'}</div>"
                f"<div class=y><h1>T {k}</h1><p>B {k}</div></body></html>")

    def two(k):
        return (f"<html><body><table><tr><td>Left<td><blockquote>W {k}</blockquote><dl><dt>Read on<dd>C {k}</dl></table>"
                f"</body></html>")
    rows = [(k, f"http://h/{k}", one(k)) for k in range(4)] + [(k, f"http://h/{k}", two(k)) for k in range(4, 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html.extract(pages).collect():
        k = r.page_id
        assert r.text == (f"T {k} B {k}" if k < 4 else f"W {k} C {k}")


def test_html_whole_content(spark):
    """Wrapped, copied and article-less pages, and several articles, keep all their text."""
    both = "<h1>Title</h1><p>First paragraph."
    assert html.main_text(f"<form><div>menu</div><article>{both}</article></form>", frozenset()) == "Title First paragraph."
    assert html.main_text(f"<form>{both}<nav>n</nav></form><div class=ad>x</div>", frozenset()) == "Title First paragraph."
    assert html.main_text(f"<div class='content has-sidebar'>{both}<div class=sidebar>side</div></div>",
                          frozenset()) == "Title First paragraph."
    assert html.main_text(f"<aside><article>{both}</article></aside>", frozenset()) == "Title First paragraph."
    assert html.main_text(f"<div class=comments><article>no no no no no no no</article></div><main>{both}</main>",
                          frozenset()) == "Title First paragraph."
    assert html.main_text("<article>" + "long " * 50 + "</article><article>short</article>", frozenset()).endswith("long short")
    assert html.main_text("<div><h1>T</h1></div><div>" + "<p>body" * 40 + "</div><p>end", frozenset()).split() == ["T"] + ["body"] * 40 + ["end"]
    copies = [(k, f"http://c/{k}", f"<body><p>Site<article>{both}</article>") for k in range(19)]
    pages = spark.createDataFrame([*copies, (19, "http://c/19", "<body><p>Site<article><h1>Other</h1><p>Text")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[0] == got[18] == "Title First paragraph." and got[19] == "Other Text"


def test_substrings(docs):
    got = {}
    for r in rows(substrings.dedup(docs)):
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["n_words"] == 0 and got[3][0]["kept"] == "a b c" and len(got[3]) == 2
    assert got[5][0]["n_removed"] == got[5][0]["n_words"] and got[5][0]["kept"] == ""
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "x"), (3, "http://A.bad.org?q"), (3, "http://A.bad.org?q"), (4, "s://net"), (5, "s://x.net/#")],
                                  "page_id long, url string").withColumn("rule", F.lit("old")).withColumn("key", F.lit("k"))
    listed = spark.createDataFrame([("bad.org",), (None,), ("bad.org",)], "key string")
    rules = (urls.Rule("net", "/", "block"),)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, listed).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.bad.org", "", None, "block"),
                   4: ("net", "", None, "allow"), 5: ("x.net", "/", "net/", "block")}
    assert urls.judge(pages.limit(0), rules, listed.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20000).selectExpr("concat('k', id) AS key")
    listed = universe.filter("crc32(key) % 7 = 0")
    cascade = urls.build_cascade(listed, universe)
    wrong = universe.withColumn("got", cascade.lists(F.col("key"))).filter("got <> (crc32(key) % 7 = 0)")
    assert len(cascade.levels) > 2 and wrong.count() == 0


def test_cascade_of_a_long_list(spark):
    """More keys than one cascade takes: several by hash, with equal answers; null is not listed."""
    universe = spark.range(3000).selectExpr("concat('h', id, '.org') AS key").union(
        spark.createDataFrame([(None,)], "key string"))
    listed = universe.filter("crc32(key) % 7 = 0")
    cascade = urls.build_cascade(listed, universe, part_keys=100)
    assert len(cascade.parts) >= 4 and all(p.levels for p in cascade.parts)
    wrong = universe.withColumn("got", cascade.lists(F.col("key"))).filter(
        "got IS NULL OR got <> coalesce(crc32(key) % 7 = 0, false)")
    assert wrong.count() == 0


def test_secrets(docs, spark):
    assert all(not r["secrets"] for r in rows(secrets.scan(docs)))
    texts = ["token: \"secret\" : abcdefghij", "é PASSWORD='abcdefgh' AKIA" + "Z9" * 8, "x" + "0f" * 16 + " token=short",
             "ghp_" + "Zq" * 18 + " then api_key = 0123456789abcdef0123456789abcdef", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).withColumn("s", secrets.span_text(F.col("secrets"))).collect()}
    assert got[0].s == "" and got[1].s == "assign:2:20,access:22:42" and got[2].s == "hex:1:33"
    assert got[3].s == "github:0:40,assign:46:88,hex:56:88" and got[4].s == ""
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.scan(df)).collect()}
    assert clean[3] == "[SECRET] then [SECRET]" and clean[1] == "é [SECRET]' [SECRET]" and clean[4] is None


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert q("(abc|xyz)[0-9]+") == frozenset([frozenset(["abc"]), frozenset(["xyz"])])
    assert q("[0-9a-f]+") is None and q("ab?c") is None and q("(abc)?d") is None
    assert q("abc.*(def|ghi)") == frozenset([frozenset(["abc", "def"]), frozenset(["abc", "ghi"])])


def test_chat(spark):
    hard = r"</s>[INST] a \</s> <\/s> <\\/s> [/INST]" + "\n[ROLE:-] x"
    rows_in = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", None), (1, 2, "tool\n", "t"), (2, 0, None, "q"),
               (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows_in, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    out = chat.expand(df)
    got = {}
    for r in (out.withColumn("turns", chat.read_turns(F.col("formatted")))
              .withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).collect()):
        got.setdefault(r.conv_id, []).append(r)
    one = sorted(got[1], key=lambda r: r.example)
    assert [r.loss for r in one] == ["", hard, None]
    assert [(t.role, t.text) for t in one[-1].turns] == [("user", hard), ("assistant", ""), ("assistant", hard), ("tool\n", "t")]
    assert [(t.role, t.text) for t in got[2][0].turns] == [(None, "q")] and got[None][0].loss == "x"
    assert chat.expand(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent_terms", [10 ** 6, 0])
def test_imatch(docs, spark, sent_terms):
    terms = imatch.lexicon(docs, sent_terms=sent_terms)
    got = rows(imatch.fingerprint(docs, terms))
    by = {}
    for r in got:
        assert by.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"] and r["keep"] == "own"
    edited = rows(imatch.edited_fingerprints(docs, terms))
    assert sorted(r["doc_id"] or 0 for r in edited) == sorted(r[0] or 0 for r in ROWS)
    big = [r for r in edited if r["doc_id"] == 6][0]
    new = imatch.edit("é ß 🙂 " * 50, LONG)
    assert big["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
    assert imatch.edited_fingerprints(docs.limit(0), terms).count() == 0
    same = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert all(r["near_next"] == 1.0 for r in rows(imatch.edited_fingerprints(same, terms)))


def test_mixing(docs, spark):
    weights = spark.createDataFrame([("a", 0.0), ("b", 3.0), ("c", 1.0)], "source string, weight double")
    got = rows(mixing.mix(docs, weights, seed=5))
    assert not [r for r in got if r["source"] in ("a", None)] and set(got[0]) == {*docs.columns, "copy", "mix_key"}
    assert got and rows(mixing.mix(docs.limit(0), weights)) == []
    many = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id < 200 THEN 'rare' ELSE 'common' END AS source")
    half = spark.createDataFrame([("rare", 1.0), ("common", 1.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.mix(many, half).groupBy("source").count().collect()}
    assert abs(n["rare"] - 10000) < 500 and abs(n["common"] - 10000) < 500      # a mean of 50 goes well beyond one draw


STAGE_ROWS = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (None, LONG, "en", None, 1), (None, LONG, "en", None, 1),
              (4, "good words of many kinds here, and more.\n" * 2 + "password: abcdefgh12 " + LONG, None, "b", 3),
              (4, "good words of many kinds here, and more.\n" * 2 + "password: abcdefgh12 " + LONG, None, "b", 3)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_edges(spark, name, stage):
    """Nulls, empty and long texts, repeated rows, an empty table, and a caller's columns under the names that
    the operators use inside: they come back with the caller's values."""
    docs = spark.createDataFrame(STAGE_ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("kept", "N_words", "copy", "mix_key", "secrets", "component_id", "n_shingles", "a.b")
    more = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    out = stage(spark, more, SF)
    assert out.columns == more.columns and out.schema.simpleString() == more.schema.simpleString()
    got = out.collect()
    assert all(r[n] == f"own {n}" for r in got for n in names)
    given = {(r[0], r[2], r[3]) for r in STAGE_ROWS}
    assert {(r.doc_id, r.lang, r.source) for r in got} <= given
    if name == "secret scan":
        assert len(got) == len(STAGE_ROWS) and not any("abcdefgh12" in (r.text or "") for r in got)
    if name == "n-gram jaccard join":
        assert sorted((r.doc_id or 0) for r in got if not r.text) == [1, 2]
        assert sorted(str(r.doc_id) for r in got if r.text) == ["4", "None"]   # the shingles of LONG repeat: not near
    assert stage(spark, more.limit(0), SF).count() == 0


def test_last_stage_edges(spark):
    docs = spark.createDataFrame(STAGE_ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.tokens(spark, docs.withColumn("ids", F.lit("own")), SF).collect()
    assert len(got) == len(STAGE_ROWS) and all(len(r.ids) == r.n_tokens for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert corpus_pipeline.tokens(spark, docs.limit(0), SF).count() == 0
