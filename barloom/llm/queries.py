"""The registered corpus queries and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, chat, html, imatch, lexical, mixing, ngram_join, quality, repair, secrets, substrings, urls,
               vectors)
from .common import read, sha256_hex

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs).select("doc_id", "ids")
    return bpe.decode(ids).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"))


@query("op4_quality_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.apply_rules(docs, field).drop("text")


_SECRET_SQL_RULES = [(r, r.pattern.replace("'", "''")) for r in secrets.RULES]
_SECRET_SQL = ",\n".join(
    f"""s{k} AS (SELECT row_id, [x FOR x IN list_transform(range(1, len(m) + 1), lambda i: {{
        'start': coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0),
        'ord': {k}, 'len': length(m[i]), 'grp': length(g[i]), 'kind': '{r.kind}'}}) IF x.grp >= {r.least}] AS spans
    FROM (SELECT row_id, string_split_regex(t, '{q}') AS p, regexp_extract_all(t, '{q}') AS m,
        regexp_extract_all(t, '{q}', {r.group}) AS g FROM d))""" for k, (r, q) in enumerate(_SECRET_SQL_RULES))
_SPAN_TEXT = ("coalesce(array_to_string(list_transform({}, lambda x: x.kind || ':' || CAST(x.start AS BIGINT) || ':' "
              "|| CAST(x.start + x.len AS BIGINT)), ','), '')")


@query("op7_secret_scan", f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
{_SECRET_SQL},
a AS (SELECT doc_id, s0.spans AS s0, s1.spans AS s1, s2.spans AS s2,
    list_sort(list_concat(s0.spans, list_concat(s1.spans, s2.spans))) AS base,
    list_sort({' || '.join(f's{k}.spans' for k in range(len(secrets.RULES)))}) AS every
  FROM d {' '.join(f'JOIN s{k} USING (row_id)' for k in range(len(secrets.RULES)))})
SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access,
  CAST(len(s2) AS BIGINT) AS n_hex, sha256({_SPAN_TEXT.format('base')}) AS base_sha256,
  {_SPAN_TEXT.format('every')} AS spans FROM a""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_base = sum(r.base for r in secrets.RULES)

    def count(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["order"] < n_base)
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        sha256_hex(secrets.span_text(base)).alias("base_sha256"),
                        secrets.span_text(F.col("secrets")).alias("spans"))


_MIX_ALPHA, _MIX_SEED = 0.7, 17


@query("op10_mix_sources", f"""
WITH d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || md5(coalesce(text, '')) AS k FROM documents),
s AS (SELECT source AS src, CAST(sum(coalesce(length(text), 0) + 1) AS DOUBLE) AS n FROM d GROUP BY 1),
r AS (SELECT src, pow(n, {_MIX_ALPHA}) * sum(n) OVER () / (sum(pow(n, {_MIX_ALPHA})) OVER () * n) AS rate FROM s),
m AS (SELECT src, rate, greatest(1, ceil(rate / 64)) AS parts FROM r),
c AS (SELECT src, any_value(CAST(parts AS INTEGER)) AS parts, list(p ORDER BY i) AS cdf FROM (SELECT src, parts, i,
    sum(exp(-rate / parts + i * ln(rate / parts) - lgamma(i + 1))) OVER (PARTITION BY src ORDER BY i) AS p
    FROM m, range(0, CAST(ceil(rate / parts + 12 * sqrt(rate / parts) + 30) AS BIGINT) + 1) t(i)) GROUP BY src),
u AS (SELECT d.*, cdf, (CAST('0x' || substr(md5('{_MIX_SEED}:' || j || ':' || k), 1, 13) AS BIGINT) + 0.5)
    / 4503599627370496.0 AS u FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.src, range(1, parts + 1) q(j)),
n AS (SELECT doc_id, text, lang, source, n_chars, k,
    CAST(sum(len(list_filter(cdf, lambda x: x < u))) AS BIGINT) AS n FROM u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
    md5('order{_MIX_SEED}:' || copy || ':' || k) AS mix_key FROM n, range(1, n + 1) x(copy)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), alpha=_MIX_ALPHA, seed=_MIX_SEED)


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return ngram_join.jaccard_components(docs, links=True).select("doc_id", "n_shingles", "component_id", "n_links")


URL_RULES = (urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"),
             urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow"))
#: Listed domains: names known for spam, each in the three zones.
LISTED = tuple(f"{name}.example.{zone}" for name in
               ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
               for zone in ("com", "net", "org"))
_URL_CASES = "\n".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.name)))
_URL_NAMES = _URL_CASES.format(*(r.name for r in sorted(URL_RULES, key=lambda r: -len(r.name))))
_URL_VERDICTS = _URL_CASES.format(*(r.verdict for r in sorted(URL_RULES, key=lambda r: -len(r.name))))


@query("op6_url_filter", f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {_URL_NAMES} END AS rule, CASE {_URL_VERDICTS}
    WHEN list_has_any([array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
        {list(LISTED)}) THEN 'block' ELSE 'allow' END AS verdict FROM p""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return urls.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


_ESCAPED = r"""regexp_replace(t, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|OUT|ROLE(?::[0-9A-F-]*)?)\]))', '\1\\\2\3', 'g')"""


@query("op8_chat_prefix_targets", f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
s AS (SELECT *, length({_ESCAPED}) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 11
        ELSE 16 + coalesce(2 * strlen(role), 1) END AS size,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, t)),
e AS (SELECT *, 3 + (i - 1) + sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS whole FROM s)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(whole) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    examples = chat.expand(turns.unionByName(more))
    back = examples.select(
        "conv_id", "example", F.char_length("formatted").alias("size"),
        chat.masked(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        chat.read_turns(F.col("formatted")).alias("turns"))
    whole = F.max_by("turns", "example")                     # the last example has every turn
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))),
                                    lambda x: F.coalesce(x["loss"], F.lit(""))), "")
    convs = back.groupBy("conv_id").agg(whole.alias("turns"), loss.alias("loss"),
                                        F.sum("size").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(
        F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                        sha256_hex(lines).alias("turns_sha256"),
                        F.char_length("loss").cast("long").alias("loss_chars"),
                        sha256_hex(F.col("loss")).alias("loss_sha256"), "formatted_chars")


@query("op9_imatch_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.edited_fingerprints(docs, imatch.lexicon(docs))


_W = substrings.WINDOW


@query("op5_substring_dedup", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
s AS (SELECT r, i, array_to_string(w[i:i + {_W - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {_W - 2})) AS i FROM d)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY g) > 1 AS f FROM s),
x AS (SELECT r, i, word, max(coalesce(f, false)) OVER (PARTITION BY r ORDER BY i ROWS {_W - 1} PRECEDING) AS gone
    FROM e LEFT JOIN f USING (r, i)),
k AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM x GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return substrings.dedup(docs).select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


@query("op3_html_wrapper")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op11_rotated_codes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vectors.Index(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return index.search(F.col("vec_id") % 100 == 0, k=10)


@query("op12_shared_lexical_search", r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n, w FROM t WHERE len(w) > 0),
g AS (SELECT count(*) AS gn, CAST(sum(n) AS BIGINT) AS gl FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, n, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(gn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, g GROUP BY term),
s AS (SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * gn) // gl)))) AS BIGINT) AS score
    FROM i JOIN p USING (term) JOIN f USING (term), g GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), k=50)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` rows with the faults that the contract of operator 13 draws by row."""
    void = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), void), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), void)).cast("binary")) % 20
    text, role = F.coalesce("text", void), F.coalesce("role", void)
    return (turns.select(
        "conv_id", "turn", draw.alias("draw"), F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
        .filter("draw <> 0")
        .withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .drop("draw", "copy"))


def _then(state: str, cost: str, edit: str, line: str) -> str:
    """SQL of a state text (six digits of cost, audit, a mark, repaired lines) after an edit."""
    return (f"(lpad(CAST(CAST(substr({state}, 1, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || "
            f"substr({state}, 7, instr({state}, chr(1)) - 7) || '{edit}' || substr({state}, instr({state}, chr(1))) || {line})")


def _edited(state: str, to: str) -> str:
    """SQL of keeping the row or giving it another role, to state ``to``; null where neither can be."""
    keep = f"CASE WHEN NOT must AND initial = '{to}' THEN {_then(state, 'more', 'K', 'chr(10) || role || chr(58) || text')} END"
    if to == "s":
        return keep
    name = {"u": "user", "a": "assistant"}[to]
    return f"{keep}, CASE WHEN NOT must THEN {_then(state, '1 + more', 'R', f'chr(10) || {chr(39)}{name}:{chr(39)} || text')} END"


_INSERT = {to: {x: _then(x, "5", "I", f"chr(10) || '{name}:'") for x in "nsua"} for to, name in (("u", "user"), ("a", "assistant"))}
_DELETE = {x: _then(x, "2", "D", "''") for x in "nsua"}
_SPACE_SQL = r"[\x20\x09-\x0D]"


@query("op13_conversation_repair", rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) t(i))),
d AS (SELECT conv_id, turn, xor(list_reduce([ord(x) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
    lambda c, b: xor(c >> 8, tab[CAST(xor(c, b::BIGINT) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS draw,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM d, range(2) c(copy) WHERE draw <> 0 AND (copy = 0 OR draw = 3)),
f AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?]{_SPACE_SQL}*$') THEN 'truncated' END AS fault
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM e)),
r AS (SELECT conv_id, k, role, text, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS must,
    CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, '000000' || chr(1) AS n, NULL::VARCHAR AS s,
    '000005I' || chr(1) || chr(10) || 'user:' AS u, '000010II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' AS a FROM r
  UNION ALL
  SELECT conv_id, k, n, s, u, least(a, {_INSERT['a']['u']}) AS a FROM (
    SELECT conv_id, k, n, s, least(u, {_INSERT['u']['n']}, {_INSERT['u']['s']}, {_INSERT['u']['a']}) AS u, a FROM (
      SELECT p.conv_id, r.k, {_DELETE['n']} AS n, least({_DELETE['s']}, {_edited('n', 's')}) AS s,
        least({_DELETE['u']}, {_edited('n', 'u')}, {_edited('s', 'u')}, {_edited('a', 'u')}) AS u,
        least({_DELETE['a']}, {_edited('u', 'a')}) AS a
      FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = p.k + 1))),
b AS (SELECT conv_id, least(n, a) AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM f) GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best, 1, 6) AS BIGINT), 0) AS cost,
  coalesce(substr(best, 7, instr(best, chr(1)) - 7), '') AS audit,
  sha256(coalesce(substr(best, instr(best, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN b ON o.conv_id IS NOT DISTINCT FROM b.conv_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repairs, edits = repair.repair(damaged(turns))
    line = F.struct("part", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    said = (edits.filter("edit <> 'D'").groupBy(F.col("conv_id").alias("said_id"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("said")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    convs = turns.select(F.col("conv_id").cast("long").alias("id")).distinct()
    return (convs.join(repairs.drop("segments"), F.col("id").eqNullSafe(F.col("conv_id")), "left")
            .join(said, F.col("id").eqNullSafe(F.col("said_id")), "left")
            .select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"), sha256_hex(F.coalesce("said", F.lit(""))).alias("repaired_sha256")))
