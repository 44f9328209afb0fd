"""Secret scans through a trigram inverted index. DataFrame functions only on the data.

Each rule's pattern is turned into a Boolean trigram query: a set of alternatives, each a set
of trigrams that all occur in any text the pattern matches. Postings (trigram, row) are
intersected per alternative; only the candidate rows are searched with the rule. A rule
whose pattern promises no trigram is searched in every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

# The standard library's own regular-expression parser; only its tree is read.
from re import _constants as K, _parser as P  # type: ignore[attr-defined]


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base kinds are given, the others are the public formats of common tokens.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,200}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]+@"),
)

#: Limits of the query derivation; beyond them a part of a pattern promises nothing.
MAX_STRINGS, MAX_ALTERNATIVES = 48, 64
Query = frozenset | None                    # alternatives (frozensets of trigrams), None: any text


def _of_strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return _least({frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings})


def _least(alternatives: set[frozenset]) -> frozenset:
    """Without alternatives that another one already covers."""
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = _least({x | y for x, y in product(a, b)})
    return both if len(both) <= MAX_ALTERNATIVES else min(a, b, key=len)


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings the items match, lower-cased, where they are few; the query)."""
    query: Query = None
    run: set[str] | None = {""}
    whole = True

    def flush() -> None:
        nonlocal query, run, whole
        query, run, whole = _and(query, _of_strings(run)), {""}, False

    for op, arg in items:
        exact, inner = _item(op, arg)
        if exact is None:
            flush()
            query = _and(query, inner)
        else:
            joined = {a + b for a in run for b in exact}
            if len(joined) > MAX_STRINGS:
                flush()
                joined = exact
            run = joined
    if whole:
        return run, _of_strings(run)
    flush()
    return None, query


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, None
    if op is K.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                chars.add(chr(value).lower())
            elif kind is K.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is K.SUBPATTERN:
        return _walk(arg[3])
    if op is K.BRANCH:
        parts = [_walk(p) for p in arg[1]]
        if all(e is not None for e, _ in parts):
            strings = set().union(*(e for e, _ in parts))
            if len(strings) <= MAX_STRINGS:
                return strings, _of_strings(strings)
        queries = [q for _, q in parts]
        return None, None if any(q is None for q in queries) else _least(set().union(*queries))
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _walk(inner)
        if exact is not None and high == 1:
            return exact | ({""} if low == 0 else set()), None
        if exact is not None and low == high and low * max(map(len, exact), default=0) <= 16 and len(exact) == 1:
            return {next(iter(exact)) * low}, None
        return None, query if low >= 1 else None
    if op is K.AT:
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams (lower-cased) for a pattern; None if it has to be scanned for."""
    return _walk(P.parse(pattern))[1]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


LANE = 60                                    # trigrams per mask column


def _masks(query_trigrams: frozenset, numbers: dict[str, int]) -> dict[int, int]:
    lanes: dict[int, int] = {}
    for t in query_trigrams:
        lane, bit = divmod(numbers[t], LANE)
        lanes[lane] = lanes.get(lane, 0) | 1 << bit
    return lanes


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(``__row``, ``__tri``): the rows whose lower-cased text has each of ``trigrams``.
    ``rows`` has ``__row`` and ``__text``. Only trigrams that some rule asks for are listed."""
    low = rows.select("__row", F.lower("__text").alias("__low"))
    found = F.array_compact(F.array(*[
        F.when(F.contains(F.col("__low"), F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))
    return low.select("__row", F.explode(found).alias("__tri"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, dict[str, Column]]:
    """Rows that pass some rule's query, with a mask of the trigrams each has; per rule the
    test of the mask, None for a rule that scans every row."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() if q is not None for alt in q for t in alt})
    if not trigrams:
        return None, {k: None for k in queries}
    numbers = {t: k for k, t in enumerate(trigrams)}
    lanes = range((len(trigrams) + LANE - 1) // LANE)
    bit = F.expr(f"shiftleft(1L, __tri % {LANE})")
    masks = (postings(rows, trigrams).groupBy("__row")
             .agg(*[F.bit_or(F.when(F.floor(F.col("__tri") / LANE) == n, bit).otherwise(F.lit(0)))
                    .alias(f"__m{n}") for n in lanes]))
    tests: dict[str, Column | None] = {}
    for kind, query in queries.items():
        tests[kind] = None
        if query is not None:
            test = F.lit(False)
            for alt in query:
                one = F.lit(True)
                for lane, mask in sorted(_masks(alt, numbers).items()):
                    one = one & (F.col(f"__m{lane}").bitwiseAND(F.lit(mask)) == F.lit(mask))
                test = test | one
            tests[kind] = test
    some = F.lit(False)
    for t in tests.values():
        some = some | t if t is not None else some
    return masks.filter(some), tests


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule in ``text``: leftmost matches that do not overlap, in code points.
    What ``split`` leaves and what the pattern takes alternate, so their lengths add up to
    the positions."""
    pattern = F.lit(rule.pattern)
    parts = F.struct(F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
                     F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length).alias("len"),
                     F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length).alias("grp"))
    none = F.array().cast("array<struct<start:int,order:int,stop:int,kind:string>>")

    def step(s: Column, k: Column, p: Column) -> Column:
        start = s["at"] + F.get(p["gap"], k)
        stop = start + F.get(p["len"], k)
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), stop.alias("stop"),
                        F.lit(rule.kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(F.get(p["grp"], k) >= rule.least, F.concat(s["spans"], F.array(span)))
                        .otherwise(s["spans"]).alias("spans"))

    def walk(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(p["len"]) - 1),
                           F.struct(F.lit(0).alias("at"), none.alias("spans")),
                           lambda s, k: step(s, k, p), lambda s: s["spans"])

    return _let(parts, lambda p: F.when(F.size(p["len"]) > 0, walk(p)).otherwise(none))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id"
         ) -> DataFrame:
    """``df`` with ``secrets``: spans (start, order, stop, kind) of all rules, by start and
    then rule; positions are code points, the end exclusive.

    A null or empty text has none. Null and repeated ids are harmless: rows meet the index by
    a hash of id and text, and equal rows have equal spans. Texts are searched whole. A column
    named ``secrets`` is replaced.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != "secrets"]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keep, body.alias("__text"), F.xxhash64(F.col(doc_id), body).alias("__row"))
    found, tests = candidates(rows.select("__row", "__text"), rules)
    if found is not None:
        rows = rows.join(found, "__row", "left")
    spans = []
    for order, rule in enumerate(rules):
        test = tests[rule.kind]
        hit = F.col("__text").rlike(_quick(rule))
        cond = hit if test is None else F.coalesce(test, F.lit(False)) & hit
        spans.append(F.when(cond, _matches(F.col("__text"), rule, order))
                     .otherwise(F.array().cast("array<struct<start:int,order:int,stop:int,kind:string>>")))
    return rows.select(*keep, F.array_sort(F.concat(*spans)).alias("secrets"))


def _quick(rule: Rule) -> str:
    """A pattern that every qualifying match contains: the last repeat with its least length."""
    if rule.least and rule.group == 0 and rule.pattern.endswith("+"):
        fixed = len(re.match(r"[A-Z]*", rule.pattern)[0])
        return f"{rule.pattern[:-1]}{{{rule.least - fixed},}}"
    return rule.pattern


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, spans: str = "secrets", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""
    piece = "struct<at:int,out:array<string>>"

    def cut(t: Column, s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        gap = F.substring(t, s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"),
                        F.when(fresh, F.concat(s["out"], F.array(gap, F.lit(mark))))
                        .otherwise(s["out"]).alias("out")).cast(piece)

    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(piece)
    new = F.aggregate(F.col(spans), start, lambda s, x: cut(t, s, x),
                      lambda s: F.array_join(F.concat(s["out"], F.array(F.substring(
                          t, s["at"] + 1, F.char_length(t)))), ""))
    return df.withColumn(text, F.when(F.size(spans) > 0, new).otherwise(t))
