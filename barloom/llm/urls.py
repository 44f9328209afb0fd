"""URL filters: exact rules, then a Bloom filter cascade over host names. DataFrame functions only.

Level 1 of the cascade holds the listed keys; level 2 the keys of the corpus that level 1 takes
for listed ones; level 3 the listed keys that level 2 takes for those, and so on until no key is
mistaken. A key of that universe is listed exactly when the first level which lacks it has an
even number. The levels are constants in the expression, so judging a url joins nothing.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: A cascade takes about this many keys and then has about four megabytes; a longer list is dealt
#: to several cascades by the hash of the key, and a key asks its own one only.
PART_KEYS = 1_000_000


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]          # 32 bits each

    def has(self, key: Column, level: int) -> Column:
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<int>")   # folded once
        out = F.lit(True)
        for at in _places(key, level, self.bits, self.hashes):
            word = F.get(held, F.floor(at / 32).cast("int"))
            out = out & (F.getbit(word, (at % 32).cast("int")) == 1)
        return out


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    one = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(bits))
    two = F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(bits))
    return [F.pmod(one + two * i, F.lit(bits)) for i in range(hashes)]


def _fill(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """A filter of the ``n`` keys with about the false positive rate. Bits are or-ed per
    word in the tasks; what comes to the driver is the filter itself."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    hashes = min(16, max(1, round(bits / n * math.log(2))))
    at = F.explode(F.array(*_places(F.col("key"), level, bits, hashes)))
    rows = (keys.select(at.alias("at"))
            .groupBy(F.floor(F.col("at") / 32).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1, CAST(at % 32 AS INT))")).alias("mask")).collect())
    words = [0] * ((bits + 31) // 32)
    for r in rows:
        words[r.word] = r.mask
    return Level(bits, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed; null is not."""
        out = F.lit(len(self.levels) % 2 == 1)                # every level has it
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].has(key, k + 1), out).otherwise(F.lit(k % 2 == 1))
        return F.coalesce(key.isNotNull() & out, F.lit(False))


@dataclass(frozen=True)
class DealtCascade:
    parts: tuple[Cascade, ...]

    @property
    def levels(self) -> tuple[Level, ...]:
        return tuple(level for p in self.parts for level in p.levels)

    def lists(self, key: Column) -> Column:
        out = F.lit(False)
        for k, part in enumerate(self.parts):
            if part.levels:
                out = F.when(_part(key, len(self.parts)) == k, part.lists(key)).otherwise(out)
        return out


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def build_cascade(listed: DataFrame, universe: DataFrame, part_keys: int = PART_KEYS) -> Cascade | DealtCascade:
    """A cascade for ``listed(key)`` that is exact on ``universe(key)`` and on the listed keys.

    Null keys are left out and repeated ones count once; with no listed key nothing is listed.
    The first level's rate makes its false positives about as many as the listed keys, whatever
    the universe; later levels halve. A list of more than ``part_keys`` keys is dealt to several cascades.
    """
    own = listed.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    n = own.count()
    if n == 0:
        return Cascade(())
    others = (universe.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL")
              .distinct().join(own, "key", "left_anti"))
    if n <= part_keys:
        return _levels(own, others, n)
    parts, built = math.ceil(n / part_keys), []
    for k in range(parts):
        mine = _part(F.col("key"), parts) == k
        some = own.filter(mine)
        size = some.count()
        built.append(_levels(some, others.filter(mine), size) if size else Cascade(()))
    return DealtCascade(tuple(built))


def _levels(own: DataFrame, others: DataFrame, n: int) -> Cascade:
    """The levels for the ``n`` listed keys ``own`` against ``others``."""
    m = others.count()
    levels = [_fill(own, 1, n, min(0.5, max(1e-9, n / max(m, 1))))]
    # Both sides shrink by what each new level tells apart; only listed keys and false
    # positives are left, and those are about as many as the listed keys.
    inside, outside = own, others
    held = []
    while True:
        number = len(levels)
        outside = outside.filter(levels[-1].has(F.col("key"), number)).persist()
        held.append(outside)
        wrong = outside.count()
        if wrong == 0:
            for df in held:
                df.unpersist()
            return Cascade(tuple(levels))
        levels.append(_fill(outside, number + 1, wrong, 0.5))
        inside, outside = outside, inside


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """``field`` of the longest rule that fits; of equally long ones the first by name."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: tuple[Rule, ...], listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest fitting rule decides; without one, a url is blocked when its host or a domain
    above it is in ``listed(key)``. A null url, or one without ``://``, has neither and is allowed.
    Columns under the new names are replaced; repeated and null rows are judged like others.
    """
    new = ("host", "path", "rule", "verdict")
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    host, path = split_url(F.col(url))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    universe = parsed.select("host").distinct().select(F.explode(host_suffixes(F.col("host"))).alias("key"))
    cascade = build_cascade(listed, universe)
    block = F.exists(host_suffixes(F.col("host")), cascade.lists) if cascade.levels else F.lit(False)
    rule = matching_rule(F.col("host"), F.col("path"), rules, "name")
    verdict = matching_rule(F.col("host"), F.col("path"), rules, "verdict")
    return parsed.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(
        verdict, F.when(block, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
