"""Main text of web pages by wrapper induction.

1. Every page becomes a tree of labels, siblings with one label taken together, and a list of
   its text nodes (path and text).
2. Trees of a host that match well by simple tree matching are one layout: equal labels match,
   children match in order, as many nodes as possible. A layout's commonest tree is its template.
3. Among nodes aligned with the template, a text that nearly all different pages of the layout
   have at the same path is constant and belongs to the template. All else are varying slots.
4. The content is the varying text of the page's articles and main part, or of the whole page
   if it has neither, without slots that serve another purpose: menus, headers, footers, side
   columns, notices, adverts, forms, comments.

Counts and templates cover all pages; a host never has to fit into one task.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, map_arrow, store, texts, unstore
from .urls import split_url

#: A text is constant in a layout when at least this share of at least so many different pages has it.
CONSTANT_SHARE, LEAST_PAGES = 0.9, 2
#: Trees are one layout when at least this share of their nodes matches.
LAYOUT_MATCH = 0.7
#: A task finds the layouts of about so many trees of a host.
TREES = 1000
#: Inside an article only constant texts up to this length are template; a longer one is a
#: passage that many articles quote.
LONGEST_CONSTANT = 200
#: Up to so many hosts the templates are broadcast, beyond it joined on salted hosts.
BROADCAST_HOSTS, SALTS = 10_000, 32

# Element kinds of HTML and names in common use for page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr ruby rt rp rb".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu script style noscript template "
                    "iframe textarea svg canvas object audio video map fieldset".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie "
                      "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup nav "
                      "navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer comment comments "
                      "disqus reply replies respond share sharing social related recommended recommendations login "
                      "search searchform pagination pager toolbar widget skip contentinfo complementary".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
FORMS = frozenset("form fieldset".split())
TOP = frozenset("header masthead topbar".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPES = frozenset("html body article main section div table ul ol td th li blockquote aside nav header footer form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Text:
    """A text node: its path, decoded text, and where it stands. ``article`` tells whether an
    article or main element is around it; ``outer`` and ``inner`` are the furniture elements
    around that element and inside of it, as (number, kind)."""

    __slots__ = ("path", "text", "article", "outer", "inner")

    def __init__(self, path, text, top):
        self.path, self.text = path, text
        _, _, self.article, self.outer, self.inner = top


@lru_cache(maxsize=20_000)
def _label(tag: str, attrs: str) -> tuple[str, frozenset]:
    """Label of an element and the lower-cased parts of its class, id and role."""
    if not attrs or "=" not in attrs:
        return tag, frozenset()
    if tag == "html":                            # one layout for each language
        lang = _LANG.search(attrs)
        return (f"html:{lang[1].lower()}" if lang else tag), frozenset()
    names = [next(filter(None, m), "") for m in _NAMES.findall(attrs)]
    parts = frozenset(p.lower() for n in names for p in _PARTS.findall(n))
    return (f"{tag}.{names[0].split()[0]}" if names and names[0].split() else tag), parts


#: Kinds of furniture: what is never content, comments, forms, and what only its name tells.
HARD, TALK, FORM, NAMED = range(4)


def _furniture(tag: str, parts: frozenset, inside: bool) -> int | None:
    """Kind of furniture that an element is, if any."""
    if tag in ("html", "body"):
        return None
    if parts & COMMENTS:
        return TALK
    if tag in ("article", "main"):
        return None
    if tag in DROPPED:
        return FORM if tag in FORMS else HARD
    return NAMED if parts & FURNITURE or not inside and (tag == "header" or parts & TOP) else None


#: Deeper elements keep the path of their parent, so that paths stay short on any input.
MAX_DEPTH = 150


def parse(html: str) -> tuple[list[str], list[Text | None]]:
    """(paths in order of first appearance, text nodes with None at block boundaries)."""
    paths: dict[str, int] = {}
    out: list[Text | None] = []
    # tag, path, article, outer, inner of the open elements
    stack: list[tuple] = [("", "", False, (), ())]
    count, pos, size = 0, 0, len(html)
    while pos < size:
        m = _TOKEN.search(html, pos)
        stop = m.start() if m else size
        if stop > pos:
            out.append(Text(stack[-1][1], unescape(html[pos:stop]), stack[-1]))
        if m is None:
            break
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        block = tag not in INLINE
        if block and (not out or out[-1] is not None):
            out.append(None)
        if m[1] or m[4]:                                            # an end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else size
            continue
        ends = CLOSED_BY.get(tag)
        if block:
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k][0]
                if t == "p" or ends and t in ends:
                    del stack[k:]
                    if not ends:
                        break
                elif t in SCOPES:
                    break
        _, path, article, outer, inner = stack[-1]
        label, parts = _label(tag, m[3] if m[2] else m[6])
        count += 1
        deep = len(stack) > MAX_DEPTH
        if block and not deep:
            path = f"{path}>{label}" if path else label
            paths.setdefault(path, len(paths))
        kind = _furniture(tag, parts, article)
        if tag in ("article", "main") and not article and kind is None:
            article, outer, inner = True, tuple(x for x in inner if x[1] != FORM), ()
        if kind is not None and len(inner) <= MAX_DEPTH:
            inner += ((count, kind),)
        stack.append((tag, path, article, outer, inner))
    return list(paths), out


def match_trees(a: list[str], b: list[str]) -> set[str]:
    """Paths of ``a`` aligned with a node of ``b`` by simple tree matching: the roots' labels
    are equal and an order-preserving choice of children matches as many nodes as possible."""
    kids_a, kids_b = _children(a), _children(b)
    memo: dict[tuple[str, str], tuple[int, list]] = {}

    def score(x: str, y: str) -> int:
        """Nodes matched under two children lists, plus one for the pair itself."""
        key = (x, y)
        if key not in memo:
            left, right = kids_a.get(x, []), kids_b.get(y, [])
            table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
            for i, p in enumerate(left, 1):
                for j, q in enumerate(right, 1):
                    here = table[i - 1][j - 1] + score(p, q) if _name(p) == _name(q) else 0
                    table[i][j] = max(table[i - 1][j], table[i][j - 1], here)
            pairs, i, j = [], len(left), len(right)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((left[i], right[j]))
            memo[key] = (table[-1][-1] + 1, pairs)
        return memo[key][0]

    score("", "")
    aligned, todo = set(), [("", "")]
    while todo:
        for p, q in memo[todo.pop()][1]:
            aligned.add(p)
            todo.append((p, q))
    return aligned


def _name(path: str) -> str:
    return path.rpartition(">")[2]


def _children(paths: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for p in filter(None, paths):                # the tree of an empty page is one empty path
        out.setdefault(p.rpartition(">")[0], []).append(p)
    return out


def _clean(text: str) -> str:
    return " ".join(text.split())


def _key(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


def blocks_of(nodes: list[Text | None]) -> list[list[Text]]:
    """Runs of text nodes between block boundaries that hold more than white space."""
    out: list[list[Text]] = [[]]
    for n in nodes:
        if n is None:
            out.append([])
        else:
            out[-1].append(n)
    return [b for b in out if any(n.text.strip() for n in b)]


def _head(block: list[Text]) -> Text:
    return next(n for n in block if n.text.strip())


def _block_key(block: list[Text]) -> int:
    return _key(_head(block).path, _clean("".join(n.text for n in block)))


def page_nodes(html: str) -> tuple[str, int, list[int], list[int]]:
    """(tree, hash of the article's text, number of the path, key), the last two with one entry
    for each distinct block of text."""
    paths, nodes = parse(html)
    number = {p: k for k, p in enumerate(paths)}
    blocks = blocks_of(nodes)
    seen = {_block_key(b): number[_head(b).path] for b in blocks if _head(b).path}
    return "\n".join(paths), _key("", _joined(_content(blocks))), list(seen.values()), list(seen)


def main_text(html: str, constant: frozenset) -> str:
    """Content of one page, given the keys of its host's constant blocks."""
    blocks = blocks_of(parse(html)[1])
    varying = [b for b in blocks if not _is_constant(b, constant)] if constant else blocks
    return _joined(_content(varying)) or _joined(_content(blocks))


def _joined(blocks: list[list[Text]]) -> str:
    return _clean(" ".join(["".join([n.text for n in b]) for b in blocks]))


def _content(blocks: list[list[Text]]) -> list[list[Text]]:
    """The blocks without furniture. An element that only its name or a form makes furniture is
    none if it holds most of the text; text counts that stands in articles or the main part, if
    there are any. Where all articles are inside furniture other than comments, they count."""
    shown = [n for b in blocks for n in b if n.text.strip() and all(k != TALK for _, k in n.outer + n.inner)]
    inside = [n for n in shown if n.article]
    counted = [n for n in inside or shown if all(k != HARD for _, k in n.outer + n.inner)]
    weight: dict[int, int] = {}
    for n in counted:
        for e, k in n.outer + n.inner:
            weight[e] = weight.get(e, 0) + len(n.text)
    whole = sum(len(n.text) for n in counted)
    wrapper = {e for e, w in weight.items() if 2 * w > whole}

    def kept(marks) -> bool:
        return all(e in wrapper for e, k in marks)

    if inside:
        free = any(kept(n.outer) and kept(n.inner) for n in inside)
        talk = {e for b in blocks for n in b for e, k in n.outer if k == TALK}
        return [[n for n in b if n.article and kept(n.inner) and (
            kept(n.outer) if free else talk.isdisjoint(e for e, _ in n.outer))] for b in blocks]
    return [[n for n in b if not n.article and kept(n.inner)] for b in blocks]


def _is_constant(block: list[Text], constant: frozenset) -> bool:
    head = _head(block)
    short = sum(len(n.text) for n in block) <= LONGEST_CONSTANT
    return (short or not head.article) and _block_key(block) in constant


def _matched(a: list[str], b: list[str]) -> bool:
    """Whether two trees are of one layout. Trees whose sizes or labels cannot agree in that
    many nodes are not matched."""
    least = LAYOUT_MATCH * (len(a) + len(b)) / 2
    return a == b or min(len(a), len(b)) >= least and len(match_trees(a, b)) >= least


def _leaders(trees: DataFrame) -> DataFrame:
    """``host, tree_id, leader`` for ``trees(host, part, n, tree_id, tree)``: by falling number of
    pages, each tree joins the first earlier leader of its host and part that it matches, or
    leads. A task holds the leaders only."""
    rows = (trees.select("host", "part", "tree_id", "tree", "n").repartition("host", "part")
            .sortWithinPartitions("host", "part", F.desc("n"), "tree_id"))

    def run(batches):
        at, leaders = None, []
        for b in batches:
            out = []
            for host, part, tree_id, tree in zip(*(c.to_pylist() for c in b.columns[:4])):
                if (host, part) != at:
                    at, leaders = (host, part), []
                paths = tree.split("\n")
                leader = next((k for k, other in leaders if _matched(paths, other)), None)
                if leader is None:
                    leaders.append((tree_id, paths))
                    leader = tree_id
                out.append((host, tree_id, leader))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))],
                names=["host", "tree_id", "leader"])

    return map_arrow(rows, run, "host string, tree_id long, leader long")


def layouts(trees: DataFrame) -> DataFrame:
    """``host, tree_id, layout``; a layout is named by its template's id. The trees of a host
    are dealt to tasks, then the layouts found there are compared with each other."""
    many = (trees.groupBy("host").agg(F.ceil(F.count("*") / TREES).alias("parts")).filter("parts > 1"))
    dealt = (trees.join(F.broadcast(many), "host", "left")
             .withColumn("part", F.pmod(F.xxhash64("tree_id"), F.coalesce("parts", F.lit(1)))))
    first = store(_leaders(dealt), "leaders")
    sizes = (trees.join(first, ["host", "tree_id"]).groupBy("host", "leader").agg(F.sum("n").alias("n"))
             .withColumnRenamed("leader", "tree_id"))
    last = _leaders(trees.drop("n").join(sizes, ["host", "tree_id"]).withColumn("part", F.lit(0)))
    last = last.select("host", F.col("tree_id").alias("leader"), F.col("leader").alias("layout"))
    out = store(first.join(last, ["host", "leader"]).select("host", "tree_id", "layout"), "layouts")
    unstore(first)
    return out


def templates(pages: DataFrame) -> DataFrame:
    """``host, constant`` (keys of constant texts) for hosts that have any, from
    ``pages(host, html)``. Pages of one layout with the same article text count once. A key has
    the path in it, so the layouts of a host share one list."""
    def nodes(batch: pa.RecordBatch) -> list:
        rows = [page_nodes(t) for t in texts(batch, "html")]
        trees = [r[0] for r in rows]
        return [pa.array(trees, pa.string()), pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in trees], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))]

    found = append_columns(pages, nodes, [
        T.StructField("tree", T.StringType()), T.StructField("tree_id", T.LongType()),
        T.StructField("article", T.LongType()),
        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType()))])
    found = store(found.drop("html"), "nodes")
    trees = store(found.filter("host IS NOT NULL").groupBy("host", "tree_id", "tree").agg(F.count("*").alias("n")), "trees")
    named = layouts(trees)
    heads = trees.select("host", F.col("tree_id").alias("layout"), F.col("tree").alias("template"))
    pairs = (trees.join(named, ["host", "tree_id"]).join(heads, ["host", "layout"])
             .select("host", "tree_id", "tree", "template", "layout"))

    def align(batches):
        known: dict[tuple[str, str], list[bool]] = {}
        for b in batches:
            flags = []
            for tree, template in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if (tree, template) not in known:
                    paths = tree.split("\n")
                    same = match_trees(paths, template.split("\n"))
                    known[tree, template] = [p in same for p in paths]
                flags.append(known[tree, template])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(flags, pa.list_(pa.bool_()))],
                                             names=["host", "tree_id", "layout", "aligned"])

    aligned = map_arrow(pairs, align, "host string, tree_id long, layout long, aligned array<boolean>")
    in_template = F.filter(F.arrays_zip("at", "keys"), lambda x: F.get("aligned", x["at"]))
    different = store(found.drop("tree").join(aligned, ["host", "tree_id"])
                      .select("host", "layout", "article", F.transform(in_template, lambda x: x["keys"]).alias("keys"))
                      .groupBy("host", "layout", "article").agg(F.max("keys").alias("keys")), "pages")
    sizes = (different.groupBy("host", "layout").agg(F.count("*").alias("pages"))
             .filter(F.col("pages") >= LEAST_PAGES))
    constant = (different.select("host", "layout", F.explode("keys").alias("key"))
                .groupBy("host", "layout", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
                .join(sizes, ["host", "layout"])
                .filter(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
                .groupBy("host").agg(F.collect_set("key").alias("constant")))
    out = store(constant, "templates")
    unstore(found, trees, named, different)
    return out


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``.

    A null or empty page has an empty text; a null url is a host of its own. A layout with
    one page has no template, its content is found by the slots' purpose alone. Character
    references are decoded, white space becomes one space, blocks are joined by one space;
    nothing is cut off. A column named ``text`` is replaced; repeated pages count as pages.
    """
    keep = [c for c in pages.columns if c.lower() != "text"]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], split_url(F.col(url))[0].alias("__host"))
    wrapper = templates(rows.select(F.col("__host").alias("host"), F.col(html).alias("html")))
    wrapper = wrapper.withColumnRenamed("host", "__known")
    if wrapper.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(wrapper), F.col("__host") == F.col("__known"), "left")
    else:
        salted = wrapper.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = (rows.withColumn("__at", F.pmod(F.xxhash64(url, html), F.lit(SALTS)))
                  .join(salted, (F.col("__at") == F.col("__salt")) & (F.col("__host") == F.col("__known")), "left")
                  .drop("__at", "__salt"))
    joined = joined.drop("__known", "__host")

    def run(batch: pa.RecordBatch) -> list:
        keys = batch.column(batch.schema.get_field_index("constant")).to_pylist()
        return [pa.array([main_text(t, frozenset(k or ())) for t, k in zip(texts(batch, html), keys)], pa.string())]

    return append_columns(joined, run, [T.StructField("text", T.StringType())]).select(*keep, "text")
