"""HTML extraction by wrapper induction.

Pages become trees of block elements.  A page's *shape* is its tree without
texts, in which sibling blocks of equal shape are one repeated node; a host has
few shapes, however many pages.  Simple tree matching aligns a host's shapes into
one wrapper tree, whose nodes are slots.  Texts are counted per slot over a
host's distinct pages: a slot that reads the same everywhere, or a text that
nearly every page has in the same slot, is template; what varies is content,
unless its place (menus, footers, adverts, forms, comments) or its links say
that it is not.

Hosts of any size: shapes are deduplicated before they meet, wrappers are merged
in a tree of bounded groups, texts travel as hashes with partial counts.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# HTML's element classes, as parsers know them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math select button canvas object audio video".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
 form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody
 td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
# start tag -> elements that it ends, and those it does not look beyond
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}

# Places that hold no article text: by element, by role, by words of class and id.
PLACES = frozenset("nav footer aside form head dialog menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form toolbar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies
 consent disqus footer masthead menu nav navbar navigation newsletter notice notices pager pagination popup modal promo promoted promotion
 related respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget topbar""".split())
MAIN = ("article", "main")        # elements that hold the article, best first
MAIN_NAMES = frozenset("articlebody entry-content post-content article-body article-content post-body story-body".split())

DEPTH = 200            # elements nested deeper stand beside their ancestor at this depth
SHAPES = 32            # unequal shapes under one parent and name before they count as one repeated node
FOLD = 64              # wrappers that one merge takes, about
TEMPLATE_SHARE = 0.9   # of a host's distinct pages that must share a text for it to be template
TEMPLATE_PAGES = 8     # and their least number
FEW_TEXTS = 0.1        # texts per page under which a slot with a single text a page is template
LINK_SHARE = 0.5       # of a slot's or block's characters inside links, above which it is a menu

TOKEN = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))"                                   # comments
    r"|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)"
    r"|[!?/][^>]*+(?:>|\Z))", re.S)                                         # declarations and other non-elements
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WORDS = re.compile(r"[a-z]+")


@lru_cache(4096)
def _end_of(name: str):
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I)


class Node:
    __slots__ = ("tag", "hint", "kids", "up", "depth", "texts")

    def __init__(self, tag, hint, up):
        self.tag, self.hint, self.up = tag, hint, up
        self.kids, self.texts = [], []
        self.depth = up.depth + 1 if up else 0


def _hint(rest: str) -> str:
    """What a block's class, id, role and item property say, as sorted words."""
    if not rest or rest.isspace():
        return ""
    words = set()
    for m in ATTRIBUTE.finditer(rest):
        name = m[1].lower()
        if name in ("class", "id", "role", "itemprop", "hidden", "aria-hidden"):
            value = (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                words.add("=hidden")
            elif name == "role":
                words.update(f"={w}" for w in value.split())
            elif name in ("class", "itemprop"):
                words.update(w for w in value.split() if not any(c.isdigit() for c in w))
            elif not any(c.isdigit() for c in value):
                words.add(value)
    return " ".join(sorted(words))


def parse(page: str) -> Node:
    """The block tree of a page.  Inline elements are part of their block's text,
    but link text is kept apart; what no reader sees is left out."""
    root = here = Node("#", "", None)
    run, in_link, link = [], 0, 0      # the text so far, of the current block

    def flush():
        nonlocal run, link
        if run:
            text = " ".join("".join(run).split())
            run = []
            if text:
                here.texts.append((len(here.kids), text, min(link, len(text))))
        link = 0

    def close_to(node):
        nonlocal here, in_link
        flush()
        here, in_link = node, 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            said = page[at:lt]
            run.append(entities.unescape(said) if "&" in said else said)
            if in_link:
                link += lt - at
        if lt == n:
            break
        m = TOKEN.match(page, lt)
        if m is None:
            run.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCK:
                up = here
                while up.up is not None and up.tag != name:
                    up = up.up
                if up.tag == name:
                    close_to(up.up)
                elif name == "p":
                    flush()
            continue
        if name in RAW:
            done = _end_of(name).search(page, at)
            at = done.end() if done else n
            run.append(" ")
        elif name in BLOCK:
            if name in CLOSES_P:
                up = here
                while up.up is not None and up.tag != "p" and up.tag not in ("td", "th", "caption", "table", "button"):
                    up = up.up
                if up.tag == "p":
                    close_to(up.up)
            if name in ENDS:
                over, stop = ENDS[name]
                up, last = here, None
                while up.up is not None and up.tag not in stop:
                    if up.tag in over:
                        last = up
                    up = up.up
                if last is not None:
                    close_to(last.up)
            flush()
            if name not in VOID:
                up = here if here.depth < DEPTH else here.up
                here = Node(name, _hint(m["rest"]), up)
                up.kids.append(here)
            in_link = 0
        elif name == "br" or name in VOID:
            run.append(" ")
        elif name == "a":
            in_link += 1
    flush()
    return root


# A shape is (tag, hint, child shapes): a nested tuple.

def shapes_of(root: Node):
    """(number of every node's shape, by id; the distinct shapes).  Of a node's
    children, equal shapes count once, in the order in which they first come."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.kids)
    known: dict[tuple, int] = {}
    table, number = [], {}
    for node in reversed(order):
        kids, seen = {}, {}
        for k in node.kids:
            s = number[id(k)]
            if s not in kids:
                label = table[s][:2]
                if seen.get(label, 0) < SHAPES:
                    seen[label] = seen.get(label, 0) + 1
                    kids[s] = None
        form = (node.tag, node.hint, tuple(kids))
        if form not in known:
            known[form] = len(table)
            table.append(form)
        number[id(node)] = known[form]
    return number, table


def preorder(shape) -> list:
    """(shape node, parent number) of a shape in preorder."""
    out, todo = [], [(shape, -1)]
    while todo:
        s, up = todo.pop()
        at = len(out)
        out.append((s, up))
        todo.extend((k, at) for k in reversed(s[2]))
    return out


def _size(shape, sizes) -> int:
    n = sizes.get(shape)
    if n is None:
        n = sizes[shape] = 1 + sum(_size(k, sizes) for k in shape[2])
    return n


def matching(a, b, memo) -> tuple[int, tuple]:
    """Simple tree matching: the largest number of nodes that an order-keeping
    mapping of two trees with equal roots pairs, and the pairs of children."""
    if a[:2] != b[:2]:
        return 0, ()
    known = memo.get((a, b))
    if known is not None:
        return known
    if a == b:
        result = (_size(a, memo.setdefault("sizes", {})), tuple((i, i) for i in range(len(a[2]))))
    else:
        ka, kb = a[2], b[2]
        w = [[matching(x, y, memo)[0] for y in kb] for x in ka]
        m = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
        for i in range(1, len(ka) + 1):
            for j in range(1, len(kb) + 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w[i - 1][j - 1])
        pairs, i, j = [], len(ka), len(kb)
        while i and j:
            if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
        result = (m[-1][-1] + 1, tuple(reversed(pairs)))
    memo[(a, b)] = result
    return result


def merged(a, b, memo):
    """The wrapper of two wrappers: aligned nodes are one, the others stand where
    their neighbours do."""
    if a == b:
        return a
    _, pairs = matching(a, b, memo)
    kids, i, j = [], 0, 0
    for x, y in (*pairs, (len(a[2]), len(b[2]))):
        kids.extend(a[2][i:x])
        kids.extend(k for k in b[2][j:y])
        if x < len(a[2]):
            kids.append(merged(a[2][x], b[2][y], memo))
        i, j = x + 1, y + 1
    return a[0], a[1], tuple(kids)


def aligned(wrapper, shape) -> list[int]:
    """The slot (preorder number in the wrapper) of every node of a shape, in
    preorder; -1 where the wrapper has none."""
    numbers, memo = {}, {}
    flat = preorder(wrapper)
    starts: dict[int, list[int]] = {}
    for at, (_, up) in enumerate(flat):
        starts.setdefault(up, []).append(at)
    out, todo = [], [(shape, 0 if wrapper[:2] == shape[:2] else -1)]
    while todo:
        s, slot = todo.pop()
        out.append(slot)
        to = {}
        if slot >= 0:
            kids = starts.get(slot, [])
            to = {y: kids[x] for x, y in matching(flat[slot][0], s, memo)[1]}
        todo.extend((k, to.get(y, -1)) for y, k in reversed(list(enumerate(s[2]))))
    return out


def dumps(shape) -> str:
    """A shape as text: a bracket expression, read back by ``loads``."""
    parts, todo = [], [shape]
    while todo:
        s = todo.pop()
        if isinstance(s, str):
            parts.append(s)
            continue
        parts.append(f"({json.dumps(s[0] + ' ' + s[1])}")
        todo.append(")")
        todo.extend(reversed(s[2]))
    return "".join(parts)


def loads(text: str):
    at, stack, read = 0, [], json.JSONDecoder()
    while True:
        if text[at] == "(":
            label, at = read.raw_decode(text, at + 1)
            tag, _, hint = label.partition(" ")
            stack.append((tag, hint, []))
        else:
            tag, hint, kids = stack.pop()
            node = (tag, hint, tuple(kids))
            at += 1
            if not stack:
                return node
            stack[-1][2].append(node)


def outside(tag: str, hint: str) -> bool:
    """Does a block's element or naming say that no article text is in it?"""
    if tag in PLACES:
        return True
    for w in hint.split():
        if w.startswith("="):
            if w[1:] in ROLES or w == "=hidden":
                return True
        elif NAMES.intersection(WORDS.findall(w)) and w not in MAIN_NAMES:
            return True
    return False


def places(shape) -> list[int]:
    """How well each node of a shape (in preorder) lies for content: 0 not at
    all, 1 anywhere in the page, 2 inside main, 3 inside an article.  A place
    that holds all the page's articles is none of the outside ones, whatever its name."""
    flat = preorder(shape)
    sizes = [1] * len(flat)
    for at in range(len(flat) - 1, 0, -1):
        sizes[flat[at][1]] += sizes[at]
    tags = [s[0] for s, _ in flat]
    anchor = next((t for t in ("article", "main", "h1") if t in tags), None)
    marks = np.concatenate([[0], np.cumsum([t == anchor for t in tags])])

    def holds_all(at):
        return anchor is not None and marks[at + sizes[at]] - marks[at] == marks[-1] and (
            anchor != "h1" or tags[at] in ("html", "body", "form", "div", "section"))

    out = []
    for at, ((tag, hint, _), up) in enumerate(flat):
        best = out[up] if up >= 0 else 1
        words = hint.split()
        named = best < 3 and any("header" in WORDS.findall(w) for w in words)
        if best and up >= 0 and not (tag not in MAIN and holds_all(at)) and (
                outside(tag, hint) or tag == "header" and best < 2 or named):
            best = 0
        elif best:
            if tag == "article" or MAIN_NAMES.intersection(words):
                best = 3
            elif tag == "main" or "=main" in words:
                best = max(best, 2)
        out.append(best)
    return out


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def page_blocks(page: str):
    """(shape, blocks): a page's texts in order, each with its node in the shape
    (by preorder) and its number of characters inside links."""
    root = parse(page)
    number, table = shapes_of(root)
    built = []
    for tag, hint, kids in table:       # children come before their parents
        built.append((tag, hint, tuple(built[k] for k in kids)))
    # the places of the shape's nodes: for each, where its children's shapes stand
    below: list[dict] = []
    todo = [(number[id(root)], None)]
    while todo:
        s, slot = todo.pop()
        if slot is not None:
            slot[s] = len(below)
        mine: dict = {}
        below.append(mine)
        todo.extend((k, mine) for k in reversed(table[s][2]))
    blocks, stack = [], [(root, 0, 0, 0)]
    while stack:
        node, at, k, t = stack.pop()
        while t < len(node.texts) and node.texts[t][0] == k:
            blocks.append((at, node.texts[t][1], node.texts[t][2]))
            t += 1
        if k < len(node.kids):
            stack.append((node, at, k + 1, t))
            kid, mine = node.kids[k], below[at]
            s = number[id(kid)]
            to = mine.get(s)
            if to is None:      # past SHAPES, or below such a block: as the first of its name, else as its parent
                to = next((v for x, v in mine.items() if table[x][:2] == table[s][:2]), at)
            stack.append((kid, to, 0, 0))
    return built[number[id(root)]], blocks


def parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, url, host, shape_id, shape, page, blocks): every page read once; the
    whole text is kept, by block.  ``page`` is a hash of all texts, ``mark`` one of
    a block's; ``again`` says that the node had the text before."""
    import pyarrow as pa
    src = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), host_of(F.col(f"`{url}`")).alias("host"),
                       F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    from pyspark.sql.pandas.types import to_arrow_type
    head = [pa.field(c, to_arrow_type(src.schema[c].dataType)) for c in ("key", "url", "host")]
    block = pa.struct([pa.field("node", pa.int32()), pa.field("text", pa.string()), pa.field("link", pa.int32()),
                       pa.field("mark", pa.int64()), pa.field("again", pa.bool_())])
    schema = pa.schema([*head, pa.field("shape_id", pa.int64()), pa.field("shape", pa.string()), pa.field("page", pa.int64()),
                        pa.field("blocks", pa.list_(block))])

    def short_hash(texts):
        h = hashlib.blake2b(digest_size=8)
        for t in texts:
            h.update(t.encode("utf-8", "surrogatepass") + b"\0")
        return int.from_bytes(h.digest(), "big", signed=True)

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, shapes, wholes, ends, nodes, texts, links, marks, again = [], [], [], [0], [], [], [], [], []
                for page in part.column(3).to_pylist():
                    shape, blocks = page_blocks(page)
                    text = dumps(shape)
                    shapes.append(text)
                    ids.append(short_hash([text]))
                    wholes.append(short_hash(t for _, t, _ in blocks))
                    seen = set()
                    for node, said, link in blocks:
                        mark = short_hash([said])
                        nodes.append(node)
                        texts.append(said)
                        links.append(link)
                        marks.append(mark)
                        again.append((node, mark) in seen)
                        seen.add((node, mark))
                    ends.append(len(nodes))
                items = pa.StructArray.from_arrays(
                    [pa.array(nodes, pa.int32()), pa.array(texts, pa.string()), pa.array(links, pa.int32()),
                     pa.array(marks, pa.int64()), pa.array(again, pa.bool_())], fields=list(block))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).cast(head[i].type) for i in range(3)], pa.array(ids, pa.int64()), pa.array(shapes, pa.string()),
                     pa.array(wholes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], schema=schema)

    out = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in ("key", "url", "host"))
    return src.mapInArrow(read, f"{out}, shape_id long, shape string, page long, blocks array<struct<node:int,text:string,link:int,mark:bigint,again:boolean>>")


def wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) from distinct (host, shape): wrappers are merged about
    ``FOLD`` at a time, level by level, until every host has one.  The driver
    sees one number per level."""
    n = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    now = shapes.select("host", F.col("shape").alias("wrapper")).withColumn("h", F.xxhash64("wrapper")).join(n, "host")

    def merge(pdf):
        memo: dict = {}
        trees = [loads(t) for t in sorted(pdf["wrapper"])]
        whole = trees[0]
        for t in trees[1:]:
            whole = merged(whole, t, memo)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [dumps(whole)], "h": [int(pdf["part"].iloc[0])], "n": [int(pdf["parts"].iloc[0])]})

    while True:
        parts = now.withColumn("parts", F.ceil(F.col("n") / FOLD)).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")))
        now = materialize(parts.select("host", "wrapper", "parts", "part").groupBy("host", "part").applyInPandas(
            merge, "host string, wrapper string, h long, n long"), "wrappers")
        if (now.agg(F.max("n")).first()[0] or 0) <= 1:
            return now.select("host", "wrapper")


def slots(shapes: DataFrame, wraps: DataFrame) -> DataFrame:
    """(host, shape_id, slots, places): every shape aligned to its host's wrapper;
    both arrays have an element per node of the shape."""
    def align(batches):
        for pdf in batches:
            rows = []
            for host, sid, shape, wrapper in zip(pdf["host"], pdf["shape_id"], pdf["shape"], pdf["wrapper"]):
                tree = loads(shape)
                rows.append((host, sid, aligned(loads(wrapper), tree), places(tree)))
            yield pd.DataFrame(rows, columns=["host", "shape_id", "slots", "places"])

    return shapes.join(wraps, "host").select("host", "shape_id", "shape", "wrapper").mapInPandas(
        align, "host string, shape_id long, slots array<int>, places array<int>")


def verdicts(pages: DataFrame, at: DataFrame) -> DataFrame:
    """(host, shape_id, place, nodes, template): the best place in which a shape
    has content, its nodes there, and hashes of (node, text) that are template
    all the same.

    A host's equal pages count once.  What is shuffled per page is its blocks'
    hashes, once by page and once by text."""
    marks = F.transform(F.filter("blocks", lambda b: ~b["again"]), lambda b: F.struct(
        b["node"].alias("node"), b["mark"].alias("mark"), b["link"].alias("link"), F.length(b["text"]).alias("chars")))
    once = pages.select("host", "shape_id", "page", marks.alias("marks")).groupBy("host", "shape_id", "page").agg(F.first("marks").alias("marks"))
    once = materialize(once.join(at, ["host", "shape_id"]).select("host", "shape_id", "places", "slots", "marks"), "page-marks", "zstd")
    slot_of = lambda m: F.get("slots", m["node"])
    said = once.select("host", F.explode(F.transform("marks", lambda m: F.struct(
        slot_of(m).alias("slot"), m["mark"].alias("mark"), m["link"].alias("link"), m["chars"].alias("chars")))).alias("m")).select("host", "m.*")
    having = once.select("host", F.explode(F.array_distinct(F.transform("marks", slot_of))).alias("slot"))
    by = ["host", "slot"]
    stats = said.groupBy(*by).agg(F.count(F.lit(1)).alias("uses"), F.sum("link").alias("link"), F.sum("chars").alias("chars"))
    stats = stats.join(having.groupBy(*by).agg(F.count(F.lit(1)).alias("pages")), by).where("slot >= 0")
    texts = said.groupBy("host", "slot", "mark").agg(F.count(F.lit(1)).alias("n"))
    texts = materialize(texts.where(f"n >= {TEMPLATE_PAGES * TEMPLATE_SHARE}").unionByName(
        # of texts that cannot be template by themselves, only their number matters
        texts.where(f"n < {TEMPLATE_PAGES * TEMPLATE_SHARE}").groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n")).select(
            "host", "slot", F.lit(None).cast("long").alias("mark"), "n")), "page-texts")
    stats = stats.join(texts.groupBy(*by).agg(F.sum(F.when(F.col("mark").isNull(), F.col("n")).otherwise(1)).alias("n_texts")), by)
    enough = F.col("pages") >= TEMPLATE_PAGES
    stats = materialize(stats.select(
        "host", "slot", "pages", (F.col("link") > LINK_SHARE * F.col("chars")).alias("links"),
        (enough & (F.col("uses") <= 1.5 * F.col("pages")) & (F.col("n_texts") <= FEW_TEXTS * F.col("pages"))).alias("few")), "page-stats")
    common = texts.where("mark is not null").join(stats, by).where(enough & (F.col("n") >= TEMPLATE_SHARE * F.col("pages")))
    used = once.select("host", "shape_id", F.explode(F.array_distinct(F.transform("marks", lambda m: m["node"]))).alias("node")).distinct()
    nodes = used.join(at, ["host", "shape_id"]).select(
        "host", "shape_id", "node", F.get("slots", "node").alias("slot"), F.get("places", "node").alias("place"))
    # inside an article neither links nor few texts speak against a slot
    open_ = nodes.where("place > 0").join(stats, by, "left").where("place = 3 or not (coalesce(links, false) or coalesce(few, false))")
    best = open_.groupBy("host", "shape_id").agg(F.max("place").alias("best"), F.collect_list(F.struct("place", "node")).alias("all"))
    chosen = best.select("host", "shape_id", F.col("best").alias("place"), F.expr("transform(filter(all, x -> x.place = best), x -> x.node)").alias("nodes"))
    fixed = nodes.join(common.select("host", "slot", "mark"), by).groupBy("host", "shape_id").agg(
        F.collect_list(F.xxhash64("node", "mark")).alias("template"))
    return chosen.join(fixed, ["host", "shape_id"], "left")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url``, ``text``: the blocks of the article,
    white space as one blank, joined by an empty line.

    Null html is an empty page and has an empty text; pages without an address
    share the host ``""``; repeated rows get a row each.  Pages of a host with
    fewer than ``TEMPLATE_PAGES`` distinct pages are judged by their places alone.
    Other columns play no part."""
    read = materialize(parsed(pages, key, url, html), "page-blocks", "zstd")
    shapes = materialize(read.groupBy("host", "shape_id").agg(F.min("shape").alias("shape")), "page-shapes")
    at = materialize(slots(shapes, wrappers(shapes)), "page-slots")
    judged = materialize(verdicts(read, at), "page-verdicts")
    out = read.join(judged, ["host", "shape_id"], "left")
    # outside an article a block that is mostly links is a menu, whatever its slot
    kept = F.filter("blocks", lambda b: F.array_contains("nodes", b["node"]) & (
        (F.col("place") == 3) | (b["link"] <= LINK_SHARE * F.length(b["text"]))) & ~F.coalesce(
        F.array_contains("template", F.xxhash64(b["node"], b["mark"])), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return out.select("key", "url", F.coalesce(text, F.lit("")).alias("text"))
