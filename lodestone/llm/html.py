"""Main text of pages by wrapper induction.

A page's DOM is reduced to a skeleton: one node for each kind (tag and classes) of child under a node. The distinct
skeletons of a host are aligned by simple tree matching into one wrapper, so that each text block of a page has a place
in it. Skeletons are aligned FORMS at a time, the commonest first, into partial wrappers, and these again, until a host
has one: no task aligns more than FORMS trees.

A text that most of the host's differing pages hold at one place is template, the others are varying slots. Pages vote by
their longest blocks, so near copies of one page have about one vote. The content is what lies under the wrapper's
outermost article and main nodes where it has any (but not articles that are constant as a whole beside varying ones);
elsewhere it is all varying text. Template blocks go in both; within an article only on hosts of SURE_PAGES differing
pages and more, at a share of SURE, and where they are less than half of the page's own article.
What varies though it is no content can't be told by alignment: menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts and styles are left out by tag, role and class at any place.

Blocks are the texts between block-level tags, white space collapsed, joined by one line feed.

Defined cases: a null or empty page has the empty text; a null or odd url is a host of its own; a host's single page (or
copies of one page) has no template; blocks nested more than 200 deep count by kind at the 200th; unclosed and stray tags are closed or skipped as browsers do.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released

DEEPEST = 200  # levels of a skeleton that are told apart
CONSTANT, PAGES, LOTS = 0.6, 3, 32  # share of pages and least number of pages of a template text; parts of a host's texts
SURE, SURE_PAGES = 0.8, 10  # the same within an article
FORMS = 64  # trees aligned by one task

# Elements by HTML's own kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp svg math template select object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
ASIDE_TAGS = frozenset("head nav footer aside form button menu dialog fieldset label".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted "
    "cookie cookies consent notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist reply replies discussion disqus respond feedback share sharing social related recommended recommendations "
    "footer masthead toolbar pagination pager widget skip".split()
)
HEAD_WORDS = frozenset("header banner topbar".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("kids", "kind", "place", "tag")

    def __init__(self, tag: str, kind: str):
        self.tag, self.kind, self.kids, self.place = tag, kind, {}, 0


def described(tag: str, raw: str) -> tuple[str, str]:
    """(kind, what it is: '' content, 'aside' left out, 'head' left out unless in an article, 'main' an article) of a start tag."""
    if not raw.strip(" /"):
        kind, words, role, held = tag, frozenset(), "", {}
    else:
        held = {}
        for m in ATTRIBUTE.finditer(raw):
            held.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        classes = f"{held.get('class', '')} {held.get('id', '')}"
        words = {w.lower() for w in WORD.findall(classes)}
        role = held.get("role", "").lower()
        kind = ".".join([tag, *sorted({w.lower() for w in WORD.findall(held.get("class", ""))})])
    hidden = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
    if tag in ("article", "main") or role in ("main", "article") or held.get("itemprop", "").lower() == "articlebody":
        return kind, "aside" if hidden or words & ASIDE_WORDS & {"comment", "comments", "reply", "replies", "related", "promo", "ad", "sponsored"} else "main"
    if tag in ("html", "body"):
        return kind, ""
    if hidden or tag in ASIDE_TAGS or role in ASIDE_ROLES or words & ASIDE_WORDS:
        return kind, "aside"
    if tag == "header" or words & HEAD_WORDS:
        return kind, "head"
    return kind, ""


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """(skeleton, text blocks in page order with their nodes); what is left out has no blocks."""
    root = Node("", "")
    # The open elements: tag, skeleton node, left out?, within an article?
    stack: list[tuple[str, Node, bool, bool]] = [("", root, False, False)]
    blocks: list[tuple[Node, str]] = []
    pending: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if pending:
            text = SPACES.sub(" ", entities.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                node = next(s[1] for s in reversed(stack) if s[0] in BLOCK or s[0] == "")
                blocks.append((node, text))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][0] in BLOCK:
                flush()
            stack.pop()

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            if not stack[-1][2]:
                pending.append(page[at:])
            break
        if m.start() > at and not stack[-1][2]:
            pending.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                pop_to(depth)
            continue
        raw = m[3] or m[6] or ""
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1][2]:
                pending.append(" ")
            continue
        if tag in RAW and not (tag == "svg" and raw.endswith("/")):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCK), 0)
            if depth and stack[depth][0] == "p":
                pop_to(depth)
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in FENCE[tag]:
                    break
                if stack[i][0] in CLOSES[tag]:
                    pop_to(i)
        _, parent, out, inside = stack[-1]
        kind, what = described(tag, raw)
        if tag in BLOCK:
            flush()
            if kind not in parent.kids:
                parent.kids[kind] = Node(tag, kind + ("!" if what == "main" else ""))
            node = parent.kids[kind]
        else:
            node = parent
        left = out or what == "aside" or (what == "head" and not inside)
        if left and not out:
            flush()
        stack.append((tag, node, left, inside or (what == "main" and not left)))
    pop_to(1)
    flush()
    return root, blocks


def shape(root: Node) -> list:
    """The skeleton as nested lists [kind, kids], its nodes numbered in that order. Nodes below DEEPEST share a place by kind under the last node above, those in an article with it."""
    count = 0

    def number(node: Node) -> int:
        nonlocal count
        node.place, count = count, count + 1
        return node.place

    def flat(top: Node) -> list:
        kinds: dict[str, int] = {}
        deep = [(k, False) for k in reversed(top.kids.values())]
        while deep:
            node, inside = deep.pop()
            inside |= node.kind.endswith("!")
            kind = node.kind if node.kind.endswith("!") or not inside else node.kind + "!"
            if kind in kinds:
                node.place = kinds[kind]
            else:
                kinds[kind] = number(node)
            deep += [(k, inside) for k in reversed(node.kids.values())]
        return [[kind, []] for kind in kinds]

    def walk(node: Node, depth: int) -> list:
        number(node)
        return [node.kind, [walk(k, depth + 1) for k in node.kids.values()] if depth < DEEPEST else flat(node)]

    return walk(root, 0)


class Wrapper:
    """The union of a host's skeletons; places are numbered as they come."""

    def __init__(self):
        self.kinds, self.parents, self.kids = [""], [-1], [[]]

    def add(self, kind: str, parent: int, after: int) -> int:
        self.kinds.append(kind)
        self.parents.append(parent)
        self.kids.append([])
        self.kids[parent].insert(after, len(self.kinds) - 1)
        return len(self.kinds) - 1

    def matching(self, place: int, tree: list, held: dict) -> int:
        """Nodes of the largest match of a subtree with a place: simple tree matching."""
        key = (place, id(tree))
        if key not in held:
            held[key] = 0 if self.kinds[place] != tree[0] else 1 + self.table(place, tree, held)[-1][-1]
        return held[key]

    def table(self, place: int, tree: list, held: dict) -> list[list[int]]:
        rows = [[0] * (len(tree[1]) + 1)]
        for own in self.kids[place]:
            row = [0]
            for j, other in enumerate(tree[1]):
                both = self.matching(own, other, held)
                row.append(max(row[-1], rows[-1][j + 1], rows[-1][j] + both if both else 0))
            rows.append(row)
        return rows

    def align(self, tree: list) -> list[int]:
        """The place of each node of a skeleton, in its order; nodes without a match become new places."""
        held: dict = {}
        places: dict[int, int] = {}

        def settle(place: int, node: list) -> None:
            places[id(node)] = place
            own, rows, pairs = list(self.kids[place]), self.table(place, node, held), {}
            i, j = len(own), len(node[1])
            while i and j:
                both = self.matching(own[i - 1], node[1][j - 1], held)
                if both and rows[i][j] == rows[i - 1][j - 1] + both:
                    pairs[j - 1] = own[i - 1]
                    i, j = i - 1, j - 1
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            after = 0
            for k, kid in enumerate(node[1]):
                if k not in pairs:
                    pairs[k] = self.add(kid[0], place, after)
                after = self.kids[place].index(pairs[k]) + 1
            for k, kid in enumerate(node[1]):
                settle(pairs[k], kid)

        settle(0, tree)
        out: list[int] = []

        def walk(node: list) -> None:
            out.append(places[id(node)])
            for kid in node[1]:
                walk(kid)

        walk(tree)
        return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or url or "").lower()
    except ValueError:
        return url or ""


def leading(texts: list[str], digests: list[int]) -> list[int]:
    """The digests of a page's longest differing blocks, three at most."""
    held = {d: len(t) for t, d in zip(texts, digests, strict=True)}
    return sorted(held, key=lambda d: (-held[d], d))[:3]


def parsed(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                root, blocks = parse(page or "")
                skeleton = json.dumps(shape(root), separators=(",", ":"))
                texts = [t for _, t in blocks]
                digest = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts]
                rows.append((host_of(url), skeleton, leading(texts, digest), [b.place for b, _ in blocks], texts, digest))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["page_id", "url", "host", "skeleton", "leads", "nodes", "texts", "digests"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = pages.select("page_id", "url", "html").mapInArrow(released(run), f"page_id {kind}, url string, host string, skeleton string, leads array<long>, nodes array<int>, texts array<string>, digests array<long>")
    return out.withColumn("form", F.xxhash64("skeleton"))


def nested(wrapper: Wrapper) -> tuple[list, list[int]]:
    """(the wrapper as a tree, the place of each of its nodes in that tree's order)."""
    order: list[int] = []

    def walk(place: int) -> list:
        order.append(place)
        return [wrapper.kinds[place], [walk(k) for k in wrapper.kids[place]]]

    return walk(0), order


def induced(trees: pd.DataFrame) -> pd.DataFrame:
    """One lot's trees, aligned: the places of each in the lot's wrapper, and the wrapper as a tree in the first row."""
    wrapper = Wrapper()
    rows = trees.sort_values(["pages", "form"], ascending=[False, True])
    maps = [wrapper.align(json.loads(s)) for s in rows["skeleton"]]
    tree, order = nested(wrapper)
    spot = [0] * len(order)
    for i, place in enumerate(order):
        spot[place] = i
    rest = [None] * (len(rows) - 1)
    return pd.DataFrame({"host": rows["host"], "lot": rows["lot"], "form": rows["form"], "places": [[spot[p] for p in m] for m in maps], "skeleton": [json.dumps(tree, separators=(",", ":")), *rest], "pages": [int(rows["pages"].sum()), *[0] * len(rest)]})


def wrapped(shapes: DataFrame, scratch: Scratch, forms: int) -> tuple[DataFrame, DataFrame]:
    """((host, form, places) of each form, (host, skeleton) of each host's wrapper), from (host, form, skeleton, pages)."""
    places, turn = None, 0
    while True:
        turn += 1
        size = scratch.table(shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / forms).alias("lots")), f"lots-{turn}")
        dealt = shapes.join(size, "host").withColumn("lot", F.pmod(F.xxhash64("form", "skeleton"), "lots")).select("host", "lot", "form", "skeleton", "pages")
        kind = "host string, lot long, form long, places array<int>, skeleton string, pages long"
        aligned = scratch.table(dealt.groupBy("host", "lot").applyInPandas(induced, kind), f"aligned-{turn}")
        own = aligned.select("host", "form", "lot", "places")
        if places is None:
            places = own
        else:  # a place in the partial wrapper becomes one in the wrapper of its lot
            up = own.select("host", F.col("form").alias("lot"), F.col("lot").alias("next"), F.col("places").alias("up"))
            places = places.join(up, ["host", "lot"]).select("host", "form", F.col("next").alias("lot"), F.expr("transform(places, p -> element_at(up, p + 1))").alias("places"))
            places = scratch.table(places, f"places-{turn}")
        shapes = aligned.where("skeleton is not null").select("host", F.col("lot").alias("form"), "skeleton", "pages")
        if not size.where("lots > 1").limit(1).count():
            return places.select("host", "form", "places"), shapes.select("host", "skeleton")


def unnested(skeleton: str) -> tuple[list[str], list[int]]:
    """(kinds, parents) of a tree's nodes, in its order."""
    kinds, parents, deep = [], [], [(json.loads(skeleton), -1)]
    while deep:
        (kind, kids), parent = deep.pop()
        kinds.append(kind)
        parents.append(parent)
        deep += [(k, len(kinds) - 1) for k in reversed(kids)]
    return kinds, parents


def slot(kinds: list[str], parents: list[int], mass: dict[int, int]) -> tuple[list[int], bool]:
    """(places of the content, is it the articles'?) from the varying text at each place: all under the outermost article and main places, less those without any where others have some; every place of a host without them."""
    kids: dict[int, list[int]] = {}
    for place, parent in enumerate(parents):
        kids.setdefault(parent, []).append(place)

    def below(top: int, stop: bool) -> list[int]:
        held, deep = [], [top]
        while deep:
            place = deep.pop()
            held.append(place)
            if not (stop and kinds[place].endswith("!")):
                deep += kids.get(place, [])
        return held

    mains = [below(p, False) for p in below(0, True) if kinds[p].endswith("!")]
    varying = [m for m in mains if any(mass.get(p, 0) for p in m)]
    return ([p for m in varying or mains for p in m], True) if mains else (below(0, False), False)


def votes(held: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, place, digest, size, pages, of): how many of a host's differing pages hold each text at each place.

    Pages are told apart by their longest block, or on hosts where that one varies less by the second longest; a block's own
    votes are told apart by the other one of them.
    """
    longest, second = F.get("leads", F.lit(0)), F.get("leads", F.lit(1))
    differing = held.groupBy("host").agg(F.count_distinct(longest).alias("a"), F.count_distinct(second).alias("b"))
    differing = scratch.table(differing.select("host", F.greatest("a", "b").alias("of"), (F.col("b") > F.col("a")).alias("turned")), "differing")
    blocks = held.join(places, ["host", "form"]).join(differing.select("host", "turned"), "host")
    blocks = blocks.select("host", F.when(F.col("turned"), second).otherwise(longest).alias("lead"), F.when(F.col("turned"), longest).otherwise(second).alias("other"), "places", F.explode(F.arrays_zip("nodes", "digests", F.transform("texts", F.length).alias("sizes"))).alias("b"))
    voter = F.coalesce(F.when(F.col("lead") != F.col("b.digests"), F.col("lead")), F.col("other"))
    blocks = blocks.select("host", F.element_at("places", F.col("b.nodes") + 1).alias("place"), F.col("b.digests").alias("digest"), F.col("b.sizes").alias("size"), voter.alias("voter"))
    seen = blocks.groupBy("host", "place", "digest").agg(F.count_distinct("voter").alias("pages"), F.first("size").alias("size"))
    # A host may hold a third of all pages: its texts are dealt out by digest, and summed up again in part before they meet.
    seen = seen.withColumn("lot", F.pmod("digest", F.lit(LOTS)))
    lots = differing.select("host", "of").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOTS - 1).cast("long"))))
    return seen.join(lots, ["host", "lot"])


def extract(pages: DataFrame, forms: int = FORMS) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    held = scratch.table(parsed(pages), "parsed")
    shapes = held.groupBy("host", "form").agg(F.first("skeleton").alias("skeleton"), F.count(F.lit(1)).alias("pages"))
    places, wrappers = wrapped(shapes, scratch, forms)
    seen = votes(held, places, scratch).withColumn("fixed", (F.col("of") >= PAGES) & (F.col("pages") >= CONSTANT * F.col("of")))
    by_place = seen.groupBy("host", "place").agg(
        F.sum(F.when(~F.col("fixed"), F.col("size") * F.col("pages")).otherwise(0)).alias("mass"),
        F.collect_list(F.when(F.col("fixed"), F.struct("digest", ((F.col("of") >= SURE_PAGES) & (F.col("pages") >= SURE * F.col("of"))).alias("sure")))).alias("fixed"),
    )
    # One row a host: a mass for each place, and its template texts, no more than CONSTANT allows for: a page's blocks / CONSTANT.
    by_host = by_place.groupBy("host").agg(F.collect_list(F.struct("place", "mass")).alias("masses"), F.flatten(F.collect_list(F.transform("fixed", lambda f: F.struct("place", f["digest"].alias("digest"), f["sure"].alias("sure"))))).alias("fixed"))
    hosts = scratch.table(wrappers.join(by_host, "host"), "hosts")

    def slots(batches):
        for batch in batches:
            found = [slot(*unnested(k), {m["place"]: m["mass"] for m in ms}) for k, ms in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.bool_()), batch.column(3)], ["host", "slot", "semantic", "fixed"])

    kinds = "host string, slot array<int>, semantic boolean, fixed array<struct<place:int,digest:bigint,sure:boolean>>"
    chosen = scratch.table(hosts.select("host", "skeleton", "masses", "fixed").mapInArrow(slots, kinds), "slots")

    def run(batches):
        for batch in batches:
            rows = []
            for nodes, texts, digests, places, inside, semantic, fixed in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                template = {(f["place"], f["digest"]): f["sure"] for f in fixed or []}
                rows.append("\n".join(content(texts, [(places[i], d) for i, d in zip(nodes, digests, strict=True)], set(inside or []), bool(semantic), template)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = held.select("page_id", "url", "host", "form", "nodes", "texts", "digests").join(places, ["host", "form"]).join(chosen, "host", "left")
    out = joined.select("page_id", "url", "nodes", "texts", "digests", "places", "slot", "semantic", "fixed").mapInArrow(released(run), f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def content(texts: list[str], spots: list[tuple[int, int]], inside: set[int], semantic: bool, template: dict[tuple[int, int], bool]) -> list[str]:
    """The blocks of a page, at (place, digest) spots, that are content: in the slots and not template."""
    varying = [t for t, s in zip(texts, spots, strict=True) if s not in template]
    own = [(t, s) for t, s in zip(texts, spots, strict=True) if s[0] in inside]
    if semantic:
        rest = [t for t, s in own if not template.get(s)]
        kept = rest if 2 * sum(map(len, rest)) > sum(len(t) for t, _ in own) else [t for t, _ in own]
    else:
        kept = [t for t, s in own if s not in template]
    return kept or varying  # a page of another form than its host's
