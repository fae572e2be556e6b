"""Main text by wrapper induction over the pages of a host.

A few pages of a host, merged by partial tree alignment, lend their block structure as
the seed. Every page of the host is aligned to the seed by simple tree matching (runs of like siblings count as one
repeating node), and Spark counts over all distinct pages how often each text stands
in each seed node, and how much of a node's text is links or stands under a boilerplate
name. Texts that most pages share are template; of the varying slots those are content
that the host's pages do not show to be a menu, notice, advert, form or comment thread.
Where <article> and <main> hold most of a host's text, less link text makes a menu
outside them, and small slots there are its rim, which goes too. A page is cut by its wrapper; its own markup decides only on elements that
the wrapper lacks, and on hidden ones.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import materialize, row_id, small_side

#: A text is template when so many pages of the host have it in the same node; pages
#: of equal html count as one.
MIN_PAGES, MIN_SHARE = 5, 0.6
#: A slot whose text is links to this share, over all pages of the host, is a menu.
LINK_SHARE = 0.6
#: The same for slots that lie outside <article> and <main> on a host that has over
#: half of its text in them.
OUTSIDE_LINK_SHARE = 0.3
#: On such a host a slot outside them that has less than this share of the host's text and
#: no headings is its rim: adverts, notices and teasers, whatever their names and texts.
RIM_SHARE = 0.1
#: A node is boilerplate by its name if so much of its text on the host stands there.
NAMED_SHARE = 0.5
#: Elements nested deeper become siblings, as in browsers (whose limit is 512).
MAX_DEPTH = 200
#: Pages of a host that its seed is merged from, and nodes beyond which it is not grown.
SEED_PAGES, SEED_NODES = 8, 5000
#: Beyond this many pairs of children, siblings align in halves, in linear space.
DP_CELLS = 250_000

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: skipped up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes svg math".split())
DROPPED = frozenset("head nav aside footer form menu dialog noscript template select button canvas object video audio fieldset".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Containers whose label says nothing.
BARE = frozenset("div section td center".split())
SCOPE = frozenset("ul ol dl table article section div body html blockquote main".split())


def _words(names: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{names})(?=$|[\s_-])")


#: Words of classes and ids that name boilerplate.
BOILER = _words(
    r"ads?|adverts?|advertisements?|adslot|sponsor(?:ed|s)?|promo|nav(?:bar|igation)?|breadcrumbs?|masthead|(?:site|page|global|top)[_-]?header|footer|sidebar|cookies?|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|commentlist|disqus|pagination|pager|toolbar|skip(?:link)?|hidden|visually-hidden"
)
#: Words that also stand for content: a node of these, and one inside the content
#: whose id has any of all these words, is dropped only if the host's pages agree.
SUSPECT = _words(
    r"banner|menu|foot|side|widgets?|related|recommend(?:ed|ations?)?|shar(?:e|ing)|social|consent|notices?|alerts?|subscription|respond|responses?|repl(?:y|ies)|discussion|search|copyright|legal|disclaimer|promotion"
)
#: They agree if so much of its text is template or links.
AGREED_SHARE = 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = re.compile(r"(?:^|\s)(?:navigation|banner|contentinfo|complementary|search|form|alert|alertdialog|dialog|menu|menubar|toolbar)(?=$|\s)")
ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)


class Node:
    """A block element; a leaf holds the text of one block and is labelled '#'.

    ``hidden`` elements never show, ``named`` ones have the tag or name of boilerplate,
    ``suspect`` ones a name that may mean that. ``inside`` an <article> or <main>, or
    ``dead`` (hidden or named), are passed on to all that an element holds."""

    __slots__ = ("children", "dead", "hidden", "inside", "label", "links", "named", "seed", "suspect", "tag", "text")

    def __init__(self, tag: str, label: str, parent: Node | None = None, hidden: bool = False, named: bool = False, suspect: bool = False, text: str = "", links: int = 0):
        self.tag, self.label, self.hidden, self.named, self.suspect, self.text, self.links = tag, label, hidden, named, suspect, text, links
        self.children: list[Node] = []
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.dead = hidden or named or parent is not None and parent.dead
        self.seed: int | None = None

    @property
    def marked(self) -> bool:
        return self.inside and not self.dead


def _attributes(tag: str, rest: str, inside: bool = False) -> tuple[str, bool, bool, bool]:
    """The class and id words of a start tag, whether the element is hidden, whether its
    name or role says boilerplate, and whether its name may.
    ``inside``: the element is part of the content."""
    classes, ids, role, hidden = "", "", "", False
    for m in ATTR.finditer(rest):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "class":
            classes += " " + value
        elif name == "id":
            ids += " " + value
        elif name == "role":
            role += " " + value
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        else:
            hidden |= value != "false" and (name == "hidden" or value == "true")
    words = classes + ids
    named = tag not in ("html", "body", "article", "main") or "comment" in words
    sure = classes if inside or tag in HEADINGS else words
    bad = named and bool(BOILER.search(sure) or ROLES.search(role))
    doubt = classes if tag in HEADINGS else words
    return " ".join(sorted(words.split())), hidden, bad, named and not bad and bool(SUSPECT.search(doubt) or BOILER.search(doubt))


def parse(html: str | None) -> Node:
    """The tree of block elements with their text. Any input gives a tree."""
    root = Node("#root", "#root")
    stack, text, links, in_link, muted = [root], [], 0, 0, []
    opened: Counter[str] = Counter()
    src = html or ""

    def flush() -> None:
        nonlocal links
        if text:
            words = " ".join("".join(text).split())
            if words:
                leaf = Node("#", "#", stack[-1], text=words, links=min(links, len(words)))
                hold(leaf)
            text.clear()
        links = 0

    def hold(node: Node) -> None:
        """Hang a node under the innermost open element, but not deeper than MAX_DEPTH;
        beyond that it takes over what its element is."""
        if len(stack) > MAX_DEPTH:
            node.hidden, node.named = node.hidden or stack[-1].hidden, node.named or stack[-1].named
        stack[min(len(stack), MAX_DEPTH) - 1].children.append(node)

    def close_to(depth: int) -> None:
        nonlocal in_link
        flush()
        for x in stack[depth:]:
            opened[x.tag] -= 1
        del stack[depth:]
        in_link = 0
        muted.clear()

    at, size = 0, len(src)
    while at < size:
        lt = src.find("<", at)
        if lt != at:
            piece = src[at : lt if lt >= 0 else size]
            if not muted:
                piece = htmllib.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if in_link:
                    links += len(piece.strip())
            if lt < 0:
                break
        m = TAG.match(src, lt)
        if m is None:  # a bare '<' is text; a tag cut off by the end is dropped
            if re.match(r"</?[a-zA-Z]", src[lt : lt + 3]):
                gt = src.find(">", lt)
                at = gt + 1 if gt >= 0 else size
            else:
                if not muted:
                    text.append("<")
                at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK or tag in DROPPED:
                for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[depth].tag == tag:
                        close_to(depth)
                        break
                    if tag == "p" and stack[depth].tag in SCOPE:
                        break
            elif muted and muted[-1] == tag:
                muted.pop()
            elif tag == "a":
                in_link = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(src, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag not in BLOCK and tag not in DROPPED:
            if muted:
                if tag == muted[-1]:
                    muted.append(tag)
            elif "=" in m[3] and any(_attributes(tag, m[3], True)[1:3]):
                muted.append(tag)
            elif tag == "a":
                in_link = 1
            continue
        # a block element begins
        if stack[-1].tag == "p" or any(x.tag == "p" for x in stack[-3:]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in SCOPE:
                    break
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in CLOSES[tag]:
                    close_to(depth)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[depth].tag in SCOPE:
                    break
        flush()
        if tag == "hr":
            continue
        inside = stack[-1].inside
        words, hidden, named, suspect = _attributes(tag, m[3], inside) if m[3] else ("", False, False, False)
        named = named or tag in DROPPED or (tag == "header" and not inside)
        node = Node(tag, f"{tag} {words}" if words else tag, stack[-1], hidden, named, suspect and not hidden and not named)
        hold(node)
        stack.append(node)
        opened[tag] += 1
    close_to(1)
    return root


def _kind(node: Node) -> tuple:
    """What makes neighbours repeat: the label, for bare containers also what they hold."""
    return (node.label, *sorted({c.label for c in node.children})) if node.label in BARE else (node.label,)


def runs(children: list[Node]) -> list[list[Node]]:
    """Siblings in order, with a run of like ones as one repeating node."""
    out: list[list[Node]] = []
    last = None
    for c in children:
        kind = _kind(c)
        if kind == last:
            out[-1].append(c)
        else:
            out.append([c])
        last = kind
    return out


def skeleton(members: list[Node]) -> list:
    """[label, [children]] of a repeating node: the structure of its first member
    that has any."""
    first = next((m for m in members if m.children), members[0])
    return [members[0].label, [skeleton(r) for r in runs(first.children)]]


def numbered(tree: list, at: int = 0) -> tuple[list, int]:
    """[label, children, number] in document order."""
    mine, kids, at = at, [], at + 1
    for k in tree[1]:
        kid, at = numbered(k, at)
        kids.append(kid)
    return [tree[0], kids, mine], at


def grown(tree: list, page: Node) -> list:
    """Partial tree alignment: the structure with what else the page has, in place."""
    if tree[0] != page.label:
        return tree
    seed, _ = numbered(tree)
    align([page], seed, {})

    def plain(s: list) -> list:
        return [s[0], [plain(k) for k in s[1]]]

    def grow(members: list[Node], s: list) -> list:
        first = next((m for m in members if m.children), members[0])
        at = {k[2]: i for i, k in enumerate(s[1])}
        out, j = [], 0
        for r in runs(first.children):
            i = at.get(r[0].seed, -1)
            if i >= j:
                out += [plain(k) for k in s[1][j:i]]
                out.append(grow(r, s[1][i]))
                j = i + 1
            else:
                out.append(skeleton(r))
        return [s[0], out + [plain(k) for k in s[1][j:]]]

    return grow([page], seed)


def _weight(members: list[Node], seed: list, memo: dict) -> int:
    """Simple tree matching: the most node pairs that keep labels, parents and order."""
    if members[0].label != seed[0]:
        return 0
    key = (id(members[0]), seed[2])
    if key not in memo:
        first = next((m for m in members if m.children), members[0])
        memo[key] = 1 + _ends(runs(first.children), seed[1], memo)[-1]
    return memo[key]


def _table(a: list[list[Node]], b: list, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            best = max(row[j], last[j + 1])
            if x[0].label == y[0]:
                best = max(best, last[j] + _weight(x, y, memo))
            row.append(best)
        rows.append(row)
    return rows


def _ends(a: list[list[Node]], b: list, memo: dict) -> list[int]:
    """The last row of ``_table``, in linear space."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            best = max(row[j], last[j + 1])
            if x[0].label == y[0]:
                best = max(best, last[j] + _weight(x, y, memo))
            row.append(best)
        last = row
    return last


def _pairs(a: list[list[Node]], b: list, memo: dict) -> Iterator[tuple[list[Node], list]]:
    """The pairs of a heaviest alignment of siblings. Beyond DP_CELLS the first is cut
    in two, and the second where the halves weigh most together (Hirschberg)."""
    if len(a) > 1 and len(a) * len(b) > DP_CELLS:
        mid = len(a) // 2
        head, tail = _ends(a[:mid], b, memo), _ends(a[mid:][::-1], b[::-1], memo)
        cut = max(range(len(b) + 1), key=lambda j: head[j] + tail[len(b) - j])
        yield from _pairs(a[:mid], b[:cut], memo)
        yield from _pairs(a[mid:], b[cut:], memo)
        return
    table, i, j = _table(a, b, memo), len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            yield a[i], b[j]


def align(members: list[Node], seed: list, memo: dict) -> None:
    """Set ``seed`` on every node that simple tree matching pairs with the seed."""
    for m in members:
        m.seed = seed[2]
        for x, y in _pairs(runs(m.children), seed[1], memo):
            align(x, y, memo)


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def watched(node: Node) -> Iterator[tuple[Node, int | None, int, bool]]:
    """Text leaves in page order with the seed number of the nearest paired node, of the
    nearest paired one that is named or suspect (-1: none), and whether it is in a
    heading."""
    stack = [(node, None, -1, False)]
    while stack:
        n, s, w, h = stack.pop()
        if n.seed is not None:
            s = n.seed
            w = s if n.named or n.suspect else w
        h = h or n.tag in HEADINGS
        if n.tag == "#":
            yield n, s, w, h
        stack += [(c, s, w, h) for c in reversed(n.children)]


def leaves(node: Node) -> Iterator[tuple[Node, int | None]]:
    """Text leaves in page order with the seed number of the nearest paired node."""
    for n, s, *_ in watched(node):
        yield n, s


def kept_blocks(root: Node, wrapper: dict) -> list[str]:
    """The texts of the content blocks. ``wrapper``: const (seed number -> keys of
    template texts), menus (seed numbers of link slots), agreed (seed numbers of
    nodes that the host's pages show to be boilerplate) and rim (seed numbers of small
    slots outside the marked text; a page without most of its text marked has none).
    Nodes that are not paired with the seed go by their own names."""
    const, dropped = wrapper.get("const", {}), {*wrapper.get("menus", ()), *wrapper.get("agreed", ())}
    rim, found, stack = set(wrapper.get("rim", ())), [], [(root, None)]
    while stack:
        n, s = stack.pop()
        if n.seed is not None:
            s = n.seed
        if n.hidden or (n.named if n.seed is None else n.seed in dropped):
            continue
        if n.tag == "#" and text_key(n.text) not in const.get(str(s), ()):
            found.append((n.text, s, n.inside))
        stack += [(c, s) for c in reversed(n.children)]
    marked = sum(len(t) for t, _, inside in found if inside)
    rim = rim if 2 * marked > sum(len(t) for t, *_ in found) else ()
    return [t for t, s, inside in found if inside or s not in rim]


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def _with_seed(root: Node, seed: str | None) -> Node:
    if seed:
        tree = json.loads(seed)
        if tree[0] == root.label:
            align([root], tree, {})
    return root


def seeds(pages: DataFrame) -> DataFrame:
    """``host, seed``: the block structures of up to SEED_PAGES pages of each host, the
    first of each class of row numbers, merged."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = []
            for some in batch.column(1).to_pylist():
                tree = skeleton([parse(some[0]["html"])])
                for x in some[1:]:
                    if numbered(tree)[1] < SEED_NODES:
                        tree = grown(tree, parse(x["html"]))
                trees.append(json.dumps(numbered(tree)[0], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], names=["host", "seed"])

    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "_rid")).alias("f")
    chosen = pages.where("html <> '' and host <> ''").groupBy("host", F.pmod(F.xxhash64("_rid"), F.lit(SEED_PAGES)).alias("class")).agg(first).select(F.col("f._rid").alias("_rid"))
    chosen = materialize(chosen, "chosen")
    some = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("no"), "id", "_rid", "html"))).alias("some")
    few = pages.join(small_side(chosen), "_rid", "left_semi").groupBy("host").agg(some)
    return materialize(few.mapInArrow(outline, "host string, seed string"), "seeds")


def induce(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``host, seed, wrapper``: what all pages of the host show about its seed."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, int]] = set()
        for batch in batches:
            rows: list[tuple] = []
            for host, html, seed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = text_key(html or "")
                if (host, page) in done:
                    continue
                if len(done) > 1 << 20:
                    done.clear()
                done.add((host, page))
                seen: dict[tuple[int, int], list[int]] = {}
                for n, s, w, h in watched(_with_seed(parse(html), seed)):
                    if s is not None:
                        x = seen.setdefault((s, text_key(n.text)), [0, 0, 0, 0, 0, w])
                        x[4] += len(n.text) * h
                        x[0] += len(n.text)
                        x[1] += n.links
                        x[2] += len(n.text) * n.marked
                        x[3] += len(n.text) * n.dead
                rows += [(host, page, s, k, 1, *x) for (s, k), x in seen.items()]
                rows.append((host, page, -1, 0, 1, 0, 0, 0, 0, 0, -1))  # the page itself
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "page", "node", "key", "n", "chars", "links", "marked", "dead", "headed", "doubted"])

    seen = pages.join(small_side(found), "host").select("host", "html", "seed").mapInArrow(observe, "host string, page long, node int, key long, n long, chars long, links long, marked long, dead long, headed long, doubted long")
    sums = [F.sum(c).alias(c) for c in ("chars", "links", "marked", "dead", "headed")]
    # copies of a page in other tasks show the same rows
    texts = materialize(seen.distinct().groupBy("host", "node", "key").agg(F.sum("n").alias("n"), *sums, F.max("doubted").alias("doubted")), "texts")
    total = texts.where("node = -1").select("host", F.col("n").alias("pages"))
    slots = texts.where("node >= 0").groupBy("host", "node").agg(*sums)
    marking = texts.groupBy("host").agg((2 * F.sum("marked") > F.sum("chars")).alias("marks"), F.sum("chars").alias("all_chars"))
    outside = F.col("marks") & (2 * F.col("marked") < F.col("chars"))
    limit = F.when(outside, OUTSIDE_LINK_SHARE).otherwise(LINK_SHARE)
    menus = slots.join(marking, "host").where(F.col("links") > limit * F.col("chars")).groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("menus"))
    small = outside & (F.col("chars") < RIM_SHARE * F.col("all_chars")) & (2 * F.col("headed") < F.col("chars"))
    rim = slots.join(marking, "host").where(small).groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("rim"))
    often = texts.where(f"node >= 0 and n >= {MIN_PAGES}").join(total, "host").where(F.col("n") > MIN_SHARE * F.col("pages"))
    const = often.groupBy("host", "node").agg(F.collect_list("key").alias("keys")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct(F.col("node").cast("string"), "keys"))).alias("const"))
    template = (F.col("n") >= MIN_PAGES) & (F.col("n") > MIN_SHARE * F.col("pages"))
    # a node whose name says boilerplate, or may: the text under it decides
    poor = F.when(template, F.col("chars")).otherwise(F.col("links"))
    doubted = texts.where("doubted >= 0").join(total, "host").groupBy("host", "doubted").agg(F.sum("chars").alias("chars"), F.sum(poor).alias("poor"), F.sum("dead").alias("dead"))
    agreed = doubted.where((F.col("dead") > NAMED_SHARE * F.col("chars")) | (F.col("poor") > AGREED_SHARE * F.col("chars"))).groupBy("host").agg(F.sort_array(F.collect_list("doubted")).alias("agreed"))
    both = found.join(menus, "host", "left").join(const, "host", "left").join(agreed, "host", "left").join(rim, "host", "left")
    return materialize(both.select("host", "seed", F.to_json(F.struct("menus", "const", "agreed", "rim")).alias("wrapper")), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id_col>, <url_col>, text``, one row per page.

    Null and empty html give an empty text, an empty table gives no rows; pages of a
    null or odd url share nothing, so they have no wrapper. Repeated rows get equal
    texts and count once. On hosts of under MIN_PAGES distinct pages no text is
    template. Pages of any length and depth are read whole, and cut-off ones keep the
    text that they have. Other columns are ignored.
    """
    base = row_id(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))).withColumn("host", _host(F.col("url")))
    wrappers = induce(base.select("host", "html"), seeds(base.select("_rid", "host", "id", "html")))

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, htmls, trees, found = batch.columns
            out = []
            known: dict[str | None, dict] = {}
            for html, seed, w in zip(htmls.to_pylist(), trees.to_pylist(), found.to_pylist(), strict=True):
                if w not in known:
                    known[w] = {k: v for k, v in json.loads(w or "{}").items() if v}
                    known[w]["const"] = {k: set(v) for k, v in known[w].get("const", {}).items()}
                out.append("\n".join(kept_blocks(_with_seed(parse(html), seed), known[w])))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string())], names=["id", "url", "text"])

    kind = base.schema["id"].dataType.simpleString()
    done = base.join(small_side(wrappers), "host", "left").select("id", "url", "html", "seed", "wrapper").mapInArrow(pull, f"id {kind}, url string, text string")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
