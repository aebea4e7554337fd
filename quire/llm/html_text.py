"""Main-text extraction by site template removal.

Every element subtree of a page is hashed by its shape: tags, class words and the shapes of its children with runs of
equal ones as one, under the path of its ancestors; texts and link targets are left out, so a menu with other labels
is still the same menu. Spark counts on how many different pages of a host, and on how many hosts, each shape occurs.
What recurs and stands outside the page's content is template and is deleted; what occurs once is kept. The content is
where ``article`` or ``main`` says, or else the deepest container with half of the page's words outside links. Inside
the content the counts are of subtrees with their texts: a container that is the same on several pages goes, sentences
and headings stay. Identical pages count once, so copies of a page do not turn its article into a template.

Tags, roles and class words only break ties: inside the content (a comment section or share bar within the article),
and on the pages of a host with fewer than ``min_pages`` pages, of which counts say nothing but that a shape is that of
``min_hosts`` hosts. What other hosts are in the table hence changes no text unless they share shapes. An element that holds half of the content's words is not furniture by its class.
Scripts, styles, forms and other markup that is no text go everywhere.

Defined results: null or empty markup and pages without content have an empty text; a null URL has the host ``''``;
repeated rows each get a row; an empty table gives an empty result; only id, URL and markup are read, so other columns
cannot clash. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import filesystem, forget, map_batches, sliced, staged
from quire.llm.url_filter import url_host

#: A shape is template on a host from so many pages and that share of the host's, or from so many hosts.
MIN_PAGES, MIN_SHARE, MIN_HOSTS = 3, 0.001, 3
#: Template tables of up to this many hashes are read by every task; beyond it they come before their pages.
SMALL_HASHES = 500_000
#: Pages of a host that a task has then; groups of a host at most.
PAGES_A_GROUP, MOST_GROUPS = 5000, 1 << 30
#: Lists of repeated pages of up to this many rows are broadcast.
BROADCAST_COPIES = 100_000
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 200

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template iframe textarea title svg math object form button select option canvas audio video map input".split())
FRAME = frozenset("nav footer aside menu dialog".split())
CONTAINERS = frozenset("div section aside ul ol dl table form nav footer header figure details menu dialog".split())
LAYOUT = CONTAINERS | frozenset("#root html body center tbody tr td".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body article main section div aside table ul ol dl td th form".split())
# What class and id words say about furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-bar|widget|footer|comments?|disqus|respond|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|signup|popup|modal|overlay|login|search|toolbar|pagination|pager|skip-link|masthead)(?:$|[\s_-])",
    re.I,
)
ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu|menubar)$", re.I)
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)


class Node:
    """An element: its children are nodes and strings of decoded text."""

    __slots__ = ("attributes", "children", "digest", "linked", "prose", "shape", "spot", "tag")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.digest = tag, attributes, [], 0
        self.shape, self.spot, self.prose, self.linked = 0, 0, 0, 0


def parse(html: str) -> Node:
    """The element tree of a page; missing end tags are implied, stray ones ignored, comments dropped."""
    root = Node("#root", "")
    stack, at = [root], 0
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            if at < len(html):
                stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        end, tag, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag in SCOPES:
                    break
            continue
        closes = ("p",) if tag in CLOSES_P else SIBLINGS.get(tag)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES and not (tag == "tr" and stack[i].tag in ("td", "th")):
                    break
        node = Node(tag, rest)
        stack[-1].children.append(node)
        if tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = len(html) if close is None else html.find(">", close.end() - 1) + 1 or len(html)
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(node)
    return root


def _name(node: Node) -> str:
    """The tag with the class words; numbers in them are one."""
    if "class" not in node.attributes:
        return node.tag
    found = next(("".join(values) for name, *values in ATTRIBUTE.findall(node.attributes) if name.lower() == "class"), "")
    return f"{node.tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '#', found).split()))}" if found.strip() else node.tag


def hashed(root: Node) -> list[Node]:
    """Sets digest (with texts), shape, spot (path and name only) and the words of every element; the elements, parents first."""
    from xxhash import xxh3_64_intdigest

    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node))
    names = {id(n): _name(n) for n in order}
    for n in reversed(order):
        parts, inner = [n.tag, n.attributes.strip()], []
        for c in n.children:
            if isinstance(c, Node):
                parts.append(f"\x00{c.digest:x}")
                if c.tag not in RAW:
                    n.prose += c.prose
                    n.linked += c.linked
                if c.tag not in INLINE and c.tag not in VOID and (not inner or inner[-1] != c.shape):
                    inner.append(c.shape)
            else:
                words = c.split()
                n.prose += len(words)
                parts.append(" ".join(words))
        if n.tag == "a":
            n.linked, n.prose = n.linked + n.prose, 0
        n.digest = xxh3_64_intdigest("\x01".join(p for p in parts if p)) - (1 << 63)
        n.shape = xxh3_64_intdigest(f"{names[id(n)]}\x02{inner}")
    paths = {id(root): 0}
    for n in order:
        here = paths[id(n)]
        own = xxh3_64_intdigest(f"{here:x}\x03{names[id(n)]}")
        n.shape = xxh3_64_intdigest(f"{here:x}\x04{n.shape:x}") - (1 << 63)
        # A bare div says nothing without what is in it; a name does.
        n.spot = own - (1 << 63) if n.tag in FRAME or n.tag in ("header", "form") or "." in names[id(n)] else n.shape
        for c in n.children:
            if isinstance(c, Node):
                paths[id(c)] = own
    return order


def is_furniture(node: Node, inside: bool, words: int = 0) -> bool:
    """Whether tag, role or class say furniture; ``inside``: it stands in the article; ``words``: of the whole content."""
    if node.tag in NEVER or node.tag in FRAME or node.tag == "header" and not inside:
        return True
    if not node.attributes or node.tag in ("html", "body", "main") or words and 2 * node.prose >= words:
        return False
    for name, *values in ATTRIBUTE.findall(node.attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or name == "role" and ROLES.match(value) or name in ("class", "id") and FURNITURE.search(value):
            return True
    return False


def content_roots(root: Node) -> tuple[list[Node], bool]:
    """Where the text is: the articles, else main, else the container with most words; whether it is one of the first two."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag in NEVER or n.tag in FRAME and 2 * n.prose < root.prose:
            continue
        kind = "main" if re.search(r"role\s*=\s*[\"']?main", n.attributes) else n.tag
        if kind in found:
            found[kind].append(n)
            if kind == "article":
                continue
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    # A comment may be an article too.
    words = sum(n.prose for n in found["article"])
    found["article"] = [n for n in found["article"] if not is_furniture(n, True, words)] or found["article"]
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind], True
    at = root
    while True:
        inner = [c for c in at.children if isinstance(c, Node) and c.tag in LAYOUT - FRAME and c.prose and 2 * c.prose >= root.prose]
        if not inner:
            return [at], False
        at = inner[0]


def around(order: list[Node], starts: list[Node]) -> set[int]:
    """The ids of the elements that hold one of ``starts``."""
    over, goals = set(), set(map(id, starts))
    for n in reversed(order):
        if any(isinstance(c, Node) and (id(c) in goals or id(c) in over) for c in n.children):
            over.add(id(n))
    return over


def main_text(html: str | None, templates: frozenset[int] | set[int] = frozenset(), counted: bool = False) -> str:
    """The blocks of a page's content without template subtrees; ``counted``: the counts decide what is template."""
    if not html:
        return ""
    root = parse(html)
    order = hashed(root)
    starts, marked = content_roots(root)
    goals, over = set(map(id, starts)), around(order, starts)
    words = sum(n.prose for n in starts)
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    def goes(n: Node, inside: bool) -> bool:
        if n.tag in NEVER:
            return True
        if inside:
            recurs = n.tag in CONTAINERS and (n.digest in templates or not marked and n.shape in templates and n.linked > n.prose)
            return recurs or is_furniture(n, marked, words)
        recurs = (n.shape in templates or n.spot in templates) and (marked or n.tag in CONTAINERS)
        return recurs or not counted and (marked or is_furniture(n, False))

    todo: list = [(root, False)]
    while todo:
        n, inside = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            now.append(n)
        elif id(n) not in over and id(n) not in goals and n.tag != "br" and goes(n, inside):
            if n.tag not in INLINE:
                flush()
        elif n.tag == "br":
            now.append(" ")
        else:
            inside = inside or id(n) in goals
            if n.tag not in INLINE:
                flush()
                todo.append((None, False))
            # Loose text beside a marked article belongs to no element that could recur.
            bare = inside or not marked or id(n) not in over
            todo.extend((c, inside) for c in reversed(n.children) if bare or isinstance(c, Node))
    flush()
    return "\n\n".join(blocks)


def countable(html: str | None) -> tuple[set[int], set[int]]:
    """Of a page: the shapes and spots outside its article, and the digests of containers inside its content."""
    root = parse(html or "")
    order = hashed(root)
    starts, marked = content_roots(root)
    over, goals = around(order, starts), set(map(id, starts))
    shapes: set[int] = set()
    digests: set[int] = set()
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or id(n) in goals
        if n.tag in NEVER or n.tag in VOID:
            continue
        if id(n) not in over and id(n) not in goals:
            if inside and n.tag in CONTAINERS:
                digests.add(n.digest)
            if (n.tag in CONTAINERS or not inside and n.tag not in INLINE) and not (inside and marked):
                shapes.update((n.shape, n.spot))
        todo.extend((c, inside) for c in n.children if isinstance(c, Node))
    return shapes, digests


def site_templates(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """host, counted, hashes, groups of every host: whether counts decide there, its hashes that recur, in how many groups its pages go.

    A hash recurs on at least ``min_pages`` different pages and that share of the host's, or, of shapes, on ``min_hosts`` hosts.
    """
    rows = pages.select(url_host(F.col("url")).alias("host"), F.col("page_id").alias("page_id"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), "html")
    repeated = staged(rows.groupBy("host", "digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("host", "digest", "first"), "html-copies")
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_COPIES else repeated
    once = rows.join(side, ["host", "digest"], "left").where("first is null or first = page_id")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, SLICE):
            hosts, kinds, digests = [], [], []
            for host, html in zip(*[c.to_pylist() for c in b.columns]):
                shapes, texts = countable(html)
                # Kind 0 is the page itself.
                kinds += [0] + [1] * len(shapes) + [2] * len(texts)
                digests += [0, *shapes, *texts]
                hosts += [host] * (1 + len(shapes) + len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int8()), pa.array(digests, pa.int64())], ["host", "kind", "digest"])

    counts = map_batches(once.select("host", "html"), subtrees, "host string, kind byte, digest long").groupBy("host", "kind", "digest").agg(F.count("*").alias("pages"))
    counts = staged(counts.where((F.col("kind") < 2) | (F.col("pages") >= min_pages)), "html-counts")
    sizes = counts.where("kind = 0").select("host", F.col("pages").alias("all_pages"))
    pooled = counts.where("kind = 1").groupBy("digest").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= min_hosts)
    recurs = (F.col("pages") >= F.greatest(F.lit(min_pages), min_share * F.col("all_pages"))) | F.col("hosts").isNotNull()
    often = counts.where("kind > 0").join(sizes, "host").join(pooled, "digest", "left").where(recurs).groupBy("host").agg(F.collect_set("digest").alias("hashes"))
    out = staged(sizes.join(often, "host", "left").select("host", (F.col("all_pages") >= min_pages).alias("counted"), "hashes", F.greatest(F.lit(1), F.ceil(F.col("all_pages") / PAGES_A_GROUP)).cast("int").alias("groups")), "html-templates")
    forget(repeated, counts)
    return out


def _read_hosts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Texts of page rows (page_id, url, html, host); the small table of templates is read once by a task."""
    from pyarrow import dataset

    store, root = filesystem(path)
    table = dataset.dataset(root, filesystem=store, format="parquet").to_table(columns=["host", "counted", "hashes"])
    place = {host: i for i, host in enumerate(table.column("host").to_pylist())}
    counted, hashes, seen = table.column("counted").to_pylist(), table.column("hashes"), {}
    for b in sliced(batches, SLICE):
        texts = []
        for html, host in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if host not in seen:
                if len(seen) > 1000:
                    seen.clear()
                i = place.get(host)
                seen[host] = (frozenset(), False) if i is None else (frozenset(hashes[i].as_py() or ()), bool(counted[i]))
            texts.append(main_text(html, *seen[host]))
        yield _texts(b.column(0), b.column(1), texts)


def _follow_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of page rows that follow the row of their host's templates (page_id, url, html, kind, counted, hashes)."""
    hashes, counted = frozenset(), False
    for b in sliced(batches, SLICE):
        pages, texts = [], []
        for i, (kind, html, decides) in enumerate(zip(b.column(3).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
            if kind == 0:
                hashes, counted = frozenset(b.column(5)[i].as_py() or ()), bool(decides)
            else:
                pages.append(i)
                texts.append(main_text(html, hashes, counted))
        take = pa.array(pages, pa.int64())
        yield _texts(b.column(0).take(take), b.column(1).take(take), texts)


def _texts(ids, urls, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, templates: DataFrame | None = None, **options) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``; ``templates``: of ``site_templates``, else made of ``pages``.

    Up to SMALL_HASHES hashes are a file that every task reads. Beyond it pages are dealt out by host and group, and the
    first row of a group brings the host's hashes: either way they are not in the rows of pages.
    """
    templates = site_templates(pages, **options) if templates is None else templates
    schema = "page_id long, url string, text string, n_chars long"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", url_host(F.col("url")).alias("host"))
    size = templates.agg(F.sum(1 + F.coalesce(F.size("hashes"), F.lit(0)))).first()[0] or 0
    if size <= SMALL_HASHES:
        path = getattr(templates, "_staged_at", None) or staged(templates, "html-templates")._staged_at
        return map_batches(rows, lambda batches: _read_hosts(batches, path), schema)
    group = F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(MOST_GROUPS))
    spread = rows.join(templates.select("host", "groups"), "host", "left").select("host", F.pmod(group, F.coalesce("groups", F.lit(1))).cast("int").alias("group"), F.lit(1).alias("kind"), "page_id", "url", "html", F.lit(None).cast("boolean").alias("counted"), F.lit(None).cast("array<long>").alias("hashes"))
    heads = templates.select("host", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "counted", "hashes")
    dealt = heads.unionByName(spread).repartition("host", "group").sortWithinPartitions("host", "group", "kind")
    return map_batches(dealt.select("page_id", "url", "html", "kind", "counted", "hashes"), _follow_hosts, schema)
