"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree of style nodes: a node is a path of tags
and classes. A node's presentations are the sequences of its children, its contents the
texts below it; where both are nearly the same on all pages the node is decoration, and
where they differ it is content. Its importance is

    (1 - g^l) * presentation + g^l * content,   g = 0.9, l = number of kinds of children

presentation: entropy of the presentations over the host's m pages, to the base m;
content: 1 - the mean over pages of log_m(pages with that same content). It is read
against the host's most important branch, so copies of pages make nothing look like
decoration. Branches of low importance are removed from each page of the host: low is
less for what nothing else speaks against than for link lists, site headers and elements
whose class or id hints at noise. Entropy can say nothing about a host with a few pages,
nor about menus and comments that change from page to page; there, what tags and classes
declare decides. A region that is declared as the article is kept, with nothing of the
page outside it; inside, the tree removes whole boxes alone, and none on small hosts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from factgraph.llm.common import table, written

#: Importance, as a share of the host's most important branch, below which a branch is removed: if something else speaks against it, and if nothing does.
LOW, LOWEST = 0.75, 0.3
#: Pages that must have a branch before the tree judges it, and before it does so inside an article.
LEAST_PAGES, LEAST_PAGES_INSIDE, DAMPING = 4, 8, 0.9
#: A host whose most important branch has less than this shows copies of one page, and nothing can be told.
LEAST_DIFFERENCE = 0.1

RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes svg object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset("nav aside footer form head menu dialog search fieldset input annotation annotation-xml".split()) | RAW
#: Controls are noise in a form; elsewhere that is open.
HINTED_TAGS = frozenset(["button", "label"])
#: Whole boxes, which the tree may remove inside an article: not headings, paragraphs, tables or words of a sentence.
BOXES = frozenset("div section ul details button label".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices"
    " alert newsletter subscribe signup login popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer masthead toolbar pagination pager share sharing social comment comments respond reply replies disqus related"
    " recommended widget hidden skip".split()
)
#: Words that say nothing of what an element holds: `share-box` is as clear as `share`, `hljs-comment` is not.
VAGUE_WORDS = frozenset(
    "area articles bar block body box button buttons card container content form group icon icons inner item items link links list outer"
    " panel post posts row section stories teaser text thread title wrap wrapper".split()
)
#: On a paragraph these speak of its style as often as of noise.
STYLE_WORDS = frozenset("alert notice notices hidden share sharing social related recommended widget skip banner toolbar".split())
#: Slugs of titles and names of highlighted code stand on these; what they say in part says nothing.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CODE_TAGS = frozenset(["pre", "code"])
#: Tokens of class or id that mean the site's header, outside an article.
HEADER_TOKENS = frozenset("header site-header page-header global-header main-header top-header topbar top-bar".split())
#: Noise that is doubted where it holds a declared article: wrappers are often named after what they hold.
SOFT_TAGS = frozenset(["form", "fieldset"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
MAIN_TAGS = frozenset(["article", "main"])
#: A new one of these ends an open one of those, up to the fence around both.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
#: Every attribute in full, so that nothing within a value is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")


#: How surely an element is noise: a name says so in part; a name says so; a tag or a role does.
NONE, HINTED, NAMED, CERTAIN = range(4)


class Node(NamedTuple):
    parent: int
    tag: str
    path: int
    noise: int  # NONE to CERTAIN
    main: bool
    header: bool


def named(tag: str, name: str, tokens: list[str]) -> int:
    """What an element's class or id says of it.

    A token counts whole: each of its words is noise, or vague beside one that is. Of
    other tokens a word is a hint, but not on articles, sections, headings and inline
    elements; and no id of the last two counts. On a paragraph some words are a hint at
    most.
    """
    inline = tag not in BLOCK
    if name == "id" and (inline or tag in HEADINGS):
        return NONE
    said = [set(WORD.findall(t)) for t in tokens]
    noisy = [w for w in said if not NOISE_WORDS.isdisjoint(w)]
    if any(w <= NOISE_WORDS | VAGUE_WORDS and not (tag == "p" and w <= STYLE_WORDS | VAGUE_WORDS) for w in noisy):
        return NAMED
    quiet = inline or tag in HEADINGS or tag in MAIN_TAGS or tag == "section"
    return HINTED if noisy and not quiet else NONE


def declared(tag: str, attributes: str) -> tuple[str, int, bool, bool]:
    """Of an element: its style, how surely it is noise, whether it is the article or a site's header."""
    style, main, header = tag, tag in MAIN_TAGS, tag == "header"
    noise = (NAMED if tag in SOFT_TAGS else CERTAIN) if tag in NOISE_TAGS else HINTED if tag in HINTED_TAGS else NONE
    if attributes:
        seen: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):  # of a name given twice the first counts
            seen.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        for name, value in seen.items():
            if name in ("class", "id"):
                if name == "class":
                    style += f".{DIGITS.sub('0', value)}"
                tokens = value.split()
                header |= not HEADER_TOKENS.isdisjoint(tokens)
                if tag not in ("html", "body", "main"):
                    noise = max(noise, named(tag, name, tokens))
            elif name == "role":
                style += f"@{value}"
                noise = CERTAIN if value in NOISE_ROLES else noise
                main |= value in ("main", "article")
            elif name == "itemprop":
                main |= value == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                noise = CERTAIN
    return style, noise, main and noise <= HINTED, header


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes of a page in order, and its pieces of text as (node, text).

    A text of None ends a block. End tags without a start are passed over, elements
    left open end with what holds them.
    """
    nodes, text = [Node(-1, "", 0, 0, False, False)], []
    open_, at, find = [0], 0, TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            rest = page[at:]
            if rest:
                text.append((open_[-1], rest))
            return nodes, text
        if m.start() > at:
            text.append((open_[-1], page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text.append((open_[-1], entities.escape(m[0][9:-3])))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(open_) - 1, 0, -1):
                own = nodes[open_[i]].tag
                if own == tag:
                    if tag in BLOCK:
                        text.append((open_[i], None))
                    del open_[i:]
                    break
                if tag not in BLOCK and own in BLOCK:  # a stray end of an inline element
                    break
            continue
        if tag in BLOCK:
            text.append((open_[-1], None))
            for i in range(len(open_) - 1, 0, -1):  # a block ends a paragraph that is open
                own = nodes[open_[i]].tag
                if own == "p":
                    del open_[i:]
                    break
                if own in BLOCK:
                    break
        if tag in ENDS:
            fence = FENCES.get(tag, ("table",))
            for i in range(len(open_) - 1, 0, -1):
                own = nodes[open_[i]].tag
                if own in fence:
                    break
                if own in ENDS[tag]:
                    del open_[i:]
        style, noise, main, header = declared(tag, m[3] or m[6] or "")
        parent = open_[-1]
        nodes.append(Node(parent, tag, xxh3_64_intdigest(style, nodes[parent].path), noise, main, header))
        own = len(nodes) - 1
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                text.append((parent, None if tag == "hr" else "" if tag == "wbr" else " "))
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            open_.append(own)


class Low(NamedTuple):
    """Paths of a host's style nodes below LOW, below LOWEST, and those of the latter that many pages have."""

    low: frozenset[int] = frozenset()
    lowest: frozenset[int] = frozenset()
    boxes: frozenset[int] = frozenset()


def branches(nodes: list[Node], text: list[tuple[int, str]], low: Low) -> list[bool]:
    """Which nodes the tree removes: their own importance is low enough, and nothing below them is important."""
    inside, linked, said, whole = [False], [False], [False] * len(nodes), [True] * len(nodes)
    for n in nodes[1:]:
        inside.append(inside[n.parent] or n.main)
        linked.append(linked[n.parent] or n.tag == "a")
    for node, piece in text:
        if piece and not linked[node] and not piece.isspace():
            said[node] = True  # something beside links
    out = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        said[n.parent] |= said[i]
        if n.tag in VOID or n.tag in RAW:
            continue
        whole[n.parent] &= whole[i] and n.path in low.low
        if n.path in low.low and whole[i]:
            doubted = n.noise >= HINTED
            if inside[i]:
                out[i] = n.tag in BOXES and (doubted or n.path in low.boxes)
            else:  # of the words of a sentence none goes alone
                out[i] = doubted or n.header or (n.tag in BLOCK and (not said[i] or n.path in low.lowest))
    return out


def flags(nodes: list[Node], text: list[tuple[int, str]], low: Low, soft: bool = True) -> list[bool]:
    """Which nodes' own text stays: not that of branches the site's tree removes, nor what tags declare as noise.

    soft: what names call noise goes as well, where no article is below it. Not in code,
    where names are the highlighter's. Inside an article a hint alone removes nothing.
    """
    holds = [False] * len(nodes)  # a declared article at or below
    for i in range(len(nodes) - 1, 0, -1):
        holds[i] |= nodes[i].main
        if holds[i] and nodes[i].noise < CERTAIN:
            holds[nodes[i].parent] = True
    pruned = branches(nodes, text, low) if low.low else [False] * len(nodes)
    gone, inside, code, has_main = [False], [False], [False], False
    for i, n in enumerate(nodes[1:], 1):
        in_main = inside[n.parent] or n.main
        doubted = n.noise == NAMED or (n.noise == HINTED and not inside[n.parent])
        noise = n.noise == CERTAIN or (doubted and soft and not holds[i] and not code[n.parent])
        # the heading of an article often stands in a header; a header elsewhere is the site's
        drop = gone[n.parent] or noise or (n.header and not inside[n.parent] and not holds[i]) or (pruned[i] and not holds[i])
        gone.append(drop)
        code.append(code[n.parent] or n.tag in CODE_TAGS)
        inside.append(in_main and not drop)
        has_main |= n.main and not drop
    return [not g and (i or not has_main) for g, i in zip(gone, inside)]


def main_text(page: str | None, low: Low = Low(), soft: bool = True) -> str:
    """Blocks that stay, in page order, joined by an empty line.

    In a block character references are decoded and white space becomes one space. low:
    what the site's tree gives little importance; a page of which nothing else is left
    keeps that, and then what class names alone call noise.
    """
    nodes, text = parse(page or "")
    stays = flags(nodes, text, low, soft)
    blocks, block = [], []
    for node, piece in [*text, (0, None)]:
        if piece is None:
            if block:
                whole = SPACE.sub(" ", entities.unescape("".join(block))).strip()
                if whole:
                    blocks.append(whole)
                block = []
        elif stays[node]:
            block.append(piece)
    if not blocks and (low.low or soft) and len(nodes) > 1:
        return main_text(page, Low(), bool(low.low))
    return "\n\n".join(blocks)


def style_rows(page: str | None) -> list[tuple[int, int, int, int]]:
    """(path, presentation, content, kinds of children) for each style node of a page."""
    nodes, text = parse(page or "")
    children: list[list[int]] = [[] for _ in nodes]
    below: list[list[str]] = [[] for _ in nodes]
    for i, n in enumerate(nodes[1:], 1):
        children[n.parent].append(n.path)
    for node, piece in text:
        if piece and not piece.isspace():
            while node > 0:
                below[node].append(piece)
                node = nodes[node].parent
    merged: dict[int, tuple[list[int], list[str]]] = {}
    for i, n in enumerate(nodes[1:], 1):
        if n.tag not in ("html", "body", "head") and n.tag not in VOID and n.tag not in RAW:
            shown, said = merged.setdefault(n.path, ([], []))
            shown += [c for c, before in zip(children[i], [0, *children[i]]) if c != before]  # runs of equal children count once
            said += below[i]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [
        (signed(path), signed(xxh3_64_intdigest(repr(shown))), signed(xxh3_64_intdigest(SPACE.sub(" ", " ".join(said)))), len(set(shown)))
        for path, (shown, said) in merged.items()
    ]


def host_of(url):
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The hosts' style nodes: host, path, pages, presentation, content, importance.

    Each page counts once for a node. All of it is grouped sums, combined before each
    shuffle, so a host with a third of all pages is no burden to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                rows = [style_rows(h) for h in some.column(1).to_pylist()]
                where = pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64())
                flat = [x for r in rows for x in r]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(where)] + [pa.array([x[i] for x in flat], pa.int64()) for i in range(4)],
                    names=["host", "path", "shown", "said", "kinds"],
                )

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    nodes = rows.mapInArrow(run, "host string, path long, shown long, said long, kinds long")
    # one pass over the nodes: counts of each presentation with each content, then of each alone
    both = written(nodes.groupBy("host", "path", "shown", "said").agg(F.count("*").alias("n"), F.max("kinds").alias("kinds")), "style-nodes")
    n_log_n = F.sum(F.col("n") * F.log("n"))

    def spread(column: str) -> DataFrame:
        alone = both.groupBy("host", "path", column).agg(F.sum("n").alias("n"), F.max("kinds").alias("kinds"))
        return alone.groupBy("host", "path").agg(F.sum("n").alias("pages"), n_log_n.alias("nln"), F.max("kinds").alias("kinds"))

    shown = spread("shown")
    said = spread("said").select("host", "path", F.col("nln").alias("said_nln"))
    m, base = F.col("pages").cast("double"), F.log(F.col("pages").cast("double"))
    # log m - (sum n log n) / m is the entropy of the counts n; over log m it lies in 0 to 1
    presentation = F.when(F.col("pages") > 1, 1 - F.col("nln") / m / base).otherwise(1.0)
    content = F.when(F.col("pages") > 1, 1 - F.col("said_nln") / m / base).otherwise(1.0)
    weight = F.pow(F.lit(DAMPING), F.col("kinds"))
    return shown.join(said, ["host", "path"]).select(
        "host", "path", "pages",
        presentation.alias("presentation"), content.alias("content"),
        ((1 - weight) * presentation + weight * content).alias("importance"),
    )


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, low, lowest, boxes): paths of a host's unimportant style nodes, as Low has them.

    Importance is taken against the host's most important node of those that at least
    half as many pages have as any. Pages without a host have no site and no tree.
    """
    own = Window.partitionBy("host")  # style nodes of a host, not its pages
    ranked = tree.filter("host != ''").withColumn("most", F.max("pages").over(own))
    ranked = ranked.withColumn("best", F.max(F.when(F.col("pages") * 2 >= F.col("most"), F.col("importance"))).over(own))
    share = F.col("importance") / F.col("best")
    low = ranked.filter((F.col("pages") >= LEAST_PAGES) & (F.col("best") >= LEAST_DIFFERENCE) & (share < LOW))
    paths = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("path"))))
    return low.groupBy("host").agg(
        paths(F.lit(True)).alias("low"), paths(share < LOWEST).alias("lowest"), paths((share < LOWEST) & (F.col("pages") >= LEAST_PAGES_INSIDE)).alias("boxes")
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text.

    A null or empty html gives an empty text; a null or unparsable url has no host, and
    its page no site to be compared with. Whole pages are read; repeated rows are pages
    of their own and count for their host as such; extra columns are ignored; an empty
    table gives no rows.
    """
    removed = written(low_branches(style_tree(pages, url_col, html_col)), "low-importance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lows: dict[str | None, Low] = {None: Low()}
                texts = []
                for i, (page, host) in enumerate(zip(some.column(2).to_pylist(), some.column(3).to_pylist())):
                    if host not in lows:  # null where nothing is low
                        lows[host] = Low(*(frozenset(x % (1 << 64) for x in some.column(c)[i].as_py()) for c in (4, 5, 6)))
                    texts.append(main_text(page, lows[host]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("own_host"))
    # two plain shuffles where the table of hosts is large, so that a hot host's pages can be split
    joined = rows.join(removed, F.col("own_host") == F.col("host"), "left").select("id", "url", "html", "host", "low", "lowest", "boxes")
    return joined.mapInArrow(run, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)


def op4_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
