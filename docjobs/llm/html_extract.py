"""HTML extraction: site style tree.

Every page is read into elements (tolerating unclosed and misnested tags). The pages of a host are merged into one style
tree: a node is a block-level element's path of tags, classes and ids. It keeps its presentations (sequences of child
tags) and its contents (the texts of its own blocks, or one digest of the whole branch where it has none) over the host's
different pages. Importance comes from entropy:

* content: one less the mean, over the node's different texts, of the entropy of the pages that share a text, relative to
  that of all pages that have the node. A text on every page adds one, a text on a single page nothing. The mean is over
  different texts, so many copies of an article are one text among its host's many;
* presentation: the entropy of the presentations over the pages. A node with own texts counts by its content, one
  without by both (it is unimportant only if it looks and reads alike everywhere).

What HTML and class names declare is a prior, worth so many pages (``PRIORS``); the measured importance counts as much as
the pages that have the node, so on hosts with few pages the declaration decides and on large ones entropy can overrule
it, either way. Branches that end below one half are removed from each page. Two things stay outside entropy's reach:
comments of readers and forms, which differ from page to page as articles do, and scripts and styles.

Below the main content a class name declares furniture only if all its words do (``cookie-notice``, ``comment-list``). One
with other words in it (``feedback-loops``), or with words that titles and sections bear too (``post-header``, ``legal``),
is no more than a hint: the element stays, unless the host's pages repeat it.

The tree's statistics are aggregated by host, node and text, with partial sums before each shuffle, so a host with a third
of all pages is no hot group. Only nodes where entropy overrules the declaration come back to the pages.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
line feeds in page order; ``br`` is white space. Null and empty pages have empty text; pages that are equal count once
for the tree; null urls share one host; repeated rows are each extracted; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.llm.common import small_batches, valid, written

#: What is declared of an element: in the main content, a container below it, nothing, outside the page's main content,
#: furniture; and a reader's or a form's, which entropy can't tell from an article.
#: A hint is what only an ambiguous class name below the main content says.
MAIN, INNER, OPEN, OUTSIDE, FURNITURE, READER, HINT = range(7)
#: The importance that a declaration gives, and the pages that it is worth against what is measured.
PRIORS = {MAIN: (1.0, 1000), INNER: (0.7, 64), OPEN: (0.5, 64), OUTSIDE: (0.0, 1000), FURNITURE: (0.0, 1000), READER: (0.0, None), HINT: (0.5, 8)}
#: The measured importance at which a node is as likely furniture as not, and how steeply that changes around it.
EVEN, STEEP = 0.95, 10.0
#: The nodes where entropy overrules are sent to every executor up to so many bytes, and joined page by page beyond.
MOST_BROADCAST = 8 << 20

#: What HTML says about its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - set("body caption dd dt html legend li option tbody td tfoot th thead tr".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = set("table ul ol dl body html article section div main aside nav footer header select".split())
CONTAINERS = set("address aside blockquote details div dl fieldset figure footer form header menu nav ol section table ul".split())
FURNITURE_TAGS = set("nav footer aside dialog menu object canvas audio video".split())
READER_TAGS = set("form button select search head fieldset label input".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary dialog alert alertdialog menu menubar toolbar".split())
READER_ROLES = set("search form".split())
FURNITURE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adslot adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars rail widget widgets menu menus submenu nav navbar navigation navi breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer foot header share sharing social related recommended recommendations "
    "skip copyright legal disclaimer tags".split()
)
READER_NAMES = set("comment comments commentlist reply replies respond disqus discussion feedback login hidden".split())
#: Words that sections and titles of articles bear too, and words that say nothing about what an element is.
AMBIGUOUS_NAMES = set("banner copyright disclaimer discussion feedback foot footer head header legal masthead rail related share skip social tags widget widgets".split())
NEUTRAL_NAMES = set("area article bar block body box button buttons center col column container content entry form icon icons inner item items left link links list main outer page panel post posts reader right section site slot text title top bottom unit user wrap wrapper".split())
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
#: Names that make furniture of an element that is an article by its tag.
NOT_MAIN_NAMES = {"related", "promo", "sponsored"}

#: Comments, declarations and tags. As HTML has it, what is not closed reaches to the end of the page, and a quote opens
#: a value only after an equals sign; possessive, so it reads a page once whatever it holds.
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]*))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    path: str
    parent: Element | None
    kind: int
    children: list = field(default_factory=list)  # tags, for the presentation
    texts: list = field(default_factory=list)  # hashes of its own blocks, and of the branches below it

    @property
    def key(self) -> int:
        """The node of the host's tree that the element belongs to."""
        return _hash(f"{self.kind}{self.path}")


def _vague(words: list[str]) -> bool:
    """Whether the words of a class name leave it open what the element is: some other than furniture's, or only ambiguous ones."""
    said = [w for w in words if w not in NEUTRAL_NAMES]
    return any(w not in FURNITURE_NAMES and w not in READER_NAMES for w in said) or all(w in AMBIGUOUS_NAMES for w in said)


def _declared(tag: str, attrs: str, parent: Element) -> tuple[str, int]:
    """The label of an element in paths, and what is declared of it."""
    names, hints, label = [], [], tag
    inside = parent.kind in (MAIN, INNER, HINT)
    main, reader, furniture = tag in MAIN_TAGS, tag in READER_TAGS, tag in FURNITURE_TAGS or (tag == "header" and not inside)
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            furniture |= value.lower() in FURNITURE_ROLES
            reader |= value.lower() in READER_ROLES
            main |= value.lower() in MAIN_ROLES
        elif key == "hidden":
            reader = True
        elif key in ("class", "id"):
            label += ("." if key == "class" else "#") + ".".join(sorted(value.split()))
            for name in value.split():
                words = [n.lower() for n in _NAME.findall(name)]
                (hints if inside and tag not in MAIN_TAGS and _vague(words) else names).extend(words)
    if tag not in ("html", "body"):
        reader |= not READER_NAMES.isdisjoint(names)
        furniture |= not (NOT_MAIN_NAMES if tag in MAIN_TAGS else FURNITURE_NAMES).isdisjoint(names)
    if reader or parent.kind == READER:
        return label, READER
    if furniture or parent.kind == FURNITURE:
        return label, FURNITURE
    if inside and tag in BLOCKS and not (FURNITURE_NAMES | READER_NAMES).isdisjoint(hints):
        return label, HINT
    if parent.kind in (INNER, HINT) or (parent.kind == MAIN and tag in CONTAINERS):
        return label, INNER
    return label, MAIN if main or parent.kind == MAIN else OPEN


def read_page(html: str, declared: bool = True):
    """The elements of a page in order, and its blocks: (block-level element, text)."""
    root = Element("", "", None, OPEN)
    stack, elements, blocks, block = [root], [root], [], None
    at, end, opened = 0, len(html), Counter()

    def say(text: str):
        nonlocal block
        own = stack[-1]
        while own.tag not in BLOCKS and own.tag and own.kind == own.parent.kind:
            own = own.parent
        if own.tag not in BLOCKS and own.tag:  # declared to be something else than the block that it stands in
            return
        if block is None:
            block = (own, [])
            blocks.append(block)
        block[1].append(text)

    def close(depth: int):
        nonlocal block
        for e in stack[depth:]:
            opened[e.tag] -= 1
            if e.tag in BLOCKS:
                block = None
        del stack[depth:]

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            if html[at:].strip():
                say(html[at:])
            break
        if m.start() > at:
            piece = html[at : m.start()]
            if block is not None or not piece.isspace():
                say(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                continue
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                at = stop.end() if stop else end
            continue
        if (tag in CLOSES_P or tag == "p") and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        ends = SAME_CLOSES.get(tag)
        if ends and tag != "p":
            low = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    low = k
                elif stack[k].tag in SCOPES:
                    break
            if low is not None:
                close(low)
        if tag == "br":
            if block is not None:
                block[1].append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            continue
        parent = stack[-1]
        if tag in BLOCKS:
            block = None
        label, kind = _declared(tag, m[3], parent)
        above = parent.path if len(parent.path) < 400 else f"~{_hash(parent.path)}"
        e = Element(tag, f"{above}/{label}", parent, kind if declared or kind == READER else OPEN)
        parent.children.append(tag)
        elements.append(e)
        stack.append(e)
        opened[tag] += 1
    if any(e.kind == MAIN for e in elements):
        for e in elements:
            if e.kind == OPEN:
                e.kind = OUTSIDE
    return elements, [(e, t) for e, parts in blocks if (t := " ".join(unescape("".join(parts)).split()))]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_nodes(html: str, declared: bool = True):
    """A hash of the page, and (node, kind, presentation, own texts, content of the branch) of its nodes that hold text."""
    elements, blocks = read_page(html, declared)
    own: dict[int, list] = {}
    for e, text in blocks:
        h = _hash(text)
        e.texts.append(h)
        own.setdefault(e.key, []).append(h)
    nodes: dict[int, list] = {}
    for e in reversed(elements):  # a branch is closed after all in it: each text is folded upwards once
        if not e.texts:
            continue
        branch = _hash(",".join(map(str, e.texts)))
        if e.parent is not None:
            e.parent.texts.append(branch)
        if e.tag in BLOCKS and e.kind != READER:
            node = nodes.setdefault(e.key, [e.kind, [], []])
            node[1].append(",".join(e.children))
            node[2].append(branch)
    page = _hash("\n".join(t for _, t in blocks))
    return page, [(k, kind, _hash("|".join(looks)), list(dict.fromkeys(own.get(k, ()))), _hash(",".join(map(str, branches)))) for k, (kind, looks, branches) in nodes.items()]


def main_text(html: str | None, overruled: set[int], declared: bool = True) -> str:
    """The blocks of a page outside furniture; overruled are the nodes of which entropy says the opposite of the declaration."""
    if not html:
        return ""
    elements, blocks = read_page(html, declared)
    gone: dict[int, bool] = {id(None): False}
    for e in elements if overruled else ():  # parents come first
        gone[id(e)] = gone[id(e.parent)] or (PRIORS[e.kind][0] >= 0.5 and e.tag in BLOCKS and e.key in overruled)
    kept = (t for e, t in blocks if not gone.get(id(e)) and (PRIORS[e.kind][0] >= 0.5 or e.key in overruled))
    return "\n".join(kept)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


_NODES = "array<struct<node:long,kind:int,style:long,own:array<long>,branch:long>>"


def _node_rows(declared: bool, batches):
    kind = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("style", pa.int64()), ("own", pa.list_(pa.int64())), ("branch", pa.int64())]))
    for batch in batches:
        found = [style_nodes(html or "", declared) for html in batch.column(1).to_pylist()]
        nodes = [[dict(zip(("node", "kind", "style", "own", "branch"), n)) for n in own] for _, own in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.int64()), pa.array(nodes, kind)], names=["host", "page", "nodes"])


def style_tree(pages: DataFrame, url: str = "url", html: str = "html", declared: bool = True) -> DataFrame:
    """host, node, kind, pages, importance of the nodes of each host's tree."""
    seen = pages.select(host(url).alias("host"), valid(html).alias("html")).mapInArrow(functools.partial(_node_rows, declared), f"host string, page long, nodes {_NODES}").dropDuplicates(["host", "page"])
    flat = seen.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    texts = F.when(F.size("own") > 0, F.transform("own", lambda t: F.struct(F.lit("own").alias("of"), t.alias("hash")))).otherwise(F.array(F.struct(F.lit("branch").alias("of"), F.col("branch").alias("hash"))))
    every = F.concat(F.array(F.struct(F.lit("style").alias("of"), F.col("style").alias("hash"))), texts)
    counted = flat.select("host", "node", "kind", F.explode(every).alias("x")).groupBy("host", "node", "kind", "x.of", "x.hash").agg(F.count("*").alias("n"))
    has = lambda of, x: F.sum(F.when(F.col("of") == of, x).otherwise(0.0))
    one = F.lit(1.0)
    sums = [has("style", F.col("n")).alias("pages"), has("style", F.col("n") * F.log("n")).alias("looks")]
    sums += [x for of in ("own", "branch") for x in (has(of, one).alias(f"n_{of}"), has(of, F.log("n")).alias(f"log_{of}"))]
    node = counted.groupBy("host", "node", "kind").agg(*sums)
    most = F.log("pages")
    style = F.when(F.col("pages") > 1, (most - F.col("looks") / F.col("pages")) / most).otherwise(1.0)
    content = lambda of: F.when(F.col("pages") > 1, 1 - F.col(f"log_{of}") / F.col(f"n_{of}") / most).otherwise(1.0)
    importance = F.when(F.col("n_own") > 0, content("own")).otherwise(1 - (1 - style) * (1 - content("branch")))
    return node.select("host", "node", "kind", F.col("pages").cast("long").alias("pages"), importance.alias("importance"))


def weighed(tree: DataFrame) -> DataFrame:
    """The tree with kept (what is decided for a node) and overruled (whether its declaration says the opposite)."""
    by_kind = lambda i: F.element_at(F.create_map(*(F.lit(x).cast("double") for k, p in PRIORS.items() if p[1] for x in (k, p[i]))), F.col("kind").cast("double"))
    share = F.col("pages") / (F.col("pages") + by_kind(1))
    measured = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 + STEEP * (F.col("importance") - EVEN)))
    kept = (1 - share) * by_kind(0) + share * measured >= 0.5
    return tree.withColumn("kept", kept).withColumn("overruled", F.col("kept") != (by_kind(0) >= 0.5))


def _text_rows(declared: bool, batches):
    for batch in batches:
        text = [main_text(h, set(nodes or ()), declared) for h, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])


def _page_nodes(declared: bool, batches):
    for batch in batches:
        for h, page, html in zip(*(c.to_pylist() for c in batch.columns)):
            nodes = list({e.key for e in read_page(html or "", declared)[0] if e.tag in BLOCKS})
            yield pa.RecordBatch.from_pydict({"host": pa.array([h] * len(nodes), pa.string()), "page": pa.array([page] * len(nodes), pa.int64()), "node": pa.array(nodes, pa.int64())})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", declared: bool = True, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text for each row of pages; without ``declared``, entropy alone decides (but for forms and readers)."""
    small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)[page_id]
    found = written(weighed(style_tree(pages, url, html, declared)).filter("overruled").select("host", "node"), "overruled")
    size = found.agg(F.sum(F.length("host") + 8)).first()[0] or 0
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), valid(html).alias("html"), host(url).alias("host"))
    if size <= most_broadcast:
        joined = rows.join(F.broadcast(found.groupBy("host").agg(F.collect_list("node").alias("nodes"))), "host", "left")
    else:  # each page's own nodes, so that no row holds more than its page does
        rows = rows.withColumn("page", F.xxhash64("html"))
        own = rows.select("host", "page", "html").mapInArrow(functools.partial(_page_nodes, declared), "host string, page long, node long").distinct()
        joined = rows.join(own.join(found, ["host", "node"]).groupBy("host", "page").agg(F.collect_list("node").alias("nodes")), ["host", "page"], "left")
    return joined.select("page_id", "url", "html", "nodes").mapInArrow(functools.partial(_text_rows, declared), f"page_id {kind}, url string, text string")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the main text of each page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
