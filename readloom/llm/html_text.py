"""Main text of HTML pages by tree scoring: paragraphs pass points to ancestors, discounted by link density."""

from __future__ import annotations

import re
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import common

#: Element names by what HTML makes of them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title iframe svg canvas".split()
DROPPED = set("nav aside footer button select option menu label input audio video head annotation annotation-xml".split()) | set(RAW)
#: Dropped as well, unless the page's text is in them.
WRAPPING = set("form fieldset dialog header".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPHS = set("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
#: Parts of lists and tables hold no article by themselves; points pass through them.
PARTS = set("tr tbody thead tfoot table ul ol dl hgroup".split())
#: A start tag of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Elements nested deeper than this stay empty and their content goes on in the element around them, as in browsers.
DEEPEST = 512
#: Words that name what is no article, as a whole class or id or as the first or last part of one ("site-footer"; parts of
#: MAKEUP at the end don't count), unless a part before says that they tell of the page's state ("no-sidebar").
UNLIKELY = set("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent disclaimer
footer footnav gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promotion related
recommended replies reply responses rss share sharing shoutbox sidebar side skip social sponsor sponsored subscribe subscription tag tags toolbar topbar widget widgets alert signup login search""".split())
#: Of these, words that articles are about too ("share-prices", "social-history"): as a part of a name whose other parts
#: say nothing of a page's make-up, they count only where the content looks like boilerplate: little running text, or links.
TOPICAL = set("""ad ads advertisement advertising alert banner comment consent cookie cookies disclaimer gdpr header login menu menus navigation newsletter notice notices notification overlay popup promotion
related recommended reply responses search share sharing side signup skip social sponsor subscription tag tags widget widgets""".split())
MAKEUP = set("""area articles bar block body bottom box button buttons col column container content entries entry form group heading icon icons inner item items left link links list main outer page panel
post posts primary right row secondary section site slot stories story text title top unit wrap wrapper""".split())
PLAIN_TEXT, PLAIN_LINKS = 140, 0.33
STATES = set("has no not with without is js layout single page body template wp".split())
REMARKS = set("comment comments commentlist reply replies responses disqus".split())
#: What is cut only as long as so large a share of the page's running text stands outside of it; and how long a text must be
#: to count as running.
OUTSIDE, RUNNING = 0.1, 20
#: What the score of a container with such a name is worth, where it stays.
DOUBTED = 0.25
LIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?:(?P<inside>{ATTRIBUTES})>|[^>]*+(?:>|\Z))|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{ATTRIBUTES})>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
#: Without an end tag these take the rest of the page, as in browsers; the others end where the element around them does.
TO_THE_END = {"script", "style", "textarea", "title"}
PART = re.compile(r"[-_]+|\d+")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


def attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), a or b or c)
    return found


class Node:
    __slots__ = ("tag", "hints", "hidden", "parent", "children", "score", "size", "linked", "depth", "doubted", "running")

    def __init__(self, tag: str, rest: str = "", parent: Node | None = None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent is not None else 0
        own = attributes(rest) if rest.strip(" /") else {}
        self.hints = " ".join(own[name] for name in ("class", "id", "role") if own.get(name))
        self.hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or NO_DISPLAY.search(own.get("style", "")) is not None
        self.score, self.size, self.linked, self.running, self.doubted = 0.0, 0, 0, 0, False


def tree(html: str) -> Node:
    """Elements and texts as browsers roughly nest them; void elements but br are left out, open ones end with the page."""
    root = now = Node("#root")
    at, open_ended = 0, set()
    while m := TOKEN.search(html, at):
        if m.start() > at:
            now.children.append(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if m["raw"]:
            tag = m["raw"].lower()
            if (m["inside"] or "").endswith("/"):  # it has ended at once
                continue
            end = None if tag in open_ended else RAW_END[tag].search(html, at)
            if end is not None:
                at = end.end()
                continue
            open_ended.add(tag)  # none follows
            if tag in TO_THE_END:
                at = len(html)
                break
            name = tag
        if not name:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            open_ = now
            while open_ is not root and open_.tag != name:
                open_ = open_.parent
            if open_ is not root:
                now = open_.parent
            continue
        if name in VOID:
            if name == "hr":
                now.children.append(Node("hr", "", now))
            elif name == "br":
                now.children.append("\n")
            continue
        if name in CLOSES_P:
            open_ = now
            while open_ is not root and open_.tag not in ("p", "table", "button", "td", "th"):
                open_ = open_.parent
            if open_.tag == "p":
                now = open_.parent
        if name in ENDS:
            open_, last = now, None
            while open_ is not root and open_.tag not in SCOPES[name]:
                if open_.tag in ENDS[name]:
                    last = open_
                open_ = open_.parent
            if last is not None:
                now = last.parent
        rest = m["rest"] or m["rest2"] or ""
        node = Node(name, rest, now)
        now.children.append(node)
        if node.depth < DEEPEST and (name in BLOCKS or not rest.endswith("/")):
            now = node
    if at < len(html):
        now.children.append(html[at:])
    return root


def inside(node: Node, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def doubted(node: Node) -> bool:
    """Whether tag, style or names speak against ``node``."""
    if node.tag == "header":
        return not inside(node, ("article", "main"))
    if node.tag in WRAPPING or node.hidden:
        return True
    if not node.hints or node.tag in ("html", "body", "main"):
        return False
    names = REMARKS if node.tag == "article" else UNLIKELY
    for hint in node.hints.lower().split():
        parts = [p for p in PART.split(hint) if p]
        if not parts or parts[0] in STATES:
            continue
        last = next((p for p in reversed(parts) if p not in MAKEUP), parts[-1])
        told = {parts[0], last} & names
        if told - TOPICAL or told and (set(parts) <= names | MAKEUP or node.running < PLAIN_TEXT or node.linked > PLAIN_LINKS * node.size):
            return True
    return False


def pruned(root: Node) -> list[Node]:
    """All nodes that stay, parents first, after unwanted ones are cut off.

    Doubted ones stay if nearly all running text of the page is inside: the largest first, and then what is doubted in it
    is judged in the same way.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in DROPPED]
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    for node in reversed(order):
        measured(node)
        if node.tag != "a":
            texts = (len(c.strip()) if isinstance(c, str) else c.running for c in node.children)
            node.running = sum(n for c, n in zip(node.children, texts) if not isinstance(c, str) or n >= RUNNING)
        node.doubted = doubted(node)
    total, suspects, outside, kept = root.running, [], root.running, set()

    def found(node: Node) -> None:
        """The outermost doubted nodes under ``node``."""
        nonlocal outside
        stack = [c for c in node.children if not isinstance(c, str)]
        while stack:
            one = stack.pop()
            if one.doubted:
                heappush(suspects, (-one.running, len(suspects), id(one), one))
                outside -= one.running
            else:
                stack += [c for c in one.children if not isinstance(c, str)]

    found(root)
    while suspects and outside < OUTSIDE * total:
        largest = heappop(suspects)[-1]
        if not largest.running:
            break
        kept.add(id(largest))
        outside += largest.running
        found(largest)
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not c.doubted or id(c) in kept]
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return order


def measured(node: Node) -> None:
    """Sets the letters of a node's text and of its links, once those of its children are."""
    own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
    node.size = own + sum(c.size for c in node.children if not isinstance(c, str))
    node.linked = node.size if node.tag == "a" else sum(c.linked for c in node.children if not isinstance(c, str))


def scored(order: list[Node]) -> None:
    for node in reversed(order):
        measured(node)
    for node in order:
        loose = node.tag not in PARAGRAPHS and node.tag in BLOCKS and any(isinstance(c, str) and c.strip() for c in node.children)
        if not (node.tag in PARAGRAPHS or loose) or not node.size:
            continue
        commas = sum(text.count(",") + text.count("、") + text.count("，") for text in texts(node))
        points = (0.25 if node.tag in ("li", "dd") or node.tag[0] == "h" else 1) * (1 + commas + min(node.size / 100, 3))
        share, up = 1.0, node if loose else node.parent
        depth = 0
        while up is not None and depth < 4:
            if up.tag in PARTS:
                up = up.parent
                continue
            up.score += points * share
            depth += 1
            share = 0.5 if depth == 1 else 0.5 / (depth + 1)
            up = up.parent
    for node in order:
        if node.tag in ("article", "main"):
            node.score += 25 if node.size else 0
        elif node.hints and LIKELY.search(node.hints):
            node.score += 5 if node.size else 0
        node.score *= 1 - node.linked / node.size if node.size else 0
        node.score *= DOUBTED if node.doubted else 1


def texts(node: Node):
    stack = [node]
    while stack:
        one = stack.pop()
        if isinstance(one, str):
            yield one
        else:
            stack += reversed(one.children)


def blocks(kept: list[Node]) -> list[str]:
    """The texts of blocks in page order, white space made one space; empty ones are none."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if parts:
            line = " ".join(unescape("".join(parts)).split())
            if line:
                out.append(line)
            parts.clear()

    stack: list = [*reversed(kept)]
    while stack:
        one = stack.pop()
        if one is None:
            end()
        elif isinstance(one, str):
            parts.append(one)
        elif one.tag in BLOCKS:
            end()
            stack.append(None)
            stack += reversed(one.children)
        else:
            stack += reversed(one.children)
    end()
    return out


def main_text(html: str) -> str:
    """The blocks of the best container and of siblings like it, joined by \\n; empty if the page has no text to keep."""
    order = pruned(tree(html))
    scored(order)
    best = max((n for n in order if n.tag in BLOCKS and n.tag not in PARTS or n.tag == "#root"), key=lambda n: n.score, default=None)
    if best is None or best.score <= 0:
        bodies = [n for n in order if n.tag in ("article", "main")] or [n for n in order if n.tag == "body"] or order[:1]
        return "\n".join(blocks(bodies[:1]))
    up = best
    while up is not None:  # a part of an article stands for the whole of it
        if up.tag in ("article", "main") and up.score > 0:
            best = up
        up = up.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        least = max(10, best.score * 0.2)
        alike = lambda n: n.score >= least or n.tag == "p" and n.size > 80 and n.linked < 0.25 * n.size or n.tag[0] == "h" and n.tag[1:].isdigit()
        kept = [c for c in best.parent.children if not isinstance(c, str) and (c is best or alike(c))]
    elif best.tag == "article" and best.parent is not None:
        kept = [c for c in best.parent.children if not isinstance(c, str) and (c is best or c.tag == "article" and c.score >= 0.2 * best.score)]
    return "\n".join(blocks(kept))


def extract_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole ``html`` as column ``name`` (a clash appends underscores).

    Null and empty pages, and pages without a block to keep, give the empty text. All rows and columns stay.
    """
    common.bounded_batches(pages.sparkSession)

    @arrow_udf("string")
    def extracted(values: pa.Array) -> pa.Array:
        return pa.array([main_text(v.as_py()) for v in values], pa.string())

    return pages.withColumn(common.fresh(pages, name)[0], extracted(common.text_of(html)))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, the main text of every page and its code points; see extract_text."""
    out = extract_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
