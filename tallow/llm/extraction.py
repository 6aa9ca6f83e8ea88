"""Main text of web pages by consensus host paths.

Every page scores its containers by the text they hold; the best one's path,
generalised to tags and classes without numbers, is a vote for its host. Spark
counts the votes, and each page is then extracted anew from its host's winning
path, or from its own best container where that path is absent.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import stage

BROADCAST_BYTES = 32 << 20
WINNERS = 3  # paths kept for a host, by votes
LEAST_SHARE = 0.25
SALTS = 16

# Element names by their role in a page.
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "select", "textarea", "button"}
NOISE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
NOISE_WORDS = r"ad|ads|advert\w*|banner|breadcrumbs?|comments?(?:-?(?:area|box|form|list|section|thread|wrap\w*))?|cookies?|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|replies|reply|respond|sidebar|sponsor\w*|subscribe|toolbar"
ASIDE_WORDS = r"promo\w*|related|share|sharing|social|widget"  # what a name of main text in the same element outweighs
NOISE_NAME = re.compile(rf"(?:^|[\s_-])(?:{NOISE_WORDS})(?:$|[\s_-])", re.I)
ASIDE_NAME = re.compile(rf"(?:^|[\s_-])(?:{ASIDE_WORDS})(?:$|[\s_-])", re.I)
NOISE_ALONE = re.compile(rf"(?:{NOISE_WORDS})", re.I)
MODIFIER = re.compile(r"(?:has|have|with|without|no|is|show|hide|toggle)[-_]", re.I)  # tells how an element is laid out, not what it is
OWN_HEADER = re.compile(r"(?:article|entry|post|story)[-_]{1,2}(?:header|heading|title)", re.I)  # of the article itself: its text stays
MAIN_NAME = re.compile(r"article|content|entry|main|post|story|body-?text", re.I)
NOISE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}

# A quote opens a value after an equals sign only, and one that nothing closes is a letter like any other.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)


class Node:
    """An element. Its path is kept as a step, a hash and a length, and spelt out on demand: pages nest deep."""

    __slots__ = ("tag", "step", "key", "length", "parent", "noise", "left_out", "named", "parts", "chars", "links", "blocks", "main")

    def __init__(self, tag: str, step: str, parent: Node | None, left_out: bool, named: bool, main: bool) -> None:
        self.tag, self.step, self.parent, self.main = tag, step, parent, main
        self.key = hash((parent.key, step)) if parent and step else parent.key if parent else hash("")
        self.length = (parent.length if parent else 0) + (len(step) + 1 if step else 0)
        self.left_out, self.named = left_out, named  # by element or role, its own or one around it; by its own name
        self.noise = left_out or named or bool(parent and parent.noise)
        self.parts: list = []  # strings, child nodes, and None for the edge of a block
        self.chars = self.links = self.blocks = 0

    @property
    def path(self) -> str:
        steps, node = [], self
        while node:
            if node.step:
                steps.append(node.step)
            node = node.parent
        return "".join(f">{x}" for x in reversed(steps))


def key_of(path: str) -> int:
    """The key of a node with this path."""
    key = hash("")
    for step in path.split(">")[1:]:
        key = hash((key, step))
    return key


def _general(tag: str, names: str) -> str:
    kept = [re.sub(r"\d+", "#", c.lower()) for c in names.split()]
    return ".".join([tag, *sorted(c for c in set(kept) if c.strip("#-_"))])


def _noise_name(names: str) -> bool:
    """Whether the classes and id of an element mark it as no part of the text.

    A name of main text in the same element outweighs names that only hold a word of noise (content sidebar-left), not
    such a word alone (content sidebar). What an element has (has-sidebar) says nothing of what it is.
    """
    words = [x for x in names.split() if not MODIFIER.match(x) and not OWN_HEADER.fullmatch(x)]
    noise, aside = ([x for x in words if p.search(x)] for p in (NOISE_NAME, ASIDE_NAME))
    if any(NOISE_ALONE.fullmatch(x) for x in noise):
        return True
    return bool(noise or aside) and not any(MAIN_NAME.search(x) for x in words if x not in noise and x not in aside)


def parse(text: str) -> Node:
    """A tolerant tree of a page: unclosed elements end with their parent, stray end tags are ignored."""
    root = Node("", "", None, False, False, False)
    top, at = root, 0
    still_open: dict[str, int] = {}  # how often each element is open: what isn't is not looked for
    endless: set[str] = set()  # elements that nothing ends from here on

    def close(node: Node) -> None:
        """Close all that is open inside node."""
        nonlocal top
        while top is not node:
            still_open[top.tag] -= 1
            top = top.parent

    def is_open(tags: set[str]) -> bool:
        return any(still_open.get(t) for t in tags)

    def say(raw: str) -> None:
        if raw:
            top.parts.append(htmllib.unescape(raw))

    while m := TOKEN.search(text, at):
        say(text[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        if m[1]:
            if still_open.get(tag):
                node = top
                while node.tag != tag:
                    node = node.parent
                close(node.parent)
            elif tag in ("p", "br"):
                top.parts.append(None)
            continue
        attrs = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3] else {}
        if tag in VOID:
            if tag in BLOCKS:
                top.parts.append(None)
            continue
        if tag in BLOCKS and tag not in CLOSED_BY_SIBLING:
            if is_open(LINES):
                close(_close_paragraph(top))
        elif is_open(CLOSED_BY_SIBLING.get(tag, set())):
            node = top
            while node.parent and node.tag not in CLOSED_BY_SIBLING[tag] | {"ul", "ol", "dl", "table", "select"}:
                node = node.parent
            if node.parent and node.tag in CLOSED_BY_SIBLING[tag]:
                close(node.parent)
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        left_out = top.left_out or tag in NOISE or tag in SKIPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in NOISE_ROLES
        named = tag not in ("html", "body", "main", "article") and _noise_name(names)
        node = Node(tag, _general(tag, attrs.get("class", "")) if tag in BLOCKS else "", top, left_out, named, tag in ("article", "main") or bool(names and MAIN_NAME.search(names)))
        top.parts.append(node)
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            if not end:
                endless.add(tag)
            # Without an end, scripts and styles run to the page's end; what else is open there is taken for a stray tag.
            at = end.end() if end else len(text) if tag in ("script", "style") else at
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        top = node
        still_open[tag] = still_open.get(tag, 0) + 1
    say(text[at:])
    return root


def _close_paragraph(top: Node) -> Node:
    node = top
    while node.parent and node.tag not in LINES and node.tag not in BLOCKS:
        node = node.parent
    return node.parent if node.parent and node.tag in LINES else top


def blocks_of(node: Node, around: bool = True) -> list[str]:
    """The texts of a node's blocks in page order, without noise; white space inside a block is one space. Not around: what stands around the node says nothing of its inside."""
    out: list[str] = []
    text: list[str] = []

    def end() -> None:
        if joined := " ".join("".join(text).split()):
            out.append(joined)
        text.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            text.append(x)
        elif (x.noise if around else x.left_out or x.named) and x is not node:
            if x.tag in BLOCKS:
                end()
        else:
            edge = [None] if x.tag in BLOCKS else []
            todo += [*edge, *reversed(x.parts), *edge]
    end()
    return out


def containers(root: Node) -> list[Node]:
    """Containers that hold text and are no noise, in page order, with the words, link words and blocks under them. To be called once a page."""
    todo, order = [root], []
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in reversed(x.parts) if isinstance(c, Node) and not c.noise]
    for x in reversed(order):
        own = sum(len(s.split()) for s in x.parts if isinstance(s, str))
        x.chars += own
        x.links += own if x.tag == "a" else 0
        if x.parent:
            x.parent.chars += x.chars
            x.parent.links += x.chars if x.tag == "a" else x.links
            x.parent.blocks += x.blocks + (x.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "li") and x.chars > 0)
    return [x for x in order if x.tag in CONTAINERS and x.chars]


def score(x: Node, page: Node) -> float:
    """How much of the page's text a container holds, less its links; a container marked as main text counts double, and body less."""
    share = x.chars / max(page.chars, 1)
    kind = 2.0 if x.main else 0.6 if x.tag == "body" else 1.0
    return kind * share * (1 - x.links / max(x.chars, 1)) * (1 + min(x.blocks, 20) / 40)


def best_container(root: Node, found: list[Node]) -> Node | None:
    return max(found, key=lambda x: (score(x, root), x.length), default=None)


def extract(text: str | None, winners: list[str]) -> str:
    """The main text of one page: the first of the winning paths that it has, else its best container, else all that is no noise.

    A winning path must hold LEAST_SHARE of the best container's words. A page whose text all lies in elements
    that their names mark as noise gives the text of the one of them with most words, without the noise inside it.
    """
    root = parse(text or "")
    found = containers(root)
    own = best_container(root, found)
    by_key: dict[int, list[Node]] = {}
    for x in found:
        by_key.setdefault(x.key, []).append(x)
    chosen = next((nodes for path in winners if (nodes := by_key.get(key_of(path))) and nodes[0].path == path and sum(n.chars for n in nodes) >= LEAST_SHARE * (own.chars if own else 0)), [own or root])
    return " ".join(b for n in chosen for b in blocks_of(n)) or _largest_named(root)


def _largest_named(root: Node) -> str:
    """The text of the outermost element marked by its name that has most words (of equal ones the first)."""
    todo, best = [root], ""
    while todo:
        x = todo.pop()
        if x.named and not x.left_out:
            text = " ".join(blocks_of(x, around=False))
            if len(text.split()) > len(best.split()):
                best = text
        elif not x.left_out:
            todo += [c for c in reversed(x.parts) if isinstance(c, Node)]
    return best


def host_of(url):
    """The host of a URL column, lower-cased; null and odd URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """The up to WINNERS paths of each host by votes: host, winners (array of string), one row per host."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[str, str], int] = {}
            for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and (best := best_container(root := parse(text), containers(root))) is not None:
                    counts[host, best.path] = counts.get((host, best.path), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["host", "path", "votes"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    first = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    top = votes.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= WINNERS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("winners"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty html give an empty text, and null or odd URLs are one host; repeated rows give repeated rows, a
    table without rows gives none. Of paths with equal votes the first in code-point order leads. A page is read
    whole, however long. Other columns are not read, so they may have any name.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    winners = stage(host_paths(p), "host-paths")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("winners", "")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = p.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(t, w or []) for t, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "winners").mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
