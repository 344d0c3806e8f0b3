"""Main text of HTML pages by site template removal.

Every element's subtree is hashed from its tags, names and text, and Spark counts on how many different pages
of a host it stands, and beside how many different stories: what the page's longest blocks outside of it
say. Subtrees that recur beside many stories of their host, in the article and outside, are template and
deleted: menus, notices, footers and whatever else a site repeats. Copies and near copies of a page make no
template, since their parts recur beside the same story.

Elements whose content changes from page to page, such as comments, recur by their names alone: one that
is named as something other than the article goes if so named an element stands on many pages of the host. On
hosts with too few pages for anything to recur, the name decides. What HTML itself declares not to be the
article (``nav``, ``form``, ``script``, hidden elements) always goes.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sorted_store, worker
from .wordbytes import AT_ONCE, mix64

#: different stories beside which a subtree of a host's template stands, at least
LEAST_STORIES = 10
#: words that a paragraph, list or table must have to be told from others by its text
LEAST_WORDS = 5
#: what a task has lately handed on, and hands on once, at most
HELD = 500_000

# fixed values: kinds of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend li dd dt tbody td tfoot th thead tr".split())
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption b i em strong a code span sub sup u s q cite abbr mark small".split())
NEVER = frozenset("script style noscript template svg math canvas iframe object applet audio video map head title nav footer aside form button select option textarea input dialog menu search".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status note".split())
NOT_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer topbar toolbar comment comments respond reply replies disqus "
    "sharing related recommended recommendations newsletter subscribe subscription signup login pagination pager rail teaser teasers paywall".split()
)
#: these are also subjects of articles, so they never name away most of a page's text or a marked article
DOUBTFUL_NAMES = frozenset("promo promotion banner notice notices notification alert discussion share social search skip disclaimer copyright legal privacy trending popular feedback rating poll survey donate".split())
#: beginnings of names that say what an element has or is filed under
_ABOUT = re.compile(r"(?:has|with|without|no|is|category|tag|topic|section|format|type|status)[-_]")
ARTICLE_NAMES = frozenset("article content post entry story main".split())
HEADERS = frozenset(("header", "masthead"))

_MARKUP = re.compile(
    r"<(?:!--(?:.*?--!?>|.*\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*+(?:>|\Z))|[!?/][^>]*+(?:>|\Z))", re.S
)
_ATTR = re.compile(r"([a-zA-Z][^\s=>/\"']*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAMED = re.compile(r"\b(?:class|id|role|hidden|style|aria-hidden|itemprop)\b", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "items", "names", "role", "hidden", "body", "hash", "size", "words", "first", "last")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.items = tag, parent, []
        self.names = self.role = ""
        self.hidden = self.body = False
        self.hash = self.size = self.words = self.first = self.last = 0


def _read_names(node: Node, attrs: str) -> None:
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name in ("class", "id"):
            node.names += f" {value}"
        elif name == "role":
            node.role = value.strip().lower()
        elif name == "itemprop":
            node.body = value.strip().lower() == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.hidden = True


def parse(page: str) -> Node:
    """The page's element tree; missing end tags are implied, end tags without a start are dropped."""
    root = Node("#root", None)
    here, at = root, 0
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            here.items.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            up = here
            while up is not root and up.tag != tag:
                # the end of an inline element doesn't end the blocks in it
                if tag not in BLOCK and up.tag in BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in CLOSES_P:
            here = _close(here, ("p",), ("table", "td", "th", "button", "object", "#root"))
        elif tag in CLOSED_BY:
            here = _close(here, *CLOSED_BY[tag])
        node = Node(tag, here)
        here.items.append(node)
        if (attrs := m["attrs"]) and len(attrs) > 1 and _NAMED.search(attrs):
            _read_names(node, attrs)
        if tag in VOID or (attrs or "").endswith("/>") and tag in ("path", "rect", "circle", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag in ("textarea", "title"):
                node.items.append(entities.unescape(page[at:stop]))
            at = page.find(">", stop) + 1 if end else stop
            if not at:
                at = len(page)
            continue
        here = node
    if at < len(page):
        here.items.append(entities.unescape(page[at:]))
    return root


def _close(here: Node, tags, stop) -> Node:
    """Where a new element goes if it ends the outermost open element of ``tags`` inside ``stop``."""
    up, out = here, here
    while up.parent is not None and up.tag not in stop:
        if up.tag in tags:
            out = up.parent
            if tags == ("p",):
                break
        up = up.parent
    return out


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x02".join(parts).encode("utf-8", "surrogatepass"))


def measure(root: Node) -> list[Node]:
    """Sets each element's subtree hash, its length and words of text, and the numbers of its first and last element
    in the order of the page; gives the elements, children before parents."""
    order, waiting = [], [root]
    while waiting:
        n = waiting.pop()
        n.first = n.last = len(order)
        order.append(n)
        waiting += [c for c in reversed(n.items) if isinstance(c, Node)]
    order.reverse()
    for n in order:
        parts = [n.tag, n.names, n.role]
        for c in n.items:
            if isinstance(c, Node):
                parts.append(f"\x01{c.hash:x}")
                n.last = max(n.last, c.last)
                if c.tag not in NEVER or c.tag in ("nav", "footer", "aside", "form"):
                    n.size += c.size
                    n.words += c.words
            elif words := c.split():
                plain = " ".join(words)
                parts.append(plain)
                n.size += len(plain)
                n.words += len(words)
        n.hash = _hash(*parts)
    return order


def shingle_hashes(words: list[str], size: int = 5) -> np.ndarray:
    """Hashes of the shingles of a list of words, or of all of them if they are fewer than a shingle."""
    of = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in dict.fromkeys(words)}
    x = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix64(h + x[k : k + n])
    return h


def longest_blocks(order: list[Node], k: int = 3) -> list[tuple[int, int, int, int]]:
    """(number, hash, least and largest hash of a shingle of five words) of the k blocks with the most words, longest
    first, of equal ones the first in the page."""
    of: dict[int, int] = {}
    words: dict[int, list[str]] = {}
    for n in reversed(order):
        block = of[n.first] = n.first if n.tag in BLOCK or n.parent is None else of[n.parent.first]
        if n.tag not in NEVER:
            for c in n.items:
                if isinstance(c, str):
                    words.setdefault(block, []).extend(c.split())
    out = []
    for number in sorted((b for b, w in words.items() if w), key=lambda b: (-len(words[b]), b))[:k]:
        shingles = shingle_hashes(words[number])
        out.append((number, _hash(*words[number]), int(shingles.min()), int(shingles.max())))
    return out


def may_recur(n: Node) -> bool:
    """Whether a recurring subtree tells something: it has text, and more than a few words if it is prose."""
    return bool(n.size) and n.tag not in ("#root", "html", "body", "head", "title", "script", "style") and (n.tag not in PROSE or n.words >= LEAST_WORDS)


def _names(node: Node) -> set[str]:
    return {p.lower() for name in node.names.split() if not _ABOUT.match(name) for p in _PART.findall(name)} if node.names else set()


def _slot(n: Node) -> int:
    """The hash of an element's tag and names, whatever is in it."""
    return _hash("slot", n.tag, n.names, n.role)


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("main", "article") or node.body


def _is_named(n: Node) -> bool:
    """Whether the names say that the element isn't the article (of headers only outside of it)."""
    return n.tag == "header" or bool(n.names) and bool(_names(n) & (NOT_ARTICLE_NAMES | DOUBTFUL_NAMES | HEADERS))


def subtrees(order: list[Node]) -> dict[int, Node]:
    """What a host's pages may share: the hashes of subtrees and slots, with the first element of each."""
    out: dict[int, Node] = {}
    for n in reversed(order):
        if may_recur(n):
            out.setdefault(n.hash, n)
        if _is_named(n):
            out.setdefault(_slot(n), n)
    return out


def stories(order: list[Node], nodes) -> list[tuple[int, int]]:
    """(page, story) beside each of some elements, or beside nothing, as told by the two longest blocks outside of it:
    copies of a page have one page, and near copies (of which four shingles in five are the same) mostly one story."""
    blocks, known = longest_blocks(order), {}

    def outside(n: Node | None) -> tuple[int, int]:
        two = tuple(b for b in blocks if n is None or not n.first <= b[0] <= n.last)[:2]
        if two not in known:
            known[two] = _hash(*(f"{b[1]:x}" for b in two)), _hash(f"{two[0][2]:x}", f"{two[-1][3]:x}") if two else 0
        return known[two]

    return [outside(n) for n in nodes]


def main_text(page: str | None, recurs: frozenset[int] | set[int] = frozenset(), few_pages: bool = True) -> str:
    """The text of the page's article, one block a line. ``recurs``: the subtrees and slots of the host's template;
    ``few_pages``: whether the host has too few pages to have one. Of equal candidates the first one is the article."""
    if not page:
        return ""
    root = parse(page)
    return _main_text(root, measure(root), recurs, few_pages)


def _main_text(root: Node, order: list[Node], recurs, few_pages: bool) -> str:
    holds_main: set[int] = set()
    for n in order:
        if _is_main(n) and not _names(n) & NOT_ARTICLE_NAMES:
            up = n
            while up is not None and id(up) not in holds_main:
                holds_main.add(id(up))
                up = up.parent

    def named_away(n: Node, inside: bool) -> bool:
        if id(n) in holds_main or not _is_named(n) or not few_pages and _slot(n) not in recurs:
            return False
        names = _names(n)
        if names & NOT_ARTICLE_NAMES:
            return n.size < root.size
        return bool(names & DOUBTFUL_NAMES) and 2 * n.size < root.size or not inside and (n.tag == "header" or bool(names & HEADERS)) and n.size < root.size

    # what goes, from the outside in, and what then is left of each element
    gone: set[int] = set()
    inside: set[int] = set()
    for n in reversed(order):
        up = id(n.parent)
        if up in gone:
            gone.add(id(n))
            continue
        if up in inside or _is_main(n) and id(n) in holds_main:
            inside.add(id(n))
        if n is not root and (n.hidden or n.tag in NEVER or n.role in NOT_ARTICLE_ROLES or may_recur(n) and n.hash in recurs or named_away(n, id(n) in inside)):
            gone.add(id(n))
    left: dict[int, int] = {}
    for n in order:
        if id(n) not in gone:
            left[id(n)] = sum(left.get(id(c), 0) if isinstance(c, Node) else len("".join(c.split())) for c in n.items)
    # in the order of the page: the largest marked element, or one inside it that has most of it
    kept = [n for n in reversed(order) if id(n) in left]
    start = root
    marked = [n for n in kept if _is_main(n)]
    if marked:
        start = max(marked, key=lambda n: left[id(n)])
        inner = max((n for n in marked if n is not start and _within(n, start)), key=lambda n: left[id(n)], default=None)
        if inner is not None and 2 * left[id(inner)] >= left[id(start)]:
            start = inner
    else:
        named = [n for n in kept if n.tag in ("div", "section") and 2 * left[id(n)] >= left[id(root)] > 0 and _names(n) & ARTICLE_NAMES]
        start = max(named, key=lambda n: left[id(n)], default=root)
    return _blocks(start, lambda n: id(n) in gone)


def _within(n: Node, outer: Node) -> bool:
    while n is not None:
        if n is outer:
            return True
        n = n.parent
    return False


def _blocks(start: Node, gone) -> str:
    lines, words = [], []

    def end():
        if line := " ".join("".join(words).split()):
            lines.append(line)
        words.clear()

    waiting: list = [iter(start.items)]
    tags = [start.tag]
    while waiting:
        c = next(waiting[-1], None)
        if c is None:
            waiting.pop()
            if tags.pop() in BLOCK:
                end()
        elif isinstance(c, str):
            words.append(c)
        elif c.tag == "br":
            words.append(" ")
        elif not gone(c):
            if c.tag in BLOCK:
                end()
            waiting.append(iter(c.items))
            tags.append(c.tag)
    end()
    return "\n".join(lines)


# -- Spark -------------------------------------------------------------------------------------------------


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", "html", F.xxhash64(F.coalesce(host, F.lit(""))).alias("host"))


def _keys(host: int, hashes: list[int]) -> np.ndarray:
    """What a subtree, or with 0 the host itself, is counted under: a hash of both."""
    return mix64(np.array(hashes, np.uint64) ^ mix64(np.array([host & (1 << 64) - 1], np.uint64)))


def _parsed(hosts: list[int], htmls: list[str | None]):
    """(index, root, elements, subtrees, keys of the host and of these) of pages with html, by slices of pages."""
    rows, size = [], 0
    for k, (host, page) in enumerate(zip(hosts, htmls)):
        if page:
            root = parse(page)
            order = measure(root)
            found = subtrees(order)
            rows.append((k, root, order, found, _keys(host, [0, *found])))
            size += len(page)
        if size >= AT_ONCE:
            yield rows
            rows, size = [], 0
    yield rows


def _counted(batches):
    worker.begin("html_template")
    seen: set[tuple[int, int, int]] = set()
    for b in batches:
        for rows in _parsed(b.column(0).to_pylist(), b.column(1).to_pylist()):
            new = set()
            for _, _, order, found, keys in rows:
                new.update((key, story, page) for key, (page, story) in zip(keys.tolist(), stories(order, [None, *found.values()])))
            new -= seen
            if len(seen) + len(new) > HELD:
                seen.clear()
            seen |= new
            cols = np.array(list(new), np.uint64).reshape(-1, 3).T.copy().view(np.int64)
            yield pa.record_batch(list(map(pa.array, cols)), names=["key", "story", "page"])


def counts(pages: DataFrame) -> DataFrame:
    """(key, pages, stories): on how many different pages of its host each subtree or slot stands, and with how many
    different stories. Rows are combined by page and story before they meet by key, so a hot host or menu is spread
    over all tasks."""
    x = _hosts(pages).where("html <> ''").select("host", "html").mapInArrow(_counted, "key long, story long, page long")
    x = x.distinct().groupBy("key", "story").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("key").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("stories"))


def templates(pages: DataFrame) -> sorted_store.Store:
    """The keys that recur: with ``LEAST_STORIES`` different stories, and with one for every other page at least."""
    often = (F.col("stories") >= LEAST_STORIES) & (2 * F.col("stories") >= F.col("pages"))
    return sorted_store.write(counts(pages).where(often).select(F.col("key").alias("hash"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), "templates")


def _extracted(recurring: sorted_store.Store):
    def run(batches):
        worker.begin("html_template")
        for b in batches:
            texts = [""] * b.num_rows
            for rows in _parsed(b.column(3).to_pylist(), b.column(2).to_pylist()):
                hits = recurring.values(np.concatenate([r[4] for r in rows]))[0] > 0 if rows else []
                at = 0
                for k, root, order, found, keys in rows:
                    big, *hit = hits[at : at + len(keys)].tolist()
                    at += len(keys)
                    texts[k] = _main_text(root, order, {h for h, x in zip(found, hit) if x}, not big)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Null or empty html gives an empty text; rows without an address, or with one that names no host, count as
    one host. Repeated rows each keep their row and count as one page of their host. Pages of any length are
    taken whole. Of articles of one length the first in the page is taken. Other columns are ignored; an empty
    table gives an empty one. Workers look a page's subtrees up in the stored template keys, so nothing is
    joined to the pages, and no task has a host to itself.
    """
    return _hosts(pages).mapInArrow(_extracted(templates(pages)), "page_id long, url string, text string, n_chars long")
