"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. Per path, characters outside links and punctuation are added up and
divided by the number of nodes; the two ratios are smoothed along the page's order of paths, fused by their product, and
compared with a share of their mean. Text nodes of paths above it are content; the page's main block is the smallest
element that covers nearly all of it (an article or main element needs to cover half). Of its blocks without content,
those made of links go; what a block keeps, it keeps whole. Menus, adverts, forms, notices and comments, told by their element or class, take no part.

One pass over the page, one over its elements: both linear in the page's length, however tags are left open.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style textarea title noscript iframe xmp noembed noframes".split()}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that may be the main block.
HOLDERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hgroup li td th tr tbody thead tfoot table ul ol dl dt dd blockquote pre caption figcaption figure summary address".split())
#: Elements whose text is never content; a header is the page's unless it is an article's own.
NOISE = frozenset("nav header footer aside form script style noscript iframe template select button textarea head title svg canvas object menu dialog option datalist label audio video math".split())
#: Words of class, id and role that tell the same, and words that only go with them.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion promoted sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended "
    "comment comments commentlist disqus respond reply replies complementary contentinfo search pagination pager widget widgets toolbar alert skip-link".split()
)
WITH_NOISE = frozenset("site page main global top bottom left right list item items link links button buttons bar box container wrapper wrap area section block slot posts form inner outer row column panel message icons media primary secondary skip to up 1 2 3".split())
#: Words that tell it at either end of a name, and words that say the contrary.
PLAIN_NOISE = frozenset("ad ads advert adverts advertisement advertisements banner comment comments commentlist cookie cookies consent disqus login newsletter promo promos related signup sponsor sponsored subscribe subscription".split())
CONTRARY = frozenset("no not without with has content article articlebody entry story main".split())
#: What closes an open <p>.
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
#: Elements that end an open one of their kind, by kind; and those inside which a kind starts anew.
KINDS = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3, "option": 4, "p": 5}
ANEW = {"ul": (0,), "ol": (0,), "menu": (0,), "dl": (1,), "table": (2, 3), "tbody": (2, 3), "thead": (2, 3), "tfoot": (2, 3), "tr": (3,), "select": (4,), "datalist": (4,)}
STOPS = frozenset(".,;:!?…。、，；：！？")
SPACE = re.compile(r"\s+")
#: Share of the mean ratio that makes content; shares of the content that the main block, and an article, cover.
THRESHOLD, COVER, ARTICLE = 0.5, 0.95, 0.5


class Node:
    """An element: its number, tag, parent, path, kind of noise, whether it is in noise and in a link, and open elements."""

    __slots__ = ("number", "tag", "parent", "path", "own", "noise", "link", "open")

    def __init__(self, number: int, tag: str, parent: Node | None, path: int, own: int):
        self.number, self.tag, self.parent, self.path, self.own = number, tag, parent, path, own
        # What never is content holds none; the rest is settled when the page is known.
        self.noise = own == 2 or (parent is not None and parent.noise)
        self.link = tag == "a" or (parent is not None and parent.link)
        here = parent.open if parent else (None,) * 6
        anew = (*ANEW.get(tag, ()), *((5,) if tag in BLOCKS and tag != "p" else ()))
        if anew or tag in KINDS:
            own = [None if k in anew else x for k, x in enumerate(here)]
            if tag in KINDS:
                own[KINDS[tag]] = self
            here = tuple(own)
        self.open = here


def noisy_name(word: str) -> bool:
    """Whether a word of a class names what is no content: by itself, in parts which all say so or go with it, or in parts of
    which the first or the last is plain enough (comment-body, reader-comments) and none says the contrary."""
    if word in NOISE_WORDS:
        return True
    parts = re.split("[-_]", word)
    if len(parts) < 2 or not CONTRARY.isdisjoint(parts):
        return False
    return parts[0] in PLAIN_NOISE or parts[-1] in PLAIN_NOISE or (any(p in NOISE_WORDS for p in parts) and all(p in NOISE_WORDS or p in WITH_NOISE for p in parts))


def noise_of(tag: str, attributes: str, in_article: bool) -> int:
    """2 for what is never content, 1 for what its class calls noise, else 0."""
    if tag in NOISE and not (tag == "header" and in_article):
        return 2
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return 2
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and any(map(noisy_name, value.split())):
            return 1
    return 0


def parse(page: str) -> tuple[list[Node], list[tuple[Node, int, str]]]:
    """Elements in page order, and text nodes: element, number of the block, decoded text."""
    nodes, texts = [Node(0, "", None, 0, 0)], []
    paths: dict[tuple[int, str], int] = {}
    here, at, block, end, opened, articles = nodes[0], 0, 0, len(page), Counter(), 0

    def text(a: int, z: int) -> None:
        if a < z:
            x = page[a:z]
            texts.append((here, block, _html.unescape(x) if "&" in x else x))

    def close(node: Node) -> None:
        nonlocal here, articles
        while here is not node:
            opened[here.tag] -= 1
            articles -= here.tag in ("article", "main")
            here = here.parent
        opened[node.tag] -= 1
        articles -= node.tag in ("article", "main")
        here = node.parent

    while at < end:
        lt = page.find("<", at)
        while lt >= 0 and not (page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] in ("/", "!", "?")):
            lt = page.find("<", lt + 1) if lt + 1 < end else -1
        if lt < 0:
            text(at, end)
            break
        text(at, lt)
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        m = TAG.match(page, lt) or START.match(page, lt)
        gt = m.end() - 1 if m and m.re is TAG else page.find(">", lt)
        if gt < 0:
            text(lt, end)
            break
        at = gt + 1
        if not m:
            continue
        tag, attributes = m[2].lower(), page[m.end(2) : gt]
        if m[1]:
            if opened[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            block += tag in BLOCKS
            continue
        if tag in VOID:
            block += tag == "hr"
            if tag == "br":
                texts.append((here, block, " "))
            continue
        block += tag in BLOCKS
        if tag in CLOSES_P and here.open[5] is not None:
            close(here.open[5])
        kind = KINDS.get(tag)
        if kind is not None and tag != "p":
            last = here.open[kind] or (here.open[3] if tag == "tr" else None)
            if last is not None:
                close(last)
        if attributes.endswith("/") and tag in ("svg", "path", "math", "use"):
            continue
        own = 0 if here.noise else noise_of(tag, attributes, articles > 0)
        here = Node(len(nodes), tag, here, paths.setdefault((here.path, tag), len(paths) + 1), own)
        nodes.append(here)
        opened[tag] += 1
        articles += tag in ("article", "main")
        if tag in RAW:
            shut = RAW[tag].search(page, at)
            stop = shut.start() if shut else end
            if not here.noise:
                text(at, stop)
            at = shut.end() if shut else end
            close(here)
    return nodes, texts


def solid(text: str) -> int:
    """Characters that are no white space."""
    return len(SPACE.sub("", text))


def path_ratios(texts: list[tuple[Node, int, str]]) -> dict[int, float]:
    """The fused ratio of each path, from text nodes."""
    sums: dict[int, list[float]] = {}
    for n, _, t in texts:
        if size := solid(t):
            r = sums.setdefault(n.path, [0.0, 0.0, 0.0])
            r[0] += 0 if n.link else size
            r[1] += sum(map(t.count, STOPS))
            r[2] += 1
    per = [(a / n, b / n) for a, b, n in sums.values()]
    out = {}
    for i, p in enumerate(sums):
        near = [(math.exp(-((i - j) ** 2) / 2), per[j]) for j in range(max(0, i - 2), min(len(per), i + 3))]
        whole = sum(w for w, _ in near)
        out[p] = sum(w * r[0] for w, r in near) / whole * (1 + sum(w * r[1] for w, r in near) / whole)
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, one block a line; empty if there is none."""
    if not page:
        return ""
    nodes, every = parse(page)
    # What a class calls noise is none where it holds the page's title or article, or all that is left.
    last, titled = list(range(len(nodes))), [n.tag in ("h1", "article", "main") for n in nodes]
    for n in reversed(nodes[1:]):
        last[n.parent.number] = max(last[n.parent.number], last[n.number])
        titled[n.parent.number] |= titled[n.number]
    never = [n.noise for n in nodes]
    for lift_all in (False, True):
        for n in nodes[1:]:
            n.noise = never[n.number] or n.parent.noise or (n.own == 1 and not titled[n.number] and not lift_all)
        texts = [x for x in every if not x[0].noise]
        if any(solid(t) for _, _, t in texts):
            break
    fused = path_ratios(texts)
    if not fused:
        return ""
    level = THRESHOLD * sum(fused.values()) / len(fused)
    chosen = {p for p, x in fused.items() if x >= level}
    content, linked, kept = [0] * len(nodes), set(), set()
    for n, b, t in texts:
        if n.path in chosen:
            content[n.number] += solid(t)
        # A block with links stays for words of a chosen path, or outside of links.
        if any(map(str.isalnum, t)):
            (kept if n.path in chosen or not n.link else linked).add(b)
    for n in reversed(nodes[1:]):
        content[n.parent.number] += content[n.number]
    total = content[0]
    best = nodes[0]
    for n in nodes[1:]:
        # Elements are numbered in page order, so the innermost one that covers enough comes last.
        if n.tag in HOLDERS and n.number <= last[best.number] and content[n.number] >= (ARTICLE if n.tag in ("article", "main") else COVER) * total:
            best = n
    blocks: dict[int, list[str]] = {}
    for n, b, t in texts:
        if best.number <= n.number <= last[best.number] and (b in kept or b not in linked):
            blocks.setdefault(b, []).append(t)
    return "\n".join(x for b in blocks.values() if (x := SPACE.sub(" ", "".join(b)).strip()))


def extract_text(pages: DataFrame) -> DataFrame:
    """All columns of pages (it needs html) and text, the main text of each page; a null or empty html gives an empty text.

    One page is one row of work: no shuffle, and nothing is cut. A column named text is replaced.
    """
    rest = [c for c in pages.columns if c not in ("html", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x) for x in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), text], [*rest, "text"])

    schema = pages.select(*rest).withColumn("text", F.lit("")).schema
    return pages.select(*rest, F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
