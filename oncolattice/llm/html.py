"""Main text of web pages by tag-path ratios.

A page's text falls into blocks, each with the path of block elements from the root. Per path, text length
and punctuation per block are aggregated, smoothed over paths that are close in the tree, fused by their
product, and thresholded against the page's best path.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z""", re.S)
RAW = frozenset("script style textarea title noscript template iframe svg select button object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var
    math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mfenced mpadded""".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table".split())
APART = frozenset("nav footer aside form dialog menu head".split())  # no part of an article's text, but see main_text
WHOLE = frozenset("html body article main".split())  # labels of these say nothing about their text
OWN_TEXT = frozenset("p li td th dt dd caption figcaption blockquote pre summary h1 h2 h3 h4 h5 h6".split())  # short ones go with their section
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table".split())
ROLES = re.compile(r"""(?<![\w:.-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SIGNS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb
    breadcrumbs sidebar footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe share sharing social
    related comment comments disqus reply replies complementary contentinfo search pagination pager widget""".split())
READERS = frozenset("comment comments disqus reply replies".split())
ABOUT = frozenset("has no not with without hide show is".split())  # such a word before a sign says that a part lies near, not that this is it
BLOCK_START = re.compile(r"<(?:body|main|article|section|div|p|h[1-6]|ul|ol|dl|table|blockquote|header|nav|form)(?=[\s>/])", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？¿¡]")
SPACE = re.compile(r"\s+")

WIDTH = 1.0       # of the smoothing over distances in the tree
THRESHOLD = 0.05  # of the best path's score


def _sign(tag: str, attributes: str, inside: bool) -> int:
    """0: nothing speaks against the element's text; 1: its tag or a label does; 2: readers wrote it. `inside` an article a header is its own."""
    if tag in WHOLE:
        return 0
    found = {"header"} if tag == "header" else set()
    if attributes and "=" in attributes:
        for m in ROLES.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = re.split(r"[^a-z]+", name)
                found.update(w for k, w in enumerate(words) if w in SIGNS and not (k and words[k - 1] in ABOUT))
    if inside:
        found.discard("header")
    return 2 if found & READERS else 1 if found or tag in APART else 0


class Page:
    """Blocks of a page in order (path of tags, text, innermost element, characters in links) and the tree of its block elements."""

    def __init__(self, page: str):
        self.found: list[tuple[tuple, str, int, int]] = []
        self.parent, self.tag, self.sign = [], [], []
        self._read(page)

    def up(self, element: int):
        """The element and those around it."""
        while element >= 0:
            yield element
            element = self.parent[element]

    def apart(self) -> list[bool]:
        """Elements in parts set apart. A sign is overruled where the element holds an article's text, or, on a page without
        article or main element, most of the page's sentences; never where readers wrote it, nor for menus, footers and asides."""
        n = len(self.tag)
        sentences, whole, total, plain = [0] * n, [False] * n, 0, True
        for path, text, element, linked in self.found:
            plain = plain and "article" not in path and "main" not in path
            size = len(text) - linked if PUNCTUATION.search(text) else 0
            total += size
            if size:
                article = False
                for e in self.up(element):
                    sentences[e] += size
                    whole[e] |= article
                    article |= self.tag[e] in ("article", "main") and self.sign[e] != 2
        out = [False] * n
        for e in range(n):
            free = whole[e] or plain and 2 * sentences[e] > total and (self.tag[e] == "form" or self.tag[e] not in APART)
            out[e] = self.parent[e] >= 0 and out[self.parent[e]] or self.sign[e] > 0 and not (self.sign[e] == 1 and free)
        return out

    def _read(self, page: str) -> None:
        stack, parts, at = [], [], 0  # stack: block elements (tag, number)
        links, linked = 0, 0

        def flush():
            nonlocal linked
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                self.found.append((tuple(t for t, _ in stack), text, stack[-1][1] if stack else -1, min(linked, len(text))))
            linked = 0

        def pop(tags, stop=()):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    del stack[k:]
                    return
                if stack[k][0] in stop:
                    return

        while m := TOKEN.search(page, at):
            parts.append(page[at:m.start()])
            if links > 0:
                linked += m.start() - at
            at = m.end()
            end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in RAW and not end:
                if not attributes.endswith("/"):  # one that is never closed ends where the next block starts
                    close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                    start = None if close else BLOCK_START.search(page, at)
                    at = close.end() if close else start.start() if start else len(page)
                continue
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if end else 1
            elif tag in INLINE or tag in RAW:
                continue
            elif tag in VOID:
                if tag == "hr":
                    flush()
            else:
                flush()
                if end:
                    pop((tag,))
                else:
                    if tag in CLOSES_P:
                        pop(("p",), SCOPE | {"td", "th"})
                    if tag in SAME:
                        pop(SAME[tag], SCOPE)
                    self.parent.append(stack[-1][1] if stack else -1)
                    self.tag.append(tag)
                    self.sign.append(_sign(tag, attributes, any(t in ("article", "main") for t, _ in stack)))
                    stack.append((tag, len(self.tag) - 1))
        parts.append(page[at:])
        flush()


def main_text(page: str, width: float = WIDTH, threshold: float = THRESHOLD) -> str:
    """Blocks of the content nodes, in page order, joined by newlines.

    Blocks in parts set apart do not count. Paths whose fused score reaches the threshold are content; the element around all of them, or the
    article or main element that holds it, is the article, and its list items, cells, headings and short paragraphs go with
    it unless they are mostly links. Loose text of another path is left out, and loose text whose path has no punctuation at all.
    """
    tree = Page(page)
    away = tree.apart()
    found = [b for b in tree.found if b[2] < 0 or not away[b[2]]]
    own: dict[tuple, list] = {}
    for path, text, _, _ in found:
        sums = own.setdefault(path, [0, 0, 0])
        sums[0] += len(text)
        sums[1] += len(PUNCTUATION.findall(text))
        sums[2] += 1
    if not own:
        return ""
    # distances of more than a few steps weigh nothing, so paths are only compared within a subtree
    ratio = {p: (c / n, (1 + k) / n) for p, (c, k, n) in own.items()}
    reach = math.ceil(4 * width)
    under: dict[tuple, list] = {}
    for p in ratio:
        for up in range(min(reach, len(p)) + 1):
            under.setdefault(p[:len(p) - up], []).append(p)
    score = {}
    for p in ratio:
        seen = {}
        for up in range(min(reach, len(p)) + 1):
            root = p[:len(p) - up]
            for q in under[root]:
                d = up + len(q) - len(root)
                if q not in seen and d <= reach:
                    seen[q] = math.exp(-d * d / (2 * width * width))
        length = sum(w * ratio[q][0] for q, w in seen.items())
        punctuation = sum(w * ratio[q][1] for q, w in seen.items())
        score[p] = length * punctuation
    least = threshold * max(score.values())
    root = None
    for path, _, element, _ in found:
        if score[path] >= least:
            around = [e for e in tree.up(element) if tree.tag[e] not in OWN_TEXT][::-1]
            root = around if root is None else [x for x, y in zip(root, around) if x == y]
    article = [k for k, e in enumerate(root) if tree.tag[e] in ("article", "main")]
    root = root[article[-1]] if article else root[-1] if root else -1
    lists: dict[int, list] = {}
    for _, text, element, linked in found:
        for e in tree.up(element):
            if tree.tag[e] in LISTS:
                sums = lists.setdefault(e, [0, 0])
                sums[0] += len(text)
                sums[1] += linked
                break

    marked = any(own[path][1] for path in own)

    def belongs(path, text, element, linked):
        if score[path] >= least and (not marked or own[path][1] or path[-1:] and path[-1] in OWN_TEXT or "article" in path or "main" in path):
            return True
        if not path or path[-1] not in OWN_TEXT:
            return False
        around = list(tree.up(element))
        if root >= 0 and root not in around:
            return False
        outer = next((e for e in around if e in lists), None)
        if outer is not None and path[-1] not in HEADINGS:
            return 2 * lists[outer][1] <= lists[outer][0]
        return path[-1] in HEADINGS or 2 * linked <= len(text)

    return "\n".join(b[1] for b in found if belongs(*b))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    The whole html is read; a null or empty page has the empty text. Character references are decoded, white
    space in a block is one space, blocks are joined by one newline; nothing else is dropped or cut. Text of
    unclosed or truncated pages is taken as far as it goes. Each row stands for itself; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(p, **options) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
