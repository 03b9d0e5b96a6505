"""Main text of web pages by tag-path ratios.

A page is one row, so all of its nodes are at hand in the task that reads it: the operator is one map without a
shuffle. Per page:

1. Nodes. The markup is read into blocks of text. A block's path is the chain of block tags above it with their first
   class, e.g. `body/article/p`; inline tags and line breaks stay inside a block.
2. Path ratios. Over all blocks of a path: characters per block, and punctuation marks per block.
3. Smoothing. Every block gets the two ratios of its path; both rows of numbers are smoothed in page order by a Gaussian.
4. Fusion. Both are divided by their page mean; the score of a block is their mean, the score of a path the mean of its
   blocks weighted by length. Text within links counts against a path by its share.
5. Threshold. Paths whose score exceeds LAMBDA standard deviations are content.
6. Region. The article is what the page marks as such: of several, the one with the largest sum of scores by length.
   On a page without such marks it is the smallest element around the content paths, from the first of their blocks (and
   a heading before it) to the last. All blocks of the region are kept, short ones too, but for boilerplate by tag, role
   or class, hidden elements, and paths that are mostly links.

Awkward rows: a null or empty page, or one without text, gives an empty text with n_chars 0; unclosed, crossed and cut
tags are closed as the tags around them demand; comments, scripts and styles never are text; repeated rows are
answered each; ids may be null or repeated; other columns are not read; text is never cut, at any length.
"""

from __future__ import annotations

import html as markup
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.batches import row_slices

# fixed values: element names of HTML by their role
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
EMBEDDED = frozenset("template noscript svg math object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = frozenset("head nav footer aside form dialog menu button select datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section main div".split())
# fixed values: words in class, id and role that name what is not the article
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs combx comment comments complementary consent contentinfo cookie cookies "
    "copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo "
    "promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
ARTICLE_BODY = frozenset("articlebody mainentity".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
PUNCTUATION = ".,;:!?…、。，！？"
DEPTH = 512  # deeper elements become siblings, as in browsers
LAMBDA = 0.5
LINKS = 0.8
LEAST_LEFT = 0.25
KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)


class Element:
    __slots__ = ("article", "dropped", "hints", "number", "parent", "path", "tag")

    def __init__(self, tag, path, parent, number):
        self.tag, self.path, self.parent, self.number = tag, path, parent, number
        self.dropped = parent.dropped if parent else ""
        self.hints = parent.hints if parent else ()  # elements around it that are named as boilerplate
        self.article = parent.article if parent else None


class Block:
    __slots__ = ("element", "links", "parts", "text")

    def __init__(self, element):
        self.element, self.parts, self.links, self.text = element, [], 0, ""


def opened(tag: str, attributes: str, parent: Element, number: int) -> Element:
    """A new element: its path, and what it says about its text."""
    label, marks, body, hidden = tag, [], False, False
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name in ("class", "id", "role"):
                marks += NAME_PART.findall(value)
                if name == "class" and value.split():
                    label = f"{tag}.{value.split()[0]}"
                body |= name == "role" and value.lower() in ("main", "article")
            elif name == "itemprop":
                body |= value.lower() in ARTICLE_BODY
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                hidden |= name == "hidden" or value.lower() == "true"
    element = Element(tag, (parent.path, label), parent, number)
    if (tag in ("article", "main") or body) and (parent.article is None or (tag == "article" and parent.article.tag == "main")):
        element.article = element
        if element.dropped == "form":  # a form around the whole page
            element.dropped = ""
    if not element.dropped and (hidden or tag in BOILERPLATE or (tag == "header" and parent.article is None)):
        element.dropped = tag
    if tag not in ("html", "body") and any(m.lower() in NOT_ARTICLE for m in marks):
        element.hints = (*element.hints, element)
    return element


def blocks_of(html: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    root = Element("", (None, ""), None, 0)
    stack, inline, count = [root], [], 0  # open blocks; open inline tags of the innermost
    paths: dict[tuple, tuple] = {}
    out = [Block(root)]
    at, size = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            out[-1].parts.append(raw)
            if "a" in inline:
                out[-1].links += len(raw)

    def turn() -> None:
        if out[-1].parts:
            out.append(Block(stack[-1]))
        else:
            out[-1].element = stack[-1]
        inline.clear()

    def close(names, scoped: bool) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if scoped and stack[k].tag in SCOPES:
                return

    while at < size:
        token = TOKEN.search(html, at)
        if token is None:
            text(html[at:])
            break
        text(html[at:token.start()])
        at = token.end()
        ended, tag = token[1], token[2]
        if tag:
            tag = tag.lower()
            if tag in RAW or tag in EMBEDDED:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                if end and (tag in RAW or not token[3].endswith("/")):
                    at = end.end()
                elif tag in RAW:
                    at = size
                text(" ")
            elif tag in INLINE:
                inline.append(tag)
            elif tag in VOID:
                text(" ")
                if tag == "hr":
                    turn()
            else:
                close({"p"}, True)
                if tag in CLOSES:
                    close(CLOSES[tag], True)
                if len(stack) > DEPTH:
                    stack.pop()
                count += 1
                element = opened(tag, token[3], stack[-1], count)
                element.path = paths.setdefault((id(stack[-1].path), element.path[1]), element.path)
                stack.append(element)
                turn()
        elif ended:
            tag = ended.lower()
            if tag in INLINE:
                if tag in inline:
                    inline.reverse()
                    inline.remove(tag)
                    inline.reverse()
            elif tag == "br":
                text(" ")
            else:
                close({tag}, False)
                turn()
    return out


def finished(blocks: list[Block]) -> list[Block]:
    """Blocks with text: references decoded, white space folded."""
    out = []
    for b in blocks:
        raw = "".join(b.parts)
        b.links = b.links / max(1, len(raw))
        b.text = " ".join((markup.unescape(raw) if "&" in raw else raw).split())
        if b.text:
            out.append(b)
    return out


def path_scores(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(score of each block, share of link text on its path, blocks of every path)."""
    paths = defaultdict(list)
    for i, b in enumerate(blocks):
        paths[id(b.element.path)].append(i)
    length = np.array([len(b.text) for b in blocks], float)
    marks = np.array([sum(map(b.text.count, PUNCTUATION)) for b in blocks], float)
    linked = np.array([b.links for b in blocks]) * length
    ratios, links = np.empty((2, len(blocks))), np.empty(len(blocks))
    for own in paths.values():
        ratios[:, own] = [[length[own].mean()], [marks[own].mean()]]
        links[own] = linked[own].sum() / length[own].sum()
    wide = np.convolve(np.ones(len(blocks)), KERNEL, "same")[:len(blocks)] if len(blocks) >= len(KERNEL) else None
    smooth = np.array([np.convolve(r, KERNEL, "same") / wide for r in ratios]) if wide is not None else ratios
    mean = smooth.mean(axis=1, keepdims=True)
    return (smooth / np.where(mean > 0, mean, 1)).mean(axis=0) * (1 - links), links, list(paths.values())


def ancestors(element: Element) -> list[Element]:
    out = []
    while element is not None:
        out.append(element)
        element = element.parent
    return out[::-1]


def inner_hint(block: Block) -> bool:
    """Whether an element within the block's article is named as boilerplate."""
    hints = block.element.hints
    return bool(hints) and hints[-1].number > block.element.article.number


def main_text(html: str | None) -> str:
    """The blocks of the article, one per line."""
    blocks = [b for b in finished(blocks_of(html or "")) if not b.element.dropped]
    if not blocks:
        return ""
    score, links, paths = path_scores(blocks)
    weight = score * [len(b.text) for b in blocks]
    within = defaultdict(float)
    for b, w in zip(blocks, weight, strict=True):
        if b.element.article is not None and not inner_hint(b):
            within[b.element.article] += w
    if within:
        # a mark of boilerplate around the only article is no verdict on it; among several, unmarked ones go first
        best = max(within, key=lambda article: (not article.hints, within[article], -article.number))
        region = [i for i, b in enumerate(blocks) if b.element.article is best]
        hinted = {i for i in region if inner_hint(blocks[i])}
    else:
        held = defaultdict(float)
        for b, w in zip(blocks, weight, strict=True):
            for hint in b.element.hints:
                held[hint] += w
        # where the marks leave too little, the one that holds most stands around the article
        pardoned = set()
        while True:
            hinted = {i for i, b in enumerate(blocks) if not pardoned.issuperset(b.element.hints)}
            left = held.keys() - pardoned
            if not left or weight.sum() - weight[sorted(hinted)].sum() >= LEAST_LEFT * weight.sum():
                break
            pardoned.add(max(left, key=lambda hint: (held[hint], -hint.number)))
        content = []
        for own in paths:
            lengths = np.array([len(blocks[i].text) for i in own])
            if (score[own] * lengths).sum() / lengths.sum() > LAMBDA * score.std() and not set(own) <= hinted:
                content += [i for i in own if i not in hinted]
        if not content:
            return ""
        chain = ancestors(blocks[content[0]].element)
        for i in content[1:]:
            other = ancestors(blocks[i].element)
            same = 0
            while same < min(len(chain), len(other)) and chain[same] is other[same]:
                same += 1
            chain = chain[:same]
        first, last = min(content), max(content)
        while first and blocks[first - 1].element.tag in HEADINGS:
            first -= 1
        around = chain[-1]
        region = [i for i in range(first, last + 1) if i in content or around in ancestors(blocks[i].element)]
    return "\n".join(blocks[i].text for i in region if i not in hinted and links[i] < LINKS)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of `keep`, text, n_chars (code points) of every page."""
    slim = pages.select(*keep, F.col(html_col).alias("__in"))

    def run(batches):
        for batch in row_slices(batches):
            texts = [main_text(x) for x in batch.column("__in").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return slim.mapInArrow(run, slim.drop("__in").schema.add("text", "string").add("n_chars", "long"))
