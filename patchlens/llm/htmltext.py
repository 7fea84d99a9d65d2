"""Main text of HTML pages by tag-path ratios.

A page's text nodes are gathered by their root-to-leaf tag path (tags with their classes). A path's characters and
punctuation marks a node are its two ratios; both are smoothed over the nodes that stand near and share most of their
ancestors, and fused. Blocks whose nodes reach a share of the page's mean are content; then so are headings, list items
and other short blocks of plain content tags in the element path that holds the content, or all blocks of the article
element that it stands in. Paths through elements that
are, or by class, id or role call themselves, menus, headers, footers, sidebars, notices, adverts, forms or reader
comments weigh nothing, as do scripts, styles, hidden and replaced elements.

Each row is computed from its own html alone, in time and memory in proportion to it, so nothing is shuffled, and equal
rows stay equal rows. Null and empty html, and pages without content, give an empty text. Other columns are ignored; null
ids and addresses stay null; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.html import BLOCKS, CLOSE, OPEN, TEXT, attributes, events
from .common import column, slices

#: Share of the page's mean score, weighted by characters, that a content block reaches.
LEAST = 0.15
#: Nodes on either side that a ratio is smoothed over, and the deviation of their weights.
NEAR, DEVIATION = 3, 1.5

# Elements without visible prose of the page's own.
DROPPED = frozenset(
    "applet area audio button canvas datalist dialog fieldset form frameset head iframe input label legend map menu nav noembed noframes noscript object optgroup option output script select style svg template textarea title video xmp".split()
)
#: Elements that are page furniture, and one that is unless it stands inside the article.
ASIDE = frozenset("aside footer".split())
AROUND = "header"
MAIN = frozenset("article main".split())
BREAKS = BLOCKS | frozenset("body br caption dd dt html li option tbody td tfoot th thead tr".split()) - {"br"}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = INLINE | frozenset("blockquote caption center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre summary table tbody td tfoot th thead tr ul".split())

# Words of classes, ids and roles.
FURNITURE = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertisements advertising adsense alert alertdialog banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup promo promotion promoted recommended related reply replies respond responses search searchbox share sharing sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola topbar toolbar trending widget widgets".split()
)
#: The same as parts of longer words, which names run together.
STEMS = re.compile("adsby|advert|banner|breadcrumb|comment(?!ar)|consent|cookie|disqus|footer|masthead|navbar|newsletter|outbrain|popup|promo(?!t|n)|sidebar|sponsor|taboola|widget|(?:top|main|side|sub|site|foot|drop)(?:nav|menu)")
#: Of an article itself, which may have any topic in its names, only these.
REPLIES = frozenset("ad advert comment comments reply replies related sponsored teaser".split())
#: Furniture only outside the article.
OUTER = frozenset("header head branding logo".split())
#: Words that say a name describes what is around, as in "has-sidebar".
ABOUT = frozenset("has no with without".split())

WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
MARKS = re.compile(r"[.,;:!?…、。！，：；？]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def furniture(name: str, given: dict[str, str], within: bool, forms: bool = False) -> bool:
    """Whether an element is page furniture; within: it stands inside the article; forms: a form is not."""
    if (name in DROPPED and not (forms and name in ("form", "fieldset"))) or name in ASIDE or name == AROUND and not within:
        return True
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or HIDDEN.search(given.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        return not REPLIES.isdisjoint(given.get("class", "").lower().split())
    for key in ("class", "id", "role"):
        for one in given.get(key, "").split():
            words = {w.lower() for w in WORD.findall(one)}
            if not words & ABOUT and (words & FURNITURE or not within and words & OUTER or STEMS.search(one.lower())):
                return True
    return False


class Page:
    """Text nodes of a page with their tag paths; paths are numbers, a parent's being smaller."""

    def __init__(self, source: str, forms: bool = False) -> None:
        self.parent, self.tag, self.weighs, self.linked = [-1], [""], [True], [False]
        #: nodes: path, text, depth, least depth since the node before
        self.paths: list[int] = []
        self.texts: list[str] = []
        self.depths: list[int] = []
        self.joint: list[int] = []
        #: blocks: their first node, and the path of the block's element
        self.blocks: list[int] = []
        self.homes: list[int] = []
        known: dict[tuple[int, str, str], int] = {}
        stack = [0]
        homes = [0]
        article = 0
        lowest, fresh = 0, True
        for kind, name, more in events(source):
            if kind == OPEN:
                given = attributes(more) if more else {}
                key = (stack[-1], name, given.get("class", "") or given.get("id", ""))
                at = known.get(key)
                if at is None or more:
                    weighs = self.weighs[stack[-1]] and not furniture(name, given, article > 0, forms)
                    # equal paths, but one by id or style hidden: apart
                    key = (*key, weighs) if at is not None and self.weighs[at] != weighs else key
                    at = known.get(key)
                    if at is None:
                        at = known[key] = len(self.parent)
                        self.parent.append(stack[-1])
                        self.tag.append(name)
                        self.weighs.append(weighs)
                        self.linked.append(self.linked[stack[-1]] or name == "a")
                stack.append(at)
                article += name in MAIN
                if name in BREAKS:
                    fresh = True
                    homes.append(at)
                elif name == "br" and not fresh:
                    self.texts[-1] += "\n"
            elif kind == CLOSE:
                stack.pop()
                lowest = min(lowest, len(stack))
                article -= name in MAIN
                if name in BREAKS:
                    fresh = True
                    homes.pop()
            elif self.weighs[stack[-1]]:
                if fresh and name.isspace():
                    continue
                if fresh:
                    self.blocks.append(len(self.paths))
                    self.homes.append(homes[-1])
                fresh = False
                self.paths.append(stack[-1])
                self.texts.append(name)
                self.depths.append(len(stack))
                self.joint.append(lowest)
                lowest = len(stack)

    def scores(self) -> list[float]:
        """The fused ratio of each node."""
        sizes, marks, nodes = {}, {}, {}
        for at, text in zip(self.paths, self.texts, strict=True):
            sizes[at] = sizes.get(at, 0) + len(text)
            marks[at] = marks.get(at, 0) + len(MARKS.findall(text))
            nodes[at] = nodes.get(at, 0) + 1
        length = {at: sizes[at] / n for at, n in nodes.items()}
        mark = {at: marks[at] / n for at, n in nodes.items()}
        falls = [math.exp(-0.5 * (k / DEVIATION) ** 2) for k in range(NEAR + 1)]
        out = []
        for i, at in enumerate(self.paths):
            total, long, full = 1.0, length[at], mark[at]
            for step in (-1, 1):
                shared = self.depths[i]
                for k in range(1, NEAR + 1):
                    j = i + step * k
                    if not 0 <= j < len(self.paths):
                        break
                    shared = min(shared, self.joint[j + 1] if step < 0 else self.joint[j])
                    other = self.paths[j]
                    weight = falls[k] * (1.0 if other == at else (shared / max(self.depths[i], self.depths[j])) ** 2)
                    total, long, full = total + weight, long + weight * length[other], full + weight * mark[other]
            out.append(long / total * (1 + full / total))
        return out

    def content(self) -> list[bool]:
        """Whether each block is content."""
        ends = [*self.blocks[1:], len(self.paths)]
        scores = self.scores()
        sizes = [len(t) for t in self.texts]
        every = sum(sizes) or 1
        least = LEAST * sum(s * n for s, n in zip(scores, sizes, strict=True)) / every
        chosen, linked = [], []
        for a, b in zip(self.blocks, ends, strict=True):
            n = sum(sizes[a:b]) or 1
            linked.append(2 * sum(size for size, at in zip(sizes[a:b], self.paths[a:b], strict=True) if self.linked[at]) > n)
            chosen.append(sum(s * m for s, m in zip(scores[a:b], sizes[a:b], strict=True)) / n >= least and not linked[-1])
        # the deepest path that holds half of what is chosen, then what has plain tags in it
        held = [0] * len(self.parent)
        for a, b, home, yes in zip(self.blocks, ends, self.homes, chosen, strict=True):
            if yes:
                held[home] += sum(sizes[a:b])
        for at in range(len(held) - 1, 0, -1):
            held[self.parent[at]] += held[at]
        holder = 0
        for at in range(len(held)):
            if 2 * held[at] > held[0]:
                holder = at
        while self.tag[holder] in CONTENT:
            holder = self.parent[holder]
        # an article, or else a main part, that it stands in is content with all that it has
        for tag in ("article", "main"):
            outer = holder
            while outer and self.tag[outer] != tag:
                outer = self.parent[outer]
            if outer:
                holder = outer
                break
        whole = self.tag[holder] in MAIN
        inside = [False] * len(held)
        inside[holder] = True
        for at in range(holder + 1, len(held)):
            inside[at] = inside[self.parent[at]] and (whole or self.tag[at] in CONTENT)
        # a menu is links; in an article, or in its paragraphs and headings, links are text
        some = any(chosen)
        text = lambda home: whole or self.tag[holder] not in ("", "body", "html") and self.tag[home] not in ("li", "ul", "ol")
        return [yes or some and inside[home] and (not link or text(home)) for yes, home, link in zip(chosen, self.homes, linked, strict=True)]

    def text(self) -> str:
        """The content blocks in page order, white space inside each being one space, one a line."""
        lines: list[str] = []
        if not self.blocks:
            return ""
        for a, b, yes in zip(self.blocks, [*self.blocks[1:], len(self.paths)], self.content(), strict=True):
            if yes and (line := " ".join(html.unescape("".join(self.texts[a:b])).split())):
                lines.append(line)
        return "\n".join(lines)


def main_text(source: str | None) -> str:
    """The main text of one page; where nothing stands outside its forms, what stands in them."""
    found = Page(source).text() if source else ""
    return found if found or not source or "<form" not in source.lower() else Page(source, forms=True).text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(source) for source in column(batch, "html").to_pylist()]
            yield pa.record_batch([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS bigint) AS page_id", "CAST(url AS string) AS url", "CAST(html AS string) AS html").mapInArrow(run, SCHEMA)
