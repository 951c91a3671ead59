"""Main text of web pages by composite text density.

A page becomes a tree of elements.  What is no article by its name goes first:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, by element, role, or a word of class or id.  Then every node has
its characters C, tags T, and those of links LC and LT, over its whole subtree, and
the link-adjusted characters per tag

    (C / T) * log_b((C / LC) * (T / LT)),  b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

(counts of 0 are 1).  The node whose children have the greatest sum of densities is
the core.  The least density on the path from it to the body is the threshold: from
the core up, a parent is taken as long as what it adds is as dense as that, so that
blocks beside the core stay whole.  Where a page marks its article (or main part),
the core is sought in it, and all of it is taken.

Pages are independent rows: no shuffle, and memory follows a batch.

Defined results: a null page is empty; a page without any text gives ''; markup that is
not closed ends with the page or with what must close it; repeated rows stay; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as charrefs
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# HTML's elements by kind.
_VOID = _set("area base br col embed hr img input link meta param source track wbr")
_RAW = _set("script style noscript template iframe textarea title svg math object select noembed noframes xmp")
_BLOCK = _set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul")
_HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: What an opening element ends, and where the search for that stops.
_ENDS = {t: (_set("p"), _set("td th table button caption")) for t in _BLOCK - _set("td th tr tbody thead tfoot caption html head body")} | {
    "li": (_set("li p"), _set("ul ol menu")), "dt": (_set("dt dd p"), _set("dl")), "dd": (_set("dt dd p"), _set("dl")),
    "td": (_set("td th p"), _set("tr table")), "th": (_set("td th p"), _set("tr table")), "tr": (_set("tr td th p"), _set("table")),
    "tbody": (_set("thead tbody tfoot tr td th"), _set("table")), "tfoot": (_set("thead tbody tr td th"), _set("table")), "body": (_set("head"), _set("html")), "a": (_set("a"), _BLOCK),
}
# Names of what is no article.
_NOISE_TAGS = _RAW | _set("head nav footer aside form button dialog menu search fieldset")
_NOISE_ROLES = _set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar")
_NOISE_WORDS = _set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar login signup signin search copyright"
)
_HEADER_WORDS = _set("header")


@dataclass
class _Page:
    """Elements in page order: tag, parent, last descendant, kind of noise; and what stands in the page, in order."""

    tags: list[str]
    parent: list[int]
    last: list[int]
    noise: list[str]
    #: (element, text) of each text, (element, None) where an element begins or ends.
    content: list[tuple[int, str | None]]


def _kind(tag: str, attrs: str) -> str:
    """'always', 'named' (unless it holds the article), 'header' (unless it is an article's title) or ''."""
    if tag in _NOISE_TAGS:
        return "always"
    if tag == "header":
        return "header"
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    words: set[str] = set()
    for name, *values in _ATTR.findall(attrs):
        value = "".join(values)
        if name.lower() == "role" and value.strip().lower() in _NOISE_ROLES:
            return "named"
        words.update(w.lower() for w in _WORD.findall(value))
    return "named" if words & _NOISE_WORDS else "header" if words & _HEADER_WORDS else ""


def _parse(page: str) -> _Page:
    out = _Page(["html"], [-1], [0], [""], [])
    stack, at = [0], 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            k = stack.pop()
            out.last[k] = len(out.tags) - 1
            out.content.append((k, None))

    def end_open(ends: frozenset[str], stop: frozenset[str]) -> None:
        """Close from the outermost of ``ends`` above the nearest of ``stop``."""
        depth = 0
        for d in range(len(stack) - 1, 0, -1):
            if out.tags[stack[d]] in stop:
                break
            if out.tags[stack[d]] in ends:
                depth = d
        if depth:
            close(depth)

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            out.content.append((stack[-1], charrefs.unescape(text) if "&" in text else text))
        if m is None:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag or tag == "html":
            continue
        if m["end"] or m["end2"]:
            stop = frozenset() if tag in _BLOCK else _BLOCK
            for d in range(len(stack) - 1, 0, -1):
                if out.tags[stack[d]] == tag:
                    close(d)
                    break
                if out.tags[stack[d]] in stop or (tag != "table" and out.tags[stack[d]] == "table"):
                    break
            continue
        if tag in _ENDS:
            end_open(*_ENDS[tag])
        if tag in _RAW:
            # nothing in it counts, up to its own end
            e = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = e.end() if e else len(page)
            continue
        k = len(out.tags)
        out.tags.append(tag)
        out.parent.append(stack[-1])
        out.last.append(k)
        out.noise.append("always" if tag in _NOISE_TAGS else _kind(tag, m["attrs"] or m["attrs2"] or ""))
        out.content.append((k, None))
        if tag not in _VOID:
            stack.append(k)
    close(0)
    return out


def _dropped(page: _Page) -> list[bool]:
    """Which elements are no part of any article."""
    n = len(page.tags)
    holds, heading, in_article, dropped = ([False] * n for _ in range(4))
    for k in range(n - 1, 0, -1):
        tag, up = page.tags[k], page.parent[k]
        holds[up] |= holds[k] or tag in ("article", "main", "h1")
        heading[up] |= heading[k] or tag in _HEADINGS
    for k in range(1, n):
        up, noise = page.parent[k], page.noise[k]
        in_article[k] = in_article[up] or page.tags[k] == "article"
        if noise == "header":
            # an article's own header has its title; a named block around the whole article is none
            own = not (in_article[k] and heading[k]) and not (holds[k] and page.tags[k] != "header")
        else:
            own = noise == "always" or (noise == "named" and not holds[k])
        dropped[k] = dropped[up] or own
    return dropped


#: Characters, tags, characters in links and link tags.
_Count = list[int]


def _densities(page: _Page, dropped: list[bool], body: int) -> tuple[list[_Count], list[float], list[float]]:
    """(counts, density, sum of the children's densities) by element; a node without children has its own density for a sum."""
    n = len(page.tags)
    linked, count = [False] * n, [[0, 0, 0, 0] for _ in range(n)]
    for k in range(1, n):
        linked[k] = linked[page.parent[k]] or page.tags[k] == "a"
    for k, text in page.content:
        if text and not dropped[k]:
            size = len(" ".join(text.split()))
            count[k][0] += size
            if linked[k]:
                count[k][2] += size
    for k in range(n - 1, 0, -1):
        if not dropped[k]:
            up, own = count[page.parent[k]], count[k]
            up[0] += own[0]
            up[1] += own[1] + 1
            up[2] += own[2]
            up[3] += own[3] + (page.tags[k] == "a")
    ratio = count[body][2] / max(1, count[body][0])
    density = [_density(c, ratio) for c in count]
    sums = [0.0] * n
    for k in range(n - 1, 0, -1):
        if not dropped[k]:
            sums[page.parent[k]] += density[k]
    return count, density, [s or d for s, d in zip(sums, density, strict=True)]


def _density(count: _Count, ratio: float) -> float:
    """Link-adjusted characters per tag; ratio: the body's share of characters in links."""
    chars, tags, links, link_tags = count[0], *(max(1, c) for c in count[1:])
    if chars <= 0:
        return 0.0
    base = math.log(chars / max(1, chars - links) * links + ratio * chars + math.e)
    return max(0.0, chars / tags * math.log(max(1.0, chars / links * tags / link_tags)) / math.log(base))


def _select(page: _Page, dropped: list[bool]) -> int:
    """The element that is the article."""
    n = len(page.tags)
    body = page.tags.index("body") if "body" in page.tags else 0
    count, density, sums = _densities(page, dropped, body)
    # the outermost article, or else main part, of each element
    scope = [0] * n
    for tag in ("article", "main"):
        if not any(scope):
            for k in range(1, n):
                scope[k] = scope[page.parent[k]] or (k if page.tags[k] == tag and not dropped[k] and count[k][0] else 0)
    marked = any(scope)
    core = max((k for k in range(body, n) if not dropped[k] and (scope[k] or not marked)), key=sums.__getitem__, default=body)
    if scope[core]:
        return scope[core]
    path = [core]
    while path[-1] not in (body, 0):
        path.append(page.parent[path[-1]])
    least = min(density[k] for k in path)
    ratio = count[body][2] / max(1, count[body][0])
    for up in path[1:]:
        added = [a - b for a, b in zip(count[up], count[core], strict=True)]
        added[1] -= 1
        added[3] -= page.tags[core] == "a"
        if added[0] > 0 and _density(added, ratio) < least:
            break
        core = up
    return core


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    tree = _parse(page)
    dropped = _dropped(tree)
    top = _select(tree, dropped)
    blocks, line = [], []
    for k, text in tree.content:
        if not top <= k <= tree.last[top] or dropped[k]:
            continue
        if text is not None:
            line.append(text)
        elif tree.tags[k] in _BLOCK:
            blocks.append("".join(line))
            line = []
        elif tree.tags[k] == "br":
            line.append(" ")
    blocks.append("".join(line))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page id, url, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(main_text, b.column(2).to_pylist()), pa.string())], names=[id_col, url_col, "text"])

    kind = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{', '.join(kind)}, text string")


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages")).selectExpr("page_id", "url", "text", "cast(char_length(text) AS long) AS n_chars")
