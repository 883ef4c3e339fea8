"""Main text of web pages by equivalence classes of their markup.

Pages of a host come from one template. The markup's tokens are the paths of
its elements (tag names with normalized classes). Paths whose occurrence
vectors over the host's pages are equal form an equivalence class. A vector is
never built: random numbers of (page, count) are summed, so that equal vectors
have equal sums, whatever number of pages and executors a host is spread over.
A class is valid if its paths occur once a page, on nearly all pages; the valid
classes, nested by their paths, are the template, and what lies below a path
of it and no longer one is a slot. Slots of menus, headers, footers, sidebars,
notices, adverts, forms and comments are told by the roles that their elements
state, by their share of links, and by being the same on all pages; of the
other slots, the container that holds most of the text is the article.

What is grouped per host are only paths found on at least a hundredth of its
pages, so a group has at most a hundred times the paths of one page.

Nulls: null ``html`` is an empty page, a null ``url`` one of the host "". Empty
pages have an empty text. Repeated rows are extracted each. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, slices, written

#: Share of a host's pages from which a path can be of its template, or is looked at.
TEMPLATE_SHARE, LEAST_SHARE = 0.9, 0.01
#: Share of a slot's text in links from which it is a menu.
MENU_SHARE = 0.6
#: Hosts up to which their templates are broadcast (of less than 1 kB each); above, they are joined.
BROADCAST_HOSTS = 20_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)

# Fixed values of HTML: elements without content, with raw text, that break lines, and that end an open one of their kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"br", "button", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SCOPES = frozenset("table ul ol dl body html div section article main".split())

# Elements and role, class or id words that state what is no main text.
_OUT_TAGS = frozenset("nav footer aside form button select dialog menu object audio video canvas head".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe"
    " signup sidebar widget widgets related recommended share sharing social comment comments disqus respond replies menu navigation navbar nav"
    " breadcrumb breadcrumbs pagination pager footer header masthead topbar login popup modal toolbar legal copyright".split()
)


def _described(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's name in paths, and whether it states that it is no main text."""
    if not attributes or attributes.isspace():
        return tag, tag in _OUT_TAGS
    out, names = tag in _OUT_TAGS, []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            words = value.split()
            names += [re.sub(r"\d+", "0", w) for w in words]
            for w in words:
                parts = re.split(r"[-_]+", w)
                if tag not in ("html", "body", "article", "main") and (w in _OUT_WORDS or parts[0] in _OUT_WORDS or parts[-1] in _OUT_WORDS):
                    out = True
        elif key == "role":
            out |= value in _OUT_ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out = True
    return ".".join([tag, *sorted(set(names))]), out


class EDGE:
    """What ``texts`` gives instead of a text at a block's edge; a class, as workers know it by its name."""


def texts(html: str) -> Iterator[tuple[str, bool, bool, object]]:
    """(path, stated to be no main text, in a link, text), in page order.

    A text of None is an element's start, ``EDGE`` a block's edge.
    """
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, out, link
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        if m is None:
            return
        at = m.end()
        text, tag = m[7], m[2] or m[5]
        top = stack[-1] if stack else ("", "", False, False)
        if text is not None:
            yield top[1], top[2], top[3], text
        elif tag:
            tag = tag.lower()
            if tag in _BLOCK:
                yield top[1], top[2], top[3], EDGE
            if m[1] or m[4]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            if tag in _ENDS_P or tag in _CLOSES:
                ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in _SCOPES:
                        break
            top = stack[-1] if stack else ("", "", False, False)
            name, out = _described(tag, m[3] or m[6] or "")
            if tag == "header" and "/article" not in top[1] and "/main" not in top[1]:
                out = True
            path = f"{top[1]}/{name}"
            yield path, top[2] or out, top[3] or tag == "a", None
            if tag in _RAW:
                end = re.compile(rf"</{tag}\s*/?>", re.I).search(html, at)
                at = end.end() if end else n
            elif tag not in _VOID and not (m[3] or m[6] or "").endswith("/"):
                stack.append((tag, path, top[2] or out, top[3] or tag == "a"))


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)"


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))


def paths(pages: DataFrame) -> DataFrame:
    """Per page and path of its markup: count, and characters of its own text and of links in it. The path "" stands for the page."""
    schema = "host string, page long, path string, n long, chars long, link_chars long, out boolean, text_hash long"

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in slices(batches, "html"):
            rows: list[tuple] = []
            for host, page, html in zip(*(column(batch, c).to_pylist() for c in ("host", "page_id", "html")), strict=True):
                seen: dict[str, list] = {"": [1, 0, 0, False, 0]}
                own: dict[str, list[str]] = {}
                for path, out, link, text in texts(html or ""):
                    row = seen.setdefault(path, [0, 0, 0, out, 0])
                    if text is None:
                        row[0] += 1
                    elif text is not EDGE and not text.isspace():
                        size = len(text.strip())
                        row[1] += size
                        row[2] += size * link
                        own.setdefault(path, []).append(text)
                for path, row in seen.items():
                    row[4] = xxhash.xxh64_intdigest("\n".join(own[path]).encode("utf-8", "replace")) >> 1 if path in own else 0
                    rows.append((host, page, path, *row))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "page", "path", "n", "chars", "link_chars", "out", "text_hash"])

    return _with_host(pages).select("host", "page_id", "html").mapInArrow(run, schema)


def classes(found: DataFrame) -> DataFrame:
    """Per host and path: pages, occurrences and ``class``, the first path with the same occurrence vector."""
    part = lambda k: F.sum(F.pmod(F.xxhash64("page", "n", F.lit(k)), F.lit(1 << 31)))
    path = found.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"), F.max("out").alias("out"),
        F.approx_count_distinct("text_hash").alias("texts"), part(1).alias("v1"), part(2).alias("v2"),
    )
    hosts = path.filter("path = ''").select("host", F.col("pages").alias("host_pages"))
    seen = path.filter("path <> ''").join(hosts, "host").filter(F.col("pages") >= F.greatest(F.lit(1.0), F.col("host_pages") * LEAST_SHARE))
    return seen.withColumn("class", F.min("path").over(W.partitionBy("host", "pages", "n", "v1", "v2"))).drop("v1", "v2")


def templates(found: DataFrame) -> DataFrame:
    """Per host: ``main``, the path that holds the article (null: none), and ``fixed``, template paths whose text never varies."""

    def choose(rows):
        import pandas as pd

        host, rows = rows["host"].iloc[0], rows.sort_values("path")
        total = int(rows["host_pages"].iloc[0])
        valid = (rows["pages"] == rows["n"]) & (rows["pages"] >= TEMPLATE_SHARE * total)
        sizes = rows.groupby("class")["path"].transform("size")
        root = set(rows["path"][valid & ((sizes > 1) | (rows["pages"] == total))])

        def slot(path: str) -> str:
            while path and path not in root:
                path = path.rpartition("/")[0]
            return path

        chars: dict[str, float] = {}
        links: dict[str, float] = {}
        for r in rows.itertuples():
            if not r.out:
                s = slot(r.path)
                chars[s] = chars.get(s, 0) + r.chars
                links[s] = links.get(s, 0) + r.link_chars
        good = {s: c for s, c in chars.items() if c and links[s] < MENU_SHARE * c}
        main = max(sorted(good), key=good.get) if good else None
        # a template path with one text on all pages is a notice, unless it is the article's own
        same = rows[valid & (rows["texts"] == 1) & (rows["chars"] > 0) & (total >= 5)]["path"]
        fixed = [p for p in same if main is None or not (p == main or p.startswith(main + "/"))]
        # a heading may be the largest slot's sibling: then the article is what holds both
        while main:
            above, tag = main.rpartition("/")[0], main.rpartition("/")[2].partition(".")[0]
            held = above.rpartition("/")[2].partition(".")[0]
            if tag in ("article", "main") or held in ("body", "html", ""):
                break
            main = above
        return pd.DataFrame({"host": [host], "main": [main], "fixed": [fixed]})

    return classes(found).groupBy("host").applyInPandas(choose, "host string, main string, fixed array<string>")


def main_text(html: str, main: str | None, fixed: frozenset[str] = frozenset()) -> str:
    """The blocks of text below the path ``main``, in page order, joined by line ends; all that is not ruled out if ``main`` isn't there."""
    inside: list[str] = []
    anywhere: list[str] = []
    blocks: tuple[list, list] = ([], [])
    found = False

    def flush() -> None:
        for part, kept in zip((inside, anywhere), blocks, strict=True):
            if part:
                text = " ".join(entities.unescape("".join(part)).split())
                if text:
                    kept.append(text)
                part.clear()

    for path, out, _, text in texts(html):
        if text is None:
            found = found or path == main
        elif text is EDGE:
            flush()
        elif not out:
            if main is not None and (path == main or path.startswith(main + "/")):
                inside.append(text)
            if not any(path == p or path.startswith(p + "/") for p in fixed):
                anywhere.append(text)
    flush()
    return "\n".join(blocks[0] if found else blocks[1])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of each row of ``pages``."""
    known = written(templates(paths(pages)))
    small = known.count() <= BROADCAST_HOSTS
    joined = _with_host(pages).join(F.broadcast(known) if small else known, "host", "left")
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "html"):
            out = [main_text(h or "", m, frozenset(f or ())) for h, m, f in zip(*(column(batch, c).to_pylist() for c in ("html", "main", "fixed")), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url").cast(pa.string()), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "main", "fixed").mapInArrow(run, schema)
