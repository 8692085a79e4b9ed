"""Main text of web pages by site style trees.

Yi, Liu and Li, "Eliminating noisy information in Web pages for data mining"
(KDD 2003): the DOMs of a host's pages are merged by their style paths (tags,
classes and roles from the root). A style node's content importance is one
less the mean entropy of its contents over the host's pages: a sentence that
stands on all pages says nothing about any of them. Its presentation importance is the
entropy of the child sequences it has. A branch is as important as its most
important node; branches of low importance are removed from each page.

All branches enter the tree, those in an article or main element and those that
markup calls noise too. Pages of a host that say the same are one page of it, so
that copies of an article are no boilerplate. What the importances leave is then
checked by markup: branches that are no main text by name (nav, footer, forms,
classes such as "sidebar") go, and a page with an article or main element gives
what is left of that element.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm.common import stage

#: Branches below this importance go; a node must be on LEAST_PAGES pages and this share of its host's pages.
IMPORTANCE, LEAST_PAGES, LEAST_SHARE = 0.3, 5, 0.2

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never main text.
_NOISE_TAGS = frozenset("head nav footer aside form button select option textarea input script style noscript template svg canvas iframe object video audio map dialog menu".split())
#: Words of a class, id or role that mark a branch as no main text.
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe signup comment comments disqus "
    "respond share sharing social related recommended recommendations login search searchbox widget pagination pager toolbar skip contentinfo complementary alert dialog".split()
)
#: Elements that end an open element of the set when they begin.
_ENDS = {
    **{t: frozenset({"p"}) for t in "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
#: What implied ends do not reach beyond.
_SCOPES = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote button".split())
_token = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_attribute = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_names = re.compile(r"[a-z]+|[0-9]+")
_spaces = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    #: Decided by markup: noise, or inside the page's main element.
    noise: bool
    main: bool
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    text: str
    #: Style paths from the root down to the block's element.
    paths: tuple[str, ...]
    noise: bool
    main: bool


def _style(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The style of an element, whether it is noise, whether it is the page's main element."""
    if not attributes.strip():
        return tag, tag in _NOISE_TAGS, tag in ("article", "main")
    found = {}
    for name, a, b, c in _attribute.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c).lower())
    words = [w for k in ("class", "id", "role") for w in _names.findall(found.get(k, ""))]
    style = ".".join([tag, *sorted({w for w in words if not w.isdigit()})])
    main = tag in ("article", "main") or found.get("role") in ("main", "article")
    noise = tag in _NOISE_TAGS or "hidden" in found or (tag not in ("html", "body") and not main and not _NOISE_WORDS.isdisjoint(words))
    return style, noise, main


def parse(page: str | None) -> tuple[list[Block], list[tuple[str, str]]]:
    """Blocks of text in page order, and (path, children) of each element."""
    root = Node("", "", False, False)
    stack, blocks, layout = [root], [], []
    run: list[str] = []
    text = page or ""

    def flush() -> None:
        said = _spaces.sub(" ", "".join(run)).strip()
        run.clear()
        if said:
            top = stack[-1]
            blocks.append(Block(said, tuple(n.path for n in stack[1:]), top.noise, top.main))

    def close(to: int) -> None:
        while len(stack) > to:
            if stack[-1].tag not in _INLINE:
                flush()
            gone = stack.pop()
            if gone.children:
                layout.append((gone.path, " ".join(gone.children)))

    at = 0
    while m := _token.match(text, at):
        at = m.end()
        ending, tag, attributes, said = m.groups()
        if said is not None:
            run.append(html.unescape(said) if "&" in said else said)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close(depth)
            elif tag == "p" or tag not in _INLINE:
                flush()
            continue
        if (ends := _ENDS.get(tag)) is not None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in _SCOPES:
                    break
        if tag == "br":
            run.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        style, noise, main = _style(tag, attributes or "")
        above = stack[-1]
        node = Node(tag, f"{above.path}>{style}", above.noise or noise, above.main or (main and not above.noise))
        if tag not in _INLINE:
            # a page's header or footer is none of an article's own heading
            if tag == "header" and not node.main:
                node.noise = True
            above.children.append(style)
        if tag in _VOID or (attributes or "").rstrip().endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        stack.append(node)
    close(1)
    flush()
    return blocks, layout


def _key(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def _branches(paths: tuple[str, ...]) -> list[int]:
    return [_key(p) for p in paths]


def main_text(page: str | None, low: set[int]) -> str:
    """The page's main blocks, one a line; ``low``: its host's branches of low importance.

    Blocks in those branches go first, wherever they stand. Of the others, those
    outside noise stay; if some are in an article or main element, only they.
    """
    blocks, _ = parse(page)
    important = [b for b in blocks if not low or low.isdisjoint(_branches(b.paths))]
    sound = [b for b in important if not b.noise]
    return "\n".join(b.text for b in [b for b in sound if b.main] or sound)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, said, path, up, kind, feature) of each page: contents (0), layouts (1), and the page itself (2); ``said`` is its main text by markup alone."""
    for batch in batches:
        rows: list[tuple[str, int, int, list[int], int, int]] = []
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            blocks, layout = parse(page)
            sound = [b for b in blocks if not b.noise]
            page_key = _key("\n".join(b.text for b in [b for b in sound if b.main] or sound))
            seen = {(host, page_key, 0, (), 2, 0)}
            for b in blocks:
                up = tuple(_branches(b.paths))
                seen.add((host, page_key, up[-1] if up else 0, up, 0, _key(b.text)))
            for path, children in layout:
                parts = path.split(">")[1:]
                up = tuple(_key(">" + ">".join(parts[: i + 1])) for i in range(len(parts)))
                seen.add((host, page_key, up[-1], up, 1, _key(children)))
            rows += seen
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["host", "said", "path", "up", "kind", "feature"])


def low_branches(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, low): the branches of low importance of each host that has any.

    A node on few pages is never judged. Those judged are at most 1 /
    LEAST_SHARE times as many as a page has elements on average, which bounds
    the array.
    """
    seen = pages.select(_host(F.col(url)).alias("host"), F.col(page).alias("html")).mapInArrow(_observed, "host string, said long, path long, up array<long>, kind int, feature long")
    counts = stage(seen.distinct().groupBy("host", "path", "up", "kind", "feature").agg(F.count(F.lit(1)).alias("n")), "style-tree")
    of_host = counts.where("kind = 2").select("host", F.col("n").alias("pages"))
    nodes = counts.where("kind < 2").groupBy("host", "path", "up", "kind").agg(
        F.sum("n").alias("on"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.count(F.lit(1)).alias("forms")
    )
    # A host of one page is never judged, but Spark may reckon its entropies.
    judged = nodes.join(of_host, "host").withColumn("log_pages", F.log(F.greatest("pages", F.lit(2)).cast("double")))
    # Contents: H = sum n log n / (on log pages), 1 if all pages share one content. Layouts: entropy of the forms.
    content = 1 - F.col("n_log_n") / (F.col("on") * F.col("log_pages"))
    layout = (F.log("on") - F.col("n_log_n") / F.col("on")) / F.col("log_pages")
    rare = (F.col("on") < LEAST_PAGES) | (F.col("on") < LEAST_SHARE * F.col("pages"))
    importance = F.when(rare, 1.0).when(F.col("kind") == 0, content).otherwise(layout)
    # A branch is as important as its most important content; the layout speaks for branches of content that is judged.
    branches = judged.select("host", "kind", importance.alias("importance"), F.explode("up").alias("branch"))
    worth = branches.groupBy("host", "branch").agg(F.max("importance").alias("importance"), F.min("kind").alias("kind"))
    return worth.where((F.col("importance") < IMPORTANCE) & (F.col("kind") == 0)).groupBy("host").agg(F.collect_set("branch").alias("low"))


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """row (a struct of the columns of ``pages``) and text, its main text ('' if none).

    NULL html counts as empty; a NULL url is a host of its own name. The table
    of low branches is stored first, so that Spark broadcasts it if it is small
    by measure, and otherwise joins by host, dividing a large host.
    """
    low = stage(low_branches(pages, url, page), "low-branches")
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    joined = pages.select(row, F.col(page).alias("html"), _host(F.col(url)).alias("host")).join(low, "host", "left")

    @F.pandas_udf("string")
    def text(texts, lows):
        import pandas as pd

        return pd.Series([main_text(t, set(x) if x is not None else set()) for t, x in zip(texts, lows, strict=True)])

    return joined.select("row", text("html", "low").alias("text"))
