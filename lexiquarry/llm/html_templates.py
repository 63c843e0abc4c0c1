"""Main text of web pages by site template removal.

Every element subtree of a page is hashed (tag, text and children). Spark counts in how many different pages
of a host each hash occurs; subtrees that recur across many of them are the site's template and are deleted,
wherever they stand. Only of what is left, the article is taken: what HTML itself marks as not part of it
(navigation, headers, footers, asides, forms, scripts, adverts, notices, reader comments) goes as well, for what
differs from page to page can't be found by counting, and if an <article> or <main> has text left, only that stays.
Inside these, running text (paragraphs, headings, list items and the like) is never taken for template: short
paragraphs and articles published twice recur too.

Defined results: null or empty html gives an empty text. Pages with the same url host form a site; a page
whose url has no host belongs to the site "". Copies of one page count once, so that mirrored pages don't
turn an article into template. page_id isn't used as a key: repeated rows give repeated results. Other
columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S
)
#: Elements whose content isn't markup, up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address nav header footer aside form fieldset details summary dialog menu noscript "
    "template button select option label svg canvas video audio object hr center".split()
)
#: Never part of an article.
DROPPED = set(
    "head nav footer aside form noscript template button select dialog menu svg canvas video audio object script style "
    "textarea title iframe".split()
)
#: Words of class, id and role that name something else than the article.
LABELS = set(
    "ad ads advert adverts advertisement sponsor sponsored banner cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription promo promotion popup modal sidebar breadcrumb breadcrumbs menu navbar navigation nav share "
    "sharing social related comment comments disqus masthead".split()
)
ROOTS = {"article", "main"}
PROSE = set("article main section p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption body html".split())
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A start tag that ends an open element of the same kind.
CLOSES_SELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


@dataclass
class Node:
    tag: str
    parent: int
    dropped: bool
    inside: bool  # within <article> or <main>
    digest: int = 0
    parts: list[str] = field(default_factory=list)


def parse(page: str, labels: frozenset[str] | set[str] = LABELS) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements, with digests of their subtrees, and blocks of text as (element, text)."""
    nodes = [Node("", -1, False, False)]
    open_nodes, open_tags, blocks, run = [0], Counter(), [], []

    def end_block() -> None:
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                at = open_nodes[-1]
                blocks.append((at, text))
                nodes[at].parts.append(text)

    def close() -> None:
        node = nodes[open_nodes.pop()]
        open_tags[node.tag] -= 1
        if node.parts:
            node.digest = xxhash.xxh3_64_intdigest(f"{node.tag}\x00" + "\x01".join(node.parts)) - 2**63
            nodes[node.parent].parts.append(f"\x02{node.digest}")

    at, n = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                end_block()
                if open_tags[tag]:
                    while nodes[open_nodes[-1]].tag != tag:
                        close()
                    close()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in BLOCKS:
            end_block()
            if tag not in VOID:
                if nodes[open_nodes[-1]].tag == "p" or tag in CLOSES_SELF and nodes[open_nodes[-1]].tag == tag:
                    close()
                over = nodes[open_nodes[-1]]
                names = re.split(r"[^a-z0-9]+", " ".join(x for y in ATTRIBUTE.findall(m[3]) for x in y).lower()) if m[3] else ()
                dropped = over.dropped or tag in DROPPED or tag == "header" and not over.inside or not labels.isdisjoint(names)
                if tag in ("html", "body"):
                    dropped = False
                nodes.append(Node(tag, open_nodes[-1], dropped, over.inside or tag in ROOTS))
                open_nodes.append(len(nodes) - 1)
                open_tags[tag] += 1
    if at < n:
        run.append(page[at:])
    end_block()
    while len(open_nodes) > 1:
        close()
    return nodes, blocks


def protected(x: Node) -> bool:
    """Running text of an article, and the document itself, are no template."""
    return x.tag in PROSE and x.inside or x.tag in ("html", "body", "")


def template_candidates(page: str) -> list[int]:
    """Digests of the subtrees that may be template, each once."""
    nodes, _ = parse(page)
    return list({x.digest for x in nodes if x.digest and not protected(x)})


def main_text(page: str, template=(), labels: frozenset[str] | set[str] = LABELS) -> str:
    """The text of page without template subtrees, blocks joined by line ends."""
    nodes, blocks = parse(page, labels)
    gone = [False] * len(nodes)
    for k, x in enumerate(nodes):
        gone[k] = x.dropped or (k > 0 and gone[x.parent]) or (x.digest in template and not protected(x))
    inside = [text for k, text in blocks if nodes[k].inside and not gone[k]]
    return "\n".join(inside or [text for k, text in blocks if not gone[k]])


def templates(trees: DataFrame, least_pages: int = 10, fewest: int = 3) -> DataFrame:
    """(host, subtree) of what is template, of trees (host, page, subtree), where a page's row without subtree counts
    the page: subtrees in least_pages different pages of a host or more, and on a host of less than twice as many
    pages those in half of its pages, in `fewest` at least. The bar doesn't grow with a host beyond that."""
    counts = trees.where("subtree is not null").groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
    sites = trees.where("subtree is null").groupBy("host").agg(F.count("*").alias("pages"))
    bar = F.least(F.lit(least_pages), F.greatest(F.lit(fewest), F.ceil(F.col("pages") / 2)))
    return counts.join(sites, "host").where(F.col("n") >= bar).select("host", "subtree")


def extract(
    pages: DataFrame, least_pages: int = 10, fewest: int = 3, broadcast_rows: int = 50_000, labels: frozenset[str] | set[str] = LABELS
) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    What is template, see templates(). Up to broadcast_rows template subtrees are sent to every task; more are joined,
    with the same result. labels: words of class, id and role that name no part of an article.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("html"))

    def hashed(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "page": pdf["page"], "subtree": [template_candidates(x) for x in pdf["html"]]})

    found = rows.select("host", "page", "html").mapInPandas(hashed, "host string, page long, subtree array<long>")
    # Copies of a page are one; the null counts the page itself.
    trees = found.select("host", "page", F.explode(F.concat("subtree", F.array(F.lit(None).cast("long")))).alias("subtree")).distinct()
    common = materialize(templates(trees, least_pages, fewest), "templates")

    def cleaned(template_of):
        def run(batches: Iterator):
            import pandas as pd

            for pdf in batches:
                texts = [main_text(x, t, labels) for x, t in zip(pdf["html"], template_of(pdf))]
                yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(x) for x in texts]})

        return run

    schema = "page_id long, url string, text string, n_chars long"
    few = common.limit(broadcast_rows + 1).collect()
    if len(few) <= broadcast_rows:  # so small a table goes to every task; pages need no shuffle
        by_host: dict[str, set[int]] = {}
        for r in few:
            by_host.setdefault(r["host"], set()).add(r["subtree"])
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
        return rows.mapInPandas(cleaned(lambda pdf: [sent.value.get(h, ()) for h in pdf["host"]]), schema)
    # A page's own template subtrees are no more than its elements, however large the site.
    own = trees.join(common, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_list("subtree").alias("template"))
    joined = rows.join(own, ["host", "page"], "left")
    return joined.mapInPandas(cleaned(lambda pdf: [set(t) if t is not None else () for t in pdf["template"]]), schema)
