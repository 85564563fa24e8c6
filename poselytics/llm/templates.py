"""Main text of web pages by removal of what a site's pages have in common.

Element subtrees are hashed and counted per host; a subtree that stands in many
of a host's pages with different texts is part of its template and is deleted, wherever it stands, before the main element is looked for. Copies of
one page count once, so an article that a site publishes many times is
no template. What the markup itself names as navigation, advert, form and so on
goes as well, as most hosts have too few pages to count.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poselytics.llm.common import BROADCAST_BYTES, keep, without

#: A subtree is a template from so many different pages of its host on, however many pages that has.
MIN_PAGES = 10
#: Inside the article, where text may well be quoted often, also from this share of them.
MIN_PAGES_ARTICLE = 20
SHARE_ARTICLE = 0.5

# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_NO_TEXT = frozenset(
    "head title script style noscript template iframe nav footer aside form menu button select option textarea input "
    "dialog svg canvas object embed audio video map xmp noembed noframes".split()
)
#: These start tags end an open one of the listed kinds.
_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: Never part of a template as a whole.
_PAGE = frozenset("html head body article main".split())
_SCOPE = frozenset("ul ol dl table select body html article section div".split())
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
# What class, id and role call such parts.
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments disqus "
    "replies respond social share sharing related recommended newsletter subscribe subscription popup modal overlay "
    "paywall login signup pagination pager toolbar".split()
)

#: With these, a name stands for the part as a whole: share-buttons, but not share-price-table.
_PLAIN = frozenset(
    "area bar block bottom box button buttons container content footer form global header inner item items left link links "
    "list main message outer page panel post posts articles stories primary right secondary section site slot top unit widget "
    "wrap wrapper".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+")


def _stands_for_part(name: str) -> bool:
    """Whether a class or id such as ad-box says nothing but what part of a site it is."""
    words = set(_WORD.findall(name))
    return bool(words & _NAMES) and words <= _NAMES | _PLAIN


class Element:
    """A node of the page; ``parts`` holds texts and elements in order."""

    __slots__ = ("article", "dropped", "foreign", "hash", "name", "named", "parts", "tag")

    def __init__(self, tag: str, attributes: str, in_article: bool, in_foreign: bool = False) -> None:
        self.tag = tag
        self.foreign = in_foreign or tag in ("svg", "math")
        self.parts: list[str | Element] = []
        self.hash = 0
        found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        self.name = f"{tag}.{found.get('class', '')}#{found.get('id', '')}" if found else tag
        words = {w.lower() for k in ("class", "id") for w in _WORD.findall(found.get(k, ""))} if found else frozenset()
        kind = (
            tag in _NO_TEXT
            or (tag == "header" and not in_article)
            or found.get("role", "").lower() in _ROLES
            or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
        )
        # dropped for a part of its class or id alone: 1, for a whole one: 2; in the article a part must not be one word of several
        self.named = 0
        if not kind and words & _NAMES:
            whole = {w.lower() for k in ("class", "id") for w in found.get(k, "").split()}
            if whole & _NAMES:
                self.named = 2
            elif not in_article or any(_stands_for_part(w) for w in whole):
                self.named = 1
        self.dropped = kind or self.named > 0
        # the root is never a notice of its own
        if tag in ("html", "body", "main") or (tag == "article" and not (words & {"comment", "comments", "ad", "ads", "advert"})):
            self.dropped, self.named = False, 0
        self.article = in_article or tag in ("article", "main") or found.get("role", "").lower() == "main"


def parse(page: str | None) -> Element:
    """The tree of a page; tags left open are closed where HTML closes them, cut ones are left out."""
    text = page or ""
    root = Element("html", "", False)
    stack, at = [root], 0
    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            if at < len(text):
                stack[-1].parts.append(text[at:])
            return root
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            else:
                if tag in ("p", "br"):  # HTML makes an empty element of these
                    stack[-1].parts.append(Element(tag, "", stack[-1].article))
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P or tag in _ENDS:
            closes = _ENDS.get(tag, frozenset())
            for depth in range(len(stack) - 1, 0, -1):
                found = stack[depth].tag
                if found in closes or (found == "p" and tag in _ENDS_P):
                    del stack[depth:]
                    break
                if found in _SCOPE:
                    break
        element = Element(tag, m[3], stack[-1].article, stack[-1].foreign)
        stack[-1].parts.append(element)
        # a slash closes nothing outside of drawings and formulas
        if tag in _VOID or (element.foreign and m[3].endswith("/")):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            element.parts.append(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text)
            continue
        stack.append(element)


def hash_tree(root: Element, host: str) -> None:
    """Give every element the hash of its host, names and texts, children first."""
    waiting: list[tuple[Element, bool]] = [(root, False)]
    while waiting:
        node, ready = waiting.pop()
        if not ready:
            waiting.append((node, True))
            waiting += [(p, False) for p in node.parts if not isinstance(p, str)]
            continue
        words = [node.name, host]
        for part in node.parts:
            words.append(" ".join(part.split()) if isinstance(part, str) else f"\x00{part.hash:x}")
        node.hash = xxhash.xxh64_intdigest("\x01".join(words).encode("utf-8", "replace"))


def _main(root: Element) -> list[Element]:
    """The outermost articles, else what is marked as main, else the page.

    What encloses one is passed through where only a part of a class or id would drop it (has-sidebar), and if
    nothing is found, where a whole one would.
    """
    for passed in (1, 2):
        for wanted in ("article", "main"):
            found, waiting = [], [root]
            while waiting:
                node = waiting.pop()
                if node.dropped and not 0 < node.named <= passed:
                    continue
                if node.tag == wanted and not node.dropped:
                    found.append(node)
                    continue
                waiting += [p for p in reversed(node.parts) if not isinstance(p, str)]
            if found:
                return found
    return [root]


def delete_templates(root: Element, templates) -> int:
    """Empty every subtree that ``templates`` holds, the whole page over; how many there were."""
    deleted, waiting = 0, [root]
    while waiting:
        node = waiting.pop()
        kept = []
        for part in node.parts:
            if isinstance(part, str):
                kept.append(part)
            elif part.tag not in _PAGE and templates(part):
                deleted += 1
                if part.tag not in _INLINE:
                    kept.append(" ")  # the blocks around it stay apart
            else:
                kept.append(part)
                waiting.append(part)
        node.parts = kept
    return deleted


def page_text(root: Element) -> str:
    """What tells a page from others: its main text, or if most of its text stands elsewhere, all of it."""
    main, whole = main_text(root), main_text(root, [root])
    return main if 2 * len(main) >= len(whole) else whole


def main_text(root: Element, within: list[Element] | None = None) -> str:
    """Text of the main content (or of ``within``), a space between blocks, without dropped elements."""
    out: list[str] = []
    waiting: list[str | Element] = list(reversed(within or _main(root)))
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if node.dropped:
            continue
        if node.tag not in _INLINE:
            out.append(" ")
            waiting.append(" ")
        waiting += reversed(node.parts)
    return " ".join(html.unescape("".join(out)).split())


def blocks(root: Element) -> Iterator[Element]:
    """Elements that may be part of a template: all with text but inline ones and whole pages."""
    waiting: list[Element] = [root]
    while waiting:
        node = waiting.pop()
        children = [p for p in node.parts if not isinstance(p, str)]
        waiting += children
        if node.tag in _INLINE or node.tag in _PAGE or node.tag in _VOID:
            continue
        if children or any(p.strip() for p in node.parts if isinstance(p, str)):
            yield node


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, *, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, subtree of every template of a host. ``pages``: host, html."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, subtrees, signatures, inside = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page)
                hash_tree(root, host)
                signature = _signed(xxhash.xxh64_intdigest(page_text(root).encode("utf-8", "replace")))
                seen = {_signed(node.hash): node.article for node in blocks(root)}
                # the page itself, for the number of pages of the host
                seen[0] = False
                for subtree, article in seen.items():
                    hosts.append(host)
                    subtrees.append(subtree)
                    signatures.append(signature)
                    inside.append(article)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts), pa.array(subtrees, pa.int64()), pa.array(signatures, pa.int64()), pa.array(inside, pa.bool_())],
                names=["host", "subtree", "signature", "inside"],
            )

    found = pages.mapInArrow(emit, "host string, subtree long, signature long, inside boolean")
    distinct = found.groupBy("host", "subtree", "signature").agg(F.max("inside").alias("inside"))
    counted = keep(
        distinct.groupBy("host", "subtree")
        .agg(F.count("*").alias("n"), F.max("inside").alias("inside"))
        .where((F.col("n") >= min_pages) | (F.col("subtree") == 0)),
        "subtrees",
    )
    total = counted.where("subtree = 0").select("host", F.col("n").alias("pages"))
    wanted = F.when(
        F.col("inside"), (F.col("n") >= MIN_PAGES_ARTICLE) & (F.col("n") >= F.col("pages") * SHARE_ARTICLE)
    ).otherwise(F.col("n") >= min_pages)
    return counted.where("subtree <> 0").join(total, "host").where(wanted).select("host", "subtree")


def extract(pages: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` (url, html and others) without html, with text and n_chars.

    An empty table gives an empty one. A null or empty page has an empty text; a page without a host shares the host ''. Columns named
    text or n_chars are replaced. Templates go to the workers, hosts in as many groups as keep
    each group's below ``limit`` bytes; every page is extracted once, with its host's group.
    """
    spark = pages.sparkSession
    base = without(pages, "text", "n_chars", "__host")
    at_host = base.withColumn("__host", host_of(F.col("url").cast("string")))
    templates = keep(
        site_templates(at_host.select(F.col("__host").alias("host"), F.coalesce("html", F.lit("")).alias("html"))),
        "templates",
    )
    groups = max(1, -(-templates.count() * 8 // limit))
    group = lambda host: F.pmod(F.xxhash64(host), F.lit(groups))
    results = [
        _extract(
            at_host if groups == 1 else at_host.where(group("__host") == k),
            _sent(spark, templates if groups == 1 else templates.where(group("host") == k)),
        )
        for k in range(groups)
    ]
    done = results[0]
    for more in results[1:]:
        done = done.union(more)
    return done


def _sent(spark: SparkSession, templates: DataFrame):
    return spark.sparkContext.broadcast(np.unique(np.array([r["subtree"] for r in templates.collect()], dtype=np.int64)))


def _extract(pages: DataFrame, templates) -> DataFrame:
    names = [c for c in pages.columns if c.lower() not in ("html", "__host")]
    html_at = [c.lower() for c in pages.columns].index("html")
    keep_at = [pages.columns.index(c) for c in names]
    host_at = pages.columns.index("__host")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in names) + "text string, n_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(templates.value.tolist())
        for batch in batches:
            texts = []
            for host, page in zip(batch.column(host_at).to_pylist(), batch.column(html_at).to_pylist(), strict=True):
                root = parse(page)
                if known:
                    hash_tree(root, host)
                    delete_templates(root, lambda node: _signed(node.hash) in known)
                texts.append(main_text(root))
            columns = [batch.column(k) for k in keep_at]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    return pages.mapInArrow(read, schema)
