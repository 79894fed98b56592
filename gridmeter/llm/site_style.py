"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles. An element's path (tags with classes and ids from
the root) is a node; its presentation styles are the sequences of child tags that pages give it, and its
content features are the texts of its blocks and the targets of its links. With m distinct pages:

- presentation importance: the entropy of the style shares to the base m (1 where m is 1);
- content importance of a leaf: 1 - the mean over its features of log_m(pages that show the feature).

A leaf's composite importance adds the presentation importance of its ancestors, the nearest first,
discounted by (1 - g) g**distance, to g**depth times its content importance. A branch goes when all its
leaves fall below `least`; below twice that where a class or id in its path has a word of NOISE_NAMES. Landmarks give the tree a prior: branches that are menus, headers, footers,
sidebars, notices, adverts, scripts, comments or hidden have importance 0 (a header within an
article counts as its heading). A name says so only if all its words do ("cookie-banner", not "cookie-recipe"). Where a page has an article or main element with prose, what stands
outside has importance 0 too, unless that is four times as much prose; articles of headings and links alone are teasers beside one with prose.
A form goes, but for one around an article or around most of a page's prose, which loses its labels only. If
the tree would leave nothing but headings of a page (hosts whose pages are all copies), the priors alone decide for that page.

Only paths, counts and hashes leave the pages; equal pages of a host count once. The low branches go to
the pages by a broadcast up to a checked size and else by a join whose keys are salted, so that one host
may hold most pages.

Defined results: null or empty html gives empty text and 0 code points; a null url is a host of its own,
""; tags that are never closed end with their parents; broken markup is read on as text. Other columns are
ignored; rows that repeat a page_id give a row each.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small_batches

#: Composite importance below which a branch goes, the discount, and the pages from which a host is judged.
LEAST, DISCOUNT, MIN_PAGES = 0.2, 0.9, 5
BROADCAST_PATHS, SALTS = 200_000, 64
#: So many times an article's prose outside of it, and it is no main part.
OUTSIDE = 4
#: HTML's elements by kind.
PROSE_TAGS = frozenset("p li td dd dt pre blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas object select".split())
INLINE = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav footer aside button head dialog menu".split())
HEADINGS, LABELS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("label legend".split())
MAIN_TAGS = frozenset(("article", "main"))
#: A new one of these ends an open one (and what is open in it), up to the nearest of the second set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body div article main section nav aside header footer ul ol dl table td th blockquote form".split())
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of classes, ids and roles for what is no part of an article, and words for parts of a page. A name of such words alone, with one of the
#: first or second list, marks a branch as no part of the article; a word of the first list anywhere makes the tree doubt the branch.
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer sidebar "
    "cookie cookies consent gdpr newsletter subscription signup comments commentlist disqus pagination pager masthead topbar contentinfo complementary".split()
)
NOISE_PARTS = frozenset(
    "promo promotion aside widget widgets related recommended notice notices notification alert popup modal overlay subscribe login share sharing social comment "
    "reply replies respond toolbar search hidden skip".split()
)
PART_WORDS = frozenset(
    "area article articles bar block blog bottom box button buttons container content desktop dialog entry fixed form global header icons inner item items left link links list main "
    "mobile page panel post posts primary right row secondary section site slot sticky stories thread title top unit wrap wrapper".split()
)
#: An article element with one of these is no main part of its page.
TEASERS = frozenset("teaser card preview promo related recommended summary".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=\s*+[^\s>\"']*+|[\"'])*+)(>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("article", "children", "form", "link", "main", "noise", "path", "tag")

    def __init__(self, tag: str, path: str, noise: bool, main: bool, article: int = 0, form: int = 0, link: bool = False):
        """article and form: numbers of the outermost article and form that the node is in, or 0."""
        self.tag, self.path, self.noise, self.main, self.article, self.form, self.link, self.children = tag, path, noise, main, article, form, link, []


class Block:
    """Text of one block element, in page order, up to the next block's start."""

    __slots__ = ("href", "main", "node", "parts", "prose")

    def __init__(self, node: Node, main: bool):
        self.node, self.main, self.parts, self.href, self.prose = node, main, [], [], 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag; of several of one name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or (m[4] or "").strip("\"'")))
    return out


def _noise(names: list[str]) -> bool:
    """Whether one of the names says, with all its words, that a branch is no part of the article."""
    for name in names:
        parts = _WORD.findall(name)
        if any(p in NOISE_NAMES or p in NOISE_PARTS for p in parts) and all(p in NOISE_NAMES or p in NOISE_PARTS or p in PART_WORDS for p in parts):
            return True
    return False


def _hidden(a: dict[str, str]) -> bool:
    style = "".join(a.get("style", "").lower().split())
    return "hidden" in a or a.get("aria-hidden", "").strip().lower() == "true" or "display:none" in style or "visibility:hidden" in style


def parse(source: str) -> tuple[list[Block], dict[str, list[str]], set[int]]:
    """Blocks in page order that no landmark removes (with whether they stand in the main part), child sequences by path, forms that hold a main part."""
    root = Node("", "", False, False)
    stack, blocks, styles, around = [root], [], {}, set()
    articles = forms = 0
    block: Block | None = None
    skip = ""  # the raw element we are in
    at = 0

    def add(text: str) -> None:
        nonlocal block
        if stack[-1].noise:
            return
        if block is None:
            if not text.strip():
                return
            node = next(n for n in reversed(stack) if n.tag not in INLINE)
            block = Block(node, stack[-1].main)
            blocks.append(block)
        block.parts.append(text)
        if not stack[-1].link:
            block.prose += len(text.strip())

    def close(k: int) -> None:
        nonlocal block
        for n in reversed(stack[k:]):
            if n.tag not in INLINE:
                block = None
            styles.setdefault(n.path, []).append(",".join(n.children))
        del stack[k:]

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        end, tag = m[1], (m[2] or "").lower()
        if skip:
            if not (end and tag == skip):
                continue
            skip, at = "", m.end()
            continue
        if m.start() > at:
            add(html.unescape(source[at : m.start()]))
        at = m.end()
        if not tag or (not m[4] and not end):  # a comment, a declaration, or a tag cut off by the page's end
            continue
        if end:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k:
                close(k)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                skip = tag
            stack[-1].children.append(tag)
            continue
        if tag in VOID:
            stack[-1].children.append(tag)
            if tag == "br":
                if block is not None:
                    block.parts.append(" ")
            elif tag == "hr":
                block = None
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS_END_P else set())
        if shut:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    close(i)
                    if tag not in ("tr", "td", "th"):
                        break
                elif stack[i].tag in SCOPES and stack[i].tag not in shut:
                    break
        a = _attributes(m[3])
        names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".lower().split()
        parent = stack[-1]
        own_main = tag in MAIN_TAGS or a.get("role", "").lower() in ("main", "article")
        main = parent.main or own_main and not (tag == "article" and any(w in TEASERS for n in names for w in _WORD.findall(n)))
        noise = parent.noise or tag in NOISE_TAGS or tag in LABELS and parent.form > 0 or _hidden(a) or _noise(names) and tag not in ("html", "body", *MAIN_TAGS) or tag == "header" and not parent.main
        label = f"{tag}.{'.'.join(sorted(_DIGITS.sub('0', a.get('class', '') + ' ' + a.get('id', '')).split()))}" if names else tag
        parent.children.append(label)
        if own_main:
            around.add(parent.form)
        article = parent.article
        if not article and (tag == "article" or a.get("role", "").lower() == "article"):
            articles += 1
            article = articles
        if tag == "form" and not parent.form:
            forms += 1
        form = parent.form or (forms if tag == "form" else 0)
        node = Node(tag, f"{parent.path}/{label}", noise, main and not noise, article, form, parent.link or tag == "a" or tag in HEADINGS)
        if tag not in INLINE:
            block = None
        stack.append(node)
        if tag == "a" and block is not None and a.get("href"):
            block.href.append(a["href"])
    if not skip and at < len(source):
        add(html.unescape(source[at:]))
    close(0)
    return blocks, styles, around


def _prose(blocks: list[Block]) -> int:
    """Characters outside headings and links."""
    return sum(b.prose for b in blocks)


def _kept(source: str | None) -> tuple[list[Block], dict[str, list[str]]]:
    """Blocks after the priors."""
    blocks, styles, around = parse(source or "")
    blocks = [b for b in blocks if b.text()]
    wide = {f for f in {b.node.form for b in blocks} if 2 * _prose([b for b in blocks if b.node.form == f and b.node.tag in PROSE_TAGS]) > _prose(blocks)}
    blocks = [b for b in blocks if not b.node.form or b.node.form in around or b.node.form in wide]
    told = {b.node.article for b in blocks if b.main and b.prose}
    if told - {0}:
        blocks = [b for b in blocks if not (b.main and b.node.article and b.node.article not in told)]
    main = [b for b in blocks if b.main]
    if main and _prose([b for b in blocks if not b.main and b.node.tag in PROSE_TAGS]) <= OUTSIDE * _prose(main):
        return main, styles
    if main and told - {0}:  # articles beside a longer story are its teasers
        return [b for b in blocks if not (b.main and b.node.article)], styles
    return blocks, styles


def main_text(source: str | None, low: set[str] = frozenset()) -> str:
    """The page's text without the branches whose paths are low."""
    blocks, _ = _kept(source)
    if low:
        stay = [b for b in blocks if b.node.path not in low]
        if any(b.node.tag not in HEADINGS for b in stay):
            blocks = stay
    return " ".join(b.text() for b in blocks)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, kind (0 style, 1 content), feature, pages, times: summed over the pages of a batch."""
    for batch in batches:
        counts: Counter = Counter()
        for site, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            blocks, styles = _kept(source)
            own: Counter = Counter()
            paths = set()
            for b in blocks:
                for f in (b.text(), *b.href):
                    own[b.node.path, 1, _hash(_DIGITS.sub("0", f))] += 1
                path = b.node.path
                while path and path not in paths:
                    paths.add(path)
                    path = path.rpartition("/")[0]
            for path in paths:
                own[path, 0, _hash("|".join(styles.get(path, ())))] += 1
            for key, n in own.items():
                counts[(site, *key, 0)] += 1
                counts[(site, *key, 1)] += n
        keys = [k[:4] for k in counts if k[4] == 0]
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))]
        columns += [pa.array([counts[(*k, i)] for k in keys], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "path", "kind", "feature", "pages", "times"])


def _doubted(path: Column) -> Column:
    """Whether a class or id below the body has a word of NOISE_NAMES."""
    return F.regexp_replace(F.lower(path), "^/html[^/]*/body[^/]*", "").rlike(f"(?<![a-z])({'|'.join(sorted(NOISE_NAMES))})(?![a-z])")


def low_paths(pages: DataFrame, least: float = LEAST, discount: float = DISCOUNT, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, path of the leaves whose composite importance on their host is below least. pages: host, html."""
    distinct = pages.dropDuplicates(["host", "html"])
    found = distinct.mapInArrow(_features, "host string, path string, kind int, feature long, pages long, times long")
    found = materialize(found.groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("pages"), F.sum("times").alias("times")))
    total = materialize(found.filter("kind = 0").groupBy("host", "path").agg(F.sum("pages").alias("m"))).filter(F.col("m") >= min_pages)
    rows = found.join(total, ["host", "path"])
    share, base = F.col("pages") / F.col("m"), F.log(F.col("m"))
    nodes = rows.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, -share * F.log(share) / base)).alias("style"),
        (1 - F.sum(F.when(F.col("kind") == 1, F.col("times") * F.log("pages") / base)) / F.sum(F.when(F.col("kind") == 1, F.col("times")))).alias("content"),
    )
    leaves = nodes.filter("content IS NOT NULL").withColumn("parts", F.split("path", "/")).withColumn("depth", F.size("parts") - 1)
    up = leaves.select("host", "path", "content", "depth", F.posexplode(F.expr("transform(sequence(0, depth - 1), d -> array_join(slice(parts, 1, depth + 1 - d), '/'))")).alias("far", "ancestor"))
    styles = nodes.select("host", F.col("path").alias("ancestor"), "style")
    joined = up.join(styles, ["host", "ancestor"], "left")
    weight = F.lit(1 - discount) * F.pow(F.lit(discount), F.col("far"))
    composite = F.sum(weight * F.coalesce("style", F.lit(1.0))) + F.pow(F.lit(discount), F.max("depth")) * F.max("content")
    return materialize(joined.groupBy("host", "path").agg(composite.alias("importance")).filter(F.col("importance") < F.when(_doubted(F.col("path")), 2 * least).otherwise(least)).groupBy("host").agg(F.collect_set("path").alias("low")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(source, set(low or ())) for source, low in zip(batch["html"].to_pylist(), batch["low"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    low = low_paths(pages.select("host", "html").filter("html IS NOT NULL"), least)
    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_PATHS:
        joined = pages.join(F.broadcast(low), "host", "left")
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
