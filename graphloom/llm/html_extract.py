"""HTML extraction (9): template deduction from equivalence classes (Arasu and Garcia-Molina, 2003).

1. A page becomes tokens: its elements, by their path of tags and classes, and its text blocks.
2. A token's occurrence vector says how often each page of the host has it. Vectors are compared
   by an order-free digest, so grouping by (host, token) and then by (host, digest) needs no list
   of pages. Tokens of one vector form an equivalence class; a class of at least MIN_TOKENS tokens
   on at least MIN_PAGES pages is valid. Hosts with one page have no vectors to compare: they share
   the host "", so that what their pages have in common is deduced all the same.
3. Valid classes nest by their paths into the host's template. Text blocks of such classes are
   template, wherever they are. The main slot is a section of a once-a-page class that holds most
   of the text left over by the template: the deepest article or main element if one is among
   these sections, else the deepest section.
4. What remains in the main slot, without the template, is the page's text. Of the slots nested in
   it, those whose names say so (NAMES: comments, adverts) go: their texts differ from page to page like
   the article's, so no class can tell them apart.

If most of a slot's text is template, the host's pages are near copies of one another: blocks in
the slot stay. A slot with nothing but template on one page stays there, too. A page without the slot,
or of the host "" without most elements of its template, has none: there an article or main element
that holds most of the page's text counts, or else the whole body, and NAMES go.

Defined results: null html has empty text; a null or odd url has the host ""; repeated rows count
as pages of their own; character references without an end are decoded as browsers do; a tag cut
off by the end of the page is dropped; very long pages are whole (a batch has 4 MB or one page);
an empty table gives no rows; columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches

MIN_TOKENS, MIN_PAGES = 2, 2
#: Share of a host's pages that a text block of the template is on, and the least number of them.
TEXT_SHARE, TEXT_PAGES = 0.6, 5
#: Host tables of at most so many rows are broadcast.
BROADCAST_ROWS = 50_000

# HTML's vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTION = frozenset("body main article section div td center".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form noscript template iframe svg button select textarea object canvas dialog menu label option fieldset title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Names that sites like to give to what is not the article; used where the template cannot decide.
NAMES = frozenset(
    "nav navbar navigation menu menubar masthead topbar toolbar header footer sidebar aside rail notice notices cookie cookies consent gdpr banner alert ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist discussion replies disqus form newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager popup modal overlay widget search skip legal copyright disclaimer paywall".split()
)

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"(<(?:[a-zA-Z/](?:[^>\"']|\"[^\"]*\"|'[^']*')*|[!?][^>]*)>|<[a-zA-Z/][^>]*>|<[a-zA-Z/!?][^>]*\Z)")
NAME = re.compile(r"</?\s*([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


def _named(attrs: str, names: frozenset[str]) -> tuple[bool, str]:
    """Does a class, id or role say that this is no article; the classes."""
    if "=" not in attrs:
        return False, ""
    bad, classes = False, ""
    for kind, a, b, c in ATTR.findall(attrs):
        value = a or b or c
        if kind.lower() == "role":
            bad |= bool(names) and value.lower() in ROLES
            continue
        bad |= any(w.lower() in names for w in WORDS.split(value))
        if kind.lower() == "class":
            classes = ".".join(sorted(value.lower().split()))
    return bad, classes


def parse(html: str, names: frozenset[str]) -> tuple[list[tuple[str, str, bool, tuple]], dict[str, int]]:
    """Blocks (path, text, in an article, paths of the elements around it that are named as no article) in
    page order, and how often each element path occurs."""
    parts = TAG.split(RAW.sub(" ", html))
    stack: list[tuple[str, str, bool, bool, tuple]] = [("", "", False, False, ())]  # tag, path, dropped, in an article, named
    blocks: list[tuple[str, str, bool, tuple]] = []
    seen: dict[str, int] = defaultdict(int)
    held: list[str] = []
    at = stack[0]

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", html_lib.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((at[1], text, at[3], at[4]))

    for i, part in enumerate(parts):
        if i % 2 == 0:
            if part and not at[2]:
                held.append(part)
            continue
        m = NAME.match(part)
        if not m:
            continue
        tag = m[1].lower()
        if tag in ("br", "hr", "wbr"):
            held.append(" " if tag != "wbr" else "")
            continue
        closing = part[1] == "/"
        if tag in BLOCK or at[2] or tag in DROPPED:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            at = stack[-1]
        elif tag not in VOID:
            if tag in BLOCK:
                # A paragraph cannot hold a block, nor a list item another one.
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "td", "th", "tr", "dd", "dt"):
                        del stack[k:]
                        break
                    if stack[k][0] in SECTION or stack[k][0] in ("ul", "ol", "table", "tr"):
                        break
                at = stack[-1]
            bad, classes = _named(part[m.end() :], names)
            article = at[3] or tag in ("article", "main")
            dropped = at[2] or tag in DROPPED
            if tag == "header":
                dropped = at[2] or not at[3]
            path = f"{at[1]}/{tag}.{classes}" if classes else f"{at[1]}/{tag}"
            if tag in BLOCK:
                seen[path] += 1
            named = (*at[4], path) if bad and tag not in ("html", "body", "article", "main") else at[4]
            stack.append((tag, path, dropped, article, named))
            at = stack[-1]
    flush()
    return blocks, seen


def in_article_header(path: str) -> bool:
    """Inside an article's header only headings belong to the text."""
    tags = [p.split(".")[0] for p in path.split("/")]
    return "header" in tags and tags[-1] not in HEADING


def content(html: str, names: frozenset[str] = NAMES) -> tuple[list[tuple[str, str, bool, tuple]], dict[str, int]]:
    """parse() without what an article's header has besides headings."""
    blocks, seen = parse(html, names)
    return [x for x in blocks if not in_article_header(x[0])], seen


def inside(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def _name(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def _halves(page: str, n: int) -> tuple[int, int]:
    """What a page that has a token n times adds to its vector's digest: two numbers below 2^32, whose sums over up to 2^31 pages fit a long."""
    h = xxhash.xxh64_intdigest(f"{n}\x00{page}")
    return h >> 32, h & 0xFFFFFFFF


def _tokens(pages: DataFrame) -> DataFrame:
    """host, token, text (or an element), path, pages, v1 and v2 (the vector's digest), once (at most once a page), chars: summed by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict = {}

            def add(host, token, text, path, page, n, chars):
                old = sums.get((host, token), (text, path, 0, 0, 0, True, 0))
                v1, v2 = _halves(page, n)
                sums[host, token] = (text, path, old[2] + 1, old[3] + v1, old[4] + v2, old[5] and n == 1, old[6] + chars)

            for page_id, host, html in zip(b["page_id"], b["host"], b["html"]):
                # Equal rows add equal numbers, so digests do not depend on where a row is.
                page = f"{page_id}:{xxhash.xxh128_hexdigest(html or '')}"
                blocks, seen = content(html or "")
                chars: dict = defaultdict(int)
                texts: dict = defaultdict(int)
                for path, text, *_ in blocks:
                    texts[path, text] += 1
                    at = ""
                    for step in path.split("/")[1:]:
                        at = f"{at}/{step}"
                        chars[at] += len(text)
                for path, n in seen.items():
                    add(host, _name("e", path), False, path, page, n, chars[path])
                for (path, text), n in texts.items():
                    add(host, _name("t", path, text), True, path, page, n, n * len(text))
            yield pd.DataFrame([(h, t, *v) for (h, t), v in sums.items()], columns=["host", "token", "text", "path", "pages", "v1", "v2", "once", "chars"])

    return pages.mapInPandas(run, "host string, token long, text boolean, path string, pages long, v1 long, v2 long, once boolean, chars long")


def _choose(elements: list, texts: list) -> tuple[str | None, list[int], list[str]]:
    """choose_slot() of rows, and the template's element paths."""
    elements = [(e["path"], e["able"], e["chars"]) for e in elements]
    return *choose_slot(elements, [(t["token"], t["path"], t["chars"]) for t in texts]), [path for path, *_ in elements]


def choose_slot(elements: list[tuple[str, bool, int]], texts: list[tuple[int, str, int]]) -> tuple[str | None, list[int]]:
    """The main slot and the names of the template's blocks. elements: path, may it be the slot,
    chars; texts: name, path, chars of the template's blocks."""
    chars = {path: n for path, _, n in elements}
    left = {path: n - sum(size for _, at, size in texts if inside(at, path)) for path, n in chars.items()}
    if not any(left.values()):  # Nothing differs between the pages.
        left = chars
    most = max(left.values(), default=0)
    slots = [path for path, able, _ in elements if able and 2 * left[path] > most]
    if not slots:
        return None, [name for name, *_ in texts]
    slot = max(slots, key=lambda path: (path.split("/")[-1].split(".")[0] in ("article", "main"), path.count("/"), path))
    copies = 2 * sum(size for _, at, size in texts if inside(at, slot)) > chars[slot]
    return slot, [name for name, at, _ in texts if not (copies and inside(at, slot))]


def deduce_templates(pages: DataFrame) -> DataFrame:
    """host, slot (path of the main slot or null), texts (names of the template's text blocks), paths (of
    its elements) of hosts with several pages, and of the host ""."""
    sums = [F.sum(c).alias(c) for c in ("pages", "v1", "v2", "chars")]
    tokens = _tokens(pages).groupBy("host", "token").agg(F.first("text").alias("text"), F.max("path").alias("path"), F.min("once").alias("once"), *sums)
    # A token of one page is in no valid class.
    tokens = materialize(tokens.filter(F.col("pages") >= MIN_PAGES))
    classes = tokens.groupBy("host", "v1", "v2", "pages").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= MIN_TOKENS).drop("size")
    hosts = tokens.groupBy("host").agg(F.max("pages").alias("host_pages"))
    section = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), 1).isin(*SECTION)
    template = tokens.join(classes, ["host", "v1", "v2", "pages"], "left_semi").join(hosts, "host")
    able = F.col("once") & section
    element = ~F.col("text") & (2 * F.col("pages") > F.col("host_pages"))
    text = F.col("text") & (F.col("pages") >= TEXT_PAGES) & (F.col("pages") >= TEXT_SHARE * F.col("host_pages"))
    # At most tokens-of-a-page / share tokens can be on such a share of a host's pages.
    lists = template.filter(element | text).groupBy("host").agg(
        F.collect_list(F.when(element, F.struct("path", able.alias("able"), "chars"))).alias("elements"), F.collect_list(F.when(text, F.struct("token", "path", "chars"))).alias("blocks")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_choose(es, ts) for es, ts in zip(b["elements"], b["blocks"])]
            yield pd.DataFrame({"host": b["host"], **{k: pd.Series([x[i] for x in found], dtype=object) for i, k in enumerate(("slot", "texts", "paths"))}})

    return materialize(lists.mapInPandas(run, "host string, slot string, texts array<long>, paths array<string>"))


def article_text(html: str, slot: str | None, template: frozenset[int], paths: list[str] = (), names: frozenset[str] = NAMES) -> str:  # type: ignore[assignment]
    """The text of one page under its host's template. paths: elements most of which the page must have."""
    blocks, seen = content(html, names)
    kept = [x for x in blocks if not template or _name("t", *x[:2]) not in template]
    if slot:
        here = [x for x in blocks if inside(x[0], slot)]
        if here and 2 * sum(p in seen for p in paths) >= len(paths):
            # Named elements are no article if they are slots inside the main slot.
            nested = lambda x: any(at != slot and inside(at, slot) for at in x[3])
            found = [x for x in kept if inside(x[0], slot)] or here
            return "\n".join(x[1] for x in ([x for x in found if not nested(x)] or found))
    kept = [x for x in kept if not x[3]] or kept or blocks
    article = [x[1] for x in kept if x[2]]
    if 2 * sum(map(len, article)) > sum(len(x[1]) for x in kept):
        return "\n".join(article)
    return "\n".join(x[1] for x in kept)


def extract(pages: DataFrame, names: frozenset[str] = NAMES) -> DataFrame:
    """page_id, url, text, n_chars of every page. names: words of classes and ids that are no article."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    # Hosts of several pages by the urls alone; the others share the host "".
    several = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and host <> ''").select("host"))
    rows = rows.join(_small(several.withColumn("several", F.lit(True))), "host", "left").withColumn("host", F.when(F.col("several"), F.col("host")).otherwise(""))
    templates = deduce_templates(rows.select("page_id", "host", "html"))
    rows = rows.join(_small(templates), "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # Pages of a host have its template; that of the host "" need not be theirs.
            columns = zip(b["html"], b["slot"], b["texts"], b["paths"], b["host"])
            texts = [article_text(x or "", s, frozenset(t) if t is not None else frozenset(), p if h == "" and p is not None else (), names) for x, s, t, p, h in columns]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.select("page_id", "url", "html", "slot", "texts", "paths", "host").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def _small(hosts: DataFrame) -> DataFrame:
    return F.broadcast(hosts) if hosts.count() <= BROADCAST_ROWS else hosts
