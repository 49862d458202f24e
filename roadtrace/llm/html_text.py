"""HTML extraction: nearest-URL page differencing, over lines that a reading of the page's structure marks.

Pages of a host are ordered by URL path and paired with the neighbour whose path is nearer and whose lines differ. Text lines
are aligned by longest common subsequence, and lines that both have are deleted. The structure's part: menus, adverts and so on
go by their tags, roles and class names; lines inside <article> or <main> are marked as the article's own and stay, since
articles may quote each other. A class name counts only whole (see named()), and inside an article only for a minor part of its
text: what holds half of it or more may be the article itself, so that differencing decides its lines.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .url_filter import parts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
OPEN = re.compile(r"<!--.*", re.S)  # a comment without an end
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "canvas", "audio", "video"}
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "label", "fieldset"}
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "b", "i", "em", "strong", "a", "u", "small", "font", "code"}  # ends may be missing
MAIN = {"article", "main"}
NAMES = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
#: Words that may stand beside such a name in one class token.
FILLERS = set("area bar block bottom box buttons container content form icons inner item items left link links list main outer page panel right section site slot text top unit wrap wrapper".split())
#: Reader comments may be longer than the article, so that these names count whatever the size.
READERS = {"comment", "comments", "disqus", "replies", "reply"}
BODY, FREE, DOUBT = 0, 1, 2
#: A page with which so much of one's lines is shared is taken for a copy and says nothing about what is template.
COPY = 0.9


def named(token: str) -> set[str]:
    """The parts of a class token in NAMES, if all its parts are there or in FILLERS: ad-slot and footer, but not search-engine."""
    pieces = {x for x in re.split(r"[^a-z0-9]+", token) if x}
    return pieces & NAMES if pieces <= NAMES | FILLERS else set()


def _unwanted(tag: str, attributes: str, inside: bool) -> int:
    """Of an element: 0 wanted, 1 unwanted, 2 unwanted unless it turns out to hold the article."""
    if tag in DROPPED or (tag == "header" and not inside):
        return 1
    if tag in ("html", "body") or not attributes:
        return 0
    doubt = 0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return 1
        if name == "role" and value in ROLES:
            return 1
        if name in ("class", "id") and tag not in MAIN:
            names = set().union(*map(named, value.split()))
            if names & READERS or (names and not inside):
                return 1
            doubt = doubt or (2 if names else 0)
    return doubt


def lines(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order, white space as single spaces, references decoded.

    BODY: inside <article> or <main>. DOUBT: there, in an outermost element with an unwanted name that holds half of the text in
    there or more. FREE: outside. Blocks of unwanted elements, and what isn't text, are left out.
    """
    if not page:
        return []
    out: list[tuple[int, str, int]] = []  # and the number of the outermost named element, or 0
    stack: list[tuple[str, int]] = []  # open elements that must be closed, and whether they are unwanted
    depth: Counter[str] = Counter()  # of each tag in the stack
    last = page.rfind(">") + 1  # no tag ends after it
    away = inside = doubts = element = 0
    buffer: list[str] = []
    at = 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text and not away:
                out.append((BODY if inside else FREE, text, element if doubts else 0))

    while True:
        m = TOKEN.search(page, at, last) or (OPEN.search(page, at) if at <= len(page) else None)
        if (m.start() if m else len(page)) > at and not away:
            buffer.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m.re is OPEN or m[2] is None:
            if m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
                at = len(page)  # without an end
            continue
        end, tag = m[1], m[2].lower()
        if tag in BLOCKS:
            flush()
        if not end and tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag in VOID:
            continue
        elif not end:
            bad = _unwanted(tag, m[3], inside > 0)
            if m[3].endswith("/") or (tag in LOOSE and not bad):
                continue
            stack.append((tag, bad))
            depth[tag] += 1
            away += bad == 1
            element += bad == 2 and not doubts
            doubts += bad == 2
            inside += tag in MAIN
        elif depth[tag]:
            while True:
                t, bad = stack.pop()
                depth[t] -= 1
                away -= bad == 1
                doubts -= bad == 2
                inside -= t in MAIN
                if t == tag:
                    break
    flush()
    sizes: Counter[int] = Counter()
    for kind, text, element in out:
        if kind == BODY:
            sizes[element] += len(text)
    major = {e for e, n in sizes.items() if 2 * n >= sizes.total()}
    return [(DOUBT if element else kind, text) for kind, text, element in out if not element or element in major]


def shared(a: list[int], b: list[int]) -> set[int]:
    """Indices of a in a longest common subsequence with b.

    Rows of the table are bit sets over b, one big integer each, whose zeros are the smallest ends of common subsequences of
    each length (Hyyro, 2004). Every step-th row is kept, and the rows between are made again on the way back.
    """
    out, top = set(), min(len(a), len(b))
    head = next((i for i in range(top) if a[i] != b[i]), top)
    tail = next((i for i in range(top - head) if a[-1 - i] != b[-1 - i]), top - head)
    out |= {*range(head), *range(len(a) - tail, len(a))}
    known = set(a[head : len(a) - tail])
    b = [y for y in b[head : len(b) - tail] if y in known]
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    rows = [(i, x) for i, x in enumerate(a[head : len(a) - tail], head) if x in where]
    if not rows:
        return out
    for y, places in where.items():
        bits = bytearray(len(b) // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        where[y] = int.from_bytes(bits, "little")
    mask = (1 << len(b)) - 1

    def after(v: int, lo: int, hi: int) -> Iterator[int]:
        for _, x in rows[lo:hi]:
            u = v & where[x]
            v = ((v + u) | (v - u)) & mask
            yield v

    step, v = isqrt(len(rows)) + 1, mask
    kept = [mask]
    for lo in range(0, len(rows), step):
        for v in after(v, lo, lo + step):
            pass
        kept.append(v)
    i, block, table = len(rows), -1, []

    def row(n: int) -> int:
        nonlocal block, table
        if n == 0:
            return mask
        if (n - 1) // step != block:
            block = (n - 1) // step
            table = list(after(kept[block], block * step, block * step + step))
        return table[(n - 1) % step]

    j = len(b)
    while i:
        j = (~row(i) & mask & ((1 << j) - 1)).bit_length() - 1
        if j < 0:
            break
        while i > 1 and not row(i - 1) >> j & 1:
            i -= 1
        i -= 1
        out.add(rows[i][0])
    return out


def neighbours(urls: DataFrame) -> DataFrame:
    """(host, digest, near, far) for urls (key, host, path, digest): keys of the two neighbours in path order, the one whose
    path has the longer prefix in common first.

    Pages of a host that have the same lines, and so digest, count as one, at the first of their URLs. Ties go to the
    neighbour before. The only page of a host, and pages without a host, have none. Pages are ordered over range partitions;
    the rows at partitions' edges, two each, meet in a second, small ordering.
    """
    order = ["host", "path", "key"]
    nodes = urls.where("host <> ''").groupBy("host", "digest").agg(F.min(F.struct("path", "key")).alias("at")).select("host", "digest", "at.path", "at.key")
    dealt = written(nodes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "urls")
    w = Window.partitionBy("part").orderBy(*order)
    near = lambda w: {"before": F.lag(F.struct(*order)).over(w), "after": F.lead(F.struct(*order)).over(w)}
    inner = dealt.withColumns(near(w))
    edges = inner.where("before is null or after is null").drop("before", "after").withColumns(near(Window.partitionBy(F.lit(0)).orderBy(*order)))
    inner = inner.join(edges.select("host", "digest", F.col("before").alias("b2"), F.col("after").alias("a2")), ["host", "digest"], "left")
    before, after = F.coalesce("before", "b2"), F.coalesce("after", "a2")
    df = inner.select("host", "digest", "path", F.when(before["host"] == F.col("host"), before).alias("b"), F.when(after["host"] == F.col("host"), after).alias("a"))
    cut = lambda other: F.when(other.isNull(), -1).otherwise(_common("path", other["path"]))
    first = cut(F.col("b")) >= cut(F.col("a"))
    return df.select("host", "digest", F.when(first, F.col("b.key")).otherwise(F.col("a.key")).alias("near"), F.when(first, F.col("a.key")).otherwise(F.col("b.key")).alias("far")).where("near is not null")


def _common(a, b):
    """Length of the common prefix of two strings."""
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([next((i for i, (p, q) in enumerate(zip(s or "", t or "")) if p != q), min(len(s or ""), len(t or ""))) for s, t in zip(x, y)])

    return F.pandas_udf(run, "int")(a, b)


def kept(kinds: list[int], own: list[int], partners: list[list[int] | None]) -> list[int]:
    """Indices of the lines that are the page's text: own and partners' are hashes of lines, the nearest partner first.

    A partner with which a page shares COPY of its lines or more is a copy and says nothing. BODY lines stay; of the others
    those that the first other partner hasn't. Without such a partner all lines stay, or all but FREE ones where there are others.
    """
    for other in partners:
        if other is not None:
            both = shared(own, other)
            if len(both) < COPY * len(own):
                return [i for i, k in enumerate(kinds) if k == BODY or i not in both]
    return [i for i, k in enumerate(kinds) if k != FREE or all(k == FREE for k in kinds)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html).

    The text of a page is its lines by kept(): those inside <article> or <main>, and those outside, but for menus and other
    unwanted elements, that the page at the nearest URL of the host hasn't. Null and empty pages have an empty text. Pages
    with a null or malformed URL, or alone on their host, have no partner. Equal rows have equal results. Pages all of
    whose lines are the article's take no part in the pairing but as partners.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [lines(h) for h in b["html"]]
            hashes = [[xxhash.xxh64_intdigest(t) - (1 << 63) for _, t in f] for f in found]
            loose = [any(k != BODY for k, _ in f) for f in found]
            yield pd.DataFrame({
                "key": b["key"], "page_id": b["page_id"], "url": b["url"], "text": [None if x else " ".join(t for _, t in f) for f, x in zip(found, loose)],
                "kinds": [[k for k, _ in f] if x else [] for f, x in zip(found, loose)], "texts": [[t for _, t in f] if x else [] for f, x in zip(found, loose)],
                "hashes": hashes, "digest": [xxhash.xxh64_intdigest(np.array(h, "i8").tobytes()) - (1 << 63) for h in hashes],
            })

    # Ids travel as text: pandas would turn whole numbers beside nulls into doubles.
    keyed = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").withColumn("key", F.xxhash64("page_id", "url", "html"))
    parsed = written(keyed.mapInPandas(parse, "key long, page_id string, url string, text string, kinds array<int>, texts array<string>, hashes array<long>, digest long"), "lines")
    done, loose = parsed.where("text is not null").select("page_id", "url", "text"), parsed.where("text is null")
    out = done
    if not loose.isEmpty():
        at = parts(parsed.select("key", "url", "digest")).select("key", "host", "path", "digest")
        pairs = written(at.join(loose.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).join(neighbours(at), ["host", "digest"]).select("key", "near", "far"), "partners")
        asked = pairs.select(F.col("near").alias("key")).union(pairs.select("far")).distinct()
        theirs = parsed.select("key", "hashes").join(asked, "key", "left_semi").dropDuplicates(["key"])
        side = lambda c: theirs.select(F.col("key").alias(c), F.col("hashes").alias(f"{c}_lines"))
        met = loose.join(pairs.join(side("near"), "near").join(side("far"), "far", "left").select("key", "near_lines", "far_lines"), "key", "left")
        out = out.union(met.select("page_id", "url", "kinds", "texts", "hashes", "near_lines", "far_lines").mapInPandas(_differ, "page_id string, url string, text string"))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def _differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    plain = lambda x: None if x is None else list(x)
    for b in batches:
        texts = []
        for kinds, own, mine, near, far in zip(b["kinds"], b["texts"], b["hashes"], b["near_lines"], b["far_lines"]):
            texts.append(" ".join(own[i] for i in kept(list(kinds), list(mine), [plain(near), plain(far)])))
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
