"""Main text of web pages by nearest-URL page differencing.

1. A page becomes text lines (one per block element), each with a zone:
   ``main`` (inside <article>, <main> or role=main), ``boiler`` (inside a menu,
   header, footer, sidebar, form, script, advert, notice or reader comments,
   by element, role or class words) or ``open`` (anywhere else).
2. Pages of a host are put in URL-path order and each is paired with the
   neighbour whose path is nearest (longest common prefix).  Their lines are
   aligned by longest common subsequence.
3. Outside a container, shared lines are deleted.  Inside one (the article,
   of which nothing else may go) sharing marks a line, and the host decides: a marked line
   goes where the same line, in the same element path, was marked on more than
   half of the host's pages and on ``LEAST_VOTES`` at least, which is what a template
   does and a paragraph does not.  Pairs that share ``COPY_SHARE`` or more of the container's
   characters carry the same article and do not vote.  Boiler lines go
   whether shared or not: menus and footers also differ from page to page.  A
   page without a neighbour has nothing to be held against; there the container
   alone decides about lines outside it.

Class and id words count as whole names or as the head of a compound without
negation (``site-footer``, not ``no-footer``), on block elements only, and never
against the first container of a page or what holds it.

A host may hold a third of all pages, so pages are cut into ranges of (host,
path, id), one a task, and the pages next to a cut go to both sides: every page
meets its true neighbours, wherever the cuts fall.

Defined cases: null html gives no text; a null URL belongs to the host "";
pages with equal URLs are ordered by id; a page alone on its host has nothing
shared; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: NAMED is boiler by a class word only, which the page's first container overrules.
MAIN, OPEN, BOILER, NAMED = 0, 1, 2, 3
#: Shared part of a container from which on two pages carry the same article.
COPY_SHARE = 0.5
#: Pages of a host that must mark a line inside their containers before it counts as template.
LEAST_VOTES = 4

#: Elements whose text never belongs to the article.
BOILER_TAGS = frozenset(
    "nav header footer aside form head title menu dialog button select textarea input label iframe object".split())
#: Elements whose content is not text; skipped up to their end tag.
OPAQUE = "script|style|noscript|template|svg|math|textarea|iframe|object|select"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu".split())
#: Words in a class or id that name something other than the article.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar nav navbar navigation "
    "menu breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal newsletter subscribe share "
    "sharing social related recommended comment comments disqus respond footer header masthead toolbar pagination "
    "pager login search skip".split())
NEGATIONS = frozenset("no not non without has have with hide hides enable enabled disable disabled".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<opaque>{OPAQUE})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=opaque)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S | re.I)
ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def _names_boiler(names: str) -> bool:
    """Whether a class or id list names something other than the article."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if name in BOILER_WORDS or len(parts) > 1 and parts[-1] in BOILER_WORDS and NEGATIONS.isdisjoint(parts):
            return True
    return False


def _zone_of(tag: str, attrs: str, outer: int, first: bool) -> int:
    """Zone inside an element; ``first``: no container has been met yet."""
    if outer == BOILER or tag in BOILER_TAGS:
        return BOILER
    found = {}
    if attrs and "=" in attrs or "hidden" in attrs:
        found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
        role = found.get("role", "").lower()
        if role in BOILER_ROLES or found.get("aria-hidden", "").lower() == "true":
            return BOILER
        if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
            return BOILER
    container = tag in ("article", "main") or found.get("role", "").lower() == "main"
    if container and first:
        return MAIN
    if tag in BLOCK and tag not in ("html", "body") and _names_boiler(f"{found.get('class', '')} {found.get('id', '')}"):
        return NAMED
    return MAIN if container and outer != NAMED else outer


def page_lines(source: str) -> list[tuple[str, int, str]]:
    """(text, zone, element path) of every non-empty block in page order, references decoded, white space single."""
    lines: list[tuple[str, int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at, first = OPEN, 0, True

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                lines.append((text, zone, "/".join(t for t, _ in stack)))
            parts.clear()

    for m in TOKEN.finditer(source):
        if m.start() > at:
            parts.append(source[at:m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK or tag in BOILER_TAGS:
            flush()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    flush()
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag == "body":  # an unclosed head ends here
                stack.clear()
            outer = stack[-1][1] if stack else OPEN
            new = _zone_of(tag, m["attrs"] or m["attrs2"] or "", outer, first)
            first = first and new != MAIN
            if new != outer:
                flush()
            stack.append((tag, new))
        zone = stack[-1][1] if stack else OPEN
    if at < len(source):
        parts.append(source[at:])
    flush()
    return lines


def shared_lines(own: list[str], other: list[str]) -> set[int]:
    """Positions in ``own`` on a longest common subsequence with ``other`` (Hunt-Szymanski)."""
    at: dict[str, list[int]] = {}
    for j, x in enumerate(other):
        at.setdefault(x, []).append(j)
    tails: list[int] = []
    heads: list[tuple] = []
    for i, x in enumerate(own):
        for j in reversed(at.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, heads[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                heads.append(link)
            else:
                tails[k], heads[k] = j, link
    out, link = set(), heads[-1] if heads else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def line_mark(text: str, path: str) -> int:
    """64-bit digest of a line in its element path."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode(), digest_size=8).digest(), "little", signed=True)


def kept_lines(lines: list[tuple[str, int, str]], near: list[tuple[str, int, str]] | None
               ) -> tuple[list[tuple[str, int | None]], bool]:
    """Lines left after differencing, those of the container that are shared with their mark; whether marks are votes."""
    shared = shared_lines([x[0] for x in lines], [x[0] for x in near]) if near else set()
    inside = sum(len(x) for x, z, _ in lines if z == MAIN)
    copy = sum(len(lines[i][0]) for i in shared if lines[i][1] == MAIN) >= COPY_SHARE * inside
    keep = [(x, line_mark(x, p) if i in shared and z == MAIN else None) for i, (x, z, p) in enumerate(lines)
            if z == MAIN or z == OPEN and (near or not inside) and i not in shared]
    return keep, not copy


def main_text(lines: list[tuple[str, int, str]], near: list[tuple[str, int, str]] | None,
              template: frozenset[int] = frozenset()) -> str:
    """Text of a page, given its nearest page and the marks of its host's template lines."""
    return " ".join(x for x, mark in kept_lines(lines, near)[0] if mark is None or mark not in template)


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (slot, host, path, id); each page waits for its right neighbour.

    Pages of the next ranges (``own`` false) are neighbours only.
    """
    left = cur = None  # (group, path, lines) and, for cur, (page_id, url, own) too
    out: list[tuple] = []

    def emit(right) -> None:
        group, path, lines, pid, url, own = cur
        if not own:
            return
        score = lambda o: len(commonprefix((path, o[1]))) if o and o[0] == group else -1
        a, b = score(left), score(right)
        near = None if max(a, b) < 0 else (left if a >= b else right)
        keep, votes = kept_lines(lines, near[2] if near else None)
        out.append((pid, url, group[1], [x for x, _ in keep], [m for _, m in keep], votes))

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()),
                        ("lines", pa.list_(pa.string())), ("marks", pa.list_(pa.int64())), ("votes", pa.bool_())])
    pack = lambda: pa.record_batch([pa.array(list(c), f.type) for c, f in zip(list(zip(*out)) or [[]] * 6, schema)], schema=schema)
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("slot", "host", "path", "page_id", "url", "html", "own")]
        for slot, host, path, pid, url, source, own in zip(*cols):
            page = ((slot, host), path, page_lines(source or ""), pid, url, own)
            if cur is not None:
                emit(page)
                left = cur
            cur = page
        if out:
            yield pack()
            out.clear()
    if cur is not None:
        emit(None)
    yield pack()


def _ranges(rows: DataFrame, n: int) -> list[tuple]:
    """(lo, hi, first, last) of at most ``n`` ranges: keys of its pages with guests, and of its own.

    One row a range reaches the driver.
    """
    dealt = (rows.select("host", "path", "page_id").repartitionByRange(n, "host", "path", "page_id")
             .select(F.spark_partition_id().alias("part"), F.struct("host", "path", "page_id").alias("key")))
    ends = sorted(dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect())
    return [(ends[k - 1].last if k else e.first, ends[k + 1].first if k + 1 < len(ends) else e.last, e.first, e.last)
            for k, e in enumerate(ends)]


def _slots(bounds: list[tuple]):
    """Arrow UDF: the ranges that a page belongs to, its own and those it is next to, by binary search."""
    key = lambda k: tuple((x is not None, x) for x in (k.host, k.path, k.page_id))
    lo, hi, first, last = ([key(b[i]) for b in bounds] for i in range(4))

    @F.pandas_udf("array<struct<slot: int, own: boolean>>")
    def slots(host: pd.Series, path: pd.Series, page_id: pd.Series) -> pd.Series:
        out = []
        for h, p, i in zip(host, path, page_id):
            k = tuple((x is not None, x) for x in (h, p, None if i is None else int(i)))  # ids come as text: pandas has no null integer
            a, b = bisect_left(hi, k), bisect_right(lo, k)  # ranges a..b-1 hold the key
            out.append([(s, first[s] <= k <= last[s]) for s in range(a, b)])
        return pd.Series(out)
    return slots


def template_lines(marked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, template array<long>): marks that more than half of a host's pages, and LEAST_VOTES, give.

    ``sizes`` holds (host, pages).
    """
    votes = (marked.where("votes").select("host", F.explode(F.array_distinct(F.array_compact("marks"))).alias("mark"))
             .groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_VOTES))
    won = votes.join(sizes, "host").where("2 * n > pages")
    return won.groupBy("host").agg(F.collect_list("mark").alias("template"))  # lines that most pages carry: a page's worth


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str, ranges: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every page of ``df``."""
    spark = df.sparkSession
    parts = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", 0)
    host = F.lower(F.regexp_extract(parts, r"//([^/?#]*)", 1))
    rest = F.regexp_replace(parts, r"^[^/]*//[^/?#]*", "")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.col(html_col).alias("html"), host.alias("host"), rest.alias("path"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = _slots(_ranges(rows, n))
    slotted = rows.select("*", F.explode(slots("host", "path", F.col("page_id").cast("string"))).alias("at"))
    dealt = (slotted.select("at.slot", "host", "path", "page_id", "url", "html", "at.own")
             .repartitionById(n, "slot").sortWithinPartitions("slot", "host", "path", "page_id", "html"))
    pages = dealt.mapInArrow(_differ, "page_id long, url string, host string, lines array<string>, "
                                      "marks array<long>, votes boolean")
    # the three uses of ``pages`` read one exchange; only pages with marks meet the votes of their host
    has_marks = F.exists("marks", lambda m: m.isNotNull())
    marked = pages.where(has_marks)
    told = marked.join(template_lines(marked, rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))), "host", "left")
    stays = F.filter(F.arrays_zip("lines", "marks"),
                     lambda x: x["marks"].isNull() | ~F.coalesce(F.array_contains("template", x["marks"]), F.lit(False)))
    told = told.select("page_id", "url", F.array_join(F.transform(stays, lambda x: x["lines"]), " ").alias("text"))
    plain = pages.where(~has_marks).select("page_id", "url", F.array_join("lines", " ").alias("text"))
    return plain.unionByName(told).withColumn("n_chars", F.length("text").cast("long"))
