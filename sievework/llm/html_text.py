"""Main text of web pages by nearest-URL page differencing (operator 4).

Each page is cut into text lines, one for each block of its markup, and a line knows where it stands: in something
that is never part of an article (menu, header, footer, sidebar, form, advert, notice, comments, script, style, head),
in an article element, or loose, outside both. Pages with loose lines are ordered by host and path; each is paired with
the page before it and the page after it in its host. Its loose lines are aligned with those of either by their longest
common subsequence, and the shared ones, which the site's template wrote, are deleted. The main text is the article's
lines and the loose lines that remain, in page order. Copies of a page in a host, equal in all lines, count as one page
at the place of the first, so that none is differenced with itself, and get the same text.

A class or id name tells that an element is not part of an article only as a whole, or if all words it is made of do
(`cookie-notice`, `site-footer`, but not `no-sidebar`), and not if the element is or contains an article or main
element. Names that may or may not tell so, as of bylines, shares, related links and widgets, drop nothing: their lines
are loose inside an article too, so that differencing judges them.

Other lines of an article element are not differenced: copies of an article on one host, and passages that its articles
share, would be deleted with the template.

The order is a range partitioning, so a host with very many pages is spread over tasks; the one pair that
crosses each partition boundary is joined from a table of the partitions' first and last rows.

Null or empty html gives an empty text. Null urls form a host of their own. Rows that repeat a page_id or url are
extracted each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.differences import common_lines

from .common import batches, stored, table
from .url_filter import split_url

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")

# Elements by kind, after the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
NOT_TEXT = frozenset("head script style noscript iframe template svg math object canvas audio video nav header footer aside form button select textarea menu dialog search".split())
ARTICLE = frozenset("article main".split())
REPEATED = frozenset("li dt dd tr td th option".split())
# Words of class and id names, and roles, of what is not part of an article.
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted promotion reply replies respond sidebar sponsor sponsored".split()
)
# Words of names whose lines are differenced wherever they stand.
JUDGED_WORDS = frozenset("breadcrumb breadcrumbs byline pagination paywall related share sharing social subscribe toolbar widget".split())
# Words that, beside one of those in a class or id name, leave its meaning as it is.
NEUTRAL_WORDS = frozenset("area bar block bottom box button buttons container group inner item items left link links list main outer page panel post posts right section site slot text top unit wrap wrapper".split())
NOT_TEXT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: NAMED: dropped by its class or id name, if no article or main element is in it. JUDGED: loose by its name.
DROPPED, INSIDE, LOOSE, NAMED, JUDGED = 0, 1, 2, 3, 4


def _names(value: str, meant: frozenset[str]) -> bool:
    """Whether one of the class or id names is made of the meant words and neutral ones."""
    for name in value.split():
        words = set(_WORD.findall(name))
        if not meant.isdisjoint(words) and words <= meant | NEUTRAL_WORDS:
            return True
    return False


def _kind(tag: str, attributes: str) -> int | None:
    """What an element makes of its text, or None if it changes nothing."""
    if tag in NOT_TEXT:
        return DROPPED
    named, judged, main = False, False, tag == "main"
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in NOT_TEXT_ROLES):
                return DROPPED
            named |= name in ("class", "id") and _names(value, NOT_TEXT_WORDS)
            judged |= name in ("class", "id") and _names(value, JUDGED_WORDS)
            main |= name == "role" and value == "main"
            if name == "role" and value == "article":
                tag = "article"
    if main:
        return INSIDE
    return NAMED if named else INSIDE if tag in ARTICLE else JUDGED if judged else None


def text_lines(page: str | None) -> list[tuple[int, str]]:
    """(kind, line) of each block with text, in page order; lines in what is no article are left out."""
    out: list[tuple[int, str, tuple]] = []
    if not page:
        return []
    stack: list[tuple[str, int | None]] = []
    count = [0, 0, 0, 0, 0]
    judged = [0]  # open JUDGED elements in each open article, innermost last
    named: list[list[bool]] = []  # of each open NAMED element, whether it is dropped
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := " ".join("".join(line).split()):
                out.append((INSIDE if count[INSIDE] and not judged[-1] else LOOSE, text, tuple(named)))
            line.clear()

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            _, kind = stack.pop()
            if kind is not None:
                flush()
                count[kind] -= 1
                if kind == NAMED:
                    named.pop()
                elif kind == INSIDE:
                    judged.pop()
                elif kind == JUDGED:
                    judged[-1] -= 1

    at = 0
    raw: str | None = None
    while True:
        m = _TOKEN.search(page, at) if raw is None else re.compile(rf"</({raw})\b[^>]*(?:>|\Z)", re.I).search(page, at)
        end = m.start() if m else len(page)
        if raw is None and end > at and not count[DROPPED]:
            line.append(html.unescape(page[at:end]))
        if not m:
            if raw is not None or end >= len(page):
                break
        at = m.end()
        if raw is not None:
            raw = None
            pop_to(len(stack) - 1)
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            line.append(" ")
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or (tag in REPEATED and stack[depth][0] == tag):
                    pop_to(depth)
                    break
                if stack[depth][0] in BLOCK and stack[depth][0] not in REPEATED:
                    break
        kind = _kind(tag, m[3])
        if m[3].endswith("/") and tag not in RAW:
            continue
        if kind is not None:
            flush()
            count[kind] += 1
            if kind == NAMED:
                named.append([True])
            elif kind == JUDGED:
                judged[-1] += 1
            elif kind == INSIDE:
                judged.append(0)
                if not count[DROPPED]:
                    for dropped in named:
                        dropped[0] = False
        stack.append((tag, kind))
        if tag in RAW:
            raw = tag
    flush()
    return [(kind, text) for kind, text, within in out if not any(dropped[0] for dropped in within)]


PARSED = "page_id long, url string, host string, path string, digest binary, lines array<string>, loose array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """Per page: host, path, digest of all lines, its lines in page order, and the places of the loose ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4 << 20):
            host, path, digest, texts, loose = [], [], [], [], []
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, p = split_url(url)
                lines = text_lines(page)
                host.append(h)
                path.append(p)
                digest.append(hashlib.sha256("\n".join(f"{kind}{x}" for kind, x in lines).encode(errors="surrogatepass")).digest())
                texts.append([x for _, x in lines])
                loose.append([i for i, (kind, _) in enumerate(lines) if kind == LOOSE])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(host), pa.array(path), pa.array(digest, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(loose, pa.list_(pa.int32()))], [c.split()[0] for c in PARSED.split(", ")])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, PARSED)


def with_neighbours(lines: DataFrame) -> DataFrame:
    """lines(host, path, page_id, row, own) with `before` and `after`, the own lines of the pages next to each row in its host."""
    laid = stored(lines.repartitionByRange("host", "path", "page_id", "row").sortWithinPartitions("host", "path", "page_id", "row").withColumn("part", F.spark_partition_id()), "laid")
    order = Window.partitionBy("part").orderBy("host", "path", "page_id", "row")
    me = F.struct("host", "own")
    near = laid.withColumn("before", F.lag(me).over(order)).withColumn("after", F.lead(me).over(order))
    # Only the ends of a partition, two rows, have a neighbour elsewhere. Their keys are put in order; the lines are fetched by a join.
    key = F.struct("host", "path", "page_id", "row")
    edge = laid.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    across = Window.orderBy("part")  # one row for each partition, without lines
    edge = edge.select("part", F.lag("last.row").over(across).alias("row_before"), F.lead("first.row").over(across).alias("row_after"))
    lines_of = lambda name: edge.select("part", F.col(f"row_{name}").alias("row")).join(laid.select("row", me.alias(f"{name}_part")), "row").drop("row")
    inner = near.filter("before is not null and after is not null")
    ends = near.filter("before is null or after is null").join(lines_of("before"), "part", "left").join(lines_of("after"), "part", "left")
    ends = ends.select(*[F.coalesce(c, f"{c}_part").alias(c) if c in ("before", "after") else c for c in near.columns])
    met = inner.unionByName(ends)
    return met.withColumns({c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(f"{c}.own")) for c in ("before", "after")})


def _shared_places(paired: DataFrame) -> DataFrame:
    """(host, digest, gone): the places, among its loose lines, of those that a page shares with one next to it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            gone = [sorted(common_lines(own, before or []) | common_lines(own, after or [])) for own, before, after in rows]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32()))], ["host", "digest", "gone"])

    return paired.select("host", "digest", "own", "before", "after").mapInArrow(run, "host string, digest binary, gone array<int>")


def _without(found: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages with their lines, without the loose ones at the places `gone`."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            text = []
            for lines, loose, gone in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                left_out = {loose[i] for i in gone}
                text.append("\n\n".join(x for i, x in enumerate(lines) if i not in left_out))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return found.select("page_id", "url", "lines", "loose", "gone").mapInArrow(run, "page_id long, url string, text string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    all_pages = stored(parsed(pages).withColumn("row", F.monotonically_increasing_id()), "pages")
    plain = all_pages.filter("size(loose) = 0").select("page_id", "url", F.array_join("lines", "\n\n").alias("text"))
    mixed = all_pages.filter("size(loose) > 0")
    own = mixed.select("host", "path", "page_id", "row", "digest", F.transform("loose", lambda i: F.get("lines", i)).alias("own"))
    first = own.groupBy("host", "digest").agg(F.min(F.struct("path", "page_id", "row")).alias("at"), F.any_value("own").alias("own"))
    gone = _shared_places(with_neighbours(first.select("host", "at.*", "digest", "own")))
    text = plain.unionByName(_without(mixed.join(gone, ["host", "digest"])))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
