"""Main text of web pages: markup rules, and differencing against the page with the nearest URL of the same host."""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Element names and class words of the HTML conventions that the rules rely on.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "aside", "form", "button", "select", "option", "fieldset", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map", "head"}
#: Dropped unless they stand inside the article.
FRAME = {"header", "footer"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
    "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag of the first kind closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MARKED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|sidebar|side-bar|ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promoted|"
    r"cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|comment|comments|disqus|respond|reply|replies|"
    r"footer|masthead|skip-link|widget|toolbar|pagination|pager|copyright|legal)(?:$|[\s_-])",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?(?:</\1\s*[^>]*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


#: What the markup says of a line: it stands in a part that is no main text, in no such part, in the main part of the
#: page, or in an article.
BESIDE, OPEN, CENTRE, ARTICLE = range(4)


MAIN = {"main": CENTRE, "article": ARTICLE}


def protected(found: list[tuple[str, int]]) -> int:
    """The kind of the lines that are the text by the markup alone: those of articles, else of the main part, if there are any."""
    return max((kind for _, kind in found if kind >= CENTRE), default=ARTICLE)


def blocks(page: str) -> list[tuple[str, int]]:
    """The lines of a page in order, with what the markup says of each: BESIDE, OPEN, CENTRE or ARTICLE.

    A line is the text of a block. White space in it is one space; empty lines, comments and raw elements (scripts,
    styles) are left out. Unclosed and misnested tags are tolerated.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # (element, dropped, kind of its lines)
    dropped, inside = False, OPEN

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((line, BESIDE if dropped else inside))
            text.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:  # comment, declaration or raw element
            if m[1] is not None:
                text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m[2]:  # end tag: closes up to its start tag, if that is open
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, OPEN)
                    break
        elif name not in VOID:
            for closed in CLOSES.get(name, ()):
                if stack and stack[-1][0] == closed:
                    stack.pop()
            before = (stack[-1][1], stack[-1][2]) if stack else (False, OPEN)
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[4])} if m[4].strip() else {}
            label = f"{attrs.get('class', '')} {attrs.get('id', '')}"
            bad = (
                name in DROPPED
                or (name in FRAME and before[1] == OPEN)
                or "hidden" in attrs
                or attrs.get("aria-hidden") == "true"
                or attrs.get("role", "").lower() in ROLES
                or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
                or (name not in ("html", "body") and name not in MAIN and bool(MARKED.search(label)))
                or (name in MAIN and bool(re.search(r"\b(?:comment|related|ad|teaser)", label, re.I)))
            )
            dropped, inside = before[0] or bad, max(before[1], 0 if bad else MAIN.get(name, 0))
            if not m[5]:
                stack.append((name, dropped, inside))
            else:
                dropped, inside = before
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def main_lines(found: list[tuple[str, int]], gone: set[int], compared: bool = False) -> list[str]:
    """The lines that are main text; `gone` are positions among the lines that stand in neither article nor main part.

    A page that was compared keeps the lines of articles and of the main part, and the open lines that no neighbour
    shares. If there was no page to compare with, the markup alone decides: the article's lines (or the main part's),
    or all open lines of a page without such parts.
    """
    sure = protected(found)
    if not compared and any(kind == sure for _, kind in found):
        return [t for t, kind in found if kind == sure]
    text, at = [], 0
    for t, kind in found:
        if kind >= CENTRE:
            text.append(t)
            continue
        if kind == OPEN and at not in gone:
            text.append(t)
        at += 1
    return text


def shared(mine: list[int], other: list[int]) -> set[int]:
    """Positions of `mine` in a longest common subsequence with `other`; of several the one that keeps early lines."""
    lo = 0
    while lo < min(len(mine), len(other)) and mine[lo] == other[lo]:
        lo += 1
    hi = 0
    while hi < min(len(mine), len(other)) - lo and mine[-1 - hi] == other[-1 - hi]:
        hi += 1
    out = set(range(lo)) | set(range(len(mine) - hi, len(mine)))
    a, b = mine[lo : len(mine) - hi], other[lo : len(other) - hi]
    common = set(a) & set(b)  # a line that only one page has is in no subsequence
    at = [i for i, x in enumerate(a) if x in common]
    a, b = [a[i] for i in at], [x for x in b if x in common]
    if a and b:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            row, below = table[i], table[i + 1]
            for j in range(len(b) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(lo + at[i])
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
    return out


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row: the main text of the page.

    A null or empty page gives an empty text. Rows with equal key each get their own result; a null key or URL is
    an ordinary value (rows without URL have no host and are not paired). An empty table gives no rows.

    Every page is compared with the page with the nearest URL: pages of a host are ordered by path, a page is paired
    with the neighbour whose path has the longer common beginning (the earlier one of equals), their lines are aligned
    by the longest common subsequence, and shared lines are deleted; lines that only this page has are kept, inside
    the article or not. A neighbour with the same text is a copy and is passed over, adverts, menus and the like set aside. Shared lines
    alone do not tell a paragraph that two articles quote from a notice, so the lines of articles and of the main part
    are not compared but kept whole; and unshared lines alone do not tell a menu of one page's own from text, so
    markup rules drop menus, headers, footers, sidebars, notices, adverts, forms and reader comments. A page that has
    no neighbour on its host but copies is left to the markup: its article, else its main part, else its open lines.

    Only line hashes travel to the neighbours. Ordering is by range over host, path and key, so a hot host is many
    ranges; pages at the border of two ranges meet their neighbour through a table of the ranges' ends.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("h", F.xxhash64("html", "url"))
    place = F.lower(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""))
    host, path = F.regexp_replace(F.substring_index(F.substring_index(F.substring_index(place, "/", 1), "?", 1), "#", 1), r":\d+$", ""), F.expr("substring(place, length(substring_index(place, '/', 1)) + 1)")

    def lines(batches):
        for b in batches:
            got, whole = [], []
            for p in b.column("html").to_pylist():
                found = blocks(p or "")
                text = [t for t, kind in found if kind != BESIDE]
                whole.append(_hash("\n".join(text)) if text else None)
                got.append([_hash(t) for t, kind in found if kind < CENTRE])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "h", "host", "path")), pa.array(whole, pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["id", "h", "host", "path", "whole", "lines"])

    kind = kinds[key]
    loose = rows.withColumn("place", place).withColumn("host", host).withColumn("path", path).select("id", "h", "host", "path", "html")
    loose = loose.mapInArrow(lines, f"id {kind}, h long, host string, path string, whole long, lines array<long>").where("host is not null and host <> '' and whole is not null")
    order = ["host", "path", "id", "h"]
    ranged = materialize(loose.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "lines")
    near = F.struct("host", "path", "whole", "lines")
    inside = Window.partitionBy("part").orderBy(*order)
    ends = ranged.groupBy("part").agg(F.min_by(near, F.struct(*order)).alias("low"), F.max_by(near, F.struct(*order)).alias("high"))
    across = Window.orderBy("part")  # a row for each range
    ends = ends.select("part", F.lag("high").over(across).alias("left_end"), F.lead("low").over(across).alias("right_end"))
    met = ranged.withColumn("before", F.lag(near).over(inside)).withColumn("after", F.lead(near).over(inside)).join(ends, "part")
    met = met.select("id", "h", "host", "path", "whole", "lines", F.coalesce("before", "left_end").alias("before"), F.coalesce("after", "right_end").alias("after"))

    def differ(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                best = None
                for other in (r["before"], r["after"]):
                    if other and other["host"] == r["host"] and other["whole"] != r["whole"]:
                        n = _common(other["path"] or "", r["path"] or "")
                        if best is None or n > best[0]:
                            best = (n, other["lines"])
                out.append(sorted(shared(r["lines"], best[1])) if best else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(out, pa.list_(pa.int32()))], ["id", "h", "gone"])

    gone = met.mapInArrow(differ, f"id {kind}, h long, gone array<int>").where("gone is not null")
    # null keys are values here, so they are joined by a null-safe condition on a key made of both
    tag = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull(), "h")
    gone = gone.select(tag.alias("tag"), "gone").groupBy("tag").agg(F.first("gone").alias("gone"))
    joined = rows.select("id", "url", "html", tag.alias("tag")).join(gone, "tag", "left").select("id", "url", "html", "gone")

    def extract(batches):
        for b in batches:
            texts = []
            for p, g in zip(b.column("html"), b.column("gone").to_pylist()):
                texts.append(" ".join(main_lines(blocks(p.as_py() or ""), set(g or ()), g is not None)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"id {kind}, url {kinds[url]}, text string, n_chars long").withColumnRenamed("id", key).withColumnRenamed("url", url)


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n
