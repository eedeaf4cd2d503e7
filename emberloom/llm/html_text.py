"""Main text of web pages by structure and nearest-URL page differencing.

A page is scanned once into text lines (one per block), each marked: noise (in
a menu, footer, advert ...), suspect (in an element whose class only hints at
noise, such as ``related-posts`` or ``search-box``), free, or the same two
inside an article. Pages are dealt to ranges of (host, path, id) and sorted
there, so that the pages with the nearest URLs of the same host are neighbours
in the stream; the first and last pages of neighbouring ranges meet in a second
small exchange, so that the answer does not depend on how the ranges are cut.
A page's lines are aligned with each neighbour's by their longest common
subsequence, and the alignment decides:

* on a page without an article, lines shared with the nearest page that is not
  a copy go; if nothing would be left, they stay;
* suspect lines, within articles too, go if either neighbour has them, and stay
  otherwise.

Other lines of an article stay: articles share passages and short paragraphs,
and a site may serve one article under two URLs.

End tags that HTML lets a page leave out (of head, p, list items, table parts
and options) are supplied where the element ends. Class, role and id count only
as whole names or by a plain first part (``ad-slot``, ``comment-list``); they
never judge a heading, and a compound id judges nothing.

Defined results: null and empty html gives empty text; a null or odd URL is of
the host "" or compares by its whole text; repeated pages are answered each, and
are copies of each other; pages of equal URL stand in the order of id, then of
their text; a page of any length is scanned in linear time and aligned in time
by lines times lines over the machine's big-integer width; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE, FREE, MAIN, SUSPECT, SUSPECT_MAIN = range(5)
#: Bytes of html in one range of URLs, about, and most ranges.
RANGE_BYTES = 8_000_000
RANGES = 50_000
#: Keys drawn for each range, to set the ranges' ends, and the longest URL that sets one.
KEYS_PER_RANGE = 8
KEY_CHARS = 500

#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style template textarea title iframe object select option button noscript svg canvas audio video datalist head".split())
#: Elements that hold what is not the article.
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Elements that hold the article.
MAIN_TAGS = frozenset("article main".split())
#: Names of class, role or id that mark noise.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe share sharing social related "
    "comment comments commentlist disqus reply replies toolbar pagination contentinfo complementary search alert".split()
)
#: First parts of compound class names that mark noise too.
NOISE_PARTS = frozenset("ad ads advert advertisement sponsor sponsored menu nav navbar breadcrumb breadcrumbs sidebar cookie comment comments newsletter share pagination".split())
#: Elements that names never judge.
UNJUDGED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)

#: Elements that may stand in a head; any other one ends it.
HEAD_TAGS = frozenset("head html title meta link base basefont bgsound noframes script style template noscript".split())
_PARTS = frozenset("thead tbody tfoot".split())
_ROWS = _PARTS | {"tr"}
#: Elements whose end tag may be left out, with the elements whose start ends them.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dd": frozenset(["dd", "dt"]),
    "dt": frozenset(["dd", "dt"]),
    "td": _ROWS | {"td", "th"},
    "th": _ROWS | {"td", "th"},
    "tr": _ROWS,
    "thead": _PARTS,
    "tbody": _PARTS,
    "tfoot": _PARTS,
    "caption": _ROWS | {"colgroup"},
    "option": frozenset(["option", "optgroup"]),
    "optgroup": frozenset(["optgroup"]),
}
_ENDERS = frozenset(t for by in ENDED_BY.values() for t in by)
_CELLS = _ROWS | {"td", "th", "caption", "colgroup"}


def _within(name: str) -> frozenset[str]:
    """Elements over whose bounds a tag of an element with optional end does not reach."""
    if name in _CELLS:
        return frozenset(["table", "template"])
    if name in ("option", "optgroup"):
        return frozenset(["select", "datalist", "template"])
    return (BLOCKS | {"td", "th", "button", "object", "select", "template"}) - {"address", "div", "p"}


_BOUNDS = {t: _within(t) for t in frozenset(ENDED_BY) | _ENDERS}
#: Elements that an inline element's end tag does not close.
_HOLDERS = BLOCKS | {"td", "th", "body"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What may stand in a tag, without going back over it.
_ATTRIBUTES = re.compile(r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}


def _judged(attrs: str) -> int | None:
    """NOISE or SUSPECT if an element's names say so."""
    found = None
    for m in _ATTRIBUTE.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        for name in [value.strip()] if m[1].lower() == "id" else value.split():
            if name in NOISE_NAMES:
                return NOISE
            if m[1].lower() != "id":
                parts = re.split("[-_]+", name)
                if parts[0] in NOISE_PARTS:
                    return NOISE
                if not NOISE_NAMES.isdisjoint(parts):
                    found = SUSPECT
    return found


def _role(name: str, attrs: str, inside_main: bool) -> int | None:
    """What an element makes of its content, if it makes a difference."""
    if name in SKIPPED or name in NOISE_TAGS or (name == "header" and not inside_main):
        return NOISE
    judged = _judged(attrs) if attrs and name not in UNJUDGED else None
    return judged if judged is not None else MAIN if name in MAIN_TAGS else None


def _tags(page: str):
    """(text before, closing, name, attributes) of each tag, and at the end (text, None, "", ""); jumps are sent back.

    A quote that is never closed makes all later tags end at their first ">".
    """
    at = text_from = 0
    plain = False
    last = page.rfind(">")
    while True:
        begin = page.find("<", at)
        if begin >= 0 and page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            yield page[text_from:begin], None, "", ""
            at = text_from = end + 3 if end >= 0 else len(page)
            continue
        if begin < 0 or begin > last:
            yield page[text_from:], None, "", ""
            return
        if page[begin + 1 : begin + 2] in ("!", "?"):
            yield page[text_from:begin], None, "", ""
            at = text_from = page.find(">", begin) + 1
            continue
        m = _TAG.match(page, begin)
        if m is None:
            at = begin + 1
            continue
        end = -1 if plain else _ATTRIBUTES.match(page, m.end()).end()
        if not 0 <= end < len(page) or page[end] != ">":
            plain = True
            end = page.find(">", m.end())
        jump = yield page[text_from:begin], m[1] == "/", m[2].lower(), page[m.end() : end]
        at = text_from = end + 1
        if jump:
            closed = jump.search(page, at)
            at = text_from = closed.end() if closed else len(page)
            yield "", None, "", ""


def lines(page: str | None) -> list[tuple[str, int]]:
    """The page's text lines in order, each with its mark."""
    out: list[tuple[str, int]] = []
    now: list[str] = []
    open_: list[tuple[str, int | None]] = []  # name, mark
    count: dict[str, int] = defaultdict(int)  # of the names in open_
    marks = [0] * 5  # of the marks in open_
    mark = FREE

    def end_line():
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            if text:
                out.append((text, mark))
            now.clear()

    def end_from(k: int):
        """End open_[k] and all in it."""
        nonlocal mark
        gone = open_[k:]
        changes = any(m is not None for _, m in gone)
        if changes:
            end_line()
        del open_[k:]
        for name, _ in gone:
            count[name] -= 1
        for _, m in gone:
            if m is not None:
                marks[m] -= 1
        mark = NOISE if marks[NOISE] else (SUSPECT_MAIN if marks[MAIN] else SUSPECT) if marks[SUSPECT] else MAIN if marks[MAIN] else FREE

    def end_before(name: str):
        """End what the start of an element ends."""
        if name not in _ENDERS or not any(count[t] for t in ENDED_BY if name in ENDED_BY[t]):
            return
        cut = None
        for k in range(len(open_) - 1, -1, -1):
            other = open_[k][0]
            if name in ENDED_BY.get(other, ()):
                cut = k
                if name not in _CELLS:
                    break
            elif other in _BOUNDS[name]:
                break
        if cut is not None:
            end_from(cut)

    def end_paragraph():
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == "p":
                end_from(k)
            if open_[k:] == [] or open_[k][0] in _HOLDERS or open_[k][0] in SKIPPED:
                return

    tags = _tags(page or "")
    jump = None
    while True:
        try:
            before, closing, name, attrs = tags.send(jump)
        except StopIteration:
            break
        jump = None
        if before:
            if open_ and open_[-1][0] == "head" and not before.isspace():  # text ends a head
                end_from(len(open_) - 1)
            now.append(before)
        if closing is None:
            continue
        if name == "br":
            now.append(" ")
        if name in BLOCKS:
            end_line()
            if count["p"]:  # a paragraph ends where a block begins or ends
                end_paragraph()
        if closing:
            if not count[name] or name == "p":
                continue
            bounds = _BOUNDS.get(name, ()) if name in ENDED_BY else () if name in _HOLDERS or name in SKIPPED else _HOLDERS
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    end_from(k)
                    break
                if open_[k][0] in bounds:
                    break
            continue
        if open_ and open_[-1][0] == "head" and name not in HEAD_TAGS:
            end_from(len(open_) - 1)
        end_before(name)
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        if name in _RAW_END:
            jump = _RAW_END[name]
            continue
        role = _role(name, attrs, marks[MAIN] > 0)
        if role is not None:
            end_line()
            marks[role] += 1
            mark = NOISE if marks[NOISE] else (SUSPECT_MAIN if marks[MAIN] else SUSPECT) if marks[SUSPECT] else MAIN if marks[MAIN] else FREE
        open_.append((name, role))
        count[name] += 1
    end_line()
    return out


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence with b.

    A bit for each line of b tells where the length grows; a row of bits
    follows from the one before by a few operations on whole integers. Of
    the rows only every k-th is kept, and what lies between is made again
    when the way back passes there, so memory grows with the square root of a.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    end_a, end_b = len(a), len(b)
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    n, m = end_a - lo, end_b - lo
    where: dict[str, int] = defaultdict(int)
    for j in range(m):
        where[b[lo + j]] |= 1 << j
    lines_a = [where.get(x, 0) for x in a[lo:end_a]]
    every = max(1, int(n**0.5))
    full = (1 << m) - 1

    def rows(row: int, begin: int, end: int) -> list[int]:
        """The bits after lines begin to end, given those before: 0 where the length grows."""
        out = []
        for hits in lines_a[begin:end]:
            used = row & hits
            row = (row + used | row - used) & full
            out.append(row)
        return out

    kept = [full]
    for begin in range(0, n, every):
        kept.append((rows(kept[-1], begin, begin + every) or [kept[-1]])[-1])
    middle = []
    i, j = n, m
    while i and j:
        begin = (i - 1) // every * every
        part = [kept[begin // every], *rows(kept[begin // every], begin, i)]
        while i > begin and j:
            if part[i - begin] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if part[i - begin] >> (j - 1) & 1:
                j -= 1
                middle.append(lo + i)
    return [*range(lo), *reversed(middle), *range(end_a, len(a))]


def main_text(own: list[tuple[str, int]], *neighbours: list[tuple[str, int]] | None) -> str:
    """A page's text given its lines and those of its neighbours, the one with the nearest URL first."""
    own = [x for x in own if x[1] != NOISE]
    texts = [t for t, _ in own]
    other = [[t for t, mark in x if mark != NOISE] for x in neighbours if x]
    shared = [set(common_lines(texts, x)) for x in other if x != texts]  # copies tell nothing
    either = set().union(*shared)
    article = [k for k, (_, mark) in enumerate(own) if mark in (MAIN, SUSPECT_MAIN)]
    if article:
        return "\n".join(texts[k] for k in article if own[k][1] == MAIN or k not in either)
    sure = [k for k in range(len(own)) if own[k][1] == FREE or k not in either]
    kept = [k for k in sure if not shared or k not in shared[0]]
    return "\n".join(texts[k] for k in kept or sure)


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path with query, without scheme and fragment."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "").split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def _same_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


_LINE = pa.struct([("text", pa.string()), ("mark", pa.int8())])
_LINES_DDL = "array<struct<text:string,mark:tinyint>>"
_PARSED = {"range": pa.int32(), "host": pa.string(), "path": pa.string(), "page_id": pa.int64(), "tie": pa.int64(), "url": pa.string(), "lines": pa.list_(_LINE)}
_PARSED_DDL = f"range int, host string, path string, page_id bigint, tie bigint, url string, lines {_LINES_DDL}"
_PAGE_DDL = f"struct<host:string,path:string,page_id:bigint,url:string,lines:{_LINES_DDL}>"
_ANSWER = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}
_ANSWER_DDL = "page_id bigint, url string, text string, n_chars bigint"
_FIRST_ID = -(2**63)


def _key(url: str | None, page_id: int | None) -> tuple:
    return (*url_key(url), _FIRST_ID if page_id is None else page_id)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _stream(batches):
    """(range, page) in order; a page is (host, path, id, url, lines)."""
    for batch in batches:
        ranges, hosts, paths, ids, urls = (batch.column(c).to_pylist() for c in ("range", "host", "path", "page_id", "url"))
        for k, x in enumerate(batch.column("lines")):
            yield ranges[k], (hosts[k], paths[k], ids[k], urls[k], [(y["text"], y["mark"]) for y in x.as_py() or []])


def _settle(before, now, after) -> tuple:
    near = [x for x in (before, after) if x is not None and x[0] == now[0]]
    near.sort(key=lambda x: -_same_start(x[1], now[1]))  # of equally near ones the one before
    text = main_text(now[4], *[x[4] for x in near])
    return now[2], now[3], text, len(text)


def _ends(rows: DataFrame, ranges: int) -> list[tuple]:
    """Ends of the ranges, from a hash sample of keys whose size depends on their number alone.

    Each range holds KEYS_PER_RANGE of the drawn pages at least, so none is short of two pages.
    """
    wanted = ranges * KEYS_PER_RANGE
    n = max(1, rows.count())
    drawn = rows.where((F.length(F.coalesce("url", F.lit(""))) <= KEY_CHARS) & (F.pmod(F.xxhash64("url", "page_id", F.lit(5)), F.lit(n)) < wanted))
    keys = sorted({_key(r["url"], r["page_id"]) for r in drawn.select("url", "page_id").distinct().collect()})
    step = max(KEYS_PER_RANGE, -(-len(keys) // ranges))
    return keys[step : len(keys) - KEYS_PER_RANGE + 1 : step]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page row."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RANGES, -(-size // RANGE_BYTES)))
    ends = spark.sparkContext.broadcast(_ends(rows, ranges))
    last = len(ends.value)

    def parse(batches):
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for page_id, url, x in zip(ids, urls, batch.column(2), strict=True):
                key, page = _key(url, page_id), x.as_py() or ""
                own = [{"text": t, "mark": k} for t, k in lines(page) if k != NOISE]
                out.append((bisect_right(ends.value, key), key[0], key[1], page_id, zlib.crc32(page.encode("utf-8", "replace")), url, own))
            yield _batch(out, _PARSED)

    dealt = rows.mapInArrow(parse, _PARSED_DDL).repartitionById(last + 1, "range").sortWithinPartitions("range", "host", "path", "page_id", "tie")

    def inner(batches):
        """Answers of all pages but a range's first and last, whose other neighbours stand elsewhere."""
        before = now = None
        of, out = None, []
        for r, page in chain(_stream(batches), [(None, None)]):
            if now is not None and (before is not None or of == 0) and (r == of or of == last):
                out.append(_settle(before, now, page if r == of else None))
                if len(out) >= 500:
                    yield _batch(out, _ANSWER)
                    out = []
            before, now, of = (now if r == of else None), page, r
        yield _batch(out, _ANSWER)

    def edges(batches):
        """(seam, side, pages) of a range's first two and last two pages; seam k is between ranges k and k + 1."""
        held: list = []
        of, n, out = None, 0, []

        def seam(k: int, side: int, pages: list) -> tuple:
            return k, side, [dict(zip(("host", "path", "page_id", "url", "lines"), (*p[:4], [{"text": t, "mark": m} for t, m in p[4]]))) for p in pages]

        for r, page in chain(_stream(batches), [(None, None)]):
            if r != of and of is not None and of < last:
                out.append(seam(of, 0, held))
            if r != of:
                held, of, n = [], r, 0
            if page is not None:
                held = [*held[-1:], page]
                n += 1
                if n == 2 and r:
                    out.append(seam(r - 1, 1, held))
        yield _batch(out, {"seam": pa.int32(), "side": pa.int8(), "pages": pa.list_(pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.list_(_LINE))]))})

    def join(batches):
        for batch in batches:
            out = []
            for x in batch.column("pages").to_pylist():
                (q, p), (a, b) = ([(g["host"], g["path"], g["page_id"], g["url"], [(y["text"], y["mark"]) for y in g["lines"]]) for g in x[side]] for side in ("low", "high"))
                out += [_settle(q, p, a), _settle(p, a, b)]
            yield _batch(out, _ANSWER)

    made = dealt.mapInArrow(inner, _ANSWER_DDL)
    if last:
        sides = dealt.mapInArrow(edges, f"seam int, side tinyint, pages array<{_PAGE_DDL}>").groupBy("seam")
        met = sides.agg(F.struct(F.max(F.when(F.col("side") == 0, F.col("pages"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("pages"))).alias("high")).alias("pages"))
        made = made.unionByName(met.select("pages").mapInArrow(join, _ANSWER_DDL))
    return made.withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
