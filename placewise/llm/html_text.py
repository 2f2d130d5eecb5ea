"""Main text of web pages: nearest-URL page differencing over structural blocks.

1. Every page is cut into text lines (blocks of the page, white space normalised). A line's place is read from the
   markup: inside navigation, header, footer, sidebar, notice, advert, form, comment or hidden elements; inside an article;
   inside a main element; inside a container named as content; or open.
2. Pages of a host are sorted by URL path and each is paired with the neighbour that shares more leading path
   segments (the one before on a tie). Neighbours that are copies (``COPY`` of the characters outside boilerplate
   elements are shared, on either page) form a run, and a page is paired with the nearest page before or after its run.
   Sorting is by range over (host, path), so a hot host is spread; the ends of the ranges are matched through tables of
   one row per range.
3. The lines of a pair are aligned by longest common subsequence on their hashes, and shared lines are deleted -
   except lines inside an article or main element, prose (``PROSE_WORDS`` words and a full stop), and shorter sentences between
   lines that are not shared: passages that many articles quote are shared too and are article text. Two copies delete nothing from each other. Lines of boilerplate
   elements are deleted, shared or not, as are copyright lines and lines of nothing but links where no content element is marked.
4. What is left of the best place (article, then main, then named container, then open lines) is the text. Lines of a main
   element stay beside those of articles in the page unless they are shared. A named container with ``TEASER`` times the text of
   the articles beside it is the best place. A form that holds the whole page is a plain container.

A class or id name marks boilerplate as a whole (``sidebar``, ``post-comments``, ``cookie-notice``), not by one word in it
(``has-sidebar``, ``share-price``), and never for html, body, main and article. Articles inside an element that only its name
rejects are taken if the page has no other article, main element or named container.

Defined results: a null or empty page, or one without text, gives the empty text; a null URL, or a host with one page,
has no partner, and only the markup decides; repeated rows (same id, URL and html) share a partner and stay repeated;
null ids are carried along; ties of the path are ordered by hash; very long pages cost their length (closing tags without an open
element are found by counts); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from placewise.session import stage

from .common import map_batches, small_batches

# Kinds of elements.
BOILERPLATE_TAGS = frozenset(
    "nav header footer aside form script style noscript template svg iframe button select option textarea menu dialog head "
    "object embed canvas audio video map".split()
)
RAW_TAGS = frozenset("script style textarea title noscript iframe template".split())
#: Elements without a box of their own: they do not end a line.
UNSEEN_TAGS = frozenset("script style noscript template".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class or id names that mark boilerplate, and words that may stand beside them in such a name.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies cta "
    "disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "topbar widget".split()
)
NEUTRAL_NAMES = frozenset(
    "area bar block blocks body bottom box btn button buttons col column container content div footer form global group header holder icons "
    "inner item items left link links list main message outer page panel post posts primary right secondary section site slot "
    "stories text title top unit wrap wrapper".split()
)
#: Names of elements that hold articles other than the page's own.
OTHERS_NAMES = frozenset("comment comments commentlist disqus promo promoted promotion related respond sponsor sponsored".split())
NEVER_BY_NAME = frozenset("html body main article".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
CONTENT_NAMES = frozenset(
    "article article-body article-content articlebody body-text content entry entry-content main main-content maincontent post "
    "post-body post-content story story-body text".split()
)

BOILERPLATE, ARTICLE, MAIN, NAMED, OPEN, BY_NAME = range(6)
#: Form parts that stay boilerplate where a form holds the whole page.
FORM_PARTS = frozenset("label legend".split())
#: Share of the characters outside boilerplate elements from which on a shared page is a copy.
COPY = 0.9
#: Words from which on a line that ends like a sentence is prose, which two pages may quote.
PROSE_WORDS = 12
#: A named container with so many times the characters of the articles beside it holds the page's article.
TEASER = 2

_TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_FORM = re.compile(r"<form\b", re.IGNORECASE)
_CONTENT_ELEMENT = re.compile(r"""<(?:article|main)\b|role\s*=\s*["']?main\b""", re.IGNORECASE)
_NOTICE = re.compile(r"(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|\d{4}))", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


def _attributes(rest: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")) if value else "" for name, value in _ATTRIBUTE.findall(rest)}


def _boilerplate_name(name: str, inside: bool) -> bool:
    """Whether a class or id name is that of boilerplate as a whole. Headers inside an article are part of it."""
    parts = [p for p in _NAME_PARTS.split(name) if p and not p.isdigit()]
    marks = [p in BOILERPLATE_NAMES or (p == "header" and not inside) for p in parts]
    return any(marks) and all(m or p in NEUTRAL_NAMES for m, p in zip(marks, parts, strict=True))


def _element_kind(tag: str, rest: str, kind: int, reopen: bool = False) -> int:
    """The kind of the lines in this element, given the kind around it; with ``reopen``, elements that their name rejects have the
    kind BY_NAME, in which articles and main elements count."""
    if kind == BOILERPLATE:
        return kind
    given = _attributes(rest) if rest.strip(" /") else {}
    names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    inside = kind in (ARTICLE, MAIN)
    if tag == "form" and reopen:
        return kind
    if (tag in BOILERPLATE_TAGS or (reopen and tag in FORM_PARTS)) and not (tag == "header" and inside):
        return BOILERPLATE
    if hidden or role in BOILERPLATE_ROLES:
        return BOILERPLATE
    rejected = [] if tag in NEVER_BY_NAME or role == "main" else [n for n in names if _boilerplate_name(n, inside)]
    if rejected:
        others = any(p in OTHERS_NAMES for n in rejected for p in _NAME_PARTS.split(n))
        return BY_NAME if reopen and not inside and not others else BOILERPLATE
    if tag == "article":
        return ARTICLE
    if kind == ARTICLE:
        return kind
    if tag == "main" or role == "main":
        return MAIN
    if kind == OPEN and any(n in CONTENT_NAMES for n in names):
        return NAMED
    return kind


def page_lines(html: str) -> list[tuple[str, int]]:
    """(text, kind) of every line of the page in order; script and style content is no line.

    A page whose text all lies in boilerplate elements, or whose articles do, is read again with forms as plain containers and
    with articles counting inside elements that only their name rejects.
    """
    lines = _lines(html, False)
    kinds = {k for _, k in lines}
    if not kinds & {ARTICLE, MAIN, NAMED} and (_CONTENT_ELEMENT.search(html) or (OPEN not in kinds and _FORM.search(html))):
        found = [(t, BOILERPLATE if k == BY_NAME else k) for t, k in _lines(html, True)]
        now = {k for _, k in found}
        if now & {ARTICLE, MAIN} or (OPEN not in kinds and now & {NAMED, OPEN}):
            return found
    return lines


def _lines(html: str, reopen: bool) -> list[tuple[str, int]]:
    """Lines with their kinds. Outside of content elements, copyright lines are boilerplate, and lines of nothing but links that are
    neither heading nor prose."""
    lines: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements with the kind around them
    opened: Counter = Counter()  # and how many there are of each
    kind, at, plain = OPEN, 0, False

    def flush() -> None:
        nonlocal plain
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                counts = kind != OPEN or ((plain or is_prose(text)) and not _NOTICE.match(text))
                lines.append((text, kind if counts else BOILERPLATE))
        plain = False

    def data(text: str) -> None:
        nonlocal plain
        buffer.append(unescape(text) if "&" in text else text)
        plain = plain or (not text.isspace() and (not opened["a"] or any(opened[h] for h in HEADINGS)))

    for match in iter(lambda: _TAG.search(html, at), None):
        if match.start() > at:
            data(html[at : match.start()])
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        tag = name.lower()
        if match["close"]:
            # A closing tag without an open element is found by the count, not by a walk.
            open_at = next(i for i in reversed(range(len(stack))) if stack[i][0] == tag) if opened[tag] else None
            if open_at is not None and stack[open_at][1] != kind or tag not in INLINE_TAGS:
                flush()
            if open_at is not None:
                kind = stack[open_at][1]
                opened.subtract(t for t, _ in stack[open_at:])
                del stack[open_at:]
            continue
        below = _element_kind(tag, match["rest"], kind, reopen)
        if tag not in UNSEEN_TAGS and (below != kind or tag not in INLINE_TAGS):
            flush()
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag not in VOID_TAGS and not match["rest"].rstrip().endswith("/"):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                kind = stack.pop()[1]
                opened[tag] -= 1
                below = _element_kind(tag, match["rest"], kind, reopen)
            stack.append((tag, kind))
            opened[tag] += 1
            kind = below
    if at < len(html):
        data(html[at:])
    flush()
    return lines


def is_sentence(text: str) -> bool:
    return text.rstrip("\"'»”’)")[-1:] in (".", "!", "?", "…")


def is_prose(text: str) -> bool:
    """Whether a line reads like the text of an article: long, and with a full stop or the like at its end."""
    return text.count(" ") + 1 >= PROSE_WORDS and is_sentence(text)


def _template(lines: list[tuple[str, int]], shared: set[int]) -> set[int]:
    """Shared lines that are of the pages' template and no passage that both quote.

    Prose stays. A shorter sentence goes at the top or the bottom of a page, where nothing but template lines is above or below it;
    inside the page, between lines of its own, it is a quotation. Lines that are no sentence go wherever they are.
    """
    short = {i for i in shared if not is_prose(lines[i][0])}
    gone = {i for i in short if not is_sentence(lines[i][0])}
    for order in (range(len(lines)), reversed(range(len(lines)))):
        for i in order:
            if lines[i][1] != BOILERPLATE and i not in short:
                break
            if i in short:
                gone.add(i)
    return gone


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """The lines of the best place, joined by one space.

    Shared lines of the template go, but for those inside article and main elements. Lines of a main
    element outside its articles are of the best place too, unless shared. Articles are teasers where a named container holds
    ``TEASER`` times their text; then the container is the best place.
    """
    gone = _template(lines, shared)
    kept = [(i, t, k) for i, (t, k) in enumerate(lines) if k in (ARTICLE, MAIN) or (k != BOILERPLATE and i not in gone)]
    size = [0] * 6
    for _, t, k in kept:
        size[k] += len(t)
    best = min((k for _, _, k in kept), default=OPEN)
    if size[NAMED] >= TEASER * (size[ARTICLE] + size[MAIN]) > 0:
        best = NAMED
    return " ".join(t for i, t, k in kept if k == best or (k == MAIN and best == ARTICLE and i not in shared))


# -- alignment -----------------------------------------------------------------


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit rows of the longest common subsequence: after j symbols of ``b``, the zero bits below i count the longest
    common subsequence of ``a[:i]`` and ``b[:j]``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row, rows = full, [full]
    for x in b:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    return rows


def common_subsequence(a: list[int], b: list[int], most_bits: int = 1 << 29) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Symbols of one side only are left out first, common ends are matched at once. Larger problems than ``most_bits``
    are halved (Hirschberg), so memory stays bounded.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    x, y = [a[i] for i in at], [v for v in b if v in both]
    found: list[int] = []

    def solve(a0: int, a1: int, b0: int, b1: int) -> None:
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            found.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            found.append(a1 - 1)
            a1, b1 = a1 - 1, b1 - 1
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            return
        if n * m > most_bits and m > 1:
            half = b0 + m // 2
            ahead = _last_row(x[a0:a1], y[b0:half])
            back = _last_row(x[a0:a1][::-1], y[half:b1][::-1])
            cut = max(range(n + 1), key=lambda i: ahead[i] + back[n - i])
            solve(a0, a0 + cut, b0, half)
            solve(a0 + cut, a1, half, b1)
            return
        rows, i = _rows(x[a0:a1], y[b0:b1]), n - 1
        for j in range(m, 0, -1):
            # Walk back: a zero bit at i that the row before lacks is where symbol j was matched.
            while i >= 0 and rows[j] >> i & 1:
                i -= 1
            if i < 0:
                return
            if rows[j - 1] >> i & 1:
                found.append(a0 + i)
                i -= 1

    solve(0, len(x), 0, len(y))
    return sorted(at[i] for i in found)


def _last_row(a: list[int], b: list[int]) -> list[int]:
    places: dict[int, int] = {}
    for i, v in enumerate(a):
        places[v] = places.get(v, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for v in b:
        met = row & places.get(v, 0)
        row = ((row + met) | (row - met)) & full
    out, digits = [0], format(row, f"0{len(a)}b")[::-1]
    for d in digits:
        out.append(out[-1] + (d == "0"))
    return out


# -- pairs ---------------------------------------------------------------------

_KEY = ["k1", "k2"]


def is_copy(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> bool:
    """Whether one of two pages, given by the hashes of their lines and their characters that count, is nearly all in the other."""

    def most(x: list[int], sizes: list[int], y: list[int], other: list[int]) -> bool:
        there = {h for h, n in zip(y, other, strict=True) if n}
        return sum(n for h, n in zip(x, sizes, strict=True) if h in there) >= COPY * sum(sizes)

    return most(a, a_sizes, b, b_sizes) or most(b, b_sizes, a, a_sizes)


def _line_hashes(keyed: DataFrame) -> DataFrame:
    """(k1, k2, host, path, hashes, sizes): one small row per page. Lines of boilerplate elements have the size 0."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = [page_lines(h) for h in batch.column("html").to_pylist()]
        hashes = pa.array([[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in p] for p in pages], pa.list_(pa.int64()))
        sizes = pa.array([[len(t) if k != BOILERPLATE else 0 for t, k in p] for p in pages], pa.list_(pa.int32()))
        kept = ("k1", "k2", "host", "path")
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), hashes, sizes], [*kept, "hashes", "sizes"])

    rows = keyed.select(
        "k1",
        "k2",
        F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        "html",
    )
    return map_batches(rows, digest, "k1 long, k2 long, host string, path string, hashes array<long>, sizes array<int>")


def _shared_segments(a: Column, b: Column) -> Column:
    """Leading path segments that are equal."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same))


def _run_starts(sliced: DataFrame, order: WindowSpec, met: DataFrame) -> DataFrame:
    """The rows of ``sliced`` without their lines, with ``start``: whether the page before, in order, is no copy of it."""
    lines = F.struct("host", "hashes", "sizes")
    ends = sliced.groupBy("slice").agg(F.max_by(lines, F.struct("host", "path", *_KEY)).alias("end"))
    before = met.select("slice", F.col("previous").alias("at")).join(ends.select(F.col("slice").alias("at"), "end"), "at").drop("at")
    rows = sliced.withColumn("prior", F.lag(lines).over(order)).join(before, "slice", "left")
    prior = F.coalesce("prior", "end")
    names = ["k1", "k2", "host", "path", "slice"]

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column(c).to_pylist() for c in ("hashes", "sizes", "others", "other_sizes"))
        start = [y is None or not is_copy(x, n, y, m) for x, n, y, m in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(start, pa.bool_())], [*names, "start"])

    pairs = rows.withColumn("prior", F.when(prior["host"] == F.col("host"), prior)).select(
        *names, "hashes", "sizes", F.col("prior.hashes").alias("others"), F.col("prior.sizes").alias("other_sizes")
    )
    return stage(map_batches(pairs, compare, "k1 long, k2 long, host string, path string, slice int, start boolean"), "runs")


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2): each page's neighbour by path within its host, beyond the run of copies it stands in; within the run if the
    host has no other page. Pages without one are left out. Without the columns ``hashes`` and ``sizes`` no page is a copy."""
    place = ["host", "path", *_KEY]
    lines = [c for c in ("hashes", "sizes") if c in pages.columns]
    sliced = stage(
        pages.where(F.coalesce(F.col("host"), F.lit("")) != "").select(*place, *lines).dropDuplicates(place).repartitionByRange(*place).withColumn(
            "slice", F.spark_partition_id()
        ),
        "slices",
    )
    own = F.struct(*place)
    order = Window.partitionBy("slice").orderBy(*place)
    along = Window.orderBy("first")  # one row per range of the sort: as many as partitions
    ends = sliced.groupBy("slice").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    met = ends.select(
        "slice", "first", F.lag("slice").over(along).alias("previous"), F.lag("last").over(along).alias("before_slice"), F.lead("first").over(along).alias("after_slice")
    )
    runs = _run_starts(sliced, order, met) if lines else sliced.withColumn("start", F.lit(True))
    around = (
        runs.withColumns({"before": F.lag(own).over(order), "after": F.lead(own).over(order)})
        .join(met, "slice")
        .withColumns({"before": F.coalesce("before", "before_slice"), "after": F.coalesce("after", "after_slice")})
    )
    # The page before the start of the own run, and the start of the next run; a run may go on over several slices.
    back = Window.partitionBy("slice").orderBy(*[F.col(c).desc() for c in place])
    edge = F.when(F.col("start"), F.struct(F.col("before").alias("page")))
    seen = around.withColumns({
        "outer_before": F.last(edge, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "outer_after": F.last(F.when(F.col("start"), own), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
    })
    states = seen.groupBy("slice", "first").agg(
        F.max_by("outer_before", own).alias("ending"), F.min(F.when(F.col("start"), own)).alias("opening")
    )
    carried = states.select(
        "slice",
        F.last("ending", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("ending"),
        F.last("opening", ignorenulls=True).over(Window.orderBy(F.col("first").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("opening"),
    )
    outer = seen.join(carried, "slice").withColumns(
        {"outer_before": F.coalesce("outer_before", "ending")["page"], "outer_after": F.coalesce("outer_after", "opening")}
    )

    def near(side: str) -> Column:
        return F.when(F.col(f"{side}.host") == F.col("host"), _shared_segments(F.col("path"), F.col(f"{side}.path"))).otherwise(F.lit(-1))

    def nearer(before: str, after: str) -> Column:
        found = F.when(near(after) > near(before), F.col(after)).otherwise(F.col(before))
        return F.when((near(before) >= 0) | (near(after) >= 0), found)

    partner = F.coalesce(nearer("outer_before", "outer_after"), nearer("before", "after"))
    return outer.select(*_KEY, partner.alias("partner")).where("partner is not null").select(
        *_KEY, F.col("partner.k1").alias("p1"), F.col("partner.k2").alias("p2")
    )


def shared_lines(pages: DataFrame) -> DataFrame:
    """(k1, k2, shared, copy): positions of the lines that a page has in common with its partner, in order, and whether the two are
    copies."""
    lines = stage(_line_hashes(pages).dropDuplicates(_KEY), "lines")
    pairs = nearest_pages(lines)
    other = lines.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("hashes").alias("others"), F.col("sizes").alias("other_sizes"))
    names = ["hashes", "sizes", "others", "other_sizes"]
    both = pairs.join(other, ["p1", "p2"]).join(lines.select(*_KEY, "hashes", "sizes"), _KEY).select(*_KEY, *names)

    def align(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        found = pa.array([common_subsequence(a, b) for a, _, b, _ in rows], pa.list_(pa.int32()))
        copy = pa.array([is_copy(*row) for row in rows], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), found, copy], ["k1", "k2", "shared", "copy"])

    return map_batches(both, align, "k1 long, k2 long, shared array<int>, copy boolean")


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every page."""
    small_batches(pages.sparkSession)
    named = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    # Two hashes over the whole row are its key: rows that share it are repeated rows.
    keyed = named.withColumns({"k1": F.xxhash64("page_id", "url", "html"), "k2": F.xxhash64("html", F.lit("2"), "url", "page_id")})
    found = stage(shared_lines(keyed), "shared")
    # The lines move once, packed, by hash, at any size; only the small side is held in memory.
    rows = map_batches(keyed, _pack, "k1 long, k2 long, page_id long, url string, kinds binary, lines binary")
    rows = rows.join(found.hint("shuffle_hash"), _KEY, "left").select("page_id", "url", "kinds", "lines", "shared", "copy")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared = batch.column("shared").to_pylist()
        columns = (batch.column(c).to_pylist() for c in ("kinds", "lines", "copy"))
        texts = [
            main_text(_unpack(kinds, lines), set() if copy else set(s or ()))
            for kinds, lines, copy, s in zip(*columns, shared, strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(s or ()) for s in shared], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars", "n_shared"],
        )

    return map_batches(rows, extract, "page_id long, url string, text string, n_chars long, n_shared long")


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The lines of pages, compressed: a line holds no line feed, so they are joined by it."""
    squeeze = zstandard.ZstdCompressor().compress
    pages = [page_lines(h) for h in batch.column("html").to_pylist()]
    kinds = pa.array([bytes(k for _, k in p) for p in pages], pa.binary())
    lines = pa.array([squeeze("\n".join(t for t, _ in p).encode("utf-8", "replace")) for p in pages], pa.binary())
    kept = ("k1", "k2", "page_id", "url")
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), kinds, lines], [*kept, "kinds", "lines"])


def _unpack(kinds: bytes, lines: bytes) -> list[tuple[str, int]]:
    texts = zstandard.ZstdDecompressor().decompress(lines).decode().split("\n") if kinds else []
    return list(zip(texts, kinds, strict=True))
