"""Operator 10: HTML extraction by nearest-URL page differencing.

Each page is parsed once into text lines (blocks). Lines inside navigation, header, footer, aside, form and the like,
or in a block whose class, id or role names such a thing, belong to the frame.

Every page is differenced: it is paired with the pages of the nearest other paths of its host, before and after it in
path order, whatever tasks and batches they are in. Spark places one page of each path in that order, with hashes of
its lines. The longest common subsequence of two line lists shows the template. A pair that shares most of a page's
text is a copy and shows nothing.

A check by the markup follows, as menus, adverts and footers may have other words on each page, and articles of one
host repeat sentences; the README has figures. Where an article or main element names the content, its lines are the
text, shared or not, unless all of them are template and open lines are left that are not: then these are the text.
Without such an element the text is what is left of the open lines. A class of a wrapper around an article judges the
wrapper's own lines; an article in a framed block counts only on pages that have no other.

Defined cases: null or empty html has an empty text; a page without a pair is judged by its markup alone, so are
pages with a null url; of pages of one path the one with the least page_id and html stands for it; unclosed elements
end with the page or the element around them; repeated rows each give a row; an empty table gives an empty table;
extra columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, table

# Elements of which no text is shown, elements around a page's frame, and elements that don't end a line.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "video", "audio", "canvas")
FRAME = ("nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "head")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = ("article", "main")
# Words of class, id and role that name parts of the frame, and those that may also name content inside an article.
NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus feedback footer gdpr legal "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted recommended related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
VAGUE = frozenset("feedback legal menu overlay pager privacy search skip social widget widgets toolbar notification banner disclaimer copyright header".split())
#: Where a tag begins, what its attributes are made of, and one attribute with its value.
TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)", re.I)
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"[\s/]*+(?P<name>[^\s/>=\"']++|[\"'=])(?:\s*+=\s*+(?:\"(?P<a>[^\"]*+)\"?|'(?P<b>[^']*+)'?|(?P<c>[^\s>\"']*+)))?")
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Parts of compound class names behind which a name says what a block has or lacks, not what it is.
MODIFIERS = frozenset("with without no not has have hide show is".split())
# What stands behind a word of NAMES in a compound that names a part of the frame.
THINGS = frozenset(
    "area articles bar block body bottom box button buttons card col column container content count entries form group icon icons inner item items left link links list main message news outer "
    "pages panel policy posts products reading right root row section slot stories thread title tools top topics unit videos wrap wrapper".split()
)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
#: Cells of the table of a longest common subsequence that are held at once; larger ones are halved.
CELLS = 1 << 22


def _word(part: str) -> list[str]:
    """A part of a class name, cut where a word of NAMES and one of THINGS are written together."""
    for i in range(2, len(part) - 1):
        if part[i:] in THINGS and part[:i] in NAMES:
            return [part[:i], part[i:]]
    return [part]


def names_frame(token: str, content: int) -> bool:
    """Whether a token of class, id or role names a part of the frame: a word of NAMES, alone or in a compound where it stands last, or before another such word, a number or a word of THINGS. What a block only has or lacks doesn't count."""
    token = token.strip()
    if token.lower() in NAMES or token.lower() == "header":
        return not (content and token.lower() in VAGUE)
    parts = [x for w in WORDS.findall(token) for x in _word(w.lower())]
    if len(parts) < 2:
        return False
    known = NAMES - VAGUE if content else NAMES
    for i, x in enumerate(parts):
        if x in known and not (i and parts[i - 1] in MODIFIERS):
            behind = parts[i + 1] if i + 1 < len(parts) else ""
            if not behind or behind in NAMES or behind in THINGS or behind.isdigit():
                return True
    return False


def _framed(tag: str, attrs: str, content: int) -> tuple[bool, bool]:
    """Does this element hold a part of the frame, and does its tag say so? Attributes are read by name from the tag's start, and the first of a name counts."""
    if tag in FRAME or (tag == "header" and not content):
        return True, True
    if tag in ("html", "body") or tag in CONTENT or not attrs.strip("/ "):
        return False, False
    seen: set[str] = set()
    named = False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
        if name in seen:
            continue
        seen.add(name)
        if name in ("class", "id", "role"):
            named = named or any(names_frame(x, content) for x in entities.unescape(value).split())
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and HIDING.search(value)):
            return True, True
    return named, False


def tokens(page: str):
    """(text before it, tag, whether it ends an element, attributes, elements without shown text) of each piece of markup, and the text that is left, in time linear in the page.

    A tag ends at the first > outside of quotes. If a page ends before, its quotes are broken: this tag and those that
    follow end at their first >. What looks like a tag but has no > behind it is text."""
    at = i = 0
    last, broken = page.rfind(">"), False
    while 0 <= (i := page.find("<", i)) < last:
        m, tag, end, attrs = TAG.match(page, i), "", False, ""
        if page.startswith("<!--", i):
            stop = page.find("-->", i + 2)
            stop = len(page) if stop < 0 else stop + 3
        elif m:
            whole = None if broken else ATTRIBUTES.match(page, m.end())
            broken = broken or not whole
            stop = whole.end() if whole else page.find(">", m.end()) + 1
            tag, end, attrs = m["tag"].lower(), bool(m["end"]), page[m.end() : stop - 1]
        elif page[i + 1] in "!?/":
            stop = page.find(">", i) + 1
        else:
            i += 1
            continue
        raw = tag in RAW and not end
        if raw and not (tag == "svg" and attrs.endswith("/")):
            closing = RAW_END[tag].search(page, stop)
            stop = page.find(">", closing.end()) + 1 if closing else 0
            stop = stop or len(page)
        yield page[at:i], tag, end, attrs, raw
        at = i = stop
    yield page[at:], "", False, "", False


#: Kinds of lines: of the frame, open, content, and content within a block that a class names as frame.
FRAMED, OPEN, CONTENT_LINE, WRAPPED = range(4)


def lines(page: str) -> list[tuple[str, int]]:
    """(line, its kind) for each block with text, in page order."""
    out: list[tuple[str, int]] = []
    piece: list[str] = []
    # tag, framed, framed by its tag, content, and what was framed around a content element
    stack: list[tuple[str, bool, bool, bool, int]] = []
    open_tags: Counter = Counter()
    framed = hard = content = around = 0

    def flush() -> None:
        if piece:
            line = " ".join(entities.unescape("".join(piece)).split())
            if line:
                kind = FRAMED if hard or framed > around else OPEN if not content else WRAPPED if around else CONTENT_LINE
                out.append((line, kind))
            piece.clear()

    def pop() -> None:
        nonlocal framed, hard, content, around
        tag, a, b, c, outer = stack.pop()
        open_tags[tag] -= 1
        framed -= a
        hard -= b
        content -= c
        if c:
            around = outer

    for text, tag, end, attrs, raw in tokens(page):
        if text:
            piece.append(text)
        if raw:
            if tag in ("title", "iframe", "video", "audio", "canvas", "object"):
                flush()
            continue
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if end:
            # an end tag closes the elements left open inside its own; one that was never opened is ignored
            if open_tags[tag]:
                edge = tag not in ("p", "li", "b", "i", "span", "a", "em", "strong")
                while stack and stack[-1][0] != tag and (edge or stack[-1][0] in INLINE):
                    if any(stack[-1][1:4]):
                        flush()
                    pop()
                if stack and stack[-1][0] == tag:
                    if any(stack[-1][1:4]):
                        flush()
                    pop()
        elif tag not in VOID and not attrs.endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                pop()
            (inside, by_tag), of = _framed(tag, attrs, content), tag in CONTENT
            if inside or of:
                flush()
            stack.append((tag, inside, by_tag, of, around))
            open_tags[tag] += 1
            framed += inside
            hard += by_tag
            # the outermost content element isn't judged by the classes around it
            if of and not content:
                around = framed
            content += of
    flush()
    return out


def _rows(a: list, b: list):
    """The bit rows of the table of longest common subsequences: bit i of a row is 0 where the length grows with a[i]."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        if y in where:  # others leave the row as it is
            u = row & where[y]
            row = ((row + u) | (row - u)) & every
        yield row


def _lengths(a: list, b: list) -> list[int]:
    """Lengths of longest common subsequences of b with each beginning of a."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for c in reversed(bin(row | 1 << len(a))[3:]):
        out.append(out[-1] + (c == "0"))
    return out


def common(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b. A table of more than CELLS bits is halved, so memory is bounded."""
    known = set(a)
    b = [y for y in b if y in known]
    if not b:
        return set()
    if len(b) > 1 and len(a) * len(b) > CELLS:
        half = len(b) // 2
        head, tail = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])
        cut = max(range(len(a) + 1), key=lambda i: (head[i] + tail[len(a) - i], -i))
        return common(a[:cut], b[:half]) | {cut + i for i in common(a[cut:], b[half:])}
    rows = list(_rows(a, b))
    found, i, j = set(), len(a), len(rows)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not (j and not rows[j - 1] >> (i - 1) & 1):
                i -= 1
                found.add(i)
    return found


def kind_of(kinds: list[int]) -> int:
    """The kind of the lines that are the text: of content where the markup names it, in framed wrappers only if there is no other, else open ones."""
    return next((k for k in (CONTENT_LINE, WRAPPED) if k in kinds), OPEN)


def content_of(page: list[tuple[str, int]]) -> str | None:
    """The text where the markup names it."""
    kind = kind_of([k for _, k in page])
    return None if kind == OPEN else " ".join(x for x, k in page if k == kind)


def template(kind: int, kinds: list[int], sizes: list[int], hashes: list[int], pairs: list[list[int]]) -> set[int]:
    """The places of the lines that a page shares with those of its pairs that aren't copies."""
    inside = [i for i, k in enumerate(kinds) if k in (kind, OPEN)]
    whole, shared = sum(sizes[i] for i in inside), set()
    for other in pairs:
        found = common(hashes, other)
        if 2 * sum(sizes[i] for i in inside if i in found) <= whole:
            shared |= found
    return shared


def left_open(kind: int, kinds: list[int], sizes: list[int], hashes: list[int], pairs: list[list[int]]) -> list[int] | None:
    """The places of the open lines that differencing leaves, if these are the text: where the markup names no content, or names template alone. None where all lines of the kind stay."""
    shared = template(kind, kinds, sizes, hashes, pairs)
    left = [i for i, k in enumerate(kinds) if k == OPEN and i not in shared]
    alone = all(i in shared for i, k in enumerate(kinds) if k == kind)
    return left if kind == OPEN or (left and alone) else None


def differenced(texts: list[str], kinds: list[int], hashes: list[int], pairs: list[list[int]]) -> str:
    """The text of a page beside the line hashes of its pairs."""
    kind = kind_of(kinds)
    left = left_open(kind, kinds, [len(x) for x in texts], hashes, pairs)
    return " ".join(x for i, (x, k) in enumerate(zip(texts, kinds)) if (k == kind if left is None else i in left))


def _parsed(batches):
    import pyarrow as pa

    for batch in batches:
        pages = [lines(x.as_py() or "") for x in batch.column("html")]
        kinds = [[k for _, k in page] for page in pages]
        out = ([[x for x, _ in page] for page in pages], kinds, [kind_of(x) for x in kinds])
        types = (pa.list_(pa.string()), pa.list_(pa.int8()), pa.int8())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "path")), *(pa.array(c, t) for c, t in zip(out, types))], ["page_id", "url", "host", "path", "lines", "kinds", "kind"])


def _differenced(batches):
    import pyarrow as pa

    for batch in batches:
        out: list[list] = [[], []]
        columns = (batch.column(c).to_pylist() for c in ("id", "kind", "kinds", "sizes", "hashes", "before", "after"))
        for id, kind, kinds, sizes, hashes, before, after in zip(*columns):
            left = left_open(kind, kinds, sizes, hashes, [x for x in (before, after) if x])
            # where all open lines are left, there is nothing to tell
            if left is not None and (kind != OPEN or len(left) < kinds.count(OPEN)):
                out[0].append(id)
                out[1].append(left)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32()))], ["id", "left"])


def neighbours(reps: DataFrame) -> DataFrame:
    """reps(host, path, hashes), one row a path -> host, path, before, after: the hashes of the nearest paths of the host.

    Paths are dealt by range, so a host of any size spreads over many tasks; what lies beyond a task's range is its neighbours' first or last row, one of each a task."""
    dealt = Written(reps.repartitionByRange("host", "path").select("*", F.spark_partition_id().alias("part")), "page-paths").df
    order = Window.partitionBy("part").orderBy("host", "path")
    row = F.struct("host", "hashes")
    placed = dealt.select("*", F.lag(row).over(order).alias("lo"), F.lead(row).over(order).alias("hi"))
    edges = dealt.groupBy("part").agg(F.min(F.struct("host", "path", "hashes")).alias("first"), F.max(F.struct("host", "path", "hashes")).alias("last"))
    by_part = Window.orderBy("part")  # as many rows as tasks
    edges = edges.select("part", F.lag("last").over(by_part).alias("prev"), F.lead("first").over(by_part).alias("next"))
    met = placed.join(F.broadcast(edges), "part", "left")
    one = lambda x, y: F.when(F.coalesce(F.col(f"{x}.host"), F.col(f"{y}.host")) == F.col("host"), F.coalesce(F.col(f"{x}.hashes"), F.col(f"{y}.hashes")))
    return met.select("host", "path", one("lo", "prev").alias("before"), one("hi", "next").alias("after"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    bare = F.regexp_replace(F.lower("url"), r"^[a-z][a-z0-9+.-]*://|[?#].*$", "")
    keyed = pages.select("page_id", "url", "html", F.regexp_extract(bare, "^[^/]*", 0).alias("host"), F.regexp_replace(bare, r"^[^/]*|(\.html?)?/?$", "").alias("path"))
    parsed = keyed.mapInArrow(_parsed, "page_id long, url string, host string, path string, lines array<string>, kinds array<tinyint>, kind tinyint")
    # of all lines hashes are kept, and the words of those that may be text
    shown = F.zip_with("lines", "kinds", lambda x, k: F.when((k == F.col("kind")) | (k == OPEN), x).otherwise(""))
    held = parsed.select(F.monotonically_increasing_id().alias("id"), "page_id", "url", "host", "path", "kind", "kinds", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), shown.alias("lines"))
    all_pages = Written(held, "pages", "zstd").df
    known = all_pages.where("host IS NOT NULL")
    reps = known.groupBy("host", "path").agg(F.min(F.struct("page_id", "hashes")).alias("x")).select("host", "path", "x.hashes")
    # pages are differenced by hashes, and only the places of what is left are joined to their words
    small = known.select("id", "host", "path", "kind", "kinds", F.transform("lines", F.length).alias("sizes"), "hashes")
    paired = small.join(neighbours(reps), ["host", "path"]).drop("host", "path")
    left = Written(paired.mapInArrow(_differenced, "id long, left array<int>"), "page-left").df
    of_kind = F.filter(F.arrays_zip("lines", "kinds"), lambda x: x["kinds"] == F.col("kind"))
    text = F.when(F.col("left").isNull(), F.array_join(F.transform(of_kind, lambda x: x["lines"]), " ")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), " "))
    return all_pages.join(left, "id", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE: dict[str, str] = {}
