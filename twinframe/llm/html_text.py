"""Main-text extraction by nearest-URL page differencing (operator 4).

Each page is parsed once into text lines, one for each block, with the elements around it. Within
a host, pages are put in order of their URL path; a page is compared with its nearest neighbours in
that order, whose lines are aligned with its own by longest common subsequence. Shared lines are
what the site prints around its articles, and are deleted.

Differencing alone would also delete what two articles really share (copies of an article, a quoted
passage) and keep what varies from page to page around them (menus and adverts of each page). So two
rules bound it: lines in elements that are never an article's text go as well where no neighbour
shares them, and a line that is prose (a paragraph, heading, quotation or cell) inside the article's
own element goes only if every neighbour that may vote shares it, four at least. A neighbour that
shares half of the page's text or more is a copy and no witness: it has no vote on prose, and for
other lines, which the nearest witness decides, the next one is asked.

What a class, id or role says about an element counts if the whole word is known for page frames, or
all parts between hyphens are known or say nothing (``cookie-banner-wrapper``, but not ``ad-free``).
It counts for nothing on body elements, and on an article's element only if it says that this is a reader's comment.

A form is no main text, unless an article's element begins in it or nothing else on the page can be main
text: some sites put one form around the whole page.

Neighbours are found without a window over a host: light rows (line hashes only) are put in order
by a range exchange, numbered, and cut into blocks of consecutive rows with the neighbours on
either side, so a host of any size is many tasks. Only pages that lose lines to differencing that
structure had left are joined back.

Edge cases. A null html is empty; an empty text results. A null URL is a host of its own, whose
pages are ordered like others. Unclosed, crossing and cut-off tags are accepted. Rows that repeat
id, URL and html get the same result. Extra columns are ignored; an empty table gives none. Aligning
takes time in proportion to the equal pairs of lines where they are few, else to the product of the
numbers of lines over the bits of a machine word, whatever lines repeat.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.sources.shared import materialize

#: A comment or declaration, or a tag; quotes in a tag count only where a value begins.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)?+)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""")

# Element names and words in class, id and role attributes.
RAW = frozenset("script style noscript template iframe canvas audio video noembed noframes textarea title".split())
NESTED = frozenset("template noscript canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math object q rp rt ruby s samp small span strike strong sub sup svg time tt u var".split())
WHOLE = frozenset("html body main".split())
NEVER = frozenset("nav aside footer head button select option label fieldset menu dialog datalist input map".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption caption address".split())
ARTICLE_WORDS = frozenset("article-body articlebody post-content entry-content post-body story-body main-content article-content story article post entry content".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
NEUTRAL_WORDS = frozenset("area article articles author bar block body bottom box button buttons center column container content expanded form global group header icons inner item items label left link links list main media meta mobile outer page panel post posts primary right row secondary section site slot small text thread title top unit wide widget wrap wrapper".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
CLOSED_BY = {"li": {"li"}, "p": set(), "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


# What an open element is besides an element.
FRAME, COMMENT, FORM, ARTICLE, TEXT = 1, 2, 4, 8, 16
KINDS = (FRAME, COMMENT, FORM, ARTICLE, TEXT)


class Line:
    """A block's text: where it stands decides what differencing may do with it."""

    __slots__ = ("text", "outside", "form", "article", "prose")

    def __init__(self, text: str, outside: bool, form: bool, article: bool, prose: bool):
        self.text, self.outside, self.form, self.article, self.prose = text, outside, form, article, prose


class Open:
    """The open elements, outermost first. How many of a kind are open, and where the last one of a name is, is known without a search."""

    def __init__(self):
        self.names: list[str] = []
        self.kinds: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.places: dict[int, list[int]] = {k: [] for k in KINDS}
        self.marked: Counter = Counter()  # open elements of a name that are no main text

    def push(self, name: str, kind: int) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        for k in KINDS:
            if kind & k:
                self.places[k].append(len(self.names))
        self.marked[name] += kind & (FRAME | COMMENT | FORM) > 0
        self.names.append(name)
        self.kinds.append(kind)

    def cut(self, depth: int) -> None:
        """Close all elements from this depth on."""
        while len(self.names) > depth:
            name, kind = self.names.pop(), self.kinds.pop()
            self.at[name].pop()
            for k in KINDS:
                if kind & k:
                    self.places[k].pop()
            self.marked[name] -= kind & (FRAME | COMMENT | FORM) > 0

    def last(self, names) -> int:
        """The depth of the innermost of these elements, -1 if none is open."""
        return max((own[-1] for x in names if (own := self.at.get(x))), default=-1)

    def close(self, names, stop=()) -> None:
        """Close the innermost of these, and what is in it, unless one of ``stop`` is open in it."""
        depth = self.last(names)
        if depth >= 0 and depth > self.last(stop):
            self.cut(depth)

    def free_forms(self) -> None:
        """The open forms hold a page, not fields."""
        for depth in self.places[FORM]:
            self.kinds[depth] &= ~FORM
            self.marked[self.names[depth]] -= not self.kinds[depth] & (FRAME | COMMENT)
        self.places[FORM] = []

    def has(self, kind: int) -> bool:
        return bool(self.places[kind])

    def line(self, text: str) -> Line:
        return Line(text, self.has(FRAME) or self.has(COMMENT), self.has(FORM), self.has(ARTICLE), self.has(TEXT))


class Closings:
    """Whether elements that are open at a place of a page are closed later on; each name's tags are looked for once."""

    def __init__(self, page: str):
        self.page, self.of = page, {}

    def _tags(self, name: str) -> tuple[list[int], list[int], list[int]]:
        """Places of a name's tags, how many are open after each, and the least of that from each place on."""
        if name not in self.of:
            found = [(m.start(), -1 if m[1] else 1) for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", self.page, re.I)]
            after = list(accumulate((x for _, x in found), initial=0))
            least = list(accumulate(reversed(after), min))[::-1]
            self.of[name] = [x for x, _ in found], after, least
        return self.of[name]

    def all_closed(self, at: int, names: list[str]) -> bool:
        """Whether the rest of the page closes all these open elements."""
        for name, n in Counter(names).items():
            places, after, least = self._tags(name)
            k = bisect_left(places, at)
            if least[k] > after[k] - n:
                return False
        return True


def _named(attrs: str) -> tuple[bool, bool, bool, str]:
    """What class and id say: the page's frame, comments, the article; and the role."""
    frame = comments = article = False
    role = ""
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            role = value.strip()
        elif name in ("class", "id"):
            for word in value.split():
                parts = [x for x in re.split(r"[_-]+|\d+", word) if x]
                plain = all(x in OUTSIDE_WORDS or x in NEUTRAL_WORDS for x in parts)
                frame |= plain and (not OUTSIDE_WORDS.isdisjoint(parts) or "header" in parts)
                comments |= plain and not COMMENT_WORDS.isdisjoint(parts)
                article |= word in ARTICLE_WORDS
    return frame, comments, article, role


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the text after an element of raw text begins; some of them nest."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).finditer(page, at):
        if not m[1]:
            depth += name in NESTED and not m[0].rstrip(">").endswith("/")
        else:
            depth -= 1
            if not depth:
                return m.end()
    return len(page)


def lines(page: str) -> list[Line]:
    """A page's text lines in order, white space within a line as single spaces."""
    out: list[Line] = []
    stack, closings, text = Open(), Closings(page), []

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(stack.line(joined))
            text.clear()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(entities.unescape(page[at:]))
            break
        if lt > at:
            text.append(entities.unescape(page[at:lt]))
        m = TAG.match(page, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE:
                if stack.marked[name]:
                    flush()
                stack.close((name,), ("p", "div", "article", "section", "li", "td", "body"))
            elif stack.at.get(name):
                flush()
                stack.close((name,))
            elif name == "p":
                flush()
            continue
        attrs = m[3] or ""
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                at = _raw_end(page, name, at)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        frame, comments, body, role = _named(attrs) if attrs and name not in WHOLE else (False, False, False, "")
        kind = 0
        if name == "article":
            kind = COMMENT if comments and not body else FRAME if role in OUTSIDE_ROLES else 0
        elif comments:
            kind = COMMENT
        elif name in NEVER or role in OUTSIDE_ROLES or frame or name == "header" and not stack.has(ARTICLE):
            kind = FRAME
        elif name == "form":
            kind = FORM
        if not kind & (FRAME | COMMENT) and (name in ("article", "main") or role in ("article", "main") or name in ("div", "section") and body):
            kind |= ARTICLE
        if name in INLINE:
            if kind & (FRAME | COMMENT):
                flush()
            stack.push(name, kind & (FRAME | COMMENT))
            continue
        flush()
        if kind & ARTICLE:
            stack.free_forms()
        if kind & ARTICLE and name in ("article", "main") and not stack.has(COMMENT) and stack.has(FRAME):
            # An article begins: what of the page's frame was left open ends here, unless it is closed later on.
            if not closings.all_closed(at, [stack.names[k] for k in stack.places[FRAME]]):
                stack.cut(stack.places[FRAME][0])
        if name != "p" and name in CLOSED_BY:
            stack.close(CLOSED_BY[name], ("ul", "ol", "dl", "table", "menu", "select", "article", "div", "section", "nav"))
        else:
            stack.close(("p",), ("article", "main", "div", "section", "li", "td", "blockquote", "nav", "aside", "footer", "form"))
        stack.push(name, kind | (TEXT if name in PROSE else 0))
    flush()
    return out


def shared(own: list[int], other: list[int]) -> list[bool]:
    """Which of ``own`` are in a longest common subsequence with ``other``."""
    n, m, first, last = len(own), len(other), 0, 0
    while first < min(n, m) and own[first] == other[first]:
        first += 1
    while last < min(n, m) - first and own[n - 1 - last] == other[m - 1 - last]:
        last += 1
    out = [True] * first + [False] * (n - first - last) + [True] * last
    known = set(own[first : n - last])
    ys = [y for y in other[first : m - last] if y in known]
    known.intersection_update(ys)
    xs = [i for i in range(first, n - last) if own[i] in known]
    if xs:
        for k in _common([own[i] for i in xs], ys):
            out[xs[k]] = True
    return out


def _common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence: Hunt and Szymanski's where few pairs are equal, else Hirschberg's halves."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        times = Counter(b[k:m])
        if j - i == 1:
            out += [i] if times[a[i]] else []
        elif sum(times[x] for x in a[i:j]) <= 16 * (j - i + m - k):
            out += [i + x for x in _few_pairs(a[i:j], b[k:m])]
        else:
            mid = (i + j) // 2
            ahead, back = _lengths(a[i:mid], b[k:m]), _lengths(a[mid:j][::-1], b[k:m][::-1])[::-1]
            cut = k + int(np.argmax(ahead + back))
            todo += [(i, mid, k, cut), (mid, j, cut, m)]
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each beginning of ``b``, by bits (Hyyro's)."""
    where: dict[int, int] = {}
    for x in set(a):
        bits = np.packbits(np.fromiter((y == x for y in b), dtype=bool, count=len(b)), bitorder="little")
        where[x] = int.from_bytes(bits.tobytes(), "little")
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where[x]
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), count=len(b), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _few_pairs(own: list[int], other: list[int]) -> list[int]:
    where: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    nodes: list[tuple] = []
    for i, x in enumerate(own):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j), nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[0])
        node = node[1]
    return out


def candidates(found: list[Line]) -> list[Line]:
    """The lines that may be main text, before differencing: those in article elements if there are any, without the page's frame and forms."""
    free = [x for x in found if not x.outside]
    free = [x for x in free if not x.form] or free
    return [x for x in free if x.article] if any(x.article for x in free) else free


def line_hash(text: str) -> int:
    b = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) << 31 ^ zlib.adler32(b)


def witnessed(own: list[int], sizes: list[int], kept: list[bool], others: list[list[int]]) -> list[bool]:
    """Lines that a neighbour shares; a neighbour that shares half of the text that counts is a copy and is passed over."""
    all_size = sum(s for s, k in zip(sizes, kept, strict=True) if k)
    for other in others:
        same = shared(own, other)
        if 2 * sum(s for s, k, x in zip(sizes, kept, same, strict=True) if k and x) < max(1, all_size):
            return same
    return [False] * len(own)


def frame_prose(own: list[int], sizes: list[int], kinds: list[int], others: list[list[int]], least: int = 4) -> list[bool]:
    """Prose of the article that all neighbours share, ``least`` of them or more; copies have no vote.

    As no witness shares half of the page's main text, never all of it goes.
    """
    all_size, votes, witnesses = sum(s for s, k in zip(sizes, kinds, strict=True) if k), [0] * len(own), 0
    for other in others:
        same = shared(own, other)
        if 2 * sum(s for s, k, x in zip(sizes, kinds, same, strict=True) if k and x) < all_size:
            witnesses += 1
            votes = [v + x for v, x in zip(votes, same, strict=True)]
    return [k == 1 and v >= least and v == witnesses for v, k in zip(votes, kinds, strict=True)]


def _url_order(url) -> dict:
    """Host and path of a URL, in lower case, the path without query, fragment and ends."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_replace(path, r"(\.html?)?/*$", ""), F.lit(""))}


KEY = ["k1", "k2"]


def _row_key(id_col: str, url_col: str, html_col: str) -> dict:
    return {"k1": F.xxhash64(id_col, url_col, html_col), "k2": F.xxhash64(F.lit(9), html_col, url_col, id_col)}


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row's lines: their hashes, sizes, kinds (0 never main text, 1 main text unless all neighbours share it, 2 main text unless shared) and, unless 0, texts."""
    src = pages.select(
        F.col(id_col).alias("id_"), F.col(url_col).alias("url_"), F.col(html_col).alias("html_"),
        *(c.alias(k) for k, c in _row_key(id_col, url_col, html_col).items()), *(c.alias(k) for k, c in _url_order(F.col(url_col)).items()),
    )
    schema = T.StructType([f for f in src.schema.fields if f.name != "html_"])
    for name, kind in (("hashes", T.LongType()), ("sizes", T.IntegerType()), ("kinds", T.IntegerType()), ("texts", T.StringType())):
        schema.add(name, T.ArrayType(kind))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            hashes, sizes, kinds, texts = [], [], [], []
            for page in b.column("html_").to_pylist():
                found = lines(page or "")
                main = set(map(id, candidates(found)))
                kind = [0 if id(x) not in main else 1 if x.article and x.prose else 2 for x in found]
                hashes.append([line_hash(x.text) for x in found])
                sizes.append([len(x.text) for x in found])
                kinds.append(kind)
                texts.append([x.text if k else "" for x, k in zip(found, kind, strict=True)])
            cols = [pa.array(v, type=pa.list_(t)) for v, t in ((hashes, pa.int64()), (sizes, pa.int32()), (kinds, pa.int32()), (texts, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-4]), *cols], schema.names)

    return src.mapInArrow(run, schema)


def shared_lines(parsed: DataFrame, reach: int = 4, block: int = 512) -> DataFrame:
    """``(k1, k2, n_lines, n_shared, drop)`` of every page with lines: how many there are, how many of them differencing deletes, and the numbers of those that are main text by structure."""
    spark = parsed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = parsed.select(*KEY, "host", "path", "hashes", "sizes", "kinds")

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * b.num_rows, type=pa.int32()), pa.array(range(n, n + b.num_rows), type=pa.int64())], [*b.schema.names, "task", "nth"])
            n += b.num_rows

    ordered = light.repartitionByRange(parts, "host", "path", *KEY).sortWithinPartitions("host", "path", *KEY)
    ordered = materialize(ordered.mapInArrow(number, T.StructType(light.schema.fields + [T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())])), "page-order")
    begin, rows = 0, []
    for r in ordered.groupBy("task").agg(F.count("*").alias("n")).orderBy("task").collect():  # one row a task
        rows.append((r["task"], begin))
        begin += r["n"]
    starts = F.broadcast(spark.createDataFrame(rows, "task int, begin long"))
    placed = ordered.join(starts, "task").withColumn("g", F.col("begin") + F.col("nth"))
    mine = F.floor(F.col("g") / block)
    around = F.array_distinct(F.array(F.floor((F.col("g") - reach) / block), mine, F.floor((F.col("g") + reach) / block)))
    dealt = placed.select("g", (mine).alias("own"), "host", *KEY, "hashes", "sizes", "kinds", F.explode(around).alias("part")).filter("part >= 0")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "g")

    def compare(batches):
        import pyarrow as pa

        near: list[dict] = []
        out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_lines", pa.int32()), ("n_shared", pa.int32()), ("drop", pa.list_(pa.int32()))])

        def judge(i: int) -> tuple | None:
            x = near[i]
            if x["own"] != x["part"] or not x["kinds"]:
                return None
            order = [k for d in range(1, reach + 1) for k in (i - d, i + d)]
            others = [near[k]["hashes"] for k in order if 0 <= k < len(near) and near[k]["part"] == x["part"] and near[k]["host"] == x["host"] and abs(near[k]["g"] - x["g"]) <= reach]
            same = witnessed(x["hashes"], x["sizes"], [k > 0 for k in x["kinds"]], others)
            frame = frame_prose(x["hashes"], x["sizes"], x["kinds"], others) if 1 in x["kinds"] else same
            gone = [f if k == 1 else s for s, f, k in zip(same, frame, x["kinds"], strict=True)]
            return x["k1"], x["k2"], len(gone), sum(gone), [i for i, (g, k) in enumerate(zip(gone, x["kinds"], strict=True)) if g and k]

        def give(found):
            return pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in found], schema=out)

        begin = 0  # rows before it are judged already
        for b in batches:
            near += b.to_pylist()
            end = max(begin, len(near) - reach)  # the others' neighbours may still come
            found = [r for r in map(judge, range(begin, end)) if r]
            if found:
                yield give(found)
            gone = max(0, end - reach)
            near, begin = near[gone:], end - gone
        found = [r for r in map(judge, range(begin, len(near))) if r]
        if found:
            yield give(found)

    return dealt.mapInArrow(compare, "k1 long, k2 long, n_lines int, n_shared int, drop array<int>")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` of every row; see the module's text for edge cases."""
    parsed = materialize(parse_pages(pages, id_col, url_col, html_col), "page-lines")
    drop = materialize(shared_lines(parsed).filter(F.size("drop") > 0).dropDuplicates(KEY).select(*KEY, "drop"), "shared-lines")
    found = parsed.select("id_", "url_", *KEY, "kinds", "texts")
    gone = F.lit(None).cast("array<int>")
    if not drop.isEmpty():
        found, gone = found.join(drop, KEY, "left"), F.col("drop")
    numbers = F.sequence(F.lit(0), F.size("texts") - 1)
    kept = F.filter(numbers, lambda i: (F.get("kinds", i) > 0) & ~F.coalesce(F.array_contains(gone, i), F.lit(False)))
    text = F.when(F.size("texts") == 0, "").otherwise(F.array_join(F.transform(kept, lambda i: F.get("texts", i)), " "))
    out = found.select(F.col("id_").alias(id_col), F.col("url_").alias(url_col), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
