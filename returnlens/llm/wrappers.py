"""Main text of web pages by wrappers: union-free expressions inferred from the pages of a host.

A page's token stream is a nested sequence of block tags and text slots. Streams of one host are
aligned one after the other: what repeats in a row becomes a repeated group, what one of two streams
lacks an optional one, and texts that differ a text slot; equal texts stay constants. The expression
that comes out, the wrapper, carries for each place how often it occurs and how much text and link
text stands there, and from that the place of the main text is chosen.

A wrapper is a nested list ``[label, count, repeated, parts, text]``. ``parts`` are nested lists, or
for a text slot none; ``text`` of a slot is ``[characters, of these in links, constant or null]``.
A part is optional if it counts less than what holds it.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, stored

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

# Element names, as HTML defines them.
RAW = frozenset("script style textarea title iframe noframes xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("html head body".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address".split())
BLOCKS = PROSE | frozenset("""address article aside center details dialog dir div fieldset footer form header hgroup hr legend main menu nav
    noscript object optgroup option search section select summary svg template video audio canvas button""".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Names by which pages mark what is not the article, and what is.
OUTSIDE_TAGS = frozenset("nav aside footer form header noscript template svg select button dialog menu object canvas video audio fieldset".split())
OUTSIDE_NAMES = frozenset("""ad ads advert advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu
    breadcrumb breadcrumbs sidebar aside widget footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
    subscribe signup login share sharing social related recommended comment comments reply replies respond disqus discussion pager pagination
    copyright disclaimer hidden""".split())
STRONG_TAGS = frozenset(("article", "main"))
STRONG_NAMES = frozenset(("articlebody", "article", "main"))

DEEPEST = 150
FLOW = "flow"
SHARE = 0.6
STRONG_SHARE = 0.25
LINKS = 0.5
LEAST_PAGES = 4
FAN_IN = 16
HOSTS_HELD = 2_000
HOT_SHARE = 1000
HOT_PARTS = 64


def label_of(tag: str, attributes: str) -> str:
    """A block's name for alignment: its tag and the words of its class, id and role. Words with digits
    are the page's own and left out; a piece of prose keeps only words that say it is not text."""
    words = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "itemprop"):
            for word in value.split():
                if name == "itemprop":
                    words.add(word.lower())
                elif not any(c.isdigit() for c in word):
                    words.update(w.lower() for w in NAMES.findall(word))
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            words.add("hidden")
    if tag in PROSE:
        words &= OUTSIDE_NAMES
    return " ".join([tag, *sorted(words)])


def read_page(page: str) -> tuple[list, list[str]]:
    """The token stream of a page, as a wrapper of that page alone whose slots hold the numbers of their
    texts, and the texts in page order."""
    root: list = ["page", []]
    stack, texts, held = [root], [], []
    links = linked = at = 0

    def close_text() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            stack[-1][1].append([len(texts), min(linked, len(text))])
            texts.append(text)
        linked = 0

    def text(part: str) -> None:
        nonlocal linked
        held.append(part)
        linked += len(part) if links else 0

    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        if token.start() > at:
            text(page[at:token.start()])
        at = max(token.end(), token.start() + 1)
        if token[2] is None:
            continue
        closing, tag = bool(token[1]), token[2].lower()
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br" or tag == "hr":
            held.append(" ")
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if end is None else end.start()
        if tag in VOID or tag in RAW or (tag not in BLOCKS and tag not in FRAME):
            continue
        close_text()
        if tag in FRAME:
            continue
        links = 0
        opened = [node[0].split(" ", 1)[0] for node in stack]
        if closing:
            if tag in opened:
                del stack[len(opened) - 1 - opened[::-1].index(tag):]
        else:
            if opened[-1] == "p":
                stack.pop()
            elif tag in CLOSES:
                ends, bounds = CLOSES[tag]
                for place in range(len(opened) - 1, 0, -1):
                    if opened[place] in bounds:
                        break
                    if opened[place] in ends:
                        del stack[place:]
            if len(stack) < DEEPEST:  # deeper blocks stand for their texts
                node = [label_of(tag, token[3]), []]
                stack[-1][1].append(node)
                stack.append(node)
    close_text()
    return _folded(root, texts), texts


def _folded(node: list, texts: list[str]) -> list:
    """A block as wrapper: prose in a row becomes a repeated group of optional parts, one per label,
    and equal blocks in a row a repeated block."""
    parts: list[list] = []
    for child in node[1]:
        if isinstance(child[0], int):
            number, linked = child
            part = ["#", 1, False, [], [len(texts[number]), linked, zlib.crc32(texts[number].encode("utf-8", "replace"))], [number]]
        else:
            part = _folded(child, texts)
            if not part[3]:
                continue  # no text in it
        if part[0].split(" ", 1)[0] in PROSE or part[0] == "#":
            if not parts or parts[-1][0] != FLOW:
                parts.append([FLOW, 1, False, [], None])
            parts[-1][3] = _together(parts[-1][3], [part], True)
        elif parts and parts[-1][0] == part[0]:
            _merge(parts[-1], part, True)
        else:
            parts.append(part)
    return [node[0], 1, False, parts, None]


def _merge(one: list, other: list, row: bool) -> None:
    """Bring ``other`` into ``one``, of the same label; ``row``: they stand in a row on a page."""
    one[1] += other[1]
    one[2] = one[2] or other[2] or row
    if one[4] is not None:
        a, b = one[4], other[4]
        one[4] = [a[0] + b[0], a[1] + b[1], a[2] if a[2] == b[2] else None]
    if len(one) > 5 and len(other) > 5:
        one[5] = one[5] + other[5]
    one[3] = _together(one[3], other[3], one[0] == FLOW)


def _together(one: list[list], other: list[list], flow: bool) -> list[list]:
    """Two sequences of parts as one: parts aligned to each other merge, the others become optional."""
    if flow:
        out = {part[0]: part for part in one}
        for part in other:
            if part[0] in out:
                _merge(out[part[0]], part, True)
            else:
                out[part[0]] = part
        return [out[name] for name in sorted(out)]
    out = []
    for a, b in aligned([p[0] for p in one], [p[0] for p in other]):
        if a is not None and b is not None:
            _merge(one[a], other[b], False)
        out.append(one[a] if a is not None else other[b])
    return out


def aligned(one: list[str], other: list[str]) -> list[tuple[int | None, int | None]]:
    """Places of two label sequences side by side, by a longest common subsequence."""
    head = 0
    while head < min(len(one), len(other)) and one[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(one), len(other)) - head and one[-1 - tail] == other[-1 - tail]:
        tail += 1
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(head)]
    a, b = one[head:len(one) - tail], other[head:len(other) - tail]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append((head + i, None))
            i += 1
        else:
            out.append((None, head + j))
            j += 1
    return out + [(len(one) - tail + k, len(other) - tail + k) for k in range(tail)]


def _bare(node: list) -> list:
    """A wrapper without the numbers of texts."""
    return [node[0], node[1], node[2], [_bare(p) for p in node[3]], node[4]]


def _strong(node: list) -> bool:
    tag, *words = node[0].split(" ")
    return tag in STRONG_TAGS or bool(STRONG_NAMES & set(words))


def _holds_strong(node: list) -> bool:
    return any(_strong(p) or _holds_strong(p) for p in node[3])


def _outside(node: list) -> bool:
    """Whether a block is by its name not part of the article and holds none."""
    tag, *words = node[0].split(" ")
    return (tag in OUTSIDE_TAGS or bool(OUTSIDE_NAMES & set(words))) and not _holds_strong(node)


def _mass(node: list) -> float:
    """Characters outside links in a block that may be the article."""
    if node[4] is not None:
        return node[4][0] - node[4][1] if node[4][1] <= LINKS * node[4][0] else 0
    return sum(_mass(p) for p in node[3] if not _outside(p))


def main_block(wrapper: list) -> list:
    """The block that holds the article: from the page downwards, into an article or main block that has
    a good part of the text, or else into the block with most of it, as long as no headline is left behind."""
    node = wrapper
    while True:
        inner = [(p, _mass(p)) for p in node[3] if p[0] != FLOW and p[4] is None and not _outside(p)]
        mass = _mass(node)
        if not inner or mass == 0 or node[0].split(" ")[0] == "article":
            return node
        strong = [(p, m) for p, m in inner if (_strong(p) or _holds_strong(p)) and m >= STRONG_SHARE * mass]
        best, most = max(strong or inner, key=lambda found: found[1])
        headline = any(p[0].split(" ")[0] == "h1" for part in node[3] if part[0] == FLOW for p in part[3])
        if not strong and (most < SHARE * mass or headline):
            return node
        if _strong(node) and not _strong(best) and headline:
            return node
        node = best


def _varies(node: list) -> bool:
    if node[4] is not None:
        return node[4][2] is None
    return any(_varies(p) for p in node[3])


def marked_slots(wrapper: list) -> list:
    """The wrapper with each slot's text replaced by whether it belongs to the main text.

    Within the main block, blocks that are by name something else go, and slots that are mostly links.
    A constant goes if the host has several pages and other places of the block vary.
    """
    main = main_block(wrapper)
    template = wrapper[1] >= LEAST_PAGES and _varies(main)

    def mark(node: list, inside: bool) -> list:
        inside = inside or node is main
        if node[4] is not None:
            chars, linked, constant = node[4]
            fixed = template and constant is not None and node[1] >= LEAST_PAGES and not node[2]
            return [node[0], inside and linked <= LINKS * chars and not fixed]
        if inside and node is not main and _outside(node) and not (node[0].split(" ")[0] == "header" and _holds_headline(node)):
            return [node[0], []]
        return [node[0], [mark(p, inside) for p in node[3]]]

    return mark(wrapper, False)


def _holds_headline(node: list) -> bool:
    return any(p[0].split(" ")[0] == "h1" or _holds_headline(p) for p in node[3])


def _numbers(page: list, marks: list, out: list[int]) -> None:
    """Numbers of the page's texts that stand in marked slots."""
    if page[4] is not None:
        if marks[1]:
            out.extend(page[5])
        return
    if page[0] == FLOW:
        known = {m[0]: m for m in marks[1]}
        pairs = [(p, known.get(p[0])) for p in page[3]]
    else:
        pairs = [(page[3][a], marks[1][b]) for a, b in aligned([p[0] for p in page[3]], [m[0] for m in marks[1]]) if a is not None and b is not None]
    for part, mark in pairs:
        if mark is not None and isinstance(mark[1], bool) == (part[4] is not None):
            _numbers(part, mark, out)


def main_text(page: str | None, marks: list | None) -> str:
    """Main text of a page by its host's marked wrapper; if that finds none there, by the page alone."""
    if not page:
        return ""
    stream, texts = read_page(page)
    numbers: list[int] = []
    if marks is not None:
        _numbers(stream, marks, numbers)
    if not numbers:
        _numbers(stream, marked_slots(_bare(stream)), numbers)
    return "\n".join(texts[i] for i in sorted(numbers))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of a task's pages (host, html), one per host as long as not too many are held."""
    part = TaskContext.get().partitionId()
    held: dict[str, list] = {}

    def rows() -> pa.RecordBatch:
        wrappers = [json.dumps(w, separators=(",", ":")) for w in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array(wrappers, pa.string())],
                                          ["host", "part", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0), batch.column(1)):
            wrapper = _bare(read_page(page.as_py())[0])
            if (known := held.get(host.as_py())) is None:
                held[host.as_py()] = wrapper
            else:
                _merge(known, wrapper, False)
        if len(held) > HOSTS_HELD:
            yield rows()
            held.clear()
    yield rows()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, part, wrappers) with their few wrappers aligned into one."""
    for batch in batches:
        for host, part, wrappers in zip(*(batch.column(i) for i in range(3))):
            parts = [json.loads(w["wrapper"]) for w in wrappers.as_py()]
            for other in parts[1:]:
                _merge(parts[0], other, False)
            yield pa.RecordBatch.from_arrays([pa.array([host.as_py()]), pa.array([part.as_py()]), pa.array([json.dumps(parts[0], separators=(",", ":"))])],
                                             ["host", "part", "wrapper"])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of pages (host, html). Every task aligns its own pages; of what the tasks found a
    bounded number is aligned at a time, in rounds, so a host of any size never meets in one task."""
    kind = "host string, part long, wrapper string"
    found = stored(pages.where("html IS NOT NULL").select("host", "html").mapInArrow(_infer, kind), "wrappers")
    last = found.agg(F.max("part")).first()[0] or 0
    while last > 0:
        groups = found.groupBy("host", F.floor(F.col("part") / FAN_IN).alias("part")).agg(F.sort_array(F.collect_list(F.struct("part", "wrapper"))).alias("all"))
        found, last = stored(groups.mapInArrow(_combine, kind), "wrappers"), last // FAN_IN
    several = found.groupBy("host").agg(F.lit(0).cast("long").alias("part"), F.sort_array(F.collect_list(F.struct("part", "wrapper"))).alias("all"))
    return stored(several.mapInArrow(_combine, kind).select("host", "wrapper"), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, wrapper) to (page_id, url, text, n_chars)."""
    known: dict[str, list] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column(2), batch.column(3)):
            source = wrapper.as_py()
            if source is not None and source not in known:
                if len(known) >= HOSTS_HELD:
                    known.clear()
                known[source] = marked_slots(json.loads(source))
            texts.append(main_text(page.as_py(), known.get(source)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html).

    A null or empty html, and one without text, gives an empty text. Pages without a readable host share
    a wrapper. Where the wrapper finds nothing on a page, the same choice is made on that page alone.
    Rows that repeat come out each; other columns play no part; an empty table gives no rows. Broken
    markup is read as browsers do: missing end tags are implied, stray ones ignored.

    Wrappers are joined to the pages by host. A host with more than one page in a thousand, of which
    there are fewer than a thousand, is spread over several keys.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    wrappers = host_wrappers(rows)
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("n")).first().n
    hot = counts.where(F.col("n") * HOT_SHARE > total).select(F.col("host").alias("_hot"))
    spot = F.pmod(F.xxhash64("page_id", "url", F.octet_length("html")), F.lit(HOT_PARTS))
    marked = rows.join(F.broadcast(hot), F.col("host") == F.col("_hot"), "left").withColumn(
        "spot", F.when(F.col("_hot").isNotNull(), spot).otherwise(F.lit(0)))
    spread = wrappers.join(F.broadcast(hot), F.col("host") == F.col("_hot"), "left").select(
        "host", "wrapper", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(HOT_PARTS - 1).cast("long")))
                                     .otherwise(F.array(F.lit(0).cast("long")))).alias("spot"))
    joined = marked.join(spread, ["host", "spot"], "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op12_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
