"""Main text of web pages by wrappers: union-free expressions inferred from the pages of a host.

A page is read as a stream of tags and text. Inline tags don't count, missing end tags are filled
in, so the stream is a sequence of nested elements. A wrapper is such a sequence with marks:
``OPTIONAL`` groups, ``REPEATED`` groups and text slots. It starts as the first page and is aligned
with one page after the other. Equal tags advance; two different texts are a slot; at a mismatch of
tags a neighbour of the same tag makes a repeated group, and what only one side has becomes
optional. Wrappers align with wrappers in the same way: each task folds its pages into one wrapper
for each host, and these (small, whatever the number of pages) are merged host by host, in salted
rounds, so a host with a third of all pages is work for all tasks.

The slots of the main text are chosen once for a wrapper: what lies in menus, headers, footers,
sidebars, notices, adverts, forms and comments is out; then the article, or else the smallest
element with most of the text over all pages of the host. A page is matched with its host's
wrapper, and the text in those slots is the result. Elements nested deeper than ``DEPTH`` are read as
neighbours, so nothing here recurses deeper than that.
"""

from __future__ import annotations

import bisect
import html as html_lib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, stored

OPTIONAL, REPEATED, MAIN = 1, 2, 4
SLOT = "#"
#: Longest group of elements that is looked for as a repetition.
PERIOD = 4
#: Hosts that a task keeps wrappers for before it hands them on, and parts of a host's first merge.
HOSTS, SALTS = 2000, 32
#: Share of the text that the main element has at least where there is no article.
SHARE = 0.6

BLOCKS = frozenset(
    "html head body title article main section div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd menu nav header footer "
    "aside form fieldset legend label button select option optgroup datalist output textarea table caption colgroup "
    "thead tbody tfoot tr td th blockquote pre address figure figcaption details summary dialog hr center noscript "
    "template iframe object video audio canvas svg math map search frameset noframes script style".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math noframes xmp".split())
#: A start tag of the key ends an open element of the values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"}, "thead": {"caption", "colgroup"}, "body": {"head"},
}
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl dt dd fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: Elements that such closing doesn't reach through.
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
OUT_TAGS = frozenset(
    "head title nav footer aside form fieldset legend label button select option optgroup datalist output textarea menu "
    "dialog noscript template iframe object video audio canvas svg math script style search noframes map".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo "
    "promotion promoted sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar "
    "footer comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended widget widgets "
    "toolbar login pagination pager copyright hidden skiplink outbrain taboola".split()
)
#: Out unless inside an article, where they hold its title.
PAGE_ONLY = frozenset({"header"})

#: Words in front of a name that only tell a state, and words that only name a part or a place of what a name's first word is.
STATES = frozenset("has have with without no not is are js hide hidden show open enable disable".split())
PARTS_OF = frozenset(
    "left right top bottom upper lower first last main primary secondary inner outer wrap wrapper container area box block "
    "list item items slot section bar panel row col column content links link buttons button form posts articles post "
    "article title heading text body unit zone group toggle".split()
)
#: Readers' comments go however long they are; other names go only where they don't hold most of the text.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Elements that no name but that of comments takes out; a section's id is a place to link to.
KEPT_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper are read as neighbours at that depth, as browsers do; what is out stays out.
DEPTH = 200

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _means(name: str) -> str:
    """The word of ``OUT_WORDS`` that a class or id stands for, or ''.

    That is its last word, or its first one if all others name a part of it; with a state in front
    it says nothing about the element itself.
    """
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in STATES and len(words) > 1:
        return ""
    if words[-1] in OUT_WORDS:
        return words[-1]
    return words[0] if words[0] in OUT_WORDS and set(words[1:]) <= PARTS_OF else ""


def _label(tag: str, attributes: str) -> str:
    """Name of the element and the letters of its class, id and role.

    In front: '!' if it is never main text, '~' if its name says so, which is weighed later.
    """
    out = tag in OUT_TAGS
    words: list[str] = []
    means: set[str] = set()
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                words += [w.lower() for w in _WORD.findall(value)]
                mine = {_means(part) for part in value.split()}
                means |= mine & COMMENTS if name == "id" and tag == "section" else mine
            elif name == "role":
                out = out or value.lower() in OUT_ROLES
                words.append("role-" + value.lower())
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out = True
    means.discard("")
    if tag not in ("html", "body"):
        out = out or not means.isdisjoint(COMMENTS)
        if "header" in words and not {"article", "post", "entry", "story"} & set(words):
            words.append("(header)")
    mark = "!" if out else "~" if means and tag not in KEPT_TAGS else ""
    return mark + tag + "".join("." + w for w in words)


_labels: dict[tuple[str, str], str] = {}


def _known_label(tag: str, attributes: str) -> str:
    if (tag, attributes) not in _labels:
        if len(_labels) > 20_000:
            _labels.clear()
        _labels[tag, attributes] = _label(tag, attributes)
    return _labels[tag, attributes]


def tree(page: str) -> list:
    """The page's elements: [label, marks, children] and, for a block's text, ['#', 0, text]."""
    root: list = ["", 0, []]
    stack, names = [root], [""]
    opened: dict[str, int] = {}  # open elements by name
    pending: list[str] = []

    def flush():
        text = " ".join(html_lib.unescape("".join(pending)).split()) if pending else ""
        pending.clear()
        if text:
            stack[-1][2].append([SLOT, 0, text])

    def pop(to: int):
        flush()
        for name in names[to:]:
            opened[name] -= 1
        del stack[to:], names[to:]

    def nearest(tag: str) -> int:
        k = len(names) - 1
        while names[k] != tag:
            k -= 1
        return k

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            pending.append(page[at:])
            break
        if found.start() > at:
            pending.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "br":
                pending.append(" ")
            continue
        if found[1]:
            if opened.get(tag):
                pop(nearest(tag))
            else:
                flush()
            continue
        flush()
        if tag in ENDS_P and opened.get("p"):
            # Unless something like a button or a cell is in between.
            k = nearest("p")
            if not {"button", "td", "th", "object", "caption"} & set(names[k:]):
                pop(k)
        if tag in CLOSES and any(opened.get(x) for x in CLOSES[tag]):
            fence = FENCES.get(tag, {"table"})
            k = len(names) - 1
            last = 0
            while k > 0 and names[k] not in fence:
                if names[k] in CLOSES[tag]:
                    last = k
                k -= 1
            if last:
                pop(last)
        label = _known_label(tag, found[3].rstrip("/"))
        above = stack[-1]
        if len(stack) > DEPTH:  # a neighbour of the element that it is nested in
            if above[0][:1] == "!" and label[0] != "!":
                label = "!" + label.lstrip("~")
            elif above[0][:1] == "~" and label[0] not in "!~":
                label = "~" + label
            home = stack[DEPTH - 1]
        else:
            home = above
        node = [label, 0, []]
        home[2].append(node)
        if tag in VOID or found[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}(?![a-zA-Z0-9])[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else end  # what is inside is no text of the page
            continue
        stack.append(node)
        names.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return root[2]


def _copy(nodes: list) -> list:
    """A page's nodes as wrapper nodes: texts become slots that count their characters."""
    return [[n, m, len(c) if isinstance(c, str) else c if n == SLOT else fold(_copy(c))] for n, m, c in nodes]


def _join(a: list, b: list) -> list:
    """Two nodes of one label as one."""
    if a[0] == SLOT:
        return [SLOT, a[1] | b[1], a[2] + b[2]]
    return [a[0], a[1] | b[1], align(a[2], b[2])]


def fold(nodes: list) -> list:
    """Neighbours of one label become a repeated element, equal neighbouring sequences a repeated group."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = _join(out[-1], node)
            out[-1][1] |= REPEATED
        else:
            out.append(node)
        for period in range(2, min(PERIOD, len(out) // 2) + 1):
            if all(out[-k - 1][0] == out[-k - 1 - period][0] for k in range(period)):
                for k in range(period):
                    out[-k - 1 - period] = _join(out[-k - 1 - period], out[-k - 1])
                    out[-k - 1 - period][1] |= REPEATED
                del out[-period:]
                break
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence of two label sequences.

    Short ones by a table; long ones by the places that agree (Hunt and Szymanski), which takes time
    by the number of agreeing pairs. Where even these are too many, the ends of the sequences are
    matched greedily, which leaves more of both optional but loses nothing.
    """
    if len(a) * len(b) <= 1 << 16:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    if sum(len(places.get(x, ())) for x in a) > 1 << 20:
        out, j = [], 0
        for i, x in enumerate(a):
            k = bisect.bisect_right(places.get(x, []), -j, key=lambda p: -p) if x in places else 0
            if k:
                out.append((i, places[x][k - 1]))
                j = places[x][k - 1] + 1
        return out
    ends: list[int] = []
    links: list = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect.bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append((link[0], link[1]))
        link = link[2]
    return out[::-1]


def align(a: list, b: list) -> list:
    """The wrapper of both sequences: what they share in order is joined, the rest is optional."""
    head = 0
    while head < len(a) and head < len(b) and a[head][0] == b[head][0]:
        head += 1
    out = [_join(x, y) for x, y in zip(a[:head], b[:head])]
    if head == len(a) == len(b):
        return out
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail][0] == b[-1 - tail][0]:
        tail += 1
    rest, other = a[head : len(a) - tail], b[head : len(b) - tail]
    i = j = 0
    for x, y in [*_common([n[0] for n in rest], [n[0] for n in other]), (len(rest), len(other))]:
        for side, start, stop in ((rest, i, x), (other, j, y)):
            out += [[n[0], n[1] | OPTIONAL, n[2]] for n in side[start:stop]]
        if x < len(rest) or y < len(other):
            out.append(_join(rest[x], other[y]))
        i, j = x + 1, y + 1
    out += [_join(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :])]
    return fold(out)


def _is_out(label: str, inside: bool) -> bool:
    return label[0] == "!" or not inside and (label.partition(".")[0] in PAGE_ONLY or "(header)" in label)


def weighed(nodes: list) -> list:
    """The wrapper with '~' elements settled: those that hold at least half of the text stay, others are out ('!')."""

    def weight(children: list) -> int:
        return sum(n[2] if n[0] == SLOT else 0 if n[0][0] == "!" else weight(n[2]) for n in children)

    total = weight(nodes)

    def settle(children: list) -> list:
        out = []
        for label, marks, rest in children:
            if label[0] == "~":
                label = ("" if 2 * weight(rest) >= total else "!") + label[1:]
            out.append([label, marks, rest if label == SLOT else settle(rest)])
        return out

    return settle(nodes)


def _is_article(label: str) -> bool:
    tag, *words = label.split(".")
    return tag == "article" or "articlebody" in words or {"article", "body"} <= set(words)


def _is_main(label: str) -> bool:
    return label.partition(".")[0] == "main" or ".role-main" in label


def choose(wrapper: list) -> list:
    """Mark the slots of the main text: in articles, else in main, else in the smallest element with most text."""
    settled = weighed(wrapper)
    _choose(settled)
    _hand_back(settled, wrapper)
    return wrapper


def _hand_back(settled: list, wrapper: list) -> None:
    """The marks of the slots of the same wrapper with settled labels."""
    for x, y in zip(settled, wrapper):
        if x[0] == SLOT:
            y[1] = x[1]
        else:
            _hand_back(x[2], y[2])


def _choose(wrapper: list) -> list:
    """``choose`` where every element is in or out."""

    def weight(nodes: list, inside: bool) -> int:
        total = 0
        for label, _, rest in nodes:
            if label == SLOT:
                total += rest
            elif not _is_out(label, inside):
                total += weight(rest, inside)
        return total

    def mark(nodes: list, inside: bool) -> None:
        for node in nodes:
            if node[0] == SLOT:
                node[1] |= MAIN
            elif not _is_out(node[0], inside):
                mark(node[2], inside)

    def within(nodes: list, test) -> list:
        found = []
        for node in nodes:
            if node[0] == SLOT or _is_out(node[0], False):
                continue
            found += [node] if test(node[0]) and weight(node[2], True) else within(node[2], test)
        return found

    for test in (_is_article, _is_main):
        if chosen := within(wrapper, test):
            for node in chosen:
                mark(node[2], True)
            return wrapper
    at, inside = wrapper, weight(wrapper, False)
    while True:
        heavy = [n for n in at if n[0] != SLOT and not _is_out(n[0], False) and n[1] & REPEATED == 0]
        heavy = [n for n in heavy if n[2] and weight(n[2], False) >= SHARE * inside and any(x[0] != SLOT for x in n[2])]
        if len(heavy) != 1:
            break
        at = heavy[0][2]
    mark(at, False)
    return wrapper


def texts(nodes: list, wrapper: list) -> list[str]:
    """The page's texts that fall into the main slots of the wrapper, in page order."""
    out, at = [], 0
    for label, _, rest in nodes:
        place = next((k for k in range(at, len(wrapper)) if wrapper[k][0] == label), None)
        if place is None:  # back to the start of a repeated group
            place = next((k for k in range(len(wrapper)) if wrapper[k][0] == label), None)
        if place is None:
            continue
        at = place
        if label == SLOT:
            if wrapper[place][1] & MAIN:
                out.append(rest)
        else:
            out += texts(rest, wrapper[place][2])
    return out


def _own(pages) -> object:
    """Wrappers by host of a task's pages."""

    def rows(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()], pa.string())],
            ["host", "wrapper"],
        )

    held: dict = {}
    for batch in pages:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new = fold(_copy(tree(page or "")))
            held[host] = align(held[host], new) if host in held else new
        if len(held) > HOSTS:
            yield rows(held)
            held = {}
    yield rows(held)


def _merge(last: bool):
    """Wrappers that follow each other for one host (and salt) become one."""

    def run(batches):
        host, salt, held = None, None, None

        def row():
            text = json.dumps(choose(held) if last else held, separators=(",", ":"))
            return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([text], pa.string())], ["host", "wrapper"])

        for batch in batches:
            for h, s, w in zip(*(c.to_pylist() for c in batch.columns)):
                new = json.loads(w)
                if held is not None and (h, s) == (host, salt):
                    held = align(held, new)
                    continue
                if held is not None:
                    yield row()
                host, salt, held = h, s, new
        if held is not None:
            yield row()

    return run


def _named(pages: DataFrame) -> DataFrame:
    address = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("_host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (as JSON, main slots marked) of all pages; addresses without a host share the host ''."""
    bounded_batches(pages.sparkSession)
    parts = _named(pages).select("_host", "html").mapInArrow(_own, "host string, wrapper string")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.select("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int").alias("salt"), "wrapper")
    salted = salted.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    once = salted.mapInArrow(_merge(False), "host string, wrapper string")
    whole = once.select("host", F.lit(0).alias("salt"), "wrapper").repartition(n, "host").sortWithinPartitions("host", "wrapper")
    return whole.mapInArrow(_merge(True), "host string, wrapper string")


def main_text(page: str, wrapper: list) -> str:
    """The main text of one page; if its host's slots are all empty there, by a wrapper of its own."""
    nodes = tree(page)
    found = texts(nodes, wrapper)
    if not found:
        found = texts(nodes, choose(fold(_copy(nodes))))
    return "\n".join(found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``.

    A null html is an empty page; a null url counts to the host ''. A page without main text has
    text '' and n_chars 0. Repeated rows give repeated results; other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    # Stored, so that the planner knows its size: it is broadcast if that is small, else joined by host.
    known = stored(wrappers(pages), "wrappers")
    joined = _named(pages).join(known, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "wrapper")
    kinds = dict(pages.dtypes)

    def run(batches):
        read: dict = {}
        for batch in batches:
            out = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper not in read:
                    if len(read) > HOSTS:
                        read.clear()
                    read[wrapper] = json.loads(wrapper) if wrapper else []
                out.append(main_text(page or "", read[wrapper]))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
