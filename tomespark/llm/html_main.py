"""Main text of web pages by inferred wrappers.

Pages of a host are token streams of tags and text. Wrappers are union-free
regular expressions over such tokens: folding a stream turns runs of repeated
token groups into one repeated group; aligning it with the wrapper so far
turns tokens that only one side has into optional ones, and texts into slots.
Aligning also says which node of the wrapper each text of a page fills; texts
of one repeated group fill the same slots. A page's text is read off the slots
that its texts fill, and of nothing else. A slot is judged by what all pages of
its block put there: whether they mostly have the same text, how much of it is
links, and the elements around it. Elements and words that always mean something
else than an article (menus, adverts, comments) rule a slot out; words that may
(``related``, ``form``, ``search``) do so only for a constant or a linked slot.
Pages without an article or main element are read from the container in which
most running text varies.

A host's pages are dealt into blocks of about ``BLOCK`` pages by the hash of
page id and url, so a host with any number of pages never gathers in a task,
and every page takes part in its block's wrapper.

Defined cases: null and empty html give an empty text; a null url is a host of
its own kind; repeated rows give a row each; line breaks and images inside a
paragraph don't end its block; broken markup (unclosed or stray tags, cut
entities) is read as browsers do, about; a page of any length is read as a
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 64
#: Hosts of more than a block (some 50 bytes each) that are broadcast at most; beyond, it's a shuffled join.
BROADCAST_HOSTS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|object|select|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_LABEL = re.compile(r"\b(?:class|id|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same kind or of another block closes, as HTML has it.
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NOT_MAIN_TAGS = frozenset("nav footer aside form head menu dialog fieldset".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_TAGS = frozenset("article main".split())
#: Words of classes and ids that always mean something beside the article, and those that may.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus masthead nav navbar navigation newsletter pager pagination popup promo promotion replies sidebar sponsor sponsored".split()
)
MAY_BE = frozenset("banner copyright footer form header hidden login menu modal notice notices recommended related reply search share sharing signup social subscribe subscription tags toolbar widget".split())
MAIN = frozenset("article articlebody content entry main post story".split())
#: Words that make a name with one of NOT_MAIN say how a page is laid out or what state it is in (has-sidebar, comments-open),
#: and those that do so on an element around an article (content-sidebar-wrap).
STATE = frozenset("has no not with without is are hide show open opened closed enabled disabled on off allow allowed js layout".split())
AROUND = frozenset("content wrap wrapper main page site container left right one two three col cols column columns grid".split())
_ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-zA-Z]+)", re.I)


def _words(attrs: str) -> frozenset[str]:
    if not attrs:
        return frozenset()
    names = [[w.lower() for w in _WORD.findall(name)] for m in _LABEL.finditer(attrs) for name in (m[1] or m[2] or m[3] or "").split()]
    words = frozenset(w for name in names for w in name)
    # "!beside": a whole name says that the element isn't the article; "!even-around": also where an article lies in it
    said = [frozenset(name) for name in names if not NOT_MAIN.isdisjoint(name)]
    if any(len(name) == 1 or STATE.isdisjoint(name) for name in said):
        words |= {"!beside"}
    if any(len(name) == 1 or (STATE | AROUND).isdisjoint(name) for name in said):
        words |= {"!even-around"}
    role = _ROLE.search(attrs)
    return words | {"role=" + role[1].lower()} if role and role[1].lower() in NOT_MAIN_ROLES else words


class Page:
    """Blocks of a page in order: (path of open elements, text, characters in links)."""

    def __init__(self, text: str) -> None:
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []
        stack: list[str] = []
        names: list[str] = []
        parts: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                own = " ".join(entities.unescape("".join(parts)).split())
                if own:
                    self.blocks.append((tuple(stack), own, linked))
                parts.clear()
            linked = 0

        links = 0
        for m in _TOKEN.finditer(text):
            if m["text"] is not None:
                parts.append(m["text"])
                if links:
                    linked += len(m["text"])
                continue
            name = m["name"] or m["name2"]
            if name is None:
                if m["raw"] and m["raw"].lower() == "title":
                    flush()
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    links = 0 if m["close"] or m["close2"] else 1
                continue
            if name in VOID and name != "hr":
                if name == "br":
                    parts.append(" ")
                continue
            flush()
            links = 0
            if m["close"] or m["close2"]:
                if name in names:
                    at = len(names) - 1 - names[::-1].index(name)
                    del names[at:], stack[at:]
                continue
            if name in VOID:
                continue
            while names and names[-1] in CLOSED_BY and (CLOSED_BY[names[-1]] is None or name in CLOSED_BY[names[-1]]):
                names.pop()
                stack.pop()
            words = _words(m["attrs"] or m["attrs2"] or "")
            names.append(name)
            stack.append(name + "".join("." + w for w in sorted(words)))
        flush()

    def stream(self) -> list[str]:
        """Tokens: the elements that open and close between texts, and a # for each text."""
        out: list[str] = []
        last: tuple[str, ...] = ()
        for path, _, _ in self.blocks:
            same = 0
            while same < min(len(path), len(last)) and path[same] == last[same]:
                same += 1
            if path == last and path:  # the next element of the same kind
                same -= 1
            out += ["/" + x for x in reversed(last[same:])]
            out += path[same:]
            out.append("#")
            last = path
        return out + ["/" + x for x in reversed(last)]


def _alike(out: list, at: int, n: int) -> bool:
    """Whether the n tokens before ``at`` and the last n are the same, looked at from the end."""
    return all(out[at - k] == out[-k] for k in range(1, n + 1))


def fold_and_count(stream: list) -> tuple[tuple, tuple]:
    """fold(), and how many texts each of its nodes stands for."""
    out: list = []
    held: list[int] = []
    seen: dict = {}  # places of a token, some of which may be folded by now
    folded: list[int] = []  # places of groups
    for token in stream:
        out.append(token)
        held.append(int(token == "#"))
        repeats, places = [], seen.setdefault(token, [])
        last = len(out)
        for k in range(len(places) - 1, -1, -1):  # the nearest place where this token stood is the shortest group
            n = last - 1 - places[k]
            if 2 * n > last:
                break
            if places[k] < last - 1 and out[places[k]] == token and _alike(out, last - n, n):
                repeats.append(n)
                break
        if repeats:
            n = repeats[0]
            out[-2 * n :] = [("+", tuple(out[-n:]))]
            held[-2 * n :] = [sum(held[-2 * n :])]
            while folded and folded[-1] >= len(out) - 1:
                folded.pop()
            folded.append(len(out) - 1)
        before = next((at for at in reversed(folded[-2:]) if at <= len(out) - 2), None)
        if before is not None:  # a group before that these tokens are another round of
            n = len(out) - 1 - before
            if len(out[before][1]) == n and out[before][1] == tuple(out[-n:]):
                held[before:] = [sum(held[before:])]
                del out[before + 1 :]
                while folded[-1] > before:
                    folded.pop()
        while places and (places[-1] >= len(out) or out[places[-1]] != token):
            places.pop()
        if out[-1] == token:
            places.append(len(out) - 1)
    return tuple(out), tuple(held)


def fold(stream: list) -> tuple:
    """The stream with every run of a repeated group of tokens as one ("+", group), however long."""
    return fold_and_count(stream)[0]


def groups_of(nodes: tuple) -> Iterator[tuple]:
    """The repeated groups of more than one token, inner ones first."""
    for node in nodes:
        if isinstance(node, tuple):
            yield from groups_of(node[1])
            if node[0] == "+" and len(node[1]) > 1:
                yield node[1]


def single_groups(nodes: tuple, held: tuple, groups: list[tuple]) -> tuple[tuple, tuple]:
    """The folded stream with groups that stand once in it, but repeat in other pages, as repeated groups too."""
    out, counts = list(nodes), list(held)
    for group in groups:
        n, i = len(group), 0
        while i <= len(out) - n:
            if out[i] == group[0] and tuple(out[i : i + n]) == group:
                out[i : i + n], counts[i : i + n] = [("+", group)], [sum(counts[i : i + n])]
            i += 1
    return tuple(out), tuple(counts)


def plain(node) -> object:
    """What a wrapper's node stands for when it's compared: the token or the group, optional or not."""
    while isinstance(node, tuple) and node[0] == "?":
        node = node[1][0]
    return node


def same(a, b) -> bool:
    a, b = plain(a), plain(b)
    if isinstance(a, tuple) != isinstance(b, tuple):
        group, one = (a, b) if isinstance(a, tuple) else (b, a)
        return group[1] == (one,)
    return a == b


def _key(node) -> object:
    """Equal for nodes that are the same()."""
    node = plain(node)
    return node[1][0] if isinstance(node, tuple) and len(node[1]) == 1 and not isinstance(node[1][0], tuple) else node


class Rows:
    """Lengths of longest common subsequences of w[i:] and s[j:], a row of bits for each i (Hyyro's bit vectors).

    A row is one number of len(s) bits, made from the row after it by one
    addition. Every k-th row is kept, k the root of len(w), and the rows between
    are made again when they are read, so memory grows as k times len(s) bits.
    Rows are read in rising order.
    """

    def __init__(self, w: list[int], s: list[int]) -> None:
        self.w, self.m = w, len(s)
        self.every = max(1, int(len(w) ** 0.5))
        self.ones = (1 << self.m) - 1
        self.places: dict[int, list[int]] = {}
        for j, one in enumerate(s):
            self.places.setdefault(one, []).append(self.m - 1 - j)
        self.mask = lru_cache(maxsize=64)(self._mask)
        self.kept = {len(w): self.ones}
        row = self.ones
        for i in range(len(w) - 1, -1, -1):
            row = self._before(row, i)
            if i % self.every == 0:
                self.kept[i] = row
        self.first, self.held = 0, [] if not w else self._between(0)

    def _mask(self, one: int) -> int:
        bits = bytearray(self.m // 8 + 1)
        for p in self.places.get(one, ()):
            bits[p >> 3] |= 1 << (p & 7)
        return int.from_bytes(bits, "little")

    def _before(self, row: int, i: int) -> int:
        same = row & self.mask(self.w[i])
        return ((row + same) | (row - same)) & self.ones

    def _between(self, first: int) -> list[int]:
        """Rows from ``first``, a kept one, to the next kept one."""
        last = min(first + self.every, len(self.w))
        out = [self.kept[last]]
        for i in range(last - 1, first - 1, -1):
            out.append(self._before(out[-1], i))
        return out[::-1]

    def row(self, i: int) -> int:
        if i > self.first + self.every:
            self.first = (i - 1) // self.every * self.every
            self.held = self._between(self.first)
        return self.held[i - self.first] if i - self.first < len(self.held) else self.kept[i]

    def longest(self, i: int, j: int) -> int:
        left = self.m - j
        return left - (self.row(i) & ((1 << left) - 1)).bit_count()

    def gains(self, i: int, j: int) -> bool:
        """Whether s[j] makes the longest one of w[i:] longer."""
        return not self.row(i) >> (self.m - 1 - j) & 1


def steps(wrapper: tuple, stream: tuple) -> list[tuple[int | None, int | None]]:
    """The longest common subsequence: places of wrapper and stream in order, None where only one side has a node."""
    known: dict = {}
    number = lambda nodes: [known.setdefault(_key(x), len(known)) for x in nodes]
    w, s = number(wrapper), number(stream)
    head = 0
    while head < min(len(w), len(s)) and w[head] == s[head]:
        head += 1
    tail = 0
    while tail < min(len(w), len(s)) - head and w[-1 - tail] == s[-1 - tail]:
        tail += 1
    n, m = len(w) - head - tail, len(s) - head - tail
    w, s = w[head : head + n], s[head : head + m]
    rows = Rows(w, s)
    out: list[tuple[int | None, int | None]] = [(k, k) for k in range(head)]
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and w[i] == s[j]:
            out.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif j == m or i < n and (rows.gains(i, j) or rows.longest(i + 1, j) >= rows.longest(i, j)):
            out.append((head + i, None))
            i += 1
        else:
            out.append((None, head + j))
            j += 1
    return out + [(head + n + k, head + m + k) for k in range(tail)]


def _joined(wrapper: tuple, stream: tuple, pairs: list[tuple[int | None, int | None]]) -> tuple:
    optional = lambda x: x if isinstance(x, tuple) and x[0] == "?" else ("?", (x,))
    merged = lambda a, b: a if isinstance(plain(a), tuple) or not isinstance(plain(b), tuple) else (("?", (plain(b),)) if a != plain(a) else b)
    return tuple(optional(stream[j]) if i is None else optional(wrapper[i]) if j is None else merged(wrapper[i], stream[j]) for i, j in pairs)


def align(wrapper: tuple, stream: tuple) -> tuple:
    """The wrapper that also holds this folded stream: tokens of one side only become optional."""
    return _joined(wrapper, stream, steps(wrapper, stream))


class Wrapper(tuple):
    """A wrapper's nodes, and for each text of each page the number of the node that it fills."""

    def __new__(cls, nodes: tuple = (), filled: dict[Page, list[int]] | None = None) -> Wrapper:
        out = super().__new__(cls, nodes)
        out.filled = filled or {}
        return out


def infer(pages: list[Page]) -> Wrapper:
    """The wrapper of all pages. Streams that fold alike are aligned once."""
    plainly = [fold_and_count(page.stream()) for page in pages]
    groups = list(dict.fromkeys(g for nodes, _ in dict.fromkeys(plainly) for g in groups_of(nodes)))
    wrapper: tuple | None = None
    numbers: list[int] = []  # of the wrapper's nodes, which they keep
    seen: dict[tuple, list[int]] = {}
    filled: dict[Page, list[int]] = {}
    done: dict[tuple, tuple] = {}
    for page, folded in zip(pages, plainly):
        if folded not in done:
            done[folded] = single_groups(*folded, groups)
        nodes, held = done[folded]
        if nodes not in seen:
            if wrapper is None:
                wrapper, numbers = nodes, list(range(len(nodes)))
                seen[nodes] = numbers
            else:
                pairs = steps(wrapper, nodes)
                fresh = iter(range(len(numbers), len(numbers) + len(pairs)))
                numbers = [next(fresh) if i is None else numbers[i] for i, _ in pairs]
                wrapper = _joined(wrapper, nodes, pairs)
                seen[nodes] = [k for k, (_, j) in zip(numbers, pairs) if j is not None]
        filled[page] = [k for k, n in zip(seen[nodes], held) for _ in range(n)]
    return Wrapper(wrapper or (), filled)


class Place:
    """What the elements around a slot say."""

    def __init__(self, path: tuple[str, ...]) -> None:
        self.out = self.main = self.tagged = self.doubted = False
        around = max((k for k, element in enumerate(path) if element.split(".")[0] in MAIN_TAGS), default=-1)
        for k, element in enumerate(path):
            name, *words = element.split(".")
            self.out = self.out or name in NOT_MAIN_TAGS or (name == "header" and not self.main) or any(w.startswith("role=") for w in words)
            if name != "body":
                self.out = self.out or ("!even-around" if k < around else "!beside") in words
            if name not in MAIN_TAGS and name != "body":
                self.doubted = self.doubted or not MAY_BE.isdisjoint(words)
            self.main = self.main or (not self.out and (name in MAIN_TAGS or (name in ("div", "section", "td") and not MAIN.isdisjoint(words) and not self.doubted)))
            self.tagged = self.tagged or (not self.out and name in MAIN_TAGS)


class Slots:
    """What all pages of a block put into each slot (node, path) of their wrapper."""

    def __init__(self, wrapper: Wrapper, pages: list[Page]) -> None:
        self.of = {p: [(node, path) for node, (path, _, _) in zip(wrapper.filled.get(p, ()), p.blocks)] for p in pages}
        self.chars: dict[tuple, int] = {}
        self.linked: dict[tuple, int] = {}
        on: dict[tuple, dict[str, int]] = {}
        filling: dict[tuple, int] = {}
        for page in {tuple(b[:2] for b in p.blocks): p for p in pages}.values():
            own = set()
            for slot, (_, text, linked) in zip(self.of[page], page.blocks):
                own.add((slot, text))
                self.chars[slot] = self.chars.get(slot, 0) + len(text)
                self.linked[slot] = self.linked.get(slot, 0) + linked
            for slot, text in own:
                texts = on.setdefault(slot, {})
                texts[text] = texts.get(text, 0) + 1
            for slot in {slot for slot, _ in own}:
                filling[slot] = filling.get(slot, 0) + 1
        #: slot -> the texts that most of five or more different pages have there, where little else stands there
        self.constant: dict[tuple, set[str]] = {}
        for slot, texts in on.items():
            often = {t for t, n in texts.items() if filling[slot] >= 5 and n >= 0.8 * filling[slot]}
            if sum(texts[t] for t in often) >= 0.8 * sum(texts.values()):
                self.constant[slot] = often

    def fixed(self, slot: tuple, text: str) -> bool:
        return text in self.constant.get(slot, ())


def constant_slots(wrapper: Wrapper, pages: list[Page]) -> set[tuple]:
    """Slots (node, path) that five or more different pages fill, mostly with the same text."""
    return {slot for slot, texts in Slots(wrapper, pages).constant.items() if texts}


def main_paths(wrapper: Wrapper, pages: list[Page]) -> dict[Page, list[bool]]:
    """For each page, which of its texts are the article's, by the slots that they fill."""
    slots = Slots(wrapper, pages)
    places = {path: Place(path) for path in {b[0] for p in pages for b in p.blocks}}

    def inside(slot: tuple, text: str) -> bool:
        place = places[slot[1]]
        beside = place.doubted and (slots.fixed(slot, text) or 2 * slots.linked[slot] > slots.chars[slot])
        return place.main and not place.out and not beside

    named = {page for page in pages if any(inside(slot, b[1]) for slot, b in zip(slots.of[page], page.blocks))}
    # no article-like element: the container with most text outside links, where texts differ between pages
    open_ = lambda slot: not places[slot[1]].out and not places[slot[1]].doubted
    rest = [(slot, text, linked) for page in pages if page not in named for slot, (_, text, linked) in zip(slots.of[page], page.blocks) if open_(slot)]
    varying = [x for x in rest if not slots.fixed(x[0], x[1])]
    weight_of = lambda blocks: sum(max(0, len(text) - 3 * linked) for _, text, linked in blocks)
    mass: dict[tuple[str, ...], float] = {}
    for (_, path), text, linked in varying if 2 * weight_of(varying) >= weight_of(rest) else rest:
        weight = max(0, len(text) - 3 * linked)
        for depth in range(len(path) + 1):
            mass[path[:depth]] = mass.get(path[:depth], 0.0) + weight
    at: tuple[str, ...] = ()
    while True:
        below = [(m, p) for p, m in mass.items() if len(p) == len(at) + 1 and p[: len(at)] == at]
        if not below or max(below)[0] < 0.8 * mass.get(at, 0.0) or max(below)[1][-1].split(".")[0] in ("p", "li", "td"):
            break
        at = max(below)[1]
    out: dict[Page, list[bool]] = {}
    for page in pages:
        own = list(zip(slots.of[page], page.blocks))
        kept = [inside(slot, b[1]) if page in named else open_(slot) and slot[1][: len(at)] == at for slot, b in own]
        fixed = [k and not places[slot[1]].tagged and slots.fixed(slot, b[1]) for k, (slot, b) in zip(kept, own)]
        size = lambda marks: sum(len(b[1]) for (_, b), x in zip(own, marks) if x)
        if 2 * size(fixed) <= size(kept):  # else the pages are copies, about, and constant text may be the article
            kept = [k and not f for k, f in zip(kept, fixed)]
        out[page] = kept
    return out


def read(page: Page, main: dict[Page, list[bool]]) -> str:
    return "\n".join(text for (_, text, _), kept in zip(page.blocks, main[page]) if kept)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row of pages."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    sizes = common.written(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).filter("blocks > 1"), "large-hosts")
    large = F.broadcast(sizes) if sizes.count() <= BROADCAST_HOSTS else sizes
    dealt = rows.join(large, "host", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("page_id", "url"), F.col("blocks")))
    ordered = dealt.select("host", "block", "page_id", "url", "html").repartition("host", "block").sortWithinPartitions("host", "block", "page_id", "url")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.groups(batches, 2):
            own = [Page(h) for h in rows.column(4).to_pylist()]
            main = main_paths(infer(own), own)
            yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(3), pa.array([read(p, main) for p in own], pa.string())], names=["page_id", "url", "text"])

    return ordered.mapInArrow(extract, "page_id long, url string, text string")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.spread(common.table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))


#: The same rows for pages with one article element that holds blocks and inline tags only, as all pages of the standard tables do.
ORACLE_SQL = r"""
with a as (
  select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) inner_html from pages),
b as (
  select page_id, url, list_transform(
    regexp_split_to_array(regexp_replace(regexp_replace(inner_html, '</?(a|b|i|em|strong|span)(\s[^>]*)?>', '', 'g'), '<br\s*/?>', ' ', 'g'), '<[^>]*>'),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) blocks
  from a),
c as (select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from b)
select page_id, url, text, length(text) n_chars from c
"""
