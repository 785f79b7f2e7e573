"""Main text of web pages by wrapper induction.

Pages of one host are cut to skeletons (tags, classes, sizes and hashes of their texts), dealt into small groups and
aligned with the group's first page by simple tree matching. A text node that meets the same text in its partner is
constant; nodes that are constant on most pages of the host are its template. What is left varies: the host's main slot
is the innermost element that most pages have once and that holds most of their varying text outside of links. Where
the page marks an article its slots are the text, else the main slot is, without the template in either case. Menus,
adverts and the like go by tag; by the words of their class where the page has neither article nor main slot, and
inside an article where these words are all that the class says.
"""

from __future__ import annotations

import html as references
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored

# Element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_FOREIGN = frozenset({"svg", "math"})
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "option", "optgroup", "caption", "tr", "td", "th", "tbody", "thead", "tfoot", "html", "body"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: What ends svg and math that were never closed, and inside which of their elements it does not.
_BREAKS_OUT = _BLOCK - {"title"} | frozenset("b big code em embed head i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
_HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
_LEFT_OUT = frozenset("nav aside footer form script style noscript iframe template svg annotation annotation-xml button select input textarea head title dialog menu search object audio video canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments commentlist disqus discussion replies "
    "share sharing social related recommended newsletter subscribe signup popup modal overlay widget toolbar pagination pager".split()
)

#: Of these, what is no part of an article even on a heading or a paragraph.
_FOREIGN_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored cookie cookies consent newsletter subscribe share sharing".split())
#: Of these, what holds articles of others beside or below the page's own.
_OTHERS = frozenset("comment comments commentlist disqus replies related recommended".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)", re.S)
_DIGITS = re.compile(r"[0-9]{3,}")
_HOLDERS = frozenset("div section ul ol dl table center details figure".split())
#: Class words and types of articles that are readers' comments.
_COMMENT = re.compile(r"(?:^|[\s/_-])(?:comment|comments|reply|replies)(?:$|[\s_-])")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
#: Why an element is left out: by what it is, by the words of its class or id, or as a form.
_SURELY, _BY_WORDS, _AS_FORM = 1, 2, 3


class Node:
    """An element; kids are elements and texts in page order. out says whether and why it is left out by itself.

    name is the tag with its class or id, without numbers of three digits or more.
    """

    __slots__ = ("tag", "name", "kids", "out")

    def __init__(self, tag: str, name: str = "", out: int = 0):
        self.tag, self.name, self.kids, self.out = tag, name or tag, [], out


def _own_attributes(attributes: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'").lower()) for name, value in _ATTRIBUTE.findall(attributes)] if attributes else []


def _named(tag: str, attributes: list[tuple[str, str]]) -> str:
    return ".".join([tag, *(_DIGITS.sub("", " ".join(value.split())) for name, value in attributes if name in ("class", "id"))])


def _boilerplate(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> int:
    if tag in _LEFT_OUT and tag != "form" or tag == "header" and not in_article:
        return _SURELY
    why = _AS_FORM if tag == "form" else 0
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return _SURELY
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _SURELY
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and not _WORDS.isdisjoint(words := value.split()):
            if in_article and not _OTHERS.isdisjoint(words):
                return _SURELY
            if not in_article or not _FOREIGN_WORDS.isdisjoint(words) or tag in _HOLDERS and _WORDS.issuperset(words):
                why = why or _BY_WORDS
        if tag == "article" and name in ("class", "id", "itemprop", "itemtype") and _COMMENT.search(value):
            return _SURELY
    return why


def parse(page: str) -> Node:
    """The element tree. Unclosed and stray tags are mended as browsers do in the common cases."""
    root = Node("#")
    stack, at, end = [root], 0, len(page)
    opened: Counter[str] = Counter()  # the open elements by tag, so that a deep page is not searched for what isn't there

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def last(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag) if opened[tag] else 0

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if k := last(tag):
                close(k)
            continue
        foreign = max(last("svg"), last("math"))
        if foreign and any(x.tag in _HOLDS_HTML for x in stack[foreign + 1 :]):
            foreign = 0
        if foreign and tag in _BREAKS_OUT:
            close(foreign)
            foreign = 0
        if tag in _CLOSES_P and (k := last("p")):
            close(k)
        if tag in _SAME and any(opened[x] for x in _SAME[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _STOPS[tag]:
                    break
                if stack[k].tag in _SAME[tag]:
                    close(k)
                    break
        attributes = _own_attributes(m[3])
        node = Node(tag, _named(tag, attributes), _boilerplate(tag, attributes, opened["article"] + opened["main"] > 0))
        if tag in ("article", "main") and opened["form"]:
            for x in stack:  # a form around an article is the page's, as a rule
                x.out = 0 if x.out == _AS_FORM else x.out
        stack[-1].kids.append(node)
        if (foreign or tag in _FOREIGN) and m[3].rstrip().endswith("/"):
            continue
        if tag in _RAW:
            ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if ended is None:
                if tag in ("script", "style", "textarea", "title"):
                    break
                continue  # one that was never closed holds nothing
            node.kids.append(page[at : ended.start()])
            at = ended.end()
        elif tag not in _VOID:
            stack.append(node)
            opened[tag] += 1
    return root


def _own_text(node: Node) -> str:
    return " ".join(" ".join(k for k in node.kids if isinstance(k, str)).split())


def _key(path: int, tag: str) -> int:
    """The checksum of a path of tags, from that of the path above."""
    return zlib.crc32(f"{path:08x}/{tag}".encode())


def skeleton(root: Node) -> bytes:
    """The elements in page order: depth, checksums of the tag, of the path of names and of the own text, and the text's characters outside of links."""
    out = []
    left = [(root, 0, 0, False)]
    while left:
        node, depth, path, linked = left.pop()
        text = _own_text(node) if node.tag not in _RAW else ""
        linked = linked or node.tag == "a"
        out.append(struct.pack("<IIIII", depth, zlib.crc32(node.tag.encode()), path, zlib.crc32(text.encode()) | 1 if text else 0, 0 if linked else len(text)))
        if node.tag != "svg":
            left += [(kid, depth + 1, _key(path, kid.name), linked) for kid in reversed(node.kids) if not isinstance(kid, str)]
    return b"".join(out)


class Bone:
    """An element of a skeleton."""

    __slots__ = ("tag", "depth", "path", "text", "chars", "kids", "above")

    def __init__(self, tag: int, depth: int, path: int, text: int, chars: int, above: Bone | None):
        self.tag, self.depth, self.path, self.text, self.chars, self.kids, self.above = tag, depth, path, text, chars, [], above


def rebuilt(packed: bytes) -> list[Bone]:
    """The elements in page order, the root first."""
    bones: list[Bone] = []
    stack: list[Bone] = []
    for depth, tag, path, text, chars in struct.iter_unpack("<IIIII", packed):
        del stack[depth:]
        bone = Bone(tag, depth, path, text, chars, stack[-1] if stack else None)
        if stack:
            stack[-1].kids.append(bone)
        stack.append(bone)
        bones.append(bone)
    return bones


class _Forms:
    """Elements numbered by their form: tag, text and the forms of the kids. A form's kids have smaller numbers."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.tag: list[int] = []
        self.text: list[int] = []
        self.kids: list[tuple[int, ...]] = []
        self.plain: list[int] = []  # the form without texts
        self.texts: list[frozenset[int] | None] = []  # those in and below a form, None where there are many

    def number(self, tag: int, text: int, kids: tuple[int, ...]) -> int:
        form = self.known.get((tag, text, kids))
        if form is None:
            bare = (tag, 0, tuple([self.plain[k] for k in kids]))
            plain = self.number(*bare) if bare != (tag, text, kids) else None
            form = self.known[tag, text, kids] = len(self.tag)
            held = [self.texts[k] for k in set(kids)]
            texts = None if None in held or sum(map(len, held)) > 64 else frozenset([text] if text else []).union(*held)
            for column, value in ((self.tag, tag), (self.text, text), (self.kids, kids), (self.plain, form if plain is None else plain), (self.texts, texts)):
                column.append(value)
        return form

    def below(self, form: int) -> list[int]:
        """The form and those below it, kids first."""
        seen, left = {form}, [form]
        while left:
            new = set(self.kids[left.pop()]) - seen
            seen |= new
            left += new
        return sorted(seen)

    def keeping(self, form: int, texts: set[int], done: dict[int, int]) -> int:
        """The form with no other texts than these."""
        if form not in done:
            for f in self.below(form):
                if f not in done:
                    done[f] = self.number(self.tag[f], self.text[f] if self.text[f] in texts else 0, tuple([done[k] for k in self.kids[f]]))
        return done[form]

    def pair(self, x: int, y: int) -> tuple[int, int]:
        """A pair of the same weight: texts count only where both have them."""
        s, t = self.texts[x], self.texts[y]
        return (x, y) if s is None or t is None or not s.isdisjoint(t) else (self.plain[x], self.plain[y])

    def deep(self, x: int, y: int) -> bool:
        return self.tag[x] == self.tag[y] and bool(self.kids[x]) and bool(self.kids[y])

    def weight(self, x: int, y: int, known: dict[tuple[int, int], float]) -> float:
        if self.tag[x] != self.tag[y]:
            return 0
        return known[self.pair(x, y)] if self.kids[x] and self.kids[y] else 1.5 if self.text[x] and self.text[x] == self.text[y] else 1


class _Rows:
    """The kids of two forms, each compared with each. ``needs`` are the pairs whose weights come first."""

    def __init__(self, forms: _Forms, x: int, y: int):
        self.forms, self.xs, self.ys = forms, forms.kids[x], forms.kids[y]
        self.needs = {forms.pair(u, v) for u in set(self.xs) for v in set(self.ys) if forms.deep(u, v)}

    def best(self, known: dict[tuple[int, int], float]) -> float:
        return self._sums(known)[-1][-1]

    def _sums(self, known: dict[tuple[int, int], float]) -> list[list[float]]:
        weights = {u: [self.forms.weight(u, v, known) for v in self.ys] for u in set(self.xs)}
        sums = [[0.0] * (len(self.ys) + 1)]
        for u in self.xs:
            above = sums[-1]
            best = 0.0
            row = [best]
            for j, own in enumerate(weights[u]):
                best = max(above[j + 1], best, above[j] + own)
                row.append(best)
            sums.append(row)
        return sums

    def matches(self, known: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
        """Places of the kids that are paired, the last first."""
        return _traced(self._sums(known), len(self.ys))[0]


def _traced(sums, j: int) -> tuple[list[tuple[int, int]], int]:
    """Pairs (row, place) of the best sum up to place j, and the place that the first row leaves."""
    i, out = len(sums) - 1, []
    while i > 0 and j > 0:
        if sums[i][j] == sums[i - 1][j]:
            i -= 1
        elif sums[i][j] == sums[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out, j


class _WideRows(_Rows):
    """The same for long rows of kids.

    Kids that share a rare text are compared as they are; all others weigh as much as without rare texts, and of those
    forms there are few. Sums are built by rows of numbers; every so many of them one is kept, from which the way back
    is found again.
    """

    def __init__(self, forms: _Forms, x: int, y: int):
        self.forms, self.xs, self.ys = forms, forms.kids[x], forms.kids[y]
        ours, theirs = ({k: {forms.text[f] for f in forms.below(k)} - {0} for k in set(row)} for row in (self.xs, self.ys))
        times, others = (Counter(t for held in side.values() for t in held) for side in (ours, theirs))  # among different forms
        rare = {t for t, n in times.items() if 0 < n * others[t] <= max(len(self.xs), len(self.ys))}
        often, done = set(times) & set(others) - rare, {}
        holders = defaultdict(list)
        for v, held in theirs.items():
            for t in held & rare:
                holders[t].append(v)
        self.alike = {u: {v for t in held & rare for v in holders[t] if forms.tag[v] == forms.tag[u]} for u, held in ours.items()}
        self.lesser = {k: forms.keeping(k, often, done) for k in ours.keys() | theirs.keys()}
        mine, yours = ({self.lesser[k] for k in side} for side in (ours, theirs))
        self.needs = {forms.pair(u, v) for u in mine for v in yours if forms.deep(u, v)}
        self.needs |= {forms.pair(u, v) for u, some in self.alike.items() for v in some if forms.deep(u, v)}
        kinds = sorted(yours)
        place = {v: k for k, v in enumerate(kinds)}
        self.kinds, self.kind_at = kinds, np.array([place[self.lesser[v]] for v in self.ys])
        at = defaultdict(list)
        for j, v in enumerate(self.ys):
            at[v].append(j)
        self.at = {v: np.array(places) for v, places in at.items()}
        self.last: tuple[int, np.ndarray | None] = (-1, None)
        self.own: tuple[int, np.ndarray | None] = (-1, None)

    def _next(self, above: np.ndarray, i: int, known: dict[tuple[int, int], float]) -> np.ndarray:
        """The sums of another row, doubled, as whole numbers."""
        u, forms = self.xs[i], self.forms
        if self.own[0] != u:
            less = self.lesser[u]
            if self.last[0] != less:
                self.last = (less, np.array([2 * forms.weight(less, v, known) for v in self.kinds]).astype(np.int64)[self.kind_at])
            own = self.last[1].copy() if self.alike[u] else self.last[1]
            for v in self.alike[u]:
                own[self.at[v]] = 2 * forms.weight(u, v, known)
            self.own = (u, own)
        row = above.copy()
        np.maximum(row[1:], above[:-1] + self.own[1], out=row[1:])
        return np.maximum.accumulate(row, out=row)

    def _kept(self, known: dict[tuple[int, int], float]) -> tuple[int, list[np.ndarray]]:
        every, kept = math.isqrt(len(self.xs)) + 1, []
        row = np.zeros(len(self.ys) + 1, np.int64)
        for i in range(len(self.xs)):
            if i % every == 0:
                kept.append(row)
            row = self._next(row, i, known)
        return every, kept

    def best(self, known: dict[tuple[int, int], float]) -> float:
        row = np.zeros(len(self.ys) + 1, np.int64)
        for i in range(len(self.xs)):
            row = self._next(row, i, known)
        return float(row[-1]) / 2

    def matches(self, known: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
        every, kept = self._kept(known)
        j, out = len(self.ys), []
        for block in reversed(range(len(kept))):
            sums, lo = [kept[block]], block * every
            for i in range(lo, min(lo + every, len(self.xs))):
                sums.append(self._next(sums[-1], i, known))
            some, j = _traced(sums, j)
            out += [(lo + i, at) for i, at in some]
        return out


def tree_match(a: Bone, b: Bone, found: list[tuple[Bone, Bone]]) -> float:
    """Simple tree matching: the most pairs that keep parents and the order of siblings. Appends them to found.

    Every kid is compared with every kid of the other element, however many there are. A pair of forms is weighed once;
    texts that only one page has make no forms of their own. Long rows of siblings take the square of their length in
    additions, and the memory of its square root of rows.
    """
    if a.tag != b.tag:
        return 0
    forms, of = _Forms(), {}
    pages = [[a], [b]]
    for page in pages:
        for x in page:
            page += x.kids
    shared = {x.text for x in pages[0]} & {y.text for y in pages[1]}
    for page in pages:
        for x in reversed(page):  # kids before parents
            of[id(x)] = forms.number(x.tag, x.text if x.text in shared else 0, tuple([of[id(k)] for k in x.kids]))

    def rows(x: int, y: int) -> _Rows:
        return (_WideRows if len(forms.kids[x]) * len(forms.kids[y]) > 4096 else _Rows)(forms, x, y)

    known: dict[tuple[int, int], float] = {}
    root = forms.pair(of[id(a)], of[id(b)])
    left: list[tuple[tuple[int, int], _Rows | None]] = [(root, None)]
    while left:  # a pair is weighed after all pairs of its kids
        pair, ready = left.pop()
        if pair in known:
            continue
        x, y = pair
        if ready is None:
            ready = rows(x, y)
            left.append((pair, ready))
            left += [(p, None) for p in ready.needs if p not in known]
            continue
        known[pair] = ready.best(known) + (1.5 if forms.text[x] and forms.text[x] == forms.text[y] else 1)
    pairs = [(a, b)]
    while pairs:
        x, y = pairs.pop()
        found.append((x, y))
        if x.kids and y.kids:
            pairs += [(x.kids[i], y.kids[j]) for i, j in rows(*forms.pair(of[id(x)], of[id(y)])).matches(known)]
    return known[root]


HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _aligned(first: list[Bone], page: list[Bone]) -> tuple[set[tuple[int, int]], dict[int, list[int]]]:
    """Path and text of the nodes that are constant on both pages, and for each path of the second [depth, times, varying characters in and below it]."""
    matched: list[tuple[Bone, Bone]] = []
    tree_match(first[0], page[0], matched)
    same = {(x.path, x.text) for x, y in matched if x.text and x.text == y.text and x.path == y.path}
    chars = {id(y): 0 if (y.path, y.text) in same else y.chars for y in page}
    for y in reversed(page):
        if y.above is not None:
            chars[id(y.above)] += chars[id(y)]
    paths: dict[int, list[int]] = {}
    for y in page:
        known = paths.setdefault(y.path, [y.depth, 0, 0])
        known[1] += 1
        known[2] += chars[id(y)]
    return same, paths


def host_templates(pages: DataFrame, group: int = 8, share: float = 0.6, least: int = 3, main_share: float = 0.7) -> DataFrame:
    """(host, nodes, main_slot): the template of each host, as path and text checksums of constant nodes, and the path of its main slot.

    Each page is aligned with the first of its group; a node counts as constant on both if their texts are the same,
    and belongs to the template if it is so on ``share`` of the host's different pages and on ``least`` at least. The
    main slot is the innermost path that ``share`` of the pages have, once a page as a rule, and that holds
    ``main_share`` of the varying characters outside of links; hosts of fewer than ``least`` pages have none. Pages with
    the same skeleton count once. Groups are dealt by a hash of the skeleton, so that no host, however large, comes
    into one task.
    """

    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bones = [skeleton(parse(x or "")) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(bones, pa.binary())], names=["host", "bones"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, members in zip(batch.column("host").to_pylist(), batch.column("members").to_pylist()):
                first, *others = map(rebuilt, sorted(members))
                for k, page in enumerate(others):
                    same, paths = _aligned(first, page)
                    rows += [(host, path, text, 2 if k == 0 else 1, None, None, None) for path, text in same]  # the first page counts once
                    rows += [(host, path, None, 1, *found) for path, found in paths.items()]
            names = ["host", "path", "text", "n", "depth", "times", "chars"]
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)

    bones = stored(pages.select(F.expr(HOST).alias("host"), "html").mapInArrow(cut_down, "host string, bones binary").distinct())
    sizes = stored(bones.groupBy("host").agg(F.count("*").alias("pages")))  # a table of known size, so that Spark can broadcast it where it is small
    dealt = bones.join(sizes, "host").withColumn("part", F.expr(f"pmod(xxhash64(bones), cast(ceil(pages / {group}) as bigint))"))
    groups = dealt.groupBy("host", "part").agg(F.collect_list("bones").alias("members")).filter("size(members) > 1")
    votes = groups.select("host", "members").mapInArrow(align, "host string, path long, text long, n long, depth long, times long, chars long")
    seen = stored(votes.groupBy("host", "path", "text").agg(*[F.sum(c).alias(c) for c in ("n", "times", "chars")], F.min("depth").alias("depth")))
    constant = seen.filter(F.col("text").isNotNull() & (F.col("n") >= least)).join(sizes, "host").filter(F.col("n") >= share * F.col("pages"))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("nodes"))
    slots = seen.filter("text is null")
    whole = slots.filter("depth = 0").select("host", F.col("n").alias("aligned"), F.col("chars").alias("all"))
    slots = slots.join(whole.filter(f"aligned >= {least - 1} and all > 0"), "host")
    slots = slots.filter((F.col("n") >= share * F.col("aligned")) & (F.col("times") <= 1.2 * F.col("n")) & (F.col("chars") >= main_share * F.col("all")))
    slots = slots.groupBy("host").agg(F.max_by("path", F.struct("depth", "path")).alias("main_slot"))
    return stored(constant.join(slots, "host", "full_outer"))


def main_text(page: str, template: set[tuple[int, int]] = frozenset(), main_slot: int | None = None) -> str:
    """Text of the slots that vary and are no boilerplate: those of an article, where there is one with text, else those of the main slot.

    A class or id that names boilerplate may stand around the whole page: a main below counts all the same, and an
    article does where no other article has text.
    """
    whole: list[str] = []
    slot: list[str] = []
    pieces: list[tuple[str, int]] = []  # of main and article elements: texts, and how sure: 3 article, 2 main, 1 article below such words, 0 space
    left: list[tuple[Node | str, int, int, bool, bool]] = [(parse(page), 0, 0, False, False)]
    while left:
        node, path, inside, doubted, slotted = left.pop()
        if isinstance(node, str):
            if not doubted:
                whole.append(node)
            if slotted:
                slot.append(node)
            if node == " " or inside and (inside == 1 or not doubted):
                pieces.append((node, 0 if node == " " else inside))
            continue
        if node.out in (_SURELY, _AS_FORM) or node.tag in _RAW:
            continue
        slotted = slotted or main_slot is not None and path == main_slot
        if node.out == _BY_WORDS:
            if inside in (1, 3):
                continue
            doubted, inside = True, 0
            slotted = main_slot is not None and path == main_slot
        if node.tag == "main":
            inside, doubted = max(inside, 2), False
        elif node.tag == "article":
            inside = 1 if doubted or inside == 1 else 3
        constant = bool(template) and (text := _own_text(node)) != "" and (path, zlib.crc32(text.encode()) | 1) in template
        kids = [(kid, path if isinstance(kid, str) else _key(path, kid.name), inside, doubted, slotted) for kid in node.kids if not (constant and isinstance(kid, str))]
        edge = [(" ", path, inside, doubted, slotted)] if node.tag in _BLOCK else []
        left += edge + kids[::-1] + edge
    least = 2 if any(sure == 3 and x.strip() for x, sure in pieces) else 1
    marked = [x for x, sure in pieces if sure >= least or not sure]
    return next((text for found in (marked, slot, whole) if (text := " ".join(references.unescape("".join(found)).split()))), "")


def extract_text(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row for each row of (page_id, url, html): main text and its length in code points.

    Null and empty html give an empty text; a null or odd url makes a page of the host ''; pages may be of any length,
    depth and width; repeated rows give repeated rows; an empty table gives none; other columns, ``text`` and ``n_chars``
    too, are not read. Templates join by host; their size decides how Spark joins them.
    """
    templates = host_templates(pages) if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                given = zip(*(part.column(c).to_pylist() for c in ("html", "nodes", "main_slot")))
                kept = [main_text(page or "", {(x["path"], x["text"]) for x in nodes or ()}, slot) for page, nodes, slot in given]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(kept, pa.string()), pa.array([len(x) for x in kept], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    wide = pages.select("page_id", "url", "html", F.expr(HOST).alias("host")).join(templates, "host", "left").select("page_id", "url", "html", "nodes", "main_slot")
    return wide.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
