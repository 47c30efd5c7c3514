"""HTML extraction by wrappers: the pages of a host are aligned into one union-free expression of nested tags with
optional and repeated groups and text slots, which says where the main text lies.

Two tags stand for the same place of the expression if they and all around them have the same labels. So the order in
which pages are aligned makes no difference, and each place is a sum over pages: on how many it is (fewer than all: it
is optional), how often at most (more than once: it is a repeated group), how much text it holds, and which texts stand
there on many pages. A text that a place has on most pages is the template's; a varying one is content.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .memory import tidy

#: Fixed values of HTML: elements without content, whose content is no markup, and that don't begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object audio video canvas xmp noembed noframes head".split()) - {"head"}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp nobr".split())
#: Fixed values of HTML: an opening tag ends an open element of these names.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that are never main text, and words in class, id or role that say so.
ASIDE = frozenset("nav header footer aside form menu dialog button select input fieldset".split())
ASIDE_WORDS = re.compile(
    r"(?:^|[-_\s\d])(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|navs?|navbar|navigation|menus?|menubar|breadcrumbs?|crumbs|side-?bars?|footers?|foot|headers?|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|replies|"
    r"cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|pop-up|modals?|overlay|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|sign-?up|login|log-?in|search\w*|pagination|pager|tags?|widgets?|copyright|legal|disclaimer|skip-link|complementary|contentinfo)(?:$|[-_\s\d])"
)
MAIN = ("article", "main")
#: Elements whose words say nothing within an article, as they are its own text.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt".split())
MAIN_WORDS = re.compile(r"(?:^|[-_\s])(?:article|post|entry|story|main|content|body)(?:$|[-_\s\d])")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Pages of a host on which a text must stand to be its template's.
TEMPLATE_PAGES = 3
#: Elements that may be a box of the template within an article; a paragraph or heading is not.
BOXES = frozenset("div section ul ol dl table figure details center".split())
#: Modulus and bases of the hashes of paths and texts.
PRIME, TEXT_BASE, PATH_BASE = (1 << 61) - 1, 0x1B873593CC9E2D51, 0x165667B19E3779F9
#: Places and texts of them that a task holds before it sends them on.
PLACES = 200_000


def labelled(name: str, attributes: str) -> str:
    """The name with its class, id and role; digits in them are all alike."""
    found = sorted({w for m in ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()}) if attributes.strip() else []
    return name + "".join(f".{re.sub('[0-9]+', '0', w)}" for w in found)


def is_aside(label: str, inside: bool) -> bool:
    """Whether an element of this label holds no main text. A header within the article is its own heading."""
    name, *words = label.split(".")
    if name in ASIDE:
        return not (name == "header" and inside)
    if name in ("html", "body", "main") or inside and name in TEXT:
        return False
    return any(ASIDE_WORDS.search(w) for w in words)


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """('open' or 'close', label, inline), ('text', text, False) and ('break', '', False), well nested."""
    stack: list[str] = []
    at, size, opened = 0, len(page), Counter()

    def close(to: int) -> Iterator[tuple[str, str, bool]]:
        while len(stack) > to:
            label = stack.pop()
            name = label.split(".", 1)[0]
            opened[name] -= 1
            yield "close", label, name in INLINE

    while at < size:
        m = TOKEN.search(page, at)
        if (end := m.start() if m else size) > at:
            yield "text", entities.unescape(page[at:end]), False
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].split(".", 1)[0] == name), -1) if opened[name] else -1
            if depth >= 0:
                yield from close(depth)
            elif name in ("p", "br"):
                yield "break", "", False
            continue
        if name in RAW:
            end_tag = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                at = end_tag.end() if end_tag else size
            continue
        if name in VOID:
            yield "break", "", False
            continue
        ended = ENDS.get(name, set()) | ({"p"} if name in BLOCKS_END_P else set())
        if ended:
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                own = stack[i].split(".", 1)[0]
                if own in ended:
                    yield from close(i)
                    break
                if own not in INLINE:
                    break
        label = labelled(name, m[3])
        stack.append(label)
        opened[name] += 1
        yield "open", label, name in INLINE
    yield from close(0)


def long_hash(x: str) -> int:
    """63 bits, as a long that is never negative."""
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1


@lru_cache(100_000)
def label_hash(label: str) -> int:
    return long_hash(label) % PRIME


def rank_of(label: str) -> int | None:
    """How surely an element of this label holds the main text, least first; None if nothing says so."""
    name, *words = label.split(".")
    if name in MAIN:
        return MAIN.index(name) + 3 * any(ASIDE_WORDS.search(w) for w in words)
    return 2 if words and MAIN_WORDS.search(" ".join(words)) else None


def standing(label: str, within: bool) -> tuple[bool, int | None, bool]:
    """Whether an element is aside, its rank if it may be main, and whether what is in it is within an article. An
    article of comments, say, may be main if it is in no other."""
    name, rank, off = label.split(".", 1)[0], rank_of(label), is_aside(label, within)
    if off and rank is not None and rank > 2 and not within:
        off = False
    return off, None if off else rank, not off and name in MAIN


class Walk:
    """One pass over a page's blocks. ``path`` is a hash of all labels from the root; ``close`` tells of each element
    its path, label, the hash of all text inside, its length, whether it is in an element that may be main, and where
    its blocks begin."""

    __slots__ = ("length", "path", "stack", "text", "times")

    def __init__(self):
        self.stack: list[tuple] = []
        self.path, self.text, self.times, self.length = 0, 0, 1, 0

    def open(self, label: str, *more) -> None:
        self.stack.append((self.path, self.text, self.times, self.length, label, more))
        self.path = (self.path * PATH_BASE + label_hash(label) + 1) % PRIME
        self.text, self.times, self.length = 0, 1, 0

    def say(self, value: str) -> None:
        if value := " ".join(value.split()):
            self.text = (self.text * TEXT_BASE + long_hash(value)) % PRIME
            self.times = self.times * TEXT_BASE % PRIME
            self.length += len(value)

    def close(self) -> tuple[int, str, int, int, tuple]:
        path, text, times, length = self.path, self.text, self.times, self.length
        self.path, before, times_before, length_before, label, more = self.stack.pop()
        self.text, self.times, self.length = (before * times + text) % PRIME, times_before * times % PRIME, length_before + length
        return path, label, text, length, more


def places(page: str) -> dict[int, list]:
    """The places of a page by path: how often each stands there, its texts with their lengths, its length, the rank of its label,
    and whether it is inside an element that may be main and whether it may be a box there. Nothing aside counts."""
    walk, out, aside, within, flags = Walk(), {}, 0, 0, []
    for kind, value, inline in events(page):
        if kind == "text":
            if not aside:
                walk.say(value)
        elif kind == "open":
            off, rank, main = standing(value, within > 0)
            flags.append((off, main))
            if not inline:
                walk.open(value, rank, within > 0)
            aside += off
            within += main
        elif kind == "close":
            off, main = flags.pop()
            aside -= off
            within -= main
            if inline:
                continue
            path, label, text, length, (rank, inside) = walk.close()
            if off or aside or not length:
                continue
            box = label.split(".", 1)[0] in BOXES
            place = out.setdefault(path, [0, {}, 0, rank, inside, box])
            place[0] += 1
            place[2] += length
            if box or not inside:  # else no text of it counts
                place[1][text] = length
    out[0] = [1, {}, walk.length, None, False, False]
    return out


class Place:
    """A place of a wrapper over some pages: how many have it, how many once, how often at most, its text's length, and
    counts of all texts that stand there, with the least and greatest hash of their pages."""

    __slots__ = ("box", "length", "most", "once", "pages", "rank", "texts", "within")

    def __init__(self, rank, within, box):
        self.pages = self.once = self.most = self.length = 0
        self.rank, self.within, self.box = rank, within, box
        self.texts: dict[int, list] = {}

    def add(self, times: int, texts: dict[int, int], length: int, content: int) -> None:
        self.pages += 1
        self.once += times == 1
        self.most = max(self.most, times)
        self.length += length
        for text, size in texts.items():
            if text in self.texts:
                t = self.texts[text]
                t[0] += 1
                t[1], t[2] = min(t[1], content), max(t[2], content)
            else:
                self.texts[text] = [1, content, content, size]


def wrapper(pages: Iterable[str]) -> dict[int, Place]:
    """The wrapper of some pages by path; equal pages count once."""
    out: dict[int, Place] = {}
    seen = set()
    for page in pages:
        content = long_hash(page)
        if content not in seen:
            seen.add(content)
            aligned(out, page, content)
    return out


def aligned(into: dict[int, Place], page: str, content: int) -> int:
    """Aligns a page with a wrapper: what both have is matched by path, the rest becomes optional. How many places and
    texts the page has."""
    held = 0
    for path, (times, texts, length, *about) in places(page).items():
        if path not in into:
            into[path] = Place(*about)
        into[path].add(times, texts, length, content)
        held += 1 + len(texts)
    return held


PLACE = "host string, path bigint, pages bigint, once bigint, most bigint, length bigint, rank int, within boolean, box boolean, texts array<struct<text:bigint,pages:bigint,lo:bigint,hi:bigint,length:bigint>>"


@tidy
def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the wrappers of a task's pages, host by host."""
    hosts: dict[str, dict[int, Place]] = {}
    seen: set[tuple[str, int]] = set()
    held = 0
    texts = pa.list_(pa.struct([(n, pa.int64()) for n in ("text", "pages", "lo", "hi", "length")]))
    kinds = (pa.string(), *[pa.int64()] * 5, pa.int32(), pa.bool_(), pa.bool_(), texts)

    def batch() -> pa.RecordBatch:
        rows = [
            (host, path, x.pages, x.once, x.most, x.length, x.rank, x.within, x.box, [dict(zip(("text", "pages", "lo", "hi", "length"), (k, *t))) for k, t in x.texts.items()])
            for host, found in hosts.items()
            for path, x in found.items()
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PLACE.split(", ")])

    for b in batches:
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            content = long_hash(page)
            if (host, content) not in seen:
                seen.add((host, content))
                held += aligned(hosts.setdefault(host, {}), page, content)
                if held > PLACES:
                    yield batch()
                    hosts, held = {}, 0
    if hosts:
        yield batch()


def decisions(found: DataFrame) -> DataFrame:
    """``host, main, template`` of each host from the places of its pages: the paths of its main regions, and the paths
    and texts of its template.

    Main are the places of the best rank that hold text. A text is the template's if, outside main regions, it is that
    of a place on more than half of the host's pages, or, inside, that of a box on each page which has a
    box there; on ``TEMPLATE_PAGES`` pages at least, not all equal, and if it isn't half of all their text:
    then the pages are copies of each other. Equal pages count once a task, and pages that are all equal show nothing.
    """
    place = found.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("pages", "once", "length")), *(F.first(c).alias(c) for c in ("rank", "within", "box")))
    text = found.select("host", "path", F.explode("texts").alias("t")).groupBy("host", "path", "t.text").agg(F.sum("t.pages").alias("same"), F.min("t.lo").alias("lo"), F.max("t.hi").alias("hi"), F.max("t.length").alias("size"))
    whole = place.filter("path = 0").select("host", F.col("pages").alias("all_pages"), (F.col("length") / F.col("pages")).alias("usual"))
    best = place.filter("rank is not null and not within and length > 0").groupBy("host", "rank").agg(F.sort_array(F.collect_list("path")).alias("main")).groupBy("host").agg(F.min(F.struct("rank", "main")).alias("x")).select("host", "x.main")
    told = text.filter(F.col("same") >= TEMPLATE_PAGES).filter("lo <> hi and path <> 0").join(place.filter("rank is null"), ["host", "path"]).join(whole, "host").filter("2 * size <= usual")
    told = told.filter((~F.col("within") & (2 * F.col("same") > F.col("all_pages"))) | (F.col("within") & F.col("box") & (F.col("same") == F.col("pages"))))
    drop = told.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("template"))
    return best.join(drop, "host", "full_outer").select("host", "main", "template")


def main_text(page: str, main: frozenset[int], template: frozenset[tuple[int, int]]) -> str:
    """The main text of a page: the blocks in its host's main regions or, if it has none of these, all blocks that
    aren't aside; without those of its host's template, unless nothing else is left."""
    walk, aside, inside, within, parts = Walk(), 0, 0, 0, []
    everywhere: list[tuple[str, bool]] = []
    kept: list[tuple[str, bool]] = []
    flags: list[tuple[bool, bool, bool]] = []
    seen_main = False

    def flush() -> None:
        if parts:
            if block := " ".join("".join(parts).split()):
                kept.append((block, inside > 0))
                everywhere.append((block, inside > 0))
            parts.clear()

    for kind, value, inline in events(page):
        if kind == "text":
            if not aside:
                parts.append(value)
                walk.say(value)
        elif kind == "break":
            parts.append(" ")
        elif kind == "open":
            off, rank, article = standing(value, within > 0)
            here = False
            if not inline:
                flush()
                walk.open(value, len(kept))
                here = not off and not aside and walk.path in main
                off = off or rank is not None and rank > 2 and not here
            flags.append((off, here, article))
            aside += off
            inside += here
            within += article
            seen_main = seen_main or here
        else:
            if not inline:
                flush()
            off, here, article = flags.pop()
            aside -= off
            inside -= here
            within -= article
            if not inline:
                path, _, text, _, (begin,) = walk.close()
                if (path, text) in template:
                    del kept[begin:]
    flush()
    for blocks in (kept, everywhere):
        if out := " ".join(block for block, main_ in blocks if main_ or not seen_main):
            return out
    return ""


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read: dict[str, tuple] = {}
    for b in batches:
        out = []
        for host, page, main, template in zip(*(b.column(c).to_pylist() for c in ("host", "html", "main", "template"))):
            if host not in read:
                if len(read) > 1000:
                    read.clear()
                read[host] = frozenset(main or ()), frozenset((t["path"], t["text"]) for t in template or ())
            out.append(main_text(page, *read[host]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (page_id, url, html).

    Each task aligns the pages it has of a host, and the places are summed per host, so all pages shape the wrapper and
    a host of many pages sends a few small rows for each task. Each page's blocks in the wrapper's main regions are
    joined, without what the wrapper shows to be the template's. Pages of a host whose wrapper has no such region, and
    pages that lack it, give all blocks that lie in no menu, header, footer, sidebar, notice, advert, form or comments.

    Null or empty html: an empty text. Null url: pages without url count as one host. Repeated rows: a row each. No
    rows: no rows. Broken markup is closed at the end of the page. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = written(own.select("host", "html").mapInArrow(_induce, PLACE), "places")
    told = written(decisions(found), "wrappers")
    return own.join(told, "host", "left").select("page_id", "url", "host", "html", "main", "template").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
