"""Main-text extraction by consensus paths of a host.

First pass: every page is parsed, its containers are scored (each block of text gives points to its parent and half of them
to its grandparent, less the share of link text), and the best container's generalised tag-class path (digits of a class as
0), as a 64-bit hash, is the page's vote. Spark counts the votes per host. Second pass: each page is extracted from the
elements at its host's winning path; a page without text there is extracted from its own best container.

An element is left out by its tag (nav, footer, form, ...), or by a class or id made only of words for such parts, or naming
comments, adverts or cookies. A name that holds such a word among others (``search-results``) leaves its element out unless that holds most
of the page's text and few links; one that tells about the layout (``has-sidebar``, ``no-comments``) does nothing.

A page takes memory in proportion to its length: an element keeps its parent and a hash of its path. Pages meet their host's
path in a join by host; where the paths are too many to broadcast, a large host is split by the adaptive skew join.

Defined results: null or empty html, or a page without text, gives an empty text; hosts are compared lower-cased, a null url
is a host of its own; ties of votes go to more text, then to the smaller path hash; whole pages are parsed, unclosed
or stray tags included; repeated rows are treated alike; other columns, whatever their names, are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import _core as C
from tabloom.llm.url_markov import host

#: Fixed values of HTML: elements without content, without text of their own, blocks, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html option legend summary caption td th tr tbody thead tfoot li dd dt".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr td th", ("table",)), "option": ("option", ("select",))}
#: Elements and class or id words that are not part of an article.
ASIDE_TAGS = frozenset("nav header footer aside form button select menu dialog head input label".split())
ASIDE_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist respond disqus cookie cookies consent footer foot header masthead menu nav navbar navigation newsletter notice notices alert popup modal overlay promo promotion related recommended recommendations share sharing social sidebar sponsor sponsored subscribe toolbar widget pagination pager login signup search".split())
#: Of these words, any piece of a name tells; the others may be about the layout. Words that say a name does so.
ALWAYS = frozenset("ad ads adv advert advertisement advertising comment comments commentlist respond disqus cookie cookies consent".split())
LAYOUT = frozenset("has no with without is not show hide".split())
INLINE = frozenset("p span b i em strong a h1 h2 h3 h4 h5 h6 li td th pre code font u small sub sup math object".split())
HOLDERS = frozenset("article body div main section td table blockquote center ul ol dl p span figure li tbody tr".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: Where a raw element ends, looked for in the page itself: lower-casing a copy moves offsets (U+0130 becomes two characters).
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
_LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=50_000)
def names(value: str) -> tuple[int, str]:
    """(2: names a part that is left out, 1: may do so, 0: does not; the generalised classes) of a class or id."""
    found = 0
    for token in value.split():
        pieces = re.findall(r"[a-z]+", token)
        some = [x in ASIDE_WORDS for x in pieces]
        if not any(some) or pieces[0] in LAYOUT:
            continue
        found = max(found, 2 if all(some) or not ALWAYS.isdisjoint(pieces) else 1)
    return found, ".".join(sorted(re.sub(r"[0-9]+", "0", value).split()))


@lru_cache(maxsize=200_000)
def below(path: int, token: str) -> int:
    """The hash of a path with one more element."""
    return int.from_bytes(blake2b(f"{path}>{token}".encode(), digest_size=8).digest(), "little", signed=True)


class Page:
    """Elements in page order (parent, tag, path, left out, in a link) and runs of text with the block each stands in."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.token, self.path, self.out, self.link = [-1], ["#"], [""], [0], [False], [False]
        self.hold, self.weak, self.maybe = [0], [0], {0: 0}  # element that can hold blocks; nearest doubtful one; its own outer one
        self.runs: list[tuple[int, int, str]] = []  # (element, block number, text)
        self.block = 0
        self.opened: dict[str, int] = {}
        stack = [0]
        at, n = 0, len(html)
        while at < n:
            i = html.find("<", at)
            if i < 0:
                i = n
            if i > at:
                self.runs.append((stack[-1], self.block, html[at:i]))
            if i == n:
                break
            m = _TAG.match(html, i) or _LOOSE.match(html, i)
            if m is None:
                self.runs.append((stack[-1], self.block, "<"))
                at = i + 1
                continue
            at = m.end()
            if m.lastindex is None or m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    self.block += 1
                self.close(stack, (tag,), ())
                continue
            if tag in BLOCK:
                self.block += 1
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                close = html.find(">", end.start()) if end else -1
                at = n if close < 0 else close + 1
                continue
            if tag in CLOSES_P:
                self.close(stack, ("p",), HOLDERS - {"p", "span"})
            if tag in SIBLINGS:
                names, bounds = SIBLINGS[tag]
                self.close(stack, names.split(), bounds)
            if tag in VOID:
                continue
            self.open(stack, tag, m[3])
            if m[3].endswith("/") and tag not in BLOCK:
                self.cut(stack, len(stack) - 1)
        self.last = list(range(len(self.parent)))  # the last element inside each one
        for e in range(len(self.parent) - 1, 0, -1):
            up = self.parent[e]
            self.last[up] = max(self.last[up], self.last[e])
        self.settle_doubts()

    def cut(self, stack: list[int], d: int) -> None:
        for e in stack[d:]:
            self.opened[self.tag[e]] -= 1
        del stack[d:]

    def close(self, stack: list[int], names, bounds) -> None:
        """Close the innermost open element of those names, unless one of the bounds comes first."""
        if not any(self.opened.get(t) for t in names):
            return
        for d in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[d]]
            if t in names:
                self.cut(stack, d)
                return
            if t in bounds:
                return

    def open(self, stack: list[int], tag: str, attributes: str) -> None:
        up, e = stack[-1], len(self.tag)
        classes, doubt = "", 2 * (tag in ASIDE_TAGS)
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
                told, general = globals()["names"](value)
                if name == "class":
                    classes = general
                if name == "hidden":
                    doubt = 2
                elif tag not in ("html", "body", "main", "article"):
                    doubt = max(doubt, told)
        token = f"{tag}.{classes}" if classes else tag
        self.parent.append(up)
        self.tag.append(tag)
        self.token.append(token)
        self.path.append(below(self.path[up], token) if tag != "html" else self.path[up])
        self.out.append(self.out[up] or doubt == 2)
        self.link.append(self.link[up] or tag == "a")
        self.hold.append(self.hold[up] if tag in INLINE else e)
        if doubt == 1:
            self.maybe[e] = self.weak[up]
        self.weak.append(e if doubt == 1 else self.weak[up])
        self.opened[tag] = self.opened.get(tag, 0) + 1
        stack.append(e)

    def settle_doubts(self) -> None:
        """Leave out the elements with a doubtful name, but for those with most of the text and few links."""
        if len(self.maybe) == 1:
            return
        size, linked = dict.fromkeys(self.maybe, 0), dict.fromkeys(self.maybe, 0)
        for e, _, t in self.runs:
            if not self.out[e]:
                n = len(t.strip())
                size[self.weak[e]] += n
                linked[self.weak[e]] += n * self.link[e]
        for e in sorted(self.maybe, reverse=True):  # an inner one comes after its outer one
            if e:
                size[self.maybe[e]] += size[e]
                linked[self.maybe[e]] += linked[e]
        gone = {0: False}
        for e in sorted(self.maybe):
            if e:
                gone[e] = gone[self.maybe[e]] or not (2 * size[e] > size[0] and 10 * linked[e] < 3 * size[e])
        for e in range(1, len(self.out)):
            self.out[e] = self.out[e] or gone[self.weak[e]]

    def path_of(self, e: int) -> str:
        parts = []
        while e > 0:
            if self.tag[e] != "html":
                parts.append(self.token[e])
            e = self.parent[e]
        return "".join(f">{t}" for t in reversed(parts))

    def blocks(self) -> list[tuple[int, str, float]]:
        """(element, text, share of link text) of every block that is not left out, in page order."""
        out, parts, now, element, linked, solid = [], [], None, 0, 0, False

        def flush() -> None:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((element, text, linked / max(1, sum(map(len, parts)))))

        for e, b, t in self.runs:
            if self.out[e]:
                continue
            if b != now:
                flush()
                parts, now, element, linked, solid = [], b, e, 0, False
            elif not solid:
                element = e
            elif element != e and t.strip():
                element = self.common(element, e)
            solid = solid or bool(t.strip())
            parts.append(t)
            linked += len(t) * self.link[e]
        flush()
        return out

    def common(self, a: int, b: int) -> int:
        while not a <= b <= self.last[a]:
            a = self.parent[a]
        return a

    def best(self) -> tuple[int, int, int]:
        """(element, hash of its path, characters) of the container with the highest score; element -1 where there is no text."""
        points: dict[int, float] = {}
        size: dict[int, int] = {}
        for e, text, linked in self.blocks():
            p = (1 + min(len(text) / 100, 3) + text.count(",") * 0.1) * (1 - linked)
            h = self.hold[e]
            size[h] = size.get(h, 0) + len(text)
            for weight in (1.0, 0.5):
                points[h] = points.get(h, 0.0) + weight * p * (1.25 if self.tag[h] in ("article", "main") else 1.0)
                if h <= 0:
                    break
                h = self.parent[h]
        if not points:
            return -1, 0, 0
        e = max(points, key=lambda k: (points[k], -k))
        return e, self.path[e], size.get(e, 0)

    def text(self, path: int | None) -> str:
        """The blocks inside all elements at that path, or inside the page's own best container."""
        blocks = self.blocks()
        if path is not None:
            roots = {i for i, p in enumerate(self.path) if p == path}
            found = self.inside(blocks, roots)
            if found:
                return found
        e = self.best()[0]
        return self.inside(blocks, {e}) if e >= 0 else ""

    def inside(self, blocks: list[tuple[int, str, float]], roots: set[int]) -> str:
        known: dict[int, bool] = {}

        def under(e: int) -> bool:
            chain = []
            while e >= 0 and e not in known and e not in roots:
                chain.append(e)
                e = self.parent[e]
            ok = e >= 0 and (e in roots or known.get(e, False))
            for c in chain:
                known[c] = ok
            return ok

        return "\n".join(t for e, t, _ in blocks if under(e)) if roots else ""


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        best = [Page(h).best() for h in (x.as_py() or "" for x in b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p if e >= 0 else None for e, p, _ in best], pa.int64()), pa.array([n for _, _, n in best], pa.int64())], names=["host", "path", "chars"])


def winners(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the hash of the path with most votes of each host."""
    votes = pages.select(F.coalesce(host(F.col(url)), F.lit("")).alias("host"), F.col(html).alias("html")).mapInArrow(vote, "host string, path long, chars long")
    counted = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    # the smallest of (-votes, -chars, path) is the winner
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), "path")).alias("w")).select("host", F.col("w.path").alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    C.arrow_limits(pages.sparkSession)
    chosen = C.settle(winners(pages, url, html), "host-paths")
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h.as_py() or "").text(p.as_py()) for h, p in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), F.coalesce(host(F.col(url)), F.lit("")).alias("host")).join(chosen, "host", "left")
    return named.select("key", "url", "html", "path").mapInArrow(read, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
