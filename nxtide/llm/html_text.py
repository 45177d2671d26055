"""Main text of web pages by consensus of a host's pages on the paths of its containers."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nxtide.llm.common import free_names, join_spread, save, text_of, without

#: Bytes of all hosts' winning paths up to which each task is sent them; beyond, pages and paths meet by a shuffle.
SEND_BYTES = 32 << 20
#: A path wins with at least this share of its host's votes, so that a host has few of them.
WINS = 0.1
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
PLAIN_END = re.compile(r"\s*+/?>")
NAME = re.compile(r"[\s/]*+([^\s/>=]*+)\s*+(=?)\s*+")
BARE = re.compile(r"[^\s>]++")
#: Their content is no markup.
RAW = {t: re.compile(rf"</{t}(?![a-z0-9])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
#: An open element of these is ended by one of those that begins, unless one of the last is open within it.
ENDED = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",))}
TABLE = frozenset("table thead tbody tfoot tr td th body html".split())
#: Left out with all that they hold, whatever they are called; a header only where it is not within an article or main.
OUTSIDE = frozenset("nav footer aside button select menu dialog template noscript svg object audio video canvas datalist".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog menu menubar".split())
#: Words of classes and ids that name what is no article, and words that may stand beside them in such a name.
NOISE = frozenset("ad ads advert adverts advertisement adsbygoogle banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu breadcrumb breadcrumbs masthead sidebar widget related share sharing social cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal login signup search footer pagination pager comment comments disqus replies respond".split())
BESIDE = frozenset("top bottom left right main site page primary secondary global mobile box bar block list area section container wrapper wrap inner outer slot unit link links button buttons icon icons post posts article articles stories entry entries form policy google sticky header thread the".split())
REPLIES = frozenset("comment comments disqus replies respond".split())
#: Names of a site's top; not with a heading outside links, as an article's own top is called that too.
TOPS = frozenset("header site-header top-header topbar".split())
#: Shares of a page's text outside links: what is named as noise is left out with up to MOST of it, replies and what is apart from
#: an article or main with up to NEARLY_ALL; where what stays has less than LITTLE, names don't decide.
MOST, NEARLY_ALL, LITTLE = 0.5, 0.9, 0.1
#: A container stands for the one around it with this share of its text, an article or main beside other things with the lesser one.
HOLDS, SAID = 0.75, 0.5
#: A host's path is this page's with this share of the text of the page's own choice; an article or main with the lesser one.
AGREES, SAID_AGREES = 0.5, 0.05
LONG_NAME = 160


def _short(name: str) -> str:
    """A long name's hash in its place, so that paths of deep trees stay short."""
    return name if len(name) <= LONG_NAME else "~" + hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=12).hexdigest()


def _names_noise(names: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names noise, readers' replies, or a site's top: a word of NOISE alone, or among words of BESIDE only."""
    noise = replies = top = False
    for name in names.split():
        parts = re.split(r"[-_]+", name.lower().strip("-_"))
        if any(p in NOISE for p in parts) and all(p in NOISE or p in BESIDE or p.isdigit() for p in parts):
            noise = True
            replies = replies or any(p in REPLIES for p in parts)
        top = top or name.lower() in TOPS
    return noise, replies, top


class Page:
    """A page read in one pass: blocks of text, the tree of their containers, and the elements that may be left out.

    Markup is read as browsers do: an unclosed quote, comment or script goes on to the end. The
    work is in proportion to the page's length, whatever its nesting: containers and elements that
    may be left out are numbered, each with the one around it, and nothing is looked for in a stack.
    """

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, str]] = [(-1, "", "")]  # containers from the page itself on: the one around, path, tag
        self._outs: list[tuple[int, str, bool]] = [(-1, "", False)]  # elements that may be left out: the one around, why, whether in an article or main
        self._read: list[tuple[list[tuple[str, bool, int]], int, bool]] = []  # blocks: parts (text, linked, element), container, heading
        self._parts: list[tuple[str, bool, int]] = []
        self._stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]  # tag, container, element that may be left out, in an article or main, heading
        self._open: dict[str, list[int]] = {}  # places of open elements in the stack
        self._link = -1  # the stack's length where a link was opened
        self._scan(source)
        self._flush()
        kept = self._kept()
        self.blocks: list[tuple[str, int, int]] = []  # text, container, worth: its length less twice that of its links
        self._headed: set[int] = set()
        for parts, node, heading in self._read:
            own = [p for p in parts if kept[p[2]]]
            text = " ".join("".join(t for t, _, _ in own).split())
            if text:
                self.blocks.append((text, node, max(0, len(text) - 2 * sum(len(t) for t, linked, _ in own if linked))))
                if heading and self.blocks[-1][2]:
                    self._headed.add(node)
        self._worth = [0] * len(self.nodes)
        for _, node, worth in self.blocks:
            self._worth[node] += worth
        for node in range(len(self.nodes) - 1, 0, -1):
            self._worth[self.nodes[node][0]] += self._worth[node]
        self.best = self._best()

    def _scan(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            less = source.find("<", at)
            if less < 0:
                self._text(source[at:])
                return
            tag = TAG.match(source, less)
            if not tag:
                if source.startswith(("<!", "<?", "</"), less):
                    self._text(source[at:less])
                    close = source.find("-->", less + 2) if source.startswith("<!--", less) else source.find(">", less)
                    at = end if close < 0 else close + (3 if source.startswith("<!--", less) else 1)
                else:
                    self._text(source[at : less + 1])
                    at = less + 1
                continue
            self._text(source[at:less])
            name = tag[1].lower()
            plain = PLAIN_END.match(source, tag.end())
            held, at = ({}, plain.end()) if plain else _attributes(source, tag.end())
            if at < 0:
                return
            if source[less + 1] == "/":
                self._close(name)
            elif name in RAW:
                close = RAW[name].search(source, at)
                at = close.start() if close else end
            else:
                self._start(name, held)

    def _text(self, text: str) -> None:
        if text:
            self._parts.append((entities.unescape(text) if "&" in text else text, self._link >= 0, self._stack[-1][2]))

    def _flush(self) -> None:
        if any(not text.isspace() for text, _, _ in self._parts):
            self._read.append((self._parts, self._stack[-1][1], self._stack[-1][4]))
        self._parts = []

    def _last(self, tag: str) -> int:
        places = self._open.get(tag)
        return places[-1] if places else 0

    def _cut(self, length: int) -> None:
        for tag, *_ in self._stack[length:]:
            self._open[tag].pop()
        del self._stack[length:]
        if self._link >= length:
            self._link = -1

    def _start(self, tag: str, held: dict[str, str]) -> None:
        if tag == "br":
            self._parts.append((" ", False, self._stack[-1][2]))
        if tag == "a":
            self._link = len(self._stack) if "href" in held else -1
        if tag in BLOCKS:
            self._flush()
            if p := self._last("p"):  # a block ends an open paragraph
                self._cut(p)
            elif tag in ENDED:
                ended, within = ENDED[tag]
                places = [k for t in ended if (k := self._last(t)) > max(map(self._last, within))]
                if places:
                    self._cut(min(places))
        if tag in VOID:
            return
        _, node, out, main, heading = self._stack[-1]
        why = ""
        if held:
            names = f"{held.get('class', '')} {held.get('id', '')}"
            noise, replies, top = _names_noise(names) if names != " " else (False, False, False)
            if "hidden" in held or held.get("role", "").lower() in ROLES or "display:none" in held.get("style", "").replace(" ", "").lower():
                why = "tag"
            elif replies and tag in BLOCKS:
                why = "replies"
            elif tag not in HEADINGS and tag not in ("body", "html", "article", "main", "p") and (noise or top and not main):
                why = "name" if noise else "top"
        if tag in OUTSIDE or tag == "header" and not main:
            why = "tag"
        elif tag == "form" and not why:
            why = "form"
        if tag not in BLOCKS and not why:
            return  # what is inline matters only if it may be left out
        if why:
            self._outs.append((out, why, main))
            out = len(self._outs) - 1
        if tag in CONTAINERS:
            kind = ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in held.get("class", "").lower().split())])
            self.nodes.append((node, _short(f"{self.nodes[node][1]}/{_short(kind)}"), tag))
            node = len(self.nodes) - 1
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, node, out, main or tag in ("article", "main"), heading or tag in HEADINGS))

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._link = -1
        place = self._last(tag)
        if tag in BLOCKS or 0 < place < len(self._stack) - 1:
            self._flush()
        if place and (tag in TABLE or place > max(self._last("td"), self._last("th"))):  # a cell's end tags don't reach beyond it
            self._cut(place)

    def _kept(self) -> list[bool]:
        """For each element that may be left out whether it stays, by its share of the page's text outside links."""
        held, headed, marked = [0] * len(self._outs), [False] * len(self._outs), False
        said = self._said()
        for parts, node, heading in self._read:
            for text, linked, out in parts:
                n = 0 if linked else len(text.strip())
                held[out] += n
                headed[out] = headed[out] or bool(n and heading)
                marked = marked or bool(n and not out and said[node])  # the page says itself where its text is
        for i in range(len(held) - 1, 0, -1):
            held[self._outs[i][0]] += held[i]
            headed[self._outs[i][0]] = headed[self._outs[i][0]] or headed[i]
        total, own = held[0], [True] * len(held)
        apart = [why == "replies" or why == "name" and marked and not main for _, why, main in self._outs]
        for i, (_, why, _) in enumerate(self._outs[1:], 1):
            own[i] = why == "top" and headed[i] or held[i] > (max(0, total - 1) if why == "tag" else total * (NEARLY_ALL if apart[i] else MOST))
        kept = self._inherited(own)
        stays = sum(len(t.strip()) for parts, _, _ in self._read for t, linked, out in parts if not linked and kept[out])
        if stays < LITTLE * total:
            kept = self._inherited([k or why in ("name", "top", "form") and not apart[i] for i, (k, (_, why, _)) in enumerate(zip(own, self._outs))])
        return kept

    def _inherited(self, own: list[bool]) -> list[bool]:
        for i in range(1, len(own)):
            own[i] = own[i] and own[self._outs[i][0]]
        return own

    def _said(self) -> list[bool]:
        """For each container whether it is within an article or main."""
        out = [False]
        for around, _, tag in self.nodes[1:]:
            out.append(tag in ("article", "main") or out[around])
        return out

    def _best(self) -> int:
        """The lowest container that holds most of the page's text: from the page on down, as long as one holds most of another.

        Nothing below an article is chosen, nor below a main but an article, nor below what has a heading of its own.
        """
        largest: dict[int, int] = {}
        for node in range(1, len(self.nodes)):
            around = self.nodes[node][0]
            if self._worth[node] > self._worth[largest.get(around, 0)] or around not in largest:
                largest[around] = node
        node = 0
        while (child := largest.get(node)) is not None and self._worth[child]:
            tag, inner = self.nodes[node][2], self.nodes[child][2]
            said = inner in ("article", "main") and tag != "main"
            if tag == "article" or tag == "main" and inner != "article" or tag not in ("", "body") and node in self._headed:
                break
            if self._worth[child] < (SAID if said else HOLDS) * self._worth[node]:
                break
            node = child
        return node

    def vote(self) -> str | None:
        """The path of the page's own choice; None for a page without text outside links."""
        return self.nodes[self.best][1] if self._worth[0] else None

    def _within(self, path: str) -> tuple[list[tuple[str, int, int]], int, bool]:
        """The blocks within containers of that path, each widened to the article or main around it; their worth; whether there is such a one."""
        chosen, said = [False] * len(self.nodes), False
        around = [0] * len(self.nodes)  # the innermost article or main
        for i, (up, own, tag) in enumerate(self.nodes[1:], 1):
            around[i] = i if tag in ("article", "main") else around[up]
            if own == path:
                chosen[around[i] or i] = True
                said = said or around[i] > 0
        for i, (up, _, _) in enumerate(self.nodes[1:], 1):
            chosen[i] = chosen[i] or chosen[up]
        found = [b for b in self.blocks if chosen[b[1]]]
        return found, sum(b[2] for b in found), said

    def main_text(self, paths: list[str] | str | None = None) -> str:
        """The text within the first of its host's paths that this page has enough of; else within its own choice."""
        inside = [False] * len(self.nodes)
        inside[self.best] = True
        for i in range(self.best + 1, len(self.nodes)):
            inside[i] = inside[self.nodes[i][0]]
        blocks = [b for b in self.blocks if inside[b[1]]]
        for path in [paths] if isinstance(paths, str) else paths if paths is not None else []:
            found, worth, said = self._within(path)
            if worth and worth >= (SAID_AGREES if said else AGREES) * self._worth[self.best]:
                blocks = found
                break
        return "\n\n".join(text for text, _, _ in blocks)


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag and the place behind it, or -1 if it goes on to the end of the page."""
    held: dict[str, str] = {}
    while True:
        m = NAME.match(source, at)
        at = m.end()
        c = source[at : at + 1]
        value = ""
        if m[2] and c and c in "\"'":
            close = source.find(c, at + 1)
            if close < 0:
                return held, -1
            value, at = source[at + 1 : close], close + 1
        elif m[2] and c and c != ">":
            value = BARE.match(source, at)[0]
            at += len(value)
        if m[1]:
            held.setdefault(m[1].lower(), value)
        if at >= len(source):
            return held, -1
        if source[at] == ">":
            return held, at + 1


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, pages, paths): for each host the paths with at least WINS of its pages' votes, most votes first (ties: in order).

    Each page with text votes once, for the path of the container that it would choose alone; a
    path is made of tags and classes, with # for digits. Votes are summed before they are shuffled.
    """

    @F.pandas_udf("string")
    def votes(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in frames:
            yield pd.Series([Page(source).vote() for source in column], dtype=object)

    cast = pages.select(host_of(F.col("url")).alias("host"), votes(text_of(F.col("html"))).alias("path"))
    counted = save(cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")))
    hosts = counted.groupBy("host").agg(F.sum("votes").alias("pages"))
    won = counted.filter("path is not null").join(hosts, "host").filter(F.col("votes") >= WINS * F.col("pages"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path")))
    return hosts.join(won.groupBy("host").agg(ranked.alias("won")), "host", "left").select("host", "pages", F.col("won.path").alias("paths"))


def main_texts(pages: DataFrame, send_bytes: int = SEND_BYTES) -> DataFrame:
    """pages (page_id, url, html) with `text`, their main text: blocks in order, joined by two line feeds.

    The pages of a host vote for paths (winning_paths); then each page is read again, and its text
    is what is within the first winning path that it has enough of, or else within its own choice.
    If all winning paths are small by their counted size, each task gets them and pages stay where
    they are; else they meet by a shuffle, in which a large host's pages are dealt among copies of
    its paths.

    Null or empty html has no text; a null url, or one without a host, belongs to the empty host.
    Repeated rows are rows each, and vote each. Ties between paths go to the first in order. An empty
    table stays empty. A column `text` of pages is replaced; other columns stay as they are.
    """
    host, paths, count = free_names(pages, "host", "paths", "pages")
    winners = save(winning_paths(pages)).select(F.col("host").alias(host), F.col("paths").alias(paths), F.col("pages").alias(count))
    size = winners.agg(F.sum(F.length(host) + F.coalesce(F.length(F.array_join(paths, "")), F.lit(0)) + 64)).first()[0] or 0
    own = pages.withColumn(host, host_of(F.col("url")))
    if size <= send_bytes:
        joined = own.join(F.broadcast(winners), host, "left")
    else:
        joined = join_spread(own, winners, [host], count, ["page_id", "url"], "left")

    @F.pandas_udf("string")
    def extracted(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, ways in frames:
            yield pd.Series([Page(s).main_text(w) for s, w in zip(sources, ways)], dtype=object)

    return joined.select(*without(pages, "text"), extracted(text_of(F.col("html")), F.col(paths)).alias("text"))
