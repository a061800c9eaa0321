"""Main text of web pages, by markup and by what a host repeats.

A page is cut into blocks at block-level tags. Markup decides where it can: blocks
in menus, headers, footers, sidebars, notices, adverts, forms and comments go, and
blocks of an article or main part stay. All blocks outside articles also go into
the host's token stream. Boilerplate are whole blocks of ``RUN`` or more tokens that
another page has too, and runs of ``LONG`` or more tokens inside blocks that stand on
``LONG_PAGES`` pages or more, found by a suffix array of the concatenated streams of
a host's pages. Shorter runs inside a block are phrases, and stay. Pages with equal
blocks are one page here, as are rows of one page id. If a page has an article,
blocks outside it that are left over are not part of it and go too.

The pages of a host are dealt into groups of bounded bytes by a hash of the page id,
so that a large host is many groups. 64-bit keys of its blocks and windows of ``LONG``
tokens are added up over all groups of a host, and those that make boilerplate only
with other groups go to the groups that hold them: the text does not depend on the dealing.

Edge cases: NULL or empty html has an empty text; a page without an article keeps
all that is not boilerplate; a host with one page has nothing to compare with; repeated
rows of one page id are one page, however often they come, and are answered each; a
NULL url is a host of its own; unclosed elements end with what encloses them; pages
are read whole; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.llm.common import map_batches, on_workers, stored
from thingroups.llm.decontaminate import suffix_array

#: Tokens of a whole block that counts as repeated, and bytes of a host's group of pages.
RUN, GROUP_BYTES = 5, 2_000_000
#: Tokens of a run that counts inside a block, and pages that it stands on.
LONG, LONG_PAGES = 15, 3
#: Hosts of more than one group that are sent to all executors (some 50 bytes each); with
#: more of them, pages and hosts are joined by a shuffle.
MOST_BROADCAST = 100_000

#: Fixed values of HTML: elements by what they mean for the text.
RAW = "script|style|noscript|template|iframe|object|svg|math|textarea|select|button|title|canvas|audio|video"
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figure footer form head"
    " header html li main menu nav ol section table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("head nav footer aside form menu dialog".split())
ARTICLES = {"article", "main"}
#: Words of a class, id or role that tell what a container is for.
DROPPED_WORDS = set(
    "nav navbar navigation menu menubar header footer sidebar banner ad ads advert adverts advertisement sponsor"
    " sponsored promo cookie cookies consent notice comment comments disqus share sharing social breadcrumb"
    " breadcrumbs related newsletter subscribe popup modal pagination pager toolbar contentinfo complementary".split()
)
#: Elements that are never dropped for a name, and names of what holds other texts.
WHOLE, OTHERS = {"html", "body", "main", "article"}, {"comment", "comments", "disqus", "related"}
#: Parts of a name that come after such a word, and parts that only tell of a state.
NEUTRAL = set(
    "area bar block body bottom box column container content fixed group holder inner item items left links list main"
    " outer panel primary right row secondary section sticky top widget widgets wrap wrapper".split()
)
STATES = set("has have is no not with without hide hidden show".split())
_NAME = re.compile(rf"(?:(?P<raw>{RAW})\b|(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*))", re.IGNORECASE)
_UNQUOTED = re.compile(r"[^'\">]*")
_RAW_ENDS: dict[str, re.Pattern] = {}


@dataclass(frozen=True)
class Tag:
    """A stretch of markup; raw elements with all inside, comments and declarations have no name."""

    start: int
    end: int
    name: str = ""
    closes: bool = False
    rest: str = ""


class Tags:
    """The markup of a page, from left to right, in linear time.

    A tag ends at the first ``>`` outside quotes. One that never ends is text, and every
    place outside quotes that the search for its end went through is marked: a later
    search that gets to such a place would go on the same way, and is given up."""

    def __init__(self, page: str):
        self.page = page
        self._last = {c: page.rfind(c) for c in "'\">"}
        self._hopeless = bytearray(len(page) + 1)

    def _tag_end(self, at: int) -> int:
        """The place of the ``>`` of a tag whose attributes begin here, or -1."""
        page, seen = self.page, []
        while at <= self._last[">"] and not self._hopeless[at]:
            stop = _UNQUOTED.match(page, at).end()
            seen.append((at, stop + 1))
            if stop == len(page):
                break
            if page[stop] == ">":
                return stop
            if stop == self._last[page[stop]]:
                break  # the quote is never closed
            at = page.index(page[stop], stop + 1) + 1
        for a, b in seen:
            self._hopeless[a:b] = b"\x01" * (min(b, len(self._hopeless)) - a)
        return -1

    def __iter__(self) -> Iterator[Tag]:
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            tag = self._at(start)
            if tag is not None:
                yield tag
            at = start + 1 if tag is None else tag.end

    def _at(self, start: int) -> Tag | None:
        page = self.page
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return Tag(start, len(page) if end < 0 else end + 3)
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start) if start < self._last[">"] else -1
            return None if end < 0 else Tag(start, end + 1)
        name = _NAME.match(page, start + 1)
        end = -1 if name is None else self._tag_end(name.end())
        if end < 0:
            return None
        if name["raw"]:
            closing = _RAW_ENDS.setdefault(name["raw"].lower(), re.compile(rf"</{name['raw']}\s*>", re.IGNORECASE))
            found = closing.search(page, end + 1)
            return Tag(start, found.end() if found else len(page))
        return Tag(start, end + 1, name["name"].lower(), bool(name["end"]), page[name.end() : end])


_PURPOSE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

DROP, OPEN, KEEP = 0, 1, 2


def _said(rest: str) -> set[str]:
    """The dropped words that a class, id or role names: ``menu``, ``main-menu``,
    ``menu-list``, but not ``no-menu`` or ``menu-maker``."""
    out = set()
    for values in _PURPOSE.findall(rest):
        for name in "".join(values).lower().split():
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            while len(parts) > 1 and parts[-1] in NEUTRAL:
                parts.pop()
            if parts and parts[-1] in DROPPED_WORDS and not STATES & set(parts):
                out.add(parts[-1])
    return out


def _purpose(name: str, rest: str, around: int, named: bool = True) -> int:
    """What a container's blocks are, from its tag and attributes and what is around it."""
    if around == DROP or name in DROPPED or (name == "header" and around != KEEP):
        return DROP
    said = _said(rest) if named and name not in WHOLE else set()
    if said and not (around == KEEP and said <= {"header"}):
        return DROP
    return KEEP if name in ARTICLES else around


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(DROP, OPEN or KEEP, text) of each block that has text, in page order.

    If no article has text outside containers that are dropped for their names, such
    containers around an article are not dropped; comments and related pages are."""
    around: set[int] = set()
    out = _blocks_of(page, frozenset(), around)
    if around and not any(kind == KEEP for kind, _ in out):
        out = _blocks_of(page, frozenset(around), set())
    return out


def _blocks_of(page: str | None, spared: frozenset[int], around: set[int]) -> list[tuple[int, str]]:
    """``spared``: containers, by the place of their tag, whose names are not looked at;
    ``around`` gets those that only their names drop, with an article inside."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    named: list[int | None] = []  # for each open container: its place, if names alone drop it
    opened: Counter[str] = Counter()
    hard, told = 0, 0  # containers in ``named`` that are dropped anyway, and those that ``around`` has

    def close() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            out.append((stack[-1][1] if stack else OPEN, text))

    at, page = 0, page or ""
    for tag in Tags(page):
        pieces.append(page[at : tag.start])
        at, name = tag.end, tag.name
        if name == "br":
            pieces.append(" ")
        elif name and name not in INLINE:
            close()
            if name in CONTAINERS and tag.closes:
                while opened[name]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    hard -= named.pop() == -1
                    if last == name:
                        break
                told = min(told, len(named))
            elif name in CONTAINERS and not tag.rest.endswith("/"):
                outer, place = stack[-1][1] if stack else OPEN, None
                kind = _purpose(name, tag.rest, outer, tag.start not in spared)
                if kind == DROP and name not in WHOLE:
                    anyway = name in DROPPED or name == "header" or _said(tag.rest) & OTHERS
                    place = -1 if anyway else tag.start if _said(tag.rest) else None
                stack.append((name, kind))
                opened[name] += 1
                named.append(place)
                hard += place == -1
                if name in ARTICLES and kind == DROP and not hard:
                    around.update(n for n in named[told:] if n is not None)
                    told = len(named)
    pieces.append(page[at:])
    close()
    return out


def window_keys(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit key of each window of ``width`` token hashes."""
    out = np.full(max(0, len(hashes) - width + 1), seed, np.uint64)
    for i in range(width if len(out) else 0):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _distinct(group: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many different values each group has."""
    pairs = np.unique(group * (of.max() + 1) + of)
    return np.bincount(pairs // (of.max() + 1), minlength=group[-1] + 1)


def repeated(
    streams: list[list[list[str]]],
    pages: list,
    run: int = RUN,
    least: int = 2,
    contents: list | None = None,
    known: np.ndarray | None = None,
    seed: int = 0,
) -> list[list[np.ndarray]]:
    """For each stream's blocks, which tokens lie in a run that stands on ``least`` pages,
    different in id and in content, or whose window's key is ``known`` to do so."""
    contents = contents or [tuple(map(tuple, stream)) for stream in streams]
    numbers: dict[str, int] = {}
    blocks = [b for stream in streams for b in stream]
    total = sum(len(b) + 1 for b in blocks)
    text, page, content = (np.zeros(total, np.int64) for _ in range(3))
    page_number = {p: i for i, p in enumerate(dict.fromkeys(pages))}
    content_number = {c: i for i, c in enumerate(dict.fromkeys(contents))}
    at = 0
    for stream, p, c in zip(streams, pages, contents, strict=True):
        for b in stream:
            text[at : at + len(b)] = [numbers.setdefault(t, len(numbers)) for t in b]
            page[at : at + len(b) + 1] = page_number[p]
            content[at : at + len(b) + 1] = content_number[c]
            at += len(b) + 1
    ends = np.cumsum([len(b) + 1 for b in blocks]) - 1
    text[ends] = len(numbers) + np.arange(len(ends))  # a separator occurs once: no run goes across
    covered = np.zeros(total + 1, np.int64)
    order = suffix_array(text)
    if total > 1:
        fits = order < total - run + 1
        same = fits[1:] & fits[:-1]
        for k in range(run):
            same &= text[np.minimum(order[1:] + k, total - 1)] == text[np.minimum(order[:-1] + k, total - 1)]
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        often = (_distinct(group, page[order]) >= least) & (_distinct(group, content[order]) >= least)
        starts = order[often[group]]
        if known is not None and len(known):
            hashes = np.concatenate([token_hashes(list(numbers)), np.arange(len(ends), dtype=np.uint64)])
            elsewhere = np.flatnonzero(np.isin(window_keys(hashes[text], run, seed), known))
            inside = np.searchsorted(ends, elsewhere) == np.searchsorted(ends, elsewhere + run - 1)
            inside &= ~np.isin(elsewhere + run - 1, ends)
            starts = np.union1d(starts, elsewhere[inside])
        np.add.at(covered, starts, 1)
        np.add.at(covered, np.minimum(starts + run, total), -1)
    marks = np.cumsum(covered[:total]) > 0
    out, at = [], 0
    for stream in streams:
        lines = []
        for b in stream:
            lines.append(marks[at : at + len(b)])
            at += len(b) + 1
        out.append(lines)
    return out


def token_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def content_key(page: list[tuple[int, str]]) -> int:
    """Equal for pages with the same blocks, menus and the like left aside."""
    said = [text for kind, text in page if kind == OPEN] or [text for kind, text in page if kind != KEEP]
    return xxhash.xxh64_intdigest("\n".join(said))


def keys_of(page: list[tuple[int, str]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a page's whole blocks, and of its windows of LONG tokens."""
    texts = [text for kind, text in page if kind != KEEP]
    streams = [text.split() for text in texts]
    whole = [xxhash.xxh64_intdigest(t, seed) for t, s in zip(texts, streams, strict=True) if len(s) >= RUN]
    windows = [window_keys(token_hashes(s), LONG, seed) for s in streams if len(s) >= LONG]
    return np.array(sorted(set(whole)), np.uint64), np.unique(np.concatenate([*windows, np.zeros(0, np.uint64)]))


def host_seed(host: str) -> int:
    return xxhash.xxh64_intdigest(host)


def main_texts(
    pages: list[list[tuple[int, str]]], ids: list, host: str = "", known: np.ndarray | None = None
) -> list[tuple[str, int]]:
    """Text and number of repeated tokens of each page of a host's group. ``known``: keys
    of blocks and windows that other groups make boilerplate."""
    streams = [[text.split() for kind, text in page if kind != KEEP] for page in pages]
    contents, seed = [content_key(page) for page in pages], host_seed(host)
    on: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for page, i, c in zip(pages, ids, contents, strict=True):
        for kind, text in page:
            if kind != KEEP:
                on[text][0].add(i)
                on[text][1].add(c)
    elsewhere = set() if known is None else set(known.tolist())
    whole = {t for t, (i, c) in on.items() if (min(len(i), len(c)) > 1 or xxhash.xxh64_intdigest(t, seed) in elsewhere) and len(t.split()) >= RUN}
    out = []
    runs = repeated(streams, ids, LONG, LONG_PAGES, contents, known, seed)
    for page, stream, marks in zip(pages, streams, runs, strict=True):
        has_article = any(kind == KEEP for kind, _ in page)
        kept, n_repeated, outside = [], 0, iter(zip(stream, marks, strict=True))
        for kind, text in page:
            if kind == KEEP:
                kept.append(text)
                continue
            tokens, mark = next(outside)
            if text in whole:
                mark = np.ones(len(tokens), bool)
            n_repeated += int(mark.sum())
            if kind == OPEN and not has_article:
                kept.append(" ".join(t for t, m in zip(tokens, mark, strict=True) if not m))
        out.append((" ".join(filter(None, kept)), n_repeated))
    return out


def extract(pages: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """page_id, url, text and n_repeated (tokens of the host's boilerplate) of each page."""

    def parse(batches: Iterator[list[list]]) -> Iterator[dict]:
        for ids, urls, sources in batches:
            parsed = [blocks_of(s) for s in sources]
            yield {
                "page_id": ids,
                "url": urls,
                "host": [(re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", u or "") or [None, ""])[1].lower() for u in urls],
                "kinds": [[k for k, _ in p] for p in parsed],
                "texts": [[t for _, t in p] for p in parsed],
                "bytes": [len(s) if s else 0 for s in sources],
            }

    def windows(batches: Iterator[list[list]]) -> Iterator[dict]:
        for hosts, parts, ids, sources in batches:
            for i in range(0, len(ids), 250):
                out: dict[str, list] = {"host": [], "key": [], "least": [], "part": [], "page": [], "content": []}
                for host, part, page_id, source in zip(*(x[i : i + 250] for x in (hosts, parts, ids, sources)), strict=True):
                    page = blocks_of(source)
                    content = np.uint64(content_key(page)).view(np.int64).item()
                    for keys, least in zip(keys_of(page, host_seed(host)), (2, LONG_PAGES), strict=True):
                        out["key"] += keys.view(np.int64).tolist()
                        for name, value in (("host", host), ("least", least), ("part", part), ("page", page_id), ("content", content)):
                            out[name] += [value] * len(keys)
                yield out

    def groups(key: tuple, rows: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
        blocks = [list(zip(k, t, strict=True)) for k, t in zip(rows["kinds"], rows["texts"], strict=True)]
        ids = [None if pd.isna(i) else int(i) for i in rows["page_id"]]
        known = elsewhere["key"].to_numpy(np.int64).view(np.uint64)
        texts = main_texts(blocks, ids, key[0], known)
        return pd.DataFrame(
            {
                "page_id": pd.array(ids, dtype="Int64"),
                "url": rows["url"].to_numpy(),
                "text": [t for t, _ in texts],
                "n_repeated": [n for _, n in texts],
            }
        )

    schema = "page_id long, url string, host string, kinds array<int>, texts array<string>, bytes long"
    parsed = map_batches(pages.withColumn("page_id", F.col("page_id").cast("long")), ["page_id", "url", "html"], parse, schema)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    sizes = pages.groupBy(host.alias("host")).agg(F.sum(F.length("html")).alias("host_bytes"))
    large = sizes.where(F.col("host_bytes") > group_bytes).select("host", F.ceil(F.col("host_bytes") / group_bytes).alias("parts"))
    large = stored(large, "large-hosts")
    few = large.count() <= MOST_BROADCAST
    part = F.coalesce(F.pmod(F.xxhash64("page_id"), "parts"), F.lit(0))
    dealt = parsed.join(F.broadcast(large) if few else large, "host", "left").withColumn("part", part)
    if not few:  # the join has dealt the pages by host alone
        dealt = dealt.repartition("host", "part")
    # what repeats in several groups of a host: first by group, so that no key is hot
    source = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), "html")
    source = source.join(F.broadcast(large) if few else large, "host").withColumn("part", part)
    found = map_batches(source, ["host", "part", "page_id", "html"], windows, "host string, key long, least int, part long, page long, content long")
    some = lambda c: F.slice(F.collect_set(c), 1, LONG_PAGES)
    page = F.coalesce("page", F.lit(-(2**63)))
    in_group = found.groupBy("host", "key", "part").agg(
        F.max("least").alias("least"), some(page).alias("pages"), some("content").alias("contents")
    )
    count = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    on_host = in_group.groupBy("host", "key").agg(
        F.max("least").alias("least"), count("pages").alias("pages"), count("contents").alias("contents"), F.collect_list("part").alias("in")
    )
    on_host = on_host.where((F.size("in") > 1) & (F.col("pages") >= F.col("least")) & (F.col("contents") >= F.col("least")))
    elsewhere = on_host.select("host", F.explode("in").alias("part"), "key").groupBy("host", "part")
    schema = "page_id long, url string, text string, n_repeated long"
    return on_workers(dealt).groupBy("host", "part").cogroup(elsewhere).applyInPandas(groups, schema)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
