"""Main text of web pages: structure, and long substrings that repeat over a host.

A page is cut into blocks, each with a region: *main* (inside article or main),
*plate* (menus, forms, adverts and the like, known by tag, role, class or id;
dropped at once) or *open* (neither).  A page with main blocks is those blocks
without what its host repeats.

The token streams of a host's pages are concatenated and their suffixes sorted
(a suffix array by prefix doubling, with common prefixes), in parts of ``PART``
tokens; neighbours from distinct pages give the long repeated substrings, of
``RUN`` tokens and more.  What a part finds is counted over all pages.  Structure
says how much repetition makes boilerplate:

* main blocks: a substring that stands on more than half of the host's rows
  with main blocks, in ``LEAST`` distinct texts or more (a notice on all articles
  goes, an article on two pages stays; a page whose whole text is shared keeps
  it);
* open blocks, which make the text of pages without main blocks: a substring
  that two distinct pages of the host have in open blocks (those of pages with
  main blocks included), or that is boilerplate of main blocks.  As the two
  pages may lie anywhere, runs of RUN tokens are grouped here by a hash; longer
  substrings are unions of them.

All tokens that such substrings cover go; the unique runs stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import materialise, slices, small_batches
from bulwark.llm.textkernel import Words, mix, text_buffer

#: Tokens of the shortest repeated substring that counts as boilerplate.
RUN = 8
#: Distinct texts that a run of main blocks must stand in to count as boilerplate.
LEAST = 3
#: Tokens of one suffix array of ``host_plates``, and bits by which parts name runs; both change cost only.
PART, BITS = 2_000_000, 1 << 26

# Element names of HTML by how they act here.
_RAW = "script|style|template|noscript|svg|iframe|textarea|select|math|object|canvas|audio|video|title"
_PLATE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "head", "datalist", "fieldset"}
_BLOCK = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "tr", "td", "th",
    "caption", "section", "article", "main", "header", "figure", "figcaption", "address", "hr", "body", "html", "details", "summary",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class and id that tell boilerplate on any element, and those that do unless the element is a section of text.
_PLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies",
    "consent", "gdpr", "newsletter", "subscribe", "subscription", "signup", "sidebar", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "masthead", "comment", "comments", "disqus", "respond", "popup", "modal", "pagination", "pager", "login", "copyright",
}
_WEAK_WORDS = {
    "notice", "menu", "nav", "footer", "reply", "replies", "share", "sharing", "social", "related", "recommended", "overlay", "toolbar", "widget",
    "search", "skip", "hidden",
}
_TEXT_SECTIONS = {"section", "article", "main"}
_PLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
_OUTSIDE_ONLY = {"header"}
# Elements whose end tag may be left out, by the start tags that end them, and the elements that hide those.
_ENDS_P = _BLOCK - {"li", "dt", "dd", "tr", "td", "th", "caption", "body", "html", "summary"} | {"nav", "footer", "aside", "form", "menu", "fieldset", "p"}
_ENDED_BY = {
    "p": _ENDS_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
}
_HIDES = {"p": _ENDS_P - {"p"} | {"li", "dd", "dt", "td", "th"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _is_plate(name: str, attributes: str, inside: bool) -> bool:
    if name in _PLATE or (name in _OUTSIDE_ONLY and not inside):
        return True
    if not attributes or name in ("body", "html"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            words = _SPLIT.split(value)
            if not _PLATE_WORDS.isdisjoint(words) or (name not in _TEXT_SECTIONS and not _WEAK_WORDS.isdisjoint(words)):
                return True
        elif key == "role":
            if value in _PLATE_ROLES:
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def blocks_of(page: str) -> tuple[list[str], list[str]]:
    """(main blocks, open blocks) in page order; white space inside a block is one space.

    Open elements are kept on a stack, so that one whose end tag is left out ends
    where a browser would end it, dropped ones too.
    """
    main: list[str] = []
    rest: list[str] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, main
    inside = dropped = at = 0  # how many open elements are main, and dropped

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                (main if inside else rest).append(text)
            pieces.clear()

    def close_to(k: int) -> None:
        nonlocal inside, dropped
        flush()
        for _, gone, core in stack[k:]:
            dropped -= gone
            inside -= core
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if not dropped and m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close_to(k)
                    break
            else:
                if name in _BLOCK and not dropped:
                    flush()
            continue
        if name == "br":
            if not dropped:
                pieces.append(" ")
            continue
        for k in range(len(stack) - 1, -1, -1):
            above = stack[k][0]
            if name in _ENDED_BY.get(above, ()) and not any(x in _HIDES[above] for x, _, _ in stack[k + 1 :]):
                close_to(k)
                break
        gone = name not in _VOID and not dropped and _is_plate(name, m[4], inside > 0)
        if gone or (name in _BLOCK and not dropped):
            flush()
        # elements inside a line matter only where they are dropped, or may end inside something dropped
        if name in _VOID or m[4].endswith("/") or not (gone or dropped or name in _BLOCK or name in _ENDED_BY):
            continue
        core = not gone and not dropped and (name in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", m[4]) is not None)
        stack.append((name, gone, core))
        dropped += gone
        inside += core
    if not dropped:
        pieces.append(page[at:])
    flush()
    return main, rest


def unique_runs(tokens: list[list[str]], covered: set[int]) -> str:
    """Blocks without their covered tokens (numbered through the page); what is empty then goes."""
    at, out = 0, []
    for block in tokens:
        kept = [w for k, w in enumerate(block, at) if k not in covered]
        at += len(block)
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first): words first[i]:first[i + 1] are text i's."""
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    words = Words(buf, offsets)
    return words.hashes(buf), words.first


def _run_keys(h: np.ndarray, start: np.ndarray, hosts: np.ndarray, run_length: int) -> np.ndarray:
    """A hash of host and run for the runs of words that begin at ``start``."""
    keys = np.zeros(len(start), np.uint64)
    for k in range(run_length):
        keys = mix(keys + h[start + k])
    return mix(keys ^ mix(hosts.astype(np.int64).view(np.uint64)))


def window_keys(texts: list[str], hosts: np.ndarray, run_length: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row, at) of all runs of ``run_length`` tokens: a hash of host and run, the text's number and the first token's number in it."""
    h, first = _words(texts)
    n = np.diff(first)
    row = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(h)) - first[row]
    whole = at + run_length <= n[row]
    start, row, at = np.flatnonzero(whole), row[whole], at[whole]
    return _run_keys(h, start, hosts[row], run_length), row, at


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(order, lcp, ranks) of the suffixes of one array of integers, compared to ``2 * depth - 1`` tokens (depth: a power of two).

    Prefix doubling: ranks[k] numbers the runs of 2^k tokens in their order, and
    two ranks make one of twice the length.  lcp[i] is the common prefix of the
    suffixes order[i - 1] and order[i], found from the ranks, longest first.
    """
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for rank in ranks[::-1]:
        size = step
        step //= 2
        room = (a + size <= n) & (b + size <= n)
        same = np.zeros(len(a), bool)
        same[room] = rank[a[room]] == rank[b[room]]
        lcp[1:][same] += size
        a[same] += size
        b[same] += size
    return order, lcp, ranks


def repeated_elsewhere(tokens: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """For each token, the length of the longest substring from it that stands on another page too (0 below ``least``; lengths above 2 * depth - 1 count as that).

    ``page`` is the page number of each token; separators have a token and a page of their own.
    """
    depth = 1 << max(5, (least - 1).bit_length())
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    order, lcp, _ = suffix_array(tokens, depth)
    out[order] = np.maximum(_to_another(page[order], lcp), _to_another(page[order][::-1], np.append(lcp[1:], 0)[::-1])[::-1])
    out[out < least] = 0
    return out


def _to_another(page: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix of the array with the nearest one before it of another page; lcp: with the one just before."""
    n = len(page)
    out = lcp.copy()
    first = np.concatenate([[True], page[1:] != page[:-1]])
    nth = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    later = np.flatnonzero(nth)
    later = later[np.argsort(nth[later], kind="stable")]
    for at in np.split(later, np.flatnonzero(np.diff(nth[later])) + 1):
        out[at] = np.minimum(out[at - 1], lcp[at])  # the ones before in their runs are done
    return out


def _once(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key of a row once."""
    order = np.lexsort((row, keys))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[new], row[new]


def named_runs(h: np.ndarray, row: np.ndarray, hosts: np.ndarray, run_length: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(keys, hosts) of the runs on more than half of the rows of their host, by the suffix array of all hosts.

    h: word hashes of all rows, one row after the other; row: number of each
    word's row; hosts: of each row.  Words are keyed by their host and rows are
    separated, so one array holds the suffixes of every host.
    """
    n, rows = len(h), len(hosts)
    whose, first, pages_of = np.unique(hosts, return_inverse=True, return_counts=True)
    begin = np.searchsorted(row, np.arange(rows + 1))
    keyed = mix(h ^ mix(hosts.astype(np.int64).view(np.uint64))[row]) if n else h
    place = np.arange(n) + row  # a separator after every row
    tokens, page = np.empty(n + rows, np.int64), np.empty(n + rows, np.int64)
    # separators are all different, and unlike any word
    tokens[place], page[place] = np.unique(keyed, return_inverse=True)[1], row
    ends = begin[1:] + np.arange(rows)
    tokens[ends], page[ends] = n + np.arange(rows), rows + np.arange(rows)
    long = repeated_elsewhere(tokens, page, run_length)[place] >= run_length
    # a host with one row here: each of its runs is on more than half
    alone = (pages_of[first] == 1)[row] & (np.arange(n) + run_length <= begin[1:][row])
    start = np.flatnonzero(long | alone)
    keys, where = _once(_run_keys(h, start, hosts[row[start]], run_length), row[start])
    order = np.argsort(keys, kind="stable")
    keys, where = keys[order], where[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(keys)))
    passes = 2 * count > pages_of[first[where[at]]]
    return keys[at][passes], hosts[where[at]][passes]


def host_plates(rows: DataFrame, run_length: int = RUN) -> np.ndarray:
    """Sorted keys of the runs that stand in the main blocks of more than half of a host's rows with main blocks, on ``LEAST`` distinct texts or more.

    Each part of the rows has a suffix array of its own, which finds the long
    substrings that its rows share.  A run on more than half of all rows is on
    more than half in one part at least, however they are parted; so each part
    names what passes in it, and only runs named (by a bit of their key) are
    counted over all rows.
    """
    source = rows.select("hosted", "html")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        pages: list[np.ndarray] = []
        held = rows_held = 0

        def part() -> pa.RecordBatch:
            all_hosts = np.concatenate(pages)
            keys, host = named_runs(np.concatenate([h for h, _ in kept]), np.concatenate([r for _, r in kept]), all_hosts, run_length)
            hosts, pages_of = np.unique(all_hosts, return_counts=True)
            out = np.concatenate([keys.view(np.int64), np.zeros(len(hosts), np.int64)])
            size = np.concatenate([np.zeros(len(keys), np.int64), pages_of])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([host, hosts])), pa.array(out), pa.array(size)], names=["hosted", "key", "pages"])

        for batch in slices(batches, "html"):
            texts, hosts = _main_texts(batch)
            if not texts:
                continue
            h, first = _words(texts)
            kept.append((h, rows_held + np.repeat(np.arange(len(texts)), np.diff(first))))
            pages.append(hosts)
            held += len(h)
            rows_held += len(texts)
            if held >= PART:
                yield part()
                kept, pages, held, rows_held = [], [], 0, 0
        if pages:
            yield part()

    found = materialise(source.mapInArrow(named, "hosted long, key long, pages long"))
    hosts = materialise(found.groupBy("hosted").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST))
    bits = found.where("pages = 0").join(hosts.select("hosted"), "hosted", "left_semi").select(F.pmod("key", F.lit(BITS)).alias("bit")).distinct().toArrow()["bit"].to_numpy()
    if not len(bits):
        return np.zeros(0, np.uint64)
    flags = np.zeros(BITS, bool)
    flags[bits] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in slices(batches, "html"):
            texts, hosts = _main_texts(batch)
            keys, row, _ = window_keys(texts, hosts, run_length)
            bit = keys.view(np.int64) % BITS
            hit = (packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
            keys, row = _once(keys[hit], row[hit])
            text = np.array([int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hosts[row], pa.int64()), pa.array(keys.view(np.int64)), pa.array(text[row], pa.int64())], names=["hosted", "key", "content"])

    each = source.mapInArrow(counted, "hosted long, key long, content long").groupBy("hosted", "key", "content").agg(F.count("*").alias("n"))
    total = each.groupBy("hosted", "key").agg(F.sum("n").alias("n"), F.count("*").alias("contents")).where(F.col("contents") >= LEAST)
    keys = total.join(hosts, "hosted").where(2 * F.col("n") > F.col("pages")).select("key").toArrow()["key"].to_numpy()
    return np.sort(keys.astype(np.int64).view(np.uint64))


def _main_texts(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """(main blocks joined, host hash) of the rows with main blocks."""
    texts = ["\n".join(blocks_of(page or "")[0]) for page in batch.column("html").to_pylist()]
    some = np.array([bool(t) for t in texts], bool)
    return [t for t in texts if t], batch.column("hosted").to_numpy(zero_copy_only=False)[some]


def _plate_starts(texts: list[str], hosts: np.ndarray, plates: np.ndarray, run_length: int) -> dict[int, list[int]]:
    """By text number, the tokens at which runs of ``plates`` start."""
    out: dict[int, list[int]] = {}
    if len(plates):
        keys, row, at = window_keys(texts, hosts, run_length)
        k = np.minimum(np.searchsorted(plates, keys), len(plates) - 1)
        for i in np.flatnonzero(plates[k] == keys):
            out.setdefault(int(row[i]), []).append(int(at[i]))
    return out


def main_text(pages: DataFrame, run_length: int = RUN) -> DataFrame:
    """(page_id, url, text), one row per row of ``pages(page_id, url, html)``.

    Null html gives the empty text.  Rows that repeat a page count as one page
    among open blocks; a null url is a host of its own.  A page of any length is
    read whole, alone in its slice if it is long.  Other columns are ignored
    whatever their names; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.xxhash64(host).alias("hosted"), F.col("html").cast("string").alias("html"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in ("page_id", "url"))
    shared = pages.sparkSession.sparkContext.broadcast(host_plates(rows, run_length))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            mains = [blocks_of(page or "")[0] for page in batch.column("html").to_pylist()]
            some = pa.array([bool(m) for m in mains], pa.bool_())
            batch, mains = batch.filter(some), [m for m in mains if m]
            starts = _plate_starts(["\n".join(m) for m in mains], batch.column("hosted").to_numpy(zero_copy_only=False), shared.value, run_length)
            texts = []
            for i, main in enumerate(mains):
                left = unique_runs([b.split(" ") for b in main], {j + k for j in starts[i] for k in range(run_length)}) if i in starts else ""
                texts.append(left or "\n".join(main))  # a page is never emptied by what it shares
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            both = [blocks_of(page or "") for page in batch.column("html").to_pylist()]
            kept = pa.array([bool(rest) or not main for main, rest in both], pa.bool_())
            batch, both = batch.filter(kept), [b for b in both if b[1] or not b[0]]
            lists = [[b.split(" ") for b in rest] for _, rest in both]
            arrays = [*(batch.column(c) for c in ("page_id", "url", "hosted", "page")), pa.array([bool(m) for m, _ in both], pa.bool_()), pa.array(lists, pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "hosted", "page", "framed", "blocks"])

    found = rows.mapInArrow(framed, f"{head}, text string")

    # open blocks of framed pages tell what repeats, too, but only pages without main blocks are made of open ones
    hashed = rows.select("page_id", "url", "hosted", F.xxhash64("url", "html").alias("page"), "html")
    loose = materialise(hashed.mapInArrow(opened, f"{head}, hosted long, page long, framed boolean, blocks array<array<string>>"))
    tokens = loose.select("hosted", "page", F.flatten("blocks").alias("t")).where(F.size("t") >= run_length).dropDuplicates(["hosted", "page"])
    suffixes = tokens.select("hosted", "page", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("t") - run_length), lambda i: F.xxhash64(F.slice("t", i + 1, run_length)))).alias("i", "prefix"))
    repeated = suffixes.groupBy("hosted", "prefix").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b").select("hosted", "prefix")
    marks = suffixes.join(materialise(repeated), ["hosted", "prefix"]).groupBy("hosted", "page").agg(F.collect_set("i").alias("starts"))
    joined = loose.where("not framed").join(marks, ["hosted", "page"], "left").select("page_id", "url", "hosted", "blocks", "starts")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("blocks").to_pylist()
            plates = _plate_starts(["\n".join(" ".join(b) for b in blocks or []) for blocks in lists], batch.column("hosted").to_numpy(zero_copy_only=False), shared.value, run_length)
            texts = []
            for n, (blocks, starts) in enumerate(zip(lists, batch.column("starts").to_pylist(), strict=True)):
                texts.append(unique_runs(blocks or [], {i + k for i in [*(starts or []), *plates.get(n, [])] for k in range(run_length)}))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return found.unionByName(joined.mapInArrow(kept, f"{head}, text string"))
