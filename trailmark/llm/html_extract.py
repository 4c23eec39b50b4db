"""Main text of web pages: markup where it says what a block is, a host's repeated substrings where it doesn't.

A page is cut into blocks, and each block has a role: inside an article or main element (content), inside
an element that markup names as menu, header, footer, sidebar, notice, advert, form or comments
(boilerplate), or neither (open; only pages without an article have such blocks).

For each host the boilerplate and open blocks of its pages form token streams.  They are concatenated,
one page after the other, and their suffixes are sorted by prefix doubling to the depth of ``LENGTH``
tokens; neighbours that agree that far are occurrences of one repeated substring, and a longer
repeat is a chain of those, each a token after the one before, as far as the same pages have them all.  A run is boilerplate
that at least ``PAGES`` distinct pages of a host share,
and at least ``SHARE`` of its distinct pages; pages of equal main text (article and open blocks) are one.  Open blocks
that one such run covers from end to end are left out; a block with anything else in it stays whole, and so
does a page of which nothing would be left.  Blocks whose role markup settles are not changed by
repetition, since articles may quote and copy each other.

A host may have any number of pages.  Suffix arrays are built over each batch's pages of a host, and
what they find (a substring's hash and the hashes of its pages' main texts) is united over batches, so the decision is
that of the array over the whole host while no task holds more than a batch.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import written

LENGTH, PAGES, SHARE = 8, 3, 0.1
#: Bytes of pages whose suffix arrays are built at once.
BATCH_BYTES = 16 << 20
CONTENT, OPEN, BOILERPLATE = 0, 1, 2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form head menu dialog svg math canvas object audio video select button datalist fieldset map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of class and id names that mark boilerplate wherever they stand in a name.
_STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter sidebar nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus popup modal pagination pager".split()
)
#: Words that do so if the rest of the name is of such words and of the helping ones only ("related-posts", not "related-work").
_MARKS = _STRONG | frozenset("promotion banner notice notices alert subscribe subscription signup login side aside header respond reply replies related recommended share sharing social overlay form search skip toolbar widget".split())
_HELPING = frozenset("box bar list lists link links item items button buttons section block area wrapper wrap container inner outer group panel row col left right top bottom main site page global posts articles stories content links icons".split())
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: What a start tag closes, up to the first of the elements that bound the search.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "article", "main", "section", "nav", "aside"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "article", "main", "section"}), "dd": ({"dt", "dd"}, {"dl", "table", "article", "main", "section"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_BOUNDS = frozenset("table td th caption".split())


def _marked(names: str) -> bool:
    """Does one of the names of a class or id attribute mark boilerplate?"""
    for name in names.split():
        parts = [p.lower() for p in _SPLIT.split(name) if p]
        if _STRONG & set(parts) or (set(parts) & _MARKS and set(parts) <= _MARKS | _HELPING):
            return True
    return False


def _boilerplate(name: str, raw: str, in_article: bool) -> bool:
    if name in _DROPPED or (name == "header" and not in_article):
        return True
    if not raw.strip():
        return False
    attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if name in ("html", "body", "main", "article"):
        return False
    return any(_marked(attributes.get(k, "")) for k in ("class", "id") if not (in_article and name == "header"))


class _Reader:
    """The open elements of a page, and its blocks so far."""

    def __init__(self):
        self.out: list[tuple[int, str]] = []
        self.held: list[str] = []  # text of the block under way
        self.aside: list[str] = []  # text of a marked inline element in it
        self.stack: list[str] = []
        self.skip = -1  # place in the stack of the element that is boilerplate
        self.inline = False  # ... which is an inline one: the block goes on after it
        self.articles = 0

    def text(self, part: str) -> None:
        (self.aside if self.skip >= 0 and self.inline else self.held).append(part)

    def _emit(self, parts: list[str], role: int) -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            self.out.append((role, text))
        parts.clear()

    def flush(self) -> None:
        self._emit(self.aside, BOILERPLATE)
        role = BOILERPLATE if self.skip >= 0 and not self.inline else CONTENT if self.articles else OPEN
        self._emit(self.held, role)

    def _pop_to(self, place: int) -> None:
        """Close all elements from a place of the stack on."""
        self.flush()
        self.articles -= sum(n in ("article", "main") for n in self.stack[place:])
        del self.stack[place:]
        if self.skip >= place:
            self.skip, self.inline = -1, False

    def _nearest(self, names, bounds) -> int:
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place] in names:
                return place
            if self.stack[place] in bounds:
                return -1
        return -1

    def start(self, name: str, raw: str) -> None:
        """A block element begins: it ends the block, and paragraphs and items that it cannot stand in."""
        self.flush()
        if name in _BLOCKS and (place := self._nearest({"p"}, _BOUNDS)) >= 0:
            self._pop_to(place)
        if name in _IMPLIED and (place := self._nearest(*_IMPLIED[name])) >= 0:
            self._pop_to(place)
        if name in _VOID or raw.endswith("/"):
            return
        self.stack.append(name)
        if name in ("article", "main"):
            self.articles += 1
        if self.skip < 0 and _boilerplate(name, raw, self.articles > 0):
            self.skip, self.inline = len(self.stack) - 1, False

    def start_inline(self, name: str, raw: str) -> None:
        if name in _VOID or raw.endswith("/"):
            return
        if self.skip >= 0:
            if self.inline and name == self.stack[self.skip]:  # the same element within it
                self.stack.append(name)
        elif "=" in raw and _boilerplate(name, raw, True):
            self.stack.append(name)
            self.skip, self.inline = len(self.stack) - 1, True

    def end_inline(self, name: str) -> None:
        if self.skip >= 0 and self.inline and self.stack[-1] == name:
            self.stack.pop()
            if len(self.stack) <= self.skip:
                self._emit(self.aside, BOILERPLATE)
                self.skip, self.inline = -1, False

    def end(self, name: str) -> None:
        """An end tag closes the nearest element of its name, and all that stand in it; one without such an element only ends the block."""
        place = self._nearest({name}, _BOUNDS - {name})
        if place >= 0:
            self._pop_to(place)
        else:
            self.flush()


def blocks(page: str) -> list[tuple[int, str]]:
    """``(role, text)`` of every block that has text, in page order.

    Open elements are kept as browsers keep them: a start tag closes paragraphs and items that it cannot stand in, an
    end tag closes all within its element, and what is boilerplate ends with its element or with one round it.
    """
    r = _Reader()
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            r.text(page[at:])
            break
        if lt > at:
            r.text(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            r.text("<")
            at = lt + 1
            continue
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in _RAW:
            if not close and not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
                at = n if not end else max(page.find(">", end.start()) + 1, 0) or n
        elif name == "br":
            r.text(" ")
        elif name in _INLINE:
            if close:
                r.end_inline(name)
            else:
                r.start_inline(name, attributes)
        elif close:
            r.end(name)
        else:
            r.start(name, attributes)
    r.flush()
    if any(role == CONTENT for role, _ in r.out):
        return [(BOILERPLATE if role == OPEN else role, text) for role, text in r.out]
    return r.out


def host_of(url: str | None) -> str:
    m = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _tokens(parts: list[str]) -> np.ndarray:
    data, offsets = X.utf8(pa.array([" ".join(parts)], pa.string()))
    return X.scan(data, offsets, X.NONSPACE).hash


def suffix_runs(streams: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of the streams, sorted to the depth ``length``: positions, and where a new run begins.

    Positions count through the concatenated streams and start at runs that lie in one stream.
    """
    text = np.concatenate(streams) if streams else np.zeros(0, np.uint64)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    edge = np.repeat(np.cumsum([len(s) for s in streams]), [len(s) for s in streams])
    n, k = len(text), 1
    place = np.arange(n)
    while k < length:
        step = min(k, length - k)
        follow = np.full(n, -1, np.int64)
        follow[: n - step] = rank[step:]
        follow[place + step >= edge] = -1 - place[place + step >= edge]  # a stream's end differs from all
        both = np.lexsort((follow, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[both][1:] != rank[both][:-1]) | (follow[both][1:] != follow[both][:-1])
        rank[both] = np.cumsum(new) - 1
        k += step
    order = np.argsort(rank, kind="stable")
    order = order[order + length <= edge[order]]
    new = np.ones(len(order), bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    return order, new


def _page_key(url: str | None, page: str | None, page_id) -> int:
    data, offsets = X.utf8(pa.array([f"{page_id} {url} {page}"], pa.string()))
    words = X.scan(data, offsets, X.NONSPACE).hash
    return int(np.bitwise_xor.reduce(X.mix(words + np.arange(len(words), dtype=np.uint64))).view(np.int64)) if len(words) else 0


def _content_key(parts: list[tuple[int, str]]) -> int:
    """One for all pages of equal main text."""
    main = "\n".join(t for r, t in parts if r != BOILERPLATE)
    return int.from_bytes(blake2b(main.encode(), digest_size=8).digest(), "little", signed=True)


def _finder(length: int):
    """What each batch's hosts hold: a row without a run with the contents of all pages, one for each run
    with the contents that have it, and one for each occurrence in pages with open blocks."""

    def run(batches):
        for batch in (part for whole in batches for part in X.slices(whole, "html", BATCH_BYTES)):
            by_host: dict[str, list] = {}
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            for page_id, url, page in rows:
                parts = blocks(page or "")
                if parts:
                    opened = any(r == OPEN for r, _ in parts)
                    stream = _tokens([t for r, t in parts if r != CONTENT])
                    by_host.setdefault(host_of(url), []).append((_page_key(url, page, page_id) if opened else 0, opened, stream, _content_key(parts)))
            hosts, keys, page_keys, places = [], [], [], []
            held, sizes_held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for host, found in by_host.items():
                mine = int(X.mix(_tokens([host]).sum(keepdims=True) + np.uint64(1)).view(np.int64)[0])
                contents, content = np.unique(np.array([c for *_, c in found], np.int64), return_inverse=True)
                hosts.append(mine)
                keys.append(None)
                page_keys.append(None)
                places.append(None)
                held.append(contents)
                sizes_held.append(np.array([len(contents)]))
                streams = [s for _, _, s, _ in found]
                order, new = suffix_runs(streams, length)
                if not len(order):
                    continue
                sizes = np.array([len(s) for s in streams])
                begin = np.cumsum(sizes) - sizes
                page = np.searchsorted(begin, order, "right") - 1
                text = np.concatenate(streams)
                group = np.cumsum(new) - 1
                pair = np.unique(group * len(contents) + content[page])
                key = X.grams(text, length)[order[new]].view(np.int64)
                hosts += [mine] * len(key)
                keys += key.tolist()
                page_keys += [None] * len(key)
                places += [None] * len(key)
                held.append(contents[pair % len(contents)])
                sizes_held.append(np.bincount(pair // len(contents)))
                occurring = np.flatnonzero(np.array([o for _, o, _, _ in found])[page])
                sizes_held.append(np.zeros(len(occurring), np.int64))
                for i in occurring.tolist():
                    hosts.append(mine)
                    keys.append(int(key[group[i]]))
                    page_keys.append(found[page[i]][0])
                    places.append(int(order[i] - begin[page[i]]))
            edge = np.append(0, np.cumsum(np.concatenate(sizes_held))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(held), pa.int64()))
            yield pa.record_batch([pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), lists, pa.array(page_keys, pa.int64()), pa.array(places, pa.int32())], ["host", "run", "contents", "page_key", "place"])

    return run


def _cutter(batches):
    for batch in (part for whole in batches for part in X.slices(whole, "html")):
        texts, keys, opened = [], [], []
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            parts = blocks(page or "")
            texts.append("\n".join(t for r, t in parts if r == CONTENT))
            has = any(r == OPEN for r, _ in parts)
            keys.append(_page_key(url, page, page_id) if has else None)
            opened.append([{"role": r, "text": t} for r, t in parts] if has else None)
        kind = pa.list_(pa.struct([("role", pa.int32()), ("text", pa.string())]))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(keys, pa.int64()), pa.array(opened, kind)], ["page_id", "url", "text", "page_key", "blocks"])


def _chains(length: int):
    """``page_key, block, place`` of the open blocks that shared substrings may cover: the chain of places from a block's start to its end.

    A block of fewer tokens than a substring has is covered by one round it, and has the first such place.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for key, parts, places in zip(*(batch.column(c).to_pylist() for c in ("page_key", "blocks", "places")), strict=True):
                at, i = set(places), 0
                for block, p in enumerate(parts):
                    size = 0 if p["role"] == CONTENT else len(p["text"].split(" "))
                    if p["role"] == OPEN:
                        inner = range(i, i + size - length + 1)
                        round_it = [x for x in range(max(i + size - length, 0), i + 1) if x in at] if size < length else []
                        chain = round_it[:1] or (inner if len(inner) and all(x in at for x in inner) else [])
                        out += [(key, block, x) for x in chain]
                    i += size
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[x] for r in out], pa.int32()) for x in (1, 2))], ["page_key", "block", "place"])

    return run


def _keeper(batches):
    """The text of pages with open blocks: all but the blocks that repeated runs cover, or all if none is left."""
    for batch in batches:
        texts = []
        for parts, gone in zip(batch.column("blocks").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            left_out = set(gone or [])
            out = [p["text"] for i, p in enumerate(parts) if p["role"] == CONTENT or (p["role"] == OPEN and i not in left_out)]
            texts.append("\n".join(out or [p["text"] for p in parts if p["role"] == OPEN]))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html_column: str = "html", length: int = LENGTH, shared_by: int = PAGES, share: float = SHARE) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every row.

    Null, empty and contentless pages have the empty text.  Repeated rows and copied pages each give their row, and
    count as one page when repetition is looked for: a run must be on ``shared_by`` distinct pages of its host, and on
    the part ``share`` of them.  A null url is a host of its own name, "".  Malformed
    or cut markup is read as browsers do: what is open at the end is closed there.  An empty table gives none.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    kind = base.schema["page_id"].dataType.simpleString()
    found = written(base.mapInArrow(_finder(length), "host long, run long, contents array<long>, page_key long, place int"), "runs")
    occurring = found.where(F.col("page_key").isNotNull()).select("host", "run", "page_key", "place")
    holding = found.where(F.col("run").isNotNull() & F.col("page_key").isNull()).join(occurring.select("host", "run").distinct(), ["host", "run"], "left_semi")
    each = holding.select("host", "run", F.explode("contents").alias("content")).distinct()
    counted = each.groupBy("host", "run").agg(F.count("*").alias("n")).where(F.col("n") >= shared_by)
    pages_of = found.where(F.col("run").isNull()).select("host", F.explode("contents").alias("content")).distinct().groupBy("host").agg(F.count("*").alias("of"))
    shared = counted.join(pages_of, "host").where(F.col("n") >= F.col("of") * share).select("host", "run")
    cut = base.mapInArrow(_cutter, f"page_id {kind}, url string, text string, page_key long, blocks array<struct<role:int,text:string>>")
    settled = cut.where(F.col("page_key").isNull()).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
    opened = written(cut.where(F.col("page_key").isNotNull()), "opened")  # read twice
    covered = occurring.join(shared, ["host", "run"]).distinct()
    places = covered.groupBy("page_key").agg(F.collect_set("place").alias("places"))
    chains = opened.select("page_key", "blocks").dropDuplicates(["page_key"]).join(places, "page_key").mapInArrow(_chains(length), "page_key long, block int, place int")
    chains = chains.join(covered, ["page_key", "place"]).groupBy("host", "page_key", "block").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    # pages that have all of a chain, counted once for all blocks of equal chains
    links = chains.select("host", "runs").distinct().select("host", "runs", F.explode("runs").alias("run")).withColumn("chain", F.xxhash64("runs"))
    having = links.join(each, ["host", "run"]).groupBy("host", "chain", "content").agg(F.count("*").alias("n"), F.max(F.size("runs")).alias("of")).where("n = of")
    whole = having.groupBy("host", "chain").agg(F.count("*").alias("n")).where(F.col("n") >= shared_by).join(pages_of, "host")
    whole = whole.where(F.col("n") >= F.col("of") * share).select("host", "chain")
    gone = chains.withColumn("chain", F.xxhash64("runs")).join(whole, ["host", "chain"]).groupBy("page_key").agg(F.collect_set("block").alias("gone"))
    kept = opened.join(gone, "page_key", "left").select("page_id", "url", "blocks", "gone")
    return settled.unionByName(kept.mapInArrow(_keeper, f"page_id {kind}, url string, text string, n_chars long"))
