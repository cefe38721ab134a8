"""HTML extraction with a host suffix array.

1. A page is read once, from left to right, by the rules of HTML for tags, attributes, comments and raw text, into blocks. Elements say what
   a block is: `main` inside <article> (else <main>), `chrome` in navigation, footers, forms, comments, adverts and the
   like, by element, role or a class or id that says just that, `open` otherwise; a form around an article or main is a wrapper. Names that may say it or something else
   ("related-work", "discussion", "social") and links that make up most of a block only mark a block of the article as doubtful.
2. The token streams of a host's chrome, open and doubtful blocks are concatenated, with an end after each block, and every position of
   RUN tokens or more is a suffix. They are refined by prefix doubling: suffixes of a host that share a prefix have the same name for
   its length, and a round counts the distinct pages of each name. Names of RUN tokens come first; suffixes whose name has the pages it needs
   try twice the length, and when no name of a length has them, the lengths between are found by halves. Where some suffixes of a name
   go on and others don't, those that go on stay in the shorter name too, so every name that is tried has all its suffixes. Thus each suffix ends with the
   deepest LCP interval that has enough pages, and its length: a repeat of any length is found whole, with its ends.
   The order between different prefixes isn't needed, so names are hashes, and a round is a count combined before its
   shuffle, which splits hot hosts and hot prefixes, in place of a range sort of ranks. Suffixes in no such interval are gone after
   the first round. A block shorter than RUN tokens is one suffix up to its end.
3. An interval of MIN_PAGES pages or more and the share SHARE of the host's pages is boilerplate (`repeats` lists those that no other
   covers). What it covers of open and doubtful
   blocks goes, and the unique runs stay: doubtful ones in pages with an article, open ones in pages without. Blocks
   in doubt by both name and links go whole. A block of the article that nothing speaks against goes only if it has RUN tokens or more
   and stands whole on the share SURE of the host's pages, SURE_PAGES at least.

Pages of a host with equal blocks are one page, so a copied article, or a page crawled twice, makes no boilerplate of itself.

Defined cases: null and empty html give an empty text; a null url is a host of its own; repeated pages are returned each;
a tag or comment that never ends takes the rest of the page; a quote that never ends is part of its value; raw elements
(scripts, frames and the like) that never end are skipped as tags only. Only page_id, url and html are read.
"""

from __future__ import annotations

import bisect
import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RUN, MIN_PAGES, SHARE, SURE, SURE_PAGES, LINKED = 8, 3, 0.2, 0.8, 5, 0.6

_TAG = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[^\s/>]+")
_SKIP, _SPACES = re.compile(r"[\s/]*"), re.compile(r"\s*")
_KEY, _VALUE = re.compile(r"=?[^\s/>=]*"), re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_GAP = re.compile(r"\s+")
#: Elements whose content is never text.
RAW = set("script style noscript template textarea title iframe svg object select datalist math canvas audio video xmp noembed noframes".split())
CHROME = set("nav footer aside form button dialog menu label fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note status".split())
#: Words of a class or id that say what an element is; words that may stand beside them; words that leave it in doubt.
SURE_NAMES = set("nav navbar navigation menu footer masthead sidebar side aside ad ads adv advert adverts advertisement advertising adbox adslot banner cookie cookies consent gdpr notice notices notification alert popup modal overlay promo promotion sponsor sponsored sponsoring comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs toolbar pagination pager".split())
BESIDE = set("form list item items box area section container wrapper wrap block bar inner outer top bottom left right primary secondary main page site global fixed sticky unit slot text title link links group panel row col column content body wide small large the for and to by on".split())
DOUBT_NAMES = SURE_NAMES | set("discussion related recommended widget search form header register login signup newsletter subscribe subscription share sharing social skip hidden teaser".split())
ARTICLE_NAMES = set("comment comments reply replies related recommended ad ads advert adverts advertisement sponsored promo teaser".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends if it is open, up to the named elements.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_WALLS = {"article", "main", "table", "td", "th"}


def tags(page: str):
    """(start, end, name, closing, attributes) of the page's tags; name "" is markup without meaning. Linear in the page's length."""
    last: dict[str, int] = {}

    def find(what: str, at: int) -> int:
        """Position of `what` from `at` on or -1; a search that failed once isn't made again."""
        if last.setdefault(what, len(page)) < at:
            return -1
        got = page.find(what, at)
        if got < 0:
            last[what] = at - 1
        return got

    n, at = len(page), 0
    while m := _TAG.search(page, at):
        start, i = m.start(), m.end()
        if page.startswith("!--", i):
            end = i + 4 if page.startswith("!-->", i) else find("-->", i + 3) + 3
            yield start, (end if end > 2 else n), "", False, {}
            at = end if end > 2 else n
            continue
        closing = page[i] == "/"
        if page[i] in "!?" or closing and not page[i + 1 : i + 2].isalpha():
            cdata = page.startswith("![CDATA[", i) and find("]]>", i)
            end = cdata + 3 if cdata and cdata > 0 else find(">", i) + 1
            if closing and page[i + 1 : i + 2] in ("", " ", "\n", "\t"):
                at = i  # no markup
                continue
            yield start, end or n, "", False, {}
            at = end or n
            continue
        name = _NAME.match(page, i + closing)
        i, found = name.end(), {}
        while True:
            i = _SKIP.match(page, i).end()
            if i >= n or page[i] == ">":
                break
            key = _KEY.match(page, i)
            i, value = _SPACES.match(page, key.end()).end(), ""
            if i < n and page[i] == "=":
                i = _SPACES.match(page, i + 1).end()
                end = find(page[i], i + 1) if i < n and page[i] in "\"'" else -1
                if end >= 0:
                    value, i = page[i + 1 : end], end + 1
                else:
                    got = _VALUE.match(page, i)
                    value, i = got[0], got.end()
            found.setdefault(key[0].lower(), value)
        end = min(i + 1, n)
        yield start, end, name[0].lower() if i < n else "", closing, found
        at = end


class _Raw:
    """Ends of raw elements."""

    def __init__(self, page: str):
        self.page, self.missing, self.flat = page, set(), set()

    def end(self, name: str, at: int) -> int | None:
        """Behind the end tag that closes `name`, or None if it never ends."""
        if name in self.missing:
            return None
        depth, first = 1, None
        for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(self.page, at):
            if m[1]:
                close = self.page.find(">", m.end())
                first = first or (len(self.page) if close < 0 else close + 1)
                depth -= 1
                if not depth or name in self.flat:
                    return first if name in self.flat else len(self.page) if close < 0 else close + 1
            elif name in ("svg", "object", "math", "template"):
                depth += 1
        (self.flat if first else self.missing).add(name)
        return first


def _named(found: dict[str, str], sure: set[str], doubt: set[str]) -> str:
    """'sure', 'doubt' or '': what class and id say. A name says chrome if all its words do or may stand beside one that does."""
    said = ""
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w for w in _WORDS.split(_CAMEL.sub(" ", token).lower()) if w and not w.isdigit()}
        if words & sure and words <= sure | BESIDE:
            return "sure"
        if words & doubt:
            said = "doubt"
    return said


def _says(tag: str, found: dict[str, str], inside: bool) -> str:
    """'sure', 'doubt' or '' for an element, inside an article or main or not."""
    if tag in CHROME or tag == "header" and not inside:
        return "sure"
    if not found or tag in ("html", "body", "main"):
        return ""
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "").lower()) or found.get("role", "").lower() in ROLES:
        return "sure"
    return _named(found, ARTICLE_NAMES, set()) if tag == "article" else _named(found, SURE_NAMES, DOUBT_NAMES)


def blocks(page: str) -> list[tuple[str, bool, bool, str]]:
    """(kind, doubtful, linked, text) of the page's non-empty blocks in page order; kinds: main, chrome, open."""
    out: list[list] = []
    text: list[str] = []
    aside: list[str] = []  # chrome inside a block
    linked = 0
    stack: list[tuple[str, str]] = []  # tag, what it says
    where: dict[str, list[int]] = {}  # of each open tag: its places in the stack
    walls: list[int] = []
    solid: list[int] = []  # places of block elements
    depth = {"sure": 0, "doubt": 0}
    depth_named: dict[int, bool] = {}  # of open forms: whether more than the element itself says chrome

    def count(tag: str) -> int:
        return len(where.get(tag, ()))

    def clean(parts: list[str]) -> str:
        return _GAP.sub(" ", entities.unescape("".join(parts))).strip()

    def flush() -> None:
        nonlocal linked
        got, beside = clean(text), clean(aside)
        if got:
            kind = "article" if count("article") else "main" if count("main") else "open"
            out.append([kind, depth["doubt"] > 0, linked >= LINKED * len(got), got])
        if beside:
            out.append(["chrome", False, False, beside])
        text.clear(), aside.clear()
        linked = 0

    def push(tag: str, said: str, named: bool = False) -> None:
        place = len(stack)
        if tag == "form":
            depth_named[place] = named
        stack.append((tag, said))
        where.setdefault(tag, []).append(place)
        if tag in _WALLS:
            walls.append(place)
        if tag in BLOCKS:
            solid.append(place)
        if said:
            depth[said] += 1
        elif tag in ("article", "main"):  # a form around an article is a wrapper
            for at_ in where.get("form", ()):
                if stack[at_][1] == "sure" and not depth_named[at_]:
                    stack[at_] = ("form", "")
                    depth["sure"] -= 1

    def pop_to(place: int) -> None:
        """Close all elements from `place` on."""
        if solid and solid[-1] >= place:
            flush()
        while len(stack) > place:
            tag, said = stack.pop()
            where[tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            if solid and solid[-1] == len(stack):
                solid.pop()
            if said:
                depth[said] -= 1

    def add(raw: str) -> None:
        nonlocal linked
        if depth["sure"]:
            aside.append(raw)
            return
        text.append(raw)
        if count("a"):
            linked += len(raw)

    raw, at = _Raw(page), 0
    for start, end, tag, closing, found in tags(page):
        if start < at:
            continue
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in RAW:
            if not closing:
                at = raw.end(tag, end) or end
                add(" ")
            continue
        if tag == "br":
            add(" ")
            continue
        if closing:
            if tag in BLOCKS:
                flush()
            place = where[tag][-1] if count(tag) else -1
            limit = -1 if tag in ("article", "main") or not walls else walls[-1]
            if tag not in BLOCKS and solid:
                limit = max(limit, solid[-1])
            if place >= 0 and place >= limit and tag not in ("html", "body"):
                pop_to(place)
            continue
        if tag in BLOCKS:
            flush()
            floor = walls[-1] if walls else -1
            if count("p") and where["p"][-1] > floor:
                pop_to(where["p"][-1])
        if tag in _ENDS:
            ends, stop = _ENDS[tag]
            floor = max((where[x][-1] for x in stop if count(x)), default=-1)
            floor = max([floor, *(w for w in walls[-1:] if stack[w][0] not in ends)])
            open_ = [places[k] for x in ends if (places := where.get(x)) and (k := bisect.bisect_right(places, floor)) < len(places)]
            if open_:
                pop_to(min(open_))
        if tag in VOID:
            continue
        said = _says(tag, found, bool(count("article") or count("main")))
        if said == "doubt" and tag not in BLOCKS:
            said = ""
        push(tag, said, tag == "form" and _says("div", found, False) == "sure")
    add(page[at:])
    pop_to(0)
    flush()
    top = "article" if any(b[0] == "article" for b in out) else "main"
    return [("main" if k == top else "chrome" if k == "chrome" else "open", d, l, t) for k, d, l, t in out]


def tokens(text: str) -> np.ndarray:
    """Codes of the tokens."""
    return np.array([xxhash.xxh3_64_intdigest(t) for t in text.split()], np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def names(codes: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of the substrings of `length` tokens from `at`: equal for equal ones. Made from names of powers of two, longest first."""
    out, top = length.astype(np.uint64), int(length.max(initial=0)).bit_length()
    powers = [codes]
    for k in range(1, top):
        half = 1 << (k - 1)
        powers.append(_mixed(powers[-1][:-half], powers[-1][half:]))
    at = at.copy()
    for k in range(top - 1, -1, -1):
        has = np.flatnonzero((length >> k) & 1)
        out[has] = _mixed(out[has], powers[k][at[has]])
        at[has] += 1 << k
    return out.view(np.int64)


def starts(ends: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lengths) of the first names: `run` tokens, or all of a shorter block."""
    sizes = np.diff(ends, prepend=0)
    first = np.where(_left(ends) >= run, run, 0)
    short = (sizes > 0) & (sizes < run)
    first[(ends - sizes)[short]] = sizes[short]
    at = np.flatnonzero(first)
    return at, first[at]


def _left(ends: np.ndarray) -> np.ndarray:
    """Tokens from each position to the end of its block."""
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(ends[-1] if len(ends) else 0)


def longer(lengths: np.ndarray, step: int, run: int) -> np.ndarray:
    """The lengths that suffixes of these lengths try in a round, 0 for none. -s: twice the length s; s: s more, where the double is out."""
    if step < 0:
        return np.where(lengths == -step, -2 * step, 0)
    doubled = run << np.floor(np.log2(np.maximum(lengths // run, 1))).astype(np.int64)
    return np.where((lengths >= run) & (step < doubled), lengths + step, 0)


def halves(double: int, run: int) -> list[int]:
    """Steps after no name of the length `double` * 2 has its pages."""
    return [run << k for k in range((double // run).bit_length() - 2, -1, -1)] + [1 << k for k in range((run - 1).bit_length() - 1, -1, -1)]


def maximal(lengths: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(block, start, end in the block) of the intervals that no other of the block covers."""
    out, at = [], 0
    for b, end in enumerate(ends):
        reached = at
        for i in np.flatnonzero(lengths[at:end]) + at:
            if i + lengths[i] > reached:
                reached = i + lengths[i]
                out.append((b, int(i - at), int(reached - at)))
        at = end
    return out


def unique_runs(text: str, repeated: list[tuple[int, int]]) -> list[str]:
    """What repeated intervals leave of a block; what stands on both sides of one becomes two blocks."""
    if not repeated:
        return [text]
    words = text.split()
    covered = [False] * len(words)
    for start, end in repeated:
        covered[start:end] = [True] * (end - start)
    out: list[str] = []
    piece: list[str] = []
    for word, gone in zip([*words, ""], [*covered, True]):
        if gone and piece:
            out.append(" ".join(piece))
            piece = []
        elif not gone:
            piece.append(word)
    return out


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_BLOCK = pa.struct([("kind", pa.string()), ("doubt", pa.bool_()), ("linked", pa.bool_()), ("text", pa.string()), ("key", pa.int64())])
_PARSED = "page_id long, url string, host string, page_key long, blocks array<struct<kind:string,doubt:boolean,linked:boolean,text:string,key:bigint>>, asked boolean"


def _parse(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = [blocks(x) if x else [] for x in part.column("html").to_pylist()]
            has = [any(b[0] == "main" for b in page) for page in found]
            asked = [any((k == "main" and (d or l)) if h else k == "open" for k, d, l, _ in page) for page, h in zip(found, has)]
            keys = [xxhash.xxh3_64_intdigest("\x00".join(b[3] for b in page if not h or b[0] == "main")) - (1 << 63) for page, h in zip(found, has)]
            rows = [[dict(zip(("kind", "doubt", "linked", "text", "key"), (*b, _key(b[3])))) for b in page] for page in found]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host")), pa.array(keys, pa.int64()), pa.array(rows, pa.list_(_BLOCK)), pa.array(asked, pa.bool_())], ["page_id", "url", "host", "page_key", "blocks", "asked"])



_STATE = "host string, page_key long, need long, asked boolean, codes binary, ends array<long>, keys array<long>, own array<boolean>, at array<long>, lengths array<long>, names array<long>, past array<long>, past_lengths array<long>, past_names array<long>, failed array<long>"
_SPANS = "host string, page_key long, name long, length long, start long, end long, block long, own boolean"
_NONE = np.zeros(0, np.int64)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _rows_of(batches, schema: str, turn):
    """Batches of `turn(row)` of the rows, without those that give nothing."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = [x for r in batch.slice(lo, 256).to_pylist() if (x := turn(r)) is not None]
            if rows:
                yield _batch(rows, schema)


def _array(x) -> np.ndarray:
    return np.array(x if x is not None else [], np.int64)


def _fixed(r: dict) -> list:
    return [r[c] for c in ("host", "page_key", "need", "asked", "codes", "ends", "keys", "own")]


def _start(run: int):
    """Distinct pages with evidence -> their token stream and the first names, lengths not reached yet."""

    def turn(r):
        page = [b for b in r["evidence"] if b["text"]]
        parts = [tokens(b["text"]) for b in page]
        if not sum(map(len, parts)):
            return None
        codes, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts], dtype=np.int64)
        kind = "main" if r["has_main"] else "open"
        at, length = starts(ends, run)
        return [r["host"], r["page_key"], r["need"], r["asked"], codes.tobytes(), ends, [b["key"] for b in page], [b["kind"] == kind for b in page], at, length, names(codes, at, length), _NONE, _NONE, _NONE, _NONE]

    return lambda batches: _rows_of(batches, _STATE, turn)


def _pass(step: int, run: int):
    """State and the names that passed -> suffixes with the lengths they reached; the lengths they left behind (past), and the names of those that stay there (failed)."""

    def turn(r):
        codes, left = np.frombuffer(r["codes"], np.uint64), _left(_array(r["ends"]))
        at, lengths, named = _array(r["at"]), _array(r["lengths"]), _array(r["names"])
        passed = _array(r["passed"])
        if not step:
            good = np.isin(named, passed)
            return [*_fixed(r), at[good], lengths[good], _NONE, _NONE, _NONE, _NONE, _NONE]
        tries = longer(lengths, step, run)
        able = (tries > 0) & (tries <= left[at])
        good = np.zeros(len(at), bool)
        good[able] = np.isin(named, passed)
        stays = (tries > 0) & ~good
        past = names(codes, at[good], lengths[good])
        return [*_fixed(r), np.concatenate([at[~good], at[good]]), np.concatenate([lengths[~good], tries[good]]), _NONE, at[good], lengths[good], past, names(codes, at[stays], lengths[stays])]

    return lambda batches: _rows_of(batches, _STATE, turn)


def _propose(step: int, run: int):
    """State and the names that some suffixes stay in (mixed) -> all suffixes of those names, and the names to try next."""

    def turn(r):
        codes, left = np.frombuffer(r["codes"], np.uint64), _left(_array(r["ends"]))
        mixed = np.isin(_array(r["past_names"]), _array(r["mixed"]))
        at, lengths = (np.concatenate([_array(r[c]), _array(r[f"past{p}"])[mixed]]) for c, p in (("at", ""), ("lengths", "_lengths")))
        tries = longer(lengths, step, run)
        able = (tries > 0) & (tries <= left[at])
        return [*_fixed(r), at, lengths, names(codes, at[able], tries[able]), _NONE, _NONE, _NONE, _NONE]

    return lambda batches: _rows_of(batches, _STATE, turn)


def _spans(batches):
    """Final state -> the intervals that no other covers."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows: list[tuple] = []
            for r in batch.slice(lo, 256).to_pylist():
                codes, ends = np.frombuffer(r["codes"], np.uint64), _array(r["ends"])
                lengths = np.zeros(len(codes), np.int64)
                np.maximum.at(lengths, _array(r["at"]), _array(r["lengths"]))
                found = maximal(lengths, ends)
                if found:
                    block, start, end = (np.array(x, np.int64) for x in zip(*found))
                    name = names(codes, np.concatenate([[0], ends])[block] + start, end - start)
                    rows += [(r["host"], r["page_key"], int(n), e - s, s, e, r["keys"][b], r["own"][b] and r["asked"]) for n, (b, s, e) in zip(name, found)]
            yield _batch(rows, _SPANS)


def _told(state: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """The state beside those names in `column` that are known: (host, name)."""
    own = state.select("host", "page_key", F.explode(F.array_distinct(column)).alias("name"))
    hit = C.written(C.join_checked(own, known, ["host", "name"], "inner").groupBy("host", "page_key").agg(F.collect_list("name").alias(name)))
    return C.join_checked(state, hit, ["host", "page_key"], "left")


def _intervals(once: DataFrame, run: int) -> DataFrame:
    """Spans (`_SPANS`) of the distinct pages (host, page_key, need, asked, has_main, evidence), by prefix doubling."""
    state = C.written(once.mapInArrow(C.trimmed(_start(run)), _STATE))
    step, steps = 0, []
    while True:
        tried = state.select("host", "need", F.explode(F.array_distinct("names")).alias("name"))
        frequent = C.written(tried.groupBy("host", "name").agg(F.count("*").alias("pages"), F.max("need").alias("need")).where("pages >= need").select("host", "name"))
        some = not frequent.isEmpty()
        if step <= 0 and some:
            double = max(run, -2 * step)
            following, steps = -double, halves(double, run)
        elif step == 0:
            following = None
        else:
            following = steps.pop(0) if steps else None
        if some:  # else all stay where they are
            told = _told(state, "names", frequent, "passed")
            told = told.where("passed is not null") if step == 0 else told
            state, last = C.written(told.mapInArrow(C.trimmed(_pass(step, run)), _STATE)), state
            C.tidy(last)
            if step == 0 and state.where(F.exists("lengths", lambda x: x >= run)).isEmpty():  # short blocks only
                following = None
        elif step == 0:
            state = state.limit(0)
        if following is None:
            return C.written(state.mapInArrow(C.trimmed(_spans), _SPANS))
        mixed = C.written(state.select("host", F.explode(F.array_distinct("failed")).alias("name")).distinct())
        state, last = C.written(_told(state, "past_names", mixed, "mixed").mapInArrow(C.trimmed(_propose(following, run)), _STATE)), state
        C.tidy(last)
        step = following


def _finish():
    def go(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, gone = [], []
                for page, repeated, sure in zip(*(part.column(c).to_pylist() for c in ("blocks", "repeated", "sure"))):
                    has, sure, kept, cut = any(b["kind"] == "main" for b in page), set(sure or ()), [], 0
                    held: dict[int, list[tuple[int, int]]] = {}
                    for x in repeated or ():
                        held.setdefault(x["block"], []).append((x["start"], x["end"]))
                    for i, b in enumerate(page):
                        if b["kind"] == "chrome" or has and b["kind"] != "main":
                            continue
                        if has and not b["doubt"] and not b["linked"]:
                            left = [] if i in sure else [b["text"]]
                        elif has and b["doubt"] and b["linked"]:
                            left = []
                        else:
                            left = unique_runs(b["text"], held.get(b["key"], []))
                        cut += left != [b["text"]]
                        kept += left
                    texts.append("\n".join(kept))
                    gone.append(cut)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "n_cut_blocks"])

    return go


def _distinct(parsed: DataFrame, run: int, min_pages: int) -> DataFrame:
    """One page for each different content of a host: what of it is in evidence, hashes of the article's plain blocks, and the pages a repeat needs."""
    plain = F.transform("blocks", lambda b, i: F.struct(i.alias("i"), F.xxhash64(b["text"]).alias("h"), F.size(F.split(b["text"], " ")).alias("words"), ((b["kind"] == "main") & ~b["doubt"] & ~b["linked"]).alias("plain")))
    plain = F.transform(F.filter(plain, lambda x: x["plain"] & (x["words"] >= run)), lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h")))
    evidence = F.filter("blocks", lambda b: (b["kind"] != "main") | b["doubt"] | b["linked"])
    seen = parsed.select("page_id", "host", "page_key", "asked", F.exists("blocks", lambda b: b["kind"] == "main").alias("has_main"), evidence.alias("evidence"), plain.alias("plain"))
    once = C.written(seen.groupBy("host", "page_key").agg(F.min_by(F.struct("asked", "has_main", "evidence", "plain"), F.coalesce("page_id", F.lit(1 << 62))).alias("r")).select("host", "page_key", "r.*"))
    sizes = C.written(once.groupBy("host").agg(F.count("*").alias("host_pages")))
    return C.join_checked(once, sizes, ["host"], "inner").withColumn("need", F.greatest(F.lit(min_pages), F.ceil(F.col("host_pages") * SHARE)).cast("long"))


def _parsed(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    return C.written(rows.mapInArrow(C.trimmed(_parse), _PARSED))


def repeats(pages: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host and repeated substring: host, n_tokens, n_pages (distinct pages on which no longer one covers it), text. Words are apart by one space."""
    parsed = _parsed(pages)
    spans = _intervals(_distinct(parsed, run, min_pages), run)
    found = spans.groupBy("host", "name", "length").agg(F.count_distinct("page_key").alias("n_pages"), F.min(F.struct("block", "start", "end")).alias("at"))
    texts = parsed.select("host", F.explode("blocks").alias("b")).select("host", F.col("b.key").alias("block"), F.col("b.text").alias("text")).dropDuplicates(["host", "block"])
    words = F.slice(F.split("text", " "), F.col("at.start").cast("int") + 1, F.col("length").cast("int"))
    return found.withColumn("block", F.col("at.block")).join(texts, ["host", "block"]).select("host", F.col("length").alias("n_tokens"), "n_pages", F.array_join(words, " ").alias("text"))


def extract(pages: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_cut_blocks (blocks of the text that repetition, or links, cut)."""
    parsed = _parsed(pages)
    once = _distinct(parsed, run, min_pages)
    spans = _intervals(once.select("host", "page_key", "need", "asked", "has_main", "evidence"), run).where("own")
    covered = C.written(spans.groupBy("host", "page_key").agg(F.collect_set(F.struct("block", "start", "end")).alias("repeated")))

    # Whole blocks of articles that hardly any page of the host is without.
    plain = once.select("host", "page_key", "host_pages", F.explode("plain").alias("b")).select("host", "page_key", "host_pages", "b.i", "b.h")
    common = plain.groupBy("host", "h").agg(F.count_distinct("page_key").alias("pages"), F.max("host_pages").alias("host_pages")).where(F.col("pages") >= SURE_PAGES)
    common = C.written(common.where(F.col("pages") >= F.col("host_pages") * SURE).select("host", "h"))
    sure = C.written(C.join_checked(plain, common, ["host", "h"], "inner").groupBy("host", "page_key").agg(F.collect_set("i").alias("sure")))

    joined = C.join_checked(C.join_checked(parsed, covered, ["host", "page_key"], "left"), sure, ["host", "page_key"], "left").select("page_id", "url", "blocks", "repeated", "sure")
    out = joined.mapInArrow(C.trimmed(_finish()), "page_id long, url string, text string, n_cut_blocks long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_cut_blocks")
