"""Main text of web pages by nearest-URL page differencing.

Pages of a host are paired with the page whose URL path is nearest in sorted order and whose lines
are others. The text lines of the pair are aligned by their longest common subsequence, and lines
that both have are template text and go. The words of menus, adverts and footers change from page
to page, so lines of such a block, and on a page with an article all lines beside it, are aligned
by the block's place in the markup. Over all pairs it is counted how often a place recurs in the
nearest page: lines go only with a place that was seen to recur on their host, or on other hosts as
far as their own says little. A place that no pair has seen twice stays. Lines of an article or
main element that no place claims stay too, since two pages may carry the same sentence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, salted_join, text_batches

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_VALUE = re.compile(r"=\s*\Z")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold text of an article.
_NEVER = set("head form button select svg canvas audio video object dialog".split())
#: Elements that propose a place of the template.
_PROPOSED = set("nav footer aside menu".split())
#: Words of class, id and role that propose one.
_MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar cookie cookies notice consent gdpr "
    "newsletter subscribe popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar share sharing social related "
    "recommended widget pagination pager login signup search alert complementary contentinfo".split()
)
#: Words that may stand beside them in a compound name: ad-box is a mark, share-price is none.
_BESIDE = set("area bar block bottom box button buttons column container content group inner item items left link links list main outer panel right row section site slot top wrap wrapper unit".split())
#: Beginnings of such words, as sites write them together (advertbox).
_MARK_STARTS = ("advert", "sidebar", "cookie", "newsletter", "breadcrumb", "navbar", "sponsor")
#: Reader comments; two pages never share them, so differencing cannot find them.
_COMMENTS = re.compile(r"comments?(?!ar)|repl(?:y|ies)|disqus|discussion")
#: Marks of parts that may hold elements named article which are none.
_NO_ARTICLE = ("comment", "repl", "related", "recommend", "promo", "disqus")
_HEADERS = {"header", "topbar", "banner"}
_MAIN = {"article", "main"}
_LIST_PARTS = {"li", "dt", "dd", "tr", "td", "th", "option"}
#: Elements whose place is that of the element around them.
_LINES = _LIST_PARTS | set("p h1 h2 h3 h4 h5 h6 br hr blockquote pre figcaption caption summary legend address tbody thead tfoot center ul ol dl".split())

#: Sightings on its own host that outweigh those on all hosts, and the share of recurrences from which a place is the template's.
OTHERS, RECURS = 8.0, 0.25
#: Numbers of a small table that a join may broadcast; above it both sides are shuffled.
BROADCAST_NUMBERS = 2_000_000
#: Pages of a run of equal ones that a task holds back; those of a longer run go on at once and are joined with what the run is compared with.
RUN_ROWS = 1000
#: White space that may stand between an equals sign and its value.
SPACES = 100
#: Longer places of nested elements are named by their hash.
LONGEST_PLACE = 200


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _is_mark(token: str) -> bool:
    parts = [p for p in re.split(r"[_-]+|\d+", token) if p]
    return any(p in _MARKS for p in parts) and all(p in _MARKS or p in _BESIDE for p in parts) or token.startswith(_MARK_STARTS)


class Tags:
    """Finds the tags, comments and declarations of a page, each character in a bounded number of looks.

    A quote opens a value only behind an equals sign. One that is never closed, or whose value runs
    over other tags up to the next value's quote, is left out of account, so that the tag ends at
    the next >. A tag without any > behind it is no tag, and a comment without an end reaches to
    the end of the page.
    """

    def __init__(self, source: str):
        self.source = source
        self.last_end = source.rfind(">")
        self.last_quote = {q: source.rfind(q) for q in "\"'"}

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next one; comments and declarations have no name."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                stop = source.find("-->", start + 4)
                return start, stop + 3 if stop >= 0 else len(source), "", "", ""
            if start > self.last_end:
                return None
            if source.startswith(("<!", "<?"), start):
                return start, source.find(">", start) + 1, "", "", ""
            name = _NAME.match(source, start + 1)
            if name is not None:
                end = self._end(name.end())
                return start, end, name[1], name[2].lower(), source[name.end() : end - 1]
            at = start + 1
        return None

    def _end(self, behind_name: int) -> int:
        """The end of a tag, which is behind a > that stands in no value."""
        source, at = self.source, behind_name
        while stop := _STOP.search(source, at):
            at, quote = stop.end(), stop[0]
            if quote == ">":
                return at
            if self.last_quote[quote] < at or not _VALUE.search(source, max(behind_name, at - 1 - SPACES), at - 1):
                continue
            close = source.find(quote, at)
            inner = source.find(">", at, close)
            if inner < 0 or source[close - 1] != "=" or source.find("<", inner, close) < 0:
                at = close + 1
        return source.find(">", behind_name) + 1  # the last > stands in a value


class _Open:
    """An open element: its place, and what holds for the lines inside."""

    __slots__ = ("name", "main", "dropped", "proposed", "closed", "place")

    def __init__(self, name: str = "", main: bool = False, dropped: bool = False, proposed: str | None = None, closed: bool = False, place: str = ""):
        self.name, self.main, self.dropped, self.proposed, self.closed, self.place = name, main, dropped, proposed, closed, place


_ROOT = _Open()


class Lines:
    """Lines of a page that may be text: what stands in forms, comments and hidden parts is left out.

    For each line: `text`; `main`, whether an article holds it and no place claims it; `place`, the
    place of the template that the markup proposes for it, or None. On a page with an article,
    every place outside of it is proposed.
    """

    def __init__(self, source: str):
        self.text: list[str] = []
        self.main: list[bool] = []
        self.place: list[str | None] = []
        self._around: list[str] = []
        self._words: list[str] = []
        self._open: list[_Open] = []
        self._names: dict[str, int] = {}
        tags, at = Tags(source), 0
        while tag := tags.after(at):
            start, end, slash, name, attributes = tag
            self._add(source[at:start])
            at = end
            if not name:
                continue
            if slash:
                self._close(name)
            elif name in _RAW and not attributes.endswith("/"):
                # these hold no markup, whatever it looks like
                stop = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = stop.end() if stop else len(source)
                if name in _BLOCKS:
                    self._flush()
            else:
                self._start(name, attributes)
        self._add(source[at:])
        self._flush()
        if any(self.main):
            self.place = [None if m else p or f"beside {a}" for m, p, a in zip(self.main, self.place, self._around, strict=True)]

    def _top(self) -> _Open:
        return self._open[-1] if self._open else _ROOT

    def _add(self, text: str) -> None:
        if text and not self._top().dropped:
            self._words.append(html.unescape(text) if "&" in text else text)

    def _push(self, element: _Open) -> None:
        if len(element.place) > LONGEST_PLACE:
            element.place = f"{_number(element.place):x}"
        self._open.append(element)
        self._names[element.name] = self._names.get(element.name, 0) + 1

    def _pop(self) -> str:
        name = self._open.pop().name
        self._names[name] -= 1
        return name

    def _flush(self) -> None:
        line = " ".join("".join(self._words).split())
        self._words = []
        if line:
            top = self._top()
            self.text.append(line)
            self.main.append(top.main and top.proposed is None)
            self.place.append(top.proposed)
            self._around.append(top.place)

    def _start(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            self._flush()
            if name != "br" and self._open and self._open[-1].name == "p":
                self._pop()
        if name in _VOID:
            return
        if name in _LIST_PARTS and self._open and self._open[-1].name == name:
            self._pop()
        top = self._top()
        main, dropped, proposed = top.main, top.dropped, top.proposed
        tokens: list[str] = []
        given: dict[str, str] = {}
        if "=" in attributes or "hidden" in attributes:
            given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            tokens = " ".join(given.get(k, "") for k in ("class", "id", "role")).lower().split()
            dropped |= "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        if name not in _BLOCKS and name not in _NEVER:
            if dropped and not top.dropped:  # a hidden part of a line
                self._push(_Open(name, main, True, proposed, top.closed, top.place))
            return
        words = {w for t in tokens for w in re.split(r"[_-]+", t)}
        apart = any(w.startswith(_NO_ARTICLE) for w in words)
        if name in _MAIN and not main and not top.closed:
            dropped, proposed = False, None  # an element before the article was not ended
        inside = main
        main |= name in _MAIN or ("main" in words and "role" in given and name in ("div", "section"))
        place = top.place if name in _LINES and not tokens else f"{top.place}>{name}{''.join('.' + re.sub(r'[0-9]+', '0', t) for t in sorted(set(tokens)))}"
        if name not in ("body", "html"):
            dropped |= name in _NEVER or any(_COMMENTS.match(w) for w in words)
            claims = name in _PROPOSED or any(map(_is_mark, tokens)) if name not in _MAIN else apart or "ad" in words
            if proposed is None and (claims or not inside and (name == "header" or words & _HEADERS)):
                proposed = place
        self._push(_Open(name, main, dropped, proposed, top.closed or apart or name == "aside", place))

    def _close(self, name: str) -> None:
        if name in _BLOCKS:
            self._flush()
        while self._names.get(name) and self._pop() != name:
            pass

    def keys(self) -> list[int]:
        """What lines are aligned by: the place where one is proposed, else the text."""
        return [_number(t if p is None else f"\0{p}") for t, p in zip(self.text, self.place, strict=True)]

    def chosen(self, shared: set[int], recurring: frozenset[int] | set[int] = frozenset()) -> list[str]:
        """The text: lines without those that the nearest page shares and those of recurring places.

        shared has the places of lines (neither main nor proposed) that the paired page has too,
        recurring the numbers of proposed places that differencing confirmed. Where the paired page
        has every such line and nothing else is left, they cannot be told from the template: all
        stay.
        """
        left = [main or (k not in shared if place is None else _number(f"\0{place}") not in recurring) for k, (main, place) in enumerate(zip(self.main, self.place, strict=True))]
        if not any(left):
            left = [place is None for place in self.place]
        return [t for t, stays in zip(self.text, left, strict=True) if stays]


def common_places(a: list[int], b: list[int]) -> list[int]:
    """Places of a that belong to a longest common subsequence of a and b.

    Rows of the recurrence are bit vectors in whole numbers. Only some rows are kept and those
    between are made again on the way back, so memory grows with the root of the length.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [*range(head), *range(len(a) - tail, len(a))]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        return ends
    at: dict[int, int] = {}
    for k, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << k
    full = (1 << len(y)) - 1

    def rows(row: int, part: list[int]) -> list[int]:
        """The row before `part` and those after each of its lines."""
        found = [row]
        for v in part:
            both = row & at.get(v, 0)
            row = (row + both | row - both) & full
            found.append(row)
        return found

    step = isqrt(len(x)) + 1
    starts = [full]
    for k in range(0, len(x), step):
        starts.append(rows(starts[-1], x[k : k + step])[-1])
    inner, j = [], len(y)
    for part in range((len(x) - 1) // step, -1, -1):
        made = rows(starts[part], x[part * step : (part + 1) * step])
        for i in range(len(made) - 1, 0, -1):
            # a cleared bit k marks that the length grows at place k of y
            while j and (made[i] >> (j - 1)) & 1:
                j -= 1
            if not j:
                break
            if (made[i - 1] >> (j - 1)) & 1 or _length(made[i - 1], j) < _length(made[i], j):
                inner.append(part * step + i - 1)
                j -= 1
        if not j:
            break
    return sorted({*ends, *(head + k for k in inner)})


def _length(row: int, places: int) -> int:
    return places - (row & ((1 << places) - 1)).bit_count()


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _nearer(path: str, before: tuple | None, after: tuple | None) -> tuple | None:
    """The one of two pages (path, ...) whose path is nearer."""
    return max((p for p in (before, after) if p is not None), key=lambda p: _near(path, p[0]), default=None)


def _sides(lines: list[int], before: tuple | None, after: tuple | None) -> list[tuple | None]:
    """(path, shared places) for each of two neighbours (host, path, lines) of a run."""
    return [p and (p[1], common_places(lines, p[2])) for p in (before, after)]


def _page_keys(pages: DataFrame) -> DataFrame:
    """A row for each page: its key columns, host, path, the keys of its lines, and their kinds.

    kinds has for each line 0 if it is main, 1 if a place is proposed, 2 if neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in text_batches(batches, "html"):
            found = [Lines(s) for s in sources]
            kinds = [bytes(0 if m else 1 if p is not None else 2 for m, p in zip(f.main, f.place, strict=True)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("sig"), pa.array([f.keys() for f in found], pa.list_(pa.int64())), pa.array(kinds, pa.binary())], names=["page_id", "url", "sig", "lines", "kinds"]
            )

    keys = pages.mapInArrow(run, "page_id long, url string, sig long, lines array<long>, kinds binary")
    place = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return keys.select("page_id", "sig", "lines", "kinds", F.lower(place).alias("host"), path.alias("path"))


_SORTED = ("host", "path", "page_id", "sig")
_PAGE = "page_id long, sig long, host string"
_SIDES = "before_path string, before_shared array<int>, after_path string, after_shared array<int>"
_PAIRED = f"{_PAGE}, path string, kinds binary, shared array<int>, places array<long>, seen array<long>, compared boolean, pid int, nth int, first boolean, last boolean, last_path string, lines array<long>, in_path string, in_lines array<long>, {_SIDES}"
_COMPARED = f"{_PAGE}, kinds binary, shared array<int>, places array<long>, seen array<long>, compared boolean"
_EDGES = f"pid int, nth int, lines array<long>, {_SIDES}"
#: A row of a task's result: a page that is compared (nth -1), one that waits for its run, a run, or a run at the task's edge.
_BLANK = dict.fromkeys(c.split()[0] for c in _PAIRED.split(", ")) | {"sig": 0, "compared": False, "nth": -1, "first": False, "last": False}


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page_id, sig, host, kinds, shared, places, seen, compared) for each page.

    shared has the places of lines that the nearest page has too, places the numbers of the page's
    proposed places and seen those of them that recur there; compared is false for a page
    without a partner. The nearest page is the nearest one of the host with other lines: pages with
    equal lines that follow each other are one run, and the pages beside the run are the neighbours
    of them all. Pages are range-partitioned by host and path, so a large host spreads over many
    tasks. The first and last run of a task wait for the neighbouring tasks': these are two rows
    for each task, which windows over (task, run) put beside each other. A run of more than
    RUN_ROWS pages is not held: its pages go on and are joined with the run.
    """
    keys = cut_lineage(_page_keys(pages))
    ranged = keys.repartitionByRange(*_SORTED).sortWithinPartitions(*_SORTED)
    most = RUN_ROWS

    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        before, run, rows, closed, waits = None, None, [], 0, False  # run is (host, first path, lines)

        def close(after: tuple | None, last: bool) -> list[dict]:
            left, right = (p if p and p[0] == run[0] else None for p in (before, after))
            known = _BLANK | {"host": run[0], "path": run[1], "pid": pid, "nth": closed, "first": not closed, "last": last, "lines": run[2]}
            if known["first"] or last:
                inner = right if not last else left
                found = known | {"last_path": rows[-1]["path"], "in_path": inner and inner[1], "in_lines": inner and inner[2]}
                return [waiting(r) for r in rows] + [found]
            sides = _sides(run[2], left, right)
            if not waits:
                return [_BLANK | r | _compared(run[2], r["kinds"], _nearer(r["path"], *sides)) for r in rows]
            return [waiting(r) for r in rows] + [known | _side_columns(sides)]

        def waiting(row: dict) -> dict:
            return _BLANK | row | {"pid": pid, "nth": closed}

        for frame in frames:
            made = []
            for new in frame.itertuples(index=False):
                lines = list(map(int, new.lines))
                if run is None or (new.host, lines) != (run[0], run[2]):
                    if run is not None:
                        made += close((new.host, new.path, lines), False)
                        closed += 1
                        before = (run[0], rows[-1]["path"], run[2])
                    run, rows, waits = (new.host, new.path, lines), [], False
                if len(rows) >= most:
                    made += map(waiting, rows)
                    rows, waits = [], True
                rows.append({"page_id": new.page_id, "sig": new.sig, "host": new.host, "path": new.path, "kinds": new.kinds})
            if made:
                yield pd.DataFrame(made).astype({"page_id": "Int64"})
        if run is not None:
            yield pd.DataFrame(close(None, True)).astype({"page_id": "Int64"})

    paired = cut_lineage(ranged.mapInPandas(pair, _PAIRED))

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples(index=False):
                lines = list(map(int, r.lines))
                sides = [None if b is None else (None, p, list(map(int, b))) for p, b in ((r.before_path, r.before_lines), (r.after_path, r.after_lines))]
                made.append({"pid": r.pid, "nth": r.nth, "lines": lines} | _side_columns(_sides(lines, *sides)))
            if made:
                yield pd.DataFrame(made)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples(index=False):
                sides = (None if p is None else (p, s) for p, s in ((r.before_path, r.before_shared), (r.after_path, r.after_shared)))
                made.append({"page_id": r.page_id, "sig": r.sig, "host": r.host, "kinds": r.kinds} | _compared(list(map(int, r.lines)), r.kinds, _nearer(r.path, *sides)))
            if made:
                yield pd.DataFrame(made).astype({"page_id": "Int64"})

    runs, rows = paired.filter("lines IS NOT NULL"), paired.filter("lines IS NULL")
    edges = _beside(runs.filter("first OR last")).repartition("pid").mapInPandas(align, _EDGES)
    edges = edges.unionByName(runs.filter("NOT (first OR last)").select(*edges.columns))
    page = ["page_id", "sig", "host", "kinds", "shared", "places", "seen", "compared"]
    waiting = salted_join(rows.filter("nth >= 0").select(*page[:4], "path", "pid", "nth"), edges, ["pid", "nth"])
    return rows.filter("nth < 0").select(*page).unionByName(waiting.mapInPandas(choose, _COMPARED))


def _side_columns(sides: list[tuple | None]) -> dict:
    return {f"{side}_{c}": p and p[k] for side, p in zip(("before", "after"), sides, strict=True) for k, c in enumerate(("path", "shared"))}


def _compared(lines: list[int], kinds: bytes, near: tuple | None) -> dict:
    """What the nearest page (path, shared places) says of a page."""
    shared = near[1] if near else []
    places = {v for v, k in zip(lines, kinds, strict=True) if k == 1}
    return {"shared": shared, "places": sorted(places), "seen": sorted(places & {lines[k] for k in shared}), "compared": near is not None}


def _beside(waits: DataFrame) -> DataFrame:
    """pid, nth, lines, and path and lines before and after each task's outer runs.

    A run that goes on in the next task is followed to where other lines begin.
    """
    order = Window.partitionBy("host").orderBy("pid", "nth")
    back = Window.partitionBy("host").orderBy(F.desc("pid"), F.desc("nth"))
    none = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<bigint>").alias("lines"))
    inner = F.when(F.col("in_path").isNotNull(), F.struct(F.col("in_path").alias("path"), F.col("in_lines").alias("lines"))).otherwise(none)

    def neighbour(w, path: str):
        same = F.lag("lines").over(w) == F.col("lines")
        return F.when(F.lag("pid").over(w).isNull(), none).when(~same, F.struct(F.lag(path).over(w).alias("path"), F.lag("lines").over(w).alias("lines")))

    # null where the run goes on: the value of the run's row before counts
    seen = waits.withColumns({"b": F.when(~F.col("first"), inner).otherwise(neighbour(order, "last_path")), "a": F.when(~F.col("last"), inner).otherwise(neighbour(back, "path"))})
    found = seen.select("pid", "nth", "lines", F.last("b", ignorenulls=True).over(order).alias("b"), F.last("a", ignorenulls=True).over(back).alias("a"))
    return found.select("pid", "nth", "lines", *[F.col(f"{s}.{c}").alias(f"{side}_{c}") for s, side in (("b", "before"), ("a", "after")) for c in ("path", "lines")])


def recurring_places(rows: DataFrame, others: float = OTHERS, recurs: float = RECURS) -> DataFrame:
    """(host, place): proposed places that recur in the nearest pages of the host.

    A host's own sightings are added to the share of recurrences on all hosts, which counts as
    `others` sightings, so a host with few or no pairs goes by the others. A place that was seen
    in no pair is not among them.
    """
    each = rows.select("host", "seen", "compared", F.explode("places").alias("place"))
    tally = cut_lineage(each.groupBy("host", "place").agg(F.count_if("compared").alias("n"), F.count_if(F.col("compared") & F.array_contains("seen", F.col("place"))).alias("same")))
    every = tally.groupBy("place").agg((F.sum("same") / F.sum("n")).alias("usual")).filter("usual > 0")
    share = (F.col("same") + others * F.col("usual")) / (F.col("n") + others)
    return salted_join(tally, every, ["place"]).filter(share >= recurs).select("host", "place")


def page_decisions(pages: DataFrame) -> DataFrame:
    """(page_id, sig, shared, recurring) for each different page that differencing takes lines from.

    shared has the places of lines without a place of their own that the nearest page shares,
    recurring the numbers of its proposed places that recur.
    """
    rows = cut_lineage(shared_lines(pages))
    key = ["page_id", "sig"]
    plain = F.filter("shared", lambda i: F.substring(F.col("kinds"), i + 1, F.lit(1)) == F.lit(bytes([2])))
    taken = rows.select(*key, plain.alias("shared")).filter(F.size("shared") > 0).groupBy(*key).agg(F.first("shared").alias("shared"))
    recurring = cut_lineage(recurring_places(rows, OTHERS, RECURS))
    places = rows.select(*key, "host", F.explode("places").alias("place"))
    small = recurring.count() <= BROADCAST_NUMBERS // 16
    found = places.join(F.broadcast(recurring), ["host", "place"]) if small else salted_join(places, recurring, ["host", "place"])
    given = found.groupBy(*key).agg(F.collect_set("place").alias("recurring"))
    # null ids take part in grouping, but not in joins by name
    both = taken.withColumn("recurring", F.lit(None).cast("array<bigint>")).unionByName(given.withColumn("shared", F.lit(None).cast("array<int>")))
    return both.groupBy(*key).agg(F.first("shared", ignorenulls=True).alias("shared"), F.first("recurring", ignorenulls=True).alias("recurring"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of pages.

    Null and empty pages give an empty text. Pages with null or equal ids and urls are told apart
    by their source; repeated rows each come back with the same text. Copies of a page are never
    its partner, and a page whose lines are all shared keeps them. A page that is alone on its
    host, but for copies, shares no line. A br ends a line, as a browser shows it. An empty table
    gives an empty result; other columns are ignored.
    """
    source = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), source.alias("html"), F.xxhash64(F.col(url_col), source).alias("sig"))
    decided = cut_lineage(page_decisions(rows)).withColumnsRenamed({c: f"s_{c}" for c in ("page_id", "sig")})
    numbers = decided.agg(F.sum(F.lit(2) + F.coalesce(F.size("shared"), F.lit(0)) + F.coalesce(F.size("recurring"), F.lit(0)))).first()[0] or 0
    side = F.broadcast(decided) if numbers <= BROADCAST_NUMBERS else decided
    same = rows["page_id"].eqNullSafe(side["s_page_id"]) & (rows["sig"] == side["s_sig"])
    both = rows.join(side, same, "left").select("page_id", "url", "html", "shared", "recurring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in text_batches(batches, "html"):
            places = zip(batch.column("shared").to_pylist(), batch.column("recurring").to_pylist(), strict=True)
            texts = ["\n".join(Lines(s).chosen(set(p or ()), set(k or ()))) for s, (p, k) in zip(sources, places, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")
