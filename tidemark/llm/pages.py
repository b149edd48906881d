"""Main text of web pages: structure of the markup and a suffix array for each host.

A page's markup is cut into blocks of text.  Blocks inside an article or main element are
its main text, whatever stands around it, unless that is an aside or comments; elements that
stand for menus, headers, footers, sidebars, notices, adverts, forms or comments, by name,
role or class, are not.  Forms, roles and classes say nothing of an element around most of the
page's text, nor do words of a class that it only has or lacks (has-sidebar); inside articles
all words of a class must say so (related-posts, but not related-work), or its first or last be
one that names the element (user-comments, article-sidebar).  What is left open are
blocks of pages without such a container.

For those the pages of a host are read together.  The token streams of all blocks outside
articles are concatenated, page after page, and ordered in a suffix array; substrings of at
least ``RUN`` tokens that occur on at least ``PAGES`` distinct pages are boilerplate, and so
are whole blocks on that many and a share of ``SHARE`` of the host's pages.  Open blocks of
which more than ``MOSTLY`` is boilerplate are removed, and the others are the main text.

A host of any size is dealt to cells of about ``CELL_BYTES``, so a large host is read by
many tasks.  If such a host has open blocks, hashes of the runs and blocks of its cells are
counted over the whole host, and each cell gets those of its own pages that are boilerplate;
so the result does not depend on how a host is dealt.

Cases: a null or empty page, or one without main text, gives an empty text; a null or
malformed address is a host of its own kind, dealt to cells like any other; repeated pages
do not make each other boilerplate, as equal markup counts as one page; references that
are not known stay as written; unclosed elements end with the container around them; a
long page is one row and is parsed whole; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.grouping import runs_of
from tidemark.llm.tokens import gram_hashes, separated, slice_hashes, suffix_array
from tidemark.session import materialize

#: Tokens that do not recur by chance; shorter phrases are boilerplate only as whole blocks.
RUN = 20
PAGES = 3
SHARE = 0.05
MOSTLY = 0.5
CELL_BYTES = 1 << 20

#: Share of the page's text that makes an element a wrapper of the page.
WRAPS = 0.75

ARTICLE, OPEN, CHROME = "article", "open", "chrome"
#: Chrome in which an article is no main text either.
ASIDE = "aside"
# Element names of the markup language.
CONTAINERS = {"article", "main"}
CHROME_NAMES = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "figure"}
SKIPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "canvas"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "tfoot", "thead", "tr", "ul",
}
SPACES = {"br", "td", "th", "wbr", "img"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements that others end in; all but these end where a container around them ends.
NESTING = CONTAINERS | CHROME_NAMES | {"div", "section", "table", "ul", "ol", "dl", "body", "details", "blockquote"}
HINTS = (
    r"nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ads?|advert\w*|sponsor\w*|banner|promo\w*|cookies?"
    r"|consent|gdpr|notices?|popup|modal|overlay|share|sharing|social|comments?|disqus|replies|related|breadcrumbs?"
    r"|newsletter|subscribe|widget|pagination|toolbar|login|signup|search|discussions?"
)
# What an element has or lacks, it is not itself.
_OWNS = "".join(rf"(?<!\b{m})(?<!_{m})" for m in ("has", "have", "no", "with", "without", "hide", "show"))
_HINT = re.compile(rf"(?:^|\s|{_OWNS}[_-])(?:{HINTS})(?=$|[\s_-])", re.I)
_HINT_WORD = re.compile(HINTS)
# Words that, next to a hint, leave its meaning as it is.
COMPANIONS = {
    "area", "articles", "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "count", "form",
    "group", "holder", "icon", "icons", "inline", "item", "items", "left", "link", "links", "list", "more", "panel",
    "posts", "right", "site", "slot", "stories", "this", "thread", "tools", "top", "unit", "us", "wrap", "wrapper",
}
# Words that say what an element is wherever a name starts or ends with them (user-comments,
# article-sidebar), and those that say it only has or lacks it.
_HEADS = re.compile(r"comments?|disqus|replies|sidebar|footer|sponsored|subscribe|social")
_OWNING = {"has", "have", "no", "with", "without", "hide", "show"}
_COMMENTS = re.compile(r"comments?|disqus|replies|discussions?")
_BESIDE = re.compile(r"comments?|disqus|replies|discussions?|aside|sidebar|related|ads?|advert\w*|sponsor\w*|promo\w*")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
_OPENS = re.compile(r"<(?:(?P<comment>!--)|(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)|(?P<other>[!?/]))", re.I)
_SKIP = re.compile(r"<(" + "|".join(sorted(SKIPPED)) + r")\b", re.I)
# The rest of a tag; what is in quotes does not end it.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")


class Markup:
    """The comments and tags of a page, in one run through it, whatever is left open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: list[int] | None = None

    def close_of(self, at: int) -> int:
        """Place after the mark that ends the tag whose rest starts here; -1 if nothing ends it.

        A first search without success goes through the page once from its end and notes
        for every place where a tag from there would end, so no later one searches again.
        """
        if at > self.last:
            return -1
        if self.ends is None:
            found = _REST.match(self.page, at)
            if found:
                return found.end()
            self.ends = self._all_ends()
        return self.ends[at]

    def _all_ends(self) -> list[int]:
        page = self.page
        ends, after = [-1] * (len(page) + 2), {}
        for i in range(len(page) - 1, -1, -1):
            c = page[i]
            if c == ">":
                ends[i] = i + 1
            elif c in "\"'":
                ends[i] = ends[after[c] + 1] if c in after else -1
                after[c] = i
            else:
                ends[i] = ends[i + 1]
        return ends

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """Start, end, name in lower case, whether it closes, and the rest of its text."""
        page, at = self.page, 0
        while tag := _OPENS.search(page, at):
            start, at = tag.start(), tag.end()
            if tag["comment"]:
                stop = page.find("-->", at)
                at = len(page) if stop < 0 else stop + 3
                yield start, at, "", False, ""
                continue
            end = self.close_of(at) if tag["name"] else -1
            if end < 0:
                # Not a tag by itself; a declaration or the like ends at the next mark.
                if page[start + 1] in "!?/" and start < self.last:
                    at = page.find(">", start) + 1
                    yield start, at, "", False, ""
                continue
            rest, skipped = page[at : end - 1], _SKIP.match(page, start)
            at = end
            if skipped:
                closing = re.compile(rf"</{skipped[1]}\s*>", re.I).search(page, end)
                at = closing.end() if closing else len(page)
                yield start, at, "", False, ""
            else:
                yield start, at, tag["name"].lower(), bool(tag["close"]), rest


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of every block of visible text, in order."""
    steps, share = _outline(page)
    out: list[tuple[str, str]] = []
    held: list[str] = []
    zones: list[str] = [OPEN]
    for what, value, rest in steps:
        if what == "text":
            held.append(value)
            continue
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((CHROME if zones[-1] == ASIDE else zones[-1], text))
        if what == "open":
            name, number = value
            zones.append(_zone_of(name, rest, zones[-1], share[number] >= WRAPS))
        elif what == "close":
            del zones[value + 1 :]
    return out


def _outline(page: str) -> tuple[list[tuple], list[float]]:
    """Texts, ends of blocks, and elements opened and closed, in order; every element's share of the text."""
    steps: list[tuple] = []
    stack: list[tuple[str, int]] = []
    before: list[int] = []
    inside: list[int] = []
    seen = 0

    opened: Counter[str] = Counter()

    def close(place: int) -> None:
        for name, number in stack[place:]:
            inside[number] = seen - before[number]
            opened[name] -= 1
        del stack[place:]

    at = 0
    for start, end, name, closes, rest in Markup(page):
        if start > at:
            steps.append(("text", page[at:start], None))
            seen += len("".join(steps[-1][1].split()))
        at = end
        if name in SPACES:
            steps.append(("text", " ", None))
        elif name in BLOCKS:
            if name not in NESTING:
                steps.append(("end", None, None))
            elif closes:
                place = len(stack)
                if opened[name]:
                    place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                close(place)
                steps.append(("close", place, None))
            elif not rest.endswith("/"):
                steps.append(("open", (name, len(before)), rest))
                stack.append((name, len(before)))
                opened[name] += 1
                before.append(seen)
                inside.append(0)
            else:
                steps.append(("end", None, None))
    steps.append(("text", page[at:], None))
    seen += len("".join(page[at:].split()))
    close(0)
    steps.append(("end", None, None))
    return steps, [n / max(seen, 1) for n in inside]


def _whole_hints(value: str) -> set[str]:
    """Hints among the classes that are nothing but hints and their companions, or headed by one."""
    out: set[str] = set()
    for name in value.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w and not w.isdigit()]
        hints = {w for w in words if _HINT_WORD.fullmatch(w)}
        if all(w in hints or w in COMPANIONS for w in words):
            out |= hints
        elif not _OWNING & set(words):
            out |= {w for w in (words[0], words[-1]) if _HEADS.fullmatch(w)}
    return out


def _zone_of(name: str, rest: str, around: str, wraps: bool) -> str:
    if around == ASIDE:
        return ASIDE
    if name in CONTAINERS:
        return ARTICLE
    if name == "aside":
        return ASIDE
    values = ["".join(v) for v in _NAMED.findall(rest)] if rest and name != "body" else []
    whole = set().union(*map(_whole_hints, values))
    beside = _COMMENTS if wraps else _BESIDE
    if any(beside.fullmatch(w) for w in whole) or (not wraps and any(v.lower() == "complementary" for v in values)):
        return ASIDE
    if around == CHROME:
        return CHROME
    if name in CHROME_NAMES and not (around == ARTICLE and name in ("header", "figure")) and not (wraps and name == "form"):
        return CHROME
    if not wraps:
        if any(v.lower() in _ROLES for v in values):
            return CHROME
        if whole - {"header"} if around == ARTICLE else any(map(_HINT.search, values)):
            return CHROME
    return around


def parsed(pages: DataFrame, html_col: str) -> DataFrame:
    """``html`` replaced by the article's text, if any, and the blocks outside it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, outside = [], []
            for page in batch.column(html_col).to_pylist():
                found = blocks(page or "")
                own = [t for z, t in found if z == ARTICLE]
                texts.append("\n\n".join(own) if own else None)
                outside.append([{"open": z == OPEN and not own, "text": t} for z, t in found if z != ARTICLE])
            kept = [i for i, c in enumerate(batch.schema.names) if c != html_col]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in kept],
                    pa.array(texts, pa.string()),
                    pa.array(outside, pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string())]))),
                ],
                [*[batch.schema.names[i] for i in kept], "article", "outside"],
            )

    shape = pages.drop(html_col).withColumns(
        {
            "article": F.lit(None).cast("string"),
            "outside": F.array().cast("array<struct<open:boolean,text:string>>"),
        }
    )
    return pages.mapInArrow(step, shape.schema)


def repeated(streams: list[list[str]], kinds: list, run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens, which are part of a long substring on enough distinct pages.

    Pages of equal kind are one page.
    """
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(t, len(number)) for s in streams for t in s], np.int64)
    firsts = np.append(0, np.cumsum([len(s) for s in streams])).astype(np.int64)
    if not len(flat):
        return [np.zeros(0, bool) for _ in streams]
    text, page = separated(flat, firsts, len(number))
    kind = np.unique(np.array(kinds), return_inverse=True)[1]
    order = suffix_array(text)
    n = len(text)
    equal = np.zeros(n, bool)
    equal[1:] = True
    for k in range(run):
        a, b = order[1:] + k, order[:-1] + k
        inside = (a < n) & (b < n)
        equal[1:] &= inside & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
    group = np.cumsum(~equal)
    pairs = np.unique(group * len(kinds) + kind[page[order]]) // len(kinds)
    often = np.bincount(pairs, minlength=group[-1] + 1) >= pages
    starts = order[often[group]]
    change = np.zeros(n + run + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    covered = np.cumsum(change[:n]) > 0
    edges = firsts + np.arange(len(firsts))
    return [covered[edges[i] : edges[i + 1] - 1] for i in range(len(streams))]


def needed(pages: int) -> int:
    """Pages of a host that a whole block has to be on."""
    return max(PAGES, math.ceil(SHARE * pages))


def frequent_blocks(outside: list[list[dict]], kinds: list) -> set[str]:
    """Texts of blocks that are on enough distinct pages."""
    where: dict[str, set] = {}
    for page, kind in zip(outside, kinds):
        for block in page:
            where.setdefault(block["text"], set()).add(kind)
    least = needed(len(set(kinds)))
    return {text for text, on in where.items() if len(on) >= least}


def unit_hashes(outside: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``RUN`` tokens, one for each place they start at, and of the blocks."""
    data = np.frombuffer(" ".join(b["text"] for b in outside).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
    words = slice_hashes(data, starts, ends)
    sizes = np.array([b["text"].count(" ") + 1 for b in outside])
    last = np.cumsum(sizes) - 1
    whole = slice_hashes(data, starts[last - sizes + 1], ends[last])
    runs = gram_hashes(words, np.array([0, len(words)]), RUN)[0] if len(words) >= RUN else words[:0]
    return runs.view(np.int64), whole.view(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (unit, page) of a cell; a run needs no more than ``PAGES`` pages of it."""
    for cell in runs_of(batches, ["host", "cell"]):
        found = [unit_hashes(o) for o in cell.column("outside").to_pylist()]
        kinds = cell.column("kind").to_numpy()
        for whole in (False, True):
            units = [f[whole] for f in found]
            if not sum(map(len, units)):
                continue
            pairs = np.unique(np.stack([np.concatenate(units), np.repeat(kinds, [len(u) for u in units])]), axis=1)
            if not whole:
                pairs = pairs[:, np.arange(pairs.shape[1]) - np.searchsorted(pairs[0], pairs[0]) < PAGES]
            n = pairs.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([cell.column("host")[0].as_py()] * n, pa.string()),
                    pa.array(np.full(n, cell.column("cell")[0].as_py(), np.int64)),
                    pa.array(np.full(n, whole)),
                    pa.array(pairs[0]),
                    pa.array(pairs[1]),
                ],
                ["host", "cell", "whole", "unit", "kind"],
            )


def over_hosts(pages: DataFrame) -> DataFrame:
    """(host, cell, whole, unit) of the boilerplate in each cell, counted over whole hosts."""
    cells = parsed(pages, "html").repartition("host", "cell").sortWithinPartitions("host", "cell")
    units = materialize(
        cells.mapInArrow(_units, "host string, cell long, whole boolean, unit long, kind long"), "page-units"
    )
    sizes = pages.groupBy("host").agg(F.countDistinct("kind").alias("pages"))
    counted = units.groupBy("host", "whole", "unit").agg(F.countDistinct("kind").alias("on"))
    least = F.when(F.col("whole"), F.greatest(F.lit(PAGES), F.ceil(F.lit(SHARE) * F.col("pages")))).otherwise(F.lit(PAGES))
    often = counted.where(F.col("on") >= PAGES).join(sizes, "host").where(F.col("on") >= least)
    places = units.select("host", "cell", "whole", "unit").distinct()
    return places.join(often.select("host", "whole", "unit"), ["host", "whole", "unit"], "left_semi")


def unique_text(outside: list[dict], covered: np.ndarray, frequent: list[bool]) -> str:
    """The open blocks that are not boilerplate for the most part."""
    out, at = [], 0
    for block, often in zip(outside, frequent):
        size = block["text"].count(" ") + 1
        if block["open"] and not often and covered[at : at + size].mean() <= MOSTLY:
            out.append(block["text"])
        at += size
    return "\n\n".join(out)


def _boilerplate(outside: list[list[dict]], kinds: list) -> Iterator[tuple[np.ndarray, list[bool]]]:
    """For each page of a host its covered tokens and its frequent blocks."""
    frequent = frequent_blocks(outside, kinds)
    for page, covered in zip(outside, repeated([[t for b in o for t in b["text"].split(" ")] for o in outside], kinds)):
        yield covered, [b["text"] in frequent for b in page]


def _boilerplate_of(outside: list[list[dict]], units: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, list[bool]]]:
    """As ``_boilerplate``, from the units found over the host."""
    long, often = units[~whole], units[whole]
    for page in outside:
        runs, own = unit_hashes(page)
        change = np.zeros(sum(b["text"].count(" ") + 1 for b in page) + RUN + 1, np.int64)
        starts = np.flatnonzero(np.isin(runs, long))
        np.add.at(change, starts, 1)
        np.add.at(change, starts + RUN, -1)
        yield np.cumsum(change)[: -RUN - 1] > 0, np.isin(own, often).tolist()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in runs_of(batches, ["host", "cell"]):
        sent = pc.is_valid(cell.column("unit"))
        units, pages = cell.filter(sent), cell.filter(pc.invert(sent))
        outside = pages.column("outside").to_pylist()
        if not len(outside):
            continue
        if pages.column("split")[0].as_py():
            whole = np.array(units.column("whole").to_pylist(), bool)
            found = _boilerplate_of(outside, units.column("unit").to_numpy(), whole)
        else:
            found = _boilerplate(outside, pages.column("kind").to_pylist())
        texts = [
            unique_text(o, *boilerplate) if article is None else article
            for article, o, boilerplate in zip(pages.column("article").to_pylist(), outside, found)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                *[pages.column(c).combine_chunks() for c in ("page_id", "url")],
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Per page of ``page_id``, ``url`` and ``html``: its main text and the length of that."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    sizes = placed.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"))
    # Only hosts of more than one cell, whose number the total size bounds.
    large = sizes.select("host", F.ceil(F.col("bytes") / F.lit(cell_bytes)).alias("cells")).where("cells > 1")
    placed = placed.join(materialize(large, "large-hosts"), "host", "left")
    cell = F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("cells", F.lit(1)))
    placed = placed.withColumns({"cell": cell, "kind": F.xxhash64("html"), "split": F.col("cells").isNotNull()}).drop("cells")
    nothing = {"whole": F.lit(None).cast("boolean"), "unit": F.lit(None).cast("long")}
    dealt = parsed(placed, "html")
    # Hosts of several cells with an open block, for which alone the others matter.
    some = F.exists("outside", lambda b: b["open"])
    open_hosts = parsed(placed.where("split"), "html").where(some).select("host").distinct()
    open_hosts = materialize(open_hosts, "open-hosts")
    rows = dealt.withColumns(nothing)
    if not open_hosts.isEmpty():
        counted = over_hosts(placed.where("split").join(open_hosts, "host", "left_semi"))
        rows = rows.unionByName(counted, allowMissingColumns=True)
    rows = rows.repartition("host", "cell").sortWithinPartitions("host", "cell")
    return rows.mapInArrow(_cells, "page_id long, url string, text string, n_chars long")
