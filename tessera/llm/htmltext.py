"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one for each block of text; elements that are no
article by their name or their class, id and role (menus, footers, sidebars,
notices, adverts, forms, comments, embedded media) leave blank lines.  Where ``article`` or ``main``
holds at least a quarter of the text that is left, the lines outside leave blanks too; elsewhere
runs of two or more lines that are mostly links do.  The text lengths of ``LINES`` consecutive
lines are summed, for every line on; a surge starts where the sum rises above a threshold and the line
has text, a dive is where it falls to nothing, and the text between is kept.  In a
page with a landmark what stands there before a surge, back to the last dive, is its
heading or its short first lines and is kept with it; text that no surge follows before the next dive goes on every page.

Defined results
* A null page gives an empty text, as does a page without text.
* Elements that close themselves or are never closed hide nothing, but ``script`` and ``style``, which run to the end of the page.
* Elements are known by their whole name: ``<button-bar>`` is no ``button``.
* Equal pages give equal texts; long pages are read whole, in time linear in their length.
* An empty table gives an empty result.  Only the named columns are read, so others do not clash.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
LINES = 3
#: The sum at which a surge starts: this share of the largest, at most so many characters.
SURGE_SHARE, SURGE_MOST = 0.2, 80

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][\w:-]*+)(?P<rest2>[^>]*+)>",
    re.S,
)
#: Elements whose content is no markup, and where it ends.
RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "textarea", "title")}
TO_THE_END = frozenset(("script", "style"))
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
BY_NAME = frozenset("nav footer aside form menu dialog noscript template iframe svg select button object canvas audio video".split())
HIDEABLE = frozenset("div section ul ol dl table header nav footer aside form p span figure h1 h2 h3 h4 h5 h6 li details fieldset article center".split())
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
STAY = frozenset("article content main story entry post body".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())


def is_away(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element is no part of an article, by its name or by what it is called."""
    if name in BY_NAME or (name == "header" and not in_article):
        return True
    if name not in HIDEABLE or "=" not in rest:
        return False
    called = {w.lower() for m in NAMED.finditer(rest) for w in PART.findall(next(g for g in m.groups() if g is not None))}
    if not called & AWAY:
        return False
    return bool(called & COMMENTS) or not called & STAY


def tokens_of(page: str) -> list[tuple[int, int, str, bool, str, bool]]:
    """(start, end, name, whether it closes, attributes, whether it is raw content) of each tag, comment and raw element."""
    tokens, at, open_to_end = [], 0, set()
    while m := TOKEN.search(page, at):
        name, end, rest = (m["name"] or m["name2"] or "").lower(), bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        at, raw = m.end(), False
        if name in RAW and not end and not rest.endswith("/") and name not in open_to_end:
            if close := RAW[name].search(page, at):
                at, raw = close.end(), True
            elif name in TO_THE_END:
                at, raw = len(page), True
            else:
                open_to_end.add(name)  # no such end follows, so none is looked for again
        tokens.append((m.start(), at, "" if raw else name, end, rest, raw))
    return tokens


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters in links, inside an article, hidden elements just before) of each block, in page order."""
    tokens = tokens_of(page)
    close: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, (_, _, name, end, rest, _) in enumerate(tokens):
        if end and opened.get(name):
            close[opened[name].pop()] = i
        elif name and not end and not rest.endswith("/"):
            opened.setdefault(name, []).append(i)
    lines: list[tuple[str, int, bool, int]] = []
    words: list[str] = []
    linked = link = depth = breaks = hidden = 0

    def flush() -> None:
        nonlocal linked, hidden
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                lines.append((text, linked, depth > 0, hidden))
                hidden = 0
        words.clear()
        linked = 0

    at, i = 0, 0
    while i <= len(tokens):
        start, after, name, end, rest, raw = tokens[i] if i < len(tokens) else (len(page), len(page), "", False, "", False)
        if start > at:
            plain = page[at:start]
            words.append(plain)
            if not plain.isspace():
                breaks = 0
                linked += len(plain) if link else 0
        at = after
        if name == "br":
            breaks += 1
            words.append(" ")
            if breaks > 1:
                flush()
        elif name == "a":
            link = 0 if end else 1
        elif name in BLOCKS:
            flush()
            link = 0
        elif name in ("td", "th", "option") or raw:
            words.append(" " if not raw else "")
        if name and not end and i in close and is_away(name, rest, depth > 0):
            flush()
            hidden += 1
            i = close[i]
            at = tokens[i][1]
        elif name in ("article", "main") and (end or i in close):
            depth = max(0, depth + (-1 if end else 1))
        i += 1
    flush()
    return lines


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    lines = lines_of(page)
    landmark = 4 * sum(len(text) for text, _, inside, _ in lines if inside) >= sum(len(text) for text, *_ in lines) > 0
    listed = [2 * linked > len(text) for text, linked, _, _ in lines]
    spaced: list[str] = []
    for i, (text, _, inside, hidden) in enumerate(lines):
        spaced += [""] * hidden
        menu = listed[i] and (i > 0 and listed[i - 1] or i + 1 < len(lines) and listed[i + 1])
        spaced.append("" if (not inside if landmark else menu) else text)
    return "\n".join(between(spaced, landmark))


def between(lines: list[str], landmark: bool) -> list[str]:
    """The lines with text from every surge to the dive after it; with a landmark also those from the dive before it."""
    size = [len(x) for x in lines] + [0] * LINES
    blocks = [sum(size[i : i + LINES]) for i in range(len(lines))]
    surge = min(SURGE_MOST, SURGE_SHARE * max(blocks, default=0))
    kept: list[str] = []
    before: list[str] = []
    rising = False
    for i, block in enumerate(blocks):
        if not block:
            rising = False
            before.clear()
        elif not rising and block > surge and size[i]:
            rising = True
            kept += before
            before.clear()
        if size[i]:
            if rising:
                kept.append(lines[i])
            elif landmark:
                before.append(lines[i])
    return kept


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def scan(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("h")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("h"))
    return narrow.mapInArrow(scan, "id long, url string, text string, n_chars long")


def op7_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
