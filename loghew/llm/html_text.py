"""Main text of web pages by two-pass block rules.

A page becomes blocks of text with their place in the page, their length, their share of link
text and their share of stop words. Pass 1 decides the clear blocks by these three; pass 2 gives
the ambiguous short ones the label of the nearest decided neighbours.

Tags and names are priors, weighed by the text that pass 1 finds: article and main frame a page
where they hold enough of its text, and a menu, notice or sidebar by name or tag is left out
unless it holds most of a page's prose, when the name misleads. Only what readers comment is known
by its name alone, since it is prose as well.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .kernels import slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements of HTML by their part in a page.
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
AWAY = set("nav footer aside form dialog menu".split())
NO_TEXT = set("head template svg math select button object canvas audio video map script style".split())
MAIN = set("article main".split())
#: Words in class, id and role that mark what is not the article, and what is.
BAD_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|warning|disclaimer|nav\w*|menus?|breadcrumbs?|sidebars?|side|footers?|headers?|masthead|topbar|comments?|commentlist|disqus|replies|reply|respond|reviews?|related|recommend\w*|share\w*|sharing|social|subscribe\w*|newsletter\w*|signup|login|popups?|modal|overlay|widgets?|toolbar|pagination|pager|search|copyright|tags?|navigation|contentinfo|complementary)(?:$|[-_\s\d])",
    re.I,
)
COMMENT_WORDS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|replies|reply|respond|reviews?)(?:$|[-_\s\d])", re.I)
GOOD_WORDS = re.compile(r"(?:^|[-_\s])(?:article|articlebody|post|entry|content|main|story|body|text)(?:$|[-_\s\d])", re.I)
#: Common short words of the languages the rules know.
STOP_WORDS = frozenset(
    (
        "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their them they this to was we were which will with you "
        "der die das den dem des ein eine einer einem und oder aber nicht ist sind war mit von zu im in auf für als auch es er sie ich wir nach bei aus "
        "le la les un une des du de et ou mais ne pas est sont dans pour par sur avec que qui ce cette il elle je nous vous au aux en plus "
        "el los las uno una unos del y o pero no es son por para con que se su lo como más al"
    ).split()
)
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Rules:
    """Thresholds of the two passes: lengths in characters, shares from 0 to 1."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.20
    stop_framed: float = 0.04
    links: float = 0.5


@dataclass
class Block:
    text: str
    links: int
    away: tuple[int, ...]  # the containers around it that a tag or name marks as no article; 0: surely none
    inside: int  # number of the article-like container, 0: none
    main: bool  # that container is an article or main element, not only named like one
    heading: bool
    label: str = ""


@dataclass
class Frame:
    tag: str
    away: tuple[int, ...]
    inside: int
    main: bool = False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; markup, comments, scripts and styles are gone."""
    out: list[Block] = []
    stack = [Frame("", (), 0)]
    parts: list[str] = []
    links = anchor = containers = marked = breaks = 0
    heading = False

    def close() -> None:
        nonlocal links, heading, breaks
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, links, stack[-1].away, stack[-1].inside, stack[-1].main, heading))
        parts.clear()
        links, heading, breaks = 0, False, 0

    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            chunk = m[0]
            if chunk.startswith(("<!", "<?")):
                continue
            chunk = html.unescape(chunk)
            if chunk.strip():
                breaks = 0
                if anchor:
                    links += len("".join(chunk.split()))
            parts.append(chunk)
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag not in INLINE and tag == "title":
                close()
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
            continue
        if tag == "a":
            anchor = 0 if closing else 1
        if tag in INLINE and tag not in ("span", "label"):
            continue
        if tag in ("span", "label") and not closing and not (attributes and BAD_WORDS.search(" ".join(a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes) if a[0].lower() in ("class", "id", "role")))):
            stack.append(Frame(tag, stack[-1].away, stack[-1].inside, stack[-1].main))
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag in ("span", "label"):
                if depth == len(stack) - 1 and depth and stack[depth].away == stack[depth - 1].away:
                    stack.pop()
                elif depth:
                    close()
                    del stack[depth:]
                continue
            close()
            anchor = 0
            if depth:
                del stack[depth:]
            continue
        close()
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and stack[-1].tag == tag:
            stack.pop()
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in VOID or attributes.endswith("/"):
            continue
        up = stack[-1]
        names = " ".join(a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes) if a[0].lower() in ("class", "id", "role"))
        hidden = re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", attributes) is not None
        good = tag in MAIN or bool(names and GOOD_WORDS.search(names))
        sure = tag in NO_TEXT or hidden or (bool(names) and tag not in ("body", "html") and bool(COMMENT_WORDS.search(names)))
        bad = sure or tag in AWAY or (tag == "header" and not up.inside) or (tag not in ("body", "html", "article", "main") and bool(names) and bool(BAD_WORDS.search(names)))
        inside, main = up.inside, up.main
        if good and not bad and (tag in MAIN or not inside):
            containers += 1
            inside, main = containers, tag in MAIN
        away = up.away
        if bad:
            marked += 1
            away = (*away, 0 if sure else marked)
        stack.append(Frame(tag, away, inside, main))
        if len(stack) > 2000:  # broken nesting
            del stack[1000:]
    close()
    return out


def measured(b: Block) -> tuple[int, float, float]:
    """(length, share of link text, share of stop words)."""
    words = WORD.findall(b.text.lower())
    return len(b.text), b.links / max(1, len(b.text.replace(" ", ""))), sum(w in STOP_WORDS for w in words) / max(1, len(words))


def by_density(size: int, links: float, stop: float, heading: bool, rules: Rules) -> str:
    if links > rules.links:
        return "bad"
    if heading or size < rules.short:
        return "short"
    if stop >= rules.stop_high:
        return "good" if size >= rules.long else "near"
    return "near" if stop >= rules.stop_low else "bad"


def classify(found: list[Block], rules: Rules) -> None:
    """Sets each block's label to good or bad.

    Pass 1 labels every block by its length and densities, and from these labels weighs the
    priors. article and main elements frame the page if their text beside links is at least
    half as much as the good text elsewhere: other blocks are then bad; inside, a lower share
    of stop words is enough, and blocks below it, such as tables, are ambiguous. Without a
    frame, containers marked as no article that hold most of the good text, and at least two
    long blocks' worth, count as unmarked.
    """
    facts = [measured(b) for b in found]
    for b, f in zip(found, facts):
        b.label = by_density(*f, b.heading, rules)
    within = sum(f[0] for b, f in zip(found, facts) if b.main and not b.away and f[1] <= rules.links)
    beside = sum(f[0] for b, f in zip(found, facts) if not b.main and not b.away and b.label == "good")
    framed = within > 0 and 2 * within >= beside
    cleared: set[int] = set()
    if not framed:
        for b in found:
            if b.main:  # an article that is none, such as a teaser
                b.main, b.inside = False, 0
        mass: dict[tuple[int, ...], int] = {}
        for b, f in zip(found, facts):
            if b.label == "good" and 0 not in b.away:
                mass[b.away] = mass.get(b.away, 0) + f[0]
        for away, size in mass.items():
            if size >= 2 * rules.long and 2 * size > sum(mass.values()):
                cleared.update(away)
    for b, (size, links, stop) in zip(found, facts):
        if any(a not in cleared for a in b.away) or (framed and not b.main):
            b.label = "bad"
        elif framed and links <= rules.links:
            b.label = "short" if b.heading or size < rules.short else "good" if stop >= rules.stop_framed else "near"
    decided = [b.label if b.label in ("good", "bad") else "" for b in found]
    n = len(found)
    before, after = [("", 0)] * n, [("", 0)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last, group, far = "", 0, 0
        seen, off = "", 0
        for i in order:
            if found[i].inside != group:
                last, group = "", found[i].inside  # labels don't come into an article from outside
            far, off = far + 1, off + 1
            if decided[i]:
                last, far = decided[i], 0
                seen, off = decided[i], 0
            side[i] = (last, far) if group else (seen, off)
    for i, b in enumerate(found):
        if b.label in ("short", "near"):
            near = {x for x, _ in (before[i], after[i]) if x}
            if not near:
                b.label = "good" if b.inside or b.label == "near" else "bad"
            elif len(near) == 1:
                b.label = near.pop()
            elif b.heading or b.label == "near":
                b.label = "good"
            else:
                b.label = min((before[i], after[i]), key=lambda x: x[1])[0]


def main_text(page: str | None, rules: Rules = Rules()) -> str:  # noqa: B008
    found = blocks(page or "")
    classify(found, rules)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every page.

    The whole html is read. Edge cases: null or empty html gives an empty text; unclosed
    tags, comments and scripts end with the page; null ids and urls stay; repeated rows are
    rows like others; an empty table gives no rows; further columns are ignored.
    """
    rules = rules or Rules()
    small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_kept", pa.int64())])

    def run(batches):
        for batch in slices(batches, "html", 1 << 20):
            texts, counts, kept = [], [], []
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                classify(found, rules)
                good = [b.text for b in found if b.label == "good"]
                texts.append("\n\n".join(good))
                counts.append(len(found))
                kept.append(len(good))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
