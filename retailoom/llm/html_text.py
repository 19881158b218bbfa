"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Blocks inside containers that never hold
article text (navigation, footers, asides, forms, page headers, and elements named as adverts,
notices, comments, side bars, ...) are bad. First pass, by stop-word density, length and link density:
blocks of many links are bad; outside the article element long blocks with stop words are good
and long ones without are bad; inside it long blocks with stop words are good. The rest is
ambiguous. Second pass: an ambiguous block takes the label of the nearest decided neighbours in
its own scope (article or not): of both if they agree, of the nearer one if not (the one before
on a tie); with no decided neighbour it is good inside an article element and bad outside.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty ones dropped, and the good ones joined by a line feed in page order. Comments,
scripts, styles and the head are no text. Missing end tags end with their parent. Null or empty
html gives empty text; repeated rows are extracted each; extra columns are ignored; no rows
give no rows. The work is one page at a time, without a shuffle.
"""

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import arrow_batch

LONG = 12
STOP_DENSITY = 0.2
LINK_DENSITY = 0.5

# Frequent function words of the supported languages
STOP_WORDS = frozenset("""
the of and to in is was he for it with as his on be at by this had not are but from or have an they which one you were her all
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou elle
de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha
""".split())
RAW = "script|style|noscript|template|textarea|svg|iframe|select|math|object"
BLOCK = frozenset("""
address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul
""".split())
NEVER = frozenset("nav aside footer form menu dialog button fieldset head".split())
ARTICLE = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED = frozenset("""
ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright
disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo
related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget
""".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
WORD_EDGES = re.compile(r"[^\W\d_]+")


def never_text(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds no article text, by its tag or the words of its names."""
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    names = " ".join(NAMES.findall(attributes)).lower()
    return any(w in NAMED for w in re.split(r"[^a-z]+", names))


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, never text, in an article element) of each block."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements and whether they began a never-text part
    never = articles = links = 0
    parts: list[str] = []
    in_links: list[str] = []

    def end_block():
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, len(" ".join(html.unescape("".join(in_links)).split())), never > 0, articles > 0))
        parts.clear()
        in_links.clear()

    def close(i: int):
        nonlocal never, articles, links
        while len(stack) > i:
            name, began = stack.pop()
            never -= began
            articles -= name in ARTICLE
            links -= name == "a"

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text = page[at:m.start()]
            parts.append(text)
            if links:
                in_links.append(text)
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            end_block()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if m[2]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if i is not None:
                if tag not in BLOCK and any(name in BLOCK for name, _ in stack[i + 1:]):
                    continue  # an inline end tag does not end the blocks around it
                close(i)
            continue
        if tag in BLOCK and stack and stack[-1][0] == tag and tag in ("p", "li", "td", "th", "tr", "dt", "dd"):
            close(len(stack) - 1)
        began = never_text(tag, m[4], articles > 0)
        if not (m[4] or "").endswith("/"):
            stack.append((tag, began))
            never += began
            articles += tag in ARTICLE
            links += tag == "a"
    if at < len(page):
        parts.append(page[at:])
    end_block()
    return out


def first_pass(block: tuple[str, int, bool, bool]) -> str:
    text, in_links, never, in_article = block
    if never or in_links > LINK_DENSITY * len(text):
        return "bad"
    words = text.lower().split()
    dense = sum(1 for w in words if (m := WORD_EDGES.search(w)) and m[0] in STOP_WORDS) >= STOP_DENSITY * len(words)
    if len(words) >= LONG:
        return "good" if dense else "ambiguous" if in_article else "bad"
    return "ambiguous"


def second_pass(labels: list[str], scopes: list[bool]) -> list[str]:
    """Ambiguous blocks inherit from the nearest decided block on either side in their scope."""
    n = len(labels)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, int] = {}
        for i in order:
            if labels[i] == "ambiguous":
                near[i] = last.get(scopes[i])
            else:
                last[scopes[i]] = i
    out = []
    for i, label in enumerate(labels):
        if label == "ambiguous":
            a, b = before[i], after[i]
            if a is None and b is None:
                label = "good" if scopes[i] else "bad"
            elif a is None or b is None:
                label = labels[b if a is None else a]
            else:
                label = labels[a] if i - a <= b - i else labels[b]
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    # blocks of never-text parts are no neighbours of the article's blocks
    shown = [b for b in found if not b[2]]
    labels = second_pass([first_pass(b) for b in shown], [b[3] for b in shown])
    return "\n".join(b[0] for b, label in zip(shown, labels) if label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points for every page."""
    ddl = "page_id bigint, url string, text string, n_chars bigint"

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield arrow_batch(ddl, batch.column(0), batch.column(1), texts, [len(t) for t in texts])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, ddl)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
