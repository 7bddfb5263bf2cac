"""Main text of web pages by block rules in two passes.

First, each block is judged by itself from its length, link density and stop-word density; then blocks too short to
tell take the label of the nearest decided neighbour. Markup that says what it is (navigation, forms, notices,
comments, adverts) is left out before that, and blocks inside an article start from a better guess.

Words of class, id and role are evidence, no proof: beside a word that names text, those that name a place on the page don't
count, and where they would leave nothing of a page that marks no
article, only those that name comments count. Function words are those of four
languages and the page's own most frequent short words; a long block with few links in a language without either
may be text, and is where nothing on the page is more surely so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from orbitlake.llm.common import small_batches, typed

# Element names of HTML, by what they hold.
SKIPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video nav footer aside form button select "
    "textarea dialog menu".split()
)
RAW = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that end an open paragraph, those that a paragraph outside stays open in, and for elements whose end
# tag may be left out, which open ones they end and where that stops.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup li main menu nav ol p pre search section summary table ul".split()
)
P_STAYS_IN = tuple("button caption object table td template th".split())
_APART = ("article", "aside", "blockquote", "button", "footer", "form", "header", "main", "nav", "object", "section", "template")
_ROWS = (("table", "template"), ("tbody", "thead", "tfoot"))
ENDS = (
    {"li": (("li",), ("ol", "ul", "menu", "dir", "table", "td", "th", *_APART))}
    | dict.fromkeys(("dd", "dt"), (("dd", "dt"), ("dl", "table", "td", "th", *_APART)))
    | dict.fromkeys(("td", "th"), (("td", "th"), ("tr", *_ROWS[0])))
    | {"tr": (("tr",), _ROWS[0] + _ROWS[1])}
    | dict.fromkeys(_ROWS[1], (_ROWS[1], _ROWS[0]))
    | {"option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("optgroup",), ("select",))}
)
# Words of class, id and role attributes that name what isn't the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense banner sponsor sponsored promo promoted promotion sidebar aside "
    "comment comments commentlist disqus respond reply replies discussion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login share sharing social related recommended recommendations toolbar pagination pager skip widget contentinfo "
    "complementary search dialog toc byline copyright legal disclaimer".split()
)
# Those of them that name reader comments, those that name a place or a look rather than what is in it, and words
# that name text, beside which the latter don't count.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
PLACES = frozenset("sidebar aside widget share sharing social header masthead notice notices alert skip search toolbar dialog modal overlay popup related".split())
TEXT_NAMES = frozenset("article articles body content contents copy entry main post story text".split())
# Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i "
    "if in into is it its more most no not of on one only or other our she so some than that the their them then there these "
    "they this to up was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes mon ne nos notre nous on "
    "ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous "
    "aber als am an auch auf aus bei bin bis das dem den der des die doch du durch ein eine einem einen einer er es für hat ich "
    "ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so und uns unter vom von vor war was wie wir zu zum zur über "
    "al como con del desde donde el ella en entre era es esta este esto fue ha hay la las lo los más mi muy no o para pero por "
    "que se si sin sobre su sus también te tiene un una uno y ya".split()
)

#: Why an element is left out: by its element or as hidden, or by words that name it.
HIDDEN, NAMED = 1, 2
#: Link density above which a block is no text; length in characters under which a block is short, from which long.
LINKS_MAX, SHORT, LONG = 0.5, 70, 200
#: Stop-word density from which a block is text, and from which it may be.
STOPS_HIGH, STOPS_LOW = 0.3, 0.15
#: Words of so many characters at most, among the page's so many most frequent ones that come so often, are its function words.
OWN_SIZE, OWN_WORDS, OWN_TIMES = 4, 15, 4
#: A page's articles are teasers if the text outside of them is so many times as long.
TEASER = 2
#: Characters from this on (ideographs, kana, hangul) say as much as three letters.
DENSE = 0x2E80
_PUNCTUATION = ".,;:!?()\"'«»"

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_END = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')|>""")
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_MARKS = re.compile("class|id|role|hidden", re.I)
_ARTICLE = re.compile(r"<(?:article|main)[\s/>]", re.I)


def _tag_end(html: str, at: int) -> int:
    """Where the tag that is open at `at` ends (its >), quotes respected; -1 if it doesn't."""
    first = html.find(">", at)
    if first < 0:
        return -1
    for m in _END.finditer(html, at):
        if m[0] == ">":
            return m.start()
    return first  # a stray quote


def _marked(attributes: str, names: frozenset) -> int:
    """HIDDEN, NAMED if whole words of class, id or role name something that isn't the article, or 0."""
    found: set[str] = set()
    if _MARKS.search(attributes):
        for m in _ATTR.finditer(attributes):
            name = m[1].lower()
            if name == "hidden" or (name == "aria-hidden" and (m[2] or m[3] or m[4] or "").strip().lower() == "true"):
                return HIDDEN
            if name in ("class", "id", "role"):
                found.update((m[2] or m[3] or m[4] or "").lower().split())
    no = found & names
    return NAMED if no and not (no <= PLACES and found & TEXT_NAMES) else 0


def _collapsed(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split()) if parts else ""


def blocks(html: str, names: frozenset = NOT_ARTICLE) -> Iterator[tuple[str, int, bool, bool]]:
    """Blocks in page order: text, characters of it inside links, whether in an article, whether a heading.

    What words of class, id or role among `names` name is left out.
    """
    at, n = 0, len(html)
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    open_tags: list[tuple[str, int]] = []  # name, why it is left out
    left_out = article = heading = 0
    named: list[int] = []  # places of open elements that are left out by their words

    where: dict[str, list[int]] = {}  # places of open elements by name

    def last(*names: str) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def opened(name: str, skip: int) -> None:
        nonlocal left_out, article, heading, links
        where.setdefault(name, []).append(len(open_tags))
        if skip == NAMED:
            named.append(len(open_tags))
        open_tags.append((name, skip))
        left_out += skip > 0
        article += name in ("article", "main")
        heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
        links += name == "a"

    def close(k: int) -> tuple[str, int] | None:
        """Close the open elements from place k on; the last link among them."""
        nonlocal left_out, article, heading, links
        link = None
        while len(open_tags) > k:
            gone, out_ = tag = open_tags.pop()
            where[gone].pop()
            left_out -= out_ > 0
            if out_ == NAMED:
                named.pop()
            article -= gone in ("article", "main")
            heading -= gone in ("h1", "h2", "h3", "h4", "h5", "h6")
            if gone == "a":
                links -= 1
                link = link or tag
        return link

    def flush():
        nonlocal parts, linked
        text = _collapsed(parts)
        out = (text, len(_collapsed(linked)), article > 0, heading > 0) if text else None
        parts, linked = [], []
        return out

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not left_out:
            run = html[at:lt]
            parts.append(run)
            if links:
                linked.append(run)
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt)
        end = _tag_end(html, m.end()) if m else -1
        if m is None or end < 0:  # a bare <
            if not left_out:
                parts.append("<")
            at = lt + 1
            if m is not None:  # no > is left: the rest is text
                if not left_out:
                    parts.append(html[at:])
                break
            continue
        closing, name = bool(m[1]), m[2].lower()
        attributes = html[m.end() : end]
        at = end + 1
        if name not in INLINE and (out := flush()):
            yield out
        if closing:
            if where.get(name):
                close(where[name][-1])
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            ended = re.compile(f"</{name}", re.I).search(html, at)
            if ended is None:
                at = n
            else:
                stop = html.find(">", ended.end())
                at = n if stop < 0 else stop + 1
            continue
        link = None
        if where.get("p") and name in ENDS_P and (k := last("p")) > last(*P_STAYS_IN):
            link = close(k)
        if name in ENDS and (k := last(*ENDS[name][0])) > last(*ENDS[name][1]):
            link = close(k) or link
        mark = _marked(attributes, names)
        if name in ("article", "main") and not article and (name == "main" or mark != NAMED):
            # words don't leave out what holds an article; comments and the like are articles in an article, or named so
            for k in named:
                open_tags[k] = (open_tags[k][0], 0)
            left_out -= len(named)
            named.clear()
        if name in SKIPPED or (name == "header" and not article):
            skip = HIDDEN
        else:
            skip = 0 if name in ("html", "body", "article", "main") else mark
        opened(name, skip)
        if link:  # a link goes on in what follows, as in a browser
            opened(*link)
    if out := flush():
        yield out


def _size(text: str) -> int:
    """Characters, those of dense scripts counted three times."""
    return len(text) if text.isascii() else len(text) + 2 * sum(ord(c) >= DENSE for c in text)


def _own_words(found: list[tuple[str, int, bool, bool]]) -> frozenset:
    """The page's most frequent short words, of blocks with few links."""
    count = Counter(w.strip(_PUNCTUATION) for text, links, *_ in found if links <= LINKS_MAX * len(text) for w in text.lower().split())
    short = sorted((-n, w) for w, n in count.items() if n >= OWN_TIMES and w.isalpha() and len(w) <= OWN_SIZE)
    return frozenset(w for _, w in short[:OWN_WORDS])


def _first_pass(text: str, link_chars: int, inside: bool, heading: bool, own: frozenset) -> str:
    """good, bad, near (may be text) or short (can't tell)."""
    n = _size(text)
    if link_chars > LINKS_MAX * len(text) and not (inside and heading):
        return "bad"
    if n < SHORT or heading:
        return "short"
    ws = [w.strip(_PUNCTUATION) for w in text.lower().split()]
    stops = max(sum(w in words for w in ws) for words in (STOP_WORDS, own)) / len(ws)
    if inside:
        return "good"
    if stops >= STOPS_HIGH:
        return "good" if n >= LONG else "near"
    return "near" if stops >= STOPS_LOW or n >= LONG else "bad"


def _decided(first: list[str], order: range) -> list[tuple[int, str] | None]:
    """For each block the nearest decided one before it in the order, with its label."""
    out: list[tuple[int, str] | None] = [None] * len(first)
    last = None
    for i in order:
        out[i] = last
        if first[i] in ("good", "bad"):
            last = (i, first[i])
    return out


def _kept(found: list[tuple[str, int, bool, bool]]) -> Iterator[str]:
    """The blocks that are text: those that are good themselves, those of an article that may be, and others like the nearest
    decided block. Of two as near, text that may be one stays, a heading goes with what follows it, the rest goes."""
    own = frozenset() if all(b[2] for b in found) else _own_words(found)
    first = [_first_pass(*b, own) for b in found]
    if any(b[2] for b in found):
        # where a page marks its article, the rest of it is none, unless the marked ones are teasers of it
        outside = sum(len(b[0]) for b, k in zip(found, first, strict=True) if not b[2] and k == "good")
        if outside <= TEASER * sum(len(b[0]) for b in found if b[2]):
            found, first = [b for b in found if b[2]], [k for b, k in zip(found, first, strict=True) if b[2]]
        else:
            found = [(text, links, False, heading) for text, links, _, heading in found]
            first = [_first_pass(*b, own) for b in found]
    if "good" not in first:  # a language without known words, or a short page: what may be text is the text
        first = ["good" if k == "near" else k for k in first]
    before, after = _decided(first, range(len(first))), _decided(first, range(len(first) - 1, -1, -1))
    for i, ((text, _, inside, heading), k, x, y) in enumerate(zip(found, first, before, after, strict=True)):
        if k in ("near", "short") and not inside:
            near = min(abs(i - d[0]) for d in (x, y) if d) if x or y else 0
            around = {d[1] for d in (x, y) if d and abs(i - d[0]) == near}
            if len(around) == 2:
                good = k == "near" or (heading and y[1] == "good")
            else:
                good = around == {"good"} or (not around and k == "near")
        else:
            good = k != "bad"
        if good:
            yield text


def main_text(html: str | None) -> str:
    """The article's blocks joined by one space; empty if there is none."""
    if not html:
        return ""
    text = " ".join(_kept(list(blocks(html))))
    if not text and not _ARTICLE.search(html):  # words alone don't empty a page
        text = " ".join(_kept(list(blocks(html, COMMENTS))))
    return text


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    What stands in article or main elements is the article, but for teasers of a longer text beside them: all of it that isn't left
    out or mostly links. A null or empty html gives an empty text; rows are neither joined nor dropped, so repeated rows stay repeated; ids
    and urls may be null; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    small_batches(pages.sparkSession)
    return typed(pages, page_id="long", url="string", html="string").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
