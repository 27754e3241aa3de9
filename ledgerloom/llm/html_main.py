"""Main text of HTML pages by two-pass block rules (operator 5).

A page is cut into blocks at block-level tags. Pass one decides blocks:

* bad: inside a region that is no article text (menus, headers, footers,
  sidebars, notices, adverts, forms, reader comments: by tag, role, or a word
  of class or id), or a list entry or short block made of links;
* with an article (``article``, ``main`` or role main) on the page: blocks
  outside it are bad, blocks in it are good if they are long or have enough
  stop words, and undecided otherwise;
* without one: long blocks and blocks of medium length are good if their
  stop-word density is high and their link density low, bad if they have few
  stop words; short blocks are undecided;
* on a page whose text has next to none of the stop words known here (another
  language or script), length and link density decide alone: long blocks with
  few links are good, others undecided. Wide signs count ``WIDE`` fold, as
  scripts like Japanese say more with fewer.

A name is a vote only. Forms like has-sidebar, comments-open or ad-free say
nothing. Within an article, a part of a name (social-science) takes no region
out that holds long text with stop words and few links, unless the part sells
(ad-slot) or means a region of its own (related-articles). Else a
region marked by a part of a name (ad-free), or a form, counts as unmarked if it
holds more long text with stop words than the page has outside marked regions,
or the page's only article. One whose whole name says so (sidebar), or that is of
reader comments, does if nothing of that kind is outside it; it needs the
article, three such blocks (comments: nearly all text of the page).

Pass two: an undecided block takes the label of the nearest decided block of
its region. Of two equally near ones a heading takes the one after it, other
blocks the bad one. The ends of an article count as good, the ends of a page
without one as bad neighbours; within an article only its good blocks count.

Scripts, styles, templates and the head are dropped while reading, up to their
own end tag, whatever stands between. Character
references are decoded, white space in a block becomes one space, blocks are
joined by an empty line. Null html: empty. A page without blocks: empty text.
Unclosed or stray tags never fail. Repeated rows get a row each; null ids and
urls are kept.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import pick, ship

ship(__name__)

LONG, MEDIUM = 140, 50
STOP_HIGH, STOP_LOW = 0.30, 0.15
LINKS_HIGH = 0.5
#: Below this share of known stop words among a page's words, its language is none of theirs.
STOP_UNKNOWN = 0.04
WIDE = 3
WIDE_SIGNS = re.compile("[\u1100-\u11ff\u2e80-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")

STOP_WORDS = frozenset("""
the of and to in a is that it for was on are as with be at by this from or an not have which but were
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
le la les de des et en un une du que est pour dans qui sur par pas au avec ce il sont plus se ne
el los las y del se por con para su al lo como más pero sus es una o ha son
""".split())

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup
option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: Their content is not text of the page.
RAW_TAGS = frozenset("script style template noscript iframe object svg math canvas head textarea title noframes noembed xmp".split())
#: What they hold is plain text up to their own end tag; in the other raw tags these may be nested.
TEXT_TAGS = "script style iframe textarea title noframes noembed xmp".split()
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog button select".split())
#: Regions that are kept on the stack until they end.
REGION_TAGS = frozenset("""article aside button div details dialog fieldset figure footer form header main menu nav ol
section select span table td ul li""".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
BAD_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion
nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices
alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies reply
share sharing social related recommended toolbar pagination pager widget skip masthead topbar""".split())

#: What follows a tag's name: a quote opens a value only right after an equals sign, and only if it is closed.
INSIDE = r"""((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)"""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   rf"|<(/?)([a-zA-Z][^\s/>]*){INSIDE}(?:>|\Z)|[^<]+|<", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}
#: In the others: a comment, a tag of plain text, or the end (of the head also a body).
RAW_NEXT = {t: re.compile(rf"<!--|<({'|'.join(TEXT_TAGS)})(?=[\s/>]){INSIDE}>|(</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z))"
                          + (r"|(?=<body(?:[\s/>]|\Z))" if t == "head" else ""), re.I)
            for t in RAW_TAGS.difference(TEXT_TAGS)}
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


#: Words beside a bad one that make a state or a layout of it: has-sidebar, comments-open.
STATE_FIRST = frozenset("has have no not non with without hide hidden".split())
STATE_LAST = frozenset("open opened closed enabled disabled on off free".split())


class Block:
    __slots__ = ("text", "linked", "bad", "article", "listed", "heading", "region")

    def __init__(self, bad: bool, article: int, listed: bool, heading: bool, region: Region | None = None):
        self.text, self.linked, self.bad, self.article, self.listed, self.heading = [], 0, bad, article, listed, heading
        self.region = region


class Region:
    """A marked region: where its tag stands, the marked one around it, how it is marked, whether it holds an article.

    ``inside``: within an article.
    """
    __slots__ = ("at", "parent", "kind", "inside", "holds", "chars", "rich", "blocks", "own_chars", "own_rich")

    def __init__(self, at: int, parent: Region | None, kind: int, inside: bool):
        self.at, self.parent, self.kind, self.inside, self.holds = at, parent, kind, inside, False
        self.chars = self.rich = self.blocks = self.own_chars = self.own_rich = 0


#: Regions that may hold articles of their own (comments, teasers), which are no text of the page either.
DEEP_TAGS = frozenset("aside footer form dialog".split())
DEEP_WORDS = frozenset("aside sidebar footer comment comments disqus respond replies reply related recommended widget".split())


#: How a region is marked, from the weakest: a part of a name that has other meanings too (social-science), a part that sells
#: or means a region of its own, a form, a whole name, reader comments, any other tag or a role.
WEAK, PART, FORM, NAME, READERS, SURE = 1, 2, 3, 4, 5, 6
SELLING_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies
consent gdpr newsletter subscribe subscription signup login popup modal overlay""".split())
READER_WORDS = frozenset("comment comments disqus respond replies reply".split())


def marked_bad(tag: str, attributes: str, article: bool) -> tuple[int, int]:
    """Whether a region of this tag is no article text: 1, or 2 if articles in it aren't either; and how it is marked.

    A header belongs to the article if it is in it.
    """
    if tag in BAD_TAGS or tag == "header" and not article:
        return 1 + (tag in DEEP_TAGS), FORM if tag == "form" else SURE
    level = kind = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        value = a or b or c
        if name.lower() == "role":
            if value.lower() in BAD_ROLES:
                level, kind = max(level, 1 + (value.lower() == "complementary")), max(kind, FORM if value.lower() == "form" else SURE)
            continue
        for token in value.split():
            parts = [p.lower() for p in NAME_PARTS.findall(token)]
            if len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
                continue
            if named := BAD_WORDS.intersection(parts):
                level = max(level, 1 + bool(named & DEEP_WORDS))
                kind = max(kind, READERS if named & READER_WORDS else NAME if BAD_WORDS.issuperset(parts)
                           else PART if named & (DEEP_WORDS | SELLING_WORDS) else WEAK)
            elif not article and "header" in parts:
                level, kind = max(level, 1), max(kind, NAME if len(parts) == 1 else PART)
    return level, kind


def has_role(attributes: str, role: str) -> bool:
    return any(name.lower() == "role" and role in (a or b or c).lower().split() for name, a, b, c in ATTRIBUTE.findall(attributes))


def raw_end(page: str, tag: str, at: int) -> int:
    """Where to read on after the content of a raw tag, which begins at ``at``; the page's end if it isn't closed."""
    if tag not in RAW_NEXT:
        m = RAW_END[tag].search(page, at)
        return m.end() if m else len(page)
    unclosed = set()
    while m := RAW_NEXT[tag].search(page, at):
        at = m.end()
        if m.group(0).startswith("<!--"):
            at = page.find("-->", m.start() + 2)
            if at < 0:
                break
            at += 3
        elif m.group(1):
            inner = m.group(1).lower()
            if not m.group(2).endswith("/") and inner not in unclosed:
                if end := RAW_END[inner].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(inner)
        else:
            return at
    return len(page)


def blocks_of(page: str, unmarked: frozenset[int] = frozenset()) -> tuple[list[Block], list[Region]]:
    """The blocks and the marked regions of a page in order. ``article`` numbers the article a block lies in, 0: none.

    Regions whose tags stand at ``unmarked`` aren't marked.
    """
    out: list[Block] = []
    marks: list[Region] = []
    stack: list[tuple[str, int, int, Region | None]] = []  # tag, and what held before it: bad (0 to 2), article and marked region
    # open tags since the innermost article or main, it included, one count for each around it: a stray end tag
    # is known at once, and an end tag doesn't end the article around it
    open_tags = [Counter()]
    mains = 0
    region = None
    bad, article, articles, links = 0, 0, 0, 0
    block = Block(False, 0, False, False)

    def cut(heading=False):
        nonlocal block
        if block.text:
            out.append(block)
        block = Block(bad > 0, article, any(t[0] in ("li", "ul", "ol") for t in stack[-3:]), heading, region)

    tokens = TOKEN.finditer(page)
    while m := next(tokens, None):
        tag = m.group(2)
        if tag is None:
            if m.group(0)[:2] not in ("<!", "<?"):
                text = html_lib.unescape(m.group(0))
                block.text.append(text)
                if links:
                    block.linked += len(text)
            continue
        tag, closing, attributes = tag.lower(), m.group(1), m.group(3)
        if tag in RAW_TAGS:
            if not closing and not attributes.endswith("/"):
                tokens = TOKEN.finditer(page, raw_end(page, tag, m.end()))
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            block.text.append(" ")
        if tag not in BLOCK_TAGS and tag not in REGION_TAGS:
            continue
        if tag in REGION_TAGS and tag not in VOID_TAGS and not attributes.endswith("/"):
            if tag in BLOCK_TAGS:
                links = 0
            if closing:
                ended = None
                while ended != tag and (mains if tag == "main" else open_tags[-1][tag]):
                    ended, bad, article, region = stack.pop()
                    open_tags[-1][ended] -= 1
                    if ended in ("article", "main"):
                        open_tags.pop()
                        mains -= ended == "main"
            else:
                stack.append((tag, bad, article, region))
                if tag in ("article", "main"):
                    open_tags.append(Counter())
                    mains += tag == "main"
                open_tags[-1][tag] += 1
                opens = tag in ("article", "main") or "main" in attributes.lower() and has_role(attributes, "main")
                worse, kind = marked_bad(tag, attributes, bool(article)) if m.start() not in unmarked else (0, 0)
                if opens and not worse and not article and bad < 2:
                    articles += 1
                    article, bad, region = articles, 0, None  # an unclosed menu before an article ends here
                if worse:
                    region = Region(m.start(), region, kind, bool(article))
                    marks.append(region)
                if opens and region:
                    region.holds = True
                bad = max(bad, worse)
        if tag in BLOCK_TAGS:
            cut(not closing and tag in HEADINGS)
        elif tag == "span":
            # an inline region of its own (an advert within a line) is cut off, another one is not
            if block.bad != (bad > 0):
                cut()
    cut()
    return out, marks


def size_of(text: str) -> int:
    """Length of a text, wide signs counted ``WIDE`` fold."""
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(WIDE_SIGNS.findall(text))


def measured(blocks: list[Block]) -> tuple[list[tuple[Block, str, float, float]], bool]:
    """The blocks with text, it, and their shares of link text and stop words; and whether the page's language is known.

    If it isn't, stop words say nothing: all blocks have the share of ordinary text.
    """
    found, all_words, all_stops = [], 0, 0
    for b in blocks:
        raw = "".join(b.text)
        text = " ".join(raw.split())
        if text:
            words = text.lower().split()
            stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words)
            links = b.linked / max(1, len(raw))
            found.append((b, text, links, stops / len(words)))
            if not b.bad and links <= LINKS_HIGH:
                # signs of scripts without spaces count as words would
                all_words += max(len(words), size_of(text) // 12)
                all_stops += stops
    if all_stops >= STOP_UNKNOWN * all_words:
        return found, True
    return [(b, text, links, STOP_LOW) for b, text, links, _ in found], False


def outvoted(found: list[tuple[Block, str, float, float]], marks: list[Region]) -> frozenset[int]:
    """Where the tags of marked regions stand that hold the page's text, against their names."""
    chars = rich = 0  # outside marked regions
    for b, text, links, stops in found:
        full = len(text) if size_of(text) >= LONG and stops >= STOP_LOW and links <= LINKS_HIGH else 0
        if b.region:
            b.region.own_chars += len(text)
            b.region.own_rich += full
            b.region.blocks += full > 0
        else:
            chars += len(text)
            rich += full
    for r in reversed(marks):
        r.chars += r.own_chars
        r.rich += r.own_rich
        if r.parent:
            r.parent.chars += r.chars
            r.parent.rich += r.rich
            r.parent.blocks += r.blocks
            # an article of a name of its own is only its own
            r.parent.holds |= r.holds and r.kind < READERS
    has_article = any(b.article and not b.bad for b, *_ in found)
    #: What is unmarked for the regions within an outvoted one.
    out = {}
    for r in marks:
        weak = r.kind == WEAK and r.inside
        if r.kind == SURE or r.parent and r.parent.at not in out or has_article and not r.holds and not weak:
            continue
        c, f = out[r.parent.at] if r.parent else (chars, rich)
        only = r.holds and f == 0 and r.chars > c
        if weak:
            free = r.rich > 0
        elif r.kind in (WEAK, PART, FORM):
            free = r.rich > f or only
        elif r.kind == NAME:
            free = only or f == 0 and r.blocks >= 3
        else:
            free = not has_article and (only or f == 0 and r.rich > 10 * c)
        if free:
            out[r.at] = (c + r.own_chars, f + r.own_rich)
    return frozenset(out)


def main_text(page: str | None) -> str:
    texts: list[str] = []
    labels: list[int] = []  # 1 good, -1 bad, 0 undecided
    regions: list[int] = []
    blocks, marks = blocks_of(page or "")
    found, known = measured(blocks)
    if marks and (free := outvoted(found, marks)):
        found, known = measured(blocks_of(page, free)[0])
    has_article = any(b.article and not b.bad for b, *_ in found)
    for b, text, links, stops in found:
        if b.bad:
            label = -1
        elif has_article:
            if not b.article:
                label = -1
            elif links > LINKS_HIGH and b.listed:
                label = -1
            else:
                label = 1 if size_of(text) >= LONG or stops >= STOP_HIGH else 0
        elif links > LINKS_HIGH:
            label = -1
        elif not known:
            label = 1 if size_of(text) >= LONG else 0
        elif len(text) >= MEDIUM:
            label = 1 if stops >= STOP_HIGH or len(text) >= LONG and stops >= STOP_LOW else -1 if stops < STOP_LOW / 3 and len(text) < LONG else 0
        else:
            label = 0
        texts.append(text)
        labels.append(label)
        regions.append(b.article)
    headings = [b.heading for b, *_ in found]
    return "\n\n".join(text for text, label in zip(texts, inherited(labels, regions, has_article, headings)) if label > 0)


def inherited(labels: list[int], regions: list[int], has_article: bool, headings: list[bool]) -> list[int]:
    """The labels, undecided ones by the nearest decided block; the region's end is one (good for an article, else bad).

    Of two equally near ones a heading takes the one after it, another block the bad one.
    """
    end = 1 if has_article else -1
    n = len(labels)

    def nearest(order):
        """(steps, label) of the nearest decided block, or end, met before each one in this order."""
        out, steps, label, region = [(0, 0)] * n, 0, end, None
        for k in order:
            if regions[k] != region:
                steps, label, region = 0, end, regions[k]
            steps += 1
            out[k] = (steps, label)
            # within an article a cut-out menu or advert says nothing about the text beside it
            if labels[k] and not (has_article and labels[k] < 0):
                steps, label = 0, labels[k]
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for label, heading, (near, a), (far, b) in zip(labels, headings, before, after):
        if label == 0:
            label = a if near < far else b if far < near or heading else min(a, b)
        out.append(label)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                text = [main_text(h) for h in b.column(2).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), b.column(1).slice(at, 512), pa.array(text, pa.string()),
                                                  pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
