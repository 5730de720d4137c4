"""Main text of web pages: flat text blocks with word count and link density of their neighbours, kept or not by a decision tree."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import map_arrow, read

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r""">|=\s*["']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements that hold no tags and end at their own end tag only.
RAW = frozenset("script style textarea title".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Other elements whose content is no text of the page.
DROPPED = frozenset("noscript template iframe svg math object canvas audio video select option button".split())
#: Elements that part blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that contain others and whose names tell of their content.
CONTAINER = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header li main menu nav ol search section table td ul".split())
#: Elements and names that never hold the article; what they hold is around it, whatever its own names are.
NEVER = frozenset("nav footer aside menu dialog".split())
NAMES_NEVER = frozenset(
    "ad ads advert adverts advertisement adv sponsor sponsored promo promoted promotion breadcrumb breadcrumbs comment comments reply replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay footer copyright share sharing social related recommended recommendations newsletter subscribe subscription pagination pager complementary contentinfo".split()
)
#: Elements and names that mostly are around the article, but are used of frames of a whole page too: an article within them is one.
OFTEN = frozenset("form search".split())
NAMES_OFTEN = frozenset("banner nav navbar navigation menu sidebar side foot signup login search widget widgets toolbar masthead topbar header skip toc tags".split())
#: Names that tell of the article itself; of the second kind only where nothing around it is told.
NAMES_ARTICLE, NAMES_TEXT = frozenset("article post entry story".split()), frozenset("content main body text prose".split())
#: First and last parts of a class that tells of the state of a page, not of what an element holds.
STATES_FIRST = frozenset("has is no not with without js layout".split())
STATES_LAST = frozenset("open opened closed active visible hidden enabled disabled collapsed expanded layout page".split())
#: Words by which a heading opens the comments of readers.
COMMENTS = frozenset("comment comments reply replies responses kommentar kommentare commentaire commentaires réaction réactions comentario comentarios respuestas".split())


@dataclass
class Block:
    text: str
    words: int
    linked: float
    article: bool
    around: int  # 0 nothing around the article, 1 often so, 2 always so
    kind: int  # 0 other, 1 paragraph, 2 heading, 3 list item or cell
    commented: bool  # after a heading of comments, in the part that it heads
    mark: str


def _place(name: str, attributes: str, article: bool, around: int) -> tuple[bool, int]:
    """(article, around) of what an element holds, given those of where it stands."""
    if name in ("html", "body"):  # classes of a page tell of its layout
        return False, 0
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        for one in (m[2] or m[3] or m[4] or "").lower().split():
            parts = re.findall(r"[a-z]+", one)
            if parts and not (len(parts) > 1 and (parts[0] in STATES_FIRST or parts[-1] in STATES_LAST)):
                names.update(parts)
    told = name == "article" or name == "main" or bool(names & NAMES_ARTICLE)
    if name in NEVER or (names & NAMES_NEVER):
        return False, 2
    if around == 2:
        return False, 2
    often = names & NAMES_OFTEN
    if told and not often - {"header", "side", "tags"}:
        return True, 0
    if article:
        often = often - {"header"}
    if name in OFTEN or often or (name == "header" and not article):
        return article, 1
    return article or (not around and bool(names & NAMES_TEXT)), around


class Tag:
    __slots__ = ("attributes", "closing", "end", "name", "partner", "start")

    def __init__(self, start: int, end: int, name: str, closing: bool, attributes: str):
        self.start, self.end, self.name, self.closing, self.attributes = start, end, name, closing, attributes
        self.partner = -1  # of an end tag the number of its start tag, and the reverse


def tags(page: str) -> list[Tag]:
    """The tags of a page in order, with comments and what raw elements hold as tags of the names '!' and '#'. Each place is looked at a bounded number of times."""
    out: list[Tag] = []
    at, n = 0, len(page)
    known: dict[str, tuple[int, int]] = {}  # from where each string was last looked for, and where it was
    lenient = False

    def find(what: str, start: int) -> int:
        since, found = known.get(what, (1, 0))
        if since <= start and (found < 0 or start <= found):
            return found
        found = page.find(what, start)
        known[what] = start, found
        return found

    while (at := find("<", at)) >= 0:
        if find(">", at) < 0:  # no tag is closed any more, only a comment may hold the rest
            rest = page.find("<!--", at)
            out += [Tag(rest, n, "!", False, "")] if rest >= 0 else []
            break
        if page.startswith("<!--", at):
            end = find("-->", at + 4)
            end = n if end < 0 else end + 3
            out.append(Tag(at, end, "!", False, ""))
            at = end
            continue
        closing = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            if page[at + 1 : at + 2] in ("/", "!", "?"):
                end = find(">", at) + 1
                out.append(Tag(at, end, "!", False, ""))
                at = end
            else:
                at += 1
            continue
        start = end = m.end()
        stop = find(">", end)
        while not lenient:  # the next > outside quoted values
            special = _SPECIAL.search(page, end)
            if special is None:  # none: from here on quotes don't count
                lenient = True
            elif special[0] == ">":
                stop = special.start()
                break
            else:
                close = find(special[0][-1], special.end())
                end = special.end() if close < 0 else close + 1
        name = m[0].lower()
        out.append(Tag(at, stop + 1, name, closing, page[start:stop]))
        at = stop + 1
        if name in RAW and not closing and not out[-1].attributes.endswith("/"):
            last = re.compile(rf"</{name}(?![\w-])", re.I).search(page, at)
            end = find(">", last.end()) + 1 if last else n
            end = end or n
            out.append(Tag(at, end, "#", False, ""))
            at = end
    return out


def _paired(found: list[Tag]) -> None:
    """Set the partner of each start tag and end tag that belong together: an end tag closes the last open element of its name and all within it."""
    opened: list[int] = []
    many: dict[str, int] = {}
    for k, tag in enumerate(found):
        if tag.name in ("!", "#") or tag.name in VOID or tag.name in RAW or (not tag.closing and tag.attributes.endswith("/")):
            continue
        if not tag.closing:
            opened.append(k)
            many[tag.name] = many.get(tag.name, 0) + 1
        elif many.get(tag.name):
            while True:
                last = opened.pop()
                many[found[last].name] -= 1
                if found[last].name == tag.name:
                    found[last].partner, tag.partner = k, last
                    break


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order; marks (comments of the form "mark:x") are for labelled pages."""
    out: list[Block] = []
    found = tags(page)
    _paired(found)
    stack: list[tuple[str, bool, int, bool]] = []  # name, article, around, commented
    parts: list[str] = []
    kind, link, link_words, at, mark, marked = 0, 0, 0, 0, "", ""
    root_commented = False

    def flush() -> None:
        nonlocal parts, link_words, root_commented
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            words = text.count(" ") + 1
            _, article, around, commented = stack[-1] if stack else ("", False, 0, root_commented)
            if (kind == 2 or words <= 4) and not commented and link_words == 0 and _heads_comments(text, words):
                commented = True
                if stack:
                    stack[-1] = (*stack[-1][:3], True)
                else:
                    root_commented = True
            out.append(Block(text, words, min(1.0, link_words / words), article, around, kind, commented, marked))
        parts, link_words = [], 0

    def add(raw: str) -> None:
        nonlocal link_words, marked
        text = entities.unescape(raw) if "&" in raw else raw
        if not parts and not text.isspace():
            marked = mark
        parts.append(text)
        if link:
            link_words += len(text.split())

    k = 0
    while k < len(found):
        tag = found[k]
        if tag.start > at:
            add(page[at : tag.start])
        at, name, k = tag.end, tag.name, k + 1
        if name == "!":
            if page.startswith("<!--mark:", tag.start):
                mark = page[tag.start + 9 : tag.end - 3]
        elif name in DROPPED:
            if not tag.closing and not tag.attributes.endswith("/"):
                if tag.partner >= 0:
                    at, k = found[tag.partner].end, tag.partner + 1
                else:  # left open: to the next block, the next of its name or the end of an element around it
                    mine = k - 1
                    while k < len(found) and not (found[k].name in BLOCK and not found[k].closing or found[k].name == name and not found[k].closing or found[k].closing and 0 <= found[k].partner < mine):
                        k += 1
                    at = found[k].start if k < len(found) else len(page)
        elif name == "a":
            link = 0 if tag.closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            link = 0
            kind = 0 if tag.closing else 1 if name == "p" else 2 if name in ("h1", "h2", "h3", "h4", "h5", "h6") else 3 if name in ("li", "td", "th", "dd", "dt") else 0
            if name in CONTAINER:
                if not tag.closing:
                    _, article, around, commented = stack[-1] if stack else ("", False, 0, root_commented)
                    stack.append((name, *_place(name, tag.attributes, article, around), commented))
                elif tag.partner >= 0:
                    while stack and stack.pop()[0] != name:
                        pass
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _heads_comments(text: str, words: int) -> bool:
    """Whether a short text heads the comments of readers: it names them and is little else."""
    if words > 4:
        return False
    told = re.findall(r"[^\W\d_]+", text.lower())
    return bool(COMMENTS & set(told)) and len(told) <= 3 and text[-1] not in ".!?"


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in article", "around", "kind", "ends as a sentence", "after a heading of comments", "page tells its article")


def features(found: list[Block]) -> np.ndarray:
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([(min(b.words, 1000), b.linked) for b in found], float)
    pad = np.vstack([[0, 0], own, [0, 0]])
    told = float(any(b.article and b.around < 2 for b in found))
    rest = np.array([(b.article, b.around, b.kind, b.text[-1] in ".!?…:;\"'”»)", b.commented, told) for b in found], float)
    return np.hstack([own, pad[:-2], pad[2:], rest])


# A small labelled table: page layouts as rows (keep, HTML); {n} stands for n words of prose, [n] for n words of a title.
LAYOUTS = (
    ((0, '<div class="top"><a href="/">[2]</a> <a href="/a">[1]</a></div><nav><ul><li><a>[1]</a></li><li><a>[2]</a></li><li><a>[1]</a></li></ul></nav>'), (0, '<div class="ad">{14}</div>'), (1, "<article><h1>[6]</h1><p>{60}</p><p>{3}</p><p>{45}</p><h2>[3]</h2><p>{12}</p><ul><li>{9}</li><li>{4}</li></ul></article>"), (0, "<footer>© [2]. {20}</footer>")),
    ((0, '<header><h1><a href="/">[2]</a></h1><p>{7}</p></header><div id="menu"><a>[1]</a> | <a>[1]</a> | <a>[2]</a></div>'), (1, '<div id="content"><h2>[7]</h2><p>{50}</p><p>{30} <a>[2]</a> {10}</p><blockquote>{25}</blockquote><p>{2}</p></div>'), (0, '<div id="sidebar"><h3>[2]</h3><ul><li><a>[4]</a></li><li><a>[5]</a></li></ul><p>{22}</p></div><div id="footer"><p>{15}</p></div>')),
    ((0, '<div class="cookie-notice"><p>{24}</p><button>[1]</button></div><nav><a>[1]</a><a>[1]</a></nav>'), (1, "<main><h1>[5]</h1><p>{80}</p><p>{6}</p><pre>{12}</pre><table><tr><td>{3}</td><td>{2}</td></tr></table><p>{40}</p></main>"), (0, '<section id="comments"><h3>[1]</h3><div class="comment"><p>{18}</p></div><div class="comment"><p>{35}</p></div><form><label>[2]</label><p>{8}</p></form></section><footer><p>{10} <a>[1]</a></p></footer>')),
    ((0, "<div><a>[1]</a> <a>[1]</a> <a>[1]</a> <a>[2]</a></div><div>[3]</div>"), (1, "<div><p>{55}</p><p>{70}</p><p>{4}</p><p>{33}</p></div>"), (0, "<div><a>[4]</a></div><div><a>[5]</a></div><div><a>[3]</a></div><div>© [3]</div>")),
    ((0, "<table><tr><td><a>[2]</a></td><td><a>[1]</a></td></tr></table>"), (1, "<h1>[6]</h1><div>{48}</div><div>{64}</div><div>{20}</div>"), (0, "<div><a>[2]</a> | <a>[2]</a></div><p>[2]</p>")),
    ((0, '<nav><a>[1]</a></nav><div class="banner">{11}</div>'), (1, "<article><header><h1>[7]</h1></header><p>{1}</p><p>{90}</p><p>{5}</p>"), (0, '<div class="advert"><p>{16}</p></div>'), (1, "<p>{38}</p><p>{8}</p>"), (0, '<aside><h4>[2]</h4><p>{28}</p><ul><li><a>[5]</a></li></ul></aside>'), (1, "<p>{52}</p></article>"), (0, '<div class="related"><h3>[2]</h3><p><a>[6]</a></p><p>{12}</p></div><footer>{30}</footer>')),
    ((0, '<form action="/s"><p>[2]</p></form><ul class="menu"><li><a>[1]</a></li><li><a>[1]</a></li></ul>'), (1, '<div class="post"><h1>[4]</h1><p>{2}</p></div>'), (0, '<div class="share">[3]</div><div class="newsletter"><p>{17}</p></div><div class="comments"><p>{44}</p><p>{3}</p></div><footer><p>[5]</p></footer>')),
    ((1, "<article><h1>[5]</h1><p>{50}</p><p>[3]</p><div>[4]</div><p>{20}</p><p><a>[5]</a></p><ul><li><a>[2]</a></li></ul><p>{1}</p><p>[40]</p></article>"),),
    ((1, "<p>{60}</p><p>{30}</p>"),),
    ((1, "<div>{200}</div>"),),
    ((1, "<p>[50]</p><p>[80]</p>"),),
    ((1, '<div class="story"><p>[2]</p><p>{45}</p><p>[35]</p></div>'),),
    ((0, "<nav><a>[1]</a><a>[2]</a></nav>"), (1, "<article>[60]<p>[25]</p><p>{70}</p><p>[2]</p>")),
    ((0, '<div class="nav"><a>[1]</a> <a>[2]</a></div><div class="ads">{20}</div>'), (1, "<main><h1>[4]</h1><p>{30}</p><p><a>[6]</a></p><div>[30]</div><p>[4]</p></main>"), (0, "<p>[6]</p><div><a>[3]</a></div>")),
    ((1, "<article><h1>[5]</h1><p>{40}</p><p>{5}</p></article>"), (0, '<div class="comments"><p>{40}</p><p>{12}</p></div>')),
    ((0, "<div>[2]</div><div><a>[1]</a></div><ul><li><a>[2]</a></li><li><a>[1]</a></li></ul>"), (1, "<div><h2>[5]</h2><p>{75}</p><ul><li>{14}</li><li>{11}</li><li>{19}</li></ul><p>{42}</p></div>"), (0, "<ul><li><a>[3]</a></li><li><a>[4]</a></li></ul><div>[4] <a>[1]</a></div>")),
    # Pages that tell nothing of their parts: what stands beside a block decides.
    ((0, "<div><a>[1]</a></div><div><a>[2]</a></div><div>[2]</div><div><a>[1]</a></div>"), (1, "<div>[6]</div><div>{70}</div><div>{5}</div><div>{40}</div><div>[3]</div><div>{55}</div>"), (0, "<div><a>[3]</a></div><div>[3]</div><div><a>[2]</a></div><div>[4]</div><div><a>[4]</a></div>")),
    ((0, "<ul><li><a>[1]</a></li><li>[2]</li><li><a>[2]</a></li></ul><p><a>[1]</a></p><p>[3]</p><p><a>[2]</a></p>"), (1, "<p>{30}</p><p>{4}</p><p>{60}</p><p>[2]</p><p>{35}</p>"), (0, "<p><a>[5]</a></p><p>[2]</p><p><a>[6]</a></p><p>[5]</p>")),
    ((0, "<table><tr><td><a>[1]</a></td><td>[1]</td><td><a>[2]</a></td></tr></table>"), (1, "<h2>[4]</h2><p>{28}</p><p>{2}</p><p>{44}</p><h3>[2]</h3><p>{37}</p><p>{6}</p><p>{26}</p>"), (0, "<p><a>[2]</a> - <a>[2]</a> - <a>[1]</a></p><p>© [2]</p><p><a>[1]</a></p>")),
    # Frames around a whole page that are named like its parts, and comments that only a heading tells of.
    ((0, '<form id="f"><div><a>[1]</a> <a>[2]</a></div>'), (1, "<div><h1>[5]</h1><p>{60}</p><p>{12}</p><p>{45}</p></div>"), (0, "<div><a>[3]</a></div><div><input>[2]</div></form>")),
    ((0, '<div class="search sidebar"><p><a>[2]</a></p>'), (1, "<div><h1>[6]</h1><p>{52}</p><p>{9}</p><p>{71}</p></div>"), (0, "<p>[2]</p><p><a>[4]</a></p></div>")),
    ((0, '<div class="login"><p>{6}</p><p>[1]</p></div>'), (1, "<article><h1>[5]</h1><p>{65}</p><p>{14}</p></article>"), (0, '<div class="sidebar"><p>{30}</p><p>{11}</p></div><div class="widget"><p>{45}</p></div>')),
    ((1, "<article><h1>[5]</h1><p>{40}</p><p>{25}</p></article>"), (0, "<div><h3>3 comments</h3><div>[1]</div><p>{30}</p><p>{9}</p><div>[2]</div><p>{52}</p></div>")),
    ((1, "<div><h1>[5]</h1><p>{40}</p><p>{25}</p>"), (0, "<section><h2>Comments</h2><p>{33}</p><p>{12}</p><p>{61}</p></section></div><p>[3]</p>")),
    ((0, "<div>{13}</div>"), (1, "<article><h1>[7]</h1><p>{80}</p><p>{3}</p></article>"), (0, "<div><p>{36}</p></div><div>{24}</div>")),
)
_FILL = re.compile(r"\{(\d+)\}|\[(\d+)\]")


def labelled_pages(copies: int = 8, seed: int = 7) -> list[str]:
    """The labelled table as pages with marks: each layout some times over, with other lengths."""
    draw = random.Random(seed)
    syllables = "ka lo mi ren tas vel or ith un sel dar po".split()

    def fill(m: re.Match) -> str:
        n = max(1, round(int(m[1] or m[2]) * draw.uniform(0.6, 1.6)))
        text = " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n))
        return text.capitalize() + ("." if m[1] else "")

    return ["<html><body>" + "".join(f"<!--mark:{keep}-->{_FILL.sub(fill, piece)}" for keep, piece in layout) + "</body></html>" for _ in range(copies) for layout in LAYOUTS]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4):
    """A decision tree by Gini impurity: a share of 1 at a leaf, else (feature, bound, at most, above)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y) - 1e-9, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        cost = left * (1 - left) * n + right * (1 - right) * (len(y) - n)
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        at = int(np.argmin(cost))
        if cost[at] < best[0]:
            best = (float(cost[at]), f, float((v[at] + v[at + 1]) / 2))
    if not best[2] and best[1] == 0:
        return share
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def train():
    """The tree of the labelled table."""
    pages = [blocks(p) for p in labelled_pages()]
    x = np.vstack([features(p) for p in pages])
    y = np.array([b.mark == "1" for p in pages for b in p], float)
    return grow(x, y)


def kept(tree, row: np.ndarray) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(tree, page: str | None) -> str:
    """The kept blocks of a page, joined by line feeds; '' for a null or empty page and where nothing is kept."""
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if kept(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html), from its whole html.

    Null html counts as empty; its text is ''. Tags left open or closed twice are no error; only a script, style,
    textarea or title left open holds the rest of the page. Repeated rows stay, an empty table gives no
    rows, other columns are ignored. Rows are read once, without a shuffle; the tree is a few hundred numbers in the task's code.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(tree, x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")


def op6_mainhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op6_mainhtml": op6_mainhtml}
ORACLE: dict[str, str] = {}
