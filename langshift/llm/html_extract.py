"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words add to the score, tags subtract from it; the
weights are log odds of being inside the main text, learned from labelled pages: of a word by the
element that it stands in, of a tag by its name. One linear scan finds the contiguous region of the
largest sum. What the region holds of elements that are never main text (menus, forms, adverts and so
on, by element or by class) is left out. A class alone doesn't remove what holds most of the page: such
marks are held against the words that stand outside of them.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, declarations, tags. A quoted value ends where its quote closes and a blank, ``>`` or ``/>`` follows. A quote
#: without such an end belongs to no value: the tag ends at the next tag or ``>``, or with the line.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)
    ((?:[^>"'] | "[^"]*"(?=\s|/?>) | '[^']*'(?=\s|/?>) | "[^"<>\n]*(?:"|(?=[<>])) | '[^'<>\n]*(?:'|(?=[<>])) | ["'])*?)
    (?:> | (?=<[/!A-Za-z]) | "(?![^"]*"(?:\s|/?>))[^"<>\n]*\n | '(?![^']*'(?:\s|/?>))[^'<>\n]*\n | \Z)""",
    re.S | re.X,
)
LABELS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
NOT_SHOWN = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: Fixed values of HTML: elements without content, elements whose content is no markup, blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "head", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul dl".split())

#: Elements and words of a class, id or role that mark what is never main text.
NEVER = frozenset("aside button datalist dialog footer form head menu nav select".split()) | RAW
NEVER_WORDS = frozenset(
    "ad ads adbox adslot advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer "
    "menu modal navbar nav navigation newsletter notice notices pagination popup promo promotion related reply replies search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe toolbar widget".split()
)

#: A class, id or role marks an element only if each of its parts is one of the words above or one of these:
#: ``share-bar`` does, ``has-sidebar``, ``share-enabled`` and ``overflow-hidden`` don't.
NEUTRAL = frozenset(
    "a alert area article articles bar blob block blocks body bottom box btn button buttons by card center col column container content cta desktop dialog entry fixed float form "
    "gdpr global google group header heading icon icons inner item items label large law leave left legal link links list lists main media message mobile outer overlay page panel "
    "policy post posts primary reader readers respond right row secondary section settings site slot small sticky stories story tab tabs text thread title toggle top trail unit user users "
    "wrap wrapper".split()
)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+(?:x\d+)?|[^\W\d_]+")
#: These are never left out by a label, but for articles that are marked as ``REMARKS``. The first of ``HOLDERS`` on a page,
#: such articles apart, keeps what holds it.
KEPT = frozenset("html body main article".split())
HOLDERS = frozenset("article main".split())

#: Labels of what readers say, and labels that tell where a text stands, not what it is.
REMARKS = frozenset("comment comments disqus replies reply".split())
PLACES = frozenset("sidebar widget".split())

#: A paragraph has so many words. A marked element without the page's first heading holds most of the page if it has so
#: many times the words that stand outside of marked elements, and so many paragraphs.
PARAGRAPH, OUTWEIGHS, PARAGRAPHS = 10, 4, 3

#: Raw elements that run to the page's end if nothing closes them. The others end at their own tag.
TO_THE_END = frozenset("script style textarea title iframe noscript".split())

#: Weights without labelled pages, as published for this method.
WORD_WEIGHT, TAG_WEIGHT = 1.0, -3.25

#: Pages that the fit takes at most, about; the largest size of a weight; how often an element or tag has to
#: occur in these pages for a weight of its own. The rarer ones share one.
SAMPLE, LARGEST, COMMON = 1000, 4.0, 5
RARE = "*"


@dataclass
class Token:
    key: str
    words: list[str] | None  # None: a tag
    block: int = 0
    never: bool = False
    main: bool = False
    text: str = ""
    mark: int = -1  # the innermost marked element around it


@dataclass
class Weights:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, token: Token) -> float:
        if token.never:
            return 0.0  # left out in any case, so it must not part what stands around it
        if token.words is None:
            return self.tags.get(token.key, self.tags.get(RARE, TAG_WEIGHT if not self.tags else -0.5))
        return len(token.words) * self.words.get(token.key, self.words.get(RARE, WORD_WEIGHT))


def label_words(attributes: str) -> set[str]:
    """The words of ``NEVER_WORDS`` in those labels that consist of such and neutral words alone."""
    found = " ".join(next(filter(None, m.groups()), "") for m in LABELS.finditer(attributes))
    words = set()
    for name in found.split():
        parts = [p.lower() for p in PARTS.findall(name)]
        if all(p in NEVER_WORDS or p in NEUTRAL or p[0].isdigit() for p in parts):
            words |= NEVER_WORDS.intersection(parts)
    return words


def hidden(attributes: str) -> bool:
    return bool(HIDDEN.search(QUOTED.sub('""', attributes)) or NOT_SHOWN.search(attributes))


@dataclass
class Mark:
    """An element whose labels (or whose name, for forms) say that it is no main text."""

    parent: int
    form: bool
    remark: bool
    place: bool
    article: bool
    within: bool  # inside the page's first article or main
    falls: bool = False
    heading: bool = False
    own: int = 0
    words: int = 0
    paragraphs: int = 0


@dataclass
class Element:
    name: str
    key: str
    never: bool
    main: bool
    mark: int = -1
    within: bool = False


class Open:
    """The open elements, with counts by name in all and since the innermost scope, so that no tag has
    to look through them."""

    def __init__(self):
        self.stack, self.count, self.scopes = [], Counter(), [("", Counter())]

    def push(self, element: Element) -> None:
        self.stack.append(element)
        self.count[element.name] += 1
        self.scopes[-1][1][element.name] += 1
        if element.name in SCOPES:
            self.scopes.append((element.name, Counter()))

    def pop(self) -> Element:
        element = self.stack.pop()
        if element.name in SCOPES:
            self.scopes.pop()
        self.scopes[-1][1][element.name] -= 1
        self.count[element.name] -= 1
        return element

    def close(self, name: str) -> None:
        """An end tag: closes the innermost element of that name, if there is one."""
        if self.count[name]:
            while self.pop().name != name:
                pass

    def close_within(self, names: tuple[str, ...]) -> None:
        """Close the innermost of ``names`` that no container shields."""
        scope, inside = self.scopes[-1]
        if scope in names or any(inside[n] for n in names):
            while self.pop().name not in names:
                pass


def tokens(page: str) -> list[Token]:
    """The page's words and tags. ``key`` of words: the nearest block element and its labels."""
    sequence, marks, first = read(page)
    gone = standing(sequence, marks, first)
    for token in sequence:
        token.never = token.never or token.mark >= 0 and gone[token.mark]
    return sequence


def read(page: str) -> tuple[list[Token], list[Mark], bool]:
    """The page's words and tags in one pass, the marked elements, and whether there is a first article
    or main. ``never`` here: by element name or hidden, whatever the marks say."""
    opened, found, marks = Open(), [], []
    block = position = 0
    unclosed: set[str] = set()
    first = False
    headings: dict[str, int] = {}

    def top() -> Element:
        return opened.stack[-1] if opened.stack else Element("", "", False, False)

    def text(raw: str) -> None:
        plain, around = html.unescape(raw), top()
        found.append(Token(around.key, plain.split(), block, around.never, around.main, plain, around.mark))

    def up(mark: int, what: str) -> None:
        while mark >= 0 and not getattr(marks[mark], what):
            setattr(marks[mark], what, True)
            mark = marks[mark].parent

    while position < len(page):
        m = MARKUP.search(page, position)
        if m is None:
            text(page[position:])
            break
        if m.start() > position:
            text(page[position : m.start()])
        position = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            around = top()
            opened.close(name)
            block += name in BLOCK
            found.append(Token(f"/{name}", None, block, around.never, mark=around.mark))
            continue
        if name in CLOSES_P:
            opened.close_within(("p",))
        if name in SIBLINGS:
            opened.close_within(SIBLINGS[name])
        block += name in BLOCK
        labels = label_words(m[3]) if "=" in m[3] else set()
        around = top()
        inside = around.main or opened.count["article"] or opened.count["main"]
        never = around.never or name in NEVER - {"form"} or (name == "header" and not inside) or bool(m[3] and name not in KEPT and hidden(m[3]))
        mark, within = around.mark, around.within
        remark = bool(labels & REMARKS)
        if not never and (name == "form" or labels and name not in KEPT or name == "article" and remark):
            marks.append(Mark(mark, name == "form", remark, bool(labels) and labels <= PLACES, name == "article", within))
            mark = len(marks) - 1
        elif not never and name in HOLDERS and not first:
            first = within = True
            up(mark, "falls")
        if not never and name in ("h1", "h2", "h3"):
            headings.setdefault(name, mark)
        found.append(Token(name, None, block, never, mark=mark))
        if name in RAW:
            if name in ("svg", "math") and m[0].endswith("/>"):
                continue
            end = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, position)
            if end is None:
                unclosed.add(name)
            position = end.start() if end else len(page) if name in TO_THE_END else position
            continue
        if name in VOID:
            if name == "br":
                found.append(Token("", [], block, never, around.main, " ", mark))
            continue
        key = " ".join([name, *sorted(labels)]) if name in BLOCK or labels else around.key
        opened.push(Element(name, key, never, around.main or name == "article" and not remark, mark, within))
    if headings:
        title = min(headings)
        up(headings[title], "heading")
        if title == "h1":
            for mark in marks:
                mark.falls |= mark.form and mark.heading
                mark.remark &= not mark.heading
    return found, marks, first


def standing(sequence: list[Token], marks: list[Mark], first: bool) -> list[bool]:
    """For each mark, whether its element is left out. A mark falls if its element holds the first article
    or main, or most of what the page shows: more words than stand outside of all marks if it has the
    page's first heading too, else several times as many. Where there is an article or main, only marks
    inside it can fall. Marks of readers' remarks fall if they hold an h1, or for an article without which the page
    were empty. What falls counts as outside for the rest, which go from the heading and the largest on."""
    outside, long = 0, Counter()
    for token in sequence:
        if token.words and not token.never:
            if token.mark < 0:
                outside += len(token.words)
            else:
                marks[token.mark].own += len(token.words)
                long[token.mark, token.block] += len(token.words)
    for (mark, _), n in long.items():
        marks[mark].paragraphs += n >= PARAGRAPH
    inside: dict[int, list[int]] = {}
    for i in range(len(marks) - 1, -1, -1):
        mark = marks[i]
        mark.words += mark.own
        if mark.parent >= 0:
            marks[mark.parent].words += mark.words
            marks[mark.parent].paragraphs += mark.paragraphs
        inside.setdefault(mark.parent, []).append(i)

    def outweighs(mark: Mark) -> bool:
        if mark.remark:
            return mark.article and not outside
        if first and not mark.within:
            return False
        if mark.heading:
            return mark.words > outside
        return mark.words > OUTWEIGHS * outside and (mark.paragraphs >= PARAGRAPHS or mark.place and not outside)

    waiting: list[tuple[bool, bool, int, int]] = []

    def wait(parent: int) -> None:
        for i in inside.get(parent, ()):
            heapq.heappush(waiting, (not marks[i].falls, not marks[i].heading, -marks[i].words, i))

    fallen = set()
    wait(-1)
    while waiting:
        i = heapq.heappop(waiting)[-1]
        if marks[i].falls or outweighs(marks[i]):
            fallen.add(i)
            outside += marks[i].own
            wait(i)
    gone: list[bool] = []
    for i, mark in enumerate(marks):
        gone.append(i not in fallen or mark.parent >= 0 and gone[mark.parent])
    return gone


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first of the longest slices with the largest sum, if that is positive; else an empty one."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or total == best and best and i + 1 - start > region[1] - region[0]:
            best, region = total, (start, i + 1)
    return region


def extract(page: str, weights: Weights) -> str:
    """The main text: its blocks in page order, joined by line ends."""
    sequence = tokens(page)
    start, end = best_region([weights.of(t) for t in sequence])
    blocks: dict[int, list[str]] = {}
    for token in sequence[start:end]:
        if token.words is not None and not token.never:
            blocks.setdefault(token.block, []).append(token.text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def counts(page: str) -> dict[tuple[str, str], list[int]]:
    """How many words of each element, and how many of each tag, lie inside and outside the main text;
    without what is left out in any case."""
    sequence = [t for t in tokens(page) if not t.never]
    inside = [i for i, t in enumerate(sequence) if t.main and t.words]
    first, last = (inside[0], inside[-1]) if inside else (0, -1)
    found: dict[tuple[str, str], list[int]] = {}
    for i, token in enumerate(sequence):
        key = ("tag" if token.words is None else "word", token.key)
        part = first <= i <= last if token.words is None else token.main
        found.setdefault(key, [0, 0])[0 if part else 1] += 1 if token.words is None else len(token.words)
    return found


def learn(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from pages whose markup labels the main text: those with exactly one article element.

    The fit takes those among about ``sample`` pages, the ones with the smallest hashes of their ids.
    Weights are log odds with one count added, at most ``LARGEST`` in size, below zero for tags.
    Elements and tags that these pages hold fewer than ``COMMON`` times share one weight. Without a
    labelled page the published weights hold.
    """
    total = pages.count()
    if not total:
        return Weights()
    few = pages.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(total)) < sample)
    labelled = few.where(F.regexp_count(F.lower(html_col), F.lit(r"<article[\s>]")) == 1)

    def run(batches):
        for batch in batches:
            rows = [(*key, *n) for page in batch.column(0) for key, n in counts(page.as_py() or "").items()]
            kind, key, inside, outside = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.string()), pa.array(inside, pa.int64()), pa.array(outside, pa.int64())], ["kind", "key", "inside", "outside"])

    sums = [F.sum("inside").alias("inside"), F.sum("outside").alias("outside")]
    found = labelled.select(html_col).mapInArrow(run, "kind string, key string, inside long, outside long").groupBy("kind", "key").agg(*sums)
    own = F.when(F.col("inside") + F.col("outside") >= COMMON, F.col("key")).otherwise(F.lit(RARE))
    weights = Weights()
    for kind, key, inside, outside in found.groupBy("kind", own.alias("key")).agg(*sums).collect():  # at most what occurs COMMON times in the sample
        odds = max(-LARGEST, min(LARGEST, math.log((inside + 1) / (outside + 1))))
        if kind == "word":
            weights.words[key] = odds
        else:
            weights.tags[key] = min(-0.1, odds)
    return weights


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars (code points) of each page.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined
    by one line end. Null or empty html, and pages without a region of positive score: empty text, 0.
    A page whose only text lies in elements named like sidebars, widgets or notices keeps it (see ``standing``).
    Null and repeated ids are carried along; no rows: none out. Other columns are not read. Pages are
    read in place, each as a whole, without a shuffle.
    """
    weights = learn(pages, id_col=id_col, html_col=html_col) if weights is None else weights
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for batch in batches:
            texts = [extract(page.as_py() or "", weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
