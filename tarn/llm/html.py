"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides blocks on their own: by
link density, stop-word density and length, and by what they stand in. Short blocks and middling ones stay open; the
second pass gives each of these the label of its nearest decided neighbours. In an article or main element the neighbours are
looked for inside it, and an open block with none to follow belongs to the article. Where the first pass finds nothing
good, what is neither marked nor linked counts as good: first the blocks that aren't short, then any.

Menus, footers, asides and controls are boilerplate by their element. A name, role or style, or being a form, only marks an
element: the mark is evidence, which the text can outweigh (see ``_overruled``), as pages also name what encloses
their article after a sidebar beside it, a category or a form around it all.

A head ends at its end tag, at the body or at the first content. Elements without text of the page are skipped to their
end tag; one that has none is skipped to the page's end if it holds raw text, and else only its tag is. Time grows with a
page's length: a tag's end is looked for once, elements nested deeper than DEPTH take the place of the one at that depth.

Defined cases: a null or empty page has the empty text; broken markup (unclosed or stray tags,
unended comments, quotes or scripts) is read to its end; repeated rows are treated alike; of marks that hold equally much text each is
judged by the same rule; columns play no part but those named, whatever the others are called; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

# Elements by their role, and names by which pages mark what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("nav footer aside menu head title dialog button select textarea label input option search".split())
SOFT = frozenset("form fieldset".split())
SKIPPED = "script style noscript template iframe object svg math canvas audio video map textarea title select".split()
RAW = frozenset("script style title textarea".split())
IN_HEAD = frozenset("base link meta basefont bgsound noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
MARKS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay"
    r"|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|foot|masthead|topbar|toolbar"
    r"|comments?|disqus|replies|respond|related|recommended|share|sharing|social|subscribe|newsletter|signup|login|search"
    r"|copyright|legal|disclaimer|pagination|pager|tags|skip)(?:$|[_-])",
    re.IGNORECASE,
)
# names that tell of the page, its layout or its topic, not of the element
_STATES = re.compile(r"(?:has|with|without|no|is|js|category|cat|tag|post|page|type|status|format|layout|template|theme|topic|author|term|lang)[-_]", re.IGNORECASE)
# what stands beside an article as text of its own, and what encloses others
BESIDE = re.compile(r"(?:^|[_-])(?:comments?|disqus|replies|respond|related|recommended)(?:$|[_-])", re.IGNORECASE)
APART = re.compile(r"(?:^|[_-])(?:cookies?|consent|gdpr|popup|modal|overlay|nav|navbar|navigation|menu)(?:$|[_-])", re.IGNORECASE)
AROUND = re.compile(r"(?:^|[_-])(?:wrap|wrapper|wrapped|container|content|main|inner|body|site|grid|row|cols?|columns?|primary|area|layout)(?:$|[_-])", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this at are from or an not but have they which you we his her "
    "la le les de des et en un une que qui est dans pour pas du au sur avec elle il ne ce se plus son par "
    "der die das und den von zu ist mit nicht ein eine dem auf für im es sich auch als war er sie "
    "el los las del y por con para una su lo no al como más pero sus o".split()
)
LINKS_MOST, SHORT, LONG, FEW, MANY = 0.33, 70, 200, 0.08, 0.2
#: Elements that stand in one another, at most.
DEPTH = 512
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_VALUE = re.compile(r"[^>=]*+(?:=\s*+([\"']?)|>)")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in SKIPPED}
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[^\W\d_]+")
GOOD, BAD, OPEN = 1, -1, 0


NONE, WEAK, BY_LAYOUT, FIRM, DROP = range(5)


def _mark(name: str, attrs: str) -> int:
    """How an element is marked as boilerplate: weakly (by a name or as a form), by a name that also tells of what encloses others, firmly (beside the article, or hidden), or dropped by its kind."""
    if name in DROPPED:
        return DROP
    mark = NONE
    default = BY_LAYOUT if name in SOFT else NONE
    if not attrs.strip() or name in ("html", "body"):
        return default
    for key, *value in _ATTR.findall(attrs):
        key, said = key.lower(), "".join(value)
        if key in ("class", "id"):
            for x in said.split():
                if MARKS.search(x) and not _STATES.match(x):
                    mark = max(mark, FIRM if BESIDE.search(x) else BY_LAYOUT if AROUND.search(x) else FIRM if APART.search(x) else WEAK)
        elif key == "role" and said.lower() in ROLES:
            mark = max(mark, BY_LAYOUT if said.lower() == "form" else FIRM)
        elif key == "aria-hidden" and said.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said, re.IGNORECASE):
            return DROP
    return DROP if re.search(r"(?:^|\s)hidden(?:\s|$)", attrs, re.IGNORECASE) else mark or default


class Block:
    __slots__ = ("text", "linked", "bad", "region", "label", "heading", "marks")

    def __init__(self, text: str, linked: int, bad: bool, region: int, heading: int, marks: tuple = ()) -> None:
        self.text, self.linked, self.bad, self.region, self.heading, self.label, self.marks = text, linked, bad, region, heading, OPEN, marks

    @property
    def prose(self) -> int:
        """Characters that read like running text, in any language."""
        return len(self.text) if len(self.text) >= SHORT and self.linked <= LINKS_MOST * len(self.text) else 0


class _Open:
    """An element that is open: its name, whether it is dropped, its region and the marks on it and around it."""

    __slots__ = ("name", "bad", "region", "marks")

    def __init__(self, name: str, bad: bool, region: int, marks: tuple) -> None:
        self.name, self.bad, self.region, self.marks = name, bad, region, marks


class _Tags:
    """Finds where tags end; each search that fails is made once a page."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at ``at``; quoted values may hold one. -1: none."""
        if at > self.last:
            return -1
        begin = at
        while self.quoted:
            m = _VALUE.match(self.page, at)
            if not m:
                break
            if m[1] is None:
                return m.end() - 1
            at = m.end()
            if m[1]:
                at = self.page.find(m[1], at) + 1
                if not at:
                    break
        self.quoted = False  # a quote that isn't ended: from here on quotes are text
        return self.page.find(">", begin)


_INLINE = frozenset("a span b strong em i u small font ins".split())
_SELF_ENDING = frozenset("p li dt dd option tr td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def blocks(page: str) -> tuple[list[Block], list[tuple[int, bool]]]:
    """The blocks of a page, in order, and the kinds of its marks, with whether an article or main element is what bears it.

    A block's region is the number of the outermost article or main element, 0 outside; marks are numbers of marks.
    """
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[_Open] = []
    held: dict[str, int] = {}  # open elements by name
    marks: list[tuple[int, bool]] = []
    regions = 0
    tags = _Tags(page)

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else _Open("", False, 0, ())
            heading = next((int(x.name[1]) for x in stack[-2:] if x.name in _HEADINGS), 0)
            out.append(Block(text, linked, top.bad, top.region, heading, top.marks))
        parts.clear()
        linked = 0

    def cut(size: int) -> None:
        while len(stack) > size:
            held[stack.pop().name] -= 1

    def end_head() -> None:
        if stack and stack[-1].name == "head":
            end()
            cut(len(stack) - 1)

    def add(text: str) -> None:
        nonlocal linked
        if text.strip():
            end_head()
        parts.append(text)
        if held.get("a"):
            linked += len(" ".join(text.split()))

    def start(name: str, attrs: str) -> None:
        nonlocal regions
        block = name in BLOCKS
        if name in _SELF_ENDING:  # these end one of their kind that is open
            if held.get(name):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        cut(i)
                        break
                    if stack[i].name in BLOCKS and stack[i].name != "p":
                        break
        elif block and held.get("p"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    cut(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        if not block and (name not in _INLINE and name not in DROPPED or attrs.rstrip().endswith("/")):
            return
        around = stack[-1] if stack else _Open("", False, 0, ())
        mark = _mark(name, attrs)
        bad, region, own = around.bad or mark == DROP or (name == "header" and not around.region), around.region, around.marks
        if mark and not bad:
            own = (*own, len(marks)) if len(own) < 64 else own
            marks.append((mark, name in MAIN))
        if name in MAIN and not region and not bad:
            regions += 1
            region = regions
        if len(stack) >= DEPTH:
            cut(DEPTH - 1)
        stack.append(_Open(name, bad, region, own))
        held[name] = held.get(name, 0) + 1

    def close(name: str) -> None:
        if held.get(name):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    cut(i)
                    break
                if stack[i].name in BLOCKS and name not in BLOCKS:
                    break

    at, size = 0, len(page)
    unclosed: set[str] = set()  # elements without an end tag from here on
    while at < size:
        here = page.find("<", at)
        if here != at:
            add(page[at : here if here >= 0 else size])
            if here < 0:
                break
        if page.startswith("<!--", here):
            at = page.find("-->", here + 4) + 3
            at = size if at < 3 else at
            continue
        if page.startswith("<![CDATA[", here):
            at = page.find("]]>", here + 9) + 3
            add(page[here + 9 : at - 3 if at > 2 else size])
            at = size if at < 3 else at
            continue
        closing = page.startswith("/", here + 1)
        m = _NAME.match(page, here + 1 + closing)
        if not m:
            at = here + 1
            if closing or page[at : at + 1] in ("!", "?"):
                stop = page.find(">", at) if at <= tags.last else -1
                at = stop + 1 if stop >= 0 else at
                if stop < 0:
                    add("<")
            else:
                add("<")
            continue
        stop = tags.end(m.end())
        if stop < 0:  # a tag that isn't ended
            add("<")
            at = here + 1
            continue
        name, attrs, at = m[0].lower(), page[m.end() : stop], stop + 1
        if not closing and name in _CLOSE:
            parts.append(" ")
            if name in ("svg", "math") and attrs.endswith("/"):
                continue
            found = None if name in unclosed else _CLOSE[name].search(page, at)
            if found:
                at = found.end()
            else:
                unclosed.add(name)
                at = size if name in RAW else at
            continue
        if not closing and name not in IN_HEAD:
            end_head()
        if name in VOID:
            parts.append(" ")
            if name == "hr":
                end()
            continue
        if name in BLOCKS:
            end()
        if closing:
            close(name)
        else:
            start(name, attrs)
    end()
    return out, marks


def _overruled(found: list[Block], marks: list[tuple[int, bool]]) -> set[int]:
    """The marks that the text outweighs. Text in firm marks is no evidence, unless there is no other running text.

    None is, if an article or main element that isn't marked holds text. Else, if such an element stands in marks and holds more
    running text than all that isn't marked, the marks around it are overruled, its own included. In a page without such an element a mark
    of a form or of layout is, if it holds more than twice what isn't marked, or the first title and some running text; any mark
    is, if it holds ten times the text outside of marks. Both take at least half of what the mark of the most running text holds.
    """
    kept = [b for b in found if not b.bad]
    plain = [b for b in kept if not b.marks and b.linked <= LINKS_MOST * len(b.text)]
    if not marks or any(b.region for b in plain):
        return set()
    free = sum(b.prose for b in plain)
    fair = [b for b in kept if b.prose and not any(marks[m][0] == FIRM for m in b.marks)]
    inside: dict[int, int] = {}
    region: dict[int, int] = {}
    for b in fair or kept:
        if b.region:
            region[b.region] = region.get(b.region, 0) + b.prose
        for m in b.marks:
            inside[m] = inside.get(m, 0) + b.prose
    best = max(region, key=lambda r: (region[r], -r), default=0)
    if fair and best and region[best] > free:
        return set(min((b.marks for b in fair if b.region == best), key=len))
    title = next((set(b.marks) for b in kept if b.heading == 1), set())
    most = max(inside.values(), default=0)
    out = {m for m, n in inside.items() if 2 * n > most and marks[m][0] == BY_LAYOUT and (n > 2 * free or m in title)}
    if not out:
        least = 10 * sum(len(b.text) for b in plain)
        out = {m for m, n in inside.items() if 2 * n > most and n > least}
    return out


def _alone(block: Block) -> int:
    """The first pass."""
    if block.bad:
        return BAD
    size = len(block.text)
    if block.linked > LINKS_MOST * size:
        return BAD
    words = _WORD.findall(block.text.lower())
    if not words:
        return OPEN
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if size < SHORT:
        return OPEN
    if stops >= MANY:
        return GOOD
    if stops >= FEW or size >= LONG and block.region:
        return GOOD if size >= LONG else OPEN
    return OPEN if block.region else BAD


def classify(found: list[Block], marks: list[tuple[int, bool]]) -> list[Block]:
    """Labels the blocks, in both passes."""
    void = _overruled(found, marks)
    for block in found:
        block.bad = block.bad or any(m not in void for m in block.marks)
        block.label = _alone(block)
    own = any(b.region and b.label == GOOD for b in found) or any(b.region and not b.bad for b in found)
    for least in (SHORT, 0):  # in a language without known stop words, or of short blocks only, what isn't marked or linked counts
        if not any(b.label == GOOD for b in found):
            for block in found:
                if not block.bad and len(block.text) >= least and block.linked <= LINKS_MOST * len(block.text):
                    block.label = GOOD
    decided = [b.label for b in found]
    # the nearest decided label before and behind, inside the region for blocks of one
    before: list[int] = []
    last: dict[int, int] = {}
    for block, label in zip(found, decided):
        key = block.region
        before.append(last.get(key, OPEN))
        if label != OPEN and not (key and block.bad):
            last[key] = label
    last = {}
    for i in range(len(found) - 1, -1, -1):
        block, key = found[i], found[i].region
        behind = last.get(key, OPEN)
        if decided[i] != OPEN:
            if not (key and block.bad):
                last[key] = decided[i]
            continue
        near = [x for x in (before[i], behind) if x != OPEN]
        if key:
            block.label = GOOD if not near or GOOD in near else BAD
        elif own:
            block.label = BAD  # the article is elsewhere
        elif block.heading:
            block.label = GOOD if behind == GOOD else BAD
        else:
            block.label = GOOD if near and all(x == GOOD for x in near) else BAD
    return found


def extract(page: str | None) -> str:
    """The main text of a page: its good blocks, one a line."""
    return "\n".join(b.text for b in classify(*blocks(page or "")) if b.label == GOOD)


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text and n_chars."""
    picked = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = picked.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in chunks(texts, 1_000_000):
                found = [extract(x) for x in texts[a:b]]
                columns = [batch.column(i)[a:b] for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=schema.names)

    return picked.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
