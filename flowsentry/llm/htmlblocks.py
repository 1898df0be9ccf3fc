"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Menus, footers, headers outside the article, asides and controls are
boilerplate. Class and id names, taken apart into words, and forms are evidence. Words that name furniture (comments,
adverts, sidebars, consent notices ...) make what they wrap boilerplate unless it holds the largest <article> or <main>,
or, on a page without a long one outside, half of the text. Words that may as well name a subject (social, related ...)
only leave the blocks inside to the density rules. All other blocks are labelled by link density, length and stop-word
density. If the marked main parts hold half of the text, they are a prior: inside, unlinked blocks of any length are at
least ambiguous; outside, only long ones count. A page with few known stop words is judged by length and links. Short
and middling blocks stay ambiguous; in the second pass they take the label of the nearest decided neighbours,
inside the main parts of those there.

Defined results: a null or empty page has the empty text. White space inside a block becomes one space, blocks are
trimmed, empty ones vanish, the others are joined by one line end in page order. Unclosed and crossing tags are
closed by the next block tag; a head ends where something stands that can't be in it, an unclosed title or noscript at
the next block tag. `<![`, `<!` and `<?` begin comments up to the next `>`. A tag whose quotes never end reaches to its
first `>`; one that has none is dropped with the rest. Any text gives a result in time proportional to its length. Null urls
and ids are kept. Repeated rows are each treated. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.batches import map_chunks

# Tag names of HTML.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option
p pre section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title noscript template svg math iframe object canvas audio video map".split())
FURNITURE = frozenset("nav footer aside menu dialog button select option datalist textarea".split())
FORMS = frozenset(["form", "fieldset"])
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
# Tags whose content is no markup, and the few that may stand in a head.
RAW = frozenset("script style iframe noembed noframes xmp".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template object".split())
ENDED_BY_BLOCK = ("title", "noscript")
# Words of class and id names. These name page furniture wherever they stand in a name ...
STRONG = re.compile(
    r"(?:ads?|advert\w*|adsense|adsbygoogle|dfp|sponsor\w*|promo\w*|nav|navbar|navigation|submenu|menus?|breadcrumbs?|sidebars?|footer|"
    r"masthead|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|share|sharing|sharebar|comments?|commentlist|commenter|"
    r"disqus\w*|pagination|pager|toolbar|signup)")
# ... these do if the other words say nothing, and otherwise only leave the content to the density rules.
WEAK = frozenset("banner notice overlay social related recommend recommended recommendations header replies respond widget login".split())
PLAIN = re.compile(r"(?:site|page|main|primary|secondary|top|bottom|left|right|list|box|wrap|wrapper|container|section|area|bar|links?|"
                   r"items?|block|posts?|articles?|stories|story|content|buttons?|icons?|form|inner|outer|wide|\d+)")
# After these a word says what is not there, or what stands beside.
DENIED = frozenset("no not has have with without hide hidden disabled".split())
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
# The most common words of English, French, German and Spanish.
STOP_WORDS = frozenset("""the of and to in a is that for it was on with as be at by this are or an from not have which but
le la les de des du et un une en est que qui dans pour pas sur au avec ce il
der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an
el los las del y que se por con para una no al lo su como""".split())

SHORT, LONG = 70, 200
MAIN_LINKS = 0.8  # inside the article
MANY_LINKS, LOW_STOPS, HIGH_STOPS = 0.33, 0.20, 0.30
GOOD, NEAR_GOOD, OPEN, BAD = "good", "near good", "short", "bad"


FREE, DOUBTFUL, MARKED = 0, 1, 2


def evidence(name: str, inside_main: bool) -> int:
    """What one class or id name says: MARKED as furniture, DOUBTFUL or nothing."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if inside_main:  # a header inside the article is its own
        words = [w for w in words if w != "header"]
    said = [w for i, w in enumerate(words) if not (i and words[i - 1] in DENIED)]
    if any(STRONG.fullmatch(w) for w in said):
        return MARKED
    if not any(w in WEAK for w in said):
        return FREE
    return MARKED if all(w in WEAK or PLAIN.fullmatch(w) for w in words) else DOUBTFUL


class Block:
    def __init__(self, furniture: bool, main: int | None, heading: bool, wrapper: int, doubtful: bool):
        self.furniture, self.main, self.heading, self.wrapper, self.doubtful = furniture, main, heading, wrapper, doubtful
        self.text: list[str] = []
        self.linked = 0


TOKEN = re.compile(
    r"""<(?:!--(?:>|->|(?P<comment>.*?)(?:--!?>|\Z))|(?P<bogus>[!?]|/(?![a-zA-Z]))|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))|(?P<text>[^<]+|<)""", re.S)
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
WANTED = re.compile(r"class|id|role|hidden", re.I)


class Cutter:
    """Blocks of a page with what the markup says about them, in one walk over its tags."""

    def __init__(self, html: str):
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, furniture, hidden, evidence
        self.depths: dict[str, list[int]] = defaultdict(list)  # where the open tags of a name lie
        self.block_depths: list[int] = []
        self.blocks: list[Block] = []
        self.now: Block | None = None
        self.links = self.breaks = self.hidden = self.furniture = self.main = self.mains = self.headings = self.doubts = 0
        self.wrappers: list[int] = []  # open marked elements
        self.parents = [0]  # of each marked element; 0 is the page
        # of each main part: its first block's innermost marked element, and how many of those hold all its blocks
        self.around: dict[int, tuple[int, int]] = {}
        self.lowest = 0
        lower = html.lower()
        self.ends_left = {tag: lower.count("</" + tag) for tag in ENDED_BY_BLOCK}
        self._walk(html, lower)

    def _walk(self, html: str, lower: str) -> None:
        at, quoted = 0, True
        lower = lower if len(lower) == len(html) else html  # lower-casing may change lengths beyond ASCII
        while at < len(html):
            found = TOKEN.match(html, at)
            at = found.end()
            if found["text"] is not None:
                self._data(found["text"])
            elif found["bogus"]:
                at = html.find(">", at) + 1 or len(html)
            elif found["tag"]:
                tag = found["tag"].lower()
                rest = REST.match(html, at) if quoted else None
                end = rest.end() if rest else html.find(">", at) + 1
                quoted = rest is not None  # quotes that never end are looked for once
                if not end:
                    return
                if found["end"]:
                    self._end(tag)
                else:
                    inside = html[at:end - 1]
                    self._start(tag, inside)
                    empty = inside.endswith("/") and not _in_value(inside)
                    if tag in RAW and not empty:
                        close = lower.find("</" + tag, end) if lower is not html else _find_tag(html, tag, end)
                        end = close if close >= 0 else len(html)
                    elif empty and tag not in VOID and tag != "br":
                        self._end(tag)
                at = end

    def _start(self, tag: str, inside: str) -> None:
        if tag == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.now = None
            elif self.now is not None:
                self.now.text.append(" ")
            return
        if tag not in IN_HEAD and tag not in ("html", "head") and self.depths["head"]:
            self._leave_to(self.depths["head"][-1])
        if tag in BLOCKS or tag == "body":
            self.now = None
            for name in ENDED_BY_BLOCK:
                if self.depths[name] and not self.ends_left[name]:
                    self._leave_to(self.depths[name][-1])
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):
                self._close_implied(tag)
        if tag in VOID:
            return
        named = {}
        if inside and WANTED.search(inside):
            for name, *values in ATTRIBUTE.findall(inside):
                named.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
        role = named.get("role", "").lower()
        main = tag in MAIN or role == "main"
        said = MARKED if tag in FORMS or role == "form" else FREE
        if not main and tag not in ("body", "html"):
            for name in (named.get("class", "") + " " + named.get("id", "")).split():
                said = max(said, evidence(name, self.main > 0))
        furniture = tag in FURNITURE or (tag == "header" and not self.main) or role in ROLES
        hidden = tag in HIDDEN or "hidden" in named or named.get("aria-hidden") == "true"
        self._enter("main:" + tag if main and tag not in MAIN else tag, furniture, hidden, said)

    def _end(self, tag: str) -> None:
        if tag in self.ends_left:
            self.ends_left[tag] -= 1
        if tag in BLOCKS:
            self.now = None
        places = self.depths[tag]
        # a stray inline end tag closes nothing outside its block
        if places and (tag in BLOCKS or not self.block_depths or places[-1] > self.block_depths[-1]):
            self._leave_to(places[-1])

    def _data(self, data: str) -> None:
        if self.hidden and self.open[-1][0] == "head" and data.strip():
            self._leave_to(len(self.open) - 1)
        if self.hidden:
            return
        solid = data.strip()
        if solid:
            self.breaks = 0
        if self.now is None:
            if not solid:
                return
            main, wrapper = self.mains if self.main else None, self.wrappers[-1] if self.wrappers else 0
            self.now = Block(self.furniture > 0, main, self.headings > 0, wrapper, self.doubts > 0)
            self.blocks.append(self.now)
            if main is not None:
                first, depth = self.around.get(main, (wrapper, len(self.wrappers)))
                self.around[main] = first, min(depth, self.lowest if main in self.around else depth)
            self.lowest = len(self.wrappers)
        self.now.text.append(data)
        if self.links:
            self.now.linked += len(solid)

    def _enter(self, tag: str, furniture: bool, hidden: bool, said: int) -> None:
        name = tag.removeprefix("main:")
        self.depths[name].append(len(self.open))
        if name in BLOCKS:
            self.block_depths.append(len(self.open))
        self.open.append((tag, furniture, hidden, said))
        self.furniture += furniture
        self.hidden += hidden
        self.doubts += said == DOUBTFUL
        self.headings += name in HEADINGS
        if tag in MAIN or tag.startswith("main:"):
            self.mains += not self.main
            self.main += 1
        if said == MARKED:
            self.parents.append(self.wrappers[-1] if self.wrappers else 0)
            self.wrappers.append(len(self.parents) - 1)
        self.links += name == "a"

    def _leave_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, furniture, hidden, said = self.open.pop()
            name = tag.removeprefix("main:")
            self.depths[name].pop()
            if name in BLOCKS:
                self.block_depths.pop()
            self.furniture -= furniture
            self.hidden -= hidden
            self.doubts -= said == DOUBTFUL
            self.headings -= name in HEADINGS
            self.main -= tag in MAIN or tag.startswith("main:")
            if said == MARKED:
                self.wrappers.pop()
                self.lowest = min(self.lowest, len(self.wrappers))
            self.links -= name == "a"

    def _close_implied(self, tag: str) -> None:
        """A new paragraph, item or cell ends an open one that no other container separates from it."""
        for place in (-1, -2):
            if len(self.block_depths) < -place:
                return
            depth = self.block_depths[place]
            name = self.open[depth][0].removeprefix("main:")
            if name == tag:
                self._leave_to(depth)
                return
            if name != "p":
                return


def _in_value(inside: str) -> bool:
    """Whether the last character of a tag belongs to a value without quotes."""
    tail = max(inside.rfind(c) for c in " \t\n\r\f\"'") + 1
    return "=" in inside[tail:] or inside[:tail].rstrip().endswith("=")


def _find_tag(html: str, tag: str, at: int) -> int:
    found = re.compile("</" + tag, re.I | re.A).search(html, at)
    return found.start() if found else -1


WIDE = re.compile("[\u2e80-\U0010ffff]")


def size(text: str) -> int:
    """Characters; the wide ones of East Asia count twice."""
    return len(text) if text.isascii() else len(text) + len(WIDE.findall(text))


def stop_share(texts: list[str]) -> float:
    words = re.findall(r"\w+", " ".join(texts).lower())
    return sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)


def closed_wrappers(cutter: Cutter, blocks: list[tuple[str, Block]]) -> list[bool]:
    """Of every marked element whether it, or one around it, holds neither the largest main part nor, without a long one
    outside, half of the text."""
    mains: dict[int, int] = defaultdict(int)
    held = [0] * len(cutter.parents)
    for text, b in blocks:
        mass = 0 if b.furniture else max(size(text) - b.linked, 0)
        held[b.wrapper] += mass
        if b.main is not None:
            mains[b.main] += mass
    for w in range(len(held) - 1, 0, -1):  # an element is numbered after those around it
        held[cutter.parents[w]] += held[w]
    largest = max(mains, key=lambda m: (mains[m], -m), default=None)
    known = largest is not None and mains[largest] > LONG
    inside = set()
    if largest is not None:
        chain, (w, depth) = [], cutter.around[largest]
        while w:
            chain.append(w)
            w = cutter.parents[w]
        inside = set(chain[len(chain) - depth:])
    closed = [False] * len(held)
    for w in range(1, len(held)):
        shut = w not in inside and (known or 2 * held[w] < held[0] or held[w] <= (LONG if mains else 0))
        closed[w] = shut or closed[cutter.parents[w]]
    return closed


def first_pass(text: str, block: Block, prior: bool, known: bool) -> str:
    """`prior`: the main parts hold half of the text. `known`: the page has the usual part of stop words."""
    chars = size(text)
    linked = block.linked / max(len(text), 1)
    stops = stop_share([text]) if known and chars >= SHORT else HIGH_STOPS
    if prior and block.main is not None:
        if linked > (MANY_LINKS if block.doubtful else MAIN_LINKS):
            return BAD
        if block.doubtful:
            return GOOD if chars > LONG and stops >= HIGH_STOPS else NEAR_GOOD if chars >= SHORT and stops >= LOW_STOPS else OPEN
        return GOOD if chars > LONG or chars >= SHORT and stops >= LOW_STOPS else NEAR_GOOD
    if linked > MANY_LINKS:
        return BAD
    if chars < SHORT:
        return BAD if block.linked or prior else OPEN
    if prior:
        return GOOD if stops >= HIGH_STOPS and chars > LONG else BAD
    if stops >= HIGH_STOPS:
        return GOOD if chars > LONG else NEAR_GOOD
    if stops >= LOW_STOPS:
        return NEAR_GOOD
    return BAD


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    """Whether each block is kept. Ambiguous blocks look for the nearest decided block on both sides."""
    decided = [i for i, label in enumerate(labels) if label in (GOOD, BAD)]
    kept = []
    at = 0
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            kept.append(label == GOOD)
            continue
        while at < len(decided) and decided[at] < i:
            at += 1
        left, right = (decided[at - 1] if at else None), (decided[at] if at < len(decided) else None)
        if left is None and right is None:
            kept.append(label == NEAR_GOOD)
        elif left is None or right is None:
            kept.append(labels[right if left is None else left] == GOOD)
        elif labels[left] == labels[right]:
            kept.append(labels[left] == GOOD)
        elif i - left == right - i or headings[i]:
            # between the two: a heading belongs to what follows, a middling block to the text
            kept.append(labels[right] == GOOD if headings[i] else label == NEAR_GOOD)
        else:
            kept.append(labels[left if i - left < right - i else right] == GOOD)
    return kept


def main_text(html: str | None) -> str:
    cutter = Cutter(html or "")
    blocks = [(" ".join(unescape("".join(b.text)).split()), b) for b in cutter.blocks]
    blocks = [(text, b) for text, b in blocks if text]
    closed = closed_wrappers(cutter, blocks)
    blocks = [(text, b, b.furniture or closed[b.wrapper]) for text, b in blocks]
    free = [(text, b) for text, b, furniture in blocks if not furniture]
    total, marked = (sum(max(size(t) - b.linked, 0) for t, b in part) for part in (free, [x for x in free if x[1].main is not None]))
    # outside, half of the text or less than an article
    prior = marked > 0 and (2 * marked >= total or total - marked <= LONG)
    known = stop_share([t for t, b in free if size(t) >= SHORT and b.linked <= MANY_LINKS * len(t)]) >= LOW_STOPS
    labels = [BAD if furniture else first_pass(text, b, prior, known) for text, b, furniture in blocks]
    kept = [False] * len(blocks)
    # with a prior, blocks of the main parts have their neighbours there
    inside = [i for i, (_, b, furniture) in enumerate(blocks) if prior and b.main is not None and not furniture]
    taken = set(inside)
    for part in (inside, [i for i in range(len(blocks)) if i not in taken]):
        for i, keep in zip(part, second_pass([labels[i] for i in part], [blocks[i][1].heading for i in part])):
            kept[i] = keep
    return "\n".join(text for (text, _, _), keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kind = T.StructType([rows.schema["page_id"], *T.StructType.fromDDL("url string, text string, n_chars bigint")])

    def read(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                "n_chars": [len(t) for t in texts]}

    return map_chunks(rows, "html", kind, read).withColumnsRenamed({"page_id": id_column, "url": url_column})
