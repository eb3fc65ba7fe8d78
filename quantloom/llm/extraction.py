"""Main text of web pages by consensus host paths.

Every page is parsed once into blocks of text with the generalised tag-class path of each container round them (digits
in class names become '#').  A page scores its containers: the share of the page's good text inside, less the share of
link text in what would be returned; good text is neither link text nor in elements that name themselves boilerplate,
and boilerplate inside costs nothing, as it is left out of any result.  A smallest article or main element that holds nearly all
good text goes first.  The best path is the page's vote.  Spark counts votes by host; paths with a tenth of a host's votes or more win there,
so a host has ten at most.  A second pass takes from each page the containers of its host's best winning path that hold
nearly all its good text, or its own best one.  A page of little text takes its host's best path that it has.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.scratch import table

MIN_SHARE = 0.1
#: The share of a page's good text that is nearly all, and the characters of it from which a page speaks for itself.
NEARLY, RICH = 0.9, 250

# Element names of the HTML standard by the role they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("body main article section div td center blockquote".split())
BOILERPLATE = frozenset("nav header footer aside button select menu dialog noscript script style template iframe svg canvas object audio video head title textarea fieldset noembed noframes xmp".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "masthead footer sidebar sidebars aside widget widgets comment comments disqus respond replies reply cookie cookies consent notice notices "
    "popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search pager pagination toolbar skip".split()
)
#: Words that may stand beside hints in the name of a boilerplate element; any other word makes the name mean something else.
NEUTRAL = frozenset("area bar block body bottom box button buttons col column container first form global group inner item items last left link links list main outer panel posts primary right secondary section site text top wrap wrapper".split())
#: Hints that also name layouts, and forms: such an element that holds most of the page's text is no boilerplate.
LAYOUT = frozenset("form nav navbar navigation menu menus masthead header footer banner sidebar sidebars aside widget widgets toolbar search pager".split())
#: Beginnings of words that name boilerplate whatever stands beside them ('article-comments', 'commentlist'), and whole words that do.
STRONG = ("comment", "disqus", "advert", "sponsor", "cookie", "gdpr", "newsletter", "popup")
STRONG_WORDS = frozenset("ad ads consent notice notices related recommended replies respond subscribe promo".split())
#: Words that turn a name into a statement about a layout or the like ('has-sidebar', 'without-comments').
NEGATIONS = frozenset("has have no non not with without hide hides layout free open closed enabled disabled allow allowed".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Start tags that end an open element of the second kind, within the nearest container.
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_STOP = frozenset("html body table ul ol dl div section article main aside nav header footer select td th".split())

# A quote opens a value right after '=' only; elsewhere it is a character of the name or of the unquoted value.
_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|$)|!\[CDATA\[(.*?)(?:\]\]>|$)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))|=)*+)>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*)))?")
_WORD = re.compile(r"[a-z]+")
_HEADING = re.compile("h[1-6]")
#: Marks boilerplate in which headings are none: the header of an article.
_TITLES = 2
_SPACE = re.compile(r"\s+")


class Tree:
    """Containers and boilerplate names of a page, each with its parent's number or -1, and paths as (parent, name) pairs.

    Nothing is copied per element, so memory and time follow the page's length however deep it is nested.
    """

    def __init__(self) -> None:
        self.up: list[int] = []  # of containers
        self.tag: list[str] = []
        self.path: list[int] = []
        self.names: list[tuple[int, str]] = [(-1, "")]
        self.number: dict[tuple[int, str], int] = {}
        self.hint_up: list[int] = []
        self.hint_depth: list[int] = []
        self.hints: list[set[str]] = []
        self.articles: list[tuple[int, int]] = []  # (boilerplate name round it, container)

    def path_of(self, parent: int, name: str) -> int:
        at = self.number.setdefault((parent, name), len(self.names))
        if at == len(self.names):
            self.names.append((parent, name))
        return at

    def spelled(self, path: int) -> str:
        parts = []
        while path > 0:
            path, name = self.names[path]
            parts.append(name)
        return "".join(f"/{x}" for x in reversed(parts))

    def find(self, path: str) -> int:
        """The number of a spelled path, or -1."""
        at = 0
        for name in path.split("/")[1:]:
            at = self.number.get((at, name), -1)
            if at < 0:
                return -1
        return at

    def container(self, up: int, tag: str, path: int) -> int:
        self.up.append(up)
        self.tag.append(tag)
        self.path.append(path)
        return len(self.up) - 1

    def hint(self, up: int, words: set[str]) -> int:
        self.hint_up.append(up)
        self.hint_depth.append(1 + self.depth(up))
        self.hints.append(words)
        return len(self.hints) - 1

    def depth(self, hint: int) -> int:
        return self.hint_depth[hint] if hint >= 0 else 0


def _summed(own: list[int], up: list[int]) -> list[int]:
    """Each number's own sum and those of all below it; parents have smaller numbers."""
    out = list(own)
    for i in range(len(out) - 1, -1, -1):
        if up[i] >= 0:
            out[up[i]] += out[i]
    return out


class Block:
    """Text between two block boundaries, in its innermost container (a number of ``tree``, or -1)."""

    __slots__ = ("text", "links", "boiler", "at", "tree")

    def __init__(self, text: str, links: int, boiler: bool, at: int, tree: Tree) -> None:
        self.text, self.links, self.boiler, self.at, self.tree = text, links, boiler, at, tree

    @property
    def inside(self) -> list[tuple[int, str]]:
        """(number, path) for each container round the block, from the outermost in."""
        out, at = [], self.at
        while at >= 0:
            out.append((at, self.tree.spelled(self.tree.path[at])))
            at = self.tree.up[at]
        return out[::-1]


def _is_boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)
    return tag in BOILERPLATE or attributes.get("role", "").lower() in ROLES or bool(hidden)


def _hints(attributes: dict[str, str]) -> set[str]:
    """Hint words of the classes and the id that name boilerplate: as a whole ('top-nav', not 'nav-story'), or by a word that
    always does ('google-ad'), unless a word beside it says otherwise ('has-sidebar', 'ad-free')."""
    found = set()
    for part in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower()))
        hints = words & HINTS or words & {"header"}
        if hints and words <= HINTS | NEUTRAL | {"header"}:
            found |= words & (HINTS | {"header"})
        elif not words & NEGATIONS and (strong := {w for w in words if w in STRONG_WORDS or w.startswith(STRONG)}):
            found |= strong
    return found


def _settle(blocks: list[Block], marks: list[int], tree: Tree) -> None:
    """Marks the blocks in elements named boilerplate, except elements round the page's article or most of its text.

    ``marks`` has the innermost such element round each block.
    """
    cleared = [False] * len(tree.hints)
    least = min((tree.depth(h) for h, _ in tree.articles), default=0)  # articles in more of them are cards in a list or the like
    own = [(h, c) for h, c in tree.articles if least and tree.depth(h) == least]
    if own:
        within = [False] * len(tree.up)
        for _, c in own:
            within[c] = True
        for c, up in enumerate(tree.up):
            within[c] = within[c] or up >= 0 and within[up]
        size = lambda rows: sum(len(b.text) - b.links for b in rows if not b.boiler)
        if size(b for b in blocks if b.at >= 0 and within[b.at]) > size(b for b, h in zip(blocks, marks, strict=True) if tree.depth(h) < least):
            for h, _ in own:
                while h >= 0 and not cleared[h]:
                    cleared[h] = True
                    h = tree.hint_up[h]
    held = [0] * len(tree.hints)
    total = 0
    for b, h in zip(blocks, marks, strict=True):
        if not b.boiler:
            total += len(b.text) - b.links
            if h >= 0:
                held[h] += len(b.text) - b.links
    for h, n in enumerate(_summed(held, tree.hint_up)):
        up = tree.hint_up[h]
        cleared[h] = (cleared[h] or tree.hints[h] <= LAYOUT and 2 * n > total) and (up < 0 or cleared[up])
    for b, h in zip(blocks, marks, strict=True):
        b.boiler = b.boiler or h >= 0 and not cleared[h]


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order."""
    out: list[Block] = []
    tree = Tree()
    # Open elements: tag, boilerplate within (or ``_TITLES``), innermost element named boilerplate, innermost container, path.
    stack: list[tuple[str, bool | int, int, int, int]] = [("", False, -1, -1, 0)]
    count: dict[str, int] = {}  # open elements by tag
    marks: list[int] = []
    text: list[str] = []
    links = link_depth = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, min(links, len(joined)), bool(stack[-1][1]), stack[-1][3], tree))
                marks.append(stack[-1][2])
            text.clear()
        links = 0

    def say(piece: str) -> None:
        nonlocal links
        if piece:
            text.append(piece)
            if link_depth:
                links += len(piece.strip())

    def pop_to(depth: int) -> None:
        nonlocal link_depth
        for tag, *_ in stack[depth:]:
            if tag not in INLINE:
                flush()
            link_depth -= tag == "a"
            count[tag] -= 1
        del stack[depth:]

    def close_within(tags, stop) -> None:
        if not any(count.get(tag) for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                pop_to(depth)
                return
            if stack[depth][0] in stop:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "br":
                text.append(" ")
            elif tag not in VOID and count.get(tag):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        pop_to(depth)
                        break
                    if tag in INLINE and stack[depth][0] not in INLINE:
                        break  # an inline end tag does not close blocks
            continue
        if tag in VOID:
            if tag in INLINE:
                text.append(" " if tag in ("br", "wbr", "img") and tag != "wbr" else "")
            else:
                if tag == "hr":
                    close_within({"p"}, _STOP)
                flush()
            continue
        if tag in _CLOSES_P:
            close_within({"p"}, _STOP)
            if _HEADING.fullmatch(tag):
                close_within({"h1", "h2", "h3", "h4", "h5", "h6"}, _STOP | {"p"})
        elif tag in _SAME:
            close_within(_SAME[tag], {"table", "ul", "ol", "dl", "select"})
        attributes = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[4])} if m[4].strip(" /\t\n") else {}
        _, boiler, hint, inside, path = stack[-1]
        if tag not in INLINE:
            flush()
            names = sorted(re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().replace("/", "|").split())
            path = tree.path_of(path, ".".join([tag.replace("/", "|"), *names]))
            if tag in CONTAINERS:
                inside = tree.container(inside, tag, path)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end  # raw text is no content
            continue
        if boiler == _TITLES and _HEADING.fullmatch(tag):
            boiler = False  # an article's header has its title
        boiler = boiler or _is_boilerplate(tag, attributes) and (_TITLES if tag == "header" and count.get("article") else True)
        hints = _hints(attributes) if attributes and tag not in ("body", "html") else set()
        if tag == "form":
            hints = hints | {"form"}
        if tag in ("article", "main"):
            if not boiler and not hints:
                tree.articles.append((hint, inside))
        elif hints:
            hint = tree.hint(hint, hints)
        stack.append((tag, boiler, hint, inside, path))
        count[tag] = count.get(tag, 0) + 1
        link_depth += tag == "a"
    pop_to(1)
    flush()
    _settle(out, marks, tree)
    return out


def _good(block: Block) -> int:
    return 0 if block.boiler else len(block.text) - block.links


def _sums(blocks: list[Block]) -> tuple[list[int], list[int]]:
    """Good text, and link text outside boilerplate, in each container."""
    tree = blocks[0].tree
    good, links = [0] * len(tree.up), [0] * len(tree.up)
    for b in blocks:
        if b.at >= 0:
            good[b.at] += _good(b)
            links[b.at] += 0 if b.boiler else b.links
    return _summed(good, tree.up), _summed(links, tree.up)


def _best(blocks: list[Block]) -> int:
    """The container of the best score, the innermost among equals; -1 if there is none."""
    total = sum(map(_good, blocks))
    if not total:
        return -1
    good, links = _sums(blocks)
    tree = blocks[0].tree
    own = [c for c, g in enumerate(good) if g >= NEARLY * total and tree.tag[c] in ("article", "main")]
    if own:
        return max(own)  # all of them are round the same text, so the last is the innermost
    scored = [(round(g / total - links[c] / (g + links[c]), 6), c) for c, g in enumerate(good) if g]
    return max(scored)[1] if scored else -1


def best_container(blocks: list[Block]) -> tuple[int, str] | None:
    """(number, path) of the container of the best score."""
    best = _best(blocks)
    return (best, blocks[0].tree.spelled(blocks[0].tree.path[best])) if best >= 0 else None


def extract(page: str | None, winners: list[str] | None = None) -> str:
    """Text of the containers of the first winning path that holds the page's good text, or of its own best container, or of all blocks."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    tree = blocks[0].tree
    total = sum(map(_good, blocks))

    def within(chosen: list[bool]) -> list[Block]:
        for c, up in enumerate(tree.up):
            chosen[c] = chosen[c] or up >= 0 and chosen[up]
        return [b for b in blocks if not b.boiler and b.at >= 0 and chosen[b.at]]

    for path in winners or []:
        at = tree.find(path)
        inside = within([p == at for p in tree.path]) if at > 0 else []
        if inside and (total < RICH or sum(map(_good, inside)) >= NEARLY * total):
            break
    else:
        best = _best(blocks)
        inside = within([c == best for c in range(len(tree.up))]) if best >= 0 else [b for b in blocks if not b.boiler]
    return "\n\n".join(b.text for b in inside)


def host_of(url) -> F.Column:
    """Host of a URL column: after '://' up to '/', '?' or '#', A-Z in lower case; empty for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def page_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes): each page's best container path, counted."""
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], int] = {}
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                best = best_container(blocks_of(page.as_py() or ""))
                if best:
                    key = host.as_py(), best[1]
                    votes[key] = votes.get(key, 0) + 1
            if votes:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes]), pa.array([p for _, p in votes]), pa.array(votes.values(), pa.int64())], names=["host", "path", "votes"])

    return rows.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def host_paths(votes: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, paths): winning paths, most votes first, then in order of path."""
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(total, "host").where(F.col("votes") >= F.col("total") * min_share)
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("r"))
    return ranked.select("host", F.transform("r", lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; text is empty where a page has none.

    Null html counts as empty, a null url as the empty host; ids are passed through, null or repeated as they are; an
    empty table gives an empty result; other columns are not read, whatever their names.  A page is one task's work, in
    time and memory that follow its length.  Paths with equal votes win in the order of their spelling.  Html is joined
    with the winners of its host as a table once those outgrow a broadcast; a hot host's rows can then be split.  Character references are decoded, white space inside a block becomes one space,
    and blocks are joined by an empty line.
    """
    winners = table(host_paths(page_votes(pages, url, html), min_share), "host_paths")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), paths.as_py()) for page, paths in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(winners, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """The text of every page, null and repeated ones too."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
