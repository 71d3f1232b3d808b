"""Main text of web pages by scores on the element tree.

Every paragraph gives points for its length and its commas, less by the share of its text that
stands in links, to its parent and in part to the ancestors above. The container of the highest
score is the main text, with those of its siblings that score alike. Elements that are boilerplate
by tag, role or name neither score nor stay. Pages are read one by one in Arrow batches; nothing
is shuffled, and time and memory of a page grow with its length.
"""

import html
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from beaconry.llm.text import bounded_batches

# Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split())
BOILERPLATE = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head header iframe input map menu nav noembed noframes noscript object option "
    "output progress script select style svg template textarea title video xmp".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words in class names and ids that mark what is no article.
BOILERPLATE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs consent cookie cookies copyright dialog "
    "disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promoted promotion recommendations recommended related search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription teaser toolbar topbar widget widgets".split())
COMMENT_WORDS = frozenset("comment commentlist comments disqus discussion feedback replies reply respond responses".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Paragraphs and headings are no containers.
_LEAVES = HEADINGS | {"p", "pre", "dt", "dd", "li", "figcaption", "caption"}
# What an opening element ends: the nearest of these names, looked for up to the nearest boundary.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NESTING = frozenset(("table", "td", "th", "button", "object"))

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<[/!?A-Za-z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMAS = re.compile("[,،、，]")
_SIBLING_SHARE, _DECLARED, _LINKS, _LINK_SHARE = 0.2, 5, 3, 0.6


class Page:
    """Elements in page order (a parent comes before its children) and the text between tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = ["body"], [-1], [""]
        # (element, text); a text of None is the edge of a block.
        self.pieces: list[tuple[int, str | None]] = []
        stack, at = [0], 0
        for match in iter(lambda: _MARKUP.search(source, at), None):
            self._text(stack[-1], source[at:match.start()])
            at = match.end()
            name = (match.group(2) or "").lower()
            if not name:
                continue
            if match.group(1):
                self._close(stack, name)
                continue
            self._open(stack, name, match.group(3))
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                stack.pop()
        self._text(stack[-1], source[at:])

    def _text(self, element: int, text: str) -> None:
        if text:
            self.pieces.append((element, html.unescape(text) if "&" in text else text))

    def _edge(self, element: int) -> None:
        self.pieces.append((element, None))

    def _pop_to(self, stack: list[int], depth: int) -> None:
        if any(self.tag[e] not in INLINE for e in stack[depth:]):
            self._edge(stack[depth - 1])
        del stack[depth:]

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if name in ("html", "body"):
            return
        if name not in INLINE:
            for ended, boundary in (({"p"}, _NESTING), _ENDS.get(name, (None, None))):
                for depth in range(len(stack) - 1, 0, -1) if ended else ():
                    tag = self.tag[stack[depth]]
                    if tag in ended:
                        self._pop_to(stack, depth)
                    if tag in ended or tag in boundary or tag not in INLINE and ended == {"p"}:
                        break
            self._edge(stack[-1])
        if name not in VOID:
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attributes.append(attributes)
            stack.append(len(self.tag) - 1)

    def _close(self, stack: list[int], name: str) -> None:
        """An inline end tag does not reach beyond its block; one without a start is left out."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                self._pop_to(stack, depth)
                return
            if name in INLINE and tag not in INLINE:
                return

    def up(self, values: list) -> list:
        """Sums over subtrees."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def down(self, marks: list[bool]) -> list[bool]:
        """Whether an element or one above it is marked."""
        out = list(marks)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out


def _is_named(page: Page, e: int) -> tuple[bool, bool, bool]:
    """Whether an element's attributes make it boilerplate for certain, by its name, or readers' comments."""
    if not page.attributes[e].strip():
        return False, False, False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(page.attributes[e])}
    style = re.sub(r"\s", "", found.get("style", "")).lower()
    sure = (
        "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in BOILERPLATE_ROLES
        or "display:none" in style or "visibility:hidden" in style
    )
    words = {w.lower() for w in _NAME_WORD.findall(found.get("class", "") + " " + found.get("id", ""))}
    return sure, not words.isdisjoint(BOILERPLATE_WORDS), not words.isdisjoint(COMMENT_WORDS)


def main_text(source: str | None) -> str:
    """The text of the main container: blocks in page order, white space as one space, '' if there is none."""
    if not source:
        return ""
    page = Page(source)
    n, parent, tag = len(page.tag), page.parent, page.tag
    in_link = page.down([t == "a" for t in tag])
    block = [0] * n
    for e in range(1, n):
        block[e] = block[parent[e]] if tag[e] in INLINE else e
    chars, linked, commas = [0] * n, [0] * n, [0] * n
    for e, text in page.pieces:
        size = len("".join(text.split())) if text else 0
        if size:
            chars[block[e]] += size
            linked[block[e]] += size if in_link[e] else 0
            commas[block[e]] += len(_COMMAS.findall(text))
    points = [
        (1 + commas[e] + min(chars[e] / 100, 3)) * (1 - linked[e] / chars[e]) if chars[e] and tag[e] not in HEADINGS else 0.0 for e in range(n)
    ]
    named = [_is_named(page, e) for e in range(n)]
    sure = page.down([t in BOILERPLATE or s or c and t not in ("body", "main") for t, (s, _, c) in zip(tag, named)])
    # An element named like boilerplate that holds the article, or most of the text, is a wrapper.
    points = [0.0 if s else p for s, p in zip(sure, points)]
    held, articles = page.up(points), page.up([t in ("article", "main") and not s for t, s in zip(tag, sure)])
    removed = page.down([
        s or by_name and t not in ("body", "article", "main") and not articles[e] and held[e] <= held[0] / 2
        for e, (t, s, (_, by_name, _)) in enumerate(zip(tag, sure, named))
    ])
    # Lists of links are menus wherever they stand.
    in_chars, in_linked, links = page.up(chars), page.up(linked), page.up([t == "a" for t in tag])
    removed = page.down([
        r or t in ("ul", "ol", "dl", "table", "div", "section") and links[e] >= _LINKS and in_linked[e] > _LINK_SHARE * in_chars[e]
        for e, (t, r) in enumerate(zip(tag, removed))
    ])
    scores = [0.0] * n
    for e in range(n):
        if points[e] and not removed[e]:
            if tag[e] not in _LEAVES:
                scores[e] += points[e]
            above, level = parent[e], 0
            while above >= 0 and level < 5:
                scores[above] += points[e] / (1 if not level else 2 if level == 1 else 3 * level)
                above, level = parent[above], level + 1
    own = [max(0, i - l) / i if i else 0 for i, l in zip(in_chars, in_linked)]
    scores = [s * share * (_DECLARED if t in ("article", "main") else 1) if t not in _LEAVES else 0.0 for s, share, t in zip(scores, own, tag)]
    best = max(range(n), key=scores.__getitem__)
    # An article or main element that holds the best container is declared to be it.
    path = _path(parent, best)
    declared = [e for e in path if tag[e] == "article"] or [e for e in path if tag[e] == "main"][:1]
    best = declared[-1] if declared else best
    chosen = [False] * n
    chosen[best] = True
    for e in range(1, n):
        if parent[e] == parent[best] and not removed[e] and (tag[e] == tag[best] or tag[e] == "p" and tag[best] != "article"):
            chosen[e] = chosen[e] or max(scores[e], points[e]) >= _SIBLING_SHARE * scores[best] > 0
    inside = page.down(chosen)
    return " ".join("".join(" " if text is None else text for e, text in page.pieces if inside[e] and not removed[e]).split())


def _path(parent: list[int], e: int) -> list[int]:
    """An element and all above it."""
    out = []
    while e >= 0:
        out.append(e)
        e = parent[e]
    return out


def extract_main_text(pages: DataFrame, html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole html, and its code points ``n_chars``.

    Null and empty html, and pages without a text, give ''. Rows are kept as they are, repeated
    or null in other columns; columns named ``text`` or ``n_chars`` are replaced, the html is
    left out unless ``keep_html``. Unclosed and stray tags are read as browsers mostly do; a
    page cut off within a tag ends before it.
    """
    bounded_batches(pages.sparkSession)
    added = [StructField("text", StringType()), StructField("n_chars", LongType())]
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars") and (keep_html or f.name != html_col)]
    inner = pages.select(F.col(f"`{html_col}`"), *[F.col(f"`{f.name}`") for f in kept]).toDF(*[f"c{i}" for i in range(len(kept) + 1)])

    def run(batches):
        for batch in batches:
            texts = pa.array((main_text(h.as_py()) for h in batch.column(0)), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], texts, pc.utf8_length(texts).cast(pa.int64())], names=[*[f.name for f in kept], "text", "n_chars"])

    return inner.mapInArrow(run, StructType([*kept, *added]))
