"""Main-text extraction by tag-path ratios.

A page is read as a stream of tags and text into a tree of elements.  Every element has a root-to-leaf tag path (names
with their class and id words); equal paths are one path node.  Per path the text length, the punctuation and the
number of text nodes are added up.  The two ratios (characters per node, punctuation per node) are
smoothed along the page and fused into one score with a prior of the path's names.

*Threshold.*  The scale of a page is its length-weighted median score.  Paths above ``SURE`` of it are content,
those below ``NEVER`` are not; between the two the threshold lies in the widest gap of the page's own scores.
The text nodes of the paths above it are selected.

*Selection.*  The container is the deepest element that holds all selected nodes, or the outermost article or
main around it.  If it is more than the whole body, all its blocks stay, short leads and headings included.
If it is the body, the blocks from the first selected to the last stay, with the rest of every article or main
that holds selected ones, the paragraphs beside selected paragraphs and the headings right before the first.

Names that say menu, advert, form, comment and the like lower a path's prior; such an element is dropped unless
it holds most of the page's text or fused weight.  Tags that say it (nav, footer, aside, ..) are dropped.
All steps are linear in the page, whatever is left unclosed.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|select|iframe|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var".split())
# A start tag closes these open tags (nearest first), as page authors leave them open.
_BLOCKS = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure "
                    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
_DROP_TAGS = frozenset("nav footer aside button menu dialog header head select option".split())
_DROP_WORDS = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adverts?|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|side-?bars?|aside|"
    r"footer|header|masthead|comments?|replies|respond|discuss\w*|disqus|notices?|cookies?|consent|gdpr|popup|modal|"
    r"newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|"
    r"pager|copyright|legal|hidden)(?:$|[-_ ])", re.I)
# Words on the state or topic of a whole page or article.
_STATE_WORDS = re.compile(r"(?:^|(?<= ))(?:(?:has|with|without|no|tag|category)-\S+|\S+-(?:open|closed|enabled|disabled))(?= |$)", re.I)
_PUNCT = frozenset(".,;:!?…。，、！？；：")
_SPACE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85\xa0  -     　]+")
_LANDMARKS = frozenset(("article", "main"))
_KEPT = frozenset(("html", "body", *_LANDMARKS))
_DOUBT = 0.25                   # prior of an element named like something to drop
_PRIOR = {"p": 2.0, "blockquote": 2.0, "pre": 2.0, "a": 0.1}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset(("p", "blockquote", "pre"))
_WHOLE = frozenset(("", "html", "body"))
SURE, NEVER = 0.5, 0.05         # of the page's median score


class Paths:
    """Tag paths as a tree: parent, name and mark ("", "!" dropped, "?" doubtful) of every path; and the elements, with
    their parent element (``up``) and their path (``of``).  0 is the root in both; children come after their parents."""

    def __init__(self):
        self.parent, self.name, self.mark, self.ids = [-1], [""], [""], {}
        self.up, self.of = [-1], [0]

    def child(self, element: int, step: str, name: str, mark: str) -> int:
        """A new element below ``element``."""
        key = (self.of[element], step)
        if key not in self.ids:
            self.ids[key] = len(self.parent)
            self.parent.append(self.of[element])
            self.name.append(name)
            self.mark.append(mark)
        self.up.append(element)
        self.of.append(self.ids[key])
        return len(self.up) - 1

    def __len__(self):
        return len(self.parent)

    def element_name(self, element: int) -> str:
        return self.name[self.of[element]]

    def gone(self) -> list[bool]:
        """Whether a path lies in a dropped element."""
        out = [False] * len(self)
        for k in range(1, len(self)):
            out[k] = out[self.parent[k]] or self.mark[k] == "!"
        return out


def below(parent: list[int], own: list) -> list:
    """Sums over sub-trees of a value per node."""
    out = list(own)
    for k in range(len(out) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


class _Open:
    """The stack of open elements, with the places of every name."""

    def __init__(self):
        self.names, self.elements, self.places = [], [0], {}

    def push(self, name: str, element: int):
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.elements.append(element)

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, at: int):
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.elements.pop()

    def close(self, names, within):
        """Close the nearest open element of ``names`` that is not behind one of ``within``."""
        at = self.last(names)
        if at >= 0 and at > self.last(within):
            self.cut(at)


def text_nodes(page: str) -> tuple[Paths, list[tuple[int, int, str]]]:
    """(paths, [(element, block number, decoded text)]) of every text node, in page order."""
    paths, out, stack = Paths(), [], _Open()
    block, at = 0, 0

    def emit(text: str):
        if text:
            out.append((stack.elements[-1], block, _html.unescape(text)))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            emit(page[at:m.start()])
        at = m.end()
        if m[3] is None:
            if m[1] is not None and m[1].lower() not in ("script", "style"):
                block += 1
            continue
        name = m[3].lower()
        if m[2]:                                                # end tag
            if stack.places.get(name):
                stack.cut(stack.places[name][-1])
            if name not in _INLINE:
                block += 1
            continue
        if name in _VOID:
            if name == "br":
                emit(" ")
            elif name == "hr":
                block += 1
            continue
        if name in _BLOCKS:                                     # a block start ends an open paragraph
            stack.close(("p",), ("article", "aside", "body", "div", "section", "td", "th", "li", "blockquote", "main"))
        if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            stack.close(("dd", "dt") if name in ("dd", "dt") else (name,), ("ul", "ol", "dl", "table", "menu"))
        if name not in _INLINE:
            block += 1
        words, hidden = _names(m[4])
        step, mark = f"{name}.{words}" if words else name, ""
        if hidden or name in _DROP_TAGS:
            step, mark = f"!{step}", "!"
        elif name == "form" or (words and name not in _KEPT and _DROP_WORDS.search(_STATE_WORDS.sub("", words))):
            step, mark = f"?{m.start()}?{step}", "?"            # an element of its own, until it is settled
        stack.push(name, paths.child(stack.elements[-1], step, name, mark))
    if at < len(page):
        emit(page[at:])
    return paths, out


def _names(attrs: str) -> tuple[str, bool]:
    words, hidden = [], False
    for m in _ATTR.finditer(attrs or ""):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            words.append(value)
        elif key == "hidden" or value.lower() == "true":
            hidden = True
    return " ".join(words), hidden


def path_scores(paths: Paths, nodes: list[tuple[int, int, str]], width: int = 1) -> tuple[list[float], list[int], list[int]]:
    """(fused score, text length, text nodes) of every path: (text / nodes) x (1 + punctuation / nodes) x prior, smoothed
    over the ``width`` paths before and after in order of first appearance; 0 without text or under a dropped element."""
    n = len(paths)
    length, punct, count, order = [0] * n, [0] * n, [0] * n, []
    for element, _, text in nodes:
        path = paths.of[element]
        if not count[path]:
            order.append(path)
        length[path] += len(text.strip())
        punct[path] += sum(c in _PUNCT for c in text)
        count[path] += 1
    prior = [1.0] * n
    for k in range(1, n):
        own = 0.0 if paths.mark[k] == "!" else _DOUBT if paths.mark[k] == "?" else _PRIOR.get(paths.name[k], 1.0)
        prior[k] = prior[paths.parent[k]] * own
    ratio, marks = [length[p] / count[p] for p in order], [punct[p] / count[p] for p in order]
    smooth = lambda x: [(sum(x[max(0, k - width):k + width + 1]) / len(x[max(0, k - width):k + width + 1])
                         + 3 * x[k]) / 4 for k in range(len(x))]
    out = [0.0] * n
    for p, r, q in zip(order, smooth(ratio), smooth(marks)):
        out[p] = r * (1.0 + q) * prior[p] if length[p] else 0.0
    return out, length, count


def settle(paths: Paths, nodes: list[tuple[int, int, str]]) -> None:
    """Every mark ``?`` becomes either none or ``!``: the element is kept if it holds more than half of the fused weight of all
    that is not dropped for certain, or of its text and no article or main stands apart from it."""
    doubtful = [k for k in range(len(paths)) if paths.mark[k] == "?"]
    if not doubtful:
        return
    scores, length, count = path_scores(paths, nodes)
    shaky, around = [False] * len(paths), [0] * len(paths)
    for k in range(1, len(paths)):
        shaky[k] = shaky[paths.parent[k]] or paths.mark[paths.parent[k]] == "?"
    text = below(paths.parent, [0 if g else x for g, x in zip(paths.gone(), length)])
    weight = below(paths.parent, [x * c for x, c in zip(scores, count)])
    landmarks = {k for k in range(len(paths)) if paths.name[k] in _LANDMARKS and text[k] and not shaky[k]}
    for k in range(1, len(paths)):                              # landmarks around a path, itself included
        around[k] = around[paths.parent[k]] + (k in landmarks)
    for k in doubtful:
        apart = len(landmarks) > around[k]
        paths.mark[k] = "" if 2 * weight[k] > weight[0] or (2 * text[k] > text[0] and not apart) else "!"


def threshold(scores: list[float], length: list[int]) -> float:
    """Least score of a content path: in the widest gap (by ratio) of the scores between NEVER and SURE times the median."""
    live = sorted((s, n) for s, n in zip(scores, length) if s > 0)
    left, top = sum(n for _, n in live) / 2, 0.0
    for top, n in live:
        left -= n
        if left <= 0:
            break
    edges = [NEVER * top, *(s for s, _ in live if NEVER * top < s < SURE * top), SURE * top]
    low, high = max(zip(edges, edges[1:]), key=lambda e: e[1] / e[0] if e[0] else 0.0)
    return (low * high) ** 0.5


def content_container(paths: Paths, chosen: set[int]) -> int:
    """The deepest element that holds all ``chosen`` elements, moved out to the outermost landmark around it, or else out of
    paragraphs, lists and inline elements."""
    held = below(paths.up, [int(k in chosen) for k in range(len(paths.up))])
    at = max(k for k in range(len(held)) if held[k] == len(chosen))
    chain = [at]
    while chain[-1]:
        chain.append(paths.up[chain[-1]])
    chain.reverse()
    for k, e in enumerate(chain):
        name = paths.element_name(e)
        if name in _LANDMARKS:
            return e
        if name in _INLINE or (name in _BLOCKS and name not in ("div", "section")):
            return chain[k - 1]
    return at


def kept_blocks(paths: Paths, nodes: list[tuple[int, int, str]]) -> set[int]:
    """Numbers of the blocks that belong to the main text."""
    scores, length, _ = path_scores(paths, nodes)
    if not any(scores):
        return set()
    least = threshold(scores, length)
    gone = paths.gone()
    live = [(e, block) for e, block, text in nodes if text.strip() and not gone[paths.of[e]]]
    sure = [(e, block) for e, block in live if scores[paths.of[e]] >= least]
    container = content_container(paths, {e for e, _ in sure})
    n = len(paths.up)
    inside, landmark, heading = [e == container for e in range(n)], [-1] * n, [False] * n
    for e in range(1, n):
        up, name = paths.up[e], paths.element_name(e)
        inside[e] = inside[e] or inside[up]
        landmark[e] = landmark[up] if landmark[up] >= 0 else e if name in _LANDMARKS else -1
        heading[e] = heading[up] or name in _HEADINGS
    if paths.element_name(container) in _WHOLE:
        first, last = sure[0][1], sure[-1][1]
        marks = {landmark[e] for e, _ in sure} - {-1}
        paragraph = [paths.element_name(e) in _PARAGRAPHS for e in range(n)]
        beside = {paths.up[e] for e, _ in sure if paragraph[e]}
        keep = {block for e, block in live if first <= block <= last or landmark[e] in marks or (paragraph[e] and paths.up[e] in beside)}
    else:
        keep = {block for e, block in live if inside[e]}
    begin = min(keep)
    for e, block in reversed([x for x in live if x[1] < begin]):                       # headings right before the first block
        if not heading[e]:
            break
        keep.add(block)
    return keep


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, joined by one line feed."""
    paths, nodes = text_nodes(page or "")
    settle(paths, nodes)
    keep = kept_blocks(paths, nodes)
    gone = paths.gone()
    blocks: dict[int, list[str]] = {}
    for element, block, text in nodes:
        if block in keep and not gone[paths.of[element]]:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip(" ") for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row; no shuffle.

    Null, empty and content-free pages give an empty text with n_chars 0.  Repeated rows give repeated
    results; other columns are ignored.  Nothing is cut at any length.
    """
    def extract(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr(f"cast(`{id_col}` as long)", f"cast(`{url_col}` as string)", f"`{html_col}`").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")


def op10_path_ratio(spark, sf_dir):
    from seqspark.llm.common import table
    return extract_main_text(table(spark, sf_dir, "pages"))
