"""Main text of web pages: flat text blocks with words and link density of neighbours, classified by a small decision tree."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmem.llm import html_samples

#: Elements whose content is never text of the page; RAW ones hold no markup.
_SILENT = set("script style noscript template svg math iframe object textarea select button canvas audio video head".split())
_RAW = set("script style textarea noscript iframe template svg".split())
_META = set("title meta link base script style noscript template".split())
#: Elements that end a block of text.
_BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Elements that another paragraph, item or heading ends.
_LOOSE = {"p", "li", *_HEADINGS}
#: Elements, and names in class, id or role, that hold what stands beside the article, or the article.
_ASIDE = set("nav header footer aside form menu dialog".split())
_STRONG = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer topbar toolbar share sharing comment comments commentlist disqus respond replies reply newsletter subscribe subscription signup login widget widgets "
    "pagination pager skip copyright contentinfo complementary dialog outbrain taboola".split()
)
_WEAK = set("side header masthead social related recommended recommendations search legal disclaimer".split())
#: Words that may stand beside those within one name, as in site-footer or ad-box; others make it another name.
_NEUTRAL = set("site page post posts list box container wrapper wrap area section block inner outer left right top bottom item items link links bar panel form global main primary secondary row col unit slot body content title text icon image".split())
_ARTICLE = set("article-body articlebody article-content article-text post-content post-body entry-content main-content story-body main article".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)
_UNSEEN = re.compile(r"""display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_LINK, _LINK_END = re.compile(r"<a[\s>]", re.I), re.compile(r"</a\s*>", re.I)
_ENDS = tuple(".!?:;\u2026\u3002\uff01\uff1f")
_QUOTES = "\"')]\u00bb\u201d\u2019"
#: Output of this many characters is one batch, so that long pages need bounded memory.
BATCH_CHARS = 8_000_000

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "sentence", "article", "aside", "heading")
_MAIN, _WEAKLY, _BESIDE, _UNHEARD = 1, 2, 4, 8


@dataclass
class Tree:
    """A binary decision tree: rows with x[feature] <= at go to low, the others to high; leaves hold a label."""

    label: int
    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.label)
        out, low = np.empty(len(x), int), x[:, self.feature] <= self.at
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """A tree by Gini impurity; ties go to the earlier feature and the lower threshold, so that training is repeatable."""
    label = int(2 * y.sum() >= len(y))
    if depth == 0 or y.min() == y.max():
        return Tree(label)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            gini = sum(len(p) * (1 - (p.mean() ** 2 + (1 - p.mean()) ** 2)) for p in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, at
    if best is None:
        return Tree(label)
    low = x[:, best[1]] <= best[2]
    return Tree(label, best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train() -> Tree:
    """The tree of the labelled pages: each block of theirs is a row, its text's first character the label."""
    x, y = [], []
    for page in html_samples.pages():
        texts, rows = blocks(page)
        x.append(rows)
        y += [t[0] == "+" for t in texts]
    return grow(np.vstack(x), np.array(y, int))


class _Open:
    """The open elements. Each knows what it lies in, so that no step looks through the stack."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int]] = []  # name, kinds with those around, heading's level, last wall
        self.places: dict[str, list[int]] = {}

    def top(self) -> tuple[str, int, int, int]:
        return self.stack[-1] if self.stack else ("", 0, 0, -1)

    def push(self, name: str, kind: int) -> None:
        _, kinds, level, wall = self.top()
        self.places.setdefault(name, []).append(len(self.stack))
        wall = wall if name in _LOOSE or name not in _BLOCKS else len(self.stack)
        self.stack.append((name, kinds | kind, _HEADINGS.get(name, level), wall))

    def pop(self, name: str, implied: bool = False) -> bool:
        """Closes the innermost such element and all within; an implied end only if no other block lies between."""
        places = self.places.get(name)
        if not places or (implied and places[-1] < self.top()[3]):
            return False
        for inner, *_ in reversed(self.stack[places[-1] :]):
            self.places[inner].pop()
            self.stack.pop()
        return True


class _Next:
    """Where a pattern is next found; asked with rising places, it reads the page once."""

    def __init__(self, pattern: re.Pattern, page: str):
        self.pattern, self.page, self.found = pattern, page, -1

    def after(self, at: int) -> int:
        if self.found < at:
            m = self.pattern.search(self.page, at)
            self.found = m.start() if m else len(self.page) + 1
        return self.found


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Flat text blocks of a page in order, with decoded and trimmed text, and their features; in linear time."""
    texts, rows = [], []
    parts: list[tuple[str, bool]] = []
    opened = _Open()
    link, link_end = _Next(_LINK, page), _Next(_LINK_END, page)
    linked = 0  # 1: in a link that a block ends, 2: in one that its own tag ends

    def end() -> None:
        if parts:
            whole = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
            if whole:
                words = len(whole.split())
                of_links = len(entities.unescape(" ".join(p for p, a in parts if a)).split())
                _, kinds, level, _ = opened.top()
                aside = 2 if kinds & _BESIDE else 1 if kinds & _WEAKLY else 0
                heading = 2 if level == 1 else int(level > 0)
                texts.append(whole)
                rows.append((words, min(1.0, of_links / words), whole.rstrip(_QUOTES).endswith(_ENDS), kinds & _MAIN, aside, heading))
            parts.clear()

    at, last = 0, page.rfind(">")
    while at < len(page):
        m = _TAG.search(page, at) if at <= last else _UNENDED.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not opened.top()[1] & _UNHEARD:
            parts.append((text, linked > 0))
        if m is None or at > last:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        close, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if "head" in opened.places and opened.places["head"] and name not in _META and not (close and name != "head"):
            opened.pop("head")
        if name == "a":
            linked = 0 if close or "href" not in rest.lower() else 2 if link_end.after(at) < link.after(at) else 1
            continue
        if name == "br":
            parts.append((" ", linked > 0))
            continue
        if close:
            if name in _BLOCKS or opened.places.get(name):
                end()
                linked = linked if linked == 2 else 0
                opened.pop(name)
            continue
        if name in _RAW and not (name == "svg" and rest.endswith("/")):
            done = _RAW_END[name].search(page, at)
            at = done.end() if done else len(page)
            if name != "script" and name != "style":
                end()
            continue
        kind = _kind(name, rest, opened.top()[1])
        if name not in _BLOCKS and not kind:
            continue
        end()
        linked = linked if linked == 2 else 0
        if name in _BLOCKS:
            opened.pop("p", implied=True)
            if name in _LOOSE:
                opened.pop(name, implied=True)
        if name not in _VOID and not (name not in _BLOCKS and rest.endswith("/")):
            opened.push(name, kind)
    end()
    base = np.array(rows, float).reshape(-1, 6)
    near = np.zeros((len(base) + 2, 2))
    near[1:-1] = base[:, :2]
    base[:, 3] = _within(base)
    return texts, np.hstack([base[:, :2], near[:-2], near[2:], base[:, 2:]])


_UNENDED = re.compile(r"<[/!?a-zA-Z]")


def _within(base: np.ndarray) -> np.ndarray:
    """1 for blocks of an article, -1 for those beside it; 0 where the page has none that holds much of its text."""
    words = base[:, 0] * (1 - base[:, 1]) * (base[:, 4] < 2)
    inside = base[:, 3] > 0
    held, whole = words[inside].sum(), words.sum()
    return np.where(inside, 1, -1) if held and 4 * held >= whole else np.zeros(len(base))


def _kind(name: str, attributes: str, around: int) -> int:
    """What an element says of the text in it."""
    if name in _SILENT:
        return _UNHEARD
    kind = _MAIN if name in ("article", "main") else 0
    if name in _ASIDE and not (name == "header" and around & _MAIN):
        kind |= _BESIDE
    if not attributes or attributes == "/":
        return kind
    if _HIDDEN.search(_QUOTED.sub("", attributes)) or _UNSEEN.search(attributes):
        return _UNHEARD
    if name in ("html", "body", "main"):
        return kind
    for _, *value in _NAMED.findall(attributes):
        for token in re.sub("([a-z])([A-Z])", r"\1-\2", "".join(value)).lower().replace("_", "-").split():
            words = {w for w in re.split("[^a-z]+", token) if len(w) > 1}
            if token in _ARTICLE:
                kind |= _MAIN
            elif words & _STRONG and words <= _STRONG | _WEAK | _NEUTRAL:
                kind |= _BESIDE
            elif words & _WEAK and words <= _WEAK | _NEUTRAL and not (around & _MAIN and "header" in words):
                kind |= _WEAKLY
    return kind


def main_text(page: str | None, tree: Tree) -> str:
    """The blocks that the tree takes for main text, joined by one newline; nothing of them is cut."""
    texts, x = blocks(page or "")
    if not texts:
        return ""
    return "\n".join(t for t, keep in zip(texts, tree.predict(x), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, the columns of `keep`, text, n_chars) for every page: the article's blocks in order, joined by one newline.

    A null, empty or wholly silent page gives an empty text; markup that doesn't end runs to the end of the page;
    repeated rows give repeated results; a null id stays null; columns of `pages` that `keep` doesn't name don't matter,
    and one that it names like a result gives way to it. Time is linear in a page's length. One scan, no shuffle; the
    tree (a few dozen nodes) goes with the task.
    """
    tree = train()
    cols = [c for c in dict.fromkeys([id_col, *keep]) if c == id_col or c.lower() not in ("text", "n_chars")]

    def run(batches):
        for b in batches:
            pages_of, at = b.column(len(cols)), 0
            while at < len(pages_of):
                text, size, start = [], 0, at
                while at < len(pages_of) and size < BATCH_CHARS:
                    text.append(main_text(pages_of[at].as_py(), tree))
                    size += len(text[-1])
                    at += 1
                kept = [c.slice(start, at - start) for c in b.columns[: len(cols)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*cols, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in cols)
    return pages.select(*[F.col(c) for c in cols], F.col(html_col)).mapInArrow(run, f"{kinds}, text string, n_chars long")
