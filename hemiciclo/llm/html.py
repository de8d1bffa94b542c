"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its open ancestors. What
browsers don't show (head, scripts, styles, templates, comments of the markup) makes no block; formulas and
drawings are text inside a block, but for their titles, descriptions and annotations. A block's
features are its ancestors' tags, the words of their class, id and role, and its text's shape. A chain with
two labels, main text or not, is trained on labelled pages by maximum likelihood and decoded by Viterbi.

Labelled pages: `labelled_pages` composes layouts (semantic tags, named containers, bare pages) out of parts
whose labels are known, with filler of all lengths, so that no length or language decides by itself.

Each open element takes one frame that shares its parent's sets, and only names the chain knows are kept, so time
and memory stay in proportion to the page, however deep it is.

Edge cases: null and empty html give an empty text; unclosed and stray tags are closed as browsers do it,
nearly; a page that ends inside a tag, comment or script ends there; repeated rows are extracted each.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import with_struct

# Elements of HTML by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul button textarea".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas".split())
#: Inline elements with a markup of their own, whose tags may close themselves, and the parts that aren't shown.
FOREIGN = frozenset(("math", "svg"))
UNSHOWN = frozenset("annotation annotation-xml desc metadata".split())
#: Hidden elements whose content is text, not markup.
_RAW = frozenset("script style title iframe".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+>|[^>]*>|[^>]*\Z)|[!?][^>]*(?:>|\Z))", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: An open p ends where one of these begins.
_ENDS_P = BLOCKS - {"option", "button", "select", "textarea", "legend", "summary", "caption"}
#: Elements that end one another.
_ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Frame(NamedTuple):
    """An open element with what is open around it. Sets are those of the parent unless something new opens,
    so a page with very many open elements takes no more than one frame for each."""

    parent: Frame | None
    tag: str
    telling: frozenset[str]
    inner: str  # the innermost telling tag
    within: tuple[frozenset[str] | None, frozenset[str] | None]  # telling tags inside the outermost article and main
    names: frozenset[str]


@dataclass
class Block:
    text: str
    linked: int = 0  # characters inside links
    frame: Frame | None = None

    @property
    def tags(self) -> tuple[str, ...]:
        """All open elements, the outermost first."""
        out, frame = [], self.frame
        while frame is not None:
            out.append(frame.tag)
            frame = frame.parent
        return tuple(reversed(out))


_NOTHING: frozenset[str] = frozenset()


def opened(parent: Frame | None, tag: str, names: tuple[str, ...]) -> Frame:
    telling, inner, within, known = parent[2:] if parent else (_NOTHING, "none", (None, None), _NOTHING)
    if tag in _TELLING:
        within = tuple(w if w is None or tag in w else w | {tag} for w in within)
        within = tuple(_NOTHING if w is None and tag == t else w for w, t in zip(within, ("article", "main"), strict=True))
        telling, inner = telling if tag in telling else telling | {tag}, tag
    return Frame(parent, tag, telling, inner, within, known if known.issuperset(names) else known.union(names))


def hidden_end(page: str, at: int, name: str) -> int | None:
    """Where the hidden element that opened before ``at`` has ended; None if it doesn't end.

    What looks like its end tag inside a script, style or comment isn't one.
    """
    if name in _RAW:
        end = _end_tag(name).search(page, at)
        return end.end() if end else None
    while True:
        m = _TAG.search(page, at)
        if m is None:
            return None
        at, inner = m.end(), (m[2] or "").lower()
        if m[1] and inner == name:
            return at
        if not m[1] and inner in _RAW:
            end = _end_tag(inner).search(page, at)
            if end is None:
                return None
            at = end.end()


@lru_cache(256)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


@lru_cache(4096)
def _named(attributes: str) -> tuple[str, ...]:
    words = []
    for m in _NAMES.finditer(attributes):
        words += _WORD.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower())
    return tuple(dict.fromkeys(words))


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order; white space inside a block is one blank, references are decoded.

    Of names only ``known`` ones are kept, if given: then what a frame holds is bounded, however many are open.
    """
    found: list[Block] = []
    if not page:
        return found
    stack: list[Frame] = []
    open_tags: Counter[str] = Counter()
    endless: set[str] = set()  # hidden elements that don't end behind here
    parts: list[str] = []
    linked = at = 0

    def close():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, linked, stack[-1] if stack else None))
        parts.clear()
        linked = 0

    def pop(to: int):
        open_tags.subtract(f.tag for f in stack[to:])
        del stack[to:]

    def foreign() -> bool:
        """Whether what is open is part of a formula or drawing."""
        if not any(open_tags[t] for t in FOREIGN):
            return False
        return next((f.tag in FOREIGN for f in reversed(stack) if f.tag in BLOCKS or f.tag in FOREIGN), False)

    while True:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            parts.append(text)
            if open_tags["a"]:
                linked += len(text)
        if m is None:
            close()
            return found
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "text" and foreign():
            parts.append(" ")  # texts of a drawing stand apart
        if m[1]:
            if name in BLOCKS:
                close()
            for i in range(len(stack) - 1, -1, -1) if open_tags[name] else ():
                if stack[i].tag == name:
                    pop(i)
                    break
                if name not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline tag doesn't close a block
            continue
        if name == "br":
            parts.append(" ")
            continue
        empty = name in EMPTY or (m[3].rstrip(">").endswith("/") and (name in FOREIGN or foreign()))
        if name in HIDDEN or (name in UNSHOWN and foreign()):
            if not empty and name not in endless:
                end = hidden_end(page, at, name)
                if end is not None:
                    at = end
                elif name in ("script", "style", "template"):
                    at = len(page)
                else:
                    endless.add(name)
            continue
        if name in BLOCKS:
            close()
            if name in _ENDS_P:
                for i in range(len(stack) - 1, -1, -1) if open_tags["p"] else ():
                    if stack[i].tag == "p":
                        pop(i)
                        break
                    if stack[i].tag in ("button", "table", "td", "th"):
                        break
            if name in _SAME:
                alike = _ALIKE.get(name, (name,))
                for i in range(len(stack) - 1, -1, -1) if any(open_tags[t] for t in alike) else ():
                    if stack[i].tag in alike:
                        pop(i)
                        break
                    if stack[i].tag in _SAME[name]:
                        break
        if not empty:
            names = _named(m[3])
            stack.append(opened(stack[-1] if stack else None, name, names if known is None else tuple(w for w in names if w in known)))
            open_tags[name] += 1


def features(block: Block, at: int, of: int) -> list[str]:
    """Names of the features that hold for a block."""
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    frame = block.frame or opened(None, "none", ())
    out = [f"tag:{t}" for t in frame.telling] + [f"name:{w}" for w in frame.names] + [f"in:{frame.inner}"]
    # Inside an article a heading area belongs to the article; elsewhere it is the page's.
    within = next((w for w in frame.within if w is not None), _NOTHING)
    out += [f"article>{t}" for t in within]
    out.append(f"leaf:{frame.tag}")
    out.append(f"words:{min(words.bit_length(), 6)}")
    out.append(f"links:{min(3, 4 * block.linked // max(n, 1))}")
    if text[-1] in ".!?…":
        out.append("ends")
    if "©" in text:
        out.append("copyright")
    if at == 0:
        out.append("first")
    if at == of - 1:
        out.append("last")
    out.append("bias")
    return out


_TELLING = frozenset("article main nav header footer aside form menu ul ol table section figure blockquote h1 h2 h3 h4 p div dialog select button textarea details label fieldset".split())


@dataclass
class Chain:
    """Weights of a chain: by feature and label, and by label after label."""

    index: dict[str, int] = field(default_factory=dict)
    state: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self):
        self.rows = self.state.tolist()
        self.names = frozenset(f.removeprefix("name:") for f in self.index if f.startswith("name:"))

    def scores(self, page: list[list[str]]) -> list[tuple[float, float]]:
        out = []
        for names in page:
            a = b = 0.0
            for name in names:
                i = self.index.get(name)
                if i is not None:
                    x, y = self.rows[i]
                    a += x
                    b += y
            out.append((a, b))
        return out

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels (1: main text), by Viterbi."""
        (aa, ab), (ba, bb) = self.step.tolist()
        best, back = None, []
        for a, b in self.scores(page):
            if best is None:
                best = (a, b)
                continue
            x, y = best
            from_a, from_b = int(y + ba > x + aa), int(y + bb > x + ab)
            back.append((from_a, from_b))
            best = (a + (y + ba if from_a else x + aa), b + (y + bb if from_b else x + ab))
        if best is None:
            return []
        label = int(best[1] > best[0])
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def trained(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.15, penalty: float = 2e-4) -> Chain:
    """Maximum likelihood with a ridge, by Adam; forward and backward sums run over all pages at once."""
    index: dict[str, int] = {}
    for page, _ in pages:
        for names in page:
            for name in names:
                index.setdefault(name, len(index))
    n, longest = len(pages), max(len(p) for p, _ in pages)
    lengths = np.array([len(p) for p, _ in pages])
    cells = [(i, t, index[name]) for i, (page, _) in enumerate(pages) for t, names in enumerate(page) for name in names]
    row, time, feat = np.array(cells).T
    gold = np.zeros((n, longest, 2))
    for i, (_, labels) in enumerate(pages):
        gold[i, np.arange(len(labels)), labels] = 1
    there = np.arange(longest)[None] < lengths[:, None]
    gold_step = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    w = np.zeros(2 * len(index) + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        state, step = w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2)
        unary = np.zeros((n, longest, 2))
        np.add.at(unary, (row, time), state[feat])
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            forward[:, t] = unary[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + step[None], axis=1)
        for t in range(longest - 2, -1, -1):
            later = np.logaddexp.reduce(step[None] + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], later, 0)
        total = np.logaddexp.reduce(forward[np.arange(n), lengths - 1], axis=1)
        share = np.exp(forward + backward - total[:, None, None]) * there[..., None]
        pair = np.exp(forward[:, :-1, :, None] + step[None, None] + (unary + backward)[:, 1:, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        grad_state = np.zeros_like(state)
        np.add.at(grad_state, feat, (share - gold)[row, time])
        grad = np.concatenate([grad_state.ravel(), (pair.sum((0, 1)) - gold_step).ravel()]) / n + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(index, w[:-4].reshape(-1, 2).copy(), w[-4:].reshape(2, 2).copy())


# Names that sites give to containers, for main text and for the parts around it.
MAIN_NAMES = "article content post entry story body text main page-content entry-content post-body article-body markdown prose blog-post news".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar toc links pagination pager tabs mega-menu skip-link".split(),
    "header": "header site-header masthead banner branding logo top page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon imprint".split(),
    "aside": "sidebar aside widget related recommended trending popular rail more-stories tags author-box newsletter".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion adsbygoogle ad-slot banner-ad sponsor partner".split(),
    "notice": "cookie cookies cookie-banner consent notice alert gdpr privacy-notice notification popup modal overlay paywall subscribe".split(),
    "form": "form search search-form login signup subscribe-form newsletter-form contact-form".split(),
    "comments": "comments comment comment-list comment-body discussion responses replies reply disqus respond reader-comments feedback".split(),
    "share": "share social sharing share-buttons follow social-links".split(),
}
_TAG_OF = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


def labelled_pages(n: int = 600, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of known layout with a label for each leaf block, 1 for main text."""
    r = random.Random(seed)

    def prose(low, high, dot=True):
        words = ["".join(r.choice("bdfgklmnprstv") + r.choice("aeiouéüñ") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(words).capitalize() + ("." if dot else "")

    def any_prose():
        return prose(*r.choice([(1, 3), (3, 10), (10, 40), (30, 90)]), dot=r.random() < 0.7)

    def wrap(kind, inner, depth=0):
        names = r.choice(OTHER_NAMES[kind])
        tag = _TAG_OF.get(kind)
        if tag and r.random() < 0.55:
            open_tag = tag if r.random() < 0.6 else f'{tag} class="{names}"'
        else:
            tag = r.choice(["div", "div", "section", "aside" if kind in ("ad", "aside", "notice") else "div", "ul" if kind in ("nav", "share") else "div"])
            open_tag = f'{tag} {r.choice(["class", "class", "id"])}="{names}{r.choice(["", "", "-" + str(r.randint(1, 9)), " wrap"])}"'
        return f"<{open_tag}>{inner}</{tag}>"

    def other(kind, out):
        parts = []
        for _ in range(r.randint(1, 5) if kind in ("nav", "comments", "aside", "footer", "form") else r.randint(1, 2)):
            text = prose(1, 3, False) if kind in ("nav", "share") and r.random() < 0.9 else any_prose()
            if kind == "footer" and r.random() < 0.4:
                text = "© " + text
            shape = {"nav": ["li", "a", "li"], "form": ["label", "button", "p", "option", "bare"], "comments": ["p", "div", "li", "bare", "article"]}.get(kind, ["p", "bare", "li", "div", "h3", "a"])
            s = r.choice(shape)
            if s == "a":
                parts.append(f'<div><a href="/{prose(1, 1, False)}">{text}</a></div>')
            elif s == "li":
                parts.append(f'<ul><li><a href="/x">{text}</a></li></ul>' if r.random() < 0.7 else f"<ul><li>{text}</ul>")
            elif s == "article":
                parts.append(f'<article class="comment"><p>{text}</p></article>')
            elif s == "label":
                parts.append(f'<div><label>{text}</label><input name="q"></div>')
            elif s == "option":
                parts.append(f"<select><option>{text}</option></select>")
            elif s == "bare":
                parts.append(f"<div>{text}</div>" if parts or kind == "form" else text)
            else:
                parts.append(f"<{s}>{text}</{s}>")
            out.append(0)
        return wrap(kind, "".join(parts))

    pages = []
    for _ in range(n):
        labels: list[int] = []
        html = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"]
        bare = r.random() < 0.06
        for kind in ("notice", "header", "nav", "ad", "form", "share"):
            if not bare and r.random() < {"nav": 0.8, "header": 0.5, "ad": 0.5}.get(kind, 0.25):
                html.append(other(kind, labels))
        open_tag, close_tag = r.choice([
            ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
            (f'<div class="{r.choice(MAIN_NAMES)}">', "</div>"), (f'<div id="{r.choice(MAIN_NAMES)}">', "</div>"),
            (f'<article class="{r.choice(MAIN_NAMES)}">', "</article>"), (f'<section class="{r.choice(MAIN_NAMES)}">', "</section>"),
        ]) if not bare else ("", "")
        html.append(open_tag)
        if r.random() < 0.8:
            title = f"<h1>{prose(2, 10, False)}</h1>"
            labels.append(1)
            if open_tag.startswith(("<article", "<main")) and r.random() < 0.25:
                title = f"<header>{title}</header>"
            html.append(title)
        for _ in range(r.randint(1, 12)):
            s = r.choice(["p"] * 9 + ["h2", "li", "blockquote", "table", "figure", "div", "open"])
            text = any_prose()
            if s == "li":
                html.append(f"<ul><li>{text}</li><li>{prose(1, 8)}</li></ul>")
                labels.append(1)
            elif s == "table":
                html.append(f"<table><tr><td>{text}<td>{prose(1, 3)}</table>")
                labels.append(1)
            elif s == "figure":
                html.append(f"<figure><img src=x><figcaption>{text}</figcaption></figure>")
            elif s == "open":
                html.append(f"<p><b>{text}<br>")
            elif s == "p" and r.random() < 0.15:
                html.append(f'<p>{text} <a href="/y">{prose(1, 6)}</a>')
            else:
                html.append(f"<{s}>{text}</{s}>")
            labels.append(1)
            if not bare and r.random() < 0.06:
                html.append(other(r.choice(["ad", "share", "aside", "notice", "form", "nav"]), labels))
        if not bare and r.random() < 0.15 and "article" in open_tag:
            html.append(other(r.choice(["footer", "comments", "share"]), labels))
        html.append(close_tag)
        for kind in ("comments", "aside", "ad", "form", "share", "footer", "notice"):
            if not bare and r.random() < {"footer": 0.8, "comments": 0.4, "aside": 0.4}.get(kind, 0.15):
                html.append(other(kind, labels))
        if r.random() < 0.85:
            html.append("</body></html>")
        pages.append(("".join(html), labels))
    return pages


def page_features(page: str | None, known: frozenset[str] | None = None) -> tuple[list[Block], list[list[str]]]:
    parts = blocks(page, known)
    return parts, [features(b, i, len(parts)) for i, b in enumerate(parts)]


@lru_cache(1)
def default_chain() -> Chain:
    """The chain trained on `labelled_pages`."""
    pages = []
    for page, labels in labelled_pages():
        parts, rows = page_features(page)
        if len(parts) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        pages.append((rows, labels))
    return trained(pages)


def main_text(page: str | None, chain: Chain) -> str:
    parts, rows = page_features(page, chain.names)
    return "\n".join(b.text for b, label in zip(parts, chain.decode(rows), strict=True) if label)


def extract(pages: DataFrame, chain: Chain | None = None, html: str = "html", name: str = "main") -> DataFrame:
    """``pages`` with a struct ``name``: text and n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(chain or default_chain())

    def run(values):
        texts = [main_text(v, sent.value) for v in values]
        return [{"text": t, "n_chars": len(t)} for t in texts]

    return with_struct(pages, html, run, name, "text string, n_chars bigint")


def report(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"), name="m")
    return out.select("page_id", "url", F.col("m.text").alias("text"), F.col("m.n_chars").alias("n_chars"))
