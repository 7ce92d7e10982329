"""Main text of web pages: flat text blocks, their features and those of their neighbours, and a decision tree.

A page is read once into text blocks; a block's features are its words and link density, those of the blocks before
and after it, and marks of the elements around it. The tree is trained here, on the small labelled table in html_labels.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_labels import LABELLED, MARK

_TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>")
_HINT = re.compile(r"""(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = frozenset("script style noscript template iframe object svg title textarea canvas audio video xmp noframes noembed".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_BOILER_TAGS = frozenset("aside button dialog fieldset footer form head menu nav option select".split())
_BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toast toolbar topbar widget".split()
)
_ARTICLE_WORDS = frozenset("article articlebody entry main post story".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SENTENCE = re.compile(r"[.!?…。！？:;\"»”)]$")


def _marks(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is around unwanted text, and whether it is around an article."""
    boiler, article = tag in _BOILER_TAGS, tag in ("article", "main")
    if tag == "header" and not inside:
        boiler = True
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in _HINT.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                boiler = True
            elif name == "style":
                boiler |= "display:none" in value.replace(" ", "")
            elif name in ("class", "id", "role", "itemprop"):
                words = set(_WORD.findall(value))
                boiler |= bool(words & _BOILER_WORDS) or not inside and tag not in _HEADINGS and "header" in words
                article |= bool(words & _ARTICLE_WORDS)
    return boiler, article and not boiler


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, marks) of each text block; marks: 1 unwanted around, 2 article around, 4 heading, 8 list item, 16 table cell."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, unwanted, article, link
    top = ("", False, False, False)
    lower = None

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                tags = {s[0] for s in stack}
                out.append((" ".join(words), len(words), min(linked, len(words)), top[1] + 2 * top[2] + 4 * bool(tags & _HEADINGS) + 8 * ("li" in tags) + 16 * bool(tags & {"td", "th"})))
        parts, linked = [], 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            parts.append(page[a:b])
            if top[3]:
                linked += len(page[a:b].split())

    at = 0
    n = len(page)
    while at < n:
        nxt = page.find("<", at)
        if nxt < 0:
            text(at, n)
            break
        text(at, nxt)
        if page.startswith("<!--", nxt):
            end = page.find("-->", nxt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TOKEN.match(page, nxt)
        if not m:
            parts.append("<")
            at = nxt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                close()
            if tag in _BLOCK or tag == "a":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        top = stack[-1] if stack else ("", False, False, False)
                        break
                    if tag == "a" and stack[i][0] in _BLOCK:
                        break
            continue
        if tag in _RAW and not (tag == "svg" and m[3].endswith("/")):
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            if end < 0 or len(lower) != n:
                found = re.compile(f"</{tag}", re.I).search(page, at)
                end = found.start() if found else n if tag in ("script", "style") else -1
            if end < 0:  # never closed: only the tag goes
                continue
            gt = page.find(">", end)
            at = n if gt < 0 else gt + 1
            if tag in ("textarea", "title"):
                close()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            close()
            if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") or tag in _HEADINGS:  # these end an open one of their kind
                kinds = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in kinds or tag != "p" and stack[i][0] == "p":
                        del stack[i:]
                        top = stack[-1] if stack else ("", False, False, False)
                        break
                    if stack[i][0] in _BLOCK:
                        break
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK and tag != "a":
            continue
        if tag in _BLOCK or tag == "a":
            boiler, article = _marks(tag, m[3], top[2])
            top = (tag, top[1] or boiler, top[2] or article, tag == "a" or top[3] and tag != "a")
            stack.append(top)
    close()
    return out


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """A row per block: words, link density, the same of the blocks before and after, the five marks, ends as a sentence, page has an article."""
    if not found:
        return np.zeros((0, 13))
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found]) / words
    marks = np.array([b[3] for b in found])
    around = [np.r_[0, words[:-1]], np.r_[0, density[:-1]], np.r_[words[1:], 0], np.r_[density[1:], 0]]
    flags = [(marks >> i) & 1 for i in range(5)]
    ends = [bool(_SENTENCE.search(b[0])) for b in found]
    wanted = ((marks & 3) == 2).any()
    return np.stack([words, density, *around, *flags, ends, np.full(len(found), wanted)], axis=1).astype(float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple | float:
    """A binary decision tree by Gini impurity: (feature, threshold, low side, high side) or the share of wanted blocks."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            n = int(low.sum())
            if min(n, len(y) - n) < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None or best[0] >= y.mean() * (1 - y.mean()) - 1e-12:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(1)
def trained() -> tuple | float:
    """The tree of the labelled table: blocks that start with MARK are wanted."""
    xs, ys = [], []
    for page in LABELLED:
        found = blocks(page)
        xs.append(features(found))
        ys.extend(b[0].startswith(MARK) for b in found)
    return grow(np.concatenate(xs), np.array(ys, float))


def _share(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    side = x[:, f] <= cut
    out = np.empty(len(x))
    out[side], out[~side] = _share(low, x[side]), _share(high, x[~side])
    return out


def main_text(page: str | None, tree: tuple | float) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b[0] for b, p in zip(found, _share(tree, features(found))) if p >= 0.5)


def _extractor(tree: tuple | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages: the main text of the whole page.

    Character references are decoded, white space within a block becomes one space, blocks are joined in page order by
    a line feed. Null or empty pages and pages without wanted blocks give the empty string; repeated rows give
    repeated results; unclosed elements end with the page; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extractor(trained()), "page_id long, url string, text string, n_chars long")
