"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read tag by tag with implied end tags; a leaf block is the text between two block-level borders. Its features
are its ancestors' tags and the tokens of their class, id and role, its own text (length, links, marks, capitals) and
its place. The field's weights are trained here on labelled pages (``html_pages``) by exact gradients of the
likelihood (forward and backward sums), and pages are decoded by Viterbi: the best labels of all blocks together.

Formulas, drawings and the text inside of objects and players flow with the text around them, and the field judges it like
any other. The content of an iframe is another page's or raw text that no reader sees, and goes with the markup.

Defined cases: null or empty html has an empty text; broken or unclosed markup is read as far as it goes (behind the
first tag whose quotes never close, a quoted value ends before the next "<" at the latest); null url
stays null; rows that repeat an id are judged one by one; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 500
#: fixed: elements that stand in a line of text; all others border a block, except br, which is white space
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr object audio video canvas math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded menclose mtable mtr mtd semantics svg g text tspan defs desc path rect circle line use".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: fixed: elements whose content is no text of the page
SKIPPED = frozenset("script style template title textarea iframe noembed noframes head".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: fixed: start tags that end an open element of these names
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"}}
SCOPES = frozenset("table ul ol dl select body html article section div main aside nav header footer form".split())
#: these border no block: text goes on behind them
UNSEEN = (SKIPPED | RAW) - {"head"}
FLOWS = INLINE | UNSEEN
_MARK = re.compile(r"<[!?]|</?[a-zA-Z]")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: where quotes were left open: each try ends at the next tag, so reading stays linear
_BROKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>?", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_TAGS = frozenset("nav header footer aside article main section form ul ol li table td button label select option blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 p div address dl noscript".split())
_BAD = frozenset("nav menu navbar navigation breadcrumb breadcrumbs sidebar side aside footer header masthead comment comments reader disqus reply ad ads advert advertisement adslot sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal paywall subscribe newsletter signup login search share sharing social related recommended widget tags pagination pager toolbar copyright legal disclaimer toc skip".split())
_GOOD = frozenset("article content main story post entry body text".split())


class _Open:
    __slots__ = ("name", "features", "skipped", "link", "block")

    def __init__(self, name, features, skipped, link, around=None):
        self.name, self.features, self.skipped, self.link = name, features, skipped, link
        self.block = around.block if around and name in FLOWS else self


@lru_cache(maxsize=4096)
def _element(name: str, attributes: str) -> tuple[str, ...]:
    out = [f"in:{name}"] if name in _TAGS else []
    tokens = {t for m in _NAME.finditer(attributes) for t in _TOKEN.findall((m[1] or m[2] or m[3] or "").lower())}
    if tokens & _BAD:
        out += ["bad", *(f"bad:{t}" for t in tokens & _BAD)]
    elif tokens & _GOOD:
        out += ["good"]
    return tuple(out)


def blocks(page: str) -> list[tuple[str, int, str, frozenset]]:
    """(text, characters in links, nearest block element, ancestors' features) of each leaf block, in page order."""
    out: list = []
    stack = [_Open("#", frozenset(), False, False)]
    text: list[str] = []
    linked = 0
    where = stack[0]
    opened: Counter = Counter()  # open elements by name: no search of a deep stack for one that isn't there

    def flush():
        nonlocal linked
        if text:
            t = " ".join("".join(text).split())
            if t:
                out.append((t, linked, where.name, where.features))
            text.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked, where
        top = stack[-1]
        if top.skipped or not raw:
            return
        if not text:
            where = top.block
        t = html.unescape(raw) if "&" in raw else raw
        text.append(t)
        if top.link:
            linked += len(t.strip())

    def pop_to(k: int):
        if any(e.name not in FLOWS for e in stack[k:]):
            flush()
        drop(k)

    def drop(k: int):
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    pos, n, tag = 0, len(page), _TAG
    while pos < n:
        at = _MARK.search(page, pos)
        if at is None:
            add(page[pos:])
            break
        m = tag.match(page, at.start())
        if m is None and tag is _TAG:
            if page.find(">", at.start()) < 0:  # the page ends within a tag
                add(page[pos : at.start()])
                break
            tag = _BROKEN
            m = tag.match(page, at.start())
        add(page[pos : m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                add(" ")
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k].name == name:
                    pop_to(k)
                    break
                if name in INLINE and stack[k].name not in INLINE:
                    break
            else:
                if name not in FLOWS:
                    flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name not in FLOWS:
            flush()
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():  # a block-level start ends an open paragraph
                if stack[k].name == "p":
                    drop(k)
                    break
                if stack[k].name in SCOPES or stack[k].name in ("td", "th", "li", "button"):
                    break
            ends = CLOSES.get(name)
            if ends and any(opened[e] for e in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ends:
                        drop(k)
                        if name not in ("tr",):
                            break
                    elif stack[k].name in SCOPES:
                        break
        if name in VOID or m[3].endswith("/") and name in ("path", "use", "svg", "g", "rect", "circle"):
            continue
        top = stack[-1]
        own = _element(name, m[3]) if name not in INLINE else ()
        stack.append(_Open(name, top.features.union(own) if own else top.features, top.skipped or name in SKIPPED, top.link or name == "a", top))
        opened[name] += 1
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            drop(len(stack) - 1)
            pos = end.end() if end else n
    flush()
    return out


def features(page_blocks: list) -> list[list[str]]:
    n, out = len(page_blocks), []
    longest = max((len(b[0]) for b in page_blocks), default=1)
    for k, (text, linked, name, ancestors) in enumerate(page_blocks):
        size = len(text)
        words = text.count(" ") + 1
        f = ["bias", f"is:{name}" if name in _TAGS else "is:other", *ancestors]
        f.append(f"words:{min(words.bit_length(), 8)}")
        f.append("links:" + ("0" if not linked else "some" if linked < 0.5 * size else "most"))
        f.append("end:" + ("stop" if text[-1] in ".!?…\"'”»)" else "none"))
        if "©" in text or text[:9].lower() == "copyright":
            f.append("copyright")
        if "good" in ancestors and "bad" not in ancestors:
            f.append("good-only")
        if "in:article" in ancestors or "in:main" in ancestors:
            f.append("article-only" if not ("bad" in ancestors or "in:aside" in ancestors or "in:form" in ancestors or "in:nav" in ancestors or "in:footer" in ancestors) else "article-but")
        f.append(f"place:{5 * k // n}")
        if k == 0:
            f.append("first")
        if k == n - 1:
            f.append("last")
        if size >= 0.5 * longest:
            f.append("long-here")
        out.append(f)
    return out


class Field:
    """Two labels (1: main text). Only differences of weights matter, so a feature has one weight."""

    def __init__(self, names: list[str]):
        self.at = {f: k for k, f in enumerate(names)}
        self.w = np.zeros(len(names))
        self.t = np.zeros((2, 2))

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
        n, length = len(pages), max(map(len, pages))
        x = np.zeros((n, length, len(self.w)), dtype=np.float32)
        y, mask = np.zeros((n, length), dtype=np.int64), np.zeros((n, length), dtype=bool)
        for i, (p, lab) in enumerate(zip(pages, labels, strict=True)):
            for k, fs in enumerate(p):
                x[i, k, [self.at[f] for f in fs if f in self.at]] = 1
            y[i, : len(lab)], mask[i, : len(lab)] = lab, True
        flat = x.reshape(-1, len(self.w))
        pair = mask[:, 1:]
        seen_t = np.zeros((2, 2))
        np.add.at(seen_t, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        m, v, step = [np.zeros_like(self.w), np.zeros((2, 2))], [np.zeros_like(self.w), np.zeros((2, 2))], 0
        for _ in range(rounds):
            e = (flat @ self.w.astype(np.float32)).reshape(n, length).astype(np.float64)
            node, edge = self._marginals(e, mask)
            g = [flat.T @ ((y - node) * mask).reshape(-1) / n - ridge * self.w, (seen_t - edge) / n - ridge * self.t]
            step += 1
            for k, p in enumerate((self.w, self.t)):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _marginals(self, e: np.ndarray, mask: np.ndarray):
        """P(label 1) of each block and expected transitions, by log sums forward and backward."""
        n, length = e.shape
        emit = np.stack([np.zeros_like(e), e], axis=2)
        a, b = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        a[:, 0] = emit[:, 0]
        for k in range(1, length):
            new = np.logaddexp(a[:, k - 1, 0, None] + self.t[0], a[:, k - 1, 1, None] + self.t[1]) + emit[:, k]
            a[:, k] = np.where(mask[:, k, None], new, a[:, k - 1])
        for k in range(length - 2, -1, -1):
            nxt = emit[:, k + 1] + b[:, k + 1]
            new = np.logaddexp(self.t[:, 0] + nxt[:, :1], self.t[:, 1] + nxt[:, 1:])
            b[:, k] = np.where(mask[:, k + 1, None], new, b[:, k + 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        node = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None])
        edge = np.exp(a[:, :-1, :, None] + self.t + (emit + b)[:, 1:, None, :] - z[:, None, None, None])
        return node, (edge * mask[:, 1:, None, None]).sum(axis=(0, 1))

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi."""
        get, w = self.at.get, self.weights
        (t00, t01), (t10, t11) = self.steps
        s0 = s1 = 0.0
        back = []
        for k, fs in enumerate(page):
            e = 0.0
            for f in fs:
                i = get(f)
                if i is not None:
                    e += w[i]
            if k == 0:
                s0, s1 = 0.0, e
                continue
            f0, f1 = s0 + t00 < s1 + t10, s0 + t01 < s1 + t11
            back.append((f0, f1))
            s0, s1 = (s1 + t10 if f0 else s0 + t00), (s1 + t11 if f1 else s0 + t01) + e
        if not page:
            return []
        out = [int(s1 > s0)]
        for f in reversed(back):
            out.append(int(f[out[-1]]))
        return out[::-1]

    def freeze(self) -> Field:
        self.weights, self.steps = self.w.tolist(), self.t.tolist()
        return self


def training_page(parts) -> tuple[list[list[str]], list[int], list]:
    """Features and labels of a labelled page: marks in its texts tell which part a block came from."""
    marked, kinds = [], []
    for raw, kind in parts:
        if kind is None:
            marked.append(raw)
            continue
        mark = f"\ue000{len(kinds)}\ue001"
        kinds.append(kind)
        marked.append(re.sub(r">([^<>\s][^<>]*)", lambda m, mark=mark: f">{mark}{m[1]}", raw))
    found = blocks("".join(marked))
    labels, clean = [], []
    for text, linked, name, ancestors in found:
        m = re.search("\ue000(\\d+)\ue001", text)
        labels.append(int(kinds[int(m[1])]) if m else 0)
        t = re.sub("\ue000\\d+\ue001", "", text)
        clean.append((t or "x", min(linked, len(t)), name, ancestors))
    return features(clean), labels, clean


@lru_cache(maxsize=2)
def trained(n_pages: int = TRAIN_PAGES, seed: int = 7) -> Field:
    from .html_pages import labelled_pages

    data = [training_page(p) for p in labelled_pages(n_pages, seed)]
    data = [d for d in data if d[0]]
    counts: dict[str, int] = {}
    for d in data:
        for fs in d[0]:
            for f in fs:
                counts[f] = counts.get(f, 0) + 1
    return Field(sorted(f for f, c in counts.items() if c >= 3)).fit([d[0] for d in data], [d[1] for d in data]).freeze()


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, label in zip(found, field.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = [main_text(x, sent.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    only = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return only.mapInArrow(run, f"page_id {kind[id_col]}, url string, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
