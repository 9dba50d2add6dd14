"""Labelled pages for training: layouts with known main text, made up from a seed.

Each page is a list of (html, is_main) parts in page order. Layouts vary the wrappers, the class names, where the
title stands, what surrounds and interrupts the article, and which end tags are left out.
"""

from __future__ import annotations

import numpy as np

_SYLLABLES = "an be co de el fa go ha in ka lo mi no or pa qui ro sa te un ver wi yo za".split()
_MAIN_CLASSES = ["content", "post-body", "entry-content", "article-text", "story", "main-content", "post", "text"]


class _Page:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.words = ["".join(rng.choice(_SYLLABLES, rng.integers(1, 4))) for _ in range(300)]

    def one(self, *options):
        return options[self.rng.integers(len(options))]

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def text(self, lo: int, hi: int, stop: bool = True) -> str:
        w = [self.words[i] for i in self.rng.integers(0, len(self.words), self.rng.integers(lo, hi))]
        out, n = [], 0
        for k, x in enumerate(w):
            out.append(x.capitalize() if n == 0 else x)
            n += 1
            if stop and (self.maybe(0.12) or k == len(w) - 1):
                out[-1] += self.one(".", ".", ".", "!", "?")
                n = 0
            elif self.maybe(0.06):
                out[-1] += self.one(",", ",", ";", "***", "%%%", " |", "&amp;")
        return " ".join(out)

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.text(1, 4, False)}</a></li>' for k in range(n))


def _menu(p: _Page):
    c = p.one("", ' class="menu"', ' class="navbar"', ' id="nav"')
    inner = p.links(int(p.rng.integers(3, 9)))
    return [(p.one(f"<nav{c}><ul>{inner}</ul></nav>", f"<div{c or ' class=menu'}><ul>{inner}</ul></div>", f'<ul class="breadcrumb">{inner}</ul>'), False)]


def _header(p: _Page):
    return [(p.one(f"<header><a href='/'>{p.text(1, 3, False)}</a><p>{p.text(3, 9)}</p></header>", f'<div id="header"><h2>{p.text(1, 4, False)}</h2></div>', f'<header class="site-header"><h1>{p.text(1, 3, False)}</h1></header>'), False)]


def _notice(p: _Page):
    c = p.one("cookie-notice", "consent", "notice", "alert-banner", "gdpr", "subscribe-banner", "paywall")
    return [(f'<div class="{c}"><p>{p.text(5, 30)}</p><button>{p.text(1, 3, False)}</button></div>', False)]


def _advert(p: _Page):
    c = p.one("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner")
    body = p.one(p.text(4, 40), f"<p>{p.text(4, 40)}</p>", f'<a href="http://x.example/">{p.text(3, 12)}</a>')
    return [(p.one(f'<div class="{c}">{body}</div>', f'<aside class="{c}">{body}</aside>', f'<div id="{c}-1">{body}</div>'), False)]


def _sidebar(p: _Page):
    body = p.one(f"<h3>{p.text(1, 4, False)}</h3><ul>{p.links(5)}</ul>", f"<p>{p.text(5, 40)}</p>", f"<h4>{p.text(1, 3, False)}</h4><p>{p.text(8, 40)}</p><p>{p.text(8, 40)}</p>")
    return [(p.one(f"<aside>{body}</aside>", f'<div class="sidebar">{body}</div>', f'<section class="widget related">{body}</section>', f'<div id="right-column" class="side">{body}</div>'), False)]


def _form(p: _Page):
    return [(p.one(f'<form action="/s"><label>{p.text(1, 4, False)}</label><input name="q"><button>{p.text(1, 2, False)}</button></form>', f'<div class="newsletter"><form><p>{p.text(4, 15)}</p><select><option>{p.text(1, 3, False)}<option>{p.text(1, 3, False)}</select></form></div>'), False)]


def _comments(p: _Page):
    each = "".join(p.one(f'<div class="comment"><b>{p.text(1, 3, False)}</b><p>{p.text(4, 60)}</p></div>', f"<li><p>{p.text(4, 60)}</p></li>", f'<article class="comment"><p>{p.text(4, 60)}</p></article>') for _ in range(int(p.rng.integers(1, 6))))
    return [(p.one(f'<section id="comments"><h3>{p.text(1, 3, False)}</h3>{each}</section>', f'<div class="comments">{each}</div>', f'<ol class="comment-list">{each}</ol>', f'<div class="reader-comments"><h2>{p.text(1, 3, False)}</h2>{each}</div>'), False)]


def _share(p: _Page):
    return [(p.one(f'<div class="share">{p.text(1, 3, False)} <a href="#">{p.text(1, 2, False)}</a> <a href="#">{p.text(1, 2, False)}</a></div>', f'<ul class="social">{p.links(3)}</ul>', f'<div class="tags"><a href="#">{p.text(1, 2, False)}</a></div>'), False)]


def _footer(p: _Page):
    t = p.one(f"&copy; {p.text(1, 3, False)}", f"&copy; 2020 {p.text(1, 5, False)} &middot; {p.text(3, 10)}", p.text(4, 25), f"Copyright {p.text(1, 4, False)}. {p.text(3, 8)}")
    return [(p.one(f"<footer>{t}</footer>", f"<footer><p>{t}</p><ul>{p.links(3)}</ul></footer>", f'<div id="footer">{t}</div>', f'<div class="site-footer"><p>{t}</p></div>'), False)]


def _scripts(p: _Page):
    return [(p.one('<script>var t="</p>";track(1);</script>', "<style>p{margin:0}</style>", "<noscript><p>Enable it</p></noscript>", "<!-- x -->", "<template><p>t</p></template>"), False)]


def _article(p: _Page):
    open_, close = p.one(("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f'<div class="{p.one(*_MAIN_CLASSES)}">', "</div>"), (f'<div id="{p.one(*_MAIN_CLASSES)}">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), (f'<article class="{p.one(*_MAIN_CLASSES)}">', "</article>"), ("<table><tr><td>", "</td></tr></table>"))
    title, out = p.text(2, 14), [(open_, None)]
    if p.maybe(0.8):
        head = p.one("h1", "h1", "h1", "h2")
        out.append((f"<{head}>{title}</{head}>", True))
    for _ in range(int(p.rng.choice([1, 2, 3, 5, 8, 14, 25]))):
        r, short = p.rng.random(), p.maybe(0.2)
        t = p.text(1, 5) if short else p.text(8, 120)
        if r < 0.72:
            out.append((f"<p>{t}" + p.one("</p>", "</p>", "</p>", ""), True))
        elif r < 0.78:
            out.append((f"<p><b>{p.text(2, 12)}<br>", True))
        elif r < 0.83:
            out.append((f"<h2>{p.text(1, 7, False)}</h2>", True))
        elif r < 0.87:
            out += [("<ul>", None), *((f"<li>{p.text(2, 20)}</li>", True) for _ in range(int(p.rng.integers(2, 6)))), ("</ul>", None)]
        elif r < 0.9:
            out.append((f"<blockquote><p>{t}</p></blockquote>", True))
        elif r < 0.92:
            out.append((f"<div>{t}</div>", True))
        elif r < 0.94:
            out.append((f'<p>{t} <a href="/x">{p.text(1, 4, False)}</a> {p.text(2, 9)}</p>', True))
        elif r < 0.955:
            out.append((f"<pre>{p.text(3, 30, False)}</pre>", True))
        elif r < 0.97:
            out += _advert(p)
        elif r < 0.98:
            out += _share(p)
        else:
            out += p.one(_form, _notice, _scripts)(p)
    if p.maybe(0.1):
        out += p.one(_share, _comments, _sidebar)(p)
    return [*out, (close, None)]


def labelled_pages(n: int, seed: int = 7) -> list[list[tuple[str, bool | None]]]:
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        p = _Page(rng)
        parts = [(f"<!DOCTYPE html><html><head><title>{p.text(2, 9)}</title><style>a{{}}</style></head><body>", None)]
        before = [f for f, q in ((_header, 0.4), (_menu, 0.8), (_notice, 0.2), (_advert, 0.4), (_scripts, 0.3), (_sidebar, 0.15), (_form, 0.1)) if p.maybe(q)]
        after = [f for f, q in ((_share, 0.2), (_comments, 0.35), (_sidebar, 0.35), (_advert, 0.2), (_form, 0.15), (_notice, 0.1), (_menu, 0.15)) if p.maybe(q)]
        for f in rng.permutation(np.array(before, dtype=object)).tolist():
            parts += f(p)
        parts += _article(p)
        for f in after:
            parts += f(p)
        if p.maybe(0.85):
            parts += _footer(p)
        if p.maybe(0.8):
            parts.append(("</body></html>", None))
        out.append(parts)
    return out
