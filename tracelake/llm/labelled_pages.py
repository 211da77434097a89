"""Labelled pages from which the extractor learns: small layouts, each piece marked as main text or not.

The pages are put together here from common layouts; their words mean nothing.
"""

from __future__ import annotations

import random

#: (markup before, markup after) of pieces that are not main text.
_AROUND = [
    ("<nav><ul><li><a href='/x'>", "</a></li></ul></nav>"),
    ("<div class='menu'><a href='/x'>", "</a></div>"),
    ("<div id='navbar'><ul class='nav-links'><li><a href='/x'>", "</a></li></ul></div>"),
    ("<ul class='breadcrumb'><li><a href='/x'>", "</a></li></ul>"),
    ("<header class='site-header'><div class='logo'>", "</div></header>"),
    ("<header><p>", "</p></header>"),
    ("<div id='header'><h1>", "</h1></div>"),
    ("<footer><p>", "</p></footer>"),
    ("<footer>", "</footer>"),
    ("<div class='footer'>", "</div>"),
    ("<div class='copyright'>", "</div>"),
    ("<aside><h3>", "</h3></aside>"),
    ("<aside class='sidebar'><ul><li><a href='/x'>", "</a></li></ul></aside>"),
    ("<div id='sidebar'><div class='widget'>", "</div></div>"),
    ("<div class='related-posts'><ul><li><a href='/x'>", "</a></li></ul></div>"),
    ("<div class='cookie-notice'><p>", "</p></div>"),
    ("<div class='cookie-banner consent'>", "</div>"),
    ("<div class='notice'><p>", "</p></div>"),
    ("<div class='alert' role='alert'>", "</div>"),
    ("<div class='ad'>", "</div>"),
    ("<div class='advert'><p>", "</p></div>"),
    ("<div class='advertisement sponsored'>", "</div>"),
    ("<div class='ads banner promo'><a href='/x'>", "</a></div>"),
    ("<form class='newsletter subscribe'><label>", "</label><input><button>send</button></form>"),
    ("<form action='/s'><p>", "</p></form>"),
    ("<div class='search'><form>", "</form></div>"),
    ("<div class='share social'><a href='/x'>", "</a></div>"),
    ("<div class='popup modal'>", "</div>"),
    ("<div class='toolbar'><a href='/x'>", "</a></div>"),
]
#: The same inside or after the article: readers' comments and the like.
_AFTER = [
    ("<section class='comments'><h2>", "</h2></section>"),
    ("<div id='comments'><div class='comment'><p>", "</p></div></div>"),
    ("<ol class='comment-list'><li class='comment'><p>", "</p></li></ol>"),
    ("<div class='replies'><p class='reply'>", "</p></div>"),
    ("<div class='disqus discussion'><p>", "</p></div>"),
]
#: Around all the main text.
_BODY = [
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<main><article class='post'>", "</article></main>"),
    ("<div class='content'>", "</div>"),
    ("<div id='main-content'>", "</div>"),
    ("<div class='post entry-content'>", "</div>"),
    ("<div class='article-body story'>", "</div>"),
    ("<section class='article'>", "</section>"),
    ("<div>", "</div>"),
    ("", ""),
    ("<table><tr><td>", "</td></tr></table>"),
]
#: Around one piece of main text.
_PIECE = [("<p>", "</p>")] * 6 + [
    ("<h1>", "</h1>"),
    ("<h2>", "</h2>"),
    ("<header><h1>", "</h1></header>"),
    ("<ul><li>", "</li></ul>"),
    ("<ol><li>", "</li></ol>"),
    ("<blockquote><p>", "</p></blockquote>"),
    ("<p><b>", "</b></p>"),
    ("<p>word <a href='/x'>", "</a> word word word word</p>"),
    ("<pre><code>", "</code></pre>"),
    ("<figure><figcaption>", "</figcaption></figure>"),
    ("<div><p>", "</p></div>"),
    ("", "<br>"),
    ("", "<br><br>"),
    ("<div>", "</div>"),
    ("<p><br>", "<br></p>"),
    ("<table><tr><td>", "</td></tr></table>"),
]


def pages(n: int = 400, seed: int = 3) -> list[list[tuple[str, bool]]]:
    """Pages as lists of (markup, is main text)."""
    rng = random.Random(seed)
    words = lambda lo, hi: " ".join(["word"] * rng.randint(lo, hi))
    out = []
    for _ in range(n):
        page: list[tuple[str, bool]] = [("<html><head></head><body>", False)]
        for before, after in rng.sample(_AROUND, rng.randint(2, 6)):
            page.append((before + words(1, 15) + after, False))
        before, after = rng.choice(_BODY)
        inner: list[tuple[str, bool]] = [(before, True)]
        for _ in range(rng.randint(2, 9)):
            if rng.random() < 0.12:
                b, a = rng.choice(_AROUND)
                inner.append((b + words(1, 12) + a, False))
            b, a = rng.choice(_PIECE)
            inner.append((b + words(3, 45) + a, True))
        if rng.random() < 0.3:
            b, a = rng.choice(_AFTER)
            inner.append((b + words(3, 30) + a, False))
        page += [*inner, (after, True)]
        if rng.random() < 0.3:
            b, a = rng.choice(_AFTER)
            page.append((b + words(3, 30) + a, False))
        for before, after in rng.sample(_AROUND, rng.randint(1, 4)):
            page.append((before + words(1, 20) + after, False))
        page.append(("</body></html>", False))
        out.append(page)
    return out
