"""Labelled pages the extraction model is trained on: layouts written by hand, filled with invented prose.

``data-main`` marks what belongs to the article (1) and what doesn't (0), for all that
lies within. The attribute is never an input of the model.
"""

from __future__ import annotations

import random

_PARTS = "ba ce di fo gu la me ni po ru sa te vi wo za ther tion ent ing str mor el an is on".split()

#: {s} a short phrase, {l} a link list of three, {p} paragraphs, {q} one short paragraph, {h} a heading.
LAYOUTS = (
    '<body><nav><ul>{l}</ul></nav><div class="ad">{q}</div><article data-main="1"><h1>{h}</h1>{p}</article><footer>&copy; {s}</footer></body>',
    '<body><header><a href="/">{s}</a><ul class="menu">{l}</ul></header><main data-main="1"><h1>{h}</h1>{p}<h2>{h}</h2>{p}</main><aside><h3>{s}</h3><ul>{l}</ul></aside><footer><p>{q}</p></footer></body>',
    '<body><div id="header"><div class="logo">{s}</div><div id="nav"><ul>{l}</ul></div></div><div id="wrapper"><div id="content" data-main="1"><h2>{h}</h2>{p}<ul><li>{s}</li><li>{q}</li></ul>{p}</div><div id="sidebar"><h4>{s}</h4><p>{q}</p><ul>{l}</ul></div></div><div id="footer"><p>{s}</p></div></body>',
    '<body><div class="cookie-notice"><p>{q}</p><button>{s}</button></div><div class="topbar">{l}</div><div class="post" data-main="1"><h1 class="title">{h}</h1><div class="entry-content">{p}</div></div><div class="comments" data-main="0"><h3>{s}</h3><div class="comment"><b>{s}</b>{p}</div><div class="comment">{q}</div></div><div class="site-footer">{s}</div></body>',
    '<body><article data-main="1"><header><h1>{h}</h1></header>{p}<aside class="related" data-main="0"><h4>{s}</h4><ul>{l}</ul></aside>{p}<div class="ad-slot" data-main="0"><p>{q}</p></div><blockquote>{q}</blockquote></article><section id="comments"><h2>{s}</h2><ol><li>{p}</li><li>{q}</li></ol></section></body>',
    '<body><form action="/search"><label>{s}</label><button>{s}</button></form><table><tr><td class="menu"><ul>{l}</ul></td><td class="main" data-main="1"><h1>{h}</h1>{p}</td><td class="right banner"><p>{q}</p></td></tr></table><p class="copyright">&copy; {s}</p></body>',
    '<body><div role="banner">{s}</div><div role="navigation">{l}</div><div role="main" data-main="1"><h1>{h}</h1>{p}</div><div role="complementary"><p>{q}</p><p>{q}</p></div><div role="contentinfo"><p>{q}</p></div></body>',
    '<body><div class="breadcrumb">{l}</div><section class="story" data-main="1"><h1>{h}</h1><p>{s}</p>{p}<h3>{h}</h3>{p}</section><div class="share-buttons"><ul>{l}</ul></div><div class="newsletter"><h3>{s}</h3><p>{q}</p><form><label>{s}</label><button>{s}</button></form></div><section class="related-posts"><h3>{s}</h3><div><a href="/x">{h}</a><p>{q}</p></div></section></body>',
    '<body><div class="modal popup"><h2>{s}</h2><p>{q}</p></div><div><h1 data-main="1">{h}</h1><div data-main="1">{p}</div></div><div class="sponsored"><p>{q}</p><p>{q}</p></div><div class="tags">{l}</div></body>',
    '<body><h1 data-main="1">{h}</h1><div data-main="1">{p}</div><p><a href="/a">{s}</a> | <a href="/b">{s}</a></p></body>',
    '<body><div class="page"><div class="nav-bar"><a href="/">{s}</a></div><div class="article-body" data-main="1">{p}<pre>{q}</pre><figure><figcaption>{q}</figcaption></figure>{p}</div><div class="user-comments"><div class="reply">{p}</div><div class="reply">{p}</div></div></div></body>',
    '<body><header class="site-header"><nav>{l}</nav></header><div class="alert notice">{q}</div><main><article data-main="1"><h1>{h}</h1>{p}</article><aside class="sidebar"><div class="widget"><h4>{s}</h4><p>{q}</p></div><div class="advert"><p>{q}</p></div></aside><div id="disqus_thread"><p>{p}</p></div></main><footer class="footer"><div>{l}</div><p>{q}</p></footer></body>',
    '<body><div class="menu">{l}</div><div class="text" data-main="1"><h1>{h}</h1>{p}<ol><li>{q}</li><li>{q}</li></ol><table><tr><th>{s}</th><td>{q}</td></tr></table></div><div class="promo"><h3>{s}</h3>{p}</div><div class="login"><form><label>{s}</label><p>{q}</p><button>{s}</button></form></div></body>',
    '<body><aside>{p}</aside><nav><p>{q}</p>{l}</nav><article data-main="1">{p}</article><footer>{p}</footer></body>',
    '<body><div class="ads"><p>{p}</p></div><div class="disclaimer notice">{p}</div><article data-main="1"><h1>{h}</h1><p>{q}</p></article><div class="comment-list">{p}</div></body>',
    '<body><nav><ul>{l}</ul></nav><div class="ad">{q}</div><article data-main="1"><h1>{s}</h1><p>{s}</p></article><footer>&copy; {s} &middot; {q}</footer></body>',
    '<body><dialog open><p>{q}</p></dialog><div hidden><p>{q}</p></div><div style="display:none">{p}</div><main data-main="1"><p>{s}</p><p>123 456</p><ul><li>{s}</li><li>{s}</li></ul></main><div class="pagination">1 2 3 {l}</div><footer>{q} © 2020</footer></body>',
    '<body><div id="top-banner"><p>{q}</p></div><div class="container"><div class="row"><div class="article" data-main="1"><h1>{s}</h1>{p}<h2>{s}</h2><p>{s}</p></div><div class="column right"><div class="box">{l}</div></div></div></div><div id="reviews"><p>{q}</p>{p}</div></body>',
)


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_PARTS) for _ in range(rng.randint(1, 4)))


def _phrase(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_word(rng) for _ in range(rng.randint(low, high))).capitalize()


def _paragraph(rng: random.Random, sentences: int) -> str:
    return "<p>" + " ".join(_phrase(rng, 3, 22) + rng.choice([".", ".", ".", "?", "!"]) for _ in range(sentences)) + "</p>"


def _fill(layout: str, rng: random.Random) -> str:
    make = {
        "s": lambda: _phrase(rng, 1, 4),
        "h": lambda: _phrase(rng, 3, 10),
        "q": lambda: _phrase(rng, 4, 22) + rng.choice(["", ".", "."]),
        "p": lambda: "".join(_paragraph(rng, rng.randint(1, 5)) for _ in range(rng.randint(1, 4))),
        "l": lambda: "".join(f'<li><a href="/{_word(rng)}">{_phrase(rng, 1, 3)}</a></li>' for _ in range(rng.randint(2, 6))),
    }
    out = layout
    for key, one in make.items():
        while (mark := "{" + key + "}") in out:
            out = out.replace(mark, one(), 1)
    return f"<html><head><title>x</title></head>{out}</html>"


def labelled_pages(copies: int = 8, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return [_fill(layout, rng) for _ in range(copies) for layout in LAYOUTS]
