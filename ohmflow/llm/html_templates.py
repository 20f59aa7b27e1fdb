"""Labelled pages to learn from: texts of given pages set into layouts drawn at random.

Every element that a layout adds says in data-keep whether it belongs to the article. Layouts differ in their elements (semantic or
plain), in their names (telling, partly telling or none) and in what they hold: menus, banners, side columns, notices, adverts,
forms, related links, reader comments and footers.
"""

from __future__ import annotations

import html
import random

#: Names that layouts give to their parts, by kind; the features of html_extract group attribute words by these kinds.
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc topbar toolbar pagination pager tabs skip links",
    "ad": "ad ads advert adverts advertisement advertising adsense adbox banner promo promoted promotion sponsor sponsored dfp taboola outbrain commercial anzeige werbung publicidad",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog paywall disclaimer privacy warning hidden toast subscribe newsletter signup",
    "comment": "comment comments commentlist discussion disqus reply replies respond responses thread reader readers feedback guestbook kommentare commentaires",
    "side": "sidebar aside side widget widgets rail column secondary complementary related recommended recommendations trending popular more similar latest share social sharing sharebar tags tagcloud author bio",
    "foot": "footer foot bottom copyright colophon legal imprint contentinfo sitemap credits",
    "head": "header head masthead top logo brand branding site hero",
    "form": "form search searchbox login signin register input contact survey poll button field filter",
    "content": "article content main body post entry story text articlebody maincontent postcontent page prose read wrapper container news blog",
}
_SHORT = "Home News About Contact Archive Help Login Terms Sport Culture Shop Jobs Blog Team Press FAQ Privacy Start Travel Science".split()
_SAID = ["We use cookies to improve this site.", "Please accept our terms.", "Subscribe to our newsletter today", "You have 2 free articles left.", "This site is best viewed in a modern browser.", "Sign up now", "Share this page"]


def _tag(r: random.Random, tag: str, inner: str, keep: int | None = None, kind: str = "", named: float = 0.6) -> str:
    name = ""
    if kind and r.random() < named:
        words = KINDS[kind].split()
        name = f' {r.choice(["class", "class", "id"])}="{r.choice(["", "x-", "page-", "js "])}{r.choice(words)}{r.choice(["", "-box", " col", "_1", "-inner"])}"'
    said = "" if keep is None else f' data-keep="{keep}"'
    return f"<{tag}{name}{said}>{inner}</{tag}>"


def _links(r: random.Random, texts: list[str], n: int) -> list[str]:
    pick = lambda: r.choice(_SHORT) if r.random() < 0.4 else " ".join(r.choice(texts).split()[: r.randint(1, 7)])
    return [f'<a href="/{i}">{html.escape(pick())}</a>' for i in range(n)]


def _some(r: random.Random, texts: list[str], most: int) -> str:
    words = r.choice(texts).split()
    lo = r.randrange(max(1, len(words) - 2))
    return html.escape(" ".join(words[lo : lo + r.randint(2, most)]))


def _wrapped(r: random.Random, inner: str, named: float) -> str:
    for _ in range(r.randint(0, 2)):
        inner = _tag(r, "div", inner, None, "content", named)
    return inner


def layout(r: random.Random, texts: list[str], article: list[str]) -> str:
    """A page whose article is given as blocks; other texts are taken from texts."""
    named, semantic = r.choice([0.0, 0.5, 1.0]), r.random() < 0.6
    el = lambda tag, other="div": tag if semantic or r.random() < 0.2 else other
    menu = lambda: _tag(r, el("nav"), "<ul>" + "".join(f"<li>{x}</li>" for x in _links(r, texts, r.randint(3, 12))) + "</ul>" if r.random() < 0.7 else " | ".join(_links(r, texts, r.randint(3, 9))), 0, "menu", named)
    advert = lambda: _tag(r, r.choice(["div", "div", "p", "section", "aside"]), _some(r, texts, 14) if r.random() < 0.7 else _links(r, texts, 1)[0], 0, "ad", max(named, 0.8))
    notice = lambda: _tag(r, "div", f"<p>{r.choice(_SAID) if r.random() < 0.6 else _some(r, texts, 20)}</p>" + r.choice(["", "<button>OK</button>", "<a href='#'>More</a>"]), 0, "notice", max(named, 0.8))
    form = lambda: _tag(r, "form", f"<label>{_some(r, texts, 4)}</label><input type='text'><button>{r.choice(_SAID)}</button>", 0, "form", named)

    def comments() -> str:
        one = lambda: _tag(r, r.choice(["div", "li", "section", "article"]), f"<p>{_some(r, texts, 3)}</p><p>{_some(r, texts, 60)}</p>", None, "comment", named)
        return _tag(r, r.choice(["section", "div", "ol", "div"]), f"<h3>{r.choice(['Comments', 'Discussion', '3 replies', 'Kommentare'])}</h3>" + "".join(one() for _ in range(r.randint(1, 6))), 0, "comment", max(named, 0.8))

    def side() -> str:
        inside = [f"<h3>{_some(r, texts, 4)}</h3>", "<ul>" + "".join(f"<li>{x}</li>" for x in _links(r, texts, r.randint(2, 8))) + "</ul>", f"<p>{_some(r, texts, 40)}</p>", advert()]
        return _tag(r, el("aside"), "".join(r.sample(inside, r.randint(1, 3))), 0, "side", max(named, 0.6))

    blocks = []
    for i, text in enumerate(article):
        words = html.escape(text).split(" ")
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(words))
            words[k] = r.choice(["<b>{}</b>", "<i>{}</i>", '<a href="/z">{}</a>', "<em>{}</em>"]).format(words[k])
        tag = "h1" if i == 0 and r.random() < 0.7 else r.choice(["p", "p", "p", "p", "p", "h2", "div", "blockquote", "li"])
        inner = f"<li>{' '.join(words)}</li>" if tag == "li" else " ".join(words)
        blocks.append(f"<{'ul' if tag == 'li' else tag}>{inner}</{'ul' if tag == 'li' else tag}>" if r.random() < 0.85 or tag != "p" else f"<p>{inner}")
    for make, chance in ((advert, 0.35), (side, 0.12), (form, 0.08), (notice, 0.1), (comments, 0.1)):
        if r.random() < chance:
            blocks.insert(r.randint(1, len(blocks)), make())
    body = _tag(r, el("article", r.choice(["div", "section", "main"])), "".join(blocks), 1, "content", named)
    head = _tag(r, el("header"), f"<p>{_some(r, texts, 5)}</p>" + (menu() if r.random() < 0.5 else ""), 0, "head", max(named, 0.5))
    foot = _tag(r, el("footer"), f"&copy; {_some(r, texts, 12)}" + (" ".join(_links(r, texts, 3)) if r.random() < 0.5 else ""), 0, "foot", max(named, 0.5))
    before = [make() for make, chance in ((lambda: head, 0.7), (menu, 0.7), (notice, 0.4), (advert, 0.5), (form, 0.2), (side, 0.2)) if r.random() < chance]
    after = [make() for make, chance in ((side, 0.4), (comments, 0.5), (advert, 0.4), (form, 0.3), (menu, 0.2), (notice, 0.2)) if r.random() < chance]
    r.shuffle(after)
    return f"<html><head><title>{_some(r, texts, 5)}</title></head><body>" + _wrapped(r, "".join(before) + _wrapped(r, body, named) + "".join(after), named) + (foot if r.random() < 0.8 else "") + "</body></html>"
