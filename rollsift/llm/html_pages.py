"""Labelled pages that the extraction model learns from.

Pages are put together from a layout, a content container and kinds of
boilerplate, with invented words; every block carries ``data-y`` as its label
and the labels are taken off before training. The lists are the names and
shapes that pages commonly use.
"""

from __future__ import annotations

import random

# Words that boilerplate without a telling name begins with.
LEADS = [
    "advertisement", "advert", "ad", "ads", "sponsored", "anzeige", "werbung", "publicité", "publicidad", "anuncio", "copyright", "impressum",
    "datenschutz", "privacy", "cookies", "cookie", "subscribe", "newsletter", "share", "tweet", "follow", "comments", "comment", "reply",
    "related", "trending", "popular", "recommended", "login", "register", "menu",
]
# How pages name their parts.
CONTENT = ["content", "main-content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "text", "body", "page-content", "single", "prose", "blog-post", "main"]
MENU = ["nav", "navbar", "menu", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip-link", "topbar", "site-nav"]
HEAD = ["header", "site-header", "masthead", "page-header", "branding", "logo", "banner", "top"]
FOOT = ["footer", "site-footer", "bottom", "copyright", "colophon", "legal", "foot"]
SIDE = ["sidebar", "side", "widget", "widgets", "aside", "related", "related-posts", "recommended", "popular", "trending", "more", "tags", "rail", "author-box", "see-also"]
ADS = ["ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "ad-slot", "dfp", "affiliate"]
NOTICE = ["cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "toast", "message-bar"]
SHARE = ["share", "social", "social-links", "sharing", "buttons", "tools", "toolbar", "meta", "byline"]
COMMENTS = ["comments", "comment", "comment-list", "disqus", "disqus_thread", "responses", "replies", "discussion", "respond", "reader-comments", "user-comments"]
FORMS = ["form", "search", "search-form", "login", "contact-form", "poll"]
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "search"}
SYLLABLES = ["the", "an", "er", "on", "re", "in", "ti", "es", "or", "ne", "ka", "mo", "lu", "sch", "ein", "que", "les", "ción", "ado", "pf", "ver", "ou"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        style = self.r.random()
        if style < 0.12:  # no punctuation, one word again and again, tables in text, shouting
            word = self.word()
            return self.r.choice([lambda: " ".join([word] * n), lambda: " ".join(self.word() for _ in range(n)), lambda: " | ".join(self.word() for _ in range(n)), lambda: "!! ".join(self.word().upper() for _ in range(n))])()
        out = " ".join(self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(n)).capitalize()
        return out + "." if self.r.random() < 0.8 else out

    def inline(self, low: int, high: int) -> str:
        tag = self.r.choice(["b", "i", "em", "strong", "span", "code", "a href='/x'", "mark", "small", "u", "sub", "abbr"])
        return f"{self.words(low, high)} <{tag}>{self.words(1, 4)}</{tag.split()[0]}> {self.words(low, high)}"

    def name(self, names: list[str]) -> str:
        key = self.r.choice(["class", "class", "id"])
        more = self.r.choice(["", "", " box", " block", " clearfix", " container", " row"]) if key == "class" else ""
        return f'{key}="{self.r.choice(names)}{more}"'

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(2, 9))]
        return self.r.choice([
            lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items),
            lambda: "".join(f"<div>{x}</div>" for x in items), lambda: "<ol>" + "".join(f"<li>{x}" for x in items) + "</ol>",
        ])()

    def prose(self) -> str:
        long = self.r.random() < 0.5
        return "".join(f"<p>{self.words(12, 60) if long else self.words(1, 10)}</p>" for _ in range(self.r.randint(1, 3)))

    def piece(self) -> str:
        """A block of the article."""
        r = self.r
        kinds = ["p"] * 9 + ["inline"] * 2 + ["h2", "h3", "ul", "ol", "quote", "pre", "table", "figure", "dl", "div", "short", "broken", "section", "links", "script", "script"]
        kind = r.choice(kinds)
        if kind == "p":
            return f"<p>{self.words(15, 90)}</p>"
        if kind == "inline":
            return f"<p>{self.inline(5, 40)}</p>"
        if kind == "script":
            return f"<p>{self.words(1, 30)}{r.choice(['<script>var a=0;</script>', '<style>p{}</style>', '<noscript>x</noscript>', '<iframe></iframe>'])}{self.words(1, 30)}</p>"
        if kind == "short":
            return f"<p>{self.words(1, 4)}</p>"
        if kind == "broken":
            return f"<p><b>{self.words(10, 40)}<br><p>{self.words(10, 40)}</p>"
        if kind in ("h2", "h3"):
            return f"<{kind}>{self.words(1, 8)}</{kind}>"
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(r.randint(2, 5))) + f"</{kind}>"
        if kind == "links":
            return f"<p>{self.words(8, 30)} <a href='/a'>{self.words(2, 8)}</a> <a href='/b'>{self.words(1, 5)}</a> {self.words(3, 20)}</p>"
        if kind == "quote":
            return f"<blockquote><p>{self.words(5, 40)}</p></blockquote>"
        if kind == "pre":
            return f"<pre><code>{self.words(5, 30)}</code></pre>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind == "figure":
            return f"<figure><img src='x.png'><figcaption>{self.words(3, 15)}</figcaption></figure>"
        if kind == "dl":
            return f"<dl><dt>{self.words(1, 3)}</dt><dd>{self.words(4, 20)}</dd></dl>"
        if kind == "section":
            return f"<section><h2>{self.words(1, 6)}</h2><p>{self.words(15, 60)}</p></section>"
        return f"<div>{self.words(10, 50)}</div>"

    def nameless(self) -> tuple[str, str]:
        """Boilerplate that no name gives away: by its first word, its links, or its place beside the article."""
        r, junk = self.r, 'data-y="0"'
        tag = r.choice(["div", "div", "p", "section", "footer", "header", "aside"])
        name = r.choice(["", "", f'class="{self.word()}"', f'id="{self.word()}-{self.word()}"'])
        told = r.random() < 0.6
        lead = r.choice([*LEADS, "©"]).capitalize() + r.choice([": ", " ", ""]) if told else ""
        inner = r.choice([self.words(1, 12), self.words(3, 30), f"<a href='/n'>{self.words(1, 4)}</a>", self.links() if tag != "p" else self.words(2, 9)])
        return ("any" if told and r.random() < 0.3 else r.choice(["top", "end", "end"])), f"<{tag} {junk} {name}>{lead}{inner}</{tag}>"

    def boilerplate(self) -> tuple[str, str]:
        """(where it usually stands, markup)"""
        r, junk = self.r, 'data-y="0"'
        kind = r.choice(["menu", "head", "foot", "side", "side", "ad", "notice", "share", "comments", "form", "form", "nameless"])
        if kind == "nameless":
            return self.nameless()
        named = r.random() < 0.7
        if kind == "menu":
            tag = r.choice(["nav", "nav", "div", "ul"]) if named else "nav"
            inner = self.links() if tag != "ul" else "".join(f"<li><a href='/m'>{self.words(1, 2)}</a></li>" for _ in range(r.randint(2, 7)))
            return "top", f"<{tag} {junk} {self.name(MENU) if tag != 'nav' or named else ''} {self.role(tag)}>{inner}</{tag}>"
        if kind == "head":
            tag = r.choice(["header", "div"]) if named else "header"
            inner = r.choice(["", f"<a href='/'>{self.words(1, 2)}</a>", f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(3, 10)}</p>"]) + r.choice(["", f"<nav>{self.links()}</nav>"])
            return "top", f"<{tag} {junk} {self.name(HEAD) if tag != 'header' or named else ''} {self.role(tag)}>{inner}</{tag}>"
        if kind == "foot":
            tag = r.choice(["footer", "div"]) if named else "footer"
            inner = r.choice(["&copy; ", ""]) + r.choice([self.words(3, 30), self.prose(), self.links()])
            return "end", f"<{tag} {junk} {self.name(FOOT) if tag != 'footer' or named else ''} {self.role(tag)}>{inner}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "div", "section"]) if named else "aside"
            inner = r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + r.choice([self.prose(), self.links(), self.words(5, 40)])
            return "any", f"<{tag} {junk} {self.name(SIDE) if tag != 'aside' or named else ''} {self.role(tag)}>{inner}</{tag}>"
        if kind == "comments":
            inner = "".join(f"<{t} {self.name(COMMENTS[:2])}>{r.choice([self.prose(), self.words(3, 50)])}</{t}>" for t in [r.choice(["div", "li", "div", "li", "div", "li", "article"])] for _ in range(r.randint(1, 4)))
            tag = r.choice(["section", "div", "ol"])
            return "end", f"<{tag} {junk} {self.name(COMMENTS)}>{r.choice(['', f'<h2>{self.words(1, 3)}</h2>'])}{inner}</{tag}>"
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><select><option>{self.word()}<option>{self.word()}</select><textarea>{self.words(1, 5)}</textarea><button>{self.words(1, 2)}</button>"
            form = f"<form {junk}>{r.choice([inner, self.prose() + inner, self.prose(), self.words(1, 12), f'<p>{self.words(1, 8)}</p>'])}</form>"
            return "any", form if not named else f"<div {junk} {self.name(FORMS)}>{form}</div>"
        names = {"ad": ADS, "notice": NOTICE, "share": SHARE}[kind]
        tag = r.choice(["div", "div", "section", "p", "ins", "span"]) if kind == "ad" else r.choice(["div", "div", "section", "dialog", "p"])
        inner = r.choice([self.words(2, 50), self.words(2, 50) if tag in ("p", "ins", "span") else self.prose(), f"<a href='/z'>{self.words(2, 10)}</a>"])
        return "any", f"<{tag} {junk} {self.name(names)}>{inner}</{tag}>"

    def role(self, tag: str) -> str:
        return f'role="{ROLES[tag]}"' if tag in ROLES and self.r.random() < 0.2 else ""

    def page(self) -> str:
        r = self.r
        parts = [self.boilerplate() for _ in range(r.choice([0, 1, 2, 3, r.randint(1, 7)]))]
        inside = [x for where, x in parts if where == "any" and r.random() < 0.4]
        top = [x for where, x in parts if where == "top"] + [x for where, x in parts if where == "any" and x not in inside and r.random() < 0.5]
        end = [x for where, x in parts if x not in inside and x not in top]
        blocks = [self.piece() for _ in range(r.choice([1, 1, 2, 3, r.randint(1, 9), r.randint(1, 14)]))]
        if r.random() < 0.7:
            title = f"<h1>{self.words(2, 9)}</h1>"
            blocks.insert(0, r.choice([title, title, f"<header>{title}</header>"]))
        for x in inside:
            blocks.insert(r.randint(0, len(blocks)), x)
        good, text = 'data-y="1"', "".join(blocks)
        shape = r.random()
        if shape < 0.35:
            article = f"<article {good} {r.choice(['', self.name(CONTENT)])}>{text}</article>"
        elif shape < 0.5:
            article = f"<main {good}>{r.choice([text, f'<article>{text}</article>', f'<div {self.name(CONTENT)}>{text}</div>'])}</main>"
        elif shape < 0.85:
            article = f"<{t} {good} {self.name(CONTENT)}>{text}</{t}>" if (t := r.choice(["div", "div", "section"])) else ""
        elif shape < 0.93:
            article = f"<div {good}>{text}</div>"
        else:
            article = f"<div {good} {self.name(CONTENT)}><div>{text}</div></div>"
        bare = r.random()
        if bare < 0.15:
            return f"<html><body {good}>{r.choice([text, text, f'<div>{text}</div>'])}</body></html>"
        if bare < 0.21:
            return f"<html {good}>{r.choice([text, self.words(2, 60)])}"
        if bare < 0.27:
            return article
        wrap = r.choice([("", ""), ("", ""), ('<div class="wrapper">', "</div>"), ('<div id="page"><div class="container">', "</div></div>")])
        return f"<html><head><title>{self.words(2, 6)}</title><script>x=1</script></head><body>{r.choice(['', '', '<script>y=2</script>'])}{''.join(top)}{wrap[0]}{article}{wrap[1]}{''.join(end)}{r.choice(['</body></html>', ''])}"


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
