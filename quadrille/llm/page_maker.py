"""Made web pages with known articles, to train and test the extraction of main text."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

#: Marks article text in training pages; it is no letter, space or punctuation, and counts as one character.
MARK = "⁣"
_PARTS = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que tion ment ei ch ung ci do os la mi".split()
MENU = [("nav", ""), ("div", "nav"), ("div", "menu main-menu"), ("ul", "navbar"), ("div", "breadcrumb"), ("header", "site-header"), ("div", "topbar"), ("nav", "site-nav"), ("div", "navigation"), ("div", "toolbar"), ("ul", "pagination"), ("div", "pager"), ("div", "share-links"), ("div", "tags"), ("div", "skip-links"), ("div", "social")]
SIDE = [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "right-rail"), ("div", "widget"), ("section", "related-posts"), ("div", "recommended"), ("div", "side-column"), ("div", "more-stories"), ("div", "teaser-list"), ("div", "related"), ("section", "widget-area")]
ADS = [("div", "ad"), ("div", "advert"), ("div", "ads-box"), ("aside", "sponsored"), ("div", "banner"), ("ins", "adsbygoogle"), ("div", "promo"), ("section", "advertisement"), ("div", "sponsor"), ("div", "promotion"), ("div", "outbrain")]
NOTICES = [("div", "cookie-notice"), ("div", "notice"), ("section", "alert"), ("div", "gdpr-consent"), ("dialog", "popup"), ("div", "subscribe-banner"), ("div", "modal"), ("div", "overlay"), ("div", "cookies"), ("div", "legal-notice"), ("div", "consent")]
FORMS = [("form", ""), ("form", "newsletter"), ("form", "search-form"), ("div", "login"), ("div", "signup"), ("div", "subscribe"), ("div", "search"), ("section", "contact-form")]
COMMENTS = [("section", "comments"), ("div", "comment-list"), ("div", "disqus"), ("ol", "commentlist"), ("section", "discussion"), ("div", "replies"), ("div", "responses"), ("section", "reader-comments"), ("ul", "comment-thread")]
FOOT = [("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright"), ("div", "page-footer"), ("div", "legal"), ("div", "foot")]
HEAD = [("header", ""), ("div", "header"), ("header", "masthead"), ("div", "site-head"), ("div", "page-header"), ("div", "logo")]
BODY = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", "post"), ("div", ""), ("div", "text"), ("section", ""), ("main", "main-content"), ("div", "page-content"), ("div", "news"), ("div", "blog-post"), ("td", ""), ("div", "prose")]


class Maker:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.plain = rng.random() < 0.08  # a page whose classes say nothing
        self.bare = rng.random() < 0.12  # the article has no element of its own
        # Parts amid the article always have classes, as nothing else tells them from its paragraphs.
        self.named = self.bare

    def word(self) -> str:
        return "".join(self.r.choice(_PARTS) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self, noisy: bool = False) -> str:
        ws = [self.word() for _ in range(max(1, int(self.r.gauss(10, 6))))]
        ws = [w + ("," if self.r.random() < 0.1 else "") + (self.r.choice(("***", "###", "$$$", "&amp;&amp;&amp;", "%%%")) if noisy else "") for w in ws]
        return (" ".join(ws)).capitalize() + self.r.choice("....!?")

    def element(self, kind: tuple[str, str], inner: str) -> str:
        tag, name = kind
        if not self.named and (self.plain or self.r.random() < 0.05):
            name = self.r.choice(("", f"c{self.r.randrange(99)}"))
        attr = f' {self.r.choice(("class", "class", "class", "id"))}="{name}"' if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(self.r.choice((1, 1, 2, 3)))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def text(self, n: int) -> str:
        return " ".join(self.sentence() for _ in range(n))

    def wrapped(self, s: str) -> str:
        return f"<p>{s}</p>" if self.r.random() < 0.5 else s

    def menu(self) -> str:
        return self.element(self.r.choice(MENU), self.links(self.r.randrange(2, 9)))

    def ad(self) -> str:
        return self.element(self.r.choice(ADS), self.wrapped(self.text(self.r.randrange(1, 4)) + (f' <a href="/x">{self.words(2)}</a>' if self.r.random() < 0.4 else "")))

    def side(self) -> str:
        inner = (f"<h3>{self.words(2)}</h3>" if self.r.random() < 0.7 else "") + (self.links(self.r.randrange(3, 8)) if self.r.random() < 0.6 else self.wrapped(self.text(self.r.randrange(1, 4))))
        return self.element(self.r.choice(SIDE), inner)

    def notice(self) -> str:
        return self.element(self.r.choice(NOTICES), self.wrapped(self.text(self.r.randrange(1, 4))) + (f"<button>{self.word()}</button>" if self.r.random() < 0.5 else ""))

    def form(self) -> str:
        return self.element(self.r.choice(FORMS), f"<label>{self.words(2)}</label><input type=text>{self.wrapped(self.text(1)) if self.r.random() < 0.5 else ''}<button>{self.word()}</button>")

    def comments(self) -> str:
        one = lambda: f'<{t}{c}><b>{self.word()}</b> {self.wrapped(self.text(self.r.randrange(1, 5)))}</{t}>'
        t, c = self.r.choice((("div", ' class="comment"'), ("li", ""), ("article", ' class="comment"'), ("div", "")))
        if self.plain:
            c = ""
        return self.element(self.r.choice(COMMENTS), (f"<h2>{self.words(2)}</h2>" if self.r.random() < 0.6 else "") + "".join(one() for _ in range(self.r.randrange(1, 6))))

    def foot(self) -> str:
        return self.element(self.r.choice(FOOT), self.wrapped(f"&copy; {self.word()}.example.com &middot; {self.text(self.r.choice((1, 1, 2)))}") + (self.links(3) if self.r.random() < 0.4 else ""))

    def head(self) -> str:
        return self.element(self.r.choice(HEAD), self.wrapped(self.words(3)) + (self.links(4) if self.r.random() < 0.5 else ""))

    def article(self) -> str:
        noisy = self.r.random() < 0.1
        shout = self.r.random() < 0.05
        mark = lambda s: MARK + (s.upper() if shout else s)
        n = self.r.choice((0, 1, 1, 1, 1, 1, 2, 2, 3, 4, 6, 9, 15, 25))
        blocks = []
        # How this page writes a paragraph: mostly as one, else as an unnamed block or as bare text.
        para = self.r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<div>{}</div>", "<section>{}</section>", "{}<br><br>"))
        if self.r.random() < 0.85:
            title = mark(" ".join(self.word() for _ in range(self.r.randrange(1, 9))).capitalize())
            blocks.append(f"<h1>{title}</h1>" if self.r.random() < 0.9 else f"<h2>{title}</h2>")
        elif n == 0:
            n = 1
        for _ in range(n):
            kind = self.r.random()
            s = mark(" ".join(self.sentence(noisy) for _ in range(self.r.choice((1, 1, 1, 2, 3, 4, 6, 9)))))
            if kind < 0.72:
                blocks.append(para.format(s) if self.r.random() < 0.95 else f"<p>{s}")
            elif kind < 0.78 or (n == 1 and kind < 0.84):
                blocks.append(f"<p><b>{s}<br>")
            elif kind < 0.82:
                blocks.append(f"<h2>{mark(self.words(3))}</h2>")
            elif kind < 0.87:
                tag = self.r.choice(("ul", "ol"))
                blocks.append(f"<{tag}>" + "".join(f"<li>{mark(self.words(self.r.randrange(2, 12)))}</li>" for _ in range(self.r.randrange(2, 6))) + f"</{tag}>")
            elif kind < 0.9:
                blocks.append(f"<blockquote><p>{s}</p></blockquote>")
            elif kind < 0.93:
                blocks.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark(self.words(2))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.95:
                blocks.append(f"<pre>{s}</pre>")
            elif kind < 0.97:
                blocks.append(f"<figure><img src=x><figcaption>{mark(self.words(6))}</figcaption></figure>")
            elif kind < 0.98:
                tag = self.r.choice(("button", "math", "label", "svg"))
                blocks.append(para.format(f"{s} <{tag}>{mark(self.word())}</{tag}> {mark(self.words(5))}"))
            else:
                blocks.append(f"<p>{s} <a href='/y'>{mark(self.words(2))}</a> {mark(self.words(4))}</p>")
        for make, chance in ((self.ad, 0.2), (self.form, 0.1), (self.side, 0.1), (self.notice, 0.1)):
            if blocks and self.r.random() < chance:
                self.named = True
                blocks.insert(self.r.randrange(1, len(blocks) + 1), make())
                self.named = self.bare
        inner = "".join(blocks)
        if self.r.random() < 0.2:
            inner = f'<div class="{self.r.choice(("inner", "body", "text", "wrap", "col"))}">{inner}</div>'
        if self.r.random() < 0.12:
            inner += self.comments()
        kind = self.r.choice(BODY) if self.r.random() < 0.7 else ("article", "")
        if kind[0] == "td":
            side = f"<td>{self.links(4)}</td>" if self.r.random() < 0.6 else ""
            return f"<table><tr>{side}<td>{inner}</td></tr></table>"
        return inner if self.bare else self.element(kind, inner)

    def page(self) -> str:
        r = self.r
        before = [f() for f, c in ((self.notice, 0.25), (self.head, 0.35), (self.menu, 0.8), (self.ad, 0.5), (self.menu, 0.15), (self.form, 0.15), (self.side, 0.15)) if r.random() < c]
        after = [f() for f, c in ((self.side, 0.35), (self.ad, 0.3), (self.comments, 0.3), (self.form, 0.2), (self.side, 0.15), (self.foot, 0.85), (self.notice, 0.1)) if r.random() < c]
        if r.random() < 0.3:
            r.shuffle(before)
        script = '<script>var t="</p>";track(1);</script>' if r.random() < 0.5 else ""
        article = self.article() if r.random() < 0.97 else ""
        body = "".join(before) + "<!-- x -->" * (r.random() < 0.3) + article + script + "".join(after)
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body = f'<div class="{r.choice(("wrap", "container", "page", "site", "row", "layout"))}">{body}</div>'
        end = "</body></html>" if r.random() < 0.7 else ""
        return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(4)}</title><style>p{{margin:0}}</style></head><body>{body}{end}'


def pages(n: int, seed: int) -> Iterator[tuple[str, Callable[[str], bool]]]:
    """Pages, and what tells of a text in one whether it belongs to the article."""
    for i in range(n):
        yield Maker(random.Random(seed * 1_000_003 + i)).page(), lambda text: MARK in text
