"""Labelled pages, made by rule.

Elements carry ``data-main``: 1 around main text, 0 around what does not belong to it.  Layouts are composed of parts under
names that are customary for them; text is filler.  They stand in for pages labelled by people, which
``html_text.train`` takes in the same form.
"""

from __future__ import annotations

import random

# Filler words, and customary class names of the parts of pages.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur"
).split()
NAMES = {
    "main": "article article-body post post-content entry-content content main-content story story-body text body page-content entry blog-post hentry news-text article__content",
    "nav": "nav navbar menu main-menu topnav site-nav navigation breadcrumb breadcrumbs pagination pager tabs toolbar skip-links subnav dropdown",
    "header": "header site-header masthead top logo branding page-header hero topbar",
    "footer": "footer site-footer colophon copyright legal bottom footer-links imprint",
    "sidebar": "sidebar side rail widget related related-posts recommended popular most-read trending tags archive aside right-column secondary teaser",
    "ad": "ad ads advert advertisement adsbygoogle sponsored promo banner-ad ad-slot partner-content commercial",
    "notice": "cookie cookie-notice consent gdpr notice alert banner popup modal newsletter subscribe paywall overlay disclaimer privacy-notice message",
    "comments": "comments comment-list comment discussion responses replies reader-comments comment-body thread",
    "share": "share social sharing follow share-buttons social-links",
    "form": "search search-form login signup contact-form newsletter-form subscribe-form poll",
    "wrapper": "wrapper container row col grid page inner layout site outer column block box section",
}
TAGS = {
    "main": "article main div section", "nav": "nav nav ul div", "header": "header header div", "footer": "footer footer div", "sidebar": "aside aside div section",
    "ad": "div div aside section", "notice": "div div section aside dialog", "comments": "section div ol ul", "share": "div ul", "form": "form", "wrapper": "div div section",
}


class Maker:
    """Pages of one random source.  ``names`` are the class names in use, so that others can be kept for testing."""

    def __init__(self, seed: int, names: dict[str, list[str]] | None = None):
        self.r = random.Random(seed)
        self.names = names or {k: v.split() for k, v in NAMES.items()}
        self.coded = False  # names of this page say nothing

    def sentence(self, low: int = 5, high: int = 22) -> str:
        words = [self.r.choice(FILLER) for _ in range(self.r.randint(low, high))]
        inner = "".join(w + (", " if self.r.random() < 0.08 else " ") for w in words).strip(" ,")
        return inner[:1].upper() + inner[1:] + self.r.choice("....?!")

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def words(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.r.choice(FILLER) for _ in range(self.r.randint(low, high))).capitalize()

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.choice(FILLER)}">{text}</a>'

    def part(self, role: str, inner: str, main: bool | None = False, plain: float = 0.1) -> str:
        """An element for ``role``; now and then without any name that tells."""
        tag = self.r.choice(TAGS[role].split())
        word = f"c{self.r.randrange(16**6):06x}" if self.coded and plain else self.r.choice(self.names[role])
        name = f'{self.r.choice(("class", "class", "id"))}="{word}"' if self.r.random() >= plain else ""
        if tag in ("nav", "article", "main", "header", "footer", "aside", "form") and self.r.random() < 0.5:
            name = ""
        mark = "" if main is None else f'data-main="{int(main)}"'
        return f"<{' '.join(filter(None, (tag, name, mark)))}>{inner}</{tag}>"

    def listed(self, low: int = 3, high: int = 9, text=None) -> str:
        return "<ul>" + "".join(f"<li>{self.link((text or self.words)())}</li>" for _ in range(self.r.randint(low, high))) + "</ul>"

    def nav(self) -> str:
        inner = self.listed() if self.r.random() < 0.7 else " | ".join(self.link(self.words(1, 2)) for _ in range(self.r.randint(2, 7)))
        return self.part("nav", inner)

    def header(self) -> str:
        return self.part("header", self.r.choice(("<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "<h2>{}</h2>")).format(self.words(1, 5)) + self.r.choice(("", self.listed(2, 6), f"<p>{self.words(2, 6)}</p>")))

    def footer(self) -> str:
        inner = [f"&copy; {self.r.randint(1999, 2030)} {self.words(1, 3)}. {self.sentence()}", self.listed(2, 6), f"<p>{self.prose(1, 2)}</p>", f"&copy; {self.words(1, 2)} &middot; {self.sentence()}"]
        return self.part("footer", "".join(self.r.sample(inner, self.r.randint(1, 2))))

    def sidebar(self) -> str:
        teasers = "".join(f"<div><h3>{self.link(self.words(3, 8))}</h3><p>{self.sentence()}</p></div>" for _ in range(self.r.randint(1, 4)))
        return self.part("sidebar", f"<{(h := self.r.choice(('h2', 'h3', 'h4')))}>{self.words(1, 3)}</{h}>" + self.r.choice((self.listed(), teasers, f"<p>{self.prose(1, 3)}</p>")))

    def ad(self) -> str:
        return self.part("ad", self.r.choice((self.sentence(), f"<p>{self.sentence()}</p>", self.link(self.sentence()), f"<p>{self.prose(1, 3)}</p>{self.link(self.words())}")), plain=0.0)

    def notice(self) -> str:
        return self.part("notice", f"<p>{self.prose(1, 3)}</p>" + self.r.choice(("", "<button>{}</button>".format(self.words(1, 2)), self.link(self.words(1, 2)))), plain=0.0)

    def form(self) -> str:
        field = f'<label>{self.words(1, 2)}</label><input type="text"><button>{self.words(1, 2)}</button>'
        return self.part("form", self.r.choice(("", f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.sentence()}</p>")) + field * self.r.randint(1, 2))

    def share(self) -> str:
        return self.part("share", self.r.choice((self.listed(2, 5, lambda: self.words(1, 1)), " ".join(self.link(self.words(1, 2)) for _ in range(3)))), plain=0.0)

    def comments(self) -> str:
        one = lambda: f'<{(t := self.r.choice(("div", "li", "article")))} class="{self.r.choice(self.names["comments"])}"><b>{self.words(1, 2)}</b><p>{self.prose(1, 3)}</p></{t}>'
        return self.part("comments", self.r.choice(("", f"<h3>{self.words(1, 3)}</h3>")) + "".join(one() for _ in range(self.r.randint(1, 5))), plain=0.0)

    def body(self, inside: bool) -> str:
        """Main text, with foreign parts in between if ``inside``."""
        r, out = self.r, []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 20))):
            x = r.random()
            if x < 0.08:  # short, unfinished or dull
                out.append(f"<p>{r.choice((self.words(1, 2), self.words(1, 2) + '.', self.words(1, 1) * 20, (self.words(1, 1) + ' ') * r.randint(5, 200)))}</p>")
            elif x < 0.68:
                out.append(f"<p>{self.prose()}</p>" if r.random() < 0.9 else f"<p>{self.prose(1, 2)} {self.link(self.words())} {self.prose(1, 2)}")
            elif x < 0.78:
                out.append(f"<h2>{self.words(2, 7)}</h2>")
            elif x < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.sentence(3, 12)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.88:
                out.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif x < 0.92:
                out.append(f'<figure><img src="x"><figcaption>{self.sentence()}</figcaption></figure>')
            elif x < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{self.words()}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                out.append(f"<pre>{self.words(3, 12)}</pre>" if r.random() < 0.5 else f"<div>{self.prose()}</div>")
            if inside and r.random() < 0.12:
                out.append(r.choice((self.ad, self.ad, self.share, self.form, self.notice, self.sidebar))())
        return "".join(out)

    def main(self) -> str:
        r, title = self.r, f"<h1>{self.r.choice((self.words(2, 10), self.words(1, 2), self.sentence()))}</h1>"
        by = r.choice(("", "", f'<p class="byline">{self.words(2, 3)}</p>', f"<div>{self.words(2, 4)}</div>"))
        head = title + by if r.random() < 0.8 else f"<header>{title}{by}</header>"
        inner = (head if r.random() < 0.85 else "") + self.body(True)
        if r.random() < 0.25:
            inner = (head if r.random() < 0.5 else "") + self.part("main", self.body(True), None)
        if r.random() < 0.3:
            inner += r.choice((self.share, self.comments, self.sidebar, self.nav))()
        if r.random() < 0.12:  # a table for the layout
            return f'<table><tr><td data-main="0">{self.listed()}</td><td data-main="1">{inner}</td></tr></table>'
        return self.part("main", inner, True, plain=0.25)

    def page(self) -> str:
        r = self.r
        self.coded = r.random() < 0.25
        if r.random() < 0.06:  # nothing but the text
            return r.choice((f'<body><div data-main="1">{self.body(False)}</div></body>', f'<div data-main="1">{self.prose()}</div>'))
        often = lambda p, f: f() if r.random() < p else ""
        top = often(0.6, self.header) + often(0.75, self.nav) + often(0.25, self.notice) + often(0.2, self.form) + often(0.35, self.ad)
        middle = often(0.25, self.sidebar) + self.main() + often(0.35, self.sidebar) + often(0.15, self.ad) + often(0.25, self.comments)
        for _ in range(r.randint(0, 3)):
            middle = self.part("wrapper", middle, None, plain=0.3)
        bottom = often(0.2, self.nav) + often(0.85, self.footer) + often(0.15, self.notice)
        whole = top + middle + bottom
        if r.random() < 0.2:
            whole = self.part("wrapper", whole, None)
        return f"<!DOCTYPE html><html><head><title>{self.words()}</title><script>x()</script></head><body>{whole}</body></html>"


def labelled_pages(n: int = 1000, seed: int = 7) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
