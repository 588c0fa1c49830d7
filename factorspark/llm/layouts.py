"""Rendered pages with known answers: the texts of sampled pages in layouts drawn at random.

A table of pages may come from one template; a model that has seen only that would learn its tags by heart. So texts of
the sample are laid out anew, with elements, class names, nesting and order drawn at random, and with menus, adverts,
forms, notices, side columns, footers and readers' comments around and inside the article. Text of the article begins
with ``MARK``.
"""

from __future__ import annotations

import html
import random

MARK = "\ue000"
# Usual names of page parts.
ARTICLE = "article post entry content main story body text blog news page-content entry-content post-body article-body article-content main-content post-content richtext".split()
LAYOUT = "wrapper container page row col grid inner outer site layout section block box wrap root app center clearfix".split()
NAMES = {
    "nav": "nav menu navbar topnav navigation breadcrumb breadcrumbs tabs main-menu site-nav nav-links toc pagination pager".split(),
    "header": "header masthead site-header top brand logo site-title branding page-header topbar".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer credits foot".split(),
    "side": "sidebar side aside widget rail related recommended trending popular more-stories read-next widget-area archive tags".split(),
    "notice": "cookie cookie-banner consent notice gdpr alert modal popup overlay disclaimer message warning privacy".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor banner ad-slot ad-box adsense promotion".split(),
    "form": "form search newsletter subscribe signup login search-box contact-form register".split(),
    "comments": "comments comment comment-list replies discussion responses user-comments comments-area respond thread".split(),
    "share": "share social share-bar follow toolbar tools actions meta-links buttons".split(),
}
TAGS = {
    "nav": ("nav", "div", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "notice": ("div", "section", "aside", "p"),
    "ad": ("div", "aside", "section", "p"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul"),
}
INLINE = ("b", "i", "em", "strong", "span", "code")


class Layout:
    def __init__(self, texts: list[str], words: list[str], rng: random.Random):
        self.texts, self.words, self.rng = texts, words, rng

    def pick(self, *shares: float) -> int:
        return self.rng.choices(range(len(shares)), shares)[0]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def prose(self, most: int = 120) -> str:
        """A few successive words of a sampled text; now and then very few."""
        words = self.rng.choice(self.texts).split()
        size = self.rng.choice((1, 3, 12, 40, most, most))
        at = self.rng.randrange(max(1, len(words) - size + 1))
        return " ".join(words[at : at + size]) or self.some(1, 4)

    def named(self, kind: str | None, missing: float = 0.25) -> str:
        """Attributes with a name of the kind, a name without meaning, or none."""
        names = NAMES.get(kind, ARTICLE if kind == "article" else LAYOUT)
        if self.rng.random() < missing:
            return self.rng.choice(("", "", f' class="c{self.rng.randrange(99)}"', f' id="x{self.rng.randrange(999)}"', f' class="{self.rng.choice(LAYOUT)}"'))
        name = self.rng.choice(names)
        if self.rng.random() < 0.3:
            name = self.rng.choice((f"{name} {self.rng.choice(LAYOUT)}", f"{name}-{self.rng.choice(LAYOUT)}", f"js-{name}", f"{name}_{self.rng.randrange(9)}", name.title().replace("-", "")))
        return f' {self.rng.choice(("class", "class", "id"))}="{name}"'

    def link(self, text: str | None = None, mark: str = "") -> str:
        return f'<a href="/{self.rng.randrange(9999)}">{mark}{html.escape(text or self.some(1, 3))}</a>'

    def links(self) -> str:
        made = [self.link(self.some(1, self.rng.choice((1, 2, 8)))) for _ in range(self.rng.randint(2, 10))]
        shape = self.pick(5, 1, 1, 1)
        if shape == 0:
            return f"<ul>{''.join(f'<li>{x}</li>' for x in made)}</ul>"
        return (" | ", " ", "</p><p>")[shape - 1].join(made) if shape < 3 else "".join(f"<p>{x}</p>" for x in made)

    def article_text(self, text: str) -> str:
        """Escaped text of the article, some words in inline elements or links."""
        words = text.split()
        if len(words) > 6 and self.rng.random() < 0.35:
            a = self.rng.randrange(len(words) - 3)
            b = a + self.rng.randint(1, 3)
            inner = html.escape(" ".join(words[a:b]))
            tag = self.rng.choice((*INLINE, "a", "a"))
            inner = f'<a href="/{a}">{MARK}{inner}</a>' if tag == "a" else f"<{tag}>{MARK}{inner}</{tag}>"
            return f"{MARK}{html.escape(' '.join(words[:a]))} {inner} {MARK}{html.escape(' '.join(words[b:]))}"
        return MARK + html.escape(text)

    def article_block(self) -> str:
        rng, shape = self.rng, self.pick(12, 2, 1, 1.5, 1, 0.7, 0.7, 0.5, 0.7)
        if shape == 0:
            return f"<p>{self.article_text(self.prose())}</p>"
        if shape == 1:
            tag = rng.choice(("h2", "h3", "h4"))
            return f"<{tag}>{MARK}{html.escape(self.some(1, 8))}</{tag}>"
        if shape == 2:
            return f"<div{self.named(None, 0.7)}>{self.article_text(self.prose())}</div>"
        if shape == 3:
            tag = rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.article_text(self.prose(20))}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        if shape == 4:
            return f"<blockquote><p>{self.article_text(self.prose())}</p></blockquote>"
        if shape == 5:
            rows = "".join("<tr>" + "".join(f"<td>{MARK}{html.escape(self.some(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4)))
            return f"<table>{rows}</table>"
        if shape == 6:
            return f'<figure><img src="a.png"><figcaption>{self.article_text(self.prose(15))}</figcaption></figure>'
        if shape == 7:
            return f"<pre>{MARK}{html.escape(self.prose(30))}</pre>"
        return f"<p><b>{self.article_text(self.prose())}<br>"  # left open, as found in the wild

    def comments(self) -> str:
        item = self.rng.choice(("li", "div", "article", "div"))
        made = []
        for _ in range(self.rng.randint(1, 5)):
            who = self.rng.choice((f"<span>{self.some(1, 2)}</span>", f"<b>{self.some(1, 2)}</b>", self.link(), f"<cite>{self.some(1, 2)}</cite>"))
            when = self.rng.choice(("", f"<time>{self.rng.randint(1, 28)} {self.rng.randint(2001, 2025)}</time>", f"<span>{self.rng.randint(1, 59)}:{self.rng.randint(10, 59)}</span>"))
            said = "".join(f"<p>{html.escape(self.prose(60))}</p>" for _ in range(self.rng.choice((1, 1, 2))))
            reply = self.rng.choice(("", self.link(), f"<button>{self.some(1, 1)}</button>"))
            made.append(f"<{item}{self.named('comments', 0.3)}>{self.rng.choice((who + when, f'<div>{who}{when}</div>', f'<p>{who} {when}</p>'))}{said}{reply}</{item}>")
        return self.rng.choice(("", f"<h3>{self.rng.randint(1, 40)} {self.some(1, 1)}</h3>", f"<h2>{self.some(1, 2)}</h2>")) + "".join(made)

    def other(self, kind: str) -> str:
        """A part of the page that is not the article."""
        rng = self.rng
        inner = {
            "nav": lambda: self.links(),
            "header": lambda: rng.choice((f"<h1>{self.link()}</h1>", f"<div>{self.some(1, 3)}</div>", f"<p>{self.some(2, 8)}</p>", f"<span>{self.some(1, 3)}</span>")) + rng.choice(("", self.links(), self.other("nav"))),
            "footer": lambda: rng.choice((f"&copy; {rng.randint(1999, 2026)} {self.some(1, 12)}", f"<p>&copy; {self.some(2, 30)}</p>", f"&copy; {self.some(1, 2)} &middot; {html.escape(self.prose(20))}", f"<p>{html.escape(self.prose(40))}</p>")) + rng.choice(("", self.links())),
            "side": lambda: "".join(rng.choice((f"<h3>{self.some(1, 3)}</h3>", f"<h4>{self.some(1, 2)}</h4>", "")) + rng.choice((self.links(), f"<p>{html.escape(self.prose(25))} {self.link()}</p>", f"<p>{html.escape(self.prose(30))}</p>")) for _ in range(rng.randint(1, 3))),
            "notice": lambda: rng.choice((f"<p>{html.escape(self.prose(30))}</p>", html.escape(self.prose(30)))) + rng.choice(("", f"<button>{self.some(1, 2)}</button>", self.link())),
            "ad": lambda: rng.choice((html.escape(self.prose(20)), self.link(self.some(2, 9)), f"<p>{html.escape(self.prose(20))}</p>", f"<span>{self.some(1, 2)}</span>{self.link()}")),
            "form": lambda: rng.choice((f"<h3>{self.some(1, 4)}</h3>", f"<p>{self.some(3, 15)}</p>", "")) + f"<label>{self.some(1, 2)}</label><input name=q>" + rng.choice(("", f"<select><option>{self.some(1, 1)}<option>{self.some(1, 1)}</select>", "<textarea></textarea>")) + f"<button>{self.some(1, 2)}</button>",
            "comments": lambda: self.comments() + rng.choice(("", self.other("form"))),
            "share": lambda: " ".join(self.link(self.some(1, 1)) for _ in range(rng.randint(2, 5))),
        }[kind]()
        tag = rng.choice(TAGS[kind])
        inner = f"<li>{inner}</li>" if tag in ("ul", "ol") and not inner.startswith("<li") else inner
        # A part that looks like the article is told by its name or element only, so it always has one.
        missing = 0.0 if kind in ("comments", "notice", "side", "ad") and tag in ("div", "section", "p", "ol") else 0.3
        return f"<{tag}{self.named(kind, missing)}>{inner}</{tag}>"

    def article(self) -> str:
        rng = self.rng
        blocks = [self.article_block() for _ in range(rng.choice((1, 2, 4, 8, 14)))]
        for kind in ("ad", "share", "side", "form", "notice"):
            if rng.random() < 0.15:
                blocks.insert(rng.randint(1, len(blocks)), self.other(kind))
        if rng.random() < 0.2:
            blocks.append(self.other("comments"))
        if rng.random() < 0.85:
            tag = rng.choice(("h1", "h1", "h2"))
            blocks.insert(0, f"<{tag}>{MARK}{html.escape(self.some(2, 12))}</{tag}>")
        inner = "".join(blocks)
        for k in range(rng.choice((1, 1, 2, 3))):
            tag = rng.choice(("article", "article", "main", "div", "div", "section"))
            plain = tag in ("article", "main")
            inner = f"<{tag}{self.named('article' if k < 2 else None, 0.6 if plain else 0.3)}>{inner}</{tag}>"
        return inner

    def page(self) -> str:
        rng = self.rng
        middle = [self.article()]
        for kind, share in (("side", 0.5), ("ad", 0.5), ("comments", 0.35), ("share", 0.25), ("form", 0.15)):
            if rng.random() < share:
                middle.insert(rng.randint(0, 1) if kind in ("side", "ad") else len(middle), self.other(kind))
        if rng.random() < 0.5:
            middle = [f"<div{self.named(None)}>", *middle, "</div>"]
        before = [self.other(kind) for kind, share in (("notice", 0.3), ("header", 0.6), ("nav", 0.7), ("form", 0.2), ("ad", 0.3)) if rng.random() < share]
        after = [self.other(kind) for kind, share in (("comments", 0.15), ("side", 0.2), ("ad", 0.2), ("nav", 0.2), ("footer", 0.8), ("notice", 0.25)) if rng.random() < share]
        rng.shuffle(before)
        body = "".join(before + middle + after)
        if rng.random() < 0.3:
            body = f"<div{self.named(None)}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.some(2, 6)}</title></head><body>{body}" + rng.choice(("</body></html>", ""))


def render(texts: list[str], words: list[str], count: int, seed: int) -> list[str]:
    """``count`` pages from ``texts`` (paragraphs) and ``words``; the same input gives the same pages."""
    rng = random.Random(seed)
    return [Layout(texts, words, rng).page() for _ in range(count)] if texts and words else []
