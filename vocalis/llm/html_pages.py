"""Labelled pages for training the block labeller: seeded templates with known main text.

The pages mix semantic and plain containers, closed and unclosed tags, short and long blocks. Some
name their parts in the usual ways; others name them in words of no known meaning, not at all, or wrap
all of a page in a container whose name misleads, and some lay the page out in a table. So labels follow from
ancestors, names, text and a container's share of the page together, and not from one of them.
"""

from __future__ import annotations

import random

CONTENT_NAMES = ["content", "article", "main", "post", "entry", "story", "article-body", "post-content", "entry-content", "main-content", "story-text", "page-body"]
#: Names that stand for another part than the one they hold, on what holds a whole page.
MISLEADING = ["top", "no-sidebar", "has-menu", "with-header", "cookie", "page-nav", "ad-free", "form", "bottom", "comments-open", "widget-area", "banner"]
SYLLABLES = "ba be co da di en er fa ga he in ka la lo ma ne on pa ra re sa se ta ti tion un va ver wi zo".split()


class _Maker:
    def __init__(self, seed: int, usual: bool = True):
        self.r = random.Random(seed)
        #: How this page names its parts: as usual, in unknown words, or not at all.
        self.naming = "usual" if usual else self.r.choice(["usual", "unknown", "none"])
        #: A page of nothing but its main text.
        self.lone = not usual and self.r.random() < 0.3
        self.usual = usual

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "?", "!"])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 9])))

    def tag(self, names: list[str], classes: list[str]) -> tuple[str, str]:
        name, r = self.r.choice(names), self.r.random()
        if self.naming != "usual" and classes:
            classes = [self.word()] if self.naming == "unknown" and r < 0.8 else []
        if name not in ("div", "section", "ul", "ol") and r < 0.5 or not classes:
            return f"<{name}>", f"</{name}>"
        return f'<{name} {self.r.choice(["class", "class", "id"])}="{self.r.choice(classes)}">', f"</{name}>"

    def links(self, n: int) -> str:
        item = self.r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/y'>{}</a> ", "<div><a href='/z'>{}</a></div>", "<span><a href='#'>{}</a></span> | "])
        body = "".join(item.format(self.words(1, 3)) for _ in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li>") else body

    def boxed(self, names: list[str], classes: list[str], body: str) -> tuple[str, int]:
        a, b = self.tag(names, classes)
        return a + body + b, 0

    def side(self) -> list[tuple[str, int]]:
        r, box = self.r, self.boxed
        return [
            box(["nav", "div", "ul"], ["nav", "menu", "navbar", "main-menu", "nav-links", "breadcrumb", "site-nav"], self.links(r.randint(2, 8))),
            box(["header", "div"], ["header", "site-header", "masthead", "topbar", "page-header"], f"<div>{self.words(1, 4)}</div>" + self.links(r.randint(0, 4))),
            box(["div", "aside", "ins", "div"], ["ad", "ads", "advert", "ad-box", "sponsored", "advertisement", "promo"], r.choice([self.sentence(), self.prose(), f"<p>{self.sentence()}</p>"])),
            box(["aside", "div"], ["sidebar", "side-bar", "widget", "related", "right-rail", "recommended"], f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(3), f"<p>{self.prose()}</p>"])),
            box(["div", "section", "div"], ["cookie-notice", "cookies", "notice", "banner", "consent", "alert", "popup", "gdpr"], f"<p>{self.prose()}</p><button>{self.word()}</button>"),
            box(["form", "div", "form"], ["form", "newsletter", "search", "login", "subscribe", "contact-form"], f"<label>{self.words(1, 3)}</label><input name='q'><p>{self.sentence()}</p><button>{self.word()}</button>"),
            box(["div", "ul"], ["share", "social", "share-links"], self.links(3)),
        ]

    def comments(self) -> tuple[str, int]:
        each = self.r.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li><p>{1}</p></li>", "<article class='comment'><p>{1}</p></article>", "<p>{1}</p>"])
        body = "".join(each.format(self.word(), self.prose()) for _ in range(self.r.randint(1, 5)))
        return self.boxed(["section", "div", "ol", "div"], ["comments", "comment-list", "reader-comments", "discussion", "responses", "replies"], f"<h3>{self.words(1, 2)}</h3>" + body)

    def foot(self) -> tuple[str, int]:
        return self.boxed(["footer", "div"], ["footer", "site-footer", "page-footer", "copyright", "legal"], self.r.choice(["&copy; {} &middot; {}", "<p>&copy; {}</p><p>{}</p>", "{} {}", "<p>All rights reserved {}</p>", "<div>&copy; {}</div>"]).format(self.words(1, 3), self.sentence()))

    def block(self) -> str:
        x = self.r.random()
        if x < 0.55:
            return f"<p>{self.prose()}" + self.r.choice(["</p>", "</p>", "</p>", ""])
        if x < 0.65:
            return f"<p><b>{self.sentence()}<br>"
        if x < 0.72:
            return f"<p>{self.sentence()} <a href='/k'>{self.words(1, 4)}</a> {self.sentence()}</p>"
        if x < 0.8:
            return "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(3)) + "</ul>"
        if x < 0.86:
            return f"<h2>{self.words(1, 5)}</h2>"
        if x < 0.91:
            return f"<blockquote>{self.prose()}</blockquote>"
        if x < 0.95:
            return f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>"
        return f"<div>{self.prose()}</div>"

    def page(self) -> list[tuple[str, int]]:
        """Parts of a page in order, each with its label: 1 for main text, 0 for the rest."""
        r = self.r
        parts: list[tuple[str, int]] = [("<html><head><title>" + self.words(2, 6) + "</title><style>p{}</style></head><body>", 0)]
        if not self.usual and r.random() < 0.3:
            parts.append((f"<div {r.choice(['class', 'id'])}='{r.choice(MISLEADING)}'>", 0))
        table = self.naming != "usual" and not self.lone and r.random() < 0.3
        if table:
            parts += [("<table><tr><td>", 0), (self.links(r.randint(3, 8)), 0), ("</td><td>", 0)]
        elif not self.lone:
            few = 0.45 if self.naming == "usual" else 0.3
            parts += [p for p in self.side() if r.random() < few]
        wrap = r.random() < 0.3
        if wrap:
            parts.append((f'<div class="{"container" if self.usual else r.choice(["wrapper", self.word()])}">', 0))
        plain = self.naming == "none" and r.random() < 0.4
        a, b = ("", "") if plain or table else self.tag(["article", "main", "div", "section", "article", "article"], CONTENT_NAMES)
        parts.append((a, 0))
        if r.random() < 0.8:
            parts.append((f"<h1>{self.words(1, 9)}</h1>", 1))
        for _ in range(r.choice([1, 2, 4, 8, 15])):
            parts.append((self.block(), 1))
            if r.random() < 0.06:
                parts.append(r.choice(self.side()[2:]))
            if self.lone and r.random() < 0.3:
                break
        late = not self.lone and r.random() < 0.25
        if late and r.random() < 0.7:
            parts.append(self.comments())
        parts.append((b, 0))
        if not self.lone:
            if not late and r.random() < 0.5:
                parts.append(self.comments())
            parts += [p for p in self.side()[2:] if r.random() < 0.25]
        if wrap:
            parts.append(("</div>", 0))
        if table:
            parts.append(("</td></tr></table>", 0))
        if not self.lone and r.random() < 0.85:
            parts.append(self.foot())
        if r.random() < 0.7:
            parts.append(("</body></html>", 0))
        return parts


def labelled_pages(n: int, seed: int = 1) -> list[list[tuple[str, int]]]:
    """Pages that name their parts in the usual ways."""
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]


def odd_pages(n: int, seed: int = 2) -> list[list[tuple[str, int]]]:
    """Pages with unknown, misleading or no names, of main text alone, or laid out in a table."""
    return [_Maker(seed * 1_000_003 + i, usual=False).page() for i in range(n)]
