"""Labelled pages to train the extractor on.

A seeded generator writes pages in five layouts and marks the text of the article:

``semantic``  elements that say what they hold
``named``     plain ``div`` with class names and ids
``roles``     plain ``div`` with ARIA roles
``bare``      plain ``div`` without any name: structure and text alone
``tables``    cells of a layout table, some with names

Words are invented, so the model can't learn topics.
"""

from __future__ import annotations

import random

#: Stands before text that belongs to the article; never part of a real page's text.
MARK = "\ue000"
SYLLABLES = "an er in on re te ti es or en st nd th al it ar le me so ra vi ko ña é ü ß い ка 中 ng ou".split()
LAYOUTS = ("semantic", "named", "roles", "bare", "tables")
#: Names that layouts give to their parts.
ARTICLE = "article post entry story content main-content article-body post-content entry-content text body page-body single".split()
BOXES = {
    "menu": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs tabs toc-menu pagination".split(),
    "header": "header site-header masthead topbar top-bar branding logo page-header".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot".split(),
    "side": "sidebar aside side widget widget-area right-rail rail related recommended more-stories popular trending tags".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay paywall subscribe-notice".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo banner ad-slot adbox commercial".split(),
    "form": "form search search-form newsletter signup login subscribe contact-form".split(),
    "comments": "comments comment comment-list comment-body comments-area replies reply discussion respond disqus responses reader-comments reader-responses user-comments feedback opinions thread".split(),
    "share": "share social social-share follow sharing share-buttons".split(),
}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "form": "search", "notice": "dialog", "ad": "complementary"}
HIDE = ["hidden", 'style="display:none"', 'style="display: none;"', 'aria-hidden="true"', 'class="modal" hidden']
#: Parts that a page without names can have: links, forms and short lines.
PLAIN = {"menu", "footer", "side", "share", "form"}
SHORT = {
    "notice": ["We use cookies to improve this site.", "This site uses cookies. Accept all", "Subscribe to continue reading."],
    "footer": ["© {w} {n}", "&copy; {w}.example.com &middot; {s}", "All rights reserved. {w}", "Privacy policy", "Copyright {n} {w}", "&copy; {n} {s}"],
    "form": ["Search", "Your e-mail", "Sign up", "Subscribe", "Send"],
    "share": ["Share", "Tweet", "Share on {w}", "Follow us"],
    "comments": ["{w} says:", "Reply", "{n} comments", "Leave a comment"],
    "ad": ["Advertisement", "Sponsored by {w}", "Buy {w} now!"],
}


class Writer:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 24) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        joiner = self.rng.choice([" "] * 12 + ["### ", " | ", "&amp;&amp; "])
        return joiner.join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def prose(self) -> str:
        n = self.rng.choice([1, 1, 1, 2, 3, 5, 8])
        text = " ".join(self.sentence(1, 28) for _ in range(n))
        if self.rng.random() < 0.15:
            text = text.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
        if self.rng.random() < 0.1:
            text = f"<b>{text}<br>"
        return text

    def short(self, kind: str) -> str:
        if kind in SHORT and self.rng.random() < 0.6:
            return self.rng.choice(SHORT[kind]).format(w=self.word(), n=self.rng.randint(1999, 2030), s=self.sentence(2, 12))
        return self.sentence(1, 14 if kind != "comments" else 40)

    def box(self, kind: str, layout: str, inner: str) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section", "notice": "div", "ad": "div", "share": "div"}[kind]
        name, attribute = self.rng.choice(BOXES[kind]), self.rng.choice(["class", "id"])
        if kind == "form" and layout in ("bare", "tables"):
            return f"<form>{inner}</form>"
        if layout == "bare":
            return f"<div>{inner}</div>"
        if layout == "tables":
            named = f' {attribute}="{name}"' if kind not in PLAIN or self.rng.random() < 0.5 else ""
            return f"<tr><td{named}>{inner}</td></tr>"
        if layout == "roles" and kind in ROLES:
            return f'<div role="{ROLES[kind]}">{inner}</div>'
        if layout == "semantic" and tag not in ("div", "section"):
            named = f' class="{name}"' if self.rng.random() < 0.4 else ""
            return f"<{tag}{named}>{inner}</{tag}>"
        tag = tag if tag == "section" and self.rng.random() < 0.5 else self.rng.choice(["div", "div", "section", "ul"] if kind == "menu" else ["div"])
        more = " ".join(self.word() for _ in range(self.rng.choice([0, 0, 0, 2, 12])) if attribute == "class")
        return f'<{tag} {attribute}="{f"{more} {name}".strip()}">{inner}</{tag}>'

    def hidden(self) -> str:
        """Text that no reader sees."""
        return f"<div {self.rng.choice(HIDE)}><p>{self.prose()}</p></div>"

    def filler(self, kind: str) -> str:
        if kind in ("menu", "side", "share") and self.rng.random() < 0.85:
            items = "".join(f'<li><a href="/{self.word()}">{self.sentence(1, 6)}</a></li>' for _ in range(self.rng.randint(2, 8)))
            return (f"<h3>{self.sentence(1, 3)}</h3>" if kind == "side" else "") + f"<ul>{items}</ul>"
        if kind == "form":
            return f'<p>{self.short(kind)}</p><label>{self.short(kind)}</label><input name="q"><button>{self.short(kind)}</button>'
        if kind == "comments":
            tag = self.rng.choice(["div", "div", "li", "article"])

            def one(depth: int = 0) -> str:
                answers = f"<ul>{one(depth + 1)}</ul>" if depth < 2 and self.rng.random() < 0.25 else ""
                return f'<{tag} class="{self.rng.choice(["comment", "comment-body", "reply", "c", "response"])}"><p>{self.short(kind)}</p><p>{self.prose()}</p>{answers}</{tag}>'

            return f"<h3>{self.short(kind)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 4)))
        inner = [self.short(kind) for _ in range(self.rng.randint(1, 3))]
        return inner[0] if len(inner) == 1 else "".join(f"<p>{x}</p>" for x in inner)

    def part(self, mark) -> str:
        """A part of an article."""
        r = self.rng
        kinds = {
            "p": lambda: f"<p>{mark(self.prose())}" + "</p>" * (r.random() < 0.95),
            "h2": lambda: f"<h2>{mark(self.sentence(1, 6))}</h2>",
            "ul": lambda: "<ul>" + "".join(f"<li>{mark(self.sentence(2, 12))}</li>" for _ in range(3)) + "</ul>",
            "quote": lambda: f"<blockquote><p>{mark(self.prose())}</p></blockquote>",
            "table": lambda: "<table><tr>" + "".join(f"<td>{mark(self.word())}</td>" for _ in range(4)) + "</tr></table>",
            "pre": lambda: f"<pre>{mark(self.prose())}</pre>",
            "figure": lambda: f'<figure><img src="x.jpg"><figcaption>{mark(self.sentence(2, 10))}</figcaption></figure>',
            "dl": lambda: "<dl>" + "".join(f"<dt>{mark(self.word())}<dd>{mark(self.sentence(3, 12))}" for _ in range(2)) + "</dl>",
            "svg": lambda: f"<p>{mark(self.prose())} <svg><text>{mark(self.word())}</text></svg></p>",
        }
        return kinds[r.choices(list(kinds), [80, 7, 5, 3, 2, 3, 4, 3, 1])[0]]()

    def article(self, layout: str, inside: list[str]) -> str:
        mark = lambda text: f"{MARK}{text}"
        title = f"<h1>{mark(self.sentence(2, 12))}</h1>"
        if layout == "semantic" and self.rng.random() < 0.25:
            title = f"<header>{title}</header>"
        parts = [title] if self.rng.random() < 0.9 else []
        parts += [self.part(mark) for _ in range(self.rng.choice([1, 2, 3, 5, 9, 14]))]
        if self.rng.random() < 0.12:
            inside = [*inside, self.hidden()]
        for box in inside:
            parts.insert(self.rng.randint(1, len(parts)) if self.rng.random() < 0.6 else len(parts), box)
        inner = "".join(parts)
        if layout == "semantic":
            inner = f"<article>{inner}</article>"
            return f"<main>{inner}</main>" if self.rng.random() < 0.3 else inner
        if layout == "roles":
            return f'<div role="{self.rng.choice(["main", "article"])}">{inner}</div>'
        if layout == "bare":
            return f"<div>{inner}</div>" if self.rng.random() < 0.5 else inner
        if layout == "tables":
            named = f' class="{self.rng.choice(ARTICLE)}"' if self.rng.random() < 0.5 else ""
            return f"<tr><td{named}>{inner}</td></tr>"
        for _ in range(self.rng.randint(1, 2)):
            inner = f'<div {self.rng.choice(["class", "id"])}="{self.rng.choice(ARTICLE)}">{inner}</div>'
        return inner if self.rng.random() < 0.9 else "".join(parts)

    def page(self, layout: str | None = None) -> str:
        layout = layout or self.rng.choices(LAYOUTS, [45, 30, 9, 8, 8])[0]
        inner = "named" if layout == "tables" else layout

        def chance(p: float, *kinds: str, where: str = layout) -> list[str]:
            return [self.box(k, where, self.filler(k)) for k in kinds if self.rng.random() < p and (layout != "bare" or k in PLAIN)]

        inside = chance(0.22, "ad", "share", "side", "comments", "form", "menu", where=inner)
        before = chance(0.7, "menu") + chance(0.4, "header") + chance(0.3, "notice", "ad", "form")
        after = chance(0.3, "share", "comments", "side", "ad", "form", "menu") + chance(0.1, "notice") + chance(0.8, "footer")
        self.rng.shuffle(before)
        if self.rng.random() < 0.15 and layout != "tables":  # boxes without names between the parts
            before.append(f"<div>{self.sentence(1, 4)}</div>")
        if self.rng.random() < 0.12 and layout != "tables":
            (before if self.rng.random() < 0.5 else after).append(self.hidden())
        body = f"{''.join(before)}{self.article(layout, inside)}{''.join(after)}"
        if layout == "tables":
            body = f"<table>{body}</table>"
        return f"<!DOCTYPE html><html><head><title>{self.sentence()}</title></head><body>{body}</body></html>"


def labelled_pages(count: int = 1000, seed: int = 20240101, layouts: tuple[str, ...] = ()) -> list[str]:
    """Pages whose article text is marked, of the layouts named or of all, common ones more often."""
    writer = Writer(seed)
    return [writer.page(layouts[k % len(layouts)] if layouts else None) for k in range(count)]
