"""Labelled pages for the extraction model: pages laid out at random from named parts, and pages whose markup says what they are.

A made page is a list of parts (menu, header, notice, advert, main text, sidebar, form, comments, footer) in one of many
markups.  Prose is invented from syllables, in boilerplate as in main text, so that a model can't go by its words.  Main blocks
carry a mark in their text that is cut off again once the page is read: a block's label comes from the page itself.
"""

from __future__ import annotations

import random

from tidewater.llm.dom_blocks import Block, blocks

MARK = "⁣"
#: What pages put into their parts (fixed lists): names of elements by part, and short texts of boilerplate.
MAIN = ["article", 'article class="post"', "main", 'main id="content"', 'div class="content"', 'div id="main-content"',
        'div class="article-body"', 'section class="story"', 'div class="entry-content"', 'div class="post-body text"',
        'div class="article__text"', 'section itemprop="articleBody"', 'div role="main"', "div", "section"]
PARTS = {
    "menu": ["nav", 'nav class="menu"', 'div class="nav"', 'div id="navigation"', 'div class="navbar"', 'div class="main-menu"',
             'div role="navigation"', 'div class="breadcrumbs"', 'div class="pagination"', 'div class="toc"'],
    "header": ["header", 'header class="site-header"', 'div id="header"', 'div class="masthead"', 'div class="top-bar"',
               'div role="banner"', 'div class="logo"'],
    "footer": ["footer", 'footer class="site-footer"', 'div id="footer"', 'div class="footer-links"', 'div class="copyright"',
               'div role="contentinfo"', 'div class="bottom-bar"', 'div class="legal"'],
    "sidebar": ["aside", 'aside class="sidebar"', 'div id="sidebar"', 'div class="sidebar-left"', 'div class="widget"',
                'div class="related"', 'div class="recommended"', 'section class="popular-posts"', 'div role="complementary"',
                'div class="teaser"', 'div class="newsletter"', 'div class="social-share"', 'div class="tags"'],
    "notice": ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="gdpr"', 'div class="notice"',
               'div role="alert"', 'div class="alert alert-info"', 'div class="disclaimer"', 'div class="privacy"',
               'div class="paywall"', 'section class="notification"', 'div class="popup modal"', "dialog", 'p class="notice"'],
    "advert": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="advertisement"', 'div class="sponsored"',
               'div class="sponsor"', 'div class="promo"', 'div class="ad-banner"', 'aside class="ad"', 'div class="banner"',
               'section class="promotion"', 'p class="ad"'],
    "form": ["form", 'form class="search"', 'form id="login"', 'div class="form subscribe"', 'form class="signup"',
             'form class="contact"', "fieldset"],
    "comments": ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ol class="commentlist"',
                 'div class="responses"', 'div id="discussion"', 'section class="reader-comments"', 'div class="replies"',
                 'div id="disqus"', 'div class="user-comments"'],
}
PHRASES = {
    "menu": "Home|About|News|Contact|Sport|Politics|Start|Accueil|Inicio|Startseite|Next|Previous|1|2|3|Archive|Shop|Blog",
    "header": "Daily News|My Blog|The Herald|Menu|Skip to content|Sign in|Welcome|Search|Language",
    "footer": "Copyright 2020|© 2021 Example Ltd. All rights reserved.|Imprint|Terms of use|Privacy policy|Impressum|Legal|Contact us",
    "sidebar": "Related articles|Most read|Follow us|Share this|Popular posts|Recommended|Tags|Archive|Read more|Tweet|Latest",
    "notice": "We use cookies.|Accept all|Please accept our privacy policy.|This site uses cookies to improve your experience.|"
              "JavaScript is disabled.|Subscribe to read more.|Wir verwenden Cookies.|Utilizamos cookies.|Nous utilisons des cookies.",
    "advert": "Advertisement|Buy now!|Sponsored|Special offer|Click here|Sale -50%|Anzeige|Publicidad|Publicité|Order today.",
    "form": "Name|E-mail|Password|Submit|Search|Log in|Subscribe|Send|Your message|Remember me|Country|Sign up",
    "comments": "Reply|3 comments|Leave a comment|Posted by anna|Report|Like|Great post!|I agree.|Kommentare|Comentarios|Log in to reply",
}
SYLLABLES = "an the re on st ou en la der sch ing que ción ment ão ra ti ver ge lo mi ka su ño é ü ai to be".split()


class Layouts:
    """Random labelled pages; the same seed gives the same pages."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def prose(self, low: int, high: int) -> str:
        rng, out = self.rng, []
        for i in range(rng.randint(low, high)):
            w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
            w = w.capitalize() if not i or out[-1].endswith(".") else w
            out.append(w + (rng.choice(",.") if rng.random() < 0.12 else ""))
        return " ".join(out).rstrip(",.") + rng.choice([".", ".", ".", ".", "!", "?", ""])

    def paragraph(self, plain: bool) -> str:
        """Of main text; where the page has names, now and then a phrase that is boilerplate elsewhere."""
        rng = self.rng
        if rng.random() < 0.15:
            return self.prose(1, 3)
        if not plain and rng.random() < 0.2:
            return rng.choice("|".join(PHRASES.values()).split("|"))
        text = self.prose(4, 90)
        if rng.random() < 0.15:
            text += f' <a href="/x">{self.prose(1, 4)}</a> {self.prose(2, 20)}'
        return f"<b>{text}<br>" if rng.random() < 0.1 else text

    @staticmethod
    def wrap(opening: str, inside: str) -> str:
        return f"<{opening}>{inside}</{opening.split()[0]}>"

    def boilerplate(self, kind: str) -> str:
        rng = self.rng
        opening = rng.choice(PARTS[kind])
        short = lambda: rng.choice(PHRASES[kind].split("|")) if rng.random() < 0.6 else self.prose(1, 4).rstrip(".")
        link = lambda: f'<a href="/{rng.randint(1, 99)}">{short()}</a>'
        if kind in ("menu", "sidebar", "footer", "header") and rng.random() < 0.75:
            items = [link() for _ in range(rng.randint(1, 9))]
            inside = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.6 else " ".join(items)
            if kind != "menu" and rng.random() < 0.6:
                inside = self.wrap(rng.choice(["h2", "h3", "p", "div"]), short()) + inside
        elif kind == "form":
            inside = "".join(rng.choice([f"<label>{short()}</label><input name=a>", f"<button>{short()}</button>", f"<p>{self.prose(2, 25)}</p>",
                                         f"<select><option>{short()}<option>{short()}</select>", f"<textarea>{short()}</textarea>"])
                             for _ in range(rng.randint(1, 5)))
        elif kind == "comments":
            one = rng.choice(["div", 'div class="comment"', "li", 'article class="comment"', "p", 'div class="comment-body"'])
            inside = (f"<h3>{short()}</h3>" if rng.random() < 0.7 else "") + "".join(
                self.wrap(one, (f"<b>{short()}</b> " if rng.random() < 0.5 else "") + (f"<p>{self.prose(1, 60)}</p>" if rng.random() < 0.6 else
                                                                                    self.prose(1, 60)))
                for _ in range(rng.randint(1, 6)))
        else:
            inside = " ".join(short() if rng.random() < 0.4 else self.prose(2, 30) for _ in range(rng.randint(1, 2)))
            if rng.random() < 0.4 and not opening.startswith("p "):
                inside = f"<p>{inside}</p>"
            if kind == "footer" and rng.random() < 0.6:
                inside = "&copy; " + inside
        return self.wrap(opening, inside)

    def main(self, plain: bool) -> str:
        rng = self.rng
        mark = lambda tag, text: f"<{tag}>{MARK}{text}</{tag}>"
        out = [mark("h1", self.prose(3, 10).rstrip("."))] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                out.append(mark("p", self.paragraph(plain)) if rng.random() < 0.85 else f"<p>{MARK}{self.paragraph(plain)}")
            elif kind < 0.8:
                out.append(mark(rng.choice(["h2", "h3"]), self.prose(1, 8).rstrip(".")))
            elif kind < 0.85:
                out.append(f"<{(u := rng.choice(['ul', 'ol']))}>" + "".join(mark("li", self.prose(1, 25)) for _ in range(rng.randint(1, 5))) + f"</{u}>")
            elif kind < 0.89:
                out.append("<blockquote>" + mark("p", self.prose(4, 40)) + "</blockquote>" if rng.random() < 0.5 else mark("blockquote", self.prose(4, 40)))
            elif kind < 0.91:
                out.append(mark("pre", self.prose(3, 20)))
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + mark("td", self.prose(1, 4)) + mark("td", self.prose(1, 4)) for _ in range(3)) + "</table>")
            elif kind < 0.95:
                out.append("<figure><img src=x>" + mark("figcaption", self.prose(2, 12)) + "</figure>")
            elif not plain:
                out.append(self.boilerplate(rng.choice(["advert", "advert", "sidebar", "notice", "form"])))
        return "".join(out)

    def page(self) -> str:
        """A page; in every fifth one elements have no names, and texts and tags must do."""
        rng = self.rng
        plain = rng.random() < 0.2
        some = lambda kinds, most: [self.boilerplate(rng.choice(kinds)) for _ in range(rng.randint(0, most))]
        opening = rng.choice(MAIN[:13] if not plain else MAIN)
        main = self.wrap(opening, self.main(plain) + (self.boilerplate("comments") if not plain and rng.random() < 0.15 else ""))
        if rng.random() < 0.3:
            main = self.wrap(rng.choice(["main", 'div class="container"', 'div class="wrapper"', "div", 'div id="page"']), main)
        before = some(["menu", "header", "notice", "advert", "form", "menu"], 4)
        after = some(["sidebar", "advert", "comments", "form", "notice", "comments"], 4)
        if plain:
            before, after = some(["menu"], 2), some(["footer", "menu"], 2)
        elif rng.random() < 0.8:
            after.append(self.boilerplate("footer"))
        body = "".join([*before, main, *after])
        title = f"<title>{self.prose(2, 8)}</title><style>p{{}}</style>" if rng.random() < 0.9 else ""
        end = "</body></html>" if rng.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head>{title}</head><body>{body}{end}"


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a made page with their labels; the mark is gone from texts and features."""
    marked = [MARK in b.text for b in blocks(page)]
    out = blocks(page.replace(MARK, ""))
    if len(out) != len(marked):  # a block of the mark alone
        return [], []
    return out, [int(m) for m in marked]


#: Features of open elements inside an ``article`` that are no main text.
NOT_MAIN = frozenset(["t:aside", "t:button", "t:dialog", "t:footer", "t:form", "t:menu", "t:nav", "s:adver", "s:comme", "s:sideb",
                      "n:ad", "n:ads", "s:notic", "s:cooki", "s:promo", "s:spons"])


def by_markup(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a page and labels by its ``article`` element; none of a page without one."""
    out = blocks(page)
    labels = [int("t:article" in b.around and NOT_MAIN.isdisjoint(b.around)) for b in out]
    return (out, labels) if any(labels) else ([], [])
