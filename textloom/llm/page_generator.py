"""Generated web pages of many layouts, with the blocks of their article marked."""

from __future__ import annotations

import random
from html import escape

_SYLLABLES = "an en er in on re th st ou la de que ción os as ra do ch ung keit sch ge be ver ti ly nd wh or ea at it es le is tre eau oi aux ment ño ar ez".split()
_MENU = "Home News Sport World Business Login Register About Contact Shop Blog Archive Start Startseite Kontakt Impressum Accueil Inicio Contacto Acerca Privacy Terms Help FAQ Jobs More".split()
_NAMES = {
    "content": "content article post entry story main body text article-body post-content entry-content story-body page-content articleBody content-main maincontent".split(),
    "menu": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs menubar site-nav toolbar links".split(),
    "header": "header masthead top site-header branding banner page-header logo head".split(),
    "side": "sidebar side aside widget rail right-col left-col secondary related-posts related recommended popular trending".split(),
    "footer": "footer bottom site-footer foot copyright legal page-footer colophon".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense partner ad-slot".split(),
    "notice": "cookie cookie-notice consent notice gdpr alert banner subscribe paywall newsletter popup modal".split(),
    "comments": "comments comment-list commentlist comment respond discussion replies disqus reader-comments user-comments".split(),
    "share": "share social sharing tags meta byline author post-meta share-bar tools date".split(),
}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.marks, self.out = rng, {}, []
        self.plain = rng.random() < 0.12  # names that say nothing
        self.vocabulary = ["".join(rng.choices(_SYLLABLES, k=rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(150)]

    def words(self, n: int) -> str:
        return " ".join(self.rng.choices(self.vocabulary, k=n))

    def sentences(self, n: int) -> str:
        out = []
        for _ in range(n):
            words = self.words(self.rng.randint(2, 16)).split()
            if len(words) > 6 and self.rng.random() < 0.5:
                words[self.rng.randrange(2, len(words) - 2)] += ","
            out.append(" ".join(words).capitalize() + self.rng.choice("....?!"))
        return self.odd(" ".join(out)) if self.rng.random() < 0.12 else " ".join(out)

    def odd(self, text: str) -> str:
        """Text that is no prose: shouting, rows of cells, repeated words, figures, addresses, code, notes of rights."""
        words, rng = text.split(), self.rng
        kind = rng.randrange(8)
        if kind == 0:
            return "!! ".join(text.upper().split())
        if kind == 1:
            return rng.choice([" | ", " ; ", " / ", ", "]).join(words[:12]).capitalize()
        if kind == 2:
            return " ".join(w for w in words[:8] for _ in range(rng.randint(2, 6)))
        if kind == 3:
            return " ".join(str(rng.randrange(10**rng.randint(1, 9))) if rng.random() < 0.5 else w for w in words[:20])
        if kind == 4:
            return text + f" +1 ({rng.randrange(999)}) 555-{rng.randrange(9999)} {words[0]}@mail.example.com"
        if kind == 5:
            return f"{words[0]}={rng.randrange(16**12):x}; {' '.join(words[:6])} {{ return {words[-1]} }}"
        if kind == 6:
            return rng.choice(["This work is licensed under the", "All rights reserved by", "Permission is hereby granted to"]) + " " + text
        return words[0]

    def name(self, kind: str) -> str:
        if self.plain or self.rng.random() < 0.1:
            x = "".join(self.rng.choices("abcdefghijklmnop", k=4))
        else:
            x = self.rng.choice(_NAMES[kind])
        return self.rng.choice([f' class="{x}"', f' id="{x}"', f" class='{x} c{self.rng.randrange(9)}'", f' class="{x}"'])

    def attr(self, kind: str, share: float = 0.8) -> str:
        return self.name(kind) if self.rng.random() < share else ""

    def put(self, x: str) -> None:
        self.out.append(x)
        if self.rng.random() < 0.3:
            self.out.append(self.rng.choice(["\n", "\n  ", " "]))

    def block(self, tag: str, text: str, mark: int, attributes: str = "", close: bool = True) -> None:
        """A block of text; what is in no article is marked 0, also if an article says the same."""
        text = " ".join(text.split())
        if not text:
            return
        self.marks[text] = min(self.marks.get(text, 1), mark)
        shown, words = escape(text, quote=self.rng.random() < 0.3), text.split()
        if len(words) > 5 and self.rng.random() < 0.25:
            i = self.rng.randrange(len(words) - 2)
            inner = self.rng.choice(["b", "i", "em", "strong", "a", "span"])
            parts = [escape(w, quote=False) for w in words]
            parts[i] = f"<{inner}" + (' href="/x"' if inner == "a" else "") + f">{parts[i]}"
            parts[i + 1] += f"</{inner}>"
            shown = " ".join(parts)
        if tag == "p" and self.rng.random() < 0.1:
            shown, close = "<b>" + shown + "<br>", False
        self.put(f"<{tag}{attributes}>{shown}" + (f"</{tag}>" if close else ""))

    def links(self, n: int, wrap: str = "ul") -> None:
        self.put(f"<{wrap}>")
        for _ in range(n):
            text = self.rng.choice([self.rng.choice(_MENU), self.words(1).capitalize(), self.words(self.rng.randint(1, 4)), self.words(1)])
            self.marks[text] = 0
            if wrap in ("ul", "ol"):
                self.put(f'<li><a href="/{text}">{text}</a>' + ("</li>" if self.rng.random() < 0.9 else ""))
            else:
                self.put(f'<p><a href="/{text}">{text}</a></p>')
        self.put(f"</{wrap}>")

    def menu(self) -> None:
        tag = self.rng.choice(["nav", "nav", "div", "header"])
        self.put(f"<{tag}{self.attr('menu', 0.5 if tag == 'nav' else 1)}>")
        self.links(self.rng.randint(2, 9), self.rng.choice(["ul", "ul", "ol", "div"]))
        self.put(f"</{tag}>")

    def header(self) -> None:
        tag = self.rng.choice(["header", "div"])
        self.put(f"<{tag}{self.attr('header', 0.4 if tag == 'header' else 1)}>")
        self.block(self.rng.choice(["h1", "h2", "p", "div"]), self.words(self.rng.randint(1, 4)).title(), 0)
        if self.rng.random() < 0.5:
            self.block("p", self.sentences(1), 0)
        if self.rng.random() < 0.4:
            self.form()
        self.put(f"</{tag}>")

    def form(self) -> None:
        self.put(f"<form{self.attr('notice', 0.3)}>")
        self.block("label", self.words(2), 0)
        if self.rng.random() < 0.5:
            self.block("p", self.rng.choice(["Subscribe to our newsletter", "Sign up now", "Leave a reply", "Search the site", "Enter your e-mail"]) + " " + self.words(self.rng.randint(0, 6)) + ".", 0)
        self.put('<input type="text" value="q">')
        self.block("button", self.rng.choice(["Search", "Submit", "Send", "Subscribe", "Go"]), 0)
        self.put("</form>")

    def ad(self) -> None:
        tag = self.rng.choice(["div", "div", "aside", "section"])
        self.put(f"<!-- ad {self.rng.randrange(99)} -->" if self.rng.random() < 0.5 else "")
        text = self.sentences(self.rng.randint(1, 3))
        if self.rng.random() < 0.6:
            self.block(tag, text, 0, self.name("ad"))
        else:
            self.put(f"<{tag}{self.name('ad')}>")
            self.block("p", text, 0)
            self.put(f"</{tag}>")

    def notice(self) -> None:
        tag = self.rng.choice(["div", "section", "aside"])
        self.put(f"<{tag}{self.name('notice')}>")
        self.block("p", self.rng.choice(["We use cookies to improve your experience.", "This site uses cookies.", "Please accept our terms.", "Subscribe to read more.", ""]) + " " + self.sentences(self.rng.randint(1, 2)), 0)
        if self.rng.random() < 0.5:
            self.block("button", self.rng.choice(["Accept", "OK", "Close", "Agree"]), 0)
        self.put(f"</{tag}>")

    def side(self) -> None:
        tag = self.rng.choice(["aside", "div", "section"])
        self.put(f"<{tag}{self.attr('side', 0.4 if tag == 'aside' else 1)}>")
        self.block(self.rng.choice(["h3", "h4", "h2"]), self.words(self.rng.randint(1, 3)).capitalize(), 0)
        if self.rng.random() < 0.7:
            self.links(self.rng.randint(2, 6), self.rng.choice(["ul", "div"]))
        else:
            for _ in range(self.rng.randint(1, 3)):
                self.block("p", self.sentences(self.rng.randint(1, 3)), 0)
        self.put(f"</{tag}>")

    def comments(self) -> None:
        tag = self.rng.choice(["section", "div", "ol", "ul", "aside"])
        self.put(f"<{tag}{self.name('comments')}>")
        inner = "li" if tag in ("ol", "ul") else self.rng.choice(["div", "article", "p"])
        if inner != "li":
            self.block(self.rng.choice(["h2", "h3"]), self.rng.choice(["Comments", "Reader comments", "3 Comments", "Discussion", "Kommentare", "Comentarios", "Commentaires"]), 0)
        for _ in range(self.rng.randint(1, 6)):
            if inner == "p":
                self.block("p", self.sentences(self.rng.randint(1, 5)), 0)
                continue
            self.put(f"<{inner}{self.attr('comments', 0.6)}>")
            if self.rng.random() < 0.6:
                self.block(self.rng.choice(["cite", "span", "div", "strong"]), self.words(1).capitalize() + self.rng.choice([" says:", " wrote:", "", " 12:04"]) + ".", 0)
            self.block(self.rng.choice(["p", "p", "div"]), self.sentences(self.rng.randint(1, 5)), 0)
            self.put(f"</{inner}>")
        if self.rng.random() < 0.5:
            self.form()
        self.put(f"</{tag}>")

    def footer(self) -> None:
        tag = self.rng.choice(["footer", "footer", "div"])
        self.put(f"<{tag}{self.attr('footer', 0.4 if tag == 'footer' else 1)}>")
        if self.rng.random() < 0.5:
            self.links(self.rng.randint(1, 5))
        text = self.rng.choice(["© 2024 ", "© ", "Copyright ", ""]) + self.words(2) + self.rng.choice([" · ", " ", " | "]) + self.sentences(self.rng.randint(1, 2))
        if self.rng.random() < 0.5:
            self.block("p", text, 0)
        else:
            self.marks[text] = 0
            self.put(escape(text))
        self.put(f"</{tag}>")

    def share(self) -> None:
        self.block(self.rng.choice(["div", "p", "ul", "span"]) if self.rng.random() < 0.5 else "div", self.rng.choice([f"By {self.words(2).title()}", "Share this article", "Tags: " + self.words(3), "Posted on 3 May 2021", "Read more: " + self.words(4)]), 0, self.name("share"))

    def article(self) -> None:
        rng = self.rng
        kind = rng.random()
        if kind < 0.45:
            opening, closing = f"<article{self.attr('content', 0.4)}>", "</article>"
        elif kind < 0.6:
            opening, closing = f"<main{self.attr('content', 0.4)}>", "</main>"
        elif kind < 0.92:
            tag = rng.choice(["div", "div", "section", "td"])
            opening, closing = f"<{tag}{self.name('content')}>", f"</{tag}>"
        else:
            opening = closing = ""
        if rng.random() < 0.2:
            opening, closing = f"<div{self.attr('content')}>" + opening, closing + "</div>"
        self.put(opening)
        first = self.sentences(rng.randint(1, 2))
        if rng.random() < 0.85:
            wrap = rng.random() < 0.15
            self.put("<header>" if wrap else "")
            self.block(rng.choice(["h1", "h1", "h2"]), first[: rng.randint(8, 70)], 1)
            if rng.random() < 0.35:
                self.share()
            self.put("</header>" if wrap else "")
        if rng.random() < 0.15:
            self.share()
        body = rng.choice(["p", "p", "p", "div"])
        n = rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14, 25])
        for i in range(n):
            x = rng.random()
            if x < 0.8:
                self.block(body, first if i == 0 and rng.random() < 0.4 else self.sentences(rng.choice([1, 1, 2, 3, 5, 9, 15])), 1, close=rng.random() < 0.9)
            elif x < 0.86:
                self.block(rng.choice(["h2", "h3"]), self.words(rng.randint(1, 6)).capitalize(), 1)
            elif x < 0.9:
                self.put("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.block("li", self.sentences(1), 1)
                self.put("</ul>")
            elif x < 0.94:
                self.block(rng.choice(["blockquote", "pre"]), self.sentences(rng.randint(1, 3)), 1)
            elif x < 0.97:
                self.ad()
            else:
                self.side() if rng.random() < 0.5 else self.share()
        if rng.random() < 0.2:
            self.share()
        if rng.random() < 0.15:
            self.comments()
        self.put(closing)

    def make(self) -> str:
        rng = self.rng
        parts = []
        for step, share in ((self.notice, 0.25), (self.header, 0.35), (self.menu, 0.8), (self.ad, 0.45), (self.side, 0.2)):
            if rng.random() < share:
                parts.append(step)
        if rng.random() < 0.3:
            rng.shuffle(parts)
        if rng.random() < 0.96:
            parts.append(self.article)
        for step, share in ((self.ad, 0.15), (self.comments, 0.35), (self.side, 0.35), (self.form, 0.15), (self.notice, 0.1), (self.menu, 0.1), (self.footer, 0.85)):
            if rng.random() < share:
                parts.append(step)
        title = self.words(4)
        self.put(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
        wrap = rng.random() < 0.25
        self.put('<div class="wrapper">' if wrap else "")
        for p in parts:
            p()
        self.put("</div>" if wrap else "")
        self.put("</body></html>" if rng.random() < 0.9 else "")
        return "".join(self.out)


def page(rng: random.Random) -> tuple[str, dict[str, int]]:
    """HTML, and for the text of each block whether it belongs to the article (1) or not (0)."""
    p = _Page(rng)
    return p.make(), p.marks
