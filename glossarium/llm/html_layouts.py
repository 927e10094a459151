"""Made-up web pages whose blocks have known labels, for training the block labeller."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Phrases and names that site furniture often has.
PHRASES = {
    "menu": ["Home", "About us", "Contact", "Products", "Blog", "News", "Login", "Sign up", "Archive", "Help", "FAQ", "Shop"],
    "foot": ["© 2024 All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Contact us", "Copyright"],
    "notice": ["We use cookies to improve this site. Accept", "This site uses cookies.", "Subscribe to our newsletter", "Please enable JavaScript", "Your trial ends soon"],
    "form": ["Name", "Email", "Search", "Send", "Password", "Submit", "Subscribe", "Message"],
    "side": ["Related articles", "Most read", "Recent posts", "Categories", "Tags", "Follow us", "Share this"],
    "talk": ["Reply", "Comments", "Leave a comment", "says:", "2 hours ago", "Report", "Like"],
}
NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "main-menu"],
    "head": ["header", "masthead", "site-header", "top", "logo", "branding"],
    "foot": ["footer", "site-footer", "copyright", "bottom", "colophon", "legal"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement", "ad-slot"],
    "side": ["sidebar", "widget", "related", "aside", "share", "social", "recommended", "tags"],
    "notice": ["cookie", "notice", "alert", "newsletter", "consent", "popup", "modal", "banner-notice"],
    "talk": ["comments", "comment-list", "discussion", "replies", "respond", "comment"],
    "form": ["form", "search", "login", "subscribe", "contact-form"],
    "main": ["content", "post", "article", "entry", "story", "main", "article-body", "post-content", "text", "entry-content"],
    "plain": ["row", "col", "wrap", "container", "inner", "box", "clearfix"],
}
PARTS = "th he an in er on re st nt en ti es or ed is it al ar le se ou as de ve me ri ro ne io co te ch ei un la el qu au ción lich keit ä ö ü é è".split()


class Page:
    """Builds html and the labels of its blocks together."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.html, self.labels = rng, [], []

    def one(self, items: list[str]) -> str:
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, least: int, most: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(least), np.log(most + 1))))
        odd = self.chance(0.08) and self.one(["!!", "###", "$$$", "***"]) or ""
        out = ["".join(self.one(PARTS) for _ in range(int(self.rng.integers(1, 5)))) + odd + ("." if self.chance(0.1) else "," if self.chance(0.05) else "") for _ in range(n)]
        out[0] = out[0].capitalize()
        return " ".join(out) + self.one([".", ".", ".", "", "?"])

    def text(self, label: int, least: int, most: int, kind: str = "") -> str:
        self.labels.append(label)
        words = self.one(PHRASES[kind]) if kind and self.chance(0.55) else self.words(least, most)
        return words.replace("&", "&amp;")

    def put(self, *parts: str) -> None:
        self.html += parts

    def open(self, tags: list[str], names: str, named: float = 0.9) -> str:
        tag = self.one(tags)
        cls = f' {self.one(["class", "class", "id"])}="{self.one(NAMES[names])}{" " + self.one(NAMES["plain"]) if self.chance(0.2) else ""}"' if self.chance(named) else ""
        self.put(f"<{tag}{cls}>")
        return f"</{tag}>"

    def menu(self, label: int = 0) -> None:
        semantic = self.chance(0.6)
        end = self.open(["nav"] if semantic else ["div", "ul", "header"], "menu", 0.4 if semantic else 1)
        inner = self.chance(0.8)
        self.put("<ul>" * inner)
        for _ in range(int(self.rng.integers(2, 9))):
            self.put(f'<li><a href="/{self.one(PARTS)}">{self.text(0, 1, 2, "menu" if self.chance(0.5) else "")}</a></li>')
        self.put("</ul>" * inner, end)

    def furniture(self, kind: str) -> None:
        if kind == "menu":
            return self.menu()
        semantic = {"head": "header", "foot": "footer", "side": "aside", "ad": "aside", "form": "form"}.get(kind)
        use = semantic and self.chance(0.55 if kind != "ad" else 0.15)
        end = self.open([semantic] if use else ["div", "section"] if kind != "ad" else ["div", "div", "ins"], kind, 1 if kind in ("ad", "notice", "talk") or not use else 0.5)
        if end == "</ins>":  # an inline element: its text would join the next
            self.put("<div>")
            end = "</div></ins>"
        for _ in range(int(self.rng.integers(1, 3 if kind in ("ad", "notice", "foot", "head") else 7))):
            tag = self.one(["p", "div", "li", "h3"] if kind in ("side", "talk") else ["p", "div"])
            if kind == "talk":
                self.put(f'<div class="{self.one(NAMES["talk"])}">' if self.chance(0.5) else "<div>", f"<{tag}>", self.text(0, 3, 60, "talk" if self.chance(0.3) else ""), f"</{tag}></div>")
            elif kind == "form":
                self.put(self.one(["<label>", "<button>", "<p>"]).replace("<", "<", 1), "")
                tag = self.html.pop(-2)
                self.put(tag, self.text(0, 1, 3, "form"), tag.replace("<", "</"), '<input type="text">' * self.chance(0.5))
            elif kind in ("ad", "foot", "head", "notice") and self.chance(0.6):
                self.put(self.text(0, 2, 25, kind if kind in PHRASES and self.chance(0.4) else ""), "<br>" * self.chance(0.1), "<hr>")
            elif kind == "side" and self.chance(0.6):
                self.put(f'<{tag}><a href="#">', self.text(0, 2, 12, "side"), f"</a></{tag}>")
            else:
                self.put(f"<{tag}>", self.text(0, 2, 25, kind if kind in PHRASES else ""), f"</{tag}>")
        self.put(end)

    def prose(self) -> str:
        """A paragraph's html; it may hold links, bold runs and line breaks."""
        s = self.text(1, 1, 160)
        if self.chance(0.25):
            w = s.split(" ")
            k = int(self.rng.integers(len(w)))
            tag = self.one(["b", "i", "em", 'a href="/x"', "span", "code"])
            w[k] = f"<{tag}>{w[k]}</{tag.split()[0]}>"
            s = " ".join(w)
        return s

    def article(self) -> None:
        semantic = self.chance(0.6)
        outer = self.open(["main", "div"], "plain", 0.5) if self.chance(0.25) else ""
        end = self.open(["article", "article", "main"] if semantic else ["div", "section", "td"], "main", 0.35 if semantic else 1)
        if end == "</td>":
            self.html[-1] = "<table><tr>" + self.html[-1]
            end = "</td></tr></table>"
        if self.chance(0.85):
            h, wrap = self.one(["h1", "h1", "h2"]), self.chance(0.15)
            self.put("<header>" * wrap, f"<{h}>", self.text(1, 1, 12), f"</{h}>", "</header>" * wrap)
        for _ in range(int(np.exp(self.rng.uniform(0, np.log(22))))):
            r = self.rng.random()
            if r < 0.66:
                self.put("<p>", self.prose(), "</p>" if self.chance(0.9) else "")
            elif r < 0.74:
                self.put("<p><b>", self.text(1, 1, 60), "<br>")
            elif r < 0.79:
                h = self.one(["h2", "h3"])
                self.put(f"<{h}>", self.text(1, 1, 8), f"</{h}>")
            elif r < 0.86:
                self.put("<ul>", *[f"<li>{self.text(1, 1, 20)}</li>" for _ in range(int(self.rng.integers(1, 5)))], "</ul>")
            elif r < 0.9:
                self.put("<blockquote>", self.text(1, 3, 40), "</blockquote>")
            elif r < 0.92:
                self.put("<table>", *[f"<tr><td>{self.text(1, 1, 4)}</td><td>{self.text(1, 1, 4)}</td></tr>" for _ in range(2)], "</table>")
            elif r < 0.94:
                self.put('<figure><img src="x.png"><figcaption>', self.text(1, 2, 15), "</figcaption></figure>")
            elif r < 0.97:
                self.furniture("ad")
            else:
                self.furniture(self.one(["side", "notice", "form"]))
        self.put(end, outer)


def layouts(n: int, seed: int) -> Iterator[tuple[str, list[int]]]:
    """n pages, and for each of their blocks 1 if it is main text."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        p = Page(rng)
        p.put("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style></head><body>")
        for kind, chance in (("notice", 0.15), ("head", 0.4), ("menu", 0.8), ("form", 0.15), ("ad", 0.5), ("side", 0.15)):
            if p.chance(chance):
                p.furniture(kind)
        p.article()
        for kind, chance in (("side", 0.35), ("ad", 0.25), ("talk", 0.35), ("form", 0.2), ("menu", 0.1), ("foot", 0.85), ("notice", 0.1)):
            if p.chance(chance):
                p.furniture(kind)
        p.put("</body></html>")
        yield "".join(p.html), p.labels
