"""Generated pages whose blocks' labels are known, and the training of the block labeller on them.

Run ``python -m notelake.llm.html_train`` to fit and store the weights anew.
"""

from __future__ import annotations

import random

from .html_blocks import Block, blocks
from .html_model import BiLstm, train

_MARK = "⁣"  # put before every text of the article and taken off again after parsing

_SYLLABLES = "an be co da en fi ga he in jo ka li mo ne or pa qui ra se ti un ve wo xa yi zo th sch ué ón ß lla tion ing er es".split()


class _Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(400)]

    def prose(self, lo: int, hi: int) -> str:
        out, left = [], self.r.randint(lo, hi)
        while left > 0:
            n = min(left, self.r.randint(3, 14))
            words = [self.r.choice(self.words) for _ in range(n)]
            out.append(" ".join(words).capitalize() + self.r.choice(".....?!"))
            left -= n
        return " ".join(out)

    def few(self, lo: int = 1, hi: int = 3) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(lo, hi))).title()

    def name(self, *options: str) -> str:
        """A class or id attribute, now and then absent or with other words beside it."""
        word = self.r.choice(options)
        extra = self.r.choice(["", "", f" {self.r.choice(self.words)}", f" col-{self.r.randint(1, 12)}", " clearfix"])
        return self.r.choice([f' class="{word}{extra}"', f' id="{word}"', f' class="{self.r.choice(["site", "page", "main", "block", "c"])}-{word}"'])

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{k}">{self.few()}</a>' for k in range(self.r.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.r.random() < 0.7 else self.r.choice([" | ", " ", " / "]).join(items)

    # What is not the article.

    def menu(self) -> str:
        inner = self.links(2, 10)
        return self.r.choice([f"<nav>{inner}</nav>", f"<nav{self.name('nav', 'menu')}>{inner}</nav>", f"<div{self.name('nav', 'menu', 'navbar', 'breadcrumb', 'navigation', 'topbar')}>{inner}</div>"])

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.few()}</h1><p>{self.prose(3, 8)}</p>", f"<a href='/'>{self.few()}</a>", f"<div>{self.few()}</div>"]) + (self.menu() if self.r.random() < 0.5 else "")
        return self.r.choice([f"<header>{inner}</header>", f"<div{self.name('header', 'masthead', 'banner')}>{inner}</div>"])

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.few()}.example.com &middot; {self.prose(4, 20)}", f"<p>Copyright {self.r.randint(1999, 2026)} {self.few()}</p>" + self.links(1, 6), f"<p>{self.prose(4, 20)}</p>", self.prose(5, 40)])
        return self.r.choice([f"<footer>{inner}</footer>", f"<footer{self.name('footer')}>{inner}</footer>", f"<div{self.name('footer', 'copyright', 'legal', 'colophon')}>{inner}</div>"])

    def advert(self) -> str:
        inner = self.r.choice([self.prose(4, 40), f"<p>{self.prose(4, 30)}</p>", f"Advertisement <a href='/x'>{self.prose(2, 10)}</a>"])
        return f"<div{self.name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'sponsor', 'banner')}>{inner}</div>" if self.r.random() < 0.85 else f"<aside{self.name('ad', 'promo')}>{inner}</aside>"

    def sidebar(self) -> str:
        inner = "".join(f"<h3>{self.few()}</h3>" + self.r.choice([self.links(2, 7), f"<p>{self.prose(5, 40)}</p>"]) for _ in range(self.r.randint(1, 3)))
        return self.r.choice([f"<aside>{inner}</aside>", f"<aside{self.name('sidebar')}>{inner}</aside>", f"<div{self.name('sidebar', 'widget', 'related', 'recommended', 'rail', 'popular', 'trending')}>{inner}</div>"])

    def notice(self) -> str:
        inner = self.r.choice([f"<p>{self.prose(4, 30)}</p><button>{self.few(1, 2)}</button>", f"We use cookies. {self.prose(3, 20)} <a href='/p'>{self.few()}</a>", self.prose(5, 30)])
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'aside']))}{self.name('notice', 'cookie', 'consent', 'alert', 'popup', 'modal', 'overlay', 'newsletter', 'subscribe', 'gdpr')}>{inner}</{t}>"

    def form(self) -> str:
        inner = f"<label>{self.few()}</label><input name='q'>" + self.r.choice(["", f"<p>{self.prose(4, 20)}</p>", f"<select><option>{self.few()}</option><option>{self.few()}</option></select>", f"<textarea>{self.few()}</textarea>"]) + f"<button>{self.few(1, 1)}</button>"
        return f"<form{self.r.choice(['', self.name('search', 'login', 'signup', 'contact')])}>{inner}</form>"

    def comments(self) -> str:
        tag = self.r.choice(["div", "li", "article", "div"])
        inner = "".join(f"<{tag}{self.name('comment', 'reply')}>" + self.r.choice([f"<b>{self.few()}</b> ", f"<p>{self.few()}</p>", f"<cite>{self.few()}</cite>"]) + f"<p>{self.prose(4, 60)}</p></{tag}>" for _ in range(self.r.randint(1, 5)))
        head = self.r.choice(["", f"<h2>{self.few()}</h2>", "<h3>Comments</h3>"])
        return f"<{(t := self.r.choice(['section', 'div', 'ol' if tag == 'li' else 'div']))}{self.name('comments', 'comment-list', 'respond', 'discussion', 'replies')}>{head}{inner}</{t}>"

    def share(self) -> str:
        return f"<div{self.name('share', 'social', 'tags', 'meta', 'pagination', 'toolbar')}>{self.links(2, 5)}</div>"

    # The article.

    def mark(self, text: str) -> str:
        return _MARK + text

    def paragraph(self) -> str:
        text = self.prose(1, 90) if self.r.random() < 0.8 else self.r.choice([" | ", " "]).join(self.few(1, 1) for _ in range(self.r.randint(1, 30)))
        if self.r.random() < 0.2:
            words = text.split(" ")
            k = self.r.randrange(len(words))
            words[k] = self.r.choice([f"<a href='/z'>{words[k]}</a>", f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", f"{words[k]} &amp; {words[k]}"])
            text = " ".join(words)
        text = self.mark(text)
        return self.r.choices([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p{self.name('lead', 'text', 'p')}>{text}</p>", f"<div>{text}</div>"], [10, 2, 2, 1, 1])[0]

    def body(self) -> str:
        out = []
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = self.r.random()
            if kind < 0.8:
                out.append(self.paragraph())
            elif kind < 0.86:
                out.append(f"<h{(h := self.r.randint(2, 4))}>{self.mark(self.few(1, 6))}</h{h}>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(f"<li>{self.mark(self.prose(1, 20))}</li>" for _ in range(self.r.randint(1, 6))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote><p>{self.mark(self.prose(3, 40))}</p></blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.mark(self.few())}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<pre>{self.mark(self.prose(3, 20))}</pre>")
            if self.r.random() < 0.06:
                out.append(self.r.choice([self.advert, self.share, self.notice, self.form])())
        return "".join(out)

    def article(self) -> str:
        head = self.r.choices([f"<h1>{self.mark(self.prose(2, 12))}</h1>", f"<h1>{self.mark(self.few(1, 8))}</h1>", "", f"<h2>{self.mark(self.few(1, 8))}</h2>"], [6, 3, 1, 1])[0]
        inner = head + (self.share() if self.r.random() < 0.1 else "") + self.body() + (self.comments() if self.r.random() < 0.08 else "")
        kind = self.r.random()
        if kind < 0.5:
            return f"<article{self.r.choice(['', '', self.name('post', 'entry', 'article', 'story')])}>{inner}</article>"
        if kind < 0.65:
            return f"<main>{inner}</main>"
        if kind < 0.72:
            return f"<main><article><div{self.name('content', 'entry-content')}>{inner}</div></article></main>"
        return f"<div{self.name('content', 'post', 'entry', 'article', 'story', 'text', 'body', 'post-body', 'main', 'entry-content')}>{inner}</div>"

    def page(self) -> str:
        before = [f for f, p in ((self.notice, 0.15), (self.header, 0.35), (self.menu, 0.75), (self.advert, 0.5), (self.form, 0.1), (self.sidebar, 0.15)) if self.r.random() < p]
        after = [f for f, p in ((self.share, 0.15), (self.sidebar, 0.3), (self.advert, 0.2), (self.comments, 0.3), (self.form, 0.15), (self.notice, 0.1), (self.menu, 0.1), (self.footer, 0.85)) if self.r.random() < p]
        if self.r.random() < 0.3:
            self.r.shuffle(before)
        parts = [f() for f in before] + ([self.article()] if self.r.random() < 0.97 else []) + [f() for f in after]
        for _ in range(self.r.choice([0, 0, 0, 0, 0, 1, 1, 2, 4, self.r.randint(5, 30)])):
            parts = [f"<div{self.name('wrapper', 'container', 'page', 'layout', 'row', 'inner')}>", *parts, "</div>"]
        head = f"<head><meta charset='utf-8'><title>{self.few(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html lang='en'>{head}<body>{'<!-- ad -->'.join(parts)}</body></html>"


def examples(count: int, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """Pages as blocks and, for each, whether it belongs to the article."""
    out = []
    for k in range(count):
        found, labels = [], []
        for b in blocks(_Writer(seed * 1_000_003 + k).page()):
            own = _MARK in b.text
            text = " ".join(b.text.replace(_MARK, "").split())
            if text:
                found.append(Block(b.path, text, min(b.linked, len(text))))
                labels.append(int(own))
        out.append((found, labels))
    return out


def fit(pages: int = 4800, epochs: int = 12) -> BiLstm:
    return train(examples(pages), epochs)


if __name__ == "__main__":
    fit().save()
