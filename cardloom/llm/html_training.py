"""Training of the block labeller: ``python -m cardloom.llm.html_training``.

Pages are made up from a seed: invented words in several alphabets, an article in one of many wrappings, and around or inside it menus, headers,
footers, sidebars, notices, adverts, forms and reader comments.  Which blocks belong to the article is known by construction: its words
carry a mark that is taken off again before the page is read.  The number of pages and the seed are the only parameters; a run takes about a minute.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from cardloom.llm.html_blocks import WIDTH, cut, vectors
from cardloom.llm.html_extract import WEIGHTS, lstm, pad, scores, sigmoid

HIDDEN, PAGES, EPOCHS, SEED = 16, 9000, 6, 11
MARK = ""  # a private character at the head of article blocks

# Words that pages use in class and id names.
ARTICLE_NAMES = "article content post entry story main body text page-content article-body post-content entry-content richtext prose".split()
PLAIN_NAMES = "container wrapper row col inner block section box grid item".split()
SPARE_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu toc pagination".split(),
    "header": "header masthead topbar site-header branding logo banner".split(),
    "footer": "footer site-footer copyright colophon bottom legal imprint".split(),
    "sidebar": "sidebar aside widget rail related recommended trending popular secondary tags share social".split(),
    "notice": "cookie consent notice gdpr alert banner popup modal overlay disclaimer paywall".split(),
    "advert": "ad ads advert advertisement sponsored promo promotion adsense banner-ad sponsor".split(),
    "form": "form newsletter subscribe signup login search contact".split(),
    "comments": "comments comment discussion replies responses respond comment-list disqus feedback".split(),
}
#: Headings of what is not the article, by kind.
HEADINGS = {
    "comments": ["Comments", "3 Comments", "Leave a reply", "Kommentare (2)", "Commentaires", "Comentarios", "Discussion"],
    "sidebar": ["Related", "Popular", "Recommended", "Tags", "Share this", "Mehr zum Thema", "Sur le même sujet", "Relacionado"],
    "form": ["Newsletter", "Subscribe", "Search", "Login", "Suche", "Recherche", "Buscar"],
    "notice": ["We use cookies", "Cookies", "Privacy", "Datenschutz"],
    "advert": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad"],
}
TAG_OF = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
SYLLABLES = ["the", "an", "ti", "on", "er", "in", "re", "ed", "nd", "ou", "sch", "ung", "lich", "ver", "ä", "ß", "é", "que", "tion", "eau", "ción", "ado", "ñ", "ko", "ra", "mi", "ye", "да", "но", "的", "a", "st"]


class Maker:
    """Maker of one page; ``fold`` keeps to one part of the names that pages use: ``train``, ``held`` or all."""

    def __init__(self, seed: int, fold: str = ""):
        self.r = random.Random(seed)
        part = lambda words: [w for i, w in enumerate(words) if not fold or (i % 3 == 2) == (fold == "held")]
        self.article_names, self.plain_names = part(ARTICLE_NAMES), part(PLAIN_NAMES)
        self.spare_names = {k: part(v) for k, v in SPARE_NAMES.items()}

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice([1, 1, 2, 2, 3, 4])))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        junk = self.r.choice(["", "", "", "", "%%%", "***", "&amp;&amp;", "!!"])
        return (" ".join(w + junk for w in words)).capitalize() + self.r.choice([".", ".", ".", "", "!", "?"])

    def prose(self, most: int = 6) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, self.r.randint(1, most)])))
        if self.r.random() < 0.2:
            words = text.split(" ")
            k = self.r.randrange(len(words))
            words[k] = self.r.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span class=hl>{}</span>", "{}<br>"]).format(words[k])
            text = " ".join(words)
        return text

    def opaque(self) -> str:
        """A name that tells nothing, as styling tools make them."""
        r = self.r
        own = lambda n: "".join(r.choice("abcdefghkmnpqrtvwxyz0123456789") for _ in range(n))
        return r.choice([lambda: "c-" + own(4), lambda: "css-" + own(6), lambda: "sc-" + own(6), lambda: own(2) + "_" + own(4), lambda: r.choice("abcdexyz") + str(r.randint(1, 99)), lambda: r.choice(["wrap", "page", "site", "root", "app", "top", "center", "inner", "outer", "layout"])])()

    def wrapped(self, body: str, most: int = 3) -> str:
        """``body`` in some elements that don't tell what is in them."""
        for _ in range(self.r.choice([0, 0, 1, 1, 2, most])):
            kind = self.r.random()
            names = "" if kind < 0.35 else f' {self.r.choice(["class", "id"])}="{self.opaque()}"' if kind < 0.75 else self.names(self.plain_names)
            tag = self.r.choice(["div", "div", "div", "section", "span" if "<p" not in body and "<div" not in body else "div", "center"])
            body = f"<{tag}{names}>{body}</{tag}>"
        return body

    def names(self, words: list[str]) -> str:
        if self.r.random() < 0.15:
            return ""
        chosen = [self.r.choice(words)] + ([self.r.choice(self.plain_names)] if self.r.random() < 0.3 else [])
        self.r.shuffle(chosen)
        return f' {self.r.choice(["class", "class", "class", "id"])}="{" ".join(chosen)}"'

    def links(self, n: int) -> str:
        item = self.r.choice(["<li><a href='/{0}'>{0}</a></li>", "<li><a href='/{0}'>{0}</a>", "<a href='/{0}'>{0}</a> ", "<div><a href='/{0}'>{0}</a></div>", "<p><a href='#'>{0}</a></p>"])
        items = "".join(item.format(self.r.choice([self.word, lambda: self.sentence(2, 6)])()) for _ in range(n))
        return f"<ul>{items}</ul>" if item.startswith("<li") else items

    def spare(self, kind: str) -> str:
        tag = TAG_OF.get(kind, "div") if self.r.random() < 0.6 else self.r.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
        names = self.names(self.spare_names[kind])
        plainly = TAG_OF.get(kind) == tag or kind == "menu"  # its tag, its links or its fields tell it
        if not plainly and not names:
            names = f' class="{self.r.choice(self.spare_names[kind])}"'
        if names and self.r.random() < 0.25:
            names = names.replace('="', '="' + self.r.choice(["top-", "site-", "page-", "main-", "post-", "l-", "block-", "js-"]))
        elif plainly and self.r.random() < 0.4:
            names = f' class="{self.opaque()}"'
        told = self.r.choice(HEADINGS[kind]) if kind in HEADINGS and self.r.random() < 0.6 else None
        if told and kind == "comments" and self.r.random() < 0.25:
            names = f' class="{self.opaque()}"'  # the heading alone tells it
        head = lambda low, high: told or self.sentence(low, high)
        p = lambda most=3: f"<p>{self.prose(most)}</p>"
        inner = {
            "menu": lambda: self.links(self.r.randint(3, 9)),
            "header": lambda: self.r.choice([f"<h1>{self.word()}</h1>", "", f"<span>{self.sentence(1, 4)}</span>"]) + self.links(self.r.randint(0, 5)),
            "footer": lambda: self.r.choice(["&copy; ", "", "© 2024 "]) + self.sentence() + self.r.choice(["", " &middot; " + self.sentence(), self.links(3), p()]),
            "sidebar": lambda: f"<h3>{head(1, 4)}</h3>" + self.r.choice([self.links(self.r.randint(2, 7)), p() + p()]),
            "notice": lambda: (f"<b>{told}</b> " if told else "") + self.r.choice([p(), self.prose(2)]) + self.r.choice(["", "<button>OK</button>"]),
            "advert": lambda: (f"<small>{told}</small>" if told else "") + self.r.choice([self.prose(2), p(), f"<a href='/buy'>{self.sentence()}</a>"]),
            "form": lambda: p() if "class" in names and self.r.random() < 0.25 else (f"<h4>{told}</h4>" if told else "") + f"<label>{self.word()}</label><input name=q>" + self.r.choice(["", self.prose(1)]) + f"<button>{self.word()}</button>",
            "comments": lambda: f"<h3>{told or (self.sentence(1, 3))}</h3>" + "".join(self.r.choice(["<div class='comment'>{}{}</div>", "<div>{}{}</div>", "<li>{}{}</li>", "{}{}"]).format(f"<span>{self.word()}</span>", p(4)) for _ in range(self.r.randint(1, 5))),
        }[kind]()
        return f"<{tag}{names}>{inner}</{tag}>"

    def article(self) -> str:
        r, parts = self.r, []
        title = self.sentence(2, 10)
        if r.random() < 0.85:
            parts.append(f"<h1>{MARK}{title}</h1>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.74:
                parts.append(f"<p>{MARK}{self.prose()}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.80:
                parts.append(f"<h{r.choice('23')}>{MARK}{self.sentence(1, 7)}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{MARK}{self.prose(2)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.87:
                parts.append(f"<blockquote>{MARK}{self.prose()}</blockquote>")
            elif kind < 0.89:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{self.word()}</td><td>{MARK}{self.sentence(1, 5)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.93:
                parts.append(f"<p>{MARK}<b>{title}<br>{MARK}<p>{MARK}{self.prose()}</p>")
            elif kind < 0.94:
                parts.append(f"<pre>{MARK}{self.sentence()}</pre>")
            elif kind < 0.96:
                parts.append(f"<figure{self.names(self.plain_names) if r.random() < 0.3 else ''}><img src=x><figcaption>{MARK}{self.sentence(2, 9)}</figcaption></figure>")
            else:
                parts.append(self.spare(r.choice(["advert", "sidebar", "form", "notice"])))
        if r.random() < 0.15:
            parts.append(self.spare("comments"))
        # what follows a line break inside the article's own blocks belongs to it as well
        if r.random() < 0.08:
            # paragraphs that are only set apart by line breaks
            parts = [p[3:].removesuffix("</p>") + r.choice(["<br><br>", "<br>\n<br>", "<br/>"]) if p.startswith("<p>" + MARK) and "<p>" not in p[3:] else p for p in parts]
        parts = [x.replace("<br>", "<br>" + MARK).replace("<br/>", "<br/>" + MARK) if MARK in x else x for x in parts]
        if r.random() < 0.12:
            parts.insert(1, f"<p class='{r.choice(['byline', 'meta', 'date', 'author', self.opaque()])}'>{MARK}{self.sentence(2, 5)}</p>")
        if r.random() < 0.3:
            # in sections, asides between them or inside
            cuts = sorted(r.sample(range(1, len(parts)), min(len(parts) - 1, r.randint(1, 3)))) if len(parts) > 1 else []
            tag = r.choice(["section", "section", "div"])
            groups = [parts[a:b] for a, b in zip([0, *cuts], [*cuts, len(parts)])]
            body = "".join((f"<{tag}>{''.join(g)}</{tag}>" if r.random() < 0.9 else "".join(g)) + (self.spare(r.choice(["sidebar", "advert", "form"])) if r.random() < 0.3 else "") for g in groups)
        else:
            body = "".join(parts)
        body = self.wrapped(body, 2) if r.random() < 0.25 else body
        shape = r.random()
        if shape < 0.3:
            return f"<article{self.names(self.article_names) if r.random() < 0.5 else ''}>{body}</article>"
        if shape < 0.42:
            return f"<main>{self.wrapped(body, 1)}</main>"
        if shape < 0.6:
            return f"<div class=\"{r.choice(self.article_names)}\">{body}</div>"
        # nothing tells it but what is in it
        return f"<div class='{self.opaque()}'>{body}</div>" if shape < 0.75 else f"<div id='{self.opaque()}'>{body}</div>" if shape < 0.85 else f"<div>{body}</div>" if shape < 0.92 else body

    def page(self) -> str:
        r = self.r
        before = [k for k in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.35]
        after = [k for k in ("sidebar", "comments", "advert", "form", "menu", "notice", "footer") if r.random() < (0.7 if k == "footer" else 0.3)]
        r.shuffle(before)
        if r.random() < 0.2:
            before, after = [], []
        elif r.random() < 0.2:
            before, after = [k for k in before[:1]], [k for k in after[:1]]
        title = f"<title>{self.sentence(2, 10)}</title>" if r.random() < 0.85 else ""
        head = r.choice([f'<head><meta charset="utf-8">{title}<style>p{{margin:0}}</style><script>var t="</p>";</script></head>', f"<head>{title}</head>", "" if r.random() < 0.5 else title])
        body = "".join(self.spare(k) for k in before) + r.choice(["<!-- x -->", "", "\n"]) + self.article() + "".join(self.spare(k) for k in after)
        if r.random() < 0.5:
            body = self.wrapped(body)
        return r.choice(["<!DOCTYPE html>", "<!DOCTYPE html>", ""]) + f"<html>{head}<body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def labelled(pages: int, seed: int, fold: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of the blocks of made-up pages."""
    out = []
    for k in range(pages):
        page = Maker(seed * 1_000_003 + k, fold).page()
        labels = [MARK in b.text for b in cut(page) if b.text.replace(MARK, "").strip()]
        # what is learned from is the page without marks
        out.append((vectors(cut(page.replace(MARK, ""))), np.array(labels, np.float32)))
    return out


def back_through(keep: list, grown: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of w, u, b from those of the hidden states."""
    hidden = u.shape[0]
    dh, dc = np.zeros_like(grown[0]), np.zeros_like(grown[0])
    dz_all, du = np.zeros((len(keep), grown.shape[1], 4 * hidden), np.float32), np.zeros_like(u)
    for t in range(len(keep) - 1, -1, -1):
        h, c, i, f, o, g, new, m = keep[t]
        dh = dh + grown[t]
        tanh = np.tanh(new)
        inner = m * dh
        dnew = m * dc + inner * o * (1 - tanh * tanh)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), inner * tanh * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh, dc = (1 - m) * dh + dz @ u.T, (1 - m) * dc + dnew * f
    flat = dz_all.reshape(-1, 4 * hidden)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED, hidden: int = HIDDEN, fold: str = "") -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = labelled(pages, seed, fold)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    m = {"v0": draw(hidden), "v1": draw(hidden), "c": np.zeros((), np.float32)}
    for d in "01":
        m |= {"w" + d: draw(WIDTH, 4 * hidden), "u" + d: draw(hidden, 4 * hidden), "b" + d: np.zeros(4 * hidden, np.float32)}
    mean, square = {k: np.zeros_like(x) for k, x in m.items()}, {k: np.zeros_like(x) for k, x in m.items()}
    step = 0
    for epoch in range(epochs):
        order = np.argsort([len(x) + rng.random() * 6 for x, _ in data], kind="stable")
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        rng.shuffle(batches)
        rate, loss = 0.006 * 0.6**epoch, 0.0
        for batch in batches:
            x, mask = pad([data[k][0] for k in batch])
            y = np.zeros_like(mask)
            for j, k in enumerate(batch):
                y[: len(data[k][1]), j] = data[k][1]
            keep0, keep1 = [], []
            ahead = lstm(x, mask, m["w0"], m["u0"], m["b0"], keep0)
            back = lstm(x[::-1], mask[::-1], m["w1"], m["u1"], m["b1"], keep1)[::-1]
            odds = ahead @ m["v0"] + back @ m["v1"] + m["c"]
            p = sigmoid(odds)
            d = ((p - y) * mask / mask.sum()).astype(np.float32)
            loss -= float((np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / mask.sum())
            grads = {"v0": np.einsum("tp,tph->h", d, ahead), "v1": np.einsum("tp,tph->h", d, back), "c": d.sum()}
            grads["w0"], grads["u0"], grads["b0"] = back_through(keep0, d[..., None] * m["v0"], x, m["u0"])
            grads["w1"], grads["u1"], grads["b1"] = back_through(keep1, (d[..., None] * m["v1"])[::-1], x[::-1], m["u1"])
            step += 1
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                m[k] = (m[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {loss / len(batches):.4f}", file=sys.stderr)
    return m


def accuracy(model: dict[str, np.ndarray] | None = None, pages: int = 500, seed: int = 99, fold: str = "") -> float:
    """Share of blocks of held-out pages with the right label; ``fold="held"`` for names that training on ``fold="train"`` hasn't seen."""
    data = labelled(pages, seed, fold)
    found = scores([x for x, _ in data], model)
    return float(np.concatenate([(s > 0) == (y > 0) for s, (_, y) in zip(found, data, strict=True)]).mean())


if __name__ == "__main__":
    print(f"accuracy on names that training hasn't seen {accuracy(train(fold='train'), fold='held'):.4f}")
    model = train()
    np.savez_compressed(WEIGHTS, **model)
    print(f"held-out accuracy {accuracy(model):.4f}")
