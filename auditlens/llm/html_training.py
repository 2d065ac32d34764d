"""Labelled pages for the block labeller, made from a fixed seed, and its training: `python -m auditlens.llm.html_training`.

Layouts, names of classes and words vary; what is main text is known by how a page is made. The number of pages is the bound of
the labelled sample.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from auditlens.llm.html_blocks import blocks_of, features
from auditlens.llm.labeller import fit, scores

PAGES = 4000
WEIGHTS = Path(__file__).with_name("labeller.npz")
#: Names that pages use for their parts (fixed values).
BOILER = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs mainmenu toc",
    "header": "header masthead topbar branding siteheader banner",
    "footer": "footer bottom copyright siteinfo colophon legal imprint",
    "aside": "aside sidebar side widget related recommended rail secondary",
    "notice": "notice cookie consent gdpr alert popup overlay modal newsletter subscribe paywall",
    "ad": "ad ads advert advertisement sponsored promo banner adbox sponsor adslot",
    "comments": "comments comment respond replies discussion commentlist disqus reply",
    "form": "form search login signup searchform contact",
    "share": "share social sharing follow tags meta byline pagination pager",
}
CONTENT = "content post entry article body text story maincontent main single page document prose read"
BYLINES = "byline meta author dateline info entry-meta post-meta articleheader heading"
NOISE = "row col wrap container inner clearfix box grid flex block wrapper outer group module site layout x1 css u-full"
SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "aeinorstléèàçü", "абвгдежиклмнопрст", "的一是不了人我在有他")


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        letters = self.r.choice(SCRIPTS)
        self.words = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) for _ in range(400)]

    def text(self, low: int, high: int, stops: bool = True) -> str:
        n = self.r.randint(low, high)
        out = []
        for k in range(n):
            w = self.r.choice(self.words)
            if stops and self.r.random() < 0.12:
                w += self.r.choice(".,.;!?")
            out.append(w + ("&amp;" if self.r.random() < 0.004 else ""))
        return (" ".join(out) + ("." if stops and self.r.random() < 0.8 else "")).capitalize()

    def attr(self, names: str) -> str:
        got = [self.r.choice(names.split())]
        if self.r.random() < 0.4:
            got.append(self.r.choice(NOISE.split()))
        self.r.shuffle(got)
        key = self.r.choice(("class", "class", "class", "id"))
        return f' {key}="{self.r.choice((" ", " ", "-")).join(got)}"'

    def boiler(self, kind: str) -> str:
        r = self.r
        own = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else r.choice(("div", "div", "section", "ul"))
        bare = own == kind and r.random() < 0.6
        head = f"<{own}{'' if bare else self.attr(BOILER[kind])}>"
        if own == "ul" or kind in ("nav", "share") and r.random() < 0.7:
            items = "".join(f'<li><a href="/{k}">{self.text(1, 3, False)}</a>{"</li>" if r.random() < 0.9 else ""}' for k in range(r.randint(1, 8)))
            body = items if own == "ul" else f"<ul>{items}</ul>"
        elif kind == "comments":
            body = "".join(f"<div{self.attr(BOILER['comments'])}><p>{self.text(3, 40)}</p></div>" for _ in range(r.randint(1, 5)))
        elif kind == "form":
            body = f"<label>{self.text(1, 4, False)}</label><input type=text><button>{self.text(1, 2, False)}</button>"
        else:
            body = "".join(r.choice(("<p>{}</p>", "{}", "<span>{}</span>", "<h3>{}</h3>", '<a href="/x">{}</a>')).format(self.text(1, 25)) for _ in range(r.randint(1, 3)))
        return f"{head}{body}</{own}>"

    def byline(self) -> str:
        """The head of an article, of which its title alone is main text."""
        r = self.r
        title = f"\x01<h{r.randint(1, 2)}>{self.text(2, 14)}</h1>\x02" if r.random() < 0.8 else ""
        by = "".join(r.choice(("<p{}>{}</p>", "<div{}>{}</div>", "<ul><li{}>{}</li></ul>", "<time{}>{}</time>")).format(
            self.attr(BYLINES) if r.random() < 0.6 else "", self.text(1, 8)) for _ in range(r.randint(0 if title else 1, 2)))
        own = r.choice(("<header>", "<header>", f"<header{self.attr(BYLINES)}>", f"<div{self.attr(BYLINES)}>"))
        return f"{own}{title}{by}</{own[1:].split(' ')[0].strip('>')}>"

    def paragraph(self, style: str) -> str:
        """A paragraph as the page's style writes it: bare text ended by breaks, a box of its own, or a `p`."""
        if style == "bare":
            return self.text(5, 90) + self.r.choice(("<br>", "<br><br>", "<br/><br/>", "<br />\n"))
        if style == "box":
            return f"<div{self.attr(NOISE) if self.r.random() < 0.3 else ''}>{self.text(3, 90)}</div>"
        lead = self.r.choice(("<p>", "<p>", "<p>", "<p><b>", "<p class=lead>"))
        return lead + self.text(1, 90) + self.r.choice(("</p>", "</p>", "</p>", "<br>", ""))

    def main(self) -> list[str]:
        r, out = self.r, []
        style = r.choice(("p", "p", "p", "bare", "box"))
        if r.random() < 0.85:
            out.append(f"<h1>{self.text(2, 14)}</h1>")
        for _ in range(r.choice((1, 2, 4, 8, 16, 30))):
            kind = r.random()
            if kind < 0.75:
                out.append(self.paragraph(style))
            elif kind < 0.83:
                out.append(f"<h{r.randint(2, 4)}>{self.text(1, 9, False)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.text(1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote>{self.text(5, 40)}</blockquote>")
            elif kind < 0.97:
                out.append("<table><tr>" + "".join(f"<td>{self.text(1, 5, False)}" for _ in range(r.randint(1, 6))) + "</table>")
            else:
                out.append(f"<pre>{self.text(3, 30)}</pre>")
        return out

    def cells(self, middle: str) -> str:
        """The page's middle as a cell of a layout table, with a menu or a column of remarks in those beside it."""
        r = self.r
        cell = lambda: r.choice(("<td>", "<td valign=top>", f"<td width={r.randint(100, 600)}>"))
        side = lambda: cell() + r.choice(("<br>", "", " | ")).join(
            f'<a href="/{k}">{self.text(1, 3, False)}</a>' for k in range(r.randint(2, 9))) + "</td>" if r.random() < 0.7 else (
            f"<td{self.attr(BOILER[r.choice(('nav', 'aside', 'ad'))])}>{self.text(2, 20)}</td>")
        left, right = r.choice(((side(), ""), ("", side()), (side(), side())))
        top = f"<tr>{side()}</tr>" if r.random() < 0.3 else ""
        return f"<table>{top}<tr>{left}{cell()}{middle}</td>{right}</tr></table>"

    def page(self) -> str:
        """A page; main text stands between marks that no word contains."""
        r = self.r
        put = lambda kinds, most: "".join(self.boiler(r.choice(kinds)) for _ in range(r.randint(0, most)))
        box = r.choice(("<article>", "<article>", "<article>", "<main>", f"<div{self.attr(CONTENT)}>", f"<section{self.attr(CONTENT)}>", ""))
        inner = [f"\x01{x}\x02" for x in self.main()]
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            inner.insert(r.randint(0, len(inner)), self.boiler(r.choice(("ad", "share", "aside", "notice", "form"))))
        if box and r.random() < 0.2:
            if "<h1>" in inner[0]:
                inner.pop(0)
            inner.insert(0, self.byline())
        if box and r.random() < 0.15:
            inner.append(self.boiler("comments"))
        name = box[1:].split(" ")[0].strip(">")
        around = f"<div{self.attr(NOISE)}>" if r.random() < 0.4 else ""
        middle = box + "".join(inner) + (f"</{name}>" if name else "")
        if r.random() < 0.15:
            middle = self.cells(middle)
        front, back = ["nav", "header", "notice", "ad", "aside", "form", "share"], ["footer", "comments", "aside", "nav", "ad", "share", "notice", "form"]
        return (f"<!DOCTYPE html><html><head><title>{self.text(2, 8)}</title><style>p{{}}</style><script>var a='<p>'</script></head><body>{around}"
                f"{put(front, 4)}<!-- x -->{middle}{put(back, 5)}{'</div>' if around else ''}</body></html>")


def labelled(seed: int) -> tuple[list, np.ndarray]:
    page = Maker(seed).page()
    blocks, inside, labels, clean = blocks_of(page), False, [], []
    for text, linked, path, own in blocks:
        main = inside or "\x01" in text
        inside = max(text.rfind("\x01"), -1 if not inside else 0) > text.rfind("\x02") if ("\x01" in text or "\x02" in text) else inside
        bare = text.replace("\x01", "").replace("\x02", "").strip()
        if bare:
            labels.append(main)
            clean.append((bare, linked, path, own))
    return clean, np.array(labels, np.float32)


def sample(first: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    made = [labelled(first + k) for k in range(n)]
    made = [m for m in made if m[0]]
    return features([b for b, _ in made]), [y for _, y in made]


def accuracy(model: dict[str, np.ndarray], first: int, n: int) -> float:
    x, y = sample(first, n)
    return float(np.mean(np.concatenate([(p > 0.5) == (t > 0.5) for p, t in zip(scores(model, x), y)])))


def load() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as held:
        return {k: held[k].astype(np.float32) for k in held.files}


def main() -> None:
    model = fit(*sample(0, PAGES))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in model.items()})
    print(f"held-out accuracy {accuracy(load(), 1_000_000, 500):.4f}")


if __name__ == "__main__":
    main()
