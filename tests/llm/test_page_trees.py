"""Operator 1 on pages with missing end tags, odd attributes, and links and ids inside an article."""

import random

import pytest

from speechspark.llm import html_text

S = "Some words of the article stand here, and more of them follow. " * 4
P, T = f"<p>{S}</p>", S.strip()
REFERENCES = "<ul>" + "".join(f"<li><a href=x{k}>Reference number {k} with a title</a></li>" for k in range(10)) + "</ul>"
LISTED = "\n".join(f"Reference number {k} with a title" for k in range(10))

PAGES = {
    "pruned paragraph, no end tag": (f"<article><p class='notice'>Note<p>{S}<p>{S}</article><p>after", f"{T}\n{T}"),
    "pruned item, no end tag": (f"<article><ul><li class=menu>Home<li>one<li>two</ul>{P}</article>", f"one\ntwo\n{T}"),
    "pruned box, ended by its parent": (f"<div><div><div class=sidebar>x<b>y</div></div>{P}</div>{P}", f"{T}\n{T}"),
    "pruned cell, no end tag": (f"<article><table><tr><td class=ad>x<td>kept<tr><td>more</table>{P}</article>", f"kept\nmore\n{T}"),
    "button around a box": (f"<article>{P}<button><div>x</button>{P}</article>", f"{T}\n{T}"),
    "end tag of a phrase inside a menu": (f"<article><span><nav>x</span><a>y</a></nav>{S}</span>{P}</article>", f"{T}\n{T}"),
    "nested menus": (f"<article><nav><nav>a</nav>b</nav>{P}</article>", T),
    "head, no end tag": (f"<html><head><title>t</title><meta charset=utf-8><p>{S}", T),
    "head, text behind it": ("<head><title>t</title> words", "words"),
    "heading and section ids": (
        f"<article><h2 id='related-work'>Related work</h2>{P}<section id=discussion><h2>D</h2>{P}</section><p id=notice>n</p></article>",
        f"Related work\n{T}\nD\n{T}\nn"),
    "comments by id": (f"<article>{P}<section id=comments>{P}</section><div id=sidebar-left>{P}</div></article>", T),
    "references of an article": (f"<article>{P * 8}<h2>References</h2>{REFERENCES}</article>", "\n".join([T] * 8) + f"\nReferences\n{LISTED}"),
    "links between paragraphs": (f"<div><h1>H</h1>{P}{REFERENCES}{P}</div>", f"H\n{T}\n{LISTED}\n{T}"),
    "apostrophe without quotes": (f"<article><p title=don't>{S}</p>{P}<p title=can't>{S}</p></article>", f"{T}\n{T}\n{T}"),
    "stray quotes": (f"<article><p class='a'\">{S}</p>{P}</article>", f"{T}\n{T}"),
    "marked word inside a title": (f"<article><p title='x class=notice id=nav'>{S}</p></article>", T),
    "sign inside quotes": (f"<article><p data-x = 'a > b' class=\"x\">{S}</p></article>", T),
}


@pytest.mark.parametrize("name", PAGES)
def test_tree(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def plain_tree(rng, depth=0):
    """(html, blocks): a random article of well-formed blocks and pruned parts, and the blocks that stay."""
    page, blocks = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["p", "h2", "quote", "list", "pruned", "open", "nest"] if depth < 3 else ["p", "h2"])
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(8, 40)))
        if kind in ("p", "h2"):
            page.append(f"<{kind}>{words}</{kind}>")
            blocks.append(words)
        elif kind == "quote":
            page.append(f"<blockquote>{words}</blockquote>")
            blocks.append(words)
        elif kind == "list":
            items = [f"{words} {k}" for k in range(rng.randint(1, 3))]
            page.append("<ul>" + "".join(f"<li>{x}" + rng.choice(["", "</li>"]) for x in items) + "</ul>")
            blocks.extend(items)
        elif kind == "pruned":
            inner, _ = plain_tree(rng, depth + 1)
            page.append(rng.choice([f"<nav>{inner}</nav>", f"<div class=sidebar>{inner}</div>", f"<aside>{inner}</aside>", f"<!--{words}-->"]))
        elif kind == "open":
            page.append(f"<p class=notice>{words}<p>{words} kept")
            blocks.append(f"{words} kept")
        else:
            inner, below = plain_tree(rng, depth + 1)
            page.append(f"<section id=discussion>{inner}</section>")
            blocks.extend(below)
    return "".join(page), blocks


@pytest.mark.parametrize("seed", range(60))
def test_random_articles(seed):
    """The blocks that a random article was made of, in order, and nothing else."""
    rng = random.Random(seed)
    page, blocks = plain_tree(rng)
    around = f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article>{page}</article><footer>f</footer></body></html>"
    assert html_text.main_text(around) == "\n".join(blocks)
