"""Labelled pages to train the extraction model on: layouts drawn at random, every element marked.

The attribute ``data-y`` says whether what an element holds is main text (1) or not (0); elements without
it follow their parent. The parser reads it as a label and no feature sees it.
"""

from __future__ import annotations

import random

#: Share of pages whose main text has no container.
BARE = 0.25
_LETTERS = "etaoinshrdlucmfwypvbgk"


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_LETTERS) for _ in range(rng.randint(1, 9))) for _ in range(n))


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join(_words(rng, rng.randint(2, 16)).capitalize() + rng.choice(".....?!") for _ in range(n))


def _attr(rng: random.Random, *names: str) -> str:
    name = rng.choice([*names, ""])
    return f' {rng.choice(["class", "id"])}="{name}{rng.choice(["", "", " c" + str(rng.randint(1, 99))])}"' if name else ""


def _plain(rng: random.Random) -> str:
    """An attribute that tells nothing, or none."""
    return rng.choice(["", f' class="c{rng.randint(1, 99)}"', f' id="x{rng.randint(1, 9)}"'])


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{k}">{_words(rng, rng.randint(1, 4))}</a></li>' for k in range(n))


def _linked(rng: random.Random) -> str:
    """A paragraph that is a link, but for a few words at most."""
    return f'<p>{rng.choice(["", _words(rng, 2) + " "])}<a href="/x">{_sentences(rng, rng.randint(1, 2))}</a></p>'


def _block(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.55:
        text = _sentences(rng, rng.randint(1, 7))
        if rng.random() < 0.3:
            text = f'<b>{text}' + rng.choice(["</b>", "<br>"])
        if rng.random() < 0.2:
            text += f' <a href="/x">{_words(rng, 2)}</a> {_words(rng, 5)}.'
        return f"<p>{text}" + rng.choice(["</p>", "</p>", ""])
    if kind < 0.59:
        return _loose(rng)
    if kind < 0.62:
        return f"<ul>{_links(rng, rng.randint(2, 4))}</ul>"
    if kind < 0.65:
        return _linked(rng)
    if kind < 0.7:
        return f"<p>{_words(rng, rng.randint(1, 4))}</p>"
    if kind < 0.78:
        return f"<h{rng.randint(2, 4)}>{_words(rng, rng.randint(1, 8))}</h2>"
    if kind < 0.84:
        return "<ul>" + "".join(f"<li>{_words(rng, rng.randint(2, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
    if kind < 0.88:
        return f"<blockquote><p>{_sentences(rng, 2)}</p></blockquote>"
    if kind < 0.92:
        return f"<pre>{_words(rng, 12)}</pre>"
    if kind < 0.96:
        return "<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 3)}</td></tr>" for _ in range(3)) + "</table>"
    return f"<div>{_sentences(rng, 3)}</div>"


def _loose(rng: random.Random) -> str:
    """Text without an element of its own, in lines or not."""
    lines = [_sentences(rng, rng.randint(1, 4)) for _ in range(rng.choice([1, 1, 2, 4]))]
    text = rng.choice(["<br><br>", "<br>", " "]).join(lines)
    return rng.choice(["{}", "{}", "<font>{}</font>", "<span>{}</span>", "<b>{}</b>"]).format(text)


def _chrome(rng: random.Random, named: bool = False) -> str:
    """A piece of what is not main text; one that an element or a name tells, if so asked."""
    return rng.choice((_pieces(rng)[:-2]) if named else _pieces(rng))()


def _pieces(rng: random.Random) -> list:
    return [
        lambda: f'<nav data-y="0"{_attr(rng, "menu", "breadcrumb")}><ul>{_links(rng, rng.randint(3, 8))}</ul></nav>',
        lambda: f'<div data-y="0" class="{rng.choice(["menu", "nav", "navigation"])}"><ul>{_links(rng, rng.randint(3, 8))}</ul></div>',
        lambda: f'<div data-y="0" class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{rng.choice(["", "<p>"])}{_sentences(rng, rng.randint(1, 5))}</div>',
        lambda: f'<aside data-y="0"{_attr(rng, "sidebar", "widget")}><h3>{_words(rng, 2)}</h3><p>{_sentences(rng, rng.randint(1, 4))}</p><ul>{_links(rng, 3)}</ul></aside>',
        lambda: f'<div data-y="0" class="{rng.choice(["sidebar", "related", "widget", "recommended"])}"><p>{_sentences(rng, 2)}</p><ul>{_links(rng, 3)}</ul></div>',
        lambda: f'<div data-y="0" class="{rng.choice(["cookie", "notice", "consent", "newsletter", "popup"])}"><p>{_sentences(rng, rng.randint(1, 3))}</p></div>',
        lambda: f'<form data-y="0"{_attr(rng, "search", "login", "signup")}><p>{_words(rng, 5)}</p><label>{_words(rng, 2)}</label></form>',
        lambda: f'<div data-y="0" class="{rng.choice(["share", "social", "follow"])}"><ul>{_links(rng, 4)}</ul></div>',
        lambda: f'<{(t := rng.choice(["div", "section"]))} data-y="0"{_plain(rng)}><ul>{_links(rng, rng.randint(3, 8))}</ul></{t}>',
        lambda: f'<div data-y="0"{_plain(rng)}>' + " | ".join(f'<a href="/{k}">{_words(rng, rng.randint(1, 3))}</a>' for k in range(rng.randint(2, 6))) + "</div>",
    ]


def _comments(rng: random.Random) -> str:
    tag = rng.choice(["div", "section", "ol"])
    inner = "".join(f'<div{_attr(rng, "comment", "reply")}><p>{_sentences(rng, rng.randint(1, 4))}</p></div>' for _ in range(rng.randint(1, 4)))
    return f'<{tag} data-y="0" {rng.choice(["class", "id"])}="{rng.choice(["comments", "replies", "discussion", "comment"])}"><h3>{_words(rng, 2)}</h3>{inner}</{tag}>'


def _bare(rng: random.Random) -> str:
    """A page whose main text has no container of its own: it stands in the body, in a few wrappers that tell
    nothing, or in a cell of a table that lays the page out."""
    title = rng.choice(["", "", f"<h1>{_words(rng, rng.randint(1, 8))}</h1>", f"<b>{_words(rng, 3)}</b><br>"])
    n = rng.choice([1, 1, 2, 3, 6])
    kind = rng.random()
    text = title + (_loose(rng) if kind < 0.4 else "".join(_block(rng) if rng.random() < 0.5 else _loose(rng) + rng.choice(["<hr>", "<p>", ""]) for _ in range(n)))
    before = "".join(_chrome(rng) for _ in range(rng.choice([0, 0, 0, 1, 2])))
    after = "".join(_chrome(rng) for _ in range(rng.choice([0, 0, 1])))
    if rng.random() < 0.2:
        after += _comments(rng)
    if rng.random() < 0.3:
        after += f'<footer data-y="0">{_sentences(rng, 1)}</footer>'
    wrap = rng.choice(["{}", "{}", "{}", "<center>{}</center>", "<div>{}</div>", "<center><font>{}</font></center>", "table"])
    if wrap == "table":
        side = f'<td data-y="0"><ul>{_links(rng, rng.randint(3, 6))}</ul></td>' if rng.random() < 0.6 else ""
        return f'<html><body data-y="0">{before}<table><tr>{side}<td data-y="1">{text}</td></tr></table>{after}'
    return f'{rng.choice(["", "<html>", "<!DOCTYPE html><html><head><title>x</title></head>"])}<body data-y="1">{before}{wrap.format(text)}{after}'


def page(seed: int) -> str:
    """The labelled page of a seed."""
    rng = random.Random(seed)
    if rng.random() < BARE:
        return _bare(rng)
    out = [f"<!DOCTYPE html><html><head><title>{_words(rng, 6)}</title></head><body data-y=\"0\">"]
    if rng.random() < 0.5:
        out.append(f'<header data-y="0"{_attr(rng, "header", "masthead")}>{rng.choice(["<h1>", "<p>"])}{_words(rng, 3)}{rng.choice(["</h1>", "</p>"])}<ul>{_links(rng, 3)}</ul></header>')
    if rng.random() < 0.15:
        out.append(rng.choice([f'<a href="#c">{_words(rng, 3)}</a>', " | ".join(f'<a href="/{k}">{_words(rng, 1)}</a>' for k in range(4))]))
    out += [_chrome(rng) for _ in range(rng.randint(0, 3))]
    tag, attr = rng.choice([("article", ""), ("article", _attr(rng, "post", "entry")), ("main", ""), ("div", ' class="content"'), ("div", ' id="article"'), ("div", ' class="post-body"'), ("section", ' class="story text"'), ("div", _plain(rng)), ("section", _plain(rng)), ("article", _plain(rng))])
    title = f"<h1>{_words(rng, rng.randint(1, 12))}</h1>"
    inside = [f"<header>{title}</header>" if rng.random() < 0.2 else title] if rng.random() < 0.8 else []
    n = rng.choice([1, 2, 3, 5, 8, 12])
    inside += [_linked(rng) if n == 1 and rng.random() < 0.3 else _block(rng) for _ in range(n)]
    for _ in range(rng.choice([0, 0, 0, 1])):
        inside.insert(rng.randint(0, len(inside)), _chrome(rng, named=True))
    if rng.random() < 0.15:
        inside.append(_comments(rng))
    wrapped = rng.random() < 0.35
    out.append(("<div data-y=\"0\"" + _attr(rng, "wrapper", "page", "container") + ">" if wrapped else "") + f'<{tag} data-y="1"{attr}>' + "".join(inside) + f"</{tag}>")
    out += [_chrome(rng) for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.4:
        out.append(_comments(rng))
    out.append("</div>" if wrapped else "")
    if rng.random() < 0.8:
        out.append(rng.choice([f'<footer data-y="0">&copy; {_words(rng, 2)} {_sentences(rng, rng.randint(1, 3))}</footer>', f'<div data-y="0" class="footer"><p>{_sentences(rng, 2)}</p></div>']))
    return "".join(out) + rng.choice(["</body></html>", ""])


def pages(n: int, seed: int = 0) -> list[str]:
    return [page(seed * 1_000_003 + k) for k in range(n)]
