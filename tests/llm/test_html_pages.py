"""Pages set aside: templates and texts that the labelled pages do not have, block by block."""

import itertools

import pytest

from claimlens.llm import html_tree

LONG = ["The ferry left at noon with forty people on board, and the wind rose soon after that. Nobody thought of turning back. ",
        "this line has no stops and no capital letters but it goes on and on as the sea does ",
        "Die Fähre fuhr um zwölf Uhr ab; der Wind wurde stärker. Niemand dachte daran, umzukehren: die Insel war nah. "]
#: (html with {a}, {b}, {c} for article texts and {x} for others; whether the title is text)
TEMPLATES = {
    "information": '<nav><a>Home</a></nav><article><div class="information"><p>{a}</p><p>{b}</p></div></article>',
    "inside": '<div class="wrapper"><div class="inside"><p>{a}</p><p>{b}</p></div></div>',
    "no_names": "<ul><li><a>Home</a></li><li><a>News</a></li></ul><h1>{c}</h1><p>{a}</p><p>{b}</p><ul><li><a>Terms</a></li><li><a>Privacy</a></li></ul>",
    "link_items": "<article><p>{a}</p><ul><li><a>{c}</a></li><li><a>{b}</a></li></ul><p>{a}</p></article>",
    "commentlist": '<article><h1>{c}</h1><p>{a}</p><p>{b}</p></article><ol class="commentlist"><li><p>{x}</p></li><li><p>Thanks, I liked it.</p></li></ol>',
    "table_menu": "<table><tr><td><a>Home</a><a>News</a></td><td><p>{a}</p><p>{b}</p></td></tr></table>",
    "platform": '<div class="platform"><div class="headline"><h1>{c}</h1></div><div class="context"><p>{a}</p><p>{b}</p></div></div><div class="site-footer">Made here. <a>Terms</a></div>',
    "popular": '<div id="navigation"><a>A</a><a>B</a></div><main><h1>{c}</h1><p>{a}</p><p>{b}</p></main><div class="sidebar"><h3>Popular</h3><p>{x}</p></div>',
    "cookies": '<div class="cookie-consent"><p>We use cookies.</p></div><div id="main-content"><h1>{c}</h1><p>{a}</p><p>{b}</p></div><section id="respond"><h3>Leave a reply</h3><form><label>Name</label></form></section>',
    "history": '<div class="history"><h2>{c}</h2><p>{a}</p><blockquote>{b}</blockquote></div><div class="advert"><p>{x}</p></div>',
}


def pages():
    for (name, t), text in itertools.product(TEMPLATES.items(), LONG):
        a, b, c, x = (s.strip() for s in (text * 2, text * 3, "Ferry to the north", text * 2 + "too"))
        want = [{"{a}": a, "{b}": b, "{c}": c}[k] for k in sorted(("{a}", "{b}", "{c}"), key=t.find) if k in t]
        if name == "link_items":
            want.append(a)
        yield name, f"<html><body>{t.format(a=a, b=b, c=c, x=x)}</body></html>", "\n".join(want)


@pytest.fixture(scope="module")
def found():
    rows = list(pages())
    return [(name, got, want) for (name, _, want), got in zip(rows, html_tree.texts([p for _, p, _ in rows], html_tree.train()), strict=True)]


@pytest.mark.parametrize("name", TEMPLATES)
def test_template(found, name):
    for k, got, want in found:
        if k == name:
            assert got == want


def test_blocks_of_pages_set_aside(found):
    hit = sum(len(set(g.split("\n")) & set(w.split("\n"))) for _, g, w in found)
    n_got, n_want = (sum(len(set(r[i].split("\n"))) for r in found) for i in (1, 2))
    assert 2 * hit / (n_got + n_want) >= 0.97


@pytest.mark.parametrize("depth", (1, 3, 5, 50, 3000))
@pytest.mark.parametrize("body", ("deep", "<p>A line of words, which is all that this page has to say.</p>", "<p>no stops here at all just words</p><p>two</p>"))
def test_text_below_plain_divisions_stays(depth, body):
    got = html_tree.texts(["<html><body>" + "<div>" * depth + body], html_tree.train())[0]
    assert got == body.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")
