"""Labelled pages: y="1" marks main text, y="0" the rest; children inherit the mark."""

_S = "Rain fell over the harbour all night, and by morning the boats could not leave."
_L = ("The council met on Tuesday to hear from the people who live by the river. Most of them asked for a wall, "
      "but some were afraid that it would only move the water to the next village, as it had done before. ")
_Q = "It took nine years, said the engineer, and nobody thanked us."

PAGES = [
    f'<html y="1"><head y="0"><title>Harbour</title></head><body><nav y="0"><ul><li><a>Home</a></li><li><a>News</a></li><li><a>Sport</a></li></ul></nav><div class="ad" y="0">Buy new shoes today. Free delivery.</div><article><h1>Harbour closed</h1><p><b>{_S}</b></p><p>{_L}</p><p>{_L}{_S}</p><p>Short.</p></article><footer y="0">&copy; Daily &middot; All rights reserved.</footer></body></html>',
    f'<html y="1"><body><header y="0"><div class="logo">The Daily</div><form><label>Search</label><input><button>Go</button></form></header><main><article class="post"><header><h1>A wall for the river</h1></header><p>{_L}</p><blockquote><p>{_Q}</p></blockquote><p>{_L} <a>the report</a> {_S}</p><ul><li>A wall of stone, as high as a house.</li><li>A wider bed for the river.</li></ul><p>End.</p></article><section id="comments" class="comments" y="0"><h2>Comments</h2><div class="comment"><p>I live there, and I think the wall is a bad idea for all of us, really.</p></div><div class="comment"><p>Well written, thank you. I had hoped to read more about the boats.</p></div></section></main><aside class="sidebar" y="0"><h3>Related</h3><ul><li><a>Boats</a></li><li><a>Floods</a></li></ul></aside><footer y="0"><p>About us. Contact. Privacy.</p></footer></body></html>',
    f'<html y="1"><body><div id="cookie-banner" class="notice" y="0"><p>We use cookies to make this page better for you, and to count our readers.</p><button>Accept</button></div><div id="menu" y="0"><a>Start</a> <a>Shop</a> <a>Help</a></div><div id="content"><h2>Bread without haste</h2><div><p>{_L}</p><p>{_S} {_L}</p></div><table><tr><td>Flour</td><td>one pound, sifted twice.</td></tr><tr><td>Salt</td><td>a spoon</td></tr></table><pre>bake(1)</pre></div><div class="share social" y="0"><a>Like</a> <a>Send</a></div><div id="footer" y="0">Made by hand. <a>Terms</a></div></body></html>',
    f'<html y="1"><body><div class="wrapper"><div class="header" y="0"><h1>Site name</h1><p>News since the old days, every day.</p></div><div class="entry"><h1>Night train</h1><p>{_S}</p><figure><figcaption>The train at the border.</figcaption></figure><p>{_L}{_L}</p><div class="promo advert" y="0"><p>Order our new book now, it is cheaper until Sunday.</p></div><h3>Later</h3><p>{_L}</p><p>{_Q}</p></div><div class="newsletter" y="0"><form><p>Get our letter every week.</p><input><button>Subscribe</button></form></div><div class="footer" y="0"><p>{_S}</p></div></div></body></html>',
    f'<html y="1"><body><nav class="breadcrumb" y="0"><a>Home</a> / <a>City</a></nav><section class="article-body"><h1>Three bridges</h1><p>{_L}</p><p>One.</p><p>{_S}<br>{_Q}</p><ol><li>{_S}</li><li>The second, built of wood.</li></ol></section><aside y="0"><p>{_L}</p></aside><div role="complementary" class="widget" y="0"><h4>Most read</h4><p>Ten ways to cook fish in the evening.</p></div><div class="reader-comments" y="0"><p>{_L}</p><p>I do not agree with any of this.</p></div></body></html>',
    f'<html y="1"><body><p>{_L}</p><p>{_S}</p><div><p>{_Q}</p></div><h2>More</h2><p>{_L}</p><noscript y="0">Please turn on scripts.</noscript><div class="alert" y="0">This page is old.</div><footer y="0"><ul><li><a>Imprint</a></li></ul></footer></body></html>',
    f'<html y="1"><body><header y="0"><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav></header><article><p><b>{_S}</b><br></p><p>{_L}</p><p>{_L}</p><div class="ads" y="0"><span>Cheap flights to the sea, only today.</span></div><p>{_S}</p><aside y="0"><p>Read also: a story on the price of salt.</p></aside><p>{_Q}</p><section class="note"><p>{_S}</p></section><form y="0"><p>Tell us what you think.</p><textarea></textarea></form><footer y="0"><p>Written by the desk. Printed on Monday.</p></footer></article><div class="sponsored" y="0"><p>{_L}</p></div></body></html>',
    f'<html y="1"><body><div class="nav menu" y="0"><ul><li>Start</li><li>Shop</li></ul></div><div class="main"><div class="text"><h1>Salt</h1><div>{_L}</div><div>{_S}</div><span>{_Q}</span></div></div><div class="disclaimer" y="0"><p>Prices may change at any time, without notice.</p></div><div class="popup modal" y="0"><p>Do not leave yet. We have an offer for you.</p></div><div id="disqus_thread" class="comment-list" y="0"><ul><li><p>{_L}</p></li><li><p>Nice.</p></li></ul></div></body></html>',
    '<html y="1">Nothing but words here, no marks at all.</html>', '<html y="1"><p>a</p></html>', '<html y="1">word</html>',
    '<html y="1"><body>word word</body></html>', '<html y="1"><body><p>Yes</p></body></html>', '<html y="1"><body><div>Few words</div></body></html>',
    '<html y="1"><head y="0"><title>x</title></head><body><nav y="0"><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><div class="ad" y="0">Shoes are cheap today, in town.</div><article><h1>No</h1><p>No</p></article><footer y="0">&copy; x &middot; Made here.</footer></body></html>',
    '<html y="1"><head y="0"></head><body><nav y="0"><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><div class="ad" y="0">Shoes are cheap today.</div><article><h1>Rope</h1><p><b>Rope</b></p><p>rope rope rope rope rope rope rope rope rope rope rope rope rope rope rope rope rope rope</p></article><footer y="0">&copy; x</footer></body></html>',
    '<html y="1"><body><nav y="0"><a>One</a></nav><div class="ad" y="0">Go.</div><article><p>one | two | three | four</p><p>five | six</p><p></p></article><footer y="0">&copy; x</footer></body></html>',
    '<html y="1"><body><div class="ad" y="0">A word from those who pay, and it is long enough to read for a while, is it not.</div><article><h1></h1><p></p></article><footer y="0">&copy; x</footer></body></html>',
    '<html y="1"><body><div class="header" y="0">Site</div><nav y="0"><a>x</a></nav><div class="post"><h1>T</h1><p>One two three, four five.</p><p>Next and last.</p><div class="comments" y="0"><p>I say something here. It is long, as I like to write much about it.</p></div></div><aside y="0"><p>Text on the side, long enough to read.</p></aside><form y="0">name</form><div class="notice" y="0">We use cookies.</div></body></html>',
    '<html y="1"><body><article><p>See <a>here</a>.</p><p><a>A whole line that is a link</a></p><ul><li><a>First</a> of all</li><li>Second</li></ul></article><section class="comments" y="0"><p>Good.</p></section></body></html>',
    '<html y="1"><body><main><p>Short words</p><p><em>and</em> more <strong>of</strong> them</p><div class="advert" y="0"><p>Buy</p></div></main><header y="0">Top of page</header><div id="sidebar" y="0"><p>Side</p></div></body></html>',
    *[f'<html y="1"><head y="0"><title>{w}</title></head><body><nav y="0"><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul></nav><div class="ad" y="0">{_S}</div><article><h1>{h}</h1><p><b>{h}</b></p><p>{w * n}</p><p>{w}</p></article><footer y="0">&copy; x &middot; {_Q}</footer></body></html>'
      for w, h, n in (("rope ", "rope rope rope rope rope rope rope", 200), ("again and again ", "again", 12), ("one ", "", 40), ("buy now ", "buy now buy now", 5), (_S + " ", _S, 3))],
    *[f'<html y="1"><head y="0"><title>{w}</title></head><body><nav y="0"><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three,</a></li></ul></nav><div class="ad" y="0">{_S}</div><article><h1>{w}</h1>{f"<p>{w}</p>" * n}<p><b>{w}</b></p></article><footer y="0">&copy; x &middot; {_Q}</footer></body></html>'
      for w, n in (("A short line.", 60), ("Line", 60), ("Two words", 25), ("All, of it. And more; then: some.", 40))],
    *[f'<html y="1"><body><div class="content"><h2>Title</h2><p>{_L}</p>{f"<p>{w}</p>" * n}</div><div class="comments" y="0">{f"<div><p>{w}</p></div>" * n}</div><aside y="0">{f"<p>{w}</p>" * n}</aside></body></html>'
      for w, n in (("A short line.", 20), ("Line", 20))],
    # no names for parts: menus are lists or cells of links
    f'<html y="1"><body><ul y="0"><li><a>Start</a></li><li><a>Shop</a></li><li><a>Help</a></li></ul><h1>Salt</h1><p>{_L}</p><p>{_S}</p><p>{_L}</p><ul y="0"><li><a>Imprint</a></li><li><a>Data</a></li></ul></body></html>',
    f'<html y="1"><body><p y="0"><a>Start</a> | <a>Shop</a> | <a>Help</a></p><h2>Bread</h2><div><p>{_L}{_S}</p><p>{_Q}</p></div><ul><li>Flour, sifted twice.</li><li>Salt from the sea.</li></ul><div y="0"><a>Imprint</a> <a>Data</a></div></body></html>',
    f'<html y="1"><body><table><tr><td y="0"><a>Start</a><br><a>Shop</a><br><a>Help</a></td><td><h1>Salt</h1><p>{_L}</p><p>{_S}{_S}</p></td></tr><tr><td y="0"><a>Imprint</a></td></tr></table></body></html>',
    f'<html y="1"><body><table><tr y="0"><td><a>Start</a><a>Shop</a><a>Help</a></td></tr><tr><td><p>{_S}</p><p>{_L}</p></td></tr></table><table><tr><th>Year</th><th>Ships</th></tr><tr><td>1901</td><td>40</td></tr></table></body></html>',
    f'<html y="1"><body><div><div y="0"><a>Start</a><a>Shop</a></div><div><div><p>{_L}</p><p>{_L}{_S}</p></div></div></div></body></html>',
    f'<html y="1"><body><div class="page"><div class="row"><div class="col"><h1>Rope</h1><p>{_L}</p><p>{_L}</p></div></div></div></body></html>',
    f'<html y="1"><body><div class="outer"><div class="box"><p>{_S}</p><p>{_L}{_L}</p></div></div><div id="bottom" y="0"><a>Imprint</a> <a>Data</a></div></body></html>',
    # links that belong to the article
    f'<html y="1"><body><nav y="0"><ul><li><a>Start</a></li><li><a>Shop</a></li></ul></nav><article><h1>Sources</h1><p>{_L}</p><ul><li><a>The report of the council</a></li><li><a>The map of the river</a></li><li><a>Minutes</a>, in part</li></ul><p>{_S}</p><p><a>The old wall</a></p></article><footer y="0"><a>Imprint</a></footer></body></html>',
    f'<html y="1"><body><main><h1>Guide</h1><p>{_S}</p><ol><li><a>Knots</a></li><li><a>Sails</a></li></ol><h2><a>Knots</a></h2><p>{_L}</p><table><tr><td><a>Bowline</a></td><td>a loop that holds</td></tr></table></main><aside y="0"><ul><li><a>Boats</a></li></ul></aside></body></html>',
    f'<html y="1"><body><div class="post"><p>{_L}</p><ul><li><a>One way</a></li><li><a>The other way</a></li></ul><p>{_Q}</p><ul class="share" y="0"><li><a>Like</a></li><li><a>Send</a></li></ul><ul class="related-posts" y="0"><li><a>Floods</a></li><li><a>Boats</a></li></ul></div></body></html>',
    f'<html y="1"><body><div class="story"><div class="headline"><h1>{_Q}</h1></div><div class="info"><p>{_L}</p><p>{_S}</p></div><div class="byline"><p>By a reader of maps.</p></div></div><div class="menu-bottom" y="0"><a>Start</a></div></body></html>',
    # readers' comments as long as articles, in lists and divisions after or within the article
    *[f'<html y="1"><body><header y="0"><h2>The Daily</h2></header><{t}><h1>Wall</h1><p>{_L}</p><p>{_S}{_Q}</p></{t.split()[0]}><{c} y="0"><li><p>{_L}</p></li><li><p>{_S}</p></li><li><p>Thanks!</p></li></{c.split()[0]}></body></html>'
      for t in ("article", 'div class="content"', "main") for c in ('ul class="comments"', 'ol id="comment-list"', 'ol class="commentlist"', 'ul class="replies"')],
    f'<html y="1"><body><article><h1>Wall</h1><p>{_L}</p><div class="info"><p>{_L}</p></div><ol class="commentlist" y="0"><li><p>{_L}</p></li><li><div><p>{_S}</p></div></li></ol></article></body></html>',
    f'<html y="1"><body><div id="content"><p>{_L}</p></div><section id="respond" y="0"><h3>Write to us</h3><p>{_S}</p><form><input></form></section></body></html>',
    # parts beside the article that read like one
    *[f'<html y="1"><body><{t}><h1>Boats</h1><p>{_L}</p><p>{_L}</p></{t.split()[0]}><div class="{c}" y="0"><h3>{_Q}</h3><p>{_L}</p></div></body></html>'
      for t, c in (("main", "sidebar"), ("article", "right-side"), ("main", "related"), ('div class="entry"', "most-read"), ("article", "newsletter"), ("main", "site-footer"), ('div id="main-content"', "cookie-bar"), ("article", "promo-box"))],
    # nothing but text below plain divisions
    *[f'<html y="1"><body>{"<div>" * n}{b}{t}{e}{"</div>" * n}</body></html>'
      for n in (1, 2, 4, 9) for t in (_S, _Q, _L, "One line.", "word", "rope and sail and wind</p><p>salt") for b, e in (("", ""), ("<p>", "</p>"), ("<h1>Salt</h1><p>", "</p>"), ("<h1>Salt</h1><span>", "</span>"))],
    # and the same beside named parts, short and long
    *[f'<html y="1"><body><div class="{c}" y="0">{x}</div>{b}<p>{_S}</p><p>One, two; three.</p>{e}<div class="{d}" y="0">{x}</div></body></html>'
      for c, d in (("header", "footer"), ("top menu", "comments"), ("ad", "sidebar"), ("notice", "related")) for x in ("Salt", _S, f"<p>{_Q}</p>")
      for b, e in (('<div class="post"><h1>Salt</h1>', "</div>"), ("<div><h1>Salt</h1>", "</div>"), ("", ""))],
]
