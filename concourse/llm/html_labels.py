"""The labelled table that the block classifier is trained on: short pages whose wanted blocks start with MARK."""

MARK = "§"

_LONG = "§The harbour was quiet that morning, and the boats lay close together along the wall while the crews talked."
_MORE = "§Nobody knew how long the work would take, but the plan was clear and the tools were ready for the first day."

LABELLED = [
    # semantic elements around an article
    f"""<html><head><title>t</title></head><body><header><a href=/>Site name</a></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News today</a></li><li><a href=/c>Sport</a></li></ul></nav>
    <div class="ad">Buy new shoes now, the best of the season for the whole family.</div><article><h1>§A quiet morning</h1><p>{_LONG}<p>{_MORE}<p>§Yes.<p>§It was.</p><p>§See <a href=/x>the map</a> for the way there.</p></article>
    <footer>Copyright of the site, all rights reserved, and a line of words that is rather long for a footer.</footer></body></html>""",
    # an article with unwanted parts inside
    f"""<body><div id="cookie-notice">We use cookies to make this site work well for you, and you can say no to them at any time you like.</div><main><article><header><h1>§Work begins</h1></header><p>§Short.</p><p>{_LONG}</p>
    <aside>Read more about this in our other piece about boats and harbours from last year.</aside><ul><li>§First thing</li><li>§Second thing to do</li></ul><div class="advert"><p>This space is for adverts, and here is one about a car that you may like.</p></div>
    <p>{_MORE}</p><blockquote>§We will see, said the mate.</blockquote><form><label>Your mail address</label><button>Send</button></form><section class="comments"><h3>Comments</h3><p>I do not agree with this at all, the boats were never that close to the wall.</p><p>Nice.</p></section></article></main>
    <aside class="sidebar"><h2>Popular</h2><p>The ten best walks along the coast, told by those who know them well.</p></aside><footer><p>About us</p><p>Contact</p></footer></body>""",
    # class names only
    f"""<body><div class="topbar">Welcome, guest</div><div class="menu"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div class="post"><h2>§Boats</h2><div>{_LONG}</div><div>{_MORE}</div><p>§The end.</p><table><tr><td>§Day</td><td>§Boats seen</td></tr><tr><td>§One</td><td>§Four</td></tr></table></div>
    <div class="related"><p>You may also like these pieces on boats and the sea, chosen for you by the editors.</p></div><div class="comment">First! And a long comment about how the piece was wrong about the boats and the wall.</div><div class="footer">Legal notes and a long line of words about who owns what and since when it is so.</div></body>""",
    f"""<body><p class="notice">This site will be down for some hours on Sunday night while we move it to a new home.</p><div role="navigation"><p>Go to start</p></div><div role="main"><h1>§Title here</h1><p>§One.</p><p>§Two words.</p><p>{_MORE}</p></div><div role="contentinfo">Printed in the town by the press</div></body>""",
    # no marks at all: words and links decide
    f"""<body><a href=1>Start</a> <a href=2>About</a> <a href=3>Help</a><h1>§How the work went</h1><p>{_LONG}</p><p>{_MORE} §And then they went <a href=4>home</a>.</p><p>{_LONG}</p><p><a href=5>Next page</a></p><p>All rights reserved</p></body>""",
    f"""<body><table><tr><td><a href=1>Start</a></td><td><a href=2>List</a></td></tr></table><div>{_LONG}</div><div>{_MORE}</div><div>{_LONG}</div><div><a href=1>Back</a> | <a href=2>Up</a></div><div>Page made in May</div></body>""",
    f"""<body><ul><li><a href=1>First link here</a></li><li><a href=2>Second link here</a></li></ul><p>{_MORE}</p><p>{_LONG}</p><ul><li><a href=1>More of this</a></li><li><a href=2>More of that</a></li></ul></body>""",
    # short articles and one-word paragraphs
    """<body><nav><a href=1>a</a></nav><article><h1>§Of</h1><p>§Of.</p><p>§Be.</p></article><footer>x</footer></body>""",
    """<body><nav><a href=1>Menu of the day and more</a></nav><article><p>§<a href=9>All of this is a link</a></p><p>§Why?</p></article><div class="banner">Sale</div></body>""",
    """<body><div class="newsletter"><p>Sign up for our letter and get the news each day before all others do, at no cost to you.</p></div><article><p>§No</p><p>§Go on then</p></article><div class="share"><a href=1>Share</a></div></body>""",
    # the article ends the page, or the page breaks off
    f"""<body><nav><a href=1>a</a><a href=2>b</a></nav><article><h1>§Last</h1><p>{_LONG}</p><p>§At the end.""",
    f"""<body><div class="menu"><a href=1>a</a></div><main><p>{_MORE}</p><p>§Ends</p><p>§<a href=1>A link that ends it</a></p></main></body>""",
    f"""<body><nav>Start</nav><article><p>§Only one</article>""",
    f"""<body><p>{_LONG}</p><p>{_MORE}</p></body>""",
    f"""<p>{_MORE}</p>""",
    """<p>§Plain words of a note, and no more than that.""",
    """<p>§Gone fishing.</p>""",
    f"""<body><nav><a href=1>a</a></nav><article><p>§<a href=1>Map</a></p><p>§<a href=1>Plan</a></p><p>{_LONG}</p><ul><li>§<a href=2>Chart</a></li><li>§<a href=3>Tides</a></li></ul><p>§<a href=4>Log</a></p></article></body>""",
    # pages without an article
    """<body><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav><form><p>Name</p><p>Mail</p></form><footer>Copyright</footer></body>""",
    """<body><p><a href=1>One</a></p><p><a href=2>Two</a></p><p>Log in</p></body>""",
]
