"""Pages written by hand in layouts that the training pages don't have: HTML and the blocks of its main text."""

TOPICS = [
    ("River reopened to boats", ["The river authority said on Monday that boats may pass the lock again.", "Repairs took eleven weeks, three more than planned, because a gate had to be made anew.", "Short note."]),
    ("How to keep bread fresh", ["Keep the loaf in a cloth bag, cut side down, on a wooden board.", "A fridge makes it stale sooner: starch sets fastest just above freezing.", "Frozen slices toast well."]),
    ("Release 4.2 of the tracker", ["This release adds saved searches and a faster index.", "Upgrading from 4.1 needs no change of the database, but the cache is rebuilt once.", "Thanks to all testers."]),
    ("Chess club wins the cup", ["Our second team won the county cup for the first time since 1987.", "In the last round Petra Holm drew a lost game, which gave us the half point that we needed.", "Photos follow."]),
    ("Why leaves turn red", ["In autumn trees break down the green pigment and draw its parts back into the wood.", "Red is made anew, out of sugar, and may shield the leaf from light while that goes on.", "Not all trees do it."]),
]


def news(title, p):
    html = f"""<!doctype html><html lang=en><head><meta charset=utf-8><title>{title} | The Courier</title></head><body>
    <div id="page"><header class="masthead"><a href="/">The Courier</a><nav aria-label="main"><ul><li><a href="/w">World</a><li><a href="/l">Local</a><li><a href="/s">Sport</a></ul></nav></header>
    <main role="main"><article class="story"><h1>{title}</h1><p>{p[0]}</p><figure><img src=a.jpg></figure><p>{p[1]}</p>
    <aside class="related"><h3>Related</h3><ul><li><a href="/1">Older story one</a></li><li><a href="/2">Older story two</a></li></ul></aside><p>{p[2]}</p></article></main>
    <footer class="site-footer"><p>&copy; The Courier</p><a href="/imprint">Imprint</a></footer></div></body></html>"""
    return html, [title, *p]


def blog(title, p):
    html = f"""<html><body class="home"><div class="wrapper"><div class="top"><div class="nav"><a href="/">Home</a> <a href="/about">About me</a> <a href="/feed">Feed</a></div></div>
    <div class="post"><h2>{title}</h2><div class="entry-content"><p>{p[0]}<p>{p[1]}<blockquote><p>{p[2]}</p></blockquote></div></div>
    <div class="comments"><h3>2 comments</h3><div class="comment"><p>Nice one, thank you!</p></div><div class="comment"><p>I do not agree with this at all, sorry.</p></div></div>
    <div class="sidebar"><h3>Archive</h3><ul><li><a href="/5">May</a></li><li><a href="/4">April</a></li></ul></div><div class="footer">Made by hand.</div></div></body></html>"""
    return html, [title, *p]


def manual(title, p):
    html = f"""<!DOCTYPE html><html><head><style>a{{}}</style><script>var x = "<p>no</p>";</script></head><body><nav class="toc"><ol><li><a href="#a">Start</a></li><li><a href="#b">Use</a></li></ol></nav>
    <main><section><h1>{title}</h1><p>{p[0]}</p></section><section id=b><h2>Use</h2><pre>tool --all x</pre><p>{p[1]}</p><table><tr><th>Name</th><td>{p[2]}</td></tr></table></section></main>
    <div class="cookie-notice"><p>We use cookies to count visits.</p><button>Accept</button></div></body></html>"""
    return html, [title, p[0], "Use", "tool --all x", p[1], "Name", p[2]]


def old(title, p):
    html = f"""<HTML><HEAD><TITLE>{title}</TITLE><BODY BGCOLOR=white><FORM ACTION=/find><INPUT NAME=q><BUTTON>Search</BUTTON></FORM>
    <DIV ID="content"><H1>{title}</H1><P>{p[0]}<P>{p[1]}<UL><LI>{p[2]}</UL></DIV><DIV ID="footer">Copyright 1999 the webmaster</DIV></BODY></HTML>"""
    return html, [title, *p]


def magazine(title, p):
    html = f"""<body><section class="promo banner"><a href="/buy">Subscribe now and save half</a></section><header><h2>Weekly</h2><ul><li><a href=/a>Arts</a><li><a href=/b>Books</a></ul></header>
    <article><header><h1>{title}</h1></header><div class="body"><p>{p[0]}</p><div class="ad"><p>Advertisement: shoes at half price.</p></div><p>{p[1]}</p><p>{p[2]}</p></div></article>
    <section class="newsletter"><form><label>Mail</label><input><p>Get our letter every Friday.</p><button>Sign up</button></form></section><footer>Weekly, all rights reserved.</footer></body>"""
    return html, [title, *p]


def bare(title, p):
    html = f"""<html><head><meta charset=utf-8><body><article><h1>{title}</h1><p>{p[0]}<svg/><p>{p[1]} <iframe src=x/><p>{p[2]}<noscript>off</noscript></article>"""
    return html, [title, *p]


PAGES = [(layout.__name__, *layout(title, p)) for layout in (news, blog, manual, old, magazine, bare) for title, p in TOPICS]
