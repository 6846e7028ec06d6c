"""The labelled pages that the decision tree of html_extract learns from."""

import re

#: Pages of many layouts. The first character of each block's text is its label: + main text, - anything else.
#: {n} stands for a sentence of n words.
PAGES = (
    # an article element between menus, adverts and a footer
    """<body><nav><ul><li><a href="/">-Home</a></li><li><a href="/n">-News</a></li><li><a href="/s">-Sport today</a></li></ul></nav>
    <div class="ad">-{8}</div><article><h1>+A title of some words</h1><p>+{30}</p><p>+{4}</p><p>+{1}</p><p>+{55}</p></article><footer>-&copy; Example {6}</footer></body>""",
    """<body><header><a href="/">-Example</a><p>-The paper for everyone</p></header><div class="cookie-notice"><p>-{25}</p><a href="/c">-More</a></div>
    <main><article><h1>+Bridges</h1><p>+{18}</p><h2>+Why they stand</h2><p>+{60}</p><ul><li>+Stone arches</li><li>+{9}</li><li>+Steel</li></ul><h2>+Others</h2><p>+{12}</p></article></main>
    <aside><h3>-Popular</h3><ul><li><a href="/1">-{7}</a></li><li><a href="/2">-{5}</a></li></ul></aside><footer><p>-{14}</p></footer></body>""",
    # links in and as paragraphs of an article
    """<body><nav><a href="/">-Start</a></nav><article><h1><a href="/t">+A linked title here</a></h1><p>+See <a href="/x">one two three four</a></p><p>+{20}</p>
    <p><a href="/y">+{6}</a></p><p>+{25} <a href="/z">{12}</a></p><p>+Also <a href="/w">this one</a> and <a href="/v">that one</a>.</p><p>+{33}</p>
    <div class="share"><a href="/f">-Share</a></div></article><div class="related"><h3>-Related</h3><ul><li><a href="/1">-{6}</a></li><li><a href="/2">-{8}</a></li></ul></div></body>""",
    # adverts, newsletters, reader comments inside the article
    """<body><article><h1>+Rain</h1><p>+{40}</p><div class="advert"><p>-{12}</p></div><p>+{35}</p><div class="newsletter-signup"><h3>-Stay informed</h3><p>-{16}</p></div><p>+{28}</p>
    <section class="comments"><h2>-Comments</h2><p>-{45}</p><p>-{7}</p><p>-{80}</p></section></article><footer>-{5}</footer></body>""",
    # parts whose names say little: running text stays, lists of links and short lines go
    """<body><article><h1>+Finding things</h1><section id="search"><h2>+How search works</h2><p>+{30}</p><p>+{22}</p><p>+{6}</p></section><p class="related-work">+{24}</p>
    <section id="legal"><p>+{40}</p><p>+{18}</p></section><div class="social"><a href="/a">-Follow us</a></div><div class="related"><a href="/b">-{6}</a></div></article></body>""",
    """<body><div id="search"><p>-Search the site</p></div><div id="text"><h1>+On law</h1><div class="legal"><p>+{35}</p><p>+{20}</p></div><p>+{26}</p></div>
    <div class="related"><h3>-Related stories</h3><a href="/1">-{7}</a></div><div class="social"><p>-Find us elsewhere</p></div></body>""",
    """<body><article><div class="header"><h1>+Stars</h1><p>+{15}</p></div><p>+{30}</p><div class="related"><p>-Read also: <a href="/b">{6}</a></p></div><p>+{31}</p></article></body>""",
    # no article element
    """<body><div id="menu"><a href="/">-Home</a> <a href="/b">About</a></div><div id="text"><h1>+Old pages</h1><p>+{45}</p><p>+{4}</p><p>+{28}</p><h3>+More of it</h3><p>+{17}</p></div>
    <div class="sidebar"><p>-{20}</p></div><div id="footer">-{9}</div></body>""",
    """<body><p>+Short.</p><p>+{5}</p><p>+{7}</p></body>""",
    """<body><p>+{3}</p></body>""",
    """<body><p>+A single line without an end</p></body>""",
    """<body><h1>+Notes</h1><p>+{6}</p><p>+{2}</p><p>+{11}</p><p>+{3}</p><p>+{8}</p></body>""",
    """<body><div><a href="/">-Home</a></div><div><p>+{4}</p><p>+{9}</p><p>+{2}</p></div><div><a href="/p">-Privacy</a> | <a href="/t">Terms</a></div></body>""",
    """<body><table><tr><td><a href="/">-Home</a></td><td><a href="/l">-Links</a></td></tr></table><table><tr><td>+{60}</td></tr><tr><td>+{35} <a href="/q">{9}</a> {30}</td></tr></table>
    <p><a href="/prev">-Back</a> <a href="/next">Next</a></p></body>""",
    """<body><div><ul><li><a href="/1">-{4}</a></li><li><a href="/2">-{3}</a></li><li><a href="/3">-{6}</a></li></ul></div><h2>+A list of reasons</h2><p>+{24}</p><ul><li>+{8}</li><li>+{3}</li><li>+{14}</li></ul>
    <p>+{19}</p><div>-Posted in <a href="/c">Various things</a></div><div><a href="/4">-{9}</a></div></body>""",
    """<body><div>-Menu</div><div><a href="/1">-One</a> <a href="/2">Two</a></div><h1>+Trees of the north</h1><p>+{50}</p><p>+See <a href="/x">the long list of trees</a> for more names.</p><p>+{38}</p>
    <h4>-See also</h4><ul><li><a href="/5">-{5}</a></li><li><a href="/6">-{4}</a></li></ul><p>-<a href="/up">Up</a></p></body>""",
    # a title before its article, teasers and loose text beside it
    """<body><a href="/">-Logo</a><h1>+Title before the article</h1><article><p>+{42}</p><p>+{21}</p><h2>+Part</h2><p>+{30}</p></article><h2>-Latest</h2><div><p>-{13}</p><a href="/m">-More</a></div>
    <div><h3>-What readers say</h3><p>-{35}</p><p>-{9}</p></div></body>""",
    """<body><main><h1>+Guide</h1><p>+{26}</p><pre>+run the thing</pre><p>+{8}</p><table><tr><th>+Name</th><th>+Size</th></tr><tr><td>+a</td><td>+12</td></tr></table></main><div>-{16}</div><p>-{4}</p></body>""",
    """<body><div class="post-content"><p>+{33}</p><blockquote>+{12}</blockquote><p>+{5}</p><figure><figcaption>+Photo of a bridge</figcaption></figure><p>+{48}</p></div><div>-{22}</div>
    <form><p>-Your name</p><p>-{10}</p></form></body>""",
    """<body><article><h2><a href="/1">-{5}</a></h2></article><article><h2><a href="/2">-{6}</a></h2></article><div id="story"><h1>+Story</h1><p>+{52}</p><p>+{41}</p><p>+{6}</p></div><div><a href="/3">-{6}</a></div></body>""",
    # menus whose last item meets the text, comments and teasers of all lengths beside an article
    """<body><div><a href="/1">-Home</a></div><div><a href="/2">-Books and films</a></div><div><a href="/3">-{5}</a></div><p>+{64}</p><p>+{3}</p><p>+{29}</p><div><a href="/4">-Top</a></div></body>""",
    """<body><div><a href="/1">-Start</a></div><div><a href="/2">-{6}</a></div><h1>+Hills</h1><p>+{44}</p><p>+{70}</p><div><a href="/3">-{4}</a></div><div><a href="/4">-About this site</a></div></body>""",
    """<body><ul><li><a href="/1">-{9}</a></li><li><a href="/2">-{7}</a></li></ul><p>+{12}</p><p>+{40}</p><ul><li><a href="/3">-{8}</a></li></ul></body>""",
    """<body><div>-{6}</div><article><p>+{48}</p><p>+{66}</p></article><div>-{12}</div><div>-{60}</div><div>-{45}</div><div>-{90}</div><div>-{3}</div></body>""",
    """<body><div>-{20}</div><main><p>+{70}</p><h3>+Then</h3><p>+{44}</p></main><h2>-Replies</h2><p>-{50}</p><p>-{75}</p></body>""",
    """<body><p><a href="/1">-{8}</a></p><h1>+Before its article</h1><article><p>+{61}</p><p>+{14}</p></article><h3>-More</h3><p>-{44}</p><p>-{52}</p></body>""",
    """<body><article><ul><li><a href="/a">+{4}</a></li><li><a href="/b">+{3}</a></li></ul><p>+{30}</p><p><a href="/c">+{3}</a></p><p><a href="/d">+{7}</a></p><p>+{5}</p></article></body>""",
    # short lines before and after links, in articles and without them
    """<body><article><p>+{20}</p><p>+{2}</p><div class="share"><a href="/s">-Share this</a></div></article><div><a href="/n">-{7}</a></div></body>""",
    """<body><article><p>+{4}</p><p>+{30}</p><p>+{3}</p></article><ul><li><a href="/1">-{3}</a></li><li><a href="/2">-{6}</a></li></ul></body>""",
    """<body><main><table><tr><td>+12</td><td><a href="/k">+Kite</a></td><td>+3</td></tr><tr><td>+Total</td><td><a href="/l">+Lark song</a></td><td>+40</td></tr></table><p>+No mark at the end</p><a href="/x">+Source</a></main></body>""",
    """<body><div><a href="/">-Front</a></div><div><h2>+Wind</h2><p>+{9}</p><p>+Compare <a href="/1">the page on storms</a> and <a href="/2">on calm</a> too.</p></div><div><a href="/3">-Imprint</a> <a href="/4">Contact</a></div></body>""",
    """<body><div><a href="/">-Front</a></div><div><p>+{14}</p><p>+It is <a href="/1">said often</a> but <a href="/2">never shown by anyone</a>.</p><p>+{6}</p></div><div><a href="/3">-Contact</a></div></body>""",
    """<body><div><p>+{13}</p><p>+{3}</p></div><div><a href="/3">-Imprint</a></div></body>""",
    """<body><div><h1>+Sand</h1><p>+{16}</p><p>+{4}</p></div><div>-Tags: <a href="/3">sand</a> <a href="/4">dune</a></div><div>-Posted by <a href="/5">someone</a></div></body>""",
)

_WORDS = "the river runs past old stone houses and people walk along its banks when evening light comes over hills".split()


def pages() -> list[str]:
    def sentence(m: re.Match) -> str:
        n = int(m[1])
        return " ".join((_WORDS * (n // len(_WORDS) + 1))[:n]) + "."

    return [re.sub(r"\{(\d+)\}", sentence, p) for p in PAGES]
