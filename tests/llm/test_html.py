"""HTML extraction: whole pages that the tree hasn't learned from, malformed markup, edges of the table."""

import time

import numpy as np
import pytest

from corpusmem.llm import html_extract, html_samples

#: Pages and the blocks of their articles. Four blocks of TRIED were once wrong and led to more labelled pages; UNSEEN
#: was written after that and the tree not changed since.
TRIED = {
'plain': ('<p>Short.</p><p>Another sentence stands here.</p><p>And a third one follows it.</p>', ["Short.","Another sentence stands here.","And a third one follows it."]),
'linkp': ('<nav><a href=/>Home</a></nav><article><h1>Link</h1><p>see <a href=x>one two three four</a></p><p class="related-work">Others have studied this before us.</p><section id="search"><p>Searching is done by an index that grows with the text.</p></section></article>', ["Link","see one two three four","Others have studied this before us.","Searching is done by an index that grows with the text."]),
'news': ('<body class="has-sidebar"><div id="top-nav"><a href=/>World</a> <a href=/b>Local</a></div><div class="wrapper with-sidebar"><div class="left-column"><h1>Ferry returns to the harbour</h1><p>The ferry came back on Monday after a month of repairs, and a crowd met it.</p><p>"We missed it," said one.</p><p>Tickets cost the same as before.</p></div><div class="right-sidebar"><h3>Most read</h3><p>Mayor resigns after the vote in the council last week.</p></div></div><div class="site-footer">Example News, all rights reserved</div></body>', ["Ferry returns to the harbour","The ferry came back on Monday after a month of repairs, and a crowd met it.",'"We missed it," said one.',"Tickets cost the same as before."]),
'blog': ('<div class="masthead"><a href=/>My blog</a></div><div class="entry-content"><p>I planted beans.<p>They grew &amp; grew until the fence gave way under them.<ul><li>First lesson<li>Second lesson, which took longer</ul></div><div id="comments"><h2>2 comments</h2><div class="comment-body"><p>Lovely beans, I grew some as well last year and ate them all in one week.</p></div></div><form><label>Name</label><textarea>x</textarea></form>', ["I planted beans.","They grew & grew until the fence gave way under them.","First lesson","Second lesson, which took longer"]),
'ads': ('<article><header><h1>Soup</h1><p>By a cook</p></header><p>Boil water first.</p><div class="ad-slot-2">Buy pots now.</div><aside>Did you know that soup is old?</aside><p>Add salt.</p><div class="ShareBar"><a href=f>Share</a></div><footer>Filed under soup</footer></article><div role="dialog">We use cookies.</div><div style="display:none">secret words in here</div>', ["Soup","By a cook","Boil water first.","Add salt."]),
'wild': ('<ARTICLE><H1>Old <I>markup</I></H1><P>One&nbsp;two<BR>three<P>Four <!-- <p>no</p> --> five<SCRIPT>if (a<b) {"</p>"}</SCRIPT> six<p>a &lt;b&gt; c</ARTICLE><DIV CLASS=Menu>Home</DIV>', ["Old markup","One two three","Four five six","a <b> c"]),
'cards': ('<main><h1>Two roads</h1><p>The first road is long and it winds through the whole of the valley.</p><p>The second is short.</p></main><section><a href=1><h3>Next story</h3><p>A summary of the next story for those who want more.</p></a></section>', ["Two roads","The first road is long and it winds through the whole of the valley.","The second is short."]),
'table': ('<article><h2>Sizes</h2><table><tr><th>Name<th>Size<tr><td>Oak<td>20<tr><td><a href=e>Elm</a><td>15</table><p>All in metres</p></article>', ["Sizes","Name","Size","Oak","20","Elm","15","All in metres"]),
'nomenu': ('<div><div><a href=/>Home</a></div><div><a href=/a>About us</a></div></div><div><h1>How clocks work</h1><p>A weight falls slowly.</p><p>The pendulum lets one tooth pass at each swing, so that the hands go round at an even pace.</p><p>Read <a href=b>more on pendulums</a> or <a href=c>on weights</a> elsewhere.</p></div><div><a href=p>Privacy</a> <a href=t>Terms</a></div>', ["How clocks work","A weight falls slowly.","The pendulum lets one tooth pass at each swing, so that the hands go round at an even pace.","Read more on pendulums or on weights elsewhere."]),
}
UNSEEN = {
'recipe': ('<div class="navbar"><a href=/>Kitchen</a></div><main><h1>Bread</h1><p>Mix flour and water.</p><ol><li>Knead</li><li>Wait for <a href=r>an hour</a></li><li>Bake</li></ol><p>Done!</p></main><div class="newsletter">Get a recipe each week by mail.</div><div class="site-footer"><a href=i>Imprint</a></div>', ["Bread","Mix flour and water.","Knead","Wait for an hour","Bake","Done!"]),
'forum': ('<ul id="breadcrumbs"><li><a href=/>Forum</a></li><li><a href=/g>Garden</a></li></ul><article><p>My roses have spots on every leaf since the rain began.</p></article><section class="comment-list"><article class="comment"><p>Cut them back.</p></article><article class="comment"><p>Mine have the same and I did nothing about it for years.</p></article></section>', ["My roses have spots on every leaf since the rain began."]),
'essay': ('<h1>On walking</h1><p>One walks to think.</p><p>There is, as <a href=1>an old author</a> says, no better way to lose a worry than to take it up a hill.</p><h2>Shoes</h2><p>Any will do.</p>', ["On walking","One walks to think.","There is, as an old author says, no better way to lose a worry than to take it up a hill.","Shoes","Any will do."]),
'mixed': ('<div id="cookie-banner"><p>This site keeps cookies to remember you.</p></div><div role="navigation"><a href=a>A</a></div><div role="main"><p>The lake froze in January.</p><div class="promo">Visit the lake hotel for half the price.</div><p>People skated on it</p></div><div role="complementary"><p>The weather today is fine and dry.</p></div>', ["The lake froze in January.","People skated on it"]),
'list': ('<div><a href=/>Home</a> <a href=/x>Index</a></div><h2>Ten birds</h2><ul><li>Robin, a small one that sings in winter.</li><li>Crow, black and clever.</li></ul><p>All of them live near my house in the old wood.</p><div><a href=/p>Previous page</a></div>', ["Ten birds","Robin, a small one that sings in winter.","Crow, black and clever.","All of them live near my house in the old wood."]),
'doc': ('<header><h2>Docs</h2></header><div class="sidebar-menu"><ul><li><a href=1>Install</a></li></ul></div><article class="legal-guide"><h1>Install</h1><pre>make all</pre><p>Then see <a href=2>the next page</a>.</p><h3>Search</h3><p>Type a word.</p></article><nav><a href=3>Next</a></nav>', ["Install","make all","Then see the next page.","Search","Type a word."]),
}


@pytest.fixture(scope="module")
def tree():
    return html_extract.train()


def wrong_blocks(pages, tree):
    wrong = []
    for page, want in pages.values():
        texts, x = html_extract.blocks(page)
        got = [t for t, keep in zip(texts, tree.predict(x), strict=True) if keep]
        wrong += set(got) ^ set(want)
    return wrong


def test_pages_the_tree_has_not_learned(tree):
    assert wrong_blocks(UNSEEN, tree) == []
    assert wrong_blocks(TRIED, tree) == ["Read more on pendulums or on weights elsewhere."]


def test_labelled_pages(tree):
    n = 0
    for page in html_samples.pages():
        texts, x = html_extract.blocks(page)
        assert x.shape == (len(texts), len(html_extract.FEATURES))
        assert [t[0] == "+" for t in texts] == tree.predict(x).astype(bool).tolist() and {t[0] for t in texts} <= {"+", "-"}
        n += len(texts)
    assert n == 244


def test_features_of_neighbours():
    texts, x = html_extract.blocks("<p>one two three.</p><h2>four</h2><p>five <a href=x>six seven</a> eight</p>")
    assert texts == ["one two three.", "four", "five six seven eight"]
    assert np.allclose(x[1], [1, 0, 3, 0, 4, 0.5, 0, 0, 0, 1])


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>" * 100_000 + "x</p>" * 100_000, "<div>x" * 150_000, "<h1>" * 60_000 + "<p></p>" * 60_000, "<p><div>" + "<h1>" * 60_000 + "<p></p>" * 60_000]
    + ["<a href=x>" * 100_000, "<a '" * 250_000, '<a "<b>\n' * 120_000, "<!--" * 250_000, "<svg>" * 200_000, '<a ""' * 200_000 + '">"', "<b class=ad>" * 80_000 + "</b>" * 80_000],
)
def test_time_is_linear(tree, page):
    start = time.process_time()
    html_extract.main_text(page, tree)
    assert time.process_time() - start < 20  # quadratic time takes minutes


def test_edges(spark, tree):
    long = "<article>" + "<p>" + "word " * 400_000 + "</p></article>"
    rows = [(None, "u", "<p>No id here.</p>", 1, "x"), (1, None, None, 1, "x"), (2, "u", "", 1, "x"), (3, "u", "<script>only</script>", 1, "x"), (4, "u", long, 1, "x")] + 2 * [(5, "u", "<p>Twice.</p>", 1, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    out = html_extract.extract(table, keep=("url", "text", "n_chars"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    whole = " ".join(["word"] * 400_000)
    want = [(None, "u", "No id here.", 11), (1, None, "", 0), (2, "u", "", 0), (3, "u", "", 0), (4, "u", whole, len(whole)), (5, "u", "Twice.", 6), (5, "u", "Twice.", 6)]
    assert got == sorted(want, key=str)
    assert html_extract.extract(table.limit(0)).collect() == []
    unended = {"<p>unended <b": "unended", "<p>a < b and c": "a < b and c", "<p>x<!-- no": "x", "<p>y<script>z": "y", "<p>&#x263A; &unknown; &amp": "\u263a &unknown; &"}
    assert {p: html_extract.main_text(p, tree) for p in unended} == unended
