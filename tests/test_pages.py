"""Main text: furniture goes, the article stays."""

from newswarden.functions.pages import readable


def test_readable():
    page = '<html><body><nav><a href="/">Home</a></nav><div class="ad">Buy now, it is very cheap.</div><article><h1>A title of some words here</h1><p>First paragraph &amp; more.<br>Next line of it.</p><script>var x="</p>"</script></article><footer>All rights.</footer></body></html>'
    assert readable(page) == "A title of some words here\nFirst paragraph & more.\nNext line of it."
    assert readable(None) == "" and readable("") == "" and readable("plain words without any tag at all") == "plain words without any tag at all"
    assert readable('<p><a href="x">only a link of many words here</a></p><p>Real text stands here.</p>') == "Real text stands here."
    assert readable("<p>" * 3000 + "Deep text, and unclosed tags.") == "Deep text, and unclosed tags."
