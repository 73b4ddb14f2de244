"""Trees of pages that aren't well formed, as browsers build them."""

import pytest

from sitewright.sources import html


def shown(node):
    return "".join(x if isinstance(x, str) else f"<{x.tag}>{shown(x)}</{x.tag}>" for x in node.items)


@pytest.mark.parametrize(("page", "tree"), [
    ("<p>a<p>b", "<p>a</p><p>b</p>"),
    ("</p>x<p>a<div>b</div>c", "x<p>a</p><div>b</div>c"),
    ("<p>a<b>b<p>c", "<p>a<b>b</b></p><p>c</p>"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<h1>a<h2>b</h2>c", "<h1>a</h1><h2>b</h2>c"),
    ("<h1>a</h3>b", "<h1>a</h1>b"),
    ("<a href=1>x<a href=2>y</a>z", "<a>x</a><a>y</a>z"),
    ("<b><p>x</b>y</p>z", "<b><p>xy</p></b>z"),
    ("<div><span>a</div>b</span>c", "<div><span>a</span></div>bc"),
    ("<table>stray<tr><td>a<td>b<tr><td>c</table>d", "stray<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>d"),
    ("<table><b>q</b><tr><td>a</table>", "<b>q</b><table><tr><td>a</td></tr></table>"),
    ("<table><tr><td><table><tr><td>in</table>after<td>n</table>", "<table><tr><td><table><tr><td>in</td></tr></table>after</td><td>n</td></tr></table>"),
    ("<table><tbody><tr><td>a<tbody><tr><td>b<thead><tr><th>h</table>", "<table><tbody><tr><td>a</td></tr></tbody><tbody><tr><td>b</td></tr></tbody><thead><tr><th>h</th></tr></thead></table>"),
    ("<p><table><tr><td><p>a</table>b", "<p><table><tr><td><p>a</p></td></tr></table>b</p>"),
    ("<td>x</td>y", "xy"),
    ("<svg><path/><title/></svg>x<div/>y", "<svg><path></path><title></title></svg>x<div>y</div>"),
    ("<html><body><body>x</body>y", "<html><body>xy</body></html>"),
    ("<select><option>a<option>b</select>c", "<select><option>a</option><option>b</option></select>c"),
])
def test_trees(page, tree):
    assert shown(html.tree(page)) == tree


def test_candidates_of_misnested_pages():
    x = html.extract("<title>T</title><body><nav><ul><li>menu</nav><h1>One<h2>Two</h2><p>first<p>second <table>lost<tr><td>cell</table><a href=/a>A<a href=/b>B")
    assert (x["title_tag"], x["title_h1"], x["h2"], x["headings"]) == ("T", "One", "Two", ["One", "Two"])
    assert [(a["href"], a["text"]) for a in x["anchors"]] == [("/a", "A"), ("/b", "B")]
    assert "menu" not in x["excerpt"] and "lost" in x["excerpt"] and "cell" in x["excerpt"]
    assert html.extract("<html><head><title>H</title></head><body><svg><title>icon</title></svg>")["title_tag"] == "H"
    assert html.extract("<body><svg><title>icon</title></svg>")["title_tag"] is None
    assert html.extract(None)["excerpt"] == html.extract("")["excerpt"] == ""
