"""Texts of nested shapes, which are gathered once from the inside out."""

import pytest

from quern.llm import wrapper

PAGES = [
    "<body><div class=a>one <b>two</b><div>three<p>four<br>five</div> six</div><p>seven<p>eight<ul><li>nine<li>ten <div>x</div>y</ul>",
    "<html><body hidden>gone<article>in<section id=ad><p>out</section><header><h1>t</h1></header>" + "<div>d" * 30 + "</article></body>",
    "text <table><tr><td>a<td>b<tr><td>c</table> tail<form>f</form><div class='ad'>no</div>",
    "",
]


@pytest.mark.parametrize("html", PAGES)
def test_nested_texts(html):
    shapes = list(wrapper.shape(wrapper.tree(html)).walk())
    assert wrapper._nested_texts(shapes) == {s.number: wrapper._text(s) for s in shapes}


def test_an_inner_text_is_read_once():
    """Joins of text grow with the page, not with its depth."""
    root = wrapper.tree("<div>" * 20 + "<p>word</p>" * 50 + "</div>" * 20)
    calls, known = [], wrapper.blocks

    def counted(nodes, *args, **kw):
        calls.append(sum(len(n.parts) for n in nodes if id(n) not in (kw.get("known") or {})))
        return known(nodes, *args, **kw)

    shapes = list(wrapper.shape(root).walk())
    wrapper.blocks = counted
    try:
        wrapper._nested_texts(shapes)
    finally:
        wrapper.blocks = known
    assert sum(calls) <= 150
