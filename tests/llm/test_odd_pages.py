"""Pages of a megabyte that no one wrote: read in time and memory in proportion to their length."""

import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import html_extract

ODD = {
    "tags without an end": "<a ",
    "elements without an end": "<div>x",
    "quotes without an end": '<a ">x"',
    "quotes of one kind": "<p '>x",
    "comments without an end": "<!--",
    "less than": "< ",
    "end tags of nothing": "</div>x",
    "unknown elements and headings": "<foo><h1>x",
    "attributes without an end": '<a b="c" ',
    "raw elements without an end": "<script>x",
    "hidden elements": "<template>x</template><template>",
}


@pytest.mark.parametrize("kind", ODD)
def test_a_megabyte(kind):
    page = "<p>begin</p>" + ODD[kind] * (1_000_000 // len(ODD[kind])) + "end"
    began = time.process_time()
    found = html_extract.blocks(page)
    assert time.process_time() - began < 5
    assert found[0][1] == "begin"


def test_items_in_a_deep_list():
    """A list's items look for the last open one, and not through all that is open."""
    page = "<li><ul>" + "<foo>" * 60_000 + "<li></li>x" * 60_000
    began = time.process_time()
    assert len(html_extract.blocks(page)) == 60_000 and time.process_time() - began < 5


def test_memory_of_a_megabyte():
    page = "<div>x" * 170_000
    tracemalloc.start()
    own = html_extract.Labeller(7)
    (chosen,) = html_extract.label(own, [html_extract.blocks(page)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chosen) == 170_000 and peak < 500e6


def plain_end(page, at):
    """Where a tag whose name ends at a place is closed: outside of quotes, or else at the next ">"."""
    k, quote = at, None
    while k < len(page):
        if quote:
            quote = None if page[k] == quote else quote
        elif page[k] in "\"'":
            quote = page[k]
        elif page[k] == ">":
            return k
        k += 1
    return page.find(">", at)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<a", "<p ", ">", '"', "'", "x", " y=", "</p", "<!--", "-->", "<!d", "<"]), max_size=30).map("".join))
def test_tags_end_where_a_plain_scan_ends_them(page):
    for begin, end, _, tag, _ in html_extract.tags(page):
        if tag:
            name = html_extract.START.match(page, begin).end()
            assert end == plain_end(page, name) + 1
