import random
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boutlab.functions import tree

NESTED = """<html><body><table id=t1><tr><td class="a b">one<table id=t2><tr><td>in <b>ner</b></td><td>x</td></tr></table> after
</td><td>two</td></tr></table><div class="o">A<div class='i'>B &amp; C<div></div></div>D</div><!-- <td>no</td> -->
<script>var x = "<div>";</script><ul><li>1<ul><li>1a<li>1b</ul><li>2</ul><img src="/b.png"><p>p1<p>p2</div></body></html>"""


class Built(HTMLParser):
    """(tag, level among its kind, text) of every element of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append([tag, sum(self.found[i][0] == tag for i in self.open), ""])
        if tag not in tree.VOID:
            self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for i in self.open:
            self.found[i][2] += data


def _listed(page):
    nodes, texts = tree.scan(page)
    return [[n[1], n[6], "".join(texts[n[7] : n[8]])] for n in nodes[1:]]


def _pages():
    text = st.sampled_from(["", "a", " b\n", "&amp;c", "é ", "x &lt; y"])
    kinds = st.sampled_from(["div", "span", "table", "section", "b"])
    element = lambda inner: st.tuples(kinds, st.lists(inner, max_size=4)).map(
        lambda x: f"<{x[0]} class='k {x[0]}'>{''.join(x[1])}</{x[0]}>"
    )
    return st.recursive(st.one_of(text, st.just("<br>"), st.just("<img src='/i.png'>")), element, max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(_pages())
def test_elements_levels_and_texts_are_those_of_another_parser(page):
    other = Built()
    other.feed(page)
    other.close()
    assert _listed(page) == other.found


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abdivtr \"'=!-&;", max_size=80))
def test_any_text_is_read(page):
    nodes, texts = tree.scan(page)
    for at, (own, _, _, _, last, parent, level, start, stop) in enumerate(nodes):
        assert own == at <= last < len(nodes) and parent < at and level >= 0 and 0 <= start <= stop <= len(texts)
        assert parent < 0 or nodes[parent][4] >= last


def test_nested_and_unclosed_elements():
    found = _listed(NESTED)
    texts = {(t, n): x.split() for t, n, x in found}
    assert [x[:2] for x in found if x[0] == "table"] == [["table", 0], ["table", 1]]
    assert texts["td", 1] == ["x"] and found[[x[0] for x in found].index("td")][2].split() == ["onein", "nerx", "after"]
    assert [x[2].strip() for x in found if x[0] == "li" and x[1] == 1] == ["1a", "1b"]
    assert [x[2].split() for x in found if x[0] == "li" and x[1] == 0] == [["11a1b"], ["2"]]
    assert [x[2] for x in found if x[0] == "div"] == ["AB & CD", "B & C", ""]
    assert [x[2].strip() for x in found if x[0] == "p"] == ["p1", "p2"]


@pytest.mark.parametrize("unit", ["<div>a", "<div>a</div>", "<td>a", "</div>", "<p>", "<!-- x", "<a b=\"", "< ", "<a ='", "<script>", "<!"])
def test_linear_in_the_length_of_a_page(unit):
    def seconds(n):
        start = time.process_time()
        tree.scan("<b>" * n + unit * n)
        return time.process_time() - start

    seconds(1_000)
    assert seconds(20_000) < 25 * max(seconds(2_000), 0.01)


def test_columns(spark):
    pages = spark.createDataFrame([(1, NESTED), (2, None), (3, "")], "page_id long, html string")
    made = tree.with_tree(pages)
    cells = tree.inside(tree.page(), "td", level=0)
    rows = {
        r.page_id: r
        for r in made.select(
            "page_id",
            F.transform(cells, tree.text_of).alias("outer"),
            tree.text_of(tree.nth(tree.inside(tree.nth(cells, 0), "td"), 1)).alias("inner"),
            F.size(tree.children(tree.nth(tree.inside(tree.page(), "ul"), 0), "li")).alias("items"),
            tree.text_of(tree.nth(tree.inside(tree.page(), "td", "b"), 0)).alias("classed"),
            tree.attribute(tree.nth(tree.inside(tree.page(), "img"), 0), "src").alias("src"),
        ).collect()
    }
    assert [" ".join(x.split()) for x in rows[1].outer] == ["onein nerx after", "two"]
    assert (rows[1].inner, rows[1].items, rows[1].src) == ("x", 2, "/b.png")
    assert rows[1].classed.startswith("one")
    for empty in (rows[2], rows[3]):
        assert empty.outer == [] and empty.inner is None and empty.src is None


def test_labels(spark):
    page = "<div><i class=t><i>Round:</i> 3 </i><p><i>Details:</i> a &amp; <b>b</b></p></div>"
    made = tree.with_tree(spark.createDataFrame([(1, page)], "page_id long, html string"))
    found = made.select(*[tree.labelled_text(tree.page(), x).alias(x) for x in ("Round:", "Details:", "None:")]).first()
    assert tuple(found) == ("3", "a & b", None)


def test_parts_hold_their_own_elements_only_and_say_what_the_whole_tree_says():
    rng, pieces = random.Random(5), ["<td>", "<td class='x y'>", "</td>", "<tr>", "</tr>", "<table>", "</table>", "<a>", "w ", "&amp;"]
    for _ in range(300):
        page = "".join(rng.choice(pieces) for _ in range(40))
        nodes, texts = tree.scan(page, frozenset({"td", "a"}))
        wanted = [n for n in nodes if n[1] == "td" and "x" in n[2]]
        places = {n[0]: i for i, n in enumerate(wanted)}
        parts = sorted(tree.scan_parts(page, frozenset({"td", "a"}), tree.Kind("td", ("x",))), key=lambda p: p[0])
        assert [p[0] for p in parts] == list(range(len(wanted)))
        for node, (_, around, level, part, words) in zip(wanted, parts, strict=True):
            assert words == texts[node[7] : node[8]] and level == node[6]
            assert [(n[1], n[6]) for n in part[1:]] == [(n[1], n[6]) for n in nodes[node[0] : node[4] + 1]]
            outer = nodes[node[5]]
            while outer[1] == "a":
                outer = nodes[outer[5]]
            assert around == (places.get(outer[0], -1) if level else None)


def test_threes_of_parts_leave_out_a_short_last_one():
    page = "".join(f"<td>{i}<a>{i}</a></td>" for i in range(8))
    parts = list(tree.scan_parts(page, frozenset({"a"}), tree.Kind("td"), width=3))
    assert [p[0] for p in parts] == [0, 1]
    nodes, texts = parts[1][3:]
    assert [texts[n[7]] for n in nodes if n[5] == 0] == ["3", "4", "5"]
    assert [texts[n[7]] for n in nodes if n[1] == "a"] == ["3", "4", "5"] and nodes[0][4] == 6


def test_a_long_page_leaves_its_task_as_small_rows(spark):
    rows = "".join(f"<tr class='r'><td>{i}</td></tr>" for i in range(3000))
    pages = spark.createDataFrame([(1, f"<table><tbody class='b'>{rows}</tbody></table><tr class='r'></tr>"), (2, None)], "page_id long, html string")
    found = tree.with_parts(pages, ["td"], tree.Kind("tr", ("r",)), within=tree.Kind("tbody", ("b",)))
    sizes = found.agg(F.count("*"), F.max(F.size("tree.nodes")), F.max("pos")).first()
    assert tuple(sizes) == (3000, 3, 2999)
    first = tree.with_first(pages, (), tree.Kind("td")).select("page_id", tree.text_of(tree.unit()).alias("t"))
    assert sorted(map(tuple, first.collect())) == [(1, "0"), (2, None)]
