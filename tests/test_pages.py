from boutlab.operators import pages

HTML = """<html><title>Hi <b>all</b></title><body><ul>
<li>one</li><li><a href="/x" class="k">two</a></li><li>three</li><li>four</li><li></li></ul>
<a name="n">anchor</a><div class="ad big">first</div><div class="ad">exact</div>
<img src="/a.png"><img alt="m" src="/belt.png"><i class="label">Referee:</i> <span>Jo Doe</span>
<i>Round:</i>
 2 </body></html>"""


def frame(spark, *documents):
    return spark.createDataFrame(list(enumerate(documents)), "page_id long, html string")


def test_links_and_fields(spark):
    p = frame(spark, HTML, "<p>nothing</p>")
    links = [tuple(r) for r in pages.extract_links(p).orderBy("pos").collect()]
    assert links == [(0, 0, "/x", "two"), (0, 1, "", "anchor")]
    titles = {r["page_id"]: r["text"] for r in pages.extract_text_field(p, "title").collect()}
    assert titles == {0: "Hi all", 1: None}
    assert pages.extract_text_field(p, "div", "ad").first()["text"] == "exact"
    assert pages.extract_text_field(p, "div", "ad", partial=True).first()["text"] == "first"


def test_cells_rows_and_slices(spark):
    p = frame(spark, HTML, "<p>nothing</p>")
    cells = [r["text"] for r in pages.extract_cells(p, "li").orderBy("pos").collect()]
    assert cells == ["one", "two", "three", "four", ""]
    rows = [tuple(r) for r in pages.chunk_cells(p, "li", 2).orderBy("row").collect()]
    assert rows == [(0, 0, "one", "two"), (0, 1, "three", "four"), (0, 2, "", None)]
    assert [r["text"] for r in pages.slice_items(p, "li", 1, 3).collect()] == ["two", "three"]
    assert [r["text"] for r in pages.slice_items(p, "li", 3, -1).collect()] == ["four"]
    assert [r["text"] for r in pages.slice_items(p, "li", 4, None).collect()] == [""]
    assert pages.slice_items(p, "li", 3, -4).count() == 0
    assert {r["page_id"]: r["text"] for r in pages.nth_cell(p, "li", 2).collect()} == {0: "three", 1: None}


def test_markers_and_labels(spark):
    p = frame(spark, HTML, "<p>nothing</p>")
    assert [r["flag"] for r in pages.flag_marker(p, "/belt.png").orderBy("page_id").collect()] == [True, False]
    assert not pages.flag_marker(p, "belt.png").first()["flag"]
    assert [r["text"] for r in pages.extract_tail_text(p, "Referee:").orderBy("page_id").collect()] == ["Jo Doe", None]
    assert pages.extract_tail_text(p, "Round:").first()["text"] == "2"


def test_cells_inside_cells(spark):
    table = "<table><tr><td>a<table><tr><td>b</td><td>c<table><td>d</table></td></tr></table></td><td>e</td></tr></table>"
    rows = [tuple(r)[1:] for r in pages.nested_cells(frame(spark, table, "<p></p>", None), "td").orderBy("pos").collect()]
    assert rows == [(0, 0, None, "abcd"), (1, 1, 0, "b"), (2, 1, 0, "cd"), (3, 2, 2, "d"), (4, 0, None, "e")]
    block = '<div class="ad">x<div>y</div>z</div><div class="ad">w</div>'
    assert pages.extract_text_field(frame(spark, block), "div", "ad").first()["text"] == "xy"
    fields = {r.page_id: r.text for r in pages.nested_field(frame(spark, block, "<p>"), "div", "ad").collect()}
    assert fields == {0: "xyz", 1: None}


def test_links_are_walked_once_per_step(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (9, 1)], "page_id long, target_page_id long")
    start = spark.createDataFrame([(1,)], "page_id long")
    walked = sorted(tuple(r) for r in pages.follow_links(start, links, 3).collect())
    assert walked == [(1, 1, 2), (1, 1, 3), (2, 2, 4), (2, 3, 4), (3, 4, 5)]
    everything = spark.range(10).withColumnRenamed("id", "page_id")
    assert [r["page_id"] for r in pages.linked_pages(start, links, everything, 2).collect()] == [4]


PERSON = """<div class='b-x b-fight-details__person'><i class="b-fight-details__person-status s">{}</i>
<A class="b-link b-fight-details__person-link" href="/c">{}</A></div>"""


def test_corners_are_found_among_other_classes_and_decoys(spark):
    decoy = '<!-- <div class="b-fight-details__person"><a class="b-fight-details__person-link">X</a></div> -->'
    wrapped = f'{decoy}<div class="b-fight-details__persons">{PERSON.format("L", "Ann &amp; Co")}{PERSON.format("W", "Bea")}</div>'
    nameless = PERSON.format("W", "Ann") + PERSON.format("L", "")
    p = frame(spark, wrapped, nameless, "<p></p>")
    rows = pages.bout_from_page(p).collect()
    assert [(r.page_id, r.r_name, r.b_name, r.winner) for r in rows] == [(0, "Ann & Co", "Bea", "Bea")]
    assert sorted(r.page_id for r in pages.unreadable_bouts(p).collect()) == [1, 2]


def test_strikes_come_from_the_third_table_and_rounds_from_the_right_chart(spark):
    def table(*cells):
        made = "".join(f'<td class="b-fight-details__table-col x"><p>{r}</p><p>{b}</p></td>' for r, b in cells)
        return f"<table><tbody>{made}</tbody></table>"

    def row(red, blue):
        sides = (("js-red", red), ("js-blue", blue))
        inner = "".join(
            f'<i class="bar {s}"><i class="b-fight-details__bar-chart"></i>'
            f'<i class="b-fight-details__bar-chart-text y">{t}</i></i>' for s, t in sides
        )
        return f'<div class="b-fight-details__bar-charts-row clearfix">{inner}</div>'

    none = ("", "")
    totals = table((1, 0), ("10 of 20", "5 of 9"), none, ("12 of 25", "6 of 10"), ("2 of 3", "0 of 1"), none, (1, 2), (0, 1), ("1:05", "0:10"))
    wrong = table(*[("99 of 99", "99 of 99")] * 9)
    strikes = table(none, none, *[(f"{n} of 9", f"{n} of 8") for n in range(1, 7)])
    charts = f'<div class="b-fight-details__charts-col_pos_left">{row("9 of 9", "9 of 9")}</div>'
    charts += f'<div class="c b-fight-details__charts-col_pos_right">{row("3 of 7 - 42%", "1 of 2 - 50%")}{row("4 of 5 - 80%", "0 of 3 - 0%")}</div>'
    red, blue = pages.corner_stats_from_page(frame(spark, totals + wrong + strikes + wrong + charts)).orderBy("ctrl_time").collect()[::-1]
    assert (red.corner, red.kd_landed, red.sig_str_landed, red.ctrl_time, red.head_landed, red.ground_attempted) == ("r", 1, 10, 65, 1, 9)
    assert (blue.corner, blue.td_attempted, blue.subs_attempted, blue.reversals, blue.ground_landed) == ("b", 1, 2, 1, 6)
    assert [red[f"round_{n}_sig_str_attempted"] for n in range(1, 6)] == [7, 5, None, None, None]
    assert [blue[f"round_{n}_sig_str_landed"] for n in (1, 2)] == [1, 0]
