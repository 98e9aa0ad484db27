"""Hand-made edge cases (values invented) for the operators."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from slotvalue.functions.rfuncs import percent_label
from slotvalue.functions.text import file_stem, latin_ascii
from slotvalue.operators import bands, clean, compare, corpus, exemplars, keys, report, searchindex, slots
from slotvalue.sources import pages

AS_OF = "2001-12-31"


def rows(df, *cols, order=None):
    df = df.select(*cols) if cols else df
    return [tuple(r) for r in df.orderBy(*(order or [F.col(f"`{c}`") for c in df.columns])).collect()]


# ------------------------------------------------------------- cleaning

def test_clean_entrants_parsing(spark):
    raw = spark.createDataFrame([
        (2000, 1, "1", "A B", "3", "10.5", ""),
        (2000, 2, " 2 ", "C D", "", "", "1"),
        (2000, 3, "Pk", "Player", "Yrs", "WS", "VORP"),
        (2000, 4, "", "E F", "1", "1", "1"),
        (2000, 5, None, "G H", "1", "1", "1"),
        (2000, 6, "1.0d", "I J", "1", "1", "1"),
        (2000, 7, "3", "", "1", "1", "1"),
        (2000, 8, "4", "K L", "abc", None, "2"),
    ], "class_year int, row_pos int, Pk string, Player string, Yrs string, WS string, VORP string")
    got = rows(clean.clean_entrants(raw), "row_pos", "slot", "exposure", "value", "value2")
    assert got == [(1, 1, 3.0, 10.5, 0.0), (2, 2, 0.0, 0.0, 1.0), (8, 4, None, None, 2.0)]


def test_name_clean(spark):
    df = spark.createDataFrame([("Dončić Łuka",), ("O'Neal-Smith Jr.",), ("Nene",), ("Foo Bar ",),
                                (None,)], "name string")
    got = {r["name"]: (r["name_clean"], r["first_name"], r["last_name"], r["base_id"])
           for r in keys.name_clean(df).collect()}
    assert got["Dončić Łuka"] == ("Doncic Luka", "Doncic", "Luka", "lukado")
    assert got["O'Neal-Smith Jr."] == ("ONealSmith Jr", "ONealSmith", "Jr", "jron")
    assert got["Nene"] == ("Nene", "Nene", "Nene", "nenene")
    assert got["Foo Bar "] == ("Foo Bar ", "Foo", "", "fo")
    assert got[None] == (None, None, None, "NANA")


def test_entity_key_suffixes(spark):
    df = spark.createDataFrame([
        (2001, 1, "Ann Smith"), (2000, 5, "Anna Smithers"), (2000, 2, "Andy Smith"), (2000, 3, "Bo Unique"),
    ], "class_year int, id int, name string")
    got = rows(keys.entity_key(df), "id", "player_id")
    assert got == [(1, "smithan3"), (2, "smithan1"), (3, "uniqubo"), (5, "smithan2")]


# ---------------------------------------------------------------- pages

HTML = ("<html><head><title>T &amp; x</title></head><body>"
        "<table><tr><th>MP</th><th>PTS</th><th>MP</th><th>MP</th></tr>"
        "<tr><td>1</td><td><a href=\"/p\">2 &lt;b&gt;</a></td><td>3</td><td> 4 </td></tr></table>"
        "<table><tr><td>second</td></tr></table></body></html>")


def test_page_cells_and_header(spark):
    pg = spark.createDataFrame([(1, "http://x/2004", HTML), (2, "http://x/none", "<p>no tables</p>")],
                               "page_id long, url string, html string")
    cells = pages.page_cells(pg)
    assert cells.where("page_id = 2").count() == 0
    first = pages.page_first_table(pg)
    assert first.where("cell = 'second'").count() == 0
    named = pages.header_promote(pg)
    got = rows(named.where("table_idx = 0"), "col_idx", "col_name", "cell", "href")
    assert got == [(0, "MP", "1", None), (1, "PTS", "2 <b>", "/p"), (2, "MP.1", "3", None), (3, "MP.2", "4", None)]
    wide = pages.to_wide(named.where("table_idx = 0"), ["MP", "PTS", "MP.1", "MP.2"])
    assert rows(wide, "MP", "PTS", "`MP.1`", "`MP.2`") == [("1", "2 <b>", "3", "4")]
    scan = rows(pages.page_scan(pg), "page_id", "class_year")
    assert scan == [(1, 2004), (2, None)]


# ------------------------------------------------------------ summaries

def _entrants(spark, data):
    return spark.createDataFrame(data, "class_year long, slot long, id long, name string, "
                                       "exposure double, value double")


def test_slot_value_median_and_nulls(spark):
    data = [(2000, 1, i, "x", 1.0, float(v)) for i, v in enumerate([5, 1, 3, 4])]  # even: median 3.5
    data += [(2000, 2, 10 + i, "x", 1.0, float(v)) for i, v in enumerate([7, 2, 9])]  # odd: 7
    data += [(2000, 3, 20, "x", 1.0, None), (2000, 3, 21, "x", 1.0, 1.0)]          # NULL -> NULL
    data += [(2000, 31, 30, "x", 1.0, 1.0)]                                         # above the cut
    got = rows(slots.slot_value(_entrants(spark, data)), "slot", "total", "avg", "med", "highlight")
    assert got == [(1, 13.0, 3.25, 3.5, "no"), (2, 18.0, 6.0, 7.0, "yes"), (3, None, None, None, "no")]


def test_half_even_labels(spark):
    df = spark.createDataFrame([(2.25, 0.0625)], "a double, p double")
    r = df.select(F.bround("a", 1).alias("l"), percent_label(F.col("p")).alias("pl")).first()
    assert (r["l"], r["pl"]) == (2.2, "6.2%")


def test_class_rank_ties_nulls_and_slot_filter_after(spark):
    data = [(2000, 40, 1, "a", 1.0, 9.0), (2000, 1, 2, "b", 1.0, 5.0), (2000, 2, 3, "c", 1.0, 5.0),
            (2000, 3, 4, "d", 1.0, 1.0), (2000, 4, 5, "e", 1.0, None), (2000, 5, 6, "f", 0.0, 99.0)]
    ranked = slots.class_rank(_entrants(spark, data))
    assert rows(ranked, "id", "class_rank") == [(1, 1), (2, 2), (3, 2), (4, 3), (5, None)]
    summary = rows(slots.slot_rank(ranked), "slot", "avg_rank")
    assert summary == [(1, 2.0), (2, 2.0), (3, 3.0), (4, None)]


# ---------------------------------------------------------------- bands

def test_band_assign_edges(spark):
    data = [(1990, 1, 1, "z", 0.0, 0.0),     # zero exposure -> mega_bust
            (1990, 1, 2, "n", None, 3.0),    # NULL exposure -> NULL rate -> mega_boom
            (1990, 2, 3, "a", 1.0, 1.0), (1990, 2, 4, "b", 1.0, 2.0), (1990, 2, 5, "c", 1.0, 3.0),
            (1990, 3, 6, "d", 1.0, 4.0), (1990, 3, 7, "e", 1.0, 5.0),
            (1999, 1, 8, "young", 1.0, 5.0)]  # not mature
    got = dict(rows(bands.band_assign(_entrants(spark, data), as_of=AS_OF), "id", "band"))
    # rates 1..5: mean 3, sd ~1.58; 2 < 3 - 0.79 -> bust; 3 -> role_player; 4 -> role_player (< 3.79? no) ...
    assert got[1] == "mega_bust" and got[2] == "mega_boom" and 8 not in got
    assert got[3] == "mega_bust" and got[4] == "bust" and got[5] == "role_player"
    assert got[6] == "boom" and got[7] == "mega_boom"


def test_band_bound_is_strict(spark):
    # rates 0, 2: mean 1, sd sqrt(2); exactly on mean + 0.5 sd never happens with floats,
    # so test the strict bound through mean itself: rate == mean -> role_player (not bust)
    data = [(1990, 1, 1, "a", 1.0, 0.0), (1990, 1, 2, "b", 1.0, 1.0), (1990, 1, 3, "c", 1.0, 2.0)]
    got = dict(rows(bands.band_assign(_entrants(spark, data), as_of=AS_OF), "id", "band"))
    assert got[2] == "role_player"


def test_share_stack_zero_fill(spark):
    data = [(1990, 1, i, "x", 1.0, float(i)) for i in range(4)] + [(1990, 2, 10, "y", 0.0, 0.0)]
    shares = bands.band_share(bands.band_assign(_entrants(spark, data), as_of=AS_OF))
    sums = dict(rows(shares.groupBy("slot").agg(F.sum("prop")), ))
    assert all(abs(v - 1.0) < 1e-12 for v in sums.values())
    stack = bands.band_stack(shares)
    tops = stack.groupBy("slot").agg(F.max("ymax").alias("m")).collect()
    assert all(abs(r["m"] - 1.0) < 1e-12 for r in tops)
    filled = bands.band_zero_fill(bands.band_assign(_entrants(spark, data), as_of=AS_OF))
    assert filled.count() == 10
    assert rows(filled.where("slot = 2 and count > 0"), "band", "count") == [("mega_bust", 1)]


# ------------------------------------------------------------ exemplars

def test_exemplar_counts_and_middle(spark):
    data = []
    i = 0
    for slot, size in [(1, 1), (2, 2), (3, 3), (4, 8), (5, 9), (6, 4)]:
        for k in range(size):
            data.append((1990, slot, i, f"p{i}", 1.0, float(k + 1)))
            i += 1
    ex = exemplars.exemplars(_entrants(spark, data), as_of=AS_OF)
    counts = dict(rows(ex.groupBy("slot").count()))
    assert counts == {1: 3, 2: 6, 3: 9, 4: 9, 5: 9, 6: 9}
    # 3 * min(3, size) per slot
    mid4 = sorted(r["value"] for r in ex.where("slot = 6 and category = 'Middle 3'").collect())
    assert mid4 == [1.0, 2.0, 3.0]        # even group: the lower third row
    mid9 = sorted(r["value"] for r in ex.where("slot = 5 and category = 'Middle 3'").collect())
    assert mid9 == [4.0, 5.0, 6.0]
    top9 = sorted(r["value"] for r in ex.where("slot = 5 and category = 'Top 3'").collect())
    assert top9 == [7.0, 8.0, 9.0]


def test_report_dimension_placeholder_and_duplicates(spark):
    data = [(1990, 1, 1, "a", 1.0, 1.0), (1990, 1, 2, "b", 1.0, 2.0)]
    ex = exemplars.exemplars(_entrants(spark, data), as_of=AS_OF).withColumn("player_id", F.col("id").cast("string"))
    dim = spark.createDataFrame([("img/1.jpg", "1"), ("img/1.png", "1")], "path string, player_id string")
    rep = report.slot_report(ex, dim, placeholder="ph.jpg")
    paths = sorted(r["path"] for r in rep.where("category = 'Bottom 3'").collect())
    assert paths == ["img/1.jpg", "img/1.png", "ph.jpg"]
    stems = spark.createDataFrame([("a/b.v2.jpg",), ("a/b",)], "p string").select(file_stem(F.col("p")))
    assert sorted(r[0] for r in stems.collect()) == ["b", "b.v2"]


# ------------------------------------------------------------- corpus

def test_search_collapse_snippet(spark):
    idx = spark.createDataFrame([
        (1, "a.html", "Alpha page", "", "the quick brown fox jumps"),
        (2, "a.html#s1", "Alpha page", "Part", "a quick brown dog"),
        (3, "a.html#s2", "Alpha page", "Part", "slow"),
        (4, "a.html#s3", "Alpha page", "Part", "brown"),
        (5, "b.html", "Beta", "", "QUICK BROWN things"),
    ], "entry_id long, href string, title string, section string, text string")
    q = spark.createDataFrame([(1, "quick brown"), (2, "alpha"), (3, "x"), (4, "own"), (5, "wn do"),
                               (6, "a q")], "query_id long, query string")
    hits = searchindex.search(idx, q)
    got = rows(hits, "query_id", "entry_id", "score")
    assert (1, 1, 10) in got and (1, 2, 10) in got and (1, 5, 10) in got
    assert [r for r in got if r[0] == 2] == [(2, e, 20) for e in (1, 2, 3, 4)]
    assert not [r for r in got if r[0] == 3]          # shorter than 2
    assert len([r for r in got if r[0] == 4]) == 4    # inside words
    assert [r for r in got if r[0] == 5] == [(5, 2, 10)]   # across a word boundary
    assert [r for r in got if r[0] == 6] == [(6, 2, 10)]   # single-character words only
    col = corpus.collapse(hits.where("query_id = 2"))
    assert rows(col, "item_pos", "href", "more") == [(1, "a.html", 1), (2, "a.html#s1", 1), (3, "a.html#s2", 1)]
    text = "word " * 30 + "target here" + ", tail" * 60
    df = spark.createDataFrame([(text, "TARGET")], "t string, q string")
    snip = df.select(corpus.snippet(F.col("t"), F.col("q"))).first()[0]
    assert snip.startswith("target here, tail") and snip.endswith("…") and len(snip) <= 215
    short = spark.createDataFrame([("abc def", "zzz"), ("abc def", "def")], "t string, q string")
    assert [r[0] for r in short.select(corpus.snippet(F.col("t"), F.col("q"))).collect()] == ["abc def"] * 2


def test_listing_category_stats(spark):
    docs = spark.createDataFrame([(i, "fr" if i % 2 else "en", f"s{i % 3}", "a b  c" if i == 3 else "")
                                  for i in range(10)], "doc_id long, lang string, source string, text string")
    page = corpus.listing_page(docs, page=2, size=3, order=[("doc_id", "desc")])
    assert rows(page, "doc_id", "position") == [(4, 6), (5, 5), (6, 4)]
    assert corpus.in_category(docs, "fr", F.concat_ws(",", "lang", "source")).count() == 5
    assert corpus.in_category(docs, "", F.concat_ws(",", "lang", "source")).count() == 10
    st = dict(rows(corpus.word_stats(docs), "doc_id", "words"))
    assert st[3] == 3 and st[0] == 0


def test_compare_helpers(spark):
    summary = spark.createDataFrame([(1, 5.0, 4.0), (2, 3.0, 2.0), (3, 3.5, 0.0), (6, 1.0, 1.0)],
                                    "slot long, avg double, med double")
    assert rows(compare.lowest_mean(summary)) == [(2, 3.0)]
    assert rows(compare.nearest_mean(summary), "slot") == [(3,)]
    ratios = dict(rows(compare.ratio_to_focus(summary), "slot", "ratio"))
    assert ratios == {1: 0.5, 3: None, 6: 2.0}


def test_approx_median_opt_in(spark):
    data = [(2000, 1, i, "x", 1.0, float(i)) for i in range(101)]
    exact = slots.slot_value(_entrants(spark, data)).first()
    approx = slots.slot_value(_entrants(spark, data), median="approx").first()
    assert exact["med"] == 50.0 and abs(approx["med"] - 50.0) <= 1.0


def test_report_order_and_exact_median(spark):
    df = spark.createDataFrame([(1, 3, 1.0, 2000, "a"), (1, 1, 5.0, 2000, "b"), (1, 1, 7.0, 2001, "c"),
                                (1, 2, 2.0, 2000, "d")],
                               "slot long, category_ord long, rate double, class_year long, name string")
    assert [r["name"] for r in report.report_order(df).collect()] == ["c", "b", "d", "a"]
    med = slots.exact_median(df, ["slot"], "rate").first()
    assert med["med"] == 3.5


def cells_of(spark, html, url="u/1"):
    pg = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return rows(pages.page_cells(pg), "table_idx", "row_idx", "col_idx", "cell", "href")


def test_cells_of_nested_tables_and_lists(spark):
    assert cells_of(spark, "<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>"
                           "<ul><li><a href='/x'>one &amp; two</a></li><li>three</li></ul>") == [
        (0, 0, 0, "ain", None), (0, 0, 1, "b", None), (1, 0, 0, "in", None),
        (2, 0, 0, "one & two", "/x"), (2, 1, 0, "three", None)]
    # a list inside a cell ends neither the cell nor the table
    assert cells_of(spark, "<table><tr><th>h</th></tr><tr><td><ul><li>x</li></ul>y</td></tr><tr><td>z</td></tr></table>") == [
        (0, 0, 0, "h", None), (0, 1, 0, "xy", None), (0, 2, 0, "z", None), (1, 0, 0, "x", None)]
    assert cells_of(spark, "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>") == [
        (0, 0, 0, "ab", None), (0, 1, 0, "c", None), (1, 0, 0, "b", None)]
    # nothing closed
    assert cells_of(spark, "<table><tr><td>a<td>b<tr><td>c") == [(0, 0, 0, "a", None), (0, 0, 1, "b", None), (0, 1, 0, "c", None)]


def test_cells_decode_every_reference(spark):
    html = "<table><tr><td>Jos&eacute; &#321;uka</td><td>a&nbsp;&nbsp;b &#x41; &middot; &amp;lt;</td></tr></table>"
    assert [c[3] for c in cells_of(spark, html)] == ["José Łuka", "a b A · &lt;"]


def test_spans_are_filled_and_over_headers_skipped(spark):
    over = ("<table><tr><th></th><th colspan=2>Totals</th></tr><tr><th>Player</th><th>MP</th><th>WS</th></tr>"
            "<tr><td>Ann</td><td colspan='2'>7</td></tr><tr><td rowspan=2>Bo</td><td>1</td><td>2</td></tr>"
            "<tr><td>3</td><td>4</td></tr></table>")
    pg = spark.createDataFrame([(1, "u/1", over)], "page_id long, url string, html string")
    got = rows(pages.header_promote(pg), "row_idx", "col_name", "cell", order=["row_idx", "col_idx"])
    assert got == [(2, "Player", "Ann"), (2, "MP", "7"), (2, "WS", "7"), (3, "Player", "Bo"), (3, "MP", "1"), (3, "WS", "2"),
                   (4, "Player", "Bo"), (4, "MP", "3"), (4, "WS", "4")]
    first = rows(pages.header_promote(pg, header_row=0), "col_name", order=["row_idx", "col_idx"])
    assert [r[0] for r in first[:3]] == ["", "Totals", "Totals.1"]


def test_unique_names_skip_a_taken_suffix():
    assert pages.unique_names(["MP", "PTS", "MP", "MP"]) == ["MP", "PTS", "MP.1", "MP.2"]
    assert pages.unique_names(["MP", "MP", "MP.1"]) == ["MP", "MP.2", "MP.1"]
    assert pages.unique_names(["", ""]) == ["", ".1"]


def test_pages_to_entrants(spark):
    """Two classes, a repeated header, an over-header, accents, a page without tables."""
    def page(*lines):
        head = "<tr><th></th><th colspan=3>x</th><th></th></tr><tr>" + "".join(
            f"<th>{c}</th>" for c in ("Pk", "Player", "Yrs", "WS", "VORP")) + "</tr>"
        body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in line) + "</tr>" for line in lines)
        return f"<html><ul><li>menu</li></ul></html><table>{head}{body}</table>".replace("<ul><li>menu</li></ul>", "")

    pg = spark.createDataFrame([
        (1, "http://h/draft/2004", page(("1", "Ann Smith", "3", "10.5", ""), ("Pk", "Player", "Yrs", "WS", "VORP"),
                                        ("2", "Nguy&#7877;n Văn Thiệu", "", "", "1"))),
        (2, "http://h/draft/2005", page(("1", "Anna Smithers", "1", "2", "3"), ("1.5", "Bo Half", "1", "abc", "3"))),
        (3, "http://h/none", "<p>nothing</p>"), (4, None, None)], "page_id long, url string, html string")
    got = rows(clean.load_pages(pg), "class_year", "slot", "name", "exposure", "value", "value2", "player_id",
               order=["class_year", "row_pos"])
    assert got == [(2004, 1.0, "Ann Smith", 3.0, 10.5, 0.0, "smithan1"), (2004, 2.0, "Nguyễn Văn Thiệu", 0.0, 0.0, 1.0, "thieung"),
                   (2005, 1.0, "Anna Smithers", 1.0, 2.0, 3.0, "smithan2"), (2005, 1.5, "Bo Half", 1.0, None, 3.0, "halfbo")]


def test_cells_are_handed_on_a_few_at_a_time(spark, monkeypatch):
    """A task never holds the cells of many pages, and a page's may go out in several parts."""
    body = "".join(f"<tr><td>{i}</td><td>n{i}</td></tr>" for i in range(20))
    pg = spark.createDataFrame([(i, f"http://h/{i}", f"<table><tr><th>Pk</th><th>Player</th></tr>{body}</table>") for i in range(30)],
                               "page_id long, url string, html string").coalesce(1)
    whole = rows(pages.page_tables(pg))
    monkeypatch.setattr(pages, "CELLS_OUT", 7)
    assert rows(pages.page_tables(pg)) == whole and len(whole) == 30 * 42


def test_wide_rows_take_one_aggregate(spark):
    pg = spark.createDataFrame([(1, "http://h/1", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"),
                                (1, "http://h/1", "<table><tr><th>c</th></tr><tr><td>9</td></tr></table>")],
                               "page_id long, url string, html string")
    wide = pages.raw_table(pg, ["a", "b", "c", "d"])
    assert [tuple(r) for r in wide.collect()] == [(1, 1, 1, "1", "2", "9", None)]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_buckets_are_not_worked_out_below_an_aggregate(spark):
    cells = spark.range(400).select((F.col("id") % 5).alias("k"), (F.col("id") / 4).cast("long").alias("o"), F.col("id").cast("string").alias("c"))
    made = cells.groupBy("k", "o").agg(F.first("c").alias("c"))
    plan = keys.number_within(made, ["c"], ["k", "o"], buckets=4)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambdafunction" in line]


def test_first_table_is_that_of_the_whole_page(spark):
    """Stopping at its end gives what the whole page gives."""
    odd = ["<table><tr><td>a<table><tr><td>in</td></tr></table>b</td></tr></table><ul><li>x</li></ul>", "<ul><li>open",
           "<!-- <table> --><script>'<ul>'</script><ol><li>1<ul><li>2</ol><table><tr><td>z</td></tr></table>", "</table><p>none", "",
           "<table><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr></table></table><table></table>"]
    pg = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(odd)], "page_id long, url string, html string")
    assert rows(pages.page_first_table(pg)) == rows(pages.page_cells(pg).where("table_idx = 0"))


def test_names_tie_by_page_and_row(spark):
    """Two pages of one class: the lower page comes first, whatever its rows."""
    def page(*names):
        body = "".join(f"<tr><td>{i + 1}</td><td>{n}</td><td>1</td><td>1</td><td>1</td></tr>" for i, n in enumerate(names))
        return "<table><tr>" + "".join(f"<th>{c}</th>" for c in clean.PAGE_COLUMNS) + f"</tr>{body}</table>"

    pg = spark.createDataFrame([(2, "http://h/2000", page("Al Smith")), (1, "http://h/2000", page("X Y", "Alan Smith", "Alf Smith"))],
                               "page_id long, url string, html string")
    got = rows(clean.load_pages(pg), "page_id", "row_pos", "player_id")
    assert got == [(1, 1, "yx"), (1, 2, "smithal1"), (1, 3, "smithal2"), (2, 1, "smithal3")]


def test_transliteration_of_more_blocks(spark):
    given = ["ＡＢＣ ｘｙｚ", "ﬁx ﬀ ﬃ ﬅ", "ⱡⱥⱢ Ꜳꜳ Ꝏ", "plain", "ƀɁ Ƒ", "Straße Œuvre", None, "日本"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(latin_ascii(F.col("t"))).collect()]
    assert got[:6] == ["ABC xyz", "fix ff ffi st", "laL AAaa OO", "plain", "bɁ F", "Strasse OEuvre"] and got[6:] == [None, "日本"]


def test_transliteration_of_vietnamese_and_forms(spark):
    df = spark.createDataFrame([("Nguyễn Văn Thiệu",), ("Ṡtraẞe",), ("Ḿb Ấn",)], "name string")
    assert [r.name_clean for r in keys.name_clean(df).collect()] == ["Nguyen Van Thieu", "StraSSe", "Mb An"]


def test_labels_follow_k(spark):
    data = [(1990, 1, i, f"p{i}", 1.0, float(i)) for i in range(9)]
    ex = exemplars.exemplars(_entrants(spark, data), as_of=AS_OF, k=2)
    assert {r["category"] for r in ex.collect()} == {"Top 2", "Middle 2", "Bottom 2"}
    assert {r["category_ord"] for r in ex.collect()} == {1, 2, 3}


def test_page_index_of_odd_pages(spark):
    many = "<title>T &eacute;</title><h1>H</h1><article>a</article><article>b</article>" + "".join(f"<p>w{i}</p>" for i in range(1100))
    pg = spark.createDataFrame([
        (1, "http://h/1#x", many), (2, "http://h/2", "<html><body><script>no</script>seen <p>par</p></body></html>"),
        (3, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    idx = corpus.page_index(pg)
    assert idx.count() == idx.select("entry_id").distinct().count() == 1101 + 2 + 1
    by = {(r.page_id, r.pos): r for r in idx.select("entry_id.*", "href", "title", "section", "text").collect()}
    assert by[1, 0][2:] == ("http://h/1", "T é", "H", "a b") and by[1, 1100][2:] == ("http://h/1#p1099", "T é", "H", "w1099")
    assert by[2, 0].text == "seen par" and by[2, 1].text == "par" and by[3, 0].text == ""
    q = spark.createDataFrame([(1, "w1050"), (2, "w0")], "query_id long, query string")
    assert rows(searchindex.search(idx, q), "query_id", "href") == [(1, "http://h/1#p1050"), (2, "http://h/1#p0")]


def test_one_common_word_over_many_entries(spark):
    idx = spark.range(3000).select(F.col("id").alias("entry_id"), F.concat(F.lit("h"), "id").alias("href"), F.lit("").alias("title"),
                                   F.lit("").alias("section"), F.lit("some common word here").alias("text"))
    q = spark.createDataFrame([(i, "common") for i in range(5)] + [(9, "some common word")], "query_id long, query string")
    got = searchindex.search(idx, q, limit=None).groupBy("query_id").count()
    assert {r.query_id: r["count"] for r in got.collect()} == {i: 3000 for i in (0, 1, 2, 3, 4, 9)}


def test_texts_are_not_dealt_once_for_each_query(spark, monkeypatch):
    """Of many queries, each goes to its entries before the texts are joined."""
    idx = spark.range(60).select(F.col("id").alias("entry_id"), F.concat(F.lit("h"), "id").alias("href"), F.lit("").alias("title"),
                                 F.lit("").alias("section"), F.concat(F.lit("a common w"), "id").alias("text"))
    q = spark.createDataFrame([(i, f"common w{i}") for i in range(8)] + [(3, "common"), (9, "a common w"), (None, "common")],
                              "query_id long, query string")
    few = rows(searchindex.search(idx, q))
    monkeypatch.setattr(searchindex, "FEW", 0)
    many = searchindex.search(idx, q)
    assert rows(many) == few
    joins = [line for line in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "entry_id" in joins[0] and "query_id" in joins[1]


def test_postings_are_rows_of_blocks(spark):
    """A word of many entries takes a row a block, so little is dealt and sorted when they are written."""
    idx = spark.range(0, 3000, 1, 2).select(F.col("id").alias("entry_id"), F.lit("h").alias("href"), F.lit("").alias("title"),
                                            F.lit("").alias("section"), F.concat(F.lit("some common w"), F.col("id") % 7).alias("text"))
    index = searchindex.build_search_index(idx)
    by = {r["word"]: r["n"] for r in index.postings.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(by.values()) <= 8 and set(by) == {"", "some", "common", *(f"w{i}" for i in range(7))}
    assert {r["word"]: r["held"] for r in index.words.collect()}["common"] == 3000


def test_search_of_blocks_against_every_pair(spark, monkeypatch):
    """Small blocks, dealt lists, words that few and many entries hold, ids and queries that repeat or are NULL."""
    for name, value in (("BLOCK", 40), ("LONG", 2), ("HOT", 6), ("ENOUGH", 3)):
        monkeypatch.setattr(searchindex, name, value)
    texts = [" ".join(f"w{(i * k) % m}" for k, m in ((1, 5), (2, 3), (3, 11), (1, 7), (5, 4), (7, 13))) for i in range(90)] + ["", None, "W1 w2  w3"]
    entries = [(i if i % 20 else (None if i == 20 else 7), f"h{i}", "a title" if i % 9 == 0 else None, "", t) for i, t in enumerate(texts)]
    asked = [t[2:n] for t in texts[:40:3] for n in (12, 15, len(t))] + ["w1", "w2 w0", "a t", "a nowhere b", "x w1 y", "1 W", "W2  w3", "le"]
    queries = [(None if i == 4 else i % 30, t) for i, t in enumerate(asked + asked[:5])]
    df = spark.createDataFrame(entries, "entry_id long, href string, title string, section string, text string")
    got = searchindex.search(df, spark.createDataFrame(queries, "query_id long, query string"), limit=None)
    want = [(q, t, e, h, sum(w for f, w in ((title, 20), (text, 10)) if t.lower() in (f or "").lower()))
            for q, t in queries if q is not None for e, h, title, _, text in entries if e is not None]
    assert rows(got, "query_id", "query", "entry_id", "href", "score") == sorted(r for r in want if r[4])


def test_search_of_more_candidates_than_entries(spark, monkeypatch):
    """Common words: entries are read once for a part of the queries, candidates are not written for each of them."""
    texts = [" ".join(f"w{(i * k) % m}" for k, m in ((1, 5), (2, 3), (3, 11), (1, 7), (5, 4), (7, 13))) for i in range(90)] + ["", None, "W1 w2  w3", "Ünï w1 日本 w2"]
    entries = [((i // 7, i % 7) if i % 20 else (3, 3), f"h{i}", "a title" if i % 9 == 0 else None, "", t) for i, t in enumerate(texts)]
    asked = [t[2:n] for t in texts[:60:3] for n in (12, 15, len(t))] + ["w1", "w2 w0", "a t", "a nowhere b", "x w1 y", "1 W", "W2  w3", "le", "ï W1 日本", "  "]
    queries = [(None if i == 4 else i % 30, t) for i, t in enumerate(asked + asked[:5])]
    df = spark.createDataFrame(entries, "entry_id struct<a: long, b: long>, href string, title string, section string, text string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    index, passes = searchindex.build_search_index(df), []
    want = sorted((q, t, e, h, s) for q, t in queries if q is not None for e, h, title, _, text in entries
                  if (s := sum(w for f, w in ((title, 20), (text, 10)) if t.lower() in (f or "").lower())))
    real = searchindex.anchors.wanted
    monkeypatch.setattr(searchindex.anchors, "wanted", lambda texts: passes.append(len(texts)) or real(texts))
    for name, value in (("CANDIDATES", 20), ("PART", 200)):
        monkeypatch.setattr(searchindex, name, value)
    some = q.where("query <> '  '")
    got = searchindex.search(index, some, limit=None)
    assert rows(got, "query_id", "query", "entry_id", "href", "score") == [r for r in want if r[1] != "  "]
    assert len(passes) > 2 and sum(passes) == some.select(F.lower("query")).distinct().count()
    best = rows(searchindex.search(index, some, limit=4), "query_id", "rank", "entry_id", "score")
    monkeypatch.setattr(searchindex, "CANDIDATES", 1 << 40)
    assert best == rows(searchindex.search(index, some, limit=4), "query_id", "rank", "entry_id", "score")
    assert rows(searchindex.search(index, q, limit=None), "query_id", "query", "entry_id", "href", "score") == want


def test_anchors_against_every_pair(monkeypatch):
    """Texts of all widths, one inside another, at the ends and over the edge of a text, in small chunks."""
    from slotvalue.operators import anchors
    rng = np.random.default_rng(3)
    long = ["".join(rng.choice(list("abé "), n)) for n in (0, 1, 5, 40, 0, 300, 64, 2)] + ["site - " * 9 + "x", ""]
    short = sorted({t[a:a + n] for t in long for a in range(0, len(t), 7) for n in (1, 2, 3, 4, 5, 8, 9, 17, 33, 70)} | {"zz", "site - site - site - site - site - site"})
    wanted = anchors.wanted([t.encode() for t in short])
    want = [(i, j) for i, t in enumerate(long) for j, w in enumerate(short) if w in t]
    for size in (1 << 20, 16):
        monkeypatch.setattr(anchors, "CHUNK", size)
        field, text = wanted.found(*anchors.padded([pa.array(long[:4]), pa.array(["no", *long[4:]])[1:]]))
        assert list(zip(field.tolist(), text.tolist())) == want
    assert not len(anchors.wanted([]).found(*anchors.padded([pa.array([""])]))[0])
