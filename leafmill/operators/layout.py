"""Layout from positioned runs: gutters, reading order, islands, nearest joins, page flow, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import fold_items
from ..functions.text import trim_all
from ..sources.shared import sorted_join, written
from .chunking import greedy


def covered_stretches(intervals: DataFrame, by: list[str], lo: str, hi: str, step: float = 0.5) -> DataFrame:
    """(by, bin, until, covered): intervals over the bins from bin to before until, from one row up and one down for each
    interval and a running sum, so an interval's width costs nothing."""
    a, z = F.floor(F.col(lo) / step).cast("long"), F.ceil(F.col(hi) / step).cast("long")
    turns = intervals.select(*by, F.explode(F.array(F.struct(a.alias("bin"), F.lit(1).alias("d")), F.struct(z.alias("bin"), F.lit(-1).alias("d")))).alias("t")).groupBy(*by, "t.bin").agg(F.sum("t.d").alias("d"))
    w = Window.partitionBy(*by).orderBy("bin") if by else Window.partitionBy(F.lit(0)).orderBy("bin")
    steps = turns.withColumn("covered", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("bin").over(w))
    return steps.where("until is not null").select(*by, "bin", "until", "covered")


def coverage(intervals: DataFrame, by: list[str], lo: str, hi: str, step: float = 0.5) -> DataFrame:
    """(by, bin, covered): intervals over each bin, a row a bin."""
    return covered_stretches(intervals, by, lo, hi, step).select(*by, F.explode(F.sequence("bin", F.col("until") - 1)).alias("bin"), "covered")


def islands(rows: DataFrame, by: list[str], order: str, joins: Column) -> DataFrame:
    """rows with island: a running number that grows where joins (over the row before, by lag) does not hold."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gutters(lines: DataFrame, page_width: float, page: str = "page", step: float = 0.5) -> DataFrame:
    """(page, left, right): blank strips between the text columns of pages, in mm.

    lines: (page, text, x, width, font_size, body), body the size of the page's running text. Only lines of that size
    (1.5 points more or less) narrower than 0.6 of the page count; a page needs twelve of them over 0.4 of its width. A
    strip is 3 mm wide or more, lies 0.15 of the text's width inside it, and 5 % of the lines, two at least, may cross
    it. All strips of a page go if one of them has less than four lines wholly on either side.
    """
    x, end = F.col("x").cast("double"), F.col("x").cast("double") + F.col("width")
    body = lines.where((F.trim("text") != "") & (F.abs(F.col("font_size") - F.col("body")) <= 1.5) & (F.col("width") > 0) & (F.col("width") < page_width * 0.6)).select(page, x.alias("x"), end.alias("end"))
    # The page's numbers go along as keys, and stretches of equal cover stay whole: nothing is joined or sorted by bins.
    all_of, sized = Window.partitionBy(page), [page, "n", "from", "to"]
    own = body.select(page, "x", "end", F.count("*").over(all_of).alias("n"), F.min("x").over(all_of).alias("from"), F.max("end").over(all_of).alias("to"))
    own = own.where((F.col("n") >= 12) & (F.col("to") - F.col("from") >= page_width * 0.4)).select(*sized, (F.col("x") - F.col("from")).alias("x"), (F.col("end") - F.col("from")).alias("end"))
    low = covered_stretches(own, sized, "x", "end", step).where(F.col("covered") <= F.greatest(F.lit(2.0), F.floor(F.col("n") * 0.05 + 0.5)))
    low = islands(low, sized, "bin", F.col("bin") == F.lag("until").over(Window.partitionBy(*sized).orderBy("bin")))
    g = low.groupBy(page, "from", "to", "island").agg((F.col("from") + F.min("bin") * step).alias("left"), (F.col("from") + F.max("until") * step).alias("right"))
    margin = (F.col("to") - F.col("from")) * 0.15
    g = g.where((F.col("right") - F.col("left") >= 3) & (F.col("left") > F.col("from") + margin) & (F.col("right") < F.col("to") - margin)).select(page, "left", "right")
    sides = sorted_join(body, g, page).groupBy(page, "left", "right").agg(F.count_if(F.col("end") <= F.col("left") + 0.5).alias("before"), F.count_if(F.col("x") >= F.col("right") - 0.5).alias("after"))
    solid = sides.withColumn("least", F.min(F.least("before", "after")).over(Window.partitionBy(page)))
    return solid.where("least >= 4").select(page, "left", "right")


def reading_order(boxes: DataFrame, gutter: DataFrame, page_width: float, page: str = "page", order: str = "idx") -> DataFrame:
    """boxes (page, order, x, y, width) with place: by columns on pages with gutters, in the order given elsewhere.

    A box stands in the column that holds its left edge, or the nearest. It spans columns if it reaches beyond the middle
    of the next one; what spans parts the page in bands, read one after another, within them column by column, each from
    the top. A page has few gutters, gathered in its row and written first, so that what finds them and what orders boxes
    never hold memory in one task.
    """
    g = gutter.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("g"))
    edges = F.concat(F.array(F.lit(0.0)), F.transform("g", lambda q: q["right"].cast("double"))), F.concat(F.transform("g", lambda q: q["left"].cast("double")), F.array(F.lit(float(page_width))))
    g = written(g.select(page, F.zip_with(*edges, lambda a, z: F.struct(a.alias("x0"), z.alias("x1"))).alias("columns")), "columns")
    x = F.coalesce(F.col("x").cast("double"), F.lit(0.0))
    off = F.transform("columns", lambda c, i: F.struct(F.when((x >= c["x0"]) & (x < c["x1"]), -1.0).otherwise(F.least(F.abs(x - c["x0"]), F.abs(x - c["x1"]))).alias("off"), i.alias("i")))
    b = sorted_join(boxes, g, page, "left").withColumn("column", F.array_min(off)["i"])
    following = F.get("columns", F.col("column") + 1)
    # The columns themselves are left behind before anything is sorted: a page without gutters has no column.
    b = b.withColumn("spans", F.coalesce(x + F.coalesce("width", F.lit(0.0)) > (following["x0"] + following["x1"]) / 2, F.lit(False))).drop("columns")
    top = [F.coalesce("y", F.lit(0.0)), x, F.col(order)]
    before = Window.partitionBy(page).orderBy(*top).rowsBetween(Window.unboundedPreceding, 0)
    several = F.col("column").isNotNull()
    b = b.withColumn("band", F.when(several, 2 * F.sum(F.col("spans").cast("int")).over(before) - F.col("spans").cast("int")))
    by = [F.when(several, c) for c in (F.col("band"), F.when(F.col("spans"), 0).otherwise(F.col("column")), *top)]
    return b.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(*by, order))).drop("column", "spans", "band")


def next_on_line(runs: DataFrame, by: list[str], key: str, near: float = 20.0) -> DataFrame:
    """runs (by, key, x, y, font_size, rotated) with next: the nearest run to the right (the first by key of equals) no
    further up or down than half the larger of both sizes, 0.6 mm at least; rotated runs have none and are none.

    Runs meet in strips as high as half the largest size of their page, first within `near` mm to the right; only those
    that find none there are held against their whole strips.
    """
    some = runs.where(~F.coalesce("rotated", F.lit(False)) & F.col("x").isNotNull() & F.col("y").isNotNull())
    some = some.select(*by, F.col(key).alias("_k"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), F.coalesce("font_size", F.lit(0.0)).cast("double").alias("_s"))
    high = some.groupBy(*by).agg(F.greatest(F.lit(0.6), F.max("_s") * MM * 0.5).alias("_h"))
    some = some.join(high, by).withColumn("_strip", F.floor(F.col("_y") / F.col("_h"))).withColumn("_cell", F.floor(F.col("_x") / near))
    other = some.select(*by, "_strip", "_cell", *(F.col(c).alias(f"{c}2") for c in ("_k", "_x", "_y", "_s")))
    fits = (F.col("_x2") > F.col("_x")) & (F.abs(F.col("_y2") - F.col("_y")) <= F.greatest(F.lit(0.6), F.greatest("_s", "_s2") * MM * 0.5))
    strips = F.explode(F.array(*(F.col("_strip") + i for i in (-1, 0, 1))))
    best = F.min(F.struct("_x2", "_k2"))["_k2"].alias("next")
    cells = F.explode(F.array(F.col("_cell"), F.col("_cell") + 1))
    ask = some.withColumn("_strip", strips)
    close = ask.withColumn("_cell", cells).join(other, [*by, "_strip", "_cell"]).where(fits).groupBy(*by, "_k").agg(best)
    rest = ask.drop("_cell").join(close, [*by, "_k"], "left_anti").join(other.drop("_cell"), [*by, "_strip"]).where(fits).groupBy(*by, "_k").agg(best)
    return runs.join(close.unionByName(rest).withColumnRenamed("_k", key), [*by, key], "left")


def rule_edges(rules: DataFrame, by: list[str], least: Column, near: float = 1.0) -> DataFrame:
    """(by, x): where upright rules (x, width, height) less than `near` mm apart add up to the height least (a column of rules, or a number)."""
    at = rules.where("height > width").select(*by, (F.col("x") + F.col("width") / 2).alias("x"), "height", least.alias("_least"))
    w = Window.partitionBy(*by).orderBy("x")
    at = islands(at, by, "x", F.col("x") - F.lag("x").over(w) < near)
    return at.groupBy(*by, "island").agg(F.min("x").alias("x"), F.sum("height").alias("_sum"), F.max("_least").alias("_least")).where("_sum >= _least").select(*by, "x")


def containing(points: DataFrame, intervals: DataFrame, by: list[str], value: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """points joined with the intervals (by, lo, hi, ...) that hold their value, lo < value < hi.

    Each interval lies in two cells at most of the power of two that is no less than its length; a point looks into one
    cell for each such size that its group has. So it is an equi-join whatever the lengths, not one of all with all.
    """
    size = F.when(F.col(hi) > F.col(lo), F.ceil(F.log2((F.col(hi) - F.col(lo)).cast("double"))).cast("int"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_size")))
    held = intervals.withColumn("_size", size).where("_size is not null")
    held = held.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(lo), cell(hi)))))
    sizes = held.groupBy(*by).agg(F.collect_set("_size").alias("_sizes"))
    asked = points.join(sizes, by).withColumn("_size", F.explode("_sizes")).drop("_sizes").withColumn("_cell", cell(value))
    return asked.join(held, [*by, "_size", "_cell"]).where((F.col(value) > F.col(lo)) & (F.col(value) < F.col(hi))).drop("_size", "_cell")


def held_values(points: DataFrame, intervals: DataFrame, by: list[str], value: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """intervals with held, how many points of their group they hold (lo < value < hi), and first, the smallest of those;
    without the intervals that hold none.

    No pair is made. Points and ends of one value are one row; these rows are written by ranges of the group and value,
    each range sums up its own points and takes what the ranges before and behind it add from a table of a row a range and
    group. An interval holds the points below its hi less those up to its lo.
    """
    part, v, n = "_part", F.col("_v"), F.col("_n")
    real = lambda c: F.col(c).cast("double").alias("_v")
    held = intervals.where(F.col(lo) < F.col(hi))
    places = points.where(F.col(value).isNotNull()).select(*by, real(value), F.lit(1).alias("_n"))
    for end in (lo, hi):
        places = places.unionByName(held.select(*by, real(end), F.lit(0).alias("_n")))
    places = places.groupBy(*by, "_v").agg(F.sum("_n").alias("_n"))
    places = written(places.repartitionByRange(*by, "_v").withColumn(part, F.spark_partition_id()), "places")
    # What lies behind is a running value from the other end: a frame up to the last row is worked out anew for each row.
    groups, back = Window.partitionBy(*by).orderBy(part), Window.partitionBy(*by).orderBy(F.desc(part))
    earlier = (Window.unboundedPreceding, -1)
    ranges = places.groupBy(*by, part).agg(F.sum("_n").alias("_all"), F.min(F.when(n > 0, v)).alias("_least"))
    ranges = ranges.select(
        *by, part, F.coalesce(F.sum("_all").over(groups.rowsBetween(*earlier)), F.lit(0)).alias("_before"),
        F.last("_least", True).over(back.rowsBetween(*earlier)).alias("_behind"),
    )
    w, down = Window.partitionBy(*by, part).orderBy("_v"), Window.partitionBy(*by, part).orderBy(F.desc("_v"))
    upto = F.col("_before") + F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.coalesce(F.min(F.when(n > 0, v)).over(down.rowsBetween(*earlier)), F.col("_behind"))
    places = sorted_join(places, ranges, [*by, part]).select(*by, "_v", upto.alias("_upto"), (upto - n).alias("_below"), following.alias("first"))
    out = held.withColumn("_lo", F.col(lo).cast("double")).withColumn("_hi", F.col(hi).cast("double"))
    out = sorted_join(out, places.select(*by, F.col("_v").alias("_lo"), "_upto", "first"), [*by, "_lo"])
    out = sorted_join(out, places.select(*by, F.col("_v").alias("_hi"), "_below"), [*by, "_hi"])
    out = out.withColumn("held", F.col("_below") - F.col("_upto")).where("held > 0")
    return out.select(*intervals.columns, "held", "first")


def nearest(left: DataFrame, right: DataFrame, key: str, bin_size: float, other: str = "other", penalty: Column | None = None) -> DataFrame:
    """left (key, x, y) with the nearest of right (other, x, y) in the 3 by 3 bins around it, ties by other: an
    equi-join on bins. penalty is added to the squared distance. Rows without a neighbour have null. Without a penalty
    only distinct places meet, each with the smallest other of those that stand there, and key tells rows apart."""
    if penalty is None:
        at = lambda c: c.isNotNull() & F.col(other).isNotNull()
        seats = right.where(at(F.col("x")) & F.col("y").isNotNull()).groupBy("x", "y").agg(F.min(other).alias(other))
        asked = left.where("x is not null and y is not null").select("x", "y").distinct().withColumn("_at", F.struct("x", "y"))
        found = nearest(asked, seats, "_at", bin_size, other, F.lit(0.0)).select("x", "y", other, "distance2")
        return left.join(found, ["x", "y"], "left").select(*left.columns, other, "distance2")
    cell = lambda c: F.floor(F.col(c) / bin_size)
    r = right.select(F.col(other), F.col("x").alias("rx"), F.col("y").alias("ry"), cell("x").alias("bx"), cell("y").alias("by"), *[c for c in right.columns if c not in (other, "x", "y")])
    around = F.array(*(F.struct((cell("x") + i).alias("bx"), (cell("y") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = left.withColumn("b", F.explode(around)).select("*", "b.bx", "b.by").join(r, ["bx", "by"])
    d = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2
    best = near.withColumn("d", d if penalty is None else d + penalty).groupBy(key).agg(F.min(F.struct("d", other)).alias("m"))
    return left.join(best, key, "left").select(*left.columns, F.col(f"m.{other}").alias(other), F.col("m.d").alias("distance2"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place floor(n / 2) in order, from a sorted window: no group is gathered."""
    w = Window.partitionBy(by)
    r = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return r.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(by, F.col(value).alias("median"), F.col("_n").alias("n"))


def dominant(rows: DataFrame, by: str, value: str, weight: Column) -> DataFrame:
    """The value of the largest total weight in each group, ties by value."""
    t = rows.groupBy(by, value).agg(F.sum(weight).alias("w"))
    return t.groupBy(by).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(value).alias("v")))["v"].alias(value))


def flow_pages(rows: DataFrame, key: str, order: str, height: str, page_height: int) -> DataFrame:
    """rows with page_no: elements fill pages greedily in order; one taller than a page has a page of its own."""
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, height))).alias("x"))
    pages = greedy(F.transform("x", lambda r: r[height]), F.lit(page_height))
    got = got.select(key, F.explode(F.arrays_zip(F.transform("x", lambda r: r[order]).alias("o"), pages.alias("p"))).alias("z"))
    return got.select(key, F.col("z.o").alias(order), (F.col("z.p") + 1).alias("page_no"))


def heading_of(size: Column, body: Column, bold: Column, text: Column) -> Column:
    """Level of bold short lines by size or ratio to the body's."""
    ratio = size / body
    return F.when(bold & (F.length(text) <= 120), F.when((size >= 22) | (ratio >= 1.8), 1).when((size >= 17) | (ratio >= 1.35), 2).when((size >= 16) | (ratio >= 1.2), 3))


def links_of(runs: DataFrame, links: DataFrame, page: str = "page") -> DataFrame:
    """runs with the first link rectangle (by link_idx) of their page that holds their centre."""
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = (cx >= F.col("lx")) & (cx <= F.col("lx") + F.col("lw")) & (cy >= F.col("ly")) & (cy <= F.col("ly") + F.col("lh"))
    hit = runs.select(page, "run_idx", "x", "y", "width", "height").join(links, page).where(inside).groupBy(page, "run_idx").agg(F.min_by("target", "link_idx").alias("link"))
    return runs.join(hit, [page, "run_idx"], "left")


def best_overlap(cells: DataFrame, bands: DataFrame, page: str = "page") -> DataFrame:
    """cells with the band of their page that they overlap most, by at least 0.2; ties by band."""
    over = F.least(F.col("x") + F.col("width"), F.col("right")) - F.greatest(F.col("x"), F.col("left"))
    hit = cells.select(page, "cell", "x", "width").join(bands, page).withColumn("o", over).where(F.col("o") >= 0.2)
    return cells.join(hit.groupBy(page, "cell").agg(F.max(F.struct("o", (-F.col("band")).alias("b")))["b"].alias("nb")).select(page, "cell", (-F.col("nb")).alias("band")), [page, "cell"], "left")


def pairwise_agreement(rows: DataFrame, by: str, truth: str, got: str) -> DataFrame:
    """Of the pairs of a group in truth's order, how many stand in that order in got too."""
    a = rows.select(by, F.col(truth).alias("t1"), F.col(got).alias("g1"))
    b = rows.select(by, F.col(truth).alias("t2"), F.col(got).alias("g2"))
    p = a.join(b, by).where("t1 < t2")
    return p.groupBy(by).agg(F.count("*").alias("pairs"), F.count_if(F.col("g1") < F.col("g2")).alias("agreeing"))


#: Millimetres of a point.
MM = 25.4 / 72


def text_rows(runs: DataFrame, by: list[str], order: str, x: str = "x", y: str = "y", font_size: str = "font_size") -> DataFrame:
    """runs with row: from the top, a run joins the last row if it stands no further from that row's first run than 0.35
    of its own font size, or 0.8 mm. An ordered fold over one page's places, which takes the page's runs along in its row,
    so that nothing is joined. Runs of a null place have no row; order tells runs of a page apart."""
    near = F.greatest(F.lit(0.8), F.col(font_size) * MM * 0.35)
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    for c in by:
        placed = placed & F.col(c).isNotNull()
    place = F.when(placed, F.struct(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(order).alias("o"), F.coalesce(near, F.lit(0.8)).alias("near")))
    rest = [c for c in runs.columns if c not in by]
    got = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.struct(*rest).alias("run")))).alias("r"))

    def step(a: Column, r: Column) -> tuple[Column, Column]:
        joins = F.coalesce(F.abs(a["y"] - r["y"]) <= r["near"], F.lit(False)) | r.isNull()
        n = a["n"] + (~joins).cast("int")
        return F.struct(F.when(joins, a["y"]).otherwise(r["y"]).alias("y"), n.alias("n")), F.when(r.isNotNull(), n)

    rows = fold_items(F.transform("r", lambda r: r["at"]), F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("n")), "int", step)["items"]
    # Outer, though there is always a run: else Spark would ask for the size of the fold's items first, and fold twice.
    both = F.explode_outer(F.zip_with("r", rows, lambda r, n: F.struct(r["run"].alias("run"), n.alias("row"))))
    return got.select(*by, both.alias("z")).select(*by, "z.run.*", "z.row").select(*runs.columns, "row")


def match_title(s: Column) -> Column:
    """Lower case letters and digits with single spaces, for comparing titles."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), "[\\s\u00a0]+", " "), r"[^\p{L}\p{N} ]", ""))


def apply_outline(texts: DataFrame, outline: DataFrame, by: list[str], order: str, text: str = "text", y: str = "y", heading: str = "heading") -> DataFrame:
    """texts with heading, toc_entry and toc_level from an outline (by, seq, title, depth): each entry goes to the text of
    its page that says the same (3), begins with it or the other way round (2) or stands in it with 6 letters or more (1);
    of equals to the highest, then the first by order. A text keeps a heading it has; of several entries the first gives
    the heading, the last its entry. Entries and texts meet by equality only: a text gives its beginnings of the lengths
    that titles of its page have, a title its own of the lengths of texts, and titles that find nothing there their parts."""
    e = outline.select(*by, F.col("seq").alias("_seq"), F.trim("title").alias("_title"), match_title(F.col("title")).alias("_want"), F.least(F.lit(6), F.greatest(F.lit(1), F.col("depth"))).cast("int").alias("_level")).where("_want <> ''")
    t = texts.select(*by, F.col(order).alias("_o"), F.coalesce(F.col(y), F.lit(0.0)).alias("_y"), match_title(F.col(text)).alias("_have")).where("_have <> ''")
    seat = F.min("_at").alias("_at")
    said = t.groupBy(*by, "_have").agg(F.min(F.struct("_y", "_o")).alias("_at"))
    asked = e.select(*by, "_want").distinct()
    lengths = lambda d, c: d.groupBy(*by).agg(F.collect_set(F.length(c)).alias("_lengths"))
    shorter = lambda c: F.filter("_lengths", lambda n: n < F.length(c))
    begins = lambda c: F.explode(F.transform(shorter(c), lambda n: F.substring(c, F.lit(1), n)))
    same = asked.join(said.withColumnRenamed("_have", "_want"), [*by, "_want"]).select(*by, "_want", F.lit(3).alias("_s"), "_at")
    longer = said.join(lengths(asked, "_want"), by).select(*by, begins(F.col("_have")).alias("_want"), "_at").groupBy(*by, "_want").agg(seat)
    longer = asked.join(longer, [*by, "_want"]).select(*by, "_want", F.lit(2).alias("_s"), "_at")
    titles = asked.join(lengths(said, "_have"), by)
    head = titles.select(*by, "_want", begins(F.col("_want")).alias("_have")).join(said, [*by, "_have"]).select(*by, "_want", F.lit(2).alias("_s"), "_at")
    near = written(same.unionByName(longer).unionByName(head), "titles")
    want = F.col("_want")
    parts = F.flatten(F.transform(F.filter(shorter(want), lambda n: n >= 6), lambda n: F.transform(F.sequence(F.lit(1), F.length(want) - n + 1), lambda i: F.substring(want, i, n))))
    left = titles.join(near.select(*by, "_want").distinct(), [*by, "_want"], "left_anti")
    inside = left.select(*by, "_want", F.explode(F.array_distinct(parts)).alias("_have")).join(said, [*by, "_have"]).select(*by, "_want", F.lit(1).alias("_s"), "_at")
    hit = e.join(near.unionByName(inside), [*by, "_want"]).select(*by, "_seq", "_title", "_level", "_s", "_at.*")
    best = hit.groupBy(*by, "_seq").agg(F.min(F.struct((-F.col("_s")).alias("s"), "_y", "_o"))["_o"].alias("_o"), F.first("_title").alias("_title"), F.first("_level").alias("_level"))
    given = best.groupBy(*by, "_o").agg(F.min_by("_level", "_seq").alias("_first"), F.max_by("_title", "_seq").alias("toc_entry"), F.max_by("_level", "_seq").alias("toc_level"))
    out = texts.join(given.withColumnRenamed("_o", order), [*by, order], "left")
    return out.withColumn(heading, F.coalesce(heading, "_first")).drop("_first")


#: What two runs must share to be one line, where a page has it.
STYLE = ("face", "color", "italic", "rotation", "opacity")


def merge_lines(runs: DataFrame, by: list[str], order: str, near: float = 0.6) -> DataFrame:
    """(by, order, text, x, y, width, font_size, the columns of STYLE there are, bold): runs that follow one another on a
    line put together, under the order of the first.

    A run goes on the line of the one before where style and size (less than 0.4 points apart) are the same, it stands
    no more than `near` mm off, and begins between half an em before that one's end and 0.45 em behind it. More than
    0.08 em is a space, where neither side has one. A currency sign after a number begins anew. Blank runs wider than
    two ems are the space between columns: they go, and part lines; one em on pages of eight blanks and more of which a
    quarter is that wide. Runs are compared with the run before them: a window over a page, no page is gathered.
    """
    style = [c for c in STYLE if c in runs.columns]
    em, text = F.col("font_size") * F.lit(MM), F.col("text")
    page, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    blank = trim_all(text) == ""
    counts = blank & (F.col("width") >= em * 0.5)
    n, wide = F.count_if(counts).over(page), F.count_if(counts & (F.col("width") >= em * 2)).over(page)
    r = runs.where(text != "").withColumn("_gap", F.when((n >= 8) & (wide / n >= 0.25), 1.0).otherwise(2.0))
    r = r.withColumn("_column", blank & (F.col("width") > em * F.col("_gap"))).withColumn("_cut", F.coalesce(before("_column"), F.lit(False))).where("not _column")
    gap = F.col("x") - before(F.col("x") + F.col("width"))
    same = F.lit(True)
    for c in style:
        same = same & F.col(c).eqNullSafe(before(c))
    price = trim_all(text).rlike("^[$€£¥]$") & before("text").rlike(r"[\d)]\s*$")
    joins = same & ~price & ~F.col("_cut") & (F.abs(F.col("y") - before("y")) <= near) & (F.abs(F.col("font_size") - before("font_size")) < 0.4) & gap.between(-em * 0.5, em * 0.45)
    apart = joins & (gap > em * 0.08) & ~before("text").rlike(r"\s$") & ~text.rlike(r"^\s")
    r = islands(r.withColumn("_apart", F.when(apart, " ").otherwise("")), by, order, joins)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat("_apart", "text").alias("t"))))
    first = lambda c: F.min_by(c, order).alias(c)
    bold = F.every(F.coalesce("bold", F.lit(False))) if "bold" in runs.columns else F.lit(False)
    lines = r.groupBy(*by, "island").agg(F.min(order).alias(order), parts.alias("p"), first("x"), first("y"), F.max(F.col("x") + F.col("width")).alias("_end"), first("font_size"), *map(first, style), bold.alias("bold"))
    joined = F.array_join(F.transform("p", lambda q: q["t"]), "")
    return lines.select(*by, order, joined.alias("text"), "x", "y", (F.col("_end") - F.col("x")).alias("width"), "font_size", *style, "bold")


def without_doubles(lines: DataFrame, by: list[str], order: str, back: int = 40) -> DataFrame:
    """lines without those that say the same as one of the `back` lines before, a fraction of a millimetre off: 0.9 down,
    1.3 across, less than 0.6 points of size. Those drawn twice are bold. Lines meet on page, text and a strip of y."""
    w = Window.partitionBy(*by).orderBy(order)
    said = lines.withColumn("_n", F.row_number().over(w)).withColumn("_t", trim_all(F.col("text")))
    facts = said.where("_t != ''").select(*by, "_t", F.col("_n"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), F.col("font_size").cast("double").alias("_s"))
    strip = F.floor(F.col("_y") / 0.9)
    old = facts.select(*by, "_t", *(F.col(c).alias(f"{c}0") for c in ("_n", "_x", "_y", "_s")), F.explode(F.array(strip - 1, strip, strip + 1)).alias("_strip"))
    close = (F.col("_n") - F.col("_n0")).between(1, back) & (F.abs(F.col("_y") - F.col("_y0")) <= 0.9) & (F.abs(F.col("_x") - F.col("_x0")) <= 1.3) & (F.abs(F.col("_s") - F.col("_s0")) < 0.6)
    pairs = facts.withColumn("_strip", strip).join(old, [*by, "_t", "_strip"]).where(close).select(*by, "_n", "_n0")
    marks = pairs.select(*by, "_n", F.lit(True).alias("_twin"), F.lit(False).alias("_drawn")).unionByName(pairs.select(*by, F.col("_n0").alias("_n"), F.lit(False).alias("_twin"), F.lit(True).alias("_drawn")))
    marks = marks.groupBy(*by, "_n").agg(F.max("_twin").alias("_twin"), F.max("_drawn").alias("_drawn"))
    out = said.join(marks, [*by, "_n"], "left").where(~F.coalesce("_twin", F.lit(False)))
    return out.withColumn("bold", F.coalesce("_drawn", F.lit(False)) | (F.coalesce("bold", F.lit(False)) if "bold" in lines.columns else F.lit(False))).drop("_n", "_t", "_twin", "_drawn")


#: What begins a list's item, and what ends a sentence (fixed values).
ITEM_START = r"^\s*(?:[•◦▪●■\-–—*]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|[ivx]{1,4}[.)]\s)"
SENTENCE_END = "[.!?:;][\"'”’)\\]]*$"


def paragraphs(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """lines (text, x, y, width, font_size, face, heading) with paragraph, a running number from 0.

    Whether a line may go on the one before is told by a window over both: face, size, 0.9 to 1.75 line heights apart,
    no heading, blank line or list item, and how the one before ends. How far that one is full depends on the widest
    line of the paragraph so far, and the left edge on its first two: a fold over the page's numbers, not its texts.
    """
    w = Window.partitionBy(*by).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    ends = F.rtrim(before("text"))
    high, drop = before("font_size") * F.lit(MM), F.col("y") - before("y")
    may = F.col("heading").isNull() & before("heading").isNull() & (F.col("face") == before("face")) & (F.abs(F.col("font_size") - before("font_size")) < 0.5) & drop.between(high * 0.9, high * 1.75) & (trim_all(F.col("text")) != "") & ~F.col("text").rlike(ITEM_START)
    # How much of the widest line the one before must fill: nothing after a hyphen or within a sentence that goes on small.
    least = F.when(ends.rlike("[-‐‑]$"), 0.0).when(ends.rlike(SENTENCE_END), 0.85).when(F.ltrim("text").rlike(r"^[a-z(\[]"), 0.0).otherwise(0.6)
    num = lambda c: F.col(c).cast("double")
    r = lines.withColumn("_r", F.struct(F.col(order).alias("o"), F.coalesce(may, F.lit(False)).alias("may"), F.coalesce(least, F.lit(0.0)).alias("least"), num("x").alias("x"), num("width").alias("width"), before("width").cast("double").alias("was")))
    page = r.groupBy(*by).agg(F.array_sort(F.collect_list("_r")).alias("r"))
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(-1).alias("n"), none.alias("first"), none.alias("second"), none.alias("widest"))

    def step(s: Column, q: Column) -> tuple[Column, Column]:
        widest = F.greatest(s["widest"], q["width"])
        edge = F.when(s["second"].isNull(), F.abs(q["x"] - s["first"]) <= 6).otherwise((F.abs(q["x"] - s["first"]) <= 1.2) & (F.abs(q["x"] - s["second"]) <= 1.2))
        on = F.coalesce(q["may"] & edge & (q["was"] >= widest * q["least"]), F.lit(False))
        n = s["n"] + F.when(on, 0).otherwise(1)
        second = F.when(on, F.coalesce(s["second"], q["x"]))
        return F.struct(n.alias("n"), F.when(on, s["first"]).otherwise(q["x"]).alias("first"), second.alias("second"), F.when(on, widest).otherwise(q["width"]).alias("widest")), n

    page = page.select(*by, F.explode(F.arrays_zip(F.transform("r", lambda q: q["o"]).alias("o"), fold_items(F.col("r"), start, "int", step)["items"].alias("n"))).alias("z"))
    return lines.join(page.select(*by, F.col("z.o").alias(order), F.col("z.n").alias("paragraph")), [*by, order])


def merged_paragraphs(numbered: DataFrame, by: list[str], order: str, page_width: float) -> DataFrame:
    """(by, paragraph, lines, text, x, y, width, height, line_height, indent): each paragraph as one box.

    Lines stay lines, their blanks single. The box begins at the leftmost line; a first line further right than 0.5 mm
    gives an indent. Its width is 1.2 times the text's and 0.4 of a line height, within the page. line_height: the mean
    distance of lines in line heights; the box begins half of what that is above one higher. A single line keeps its box.
    """
    high = F.min_by("font_size", order) * F.lit(MM)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.regexp_replace(trim_all(F.col("text")), "[ \t]+", " ").alias("t")))), lambda q: q["t"]), "\n")
    p = numbered.groupBy(*by, "paragraph").agg(
        F.count("*").alias("lines"), text.alias("text"), F.min("x").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"), F.min_by("x", order).alias("x1"), F.min_by("y", order).alias("y1"), F.max_by("y", order).alias("y2"), high.alias("high")
    )
    several = F.col("lines") > 1
    ratio = F.when(several, F.round((F.col("y2") - F.col("y1")) / (F.col("lines") - 1) / F.col("high"), 2)).otherwise(1.0)
    p = p.withColumn("line_height", ratio)
    inset = F.col("x1") - F.col("left")
    width = F.when(several, F.round(F.least(page_width - F.col("left"), (F.col("right") - F.col("left")) * 1.2 + F.col("high") * 0.4), 2)).otherwise(F.col("right") - F.col("left"))
    y = F.when(several, F.round(F.greatest(F.lit(0.0), F.col("y1") - (F.col("line_height") - 1) / 2 * F.col("high")), 2)).otherwise(F.col("y1"))
    return p.select(*by, "paragraph", "lines", "text", F.col("left").alias("x"), y.alias("y"), width.alias("width"), F.round(F.col("lines") * F.col("line_height") * F.col("high"), 2).alias("height"), "line_height", F.when(several & (inset > 0.5), F.round(inset, 2)).alias("indent"))


def wrapped_headings(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """lines (x, y, font_size, heading) with title: a running number that headings share which follow one another, of one
    level, size and left edge, each less than 2.2 lines below the one before; null for lines that are no heading."""
    w = Window.partitionBy(*by).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    drop = F.col("y") - before("y")
    joins = (F.col("heading") == before("heading")) & (F.abs(F.col("font_size") - before("font_size")) < 0.5) & (F.abs(F.col("x") - before("x")) < 1) & (drop > 0) & (drop < F.col("font_size") * MM * 2.2)
    out = islands(lines, by, order, joins)
    return out.withColumn("title", F.when(F.col("heading").isNotNull(), F.col("island"))).drop("island")


def without_widget_values(runs: DataFrame, widgets: DataFrame, by: list[str], key: str) -> DataFrame:
    """runs without those whose centre lies in a form widget (x, y, width, height, value; 1 mm more above and below) of
    their page that holds the same text: joined on page and text, so only equal values meet."""
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    own = runs.withColumn("_t", F.trim("text")).where("_t <> ''").select(*by, key, "_t", cx.alias("_cx"), cy.alias("_cy"))
    w = widgets.select(*by, F.trim("value").alias("_t"), *(F.col(c).alias(f"_w{c}") for c in ("x", "y", "width", "height")))
    hit = own.join(w, [*by, "_t"]).where("_cx between _wx and _wx + _wwidth and _cy between _wy - 1 and _wy + _wheight + 1")
    return runs.join(hit.select(*by, key).distinct(), [*by, key], "left_anti")


def numeric_columns(cells: DataFrame, by: list[str], text: str = "text", least: int = 2, share: float = 0.6) -> DataFrame:
    """(by, filled, numeric, is_numeric): columns of a table where two cells or more, and 60 % of those not blank, are numbers."""
    from ..functions.text import is_numeric_cell

    filled = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    n = cells.groupBy(*by).agg(F.count_if(filled).alias("filled"), F.count_if(filled & is_numeric_cell(F.col(text))).alias("numeric"))
    return n.withColumn("is_numeric", (F.col("numeric") >= least) & (F.col("numeric") >= F.col("filled") * share))


def extent(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, left, top, right, bottom): the smallest box around those of a group."""
    return boxes.groupBy(*by).agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))


def row_pitch(rows: DataFrame, by: str, y: str = "y") -> DataFrame:
    """(by, median, n): the upper median of the distances of neighbouring rows."""
    gaps = rows.withColumn("_g", F.col(y) - F.lag(y).over(Window.partitionBy(by).orderBy(y)))
    return upper_median(gaps, by, "_g")
