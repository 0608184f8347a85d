"""Tables from runs: bands against placing by hand, planted tables among prose, matching against trying in order."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions.text import is_numeric_cell
from leafmill.operators import layout as ly
from leafmill.operators import tables as tb


@pytest.mark.parametrize("text,want", [(t, True) for t in ("13,756", "(8,953)", "$ 2,701", "58%", "0.43", "—", "--", "¥5", "12ms", "3k", "2×", "−4", " 7 ")] + [(t, False) for t in ("", " ", "a1", "1.2.3", "12 apples", "MS", "1e5")])
def test_numbers(spark, text, want):
    assert spark.range(1).select(is_numeric_cell(F.lit(text))).first()[0] is want


def bands_by_hand(cells):
    """{(row, cell): band} of one block of (row, cell, text, x0, x1), em 3; None where a row breaks the grid."""
    firsts = [c for c in cells if c[1] == 0]
    edge = min((c[3] for c in cells if c[1] > 0), default=float("inf"))
    labels = [c for c in firsts if c[3] < edge - 4.5]
    words = min((c[3] for c in labels if not c[2].isdigit()), default=float("inf"))
    labels = [c for c in labels if not c[2].isdigit() or c[3] <= words + 9]
    body = [c for c in cells if c not in labels]
    if not body:
        return None
    per = {r: [c for c in body if c[0] == r] for r in {c[0] for c in body}}
    most = max(map(len, per.values()))

    def clusters(some):
        out = []
        for c in sorted(some, key=lambda c: (c[3], c[0], c[1])):
            if out and c[3] <= max(x[4] for x in out[-1]) - 0.2:
                out[-1].append(c)
            else:
                out.append([c])
        return out if all(len({x[0] for x in k}) == len(k) for k in out) else None

    finest = sorted(r for r in per if len(per[r]) == most)
    groups, used = clusters([c for r in finest for c in per[r]]), set(finest)
    if groups is None:
        groups, used = clusters(per[finest[0]]), {finest[0]}
    if groups is None:
        return None
    bands = [{"x0": min(c[3] for c in k), "x1": max(c[4] for c in k), "in": list(k)} for k in groups]
    for c in (c for r in sorted(per) if r not in used for c in sorted(per[r], key=lambda c: c[1])):
        share = [min(c[4], b["x1"]) - max(c[3], b["x0"]) for b in bands]
        free = [i for i, b in enumerate(bands) if all(x[0] != c[0] for x in b["in"]) and share[i] > 0]
        if free:
            b = bands[max(free, key=lambda i: (share[i], -i))]
            b["in"].append(c)
            if sum(c[3] < x["x1"] - 0.2 and c[4] > x["x0"] + 0.2 for x in bands) <= 1:
                b["x0"], b["x1"] = min(b["x0"], c[3]), max(b["x1"], c[4])
        elif any(s > (c[4] - c[3]) / 2 for s in share):
            return None
        else:
            bands.append({"x0": c[3], "x1": c[4], "in": [c]})
    done = []
    for b in sorted(bands, key=lambda b: (b["x0"], b["x1"])):
        if done and not {c[0] for c in done[-1]["in"]} & {c[0] for c in b["in"]} and b["x0"] - done[-1]["x1"] <= 4.5:
            done[-1]["in"] += b["in"]
            done[-1]["x1"] = max(done[-1]["x1"], b["x1"])
        else:
            done.append(b)
    out = {(c[0], c[1]): 0 for c in labels}
    return out | {(c[0], c[1]): i + bool(labels) for i, b in enumerate(done) for c in b["in"]}


def test_bands_equal_placing_by_hand(spark):
    rng, blocks = random.Random(4), {}
    for block in range(300):
        edges = sorted(rng.sample(range(30, 200, 10), rng.randint(1, 5)))
        cells = []
        for row in range(rng.randint(1, 7)):
            own = []
            if rng.random() < 0.7:
                own.append(("12" if rng.random() < 0.2 else "name", float(rng.choice([5, 5, 8, 20])), float(rng.choice([18, 25, 60]))))
            for e in edges:
                if rng.random() < 0.8:
                    w = rng.choice([6, 8, 12, 25])
                    own.append((rng.choice(["1", "x"]), e - w + rng.random(), e + rng.random()))
            own.sort(key=lambda c: c[1])
            cells += [(row, i, *c) for i, c in enumerate(own)]
        if cells:
            blocks[block] = cells
    df = spark.createDataFrame([(b, *c, 3.0) for b, cells in blocks.items() for c in cells], "block int, row int, cell int, text string, x0 double, x1 double, em double")
    got = {b: {} for b in blocks}
    for r in tb.banded(df, ["block"]).collect():
        got[r.block][r.row, r.cell] = r.band
    for b, cells in blocks.items():
        want = bands_by_hand(cells) or {(c[0], c[1]): None for c in cells}
        assert got[b] == want, (b, cells)
    assert 30 < sum(bands_by_hand(c) is None for c in blocks.values()) < 270


def page(rng, number, kind):
    """(runs, grid or None) of a page of prose, with a table in it or two columns of prose."""
    runs, y = [], 20.0
    say = lambda x, text, bold=False: runs.append((number, len(runs), text, float(x), y, len(text) * 1.76, 4.0, 10.0, bold))
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "and"]) for _ in range(n))
    for _ in range(rng.randint(0, 4)):
        say(20, prose(12))
        y += 5
    grid = None
    if kind == "columns":
        for _ in range(25):
            say(20, prose(6)[:38])
            say(110, prose(6)[:38])
            y += 5
    elif kind == "table":
        y += 12
        xs = [20, 75, 105, 140, 170][: rng.randint(3, 5)]
        grid = [["Name of it", "Count", "Price in $", "Share", "Mark"][: len(xs)]]
        for i in range(rng.randint(2, 29)):
            grid.append([f"thing {i}", str(rng.randint(1, 99)), f"${rng.randint(1, 9)},{rng.randint(100, 999)}.00", f"{rng.randint(0, 99)}%", rng.choice(["yes", "no"])][: len(xs)])
        for i, row in enumerate(grid):
            for x, v in zip(xs, row):
                say(x, v, i == 0)
            if 0 < i < len(grid) - 1 and rng.random() < 0.15:  # the label goes on in a second line
                y += 5
                say(20, "and more")
                row[0] += " and more"
            y += 5
        y += 12
    for _ in range(rng.randint(1, 6)):
        say(20, prose(12))
        y += 5
    return runs, grid


def test_planted_tables(spark):
    rng = random.Random(6)
    pages = [page(rng, i, ["table", "table", "prose", "columns"][i % 4]) for i in range(80)]
    df = spark.createDataFrame([r for runs, _ in pages for r in runs], "page int, run_idx int, text string, x double, y double, width double, height double, font_size double, bold boolean")
    gutter = spark.createDataFrame([(i, 95.0, 108.0) for i in range(3, 80, 4)], "page int, left double, right double")
    got = {r.page: r for r in tb.detect_tables(df, ["page"], gutters=gutter).collect()}
    assert {i for i, (_, grid) in enumerate(pages) if grid} == set(got)
    for i, r in got.items():
        assert [list(x) for x in r.rows] == pages[i][1] and r.header_rows == 1 and [c.numeric for c in r.columns][1:4] == [True] * (min(4, len(r.columns)) - 1)
    assert tb.detect_tables(df.limit(0), ["page"]).count() == 0


def test_rules_make_a_small_table(spark):
    runs = [(1, i, text, float(x), float(y), 10.0, 4.0, 10.0, False) for i, (text, x, y) in enumerate([("a", 20, 30), ("b", 60, 30), ("c", 20, 36), ("d", 60, 36), ("x", 20, 100), ("y", 60, 100), ("z", 20, 106), ("w", 60, 106)])]
    df = spark.createDataFrame(runs, "page int, run_idx int, text string, x double, y double, width double, height double, font_size double, bold boolean")
    shapes = spark.createDataFrame([(1, x, 28.0, 0.2, 14.0) for x in (18.0, 55.0, 75.0)], "page int, x double, y double, width double, height double")
    assert tb.detect_tables(df, ["page"]).count() == 0
    assert [[list(x) for x in r.rows] for r in tb.detect_tables(df, ["page"], shapes=shapes).collect()] == [[["a", "b"], ["c", "d"]]]


def test_cells_join_and_part(spark):
    runs = [("HR", 20, 5), ("& benefits", 26, 20), ("$", 60, 2), ("2,701", 75, 10), ("11", 90, 4), ("12", 96, 4), (" ", 100, 40), ("€", 120, 2), ("word", 124, 8)]
    df = spark.createDataFrame([(1, i, t, float(x), 10.0, float(w), 4.0, 10.0, False) for i, (t, x, w) in enumerate(runs)] + [(1, 99, "lost", None, 10.0, 1.0, 4.0, 10.0, False)], "page int, run_idx int, text string, x double, y double, width double, height double, font_size double, bold boolean")
    assert [(r.text, r.members) for r in tb.page_cells(df, ["page"]).orderBy("cell").collect()] == [("HR & benefits", [0, 1]), ("$ 2,701", [3, 2]), ("11", [4]), ("12", [5]), ("€", [7]), ("word", [8])]


def test_glyph_width(spark):
    rows = [(1, "abc", w) for w in (3.0, 4.0, 5.0, 6.0)] + [(2, "abc", 3.0), (3, "abc", 30.0), (3, "abc", 30.0), (3, "abc", 30.0), (3, "abc ", 1.0)]
    got = {r.page: r.k for r in tb.glyph_width(spark.createDataFrame([(*r, 10.0) for r in rows], "page int, text string, width double, font_size double"), ["page"]).collect()}
    assert got == pytest.approx({1: 5.0 / (30 * ly.MM), 2: 0.55, 3: 0.7})


def scores_by_hand(truth, got):
    taken, pairs = set(), []
    norm = lambda g: [[" ".join(x.split()).lower() for x in r] for r in g]
    for name, grid in truth:
        want = [x for r in norm(grid) for x in r]
        rated = [(sum(x in {y for r in norm(g) for y in r} for x in want), -i) for i, (_, g) in enumerate(got) if i not in taken]
        score, i = max(rated, default=(0, 0))
        hit = -i if score > 0 and score * 2 >= len(want) else None
        taken.add(hit)
        pairs.append((norm(grid), norm(got[hit][1]) if hit is not None else None))
    ok = lambda a, b: sum(b is not None and i < len(b) and j < len(b[i]) and b[i][j] == x for i, r in enumerate(a) for j, x in enumerate(r))
    cells = lambda g: sum(map(len, g))
    return (len(pairs), sum(b is not None for _, b in pairs), sum(a == b for a, b in pairs), sum(b is not None and a[0] == b[0] for a, b in pairs), sum(cells(a) for a, _ in pairs), sum(ok(a, b) for a, b in pairs), len(got) - sum(b is not None for _, b in pairs))


def test_scores_of_shuffled_merged_and_split_tables(spark):
    rng = random.Random(8)
    for _ in range(6):
        grid = lambda: [[rng.choice(["A", "b ", "c  d", "1", "2", ""]) + str(rng.randint(0, 9)) for _ in range(3)] for _ in range(rng.randint(2, 5))]
        truth = [(i, grid()) for i in range(6)]
        read = [g for _, g in truth]
        read = [read[0], read[1] + read[2], read[3][:1], read[3][1:], [list(reversed(r)) for r in read[4]], grid()]
        rng.shuffle(read)
        got = list(enumerate(read))
        rows = lambda ts: spark.createDataFrame([("f", n, i, j, x) for n, g in ts for i, r in enumerate(g) for j, x in enumerate(r)], "file string, table int, row int, column int, text string")
        assert tuple(tb.table_scores(rows(truth), rows(got), "file").first()) == scores_by_hand(truth, got)


def test_cells_are_never_broadcast(spark, tmp_path):
    """A side's size is told by its files, in which a page's cells are a small array: as rows they are many."""
    from leafmill.sources.shared import written

    cells = spark.range(4000).selectExpr("id div 40 as page", "int(id % 40 div 4) as row", "int(id % 4) as cell", "if(id % 4 = 0, 'a', '1') as text", "double(10 + 30 * (id % 4)) as x0", "double(20 + 30 * (id % 4)) as x1", "3.0D as em")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    got = tb.banded(written(cells, "few"), ["page"])
    assert "Broadcast" not in plan(got) and got.where("band = cell").count() == 4000
    runs = written(cells.selectExpr("page", "row * 4 + cell as run_idx", "text", "x0 as x", "double(row * 6) as y", "10.0D as width", "4.0D as height", "10.0D as font_size", "row = 0 as bold"), "runs")
    found = tb.detect_tables(runs, ["page"])
    assert "Broadcast" not in plan(found) and "Broadcast" not in plan(tb.page_cells(runs, ["page"])) and found.count() == 100


def test_scores_move_cells_once(spark):
    """Cells were joined at each step, so a table's texts were shuffled eight times."""
    truth = spark.range(400).selectExpr("id div 80 as doc", "id div 8 as table", "int(id % 8 div 2) as row", "int(id % 2) as column", "concat('t', id) as text")
    got = truth.where("table % 5 <> 0").selectExpr("doc", "table", "row", "column", "if(table % 7 = 1 and row = 0, 'x', text) as text").where("not (table % 3 = 1 and row = 3)")
    scores = tb.table_scores(truth, got, "doc")
    lost, bad = lambda i: i % 3 == 1, lambda i: i % 7 == 1
    some = [i for i in range(50) if i % 5]
    assert scores.first().asDict() == dict(
        tables=50, found=len(some), exact=sum(not lost(i) and not bad(i) for i in some), headers=sum(not bad(i) for i in some), cells=400, cells_right=sum(8 - 2 * lost(i) - 2 * bad(i) for i in some), extra=0
    )
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "RepartitionByExpression" not in plan  # written before


def _moves(d):
    """(exchanges, joins) of a plan before it runs."""
    plan = d._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Join")


def test_blocks_of_dealt_cells_move_no_more(spark):
    """Cells were worked out again and joined with their bands and by their blocks, which shuffled them three times."""
    cells = spark.range(4000).selectExpr("id div 40 as page", "int(id % 40 div 4) as row", "int(id % 4) as cell", "if(id % 4 = 0, 'a', '1') as text", "double(10 + 30 * (id % 4)) as x0", "double(20 + 30 * (id % 4)) as x1", "3.0D as em", "id as mark")
    got = tb.banded(cells.repartition(5, "page"), ["page"])
    assert _moves(got) == (1, 0)
    assert got.columns == [*cells.columns, "band"] and got.where("band = cell and mark = page * 40 + row * 4 + cell").count() == 4000


def test_runs_of_dealt_pages_move_no_more(spark):
    """Runs were joined with their widths, rows and blocks, each time by another shuffle."""
    rng = random.Random(9)
    runs = [r for i in range(20) for r in page(rng, i, ["table", "prose"][i % 2])[0]] + [(None, 1, "no page", 1.0, 1.0, 5.0, 4.0, 10.0, False)]
    df = spark.createDataFrame(runs, "page int, run_idx int, text string, x double, y double, width double, height double, font_size double, bold boolean")
    once = tb.column_bands(tb._blocks(tb.page_cells(df.repartition(5, "page"), ["page"]), ["page"]), ["page", "block"], ["row", "cell", "text"])
    assert _moves(once) == (1, 0)
    assert {r.page for r in once.where("broken is null").collect()} >= set(range(0, 20, 2))
    plans = tb.detect_tables(df, ["page"])
    assert _moves(plans)[1] == 0 and {r.page for r in plans.collect()} == set(range(0, 20, 2))


def test_parted_blocks_keep_all_columns(spark):
    """A block that a row breaks is parted, and its parts have all that its cells had."""
    grid = [(r, c, "1" if c else "a", 20.0 + 30 * c, 30.0 + 30 * c) for r in range(4) for c in range(3)]
    grid += [(4, 0, "b", 20.0, 22.0), (4, 1, "2", 23.0, 26.0), (4, 2, "3", 27.0, 30.0)] + [(r, c, "1" if c else "a", 20.0 + 30 * c, 30.0 + 30 * c) for r in range(5, 8) for c in range(3)]
    df = spark.createDataFrame([(1, "k", *c, 3.0, f"m{c[0]}{c[1]}") for c in grid], "page int, block string, row int, cell int, text string, x0 double, x1 double, em double, mark string")
    assert tb.column_bands(df, ["page", "block"]).where("broken is not null").count() == 1
    blocks = tb._parted(df, ["page"])
    kept = [f.name for f in blocks.schema["own"].dataType.elementType]
    cells = tb._seated(blocks, ["page", "block"], kept).collect()
    assert len(blocks.collect()) > 1 and all(c.mark == f"m{c.row}{c.cell}" and c.band is not None for c in cells)
    assert {(c.row, c.cell) for c in cells if c.row < 4} == {(r, c) for r in range(4) for c in range(3)}


def test_scores_of_dealt_cells_stay(spark):
    """Cells dealt by document were shuffled again, and all gathered twice: by text and table, then by text."""
    truth = spark.range(960).selectExpr("id div 240 as doc", "id div 8 as table", "int(id % 8 div 2) as row", "int(id % 2) as column", "if(id % 3 = 0, ' Same  text', concat('t', id)) as text").repartition(5, "doc")
    got = truth.where("table % 5 <> 0").withColumn("text", F.expr("if(text like 't%', upper(text), 'same text\t')"))
    plan = tb._met(truth, got, "doc", True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") == 2 and plan.count(" ObjectHashAggregate") == 2
    assert tb.table_scores(truth, got, "doc", dealt=True).first() == tb.table_scores(truth, got, "doc").first()
    assert tb.table_scores(truth, got, "doc", dealt=True).select("tables", "found", "exact", "extra").first() == (120, 96, 96, 0)
