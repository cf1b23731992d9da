"""Rectangles and characters on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from readlake.functions import text as X

SAME_AREA = 0.5
CELLS = 16  # grid cells per page side: what two boxes must share before they are compared


def _cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """One row per grid cell a box touches (coordinates are fractions of the page)."""
    at = lambda v: F.least(F.greatest(F.floor(v * CELLS), F.lit(0)), F.lit(CELLS - 1))
    across = df.withColumn("_cx", F.explode(F.sequence(at(x0), at(x1))))
    return across.withColumn("_cy", F.explode(F.sequence(at(y0), at(y1))))


def same_area(a: DataFrame, b: DataFrame, at: list[str]) -> DataFrame:
    """Pairs of rectangle sets on one page covering mostly the same area. `a` has id_a, `b` id_b, both x, y, w,
    h. Boxes meet only where they share a grid cell; each pair of boxes is counted in one of its cells."""
    box = lambda df, name: df.select(*at, F.col(name), *(F.col(c).alias(f"{name}_{c}") for c in "xywh"))
    edge = lambda n, c, d: F.col(f"{n}_{c}") + F.col(f"{n}_{d}")
    ca = _cells(box(a, "id_a"), F.col("id_a_x"), F.col("id_a_y"), edge("id_a", "x", "w"), edge("id_a", "y", "h"))
    cb = _cells(box(b, "id_b"), F.col("id_b_x"), F.col("id_b_y"), edge("id_b", "x", "w"), edge("id_b", "y", "h"))
    met = ca.join(cb, [*at, "_cx", "_cy"])
    first = lambda c: F.least(F.greatest(F.floor(F.greatest(F.col(f"id_a_{c}"), F.col(f"id_b_{c}")) * CELLS), F.lit(0)), F.lit(CELLS - 1))
    met = met.filter((F.col("_cx") == first("x")) & (F.col("_cy") == first("y")))
    w = F.least(edge("id_a", "x", "w"), edge("id_b", "x", "w")) - F.greatest("id_a_x", "id_b_x")
    h = F.least(edge("id_a", "y", "h"), edge("id_b", "y", "h")) - F.greatest("id_a_y", "id_b_y")
    shared = met.groupBy(*at, "id_a", "id_b").agg(F.sum(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))).alias("_shared"))
    areas = lambda df, name: df.groupBy(*at, name).agg(F.sum(F.col("w") * F.col("h")).alias(f"_{name}"))
    out = shared.join(areas(a, "id_a"), [*at, "id_a"]).join(areas(b, "id_b"), [*at, "id_b"])
    ratio = F.col("_shared") / F.nullif(F.least("_id_a", "_id_b"), F.lit(0.0))
    return out.select(*at, "id_a", "id_b", ratio.alias("ratio")).filter(F.col("ratio") >= SAME_AREA)


def inside(cx: Column, cy: Column, x: Column, y: Column, w: Column, h: Column, margin: float) -> Column:
    return cx.between(x - margin, x + w + margin) & cy.between(y - margin, y + h + margin)


def chars_in_boxes(chars: DataFrame, boxes: DataFrame, at: list[str], key: str, margin: float = 0.004, carried: tuple[str, ...] = ()) -> DataFrame:
    """Characters whose middle lies in a block's box, give or take a margin; a character in two boxes of a block counts once. `carried`:
    further columns of the characters to keep. Both sides meet by page, each row sent once; the rows of a page stay together, so that what
    is grouped by page next needs no further shuffle."""
    mid = chars.repartition(*at).select(*at, "ord", *carried, ((F.col("x0") + F.col("x1")) / 2).alias("_mx"), ((F.col("y0") + F.col("y1")) / 2).alias("_my"))
    hit = inside(F.col("_mx"), F.col("_my"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), margin)
    return mid.join(boxes.select(*at, key, *"xywh"), at).filter(hit).select(*at, key, "ord", *carried).distinct()


def lines_of(chars: DataFrame, at: list[str]) -> DataFrame:
    """Characters (ord, x0, y0, x1, y1, with c and line where known) packed, one row per line of a page, a page without lines being one: `ords`
    rising, their corners, and what they say: `said`, or `signs` where a character has several letters. Packed rows come back as they are."""
    if "ords" in chars.columns:
        return chars
    line = F.col("line") if "line" in chars.columns else F.lit(0)
    c = F.col("c") if "c" in chars.columns else F.lit("")
    corners = ("x0", "y0", "x1", "y1")
    rows = chars.select(*at, line.alias("line"), F.struct("ord", c.alias("c"), *corners).alias("_c"))
    rows = rows.groupBy(*at, "line").agg(F.array_sort(F.collect_list("_c")).alias("_c"))
    each = lambda n: F.transform("_c", lambda x: x[n])
    signs = each("c")
    single = F.coalesce(F.forall(signs, lambda c: F.length(c) == 1), F.lit(False))
    return rows.select(
        *at, "line", each("ord").alias("ords"), *(each(n).alias(n) for n in corners),
        F.when(single, F.array_join(signs, "")).alias("said"), F.when(~single, signs).alias("signs"),
    )


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, at: list[str], key: str, margin: float = 0.004, words: bool = True) -> DataFrame:
    """(at, key, ords, said, signs): per page and block, the characters of packed lines whose middle lies in one of the block's boxes, give or
    take a margin, each once and rising; with `words` false only their `ords`. Lines and boxes meet by page, and a line is read for the
    boxes it touches."""
    middle = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2)
    rows = lines.select(*at, "ords", *(["said", "signs"] if words else []), middle("x0", "x1").alias("_mx"), middle("y0", "y1").alias("_my"))
    rows = rows.withColumns({f"_{n}{c}": f(f"_m{c}") for c in "xy" for n, f in (("low", F.array_min), ("high", F.array_max))})
    rows = rows.join(boxes.select(*at, key, *"xywh"), at)
    between = lambda c, d: (F.col(f"_high{c}") >= F.col(c) - margin) & (F.col(f"_low{c}") <= F.col(c) + F.col(d) + margin)
    rows = rows.filter(between("x", "w") & between("y", "h"))
    within = lambda c, d: (F.col(f"_low{c}") >= F.col(c) - margin) & (F.col(f"_high{c}") <= F.col(c) + F.col(d) + margin)
    # A line that lies in a box as a whole is taken as it is; of others, and of those that meet in a block, the characters are looked at.
    carried = [F.coalesce("signs", F.split("said", "")).alias("c")] if words else []
    each = F.arrays_zip(F.col("ords").alias("ord"), *carried, F.col("_mx").alias("x"), F.col("_my").alias("y"))
    held = F.filter(each, lambda z: inside(z["x"], z["y"], F.col("x"), F.col("y"), F.col("w"), F.col("h"), margin))
    if not words:
        rows = rows.select(*at, key, F.when(within("x", "w") & within("y", "h"), F.col("ords")).otherwise(F.transform(held, lambda z: z["ord"])).alias("ords")).filter(F.size("ords") > 0)
        return rows.groupBy(*at, key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ords")))).alias("ords"))
    piece = lambda rows: X.let(rows, _piece)
    some = piece(F.transform(held, lambda z: F.struct(z["ord"].alias("ord"), z["c"].alias("c"))))
    whole = F.struct("ords", "said", "signs")
    rows = rows.select(*at, key, F.when(within("x", "w") & within("y", "h"), whole).otherwise(some).alias("_p")).filter(F.size("_p.ords") > 0)
    rows = rows.groupBy(*at, key).agg(F.collect_list("_p").alias("_p"))
    chars = lambda p: F.transform(F.arrays_zip(p["ords"].alias("ord"), F.coalesce(p["signs"], F.split(p["said"], "")).alias("c")), lambda z: F.struct(z["ord"].alias("ord"), z["c"].alias("c")))
    once = lambda every: F.filter(every, lambda x, i: (i == 0) | (x != F.get(every, i - 1)))
    met = piece(X.let(F.sort_array(F.flatten(F.transform("_p", chars))), once))
    return rows.select(*at, key, F.when(F.size("_p") == 1, F.get("_p", F.lit(0))).otherwise(met).alias("_p")).select(*at, key, "_p.*")


def _piece(chars: Column) -> Column:
    """Characters (ord, c) packed: `said`, or `signs` where one has several letters."""
    signs = F.transform(chars, lambda x: x["c"])
    single = F.coalesce(F.forall(chars, lambda x: F.length(x["c"]) == 1), F.lit(False))
    return F.struct(F.transform(chars, lambda x: x["ord"]).alias("ords"), F.when(single, F.array_join(signs, "")).alias("said"), F.when(~single, signs).alias("signs"))


def stretches(ords: Column) -> Column:
    """Rising numbers as stretches (ord, size) that go on by one."""
    starts = F.filter(F.transform(ords, lambda x, i: F.struct(x.alias("ord"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(ords, x["i"] - 1) + 1 != x["ord"]))
    cut = X.let(starts, lambda s: F.transform(s, lambda x, k: F.struct(x["ord"].alias("ord"), (F.coalesce(F.get(s, k + 1)["i"], F.size(ords)) - x["i"]).alias("size"))))
    low = F.get(ords, F.lit(0))
    return F.when(F.element_at(ords, -1) - low + 1 == F.size(ords), F.array(F.struct(low.alias("ord"), F.size(ords).alias("size")))).otherwise(cut)


def merge_rects(rects: Column) -> Column:
    """One selection's small boxes as one box per line: a box joins the last line when their middles nearly
    agree and the gap is about a space. A fold over one selection's own boxes."""
    keyed = F.transform(
        F.filter(rects, lambda r: (r["w"] > 0) & (r["h"] > 0)),
        lambda r: F.struct((r["y"] + r["h"] / 2).alias("m"), r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h")),
    )
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))

    def step(lines: Column, r: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        same = F.abs(last["y"] + last["h"] / 2 - r["m"]) < F.least(last["h"], r["h"]) * 0.5
        close = r["x"] <= last["x"] + last["w"] + F.greatest(last["h"], r["h"]) * 0.8
        x, y = F.least(last["x"], r["x"]), F.least(last["y"], r["y"])
        grown = box(
            x, y, F.greatest(last["x"] + last["w"], r["x"] + r["w"]) - x, F.greatest(last["y"] + last["h"], r["y"] + r["h"]) - y
        )
        head = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(F.coalesce(same & close, F.lit(False)), F.concat(head, F.array(grown))).otherwise(
            F.concat(lines, F.array(box(r["x"], r["y"], r["w"], r["h"])))
        )

    none = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    return F.aggregate(F.array_sort(keyed), none, step)


def line_boxes(chars: DataFrame, at: list[str], line: str) -> DataFrame:
    """The box around the characters of each line, clipped to the page, to five decimals."""
    box = chars.groupBy(*at, line).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    x, y = F.greatest(F.lit(0.0), "x0"), F.greatest(F.lit(0.0), "y0")
    w, h = F.least(F.lit(1.0), "x1") - x, F.least(F.lit(1.0), "y1") - y
    out = box.select(*at, line, *(F.round(v, 5).alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))
    return out.filter("w > 0 AND h > 0")


def source_box(x0, y0, x1, y1, width, height) -> list[Column]:
    """An item's box as fractions of its page, four decimals, cut at the page's edges."""
    a, b = F.greatest(x0, F.lit(0.0)), F.greatest(y0, F.lit(0.0))
    c, d = F.least(x1, width), F.least(y1, height)
    return [
        F.round(a / width, 4).alias("x"),
        F.round(b / height, 4).alias("y"),
        F.round(F.greatest(c - a, F.lit(0.0)) / width, 4).alias("w"),
        F.round(F.greatest(d - b, F.lit(0.0)) / height, 4).alias("h"),
    ]


def joined_stretches(df: DataFrame, at: list[str], lo: str, hi: str, gap: float) -> DataFrame:
    """Stretches that overlap or lie within `gap`, as one: sort, running maximum, islands."""
    w = W.partitionBy(*at).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", (reach.isNull() | (F.col(lo) > reach + gap)).cast("int"))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy(*at, "_i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("pieces")).drop("_i")
