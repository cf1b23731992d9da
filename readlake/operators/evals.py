"""Measures of quality: shares, nearest-rank times, support of claims, labels found where they belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import text as X
from readlake.operators.ranking import running

SUPPORTED = 0.4
# Numbers spelled out, in two languages.
SPELLED = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "một": "1", "hai": "2", "ba": "3", "bốn": "4", "năm": "5", "sáu": "6", "bảy": "7", "tám": "8", "chín": "9", "mười": "10",
}
# Words too common to support a claim.
STOP = (
    "the", "and", "for", "that", "with", "this", "are", "was", "were", "from", "which", "not", "have", "has", "its", "their", "can", "các", "những", "của",
    "trong", "một", "cho", "với", "được", "không", "này", "khi", "đến", "như",
)


def shares(df: DataFrame, **measures: tuple[Column, Column]) -> DataFrame:
    """(measure, hit, of, rate): for each measure the rows of its scope and those that meet it, in one pass."""
    aggs = []
    for name, (scope, met) in measures.items():
        aggs += [F.count_if(scope & met).alias(f"h_{name}"), F.count_if(scope).alias(f"o_{name}")]
    one = df.agg(*aggs)
    rows = ", ".join(f"'{n}', h_{n}, o_{n}" for n in measures)
    out = one.selectExpr(f"stack({len(measures)}, {rows}) AS (measure, hit, of)")
    return out.withColumn("rate", F.when(F.col("of") > 0, F.round(F.col("hit") / F.col("of"), 3)))


def timing(df: DataFrame, group: str, seconds: str) -> DataFrame:
    """(group, p50, p95, n): nearest-rank times per group and over all. Times are counted by value before the shuffle and the
    counts summed slice by slice, so no group is held in one buffer."""
    kind = F.explode(F.array(F.struct(F.lit(0).alias("_g"), F.col("_k")), F.struct(F.lit(1).alias("_g"), F.lit("all").alias("_k"))))
    counted = df.groupBy(F.col(group).cast("string").alias("_k"), F.col(seconds).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.select(kind.alias("k"), "_v", "_c").groupBy("k._g", "k._k", "_v").agg(F.sum("_c").alias("_c"))
    sizes = counted.groupBy("_g", "_k").agg(F.sum("_c").alias("n"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))).alias("_m"))
    upto = running(counted.filter("_v IS NOT NULL"), ["_g", "_k"], F.floor("_v"), [F.col("_v")], {"_upto": F.col("_c")})
    sizes, upto = sizes.alias("s"), upto.alias("u")
    both = sizes.join(upto, (F.col("s._g") == F.col("u._g")) & F.col("s._k").eqNullSafe(F.col("u._k")), "left")
    p = lambda q: F.min(F.when(F.col("_upto") >= F.col("_m") * q, F.col("_v")))
    return both.groupBy("s._g", "s._k", "n").agg(p(0.5).alias("p50"), p(0.95).alias("p95")).select(F.col("_k").alias("group"), "p50", "p95", "n")


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({X.WORD})"), F.lit(1))
    long = F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 3) & ~F.rlike(w, F.lit("^[0-9_]+$")))
    return F.array_except(long, F.array(*map(F.lit, STOP)))


def numbers(text: Column) -> Column:
    """The numbers of a text: digits without thousands marks, and words for one to ten."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), F.lit(1))
    digits = F.transform(found, lambda n: F.regexp_replace(n, r"[.,](?=[0-9]{3}(?![0-9]))", ""))
    spelled = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.map_contains_key(spelled, w))
    return F.array_distinct(F.concat(digits, F.transform(words, lambda w: F.element_at(spelled, w))))


def support(claim: Column, cited: Column) -> Column:
    """Share of a claim's content words found in what it cites; 1 for a claim with none."""
    words = content_words(claim)
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, content_words(cited))) / F.size(words))


def norm(text: Column) -> Column:
    """Label text for comparison: one kind of quote, no Markdown, no section numbers, one space."""
    flat = F.translate(text, "’‘“”–—", "''\"\"--")
    bare = F.regexp_replace(F.regexp_replace(flat, r"(?m)^#{1,6}\s+", ""), r"\*\*|__|\\|⁣|­", "")
    return F.lower(X.collapse(F.regexp_replace(bare, r"(?m)^\d{1,2}(?:\.\d{1,2})*\.?\s+", "")))


def judge_answers(answers: DataFrame) -> DataFrame:
    """Adds has_fact, cites_fact, abstained and right: `facts` any of which must occur, `cited_text` what the
    answer's passages say, `should_abstain` whether the document holds no answer."""
    said, proof = X.fold(F.col("answer")), X.fold(F.col("cited_text"))
    has = lambda hay: F.exists("facts", lambda f: F.contains(hay, X.fold(f)))
    out = answers.withColumn("has_fact", has(said)).withColumn("cites_fact", F.coalesce(has(proof), F.lit(False)))
    out = out.withColumn("abstained", X.abstained(F.col("answer")) & (F.size(X.cited(F.col("answer"))) == 0))
    right = F.when(F.col("should_abstain"), F.col("abstained")).otherwise(F.col("has_fact") & F.col("cites_fact"))
    return out.withColumn("right", right)


def score_points(points: DataFrame, key: str) -> DataFrame:
    """(key, points, sourced, supported, unknown_numbers) of a result's points (text, cited_text, document_text)."""
    rows = points.withColumn("_s", support(F.col("text"), F.coalesce("cited_text", F.lit(""))))
    rows = rows.withColumn("_n", F.size(F.array_except(numbers(F.col("text")), numbers(F.col("document_text")))))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.count("cited_text").alias("sourced"),
        F.count_if(F.col("cited_text").isNotNull() & (F.col("_s") >= SUPPORTED)).alias("supported"), F.sum("_n").alias("unknown_numbers"),
    )


def labels_found(labels: DataFrame, flow: DataFrame, doc: str) -> DataFrame:
    """Each label with how often its words occur in the document's flow (labels: doc, label_id, text)."""
    texts = flow.select(doc, norm(F.col("text")).alias("_flow"))
    rows = labels.withColumn("_l", norm(F.col("text"))).filter(F.length("_l") > 0).join(texts, doc)
    times = (F.length("_flow") - F.length(F.replace("_flow", F.col("_l"), F.lit("")))) / F.length("_l")
    return rows.select(doc, "label_id", times.cast("int").alias("times"))


# ---- how well pages were cleaned, against labels

#: Labels whose place on the page a reader opens.
PLACED = ("ABSTRACT", "SECTION_HEADING", "BODY", "LIST", "QUOTE", "CAPTION", "FOOTNOTE")


def _documents(flow: DataFrame, side: DataFrame, doc: str) -> DataFrame:
    """One row a document: its blocks in the flow and its side store in order, normalised, and the whole flow as it is."""
    blocks = flow.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ord", norm(F.col("text")).alias("t"), F.col("text").alias("raw"), "boxes"))).alias("_flow"))
    kept = side.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ord", "type", norm(F.col("text")).alias("t")))).alias("_side"))
    return blocks.join(kept, doc, "full")


def _times(block: Column, text: Column) -> Column:
    return ((F.length(block) - F.length(F.replace(block, text, F.lit("")))) / F.greatest(F.length(text), F.lit(1))).cast("int")


def judged_labels(labels: DataFrame, flow: DataFrame, side: DataFrame, doc: str, titles: DataFrame | None = None) -> DataFrame:
    """Each label (doc, label_id, type, group, text, whole, max_in_flow) with in_flow, how often it stands in the flow, and in_side, the type it was
    filed under. `whole`: only a block that is the label counts. A title shown above the text (titles: doc, title) counts as in the flow;
    `max_in_flow` places of a label that is not of the main text are allowed. A document's labels meet its blocks as one row."""
    packed = labels.withColumn("_l", norm(F.col("text"))).groupBy(doc).agg(F.collect_list(F.struct("label_id", "type", "group", "text", "_l", "whole", "max_in_flow")).alias("_labels"))
    rows = packed.join(_documents(flow, side, doc), doc, "left")
    rows = rows.join(titles.select(doc, norm(F.col("title")).alias("_title")), doc, "left") if titles is not None else rows.withColumn("_title", F.lit(""))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    rows = rows.withColumn("_flow", none(F.col("_flow"), rows.schema["_flow"].dataType)).withColumn("_side", none(F.col("_side"), rows.schema["_side"].dataType))

    def judged(x: Column) -> Column:
        whole = F.coalesce(x["whole"], F.lit(False))
        found = F.aggregate("_flow", F.lit(0), lambda n, b: n + F.when(whole, (b["t"] == x["_l"]).cast("int")).otherwise(_times(b["t"], x["_l"])))
        title = (x["type"] == "TITLE") & (found == 0) & F.coalesce(F.contains(F.col("_title"), x["_l"]), F.lit(False))
        found = F.when(title, 1).otherwise(found)
        found = F.when(x["group"] == "MAIN", found).otherwise(F.greatest(found - F.coalesce(x["max_in_flow"], F.lit(0)), F.lit(0)))
        filed = F.filter("_side", lambda b: F.when(whole, b["t"] == x["_l"]).otherwise(F.contains(b["t"], x["_l"])))
        named = [x[c].alias(c) for c in ("label_id", "type", "group", "text")]
        return F.struct(*named, F.when(F.length(x["_l"]) > 0, found).otherwise(0).alias("in_flow"), F.when(F.length(x["_l"]) > 0, F.get(filed, F.lit(0))["type"]).alias("in_side"))

    return rows.select(doc, F.explode(F.transform("_labels", judged)).alias("x")).select(doc, "x.*")


def judged_pairs(pairs: DataFrame, flow: DataFrame, doc: str) -> DataFrame:
    """Each pair (doc, a, b, next) with result: ok where a's first place in the flow is before b's (for `next`: in the block before, or before
    it in one block), wrong, or missing where one of them is not found."""
    packed = pairs.groupBy(doc).agg(F.collect_list(F.struct("a", "b", "next")).alias("_pairs"))
    rows = packed.join(flow.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ord", norm(F.col("text")).alias("t")))).alias("_flow")), doc, "left")

    def place(text: Column) -> Column:
        at = F.transform("_flow", lambda b, i: F.struct(i.alias("block"), F.call_function("locate", norm(text), b["t"]).alias("at")))
        return F.get(F.filter(at, lambda x: x["at"] > 0), F.lit(0))

    def judged(p: Column) -> Column:
        a, b = place(p["a"]), place(p["b"])
        after = (a["block"] < b["block"]) | ((a["block"] == b["block"]) & (a["at"] < b["at"]))
        follows = (b["block"] == a["block"] + 1) | ((a["block"] == b["block"]) & (a["at"] < b["at"]))
        right = F.when(F.coalesce(p["next"], F.lit(False)), follows).otherwise(after)
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), p["next"].alias("next"), F.when(a.isNull() | b.isNull(), "missing").when(right, "ok").otherwise("wrong").alias("result"))

    return rows.select(doc, F.explode(F.transform("_pairs", judged)).alias("x")).select(doc, "x.*")


def judged_words(broken: DataFrame, flow: DataFrame, doc: str) -> DataFrame:
    """Each word a page breaks at a line's end but prints whole elsewhere (doc, a, b: its halves) with rejoined: whether the flow no longer
    has it in two."""
    packed = broken.groupBy(doc).agg(F.collect_set(F.struct("a", "b")).alias("_words"))
    rows = packed.join(flow.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), "\n").alias("_all")), doc, "left")
    cut = lambda w: F.rlike(F.coalesce("_all", F.lit("")), F.concat(w["a"], F.lit("[-­]\\s*"), w["b"]))
    return rows.select(doc, F.explode(F.transform("_words", lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), (~cut(w)).alias("rejoined")))).alias("x")).select(doc, "x.*")


def judged_places(labels: DataFrame, flow: DataFrame, printed: DataFrame, doc: str) -> DataFrame:
    """Each placed label found in the flow with result: ok where a box of its first block lies over a place where the page prints the words
    (printed: doc, label_id, page, x, y, w, h), wrong, no box, or unmeasured where nothing is known to print them."""
    placed = labels.filter(F.col("type").isin(*PLACED)).withColumn("_l", norm(F.col("text"))).filter("length(_l) > 0")
    blocks = flow.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ord", norm(F.col("text")).alias("t"), "boxes"))).alias("_flow"))
    rows = placed.groupBy(doc).agg(F.collect_list(F.struct("label_id", "type", "_l")).alias("_labels")).join(blocks, doc)
    first = lambda x: F.get(F.filter("_flow", lambda b: F.contains(b["t"], x["_l"])), F.lit(0))
    found = rows.select(doc, F.explode(F.transform("_labels", lambda x: F.struct(x["label_id"].alias("label_id"), x["type"].alias("type"), first(x).alias("block")))).alias("x"))
    found = found.select(doc, "x.label_id", "x.type", "x.block.boxes", "x.block").filter("block is not null").drop("block")
    hits = printed.groupBy(doc, "label_id").agg(F.collect_list(F.struct("page", "x", "y", "w", "h")).alias("_hits"))
    over = lambda a, b, c, d: (a[c] < b[c] + b[d]) & (b[c] < a[c] + a[d])
    right = F.exists("boxes", lambda b: F.exists("_hits", lambda h: (b["page"] == h["page"]) & over(b, h, "x", "w") & over(b, h, "y", "h")))
    result = F.when(F.col("_hits").isNull(), "unmeasured").when(F.coalesce(F.size("boxes"), F.lit(0)) <= 0, "no box").when(right, "ok").otherwise("wrong")
    return found.join(hits, [doc, "label_id"], "left").select(doc, "label_id", "type", result.alias("result"))


def cleaning_shares(labels: DataFrame, pairs: DataFrame, checks: DataFrame, words: DataFrame, places: DataFrame, group_of: Column) -> DataFrame:
    """(measure, hit, of, rate): the eleven measures of how pages were cleaned, in one pass over the judged rows. `group_of`: the group of the type
    in `in_side`. checks: (…, ok)."""
    none = lambda kind: F.lit(None).cast(kind)

    def told(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        every = {"group": none("string"), "in_flow": none("int"), "filed": none("string"), "ok": none("boolean"), "known": F.lit(True)} | columns
        return df.select(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in every.items()])

    rows = told(labels, "label", group=F.col("group"), in_flow=F.col("in_flow"), filed=group_of)
    rows = rows.unionByName(told(pairs, "pair", ok=F.col("result") == "ok", known=F.col("result") != "missing"))
    rows = rows.unionByName(told(checks, "check", ok=F.col("ok"))).unionByName(told(words, "word", ok=F.col("rejoined")))
    rows = rows.unionByName(told(places, "place", ok=F.col("result") == "ok", known=F.col("result") != "unmeasured"))
    is_label, group, flow, ok = F.col("kind") == "label", F.col("group"), F.col("in_flow"), F.coalesce("ok", F.lit(False))
    of = lambda g: is_label & (group == g)
    filed = is_label & F.col("filed").isNotNull()
    kind = lambda k: (F.col("kind") == k) & F.col("known")
    return shares(
        rows,
        main_kept=(of("MAIN"), flow > 0),
        furniture_suppressed=(of("FURNITURE"), flow == 0),
        figure_text_suppressed=(of("FIGURE_TEXT"), flow == 0),
        metadata_separated=(of("METADATA"), flow == 0),
        supplementary_separated=(of("SUPPLEMENTARY"), flow == 0),
        kept_somewhere=(is_label & group.isin("METADATA", "SUPPLEMENTARY", "FURNITURE"), (flow > 0) | filed),
        reading_order=(kind("pair"), ok),
        # A main label printed as something else too (the title in the running header) is no error of typing.
        typed_right=(filed & ((group != "MAIN") | (flow == 0)), F.col("filed") == group),
        checks=(kind("check"), ok),
        words_rejoined=(kind("word"), ok),
        provenance=(kind("place"), ok),
    )


def order_right(places: DataFrame, pairs: DataFrame, doc: str) -> DataFrame:
    """Pairs (a before b) whose first places in the flow are in that order; `next` pairs must be neighbours."""
    at = lambda n: places.select(doc, F.col("label_id").alias(n), F.col("place").alias(f"_{n}"))
    rows = pairs.join(at("a"), [doc, "a"]).join(at("b"), [doc, "b"])
    right = (F.col("_a") < F.col("_b")) & (~F.col("next") | (F.col("_b") == F.col("_a") + 1))
    return rows.select(doc, "a", "b", right.alias("right"))
