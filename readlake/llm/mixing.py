"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Rows are summed to cells (one per combination of the dimensions' values), so everything after the first shuffle is as small as the
number of combinations. A round multiplies each cell by target / present share of its value, one dimension after the other; the
rounds end when every share is within `close` of its target. Weights then become probabilities c * weight, at most 1, with c
chosen so that the expected number of tokens kept is `rate` of all; what the limit 1 takes away is given back as a row's weight, so
weighted tokens still have the target shares. A row is picked if a hash of its id, as a fraction, is below its probability.

Fractions are summed as decimals, so a result does not depend on the order in which tasks end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.session import pinned

WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null value of a dimension.
MISSING = "∅"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) told by the id alone; a null id counts as the empty text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


#: Shares and probabilities nearer to zero than this are zero.
CLOSE = 1e-12


def exact_sum(x: Column) -> Column:
    """A sum of doubles that is the same in any order."""
    return F.sum(x.cast("decimal(38,24)")).cast("double")


def shares(cells: DataFrame, dimension: str, targets: DataFrame | None) -> DataFrame:
    """(dimension, target): the target share of each value present. Targets of absent values are left out and the rest scaled to sum
    to one; values without a target share what is left as they do now (nothing is left if the targets sum to one, but for `CLOSE`, or
    more). Where no target is of a value present, shares stay as they are."""
    now = cells.groupBy(dimension).agg(F.sum("n").alias("n"))
    if targets is None:
        whole = now.agg(F.sum("n")).first()[0] or 1.0
        return now.select(dimension, (F.col("n") / F.lit(float(whole))).alias("target"))
    wanted = targets.select(F.coalesce(F.col("value").cast("string"), F.lit(MISSING)).alias(dimension), F.col("share").cast("double").alias("share"))
    wanted = wanted.groupBy(dimension).agg(exact_sum(F.col("share")).alias("share"))
    both = now.join(wanted, dimension, "left")
    # Sums over all values as one row; a dimension's values are a table of the size of the targets.
    sums = both.agg(F.coalesce(exact_sum(F.col("share")), F.lit(0.0)).alias("given"), F.sum(F.when(F.col("share").isNull(), F.col("n")).otherwise(0.0)).alias("free"))
    r = sums.first()
    given, free = float(r["given"] or 0.0), float(r["free"] or 0.0)
    left = 1.0 - given if free > 0 and 1.0 - given >= CLOSE else 0.0
    total = given + left
    if total <= 0:
        return shares(cells, dimension, None)
    fair = F.when(F.col("share").isNotNull(), F.col("share")).otherwise(F.col("n") * F.lit(left / free if free > 0 else 0.0))
    return both.select(dimension, (fair / F.lit(total)).alias("target"))


def rake(cells: DataFrame, dimensions: list[str], targets: dict[str, DataFrame], rounds: int = 50, close: float = CLOSE) -> tuple[DataFrame, float]:
    """cells: the dimensions and `n`. The cells with `weight`, and how far a share is from its target at most. Shares that no weights
    can meet (a value found only with one whose target is zero) leave a distance; the weights of the last round are given."""
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    frame = cells.withColumn("share", F.col("n") / F.lit(float(total) or 1.0)).withColumn("weight", F.lit(1.0))
    for d in dimensions:
        frame = frame.join(shares(cells, d, targets.get(d)).withColumnRenamed("target", f"target_{d}"), d)
    frame = pinned(frame, "cells")
    far = 0.0
    for _ in range(rounds):
        off = []
        for d in dimensions:
            present = F.sum((F.col("share") * F.col("weight")).cast("decimal(38,24)")).over(Window.partitionBy(d)).cast("double")
            frame = frame.withColumn("present", present).withColumn(f"off_{d}", F.abs(F.col("present") - F.col(f"target_{d}")))
            off.append(F.max(f"off_{d}"))
            frame = frame.withColumn("weight", F.when(F.col("present") > 0, F.col("weight") * F.col(f"target_{d}") / F.col("present")).otherwise(0.0)).drop("present")
        frame = pinned(frame, "raked")
        far = max((x or 0.0) for x in frame.agg(*off).first())
        frame = frame.drop(*[f"off_{d}" for d in dimensions])
        if far <= close:
            break
    return frame.select(*dimensions, "n", "weight"), far


def calibrated(cells: DataFrame, rate: float, rounds: int = 30) -> float:
    """c such that the sum of n * min(1, c * weight) is `rate` of all n, or as near as can be."""
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    share = F.col("n") / F.lit(float(total) or 1.0)
    c = float("inf")
    for _ in range(rounds):
        full = (F.col("weight") * F.lit(c) >= 1) if c != float("inf") else F.lit(False)
        sums = [exact_sum(F.when(full, share).otherwise(0.0)).alias("full"), exact_sum(F.when(full, 0.0).otherwise(share * F.col("weight"))).alias("rest")]
        r = cells.agg(*sums).first()
        if not r["rest"]:
            break
        new = max(0.0, rate - float(r["full"])) / float(r["rest"])
        if c != float("inf") and abs(new - c) <= 1e-12 * c:
            break
        c = new
    return 1.0 if c == float("inf") else c


def mixed(
    docs: DataFrame,
    dimensions: dict[str, Column],
    targets: dict[str, DataFrame | Callable[[DataFrame], DataFrame]],
    tokens: Column,
    rate: float = 0.5,
    doc_id: str = "doc_id",
    seed: str = "mix",
    rounds: int = 50,
    close: float = CLOSE,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of `docs` (columns `keep`, default all) with the dimensions' values, mix_tokens, mix_probability, mix_weight and
    mix_picked. Targets are (value, share) for each dimension, or told from the cells (mix_<dimension>, n).

    A null value of a dimension is a value of its own (shown as ∅). Rows without tokens count nothing and are told like others of
    their cell; a cell without tokens has probability and weight 0, as has one whose target, or whose probability but for `CLOSE`, is zero. Repeated
    rows share a decision. Columns of docs with the names that are added are replaced; others may have any name."""
    names = [f"mix_{d}" for d in dimensions]
    fresh = [*names, "mix_tokens", "mix_probability", "mix_weight", "mix_picked"]
    kept = [c for c in (keep or docs.columns) if c not in fresh]
    values = [F.coalesce(x.cast("string"), F.lit(MISSING)).alias(n) for n, x in zip(names, dimensions.values(), strict=True)]
    cells = docs.select(*values, tokens.alias("t")).groupBy(*names).agg(F.sum("t").cast("double").alias("n")).filter("n > 0")
    cells = pinned(cells, "mix_cells")
    wanted = {f"mix_{d}": t(cells) if callable(t) else t for d, t in targets.items()}
    raked, _ = rake(cells, names, wanted, rounds, close)
    raked = pinned(raked, "mix_weights")
    c = calibrated(raked, rate)
    chance = F.col("weight") * F.lit(c)
    told = raked.select(*names, F.when(chance >= CLOSE, chance).otherwise(0.0).alias("chance"))
    row = F.struct(*([F.col(f"`{k}`") for k in kept] or [F.lit(0).alias("none")]))
    rows = docs.select(row.alias("row"), *values, tokens.alias("mix_tokens"), fraction(F.col(doc_id), seed).alias("fraction"))
    rows = rows.join(told, names, "left").withColumn("chance", F.coalesce("chance", F.lit(0.0)))
    added = {
        "mix_probability": F.least(F.lit(1.0), "chance"),
        "mix_weight": F.when(F.col("chance") > 0, F.greatest(F.lit(1.0), "chance")).otherwise(0.0),
        "mix_picked": F.col("fraction") < F.least(F.lit(1.0), "chance"),
    }
    return rows.select(*[F.col(f"row.`{k}`").alias(k) for k in kept], *names, "mix_tokens", *[v.alias(k) for k, v in added.items()])


def topic(text: Column) -> Column:
    """What a text is about, as far as its form tells: a stand-in by marks for a topic model, which `mixed` takes as any other column."""
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(text.contains("icense"), "license")
        .when(text.contains(" | "), "table")
        .when(text.contains("!! "), "shouting")
        .when(text.contains("*** ") | text.contains("&&& ") | text.contains("%%% "), "symbols")
        .when(text.contains("@"), "contact")
        .otherwise("prose")
    )


#: Target shares of the query and the pipeline; what is not named shares what is left.
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
TOPICS = {"prose": 0.8}
#: Sources are evened out: their shares are raised to this power.
EVEN = 0.7


def standard(docs: DataFrame, rate: float = 0.5, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """`documents` mixed to the targets above."""
    spark = docs.sparkSession

    def listed(held: dict[str, float]) -> DataFrame:
        return spark.createDataFrame(list(held.items()), "value string, share double")

    def evened(cells: DataFrame) -> DataFrame:
        each = cells.groupBy(F.col("mix_source").alias("value")).agg(F.pow(F.sum("n"), F.lit(EVEN)).alias("share"))
        total = each.agg(F.sum("share")).first()[0] or 1.0
        return each.withColumn("share", F.col("share") / F.lit(total))

    targets = {"source": evened, "lang": listed(LANGUAGES), "topic": listed(TOPICS)}
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}
    return mixed(docs, dims, targets, n_words(F.col("text")), rate, seed=seed, keep=keep)


def oracle(table: str = "documents", rate: float = 0.5, seed: str = "mix", rounds: int = 40) -> str:
    """`standard` in DuckDB: one row per row of `table`, with its columns doc_id and the mix columns."""
    listed = {name: ", ".join(f"('{k}', {v})" for k, v in held.items()) for name, held in (("lang", LANGUAGES), ("topic", TOPICS))}

    def target(name: str) -> str:
        given = f"SELECT d.*, g.share FROM (SELECT {name}, sum(n) AS n FROM cells GROUP BY 1) d LEFT JOIN (VALUES {listed[name]}) g(v, share) ON d.{name} = g.v" if name in listed else (
            "SELECT source, n, pow(n, " + str(EVEN) + ") / sum(pow(n, " + str(EVEN) + ")) OVER () AS share FROM (SELECT source, sum(n) AS n FROM cells GROUP BY 1)"
        )
        return f"""t_{name} AS (SELECT {name}, CASE WHEN given + rest <= 0 THEN n / sum(n) OVER () ELSE coalesce(share, n * rest / free) / (given + rest) END AS target
    FROM (SELECT *, CASE WHEN free > 0 AND 1 - given >= {CLOSE} THEN 1 - given ELSE 0 END AS rest FROM (
        SELECT *, coalesce(sum(share) OVER (), 0)::DOUBLE AS given, sum(CASE WHEN share IS NULL THEN n ELSE 0 END) OVER ()::DOUBLE AS free FROM ({given}))))"""

    return f"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
    CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN contains(text, 'icense') THEN 'license' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shouting'
        WHEN contains(text, '*** ') OR contains(text, '&&& ') OR contains(text, '%%% ') THEN 'symbols' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM {table}),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM f GROUP BY ALL HAVING sum(tokens) > 0),
{target("source")},
{target("lang")},
{target("topic")},
start AS (SELECT cells.*, n / sum(n) OVER () AS share, t_source.target AS ts, t_lang.target AS tl, t_topic.target AS tt
    FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
r AS (SELECT 0 AS i, *, 1.0::DOUBLE AS w FROM start
    UNION ALL SELECT i + 1, source, lang, topic, n, share, ts, tl, tt, CASE WHEN s3 > 0 THEN w2 * tt / s3 ELSE 0 END FROM (
        SELECT *, sum(share * w2) OVER (PARTITION BY topic) AS s3 FROM (
            SELECT *, CASE WHEN s2 > 0 THEN w1 * tl / s2 ELSE 0 END AS w2 FROM (
                SELECT *, sum(share * w1) OVER (PARTITION BY lang) AS s2 FROM (
                    SELECT *, CASE WHEN s1 > 0 THEN w * ts / s1 ELSE 0 END AS w1 FROM (
                        SELECT *, sum(share * w) OVER (PARTITION BY source) AS s1 FROM r WHERE i < {rounds})))))),
final AS (SELECT source, lang, topic, n, w, row_number() OVER (ORDER BY w DESC, source, lang, topic) AS k FROM r WHERE i = {rounds}),
-- The k heaviest cells are kept whole: the fewest for which the next one's probability stays below one.
step AS (SELECT k, w, greatest(0, {rate} * sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(n * w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM final),
cal AS (SELECT coalesce((SELECT c FROM step WHERE c * w < 1 ORDER BY k LIMIT 1), 1.0) AS c)
SELECT f.doc_id, f.source AS mix_source, f.lang AS mix_lang, f.topic AS mix_topic, f.tokens AS mix_tokens,
    (CASE WHEN w * c >= {CLOSE} THEN least(1.0, w * c) ELSE 0 END)::DOUBLE AS mix_probability, (CASE WHEN w * c >= {CLOSE} THEN greatest(1.0, w * c) ELSE 0 END)::DOUBLE AS mix_weight,
    ('0x' || substr(md5(coalesce(f.doc_id::VARCHAR, '') || '-{seed}'), 1, 12))::BIGINT / 281474976710656.0 < (CASE WHEN w * c >= {CLOSE} THEN least(1.0, w * c) ELSE 0 END) AS mix_picked
FROM f CROSS JOIN cal LEFT JOIN final USING (source, lang, topic)"""
