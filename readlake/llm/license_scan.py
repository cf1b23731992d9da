"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its words, A-Z lowered, each with one space on either side, so that a rule matches whole words and two matches
never share a space. Rules are tried only where one of the keywords stands. All places of all rules that match are put in order;
a place that lies inside a place of the same or a higher rank is suppressed, except those of the base phrases, which always
count. A text is one row from the scan to the result: there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What a license is called, in words; ( )? and (a|b) as in regular expressions.
NAMES = {
    "afl-3": "academic free license( version)? 3( 0)?",
    "agpl-3": "((gnu )?(affero general public license|agpl)( version| v)? ?3( 0)?|agplv3)",
    "apache-1": "apache( software)? license( version)? 1( 0| 1)?",
    "apache-2": "apache( software)?( license)?( version| v)? 2( 0)?",
    "artistic-2": "artistic license( version)? 2( 0)?",
    "bsd": "bsd( style| type)?( license| licence)?",
    "bsd-2-clause": "(simplified|2 clause|two clause) bsd( license)?",
    "bsd-3-clause": "(new|modified|revised|3 clause|three clause) bsd( license)?",
    "bsl-1": "boost software license( version)?( 1 0)?",
    "cc-by": "(cc by|creative commons attribution)( license)?( [1-4] [05])?( international| unported| generic)?",
    "cc-by-nc": "(cc by nc|creative commons attribution non ?commercial)( [1-4] [05])?( international| unported| generic)?",
    "cc-by-nc-nd": "(cc by nc nd|creative commons attribution non ?commercial no ?derivatives)( [1-4] [05])?",
    "cc-by-nc-sa": "(cc by nc sa|creative commons attribution non ?commercial share ?alike)( [1-4] [05])?",
    "cc-by-nd": "(cc by nd|creative commons attribution no ?derivatives)( [1-4] [05])?",
    "cc-by-sa": "(cc by sa|creative commons attribution share ?alike)( [1-4] [05])?",
    "cc0-1": "(cc0|cc zero|creative commons zero)( 1 0)?( universal)?",
    "cddl-1": "(common development and distribution license|cddl)( version)?( 1 [01])?",
    "cecill-2": "cecill( license| v| version)? ?2( 1)?",
    "cpl-1": "common public license( version)?( 1 0)?",
    "ecl-2": "educational community license( version)?( 2 0)?",
    "epl-1": "eclipse public license( version| v)? 1( 0)?",
    "epl-2": "eclipse public license( version| v)? 2( 0)?",
    "eupl-1": "(european union public licen[cs]e|eupl)( version| v)?( 1 [12])?",
    "gfdl-1": "(gnu )?free documentation license( version)?( 1 [123])?",
    "gpl-2": "((gnu )?(general public license|gpl)( version| v)? 2( 0)?|(gnu )?gplv2)",
    "gpl-3": "((gnu )?(general public license|gpl)( version| v)? 3( 0)?|(gnu )?gplv3)",
    "gpl": "gnu (general public license|gpl)",
    "isc": "isc( license)?",
    "lgpl-2": "((gnu )?((lesser|library) general public license|lgpl)( version| v)? 2( 0| 1)?|(gnu )?lgplv2( 1)?)",
    "lgpl-3": "((gnu )?(lesser general public license|lgpl)( version| v)? 3( 0)?|(gnu )?lgplv3)",
    "lppl-1": "latex project public license( version)?( 1 3)?",
    "mit": "(mit|expat|x11)( license)?",
    "mpl-1": "mozilla public license( version| v)? 1( 1| 0)?",
    "mpl-2": "mozilla public license( version| v)? 2( 0)?",
    "ncsa": "(university of illinois )?ncsa( open source)? license",
    "odbl-1": "open (database license|data commons open database license)( 1 0)?",
    "ofl-1": "(sil )?open font license( version)?( 1 1)?",
    "osl-3": "open software license( version)? 3( 0)?",
    "postgresql": "postgresql license",
    "psf-2": "(python software foundation|psf) license( version)?( 2)?",
    "unlicense": "(the )?unlicense",
    "wtfpl": "(wtfpl|do what the fuck you want to public license)",
    "zlib": "zlib( libpng)? license",
}

#: Identifiers of the SPDX list, in words, as they follow a tag.
SPDX = {
    "afl-3": "afl 3 0",
    "agpl-3": "agpl 3 0( only| or later)?",
    "apache-1": "apache 1 [01]",
    "artistic-2": "artistic 2 0",
    "bsd-2-clause": "bsd 2 clause( patent| views)?",
    "bsd-3-clause": "bsd 3 clause( clear| lbnl| attribution)?",
    "bsd-4-clause": "bsd 4 clause( uc)?",
    "0bsd": "0bsd",
    "blueoak-1": "blueoak 1 0 0",
    "bsl-1": "bsl 1 0",
    "busl-1": "busl 1 1",
    "cc0-1": "cc0 1 0",
    "cddl-1": "cddl 1 [01]",
    "cecill-2": "cecill 2 [01]",
    "cpl-1": "cpl 1 0",
    "ecl-2": "ecl 2 0",
    "epl-1": "epl 1 0",
    "epl-2": "epl 2 0",
    "eupl-1": "eupl 1 [12]",
    "gfdl-1": "gfdl 1 [123]( only| or later)?",
    "gpl-1": "gpl 1 0( only| or later)?",
    "gpl-2": "gpl 2 0( only| or later| with classpath exception)?",
    "gpl-3": "gpl 3 0( only| or later)?",
    "lgpl-2": "lgpl 2 [01]( only| or later)?",
    "lgpl-3": "lgpl 3 0( only| or later)?",
    "lppl-1": "lppl 1 3[ac]?",
    "mit-0": "mit 0",
    "mpl-1": "mpl 1 [01]",
    "mpl-2": "mpl 2 0( no copyleft exception)?",
    "ms-pl": "ms pl",
    "ms-rl": "ms rl",
    "mulan-2": "mulanpsl 2 0",
    "ncsa": "ncsa",
    "odbl-1": "odbl 1 0",
    "ofl-1": "ofl 1 [01]( no rfn| rfn)?",
    "osl-3": "osl 3 0",
    "postgresql": "postgresql",
    "psf-2": "(psf|python) 2 0",
    "ruby": "ruby",
    "upl-1": "upl 1 0",
    "vim": "vim",
    "w3c": "w3c",
    "zlib": "zlib( acknowledgement)?",
    "zpl-2": "zpl 2 [01]",
}

#: Sentences around a name, most certain first: (rank, keyword, pattern).
AROUND = [
    (1, "licensed", "(dual )?licensed( to you)? under( the terms of| the terms and conditions of)?( the| a)? {}"),
    (1, "under", "(released|distributed|published|provided|available|offered|covered|made available) under( the terms of)?( the| a)? {}"),
    (1, "covered", "covered by( the terms of)?( the| a)? {}"),
    (1, "identifier", "spdx license identifier {}"),
    (2, "licensed", "{} licensed"),
    (2, "license", "(license|licence|licensing)( is| type| information)?( the| a)? {}"),
    (2, "terms", "terms( and conditions)? of( the| a)? {}"),
    (3, "license", "{} (license|licence)"),
]

#: Sentences of license texts and notices: (rank, label, keyword, pattern).
SENTENCES = [
    (1, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    (1, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
    (1, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    (1, "apache-2", "license", "you may not use this file except in compliance with the license"),
    (1, "gpl", "redistribute", "redistribute it and or modify it under the terms of the gnu general public license"),
    (1, "lgpl", "redistribute", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (1, "agpl", "redistribute", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    (1, "mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    (1, "unlicense", "public", "this is free and unencumbered software released into the public domain"),
    (1, "zlib", "warranty", "this software is provided as is without any express or implied warranty"),
    (2, "public-domain", "domain", "(dedicated to|released (in|into)|in|placed (in|into)) the public domain"),
    (2, "proprietary", "reserved", "all rights reserved"),
    (2, "proprietary", "confidential", "proprietary and confidential"),
    (3, "copyright-notice", "copyright", "copyright( c)? [0-9]{4}"),
    (3, "gpl", "gnu", "gnu general public license"),
    (3, "lgpl", "gnu", "gnu lesser general public license"),
    (3, "cc", "commons", "creative commons( license)?"),
]


@dataclass(frozen=True)
class Rule:
    rank: int
    label: str
    keyword: str
    pattern: str  # over words with a space on either side


def spaced(pattern: str) -> str:
    """A pattern of words with single spaces, for words that have a space each on either side."""
    return " " + pattern.replace(" ?", "(  )?").replace(" ", "  ").replace("(    )?", "(  )?") + " "


def rules() -> list[Rule]:
    """Base phrases (rank 0), then names in sentences, identifiers, sentences of license texts."""
    out = [Rule(0, label, "cc" if label == "cc-by-nc" else "license", spaced(phrase)) for phrase, label in BASE.items()]
    out += [Rule(rank, label, key, spaced(around.format(name))) for rank, key, around in AROUND for label, name in NAMES.items()]
    out += [Rule(1, label, "identifier", spaced(f"spdx license identifier {name}")) for label, name in SPDX.items()]
    return out + [Rule(rank, label, key, spaced(pattern)) for rank, label, key, pattern in SENTENCES]


def lowered(text: Column) -> Column:
    """A-Z in lower case. `lower` would also make ASCII letters of two other characters, which are put aside first."""
    text = F.coalesce(text, F.lit(""))
    odd = F.lit("Kİ")
    text = F.when(text.contains("K") | text.contains("İ"), F.translate(text, "Kİ", "ĸı")).otherwise(text) if odd is not None else text
    return F.lower(text)


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def detections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, places): all rule matches of every row in order, places as (start, minus_end, rank, label), in words from 0.

    A null text is empty. Repeated rows give repeated results."""
    every = rules()
    trimmed = F.trim(F.regexp_replace(lowered(F.col(text)), BETWEEN, " "))
    frame = docs.select(F.col(doc_id).alias("doc_id"), trimmed.alias("_words"))
    n_words = F.when(F.col("_words") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("_words")) + 1)
    wide = F.concat(F.lit(" "), F.replace("_words", F.lit(" "), F.lit("  ")), F.lit(" "))
    keys = sorted({r.keyword for r in every})
    frame = frame.select("doc_id", n_words.alias("n_words"), F.when(F.col("_words").rlike(r"(^| )(" + "|".join(keys) + r")( |$)"), wide).alias("_wide"))
    table = F.array(*[F.struct(F.lit(r.rank).alias("rank"), F.lit(r.label).alias("label"), F.lit(f" {r.keyword} ").alias("key"), F.lit(r.pattern).alias("pattern")) for r in every])
    # Keywords first: a rule's pattern is only tried where its keyword stands.
    met = F.filter(table, lambda r: F.col("_wide").contains(r["key"]))
    met = F.filter(met, lambda r: F.regexp_like(F.col("_wide"), r["pattern"]))
    frame = frame.withColumn("_met", F.when(F.col("_wide").isNotNull(), met))

    def places(r: Column) -> Column:
        # Pieces between matches and the matches: the words before a match are those of all pieces and matches before it.
        piece = F.transform(F.split(F.col("_wide"), r["pattern"], -1), lambda x: _spaces(x) / 2)
        match = F.transform(F.regexp_extract_all(F.col("_wide"), r["pattern"], F.lit(0)), lambda x: _spaces(x) / 2)
        both = F.arrays_zip(piece.alias("a"), match.alias("b"))
        empty = F.array().cast("array<struct<start:bigint,minus_end:bigint>>")
        begin = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["a"].cast("long")
            end = start + x["b"].cast("long")
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), (-end).alias("minus_end")))).alias("out"))

        found = F.aggregate(F.slice(both, F.lit(1), F.size(match)), begin, step, lambda s: s["out"])
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["minus_end"].alias("minus_end"), r["rank"].alias("rank"), r["label"].alias("label")))

    found = F.array_sort(F.flatten(F.transform("_met", places)))
    empty = F.array().cast("array<struct<start:bigint,minus_end:bigint,rank:int,label:string>>")
    return frame.select("doc_id", "n_words", F.coalesce(found, empty).alias("places"))


def suppressed(places: Column) -> Column:
    """The places that stay. They come by start, the longest first, then by rank: a place lies inside an earlier one exactly if
    some earlier one ends no sooner, so the furthest end of each rank is all that has to be kept in mind."""
    ranks = 4
    state = F.struct(F.array_repeat(F.lit(-1).cast("long"), ranks).alias("ends"), F.array().cast("array<struct<start:bigint,minus_end:bigint,rank:int,label:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        end = -x["minus_end"]
        inside = F.array_max(F.slice(s["ends"], F.lit(1), x["rank"] + 1)) >= end
        stays = (x["rank"] == 0) | ~inside
        ends = F.transform(s["ends"], lambda e, i: F.when(i == x["rank"], F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(stays, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(places, state, step, lambda s: s["out"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts all places of base phrases; first_word and last_word are their smallest and largest start, null if there are
    none. Labels are distinct, sorted and joined by commas, empty if there are none. The score is that of the best rank found."""
    held = detections(docs, doc_id, text).withColumn("kept", suppressed(F.col("places")))
    starts = F.transform(F.filter("places", lambda x: x["rank"] == 0), lambda x: x["start"])

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    best = F.array_min(F.transform("kept", lambda x: x["rank"]))
    score = F.when(best == 0, 1.0).when(best == 1, 0.9).when(best == 2, 0.7).when(best == 3, 0.4).otherwise(0.0)
    return held.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.filter("places", lambda x: x["rank"] == 0)).alias("base_labels"),
        joined(F.col("kept")).alias("labels"),
        score.alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB: places by splitting, suppression by an anti join."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    listed = ", ".join(f"({r.rank}, {text(r.label)}, {text(f' {r.keyword} ')}, {text(r.pattern)})" for r in rules())
    return f"""
WITH rules(rank, label, key, pattern) AS (VALUES {listed}),
rows_ AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_id, doc_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) AS w FROM rows_),
wide AS (SELECT row_id, doc_id, CASE WHEN w = '' THEN 0 ELSE length(w) - length(replace(w, ' ', '')) + 1 END AS n_words,
    ' ' || replace(w, ' ', '  ') || ' ' AS s FROM words),
met AS (SELECT row_id, s, rank, label, pattern, regexp_extract_all(s, pattern) AS hits, string_split_regex(s, pattern) AS pieces
    FROM wide JOIN rules ON contains(s, key) AND regexp_matches(s, pattern)),
each AS (SELECT row_id, rank, label, pieces, hits, unnest(range(1, len(hits) + 1)) AS k FROM met),
spot AS (SELECT row_id, rank, label,
    (list_sum(list_transform(list_concat(pieces[1:k], hits[1:k - 1]), lambda x: length(x) - length(replace(x, ' ', '')))) // 2)::BIGINT AS a,
    (list_sum(list_transform(list_concat(pieces[1:k], hits[1:k]), lambda x: length(x) - length(replace(x, ' ', '')))) // 2)::BIGINT AS b
    FROM each),
kept AS (SELECT * FROM spot d WHERE rank = 0 OR NOT EXISTS (SELECT 1 FROM spot e WHERE e.row_id = d.row_id AND e.rank <= d.rank
    AND e.a <= d.a AND e.b >= d.b AND (e.rank < d.rank OR e.a < d.a OR e.b > d.b OR e.label < d.label))),
base AS (SELECT row_id, count(*) AS n, min(a) AS f, max(a) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM spot WHERE rank = 0 GROUP BY row_id),
own AS (SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS ls, min(rank) AS best FROM kept GROUP BY row_id)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.f AS first_word, base.l AS last_word,
    coalesce(base.ls, '') AS base_labels, coalesce(own.ls, '') AS labels,
    (CASE own.best WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0.0 END)::DOUBLE AS score
FROM wide LEFT JOIN base USING (row_id) LEFT JOIN own USING (row_id)"""
