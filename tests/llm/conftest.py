import pytest

WORDS = "the of and to in is on at by it an or as be we he so no up if".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "er", "ing", "tion", "ly"]) + str(r.randrange(40)) for _ in range(n))


SHARED = prose(1, 60)
BASE = prose(2, 120)

#: doc_id, text, lang, source. Null and repeated ids, null, empty, blank and very long texts, copies, near copies, shared passages.
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("the", "thee", 2), "en", "b"),
    (4, prose(3, 50) + " " + SHARED + " " + prose(4, 50), "en", "a"),
    (5, prose(5, 20) + "\n" + SHARED.replace(" ", "\t") + "  " + prose(6, 30), None, "a"),
    (6, None, "en", "a"),
    (7, "", "en", None),
    (8, " \t\r\n\x0b\x0c ", "de", "b"),
    (9, "Ärger und Öl, ß; straße: KK İ naïve Licence \U0001f600", "de", "b"),
    (10, "word", "fr", "c"),
    (11, "Released under the MIT License. CC BY-NC 4.0, Apache License, Version 2.0; under the mit license", "en", "c"),
    (11, "Released under the MIT License. CC BY-NC 4.0, Apache License, Version 2.0; under the mit license", "en", "c"),
    (11, "another text of the same id released under the GNU General Public License version 3", "en", "c"),
    (None, prose(7, 45), "en", "a"),
    (None, prose(7, 45), "en", "a"),
    (None, None, None, None),
    (12, " ".join([prose(8, 40)] * 3), "en", "a"),
    (13, ("a b c " * 4000).strip(), "en", "a"),
    (14, prose(9, 30000), "en", "a"),
    (15, prose(10, 35), "en", "a"),
    (16, "x" + prose(10, 35), "en", "a"),
    (17, prose(11, 34), "es", "d"),
    (18, prose(11, 34), "es", "d"),
    (19, "1 2 3 4 5 ... !!", "es", "d"),
    (100, prose(12, 8).upper(), "en", "a"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """The rows above with more columns than documents has, under names that the operators use themselves."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id long, lang_pred string, row string, text_key long, mix_picked int, score double"
    rows = [(i, t, g, s, len(t or ""), "f", 7, "zz", "r", 1, 5, 0.5) for i, t, g, s in ROWS]
    return spark.createDataFrame(rows, shape).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
