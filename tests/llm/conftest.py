import random

import pytest

EXTRA = "mark bigint, bucket int, spans string, node bigint, `group` string, word string, rank int, _kept string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def with_columns(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    data = [(i, t, lang, source, len(t) if t is not None else None, 7, 1, "x", 3, "g", "w", 2, "k")
            for i, t, lang, source in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return lambda rows: with_columns(spark, rows)


@pytest.fixture(scope="session")
def messy_rows():
    """NULLs, empty and blank texts, ties, repeated rows, odd white space, one very long text."""
    rng = random.Random(5)
    syllables = ["ka", "lo", "mi", "ré", "tz", "über", "ñ", "the", "an", "12", "x."]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = text(120)
    edited = base.split(" ")
    edited[60] = "changed"
    rows = [(i, text(rng.randint(1, 90)), "en", "s") for i in range(20)]
    rows += [
        (20, None, None, None), (21, "", "en", None), (22, " \t\n\v\f\r ", None, "s"), (23, base, "en", "s"),
        (24, base, "de", "s"), (25, " ".join(edited), "en", "s"), (26, base.upper(), "en", "s"), (27, "one two", "en", "s"),
        (28, "One  TWO", "en", "s"), (29, "a  b\n\n c\td e f <|endoftext|> g\n ", "fr", "s"), (30, text(6000), "en", "s"),
        (31, text(40) + " " + base + " " + text(40), "en", "s"), (32, "漢字かな Ａ ﬁ é İ ςΣ 'll don't", "es", "s"),
        (33, "line\n" * 12 + "#$% " * 4, "en", "s"), (None, base, "en", "s"), (None, None, "en", "s"),
        (23, base, "en", "s"), (34, "x" * 5000 + " " + "ab" * 4000, "en", "s"),
    ]
    return rows
