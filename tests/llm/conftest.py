import random

import pytest

WORDS = "the of and river stone lamp quiet green harbour winter candle orchard copper thread window meadow signal paper bridge cloud".split()


def sentence(rng, n, vocabulary=400):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(vocabulary)) for _ in range(n))


def corpus():
    """(doc_id, text) with copies, edits, shared passages, repeated lines, nulls, empty and odd texts."""
    rng = random.Random(5)
    base = ["\n".join(sentence(rng, rng.randrange(4, 40)) for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    passage = sentence(rng, 60)
    rows = list(enumerate(base))
    for k in range(30):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(9))
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 15)) for k in range(8)]
    rows += [(300, None), (301, ""), (302, "   \n \t"), (303, "one"), (304, "one two"), (305, "One TWO"), (306, "é" * 300),
             (307, "ab" * 400), (308, "x" * 1000), (309, " ".join(["na na"] * 200)), (310, "\n".join([passage] * 3)),
             (311, "日本語 текст ελληνικά " * 30), (312, sentence(rng, 6000)), (313, "Zeile eins\nZeile eins\n\nZeile zwei eins"),
             (314, "it's  we'll\t\n\n  DON'T 'tis x''s 12ab ½ <|endoftext|> — “q” z"), (315, "a\x00b\r\nc\x0bd\x0ce")]
    return rows


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture
def docs(spark, texts):
    """The corpus with repeated rows, a null id, and extra columns named like results."""
    rows = [(i, t, "en", "s" + str((i or 0) % 3), 7, "x") for i, t in [*texts, texts[3], texts[3], (None, "no id here\nat all")]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, kept string").repartition(4)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, score int, kept string")
