"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron".split()


def prose(seed: int, n: int) -> str:
    """``n`` pseudo-random words, all from a rule."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 15 if (x >> 8 & 15) < 15 else 0] + str(x >> 16 & 31))
    return " ".join(out)


def rows() -> list[tuple]:
    long = prose(99, 30_000)
    near = prose(3, 200).split(" ")
    return [
        (1, prose(1, 60), "en", "a", 1), (2, prose(1, 60), "en", "b", 1),
        (3, prose(1, 60), None, None, None), (4, "", "en", "a", 0), (5, None, None, "a", None),
        (6, long, "en", "a", 1), (7, long, "en", "c", 1), (None, prose(2, 40), "en", "a", 1),
        (None, prose(2, 40), "en", "a", 1), (8, prose(4, 50), "en", "a", 1),
        (8, prose(4, 50), "en", "a", 1), (9, " ".join(near), "de", "b", 1),
        (10, " ".join([*near[:100], "changed", *near[101:]]), "de", "b", 1),
        (11, "two words", "en", "a", 1), (12, "two words", "en", "a", 1),
        (13, "12 - ... !", "en", "a", 1), (14, "é́ \U0001f600\n\n  ß", "de", "a", 1),
        (15, prose(5, 2500), "en", "d", 1),
    ]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The table with columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ["keep_id", "group_size", "kept", "shard", "slot", "rank", "node", "tie", "x_tie",
             "x_text", "part", "epoch", "block", "position", "toxicity", "lang_pred", "pii_spans",
             "text_sha256", "n", "run", "fp", "fingerprint", "component_id", "a_ids", "terms", "label", "quota", "at", "of", "start", "length"]
    return df.withColumns({n: F.lit(n) for n in names})
