"""Small document tables with every awkward case, shared by the tests of the operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id string, key string, node bigint, secrets string, n bigint"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["er", "th", "on", "an", "re", "ti", "es"]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    out = [
        (0, base),
        (1, near),
        (2, base),
        (2, base),
        (3, prose(3, 80) + " " + passage + " " + prose(4, 80)),
        (4, prose(5, 10) + "\n" + passage),
        (5, None),
        (6, ""),
        (7, " \t\n"),
        (8, "one"),
        (9, "one"),
        (10, "one two"),
        (11, "Ünï 漢字 😀 " * 30),
        (12, "ab" * 9000),
        (13, "ab" * 9000 + "c"),
        (None, passage),
        (None, None),
        (14, 'api_key = "Ab3dE5gH7jK9mN1pQ" and AKIA' + "ABCDEFGHIJKLMNOP2" + " and " + "0123456789abcdef" * 2),
        (15, (prose(6, 400) + " ") * 20),
        (16, near.upper()),
    ]
    return out + [(100 + k, prose(100 + k, 40)) for k in range(40)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    # the other columns clash with names that operators use inside, or are null
    full = [(i, t, "en", None, len(t or ""), None, "x", None, 7, "s", 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
