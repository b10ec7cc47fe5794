"""Small documents with awkward rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, cid long"


def texts(seed: int = 3, n: int = 40) -> list[str | None]:
    r = random.Random(seed)
    words = ["the", "of", "stone", "river", "é", "ñandú", "grass,", "Blue", "and.", "漢字", "x9", "on"]
    made: list[str | None] = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(n)]
    passage = " ".join(r.choice(words) for _ in range(50))
    for i in range(0, n, 4):
        made[i] = f"{made[i]}\n{passage} {made[i + 1]}"
    near = made[0].split(" ")
    made += [None, "", " ", "a" * 5000, "ab " * 3000, made[3], made[3], " ".join(["new", *near]), made[0]]
    return made


def documents(spark, made=None):
    made = texts() if made is None else made
    rows = [
        (i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", len(t) if t else None, -i, i)
        for i, t in enumerate(made)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
