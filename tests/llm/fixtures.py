"""Small document tables with nulls, empty and very long texts, ties, repeated rows and odd characters."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 3, n: int = 60) -> list[str]:
    rng = random.Random(seed)
    words = [a + b for a in ("re", "no", "Ta", "li", "É") for b in ("an", "st", "or", "42", "ü", "")]
    made = []
    for _ in range(n):
        out = []
        for _ in range(rng.choice([0, 1, 2, 3, 8, 40, 160])):
            out.append(rng.choice(words) + rng.choice(["", "", "", ",", ".", "!"]))
        made.append(rng.choice(["", "\n"]).join(w + rng.choice([" ", " ", "\n"]) for w in out))
    return made


def edge_rows() -> list[tuple]:
    made = texts()
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(made)]
    rows += [(100 + i, made[20 + i % 3], "en", "src0", 1) for i in range(6)]  # copies
    rows += [(7, made[7], "en", "src1", 5), (7, made[7], "en", "src1", 5)]  # repeated rows
    rows += [(200, None, None, None, None), (None, "no id at all 1234 5678", None, "src1", 2), (None, None, "de", None, None), (201, "", "en", "src2", 0)]
    rows += [(202, "x" * 30_000, "en", "src2", 1), (203, "word " * 9_000, "en", "src2", 1), (204, "é  \t 🙂 tab\x0b a\x01b", "en", "src2", 1)]
    return rows


def documents(spark, rows=None, clashing=True):
    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    if clashing:  # columns of the input that have the names of results and helpers
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in ("kept", "fingerprint", "position", "block", "_m", "hash", "media", "row", "fp")})
    return df
