"""Documents with every odd case that the operators define, and a column whose names clash with theirs."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words long, score double, sig string, kept string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_documents(spark, seed=0):
    rng = random.Random(seed)
    base = [words(rng, 60) for _ in range(6)]
    passage = words(rng, 50)
    near = base[0].split()
    near[30] = "changed"
    loop = " ".join([words(rng, 3)] * 40)
    texts = [
        None, "", " ", "\n", "\n\n", "x", "a b c", "ÄÖ ß é ı İ", "\t mixed\x0b white\x0c space \r\n", "<|endoftext|> special <|startoftext|>",
        *base, base[0], base[0], base[1].upper(), " ".join(near), base[2] + "\n" + passage, passage + " " + base[3], f"{base[4]} {passage}",
        loop, words(rng, 5000), "same line\n" * 3 + words(rng, 20), *[f"Same Line \n{words(rng, 30)}" for _ in range(12)], *[f"{words(rng, 10)}\n  COMMON tail " for _ in range(9)],
    ]
    rows = [(i, t, "en", "s", len(t or ""), "k", 7, 0.5, "sig", "kept") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base[5], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (5, "another text of id five", "en", "s", 1, "k", 7, 0.5, "sig", "kept")]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1]) for r in rows]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
