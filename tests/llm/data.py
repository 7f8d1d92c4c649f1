"""Hard small inputs: nulls, empty and long texts, copies, repeated rows, columns with clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash long, component long, score double, row long, spans string, ids string, name string, part string, features string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", ",", "."]) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(12)]
    out = [None, "", "   ", "\n", "one", "one two three", "ü" * 50, "a" * 900, "ab" * 700, "\t mixed\r\nwhite \x0b space ", prose(rng, 4000)]
    for b in base:
        out.append(b)
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    passage = prose(rng, 130)
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 15)}" for _ in range(5)]
    out += [base[0], base[1], base[1], base[1].upper()]
    out += [f"{base[2]} password = hunter2hunter token:abc secret=token:abcdefgh x"]
    return out


def documents(spark, seed=1, extra=()):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 7, 8, 0.5, 9, "s", "i", "n", "p", "f") for i, t in enumerate([*texts(seed), *extra])]
    rows += [rows[15], rows[15], (None, "no id at all", None, None, None) + (None,) * 9, (None, None, None, None, None) + (None,) * 9]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
