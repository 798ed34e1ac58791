"""Small tables with every awkward row the operators must define."""

import random

SF = "/root/testdata/sf0.001"
EXTRA = "key STRING, fp LONG, sub LONG, name STRING, score DOUBLE, y INT, n INT, pos INT, bin STRING, doc LONG"


def vocabulary(seed=1, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abdegiklmnorstuvé") for _ in range(r.randint(3, 8))) for _ in range(n)]


def prose(seed, n):
    r, v = random.Random(seed), vocabulary()
    return " ".join(r.choice(v) for _ in range(n))


def edge_rows():
    a, b = prose(1, 120), prose(2, 300)
    long = prose(3, 20_000)
    return [
        (1, a), (2, a), (3, a.upper()), (4, None), (5, ""), (6, "   \n\t "), (7, b), (8, b.replace(b.split()[150], "changed", 1)),
        (9, long), (10, long), (11, "one two"), (12, "One TWO"), (13, "é É ß"), (None, "no id at all " + prose(4, 60)),
        (None, None), (14, prose(5, 90)), (14, prose(5, 90)), (15, "In " * 700), (16, "x" * 40_000), (17, prose(6, 250) + " " + a),
    ]


def edge_docs(spark):
    rows = [(i, t, "en", "k", 1, 2, "z", 0.5, 1, 3, 4, "b", 9) for i, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, " + EXTRA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING, " + EXTRA)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def ascii_upper(t):
    return "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in t)
