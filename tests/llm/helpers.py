"""Small documents with every awkward trait, and plain comparisons."""

from pyspark.sql import types as T

WORDS = "the sea was calm and grey that morning while boats went out to fish beyond far rocks under low cloud".split()

#: Extra columns whose names the operators use themselves.
CLASHING = ["id", "_id", "size", "h", "fp", "component", "node", "key", "k", "crc", "_s", "_t", "copies", "whole", "upto", "target", "row", "term", "flags", "share", "_y", "f", "a", "b", "v", "rid", "m", "u", "n", "n_links", "score", "rank", "piece", "start", "length", "shard", "slot", "section", "tokens", "total", "pii_spans", "pii_text", "toxicity", "lang_pred", "lang_score", "tt"]


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


def awkward() -> list[tuple]:
    """Rows (doc_id, text, lang, source): nulls, empty and long texts, ties and repeated rows."""
    same = prose(3, 40)
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "   \n\t ", "en", "a"),
        (4, "12345 67 !!! ² ...", None, "b"),
        (5, prose(5, 60_000), "en", "b"),
        (6, "x" * 200_000, None, "b"),
        (None, prose(9, 30), "en", None),
        (None, None, None, None),
        (None, "", None, "a"),
        (7, "mail jo@example.org or +44 20 7946 0958 now", "en", "c"),
        (8, "퟿\U0001f600 éé naïve \u0001 word", "fr", "c"),
    ]
    rows += [(20 + i, same, "en", "a") for i in range(12)]
    rows += [(40, prose(4, 25), "en", "a")] * 3
    rows += [(50 + i, prose(50 + i, 20 + 7 * i), "en" if i % 2 else "de", "abc"[i % 3]) for i in range(30)]
    return rows


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def documents(spark, rows, clash: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    return df


def smallest_in_component(nodes, links) -> dict:
    """Smallest node reachable from each node, by union and find."""
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
