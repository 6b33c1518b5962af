import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.similarity import jaro_winkler_similarity


def _scores(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return [r[0] for r in df.select(jaro_winkler_similarity(F.col("a"), F.col("b"))).collect()]


def test_winkler_published_pairs(spark):
    pairs = [("MARTHA", "MARHTA"), ("DWAYNE", "DUANE"), ("DIXON", "DICKSONX"), ("abc", "abc"), ("", ""), ("abc", "xyz")]
    assert _scores(spark, pairs) == pytest.approx([0.961, 0.84, 0.813, 1.0, 0.0, 0.0], abs=1e-3)


def test_nulls(spark):
    assert _scores(spark, [(None, "x"), ("a", None)]) == [None, None]


def _brute(a: str, b: str) -> float:
    """Jaro-Winkler from its definition."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    pairs = []
    for i, x in enumerate(a):
        free = [j for j, y in enumerate(b) if x == y and abs(i - j) <= reach and all(j != q for _, q in pairs)]
        if free:
            pairs.append((i, free[0]))
    m = len(pairs)
    if not m:
        return 0.0
    half = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs))) // 2
    sim = 1.0 if a == b else (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = next((k for k in range(5) if k == 4 or a[k:k + 1] != b[k:k + 1] or k >= len(a)), 4)
    return sim if sim <= 0.7 else sim + 0.1 * prefix * (1 - sim)


def test_against_the_definition(spark):
    draw = random.Random(6)
    pairs = [("".join(draw.choices("abcdé", k=draw.randint(0, 12))), "".join(draw.choices("abcdé", k=draw.randint(0, 12))))
             for _ in range(300)]
    assert _scores(spark, pairs) == pytest.approx([_brute(a, b) for a, b in pairs])


def test_long_texts_against_duckdb(spark):
    """4,000 characters a side take well under a second a pair."""
    import time

    import duckdb
    draw = random.Random(7)
    pairs = []
    for size, letters in ((4_000, "abcdefghij "), (4_000, "ab"), (3_000, "aé€😀xyz"), (200, "abc")):
        a = "".join(draw.choices(letters, k=size))
        b = "".join(x if draw.random() < 0.9 else draw.choice(letters) for x in a)
        pairs += [(a, b), (a, b[::-1]), (a, a[: size // 3])]
    pairs += [("x" * 4_000, "x" * 3_999 + "y"), ("ab" * 2_000, "ba" * 2_000)]
    _scores(spark, pairs[-1:])  # warm
    began = time.time()
    got = _scores(spark, pairs)
    assert time.time() - began < 20
    con = duckdb.connect()
    ascii_only = [k for k, (a, b) in enumerate(pairs) if a.isascii() and b.isascii()]  # DuckDB compares bytes
    want = [con.execute("select jaro_winkler_similarity(?, ?)", list(pairs[k])).fetchone()[0] for k in ascii_only]
    assert [got[k] for k in ascii_only] == pytest.approx(want)
    assert got[:3] != got[3:6] and all(0 <= x <= 1 for x in got)
