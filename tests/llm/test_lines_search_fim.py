"""Line dedup, ranked search and fill-in-middle against brute force."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import fim, linedup, search
from tests.llm.conftest import ODD

SPACE = " \t\n\x0b\f\r"


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


# -- line dedup ---------------------------------------------------------------
def common_lines(rows, least, min_chars=1):
    """Counter of (id, lines, dropped, kept text), by the definition."""
    held = Counter(k for _, t, *_ in rows for k in {low(line.strip(SPACE)) for line in (t or "").split("\n")})
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(low(x.strip(SPACE))) < min_chars or held[low(x.strip(SPACE))] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


LINES = [(i, "\n".join(["Header", f"own {i}", " header\t", "", "ÄRGER" if i % 2 else "ärger", f"pair {i // 2}"]))
         for i in range(40)] + [(100 + i, "HEADER") for i in range(60)] + [
    (200, "\n" * 500 + "Header"), (201, "x " * 50_000 + "\nHeader\n\n"), (202, "header\x00\nheader "),
    (203, "  \t"), (203, "  \t"), (204, "\nheader\n"), (None, "header\nlast")]


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_line_dedup_equals_brute_force(make_docs, batches):
    rows = LINES + ODD
    got = linedup.drop_common_lines(make_docs(rows, parts=5), least=10, batches=batches).collect()
    assert Counter(map(tuple, got)) == common_lines(rows, 10)


def test_line_dedup_threshold_and_shortest_key(make_docs):
    rows = [(i, f"ab\nabc\n{i}") for i in range(9)] + [(9, "abc\nab\nAB")]
    for least, chars in ((10, 1), (10, 3), (11, 1)):
        got = linedup.drop_common_lines(make_docs(rows), least=least, min_chars=chars).collect()
        assert Counter(map(tuple, got)) == common_lines(rows, least, chars)


def test_line_dedup_of_an_empty_table(make_docs):
    assert linedup.drop_common_lines(make_docs([(1, "x")]).where("false")).count() == 0


def test_runs_are_levelled_and_count_what_the_batches_hold(spark):
    rng = np.random.default_rng(3)
    runs, total = linedup.LineRuns(spark, least=4), Counter()
    for batch in range(5):
        keys = [bytes([k]) * 16 for k in rng.integers(0, 60, 50)]
        total += Counter(keys)
        runs.add(spark.createDataFrame([(k,) for k in keys], "line binary"))
        # One run for each set bit of the number of batches.
        assert len(runs.runs) == bin(batch + 1).count("1")
    assert {r.line for r in runs.settled().collect()} == {k for k, n in total.items() if n >= 4}


def test_merging_runs_moves_no_rows(spark):
    runs = linedup.LineRuns(spark, least=2)
    a, b = (runs._write(spark.range(50).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("line"),
                                               F.lit(1).cast("long").alias("n"))) for _ in range(2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = runs._merge(a, b)
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert merged.where("n = 2").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- ranked search ------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(rows, items, k=10):
    docs = [(i, TERM.findall(low(t or ""))) for i, t, *_ in rows]
    n_docs, length = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    counts = [Counter(t) for _, t in docs]
    df = Counter(x for t in counts for x in t)
    out = []
    for item, text in items:
        scores = []
        for (i, terms), tf in zip(docs, counts):
            m = 100 - 90 + (90 * len(terms) * n_docs) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                    for t in set(TERM.findall(low(text or ""))) if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        scores.sort()
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(scores[:k])]
    return Counter(out)


def corpus(n, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "İx", "ÑANDÚ", "x²"]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    return [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 120), p=share / share.sum())) + "," * (i % 3))
            for i in rng.permutation(n)]


@pytest.mark.parametrize("segment", [3_000, 8_000_000])
def test_search_equals_brute_force(spark, make_docs, monkeypatch, segment):
    monkeypatch.setattr(search, "SEGMENT", segment)
    monkeypatch.setattr(search, "STRETCH", 16)
    rows = corpus(600) + ODD + [(900 + i, "tie tie w1") for i in range(30)]
    items = [(i, t) for i, t in corpus(25, seed=6)] + [(50, "tie"), (51, "W1 w2-w3/w1 straße ñandú ÑANDÚ"), (52, None),
                                                       (53, ""), (54, "..."), (50, "word"), (None, "one cat"), (55, "nowhere")]
    index = search.build_index(make_docs(rows, parts=4))
    want = ranked(rows, items)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    for query_bytes in (search.QUERY_BYTES, 8_000):
        got = search.search(index, queries, query_bytes=query_bytes).collect()
        assert Counter(map(tuple, got)) == want


def test_top_k_skips_nothing_it_should_find():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n = int(rng.integers(1, 6_000))
        ids, lists, total = rng.permutation(n), [], np.zeros(n, np.int64)
        for _ in range(int(rng.integers(1, 12))):
            docs = np.sort(rng.choice(n, int(rng.integers(1, n + 1)) // int(rng.choice([1, 2, 40])) or 1, replace=False))
            part = rng.integers(1, int(rng.choice([2, 5, 1_000])), len(docs)) + 1
            lists.append((docs, part))
            total[docs] += part
        docs, score = search.top_k(lists, ids, 10)
        want = sorted(((-int(s), int(i)) for s, i in zip(total, ids) if s > 0))[:10]
        assert [(-int(s), int(ids[d])) for d, s in zip(docs, score)] == want


def test_search_of_empty_tables(spark, make_docs):
    some, none = make_docs([(1, "one two")]), make_docs([(1, "x")]).where("false")
    asked = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert search.search(search.build_index(none), asked).count() == 0
    assert search.search(search.build_index(some), asked.where("false")).count() == 0
    assert search.search(search.build_index(make_docs([(1, None), (2, "?")])), asked).count() == 0


# -- fill in middle -----------------------------------------------------------
def transformed(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


TEXTS = [(i, t) for i, t in enumerate(
    ["é", "€", "😀", "a😀€éz" * 3, "\x00\x00", "<P>", "a<S", "<", "P>", "<<M>>", "日本語" * 7, "é" * 9, "\U0010ffff" * 5,
     "x" * 7, "x" * 8, "x" * 9, "é" * 4, "aé" * 40_000]
    + ["".join(np.random.default_rng(s).choice(list("aé€😀\n<SPM>"), s * 3)) for s in range(120)])]


def test_fill_in_middle_equals_brute_force_and_comes_back(make_docs):
    rows = TEXTS + ODD
    made = fim.fill_in_middle(make_docs(rows, parts=4))
    got = made.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(transformed(*r[:2]) for r in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(make_docs([(1, "x")]).where("false")).count() == 0


def test_units_of_any_alignment():
    rng = np.random.default_rng(2)
    for _ in range(200):
        texts = ["".join(rng.choice(list("aé€😀"), rng.integers(0, 20))) for _ in range(rng.integers(1, 12))]
        size = np.array([len(t) for t in texts])
        first, second = rng.integers(0, 1 << 32, (2, len(texts)))
        data, at, n, ((a, x), (b, y)) = fim.cut_points(pa.array(["skipped"] + texts).slice(1), first, second)
        assert n.tolist() == size.tolist()
        for k, t in enumerate(texts):
            assert bytes(data[at[k]:x[k]]).decode() == t[:a[k]]
            assert bytes(data[x[k]:y[k]]).decode() == t[a[k]:b[k]]
            assert bytes(data[y[k]:at[k + 1]]).decode() == t[b[k]:]


def test_sql_of_the_three_on_odd_rows(spark, make_docs):
    """The oracles and the queries' columns agree on nulls, blanks and repeated rows."""
    con = duckdb.connect()
    docs = make_docs(LINES + ODD + TEXTS)
    items = spark.createDataFrame([(1, "header own"), (2, "one cat"), (3, None)], "item_id long, text string")
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", items.toArrow())

    def same(df, sql):
        names = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, df.select(names).collect())) == Counter(want)

    lines = linedup.drop_common_lines(docs)
    same(lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")), linedup.ORACLE)
    made = fim.fill_in_middle(docs)
    same(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                     F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")), fim.ORACLE)
    same(search.search(search.build_index(docs), items), search.ORACLE)
