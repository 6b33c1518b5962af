"""The corpus pipeline stage by stage against brute force, and run() against its stages."""

import os
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from ledgerline.llm import packing
from ledgerline.session import scratch_path
from tests.llm.test_operators import brute_components, check_places, split_words, water_fill

SPACE = re.compile(r"[\x20\x09-\x0D]")


def corpus():
    """Documents in two languages with exact and near copies, and odd rows."""
    draw = random.Random(12)
    english = "the cat sat on a mat and dogs ran to house with many people who were going home".split()
    german = "der Hund und die Katze sind über Straße gelaufen weil es schon spät geworden war".split()
    rows = []
    for i in range(90):
        lang, words = (("en", english), ("de", german))[i % 2]
        text = " ".join(draw.choices(words, k=draw.randint(5, 60)) + [f"number{i}"])
        rows.append((i, text, lang, "abc"[i % 3] if i % 7 else None))
    for i in range(0, 20, 2):
        rows.append((100 + i, " ".join(rows[i][1].split(" ")) + " \n", rows[i][2], "a"))  # an exact copy
        words = rows[i + 20][1].split() * 4
        rows.append((200 + i, " ".join(words), "en", "b"))
        rows.append((300 + i, " ".join(words + ["tail"]), "en", "c"))  # a near copy
    rows += [(400, None, None, None), (401, "", "en", "a"), (402, " \t\n", "en", "a"), (403, "### 1234", "en", "a"),
             (404, "same text in every row", "en", "b"), (404, "same text in every row", "en", "b"), (405, "word " * 30_000, "en", "c")]
    return rows


def brute_stage(name, before):
    """(id, text, source) rows that stay, for the stages that choose among rows."""
    if name == "language_id":
        return Counter(r for r in before if r[1] and any(ch.isalpha() for ch in r[1]))
    if name == "exact_dedup":
        best = {}
        for r in before:
            key = SPACE.sub("", r[1] or "")
            best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1] or ""), x[0]))
        return Counter(best.values())
    components = brute_components([r[:2] for r in before], 5, 80)
    return Counter(r for r in before if components[r[0]][1] == r[0])


def plain(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, make_docs):
    """[(name, rows before, result as written and read again)]"""
    docs, out = make_docs(corpus(), parts=4), []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"stage_{uuid.uuid4().hex}")
        stage(spark, docs, "nowhere").write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_the_stages_and_their_columns(stages, make_docs):
    assert [name for name, *_ in stages] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    columns = make_docs(corpus()).columns
    assert all(after.columns == columns for _, _, after in stages[:-1])


@pytest.mark.parametrize("which", [0, 1, 2])
def test_stages_that_choose_among_rows(stages, which):
    name, before, after = stages[which]
    rows = plain(before)
    got = Counter(plain(after))
    assert got == brute_stage(name, rows) and sum(got.values()) < len(rows)


def test_mixed_copies(stages):
    _, before, after = stages[3]
    rows, got = plain(before), Counter(plain(after))
    sizes, taken = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += len(split_words(text))
    assert set(got) <= set(rows) and max(got.values()) <= 3
    for (_, text, source), n in got.items():
        taken[source] += n * len(split_words(text))
    for source, target in water_fill(dict(sizes)).items():
        gap = round(target) - taken[source]
        useful = [len(split_words(r[1])) for r in rows if r[2] == source and (got[r] < 3 if gap > 0 else got[r] > 0)]
        assert abs(gap) < min(useful, default=1)


def test_packed_pieces(stages):
    from tokenizers import Tokenizer

    _, before, after = stages[4]
    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for doc, text, _ in plain(before):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[doc, piece, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    rows = after.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check_places(rows, 2048) >= -(-sum(r.length for r in rows) // 2048)


def written(spark, docs):
    folder = scratch_path(spark, f"tables_{uuid.uuid4().hex}")
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    return folder


def test_run_is_its_stages(spark, make_docs, stages):
    def pieces(df):
        return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())

    run = corpus_pipeline.run(spark, written(spark, make_docs(corpus(), parts=4)))
    assert pieces(run) == pieces(stages[-1][2])
    fills = defaultdict(int)
    for r in run.collect():
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048


def test_run_on_an_empty_table(spark, make_docs):
    assert corpus_pipeline.run(spark, written(spark, make_docs([(1, "x")]).where("false"))).count() == 0
