"""MinHash near-dedup: universal hash minima, banding, signature and full-set
verification, connected components by alternating large-star and small-star.

1. Every text becomes its set of distinct word shingles and a signature of
   BANDS * ROWS universal hash minima. Equal sets are one class (one node):
   copies cost one row each from here on.
2. Nodes that share a band's minima share a bucket. Every member of a bucket
   is compared by signature with the bucket's smallest node only, a number of
   pairs linear in the members. Members with an estimate of LOOSE or more join
   that leader's family; members below FIRM go on to another round with the
   next leader. (Distance is a metric: a member at FIRM or more and one below
   LOOSE differ by more than a link allows.) Pairs that pass ESTIMATE are
   confirmed on the full sets of the whole texts, and components follow.
3. Families that still hold several components are finished exactly: members
   are dealt into cells of two blocks (a block of the largest component against
   a block of the others, the others' blocks among themselves); a cell intersects
   the full sets of its pairs at once and returns a spanning forest of the links
   it finds.
4. What no leader took in after ROUNDS rounds (texts that share a passage, not
   their bulk) meets in cells of its bucket by signature, and what passes is
   confirmed on full sets.

What may be missed, at a similarity of 0.8: 28 bands of 4 rows miss a pair once
in 2.5 million, the signature estimate of 0.55 drops one in 30 million. A member
at FIRM or more of a leader leaves a bucket's later rounds on an estimate of 112
minima; a link to a member below LOOSE is then lost only if the two estimates err
by 0.1 together (true values differ by 0.2 at most), about two and a half of their
standard deviations, in every bucket the two share, and no other member joins them.

Both sides of a join follow the input: joins are merged or hashed after an exchange at
every size, so the driver never gathers a side for a broadcast (but the hot sets of the
last join, 1,024 at most).

Defined results: words are runs outside [\\x20\\x09-\\x0D] after lower-casing
A-Z; a text with fewer words than a shingle is one shingle; a text without
words, or null, has an empty set, links with nothing and is its own component;
repeated ids count as one document; an empty table gives no rows; extra
columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.arrowtext import coded_words, text_slices, tidy
from ledgerline.llm.common import attach, c, cut

BANDS, ROWS = 28, 4
ESTIMATE = 0.55  # share of equal minima below which a pair cannot be a link
LOOSE, FIRM = 0.3, 0.6  # of a leader's family; of members that need no other leader
ROUNDS = 2
GROUP = 4_096  # comparisons with one leader that share a task
BLOCK = 512  # members of a family or bucket compared at once
COLUMNS = 4_096  # shingles intersected at once in a cell
LEAST_PERCENT = 80  # what the bands and thresholds above are set for


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the universal hash functions x -> (a x + b) mod 2^64,
    of which the upper half counts; drawn once from a fixed seed."""
    draw = np.random.Generator(np.random.PCG64(20_011))
    a = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int):
    """The sorted array of distinct 64-bit shingle hashes of each text."""
    for _, part in text_slices(texts):
        yield from _slice_sets(part, width)


def _slice_sets(texts: pa.Array, width: int):
    import xxhash

    distinct, code, ends = coded_words(pc.ascii_lower(texts))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in distinct), np.uint64, len(distinct))
    word = hashes[code]
    joined = word.copy()
    for k in range(1, width):
        joined[:len(word) - k] = _mix(joined[:len(word) - k]) + word[k:]
    joined = _mix(joined)
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if end - start >= width:
            yield np.unique(joined[start:end - width + 1])
        elif end > start:
            # Fewer words than a shingle: the sequence as one, told apart by its length.
            whole = np.array([end - start], np.uint64)
            for k in range(start, end):
                whole = _mix(whole) + word[k:k + 1]
            yield _mix(whole)
        else:
            yield joined[:0]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(best, (shingles[at:at + 512, None] * a + b).min(0), out=best)
    return (best >> np.uint64(32)).astype("<u4").tobytes()


def sketch(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), sig. A written table."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("sig", pa.binary())])

    def run(batches):
        import xxhash

        a, b = multipliers()
        for batch in batches:
            out = [[], [], []]
            for s in shingle_sets(batch.column(1), width):
                out[0].append(len(s))
                out[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out[2].append(signature(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, f.type) for x, f in zip(out, list(schema)[1:]))], schema=schema)

    return cut(docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id long, n_shingles long, digest binary, sig binary"))


def band_rows(nodes: DataFrame) -> DataFrame:
    """(key, node): a node's bucket in each band."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
            for r in range(ROWS):
                key = _mix(key + sig[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], schema=schema)

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def compare(pairs: DataFrame, values: DataFrame, kind: str, keep) -> DataFrame:
    """The (a, b) rows of ``pairs`` with their score, unless it is negative.

    ``values`` has node and value (of SQL type ``kind``). A task gets a leader
    b once and then its members a, at most about GROUP of them: leaders with
    more are dealt over several groups. ``keep(values)`` is a factory called
    once per task; it returns load(array of values) -> prepared values and
    test(leader, member) -> score.
    """
    n = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / GROUP))
    dealt = pairs.join(n.hint("merge"), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("part"))
    lead = n.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("a"))
    rows = (dealt.hint("merge").join(values, dealt.a == values.node).select("b", "part", "a", "value")
            .unionByName(lead.hint("merge").join(values, lead.b == values.node).select("b", "part", "a", "value")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.int64())])

    def run(batches):
        load, test = keep()
        current, leader = None, None
        for batch in batches:
            out = ([], [], [])
            b, part, a = (batch.column(i).to_pylist() for i in range(3))
            for i, value in enumerate(load(batch.column(3))):
                if a[i] is None:
                    current, leader = (b[i], part[i]), value
                elif current == (b[i], part[i]) and (score := test(leader, value)) >= 0:
                    for column, x in zip(out, (a[i], b[i], score)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
            .mapInArrow(tidy(run), "a long, b long, score long"))


def minima(estimate: float) -> int:
    """The number of equal minima that makes an estimate."""
    return int(np.ceil(estimate * BANDS * ROWS))


def by_signature():
    """Scores a pair by its equal minima."""
    def load(values):
        return [np.frombuffer(x, "<u4") for x in values.to_pylist()]

    return load, lambda a, b: int((a == b).sum())


def by_sets(width: int, percent: int):
    """Keeps the pairs of texts that are links."""
    def keep():
        def test(a, b):
            shared = len(np.intersect1d(a, b, assume_unique=True))
            return 0 if 100 * shared >= percent * (len(a) + len(b) - shared) else -1

        return lambda values: shingle_sets(values, width), test

    return keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): alternating large-star and
    small-star until the stars no longer change; root is the smallest node."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = cut(small)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def families(members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, score) of members and the leaders whose family they join, the
    (key, node) rows that need cells of their bucket), from the (key, node) rows
    of buckets."""
    sigs = nodes.select("node", F.col("sig").alias("value"))
    rest, edges = members, None
    for _ in range(ROUNDS):
        lead = rest.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        stars = cut(rest.join(lead.hint("merge"), "key").where("node <> b"))
        scored = cut(compare(stars.select(F.col("node").alias("a"), "b").distinct(), sigs, "binary", by_signature))
        found = scored.where(F.col("score") >= minima(LOOSE))
        edges = found if edges is None else edges.unionByName(found)
        rest = cut(stars.withColumnRenamed("node", "a").join(scored.hint("merge"), ["a", "b"])
                   .where(F.col("score") < minima(FIRM)).select("key", F.col("a").alias("node")))
    return cut(edges.groupBy("a", "b").agg(F.max("score").alias("score"))), rest


def cells(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Deal the (key, node) rows of each key into cells (key, i, j) of about two
    BLOCKs, so that two members of different groups of ``groups`` (node, root)
    meet in one: block i of the largest group meets block k of the others in
    (i, -1 - k), and blocks i and j of the others meet in (i, j). Rows of a cell
    with the same ``side`` are not compared: in the first kind that is all of the
    others, in the second a group. Keys with one group are done."""
    labelled = members.join(groups.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.count("*").alias("roots"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top")
    ).where("roots > 1").select(
        "key", F.col("top.root").alias("top"), F.ceil(F.col("top.n") / BLOCK).alias("top_blocks"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("blocks"))
    rows = labelled.join(mixed.hint("merge"), "key")
    own, home = (F.pmod(F.xxhash64("node"), F.col(n)) for n in ("blocks", "top_blocks"))
    among = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.col("root").alias("side")))
    against = F.transform(F.sequence(F.lit(0), F.col("top_blocks") - 1), lambda i: F.struct(
        i.alias("i"), (-1 - own).alias("j"), F.lit(-1).cast("long").alias("side")))
    top = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        home.alias("i"), (-1 - k).alias("j"), F.col("root").alias("side")))
    return (rows.withColumn("cell", F.explode(F.when(F.col("root") == F.col("top"), top)
                                              .otherwise(F.concat(against, among))))
            .select("key", "cell.i", "cell.j", "cell.side", "node", "root"))


def near_in_cell(side: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """For each row but the last, the later rows of another side that pass the estimate."""
    least, out = minima(ESTIMATE), []
    for i in range(len(side) - 1):
        later = np.flatnonzero(side[i + 1:] != side[i]) + i + 1
        out.append(later[(sig[later] == sig[i]).sum(1) >= least])
    return out


def _cell(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, roots and the near rows of each of a cell."""
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(table.num_rows, -1)
    return table.column("node").to_numpy(), table.column("root").to_numpy(), near_in_cell(table.column("side").to_numpy(), sig)


def pairs_in_cells(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups that pass the signature estimate."""
    def run(table: pa.Table) -> pa.Table:
        node, root, near = _cell(table)
        left = np.repeat(node[:-1], [len(x) for x in near])
        right = node[np.concatenate(near)] if near else left
        return pa.table({"a": np.maximum(left, right), "b": np.minimum(left, right)})

    return dealt.hint("merge").join(nodes.select("node", "sig"), "node").groupBy("key", "i", "j").applyInArrow(
        run, "a long, b long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = uses[column] > 1
    row, column = row[several], (np.cumsum(uses > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def links_in_cells(dealt: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the links between different groups in each cell;
    ``sets`` has node and shingles (sorted 64-bit hashes)."""
    def run(table: pa.Table) -> pa.Table:
        node, root, near = _cell(table)
        some = np.unique(np.concatenate([[i, *x] for i, x in enumerate(near) if len(x)] or [[]])).astype(int)
        out = []
        if len(some):
            chosen = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles").take(pa.array(some))]
            shared, size = shared_counts(chosen), np.array([len(x) for x in chosen])
            link = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
            place = np.full(len(node), -1)
            place[some] = np.arange(len(some))
            top = {r: r for r in root.tolist()}

            def find(r):
                while top[r] != r:
                    top[r] = r = top[top[r]]
                return r

            for i, later in enumerate(near):
                if len(later):
                    for j in later[link[place[i], place[later]]].tolist():
                        x, y = find(int(root[i])), find(int(root[j]))
                        if x != y:
                            top[x] = y
                            out.append((int(max(node[i], node[j])), int(min(node[i], node[j]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    rows = dealt.hint("merge").join(nodes.select("node", "sig"), "node").join(sets.hint("merge"), "node")
    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_components(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, n_shingles, digest per document, and per distinct
    set its digest, copies and component_id. Both are written tables."""
    rows = sketch(docs, width, id_col, text_col)
    nodes = cut(rows.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("min_id"), F.count("*").alias("copies"), F.first("sig").alias("sig")
    ).withColumn("node", F.monotonically_increasing_id()))
    bands = cut(band_rows(nodes))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(bands.join(shared.hint("merge"), "key").select("key", "node"))

    # The texts cross one exchange, by id and at every size alike; those of the members,
    # one or few a node, are kept for all that follows.
    several = nodes.select("node", F.col("min_id").alias("_id"), "digest").join(
        members.select("node").distinct().hint("merge"), "node", "left_semi").hint("shuffle_hash")
    texts = docs.select(c(id_col).cast("long").alias("_id"), c(text_col).alias("value"))
    kept = cut(texts.join(several, texts["_id"].eqNullSafe(several["_id"])).select("node", "digest", "value"))

    def own(wanted: DataFrame, as_sets: bool) -> DataFrame:
        """(node, value): a text with the node's set, or the set, for the nodes of ``wanted``."""
        ends = cut(wanted.select("node").distinct())
        return _own(kept.join(ends.hint("shuffle_hash"), "node", "left_semi"), width, as_sets)

    def confirm(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        return cut(compare(pairs, own(wanted, False), "string", by_sets(width, percent)).select("a", "b"))

    edges, rest = families(members, nodes)
    links = confirm(edges.where(F.col("score") >= minima(ESTIMATE)).select("a", "b"))
    roots = cut(components(links))
    family = cut(components(edges))
    dealt = cut(cells(family.select(F.col("root").alias("key"), "node"), roots))
    sets = cut(own(dealt, True)).withColumnRenamed("value", "shingles").dropDuplicates(["node"])
    inside = cut(links_in_cells(dealt, nodes, sets, percent))
    outside = confirm(cut(pairs_in_cells(cells(rest, family), nodes)))
    more = inside.unionByName(outside)
    if more.take(1):
        roots = cut(components(links.unionByName(more)))
    placed = nodes.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("min_id").alias("component_id"))
    classes = cut(placed.join(smallest.hint("merge"), "root").select("digest", "copies", "component_id"))
    return rows, classes


def _own(found: DataFrame, width: int, as_sets: bool) -> DataFrame:
    """(node, value) where the text has the node's own set (ids may repeat): the text,
    or its shingles."""
    schema = pa.schema([("node", pa.int64()), ("value", pa.binary() if as_sets else pa.string())])

    def run(batches):
        import xxhash

        for batch in batches:
            want, same, sets = batch.column(1).to_pylist(), [], []
            for i, s in enumerate(shingle_sets(batch.column(2), width)):
                raw = s.tobytes()
                same.append(xxhash.xxh3_128_digest(raw) == want[i])
                if as_sets and same[-1]:
                    sets.append(raw)
            kept = batch.filter(pa.array(same, pa.bool_()))
            value = pa.array(sets, pa.binary()) if as_sets else kept.column(2)
            yield pa.RecordBatch.from_arrays([kept.column(0), value], schema=schema)

    return found.mapInArrow(tidy(run), f"node long, value {'binary' if as_sets else 'string'}")


def near_dedup(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document. ``percent`` is 80 or more."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"bands and thresholds are set for {LEAST_PERCENT} percent and more, not {percent}")
    rows, classes = near_components(docs, width, percent, id_col, text_col)
    found = attach(rows.select("doc_id", "n_shingles", "digest"), classes, "digest", "copies", salt_by="doc_id",
                   merge=True)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component
    the document with the smallest id."""
    gone = near_dedup(docs, width, percent, id_col, text_col).where(~F.col("kept")).select(
        F.col("doc_id").alias("_gone")).distinct()
    marked = docs.withColumn("_id", c(id_col).cast("long"))
    return marked.join(cut(gone), F.col("_id") == F.col("_gone"), "left_anti").select(*[c(n) for n in docs.columns])
