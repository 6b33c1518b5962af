"""Secret scans with an incremental blob ledger.

Every historical version of a path is content-addressed (SHA-256 of its text).
The ledger holds, for each blob, the rule versions that have scanned it and
what they found. A run scans only the (blob, rule version) pairs the ledger
does not hold, once per blob however many paths carry it, and joins findings
back to all paths. Raising a rule's version rescans all blobs with that rule
alone.

Base rules take the leftmost non-overlapping matches of their pattern and then
drop those that are too short; added rules find private-key headers and the
tokens of two services. Spans are in code points, end exclusive, by start and
then in the order of the rules.

Defined results: a null text counts as empty (no finding); repeated rows and
paths get the findings of their blob each; an empty table gives no rows; extra
columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.arrowtext import tidy
from ledgerline.llm.common import attach, c, cut, digest


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    least: int = 0  # characters of the measured group
    group: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()  # lower-case words, one of which every match holds

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_KINDS = ("assign", "access", "hex")
# Fixed patterns of the base kinds, then the added ones.
RULES = (
    Rule("assign", 1,
         r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         6, 2, True, ("password", "passwd", "secret", "token", "api_key", "apikey")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, needs=("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("-----begin ",)),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
)

LEDGER = "blob binary, rules array<string>, findings array<struct<start: bigint, end: bigint, rule: string>>"
SPANS = "array<struct<start: bigint, rank: int, kind: string, end: bigint>>"


def matcher(rules: tuple[Rule, ...]):
    """text, rule names -> [(start, end, rule name)], in the order of the text."""
    compiled = {}
    for r in rules:
        pattern = r.pattern
        if r.group == 0 and r.least and re.fullmatch(r"\[[^]]+\]\+", pattern):
            pattern = f"{pattern[:-1]}{{{r.least},}}"  # a run of one class: its length is known at once
        compiled[r.name] = (r, re.compile(pattern, re.A | (re.I if r.any_case else 0)))

    def find(text: str, names) -> list[tuple[int, int, str]]:
        low = text.lower()
        found = []
        for name in names:
            r, pattern = compiled[name]
            if r.needs and not any(x in low for x in r.needs):
                continue
            for m in pattern.finditer(text):
                if m.end(r.group) - m.start(r.group) >= r.least:
                    found.append((m.start(), m.end(), name))
        return sorted(found)

    return find


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rules, findings) of the blob and rule-version pairs
    among ``versions`` that ``ledger`` does not hold yet."""
    every = F.array(*[F.lit(r.name) for r in rules])
    text = F.coalesce(c(text_col), F.lit(""))
    # Copies meet before the shuffle: one text per blob leaves each task.
    blobs = versions.select(digest(text).alias("blob"), text.alias("text")).groupBy("blob").agg(
        F.first("text").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("rules", every)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(
            F.collect_set("rule").alias("seen"))  # at most one entry per rule version
        todo = (blobs.join(seen, "blob", "left")
                .withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
                .where(F.size("rules") > 0))
    schema = pa.schema([
        ("blob", pa.binary()), ("rules", pa.list_(pa.string())),
        ("findings", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string())])))])

    def run(batches):
        find = matcher(rules)
        for batch in batches:
            texts, names = batch.column(1), batch.column(2).to_pylist()
            found = [[dict(zip(("start", "end", "rule"), x)) for x in find(t.as_py(), n)]
                     for t, n in zip(texts, names)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, schema.field(1).type), pa.array(found, schema.field(2).type)],
                schema=schema)

    return todo.select("blob", "text", "rules").mapInArrow(tidy(run), LEDGER)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES,
                     path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, findings) for every row of ``versions``: what the current rule
    versions found in its blob, empty if nothing."""
    rows = versions.select(c(path_col).alias("path"), digest(c(text_col)).alias("blob"))
    known = F.array(*[F.lit(r.name) for r in rules])
    # Findings of rule versions that are no longer current are left behind.
    current = F.filter("findings", lambda x: F.array_contains(known, x["rule"]))
    span = F.transform(current, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(known, x["rule"]).cast("int").alias("rank"),
        F.substring_index(x["rule"], "@", 1).alias("kind"), x["end"].alias("end")))
    spans = (ledger.where(F.arrays_overlap("rules", known)).select("blob", span.alias("spans")).groupBy("blob")
             .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("findings")))
    copies = rows.groupBy("blob").agg(F.count("*").alias("copies"))
    groups = cut(copies.join(spans, "blob", "left"))
    return attach(rows, groups, "blob", "copies", salt_by="path").select(
        "path", F.coalesce("findings", F.array().cast(SPANS)).alias("findings"))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans for every document."""
    fresh = cut(scan_unseen(docs, ledger))
    whole = fresh if ledger is None else ledger.unionByName(fresh)
    found = findings_by_path(docs, whole)

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def of(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("path").alias("doc_id"), *[of(k) for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
