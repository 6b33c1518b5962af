"""Incremental catalog snapshot: which objects changed, are new or vanished
since the last snapshot, and the content to write for them.

The reference walks a local directory and fetches object source one by one.
Here the previous run's manifest is a table ``(db_nm, sc_nm, file_nm,
file_last_modified)`` and object source is a ``ddl`` column, so the whole
decision is one aggregation and one full outer join. Stored content (``K7``) is
one row per overload, in signature order, whatever their number; a file's text
is the concatenation of its rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File extension per object type.
EXTENSIONS = {
    "TABLE": ".tbl",
    "EXTERNAL TABLE": ".tbl",
    "DYNAMIC TABLE": ".tbl",
    "VIEW": ".vw",
    "PROCEDURE": ".pr",
    "TASK": ".tsk",
    "STREAM": ".stm",
    "FILE_FORMAT": ".ff",
    "PIPE": ".pipe",
    "FUNCTION": ".func",
    "SEQUENCE": ".seq",
}
# Listing source → object type for the information_schema-style views.
SOURCE_TYPES = {
    "external_tables": "EXTERNAL TABLE",
    "views": "VIEW",
    "file_formats": "FILE_FORMAT",
    "sequences": "SEQUENCE",
    "pipes": "PIPE",
}
OVERLOADED = ("PROCEDURE", "FUNCTION")


def schema_list(schemata: DataFrame, system_databases: Sequence[str] = ()) -> DataFrame:
    """Live schemas, without INFORMATION_SCHEMA and the platform's own
    databases; ordered by database, then schema descending."""
    s = schemata.filter(F.col("deleted").isNull() & ~F.col("schema_name").isin("INFORMATION_SCHEMA"))
    if system_databases:
        s = s.filter(~F.col("catalog_name").isin(*system_databases))
    return (s.select(F.col("catalog_name").alias("database_name"), "schema_name")
            .orderBy(F.col("database_name").asc(), F.col("schema_name").desc()))


def object_list(listing: DataFrame) -> DataFrame:
    """One frame of catalog objects with their change time.

    ``tables``: ``table_type LIKE '%TABLE' AND NOT LIKE 'EXTERNAL TABLE'`` → TABLE;
    the other information_schema views map to their type; ``show`` rows (task,
    stream, dynamic table) use ``created_on`` as change time, so an altered
    task is not seen as changed (kept as in the reference).
    """
    src = F.col("source")
    mapping = F.create_map(*[x for k, v in SOURCE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    obj_type = (F.when(src == "tables", F.lit("TABLE"))
                .when(src == "show", F.col("table_type"))
                .otherwise(mapping[src]))
    keep = ((src != "tables") | (F.col("table_type").like("%TABLE") & ~F.col("table_type").like("EXTERNAL TABLE")))
    changed = F.when(src == "show", F.col("created_on")).otherwise(F.col("last_altered"))
    return (listing.filter(keep & obj_type.isNotNull())
            .select("db_nm", "sc_nm", obj_type.alias("obj_type"), "obj_name", changed.alias("last_altered")))


def normalise_signature(sig: Column) -> Column:
    """``(A VARCHAR, B NUMBER)`` → ``(VARCHAR, NUMBER)``; ``()`` stays; a
    trailing `` RETURN ...`` is cut. Odd tokens after splitting on blanks."""
    s = F.regexp_replace(sig, " RETURN .*", "")
    return F.when(s == "()", s).otherwise(
        F.concat(F.lit("("), F.array_join(F.filter(F.split(s, " "), lambda x, i: i % 2 == 1), " ")))


def with_overload_time(objects: DataFrame) -> DataFrame:
    """Every signature carries its name's latest change time.

    A grouped max (partial aggregation) joined back by name rather than a
    window: a name with very many overloads is then never buffered in one
    task, and AQE can split the join if one name is hot."""
    keys = ["db_nm", "sc_nm", "obj_type", "obj_name"]
    latest = objects.groupBy(*keys).agg(F.max("last_altered").alias("obj_last_altered"))
    return objects.join(latest, keys, "inner")


def extension(obj_type: Column) -> Column:
    """E3; a type without a fixed extension gets its own name as one, so that its
    files are written and found again like any other."""
    m = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, obj_type), F.concat(F.lit("."), F.lower(F.replace(obj_type, F.lit(" "), F.lit("_")))))


def in_scope(objects: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Restrict to the schemas in ``scope(db_nm, sc_nm)`` (None = all). The scope,
    a list of schemas that the caller names, goes to every task: dealt by schema, all
    objects of a run over one schema would meet in one task."""
    if scope is None:
        return objects
    return objects.join(named_schemas(scope), ["db_nm", "sc_nm"], "left_semi")


def named_schemas(scope: DataFrame) -> DataFrame:
    return F.broadcast(scope.select("db_nm", "sc_nm"))


def object_files(objects: DataFrame) -> DataFrame:
    """One row per file: (db_nm, sc_nm, file_nm, obj_type, obj_name, obj_last_altered,
    no_source). no_source: the source text of an overload could not be fetched."""
    missing = F.col("ddl").isNull() if "ddl" in objects.columns else F.lit(False)
    return (objects.groupBy("db_nm", "sc_nm", "obj_type", "obj_name")
            .agg(F.max("last_altered").alias("obj_last_altered"), F.max(missing).alias("no_source"))
            .withColumn("file_nm", F.concat(F.col("obj_name"), extension(F.col("obj_type")))))


KEYS = ["db_nm", "sc_nm", "file_nm"]
# Joins and groupings by file go by this number; names are compared where it is equal.
# Rows are so sorted by one number, where all names of a catalog begin alike.
ID = "file_id"


def with_id(rows: DataFrame) -> DataFrame:
    return rows if ID in rows.columns else rows.withColumn(ID, F.xxhash64(*KEYS))


LISTED = "listed_"


def as_listed(files: DataFrame, names: Sequence[str] = KEYS) -> DataFrame:
    """``files`` with their id; it and ``names`` are renamed to stand beside those of the rows they are joined to."""
    return with_id(files).withColumnsRenamed({n: LISTED + n for n in (ID, *names)})


def same_file(names: Sequence[str] = KEYS) -> Column:
    """A row, with its file's id, and a listed file agree in ``names``; names that are
    NULL agree with nothing. Written as a lookup, not as equalities, which would make
    Spark deal and sort by every name and compute derived ones again to drop NULLs."""
    def row(prefix: str) -> Column:
        return F.struct(*[F.col(prefix + n).alias(n) for n in names])

    return reduce(and_, [F.col(LISTED + n).isNotNull() for n in names],
                  F.col(ID) == F.col(LISTED + ID)) & F.array_contains(F.array(row(LISTED)), row(""))


def of_files(rows: DataFrame, files: DataFrame, names: Sequence[str] = KEYS) -> DataFrame:
    """The rows that agree with one of ``files`` in ``names``, with their file's id."""
    return with_id(rows).join(as_listed(files.select(*names), names), same_file(names), "left_semi")


def changes(objects: DataFrame, manifest: DataFrame, delete: bool = False,
            scope: DataFrame | None = None) -> DataFrame:
    """E4 + E5: per file NEW, CHANGED, NO_CHANGE, ERROR, or NOT_SEEN / DELETE.

    NO_CHANGE when the file is at least as new as the object's latest change;
    a NULL change time never counts as unchanged. ERROR when the file should be
    written but its source is missing: what was stored before stays.
    """
    files = with_id(object_files(in_scope(objects, scope)))
    j = files.join(as_listed(in_scope(manifest, scope)), same_file(), "full_outer")
    status = (F.when(F.col("obj_name").isNull(), F.lit("DELETE" if delete else "NOT_SEEN"))
              .when(F.col("file_last_modified") >= F.col("obj_last_altered"), F.lit("NO_CHANGE"))
              .when(F.col("no_source"), F.lit("ERROR"))
              .when(F.col("file_last_modified").isNull(), F.lit("NEW"))
              .otherwise(F.lit("CHANGED")))
    kept = ["version"] if "version" in manifest.columns else []
    return j.select(*[F.coalesce(k, LISTED + k).alias(k) for k in KEYS], "obj_type", "obj_name", "obj_last_altered",
                    "file_last_modified", status.alias("status"), *kept)


def content_parts(objects: DataFrame, files_to_write: DataFrame | None = None) -> DataFrame:
    """E6 as it is stored: (db_nm, sc_nm, file_nm, part, content), one row per
    overload; ``part`` is the signature, and a file's text is its rows in order of
    ``part`` and content. ``files_to_write`` (db_nm, sc_nm, file_nm) limits the
    work to files that changed: the source of the others is not moved."""
    return _parts_with_id(objects, files_to_write).drop(ID)


def _parts_with_id(objects: DataFrame, files_to_write: DataFrame | None) -> DataFrame:
    o = with_id(objects.withColumn("file_nm", F.concat(F.col("obj_name"), extension(F.col("obj_type")))))
    if files_to_write is not None:
        o = of_files(o, files_to_write)
    return o.select(*KEYS, F.coalesce("argument_signature", F.lit("")).alias("part"), F.col("ddl").alias("content"), ID)


def content(objects: DataFrame, files_to_write: DataFrame | None = None) -> DataFrame:
    """The text of each file, overloads concatenated in signature order:
    (db_nm, sc_nm, file_nm, content, n_parts)."""
    return file_text(_parts_with_id(objects, files_to_write))


def file_text(parts: DataFrame) -> DataFrame:
    """One row per file from its stored parts; the text of one file is one value."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "content")))
    return (with_id(parts).groupBy(ID, *KEYS)
            .agg(F.concat_ws("\n", ordered["content"]).alias("content"),
                 F.count(F.lit(1)).alias("n_parts")).drop(ID))


def next_manifest(changed: DataFrame, run_ts: Column, version: str | None = None) -> DataFrame:
    """The manifest after this run: rewritten files get ``run_ts`` (and the
    version that holds them), the others keep what they had; NOT_SEEN files stay
    listed, deleted ones and errors that were never stored do not."""
    keep = changed.filter((F.col("status") != "DELETE") & ~((F.col("status") == "ERROR") & F.col("file_last_modified").isNull()))
    written = F.col("status").isin("NEW", "CHANGED")
    out = [*KEYS, F.when(written, run_ts).otherwise(F.col("file_last_modified")).alias("file_last_modified")]
    if version is not None:
        before = F.col("version") if "version" in changed.columns else F.lit(None).cast("string")
        out.append(F.when(written, F.lit(version)).otherwise(before).alias("version"))
    return keep.select(*out)
