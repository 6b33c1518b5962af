"""Name audit: identifier checks over a table of names, one pass, no UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import identifiers as ident


def audit_names(names: DataFrame, col: str = "name") -> DataFrame:
    """Every N1-N6 verdict for each name, as columns of one projection."""
    c = F.col(col)
    two = ident.split_db_sc(c)
    three = ident.split_db_sc_obj(c)
    parsed = ident.parse_name(c)
    sch = ident.parse_schema(c)
    return names.select(
        "*",
        ident.is_unquoted_name(c).alias("is_unquoted"),
        ident.is_quoted_name(c).alias("is_quoted"),
        ident.matches_name(c).alias("is_name"),
        ident.matches_schema(c).alias("is_schema"),
        two["db"].alias("split_db"), two["sc"].alias("split_sc"),
        three["db"].alias("obj_db"), three["sc"].alias("obj_sc"), three["obj"].alias("obj_name"),
        parsed["name"].alias("parsed_name"), parsed["quoted"].alias("parsed_quoted"),
        parsed["error"].alias("parse_error"),
        sch["db"].alias("schema_db"), sch["sc"].alias("schema_sc"), sch["error"].alias("schema_error"))

