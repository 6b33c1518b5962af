"""Name-audit queries over the ``names`` fixture (one name per part)."""

from __future__ import annotations

from ledgerline.operators.names import audit_names
from ledgerline.plans.registry import register
from ledgerline.sources.fixtures import fixture, oracle_cte

CTE = oracle_cte("names")

# The rules again, for the oracle alone: a letter or underscore and up to 254 more
# letters, digits, underscores or dollar signs; or 1 to 253 printable ASCII
# characters, quotes included, between quotes.
UNQUOTED = "[[:alpha:]_][[:alnum:]_$]{0,254}"
NAME = f'{UNQUOTED}|"[ -~]{{1,253}}"'


def _unq(x: str) -> str:
    return f"coalesce(position('\"' in {x}) = 0 and regexp_full_match({x}, '{UNQUOTED}'), false)"


def _quo(x: str) -> str:
    q = f"(length({x}) - length(replace({x}, '\"', '')))"
    d = f"(cast(floor({q} / 2) as integer) - 2)"
    return (f"coalesce({q} % 2 = 0 and {q} >= 2 and regexp_full_match({x}, '\"(?:[^\"]|\"\")+\"') and "
            f"case when {q} = 2 then length({x}) between 3 and 255 else length({x}) between 3 + {d} and 255 + {d} end, false)")


def _nm(x: str) -> str:
    return f"({_unq(x)} or {_quo(x)})"


def _cnt(x: str, sub: str) -> str:
    return f"cast(floor((length({x}) - length(replace({x}, '{sub}', ''))) / {len(sub)}) as integer)"


def _audit():
    return lambda spark, sf_dir: audit_names(fixture(spark, sf_dir, "names"))


@register("name_unquoted", CTE + f"\nselect id, name, {_unq('name')} as is_unquoted from names")
def name_unquoted(spark, sf_dir):
    return _audit()(spark, sf_dir).select("id", "name", "is_unquoted")


@register("name_quoted", CTE + f"\nselect id, name, {_quo('name')} as is_quoted from names")
def name_quoted(spark, sf_dir):
    return _audit()(spark, sf_dir).select("id", "name", "is_quoted")


_S2 = f""",
p as (select id, name, {_cnt('name', '.')} as periods,
             split_part(name, '.', 1) as one_db, split_part(name, '.', 2) as one_sc,
             split_part(name, '"."', 1) || '"' as both_db, '"' || split_part(name, '"."', 2) as both_sc,
             split_part(name, '".', 1) || '"' as pre_db, split_part(name, '".', 2) as pre_sc,
             split_part(name, '."', 1) as post_db, '"' || split_part(name, '."', 2) as post_sc,
             {_cnt('name', '"."')} as n_both, {_cnt('name', '".')} as n_pre, {_cnt('name', '."')} as n_post
        from names),
r as (select id, name,
             case when periods = 1 and {_nm('one_db')} and {_nm('one_sc')} then one_db
                  when periods > 1 and n_both = 1 and {_quo('both_db')} and {_quo('both_sc')} then both_db
                  when periods > 1 and n_both <> 1 and n_pre = 1 and {_quo('pre_db')} and {_unq('pre_sc')} then pre_db
                  when periods > 1 and n_both <> 1 and n_pre <> 1 and n_post = 1 and {_unq('post_db')} and {_quo('post_sc')}
                    then upper(post_db) end as split_db,
             case when periods = 1 and {_nm('one_db')} and {_nm('one_sc')} then one_sc
                  when periods > 1 and n_both = 1 and {_quo('both_db')} and {_quo('both_sc')} then both_sc
                  when periods > 1 and n_both <> 1 and n_pre = 1 and {_quo('pre_db')} and {_unq('pre_sc')} then upper(pre_sc)
                  when periods > 1 and n_both <> 1 and n_pre <> 1 and n_post = 1 and {_unq('post_db')} and {_quo('post_sc')}
                    then post_sc end as split_sc
        from p)"""


@register("name_split2", CTE + _S2 + "\nselect id, name, split_db, split_sc from r")
def name_split2(spark, sf_dir):
    return _audit()(spark, sf_dir).select("id", "name", "split_db", "split_sc")


@register("name_split3", CTE + f""",
p as (select id, name, split_part(name, '.', 1) as a, split_part(name, '.', 2) as b, split_part(name, '.', 3) as c,
             {_cnt('name', '.')} as periods from names),
q as (select *, periods = 2 and {_nm('a')} and {_nm('b')} and {_nm('c')} as ok from p)
select id, name, case when ok then a end as obj_db, case when ok then b end as obj_sc, case when ok then c end as obj_name
  from q""")
def name_split3(spark, sf_dir):
    return _audit()(spark, sf_dir).select("id", "name", "obj_db", "obj_sc", "obj_name")


_NAME_SQL = NAME.replace("'", "''")


@register("name_parse", CTE + f""",
m as (select id, name, regexp_extract_all(name, '({_NAME_SQL})', 1) as ms from names),
p as (select id, name, ms[1] as first, len(ms) as n from m),
e as (select id, name, first,
             case when n = 0 then 'no match' when n <> 1 and length(first) <> 1 then 'match length incorrect' end as err
        from p)
select e.id, e.name,
       coalesce(regexp_full_match(e.name, '{_NAME_SQL}'), false) as is_name,
       coalesce(regexp_full_match(e.name, '(?:(?:{_NAME_SQL})\\.)?(?:{_NAME_SQL})'), false) as is_schema,
       case when err is null then first end as parsed_name,
       case when err is null then position('"' in first) > 0 end as parsed_quoted,
       err as parse_error,
       case when regexp_full_match(e.name, '(?:({_NAME_SQL})\\.)({_NAME_SQL})')
            then regexp_extract(e.name, '^(?:({_NAME_SQL})\\.)({_NAME_SQL})$', 1) end as schema_db,
       case when regexp_full_match(e.name, '(?:({_NAME_SQL})\\.)({_NAME_SQL})')
            then regexp_extract(e.name, '^(?:({_NAME_SQL})\\.)({_NAME_SQL})$', 2) end as schema_sc
  from e""")
def name_parse(spark, sf_dir):
    return _audit()(spark, sf_dir).select("id", "name", "is_name", "is_schema", "parsed_name", "parsed_quoted",
                                          "parse_error", "schema_db", "schema_sc")
