"""String similarity scalars for difference reports, all as column expressions.

Edit distance and soundex are Spark built-ins. Jaro-Winkler merges the place lists
of each character in one fold, linear in the characters after a sort; callers apply
it to *grouped* value pairs (one row per distinct from/to pair), never to raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Winkler modification (standard definition).
WINKLER_PREFIX_SCALE = 0.1
WINKLER_MAX_PREFIX = 4
WINKLER_BOOST_THRESHOLD = 0.7


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _chars(c: Column) -> Column:
    """The characters of a string; none of the empty string."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def _places(chars: Column) -> Column:
    """(character, place) in the order of both: each character's places are a run."""
    return F.sort_array(F.transform(chars, lambda x, i: F.struct(x.alias("c"), i.alias("at"))))


CHUNK = 64  # matches per inner array: an append copies no more than that


def _matches(a: Column, b: Column, window: Column) -> Column:
    """The (place in ``a``, place in ``b``) of matched characters.

    Taking the characters of ``a`` in order, each is matched with the first equal one
    of ``b`` within ``window`` that is still free. For one character these choices are
    a merge of its two place lists: what lies before the window of a place lies before
    those of all later ones. One fold over both sorted lists does all characters.
    """
    def merge(x: Column, y: Column) -> Column:
        def step(now: Column, _: Column) -> Column:
            p, q = F.get(x, now["p"]), F.get(y, now["q"])
            behind = (p["c"] < q["c"]) | ((p["c"] == q["c"]) & (p["at"] + window < q["at"]))
            ahead = (p["c"] > q["c"]) | ((p["c"] == q["c"]) & (p["at"] - window > q["at"]))
            hit = ~behind & ~ahead
            full = F.size(now["last"]) >= CHUNK
            pair = F.array(F.struct(p["at"].alias("i"), q["at"].alias("j")))
            moved = F.struct(
                (now["p"] + F.when(ahead, 0).otherwise(1)).alias("p"),
                (now["q"] + F.when(behind, 0).otherwise(1)).alias("q"),
                F.when(hit & full, F.concat(now["done"], F.array(now["last"]))).otherwise(now["done"]).alias("done"),
                F.when(~hit, now["last"]).when(full, pair).otherwise(F.concat(now["last"], pair)).alias("last"))
            # A list has come to its end: nothing is left to match.
            return F.when(p.isNull() | q.isNull(), now).otherwise(moved)

        pairs = F.array().cast("array<struct<i:int,j:int>>")
        start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"),
                         F.array().cast("array<array<struct<i:int,j:int>>>").alias("done"), pairs.alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(x) + F.size(y)), start, step,
                           lambda end: F.concat(F.flatten(end["done"]), end["last"]))

    return _let(_places(a), lambda x: _let(_places(b), lambda y: merge(x, y)))


def _jaro(a: Column, b: Column) -> Column:
    """Jaro similarity of two character arrays."""
    la, lb = F.size(a), F.size(b)
    window = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))

    def score(hits: Column) -> Column:
        m = F.size(hits)
        ours, theirs = (F.sort_array(F.transform(hits, lambda x: x[side])) for side in "ij")
        # Matched characters of both strings in their own order that differ.
        out = F.size(F.filter(F.arrays_zip(ours.alias("x"), theirs.alias("y")),
                              lambda p: F.get(a, p["x"]) != F.get(b, p["y"])))
        t = F.floor(out / 2)
        return F.when(m == 0, F.lit(0.0)).otherwise((m / la + m / lb + (m - t) / m) / 3.0)

    return F.when((la == 0) | (lb == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(
        _let(_matches(a, b, window), score))


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """0..1 similarity; NULL when either side is NULL."""
    def score(x: Column, y: Column) -> Column:
        def boosted(sim: Column) -> Column:
            same = [F.coalesce(F.get(x, F.lit(i)) == F.get(y, F.lit(i)), F.lit(False)) for i in range(WINKLER_MAX_PREFIX)]
            prefix, whole = F.lit(0), F.lit(True)
            for s in same:
                whole = whole & s
                prefix = prefix + F.when(whole, 1).otherwise(0)
            return F.when(sim <= WINKLER_BOOST_THRESHOLD, sim).otherwise(sim + prefix * WINKLER_PREFIX_SCALE * (1.0 - sim))

        return _let(_jaro(x, y), boosted)

    a, b = a.cast("string"), b.cast("string")
    return F.when(a.isNotNull() & b.isNotNull(), _let(_chars(a), lambda x: _let(_chars(b), lambda y: score(x, y))))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def soundex_equal(a: Column, b: Column) -> Column:
    return F.soundex(a) == F.soundex(b)
