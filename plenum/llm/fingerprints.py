"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, long ones cut at LINE characters) are hashed; each digest goes to one cell in each of
three sub-tables, and a cell holds a count, the xor of its digests and the xor of their check sums. Cells that hold
nothing are left out, so that a sketch costs what its digests do, however wide its tables are. Two versions' sketches
subtract cell by cell; cells that are left with one digest are peeled until nothing is left, and what was peeled are
the digests that only one version has. If peeling sticks, it is tried again with larger tables.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.lineage import let, numbered

LINE = 200
#: Cells in each of the three sub-tables: WIDTH in the stored fingerprint, which the first attempt peels. The next has as
#: many as there are digests in all, or more (a power of GROWTH), and each later one GROWTH times more.
WIDTH, GROWTH, ATTEMPTS = 8, 4, 6
#: Peeling takes few rounds; a sketch that needs more is tried again larger.
ROUNDS = 24
#: Documents of a group that is put in order together, and the most groups. SPREAD documents for each group are sampled to set the groups' bounds.
GROUP, MOST_GROUPS, SPREAD = 1000, 1 << 14, 8


def digests(text: Column) -> Column:
    """array<bigint> of the distinct paragraphs of a text that is not null; an empty text has none. All characters count."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"\n*[^\n]{{1,{LINE}}}|\n+"), F.lit(0)), lambda p: F.xxhash64(p)))


CELLS = "array<struct<i:bigint,c:int,k:bigint,h:bigint>>"


def _entry(i: Column, c: Column, k: Column, h: Column) -> Column:
    return F.struct(i.alias("i"), c.alias("c"), k.alias("k"), h.alias("h"))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(99))


def _placed(found: Column, sign: int, width: Column) -> Column:
    """The three cells of each digest, holding it alone."""
    at = lambda d, j: F.pmod(F.xxhash64(d, F.lit(j)), width) + width * j
    alone = lambda d, h: F.array(*[_entry(at(d, j), F.lit(sign), d, h) for j in range(3)])
    return F.flatten(F.transform(found, lambda d: let(_check(d), lambda h: alone(d, h))))


def _summed(entries: Column) -> Column:
    """Entries of the same cell made one; cells that hold nothing are left out. The entries are sorted, and each run of a cell is folded by itself."""
    add = lambda acc, e: _entry(e["i"], acc["c"] + e["c"], acc["k"].bitwiseXOR(e["k"]), acc["h"].bitwiseXOR(e["h"]))
    zero = _entry(F.lit(0).cast("long"), F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def runs(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda j: (j == 0) | (F.get(e, j)["i"] != F.get(e, j - 1)["i"]))
        run = lambda j, n: F.when(n == 1, F.get(e, j)).otherwise(F.aggregate(F.slice(e, j + 1, n), zero, add))
        return let(starts, lambda s: F.transform(s, lambda j, q: let(F.coalesce(F.get(s, q + 1), F.size(e)) - j, lambda n: run(j, n))))

    cells = let(F.sort_array(entries), lambda e: F.when(F.size(e) > 0, runs(e)).otherwise(e))
    return F.filter(cells, lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["h"] != 0))


def sketch(found: Column, width: Column) -> Column:
    """CELLS of three tables of `width` cells from an array of distinct digests."""
    return _summed(_placed(found, 1, width))


def subtract(a: Column, b: Column) -> Column:
    """CELLS of the difference of two sketches of the same width."""
    return _summed(F.concat(a, F.transform(b, lambda e: _entry(e["i"], -e["c"], e["k"], e["h"]))))


def peel(cells: Column, width: Column) -> Column:
    """struct<cells, a, b, done>: the digests of the first version only, of the second only, and the cells that are left."""
    none = F.array().cast("array<bigint>")

    def one_round(acc: Column, _: Column) -> Column:
        pure = F.filter(acc["cells"], lambda e: (F.abs(e["c"]) == 1) & (_check(e["k"]) == e["h"]))
        side = lambda got, s: F.array_distinct(F.transform(F.filter(got, lambda e: e["c"] == s), lambda e: e["k"]))

        def without(got: Column) -> Column:
            rest = _summed(F.concat(acc["cells"], _placed(got["a"], -1, width), _placed(got["b"], 1, width)))
            return F.struct(rest.alias("cells"), F.concat(acc["a"], got["a"]).alias("a"), F.concat(acc["b"], got["b"]).alias("b"), F.lit(False).alias("done"))

        stuck = F.struct(acc["cells"].alias("cells"), acc["a"].alias("a"), acc["b"].alias("b"), F.lit(True).alias("done"))
        found = lambda got: let(F.struct(side(got, 1).alias("a"), side(got, -1).alias("b")), without)
        return F.when(acc["done"], acc).otherwise(let(pure, lambda got: F.when(F.size(got) == 0, stuck).otherwise(found(got))))

    zero = F.struct(cells.cast(CELLS).alias("cells"), none.alias("a"), none.alias("b"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, one_round)


def difference(a: Column, b: Column, first_a: Column, first_b: Column) -> Column:
    """struct<a, b>: how many digests of two arrays only the first has, and only the second, as peeled. `first_a` and
    `first_b` are their stored sketches, which the first attempt subtracts.

    Tables of more cells than there are digests stick only if a few digests share all their cells. Were that so in
    every attempt, the query would fail.
    """
    none = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    peeled = lambda cells, w: let(peel(cells, w), lambda s: F.when(F.size(s["cells"]) == 0, F.struct(F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"))).otherwise(none))
    fit = F.ceil(F.log2(F.greatest(F.size(a) + F.size(b), F.lit(2)).cast("double")) / F.log2(F.lit(float(GROWTH))))

    def larger(acc: Column, k: Column) -> Column:
        width = F.pow(F.lit(float(GROWTH)), fit + k).cast("long")
        return F.when(acc["a"] >= 0, acc).otherwise(let(width, lambda w: peeled(subtract(sketch(a, w), sketch(b, w)), w)))

    small = F.abs(F.size(a) - F.size(b)) > 3 * WIDTH  # the numbers alone differ by more than the first tables hold
    stored = F.when(small, none).otherwise(peeled(subtract(first_a, first_b), F.lit(WIDTH).cast("long")))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 2)), stored, larger)
    return let(found, lambda s: F.when(s["a"] >= 0, s).otherwise(F.raise_error(F.lit("a sketch did not peel")).cast("struct<a:int,b:int>")))


def stored(found: Column) -> Column:
    """The sketch that makes a fingerprint."""
    return sketch(found, F.lit(WIDTH).cast("long"))


def likeness(a: Column, b: Column, first_a: Column | None = None, first_b: Column | None = None) -> Column:
    """Jaccard similarity of two digest arrays from their peeled difference; two empty texts are alike (1.0)."""
    share = lambda s: (F.size(a) - s["a"]) / (F.size(a) + s["b"]).cast("double")
    some = difference(a, b, stored(a) if first_a is None else first_a, stored(b) if first_b is None else first_b)
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(let(some, share))


def fingerprint(found: Column, cells: Column) -> Column:
    """A stored sketch as text: the number of digests, then place, count, digests and check sums of each cell that holds any."""
    written = F.transform(cells, lambda e: F.concat_ws(".", F.hex(e["i"]), F.hex(e["c"]), F.hex(e["k"]), F.hex(e["h"])))
    return F.concat(F.size(found).cast("string"), F.lit(":"), F.array_join(written, ","))


def bounds_of(df: DataFrame, n: int, key: str) -> list[list[int]]:
    """[null?, key, _row] of the first row of each group but the first, from a sample of about SPREAD rows a group that a hash draws."""
    groups = min(MOST_GROUPS, -(-n // GROUP))
    if groups < 2:
        return []
    drawn = F.pmod(F.xxhash64("_row", F.lit(5)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SPREAD * groups / n))
    sample = sorted((r[0] is None, r[0] or 0, r[1]) for r in df.where(drawn).select(F.col(key).cast("long"), "_row").limit(4 * SPREAD * MOST_GROUPS).collect())
    return [[int(none), k, row] for none, k, row in sample[SPREAD::SPREAD]]


def with_next(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """`df` (with a column `_row`) with `next_<c>` for each of `wanted`: of the row that follows by (key, _row), after the last the first.

    Rows are dealt to groups by bounds of (key, _row), so that neither large keys nor one that many rows share make a
    large group; the first rows of a group are also sent to the group before it, and the first of all to the last. So
    one shuffle suffices and no task holds more than a group. Null keys come last.
    """
    place = F.struct(F.col(key).isNull().cast("int").alias("none"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.col("_row").alias("row"))
    facts = df.agg(F.count("*").alias("n"), F.min(place).alias("low")).first()
    bounds = bounds_of(df, facts["n"], key)
    wide = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    triple = "struct<none:int,key:bigint,row:bigint>"
    known = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    as_rows = lambda part: [dict(zip(("none", "key", "row"), b, strict=True)) for b in part]
    below = lambda list_, at: F.size(F.filter(list_, lambda b: b <= at))
    first = F.col("_place") == F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip(facts["low"], ("int", "long", "long"), ("none", "key", "row"), strict=True)]) if facts["n"] else F.lit(False)
    placed = df.withColumn("_place", place)
    if bounds:
        coarse = known(as_rows([part[0] for part in fine]), f"array<{triple}>")
        all_fine = known([as_rows(part) for part in fine], f"array<array<{triple}>>")
        placed = placed.withColumn("_coarse", below(coarse, F.col("_place")) - 1).withColumn("_near", F.get(all_fine, F.col("_coarse")))
        placed = placed.withColumn("_home", F.when(F.col("_coarse") < 0, 0).otherwise(F.col("_coarse") * wide + below(F.col("_near"), F.col("_place"))))
        placed = placed.withColumn("_leads", F.coalesce(F.get("_near", (F.col("_home") - 1) % wide) == F.col("_place"), F.lit(False)))
    else:
        placed = placed.withColumn("_home", F.lit(0)).withColumn("_leads", F.lit(False))
    seat = lambda group, guest: F.struct(group.cast("int").alias("_group"), F.lit(guest).alias("_guest"))
    none = F.array().cast("array<struct<_group:int,_guest:int>>")
    seats = F.concat(F.array(seat(F.col("_home"), 0)), F.when(F.col("_leads"), F.array(seat(F.col("_home") - 1, 1))).otherwise(none), F.when(first, F.array(seat(F.lit(len(bounds)), 2))).otherwise(none))
    order = Window.partitionBy("_group").orderBy("_guest", "_place")
    seated = placed.withColumn("_seat", F.explode(seats)).select(*df.columns, "_place", "_seat.*")
    led = seated.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in wanted])
    return led.where("_guest = 0").drop("_group", "_guest", "_place")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses.

    A null text counts as empty, and an empty one has no paragraphs. Rows with equal doc_ids follow each other in the
    order of the table, null ids come last; a single row is its own next. Other columns don't matter.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = numbered(docs, "_row")
    pairs = with_next(docs.withColumn("own", digests(F.col("text"))), "doc_id", ["text", "own"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("_edited"))
    pairs = pairs.withColumn("_new", digests(F.col("_edited")))
    pairs = pairs.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "own", "_new", "next_own", stored(F.col("own")).alias("_own8"), stored(F.col("_new")).alias("_new8"), stored(F.col("next_own")).alias("_next8"))
    near = lambda other, cells: likeness(F.col("own"), F.col(other), F.col("_own8"), F.col(cells))
    return pairs.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own"), F.col("_own8")).alias("fingerprint"), fingerprint(F.col("_new"), F.col("_new8")).alias("edited_fingerprint"), near("_new", "_new8").alias("near_edited"), near("next_own", "_next8").alias("near_next"))
