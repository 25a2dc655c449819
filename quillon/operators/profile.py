"""What kind of column each column of a table is.

One pass counts the distinct cells of all columns, with partial counts before the shuffle;
everything else is computed on distinct cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import numbers as N
from quillon.operators._lineage import kept

#: A dictionary has at most this many values, and at most half as many as the table has rows.
DICTIONARY_VALUES = 65_536
#: The size (as a power of 2) of sketches of distinct cells, and a bound on their relative standard error.
SKETCH, ESTIMATE_ERROR = 12, 0.02
#: Columns counted in one pass; a grouping id has a bit for each.
SETS = 48


def rendered(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every column (or those named) as text without nulls."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[N.to_text(F.col(f"`{c}`"), kinds[c]).alias(c) for c in names or df.columns])


def melted(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """position, col, cell: one row for each cell."""
    texts = rendered(df, names)
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("col"), F.col(f"`{c}`").alias("cell")) for i, c in enumerate(texts.columns)])
    return texts.select(F.inline(cells))


def cell_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """position, col, cell, n: how often each text occurs in each column.

    Values are counted by their own type, one grouping set for each column, and only distinct
    ones are written as text. Types that cannot be grouped by are text from the start.
    """
    names = names or df.columns
    parts = [_counted(df, names[i : i + SETS], i) for i in range(0, len(names), SETS)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _counted(df: DataFrame, names: list[str], first: int) -> DataFrame:
    def plain(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, (T.StringType, T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
            return N.to_text(F.col(f"`{c}`"), kind)
        return F.col(f"`{c}`")

    keys = [f"__k{i}" for i in range(len(names))]
    rows = df.select(*[plain(c).alias(k) for c, k in zip(names, keys)])
    counts = rows.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    every = (1 << len(keys)) - 1
    cell = position = name = None
    for i, (c, k) in enumerate(zip(names, keys)):
        own = F.col("g") == (every ^ (1 << (len(keys) - 1 - i)))
        text = N.to_text(F.col(k), rows.schema[k].dataType)
        cell = F.when(own, text) if cell is None else cell.when(own, text)
        position = F.when(own, first + i) if position is None else position.when(own, first + i)
        name = F.when(own, c) if name is None else name.when(own, c)
    # an empty table has no rows, whatever its columns
    return counts.select(position.alias("position"), name.alias("col"), cell.alias("cell"), "n").where("n > 0")


def column_profile(df: DataFrame) -> DataFrame:
    """One row for each column: counts of rows, distinct cells, plain and canonical decimals, the
    least and most decimals, cells with a newline or a marker byte (1 or 2), and bytes in all."""
    cell = F.col("cell")
    counts = cell_counts(df)
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    return counts.groupBy("position", "col").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), total(N.is_plain(cell))("n_plain"), total(N.is_canonical(cell))("n_canonical"),
        F.min(N.decimals(cell)).alias("min_dec"), F.max(N.decimals(cell)).alias("max_dec"), F.max(F.abs(N.mantissa(cell))).alias("max_abs"),
        total(cell.contains("\n"))("n_newline"), total(cell.rlike("[\\x01\\x02]"))("n_marker"), F.sum(F.octet_length(cell).cast("long") * F.col("n")).alias("n_bytes"),
    )


def distinct_estimates(df: DataFrame) -> DataFrame:
    """position, col, n, n_about: the rows and an estimate of the distinct values of each column, by sketches that the
    tasks fill and merge. No row is shuffled."""
    hashes = df.select(*[F.xxhash64(N.to_text(F.col(f"`{f.name}`"), f.dataType) if isinstance(f.dataType, T.VariantType) else F.col(f"`{f.name}`")).alias(f"__c{i}") for i, f in enumerate(df.schema.fields)])
    sums = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("col"), F.count(F.lit(1)).alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg(f"__c{i}", SKETCH)).alias("n_about")) for i, c in enumerate(df.columns)]
    return hashes.agg(F.array(*sums).alias("found")).select(F.inline("found")).where("n > 0")


def cell_facts(df: DataFrame, names: list[str]) -> DataFrame:
    """col, n, n_canonical, min_dec, max_dec (of canonical cells) of the columns named: one pass over the rows, of which
    nothing but these sums is shuffled."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    integral = lambda c: isinstance(kinds[c], T.IntegralType)
    texts = df.select(*[(F.col(f"`{c}`") if integral(c) else N.to_text(F.col(f"`{c}`"), kinds[c])).alias(f"__c{i}") for i, c in enumerate(names)])
    sums = []
    for i, c in enumerate(names):
        cell = F.col(f"__c{i}")
        if integral(c):
            canonical = cell.isNotNull() & (F.abs(cell.cast("decimal(20,0)")) < F.lit(N.REACH).cast("decimal(20,0)"))
            dec = F.when(canonical, F.lit(0).cast("long"))
        else:
            canonical = N.is_canonical(cell)
            dec = F.when(canonical, N.places(cell))
        sums.append(F.struct(F.lit(c).alias("col"), F.count(F.lit(1)).alias("n"), F.count_if(canonical).alias("n_canonical"), F.min(dec).alias("min_dec"), F.max(dec).alias("max_dec")))
    return texts.agg(F.array(*sums).alias("found")).select(F.inline("found"))


def column_kinds(df: DataFrame) -> DataFrame:
    """position, col, kind, dec, n, n_distinct by the rules of `classified`; n_distinct is that of dictionaries, else null.

    Distinct cells are counted, and so shuffled, only of columns whose estimate is not beyond doubt (a dozen standard
    errors) above what a dictionary can hold; the others' cells are judged row by row, where they are.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], "position int, col string, kind string, dec long, n long, n_distinct long")
    about = kept(distinct_estimates(df))
    few = (F.col("n_about") * (1 - 12 * ESTIMATE_ERROR) <= F.least(F.lit(DICTIONARY_VALUES), F.floor(F.greatest(F.col("n"), F.lit(2)) / 2))).alias("few")
    counted, judged = [], []
    for r in about.select("col", few).collect():  # a row for each column
        (counted if r["few"] else judged).append(r["col"])
    parts = []
    if counted:
        cell, n = F.col("cell"), F.col("n")
        canonical = N.is_canonical(cell)
        parts.append(cell_counts(df, counted).groupBy("col").agg(F.sum("n").alias("n"), F.sum(F.when(canonical, n).otherwise(0)).alias("n_canonical"), F.min(F.when(canonical, N.places(cell))).alias("min_dec"), F.max(F.when(canonical, N.places(cell))).alias("max_dec"), F.count(F.lit(1)).alias("n_distinct")))
    for i in range(0, len(judged), SETS):
        parts.append(cell_facts(df, judged[i : i + SETS]).withColumn("n_distinct", F.lit(None).cast("long")))
    facts = about.select("position", "col", "n").limit(0).select("col", "n", *[F.lit(0).cast("long").alias(c) for c in ("n_canonical", "min_dec", "max_dec", "n_distinct")])
    for part in parts:
        facts = facts.unionByName(part)
    known = about.select("position", "col").join(F.broadcast(facts), "col")  # a row for each column
    number = (F.col("n_canonical") == F.col("n")) & (F.col("min_dec") == F.col("max_dec"))
    bound = F.least(F.lit(DICTIONARY_VALUES), F.floor(F.greatest(F.col("n"), F.lit(2)) / 2))
    kind = F.when(number, "NUM").when(F.col("n_distinct") <= bound, "DICT").otherwise("TEXT")
    return known.select("position", "col", kind.alias("kind"), F.when(number, F.col("max_dec")).alias("dec"), "n", F.when(kind == "DICT", F.col("n_distinct")).alias("n_distinct"))


def classified(profile: DataFrame) -> DataFrame:
    """position, col, kind, dec, n, n_distinct: NUM if all cells are canonical at one number of
    decimals, else DICT if the distinct cells are few enough, else TEXT."""
    number = (F.col("n") > 0) & (F.col("n_canonical") == F.col("n")) & (F.col("min_dec") == F.col("max_dec"))
    few = F.col("n_distinct") <= F.least(F.lit(DICTIONARY_VALUES), F.floor(F.greatest(F.col("n"), F.lit(2)) / 2))
    return profile.select("position", "col", F.when(number, "NUM").when(few, "DICT").otherwise("TEXT").alias("kind"), F.when(number, F.col("max_dec")).alias("dec"), "n", "n_distinct")


def modal_decimals(df: DataFrame) -> DataFrame:
    """col, dec, n_cells: the commonest number of decimals of each column's plain cells, the smaller of equals."""
    by = cell_counts(df).select("col", "n", N.decimals(F.col("cell")).alias("dec")).where("dec is not null").groupBy("col", "dec").agg(F.sum("n").alias("n_cells"))
    return by.groupBy("col").agg(F.max_by(F.struct("dec", "n_cells"), F.struct("n_cells", -F.col("dec"))).alias("top")).select("col", "top.dec", "top.n_cells")
