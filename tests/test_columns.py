"""Numbers as text, column kinds and dependencies."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import dates, numbers, text
from quillon.operators import blocks, compare, dependency, derive, labels, profile, sequence


def one(spark, values, kind, *expressions):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", kind)])).select(*expressions).collect()]


def test_doubles_have_no_exponent(spark):
    values = [0.0, -0.5, 1e7, 12345678.25, -98765432.0, 123456789012.5, 0.001, 1.5, None]
    got = [r[0] for r in one(spark, values, T.DoubleType(), numbers.to_text(F.col("x"), T.DoubleType()))]
    assert got == ["" if v is None else repr(v) for v in values]


def test_canonical_cells(spark):
    cells = ["", "0", "-0", "-0.0", "007", "1.", ".5", "+1", "1.50", "-12", str(2**62 - 1), str(2**62), "1e3", "0." + "1" * 19, "5\n"]
    got = [r[0] for r in one(spark, cells, T.StringType(), numbers.is_canonical(F.col("x")))]
    assert got == [c in ("0", "1.50", "-12", str(2**62 - 1)) for c in cells]


def test_rounding_half_to_even(spark):
    cells = ["2.125", "-0.4", "0.5", "1.5", "-0.5", "009.95", "1", "1.2", "99.995", "abc", "", "2.675000"]
    for places in (0, 1, 2):
        got = [r[0] for r in one(spark, cells, T.StringType(), numbers.round_half_even(F.col("x"), places))]
        for c, g in zip(cells, got):
            if not c or not c.lstrip("-")[0].isdigit():
                assert g is None
            elif len(c.partition(".")[2]) <= places:
                assert g == c
            else:
                assert Decimal(g) == Decimal(c).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN)
                assert g.startswith("-") == c.startswith("-") and g.lstrip("-").startswith("0") == (c.lstrip("-").startswith("0") and not (c == "0.5" and places < 0))
                assert derive._round(c, places) == g


def test_mantissas_come_back(spark):
    cells = ["0.05", "-0.05", "12.00", "-3.10", "100000.99"]
    assert [r[0] for r in one(spark, cells, T.StringType(), numbers.unscaled(numbers.scaled(F.col("x"), 2), 2))] == cells


def test_codes(spark):
    values = [0, -1, 1, -2, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    got = one(spark, values, T.LongType(), numbers.unzigzag(numbers.zigzag(F.col("x"))))
    assert [r[0] for r in got] == values


def test_kinds(spark):
    n = 60
    rows = [(str(i), "ab"[i % 2], f"t{i}", f"{i}.50", f"{i}.5" if i % 2 else f"{i}", None) for i in range(n)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    kinds = {r["col"]: (r["kind"], r["dec"]) for r in profile.classified(profile.column_profile(df)).collect()}
    assert kinds == {"a": ("NUM", 0), "b": ("DICT", None), "c": ("TEXT", None), "d": ("NUM", 2), "e": ("TEXT", None), "f": ("DICT", None)}
    assert profile.column_profile(df.limit(0)).count() == 0


def test_tree_follows_gains():
    tree = dependency.parent_tree({"a": 5, "b": 3, "c": 9, "d": 1}, {("d", "b"): 10**6, ("b", "c"): 10**6, ("d", "c"): 10**5, ("d", "a"): 10})
    assert tree == [("d", None), ("b", "d"), ("c", "b"), ("a", None)]


def test_decode_refuses_unknown_ids(spark):
    df = spark.createDataFrame([("x",), ("y",)], "v string")
    values = dependency.alphabet(df, "v")
    assert sorted(r.v for r in dependency.decode(dependency.encode(df, "v", values), "v", values).collect()) == ["x", "y"]
    with pytest.raises(Exception, match="more than 1 values"):
        dependency.alphabet(df, "v", 1).collect()
    with pytest.raises(Exception, match="alphabet"):
        dependency.decode(spark.createDataFrame([(7,)], "v_id long"), "v", values).collect()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_row_numbers_do_not_depend_on_partitions(spark, parts):
    keys = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string").repartition(parts)
    got = sorted((r.rid, r.k, r.block) for r in sequence.numbered(df, "k", rows_per_block=64).collect())
    assert got == [(i, k, i // 64) for i, k in enumerate(sorted(keys))]


def test_differences_wrap_and_come_back(spark):
    values = [2**63 - 1, -(2**63), 0, 5, -7, 2**62, 1]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "block long, rid long, v long")
    for k in range(5):
        coded = df.select("block", "rid", sequence.differences(df, "v", k).alias("v"))
        assert [r.v for r in sequence.undifferenced(coded, "v", k).orderBy("rid").collect()] == values


def test_groups_are_runs_of_like_columns():
    columns = [("a", "NUM", 0, 100, False), ("b", "NUM", 0, 700, False), ("c", "NUM", 0, 90, False), ("d", "DICT", None, None, False), ("e", "NUM", 1, 5, False), ("f", "NUM", 1, 5, False), ("g", "NUM", 2, 5, False)]
    assert compare.groups(columns) == [["a", "b", "c"]]
    assert compare.commensurable(0, 8) and not compare.commensurable(1, 9)


def test_derived_columns_come_back(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lat, lon = f"{rng.uniform(-90, 90):.6f}", f"{rng.uniform(-180, 180):.6f}"
        rows.append((i, lat, lon, f"POINT ({lon} {lat})", derive._round(lat, 2) or lat))
    df = spark.createDataFrame(rows, "rid long, lat string, lon string, place string, short string")
    names = ["lat", "lon", "place", "short"]
    plan = derive.derive_plan(df, "rid", names)
    assert plan["place"] == ["lat", "lon"] and plan["short"] == ["lat"]
    texts = df.select(*names)
    coded = derive.derive(texts, plan)
    assert coded.select("place").distinct().count() == 1
    assert sorted(derive.underive(coded, plan).collect()) == sorted(texts.collect())
    for bad in ("\x01", "\x019:\x02", "\x010:9\x02", "\x010\x02"):
        with pytest.raises(ValueError):
            derive.expand_cell(bad, ["1.25"])


def test_dates():
    for family, shown, kind in (("stata", "%td", "date"), ("stata", "%tc", "datetime"), ("stata", "%tcHH:MM", "time"), ("stata", "%tw", "other"), ("spss", "ADATE10", "date"), ("spss", "MOYR8", "other"), ("sas", "DATE9", "date"), ("sas", "DATETIME20.", "datetime")):
        assert dates.kind_of(family, shown) == kind, shown


def test_dates_as_text(spark):
    days = [0.0, 21310.0, -715875.0, 0.5, 3e6, None]
    assert [r[0] for r in one(spark, days, T.DoubleType(), dates.iso_date(F.col("x"), "stata"))] == ["1960-01-01", "2018-05-06", "0000-01-01", None, None, None]
    values = [0.0, 1500.0, 1e12 + 0.25, -1.0]
    assert [r[0] for r in one(spark, values, T.DoubleType(), dates.iso_datetime(F.col("x"), "stata"))] == ["1960-01-01 00:00:00", "1960-01-01 00:00:01.5", "1991-09-09 01:46:40.00025", "1959-12-31 23:59:59.999"]
    assert [r[0] for r in one(spark, [3661.0, 100 * 3600.0], T.DoubleType(), dates.clock(F.col("x")))] == ["01:01:01", "100:00:00"]


def test_dates_after_9999(spark, tmp_path):
    import duckdb

    from quillon import catalog

    days = [2932896.0 + 3653, 2932897.0 + 3653, 3e6, 1e8, -719529.0 + 3653, 3e9]
    assert [r[0] for r in one(spark, days, T.DoubleType(), dates.iso_date(F.col("x"), "stata", dates.FAR_DATE))] == ["9999-12-31", "10000-01-01", "10173-09-20", "275750-09-13", None, None]
    values = [5e14 + 0.125, 5e14 + 0.5, -5e14, 1e19]
    assert [r[0] for r in one(spark, values, T.DoubleType(), dates.iso_datetime(F.col("x"), "stata", dates.FAR_TIME))] == ["17804-05-15 00:53:20.000125", "17804-05-15 00:53:20.0005", None, None]
    assert [r[0] for r in one(spark, values, T.DoubleType(), dates.iso_datetime(F.col("x"), "stata"))] == [None] * 4
    c = duckdb.connect()
    c.sql(f"COPY (SELECT CAST(k AS BIGINT) AS c_custkey FROM (SELECT unnest([0, 29000, 29441, 29442, 64053, 90000, 173000, 899999]) AS k)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = sorted(c.sql(catalog.oracle_sql()["iso_date_render"]).fetchall())
    assert sorted(map(tuple, catalog.iso_date_render(spark, str(tmp_path)).collect())) == want and None not in want[-1]


def test_names_sizes_and_labels(spark):
    taken: set = set()
    assert [text.legal_name(n, taken, 8) for n in ("a b", "A_B", "1st", "", "a_b", "very_long_name")] == ["a_b", "A_B_2", "v1st", "v", "a_b_3", "very_lon"]
    assert [r[0] for r in one(spark, [5, 999, 1000, 1234567, 5 * 10**12], T.LongType(), text.human_size(F.col("x")))] == ["5 B", "999 B", "1.0 KB", "1.2 MB", "5.0 TB"]
    sets = spark.createDataFrame([(1.0, "one", 0), (1.0, "uno", 1)], "key double, label string, nth int")
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert sorted(map(tuple, labels.labelled(df, "v", sets).collect())) == [(1.0, "one"), (2.0, None)]
    assert [r[0] for r in one(spark, [5.0, 11.0, 15.0], T.DoubleType(), labels.missing_tag(F.col("x"), [(10, 12), (11, 20)]))] == [None, "a", "b"]


def test_blocks_are_dealt_evenly(spark):
    df = sequence.dealt(sequence.with_blocks(spark.range(40_000).withColumnRenamed("id", "rid"), 1000))
    met = df.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("block").alias("blocks"), F.count("*").alias("n")).collect()
    assert len(met) == 40 and {(r.blocks, r.n) for r in met} == {(1, 1000)}
    assert sequence.dealt(df.where("false")).count() == 0
    plan = df.groupBy("block").applyInArrow(lambda t: t.select(["block"]).slice(0, 1), "block long")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # none but the dealing
    assert plan.count() == 40


def test_block_sizes(spark):
    s = blocks.block_stats(spark.createDataFrame([(x,) for x in (5, 1, 9, 7)], "bytes long")).first()
    assert (s.n_blocks, s.least, s.middle, s.most) == (4, 1, 7, 9)


def test_kinds_of_wide_and_hard_tables(spark):
    wide = spark.range(900).select(*[((F.col("id") * (i + 1)) % (3 + i % 7)).alias(f"c{i}") for i in range(130)], F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("holes"))
    got = {r.col: (r.kind, r.dec, r.n_distinct) for r in profile.column_kinds(wide).collect()}
    assert len(got) == 132 and all(got[f"c{i}"] == ("NUM", 0, None) for i in range(130))
    assert got["text"] == ("TEXT", None, None) and got["holes"] == ("DICT", None, 6)
    assert profile.column_kinds(wide.limit(0)).count() == 0 and profile.column_kinds(wide.select()).count() == 0
    same = {r.col: (r.kind, r.dec) for r in profile.classified(profile.column_profile(wide.select("c1", "text", "holes"))).collect()}
    assert same == {c: got[c][:2] for c in same}


def test_gains_of_wide_tables_are_those_of_narrow_ones(spark, monkeypatch):
    monkeypatch.setattr(dependency, "BATCH_SETS", 7)
    monkeypatch.setattr(dependency, "BATCH_COLUMNS", 4)
    df = spark.range(200).select(*[((F.col("id") * (i + 3)) % (2 + i)).alias(f"a.{i}") for i in range(9)])
    got = {(r.parent, r.child): r.gain_q for r in dependency.gain_matrix(df, df.columns).collect()}
    monkeypatch.undo()
    assert got == {(r.parent, r.child): r.gain_q for r in dependency.gain_matrix(df, df.columns).collect()} and len(got) == 72
    many = spark.range(50).select(*[(F.col("id") % (2 + i)).alias(f"c{i}") for i in range(200)])
    assert dependency.column_entropies(many, many.columns).count() == 200


def test_systematic_samples(spark, monkeypatch):
    monkeypatch.setattr(dependency, "SAMPLE_ROWS", 100)
    for n, left in ((50, 50), (199, 199), (200, 100), (1000, 100), (1050, 105)):
        assert dependency.sampled(spark.range(n), "id").count() == left
