"""Single operators and the control plane, with results known beforehand."""

import datetime as dt
import random

import pytest

from larkspur.expr import Expr, Sym, q, s
from larkspur.plans.control import evaluate_staged, held_stages
from larkspur.session import Engine
from larkspur.workloads import timeseries, tpch


@pytest.fixture()
def engine(spark):
    return Engine(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def column(name, *values):
    return Expr(name, (Expr("List", values),))


PEOPLE = q.Table(column("id", 1, 2, 3), column("first", "John", "Sam", "Barbara"), column("last", "McCarthy", "Madden", "Liskov"), column("year", 1927, 1976, 1939))


def test_atoms(engine):
    assert engine.evaluate(q.Plus(5, 4)) == 9 and engine.evaluate(q.Plus(5, 2, 2)) == 9 and engine.evaluate(q.Plus(5, q.Plus(2, 2))) == 9
    assert engine.evaluate(q.Plus(2.5, 2.5)) == 5.0 and engine.evaluate(q.Greater(5, 2)) is True
    assert engine.evaluate(q.StringJoin("howdie", " ", "world")) == "howdie world"
    assert engine.evaluate(q.Symbol("x")) == Sym("x")


def test_unknown_heads_stay(engine):
    assert engine.evaluate(q.Unheard(q.Plus(1, 2), s.y)) == q.Unheard(3, s.y)


def test_select_and_project(engine):
    t = q.Table(column("value", 2, 3, 1, 4, 1))
    assert rows(engine.evaluate(q.Select(t, q.Where(q.Greater(s.value, 3))))) == [(4,)]
    t = q.Table(column("value", 10, 20, 30, 40, 50))
    assert [r[0] for r in rows(engine.evaluate(q.Project(t, q.As(s.r, q.Plus(s.value, s.value)))))] == [20, 40, 60, 80, 100]
    test = lambda e: [r[0] for r in rows(engine.evaluate(q.Project(t, q.As(s.r, e))))]
    assert test(q.Greater(s.value, 25)) == [False, False, True, True, True]
    assert test(q.Greater(45, s.value)) == [True, True, True, True, False]
    assert test(q.And(q.Greater(s.value, 25), q.Greater(45, s.value))) == [False, False, True, True, False]


def test_people(engine):
    found = engine.evaluate(q.Project(q.Select(PEOPLE, q.Where(q.StringContainsQ(s.last, "Madden"))), q.As(s.first, s.first, s.last, s.last)))
    assert rows(found) == [("Sam", "Madden")]
    assert rows(engine.evaluate(q.Group(PEOPLE, s.Count))) == [(3,)]
    assert rows(engine.evaluate(q.Group(PEOPLE, q.Function(0), s.Count))) == [(3, 0)]
    assert rows(engine.evaluate(q.Select(PEOPLE, q.Where(q.Function(False))))) == []
    assert [r[0] for r in rows(engine.evaluate(q.Sort(PEOPLE, q.By(s.last))))] == [3, 2, 1]
    assert [r[0] for r in rows(engine.evaluate(q.Sort(PEOPLE, q.By(s.last, s.desc))))] == [1, 2, 3]
    # Needles are plain text, not patterns.
    assert rows(engine.evaluate(q.Select(PEOPLE, q.Where(q.StringContainsQ(s.last, "M%n"))))) == []


def test_empty_table(engine):
    t = q.Table(*(column(c) for c in "abcde"))
    assert rows(engine.evaluate(q.Select(t, q.Where(q.Function(True))))) == []
    assert rows(engine.evaluate(q.Group(t, q.As(s.n, q.Count("*"))))) == [(0,)]


def test_join(engine):
    a = q.Table(column("from", *range(10)), column("to", *range(10, 20)))
    b = q.Table(column("from2", *range(10, 20)), column("to2", *range(10)))
    out = engine.evaluate(q.Join(a, b, q.Where(q.Equal(s.to, s.from2))))
    assert out.columns == ["from", "to", "from2", "to2"] and out.count() == 10
    assert engine.evaluate(q.Join(a, b, q.Where(q.Equal(s.from2, s.to)))).count() == 10
    with pytest.raises(ValueError):
        engine.evaluate(q.Join(a, b, q.Where(q.Greater(s.to, s.from2))))


def test_interpolated_cells(engine):
    for seed in range(3):
        r = random.Random(seed)
        x = sorted(r.sample(range(1, 999, 2), 3))
        y0, y2 = r.randrange(1, 999, 2), r.randrange(1, 999, 2)
        t = q.Table(column("x", *x), column("y", y0, q.Interpolate(s.x), y2))
        assert [v[0] for v in rows(engine.evaluate(q.Order(q.Project(t, q.As(s.y, s.y, s.x, s.x)), q.By(s.x))))] == [y0, (y0 + y2) // 2, y2]


def test_positions(engine):
    t = q.Table(column("key", 1, 2, 3, 7, 0, 10), column("payload", 5, 10, 6, 8, 3, 2))
    out = engine.evaluate(q.Select(q.AddIndices(t, s.index), q.Where(q.Greater(s.key, 2))))
    assert sorted(rows(out)) == [(3, 6, 2), (7, 8, 3), (10, 2, 5)]
    t = q.Table(column("key", 1, 2, 3, 4), column("payload", 5, 6, 7, 8))
    assert rows(engine.evaluate(q.GatherRows(t, q.List(0, 2, 3)))) == [(1, 5), (3, 7), (4, 8)]
    assert rows(engine.evaluate(q.GatherRows(t, q.List(3, 0, 3)))) == [(4, 8), (1, 5), (4, 8)]
    t = q.Table(column("key", *range(10, 70, 10)), column("payload", *range(100, 700, 100)), column("row_index", 0, 2, 4))
    assert rows(engine.evaluate(q.Project(q.PartialTable(t, s.row_index), q.As(s.key, s.key)))) == [(10,), (30,), (50,)]
    t = q.Table(column("category", 1, 2, 1, 2, 1, 2), column("value", *range(10, 70, 10)), column("row_index", 0, 2, 4))
    assert rows(engine.evaluate(q.Group(q.PartialTable(t, s.row_index), q.By(s.category), q.As(s.n, q.Sum(s.value))))) == [(1, 90)]


def test_ranges_overlap_and_reverse(engine):
    t = q.Project(q.Table(column("pos", *range(20))), q.As(s.pos, s.pos))
    r = q.Table(column("a", 2, 3, 9, 7), column("b", 5, 4, 9, 5))
    out = engine.evaluate(q.GatherRanges(t, "parquet", s.a, s.b, r, q.List(s.pos)))
    assert sorted(rows(out)) == [(2,), (3,), (3,), (4,)]


def test_dictionary(engine):
    t = q.Table(column("col1", 1, 2, 4, 3), column("col2", "a", "b", "c", "d"), column("col3", "d", "d", "a", "d"))
    coded = engine.evaluate(q.EncodeTable(t))
    assert sorted(rows(coded)) == [(1, 0, 0), (2, 1, 0), (3, 3, 0), (4, 2, 1)]
    assert engine.evaluate(q.GetEncodingFor("a", s.col2)) == 0 and engine.evaluate(q.GetEncodingFor("zz", s.col2)) == -1
    assert engine.evaluate(q.GetEncodingFor("a", s.other)) == q.InvalidKeyForColumn("a", s.other)
    engine.catalog["coded"] = coded
    assert sorted(rows(engine.evaluate(q.DecodeTable(s.coded)))) == [(1, "a", "d"), (2, "b", "d"), (3, "d", "d"), (4, "c", "a")]
    # Dictionaries grow; codes stay.
    again = engine.evaluate(q.EncodeTable(q.Table(column("col2", "z", "b"))))
    assert sorted(rows(again)) == [(1,), (4,)]
    engine.catalog["odd"] = engine.evaluate(q.Table(column("col2", 0, 77)))
    assert sorted(rows(engine.evaluate(q.DecodeTable(s.odd)))) == [("INVALID_ENCODING",), ("a",)]


def test_guards(engine):
    assert engine.evaluate(q.Set(s.x, 1)) == 1 and engine.evaluate(s.x) == 1
    assert engine.evaluate(q.Set(s.x, q.Increment(s.x))) == 2 and engine.evaluate(s.x) == 2
    assert engine.evaluate(q.EvaluateIf(False, q.Increment(1))) == Expr("EvaluateIf", (False, Expr("__Increment", (1,))))
    assert engine.evaluate(q.EvaluateIf(True, q.Increment(1))) == 2
    assert engine.evaluate(q.EvaluateIf(False, q.ThisIsHeld(q.Increment(1)))) == Expr("EvaluateIf", (False, Expr("__ThisIsHeld", (2,))))
    assert engine.evaluate(q.Stays(q.EvaluateIf(True, q.ThisIsNotHeld(q.Increment(1))))) == q.Stays(q.ThisIsNotHeld(2))
    assert engine.evaluate(q.EvaluateIf(q.Equals(0, 0), q.Increment(1))) == 2
    assert held_stages(engine.evaluate(q.EvaluateIf(q.Equals(1, 0), q.Increment(1)))) == 1
    assert engine.evaluate(q.NotEquals(1, 0)) is True
    with pytest.raises(NameError):
        engine.evaluate(q.Set(s.y, s.unset))


def test_errors_are_values(engine):
    bad = engine.safe_evaluate(timeseries.m7_wrong_url())
    assert bad.head == "ErrorWhenEvaluatingExpression" and engine.safe_evaluate(bad) == bad
    assert engine.safe_evaluate(q.Plus(1, 1)) == 2


def test_settings_and_capabilities(engine, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    t = q.Table(column("v", 1, 2, 3))
    assert engine.evaluate(q.Let(q.Group(t, q.As(s.n, q.Count("*"))), q.Parallel(3))).count() == 1
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    engine.evaluate(q.Set(s.maxThreads, 5))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "5"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {"Project", "Join", "EncodeTable", "EvaluateIf"} <= {x.name for x in engine.evaluate(q.GetEngineCapabilities()).args}


def test_tables(engine, tmp_path):
    engine.evaluate(Expr("CreateTable", (s.Customer, Sym("FirstName:VARCHAR:20"), Sym("Age:INT"))))
    engine.evaluate(q.InsertInto(s.Customer, "John", 3))
    assert rows(engine.evaluate(q.Table(s.Customer))) == [("John", 3)]
    assert engine.evaluate(q.Schema(s.Customer)) == q.List(q.List(s.firstname, "string"), q.List(s.age, "int"))
    engine.evaluate(q.SaveTable(s.Customer, s.kept))
    assert rows(engine.evaluate(q.GetTable(s.kept))) == [("John", 3)]
    engine.evaluate(q.ClearTables())
    with pytest.raises(KeyError):
        engine.evaluate(q.GetTable(s.kept))


def test_pipelines(engine):
    from larkspur.plans.control import engine_passes

    engine_passes(engine)["double"] = lambda e: q.Times(e, 2)
    assert engine.evaluate(q.EvaluateInEngines(q.List(s.double, s.double), 3, 5)) == 20
    engine.evaluate(q.SetDefaultEnginePipeline(s.double))
    assert engine.evaluate(7) == 14
    engine.pipeline = []


def test_pricing_goldens(engine):
    """Four rows with figures worked out by hand."""
    engine.catalog["lineitem"] = engine.evaluate(
        q.Table(
            column("l_returnflag", "N", "N", "A", "A"), column("l_linestatus", "O", "O", "F", "F"), column("l_quantity", 17.0, 21.0, 8.0, 5.0),
            column("l_extendedprice", 17954.55, 34850.16, 7712.48, 25284.0), column("l_discount", 0.10, 0.05, 0.06, 0.06),
            column("l_tax", 0.02, 0.06, 0.02, 0.06),
            column("l_shipdate", *(q.DateObject(d) for d in ("1992-03-13", "1994-04-12", "1996-02-28", "1994-12-31"))),
        )
    )
    out = {r[:2]: r[2:] for r in rows(engine.evaluate(tpch.q1()))}
    assert out["N", "O"][0] == 38 and out["N", "O"][1] == pytest.approx(52804.71) and out["N", "O"][-1] == 2
    assert out["N", "O"][2] == pytest.approx(17954.55 * 0.9 + 34850.16 * 0.95)
    assert out["A", "F"][3] == pytest.approx(7712.48 * 0.94 * 1.02 + 25284.0 * 0.94 * 1.06)
    out = engine.evaluate(tpch.q6(first="1993-12-31", last="1995-01-01"))
    assert out.columns == ["revenue"] and rows(out)[0][0] == pytest.approx(34850.16 * 0.05 + 25284.0 * 0.06)
    staged = evaluate_staged(engine, tpch.q1(staged=True))
    assert sorted(rows(staged)) == sorted(rows(engine.evaluate(tpch.q1())))


def test_dates(engine):
    t = q.Table(column("d", q.DateObject("1997-01-01"), q.DateObject("1997-01-10"), q.DateObject("1996-12-31")))
    assert [r[0] for r in rows(engine.evaluate(q.Project(t, q.As(s.y, q.Year(s.d)))))] == [1997, 1997, 1996]
    assert engine.evaluate(t).first()[0] == dt.date(1997, 1, 1)


def test_span_sums(engine):
    r = random.Random(5)
    for make in (lambda: r.randint(-(2**31), 2**31), lambda: r.randint(-(2**40), 2**40), r.random):
        values = [make() for _ in range(50)]
        assert rows(engine.evaluate(q.Group(q.Table(column("v", *values)), q.Sum(s.v))))[0][0] == pytest.approx(sum(values))


def test_merge_and_append(engine):
    a, b = q.Table(column("x", 1, 2, 3)), q.Table(column("y", "a", "b"))
    assert sorted(rows(engine.evaluate(q.MergeColumns(a, b)))) == [(1, "a"), (2, "b")]
    wide = q.Table(column("p", 7), column("r", 8))
    assert sorted(rows(engine.evaluate(q.Append(a, wide)))) == [(1,), (2,), (3,), (7,)]


def test_files(engine, spark, tmp_path):
    from larkspur.sources.tables import file_length, whole_files

    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "b.bin").write_bytes(b"6")
    (tmp_path / "c.bin").write_bytes(b"")
    assert [file_length(spark, str(tmp_path / f)) for f in ("a.bin", "b.bin", "c.bin")] == [5, 1, 0]
    assert sorted(bytes(r.content) for r in whole_files(spark, str(tmp_path)).collect()) == [b"12345", b"6"]
    path = str(tmp_path / "t.parquet")
    spark.range(100).repartition(3).write.parquet(path)
    engine.evaluate(q.StartTrackingOverhead())
    out = engine.evaluate(q.Gather(path, "parquet", q.List(q.List(0, 99)), q.List(s.id), q.IndexColumn(s.pos)))
    assert sorted(r.pos for r in out.collect()) == [0, 99]
    assert engine.evaluate(q.GetTotalOverhead()) > 0 and engine.evaluate(q.GetOverhead("nowhere")) == 0
    engine.evaluate(q.StopTrackingOverhead())
    assert engine.evaluate(q.ClearCaches()) is True and engine.evaluate(q.ResetEngines()) is True


def test_positions_over_many_files(spark, tmp_path):
    from larkspur.operators.positions import add_indices
    from larkspur.sources.tables import with_positions

    path = str(tmp_path / "many.parquet")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    assert all(r.id == r.pos for r in with_positions(spark.read.parquet(path), "pos").collect())
    assert all(r.id == 2 * r.n + 1 for r in add_indices(spark.range(1, 999, 2).repartition(5), "n", ["id"]).collect())


def test_decoders(spark):
    from larkspur.operators import codec

    packed = spark.createDataFrame([(0b11_01_00_10,)], "word long")
    four = packed.selectExpr("word", "explode(sequence(0, 3)) as i")
    assert [r.v for r in codec.unpack_bits(four, "word", 2, "i", "v").orderBy("i").collect()] == [2, 0, 1, 3]
    assert [r.v for r in codec.unpack_bits(spark.createDataFrame([(-1,)], "word long").selectExpr("word", "1 as i"), "word", 32, "i", "v").collect()] == [(1 << 32) - 1]
    runs = spark.createDataFrame([(0, "a"), (2, "b"), (2, "never"), (5, "c")], "start long, value string").where("value <> 'never'")
    at = spark.range(7).withColumnRenamed("id", "pos")
    assert "".join(r.v for r in codec.decode_runs(at, "pos", runs, "start", "value", 7, "v").orderBy("pos").collect()) == "aabbbcc"
    book = spark.createDataFrame([(0, "x"), (1, "y")], "code int, value string")
    got = codec.decode_dictionary(spark.createDataFrame([(1,), (0,), (9,)], "c int"), "c", book, "code", "value", "v").collect()
    assert sorted((r.c, r.v) for r in got) == [(0, "x"), (1, "y"), (9, None)]
    assert [tuple(r) for r in codec.decode_sequence(spark, 5, -2, 3, "v").orderBy("pos").collect()] == [(0, 5), (1, 3), (2, 1)]


def test_interpolation_reaches_across_runs(spark, monkeypatch):
    """Runs of few rows give what one sorted run gives, with groups and without."""
    import random

    from larkspur.operators import relational

    monkeypatch.setattr(relational, "RUN", 3)
    r = random.Random(1)
    rows = [(i, i % 2, None if r.random() < 0.6 else float(r.randint(0, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "x long, g long, y double").repartition(4)
    for by in ([], ["g"]):
        got = {x.x: x.y for x in relational.interpolate(df, "x", "y", by).collect()}
        for i, g, y in rows:
            line = [v for j, h, v in rows if v is not None and j < i and (not by or h == g)]
            after = [v for j, h, v in rows if v is not None and j > i and (not by or h == g)]
            want = y if y is not None else (line[-1] + after[0]) / 2 if line and after else None
            assert got[i] == want, (by, i)


def test_inserted_rows_are_one_local_table(spark):
    engine = Engine(spark)
    engine.evaluate(q.CreateTable(s.t, Sym("k:BIGINT")))
    for i in range(40):
        engine.evaluate(q.InsertInto(s.t, i))
    df = engine.evaluate(q.Table(s.t))
    assert df._jdf.queryExecution().logical().toString().count("Union") == 1
    assert sorted(r.k for r in df.collect()) == list(range(40))


def test_ranges_keep_their_order(spark):
    engine = Engine(spark, {"d": spark.createDataFrame([(i, chr(97 + i)) for i in range(20)], "pos long, v string")})
    ranges = q.Table(q.a(q.List(9, 2, 2)), q.b(q.List(11, 4, 3)))
    out = engine.evaluate(q.GatherRanges(q.Table(s.d), "parquet", s.a, s.b, ranges, q.List(s.pos, s.v), q.RangeIndex(s.r)))
    assert [(r.pos, r.v) for r in out.orderBy("r", "pos").collect()] == [(9, "j"), (10, "k"), (2, "c"), (3, "d"), (2, "c")]


def test_encoded_columns_of_unlike_lengths(spark):
    with pytest.raises(ValueError):
        Engine(spark).evaluate(q.Table(q.a(q.SequenceEncodedList(0, 1, 3)), q.b(q.SingleValueList(64, 4, "INT64", 1))))
    with pytest.raises(ValueError):
        Engine(spark).evaluate(q.Table(q.a(q.RLEList(q.List(0), q.List(1)))))


def test_no_dictionary_at_a_url(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "k long, v string").write.parquet(str(tmp_path / "t"))
    with pytest.raises(KeyError):
        Engine(spark).evaluate(q.GetEncodingForFromURL("x", s.k, str(tmp_path / "t")))


@pytest.fixture
def undealt(spark, monkeypatch):
    """Partitions of a shuffle stay as they are dealt, as those of large tables do; ranges are small."""
    from larkspur.operators import positions

    monkeypatch.setattr(positions, "SPARSE", 8, raising=False)
    monkeypatch.setattr(positions, "PER", 256, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_of_many_rows(spark, undealt):
    """Numbers are gapless and in order, over more rows than one range holds, with nulls, ties and texts."""
    from larkspur.operators.positions import add_indices

    df = spark.range(30_000).selectExpr("id", "id * 7919 % 30000 as k", "if(id % 7 = 0, null, cast(id % 1000 as string)) as t", "repeat('x', 20) as more").repartition(6)
    whole = add_indices(df, "n", ["k"]).collect()
    assert len(whole) == 30_000 and all(r.n == r.k for r in whole)
    got = [(r.n, r.t, r.k) for r in add_indices(df, "n", ["t", "k"]).orderBy("n").select("n", "t", "k", "more").collect()]
    assert [n for n, _, _ in got] == list(range(30_000))
    assert [(t is None, t or "", k) for _, t, k in got] == sorted((t is None, t or "", k) for _, t, k in got)
    tied = add_indices(df, "n", ["t"]).select("n", "t").orderBy("n").collect()
    assert [r.n for r in tied] == list(range(30_000)) and [r.t for r in tied] == [t for _, t, _ in got]


def test_interpolation_of_many_rows(spark, undealt):
    """No row is lost and each null gets the mean of its neighbours, over more rows than one run or range holds."""
    from larkspur.operators.relational import interpolate

    df = spark.range(30_006).selectExpr("id % 3 as g", "id as x", "if(id % 9 < 3, null, 2.0D * id) as y", "repeat('x', 20) as more").repartition(6)
    out = interpolate(df, "x", "y", ["g"])
    assert out.count() == 30_006 and out.where("y = 2.0D * x").count() == 30_003
    assert sorted(r.x for r in out.where("y is null").collect()) == [0, 1, 2]


def test_partial_table_of_many_rows(spark, engine, undealt):
    """Rows stay at the positions named, over more rows than one range holds."""
    df = spark.range(30_000).selectExpr("id as pos", "id * 3 as value", "if(id % 10 = 4, id, null) as wanted", "repeat('x', 20) as more").repartition(6)
    engine.catalog["many"] = df
    out = engine.evaluate(q.PartialTable(s.many, s.wanted))
    assert out.count() == 3_000 and out.where("pos = wanted and value = 3 * wanted").count() == 3_000
