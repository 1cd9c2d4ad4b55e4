import pytest

from colonnade import schema
from colonnade.sources import builders, export
from colonnade.workspace import StoreLocked, Workspace


@pytest.fixture
def v(spark):
    return builders.vector(spark, [1.0, 2.0, 3.0])


def test_names_and_tiers(spark, tmp_path, v):
    with Workspace(spark, str(tmp_path)) as w:
        w.assign("var1", v)
        assert w.has("temp.var1") and w.get("var1").count() == w.get("temp.var1").count() == 3
        w.assign("memory.var2", v)
        assert not w.has("var2") and w.get("memory.var2").count() == 3
        w.assign("persistent.flop", w.get("var1"))
        assert not w.has("var1") and w.get("persistent.flop").count() == 3
        with pytest.raises(ValueError):
            w.assign("persistent.flop", v)
        with pytest.raises(ValueError):
            w.assign("x", v)
        name = w.spaces["temp"].add(v)
        assert name.startswith("__Vector_") and w.spaces["temp"].names() == []
        assert spark.sql("SELECT sum(v) FROM persistent__flop").first()[0] == 6
        assert "flop: vector" in w.report()
    assert w.closed
    with pytest.raises(RuntimeError):
        w.get("persistent.flop")


def test_restore_and_locks(spark, tmp_path, v):
    w = Workspace(spark, str(tmp_path))
    w.assign("persistent.kept", schema.annotate(v, "v", resolution=0.5))
    w.assign("gone", v)
    for mode in (False, True):
        with pytest.raises(StoreLocked):
            Workspace(spark, str(tmp_path), read_only=mode)
    w.close()
    with Workspace(spark, str(tmp_path), read_only=True) as a, Workspace(spark, str(tmp_path), read_only=True) as b:
        assert a.get("persistent.kept").count() == b.get("persistent.kept").count() == 3
        assert schema.metadata(a.get("persistent.kept"), "v")["resolution"] == 0.5
        assert not a.has("gone")
        with pytest.raises(StoreLocked):
            Workspace(spark, str(tmp_path))
        with pytest.raises(PermissionError):
            a.assign("more", v)
    with Workspace(spark, str(tmp_path)) as w:
        w.remove("persistent.kept")
        assert not w.has("persistent.kept") and not (tmp_path / "persistent" / "kept").exists()


def test_elements_stay_in_their_workspace(spark, tmp_path, v):
    with Workspace(spark, str(tmp_path / "a")) as a, Workspace(spark, str(tmp_path / "b")) as b:
        kept = a.assign("mine", v)
        with pytest.raises(ValueError):
            b.assign("mine", kept)
        with a.batch():
            a.spaces["temp"].assign_all({"one": v, "two": v})
        assert a.spaces["temp"].names() == ["mine", "one", "two"]
        a.wipe()
        assert a.spaces["temp"].names() == []


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 2.5, None)], "rid long, text string, num double, none string")
    df = schema.annotate(schema.annotate(df, "rid", row_id=True), "num", label=True)
    assert export.column_order(df) == ["rid", "none", "text", "num"]
    assert export.csv_lines(df).first()[0] == '1,,"say ""hi""",2.5'
    export.export_frame(df, str(tmp_path / "f"), "f", notes=True)
    head = (tmp_path / "f" / "header.csv").read_text().splitlines()
    assert head[0] == '"name","f"' and head[-1] == "rid,none,text,num" and '"label columns",num' in head
    with Workspace(spark, str(tmp_path / "w")) as w:
        w.assign("frame", df)
        w.assign("vec", builders.vector(spark, ["a", "b"]))
        w.assign("one", builders.scalar(spark, 5))
        assert export.export_namespace(w.spaces["temp"], str(tmp_path / "out")) == ["frame.dataFrame.csv", "vec.vector.csv", "scalars.csv"]
        assert (tmp_path / "out" / "scalars.csv").read_text() == '"one",5\n'


def test_copies_notes_and_deletion(spark, tmp_path, v):
    with Workspace(spark, str(tmp_path / "a")) as a, Workspace(spark, f"file://{tmp_path}/b") as b:
        a.assign("mine", v)
        a.copy_to("mine", b, "persistent.theirs")
        a.copy_to("mine", b)
        assert b.get("persistent.theirs").count() == b.get("mine").count() == 3 and a.has("mine")
        with pytest.raises(ValueError):
            b.assign("again", a.get("mine"))
        b.note(owner="me", gone=None)
    (tmp_path / "b" / "persistent" / "lost").mkdir()
    with Workspace(spark, f"file://{tmp_path}/b") as b:
        assert b.notes == {"owner": "me"} and b.stored == 1 and b.get("persistent.theirs").count() == 3
        assert b.collect_garbage() == ["persistent/lost"] and b.has("persistent.theirs")
    with Workspace(spark, str(tmp_path / "b"), read_only=True) as b, pytest.raises(PermissionError):
        b.delete()
    Workspace(spark, str(tmp_path / "b")).delete()
    assert not (tmp_path / "b").exists()


def test_slow_queries_are_dumped(spark, v):
    import io

    from colonnade.operators.debug import QueryDebugger, QueryDump

    out = io.StringIO()
    for debugger in (QueryDump(0.0, out), QueryDump(1e9, out), QueryDebugger(0.0)):
        assert debugger.perform("above", {"v": 1.5}, v, lambda df: df.filter("v > 1.5")).count() == 2
    text = out.getvalue()
    assert text.count("Query above") == 1 and "result rows: 2" in text and "parameters: {'v': 1.5}" in text and "Filter" in text


def test_numbers_as_integers(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0)], "a int, b double")
    assert schema.is_integral_number(df, "a") and not schema.is_integral_number(df, "b")
    assert [r[0] for r in df.select(schema.equals_as_long(df, "a", 1.9)).collect()] == [True, False]
    assert df.filter(schema.equals_as_long(df, "a", "1")).count() == 0
    with pytest.raises(TypeError):
        schema.equals_as_long(df, "b", 1)


def test_codes_back_to_values_and_renamed(spark):
    from colonnade.operators import factors

    codes = factors.factor_of(spark, ["low", "high"])
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 9), (4, None)], "rid int, c int")
    assert {r["rid"]: r["v"] for r in factors.decode(df, "c", codes, "v").collect()} == {1: "high", 2: "low", 3: None, 4: None}
    assert [r[0] for r in factors.values_in_order(factors.clone_and_rename(codes, {"low": "least"})).collect()] == ["least", "high"]
    for names in ({"none": "x"}, {"low": "high"}):
        with pytest.raises(ValueError):
            factors.clone_and_rename(codes, names)
