"""Files found, read, typed, numbered, filtered and written."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from eqlake.sources import readers as R


def test_formats(spark, tmp_path):
    rows = [{"id": 1, "kernel": "x*t", "f": "x", "lambda_val": 0.5}, {"id": 2, "kernel": "1", "f": "x**2", "lambda_val": 1.0}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"data": rows}))
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "d.csv").write_text("id,kernel,f,lambda_val\n1,x*t,x,0.5\n2,1,x**2,1.0\n")
    for name in "abcd":
        path = next(str(p) for p in tmp_path.glob(f"{name}.*"))
        got = R.read(spark, path).select("id", "kernel", "f", "lambda_val").orderBy("id").collect()
        assert [tuple(str(v) for v in r) for r in got] == [("1", "x*t", "x", "0.5"), ("2", "1", "x**2", "1.0")], name
    assert R.read(spark, str(tmp_path / "d.csv"), schema="id int, kernel string, f string, lambda_val double").schema["id"].dataType.simpleString() == "int"
    assert [r.id for r in R.read(spark, str(tmp_path / "a.json"), limit=1, key="id").collect()] == [1]
    assert R.read(spark, str(tmp_path / "none.csv"), schema="id int").count() == 0
    assert R.format_of("x/y.JSONL") == "jsonl" and R.format_of("x.odd") == "json"
    with pytest.raises(ValueError):
        R.read(spark, str(tmp_path), "xml")


def test_written_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", [1.0, 2.0]), (2, None, None)], "i int, t string, v array<double>")
    for end in ("parquet", "jsonl"):
        R.write(df, f"{tmp_path}/o.{end}")
        assert sorted((r.i, r.t, r.v) for r in R.read(spark, f"{tmp_path}/o.{end}").collect()) == [(1, "a,\"b\"\nc", [1.0, 2.0]), (2, None, None)]
    R.write(df, f"{tmp_path}/o.csv")
    back = {str(r.i): r for r in spark.read.csv(f"{tmp_path}/o.csv", header=True, multiLine=True, escape='"').collect()}
    assert back["1"].t == "a,\"b\"\nc" and json.loads(back["1"].v) == [1.0, 2.0]
    out = R.write_metrics(df.select("i", "t"), f"{tmp_path}/m.json", "i")
    assert out[2] == {} and json.loads((tmp_path / "m.json").read_text())["1"]["t"].startswith("a")


def test_equations(spark):
    raw = spark.createDataFrame([(" 2x ", "x", "x*t", "0.5", "0", "1", "true", "3"), ("sinh(x)", "exp(x)", "7", "odd", None, "1", "no", None)], "U string, f string, Kernel string, lmbda string, a string, B string, u_is_polynomial string, u_max_degree string")
    e = R.equations(raw).collect()
    assert (e[0].u, e[0].u_type, e[0].lambda_val, e[0].b, e[0].u_max_degree, e[0].kernel_type) == ("2*x", "polynomial", 0.5, 1.0, 3, "polynomial")
    assert (e[1].u_type, e[1].f_type, e[1].kernel_type, e[1].lambda_val, e[1].a, e[1].u_max_degree) == ("hyperbolic", "exponential", "real_value", 1.0, 1.0, 0)
    typed = R.equations(raw)
    assert R.filtered(typed, max_degree=2).count() == 1 and R.filtered(typed, u_type="polynomial", f_type="polynomial").count() == 1
    assert R.only(typed, "nothing", "u").columns == ["u"] and "u" not in R.without(typed, "u", "nothing").columns


def test_places_batches_ids(spark):
    df = spark.range(0, 103, 1, 7).select("id", *(F.lit("x").alias(c) for c in R.REQUIRED))
    rows = {r.equation_id: r.id for r in R.with_ids(df).collect()}
    assert rows == {f"eq_{k}": k for k in range(103)}
    own = df.withColumn("equation_id", F.when(F.col("id") == 5, "mine"))
    assert {r.equation_id for r in R.with_ids(own).where("id in (5, 6)").collect()} == {"mine", "eq_6"}
    assert R.at(df, 50)["id"] == 50 and R.at(df, 103) is None
    sizes = [len(b) for b in R.batches(df, 25)]
    assert sizes == [25, 25, 25, 25, 3]
    with pytest.raises(ValueError, match="kernel"):
        R.with_ids(df.drop("kernel"))
    assert R.sample(df, 10, "id").count() == 10 and R.sample(df, 500, "id").count() == 103
    assert R.numbered(df.where("false"), "n").count() == 0


def test_files(spark, tmp_path):
    for name in ("base.csv", "x.json", "validation_report.json", "z.txt"):
        (tmp_path / name).write_text("a")
    names = lambda: [p.rsplit("/", 1)[-1] for p in R.equation_files(str(tmp_path))]
    assert names() == ["base.csv", "x.json"]
    (tmp_path / "formatted").mkdir()
    assert names() == ["x.json"]
    (tmp_path / "formatted" / "train_rpn.csv").write_text("a")
    assert names() == ["train_rpn.csv"] and R.equation_files(str(tmp_path / "x.json")) == [str(tmp_path / "x.json")]
    assert R.newest(f"{tmp_path}/*.json").endswith("x.json") and R.newest(f"{tmp_path}/*.odd") is None
    assert {r.md5 for r in R.digests(spark, str(tmp_path / "x.json")).collect()} == {"0cc175b9c0f1b6a831c399e269772661"}
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("in/a.csv", "1")
    assert (tmp_path / "p" / "in" / "a.csv").exists() is False
    assert R.extracted(str(tmp_path / "p.zip")) == str(tmp_path / "p") and (tmp_path / "p" / "in" / "a.csv").exists()
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("../out.csv", "1")
    with pytest.raises(ValueError):
        R.extracted(str(tmp_path / "q.zip"))


def test_points_and_settings(spark, tmp_path):
    texts = ['{"x_values": [0, 1], "u_values": [1.5, 2]}', "{'x_values': [0.0], 'u_values': [1.0], 'constant_samples': None}", "odd", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(R.points_of(F.col("t")).alias("p")).collect()
    assert [r.p and (r.p.x_values, r.p.u_values) for r in got] == [([0, 1], [1.5, 2]), ([0], [1]), None, None]
    assert R.literal("{'a': None}") == {"a": None} and R.literal("[1]") is None and R.literal("x +") is None
    (tmp_path / "s.json").write_text('{"split": {"train": 0.7}}')
    s = R.settings(str(tmp_path / "s.json"))
    assert s["split"] == {"train": 0.7, "val": 0.1, "seed": 42} and R.DEFAULTS["split"]["train"] == 0.8
    R.save_settings(s, str(tmp_path / "t.json"))
    assert R.settings(str(tmp_path / "t.json")) == s
    (tmp_path / "u.json").write_text('{"odd": {}}')
    with pytest.raises(ValueError):
        R.settings(str(tmp_path / "u.json"))
