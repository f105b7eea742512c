"""Small hand-computed cases of the operators."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.errors import DataError, GenerationError, ParameterError, UserError
from tabloom.functions import expressions as X
from tabloom.operators import cluster, codecs, detect, records, relational, sampling, sequences, stats
from tabloom.plans import record_pipeline, synthesizers
from tabloom.sources import files
from tabloom.streaming import streams


def test_distance_of_distributions(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "key string, mass double")
    get = lambda a, b: stats.js_distance(frame(a), frame(b)).first()[0]
    assert get({"foo": 1.0, "baz": 0.0}, {"bar": 1.0, "baz": 0.0}) == pytest.approx(1.0)
    assert get({"foo": 1.0, "baz": 0.0}, {"foo": 0.5, "baz": 0.5}) == pytest.approx(0.5579230452841438)
    assert get({"foo": 1.0, "bar": 0.0, "baz": 0.0}, {"foo": 1.0}) == 0
    assert get({"foo": 1.0}, {"foo": 0.0}) == stats.EMPTY_DISTANCE


def test_memorized_rows_count_missing_as_equal_and_harmonise_types(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "a int, b string")
    b = spark.createDataFrame([("1", "x"), (None, "y"), ("4", "z")], "a string, b string")
    assert relational.count_memorized(a, b).first()[0] == 2
    with pytest.raises(ParameterError):
        relational.memorized_rows(a, b.toDF("c", "d"))


def test_correlation_matrix_with_missing_and_infinite_values(spark):
    rows = [(i, float("inf") if i % 10 == 0 else float(i % 7), float("nan") if i % 9 == 0 else float(i), "ab"[i % 2] if i % 8 else None, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, x double, y double, s string, one int")
    cells = {(r[0], r[1]): r[2] for r in stats.correlation_matrix(df, ["s"]).collect()}
    assert len(cells) == 25 and all(math.isfinite(v) for v in cells.values())
    assert cells["one", "one"] == 1 and cells["one", "x"] == 0 and cells["id", "id"] == 1


def test_upsample_sizes(spark):
    df = spark.range(1000)
    for target, n in ((800, 1000), (1001, 1001), (2000, 2000), (2042, 2042)):
        assert relational.upsample(df, target, "id").count() == n


def test_longest_run_and_repair(spark):
    v = [None, None, 1.0, None, 3.0, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "e string, t int, v double")
    assert sequences.longest_null_run(df, "e", "t", "v").first()["run"] == 2
    assert [r.v for r in sequences.interpolate(df, "e", "t", "v").orderBy("t").collect()] == [1, 1, 1, 2, 3, 3]


def test_scaling_both_ranges(spark):
    df = spark.createDataFrame([(1.5,), (3.0,), (-1.0,)], "v double")
    unit = [r[0] for r in df.select(sequences.scale(F.col("v"), F.lit(-1.0), F.lit(3.0))).collect()]
    both = [r[0] for r in df.select(sequences.scale(F.col("v"), F.lit(-1.0), F.lit(3.0), True)).collect()]
    assert unit == [0.625, 1, 0] and both == [0.25, 1, -1]


def test_validity_is_an_error_where_most_examples_fail(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(10)] + [("b", i, 1.0) for i in range(10)] + [("c", i, None) for i in range(10)], "e string, t int, v double")
    valid = sequences.example_validity(df, "e", "t", ["v"])
    assert {r.e: r.valid for r in valid.collect()} == {"a": False, "b": True, "c": False}
    with pytest.raises(DataError):
        sequences.keep_valid(df, valid, "e")


def test_too_long_sequence_raises(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(Exception, match="longer than 1"):
        sequences.pad(df, "v", 1).collect()


def test_encodings(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (13,)], "o int")
    bits = [r[0] for r in df.select(X.binary(F.col("o"), 4)).collect()]
    assert bits == [[0, 0, 0, 0], [0, 0, 0, 1], [0, 1, 1, 1], [1, 1, 0, 1]]
    assert [r[0] for r in df.select(X.binary_decode(X.binary(F.col("o"), 4))).collect()] == [0, 1, 7, 13]
    with pytest.raises(Exception, match="outside the dictionary"):
        df.select(X.one_hot(F.col("o"), 7)).collect()
    assert X.bits_for(4) == 3 and X.bits_for(3) == 2


def test_codecs_round_trip_with_missing_values(spark):
    df = spark.createDataFrame([(1, "a", 1.25, None), (2, None, None, None), (3, "b", -2.5, None)], "k int, c string, x double, e double")
    t = codecs.TableCodec("k", continuous="float", chosen={"k": "float"}).fit(df)
    back = t.decode(t.encode(df)).orderBy("k").collect()
    assert [(r.c, r.x) for r in back] == [("a", 1.25), (None, None), ("b", -2.5)] and all(r.e is None for r in back)
    b = codecs.BinaryCodec("c").fit(df, "k")
    assert [r.c for r in b.decode(b.encode(df)).orderBy("k").collect()] == ["a", None, "b"]
    f = codecs.FrequencyCodec("c").fit(df)
    assert {r.k: r.c for r in f.decode(f.encode(df)).collect()} == {1: "a", 2: None, 3: "b"}


def test_mixture_inverse_is_close(spark):
    df = spark.range(400).select((F.col("id") % 2 * 100 + F.col("id") % 10).cast("double").alias("x"), "id")
    m = codecs.MixtureCodec("x", components=3, seed=1).fit(df)
    back = m.decode(m.encode(df).select("id", "x")).join(df.withColumnRenamed("x", "y"), "id")
    assert back.where(F.abs(F.col("x") - F.col("y")) > 5).count() < 8


@pytest.mark.parametrize(("text", "name"), [("2020-01-31", "%Y-%m-%d"), ("01/31/2020", "%m/%d/%Y"), ("31.12.2020", "%d.%m.%Y"), ("2020-01-31 10:11:12", "%Y-%m-%d %X"), ("2020-01-31T10:11:12Z", "%Y-%m-%dT%X%z"), ("Jan 31 2020", "%b %d %Y")])
def test_datetime_formats(spark, text, name):
    df = spark.createDataFrame([(text,), (None,), (text,)], "d string")
    assert [tuple(r) for r in detect.detect_datetimes(df).collect()] == [("d", name)]


def test_no_datetime_in_junk(spark):
    df = spark.createDataFrame([("hello",), ("12",)], "d string")
    assert detect.detect_datetimes(df).count() == 0


def test_sparse_datetimes_beside_many_masks(spark):
    names = [("a" * i + " " + "b" * j, None, None) for i in range(1, 41) for j in range(1, 41)] * 2
    df = spark.createDataFrame([*names, ("x", "2020-01-31", "1:30 xx"), ("y", None, "1:30 pm")], "name string, day string, time string").coalesce(1)
    assert {tuple(r) for r in detect.detect_datetimes(df).collect()} == {("day", "%Y-%m-%d"), ("time", "%I:%M %p")}


def test_any_shape_is_that_of_the_candidates(spark):
    def example(shape, most):
        out = re.sub(r"\(\?:Z\|(.*?)\)$", r"\1", shape) if most else re.sub(r"\(\?:Z\|.*?\)$", "Z", shape)
        out = re.sub(r"\[([^]])[^]]*\]\{([0-9]+)(?:,([0-9]+))?\}", lambda m: m[1].replace("0", "1") * int((most and m[3]) or m[2]), out)
        return re.sub(r"\[\+-\]", "+", re.sub(r"\[AaPp\]\[Mm\]", "pM", out)).replace("[.]", ".").replace("\\.", ".")

    shapes = sorted({f.shape for f in detect.CANDIDATES})
    texts = [example(s, most) for s in shapes for most in (False, True)]
    assert all(re.fullmatch(s, t) for s, t in zip([s for s in shapes for _ in range(2)], texts, strict=True))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~F.col("t").rlike(detect.any_shape())).count() == 0
    none = ["", "hello", "12", "2020-01-31 ", "2020-01-31X10:11", "1:30 xx", "2020-01", "2020-01-31 10:11:12+1"]
    assert spark.createDataFrame([(t,) for t in none], "t string").where(F.col("t").rlike(detect.any_shape())).count() == 0


def test_clusters_hold_all_columns_once(spark, data):
    c = files.read_table(spark, f"{data}/customer.parquet")
    groups = cluster.cluster_columns(c, "c_custkey", prefix=["c_name"], most=2)
    assert groups[0][0] == "c_name" and sorted(x for g in groups for x in g) == sorted(c.columns)
    with pytest.raises(ParameterError):
        cluster.cluster_columns(c, prefix=["nothing"])


def test_python_validator(spark):
    def check(line):
        if line == "boom":
            raise ValueError("bad line")
        return None if line == "?" else line.isdigit()

    df = spark.createDataFrame([(0, "1"), (1, "x"), (2, "boom"), (3, "?")], "i int, text string")
    out = {r.i: (r.valid, r.explain) for r in records.validate(df, "text", check).collect()}
    assert out == {0: (True, None), 1: (False, None), 2: (False, "bad line"), 3: (None, None)}


def test_records_and_workers(spark):
    df = spark.createDataFrame([("a,b,,",), ("a",), ("a,b,c,d",)], "t string")
    got = [r[0] for r in df.select(X.named_values(X.split_record(F.col("t"), ","), ["x", "y", "z"])).collect()]
    assert got[0].asDict() == {"x": "a", "y": "b", "z": ""} and got[1].asDict() == {"x": "a", "y": "", "z": ""} and got[2] is None
    assert records.worker_count(None, 8, 100) == 8 and records.worker_count(-1, 8, 100) == 7 and records.worker_count(0.5, 8, 100) == 4 and records.worker_count(4, 8, 5) == 1
    with pytest.raises(ParameterError):
        records.check_start("abc", ",")


def test_model_folder_round_trip(tmp_path):
    c = files.BatchConfig(str(tmp_path / "m"), epochs=3)
    c.save()
    assert files.BatchConfig.load(str(tmp_path / "m")).epochs == 3
    files.save_headers(str(tmp_path / "m"), ["a", "b"])
    assert files.load_headers(str(tmp_path / "m")) == ["a", "b"]
    files.archive(str(tmp_path / "m"), str(tmp_path / "m.tar.gz"))
    files.extract(str(tmp_path / "m.tar.gz"), str(tmp_path / "out"))
    assert (tmp_path / "out/model_params.json").exists()
    with pytest.raises(UserError):
        files.batch_folders(str(tmp_path))


def test_lines_and_typed_records(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1,a\n2,b\n3,c\n")
    lines = files.read_lines(spark, str(tmp_path / "x.txt"))
    assert [tuple(r) for r in lines.orderBy("line_id").collect()] == [(0, "1,a"), (1, "2,b"), (2, "3,c")]
    t = files.typed(lines, "line", ["n", "s"])
    assert t.dtypes == [("n", "bigint"), ("s", "string")] and files.typed(lines.where("false"), "line", ["n"]).count() == 0


def test_synthesizers(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    m = synthesizers.CopulaSynthesizer(constraints=["x > 10"]).fit(df)
    s = m.sample(spark, 200, 5, {"c": "a"})
    assert s.count() == 200 and s.where("x <= 10 or c <> 'a'").count() == 0 and s.select(F.corr("x", "y")).first()[0] > 0.9
    with pytest.raises(ParameterError):
        m.sample(spark, 1, 0, {"nothing": 1})
    text = synthesizers.TextSynthesizer(2).fit(spark.createDataFrame([("abcabc",), ("abcd",)], "line string")).sample(spark, 20, 1, start="ab")
    assert all(r.text.startswith("ab") for r in text.collect())


def test_constraints_that_few_rows_meet_are_met_or_raise(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("x"))
    m = synthesizers.CopulaSynthesizer(constraints=["x > 290"]).fit(df)
    assert m.sample(spark, 200, 1).where("x > 290").count() == 200
    with pytest.raises(GenerationError):
        synthesizers.CopulaSynthesizer(constraints=["x > 1000"]).fit(df).sample(spark, 5)


def test_completion_depends_on_the_known_cells(spark):
    df = spark.range(400).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    m = synthesizers.CopulaSynthesizer(primary_key="id").fit(df)
    done = m.complete(df.select("id", "x"), "id", seed=1)
    assert done.select(F.corr("x", "y")).first()[0] > 0.95 and done.count() == 400
    some = spark.createDataFrame([(1, None), (2, 5.0)], "id long, x double")
    assert [(r.id, r.x) for r in m.complete(some, "id").orderBy("id").collect()] == [(1, None), (2, 5.0)]
    assert m.sample(spark, 300, 2, {"x": 390.0}).agg(F.avg("y")).first()[0] > 700 > m.sample(spark, 300, 2).agg(F.avg("y")).first()[0]
    assert m.complete(df.select("id", "x").repartition(7), "id", 1).orderBy("id").collect() == done.orderBy("id").collect()


def test_all_categories_and_contexts_are_kept(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id")).alias("c"), (F.col("id") % 3).cast("double").alias("x"))
    m = synthesizers.CopulaSynthesizer().fit(df)
    drawn = m.sample(spark, 20_000, 4)
    assert drawn.select("c").distinct().count() > 4500 and drawn.join(df, "c", "left_anti").count() == 0
    m.save(str(tmp_path / "m.json"))
    assert synthesizers.CopulaSynthesizer.load(str(tmp_path / "m.json")).sample(spark, 50, 4).orderBy("c").collect() == m.sample(spark, 50, 4).orderBy("c").collect()
    lines = spark.createDataFrame([(f"{a}{b}" * 130,) for a in "abcdefgh" for b in "ijklmnop"], "line string")
    text = synthesizers.TextSynthesizer(4).fit(lines, most_contexts=30)
    assert text.order == 1 and len(text.table) == 17 and max(len(r.text) for r in synthesizers.TextSynthesizer(4).fit(lines).sample(spark, 50, 1).collect()) > 200
    text.save(str(tmp_path / "t.json"))
    assert synthesizers.TextSynthesizer.load(str(tmp_path / "t.json")).sample(spark, 9, 2).collect() == text.sample(spark, 9, 2).collect()


def test_sequences_are_saved_and_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 10).alias("e"), F.col("id").alias("t"), F.rand(1).alias("v"))
    m = synthesizers.SequenceSynthesizer("e", "t", ["v"]).fit(df)
    first = m.sample(spark, 30, 5).orderBy("sample_id", "pos").collect()
    m.save(str(tmp_path / "s"))
    again = synthesizers.SequenceSynthesizer.load(str(tmp_path / "s"))
    again.source = again.source.repartition(9)
    assert again.sample(spark, 30, 5).orderBy("sample_id", "pos").collect() == first


def test_draws_meet_their_interval_whatever_their_number(spark):
    values = spark.range(20_000).select(F.format_string("%05d", "id").alias("value"), ((F.col("id") + 1) / 20_000).alias("high"))
    got = sampling.draw(spark.createDataFrame([(0.0,), (0.5,), (0.99999,), (1.0,), (0.25003,)], "r double"), "r", values)
    assert {r.r: r.value for r in got.collect()} == {0.0: "00000", 0.5: "10000", 0.99999: "19999", 1.0: "19999", 0.25003: "05000"}


def test_streamed_validation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1\nx\n")
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    out = streams.run_once(streams.validated(stream, "text", "text rlike '^[0-9]+$'"), "validated_lines", str(tmp_path / "cp"))
    assert {r.text: r.valid for r in out.collect()} == {"1": True, "x": False}


def test_copula_is_saved_and_completes_rows(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    m = synthesizers.CopulaSynthesizer().fit(df)
    m.save(str(tmp_path / "m.json"))
    again = synthesizers.CopulaSynthesizer.load(str(tmp_path / "m.json"))
    assert again.sample(spark, 20, 3).collect() == m.sample(spark, 20, 3).collect()
    known = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    assert [(r.k, r.c) for r in again.complete(known, "k").orderBy("k").collect()] == [(1, "a"), (2, "b")]


def test_record_pipeline(spark, data):
    n = files.read_table(spark, f"{data}/nation.parquet")
    p = record_pipeline.RecordPipeline(batch_size=2, order=6).fit(n, seeds=["n_regionkey"])
    made, summaries = p.generate(spark, 12, seed=2, start={"n_regionkey": "1"})
    rows = made.collect()
    assert len(rows) == 12 and made.columns == ["rank", *n.columns] and all(r.n_regionkey == "1" for r in rows)
    assert all(s.first()["is_valid"] for s in summaries)
    seen = []
    few, _ = p.generate(spark, 5, seed=3, most_invalid=200, check="n_regionkey <> '0'", progress=seen.append)
    assert few.count() == 5 and few.where("n_regionkey = '0'").count() == 0
    assert {x["batch"] for x in seen} == {None, *range(len(p.batches))} and all(x["valid"] + x["invalid"] > 0 for x in seen)
    judged = records.validate_records(n, lambda r: r["n_nationkey"] < 3)
    assert judged.where("valid").count() == 3
    seeds = spark.createDataFrame([(7, "0"), (8, "1"), (9, "0")], "k long, n_regionkey string")
    assert sorted((r.seed_id, r.n_regionkey) for r in p.generate_seeded(seeds, "k", ["n_regionkey"]).collect()) == [(7, "0"), (8, "1"), (9, "0")]


def test_numbers_do_not_depend_on_what_a_branch_reads(spark, monkeypatch):
    rows = spark.range(0, 400_000, 1, 8).select(F.pmod(F.col("id") * 7919, F.lit(400_003)).alias("k"), F.when(F.col("id") % 1000 != 0, F.floor(F.col("id") / 97)).alias("t"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        for out in (sequences.numbered(rows, ["t", "k"], "n"), sequences.running_sums(rows, ["t", "k"], {"n": F.lit(1)}).withColumn("n", F.col("n") - 1)):
            right = out.withColumn("at", F.row_number().over(Window.orderBy("t", "k")) - 1)
            assert right.where("n <> at or length(wide) <> 256").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    monkeypatch.setattr(sequences, "RANGE_ROWS", 1)
    few = spark.createDataFrame([(None, 2.0), (1.5, None), (float("nan"), 1.0), (1.5, float("-inf"))], "a double, b double")
    assert [r.n for r in sequences.numbered(few, ["a", "b"], "n").orderBy("a", "b").collect()] == [0, 1, 2, 3]
    assert sequences.numbered(few.where("false"), "a", "n").count() == 0


def test_nearest_is_exact_across_cells_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(relational, "CELL_POINTS", 8)
    draw = random.Random(5)
    rows = [(i, [float(draw.randrange(9)), draw.randrange(4) / 4]) for i in range(300)] + [(i, [draw.gauss(40, 9), draw.gauss(0, 9)]) for i in range(300, 500)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan"), 1.0]), (503, [float("inf"), 0.0]), (504, [1.0]), (505, [])]

    def away(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 3, 0.0
        d = math.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), 0.0))
        return (2, 0.0) if math.isnan(d) else (1, 0.0) if math.isinf(d) else (0, d)

    def right(asks, points):
        return {(i, j, n) for i, v in asks for n, (_, j) in enumerate(sorted((away(v, w), j) for j, w in points if j != i)[:5], 1)}

    for points in (rows, rows[:3] + rows[500:505], rows[7:8] * 1):
        asks = [r for r in rows if r[0] % 5 == 0 or r[0] >= 500]
        q, p = (spark.createDataFrame(x, "id long, v array<double>") for x in (asks, points))
        found = [tuple(r) for r in relational.nearest(q, p, "id", "v").select("query_id", "neighbour_id", "rank").collect()]
        assert len(found) == len(set(found)) and set(found) == right(asks, points)
    none = spark.createDataFrame([], "id long, v array<double>")
    assert relational.nearest(none, none, "id", "v").count() == 0
