"""What keeps queries whole on larger tables: archives in place of a file a row, partitions that grow with the input, batches that hold what they should."""

import os

from pyspark.sql import functions as F

from trialgrid.plans import queries_records
from trialgrid.plans.bindings import Bound
from trialgrid.sources import readers, writers
from trialgrid.streaming import streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def results(spark):
    name = lambda i, seed: f"c/m/a b/base/results/route_{i}_p0_seed{seed}.json"
    files = [(name(1, 42), '{"labels": ["x"]}'), (name(2, 42), "\n"), (name(3, 43), "{}"), (name(4, 42), ""), (name(6, 42), None), ("c/m/a b/base/route_5_p0_seed42.json", "{}"), (name(7, 42), '{"labels": [')]
    return spark.createDataFrame(files, "path string, value string")


def test_an_archive_reads_as_its_tree(spark, tmp_path):
    writers.write_tree(results(spark), str(tmp_path / "tree"))
    writers.pack_tree(results(spark).coalesce(1), str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("*.parquet"))) == 1
    for seeds in ((42,), None):
        loose, packed = readers.scan_results(spark, str(tmp_path / "tree"), seeds), readers.scan_results(spark, str(tmp_path / "packed"), seeds, packed=True)
        tail = F.substring_index("path", "/", -1).alias("path")
        for one, other, more in ((loose[0], packed[0], ["scenario", "level", "route_id", "variant", "seed", "labels"]), (loose[1], packed[1], [F.regexp_replace("text", "\n$", "").alias("text"), "nothing_read"])):
            assert rows(one.select(tail, *more)) == rows(other.select(tail, *more)) and other.count()


def test_archives_of_several_sources(spark, tmp_path):
    writers.pack_tree(results(spark).withColumn("seed", F.regexp_extract("path", "seed([0-9]+)", 1)), str(tmp_path / "t"), ("seed",))
    got = readers.scan_sources(spark, [readers.Source(f"{tmp_path}/t/seed={s}", (s,), packed=True) for s in (42, 43)], ("m",), 43)
    assert rows(got.select("category", "model", "route_id", "seed")) == [("c", "m", "3", 43)]


def test_the_number_of_files_of_a_result_tree_is_not_that_of_its_runs(spark, tmp_path):
    b = Bound(spark, SF)
    queries_records.result_tree(b, str(tmp_path / "t"))
    found = [f for _, _, names in os.walk(tmp_path / "t") for f in names if not f.startswith((".", "_"))]
    assert spark.read.parquet(str(tmp_path / "t")).count() == b.v_rec.count() > 100 and len(found) <= 64


def test_late_ticks_are_late_though_all_parts_are_few_files(spark, tmp_path):
    from trialgrid.plans import queries_runs

    one = spark.range(1000).where("id % 3 = 1 AND pmod(hash(id), 4) = 0").head()[0]  # its ticks fill the first of four partitions and leave the others empty
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(600).withColumn("l_suppkey", F.lit(one).cast("bigint")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    late = queries_runs.tick_stream(Bound(spark, str(tmp_path)), queries_runs.LATE_TICKS)[streams.LATE]
    assert rows(late.select("run_id", "frame")) == [(one, 20), (one, 70)]


def test_partitions_of_ticks_grow_with_the_table(spark, monkeypatch):
    from trialgrid.plans import bindings

    b = Bound(spark, SF)
    least, n = int(spark.conf.get("spark.sql.shuffle.partitions")), b.lineitem.count()
    assert b.parts("lineitem") == b.v_tel.rdd.getNumPartitions() == least
    monkeypatch.setattr(bindings, "PART_ROWS", 100)
    assert Bound(spark, SF).v_tel.rdd.getNumPartitions() == -(-n // 100) > least


def test_global_statistics_are_rounded_to_three_digits_before_they_are_compared(spark, tmp_path):
    import duckdb

    from trialgrid import catalog

    at = lambda t: str(tmp_path / f"{t}.parquet")
    table = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    # one run of 49.85, of 1000 planned: a mean of 0.05 at three digits, below it without
    table("orders").limit(1).withColumn("o_orderkey", F.lit(757).cast("bigint")).write.parquet(at("orders"))
    line = {"l_orderkey": F.lit(757).cast("bigint"), "l_linenumber": F.lit(2), "l_quantity": F.lit(30.0), "l_returnflag": F.lit("R")}
    table("lineitem").limit(1).withColumns(line).write.parquet(at("lineitem"))
    for t in ("customer", "part"):
        table(t).write.parquet(at(t))
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at(t)}/*.parquet'")
    ours = catalog.QUERIES["a7_global_stats"](spark, str(tmp_path)).toPandas()
    theirs = con.execute(catalog.SQL["a7_global_stats"]()).df()
    assert ours["mean_composed"].tolist() == theirs["mean_composed"].tolist() == [0.1]


def test_arrivals_in_archives_are_those_of_the_tree(spark, tmp_path):
    name = lambda i, seed: f"c/m/s/base/results/route_{i}_p0_seed{seed}.json"
    files = [(name(i, 42), "" if i == 1 else "{}") for i in range(3)] + [("c/m/s/base/x/results/route_1_p0_seed42.json", "{}"), (name(1, 9), "{}"), (name(4, 9), None), ("c/m/s/base/route_8_p0_seed42.json", "{}")]
    writers.pack_tree(spark.createDataFrame(files, "path string, value string").repartition(3), str(tmp_path / "in"))
    stream = streams.result_files(spark, str(tmp_path / "in"), 1, packed=True)
    got = streams.drain(streams.completeness_stream(stream, ["scenario", "level", "route_id", "variant"], ["model", "category", "seed"], "modificationTime"), str(tmp_path / "s"), "update", ["model", "category", "seed"])
    assert rows(got) == [("m", "c", 42, 3), ("m", "c", 9, 1)]


def test_partitions_of_reactions_grow_with_the_table(spark, monkeypatch):
    from trialgrid.plans import bindings, queries_runs

    monkeypatch.setattr(bindings, "PART_ROWS", 100)
    b = Bound(spark, SF)
    assert queries_runs.reactions(b).rdd.getNumPartitions() == b.parts("lineitem") > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_state_of_streams_is_dealt_by_cores_and_rows(spark, tmp_path, monkeypatch):
    from trialgrid import catalog
    from trialgrid.plans import bindings, queries_runs

    monkeypatch.setattr(queries_runs, "shared_path", lambda _, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for query, name, table in (("t3_completeness_stream", "arrivals", "orders"), ("t2_ledger_stream", "attempts", "events")):
        catalog.QUERIES[query](spark, SF).count()
        held = [x for x in os.listdir(tmp_path / name / "state" / "state" / "0") if x.isdigit()]
        assert len(held) == Bound(spark, SF).state_parts(table) == spark.sparkContext.defaultParallelism < int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    monkeypatch.setattr(bindings, "PART_ROWS", 100)
    assert Bound(spark, SF).state_parts("orders") == -(-Bound(spark, SF).orders.count() // 100) > int(before)
