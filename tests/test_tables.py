"""Arrow file tables, named data files, and writes that appear whole."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.plans.catalog import QUERIES
from tallyweave.sources import arrow_tables, readers, sinks

SF = "/root/testdata/sf0.001"


def arrow_files(folder, tables, stream=False, batch_rows=4):
    os.makedirs(folder, exist_ok=True)
    for i, table in enumerate(tables):
        with pa.OSFile(f"{folder}/{'stream' if stream else 'file'}-{i}.arrow", "wb") as out:
            with (pa.ipc.new_stream if stream else pa.ipc.new_file)(out, table.schema) as writer:
                writer.write_table(table, max_chunksize=batch_rows)


def table(start, n):
    ids = list(range(start, start + n))
    return pa.table({
        "id": pa.array(ids, pa.int64()),
        "text": pa.array([None if i % 5 == 0 else f"tëxt {i}" for i in ids], pa.large_string()),
        "tags": pa.array([[f"t{i}"] * (i % 3) for i in ids], pa.list_(pa.string())),
    })


def test_arrow_files_are_read_by_ranges_of_batches(spark, tmp_path):
    folder = str(tmp_path / "t")
    arrow_files(folder, [table(0, 40), table(40, 7), table(47, 0)])
    arrow_files(folder, [table(100, 9)], stream=True)
    (tmp_path / "t" / "dataset_info.json").write_text("{}")
    df = arrow_tables.read_arrow_table(spark, folder, task_bytes=1)
    assert dict(df.dtypes) == {"id": "bigint", "text": "string", "tags": "array<string>"}
    assert df.rdd.getNumPartitions() == 10 + 2 + 1
    want = [r for t in (table(0, 47), table(100, 9)) for r in t.to_pylist()]
    assert [r.asDict() for r in df.orderBy("id").collect()] == want
    narrow = arrow_tables.read_arrow_table(spark, f"file://{folder}", ["text"])
    assert narrow.columns == ["text"] and narrow.count() == 56
    one = arrow_tables.read_arrow_table(spark, f"{folder}/file-1.arrow", ["tags", "id"])
    assert [tuple(r) for r in one.orderBy("id").collect()] == [(r["tags"], r["id"]) for r in table(40, 7).to_pylist()]


def test_arrow_files_of_another_schema_are_refused(spark, tmp_path):
    folder = str(tmp_path / "t")
    arrow_files(folder, [table(0, 3), pa.table({"id": ["not a number"], "text": ["x"], "tags": [["y"]]})])
    with pytest.raises(Exception, match="column 'id' is string, not bigint"):
        arrow_tables.read_arrow_table(spark, folder).collect()
    assert arrow_tables.read_arrow_table(spark, folder, ["text"]).count() == 4
    with pytest.raises(Exception, match="no .arrow files"):
        arrow_tables.read_arrow_table(spark, str(tmp_path)).collect() if os.rename(folder, f"{tmp_path}-moved") is None else None


@pytest.mark.parametrize("stream", [False, True])
def test_arrow_round_trip(spark, tmp_path, stream):
    rows = [(i, None if i % 4 == 0 else "é" * i, [float(i)], i % 2 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, t string, v array<double>, b boolean").repartition(3)
    path = str(tmp_path / "out")
    arrow_tables.write_arrow_table(df, path, stream)
    assert sorted(os.listdir(path)) == [f"part-0000{i}.arrow" for i in range(3)]
    back = arrow_tables.read_arrow_table(spark, path)
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == sorted(rows, key=lambda r: r[0])


def test_data_files(spark, tmp_path):
    for part, n in (("train/a", 3), ("train/b", 2), ("test/c", 4)):
        spark.range(n).coalesce(1).write.json(f"{tmp_path}/{part}")
    read = lambda files, split=None: readers.read_data_files(spark, str(tmp_path), files, "id bigint", split).count()
    splits = {"train": ["train/a/*.json", "train/b/*.json"], "test": "test/*/*.json"}
    assert read(splits, "train") == 5 and read(splits, "test") == 4 and read(splits) == 9
    assert read("train/*/*.json") == 5 and read(["train/a/*.json", "test/c"]) == 7
    with pytest.raises(KeyError):
        read(splits, "dev")


def results(spark, keys):
    df = spark.range(60).select((F.col("id") % len(keys)).alias("k"), F.col("id").cast("string").alias("completion"))
    return df.withColumn("ft_dataset", F.element_at(F.array(*map(F.lit, keys)), (F.col("k") + 1).cast("int"))).drop("k").repartition(5)


def counts(spark, folder):
    return {r["ft_dataset"]: r["count"] for r in sinks.read_results(spark, folder).groupBy("ft_dataset").count().collect()}


def test_a_key_is_written_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    folder, keys = str(tmp_path / "out"), ["a-1", "b-2", "c/3", "d 4"]
    move, done = sinks._move, []

    def broken(*args):
        if len(done) == 2:
            raise KeyboardInterrupt("the write is killed between two keys")
        done.append(move(*args))

    monkeypatch.setattr(sinks, "_move", broken)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_results_once(results(spark, keys), folder)
    monkeypatch.setattr(sinks, "_move", move)
    assert list(counts(spark, folder).values()) == [15, 15]  # the others' lines are hidden
    sinks.write_results_once(results(spark, keys), folder)
    assert counts(spark, folder) == dict.fromkeys(keys, 15)
    sinks.write_results_once(results(spark, [*keys, "e"]), folder)
    assert counts(spark, folder) == {**dict.fromkeys(keys, 15), "e": 12}


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, folder)
    for n in range(4):
        sinks.write_version(spark.range(n + 1), folder, n)
    assert sinks.read_version(spark, folder).count() == 4
    assert sorted(os.listdir(folder)) == ["version=2", "version=3"]
    # A version that is still being written is not read.
    spark.range(9).write.parquet(f"{folder}/version=4")
    os.remove(f"{folder}/version=4/_SUCCESS")
    assert sinks.read_version(spark, folder).count() == 4
    sinks.write_version(spark.range(6), folder, 4)
    assert sinks.read_version(spark, folder).count() == 6


@pytest.mark.parametrize("name", ["src_stream", "stream_prepare", "stream_metric_log"])
def test_a_stream_reads_a_table_kept_as_a_folder(spark, name, tmp_path):
    """One file or a folder of several files: the same rows."""
    for table in ("documents", "events"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    one, several = (QUERIES[name](spark, path) for path in (SF, str(tmp_path)))
    assert one.count() > 0 and one.exceptAll(several).count() == several.exceptAll(one).count() == 0


def test_a_run_folder_gets_more_files_with_more_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.range(60).crossJoin(docs).drop("id").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["src_jsonl_glob"](spark, str(tmp_path)).select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(found) > 4 and max(r["count"] for r in found) <= 2000 and sum(r["count"] for r in found) == 60 * docs.count()
