from runlens.operators.extract import accepted, registered
from runlens.streaming.extract import line_stream, run_extraction


def test_only_new_files_are_read(spark, tmp_path):
    logs, sink, state = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "state")
    logs.mkdir()

    def run(name, number):
        (logs / name).write_text(f"2019-02-03 04:05:06,000\tMap({number}/4) switched to RUNNING \nnoise\n")
        run_extraction(line_stream(spark, str(logs)), registered()["flink_tasks"], sink, state).awaitTermination()
        return sorted(r.task_instance for r in accepted(spark.read.parquet(sink)).collect())

    assert run("flink-u-jobmanager-a.log", 1) == [1]
    assert run("flink-u-jobmanager-b.log", 2) == [1, 2]


def test_batches_with_headers(spark, tmp_path):
    logs, sink, state = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "state")
    logs.mkdir()
    for host in ("n1", "n2"):
        (logs / f"dstat-u-{host}.csv").write_text(f'"epoch","cpu"\n"epoch","{host}"\n1.5,2\n')
    stream = line_stream(spark, str(logs), max_files=1)
    run_extraction(stream, registered()["dstat"], sink, state, per_batch=True).awaitTermination()
    got = sorted((r.host, r.name, r.v_double) for r in accepted(spark.read.parquet(sink)).collect())
    assert got == [("n1", "dstat_cpu:n1", 2.0), ("n2", "dstat_cpu:n2", 2.0)]
