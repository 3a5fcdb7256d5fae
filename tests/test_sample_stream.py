"""Sample files whose header and data come in different micro-batches."""

import time

import pytest
from pyspark.sql import functions as F

from runlens.operators.extract import accepted, rejected
from runlens.operators.extract.dstat import extract_samples
from runlens.sources.files import number_lines, scan_lines
from runlens.sources.growing import growing_lines
from runlens.streaming.samples import run_samples

BANNER = '"Dstat 0.7.2 CSV output"\n"Host:","h",,,,"User:","u"\n\n'


@pytest.fixture
def step(spark, tmp_path):
    """Append texts to files, run the stream from its checkpoint, return what it has written so far."""
    logs = tmp_path / "logs"
    logs.mkdir()

    def run(**more):
        timeout = more.pop("timeout_ms", 3_600_000)
        for host, text in more.items():
            with open(logs / f"dstat-u-{host}.csv", "a") as f:
                f.write(text)
        lines = growing_lines(spark, str(logs), str(tmp_path / "notes"), split_bytes=40)
        run_samples(lines, str(tmp_path / "sink"), str(tmp_path / "state"), timeout, salts=3).awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "sink"))

    run.logs = logs
    return run


def samples(df):
    return sorted((r.file[-6:-4], r.record_key, r.name, r.v_double) for r in accepted(df).collect())


def test_headers_and_samples_of_different_batches(spark, step):
    """One file shows its header first, one in two parts, one after its samples; each run is a restart."""
    a = step(n1=BANNER + '"epoch","cpu",\n', n2="1.5,9\n", n3='"epoch","mem"\n"epoch","used"\n1.0,1\n')
    assert samples(a) == [("n3", 3, "dstat_mem:used", 1.0)]
    b = step(n1='"epoch","usr","sys"\n', n2='2.5,8\n"epoch","io"\n')
    assert samples(b) == samples(a)
    c = step(n1="".join(f"{i}.0,{i},{i + 1}\n" for i in range(1, 8)), n2='"epoch","read"\n3.5,7\n', n3="2.0,2\n")
    d = step(n1="9.0,x,1\n", n2="4.5,6\n")
    batch = number_lines(scan_lines(spark, str(step.logs))).withColumn("record_key", F.col("line_no")).select("file", "record_key", "value")
    want = extract_samples(batch)
    assert samples(d) == samples(want) and len(samples(c)) == 14 + 3 + 2
    reasons = lambda df: sorted((r.record_key, r.reject_reason) for r in rejected(df).collect())
    assert reasons(d) == reasons(want) == [(13, "not a number")]


def test_files_without_a_header_are_given_up(step):
    held = step(n1="1.5,1\n2.5,2\n", n2='"epoch","a"\n"epoch","b"\n1.5,1\n', timeout_ms=2_000)
    assert [r.file[-6:-4] for r in held.collect()] == ["n2"]
    time.sleep(3)
    late = step(n2="2.5,2\n", timeout_ms=2_000)
    assert sorted((r.file[-6:-4], r.record_key) for r in rejected(late).where("reject_reason = 'no header'").collect()) == [("n1", 1), ("n1", 2)]
    assert [x[:2] for x in samples(late)] == [("n2", 3), ("n2", 4)]
