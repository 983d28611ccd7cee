import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from conftest import endpoints_of, nodes_of, obj, rows, typ

from driftspark.model import PAYLOADS_DDL
from driftspark.operators import diff, infer, merge
from driftspark.model import Contract
from driftspark.session import settle
from driftspark.streaming.debounce import LateRows, debounce, debounce_hot_stream, debounce_stream
from driftspark.streaming.drift import DriftCheck

EPOCH = dt.datetime(2024, 1, 1)


def at(ms):
    return EPOCH + dt.timedelta(milliseconds=ms)


def brute_sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] < gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return [tuple(s) for s in out]


@pytest.mark.parametrize("chunk", [1, 3, 100_000])
def test_debounce_matches_brute_force(spark, chunk):
    import random

    rng = random.Random(3)
    data = {k: sorted(rng.randrange(0, 40_000) for _ in range(n)) for k, n in (("hot", 400), ("cold", 15), ("one", 1))}
    data["steady"] = list(range(0, 30_000, 149))
    data["edge"] = [0, 150, 299, 449, 600]
    df = spark.createDataFrame([(k, at(t)) for k, ts in data.items() for t in ts], "k string, ts timestamp")
    base = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    expected = sorted((k, base + a * 1000, base + b * 1000, n) for k, ts in data.items() for a, b, n in brute_sessions(ts, 150))
    assert sorted(tuple(r) for r in debounce(df, ["k"], "ts", 150_000, chunk).collect()) == expected


def write_batch(spark, folder, data, ddl):
    spark.createDataFrame(data, ddl).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    ddl = "k string, ts timestamp_ntz"
    first = [("a", at(t)) for t in (0, 100, 220, 371, 5000)] + [("b", at(10)), ("a", at(2_000_000))]
    write_batch(spark, src, first, ddl)

    def run():
        stream = spark.readStream.schema(ddl).parquet(src)
        query = debounce_stream(stream, ["k"], "ts").writeStream.outputMode("append").format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return query

    run()
    write_batch(spark, src, [("a", at(1)), ("a", at(2_000_010))], ddl)
    run()
    found = rows(spark.read.parquet(out), "k", "first", "last", "due", "events")
    assert found == sorted([
        ("a", at(0), at(220), at(370), 3), ("a", at(371), at(371), at(521), 1), ("a", at(5000), at(5000), at(5150), 1), ("b", at(10), at(10), at(160), 1),
    ], key=repr)


def test_late_rows_are_counted_in_a_table(spark, tmp_path):
    ddl = "k string, ts timestamp"
    batches = [[("a", at(600_000))], [("a", at(0)), ("a", at(500)), ("b", at(9_000_000)), ("a", None)], [("a", at(8_399_999)), ("a", at(8_400_000))], []]
    late = LateRows(spark, str(tmp_path / "late"), "ts", 600_000_000)
    for _ in range(2):
        for i, batch in enumerate(batches):
            late.process(spark.createDataFrame(batch, ddl), i)
            late.process(spark.createDataFrame(batch, ddl), i)
    base = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert rows(late.table(), "batch", "rows", "late", "watermark") == sorted(
        [(0, 1, 0, None), (1, 4, 0, base), (2, 2, 1, base + 8_400_000_000), (3, 0, 0, base + 8_400_000_000)], key=repr)


def test_reads_of_a_batch_are_bounded(spark, check):
    check.compact_every = 2
    for i in range(5):
        check.process(spark.createDataFrame(BATCHES[i % 3], PAYLOADS_DDL), i)
        assert len({f.rsplit("/", 2)[1] for f in check.baseline(i + 1).inputFiles()}) <= 2
    assert rows(check.reports().where("batch = 1"), "breaking", "non_breaking", "failed") == [(2, 0, True)]


def payload(minute, path, body, method="GET", kind="application/json"):
    return (EPOCH + dt.timedelta(minutes=minute), "o", "a", method, path, 200, kind, body if isinstance(body, str) else json.dumps(body))


BATCHES = [
    [payload(0, "/x", {"a": 1, "n": "s"}), payload(1, "/x", {"a": 2}), payload(1, "/y", {"p": 1}), payload(1, "/other", {"q": 1}), payload(2, "/x", {"zz": 1}, "POST")],
    [payload(5, "/x", {"a": 1}), payload(6, "/x", "{broken"), payload(6, "/x", "<p>", kind="text/html")],
    [payload(9, "/y", {"p": "now text"})],
]


@pytest.fixture()
def check(spark, tmp_path):
    endpoints = endpoints_of(spark, [("GET", "/x", [200], None), ("GET", "/y", [200], None), ("POST", "/x", [200], None)])
    baseline = nodes_of(spark, {("GET", "/x", "response"): obj({"a": typ("integer"), "st": typ("string")}), ("GET", "/y", "response"): typ("unknown")})
    return DriftCheck(spark, str(tmp_path / "state"), endpoints).start_from(baseline)


def test_batches_follow_the_baseline_and_can_run_again(spark, check):
    for _ in range(2):
        for i, batch in enumerate(BATCHES):
            df = spark.createDataFrame(batch, PAYLOADS_DDL)
            check.process(df, i)
            if i != 1:
                check.process(df, i)
        found = rows(check.changes(), "batch", "path", "change_type", "message")
        assert found == [
            (0, "/x", "non-breaking", 'Field "response.n" was added'), (0, "/y", "non-breaking", 'Field "response.p" was added'),
            (1, "/x", "breaking", 'Field "response.n" was removed'), (1, "/x", "breaking", 'Field "response.st" was removed'),
        ]
        now = check.baseline(3).where("size(node_path) = 1")
        assert rows(now, "path", "name", "type", "source") == [("/x", "a", "integer", None), ("/y", "p", "integer", "sampled")]


def test_stream_of_one_batch_equals_the_batch_operators(spark, check, tmp_path):
    src = str(tmp_path / "src")
    write_batch(spark, src, BATCHES[0], PAYLOADS_DDL)
    check.run(spark.readStream.schema(PAYLOADS_DDL).parquet(src), str(tmp_path / "ck")).awaitTermination()
    before = check.baseline(before=0)
    reads = spark.read.parquet(src).where("method = 'GET' and path in ('/x', '/y')")
    after = settle(merge.apply_samples(before, infer.observed_nodes(settle(infer.observed_types(reads), "t"))), "a")
    expected = diff.field_changes(Contract(check.endpoints, before), Contract(check.endpoints, after))
    assert rows(check.changes().drop("batch")) == rows(expected)
    keep = ["path", "node_path", "type", "source"]
    assert rows(check.baseline(1), *keep) == rows(after, *keep)


def test_hot_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(5)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    ddl, minute = "k string, ts timestamp_ntz", 60_000
    data = [("hot", at(rng.randrange(0, 600 * minute))) for _ in range(500)] + [("b", at(i * 7 * minute)) for i in range(60)]
    # Gaps of exactly the quiet time and just below it, and rows on the edges of buckets.
    data += [("edge", at(ms)) for ms in (0, 5 * minute - 1, 10 * minute - 1, 15 * minute - 2, 20 * minute, 25 * minute, 599 * minute)]
    # Gaps of the quiet time and one microsecond less, inside a bucket run and over the edges of batches.
    for key, gap in (("just", 300_000_000), ("below", 299_999_999)):
        data += [(key, EPOCH + dt.timedelta(microseconds=i * gap)) for i in range(100)]
    data.sort(key=lambda r: r[1])
    for part in range(4):
        write_batch(spark, src, data[part * len(data) // 4 : (part + 1) * len(data) // 4], ddl)
        stream = spark.readStream.schema(ddl).parquet(src)
        bursts = debounce_hot_stream(stream, ["k"], "ts", 5 * minute * 1000)
        bursts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
    batch = debounce(spark.createDataFrame(data, ddl), ["k"], "ts", 5 * minute * 1000)
    base = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    newest = base + int((data[-1][1] - EPOCH).total_seconds() * 1000) * 1000
    closed = batch.where(F.col("last") + 2 * 5 * minute * 1000 <= newest - 600_000_000)
    got = spark.read.schema("k string, first bigint, last bigint, events bigint").parquet(out)
    assert rows(got) == rows(closed.select("k", "first", "last", "events")) and got.count() > 20
