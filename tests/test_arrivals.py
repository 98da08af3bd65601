"""Late rows are marked frame by frame (X4), and what rows hold comes out as it went in."""

import datetime
import decimal
import math
import time

import pandas as pd
from pyspark.sql import Row

from rubric.session import scratch_path
from rubric.streaming import streams as X

MICROS = 1_700_000_000_000_000
KINDS = ("sample_id long, gen_idx int, completion string, answer string, ts timestamp, a tinyint, b smallint, c float, d double, e boolean, "
         "f date, g decimal(38,10), h binary, note string")


def _at(*parts):
    return datetime.datetime(*parts)


class _Timer:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_frames_are_marked_as_rows_are():
    micros = [None, 0, MICROS - 1, MICROS, MICROS + 1, MICROS + 2, -62_000_000_000_000_000, 250_000_000_000_000_000]
    for mark in (0, MICROS // 1000):
        rows = X._Arrivals(["x", "_micros"]).handleInputRows((0,), [Row(x=str(m), _micros=m) for m in micros], _Timer(mark))
        old = [(r.x, r._late, r._at) for r in rows]
        frame = pd.DataFrame({"x": map(str, micros), "time": [X._NO_TIME if m is None else m for m in micros], "_deal": 0})
        made = list(X._ArrivalFrames(["x"]).handleInputRows((0,), iter([frame, frame[:0], frame]), _Timer(mark)))
        assert [len(m) for m in made] == [len(frame), 0, len(frame)]  # a frame for a frame, not a call for each row
        for m in (made[0], made[2]):
            assert list(m.columns) == ["x", "_late", "_at"]
            assert [(x, late, at.to_pydatetime()) for x, late, at in m.itertuples(index=False)] == old


def _stream(spark, schema, *batches):
    src = scratch_path(spark, "arrivals-src")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # distinct modification times keep the file order
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def _known(r):
    return [("nan" if isinstance(x, float) and math.isnan(x) else str(x) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x)
            for x in r]


def test_all_kinds_of_values_come_out_as_they_went_in(spark):
    text, day = "<answer>yes</answer>", datetime.date
    big = (1 << 53) + 1  # no double
    full = [(big, 0, text, "yes", _at(2024, 1, 5), 127, -32768, 0.1, 0.1, True, day(1, 1, 1), decimal.Decimal("-1234567890123456789.0123456789"),
             b"\x00\xff,", "a,b"),
            (-(1 << 63), 1, text, "no", _at(2024, 1, 5, 0, 0, 0, 1), -128, 0, float("nan"), -0.0, False, day(9999, 12, 31), decimal.Decimal("1E-10"), b"", ""),
            (big + 1, 2, "", "yes", _at(2024, 1, 5, 1), 1, 1, float("inf"), 5e-324, None, None, decimal.Decimal(0), None, " \n\x00"),
            (None, None, None, None, None, *[None] * 9),
            (3, 3, text, None, None, 0, 0, float("-inf"), 1.7976931348623157e308, True, day(2024, 2, 29), decimal.Decimal(1), b"\n", "null")]
    late = [(7, None, text, "yes", _at(1970, 1, 2), None, 2, None, float("nan"), None, None, None, b"z", None)]
    after = [(8, 0, text, "yes", _at(2024, 1, 6), *[None] * 9)]
    sink = scratch_path(spark, "arrivals-sink")
    stream = _stream(spark, KINDS, full, late, after, full[:1])
    assert X.run_to_end(X.dedup_score_stream(stream, sink)) == 1
    names = [f.split()[0] for f in KINDS.split(", ")]

    def as_rows(df):
        return sorted((_known(r) for r in df.select(*names).collect()), key=repr)

    assert as_rows(X.scored_rows(spark, sink)) == as_rows(spark.createDataFrame(full + after, KINDS))
    assert as_rows(X.rejected_rows(spark, sink)) == as_rows(spark.createDataFrame(late, KINDS))
    assert {r.is_correct for r in X.rejected_rows(spark, sink).collect()} == {None}


def test_other_kinds_go_row_by_row(spark):
    schema = "sample_id long, gen_idx int, completion string, answer string, ts timestamp, tags array<long>, seen timestamp"
    first = [(1, 0, "<answer>yes</answer>", "yes", _at(2024, 1, 5), [1, None, (1 << 53) + 1], _at(2024, 1, 5)),
             (2, 0, "<answer>no</answer>", "yes", None, None, None)]
    late = [(4, 0, "", "yes", _at(2024, 1, 1), [], None)]
    sink = scratch_path(spark, "arrivals-sink")
    assert X.run_to_end(X.dedup_score_stream(_stream(spark, schema, first, late, first[:1]), sink)) == 1
    got = X.scored_rows(spark, sink).select("sample_id", "tags", "seen", "is_correct").collect()
    assert sorted(tuple(r) for r in got) == [(1, [1, None, (1 << 53) + 1], _at(2024, 1, 5), 1), (2, None, None, 0)]
    assert [r.sample_id for r in X.rejected_rows(spark, sink).collect()] == [4]
