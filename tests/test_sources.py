import gzip
import io
import json
import urllib.error
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tobflow import config as C
from tobflow.operators import quality
from tobflow.schema import DAY, SECOND
from tobflow.sources import ledger, market, reports

DAY0 = 19601 * DAY
HEAD = "exchange,symbol,timestamp,local_timestamp,ask_amount,ask_price,bid_price,bid_amount\n"


def write_gz(path: Path, text: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()))
    return str(path)


class Response(io.BytesIO):
    def __init__(self, body: bytes, size: int | None):
        super().__init__(body)
        self.headers = {} if size is None else {"Content-Length": str(size)}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def test_held_out_days(tmp_path, spark):
    with pytest.raises(C.HeldOutDateError):
        market.read_book(spark, str(tmp_path / "2026-05-01.csv.gz"))
    with C.unlocked():
        assert C.check_date("2026-05-01") == "2026-05-01"
    with pytest.raises(C.HeldOutDateError):
        C.check_date("2026-04-01")
    split = C.Split()
    assert (len(split.train), len(split.valid), len(split.test)) == (24, 7, 6)
    assert C.months_between("2023-09-02", "2023-12-01") == ["2023-10-01", "2023-11-01", "2023-12-01"]


def test_files_are_read_in_order_by_header(tmp_path, spark):
    good = write_gz(tmp_path / "a" / "2023-09-01.csv.gz", HEAD + f"e,X,{DAY0},{DAY0 + 1},1,100.5,100.0,2\ne,X,{DAY0},{DAY0 + 2},3,100.5,100.0,\n")
    rows = market.read_book(spark, good).orderBy("seq").collect()
    assert [r.local_timestamp - DAY0 for r in rows] == [1, 2] and rows[0].day0 == DAY0
    assert rows[0].bid_price == 100.0 and rows[0].ask_amount == 1.0 and rows[1].bid_amount is None
    swapped = write_gz(tmp_path / "b" / "2023-09-01.csv.gz", HEAD.replace("ask_price,bid_price", "bid_price,ask_price") + f"e,X,{DAY0},{DAY0},1,100.0,100.5,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        market.read_book(spark, swapped).collect()


def test_download_retries_and_checks(tmp_path):
    calls, naps = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise urllib.error.URLError("lost")
        return Response(b"abc", 5 if len(calls) == 2 else 3)

    path = market.download("u", tmp_path / "2023-09-01.csv.gz", opener, naps.append)
    assert path.read_bytes() == b"abc" and naps == [2.0, 4.0] and len(calls) == 3
    market.download("u", path, opener, naps.append)
    assert len(calls) == 3 and not list(tmp_path.glob("*.part"))

    def gone(url, timeout):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        market.download("u", tmp_path / "2023-10-01.csv.gz", gone, naps.append)
    with pytest.raises(urllib.error.URLError):
        market.download("u", tmp_path / "2023-11-01.csv.gz", lambda url, timeout: (_ for _ in ()).throw(urllib.error.URLError("x")), naps.append)


def test_listing_and_volumes(spark):
    pages = {"": "<IsTruncated>true</IsTruncated><Prefix>k/AUSDT/</Prefix><NextMarker>m</NextMarker>", "m": "<Prefix>k/BUSDT/</Prefix>"}
    found = market.listing("u?x", r"<Prefix>k/([^/<]+)/</Prefix>", lambda url, timeout: Response(pages[url.rpartition("=")[2]].encode(), None))
    assert found == ["AUSDT", "BUSDT"]
    lines = spark.createDataFrame([("A", "open_time,o,h,l,c,v,ct,qv"), ("A", "1,2,3,4,5,6,7,8.5"), ("B", "1,2")], "symbol string, line string")
    assert {r.symbol: r.quote_volume for r in market.quote_volume(lines).collect()} == {"A": 8.5, "B": None}


def test_quality_figures(spark):
    rows = [(0, 100.0, 1.0, 100.1, 1.0), (3, 100.0, 1.0, 100.1, 1.0), (2, 100.2, 1.0, 100.1, 1.0), (7199, None, 1.0, 100.2, 1.0), (7199, 100.0, 2.0, 100.3, 1.0), (7200, 100.05, 2.0, 100.2, 1.0)]
    df = spark.createDataFrame([("X", DAY0, i, DAY0 + s * SECOND, DAY0 + s * SECOND + (-1000 if i == 5 else 2000), az, ap, bp, bs) for i, (s, bp, bs, ap, az) in enumerate(rows)], "symbol string, day0 long, seq long, timestamp long, local_timestamp long, ask_amount double, ask_price double, bid_price double, bid_amount double")
    r = quality.quality_report(df, 0.1).first()
    assert (r.rows, r.rows_with_nan, r.ts_backwards, r.crossed_or_locked, r.off_grid_rows) == (6, 1, 1, 1, 1)
    assert r.duplicate_rows == 0 and r.max_gap_s == 7196.0 and r.frac_recv_delay_negative == pytest.approx(1 / 6)
    assert r.rows_per_hour == [3, 2, 1] + [0] * 21
    with pytest.raises(ValueError):
        quality.gate(quality.quality_report(df, 0.1))
    same = df.unionAll(df.where("seq = 5").withColumn("seq", F.lit(6).cast("long")))
    assert quality.quality_report(same, 0.1).first().duplicate_rows == 1


@pytest.mark.parametrize("prices, tick", [([100.1, 100.2, 100.7], 0.1), ([1.01, 1.02], 0.01), ([0.00105, 0.0011], 5e-5), ([10, 25], 5), ([7, 8], 1), ([100.1] * 99999 + [100.15], 0.1), ([3e-7, 4e-7], 1e-7)])
def test_tick_inference(spark, prices, tick):
    df = spark.createDataFrame([("X", float(p)) for p in prices], "symbol string, price double")
    assert quality.infer_tick(df).first().tick == pytest.approx(tick)


def test_ledger(tmp_path, spark):
    path = str(tmp_path / "ledger")
    ledger.log_trials(spark, path, {"phase": "1", "value": 0.5}, {"phase": "2"})
    ledger.log_trials(spark, path, {"phase": "3"})
    assert sorted(r.phase for r in ledger.read_ledger(spark, path).collect()) == ["1", "2", "3"]
    with pytest.raises(KeyError):
        ledger.log_trials(spark, path, {"nothing": 1})


def test_reports_round_trip(tmp_path, spark):
    df = spark.createDataFrame([("a|b", 0.123456), ("c", 2.0)], "name string, value double")
    text = reports.sections("Top", {"One": reports.markdown_table(df) + "\n\n| x |\n|---|\n| 9 |", "Empty": "| a |\n|---|"})
    one = [{"name": "a|b", "value": "0.1235"}, {"name": "c", "value": "2.0000"}]
    assert reports.markdown_tables(text) == {"One": [one, [{"x": "9"}]], "Empty": [[]]}
    assert [tuple(r) for r in reports.typed(spark, one, "name string, value double").collect()] == [("a|b", 0.1235), ("c", 2.0)]
    ci = reports.typed(spark, [{"ci": "[-0.5000, 1.2500]", "ok": "true"}, {"ci": "", "ok": "false"}], "ci struct<lo:double,hi:double>, ok boolean").collect()
    assert (tuple(ci[0].ci), ci[1].ci, ci[0].ok, ci[1].ok) == ((-0.5, 1.25), None, True, False)
    assert reports.numbers("0.744 [−0.346, 1.057]") == [0.744, -0.346, 1.057]
    models = spark.createDataFrame([("X", "flow", 100.0, 0.5, 1.5), ("X", "flow_over_depth", 0.0, 0.1, -2.0)], "symbol string, model string, latency_ms double, a double, b double")
    reports.write_models(models, tmp_path / "m.json", ["2023-09-01"], 5.0, "flow_L100")
    assert json.loads((tmp_path / "m.json").read_text())["models"]["X"]["flow_L100"] == [0.5, 1.5]
    assert sorted(map(tuple, reports.read_models(spark, str(tmp_path / "m.json")).collect())) == sorted(map(tuple, models.collect()))
    reports.write_explorer({"x": [1.23456789, float("nan")], "n": 3}, tmp_path / "d.js")
    assert reports.read_explorer((tmp_path / "d.js").read_text()) == {"x": [1.2346, 0.0], "n": 3}
