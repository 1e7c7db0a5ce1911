"""The steps end to end, over a server that stands in for the archive."""

import gzip
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tobflow import cli
from tobflow import config as C
from tobflow.plans import explorer, ingest, study
from tobflow.schema import DAY, SECOND
from tobflow.sources import ledger, market, reports

BOOK_HEAD = "exchange,symbol,timestamp,local_timestamp,ask_amount,ask_price,bid_price,bid_amount\n"
TRADE_HEAD = "exchange,symbol,timestamp,local_timestamp,id,side,price,amount\n"


def micros(date):
    return int(np.datetime64(date, "us").astype("int64"))


def book_file(date, symbol, seed, n=4000):
    """A day of updates on a 0.1 tick; the first is 1 ms before midnight."""
    rng, day0 = np.random.default_rng(seed), micros(date)
    t = np.sort(rng.integers(0, DAY, n)) + day0
    t[0] = day0 - 1000
    bid = np.round(100 + np.cumsum(rng.integers(-1, 2, n)) * 0.1, 1)
    lines = [f"e,{symbol},{a},{a + 3000},{x},{b + 0.1 * s:.1f},{b:.1f},{y}" for a, b, s, x, y in zip(t, bid, rng.integers(1, 3, n), rng.integers(1, 50, n), rng.integers(1, 50, n))]
    return gzip.compress((BOOK_HEAD + "\n".join(lines) + "\n").encode())


def trades_file(date, symbol, seed, n=2000):
    rng, day0 = np.random.default_rng(seed), micros(date)
    rows = zip(np.sort(rng.integers(0, DAY, n)) + day0, rng.choice(["buy", "sell", "unknown"], n), rng.integers(1, 9, n))
    return gzip.compress((TRADE_HEAD + "\n".join(f"e,{symbol},{a},{a + 3000},{i},{s},100,{x}" for i, (a, s, x) in enumerate(rows)) + "\n").encode())


@pytest.fixture
def archive(monkeypatch):
    """path -> body; asked lists the paths that were asked for."""
    bodies, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = bodies.get(self.path)
            self.send_response(404 if body is None else 200)
            self.send_header("Content-Length", str(len(body or b"")))
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setenv("TOBFLOW_ARCHIVE_URL", root + "/{dataset}/{y}/{m}/{d}/{symbol}")
    monkeypatch.setenv("TOBFLOW_CANDLE_URL", root + "/candles/{symbol}/{y}-{m}-{d}")
    monkeypatch.setenv("TOBFLOW_LISTING_URL", root + "/listing?x=1")
    yield bodies, asked
    server.shutdown()


@pytest.fixture
def project(tmp_path, monkeypatch):
    monkeypatch.setenv("TOBFLOW_PROJECT_DIR", str(tmp_path))
    monkeypatch.delenv("TOBFLOW_DATA_DIR", raising=False)
    return tmp_path


def put(bodies, date, symbol, seed, datasets=("book_ticker", "trades")):
    for d in datasets:
        bodies[f"/{d}/{date.replace('-', '/')}/{symbol}"] = trades_file(date, symbol, seed) if d == "trades" else book_file(date, symbol, seed)


def test_help_version_and_refusals(capsys, project, archive):
    assert cli.main([]) == 0
    text = capsys.readouterr().out
    assert all(name in text for name, *_ in cli.STEPS)
    with pytest.raises(SystemExit) as done:
        cli.main(["--version"])
    assert done.value.code == 0 and "tobflow" in capsys.readouterr().out
    with pytest.raises(C.HeldOutDateError):
        cli.main(["buckets", "--dates", "2026-05-01"])
    assert not archive[1]
    with pytest.raises(SystemExit, match="--final"):
        cli.main(["final-test"])


def test_buckets_windows_frames(spark, project, archive, capsys):
    bodies, asked = archive
    dates = ["2023-09-01", "2023-10-01"]
    for seed, date in enumerate(dates):
        put(bodies, date, "BTCUSDT", seed)
    with pytest.raises(SystemExit, match="buckets --symbol BTCUSDT"):
        cli.main(["windows"])
    assert cli.main(["buckets", "--dates", *dates, "2023-11-01"]) == 0
    said = capsys.readouterr()
    assert "MISSING BTCUSDT 2023-11-01" in said.err and "tick=0.1" in said.out
    paths = C.Paths()
    grid = market.read_days(spark, paths.buckets(), "BTCUSDT", dates)
    assert grid.count() == 2 * 86400 and set(grid.columns) >= {"t", "flow", "dmid_ticks", "depth", "spread_ticks", "n_events", "mid", "ti"}
    with pytest.raises(FileNotFoundError, match="2023-12-01"):
        market.read_days(spark, paths.buckets(), "BTCUSDT", [*dates, "2023-12-01"])

    # the report, partly observed while the grid was written, is that of one batch
    found = reports.read_quality((paths.reports() / "quality" / "book_ticker_BTCUSDT_2023-09-01.md").read_text())
    book = market.read_book(spark, str(paths.raw("book_ticker", "BTCUSDT", "2023-09-01")))
    from tobflow.operators.quality import quality_report

    whole = quality_report(book, 0.1).first().asDict()
    assert {k: found[k] for k in whole if found.get(k) is not None} == {k: v for k, v in whole.items() if v is not None}
    assert found["tick"] == 0.1 and found["frac_empty_1s_buckets"] > 0.9 and found["max_gap_s"] > 1

    # a second run asks for nothing and reads no raw file
    for d in dates:
        paths.raw("book_ticker", "BTCUSDT", d).write_bytes(b"broken")
    n = len(asked)
    assert cli.main(["buckets", "--dates", *dates]) == 0 and len(asked) == n
    assert capsys.readouterr().out.count("exists, skipping") == 2

    assert cli.main(["windows", "--boot", "20"]) == 0
    rows = ledger.read_ledger(spark, paths.ledger())
    assert rows.count() == 18 and {r.symbol for r in rows.select("symbol").distinct().collect()} == {"BTCUSDT"}
    typed = {r.spec: r for r in explorer.summary(spark, paths, "BTCUSDT").collect()}
    assert list(typed) == [s[0] for s in C.SPECS] and typed["main 10s/30min"].days == 2
    assert {typed["main 10s/30min"][h] for h in ("h1", "h2", "h3", "h4")} <= {"PASS", "FAIL"}
    panel = explorer.windows(spark, paths, "BTCUSDT")
    logged = {r.metric: float(r.value) for r in rows.where("bucket = '10s'").collect()}
    assert panel.count() == typed["main 10s/30min"].windows and logged["r2_flow_median"] == pytest.approx(panel.agg(F.median("r2_flow")).first()[0], abs=1e-6)

    for d, seed in zip(dates, (0, 1)):
        paths.raw("book_ticker", "BTCUSDT", d).write_bytes(book_file(d, "BTCUSDT", seed))
    assert cli.main(["frames", "--symbols", "BTCUSDT", "--dates", dates[0]]) == 0
    frame = market.read_days(spark, paths.frames(), "BTCUSDT", dates[:1])
    assert frame.count() > 1000 and frame.where("tgt_start_0 < feat_end").count() == 0
    modified = sorted(frame.inputFiles())
    assert cli.main(["frames", "--symbols", "BTCUSDT", "--dates", dates[0]]) == 0
    assert sorted(market.read_days(spark, paths.frames(), "BTCUSDT", dates[:1]).inputFiles()) == modified
    capsys.readouterr()
    assert cli.main(["figures", "--symbols", "BTCUSDT"]) == 0
    drawn = reports.read_explorer((project / "site" / "figures.js").read_text())["BTCUSDT"]
    assert len(drawn["depth_curve"]) == 50 and 0 <= drawn["explain_or_predict"]["same_interval"] <= 1
    assert len(drawn["example"]) >= 30 and len(drawn["r2_over_time"]) == 2
    capsys.readouterr()
    assert cli.main(["status", "--symbols", "BTCUSDT"]) == 0
    status = json.loads(capsys.readouterr().out)
    assert status["symbols"]["BTCUSDT"] == {"grids": 2, "frames": 1, "report": True} and status["ledger_rows"] == 18 and not status["held_out_used"]


def frames(spark, paths, symbols, days, seed=0):
    """Prediction frames in which flow predicts a little."""
    rng, rows = np.random.default_rng(seed), []
    for symbol in symbols:
        for day in days:
            day0 = micros(day)
            for i, (x, e) in enumerate(rng.normal(size=(60, 2))):
                y = round(0.5 * x + e, 3)
                rows.append((symbol, day0, day0 + (i + 1) * 10 * SECOND, 0.1, float(x), float(rng.normal()), float(e), 2.0, *(3 * [float(y), 100.0, 0.5])))
    names = [f"{c}_{lat}" for lat in C.LATENCIES_MS for c in ("y", "mid_entry", "half_spread_bps")]
    schema = "symbol string, day0 long, t long, tick double, x double, ti_lag double, ar_lag double, depth_t double, " + ", ".join(f"{n} double" for n in names)
    market.write_days(spark.createDataFrame(rows, schema), paths.frames())


def test_models_final_test_and_site(spark, project, monkeypatch, capsys):
    symbols = ["AUSDT", "BUSDT"]
    split = C.Split(train=C.months_between("2023-09-01", "2024-09-01"), valid=C.months_between("2024-10-01", "2024-12-01"), test=["2026-04-01", "2026-05-01"])
    monkeypatch.setattr(C, "Split", lambda: split)
    paths = C.Paths()
    with pytest.raises(SystemExit, match="step before"):
        frames(spark, paths, symbols, split.train[:1], 5)
        cli.main(["models", "--symbols", *symbols])
    frames(spark, paths, symbols, [*split.train[1:], *split.valid, *split.test])
    assert cli.main(["models", "--symbols", *symbols, "--boot", "50"]) == 0
    frozen = json.loads(paths.models().read_text())
    assert frozen["fit_on"] == split.train and set(frozen["models"]) == set(symbols) and len(frozen["models"]["AUSDT"]) == 12
    logged = ledger.read_ledger(spark, paths.ledger())
    assert logged.count() == 2 * 4 and logged.where("metric = 'pooled_oos_r2'").count() == 2
    text = (paths.reports() / "models_AUSDT.md").read_text()
    outside = explorer.validation(spark, paths, "AUSDT").where("model = 'flow' AND latency_ms = 100").first()
    # by hand
    def long(days):
        rows = market.read_days(spark, paths.frames(), "AUSDT", days).orderBy("t").toPandas()
        return rows["x"].to_numpy(), rows["y_100"].to_numpy(), rows["day"].astype(str).to_numpy()

    x, y, _ = long(split.train)
    b, a = np.polyfit(x, y, 1)
    assert frozen["models"]["AUSDT"]["flow_L100"] == pytest.approx([a, b])
    vx, vy, vday = long(split.valid)
    sse, sst = ([np.sum(q[vday == d]) for d in split.valid] for q in ((vy - a - b * vx) ** 2, vy**2))
    assert outside.oos_r2 == pytest.approx(1 - sum(sse) / sum(sst), abs=1e-4)
    rng = np.random.default_rng(C.BOOTSTRAP_SEED)
    draws = [1 - np.take(sse, pick).sum() / np.take(sst, pick).sum() for pick in (rng.integers(0, 3, 3) for _ in range(50))]
    assert list(outside.oos_r2_ci) == pytest.approx(np.quantile(draws, [0.025, 0.975]), abs=1e-4)
    assert "Walk-forward" in text and "oos_r2_ci" in text

    assert cli.main(["final-test", "--final", "--symbols", *symbols]) == 0
    assert ledger.read_ledger(spark, paths.ledger()).count() == 8 + 6
    assert explorer.held_out(spark, paths, "BUSDT").where("model = 'flow'").first().verdict == "PASS"
    with pytest.raises(FileExistsError):
        cli.main(["final-test", "--final", "--symbols", *symbols])
    assert cli.main(["site", "--symbols", *symbols]) == 0
    one = (project / "site" / "data.js").read_text()
    assert cli.main(["site", "--symbols", *symbols]) == 0 and (project / "site" / "data.js").read_text() == one
    data = reports.read_explorer(one)
    assert set(data["predictive"]["AUSDT"]) == {"held_out", "validation", "walk_forward"} and data["fee_bps"] == 5.0 and data["explore"] == {}
    capsys.readouterr()


def test_pilot(spark, project, archive, monkeypatch):
    bodies, _ = archive
    monkeypatch.setattr(study, "PILOT_RUNS", {"book_ticker": ["2023-09-01", "2024-09-01"], "quotes": ["2024-09-01"]})
    put(bodies, "2023-09-01", "BTCUSDT", 1, ("book_ticker",))
    put(bodies, "2024-09-01", "BTCUSDT", 2, ("book_ticker", "quotes"))
    assert cli.main(["pilot"]) == 0
    paths = C.Paths()
    rows = reports.markdown_tables((paths.reports() / "pilot.md").read_text())["Windows of 30 minutes, buckets of 10 s"][0]
    assert [(r["dataset"], r["day"]) for r in rows] == [("book_ticker", "2023-09-01"), ("book_ticker", "2024-09-01"), ("book_ticker", "pooled"), ("quotes", "2024-09-01")]
    assert int(rows[2]["windows"]) == int(rows[0]["windows"]) + int(rows[1]["windows"])
    assert ledger.read_ledger(spark, paths.ledger()).count() == 3 * 4 + 1
    quality = reports.read_quality((paths.reports() / "quality" / "pilot" / "quotes_BTCUSDT_2024-09-01.md").read_text())
    assert (quality["buckets"], quality["inferred_tick"]) == (8640, 0.1) and quality["buckets_dropped_funding"] == 72
    before = (paths.reports() / "pilot.md").read_text()
    assert cli.main(["pilot"]) == 0 and (paths.reports() / "pilot.md").read_text() == before


def zipped(line):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("candle.csv", line)
    return out.getvalue()


def test_select_symbol(spark, project, archive):
    bodies, asked = archive
    day = study.SELECTION_DAY
    listed = ["AUSDT", "BUSDT", "BTCUSDT", "CUSDT", "XEUR", "DUSDT"]
    bodies["/listing?x=1&marker="] = "".join(f"<Prefix>data/futures/um/daily/klines/{s}/</Prefix>" for s in listed).encode()
    for s, volume, head in (("AUSDT", 5e6, "open_time,o,h,l,c,v,ct,qv\n"), ("BUSDT", 9e6, ""), ("DUSDT", 7e6, "")):
        bodies[f"/candles/{s}/{day}"] = zipped(f"{head}1,2,3,4,5,6,7,{volume}\n")
        if s != "DUSDT":
            put(bodies, day, s, ord(s[0]), ("book_ticker",))
    text = study.select_symbol(spark, C.Paths())
    assert "3 traded and 4 listed" in text and "Selected: **none**" in text  # fewer updates than one a second
    rows = {r.symbol: r for r in explorer.selection(spark, C.Paths()).collect()}
    assert set(rows) == {"AUSDT", "BUSDT"} and rows["BUSDT"].quote_volume_musd == 9.0 and not rows["AUSDT"].eligible
    assert rows["AUSDT"].median_updates_per_s == 0.0 and rows["AUSDT"].rows == 3999 and rows["AUSDT"].tick == 0.1
    assert not [p for p in asked if "BTCUSDT" in p or "XEUR" in p]


def test_a_day_off_its_tick_and_an_empty_file_are_refused(spark, project, archive):
    bodies, _ = archive
    put(bodies, "2023-09-01", "BTCUSDT", 3)
    paths = C.Paths()
    ingest.raw_days(spark, [("BTCUSDT", "2023-09-01")], paths)
    book = market.read_book(spark, str(paths.raw("book_ticker", "BTCUSDT", "2023-09-01")))
    with pytest.raises(ValueError, match="off-grid"):
        ingest.values(book, book.select("symbol", "day0").distinct().withColumn("tick", F.lit(1.0)))
    with pytest.raises(ValueError, match="no rows"):
        ingest.values(book.limit(0))


def test_sizes():
    assert [study.human_size(n) for n in (5, 1536, 3 * 1024**2, 2.5 * 1024**3)] == ["5 B", "1.5 KB", "3.0 MB", "2.5 GB"]
