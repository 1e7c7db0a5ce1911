"""Schemas of files and tables. Files list their columns in the order on disk."""

from __future__ import annotations

BOOK_FILE = "exchange string, symbol string, timestamp long, local_timestamp long, ask_amount double, ask_price double, bid_price double, bid_amount double"
TRADES_FILE = "exchange string, symbol string, timestamp long, local_timestamp long, id string, side string, price double, amount double"
BOOK_COLUMNS = ["timestamp", "local_timestamp", "ask_amount", "ask_price", "bid_price", "bid_amount"]
TRADE_COLUMNS = ["timestamp", "local_timestamp", "side", "amount"]
LEDGER = "run_utc string, git_sha string, phase string, symbol string, dates string, dataset string, bucket string, window string, variant string, metric string, value string, notes string"
WINDOWS = (
    "window long, beta double, t_nw double, r2_flow double, n long, r2_quad double, r2_ti double, r2_plc_p5 double, r2_plc_m5 double, "
    "depth_mean double, frac_spread_gt1 double, events long, block int, weekend int, day string"
)
MODELS = "fit_on array<string>, fee_bps double, main string, models map<string, map<string, array<double>>>"

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
#: Keys of one day's stream of one instrument.
STREAM = ["symbol", "day0"]
