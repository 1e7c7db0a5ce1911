"""Benchmark decontamination by template windows, with DataFrame functions only.

Numbers, units and names become typed slots, so a question keeps its template when its parameters change.
Windows of template tokens are hashed and joined to the benchmark's windows; matches of one alignment are
gathered, and an alignment counts only if its slots are consistent: a benchmark value always has the same
value in the document. Items without a telling window (too short, or slots only) are looked for whole, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import BROADCAST_BYTES, documents, keyed, table

#: Unit words that may follow a number.
UNITS = "km/h|mph|kg|mg|km|cm|mm|ml|kb|mb|gb|ms|hours?|hrs?|minutes?|mins?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|feet|foot|inches|grams?|kilograms?|kilometers?|kilometres?|pounds?|lbs?|liters?|litres?|dollars?|euros?|cents?|percent|degrees?|g|m|s|l"
#: Private-use marks: a sentence's first word, number, name and unit.
START, NUMBER, NAME, UNIT = "", "", "", ""
#: (pattern, replacement), applied in order; the last makes a template of a marked text.
MARKS = (
    (r"(\p{Nd})[.,](\p{Nd})", "$1$2"),
    (r"[.!?:][^\p{L}\p{Nd}\s]*\s+|\s*\n\s*", f" {START}"),
    (r" (\p{Lu}\p{Ll}+)", f" {NAME}$1"),
    (rf"(\p{{Nd}}+)\s?(?:((?i:{UNITS}))\b)?", f" {NUMBER}$1 {UNIT}$2 "),
)
STRIP = (rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NUMBER}-{UNIT}]+", " ")
TEMPLATE = (rf"([{NUMBER}-{UNIT}])[^ ]*", "$1")
PLAIN = ((f"[{START}-{UNIT}]", ""), (" +", " "))


def marked(text: Column) -> Column:
    """Lower-cased words of a text, single-spaced, with the values of numbers, units and names behind their marks."""
    for pattern, to in MARKS:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(F.regexp_replace(F.lower(text), *STRIP))


def tokens(text: Column) -> Column:
    """Words of a marked text; an empty one has one empty word."""
    return F.split(text, " ")


def plain_words(text: Column) -> Column:
    """Words of a marked text without their marks."""
    for pattern, to in PLAIN:
        text = F.regexp_replace(text, pattern, to)
    return tokens(F.trim(text))


def window_hashes(hashes: Column, size: int) -> Column:
    """Hash of each run of ``size`` hashed words, in order; none where there are fewer."""
    places = F.sequence(F.lit(0), F.size(hashes) - size)
    windows = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    return F.when(F.size(hashes) >= size, windows).otherwise(F.array().cast("array<bigint>"))


def _template_tokens(text: Column) -> Column:
    return tokens(F.regexp_replace(text, *TEMPLATE))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, size: int, literals: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items: item_id, item_words, item_windows; windows: item_id, at, hash of those with enough literal words; items without any)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), marked(F.coalesce(F.col("text"), F.lit(""))).alias("m")).where("item_id IS NOT NULL").distinct()
    items = items.select("item_id", tokens(F.col("m")).alias("item_words"), _template_tokens(F.col("m")).alias("t"), plain_words(F.col("m")).alias("plain"))
    n_literal = lambda i: F.size(F.filter(F.slice("t", i + 1, size), lambda w: ~w.rlike(f"^[{NUMBER}-{UNIT}]")))
    places = F.when(F.size("t") >= size, F.filter(F.sequence(F.lit(0), F.size("t") - size), lambda i: n_literal(i) >= literals)).otherwise(F.array().cast("array<int>"))
    items = items.withColumn("hashes", window_hashes(_hashed(F.col("t")), size)).withColumn("places", places)
    whole = items.where((F.size("places") == 0) & (F.array_join("plain", "") != "")).select("item_id", F.col("plain").alias("item_words"))
    items = items.where(F.size("places") > 0)
    windows = items.select("item_id", F.explode("places").alias("at"), "hashes").select("item_id", "at", F.get("hashes", F.col("at")).alias("hash"))
    return items.select("item_id", "item_words", F.size("places").alias("item_windows")), windows, whole


def whole_items(rows: DataFrame, whole: DataFrame) -> DataFrame | None:
    """Pairs of a row and an item (item_id, item_words) whose words, values and all, stand in the row's text; None without items.

    A text's runs of words are hashed once for each length that items have; hits are compared word by word.
    """
    lengths = sorted(r[0] for r in whole.select(F.size("item_words")).distinct().collect())
    if not lengths:
        return None
    words = rows.select("doc_id", "row_hash", plain_words(marked(F.col("text"))).alias("w"))
    items = whole.select("item_id", "item_words", F.xxhash64("item_words").alias("hash"))
    out = None
    for n in lengths:
        places = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1))
        runs = words.select("doc_id", "row_hash", F.explode(F.transform(places, _run_of(n))).alias("run"))
        hits = runs.withColumn("hash", F.xxhash64("run")).join(items, "hash").where(F.col("run") == F.col("item_words"))
        found = hits.select("doc_id", "row_hash", "item_id")
        out = found if out is None else out.union(found)
    one = F.lit(1).cast("int")
    return out.distinct().select("doc_id", "row_hash", "item_id", one.alias("n_windows"), one.alias("item_windows"), F.lit(1.0).alias("coverage"), F.lit(0).alias("n_changed"))


def _run_of(n: int):
    return lambda i: F.slice("w", i, n)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, size: int = 8, literals: int = 4, coverage: float = 0.5) -> DataFrame:
    """Pairs of a document and a benchmark item of whose template windows it holds the share ``coverage`` or more.

    Returns doc_id, row_hash, item_id, n_windows, item_windows, coverage and n_changed (slots whose values
    differ from the item's: above 0, the item was re-parameterised). Null texts count as empty and match
    nothing; rows with a null doc_id keep it; items of fewer than ``size`` words or without a window of
    ``literals`` literal words are found only whole, their values unchanged, as one window; items without words match
    nothing; repeated rows of a document or an item count once; a very long text has as many windows as words; ties of
    alignments count as one item; an empty table gives no rows; other columns are ignored.
    """
    items, windows, whole = benchmark_windows(benchmark, size, literals)
    items, windows, whole = table(items, "items"), table(windows, "windows"), table(whole, "whole-items")
    # bytes of the items' words, as of their windows' hashes, are what a broadcast holds
    held = items.agg(F.coalesce(F.sum(F.octet_length(F.array_join("item_words", " ")) + 24 * F.size("item_words")), F.lit(0))).first()[0]
    small = windows.count() * 64 + held <= BROADCAST_BYTES
    rows = keyed(docs)
    # projections of their own, and an outer explode, which no filter is inferred from: what repeats is computed anew
    words = rows.select("doc_id", "row_hash", _hashed(_template_tokens(marked(F.col("text")))).alias("words"))
    hashes = words.select("doc_id", "row_hash", F.posexplode_outer(window_hashes(F.col("words"), size)).alias("doc_at", "hash"))
    hits = hashes.join(F.broadcast(windows) if small else windows, "hash")
    alignments = hits.groupBy("doc_id", "row_hash", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("places"))
    alignments = table(alignments, "alignments")

    found = alignments.select("doc_id", "row_hash").distinct()
    found = table(found, "found")
    few = found.count() * 64 <= BROADCAST_BYTES
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.row_hash") == F.col("b.row_hash")]
    texts = rows.alias("a").join((F.broadcast(found) if few else found).alias("b"), same, "left_semi").dropDuplicates(["doc_id", "row_hash"])
    texts = texts.select("doc_id", "row_hash", tokens(marked(F.col("text"))).alias("doc_words"))
    joined = alignments.alias("a").join(texts.alias("b"), same).select("a.*", "b.doc_words").join(F.broadcast(items) if small else items, "item_id")
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + size - 1))))
    slots = F.filter(covered, lambda i: F.get("item_words", i).rlike(f"^[{NUMBER}-{UNIT}]"))
    joined = joined.withColumn("slots", F.transform(slots, lambda i: F.struct(F.get("item_words", i).alias("theirs"), F.get("doc_words", i + F.col("shift")).alias("ours"))))
    consistent = F.size(F.array_distinct("slots")) == F.size(F.array_distinct("slots.theirs"))
    joined = joined.where(consistent).withColumn("n_changed", F.size(F.filter(F.array_distinct("slots"), lambda s: s["theirs"] != s["ours"])))
    best = joined.groupBy("doc_id", "row_hash", "item_id", "item_windows").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max("n_changed").alias("n_changed"))
    best = best.select("doc_id", "row_hash", "item_id", F.size("places").alias("n_windows"), "item_windows", (F.size("places") / F.col("item_windows")).alias("coverage"), "n_changed")
    best = best.where(F.col("coverage") >= coverage)
    extra = whole_items(rows, whole)
    return best if extra is None else best.union(extra)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("item_windows").cast("long").alias("item_windows"), F.col("n_changed").cast("long").alias("n_changed"))


def _sql_marked(text: str) -> str:
    for pattern, to in MARKS:
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace(lower({text}), '{STRIP[0]}', ' ', 'g'))"


OP9_SQL = f"""
WITH sides AS (
  SELECT 'd' AS side, doc_id AS id, {_sql_marked("coalesce(text, '')")} AS m FROM documents
  UNION ALL SELECT 'b', item_id, {_sql_marked("coalesce(text, '')")} FROM benchmark),
toks AS MATERIALIZED (
  SELECT DISTINCT side, id, string_split(m, ' ') AS w, string_split(regexp_replace(m, '{TEMPLATE[0]}', '\\1', 'g'), ' ') AS t,
         string_split(trim(regexp_replace(regexp_replace(m, '{PLAIN[0][0]}', '', 'g'), '{PLAIN[1][0]}', ' ', 'g')), ' ') AS p FROM sides),
wins AS (
  SELECT side, id, w, t, i, t[i:i+7] AS win FROM (SELECT *, unnest(range(1, len(t) - 6)) AS i FROM toks WHERE len(t) >= 8)),
items AS (
  SELECT * FROM wins WHERE side = 'b' AND len(list_filter(win, lambda x: NOT regexp_matches(x, '^[{NUMBER}-{UNIT}]'))) >= 4),
sized AS (SELECT id, count(*) AS item_windows FROM items GROUP BY id),
shorts AS (SELECT t.id, t.p FROM toks t LEFT JOIN sized s ON s.id = t.id WHERE t.side = 'b' AND s.id IS NULL AND array_to_string(t.p, '') <> ''),
hits AS (
  SELECT d.id AS doc_id, b.id AS item_id, d.i - b.i AS shift, b.i AS pos, any_value(d.w) AS dw, any_value(b.w) AS bw
  FROM (SELECT * FROM wins WHERE side = 'd') d JOIN items b ON d.win = b.win GROUP BY ALL),
places AS (SELECT doc_id, item_id, shift, unnest(range(pos, pos + 8)) AS p, dw, bw FROM hits),
pairs AS (
  SELECT DISTINCT doc_id, item_id, shift, bw[p] AS theirs, dw[p + shift] AS ours FROM places WHERE regexp_matches(bw[p], '^[{NUMBER}-{UNIT}]')),
slots AS (
  SELECT doc_id, item_id, shift, count(*) AS n, count(DISTINCT theirs) AS k, count(*) FILTER (WHERE theirs <> ours) AS changed FROM pairs GROUP BY ALL),
good AS (
  SELECT h.doc_id, h.item_id, h.pos, coalesce(s.changed, 0) AS changed FROM hits h LEFT JOIN slots s USING (doc_id, item_id, shift) WHERE s.n IS NULL OR s.n = s.k)
SELECT doc_id, item_id, count(DISTINCT pos) AS n_windows, item_windows, max(changed) AS n_changed
FROM good JOIN sized ON item_id = id GROUP BY doc_id, item_id, item_windows HAVING count(DISTINCT pos) >= 0.5 * item_windows
UNION ALL
SELECT DISTINCT d.id, b.id, 1, 1, 0 FROM shorts b, (SELECT id, p FROM toks WHERE side = 'd') d WHERE len(d.p) >= len(b.p)
  AND list_contains(list_transform(range(1, len(d.p) - len(b.p) + 2), lambda i: d.p[i : i + len(b.p) - 1]), b.p)
"""
