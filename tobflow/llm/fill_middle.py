"""Fill-in-middle transformation over an index of distinct texts.

Documents of one text share an index row: they are grouped by the SHA-256 of their text, and the group's contents are
collected as a set, so a group of two contents stops the job instead of mixing them. Documents themselves travel as
small rows (doc_id and digest) and are joined back to the one row of their text, whose Elias-Fano list of code point
boundaries (byte offsets) is made once; each selects the two boundaries of its own cut there. A text that very many
documents hold is dealt over shares of about ``SHARE`` documents, each with an index row of its own, so that no task
works for a whole hot group. Texts are shuffled once, after equal ones of a task are combined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import BROADCAST_BYTES, documents, drop_tables, table

#: Documents of one text that share an index row.
SHARE = 1000
#: Boundaries between two samples of a list's select directory.
SAMPLE = 256
#: The markers of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def encode_list(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """The Elias-Fano form of ascending integers (at least one): bits of a low part, low parts, unary high parts, places of every SAMPLE-th value."""
    n, top = len(values), int(values[-1])
    low_bits = max(0, (top // n).bit_length() - 1)
    places = (values >> low_bits) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1, bool)
    high[places] = True
    low = (values[:, None] >> np.arange(low_bits)) & 1 if low_bits else np.zeros(0)
    return low_bits, np.packbits(low.astype(bool).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<i8").tobytes()


def select(low_bits: int, low: bytes, high: bytes, places: bytes, i: int) -> int:
    """The i-th value of a list."""
    at = int(np.frombuffer(places, "<i8", 1, 8 * (i // SAMPLE))[0])
    byte, ones, left = at // 8, np.zeros(0, np.int64), i % SAMPLE
    while True:
        bits = np.unpackbits(np.frombuffer(high, np.uint8)[byte : byte + SAMPLE], bitorder="little")
        if byte * 8 < at:
            bits[: at - byte * 8] = 0
        ones = np.flatnonzero(bits)
        if left < len(ones):
            break
        left, byte = left - len(ones), byte + SAMPLE
    value = byte * 8 + int(ones[left]) - i
    for bit in range((i + 1) * low_bits - 1, i * low_bits - 1, -1):
        value = value << 1 | low[bit >> 3] >> (bit & 7) & 1
    return value


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets of a UTF-8 text's code points, and its end."""
    data = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _cuts(texts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
    """For each text, the byte offsets of its documents' cuts, from one boundary list."""
    out = []
    for text, first, second in zip(texts, firsts, seconds, strict=True):
        own = encode_list(boundaries(text.as_buffer().to_pybytes()))
        out.append([{"a": select(*own, a), "b": select(*own, b)} for a, b in zip(first.as_py(), second.as_py(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))


def _shares(rows: DataFrame, share: int) -> DataFrame:
    """key and parts of the texts that more than ``share`` documents hold."""
    return rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > share).select("key", F.ceil(F.col("n") / share).alias("parts"))


def _dealt(rows: DataFrame, hot: DataFrame, small: bool) -> DataFrame:
    """rows (doc_id, key, ...) with share, the part of a hot text that a document belongs to."""
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot) if small else hot, "key", "left").withColumn("share", part).drop("parts")


def _seed(doc_id: Column, group: int) -> Column:
    """The group-th eight hexadecimal digits of the digest of ``1:`` and the decimal doc_id, as an unsigned integer."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * group - 7, 8), 16, 10).cast("long")


def _transformed(docs: DataFrame, share: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """doc_id, copies (equal rows), n, form, prefix_chars, middle_chars and output; and the tables it reads, for later deletion."""
    from pyspark.sql.functions import arrow_udf

    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = table(base.groupBy("doc_id", "key").agg(F.count("*").alias("copies")), "fim-rows")
    hot = table(_shares(rows, share), "fim-hot")
    small = hot.count() * 64 <= BROADCAST_BYTES
    content = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("one digest, two contents")))
    index = _dealt(base, hot, small).groupBy("key", "share").agg(F.collect_set("text").alias("texts")).select("key", "share", content.alias("text"))
    asked = _dealt(rows, hot, small)
    document = F.struct("doc_id", "copies", *[_seed(F.col("doc_id"), g).alias(f"h{g}") for g in (1, 2, 3, 4)])
    asked = asked.groupBy("key", "share").agg(F.collect_list(document).alias("docs"))
    joined = index.join(asked.hint("shuffle_hash"), ["key", "share"]).withColumn("n", F.length("text").cast("long"))
    places = lambda choose: F.transform("docs", lambda d: choose(d["h1"] % (F.col("n") + 1), d["h2"] % (F.col("n") + 1)).cast("int"))
    joined = joined.withColumns({"firsts": places(F.least), "seconds": places(F.greatest)})
    joined = joined.withColumn("at", arrow_udf(_cuts, "array<struct<a:int,b:int>>")("text", "firsts", "seconds"))
    cut = joined.select("text", "n", F.inline(F.arrays_zip("docs", "firsts", "seconds", "at")))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | marked | (F.col("docs.h3") % 100 >= 90)
    form = F.when(plain, "plain").when(F.col("docs.h4") % 100 < 20, "spm").otherwise("psm")
    cut = cut.select("docs.doc_id", "docs.copies", "text", "n", form.alias("form"), F.col("firsts").alias("first"), F.col("seconds").alias("second"), "at")
    raw = "cast(text AS binary)"
    part = {k: F.expr(f"cast({e} AS string)") for k, e in (("p", f"substring({raw}, 1, at.a)"), ("m", f"substring({raw}, at.a + 1, at.b - at.a)"), ("s", f"substring({raw}, at.b + 1)"))}
    P, S, M = map(F.lit, (PREFIX, SUFFIX, MIDDLE))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(S, part["s"], P, part["p"], M, part["m"])).otherwise(F.concat(P, part["p"], S, part["s"], M, part["m"]))
    known = F.col("form") != "plain"
    sizes = {"prefix_chars": F.col("first"), "middle_chars": F.col("second") - F.col("first")}
    return cut.select("doc_id", "copies", "n", "form", *[F.when(known, v.cast("long")).alias(k) for k, v in sizes.items()], output.alias("output")), (rows, hot)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from; no text holds a marker, so each stands once."""
    piece = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    middle = piece(output, MIDDLE, 2)
    psm = F.concat(piece(piece(output, SUFFIX, 1), PREFIX, 2), middle, piece(piece(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(piece(piece(output, PREFIX, 2), MIDDLE, 1), middle, piece(piece(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def _given(out: DataFrame, spent: tuple[DataFrame, ...]) -> DataFrame:
    """A row for each copy of a row of out, which is written first."""
    out = table(out, "fim")
    drop_tables(*spent)
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy", "copies")


def fill_in_middle(docs: DataFrame, *, share: int = SHARE) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every row of docs.

    Two seeded cuts part a text in prefix, middle and suffix; psm and spm order the parts behind markers, plain leaves
    the text. A null text counts as empty and is plain; a null doc_id is seeded as the empty text behind ``1:``; equal
    rows are given out as often as they occur; very long texts are cut like any other (an index row holds one text);
    an empty table gives no rows; other columns are ignored.
    """
    return _given(*_transformed(docs, share))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    out, spent = _transformed(documents(spark, sf_dir), SHARE)
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return _given(out.withColumns(digests).drop("output"), spent)


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""
