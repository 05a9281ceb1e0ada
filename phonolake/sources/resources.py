"""Resource tables in tab-separated text, gzipped or not: sections, line kinds by their first sign, and binary models.

A gzip file can't be split, so such a table is read once and kept as Parquet (`kept`). Files with sections are small by
nature; the section of a line comes from a running count over file order within one file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

#: What the plans take.
SCHEMAS = {
    "en_lexicon": "dialect string, tier string, word string, ps map<string,string>",
    "en_tokenizer": "kind string, key string, pieces array<string>",
    "zh_phrase": "phrase string, syllables array<string>",
    "zh_syllable": "syllable string, initial string, final string",
    "zh_word": "word string, freq double, pos string",
    "hmm_start": "state string, lp double",
    "hmm_trans": "state string, next string, lp double",
    "hmm_emit": "state string, ch string, lp double",
    "ja_lexicon": "surface string, tokens array<struct<lc:int,rc:int,wcost:int,pron:string>>",
    "ja_word": "word string",
    "replay_word": "lang string, word string, final string, init string, o_nasal string, o_len string, ctx int, tails array<string>",
    "replay_pair": "lang string, w1 string, w2 string, tail_medial string, head_medial string, tail_final string, head_final string",
    "lts_segment": "lang string, shape int, key string, chunk string",
    "hi_word": "word string, alone string, nonfinal string, final string",
    "hi_num": "slot string, n int, ps string",
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, line) in file order."""
    text = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    return text.filter("line <> ''")


def sectioned(spark: SparkSession, path: str, mark: str = "##") -> DataFrame:
    """Lines with the name of the section that began last before them; comments go."""
    rows = lines(spark, path)
    begins = F.col("line").startswith(mark)
    name = F.last(F.when(begins, F.substring("line", len(mark) + 1, 1 << 20)), ignorenulls=True).over(Window.partitionBy("file").orderBy("nth"))
    return rows.withColumn("section", name).filter(~F.col("line").startswith("#"))


def lexicon(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """word, then phonemes or TAG=phonemes fields; a tag without phonemes is null."""
    fields = F.split("line", "\t")
    rest = F.slice(fields, F.lit(2), F.size(fields) - 1)
    plain = (F.size(rest) == 1) & ~F.get(rest, F.lit(0)).contains("=")
    tagged = F.map_from_entries(F.transform(rest, lambda f: F.struct(F.split(f, "=", 2)[0], F.nullif(F.get(F.split(f, "=", 2), F.lit(1)), F.lit("")))))
    ps = F.when(plain, F.create_map(F.lit("DEFAULT"), F.get(rest, F.lit(0)))).otherwise(tagged)
    return sectioned(spark, path).select(F.lit(dialect).alias("dialect"), F.lower("section").alias("tier"), F.get(fields, F.lit(0)).alias("word"), ps.alias("ps"))


def by_sign(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A Mandarin table whose lines tell their kind by the first sign: one scan, one filtered projection a kind."""
    pairs = lines(spark, path).select(F.split("line", "\t", 2).alias("f")).select(F.col("f")[0].alias("key"), F.col("f")[1].alias("value"))
    body = F.substring("key", 2, 1 << 20)
    total, syllable, word = F.col("key") == "@@", F.col("key").startswith("#"), F.col("key").startswith("@")
    return {
        "total": pairs.filter(total).select(F.col("value").cast("double").alias("total")),
        "syllable": pairs.filter(syllable).select(body.alias("syllable"), F.split("value", ",", 2)[0].alias("initial"), F.get(F.split("value", ",", 2), F.lit(1)).alias("final")),
        "word": pairs.filter(word & ~total).select(body.alias("word"), F.split("value", " ", 2)[0].cast("double").alias("freq"), F.get(F.split("value", " ", 2), F.lit(1)).alias("pos")),
        "phrase": pairs.filter(~syllable & ~word).select(F.col("key").alias("phrase"), F.split("value", " ").alias("syllables")),
    }


def hmm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rows s, t and e (start, transition, emission) and c (a character's states); the last field is the log probability."""
    f = F.split("line", "\t")
    rows = lines(spark, path).select(f.alias("f"))
    kind = lambda k: rows.filter(F.col("f")[0] == k)
    last = F.element_at("f", -1)
    n = F.size("f")
    return {
        "start": kind("s").select(F.slice("f", F.lit(2), n - 2).alias("state"), last.cast("double").alias("lp")),
        "trans": kind("t").select(F.slice("f", F.lit(2), (n - 2) / 2).alias("state"), F.slice("f", F.lit(2) + ((n - 2) / 2).cast("int"), (n - 2) / 2).alias("next"), last.cast("double").alias("lp")),
        "emit": kind("e").select(F.slice("f", F.lit(2), n - 3).alias("state"), F.element_at("f", -2).alias("ch"), last.cast("double").alias("lp")),
        "chars": kind("c").select(F.col("f")[1].alias("ch"), F.slice("f", F.lit(3), n - 2).alias("states")),
    }


def replay(spark: SparkSession, path: str, lang: str) -> dict[str, DataFrame]:
    """Words, then pairs, then the letter-to-sound model."""
    rows = sectioned(spark, path).select(F.split(F.coalesce("section", F.lit("")), " ")[0].alias("part"), F.split("line", "\t").alias("f"))
    words, pairs, model = (rows.filter(F.col("part") == p) for p in ("", "BIGRAMS", "LTS"))
    c = lambda i: F.get("f", F.lit(i))
    return {
        "word": words.select(F.lit(lang).alias("lang"), c(0).alias("word"), c(1).alias("final"), F.when(c(2) == "=", c(1)).otherwise(c(2)).alias("init"), c(3).alias("o_nasal"), c(4).alias("o_len"), F.coalesce(F.nullif(c(5), F.lit("")).cast("int"), F.lit(-1)).alias("ctx"), F.slice("f", 7, 1 << 20).alias("tails")),
        "pair": pairs.select(F.lit(lang).alias("lang"), *(c(i).alias(n) for i, n in enumerate(("w1", "w2", "tail_medial", "head_medial", "tail_final", "head_final")))),
        "segment": model.filter(c(0) == "S").select(F.lit(lang).alias("lang"), c(1).cast("int").alias("shape"), c(2).alias("key"), c(3).alias("chunk")),
        "stress": model.filter(c(0) == "T").select(F.lit(lang).alias("lang"), F.concat_ws("\t", c(1), c(2), c(3)).alias("key"), c(4).alias("pattern")),
    }


def write_table(df: DataFrame, path: str, keys: list[str]) -> None:
    """Escaped, tab-separated, gzipped lines in the order of their keys, in one file: for resource tables, which are small."""
    line = F.concat_ws("\t", *(T.escape_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns))
    df.repartitionByRange(1, *keys).sortWithinPartitions(*keys).select(line.alias("value")).write.option("compression", "gzip").text(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    want = S.StructType.fromDDL(schema)
    fields = F.split("value", "\t")
    return spark.read.text(path).select(*(T.unescape_field(F.get(fields, F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(want.fields)))


def kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


# -- binary models


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def pack_weights(weights: dict[str, dict[str, int]]) -> bytes:
    """Tags, then each feature with its sparse whole-number weights; compressed."""
    tags = sorted({t for ws in weights.values() for t in ws})
    body = varint(len(tags)) + b"".join(varint(len(t.encode())) + t.encode() for t in tags) + varint(len(weights))
    for f in sorted(weights):
        ws = weights[f]
        body += varint(len(f.encode())) + f.encode() + varint(len(ws)) + b"".join(varint(tags.index(t)) + varint(zigzag(ws[t])) for t in sorted(ws))
    return b"TAGW1" + zlib.compress(body, 9)


def unpack_weights(data: bytes) -> dict[str, dict[str, int]]:
    if data[:5] != b"TAGW1":
        raise ValueError("not a weight file")
    body, at = zlib.decompress(data[5:]), 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = body[at]
            at, n, shift = at + 1, n | (b & 127) << shift, shift + 7
            if b < 128:
                return n

    def string() -> str:
        nonlocal at
        n = number()
        at += n
        return body[at - n : at].decode()

    tags = [string() for _ in range(number())]
    out = {}
    for _ in range(number()):
        f = string()
        out[f] = {}
        for _ in range(number()):
            t, n = tags[number()], number()
            out[f][t] = (n >> 1) ^ -(n & 1)
    return out


def weights(spark: SparkSession, path: str) -> DataFrame:
    """(feature, tag, w) of a binary model file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = [(f, t, w) for f, ws in unpack_weights(data).items() for t, w in ws.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["feature", "tag", "w"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "feature string, tag string, w int")


def pack_matrix(a, b, shifts, cost_shift: int, row, col, grand: int) -> bytes:
    import numpy as np

    head = struct.pack("<HHHHh", len(row), len(col), len(shifts), cost_shift, grand)
    return head + np.asarray(row, "<i2").tobytes() + np.asarray(col, "<i2").tobytes() + np.asarray(shifts, "u1").tobytes() + np.asarray(a, "i1").tobytes() + np.asarray(b, "i1").tobytes()


def unpack_matrix(data: bytes):
    import numpy as np

    from ..operators.kernels import CompactMatrix

    rows, cols, rank, cost_shift, grand = struct.unpack_from("<HHHHh", data)
    sizes, kinds, at, parts = (rows, cols, rank, rows * rank, cols * rank), ("<i2", "<i2", "u1", "i1", "i1"), 10, []
    for n, kind in zip(sizes, kinds, strict=True):
        part = np.frombuffer(data, kind, n, at)
        if len(part) != n:
            raise ValueError("the matrix is cut off")
        at += part.nbytes
        parts.append(part)
    row, col, shifts, a, b = parts
    return CompactMatrix(a.reshape(rows, rank), b.reshape(cols, rank), shifts, cost_shift, row, col, grand)
