"""Secret scans over an incremental blob ledger, by DataFrame operations only.

Each version of a file is a row (path key, text). A version's blob is named by the SHA-256 of its content. The ledger
holds a row for each (blob, rule version) that was ever scanned, with the spans found. A scan hashes the versions,
drops every (blob, rule version) pair that the ledger has, scans one copy of each remaining blob, appends the outcome
(also the empty ones, so that clean blobs aren't scanned again) and joins findings back to all paths of a blob.

Defined cases: null text is an empty blob; an empty table gives an empty table; repeated rows are paths of one blob; a
null key is a path as any other; very long texts are ordinary; columns besides the key and the text are ignored. Spans count code points, their end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch

#: Kind, pattern, group that must be long enough (0: all of it), its least length.
RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A pattern that each match of a rule contains: one pass of it settles most texts.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
RULE_VERSION = "base-1"
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def kind_spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The kept matches of a rule: leftmost, not overlapping, the short ones dropped after matching.

    Splitting by the pattern gives the text between matches, so running lengths give every match's place.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    lengths = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), judged.alias("part")),
        lambda x: F.struct(
            F.length(x["gap"]).cast("long").alias("gap"),
            F.coalesce(F.length(x["hit"]), F.lit(0)).cast("long").alias("hit"),
            F.coalesce(F.length(x["part"]), F.lit(0)).cast("long").alias("part"),
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["hit"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["part"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.rlike(HINTS[kind]), F.aggregate(lengths, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def find(text: Column) -> Column:
    """All spans of a text by start, then by kind as listed."""
    every = [kind_spans(text, i, *rule) for i, rule in enumerate(RULES)]
    return F.array_sort(F.concat(*every))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(versions: DataFrame, key: str, text: str, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan unseen blobs of ``versions``, append them to the ledger at path ``ledger`` and return (key, blob, spans).

    A job that is repeated after a failure scans what its lost attempt didn't append; a pair that two attempts
    appended counts once.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    paths = rows.select("path", F.sha2("body", 256).alias("blob"))
    ledger_schema = f"blob string, rules string, spans {SPAN}"
    known = _read(spark, ledger, ledger_schema).where(F.col("rules") == rule_version)
    # One path of each unseen blob speaks for it: only names and paths are shuffled for that, never texts.
    fresh = paths.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("no"), F.col("path").alias("path"))).alias("one"))
    fresh = fresh.join(known.select("blob"), "blob", "left_anti").select("blob", F.col("one.path").alias("path"))
    named = rows.withColumn("blob", F.sha2("body", 256))
    owner = fresh.select(F.col("path").alias("owner"), F.col("blob").alias("owned"))
    speaks = named.join(owner, F.col("path").eqNullSafe(F.col("owner")) & (F.col("blob") == F.col("owned")), "left_semi")
    found = speaks.select("blob", F.lit(rule_version).alias("rules"), find(F.col("body")).alias("spans"))
    found.write.mode("append").parquet(ledger)
    all_known = _read(spark, ledger, ledger_schema).where(F.col("rules") == rule_version)
    hits = all_known.where(F.size("spans") > 0).dropDuplicates(["blob"]).select("blob", "spans")
    return paths.join(hits, "blob", "left").select(F.col("path").alias(key), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, from a scan with an empty ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, "doc_id", "text", Scratch(spark, "op7").path("ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind, *_ in RULES),
        F.sha2(listed(F.col("spans")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
