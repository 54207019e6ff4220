"""Secret scans over every historical version of every text, by an incremental ledger. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused


@dataclass(frozen=True)
class Rule:
    """Matches of pattern (leftmost, not overlapping) of which `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: A necessary condition that is cheaper to test than the pattern.
    hint: str | None = None


#: The base rules, in the order in which spans with equal starts are listed; then what this pack adds.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, r"(?i)passw|secret|token|api"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ"),
)
RULES = BASE + EXTRA
#: Changes whenever RULES does; a blob is scanned once for each version.
RULE_VERSION = "2"

SPAN = "struct<start:long,nth:int,kind:string,end:long>"
#: Spans of a text that are gathered in one list before the next is begun.
PART = 256


def spans_of(text: Column, rule: Rule, nth: int) -> Column:
    """The spans of one rule as array<SPAN>, in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so a running sum of their lengths
    gives each match's place.
    """
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    empty = F.from_json(F.lit("[]"), f"array<array<{SPAN}>>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("part"), empty.alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        # the same pattern on the match alone finds the same groups, as a match never looks past its end
        size = F.length(x["match"]) if not rule.group else F.length(F.regexp_extract(x["match"], rule.pattern, rule.group))
        span = F.struct(start.alias("start"), F.lit(nth).alias("nth"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        # appending copies a list, so the spans are gathered in parts of bounded length
        full = F.size(acc["part"]) >= PART
        part = F.when(full, F.array(span)).otherwise(F.concat(acc["part"], F.array(span)))
        parts = F.when(full, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"])
        hit = size >= rule.least
        return F.struct(end.alias("at"), F.when(hit, part).otherwise(acc["part"]).alias("part"), F.when(hit, parts).otherwise(acc["parts"]).alias("parts"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), m.alias("match")))
    found = F.aggregate(pairs, zero, step, lambda acc: F.concat(F.flatten(acc["parts"]), acc["part"]))
    return F.when(F.rlike(text, F.lit(rule.hint)) if rule.hint else F.lit(True), found).otherwise(none)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> (blob, spans): all spans by start, then in the order of the rules."""
    found = F.concat(*[spans_of(F.col("text"), r, i) for i, r in enumerate(rules)])
    return blobs.select("blob", F.array_sort(found).alias("spans"))


def empty_ledger(spark) -> DataFrame:
    none = F.lit(None)
    return spark.range(0).select(none.cast("string").alias("blob"), none.cast("string").alias("rule_version"), none.cast(f"array<{SPAN}>").alias("spans"))


class Ledger:
    """A ledger kept as a Parquet table between scans, a folder a rule version: each scan appends what it saw for the first time.

    A scan reads the names of the blobs that its rule version has, and the spans of those that have some; other
    versions' entries aren't touched. An append that fails leaves files that a later read may meet: a blob scanned
    twice is one blob, as entries of one blob and rule version are equal and findings are distinct by them.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _entries(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        empty = empty_ledger(self.spark)
        try:
            return self.spark.read.schema(empty.schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty

    def read(self) -> DataFrame:
        """Every entry, once."""
        return self._entries().dropDuplicates(["blob", "rule_version"])

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
        """Findings of every version of every path, as scan_versions; unseen blobs are scanned and entered."""
        own = lambda: self._entries().where(F.col("rule_version") == rule_version).select("blob", "spans")
        scan_unseen(versions, own().select("blob"), rules, rule_version).write.mode("append").partitionBy("rule_version").parquet(self.path)
        return findings_of(versions, own())


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every version of every path, and the ledger with what was scanned now.

    versions needs text and whatever names a path and its version; all its columns but text return (own
    blob and spans are replaced), with blob (SHA-256 of the UTF-8 text; null is as empty) and spans. Only blobs that the ledger doesn't have
    under this rule version are scanned, each once however many paths and versions hold it. Repeated rows
    each return; an empty table gives none; a blob's spans never depend on its paths.

    Texts move once, by content address, pre-aggregated in each task, so thousands of copies cost one row
    a task. Findings go back by a join that adaptive execution splits for a much copied blob.
    """
    spark = versions.sparkSession
    ledger = empty_ledger(spark) if ledger is None else ledger
    done = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans")
    new = staged(scan_unseen(versions, done, rules, rule_version), "ledger")
    return findings_of(versions, done.unionByName(new.select("blob", "spans"))), ledger.unionByName(new)


def _whole_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def scan_unseen(versions: DataFrame, done: DataFrame, rules: tuple[Rule, ...], rule_version: str) -> DataFrame:
    """(blob, rule_version, spans) of the texts of `versions` whose blob isn't in `done`, each once."""
    blobs = versions.select(F.sha2(_whole_text(), 256).alias("blob"), _whole_text().alias("text"))
    unseen = blobs.join(done.select("blob"), "blob", "left_anti") if done.take(1) else blobs
    unseen = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    return scan_blobs(unseen, rules).withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", "spans")


def findings_of(versions: DataFrame, done: DataFrame) -> DataFrame:
    """The spans of done(blob, spans) joined back to every version of every path."""
    name_blob, name_spans = unused("__blob", versions), unused("__spans", versions)
    # few blobs have spans; a blob that was entered twice counts once
    known = done.where(F.size("spans") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias(name_blob), F.col("spans").alias(name_spans))
    keep = [F.col(f"`{c}`") for c in versions.columns if c.lower() not in ("text", "blob", "spans")]
    paths = versions.select(*keep, F.sha2(_whole_text(), 256).alias("blob"))
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    return paths.join(known, F.col("blob") == F.col(name_blob), "left").select(*keep, "blob", F.coalesce(name_spans, none).alias("spans"))


def digest(findings: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and the list of all spans."""
    kinds = [r.kind for r in base]
    of = lambda *k: F.filter("spans", lambda s: s["kind"].isin(*k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return findings.select("doc_id", *counts, F.sha2(spans_text(of(*kinds)), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
