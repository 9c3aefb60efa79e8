"""Secret scans over an incremental ledger of blobs.

Every historical version of every path is a blob, named by the SHA-256 of its content.  A rule's version is the SHA-256
of its pattern and bounds.  The ledger holds the findings of each (blob, rule version) pair scanned so far; a run scans
only pairs that the ledger lacks, each blob once however many paths and versions hold it, and joins the findings back
to all paths.  DataFrame functions alone are used.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_ids, shared_dir, stage_table


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ["password", "passwd", "secret", "token", "api_?key"]))


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""  # a plain string that every match holds

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:16]


#: Runs of one class are maximal, so a least length in the pattern drops the same matches as a filter after it; only
#: ``assign`` needs the filter, as a short value can end where another keyword's match would begin.
BASE_RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}", needs="AKIA"),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Beyond the base: PEM private keys, whole blocks.
RULES = (*BASE_RULES, Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "))
SPANS = "array<struct<s:int,k:int,e:int>>"
#: Each row of findings is repeated so often for the join back to paths: a blob may belong to a third of all paths.
SALTS = 8


def matches(text: Column, rule: Rule) -> Column:
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    if rule.group:
        found = F.arrays_zip(found.alias("m"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g"))
    return F.when(text.contains(rule.needs), found) if rule.needs else found


#: Parts of a text: rule, number, characters of the gap before the match, of the match, and whether it counts.
PARTS = "array<struct<k:int,p:int,gap:int,m:int,keep:boolean>>"


def parts_of(text: Column, found: Column, rule: Rule, order: int) -> Column:
    """The gaps between matches and the matches, by their lengths; one part without any stands for a rule that was tried."""
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("m"))
    full = (lambda m: m["m"]) if rule.group else (lambda m: m)
    size = (lambda m: F.length(m["g"])) if rule.group else F.length

    def part(x, i):
        keep = x["m"].isNotNull() & (size(x["m"]) >= rule.least)
        return F.struct(F.lit(order).alias("k"), i.alias("p"), F.length(x["gap"]).alias("gap"), F.coalesce(F.length(full(x["m"])), F.lit(0)).alias("m"), keep.alias("keep"))

    none = F.array(F.struct(F.lit(order).alias("k"), F.lit(0).alias("p"), F.lit(0).alias("gap"), F.lit(0).alias("m"), F.lit(False).alias("keep")))
    return F.when(F.size(found) > 0, F.transform(zipped, part)).otherwise(none).cast(PARTS)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, spans) for the texts of ``versions`` (text): pairs that ``ledger`` lacks, clean ones too.

    Null and empty texts are no blobs.  A text that occurs many times is one blob.
    """
    named = versions.where(F.length("text") > 0).select(blob_of(F.col("text")).alias("blob"), "text")
    none = F.expr("cast(array() as array<string>)")
    if ledger is None:
        blobs = named.groupBy("blob").agg(F.first("text").alias("text")).withColumn("seen", none)
    else:
        # by their names alone it is known which blobs lack a rule; only the texts of these are moved
        seen = ledger.where(F.col("rule").isin([r.version for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        lacking = named.select("blob").distinct().join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
        lacking = stage_table(lacking.select("blob", F.coalesce("seen", none).alias("seen")), "lacking", n=F.count("*"))
        texts = by_ids(named, lacking.select("blob"), "blob", lacking.observed["n"], "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        blobs = texts.join(lacking, "blob")
    # matches first, places only where there are any: each regular expression runs once over most texts
    found = blobs.select("blob", "text", "seen", *[F.when(~F.array_contains("seen", r.version), matches(F.col("text"), r)).alias(f"m{i}") for i, r in enumerate(rules)])
    parts = [F.when(~F.array_contains("seen", r.version), parts_of(F.col("text"), F.col(f"m{i}"), r, i)).otherwise(F.expr(f"cast(array() as {PARTS})")) for i, r in enumerate(rules)]
    rows = found.select("blob", F.explode(F.concat(*parts)).alias("x")).select("blob", "x.*")
    # places are running sums over the parts: linear in the matches; the rows stay where their blob is
    end = F.sum(F.col("gap") + F.col("m")).over(Window.partitionBy("blob", "k").orderBy("p")).cast("int")
    spans = rows.withColumn("e", end).groupBy("blob", "k").agg(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct((F.col("e") - F.col("m")).alias("s"), "k", "e")))).cast(SPANS).alias("spans"))
    return spans.select("blob", F.get(F.array(*[F.lit(r.version) for r in rules]), F.col("k")).alias("rule"), "spans")


def join_back(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, salts: int = SALTS) -> DataFrame:
    """All spans of every path: ``paths`` (doc_id, text) against the ledger's rows for these rules.

    Returns doc_id, blob and spans, sorted by start, then by the rule's place.  Paths without findings have no spans.
    """
    live = ledger.where(F.col("rule").isin([r.version for r in rules]) & (F.size("spans") > 0))
    findings = live.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    findings = findings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    key = paths.select("doc_id", blob_of(F.col("text")).alias("blob"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    return key.join(findings, ["blob", "salt"], "left").select("doc_id", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


LEDGER = "blob binary, rule string, spans array<struct<s:int,k:int,e:int>>"


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger stored at ``path``; None where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(LEDGER).parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks of ``versions`` (text), add it there, and return the whole ledger.

    A run that was cut off adds nothing, or all of its rows, and can be repeated; runs of one ledger follow each other.
    """
    spark = versions.sparkSession
    new = stage_table(scan(versions, open_ledger(spark, path), rules), "findings")  # written before the ledger changes
    new.write.mode("append").parquet(path)
    return open_ledger(spark, path)


def find_secrets(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan ``documents`` (doc_id, text) and return (doc_id, blob, spans) and the new ledger rows.

    With ``path`` the ledger is stored there: what it holds is not scanned again, and the whole ledger is returned.
    Every row keeps its own result; equal texts have equal spans; null texts have none; other columns are ignored.
    """
    if path is not None:
        whole = new = update_ledger(documents, path, rules)
    else:
        new = scan(documents, ledger, rules)
        whole = new if ledger is None else ledger.select("blob", "rule", "spans").unionByName(new)
    return join_back(documents, whole, rules), new


def rendered(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def count_of(place: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["k"] == place)).cast("long")


#: Setting of a session: where the query keeps its ledger.  Unset, each run starts one of its own.
LEDGER_SETTING = "spark.ledgerloom.secrets.ledger"


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get(LEDGER_SETTING, None) or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    found, _ = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path=path)
    base = F.filter("spans", lambda x: x["k"] < len(BASE_RULES))
    counts = [count_of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(rendered(base, RULES), 256).alias("base_sha256"), rendered(F.col("spans"), RULES).alias("spans"))


def cut_out(mark: str) -> Column:
    """The column ``text`` with ``mark`` for each of the column ``_secret_spans``, which do not overlap.

    The parts between them are cut from an array of the text that is made once: of its bytes, where a character is a byte,
    else of its characters.  So the work is linear in the text however many spans there are.
    """
    begin = "if(i = 0, 0, _secret_spans[i - 1].e)"
    size = f"if(i = size(_secret_spans), length(text), _secret_spans[i].s) - {begin}"
    each = "transform(sequence(0, size(_secret_spans)), i -> {0})"
    by_byte = each.format(f"cast(substring(t, {begin} + 1, {size}) as string)")
    by_character = each.format(f"array_join(slice(t, {begin} + 1, {size}), '')")
    kept = F.expr(f"if(octet_length(text) = length(text), transform(array(cast(text as binary)), t -> {by_byte})[0], transform(array(split(text, '')), t -> {by_character})[0])")
    return F.array_join(kept, mark)


def redact(documents: DataFrame, ledger: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with the text of every span that the ledger has for it replaced by ``mark``; spans that overlap are one.

    Rows without a finding pass by the join; null texts stay null; equal rows get equal texts.
    """
    live = ledger.where(F.col("rule").isin([r.version for r in rules])).select(F.col("blob").alias("_secret_blob"), F.explode("spans").alias("x")).select("_secret_blob", "x.s", "x.e")
    order = Window.partitionBy("_secret_blob").orderBy("s", "e")
    fresh = live.withColumn("fresh", F.when(F.col("s") < F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(order)).groupBy("_secret_blob", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    dirty = runs.groupBy("_secret_blob").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_secret_spans"))
    dirty = stage_table(dirty, "dirty", n=F.count("*"))
    named = documents.withColumn("_secret_blob", blob_of(F.col("text")))
    ids = dirty.select("_secret_blob")
    clean = by_ids(named, ids, "_secret_blob", dirty.observed["n"], "left_anti").select(*documents.columns)
    found = by_ids(named, ids, "_secret_blob", dirty.observed["n"], "left_semi")
    # a blob may belong to a third of the rows with findings
    salt = F.pmod(F.xxhash64(*[c for c in documents.columns if c != "text"]), F.lit(SALTS)).cast("int")
    dirty = dirty.withColumn("_secret_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    whole = found.withColumn("_secret_salt", salt).join(dirty, ["_secret_blob", "_secret_salt"])
    return clean.unionByName(whole.withColumn("text", cut_out(mark)).select(*documents.columns))


def oracle() -> str:
    """The same spans, from DuckDB's own split and extract functions."""

    def places(rule: Rule) -> str:
        p, g = rule.pattern.replace("'", "''"), rule.group
        return f"""SELECT doc_id, '{rule.kind}' AS kind, {RULES.index(rule)} AS k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            's': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
            'n': length(m[i]), 'v': length(g[i])}})) AS x
            FROM (SELECT doc_id, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {g}) AS g FROM documents WHERE text IS NOT NULL)
            WHERE len(m) > 0"""

    least = " OR ".join(f"(kind = '{r.kind}' AND x.v >= {r.least})" for r in RULES)
    each = " UNION ALL ".join(places(r) for r in RULES)
    one = "kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH hits AS (SELECT * FROM ({each}) WHERE {least}),
        per AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY x.s, k) FILTER (WHERE k < {len(BASE_RULES)}) AS base, string_agg({one}, ',' ORDER BY x.s, k) AS spans FROM hits GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id"""


ORACLE = oracle()
