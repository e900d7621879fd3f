"""Secret scans with a ledger of blobs.

Every version of every text is addressed by its SHA-256. A ledger in the shared folder holds one
row for each (blob, rule version) that has been scanned, with what was found; without a name of
its own a version is the digest of its rules, so that other rules never meet old findings. A run scans only
pairs that the ledger lacks, each once however many paths hold the blob, appends them, and joins
the ledger back to all paths.

Against a ledger that has something, addresses travel first and tell which blobs are unseen; only
the texts of these move then. What is broadcast (unseen addresses, findings) is counted before and
stays under BROADCAST_BYTES; beyond that, the same join shuffles both sides.

Spans are in code points, ends exclusive: positions follow from the lengths of the text's pieces
between the matches. Edge cases: a null text is the empty blob; repeated rows are each reported;
findings that tie in place are in the order of the rules; a text is scanned whole, and its time
grows little faster than its findings (running sums are made in blocks); a run that stopped before
its append leaves the ledger as it was, and pairs that two runs have both appended count once;
columns named blob or found are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.runtime import Tables, pack, stored, table, unpack, work_folder


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count whose group has at least least characters."""

    kind: str
    pattern: str
    group: int
    least: int


NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: In the order of the kinds. A run of hex digits or an access key is matched whole, so its least length can stand in the pattern.
RULES = (
    Rule("assign", f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
BROADCAST_BYTES = 32 << 20
ADDRESS_BYTES, FINDING_BYTES = 128, 64  # about what a row of addresses or a finding takes
MANY = 256  # findings in a text
FOUND = "array<struct<start:int,rank:int,end:int,kind:string>>"


def version_of(rules: tuple[Rule, ...]) -> str:
    """A name that changes with the rules."""
    return "rules-" + hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def let(value: Column, use) -> Column:
    """use(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, op, first: int = 0) -> Column:
    """For each element of an array of ints what op makes of those before it.

    A fold that appends would copy its result for each element; here blocks of the root of the
    array's size are folded and then each block's elements.
    """

    def fold(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, state, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def by_blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda i: F.slice(v, i * size + 1, size))

        def joined(b: Column) -> Column:
            wholes = F.transform(b, lambda x: F.aggregate(x, F.lit(first), op))
            return F.flatten(F.zip_with(b, fold(wholes, F.lit(first)), fold))

        return let(blocks, joined)

    return let(values, lambda v: F.when(F.size(v) > 0, by_blocks(v)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, kind) of one rule's matches in a text."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def located(m: Column) -> Column:
        # A match starts behind the pieces and the matches before it and its own piece.
        gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(m)), lambda x: F.length(x))

        def spans(g: Column) -> Column:
            steps = F.zip_with(g, m, lambda x, y: x + F.length(y))
            begins = F.zip_with(before(steps, lambda a, x: a + x), g, lambda x, y: x + y)
            found = F.zip_with(begins, m, lambda x, y: F.struct(x.alias("start"), F.lit(rank).alias("rank"), (x + F.length(y)).alias("end"), y.alias("text")))
            body = lambda x: F.regexp_extract(x["text"], rule.pattern, rule.group) if rule.group else x["text"]
            kept = F.filter(found, lambda x: F.length(body(x)) >= rule.least)
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"))).cast(FOUND)

        return let(gaps, spans)

    return F.coalesce(let(whole, lambda m: F.when(F.size(m) > 0, located(m))), F.array().cast(FOUND))


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings in a text, by start, then rule."""
    return F.sort_array(F.concat(*(matches(text, r, i) for i, r in enumerate(rules))))


def ledger_of(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob string, version string, found {FOUND}").parquet(ledger)


def addressed(versions: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.withColumn("blob", F.sha2(F.encode(body, "UTF-8"), 256))


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str | None = None, text: str = "text") -> str:
    """Scan the blobs of versions that the ledger lacks under this rule version, and append them; returns the version."""
    spark, version = versions.sparkSession, version or version_of(rules)
    bodies = addressed(versions.select(F.coalesce(F.col(text), F.lit("")).alias(text)), text)
    known = ledger_of(spark, ledger)
    unseen = None
    tables = Tables(spark)
    if known is not None:
        known = known.where(F.col("version") == version).select("blob")
        unseen = tables.keep(bodies.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        n = unseen.count()
        small = n * ADDRESS_BYTES <= BROADCAST_BYTES
        if small:
            bodies = bodies.join(F.broadcast(unseen), "blob", "left_semi")
    # Of each blob one text for each task is kept before anything moves.
    blobs = bodies.groupBy("blob").agg(F.first(text).alias("body"))
    if unseen is not None and not small:
        blobs = blobs.join(unseen, "blob", "left_semi")
    made = blobs.select("blob", F.lit(version).alias("version"), scan(F.col("body"), rules).alias("found"))
    made.write.mode("append").partitionBy("version").parquet(ledger)
    tables.drop(*tables.at)
    return version


def hits_of(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    """(blob, found) of each blob with findings, as a table: a blob with very many paths can then be split in the join."""
    hits = ledger_of(spark, ledger).where((F.col("version") == version) & (F.size("found") > 0))
    return stored(hits.groupBy("blob").agg(F.first("found").alias("found")), "hits")


def sized(hits: DataFrame) -> DataFrame:
    """hits, marked for a broadcast if their rows are small enough together."""
    size = hits.agg(F.coalesce(F.sum(ADDRESS_BYTES + FINDING_BYTES * F.size("found")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(hits) if size <= BROADCAST_BYTES else hits


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str | None = None, text: str = "text") -> DataFrame:
    """versions without its text, with blob and found (empty: nothing found), through the ledger."""
    versions = versions.drop("blob", "found")
    version = update_ledger(versions, ledger, rules, version, text)
    hits = hits_of(versions.sparkSession, ledger, version)
    paths = addressed(versions, text).drop(text)
    return paths.join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """text with every finding replaced; findings that overlap are replaced together."""

    def cut(take) -> Column:
        # take(a, n): n characters of the text from a on. Of findings that overlap, the first writes the mark.
        reach = before(F.transform(found, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        parts = F.zip_with(found, reach, lambda x, at: F.when(x["start"] >= at, F.concat(take(at, x["start"] - at), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), take(F.array_max(F.transform(found, lambda x: x["end"])), F.length(text)))

    plain = cut(lambda a, n: F.substr(text, a + 1, n))
    # Each substr walks the text from its start; for very many findings it is cut into characters once.
    many = let(F.split(text, ""), lambda c: cut(lambda a, n: F.array_join(F.slice(c, a + 1, n), "")))
    return F.when(F.size(found) > MANY, many).when(F.size(found) > 0, plain).otherwise(text)


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str | None = None) -> DataFrame:
    """docs with every finding in text replaced, through the ledger; an n_chars column follows the new text."""
    version = update_ledger(docs, ledger, rules, version)
    hits = sized(hits_of(docs.sparkSession, ledger, version))
    rows = addressed(pack(docs), "text").join(hits, "blob", "left")
    out = unpack(rows.withColumn("text", F.when(F.col("found").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("found")))), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def standing_ledger(spark: SparkSession) -> str:
    """The ledger that the session's setting spark.tessella.secretLedger names, for runs that add to each other; else a new one."""
    return spark.conf.get("spark.tessella.secretLedger", None) or work_folder(spark, "ledger")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document, through the session's ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = findings(docs, standing_ledger(spark))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return made.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(joined(F.col("found")), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def sql_kind(kind: str, rank: int, pattern: str, keep: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m[i]) AS stop FROM (
    SELECT doc_id, m, i,
           (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT doc_id, regexp_extract_all(body, '{pattern}') AS m, string_split_regex(body, '{pattern}') AS p FROM d) AS a,
         LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)) AS b
  WHERE {keep}"""


OP1_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), f AS ("
    + "\n  UNION ALL ".join(
        sql_kind(r.kind, i, r.pattern, f"length(regexp_extract(m[i], '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group})) >= {r.least}") for i, r in enumerate(RULES)
    )
    + """),
g AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
             count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""
)
