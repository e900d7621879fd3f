"""Conversations as training examples by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its
text lies under the loss mask. Turns behind the last assistant turn would otherwise be lost, so a
conversation that ends with another role gets one more example with an empty mask.

Template: <|im_start|>role NEWLINE text <|im_end|> NEWLINE. Within roles and texts a bar is put
behind each "<" that bars follow, so "<|im_" occurs only where the template writes it; taking the
bar out again restores the text. A newline in a role is written <|nl|>.

Turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows have one
order. A null role or text counts as empty. A row with a null conversation id belongs to no
conversation: it is one of its own, with a null conv_id. Columns other than conv_id, turn, role and
text are left out. A conversation's turns are one array in one task, as each example holds all of
them; very long texts are kept whole. Output grows with the square of a conversation's turns, which
is what this expansion means; no step before the output does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END, NEWLINE_IN_ROLE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\|+)", r"<|$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def format_conversations(df: DataFrame) -> DataFrame:
    """Examples: conv_id, lone, position of the target turn, formatted text, mask as start and end in code points.

    lone tells the rows without a conv_id apart and is null for all others.
    """
    role = F.coalesce("role", F.lit(""))
    trains = (role == "assistant").alias("trains")
    head = F.concat(F.lit(START), F.regexp_replace(escaped(role), "\n", F.lit(NEWLINE_IN_ROLE)), F.lit("\n")).alias("head")
    turn = F.struct("turn", "role", "text", trains, head, escaped(F.col("text")).alias("body"))
    # Rows that nothing joins must not meet in one task either.
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = df.select("conv_id", lone.alias("lone"), turn.alias("turn"))
    whole = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # Each turn is formatted once; an example takes its part of the one array.
    said = F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    placed = F.transform("turns", lambda x, i: F.struct((i + 1).alias("position"), x["trains"].alias("trains"), x["head"].alias("head"), x["body"].alias("body")))
    targets = F.filter(placed, lambda x: x["trains"] | (x["position"] == F.size("turns")))
    rows = whole.select("conv_id", "lone", said.alias("said"), F.explode(targets).alias("target"))
    before = F.array_join(F.slice("said", F.lit(1), F.col("target.position") - 1), "")
    rows = rows.select("conv_id", "lone", "target.*", F.concat(before, F.col("target.head")).alias("context"))
    start = F.length("context")
    return rows.select(
        "conv_id",
        "lone",
        "position",
        F.concat("context", "body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("trains"), start + F.length("body")).otherwise(start).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted example holds."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(START) + 1))
        cut = F.instr(inner, "\n")
        role = F.substr(inner, F.lit(1), cut - 1)
        return F.struct(
            unescaped(F.replace(role, F.lit(NEWLINE_IN_ROLE), F.lit("\n"))).alias("role"),
            unescaped(F.substr(inner, cut + 1)).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_masked(formatted: Column, start: Column, end: Column) -> Column:
    return unescaped(F.substr(formatted, start + 1, end - start))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, formatted and read back."""
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = format_conversations(rows)
    whole = made.groupBy("conv_id", "lone").agg(
        F.max_by("formatted", "position").alias("longest"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", read_masked(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("t")))),
                lambda x: x["t"],
            ),
            "",
        ).alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    whole = whole.withColumn("turns", read_turns(F.col("longest")))
    plain = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(plain, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, NULL, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, row_number() OVER w AS position, lead(1) OVER w IS NULL AS is_last,
         length(regexp_replace(replace(role, chr(10), '######'), '<(\|+)', '<|\1', 'g')) + length(regexp_replace(text, '<(\|+)', '<|\1', 'g')) + 24 AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn, role, text)),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, lone ORDER BY position) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR is_last))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id, lone
"""
