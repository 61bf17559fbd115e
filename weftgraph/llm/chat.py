"""Chat formatting by prefix-target expansion. DataFrame functions only.

A conversation becomes one string of turns, ``<|turn|>role<|text|>text<|end|>`` each. Control strings
inside roles and texts are broken by a backslash after their first character, and backslashes doubled,
so no text can end its turn, and unescape() restores it.

Every assistant turn is an example of its own: its text is the conversation's prefix up to that reply
(any prefix of the string ends where a turn ends), and only the reply lies under the loss mask. A
conversation's row carries its examples as spans, so that its size stays linear in its turns;
expand() makes the rows.

Defined results: turns go by turn, then role, then text, nulls first; null texts and roles are empty;
repeated rows are turns of their own; rows without conv_id make one conversation, of null; a
conversation without an assistant has no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common ones.
CONTROL = [TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ASSISTANT = "assistant"


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        x = F.replace(x, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, examples (array of end and of the loss span, in code points
    of formatted from 0; the end of the example is the end of its last turn)."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = turns.select("conv_id", "turn", text("role"), text("text"))
    rows = rows.withColumn("part", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("end", F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    start = F.col("end") - F.length("part") + (len(TURN) + len(ASSISTANT) + len(TEXT))
    example = F.when(F.col("role") == ASSISTANT, F.struct("end", start.alias("loss_start"), (F.col("end") - len(END)).alias("loss_end")))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("parts"), F.sort_array(F.collect_list(example)).alias("examples"))
    return df.select("conv_id", F.array_join(F.transform("parts", lambda p: p.part), "").alias("formatted"), "examples")


def expand(formatted: DataFrame, whole: bool = False) -> DataFrame:
    """Per example: conv_id, example (from 0), text (all turns up to the reply), loss_start, loss_end.
    whole: conversations without examples have a row too, and formatted stays beside the examples."""
    explode = F.posexplode_outer if whole else F.posexplode
    rows = formatted.select("conv_id", "formatted", explode("examples").alias("example", "e"))
    return rows.select("conv_id", *["formatted"] * whole, "example", F.substring("formatted", F.lit(1), F.col("e.end")).alias("text"), "e.loss_start", "e.loss_end")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    part = lambda x, i: unescape(F.split(F.regexp_replace(x, r"<\|end\|>\z", ""), r"<\|text\|>")[i])
    return F.transform(pieces, lambda x: F.struct(part(x, 0).alias("role"), part(x, 1).alias("text")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    shown = expand(format_conversations(turns), whole=True)
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    losses = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", loss.alias("loss")))))
    both = shown.groupBy("conv_id").agg(F.first("formatted").alias("formatted"), losses.alias("losses"))
    both = both.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform("losses", lambda x: x.loss), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return both.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(TURN + TEXT + END)}) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c
"""
