"""Chat formatting by prefix-target expansion (native SQL functions only).

Every assistant turn becomes one example: all turns before it are context and
its own text is the only trainable span. A conversation's formatted stream is
kept once, turn by turn, with the offset where each example's context ends;
expand() writes the examples out from it, context and target, one at a time, and
read_back() reads the loss from these. Stored output is linear in the input,
the work of expansion quadratic in a conversation's turns. render() gives context
and target as separate columns.

Template of a turn: [INST]role[/INST]text</s>. Control strings inside roles and
texts get a backslash in their middle and backslashes are doubled, so the
markers occur in the stream only where the template wrote them, and unescape()
restores every character.

Defined results: a null role or text counts as empty; turns are ordered by
turn, then role, then text (nulls first), so repeated rows and ties have a
fixed order; a null conv_id is one conversation; conversations without an
assistant turn have no example and an empty loss; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: Control strings and their escaped forms; a backslash itself is doubled first.
ESCAPES = (
    ("<s>", "<\\s>"),
    ("</s>", "<\\/s>"),
    ("[INST]", "[\\INST]"),
    ("[/INST]", "[\\/INST]"),
    ("<<SYS>>", "<<\\SYS>>"),
    ("<</SYS>>", "<<\\/SYS>>"),
)


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control, safe in ESCAPES:
        out = F.replace(out, F.lit(control), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its piece of the stream and where that piece and its text begin.

    conv_id, turn, ordinal, role, piece, start (code points before the piece), text_start,
    text_chars (both in the escaped stream), is_target.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = conversations.select("conv_id", "turn", "role", "text")
    return (
        turns.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)))
        .withColumn("body", escape(F.col("text")))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .withColumn("ordinal", F.row_number().over(order))
        .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long"))
        .select(
            "conv_id",
            "turn",
            "ordinal",
            "role",
            "piece",
            "start",
            (F.col("start") + F.length("head")).alias("text_start"),
            F.length("body").cast("long").alias("text_chars"),
            (F.coalesce(F.col("role"), F.lit("")) == "assistant").alias("is_target"),
        )
    )


def example_columns() -> list[Column]:
    """What an example is, from its target's turn: context end, loss span and the target's own piece."""
    return [
        F.col("ordinal").alias("target_ordinal"),
        F.col("start").alias("context_chars"),
        F.col("text_start").alias("loss_start"),
        F.col("text_chars").alias("loss_length"),
        F.col("piece").alias("target"),
    ]


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn."""
    return formatted.where("is_target").select("conv_id", *example_columns())


def render(formatted: DataFrame) -> DataFrame:
    """Examples with their context written out; quadratic in a conversation's turns."""
    ctx, ex = formatted.select("conv_id", "ordinal", "piece"), examples(formatted)
    pieces = ctx.select(F.col("conv_id").alias("c"), "ordinal", "piece")
    joined = ex.join(pieces, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("ordinal") < F.col("target_ordinal")), "left")
    return joined.groupBy("conv_id", "target_ordinal", "loss_start", "loss_length", "target").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("ordinal", "piece")))), lambda x: x["piece"]),
            "",
        ).alias("context")
    )


def expand(formatted: DataFrame, *figures: Column) -> DataFrame:
    """Prefix-target expansion: a row per assistant turn with its whole example, all turns before it and then itself.

    conv_id, x (as example_columns() has it), example, in which the loss span lies at loss_start; one row without them for a
    conversation without an assistant turn; figures of `pieces`, the conversation's stream in order. The stream is gathered
    once a conversation and examples are cut from it row by row, so no more than one of them is held at a time.
    """
    whole = formatted.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "piece"))).alias("pieces"),
        # The rows of examples(), in the stream's own grouping: no second exchange.
        F.sort_array(F.collect_list(F.when(F.col("is_target"), F.struct(*example_columns())))).alias("e"),
    )
    stream = F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("stream")
    rows = whole.select("conv_id", "e", stream, F.struct(F.lit(0).alias("_"), *figures).alias("figures")).withColumn("x", F.explode_outer("e"))
    prefix = F.substr("stream", F.lit(1), F.col("x.context_chars").cast("int"))
    return rows.select("conv_id", "x", F.concat(prefix, F.col("x.target")).alias("example"), "figures.*").drop("_")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the formatted output says: turns from the stream, loss text and sizes from the whole examples."""
    head, tail = F.length(F.lit(OPEN)), F.length(F.lit(END))

    def said(x):
        body = F.split_part(x["piece"], F.lit(CLOSE), F.lit(1))
        text = F.substr(x["piece"], F.length(body) + len(CLOSE) + 1, F.length(x["piece"]) - F.length(body) - len(CLOSE) - tail)
        role = unescape(F.substr(body, head + 1))
        return F.concat(role, F.lit("\n"), unescape(text), F.lit("\n"))

    figures = {
        "n_turns": F.size("pieces").cast("long"),
        "turns_sha256": F.sha2(F.array_join(F.transform("pieces", said), "").cast("binary"), 256),
        "formatted_chars": F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + F.length(x["piece"])),
    }
    masked = unescape(F.substr("example", F.col("x.loss_start").cast("int") + 1, F.col("x.loss_length").cast("int")))
    read = expand(formatted, *(c.alias(n) for n, c in figures.items())).select(
        "conv_id", *figures, F.col("x.target_ordinal").alias("at"), masked.alias("loss"), F.length("example").cast("long").alias("chars")
    )
    # Grouped as expand() left the rows: no exchange.
    lost = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "loss"))))
    back = read.groupBy("conv_id").agg(
        *(F.max(n).alias(n) for n in figures),
        F.array_join(F.transform(lost, lambda x: x["loss"]), "").alias("loss"),
        F.count("at").alias("n_examples"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("example_chars"),
    )
    return back.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
        "example_chars",
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts hold control strings."""
    rows = F.array(
        F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
        F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")),
    )
    types = dict(conversations.dtypes)
    probe = conversations.sparkSession.range(1).select(F.explode(rows).alias("r")).select(
        F.lit(-7).cast(types["conv_id"]).alias("conv_id"),
        F.col("r.turn").cast(types["turn"]).alias("turn"),
        F.col("r.role").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def oracle() -> str:
    """DuckDB SQL for read_back() over conversations and conversation -7."""
    esc = lambda c: _sql_escape(f"coalesce({c}, '')")
    return f"""
WITH src AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         length({esc('role')}) + length({esc('text')}) + {len(OPEN + CLOSE + END)} AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS o
  FROM src),
u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(concat(r, chr(10), x, chr(10)), '' ORDER BY o)) AS turns_sha256,
       length(coalesce(string_agg(x, '' ORDER BY o) FILTER (r = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY o) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars,
       count(*) FILTER (r = 'assistant')::BIGINT AS n_examples,
       coalesce(sum(upto) FILTER (r = 'assistant'), 0)::BIGINT AS example_chars
FROM u GROUP BY conv_id"""


def _sql_escape(expr: str) -> str:
    out = f"replace({expr}, '\\', '\\\\')"
    for control, safe in ESCAPES:
        out = f"replace({out}, '{control}', '{safe}')"
    return out
