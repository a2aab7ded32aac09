"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.groups import quoted
from gossamer.session import materialize, table

#: The control strings of the template. None starts inside another.
BEGIN, END, SEGMENT = "<s>", "</s>", "<|seg|>"
OPEN, CLOSE = "[INST]", "[/INST]"
CONTROLS = (BEGIN, END, SEGMENT, OPEN, CLOSE)


def escape(text: Column) -> Column:
    """Double every backslash, then put one behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """One pass from the left: a backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, key: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted``, its turns as the template holds them, and ``loss_spans``, the mask.

    Turns are sorted by (turn, role, text). Adjacent turns of one role share a header; the
    segments between them keep the turns apart, so nothing is lost. A run of turns reads
    ``<s>[INST]role[/INST]text<|seg|>text</s>``. Null roles and texts are empty, a null turn
    sorts first, rows that are equal throughout stay, and a null key is one conversation. A
    conversation is one row of the result, so it has to fit one; time follows its length. ``loss_spans`` is an array of (start, length), in
    bytes of the formatted text in UTF-8: the escaped text of each turn of ``loss_role``, in order. Other columns are left
    out, whatever their names; an empty table gives an empty one.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = turns.groupBy(quoted(key).alias(key)).agg(F.array_sort(F.collect_list(row)).alias("_turns"))
    other = lambda t, i: ~t.role.eqNullSafe(F.get("_turns", i).role)

    def piece(t: Column, i: Column) -> Column:
        head = F.when(other(t, i - 1), F.concat(F.lit(BEGIN + OPEN), escape(t.role), F.lit(CLOSE))).otherwise(SEGMENT)
        return F.struct(head.alias("head"), escape(t.text).alias("body"), F.when(other(t, i + 1), END).otherwise("").alias("tail"), (t.role == loss_role).alias("loss"))

    n = lambda *parts: sum(F.octet_length(p).cast("long") for p in parts)
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def advance(a: Column, p: Column) -> Column:
        span = F.struct((a.at + n(p.head)).alias("start"), n(p.body).alias("length"))
        return F.struct((a.at + n(p.head, p.body, p.tail)).alias("at"), F.when(p.loss, F.array_append(a.spans, span)).otherwise(a.spans).alias("spans"))

    chats = chats.select(quoted(key), F.transform("_turns", piece).alias("_pieces"))
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p.head, p.body, p.tail)), "")
    return chats.select(quoted(key), text.alias("formatted"), F.aggregate("_pieces", none, advance, lambda a: a.spans).alias("loss_spans"))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under a mask, unescaped, as an array in order. Over output that has been written: expressions
    that make it would be worked out again for each span."""
    raw = formatted.cast("binary")
    return F.transform(spans, lambda s: unescape(F.substring(raw, s.start.cast("int") + 1, s.length.cast("int")).cast("string")))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read turns back from ``formatted``: ``parsed`` is an array of (role, text)."""
    blocks = F.filter(F.split("formatted", r"<s>\[INST\]"), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(b, CLOSE, 1))
    texts = lambda b: F.split(F.regexp_replace(F.substr(b, F.instr(b, CLOSE) + len(CLOSE)), r"</s>\z", ""), r"<\|seg\|>", -1)
    each = F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text"))))
    return chats.withColumn("parsed", F.flatten(each))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = parse_chats(materialize(format_chats(rows.unionByName(extra)), "chats"))
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "")
    return chats.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t),
 f AS (SELECT *, CASE WHEN role = before THEN length({_sql_escape('text')}) + {len(SEGMENT)}
        ELSE length({_sql_escape('text')}) + length({_sql_escape('role')}) + {len(BEGIN + OPEN + CLOSE + END)} END AS n FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
