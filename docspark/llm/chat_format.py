"""Chat formatting with relational operations: collect, sort, merge and concatenate, all as Spark expressions.

A conversation becomes one string. Runs of turns with one role share a block::

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

Texts and roles are escaped: each backslash is doubled, then one backslash goes after the first character of each
control string inside the text. A control string therefore never occurs in an escaped text, and as every other run of
backslashes is even, the lone ones can be taken out again. A line feed in a role, whose line it would end, becomes "|\\|": a
lone backslash after a character that begins no control string.

The loss mask is run-length encoded, one pair a turn: ``skip`` code points without loss, then ``take`` with it (0 for
turns of other roles). What follows the last pair is without loss.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a text may not carry into the output as they are: the template's own, and common ones of other templates.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Roles whose texts are under the loss mask.
LOSS_ROLES = ("assistant",)
CLOSE = END + "\n"
#: A line feed inside a role.
BREAK = "|\\|"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(?<!\\)\\(?!\\)", ""), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def format_chat(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss_mask array of (skip, take).

    Turns are ordered by (turn, role, text), so ties and repeated rows have one order; a null turn sorts first. Null
    texts and null roles are empty strings; roles may hold any characters, line feeds too. Rows without conv_id form one
    conversation whose id is null. Further columns are ignored; an empty table gives no rows. A conversation is one
    output record, so its turns meet in one row, as the record itself must.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    sorted_turns = convs.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get("turns", i - 1)["role"] != x["role"])
        closes = (i + 1 == F.size("turns")) | (F.get("turns", i + 1)["role"] != x["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))).otherwise(F.lit(SEP)).alias("head"),
            escape(x["text"]).alias("body"),
            F.when(closes, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
            x["role"].isin(*LOSS_ROLES).alias("loss"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("p"))

    def mask(x: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.length(F.get("p", i - 1)["tail"]))
        head, body = F.length(x["head"]), F.length(x["body"])
        return F.struct((before + head + F.when(x["loss"], 0).otherwise(body)).alias("skip"), F.when(x["loss"], body).otherwise(0).alias("take"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.transform("p", mask).alias("loss_mask"),
    )


def parse_chat(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, turns array of (role, text), loss_text (unescaped), formatted."""
    blocks = F.filter(F.split("formatted", f"(?<={re.escape(END)})\n", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(START) + 1), F.length(block) - len(START) - len(END))
        line = F.instr(inner, F.lit("\n"))
        role = unescape_role(F.substring(inner, F.lit(1), line - 1))
        texts = F.split(F.substring(inner, line + 1, F.length(inner)), re.escape(SEP), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    # one piece a turn: cut before each opening and each separator, so that mask entries apply piece by piece
    cuts = F.split("formatted", f"(?={re.escape(START)})|(?={re.escape(SEP)})", -1)
    pieces = F.filter(cuts, lambda c: c != "")
    out = formatted.select("conv_id", "formatted", "loss_mask", F.flatten(F.transform(blocks, turns_of)).alias("turns"), pieces.alias("pieces"))
    # skip counts from the end of the piece before, of which the closing tail is left over
    tail = lambda i: F.when((i > 0) & F.endswith(F.get("pieces", i - 1), F.lit(CLOSE)), len(CLOSE)).otherwise(0)
    under = F.transform("loss_mask", lambda m, i: F.when(m["take"] > 0, unescape(F.substring(F.get("pieces", i), m["skip"] - tail(i) + 1, m["take"]))).otherwise(""))
    return out.select("conv_id", "turns", F.array_join(under, "").alias("loss_text"), "formatted")


def query(spark: SparkSession, convs: DataFrame) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    back = parse_chat(format_chat(convs.select("conv_id", "turn", "role", "text").unionByName(extra)))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    x = rf"replace({x}, '\', '\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


def _sql_escape_role(x: str) -> str:
    return rf"replace({_sql_escape(x)}, chr(10), '{BREAK}')"


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS joined FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_sql_escape('text')}) + CASE WHEN joined THEN {len(SEP)} ELSE length({_sql_escape_role('role')}) + {len(START) + 1 + len(CLOSE)} END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
