r"""Chat formatting with DataFrame functions only.

A declarative template gives each role the mark before and after its turn and whether the loss falls on its text. A
finite-state machine, given as a table of transitions, walks over the roles of a conversation and says whether their order
is valid and which turn breaks it first; broken conversations are formatted like others.

Inside texts a control string (any mark) gets one backslash more after its first character, so `</s>` becomes `<\/s>` and
`<\/s>` becomes `<\\/s>`: no text can hold a mark, and taking one backslash away gives every text back.

Turns are put in order by turn, then role and text where turns tie (nulls first); rows that repeat are turns of their own.
A null text or role counts as empty. Roles that the template doesn't have are written out in the mark. A null conv_id is a
conversation. Other columns are left aside. An empty table gives an empty result. A conversation's text is one value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm._common import table

#: role: (mark before, mark after, loss)
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Marks around the name of any other role; its text follows them and ends with the turn.
OTHER = ("[ROLE]", "[/ROLE]")
#: (state, role): next state. A conversation is valid if it ends in a state of ENDS.
TRANSITIONS = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
ENDS = ("assistant",)


def _marks(template: dict) -> str:
    """A group for what follows the first character of any mark."""
    marks = {m for before, after, _ in template.values() for m in (before, after)} | {*OTHER}
    return "|".join(sorted((re.escape(m[1:]) for m in marks), key=lambda m: (-len(m), m)))


def _firsts(template: dict) -> str:
    return "".join(sorted({re.escape(m[0]) for before, after, _ in template.values() for m in (before, after)} | {re.escape(OTHER[0][0])}))


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([{_firsts(template)}])(\\*)({_marks(template)})", r"$1\\$2$3")


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([{_firsts(template)}])\\(\\*)({_marks(template)})", "$1$2$3")


def _turn(turn: Column, template: dict) -> Column:
    """(before, text, after, loss) of one turn."""
    text, role = escape(turn["text"], template), turn["role"]
    def part(before: Column, after: Column, loss: bool) -> Column:
        return F.struct(before.alias("before"), text.alias("text"), after.alias("after"), F.lit(loss).alias("loss"))

    out = part(F.concat(F.lit(OTHER[0]), escape(role, template), F.lit(OTHER[1])), F.lit(""), False)
    for name, (before, after, loss) in template.items():
        out = F.when(role == name, part(F.lit(before), F.lit(after), loss)).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: dict = TEMPLATE, transitions: dict = TRANSITIONS, ends: tuple = ENDS) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, segments (text as formatted, loss), valid, broken_at."""
    turns = rows.select(F.col("conv_id"), F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    table_ = F.create_map(*(F.lit(x) for (state, role), then in transitions.items() for x in (f"{state}\n{role}", then)))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broken"))

    def step(now: Column, turn: Column) -> Column:
        then = F.try_element_at(table_, F.concat(now["state"], F.lit("\n"), turn["role"]))
        return F.struct(F.coalesce(then, F.lit("broken")).alias("state"), (now["at"] + 1).alias("at"), F.when(now["broken"].isNull() & then.isNull(), now["at"]).otherwise(now["broken"]).alias("broken"))

    walked = chats.select("conv_id", "turns", F.aggregate("turns", start, step).alias("end"), F.transform("turns", lambda t: _turn(t, template)).alias("parts"))
    pieces = F.transform("parts", lambda p: F.array(F.struct(p["before"].alias("text"), F.lit(False).alias("loss")), F.struct(p["text"].alias("text"), p["loss"].alias("loss")), F.struct(p["after"].alias("text"), F.lit(False).alias("loss"))))
    return walked.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.filter(F.flatten(pieces), lambda s: s["text"] != "").alias("segments"),
        (F.col("end.broken").isNull() & F.col("end.state").isin(*ends)).alias("valid"),
        F.col("end.broken").alias("broken_at"),
    )


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation."""
    opening = "|".join(re.escape(m) for m in sorted([*(b for b, _, _ in template.values()), OTHER[0]], key=len, reverse=True))
    cut = F.filter(F.split(formatted, f"(?={opening})"), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(len(OTHER[0]) + 1))
        at = F.instr(body, OTHER[1])
        out = F.struct(unescape(F.substr(body, F.lit(1), at - 1), template).alias("role"), unescape(F.substr(body, at + len(OTHER[1])), template).alias("text"))
        for name, (before, after, _) in template.items():
            own = F.struct(F.lit(name).alias("role"), unescape(F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after)), template).alias("text"))
            out = F.when(x.startswith(before), own).otherwise(out)
        return out

    return F.transform(cut, turn)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, read back from what the formatter gives."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mine = spark.range(0, 2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_chats(rows.unionByName(mine))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = done.select("conv_id", "formatted", "valid", read_back(F.col("formatted")).alias("turns"), F.array_join(loss, "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), long AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|/?ROLE\])', '\1\\\2\3', 'g'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 13 + length(role) END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN prior IS NULL WHEN 'user' THEN prior IS NULL OR prior IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(prior = 'user', false) ELSE false END AND (back > 1 OR role = 'assistant')) AS valid
FROM long GROUP BY conv_id
"""
