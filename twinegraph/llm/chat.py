"""Operator 8: chat formatting with Spark expressions only.

Template, one block per run of turns with the same role::

    ### {role}\\n{text}</turn>{text}</turn>\\n

Texts and roles are escaped so that neither ``#`` nor ``<`` is left in them:
``\\`` becomes ``\\b``, ``#`` becomes ``\\h``, ``<`` becomes ``\\l`` and, in
roles, a line end becomes ``\\n``. No control string can then come from a text,
and undoing the four replacements in reverse order gives the text back exactly.
The loss mask covers the texts of assistant blocks, without their markers.

Turns are collected per conversation and sorted by (turn, role, text), nulls first; adjacent turns of one
role are merged by array functions, and the blocks are concatenated. Offsets are running sums over an array,
made in chunks so that the work on a conversation stays about linear in its length. The query's loss columns are
cut out of the formatted text by the mask, over a copy of four bytes per character in which a place is found at once.
A conversation's output is one value, so it must fit one row (500 million characters).

Defined results: a null text or role is empty; rows with a null conv_id form
one conversation; equal rows are all kept; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

START, END = "### ", "</turn>"
#: Fixed values of the template: what stands for each escaped character.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
LEARNED_ROLE = "assistant"


def escape(c: Column, line: bool = False) -> Column:
    for raw, safe in ESCAPES + ([("\n", "\\n")] if line else []):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, line: bool = False) -> Column:
    for raw, safe in reversed(ESCAPES + ([("\n", "\\n")] if line else [])):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


#: Numbers that a running sum copies at a time.
CHUNK = 256


def running_sum(x: Column) -> Column:
    """The sums of an array's first 1, 2, ... numbers; arrays are immutable, so an append copies, and appends stay within a chunk."""
    last = lambda a: F.element_at(a, -1)
    add = lambda a, v: F.array_append(a, last(a) + v)
    zero = F.lit(0).cast("long")

    def over(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, v: a + v))
        before = F.aggregate(sums, F.array(zero), add)
        return let(before, lambda b: F.flatten(F.transform(chunks, lambda c, k: F.slice(F.aggregate(c, F.array(F.get(b, k)), add), 2, CHUNK))))

    n = F.ceil(F.size(x) / CHUNK).cast("int")
    return let(F.transform(F.sequence(F.lit(1), n), lambda k: F.slice(x, (k - 1) * CHUNK + 1, F.lit(CHUNK))), over)


def _merged(t: Column) -> Column:
    """One struct (head, safe, tail, learned) per turn: the first turn of a role's run opens the block, the last one closes it."""
    role = lambda i: F.element_at(t, i)["role"]
    opens = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (role(i) != role(F.greatest(i - 1, F.lit(1)))))

    def blocks(starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(t) + 1)
        return F.transform(starts, lambda s, j: F.struct(role(s).alias("role"), F.slice(t, s, end(j) - s).alias("turns")))

    def pieces(b: Column) -> Column:
        n = F.size(b["turns"])
        return F.transform(b["turns"], lambda x, i: F.struct(
            F.when(i == 0, F.concat(F.lit(START), escape(b["role"], line=True), F.lit("\n"))).otherwise("").alias("head"),
            escape(x["text"]).alias("safe"),
            F.when(i + 1 == n, END + "\n").otherwise(END).alias("tail"),
            (b["role"] == LEARNED_ROLE).alias("learned")))

    return F.flatten(F.transform(let(opens, blocks), pieces))


def _shown(p: Column) -> Column:
    """struct(formatted, loss_spans) of a conversation's pieces."""
    whole = F.transform(p, lambda x: F.concat(x["head"], x["safe"], x["tail"]))
    spans = lambda ends: F.transform(p, lambda x, i: F.struct((F.get(ends, i) - F.length(x["tail"]) - F.length(x["safe"])).alias("start"), (F.get(ends, i) - F.length(x["tail"])).alias("end"), x["learned"].alias("learned")))
    mask = lambda ends: F.transform(F.filter(spans(ends), lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return let(whole, lambda w: F.struct(F.array_join(w, "").alias("formatted"), let(running_sum(F.transform(w, lambda x: F.length(x).cast("long"))), mask).alias("loss_spans")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end of each assistant text in ``formatted``, code points)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # a generator, so that both columns come from one evaluation
    return collected.select("conv_id", F.inline(F.array(let(F.col("t"), lambda t: let(_merged(t), _shown)))))


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, turns: the (role, text) pairs that ``formatted`` holds, in order, unescaped; formatted and loss_spans pass through."""
    blocks = F.filter(F.split("formatted", START), lambda b: b != "")
    line = lambda b: F.instr(b, "\n")
    texts = lambda b: F.split(b.substr(line(b) + 1, F.length(b)), END)
    pairs = F.flatten(F.transform(blocks, lambda b: let(texts(b), lambda parts: F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda t: F.struct(unescape(b.substr(F.lit(1), line(b) - 1), line=True).alias("role"), unescape(t).alias("text")),
    ))))
    return formatted.select("conv_id", "formatted", "loss_spans", F.length("formatted").cast("long").alias("formatted_chars"), pairs.alias("turns"))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All that the mask covers, unescaped. A character takes four bytes in the copy that is cut, so no span is counted for from the start."""
    part = lambda x, s: F.decode(x.substr((s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32")
    return let(F.encode(formatted, "UTF-32"), lambda x: F.array_join(F.transform(spans, lambda s: unescape(part(x, s))), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """The query's columns: turns read from the formatted text, the loss from what the mask covers of it."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_turns(formatted).select("conv_id", "formatted_chars", "turns", F.explode(F.array(learned_text(F.col("formatted"), F.col("loss_spans")))).alias("learned"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: A conversation whose texts hold control strings.
TRAP = "\\### Assistant: </turn> ok"


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the trap, formatted, then read back from the formatted text."""
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return digests(format_conversations(turns))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, row_number() OVER w AS nth, lag(role) OVER w AS prev,
    length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS safe,
    length(role) + length(regexp_replace(role, '[^\\#<\n]', '', 'g')) AS role_chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(safe + 7 + CASE WHEN prev IS NULL OR prev <> role THEN role_chars + 6 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
