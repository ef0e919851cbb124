"""Chat rendering from every participant's point of view.

For each participant of a conversation the whole dialogue is rendered once, with that speaker as the assistant, all others
as named users, and a mask that trains on the assistant's words only. A conversation is cut into parts of a fixed span of
turns, so no row and no task holds a whole long one; the parts of one rendering follow each other in the order of ``part``.

DataFrame expressions only. Rules:

* a participant is any speaker but the ``system`` roles, which keep their own name and are never trained on;
* a null or blank speaker is ``unknown``, a null text is empty;
* turns are ordered by (turn, speaker, text); a null turn comes first, in part -1; repeated rows are repeated messages;
* a template marker inside a text or name is broken up (``<|`` becomes ``< |``), so that a text cannot forge a message;
* rows without a conversation id belong to no dialogue and give nothing; a conversation without participants neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS_PER_PART = 256


def _safe(value: Column) -> Column:
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|"), F.lit("< |"))


def render_perspectives(
    conversations: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system_roles: tuple[str, ...] = ("system",),
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """Rows (conversation, perspective, part, n_messages, n_trained, text, mask).

    ``mask`` is an array of (n_chars, trained) that covers ``text`` without gaps: header, content and end of each message.
    The content and the end mark of the assistant's messages are trained on. Other columns are not read.
    """
    name = F.when(F.trim(F.col(speaker)) == "", None).otherwise(F.col(speaker))
    messages = conversations.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("_conv"),
        F.coalesce(F.floor(F.col(turn) / turns_per_part), F.lit(-1)).cast("long").alias("part"),
        F.struct(
            F.col(turn).alias("turn"), _safe(F.coalesce(name, F.lit("unknown"))).alias("speaker"), _safe(F.col(text)).alias("text")
        ).alias("message"),
    )
    is_system = F.col("message.speaker").isin(*system_roles)
    # Distinct (conversation, speaker) pairs: combined map-side, so a busy conversation costs a task one row per speaker.
    people = messages.filter(~is_system).select(F.col("_conv").alias("_owner"), F.col("message.speaker").alias("perspective")).distinct()
    parts = messages.groupBy("_conv", "part").agg(F.array_sort(F.collect_list("message")).alias("messages"))

    def pieces(m: Column) -> Column:
        own = m["speaker"] == F.col("perspective")
        header = F.when(own, F.lit("assistant")).when(m["speaker"].isin(*system_roles), m["speaker"]).otherwise(
            F.concat(F.lit("user name="), m["speaker"])
        )
        return F.struct(
            F.concat(F.lit(OPEN), header, F.lit("\n")).alias("header"),
            F.concat(m["text"], F.lit(CLOSE)).alias("body"),
            F.lit("\n").alias("tail"),
            own.alias("own"),
        )

    rendered = people.join(parts, F.col("_owner") == F.col("_conv")).withColumn("_pieces", F.transform("messages", pieces))
    return rendered.select(
        F.col("_conv").alias(conversation),
        "perspective",
        "part",
        F.size("_pieces").alias("n_messages"),
        F.size(F.filter("_pieces", lambda p: p["own"])).alias("n_trained"),
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["header"], p["body"], p["tail"])), "").alias("text"),
        F.flatten(
            F.transform(
                "_pieces",
                lambda p: F.array(
                    F.struct(F.length(p["header"]).alias("n_chars"), F.lit(False).alias("trained")),
                    F.struct(F.length(p["body"]).alias("n_chars"), p["own"].alias("trained")),
                    F.struct(F.length(p["tail"]).alias("n_chars"), F.lit(False).alias("trained")),
                ),
            )
        ).alias("mask"),
    )


def mask_text(mask: Column) -> Column:
    """A mask as text, one ``length:flag`` per run, for files and comparisons."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["n_chars"], F.lit(":"), m["trained"].cast("int"))), " ")


#: The same rendering in SQL, with the mask as text.
ORACLE = f"""
with m as (
  select conv_id, cast(coalesce(floor(turn / {TURNS_PER_PART}), -1) as bigint) as part, turn,
         replace(case when role is null or trim(role, ' ') = '' then 'unknown' else role end, '<|', '< |') as speaker,
         replace(coalesce(text, ''), '<|', '< |') as body
  from conversations where conv_id is not null
), people as (select distinct conv_id, speaker as perspective from m where speaker <> 'system'),
r as (
  select m.conv_id, perspective, part, turn, speaker, body, speaker = perspective as own,
         '{OPEN}' || case when speaker = perspective then 'assistant' when speaker = 'system' then speaker
                          else 'user name=' || speaker end || chr(10) as header
  from m join people on m.conv_id = people.conv_id
)
select conv_id, perspective, part, count(*) as n_messages, count(*) filter (where own) as n_trained,
       string_agg(header || body || '{CLOSE}' || chr(10), '' order by turn nulls first, speaker, body) as text,
       string_agg(length(header) || ':0 ' || (length(body) + {len(CLOSE)}) || ':' || cast(own as int) || ' 1:0', ' '
                  order by turn nulls first, speaker, body) as mask
from r group by conv_id, perspective, part
"""
