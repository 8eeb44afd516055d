"""Chat formatting of preference pairs.

The chosen and the rejected conversation of a pair share their first turns. The longest common prefix of
whole turns is rendered once, as the prompt; what follows on either side is rendered as a completion,
turn by turn, and only turns of the assistant carry loss. Everything is a Spark SQL expression.

Cases: a null role or text is an empty string. Turns are ordered by turn, role and text; repeated turns stay.
Equal conversations give two empty completions; if one side begins with the whole other side, that one's
completion is empty. A missing side is an empty conversation. Turns without a conv_id belong to no
conversation and give no row. Extra columns are ignored. One conversation is one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) from one row per turn."""
    told = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    grouped = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    return grouped.select("conv_id", F.transform("said", lambda s: F.struct(s["role"], s["text"])).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _parts(turns: Column) -> Column:
    """Role, rendered length and loss flag of every turn of a completion."""
    return F.transform(
        turns,
        lambda t: F.struct(
            t["role"].alias("role"), F.length(rendered(t)).alias("length"), (t["role"] == "assistant").alias("loss")
        ),
    )


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Prompt and completions of ``pairs`` (pair_id, chosen, rejected: arrays of role and text).

    Columns: pair_id, prompt_turns, prompt, chosen, rejected, chosen_parts, rejected_parts. The parts tell
    for each turn of a completion how many characters it has and whether they count for the loss.
    """
    none = F.array().cast(f"array<{TURN}>")
    sides = pairs.select(
        "pair_id", F.coalesce(F.col("chosen"), none).alias("_chosen"), F.coalesce(F.col("rejected"), none).alias("_rejected")
    )
    same = F.zip_with("_chosen", "_rejected", lambda a, b: a.eqNullSafe(b))
    first_other = F.array_position(same, False)
    shared = sides.withColumn(
        "prompt_turns", F.when(first_other == 0, F.size("_chosen")).otherwise(first_other - 1).cast("int")
    )
    rest = lambda side: F.slice(side, F.col("prompt_turns") + 1, F.size(side))
    split = shared.select(
        "pair_id", "prompt_turns", F.slice("_chosen", F.lit(1), F.col("prompt_turns")).alias("_prompt"),
        rest("_chosen").alias("_chosen"), rest("_rejected").alias("_rejected"),
    )
    return split.select(
        "pair_id", "prompt_turns", _text(F.col("_prompt")).alias("prompt"),
        _text(F.col("_chosen")).alias("chosen"), _text(F.col("_rejected")).alias("rejected"),
        _parts(F.col("_chosen")).alias("chosen_parts"), _parts(F.col("_rejected")).alias("rejected_parts"),
    )


def pairs_from_conversations(turns: DataFrame) -> DataFrame:
    """A preference pair per conversation.

    The conversation itself is chosen. In the rejected one its last assistant turn is replaced by the last
    assistant turn of the conversation with the next id, and left out if there is none.
    """
    own = conversations_of(turns)
    size = F.size("turns")
    from_end = F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == "assistant"), True)
    marked = own.withColumn("_last", F.when(from_end > 0, size - from_end).cast("int"))
    answers = marked.select(
        (F.col("conv_id") - 1).alias("conv_id"), F.get("turns", F.col("_last"))["text"].alias("_other")
    ).where(F.col("_other").isNotNull())
    both = marked.join(answers, "conv_id", "left")
    replaced = F.transform(
        "turns",
        lambda t, i: F.when(i == F.col("_last"), F.struct(t["role"], F.col("_other").alias("text"))).otherwise(t),
    )
    return both.select(
        F.col("conv_id").alias("pair_id"),
        F.col("turns").alias("chosen"),
        F.filter(replaced, lambda t: t["text"].isNotNull()).alias("rejected"),
    )


def told(parts: str) -> Column:
    """Parts as text: role:length:loss, comma-joined."""
    line = lambda p: F.concat_ws(":", p["role"], p["length"].cast("string"), p["loss"].cast("int").cast("string"))
    return F.array_join(F.transform(parts, line), ",")


PREFERENCE_SQL = """
with said as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as i,
        coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null),
last as (select conv_id, max(i) filter (where role = 'assistant') as li from said group by 1),
answer as (select s.conv_id, s.text from said s join last l on l.conv_id = s.conv_id and s.i = l.li),
other as (select s.conv_id, row_number() over (partition by s.conv_id order by s.i) - 1 as i, s.role,
        case when s.i = l.li then a.text else s.text end as text
    from said s join last l using (conv_id) left join answer a on a.conv_id = s.conv_id + 1
    where not (l.li is not null and s.i = l.li and a.conv_id is null)),
shared as (select conv_id, coalesce(min(i) filter (where not same), count(*)) as n
    from (select coalesce(s.conv_id, o.conv_id) as conv_id, coalesce(s.i, o.i) as i,
            coalesce(s.role = o.role and s.text = o.text, false) as same
        from said s full join other o on o.conv_id = s.conv_id and o.i = s.i)
    group by 1),
shown as (select side, conv_id, i, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as line, n
    from (select 'c' as side, * from said union all select 'r', * from other) join shared using (conv_id))
select conv_id as pair_id, any_value(n)::int as prompt_turns,
    coalesce(string_agg(line, '' order by i) filter (where side = 'c' and i < n), '') as prompt,
    coalesce(string_agg(line, '' order by i) filter (where side = 'c' and i >= n), '') as chosen,
    coalesce(string_agg(line, '' order by i) filter (where side = 'r' and i >= n), '') as rejected,
    coalesce(string_agg(role || ':' || length(line) || ':' || (role = 'assistant')::int, ',' order by i)
        filter (where side = 'c' and i >= n), '') as chosen_parts,
    coalesce(string_agg(role || ':' || length(line) || ':' || (role = 'assistant')::int, ',' order by i)
        filter (where side = 'r' and i >= n), '') as rejected_parts
from shown group by conv_id
"""
