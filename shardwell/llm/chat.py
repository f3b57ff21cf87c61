"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows on either side is rendered as a
completion with a mask: the character spans that training should score, which are the assistant's words and the
mark that ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# How a turn is written.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
SCORED = "assistant"


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The turns of each conversation as an array, and those without an id each as an array of its own."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    told = rows.select(F.col(id_col).alias("id"), turn.alias("t"))
    return told.filter("id is not null").groupBy("id").agg(F.sort_array(F.collect_list("t")).alias(name)), told.filter("id is null").select("id", F.array("t").alias(name))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """Spans (start, end) of the rendered turns that are scored."""
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(CLOSE)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(s, t):
        start = s["at"] + head(t)
        stop = start + F.length(t["text"]) + len(END) - 1
        span = F.array(F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("end")))
        return F.struct((stop + 1).cast("bigint").alias("at"), F.when(t["role"] == SCORED, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def preferences(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation id on either side: id, shared_turns, prompt, chosen, rejected, chosen_mask,
    rejected_mask (arrays of start and end in the completion's characters).

    Turns go by number (null first), then role and text, so repeated numbers and repeated rows all stay; they are
    equal if role and text are. A null role or text counts as empty. A turn without an id belongs to no conversation:
    it is one by itself, on its side alone. A side that lacks the id has no turns, so the prompt is empty. Equal sides
    give two empty completions. A conversation is one row of the result, so its turns come together; nothing else does.
    """
    left, lone_left = _turns(chosen, id_col, turn_col, role_col, text_col, "a")
    right, lone_right = _turns(rejected, id_col, turn_col, role_col, text_col, "b")
    none = F.array().cast(left.schema["a"].dataType)
    both = left.alias("l").join(right.alias("r"), F.col("l.id") == F.col("r.id"), "full_outer")
    both = both.select(F.coalesce("l.id", "r.id").alias("id"), F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    both = both.union(lone_left.select("id", "a", none.alias("b"))).union(lone_right.select("id", none.alias("a"), "b"))
    least = F.least(F.size("a"), F.size("b"))
    unlike = F.filter(F.sequence(F.lit(0), least), lambda i: (i < least) & ((F.get("a", i)["role"] != F.get("b", i)["role"]) | (F.get("a", i)["text"] != F.get("b", i)["text"])))
    both = both.withColumn("shared_turns", F.coalesce(F.array_min(unlike), least))
    rest = lambda c: F.slice(c, F.col("shared_turns") + 1, F.greatest(F.size(c) - F.col("shared_turns"), F.lit(0)))
    both = both.withColumns({"prompt": render(F.slice("a", 1, F.col("shared_turns"))), "a": rest("a"), "b": rest("b")})
    return both.select("id", "shared_turns", "prompt", render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"), mask(F.col("a")).alias("chosen_mask"), mask(F.col("b")).alias("rejected_mask"))


def swapped(conversations: DataFrame) -> DataFrame:
    """Rejected conversations for a table that has none: each conversation with the text of its last assistant
    turn replaced by that of its neighbour's (conv_id xor 1) last assistant turn; without such a turn next
    door, that turn is missing."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    last = conversations.filter((F.col("role") == SCORED) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    own = last.select(F.col("conv_id").alias("own_id"), F.col("last.turn").alias("own_turn"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("other_id"), F.col("last.text").alias("other_text"))
    told = conversations.filter("conv_id is not null").join(own, F.col("conv_id") == F.col("own_id"), "left").join(other, F.col("conv_id") == F.col("other_id"), "left")
    swap = F.coalesce((F.col("role") == SCORED) & F.col("turn").eqNullSafe(F.col("own_turn")), F.lit(False))
    told = told.filter(~swap | F.col("other_text").isNotNull())
    # a turn without an id has no neighbour: an assistant's is missing, others stay
    lone = conversations.filter(F.col("conv_id").isNull() & ~F.coalesce(F.col("role") == SCORED, F.lit(False)))
    return told.select("conv_id", "turn", "role", F.when(swap, F.col("other_text")).otherwise(F.col("text")).alias("text")).union(lone)


def op2_preferences(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    pairs = preferences(conversations, swapped(conversations))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.select(F.col("id").alias("conv_id"), "shared_turns", "prompt", "chosen", "rejected", written(F.col("chosen_mask")).alias("chosen_mask"), written(F.col("rejected_mask")).alias("rejected_mask"))


# A turn without an id gets a number of its own in place of the id: negative, and no two sides' alike.
OP2_SQL = """
with last as (
  select conv_id, arg_max(coalesce(text, ''), (turn is not null, turn, coalesce(text, ''))) as text, arg_max(struct_pack(turn := turn), (turn is not null, turn)).turn as turn
  from conversations where role = 'assistant' and conv_id is not null group by conv_id),
rejected as (
  select c.conv_id, c.turn, c.role, case when c.role = 'assistant' and c.turn is not distinct from o.turn and o.conv_id is not null then n.text else c.text end as text
  from conversations c left join last o on c.conv_id = o.conv_id left join last n on c.conv_id = xor(n.conv_id, 1)
  where c.conv_id is not null and (not coalesce(c.role = 'assistant' and c.turn is not distinct from o.turn and o.conv_id is not null, false) or n.text is not null)
  union all select conv_id, turn, role, text from conversations where conv_id is null and coalesce(role <> 'assistant', true)),
c as (select coalesce(cast(conv_id as hugeint) * 3, -3 * row_number() over () - 1) as own, * from conversations),
r as (select coalesce(cast(conv_id as hugeint) * 3, -3 * row_number() over () - 2) as own, * from rejected),
a as (select own, conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by own order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k from c),
b as (select own, conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by own order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k from r),
x as (select own, conv_id, k from a union select own, conv_id, k from b),
shared as (
  select x.own, x.conv_id, coalesce(min(case when a.role is distinct from b.role or a.text is distinct from b.text then x.k end) - 1, max(x.k)) as shared
  from x left join a on a.own = x.own and a.k = x.k left join b on b.own = x.own and b.k = x.k group by x.own, x.conv_id),
sides as (
  select 'a' as side, a.own, a.k, a.role, a.text, s.shared from a join shared s on a.own = s.own
  union all select 'b', b.own, b.k, b.role, b.text, s.shared from b join shared s on b.own = s.own),
written as (
  select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as line,
         coalesce(sum(case when k > shared then length(role) + length(text) + 13 else 0 end)
           over (partition by side, own order by k rows between unbounded preceding and 1 preceding), 0) + length(role) + 5 as start
  from sides),
put as (
  select own, string_agg(case when side = 'a' and k <= shared then line end, '' order by k) as prompt,
         string_agg(case when side = 'a' and k > shared then line end, '' order by k) as chosen, string_agg(case when side = 'b' and k > shared then line end, '' order by k) as rejected,
         string_agg(case when side = 'a' and k > shared and role = 'assistant' then cast(start as bigint) || ':' || cast(start + length(text) + 7 as bigint) end, ',' order by k) as chosen_mask,
         string_agg(case when side = 'b' and k > shared and role = 'assistant' then cast(start as bigint) || ':' || cast(start + length(text) + 7 as bigint) end, ',' order by k) as rejected_mask
  from written group by own)
select conv_id, cast(shared as integer) as shared_turns, coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected,
       coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask
from shared join put using (own)
"""
