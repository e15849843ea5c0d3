"""Preference formatting: one prompt, two masked completions.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns (role and text) is rendered once as the prompt; what follows in either is
a completion, with the spans of its characters that are trained on: the texts of
assistant turns with their end mark. All of it is DataFrame code; a conversation
is put together by a partial aggregation of its own turns only.

``format_pairs`` takes pairs of conversations. ``format_swapped`` makes them,
where no preferences are known: chosen is each conversation as it is, rejected
the same turns up to its last assistant turn, answered with the last answer of
the conversation of the next id. The join is on ids, one row to one.

Defined results: turns are ordered by number, then role and text; repeated rows
count once; a null role is ``unknown`` and a null text empty; conversations
that are equal, or one a prefix of the other, have an empty completion; pairs
that lack a side are left out; without a next id, or an answer in it, rejected
ends before the answer, without an assistant turn it is the conversation; spans
are start:end of code points, end exclusive; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _rendered(turns: str) -> Column:
    """Text of turns; ``turns`` is an SQL expression of an array of them."""
    return F.expr(f"array_join(transform({turns}, x -> concat('{OPEN}', x.role, '{MIDDLE}', x.text, '{END}')), '')").alias("r")


def _spans(turns: str, trained: str) -> Column:
    """start:end of what is trained on, comma-joined."""
    head, tail = len(OPEN) + len(MIDDLE), len(END)
    step = f"s.at + {head} + char_length(x.role)"
    whole = f"{step} + char_length(x.text) + {tail}"
    folded = f"aggregate({turns}, named_struct('at', 0, 'out', cast(array() as array<string>)), (s, x) -> named_struct('at', {whole}, 'out', if(x.role = '{trained}', concat(s.out, array(concat({step}, ':', {whole}))), s.out)), s -> s.out)"
    return F.expr(f"array_join({folded}, ',')")


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns: ordered turns of each conversation."""
    one = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_set(one)).alias("turns"))


def _formatted(both: DataFrame, trained: str) -> DataFrame:
    """pair_id, chosen_id, rejected_id, turns ``a`` and ``b`` -> what is asked."""
    same = "transform(sequence(1, greatest(1, least(size(a), size(b)))), i -> coalesce(get(a, i - 1).role = get(b, i - 1).role and get(a, i - 1).text = get(b, i - 1).text, false))"
    both = both.withColumn("differs", F.expr(f"array_position({same}, false)")).withColumn("n_prefix", F.expr("cast(if(differs = 0, least(size(a), size(b)), differs - 1) as int)"))
    rest = "slice({0}, n_prefix + 1, greatest(size({0}), 1))"
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_prefix", _rendered("slice(a, 1, n_prefix)").alias("prompt"),
        _rendered(rest.format("a")).alias("chosen"), _spans(rest.format("a"), trained).alias("chosen_spans"),
        _rendered(rest.format("b")).alias("rejected"), _spans(rest.format("b"), trained).alias("rejected_spans"),
    )


def format_pairs(turns: DataFrame, pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """``pairs`` (pair_id, chosen_id, rejected_id) -> pair_id, n_prefix, prompt
    and both completions with their spans."""
    whole = conversations_of(turns)
    a = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    b = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    return _formatted(pairs.select("pair_id", "chosen_id", "rejected_id").join(a, "chosen_id").join(b, "rejected_id"), trained)


def format_swapped(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Each conversation against itself with another's last answer: a pair per
    conversation, under its id; rejected_id is the one that answered."""
    last = F.expr(f"array_max(transform(turns, (x, i) -> if(x.role = '{trained}', i + 1, 0)))")
    whole = written(conversations_of(turns).withColumn("last", last), "preference-turns")
    donors = whole.filter("last > 0 and conv_id is not null").select((F.col("conv_id") - 1).alias("conv_id"), F.col("conv_id").alias("donor"), F.expr("turns[last - 1].text").alias("answer"))
    both = whole.join(donors, "conv_id", "left")
    given = F.expr(f"if(answer is null, slice(turns, 1, 0), array(named_struct('turn', turns[last - 1].turn, 'role', '{trained}', 'text', answer)))")
    swapped = F.when(F.col("last") > 0, F.concat(F.expr("slice(turns, 1, last - 1)"), given)).otherwise(F.col("turns"))
    return _formatted(both.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.when(F.col("last") > 0, F.col("donor")).alias("rejected_id"), F.col("turns").alias("a"), swapped.alias("b")), trained)


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_swapped(table(spark, sf_dir, "conversations"))


_RENDER = "coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k) FILTER ({0}), '')"
_SPANS = "coalesce(string_agg((pos - len) || ':' || pos, ',' ORDER BY k) FILTER ({0} AND role = 'assistant'), '')"
SQL = {
    "op2_preference": f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
c AS (SELECT conv_id, max(k) AS m, coalesce(max(k) FILTER (role = 'assistant'), 0) AS la FROM n GROUP BY conv_id),
g AS (SELECT c.conv_id, n.text FROM c JOIN n ON n.conv_id = c.conv_id AND n.k = c.la),
e AS (SELECT n.conv_id, true AS mine, k, role, text FROM n
      UNION ALL SELECT n.conv_id, false, k, role, text FROM n JOIN c USING (conv_id) WHERE la = 0 OR k < la
      UNION ALL SELECT c.conv_id, false, la, 'assistant', g.text FROM c JOIN g ON g.conv_id = c.conv_id + 1 WHERE la > 0),
d AS (SELECT a.conv_id, min(a.k) AS k FROM e a JOIN e b ON b.conv_id = a.conv_id AND a.mine AND NOT b.mine AND a.k = b.k WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.conv_id),
h AS (SELECT conv_id, max(k) FILTER (mine) AS ma, coalesce(max(k) FILTER (NOT mine), 0) AS mb FROM e GROUP BY conv_id),
q AS (SELECT h.conv_id, CAST(coalesce(d.k - 1, least(ma, mb)) AS INTEGER) AS n_prefix FROM h LEFT JOIN d USING (conv_id)),
s AS (SELECT e.*, n_prefix, length(text) + 8 AS len, sum(CASE WHEN k > n_prefix THEN length(role) + length(text) + 13 ELSE 0 END) OVER (PARTITION BY conv_id, mine ORDER BY k) AS pos FROM e JOIN q USING (conv_id))
SELECT s.conv_id AS pair_id, s.conv_id AS chosen_id, any_value(o.id) AS rejected_id, any_value(n_prefix) AS n_prefix,
  {_RENDER.format('mine AND k <= n_prefix')} AS prompt,
  {_RENDER.format('mine AND k > n_prefix')} AS chosen, {_SPANS.format('mine AND k > n_prefix')} AS chosen_spans,
  {_RENDER.format('NOT mine AND k > n_prefix')} AS rejected, {_SPANS.format('NOT mine AND k > n_prefix')} AS rejected_spans
FROM s LEFT JOIN (SELECT c.conv_id, g.conv_id AS id FROM c JOIN g ON g.conv_id = c.conv_id + 1 WHERE la > 0) o ON o.conv_id = s.conv_id GROUP BY s.conv_id"""
}
