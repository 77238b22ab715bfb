"""Chat formatting with a grammar round trip.

Template: each turn is `<|im_start|>`, the role, a line end, the text,
`<|im_end|>` and a line end. The parser is deterministic: it cuts
at every mark, takes what stands behind the first, third and so on as a turn,
the role up to the first line end, and undoes the escapes. A turn is rendered as it is, the
result is parsed, and only where the turn read back differs from the source is
its content escaped (see `escape_text`, `escape_role`) and tried again. The rendered conversation is
parsed once more as a whole; a difference is an error, never a silent change.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_MARK = r"<(\\*)\|"


def escape_text(s: Column) -> Column:
    """One more backslash between `<` and `|`, with any number of backslashes there."""
    return F.regexp_replace(s, _MARK, r"<\\$1|")


def unescape_text(s: Column) -> Column:
    return F.regexp_replace(s, r"<\\(\\*)\|", "<$1|")


def escape_role(s: Column) -> Column:
    """Two backslashes for one, backslash and `n` for a line end, backslash and `p` for a bar."""
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(s: Column) -> Column:
    pieces = F.split(s, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation: what stands behind the first mark, the third, and so on."""
    pieces = F.split(formatted, r"<\|im_(?:start|end)\|>", -1)
    turns = F.filter(pieces, lambda t, i: i % 2 == 1)
    return F.transform(turns, lambda t: F.struct(unescape_role(F.substring_index(t, "\n", 1)).alias("role"), unescape_text(F.regexp_replace(t, r"^[^\n]*\n", "")).alias("text")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start, end in code points of `formatted`).

    The spans hold the texts of the roles in `learn`, without markers and role.
    Turns stand by turn (null first); equal turns by role, then text. Null text
    or role counts as empty; rows without conv_id are one conversation. A
    conversation is one row of output, so its size is the bound of a group.
    Empty tables give no rows; other columns are not looked at.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = parse(render(F.col("role"), F.col("text")))
    same = F.coalesce((F.size(plain) == 1) & (plain[0]["role"] == F.col("role")) & (plain[0]["text"] == F.col("text")), F.lit(False))
    tried = rows.withColumn("same", same).select(
        "conv_id", "turn", "role", "text", F.when(F.col("same"), F.col("role")).otherwise(escape_role(F.col("role"))).alias("role_out"),
        F.when(F.col("same"), F.col("text")).otherwise(escape_text(F.col("text"))).alias("text_out"))
    shown = tried.withColumn("shown", render(F.col("role_out"), F.col("text_out")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("shown")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = before + len(START) + F.length("role_out") + 1
    placed = shown.select("conv_id", F.row_number().over(order).alias("nr"), "role", "text", "shown",
                          F.when(F.col("role").isin(*learn), F.struct(begin.alias("start"), (begin + F.length("text_out")).alias("end"))).alias("span"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nr", "role", "text", "shown", "span"))).alias("t"))
    formatted = whole.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.array_join("t.shown", "").alias("formatted"),
                             F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
                             F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"))
    kept = F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("not read back as written: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string"))
    return formatted.select("conv_id", "n_turns", kept.alias("formatted"), "loss_spans")


def masked(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the spans, once each, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
