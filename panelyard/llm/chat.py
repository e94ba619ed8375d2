"""Chat formatting with a grammar round trip.

Grammar:  conversation := turn*      turn := "<s>" role NEWLINE text "</s>"

Inside a role or text a backslash makes the next character literal. The rendered text is read
back by a deterministic parser (split at the turn marks, split at the first bare newline,
drop backslashes), and the recovered turns are compared with the source. Content that holds a
control string, or does not come back as it was, is escaped more, level by level, until it does:
level 0 as it is; level 1 with the control strings broken up and backslashes doubled; level 2
with a backslash before every character that occurs in a control string. Only DataFrame
functions are used.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LOSS_ROLES = ("assistant",)


def _level_1(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        c = F.replace(c, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return c


def _level_2(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\<>\[\]/\n])", r"\\$1")


LEVELS = (lambda c: c, _level_1, _level_2)


def _holds_control(c: Column) -> Column:
    return reduce(or_, [F.contains(c, F.lit(mark)) for mark in CONTROL])


def _render(turns: Column, escape) -> Column:
    """Newlines of a role are always escaped, as the first bare one ends the role."""
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")) if escape is not _level_2 else escape(t["role"])
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), role(t), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))), ""
    )


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a rendered conversation holds."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: F.startswith(p, F.lit(OPEN)))
    head = r"(?s)\A<s>((?:[^\\\n]|\\.)*)\n"

    def turn(p: Column) -> Column:
        start = F.regexp_extract(p, head, 0)
        return F.struct(
            _plain(F.regexp_extract(p, head, 1)).alias("role"),
            _plain(F.substring(p, F.char_length(start) + 1, F.char_length(p))).alias("text"),
        )

    return F.transform(pieces, turn)


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, turns (array of role, text, by turn), level (of
    escaping), formatted, recovered (the turns read back from ``formatted``).

    Null roles and texts are empty. Null turns come first; rows that tie on the turn are put
    in order of role and text, and repeated rows are turns of their own. Rows with a null
    conversation form one conversation. No rows give no conversations. A conversation is one
    value of the result and has to fit a row; nothing larger is gathered.
    """
    source = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = source.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )
    tried = grouped
    for n, escape in enumerate(LEVELS):
        done = F.lit(False) if n == 0 else F.col("level").isNotNull()
        rendered = _render(F.col("turns"), escape)
        tried = tried.withColumn(f"_r{n}", F.when(~done, rendered)).withColumn(f"_p{n}", parse(F.col(f"_r{n}")))
        fits = F.col(f"_p{n}") == F.col("turns")
        if n == 0:  # the parser reads most control strings back, but none may stand bare
            fits = fits & ~F.exists("turns", lambda t: _holds_control(t["role"]) | _holds_control(t["text"]))
        fits = F.when(fits, n)
        tried = tried.withColumn("level", fits if n == 0 else F.coalesce("level", fits))
    formatted = F.coalesce(*[F.when(F.col("level") == n, F.col(f"_r{n}")) for n in range(len(LEVELS))], F.raise_error(F.lit("no escaping brings the turns back")).cast("string"))
    recovered = F.coalesce(*[F.when(F.col("level") == n, F.col(f"_p{n}")) for n in range(len(LEVELS))])
    return tried.select("conv_id", "turns", "level", formatted.alias("formatted"), recovered.alias("recovered"))


def loss_texts(recovered: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(F.filter(recovered, lambda t: t["role"].isin(*LOSS_ROLES)), lambda t: t["text"])
