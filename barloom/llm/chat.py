r"""Chat formatting by prefix-target expansion. DataFrame functions only.

Every assistant turn becomes an example: all turns before it are context, its own text is
the only trainable part. Turns after the last assistant turn make one more example without a
target, so that the output holds every turn.

    <s>[SYS] text [/SYS]
    [INST] text [/INST]
    [OUT] text </s>
    [ROLE:hex] text [/ROLE]         any other role, named in hexadecimal; ``-`` for null

A control string inside a text gets a backslash after its first character. One that has
backslashes there already gets one more, so taking one away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_CONTROL = r"(/?(?:s>|(?:INST|SYS|OUT|ROLE(?::[0-9A-F-]*)?)\]))"
MARKS = {"system": ("SYS", "[/SYS]"), "user": ("INST", "[/INST]"), "assistant": ("OUT", "</s>")}
_TURN = r"(?s)\[(INST|SYS|OUT|ROLE:[0-9A-F-]*)\] (.*?) (?:\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _by_role(role: Column, pick: int, other: Column) -> Column:
    out = other
    for name, marks in MARKS.items():
        mark = f"[{marks[0]}]" if pick == 0 else marks[1]
        out = F.when(role.eqNullSafe(F.lit(name)), F.lit(mark)).otherwise(out)
    return out


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_end`` from rows of turns.

    The mask is the stretch of ``formatted`` (code points, end exclusive) with the target's
    text; both ends are null in an example without a target. A null text is empty; turns go by
    number, then role and text, nulls first, and repeated turns stay. Other columns are not
    read. A conversation is one row while it is formatted; its examples repeat its beginning
    as often as it has replies, which is what prefix expansion asks for.
    """
    body = escape(F.coalesce(F.col(text), F.lit("")))
    other = F.concat(F.lit("[ROLE:"), F.coalesce(F.hex(F.col(role).cast("binary")), F.lit("-")), F.lit("]"))
    shown = F.concat(_by_role(F.col(role), 0, other), F.lit(" "), body, F.lit(" "),
                     _by_role(F.col(role), 1, F.lit("[/ROLE]")))
    each = F.struct(F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("t"),
                    shown.alias("shown"), F.char_length(body).alias("size"))
    convs = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(each)).alias("turns"))
    total = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), total),
                       lambda i: F.element_at("turns", i)["r"].eqNullSafe(F.lit("assistant")) | (i == total))
    one = convs.select("conv_id", "turns", F.posexplode(replies).alias("example", "last"))
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform(
        F.slice("turns", F.lit(1), F.col("last")), lambda t: t["shown"]), "\n"))
    target = F.element_at("turns", F.col("last"))
    one = one.select("conv_id", "example", formatted.alias("formatted"), target["size"].alias("size"),
                     target["r"].eqNullSafe(F.lit("assistant")).alias("trains"))
    end = F.char_length("formatted") - len(" </s>")
    return one.select("conv_id", "example", "formatted",
                      F.when(F.col("trains"), end - F.col("size")).alias("loss_start"),
                      F.when(F.col("trains"), end).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn of a formatted example; a null role comes back as null."""
    names = {marks[0]: name for name, marks in MARKS.items()}

    def role(mark: Column) -> Column:
        out = F.when(mark == "ROLE:-", F.lit(None).cast("string")).otherwise(
            F.unhex(F.substring(mark, 6, 1 << 30)).cast("string"))
        for m, name in names.items():
            out = F.when(mark == m, F.lit(name)).otherwise(out)
        return out

    marks = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.zip_with(marks, bodies, lambda m, b: F.struct(role(m).alias("role"), unescape(b).alias("text")))


def masked(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the mask, as it was before escaping; null without a mask."""
    return unescape(F.substring(formatted, start + 1, end - start))
