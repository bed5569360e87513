"""Chat formatting with Spark expressions only.

A conversation becomes one string. Its turns are collected as structs and sorted, and an array aggregation merges
neighbours of one role into a block, in which a mark keeps their border::

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

In texts, a backslash goes behind each ``<`` that ``|`` or ``\\`` follows, so no text can hold a control
string; taking one backslash from behind each ``<`` undoes it. In roles ``%``, ``<`` and line ends are
percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Elements that an array aggregation adds one by one, which copies what it has; longer arrays are made of such parts.
PART = 512
_SEP_REGEX, _END_REGEX = r"<\|im_sep\|>", r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=[|\\])", r"<\\")


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def _role_out(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_in(role: Column) -> Column:
    for plain, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _in_parts(array: Column) -> Column:
    """An array as an array of arrays of ``PART`` elements."""
    last = F.ceil(F.size(array) / F.lit(float(PART))).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(array, k * PART + 1, F.lit(PART)))


def _merged(turns: Column) -> Column:
    """Structs (role, texts) of neighbouring turns (role, text) of one role. Where two parts meet a block may be in two."""
    nothing = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when((F.size(blocks) > 0) & (last["role"] == turn["role"]), F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(new)))

    return F.flatten(F.transform(_in_parts(turns), lambda part: F.aggregate(part, nothing, add)))


def _before(sizes: Column) -> Column:
    """For each number the sum of those before it."""

    def add(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + x))

    none = F.array(F.lit(0).cast("long"))
    inner = F.transform(_in_parts(sizes), lambda part: F.aggregate(part, none, add))
    base = F.aggregate(inner, none, lambda sums, part: add(sums, F.element_at(part, -1)))
    both = F.zip_with(inner, F.slice(base, 1, F.size(base) - 1), lambda part, b: F.transform(F.slice(part, 1, F.size(part) - 1), lambda x: x + b))
    return F.flatten(both)


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in code points).

    ``turns`` has conv_id, turn, role, text. Turns are ordered by (turn, role, text), nulls first, so ties
    and repeated rows have a defined order and each row stays a turn. A null text or role is empty. Rows
    without conv_id form one conversation whose id is null. An empty table gives no rows. A loss span
    covers the escaped text of one turn, without any control string. Other columns are not read.

    There is one shuffle, by conv_id. A conversation is one value of the result, so it has to meet in one task;
    the work in it grows with its length.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = rows.select("conv_id", _merged(F.col("turns")).alias("blocks"))
    roles = F.transform("blocks", lambda b: b["role"])
    nobody = F.array(F.lit(None).cast("string"))
    placed = F.arrays_zip(
        F.col("blocks"),
        F.concat(nobody, F.slice(roles, 1, F.size(roles) - 1)).alias("previous"),
        F.concat(F.slice(roles, 2, F.size(roles)), nobody).alias("next"),
    )

    def pieces(b: Column) -> Column:
        role, texts = b["blocks"]["role"], b["blocks"]["texts"]

        def piece(text: Column, k: Column) -> Column:
            begins = (k == 0) & ~b["previous"].eqNullSafe(role)
            ends = (k == F.size(texts) - 1) & ~b["next"].eqNullSafe(role)
            return F.struct(
                F.when(begins, F.concat(F.lit(START), _role_out(role), F.lit("\n"))).otherwise(F.lit(SEP)).alias("head"),
                escape(text).alias("text"),
                F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("tail"),
                role.isin(*loss_roles).alias("loss"),
            )

        return F.transform(texts, piece)

    rows = rows.select("conv_id", F.flatten(F.transform(placed, pieces)).alias("pieces"))
    sizes = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["text"]) + F.length(p["tail"])).cast("long"))
    spans = F.zip_with("pieces", _before(sizes), lambda p, at: F.struct((at + F.length(p["head"])).alias("start"), F.length(p["text"]).cast("long").alias("length"), p["loss"].alias("loss")))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, _END_REGEX, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = _role_in(F.substring_index(F.substr(block, F.lit(len(START) + 1)), "\n", 1))
        body = F.substr(block, F.instr(block, "\n") + 1)
        return F.transform(F.split(body, _SEP_REGEX, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
