"""Chat formatting in Spark expressions alone.

Turns are collected as structs and sorted by turn (ties by role, then text); adjacent turns of
one role share a block:

    <|start|> role <|body|> text [<|next|> text ...] <|end|>

In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can
occur in them, and both changes can be undone. The loss mask is run-length coded: three runs for
each turn (what stands before its text, the text, what stands after), the middle one under the
mask for the trained role. A null role or text counts as empty; a null turn comes first; a null
conv_id is a conversation of its own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, END = "<|start|>", "<|body|>", "<|next|>", "<|end|>"


def escape(value: str) -> str:
    """SQL for the escaped form of a string expression."""
    return rf"replace(replace({value}, r'\', r'\\'), '<|', r'<\|')"


def unescape(value: str) -> str:
    return rf"regexp_replace({value}, r'\\([\\|])', '$1')"


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and mask (array of length and loss) of every conversation."""
    role = trained_role.replace("\\", "\\\\").replace("'", "\\'")
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    pieces = turns.selectExpr(
        "conv_id",
        f"""transform(turns, (t, i) -> named_struct(
            'before', if(i > 0 and t.role = get(turns, i - 1).role, '{NEXT}', concat('{START}', {escape("t.role")}, '{BODY}')),
            'text', {escape("t.text")},
            'after', if(t.role = get(turns, i + 1).role, '', '{END}'),
            'loss', t.role = '{role}')) as pieces""",
    )
    return pieces.selectExpr(
        "conv_id",
        "array_join(transform(pieces, p -> concat(p.before, p.text, p.after)), '') as formatted",
        """flatten(transform(pieces, p -> array(
            named_struct('length', length(p.before), 'loss', false),
            named_struct('length', length(p.text), 'loss', p.loss),
            named_struct('length', length(p.after), 'loss', false)))) as mask""",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text, loss) from the formatted string and its mask.

    ``loss`` is the mask's word; it is null where the mask's run isn't as long as the text."""
    at = lambda s: s.replace("|", r"\|")
    blocks = formatted.selectExpr("conv_id", "formatted", "mask", f"transform(filter(split(formatted, r'{at(END)}'), b -> b <> ''), b -> split(substr(b, {len(START) + 1}), r'{at(BODY)}', 2)) as blocks")
    texts = blocks.selectExpr("conv_id", "formatted", "mask", f"flatten(transform(blocks, b -> transform(split(b[1], r'{at(NEXT)}'), x -> named_struct('role', b[0], 'text', x)))) as texts")
    return texts.selectExpr("conv_id", "formatted", f"transform(texts, (x, i) -> named_struct('role', {unescape('x.role')}, 'text', {unescape('x.text')}, 'loss', if(get(mask, 3 * i + 1).length = length(x.text), get(mask, 3 * i + 1).loss, null))) as turns")


def digests(back: DataFrame) -> DataFrame:
    """Lengths and SHA-256 digests of what was read back."""
    rows = back.selectExpr("conv_id", "formatted", "turns", "array_join(transform(filter(turns, t -> t.loss), t -> t.text), '') as learnt")
    return rows.selectExpr(
        "conv_id",
        "cast(size(turns) as bigint) as n_turns",
        r"sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256) as turns_sha256",
        "cast(length(learnt) as bigint) as loss_chars",
        "sha2(learnt, 256) as loss_sha256",
        "cast(length(formatted) as bigint) as formatted_chars",
    )
