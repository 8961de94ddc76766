r"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs, sorted by turn (ties by role, then
text), adjacent turns of one role are merged into blocks, and blocks are joined to

    <s>[TURN]user[SAYS]first text[NEXT]second text[END][TURN]assistant[SAYS]...[END]</s>

Control strings inside roles and texts get a backslash after their first character
(one more if they have some), which :func:`read_back` takes out again, so that any
text survives. The loss mask is a list of code point spans of the assistant's texts.

Defined cases: a null text or role is empty; repeated rows are turns of their own; a
null turn sorts first; a null conv_id is a conversation; an empty table gives an
empty result; columns other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the template and its usual readers take as control strings.
CONTROLS = (r"\[/?INST\]", r"\[(?:TURN|SAYS|NEXT|END)\]", r"</?s>")
_AHEAD = r"(?=/?INST\\]|(?:TURN|SAYS|NEXT|END)\\]|/?s>)"
LEARNER = "assistant"
#: Pieces of a conversation that one fold walks.
_BLOCK = 256


def _escaped(x: str) -> str:
    return rf"regexp_replace({x}, '([\\[<])(\\\\*){_AHEAD}', '$1\\\\$2')"


def _plain(x: str) -> str:
    return rf"regexp_replace({x}, '([\\[<])\\\\(\\\\*){_AHEAD}', '$1$2')"


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation; spans are (start, end) in code points."""
    own = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t"))
    chats = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    firsts = "filter(sequence(1, size(ts)), i -> i = 1 OR ts[i - 1].role != ts[i - 2].role)"
    chats = chats.withColumn("firsts", F.expr(firsts))
    block = "slice(ts, firsts[j], coalesce(get(firsts, j + 1), size(ts) + 1) - firsts[j])"
    chats = chats.withColumn("blocks", F.expr(f"transform(sequence(0, size(firsts) - 1), j -> {block})"))
    piece = lambda text, own: f"named_struct('text', {text}, 'own', {own})"
    said = f"transform(b, (t, i) -> array({piece("if(i = 0, '', '[NEXT]')", 'false')}, {piece(_escaped('t.text'), f"t.role = '{LEARNER}'")}))"
    head = piece(f"concat('[TURN]', {_escaped('b[0].role')}, '[SAYS]')", "false")
    chats = chats.withColumn("pieces", F.expr(f"flatten(transform(blocks, b -> concat(array({head}), flatten({said}), array({piece("'[END]'", 'false')}))))"))
    # two levels of folds, since a fold copies the list that it carries: pieces in blocks, then blocks
    chats = chats.withColumn("parts", F.expr(f"transform(sequence(0, (size(pieces) - 1) div {_BLOCK}), i -> slice(pieces, i * {_BLOCK} + 1, {_BLOCK}))"))
    starts = "aggregate(parts, named_struct('at', 3, 'starts', cast(array() AS array<int>)), (a, b) -> named_struct('at', a.at + aggregate(b, 0, (n, p) -> n + length(p.text)), 'starts', concat(a.starts, array(a.at))), a -> a.starts)"
    own = "concat(a.spans, array(named_struct('start', a.at, 'end', a.at + length(p.text))))"
    inside = f"aggregate(part, named_struct('at', start, 'spans', cast(array() AS array<struct<start:int,end:int>>)), (a, p) -> named_struct('at', a.at + length(p.text), 'spans', if(p.own, {own}, a.spans)), a -> a.spans)"
    spans = f"flatten(zip_with(parts, {starts}, (part, start) -> {inside}))"
    return chats.select("conv_id", F.expr("concat('<s>', array_join(transform(pieces, p -> p.text), ''), '</s>')").alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), loss: text under the mask, formatted): all taken from the formatted text and the spans."""
    body = r"regexp_replace(substring(formatted, 4, length(formatted) - 7), '\\[END\\]$', '')"
    blocks = rf"filter(split({body}, '(?:\\[END\\])?\\[TURN\\]'), (b, i) -> i > 0)"
    parts = r"split(b, '\\[SAYS\\]')"
    texts = rf"transform(split({parts}[1], '\\[NEXT\\]'), x -> named_struct('role', {_plain(parts + '[0]')}, 'text', {_plain('x')}))"
    loss = f"array_join(transform(loss_spans, s -> {_plain('substring(formatted, s.start + 1, s.end - s.start)')}), '')"
    return chats.select("conv_id", F.expr(f"flatten(transform({blocks}, b -> {texts}))").alias("turns"), F.expr(loss).alias("loss"), "formatted")


def op7(conversations: DataFrame) -> DataFrame:
    """The digest of the contract, of all conversations and one more, numbered -7, that speaks in control strings."""
    spark = conversations.sparkSession
    spoken = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", spoken), (-7, 1, LEARNER, spoken)], "conv_id long, turn long, role string, text string")
    back = read_back(format_chats(conversations.select("conv_id", "turn", "role", "text").union(more)))
    said = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
