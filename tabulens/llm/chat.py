"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns are cut into windows of whole turns that hold at most a budget of tokens. Each
window repeats the system turn and as many of the turns just before it as the history allows; only
what it adds is trained on, so repeated targets are masked and every target counts once.

A turn is written as `<s>[INST]role[/INST]text</s>`. In roles and texts a backslash is doubled and one
is put after the first character of every such mark, so no mark stands inside a text and unescaping
gives back the text.

Windows are chosen from running sums of turn tokens within a block of turns. A conversation of at most
BLOCK budgets is one block. A longer one is cut where its prefix sums pass a multiple of that, and the
next block gets the turns before the cut that its first window may repeat, so no task holds a whole
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import settled
from tabulens.operators.ranks import running_totals

BUDGET = 2048
HISTORY = 256
BLOCK = 16  # budgets that a block of turns may hold
TURN_TOKENS = 4  # of the marks of a turn
SYMBOL = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
SYSTEM, TARGET = "system", "assistant"
OPEN, NAMED, CLOSE = "<s>[INST]", "[/INST]", "</s>"
MARKS = r"\\|<(?=/?s>)|\[(?=/?INST\])"  # a backslash, or the first character of a mark
BROADCAST_LONG = 100_000  # ids of long conversations that may be broadcast


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({MARKS})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)\\", "$1")


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: what is written before and as its text, how long it is, and its place in the order."""
    conv, turn = df[f"`{conv_col}`"], df[f"`{turn_col}`"].cast("bigint")
    role, text = (F.coalesce(df[f"`{c}`"].cast("string"), F.lit("")) for c in (role_col, text_col))
    head, body = F.concat(F.lit(OPEN), escaped(role), F.lit(NAMED)), escaped(text)
    rows = df.where(conv.isNotNull()).select(
        conv.cast("bigint").alias("conv_id"),
        F.coalesce(turn, F.lit(-(1 << 63))).alias("turn"),
        F.xxhash64(role, text).alias("tie"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("symbols"),
        F.char_length(text).alias("chars"),
        (role == SYSTEM).alias("system"), (role == TARGET).alias("target"), head.alias("head"), body.alias("body"),
    )
    # White space has no symbols, yet a text of it alone may be long: 16 characters are a token at least.
    tokens = F.greatest("symbols", F.expr("cast(chars div 16 as bigint)")) + TURN_TOKENS
    return rows.withColumn("tokens", tokens).drop("symbols", "chars")


def _blocks(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Add ``block``, ``own``, false for copies in blocks that may only repeat the turn, and ``lead``, true
    for those of a leading system turn.

    Only conversations longer than a block are numbered, by narrow rows; running sums and the join of
    their blocks shuffle by turn, never by conversation.
    """
    size = BLOCK * budget
    alone = {"block": F.lit(0).cast("bigint"), "own": F.lit(True), "lead": F.lit(False)}
    long = settled(turns.groupBy("conv_id").agg(F.sum("tokens").alias("all")).where(F.col("all") > size), "long")
    n = long.count()
    if not n:
        return turns.withColumns(alone)
    known = F.broadcast(long) if n <= BROADCAST_LONG else long
    short = turns.join(known, "conv_id", "left_anti").withColumns(alone)
    rows = settled(turns.join(known, "conv_id").withColumn("row", F.monotonically_increasing_id()), "turns")
    narrow = rows.select("conv_id", "turn", "tie", "row", "tokens")
    placed = running_totals(narrow, [F.col("turn"), F.col("tie"), F.col("row")], {"start": "tokens"}, by=["conv_id"], number="place")
    rows = rows.join(placed.select("row", "start", "place"), "row").withColumn("block", F.expr(f"start div {size}"))
    lead = F.col("system") & (F.col("place") == 0) & (F.col("tokens") <= budget // 2)
    near = F.col("start") >= (F.col("block") + 1) * size - history
    copies = (
        F.when(lead, F.sequence(F.lit(0).cast("bigint"), F.expr(f"all div {size}")))
        .when(near, F.array("block", F.col("block") + 1))
        .otherwise(F.array("block"))
    )
    rows = rows.select(*turns.columns, F.col("block").alias("home"), lead.alias("lead"), F.explode(copies).alias("block"))
    own = F.col("home") == F.col("block")
    return short.unionByName(rows.withColumn("own", own).withColumn("lead", F.col("lead") & ~own).drop("home"))


def formatted(
    df: DataFrame, budget: int = BUDGET, history: int = HISTORY,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, block, window, text, n_turns, n_repeated, n_tokens, loss) of every conversation.

    ``text`` holds n_turns turns, of which the first n_repeated stood in earlier windows; ``loss`` lists
    (start, length) in code points of the texts trained on. Windows of a conversation come in the order
    of block and window. A window's tokens stay within ``budget`` unless one turn is longer.

    Rows without a conversation id are left out. NULL roles and texts count as empty; turns without a
    number come first, and turns of one number in the order of a hash of role and text. Repeated rows
    are turns of their own. A first turn of the role `system` is repeated in every later window if it
    takes at most half the budget, other system turns are plain turns. An empty table gives no rows.
    """
    if not 0 <= history <= budget // 4:
        raise ValueError("the history may take a quarter of the budget at most")
    turns = _blocks(turns_of(df, conv_col, turn_col, role_col, text_col), budget, history)
    one = F.struct("own", "turn", "tie", "head", "body", F.col("tokens").cast("int").alias("tokens"), "system", "target", "lead")
    held = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(one)).alias("held"))
    # Copies sort before own turns. The system turn leads: of the first block as its first own turn, else as a copy.
    held = held.where("exists(held, t -> t.own)").selectExpr(
        "conv_id", "block", "filter(held, t -> t.own) as own",
        f"get(filter(held, (t, i) -> t.lead or (block = 0 and i = 0 and t.system and t.tokens <= {budget // 2})), 0) as lead",
        "filter(held, t -> not t.own and not t.lead) as old",
    )
    chosen = held.selectExpr(
        "conv_id", "block", "lead", "concat(old, own) as every", "size(old) as n_old", "size(own) as n_own",
        f"""aggregate(
            transform(own, (t, i) -> if(block = 0 and i = 0 and lead is not null, 0, t.tokens)),
            named_struct('starts', array(0), 'used', 0, 'i', 0),
            (a, t) -> if(a.i > 0 and a.used + t > {budget - history} - coalesce(lead.tokens, 0),
                named_struct('starts', concat(a.starts, array(a.i)), 'used', t, 'i', a.i + 1),
                named_struct('starts', a.starts, 'used', a.used + t, 'i', a.i + 1)),
            a -> a.starts) as starts""",
    )
    # At most history / TURN_TOKENS turns fit into the history, so only those just before a window are looked at.
    most = history // TURN_TOKENS
    spans = chosen.select("*", F.posexplode("starts").alias("window", "first"))
    spans = spans.selectExpr(
        "conv_id", "block", "window", "lead", "every", "n_old + first as before",
        "coalesce(get(starts, window + 1), n_own) - first as n_new",
        f"greatest(n_old + first - {most}, if(lead is not null and block = 0, 1, 0)) as least",
    ).selectExpr(
        "conv_id", "block", "window", "lead", "every", "before", "n_new",
        f"""aggregate(
            reverse(slice(every, least + 1, greatest(before - least, 0))),
            named_struct('n', 0, 'used', 0, 'open', true),
            (a, t) -> if(a.open and a.used + t.tokens <= {history},
                named_struct('n', a.n + 1, 'used', a.used + t.tokens, 'open', true),
                named_struct('n', a.n, 'used', a.used, 'open', false)),
            a -> a.n) as n_history""",
    )
    windows = spans.selectExpr(
        "conv_id", "block", "window",
        "if(lead is null or (block = 0 and window = 0), 0, 1) + n_history as n_repeated",
        """concat(if(lead is null or (block = 0 and window = 0), slice(every, 1, 0), array(lead)),
            slice(every, before - n_history + 1, n_history + n_new)) as turns""",
    )
    return windows.selectExpr(
        "conv_id", "block", "window",
        f"array_join(transform(turns, t -> concat(t.head, t.body, '{CLOSE}')), '') as text",
        "size(turns) as n_turns", "n_repeated",
        "aggregate(turns, 0L, (a, t) -> a + t.tokens) as n_tokens",
        f"""aggregate(turns, named_struct('at', 0, 'i', 0, 'spans', cast(array() as array<struct<start: int, length: int>>)),
            (a, t) -> named_struct(
                'at', a.at + char_length(t.head) + char_length(t.body) + {len(CLOSE)}, 'i', a.i + 1,
                'spans', if(t.target and a.i >= n_repeated,
                    concat(a.spans, array(named_struct('start', a.at + char_length(t.head), 'length', char_length(t.body)))), a.spans)),
            a -> a.spans) as loss""",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, block, window, turns, losses): the turns that each window adds as (role, text), and the
    texts under its loss mask, both parsed from ``text`` and unescaped."""
    role = lambda p: unescaped(F.substr(F.substring_index(p, NAMED, 1), F.lit(len(OPEN) + 1)))
    body = lambda p: unescaped(F.substr(p, F.char_length(F.substring_index(p, NAMED, 1)) + len(NAMED) + 1))
    pieces = F.slice(F.split("text", CLOSE), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    return windows.select(
        "conv_id", "block", "window",
        F.transform(pieces, lambda p: F.struct(role(p).alias("role"), body(p).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr("text", s["start"] + 1, s["length"]))).alias("losses"),
        F.char_length("text").cast("bigint").alias("chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what windows hold.

    A digest runs over one string, so a conversation may hold at most 2 GB here.
    """
    parts = read_back(windows).select(
        "conv_id", F.size("turns").cast("bigint").alias("n"), "chars",
        F.struct("block", "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join("losses", "").alias("loss")).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts")
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    whole = whole.select("conv_id", "n_turns", "formatted_chars", joined("said").alias("said"), joined("loss").alias("loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
