"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. A window
is the system turn, a limited history repeated from before, and its own span; it
closes before it would pass the budget. Only the window's own assistant turns are
under its loss mask, so each is a target once. Control strings in texts are
escaped, reversibly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Size of a window, and of its repeated history of so many turns at most. Sizes are UTF-8 bytes of formatted turns: a byte-level
#: vocabulary makes at most one token of a byte, so a window never has more tokens than this.
BUDGET, HISTORY, HISTORY_TURNS = 4096, 1024, 2
#: The template: fixed values. Escaped texts hold none of "<", "[" and "|".
OPEN, MID, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Escapes, the first one being undone last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("|", "&vert;"))


def escape(col: Column) -> Column:
    for plain, code in ESCAPES:
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def unescape(col: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        col = F.replace(col, F.lit(code), F.lit(plain))
    return col


def formatted_size(role: Column, text: Column) -> Column:
    """UTF-8 bytes of a formatted turn."""
    marks = len(OPEN + MID + CLOSE)
    return (F.octet_length(escape(role)) + F.octet_length(escape(text)) + marks).cast("bigint")


#: Spans that are gathered before they are put to the others, so that a long conversation doesn't copy all of them for each.
GATHERED = 256


def spans(sizes: Column, room: Column, history: int, history_turns: int) -> Column:
    """``array<struct<first, again>>``: each window's first turn (from 0) and how many turns before it are repeated.

    ``sizes`` are those of a conversation's turns in order; the running sum of
    the open window starts again where the next turn would pass ``room``. A step
    knows the last ``history_turns`` sizes alone, so the work is linear in the turns.
    """
    kind = "array<struct<first:int,again:int>>"
    none, zero = F.array().cast(kind), F.lit(0).cast("bigint")
    begin = F.struct(F.lit(0).alias("i"), zero.alias("used"), *(zero.alias(f"p{k}") for k in range(1, history_turns + 1)), none.alias("new"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        i = acc["i"]
        again, used, fits, total = F.lit(0), size, F.lit(True), zero
        for k in range(1, history_turns + 1):
            total = total + acc[f"p{k}"]
            # the newest turn is repeated wherever there is room for it, older ones only within the history's size
            fits = fits & (i >= k) & (total + size <= room)
            if k > 1:
                fits = fits & (total <= history)
            again, used = F.when(fits, F.lit(k)).otherwise(again), F.when(fits, total + size).otherwise(used)
        opens = (i == 0) | (acc["used"] + size > room)
        full = F.size(acc["new"]) >= GATHERED
        one = F.array(F.struct(i.alias("first"), again.cast("int").alias("again")))
        return F.struct(
            (i + 1).alias("i"),
            F.when(opens, used).otherwise(acc["used"] + size).cast("bigint").alias("used"),
            *((size if k == 1 else acc[f"p{k - 1}"]).cast("bigint").alias(f"p{k}") for k in range(1, history_turns + 1)),
            F.when(opens & full, one).when(opens, F.concat(acc["new"], one)).otherwise(acc["new"]).alias("new"),
            F.when(opens & full, F.concat(acc["out"], F.array(acc["new"]))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(sizes, begin, step, lambda acc: F.concat(F.flatten(acc["out"]), acc["new"]))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """``conv_id, window, text, loss, turns, over``: each window's text, and what of it is under the loss mask as code point spans.

    ``turns`` gives each turn of the window: order in the conversation, whether it
    is repeated. Turns stand by ``turn``, ties by role and text; nulls first, and a
    null role or text counts as empty. A system turn is a conversation's first
    turn if its role is system; it opens every window. A window holds the turns
    that fit into ``budget``; its history is the newest turns before its own, the
    newest wherever it fits beside the window's first own turn, up to
    ``history_turns`` within ``history``. A turn that doesn't fit beside the system turn
    stands with that alone, and only then is a window ``over`` its budget.
    Repeated rows are turns. Only sizes of a conversation are held together
    in one row; its texts are dealt by conversation and window.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    rows = rows.withColumn("size", formatted_size(F.col("role"), F.col("text")))
    rows = rows.withColumn("system", (F.col("ord") == 1) & (F.col("role") == "system"))
    sized = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("system"), F.struct("ord", "size")))).alias("own"),
        F.coalesce(F.max(F.when(F.col("system"), F.col("size"))), F.lit(0)).alias("head"),
    )
    sized = sized.select("conv_id", F.transform("own", lambda t: t["size"]).alias("sizes"), "head", (F.col("head") > 0).cast("int").alias("lead"))
    cut = sized.select("conv_id", "lead", F.size("sizes").alias("n"), spans(F.col("sizes"), F.lit(budget) - F.col("head"), history, history_turns).alias("cuts"))
    # a system turn alone makes a window too
    cut = cut.withColumn("cuts", F.when(F.size("cuts") == 0, F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("again")))).otherwise(F.col("cuts")))
    stops = F.concat(F.transform(F.slice("cuts", 2, F.size("cuts")), lambda c: c["first"]), F.array("n"))
    each = cut.select("conv_id", "lead", F.posexplode(F.arrays_zip(F.col("cuts"), stops.alias("stop"))).alias("window", "both"))
    each = each.select("conv_id", "lead", "window", F.col("both.cuts").alias("cut"), F.col("both.stop").alias("stop"))
    stop = F.col("stop")
    low = F.col("cut.first") - F.col("cut.again")
    listed = F.when(stop > low, F.sequence(low, stop - 1)).otherwise(F.array().cast("array<int>"))
    listed = F.transform(listed, lambda i: F.struct((i + 1 + F.col("lead")).alias("ord"), (i < F.col("cut.first")).alias("repeated")))
    lead = F.when(F.col("lead") == 1, F.array(F.struct(F.lit(1).alias("ord"), (F.col("window") > 0).alias("repeated")))).otherwise(F.array().cast("array<struct<ord:int,repeated:boolean>>"))
    places = each.select(F.col("conv_id").alias("_conv"), "window", F.inline(F.concat(lead, listed)).alias("_ord", "repeated"))
    placed = rows.join(places, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("ord") == F.col("_ord")))
    part = F.struct("ord", "repeated", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"))
    grouped = placed.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum("size").alias("size"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.char_length(p["head"])
        b = a + F.char_length(p["body"])
        out = F.when(p["target"] & ~p["repeated"], F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["out"])
        return F.struct((b + len(CLOSE)).alias("at"), out.alias("out"))

    return grouped.select(
        "conv_id",
        "window",
        text.alias("text"),
        F.aggregate("parts", begin, step, lambda acc: acc["out"]).alias("loss"),
        F.transform("parts", lambda p: F.struct(p["ord"].alias("ord"), p["repeated"].alias("repeated"))).alias("turns"),
        (F.col("size") > budget).alias("over"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from windows' texts, masks and turn marks alone."""
    turns = F.transform(F.filter(F.split("text", r"<\|end\|>"), lambda t: t != ""), lambda t: F.split(F.replace(t, F.lit(OPEN), F.lit("")), r"<\|text\|>"))
    paired = F.zip_with(turns, "turns", lambda t, m: F.struct(m["repeated"].alias("repeated"), unescape(F.get(t, F.lit(0))).alias("role"), unescape(F.get(t, F.lit(1))).alias("text")))
    fresh = F.filter(paired, lambda t: ~t["repeated"])
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    rows = formatted.select(
        "conv_id",
        "window",
        F.size(fresh).cast("long").alias("n"),
        F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        loss.alias("loss"),
        F.char_length("text").cast("long").alias("chars"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return grouped.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def chats(conversations: DataFrame) -> DataFrame:
    """All conversations formatted and read back; an empty table gives an empty one."""
    return read_back(windows(conversations))
