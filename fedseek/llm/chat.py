"""Chat formatting in budgeted windows.

A conversation becomes one or more training texts of at most `budget` tokens,
counted by TOKEN on the formatted text, its marks and escapes included. Running
sums of the tokens of its turns choose spans that start and end with a turn; each span begins with the system
turn, then repeats as many of the 32 turns before it as fit a share of the
budget, and then has new turns. The loss mask lists the characters that are
trained on: the text of assistant turns, each in the one window where it is
new. A turn longer than the budget has a window of its own and is not cut.

Turns are numbered from 0 on in each conversation, by running sums over ranges
of turn numbers, and gathered by conversation and SEGMENT of these places, not
by conversation, so that a very long one is many groups; each group starts a
window, and has copies of the system turn and of the REPEATED turns before it
as history. Gaps in turn numbers make no difference. Rows that share a turn
number are put in order by a sort, which spills and gathers nothing in memory.

The template is `<|im_start|>role\\ntext<|im_end|>\\n`. In texts and roles
every `<`, backslashes, `|` gets one more backslash, so that none of them is a
mark; taking one away restores them. In a role, line feed and % are written
%0A and %25.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedseek.llm.common import stored

#: The template's marks.
START, END = "<|im_start|>", "<|im_end|>"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"
BUDGET, HISTORY = 512, 128
SEGMENT, REPEATED = 64, 32
#: Where a row of a segment comes from, in the order of the rows.
SYSTEM, BEFORE, OWN = 0, 1, 2


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _role_out(role), F.lit("\n"), escaped(text), F.lit(f"{END}\n"))


def _numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, raw) with at: the place of each in its conversation, from 0 on."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = turns.groupBy("conv_id", "turn").agg(F.count("*").alias("rows"))
    # running sums within ranges, then over the ranges that a conversation reaches into
    ranged = stored(per.repartitionByRange(n, "conv_id", "turn").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("conv_id", "part").agg(F.sum("rows").alias("s"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    inside = Window.partitionBy("part", "conv_id").orderBy(F.asc_nulls_first("turn")).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("at", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    places = ranged.join(sums, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
    places = places.select("c", F.col("turn").alias("t"), (F.col("at") + F.col("s")).alias("at"))
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "raw")
    own = turns.withColumn("i", F.row_number().over(same) - 1)
    own = own.join(places, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")))
    return own.select("conv_id", "role", "raw", (F.col("at") + F.col("i")).alias("at"))


def _segments(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, t: SEGMENT turns in order, after copies of the system turn and of the turns before."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = _numbered(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("raw")))
    turns = turns.withColumn("segment", F.floor(F.col("at") / SEGMENT)).withColumn("n", F.regexp_count(_formatted(F.col("role"), F.col("raw")), F.lit(TOKEN)).cast("long"))
    turns = stored(turns)
    is_system = (F.col("at") == 0) & (F.col("role") == "system")
    system = turns.where(is_system).select(F.col("conv_id").alias("c"), "role", "raw", "n")
    copies = turns.where("segment > 0").select("conv_id", "segment").distinct().join(system, F.col("conv_id").eqNullSafe(F.col("c")))
    copies = copies.select("conv_id", "segment", F.lit(SYSTEM).alias("place"), F.lit(0).cast("long").alias("at"), "role", "raw", "n")
    places = F.array(F.struct(F.when(is_system, SYSTEM).otherwise(OWN).alias("place"), F.col("segment").alias("to")))
    again = F.array(F.struct(F.lit(BEFORE).alias("place"), (F.col("segment") + 1).alias("to")))
    own = turns.withColumn("x", F.explode(F.when(F.col("at") % SEGMENT >= SEGMENT - REPEATED, F.concat(places, again)).otherwise(places)))
    own = own.select("conv_id", F.col("x.to").alias("segment"), "x.place", "at", "role", "raw", "n")
    t = F.sort_array(F.collect_list(F.struct("place", "at", "role", "raw", "n")))
    out = own.unionByName(copies).groupBy("conv_id", "segment").agg(t.alias("t"))
    return out.where((F.col("segment") == 0) | F.exists("t", lambda x: x.place == OWN))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, segment, window, text, repeated, loss: a row per window.

    Windows are in the order of segment and window. repeated: how
    many turns at the start of text are shown again (the system turn and
    history). loss: array of (start, end) in code points of text, end
    exclusive.

    conversations has conv_id, turn, role, text; other columns are not looked
    at. Rows are taken by turn (null first), then role, then text; repeated
    rows are turns of their own. A null text or role is empty. Rows of a null
    conv_id form one conversation. The system turn is the first turn if its
    role is system. Only the order of turn numbers matters. A window exceeds
    the budget only if the system turn and one turn alone do. No rows: no
    windows.
    """
    conv = _segments(conversations)
    conv = conv.withColumn("mine", F.col("segment") == 0).withColumn("sys", (F.col("t")[0].place == SYSTEM).cast("int")).withColumn("sys_n", F.when(F.col("sys") == 1, F.col("t")[0].n).otherwise(F.lit(0).cast("long")))
    conv = conv.withColumn("fresh", F.size(F.filter("t", lambda x: x.place != OWN)))
    # sums[i]: tokens of the turns before i
    sums = F.aggregate(F.col("t"), F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.n)))
    conv = conv.withColumn("sums", sums)
    state = "array<struct<hist:int,new:int,end:int>>"

    def cut(acc: Column, i: Column) -> Column:
        """Turn i joins the last window if it fits, or else starts one, with history before it."""
        w = F.element_at(acc, -1)
        total = F.col("sys_n") + F.get("sums", i + 1) - F.get("sums", w.hist)
        fits = total <= budget
        # earliest turn whose repetition stays within the history share and, with turn i, within the budget
        room = F.least(F.lit(history).cast("long"), F.lit(budget) - F.col("sys_n") - (F.get("sums", i + 1) - F.get("sums", i)))
        before = F.filter(F.sequence(F.greatest(F.col("sys"), i - 32), i), lambda j: (j == i) | (F.get("sums", i) - F.get("sums", j) <= room))
        fresh = F.array(F.struct(F.array_min(before).alias("hist"), i.alias("new"), (i + 1).alias("end")))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(w.hist.alias("hist"), w.new.alias("new"), (i + 1).alias("end"))))
        return F.when(F.size(acc) == 0, fresh).when(fits, grown).otherwise(F.concat(acc, fresh))

    ids = F.when(F.size("t") > F.col("fresh"), F.sequence(F.col("fresh"), F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.aggregate(ids, F.array().cast(state), cut)
    # a lone system turn is a window too
    cuts = F.when(F.size("t") == F.col("sys"), F.array(F.struct(F.lit(1).alias("hist"), F.lit(1).alias("new"), F.lit(1).alias("end"))).cast(state)).otherwise(cuts)
    conv = conv.withColumn("cuts", cuts)
    # cuts are never empty; a plain explode would put a filter on them below, with sums worked out anew for every turn
    spans = conv.select("conv_id", "segment", "mine", "t", "sys", F.posexplode_outer("cuts").alias("window", "c"))
    shown = F.concat(F.slice("t", 1, F.col("sys")), F.slice("t", F.col("c.hist") + 1, F.col("c.end") - F.col("c.hist")))
    # the first window's system turn is new, all later ones repeat it
    repeated = F.when(F.col("mine") & (F.col("window") == 0), F.lit(0)).otherwise(F.col("sys")) + F.col("c.new") - F.col("c.hist")
    spans = spans.select("conv_id", "segment", "window", shown.alias("s"), repeated.alias("repeated"))
    head = lambda x: F.concat(F.lit(START), _role_out(x.role), F.lit("\n"))
    pieces = F.transform("s", lambda x, i: F.struct(head(x).alias("h"), escaped(x.raw).alias("b"), ((x.role == "assistant") & (i >= F.col("repeated"))).alias("train")))
    spans = spans.select("conv_id", "segment", "window", "repeated", pieces.alias("p"))
    tail = len(END) + 1
    step = lambda a, x: F.struct((a.at + F.length(x.h) + F.length(x.b) + tail).alias("at"), F.when(x.train & (F.length(x.b) > 0), F.concat(a.loss, F.array(F.struct((a.at + F.length(x.h)).alias("start"), (a.at + F.length(x.h) + F.length(x.b)).alias("end"))))).otherwise(a.loss).alias("loss"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return spans.select(
        "conv_id",
        "segment",
        "window",
        F.array_join(F.transform("p", lambda x: F.concat(x.h, x.b, F.lit(f"{END}\n"))), "").alias("text"),
        "repeated",
        F.aggregate("p", zero, step).loss.alias("loss"),
    )


def turns_of(text: Column) -> Column:
    """The turns (role, text) of a formatted window."""
    body = F.slice(F.split(text, r"<\|im_start\|>"), 2, 2**30)
    inner = F.transform(body, lambda x: F.left(x, F.length(x) - len(END) - 1))
    return F.transform(
        inner,
        lambda x: F.struct(
            _role_in(F.substring_index(x, "\n", 1)).alias("role"),
            unescaped(F.substring(x, F.locate("\n", x) + 1, F.length(x))).alias("text"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """op9's digest of windows: everything comes from text, repeated and loss."""
    per = formatted.select(
        "conv_id",
        "segment",
        "window",
        F.length("text").cast("long").alias("chars"),
        F.slice(turns_of(F.col("text")), F.col("repeated") + 1, F.lit(2**30)).alias("t"),
        F.array_join(F.transform("loss", lambda x: unescaped(F.substring(F.col("text"), x.start + 1, x.end - x.start))), "").alias("l"),
    )
    shown = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    # a digest is of a whole conversation, so this one step gathers what it covers
    w = F.sort_array(F.collect_list(F.struct("segment", "window", shown.alias("t"), "l")))
    conv = per.groupBy("conv_id").agg(w.alias("w"), F.sum(F.size("t")).alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x.l), "")
    return conv.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x.t), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("w").cast("long").alias("n_windows"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(windows(conv.unionByName(extra)))


#: What must come back, straight from the rows.
ORACLE = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""
