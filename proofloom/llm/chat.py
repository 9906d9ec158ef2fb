"""Multi-party chat formatting: one rendering of a dialogue per participant.

In each the participant speaks as the assistant and all others as named users; the mask holds the
assistant's characters.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import running_sum
from .common import keep

# The markers of the chat template.
START, END = "<|im_start|>", "<|im_end|>"
# Characters of one row; a turn counts as its characters, its name and TURN more.
PIECE, TURN = 1 << 20, 1 << 10


def _cut(large: DataFrame) -> DataFrame:
    """``conv_id, key, part, piece, said``: parts beyond PIECE in pieces by place, of ``conv_id, key, part, at, who, says``.

    Equal turns are one row with a number until they are rendered, and the order is cut along ranges of it, so neither a
    dialogue nor a turn number nor a repeated turn is one task's work.  A text beyond PIECE continues in further pieces.
    """
    order = ["at", "who", "says"]
    runs = large.groupBy("conv_id", "key", "part", *order).agg(F.count("*").alias("c"))
    ranged = runs.repartitionByRange("key", "part", "at", "who", F.substring("says", 1, 256)).withColumn("place", F.spark_partition_id())
    runs = (keep(ranged, "turns").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.length("says") / PIECE)).cast("long"))
            .withColumn("head", F.length("who") + F.lit(TURN)).withColumn("each", F.length("says") + F.col("parts") * F.col("head")))
    runs = running_sum(runs, ["key", "part"], order, F.col("c") * F.col("each"), F.col("place"), "upto")
    runs = runs.withColumn("begin", F.col("upto") - F.col("c") * F.col("each"))

    def piece_of(begin: Column) -> Column:
        return F.floor(begin / PIECE)

    # Of equal turns those that begin in a piece go there together.
    last = F.col("begin") + (F.col("c") - 1) * F.col("each")
    short = runs.filter("parts = 1").withColumn("piece", F.explode(F.sequence(piece_of(F.col("begin")), piece_of(last))))

    def before(piece: Column) -> Column:
        return F.least(F.col("c"), F.greatest(F.lit(0), F.ceil((piece * PIECE - F.col("begin")) / F.col("each"))))

    short = short.withColumn("skip", before(F.col("piece"))).withColumn("copies", (before(F.col("piece") + 1) - F.col("skip")).cast("int"))
    short = short.filter("copies > 0").select("conv_id", "key", "part", "piece", F.struct(
        (F.col("begin") + F.col("skip") * F.col("each")).alias("at"), "who", "says", F.lit(True).alias("first"), F.lit(True).alias("last"), "copies").alias("s"))
    long = runs.filter("parts > 1").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") * F.col("parts") - 1)))
    long = long.withColumn("f", F.col("t") % F.col("parts")).withColumn(
        "from", F.col("begin") + F.floor(F.col("t") / F.col("parts")) * F.col("each") + F.col("f") * (PIECE + F.col("head")))
    long = long.select("conv_id", "key", "part", piece_of(F.col("from")).alias("piece"), F.struct(
        F.col("from").alias("at"), "who", F.substring(F.col("says"), (F.col("f") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("says"),
        (F.col("f") == 0).alias("first"), (F.col("f") == F.col("parts") - 1).alias("last"), F.lit(1).alias("copies")).alias("s"))
    cut = short.unionByName(long).groupBy("conv_id", "key", "part", "piece").agg(F.array_sort(F.collect_list("s")).alias("said"))
    return cut.withColumn("said", F.flatten(F.transform("said", lambda s: F.array_repeat(s, s["copies"]))))


def rotate(turns: DataFrame, fixed_roles: Sequence[str] = ("system",), block: int = 256, conv: str = "conv_id",
           turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, participant, part, char_start, n_turns, rendered, mask``.

    Turns go by (turn, role, text); a null turn counts as -1, a null text as empty, a null role as
    the speaker ``unknown``.  Repeated rows are turns like others.  Roles in ``fixed_roles`` keep their name
    and are never rotated; a dialogue of these alone gives no row.  Markers inside texts or names are broken with a
    blank, so a text cannot open a turn.  A long dialogue continues in further parts of ``block`` turn numbers
    each; a part beyond ``PIECE``, by many turns of a number or by long texts, has several rows, and an overlong
    text goes on in the next row, so no row grows with the dialogue.  ``char_start`` is the place of the row in the whole
    rendering, and rows joined in its order are that rendering.  ``mask`` lists start and end of trained characters,
    counted from the row's start, end marker included; ``n_turns`` are the turns that begin in the row.  Other columns
    are ignored.
    """
    def safe(c):
        return F.replace(F.replace(c, F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))

    said = turns.select(F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("at"),
                        safe(F.coalesce(F.col(role), F.lit("unknown"))).alias("who"),
                        safe(F.coalesce(F.col(text), F.lit(""))).alias("says"))
    people = said.filter(~F.col("who").isin(*fixed_roles)).select("conv_id", F.col("who").alias("participant")).distinct()
    said = said.withColumn("part", F.floor(F.col("at") / block)).withColumn(
        "key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))
    large = keep(said.groupBy("key", "part").agg(F.sum(F.length("who") + F.length("says") + F.lit(TURN).cast("long")).alias("size"))
                 .filter(F.col("size") > PIECE).select("key", "part"), "large-parts")
    some = large.limit(1).count() > 0
    turn = F.struct("at", "who", "says", F.lit(True).alias("first"), F.lit(True).alias("last"), F.lit(1).alias("copies"))
    blocks = ((said.join(large, ["key", "part"], "left_anti") if some else said).groupBy("conv_id", "key", "part")
              .agg(F.array_sort(F.collect_list(turn)).alias("said")).withColumn("piece", F.lit(0).cast("long")))
    if some:
        blocks = blocks.unionByName(_cut(said.join(large, ["key", "part"], "left_semi").select("conv_id", "key", "part", "at", "who", "says")))
    both = blocks.alias("b").join(people.alias("p"), F.col("b.conv_id").eqNullSafe(F.col("p.conv_id"))).select(
        "b.conv_id", "key", "participant", "part", "piece", "said")

    def piece(s):
        name = (F.when(s["who"] == F.col("participant"), F.lit("assistant")).when(s["who"].isin(*fixed_roles), s["who"])
                .otherwise(F.concat(F.lit("user name="), s["who"])))
        head = F.when(s["first"], F.concat(F.lit(START), name, F.lit("\n"))).otherwise(F.lit(""))
        tail = F.when(s["last"], F.lit(END + "\n")).otherwise(F.lit(""))
        return F.struct(F.concat(head, s["says"], tail).alias("text"), F.length(head).alias("head"), s["first"].alias("first"),
                        s["last"].cast("int").alias("last"), (s["who"] == F.col("participant")).alias("own"))

    built = both.withColumn("pieces", F.transform("said", piece))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done, p):
        span = F.struct((done["at"] + p["head"]).alias("start"), (done["at"] + F.length(p["text"]) - p["last"]).alias("end"))
        return F.struct((done["at"] + F.length(p["text"])).alias("at"),
                        F.when(p["own"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    built = built.select("conv_id", "key", "participant", "part", "piece", F.size(F.filter("pieces", lambda p: p["first"])).alias("n_turns"),
                         F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("rendered"),
                         F.aggregate("pieces", empty, step)["spans"].alias("mask"))

    # Places come from lengths alone, in chunks of parts and of pieces.
    def length_of(s):
        name = (F.when(s["who"] == F.col("participant"), F.lit(len("assistant"))).when(s["who"].isin(*fixed_roles), F.length(s["who"]))
                .otherwise(F.length(s["who"]) + len("user name=")))
        return (F.length(s["says"]) + F.when(s["first"], name + len(START) + 1).otherwise(F.lit(0))
                + F.when(s["last"], F.lit(len(END) + 1)).otherwise(F.lit(0))).cast("long")

    own = ["key", "participant", "part"]
    lengths = both.select(*own, "piece", F.aggregate("said", F.lit(0).cast("long"), lambda n, s: n + length_of(s)).alias("n"))
    parts = running_sum(lengths.groupBy(*own).agg(F.sum("n").alias("n")), own[:2], ["part"], F.col("n"), F.floor(F.col("part") / 1024), "upto")
    starts = parts.select(*own, (F.col("upto") - F.col("n")).alias("char_start"))
    if some:
        inside = running_sum(lengths, own, ["piece"], F.col("n"), F.floor(F.col("piece") / 1024), "upto")
        starts = inside.select(*own, "piece", (F.col("upto") - F.col("n")).alias("more")).join(starts, own).select(
            *own, "piece", (F.col("char_start") + F.col("more")).alias("char_start"))
    return built.join(starts, [*own, "piece"] if some else own).select(
        "conv_id", "participant", "part", "n_turns", "rendered", "mask", "char_start")
