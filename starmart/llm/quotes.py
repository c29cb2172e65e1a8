"""Quotation linking: conversations in reply order, without the text that they quote.

Only DataFrame expressions are used.

1. The lines of a message are read with their quote level, the number of ``>`` before them
   (blanks between allowed). Consecutive lines of one level form a passage; level 0 is the
   message's own text.
2. Passages are normalised (case, punctuation and white space do not count) and hashed:
   whole, by paragraph (they end at blank lines), by pair of adjacent lines and by line, as
   replies quote parts.
3. Each of these pieces of a quoted passage is joined, by conversation and hash, to the
   earliest message that has it as its own text. Originals are reduced to one row per key
   before, so the join gives a row per piece at most. Where the pieces of a passage name
   several messages, its original is the one that holds most of its distinct lines, and of
   equals the latest.
4. A message replies to the latest of the originals that it quotes at level 1 (else at the lowest level that is found); without a
   quote that is found it replies to the turn before. The first message of each chain of replies names
   its thread; threads are found by doubling the reach of each message, one join a round.
5. What comes out: each message's own text without quotes, its thread, its depth in it and the turn that it
   replies to. Ordered by thread and turn, every reply follows what it replies to.

Unquoted text that a message repeats from an earlier one as whole lines of ``ECHO_WORDS``
words and more counts as a quote too: ``> `` is often lost in copying. It links, but stays in the text.

Null texts are empty messages. Rows without conversation or turn belong to no thread and come
out with null thread, depth and parent. Messages of one conversation and turn are one place in it: each comes out,
and they share their links. Roles may be null. Texts, lines and runs of quote marks may be of any length; work grows
with the length. The turn before is the last one that exists, whatever its number. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm.store import keep, prepare
from starmart.operators.keys import surrogate_keys

ECHO_WORDS = 5


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Lines with their quote level, what follows the marks, and that normalised."""
    # One class repeated, not a group: a group takes stack for every mark of a long run.
    marks = r"^[ \t>]*>"
    read = F.transform(
        F.split(text, "\r\n|\r|\n"),
        lambda line: F.struct(
            F.regexp_count(F.regexp_extract(line, f"({marks})", 1), F.lit(">")).alias("level"),
            F.regexp_replace(line, f"{marks} ?", "").alias("line"),
        ),
    )
    return F.transform(read, lambda x: F.struct(x["level"].alias("level"), x["line"].alias("line"), normalised(x["line"]).alias("norm")))


def _passages(lines: Column) -> Column:
    """Consecutive lines of one level together."""
    n = F.size(lines)
    level = lambda i: F.get(lines, i)["level"]
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))

    def passage(start: Column, end: Column) -> Column:
        some = F.slice(lines, start + 1, end - start)
        join = lambda c: F.array_join(F.transform(some, lambda x: x[c]), "\n").alias(c)
        return F.struct(level(start).alias("level"), join("line"), join("norm"))

    return F.flatten(
        F.transform(
            F.array(starts),
            lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(n)), passage),
        )
    )


def _code(norm: Column) -> Column:
    """Hash of normalised lines, wherever they are broken."""
    return F.xxhash64(F.trim(F.regexp_replace(norm, "\n+", " ")))


def _split(norm: Column, breaks: str) -> Column:
    return F.filter(F.split(norm, breaks), lambda x: F.trim(F.regexp_replace(x, "\n+", " ")) != "")


def _pairs(lines: Column) -> Column:
    """Each of ``lines`` with the next."""
    n = F.greatest(F.size(lines) - 1, F.lit(0))
    return F.zip_with(F.slice(lines, 1, n), F.slice(lines, 2, n), lambda a, b: F.concat_ws("\n", a, b))


def _pieces(norm: Column) -> Column:
    """Whole, paragraphs, pairs and lines of a passage: hash, and hashes of the lines in it."""
    lines = _split(norm, "\n+")
    return F.transform(
        F.array_distinct(F.concat(F.array(norm), _split(norm, "\n\n+"), _pairs(lines), lines)),
        lambda x: F.struct(_code(x).alias("hash"), F.array_distinct(F.transform(_split(x, "\n+"), _code)).alias("lines")),
    )


def read_messages(messages: DataFrame) -> DataFrame:
    """Messages with ``own`` text and the hashes of what is quoted and said.

    Only texts with a quote mark pay for gathering passages.
    """
    text = F.coalesce("text", F.lit(""))
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text")
    ).withColumn("lines", _lines(F.col("text")))
    marked = F.exists("lines", lambda x: x["level"] > 0)
    norms = F.array_join(F.transform("lines", lambda x: x["norm"]), "\n")
    whole = F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("line"), norms.alias("norm")))
    parts = base.withColumn("passages", F.when(marked, _passages(F.col("lines"))).otherwise(whole))
    some = lambda x: F.regexp_replace(x["norm"], "\n+", "") != ""
    quoted = F.filter("passages", lambda x: (x["level"] > 0) & some(x))
    said = F.filter("passages", lambda x: (x["level"] == 0) & some(x))
    own_lines = F.transform(F.filter("lines", lambda x: (x["level"] == 0) & (x["norm"] != "")), lambda x: x["norm"])
    echo = F.filter(own_lines, lambda x: F.size(F.split(x, " ")) >= ECHO_WORDS)
    ask = lambda level, norm: F.struct(level.alias("level"), _code(norm).alias("whole"), _pieces(norm).alias("pieces"))
    return parts.select(
        "conv_id", "turn", "role",
        F.regexp_replace(
            F.array_join(F.transform(F.filter("passages", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"),
            r"^\s+|\s+$", "",
        ).alias("own"),
        F.transform(quoted, lambda x: ask(x["level"], x["norm"])).alias("quotes"),
        F.transform(echo, lambda x: ask(F.lit(0), x)).alias("echoes"),
        F.array_distinct(
            F.concat(
                F.transform(said, lambda x: _code(x["norm"])),
                F.transform(F.flatten(F.transform(said, lambda x: _split(x["norm"], "\n\n+"))), _code),
                F.transform(_pairs(own_lines), _code),
                F.transform(own_lines, lambda x: F.xxhash64(x)),
            )
        ).alias("said"),
    )


def link_quotes(read: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, origin, n)``: how many quoted passages have this original.

    Level 0 stands for repeated lines. Equal passages of a level are merged.
    """
    placed = read.filter("conv_id is not null and turn is not null")
    said = placed.select("conv_id", "turn", F.explode("said").alias("hash"))
    origins = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    passage = ["conv_id", "turn", "level", "whole"]
    # Both sides are written, so that the join can split a conversation that is too large.
    asked = keep(
        placed.select("conv_id", "turn", F.explode(F.concat("quotes", "echoes")).alias("q"))
        .select("conv_id", "turn", "q.level", "q.whole", F.explode("q.pieces").alias("piece"))
        .select(*passage, "piece.hash", "piece.lines")
        .distinct(),
        "quoted",
    )
    found = keep(
        asked.join(keep(origins, "origins"), ["conv_id", "hash"])
        .filter("origin < turn")
        .groupBy(*passage)
        .agg(F.collect_set("origin").alias("origins")),
        "originals",
    )
    # Only where several messages come into question are their lines looked up.
    several = found.filter(F.size("origins") > 1).select(*passage, F.explode("origins").alias("origin"))
    held = (
        keep(several.join(asked, passage), "rivals")
        .join(said.withColumnRenamed("turn", "origin"), ["conv_id", "origin", "hash"])
        .select(*passage, "origin", F.explode("lines").alias("line"))
        .distinct()
        .groupBy(*passage, "origin")
        .agg(F.count("*").alias("lines"))
        .groupBy(*passage)
        .agg(F.max_by("origin", F.struct("lines", "origin")).alias("origin"))
    )
    single = found.filter(F.size("origins") == 1).select(*passage, F.col("origins")[0].alias("origin"))
    return single.unionByName(held).groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"))


def threads(places: DataFrame) -> DataFrame:
    """``places(conv_id, turn, parent)`` with ``thread`` and ``depth``.

    Each round doubles how far up a message has looked; those that have found the top are done
    and take no part in later rounds, so a long thread costs rounds for itself only.
    """
    reach = keep(
        places.select(
            "conv_id", "turn", "parent", F.coalesce("parent", "turn").alias("thread"),
            F.col("parent").isNotNull().cast("long").alias("depth"),
        ),
        "reach",
    )
    done, open_ = reach.filter("parent is null"), reach.filter("parent is not null")
    while True:
        up = done.union(open_).select(
            "conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more")
        )
        # Whatever a message looks at is a place itself, so each finds one row.
        after = keep(
            open_.join(up, ["conv_id", "thread"]).select(
                "conv_id", "turn", "parent", F.col("higher").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"),
                (F.col("more") > 0).alias("moved"),
            ),
            "reach",
        )
        done = done.union(after.filter("not moved").drop("moved"))
        open_ = after.filter("moved").drop("moved")
        if not open_.head(1):
            return done


def reply_order(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, reply_to, thread, depth, n_quotes, n_linked)`` for each
    message of ``messages(conv_id, turn, role, text)``."""
    prepare(messages.sparkSession)
    read = keep(read_messages(messages), "messages")
    links = keep(link_quotes(read), "quote-links")
    chosen = links.groupBy("conv_id", "turn").agg(
        # Level 1 first, then deeper ones, repeated lines last; of one level the latest.
        F.min_by("origin", F.struct(F.when(F.col("level") == 0, 1 << 30).otherwise(F.col("level")), -F.col("origin"))).alias("origin"),
        F.sum("n").alias("n_linked"),
    )
    places = read.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    # Ranked over all conversations, so that none of them has to fit a task.
    ranked = keep(surrogate_keys(places, ["conv_id", "turn"], "place"), "ranked")
    before = ranked.select("conv_id", (F.col("place") + 1).alias("place"), F.col("turn").alias("previous"))
    placed = keep(
        ranked.join(before, ["conv_id", "place"], "left")
        .join(chosen, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.coalesce("origin", "previous").alias("parent"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")),
        "places",
    )
    found = threads(placed).join(placed.drop("parent"), ["conv_id", "turn"])
    return read.join(keep(found, "threads"), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.col("parent").alias("reply_to"), "thread", "depth",
        F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
