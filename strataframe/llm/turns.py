"""Conversation structure repair: cheapest edits to a legal order of turns, by a fold of native expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words, as characters; a text of nothing else is blank.
SPACE = " \t\n\x0b\x0c\r"
#: Adjacent roles' initials that are legal.
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3


def _known(column: Column) -> Column:
    """A column as text; null reads as one space."""
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the test damage, and `dropped`; of a repeated row two.

    By crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its `.`, `!`, `?`, 3 repeats
    it, 4 sets role user. Nulls read as one space, but for conv_id and turn themselves, which stay. Dropped rows
    stay with `dropped` set, so that their conversation is known.
    """
    kind = F.pmod(F.crc32(F.encode(F.concat_ws(":", _known(F.col("conv_id")), _known(F.col("turn"))), "UTF-8")), F.lit(20))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _known(F.col("role")).alias("role"), _known(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def flagged(turns: DataFrame) -> DataFrame:
    """Add pos (place in the conversation, from 1), fault (blank, duplicate, truncated, or null), illegal and fresh to turns(conv_id, turn, role, text, dropped).

    Rows are in order of turn, nulls first, then role and text. A row's first fault counts. illegal: whether the
    initials of the row before and of this one are no legal pair. fresh: whether its turn is one not seen before.
    """
    own = Window.partitionBy("conv_id", "dropped").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("pos")
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    initial = F.left("role", F.lit(1))
    # the windows' rows all lie in their conversation's partition, so this is one shuffle
    rows = turns.repartition("conv_id").withColumn("pos", F.row_number().over(own)).withColumn("__before", F.lag(initial).over(own))
    fault = F.when(end == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    pair = F.concat("__before", initial)
    rows = rows.withColumn("fresh", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(own)))
    return rows.withColumn("fault", fault).withColumn("illegal", F.coalesce(~pair.isin(*LEGAL), F.lit(False))).drop("__before")


_AT = ("none", "system", "user", "assistant")


def _path(cost, audit) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))


def _more(path: Column, cost: Column | int, letter: str) -> Column:
    """A path with one more edit; null (not reachable) stays so."""
    added = F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], F.lit(letter)).alias("audit"))
    return F.when(path.isNotNull(), added)


def _bind(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _with_inserts(at: Column) -> Column:
    """Paths after any inserts: one makes a user or an assistant turn of what went before, two are enough."""
    user = F.least(at["user"], *[_more(at[s], INSERT, "I") for s in ("none", "system", "assistant")])

    def assistant(user: Column) -> Column:
        best = F.least(at["assistant"], _more(user, INSERT, "I"))
        return F.struct(at["none"].alias("none"), at["system"].alias("system"), user.alias("user"), best.alias("assistant"))

    return _bind(user, assistant)


def _step(at: Column, turn: Column) -> Column:
    """Paths after one more row: deleted, kept or with another role; least() passes over what can't be."""
    extra = F.when(turn["truncated"], TRUNCATED).otherwise(0)
    deleted = {s: _more(at[s], DELETE, "D") for s in _AT}
    kept = lambda path, initial: F.when((turn["initial"] == initial) & ~turn["must_go"], _more(path, extra, "K"))
    reroled = lambda path: F.when(~turn["must_go"], _more(path, extra + REROLE, "R"))
    starts = [at[s] for s in ("none", "system", "assistant")]
    return F.struct(
        deleted["none"].alias("none"),
        F.least(deleted["system"], kept(at["none"], "s")).alias("system"),
        F.least(deleted["user"], *[kept(p, "u") for p in starts], *[reroled(p) for p in starts]).alias("user"),
        F.least(deleted["assistant"], kept(at["user"], "a"), reroled(at["user"])).alias("assistant"),
    )


def cheapest_edits(turns: Column) -> Column:
    """The (cost, audit) struct of the cheapest edits to an ordered array of (initial, must_go, truncated).

    A fold over the turns that carries the best path to each of four places in the pattern `(s?(ua)+)?`: nothing
    kept yet, a system turn, a user turn, an assistant turn last. Of equal costs the ASCII-least audit wins. It is
    enough to keep one path a place: an audit's letters fix its cost, so of two equally cheap ones neither
    begins the other, and what follows can't turn their order. They also fix every role: places alternate.
    """
    kind = "struct<cost:bigint,audit:string>"
    none = F.lit(None).cast(kind)
    start = F.struct(_path(0, "").cast(kind).alias("none"), none.alias("system"), _path(INSERT, "I").cast(kind).alias("user"), _path(2 * INSERT, "II").cast(kind).alias("assistant"))
    whole = ",".join(f"{s}:{kind}" for s in _AT)
    fold = lambda at, turn: _bind(_step(at, turn), _with_inserts).cast(f"struct<{whole}>")
    return F.aggregate(turns, start.cast(f"struct<{whole}>"), fold, lambda at: F.least(at["none"], at["assistant"]))


def repaired_turns(turns: Column, audit: Column) -> Column:
    """The array of (role, text) that an audit makes of an ordered array of turns with role and text.

    One token of the audit belongs to each turn: the inserts before it, and its own letter. The turns that are
    left alternate, after a system turn that was kept; so inserted and reroled ones take their role from their place.
    """
    made = "struct<role:string,text:string>"
    new = lambda text: F.struct(F.lit(None).cast("string").alias("role"), text.alias("text")).cast(made)
    inserted = lambda n: F.when(n > 0, F.array_repeat(new(F.lit("")), n)).otherwise(F.array().cast(f"array<{made}>"))

    def of_turn(turn: Column, token: Column) -> Column:
        own = F.when(token.endswith("K"), F.array(F.struct(turn["role"].alias("role"), turn["text"].alias("text")).cast(made))).when(token.endswith("R"), F.array(new(turn["text"])))
        return F.concat(inserted(F.length(token) - 1), F.coalesce(own, F.array().cast(f"array<{made}>")))

    tokens = F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0))
    parts = F.concat(F.flatten(F.zip_with(turns, tokens, of_turn)), inserted(F.length(audit) - F.length(F.rtrim(audit, F.lit("I")))))
    def with_roles(made: Column) -> Column:
        after = F.when(F.left(F.element_at(made, 1)["role"], F.lit(1)) == "s", 1).otherwise(0)
        role = lambda i: F.when((i - after) % 2 == 0, "user").otherwise("assistant")
        return F.transform(made, lambda p, i: F.struct(F.coalesce(p["role"], role(i)).alias("role"), p["text"].alias("text")))

    return F.when(F.size(parts) > 0, _bind(parts, with_roles)).otherwise(F.array().cast(f"array<{made}>"))


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits that put its turns in a legal order, and the turns that they leave.

    turns needs conv_id, turn, role, text and may have `dropped` (rows that only make their conversation known);
    other columns are ignored. Roles go by their initial: legal are an optional s, then u and a in turn, a last;
    or nothing. Keep costs 0, another role (user or assistant) 3, Delete 4 (the only choice for blank and duplicate
    rows), an inserted empty turn 3; a truncated row that stays costs 3 more.

    Returns conv_id, gaps (turn numbers that are missing between the least and the greatest; null if beyond a
    long), blank, duplicate, truncated, illegal, cost, audit (the edits' initials, K, R, D, I) and repaired (array of
    role, text). A null role or text is one space; a null turn is before all others and no gap; a null conv_id is a
    conversation of its own. Turns of one number are in order of role and text; repeated rows are duplicates. A
    conversation without rows has zeros and empties; an empty table gives none.

    A conversation's turns meet in one task, as its audit and its repaired turns are one row: it is that row which
    bounds a conversation, at Spark's 2 GB. Texts cross one shuffle. The fold itself carries initials and flags.
    """
    known = turns if "dropped" in turns.columns else turns.withColumn("dropped", F.lit(False))
    rows = flagged(known.select("conv_id", F.col("turn").cast("long").alias("turn"), _known(F.col("role")).alias("role"), _known(F.col("text")).alias("text"), "dropped"))
    here = ~F.col("dropped")
    count = lambda what: F.count(F.when(here & what, 1))
    fault = lambda name: count(F.col("fault") == name).alias(name)
    struct = F.struct("pos", F.left("role", F.lit(1)).alias("initial"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"), "role", "text")
    turn = F.when(here, F.col("turn")).cast("decimal(20,0)")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("fresh")), F.lit(0))
    out = rows.groupBy("conv_id").agg(
        gaps.try_cast("long").alias("gaps"),
        fault("blank"),
        fault("duplicate"),
        fault("truncated"),
        count(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(F.when(here, struct))).alias("turns"),
    )
    slim = F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["must_go"].alias("must_go"), t["truncated"].alias("truncated")))
    out = out.withColumn("edits", cheapest_edits(slim)).withColumn("audit", F.col("edits.audit"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("edits.cost").alias("cost"), "audit", repaired_turns(F.col("turns"), F.col("audit")).alias("repaired"))


def digest(repaired: DataFrame) -> DataFrame:
    """repair's rows with repaired_sha256 (of `role:text`, newline-joined) in place of the turns."""
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
