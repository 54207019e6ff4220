"""Role-mapped CSV tables: block models, drill bundles, geophysics, delays; strict or lenient as each format is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import usable

#: Fixed names: headers of a block model, in any case; any other is a value.
BLOCK_ROLES = ("x", "y", "z", "dx", "dy", "dz", "id")
#: Fixed names: headers of each role by file, without signs and in lower case; those of the second tuple count only if the first has none.
_HOLE = (("dhid", "holeid", "hole"), ("id",))
_PLACE = {"east": (("east", "easting", "x"), ()), "north": (("north", "northing", "y"), ()), "elevation": (("elevation", "elev", "rl", "z"), ("height",))}
DRILL_ROLES = {
    "collar": {"dhid": _HOLE, **_PLACE, "diameter": (("diameter", "diam"), ())},
    "survey": {"dhid": _HOLE, "depth": (("depth", "at", "md"), ("dep",)), **_PLACE, "azimuth": (("azimuth", "azi", "bearing"), ()), "dip": (("dip",), ()), "inclination": (("inc", "incl", "incline", "inclination"), ())},
    "interval": {"dhid": _HOLE, "from": (("from",), ("depfr", "depthfrom")), "to": (("to",), ("depto", "depthto"))},
    "segments": {"dhid": _HOLE, "from": (("from",), ()), "to": (("to",), ()), "x1": (("starteast", "startx", "x1"), ()), "y1": (("startnorth", "starty", "y1"), ()), "z1": (("startelevation", "startz", "z1"), ()), "x2": (("endeast", "endx", "x2"), ()), "y2": (("endnorth", "endy", "y2"), ()), "z2": (("endelevation", "endz", "z2"), ()), "diameter": (("diameter", "diam"), ())},
    "geophysics": {"dhid": _HOLE, "depth": (("depth",), ("dep", "md")), "gamma": (("gam", "gamma", "gr", "grde", "gamm"), ()), "long density": (("lsd", "denl", "longdensity", "longspaceddensity"), ()), "short density": (("ssd", "denb", "shortdensity", "shortspaceddensity"), ())},
}
#: Roles without which a file can't be read.
NEEDED = {"collar": ("dhid", "east", "north", "elevation"), "survey": ("dhid", "depth"), "interval": ("dhid", "from", "to")}


def header_key(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def unique_names(names: list[str]) -> list[str]:
    """Repeated headers get a number."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def block_roles(headers: list[str]) -> list[str]:
    """A role for each column; the first claim wins, later ones are values."""
    taken, out = set(), []
    for h in headers:
        key = h.strip().lower()
        role = key if key in BLOCK_ROLES and key not in taken else "value"
        taken.add(role)
        out.append(role)
    return out


def drill_roles(kind: str, headers: list[str]) -> dict[str, str]:
    """Role -> header. A specific name wins over a generic one; where several name a role equally well, none has it."""
    out: dict[str, str] = {}
    for role, tiers in DRILL_ROLES[kind].items():
        for tier in tiers:
            named = [h for h in headers if header_key(h) in tier]
            if named:
                if len(named) == 1:
                    out[role] = named[0]
                break
    return out


def named_headers(kind: str, headers: list[str]) -> set[str]:
    """The headers that name some role of a file, those that lost it among them: these are no attributes."""
    names = {n for tiers in DRILL_ROLES[kind].values() for tier in tiers for n in tier}
    return {h for h in headers if header_key(h) in names}


def guessed_kind(headers: list[str]) -> str | None:
    """geophysics for a file with a depth and a gamma or density column; no other kind is guessed."""
    named = {role for role, tiers in DRILL_ROLES["geophysics"].items() for tier in tiers for h in headers if header_key(h) in tier}
    return "geophysics" if "depth" in named and named & {"gamma", "long density", "short density"} else None


def validate_roles(roles: list[str], fixed: tuple[float, float, float] | None) -> str | None:
    """Why a block model can't be read with these roles, or None."""
    for r in "xyz":
        if roles.count(r) != 1:
            return f"exactly one column must be {r}"
    for i, r in enumerate(("dx", "dy", "dz")):
        if roles.count(r) > 1:
            return f"at most one column may be {r}"
        if roles.count(r) == 0 and not (fixed and fixed[i] > 0):
            return f"{r} needs a column or a positive size"
    return None


def preview(spark: SparkSession, path: str, rows: int = 5) -> tuple[list[str], list[str]]:
    """Headers and kinds (numeric or category) from a few rows; anything that isn't a number makes a category."""
    head = spark.read.option("header", True).csv(path).limit(rows)
    sample = head.collect()

    def number(x) -> bool:
        try:
            float(x)
            return True
        except ValueError:
            return False

    return head.columns, ["numeric" if all(r[i] is None or not r[i].strip() or number(r[i].strip()) for r in sample) else "category" for i in range(len(head.columns))]


def _number(c: Column, where: str) -> Column:
    t = F.trim(c)
    v = t.try_cast("double")
    bad = (t != "") & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{where}: not a finite number: "), t)).cast("double")).otherwise(v)


def read_block_model(spark: SparkSession, path: str, categories: list[str] | None = None, fixed: tuple[float, float, float] | None = None) -> DataFrame:
    """xl..zu and the values of a block-model CSV. Strict: the first bad number, size or duplicate id fails the read; blanks are null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    headers = unique_names(raw.columns)
    roles = block_roles(headers)
    issue = validate_roles(roles, fixed)
    if issue:
        raise ValueError(issue)
    df = raw.toDF(*headers)
    at = {r: F.col(f"`{headers[roles.index(r)]}`") for r in set(roles) if r != "value"}
    out = []
    for i, a in enumerate("xyz"):
        centre = _number(at[a], a)
        size = _number(at["d" + a], "d" + a) if "d" + a in at else F.lit(float(fixed[i]))
        size = F.when(size > 0, size).otherwise(F.raise_error(F.lit(f"d{a}: a size must be positive")).cast("double"))
        centre = F.coalesce(centre, F.raise_error(F.lit(f"{a}: a position is blank")).cast("double"))
        out += [(centre - size / 2).alias(f"{a}l"), (centre + size / 2).alias(f"{a}u")]
    if "id" in at:
        out.append(_number(at["id"], "id").alias("id"))
    for h, r in zip(headers, roles, strict=True):
        if r == "value":
            c = F.col(f"`{h}`")
            out.append((F.nullif(F.trim(c), F.lit("")) if h in (categories or []) else _number(c, h)).alias(h))
    blocks = df.select(*out)
    if "id" in at:
        n = F.count(F.lit(1)).over(Window.partitionBy("id"))
        blocks = blocks.withColumn("id", F.when(n > 1, F.raise_error(F.lit("a block id occurs twice")).cast("double")).otherwise(F.col("id")))
    return blocks


def write_block_model(blocks: DataFrame, path: str, values: list[str], default: float | None = None) -> None:
    """Centroids, sizes and values; sentinels, defaults and NaN are written blank."""
    cols = [x for a in "xyz" for x in (((F.col(f"{a}l") + F.col(f"{a}u")) / 2).alias(a), (F.col(f"{a}u") - F.col(f"{a}l")).alias(f"d{a}"))]
    kinds = dict(blocks.dtypes)
    cols += [(F.when(usable(F.col(v), default), F.col(v)) if kinds[v] == "double" else F.col(v)).alias(v) for v in values]
    blocks.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_drill_bundle(spark: SparkSession, collar: str, survey: str, interval: str) -> dict[str, DataFrame]:
    """collar, survey and interval tables, (kind, reason, rows) of what was left out, and the survey's angles.

    Lenient: the first collar of a hole, in file order, wins; rows that can't be read and rows of unknown holes are
    left out and counted apart; a file with over half its rows unreadable fails. An attribute is a number only if
    every cell of it that isn't blank is one.

    A survey row has a dip, or an inclination, which is read downward unless all the file's are upward by sign (see
    survey_angles), and stands with a whole direction or a whole position. A tilt beyond a right angle leaves the row
    without a direction.
    """
    out: dict[str, DataFrame] = {}
    dropped = []

    def load(kind: str, path: str) -> tuple[DataFrame, list[str]]:
        raw = spark.read.option("header", True).csv(path)
        headers = raw.columns
        roles = drill_roles(kind, headers)
        missing = [r for r in NEEDED[kind] if r not in roles]
        if missing:
            raise ValueError(f"{kind}: no one column for {', '.join(missing)}")
        others = [h for h in headers if h not in named_headers(kind, headers)] if kind == "interval" else []
        cols = [(F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")) if r == "dhid" else F.trim(F.col(f"`{h}`")).try_cast("double")).alias(r) for r, h in roles.items()]
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("id")).alias("__row")
        df = raw.select(*cols, *[F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")).alias(h) for h in others], place)
        if kind == "survey":
            df = with_directions(df)
        ok = F.lit(True)
        for r in NEEDED[kind]:
            ok = ok & F.col(r).isNotNull()
        if kind == "interval":
            ok = ok & (F.col("from") < F.col("to"))
        if kind == "survey":
            whole = F.col("east").isNotNull() & F.col("north").isNotNull() & F.col("elevation").isNotNull() if {"east", "north", "elevation"} <= set(roles) else F.lit(False)
            ok = ok & ((F.col("azimuth").isNotNull() & F.col("dip").isNotNull()) | whole)
        n, good = df.agg(F.count(F.lit(1)), F.count_if(ok)).first()
        if n and good * 2 < n:
            raise ValueError(f"{kind}: {n - good} of {n} rows can't be read")
        dropped.append((kind, "unreadable", n - good))
        return df.where(ok), others

    def with_directions(df: DataFrame) -> DataFrame:
        """azimuth and dip; what the file's angles look like is kept."""
        none = F.lit(None).cast("double")
        df = df.withColumns({c: none for c in ("azimuth", "dip", "inclination") if c not in df.columns})
        found = survey_angles(df.select(F.lit(0).alias("file"), "inclination", "dip", "azimuth"), ["file"]).drop("file")
        out["angles"] = found
        seen = found.first()
        tilt = F.coalesce("dip", F.col("inclination") if seen and seen["inclination_is_dip"] else -F.col("inclination"))
        return df.withColumn("dip", F.when(F.abs(tilt) <= 90, tilt)).drop("inclination")

    c, _ = load("collar", collar)
    c = c.groupBy("dhid").agg(F.min_by(F.struct(*[x for x in c.columns if x not in ("dhid", "__row")]), "__row").alias("r")).select("dhid", "r.*")
    out["collar"] = c
    for kind, path in (("survey", survey), ("interval", interval)):
        df, others = load(kind, path)
        dropped.append((kind, "orphan", df.join(c.select("dhid"), "dhid", "left_anti").count()))
        df = df.join(c.select("dhid"), "dhid", "left_semi").drop("__row")
        if kind == "interval" and others:
            numeric = df.agg(*[F.bool_and(F.col(f"`{h}`").isNull() | F.col(f"`{h}`").try_cast("double").isNotNull()).alias(h) for h in others]).first()
            df = df.withColumns({h: F.col(f"`{h}`").try_cast("double") for h in others if numeric[h]})
        out[kind] = df
    out["dropped"] = spark.createDataFrame(dropped, "kind string, reason string, rows long")
    return out


def desurvey(collar: DataFrame, survey: DataFrame) -> DataFrame:
    """(dhid, depth, x, y, z): tangential traces; each leg keeps the orientation at its start."""
    w = Window.partitionBy("dhid").orderBy("depth")
    leg = F.col("depth") - F.coalesce(F.lag("depth").over(w), F.lit(0.0))
    az = F.radians(F.coalesce(F.lag("azimuth").over(w), F.col("azimuth")))
    dip = F.radians(F.coalesce(F.lag("dip").over(w), F.col("dip")))
    steps = survey.withColumn("__l", leg).withColumns({"__x": F.col("__l") * F.sin(az) * F.cos(dip), "__y": F.col("__l") * F.cos(az) * F.cos(dip), "__z": F.col("__l") * F.sin(dip)})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("dhid", "depth", *[F.sum(f"__{a}").over(run).alias(f"__{a}") for a in "xyz"])
    return sums.join(collar, "dhid").select("dhid", "depth", (F.col("east") + F.col("__x")).alias("x"), (F.col("north") + F.col("__y")).alias("y"), (F.col("elevation") + F.col("__z")).alias("z"))


def read_delays(spark: SparkSession, lines: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, start, end) of lines(line, value): tab, else comma, else semicolon; all or nothing, with each problem by line number."""
    from ..functions.time import parse_time

    sep = F.when(F.contains("value", F.lit("\t")), F.lit("\t")).when(F.contains("value", F.lit(",")), F.lit(",")).otherwise(F.lit(";"))
    cells = lines.where(F.trim("value") != "").withColumn("c", F.split("value", sep))
    cells = cells.where(~((F.col("line") == 1) & F.lower(F.trim(F.col("c")[0])).isin("agent", "machine", "loader")))
    get = lambda i: F.trim(F.get("c", F.lit(i)))
    parsed = cells.select("line", get(0).alias("name"), parse_time(get(1)).alias("start"), parse_time(get(2)).alias("end"))
    known = agents.select(F.lower("name").alias("__k"), "agent")
    j = parsed.join(known, F.lower("name") == F.col("__k"), "left")
    problem = F.when(F.col("agent").isNull(), "unknown machine").when(F.col("start").isNull() | F.col("end").isNull(), "not a time").when(F.col("start") >= F.col("end"), "ends before it starts")
    j = j.withColumn("problem", problem)
    bad = j.where("problem IS NOT NULL").orderBy("line").limit(100).select("line", "problem").collect()
    if bad:
        raise ValueError("; ".join(f"line {r[0]}: {r[1]}" for r in bad))
    return j.select("agent", "start", "end")


def index_geophysics(spark: SparkSession, path: str, out: str, hole: str, depth: str) -> DataFrame:
    """Write depth series as Parquet by hole, so that one hole's curves are read by partition; returns spans by hole."""
    raw = spark.read.option("header", True).csv(path)
    cols = [F.trim(F.col(f"`{c}`")).try_cast("double").alias(c) for c in raw.columns if c != hole]
    df = raw.select(F.trim(F.col(f"`{hole}`")).alias("dhid"), *cols).where(F.col("dhid").isNotNull() & F.col(depth).isNotNull())
    # holes are spread by depth as well, so that a hole with very many readings is no single task
    df.repartition("dhid", F.floor(F.col(depth) / 1000)).write.mode("overwrite").partitionBy("dhid").parquet(out)
    return spark.read.parquet(out).groupBy("dhid").agg(F.min(depth).alias("top"), F.max(depth).alias("bottom"), F.count(F.lit(1)).alias("readings"))


def read_hole(spark: SparkSession, out: str, dhid: str) -> DataFrame:
    return spark.read.parquet(out).where(F.col("dhid") == dhid)


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def survey_angles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inclination_is_dip, azimuth_off_compass, tilt_not_an_angle) of rows(keys, inclination, azimuth, and dip if there is one); one pass.

    Inclinations that are all upward by sign, none downward, are dips already. Tilts beyond a right angle, of
    inclinations and dips alike, and azimuths off the compass are counted; a missing angle counts nowhere.
    """
    tilt, azimuth = F.col("inclination"), F.col("azimuth")
    angle = F.abs(tilt) <= 90
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    more = F.count_if(~(F.abs(F.col("dip")) <= 90)) if "dip" in rows.columns else F.lit(0)
    return rows.groupBy(*keys).agg(
        (any_of(angle & (tilt < 0)) & ~any_of(angle & (tilt > 0))).alias("inclination_is_dip"),
        F.count_if(~((azimuth >= 0) & (azimuth <= 360))).alias("azimuth_off_compass"),
        (F.count_if(~angle) + more).alias("tilt_not_an_angle"),
    )
