"""Matching entities across sources without keys: loopy belief propagation with one-to-one factors.

Candidate pairs come from joins on several narrow keys, each of which survives another kind of noise. A pair's evidence
is a sum of log likelihood ratios over partial attributes; how a source writes teams and positions is learned from pairs
whose name and birth date agree. Every listing is a factor that takes at most one entity, every (entity, source) a factor
that takes one listing and, at a price, repeated ones. Messages are exchanged by sums over the pair table, once by
listing and once by entity and source, until the marginals stand still; each listing comes out with the likeliest entity or none, and that probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.session import stage

REPEAT_PRICE = 0.1
LISTED = 0.85
ROUNDS, TOLERANCE, DAMPING = 200, 2e-3, 0.3
TOP, FAINT = 30.0, -6.0
HOT_BLOCK = 200
# records of either side in a cell of a hot block, and pairs of hot blocks in a task
CELL, TASK_PAIRS = 1000, 500_000

# fixed values: name suffixes that do not tell people apart
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "v"}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def plain(text: str) -> str:
    folded = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae"))
    return "".join(ch for ch in folded if not unicodedata.combining(ch)).lower()


def split_name(name: str | None) -> tuple[str, str, str]:
    """(first, last, the last name before a hyphen), letters only; "Last, First" and suffixes are understood."""
    if not name:
        return "", "", ""
    parts = [re.sub(r"[’'`´]", "", p) for p in plain(name).split(",")]
    words = [[w for w in re.split(r"[^a-z\-]+", p) if w.strip("-")] for p in parts]
    words = [[w for i, w in enumerate(ws) if w not in SUFFIXES or (len(words) == 1 and i == 0)] for ws in words]
    words = [ws for ws in words if ws]
    if not words:
        return "", "", ""
    if len(words) > 1:
        first, last = words[1][0], words[0]
    elif len(words[0]) == 1:
        first, last = "", words[0]
    else:
        first, last = words[0][0], words[0][1:]
    joined = "".join(last)
    return first.replace("-", ""), joined.replace("-", ""), joined.split("-")[0]


def parse_dates(text: str | None) -> list[str]:
    """The dates a written birth date can mean, as ISO strings: two where day and month can be swapped."""
    if not text:
        return []
    t = text.strip().lower()
    named = re.search(r"([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})", t) or re.search(r"(\d{1,2})\.?\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})", t)
    out = []
    if named:
        a, b, year = named.groups()
        month, day = (MONTHS.get(a), b) if a.isalpha() else (MONTHS.get(b), a)
        out = [(year, month, day)]
    elif m := re.fullmatch(r"(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})(?:[ t].*)?", t):
        out = [m.groups()]
    elif m := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})", t):
        a, sep, b, year = m.groups()
        out = [(year, b, a)] if sep == "." else [(year, a, b), (year, b, a)]
    good = []
    for y, mo, d in out:
        if mo and 1 <= int(mo) <= 12 and 1 <= int(d) <= 31:
            iso = f"{int(y):04d}-{int(mo):02d}-{int(d):02d}"
            if iso not in good:
                good.append(iso)
    return good


def _stem(text: str | None) -> str:
    return " ".join(re.split(r"[^a-z0-9&]+", plain(text).replace(" state", " st").replace(" college", ""))).strip() if text else ""


def _keys(first: str, last: str, main: str, dates: list[str], college: str, jersey: object, rookie: object) -> list[str]:
    keys = set()
    if last:
        initial = first[:1]
        for form in {last, main}:
            keys |= {f"n|{form}|{initial}", *(f"b|{form}|{d}" for d in dates)}
            if rookie is not None:
                keys.add(f"r|{form}|{rookie}")
            if jersey is not None:
                keys.add(f"j|{form}|{jersey}")
            if college:
                keys.add(f"c|{form}|{college.split(' ')[0]}")
        if len(last) > 4:
            keys |= {f"d|{last[:i]}{last[i + 1 :]}|{first[:2]}" for i in range(len(last))} | {f"d|{last}|{first[:2]}"}
        keys |= {f"i|{d}|{last[:1]}" for d in dates}
    keys |= {f"f|{d}|{first[:1]}" for d in dates if first}
    return sorted(keys)


def prepared(df: DataFrame, ids: dict[str, Column], columns: dict[str, Column]) -> DataFrame:
    """Normalised attributes and blocking keys. ``columns``: name, position, team, birth_date, college, jersey, rookie."""

    @F.pandas_udf("first string, last string, main string, dates array<string>, college string, keys array<string>")
    def norm(name: pd.Series, birth: pd.Series, college: pd.Series, jersey: pd.Series, rookie: pd.Series) -> pd.DataFrame:
        rows = []
        for n, b, c, j, r in zip(name, birth, college, jersey, rookie):
            first, last, main = split_name(n)
            dates, stem = parse_dates(b), _stem(c)
            rows.append((first, last, main, dates, stem, _keys(first, last, main, dates, stem, None if pd.isna(j) else int(j), None if pd.isna(r) else int(r))))
        return pd.DataFrame(rows, columns=["first", "last", "main", "dates", "college", "keys"])

    text = {k: columns[k].cast("string") for k in ("name", "birth_date", "college")}
    base = df.select(*[c.alias(n) for n, c in ids.items()], norm(text["name"], text["birth_date"], text["college"], columns["jersey"].cast("double"), columns["rookie"].cast("double")).alias("x"), F.lower(F.trim(columns["position"])).alias("position"), F.lower(F.trim(columns["team"])).alias("team"), columns["jersey"].cast("int").alias("jersey"), columns["rookie"].cast("int").alias("rookie"))
    return base.select(*ids, "x.*", F.when(F.col("position") != "", F.col("position")).alias("position"), F.when(~F.col("team").isin("", "fa", "none"), F.col("team")).alias("team"), "jersey", "rookie")


def _attributes() -> Column:
    """What else a record can agree in, for blocks that one key alone leaves too large."""
    c = F.col
    single = [F.when(c("college") != "", F.concat(F.lit("c"), F.split("college", " ")[0])), F.concat(F.lit("j"), c("jersey").cast("string")), F.concat(F.lit("r"), c("rookie").cast("string"))]
    return F.concat(F.array_compact(F.array(*single)), F.transform("dates", lambda d: F.concat(F.lit("d"), d)))


def _held(key: Column) -> Column:
    """The kind of attribute a key holds already, which splits nothing."""
    return F.translate(F.substring(key, 1, 1), "bif", "ddd")


def _hot_keys(listings: DataFrame, entities: DataFrame, hot_block: int) -> DataFrame | None:
    """(key, n_entities, n_listings) of the keys that more than ``hot_block`` entities and some listing share, if any."""
    many = entities.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_entities")).where(F.col("n_entities") > hot_block)
    many = stage(many, "match-hot")
    if many.isEmpty():
        return None
    asked = listings.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_listings"))
    hot = stage(many.join(asked, "key"), "match-hot")
    return None if hot.isEmpty() else hot


def _narrow(listings: DataFrame, entities: DataFrame, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        keys = lambda df, name: df.select(name, F.explode("keys").alias("key"))
        return keys(listings, "listing_id").join(keys(entities, "record_id"), "key").select("listing_id", "record_id").distinct()
    flags = hot.select("key", F.lit(True).alias("hot"))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        each = df.select(name, _attributes().alias("more"), F.explode("keys").alias("key")).join(flags, "key", "left")
        split = F.when(F.col("hot"), F.transform(F.filter("more", lambda m: F.substring(m, 1, 1) != _held(F.col("key"))), lambda m: F.concat("key", F.lit("|"), m))).otherwise(F.array("key"))
        return each.select(name, F.explode(split).alias("key"))

    return keyed(listings, "listing_id").join(keyed(entities, "record_id"), "key").select("listing_id", "record_id").distinct()


def candidates(listings: DataFrame, entities: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(listing_id, record_id) once for every pair that shares a narrow blocking key.

    A key that more than ``hot_block`` entities share is split: pairs of its block must agree in one more attribute. The
    pairs that do not are left to ``_rest``; ``evidence`` takes both.
    """
    return _narrow(listings, entities, _hot_keys(listings, entities, hot_block))


def _rest(listings: DataFrame, entities: DataFrame, l: DataFrame, e: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs of hot blocks that ``_narrow`` leaves out, each once, as rows of ``l`` beside rows of ``e``.

    They are met with their attributes, so they can be scored where they are met and are neither written nor moved. A block
    is cut into cells of about CELL records of either side, so that no task has a large one to itself.
    """
    c = F.col
    pairs = hot.agg(F.sum(c("n_listings") * c("n_entities"))).first()[0]
    tasks = math.ceil(pairs / TASK_PAIRS)
    cells = hot.select("key", F.ceil(c("n_listings") / CELL).alias("across"), F.ceil(c("n_entities") / CELL).alias("down"))

    def dealt(df: DataFrame, rows: DataFrame, name: str, prefix: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        wide = df.select(name, F.explode("keys").alias("key")).join(hot.select("key"), "key").groupBy(name).agg(F.collect_set("key").alias("wide"))
        parts = df.select(name, "keys", _attributes().alias("more")).join(wide, name)
        parts = parts.select(name, c("wide").alias(f"{prefix}wide"), F.array_except("keys", "wide").alias(f"{prefix}cold"), c("more").alias(f"{prefix}more"), F.explode("wide").alias("key")).join(cells, "key")
        placed = parts.withColumn(own[0], F.pmod(F.xxhash64(name), c(own[1]))).withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), c(other[1]) - 1))).drop("across", "down")
        return rows.join(placed, name).repartition(tasks, "key", "x", "y")

    met = dealt(listings, l, "listing_id", "", ("x", "across"), ("y", "down")).join(dealt(entities, e, "record_id", "e_", ("y", "down"), ("x", "across")), ["key", "x", "y"])
    shared, agreed = F.array_intersect("wide", "e_wide"), F.array_intersect("more", "e_more")
    # who has the same last name and shares a d key shares the n key too, which is greater
    met = met.where((F.substring("key", 1, 1) != "d") | (c("last") != c("e_last"))).where(c("key") == F.array_max(shared))
    narrow = F.arrays_overlap("cold", "e_cold") | F.exists(shared, lambda k: F.exists(agreed, lambda m: F.substring(m, 1, 1) != _held(k)))
    return met.where(~narrow).select(*l.columns, *e.columns)


def _plain_pairs(listings: DataFrame, entities: DataFrame) -> DataFrame:
    """(team, position, e_team, e_position, n): how often they meet in pairs of equal names with a birth date in common."""
    c = F.col
    kinds = lambda df, n: df.where((c("last") != "") & (F.size("dates") > 0)).groupBy("first", "last", "dates", "team", "position").agg(F.count(F.lit(1)).alias(n))
    l = kinds(listings, "n_l").withColumn("date", F.explode("dates"))
    e = kinds(entities, "n_e").select("first", "last", "n_e", F.explode("dates").alias("date"), *[c(k).alias(f"e_{k}") for k in ("dates", "team", "position")])
    once = l.join(e, ["first", "last", "date"]).where(c("date") == F.array_min(F.array_intersect("dates", "e_dates")))
    return once.groupBy("team", "position", "e_team", "e_position").agg(F.sum(c("n_l") * c("n_e")).alias("n"))


def _dialect(pairs: DataFrame, source: str, entity: str, name: str) -> DataFrame:
    """How listings write an attribute: the likelihood ratio of (written, meant), from pairs whose identity is plain."""
    seen = pairs.where(F.col(source).isNotNull() & F.col(entity).isNotNull()).groupBy(F.col(source).alias(f"{name}_w"), F.col(entity).alias(f"{name}_m")).agg(F.sum("n").alias("n"))
    written = seen.groupBy(f"{name}_w").agg(F.sum("n").alias("nw"))
    meant = seen.groupBy(f"{name}_m").agg(F.sum("n").alias("nm"))
    joined = seen.join(written, f"{name}_w").join(meant, f"{name}_m").crossJoin(F.broadcast(seen.agg(F.sum("n").alias("nn"))))
    # add-one smoothing keeps rare writings weak
    ratio = F.log((F.col("n") / (F.col("nw") + 1.0)) / (F.col("nm") / F.col("nn")))
    return joined.select(f"{name}_w", f"{name}_m", ratio.alias(f"{name}_llr"))


def _scored(pairs: DataFrame, teams: DataFrame, positions: DataFrame) -> DataFrame:
    """(listing_id, source_id, player_id, sole, psi) of pairs with the attributes of both sides."""
    c = F.col
    same_last = (c("last") == c("e_last")) & (c("last") != "")
    part_last = (c("main") == c("e_main")) & (c("main") != "") | (c("main") == c("e_last")) & (c("main") != "") | (c("last") == c("e_main")) & (c("last") != "")
    far_last = F.levenshtein("last", "e_last")
    size = F.length("last")
    share_last, share_first = c("n_last") / c("population"), c("n_first") / c("population")
    last = F.when(c("last") == "", 0.0).when(same_last, F.log(0.85 / share_last)).when(part_last, F.log(0.05 / share_last)).when(far_last <= F.when(size >= 8, 2).otherwise(1), F.log(0.07 / F.least(F.lit(0.5), share_last * 4))).otherwise(-5.0)
    head = F.substring("first", 1, 1) == F.substring("e_first", 1, 1)
    stem = F.expr("length(first) >= 3 and substring(first, 1, length(first) - 1) = substring(e_first, 1, length(first) - 1)")
    far_first = F.levenshtein("first", "e_first")
    first = (
        F.when((c("first") == "") | (c("e_first") == ""), 0.0)
        .when(c("first") == c("e_first"), F.log(0.6 / share_first))
        .when((F.length("first") == 1) & head, F.log(F.lit(0.12 / 0.06)))
        .when(stem, F.log(0.12 / F.least(F.lit(0.5), share_first * 4 + 0.01)))
        .when((far_first <= F.when(F.length("first") >= 6, 2).otherwise(1)) & (F.length("first") > 2), F.log(0.1 / F.least(F.lit(0.5), share_first * 4 + 0.005)))
        .otherwise(-4.0)
    )
    known_dates = (F.size("dates") > 0) & (F.size("e_dates") > 0)
    near = F.expr("exists(dates, d -> exists(e_dates, x -> levenshtein(d, x) <= 1 or substring(d, 6) = substring(x, 6)))")
    dates = F.when(~known_dates, 0.0).when(F.arrays_overlap("dates", "e_dates"), F.log(F.lit(0.9 / (1 / 6500)))).when(near, F.log(F.lit(0.04 / 0.006))).otherwise(-5.5)
    known_college = (c("college") != "") & (c("e_college") != "")
    college = F.when(~known_college, 0.0).when(c("college") == c("e_college"), F.log(F.lit(0.6 / 0.012))).when(F.split("college", " ")[0] == F.split("e_college", " ")[0], F.log(F.lit(0.3 / 0.05))).otherwise(F.log(F.lit(0.1)))
    jersey = F.when(c("jersey").isNull() | c("e_jersey").isNull(), 0.0).when(c("jersey") == c("e_jersey"), F.log(F.lit(0.8 / 0.0105))).otherwise(F.log(F.lit(0.2)))
    gap = F.abs(c("rookie") - c("e_rookie"))
    rookie = F.when(gap.isNull(), 0.0).when(gap == 0, F.log(F.lit(0.85 / 0.06))).when(gap == 1, F.log(F.lit(0.1 / 0.12))).otherwise(F.log(F.lit(0.06)))
    base = last + first + dates + college + jersey + rookie
    scored = pairs.select("listing_id", "source_id", "player_id", "sole", "position", "team", "e_position", "e_team", "population", base.alias("base"))
    told = scored.join(F.broadcast(teams), (c("team") == c("team_w")) & (c("e_team") == c("team_m")), "left").join(F.broadcast(positions), (c("position") == c("position_w")) & (c("e_position") == c("position_m")), "left")
    team = F.when(c("team").isNull() | c("e_team").isNull(), 0.0).otherwise(F.coalesce(F.greatest(F.lit(-1.2), F.least(F.lit(3.2), c("team_llr"))), F.lit(-1.2)))
    position = F.when(c("position").isNull() | c("e_position").isNull(), 0.0).otherwise(F.coalesce(F.greatest(F.lit(-2.5), F.least(F.lit(2.5), c("position_llr"))), F.lit(-2.5)))
    psi = c("base") + team + position + F.log(F.lit(LISTED) / (c("population") * (1 - LISTED)))
    return told.select("listing_id", "source_id", "player_id", "sole", F.least(psi, F.lit(TOP)).alias("psi"))


def evidence(listings: DataFrame, entities: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(listing_id, source_id, player_id, psi, faint): log odds of each candidate pair before any competition.

    Candidates are all pairs that share a blocking key; ``hot_block`` says how they are found, not which. Those below FAINT
    (odds of 1 to 400, so a marginal of that at most) are not kept one by one; ``faint`` is the sum of their odds, which
    stays in the listing's balance.
    """
    c = F.col
    population = F.broadcast(entities.agg(F.countDistinct("player_id").cast("double").alias("population")))
    lasts = entities.groupBy("last").agg(F.countDistinct("player_id").alias("n_last"))
    firsts = entities.groupBy("first").agg(F.countDistinct("player_id").alias("n_first"))
    records = entities.groupBy("player_id").agg((F.count(F.lit(1)) == 1).alias("sole"))
    e = entities.join(lasts, "last", "left").join(firsts, "first", "left").join(records, "player_id", "left").crossJoin(population)
    e = e.select("record_id", "player_id", "n_last", "n_first", "population", F.coalesce("sole", F.lit(False)).alias("sole"), *[c(k).alias(f"e_{k}") for k in ("first", "last", "main", "dates", "college", "position", "team", "jersey", "rookie")])
    l = listings.drop("keys")
    clear = stage(_plain_pairs(listings, entities), "match-plain")
    dialects = _dialect(clear, "team", "e_team", "team"), _dialect(clear, "position", "e_position", "position")
    hot = _hot_keys(listings, entities, hot_block)
    rows = _scored(_narrow(listings, entities, hot).join(l, "listing_id").join(e, "record_id"), *dialects)
    if hot is not None:
        rows = rows.unionByName(_scored(_rest(listings, entities, l, e, hot), *dialects))
    # a player can have several records; the best one speaks. The faint ones of players with one record are summed at once
    weak = c("sole") & (c("psi") <= FAINT)
    best = rows.groupBy("listing_id", "source_id", weak.alias("weak"), F.when(~weak, c("player_id")).alias("player_id")).agg(F.max("psi").alias("psi"), F.sum(F.exp("psi")).alias("odds"))
    faint = F.coalesce(F.sum(F.when(c("weak"), c("odds")).when(c("psi") <= FAINT, F.exp("psi"))).over(Window.partitionBy("listing_id")), F.lit(0.0))
    return best.withColumn("faint", faint).where(~c("weak") & (c("psi") > FAINT)).select("listing_id", "source_id", "player_id", "psi", "faint")


def propagate(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(listing_id, player_id, probability): the marginals of all candidate pairs after loopy belief propagation.

    ``pairs``: log odds psi and, if there is one, ``faint``, the odds of a listing's candidates that are not among them.
    Goes on until no marginal moves by TOLERANCE; a graph that has not settled after ``rounds`` rounds gives a warning.
    """
    c = F.col
    by_listing, by_entity = Window.partitionBy("listing_id"), Window.partitionBy("player_id", "source_id")
    faint = c("faint") if "faint" in pairs.columns else F.lit(0.0)
    state = pairs.select("listing_id", "source_id", "player_id", F.exp("psi").alias("psi"), faint.alias("faint"), F.lit(1.0).alias("nu"), F.lit(0.0).alias("p"))
    alone = (F.count(F.lit(1)).over(by_listing) == 1) & (F.count(F.lit(1)).over(by_entity) == 1)
    state = stage(state.withColumn("alone", alone), "match-state")
    # a pair without rivals on either side hears nothing: its marginal is its own odds
    settled = state.where("alone").select("listing_id", "player_id", (c("psi") / (1 + c("faint") + c("psi"))).alias("probability"))
    state = state.where("not alone").drop("alone")
    for _ in range(rounds):
        # a listing tells an entity how much it wants it, given what its other candidates offer
        wants = state.withColumn("all", 1 + c("faint") + F.sum(c("psi") * c("nu")).over(by_listing))
        mu = c("psi") / F.greatest(F.lit(1.0), c("all") - c("psi") * c("nu"))
        mu = wants.withColumn("p_", c("psi") * c("nu") / c("all")).withColumn("took", F.log1p(mu * REPEAT_PRICE))
        # an entity tells a listing of a source how free it is, given that source's other listings
        told = mu.withColumn("taken", F.sum("took").over(by_entity))
        a = F.exp(F.least(F.lit(200.0), F.greatest(F.lit(0.0), c("taken") - c("took"))))
        nu = c("nu") * DAMPING + (a / (1 + (a - 1) / REPEAT_PRICE)) * (1 - DAMPING)
        moved = stage(told.select("listing_id", "source_id", "player_id", "psi", "faint", nu.alias("nu"), c("p_").alias("p"), F.abs(c("p_") - c("p")).alias("change")), "match-state")
        change = moved.agg(F.max("change")).first()[0]
        state = moved.drop("change")
        if change is None or change < TOLERANCE:
            break
    else:
        warnings.warn(f"the marginals still move by {change:.3g} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return settled.unionByName(state.select("listing_id", "player_id", (c("psi") * c("nu") / (1 + c("faint") + F.sum(c("psi") * c("nu")).over(by_listing))).alias("probability")))


def match(listings: DataFrame, entities: DataFrame, accept: float = 0.6) -> DataFrame:
    """(listing_id, player_id, probability): every listing once, with the likeliest entity or null.

    ``listings``: prepared with listing_id and source_id; ``entities``: prepared with record_id and player_id. A listing
    without candidates, or whose best marginal is below ``accept``, has no entity; the probability is then that of none.
    Null and empty attributes say nothing for or against. Ties of equal probability go to the smaller player_id.
    """
    marginals = propagate(evidence(listings, entities))
    best = marginals.groupBy("listing_id").agg(F.min_by("player_id", F.struct(-F.col("probability"), "player_id")).alias("who"), F.max("probability").alias("most"), F.sum("probability").alias("some"))
    sure = F.col("most") >= accept
    found = best.select("listing_id", F.when(sure, F.col("who")).alias("player_id"), F.when(sure, F.col("most")).otherwise(1 - F.col("some")).alias("probability"))
    return listings.select("listing_id").join(found, "listing_id", "left").select("listing_id", "player_id", F.coalesce("probability", F.lit(1.0)).alias("probability"))
