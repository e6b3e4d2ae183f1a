"""Schemas that drift between files: one consistent table, and a report of every change.

Raw lines are parsed by their own file's header (or as JSON) into (path, value) cells. Two schema graphs are matched. In
the graph of the files a name has words, parent words (nesting), kinds of values and *successors* (the names that appeared
where it vanished from one file of a feed to the next); in the graph of the target a field has words and a kind. Every
pair of vertices of the same sort is a vertex of the pairwise connectivity graph, and pairs that are linked in both graphs
are its edges: a pair of names is believed as far as its words, kinds and successors are, and a pair of words as far as
the names that hold it. Scores are flooded over that graph until they stop moving. Files then take a stable one-to-one
choice of correspondences (the second choice where the first is taken), values are cast to the field's type, and the
files are united.

All flooding runs as joins over name-level tables; nothing but parsed lines has the size of the data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.session import stage

DELIMITERS = ",;\t|"
ACCEPT, SECOND = 0.36, 0.85
FLOOD, ROUNDS, TOLERANCE = 0.5, 200, 1e-3
SPELLING = 5.0
# how much of what flows into a pair of names comes from its words, its parents' words and its kinds
WORDS, PARENTS, KINDS = 0.2, 0.05, 0.1
WHOLE = ("tinyint", "smallint", "int", "bigint")
BREAK = "\x1f"


def name_tokens(name: str) -> list[str]:
    """camelCase, snake_case, blanks and nesting dots all separate the words of a name."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return [t for t in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if t]


def word_likeness(a: str, b: str) -> float:
    """How alike two words look, 0 to 1: equal, a beginning, an abbreviation, or most of their letter pairs."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short):
        return 0.85
    if len(short) >= 2 and short[0] == long[0] and len(long) >= 4 and len(short) >= 0.45 * len(long):
        rest = iter(long)
        if all(ch in rest for ch in short):
            return 0.8
    grams = [{w[i : i + 2] for i in range(len(w) - 1)} for w in (a, b)]
    if not grams[0] or not grams[1]:
        return 0.0
    dice = 2 * len(grams[0] & grams[1]) / (len(grams[0]) + len(grams[1]))
    return dice if dice >= 0.6 else 0.0


def word_weights(fields: list[str]) -> dict[str, float]:
    """A word that many fields of the schema share says little: 1 for one field, less for more."""
    held: dict[str, int] = {}
    for f in fields:
        for w in set(name_tokens(f)):
            held[w] = held.get(w, 0) + 1
    return {w: 1.0 / n for w, n in held.items()}


def name_likeness(a: str, b: str, weights: dict[str, float] | None = None) -> float:
    """How alike two field names are, 0 to 1: soft matching of their words, also through glued initials."""
    if a == b:
        return 1.0
    ta, tb = name_tokens(a), name_tokens(b)
    if not ta or not tb:
        return 0.0
    if "".join(ta) == "".join(tb):
        return 0.99
    known = weights or {}

    def soft(xs: list[str], ys: list[str]) -> float:
        weight = [known.get(x, 1.0) for x in xs + ys]
        best = [max(word_likeness(x, y) for y in ys) for x in xs] + [max(word_likeness(x, y) for x in xs) for y in ys]
        return sum(w * s for w, s in zip(weight, best)) / sum(weight)

    found = soft(ta, tb)
    for xs, ys in ((ta, tb), (tb, ta)):
        if len(xs) == 1 and len(ys) > 1 and len(xs[0]) > 2:  # gid = g + id, stype = s + type
            head, tail = xs[0][0], xs[0][1:]
            if ys[0].startswith(head) and ys[1:] == [tail]:
                found = max(found, 0.9)
    return found


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import csv

    def flatten(value: object, path: str, out: list) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                flatten(v, f"{path}.{k}" if path else str(k), out)
        elif isinstance(value, list):
            out.append((path, json.dumps(value)))
        else:
            out.append((path, None if value is None else "true" if value is True else "false" if value is False else str(value)))

    def split(line: str, delimiter: str) -> list[str]:
        if '"' not in line:
            return line.split(delimiter)
        return next(csv.reader([line], delimiter=delimiter), [])

    heads: dict[str, tuple[str, list[str]]] = {}
    for batch in batches:
        rows = []
        for file_id, line_no, line, header in zip(batch["file_id"], batch["line_no"], batch["line"], batch["header"]):
            text = line.lstrip("﻿")
            if text.lstrip().startswith("{"):
                try:
                    cells: list = []
                    flatten(json.loads(text, parse_int=str, parse_float=str), "", cells)
                    rows.append((file_id, line_no, [{"path": p, "value": v} for p, v in cells], None))
                except ValueError:
                    rows.append((file_id, line_no, None, line))
                continue
            if header is None:
                continue
            if header not in heads:
                if len(heads) > 10_000:
                    heads.clear()
                clean = header.lstrip("﻿")
                delimiter = max(DELIMITERS, key=clean.count)
                heads[header] = (delimiter, [n.strip().strip('"').strip() for n in split(clean, delimiter)])
            delimiter, names = heads[header]
            if line == header or text == header.lstrip("﻿"):
                continue
            values = split(text, delimiter)
            rows.append((file_id, line_no, [{"path": n, "value": v.strip()} for n, v in zip(names, values) if n], delimiter.join(values[len(names) :]) or None))
        yield pd.DataFrame(rows, columns=["file_id", "line_no", "cells", "rest"])


def parse_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, line_no, cells, rest): every data line of the files, each read by the header of its own file.

    Blank and comment lines and repeated headers are no data; short lines have fewer cells; cells beyond the header and
    lines that cannot be read come out in ``rest``.
    """
    body = lines.select("file_id", "line_no", "line").where(F.col("line").isNotNull() & (F.trim(F.regexp_replace("line", "^﻿", "")) != "") & ~F.regexp_replace("line", "^﻿", "").startswith("#"))
    header = body.groupBy("file_id").agg(F.min_by("line", "line_no").alias("header"))
    read = body.join(header, "file_id").join(files.select("file_id").distinct(), "file_id", "left_semi")
    return read.mapInPandas(_parse, "file_id long, line_no int, cells array<struct<path:string,value:string>>, rest string")


def value_kind(value: Column) -> Column:
    """whole, decimal, true/false or text; null for empty cells, NA and null."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | F.lower(v).isin("", "na", "null"), None)
        .when(F.lower(v).isin("true", "false"), "true/false")
        .when(v.rlike(r"^[+-]?\d+$"), "whole")
        .when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$") | v.rlike(r"^[+-]?\d+[eE][+-]?\d+$") | F.lower(v).isin("nan", "inf", "-inf"), "decimal")
        .otherwise("text")
    )


def _shape(value: Column, kind: Column) -> Column:
    """What a value looks like: short words as they are, numbers by kind and size, other text by its letter pattern."""
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "A"), r"\d+", "9"), r"\s+", " ")
    size = F.length(F.regexp_replace(value, r"\.\d*$", "")).cast("string")
    return F.when(kind.isin("whole", "decimal"), F.concat(kind, F.lit(":"), size)).when((F.length(value) <= 4) & value.rlike(r"^\p{L}+$"), F.upper(value)).otherwise(pattern)


def profile(parsed: DataFrame) -> DataFrame:
    """(file_id, name, shape, kind, n): what the columns of each file hold. Null cells count under a null kind."""
    cells = parsed.select("file_id", F.explode("cells").alias("c")).select("file_id", F.col("c.path").alias("name"), F.col("c.value").alias("value"))
    kind = value_kind(F.col("value"))
    return cells.groupBy("file_id", "name", F.when(kind.isNotNull(), _shape(F.trim("value"), kind)).alias("shape"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _overlap(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Bhattacharyya overlap of the value shapes of the names a and b of each pair."""
    sa = shapes.select(F.col("name").alias("a"), "shape", F.col("share").alias("pa"))
    sb = shapes.select(F.col("name").alias("b"), "shape", F.col("share").alias("pb"))
    return pairs.join(sa, "a").join(sb, ["b", "shape"]).groupBy("a", "b").agg(F.sum(F.sqrt(F.col("pa") * F.col("pb"))).alias("overlap"))


def flood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, s): the scores of the nodes (node, s0) of a connectivity graph once nothing moves by TOLERANCE any more.

    ``edges``: (src, dst, w); the weights into a node add up to one at most. A node's score is FLOOD parts of what its
    links believe and, for the rest, its own evidence, so that a round at least halves what is still to move.
    """
    trust = nodes.join(edges.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("others")), "node", "left")
    trust = stage(trust.select("node", "s0", (F.col("s0") * (1 - FLOOD * F.coalesce("others", F.lit(0.0)))).alias("own")), "drift-trust")
    settled = score = trust.select("node", F.col("s0").alias("s"))
    own = trust.select("node", F.col("own").alias("s"))
    for i in range(ROUNDS):
        believed = edges.join(score.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("w") * F.col("s") * FLOOD).alias("s"))
        score = own.unionByName(believed).groupBy("node").agg(F.sum("s").alias("s"))
        if i % 4 == 3:
            score = stage(score, "drift-score")
            change = score.join(settled.withColumnRenamed("s", "before"), "node").agg(F.max(F.abs(F.col("s") - F.col("before")))).first()[0]
            settled = score
            if (change or 0.0) < TOLERANCE:
                return score
    raise RuntimeError(f"scores have not settled after {ROUNDS} rounds of flooding")


def _start(pairs: DataFrame, names: DataFrame, held: DataFrame, shapes: DataFrame, fields: list[str]) -> DataFrame:
    """(name, field, s0): how alike name and values are, before any flooding."""
    weights = word_weights(fields)

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known.setdefault((x, y), name_likeness(x, y, weights)) if (x, y) not in known else known[x, y] for x, y in zip(a, b)], dtype=float)

    value = _overlap(pairs.select(F.col("name").alias("a"), F.col("field").alias("b")), shapes).select(F.col("a").alias("name"), F.col("b").alias("field"), "overlap")
    anchored = shapes.select(F.col("name").alias("field")).distinct().withColumn("anchored", F.lit(True))
    # a name seen beside the field itself in one file is another thing
    beside = held.alias("x").join(held.where(F.col("name").isin(fields)).alias("y"), "file_id").where("x.name <> y.name").groupBy(F.col("x.name").alias("name"), F.col("y.name").alias("field")).agg(F.count(F.lit(1)).alias("beside"))
    known = pairs.withColumn("alike", likeness("name", "field")).join(value, ["name", "field"], "left").join(anchored, "field", "left").join(beside, ["name", "field"], "left").join(names, "name")
    first = F.when(F.col("anchored"), F.col("alike") * 0.6 + F.coalesce("overlap", F.lit(0.0)) * 0.4).otherwise(F.col("alike") * 0.9)
    first = F.when(F.col("name") == F.col("field"), 1.0).otherwise(first * (1 - F.least(F.lit(1.0), F.coalesce("beside", F.lit(0)) / F.col("files"))))
    return known.select("name", "field", first.cast("double").alias("s0"))


def _successors(held: DataFrame, names: DataFrame, shapes: DataFrame) -> DataFrame:
    """(name, other, w): where a name went from one file of a feed to the next, a new one of like values came; and
    spellings of one name (game.type, game_type, gameType). The weights into a name stay below one."""
    came = held.join(held.select("feed_id", (F.col("pos") + 1).alias("pos"), "name", F.lit(1).alias("was")), ["feed_id", "pos", "name"], "left").where("was is null and pos > 1").select("feed_id", "pos", F.col("name").alias("new"))
    went = held.join(held.select("feed_id", (F.col("pos") - 1).alias("pos"), "name", F.lit(1).alias("stays")), ["feed_id", "pos", "name"], "left").where("stays is null").select("feed_id", (F.col("pos") + 1).alias("pos"), F.col("name").alias("old"))
    moved = came.join(went, ["feed_id", "pos"]).groupBy("new", "old").agg(F.count(F.lit(1)).alias("n"))
    like = _overlap(moved.select(F.col("new").alias("a"), F.col("old").alias("b")), shapes).select(F.col("a").alias("new"), F.col("b").alias("old"), "overlap")
    # names that stand beside each other in files are no renames of each other
    together = held.alias("x").join(held.alias("y"), "file_id").join(moved.select("new", "old"), (F.col("x.name") == F.col("new")) & (F.col("y.name") == F.col("old"))).groupBy("new", "old").agg(F.count(F.lit(1)).alias("together"))
    apart = F.greatest(F.lit(0.0), 1 - F.coalesce("together", F.lit(0)) / F.least(F.col("fn"), F.col("fo")))
    linked = moved.join(like, ["new", "old"]).join(together, ["new", "old"], "left").join(names.select(F.col("name").alias("new"), F.col("files").alias("fn")), "new").join(names.select(F.col("name").alias("old"), F.col("files").alias("fo")), "old")
    links = linked.select("new", "old", (F.col("n") * F.col("overlap") * F.col("overlap") * F.pow(apart, 4)).alias("w"))
    edges = links.select(F.col("new").alias("name"), F.col("old").alias("other"), "w").unionByName(links.select(F.col("old").alias("name"), F.col("new").alias("other"), "w"))
    spelled = names.select("name", F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", "")).alias("key"))
    spelled = spelled.join(spelled.withColumnRenamed("name", "other"), "key").where("name <> other").select("name", "other", F.lit(SPELLING).alias("w"))
    edges = edges.unionByName(spelled).groupBy("name", "other").agg(F.sum("w").alias("w"))
    # a name keeps one unit of trust in itself, so that a single weak link moves it little
    return edges.withColumn("w", F.col("w") / (1 + F.sum("w").over(Window.partitionBy("name"))))


def connectivity(profiled: DataFrame, start: DataFrame, successors: DataFrame, schema: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, s0) and edges (src, dst, w) of the pairwise connectivity graph of the names met and the schema.

    Nodes are pairs of a name and a field, of words, of parent words and a field's words, and of kinds. What flows into a
    pair of names from one sort of node is shared by how likely its parts are; what flows into another pair comes from
    the names that hold it, the likelier ones first.
    """
    spark = profiled.sparkSession
    weights = word_weights([f for f, _ in schema])

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_likeness(x, y) for x, y in zip(a, b)], dtype=float)

    @F.pandas_udf("array<struct<sort:string,part:string,w:double>>")
    def parts(names: pd.Series) -> pd.Series:
        out = []
        for name in names:
            parent, _, own = name.rpartition(".")
            out.append([{"sort": "w", "part": t, "w": weights.get(t, 1.0)} for t in dict.fromkeys(name_tokens(own))] + [{"sort": "p", "part": t, "w": weights.get(t, 1.0)} for t in dict.fromkeys(name_tokens(parent))])
        return pd.Series(out)

    kinds = profiled.where("kind is not null").groupBy("name", F.col("kind").alias("part")).agg(F.sum("n").cast("double").alias("w")).select("name", F.lit("k").alias("sort"), "part", "w")
    vertices = start.select("name").distinct().select("name", F.explode(parts("name")).alias("p")).select("name", "p.sort", "p.part", "p.w").unionByName(kinds)
    of = [(f, s, t, weights[t]) for f, _ in schema for t in dict.fromkeys(name_tokens(f)) for s in ("w", "p")]
    of += [(f, "k", "whole" if kind in WHOLE else "decimal" if kind in ("double", "float") else "true/false" if kind == "boolean" else "text", 1.0) for f, kind in schema]
    # the schema's vertices: as many as its words
    target = F.broadcast(spark.createDataFrame(of, "field string, sort string, other string, wf double"))
    pairs = vertices.join(target, "sort").join(start, ["name", "field"])
    same = F.when(F.col("part") == F.col("other"), 1.0).when(F.col("part").isin("whole", "decimal") & F.col("other").isin("whole", "decimal"), 0.7).otherwise(0.0)
    pairs = pairs.withColumn("alike", F.when(F.col("sort") == "k", same).otherwise(likeness("part", "other")))
    pair = F.concat(F.lit("n"), F.lit(BREAK), "name", F.lit(BREAK), "field")
    part = F.concat("sort", F.lit(BREAK), "part", F.lit(BREAK), "other")
    share = F.create_map(*[x for k, v in (("w", WORDS), ("p", PARENTS), ("k", KINDS)) for x in (F.lit(k), F.lit(v))])
    near = F.col("w") * F.col("wf") * (F.col("alike") + 0.05)
    pairs = stage(pairs.select(pair.alias("pair"), part.alias("part"), "sort", "alike", near.alias("near"), (F.col("s0") * F.col("s0") + 1e-6).alias("sure")), "drift-parts")
    inward = pairs.select(F.col("part").alias("src"), F.col("pair").alias("dst"), (share[F.col("sort")] * F.col("near") / F.sum("near").over(Window.partitionBy("pair", "sort"))).alias("w"))
    outward = pairs.select(F.col("pair").alias("src"), F.col("part").alias("dst"), (F.col("sure") / F.sum("sure").over(Window.partitionBy("part"))).alias("w"))
    left = 1.0 - WORDS - PARENTS - KINDS
    old = F.concat(F.lit("n"), F.lit(BREAK), "other", F.lit(BREAK), "field")
    across = successors.join(start, "name").select(old.alias("src"), pair.alias("dst"), (F.col("w") * left).alias("w"))
    nodes = start.select(pair.alias("node"), "s0").unionByName(pairs.groupBy(F.col("part").alias("node")).agg(F.max("alike").alias("s0")))
    return nodes, stage(inward.unionByName(outward).unionByName(across), "drift-edges")


def correspondences(files: DataFrame, profiled: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """(name, field, score) of every correspondence of a name met in the files with a field (name, type) of the schema
    that is likely enough: at least ACCEPT, and SECOND of the name's best.

    ``profiled``: see ``profile``. Empty input: no rows.
    """
    spark = profiled.sparkSession
    fields = [f for f, _ in schema]
    counted = profiled.where("kind is not null").groupBy("name", "shape").agg(F.sum("n").alias("n"))
    shapes = stage(counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("name"))).select("name", "shape", "share"), "drift-shapes")
    held = stage(profiled.select("file_id", "name").distinct().join(files.select("file_id", "feed_id", "pos"), "file_id"), "drift-held")
    names = held.groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    # the fields are a schema, of a size known here, so every name meets each of them once
    pairs = names.select("name").crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in fields], "field string")))
    start = stage(_start(pairs, names, held, shapes, fields), "drift-start")
    score = flood(*connectivity(profiled, start, _successors(held, names, shapes), schema))
    parts = F.split("node", BREAK)
    found = score.where(F.col("node").startswith(f"n{BREAK}")).select(parts[1].alias("name"), parts[2].alias("field"), "s")
    best = F.max("s").over(Window.partitionBy("name"))
    return found.withColumn("best", best).where((F.col("s") >= ACCEPT) & (F.col("s") >= SECOND * F.col("best"))).select("name", "field", F.col("s").alias("score"))


def ordered_files(files: DataFrame) -> DataFrame:
    """The files with their place (pos, from 1) in their feed."""
    return files.withColumn("pos", F.row_number().over(Window.partitionBy("feed_id").orderBy("file_seq", "file_id")))


def assigned(files: DataFrame, profiled: DataFrame, matches: DataFrame) -> DataFrame:
    """(file_id, name, field, kind): one field per column of a file, no field twice; unmatched columns keep their name."""
    n = F.col("n")
    cols = profiled.groupBy("file_id", "name").agg(*[F.sum(F.when(F.col("kind") == k, n).otherwise(0)).alias(k) for k in ("whole", "decimal", "true/false", "text")])
    number = F.col("whole") + F.col("decimal")
    best = F.greatest(number, F.col("true/false"), F.col("text"))
    kind = F.when(best == 0, None).when(F.col("text") == best, "text").when(number == best, F.when(F.col("decimal") > 0, "decimal").otherwise("whole")).otherwise("true/false")
    offers = matches.groupBy("name").agg(F.collect_list(F.struct("field", "score")).alias("offers"))
    joined = cols.select("file_id", "name", kind.alias("kind")).join(offers, "name", "left")
    per_file = joined.groupBy("file_id").agg(F.collect_list(F.struct("name", "kind", "offers")).alias("columns"))
    return per_file.mapInPandas(_stable, "file_id long, name string, field string, kind string")


def _stable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file's columns and fields, likeliest pair first: no column and field left apart would both rather have each other."""
    for batch in batches:
        rows = []
        for file_id, columns in zip(batch["file_id"], batch["columns"]):
            chosen: dict[str, str] = {}
            taken: set[str] = set()
            for score, name, field in sorted(((o["score"], c["name"], o["field"]) for c in columns if c["offers"] is not None for o in c["offers"]), key=lambda x: (-x[0], x[1], x[2])):
                if name not in chosen and field not in taken:
                    chosen[name] = field
                    taken.add(field)
            rows += [(file_id, c["name"], chosen.get(c["name"], c["name"]), c["kind"]) for c in columns]
        yield pd.DataFrame(rows, columns=["file_id", "name", "field", "kind"])


def changes(files: DataFrame, columns: DataFrame) -> DataFrame:
    """(file_id, field, change, before, after) of each file against the one before it in its feed.

    ``files``: with pos. The first file of a feed has no change; retyped looks back to the last earlier file whose
    column had a kind.
    """
    c = columns.join(files.select("file_id", "feed_id", "pos"), "file_id")
    now = c.select("feed_id", "pos", "field", F.col("name").alias("now"))
    old = c.select("feed_id", (F.col("pos") + 1).alias("pos"), "field", F.col("name").alias("old"))
    both = now.join(old, ["feed_id", "pos", "field"], "full").join(files.where("pos > 1").select("feed_id", "pos", "file_id"), ["feed_id", "pos"])
    what = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("old") != F.col("now"), "renamed")
    moved = both.select("file_id", "field", what.alias("change"), F.col("old").alias("before"), F.col("now").alias("after")).where("change is not null")
    past = F.lag("kind").over(Window.partitionBy("feed_id", "field").orderBy("pos"))
    typed = c.where("kind is not null").withColumn("past", past).where("past is not null and past <> kind")
    return moved.unionByName(typed.select("file_id", "field", F.lit("retyped").alias("change"), F.col("past").alias("before"), F.col("kind").alias("after")))


# fixed values: how the feeds write a season type
SEASON_TYPES = {"true": "REG", "1": "REG", "reg": "REG", "false": "POST", "2": "POST", "post": "POST"}


def cast_value(text: Column, kind: str) -> Column:
    """A cell as the field's type: marks around a number ("W16", "3 car.", "4.0") do not hide it; what has none is null."""
    none = F.lower(F.trim(text)).isin("", "na", "null", "nan")
    number = F.regexp_extract(text, r"([+-]?\d+(?:\.\d+)?)", 1)
    if kind in ("int", "bigint", "double", "float"):
        return F.when(~none & (number != ""), number.cast("double").cast(kind))
    if kind.startswith("timestamp"):
        return F.when(~none, F.try_to_timestamp(text).cast(kind))
    return F.when(~none, F.trim(text))


def unify(parsed: DataFrame, columns: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """Every data line as one row of ``schema`` (name, type) plus ``extra``, the cells of other fields by name.

    A line that cannot be read has no fields and stands in ``beyond_header`` as it is.
    """
    place = columns.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "field"))).alias("fields"))
    row = parsed.join(place, "file_id", "left")
    named = F.transform("cells", lambda c: F.struct(F.coalesce(F.try_element_at("fields", c["path"]), c["path"]).alias("k"), c["value"].alias("v")))
    row = row.select("file_id", "line_no", named.alias("cells"), "rest")

    def pick(f: str) -> Column:
        return F.try_element_at(F.filter("cells", lambda c: c["k"] == f), F.lit(1))["v"]

    out = []
    for f, kind in schema:
        value = pick(f)
        if f == "season_type":
            known = F.create_map(*[F.lit(x) for kv in SEASON_TYPES.items() for x in kv])
            value = F.coalesce(F.try_element_at(known, F.lower(F.trim(value))), value)
        out.append(cast_value(value, kind).alias(f))
    others = F.filter("cells", lambda c: ~c["k"].isin([f for f, _ in schema]))
    distinct = F.array_distinct(F.transform(others, lambda c: c["k"]))
    extra = F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.try_element_at(F.filter("cells", lambda c: c["k"] == k), F.lit(1))["v"]))
    return row.select("file_id", "line_no", *out, extra.alias("extra"), F.col("rest").alias("beyond_header"))
