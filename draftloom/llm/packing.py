"""Filling fixed-capacity containers: best fit over counts of lengths, then documents take planned slots by rank.

Documents are measured once in tokens of a public tokenizer. The plan sees only the histogram of lengths: best fit in
decreasing order, where a whole run of equal containers is filled with a whole run of equal items at a time, so the
plan's size depends on the capacity, not on the number of documents. A document then finds its slot from its rank among
the documents of its length: ranks are counted per (length, salt) and shifted by the counts of earlier salts, so a length
that a third of all documents share is ranked by many tasks. A text longer than the capacity fills containers of its own
and its rest is an item like any other; no other text is cut.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftloom.session import spread, stage

# where every worker finds the vocabulary file: this setting of the session, or the default
TOKENIZER_CONF, TOKENIZER = "draftloom.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern published with this byte-level vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n): the length of every text in tokens. A null text has length 0.

    ``tokenizer``: path of the vocabulary file on the workers; unless given, the session's setting TOKENIZER_CONF. A
    worker that lacks the file fails and names it.
    """
    tokenizer = tokenizer or docs.sparkSession.conf.get(TOKENIZER_CONF, TOKENIZER)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import os

        import tiktoken

        if not os.path.exists(tokenizer):
            raise FileNotFoundError(f"no vocabulary file {tokenizer} on this worker; set draftloom.tokenizer to its path")

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["doc_id", "n"])

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, f"doc_id {kind}, n int")


def plan(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit decreasing over (length, count) with 0 < length <= capacity.

    Returns slots (length, per container, first container, containers), in the order in which items of a length take
    them, and the number of containers.
    """
    spaces: list[int] = []  # the distinct spaces left, sorted
    runs: dict[int, list[list[int]]] = {}  # space -> runs of equal containers [first, count]
    slots: list[tuple[int, int, int, int]] = []
    opened = 0

    def add(space: int, first: int, count: int) -> None:
        if space <= 0 or count <= 0:
            return
        if space not in runs:
            bisect.insort(spaces, space)
            runs[space] = []
        runs[space].append([first, count])

    for length, left in sorted(histogram, reverse=True):
        while left > 0:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    spaces.pop(at)
            else:
                space, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = space // length
            whole = min(count, left // each)
            if whole:
                slots.append((length, each, first, whole))
                add(space - each * length, first, whole)
                left -= whole * each
            if whole < count:
                rest = left if left < each else 0
                if rest:
                    slots.append((length, rest, first + whole, 1))
                    add(space - rest * length, first + whole, 1)
                    left = 0
                add(space, first + whole + (rest > 0), count - whole - (rest > 0))
    return slots, opened


class Planned:
    """The plan of one capacity as arrays: where the items of a length start, and which containers they get."""

    def __init__(self, lengths: list[tuple[int, int]], capacity: int) -> None:
        items: dict[int, int] = {}
        self.shift: dict[int, int] = {}  # token length -> rank of its first document among the items of its item length
        self.own: dict[int, int] = {}  # token length -> containers that longer texts before it fill alone
        alone = 0
        for n, count in sorted(lengths):
            if n <= 0:
                continue
            pieces, rest = (0, n) if n <= capacity else divmod(n, capacity)
            self.own[n] = alone
            alone += pieces * count
            if rest:
                self.shift[n] = items.get(rest, 0)
                items[rest] = items.get(rest, 0) + count
        slots, self.planned = plan(list(items.items()), capacity)
        self.capacity, self.alone = capacity, alone
        begun: dict[int, int] = {}
        rows = []
        for length, each, first, count in slots:
            start = begun.get(length, 0)
            rows.append((length, start, each, first))
            begun[length] = start + each * count
        rows.sort()
        self.key = np.array([(length << 40) + start for length, start, _, _ in rows], dtype=np.int64)
        self.start, self.each, self.first = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))

    @property
    def containers(self) -> int:
        return self.planned + self.alone

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The containers of the items with these lengths and ranks among them."""
        at = np.searchsorted(self.key, (lengths << 40) + ranks, side="right") - 1
        return self.first[at] + (ranks - self.start[at]) // self.each[at]


def ranked(counts: DataFrame) -> DataFrame:
    """(doc_id, n, rank): the rank of each document among those of its length, from 0, without one task per length."""
    salts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("n", "salt").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("n", "salt", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("n", "salt").orderBy("doc_id", "copy")) - 1
    return salted.withColumn("inner", inner).join(offsets, ["n", "salt"]).select("doc_id", "n", (F.col("inner") + F.col("before")).alias("rank"))


def pack(docs: DataFrame, targets: list[tuple[int, int]], tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(target_id, container_no, doc_id, piece_no, start_token, n_tokens) for every document and target.

    ``targets``: (target_id, capacity) pairs, capacity >= 1. A text longer than the capacity comes out in pieces. Empty
    and null texts take no space and are spread over the containers (container 0 where there is none). Repeated ids
    are packed each on its own; an empty table gives no rows.
    """
    if any(capacity is None or capacity < 1 for _, capacity in targets):
        raise ValueError("a capacity is at least 1 token")
    measured = token_counts(docs, tokenizer, id_col, text_col).withColumn("copy", F.monotonically_increasing_id())
    measured = stage(measured, "token-counts")
    # one row per distinct length: bounded by the longest text, not by the number of texts
    lengths = [(r["n"], r["c"]) for r in measured.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()]
    plans = [(target, Planned(lengths, capacity)) for target, capacity in targets]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            for target, p in plans:
                cap = p.capacity
                pieces = np.where(n > cap, n // cap, 0)
                rest = np.where(n > cap, n % cap, n)
                container = np.where(n == 0, rank % max(1, p.containers), 0)
                some = np.flatnonzero(rest > 0)
                if len(some):
                    shift = np.array([p.shift[x] for x in n[some].tolist()], dtype=np.int64)
                    container[some] = p.place(rest[some], rank[some] + shift)
                last = np.flatnonzero((rest > 0) | (n == 0))
                long = np.flatnonzero(pieces > 0)
                own = np.array([p.own[x] for x in n[long].tolist()], dtype=np.int64)
                at = np.repeat(long, pieces[long])
                no = np.concatenate([np.arange(k) for k in pieces[long]]) if len(long) else np.zeros(0, dtype=np.int64)
                whole = p.planned + np.repeat(own + rank[long] * pieces[long], pieces[long]) + no
                who = np.concatenate([last, at])
                out = [np.full(len(who), target), np.concatenate([container[last], whole]), None, np.concatenate([pieces[last], no]), np.concatenate([pieces[last] * cap, no * cap]), np.concatenate([rest[last], np.full(len(at), cap)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), ids.take(pa.array(who)), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32())],
                    ["target_id", "container_no", "doc_id", "piece_no", "start_token", "n_tokens"],
                )

    return ranked(measured).mapInArrow(run, f"target_id int, container_no long, doc_id {kind}, piece_no int, start_token int, n_tokens int")


def fill_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: containers, tokens, the share of space used, and the fewest containers that could hold the tokens."""
    used = packed.groupBy("target_id", "container_no").agg(F.sum("n_tokens").alias("t"))
    total = used.groupBy("target_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    at_least = F.ceil(F.col("tokens") / F.col("token_capacity"))
    return total.join(targets.select("target_id", "token_capacity"), "target_id").select("target_id", "token_capacity", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("token_capacity")), 6).alias("used_share"), at_least.alias("least_containers"))
