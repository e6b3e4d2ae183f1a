"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment of words.

Texts are reduced to words that survive case, punctuation, markup, escapes, quotation and comment signs and encoding
damage. Every n-gram of an item is a seed. A pass over the corpus joins seeds with documents and counts them in bands of
diagonals (place in the document minus place in the item): a band with a seed that few items have and one more, or with
several common ones, makes a candidate. The second rule is exact: so many n-grams outlast the edits of any stretch that
counts, all within a few diagonals (``plan`` works the numbers out), so nothing that rarity leaves out is lost.

Candidates are aligned by Smith-Waterman recurrences over words: an item word scores 1, an edit costs ``one_in``, an
alignment may start afresh at any word that agrees. A leak needs a score of nought and a length of ``least`` item words, so
a stretch may not be cut where its score alone would gain by it; scores are therefore kept apart by the number of edits
(at one number of edits the best score is the longest stretch). No layer beyond ``plan``'s is needed.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftloom.session import spread, stage

GRAM, LEAST, ONE_IN = 5, 20, 8
RARE_ITEMS, RARE_HITS = 5, 2
MAX_BROADCAST_SEEDS, MAX_FORMS = 2_000_000, 1_000_000
LEAK = ["item_id", "item_word", "n_words", "edits", "doc_end"]

_TAG = re.compile(r"</?[a-zA-Z](?:[^<>]{0,300}|(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^)\s]*(?:\s+\"[^\"]*\")?\)|\b(?:https?|ftp)://[^\s<>\"')\]]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_SPACES = re.compile("[\u2010-\u2015\u2026\u2190-\u21ff\u00a0\u2000-\u200a\u2028\u2029\u202f\u3000|/]")
_LOST = re.compile(r"(?<=[a-z0-9])\?+(?=[a-z0-9])")
_WORD = re.compile("[a-z0-9\u0080-\U0010ffff]+")
_PLAIN = re.compile("[^a-z0-9]+")


def words(text: str | None) -> list[str]:
    """The words of a text, reduced to what damage and markup leave alone: the ASCII letters and digits of each word.

    A word without any is kept if it has at least two letters of a script other than Latin.
    """
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "\\" in t:
        t = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), t)
        t = re.sub(r"\\[nrt]", " ", t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "(" in t or ":" in t:
        t = _LINK.sub(" ", t)
    if not t.isascii():
        t = unicodedata.normalize("NFC", t).replace("\u00c3\u00a0", "\u00e0")
        t = _SPACES.sub(" ", t)
    t = _LOST.sub("", t.lower().replace("'", ""))
    if t.isascii():
        return re.findall("[a-z0-9]+", t)
    out = []
    for w in _WORD.findall(t):
        if w.isascii():
            out.append(w)
            continue
        a = _PLAIN.sub("", w)
        if a:
            out.append(a)
        else:
            other = "".join(ch for ch in w if ch.isalpha() and ord(ch) > 0x24F)
            if len(other) >= 2:
                out.append(other)
    return out


def spellings(text: str | None) -> dict[str, str]:
    """Unaccented and capital spellings of the text's accented words -> their reduced form."""
    out: dict[str, str] = {}
    for w in re.findall(r"\w+", unicodedata.normalize("NFC", text or "").lower()):
        if w.isascii():
            continue
        reduced = _PLAIN.sub("", w)
        for form in (w.replace("ß", "ss"), w.replace("ß", "ss").replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")):
            folded = "".join(ch for ch in unicodedata.normalize("NFKD", form) if not unicodedata.combining(ch))
            if folded.isascii() and reduced and folded != reduced:
                out[folded] = reduced
        upper = _PLAIN.sub("", w.replace("ß", "ss"))  # what lower-casing makes of capitals
        if upper != reduced and reduced:
            out[upper] = reduced
    return out


@dataclass(frozen=True)
class Plan:
    """Numbers that follow from n-grams of ``gram`` words, stretches of ``least`` words or more and one edit in ``one_in``."""

    gram: int
    least: int
    one_in: int
    layers: int
    common_hits: int
    band: int


def plan(gram: int = GRAM, least: int = LEAST, one_in: int = ONE_IN) -> Plan:
    """The edits to allow for, the n-grams any leaked stretch keeps, and how wide a band of diagonals holds them all.

    A longer stretch can be halved until it has fewer than 2 x least words, so (2 x least - 1) / one_in edits do; each
    spoils at most ``gram`` n-grams and shifts the diagonal by one. Parameters that leave no n-gram are refused.
    """
    layers = (2 * least - 1) // one_in
    kept = min(n - gram + 1 - gram * (n // one_in) for n in range(least, 2 * least))
    if kept < 1:
        raise ValueError(f"a stretch of {least} words with one edit in {one_in} may keep no run of {gram} words; use shorter ones")
    return Plan(gram, least, one_in, layers, max(1, kept - 1), max(16, 4 * layers))


def align(doc: list[str], item: list[str], least: int = LEAST, one_in: int = ONE_IN) -> tuple[int, int, int, int] | None:
    """The best stretch of ``item`` in ``doc`` as (first item word, item words, edits, end in the document), or None.

    A stretch begins and ends with words that agree. Row by row over the item, score[e, j] is the best score of an
    alignment with e edits that ends at document word j: words agree (+1, also as a fresh start), an item word is changed
    or dropped (1 - one_in), a document word is put in (-one_in).
    """
    layers = (2 * least - 1) // one_in
    code: dict[str, int] = {}
    it = np.array([code.setdefault(w, len(code)) for w in item], dtype=np.int32)
    dc = np.array([code.get(w, -1) for w in doc], dtype=np.int32)
    m, none = len(dc), -(1 << 29)
    score = np.full((layers + 1, m + 1), none, dtype=np.int32)
    best = None
    for i in range(1, len(it) + 1):
        row = np.full((layers + 1, m + 1), none, dtype=np.int32)
        same = dc == it[i - 1]
        row[:, 1:] = np.where(same, score[:, :-1] + 1, none)
        np.maximum(row[0, 1:], same, out=row[0, 1:], where=same)
        tops = row.max(axis=1).tolist()
        for e, top in enumerate(tops):
            n = top + one_in * e
            if top >= 0 and n >= least and (best is None or (top, n) > best[0]):
                best = ((top, n), (i - n, n, e, int(row[e].argmax())))
        np.maximum(row[1:], score[:-1] + (1 - one_in), out=row[1:])
        np.maximum(row[1:, 1:], score[:-1, :-1] + (1 - one_in), out=row[1:, 1:])
        for e in range(1, layers + 1):
            np.maximum(row[e, 1:], row[e - 1, :-1] - one_in, out=row[e, 1:])
        score = row
    return best[1] if best else None


def seeds_of(items: DataFrame, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(seed, item_id, place, rare) of all items, and (item_id, words, forms): both as large as the items' texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "words": [words(t) for t in batch["text"]], "forms": [[{"form": k, "word": v} for k, v in spellings(t).items()] for t in batch["text"]]})

    prepared = stage(items.select("item_id", "text").mapInPandas(run, "item_id long, words array<string>, forms array<struct<form:string,word:string>>"), "leak-items")
    at = F.when(F.size("words") >= gram, F.sequence(F.lit(1), F.size("words") - gram + 1)).otherwise(F.array().cast("array<int>"))
    seeds = prepared.select("item_id", F.explode(F.transform(at, lambda i: F.struct((i - 1).alias("place"), F.concat_ws(" ", F.slice("words", i, gram)).alias("seed")))).alias("s")).select("s.seed", "item_id", "s.place")
    rare = seeds.groupBy("seed").agg((F.countDistinct("item_id") <= RARE_ITEMS).alias("rare"))
    return stage(seeds.distinct().join(rare, "seed"), "leak-seeds"), prepared


def dense(doc: list[str], item: list[str], diagonal: int, p: Plan) -> bool:
    """Whether a stretch of ``item`` can lie in the band of diagonals that starts at ``diagonal``: an exact bound.

    Of any ``least`` words in a row of a leaked stretch all but its edits stand in the document near their diagonal.
    """
    run = 0
    here: list[bool] = []
    for place, word in enumerate(item):
        start = place + diagonal - p.layers
        found = word in doc[max(0, start) : max(0, start + p.band + 2 * p.layers)]
        here.append(found)
        run += found - (place >= p.least and here[place - p.least])
        if place >= p.least - 1 and run >= p.least - p.layers:
            return True
    return False


def _reduced(batch: pd.DataFrame, forms: dict[str, str] | None) -> Iterator[list[str]]:
    """The words of each text, spellings put right by ``forms`` or, where there are too many, by the row's own."""
    own = batch["own_forms"] if forms is None else [None] * len(batch)
    for text, mine in zip(batch["text"], own):
        known = forms if forms is not None else {f["form"]: f["word"] for f in mine} if mine is not None else {}
        yield [known.get(w, w) for w in words(text)] if known else words(text)


def _bands(seeds: dict[tuple[str, ...], list[tuple[int, int, bool]]], texts: dict[int, list[str]], forms: dict[str, str] | None, p: Plan):
    """Documents -> leaks, by postings and item texts the task holds: found and aligned where the text is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, ws in zip(batch["doc_id"], _reduced(batch, forms)):
                bands: dict[tuple[int, int], list[int]] = {}
                for i, words_here in enumerate(zip(*[ws[k:] for k in range(p.gram)])):
                    for item, place, rare in seeds.get(words_here, ()):
                        diagonal = (i - place) // (p.band // 2)
                        for key in ((item, diagonal), (item, diagonal - 1)):
                            band = bands.setdefault(key, [0, 0, i, i])
                            band[0] += 1
                            band[1] += rare
                            band[3] = i
                near: dict[int, list[list[int]]] = {}
                for (item, diagonal), (n, rare, low, high) in sorted(bands.items(), key=lambda x: x[1][2]):
                    if (n >= p.common_hits or (rare and n >= RARE_HITS)) and dense(ws, texts[item], diagonal * (p.band // 2), p):
                        spots = near.setdefault(item, [])
                        if spots and low <= spots[-1][1] + len(texts[item]):
                            spots[-1][1] = max(spots[-1][1], high)
                        else:
                            spots.append([low, high])
                rows += [(doc_id, *x) for item, spots in near.items() for low, high in spots if (x := _leak(ws, texts[item], item, low, high, p))]
            yield pd.DataFrame(rows, columns=["doc_id", *LEAK])

    return run


def _all_grams(forms: dict[str, str] | None, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, ws in zip(batch["doc_id"], _reduced(batch, forms)):
                if len(ws) >= gram:
                    yield pd.DataFrame({"doc_id": doc_id, "at": range(len(ws) - gram + 1), "seed": [" ".join(ws[i : i + gram]) for i in range(len(ws) - gram + 1)]})

    return run


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(d, w) for d, text in zip(batch["doc_id"], batch["text"]) for w in set(words(text))]
        yield pd.DataFrame(rows, columns=["doc_id", "form"])


def _leak(doc: list[str], item: list[str], item_id: int, low: int, high: int, p: Plan) -> tuple | None:
    """The alignment of one candidate around its seeds at ``low``..``high``."""
    reach = len(item) + len(item) // p.one_in + p.gram
    start = max(0, low - reach)
    found = align(doc[start : high + reach], item, p.least, p.one_in)
    return (item_id, *found[:3], start + found[3]) if found else None


def _aligned(forms: dict[str, str] | None, p: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, ws, item_id, item, bands in zip(batch["doc_id"], _reduced(batch, forms), batch["item_id"], batch["words"], batch["bands"]):
                it = list(item)
                spots: list[list[int]] = []
                for b in sorted(bands, key=lambda b: b["low"]):
                    if dense(ws, it, int(b["band"]) * (p.band // 2), p):
                        if spots and b["low"] <= spots[-1][1] + len(it):
                            spots[-1][1] = max(spots[-1][1], b["high"])
                        else:
                            spots.append([b["low"], b["high"]])
                rows += [(doc_id, *x) for low, high in spots if (x := _leak(ws, it, item_id, int(low), int(high), p))]
            yield pd.DataFrame(rows, columns=["doc_id", *LEAK])

    return run


def leaks(docs: DataFrame, items: DataFrame, *, gram: int = GRAM, least: int = LEAST, one_in: int = ONE_IN, max_broadcast_seeds: int = MAX_BROADCAST_SEEDS, max_forms: int = MAX_FORMS) -> DataFrame:
    """(doc_id, item_id, item_word, n_words, edits, doc_end): every document and item that share a long enough stretch.

    Null and empty texts hold and leak nothing; items shorter than ``least`` words cannot leak; items sharing a passage
    each come out; of several stretches of one item in one document the best one is reported. Repeated doc_ids count as
    one document. Seeds travel to the tasks while they are at most ``max_broadcast_seeds`` (their number is checked);
    beyond that the n-grams of the corpus meet them in a join. So do other spellings of the items' accented words while
    they are at most ``max_forms``; beyond that each document's words meet them in a join.
    """
    p = plan(gram, least, one_in)
    seeds, prepared = seeds_of(items, gram)
    text = docs.select(F.col("doc_id"), F.col("text")).where(F.col("text").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, item_word int, n_words int, edits int, doc_end int"
    spellings_ = prepared.select(F.explode("forms").alias("f")).select("f.form", "f.word").groupBy("form").agg(F.min("word").alias("word"))
    spelled = spellings_.limit(max_forms + 1).collect()
    forms = {r[0]: r[1] for r in spelled} if len(spelled) <= max_forms else None
    if forms is None:
        met = text.mapInPandas(_distinct_words, f"doc_id {kind}, form string").join(spellings_, "form")
        text = stage(text.join(met.groupBy("doc_id").agg(F.collect_set(F.struct("form", "word")).alias("own_forms")), "doc_id", "left"), "leak-texts")
    body = spread(text)
    if seeds.count() <= max_broadcast_seeds:
        postings: dict[tuple[str, ...], list[tuple[int, int, bool]]] = {}
        for r in seeds.collect():
            postings.setdefault(tuple(r["seed"].split(" ")), []).append((r["item_id"], r["place"], r["rare"]))
        texts = {r["item_id"]: list(r["words"]) for r in prepared.select("item_id", "words").collect()}
        shared = docs.sparkSession.sparkContext.broadcast((postings, texts, forms))
        found = body.mapInPandas(lambda it: _bands(*shared.value, p)(it), schema)
    else:
        hits = body.mapInPandas(_all_grams(forms, gram), f"doc_id {kind}, at int, seed string").join(seeds, "seed")
        diagonal = F.floor((F.col("at") - F.col("place")) / (p.band // 2))
        hits = hits.select("doc_id", "item_id", "at", "rare", F.explode(F.array(diagonal, diagonal - 1)).alias("band"))
        bands = hits.groupBy("doc_id", "item_id", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("rare").alias("r"), F.min("at").alias("low"), F.max("at").alias("high"))
        bands = bands.where((F.col("n") >= p.common_hits) | ((F.col("r") > 0) & (F.col("n") >= RARE_HITS)))
        pairs = stage(bands.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("band", "low", "high")).alias("bands")), "leak-candidates")
        ready = pairs.join(prepared.select("item_id", "words"), "item_id").join(text, "doc_id")
        found = ready.mapInPandas(_aligned(forms, p), schema)
    columns = LEAK[1:]
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*columns), F.struct(F.col("n_words") - one_in * F.col("edits"), "n_words", "doc_end")).alias("b"))
    return best.select("doc_id", "item_id", *[F.col(f"b.{c}").alias(c) for c in columns])
