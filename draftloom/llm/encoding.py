"""Garbled text from wrong character encoding: noisy-channel decoding under the word frequencies of the corpus.

A channel is a pair of encodings: text written in one, read as the other. A damaged word is a lattice of byte slots: what
each character was before it was misread, with wildcards where bytes were lost (U+FFFD, or a question mark inside a word).
A lattice without wildcards has one path, which undoing the channel reads off. Of a lattice with wildcards every corpus
word is a possible path; the words that can be one are found by what loss leaves alone (the ASCII letters around the
gaps, or the letters known at both ends) and sent through the lattice by a Viterbi search that prices lost bytes. Every
reading is weighed by how often the word occurs in the corpus against how often the damaged form does, plus what the
structure of the bytes says (a run of characters that is valid UTF-8 is rarely an accident). A second Viterbi search
chooses, per document, the likeliest reading of every word, with a price for changing channels; that path restores it.

Characters written as numeric references or \\u escapes count as themselves. Frequencies and readings are computed per
distinct word; only words that have a reading better than themselves are joined back to documents. Sequences shown
between backticks are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftloom.session import stage

# words with at least one character beyond ASCII, an escape of one, or a question mark before a letter; a no-break space
# belongs to a word only after what may be the first byte of a pair. The same pattern for the JVM and for Python
LEADS = "\u00c2-\u00c5\u00ce-\u00d1\u0412-\u0415\u041e-\u0421"
ESCAPED = r"&#(?:12[89]|1[3-9]\d|[2-9]\d\d|\d{4,7});|&#[xX](?:[89a-fA-F][0-9a-fA-F]|[0-9a-fA-F]{3,6});|\\u(?!00[0-7])[0-9a-fA-F]{4}"
BEYOND = rf"[\u0080-\u009f\u00a1-\uffff]|(?<=[{LEADS}])\u00a0|{ESCAPED}|\?+(?=[A-Za-z])"
WORD = rf"(?<![A-Za-z])[A-Za-z]*+(?:{BEYOND})(?:[A-Za-z]|{BEYOND})*"
WIDE, WIDER = r"\uffff", r"\U0010ffff"
SHOWN = r"`[^`\n]*`"
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp1253", "iso8859_2", "iso8859_15")
# (written in, read as) for encodings of one byte
SINGLE = (
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("iso8859_7", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp1253"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1253", "cp1251"), ("cp1250", "cp1251"),
)
SIGNS = set("‘’‚“”„–—…•·°±½¼¾×÷§¶©®™€£¥¢«»¿¡→←↑↓↔≤≥≠≈∞√´¨ªº²³¹µ№‹›†‡‰ˆ˜¬¯¸¦\u00a0\u00ad")
FLAG, SWITCH = 2.5, 2.0
LOST, WILD = "\ufffd", -1
# log odds of a lost character that no corpus word explains: beside letters, and alone
UNREAD, ALONE = 5.5, 0.5
LOST_BYTE, READABLE, SURE_SIGN = 0.7, 6.0, 0.8
_REFERENCE = re.compile(r"&#[xX]([0-9a-fA-F]+);|&#(\d+);|\\u([0-9a-fA-F]{4})")


def plain_text(token: str) -> str:
    """A token with its numeric references and escapes replaced by the characters they stand for."""
    if "&#" not in token and "\\u" not in token:
        return token
    return _REFERENCE.sub(lambda m: chr(min(int(m[1] or m[3], 16) if m[1] or m[3] else int(m[2]), 0x10FFFF)), token)


def to_bytes(text: str, read_as: str) -> bytes | None:
    """The bytes that were read as ``text``; C1 controls stand for bytes the encoding leaves undefined."""
    try:
        return text.encode(read_as)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(read_as)
            except UnicodeEncodeError:
                if 0x80 <= ord(ch) <= 0x9F:
                    out.append(ord(ch))
                else:
                    return None
        return bytes(out)


def _likely(text: str) -> bool:
    """Whether a decoded word could be one: letters of one script besides ASCII, or common signs."""
    scripts = set()
    for ch in text:
        if ch.isascii():
            if not ch.isprintable():
                return False
            if ch.isalpha():
                scripts.add("L")
        elif ch.isalpha():
            scripts.add("G" if "\u0370" <= ch <= "\u03ff" or "\u1f00" <= ch <= "\u1fff" else "C" if "\u0400" <= ch <= "\u04ff" else "L" if ch < "\u0250" else unicodedata.name(ch, "?").split()[0])
        elif ch not in SIGNS:
            return False
    return len(scripts) < 2


def readings(token: str) -> list[tuple[str, str, float]]:
    """(channel, word, structural evidence) for every channel that can be undone without loss."""
    out: dict[str, tuple[str, float]] = {}
    if LOST in token:
        return []
    for read_as in READ_AS:
        text, depth, gain = token, 0, 0.0
        while depth < 3:
            raw = to_bytes(text, read_as)
            if raw is None:
                break
            try:
                decoded = raw.decode("utf-8")
            except UnicodeDecodeError:
                break
            if decoded == text:
                break
            gain += sum(6.5 if len(ch.encode()) == 2 else 9.0 for ch in decoded if not ch.isascii())
            # other scripts than the three the encodings here can lose need the corpus to speak for them
            gain -= 7.0 * sum(ch.isalpha() and ord(ch) > 0x52F and not 0x1E00 <= ord(ch) <= 0x1FFF for ch in decoded)
            text, depth = decoded, depth + 1
            if _likely(text) and (text not in out or out[text][1] < gain):
                out[text] = (f"utf_8>{read_as}" + f"*{depth}" * (depth > 1), gain)
            if text.isascii():
                break
    for written, read_as in SINGLE:
        raw = to_bytes(token, read_as)
        if raw is None:
            continue
        try:
            decoded = raw.decode(written)
        except UnicodeDecodeError:
            continue
        if decoded != token and decoded not in out and _likely(decoded) and all(ch.isalpha() for ch in decoded):
            # signs and digits inside a word that its reading has no need of
            odd = sum(not ch.isalpha() for ch in token if not ch.isascii())
            out[decoded] = (f"{written}>{read_as}", min(3.0, 1.5 * odd))
    return [(channel, word, gain) for word, (channel, gain) in out.items()]


def slots(token: str, read_as: str) -> list[int] | None:
    """The byte lattice of a token: the byte each character was, WILD for a lost one; None if ``read_as`` cannot write it."""
    out: list[int] = []
    for ch in token:
        if ch in (LOST, "?"):
            out.append(WILD)
        elif (raw := to_bytes(ch, read_as)) is None:
            return None
        else:
            out += raw
    return out


def through(lattice: list[int], raw: bytes, most: int) -> float | None:
    """The price of the cheapest path of ``raw`` through the lattice (Viterbi), or None: a known slot takes its own byte,
    a wildcard one to ``most`` bytes beyond ASCII at LOST_BYTE each."""
    best = {0: 0.0}
    for slot in lattice:
        now: dict[int, float] = {}
        for at, price in best.items():
            if slot != WILD:
                if at < len(raw) and raw[at] == slot:
                    now[at + 1] = min(price, now.get(at + 1, price))
                continue
            for k in range(1, most + 1):
                if at + k > len(raw) or raw[at + k - 1] < 0x80:
                    break
                now[at + k] = min(price + k * LOST_BYTE, now.get(at + k, float("inf")))
        best = now
        if not best:
            return None
    return best.get(len(raw))


def _written(word: str, encoding: str) -> bytes | None:
    try:
        return word.encode(encoding)
    except UnicodeEncodeError:
        return None


def _twice(word: str, read_as: str) -> bytes | None:
    raw = word.encode()
    return None if any(b in raw for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0x98)) else raw.decode(read_as, "replace").encode()


# (name, what the word was as bytes, how those were read, bytes a wildcard can stand for)
LOSSY: list[tuple[str, Callable[[str], bytes | None], str, int]] = [
    *((f"utf_8>{r}", lambda w: w.encode("utf-8", "ignore"), r, 1) for r in (*READ_AS, "ascii")),
    ("utf_8>utf_8", lambda w: w.encode("utf-8", "ignore"), "utf_8", 4),
    *((f"utf_8>{r}*2", lambda w, r=r: _twice(w, r), r, 1) for r in ("cp1252", "cp1251", "cp1250", "cp1253")),
    *((f"{x}>utf_8", lambda w, x=x: _written(w, x), "utf_8", 3) for x in ("cp1252", "cp1250", "cp1251", "cp1253", "mac_roman", "cp437", "koi8_r", "iso8859_2")),
    *((f"{x}>{r}", lambda w, x=x: _written(w, x), r, 1) for x, r in SINGLE),
    ("any>ascii", lambda w: bytes(ord(ch) if ch.isascii() else 0xFF for ch in w), "ascii", 1),
]


_MISREADS = {f"{x}>{r}" for x, r in SINGLE}


def paths(token: str, word: str) -> list[tuple[str, str, float]]:
    """(channel, word in the case that fits, price) for every lossy channel whose lattice of ``token`` has ``word`` as a path."""
    out: dict[str, tuple[str, float]] = {}
    lattices: dict[str, list[int] | None] = {}
    misread = any(not ch.isascii() and ch != LOST for ch in token)
    for name, write, read_as, most in LOSSY:
        if not misread and name in _MISREADS:  # between one-byte encodings only misread letters tell channels apart
            continue
        if read_as not in lattices:
            lattices[read_as] = slots(token, read_as)
        if lattices[read_as] is None:
            continue
        for form in dict.fromkeys((word, word.lower(), word.capitalize(), word.upper())):
            raw = write(form)
            if raw is not None and (price := through(lattices[read_as], raw, most)) is not None and (name not in out or price < out[name][1]):
                out[name] = (form, price)
    return [(name, form, price) for name, (form, price) in out.items()]


def _bare(token: str) -> str:
    return "".join(ch.lower() if ch.isascii() and ch.isalpha() else "*" for ch in token)


def gap_keys(token: str) -> list[str]:
    """Where to look for the words a token with gaps may be: its ASCII letters around the gaps, or, where there are too
    few, the letters known at both ends, as they stand or after the known bytes were read as UTF-8. Where nothing is left
    it may be any sign that stands alone elsewhere (as many as there are signs)."""
    if sum(ch.isascii() and ch.isalpha() for ch in token) >= 2:
        return ["a" + re.sub(r"\*+", "*", _bare(token))]
    if set(token) == {LOST}:
        return ["s"]
    out = set()
    for read_as in ("utf_8", *READ_AS):
        lattice = slots(token, read_as)
        if lattice is None:
            continue
        pieces, run = [], bytearray()
        for slot in [*lattice, WILD]:
            if slot == WILD:
                pieces.append(run.decode("utf-8", "replace"))
                run = bytearray()
            else:
                run.append(slot)
        head = re.match(r"[^\ufffd]*", pieces[0])[0].lower()[:3]
        tail = re.search(r"[^\ufffd]*$", pieces[-1])[0].lower()[-3:]
        if len(head) + len(tail) >= 3:
            out.add(f"e{head}|{tail}")
    return sorted(out)


def word_keys(word: str) -> list[str]:
    """The keys under which ``gap_keys`` of any damaged form of ``word`` can look."""
    if sum(ch.isascii() and ch.isalpha() for ch in word) >= 2:
        return ["a" + re.sub(r"\*+", "*", _bare(word))]
    w = word.lower()
    if len(w) == 1 and not w.isalpha():
        return ["s"]
    return sorted({f"e{w[:a]}|{w[len(w) - b :]}" for a in range(4) for b in range(4) if 3 <= a + b and max(a, b) <= len(w)})


def _gaps(token: str) -> bool:
    return LOST in token or "?" in token


def _spoiled(token: str) -> bool:
    return _gaps(token) or any(0x80 <= ord(ch) <= 0x9F for ch in token)


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        clean = [plain_text(t) for t in batch["token"]]
        yield pd.DataFrame({"token": batch["token"], "clean": clean, "n": batch["n"]})[[not c.isascii() or "?" in c for c in clean]]


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(t, c, n, channel, word, gain) for t, c, n in zip(batch["token"], batch["clean"], batch["n"]) for channel, word, gain in readings(c)]
        yield pd.DataFrame(rows, columns=["token", "clean", "n", "channel", "word", "gain"])


def _gap_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(t, c, k) for t, c in zip(batch["token"], batch["clean"]) for k in gap_keys(c)]
        yield pd.DataFrame(rows, columns=["token", "clean", "key"])


def _word_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, w, n) for w, n in zip(batch["clean"], batch["n"]) if not _spoiled(w) for k in word_keys(w)]
        yield pd.DataFrame(rows, columns=["key", "word", "n_word"])


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(t, channel, form, n, price) for t, c, w, n in zip(batch["token"], batch["clean"], batch["word"], batch["n_word"]) for channel, form, price in paths(c, w)]
        yield pd.DataFrame(rows, columns=["token", "channel", "word", "n_word", "price"])


def _java(pattern: str) -> str:
    return pattern.replace(r"\uffff", r"\x{10ffff}")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, at, token): every word beyond ASCII outside of backticks, numbered within its document."""
    text = F.regexp_replace(F.col("text"), SHOWN, " ")
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(_java(WORD)), F.lit(0))).alias("at", "token"))


def damage_table(words: DataFrame) -> DataFrame:
    """(token, channel, word, gain): for every distinct word, the readings that may beat the word itself.

    ``words``: (token, clean, n) with corpus counts. ``gain`` is a log-likelihood ratio against the word as it stands.
    """
    lower = stage(words.groupBy(F.lower("clean").alias("w")).agg(F.sum("n").alias("c")), "damage-words")
    undone = words.mapInPandas(_readings, "token string, clean string, n long, channel string, word string, gain double")
    own = lower.select(F.col("w").alias("own"), F.col("c").alias("c_own"))
    weighed = undone.withColumn("w", F.lower("word")).withColumn("own", F.lower("clean")).join(lower, "w", "left").join(own, "own", "left")
    known = F.coalesce("c", F.lit(0))
    ratio = F.log((known + 0.5) / (F.coalesce("c_own", "n") + 0.5))
    plain = F.length(F.regexp_replace("word", r"[^\x00-\x7f]", "")) == F.length("word")
    utf = F.col("gain") + F.when(plain, F.lit(0.0)).when(known > 0, F.least(ratio, F.lit(6.0))).otherwise(-1.5)
    letters = F.length("word")
    single = F.when((known >= 2) & (letters >= 3), ratio + F.col("gain") - 1.0).when((known >= 2) & (letters == 2), F.least(ratio - 1.0, F.lit(1.0))).when((known >= 2), F.least(ratio - 1.0, F.lit(0.5))).otherwise(-9.0)
    undone = weighed.select("token", "channel", "word", F.when(F.col("channel").startswith("utf_8>"), utf).otherwise(single).alias("gain")).where("gain > 0.3")
    gone = F.col("clean").contains(LOST) | F.col("clean").rlike(r"[\x{80}-\x{9f}]")
    asked = F.col("clean").contains("?")
    broken = words.where(gone | asked)
    looked = broken.mapInPandas(_gap_keys, "token string, clean string, key string")
    index = words.mapInPandas(_word_keys, "key string, word string, n_word long").groupBy("key", "word").agg(F.sum("n_word").alias("n_word"))
    fits = looked.join(index, "key").drop("key").distinct().mapInPandas(_paths, "token string, channel string, word string, n_word long, price double")
    # a question mark may be one, so a word seen once does not speak against it, and at a word's start it takes two
    doubt = F.when(~F.col("token").contains("?"), F.lit(0.0)).when(F.col("n_word") < 2, F.lit(9.0)).when(F.col("token").startswith("?"), F.lit(4.5)).otherwise(F.lit(2.0))
    rated = fits.withColumn("gain", READABLE + F.least(F.log(F.col("n_word").cast("double")), F.lit(12.0)) - F.col("price") - doubt).where("gain > 0.3")
    rated = rated.withColumn("gain", F.when(F.col("token").startswith("?"), F.least("gain", F.lit(2.0))).when(F.col("token").contains("?"), F.least("gain", F.lit(4.0))).otherwise(F.col("gain")))
    lossy = rated.groupBy("token", "channel").agg(F.max_by("word", F.struct("gain", "word")).alias("word"), F.max("gain").alias("gain"), (F.max("n_word") / F.sum("n_word")).alias("share"))
    # where nothing but a sign's place is left, it is read only if one sign is by far the likeliest
    bare = ~F.col("token").rlike(r"[^\x{fffd}]") & (F.col("share") < SURE_SIGN)
    lossy = lossy.select("token", "channel", F.when(~bare, F.col("word")).alias("word"), "gain")
    # no encoding writes a lost character: damage that no word explains has its price, less where it stands alone
    alone = ~F.col("clean").rlike(r"\p{L}")
    unread = broken.where(gone).select("token", F.lit("lost").alias("channel"), F.lit(None).cast("string").alias("word"), F.when(alone, F.lit(ALONE)).otherwise(F.lit(UNREAD)).alias("gain"))
    return undone.unionByName(lossy).unionByName(unread)


def viterbi(steps: list[list[tuple[str, str | None, float]]], switch: float = SWITCH) -> tuple[float, list[tuple[str, str | None] | None]]:
    """The best path through per-word readings (channel, word, gain); None is the word as it stands, with gain 0."""
    best: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
    for options in steps:
        top = max(best.values(), key=lambda x: x[0])
        now: dict[str, tuple[float, tuple]] = {}
        for channel, word, gain in [("", None, 0.0), *options]:
            stay = best.get(channel, (float("-inf"), ()))
            move = (top[0] - switch * (channel != ""), top[1])
            score, path = stay if stay[0] >= move[0] else move
            choice = (score + gain, (path, None if channel == "" else (channel, word)))
            if channel not in now or choice[0] > now[channel][0]:
                now[channel] = choice
        best = now
    score, path = max(best.values(), key=lambda x: x[0])
    out: list = []
    while path:
        path, step = path
        out.append(step)
    return score, out[::-1]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, hits in zip(batch["doc_id"], batch["hits"]):
            by_place: dict[int, list] = {}
            for h in sorted(hits, key=lambda h: (h["at"], -h["gain"], h["channel"])):
                by_place.setdefault(h["at"], []).append((h["channel"], h["word"], h["gain"]))
            score, path = viterbi(list(by_place.values()))
            if score > FLAG:
                rows += [(doc_id, at, step[0], step[1], score) for at, step in zip(by_place, path) if step is not None]
        yield pd.DataFrame(rows, columns=["doc_id", "at", "channel", "word", "score"])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, at, channel, word, score): the damaged words of all documents with their best reading (null: lost).

    Null and empty texts and texts without characters beyond ASCII have none; repeated doc_ids count as one document.
    """
    found = tokens(docs)
    counted = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    words = stage(counted.mapInPandas(_cleaned, "token string, clean string, n long"), "damage-tokens")
    damage = stage(damage_table(words), "damage-readings")
    per_doc = found.join(damage, "token").groupBy("doc_id").agg(F.collect_list(F.struct("at", "channel", "word", "gain")).alias("hits"))
    # no path can score more than all readings that speak for damage together
    most = F.aggregate("hits", F.lit(0.0), lambda a, h: a + F.greatest(h["gain"], F.lit(0.0)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_doc.where(most > FLAG + SWITCH).mapInPandas(_decode, f"doc_id {kind}, at int, channel string, word string, score double")


def restore(docs: DataFrame, damaged: DataFrame) -> DataFrame:
    """(doc_id, restored, n_words, n_lost, channels): every affected document with its text as far as it can be restored."""
    by_doc = damaged.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("words"), F.count(F.lit(1)).cast("int").alias("n_words"), F.count_if(F.col("word").isNull()).cast("int").alias("n_lost"), F.concat_ws(",", F.array_sort(F.collect_set("channel"))).alias("channels"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = re.compile(f"({SHOWN})|({WORD.replace(WIDE, WIDER)})")
        for batch in batches:
            texts = []
            for text, words in zip(batch["text"], batch["words"]):
                at, out, end = -1, [], 0
                chosen = dict(words)
                for m in part.finditer(text):
                    if m[1] is not None:
                        continue
                    at += 1
                    if chosen.get(at) is not None:
                        out += [text[end : m.start()], chosen[at]]
                        end = m.end()
                texts.append("".join(out) + text[end:])
            yield batch[["doc_id", "n_words", "n_lost", "channels"]].assign(restored=texts)[["doc_id", "restored", "n_words", "n_lost", "channels"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").join(by_doc, "doc_id").mapInPandas(run, f"doc_id {kind}, restored string, n_words int, n_lost int, channels string")
