"""Text cut off by field limits or in transfer: hashed logistic regression trained on artificially cut texts.

Positives are nothing but artificial cuts of intact values: at random places, near the end, at the field limits of the
value's own source, some with the remark behind them that another sampled text closes with. Negatives are the values as
they are; a first fit on one half, on the form of closings alone, shows which values of the other half are hardly intact,
and these are left out (never taken as positives). Words stay out of that fit, or what is often cut at would look usual. Limits are counted over all rows: lengths, in characters or bytes, that a source reaches far more
often than their neighbours. Words that texts use before their end are counted over all rows too; only the fit itself
works on a sample, which is drawn, cut and turned into feature numbers on the executors and depends on the rows alone,
not on their order or partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.llm.skew import fans, skew_join
from kinledger.runtime import BROADCAST_LIMIT_BYTES, cut

BITS = 16
TRAIN_ROWS = 8_000
THRESHOLD = 0.6
#: Values as they are that the other half's fit gives more than this are not taken as intact.
DOUBT, DOUBT_ROUNDS, HALF_STEPS = 0.8, 3, 500
NEAR = 25
SPIKE = 6.0
SPIKE_ROWS = 8

MIN_ROWS = 5
ENTRY_BYTES = 64

WORD = re.compile(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]")
#: A remark that closes a text: dots, a short bracketed one (which may lack its closing bracket), one between dashes.
REMARK = re.compile(r"\s*(?:\.{2,}|…|[\[(<](?:\.{2,}|…|[\p{L}][\p{L} .]{1,24})(?:[\])>]|$)|-{2,} ?[\p{L}][\p{L} ]{1,38}-{2,})$")
#: Shares of the cuts that get another text's remark, that are made at a limit of the source where the text is longer,
#: and of the intact values that count as being at a limit by chance.
REMARKED, AT_LIMIT, BY_CHANCE = 0.2, 0.4, 0.02
RULE = re.compile(r"(?:\s*\n|^)\s*([-=*_~#])\1{4,}\s*$")
EMOJI = re.compile(r"\s*[\U0001F000-\U0001FAFF\u2600-\u27bf\ufe0f\u200d]+$")
SENTENCE_END = re.compile(r"[.!?।]['\")\]]?$|[।.!?]$")


def _h(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(s: str) -> str:
    out = []
    for ch in s:
        if ch.isdigit():
            c = "9"
        elif ch.isalpha():
            c = "A" if ch.isupper() else "a"
        elif ch.isspace():
            c = " "
        elif ord(ch) > 0x2FFF:
            c = "E"
        else:
            c = ch
        out.append(c)
    return "".join(out)


def closing(text: str) -> tuple[str, str]:
    """(text without outer blanks, a trailing rule and a closing remark; the remark or '')."""
    body = text.rstrip()
    body = RULE.sub("", body) or body
    bare = EMOJI.sub("", body)
    if bare and bare != body:
        return bare, "emoji"
    m = REMARK.search(body, max(0, len(body) - 80))
    return (body[: m.start()].rstrip() or body, m[0].strip()) if m else (body, "")


def plain(s: str) -> str:
    return re.sub(r"\p{Nd}+", "9", s.lower())


def last_word(text: str) -> str | None:
    """The word or sign a text closes with, as the word counts spell it."""
    tail = WORD.findall(closing(text)[0][-160:])
    return plain(tail[-1]) if tail else None


def features(text: str, limit: str, is_known: bool) -> np.ndarray:
    """Hashed indices of a text's closing; ``limit`` is 'none', 'chars', 'bytes' or '' (forms only: no limits, no words).

    ``is_known`` says whether the last word is one of :func:`known_words`.
    """
    body, mark = closing(text)
    lines = body[-2000:].rsplit("\n", 3)
    last = lines[-1].strip()
    before = lines[-2].strip() if len(lines) > 1 else ""
    tail = WORD.findall(body[-160:])
    words = [plain(w) for w in tail[-4:]]
    start = body.lstrip()[:200].lower()
    kind = "html" if "<html" in start or start[:2] in ("<p", "<d", "<h", "<!", "<b") else "json" if start[:1] in ("{", "[") else "plain"
    closed = (kind == "html" and body[-8:].lower().endswith("</html>")) or (kind == "json" and body[-1:] in ("}", "]"))
    end = body[-1:]
    sentence = bool(SENTENCE_END.search(body[-3:]))
    since = re.split(r"[.!?।\n]\s", body[-400:])[-1]
    opened = since.count("(") > since.count(")"), body[-600:].count("<") > body[-600:].count(">"), since.count('"') % 2 == 1
    n_words = len(last.split())
    state = f"{sentence}|{kind}|{closed}"
    f = [
        "bias",
        f"state={state}",
        f"markshape={_shape(mark[:1])}{_shape(mark[-1:])}|{min(len(mark.split()), 4)}",
        f"mark={bool(mark)}|{state}|{is_known}",
        f"end={_shape(end)}|{kind}",
        f"end2={_shape(body[-2:])}",
        f"end3={_shape(body[-3:])}",
        f"space={text.rstrip() != text}|{sentence}",
        f"opened={opened}|{kind}",
        f"known={is_known}|{state}",
        f"line={min(n_words, 12)}|{state}",
        f"firstchar={_shape(last[:1])}{last[:1] if not last[:1].isalnum() else ''}|{min(n_words, 6)}|{sentence}",
        f"beforeend={_shape(before[-1:])}|{min(n_words, 6)}|{sentence}|{is_known}",
    ]
    own_line = f"{len(lines) > 1 and n_words <= 8}|{plain(last.split()[0]) if n_words > 1 and n_words <= 8 and len(lines) > 1 else ''}"
    f.append(f"ownline={len(lines) > 1 and n_words <= 8}|{sentence}|{is_known}")
    if words:
        f.append(f"len={min(len(words[-1]), 12)}|{_shape(tail[-1][:1])}|{sentence}|{is_known}")
    if not limit:
        return np.array([_h(x) for x in f], dtype=np.int32)
    f += [
        f"mark={mark.lower()}",
        f"first={plain(last.split()[0]) if last else ''}|{min(n_words, 6)}|{sentence}",
        f"before={plain(before)[-24:]}|{min(n_words, 4)}|{sentence}",
        f"last={plain(last)}" if len(last) <= 60 else "last=long",
        f"rest={plain(since)}" if len(since) <= 20 else "rest=long",
        f"signed={plain(before)[-24:]}|{n_words <= 6}",
        f"own={own_line}|{words[-1] if words else ''}",
        f"own={own_line}|{is_known}",
        *[f"w{n}=" + " ".join(words[-n:]) + f"|{len(lines) > 1 and n_words <= 8}" for n in (1, 2, 3)],
        f"limit={limit != 'none'}|{state}",
        f"limit={limit != 'none'}|mark={bool(mark)}|{sentence}|{is_known}",
        f"limit={limit}|{is_known}",
    ]
    return np.array([_h(x) for x in f], dtype=np.int32)


def cut_once(text: str, r: float, spread: float) -> str | None:
    """An intact text cut behind its first tenth; None where that would leave a whole sentence, line or nothing."""
    n = len(text.rstrip())
    if n < 12:
        return None
    # half of the cuts fall anywhere, half near the end, where closings are cut in two
    at = int(n * (0.1 + 0.9 * r)) if spread < 0.5 else n - 1 - int(r * min(60, n - 8))
    part = text[: max(at, 4)]
    bare = part.rstrip()
    if not bare or SENTENCE_END.search(bare[-3:]) and len(bare) < n:
        return None
    if text.rstrip()[len(bare) : len(bare) + 1] in (" ", "\n", "") and bare.endswith((":", ")", '"', "-")) or text[len(bare) :].lstrip(" ").startswith("\n") and text[len(bare) :].strip():
        return None
    return part


def fit(rows: list[tuple[np.ndarray, int]], steps: int = 1_500, seed: int = 7) -> np.ndarray:
    """L2-regularised logistic regression over hashed indicators (AdaGrad, mini-batches, at least ``steps`` of them).

    Indicators of fewer than MIN_ROWS rows are left out, so that no row is learnt by heart.
    """
    w = np.zeros(1 << BITS)
    if not rows:
        return w
    seen = np.zeros(1 << BITS, dtype=np.int64)
    for f, _ in rows:
        seen[np.unique(f)] += 1
    used = np.flatnonzero(seen >= MIN_ROWS)
    place = np.full(1 << BITS, len(used), dtype=np.int32)
    place[used] = np.arange(len(used))
    # rows as places of used indicators, padded with a last place whose weight stays 0
    x = np.full((len(rows), max(len(f) for f, _ in rows)), len(used), dtype=np.int32)
    for i, (f, _) in enumerate(rows):
        x[i, : len(f)] = place[f]
    y = np.array([label for _, label in rows], dtype=float)
    v, g2 = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(max(12, -(-steps * 256 // len(rows)))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 256):
            b = x[order[lo : lo + 256]]
            p = 1 / (1 + np.exp(-np.clip(v[b].sum(1), -30, 30)))
            grad = np.bincount(b.ravel(), np.repeat(p - y[order[lo : lo + 256]], b.shape[1]), minlength=len(v)) / len(b) + 1e-6 * v
            grad[-1] = 0.0
            g2 += grad * grad
            v -= 0.25 * grad / np.sqrt(g2)
    w[used] = v[:-1]
    return w


def score(weights: np.ndarray, f: np.ndarray) -> float:
    z = float(np.clip(weights[f].sum(), -30, 30))
    return 1 / (1 + np.exp(-z))


def field_limits(docs: DataFrame, text: str, source: str) -> DataFrame:
    """(source, unit, length) of the lengths a source hits at least SPIKE times as often as the NEAR lengths around.

    Counts are of different texts over all rows and are aggregated before any window, so a window sees lengths, never texts.
    """
    sized = docs.where(F.length(text) > 0).select(
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.xxhash64(text).alias("h"),
        F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length(text).alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("length")))).alias("s"),
    )
    # copies of one text count once: many texts must share the length
    counts = sized.select("source", "s.unit", "s.length", "h").distinct().groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-NEAR, NEAR)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    return counts.withColumn("around", around).where((F.col("n") >= SPIKE_ROWS) & (F.col("n") >= SPIKE * F.greatest("around", F.lit(0.5)))).select("source", "unit", "length")


def with_limits(docs: DataFrame, key: str, text: str, source: str, limits: DataFrame) -> DataFrame:
    """(key, source, text, limit) where limit is 'chars', 'bytes' or 'none'."""
    base = docs.select(F.col(key), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"), F.length(text).alias("_chars"), F.octet_length(text).alias("_bytes"))
    # A few lengths per source; broadcast only when their number is small, else the join is left to Spark.
    few = limits.count() <= 100_000
    hint = F.broadcast if few else (lambda df: df)
    for unit in ("chars", "bytes"):
        own = limits.where(F.col("unit") == unit).select("source", F.col("length").alias(f"_{unit}"), F.lit(True).alias(f"_at_{unit}"))
        base = base.join(hint(own), ["source", f"_{unit}"], "left")
    return base.select(key, "source", "text", F.when(F.col("_at_chars"), "chars").when(F.col("_at_bytes"), "bytes").otherwise("none").alias("limit"))


@F.pandas_udf(T.StringType())
def _last_word(s: pd.Series) -> pd.Series:
    return s.map(lambda t: last_word(t) if t else None).astype(object)


def known_words(labelled: DataFrame) -> DataFrame:
    """(word) of the words and signs that occur before the end of at least MIN_ROWS texts, counted over all rows.

    The last word of a text may be cut itself and does not count there. Native expressions, each text once.
    """
    plain_text = F.regexp_replace(F.lower("text"), "\\p{Nd}+", "9")
    words = F.regexp_extract_all(plain_text, F.lit("[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]"), F.lit(0))
    each = labelled.where(F.length("text") > 0).select(words.alias("w")).where("size(w) > 1").select(F.explode(F.array_distinct(F.slice("w", F.lit(1), F.size("w") - 1))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS).select("word")


def with_known(labelled: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """``labelled`` plus ``is_known``: whether the last word is in ``known``, which takes ``size`` bytes.

    A list too large to broadcast is joined with its hot words (most texts end in a full stop) over several tasks.
    """
    ends = labelled.withColumn("word", _last_word("text"))
    marked = known.withColumn("_known", F.lit(True))
    if size <= BROADCAST_LIMIT_BYTES:
        joined = ends.join(F.broadcast(marked), "word", "left")
    else:
        ends = cut(ends)
        joined = skew_join(ends, marked, "word", F.col("text"), fans(ends.groupBy("word").agg(F.count("*").alias("n")), "word"), "left")
    return joined.withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("word", "_known")


DRAWN = T.ArrayType(T.StructType().add("part", "string").add("label", "integer").add("limit", "string"))


def _cuts(text: str, limit: str, lengths: list, seed: int, remarks: list[str]) -> list[tuple[str, int, str]]:
    """A sampled value as a negative, and an artificial cut of it as a positive; what is drawn depends on ``seed`` alone."""
    rng = np.random.default_rng(seed & (2**63 - 1))
    r = rng.random(8)
    if limit != "none":
        return []  # most values at a limit are cut: neither intact nor cut by us
    out = [(text, 0, "chars" if r[0] < BY_CHANCE else "none")]
    at = [(x["unit"], x["length"]) for x in lengths if x["length"] < (len(text) if x["unit"] == "chars" else len(text.encode()))]
    if at and r[1] < AT_LIMIT:
        unit, n = at[int(r[2] * len(at))]
        part = text[:n] if unit == "chars" else text.encode()[:n].decode("utf-8", "ignore")
        if part.strip() and not SENTENCE_END.search(part.rstrip()[-3:]):
            return [*out, (part, 1, unit)]
    part = cut_once(text, r[3], r[4]) if not closing(text)[1] else None
    if part is not None:
        if r[5] < 0.05:
            part += "\ufffd"
        if remarks and r[6] < REMARKED:
            part = part.rstrip() + " " * int(r[7] * 2) + remarks[int(rng.random() * len(remarks))]
        out.append((part, 1, "none"))
    return out


@F.pandas_udf(T.StringType())
def _remark(s: pd.Series) -> pd.Series:
    return s.map(lambda t: closing(t)[1]).astype(object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(s: pd.Series, limit: pd.Series, is_known: pd.Series) -> pd.Series:
    return pd.Series([features(t, k, w) for t, k, w in zip(s, limit, is_known, strict=True)], dtype=object)


def train(labelled: DataFrame, key: str, known: DataFrame, size: int, limits: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from about ``rows`` texts (never more than twice that), drawn by the hash of key and text from all non-blank ones.

    The bound covers fitting only; limits, known words and scores cover every row. The driver gets feature numbers and
    closing remarks (at most 80 characters each), never texts.
    """
    usable = labelled.where(F.length(F.trim("text")) > 0)
    share = rows / max(usable.count(), 1)
    # a hash threshold and not an ordered limit, for which every task would send as many texts
    seed = F.xxhash64(F.lit("fit"), F.col(key).cast("string"), "text")
    by_source = limits.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("unit", "length"))).alias("lengths"))
    drawn = usable.withColumn("seed", seed).where(F.pmod("seed", F.lit(1_000_003)) < int(share * 1_000_003) + 1).limit(2 * rows)
    sample = cut(drawn.join(by_source, "source", "left").select("text", "limit", "seed", F.coalesce("lengths", F.array().cast("array<struct<unit:string,length:int>>")).alias("lengths")))
    remarks = sorted(r.m for r in sample.select(_remark("text").alias("m")).collect() if r.m and r.m != "emoji")

    @F.pandas_udf(DRAWN)
    def draw(text: pd.Series, limit: pd.Series, lengths: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([[{"part": p, "label": y, "limit": k} for p, y, k in _cuts(*x, remarks)] for x in zip(text, limit, lengths, seed, strict=True)], dtype=object)

    parts = sample.select("seed", F.explode(draw("text", "limit", "lengths", "seed")).alias("d")).select("seed", "d.*").withColumnRenamed("part", "text")
    found = with_known(parts, known, size).select("seed", "label", _features("text", F.lit(""), "is_known").alias("plain"), _features("text", "limit", "is_known").alias("full"))
    rows_ = sorted((r.seed, r.label, r.plain, r.full) for r in found.collect())
    plain_rows = [(np.array(p, dtype=np.int32), y) for _, y, p, _ in rows_]
    half = [s & 1 for s, *_ in rows_]
    doubtful = [False] * len(rows_)
    for _ in range(DOUBT_ROUNDS):
        # each round learns from the other half without what the round before doubted
        halves = [fit([x for x, h, out in zip(plain_rows, half, doubtful, strict=True) if h == side and not out], HALF_STEPS) for side in (0, 1)]
        doubtful = [y == 0 and score(halves[1 - h], f) > DOUBT for (f, y), h in zip(plain_rows, half, strict=True)]
    return fit([(np.array(f, dtype=np.int32), y) for (_, y, _, f), out in zip(rows_, doubtful, strict=True) if not out])


def score_all(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, p) for every row: probability that the text was cut; null for null, empty and blank texts."""
    limits = cut(field_limits(docs, text, source))
    labelled = with_limits(docs, key, text, source, limits)
    known, seen = cut(known_words(labelled), rows=F.count(F.lit(1)), width=F.sum(F.octet_length("word")))
    size = seen.rows * ENTRY_BYTES + (seen.width or 0)
    weights = train(labelled, key, known, size, limits)

    @F.pandas_udf(T.DoubleType())
    def probability(s: pd.Series, limit: pd.Series, is_known: pd.Series) -> pd.Series:
        return pd.Series([score(weights, features(t, k, w)) if t and t.strip() else None for t, k, w in zip(s, limit, is_known, strict=True)], dtype="float64")

    return with_known(labelled, known, size).select(key, "source", probability("text", "limit", "is_known").alias("p"))


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return score_all(docs, key, text, source).where(F.col("p") >= THRESHOLD)


def share_by_source(docs: DataFrame) -> DataFrame:
    """Per source: rows, texts found cut, and their share."""
    scored = score_all(docs)
    hit = F.count_if(F.col("p") >= THRESHOLD)
    return scored.groupBy("source").agg(F.count("*").alias("n"), hit.alias("n_cut"), F.round(hit / F.count("*"), 6).alias("share"))
