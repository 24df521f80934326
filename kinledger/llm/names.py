"""Variant spellings of names typed by people, by noisy-channel attribution.

Canonical forms are the listed names (current and former). How often a form is typed exactly is its prior; the channel
model gives the cost (negative log-likelihood) of a variant: keyboard slips, doubled or swapped letters, phonetic
spelling, digits for letters, abbreviated, dropped or reordered words, initials, lost or extra blanks. What a word of the
trade is typed as is estimated from the names themselves: names that differ from a listed one in a single word count as
its variants (:func:`estimate_words`). Each variant is attached to the form of maximum posterior, or to none where even
that is unlikely. Candidates meet on the brand part of the name, exactly or within two edits of letters or sound (one for
brands below six letters). Pairs are formed between distinct readings and distinct listed forms, never between rows: a
brand that a third of all rows share has as many pairs as it has spellings times trades, spread over several tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.functions.text import fold_ascii
from kinledger.llm.skew import fans, salt, skew_join, spread, workers
from kinledger.llm.strings import index_keys, query_keys
from kinledger.runtime import cut

# Words of the legal form, of address and of courtesy, and the rows of a keyboard.
LEGAL = {"private", "pvt", "p", "ltd", "limited", "co", "company", "llp", "plc", "corp", "corporation", "inc", "incorporated", "public", "pvtltd"}
COURTESY = {"ms", "messrs", "mr", "mrs"}
PREFIXES = {"new", "the", "shri", "shree", "sri", "s", "r", "m", "india"}
KEYBOARD = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
WORD_HEADS = 0.005
MAX_BRAND, MAX_LINE, MAX_TOTAL = 2.7, 2.4, 3.7
MIN_POSTERIOR = 0.6
#: Costs are negative log-likelihoods divided by this.
SCALE = 1.7
#: A learnt word must stand under so many different brands, and make up this share of all such findings.
LEARN_HEADS, LEARN_SHARE = 3, 0.0002
#: Brands below this length admit one slip.
SHORT_BRAND = 6

_PLACE = {c: (r, i + r * 0.5) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}


def adjacent(a: str, b: str) -> bool:
    return a in _PLACE and b in _PLACE and abs(_PLACE[a][0] - _PLACE[b][0]) <= 1 and abs(_PLACE[a][1] - _PLACE[b][1]) <= 1.1


def phonetic(s: str) -> str:
    """Spellings that sound alike become equal."""
    for a, b in (("ksh", "x"), ("ks", "x"), ("cs", "x"), ("zh", "j"), ("z", "j"), ("ph", "f"), ("sh", "s"), ("ch", "c"), ("ee", "i"), ("oo", "u"), ("ck", "k"), ("q", "k"), ("c", "k"), ("w", "v")):
        s = s.replace(a, b)
    s = re.sub(r"(?<=[bcdgjkpt])h", "", s)
    return re.sub(r"(.)\1+", r"\1", s)


def slips(typed: str, meant: str, limit: float) -> float:
    """Weighted edit cost of a word: neighbours on the keyboard, swaps, doubled and lost letters are cheap.

    Cells further off the diagonal than ``limit`` can pay for are skipped, and so are equal beginnings and endings up
    to the letter next to the difference (on which costs depend).
    """
    if typed == meant:
        return 0.0
    width = int(limit / 0.8)
    if abs(len(typed) - len(meant)) > width:
        return 99.0
    lo, most = 0, min(len(typed), len(meant))
    while lo < most and typed[lo] == meant[lo]:
        lo += 1
    lo = max(0, lo - 2)
    end = 0
    while end < most - lo and typed[-1 - end] == meant[-1 - end]:
        end += 1
    end = max(0, end - 2)
    typed, meant = typed[lo : len(typed) - end], meant[lo : len(meant) - end]
    n, far = len(meant), 99.0
    before: list[float] = []
    row = [1.1 * j if j <= width else far for j in range(n + 1)]
    for i, a in enumerate(typed, 1):
        new = [far] * (n + 1)
        if i <= width:
            new[0] = 1.1 * i
        for j in range(max(1, i - width), min(n, i + width) + 1):
            b = meant[j - 1]
            best = row[j - 1] + (0.0 if a == b else 1.0 if adjacent(a, b) or (a in "lio" and b in "lio") else 1.9)
            extra = row[j] + (0.8 if i > 1 and a == typed[i - 2] or a == b else 1.1)
            lost = new[j - 1] + (0.8 if j > 1 and b == meant[j - 2] else 1.0)
            if extra < best:
                best = extra
            if lost < best:
                best = lost
            if i > 1 and j > 1 and a == meant[j - 2] and typed[i - 2] == b and before[j - 2] + 0.9 < best:
                best = before[j - 2] + 0.9
            new[j] = best
        before, row = row, new
        if min(row) > limit and min(before) > limit:
            return far
    return row[-1]


def abbreviates(t: str, w: str) -> bool:
    """A beginning of the word, its first letter and its end, or its first letter and some others, mostly consonants."""
    if len(t) < 2 or len(t) >= len(w) or t[0] != w[0]:
        return False
    if w.startswith(t) or len(t) >= 4 and w.endswith(t[1:]):
        return True
    it = iter(w)
    if not all(c in it for c in re.sub(r"(.)\1", r"\1", t)):
        return False
    return len(t) <= 6 and sum(c in "aeiou" for c in t[1:]) <= 1


def mistyped(t: str, w: str) -> float:
    """Cost of ``t`` as a slip for the trade word ``w``, 99 where it is none; words of other letters are not compared."""
    limit = 1.2 if len(w) < 6 else 2.2
    if abs(len(t) - len(w)) > 2 or len(set(w) - set(t)) > 2 or len(set(t) - set(w)) > 2:
        return 99.0
    c = slips(t, w, limit)
    return c if c <= limit else 99.0


class Words:
    """Words of the trade (those that follow many different first words) and what they are typed as.

    ``learnt`` has, for a typed word, the cost of every trade word it was found to stand for. Split, abbreviated and
    mistyped words are read by rule beside it.
    """

    def __init__(self, words: list[str], learnt: dict[str, dict[str, float]] | None = None):
        self.words = set(words)
        self.ordered = sorted(words)
        self.long = sorted((w for w in words if len(w) >= 4), key=len, reverse=True)
        self.learnt = learnt or {}
        self.memo: dict[str, bool] = {}
        self.costs: dict[tuple[str, str], float] = {}

    def like(self, t: str) -> bool:
        if t in self.words or t in self.learnt:
            return True
        if t not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[t] = len(t) <= 6 and any(abbreviates(t, w) for w in self.words) or len(t) >= 4 and any(mistyped(t, w) < 99 for w in self.long)
        return self.memo[t]

    def unglue(self, t: str) -> list[str]:
        if len(t) < 10 or len(t) > 60 or self.like(t):
            return [t]
        for w in self.long:
            if t.endswith(w) and len(t) - len(w) >= 4:
                return [*self.unglue(t[: -len(w)]), w]
            if t.startswith(w) and len(t) - len(w) >= 4:
                return [w, *self.unglue(t[len(w) :])]
        return [t]

    def cost(self, t: str, w: str) -> float:
        """Cost of typing ``t`` for the trade word ``w``, 99 where it is no form of it."""
        if t == w:
            return 0.0
        at = (t, w)
        if at not in self.costs:
            if len(self.costs) > 200_000:
                self.costs.clear()
            c = 0.4 if abbreviates(t, w) else mistyped(t, w)
            rule = c if c in (0.4, 99.0) else 0.75 * c
            self.costs[at] = min(rule, self.learnt.get(t, {}).get(w, 99.0))
        return self.costs[at]

    def corrected(self, line: Iterable[str]) -> tuple[str, ...]:
        """The words of the trade that were probably meant, one by one."""
        return tuple(sorted(min((self.cost(t, w), w) for w in self.ordered)[1] for t in line if t != "and"))


def name_tokens(raw: str) -> list[str]:
    """Words and numbers of a typed name, folded to ASCII and lower case; contractions and dotted initials are one word."""
    s = fold_ascii(raw) or ""
    s = re.sub(r"(?i)\bm/s\b\.?", " ", s)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s).lower().replace("&", " and ")
    s = re.sub(r"\((?:formerly|name as per)[^)]*\)?", " ", s)
    s = re.sub(r"\(p\)", " private ", s)
    s = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m[0].replace(".", "") + " ", s)
    s = re.sub(r"(?<=[a-z])[-'](?=[a-z])|(?<=\b[a-z])/(?=[a-z]{3})", "", s)
    tokens = re.findall(r"[a-z0-9]+", s)
    return [t.translate(_DIGITS) if re.search(r"[a-z]", t) and re.search(r"[0-9]", t) else t for t in tokens]


_DIGITS = str.maketrans("01345", "olees")


def _prefix(t: str, words: Words) -> str | None:
    """The prefix a word stands for, slips in the longer ones included."""
    if t in PREFIXES:
        return t
    if 4 <= len(t) <= 7 and not words.like(t):
        return next((p for p in sorted(PREFIXES) if len(p) >= 5 and slips(t, p, 1.2) <= 1.2), None)
    return None


def read_name(raw: str | None, words: Words, bare: bool = False) -> dict | None:
    """{brand, line (words of the trade), initials, prefix}; None where nothing identifies anyone.

    With ``bare``, names of nothing but words of the trade have the empty brand.
    """
    if raw is None:
        return None
    tokens = [part for t in name_tokens(raw) for part in words.unglue(t)]
    kept = []
    for i, t in enumerate(tokens):
        # a lone p is the legal form's unless it stands first or among initials
        spelled = t == "p" and (i == 0 or i + 1 < len(tokens) and len(tokens[i + 1]) == 1 and tokens[i + 1] != "l")
        if t in COURTESY or t in LEGAL and not spelled:
            continue
        if len(t) >= 6 and t not in words.words and (slips(t, "limited", 1.2) <= 1.2 or slips(t, "private", 1.2) <= 1.2):
            continue
        kept.append(t)
    while kept and kept[-1] == "and":
        kept.pop()
    prefix = []
    while len(kept) > 1 and (p := _prefix(kept[0], words)) and not (len(kept[0]) == 1 and len(kept[1]) == 1) and not (p != kept[0] and words.like(kept[1])):
        prefix.append(p)
        kept.pop(0)
    single = "".join(t for t in kept if len(t) == 1)
    merged: list[str] = []
    for t in kept:
        if len(t) == 1:
            if single:
                merged.append(single)
                single = ""
        elif t == "india":
            prefix.append(t)
        else:
            merged.append(t)
    brand, line, short = [], [], []
    for t in merged:
        if t == "and":
            line.append(t)
        elif words.like(t):
            line.append(t)
        elif len(t) <= 5 and not re.search(r"[aeiou][^aeiou][aeiou]|^[^aeiou][aeiou][^aeiou][aeiou]", t):
            short.append(t)
        else:
            brand.append(t)
    if not brand and short:
        brand, short = [short[0]], short[1:]
    if not brand and not (bare and line):
        return None
    if len(brand) > 1 and short and len("".join(brand)) < 7:
        brand += short
        short = []
    return {"brand": "".join(brand), "line": line, "initials": short[0] if short else "", "prefix": " ".join(sorted(set(prefix)))}


def line_cost(line: list[str], initials: str, meant: list[str], words: Words, whole: bool = False) -> float:
    """Cost of the words of the trade as typed, given those meant; ``whole``: as typed they name another trade in full.

    One word may be dropped, unless what is left is a trade of its own: then it is a sister company.
    """
    core = [w for w in meant if w != "and"]
    firsts = {"".join(w[0] for w in meant), "".join(w[0] for w in core)}
    real = [t for t in line if t != "and"]
    options = [99.0]
    if initials and not real:
        ends = ("", "l", "pl")
        if any(initials == f + e for f in firsts for e in ends if f):
            options.append(0.9)
    if len(real) == 1 and len(real[0]) <= 5 and any(real[0] == f + e for f in firsts for e in ("", "l", "pl") if len(f) > 1 or f and e):
        options.append(1.1)
    if not real and not initials:
        # the brand alone: its only company is meant, if it has but one (else the posterior stays low)
        options.append(2.0 if core else 0.0)
    if real and not initials:
        left = list(enumerate(core))
        total, at, order = 0.0, -1, False
        for t in real:
            best = min(((words.cost(t, w), i) for i, w in left), default=(99.0, -1))
            if best[0] > 90:
                total += 3.0
                continue
            total += best[0]
            order |= best[1] < at
            at = best[1]
            left = [x for x in left if x[0] != best[1]]
        total += sum(4.0 if whole else 1.8 for _ in left)
        if ("and" in line) != ("and" in meant):
            total += 0.2
        options.append(total + (0.4 if order else 0.0))
    return min(options)


def brand_limit(meant: str) -> float:
    return MAX_BRAND if len(meant) >= SHORT_BRAND else 1.2


def brand_cost(typed: str, meant: str) -> float:
    """Cost of a brand as typed; 99 where it is beyond :func:`brand_limit`."""
    if typed == meant:
        return 0.0
    limit = brand_limit(meant)
    a, b = phonetic(typed), phonetic(meant)
    cost = 0.5 if a == b else min(slips(typed, meant, limit), 0.4 + slips(a, b, limit))
    return cost if cost <= limit else 99.0


READ_TYPE = T.StructType().add("brand", "string").add("line", T.ArrayType(T.StringType())).add("initials", "string").add("prefix", "string")


def read_names(df: DataFrame, keys: list[str], name: str, words: Words, bare: bool = False) -> DataFrame:
    """``keys`` plus the parts of :func:`read_name`; names that identify no one are left out."""

    @F.pandas_udf(READ_TYPE)
    def read(s: pd.Series) -> pd.DataFrame:
        empty = {"brand": None, "line": None, "initials": None, "prefix": None}
        return pd.DataFrame([read_name(x, words, bare) or empty for x in s], columns=READ_TYPE.names)

    return df.select(*keys, read(name).alias("r")).select(*keys, "r.*").where("brand is not null")


def trade_words(names: DataFrame, name: str) -> list[str]:
    """Words that come after at least a share WORD_HEADS of all first words (so at most len/WORD_HEADS, some hundreds)."""
    tokens = F.split(F.lower(F.regexp_replace(name, "[^A-Za-z]+", " ")), " ")
    skipped = F.array(*[F.lit(w) for w in sorted(PREFIXES)])
    split = cut(names.select(F.array_except(F.filter(tokens, lambda t: t != ""), skipped).alias("t")).where("size(t) > 1"))
    heads = split.select(F.col("t")[0]).distinct().count()
    after = split.select(F.col("t")[0].alias("head"), F.explode(F.slice("t", F.lit(2), F.size("t"))).alias("w"))
    spread_out = after.groupBy("w").agg(F.countDistinct("head").alias("n")).where(F.col("n") >= max(3, WORD_HEADS * heads))
    stop = LEGAL | PREFIXES | {"formerly", "name", "as", "per", "mca"}
    return sorted(r.w for r in spread_out.collect() if r.w not in stop)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(s: pd.Series) -> pd.Series:
    return pd.Series([[t for t in name_tokens(x) if t not in LEGAL and t not in COURTESY] if x else [] for x in s], dtype=object)


def estimate_words(typed: DataFrame, listed: DataFrame, words: list[str]) -> dict[str, dict[str, float]]:
    """Channel of the trade words, {typed: {meant: cost}}, from names typed (column ``name``) and listed (``form``).

    A typed name and a listed one that are equal but for one word behind the first, which the list knows as a trade word
    and which is none as typed, show what the word is typed as. They meet on a hash of the rest, so nothing is compared
    with everything. Each pair counts once a brand; P(typed | meant) is its share of all the brands under which the word
    was typed. Only pairs of LEARN_HEADS brands and LEARN_SHARE of all findings reach the driver: at most 5,000.
    """
    listed = listed.select("form").where("form is not null").distinct().select(_tokens("form").alias("t")).where("size(t) > 1")
    longest = listed.agg(F.max(F.size("t"))).first()[0] or 0
    typed = typed.select("name").where("name is not null").distinct().select(_tokens("name").alias("t")).where((F.size("t") > 1) & (F.size("t") <= longest))

    def patterns(df: DataFrame, word: str) -> DataFrame:
        at = df.select("t", F.posexplode("t").alias("i", word)).where("i > 0")
        rest = F.xxhash64("i", F.slice("t", F.lit(1), F.col("i")), F.slice("t", F.col("i") + 2, F.size("t")))
        return at.select(rest.alias("rest"), F.col("t")[0].alias("head"), word).distinct()

    known = patterns(listed, "meant").where(F.col("meant").isin(words)).drop("head")
    met = patterns(typed, "typed").join(known, "rest")
    met = met.where((F.col("typed") == F.col("meant")) | ~F.col("typed").isin(words))
    counts = cut(met.groupBy("typed", "meant").agg(F.countDistinct("head").alias("n")))
    totals = {r.meant: r.n for r in counts.groupBy("meant").agg(F.sum("n").alias("n")).collect()}  # one row per trade word
    least = max(LEARN_HEADS, LEARN_SHARE * sum(totals.values()))
    out: dict[str, dict[str, float]] = {}
    for r in counts.where((F.col("typed") != F.col("meant")) & (F.col("n") >= least)).collect():
        cost = -math.log(r.n / totals[r.meant]) / SCALE
        if len(r.typed) > 1 and cost <= MAX_LINE:
            out.setdefault(r.typed, {})[r.meant] = cost
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _indexed(s: pd.Series) -> pd.Series:
    return pd.Series([sorted({"=" + phonetic(x)}.union(*(index_keys(y, 2 if len(y) >= SHORT_BRAND else 1) for y in (x, phonetic(x))))) for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _searched(s: pd.Series) -> pd.Series:
    return pd.Series([sorted({"=" + phonetic(x)}.union(*(query_keys(y, 2) for y in (x, phonetic(x))))) for x in s], dtype=object)


@F.pandas_udf(T.DoubleType())
def _brand_cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([brand_cost(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def whole_lines(readings: DataFrame, listed: DataFrame, words: Words) -> DataFrame:
    """``readings`` plus ``whole``: whether the line as typed is a trade of at least 3 brands in full.

    Distinct lines are corrected once each and joined to the distinct trades.
    """
    trades = listed.select("brand", F.array_sort(F.filter("meant", lambda w: w != "and")).alias("t")).where("size(t) > 0").groupBy("t").agg(F.countDistinct("brand").alias("brands")).where("brands >= 3")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def meant(s: pd.Series) -> pd.Series:
        return pd.Series([list(words.corrected(x)) if len(x) and "and" not in (x[0], x[-1]) else [] for x in s], dtype=object)

    lines = cut(readings.groupBy(F.array_join("line", " ").alias("_line")).agg(F.first("line").alias("line")).where("size(line) > 0"))
    known = lines.select("_line", meant("line").alias("t")).join(trades.select("t", F.lit(True).alias("whole")), "t").select("_line", "whole")
    return readings.withColumn("_line", F.array_join("line", " ")).join(known, "_line", "left").withColumn("whole", F.coalesce("whole", F.lit(False))).drop("_line")


def line_costs(words: Words):
    """UDF (line, initials, meant, whole) -> cost."""

    @F.pandas_udf(T.DoubleType())
    def cost(line: pd.Series, initials: pd.Series, meant: pd.Series, whole: pd.Series) -> pd.Series:
        costs: dict[tuple, float] = {}
        out = []
        for a, b, c, w in zip(line, initials, meant, whole, strict=True):
            at = (tuple(a), b, tuple(c), w)
            if at not in costs:
                costs[at] = line_cost(list(a), b or "", list(c), words, w)
            out.append(costs[at])
        return pd.Series(out, dtype="float64")

    return cost


def near_brands(brands: DataFrame, known: DataFrame) -> DataFrame:
    """(brand, listed) that share a key. A brand has some hundred keys, which Spark's sizes don't know: never broadcast."""
    keyed = known.select("listed", F.explode(_indexed("listed")).alias("k"))
    wanted = brands.select("brand", F.explode(_searched("brand")).alias("k"))
    return wanted.hint("merge").join(keyed.hint("merge"), "k").select("brand", "listed").distinct()


def brand_links(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """(brand, listed, brand_cost): for each typed brand every listed one it may stand for, itself included.

    Works on distinct brands, so a brand that a third of all rows share is one row here. Keys are near-complete spellings
    (or fifths of very long ones), so a bucket holds the spellings around one string, not rows.
    """
    brands, n_brands = cut(typed.select("brand").distinct(), n=F.count(F.lit(1)))
    known, n_known = cut(listed.select(F.col("brand").alias("listed")).distinct(), n=F.count(F.lit(1)))
    near, seen = cut(near_brands(workers(brands, n_brands.n, "brand", 10_000), workers(known, n_known.n, "listed", 10_000)), n=F.count(F.lit(1)))
    return cut(workers(near, seen.n, "brand").withColumn("brand_cost", _brand_cost("brand", "listed")).where("brand_cost < 99"))


def channel(typed: DataFrame, listed: DataFrame) -> Words:
    """Trade words of the listed names (``form``) and how the typed ones (``name``) spell them."""
    words = trade_words(listed, "form")
    return Words(words, estimate_words(typed, listed, words))


def reading_key() -> Column:
    """One text per reading; tokens have no blanks and no signs."""
    return F.concat_ws("|", "brand", F.array_join("line", " "), "initials", "prefix")


def attribute(claims: DataFrame, key: str, name: str, forms: DataFrame, company: str, form: str) -> DataFrame:
    """(key, company, cost, posterior): each name attached to the listed company of maximum posterior, if likely enough.

    ``forms`` has one row per listed name (current or former) and company. Null, blank and meaningless names and names
    of unlisted companies give no row; repeated names are attached alike; ties go to the form typed more often, then to
    the smaller company key. Posterior is relative to the other candidates of the row and to a name not on the list;
    companies listed under one and the same name share it.
    """
    one = F.count(F.lit(1))
    forms, n_forms = cut(forms.select(company, F.col(form).alias("form")).distinct(), n=one)
    typed, n_typed = cut(claims.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")), n=one)
    words = channel(typed, forms)
    listed = read_names(workers(forms, n_forms.n, "form"), [company], "form", words)
    same = listed.groupBy("brand", F.col("line").alias("meant"), F.col("prefix").alias("meant_prefix")).agg(F.countDistinct(company).alias("holders"), F.min(company).alias("holder"))
    same = cut(same)
    # names are read once each and readings attached once each, however often they occur
    variants = cut(read_names(workers(typed, n_typed.n, "name"), ["name", "n"], "name", words).withColumn("reading", reading_key()))
    readings = cut(whole_lines(variants.groupBy("reading").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in READ_TYPE.names]), same, words))
    links = brand_links(readings, same)
    hot_brands = fans(readings.groupBy("brand").agg(F.count("*").alias("n")), "brand", limit=10_000)
    by_brand = salt(readings, hot_brands, "brand", F.col("reading")).join(spread(links, hot_brands, "brand"), ["brand", "_salt"]).drop("_salt")
    meant = same.select(F.col("brand").alias("listed"), "meant", "meant_prefix", "holders", "holder")
    hot_listed = fans(by_brand.groupBy("listed").agg(F.count("*").alias("n")), "listed", limit=10_000)
    pairs, seen = cut(salt(by_brand, hot_listed, "listed", F.col("reading")).join(spread(meant, hot_listed, "listed"), ["listed", "_salt"]).drop("_salt"), n=F.count(F.lit(1)))
    scored = (
        workers(pairs, seen.n, "reading")
        .withColumn("line_cost", line_costs(words)("line", "initials", "meant", "whole"))
        .withColumn("cost", F.col("brand_cost") + F.col("line_cost") + F.when(F.col("prefix") == F.col("meant_prefix"), 0.0).otherwise(0.3))
        .where((F.col("line_cost") <= MAX_LINE) & (F.col("cost") <= MAX_TOTAL))
    )
    candidates = cut(scored.groupBy("reading", "holder", "holders").agg(F.min("cost").alias("cost"), F.first("n").alias("n")))
    prior = candidates.where("cost = 0 and holders = 1").groupBy("holder").agg(F.sum("n").alias("typed"))
    weighed = candidates.join(prior, "holder", "left").withColumn("logp", -SCALE * F.col("cost") + 0.3 * F.log1p(F.coalesce("typed", F.lit(0))))
    best = weighed.groupBy("reading").agg(
        F.max_by(F.struct("holder", "cost", "logp"), F.struct("logp", -F.col("holder"))).alias("b"), F.sum(F.col("holders") * F.exp("logp")).alias("all")
    )
    unlisted = F.lit(math.exp(-SCALE * MAX_TOTAL))
    chosen = best.select("reading", F.col("b.holder").alias(company), "b.cost", (F.exp("b.logp") / (F.col("all") + unlisted)).alias("posterior"))
    by_name = variants.join(chosen.where(F.col("posterior") >= MIN_POSTERIOR), "reading").select("name", company, "cost", "posterior")
    hot_names = fans(typed, "name")
    return skew_join(claims.select(key, F.col(name).alias("name")), by_name, "name", F.col(key), hot_names).select(key, company, "cost", "posterior")


def link_claims(claims: DataFrame, current: DataFrame) -> DataFrame:
    """Claims attached to the companies of the current list, under their present or a former name."""
    forms = current.select("source_row_number", F.explode(F.concat(F.array("name_core"), F.coalesce("alternate_names", F.array().cast("array<string>")))).alias("form")).where("form is not null")
    return attribute(claims, "claim_id", "claimed_name", forms, "source_row_number", "form")
