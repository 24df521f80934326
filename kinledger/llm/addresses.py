"""Same postal address written differently: a gazetteer of streets built from the addresses themselves.

1. Words that stand behind many different words are type words; what each stands for (road, colony, house ...) follows
   from its spelling, so that abbreviations are learnt and not listed.
2. Every address is taken apart (plot number, street, locality, building, unit, town, code) whatever the order of its parts.
3. Street spellings are counted within their town and locality; rare spellings are clustered to frequent ones (noisy
   channel: frequency, share of the town, edit distance) and every (town, street, type) gets an identifier.
4. Each address is resolved by a beam search over gazetteer entries: hypotheses for the town are extended by streets, the
   best BEAM of them by what other addresses say of the plot, the locality and the building there; then the best counts.
5. Addresses of one identifier and plot number denote the same premises; unit and floor are kept but don't decide.

From step 3 on the work is on distinct readings, with the number of rows behind them, so that a street or a house of a
third of all rows is one reading per spelling.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.llm.names import abbreviates
from kinledger.llm.skew import fans, salt, skew_join, spread, workers
from kinledger.llm.strings import index_keys, osa, query_keys
from kinledger.runtime import cut

BEAM = 8
#: A type word stands behind at least so many different words, and behind this share of all words.
TYPE_HEADS, TYPE_SHARE = 4, 0.001

# Kinds of streets, localities and buildings in full.
TYPES = {
    "street": ["road", "marg", "lane", "street"],
    "locality": ["nagar", "colony", "layout", "enclave", "extension", "market", "vihar"],
    "building": ["house", "plaza", "towers", "chambers", "mansion", "heights", "court", "complex", "centre", "estate", "arcade", "bhavan"],
}
NEARBY = ["near", "nr", "opp", "opposite", "behind", "beside", "next to"]
LANDMARK = re.compile(rf"\b(?:{'|'.join(NEARBY)})\b\.? *[a-z]+ +[a-z]+")
FLOOR = re.compile(r"\b(?:\d+(?:st|nd|rd|th)?|[ivx]+|ground) *([a-z]{2,7})\b\.?")
UNIT = re.compile(r"\b(?:unit|suite|office no|office|shop no|shop|flat no|flat|room no|room)\b\.? *(?:no\b\.? *)?([0-9]+[a-z]?(?:-[a-z0-9]+)?)\b")
PIN = re.compile(r"(?:\bpin(?:code)?\b[ .:-]*|- *)?(?<![0-9/])([1-9][0-9]{2}) ?([0-9]{3})(?![0-9/])")
NUMBER = r"(?:#|\bplot no\b\.?|\bplot\b|\bd\.? ?no\b\.?|\bdoor no\b\.?|\bno\b\.?)? *(?<![0-9a-z/])([0-9]+[a-z]?(?:/[0-9]+[a-z]?)?)(?![0-9a-z/])"
STREET_LOOSE = re.compile(NUMBER + r"[ ,;|-]+([a-z]+) +([a-z]{2,7})\b\.?")
NUMBER_ONLY = re.compile(NUMBER)


def is_floor(word: str) -> bool:
    return osa(word, "floor", 1) <= 1 or abbreviates(word, "floor")


class Types:
    """What a type word stands for: the words learnt, beside them abbreviations and slips of the full ones, word by word."""

    def __init__(self, words: list[str]):
        self.known: dict[str, tuple[str, str]] = {w: (kind, w) for kind, ws in TYPES.items() for w in ws}
        self.memo: dict[str, tuple[str, str] | None] = {}
        for t in words:
            best = self.read(t)
            if best:
                self.known.setdefault(t, best)
        streets = sorted((t for t, (kind, _) in self.known.items() if kind == "street"), key=len, reverse=True)
        short = "|".join(map(re.escape, streets))
        self.street = re.compile(NUMBER + r"[ ,;|-]+([a-z]+) +(" + short + r")\b\.?")
        self.street_only = re.compile(r"\b([a-z]{3,}) +(" + short + r")\b\.?")

    @staticmethod
    def _cost(t: str, w: str) -> float:
        if t == w:
            return 0.0
        if len(t) >= (4 if len(w) >= 5 else 3) and osa(t, w, 1) <= 1:
            return 1.0
        return 1.5 - 0.01 * len(t) + (0.0 if w.startswith(t) else 0.2) if abbreviates(t, w) else 9.0

    def read(self, word: str) -> tuple[str, str] | None:
        """(kind, full word) a word is nearest to by its spelling, None for words like none of them."""
        if word in self.known:
            return self.known[word]
        if word not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            bare = word.replace("/", "").replace(".", "")
            best = None if bare in NEARBY else min(((c, kind, w) for kind, ws in TYPES.items() for w in ws if (c := self._cost(bare, w)) < 9), default=None)
            self.memo[word] = best and best[1:]
        return self.memo[word]

    def street_type(self, word: str) -> str | None:
        found = self.read(word)
        return found[1] if found and found[0] == "street" else None

    def is_type(self, word: str, kind: str) -> bool:
        found = self.read(word)
        return found is not None and found[0] == kind


def type_words(rows: DataFrame, address: str) -> list[str]:
    """Words behind many different words, counted over all addresses: at most their average length / TYPE_SHARE."""
    words = F.regexp_extract_all(F.lower(address), F.lit("[a-z]+(?:/[a-z]+)?"), F.lit(0))
    pairs = rows.where(F.col(address).isNotNull()).select(words.alias("w")).where("size(w) > 1").select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("head"), F.slice("w", F.lit(2), F.size("w")).alias("word"))).alias("p"))
    distinct = cut(pairs.select("p.head", "p.word").distinct())
    heads = distinct.select("head").distinct().count()
    many = distinct.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(TYPE_HEADS, TYPE_SHARE * heads))
    return sorted(r.word for r in many.collect())


class Towns:
    """The town reference (a fixed table of towns, not of addresses): names, former names, codes, states."""

    def __init__(self, rows: list[dict]):
        self.names: dict[str, list[int]] = {}
        self.by_pin: dict[str, list[int]] = {}
        self.states: set[str] = set()
        self.by_state: dict[str, list[int]] = {}
        for r in rows:
            for n in (r["town"], r["former_town"]):
                if n:
                    self.names.setdefault(n.lower(), []).append(r["town_id"])
            if r["pin_prefix"] is not None:
                self.by_pin.setdefault(str(r["pin_prefix"]), []).append(r["town_id"])
            for s in (r["state_name"], r["state_code"]):
                if s:
                    self.states.add(s.lower())
                    self.by_state.setdefault(s.lower(), []).append(r["town_id"])

    def read(self, text: str) -> tuple[list[tuple[int, float]], set[int]]:
        """(towns named in the rest of an address with penalties, towns of the states named)."""
        words = re.findall(r"[a-z]+", text)
        found: dict[int, float] = {}
        of_state: set[int] = set()
        used: set[int] = set()
        for n in (2, 1):
            for i in range(len(words) - n + 1):
                s = " ".join(words[i : i + n])
                if s in self.states and not used & set(range(i, i + n)):
                    used |= set(range(i, i + n))
                    of_state |= set(self.by_state[s])
        for n in (2, 1):
            for i in range(len(words) - n + 1):
                if used & set(range(i, i + n)):
                    continue
                s = " ".join(words[i : i + n])
                for variant in (s, s.replace(" ", "")) if n == 2 else (s,):
                    for name, ids in self.names.items():
                        limit = 2 if len(name) >= 7 else 1
                        d = osa(variant, name, limit)
                        if d <= limit:
                            for t in ids:
                                found[t] = min(found.get(t, 9.0), float(d))
        return sorted(found.items(), key=lambda x: x[1]), of_state


def take_apart(address: str | None, towns: Towns, types: Types) -> dict | None:
    """Parts of an address; None for null, blank and unreadable ones."""
    if not address or not address.strip():
        return None
    s = re.sub(r"\s+", " ", re.sub(r"[\n\r|]", " , ", address.lower())).strip()
    unit = UNIT.search(s)
    s = FLOOR.sub(lambda m: " , " if is_floor(m[1]) else m[0], UNIT.sub(" , ", LANDMARK.sub(" , ", s)))
    pin = None
    for m in PIN.finditer(s):
        pin = m[1] + m[2]
        s = s[: m.start()] + " , " + s[m.end() :]
        break
    number = name = kind = None
    m = types.street.search(s)
    if m:
        number, name, kind = m[1], m[2], types.street_type(m[3])
        s = s[: m.start()] + " , " + s[m.end() :]
    else:
        for m in STREET_LOOSE.finditer(s):
            if types.street_type(m[3]):
                number, name, kind = m[1], m[2], types.street_type(m[3])
                s = s[: m.start()] + " , " + s[m.end() :]
                break
        else:
            m = types.street_only.search(s)
            if m:
                name, kind = m[1], types.street_type(m[2])
                s = s[: m.start()] + " , " + s[m.end() :]
            n = NUMBER_ONLY.search(s)
            if n:
                number = n[1]
                s = s[: n.start()] + " , " + s[n.end() :]
    s = re.sub(r"\bind(?:ustrial|l|\.)? area\b|\bind\. area\b", "i.a", re.sub(r"\bi\. ?a\b\.?", "i.a", s))
    words = [w for w in re.findall(r"[a-z./]+|[,;-]", s)]
    locality = building = None
    rest: list[str] = []
    for w in words:
        bare = w.strip(".")
        if rest and rest[-1] not in ",;-" and (types.is_type(bare, "locality") or bare in ("area", "i.a")):
            if bare == "area" and len(rest) > 1:
                rest.pop()
            locality = rest.pop() if rest and rest[-1] not in ",;-" else locality
            rest.append(",")
        elif rest and rest[-1] not in ",;-" and types.is_type(bare, "building"):
            building = rest.pop()
            rest.append(",")
        else:
            rest.append(bare if bare else w)
    named, of_state = towns.read(" ".join(rest))
    return {"number": number.upper() if number else None, "street": name, "kind": kind, "pin": pin, "locality": locality, "building": building, "unit": unit[1] if unit else None, "named": named, "of_state": of_state}


PARTS_TYPE = (
    T.StructType()
    .add("number", "string")
    .add("street", "string")
    .add("kind", "string")
    .add("pin", "string")
    .add("locality", "string")
    .add("building", "string")
    .add("unit", "string")
    .add("towns", T.ArrayType(T.StructType().add("town_id", "integer").add("penalty", "double")))
)


def town_hypotheses(p: dict, towns: Towns) -> list[tuple[int, float]]:
    """Towns an address may lie in, best first: postal code, name and state each add to the score.

    None is cut: the reference has a fixed number of towns, and where only a state is readable all of its towns tie.
    """
    score: dict[int, float] = {}
    for t, d in p["named"]:
        score[t] = 2.0 - d
    for t in towns.by_pin.get(p["pin"][:3], []) if p["pin"] else []:
        score[t] = score.get(t, 0.0) + 3.0
    if not score:
        for t in p["of_state"]:
            score[t] = 0.0
    elif p["of_state"]:
        for t in score:
            score[t] += 0.5 if t in p["of_state"] else -0.5
    best = max(score.values(), default=0.0)
    ranked = sorted(((t, best - v) for t, v in score.items()), key=lambda x: (x[1], x[0]))
    return [x for x in ranked if x[1] <= 2.5]


def parts(rows: DataFrame, key: str, address: str, town_rows: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(key, r_id; readings: r_id, n, parts of :func:`take_apart`): every address taken apart, each text once."""
    towns = Towns(town_rows)
    rows = cut(rows)
    texts, seen = cut(rows.where(F.col(address).isNotNull()).groupBy(F.col(address).alias("text")).agg(F.count("*").alias("rows")), n=F.count(F.lit(1)))
    # a reading of floor numbers or of the reference's own names is no type word
    places = {w for r in town_rows for c in ("town", "former_town", "state_name", "state_code") if r[c] for w in r[c].lower().split()}
    types = Types([w for w in type_words(texts, "text") if w not in places and w not in NEARBY and not re.fullmatch("[ivx]+", w)])

    @F.pandas_udf(PARTS_TYPE)
    def apart(s: pd.Series) -> pd.DataFrame:
        out = []
        for a in s:
            p = take_apart(a, towns, types)
            row = dict.fromkeys(PARTS_TYPE.names) | {"towns": []}
            if p:
                row = {k: p[k] for k in PARTS_TYPE.names[:-1]} | {"towns": [{"town_id": t, "penalty": d} for t, d in town_hypotheses(p, towns)]}
            out.append(row)
        return pd.DataFrame(out, columns=PARTS_TYPE.names)

    names = [n for n in PARTS_TYPE.names if n != "unit"]
    read = workers(texts, seen.n, "text").select("text", "rows", apart("text").alias("p")).select("text", "rows", "p.*")
    whole = F.concat_ws("|", *[F.coalesce(F.col(n), F.lit("?")) for n in names[:-1]], F.array_join(F.transform("towns", lambda t: F.concat_ws(":", t["town_id"], t["penalty"])), ","))
    read = cut(read.withColumn("r_id", F.md5(whole)))
    readings = cut(read.groupBy("r_id").agg(F.sum("rows").alias("n"), *[F.first(n).alias(n) for n in names]))
    placed = skew_join(rows.select(key, F.col(address).alias("text")), read.select("text", "r_id"), "text", F.col(key), fans(read, "text", n="rows"))
    return cut(placed.select(key, "r_id")), readings


KEYS_TYPE = T.ArrayType(T.StringType())


def _edits(s: str) -> int:
    return 2 if len(s) >= 6 else 1


@F.pandas_udf(KEYS_TYPE)
def _indexed(s: pd.Series) -> pd.Series:
    """Keys under which a spelling is found by any within two edits (one for short ones)."""
    return pd.Series([sorted(index_keys(x, _edits(x))) if x else [] for x in s], dtype=object)


@F.pandas_udf(KEYS_TYPE)
def _searched(s: pd.Series) -> pd.Series:
    return pd.Series([sorted(query_keys(x, _edits(x))) if x else [] for x in s], dtype=object)


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, 2) for x, y in zip(a, b, strict=True)], dtype="int32")


def spelling_candidates(counts: DataFrame, spelling: str, within: list[str]) -> DataFrame:
    """(within, s, c, n_c, d): for each spelling those at least as frequent within two edits, itself included.

    ``counts`` has (within, spelling, n). Candidates meet on keys of near-complete spellings, so nothing is compared with
    everything, and a bucket holds spellings, not addresses.
    """
    base = counts.select(*within, F.col(spelling).alias("s"), "n")
    asked = base.select(*within, "s", "n", F.explode(_searched("s")).alias("k"))
    others = base.select(*within, F.col("s").alias("c"), F.col("n").alias("n_c"), F.explode(_indexed("s")).alias("k"))
    near = asked.join(others, [*within, "k"]).where("s = c or n_c > n or (n_c = n and c < s)").select(*within, "s", "c", "n_c").distinct()
    return near.withColumn("d", F.when(F.col("s") == F.col("c"), 0).otherwise(_distance("s", "c"))).where("d <= 2")


def _edit_penalty() -> Column:
    return F.element_at(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.5)), F.col("d") + 1)


def localities(readings: DataFrame) -> DataFrame:
    """(town_id, locality, area): each spelling of a locality in a town and the spelling it is taken for."""
    seen = readings.where("locality is not null").select("locality", "n", F.explode("towns.town_id").alias("town_id")).groupBy("town_id", "locality").agg(F.sum("n").alias("n"))
    near = spelling_candidates(cut(seen), "locality", ["town_id"])
    return near.groupBy("town_id", F.col("s").alias("locality")).agg(F.max_by("c", F.struct(F.log("n_c") - _edit_penalty(), F.col("c"))).alias("area"))


def street_gazetteer(hypotheses: DataFrame) -> DataFrame:
    """(town_id, area, s, street, score): what the spelling ``s`` in a locality of a town may stand for.

    Spellings are clustered over all towns (a slip is a slip everywhere); how often a street stands in the town, and in
    the locality, decides between its candidates. ``area`` is '' where an address names no locality.
    """
    in_area = cut(hypotheses.groupBy("town_id", "area", "s").agg(F.sum("n").alias("n_area")))
    in_town = cut(in_area.groupBy("town_id", "s").agg(F.sum("n_area").alias("n_town")))
    everywhere = cut(in_town.groupBy(F.col("s").alias("street")).agg(F.sum("n_town").alias("n")))
    near = cut(spelling_candidates(everywhere, "street", []))
    support = in_town.select("town_id", F.col("s").alias("c"), F.col("n_town").alias("c_town"))
    local = in_area.where("area <> ''").select("town_id", "area", F.col("s").alias("c"), F.col("n_area").alias("c_area"))
    weighed = in_area.select("town_id", "area", "s").join(near, "s").join(support, ["town_id", "c"], "left").join(local, ["town_id", "area", "c"], "left")
    known = lambda c: F.log1p(F.coalesce(c, F.lit(0)))
    score = F.log("n_c") + 1.5 * known("c_town") + 0.5 * known("c_area") - _edit_penalty()
    return weighed.select("town_id", "area", "s", F.col("c").alias("street"), score.alias("score"))


def beam(readings: DataFrame) -> DataFrame:
    """(r_id, town_id, premises): the best of BEAM hypotheses (town, street) of each reading with a plot number.

    Towns come with the reading; each is extended by the gazetteer's streets; the BEAM best go on and gain what other
    rows say: how many give this plot, and how many this building at it, under the candidate's own spelling.
    """
    towns = readings.where("street is not null").select("r_id", "n", "number", "kind", "building", "locality", F.col("street").alias("s"), F.explode("towns").alias("t"))
    towns = towns.select("r_id", "n", "number", F.coalesce("kind", F.lit("?")).alias("kind"), "building", "locality", "s", "t.town_id", "t.penalty")
    hypotheses = cut(towns.join(localities(readings), ["town_id", "locality"], "left").withColumn("area", F.coalesce("area", F.lit(""))).drop("locality"))
    numbered = hypotheses.where("number is not null")
    extended = numbered.join(street_gazetteer(hypotheses), ["town_id", "area", "s"]).withColumn("score", F.col("score") - 2 * F.col("penalty"))
    rank = F.row_number().over(Window.partitionBy("r_id").orderBy(F.desc("score"), "town_id", "street"))
    kept = extended.withColumn("rank", rank).where(F.col("rank") <= BEAM)
    at = [F.col("s").alias("street"), "town_id", "kind", "number"]
    plots = numbered.groupBy(*at).agg(F.sum("n").alias("n_plot"))
    houses = numbered.where("building is not null").groupBy(*at, "building").agg(F.sum("n").alias("n_house"))
    backed = kept.join(plots, ["street", "town_id", "kind", "number"], "left").join(houses, ["street", "town_id", "kind", "number", "building"], "left")
    # a reading's own rows are no evidence for it
    own = F.when(F.col("s") == F.col("street"), F.col("n")).otherwise(0)
    others = lambda c: F.log1p(F.greatest(F.coalesce(c, F.lit(0)) - own, F.lit(0)))
    total = F.col("score") + 2 * others(F.col("n_plot")) + others(F.col("n_house"))
    identifier = F.concat_ws("|", F.lit("s"), F.col("town_id"), F.col("street"), F.col("kind"), F.col("number"))
    best = backed.groupBy("r_id").agg(F.max_by(F.struct("town_id", identifier.alias("premises")), F.struct(total, -F.col("town_id"), F.col("street"))).alias("b"))
    return best.select("r_id", "b.town_id", "b.premises")


def by_building(readings: DataFrame, placed: DataFrame) -> DataFrame:
    """(r_id, premises) of readings that give a building but no plot: the plot where that building stands in the town.

    Every town the reading may lie in is tried. Without such a plot, readings meet on the best town's most frequent
    spelling of the building.
    """
    alone = cut(readings.where("(street is null or number is null) and building is not null and size(towns) > 0").select("r_id", "n", F.col("building").alias("s"), "locality", F.explode("towns").alias("t")).select("r_id", "n", "s", "locality", "t.town_id", "t.penalty"))
    stands = readings.where("building is not null").select("r_id", "n", "building", "locality").join(placed, "r_id")
    entries = stands.groupBy("town_id", "building", "premises").agg(F.sum("n").alias("n"), F.min("locality").alias("at"))
    counts = entries.select("town_id", "building", "n").union(alone.select("town_id", F.col("s").alias("building"), "n")).groupBy("town_id", "building").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    wanted = counts.join(alone.select("town_id", F.col("s").alias("building")).distinct(), ["town_id", "building"], "left_semi")
    asked = wanted.select("town_id", F.col("building").alias("s"), F.explode(_searched("building")).alias("k"))
    known = counts.select("town_id", F.col("building").alias("c"), F.col("n").alias("n_c"), F.explode(_indexed("building")).alias("k"))
    pairs = asked.join(known, ["town_id", "k"]).select("town_id", "s", "c", "n_c").distinct()
    near = cut(pairs.withColumn("d", F.when(F.col("s") == F.col("c"), 0).otherwise(_distance("s", "c"))).where("d <= 2"))
    found = alone.drop("n").join(near, ["town_id", "s"]).join(entries.select("town_id", F.col("building").alias("c"), "premises", "at", "n"), ["town_id", "c"])
    agrees = F.levenshtein("locality", "at") <= 3
    total = F.log1p("n") - 2 * F.col("d") - 2 * F.col("penalty") + F.when(agrees, 1.0).when(agrees.isNull(), 0.0).otherwise(-2.0)
    best = found.withColumn("total", total).where((F.col("d") <= 1) | agrees).groupBy("r_id").agg(F.max_by("premises", F.struct("total", "premises")).alias("premises"))
    spelled = near.groupBy("town_id", "s").agg(F.max_by("c", F.struct("n_c", "c")).alias("c"))
    first = alone.groupBy("r_id").agg(F.min_by(F.struct("town_id", "s"), F.struct("penalty", "town_id")).alias("f")).select("r_id", "f.*")
    own = first.join(spelled, ["town_id", "s"]).select("r_id", F.concat_ws("|", F.lit("b"), "town_id", "c").alias("own"))
    return own.join(best, "r_id", "left").select("r_id", F.coalesce("premises", "own").alias("premises"))


def premises(rows: DataFrame, key: str, address: str, town_rows: list[dict]) -> DataFrame:
    """(key, premises) of every address that can be placed; null, blank and unplaceable addresses give no row."""
    keyed, readings = parts(rows, key, address, town_rows)
    placed = cut(beam(readings))
    at = placed.select("r_id", "premises").unionByName(by_building(readings, placed))
    return skew_join(keyed, at, "r_id", F.col(key), fans(readings, "r_id"))


def same_premises(rows: DataFrame, key: str, address: str, town_rows: list[dict]) -> DataFrame:
    """(row_a, row_b), row_a < row_b, of all rows at one and the same premises.

    All pairs of a group are the result asked for; a hot group is salted on one side. :func:`premises_sizes` has one
    row per address instead.
    """
    at = cut(premises(rows, key, address, town_rows))
    hot = fans(at.groupBy("premises").agg(F.count("*").alias("n")), "premises", limit=PAIR_ROWS)
    a = salt(at.select("premises", F.col(key).alias("row_a")), hot, "premises", F.col("row_a"))
    b = spread(at.select("premises", F.col(key).alias("row_b")), hot, "premises")
    return a.join(b, ["premises", "_salt"]).where("row_a < row_b").select("row_a", "row_b").distinct()


#: Rows of one premises from which on its pairs are made by several tasks.
PAIR_ROWS = 10_000


def premises_sizes(rows: DataFrame, key: str, address: str, town_rows: list[dict]) -> DataFrame:
    """(key, premises, others): each placed address, its class and how many other addresses share it."""
    at = cut(premises(rows, key, address, town_rows))
    sizes = cut(at.groupBy("premises").agg(F.count("*").alias("n")))
    return skew_join(at, sizes, "premises", F.col(key), fans(sizes, "premises")).select(key, "premises", (F.col("n") - 1).alias("others"))
