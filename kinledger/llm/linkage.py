"""Matching entities across sources without keys: probabilistic record linkage.

Passes of blocking bring pairs together, present and former names alike: the brand as listed or within two edits of
letters or sound; then, within one office, the same trade with a brand that begins or ends alike, and the initials of a
whole name. Each attribute is compared to an agreement level, expectation-maximisation over the counts of level patterns
estimates how often matches and non-matches show each level, and the posterior of the best pair is the confidence. What
TESTDATA.md rules out (another office, another line of business) stays out whatever the posterior.

Pairs are formed between distinct readings of records and distinct entries of the list, with the numbers of rows behind
them, so that a brand of a third of all rows costs as many pairs as it has spellings times trades.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.functions.text import clean
from kinledger.llm.names import MAX_BRAND, Words, brand_cost, brand_links, channel, line_costs, phonetic, read_names, reading_key, whole_lines
from kinledger.llm.skew import fans, salt, skew_join, spread, workers
from kinledger.llm.strings import osa
from kinledger.runtime import cut

ACCEPT = 0.5
ROUNDS = 60
#: Agreement levels of each attribute; 'missing' proves nothing and takes no part in the estimate.
LEVELS = {
    "brand_level": ["same", "sounds", "near", "far"],
    "line_level": ["same", "close", "partial", "other"],
    "prefix_level": ["same", "other"],
    "office_level": ["same", "other", "missing"],
    "class_level": ["same", "other", "missing"],
}
#: Brand levels that only the further passes meet, and how often matches that the brand pass missed are taken to show
#: each: those pairs are nearly all non-matches, so that an estimate of their own would follow other differences.
FURTHER = {"far": 0.06, "loose": 0.46, "initials": 0.46, "other": 0.02}
# Older words for classes of companies.
CLASS_WORDS = {"loan company": "ICC", "investment company": "ICC", "asset finance company": "ICC"}


def office_reader(offices: list[dict]):
    """UDF to the office meant (the reference has a fixed, small number of offices); null where none can be told."""
    names = {}
    for r in offices:
        for n in (r["regional_office"], r["former_office"]):
            if n:
                names[n.lower()] = r["regional_office"]

    def read(x: str | None) -> str | None:
        if not x or not x.strip():
            return None
        s = " ".join(x.lower().split()).removesuffix(" ro").removesuffix(" regional office").strip(" .,")
        if s in names:
            return names[s]
        near = sorted((osa(s, n, 3), o) for n, o in names.items())
        return near[0][1] if near and near[0][0] <= min(3, max(1, len(s) // 3)) else None

    @F.pandas_udf(T.StringType())
    def office(s: pd.Series) -> pd.Series:
        memo = {x: read(x) for x in s.dropna().unique()}
        return s.map(lambda x: memo.get(x) if isinstance(x, str) else None).astype(object)

    return office


def class_meant(c: Column) -> Column:
    x = F.regexp_replace(F.upper(clean(c)), "^NBFC-|\\*$", "")
    for old, new in CLASS_WORDS.items():
        x = F.when(x == old.upper(), new).otherwise(x)
    return F.when(F.length(x) > 0, x)


def estimate(patterns: list[tuple[dict, int]], rounds: int = ROUNDS) -> tuple[dict, dict, float]:
    """(m, u, share of matches) by EM over pattern counts; a pattern names one level per attribute."""
    m = {a: {v: (0.85 if i == 0 else 0.15 / max(1, len(vs) - 1)) for i, v in enumerate(vs)} for a, vs in LEVELS.items()}
    u = {a: {v: (0.2 if i == 0 else 0.8 / max(1, len(vs) - 1)) for i, v in enumerate(vs)} for a, vs in LEVELS.items()}
    share = 0.3
    for _ in range(rounds):
        gm = {a: dict.fromkeys(vs, 0.02) for a, vs in LEVELS.items()}
        gu = {a: dict.fromkeys(vs, 0.5) for a, vs in LEVELS.items()}
        matched = total = 0.0
        for p, n in patterns:
            w = posterior(p, m, u, share)
            matched, total = matched + n * w, total + n
            for a in LEVELS:
                gm[a][p[a]] += n * w
                gu[a][p[a]] += n * (1 - w)
        share = min(max(matched / total, 1e-6), 1 - 1e-6) if total else share
        for a, vs in LEVELS.items():
            known = [v for v in vs if v != "missing"]
            sm, su = sum(gm[a][v] for v in known), sum(gu[a][v] for v in known)
            m[a] = {v: gm[a][v] / sm for v in known}
            u[a] = {v: gu[a][v] / su for v in known}
    return m, u, share


def posterior(p: dict, m: dict, u: dict, share: float) -> float:
    z = math.log(share / (1 - share))
    for a in LEVELS:
        if p[a] != "missing":
            z += math.log(m[a][p[a]] / u[a][p[a]])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def estimate_further(patterns: list[tuple[dict, int]], linked: list[tuple[dict, int]], rounds: int = ROUNDS) -> tuple[dict, dict, float]:
    """(m, u, share of matches) of the further passes: m is that of the pairs the brand pass links, u and share come from EM."""
    m = {"brand_level": FURTHER}
    for a in LEVELS.keys() - {"brand_level"}:
        g = {v: 0.02 + sum(n for p, n in linked if p[a] == v) for v in LEVELS[a] if v != "missing"}
        m[a] = {v: x / sum(g.values()) for v, x in g.items()}
    total = sum(n for _, n in patterns)
    share, u = 0.3, None
    weights = [0.0] * len(patterns)
    for _ in range(rounds):
        gu = {a: dict.fromkeys(m[a], 0.5) for a in LEVELS}
        for (p, n), w in zip(patterns, weights, strict=True):
            for a in LEVELS:
                if p[a] != "missing":
                    gu[a][p[a]] += n * (1 - w)
        u = {a: {v: x / sum(g.values()) for v, x in g.items()} for a, g in gu.items()}
        weights = [posterior(p, m, u, share) for p, _ in patterns]
        share = min(max(sum(n * w for (_, n), w in zip(patterns, weights, strict=True)) / total, 1e-6), 1 - 1e-6) if total else share
    return m, u, share


def _initials(brand: str, line: list[str]) -> set[str]:
    return {brand[0] + "".join(w[0] for w in ws) for ws in (line, [w for w in line if w != "and"]) if ws} if brand else set()


def _typed_initials(brand: str, line: list[str]) -> set[str]:
    """What may be initials of a whole name, if ``brand`` stands alone; the legal form may have left its own."""
    return {brand.removesuffix(e) for e in ("", "l", "pl") if len(brand.removesuffix(e)) >= 2} if not line and len(brand) <= 8 else set()


#: Letters of a brand's beginning and of its end that a further pass asks to sound alike.
ENDS = 3


def block_keys(words: Words, initials):
    """UDF (brand, line) -> keys of the further passes: trade and beginning of the brand, trade and its end, initials."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(brand: pd.Series, line: pd.Series) -> pd.Series:
        memo: dict[tuple, str] = {}
        out = []
        for b, ws in zip(brand, line, strict=True):
            t = tuple(w for w in ws if w != "and")
            if t and t not in memo:
                memo[t] = " ".join(words.corrected(t))
            k = {f"i {x}" for x in initials(b, list(ws))}
            sound = phonetic(b)
            if t and len(sound) > ENDS:
                k |= {f"b {sound[:ENDS]} {memo[t]}", f"e {sound[-ENDS:]} {memo[t]}"}
            out.append(sorted(k))
        return pd.Series(out, dtype=object)

    return keys


@F.pandas_udf(T.StringType())
def _further_level(brand: pd.Series, line: pd.Series, listed: pd.Series, meant: pd.Series) -> pd.Series:
    out = []
    for b, ws, c, ms in zip(brand, line, listed, meant, strict=True):
        x, y = phonetic(b), phonetic(c)
        near = (max(len(x), len(y)) + 1) // 3
        if not b or not c:
            out.append("missing")
        elif _typed_initials(b, list(ws)) & _initials(c, list(ms)):
            out.append("initials")
        elif brand_cost(b, c) <= MAX_BRAND:
            out.append("far")
        else:
            out.append("loose" if osa(x, y, near) <= near else "other")
    return pd.Series(out, dtype=object)


def further_pairs(typed: DataFrame, listed: DataFrame, links: DataFrame, words: Words) -> DataFrame:
    """Pairs of one office that the brand pass did not form, each once; hot blocks are spread over several tasks."""
    asked = cut(typed.where("office is not null").withColumn("k", F.explode(block_keys(words, _typed_initials)("brand", "line"))).withColumn("k", F.concat_ws("|", "office", "k")))
    known = listed.where("of_office is not null").withColumn("k", F.explode(block_keys(words, _initials)("listed", "meant"))).withColumn("k", F.concat_ws("|", "of_office", "k"))
    hot = fans(asked.groupBy("k").agg(F.count("*").alias("n")), "k", limit=10_000)
    # the keys of a side look as small as the rows they come from, so that neither is left to be broadcast
    both = salt(asked, hot, "k", F.col("t_id")).hint("merge").join(spread(known, hot, "k").hint("merge"), ["k", "_salt"]).drop("k", "_salt").dropDuplicates(["t_id", "f_id"])
    return both.join(links.select("brand", "listed"), ["brand", "listed"], "left_anti")


class Compared:
    """``typed``: record key and t_id; ``listed``: company and f_id; ``pairs``: t_id, f_id, levels and the rows behind each side."""

    def __init__(self, records: DataFrame, key: str, forms: DataFrame, company: str, offices: list[dict]):
        """``records`` has key, name, office, class; ``forms`` company, form (a name), office, class."""
        office = office_reader(offices)
        one = F.count(F.lit(1))
        names, n_names = cut(records.where("name is not null").groupBy("name").agg(F.count("*").alias("rows")), n=one)
        forms, n_forms = cut(forms, n=one)
        words = channel(names, forms)
        held = read_names(workers(forms, n_forms.n, "form"), [company, "office", "class"], "form", words, bare=True).withColumn("f_name", reading_key())
        held = held.select(company, "f_name", F.col("brand").alias("listed"), F.col("line").alias("meant"), F.col("prefix").alias("meant_prefix"), office("office").alias("of_office"), class_meant(F.col("class")).alias("of_class"))
        self.listed = cut(held.withColumn("f_id", F.concat_ws("|", "f_name", F.coalesce("of_office", F.lit("?")), F.coalesce("of_class", F.lit("?")))))
        read = cut(read_names(workers(names, n_names.n, "name"), ["name", "rows"], "name", words, bare=True).withColumn("reading", reading_key()))
        desk = records.where("name is not null").select(key, "name", office("office").alias("office"), class_meant(F.col("class")).alias("class"))
        placed = skew_join(desk, read.drop("rows"), "name", F.col(key), fans(read, "name", n="rows"))
        self.typed = cut(placed.withColumn("t_id", F.concat_ws("|", "reading", F.coalesce("office", F.lit("?")), F.coalesce("class", F.lit("?")))))
        parts = ["brand", "line", "initials", "prefix", "office", "class"]
        asked = self.typed.groupBy("t_id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in parts])
        entries = cut(self.listed.groupBy("f_id").agg(F.countDistinct(company).alias("holders"), F.min(company).alias("holder"), *[F.first(c).alias(c) for c in ("listed", "meant", "meant_prefix", "of_office", "of_class")]))
        branded = entries.where("listed <> ''").withColumnRenamed("listed", "brand")
        self.asked = asked = cut(whole_lines(asked, branded, words))
        links = brand_links(asked.where("brand <> ''"), branded)
        hot = fans(asked.groupBy("brand").agg(F.count("*").alias("n")), "brand", limit=10_000)
        linked = salt(asked, hot, "brand", F.col("t_id")).join(spread(links, hot, "brand"), ["brand", "_salt"]).drop("_salt")
        hot = fans(linked.groupBy("listed").agg(F.count("*").alias("n")), "listed", limit=10_000)
        first = salt(linked, hot, "listed", F.col("t_id")).join(spread(entries, hot, "listed"), ["listed", "_salt"]).drop("_salt")
        first = first.withColumn("brand_level", F.when(F.col("brand_cost") == 0, "same").when(F.col("brand_cost") <= 0.5, "sounds").when(F.col("brand_cost") <= 1.5, "near").otherwise("far"))
        more = further_pairs(asked, entries, links, words).withColumn("brand_cost", F.lit(MAX_BRAND)).withColumn("brand_level", _further_level("brand", "line", "listed", "meant"))
        both, seen = cut(first.withColumn("further", F.lit(False)).unionByName(more.withColumn("further", F.lit(True))), n=F.count(F.lit(1)))
        costed = workers(both, seen.n, "t_id").withColumn("line_cost", line_costs(words)("line", "initials", "meant", "whole"))
        level = lambda a, b: F.when(a.isNull() | b.isNull(), "missing").when(a == b, "same").otherwise("other")
        self.pairs = cut(
            costed.select(
                "t_id",
                "f_id",
                "n",
                "holders",
                "holder",
                "further",
                "brand_level",
                F.when(F.col("line_cost") == 0, "same").when(F.col("line_cost") <= 1.3, "close").when(F.col("line_cost") <= 2.4, "partial").otherwise("other").alias("line_level"),
                F.when(F.col("prefix") == F.col("meant_prefix"), "same").otherwise("other").alias("prefix_level"),
                level(F.col("office"), F.col("of_office")).alias("office_level"),
                level(F.col("class"), F.col("of_class")).alias("class_level"),
                (F.col("brand_cost") + F.col("line_cost")).alias("cost"),
            )
        )


def compare(records: DataFrame, key: str, forms: DataFrame, company: str, offices: list[dict]) -> DataFrame:
    """(key, company, further, levels, cost) of every record and listed company that a blocking pass brings together.

    For looking at single pairs; :func:`link` never expands them.
    """
    c = Compared(records, key, forms, company, offices)
    rows = c.pairs.drop("n", "holders", "holder").join(c.listed.select(company, "f_id").distinct(), "f_id")
    return c.typed.select(key, "t_id").join(rows, "t_id").drop("t_id", "f_id")


def link(records: DataFrame, key: str, forms: DataFrame, company: str, offices: list[dict], accept: float = ACCEPT) -> DataFrame:
    """(key, company, confidence): for each record its best company where that is more likely a match than not.

    Null or meaningless names give no row, repeated records are linked alike, ties go to the cheaper spelling and then
    to the smaller company key. Only counts of level patterns (some hundreds at most) reach the driver. A further pass's
    pair counts only for records that the brand pass leaves without a company, and its confidence is shared among the
    record's candidates.
    """
    compared = Compared(records, key, forms, company, offices)
    pairs = compared.pairs
    names = list(LEVELS)
    counts = pairs.groupBy("further", *names).agg(F.sum(F.col("n") * F.col("holders")).alias("n")).collect()
    patterns, more = ([({a: r[a] for a in names}, r.n) for r in counts if r.further == f] for f in (False, True))
    m, u, share = estimate(patterns)
    weights = [(False, *(p[a] for a in names), posterior(p, m, u, share)) for p, _ in patterns]
    linked = [(p, n) for p, n in patterns if posterior(p, m, u, share) >= accept and p["line_level"] != "other" and p["office_level"] != "other"]
    m, u, share = estimate_further(more, linked)
    weights += [(True, *(p[a] for a in names), posterior(p, m, u, share)) for p, _ in more]
    spark = records.sparkSession
    schema = T.StructType([T.StructField("further", T.BooleanType()), *(T.StructField(a, T.StringType()) for a in names), T.StructField("confidence", T.DoubleType())])
    known = F.broadcast(spark.createDataFrame(weights, schema))  # one row per level pattern
    judged = pairs.join(known, ["further", *names]).where((F.col("line_level") != "other") & (F.col("office_level") != "other"))
    first = judged.where((F.col("confidence") >= accept) & ~F.col("further")).select("t_id", "holder", "confidence", "cost")
    rest = judged.where(F.col("further") & (F.col("brand_level") != "other")).groupBy("t_id", "holder").agg(F.max("confidence").alias("p"), F.min("cost").alias("cost"), F.max("holders").alias("holders")).join(first, "t_id", "left_anti")
    # a record speaks of one company: its candidates' odds share one denominator
    odds = F.col("p") / (1 - F.least("p", F.lit(1 - 1e-9)))
    shared = rest.withColumn("odds", odds).join(rest.groupBy("t_id").agg(F.sum(F.col("holders") * odds).alias("all")), "t_id").select("t_id", "holder", (F.col("odds") / (1 + F.col("all"))).alias("confidence"), "cost")
    best = first.unionByName(shared.where(F.col("confidence") >= accept))
    top = best.groupBy("t_id").agg(F.max_by(F.struct("holder", "confidence"), F.struct("confidence", -F.col("cost"), -F.col("holder"))).alias("b"))
    chosen = top.select("t_id", F.col("b.holder").alias(company), F.round("b.confidence", 6).alias("confidence"))
    return skew_join(compared.typed.select(key, "t_id"), chosen, "t_id", F.col(key), fans(compared.asked, "t_id")).select(key, company, "confidence").dropDuplicates([key])


def link_records(records: DataFrame, current: DataFrame, offices: list[dict]) -> DataFrame:
    """Records of the cancellation sheet linked to companies of the current list by name, office and class."""
    names = F.explode(F.concat(F.array("name_core"), F.coalesce("alternate_names", F.array().cast("array<string>"))))
    forms = current.select("source_row_number", names.alias("form"), F.col("regional_office").alias("office"), F.col("classification").alias("class")).where("form is not null")
    typed = records.select("record_id", F.coalesce("company_name", "company_name_core").alias("name"), F.col("regional_office").alias("office"), F.col("classification").alias("class"))
    return link(typed, "record_id", forms, "source_row_number", offices)
