"""The entity corpus: uniform entities, key table, postings and term statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinledger.functions.text import char_ngrams, clean, cluster_key, name_core, normalize_name_folded, tokens
from kinledger.functions.urls import normalize_hostname
from kinledger.operators.snapshots import counting_rows, current_list

CEILING_SHARE = 0.02
CEILING_LEAST = 20
SCAN_CAP = 4000

ENTITY_COLUMNS = ["id", "pos", "source", "standing", "name", "name_normalized", "name_core", "alternate_names", "cin", "email_domains", "hostnames", "cluster_key", "regional_office", "source_row_number", "dataset_as_of"]


def to_entity(df: DataFrame, source: str, standing: str, rank: int, cols: dict[str, str | None]) -> DataFrame:
    """One source as entities; rows without a usable name are dropped, a missing core falls back to the full name.

    ``pos`` orders entities by source and row number without a global sort.
    """
    pick = lambda name, kind: F.col(cols[name]) if cols.get(name) else F.lit(None).cast(kind)
    arr = lambda name: F.coalesce(pick(name, "array<string>"), F.array().cast("array<string>"))
    normalized = F.nullif(F.coalesce(pick("name_normalized", "string"), normalize_name_folded(pick("name", "string"))), F.lit(""))
    core = F.coalesce(F.nullif(pick("name_core", "string"), F.lit("")), name_core(normalized))
    row = pick("row", "int")
    out = df.select(
        F.concat(F.lit(source + ":"), row.cast("string")).alias("id"),
        (F.lit(rank).cast("long") * 1_000_000_000_000 + row).alias("pos"),
        F.lit(source).alias("source"),
        F.lit(standing).alias("standing"),
        clean(pick("name", "string")).alias("name"),
        normalized.alias("name_normalized"),
        core.alias("name_core"),
        F.array_distinct(F.transform(arr("alternate_names"), normalize_name_folded)).alias("alternate_names"),
        pick("cin", "string").alias("cin"),
        F.array_distinct(F.filter(F.transform(arr("email_domains"), normalize_hostname), lambda h: h.isNotNull())).alias("email_domains"),
        F.array_distinct(F.filter(F.transform(arr("hostnames"), normalize_hostname), lambda h: h.isNotNull())).alias("hostnames"),
        cluster_key(core).alias("cluster_key"),
        pick("office", "string").alias("regional_office"),
        row.alias("source_row_number"),
        pick("as_of", "date").alias("dataset_as_of"),
    )
    return out.where("name_normalized is not null and id is not null")


#: Sources of the corpus: standing, place in its order, and where each column comes from.
_SHARED = {"row": "source_row_number", "office": "regional_office", "as_of": "dataset_as_of"}
_NAMED = {"name": "name", "name_normalized": "name_normalized", "name_core": "name_core"}
_LISTED = _SHARED | _NAMED | {"alternate_names": "alternate_names", "cin": "cin_normalized", "email_domains": "email_domains"}
SOURCES = {
    "registered_nbfc": ("registered", 0, _LISTED),
    "registered_arc": ("registered", 2, _LISTED),
    "cancelled_company": ("cancelled", 3, _SHARED | _NAMED),
    "cancelled_record": ("cancellation_record", 1, _SHARED | {"name": "company_name", "name_normalized": "company_name_normalized", "name_core": "company_name_core"}),
    "bank": ("bank", 4, {"row": "source_row_number", "as_of": "dataset_as_of", "hostnames": "hostnames"} | _NAMED),
}


def unite(tables: dict[str, DataFrame]) -> DataFrame:
    """Union of the sources given, {source: rows}, as entities; columns a table lacks are null."""
    out = None
    for source, df in tables.items():
        standing, rank, cols = SOURCES[source]
        made = to_entity(df, source, standing, rank, {k: c for k, c in cols.items() if c in df.columns})
        out = made if out is None else out.unionByName(made)
    return out


def build_entities(register: DataFrame, records: DataFrame, **more: DataFrame) -> DataFrame:
    """Union of the current registered list, the cancellation records (their counting rows) and any further sources."""
    keep = ["name", "name_normalized", "name_core", "alternate_names", "cin_normalized", "email_domains", "regional_office", "dataset_as_of"]
    listed = current_list(register, ["source_row_number", *keep])
    record_keep = ["company_name", "company_name_normalized", "company_name_core", "regional_office"]
    sheet = counting_rows(records, ["dataset_as_of", "source_row_number"], "last_imported_at", record_keep)
    return unite({"registered_nbfc": listed, "cancelled_record": sheet, **more})


def entity_keys(entities: DataFrame) -> DataFrame:
    """(kind, key, pos) of every exact key; empty keys are left out."""
    one = [("cin", F.array("cin")), ("name", F.array("name_normalized")), ("core", F.array("name_core")), ("alias", F.col("alternate_names")), ("email_domain", F.col("email_domains")), ("hostname", F.col("hostnames"))]

    def tagged(kind: str, keys):
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    kinds = F.explode(F.flatten(F.array(*[tagged(kind, keys) for kind, keys in one])))
    return entities.select("pos", kinds.alias("k")).select("k.kind", "k.key", "pos").where("key is not null and key <> ''").distinct()


def postings(entities: DataFrame, kind: str = "token") -> DataFrame:
    """(term, pos): distinct words, or 3-grams, of core and former names."""
    texts = F.concat(F.array("name_core"), "alternate_names") if kind == "token" else F.array("name_core")
    terms = F.transform(texts, tokens if kind == "token" else (lambda t: char_ngrams(F.regexp_replace(t, " ", ""))))
    return entities.select(F.explode(F.array_distinct(F.flatten(terms))).alias("term"), "pos")


def term_stats(post: DataFrame, n_entities: DataFrame) -> DataFrame:
    """(term, df, idf, kept): idf = ln((N+1)/(df+1)) + 1; kept while df is at most max(20, ceil(2 % of N))."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(n_entities)
    return df.crossJoin(n).select(
        "term",
        "df",
        (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"),
        (F.col("df") <= F.greatest(F.lit(CEILING_LEAST), F.ceil(F.col("n") * CEILING_SHARE))).alias("kept"),
    )


def entity_count(entities: DataFrame) -> DataFrame:
    """One row: n."""
    return entities.agg(F.count("*").alias("n"))
