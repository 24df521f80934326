"""Blocking scores by an inverted index: (claim, entity) sums are made in a worker's arrays and never shuffled as pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.functions.similarity import trigrams
from kinledger.functions.text import tokens
from kinledger.runtime import broadcast_if_small, cut

#: Entities whose postings one task holds, and claims it scores against them. Every claim meets every block.
BLOCK_ENTITIES, CHUNK_CLAIMS, LEAST_CLAIMS = 100_000, 50_000, 200
#: Share of a block's names from which a word is common: queries with the same common words share the counts of these.
COMMON_WORD = 0.002


def scoring(claim: str, limit: int, below: int | None, gram_weight: float, blocks: int, schema):
    """Function (claims, postings) -> best places of each claim in one block, for a cogroup.

    A claim keeps as many as it may show in the end (``limit``, or its sure ones), ties by place, and the weights of its
    sure ones. With one block the words' places are known to be all; with more, both readings are given (``grams``),
    unless the grams always count (no ``below``).
    """
    import numpy as np
    import pyarrow as pa

    both = blocks > 1 and below is not None

    def score(asked: pa.Table, index: pa.Table) -> pa.Table:
        at = index.column("at").combine_chunks()
        lists = at.chunks[0] if isinstance(at, pa.ChunkedArray) and at.num_chunks else at
        ends = lists.offsets.to_numpy() if len(lists) else np.zeros(1, "int64")
        place, local = np.unique(lists.flatten().to_numpy() if len(lists) else np.zeros(0, "int64"), return_inverse=True)
        ends = ends - ends[0]
        words, grams = {}, {}
        for i, (kind, term, idf) in enumerate(zip(index.column("kind").to_pylist(), index.column("term").to_pylist(), index.column("idf").to_pylist(), strict=True)):
            if kind == "w":
                words[term] = (local[ends[i] : ends[i + 1]], idf)
            else:
                grams[term] = local[ends[i] : ends[i + 1]]
        n = len(place)
        out = ([], [], [], [], [])
        # sums, shared grams and last mention of every place; only what a claim meets is written and cleared again
        weight, shared, last = np.zeros(n), np.zeros(n, "int32"), np.zeros(n, "int64")

        def give(key, where, by_grams):
            out[0].extend([key] * len(where))
            out[1].append(place[where])
            out[2].append(weight[where])
            out[3].extend([by_grams] * len(where))

        def once(met):
            at = np.arange(len(met))
            last[met] = at
            return met[last[met] == at]

        def best(some, k, own):
            if len(some) > k:
                q = np.rint(weight[some] * 1e6)
                least = np.partition(q, len(q) - k)[len(q) - k]
                above = some[q > least]
                some = np.concatenate([above, np.sort(some[q == least])[: k - len(above)]])
            return np.union1d(some, own[weight[own] > 0]) if len(own) else some

        def add(to, p, x):
            if id(p) in twice:
                np.add.at(to, p, x)
            else:
                to[p] += x

        # lists that name a place more than once
        twice = {id(p) for p in (*(p for p, _ in words.values()), *grams.values()) if len(once(p)) < len(p)}
        none = np.zeros(0, "int64")
        counts: list[tuple] = []
        for key, ws, gs, sure in zip(*(asked.column(c).to_pylist() for c in (claim, "words", "grams", "sure")), strict=True):
            k = max(limit, len(sure))
            own = none
            if sure and n:
                s = np.asarray(sure)
                i = np.minimum(np.searchsorted(place, s), n - 1)
                own = i[place[i] == s]
            found = [words[t] for t in ws if t in words]
            for p, x in found:
                add(weight, p, x)
            some = once(np.concatenate([p for p, _ in found])) if found else none
            n1 = len(some)
            thin = below is None or n1 < below
            if both:
                counts.append((key, n1))
            if both or not thin:
                give(key, best(some, k, own), False)
            if thin:
                posts = [grams[t] for t in gs if t in grams]
                if posts:
                    for p in posts:
                        add(shared, p, 1)
                    met = once(np.concatenate(posts))
                    weight[met] += shared[met] * gram_weight
                    shared[met] = 0
                    # places without a shared gram keep what their words gave
                    some = once(np.concatenate([some, met])) if n1 else met
                give(key, best(some, k, own), True)
            weight[some] = 0
        kind = schema.field(0).type
        m = len(counts)
        join = lambda xs, dtype: np.concatenate(xs) if xs else np.zeros(0, dtype)
        hits = pa.table([pa.array(out[0], kind), pa.array(join(out[1], "int64"), pa.int64()), pa.array(join(out[2], "float64"), pa.float64()), pa.array(out[3], pa.bool_()), pa.nulls(len(out[0]), pa.int64())], schema=schema)
        met = pa.table([pa.array([c for c, _ in counts], kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.bool_()), pa.array([c for _, c in counts], pa.int64())], schema=schema)
        return pa.concat_tables([hits, met])

    return score


def blocking_scores(asked: DataFrame, claim: str, words: DataFrame, grams: DataFrame, limit: int, below: int | None, gram_weight: float, n_claims: int, n_entities: int) -> DataFrame:
    """(claim, pos, w): the entities that may be among the best of each claim, with their whole blocking weight.

    ``asked`` has claim, words, grams (terms, repeated ones count again) and sure (places always kept); ``words`` term,
    idf, pos; ``grams`` term, pos. A place weighs the sum of its words' idf and, where the claim's words meet fewer than
    ``below`` places in all (None: always), ``gram_weight`` a shared gram.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    cores = asked.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_entities // BLOCK_ENTITIES))
    chunks = max(-(-n_claims // CHUNK_CLAIMS), min(-(-2 * cores // blocks), -(-n_claims // LEAST_CLAIMS)), 1)
    part: Column = F.col("block") * chunks + F.col("chunk")
    posted = words.select(F.lit("w").alias("kind"), "term", "idf", "pos").unionByName(grams.select(F.lit("g").alias("kind"), "term", F.lit(None).cast("double").alias("idf"), "pos"))
    index = cut(posted.groupBy(F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int").alias("block"), "kind", "term").agg(F.collect_list("pos").alias("at"), F.first("idf").alias("idf")))
    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(part.alias("part"), "kind", "term", "at", "idf")
    claims = asked.withColumn("chunk", F.pmod(F.xxhash64(claim), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(part.alias("part"), claim, "words", "grams", "sure")
    schema = T.StructType([T.StructField(claim, asked.schema[claim].dataType), T.StructField("pos", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("by_grams", T.BooleanType()), T.StructField("n1", T.LongType())])
    # the number of partitions is given, so that adaptive execution does not fold costly tasks of few bytes
    n = max(2 * cores, blocks * chunks)
    both = claims.repartition(n, "part").groupBy("part").cogroup(index.repartition(n, "part").groupBy("part"))
    hits = cut(both.applyInArrow(scoring(claim, limit, below, gram_weight, blocks, to_arrow_schema(schema)), schema))
    if blocks > 1 and below is not None:
        met = hits.where("pos is null").groupBy(claim).agg((F.sum("n1") < below).alias("thin"))
        hits = hits.where("pos is not null").join(broadcast_if_small(met, n_claims, 64), claim).where(F.col("by_grams") == F.col("thin"))
    return hits.select(claim, "pos", "w")


def pooling(claim: str, limit: int, floor: float, schema):
    """Function (claims, entities) -> of the entities of one block that may be shown for each claim, for a cogroup.

    An entity is a candidate where it shares a word of its core or former names, or a 3-gram of its core name without
    blanks. Of those at least ``floor`` alike (:func:`kinledger.functions.similarity.name_similarity`) the first ``limit``
    by steps of a thousandth, place and position; where none is, the most alike one.
    """
    import numpy as np
    import pyarrow as pa

    from kinledger.functions.similarity import _sets

    def squeezed(text: str) -> set[str]:
        x = text.replace(" ", "")
        return {x[i : i + 3] for i in range(max(len(x) - 2, 1))} if x else set()

    def index(sets: list) -> tuple[dict, "np.ndarray"]:
        posts: dict[str, list[int]] = {}
        for i, terms in enumerate(sets):
            for t in terms:
                posts.setdefault(t, []).append(i)
        return {t: np.asarray(p, "int32") for t, p in posts.items()}, np.asarray([len(x) for x in sets], "int64")

    def pool(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by([("pos", "ascending")])
        place, pos, n = held.column("place").to_numpy().astype("int64"), held.column("pos").to_numpy(), held.num_rows
        names = held.column("core").to_pylist()
        sets = [_sets(x) for x in names]
        core, n_core = index([x for x, _ in sets])
        grams, n_grams = index([x for _, x in sets])
        words, _ = index([{t for x in (c, *(f or ())) if x for t in x.split(" ") if t} for c, f in zip(names, held.column("former").to_pylist(), strict=True)])
        runs, _ = index([squeezed(x) for x in names])
        met, shared = np.zeros(n, "bool"), np.zeros(n, "int32")
        keys, found = [], []
        for key, text in zip(asked.column(claim).to_pylist(), asked.column("text").to_pylist(), strict=True):
            own_words, own_grams = _sets(text)
            for terms, posts in ((own_words, words), (squeezed(text), runs)):
                for t in terms:
                    if t in posts:
                        met[posts[t]] = True
            some = np.flatnonzero(met)
            if not len(some):
                continue
            met[some] = False
            p = np.zeros(len(some))
            for terms, posts, sizes in ((own_words, core, n_core), (own_grams, grams, n_grams)):
                lists = [posts[t] for t in terms if t in posts]
                for x in lists:
                    shared[x] += 1
                s = shared[some]
                p = np.maximum(p, s / np.maximum(sizes[some] + len(terms) - s, 1))
                for x in lists:
                    shared[x] = 0
            p = np.round(p, 6)
            shown = np.flatnonzero(p >= floor)
            if len(shown) > limit:
                at = some[shown]
                order = ((1000 - np.floor(p[shown] * 1000).astype("int64")) * 100 + place[at]) * n + at
                shown = shown[np.argpartition(order, limit - 1)[:limit]]
            elif not len(shown):
                shown = np.asarray([np.argmax(p)])
            keys.extend([key] * len(shown))
            found.append(pos[some[shown]])
        return pa.table([pa.array(keys, schema.field(0).type), pa.array(np.concatenate(found) if found else np.zeros(0, "int64"), pa.int64())], schema=schema)

    return pool


def pooled(asked: DataFrame, claim: str, held: DataFrame, limit: int, floor: float, n_claims: int, n_entities: int) -> DataFrame:
    """(claim, pos): all entities that may be among the first ``limit`` shown of each claim, see :func:`pooling`.

    ``asked`` has claim and text, ``held`` pos, place, core and former (names).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    cores = asked.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_entities // BLOCK_ENTITIES))
    chunks = max(-(-n_claims // CHUNK_CLAIMS), min(-(-2 * cores // blocks), -(-n_claims // LEAST_CLAIMS)), 1)
    part: Column = (F.col("block") * chunks + F.col("chunk")).alias("part")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    claims = asked.withColumn("chunk", F.pmod(F.xxhash64(claim), F.lit(chunks)).cast("int")).withColumn("block", every(blocks)).select(part, claim, "text")
    names = held.withColumn("block", F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks)).select(part, "pos", "place", "core", "former")
    schema = T.StructType([T.StructField(claim, asked.schema[claim].dataType), T.StructField("pos", T.LongType())])
    n = max(2 * cores, blocks * chunks)
    both = claims.repartition(n, "part").groupBy("part").cogroup(names.repartition(n, "part").groupBy("part"))
    return both.applyInArrow(pooling(claim, limit, floor, to_arrow_schema(schema)), schema)


def alike(claim: str, limit: int, schema):
    """Function (claims, entities) -> the ``limit`` most alike entities of each claim of one key, for a cogroup."""
    import numpy as np
    import pyarrow as pa

    def index(sets: list[list[str]]) -> tuple[dict, "np.ndarray"]:
        posts: dict[str, list[int]] = {}
        for i, terms in enumerate(sets):
            for t in terms or ():
                posts.setdefault(t, []).append(i)
        return {t: np.asarray(p, "int64") for t, p in posts.items()}, np.asarray([len(x or ()) for x in sets])

    def jaccard(terms: list[str], posts: dict, sizes, n: int):
        met = [posts[t] for t in terms if t in posts]
        if not met:
            return np.zeros(n)
        shared = np.bincount(np.concatenate(met), minlength=n)
        return shared / np.maximum(sizes + len(terms) - shared, 1)

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by([("place", "ascending"), ("pos", "ascending")])
        place, pos, n = held.column("place").to_numpy(), held.column("pos").to_numpy(), held.num_rows
        words, n_words = index(held.column("words").to_pylist())
        grams, n_grams = index(held.column("grams").to_pylist())
        rank_of_place = place.astype("int64")
        out: list[tuple] = []
        for key, ws, gs, route, rank in zip(*(asked.column(c).to_pylist() for c in (claim, "words", "grams", "route", "rank")), strict=True):
            p = np.round(np.maximum(jaccard(ws or [], words, n_words, n), jaccard(gs or [], grams, n_grams, n)), 6)
            # steps down from 1, then place, then position: rows are in the order of the latter two
            order = ((1000 - np.floor(p * 1000).astype("int64")) * 100 + rank_of_place) * n + np.arange(n)
            for i in np.argpartition(order, limit - 1)[:limit] if n > limit else range(n):
                out.append((key, int(pos[i]), route, rank))
        return pa.table([pa.array([r[i] for r in out], schema.field(i).type) for i in range(4)], schema=schema)

    return best


def most_alike(near: DataFrame, claim: str, held: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """(claim, pos, route, rank): of the entities of each key of ``sizes`` the ``limit`` most alike to every claim of it.

    ``near`` has claim, kind, key, text, route, rank; ``held`` kind, key, pos, text, place. A key's claims are spread over tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    cores = near.sparkSession.sparkContext.defaultParallelism
    fan = sizes.select("kind", "key", F.least(F.ceil(F.col("asked") / LEAST_CLAIMS), F.greatest(F.lit(2 * cores), F.ceil(F.col("asked") / CHUNK_CLAIMS))).cast("int").alias("fan"))
    terms = lambda c: [F.array_distinct(tokens(c)).alias("words"), trigrams(c).alias("grams")]
    part = F.concat_ws("|", "kind", "key", "chunk").alias("part")
    asked = near.join(fan, ["kind", "key"]).withColumn("chunk", F.pmod(F.xxhash64(claim), F.col("fan"))).select(part, claim, "route", "rank", *terms(F.coalesce("text", F.lit(""))))
    asked = asked.withColumn("grams", F.when(F.size("words") > 0, F.col("grams")))
    listed = held.join(fan, ["kind", "key"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).select(part, "pos", "place", *terms(F.col("text")))
    schema = T.StructType([T.StructField(claim, near.schema[claim].dataType), T.StructField("pos", T.LongType()), T.StructField("route", T.StringType()), T.StructField("rank", T.IntegerType())])
    both = asked.repartition(4 * cores, "part").groupBy("part").cogroup(listed.repartition(4 * cores, "part").groupBy("part"))
    return both.applyInArrow(alike(claim, limit, to_arrow_schema(schema)), schema)


def nearest(limit: int, least: float, schema):
    """Function (texts, names) -> the ``limit`` names of one block most similar to each text, for a cogroup.

    Similarity is the overlap of the word 3-grams, at least ``least``; ties by sort_name, then id. Texts that have their
    common words alike are taken together: the 3-grams of these are counted once for all names, each text adds its
    others. A name is looked at only where it can reach what the common words alone give to the ``limit``-th name.
    """
    from array import array
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    floor = np.float32(least)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, [("sort_name", "ascending"), ("id", "ascending")], null_placement="at_start"))
        codes: dict[str, int] = {}
        known: dict[str, set[int]] = {}

        def grams(words: list[str]) -> set[int]:
            found: set[int] = set()
            for w in words:
                if w not in known:
                    padded = f"  {w} "
                    known[w] = {codes.setdefault(padded[i : i + 3], len(codes)) for i in range(len(padded) - 2)}
                found |= known[w]
            return found

        n = held.num_rows
        often, size, flat = Counter(), np.zeros(n, "int64"), array("i")
        for i, t in enumerate(held.column("words").to_pylist()):
            words = t.split(" ")
            often.update(set(words))
            own = grams(words)
            size[i] = len(own)
            flat.extend(own)
        common = {w for w, df in often.items() if df >= COMMON_WORD * n}
        flat, n_codes = np.frombuffer(flat, "int32") if n else np.zeros(0, "int32"), len(codes)
        names = np.repeat(np.arange(n), size)[np.argsort(flat, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=n_codes))])
        posts = [names[ends[g] : ends[g + 1]] for g in range(n_codes)]
        sizes, size_at = np.unique(size, return_inverse=True)
        size_at = size_at.astype("int32")
        rows: dict[int, np.ndarray] = {}
        groups: dict[frozenset, tuple[set, dict[int, list]]] = {}
        for i, t in enumerate(asked.column("words").to_pylist()):
            words = t.split(" ")
            own = grams(words)
            alike = frozenset(w for w in words if w in common)
            if alike not in groups:
                groups[alike] = (grams(list(alike)), {})
            held_grams, by_size = groups[alike]
            by_size.setdefault(len(own), []).append((i, [g for g in own - held_grams if g < n_codes]))
        shared_by = np.zeros(n, "int32")
        out_text, out_name, out_similarity = [], [], []

        def give(i, where, similarity):
            out_text.append(np.full(len(where), i))
            out_name.append(where)
            out_similarity.append(similarity)

        for held_grams, by_size in groups.values():
            base = np.zeros(n, "uint16")  # there are fewer grams of letters and digits than that
            for g in held_grams:
                if len(posts[g]) * 16 < n:
                    base[posts[g]] += 1
                    continue
                if g not in rows:
                    rows[g] = np.zeros(n, "uint16")
                    rows[g][posts[g]] = 1
                base += rows[g]
            # names of equal size and equal share of the common words are a kind
            base = base.astype("int32")
            kind = base * np.int32(len(sizes)) + size_at
            count = np.bincount(kind)
            kinds = np.flatnonzero(count)
            kind_base, kind_size = kinds // len(sizes), sizes[kinds % len(sizes)]
            similarity, need = np.zeros(len(count), "float32"), np.zeros(len(count), "int32")
            for n_own, members in by_size.items():
                by_kind = (kind_base / (n_own + kind_size - kind_base)).astype("float32")
                order = np.argsort(-by_kind)
                last = np.searchsorted(np.cumsum(count[kinds][order]), limit)
                reached = max(floor, by_kind[order[last]]) if last < len(order) else floor
                # grams to be shared beside those of the common words; a little less for the sake of rounding
                similarity[kinds] = by_kind
                need[kinds] = np.ceil(float(reached) * (n_own + kind_size) / (1 + float(reached)) - 1e-3) - kind_base
                needed = need[kind]
                first = np.flatnonzero(needed <= 0)
                first_similarity = similarity[kind[first]]
                top = np.argsort(-first_similarity, kind="stable")[:limit]
                top = top[first_similarity[top] >= floor]
                first, first_similarity = first[top], first_similarity[top]
                for i, rest in members:
                    lists = [posts[g] for g in rest]
                    some = first
                    if lists:
                        for p in lists:
                            shared_by[p] += 1
                        met = np.concatenate(lists)
                        some = met[shared_by[met] >= needed[met]]
                        if len(some):
                            some = np.union1d(some, first)
                            shared = base[some] + shared_by[some]
                        shared_by[met] = 0
                        if len(some):
                            s = (shared / (n_own + size[some] - shared)).astype("float32")
                            best = np.argsort(-s, kind="stable")[:limit]
                            best = best[s[best] >= floor]
                            give(i, some[best], s[best])
                            continue
                    give(i, first, first_similarity)
        join = lambda xs, dtype: np.concatenate(xs) if xs else np.zeros(0, dtype)
        of = asked.select(["kind", "text"]).take(pa.array(join(out_text, "int64")))
        to = held.column("id").take(pa.array(join(out_name, "int64")))
        return pa.table([of.column("kind"), of.column("text"), to, pa.array(join(out_similarity, "float32"))], schema=schema)

    return search


def _labels(df: DataFrame, n: int) -> list[int]:
    """Numbers that hashing lays into partitions 0 to n - 1, one each."""
    found: dict[int, int] = {}
    at = df.sparkSession.range(0, 40 * n + 400, 1, 1).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at"))
    for r in at.collect():
        found.setdefault(r.at, r.id)
    # where a partition got no number, some other one takes a second part
    return [found.get(i, -1 - i) for i in range(n)]


def nearest_names(asked: DataFrame, held: DataFrame, limit: int, least: float, n_texts: int, n_names: int, kinds: int) -> DataFrame:
    """(kind, text, id, similarity): of the names of a text's kind the ``limit`` most similar, and maybe further ones.

    ``asked`` has kind, text and words, each text once; ``held`` kind, id, sort_name and words; words is not empty, kinds
    are 0 to ``kinds`` - 1. ``n_texts`` and ``n_names`` are their numbers in all kinds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    cores = asked.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_names // (kinds * BLOCK_ENTITIES)))
    chunks = max(-(-n_texts // (kinds * CHUNK_CLAIMS)), min(-(-2 * cores // (kinds * blocks)), -(-n_texts // LEAST_CLAIMS)), 1)
    n = kinds * blocks * chunks
    labels = F.array(*[F.lit(x) for x in _labels(asked, n)])
    part = F.get(labels, ((F.col("kind") * blocks + F.col("block")) * chunks + F.col("chunk")).cast("int")).alias("part")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    texts = asked.withColumn("chunk", F.pmod(F.xxhash64("text"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks)).select(part, "kind", "text", "words")
    names = held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks)).select(part, "id", "sort_name", "words")
    schema = T.StructType([asked.schema["kind"], asked.schema["text"], held.schema["id"], T.StructField("similarity", T.FloatType())])
    both = texts.repartition(n, "part").groupBy("part").cogroup(names.repartition(n, "part").groupBy("part"))
    return both.applyInArrow(nearest(limit, least, to_arrow_schema(schema)), schema)
