"""Retrieval: BM25, exact nearest neighbours, score fusion, re-ranking, vectors, near-duplicate clusters, traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.staging import stage

#: Okapi's usual parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens(text: Column, *, plain: bool = False) -> Column:
    """Split at white space; plain: lower case and only letters, digits and blanks before that."""
    text = F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9\s]", "") if plain else text
    return F.array_remove(F.split(text, r"\s+"), "")


def bm25(docs: DataFrame, query: list[str], key: str, text: str, *, plain: bool = True, top_k: int = 10, positive: bool = True) -> DataFrame:
    """(key, score) of the best top_k documents; the cut comes first, then scores of 0 and less go.

    Only the query's terms are counted, within each row, so documents are not exploded to words; texts are read once, as the counts are staged. Document frequencies and the mean length are
    one aggregate over them. A term in more than half of the documents has a small positive weight, EPSILON times the mean.
    """
    terms = list(dict.fromkeys(query))
    own = tokens(F.col(text), plain=plain)
    rows = docs.select(key, own.alias("_t")).select(key, F.size("_t").alias("_n"), *[F.size(F.filter("_t", _equals(t))).alias(f"_f{i}") for i, t in enumerate(terms)])
    rows = stage(rows, "terms")
    have = [F.count_if(F.col(f"_f{i}") > 0) for i in range(len(terms))]
    idf = [F.log((F.count("*") - d + 0.5) / (d + 0.5)) for d in have]
    floor = EPSILON * F.abs(sum(idf, F.lit(0.0)) / max(1, len(idf)))
    stats = rows.agg(F.struct(F.avg("_n").alias("len"), *[F.when(x >= 0, x).otherwise(floor).alias(f"idf{i}") for i, x in enumerate(idf)])).scalar()
    rows = rows.withColumn("_s", stats).filter("_s.len > 0")
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        f = F.col(f"_f{i}")
        score = score + query.count(t) * F.col(f"_s.idf{i}") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_s.len")))
    out = rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(top_k)
    return out.filter("score > 0") if positive else out


def _equals(term: str):
    return lambda x: x == term


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, *, floor: float | None = None) -> Column:
    """Cosine; a zero norm gives 0, or with floor counts as that."""
    if floor is not None:
        return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 - squared distance, which is not the cosine."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def fit_dimension(a: Column, n: int) -> Column:
    """Cut, or filled with zeros, to n dimensions; not normalised again."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def valid_vector(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def nearest(vectors: DataFrame, query: list[float], *, key: str = "vec_id", vector: str = "embedding", k: int = 10, metric: str = "cosine", where: Column | None = None, prefilter: bool = False) -> DataFrame:
    """(key, similarity) of the k nearest, ties by key. `where` filters after the cut, as the reference does, or with prefilter before it."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if prefilter and where is not None:
        vectors = vectors.filter(where)
    s = cosine(F.col(vector), q) if metric == "cosine" else l2_similarity(F.col(vector), q)
    out = vectors.withColumn("similarity", s).orderBy(F.desc("similarity"), key).limit(k)
    return (out.filter(where) if where is not None and not prefilter else out).select(key, "similarity")


def nearest_each(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", by: str = "label", k: int = 5) -> DataFrame:
    """(query, key, similarity, nth): the k nearest within the query's own partition `by`; queries are a stated set against all rows of it.

    A group's rows are dealt to blocks, which meet its queries in numpy: the products are added up in the order of `cosine`, so the numbers are its own. Of each block go on those that may be among the k after rounding.
    Vectors that are not valid, or differ in length, meet row by row.
    """
    regular = F.when(valid_vector(F.col(vector)), F.size(vector)).otherwise(0)
    v = vectors.select(F.col(key), F.col(vector).alias("_v"), F.col(by).alias("_by"), regular.alias("_d")).filter("_by is not null")
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("_q"), F.col(by).alias("_by"), regular.alias("_d")).filter("_by is not null")
    sizes = v.groupBy("_by").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    tasks, at = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["_by", "_d", "_block"]
    own = v.filter("_d > 0").join(sizes, "_by").select(*at[:2], F.pmod(F.xxhash64(key), F.col("_blocks").cast("long")).alias("_block"), key, "_v").repartition(tasks, *at)
    asked = q.filter("_d > 0").join(sizes, "_by").select(*at[:2], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)).alias("_block"), "query", "_q").repartition(tasks, *at)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", key, "similarity"]
        ids, keys = (np.array(t.column(c).to_pylist()) for t, c in ((left, "query"), (right, key)))
        if not len(ids) or not len(keys):
            return pa.table([left.column("query").slice(0, 0), right.column(key).slice(0, 0), pa.array([], "double")], names=names)
        a, b = (np.stack(t.column(c).to_numpy()).astype(float) for t, c in ((left, "_q"), (right, "_v")))
        norm = lambda x: np.sqrt(sum((x[:, d] * x[:, d] for d in range(x.shape[1])), np.zeros(len(x))))
        length, out = norm(b), []
        for low in range(0, len(a), 256):
            part = a[low : low + 256]
            n = norm(part)[:, None] * length
            dots = np.zeros(n.shape)
            for d in range(part.shape[1]):
                dots += part[:, d, None] * b[:, d]
            alike = np.where(n == 0, 0.0, dots / np.where(n == 0, 1.0, n))
            for row, query in enumerate(ids[low : low + 256]):
                other = np.flatnonzero(keys != query)
                s = alike[row, other]
                keep = other[~(s < np.partition(s, len(s) - k)[len(s) - k] - 2e-9)] if len(s) > k else other
                keep = keep[np.lexsort((keys[keep], alike[row, keep]))]
                s = alike[row, keep]
                first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
                start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
                keep = keep[np.arange(len(s)) - start < k]  # of equal ones those of the least keys
                out.append((np.full(len(keep), low + row), keep))
        i, j = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([left.column("query").take(pa.array(i)), right.column(key).take(pa.array(j)), pa.array(alike_of(a, b, length, norm, i, j))], names=names)

    def alike_of(a: np.ndarray, b: np.ndarray, length: np.ndarray, norm: Callable, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dots, n = sum((a[i, d] * b[j, d] for d in range(a.shape[1])), np.zeros(len(i))), norm(a)[i] * length[j]
        return np.where(n == 0, 0.0, dots / np.where(n == 0, 1.0, n))

    kind = vectors.schema[key].dataType.simpleString()
    near = asked.groupBy(*at).cogroup(own.groupBy(*at)).applyInArrow(meet, f"query {kind}, `{key}` {kind}, similarity double")
    odd = v.withColumnsRenamed({"_d": "_vd"}).join(q, "_by").filter((F.col(key) != F.col("query")) & ((F.col("_d") == 0) | (F.col("_d") != F.col("_vd")))).select("query", key, cosine(F.col("_v"), F.col("_q")).alias("similarity"))
    rows = near.unionByName(odd).withColumn("similarity", F.round("similarity", 9))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))).filter(F.col("nth") <= k)


def mean_vectors(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, mean): element by element."""
    at = vectors.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    return at.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))


def hash_embedding(text: Column, dimensions: int = 256) -> Column:
    """sha256's 64 hex digits / 15, normalised, in the first of the dimensions."""
    digest = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("double") / 15)
    n = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.concat(F.transform(raw, lambda x: F.when(n == 0, 0.0).otherwise(x / F.when(n == 0, 1.0).otherwise(n))), F.array_repeat(F.lit(0.0), dimensions - 64))


def fuse_scores(legs: dict[str, tuple[DataFrame, float]], key: str, top_k: int) -> DataFrame:
    """Full outer join of the legs' (key, score), each divided by its greatest, weighted and summed; a missing score is 0.

    Legs are candidate lists, cut before they come here, so the greatest is that of the candidates.
    """
    out = None
    for name, (df, weight) in legs.items():
        most = df.agg(F.max("score")).scalar()
        part = df.select(key, F.when(most > 0, F.col("score") * (weight / most)).otherwise(F.lit(0.0)).alias(name))
        out = part if out is None else out.join(part, key, "full_outer")
    total = sum((F.coalesce(n, F.lit(0.0)) for n in legs), F.lit(0.0))
    return out.select(key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in legs], total.alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def rerank(candidates: DataFrame, query: list[str], text: str, key: str, top_k: int) -> DataFrame:
    """By the share of the query's words that a text has."""
    q = F.array(*map(F.lit, sorted({w.lower() for w in query})))
    share = F.size(F.array_intersect(q, F.split(F.lower(text), r"\s+"))) / F.size(q)
    return candidates.withColumn("relevance", share).orderBy(F.desc("relevance"), key).limit(top_k)


# What a query is expanded with when it names none of a class.
EXPANSIONS = [("sql injection", ["sqli", "sql注入"]), ("xss", ["cross-site scripting"]), ("rce", ["remote code execution", "command injection"]), ("ssrf", ["server-side request forgery"])]


def expand_query(query: str) -> str:
    """' OR ' and the synonyms of each class that the query names by one of its words and no other."""
    out = query
    for name, others in EXPANSIONS:
        if name in query.lower():
            out += "".join(f" OR {o}" for o in others if o not in query.lower())
    return out


def added_words(query: str, expanded: str) -> list[str]:
    return sorted(set(expanded.split()) - set(query.split()))


def recall_and_mrr(ranked: DataFrame, query: str, nth: str, relevant: Column, k: int) -> DataFrame:
    """One row: the share of queries with a relevant row among the first k, and the mean of 1 / place of the first relevant one (0 where none)."""
    first = ranked.groupBy(query).agg(F.min(F.when(relevant, F.col(nth))).alias("_first"))
    return first.agg(F.avg(F.when(F.col("_first") <= k, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"))


def word_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w): the distinct words of each row that has any, in order."""
    return docs.select(key, F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))).alias("w")).filter(F.size("w") > 0)


def similar_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id): each row with words and its class, the smallest key with the same word set. `similar_pairs` has the pairs of classes; two rows of a class are alike by 1.0."""
    words = word_sets(docs, key, text)
    return words.join(words.groupBy("w").agg(F.min(key).alias("id")), "w").select(key, "id")


def similar_pairs(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs whose word sets' Jaccard similarity passes the threshold.

    Equal word sets are joined once, as one, under their smallest key; `similar_classes` has the rows of each. `similar_sets` says how pairs are found.
    """
    sets = word_sets(docs, key, text).groupBy("w").agg(F.min(key).alias("id"))
    return similar_sets(sets, threshold)


#: Sets of at most this many words are joined on combinations of up to JOINT words of their prefixes, larger ones on single words.
SHORT, JOINT = 10, 3
#: Vectors that meet the queries of their group at once.
BLOCK = 2000
#: Rows of a group that one piece of its pairs has.
PIECE = 1000
#: Words of 64 bits in the bit map of a set: sets of some 250 words leave over half of 512 bits free, so that unrelated ones do not look alike. It decides what is written out, not what is found.
MAP_WORDS = 8


def similar_sets(sets: DataFrame, threshold: float, *, reach: bool = False) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of sets (id, w: distinct words) above the threshold, or with `reach` at it. With a column `by` only sets of equal `by` meet.

    Of two sets that pass, a share of the words of each is common: t of the larger one's, 2 t / (1 + t) of the smaller one's at least. With k such words of n, in order from rare to common, the first n - k + l
    of each have l in common. Short sets are joined on every l of these at once, as single words of few kinds say little. A pair that meets is kept only if places and bit maps leave room for enough common words
    (a bit that one map has alone is a word that the other set lacks), so what is written out is little more than the pairs that pass. No test loses a pair.
    """
    sets = sets if "by" in sets.columns else sets.withColumn("by", F.lit(0))
    count = sets.select("by", F.explode("w").alias("word")).groupBy("by", "word").agg(F.count("*").alias("df"))
    count = count.select(F.col("by").alias("_by"), F.col("word").alias("_word"), "df")
    ranked = sets.select("id", "by", F.explode("w").alias("word")).join(count, F.col("by").eqNullSafe(F.col("_by")) & (F.col("word") == F.col("_word")))
    # id and by name a set, so each array is as long as the set
    prefix = ranked.groupBy("id", "by").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("p")).select("id", "by", F.size("p").alias("n"), F.transform("p", lambda x: x["word"]).alias("p"))

    passes = (lambda c: c >= threshold) if reach else (lambda c: c > threshold)
    bit = F.transform("p", lambda x: F.pmod(F.xxhash64(x), F.lit(64 * MAP_WORDS)).cast("int"))
    of_word = lambda k: F.aggregate(F.filter("_bits", lambda b: F.shiftright(b, 6) == k), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(_bit(b)))
    prefix = prefix.withColumn("_bits", bit).select("*", *[of_word(k).alias(f"m{k}") for k in range(MAP_WORDS)]).drop("_bits")

    def least(n: Column, share: float, whole: Callable[[Column], Column]) -> Column:
        k = F.greatest(F.ceil(n * share - 1e-6), F.lit(1))
        return F.when(passes(k / whole(k)), k).otherwise(k + 1).cast("int")

    of_larger = lambda n: least(n, threshold, lambda k: n)
    of_smaller = lambda n: least(n, 2 * threshold / (1 + threshold), lambda k: 2 * n - k)
    joint = lambda n: F.when(n <= SHORT, F.least(F.lit(JOINT), of_larger(n))).otherwise(F.lit(1))
    n, top = F.col("n"), F.lit(SHORT + 1)
    # a set meets those as large or larger on as many words at once as the larger one takes
    upto = F.when(n > SHORT, n).otherwise(F.least(top, F.ceil(n / threshold + 1e-6).cast("int")) if threshold > 0 else top)

    def keys(rows: DataFrame, k: Column) -> DataFrame:
        rows = rows.withColumn("p", F.slice("p", F.lit(1), F.greatest(F.lit(0), F.least(n, n - k + F.col("l")))))
        rows = rows.withColumn("k", F.explode(_combinations(F.col("p"), F.col("l"))))
        return rows.select(F.xxhash64("by", "l", "k.key").alias("key"), "id", "by", "n", "k.at", *[f"m{k}" for k in range(MAP_WORDS)])

    larger = keys(prefix.withColumn("l", joint(n)), of_larger(n))
    smaller = keys(prefix.withColumn("l", F.explode(F.array_distinct(F.transform(F.sequence(n, F.greatest(n, upto)), joint)))), of_smaller(n))
    smaller = smaller.select("key", *[F.col(c).alias(f"o_{c}") for c in smaller.columns if c != "key"])
    pairs = larger.join(smaller, "key").filter(F.col("by").eqNullSafe(F.col("o_by")) & ((F.col("n") > F.col("o_n")) | ((F.col("n") == F.col("o_n")) & (F.col("id") < F.col("o_id")))))
    alone = lambda x, y: sum(F.bit_count(F.col(f"{x}m{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}m{k}")))) for k in range(MAP_WORDS))
    most = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"), F.col("n") - alone("", "o_"), F.col("o_n") - alone("o_", ""))
    pairs = pairs.withColumn("_most", most).filter((F.col("_most") > 0) & passes(F.col("_most") / (F.col("n") + F.col("o_n") - F.col("_most"))))
    pairs = pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()
    full = sets.select("id", "w")
    rows = pairs.join(full.select(F.col("id").alias("a"), F.col("w").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("w").alias("y")), "b")
    s = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return rows.select("a", "b", s.alias("similarity")).filter(passes(F.col("similarity")))


def _bit(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))


def _combinations(p: Column, size: Column) -> Column:
    """(at, key) of every `size` words of an array, of one to JOINT of them, in its order: the place of the first, from 0, and a hash."""
    after = lambda x, i: F.slice(p, i + 2, F.size(p))
    one = F.transform(p, lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("key")))
    two = F.flatten(F.transform(p, lambda x, i: F.transform(after(x, i), lambda y: F.struct(i.alias("at"), F.xxhash64(x, y).alias("key")))))
    three = F.flatten(F.transform(p, lambda x, i: F.flatten(F.transform(after(x, i), lambda y, j: F.transform(F.slice(p, i + j + 3, F.size(p)), lambda z: F.struct(i.alias("at"), F.xxhash64(x, y, z).alias("key")))))))
    return F.when(size == 1, one).when(size == 2, two).otherwise(three)


def pairs_within(rows: DataFrame, by: list[str], key: str, others: dict[str, str], *, piece: int = PIECE) -> DataFrame:
    """rows and the columns of `others` (of the second row, by the names given) of all pairs of rows of equal `by`, the smaller key first. Nulls in `by` meet nothing.

    A group's second rows are dealt to pieces of about `piece` rows, and its first rows go to each, so that a task's share of the pairs is bounded whatever the largest group; the number of tasks is the session's,
    as the few bytes of the rows say nothing about the pairs.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / piece).cast("int").alias("_pieces"))
    dealt = rows.join(sizes, by)
    first = dealt.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    second = dealt.select(*by, F.pmod(F.xxhash64(key), F.col("_pieces")).cast("int").alias("_piece"), *[F.col(c).alias(n) for c, n in others.items()])
    at = [*by, "_piece"]
    return first.repartition(tasks, *at).join(second.repartition(tasks, *at).hint("merge"), at).filter(F.col(key) < F.col(others[key])).drop("_piece")


def by_kind(pairs: DataFrame, kinds: DataFrame, a: str, b: str, by: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs and the columns that `score` adds to (a, b), found once for each two texts a and b that meet in a group and not for each pair. kinds: the distinct (by, a)."""
    texts = kinds.join(kinds.withColumnRenamed(a, b), by).select(a, b).distinct()
    scored = stage(score(texts), "kinds")
    scored = scored.select(F.col(a).alias("_a"), F.col(b).alias("_b"), *[c for c in scored.columns if c not in (a, b)])
    return pairs.join(scored, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b"))).drop("_a", "_b")


def sequence_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs and a column `ratio`: difflib's, which no built-in gives."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for x, y in batches:
            yield pd.Series([SequenceMatcher(None, i or "", j or "").ratio() for i, j in zip(x, y, strict=True)], dtype=float)

    return pairs.withColumn("ratio", ratio(a, b))


def text_features(code: Column, dimensions: int = 384) -> Column:
    """Ten counts of a source text, tiled to the dimensions, each modulo 1."""
    count = lambda p: F.regexp_count(code, F.lit(p)).cast("double")
    n = F.length(code).cast("double")
    ten = F.array(n / 1000, count("\n") / 100, count(r"\bdef\b") / 10, count(r"\bclass\b") / 10, count(r"\bimport\b") / 10, count(r"\bif\b") / 10, count(r"\bfor\b") / 10, count(r"\breturn\b") / 10, count("=") / 100, count(r"\(") / 100)
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.pmod(F.get(ten, i % 10), F.lit(1.0)))
