"""Queries of text search, vectors and near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftkite.operators import clusters as C
from siftkite.operators import containment as K
from siftkite.operators import findings as O
from siftkite.operators import lineage as G
from siftkite.operators import retrieval as R
from siftkite.plans.registry import query

_TERMS = ["the", "tion", "que", "token"]


def _bm25_sql(terms: list[str], k: int) -> str:
    t = ", ".join(f"('{x}')" for x in terms)
    return f"""with d as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> '') as w from documents),
    f as (select doc_id, len(w) as n, term, len(list_filter(w, lambda x: x = term)) as f from d, (values {t}) q(term)),
    c as (select (select count(*) from d) as n, (select avg(len(w)) from d) as l),
    raw as (select term, ln((c.n - count(*) filter (f > 0) + 0.5) / (count(*) filter (f > 0) + 0.5)) as idf from f, c group by term, c.n),
    e as (select term, case when idf >= 0 then idf else 0.25::double * abs((select avg(idf) from raw)) end as idf from raw)
    select doc_id, sum(idf * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * f.n / l))) as score from f join e on e.term = f.term, c group by doc_id order by round(score, 9) desc, doc_id limit {k}"""


@query("bm25", _bm25_sql(_TERMS, 20))
def _(t):
    return R.bm25(t.documents, _TERMS, "doc_id", "text", top_k=20)


def _vector(t, vec_id: int) -> list[float]:
    return list(t.embeddings.filter(F.col("vec_id") == vec_id).first()["embedding"])


_DOT = "list_dot_product(e.embedding::double[], q.embedding::double[])"
_COS = f"({_DOT} / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))))"


@query("nearest", f"select e.vec_id, {_COS} as similarity from embeddings e, embeddings q where q.vec_id = 3 order by similarity desc, e.vec_id limit 10")
def _(t):
    return R.nearest(t.embeddings, _vector(t, 3))


@query("nearest_l2", "select e.vec_id, 1 - list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as similarity from embeddings e, embeddings q where q.vec_id = 5 order by similarity desc, e.vec_id limit 10")
def _(t):
    return R.nearest(t.embeddings, _vector(t, 5), metric="l2")


@query("nearest_post_filter", f"select vec_id, similarity from (select e.vec_id, e.label, {_COS} as similarity from embeddings e, embeddings q where q.vec_id = 3 order by similarity desc, e.vec_id limit 30) where label < 5")
def _(t):
    return R.nearest(t.embeddings, _vector(t, 3), k=30, where=F.col("label") < 5)


@query("nearest_pre_filter", f"select e.vec_id, {_COS} as similarity from embeddings e, embeddings q where q.vec_id = 3 and e.label < 5 order by similarity desc, e.vec_id limit 30")
def _(t):
    return R.nearest(t.embeddings, _vector(t, 3), k=30, where=F.col("label") < 5, prefilter=True)


_EACH = f"r as (select q.vec_id as query, e.vec_id, round({_COS}, 9) as similarity, row_number() over (partition by q.vec_id order by round({_COS}, 9) desc, e.vec_id) as nth from embeddings e join embeddings q on e.label = q.label and e.vec_id <> q.vec_id where q.vec_id % 50 = 0)"


@query("nearest_each", f"with {_EACH} select query, vec_id, similarity, nth from r where nth <= 5")
def _(t):
    return R.nearest_each(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"))


@query("recall_and_mrr", f"with {_EACH}, f as (select query, min(nth) filter (vec_id % 2 = 0) as f from r where nth <= 5 group by 1) select avg(case when f <= 3 then 1.0::double else 0 end) as recall, avg(coalesce(1 / f, 0)) as mrr from f")
def _(t):
    ranked = R.nearest_each(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"))
    return R.recall_and_mrr(ranked, "query", "nth", F.col("vec_id") % 2 == 0, 3)


@query("mean_vectors", "select label, list(m order by i) as mean from (select label, i, avg(x) as m from (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) group by 1, 2) group by 1")
def _(t):
    return R.mean_vectors(t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>")), "label")


@query("fit_dimension", "select vec_id, len(embedding) as n, true as valid, list_sum(embedding[1:16]::double[]) as head from embeddings")
def _(t):
    fitted = R.fit_dimension(F.col("embedding"), 16)
    total = F.aggregate(fitted, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), R.valid_vector(F.col("embedding")).alias("valid"), total.alias("head"))


@query("hash_embedding", "with h as (select page_id, list_transform(range(1, 65), lambda i: ('0x' || sha256(url)[i:i])::int / 15) as v from pages) select page_id, round(v[1] / sqrt(list_dot_product(v, v)), 9) as first, 256 as n from h")
def _(t):
    e = R.hash_embedding(F.col("url"))
    return t.pages.select("page_id", F.round(F.get(e, F.lit(0)), 9).alias("first"), F.size(e).alias("n"))


def _hybrid_sql() -> str:
    legs = {"embedding": ("n", 0.5), "bm25": ("b", 0.3), "rule": ("l", 0.2)}
    scaled = ", ".join(f"{t}2 as (select doc_id, case when (select max(score) from {t}) > 0 then score * {w}::double / (select max(score) from {t}) else 0 end as v from {t})" for t, w in legs.values())
    shown = ", ".join(f"coalesce({t}2.v, 0) as {name}" for name, (t, _) in legs.items())
    return f"""with b as ({_bm25_sql(_TERMS, 30)}), n as (select e.vec_id as doc_id, {_COS} as score from embeddings e, embeddings q where q.vec_id = 3 order by score desc, e.vec_id limit 30),
    l as (select doc_id, quality::double as score from labels order by score desc, doc_id limit 30), {scaled},
    k as (select doc_id from n union select doc_id from b union select doc_id from l), j as (select doc_id, {shown} from k left join n2 using (doc_id) left join b2 using (doc_id) left join l2 using (doc_id))
    select *, embedding + bm25 + rule as score from j order by round(embedding + bm25 + rule, 12) desc, doc_id limit 10"""


@query("hybrid_search", _hybrid_sql())
def _(t):
    text = R.bm25(t.documents, _TERMS, "doc_id", "text", top_k=30)
    near = R.nearest(t.embeddings, _vector(t, 3), k=30).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    listed = t.labels.select("doc_id", F.col("quality").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(30)
    return R.fuse_scores({"embedding": (near, 0.5), "bm25": (text, 0.3), "rule": (listed, 0.2)}, "doc_id", 10)


@query("rerank", "select doc_id, len(list_intersect(['que', 'the', 'und'], list_distinct(regexp_split_to_array(lower(text), '\\s+')))) / 3 as relevance from documents order by relevance desc, doc_id limit 25")
def _(t):
    return R.rerank(t.documents, ["the", "que", "und"], "text", "doc_id", 25).select("doc_id", "relevance")


@query("similar_pairs", "with s as (select list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) as w, min(page) as id from (select conv_id * 1000 + turn as page, text from conversations) group by 1) select a.id as a, b.id as b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) as similarity from s a join s b on a.id < b.id where len(a.w) > 0 and len(b.w) > 0 and len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.5")
def _(t):
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), "text")
    return R.similar_pairs(rows, "page", "text", 0.5)


@query("similar_classes", "with s as (select conv_id * 1000 + turn as page, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) as w from conversations) select page, min(page) over (partition by w) as id from s where len(w) > 0")
def _(t):
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), "text")
    return R.similar_classes(rows, "page", "text")


@query("greedy_clusters")
def _(t):
    return C.greedy_clusters(t.conversations, "conv_id", "turn", "text", 0.3)


@query("vote_clusters")
def _(t):
    f = t.finding.select(F.col("file_path").alias("file"), "pos", F.col("line").cast("long").alias("line"), F.concat(F.lit("F"), (F.col("pos") % 97).cast("string")).alias("finding_id"), "description")
    return C.vote_clusters(f)


@query("snippet_similarity")
def _(t):
    part, by = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"]
    pairs = R.pairs_within(part, by, "p_partkey", {"p_partkey": "other", "p_name": "o_name"})
    rows = R.by_kind(pairs, part.select(*by, "p_name").distinct(), "p_name", "o_name", by, lambda x: R.sequence_similarity(x, "p_name", "o_name"))
    return rows.select("p_partkey", "other", "ratio")


def _trace_sql(scope: str) -> str:
    """From every use by recursion; `scope`: the least line that a lookup from line u.line of a file may reach."""
    return f"""select * from (with recursive a as (select l_suppkey as file, l_orderkey % 500 as line, 'v' || (l_partkey % 4) as var, min(case when l_linenumber % 2 = 0 then 'v' || (l_orderkey % 4) end) as source from lineitem group by 1, 2, 3),
    b as (select distinct l_suppkey as file, l_orderkey % 500 as line from lineitem where l_partkey % 7 = 0),
    places as (select distinct file, line from a),
    u as (select p.file, p.line, greatest(p.line - 48, 2, {scope}) as least from places p left join b on b.file = p.file and b.line < p.line group by p.file, p.line),
    n as (select u.file, u.line, a.var, max(a.line) as at, arg_max(struct_pack(s := a.source), a.line).s as origin from u join a on a.file = u.file and a.line < u.line and a.line >= u.least group by 1, 2, 3),
    h as (select a.file, a.line, a.var, n.at, n.origin, 1 as hop from a join n on n.file = a.file and n.line = a.line and n.var = a.var
        union all select h.file, h.line, h.var, n.at, n.origin, h.hop + 1 from h join n on n.file = h.file and n.line = h.at and n.var = h.origin)
    select * from h) x"""


def _traced(t, within_methods: bool):
    l, v = t.lineitem, lambda c: F.concat(F.lit("v"), c.cast("string"))
    at = [F.col("l_suppkey").alias("file"), (F.col("l_orderkey") % 500).alias("line"), v(F.col("l_partkey") % 4).alias("var")]
    a = l.groupBy(*at).agg(F.min(F.when(F.col("l_linenumber") % 2 == 0, v(F.col("l_orderkey") % 4))).alias("source"))
    return G.trace_origin(a, l.select(*at).distinct(), l.filter("l_partkey % 7 = 0").select(*at[:2]).distinct() if within_methods else None)


@query("trace_origin", _trace_sql("coalesce(max(b.line), 0)"))
def _(t):
    return _traced(t, True)


@query("trace_origin_whole", _trace_sql("0"))
def _(t):
    return _traced(t, False)


@query("merge_cluster")
def _(t):
    """The parts as items of knowledge, clustered by their words within a type and merged."""
    part = t.part
    words = F.concat_ws(" ", "p_name", "p_brand", (F.col("p_size") % 5).cast("string"))
    return C.merged_knowledge(
        part.select(
            F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("type"), words.alias("content"), F.lit("catalog").alias("source"), (F.col("p_size") / 100).alias("confidence"),
            F.split("p_name", " ").alias("tags"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("metadata"),
        )
    )


@query("best_per_key", "select cwe_id, pos, similarity from (select cwe_id, pos, round(confidence, 6) as similarity, row_number() over (partition by cwe_id order by round(confidence, 6) desc, pos) n from finding where cwe_id is not null and confidence >= 0.6) where n = 1 order by similarity desc, pos limit 5")
def _(t):
    hit = t.finding.filter("cwe_id is not null and confidence >= 0.6").withColumn("similarity", F.round("confidence", 6))
    return O.first_of(hit, ["cwe_id"], [F.desc("similarity"), "pos"]).orderBy(F.desc("similarity"), "pos").limit(5).select("cwe_id", "pos", "similarity")


_KNOWLEDGE = "k as (select 'K' || p_partkey::varchar as id, p_name || ' ' || p_type || ' ' || p_size::varchar || case when p_size % 3 = 0 then ' ' || p_brand else '' end as content from part), v as (select 'P' || min(p_partkey)::varchar as id, value from (select p_partkey, p_type as value from part union all select p_partkey, p_brand from part union all select p_partkey, p_name[1:7] from part) group by value)"
_WORDS = "select content, id, list_sort(list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'))) as w from k"


@query(
    "knowledge_edges",
    f"""with {_KNOWLEDGE}, s as ({_WORDS}), c as (select w, min(id) as id from s where len(w) > 0 group by w),
    p as (select a.id as a, b.id as b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) as weight from c a join c b on a.id < b.id
        union all select c.id, s.id, 1.0::double from c join s on s.w = c.w and s.id <> c.id),
    e as (select a as source, b as target, 'related_to' as relationship, weight, 'related' as short from p where weight > 0.5 union all select b, a, 'related_to', weight, 'related' from p where weight > 0.5
        union all select k.id, v.id, 'contains_pattern', 0.8::double, 'contains' from k join v on contains(k.content, v.value))
    select sha256(source || '_' || target || '_' || short)[1:16] as edge_id, source, target, relationship, weight from e""",
)
def _(t):
    part = t.part
    content = F.concat(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_brand"))).otherwise(""))
    knowledge = part.select(F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("id"), content.alias("content"))
    values = part.select("p_partkey", F.explode(F.array("p_type", "p_brand", F.substring("p_name", 1, 7))).alias("value"))
    patterns = values.groupBy("value").agg(F.concat(F.lit("P"), F.min("p_partkey").cast("string")).alias("id"))
    return K.knowledge_edges(knowledge, patterns)
