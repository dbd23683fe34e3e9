"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftkite.llm.common import documents
from siftkite.llm.decontam import find_leaks
from siftkite.llm.langid import language_id
from siftkite.llm.lmscore import lm_scores
from siftkite.llm.merge import merge_edited
from siftkite.llm.packing import pack_documents
from siftkite.llm.pii import find_pii
from siftkite.llm.records import write_and_read
from siftkite.llm.sharding import stratified_shards
from siftkite.llm.simhash import near_duplicates
from siftkite.llm.trie import rebuilt_trie
from siftkite.llm.urlfilter import host_of, judge, suffixes
from siftkite.llm.warc import write_and_read as archive_round_trip
from siftkite.llm.winnow import edited_fingerprints, likeness, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(documents(spark, sf_dir), WORD_BPE)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written("marks").alias("fingerprint"),
        written("edited_marks").alias("edited_fingerprint"),
        likeness("marks", "edited_marks").alias("near_edited"),
        likeness("marks", "next_marks").alias("near_next"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


FIRST_DAY = "2024-01-01"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch date, which the table lacks: a day of 2024 by the page's id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.withColumn("fetched", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") % 366).cast("int")))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' hosts and their parent domains of two labels or more: each is listed, lifted and listed again on days that its md5 gives."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    names = hosts.select(F.explode(suffixes(F.col("host"))).alias("pattern")).filter("pattern like '%.%'").distinct()
    number = lambda at: F.conv(F.substring(F.md5("pattern"), at, 2), 16, 10).cast("int")
    names = names.select("pattern", number(1).alias("x"), number(3).alias("y"), number(5).alias("z"))
    entry = lambda seq, day, action: F.struct(F.lit(seq).alias("seq"), day.alias("day"), action.alias("action"))
    x, y, z = F.col("x"), F.col("y") % 60, F.col("z")
    made = F.array(entry(1, x, F.when(z % 4 == 0, "allow").otherwise("block")), entry(2, x + 10 + y, F.lit("lift")), entry(3, x + 40 + y + z % 60, F.lit("block")))
    return names.select("pattern", F.explode(made).alias("e")).select("pattern", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("e.day")).alias("effective"), "e.seq", "e.action")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = captures(spark, sf_dir)
    return judge(pages, list_entries(pages))


OP8_SQL = r"""
with hosts as (
    select page_id, url, date '2024-01-01' + cast(page_id % 366 as int) as fetched,
        nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)', 1)), '\.$', ''), '') as host
    from pages),
labels as (select distinct host, case when regexp_matches(host, '^\[|^[0-9]+(\.[0-9]+){3}$') then [host] else string_split(host, '.') end as l from hosts where host is not null),
tails as (select host, array_to_string(l[i:], '.') as pattern from (select host, l, unnest(range(1, len(l) + 1)) as i from labels)),
names as (
    select distinct pattern, ('0x' || md5(pattern)[1:2])::int as x, ('0x' || md5(pattern)[3:4])::int % 60 as y, ('0x' || md5(pattern)[5:6])::int as z
    from tails where pattern like '%.%'),
entries as (
    select pattern, date '2024-01-01' + x as effective, 1 as seq, case when z % 4 = 0 then 'allow' else 'block' end as action from names
    union all select pattern, date '2024-01-01' + (x + 10 + y), 2, 'lift' from names
    union all select pattern, date '2024-01-01' + (x + 40 + y + z % 60), 3, 'block' from names),
spans as (
    select pattern, action, cast(effective as date) as since, lead(cast(effective as date)) over (partition by pattern order by effective, seq) as until from entries),
hits as (
    select h.page_id, t.pattern, s.action, s.since, row_number() over (partition by h.page_id order by length(t.pattern) desc) as nth
    from hosts h join tails t on h.host = t.host join spans s on s.pattern = t.pattern
    where s.action <> 'lift' and cast(h.fetched as date) >= s.since and (s.until is null or cast(h.fetched as date) < s.until))
select h.page_id, h.url, cast(h.fetched as date) as fetched, h.host, x.pattern, coalesce(x.action, 'none') as action, x.since
from hosts h left join hits x on x.page_id = h.page_id and x.nth = 1
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), WORD_BPE)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: CTEs: bits.t is the table of CRC-32, for `_crc32`.
CRC_BITS = "bits as (select list(v order by n) as t from (select n, list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, n) as v from range(256) r(n)))"


def _crc32(ascii_text: str) -> str:
    return f"xor(list_reduce([ord(y)::bigint for y in string_split({ascii_text}, '')], lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295)"


OP11_SQL = f"""
with {CRC_BITS},
turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select conv_id, list({{r: role, t: text}} order by turn nulls first, md5(octet_length(encode(role)) || ':' || role || text)) as s from turns group by conv_id),
asked as (select conv_id, s, {_crc32("conv_id::varchar")} % 9 as h from own, bits),
rebuilt as (select a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) as s from asked a left join own b on b.conv_id = a.conv_id - a.conv_id % 5),
steps as (select conv_id, s, unnest(range(0, len(s) + 1)) as depth from rebuilt),
nodes as (
    select s[1:depth] as path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(case when len(s) = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
    from steps group by 1),
saving as (select *, case when depth = 0 then 0 else (n_convs - 1) * octet_length(encode(path[depth].t)) end as saved from nodes),
children as (select path[1:depth - 1] as path, count(*) as n from nodes where depth > 0 group by 1),
above as (select path, saved, depth as at, unnest(range(0, depth + 1)) as up from saving),
subtrees as (select a.path[1:a.up] as path, sum(a.saved)::bigint as saved, count(*) filter (c.n is null) as leaves from above a left join children c on c.path = a.path group by 1)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, s.leaves as n_leaves, s.saved as saved_tokens, n.ends_sha256
from nodes n join subtrees s on s.path = n.path left join children c on c.path = n.path left join nodes p on n.depth > 0 and p.path = n.path[1:n.depth - 1]
"""

OP12_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
f as (select page_id, octet_length(encode(payload)) as n, sha256(payload) as digest, min(page_id) over (partition by payload) as smallest from p)
select page_id, n as payload_bytes, digest as payload_digest,
    case when n < 100 or smallest is null or page_id = smallest then 'response' else 'revisit' end as record_type,
    case when n < 100 or smallest is null or page_id = smallest then null else smallest end as refers_to
from f
"""


def op13_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge_edited(documents(spark, sf_dir))
    return out.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def _merged(table: str, kind: str) -> str:
    """Units of `table` (doc_id, k, b, l, r; null: absent) with their merged state m and verdict v."""
    return f"""
    select *, case when l is not distinct from r then l when r is not distinct from b then l when l is not distinct from b then r else b end as m,
        case when l is not distinct from b and r is not distinct from b then null
            when l is not distinct from r or l is not distinct from b or r is not distinct from b then 'clean' else {kind} end as v,
        l is distinct from b as lc, r is distinct from b as rc
    from {table}"""


def _edit(code: str, value: str, emptied: str) -> str:
    return f"case {code} when 0 then {emptied} when 1 then {value} || '!' when 2 then {value} || '?' else {value} end"


OP13_SQL = f"""
with {CRC_BITS},
docs as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
split as (select doc_id, string_split(text, chr(10)) as x from docs),
lines as (select doc_id, unnest(range(0, len(x))) as k, unnest(x) as line from split),
line_codes as (select doc_id, k, line, {_crc32("'L:' || doc_id || ':' || k")} % 11 as lc, {_crc32("'R:' || doc_id || ':' || k")} % 11 as rc from lines, bits),
line_units as (select doc_id, 2 * k as k, line as b, {_edit("lc", "line", "null")} as l, {_edit("rc", "line", "null")} as r from line_codes),
gap_units as (select doc_id, 2 * k + 1 as k, cast(null as varchar) as b, case lc when 3 then '!' when 4 then '?' end as l, case rc when 3 then '!' when 4 then '?' end as r from line_codes),
row_codes as (
    select doc_id, text, lang, source, {", ".join(_crc32(f"'{b}:' || doc_id || ':{c}'") + f" % 11 as {b}_{c}" for b in "LR" for c in ("row", "lang", "source"))}
    from docs, bits),
column_units as (
    select doc_id, -2 as k, lang as b, {_edit("L_lang", "lang", "''")} as l, {_edit("R_lang", "lang", "''")} as r from row_codes
    union all select doc_id, -1, source, {_edit("L_source", "source", "''")}, {_edit("R_source", "source", "''")} from row_codes),
units as (
    {_merged("column_units", "'edit_edit'")}
    union all {_merged("line_units", "case when l is null or r is null then 'edit_delete' else 'edit_edit' end")}
    union all {_merged("gap_units", "'insert_insert'")}),
folded as (
    select doc_id, bool_or(lc) as lc, bool_or(rc) as rc, max(m) filter (k = -2) as lang, max(m) filter (k = -1) as source, coalesce(string_agg(m, chr(10) order by k) filter (k >= 0), '') as text,
        count(*) filter (v = 'clean') as clean, count(*) filter (v = 'edit_edit') as ee, count(*) filter (v = 'edit_delete') as ed, count(*) filter (v = 'insert_insert') as ii
    from units group by doc_id),
kept as (
    select f.*, r.lang as base_lang, r.source as base_source, r.text as base_text, L_row = 0 or R_row = 0 as gone, (L_row = 0 and R_row <> 0 and f.rc) or (R_row = 0 and L_row <> 0 and f.lc) as clash
    from folded f join row_codes r on r.doc_id = f.doc_id),
additions as (
    select -1 - doc_id as doc_id, 'L' as branch, case L_row when 3 then '!' else '?' end as text, lang, source from row_codes where L_row in (3, 4)
    union all select -2 - doc_id, 'R', case R_row when 3 then '!' else '?' end, lang, source from row_codes where R_row in (3, 4)),
added as (
    select doc_id, count(distinct {{t: text, l: lang, s: source}}) = 1 as one, min(text) as text, min(lang) as lang, min(source) as source
    from additions where doc_id not in (select doc_id from docs) group by doc_id)
select doc_id, case when clash then base_lang when not gone then lang end as lang, case when clash then base_source when not gone then source end as source,
    case when clash then sha256(base_text) when not gone then sha256(text) end as text_sha256,
    case when gone then (not clash)::int else clean end as n_clean, case when gone then 0 else ee end as n_edit_edit, case when gone then clash::int else ed end as n_edit_delete, case when gone then 0 else ii end as n_insert_insert
from kept
union all
select doc_id, case when one then lang end, case when one then source end, case when one then sha256(text) end, one::int, 0, 0, (not one)::int from added
"""


QUERIES = (op1_records, op2_simhash, op3_sharding, op4_winnowing, op5_decontamination, op6_language, op7_lm, op8_urlfilter, op9_packing, op10_pii, op11_prefix_trie, op12_warc, op13_merge)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_urlfilter": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL, "op13_merge": OP13_SQL}
