"""The operators as registered queries over the driver's tables.

Each query applies its operator to the whole table and derives the columns
of its result from the operator's output; ``ORACLE`` holds DuckDB SQL where
SQL can express the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.alignment import align_documents
from basketry.llm.decontaminate import contaminated
from basketry.llm.exact_dedup import exact_dedup
from basketry.llm.filter_audit import filter_audit
from basketry.llm.line_dedup import line_dedup
from basketry.llm.near_dedup import near_groups
from basketry.llm.packing import pack_documents
from basketry.llm.quality import quality_scores
from basketry.llm.sharding import shard_rows
from basketry.llm.substring_dedup import substring_dedup
from basketry.llm.suffix_dedup import suffix_dedup
from basketry.llm.token_files import read_token_files, write_token_files
from basketry.llm.url_filter import url_verdicts
from basketry.llm.workdir import ship_package

# (host, path, verdict): fixed values of the contract
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, verdict string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")     # drops white space before it merges
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
WORD_END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    """One row for each contaminated document and benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op4_url_filter(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULE_SCHEMA))


def op5_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_files(spark, sf_dir):
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), WORD_VOCABULARY, WORD_END_ID, by_words=True))


def op13_alignment(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"), VOCABULARY, PIECE_VOCABULARY)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_packing, op3_sharding, op4_url_filter, op5_line_dedup, op6_near_dedup,
    op7_quality, op8_substring_dedup, op9_exact_dedup, op10_suffix_dedup,
    op11_filter_audit, op12_token_files, op13_alignment)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op4_url_filter": f"""
with a as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
           from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from a),
c as (select page_id, {_LOWER.format('h')} as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
d as (select page_id, coalesce(host, '') as host, coalesce(path, '') as path from c),
e as (select page_id, host, path,
      case when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/en/') then 'example.net/en/'
           when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/de/') then 'example.com/de/'
           when (host = 'org' or suffix(host, '.org')) and prefix(path, '/fr/') then 'org/fr/'
           when (host = 'net' or suffix(host, '.net')) and prefix(path, '/') then 'net/' end as rule from d)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from e""",
    "op5_line_dedup": f"""
with a as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
b as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from a),
c as (select *, {_LOWER.format(f"trim(line, {_SPACES})")} as key from b),
f as (select key, min(doc_id) as first_doc from c where length(key) >= 10 group by key),
g as (select c.*, f.first_doc is not null and f.first_doc <> c.doc_id as gone from c left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from g group by doc_id""",
    "op6_near_dedup": f"""
with recursive a as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w
           from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 2 then [w[1]]
             else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from a),
n as (select doc_id, len(s) as n_shingles, md5(list_sort(s)::varchar) as k from s),
c as (select k, any_value(n_shingles) as n, min(doc_id) as rep from n where n_shingles > 0 group by k),
e as (select c.rep as id, c.n, unnest(s.s) as g from c join s on s.doc_id = c.rep),
p as (select x.id as i, y.id as j, count(*) as both, any_value(x.n) as n1, any_value(y.n) as n2
      from e x join e y on x.g = y.g and x.id < y.id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
      group by x.id, y.id having 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
l as (select i, j from p union select j, i from p),
r(id, root) as (select rep, rep from c union select l.j, r.root from r join l on r.id = l.i where r.root <= l.j),
m as (select id, min(root) as component from r group by id)
select n.doc_id, n_shingles, coalesce(m.component, n.doc_id) as component_id,
       coalesce(m.component, n.doc_id) = n.doc_id as kept
from n left join c on n.k = c.k and n_shingles > 0 left join m on m.id = c.rep""",
    "op8_substring_dedup": """
with a as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
b as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from a),
c as (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as k from b),
f as (select k, min(doc_id) as first_doc from c group by k),
g as (select distinct doc_id, unnest(range(i, i + 13)) as j from c join f using (k) where first_doc < doc_id),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from a),
y as (select x.doc_id, string_agg(word, ' ' order by x.j) filter (where g.j is null) as kept,
             count(*) filter (where g.j is not null) as n_removed
      from x left join g on g.doc_id = x.doc_id and g.j = x.j group by x.doc_id)
select a.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from a left join y using (doc_id)""",
    "op10_suffix_dedup": """
with a as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, h, unnest(range(0, len(h) // 2 - 199)) as i from a),
c as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from b),
f as (select k from c group by k having count(*) > 1),
g as (select doc_id, i from c semi join f using (k)),
-- islands of windows that overlap or touch
o as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as step from g),
p as (select doc_id, i, count(*) filter (where step is null or step > 200) over (partition by doc_id order by i) as island from o),
s as (select doc_id, min(i) as x, max(i) + 200 as y from p group by doc_id, island),
t as (select doc_id, count(*) as n_spans, sum(y - x) as n_removed, list(x order by x) as xs, list(y order by x) as ys from s group by doc_id),
u as (select a.doc_id, h, n_spans, n_removed, xs, ys, len(h) // 2 as n_bytes from a left join t using (doc_id))
select doc_id, n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(case when n_spans is null then h else
           array_to_string([substr(h, 2 * (case when k = 1 then 0 else ys[k - 1] end) + 1,
                            2 * ((case when k > n_spans then n_bytes else xs[k] end) - (case when k = 1 then 0 else ys[k - 1] end)))
                            for k in range(1, n_spans + 2)], '') end)) as kept_sha256
from u""",
    "op9_exact_dedup": f"""
with a as (select doc_id, {_LOWER.format("coalesce(text, '')")} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from a""",
    "op11_filter_audit": """
with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by t) as first_doc from d),
f as (select doc_id, part,
             (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
             + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (first_doc < doc_id)::int as fails from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
      from f left join l using (doc_id) group by part, fails),
x(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
-- letters appended one at a time: every order's steps are its prefixes
o(seq, mask) as (select '', 0 union all select seq || letter, mask | bit from o, x where mask & bit = 0),
s as (select o.seq as filter_order, step::int as step, substr(o.seq, step::int, 1) as letter, p.mask as before
      from o, unnest(range(1, 6)) as r(step), o p where length(o.seq) = 5 and p.seq = substr(o.seq, 1, step::int - 1)),
c as (select part, filter_order, step, letter,
             coalesce(sum(n) filter (where fails & (before | bit) = 0), 0)::bigint as kept,
             coalesce(sum(n) filter (where fails & bit > 0 and fails & before = 0), 0)::bigint as removed,
             coalesce(sum(n) filter (where fails & bit > 0 and fails & before > 0), 0)::bigint as redundant,
             coalesce(sum(n) filter (where fails = bit), 0)::bigint as unique_fails,
             coalesce(sum(good) filter (where fails & bit > 0 and fails & before = 0), 0)::bigint as good_lost,
             coalesce(sum(toxic) filter (where fails & bit > 0 and fails & before = 0), 0)::bigint as toxic_lost
      from m, s join x using (letter) group by part, filter_order, step, letter)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, letter)::bigint as shapley from c""",
}
