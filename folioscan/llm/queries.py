"""The registered queries of this subpackage, op1 to op10, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import decontaminate, exact_dedup, exchange, lm, ngram_join, packing, quality, sharding, substring_dedup, url_filters, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op3_packing(spark, sf_dir):
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op4_url_filters(spark, sf_dir):
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"))


def op5_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.linked_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_lm_score(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), every_row=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), exchange.shared_path(spark, "warc"))


def op10_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.topology(8), sharding.topology(9))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_packing, op4_url_filters, op5_quality, op6_ngram_join, op7_lm_score, op8_decontaminate, op9_warc, op10_sharding)}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 19], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) r from win) where r > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) p from rep),
word as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) t, count(*) n from word anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (doc_id)""",
    "op2_exact_dedup": """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) keep_id, count(*) over (partition by coalesce(text, '')) group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) kept, sha256(coalesce(text, '')) text_sha256
from documents""",
    "op4_url_filters": r"""
with rules(verdict, rule, h, p) as (values ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
s as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from u),
m as (select page_id, host, path, rule, verdict, row_number() over (partition by page_id order by length(rule) desc nulls last) r
  from s left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from m where r = 1""",
    "op6_ngram_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) >= 4 then array_to_string(w[i : i + 3], ' ') else array_to_string(w, ' ') end k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
pair as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
link as (select x, y from pair join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
edge as (select x, y from link union all select y, x from link),
reach(doc_id, node) as (select doc_id, doc_id from documents union select reach.doc_id, edge.y from reach join edge on reach.node = edge.x)
select d.doc_id, coalesce(n.n, 0) n_shingles, min(node) component_id from d left join n using (doc_id) join reach using (doc_id) group by d.doc_id, n.n""",
    "op8_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 8) l, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') k from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) i from b where len(w) > 0)),
dw as (select doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') k from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, (select distinct l from bw) where len(w) >= l)),
m as (select doc_id, i, dw.l, item_id from dw join bw using (l, k)),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from m) group by doc_id),
t as (select doc_id, count(distinct item_id) n_items, sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) s from m group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(s, sha256('')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join h using (doc_id) left join t using (doc_id)""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
f as (select *, min(page_id) over (partition by h) first from p)
select page_id, cast(strlen(h) as bigint) payload_bytes, sha256(h) payload_digest,
  case when strlen(h) >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
  case when strlen(h) >= 100 and page_id <> first then first end refers_to
from f""",
}
