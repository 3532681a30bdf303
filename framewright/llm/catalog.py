"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bytebpe, collocations, filteraudit, forest, huffman, licenses, linededup, media, mixing, ngramlm, quality, ruleledger, vectors


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(_documents(spark, sf_dir))


def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bytebpe.read_ranks(public_tokenizers.path("word_bpe_49k.json"))
    return huffman.round_trip(_documents(spark, sf_dir), tokenizer, end_id=2, added=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).drop("spans")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_texts(_documents(spark, sf_dir))


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.scored(_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs, F.col("source"), counts=True)


def op9_line_dedup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs, F.col("source"), counts=True, long_ratio=linededup.LONG_RATIO)


def line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of web pages, between their tags, by the host of the page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return linededup.drop_boilerplate(pages, linededup.host_of(F.col("url")), counts=True)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_mixing."""
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3_media."""
    return op3_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6_license_scan."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bytebpe.digests(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleledger.judged(ruleledger.ledger(_documents(spark, sf_dir)), ruleledger.POLICIES[ruleledger.CURRENT])


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps, with and without each of its rules."""
    return ruleledger.ablations(ruleledger.ledger(_documents(spark, sf_dir)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_near_vectors, op2_mixing, op3_media, op4_huffman_ids, op5_quality, op6_license_scan, op7_jaccard_join, op8_ngram_lm, op9_line_dedup, op9_line_dedup_long, op10_byte_bpe, op11_rule_ledger, op12_filter_audit, op13_collocations, rule_ablations, line_dedup_pages, mixing_targets, media_payloads, license_phrases)}

ORACLE_SQL = {
    "op9_line_dedup": """
with l as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
t as (select source, count(*) as pages from l where source is not null group by source),
x as (select distinct doc_id, source, trim(u.line, ' ') as line from l, unnest(l.ls) as u(line) where source is not null),
n as (select source, line, count(*) as n from x where line <> '' group by source, line having count(*) >= 3),
b as (select n.source, list(n.line) as lines from n join t using (source) where n.n > 0.1 * t.pages group by n.source),
k as (select l.doc_id, l.source, l.text, l.ls, b.lines,
  list_filter(l.ls, lambda z: not coalesce(list_contains(b.lines, trim(z, ' ')), false)) as ks
  from l left join b on l.source = b.source)
select doc_id, source, case when lines is null or text is null then text else array_to_string(ks, chr(10)) end as text,
  coalesce(len(ls), 0)::bigint as n_lines,
  (case when lines is null or text is null then 0 else len(ls) - len(ks) end)::bigint as n_dropped
from k""",
}

#: As op9_line_dedup's, with the ratio of long lines.
ORACLE_SQL["op9_line_dedup_long"] = ORACLE_SQL["op9_line_dedup"].replace(
    "n.n > 0.1 * t.pages", r"n.n > (case when len(regexp_extract_all(n.line, '[^ \t\n\x0B\f\r]+')) > 50 then 0.001 else 0.1 end) * t.pages"
)

ORACLE_SQL["line_dedup_pages"] = """
with l as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host, regexp_replace(html, '<[^>]*>', chr(10), 'g') as text from pages),
s as (select page_id, url, nullif(host, '') as host, text, string_split(text, chr(10)) as ls from l),
t as (select host, count(*) as pages from s where host is not null group by host),
x as (select distinct page_id, host, trim(u.line, ' ') as line from s, unnest(s.ls) as u(line) where host is not null),
n as (select host, line, count(*) as n from x where line <> '' group by host, line having count(*) >= 3),
b as (select n.host, list(n.line) as lines from n join t using (host) where n.n > 0.1 * t.pages group by n.host),
k as (select s.page_id, s.url, s.text, s.ls, b.lines, list_filter(s.ls, lambda z: not coalesce(list_contains(b.lines, trim(z, ' ')), false)) as ks from s left join b on s.host = b.host)
select page_id, url, case when lines is null or text is null then text else array_to_string(ks, chr(10)) end as text, coalesce(len(ls), 0)::bigint as n_lines,
  (case when lines is null or text is null then 0 else len(ls) - len(ks) end)::bigint as n_dropped
from k"""

#: Targets are filled like vessels: sources in the order of capacity by weight are full as long as the rest's even share is no less.
ORACLE_SQL["mixing_targets"] = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
p as (select source, sum(size)::bigint as source_size, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from d group by source),
q as (select *, 3 * source_size as capacity, sum(source_size) over () as words, sum(weight) over () as weights,
  coalesce(sum(3 * source_size) over o, 0) as full_words, coalesce(sum(weight) over o, 0) as full_weights
  from p window o as (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, capacity::hugeint * (weights - full_weights) <= (words - full_words)::hugeint * weight as is_full from q),
r as (select *, words - sum(case when is_full then capacity else 0 end) over () as rest_words, weights - sum(case when is_full then weight else 0 end) over () as rest_weights from f)
select d.doc_id, d.size, r.source_size, case when is_full then capacity::double else weight::double * rest_words::double / rest_weights::double end as target
from d join r on d.source is not distinct from r.source"""

ORACLE_SQL["media_payloads"] = r"""
with b as (select doc_id, encode(coalesce(text, '')) as raw from documents),
n as (select doc_id, raw, octet_length(raw)::bigint as n, greatest(1, (octet_length(raw) + 575) // 576) * 576 as full_size from b)
select doc_id, n as n_bytes, full_size::bigint as payload_bytes, sha256(raw || repeat('\xFF'::blob, (full_size - n)::bigint)) as payload_sha256 from n"""

ORACLE_SQL["license_phrases"] = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
p as (select doc_id, ws, list_filter(range(len(ws)), lambda i: ws[i + 1:i + 4] = ['under', 'the', 'mit', 'license']) as m,
  list_filter(range(len(ws)), lambda i: ws[i + 1:i + 4] = ['apache', 'license', 'version', '2']) as a,
  list_filter(range(len(ws)), lambda i: ws[i + 1:i + 3] = ['cc', 'by', 'nc']) as c from w)
select doc_id, len(ws)::bigint as n_words, (len(m) + len(a) + len(c))::bigint as n_base, list_min(m || a || c)::bigint as first_word, list_max(m || a || c)::bigint as last_word,
  array_to_string(list_filter([case when len(a) > 0 then 'apache-2' end, case when len(c) > 0 then 'cc-by-nc' end, case when len(m) > 0 then 'mit' end], lambda x: x is not null), ',') as base_labels
from p"""

_LEDGER = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')) as ls from t),
g as (select *, list_transform(range(greatest(len(ws) - 7, 0)), lambda i: array_to_string(ws[i + 1:i + 8], ' ')) as grams from w),
h as (select *, list_filter(map_entries(histogram_of), lambda e: e.value > 1) as twice from (select *, case when len(grams) > 0 then list_histogram(grams) else map([]::varchar[], []::ubigint[]) end as histogram_of from g)),
m as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  (case when len(twice) = 0 then 0 else len(list_distinct(flatten(list_transform(list_filter(range(len(grams)), lambda i: list_contains(list_transform(twice, lambda e: e.key), grams[i + 1])), lambda i: range(i, i + 8))))) end)::bigint as n_repeat_words,
  len(ls)::bigint as n_lines, len(regexp_extract_all(text, '[A-Z]'))::bigint as n_upper, len(list_filter(ws, lambda x: x[-2:] = '!!'))::bigint as n_shouts, len(list_filter(ws, lambda x: x = '|'))::bigint as n_bars,
  len(list_filter(range(1, len(ws)), lambda i: ws[i + 1] = ws[i]))::bigint as n_echoes from h),
bits as (select *, (BITS)::bigint as bits from m)"""


def _bits(limits: dict[str, int] | None = None) -> str:
    return " + ".join(f"(case when {r.fails.format(limit=(limits or {}).get(name, r.limit))} then {1 << r.bit} else 0 end)" for name, r in ruleledger.RULES.items())


_BASE = sum(1 << ruleledger.RULES[r].bit for r in ruleledger.BASE)
ORACLE_SQL["op11_rule_ledger"] = _LEDGER.replace("BITS", _bits()) + f"""
select *, bits & {_BASE} <> 0 as base_failed, bits & {_BASE | ruleledger.POLICIES[ruleledger.CURRENT].mask()} = 0 as kept from bits"""

ORACLE_SQL["rule_ablations"] = (
    _LEDGER.replace("BITS", _bits())
    + ", u as ("
    + " union all ".join(f"select '{name}' as policy, {p.mask()} as mask, ({_bits(p.limits)})::bigint & {p.mask()} as b from m" for name, p in ruleledger.POLICIES.items())
    + "), r as (select * from (values "
    + ", ".join(f"('{name}', {1 << r.bit}::bigint)" for name, r in ruleledger.RULES.items())
    + """) r(rule, bit))
select policy, rule, count(*)::bigint as n, count_if(b = 0)::bigint as kept, count_if(b & bit <> 0)::bigint as failed, count_if(b = bit)::bigint as only, count_if(b & ~bit = 0)::bigint as kept_without
from u join r on mask & bit <> 0 group by policy, rule"""
)

ORACLE_SQL["op12_filter_audit"] = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
least_id as (select text, min(doc_id) as least from t group by text),
marks as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels where doc_id is not null group by doc_id),
f as (select t.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
d as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  (case when len(ws) < 100 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end
   + case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) then 4 else 0 end + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
   + case when f.doc_id > least then 16 else 0 end)::bigint as bits
  from f join least_id using (text) left join marks using (doc_id)),
c as (select part, good, toxic, bits, count(*) as n from d group by all),
l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(f, b)),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bs from l a, l b, l c, l d, l e where a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, k::int as step, bs[k] as own, coalesce(list_sum(bs[1:k - 1]), 0)::bigint as before from o, range(1, 6) r(k)),
x as (select part, filter_order, step, own,
  coalesce(sum(n) filter (bits & (own | before) = 0), 0)::bigint as kept, coalesce(sum(n) filter (bits & own <> 0 and bits & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (bits & own <> 0 and bits & before <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (bits = own), 0)::bigint as unique_fails,
  coalesce(sum(n) filter (bits & own <> 0 and bits & before = 0 and good = 1), 0)::bigint as good_lost, coalesce(sum(n) filter (bits & own <> 0 and bits & before = 0 and toxic = 1), 0)::bigint as toxic_lost
  from c, s group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from x"""

ORACLE_SQL["op13_collocations"] = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, k, unnest(list_transform(range(len(ws) - k + 1), lambda i: ws[i + 1:i + k])) as ph from w, range(1, 4) r(k) where len(ws) >= k),
f as (select lang, k, ph, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and a >= 10),
cuts as (select c.lang, c.ph, c.k, c.a, i, l.a as l, r.a as r, 1000000::hugeint * c.a * c.a // (l.a::hugeint * r.a) as score from c, range(1, 3) q(i)
  join f l on l.lang = c.lang and l.ph = c.ph[1:i] join f r on r.lang = c.lang and r.ph = c.ph[i + 1:] where i < c.k),
best as (select * from cuts qualify row_number() over (partition by lang, ph order by score, i) = 1),
inner_pairs as (select lang, ph[1:2] as ph, max(a) as longer from c where k = 3 group by all union all select lang, ph[2:3], max(a) from c where k = 3 group by all),
over_pairs as (select lang, ph, max(longer) as longer from inner_pairs group by all),
kept as (select b.* from best b left join over_pairs o on o.lang = b.lang and o.ph = b.ph where b.k = 3 or o.longer is null or 100 * o.longer < 50 * b.a),
ranked as (select lang, array_to_string(ph, ' ') as phrase, a, l, r, score::bigint as score, row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(ph, ' '))) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score from ranked join n using (lang) where rank <= 2000"""
