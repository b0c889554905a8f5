"""Queries of the training-data operators over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.llm import bpe, containment, langid, negatives, ngram_join, packing, phrases, quality, secrets, simhash, substrings, token_counts, toxicity
from latticeframe.llm.common import table
from latticeframe.plans.lineage import shared_dir


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_tokens(table(spark, sf_dir, "documents"))
    return packed.select("shard", "pack", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens", "position_resets", F.sha2("ids", 256).alias("ids_sha256"))


def op2_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_confirmed")


def op3_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), store).withColumn("over_limit", F.col("n_tokens") > 512)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op5_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = toxicity.train_chain(docs, labels, categories)
    return toxicity.score_chain(docs, chain, list(categories)).withColumn("toxic", F.col("p_toxic") >= 0.4)  # nearest to equal recall and precision on held-out labels


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, langs, model)
    shares = F.transform(F.array_sort(F.map_entries("proportions")), lambda e: F.concat(e["key"], F.lit(":"), F.format_number(e["value"], 3)))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_languages", F.array_join(shares, ",").alias("proportions"))


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


QUALITY_SQL = r"""
with base as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i+4], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from base where len(ws) >= 5)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, count(distinct i + k) n from rep cross join (select unnest(range(5)) k) group by doc_id),
lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from base),
m as (select b.doc_id, b.source, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words
  from base b join lines using (doc_id) left join cov c using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m),
hosts as (select source, count(*) n, count(*) filter (where base_failed or 10 * n_symbols > 3 * n_words or 2 * n_dup_lines > n_words) failed from f group by source),
sums as (select count(*) h, sum(n)::double docs, sum(failed)::double failed, sum(n * n)::double squares, sum(failed * failed / n) between_hosts from hosts),
fit as (select *, failed / docs mean, docs - squares / docs - (h - 1) free from sums),
prior as (select case when free <> 0 and failed > 0 and failed < docs
  then 1 / least(greatest(((between_hosts - failed * mean) / (mean * (1 - mean)) - (h - 1)) / free, 1e-6), 0.999) - 1 else 2.0 end w,
  case when free <> 0 and failed > 0 and failed < docs then mean else 0.5 end mean from fit),
rates as (select source, n, w, (failed + w * mean) / (n + w) rate from hosts cross join prior),
verdicts as (select source, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + w + 1)) > 0.5 rejected from rates)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected kept, round(rate, 6) host_rate
  from f join verdicts v on v.source is not distinct from f.source
"""

CONTAINMENT_SQL = r"""
with texts as (select doc_id id, text, 0 kind from documents union all select item_id, text, 1 from benchmark),
words as (select id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from texts),
sh as (select distinct id, kind, array_to_string(ws[i:i+4], ' ') g from (select *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from words where len(ws) > 0)),
items as (select id, g, count(*) over (partition by id) n from sh where kind = 1),
met as (select d.id doc_id, i.id item_id, count(*) n_shared, max(n)::bigint n_shingles from sh d join items i using (g) where d.kind = 0 group by 1, 2)
select doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles containment from met where n_shared / n_shingles >= 0.8
"""


PHRASES_SQL = r"""
with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) p from documents),
ws as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces),
grams as (select lang, k, array_to_string(w[i:i+k-1], ' ') phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from ws cross join (select unnest(range(1, 6)) k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) a from grams group by 1, 2, 3),
total as (select lang, sum(a)::hugeint n from f where k = 1 group by 1),
cand as (select * from f where k > 1 and a >= 100),
dropped as (select distinct c.lang, c.phrase from cand c join cand d on c.lang = d.lang and d.k > c.k and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') and 100 * d.a >= 100 * c.a),
cuts as (select lang, phrase, a, j, array_to_string(w[:j], ' ') one, array_to_string(w[j+1:], ' ') two from (select *, string_split(phrase, ' ') w, unnest(range(1, k)) j from cand anti join dropped using (lang, phrase))),
scored as (select c.lang, c.phrase, c.a, j, x.a l, y.a r, n, (1000 * c.a::hugeint * n) // (x.a::hugeint * y.a) score from cuts c join f x on x.lang = c.lang and x.phrase = one join f y on y.lang = c.lang and y.phrase = two join total t on t.lang = c.lang),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from low)
select lang, rank, phrase, a, l, r, n::bigint n, score::bigint score from ranked where rank <= 2000
"""


JACCARD_SQL = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i:i+2], ' ') g from (select *, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) i from words where len(ws) > 0)),
n as materialized (select doc_id, count(*) n from sh group by 1),
ranked as (select doc_id, g, row_number() over (partition by doc_id order by c, g) r from sh join (select g, count(*) c from sh group by 1) using (g)),
front as (select k.doc_id, g, n from ranked k join n using (doc_id) where r <= n - (90 * n + 99) // 100 + 1),
cand as (select distinct a.doc_id u, b.doc_id v from front a join front b using (g) where a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
met as (select u, v, count(*) c from cand join sh a on a.doc_id = u join sh b on b.doc_id = v and a.g = b.g group by 1, 2),
linked as materialized (select u, v from met join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 90 * (x.n + y.n - c)),
edges as materialized (select u, v from linked union all select v, u from linked),
cc(doc_id, least) using key (doc_id) as (select doc_id, doc_id from documents union
  select e.v, min(c.least) from cc c join edges e on e.u = c.doc_id join recurring.cc o on o.doc_id = e.v group by e.v, o.least having min(c.least) < o.least)
select doc_id, coalesce(n, 0) n_shingles, least component_id from cc left join n using (doc_id)
"""

NEGATIVES_SQL = """
with v as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id anchor, b.id other, a.label = b.label alike, list_dot_product(a.e, b.e)::bigint score from v a join v b on a.id % 50 = 0 and a.id <> b.id),
pos as (select anchor, other positive, score from s where alike qualify row_number() over (partition by anchor order by score desc, other) <= 5),
neg as (select s.anchor, positive, pos.score high, other, s.score from s join pos using (anchor) where not alike and 50 * pos.score <= 100 * s.score and 100 * s.score <= 95 * pos.score),
ranked as (select *, row_number() over (partition by anchor, positive order by score desc, other) rank from neg)
select anchor anchor_id, positive positive_id, rank::int rank, other negative_id, high positive_score, score negative_score from ranked where rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_jaccard_join": JACCARD_SQL, "op13_hard_negatives": NEGATIVES_SQL, "op11_phrases": PHRASES_SQL, "op4_quality_rules": QUALITY_SQL, "op5_contained_items": CONTAINMENT_SQL}
