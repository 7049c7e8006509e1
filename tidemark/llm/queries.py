"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import collocations, curriculum, lines, manifest, pieces, pseudonyms, quality, routed_search, setsketch, shards, substrings, threshold, urls
from tidemark.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Production parameters.
PSEUDONYM_KEY = "tidemark-pseudonyms-1"
MODEL = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and its SQL."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op9_pii_pseudonyms")
def op9(spark, sf_dir):
    """Every document with personal values permuted, and how many were."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return pseudonyms.pseudonymised(docs, PSEUDONYM_KEY, found="n_found")


@F.arrow_udf(T.StringType())
def _ids_sha256(ids: pa.Array) -> pa.Array:
    """SHA-256 of ids as little-endian unsigned 32-bit integers."""
    flat, starts = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
    return pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(starts[:-1], starts[1:])], pa.string())


@query("op10_subword_encoding")
def op10(spark, sf_dir):
    """Token counts and digests of ids and decoded text for every document."""
    import public_tokenizers

    model = pieces.read_model(public_tokenizers.path(MODEL))
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    both = pieces.encode(docs, model, decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _ids_sha256("ids").alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    """A calibrated quality score for every document."""
    docs, labels = read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.train_and_score(docs, labels)[0]


# Brute force: every pair that shares a shingle, and a walk over the links.
NEAR_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (select doc_id, unnest(case when coalesce(len(ws), 0) = 0 then []::varchar[] when len(ws) = 1 then ws
        else list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
e as (
  select a.doc_id as u, b.doc_id as v from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways as (select u, v from e union all select v, u from e),
walk as (select doc_id as d, doc_id as r from documents union select v, r from walk join both_ways on u = d),
least_id as (select d, min(r) as c from walk group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, doc_id = c as kept
from documents left join n using (doc_id) join least_id on d = doc_id"""


@query("op2_minhash_near_dedup", NEAR_SQL)
def op2(spark, sf_dir):
    """Near-duplicate component of every document over 2-word shingles."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return setsketch.near_duplicates(docs, shingle_words=2)


@query("op4_shards")
def op4(spark, sf_dir):
    """All documents in 24 shards of nearly equal bytes."""
    out = shards.sharded(read_table(spark, sf_dir, "documents", "doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(concat_ws('|', doc_id::varchar, md5(coalesce(text, '')))) as draw from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
r as (select *, (row_number() over (order by source is null, source) - 1) % 3 as place, source_size * 3e0 as cap from s),
q as (select *, (place + 1)::double as weight, cap / (place + 1)::double as ratio from r),
f as (
  select *, coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0e0) as cap_to,
         sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as weight_from,
         (sum(source_size) over ())::double as total from q),
l as (select arg_min((total - cap_to) / weight_from, ratio) as level from f where (total - cap_to) / weight_from <= ratio),
t as (select source, place, source_size, least(cap, (select level from l) * weight) as target from f),
p as (
  select d.doc_id, d.size, t.source_size, t.target, t.place,
         coalesce(sum(d.size) over (partition by d.source order by d.draw, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start,
         floor(t.target / nullif(t.source_size, 0))::bigint as passes
  from d join t on d.source is not distinct from t.source),
t2 as (
  select *, coalesce(size * passes + greatest(0, least(size, floor(target)::bigint - passes * source_size - start)), 0)::bigint as taken,
         least(start / nullif(target, 0), 1e0) as u from p)
-- Position: inverse of the integrated schedules of early, even and late sources.
select doc_id, size, source_size, target, taken, case when taken > 0 then round(case place
  when 0 then 2e0 * u / (15e-1 + sqrt(greatest(225e-2 - 2e0 * u, 0e0)))
  when 1 then u
  else case when u <= 3125e-4 / 9375e-4
    then 2e0 * u / (5e-1 / 9375e-4 + sqrt(pow(5e-1 / 9375e-4, 2) + 2e0 * (25e-2 / 9375e-4 / 5e-1) * u))
    else 5e-1 + 2e0 * (u - 3125e-4 / 9375e-4) / (75e-2 / 9375e-4 + sqrt(pow(75e-2 / 9375e-4, 2) + 2e0 * (1e0 / 9375e-4 / 5e-1) * (u - 3125e-4 / 9375e-4))) end
  end, 9) end as position
from t2"""


@query("op5_curriculum_mixing", MIX_SQL)
def op5(spark, sf_dir):
    """How many words of every document the mix takes, and where in training its first word stands."""
    out = curriculum.mixed(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


@query("op7_routed_search")
def op7(spark, sf_dir):
    """The 20 nearest found of every twentieth vector."""
    vectors = routed_search.measured(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return routed_search.search(vectors, vectors.where("id % 20 = 0"), 20)


TOP_SQL = r"""
with v as (
  select vec_id as id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (
  select q.id as query_id, c.id as vec_id,
         list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
  from v q join v c on q.id % 50 = 0 and q.id <> c.id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from p qualify rank <= 5"""


@query("op8_threshold_top_k", TOP_SQL)
def op8(spark, sf_dir):
    """The 5 largest integer inner products of every fiftieth vector."""
    vectors = threshold.scaled(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return threshold.top_k(vectors, vectors.where("id % 50 = 0"), 5)


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query("op3_url_templates")
def op3(spark, sf_dir):
    """Verdict of every page's URL by rule or template."""
    out = urls.judged(read_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


REPEAT_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, unnest(range(1, len(ws) - 18)) as i, ws from w where len(ws) >= 20),
g as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as win from p),
f as (select *, row_number() over (partition by win order by doc_id, i) as k from g),
c as (select distinct doc_id, i + j as pos from f, range(0, 20) r(j) where k > 1),
x as (select doc_id, list(pos) as gone from c group by 1),
kept as (
  select w.doc_id, len(ws) as n_words, coalesce(len(gone), 0) as n_removed,
         case when gone is null then ws else [ws[i] for i in range(1, len(ws) + 1) if not list_contains(gone, i)] end as ks
  from w left join x using (doc_id))
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(ks, ' ')) as kept_sha256 from kept"""


@query("op6_repeated_passages", REPEAT_SQL)
def op6(spark, sf_dir):
    """What is left of every document without the words of passages that start earlier."""
    out = substrings.without_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


# Brute force: every level of every source's tree, then the path of every leaf step by step. The CRC is the
# reflected polynomial applied bit by bit: a character, then eight shifts (-1).
MERKLE_SQL = r"""
with recursive d as (
  select doc_id, source, lang, n_chars, text, coalesce(xor(list_reduce(
      list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_prepend(ascii(c)::bigint, [-1::bigint for i in range(8)])))),
      lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 5 = 0, false) as bad from documents),
f as (
  select doc_id, source, bad, unnest([text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')]) as t, unnest([0, 1]) as which, lang, n_chars from d),
h as (
  select doc_id, source, bad, which, sha256(concat(
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-'), coalesce(strlen(t) || ':' || t, '-'))) as h from f),
l as (select doc_id, source, max(h) filter (which = 0) as leaf, max(h) filter (which = bad::int) as folded from h group by 1, 2),
s as (select source, count(*) as n, row_number() over (order by source is not null, source) - 1 as tree from l group by 1),
p as (select doc_id, tree, n, row_number() over (partition by tree order by doc_id is not null, doc_id) - 1 as pos, leaf, folded from l join s on l.source is not distinct from s.source),
low as (
  select tree, 0 as level, pos, n, leaf as h from p
  union all
  select tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from low where n > 1 group by tree, level, pos // 16, n),
up as (
  select -1::bigint as tree, 0 as level, tree as pos, (select count(*) from s) as n, h from low where n = 1
  union all
  select tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by tree, level, pos // 16, n),
runs as (select tree, level, pos // 16 as run, list(h order by pos) as hs from (from low union all from up) where n > 1 group by all),
climb as (
  select doc_id, tree, 0 as level, pos, n, folded, '' as proof, tree as home from p
  union all
  select doc_id, case when top then -1 else c.tree end, case when top then 0 else c.level + 1 end, case when top then c.tree else c.pos // 16 end,
         case when top then (select count(*) from s) else (c.n + 15) // 16 end,
         case when top then c.folded else sha256(array_to_string(list_transform(hs, lambda x, i: case when i = c.pos % 16 + 1 then c.folded else x end), '')) end,
         case when top then c.proof else c.proof || array_to_string([x for x, i in hs if i <> c.pos % 16 + 1], '') end, home
  from (select *, n = 1 as top from climb where n > 1 or tree >= 0) c left join runs r on not top and r.tree = c.tree and r.level = c.level and r.run = c.pos // 16)
select p.doc_id, leaf, low.h as subroot, up.h as root, sha256(proof) as proof_sha256, climb.folded as folded_root, climb.folded = up.h as verified
from p join climb on climb.doc_id is not distinct from p.doc_id and climb.home = p.tree and climb.tree = -1 and climb.n = 1
join low on low.tree = p.tree and low.n = 1 join up on up.n = 1"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark, sf_dir):
    """Leaf, roots, proof and the check of every document against the root."""
    out = manifest.proofs(read_table(spark, sf_dir, "documents", *manifest.FIELDS))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


LINES_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d),
k as (select doc_id, i, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, max(doc_id) as stays from k where length(key) >= 40 group by 1 having count(distinct doc_id) >= 5),
g as (select doc_id, list(i) as gone from k join c using (key) where doc_id <> stays group by 1)
select d.doc_id, len(ls)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_dropped,
       sha256(array_to_string(case when gone is null then ls else [x for x, i in ls if not list_contains(gone, i)] end, chr(10))) as kept_sha256
from d left join g using (doc_id)"""


@query("op13_repeated_lines", LINES_SQL)
def op13(spark, sf_dir):
    """What is left of every document without lines that stand in five documents or more."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    out = lines.kept_lines(docs, lines.keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


PHRASE_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?
-]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^ 	]+') as ws from p),
t as (select lang, sum(len(ws))::bigint as n from w group by 1),
g as (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, range(1, 5) r(k)),
f as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, any_value(ws[i:i + k - 1]) as words, count(*)::bigint as a from g group by 1, 2, 3 having count(*) >= 30),
x as (select lang, phrase, words, a, k, unnest(range(1, k)) as cut from f where k > 1),
s as (
  select x.lang, x.phrase, x.a, cut, l.a as l, r.a as r, ((2000000::hugeint * x.a) // (l.a + r.a))::bigint as score
  from x join f l on l.lang = x.lang and l.phrase = array_to_string(x.words[1:cut], ' ') join f r on r.lang = x.lang and r.phrase = array_to_string(x.words[cut + 1:], ' ')),
c as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
q as (select lang, words, a, k, unnest(range(2, k)) as m from f where k > 2),
o as (select lang, array_to_string(words[i:i + m - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, k - m + 2)) as i from q) group by 1, 2),
b as (
  select c.*, row_number() over (partition by c.lang order by score desc, a desc, c.phrase) as rank
  from c left join o on o.lang = c.lang and o.phrase = c.phrase where longer is null or 100::hugeint * longer < 80::hugeint * a)
select lang, rank::bigint as rank, phrase, a, l, r, n, score from b join t using (lang) where rank <= 2000"""


@query("op11_collocations", PHRASE_SQL)
def op11(spark, sf_dir):
    """The 2,000 best phrases of every language, with the counts behind their score."""
    return collocations.collocations(read_table(spark, sf_dir, "documents", "lang", "text"))
