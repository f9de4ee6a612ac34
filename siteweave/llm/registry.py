"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, encoding, language, lexical, mixing, neighbours, pii, secrets, simhash, spans, token_counts, warc
from .common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKEN_LIMIT = 512


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id"
    )


#: A conversation about the template's own control strings.
CONTROL_TALK = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(CONTROL_TALK, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_turns(turns, BYTE_RANKS, token_counts.PATTERN), BYTE_RANKS, token_counts.PATTERN)


OP2_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, length(regexp_replace(
    text, '([\[<])(␛*)(INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|/TURN\])', '\1\2␛\3', 'g')) as n
  from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(n + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 15 else 20 + length(role) end)::bigint as formatted_chars
from e group by conv_id
"""


def _digest(found, kinds):
    """The columns that both span queries return: a count per base kind, a hash and all spans."""
    return found.select(
        F.col("id").alias("doc_id"),
        *[spans.count_kind(F.col("base"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(spans.as_text(F.col("base")), 256).alias("base_sha256"),
        spans.as_text(F.concat("base", "added")).alias("spans"),
    )


def op3_secrets(spark, sf_dir):
    return _digest(secrets.find_secrets(table(spark, sf_dir, "documents")), ["assign", "access", "hex"])


def op4_pii(spark, sf_dir):
    return _digest(pii.find_pii(table(spark, sf_dir, "documents")), ["email", "ip", "card", "phone"])


def op5_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits"))


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, BYTE_BPE).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scorer = language.learn(docs.where(language.fold() != 2), PIECE_MODEL)
    held_out = F.coalesce(language.fold() == 2, F.lit(False))
    found = language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), scorer)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op9_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoding.encode(docs, PIECE_MODEL).select("doc_id", "encoded.*")


def op10_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_mix(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


def op13_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {
        "op1_simhash": op1_simhash,
        "op2_chat": op2_chat,
        "op3_secrets": op3_secrets,
        "op4_pii": op4_pii,
        "op5_decontaminate": op5_decontaminate,
        "op6_warc": op6_warc,
        "op7_token_counts": op7_token_counts,
        "op8_language": op8_language,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_neighbours": op10_neighbours,
        "op11_divergence": op11_divergence,
        "op12_mix": op12_mix,
        "op13_search": op13_search,
    }


def _found_sql(kind, rank, pattern, keep):
    """SQL for the spans of one pattern: leftmost non-overlapping matches, the gaps between them, and a filter on a match."""
    pattern = pattern.replace("'", "''")
    return f"""
  select doc_id, {rank} as rank, '{kind}' as kind, p0 as s, p0 + length(m) as e from (
    select doc_id, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(gaps[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0))) as p0
    from (
      select doc_id, regexp_extract_all(x, '{pattern}') as ms, regexp_split_to_array(x, '{pattern}') as gaps from t))
  where {keep}"""


_GROUP = "regexp_extract(m, '{}', 2)".format(secrets.ASSIGN.replace("'", "''"))
OP3_SQL = f"""
with t as (select doc_id, coalesce(text, '') as x from documents),
b as ({_found_sql("assign", 0, secrets.ASSIGN, f"length({_GROUP}) >= 6")}
  union all {_found_sql("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
  union all {_found_sql("hex", 2, "[0-9a-f]+", "length(m) >= 24")}),
wk as ({_found_sql("weak_id", 3, secrets.WEAK["weak_id"], "true")}
  union all {_found_sql("weak_secret", 4, "[A-Za-z0-9+/=_-]+", "regexp_full_match(m, '[A-Za-z0-9+/]{40}')")}
  union all {_found_sql("endpoint", 5, secrets.WEAK["endpoint"], "true")}),
w as (select * from wk where not exists (select 1 from b where b.doc_id = wk.doc_id and b.s < wk.e and wk.s < b.e)),
o as (
  select *, case when kind in ('access', 'weak_id') then 'id' when kind = 'endpoint' then 'endpoint' else 'secret' end as role
  from (select * from b union all select * from w)),
n as (
  select w.doc_id, w.rank, w.kind, w.s, w.e, bool_or(role = 'id') as by_id, bool_or(role = 'secret') as by_secret
  from w join o on w.doc_id = o.doc_id and o.s - w.e <= {secrets.SCOPE} and w.s - o.e <= {secrets.SCOPE} group by all),
a as (
  select doc_id, rank, kind, s, e from b
  union all
  select doc_id, rank, kind, s, e from n
  where (kind = 'weak_secret' and by_id) or (kind = 'weak_id' and by_secret) or (kind = 'endpoint' and by_id and by_secret)),
g as (
  select doc_id, count_if(kind = 'assign') as n_assign, count_if(kind = 'access') as n_access, count_if(kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where rank < 3) as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans
  from a group by 1)
select t.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join g on t.doc_id = g.doc_id
"""

OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(encode(html)) as payload_digest from p),
f as (select payload_digest, max(page_id) as first from d where payload_bytes >= 1000 group by 1 having count(*) > 1)
select page_id, payload_bytes, payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       nullif(first, page_id) as refers_to
from d left join f using (payload_digest)
"""


#: A-Z lowered and nothing else, as SQL.
_FOLDED = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP11_SQL = rf"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
c as (
  select lang, source, term, sum(n)::hugeint as n, count(*) as docs
  from (select id, lang, source, term, count(*) as n
    from (select row_number() over () as id, lang, source, ts from d), unnest(ts) as u(term) group by all)
  group by all),
k as (
  select lang, term, sum(n)::hugeint as n from c group by all having sum(docs) >= {divergence.LEAST_DOCS}),
g as (select distinct lang, source from d),
v as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n, k.n as all_n
  from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
t as (select *, sum(n) over s as total, sum(all_n) over s as all_total, count(*) over s as v from v window s as (partition by lang, source)),
p as (
  select *, 1 + {divergence.SCALE}::hugeint * (n + 2) // (total + 2 * v)::hugeint as p,
    1 + {divergence.SCALE}::hugeint * (all_n + 2) // (all_total + 2 * v)::hugeint as q
  from t),
pair as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pair x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q),
r as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::integer as rank
from r where part = 'pair' or rank <= {divergence.TOP}
"""

OP13_SQL = rf"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
n as (select row, doc_id, len(ts)::bigint as n from d where len(ts) > 0),
s as (select count(*)::bigint as docs, sum(n)::bigint as total from n),
q as (
  select distinct item_id, unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
tf as (
  select row, term, count(*)::bigint as tf from (select row, unnest(ts) as term from d)
  where term in (select term from q) group by all),
w as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::double))::bigint as w from tf, s group by term),
x as (
  select tf.term, n.doc_id, n.row, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + 50 * n.n * s.docs // s.total))) as x
  from tf join n using (row) join w on w.term = tf.term, s),
r as (
  select q.item_id, x.row, x.doc_id, sum(x.x)::bigint as score from q join x on x.term = q.term group by all having sum(x.x) > 0)
select item_id, rank::integer as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r) where rank <= {lexical.TOP}
"""


def oracle_sql():
    return {"op2_chat": OP2_SQL, "op3_secrets": OP3_SQL, "op6_warc": OP6_SQL, "op11_divergence": OP11_SQL, "op13_search": OP13_SQL}
