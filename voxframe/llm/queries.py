"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import (
    conversation_repair,
    kdtree,
    pareto,
    periodic,
    quality,
    secret_scan,
    sentencepiece_lattice,
    superminhash,
    tokencount,
    toxicity,
    urlfilter,
    warc,
    wavelet,
)
from voxframe.llm.common import read_table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_shards(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return wavelet.token_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).select(
        "doc_id", "start", "n_tokens", wavelet.crc32_of().alias("ids_crc32"))


@query
def op2_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, read_table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", F.col("evidence.doc_id").alias("evidence"))


@query
def op3_sentencepiece(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), merges=True).select(
        "doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip")


@query
def op4_top_k(spark, sf_dir):
    return kdtree.top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLES["op4_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query
def op5_near_duplicates(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return superminhash.near_duplicates(docs, shingle=2).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


@query
def op6_quality_rules(spark, sf_dir):
    return quality.judge_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


ORACLES["op6_quality_rules"] = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
win as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k
  from (select r, w, unnest(generate_series(1, len(w) - 2)) as i from d where len(w) > 2)),
twice as (select r, i from (select r, i, count(*) over (partition by r, k) as c from win) where c > 1),
rep as (
  select r, count(distinct p) as n from (
    select r, i as p from twice union all select r, i + 1 from twice union all select r, i + 2 from twice) group by r),
good as (
  select r, list_filter(list_distinct(lines), lambda x: not (
      len(regexp_extract_all(x, '[|»›•·→]')) * 4 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
      or (len(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '@@PHRASE@@')) > 0
          and len(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '@@PHRASE@@')) * 8
            >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      or len(regexp_extract_all(x, '[#*$%&|<>]')) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * 0.2::double
      or len(regexp_extract_all(x, '!!')) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * 0.2::double
      or (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 30
          and not regexp_matches(x, '[.!?:;…。！？]["''”’»)\]]*([\x20\x09-\x0D]|$)')))) as g
  from d),
s as (
  select doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
    coalesce(length(array_to_string(lines, '')), 0) as all_chars,
    coalesce(length(array_to_string(g, '')), 0) as good_chars
  from d join good using (r) left join rep using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and all_chars - good_chars <= all_chars * 0.5::double as kept,
  (all_chars - good_chars)::bigint as lost_chars
from s
""".replace("@@PHRASE@@", r"(?:^|[^\p{L}\p{N}])(?:cookies?|privacy policy|terms of (?:use|service)|all rights reserved|copyright|licensed under"
           r"|enable javascript|lorem ipsum|click here|sign up|log in|subscribe|powered by|politique de confidentialité|mentions légales"
           r"|conditions d''utilisation|tous droits réservés|cliquez ici|se connecter|abonnez-vous|datenschutzerklärung"
           r"|nutzungsbedingungen|impressum|alle rechte vorbehalten|hier klicken|anmelden|abonnieren|política de privacidad|aviso legal"
           r"|términos de uso|todos los derechos reservados|haga clic aquí|iniciar sesión|suscríbase)(?:$|[^\p{L}\p{N}])")


@query
def op7_warc(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "error")


@query
def op8_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pareto.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_mixing"] = r"""
with raw as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key
  from documents),
d as (select *, row_number() over (partition by source, key) - 1 as copy from raw),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, source_size * 2.0::double as cap,
    [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as w
  from s),
r as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, source is null, source
        rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source is null, source
        rows between current row and unbounded following) as rate,
    row_number() over (order by cap / w, source is null, source) as pos
  from w),
f as (select min(pos) as pos, arg_min(rate, pos) as rate from r where cap > rate * w),
t as (
  select source, source_size, case when f.pos is null or r.pos < f.pos then cap else f.rate * w end as target
  from r cross join f),
p as (
  select *, floor(case when source_size > 0 then target / source_size else 0 end) as sure,
    target - floor(case when source_size > 0 then target / source_size else 0 end) * source_size as missing
  from t),
-- Inclusion in proportion to size: from the largest size down, sizes are certain while their share would be 1 or more.
sizes as (
  select d.source, size, missing, sum(size) as words, sum(size::hugeint * size) as squares
  from d join p on d.source is not distinct from p.source where size > 0 and missing > 0 group by d.source, size, missing),
runs as (
  select *, missing - coalesce(sum(words) over bigger, 0)::double as before,
    (sum(squares) over (partition by source) - coalesce(sum(squares) over bigger, 0))::double as rest
  from sizes window bigger as (partition by source order by size desc rows between unbounded preceding and 1 preceding)),
full_to as (
  select *, min(before * size >= rest) over (partition by source order by size desc rows between unbounded preceding and current row) as is_full
  from runs),
rates as (
  select source, min(size) filter (is_full) as certain, arg_max(before / rest, size) filter (not is_full) as c from full_to group by source),
ranked as (
  select *, case when p > 0 then u * (1 - p) / (u * (1 - p) + (1 - u) * p) else 0 end as rank
  from (
    select doc_id, d.source, size, key, copy, source_size, target, sure, missing,
      case when size <= 0 or missing <= 0 then 0 when size >= certain then 1 else coalesce(c * size, 0) end as p,
      ('0x' || substr(md5('mix:' || key || ':' || copy), 1, 13))::bigint::double / 4503599627370496::double as u
    from d join p on d.source is not distinct from p.source left join rates on d.source is not distinct from rates.source)),
cum as (
  select *, sum(size) over (partition by source order by rank, key, copy rows between unbounded preceding and current row) as cum
  from ranked where p > 0
  union all
  select *, 0 from ranked where p <= 0)
select doc_id, size, source_size, target,
  ((sure + (p > 0 and missing > 0 and (cum <= missing or (cum - size < missing and cum - missing < missing - (cum - size))))::int)
    * size)::bigint as taken
from cum
"""


@query
def op9_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


#: Fixed values of the query: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op10_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, urlfilter.RULE_SCHEMA)
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLES["op10_url_filter"] = r"""
with rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts as (
  select row_number() over () as r, page_id,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
urls as (
  select r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
fits as (
  select r, rhost || rpath as rule, verdict,
    row_number() over (partition by r order by length(rhost || rpath) desc, length(rhost) desc) as k
  from urls join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from urls left join (select * from fits where k = 1) using (r)
"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """The texts of the query: in every document whose digest h ends in 0, the words from a on repeat every p words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    cut = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    g, n = F.expr("h div 10"), F.size("w")
    at = cut.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    changed = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), n - F.col("a")))
    return at.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark, sf_dir):
    found = periodic.find_runs(with_repeats(read_table(spark, sf_dir, "documents")))
    # The first of the runs with the greatest quotient; they come by start, then period.
    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op12_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(k) for k in secret_scan.KINDS])

    def line(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS)],
        F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the query, by a digest of conversation and turn; rows that it drops stay as ``gone``."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


@query
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_conversations(damaged(read_table(spark, sf_dir, "conversations")), gone="gone")
