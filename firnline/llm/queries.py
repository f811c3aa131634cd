"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, chat, collocations, divergence, line_dedup, mixing, packing, quality, secrets, simhash, sp_codec, toxicity, winnowing
from .common import documents


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_pairs(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), model_path())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(documents(spark, sf_dir))
    base, kept = quality.kept_by(quality.BASE), quality.kept_by(quality.PROSE)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & kept).alias("kept"), "failed", "n_lines", "n_upper", "n_letters")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


#: A document with at least this score is toxic.
TOXIC = 0.7


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model | None:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.train(docs, labels.where(~held_out()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "times")


def op7_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_documents(documents(spark, sf_dir), model_path(), with_ids=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.report(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


#: A conversation that holds the strings of the template in its texts.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn int, role string, text string")
    vocabulary = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    trees = chat.format_trees(said.unionByName(own), *vocabulary)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_text", "")
    found = chat.read_back(trees.rows, *vocabulary).select(
        "leaf",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return chat.per_conversation(trees, found)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing": op1_winnowing,
        "op2_packing": op2_packing,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_secrets": op5_secrets,
        "op6_mixing": op6_mixing,
        "op7_chaining": op7_chaining,
        "op8_simhash": op8_simhash,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_line_dedup": op10_line_dedup,
        "op11_collocations": op11_collocations,
        "op12_chat": op12_chat,
        "op13_divergence": op13_divergence,
    }


OP10_SQL = r"""
with lines as (
  select doc_id, source, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos,
         unnest(string_split(text, chr(10))) as raw
  from documents where text is not null),
clean as (select doc_id, source, pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from lines),
named as (select * from clean where line <> ''),
wide as (select line, min((doc_id, pos)) as keep from named group by line having count(distinct source) >= 8),
gone as (
  select doc_id, count(*) as n, string_agg(pos::varchar, ',' order by pos) as removed
  from named join wide using (line) where (doc_id, pos) <> keep group by doc_id)
select d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines,
       coalesce(n, 0)::bigint as n_removed, coalesce(removed, '') as removed_lines
from documents d left join gone using (doc_id)
"""


OP3_SQL = r"""
with base as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
named as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from base) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
windows as (
  select doc_id, k, ws[k] as a, ws[k + 1] as b, ws[k + 2] as c from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) as k from base where len(ws) > 2)),
often as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, a, b, c) as n from windows) where n > 1),
repeated as (select doc_id, count(distinct k + d) as n from often, (values (0), (1), (2)) t(d) group by doc_id),
found as (
  select doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as n_letters
  from base left join named using (doc_id) left join repeated r using (doc_id)),
bits as (
  select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (100 * n_symbols > 20 * n_words)::bigint
         + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint + 16 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint
         + 32 * (100 * n_upper > 50 * n_letters)::bigint as failed from found)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed = 0 as kept, failed,
  n_lines::bigint as n_lines, n_upper::bigint as n_upper, n_letters::bigint as n_letters from bits
"""


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, generate_subscripts(p, 1) as at, unnest(p) as piece
  from (select lang, doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p from documents)),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
grams as (
  select lang, n, array_to_string(ws[k:k + n - 1], ' ') as phrase
  from (select lang, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as k from words, (values (1), (2), (3)) t(n) where len(ws) >= n)),
f as (select lang, n, phrase, count(*)::hugeint as a from grams group by all),
total as (select lang, sum(a)::bigint as n from f where n = 1 group by lang),
candidates as (select lang, n as size, phrase, a, string_split(phrase, ' ') as ws from f where n > 1 and a >= 10),
parts as (
  select *, array_to_string(ws[1:k], ' ') as first_part, array_to_string(ws[k + 1:size], ' ') as second_part
  from (select *, unnest(generate_series(1, size - 1)) as k from candidates)),
cuts as (
  select c.lang, c.phrase, c.size, c.a, k, l.a as l, r.a as r, (1000000::hugeint * c.a * c.a) // (l.a * r.a) as score
  from parts c join f l on l.lang = c.lang and l.phrase = c.first_part join f r on r.lang = c.lang and r.phrase = c.second_part),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, phrase, max(a) as longer from (
    select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase from candidates where size = 3) group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, b.a desc, encode(b.phrase)) as rank
  from best b left join longer o using (lang, phrase) where o.longer is null or 100 * o.longer < 50 * b.a)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join total using (lang) where rank <= 2000
"""


OP12_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked as (
  select *, length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length('### : </turn>' || chr(10)) as chars from said),
whole as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss, sum(chars) as chars
  from marked group by conv_id)
select conv_id, n_turns::bigint as n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, chars::bigint as formatted_chars from whole
"""


OP13_SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts, row_number() over () as id from documents),
words as (select id, lang, source, unnest(ts) as term from docs),
kept as (select lang, term, count(*)::hugeint as times from words group by all having count(distinct id) >= 10),
v as (select lang, count(*)::hugeint as v, sum(times)::hugeint as n from kept group by lang),
counts as (select w.lang, w.source, w.term, count(*)::hugeint as c from words w semi join kept k using (lang, term) group by all),
groups as (select distinct lang, source from docs),
n as (select lang, source, sum(c)::hugeint as n from counts group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) as p, 1 + (1000000000::hugeint * (k.times + 2)) // (v.n + 2 * v.v) as q
  from groups g join kept k on k.lang = g.lang join v on v.lang = g.lang
  left join n on n.lang = g.lang and n.source = g.source left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": OP3_SQL, "op10_line_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_chat": OP12_SQL, "op13_divergence": OP13_SQL}
