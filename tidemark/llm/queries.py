"""The registered queries of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folder of the public tokenizer files; read by the driver only.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, predict_language

    docs = _table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out()).select("doc_id", "text", "lang")
    found = predict_language(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_text import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import score_documents

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return score_documents(_table(spark, sf_dir, "documents"), held_out)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import attribute_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = attribute_tokens(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", rule="start")
    return found.select("doc_id", "n_tokens", "n_crossing", F.size("section_tokens").cast("long").alias("n_sections"), F.col("section_tokens").cast("array<long>").alias("section_tokens"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_windows, read_back

    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select -7L conv_id, 0L turn, 'user' role, '{said}' text union all select -7L, 1L, 'assistant', '{said}'")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_windows(turns))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), sha("turns").alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                       sha("loss").alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
with recursive rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), counted as (
  select *, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\x00-\x20]')) + 4 as tokens,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from rows
), escaped as (
  select *, pos = 1 and role = 'system' as leads,
    sum(tokens) over (partition by conv_id order by pos) - tokens as start0,
    23 + length(replace(role, '~', '~0')) + len(regexp_extract_all(role, '<(/?s>|</?SYS>>)|\[/?INST\]'))
       + length(replace(text, '~', '~0')) + len(regexp_extract_all(text, '<(/?s>|</?SYS>>)|\[/?INST\]')) as chars from counted
), sized as (
  select *, 1024 - coalesce(max(case when leads then tokens end) over (partition by conv_id), 0) as room from escaped
), placed as (
  select *, case when leads then 0 else start0 - (1024 - room) end as start, case when leads then 0 else start0 - (1024 - room) + tokens end as stop,
    (case when leads then 0 else start0 - (1024 - room) end) // 16384 as stretch from sized
), based as (
  select p.conv_id, p.pos, p.stretch, p.start, p.room, coalesce(min(q.start), p.start) as base, coalesce(min(q.pos), p.pos) as low from placed p
  left join placed q on q.conv_id is not distinct from p.conv_id and q.pos between p.pos - 2 and p.pos - 1 and not q.leads
    and p.start - q.start <= least(256, p.room - (p.stop - p.start)) group by p.conv_id, p.pos, p.stretch, p.start, p.room
), follow as (
  select b.conv_id, b.pos, b.low, min(q.pos) as next from based b left join placed q on q.conv_id is not distinct from b.conv_id and q.pos > b.pos
    and (q.stop > b.base + b.room or q.stretch > b.stretch) group by b.conv_id, b.pos, b.low
), windows as (
  select conv_id, pos, low, next from follow where pos = 1
  union all select f.conv_id, f.pos, f.low, f.next from windows w join follow f on f.conv_id is not distinct from w.conv_id and f.pos = w.next
), written as (
  select w.conv_id, sum(p.chars) as chars from windows w join placed p on p.conv_id is not distinct from w.conv_id
    and ((p.pos >= w.low and (w.next is null or p.pos < w.next)) or (p.leads and w.pos > 1)) group by 1
)
select p.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
  max(w.chars)::bigint as formatted_chars
from placed p join written w on w.conv_id is not distinct from p.conv_id group by 1
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # More even than any natural mix of the tables, within four uses of one source for each of another.
    return mix_sources(docs, entropy_share=0.99999, most_repeats=4.0).select("doc_id", "source", F.col("pass").alias("pass_no"), "block", "place")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_tree import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece import encode_and_check

    found = encode_and_check(_table(spark, sf_dir, "documents").select("doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), "round_trip")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    cut = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


WHITE = r"[\x20\x09-\x0D]+"


def _with_tails(docs: DataFrame) -> DataFrame:
    """Every tenth document or so by its id ends in a repeated passage."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.filter(F.split("text", WHITE), lambda w: w != "")
    n = F.size("words").cast("long")
    docs = docs.withColumn("g", g).withColumn("words", F.when(h % 10 == 0, words))
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    start, size, left = (x.cast("int") for x in (F.col("a"), F.col("p"), n - F.col("a")))
    passage = F.slice("words", start + 1, size)
    tail = F.slice(F.flatten(F.array_repeat(passage, F.ceil(left / size).cast("int"))), F.lit(1), left)
    whole = F.array_join(F.concat(F.slice("words", F.lit(1), start), tail), " ")
    return docs.withColumn("text", F.coalesce(whole, "text")).drop("g", "words", "a", "p")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import find_runs

    found = find_runs(_with_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")), least=6, exponent=4)
    # Greatest length / period in whole numbers, then smallest start, then smallest period.
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", "n_runs", best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed_text")).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")


def op12_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_repeats import remove_shared_bytes

    cut = remove_shared_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def _damaged(turns: DataFrame) -> DataFrame:
    """Turns are dropped, emptied, cut, repeated or given to the user by a hash of their place."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    h = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    turns = turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(said[2]).alias("role"),
                         F.when(h == 1, "").when(h == 2, F.regexp_replace(said[3], "[.!?]", "")).otherwise(said[3]).alias("text"), h.alias("h"))
    copies = F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)
    return turns.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("h", "copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import COUNTS, repair

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, repaired = repair(_damaged(turns))
    line = F.struct("part", "block", "at", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line), "\n")
    texts = repaired.groupBy("conv_id").agg(F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    numbers = ("gaps", *COUNTS, "cost")
    whole = turns.select("conv_id").distinct().unionByName(found, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True).groupBy("conv_id")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return whole.agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_near_vectors, op2_language, op3_near_text, op4_brown, op5_token_counts, op6_chat, op7_mixing, op8_ann, op9_pieces, op10_repeats, op11_runs, op12_bytes, op13_repair)}
REACH = """
reach(id, root) as (
  select id, id from nodes union select l.y, r.root from reach r join (select a as x, b as y from links union all select b, a from links) l on l.x = r.id
), named as (select id, min(root) as root from reach group by 1)"""

OP1_SQL = f"""
with recursive rows as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null and len(embedding) > 0
), width as (select max(len(e)) as n from rows), valid as (
  select vec_id, list_resize(e, (select n from width), 0) as e from rows where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), sized as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from valid),
links as (select a.vec_id as a, b.vec_id as b from sized a join sized b on a.vec_id < b.vec_id and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
nodes as (select a as id from links union select b from links),
{REACH}, counted as (select id, count(*) as n from (select a as id from links union all select b from links) group by 1)
select v.vec_id, coalesce(c.n, 0) as n_links, coalesce(m.root, v.vec_id) as component_id, coalesce(m.root, v.vec_id) = v.vec_id as kept
from embeddings v left join counted c on c.id = v.vec_id left join named m on m.id = v.vec_id
"""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
with recursive w as (select doc_id, {WORDS.format(FOLDED)} as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end) as x from w
), n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
nodes as (select a as id from links union select b from links),
{REACH}
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.root, w.doc_id) as component_id, coalesce(m.root, w.doc_id) = w.doc_id as kept
from w left join n on n.doc_id = w.doc_id left join named m on m.id = w.doc_id
"""

OP10_SQL = f"""
with w as (select doc_id, {WORDS.format("coalesce(text, '')")} as ws from documents),
windows as (select doc_id, unnest(range(1, len(ws) - 11)) as first, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i : i + 12], ' '))) as x from w where len(ws) >= 13),
hits as (select doc_id, first from (select doc_id, first, min(doc_id) over (partition by x) as low from windows) where low < doc_id),
gone as (select distinct doc_id, first + k as pos from hits, range(13) r(k)),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as pos, unnest(ws) as word from w),
kept as (select doc_id, string_agg(word, ' ' order by pos) as text, count(*) as n from words anti join gone using (doc_id, pos) group by 1)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from w left join kept k using (doc_id)
"""

#: CRC-32 as SQL: the table of 256 values follows from the polynomial, each character of the text x is then one look-up.
CRC_TABLE = "crc as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) order by i) as tab from range(256) r(i))"
CRC = "xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda ch: ascii(ch)::bigint), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"

OP11_SQL = f"""
with {CRC_TABLE},
plain as (select row_number() over () as row, doc_id, {WORDS.format("coalesce(text, '')")} as ws, {CRC.format("coalesce(doc_id::varchar, '')")} as h from documents, crc),
sized as (select *, len(ws) as n, h // 10 as g, case when len(ws) > 0 then (h // 10) % len(ws) end as a from plain),
cut as (select *, 1 + (n - a) // (3 + g % 8) as p from sized),
docs as (
  select row, doc_id, n, case when doc_id is null or h % 10 <> 0 or n = 0 then ws else list_transform(range(0, n), lambda i: case when i < a then ws[i + 1] else ws[a + (i - a) % p + 1] end) end as ws from cut
), words as (select row, n, unnest(range(0, n)) as i, unnest(ws) as w from docs),
same as (select x.row, x.i, y.i - x.i as q from words x join words y on x.row = y.row and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select row, q, min(i) as s, count(*) + q as l from (select *, i - row_number() over (partition by row, q order by i) as island from same) group by row, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select row, s, l, q from islands x where not exists (select 1 from islands y where y.row = x.row and y.q < x.q and y.s <= x.s and y.s + y.l >= x.s + x.l)),
listed as (select row, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as lines from runs group by row),
best as (select * from runs qualify row_number() over (partition by row order by l::double / q desc, s, q) = 1),
gone as (select distinct row, unnest(range(s + q, s + l)) as i from runs),
kept as (select row, string_agg(w, ' ' order by i) as text from words anti join gone using (row, i) group by row)
select d.doc_id, coalesce(n_runs, 0) as n_runs, s as start, l as length, q as period, 1000 * l // q as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from docs d left join listed x on x.row = d.row left join best b on b.row = d.row left join kept k on k.row = d.row
"""

#: Two hexadecimal digits stand for a byte.
OP12_SQL = """
with docs as (select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
windows as (select row, i, md5_number(substr(x, 2 * i + 1, 800)) as w from (select row, x, unnest(range(0, length(x) // 2 - 399)) as i from docs where length(x) >= 800)),
hits as (select row, i from (select row, i, count(*) over (partition by w) as n from windows) where n > 1),
marked as (select row, i, case when i - lag(i) over (partition by row order by i) <= 400 then 0 else 1 end as new from hits),
spans as (select row, min(i) as a, max(i) + 400 as b from (select row, i, sum(new) over (partition by row order by i) as span from marked) group by row, span),
pieces as (select row, a as at, a as stop, coalesce(lag(b) over (partition by row order by a), 0) as start from spans
           union all select d.row, length(x) // 2, length(x) // 2, coalesce(max(b), 0) from docs d left join spans s on s.row = d.row group by d.row, x),
kept as (select p.row, string_agg(substr(x, 2 * start + 1, 2 * (stop - start)), '' order by start) as x from pieces p join docs d on d.row = p.row group by p.row),
gone as (select row, sum(b - a) as n, count(*) as spans from spans group by row)
select d.doc_id, length(d.x) // 2 as n_bytes, coalesce(g.n, 0) as n_removed, coalesce(g.spans, 0) as n_spans, sha256(unhex(k.x)) as kept_sha256
from docs d join kept k on k.row = d.row left join gone g on g.row = d.row
"""

#: States: 0 nothing said, 1 after system, 2 after user, 3 after assistant.  Up to two inserts stand before a turn or at the end; costs lead the text that is compared.
OP13_SQL = rf"""
with recursive {CRC_TABLE},
hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as h
  from conversations, crc
), damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, range(case when h = 0 then 0 when h = 3 then 2 else 1 end) where h <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from damaged
), faults as (
  select *, role[1] as initial, lead(role[1]) over (partition by conv_id order by pos) as follows,
    case when not regexp_matches(text, '[^ 	-
]') then 'b' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd'
         when not regexp_matches(text, '[.!?][ 	-
]*$') then 't' else ' ' end as fault from placed
), counted as (
  select conv_id, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, count(*) filter (where fault = 'b') as blank,
    count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
    count(*) filter (where follows is not null and initial || follows not in ('su', 'ua', 'au')) as illegal, max(pos) as n from faults group by 1
), inserts(f, t, ins, roles) as (values (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', 'u'), (0, 3, 'II', 'ua'), (1, 2, 'I', 'u'), (1, 3, 'II', 'ua'), (2, 3, 'I', 'a'), (2, 2, 'II', 'au'), (3, 2, 'I', 'u'), (3, 3, 'II', 'ua')
), says(f, t, c) as (values (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')
), moves as (
  select f, f as t, 'D' as edit, '' as c, 2 as cost from (values (0), (1), (2), (3)) x(f)
  union all select f, t, 'K', c, 0 from says union all select f, t, 'R', c, 1 from says where c <> 's'
), steps as (
  select conv_id, pos, i.f, m.t, 5 * length(ins) + cost + case when edit <> 'D' and fault = 't' then 5 else 0 end as cost, ins || edit as audit,
    case when i.roles <> '' then concat(case when i.roles[1] = 'u' then 'user:' else 'assistant:' end, chr(10), case when i.roles = 'ua' then 'assistant:' || chr(10) when i.roles = 'au' then 'user:' || chr(10) else '' end) else '' end
      || case edit when 'D' then '' when 'K' then role || ':' || text || chr(10) else (case m.c when 'u' then 'user:' else 'assistant:' end) || text || chr(10) end as said
  from faults x, inserts i join moves m on m.f = i.t where edit = 'D' or (fault not in ('b', 'd') and (edit = 'R' or initial = m.c))
), way as (
  select distinct conv_id, 0::bigint as pos, 0 as state, 0::bigint as cost, '' as audit, '' as said from counted
  union all
  select w.conv_id, s.pos, s.t, min_by(w.cost + s.cost, printf('%12d', w.cost + s.cost) || w.audit || s.audit), min_by(w.audit || s.audit, printf('%12d', w.cost + s.cost) || w.audit || s.audit),
    min_by(w.said || s.said, printf('%12d', w.cost + s.cost) || w.audit || s.audit)
  from way w join steps s on s.conv_id is not distinct from w.conv_id and s.pos = w.pos + 1 and s.f = w.state group by w.conv_id, s.pos, s.t
), ended as (
  select w.conv_id, w.cost + 5 * length(ins) as cost, w.audit || ins as audit, w.said || case ins when 'II' then 'user:' || chr(10) || 'assistant:' || chr(10) when 'I' then 'assistant:' || chr(10) else '' end as said
  from way w join counted c on c.conv_id is not distinct from w.conv_id and c.n = w.pos join inserts i on i.f = w.state and ((i.f = 0 and ins = '') or (i.f > 0 and i.t = 3 and (i.f <> 3 or ins = '')))
), best as (select * from ended qualify row_number() over (partition by conv_id order by cost, audit) = 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(case when said = '' then '' else said[:-2] end, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op1_near_vectors": OP1_SQL, "op3_near_text": OP3_SQL, "op6_chat": OP6_SQL, "op10_repeats": OP10_SQL, "op11_runs": OP11_SQL, "op12_bytes": OP12_SQL, "op13_repair": OP13_SQL}
