"""The operators' queries on the given tables and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demescope.llm import byte_pairs, lexical, merkle
from demescope.llm.decontaminate import leaked_items
from demescope.llm.exact_dedup import exact_duplicates
from demescope.llm.jaccard_join import similar_documents
from demescope.llm.line_dedup import without_boilerplate
from demescope.llm.sentence_pieces import encoded
from demescope.llm.token_grammar import read_shards, write_shards
from demescope.llm.toxicity import toxicity
from demescope.llm.transcripts import fit, raw_transcripts, rendered
from demescope.llm.url_filter import judged_urls
from demescope.llm.warc import archived_pages
from demescope.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_grammar")
def token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_shards(table(spark, sf_dir, "documents"), tokenizer_file(TOKENIZER), path)
    return read_shards(spark, path)


@query("op3_string_tiling")
def string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_url_language_models")
def url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"))


@query(
    "op5_exact_dedup",
    r"""
with normed as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from normed window w as (partition by text_sha256 order by chars desc, doc_id nulls last, text rows between unbounded preceding and unbounded following)
""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op9_arc_to_warc",
    """
with payloads as (
  select page_id, sha1(coalesce(html, '')) as payload_digest, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages
), ranked as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as largest from payloads
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and largest <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and largest <> page_id then largest end as refers_to
from ranked
""",
)
def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


@query("op6_transcript_roles")
def transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    raw = raw_transcripts(turns)
    # The model learns from the raw lines with their known roles; rendering sees the raw lines alone.
    known = raw.join(turns.select("conv_id", F.col("turn").alias("part"), "role"), ["conv_id", "part"])
    return rendered(raw, fit(known, order="part"))


@query("op7_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op8_site_lines",
    r"""
with rows_ as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents
), totals as (
  select host, count(distinct text) as total from rows_ group by host
), split_ as (
  select doc_id, host, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from rows_
), shared as (
  select host, line from split_ join totals using (host) where trim(line, ' ') <> ''
  group by host, line, total having count(distinct text) >= 2 and count(distinct text) > 0.01 * total
)
select s.doc_id, cast(count(*) as int) as n_lines, cast(count(h.line) as int) as n_dropped,
  md5(coalesce(string_agg(s.line, chr(10) order by s.pos) filter (h.line is null), '')) as text_md5
from split_ s left join shared h on s.host = h.host and s.line = h.line
group by s.doc_id
""",
)
def site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_boilerplate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


@query("op10_piece_segmentation")
def piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL), ids=False)


# crc32 of the decimal id, byte by byte; the constant is its fixed polynomial.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf_sql(text: str) -> str:
    values = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


@query(
    "op11_merkle_manifest",
    f"""
with recursive rows_ as (
  select doc_id, source, {_leaf_sql("text")} as leaf,
    case when {_CRC32} % 2 = 0 then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql("text")} end as claimed
  from documents
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as slot, count(*) over (partition by source) as n from rows_
), low as (
  select source, 0 as level, slot, n, leaf as h from leaves
  union all
  select source, level + 1, slot // 3, (n + 2) // 3, sha256(string_agg(h, '' order by slot)) from low where n > 1
  group by source, level, slot // 3, n
), groups_ as (
  select source, h as subroot, level as height, row_number() over (order by source nulls first) - 1 as slot, count(*) over () as n from low where n = 1
), high as (
  select 0 as level, slot, n, subroot as h from groups_
  union all
  select level + 1, slot // 3, (n + 2) // 3, sha256(string_agg(h, '' order by slot)) from high where n > 1 group by level, slot // 3, n
), steps as (
  select l.doc_id, l.leaf, l.source, w.level, w.slot, w.h, w.slot < l.slot // cast(power(3, w.level) as bigint) as before
  from leaves l join low w on l.source is not distinct from w.source and w.n > 1
    and w.slot // 3 = l.slot // cast(power(3, w.level + 1) as bigint) and w.slot <> l.slot // cast(power(3, w.level) as bigint)
  union all
  select l.doc_id, l.leaf, l.source, g.height + w.level, w.slot, w.h, w.slot < g.slot // cast(power(3, w.level) as bigint)
  from leaves l join groups_ g on l.source is not distinct from g.source join high w on w.n > 1
    and w.slot // 3 = g.slot // cast(power(3, w.level + 1) as bigint) and w.slot <> g.slot // cast(power(3, w.level) as bigint)
), sides as (
  select doc_id, leaf, level, coalesce(string_agg(h, '' order by slot) filter (before), '') as b, coalesce(string_agg(h, '' order by slot) filter (not before), '') as a
  from steps group by doc_id, leaf, level
), proofs as (
  select doc_id, leaf, sha256(string_agg(b || a, '' order by level)) as proof from sides group by doc_id, leaf
), heights as (
  select l.doc_id, l.leaf, l.claimed, g.subroot, g.height + (select max(level) from high) as top
  from leaves l join groups_ g on l.source is not distinct from g.source
), folds as (
  select doc_id, leaf, 0 as level, claimed as h, top from heights
  union all
  select f.doc_id, f.leaf, f.level + 1, sha256(coalesce(s.b, '') || f.h || coalesce(s.a, '')), f.top
  from folds f left join sides s on s.doc_id = f.doc_id and s.leaf = f.leaf and s.level = f.level where f.level < f.top
)
select t.doc_id, t.leaf, t.subroot, r.h as root, coalesce(p.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from heights t join (select h from high where n = 1) r on true
  join folds f on f.doc_id = t.doc_id and f.leaf = t.leaf and f.level = t.top left join proofs p on p.doc_id = t.doc_id and p.leaf = t.leaf
""",
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    leaf = merkle.digest_of(merkle.leaf_text(*columns, "text"))
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.digest_of(merkle.leaf_text(*columns, cut))).otherwise(leaf)
    rows = merkle.manifest(docs, "source", "doc_id", leaf, {"doc_id": F.col("doc_id"), "claimed": tampered})
    found = rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.path_digest().alias("proof_sha256"), merkle.folded(F.lower(F.hex("claimed"))).alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query(
    "op12_shared_search",
    r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), sizes as (
  select doc_id, count(*) as n from words group by doc_id
), total as (
  select count(*) as docs, cast(sum(n) as bigint) as terms from sizes
), tf as (
  select doc_id, term, count(*) as tf from words where term in (select term from wanted) group by doc_id, term
), weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term, docs
), gains as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) as gain
  from tf join weights using (term) join sizes using (doc_id), total
), scores as (
  select item_id, doc_id, cast(sum(gain) as bigint) as score from gains join wanted using (term) group by item_id, doc_id
), placed as (
  select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from scores where score > 0
)
select item_id, rank, doc_id, score from placed where rank <= 10
""",
)
def shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RANKS = "byte_bpe_50k.tiktoken"


@query("op13_byte_pairs")
def byte_pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    path = tokenizer_file(RANKS)
    ids = byte_pairs.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path, PATTERN).drop("text")
    return byte_pairs.decoded(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
