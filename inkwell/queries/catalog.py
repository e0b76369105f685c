"""Every query outside the llm subpackage, with its DuckDB oracle where SQL can express it.

A query takes (spark, folder of tables) and reads whole tables. Oracles avoid the engine's own
methods: running sums are plain windows there, and next-fit is a recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import schedules, splitting
from inkwell.functions import text as X
from inkwell.functions.tokenize import encoder, framed_ids
from inkwell.operators import batches as B
from inkwell.operators import metrics as M
from inkwell.operators import order as O
from inkwell.operators import packing as P
from inkwell.operators import prefix as R
from inkwell.operators import routing as E
from inkwell.plans import build
from inkwell.session import scratch
from inkwell.sources import documents as S
from inkwell.streaming.packing import pack_incrementally, read_packed

#: Positions of a batch, at least: as many as the longest document needs if that is more, since a whole document is never cut or left out.
WINDOW = 49_152
SEGMENT = 4_096
SHARD = 200_000
BYTE_LIMIT = 4_095
BUDGET = 100_000
EXPERTS, TOP_K = 4, 2

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if oracle:
            _ORACLES[function.__name__] = oracle
        return function

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, text, key, n, ...) of documents in their order."""
    docs = S.read_parquet(spark, f"{sf_dir}/documents.parquet", key_column="doc_id")
    return docs.withColumn("n_bytes", X.byte_length(F.col("text"))).withColumn("n", F.col("n_bytes") + 1)


def _lengths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(ord, n) of all documents, and a window that each of them fits."""
    docs = _documents(spark, sf_dir).select("ord", "n")
    return docs, max(WINDOW, docs.agg(F.max("n")).first()[0] or 0)


# The documents in order, for oracles: n is the number of (input, target) pairs.
DOCS = "docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, *, strlen(text) AS n_bytes, strlen(text) + 1 AS n FROM documents)"


def _packing_sql(lengths: str, room, name: str = "packed") -> str:
    """Next-fit, one step per document."""
    return f"""{name}_d AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, n FROM {lengths} WHERE n <= {room}),
{name} AS (
  SELECT ord, n, 0 AS batch, n AS used FROM {name}_d WHERE ord = 0
  UNION ALL
  SELECT d.ord, d.n, CASE WHEN p.used + d.n > {room} THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.used + d.n > {room} THEN d.n ELSE p.used + d.n END
  FROM {name} p JOIN {name}_d d ON d.ord = p.ord + 1
)"""


WIN = "(SELECT w FROM win)"
PACKED = f"WITH RECURSIVE {DOCS}, win AS (SELECT greatest({WINDOW}, max(n)) AS w FROM docs), {_packing_sql('docs', WIN)}, plan AS (SELECT batch, min(ord) AS start_doc, max(ord) + 1 AS end_doc, sum(n) AS real_tokens FROM packed GROUP BY batch)"


# Text


@_query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_code_points FROM documents")
def text_lengths(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.byte_length(F.col("text")).alias("n_bytes"), F.char_length("text").cast("long").alias("n_code_points"))


@_query("""
WITH h AS (SELECT item_id, hex(encode(text)) AS h, strlen(text) AS n FROM benchmark),
t AS (SELECT item_id, i, CASE WHEN i = 0 THEN 256 WHEN i = n + 1 THEN 257 ELSE CAST('0x' || substr(h, 2 * (i - 1) + 1, 2) AS INTEGER) END AS token FROM h, LATERAL (SELECT unnest(generate_series(0, n + 1)) AS i))
SELECT item_id, CAST(i AS BIGINT) AS place, CAST(token AS BIGINT) AS token FROM t""")
def byte_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.framed(X.byte_tokens(F.col("text")))).alias("place", "token"))
    return rows.select("item_id", F.col("place").cast("long").alias("place"), F.col("token").cast("long").alias("token"))


@_query("""
WITH h AS (SELECT hex(encode(text)) AS h, strlen(text) AS n FROM documents),
t AS (SELECT CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS token FROM h, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i))
SELECT token, count(*) AS n FROM t GROUP BY token""")
def byte_histogram(spark, sf_dir):
    tokens = _table(spark, sf_dir, "documents").select(F.explode(encoder().tokens(F.col("text"))).alias("token"))
    return tokens.groupBy(F.col("token").cast("long").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@_query(r"SELECT lang, CAST(sum(len(regexp_extract_all(text, '\p{Nd}'))) AS BIGINT) AS digits FROM documents GROUP BY lang")
def digit_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(X.digit_count(F.col("text"))).alias("digits"))


@_query(r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '\p{Nd}|[^\p{Nd}]+') AS parts FROM documents)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_parts, CAST(len(list_filter(parts, lambda x: regexp_full_match(x, '\p{Nd}'))) AS BIGINT) AS n_digits, array_to_string(parts, '') = (SELECT d.text FROM documents d WHERE d.doc_id = p.doc_id LIMIT 1) AS whole FROM p""")
def digit_segments(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").withColumn("parts", X.digit_segments(F.col("text")))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.size(F.filter("parts", lambda x: x.rlike(f"^{X.DIGIT}$"))).cast("long").alias("n_digits"), (F.array_join("parts", "") == F.col("text")).alias("whole"))


@_query("SELECT item_id, text FROM benchmark")
def byte_roundtrip(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", X.decode_bytes(X.byte_tokens(F.col("text"))).alias("text"))


@_query("""
WITH b AS (SELECT unnest(range(256)) AS byte), s AS (SELECT byte, (byte BETWEEN 33 AND 126 OR byte BETWEEN 161 AND 172 OR byte >= 174) AS shown FROM b),
a AS (SELECT byte, CASE WHEN shown THEN byte ELSE 255 + sum(CASE WHEN shown THEN 0 ELSE 1 END) OVER (ORDER BY byte) END::BIGINT AS code_point FROM s),
h AS (SELECT hex(encode(text)) AS h, strlen(text) AS n FROM documents),
t AS (SELECT CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS byte FROM h, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i)),
c AS (SELECT byte, count(*) AS n FROM t GROUP BY byte)
SELECT byte, code_point, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (byte)""")
def byte_alphabet(spark, sf_dir):
    """How often each byte is in the documents, beside its printable stand-in."""
    alphabet = spark.createDataFrame(list(X.byte_alphabet()), "byte long, code_point long")
    counts = byte_histogram(spark, sf_dir).select(F.col("token").alias("byte"), "n")
    return alphabet.join(counts, "byte", "left").select("byte", "code_point", F.coalesce("n", F.lit(0)).alias("n"))


def _public_bpe():
    import public_tokenizers

    return encoder(public_tokenizers.path("byte_bpe_50k.json"), (50256, 50256, 50256))


@_query()
def bpe_encode(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", _public_bpe().tokens(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"))


@_query("SELECT item_id, text FROM benchmark")
def bpe_roundtrip(spark, sf_dir):
    bpe = _public_bpe()
    rows = _table(spark, sf_dir, "benchmark").select("item_id", bpe.tokens(F.col("text")).alias("ids"))
    return rows.select("item_id", bpe.decoded(F.col("ids")).alias("text"))


# Sources


@_query(f"WITH {DOCS} SELECT ord, text, CAST(doc_id AS VARCHAR) AS key FROM docs")
def parquet_source(spark, sf_dir):
    return S.read_parquet(spark, f"{sf_dir}/documents.parquet", key_column="doc_id")


@_query(f"WITH {DOCS} SELECT ord, text FROM docs")
def jsonl_source(spark, sf_dir):
    out = scratch(spark, "documents")
    docs = _documents(spark, sf_dir)
    # files are read in order of their names, which is that of the ranges
    docs.select("ord", "text").repartitionByRange("ord").sortWithinPartitions("ord").select("text").write.option("ignoreNullFields", "false").json(out)
    return S.read_jsonl(spark, out).select("ord", "text")


@_query(f"WITH {DOCS} SELECT ord, doc_id, text FROM docs WHERE ord = 137")
def document_by_number(spark, sf_dir):
    docs = S.read_parquet(spark, f"{sf_dir}/documents.parquet", key_column="doc_id")
    return S.document(docs, 137).select("ord", F.col("key").cast("long").alias("doc_id"), "text")


@_query(f"WITH {DOCS}, s AS (SELECT ord, text, n, sum(n) OVER (ORDER BY ord) AS upto FROM docs) SELECT ord, text FROM s WHERE upto - n < {BUDGET} OR ord = 0")
def budgeted_source(spark, sf_dir):
    """Only the files that hold the budget are read."""
    return S.read_within(spark, f"{sf_dir}/documents.parquet", BUDGET).select("ord", "text")


@_query()
def file_checksums(spark, sf_dir):
    return S.file_checksums(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "pages", "conversations")))


@_query("SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark")
def union_sources(spark, sf_dir):
    part = lambda t: _table(spark, sf_dir, t).select(F.lit(t).alias("origin"), "text")
    return part("documents").unionByName(part("benchmark"))


# Filters and counters


@_query(f"WITH {DOCS} SELECT ord, doc_id FROM docs WHERE ord < 100")
def head_docs(spark, sf_dir):
    return R.first_documents(_documents(spark, sf_dir), 100).select("ord", F.col("key").cast("long").alias("doc_id"))


@_query(f"WITH {DOCS} SELECT ord, n_bytes FROM docs WHERE n_bytes <= {BYTE_LIMIT}")
def byte_filter(spark, sf_dir):
    return _documents(spark, sf_dir).where(F.col("n_bytes") <= BYTE_LIMIT).select("ord", "n_bytes")


@_query(f"""WITH {DOCS} SELECT count(*) AS read_docs, CAST(0 AS BIGINT) AS val_docs, count(*) FILTER (WHERE n_bytes > 2000) AS dropped_docs,
CAST(coalesce(sum(n_bytes) FILTER (WHERE n_bytes > 2000 AND n_bytes <= {BYTE_LIMIT}), 0) AS BIGINT) AS dropped_text_tokens,
CAST(coalesce(sum(n_bytes) FILTER (WHERE n_bytes > 2000), 0) AS BIGINT) AS dropped_text_bytes FROM docs""")
def filter_counters(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("ord", "text", "key")
    return build.counters(build.kept_documents(docs, encoder(), max_bytes=BYTE_LIMIT, max_tokens=2000)[0])


@_query(f"""SELECT lang, count(*) FILTER (WHERE strlen(text) > {BYTE_LIMIT}) AS dropped_docs, round(count(*) FILTER (WHERE strlen(text) > {BYTE_LIMIT}) / count(*), 6) AS docs_share,
round(coalesce(sum(strlen(text)) FILTER (WHERE strlen(text) > {BYTE_LIMIT}), 0) / sum(strlen(text)), 6) AS bytes_share FROM documents GROUP BY lang""")
def drop_share_by_lang(spark, sf_dir):
    over, n = F.octet_length("text") > BYTE_LIMIT, F.octet_length("text")
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count_if(over).alias("dropped_docs"),
        F.round(F.count_if(over) / F.count(F.lit(1)), 6).alias("docs_share"),
        F.round(F.coalesce(F.sum(F.when(over, n)), F.lit(0)) / F.sum(n), 6).alias("bytes_share"),
    )


@_query()
def hash_split(spark, sf_dir):
    return _documents(spark, sf_dir).select("ord", "key", splitting.is_validation(F.col("key"), 0.1, 0).alias("is_val"))


@_query()
def split_counts(spark, sf_dir):
    marks = [F.count_if(splitting.is_validation(F.col("key"), 0.1, s)).alias(f"val_seed_{s}") for s in (0, 1)]
    return _documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), *marks)


@_query("SELECT CAST(0 AS BIGINT) AS outside")
def split_nesting(spark, sf_dir):
    flags = _documents(spark, sf_dir).select(splitting.is_validation(F.col("key"), 0.05).alias("small"), splitting.is_validation(F.col("key"), 0.2).alias("large"))
    return flags.agg(F.count_if(F.col("small") & ~F.col("large")).alias("outside"))


@_query()
def bernoulli_sample(spark, sf_dir):
    return _documents(spark, sf_dir).where(splitting.sampled(F.col("ord"), 0.05, 0)).select("ord", "key")


@_query()
def tokenizer_sample(spark, sf_dir):
    """What a tokenizer would be trained on: sampled documents outside validation. Sizes are code points, as the sample's counters have them."""
    docs = _documents(spark, sf_dir).withColumn("is_val", splitting.is_validation(F.col("key"), 0.1)).withColumn("drawn", splitting.sampled(F.col("ord"), 0.5, 0))
    used = F.col("drawn") & ~F.col("is_val")
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if("is_val").alias("val_docs_skipped"), F.count_if(used).alias("sampled_docs"), F.sum(F.when(used, F.char_length("text"))).alias("sampled_size"))


# Running sums and budgets


@_query(f"WITH {DOCS} SELECT ord, CAST(sum(n) OVER (ORDER BY ord) AS BIGINT) AS upto FROM docs")
def pair_bounds(spark, sf_dir):
    return R.with_running_sum(_documents(spark, sf_dir).select("ord", "n"), "n").select("ord", "upto")


@_query(f"WITH {DOCS} SELECT ord, n FROM docs")
def lengths_from_bounds(spark, sf_dir):
    summed = R.with_running_sum(_documents(spark, sf_dir).select("ord", "n"), "n").select("ord", "upto")
    earlier = summed.select((F.col("ord") + 1).alias("ord"), F.col("upto").alias("before"))
    return summed.join(earlier, "ord", "left").select("ord", (F.col("upto") - F.coalesce("before", F.lit(0))).alias("n"))


def _budget_sql(budget: int) -> str:
    return f"WITH {DOCS}, s AS (SELECT ord, n, sum(n) OVER (ORDER BY ord) AS upto FROM docs) SELECT ord, n FROM s WHERE upto - n < {budget} OR ord = 0"


def _budget(name: str, budget: int) -> None:
    def query(spark, sf_dir):
        return R.within_budget(_documents(spark, sf_dir).select("ord", "n"), "n", budget)

    query.__name__ = name
    _query(_budget_sql(budget))(query)


_budget("budget_select", BUDGET)
_budget("budget_select_none", 0)
_budget("budget_select_one", 1)
_budget("budget_select_all", 10**12)


@_query(f"WITH {DOCS}, s AS (SELECT ord, n_bytes, sum(n_bytes + 1) OVER (ORDER BY ord) AS upto FROM docs) SELECT ord, n_bytes FROM s WHERE upto - n_bytes - 1 < {BUDGET} OR ord = 0")
def bytes_budget_slice(spark, sf_dir):
    return R.bytes_within(_documents(spark, sf_dir).select("ord", "text", "n_bytes"), BUDGET).select("ord", "n_bytes")


@_query(f"""WITH RECURSIVE {DOCS}, s AS (
  SELECT ord, n + 1 AS n, 0 AS shard, n + 1 AS used FROM docs WHERE ord = 0
  UNION ALL SELECT d.ord, d.n + 1, CASE WHEN s.used + d.n + 1 > {SHARD} THEN s.shard + 1 ELSE s.shard END, CASE WHEN s.used + d.n + 1 > {SHARD} THEN d.n + 1 ELSE s.used + d.n + 1 END
  FROM s JOIN docs d ON d.ord = s.ord + 1)
SELECT CAST(shard AS BIGINT) AS shard, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n - 2) AS BIGINT) AS text_bytes FROM s GROUP BY shard""")
def shard_layout(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("ord", (F.col("n") + 1).alias("n"))
    placed = P.next_fit(docs, SHARD, oversized="alone")
    return placed.groupBy(F.col("batch").alias("shard")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.sum(F.col("n") - 2).alias("text_bytes"))


@_query(f"""WITH RECURSIVE {DOCS}, s AS (
  SELECT ord, n + 1 AS n, 0 AS shard, n + 1 AS used FROM docs WHERE ord = 0
  UNION ALL SELECT d.ord, d.n + 1, CASE WHEN s.used + d.n + 1 > {SHARD} THEN s.shard + 1 ELSE s.shard END, CASE WHEN s.used + d.n + 1 > {SHARD} THEN d.n + 1 ELSE s.used + d.n + 1 END
  FROM s JOIN docs d ON d.ord = s.ord + 1)
SELECT 'shard_' || lpad(CAST(shard AS VARCHAR), 5, '0') || '.tokens.u16' AS name, format('{{:,}}', CAST(sum(n) AS BIGINT)) AS tokens FROM s GROUP BY shard""")
def shard_names(spark, sf_dir):
    """Shards as a listing shows them."""
    shards = shard_layout(spark, sf_dir)
    return shards.select(F.format_string("shard_%05d.tokens.u16", "shard").alias("name"), F.format_number("tokens", 0).alias("tokens"))


@_query(f"WITH {DOCS} SELECT count(*) AS docs, CAST(sum(n + 1) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS loss_tokens, CAST(sum(n_bytes) AS BIGINT) AS text_bytes FROM docs")
def manifest_totals(spark, sf_dir):
    tokens = F.size(X.framed(encoder().tokens(F.col("text")))).cast("long")
    docs = _documents(spark, sf_dir).select(tokens.alias("t"), "n_bytes")
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.sum("t").alias("tokens"), (F.sum("t") - F.count(F.lit(1))).alias("loss_tokens"), F.sum("n_bytes").alias("text_bytes"))


@_query(f"WITH {DOCS} SELECT ord, n FROM docs ORDER BY n DESC, ord LIMIT 1")
def longest_document(spark, sf_dir):
    best = _documents(spark, sf_dir).agg(F.max(F.struct("n", (-F.col("ord")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("ord"), F.col("best.n").alias("n"))


# Packing and batches


@_query(f"{PACKED} SELECT CAST(batch AS BIGINT) AS batch, start_doc, end_doc, CAST(real_tokens AS BIGINT) AS real_tokens FROM plan")
def packed_batches(spark, sf_dir):
    return P.batches(P.next_fit(*_lengths(spark, sf_dir)))


@_query(f"""WITH RECURSIVE lines AS (SELECT l_orderkey AS ord, count(*) AS n FROM lineitem GROUP BY l_orderkey), {_packing_sql('lines', 64)}
SELECT CAST(batch AS BIGINT) AS batch, min(ord) AS start_doc, max(ord) + 1 AS end_doc, CAST(sum(n) AS BIGINT) AS real_tokens FROM packed GROUP BY batch""")
def packed_orders(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.count(F.lit(1)).alias("n"))
    return P.batches(P.next_fit(build.numbered(lines), 64))


@_query(f"{PACKED} SELECT round(sum(real_tokens) / (count(*) * {WIN}), 6) AS utilization, count(*) AS n_batches FROM plan")
def packing_utilization(spark, sf_dir):
    lengths, window = _lengths(spark, sf_dir)
    return P.utilization(P.batches(P.next_fit(lengths, window)), window).select(F.round("utilization", 6).alias("utilization"), "n_batches")


SEGMENTS = f"""{PACKED}, f AS (SELECT batch, real_tokens, {WIN} - real_tokens AS remaining FROM plan),
seg AS (
  SELECT batch, CAST(ord AS BIGINT) AS place, n AS length, false AS filler FROM packed
  UNION ALL SELECT batch, 1000000000 + i, least({SEGMENT}, remaining - i * {SEGMENT}), true FROM f, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(remaining / {SEGMENT}) AS BIGINT) - 1)) AS i) WHERE remaining > 0
), numbered AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY place) - 1 AS segment, length, filler, sum(length) OVER (PARTITION BY batch ORDER BY place) AS upto FROM seg)"""


def _placed(spark, sf_dir):
    lengths, window = _lengths(spark, sf_dir)
    return P.next_fit(lengths, window), window


@_query(f"{SEGMENTS} SELECT CAST(batch AS BIGINT) AS batch, segment, CAST(upto AS BIGINT) AS upto FROM numbered")
def segment_bounds(spark, sf_dir):
    found = B.segments(*_placed(spark, sf_dir), SEGMENT)
    return found.select("batch", F.posexplode(F.slice(B.bounds(F.col("lengths")), 2, F.size("lengths"))).alias("segment", "upto")).select("batch", F.col("segment").cast("long").alias("segment"), "upto")


@_query(f"{SEGMENTS} SELECT CAST(batch AS BIGINT) AS batch, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS filler, CAST(max(length) AS BIGINT) AS longest FROM numbered WHERE filler GROUP BY batch")
def filler_chunks(spark, sf_dir):
    placed, window = _placed(spark, sf_dir)
    chunks = P.batches(placed).select("batch", F.explode(B.filler_chunks(F.lit(window) - F.col("real_tokens"), SEGMENT)).alias("c"))
    return chunks.groupBy("batch").agg(F.count(F.lit(1)).alias("chunks"), F.sum("c").alias("filler"), F.max("c").alias("longest"))


@_query(f"{SEGMENTS} SELECT CAST(batch AS BIGINT) AS batch, CAST(sum(length) AS BIGINT) AS n, CAST(sum(length * (length - 1) // 2) AS BIGINT) AS total, CAST(max(length) - 1 AS BIGINT) AS highest FROM numbered GROUP BY batch")
def positions(spark, sf_dir):
    found = B.segments(*_placed(spark, sf_dir), SEGMENT).select("batch", B.positions(F.col("lengths")).alias("p"))
    return found.select("batch", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("p").alias("highest"))


ITEMS = "docs AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, text, strlen(text) + 1 AS n, hex(encode(text)) AS h FROM benchmark)"
TOKENS = f"""{ITEMS}, tokens AS (SELECT ord, i, CASE WHEN i = 0 THEN 256 WHEN i = n THEN 257 ELSE CAST('0x' || substr(h, 2 * (i - 1) + 1, 2) AS INTEGER) END AS token FROM docs, LATERAL (SELECT unnest(generate_series(0, n)) AS i)),
pairs AS (SELECT ord, i, token AS input, lead(token) OVER (PARTITION BY ord ORDER BY i) AS target FROM tokens)"""


def _items(spark, sf_dir):
    docs = S.read_parquet(spark, f"{sf_dir}/benchmark.parquet", key_column="item_id")
    return docs.select("ord", X.framed(X.byte_tokens(F.col("text"))).alias("tokens"))


@_query(f"WITH {TOKENS} SELECT ord, CAST(i AS BIGINT) AS place, CAST(input AS BIGINT) AS input, CAST(target AS BIGINT) AS target FROM pairs WHERE target IS NOT NULL")
def input_target_pairs(spark, sf_dir):
    pairs = F.arrays_zip(X.inputs(F.col("tokens")).alias("input"), X.targets(F.col("tokens")).alias("target"))
    rows = _items(spark, sf_dir).select("ord", F.posexplode(pairs).alias("place", "pair"))
    return rows.select("ord", F.col("place").cast("long").alias("place"), F.col("pair.input").cast("long").alias("input"), F.col("pair.target").cast("long").alias("target"))


@_query(f"""WITH RECURSIVE {TOKENS}, {_packing_sql('docs', 2048)},
real AS (SELECT p.batch, row_number() OVER (PARTITION BY p.batch ORDER BY q.ord, q.i) - 1 AS slot, q.input AS id, q.target, q.i AS position FROM packed p JOIN pairs q ON q.ord = p.ord WHERE q.target IS NOT NULL),
filled AS (SELECT batch, count(*) AS n FROM real GROUP BY batch),
filler AS (SELECT batch, n + i AS slot, 258 AS id, -100 AS target, i % 512 AS position FROM filled, LATERAL (SELECT unnest(generate_series(0, 2048 - n - 1)) AS i) WHERE n < 2048)
SELECT CAST(batch AS BIGINT) AS batch, CAST(slot AS BIGINT) AS slot, CAST(id AS BIGINT) AS id, CAST(target AS BIGINT) AS target, CAST(position AS BIGINT) AS position FROM (SELECT * FROM real UNION ALL SELECT * FROM filler)""")
def materialized_batch(spark, sf_dir):
    docs = _items(spark, sf_dir)
    placed = P.next_fit(docs.select("ord", (F.size("tokens") - 1).alias("n")), 2048)
    made = B.materialize(placed, docs, 2048, 512)
    rows = made.select("batch", F.posexplode(F.arrays_zip("ids", "targets", "positions")).alias("slot", "x"))
    return rows.select("batch", F.col("slot").cast("long").alias("slot"), F.col("x.ids").cast("long").alias("id"), F.col("x.targets").cast("long").alias("target"), F.col("x.positions").cast("long").alias("position"))


# The same over documents, a digest of ids for each row


def _digest(ids) -> F.Column:
    return F.sha2(F.array_join(ids, ",").cast("binary"), 256)


FRAMED = f"""{DOCS}, h AS (SELECT ord, doc_id, hex(encode(text)) AS h, n_bytes FROM docs),
f AS (SELECT ord, doc_id, list_concat([256], list_transform(range(n_bytes), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)), [257]) AS ids FROM h)"""


@_query(f"WITH {FRAMED} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, sha256(array_to_string(ids, ',')) AS ids_sha256 FROM f")
def document_byte_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", X.framed(X.byte_tokens(F.col("text"))).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _digest("ids").alias("ids_sha256"))


@_query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def document_byte_roundtrip(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.decode_bytes(X.byte_tokens(F.col("text"))).cast("binary"), 256).alias("text_sha256"))


@_query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def document_bpe_roundtrip(spark, sf_dir):
    bpe = _public_bpe()
    rows = _table(spark, sf_dir, "documents").select("doc_id", bpe.tokens(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.sha2(bpe.decoded(F.col("ids")).cast("binary"), 256).alias("text_sha256"))


@_query(f"WITH {FRAMED} SELECT ord, CAST(len(ids) - 1 AS BIGINT) AS n_pairs, sha256(array_to_string(ids[1:len(ids) - 1], ',')) AS inputs_sha256, sha256(array_to_string(ids[2:], ',')) AS targets_sha256 FROM f")
def document_pairs(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("ord", X.framed(X.byte_tokens(F.col("text"))).alias("ids"))
    return rows.select("ord", (F.size("ids") - 1).cast("long").alias("n_pairs"), _digest(X.inputs(F.col("ids"))).alias("inputs_sha256"), _digest(X.targets(F.col("ids"))).alias("targets_sha256"))


@_query(f"""{PACKED}, h AS (SELECT ord, n_bytes, hex(encode(text)) AS h FROM docs),
f AS (SELECT ord, list_concat([256], list_transform(range(n_bytes), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)), [257]) AS ids FROM h),
b AS (SELECT batch, flatten(list(ids[1:len(ids) - 1] ORDER BY ord)) AS ids, flatten(list(ids[2:] ORDER BY ord)) AS targets, list(CAST(n AS BIGINT) ORDER BY ord) AS own, {WIN} - CAST(sum(n) AS BIGINT) AS room FROM packed JOIN f USING (ord) GROUP BY batch),
l AS (SELECT *, list_concat(own, list_transform(range(CAST(ceil(room / {SEGMENT}) AS BIGINT)), lambda i: least({SEGMENT}, room - i * {SEGMENT}))) AS lengths FROM b)
SELECT CAST(batch AS BIGINT) AS batch, sha256(array_to_string(list_concat(ids, list_transform(range(room), lambda i: 258)), ',')) AS ids_sha256, sha256(array_to_string(list_concat(targets, list_transform(range(room), lambda i: -100)), ',')) AS targets_sha256,
sha256(array_to_string(flatten(list_transform(lengths, lambda n: range(n))), ',')) AS positions_sha256, sha256(array_to_string(list_transform(range(len(lengths) + 1), lambda i: coalesce(CAST(list_sum(lengths[1:i]) AS BIGINT), 0)), ',')) AS bounds_sha256 FROM l""")
def document_batches(spark, sf_dir):
    made = _made(spark, sf_dir)
    return made.select("batch", *[_digest(c).alias(f"{c}_sha256") for c in ("ids", "targets", "positions", "bounds")])


def _made(spark, sf_dir):
    """Materialized batches of all documents: texts are dealt out and become tokens where a batch is filled."""
    placed, window = _placed(spark, sf_dir)
    docs = _documents(spark, sf_dir)
    n, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return B.streamed(placed, docs.select("ord", "text"), framed_ids(encoder()), n, n_bytes, window, SEGMENT)


@_query(f"""{PACKED}, h AS (SELECT ord, n_bytes, hex(encode(text)) AS h FROM docs),
s AS (SELECT ord, list_sum(list_transform(range(n_bytes), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS s FROM h)
SELECT CAST(batch AS BIGINT) AS batch, CAST(sum(n) AS BIGINT) AS places, CAST(sum(256 + coalesce(s, 0)) AS BIGINT) AS ids, CAST(sum(257 + coalesce(s, 0)) AS BIGINT) AS targets FROM packed JOIN s USING (ord) GROUP BY batch""")
def loss_positions(spark, sf_dir):
    """What bears a loss in each batch."""
    places = B.loss_positions(_made(spark, sf_dir))
    return places.groupBy("batch").agg(F.count(F.lit(1)).alias("places"), F.sum(F.col("id").cast("long")).alias("ids"), F.sum(F.col("target").cast("long")).alias("targets"))


# Orders and schedules


def _schedule(spark, sf_dir, seed):
    plan = P.batches(_placed(spark, sf_dir)[0])
    n = plan.count()
    return O.rank_schedule(spark, n if seed is None else O.batch_order(n, seed), 4), plan


RANKS = f"{PACKED}, slots AS (SELECT CAST(s AS BIGINT) AS slot, s // 4 AS step, s % 4 AS rank, CASE WHEN s < (SELECT count(*) FROM plan) THEN s ELSE -1 END AS batch FROM (SELECT unnest(range(CAST(ceil((SELECT count(*) FROM plan) / 4) AS BIGINT) * 4)) AS s))"


@_query(f"{RANKS} SELECT slot, CAST(step AS BIGINT) AS step, CAST(rank AS BIGINT) AS rank, CAST(batch AS BIGINT) AS batch FROM slots")
def rank_schedule(spark, sf_dir):
    return _schedule(spark, sf_dir, None)[0]


@_query()
def batch_shuffle(spark, sf_dir):
    return _schedule(spark, sf_dir, 0)[0]


@_query(f"{RANKS} SELECT CAST(step AS BIGINT) AS step, CAST(coalesce(sum(real_tokens), 0) AS BIGINT) AS tokens FROM slots LEFT JOIN plan USING (batch) GROUP BY step")
def step_tokens(spark, sf_dir):
    return O.step_tokens(*_schedule(spark, sf_dir, None))


@_query()
def seeded_permutation(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("ord", "key")
    return O.reordered(docs, O.permutation(spark, docs.count(), 0))


@_query()
def hash_order(spark, sf_dir):
    """A seeded order at any size; tests hold it against its own definition."""
    return O.hash_order(_documents(spark, sf_dir).select("ord"), 0)


def _bijection_sql(seed: int, part: int = 0) -> str:
    """places(ord, place) of the keyed bijection of all documents: its rounds as one fold, its walks as a recursion."""
    prime, keys = O.Bijection.PRIME, O.Bijection(1, seed, part).keys
    mixed = lambda v: f"(({v} % {prime} * k[2] + k[3]) % {prime} * (({v} % {prime} * k[2] + k[3]) % {prime}) + k[4]) % {prime}"
    rounds = ", ".join(f"[{i % 2}, {', '.join(map(str, key))}]" for i, key in enumerate(keys))
    folded = lambda x: f"list_reduce([[{x} // b, {x} % b], {rounds}], lambda s, k: CASE WHEN k[1] = 0 THEN [(s[1] + {mixed('s[2]')}) % a, s[2]] ELSE [s[1], (s[2] + {mixed('s[1]')}) % b] END)"
    step = lambda x, rest: f"SELECT ord, s[1] * b + s[2] AS place FROM (SELECT ord, b, {folded(x)} AS s {rest})"
    return f"""sides AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM docs)),
walk AS ({step("ord", "FROM docs, sides")} UNION ALL {step("place", "FROM walk, sides WHERE place >= n")}),
places AS (SELECT ord, CAST(place AS BIGINT) AS place FROM walk, sides WHERE place < n)"""


@_query(f"WITH RECURSIVE {DOCS}, {_bijection_sql(0)} SELECT place AS position, ord FROM places")
def bijection_order(spark, sf_dir):
    """A seeded order at any size, in a row: no rank, no look-up."""
    return O.bijection_order(_documents(spark, sf_dir).select("ord"), 0)


STEPS = f"{PACKED}, run AS (SELECT count(*) AS total, greatest(10, CAST(ceil(CAST(0.02 AS DOUBLE) * count(*)) AS BIGINT)) AS warmup FROM plan)"


@_query(f"""{STEPS} SELECT CAST(batch AS BIGINT) AS step, round(CASE WHEN batch < warmup THEN (batch + 1) / CAST(warmup AS DOUBLE)
ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (batch - warmup) / CAST(greatest(1, total - warmup) AS DOUBLE)))) END, 6) AS scale FROM plan, run""")
def lr_schedule(spark, sf_dir):
    """Of a run with a step for each packed batch of the documents."""
    plan = P.batches(_placed(spark, sf_dir)[0])
    total, warmup, _ = schedules.resolve_schedule(plan.count())
    return plan.select(F.col("batch").alias("step"), F.round(schedules.learning_rate(F.col("batch"), warmup, total, 0.1), 6).alias("scale"))


@_query(f"{STEPS} SELECT CAST(batch + 1 AS BIGINT) AS step, CAST(real_tokens AS BIGINT) AS tokens FROM plan, run WHERE batch = 0 OR (batch + 1) % 5 = 0 OR batch + 1 = total")
def logged_steps(spark, sf_dir):
    """Steps of such a run, from 1, that are logged: the first, each fifth and the last."""
    plan = P.batches(_placed(spark, sf_dir)[0])
    steps = plan.select((F.col("batch") + 1).alias("step"), F.col("real_tokens").alias("tokens"))
    return steps.where(schedules.is_logged(F.col("step"), 5, plan.count()))


# Metrics


@_query("""WITH l AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS moment, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
t AS (SELECT *, moment - first_value(moment) OVER (PARTITION BY user_id ORDER BY step) AS seconds, step * 1000 AS tokens FROM l)
SELECT user_id, CAST(step AS BIGINT) AS step, round((tokens - coalesce(lag(tokens) OVER (PARTITION BY user_id ORDER BY step), 0)) / greatest(1e-9, seconds - coalesce(lag(seconds) OVER (PARTITION BY user_id ORDER BY step), 0)), 6) AS tokens_per_second FROM t WHERE step > 1""")
def throughput_deltas(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("step")
    log = _table(spark, sf_dir, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    log = log.withColumn("seconds", at - F.first(at).over(own)).withColumn("tokens", F.col("step") * 1000)
    rates = M.throughput(log.where("step > 1").select("user_id", "step", "seconds", "tokens"), "user_id", "step", "tokens", "seconds")
    return rates.select("user_id", "step", F.round("tokens_per_second", 6).alias("tokens_per_second"))


@_query("""WITH l AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
t AS (SELECT *, moment - first_value(moment) OVER (PARTITION BY user_id ORDER BY step) AS seconds, CASE WHEN step % 3 = 0 THEN 0.25 ELSE 0 END AS spent FROM l)
SELECT user_id, CAST(step AS BIGINT) AS step, round(seconds - sum(spent) OVER (PARTITION BY user_id ORDER BY step), 4) AS train_seconds FROM t""")
def train_seconds(spark, sf_dir):
    """Each third step of a user's log has spent a quarter of a second on validation."""
    own = Window.partitionBy("user_id").orderBy("step")
    log = _table(spark, sf_dir, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    log = log.withColumn("seconds", at - F.first(at).over(own)).withColumn("spent", F.when(F.col("step") % 3 == 0, 0.25).otherwise(0.0))
    done = M.without_validation(log, "user_id", "step", "seconds", "spent")
    return done.select("user_id", "step", F.round("train_seconds", 4).alias("train_seconds"))


@_query("SELECT lang, round(sum(length(text) * 0.7) / ln(2) / greatest(1, sum(strlen(text))), 6) AS bits_per_byte FROM documents GROUP BY lang")
def bits_per_byte(spark, sf_dir):
    """The loss is 0.7 nats a code point: there is no model here."""
    rows = _table(spark, sf_dir, "documents").select("lang", (F.char_length("text") * 0.7).alias("loss"), X.byte_length(F.col("text")).alias("n_bytes"))
    return rows.groupBy("lang").agg(F.round(M.bits_per_byte(), 6).alias("bits_per_byte"))


@_query("SELECT event_type, round(sum(value * (1 + event_id % 5)) / greatest(1, sum(1 + event_id % 5)), 6) AS loss FROM events GROUP BY event_type")
def mean_loss(spark, sf_dir):
    """An event's value is the mean loss of 1 to 5 tokens."""
    tokens = 1 + F.col("event_id") % 5
    rows = _table(spark, sf_dir, "events").select("event_type", (F.col("value") * tokens).alias("loss"), tokens.alias("tokens"))
    return rows.groupBy("event_type").agg(F.round(M.mean_loss(), 6).alias("loss"))


@_query("SELECT count(*) AS n, count(DISTINCT lang) <= 1 AS agree FROM documents")
def source_agreement(spark, sf_dir):
    return M.agreement(_table(spark, sf_dir, "documents"), "lang")


# Routing; the first numbers of a vector are a row's router logits


def _probs(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, EXPERTS), lambda x: x.cast("double")).alias("logits"))
    return E.probabilities(rows, "vec_id", "logits")


ROUTED = f"""WITH l AS (SELECT vec_id AS row, [CAST(x AS DOUBLE) FOR x IN embedding[1:{EXPERTS}]] AS z FROM embeddings),
x AS (SELECT row, unnest(range({EXPERTS})) AS expert, unnest(z) AS z FROM l),
probs AS (SELECT row, expert, exp(z) / sum(exp(z)) OVER (PARTITION BY row) AS p FROM x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY p DESC, expert) - 1 AS slot FROM probs),
chosen AS (SELECT row, slot, expert, p, p / sum(p) OVER (PARTITION BY row) AS weight FROM ranked WHERE slot < {TOP_K}),
counts AS (SELECT e.expert, count(c.row) AS n FROM (SELECT unnest(range({EXPERTS})) AS expert) e LEFT JOIN chosen c USING (expert) GROUP BY e.expert)"""


@_query(f"{ROUTED} SELECT row, CAST(slot AS BIGINT) AS slot, CAST(expert AS BIGINT) AS expert, round(weight, 6) AS weight FROM chosen")
def router_topk(spark, sf_dir):
    chosen = E.top_k(_probs(spark, sf_dir), TOP_K)
    return chosen.select("row", F.col("slot").cast("long").alias("slot"), F.col("expert").cast("long").alias("expert"), F.round("weight", 6).alias("weight"))


@_query(f"{ROUTED} SELECT CAST(expert AS BIGINT) AS expert, n FROM counts")
def expert_histogram(spark, sf_dir):
    return E.histogram(E.top_k(_probs(spark, sf_dir), TOP_K), EXPERTS).select(F.col("expert").cast("long").alias("expert"), "n")


@_query(f"{ROUTED} SELECT CAST(expert AS BIGINT) AS expert, CAST(sum(n) OVER (ORDER BY expert) AS BIGINT) AS upto FROM counts")
def expert_offsets(spark, sf_dir):
    counts = E.histogram(E.top_k(_probs(spark, sf_dir), TOP_K), EXPERTS)
    return E.offsets(counts).select(F.col("expert").cast("long").alias("expert"), "upto")


@_query(f"{ROUTED} SELECT row, CAST(slot AS BIGINT) AS slot, CAST(expert AS BIGINT) AS expert, row_number() OVER (ORDER BY expert, row, slot) - 1 AS place FROM chosen")
def expert_dispatch_order(spark, sf_dir):
    chosen = E.top_k(_probs(spark, sf_dir), TOP_K)
    placed = E.dispatch(chosen, E.histogram(chosen, EXPERTS))
    return placed.select("row", F.col("slot").cast("long").alias("slot"), F.col("expert").cast("long").alias("expert"), F.col("place").cast("long").alias("place"))


@_query(f"{ROUTED} SELECT row, round(sum(weight * (expert + 1) * row), 6) AS value FROM chosen GROUP BY row")
def topk_combine(spark, sf_dir):
    """An expert's output for a row is (expert + 1) times the row's number."""
    probs = _probs(spark, sf_dir)
    outputs = probs.select("row", "expert", ((F.col("expert") + 1) * F.col("row")).cast("double").alias("value"))
    return E.combine(outputs, E.top_k(probs, TOP_K)).select("row", F.round("value", 6).alias("value"))


@_query(f"""{ROUTED}, soft AS (SELECT expert, sum(p) AS soft, sum(-p * ln(greatest(p, 1.1754943508222875e-38))) AS h FROM probs GROUP BY expert), r AS (SELECT count(DISTINCT row) AS rows FROM probs)
SELECT round({EXPERTS} * sum(n * soft) / (max(rows) * max(rows)), 6) AS aux_loss, round(min(n) / (max(rows) * {TOP_K}), 6) AS assignment_min_frac, round(max(n) / (max(rows) * {TOP_K}), 6) AS assignment_max_frac,
round(stddev_pop(n) / avg(n), 6) AS assignment_cv, round(sum(h) / max(rows), 6) AS router_entropy, count(*) FILTER (WHERE n = 0) AS unused_experts FROM counts JOIN soft USING (expert), r""")
def load_balance_stats(spark, sf_dir):
    probs = _probs(spark, sf_dir)
    found = E.balance(probs, E.top_k(probs, TOP_K), EXPERTS, TOP_K)
    return found.select(*[F.round(c, 6).alias(c) if c != "unused_experts" else F.col(c) for c in found.columns])


@_query(f"""WITH l AS (SELECT vec_id, label % {EXPERTS} AS target, [CAST(x AS DOUBLE) FOR x IN embedding[1:{EXPERTS}]] AS z FROM embeddings)
SELECT vec_id, round(ln(list_sum([exp(x) FOR x IN z])) - z[target + 1], 6) AS loss FROM l""")
def cross_entropy_rows(spark, sf_dir):
    logits = F.transform(F.slice("embedding", 1, EXPERTS), lambda x: x.cast("double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", logits.alias("z"), (F.col("label") % EXPERTS).cast("int").alias("target"))
    return rows.select("vec_id", F.round(E.cross_entropy(F.col("z"), F.col("target")), 6).alias("loss"))


@_query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), m AS (SELECT *, sqrt(list_sum([x * x FOR x IN v]) / len(v) + 1e-6) AS r FROM e)
SELECT vec_id, round(list_sum([x / r FOR x IN v]), 6) AS total, round(v[1] / r, 6) AS first FROM m""")
def rms_norm(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("y", E.rms_norm(F.col("v")))
    return rows.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("y", F.lit(0)), 6).alias("first"))


@_query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(32)) AS i FROM e),
r AS (SELECT vec_id, i, v[i + 1] AS a, v[i + 33] AS b, (vec_id % 100) * pow(10000.0, -(i / 32.0)) AS t FROM i)
SELECT vec_id, round(sum(i * (a * cos(t) - b * sin(t))), 4) AS first, round(sum(i * (b * cos(t) + a * sin(t))), 4) AS second FROM r GROUP BY vec_id""")
def rotary_positions(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", E.rotate_half(v, F.col("vec_id") % 100).alias("y"))
    weighted = lambda part: F.aggregate(F.transform(part, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(weighted(F.slice("y", 1, 32)), 4).alias("first"), F.round(weighted(F.slice("y", 33, 32)), 4).alias("second"))


@_query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(32)) AS i FROM e),
r AS (SELECT vec_id, i, v[i + 1] AS a, v[i + 33] AS b, (vec_id % 100) * pow(10000.0, -(i / 32.0)) AS t FROM i)
SELECT vec_id, round(sum(i * (a * cos(t) - b * sin(t))), 4) AS first, round(sum(i * (b * cos(t) + a * sin(t))), 4) AS second FROM r GROUP BY vec_id""")
def rotary_lookup(spark, sf_dir):
    """Angles come from a table by position instead of from arithmetic."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 100).alias("position"), v.alias("v"))
    turned = E.looked_up(rows, E.rotary_table(spark, 100, 64), "position").select("vec_id", E.rotate_with(F.col("v"), F.col("cos"), F.col("sin")).alias("y"))
    weighted = lambda part: F.aggregate(F.transform(part, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return turned.select("vec_id", F.round(weighted(F.slice("y", 1, 32)), 4).alias("first"), F.round(weighted(F.slice("y", 33, 32)), 4).alias("second"))


@_query("SELECT label, round(sqrt(sum(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding]))), 6) AS norm FROM embeddings GROUP BY label")
def frobenius_norms(spark, sf_dir):
    """Of the matrix of each label's vectors."""
    return _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(E.frobenius_norm("embedding"), 6).alias("norm"))


@_query("SELECT event_id, round(value / (1 + exp(-value)), 6) AS silu FROM events")
def silu_values(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.round(E.silu(F.col("value")), 6).alias("silu"))


# Streams and builds


@_query(f"{PACKED} SELECT ord, n, CAST(batch AS BIGINT) AS batch FROM packed")
def streamed_packing(spark, sf_dir):
    """Documents that arrive in three parts, packed as they come."""
    lengths, window = _lengths(spark, sf_dir)
    folder, n = scratch(spark, "arrivals"), lengths.count()
    for k in range(3):
        lengths.where((F.col("ord") * 3 >= k * n) & (F.col("ord") * 3 < (k + 1) * n)).write.mode("append").parquet(f"{folder}/lengths")
        pack_incrementally(spark, f"{folder}/lengths", f"{folder}/packed", f"{folder}/state", window)
    return read_packed(spark, f"{folder}/packed")


@_query(f"""WITH {DOCS} SELECT ord, CAST(n + 1 AS BIGINT) AS n_tokens, n_bytes FROM (SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, n, n_bytes FROM docs WHERE n_bytes <= {BYTE_LIMIT})""")
def cache_roundtrip(spark, sf_dir):
    """A cache built from the documents and read back."""
    out = scratch(spark, "cache")
    build.build(spark, f"{sf_dir}/documents.parquet", out, max_bytes=BYTE_LIMIT, shard_tokens=SHARD)
    return build.load(spark, out).select("ord", F.size("tokens").cast("long").alias("n_tokens"), "n_bytes")


@_query(f"""WITH RECURSIVE {DOCS.replace("FROM documents", f"FROM documents WHERE strlen(text) <= {BYTE_LIMIT}")}, {_bijection_sql(7)}
SELECT place AS ord, CAST(n + 1 AS BIGINT) AS n_tokens, n_bytes, sha256(text) AS text_sha256 FROM docs JOIN places USING (ord)""")
def shuffled_cache(spark, sf_dir):
    """A cache in a keyed order, built and read back: its tokens are those of the texts."""
    out = scratch(spark, "cache")
    build.build(spark, f"{sf_dir}/documents.parquet", out, max_bytes=BYTE_LIMIT, shard_tokens=SHARD, shuffle_seed=7, shuffle="bijection")
    text = X.decode_bytes(F.slice("tokens", F.lit(2), F.size("tokens") - 2))
    return build.load(spark, out).select("ord", F.size("tokens").cast("long").alias("n_tokens"), "n_bytes", F.sha2(text.cast("binary"), 256).alias("text_sha256"))
