"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, mixing, near_dedup, neighbours, packing, substring_bytes, substring_words, token_counts, warc
from .common import materialise, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), new_path(spark, "archives"))
    records = materialise(warc.read_archives(spark, path).drop("payload", "url"), "warc-records")
    return warc.resolve_revisits(records, ("payload_bytes",))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_bytes.remove_repeats(table(spark, sf_dir, "documents")).drop("text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.remove_repeats(table(spark, sf_dir, "documents")).drop("text")


#: Target weights of the mix: of domains, then of languages and sources within them.
MIX_WEIGHTS = [
    ("domain", "web", 4), ("domain", "books", 3), ("domain", "news", 2), ("domain", "forum", 1),
    ("lang", "en", 5), ("lang", "de", 2), ("lang", "fr", 2), ("lang", "es", 1),
    ("source", "src0", 3),
]
#: Domains by the number of the source, modulo 4.
DOMAINS = ("web", "books", "news", "forum")


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.coalesce(F.try_to_number(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    return docs.withColumn("domain", F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))) + 1))


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "level string, value string, weight long")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mixing.mix(docs, ["domain", "lang", "source"], mix_weights(spark), budget_share=0.6, max_epochs=2, seed=17)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(language_id.fold() != 1))
    out = language_id.identify(docs, model)
    return out.select("doc_id", F.coalesce(language_id.fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op10_nn_descent": op10_nn_descent,
    "op8_token_counts": op8_token_counts,
    "op5_mixing": op5_mixing,
    "op9_language_id": op9_language_id,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op1_warc_revisits": op1_warc_revisits,
    "op3_substring_dedup": op3_substring_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op4_exact_dedup": op4_exact_dedup,
}

OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS target FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN target = page_id THEN NULL ELSE target END AS refers_to
FROM w
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS digest
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       digest AS text_sha256
FROM d WINDOW w AS (PARTITION BY digest ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

def _share_sql(source: str, parent: str, name: str) -> str:
    """The children of ``source`` with their whole-token shares, as ``given``."""
    p = f"PARTITION BY {parent}" if parent else ""
    return f"""
      SELECT * EXCLUDE (f_at, c0, w0, filled, rest, ws, over_, base, spare, place),
             base + CASE WHEN NOT filled AND place <= spare THEN 1 ELSE 0 END AS given
      FROM (SELECT *, row_number() OVER ({p} ORDER BY filled, over_ DESC, {name}) AS place,
                   budget - sum(base) OVER ({p}) AS spare
      FROM (SELECT *, CASE WHEN filled THEN capacity ELSE rest * weight // ws END AS base,
                   CASE WHEN NOT filled THEN rest * weight % ws END AS over_
      FROM (SELECT *, budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({p}), 0) AS rest,
                   coalesce(sum(CASE WHEN NOT filled THEN weight END) OVER ({p}), 1) AS ws
      FROM (SELECT *, capacity * w0 <= weight * (budget - c0) AS filled
      FROM (SELECT *, coalesce(sum(capacity) OVER ({p} ORDER BY f_at, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
                   sum(weight) OVER ({p}) - coalesce(sum(weight) OVER ({p} ORDER BY f_at, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0
      FROM (SELECT *, capacity::DOUBLE / weight::DOUBLE AS f_at FROM {source}))))))"""


def _mix_sql() -> str:
    weight = lambda level: f"coalesce((SELECT w.weight FROM w WHERE w.level = '{level}' AND w.value = {level}), 1)::HUGEINT"
    values = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in MIX_WEIGHTS)
    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    return f"""
    WITH w(level, value, weight) AS (VALUES {values}),
    d AS (
      SELECT doc_id, [{domains}][coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 4 + 1] AS domain,
             coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(ceil(strlen(text) / 4), 0)::HUGEINT AS doc_tokens
      FROM documents
    ), rows_ AS (SELECT * FROM d WHERE doc_tokens > 0),
    leaf AS (SELECT domain, lang, source, sum(doc_tokens)::HUGEINT AS size, sum(doc_tokens)::HUGEINT * 2 AS capacity, {weight('source')} AS weight FROM rows_ GROUP BY ALL),
    mid AS (SELECT domain, lang, sum(capacity)::HUGEINT AS capacity, {weight('lang')} AS weight FROM leaf GROUP BY ALL),
    top AS (SELECT domain, sum(capacity)::HUGEINT AS capacity, {weight('domain')} AS weight FROM mid GROUP BY ALL),
    all_ AS (SELECT least(floor(sum(size) * 0.6::DOUBLE)::HUGEINT, sum(capacity)::HUGEINT) AS budget FROM leaf),
    top_in AS (SELECT top.*, budget FROM top, all_), top_out AS ({_share_sql('top_in', '', 'domain')}),
    mid_in AS (SELECT mid.*, t.given AS budget FROM mid JOIN top_out t USING (domain)), mid_out AS ({_share_sql('mid_in', 'domain', 'lang')}),
    leaf_in AS (SELECT leaf.*, m.given AS budget FROM leaf JOIN mid_out m USING (domain, lang)), leaf_out AS ({_share_sql('leaf_in', 'domain, lang', 'source')}),
    plan AS (SELECT domain, lang, source, (given // size)::BIGINT AS whole, given % size AS part FROM leaf_out),
    o AS (
      SELECT r.*, whole, part, sum(doc_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')), doc_tokens ROWS UNBOUNDED PRECEDING) - doc_tokens AS before
      FROM rows_ r JOIN plan USING (domain, lang, source)
    )
    SELECT doc_id, domain, lang, source, epoch, doc_tokens::BIGINT AS doc_tokens, taken::BIGINT AS taken
    FROM (SELECT *, CASE WHEN epoch < whole THEN doc_tokens ELSE greatest(0, least(doc_tokens, part - before)) END AS taken
          FROM (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM o))
    WHERE taken > 0"""


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(words))) AS pos, unnest(words) AS word FROM d),
s AS (SELECT doc_id, unnest(generate_series(1, len(words) - 49)) AS pos, words FROM d WHERE len(words) >= 50),
k AS (SELECT doc_id, pos, md5(array_to_string(words[pos : pos + 49], ' ')) AS key FROM s),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
r AS (SELECT k.doc_id, k.pos FROM k JOIN f USING (key) WHERE f.first < k.doc_id),
m AS (SELECT w.doc_id, w.pos, w.word, coalesce(max(CASE WHEN r.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept,
             count(*) FILTER (gone AND NOT before) AS n_spans
      FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_ >= 85 * (nx.n + ny.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, e.y FROM c JOIN e ON e.x = c.r),
m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


ORACLE_SQL = {
    "op3_substring_dedup": OP3_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op5_mixing": _mix_sql(),
    "op1_warc_revisits": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
}
