"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import align, centroids, chat, decontaminate, html, lm, neardup, packing, pieces, quality, topk, toxicity, warc

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS head,
         length(replace(text, '\', '\0')) + 2 * (length(text) - length(regexp_replace(text, '#+', '#', 'g')))
         + 2 * ((length(text) - length(regexp_replace(text, '</(turn|part)>', '', 'g'))) // 7) AS esc
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(esc + 7 + CASE WHEN head THEN 7 + length(role) ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query(OP1_SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(turns.unionByName(extra))


@query()
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("n_passages", F.size("passages")).drop("passages")


@query()
def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, pos, floor(256 * x::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos, embedding FROM embeddings)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.pos = c.pos AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


@query(OP4_SQL)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by 50."""
    v = table(spark, sf_dir, "embeddings")
    return topk.top_k(v, v.where("vec_id % 50 = 0"), 5)


OP3_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), l AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL
), w AS (
  SELECT kind, id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS pos FROM l
), g AS (
  SELECT kind, id, n, pos, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS shingle
  FROM w WINDOW o AS (PARTITION BY kind, id ORDER BY pos)
), s AS (
  SELECT DISTINCT kind, id, shingle FROM g WHERE pos <= greatest(0, n - 5)
), i AS (
  SELECT id, shingle, count(*) OVER (PARTITION BY id) AS n FROM s WHERE kind = 'i'
)
SELECT d.id AS doc_id, i.id AS item_id, i.n AS n_shingles, count(*) AS n_shared
FROM s d JOIN i ON d.shingle = i.shingle WHERE d.kind = 'd'
GROUP BY 1, 2, 3 HAVING count(*) * 100 >= i.n * 75
"""


@query(OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
         || chr(13) || chr(10) || 'WARC-Record-ID: <urn:x-page:' || page_id::VARCHAR || '>' || chr(13) || chr(10)
         || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html
         || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM p
), d AS (
  SELECT page_id // 512 AS file, page_id, strlen(rec)::BIGINT AS length, sha256(rec) AS digest FROM r
)
SELECT file, page_id, (sum(length) OVER (PARTITION BY file ORDER BY page_id, digest) - length)::BIGINT AS "offset", length, digest,
       CASE WHEN page_id % 101 = 7 THEN 'corrupt' WHEN page_id % 211 = 5 THEN 'missing' ELSE 'intact' END AS state
FROM d
"""


@query(OP5_SQL)
def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, against a replica in which one byte of some is changed and some are missing."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    body = F.coalesce("html", F.lit(""))
    damaged = F.when(F.pmod("page_id", F.lit(101)) == 7, F.concat(F.substring(body, 1, 20), F.lit("\x01"), F.substring(body, 22, F.length(body)))).otherwise(body)
    copies = pages.where(~((F.pmod("page_id", F.lit(211)) == 5) & (F.pmod("page_id", F.lit(101)) != 7)))
    return warc.fixity(pages, copies.withColumn("html", damaged))


@query()
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    out = pieces.encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


@query()
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, aligned between a byte-level vocabulary and one of pieces."""
    return align.alignment_digests(table(spark, sf_dir, "documents"))


@query()
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's tokens in sequences of 4,096."""
    return packing.pack(table(spark, sf_dir, "documents"))


def _op13_sql(rounds: int = 10) -> str:
    """Each round as two tables: the assignment and the centroids made of it."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q FROM v
  ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q LIMIT 8
)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT v.row, min({{'d': list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS m
  FROM v, c{n} c GROUP BY v.row
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(g.q, c.q) AS q FROM c{n} c LEFT JOIN (
    SELECT c, list(m ORDER BY pos) AS q FROM (
      SELECT c, pos, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM (SELECT a.m.c AS c, unnest(v.q) AS x, unnest(range(64)) AS pos FROM a{n} a JOIN v USING (row)) GROUP BY c, pos
    ) GROUP BY c
  ) g ON c.c = g.c
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT v.vec_id, a.m.c::INTEGER AS cluster, a.m.d AS distance, sum(a.m.d) OVER (PARTITION BY a.m.c)::BIGINT AS cluster_inertia,
       sum(a.m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON c.c = a.m.c"""


@query(_op13_sql())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components, in 8 clusters after 10 rounds."""
    return centroids.clusters(table(spark, sf_dir, "embeddings"))
