"""The operators on the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, byte_bpe, centroids, cross_polytope, exact_dedup, inner_topk, language_id, license_scan, merkle, packing, quality, simhash, url_filter
from .common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and the components of those within 3 bits."""
    return simhash.near_groups(_table(spark, sf_dir, "documents"), words=3, bits=64, radius=3)


@_query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of 4096 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts and the bytes that they decode to, as digests."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


# Spark's and DuckDB's texts are the same code points, so sha256 of the UTF-8 bytes agrees.
@_query(r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
ranked AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for blanks, and the row of each that stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("n_points")


@_query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts by a model that never saw the fold of remainder 0."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs.select("doc_id", "text"), labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts by trees that never saw the fold of remainder 2."""
    docs = _table(spark, sf_dir, "documents")
    trees = language_id.train(docs.where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), trees).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@_query("""
WITH wide AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, b.vec_id, CAST(list_inner_product(q.v, b.v) AS BIGINT) AS score
  FROM wide q, wide b WHERE q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op10_inner_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    return inner_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


#: Verdicts on a host, with its subdomains, and the start of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@_query()
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs, by rule or by the model."""
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES, model)


PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (("released under the mit license", "mit"), ("licensed under the apache license version 2 0", "apache-2"), ("licensed under cc by nc 4 0", "cc-by-nc"),
             ("this work is licensed under the gnu general public license version 3", "gpl-3"))


def _license_sql() -> str:
    """The scan by list functions: places of phrases in the words, and each window's tokens against each template."""
    stride = max(len(words.split()) for words, _ in TEMPLATES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places, labels = [], []
    for phrase, label in PHRASES:
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
        places.append(f"list_filter(range(len(words)), lambda i: {same})")
        labels.append(f"CASE WHEN len({places[-1]}) > 0 THEN '{label}' END")
    sets = [(sorted(set(words.split())), label) for words, label in TEMPLATES]
    shares = ", ".join("{'label': '%s', 'share': len(list_intersect(have, %s)) / %d}" % (label, list(tokens), len(tokens)) for tokens, label in sets)
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS words FROM t),
p AS (SELECT doc_id, words, len(words) AS n_words, list_concat({", ".join(places)}) AS spots, list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL) AS base FROM w),
l AS (SELECT doc_id, list_distinct(unnest(list_transform(range(0, greatest(len(words), 1), {stride}), lambda i: words[i + 1:i + {2 * stride}]))) AS have FROM p),
s AS (SELECT doc_id, unnest([{shares}]) AS hit FROM l),
b AS (SELECT doc_id, list(DISTINCT hit.label) AS more, max(hit.share) AS share FROM s WHERE hit.share >= 0.8 GROUP BY 1)
SELECT p.doc_id, n_words, len(spots) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(spots) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN b ON b.doc_id = p.doc_id"""


@_query(_license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of all texts by place, and the labels of passages like a template."""
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASES, TEMPLATES)


@_query()
def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all texts by a model that never saw the fold of remainder 1."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = backoff_lm.train(docs.where(remainder("doc_id", 5) != 1))
    return backoff_lm.score(docs, model, last=True).select(
        "doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


@_query()
def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found by cosine to every fiftieth vector."""
    return cross_polytope.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def _cluster_sql(k: int, rounds: int) -> str:
    """The rounds one after another; whole numbers of this size are exact in doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT vec_id, v, n, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) AS d FROM x, c{r}),
a{r} AS (SELECT vec_id, v, CAST(min(n) AS INTEGER) AS cluster, d AS distance FROM d{r} WHERE d = (SELECT min(e.d) FROM d{r} e WHERE e.vec_id = d{r}.vec_id) GROUP BY vec_id, v, d)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT cluster, i, floor(sum(y) / count(*)) AS y FROM (SELECT cluster, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(y ORDER BY i) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT n, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = n)""")
    return f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS n, v AS c FROM x ORDER BY sha256('2:' || vec_id) LIMIT {k}),
{",".join(steps).replace(" AS (", " AS MATERIALIZED (")}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON n = cluster"""


@_query(_cluster_sql(40, 5))
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors around 40 centroids after 5 rounds."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0, seed=2)


def _merkle_sql() -> str:
    """Levels by recursion over grouped nodes; proofs and folds by recursion over each row's levels."""
    def leaf(n_chars: str) -> str:
        values = ["doc_id", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"

    bits = "list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, length(t) + 1), lambda i: list_concat([ascii(t[i])::UBIGINT], list_transform(range(8), lambda j: 256::UBIGINT)))))"
    crc = f"xor(list_reduce({bits}, lambda a, e: CASE WHEN e < 256 THEN xor(a, e) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END), 4294967295::UBIGINT)"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT *, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS bad, CAST(doc_id AS VARCHAR) AS t FROM documents),
g AS (SELECT lang AS grp, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
p AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN {crc} % 7 = 0 THEN bad ELSE leaf END AS used, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM d JOIN g ON lang IS NOT DISTINCT FROM grp),
low AS (SELECT tree, 0 AS lvl, pos, leaf AS h FROM p
  UNION ALL SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, lvl, pos // 2),
sub AS MATERIALIZED (SELECT tree, lvl AS tall, h AS subroot FROM low QUALIFY row_number() OVER (PARTITION BY tree ORDER BY lvl DESC) = 1),
high AS (SELECT 0 AS lvl, tree AS pos, subroot AS h FROM sub
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY lvl, pos // 2),
top AS (SELECT lvl AS tall, h AS root FROM high ORDER BY lvl DESC LIMIT 1),
steps AS MATERIALIZED (
  SELECT p.tree, p.pos, r.lvl AS k, (p.pos >> r.lvl) & 1 AS side, n.h FROM p JOIN sub USING (tree), LATERAL (SELECT unnest(range(tall))) r(lvl) LEFT JOIN low n ON n.tree = p.tree AND n.lvl = r.lvl AND n.pos = xor(p.pos >> r.lvl, 1)
  UNION ALL
  SELECT p.tree, p.pos, s.tall + r.lvl, (p.tree >> r.lvl) & 1, n.h FROM p JOIN sub s USING (tree), top, LATERAL (SELECT unnest(range(top.tall))) r(lvl) LEFT JOIN high n ON n.lvl = r.lvl AND n.pos = xor(p.tree >> r.lvl, 1)),
proof AS (SELECT tree, pos, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256, count(*) AS n FROM steps GROUP BY tree, pos),
fold AS (SELECT tree, pos, CAST(0 AS BIGINT) AS k, used AS h FROM p
  UNION ALL SELECT tree, pos, f.k + 1, sha256(CASE WHEN side = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END) FROM fold f JOIN steps s USING (tree, pos, k))
SELECT p.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM p JOIN sub USING (tree) CROSS JOIN top LEFT JOIN proof USING (tree, pos) JOIN fold ON fold.tree = p.tree AND fold.pos = p.pos AND fold.k = coalesce(proof.n, 0)"""


@_query(_merkle_sql())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, proofs and the root of all documents by language; every seventh, by crc32, is tampered with."""
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    longer = (F.col("n_chars").cast("decimal(38,0)") + 1).alias("n_chars")
    return merkle.manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": longer}, tamper)
