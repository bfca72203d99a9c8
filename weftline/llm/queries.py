"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import best_fit, bpe_trie, exact_dedup, jaccard_join, knn_join, language_id, line_dedup, lm_score, merkle, piece_sampling, spelling, token_frames, warc
from weftline.session import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents"), size=4, num=85, den=100).drop("class_id", "text_hash")


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.score_corpus(docs, good)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"), digest_all=True)


SQL["op4_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query
def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


@query
def op6_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return knn_join.top_k(rows, rows.filter("vec_id % 50 = 0"), 5)


SQL["op6_knn_join"] = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3).drop("keep_bitmap")


SQL["op8_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS largest FROM k WHERE len(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> largest AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    index = token_frames.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_frames.read_tokens(index, folder, ids=False).withColumnRenamed("id", "doc_id")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "archives")
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder, min_payload=100)
    records = warc.read_records(index, folder, payloads=False)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op10_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY 1),
j AS (SELECT p.*, first_id, payload_bytes >= 100 AND page_id <> first_id AS again FROM p JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first_id END AS refers_to
FROM j
"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), min_letters=6, min_count=5, times=5, one_in=199)


SQL["op11_spelling"] = """
WITH RECURSIVE crc_of_byte AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY n) AS t
    FROM range(256) AS r(n)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([
        CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END
        FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')])),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM own, crc_of_byte),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
cut AS (SELECT word, k, substr(word, 1, k - 1) AS l, substr(word, k + 1) AS r FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)),
shorter AS (SELECT DISTINCT cut.word AS x, w.word AS y FROM cut JOIN w ON w.word = l || r),
near AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b USING (k, l, r) WHERE a.word <> b.word
    UNION SELECT x, y FROM shorter UNION SELECT y, x FROM shorter),
best AS (SELECT x, y, n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS place FROM near JOIN w ON w.word = y),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN y END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
    FROM w LEFT JOIN best b ON x = word AND place = 1),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root AND f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root AND f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(docs.doc_id.cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(docs.text)
    return merkle.prove_rows(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": tampered})


SQL["op12_merkle"] = """
WITH RECURSIVE d AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, text,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
        FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS crc FROM documents),
h AS (SELECT doc_id, tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS other
    FROM (SELECT *, CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS other FROM d)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
up AS (SELECT tree, 0 AS level, pos, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM leaves UNION ALL
    SELECT tree, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subroots AS (SELECT tree, hash FROM up WHERE n = 1),
top AS (SELECT 0 AS level, tree AS pos, hash, count(*) OVER () AS n FROM subroots UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
beside AS (SELECT tree, level, pos, n,
    coalesce(string_agg(hash, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(hash, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
    FROM (SELECT * FROM up UNION ALL SELECT -1 AS tree, level, pos, hash, n FROM top)),
inner_fold AS (SELECT doc_id, leaf, tree, pos AS leaf_pos, 0 AS level, pos, other AS hash, '' AS proof FROM leaves UNION ALL
    SELECT doc_id, leaf, f.tree, leaf_pos, f.level + 1, f.pos // 3, sha256(b || hash || a), proof || b || a
    FROM inner_fold f JOIN beside s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos AND n > 1),
at_subroot AS (SELECT f.* FROM inner_fold f JOIN beside s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos AND n = 1),
outer_fold AS (SELECT doc_id, leaf, tree, leaf_pos, 0 AS level, tree AS pos, hash, proof FROM at_subroot UNION ALL
    SELECT doc_id, leaf, f.tree, leaf_pos, f.level + 1, f.pos // 3, sha256(b || hash || a), proof || b || a
    FROM outer_fold f JOIN beside s ON s.tree = -1 AND s.level = f.level AND s.pos = f.pos AND n > 1),
at_root AS (SELECT f.* FROM outer_fold f JOIN beside s ON s.tree = -1 AND s.level = f.level AND s.pos = f.pos AND n = 1)
SELECT doc_id, leaf, subroots.hash AS subroot, root.hash AS root, sha256(proof) AS proof_sha256, at_root.hash AS folded_root,
    at_root.hash = root.hash AS verified
FROM at_root JOIN subroots USING (tree), (SELECT hash FROM top WHERE n = 1) AS root
"""


@query
def op13_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
