"""Named queries of the training-data operators, over the given tables, and their SQL."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as decon
from tidemark.llm import (
    impacts, jaccard, language, periods, personal, pieces, recompress, repeats, secrets, token_files, tries, word_pieces,
)
from tidemark.sources.files import shared_folder

QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in a ten-word window of a benchmark item."""
    found = decon.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decon.n_hit().alias("n_hit"), F.size(F.array_distinct("hit_items")).cast("long").alias("n_items"),
        decon.items_digest().alias("items_sha256"), (decon.n_hit() > 0).alias("contaminated"),
    )


ORACLES["op10_decontamination"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id
), it AS (
    SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as wavelet matrices and read back."""
    path = f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether decoding them gives the text back."""
    model = tokenizer_file("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return found.select(
        "doc_id", "n_pieces", F.crc32(F.coalesce("ids", F.lit(b""))).alias("ids_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of every document."""
    return word_pieces.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by patterns, and tokens of like format."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans")


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_iban", "n_ssn", "n_local_phone",
        F.sha2(personal.named(personal.base_only(F.col("found"))), 256).alias("base_sha256"),
        personal.named(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    rows = impacts.quantised(table(spark, sf_dir, "embeddings"))
    return impacts.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


ORACLES["op4_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, training=~language.held_out())
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that lie in no string of 200 bytes that occurs again."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLES["op1_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
    SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS g
    FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 199 AS BIGINT))) AS i FROM d WHERE length(h) >= 400)
), r AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)
), m AS (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS first FROM r
), s AS (
    SELECT doc_id, run, min(i) AS b, max(i) + 200 AS e
    FROM (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m) GROUP BY doc_id, run
), t AS (
    SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM s
), k AS (
    SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS tail,
        string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (b - before) AS BIGINT)), '' ORDER BY b) AS head
    FROM t JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are at least 80 % alike."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


ORACLES["op5_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
), c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


#: crc32 of the decimal conv_id, modulo 4.
_HEAD = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, 1 + len(s)),
    lambda i: [ascii(s[i::INTEGER])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b:
    CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) & 3"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of conversations that share the fronts of every twentieth."""
    found = tries.paths(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    head = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")
    return tries.prefix_trie(tries.spliced(found, conv - conv % 20, head, most=3))


ORACLES["op11_conversation_trie"] = rf"""
WITH s AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
    SELECT conv_id, turn, substr(sha256(concat(strlen(role), ':', role, text)), 1, 32) AS x,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM s
), o AS (
    SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS xs, list(w ORDER BY turn NULLS FIRST, x) AS ws FROM t GROUP BY conv_id
), c AS (
    SELECT conv_id, xs, ws, {_HEAD} AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM o)
), r AS (
    SELECT c.conv_id, list_concat(coalesce(b.xs[1:c.h], []), c.xs[c.h + 1:]) AS xs,
        list_concat(coalesce(b.ws[1:c.h], []), c.ws[c.h + 1:]) AS ws
    FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20
), n AS (
    SELECT conv_id, d, len(xs) AS m, array_to_string(xs[1:d], ',') AS node, CASE WHEN d > 0 THEN array_to_string(xs[1:d - 1], ',') END AS parent,
        CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w
    FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM r)
), a AS (
    SELECT node, min(d) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = m), '')) AS ends
    FROM n GROUP BY node
), k AS (SELECT parent AS node, count(*) AS n FROM a WHERE parent IS NOT NULL GROUP BY parent
), u AS (SELECT DISTINCT x.node AS top, y.node AS node FROM n x JOIN n y ON x.conv_id = y.conv_id AND x.d <= y.d
), z AS (
    SELECT top AS node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((a.n_convs - 1) * a.w) AS saved
    FROM u JOIN a ON a.node = u.node LEFT JOIN k ON k.node = u.node GROUP BY top
)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(k.n, 0) AS n_children,
    z.n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM a JOIN z ON z.node = a.node LEFT JOIN k ON k.node = a.node LEFT JOIN a p ON p.node = a.parent
"""


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, in every tenth with a tail that repeats itself; a null doc_id leaves them as they are."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and the text with each cut to one period."""
    found = periods.find_runs(table(spark, sf_dir, "documents"), rewrite=repeated_tail)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in no passage of 20 words that occurs earlier."""
    found = recompress.remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op13_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), r AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM x) WHERE k > 1
), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r
), p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), k AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS rest FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
