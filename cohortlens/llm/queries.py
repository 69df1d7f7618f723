"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import collocations, learned_index, lengths, mixing, packing, ppm, secrets, simhash, topk, toxicity, trie, urls, warc
from cohortlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
w AS (SELECT k, source_size, 2.0::DOUBLE * source_size AS most,
        ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS weight FROM s),
p AS (SELECT most, weight, sum(most) OVER before AS spent, sum(weight) OVER after AS left_over,
        (SELECT sum(source_size) FROM s)::DOUBLE * 1.5 AS share
      FROM w WINDOW before AS (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    after AS (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lv AS (SELECT max((share - coalesce(spent, 0)) / left_over) AS level FROM p),
t AS (SELECT k, source_size, least(most, weight * level) AS target,
        CASE WHEN source_size > 0 THEN least(most, weight * level) / source_size ELSE 0 END AS rate,
        (('0x' || substr(md5('7|' || k), 1, 5))::BIGINT)::DOUBLE / 1048576.0::DOUBLE AS u
      FROM w, lv),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size, doc_id) AS n FROM sized)
SELECT doc_id, size, source_size, target,
  size * least(floor(n * rate + u) - floor((n - 1) * rate + u), ceil(rate))::BIGINT AS taken
FROM d JOIN t USING (k)
"""


@query("op2_mix_sources", MIX_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their source's target and the words the mix takes of each."""
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_simhash_near_duplicates")
def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their 3-word-shingle fingerprint and their component at 2 bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=2, shingle=3)


@query("op7_scan_secrets")
def op7_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the secrets in their whole text: counts, a digest of the base spans, all spans."""
    return secrets.digest(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


@query("op8_warc_bundles", WARC_SQL)
def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in seekable bundles and read back."""
    bundles = warc.write_bundles(warc.decisions(table(spark, sf_dir, "pages")))
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_length_histogram")
def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of all documents' encoded lengths, with what every context limit leaves."""
    return lengths.length_sums(table(spark, sf_dir, "documents"), _vocabulary())


@query("op10_pack_best_fit")
def op10_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary())


@query("op6_classify_toxicity")
def op6_classify_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the convolutional classifier trained on the labels that aren't held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op9_filter_urls")
def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' urls judged by the rules, and by the boosted trees where no rule fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, places=urls.SECTIONS).select("page_id", "host", "path", "rule", "verdict")


@query("op1_learned_partitions")
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector among all others."""
    return learned_index.nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0, k=10)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, [floor(64.0::DOUBLE * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.w[i] * c.w[i] FOR i IN range(1, len(q.w) + 1)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op3_exact_top_k", TOP_K_SQL)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0, k=20, scale=64.0)



TRIE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST,
          md5(length(role)::VARCHAR || ':' || role || text), length(text)) AS w FROM t GROUP BY conv_id),
b AS (SELECT *, list_reduce([4294967295::UBIGINT] || [ascii(c)::UBIGINT FOR c IN string_split(conv_id::VARCHAR, '')],
        lambda a, x : list_reduce([xor(a, x)] || [i::UBIGINT FOR i IN range(8)],
          lambda v, i : xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0 END))) AS crc FROM own),
h AS (SELECT conv_id, w, (xor(crc, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM b),
built AS (SELECT h.conv_id, coalesce(o.w[1 : h.h], []) || coalesce(h.w[h.h + 1 :], []) AS w
          FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100),
pre AS (SELECT conv_id, len(w) AS size, w, unnest(range(0, len(w) + 1)) AS depth FROM built),
keyed AS (SELECT conv_id, size, depth, w[1 : depth] AS key, w[1 : depth - 1] AS up FROM pre),
node AS (SELECT key, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
         FROM keyed GROUP BY key, depth),
kids AS (SELECT up AS key, depth - 1 AS depth, count(*)::BIGINT AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children,
            CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.key[-1].t) ELSE 0 END AS own_saved
          FROM node n LEFT JOIN kids k ON k.key = n.key AND k.depth = n.depth),
spread AS (SELECT *, unnest(range(0, depth + 1)) AS d FROM whole),
sums AS (SELECT key[1 : d] AS key, d AS depth, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(own_saved)::BIGINT AS saved_tokens FROM spread GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM whole w JOIN sums s ON s.key = w.key AND s.depth = w.depth
LEFT JOIN whole p ON p.key = w.up AND p.depth = w.depth - 1 AND w.depth > 0
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return trie.trie(trie.rebuilt(trie.sequences(table(spark, sf_dir, "conversations"))))

COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
n AS (SELECT lang, count(*)::BIGINT AS n FROM starts GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
          FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT c.*, unnest(range(1, words)) AS cut FROM cand c),
sized AS (SELECT c.lang, c.phrase, c.words, c.a, c.cut, x.f AS l, y.f AS r,
            (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
          FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ') AND x.k = c.cut
          JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 : c.words], ' ') AND y.k = c.words - c.cut),
low AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS a
           FROM (SELECT lang, w, words, a, unnest(range(1, words)) AS i FROM cand WHERE words > 2), (SELECT unnest([2, 3]) AS k)
           WHERE k < words AND i + k - 1 <= words GROUP BY ALL),
kept AS (SELECT l.* FROM low l LEFT JOIN around o ON o.lang = l.lang AND o.phrase = l.phrase
         WHERE o.a IS NULL OR 100::HUGEINT * o.a < 80::HUGEINT * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""


@query("op12_phrase_collocations", COLLOCATION_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 highest-scored phrases of 2 to 4 words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_identify_languages")
def op13_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the language whose frozen byte contexts code them shortest."""
    return ppm.identify(table(spark, sf_dir, "documents"))
