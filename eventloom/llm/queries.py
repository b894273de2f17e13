"""The registered query of each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, cover_tree, jaccard_join, language_id, lexical, media, mixing, prefix_trie, sentencepiece_codec, sharding, url_filters, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _digit(host: str, at: int) -> F.Column:
    """A number from 0 to 255 that a host's MD5 gives."""
    return F.conv(F.substring(F.md5(F.col(host).cast("binary")), at, 2), 16, 10).cast("int")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a dated list. The captures' times and the list's entries follow from ids and hosts by fixed rules."""
    origin = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_add("DAY", F.pmod(F.col("page_id") * 37, F.lit(90)).cast("int"), origin))
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    day = lambda at, plus: F.timestamp_add("DAY", _digit("host", at) % 60 + plus, origin)
    dated = F.array(
        F.struct(F.col("host").alias("key"), F.lit("block").alias("action"), day(1, 0).alias("dated"), (_digit("host", 3) % 3 == 0).alias("on")),
        F.struct(F.col("host").alias("key"), F.lit("lift").alias("action"), day(1, 20).alias("dated"), (_digit("host", 3) % 2 == 0).alias("on")),
        F.struct(F.concat("host", F.lit("/en")).alias("key"), F.lit("allow").alias("action"), day(5, 0).alias("dated"), (_digit("host", 7) % 4 == 0).alias("on")),
    )
    entries = hosts.select(F.explode(dated).alias("x")).where("x.on").select("x.key", "x.action", "x.dated")
    out = url_filters.evaluate(captures, entries)
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("page_id", "url", text("fetched_at"), "list_key", "list_action", text("listed_since"), "blocked")


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)), '\.$', '')"
OP1_SQL = rf"""
WITH captures AS (
  SELECT row_number() OVER () AS row_id, page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id * 37) % 90 + 90) % 90 AS INTEGER) AS DATE) AS fetched,
         {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host, md5(host) AS h FROM captures WHERE host <> ''),
n AS (SELECT host, CAST('0x' || substr(h, 1, 2) AS INTEGER) AS a, CAST('0x' || substr(h, 3, 2) AS INTEGER) AS b,
             CAST('0x' || substr(h, 5, 2) AS INTEGER) AS c, CAST('0x' || substr(h, 7, 2) AS INTEGER) AS d FROM hosts),
entries AS (
  SELECT host AS key, 'block' AS action, DATE '2024-01-01' + a % 60 AS dated FROM n WHERE b % 3 = 0
  UNION ALL SELECT host, 'lift', DATE '2024-01-01' + (a % 60 + 20) FROM n WHERE b % 2 = 0
  UNION ALL SELECT host || '/en', 'allow', DATE '2024-01-01' + c % 60 FROM n WHERE d % 4 = 0),
held AS (SELECT key, action, dated AS since, lead(dated) OVER (PARTITION BY key ORDER BY dated) AS until
         FROM (SELECT key, dated, max(action) AS action FROM entries GROUP BY key, dated)),
labels AS (SELECT row_id, host, path, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda s: s <> '') AS p FROM captures WHERE host <> ''),
keys AS (
  SELECT row_id, array_to_string(l[i:], '.') AS key FROM (SELECT row_id, l, unnest(range(1, greatest(len(l), 2))) AS i FROM labels)
  UNION SELECT row_id, host || '/' || array_to_string(p[1:i], '/') FROM (SELECT row_id, host, p, unnest(range(1, len(p) + 1)) AS i FROM labels)),
best AS (
  SELECT k.row_id, max({{'n': length(k.key), 'key': k.key, 'action': h.action, 'since': h.since}}) AS x
  FROM keys k JOIN captures c USING (row_id) JOIN held h ON h.key = k.key AND h.action <> 'lift' AND c.fetched >= h.since AND (h.until IS NULL OR c.fetched < h.until)
  GROUP BY k.row_id)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched_at, b.x.key AS list_key, b.x.action AS list_action,
       strftime(CAST(b.x.since AS DATE), '%Y-%m-%d') AS listed_since, coalesce(b.x.action = 'block', false) AS blocked
FROM captures c LEFT JOIN best b USING (row_id)
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = _table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()
    out = sentencepiece_codec.round_trip(docs, model)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shuffle(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = warc.write(warc.plan(pages))
    back = warc.read(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_ids(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chat.Template()
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema))
    out = chat.format_chats(rows, t)
    turns = F.array_join(F.transform(chat.read_turns(F.col("formatted"), t), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.withColumns({"turns": turns, "loss": chat.loss_text(F.col("segments"), t)})
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    n = F.size(chat.read_turns(F.col("formatted"), t)).cast("long")
    return out.select("conv_id", n.alias("n_turns"), sha("turns").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid_order")


def _sql_escape(c: str) -> str:
    return rf"replace(replace(replace(replace(replace({c}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"


OP8_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         string_agg('<s>[INST] ' || {_sql_escape("role")} || ' [/INST]' || {_sql_escape("text")} || '</s>', '' ORDER BY turn NULLS FIRST, role, text) AS formatted,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(length(formatted) AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid_order
FROM c
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.where(~language_id.held_out())
    rows = language_id.profiles(train)
    out = language_id.predict(docs.select("doc_id", "text"), rows)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    read = media.round_trip(docs)
    tail = F.expr("substring(payload, greatest(length(payload) - 31, 1), 32)")
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", "declared_type", "media_type", F.size("found").cast("long").alias("n_objects"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS head,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                             lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS place FROM x),
r AS (SELECT c.conv_id, 0 AS own, place, role, text FROM c JOIN t ON t.conv_id = c.head AND place <= h
      UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t USING (conv_id) WHERE place > h),
d AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM r),
p AS (SELECT conv_id, depth, length(text) AS chars,
             sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM d
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS last FROM p),
n AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(chars) AS chars,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY node),
u AS (SELECT n.*, q.node AS parent FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
k AS (SELECT parent AS node, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT q.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
      FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN k ON k.node = n.node GROUP BY q.node)
SELECT u.conv_id, u.depth, v.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, u.ends_sha256
FROM u JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n v ON v.node = u.parent
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_links(_table(spark, sf_dir, "embeddings"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS terms FROM documents),
sums AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term, docs),
m AS (SELECT row_id, doc_id, 50 + ((50 * len(terms) * docs) // total) AS m FROM d, sums WHERE len(terms) > 0),
s AS (SELECT item_id, row_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row_id) GROUP BY item_id, row_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_sentencepiece, op3_sharding, op4_warc, op5_mixing, op6_jaccard_join, op7_nearest_neighbours, op8_chat_format, op9_language_id, op10_media, op11_prefix_trie, op12_near_dedup, op13_lexical_search)
}
ORACLES = {"op1_url_filters": OP1_SQL, "op4_warc": OP4_SQL, "op8_chat_format": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_lexical_search": OP13_SQL}
