"""The registered queries of this subpackage, with DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, exact_dedup, language_id, line_dedup, media, mixing, packing, sharding, simhash, trie, url_filter
from .runtime import WORD, cut, table

#: The rule list of the URL filter (action, host, path).
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A host is blocked if 95 % of its posterior lies above this share of bad pages.
BAD_LIMIT = 0.08


#: Labelled documents on which the two classes of text are fitted, at most.
LABELLED = 50_000

#: The tokenizer files; parameters of the operators, not part of the repository.
TOKENIZER, BYTE_TOKENIZER, PIECE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Tokens of a packed sequence.
SEQUENCE_TOKENS = 2048


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have fingerprint zero and are linked like any others; an empty table gives no row."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3).select("doc_id", "fingerprint", "component_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty: 64 bytes of padding; equal texts have equal values; an empty table gives no row."""
    pages, stored = media.publish_texts(table(spark, sf_dir, "documents"))
    store = media.load_media(stored).select(
        "digest",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.unhex(F.sha2("payload", 256)).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.unhex(F.sha2("media", 256)).alias("media_sha256"),
        "feature",
    )
    sequences = media.interleave(cut(media.parse_documents(pages, "doc_id")), media.one_a_digest(store), "doc_id")
    segment = F.explode(F.filter("segments", lambda s: s["kind"] == "media")).alias("s")
    out = sequences.select("doc_id", segment).select("doc_id", "s.position", "s.caption", "s.media.*")
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})


#: Bytes of text that a shard may hold.
SHARD_BYTES = 256 << 10


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has 0 bytes; rows of one id lie together or in overflow shards; an empty table gives no row."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is one empty line, which is never dropped; repeated rows count each; an empty table gives no row."""
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _texts_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, which have a source, and all pages, which have an address and declare a language in their markup."""
    documents, html = table(spark, sf_dir, "documents"), F.col("html")
    tag = F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    pages = table(spark, sf_dir, "pages").select(F.lit(None).cast("long").alias("doc_id"), "page_id", url_filter.visible_text(html).alias("text"), tag.alias("declared"), url_filter.host_of(F.col("url")).alias("host"))
    return documents.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.lit("").alias("declared"), F.col("source").alias("host")).unionByName(pages)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text without letters is of no known language and not kept; null hosts count as one; empty tables give no row."""
    model = language_id.fit(table(spark, sf_dir, "documents").select("text", "lang"))
    found = language_id.judge(_texts_with_evidence(spark, sf_dir), model, ["doc_id", "page_id", "declared", "host"], declared=F.col("declared"), host=F.col("host"))
    return found.select("doc_id", "page_id", "declared", "host", "language", F.round("posterior", 4).alias("posterior"), F.col("accepted").alias("kept"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has size 0, a null source is the last one; repeated rows count each; an empty table gives no row."""
    shared = mixing.with_shares(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(5, 2, 1), share=1.5, most=2.0, seed=17, keep_text=False)
    return shared.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), mixing.taken_words().alias("taken"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no ids and decodes to an empty text; an empty table gives no row."""
    import public_tokenizers

    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no labels, so documents labelled by quality give the two classes of text that label pages. A null url is judged as the host "", a page
    without words has no label; an empty table gives no row."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = url_filter.outcome_model(documents, labels.select("doc_id", (1 - F.col("quality")).alias("bad")), LABELLED)
    pages = url_filter.with_outcome(table(spark, sf_dir, "pages"), url_filter.visible_text(F.col("html")), model, "bad")
    return url_filter.filter_urls(pages, F.col("bad"), URL_RULES, BAD_LIMIT).select("page_id", "host", "path", "rule", "verdict", "rate", "lower")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text equals an empty one; of a group the largest id stays, null ids only among themselves; an empty table gives no row."""
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null roles and texts are empty, turns without a number come first; an empty table leaves the one conversation that is added."""
    log = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("message"), "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("message"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    events = log.unionByName(own).withColumns({"seq": F.col("message"), "kind": F.lit("message")})
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return chat.read_back(chat.format_conversations(events)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is the closing token alone; an empty table gives no row."""
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_TOKENIZER), SEQUENCE_TOKENS)
    packed = packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), SEQUENCE_TOKENS)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null roles and texts are empty, rows without conv_id are left out; an empty table gives no row."""
    turns, convs = trie.with_borrowed_heads(cut(trie.numbered_turns(table(spark, sf_dir, "conversations"))))
    return trie.prefix_trie(turns, convs)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has zeros and an empty ``groups_sha256``; an empty table gives no row."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_and_count(documents, public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_media_columns, op3_sharding, op4_line_dedup, op5_language_id, op6_mixing, op7_bpe, op8_url_filter, op9_exact_dedup, op10_chat_format, op11_best_fit_packing, op12_prefix_trie, op13_alignment)
    return {f.__name__: f for f in own}


_RULE_SQL = "CASE {cases} END".format(
    cases=" ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{act}}}{h}{p}'"
        for act, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    )
)

_LEVEL_SQL = """SELECT {up} n, bad, greatest((known + {c}::DOUBLE) / (known * least(greatest(coalesce(var / nullif(mean * (1 - mean), 0), 0.0), 0.0), 1.0) + {c}::DOUBLE / ({p}::DOUBLE + 1)) - 1, 1.0) AS m
FROM (SELECT *, CASE WHEN mean * (1 - mean) > 0 AND var IS NOT NULL THEN greatest(coalesce(informed, 0.0) - 1, 0.0) ELSE 0.0 END AS known
  FROM (SELECT *, (q - n * mean * mean - (k - 1) * mean * (1 - mean)) / nullif(n - nn / nullif(n, 0), 0) AS var
    FROM (SELECT {up} sum(n) AS n, sum(bad) AS bad, count(*) FILTER (n > 0) AS k, coalesce(sum(bad * bad / n) FILTER (n > 0), 0.0) AS q, sum(1 - 1 / n) FILTER (n > 0) AS informed,
        coalesce(sum(bad) / nullif(sum(n), 0), 0.0) AS mean, sum(n * n) AS nn FROM {below} {group})))"""


def _level_sql(up: str, below: str, group: str) -> str:
    return _LEVEL_SQL.format(up=up, below=below, group=group, c=url_filter.WEAK_CHILDREN, p=url_filter.WEAK_PAGES)


_LIST_SQL = ", ".join(f"'{x}'" for x in url_filter.SUFFIXES)
_SHARE_SQL = "CASE WHEN len(ws) > 0 THEN (length(t) - length(regexp_replace(t, '{}', '', 'g'))) / length(t)::DOUBLE END AS f{}"
_FEATURES_SQL = ", ".join(_SHARE_SQL.format(p, i) for i, p in enumerate((r"\pL+", r"[^\pL\pN\x20\x09-\x0D]+", r"\p{Lu}+", r"\pN+"))) + r""",
  CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws)::DOUBLE END AS f4, CASE WHEN len(ws) > 0 THEN least(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) / (10 * len(ws))::DOUBLE, 1.0) END AS f5"""
_WORDS_SQL = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws"


def _class_sql(k: int) -> str:
    return f"ln(n{k} / (n0 + n1)) + " + " + ".join(f"(-0.5::DOUBLE * ln(v{k}{i}) - (f{i} - m{k}{i}) * (f{i} - m{k}{i}) / (2 * v{k}{i}))" for i in range(6))


_MODEL_SQL = ", ".join(f"count(*) FILTER (bad = {k})::DOUBLE AS n{k}, " + ", ".join(f"avg(f{i}) FILTER (bad = {k}) AS m{k}{i}, var_pop(f{i}) FILTER (bad = {k}) + {url_filter.VARIANCE_FLOOR}::DOUBLE AS v{k}{i}" for i in range(6)) for k in (0, 1))
_SHRUNK_SQL = "({x}.bad + {u}.m * {u}.rate) / ({x}.n + {u}.m) AS rate, {x}.n + {u}.m AS total, pow({u}.m / ({x}.n + {u}.m), 2) * {u}.var AS above"

#: Normal deviations of the 5 % quantile.
Z = 1.645
_SKEW = (Z * Z - 3) / 6

OP8_SQL = f"""
WITH lf AS (SELECT 1 - quality AS bad, {_FEATURES_SQL} FROM (SELECT quality, text AS t, {_WORDS_SQL.replace("(t,", "(text,")} FROM documents JOIN (SELECT * FROM labels ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {LABELLED}) USING (doc_id))),
model AS (SELECT {_MODEL_SQL} FROM lf WHERE bad IN (0, 1) AND f0 IS NOT NULL),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
q AS (SELECT page_id, host, path, CASE WHEN f0 IS NOT NULL AND n0 > 0 AND n1 > 0 THEN ({_class_sql(1)} > {_class_sql(0)})::INT END AS bad
  FROM (SELECT page_id, host, path, {_FEATURES_SQL} FROM (SELECT *, {_WORDS_SQL} FROM p)), model),
hosts AS (SELECT host, CASE WHEN two IN ({_LIST_SQL}) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain,
  n, bad FROM (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM q GROUP BY host)),
d AS ({_level_sql(up="domain,", below="hosts", group="GROUP BY domain")}),
d2 AS (SELECT *, CASE WHEN two IN ({_LIST_SQL}) THEN two ELSE string_split(domain, '.')[-1] END AS suffix FROM (SELECT *, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') AS two FROM d)),
s AS ({_level_sql(up="suffix,", below="d2", group="GROUP BY suffix")}),
r AS ({_level_sql(up="", below="s", group="")}),
top AS (SELECT m, rate, rate * (1 - rate) / (n + 1) AS var FROM (SELECT *, CASE WHEN n > 0 THEN bad / n ELSE 0.0 END AS rate FROM r)),
sr AS (SELECT *, rate * (1 - rate) / (total + 1) + above AS var FROM (SELECT suffix, s.m, {_SHRUNK_SQL.format(x="s", u="top")} FROM s, top)),
dr AS (SELECT *, rate * (1 - rate) / (total + 1) + above AS var FROM (SELECT domain, d2.m, {_SHRUNK_SQL.format(x="d2", u="sr")} FROM d2 JOIN sr USING (suffix))),
jv AS (SELECT host, rate, rate * (1 - rate) / (total + 1) + above AS var FROM (SELECT host, {_SHRUNK_SQL.format(x="hosts", u="dr")} FROM hosts JOIN dr USING (domain))),
jb AS (SELECT *, rate * (rate * (1 - rate) / nullif(var, 0) - 1) AS a, (1 - rate) * (rate * (1 - rate) / nullif(var, 0) - 1) AS b, {_SKEW}::DOUBLE AS skew FROM jv),
jh AS (SELECT *, 1 / nullif(2 * a - 1, 0) AS p, 1 / nullif(2 * b - 1, 0) AS q FROM jb),
jw AS (SELECT *, 2 / nullif(p + q, 0) AS h FROM jh),
j AS (SELECT host, rate, CASE WHEN a IS NULL THEN rate WHEN a < 1 THEN 0.0 WHEN b < 1 THEN rate - {Z}::DOUBLE * sqrt(var) ELSE a / (a + b * exp(2 * ({Z}::DOUBLE * sqrt(h + skew) / h - (q - p) * (skew + 5 / 6.0::DOUBLE - 2 / (3 * h))))) END AS lower FROM jw),
v AS (SELECT page_id, q.host, path, {_RULE_SQL} AS found, rate, lower FROM q JOIN j USING (host))
SELECT page_id, host, path, regexp_replace(found, '^\\{{[a-z]+\\}}', '') AS rule,
  coalesce(regexp_extract(found, '^\\{{([a-z]+)\\}}', 1), CASE WHEN lower > {BAD_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS rate, round(lower, 6) AS lower FROM v
"""

OP9_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, row, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
    FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common USING (key) GROUP BY row, doc_id
"""


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
b AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM d, (SELECT unnest(range(0, 61))::INT AS depth) GROUP BY ALL),
leaf AS (SELECT b.* FROM b LEFT JOIN b AS up ON up.depth = b.depth - 1 AND up.prefix = b.prefix >> 1
  WHERE (b.shard_bytes <= {SHARD_BYTES} OR b.depth = 60) AND (b.depth = 0 OR up.shard_bytes > {SHARD_BYTES}))
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard, depth, shard_bytes, shard_docs
FROM d JOIN leaf ON leaf.prefix = d.h >> (60 - leaf.depth)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || md5(concat_ws(':', '17', doc_id::VARCHAR, text))[1:13])::BIGINT::DOUBLE + 1) / 4503599627370496.0)
      / greatest(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\pL]+', '', 'g')) / length(text) ELSE 0.0 END, 0.05) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS most,
    sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0.0) AS left_over,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0) AS open
  FROM w WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, max(left_over / open) OVER () * weight) AS target FROM r),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
k AS (SELECT d.*, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM k
"""


def _escaped_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP10_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(chat.OPEN + chat.CLOSE + chat.END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


#: CRC-32 of a decimal number: every byte is an exclusive or and eight shifts.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}::VARCHAR, ''), lambda b: [256 + ascii(b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
  lambda a, s: CASE WHEN s >= 256 THEN xor(a, s - 256) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT)"""

OP12_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) AS pos, dig, words FROM (
    SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS dig, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words
    FROM (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
c AS (SELECT conv_id, own, conv_id - conv_id % 20 AS base, {_CRC_SQL.format(x="conv_id")} % 4 AS h FROM (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id)),
n AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
r AS (SELECT n.conv_id, pos - h + taken AS pos, dig, words FROM n JOIN t ON t.conv_id = n.conv_id AND pos > h
  UNION ALL SELECT n.conv_id, pos, dig, words FROM n JOIN t ON t.conv_id = base AND pos <= h),
p AS (SELECT conv_id, pos AS depth, words, string_agg(dig, '/') OVER (PARTITION BY conv_id ORDER BY pos) AS node FROM r),
ends AS (SELECT n.conv_id, coalesce(node, '') AS node FROM n LEFT JOIN (SELECT conv_id, max(node) AS node FROM p GROUP BY conv_id) AS l ON l.conv_id = n.conv_id),
d AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(words) AS words, CASE WHEN min(depth) > 1 THEN left(node, length(node) - 33) ELSE '' END AS parent FROM p GROUP BY node
  UNION ALL SELECT '', min(conv_id), 0, count(*), 0, NULL FROM n HAVING count(*) > 0),
k AS (SELECT d.*, coalesce(kids, 0) AS n_children FROM d LEFT JOIN (SELECT parent AS node, count(*) AS kids FROM d WHERE parent IS NOT NULL GROUP BY parent) AS x ON x.node = d.node),
above AS (SELECT p.node, n_children = 0 AS leaf, (n_convs - 1) * k.words AS saved FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth
  UNION ALL SELECT '', n_children = 0, (n_convs - 1) * words FROM k),
s AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY node),
e AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY node)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM k JOIN s ON s.node = k.node LEFT JOIN e ON e.node = k.node LEFT JOIN d AS u ON u.node = k.parent
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": OP3_SQL, "op4_line_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op8_url_filter": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op10_chat_format": OP10_SQL, "op12_prefix_trie": OP12_SQL}
