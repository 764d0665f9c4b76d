"""One query per operator over its whole table, with production parameters, and the SQL that checks those SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.llm import bpe, bradley_terry, brown, chat, decontaminate, hnsw, html_text, linededup, periodic, pii, prefix_trie, sharding, simhash

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(path, split pattern) of a public vocabulary; its folder can be set by TOKENIZERS_DIR."""
    import public_tokenizers

    path = os.path.join(TOKENIZERS, name)
    return (path if os.path.exists(path) else public_tokenizers.path(name)), public_tokenizers.PATTERN


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.expand_prefixes(turns.unionByName(probe)))


CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
ctl AS (SELECT '(<|\\[)(\\\\*)(\\|turn\\||\\|say\\||\\|end\\||\\|im_start\\||\\|im_end\\||\\|endoftext\\||/?s>|<SYS>>|</SYS>>|/?INST\\])' AS p),
e AS (SELECT t.*, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS c,
             length(regexp_replace(x, p, '\\1\\\\\\2\\3', 'g')) + length(regexp_replace(r, p, '\\1\\\\\\2\\3', 'g')) + 23 AS chars
      FROM t, ctl WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x)),
f AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY n) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (r = 'assistant' OR n = c) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (r = 'assistant' OR n = c) AS BIGINT) AS n_examples
FROM f GROUP BY conv_id"""


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), path, pattern)


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "removed_chunks", "removed_lines")


LINES_SQL = """
WITH d AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INTEGER) AS i FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS own FROM d),
b AS (SELECT *, CASE WHEN (coalesce(lag(own) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + own) % 4 = 0 THEN 1 ELSE 0 END AS stop FROM h),
c AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
k AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines, count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) <> '') AS filled FROM c GROUP BY ALL),
g AS (SELECT *, filled >= 2 AND row_number() OVER (PARTITION BY body, filled >= 2 ORDER BY doc_id, chunk) > 1 AS gone FROM k)
SELECT documents.doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') END AS text,
       CAST(count(*) FILTER (gone) AS BIGINT) AS removed_chunks, CAST(coalesce(sum(lines) FILTER (gone), 0) AS BIGINT) AS removed_lines
FROM documents LEFT JOIN g USING (doc_id) GROUP BY documents.doc_id, documents.text"""


def balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = brown.train(docs.where(id_bucket() != 1))
    got = brown.score(docs, model)
    return got.select("doc_id", (id_bucket() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = bradley_terry.train(docs, labels.where(id_bucket() != 0))
    scored = bradley_terry.with_scores(docs.select("doc_id", "text"), ranker)
    return scored.select("doc_id", (id_bucket() == 0).alias("held_out"), "score", (F.col("score") >= bradley_terry.CUT).cast("int").alias("predicted"))


# crc32 of a decimal number in SQL, from its table of 256 entries
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS T FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) r(i)))"""


def crc_sql(number: str) -> str:
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT), "
            "lambda c, b: xor(c >> 8, T[(xor(c, b) & 255) + 1])), 4294967295)")


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt on the first h turns of the conversation of their hundred, as a trie of prefixes."""
    turns = durable(prefix_trie.digest_turns(table(spark, sf_dir, "conversations")))
    convs = turns.select("conv").distinct()
    plan = convs.select("conv", (F.col("conv") - F.col("conv") % 100).alias("donor"), (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h"))
    heads = turns.where("conv % 100 = 0 AND pos <= 5").withColumnRenamed("conv", "donor")
    taken = plan.join(heads, "donor").where("pos <= h").select("conv", "pos", "said", "chars")
    ready = plan.join(taken.groupBy("conv").agg(F.count("*").alias("k")), "conv", "left").select("conv", "h", F.coalesce("k", F.lit(0)).alias("k"))
    own = turns.join(ready, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "said", "chars")
    return prefix_trie.trie_nodes(durable(taken.unionByName(own)), convs)


TRIE_SQL = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id AS c, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS chars, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(said)) AS pos FROM t),
v AS (SELECT c, c - c % 100 AS d, {crc_sql("c")} % 6 AS h FROM (SELECT DISTINCT c FROM t), crc),
taken AS (SELECT v.c, o.pos, o.said, o.chars FROM v JOIN o ON o.c = v.d AND o.pos <= v.h),
k AS (SELECT v.c, h, coalesce(n, 0) AS k FROM v LEFT JOIN (SELECT c, count(*) AS n FROM taken GROUP BY c) USING (c)),
s AS (SELECT * FROM taken UNION ALL SELECT o.c, o.pos - h + k, o.said, o.chars FROM o JOIN k USING (c) WHERE o.pos > h),
p AS (SELECT c, pos AS depth, string_agg(md5(said), '') OVER (PARTITION BY c ORDER BY pos) AS key, chars, count(*) OVER (PARTITION BY c) AS n FROM s
      UNION ALL SELECT v.c, 0, '', 0, coalesce(n, 0) FROM v LEFT JOIN (SELECT c, count(*) AS n FROM s GROUP BY c) USING (c)),
u AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = n), '')) AS ends_sha256 FROM p GROUP BY depth, key),
ch AS (SELECT left(key, 32 * (depth - 1)) AS key, depth - 1 AS depth, count(*) AS n FROM u WHERE depth > 0 GROUP BY ALL),
w AS (SELECT u.*, coalesce(ch.n, 0) AS n_children FROM u LEFT JOIN ch ON ch.key = u.key AND ch.depth = u.depth),
a AS (SELECT left(key, 32 * i) AS key, i AS depth, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves
      FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM w) GROUP BY ALL)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN a ON a.key = w.key AND a.depth = w.depth LEFT JOIN w AS up ON up.depth = w.depth - 1 AND up.key = left(w.key, 32 * (w.depth - 1))"""


def periodic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's periodic runs; a tenth of the texts is made periodic first, as the contract says."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    planted = F.expr("concat(slice(ws, 1, cast(a AS int)), transform(sequence(a, n - 1), i -> ws[cast(a + (i - a) % p AS int)]))")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("h"), F.when(crc % 10 == 0, words).alias("ws"))
    docs = docs.withColumn("n", F.size("ws").cast("long")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    made = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic.periodic_runs(made)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.withColumn("b", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.period").alias("period"),
                       F.expr("(-1000 * b.l) div b.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


PERIODIC_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {crc_sql("doc_id")} AS h FROM documents, crc)),
e AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
w AS (SELECT doc_id, n, i, ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
k AS (SELECT doc_id, n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.five = y.five AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
s AS (SELECT doc_id, q, min(i) - q AS start, q + count(*) + 4 AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM m) GROUP BY doc_id, q, isle),
l AS (SELECT * FROM s WHERE length >= greatest(6, 4 * q)),
r AS (SELECT * FROM l WHERE NOT EXISTS (FROM l AS b WHERE b.doc_id = l.doc_id AND b.q < l.q AND b.start <= l.start AND b.start + b.length >= l.start + l.length)),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed,
             arg_min({{'s': start, 'l': length, 'q': q}}, {{'l': -length, 's': start, 'q': q}}) AS best FROM r GROUP BY doc_id),
c AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) FILTER (NOT EXISTS (FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + q AND w.i < r.start + length)) AS kept FROM w GROUP BY w.doc_id)
SELECT documents.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every text; the counts and base_sha256 are those of the base rules, `spans` has all."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(names[s["ord"]], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = F.transform(base, lambda s: s["ord"])
    counts = [F.size(F.filter(of, lambda o: o == F.lit(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_simhash": simhash_components, "op2_hnsw": hnsw_neighbours, "op3_decontaminate": benchmark_hits, "op4_chat_prefixes": chat_examples, "op5_byte_bpe": bpe_round_trip,
    "op6_line_chunks": line_chunks, "op7_lpt_shards": balanced_shards, "op8_brown": brown_scores, "op9_html_text": page_texts, "op10_bradley_terry": quality_scores,
    "op11_prefix_trie": conversation_trie, "op12_periodic_runs": periodic_texts, "op13_personal_data": personal_data,
}
ORACLES = {"op4_chat_prefixes": CHAT_SQL, "op6_line_chunks": LINES_SQL, "op11_prefix_trie": TRIE_SQL, "op12_periodic_runs": PERIODIC_SQL}
