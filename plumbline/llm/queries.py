"""The numbered queries: each applies one operator to its whole table and derives the columns to compare."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe,
    chat,
    decontaminate,
    html_text,
    language,
    licenses,
    prefix_trie,
    quality,
    ranked_search,
    secrets,
    simhash,
    suffix_dedup,
    token_counts,
)
from plumbline.session import cut_lineage, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op10_decontaminate",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
lengths AS (SELECT DISTINCT least(10, len(w)) k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, lengths WHERE len(w) >= k)),
found AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
hits AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit,
       coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, n_hit IS NOT NULL contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contamination(documents, table(spark, folder, "benchmark"), out="c")
    n_hit = decontaminate.hit_words(F.col("c.spans"))
    return found.select(
        "doc_id",
        F.col("c.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("c.items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_bpe_digests")
def op5_bpe_digests(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    learnt = language.learn(language.training_part(documents))
    return language.identify(documents.select("doc_id", "text"), learnt).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "margin"
    )


@query(
    "op6_quality_rules",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w FROM d),
m AS (SELECT doc_id, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
             len(list_distinct(w))::BIGINT n_distinct,
             length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT n_capitals,
             length(regexp_replace(t, '[^a-z\x{80}-\x{10FFFF}]', '', 'g'))::BIGINT n_small FROM w),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM d),
l AS (SELECT doc_id, count(*) n_lines, count(*) - count(DISTINCT line) n_dup_lines FROM lines
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) n FROM win) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) p FROM rep) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(n_lines, 0)::BIGINT n_lines, coalesce(n_dup_lines, 0)::BIGINT n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT n_repeat_words
      FROM m LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
        + CASE WHEN n_capitals > n_small AND n_words >= 20 THEN 32 ELSE 0 END
        + CASE WHEN 2 * (n_capitals + n_small) < word_chars THEN 64 ELSE 0 END
        + CASE WHEN 7 * n_distinct < n_words AND n_words < 200 THEN 128 ELSE 0 END)::BIGINT failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 base_failed,
       failed = 0 kept, failed FROM b
""",
)
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.BASE | quality.POLICIES[quality.CURRENT]).alias("kept"),
        "failed",
    )


@query(
    "op1_secret_scan",
    r"""
WITH k AS (SELECT * FROM (VALUES
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18),
  ('hex', 2, '[0-9a-f]{16,}', 0, 16),
  ('prefixed', 3, '\b(?:gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})', 0, 15),
  ('signed', 4, '\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 0, 32)) k(kind, o, p, g, least)),
m AS (SELECT doc_id, source AS owner, source || '/' || lang AS repository, kind, o, least,
        regexp_extract_all(text, p, 0) w, CASE g WHEN 2 THEN regexp_extract_all(text, p, 2) ELSE regexp_extract_all(text, p, 0) END v,
        string_split_regex(text, p) b FROM documents, k WHERE regexp_matches(text, p)),
e AS (SELECT doc_id, owner, repository, kind, o, least, v[i] AS val, length(w[i]) AS size,
        list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT
        + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(w) + 1)) i FROM m)),
c AS (SELECT * FROM e WHERE length(val) >= least),
f AS (SELECT val, count(DISTINCT repository) n_repositories, count(DISTINCT owner) n_owners FROM c GROUP BY val),
j AS (SELECT c.*, n_repositories, n_owners, n_owners < 3 AND regexp_matches(val, '[A-Za-z]') AND regexp_matches(val, '[0-9]')
        AND len(list_distinct(string_split(val, ''))) >= 8
        AND NOT regexp_matches(val, '(?i)example|sample|changeme|placeholder|your|dummy|test|xxxx|0123456|1234567|abcdef') AS live
      FROM c JOIN f USING (val)),
a AS (SELECT doc_id, count(*) FILTER (o = 0) n_assign, count(*) FILTER (o = 1) n_access, count(*) FILTER (o = 2) n_hex,
        string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, o) FILTER (o < 3) base,
        string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, o) FILTER (o < 3 OR live) spans,
        count(*) FILTER (live) n_live, count(*) FILTER (o < 3 AND n_owners >= 3) n_copied FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT n_assign, coalesce(n_access, 0)::BIGINT n_access, coalesce(n_hex, 0)::BIGINT n_hex,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0)::BIGINT n_live,
       coalesce(n_copied, 0)::BIGINT n_copied
FROM documents LEFT JOIN a USING (doc_id)
""",
)
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The owner of a document is its source; a source keeps a repository for each language."""
    found = secrets.scan(
        table(spark, folder, "documents"),
        repository=F.concat_ws("/", "source", "lang"),
        owner=F.col("source"),
        keep=["doc_id"],
    )
    base = F.filter("secrets", lambda s: s["base"])

    def count(holds) -> Column:
        return F.size(F.filter("secrets", holds)).cast("long")

    def of_kind(kind: str) -> Column:
        return count(lambda s: s["kind"] == kind)

    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.filter("secrets", lambda s: s["base"] | s["live"])).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["base"] & (s["n_owners"] >= secrets.MANY_OWNERS)).alias("n_copied"),
    )


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.find_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256"
    )


@query("op7_html_text")
def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.train(spark))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches over all documents, the first and last sent twice: both tokenizers' counts come in, copies of a
    text with a smaller id go, and the first tokenizer is recounted with an end token for each document."""
    files = {n: public_tokenizers.path(f"{n}.tiktoken") for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    keyed = documents.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    counted = cut_lineage(token_counts.count_tokens(keyed, files, public_tokenizers.PATTERN).drop("text"))
    first = cut_lineage(counted.groupBy("text_key").agg(F.min("doc_id").alias("first")))
    marked = cut_lineage(counted.join(first, "text_key").drop("text_key"))
    copies = marked.where("doc_id > first")

    def changes(rows: DataFrame, kind: str, names: list[str], tokens, old=None) -> DataFrame:
        each = [
            rows.select(
                F.lit(kind).alias("kind"),
                "source",
                "lang",
                F.lit(n).alias("tokenizer"),
                tokens(n).alias("tokens"),
                (F.lit(None).cast("long") if old is None else old(n)).alias("old_tokens"),
            )
            for n in names
        ]
        return reduce(DataFrame.unionByName, each)

    ledger = token_counts.Ledger(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    names = list(files)
    batches = [
        ("load", changes(marked, token_counts.INSERT, names, F.col)),
        ("copies", changes(copies, token_counts.DELETE, names, F.col)),
        ("recount", changes(marked.where("doc_id <= first"), token_counts.REVISE, names[:1], lambda n: F.col(n) + 1, F.col)),
    ]
    for name, rows in [*batches, batches[0], batches[2]]:
        ledger.commit(name, rows)
    return ledger.totals()


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents lie as source/lang/hundreds/id.txt; those whose id ends in 00 or 50 are their folder's LICENSE."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    name = F.when(F.col("doc_id") % 50 == 0, F.concat_ws("-", F.lit("LICENSE"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    folders = F.when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", "lang")).otherwise(
        F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100))
    )
    scanned = licenses.scan(documents).drop("text").withColumn("path", F.concat_ws("/", folders, name))
    return licenses.inherit(scanned).select("doc_id", "path", "license", "cosine", "line", "effective", "origin")


@query(
    "op11_chat_format",
    r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') "role", coalesce(text, '') t FROM conversations
           UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, "role", t) i FROM r),
s AS (SELECT *, lag("role") OVER (PARTITION BY conv_id ORDER BY i) b, lead(i) OVER (PARTITION BY conv_id ORDER BY i) nx,
        length(t) + 2 * len(regexp_extract_all(t, '<s>|</s>|\[/?INST\]|\[/?SYS\]|\[OUT\]|\[/?ROLE\]|\[SAYS\]'))
        + length(regexp_replace(t, '[^\\]', '', 'g'))
        + CASE "role" WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length("role") END c,
        CASE "role" WHEN 'system' THEN b IS NULL WHEN 'user' THEN b IS NULL OR b IN ('system', 'assistant')
          WHEN 'assistant' THEN coalesce(b, '') = 'user' ELSE false END fine FROM o)
SELECT conv_id, count(*)::BIGINT n_turns,
       sha256(string_agg("role" || chr(10) || t || chr(10), '' ORDER BY i)) turns_sha256,
       coalesce(sum(length(t)) FILTER ("role" = 'assistant'), 0)::BIGINT loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER ("role" = 'assistant'), '')) loss_sha256,
       (3 + sum(c))::BIGINT formatted_chars, count(*) FILTER (NOT fine)::BIGINT n_refused,
       max("role") FILTER (nx IS NULL) = 'assistant' complete
FROM s GROUP BY conv_id
""",
)
def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts are made of control strings, read back from what was formatted."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(given.unionByName(extra)), shuffle=False)


@query(
    "op12_prefix_trie",
    r"""
WITH t AS (SELECT conv_id, coalesce("role", '') r, coalesce(text, '') t, row_number() OVER
             (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce("role", ''), coalesce(text, '')) i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
             lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
             lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
             4294967295::BIGINT) % 4 h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 part, i, r, t FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
      UNION ALL SELECT conv_id, 1, i, r, t FROM c JOIN t USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, row_number() OVER w d, string_agg(md5(r || chr(10) || t), '') OVER w k,
             len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) words FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT k, d, min(conv_id) conv_id, count(*) n_convs, any_value(words) words FROM p GROUP BY k, d),
ch AS (SELECT left(k, 32 * (d - 1)) k, count(*) n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) n_children FROM n LEFT JOIN ch USING (k)),
s AS (SELECT p.k, sum((n_convs - 1) * m.words) saved, count(*) FILTER (n_children = 0) leaves
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.k),
e AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) ids
      FROM (SELECT conv_id, arg_max(k, d) k FROM p GROUP BY conv_id) GROUP BY k)
SELECT m.conv_id::BIGINT conv_id, m.d::BIGINT "depth", q.conv_id::BIGINT parent_conv_id, m.n_convs::BIGINT n_convs,
       m.n_children::BIGINT n_children, leaves::BIGINT n_leaves, saved::BIGINT saved_tokens, sha256(coalesce(ids, '')) ends_sha256
FROM m JOIN s USING (k) LEFT JOIN e USING (k) LEFT JOIN m q ON m.d > 0 AND q.k = left(m.k, 32 * (m.d - 1))
""",
)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"), prefix_trie.Graft(span=20, heads=4))


@query(
    "op13_ranked_search",
    r"""
WITH d AS (SELECT row_number() OVER () i, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
n AS (SELECT i, doc_id, len(w) n, w FROM d WHERE len(w) > 0),
c AS (SELECT count(*) docs, sum(n)::BIGINT l FROM n),
q AS (SELECT item, item_id, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
      FROM (SELECT row_number() OVER () item, item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM benchmark)),
qt AS (SELECT item, item_id, t, count(*) times FROM q GROUP BY ALL),
tf AS (SELECT i, doc_id, n, t, count(*) tf FROM (SELECT i, doc_id, n, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT w FROM (SELECT t, count(*) df FROM tf GROUP BY t), c),
x AS (SELECT i, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))) v FROM tf JOIN w USING (t), c),
s AS (SELECT item, item_id, i, doc_id, sum(times * v)::BIGINT score FROM qt JOIN x USING (t) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, i)::INTEGER "rank", doc_id, score
FROM s QUALIFY "rank" <= 20
""",
)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.top_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
