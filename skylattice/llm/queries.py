"""The registered queries of the training-data operators, and the SQL some of them are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import bpe, chat, collocations, linededup, mixing, neardup, phrases, prefixtrie, quality, sitetree, tokenfile, toxicity, urlfilter

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded back, as digests."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(documents, public_tokenizers.path(VOCABULARY), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near copies."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


# Shingle sets, all pairs that share a shingle, links, and the smallest reachable id.
_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
texts AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
flat AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM texts),
links AS (
  SELECT x.rep AS a, y.rep AS b FROM flat x JOIN flat y ON x.g = y.g AND x.rep < y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT rep, rep FROM texts UNION SELECT r.node, e.b FROM reach r JOIN arcs e ON r.seen = e.a),
labels AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(l.label, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.label, d.doc_id) AS kept, coalesce(t.rep, d.doc_id) AS class_id
FROM sets d LEFT JOIN texts t ON list_sort(d.s) = t.s AND len(d.s) > 0 LEFT JOIN labels l ON t.rep = l.node
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all windows of the benchmark."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return phrases.contamination(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, i AS pos, w[i] AS word
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
       LATERAL unnest(generate_series(1, len(w))) AS u(i)),
grams AS (SELECT doc_id, pos, len(g) AS n, array_to_string(g, ' ') AS gram
  FROM (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM words)),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+least(len(w), 13)-1], ' ') AS gram
  FROM items, LATERAL unnest(generate_series(1, greatest(len(w)-12, least(len(w), 1)))) AS u(i)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT g.doc_id, g.pos, x.item_id, x.n FROM grams g JOIN windows x ON x.n = 13 AND g.n = 13 AND g.gram = x.gram
  UNION ALL
  SELECT g.doc_id, g.pos, x.item_id, x.n FROM grams g JOIN sizes s ON s.n < 13 AND g.n >= s.n
    JOIN windows x ON x.n = s.n AND array_to_string(string_split(g.gram, ' ')[1:s.n], ' ') = x.gram),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_words, 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= coalesce(c.n_words, 0) AS contaminated
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN hits h USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one of nothing but control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    return chat.digests(turns.unionByName(spark.createDataFrame(extra, turns.schema)))


_OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(2 * length(text) - length(translate(text, '<>[\', ''))
           + CASE role WHEN 'assistant' THEN 12 ELSE 15 END)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(role, ',' ORDER BY turn), '(system,)?user(,assistant,user)*(,assistant)?') AS valid
FROM turns GROUP BY conv_id
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from labels outside the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.train(documents, table(spark, sf_dir, "labels").filter(~fold))
    return toxicity.scored(documents, model).select(
        "doc_id", fold.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to token files and read back from them."""
    folder = tokenfile.default_folder(spark)
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), folder)
    return tokenfile.read_documents(spark.read.parquet(folder))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return sitetree.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # The text is not needed once it is measured.
    return quality.judged(documents, only=("doc_id", "lang")).select(
        "doc_id",
        *(F.col(f"counts.{c}") for c in quality.COUNTS),
        "base_failed",
        "kept",
        F.round("character_distance", 6).alias("character_distance"),
        F.round("common_word_distance", 6).alias("common_word_distance"),
    )


def _op8_sql() -> str:
    """The same counts, histograms, means and distances."""
    words = quality.common_words(quality.COMMON_WORDS)
    listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    languages = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    classes = ["[a-z]", "[A-Z]", "[0-9]", "[\\x20\\x09-\\x0D]", "[.,;:!?''\"()\\-]", None, "[\\x00-\\x08\\x0E-\\x1F\\x7F]", "[\\x{80}-\\x{10FFFF}]"]
    count = lambda c: f"len(regexp_extract_all(t, '{c}'))"
    rest = "length(t) - " + " - ".join(count(c) for c in classes if c)
    characters = "[" + ", ".join(count(c) if c else rest for c in classes) + "]"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({languages}) THEN lang ELSE '{quality.OTHER}' END AS language FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, regexp_extract_all(translate(t, '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS low,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i+1], words[i+2]) AS n
  FROM w, LATERAL unnest(generate_series(1, len(words) - 2)) AS u(i)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, language, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, {characters} AS ch,
         list_transform({listed}, lambda c: len(list_filter(low, lambda x: x = c))) AS cw
  FROM w LEFT JOIN repeated r USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
flat AS (
  SELECT doc_id, language, base_failed, 'c' AS kind, unnest(generate_series(1, len(ch))) AS k, unnest(ch) AS n, list_sum(ch) AS total FROM judged
  UNION ALL
  SELECT doc_id, language, base_failed, 'w', unnest(generate_series(1, len(cw) + 1)), unnest(list_append(cw, n_words - list_sum(cw))), n_words FROM judged),
shares AS (SELECT *, CASE WHEN total > 0 THEN n / CAST(total AS DOUBLE) ELSE 0e0 END AS p FROM flat),
means AS (SELECT language, kind, k, avg(p) AS q FROM shares WHERE NOT base_failed GROUP BY language, kind, k),
terms AS (SELECT doc_id, s.kind, (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0e0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0e0 END) / 2 AS v
  FROM shares s JOIN means m USING (language, kind, k)),
apart AS (SELECT doc_id, sqrt(greatest(0e0, sum(v) FILTER (kind = 'c'))) AS dc, sqrt(greatest(0e0, sum(v) FILTER (kind = 'w'))) AS dw FROM terms GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ((n_words >= {quality.CHARACTER_WORDS} AND coalesce(dc, 0e0) > {quality.CHARACTER_DISTANCE}e0)
         OR (n_words >= {quality.COMMON_WORD_WORDS} AND coalesce(dw, 0e0) > {quality.COMMON_WORD_DISTANCE}e0)) AS kept,
       round(coalesce(dc, 0e0), 6) AS character_distance, round(coalesce(dw, 0e0), 6) AS common_word_distance
FROM judged LEFT JOIN apart USING (doc_id)
"""


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; a url that no rule fits is allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_OP9_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, h || p AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS rn
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE rn = 1) USING (page_id)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the chunks that an earlier document has."""
    return linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the passages of more than 50 words that an earlier document has."""
    return linededup.without_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


_OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    LATERAL unnest(generate_series(1, len(l))) AS u(i)),
marks AS (SELECT *, CAST(CAST('0x' || substr(md5(line), 1, 8) AS UBIGINT) AS BIGINT) AS h,
                 len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50 AS long FROM lines),
ends AS (SELECT *, coalesce(lead(long) OVER w, true) OR long OR (coalesce(lag(h) OVER w, 0) * 31 + h) % 4294967291 % 2 = 0 AS last
  FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM ends),
chunks AS (SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) > 1 OR bool_or(long) AS counts
  FROM placed GROUP BY doc_id, place),
ranked AS (SELECT *, counts AND row_number() OVER (PARTITION BY chunk, counts ORDER BY doc_id, place) > 1 AS gone FROM chunks),
texts AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text FROM ranked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN t.text END AS text, coalesce(t.n_chunks, 0) AS n_chunks,
       coalesce(t.n_removed, 0) AS n_removed, length(d.text) - length(t.text) AS removed_chars
FROM documents d LEFT JOIN texts t USING (doc_id)
"""



def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base score and the model's score of every document, learned from the documents that are not held out."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    model = mixing.fit(documents.filter(~held_out))
    found = mixing.scored(documents, model)
    return found.select("doc_id", held_out.alias("held_out"), *found.columns[1:])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


_OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?
-
]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
grams AS (SELECT lang, s AS size, array_to_string(w[i:i+s-1], ' ') AS phrase
  FROM words, LATERAL unnest([1, 2, 3]) AS a(s), LATERAL unnest(generate_series(1, len(w) - s + 1)) AS b(i)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.n AS a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * c.n * c.n) // (x.n::HUGEINT * y.n) AS score
  FROM candidates c, LATERAL unnest(generate_series(1, c.size - 1)) AS u(k)
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k+1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, n FROM candidates WHERE size = 3),
gone AS (SELECT lang, phrase, max(n) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT * FROM lowest LEFT JOIN gone USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, t.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000
"""

def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


# The CRC is folded bit by bit: a byte is taken in, then eight steps follow.
_OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS size,
         substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM t),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
  SELECT c.conv_id, 0 AS part, b.place, b.id, b.size FROM convs c JOIN turns b ON b.conv_id = c.base AND b.place <= c.h
  UNION ALL SELECT c.conv_id, 1, o.place, o.id, o.size FROM convs c JOIN turns o ON o.conv_id = c.conv_id AND o.place > c.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM parts),
prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS size FROM convs
  UNION ALL SELECT conv_id, depth, string_agg(id, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth), size FROM placed),
ends AS (SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM prefixes GROUP BY conv_id) GROUP BY prefix),
nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(size) AS saved FROM prefixes GROUP BY prefix, depth),
children AS (SELECT substr(prefix, 1, length(prefix) - 32) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT x.*, coalesce(c.n, 0) AS n_children FROM nodes x LEFT JOIN children c USING (prefix)),
above AS (SELECT substr(prefix, 1, 32 * d) AS prefix, saved, n_children FROM full_nodes, LATERAL unnest(generate_series(0, depth)) AS u(d)),
sums AS (SELECT prefix, sum(saved)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY prefix)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, s.leaves AS n_leaves, s.saved AS saved_tokens,
       coalesce(e.ends, sha256('')) AS ends_sha256
FROM full_nodes x JOIN sums s USING (prefix) LEFT JOIN ends e USING (prefix)
  LEFT JOIN nodes p ON x.depth > 0 AND p.prefix = substr(x.prefix, 1, length(x.prefix) - 32)
"""

QUERIES = {"op1_bpe": op1_bpe, "op2_near_duplicates": op2_near_duplicates, "op3_decontamination": op3_decontamination, "op4_chat": op4_chat, "op5_toxicity": op5_toxicity, "op6_token_files": op6_token_files, "op7_html_text": op7_html_text, "op8_quality": op8_quality, "op9_url_filter": op9_url_filter, "op10_line_dedup": op10_line_dedup, "op10_passage_dedup": op10_passage_dedup, "op11_lm_score": op11_lm_score, "op12_collocations": op12_collocations, "op13_prefix_trie": op13_prefix_trie}
ORACLES: dict[str, str] = {"op8_quality": _op8_sql(), "op4_chat": _OP4_SQL, "op2_near_duplicates": _OP2_SQL, "op3_decontamination": _OP3_SQL, "op9_url_filter": _OP9_SQL, "op10_line_dedup": _OP10_SQL, "op12_collocations": _OP12_SQL, "op13_prefix_trie": _OP13_SQL}
