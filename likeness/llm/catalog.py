"""The queries of this subpackage, each with its production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from likeness.llm.chat import format_conversations
from likeness.llm.collocations import collocations
from likeness.llm.common import table
from likeness.llm.divergence import divergence
from likeness.llm.language import identify
from likeness.llm.marked_words import encode_and_decode
from likeness.llm.media import media_columns
from likeness.llm.near_duplicates import near_duplicates
from likeness.llm.neighbours import search
from likeness.llm.packing import pack_documents
from likeness.llm.repeated_passages import without_repeats
from likeness.llm.token_counts import count_tokens
from likeness.llm.toxicity import score_documents
from likeness.llm.url_filters import judge

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: A conversation whose texts are themselves control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return format_conversations(turns.unionByName(planted))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over the tables' urls with planted redirects (each page whose id has a remainder of
    1 or 2 modulo 4 to the next), since the pages' own html declares none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("target"))
    edges = pages.filter("page_id % 4 in (1, 2)").join(following, "page_id").select(F.col("url").alias("source"), "target")
    return judge(pages, URL_RULES, edges)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op7_marked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_nearest_neighbours, op2_token_counts, op3_chat_format, op4_url_filter, op5_best_fit_packing, op6_media_columns, op7_marked_words, op8_language_id, op9_toxicity, op10_near_duplicates, op11_repeated_passages, op12_source_divergence, op13_collocations, url_aliases)
}

_ESCAPED_LENGTH = r"""length({0}) + (length({0}) - length(replace({0}, chr(92), '')))
            + len(regexp_extract_all({0}, '<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]'))"""

_RULED = """
        parts AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        named AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1) AS query FROM parts),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM named)"""
_BLOCKED = "('example.com/en/', 'net/es/', 'net/fr/')"

#: Queries that learn, tokenize, search approximately or store media have none: tests hold them
#: against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
        sized AS (
            SELECT *, {_ESCAPED_LENGTH.format("role")} + {_ESCAPED_LENGTH.format("text")} + length('<|turn|><|text|><|end|>') AS n FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op10_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
        rows AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.seen = links.a),
        labels AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN labels USING (doc_id)""",
    # No page of the tables declares a redirect or a canonical url, so a page without a rule is allowed.
    "op4_url_filter": f"WITH {_RULED} SELECT page_id, host, path, rule, CASE WHEN rule IN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict FROM ruled",
    "url_aliases": f"""
        WITH RECURSIVE {_RULED},
        own AS MATERIALIZED (SELECT *, host || chr(10) || path || chr(10) || query AS node, CASE WHEN rule IN {_BLOCKED} THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM ruled),
        edges AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM own a JOIN own b ON b.page_id = a.page_id + 1 WHERE a.page_id % 4 IN (1, 2)),
        links AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
        decided AS (SELECT reach.node, min(ruled) AS verdict FROM reach JOIN own ON own.node = reach.seen GROUP BY reach.node)
        SELECT page_id, host, path, rule, coalesce(ruled, decided.verdict, 'allow') AS verdict FROM own LEFT JOIN decided USING (node)""",
    "op11_repeated_passages": r"""
        WITH words AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        windows AS MATERIALIZED (
            SELECT row, doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS passage FROM words WHERE len(w) >= 13),
        firsts AS (SELECT passage, min(doc_id) AS first FROM windows GROUP BY passage),
        gone AS (SELECT row, list_sort(list_distinct(flatten(list(range(p, p + 13))))) AS gone FROM windows JOIN firsts USING (passage) WHERE first < doc_id GROUP BY row),
        places AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
        left_over AS (
            SELECT row, string_agg(word, ' ' ORDER BY p) AS kept FROM places ANTI JOIN (SELECT row, unnest(gone) AS p FROM gone) USING (row, p) GROUP BY row)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN gone USING (row) LEFT JOIN left_over USING (row)""",
    "op12_source_divergence": r"""
        WITH named AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        found AS (SELECT lang, source, regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM named),
        kept AS MATERIALIZED (
            SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM found) GROUP BY ALL HAVING count(*) >= 30),
        counts AS MATERIALIZED (
            SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM found) JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM named),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        own AS MATERIALIZED (
            SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) AS p
            FROM totals JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
        whole AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
            FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL) JOIN sizes USING (lang)),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_collocations": r"""
        WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
        words AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
        grams AS (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
            FROM words, (VALUES (1), (2), (3), (4), (5)) AS sizes(m) WHERE len(w) >= m),
        f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
        candidates AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
        cut AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
        parts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM cut),
        scored AS (
            SELECT p.lang, p.phrase, p.a, p.k, x.a AS l, y.a AS r, n, (1000::HUGEINT * p.a * n) // (x.a * y.a) AS score
            FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = head JOIN f y ON y.lang = p.lang AND y.phrase = tail JOIN totals ON totals.lang = p.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM candidates)) GROUP BY ALL),
        ranked AS (
            SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 2000""",
}
