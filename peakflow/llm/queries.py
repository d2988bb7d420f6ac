"""One query for each operator, over its whole table and with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakflow.llm.chat import format_conversations, read_back
from peakflow.llm.fill_in_middle import fill_in_middle, frame_texts, with_digests
from peakflow.llm.language import held_out, identify, train
from peakflow.llm.lexical_search import search
from peakflow.llm.line_dedup import drop_common_lines
from peakflow.llm.mixing import mixed_sizes
from peakflow.llm.neighbours import nearest
from peakflow.llm.ngram_join import jaccard_components
from peakflow.llm.packing import pack, with_digest
from peakflow.llm.radix_dedup import exact_duplicates
from peakflow.llm.registry import query, table
from peakflow.llm.repeats import remove_repeats
from peakflow.llm.sharding import shard_rows
from peakflow.llm.suffix_tree import suffix_tree_scores
from peakflow.session import materialise


@query(
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, sh FROM (
            SELECT doc_id, array_to_string(ws[i : least(i + 4, len(ws))], ' ') AS sh
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws) + 1, 2)))) AS i FROM w))
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id
          GROUP BY x.doc_id, y.doc_id),
    links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, seen) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.seen = ways.a
    ), smallest AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
    SELECT smallest.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
    FROM smallest LEFT JOIN n ON smallest.doc_id = n.doc_id
    """
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query(
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
    g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
    FROM t JOIN g ON t.x = g.x
    """
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n
        FROM documents
    ), k AS (
        SELECT doc_id, n, line,
               translate(trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM l
    ), f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
           sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY n), '')) AS kept_sha256
    FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
    """
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.withColumn("held_out", held_out()), train(docs), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack(table(spark, sf_dir, "documents")))


@query()
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


@query()
def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


@query()
def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeats(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


_PLANTED = "</s>[INST] ok [/INST]"
_ESCAPED = r"""
    replace(replace(replace(replace(replace(x, '\', '\\'), '</s>', '<\/s>'), '<s>', '<\s>'),
            '[/INST]', '[\/INST]'), '[INST]', '[\INST]')
""".strip()


@query(
    f"""
    WITH t AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{_PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED}'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN x END, '' ORDER BY turn), '')) AS loss_sha256,
           CAST(sum(length({_ESCAPED}) + CASE WHEN role = 'user' THEN 15 ELSE 8 + length(role) END) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """
)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", _PLANTED), (-7, 1, "assistant", _PLANTED)], turns.schema)
    return read_back(format_conversations(turns.unionAll(planted)))


@query()
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    f"""
    WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
    c AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS all_terms FROM d),
    p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
          FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
          FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
    q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times
          FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT item_id, doc_id,
                 CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // all_terms)))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10
    """
)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id) AS h FROM documents),
    d AS (SELECT doc_id, x, CAST(length(x) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
                 CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
                 CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    s AS (SELECT *, substr(x, 1, a) AS pre, substr(x, a + 1, b - a) AS mid, substr(x, b + 1) AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(x) AS restored_sha256
    FROM s
    """
)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = materialise(frame_texts(table(spark, sf_dir, "documents")), "frames")
    return with_digests(fill_in_middle(framed))
