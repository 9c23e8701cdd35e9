"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import spread, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    from weftline.llm import simhash

    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")), words=4, radius=4)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of 2048 tokens."""
    from weftline.llm import packing

    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), tokenizer("word_bpe_49k.json"), capacity=2048)


#: The rules that label URLs, and what they say.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL with its rule and verdict."""
    from weftline.llm import urls

    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back; conversation -7 says control strings."""
    from weftline.llm import chat

    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    back = chat.read_back(chat.format_conversations(rows.unionByName(own)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored payload, and what was read back."""
    from weftline.llm import media

    found = media.document_media(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    from weftline.llm import language

    return language.identify(spread(table(spark, sf_dir, "documents")))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log10 probabilities under the unigram base and the back-off automaton."""
    from weftline.llm import lm

    return lm.score(spread(table(spark, sf_dir, "documents")))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has text left, without the lines that stand on many sites."""
    from weftline.llm import lines

    return lines.dedup_lines(table(spark, sf_dir, "documents"), least_sites=10)


OP8_SQL = r"""
WITH split AS (
    SELECT DISTINCT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), line AS (
    SELECT doc_id, source, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), keyed AS (
    SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS k FROM line
), spread AS (
    SELECT k, min(doc_id) AS keeper FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10
), marked AS (
    SELECT keyed.doc_id, keyed.text, pos, line, coalesce(keyed.doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN spread ON keyed.k = spread.k
), made AS (
    SELECT doc_id, text AS old, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
           string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS rest
    FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE rest END AS text, d.lang, d.source, d.n_chars,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN made ON d.doc_id = made.doc_id AND d.text = made.old
WHERE coalesce(n_removed, 0) = 0 OR regexp_matches(rest, '\S')
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict."""
    from weftline.llm import quality

    return quality.judge(spread(table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded and decoded."""
    from weftline.llm import bpe

    path = tokenizer("byte_bpe_50k.json")
    ids = bpe.encode(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), path).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: those of the patterns, and all."""
    from weftline.llm import secret_scan as scan

    found = scan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = ("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[scan.count_of(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(scan.written(F.col("spans"), base), 256).alias("base_sha256"),
        scan.written(F.col("spans")).alias("spans"),
    )


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's code in eight parts."""
    from weftline.llm import vector_codes

    found = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def codes_sql(rounds: int = 6) -> str:
    """Plain rounds: every part against every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
    SELECT v.vec_id, v.label, v.part, v.x, arg_min(b.entry, (b.error, b.entry)) AS entry, min(b.error) AS error
    FROM parts v JOIN LATERAL (
        SELECT entry, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS error FROM book{k} c WHERE c.part = v.part
    ) b ON true GROUP BY ALL
)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
    SELECT part, entry, place, sum(x[place])::BIGINT AS total, count(*) AS n FROM near{k}, range(1, len(x) + 1) t(place) GROUP BY ALL
), new{k} AS (
    SELECT part, entry, list((total - (total % n + n) % n) // n ORDER BY place) AS x FROM mean{k} GROUP BY ALL
), book{k + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN new{k} m ON b.part = m.part AND b.entry = m.entry
)""")
    return f"""
WITH whole AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, part, v[len(v) * part // 8 + 1 : len(v) * (part + 1) // 8] AS x FROM whole, range(8) t(part)
), first AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole ORDER BY vec_id LIMIT 16
), book0 AS MATERIALIZED (
    SELECT part, entry, x FROM parts JOIN first USING (vec_id)
), {", ".join(steps)}, found AS (
    SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM near{rounds} GROUP BY ALL
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM found
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to four words."""
    from weftline.llm import collocations

    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws, count(*) AS m FROM piece GROUP BY ALL
), gram AS (
    SELECT lang, m, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: ws[i : i + k - 1])) AS g FROM words, range(1, 5) t(k) WHERE len(ws) >= k
), f AS MATERIALIZED (
    SELECT lang, k, g, sum(m) AS a FROM gram GROUP BY ALL HAVING sum(m) >= 30
), total AS (
    SELECT lang, sum(m * len(ws))::BIGINT AS n FROM words GROUP BY lang
), named AS MATERIALIZED (
    SELECT lang, k, g, a, array_to_string(g, ' ') AS phrase FROM f
), cut AS (
    SELECT lang, phrase, a, j, array_to_string(g[:j], ' ') AS first, array_to_string(g[j + 1 :], ' ') AS rest FROM named, range(1, 4) t(j) WHERE k > j
), cuts AS (
    SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, 2000000 * c.a // (l.a + r.a) AS score
    FROM cut c JOIN named l ON l.lang = c.lang AND l.phrase = c.first JOIN named r ON r.lang = c.lang AND r.phrase = c.rest
), best AS (
    SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), (score, j)) AS b FROM cuts GROUP BY ALL
), sub AS (
    SELECT lang, a, unnest(list_transform(generate_series(1, k - s + 1), lambda i: array_to_string(g[i : i + s - 1], ' '))) AS phrase FROM named, range(2, 4) t(s) WHERE k > s
), longer AS (
    SELECT lang, phrase, max(a) AS a FROM sub GROUP BY ALL
), kept AS (
    SELECT b.* FROM best b LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 80 * b.a
), ranked AS (
    SELECT lang, phrase, a, b.l AS l, b.r AS r, b.score AS score, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_packing": op2_packing,
        "op3_lm": op3_lm,
        "op4_urls": op4_urls,
        "op5_chat": op5_chat,
        "op6_media": op6_media,
        "op7_language": op7_language,
        "op8_lines": op8_lines,
        "op9_quality": op9_quality,
        "op10_bpe": op10_bpe,
        "op11_secrets": op11_secrets,
        "op12_codes": op12_codes,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_lines": OP8_SQL, "op12_codes": codes_sql(), "op13_phrases": OP13_SQL}
