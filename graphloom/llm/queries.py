"""Queries of the corpus operators over the driver's tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat
from graphloom.llm.alignment import alignment
from graphloom.llm.collocations import collocations
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.fingerprints import edited_likeness
from graphloom.llm.jaccard_join import jaccard_components
from graphloom.llm.licenses import TEMPLATES, scan_licenses
from graphloom.llm.lm_score import backoff_scores
from graphloom.llm.media import from_flac, to_flac
from graphloom.llm.packing import pack_documents
from graphloom.llm.pii import KINDS as PII_KINDS
from graphloom.llm.pii import find_pii
from graphloom.llm.secrets_scan import KINDS as SECRET_KINDS
from graphloom.llm.secrets_scan import scan_secrets
from graphloom.llm.toxicity import toxicity
from graphloom.session import table


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated", "n_near_items")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _span_digest(spans: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and digests of the base kinds' spans, and all spans as text."""
    text = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(list(kinds)))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in kinds]  # noqa: B023
    return spans.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(scan_secrets(table(spark, sf_dir, "documents")), SECRET_KINDS)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_pii(table(spark, sf_dir, "documents")), PII_KINDS)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), spark.createDataFrame(TEMPLATES, "license string, text string"))
    licenses = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["license"], f["first_word"])), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), licenses.alias("licenses"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = chat.as_transcripts(table(spark, sf_dir, "conversations"))
    return chat.parse_transcripts(raw.drop("role"), chat.learn(raw))


def op4_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = from_flac(to_flac(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["sample_offset"], b["byte_offset"], b["samples"])), ",").alias("block_offsets"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round(F.col("log_score") / F.greatest("n_tokens", F.lit(1)), 6).alias("mean_log_score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


LLM_QUERIES = {
    "op11_collocations": op11_collocations,
    "op13_imatch": op13_imatch,
    "op12_token_alignment": op12_token_alignment,
    "op8_lm_score": op8_lm_score,
    "op4_media_flac": op4_media_flac,
    "op7_chat_format": op7_chat_format,
    "op2_license_scan": op2_license_scan,
    "op1_pii": op1_pii,
    "op5_secret_scan": op5_secret_scan,
    "op3_packing": op3_packing,
    "op10_toxicity": op10_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op9_decontamination": op9_decontamination,
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PARTS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_TEMPLATES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES)

#: Models (1, 5, 7, 10), tokenizers (3, 12) and codecs (4) are beyond SQL; tests hold those to brute-force versions.
LLM_SQL: dict[str, str] = {
    "op11_collocations": r"""WITH p AS (SELECT row_number() OVER () AS d, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
      w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
      g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase, w[i:i+k-1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)),
      f AS (SELECT lang, k, phrase, any_value(g) AS g, count(*) AS f FROM g GROUP BY lang, k, phrase),
      n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
      c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
      h AS (SELECT lang, array_to_string(g[1:2], ' ') AS phrase, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(g[2:3], ' '), f FROM c WHERE k = 3),
      d AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(f) AS m FROM h GROUP BY lang, phrase) h USING (lang, phrase) WHERE k = 3 OR m IS NULL OR 100 * m < 50 * c.f),
      u AS (SELECT lang, k, phrase, f, 1 AS j, g[1] AS x, array_to_string(g[2:], ' ') AS y FROM d UNION ALL SELECT lang, k, phrase, f, 2, array_to_string(g[1:2], ' '), g[3] FROM d WHERE k = 3),
      s AS (SELECT u.lang, u.k, u.phrase, u.f AS a, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * u.f * u.f) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, j FROM u JOIN f l ON l.lang = u.lang AND l.phrase = x JOIN f r ON r.lang = u.lang AND r.phrase = y),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
      t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
      SELECT lang, rank, phrase, a, l, r, n, score, k AS words FROM t JOIN n USING (lang) WHERE rank <= 2000""",
    "op2_license_scan": f"""WITH t(license, text) AS (VALUES {_TEMPLATES}), v AS (SELECT DISTINCT license, {_WORDS.format("text")} AS w FROM t),
      z AS (SELECT row_number() OVER () AS tid, license, w, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m FROM v),
      s AS (SELECT DISTINCT tid, license, k, m, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM z)),
      c AS (SELECT tid, count(*) AS n FROM s GROUP BY tid),
      d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
      p AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM s) WHERE len(w) >= k)),
      h AS (SELECT doc_id, tid, license, m, i, p.g FROM p JOIN s ON p.g = s.g AND p.k = s.k),
      q AS (SELECT doc_id, tid, license, m, g, (i - 1) // m AS win FROM h UNION ALL SELECT doc_id, tid, license, m, g, (i - 1) // m - 1 FROM h WHERE (i - 1) // m >= 1),
      f AS (SELECT doc_id, license, win * m + 1 AS first, count(DISTINCT g) / CAST(max(n) AS DOUBLE) AS share FROM q JOIN c USING (tid) GROUP BY doc_id, tid, license, m, win),
      b AS (SELECT doc_id, license, first FROM f WHERE share >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY share DESC, first) = 1),
      l AS (SELECT doc_id, count(*) AS n, string_agg(license || ':' || first, ',' ORDER BY license) AS licenses FROM b GROUP BY doc_id)
      SELECT documents.doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN l USING (doc_id)""",
    "op6_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_PARTS} AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
      r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
      SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = w.doc_id""",
    "op8_lm_score": f"""WITH t AS (SELECT doc_id, i, w[i] AS w, CASE WHEN i > 1 THEN w[i-1] END AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {_PARTS} AS w FROM documents))),
      one AS (SELECT w, count(*) AS c FROM t GROUP BY w), own1 AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL),
      two AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY ALL), own2 AS (SELECT doc_id, v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY ALL),
      n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
      x AS (SELECT t.doc_id, t.v, one.c - own1.c AS o1, coalesce(two.c - own2.c, 0) AS o2, p.c - q.c AS ov, greatest((SELECT count(*) FROM t) - n.n, 1) AS rest FROM t JOIN one ON one.w = t.w JOIN own1 ON own1.doc_id = t.doc_id AND own1.w = t.w JOIN n ON n.doc_id = t.doc_id
        LEFT JOIN two ON two.v = t.v AND two.w = t.w LEFT JOIN own2 ON own2.doc_id = t.doc_id AND own2.v = t.v AND own2.w = t.w LEFT JOIN one p ON p.w = t.v LEFT JOIN own1 q ON q.doc_id = t.doc_id AND q.w = t.v),
      y AS (SELECT doc_id, sum(CASE WHEN v IS NOT NULL AND o2 > 0 THEN ln(o2 / CAST(ov AS DOUBLE)) ELSE ln((CASE WHEN o1 > 0 THEN o1 ELSE 0.5 END) / CAST(rest AS DOUBLE)) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END END) AS s FROM x GROUP BY doc_id)
      SELECT documents.doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(s, 0), 4) AS log_score, round(coalesce(s, 0) / greatest(coalesce(n, 0), 1), 6) AS mean_log_score FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op9_decontamination": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
      x AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
      d AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w CROSS JOIN (SELECT DISTINCT n FROM x) WHERE len(w) >= n)),
      m AS (SELECT doc_id, i, d.n, item_id FROM d JOIN x ON d.g = x.g AND d.n = x.n),
      h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
      k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
      f AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM w) GROUP BY t),
      v AS (SELECT item_id, g, t, row_number() OVER (PARTITION BY item_id, g ORDER BY coalesce(f.n, 0), t) AS r, coalesce(f.n, 0) AS c FROM (SELECT DISTINCT item_id, g, unnest(string_split(g, ' ')) AS t FROM x) LEFT JOIN f USING (t)),
      q AS (SELECT DISTINCT item_id, t1, t2 FROM (SELECT item_id, g, max(CASE WHEN r = 1 THEN t END) AS t1, max(CASE WHEN r = 2 THEN t END) AS t2, min(c) AS c FROM v GROUP BY item_id, g) WHERE c > 0),
      o AS (SELECT doc_id, p, t FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM w) WHERE t IN (SELECT t1 FROM q UNION SELECT t2 FROM q)),
      z AS (SELECT DISTINCT a.doc_id, item_id FROM q JOIN o a ON a.t = t1 LEFT JOIN o b ON b.t = t2 AND b.doc_id = a.doc_id AND abs(a.p - b.p) < 13 WHERE t2 IS NULL OR b.p IS NOT NULL),
      y AS (SELECT doc_id, count(*) AS n_near FROM z GROUP BY doc_id)
      SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(n_near, 0) AS n_near_items
      FROM w LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN y USING (doc_id)""",
}
