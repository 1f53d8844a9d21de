"""The registered queries of the text operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as _alignment
from . import bpe as _bpe
from . import decontam as _decontam
from . import htmltext as _htmltext
from . import jaccard as _jaccard
from . import linedup as _linedup
from . import pii as _pii
from . import quality as _quality
from . import sharding as _sharding
from . import substrings as _substrings
from . import toolcalls as _toolcalls
from . import toxicity as _toxicity
from . import whitening as _whitening
from .common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Tools of the derived conversations: two with a schema, one with a schema that can't be read; others are unknown.
TOOLS = (
    '[{"name": "click", "parameters": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 89}}}}, '
    '{"name": "view", "parameters": {"type": "object", "properties": {"k": {"type": "integer", "exclusiveMinimum": 4}}}}, '
    '{"name": "purchase", "parameters": {"type": "object", "properties": {"k": {"pattern": "("}}}}]'
)


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with tools, four events each: ``conversations`` holds no calls, so all of ``events`` serve.

    An event is a call and its result. A call needs the one before it; in every seventh conversation the
    first needs the second. Some calls come before what they need, repeat an identifier, are malformed or
    have no result; some results name no call.
    """
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    e = e.select("*", (-1 - F.floor(F.col("event_id") / 4)).alias("conv_id"), (F.col("event_id") % 4).alias("j"))
    own = F.concat(F.lit("e"), F.when((F.col("j") == 3) & (F.col("conv_id") % 3 == 0), F.col("event_id") - 1).otherwise(F.col("event_id")))
    need = F.when(F.col("j") > 0, F.concat(F.lit("e"), F.col("event_id") - 1)).when(F.col("conv_id") % 7 == 0, F.concat(F.lit("e"), F.col("event_id") + 1))
    call = F.concat(
        F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "id": "'), own, F.lit('", "arguments": '), "props", F.coalesce(F.concat(F.lit(', "depends_on": ["'), need, F.lit('"]')), F.lit("")), F.lit("}</tool_call>")
    )
    turn = F.when((F.col("event_id") % 5 == 2) & (F.col("j") > 0), 2 * F.col("j") - 2).otherwise(2 * F.col("j") + 1)
    calls = e.select("conv_id", turn.alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("event_id") % 37 == 6, "<tool_call>{oops</tool_call>").otherwise(call).alias("text"))
    named = F.when(F.col("event_id") % 13 == 5, F.concat(F.lit("x"), F.col("event_id"))).otherwise(own)
    result = F.concat(F.lit('{"tool_call_id": "'), named, F.lit('", "content": {"rows": '), F.col("event_id"), F.lit("}}"))
    results = e.where("event_id % 10 > 0").select("conv_id", (2 * F.col("j") + 2).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    system = e.where("j = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(f"<tools>{TOOLS}</tools>").alias("text"))
    return calls.unionByName(results).unionByName(system)


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and those that ``tool_messages`` derives from all events."""
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tool_messages(spark, sf_dir))
    return _toolcalls.link(messages).withColumn("problems", F.array_join("problems", "; "))


def _op2_sql() -> str:
    """What the docstring of ``tool_messages`` says, and the outcome of each message, said anew over the tables."""
    system = f"'{{\"content\":' || to_json('<tools>{TOOLS}</tools>')::VARCHAR || ',\"role\":\"system\"}}'"
    return """
WITH RECURSIVE e AS (SELECT event_id, event_type AS name, (props->>'$.k')::BIGINT AS k, -1 - event_id // 4 AS conv, event_id % 4 AS j FROM events),
c AS (SELECT *, 'e' || CASE WHEN j = 3 AND conv % 3 = 0 THEN event_id - 1 ELSE event_id END AS ref, CASE WHEN event_id % 5 = 2 AND j > 0 THEN 2 * j - 2 ELSE 2 * j + 1 END AS turn,
  CASE WHEN j > 0 THEN 'e' || (event_id - 1) WHEN conv % 7 = 0 THEN 'e' || (event_id + 1) END AS need, event_id % 37 = 6 AS broken FROM e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv, ref ORDER BY turn, '{"k":' || k || '}') AS nth FROM c WHERE NOT broken),
node AS (SELECT conv, ref, turn, need FROM ranked WHERE nth = 1),
arc AS (SELECT a.conv, a.ref, a.need FROM node a JOIN node b ON a.conv = b.conv AND a.need = b.ref),
behind(conv, ref, need) AS (SELECT * FROM arc UNION SELECT b.conv, b.ref, a.need FROM behind b JOIN arc a ON a.conv = b.conv AND a.ref = b.need),
looped AS (SELECT conv, ref FROM behind WHERE ref = need),
placed AS (SELECT n.conv, n.ref, EXISTS (SELECT 1 FROM looped l WHERE l.conv = n.conv AND (l.ref = n.ref OR l.ref IN (SELECT need FROM behind b WHERE b.conv = n.conv AND b.ref = n.ref))) AS cyclic,
  greatest(n.turn, (SELECT max(m.turn) FROM behind b JOIN node m ON m.conv = b.conv AND m.ref = b.need WHERE b.conv = n.conv AND b.ref = n.ref)) AS upto,
  (SELECT count(*) FROM behind b WHERE b.conv = n.conv AND b.ref = n.ref) AS depth, n.turn FROM node n),
p AS (SELECT conv, ref, cyclic, CASE WHEN cyclic THEN turn ELSE upto END AS order_turn, CASE WHEN cyclic THEN 0 ELSE depth END AS order_depth FROM placed),
r AS (SELECT *, CASE WHEN event_id % 13 = 5 THEN 'x' || event_id ELSE ref END AS named, 2 * j + 2 AS back FROM c WHERE event_id % 10 > 0),
said AS (SELECT q.*, cyclic, order_turn, order_depth, EXISTS (SELECT 1 FROM r WHERE r.conv = q.conv AND r.named = q.ref) AS answered,
  CASE WHEN name = 'click' AND k > 89 THEN '$.k: over maximum' WHEN name = 'view' AND k <= 4 THEN '$.k: under minimum' ELSE '' END AS problems FROM ranked q LEFT JOIN p USING (conv, ref))
SELECT conv AS conv_id, turn, 'assistant' AS role, 'call' AS part, ref AS call_id, CASE WHEN nth > 1 THEN 'duplicate' WHEN cyclic THEN 'cycle' WHEN name NOT IN ('click', 'view', 'purchase') THEN 'unknown_tool'
    WHEN name = 'purchase' THEN 'bad_schema' WHEN problems <> '' THEN 'invalid' WHEN NOT answered THEN 'pending' ELSE 'linked' END AS status, problems,
  CASE WHEN nth > 1 THEN turn ELSE greatest(order_turn, turn) END AS order_turn, CASE WHEN nth > 1 THEN 0 ELSE order_depth END::INT AS order_depth,
  '{"role":"assistant","tool_calls":[{"function":{"arguments":{"k":' || k || '},"name":"' || name || '"},"id":"' || ref || '","type":"function"}]}' AS json FROM said
UNION ALL SELECT conv, turn, 'assistant', 'malformed', NULL, 'malformed', '', turn, 0, '{"content":"{oops","role":"assistant"}' FROM c WHERE broken
UNION ALL SELECT r.conv, back, 'tool', 'result', named, CASE WHEN p.ref IS NULL THEN 'orphan' WHEN cyclic THEN 'cycle' ELSE 'linked' END, '', greatest(back, coalesce(order_turn, back)), coalesce(order_depth + 1, 0)::INT,
  '{"content":{"rows":' || event_id || '},"role":"tool","tool_call_id":"' || named || '"}' FROM r LEFT JOIN p ON p.conv = r.conv AND p.ref = named
UNION ALL SELECT conv, 0, 'system', 'text', NULL, 'text', '', 0, 0, """ + system + """ FROM c WHERE j = 0
UNION ALL SELECT conv_id, turn, role, 'text', NULL, 'text', '', turn, 0, '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":"' || coalesce(role, 'user') || '"}' FROM conversations"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _linedup.dedup_lines(docs, count_cols=True)


#: The documents lie in so many old shards, by source, before they are dealt to the new ones.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    placed = _sharding.reshard(read(spark, sf_dir, "documents"), old, NEW_SHARDS, "rows")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = _bpe.round_trip(read(spark, sf_dir, "documents"), ranks)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_classes(read(spark, sf_dir, "documents")).drop("text_hash", "stays")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _quality.quality(read(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = _toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = _toxicity.score(docs, model)
    return scored.select("doc_id", _toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pii.pii(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.kind = '{k.name}')) as long)").alias(f"n_{k.name}") for k in _pii.KINDS if k.base_kind]
    secrets = F.expr("cast(size(filter(spans, x -> x.kind = 'secret')) as long)").alias("n_secret")
    spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(F.expr(_pii.joined("base_spans")), 256).alias("base_sha256"), F.expr(_pii.joined("spans")).alias("spans"), secrets, spans)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = _htmltext.extract(pages, _htmltext.fit(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = _whitening.fit(vectors)
    rows = _whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(float(v)) for v in model.explained]) if model else F.array().cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model and model.n).cast("long").alias("n"), "deviation", "whitened",
        F.nanvl(F.get(share, "at"), F.lit(None)).alias("explained"), F.lit(model and model.identity_error).cast("double").alias("identity_error"),
    )


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _substrings.cut(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.expr("aggregate(removed, 0L, (n, r) -> n + r.end - r.begin)")
    return left.select("doc_id", (F.octet_length("kept") + n_removed).alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    found = _alignment.link_statistics(read(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def line_dedup_sql(table: str) -> str:
    """Common table expressions up to ``deduped``: the documents of ``table`` without later repeated passages."""
    return rf"""
WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {table}), unnest(range(1, len(ls) + 1)) AS u(i)),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM l WHERE w > 0),
win AS (SELECT doc_id, pos, max(pos) OVER r AS last, list(line) OVER r AS content, max(before + w) OVER r - before AS total FROM c
  WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {_linedup.WORDS - 1} FOLLOWING)),
back AS (SELECT doc_id, min(pos) OVER r AS pos, pos AS last, list(line) OVER r AS content, before + w - min(before) OVER r AS total FROM c
  WINDOW r AS (PARTITION BY doc_id ORDER BY before + w RANGE BETWEEN {_linedup.WORDS - 1} PRECEDING AND CURRENT ROW)),
runs AS (SELECT DISTINCT * FROM (SELECT * FROM win UNION ALL SELECT * FROM back) WHERE total >= {_linedup.WORDS}),
nth AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS n FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM nth WHERE n > 1),
left_over AS (SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
deduped AS (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
  coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(n_kept, 0) AS n_removed, d.lang, d.source, d.n_chars FROM {table} d LEFT JOIN left_over k ON d.doc_id = k.doc_id)
"""


def _op7_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(_quality.STOP_WORDS))
    checks = " AND ".join(re.sub(r"(\d)D\b", r"\1", r.sql()) for r in _quality.RULES)
    over = {k: v.replace("/ n_words", "/ greatest(n_words, 1)").replace("/ n_lines", "/ greatest(n_lines, 1)") for k, v in _quality.RATIOS.items()}
    ratios = ", ".join(f"{v} AS {k}" for k, v in over.items())
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i FROM cut, unnest(range(1, len(w) - 1)) AS u(i)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest([0, 1, 2]) AS u(k) WHERE n > 1 GROUP BY r),
c AS (SELECT doc_id, r, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stop}))) AS n_stop_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
  len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_upper_words,
  len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis_lines FROM cut),
f AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratios} FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({checks}) AS kept FROM v"""


def _op9_sql() -> str:
    patterns = {  # as the contract writes them; the added kinds as the operator has them
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    } | {k.name: k.pattern for k in _pii.KINDS if not k.base_kind} | {"secret": "[A-Za-z0-9_/+-]{20,}"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ascii(reverse({digits})[i]) - 48 ELSE 2 * (ascii(reverse({digits})[i]) - 48) - CASE WHEN reverse({digits})[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
    iban = "replace(m, ' ', '')"
    mod97 = f"list_reduce(list_transform(string_split(substr({iban}, 5) || substr({iban}, 1, 4), ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1"
    check = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": f"len({digits}) BETWEEN 12 AND 19 AND CASE WHEN len({digits}) BETWEEN 12 AND 19 THEN {luhn} END",
        "phone": f"len({digits}) BETWEEN 9 AND 15",
        "iban": mod97,
        "local_phone": "true",
        "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= 10",
    }
    reach = _pii.REACH
    near = f"lower(CASE WHEN s <= {reach} THEN ' ' ELSE '' END || t[greatest(s - {reach + 1}, 0) + 1 : s] || '  ' || t[s + length(m) + 1 : s + length(m) + {reach + 1}] || CASE WHEN s + length(m) + {reach} >= length(t) THEN ' ' ELSE '' END)"
    parts = []
    for rank, k in enumerate(_pii.KINDS):
        words = [(w, g) for w, g in ((k.words, _pii.CONTEXT_GAIN), (k.against, -_pii.CONTEXT_LOSS)) if w]
        score = f"{k.base}" + "".join(f" + CASE WHEN regexp_matches({near}, '{_pii.whole(w)}') THEN {g} ELSE 0 END" for w, g in words)
        parts.append(f"""SELECT r, {rank} AS rank, '{k.name}' AS kind, s, s + length(m) AS e, {score} AS score, {str(k.base_kind).lower()} AS base FROM (
  SELECT r, t, ms[i] AS m, (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM (
    SELECT r, t, regexp_extract_all(t, '{patterns[k.name]}') AS ms, string_split_regex(t, '{patterns[k.name]}') AS gaps FROM d), unnest(range(1, len(ms) + 1)) AS u(i)) WHERE {check[k.name]}""")
    hits = "\nUNION ALL ".join(parts)
    names = [k.name for k in _pii.KINDS if k.base_kind or k.name == "secret"]
    own = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in names)
    outs = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in names)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
hit AS ({hits}),
kept AS (SELECT * FROM hit WHERE base OR (score >= {_pii.THRESHOLD} AND NOT EXISTS (SELECT 1 FROM hit b WHERE b.base AND b.r = hit.r AND b.s < hit.e AND hit.s < b.e))),
per AS (SELECT r, {own}, count(*) AS n_spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE base) AS base_spans,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY r)
SELECT doc_id, {outs}, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)"""


QUERIES = {"op1_decontamination": op1_decontamination, "op2_tool_calls": op2_tool_calls, "op3_line_dedup": op3_line_dedup, "op4_resharding": op4_resharding, "op5_byte_bpe": op5_byte_bpe, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_quality_rules": op7_quality_rules, "op8_toxicity": op8_toxicity, "op9_pii": op9_pii, "op10_html_text": op10_html_text, "op11_whitening": op11_whitening, "op12_substrings": op12_substrings, "op13_alignment": op13_alignment}
ORACLES = {"op2_tool_calls": _op2_sql(), "op3_line_dedup": line_dedup_sql("documents") + "SELECT doc_id, n_lines, n_removed, text FROM deduped", "op7_quality_rules": _op7_sql(), "op9_pii": _op9_sql()}
