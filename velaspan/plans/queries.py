"""One query for each operator, over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velaspan.functions import text as T
from velaspan.operators import addresses as A
from velaspan.operators import evaluation as E
from velaspan.operators import export as X
from velaspan.operators import generation as G
from velaspan.operators import gold as Gd
from velaspan.operators import matching as M
from velaspan.operators import native as N
from velaspan.operators import resampling as R
from velaspan.operators import spans as S
from velaspan.operators import validation as V
from velaspan.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PRED_SQL = fx.predicted_sql()
STRICT_SQL, LOOSE_SQL, BOTH_SQL = fx.spans_sql(fx.STRICT), fx.spans_sql(fx.LOOSE), fx.spans_sql(fx.STRICT + fx.LOOSE)
SCORES_SQL = "CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1"


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- scans, messages, validity ---------------------------------------------------------------


@query(f"""SELECT id, idx, 'conversazione.' || idx || '.testo' AS field, sender, length(text) AS n_chars FROM ({fx.MESSAGES})""")
def scan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.messages(spark, sf_dir).select("id", "idx", T.field_of(F.col("idx")).alias("field"), "sender", F.length("text").cast("long").alias("n_chars"))


@query(f"""SELECT role, count(*) AS messages, count(DISTINCT id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(length(text)) AS shortest, max(length(text)) AS longest FROM ({fx.MESSAGES}) GROUP BY role""")
def message_stats_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return fx.messages(spark, sf_dir).groupBy("role").agg(F.count("*").alias("messages"), F.count_distinct("id").alias("conversations"), F.sum(n).alias("n_chars"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.messages(spark, sf_dir)
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sender", "text"))), lambda x: F.struct(x["sender"].alias("sender"), x["text"].alias("text"))).alias("messages"))


_ORDERED = f"SELECT id, idx, sender, text, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS pos FROM ({fx.MESSAGES})"
_WRONG = "sender IS NULL OR sender <> CASE WHEN pos % 2 = 0 THEN 'Utente' ELSE 'Agente' END"


@query(f"""SELECT id, idx, sender FROM ({_ORDERED}) WHERE {_WRONG}""")
def role_alternation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("idx")
    rows = fx.messages(spark, sf_dir).withColumn("pos", F.row_number().over(w) - 1)
    return rows.where("sender is null or sender <> if(pos % 2 = 0, 'Utente', 'Agente')").select("id", "idx", "sender")


@query(f"""SELECT id, count(*) AS n_messages, bool_and(NOT ({_WRONG}) AND trim(text) <> '') AS alternates, CAST(floor(count(*) / 2) AS INTEGER) AS exchanges FROM ({_ORDERED}) GROUP BY id""")
def conversation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("id", F.size("messages").cast("long").alias("n_messages"), V.alternates().alias("alternates"), F.floor(F.size("messages") / 2).cast("int").alias("exchanges"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records to export, ids qualified by a hash. Each message's first four characters are a detection; one in 17 has the wrong text."""
    rows = fx.messages(spark, sf_dir)
    k = (F.col("id").cast("long") + F.col("idx")) % 17
    item = F.struct(
        T.field_of(F.col("idx")).alias("field"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.when(k == 5, "?").otherwise(F.substring("text", 1, 4)).alias("text"),
        F.get(F.array(*map(F.lit, ("PERSON", "LOCATION", "EMAIL"))), F.col("idx") % 3).alias("type"), F.array(F.struct(F.lit("made").alias("detector"))).alias("sources"),
    )
    found = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.length("text") >= 4, item))).alias("detections"))
    sha = F.sha2(F.lit("conversations").cast("binary"), 256)
    return _conversations(spark, sf_dir).join(found, "id").select(F.concat_ws(":", sha, "id").alias("key"), "id", sha.alias("source_sha256"), F.lit("valido").alias("state"), "messages", "detections")


_K = "(CAST(id AS BIGINT) + idx) % 17 = 5 AND length(text) >= 4"
_JUDGE = f"""j AS (SELECT id, CASE WHEN bool_or(sender IS NULL OR trim(text) = '') THEN 'message' WHEN bool_or(idx <> pos OR ({_K})) THEN 'detection' END AS reason FROM ({_ORDERED}) GROUP BY id),
x AS (SELECT m.id, m.idx, m.sender, substr(m.text, 1, 4) AS text, ['PERSON', 'LOCATION', 'EMAIL'][m.idx % 3 + 1] AS type FROM ({fx.MESSAGES}) m JOIN j ON m.id = j.id WHERE j.reason IS NULL AND length(m.text) >= 4)"""


@query(f"""WITH {_JUDGE} SELECT sha256('conversations') || ':' || id AS key, id, reason FROM j WHERE reason IS NOT NULL""")
def excluded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exported(_records(spark, sf_dir)).excluded.select("key", "id", "reason")


@query(f"""WITH {_JUDGE} SELECT (SELECT count(*) FROM j) AS records, (SELECT count(*) FROM j WHERE reason IS NULL) AS exported, (SELECT count(*) FROM j WHERE reason IS NOT NULL) AS excluded,
  (SELECT count(*) FROM j WHERE reason IS NULL AND id NOT IN (SELECT id FROM x)) AS negative, (SELECT count(*) FROM x) AS detections,
  (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM x GROUP BY type)) AS categories, (SELECT string_agg(sender || '=' || n, ',' ORDER BY sender) FROM (SELECT sender, count(*) AS n FROM x GROUP BY sender)) AS roles""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return X.exported(_records(spark, sf_dir)).manifest.select("records", "exported", "excluded", "negative", "detections", show("categories"), show("roles"))


@query(f"""WITH {_JUDGE} SELECT sha256('conversations') || ':' || j.id AS id, coalesce(string_agg('conversazione.' || x.idx || '.testo:' || x.type || ':' || x.text, '|' ORDER BY 'conversazione.' || x.idx || '.testo'), '') AS spans
  FROM j LEFT JOIN (SELECT * FROM x WHERE type IN ('PERSON', 'LOCATION')) x ON j.id = x.id WHERE j.reason IS NULL GROUP BY j.id""")
def exported_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view for named entities: two types, negatives kept with an empty list."""
    rows = X.exported(_records(spark, sf_dir)).ner
    return rows.select("id", F.array_join(F.transform("annotazioni", lambda a: F.concat_ws(":", a["campo"], a["tipo"], a["testo"])), "|").alias("spans"))


# --- regular expressions ---------------------------------------------------------------------


@query(f"""SELECT doc_id, 'conversazione.0.testo' AS field, start, "end", type, value, rule, priority FROM ({STRICT_SQL})""")
def regex_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.spans(spark, sf_dir, fx.STRICT).select("doc_id", T.field_of(F.col("idx")).alias("field"), "start", "end", "type", "value", "rule", "priority")


@query(f"""SELECT type, rule, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({BOTH_SQL}) GROUP BY type, rule""")
def regex_detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.spans(spark, sf_dir, fx.STRICT + fx.LOOSE).groupBy("type", "rule").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(f"""SELECT d.doc_id, count(s.start) AS n, coalesce(CAST(sum(s."end" - s.start) AS BIGINT), 0) AS n_chars FROM ({fx.DOCS}) d LEFT JOIN ({STRICT_SQL}) s ON d.id = s.id GROUP BY d.doc_id""")
def detections_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.candidates(fx.docs(spark, sf_dir), fx.STRICT)
    return got.select("doc_id", F.size("found").cast("long").alias("n"), F.aggregate("found", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_chars"))


@query(f"""WITH g AS (SELECT id, doc_id, list({{'s': start, 'e': "end", 't': type, 'r': rule, 'p': priority}} ORDER BY -priority, start - "end", start, rule) AS l FROM ({BOTH_SQL}) GROUP BY id, doc_id),
r AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: k.s < y[1].e AND k.e > y[1].s)) > 0 THEN acc ELSE list_concat(acc, y) END) AS kept FROM g),
u AS (SELECT doc_id, unnest(kept) AS k FROM r)
SELECT doc_id, k.s AS start, k.e AS "end", k.t AS type, k.r AS rule FROM u""")
def greedy_resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resolved(fx.docs(spark, sf_dir).select("doc_id", "text"), fx.STRICT + fx.LOOSE).select("doc_id", "start", "end", "type", "rule")


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all rules, then those of the imperfect detector: many have a key in common."""
    rules = {r.name: i for i, r in enumerate([*fx.STRICT, *fx.LOOSE])} | {"tail": len(fx.STRICT) + len(fx.LOOSE)}
    ord_ = F.element_at(F.create_map(*[F.lit(x) for k, v in rules.items() for x in (k, v)]), F.col("rule"))
    one = lambda rows, name, first: rows.select("id", T.field_of(F.col("idx")).alias("field"), "start", "end", F.col("value").alias("text"), "type", F.array(F.struct(F.lit(name).alias("detector"), "rule", "priority")).alias("sources"), (ord_ + first).alias("ord"))
    return one(fx.spans(spark, sf_dir, fx.STRICT + fx.LOOSE), "regex", 0).union(one(fx.predicted(spark, sf_dir), "made", 100))


_RANK = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {i}" for i, r in enumerate(fx.STRICT + fx.LOOSE)) + " ELSE 99 END"
_DETECTED = f"""SELECT id, start, "end", type, value, 'regex/' || rule AS source, {_RANK} AS ord FROM ({BOTH_SQL}) UNION ALL SELECT id, start, "end", type, value, 'made/' || rule, 100 + {_RANK} FROM ({PRED_SQL})"""


@query(f"""SELECT id, 'conversazione.0.testo' AS field, start, "end", type, min_by(value, ord) AS text, count(*) AS n_sources, string_agg(source, ',' ORDER BY ord) AS rules,
  'det_' || substr(sha256('["' || id || '","conversazione.0.testo",' || start || ',' || "end" || ',"' || type || '"]'), 1, 16) AS detection_id
FROM ({_DETECTED}) GROUP BY id, start, "end", type""")
def merged_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.merged(_detections(spark, sf_dir))
    return got.select("id", "field", "start", "end", "type", "text", F.size("sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["detector"], s["rule"])), ",").alias("rules"), "detection_id")


@query(f"""SELECT id, start, "end", type, CASE WHEN start % 5 = 1 THEN 'offsets or text' WHEN start % 5 = 2 THEN 'type' ELSE 'source' END AS reason FROM ({STRICT_SQL}) WHERE start % 5 IN (1, 2, 3)""")
def invalid_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of which some get another text, an unknown type or no source."""
    rows = fx.spans(spark, sf_dir, fx.STRICT)
    m = F.col("start") % 5
    made = rows.select("id", T.field_of(F.col("idx")).alias("field"), "start", "end", F.when(m == 1, "?").otherwise(F.col("value")).alias("text"), "type", F.array(F.struct(F.when(m != 3, "regex").alias("detector"))).alias("sources"))
    bad = S.invalid_detections(made.withColumn("type", F.when(m == 2, "OTHER").otherwise(F.col("type"))), fx.docs(spark, sf_dir), M.TYPES)
    return bad.join(rows.select("id", "start", "end", F.col("type").alias("_t")), ["id", "start", "end"]).select("id", "start", "end", F.col("_t").alias("type"), "reason")


@query(f"""SELECT id, start, "end", prev_end FROM (SELECT id, start, "end", max("end") OVER (PARTITION BY id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM ({BOTH_SQL})) WHERE prev_end > start""")
def span_overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overlap_violations(fx.spans(spark, sf_dir, fx.STRICT + fx.LOOSE)).select("id", "start", "end", "prev_end")


@query(f"""SELECT a.id, a.start, a."end", a.rule, b.start AS b_start, b."end" AS b_end, b.rule AS b_rule FROM ({STRICT_SQL}) a JOIN ({LOOSE_SQL}) b ON a.id = b.id AND a.start < b."end" AND a."end" > b.start""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = fx.spans(spark, sf_dir, fx.STRICT), fx.spans(spark, sf_dir, fx.LOOSE)
    cols = ["id", "idx", "start", "end", "rule"]
    return S.overlap_pairs(a.select(*cols), b.select(*cols)).select("id", "start", "end", "rule", "b_start", "b_end", "b_rule")


# --- evaluation ------------------------------------------------------------------------------

_EVAL = f"""WITH d AS ({fx.DOCS}),
g AS (SELECT DISTINCT id, idx, start, "end" AS fin, type FROM ({STRICT_SQL})),
p AS (SELECT DISTINCT id, idx, start, "end" AS fin, type FROM ({PRED_SQL})),
c AS (SELECT coalesce(g.id, p.id) AS id, coalesce(g.idx, p.idx) AS idx, coalesce(g.start, p.start) AS start, coalesce(g.fin, p.fin) AS fin, coalesce(g.type, p.type) AS type,
  CASE WHEN g.id IS NOT NULL AND p.id IS NOT NULL THEN 'tp' WHEN p.id IS NOT NULL THEN 'fp' ELSE 'fn' END AS outcome
  FROM g FULL OUTER JOIN p ON g.id = p.id AND g.idx = p.idx AND g.start = p.start AND g.fin = p.fin AND g.type = p.type)"""
_COUNTS = "count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn"


def _evaluation(spark: SparkSession, sf_dir: str) -> E.Evaluation:
    gold, pred = fx.spans(spark, sf_dir, fx.STRICT).select(*E.SPAN), fx.predicted(spark, sf_dir).select(*E.SPAN)
    return E.evaluate(fx.docs(spark, sf_dir), gold, pred, fx.usable(spark, sf_dir), fx.TYPES + ("DATE",), fx.FOCUS)


@query(f"{_EVAL}, n AS (SELECT {_COUNTS} FROM c) SELECT tp, fp, fn, {SCORES_SQL} FROM n")
def exact_match_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).micro


@query(f"""{_EVAL}, n AS (SELECT t.type, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn
  FROM (SELECT unnest(['DATE', 'EMAIL', 'LOCATION', 'PASSWORD', 'PHONE']) AS type) t LEFT JOIN c ON t.type = c.type GROUP BY t.type) SELECT type, tp, fp, fn, {SCORES_SQL} FROM n""")
def exact_match_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).by_type


@query(f"""{_EVAL}, n AS (SELECT r.sender, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn
  FROM (SELECT unnest(['Utente', 'Agente']) AS sender) r LEFT JOIN (SELECT c.outcome, d.sender FROM c JOIN d ON c.id = d.id) x ON r.sender = x.sender GROUP BY r.sender) SELECT sender, tp, fp, fn, {SCORES_SQL} FROM n""")
def exact_match_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).by_role


@query(f"{_EVAL}, n AS (SELECT {_COUNTS} FROM c WHERE type IN ('EMAIL', 'PHONE')) SELECT tp, fp, fn, {SCORES_SQL} FROM n")
def exact_match_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).focus


@query(f"""{_EVAL} SELECT id, string_agg(CASE WHEN outcome = 'fp' THEN start || '-' || fin || ':' || type END, ' ' ORDER BY start, fin, type) AS fp,
  string_agg(CASE WHEN outcome = 'fn' THEN start || '-' || fin || ':' || type END, ' ' ORDER BY start, fin, type) AS fn FROM c WHERE outcome <> 'tp' GROUP BY id""")
def error_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda c: F.nullif(F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["type"])), " "), F.lit("")).alias(c)
    return _evaluation(spark, sf_dir).errors.select("id", show("fp"), show("fn"))


_CHARS = f"""{_EVAL}, s AS (SELECT id, CAST(sum(length(text)) AS BIGINT) AS total FROM d GROUP BY id),
gc AS (SELECT id, sum(fin - start) AS expected FROM g GROUP BY id), pc AS (SELECT id, sum(fin - start) AS predicted FROM p GROUP BY id),
b AS (SELECT g.id, sum(least(g.fin, p.fin) - greatest(g.start, p.start)) AS covered FROM g JOIN p ON g.id = p.id AND g.idx = p.idx AND g.start < p.fin AND g.fin > p.start GROUP BY g.id),
k AS (SELECT s.id, total, CAST(coalesce(expected, 0) AS BIGINT) AS expected, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted FROM s LEFT JOIN gc ON s.id = gc.id LEFT JOIN pc ON s.id = pc.id LEFT JOIN b ON s.id = b.id)"""


@query(f"""{_CHARS} SELECT CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(expected - covered) AS BIGINT) AS uncovered, CAST(sum(predicted - covered) AS BIGINT) AS overmasked,
  CAST(sum(total - expected) AS BIGINT) AS other, CAST(sum(covered) AS DOUBLE) / nullif(sum(expected), 0) AS coverage FROM k""")
def character_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).characters


@query(f"""{_CHARS} SELECT count(*) AS evaluated, count(*) FILTER (expected > covered) AS with_omissions, count(*) FILTER (expected > 0) AS with_expected, count(*) FILTER (expected = 0) AS negative,
  count(*) FILTER (expected = 0 AND predicted > 0) AS negative_with_fp FROM k""")
def conversation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).conversations


@query(f"""SELECT d.id, coalesce(o.state, 'mancante') AS state, o.error FROM ({fx.DOCS}) d LEFT JOIN ({fx.OUTCOMES}) o ON d.id = o.id WHERE o.state IS NULL OR o.state = 'errore'""")
def technical_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.technical_failures(fx.docs(spark, sf_dir), fx.outcomes(spark, sf_dir))


@query(f"""WITH g AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS id FROM labels), d AS (SELECT id FROM ({fx.DOCS}))
SELECT id, 'no gold' AS problem FROM d WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'gold without input' FROM g WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT id, 'prediction without input' FROM ({fx.OUTCOMES}) WHERE id NOT IN (SELECT id FROM d)""")
def id_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs are the documents, gold exists for labelled ones."""
    gold = fx.table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"))
    return E.id_problems(fx.docs(spark, sf_dir), gold, fx.outcomes(spark, sf_dir))


THRESHOLDS = (0.0, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
_SWEEP = f"""WITH g AS (SELECT DISTINCT id, idx, start, "end" AS fin, type FROM ({STRICT_SQL})),
p AS (SELECT id, idx, start, "end" AS fin, type, max({fx.pseudo_score_sql("id", "start", "rule")}) AS score FROM ({PRED_SQL}) GROUP BY ALL),
t AS (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in THRESHOLDS)}]) AS threshold),
f AS (SELECT g.id AS gid, p.id AS pid, p.score FROM g FULL OUTER JOIN p ON g.id = p.id AND g.idx = p.idx AND g.start = p.start AND g.fin = p.fin AND g.type = p.type),
n AS (SELECT threshold, count(*) FILTER (gid IS NOT NULL AND pid IS NOT NULL AND score >= threshold) AS tp, count(*) FILTER (gid IS NULL AND score >= threshold) AS fp,
  count(*) FILTER (gid IS NOT NULL AND (pid IS NULL OR score < threshold)) AS fn FROM f CROSS JOIN t GROUP BY threshold)
SELECT threshold, tp, fp, fn, {SCORES_SQL} FROM n"""


@query(_SWEEP)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.predicted(spark, sf_dir).withColumn("score", fx.pseudo_score("id", "start", "rule"))
    return E.threshold_sweep(fx.spans(spark, sf_dir, fx.STRICT), scored, THRESHOLDS)


@query(f"""{_EVAL} SELECT value, count(*) AS n FROM c JOIN (SELECT DISTINCT id, idx, start, "end" AS fin, type, value FROM ({PRED_SQL})) v
  ON c.id = v.id AND c.idx = v.idx AND c.start = v.start AND c.fin = v.fin AND c.type = v.type WHERE outcome = 'fp' GROUP BY value ORDER BY n DESC, value LIMIT 20""")
def top_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fx.predicted(spark, sf_dir).select(*E.SPAN, "value").distinct()
    return E.frequent_false_positives(_evaluation(spark, sf_dir).spans, values, 20)


# --- native entities -------------------------------------------------------------------------

_LABELS = {"mail_loose": "EMAIL", "ip_loose": "LOCATION", "token_loose": None, "phone_loose": "PHONE"}
MODEL = N.Model("fixture", _LABELS, 0.3, ("LOCATION", "EMAIL"), (("phone_loose", "mail_loose"),))


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose matches as a model's entities, with the character before them, as tokenisers give it."""
    rows = fx.spans(spark, sf_dir, fx.LOOSE)
    w = Window.partitionBy("id", "idx").orderBy("start", "end", "rule")
    return rows.select("id", "idx", (F.row_number().over(w) - 1).alias("ord"), F.col("rule").alias("label"), F.greatest(F.col("start") - 1, F.lit(0)).alias("start"), "end", fx.pseudo_score("id", "start", "rule").alias("score"))


_NATIVE = f"""SELECT s.id, s.rule AS label, greatest(s.start - 1, 0) AS start, s."end" AS fin, d.text, {fx.pseudo_score_sql("s.id", "s.start", "s.rule")} AS score FROM ({LOOSE_SQL}) s JOIN ({fx.DOCS}) d ON s.id = d.id"""
_JUDGED = f"""SELECT id, label, score, start + length(own) - length(ltrim(own, ' ' || chr(9) || chr(13) || chr(10) || ',;:')) AS start, fin - (length(own) - length(rtrim(own, ' ' || chr(9) || chr(13) || chr(10) || ',;:'))) AS fin,
  CASE label WHEN 'mail_loose' THEN 'EMAIL' WHEN 'ip_loose' THEN 'LOCATION' WHEN 'phone_loose' THEN 'PHONE' END AS type FROM (SELECT *, substr(text, start + 1, fin - start) AS own FROM ({_NATIVE}))"""


@query(f"""SELECT id, label, CAST(start AS INTEGER) AS start, CAST(fin AS INTEGER) AS "end", type, CASE WHEN type IS NULL THEN 'ignored' WHEN score < 0.3 THEN 'below' ELSE 'kept' END AS fate FROM ({_JUDGED})""")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.judged(_native(spark, sf_dir), fx.docs(spark, sf_dir), MODEL).select("id", "label", "start", "end", "type", "fate")


@query(f"""SELECT label, count(*) AS n FROM ({_JUDGED}) WHERE type IS NULL GROUP BY label""")
def ignored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.ignored_labels(N.judged(_native(spark, sf_dir), fx.docs(spark, sf_dir), MODEL))


@query(f"""SELECT id, 'conversazione.0.testo' AS field, CAST(start AS INTEGER) AS start, CAST(fin AS INTEGER) AS "end", type, label AS native_type FROM ({_JUDGED}) WHERE type IS NOT NULL AND score >= 0.3""")
def native_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = N.detections(N.judged(_native(spark, sf_dir), fx.docs(spark, sf_dir), MODEL), MODEL)
    return got.select("id", "field", "start", "end", "type", F.col("sources")[0]["native_type"].alias("native_type"))


@query(f"""WITH j AS (SELECT id, label, CAST(start AS INTEGER) AS s, CAST(fin AS INTEGER) AS e, type AS t, score FROM ({_JUDGED}) WHERE type IS NOT NULL AND score >= 0.3),
g AS (SELECT id, list({{'s': s, 'e': e, 't': t, 'x': score, 'n': label}} ORDER BY -score, s - e, s, t) AS l FROM j GROUP BY id),
r AS (SELECT id, list_reduce(list_transform(l, lambda v: [v]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: k.s < y[1].e AND k.e > y[1].s)) > 0 THEN acc ELSE list_concat(acc, y) END) AS kept FROM g),
u AS (SELECT id, unnest(kept) AS k FROM r), o AS (SELECT u.id, k.s AS s, k.e AS e, k.t AS t, k.n AS n, d.text, lag(k.e) OVER w AS pe, lag(k.t) OVER w AS pt, lag(k.n) OVER w AS pn FROM u JOIN ({fx.DOCS}) d ON u.id = d.id WINDOW w AS (PARTITION BY u.id ORDER BY k.s)),
b AS (SELECT *, CASE WHEN pt = t AND (t IN ('LOCATION', 'EMAIL') OR (pn = 'phone_loose' AND n = 'mail_loose')) AND regexp_full_match(substr(text, pe + 1, s - pe), '[\\s,]*') THEN 0 ELSE 1 END AS brk FROM o),
i AS (SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY s) AS island FROM b)
SELECT id, min(s) AS start, max(e) AS "end", any_value(t) AS type, substr(any_value(text), min(s) + 1, max(e) - min(s)) AS text FROM i GROUP BY id, island""")
def normalised_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fx.docs(spark, sf_dir)
    return N.normalised(N.judged(_native(spark, sf_dir), messages, MODEL), messages, MODEL).select("id", "start", "end", "type", "text")


@query(r"""WITH w AS (SELECT doc_id, t, i, t[i] AS value FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents))),
o AS (SELECT doc_id, value, sum(length(value) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS fin FROM w),
k AS (SELECT doc_id, CAST(fin - length(value) AS INTEGER) AS start, CAST(fin AS INTEGER) AS fin, CASE WHEN regexp_matches(value, '^[A-ZÀ-Ý]') THEN 'PERSON' ELSE 'OTHER' END AS type FROM o WHERE value <> ''),
b AS (SELECT *, CASE WHEN lag(type) OVER x = type AND type = 'PERSON' AND start - lag(fin) OVER x <= 1 THEN 0 ELSE 1 END AS brk FROM k WINDOW x AS (PARTITION BY doc_id ORDER BY start)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM b)
SELECT doc_id, min(start) AS start, max(fin) AS "end", CAST(max(fin) - min(start) AS INTEGER) AS n_chars FROM s WHERE type = 'PERSON' GROUP BY doc_id, island""")
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised words, one space apart, merged as neighbours of one type."""
    messages = fx.docs(spark, sf_dir)
    found = M.candidates(messages.select("doc_id", "text"), [M.Rule("capital", "PERSON", 1, "(?<![^ ])(?P<valore>[A-ZÀ-Ý][^ ]*)", "")])
    tokens = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["type"].alias("type"), F.lit(1.0).alias("score"), m["type"].alias("native")))
    merged = found.select("doc_id", F.explode_outer(S.adjacent_runs(tokens, F.col("text"), ("PERSON",))).alias("m")).where("m.type = 'PERSON'")
    return merged.select("doc_id", "m.start", "m.end", F.length("m.text").alias("n_chars"))


# --- addresses -------------------------------------------------------------------------------


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road address for each customer: nation as the road's name, region as the municipality."""
    n, r = fx.table(spark, sf_dir, "nation"), fx.table(spark, sf_dir, "region")
    c = fx.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    number = F.when(k % 6 != 2, (k % 300 + 1).cast("string"))
    city = F.when(k % 6 != 3, F.col("r_name"))
    at_number = F.length("n_name") + 5
    at_city = F.lit(4) + F.length("n_name") + F.coalesce(F.length(number) + 1, F.lit(0)) + 2
    text = F.concat(F.lit("Via "), F.col("n_name"), F.coalesce(F.concat(F.lit(" "), number), F.lit("")), F.coalesce(F.concat(F.lit(", "), city), F.lit("")))
    part = lambda name, s, e, v: F.struct(F.lit(name).alias("key"), F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), v.alias("text")).alias("value"))
    entries = F.array(
        part("street_type", F.lit(0), F.lit(3), F.lit("Via")),
        part("street_name", F.lit(4), F.lit(4) + F.length("n_name"), F.col("n_name")),
        part("house_number", at_number, at_number + F.length(number), number),
        part("municipality", at_city, at_city + F.length(city), city),
    )
    components = F.map_from_entries(F.filter(entries, lambda e: e["value"]["text"].isNotNull()))
    return c.select(k.cast("string").alias("id"), F.lit("conversazione.0.testo").alias("field"), F.concat(F.lit("a"), k.cast("string")).alias("address_id"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"), components.alias("components"), k.alias("key"), F.length("n_name").alias("ln"))


def _locations(addresses: DataFrame) -> DataFrame:
    """What a detector found: by key modulo 5 all, all but the municipality, the municipality, nothing, all but the number."""
    city = F.col("components")["municipality"]
    street_end = F.coalesce(city["start"] - 2, F.col("end"))
    span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
    own = F.when(city.isNotNull(), span(city["start"], city["end"]))
    m = F.col("key") % 5
    found = F.when(m == 0, F.array(span(F.lit(0), F.col("end")))).when(m == 1, F.array(span(F.lit(0), street_end))).when(m == 2, F.array(own)).when(m == 4, F.array(span(F.lit(0), 4 + F.col("ln")), own))
    return addresses.select("id", "field", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s")).select("id", "field", "s.start", "s.end")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _addresses(spark, sf_dir)
    return A.measured(rows.withColumn("parts", A.structured()), _locations(rows))


_ADDRESS = """WITH a AS (SELECT c_custkey AS k, n_name AS n, CASE WHEN c_custkey % 6 <> 2 THEN CAST(c_custkey % 300 + 1 AS VARCHAR) END AS h, CASE WHEN c_custkey % 6 <> 3 THEN r_name END AS r
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT k, n, h, r, 'Via ' || n || coalesce(' ' || h, '') || coalesce(', ' || r, '') AS text, 4 + length(n) AS street_end, 4 + length(n) + coalesce(length(h) + 1, 0) AS line_end FROM a),
q AS (SELECT k, n, h, r, text, street_end, line_end, unnest(range(0, length(text))) AS i FROM b),
x AS (SELECT k, n, h, r, text, i, substr(text, i + 1, 1) AS ch,
  CASE WHEN i < street_end THEN 'street' WHEN i < line_end THEN 'house_number' ELSE 'municipality' END AS part,
  CASE k % 5 WHEN 0 THEN true WHEN 1 THEN i < line_end WHEN 2 THEN i >= line_end WHEN 3 THEN false ELSE i < street_end OR i >= line_end END AS hit FROM q),
s AS (SELECT * FROM x WHERE regexp_matches(ch, '[A-Za-z0-9]')),
t AS (SELECT k, any_value(text) AS text, count(*) AS expected, count(*) FILTER (hit) AS covered, coalesce(string_agg(CASE WHEN NOT hit THEN ch END, '' ORDER BY i), '') AS residual_text,
  bool_and(hit) FILTER (part = 'street') AS st, bool_and(hit) FILTER (part = 'house_number') AS hn, bool_and(hit) FILTER (part = 'municipality') AS mu, bool_or(hit) FILTER (part <> 'municipality') AS beyond, bool_or(hit) AS touched FROM s GROUP BY k),
o AS (SELECT *, CASE WHEN covered = expected THEN 'complete' WHEN hn IS NOT NULL AND NOT hn AND st AND coalesce(mu, true) THEN 'house_number_exposed' WHEN mu IS NOT NULL AND NOT mu AND st AND coalesce(hn, true) THEN 'municipality_exposed'
  WHEN coalesce(mu, false) AND NOT st AND NOT beyond THEN 'municipality_only' WHEN NOT touched THEN 'uncovered' ELSE 'partial_other' END AS outcome FROM t)"""


@query(f"{_ADDRESS} SELECT CAST(k AS VARCHAR) AS id, text, CAST(expected AS INTEGER) AS expected, CAST(covered AS INTEGER) AS covered, CAST(covered AS DOUBLE) / expected AS coverage, residual_text, outcome FROM o")
def address_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("id", "text", "expected", "covered", "coverage", "residual_text", "outcome")


@query(f"{_ADDRESS} SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def coverage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.outcome_histogram(_measured(spark, sf_dir))


@query(f"""{_ADDRESS} SELECT count(*) AS total, count(*) FILTER (covered = expected) AS complete, CAST(count(*) FILTER (covered = expected) AS DOUBLE) / count(*) AS complete_rate,
  CAST(sum(covered) AS DOUBLE) / sum(expected) AS character_coverage, round(1 - CAST(sum(covered) AS DOUBLE) / sum(expected), 9) AS residual_exposure FROM o""")
def address_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.address_totals(_measured(spark, sf_dir)), "residual_exposure")


@query(f"""{_ADDRESS}, pk AS (SELECT k, part, count(*) AS e, count(*) FILTER (hit) AS c FROM s GROUP BY k, part)
SELECT z.name, count(*) FILTER (e = c) AS complete, count(e) AS total, CAST(count(*) FILTER (e = c) AS DOUBLE) / nullif(count(e), 0) AS complete_rate, CAST(sum(c) AS DOUBLE) / nullif(sum(e), 0) AS character_coverage
FROM (SELECT unnest(['street', 'house_number', 'internal', 'municipality']) AS name) z LEFT JOIN pk ON z.name = pk.part GROUP BY z.name""")
def component_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.component_totals(_measured(spark, sf_dir))


@query(f"""{_ADDRESS} SELECT CAST(k AS VARCHAR) AS id, 0 AS start, CAST(line_end AS INTEGER) AS "end", 'street_civic' AS component, substr(text, 1, line_end) AS text FROM b WHERE r IS NOT NULL
UNION ALL SELECT CAST(k AS VARCHAR), CAST(line_end + 2 AS INTEGER), CAST(length(text) AS INTEGER), 'municipality', r FROM b WHERE r IS NOT NULL""")
def address_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested locations by the last comma and the catalogue, as for addresses without components."""
    rows = _addresses(spark, sf_dir)
    plain = rows.withColumn("components", F.lit(None).cast(rows.schema["components"].dataType))
    towns = fx.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    known = spark.createDataFrame([], "id string, field string, start int, end int, type string")
    return A.expanded(plain, known, towns).select("id", "start", "end", "component", "text")


@query(f"""{_ADDRESS} SELECT CAST(k AS VARCHAR) AS id, text FROM b WHERE r IS NULL""")
def unresolved_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _addresses(spark, sf_dir)
    plain = rows.withColumn("components", F.lit(None).cast(rows.schema["components"].dataType))
    return A.unresolved(plain, fx.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))).select("id", "text")


# --- bootstrap -------------------------------------------------------------------------------

# The number of replicates is the reference's default.
REPLICATES, SEED = 10_000, 7
_BOOT_STRICT = [M.Rule("mail", "PERSON", 1, fx.STRICT[0].pattern, ""), M.Rule("ip", "LOCATION", 1, fx.STRICT[1].pattern, "")]
_BOOT = {"loose": [M.Rule("mail", "PERSON", 1, fx.LOOSE[0].pattern, ""), M.Rule("ip", "LOCATION", 1, fx.LOOSE[1].pattern, "")], "mail_only": [M.Rule("mail", "PERSON", 1, fx.STRICT[0].pattern, "")]}


def _boot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = fx.spans(spark, sf_dir, _BOOT_STRICT).select(*E.SPAN)
    ids = fx.docs(spark, sf_dir).select("id")
    found = conversations = None
    for name, rules in _BOOT.items():
        one = E.compared(gold, fx.spans(spark, sf_dir, rules).select(*E.SPAN)).withColumn("model", F.lit(name))
        own = ids.withColumn("model", F.lit(name))
        found = one if found is None else found.union(one)
        conversations = own if conversations is None else conversations.union(own)
    # an address for every third text, of which a detector covers what its length leaves over
    size = F.length("text")
    models = F.explode(F.array(*map(F.lit, _BOOT))).alias("model")
    covered = F.when(F.col("model") == "loose", size % 21).otherwise(size % 13).cast("int")
    addresses = fx.docs(spark, sf_dir).where(F.col("doc_id") % 3 == 0).select(models, "id", "text")
    addresses = addresses.select("model", "id", F.lit(20).alias("expected"), covered.alias("covered"), (covered == 20).alias("complete"))
    counters = R.units(conversations, found, addresses).persist()  # counted, collected and summed
    return R.replicated(counters, REPLICATES, SEED), R.point_estimates(counters)


def _mixed_sql(inner: str, out: str, keep: str) -> str:
    """``inner`` with its column x, below 2^32, mixed as ``out``."""
    one = f"SELECT {keep}, (xor(x, x >> 16) * {0x7FEB352D}) & 4294967295 AS x FROM ({inner})"
    two = f"SELECT {keep}, (xor(x, x >> 15) * {0x846CA68B}) & 4294967295 AS x FROM ({one})"
    return f"SELECT {keep}, xor(x, x >> 16) AS {out} FROM ({two})"


def _boot_sql() -> str:
    parts = []
    gold = fx.spans_sql(_BOOT_STRICT)
    for name, rules in _BOOT.items():
        parts.append(f"""SELECT '{name}' AS model, coalesce(g.id, p.id) AS id, coalesce(g.type, p.type) AS type, CASE WHEN g.id IS NOT NULL AND p.id IS NOT NULL THEN 'tp' WHEN p.id IS NOT NULL THEN 'fp' ELSE 'fn' END AS o
FROM (SELECT DISTINCT id, start, "end" AS fin, type FROM ({gold})) g FULL OUTER JOIN (SELECT DISTINCT id, start, "end" AS fin, type FROM ({fx.spans_sql(rules)})) p ON g.id = p.id AND g.start = p.start AND g.fin = p.fin AND g.type = p.type""")
    keys = _mixed_sql(f"SELECT r, CAST(r + {SEED} AS UBIGINT) AS x FROM (SELECT unnest(range(0, {REPLICATES})) AS r)", "k", "r")
    draws = _mixed_sql(f"SELECT r, d, (k + CAST(d AS UBIGINT)) & 4294967295 AS x FROM ({keys}) a, (SELECT unnest(range(0, (SELECT n FROM n))) AS d) b", "h", "r, d")
    scopes = {"micro": "true", "PERSON": "type = 'PERSON'", "LOCATION": "type = 'LOCATION'"}
    counts = ", ".join(f"count(*) FILTER (o = '{o}' AND {c}) AS {s}_{o}" for s, c in scopes.items() for o in ("tp", "fp", "fn"))
    sums = ", ".join(f"CAST(sum(w * coalesce({s}_{o}, 0)) AS DOUBLE) AS {s}_{o}" for s in scopes for o in ("tp", "fp", "fn"))
    sums += "".join(f", CAST(sum(w * coalesce({c}, 0)) AS DOUBLE) AS {c}" for c in R.COUNTERS[9:])
    rows = " UNION ALL ".join(
        f"SELECT model, rep, '{s}.{m}' AS metric, {e} AS value FROM s"
        for s in scopes
        for m, e in (("precision", f"{s}_tp / nullif({s}_tp + {s}_fp, 0)"), ("recall", f"{s}_tp / nullif({s}_tp + {s}_fn, 0)"), ("f1", f"2 * {s}_tp / nullif(2 * {s}_tp + {s}_fp + {s}_fn, 0)"))
    )
    rows += " UNION ALL SELECT model, rep, 'address.complete_rate', a_complete / nullif(a_total, 0) FROM s UNION ALL SELECT model, rep, 'address.character_coverage', a_covered / nullif(a_expected, 0) FROM s"
    address = " UNION ALL ".join(f"""SELECT '{m}' AS model, id, 1 AS a_total, CASE WHEN length(text) % {k} = 20 THEN 1 ELSE 0 END AS a_complete, 20 AS a_expected, length(text) % {k} AS a_covered FROM ({fx.DOCS}) WHERE doc_id % 3 = 0""" for m, k in (("loose", 21), ("mail_only", 13)))
    return f"""WITH ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM ({fx.DOCS})), n AS (SELECT count(*) AS n FROM ids),
c AS ({" UNION ALL ".join(parts)}), u AS (SELECT model, id, {counts} FROM c GROUP BY model, id),
ad AS ({address}), dr AS (SELECT r AS rep, CAST(h % (SELECT n FROM n) AS BIGINT) AS pos FROM ({draws})),
w AS (SELECT rep, pos, count(*) AS w FROM dr GROUP BY rep, pos UNION ALL SELECT -1, pos, 1 FROM ids),
s AS (SELECT m.model, w.rep, {sums} FROM w JOIN ids ON w.pos = ids.pos CROSS JOIN (SELECT unnest(['loose', 'mail_only']) AS model) m LEFT JOIN u ON u.id = ids.id AND u.model = m.model LEFT JOIN ad ON ad.id = ids.id AND ad.model = m.model GROUP BY m.model, w.rep),
v AS ({rows})"""


@query(f"""{_boot_sql()}, e AS (SELECT model, metric, value AS estimate FROM v WHERE rep = -1)
SELECT v.model, v.metric, round(any_value(e.estimate), 6) AS estimate, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance, round(quantile_cont(value, 0.025), 6) AS ci_lower, round(quantile_cont(value, 0.975), 6) AS ci_upper, count(value) AS replicates_valid
FROM v JOIN e ON v.model = e.model AND v.metric = e.metric WHERE rep >= 0 AND value IS NOT NULL GROUP BY v.model, v.metric""")
def bootstrap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.summary(*_boot(spark, sf_dir), ["model", "metric"])
    return rounded(got, "estimate", "mean", "variance", "ci_lower", "ci_upper", digits=6).select("model", "metric", "estimate", "mean", "variance", "ci_lower", "ci_upper", "replicates_valid")


@query(f"""{_boot_sql()}, p AS (SELECT a.metric, a.rep, a.value - b.value AS d FROM v a JOIN v b ON a.metric = b.metric AND a.rep = b.rep AND a.model = 'loose' AND b.model = 'mail_only' WHERE a.metric IN ('micro.f1', 'PERSON.f1', 'LOCATION.f1', 'address.complete_rate', 'address.character_coverage'))
SELECT 'loose' AS first, 'mail_only' AS second, metric, round(max(d) FILTER (rep = -1), 6) AS estimate, round(avg(d) FILTER (rep >= 0), 6) AS mean, round(quantile_cont(d, 0.025) FILTER (rep >= 0), 6) AS ci_lower, round(quantile_cont(d, 0.975) FILTER (rep >= 0), 6) AS ci_upper, count(d) FILTER (rep >= 0) AS replicates_valid
FROM p GROUP BY metric HAVING count(d) FILTER (rep >= 0) > 0""")
def bootstrap_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.differences(*_boot(spark, sf_dir), list(_BOOT))
    return rounded(got, "estimate", "mean", "ci_lower", "ci_upper", digits=6).select("first", "second", "metric", "estimate", "mean", "ci_lower", "ci_upper", "replicates_valid")


# --- lineage, reuse, catalogues --------------------------------------------------------------


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events").withColumn("usable", F.col("event_type") == "purchase")
    return X.latest(rows, ["user_id"], "event_id", "usable").select("user_id", "event_id", "event_type")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as prompts; finished orders as stored answers with the same parameters."""
    prompts = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("m").alias("deployment"))
    answers = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("id"), F.lit("m").alias("deployment"), F.lit("valido").alias("state"), F.lit("x").alias("answer"))
    return X.reusable(prompts, answers, ["deployment"])[1].select("id")


@query("""SELECT c_nationkey, count(DISTINCT c_mktsegment) AS variants FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1""")
def fd_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velaspan.sources.tables import dependency_conflicts

    return dependency_conflicts(fx.table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_mktsegment"])


@query("""SELECT doc_id, sha256(text) AS source_sha256, sha256(text) || ':' || CAST(doc_id AS VARCHAR) AS key, count(*) OVER (PARTITION BY text) AS copies FROM documents""")
def source_hash_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.col("text").cast("binary"), 256)
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", sha.alias("source_sha256")).withColumn("key", F.concat_ws(":", "source_sha256", F.col("doc_id").cast("string")))
    copies = rows.groupBy("source_sha256").agg(F.count("*").alias("copies"))
    return rows.join(copies, "source_sha256").select("doc_id", "source_sha256", "key", "copies")


@query("""SELECT count(*) AS prompts, (SELECT count(*) FROM orders) AS answers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS valido, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS da_verificare, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS errore_api FROM customer""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "valido").when(F.col("o_orderstatus") == "O", "da_verificare").when(F.col("o_orderstatus") == "P", "errore_api")
    return X.run_summary(fx.table(spark, sf_dir, "customer"), fx.table(spark, sf_dir, "orders").select(state.alias("state")))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents""")
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("cleaned"))


@query("""SELECT id, CASE WHEN regexp_matches(field, '^conversazione\\.([0-9]+)\\.testo$') THEN CAST(regexp_extract(field, '^conversazione\\.([0-9]+)\\.testo$', 1) AS INTEGER) END AS idx
FROM (SELECT conv_id AS id, CASE WHEN turn % 3 = 0 THEN 'metadati.descrizione' ELSE 'conversazione.' || turn || '.testo' END AS field FROM conversations)""")
def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "conversations")
    field = F.when(F.col("turn") % 3 == 0, "metadati.descrizione").otherwise(T.field_of(F.col("turn")))
    return rows.select(F.col("conv_id").alias("id"), T.message_index(field).alias("idx"))


# --- slots, literals, generation -------------------------------------------------------------


def _slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    slot = lambda s, v, t: F.struct(F.lit(s).alias("slot"), v.alias("value"), F.lit(t).alias("type"), F.lit(s.strip("{}")).alias("entity_id"))
    entities = F.array(slot("{{NAME}}", F.col("c_name"), "PERSON"), slot("{{CODE}}", F.concat(F.lit("P0"), k.cast("string")), "COD_UTENTE"))
    text = F.when(k % 7 == 0, "No {{WHO}} here").when(k % 3 == 0, "{{CODE}}: {{NAME}} is {{NAME}}").otherwise("Dear {{NAME}}, your code is {{CODE}}.")
    return fx.table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), text.alias("text"), entities.alias("entities"))


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n, 'P0' || c_custkey AS p FROM customer)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 7 = 0 THEN 'No {{WHO}} here' WHEN k % 3 = 0 THEN p || ': ' || n || ' is ' || n ELSE 'Dear ' || n || ', your code is ' || p || '.' END AS text,
CASE WHEN k % 7 = 0 THEN '' WHEN k % 3 = 0 THEN '0-' || length(p) || ' ' || (length(p) + 2) || '-' || (length(p) + 2 + length(n)) || ' ' || (length(p) + 6 + length(n)) || '-' || (length(p) + 6 + 2 * length(n))
  ELSE '5-' || (5 + length(n)) || ' ' || (20 + length(n)) || '-' || (20 + length(n) + length(p)) END AS spans,
CASE WHEN k % 7 = 0 THEN 'unknown slot {{WHO}}' END AS error FROM c""")
def slot_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _slotted(spark, sf_dir).withColumn("r", S.substituted("text", "entities"))
    show = F.array_join(F.transform("r.spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return got.select("id", F.col("r.text").alias("text"), show.alias("spans"), F.col("r.error").alias("error"))


@query("""WITH p AS (SELECT doc_id, string_split(text, 'the') AS pc FROM documents WHERE contains(text, 'the')), u AS (SELECT doc_id, pc, unnest(range(1, len(pc))) AS i FROM p)
SELECT doc_id, CAST(list_sum(list_transform(pc[1:i], lambda x: length(x))) + 3 * (i - 1) AS INTEGER) AS start FROM u""")
def literal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").withColumn("needle", F.lit("the"))
    return rows.select("doc_id", F.explode(S.literal_spans("text", "needle")).alias("s")).select("doc_id", "s.start")


PLAN = {
    "versione": "1",
    "totale": 0,
    "batch": [
        {"id": "core", "per_scenario_modalita": 3, "scenari": "all", "modalita": list(G.MODES)},
        {"id": "focus", "per_scenario_modalita": 8, "scenari": ["nation_0", "nation_1"], "modalita": [G.MODES[0]], "entita_obbligatorie": ["indirizzo_1"], "varianti_indirizzo": list(G.VARIANTS)},
    ],
}


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    names = F.filter(F.array(F.when(key % 5 != 4, F.lit("persona_1")), F.when(key % 2 == 0, F.lit("email_1"))), lambda x: x.isNotNull())
    return fx.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation_"), key.cast("string")).alias("scenario"), names.alias("entities"), (key % 3 == 0).alias("all"))


@query(f"""WITH s AS (SELECT n_nationkey AS k, 'nation_' || n_nationkey AS scenario, (n_nationkey % 5 <> 4 OR n_nationkey % 2 = 0) AS has FROM nation),
b AS (SELECT 'core' AS batch, 3 AS quota, ['{G.MODES[0]}', '{G.MODES[1]}'] AS modes, false AS few UNION ALL SELECT 'focus', 8, ['{G.MODES[0]}'], true),
g AS (SELECT batch, scenario, has, quota, few, unnest(modes) AS mode FROM b CROSS JOIN s WHERE NOT few OR k IN (0, 1)),
r AS (SELECT batch, scenario, mode, few, unnest(range(0, quota)) AS number FROM g WHERE has OR mode <> '{G.MODES[0]}')
SELECT batch || '-' || scenario || '-' || mode || '-' || lpad(CAST(number + 1 AS VARCHAR), 4, '0') AS id, batch, scenario, mode, CAST(number AS INTEGER) AS number,
  CASE WHEN few THEN [{", ".join(f"'{v}'" for v in G.VARIANTS)}][CAST(number % 6 + 1 AS INTEGER)] END AS address_variant FROM r""")
def stratified_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plan_rows(spark, PLAN, _scenarios(spark, sf_dir), SEED).select("id", "batch", "scenario", "mode", "number", "address_variant")


def _draw_sql(*parts: str) -> str:
    return "CAST('0x' || substr(sha256(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8) AS BIGINT)"


@query(f"""WITH s AS (SELECT n_nationkey AS k, 'nation_' || n_nationkey AS scenario, list_concat(CASE WHEN n_nationkey % 5 <> 4 THEN ['persona_1'] ELSE [] END, CASE WHEN n_nationkey % 2 = 0 THEN ['email_1'] ELSE [] END) AS own FROM nation),
b AS (SELECT 'core' AS batch, 3 AS quota, {SEED} AS seed, ['{G.MODES[0]}', '{G.MODES[1]}'] AS modes, false AS few, CAST([] AS VARCHAR[]) AS must UNION ALL SELECT 'focus', 8, {SEED + 1}, ['{G.MODES[0]}'], true, ['indirizzo_1']),
g AS (SELECT batch, scenario, own, k, quota, seed, must, unnest(modes) AS mode FROM b CROSS JOIN s WHERE NOT few OR k IN (0, 1)),
r AS (SELECT batch || '-' || scenario || '-' || mode || '-' || lpad(CAST(n + 1 AS VARCHAR), 4, '0') AS id, own, k, seed, must, mode FROM (SELECT *, unnest(range(0, quota)) AS n FROM g) WHERE len(own) > 0 OR mode <> '{G.MODES[0]}'),
e AS (SELECT id, k, seed, must, mode, own, unnest(own) AS one FROM r WHERE mode = '{G.MODES[0]}'),
p AS (SELECT id, any_value(must) AS must, CASE WHEN any_value(k) % 3 = 0 THEN any_value(own) ELSE list(one ORDER BY {_draw_sql("seed", "id", "one")}, one)[1:CAST(1 + any_value({_draw_sql("seed", "id", "'size'")}) % any_value(len(own)) AS INTEGER)] END AS kept FROM e GROUP BY id)
SELECT r.id, coalesce(array_to_string(list_sort(list_distinct(list_concat(p.kept, p.must))), ','), '') AS entities FROM r LEFT JOIN p ON r.id = p.id""")
def sampled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plan_rows(spark, PLAN, _scenarios(spark, sf_dir), SEED).select("id", F.array_join("entities", ",").alias("entities"))


RULES = {"NUM_PRATICA": {"cifre": 7, "separatore": "/", "anni": ["25", "26"]}, "PHONE": {"prefissi": ["", "+39 "], "inizio": "3", "cifre": 9, "separatori": ["", " ", "."]}}


@query(f"""SELECT c_custkey, {" || ".join(f"({_draw_sql(SEED, 'c_custkey', repr('d'), repr(str(i)))} % 10)" for i in range(7))} || '/' || ['25', '26'][CAST({_draw_sql(SEED, "c_custkey", "'y'")} % 2 + 1 AS INTEGER)] AS case_number FROM customer""")
def value_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select("c_custkey", G.value_code("NUM_PRATICA", RULES, str(SEED), F.col("c_custkey")).alias("case_number"))


@query(f"""WITH a AS (SELECT c_custkey AS k, n_name AS n, r_name AS r, CAST({_draw_sql(SEED, "c_custkey", "'number'")} % 300 + 1 AS VARCHAR) AS h, [{", ".join(f"'{v}'" for v in G.VARIANTS[:4])}][CAST(c_custkey % 4 + 1 AS INTEGER)] AS v
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT k AS c_custkey, v AS variant, CASE WHEN v = 'without_street_type' THEN '' ELSE 'Via ' END || n || CASE WHEN v = 'without_house_number' THEN '' ELSE ' ' || h END || CASE WHEN v = 'without_municipality' THEN '' ELSE ', ' || r END AS value,
  CAST(CASE WHEN v = 'without_street_type' THEN 0 ELSE 4 END AS INTEGER) AS name_start FROM a""")
def composed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = fx.table(spark, sf_dir, "nation"), fx.table(spark, sf_dir, "region")
    c = fx.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    variant = F.get(F.array(*map(F.lit, G.VARIANTS[:4])), (F.col("c_custkey") % 4).cast("int"))
    got = c.select("c_custkey", variant.alias("variant"), G.composed_address(F.concat(F.lit("Via "), F.col("n_name")), F.col("r_name"), variant, str(SEED), F.col("c_custkey")).alias("a"))
    return got.select("c_custkey", "variant", F.col("a.value").alias("value"), F.col("a.components")["street_name"]["start"].alias("name_start"))


# --- validation of chats ---------------------------------------------------------------------


@query(f"""WITH m AS ({_ORDERED}), x AS (SELECT id, min(pos) FILTER (sender = 'Utente' AND contains(text, 'the')) AS u, min(pos) FILTER (sender = 'Agente' AND contains(text, 'the')) AS a FROM m GROUP BY id)
SELECT id, CASE WHEN u IS NULL OR a IS NULL THEN 'the: missing' WHEN a < u THEN 'the: agent first' ELSE '' END AS signals FROM x""")
def slot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).withColumn("repeat", F.array(F.lit("the")))
    return rows.select("id", F.array_join(V.coverage_signals(), "; ").alias("signals"))


@query(f"""WITH m AS ({_ORDERED}), n AS (SELECT *, lead(sender) OVER w AS s2, lead(text) OVER w AS t2 FROM (SELECT id, pos, sender, CASE WHEN pos % 4 = 1 THEN ' ' ELSE text END AS text FROM (SELECT id, pos, CASE WHEN pos % 4 = 2 THEN lag(sender) OVER (PARTITION BY id ORDER BY pos) ELSE sender END AS sender, text FROM m)) WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, count(*) AS before, count(*) FILTER (NOT (trim(text) = '' AND coalesce(s2 = sender, false) AND trim(coalesce(t2, '')) <> '')) AS after FROM n GROUP BY id""")
def blank_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth message is blanked and the next one given its sender; the blank ones are then redundant."""
    rows = _conversations(spark, sf_dir)
    m = F.col("messages")
    broken = F.transform("messages", lambda x, i: F.struct(F.when(i % 4 == 2, F.get(m, i - 1)["sender"]).otherwise(x["sender"]).alias("sender"), F.when(i % 4 == 1, F.lit(" ")).otherwise(x["text"]).alias("text")))
    rows = rows.withColumn("messages", broken)
    return rows.select("id", F.size("messages").cast("long").alias("before"), F.size(V.repaired()).cast("long").alias("after"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ticket n. ' || doc_id || '/25 aperto' WHEN 1 THEN 'pratica {{NUM}} e ' || doc_id WHEN 2 THEN 'protocollo 12' ELSE 'nessun numero ' || doc_id END AS t FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id || '/25' WHEN 2 THEN '12' ELSE '' END AS numbers FROM t""")
def stray_case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 4
    text = F.when(m == 0, F.concat(F.lit("ticket n. "), k, F.lit("/25 aperto"))).when(m == 1, F.concat(F.lit("pratica {{NUM}} e "), k)).when(m == 2, "protocollo 12").otherwise(F.concat(F.lit("nessun numero "), k))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.array_join(V.stray_numbers(text), ",").alias("numbers"))


@query("""SELECT event_id, event_id % 3 = 0 AS fenced, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.' || json_keys(props)[1]) END AS first_value FROM events""")
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as model answers: some in a code fence, some cut off; the first key's value where the JSON is whole."""
    p = F.when(F.col("event_id") % 5 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).otherwise(p)
    got = V.parsed(fx.table(spark, sf_dir, "events").withColumn("answer", text), "answer", "map<string,string>")
    return got.select("event_id", "fenced", F.map_values("chat")[0].alias("first_value"))


@query("""SELECT label, CASE WHEN starts_with(lower(label), 'claude-') THEN 'anthropic' ELSE 'openai' END AS provider FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'Claude-' ELSE 'x-' END || p_brand AS label FROM part)""")
def provider_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.when(F.col("p_size") % 2 == 0, "Claude-").otherwise("x-"), F.col("p_brand")).alias("label")
    return fx.table(spark, sf_dir, "part").select(label).distinct().select("label", V.provider_of(F.col("label")).alias("provider"))


# --- further reports -------------------------------------------------------------------------


@query(f"""SELECT state, count(*) AS n FROM ({fx.OUTCOMES}) GROUP BY state""")
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.outcomes(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""SELECT s.type, d.sender, count(*) AS n FROM ({STRICT_SQL}) s JOIN ({fx.DOCS}) d ON s.id = d.id GROUP BY s.type, d.sender""")
def category_role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.detected(fx.docs(spark, sf_dir).select("id", "sender", "text"), fx.STRICT)
    return rows.groupBy("type", "sender").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderstatus AS model, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT model, max(value) FILTER (i = CAST(floor(0.025 * n) AS BIGINT)) AS lo, max(value) FILTER (i = CAST(floor(0.975 * n) AS BIGINT) - 1) AS hi FROM r GROUP BY model""")
def index_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_totalprice").alias("value"))
    return R.index_interval(rows, ["model"])


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'segnalato' ELSE 'non_revisionato' END AS review FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def reviewed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, toxic labels as review notes."""
    sha = F.lit("s")
    records = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", sha.alias("source_sha256"))
    notes = fx.table(spark, sf_dir, "labels").where("toxic = 1").select(sha.alias("sha256"), F.col("doc_id").cast("string").alias("id"), F.lit("toxic").alias("note"))
    return X.reviewed(records, notes).select("doc_id", "review")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 12 THEN 'in bozza' ELSE '' END AS signals FROM customer""")
def coherence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary that claims a draft, where the user said so only in some nations."""
    said = F.when(F.col("c_nationkey") < 12, "aiuto").otherwise("la scheda e' IN BOZZA")
    rows = fx.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array(F.struct(F.lit("Utente").alias("sender"), said.alias("text")), F.struct(F.lit("Agente").alias("sender"), F.lit("in bozza?").alias("text"))).alias("messages"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Pratica in bozza").otherwise("Altro").alias("description"),
    )
    return rows.select("c_custkey", F.array_join(V.coherence_signals(), ",").alias("signals"))


@query(f"""{_ADDRESS} SELECT CAST(k AS VARCHAR) AS id, CASE WHEN r IS NULL THEN 'street_civic' END AS problem FROM b""")
def child_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and the nested views of those that the catalogue could split."""
    rows = _addresses(spark, sf_dir)
    plain = rows.withColumn("components", F.lit(None).cast(rows.schema["components"].dataType))
    towns = fx.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    known = spark.createDataFrame([], "id string, field string, start int, end int, type string")
    return A.children(plain, A.expanded(plain, known, towns)).select("id", "problem")


@query("""SELECT count(DISTINCT lang || '|' || source) AS variants, count(DISTINCT lang || '|' || source) = 1 AS uniform FROM documents""")
def uniform_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.uniform(fx.table(spark, sf_dir, "documents"), ["lang", "source"])


_LAST = f"""SELECT *, max("end") OVER (PARTITION BY id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT id, start, "end", min(type) AS type FROM ({STRICT_SQL} UNION ALL {PRED_SQL}) GROUP BY id, start, "end")"""


@query(f"""SELECT id, start, "end", type, CASE WHEN type NOT IN ('EMAIL', 'PHONE', 'PASSWORD') THEN 'field or type' ELSE 'overlap' END AS reason FROM ({_LAST}) WHERE type NOT IN ('EMAIL', 'PHONE', 'PASSWORD') OR prev > start""")
def invalid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict matches and the imperfect detector's together, under the older type set: LOCATION is not in it, and many overlap."""
    rows = fx.spans(spark, sf_dir, fx.STRICT).select(*E.SPAN).union(fx.predicted(spark, sf_dir).select(*E.SPAN)).groupBy("id", "idx", "start", "end").agg(F.min("type").alias("type"))
    return S.invalid_spans(rows, fx.docs(spark, sf_dir), M.MASKING_TYPES).select("id", "start", "end", "type", "reason")


# --- from chats to gold ----------------------------------------------------------------------


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat for each customer. For every fifth one the name is what a reference says too."""
    k = F.col("c_custkey")
    odd = k % 5 == 0
    number = k.cast("string")
    piece = lambda key, a, text: F.struct(F.lit(key).alias("key"), F.struct(a.cast("int").alias("start"), (a + F.length(text)).cast("int").alias("end"), text.alias("text")).alias("value"))
    parts = F.map_from_entries(F.array(piece("street_name", F.lit(4), number), piece("municipality", F.length(number) + 8, F.lit("Roma"))))
    none = F.lit(None).cast("map<string,struct<start:int,end:int,text:string>>")
    slot = lambda name, value, kind, key, variant, components: F.struct(F.lit(name).alias("slot"), value.alias("value"), kind.alias("type"), F.lit(key).alias("entity_id"), F.lit(variant).cast("string").alias("address_variant"), components.alias("components"))
    slots = F.array(
        slot("{{NOME}}", F.when(odd, "IST").otherwise(F.col("c_name")), F.when(odd, "COD_INDAGINE").otherwise("PERSON"), "nome", None, none),
        slot("{{VIA}}", F.concat(F.lit("Via "), number, F.lit(" 5, Roma")), F.lit("ADDRESS"), "via", "complete_standard", parts),
    )
    reference = lambda key, text, kind: F.struct(F.lit(key).alias("reference_id"), F.lit(text).alias("reference"), F.lit(kind).alias("type"))
    say = lambda who, text: F.struct(F.lit(who).alias("sender"), F.lit(text).alias("text"))
    return fx.spread(fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(
        number.alias("id"),
        F.array(say("Utente", "Scrive {{NOME}} da {{VIA}}."), say("Agente", "Buongiorno {{NOME}}, IST va bene."), say("Utente", "IST sia.")).alias("messages"),
        F.lit("{{NOME}} chiede").alias("description"), slots.alias("slots"), F.array(reference("nome", "{{NOME}}", "PERSON"), reference("codice", "IST", "COD_INDAGINE")).alias("references"),
        F.array(F.lit("tenere {{VIA}}")).alias("keep"), F.lit("nome {{NOME}}").alias("reason"),
    )


_CHATS = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'IST' ELSE c_name END AS v, CASE WHEN c_custkey % 5 = 0 THEN 'COD_INDAGINE' ELSE 'PERSON' END AS t, 'Via ' || c_custkey || ' 5, Roma' AS a, length(CAST(c_custkey AS VARCHAR)) AS ln FROM customer)"""


@query(f"""WITH {_CHATS}, r AS (
SELECT id, 0 AS idx, 7 AS start, v AS text, t AS type, 'nome' AS ref, 1 AS s, CAST(NULL AS INTEGER) AS town FROM c UNION ALL SELECT id, 0, 11 + length(v), a, 'ADDRESS', 'via', 1, 11 + length(v) + ln + 8 FROM c
UNION ALL SELECT id, 1, 11, v, t, 'nome', 1, NULL FROM c UNION ALL SELECT id, 1, 13 + length(v), 'IST', 'COD_INDAGINE', 'codice', 2, NULL FROM c UNION ALL SELECT id, 2, 0, 'IST', 'COD_INDAGINE', 'codice', 2, NULL FROM c
UNION ALL SELECT id, 0, 7, 'IST', 'COD_INDAGINE', 'codice', 2, NULL FROM c WHERE v = 'IST' UNION ALL SELECT id, 1, 11, 'IST', 'COD_INDAGINE', 'codice', 2, NULL FROM c WHERE v = 'IST')
SELECT id, 'conversazione.' || idx || '.testo' AS field, CAST(start AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS "end", text, type, CAST(count(*) AS INTEGER) AS n_sources, min_by(ref, s) AS reference_id, CAST(max(town) AS INTEGER) AS town_start
FROM r GROUP BY id, idx, start, text, type""")
def expected_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Gd.expected(_chats(spark, sf_dir)).expected
    town = F.col("metadata.address_components")["municipality"]["start"]
    return got.select("id", "field", "start", "end", "text", "type", F.size("sources").alias("n_sources"), F.col("metadata.reference_id").alias("reference_id"), town.alias("town_start"))


@query(f"""WITH {_CHATS} SELECT id, 0 AS idx, 'Utente' AS sender, 'Scrive ' || v || ' da ' || a || '.' AS text FROM c UNION ALL SELECT id, 1, 'Agente', 'Buongiorno ' || v || ', IST va bene.' FROM c UNION ALL SELECT id, 2, 'Utente', 'IST sia.' FROM c""")
def concrete_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Gd.replaced_only(_chats(spark, sf_dir)).messages


@query(f"""WITH {_CHATS} SELECT id, 'conversazione.0.testo' AS field, CAST(7 AS INTEGER) AS start, CAST(7 + length(v) AS INTEGER) AS "end", t AS type, v AS text FROM c UNION ALL SELECT id, 'conversazione.0.testo', 11 + length(v), 11 + length(v) + length(a), 'ADDRESS', a FROM c
UNION ALL SELECT id, 'conversazione.1.testo', 11, 11 + length(v), t, v FROM c UNION ALL SELECT id, 'metadati.descrizione', 0, length(v), t, v FROM c UNION ALL SELECT id, 'trattamento_atteso.conservare.0', 7, 7 + length(a), 'ADDRESS', a FROM c UNION ALL SELECT id, 'trattamento_atteso.motivazione', 5, 5 + length(v), t, v FROM c""")
def masked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all fields in the older masking format, explanations too."""
    chats = _chats(spark, sf_dir).withColumn("slots", F.transform("slots", lambda e: F.struct(e["slot"].alias("slot"), e["value"].alias("value"), e["type"].alias("type"), e["entity_id"].alias("entity_id"), F.lit("[X]").alias("substitute"))))
    return Gd.masked(chats).expected.select("id", "field", "start", "end", "type", "text")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats with one fault each, by key modulo 12; the first is sound."""
    k = F.col("c_custkey") % 12
    say = lambda i, text: F.struct(F.lit(("Utente", "Agente")[i % 2]).alias("sender"), F.lit(text).alias("text"))
    whole = [say(i, t) for i, t in enumerate(("Sono {{A}}", "ok", "ref X1", "bene {{A}}", "grazie", "prego"))]
    swap = lambda at, item: F.array(*[item if i == at else m for i, m in enumerate(whole)])
    messages = (
        F.when(k == 2, F.array(whole[0])).when(k == 3, swap(1, say(0, "ok"))).when(k == 4, F.array(*whole[:4])).when(k == 6, F.array(say(0, "Sono io"), say(1, "ok"), *whole[2:3], say(1, "bene"), *whole[4:]))
        .when(k == 7, swap(4, say(0, "grazie, Mario"))).when(k == 10, swap(3, say(1, "bene"))).when(k == 11, swap(4, say(0, "la pratica 123/25"))).otherwise(F.array(*whole))
    )
    slot = F.struct(F.lit("{{A}}").alias("slot"), F.lit("Mario").alias("value"), F.lit("PERSON").alias("type"), F.lit("a").alias("entity_id"))
    reference = F.struct(F.lit("r").alias("reference_id"), F.when(k == 8, "X9").otherwise("X1").alias("reference"), F.lit("INDAGINE").alias("type"))
    return fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), messages.alias("messages"), F.when(k == 1, " ").when(k == 9, "{{A}}: in bozza").otherwise("caso di {{A}}").alias("description"),
        F.when(k == 5, F.array(slot, slot)).otherwise(F.array(slot)).alias("slots"), F.array(reference).alias("references"), F.array(F.lit("{{A}}")).alias("repeat"), F.lit(3).alias("exchanges"),
    )


_FAULTS = "['description', 'too short', 'turns', 'exchanges', 'repeated slots', 'slots', 'value instead of slot', 'references']"


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 12 BETWEEN 1 AND 8 THEN {_FAULTS}[CAST(c_custkey % 12 AS INTEGER)] END AS error FROM customer""")
def structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("id", V.structural_error().alias("error"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 12 BETWEEN 1 AND 8 THEN 'errore' WHEN c_custkey % 12 = 0 THEN 'valido' ELSE 'da_verificare' END AS state FROM customer""")
def chat_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prepared(_planned(spark, sf_dir)).select("id", "state")


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 1 THEN 'treatments' WHEN 2 THEN 'treatments' WHEN 3 THEN 'explanations' END AS error FROM customer""")
def treatment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older format's list of treatments: whole, short, with another substitute, without a reason."""
    k = F.col("c_custkey") % 4
    one = lambda s, x: F.struct(F.lit(s).alias("slot"), F.lit("PERSON").alias("type"), F.lit(x).alias("substitute"))
    both = F.array(one("{{B}}", "[P]"), one("{{A}}", "[P]"))
    rows = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.array(one("{{A}}", "[P]"), one("{{B}}", "[P]")).alias("slots"), F.when(k == 1, F.array(one("{{A}}", "[P]"))).when(k == 2, F.array(one("{{A}}", "[P]"), one("{{B}}", "[Q]"))).otherwise(both).alias("masked"),
        F.array(F.lit("x")).alias("keep"), F.when(k != 3, "perché").alias("reason"),
    )
    return rows.select("id", V.treatment_error().alias("error"))


@query("""SELECT c_custkey AS id, provider, CASE WHEN c_custkey % 3 = 0 THEN 'hi ' || c_custkey WHEN c_custkey % 3 = 2 THEN '' END AS text, CASE c_custkey % 3 WHEN 1 THEN 'incomplete' WHEN 2 THEN 'empty' END AS error
FROM customer, (SELECT unnest(['openai', 'anthropic']) AS provider)""")
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers in the shapes of two providers: whole, cut off, empty."""
    k = F.col("c_custkey")
    word = F.when(k % 3 == 2, "").otherwise(F.concat(F.lit("hi "), k.cast("string")))
    done = k % 3 != 1
    shapes = {
        "openai": F.format_string('{"status":"%s","output":[{"content":[{"type":"output_text","text":"%s"}]}]}', F.when(done, "completed").otherwise("incomplete"), word),
        "anthropic": F.format_string('{"stop_reason":"%s","content":[{"type":"thinking"},{"type":"text","text":"%s"}]}', F.when(done, "end_turn").otherwise("max_tokens"), word),
    }
    out = None
    for provider, shape in shapes.items():
        rows = fx.table(spark, sf_dir, "customer").select(k.alias("id"), F.parse_json(shape).alias("response"))
        text, error = V.answer_text(provider)
        one = rows.select("id", F.lit(provider).alias("provider"), F.when(~F.coalesce(error == "incomplete", F.lit(False)), text).alias("text"), error.alias("error"))
        out = one if out is None else out.union(one)
    return out


@query(f"""{_ADDRESS} SELECT CAST(k AS VARCHAR) AS id, CASE WHEN h IS NOT NULL THEN 'street:10-' || (10 + street_end) || ' house_number:' || (10 + street_end + 1) || '-' || (10 + line_end) || ' municipality:100-104' END AS parts FROM b""")
def addresses_from_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of addresses that have two nested views only, by the house number at the street's end."""
    rows = _addresses(spark, sf_dir)
    street = F.when(F.col("components")["house_number"].isNull(), "Via Roma").otherwise(F.substring_index("text", ",", 1))
    parts = A.from_children(street, F.lit(10), F.lit(100), F.lit(104))
    show = F.array_join(F.transform(parts, lambda p: F.concat(p["name"], F.lit(":"), p["start"].cast("string"), F.lit("-"), p["end"].cast("string"))), " ")
    return rows.select("id", show.alias("parts"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 5 IN (1, 2)""")
def invalid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of which some name an unknown component or quote another text."""
    rows = _addresses(spark, sf_dir)
    k = F.col("key") % 5
    other = F.transform_values("components", lambda n, v: F.struct(v["start"].alias("start"), v["end"].alias("end"), F.lit("?").alias("text")))
    renamed = F.transform_keys("components", lambda n, v: F.when(n == "street_type", "kind").otherwise(n))
    return A.invalid_components(rows.withColumn("components", F.when(k == 1, other).when(k == 2, renamed).otherwise(F.col("components")))).select("id")


@query("""WITH r AS (SELECT o_orderpriority AS p, CAST(o_custkey AS VARCHAR) AS id FROM orders), q AS (SELECT sha256(left(p, 1)) || ':' || id AS key, count(*) AS n FROM r GROUP BY p, id)
SELECT key, n FROM q""")
def qualified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several sources under keys of their sources' hashes, and how often a source has each."""
    path = F.col("o_orderpriority")
    records = fx.table(spark, sf_dir, "orders").select(path.alias("source_path"), F.col("o_custkey").cast("string").alias("id"))
    sources = records.select(F.col("source_path").alias("path")).distinct().withColumn("sha256", F.sha2(F.substring("path", 1, 1).cast("binary"), 256))
    return X.qualified(records, sources).groupBy("key").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderpriority AS p, CAST(o_custkey AS VARCHAR) AS id FROM orders) SELECT sha256(left(p, 1)) || ':' || id AS what, 'repeated id' AS problem FROM r GROUP BY p, id HAVING count(*) > 1""")
def source_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("o_orderpriority")
    records = fx.table(spark, sf_dir, "orders").select(path.alias("source_path"), F.col("o_custkey").cast("string").alias("id"))
    sources = records.select(F.col("source_path").alias("path")).distinct().withColumn("sha256", F.sha2(F.substring("path", 1, 1).cast("binary"), 256))
    return X.source_problems(X.qualified(records, sources), sources)


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n FROM customer) SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 7 = 0 THEN 'No {{WHO}} here' WHEN k % 3 = 0 THEN 'P0' || k || ': ' || n || ' is ' || n ELSE 'Dear ' || n || ', your code is P0' || k || '.' END AS text FROM c""")
def replaced_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitution without spans; an unknown slot stays."""
    rows = _slotted(spark, sf_dir).withColumn("values", F.map_from_entries(F.transform("entities", lambda e: F.struct(e["slot"].alias("key"), e["value"].alias("value")))))
    return rows.select("id", S.replaced("text", "values").alias("text"))


CODES = RULES | {"COD_UTENTE": {"varianti": [{"prefisso": "P0", "cifre": 8}, {"prefisso": "", "cifre": 7}]}, "PASSWORD": {"lunghezze": [8, 10], "alfabeto": "abcXYZ123!"}}


def _digits_sql(n: int, salt: str) -> str:
    return "(" + " || ".join(f"CAST({_draw_sql(str(SEED), 'c_custkey', repr(salt), repr(str(i)))} % 10 AS VARCHAR)" for i in range(n)) + ")"


def _pick_sql(values: list, salt: str) -> str:
    return "[" + ", ".join(repr(v) for v in values) + f"][CAST({_draw_sql(str(SEED), 'c_custkey', repr(salt))} % {len(values)} + 1 AS INTEGER)]"


@query(f"""SELECT c_custkey, CASE WHEN {_draw_sql(str(SEED), "c_custkey", "'v'")} % 2 = 0 THEN 'P0' || {_digits_sql(8, "d")} ELSE {_digits_sql(7, "d")} END AS user_code,
  left({" || ".join(_pick_sql(list(CODES["PASSWORD"]["alfabeto"]), str(i)) for i in range(10))}, {_pick_sql([8, 10], "n")}) AS password,
  {_pick_sql(["", "+39 "], "p")} || concat_ws({_pick_sql(["", " ", "."], "s")}, left(num, 3), substr(num, 4, 3), substr(num, 7)) AS phone FROM (SELECT c_custkey, '3' || {_digits_sql(9, "d")} AS num FROM customer)""")
def value_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda kind, name: G.value_code(kind, CODES, str(SEED), F.col("c_custkey")).alias(name)
    return fx.table(spark, sf_dir, "customer").select("c_custkey", one("COD_UTENTE", "user_code"), one("PASSWORD", "password"), one("PHONE", "phone"))


@query(f"""SELECT c_custkey, strftime(DATE '2025-01-01' + CAST({_draw_sql(str(SEED), "c_custkey", "'day'")} % 365 AS INTEGER), '%Y-%m-%d') AS day FROM customer""")
def synthetic_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select("c_custkey", G.synthetic_date("2025-01-01", 365, str(SEED), F.col("c_custkey")).alias("day"))


def _allowed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as scenarios with the codes of their region and of the next one; regions as surveys, the last of which is missing."""
    n = fx.table(spark, sf_dir, "nation")
    codes = F.array(F.concat(F.lit("S"), F.col("n_regionkey").cast("string")), F.concat(F.lit("S"), ((F.col("n_regionkey") + 1) % 5).cast("string")))
    r = fx.table(spark, sf_dir, "region").where("r_regionkey < 4")
    kind = F.when(F.col("r_regionkey") == 1, "da_verificare").otherwise("imprese")
    return n.select(F.col("n_name").alias("scenario"), F.lit("imprese").alias("respondent"), codes.alias("codes")), r.select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name"), kind.alias("respondent"))


@query(f"""WITH s AS (SELECT n_name AS scenario, list_sort(['S' || n_regionkey, 'S' || ((n_regionkey + 1) % 5)]) AS codes FROM nation), c AS (SELECT scenario, codes[CAST({_draw_sql(str(SEED), "scenario")} % 2 + 1 AS INTEGER)] AS code FROM s)
SELECT scenario, code, r_name AS survey FROM c LEFT JOIN region ON code = 'S' || r_regionkey AND r_regionkey < 4""")
def survey_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.survey_choice(*_allowed(spark, sf_dir), SEED).select("scenario", "code", "survey")


@query("""WITH s AS (SELECT n_name AS scenario, unnest(['S' || n_regionkey, 'S' || ((n_regionkey + 1) % 5)]) AS code FROM nation) SELECT scenario, code, CASE code WHEN 'S4' THEN 'unknown' ELSE 'respondent' END AS problem FROM s WHERE code IN ('S1', 'S4')""")
def survey_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.survey_problems(*_allowed(spark, sf_dir))


@query("""SELECT c_custkey, 'a={{A}}:MASK' || CASE WHEN c_custkey % 3 <> 0 THEN ',codice_indagine=S1:KEEP' ELSE '' END || ',nome_indagine=' || c_mktsegment || ':KEEP,periodo_ricerca=' || (2000 + c_custkey % 25) || ':KEEP,s=x:REVIEW' AS refs FROM customer""")
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    entity = F.array(F.struct(F.lit("a").alias("entity_id"), F.lit("{{A}}").alias("slot"), F.lit("PERSON").alias("type")))
    static = F.array(F.struct(F.lit("s").alias("reference_id"), F.lit("x").alias("reference"), F.lit("OFFICE").alias("type"), F.lit("REVIEW").alias("hypothesis"), F.lit("OPEN").alias("state")))
    refs = G.reference_list(entity, F.when(k % 3 != 0, "S1"), F.col("c_mktsegment"), F.lit(None).cast("string"), (2000 + k % 25).cast("int"), static)
    show = F.array_join(F.transform(refs, lambda r: F.concat(r["reference_id"], F.lit("="), r["reference"], F.lit(":"), r["hypothesis"])), ",")
    return fx.table(spark, sf_dir, "customer").select("c_custkey", show.alias("refs"))


@query(f"""{_EVAL}, n AS (SELECT c.type, d.sender, {_COUNTS} FROM c JOIN d ON c.id = d.id GROUP BY c.type, d.sender)
SELECT type, sender, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM n""")
def zero_default_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _evaluation(spark, sf_dir).spans.join(fx.docs(spark, sf_dir).select("id", "sender"), "id")
    return E.with_scores(E.counted(spans, "type", "sender"), zero=True)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS id, 'repeated' AS problem FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'other prompt' FROM orders WHERE o_orderstatus = 'O'""")
def run_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers against the prompts that are expected: orders for customers, open ones with another prompt."""
    prompts = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("p").alias("prompt"))
    answers = fx.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    answers = answers.select(F.col("o_custkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "O", "q").otherwise("p").alias("prompt"), F.lit("m").alias("deployment"), F.lit("openai").alias("provider"), F.lit("valido").alias("state"))
    return X.run_problems(prompts, answers, ["prompt"], "m", "openai")


@query()
def default_rule_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that come with the package, over documents. They look around their matches, which DuckDB's patterns can't."""
    return M.resolved(fx.docs(spark, sf_dir).select("id", "idx", "text"), M.read_rules())


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats as JSON texts with a fault of shape each, by key modulo 7; the first is sound."""
    k = F.col("c_custkey") % 7
    day = F.concat(F.lit('"data_sintetica":"'), F.when(k == 3, "x").otherwise("d"), F.lit('"'))
    meta = F.concat(F.lit("{"), day, F.lit(',"descrizione":"a"'), F.when(k == 2, ',"altro":"b"').otherwise(""), F.lit("}"))
    talk = F.when(k == 4, '[{"sender":"Utente","testo":"a","x":"1"}]').otherwise('[{"sender":"Utente","testo":"a"}]')
    text = F.concat(F.lit('{"metadati":'), meta, F.lit(',"conversazione":'), talk, F.when(k == 1, ',"altro":1').otherwise(""), F.lit("}"))
    slots = F.when(k == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("{{A}}")))
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("content"), slots.alias("slots"), F.when(k == 6, V.MODES[1]).otherwise(V.MODES[0]).alias("mode"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN ['parts', 'metadata', 'fixed metadata', 'messages', 'mode', 'mode'][CAST(c_custkey % 7 AS INTEGER)] END AS error FROM customer""")
def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select("id", V.schema_error("content", F.create_map(F.lit("data_sintetica"), F.lit("d")), "mode").alias("error"))


@query(f"""WITH m AS ({_ORDERED}), b AS (SELECT id, pos, sender, CASE WHEN pos % 4 = 1 THEN ' ' ELSE text END AS text FROM (SELECT id, pos, CASE WHEN pos % 4 = 2 THEN lag(sender) OVER (PARTITION BY id ORDER BY pos) ELSE sender END AS sender, text FROM m)),
n AS (SELECT *, lead(sender) OVER w AS s2, lead(text) OVER w AS t2 FROM b WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, coalesce(string_agg(CASE WHEN trim(text) = '' AND coalesce(s2 = sender, false) AND trim(coalesce(t2, '')) <> '' THEN CAST(pos + 1 AS VARCHAR) END, ',' ORDER BY pos), '') AS removed FROM n GROUP BY id""")
def repair_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    broken = F.transform("messages", lambda x, i: F.struct(F.when(i % 4 == 2, F.get(m, i - 1)["sender"]).otherwise(x["sender"]).alias("sender"), F.when(i % 4 == 1, F.lit(" ")).otherwise(x["text"]).alias("text")))
    rows = _conversations(spark, sf_dir).withColumn("messages", broken)
    return rows.select("id", F.array_join(F.transform(V.repair_log(), lambda x: x["message"].cast("string")), ",").alias("removed"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 25""")
def first_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.selected(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")), head=25)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'reused' WHEN 'O' THEN 'previous' ELSE 'new' END AS origin FROM orders""")
def combined_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three origins, by the state of orders."""
    part = lambda s: fx.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").cast("string").alias("id"))
    return X.combined(part("F"), part("O"), part("P"))[0]
