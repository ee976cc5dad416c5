"""Views of the tables as messages, gold and predictions, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.operators.matching import Rule, detected

_MAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
_IP = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"
_TOKEN = 'token = "([0-9a-f]{40})'
_PHONE = r"((?:\+1 )?\([0-9]{3}\) [0-9]{3}-[0-9]{4})"

#: What counts as true here, and what a looser detector finds. No look-around, so that every engine reads them alike.
STRICT = [Rule("mail", "EMAIL", 100, _MAIL, ""), Rule("ip", "LOCATION", 90, _IP, ""), Rule("token", "PASSWORD", 80, _TOKEN, ""), Rule("phone", "PHONE", 50, _PHONE, "")]
LOOSE = [
    Rule("mail_loose", "EMAIL", 70, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", ""),
    Rule("ip_loose", "LOCATION", 60, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", ""),
    Rule("token_loose", "PASSWORD", 40, 'token = "([0-9a-f]{8,40})', ""),
    Rule("phone_loose", "PHONE", 30, r"((?:\+1 )?\(?[0-9]{3}\)? ?[0-9]{3}-[0-9]{4})", ""),
]
TYPES = ("EMAIL", "LOCATION", "PASSWORD", "PHONE")
FOCUS = ("EMAIL", "PHONE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Short rows dealt to all cores, for work that is long beside the bytes that a scan is split by."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages; a system turn has no sender of the format."""
    sender = F.when(F.col("role") == "user", "Utente").when(F.col("role") == "assistant", "Agente")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").cast("int").alias("idx"), sender.alias("sender"), "role", "text")


MESSAGES = """SELECT CAST(conv_id AS VARCHAR) AS id, CAST(turn AS INTEGER) AS idx,
  CASE role WHEN 'user' THEN 'Utente' WHEN 'assistant' THEN 'Agente' END AS sender, role, text FROM conversations"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as conversations of one message."""
    sender = F.when(F.col("doc_id") % 2 == 0, "Utente").otherwise("Agente")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.lit(0).alias("idx"), sender.alias("sender"), "text", "doc_id", "n_chars")


DOCS = """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS id, 0 AS idx, CASE WHEN doc_id % 2 = 0 THEN 'Utente' ELSE 'Agente' END AS sender, text, doc_id, n_chars FROM documents"""


def spans(spark: SparkSession, sf_dir: str, rules: list[Rule]) -> DataFrame:
    """id, idx, doc_id, start, end, type, value, rule, priority of every match."""
    return detected(docs(spark, sf_dir).select("id", "idx", "doc_id", "text"), rules)


def spans_sql(rules: list[Rule]) -> str:
    parts = []
    for r in rules:
        p = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT id, 0 AS idx, doc_id, CAST(e - length(v[i]) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", '{r.type}' AS type, v[i] AS value, '{r.name}' AS rule, {r.priority} AS priority
FROM (SELECT id, doc_id, v, i, list_sum(list_transform(pc[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e
  FROM (SELECT id, doc_id, m, v, pc, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS id, doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', 1) AS v, string_split_regex(text, '{p}') AS pc
      FROM documents WHERE regexp_matches(text, '{p}'))))"""
        )
    return "\nUNION ALL\n".join(parts)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an imperfect detector finds: loose matches, of which by id and place some are left out, end early or get another type; and a false one at the end of every fifth text."""
    k = (F.col("doc_id") + F.col("start")) % 7
    rows = spans(spark, sf_dir, LOOSE).where(k != 0)
    other = F.when(F.col("type") == "PHONE", "PASSWORD").otherwise("PHONE")
    rows = rows.select(
        "id", "idx", "doc_id", "start", F.when(k == 1, F.col("end") - 1).otherwise(F.col("end")).alias("end"), F.when(k == 2, other).otherwise(F.col("type")).alias("type"),
        F.when(k == 1, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")).alias("value"), "rule", "priority",
    )
    size = F.length("text")
    false = docs(spark, sf_dir).where((F.col("doc_id") % 5 == 0) & (size >= 40))
    false = false.select("id", "idx", "doc_id", (size - 3).alias("start"), size.alias("end"), F.lit("PHONE").alias("type"), F.substring("text", size - 2, F.lit(3)).alias("value"), F.lit("tail").alias("rule"), F.lit(20).alias("priority"))
    return rows.union(false)


def predicted_sql() -> str:
    return f"""SELECT id, idx, doc_id, start, CASE WHEN (doc_id + start) % 7 = 1 THEN "end" - 1 ELSE "end" END AS "end",
  CASE WHEN (doc_id + start) % 7 <> 2 THEN type WHEN type = 'PHONE' THEN 'PASSWORD' ELSE 'PHONE' END AS type,
  CASE WHEN (doc_id + start) % 7 = 1 THEN substr(value, 1, length(value) - 1) ELSE value END AS value, rule, priority FROM ({spans_sql(LOOSE)}) WHERE (doc_id + start) % 7 <> 0
UNION ALL SELECT 'doc-' || CAST(doc_id AS VARCHAR), 0, doc_id, CAST(length(text) - 3 AS INTEGER), CAST(length(text) AS INTEGER), 'PHONE', substr(text, CAST(length(text) - 2 AS INTEGER), 3), 'tail', 20 FROM documents WHERE doc_id % 5 = 0 AND length(text) >= 40"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector that skips very short documents and runs out of time on very long ones."""
    failed = F.col("n_chars") > 12000
    return docs(spark, sf_dir).where("n_chars >= 40").select("id", F.when(failed, "errore").otherwise("ok").alias("state"), F.when(failed, "timeout").alias("error"))


OUTCOMES = """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN n_chars > 12000 THEN 'errore' ELSE 'ok' END AS state, CASE WHEN n_chars > 12000 THEN 'timeout' END AS error
  FROM documents WHERE n_chars >= 40"""


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of a detector that never fails."""
    return docs(spark, sf_dir).select("id", F.lit("ok").alias("state"), F.lit(None).cast("string").alias("error"))


def pseudo_score(*parts: str) -> Column:
    """A number in [0, 1) from columns, the same in SQL."""
    text = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def pseudo_score_sql(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(CAST(CAST('0x' || substr(sha256({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"
