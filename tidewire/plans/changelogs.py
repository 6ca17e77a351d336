"""Logs of changes applied to tables: events as an editor's actions on links and stories, orders as changes of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import changes
from tidewire.plans.registry import query
from tidewire.session import read_table

ACTIONS = """CASE event_type WHEN 'click' THEN 'delete' WHEN 'signup' THEN 'reactivate' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'discard' END WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'publish' END END"""


def _step(automaton: changes.Automaton) -> str:
    rules = " ".join(f"WHEN a = '{action}' AND s = '{a}' THEN '{b}'" for action, to in automaton.moves.items() for a, b in to.items())
    return f"list_reduce(list_prepend(coalesce(any_value(start), '{automaton.states[0]}'), list(coalesce(action, '') ORDER BY ts, event_id) FILTER (event_id IS NOT NULL)), lambda s, a: CASE {rules} ELSE s END)"


def _states_sql(automaton: changes.Automaton) -> str:
    return f"""WITH log AS (SELECT user_id, event_id, ts, {ACTIONS} AS action FROM events), old AS (SELECT DISTINCT c_custkey AS user_id, 'deleted' AS start FROM customer WHERE c_custkey % 4 = 0)
SELECT user_id, {_step(automaton)} AS state, count(event_id) AS changes FROM log FULL JOIN old USING (user_id) GROUP BY user_id"""


def _states(spark: SparkSession, sf_dir: str, automaton: changes.Automaton) -> DataFrame:
    log = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(ACTIONS).alias("action"))
    old = read_table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("deleted").alias("state")).distinct()
    return changes.fold_states(log, automaton, "user_id", ("ts", "event_id"), bucket=F.to_date("ts"), start=old)


@query(_states_sql(changes.LINKS))
def link_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether links are blocked after all actions in order: by the first reason, taken back only where an editor deleted."""
    return _states(spark, sf_dir, changes.LINKS)


@query(_states_sql(changes.STORIES))
def story_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of stories after all actions in order."""
    return _states(spark, sf_dir, changes.STORIES)


LOG = """log AS (SELECT o_custkey AS k, o_orderdate AS d, o_orderkey AS o, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS name, o_orderpriority = '5-LOW' AS low FROM orders)"""


@query(f"""WITH {LOG}, base AS (SELECT c_custkey AS k, any_value(c_name) AS name, round(any_value(c_acctbal), 2) AS price FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_custkey),
c AS (SELECT k, arg_max(price, (d, o)) FILTER (price IS NOT NULL) AS price, arg_max(name, (d, o)) FILTER (name IS NOT NULL) AS name, arg_max(low, (d, o)) AS gone FROM log GROUP BY k)
SELECT coalesce(base.k, c.k) AS k, coalesce(c.name, base.name) AS name, coalesce(c.price, base.price) AS price FROM base FULL JOIN c ON base.k = c.k WHERE NOT coalesce(gone, false)""")
def merged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after their orders as changes: the last value of each field wins, new keys come in, and those go whose last change is low."""
    c = F.col
    base = read_table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").groupBy(c("c_custkey").alias("k")).agg(F.any_value("c_name").alias("name"), F.round(F.any_value("c_acctbal"), 2).alias("price"))
    log = read_table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("k"), c("o_orderdate").alias("d"), c("o_orderkey").alias("o"), F.when(c("o_orderkey") % 3 != 0, c("o_totalprice")).alias("price"),
        F.when(c("o_orderkey") % 7 != 0, c("o_orderstatus")).alias("name"), (c("o_orderpriority") == "5-LOW").alias("low"),
    )
    return changes.merge_log(base, log, "k", ("d", "o"), ("name", "price"), deleted=c("low"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderdate < TIMESTAMP '1996-01-01' AS old, row_number() OVER (PARTITION BY o_custkey, o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderkey) AS place FROM orders),
m AS (SELECT k, max(place) AS last FROM o WHERE old GROUP BY k) SELECT k, o, (coalesce(last, 0) + place)::BIGINT AS version FROM o LEFT JOIN m USING (k) WHERE NOT old""")
def appended_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version numbers of new rows, behind those that their key has."""
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("old"))
    from_none = rows.where("old").limit(0).select("k", F.lit(0).alias("version"))
    old = changes.append_versions(from_none, rows.where("old").select("k", "o"), "k", ("o",)).select("k", "version")
    return changes.append_versions(old, rows.where("not old").select("k", "o"), "k", ("o",)).select("k", "o", F.col("version").cast("long").alias("version"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lang ELSE CASE WHEN doc_id % 8 = 0 THEN ' ' END END AS channel, text, source, length(regexp_replace(coalesce(text, ''), '[^!#|$]', '', 'g')) * 50 > n_chars AS dirty FROM documents)
SELECT doc_id, CASE WHEN coalesce(dirty, false) THEN '' ELSE coalesce(nullif(trim(channel), ''), source) END AS channel, md5(CASE WHEN coalesce(dirty, false) THEN '' ELSE text END) AS said, CASE WHEN coalesce(dirty, false) THEN 'new' ELSE 'kept' END AS status, NULL::VARCHAR AS note FROM t""")
def backfilled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty channels filled from the source, missing columns added, and contaminated texts blanked and sent back."""
    c = F.col
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.when(c("doc_id") % 4 != 0, c("lang")).otherwise(F.when(c("doc_id") % 8 == 0, " ")).alias("channel"), "text", "source", "n_chars")
    full = changes.backfill(rows, {"channel": c("source"), "status": F.lit("kept")}, {"note": "string"})
    dirty = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^!#|$]", "")) * 50 > c("n_chars")
    clean = changes.reset_rows(full, dirty, {"channel": F.lit(""), "text": F.lit(""), "status": F.lit("new")})
    return clean.select("doc_id", "channel", F.md5("text").alias("said"), "status", "note")
